"""Awkward documents that every operator has to bear."""

from pyspark.sql import types as T

LONG = " ".join(f"w{i % 997}x{i}" for i in range(6000))
PASSAGE = " ".join(f"passage{i}" for i in range(80))

#: id, text: nulls, empty and blank texts, a very long one, ties, repeated rows
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again\nand a second line of this same text here"),
    (2, "the QUICK brown fox jumps over the lazy dog again\nand a second line of this same text here"),
    (2, "the QUICK brown fox jumps over the lazy dog again\nand a second line of this same text here"),
    (3, None),
    (4, ""),
    (5, " \n\t \r\n"),
    (None, "The quick brown fox jumps over the lazy dog again\nand a second line of this same text here"),
    (None, None),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "Straße ÉCOLE naïve 漢字 😀 mail me at a.b@c.example.org now"),
    (9, "one two"),
    (10, "One Two"),
    (11, PASSAGE),
    (12, "before it " + PASSAGE + " after it"),
    (13, "aaaa " * 500),
]

# names that operators use inside
EXTRA = ("row", "th", "digest", "score", "n", "x", "key", "c", "at", "hits", "line", "words", "group_size", "kept")


def frame(spark, rows=ROWS):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(x, T.StringType()) for x in EXTRA]
    return spark.createDataFrame([(*r, *[None] * len(EXTRA)) for r in rows], T.StructType(fields))


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def thue_morse(n, a="a", b="b"):
    """Two strings of ``n`` letters, the Thue-Morse word and its complement, which polynomials modulo 2**64 mix up."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)
