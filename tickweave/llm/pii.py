"""Personal data: fixed patterns, and bootstrapped extraction by context.

Matches of the fixed patterns are the base and the seeds. Around every identifier-like
run of tokens stand lexical patterns: the word before, the word after, and both. The graph
of patterns and instances is scored in rounds: a pattern is trusted for a kind if nearly
all distinct instances it surrounds are known to be of that kind; an unknown instance that
several trusted patterns surround becomes known. Its occurrences in trusted patterns are
added to the spans.

All of it is SQL functions. Texts are read once; what is kept of one are its matches and
the lengths of the pieces between them.

The fixed patterns are written with possessive quantifiers and a look behind, which match
the same runs without stepping back or starting anew inside one: long runs cost linear time
and no deep stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.llm.registry import query
from tickweave.llm.shared import documents, materialise

LOCAL = "A-Za-z0-9._%+-"
LABEL = "[A-Za-z0-9-]++"
KINDS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@{LABEL}(?:\.{LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must hold for a kind to be searched
SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
DIGIT_TOKEN = r"[^\s0-9@]*+[0-9][^\s@]*+(?!\S)"
#: a token with an `@`, or a run of tokens with digits and without one
CANDIDATE = rf"(?<!\S)(?:[^\s@]*+@\S*+|{DIGIT_TOKEN}(?:\x20{DIGIT_TOKEN})*+)"
MANY_DIGITS = r"(?s)(?:[^0-9]*+[0-9]){4}"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda x: F.ascii(x) - 48)

    def share(x: Column, i: Column) -> Column:
        twice = 2 * x
        return F.when(i % 2 == 0, x).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(figures, share), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a fixed pattern is one of its kind."""
    n = F.length(digits(match))
    return (
        F.when(kind == "ip", match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), luhn(digits(match))))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(kind == "email")
    )


def found(text: Column, pattern: str, when: Column) -> Column:
    """Matches and the lengths of the pieces before them, in code points; null without a match."""
    matches = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(F.size(matches) > 0, matches)


def between(text: Column, pattern: str, matches: Column) -> Column:
    return F.when(matches.isNotNull(), F.split(text, pattern, -1))


def read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id`` of every document, with the matches of each kind and of candidates, written once."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"))
    slim = slim.withColumn("digit", F.col("text").rlike("[0-9]"))
    has = {k: F.lit(True) if s is None else F.instr("text", s) > 0 for k, s in SIGN.items()}
    need = {k: (has[k] if k == "email" else has[k] & F.col("digit")) for k in KINDS}
    patterns = KINDS | {"candidate": CANDIDATE}
    need["candidate"] = F.col("digit") | has["email"]
    slim = slim.select(
        "*", *[found(F.col("text"), p, need[k]).alias(f"m_{k}") for k, p in patterns.items()]
    )
    length = lambda k: F.transform(between(F.col("text"), patterns[k], F.col(f"m_{k}")), F.length)
    word = lambda x, i: F.lower(F.substring_index(F.trim(F.translate(x, "\n\t\r", "   ")), " ", i))
    pieces = between(F.col("text"), CANDIDATE, F.col("m_candidate"))
    # the last word of the piece before a candidate and the first of the piece after it
    near = F.transform(pieces, lambda x: F.struct(word(x, -1).alias("last"), word(x, 1).alias("first"), F.length(x).alias("n")))
    return materialise(
        slim.select(
            "row",
            "doc_id",
            *[F.col(f"m_{k}") for k in patterns],
            *[length(k).alias(f"n_{k}") for k in KINDS],
            near.alias("near"),
        ),
        "pii-matches",
    )


def placed(rows: DataFrame, *keys: str) -> DataFrame:
    """Start and end of matches ``i, match, n``; ``n`` is the length of the piece before a match."""
    order = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("n") + F.length("match")).over(order)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))


def base_spans(matches: DataFrame) -> DataFrame:
    """``row, kind, start, end`` of the valid matches of the fixed patterns."""
    both = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                F.arrays_zip(F.col(f"m_{k}").alias("match"), F.slice(f"n_{k}", 1, F.size(f"m_{k}")).alias("n")).alias("found"),
            )
            for k in KINDS
        ]
    )
    each = matches.select("row", F.explode(both).alias("k")).where("k.found is not null")
    each = each.select("row", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("i", "f"))
    each = each.select("row", "kind", "i", F.col("f.match").alias("match"), F.col("f.n").alias("n"))
    return placed(each, "row", "kind").where(valid(F.col("kind"), F.col("match"))).select("row", "kind", "start", "end")


def occurrences(matches: DataFrame) -> DataFrame:
    """Candidates with at least four digits or an ``@``: place, text, the words around, and the kind if known."""
    each = matches.where("m_candidate is not null").select(
        "row", "near", F.posexplode("m_candidate").alias("i", "match")
    )
    each = each.select(
        "row",
        "i",
        "match",
        F.col("near")[F.col("i")]["n"].alias("n"),
        F.col("near")[F.col("i")]["last"].alias("before"),
        F.col("near")[F.col("i") + 1]["first"].alias("after"),
    )
    known = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        parts = F.regexp_extract_all("match", F.lit(pattern), F.lit(0))
        held = F.exists(parts, lambda part: valid(F.lit(kind), part))  # noqa: B023
        known = F.when(held, F.lit(kind)).otherwise(known)
    return placed(each, "row").where(F.col("match").rlike(MANY_DIGITS) | F.contains("match", F.lit("@"))).select(
        "row", "start", "end", F.lower("match").alias("token"), "before", "after", known.alias("kind")
    )


def contexts() -> Column:
    """The lexical patterns around an occurrence; a side without a word gives none."""
    before, after = F.when(F.col("before") != "", F.col("before")), F.when(F.col("after") != "", F.col("after"))
    both = F.concat(F.lit("B "), before, F.lit(" "), after)
    return F.array_compact(F.array(F.concat(F.lit("L "), before), F.concat(F.lit("R "), after), both))


def bootstrap(edges: DataFrame, seeds: DataFrame, rounds: int, trust: float, support: int, accept: float):
    """Known instances ``token, kind, conf`` beyond the seeds, and trusted patterns ``pattern, kind``."""
    # the confidence of a found instance may round to 1 as well, so seeds have a mark of their own
    known = materialise(seeds.withColumns({"conf": F.lit(1.0), "seed": F.lit(True)}), "known")
    total = materialise(edges.groupBy("pattern").agg(F.count("*").alias("total")), "pattern-totals")
    trusted = None
    for _ in range(rounds):
        held = edges.join(known, "token").groupBy("pattern", "kind")
        held = held.agg(F.sum("conf").alias("weight"), F.count("*").alias("held"))
        good = held.join(total, "pattern").where(
            (F.col("held") >= support) & (F.col("weight") >= trust * F.col("total"))
        )
        trusted = materialise(
            good.select("pattern", "kind", (F.col("weight") / F.col("total")).alias("sure")), "trusted"
        )
        # several patterns, each partly sure, make an instance surer
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("sure")))))
        met = edges.join(trusted, "pattern").join(known.select("token"), "token", "left_anti")
        found_ = met.groupBy("token", "kind").agg((1 - doubt).alias("conf"), F.count("*").alias("times"))
        best = found_.groupBy("token").agg(F.max(F.struct("conf", "times", "kind")).alias("b"))
        new = best.where((F.col("b.conf") >= accept) & (F.col("b.times") >= 2))
        new = materialise(new.select("token", F.col("b.kind").alias("kind"), F.col("b.conf").alias("conf")), "found")
        if new.isEmpty():
            break
        known = materialise(known.unionByName(new.withColumn("seed", F.lit(False))), "known")
    return known.where("not seed").drop("seed"), trusted.select("pattern", "kind")


def personal_data(
    docs: DataFrame,
    rounds: int = 3,
    trust: float = 0.8,
    support: int = 3,
    accept: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: counts of base spans by kind, ``base_sha256``, ``spans`` and ``n_added``.

    Spans are ``kind:start:end`` in code points, end exclusive, sorted by kind (email, ip,
    card, phone) and start, joined by commas. A pattern is trusted for a kind with at least
    ``support`` distinct known instances that carry ``trust`` of all its distinct instances;
    an instance becomes known at a confidence of ``accept`` from two or more patterns. A null
    text is empty; ids may be null or repeated, and every row is a document of its own. Other
    columns are ignored; an empty table gives no rows.
    """
    matches = read(docs, id_col, text_col)
    base = materialise(base_spans(matches), "base-spans")
    seen = materialise(occurrences(matches), "occurrences")
    around = seen.select("row", "start", "end", "token", F.explode(contexts()).alias("pattern"))
    edges = materialise(around.select("pattern", "token").distinct(), "pattern-edges")
    seeds = seen.where("kind is not null").groupBy("token").agg(F.min("kind").alias("kind"))
    known, trusted = bootstrap(edges, seeds, rounds, trust, support, accept)
    added = around.join(known, "token").join(trusted, ["pattern", "kind"]).select("row", "kind", "start", "end").distinct()
    every = base.withColumn("base", F.lit(True)).unionByName(added.withColumn("base", F.lit(False)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct(rank.alias("rank"), "start", "end", "base", F.concat_ws(":", "kind", "start", "end").alias("text"))
    spans = every.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    joined = matches.select("row", "doc_id").join(spans, "row", "left")
    own = F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType))
    joined = joined.select("doc_id", own.alias("spans"))
    base_only = F.filter("spans", lambda s: s["base"])
    text = lambda a: F.array_join(F.transform(a, lambda s: s["text"]), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["base"] & (s["rank"] == i))).cast("long")
    return joined.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS, 1)],
        F.sha2(text(base_only), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base_only)).cast("long").alias("n_added"),
    )


@query("op7_pii_bootstrap")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
