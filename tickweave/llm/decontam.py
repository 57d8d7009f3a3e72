"""Benchmark decontamination: size-partitioned MinHash containment, verified exactly.

An item is found in a document when the document holds at least ``num / den`` of its
distinct five-word shingles. Items are partitioned by size, a power of two each. The
signature of an item is its ``m`` smallest shingle hashes, with ``m`` set by its partition
so that a document with enough of the item's shingles must hold one of the signature: it
may lack fewer than ``m`` of them. Documents look their hashes up in the signatures of
the partitions that are not too large for them. So no item is missed, however short it is
and however long the document. What is found is verified by the shingles themselves.

All of it is SQL functions; a document's hashes stream through one generator into the
lookup, and only hits are shuffled. The signatures are written first, so the planner knows
their size and broadcasts them only below its own limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.registry import query
from tickweave.llm.shared import documents, materialise

SIZE = 5
BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Lower-cased words between white space; an empty array for a null, empty or blank text."""
    bare = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def runs(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Every run of five values of an array column as ``g0 .. g4``; a shorter array is one run, filled with nulls."""
    n = F.size(column)
    zipped = F.arrays_zip(*[(F.col(column) if i == 0 else F.slice(column, i + 1, n)).alias(f"g{i}") for i in range(SIZE)])
    out = rows.select(*keep, n.alias("size"), F.inline(zipped).alias(*[f"g{i}" for i in range(SIZE)]))
    last = F.col("g4")
    for i in range(1, SIZE):
        last = F.when(F.col("size") == i, F.col(f"g{i - 1}")).otherwise(last)
    return out.where(last.isNotNull())


def hashed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the number of words and the hash ``g`` of every shingle of ``rows`` with ``words``; repeats stay."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    return runs(rows, "h", keep).select(*keep, "size", F.xxhash64(*[f"g{i}" for i in range(SIZE)]).alias("g"))


def spelled(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the text ``g`` of every distinct shingle of ``rows`` with ``words``."""
    every = runs(rows, "words", keep)
    return every.select(*keep, F.concat_ws(" ", *[f"g{i}" for i in range(SIZE)]).alias("g")).distinct()


def signatures(items: DataFrame, num: int, den: int) -> DataFrame:
    """``g, item_id, least``: the signature of every item, and how many words a document needs for it."""
    each = hashed(items, ["item_id"]).select("item_id", "g").distinct()
    own = each.groupBy("item_id").agg(F.sort_array(F.collect_list("g")).alias("all"))
    n = F.size("all")
    top = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1).cast("int") - 1
    m = F.least(n, F.floor(top * (den - num) / den).cast("int") + 1)
    least = F.ceil(n * num / den).cast("int")
    return own.select("item_id", least.alias("least"), F.explode(F.slice("all", 1, m)).alias("g"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    num: int = 4,
    den: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared``: the items of which a document holds ``num / den`` of the shingles.

    A shingle is five words between white space, lower-cased; a text of fewer words is one
    shingle, and one without words or a null text has none and holds nothing. Repeated rows
    and texts under one id count as one document each by text, with the largest count per id
    returned; repeated item ids join their shingles. Null ids are kept as an id of their own.
    Other columns are ignored; empty tables give no rows.
    """
    bench = items.select(items[item_col].alias("item_id"), words(items[item_text_col]).alias("words"))
    signs = materialise(signatures(bench, num, den), "signatures")
    text = docs[text_col].cast("string")
    slim = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("th"), words(text).alias("words"))
    hits = hashed(slim, ["doc_id", "th"]).join(signs, "g")
    # n words make n - 4 shingles, or one
    hits = hits.where(F.greatest(F.col("size") - SIZE + 1, F.lit(1)) >= F.col("least"))
    found = materialise(hits.select("doc_id", "th", "item_id").distinct(), "found-items")
    ours = materialise(found.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct(), "found-docs")
    same = slim["doc_id"].eqNullSafe(ours["d"]) & (slim["th"] == ours["t"])
    held = slim.join(ours, same, "left_semi")
    theirs = materialise(spelled(bench, ["item_id"]), "item-shingles")
    counts = theirs.groupBy("item_id").agg(F.count("*").alias("n_item"))
    grams = spelled(held, ["doc_id", "th"]).join(theirs.withColumnRenamed("item_id", "item"), "g")
    shared = grams.groupBy("doc_id", "th", "item").agg(F.count("*").alias("n_shared"))
    # nulls are ids too, so the pairs are compared as such
    pair = (
        shared["doc_id"].eqNullSafe(found["doc_id"])
        & (shared["th"] == found["th"])
        & shared["item"].eqNullSafe(found["item_id"])
    )
    good = shared.join(found, pair, "left_semi")
    good = good.join(counts, good["item"].eqNullSafe(counts["item_id"])).where(F.col("n_shared") * den >= F.col("n_item") * num)
    return good.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """``docs`` less the documents that hold an item; see :func:`contained_items`. All columns stay."""
    leaks = materialise(contained_items(docs, items, id_col=id_col, **more).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["doc_id"]), "left_anti")


def _words_sql(table: str, key: str) -> str:
    ws = "[\\x20\\x09-\\x0D]+"
    split = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{ws}'), lambda x: x <> '')"
    return f"""
    select distinct {key}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g
    from (select {key}, {split} as w from {table})"""


@query(
    "op1_decontamination",
    f"""
    with d as ({_words_sql("documents", "doc_id")}),
    b as ({_words_sql("benchmark", "item_id")}),
    n as (select item_id, count(*) as n_item from b group by item_id)
    select doc_id, item_id, n_item, count(*) as n_shared
    from d join b using (g) join n using (item_id)
    group by doc_id, item_id, n_item having 5 * count(*) >= 4 * n_item
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
