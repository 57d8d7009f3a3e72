"""Normalisation statistics, their bundle, and the manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave import schemas
from tickweave.functions.quotes import finite_or_zero, is_invalid, zscore
from tickweave.operators.splits import walk_forward_folds
from tickweave.session import materialise

EPS = 1e-8  # fixed value: below this a deviation counts as constant
CLIP = 10.0  # default symmetric clip


def norm_stats(train: DataFrame, features, by=("symbol",), nan_policy: str = "neutral") -> DataFrame:
    """Long table ``(by, feature, mean, std, n)`` from one mergeable aggregation.

    ``neutral`` gives mean 0 and deviation 1 to a feature with any missing or
    non-finite train value; ``skip`` leaves such values out.
    """
    if nan_policy not in ("neutral", "skip"):
        raise ValueError(f"unknown nan_policy {nan_policy!r}")
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        x = F.when(~is_invalid(F.col(f)), F.col(f).cast("double"))
        aggs += [F.avg(x).alias(f"m_{f}"), F.stddev_pop(x).alias(f"s_{f}"), F.count(x).alias(f"c_{f}")]
    wide = train.groupBy(*by).agg(*aggs)

    def entry(f: str) -> Column:
        ok = (F.col(f"c_{f}") == F.col("n")) if nan_policy == "neutral" else (F.col(f"c_{f}") > 0)
        return F.struct(
            F.lit(f).alias("feature"),
            F.when(ok, F.col(f"m_{f}")).otherwise(0.0).alias("mean"),
            F.when(ok & (F.col(f"s_{f}") >= EPS), F.col(f"s_{f}")).otherwise(1.0).alias("std"),
        )

    long = wide.select(*by, "n", F.explode(F.array(*[entry(f) for f in features])).alias("e"))
    return long.select(*by, "e.feature", "e.mean", "e.std", "n")


def day_moments(df: DataFrame, features, by=("symbol",), day: str = "day") -> DataFrame:
    """Partial moments to be stored: ``(by, day, feature, n, c, mean, m2)``, one row per key, day and feature.

    ``n`` counts rows, ``c`` those with a finite value, ``m2`` is the sum of squared deviations
    of the latter from their mean. A batch adds rows of its own; :func:`merge_moments` joins any
    number of them, so nothing is read again when days or batches are added.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        x = F.when(~is_invalid(F.col(f)), F.col(f).cast("double"))
        aggs += [F.count(x).alias(f"c_{f}"), F.avg(x).alias(f"m_{f}"), F.var_pop(x).alias(f"v_{f}")]

    def entry(f: str) -> Column:
        c = F.col(f"c_{f}")
        filled = [F.coalesce(F.col(x), F.lit(0.0)) for x in (f"m_{f}", f"v_{f}")]
        return F.struct(F.lit(f).alias("feature"), c.alias("c"), filled[0].alias("mean"), (filled[1] * c).alias("m2"))

    wide = df.groupBy(*by, day).agg(*aggs)
    long = wide.select(*by, day, "n", F.explode(F.array(*[entry(f) for f in features])).alias("e"))
    return long.select(*by, day, "e.feature", "n", "e.c", "e.mean", "e.m2")


def merge_moments(parts: DataFrame, by=("symbol",), day: str = "day") -> DataFrame:
    """``(by, feature, n, c, mean, m2)`` of all rows behind ``parts``, merged one after the other.

    The list of a group is as long as it has days and batches. Merging moves the mean by the
    weighted difference, so large values with a small spread lose nothing, unlike sums of squares.
    """
    part = F.struct(F.col(day), "n", "c", "mean", "m2")

    def join(a: Column, b: Column) -> Column:
        c = a["c"] + b["c"]
        step, share = b["mean"] - a["mean"], F.coalesce(F.try_divide(b["c"], c), F.lit(0.0))
        return F.struct(
            (a["n"] + b["n"]).alias("n"), c.alias("c"), (a["mean"] + step * share).alias("mean"),
            (a["m2"] + b["m2"] + step * step * a["c"] * share).alias("m2"),
        )

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    lists = parts.groupBy(*by, "feature").agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    return lists.select(*by, "feature", F.aggregate("_parts", none, join).alias("e")).select(*by, "feature", "e.*")


def moments_stats(merged: DataFrame, by=("symbol",), nan_policy: str = "neutral") -> DataFrame:
    """The table of :func:`norm_stats` from merged moments."""
    if nan_policy not in ("neutral", "skip"):
        raise ValueError(f"unknown nan_policy {nan_policy!r}")
    ok = (F.col("c") == F.col("n")) if nan_policy == "neutral" else (F.col("c") > 0)
    std = F.sqrt(F.try_divide("m2", "c"))
    return merged.select(
        *by, "feature", F.when(ok, F.col("mean")).otherwise(0.0).alias("mean"),
        F.when(ok & (std >= EPS), std).otherwise(1.0).alias("std"), "n",
    )


def fold_stats(parts: DataFrame, folds, by=("symbol",), day: str = "day", nan_policy: str = "neutral") -> DataFrame:
    """Train statistics of every fold, with ``fold``, from stored partial moments.

    What is repeated per fold are the days' moments, never the rows behind them.
    """
    train = walk_forward_folds(parts, folds, day).where("split = 'train'")
    keys = ["fold", *by]
    return moments_stats(merge_moments(train, keys, day), keys, nan_policy)


def sanitised(stats: DataFrame) -> DataFrame:
    """Loaded statistics made safe: non-finite mean 0, non-finite or tiny deviation 1."""
    bad_std = is_invalid(F.col("std")) | (F.col("std") < EPS)
    return stats.withColumns(
        {"mean": finite_or_zero(F.col("mean")), "std": F.when(bad_std, 1.0).otherwise(F.col("std"))}
    )


def stats_wide(stats: DataFrame, features, by=("symbol",)) -> DataFrame:
    """One row per key with ``mean_<f>`` and ``std_<f>``."""
    aggs = []
    for f in features:
        hit = F.col("feature") == f
        aggs += [F.max(F.when(hit, F.col("mean"))).alias(f"mean_{f}"), F.max(F.when(hit, F.col("std"))).alias(f"std_{f}")]
    return stats.groupBy(*by).agg(*aggs)


def require_known(df: DataFrame, known: DataFrame, keys, label: str) -> None:
    """Raise if a key of ``df`` is absent from ``known``; reads at most five keys."""
    gone = df.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti").limit(5).collect()
    if gone:
        raise schemas.ContractError(f"{label}: no entry for {[tuple(r) for r in gone]}")


def apply_stats(df: DataFrame, stats: DataFrame, features, clip: float = CLIP, by=("symbol",), check: bool = True) -> DataFrame:
    """Z-score and clip every feature; the statistics are written once and joined by real size."""
    wide = materialise(stats_wide(stats, features, by), "stats")
    if check:
        require_known(df, wide, by, "normalisation statistics")
    joined = df.join(wide, list(by))
    cols = {f: zscore(F.col(f), F.col(f"mean_{f}"), F.col(f"std_{f}"), clip) for f in features}
    return joined.withColumns(cols).select(*df.columns)


def normalised_features(df: DataFrame, features, split="split", clip: float = CLIP, by=("symbol",), dtype="float") -> DataFrame:
    """Train-only statistics, non-finite inputs set to zero, then z-score of all rows."""
    stats = norm_stats(df.where(F.col(split) == "train"), features, by)
    clean = df.withColumns({f: finite_or_zero(F.col(f)) for f in features})
    out = apply_stats(clean, stats, features, clip, by)
    return out.withColumns({f: F.col(f).cast(dtype) for f in features})


def symbol_records(stats: DataFrame, features, clip: float, by: str = "symbol") -> DataFrame:
    """One record per symbol with ordered arrays and the feature contract."""
    place = {f: i for i, f in enumerate(features)}
    pairs = F.create_map(*[x for f, i in place.items() for x in (F.lit(f), F.lit(i))])
    # the group is one symbol's feature list, bounded by the contract
    rows = stats.groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct(pairs[F.col("feature")].alias("i"), "mean", "std"))).alias("e"), F.max("n").alias("n")
    )
    return rows.select(
        F.col(by).alias("symbol"),
        F.lit(schemas.FEATURE_VERSION).alias("feature_version"),
        F.lit(schemas.contract_checksum(names=features)).alias("feature_spec_checksum"),
        F.lit(float(clip)).alias("clip"),
        F.col("e.mean").alias("mean"),
        F.col("e.std").alias("std"),
        F.col("n").alias("n_train_rows"),
    )


def check_records(records: DataFrame, width: int, checksum: str, clip: float | None = None) -> float:
    """Agreement on version, checksum, width and clip; returns the common clip."""
    row = records.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set("feature_version").alias("versions"),
        F.collect_set("feature_spec_checksum").alias("sums"),
        F.min(F.least(F.size("mean"), F.size("std"))).alias("lo"),
        F.max(F.greatest(F.size("mean"), F.size("std"))).alias("hi"),
        F.min("clip").alias("clip_lo"),
        F.max("clip").alias("clip_hi"),
    ).first()
    if not row.n:
        raise schemas.ContractError("bundle: no symbols")
    if row.versions != [schemas.FEATURE_VERSION]:
        raise schemas.ContractError(f"bundle: versions {row.versions}")
    if row.sums != [checksum]:
        raise schemas.ContractError(f"bundle: checksums {row.sums}")
    if (row.lo, row.hi) != (width, width):
        raise schemas.ContractError(f"bundle: widths {row.lo}..{row.hi}, expected {width}")
    if clip is None and row.clip_lo != row.clip_hi:
        raise schemas.ContractError("bundle: clips differ; pass clip")
    return float(row.clip_lo if clip is None else clip)


def bundle(parts: list[DataFrame], features, clip: float | None = None) -> DataFrame:
    """One record per symbol under a common head, after the agreement checks; ``by_symbol`` holds its statistics."""
    records = materialise(reduce(lambda a, b: a.unionByName(b), parts), "records")
    checksum = schemas.contract_checksum(names=features)
    agreed = check_records(records, len(features), checksum, clip)
    return records.select(
        F.lit(schemas.FEATURE_VERSION).alias("feature_version"),
        F.lit(checksum).alias("feature_spec_checksum"),
        F.lit(agreed).alias("clip"),
        F.create_map("symbol", F.struct("mean", "std", "n_train_rows")).alias("by_symbol"),
    )


def unbundle(b: DataFrame, features) -> DataFrame:
    """Back to the long table of ``norm_stats``."""
    rows = b.select(F.explode("by_symbol").alias("symbol", "s"))
    zipped = rows.select("symbol", "s.n_train_rows", F.posexplode(F.arrays_zip("s.mean", "s.std")).alias("i", "e"))
    names = F.array(*[F.lit(f) for f in features])
    return zipped.select(
        "symbol", F.element_at(names, F.col("i") + 1).alias("feature"), F.col("e.mean").alias("mean"), F.col("e.std").alias("std"),
        F.col("n_train_rows").alias("n"),
    )


def fingerprint(df: DataFrame, cols, keys=(), kind: str = "xxhash64", name: str = "fingerprint") -> DataFrame:
    """Order-free content fingerprint: a sum of row hashes, so it merges in any order."""
    if kind == "xxhash64":
        h = F.xxhash64(*cols).cast("decimal(38,0)")
    else:
        text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias(name))


def manifest(df: DataFrame, ratio: float, fingerprint_cols, keys=("symbol",), clip: float = CLIP, ts="ts_ms") -> DataFrame:
    """One record per symbol: rows and range of both splits, contract and train fingerprint."""
    def part(s, agg):
        return agg(F.when(F.col("split") == s, F.col(ts)))

    train = F.col("split") == "train"
    h = F.when(train, F.xxhash64(*fingerprint_cols)).cast("decimal(38,0)")
    rows = df.groupBy(*keys).agg(
        F.count(F.when(train, 1)).alias("train_rows"),
        F.count(F.when(~train, 1)).alias("eval_rows"),
        part("train", F.min).alias("train_start_ms"),
        part("train", F.max).alias("train_end_ms"),
        part("eval", F.min).alias("eval_start_ms"),
        part("eval", F.max).alias("eval_end_ms"),
        F.sum(h).cast("string").alias("train_fingerprint"),
    )
    return rows.select(
        *keys,
        F.lit(schemas.FEATURE_VERSION).alias("feature_version"),
        F.lit(schemas.contract_checksum()).alias("feature_spec_checksum"),
        *[c for c in rows.columns if c not in keys],
        F.lit(float(ratio)).alias("split_ratio"),
        F.lit(float(clip)).alias("norm_clip"),
    )
