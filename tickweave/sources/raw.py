"""Raw archive files (CSV, gzip CSV) to typed streams, with a per-file report.

Every file is read by its own header: its names are matched to places file by file, so
files of one job may order their columns differently. A damaged file is an error of its
own; none of its rows are stored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave import schemas
from tickweave.functions.quotes import signed_quantity
from tickweave.session import materialise
from tickweave.sources.tables import write_table

FILE = "_file"
BAD = "_bad"
CORRUPT = "_corrupt"

# Column order of trade files without a header, and quote column names.
TRADE_COLUMNS = (
    "agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "transact_time", "is_buyer_maker",
)
QUOTE_NAMES = {
    "best_bid_price": "bid_px", "best_bid_qty": "bid_sz", "best_ask_price": "ask_px", "best_ask_qty": "ask_sz",
}


def _names(line: Column) -> Column:
    """The fields of a header line, lower case and bare."""
    return F.transform(F.split(F.lower(F.translate(line, '"﻿\r', "")), ","), lambda x: F.trim(x))


def _header_lines(lines: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """Every file with its header line, null without one, and its number of lines.

    A least text is grouped by sorting, which no task should do with all of its lines: they
    are counted by file and header first, so that few rows are left.
    """
    is_header = F.forall(F.array(*[F.lit(n) for n in needed]), lambda n: F.array_contains(_names(F.col("value")), n))
    # cheap first test, so that most lines are not split for it
    is_header = F.instr(F.lower("value"), needed[0]).cast("boolean") & is_header
    counted = lines.groupBy(FILE, F.when(is_header, F.col("value")).alias("header")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(FILE).agg(F.min("header").alias("header"), F.sum("n").alias("n"))


def _headers(spark: SparkSession, paths, needed: tuple[str, ...]) -> dict[str | None, list[str]]:
    """The files of every distinct header line, those without one under None. One short row per file reaches the driver."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias(FILE))
    groups: dict[str | None, list[str]] = {}
    for row in _header_lines(lines, needed).collect():
        groups.setdefault(row.header, []).append(unquote(row[FILE]))
    return groups


def _read(spark: SparkSession, paths, needed: tuple[str, ...], wanted: tuple[str, ...], default=None) -> DataFrame:
    """Text columns ``wanted`` of all files, by each file's own header; ``_bad`` marks lines of another width.

    A header is a line that holds all ``needed`` names. Without one, ``default`` gives the
    order of the columns; with neither, all lines of the file are bad. Files with the same
    header are one CSV scan.
    """
    # the path comes as a URI; a plus sign stands for itself there
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    scans = []
    for header, files in _headers(spark, paths, needed).items():
        bare = header.translate(str.maketrans("", "", '"\ufeff\r')) if header is not None else None
        names = [x.strip(" ") for x in bare.lower().split(",")] if bare is not None else list(default or ())
        # without names a line is one field, and bad
        fields = [f"f{i}" for i in range(len(names))] or ["f0"]
        schema = T.StructType([T.StructField(x, T.StringType()) for x in [*fields, CORRUPT]])
        # the width of a line is checked only if all of its fields are read
        reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
        rows = reader.option("quote", "").option("maxCharsPerColumn", -1).csv(files)
        rows = rows.select(*[F.translate(F.col(x), '"\r', "").alias(x) for x in fields], CORRUPT, path.alias(FILE))
        if header is not None:
            place = fields[names.index(needed[0])]
            title = F.lower(F.trim(F.translate(F.col(place), "\ufeff", "")))
            rows = rows.where(~F.coalesce(title == needed[0], F.lit(False)))
        bad = F.col(CORRUPT).isNotNull() if names else F.lit(True)
        cols = [F.when(~bad, F.col(fields[names.index(n)])) if n in names else F.lit(None).cast("string") for n in wanted]
        scans.append(rows.select(*[c.alias(n) for c, n in zip(cols, wanted, strict=True)], bad.alias(BAD), FILE))
    if not scans:
        texts = [T.StructField(n, T.StringType()) for n in wanted]
        return spark.createDataFrame([], T.StructType([*texts, T.StructField(BAD, T.BooleanType()), T.StructField(FILE, T.StringType())]))
    return reduce(DataFrame.unionByName, scans)


def _number(name: str) -> Column:
    """A number, or missing: text and NaN both fail."""
    x = F.trim(F.col(name)).try_cast("double")
    return F.when(~F.isnan(x), x)


def read_quotes(spark: SparkSession, paths) -> DataFrame:
    """Quote files with a header; time is the transaction time, else the event time."""
    times = ("transaction_time", "event_time")
    df = _read(spark, paths, tuple(QUOTE_NAMES), (*QUOTE_NAMES, *times)).withColumnsRenamed(QUOTE_NAMES)
    ts = F.coalesce(*times)
    return df.withColumn("_ts", ts).select(
        _number("_ts").cast("long").alias("ts_ms"), *[_number(c).alias(c) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz")], BAD, FILE
    )


def read_trades(spark: SparkSession, paths) -> DataFrame:
    """Trade files with a header in any order, or without one in the fixed order."""
    wanted = ("price", "quantity", "transact_time", "is_buyer_maker")
    df = _read(spark, paths, wanted, wanted, TRADE_COLUMNS)
    maker = F.trim("is_buyer_maker").try_cast("boolean")
    qty = _number("quantity")
    return df.select(
        _number("transact_time").cast("long").alias("ts_ms"), _number("price").alias("price"), qty.alias("quantity"),
        maker.alias("is_buyer_maker"), signed_quantity(qty, maker).alias("signed_qty"), BAD, FILE,
    )


def read_depth(spark: SparkSession, paths) -> DataFrame:
    """Depth files with a header and a text time stamp, read as UTC."""
    wanted = ("timestamp", "percentage", "depth", "notional")
    df = _read(spark, paths, wanted, wanted)
    ts = F.unix_millis(F.trim("timestamp").try_cast("timestamp"))
    return df.select(ts.alias("ts_ms"), *[_number(c).alias(c) for c in wanted[1:]], BAD, FILE)


@dataclass(frozen=True)
class Stream:
    name: str
    schema: T.StructType
    read: object


STREAMS = {
    "quotes": Stream("quotes", schemas.QUOTES, read_quotes),
    "trades": Stream("trades", schemas.TRADES, read_trades),
    "depth": Stream("depth", schemas.DEPTH, read_depth),
}


def _complete(stream: Stream) -> Column:
    ok = ~F.col(BAD)
    for f in stream.schema.names:
        ok = ok & F.col(f).isNotNull()
    return ok


def parse(spark: SparkSession, stream: str, paths) -> DataFrame:
    """Complete rows of one stream over all paths, as one job. A damaged file stops it; see :func:`readable`."""
    s = STREAMS[stream]
    return s.read(spark, paths).where(_complete(s)).select(*s.schema.names)


def _gzip_error(data: bytes) -> str | None:
    """What is wrong with a gzip file of one or more members, read in pieces."""
    view, at, size = memoryview(data), 0, 1 << 20
    if not data:
        return None
    try:
        while at < len(view):
            unzip = zlib.decompressobj(31)
            while not unzip.eof:
                if at >= len(view):
                    return "file ends inside the compressed data"
                piece = view[at : at + size]
                unzip.decompress(piece)
                at += len(piece)
            at -= len(unzip.unused_data)
    except zlib.error as e:
        return str(e)
    return None


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _place(uri: Column, asked: list[str]) -> Column:
    """A name by which a file's URI and a path that was asked for are equal; schemes count if all paths have one."""
    if all(re.match(_SCHEME, p) for p in asked):
        return F.regexp_replace(uri, f"({_SCHEME})/+", "$1/")
    return F.regexp_replace(F.regexp_replace(uri, f"{_SCHEME}(//[^/]*)?", ""), "^/+", "/")


def readable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, error`` of every path; ``error`` is null for a sound file. Only compressed files are read."""
    asked = spark.createDataFrame([(p, p.rsplit("/", 1)[-1]) for p in paths], "path string, name string")
    packed = [p for p in paths if p.endswith(".gz")]
    if not packed:
        return asked.select("path", F.lit(None).cast("string").alias("error"))

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"file": frame["path"], "error": [_gzip_error(x) for x in frame["content"]]})

    files = spark.read.format("binaryFile").load(packed).select("path", "content")
    seen = files.mapInPandas(check, "file string, error string").where("error is not null")
    return asked.join(seen, _place(F.col("path"), paths) == _place(F.col("file"), paths), "left").select("path", "error")


def _report(paths_errors: list, counts: DataFrame, spark: SparkSession) -> DataFrame:
    asked = spark.createDataFrame([(p, p.rsplit("/", 1)[-1], e) for p, e in paths_errors], "path string, name string, error string")
    paths = [p for p, _ in paths_errors]
    joined = asked.join(counts, _place(F.col("path"), paths) == _place(F.col(FILE), paths), "left")
    status = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("ERR: "), "name", F.lit(": "), "error"))
        .when(F.coalesce("n_kept", F.lit(0)) > 0, "ok")
        .otherwise(F.concat(F.lit("ERR: no usable row in "), F.col("name")))
    )
    return joined.select(
        "path", status.alias("status"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_kept", "n_bad_time", "n_bad_value")]
    )


def _flagged(spark: SparkSession, s: Stream, paths: list[str]) -> tuple[DataFrame | None, list[tuple[str, str | None]]]:
    """All rows of the sound files with ``_ok``, and the error of each path. The paths are an argument, so they are few."""
    checked = [(r.path, r.error) for r in readable(spark, paths).collect()]
    good = [p for p, e in checked if e is None]
    return (s.read(spark, good).withColumn("_ok", _complete(s)) if good else None), checked


def _counts(spark: SparkSession, rows: DataFrame | None) -> DataFrame:
    if rows is None:
        return spark.createDataFrame([], f"{FILE} string, n_rows long, n_kept long, n_bad_time long, n_bad_value long")
    ok = F.col("_ok")
    return rows.groupBy(FILE).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(ok, 1)).alias("n_kept"),
        F.count(F.when(~ok & F.col("ts_ms").isNull(), 1)).alias("n_bad_time"),
        F.count(F.when(~ok & F.col("ts_ms").isNotNull(), 1)).alias("n_bad_value"),
    )


def parse_report(spark: SparkSession, stream: str, paths: list[str]) -> DataFrame:
    """One row per path: rows read, kept and dropped by cause.

    ``ERR:`` marks a damaged file, whose rows don't count, and one without a good row.
    """
    rows, checked = _flagged(spark, STREAMS[stream], paths)
    return _report(checked, _counts(spark, rows), spark)


# symbol, then any folders, then the day in the file name
PATH_PATTERN = r"/([^/]+)/[^/]+/[^/]*?(\d{4}-\d{2}-\d{2})[^/]*$"


def ingest(spark: SparkSession, stream: str, paths: list[str], target: str, pattern: str = PATH_PATTERN) -> DataFrame:
    """Parse all sound files once, store them by symbol and day, and return the per-file report.

    Symbol and day come from the path. Days without a good row, and those of damaged files,
    are left as they were.
    """
    s = STREAMS[stream]
    rows, checked = _flagged(spark, s, paths)
    if rows is not None:
        rows = materialise(
            rows.select(
                *s.schema.names,
                F.regexp_extract(FILE, pattern, 1).alias("symbol"),
                F.regexp_extract(FILE, pattern, 2).try_cast("date").alias("day"),
                FILE,
                "_ok",
            ),
            "parsed",
        )
        kept = rows.where("_ok and symbol <> '' and day is not null")
        write_table(kept.select(*s.schema.names, "symbol", "day"), target)
    return _report(checked, _counts(spark, rows), spark)
