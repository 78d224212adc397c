"""CSV folders whose files differ in header and encoding."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.functions.parsing import pick_column
from emberday.operators.hourly import hourly_observations
from emberday.session import written

FALLBACK_ENCODING = "cp949"
_CHUNK_BYTES = 1 << 20
# Column names the header audit looks for: fixed values.
AUDIT_ALIASES: dict[str, tuple[str, ...]] = {
    "stn_col": ("STN", "stn", "stnid", "지점", "지점번호"),
    "lat_col": ("LAT", "lat", "위도"),
    "lon_col": ("LON", "lon", "경도"),
    "tmx_col": ("TM_X", "tm_x", "X", "x"),
    "tmy_col": ("TM_Y", "tm_y", "Y", "y"),
}


def _header(path: str) -> bytes:
    """The header record of a file: its first bytes up to the first line break outside quotes."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    found, at = b"", 0
    with system.open_input_stream(inner) as stream:
        while chunk := stream.read(_CHUNK_BYTES):
            found += chunk
            while (end := found.find(b"\n", at)) >= 0:
                if found.count(b'"', 0, end) % 2 == 0:
                    return found[:end].rstrip(b"\r")
                at = end + 1
    return found.rstrip(b"\r")


def header_names(header: str) -> list[str]:
    """Column names of a header record, quotes removed."""
    return next(csv.reader(io.StringIO(header)), [])


def _peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(raw=[_header(path) for path in batch["path"]])


def _odd_quotes(line: Column) -> Column:
    """1 where a line of any encoding holds an odd number of quotes; bytes are counted, not characters."""
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2


def file_headers(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, length, header, encoding, spans_lines) per file, found by the executors.

    Files are inspected line by line in Spark's own splits, so many tasks share a large file:
    it is UTF-8 if all its lines are, and a record spans lines where one holds an odd number
    of quotes. Only the header record is read by itself.
    """
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length")
    )
    headed = listing.mapInPandas(_peek, "path string, length long, raw binary")
    lines = spark.read.option("pathGlobFilter", pattern).text(folder)
    # the text source hands on the bytes of a line as they are
    looks = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(_odd_quotes(F.col("value")) == 1).alias("odd")
    )
    same = F.regexp_replace("path", "^file:/+", "file:/") == F.regexp_replace("file", "^file:/+", "file:/")
    utf8 = F.coalesce("utf8", F.lit(True))
    named = headed.join(looks, same, "left").select(
        "path", "length", "raw", F.when(utf8, "UTF-8").otherwise(FALLBACK_ENCODING).alias("encoding"),
        F.coalesce("odd", F.lit(False)).alias("spans_lines"),
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            header = [
                bytes(raw).decode("utf-8-sig" if encoding == "UTF-8" else encoding, "replace")
                for raw, encoding in zip(batch["raw"], batch["encoding"])
            ]
            yield batch.assign(header=header)[["path", "length", "header", "encoding", "spans_lines"]]

    return named.mapInPandas(decode, "path string, length long, header string, encoding string, spans_lines boolean")


def csv_groups(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[DataFrame]:
    """One frame of text columns per distinct header, encoding and record form, with ``__source_file``.

    The driver handles one short row per file, as Spark's own file listing does, and loops
    over the groups, not the files; every group is one scan.
    """
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for f in file_headers(spark, folder, pattern).toLocalIterator():
        groups.setdefault((f.header, f.encoding, f.spans_lines), []).append(f.path)
    if not groups:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    if any(encoding == FALLBACK_ENCODING for _, encoding, _ in groups):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return [_read_group(spark, sorted(paths), *form) for form, paths in sorted(groups.items())]


def read_csv_folder(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All files as text columns, united by name; columns a file lacks become null."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), csv_groups(spark, folder, pattern)
    )


def read_hourly_folder(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Typed hourly rows of all files; names are resolved per header, before the union.

    So files that call the same column differently all contribute their rows.
    """
    return reduce(
        DataFrame.unionByName,
        [hourly_observations(group) for group in csv_groups(spark, folder, pattern)],
    )


def _read_group(
    spark: SparkSession, paths: Sequence[str], header: str, encoding: str, spans_lines: bool
) -> DataFrame:
    """Columns are read by position and named from the header; of equal names the last one stays."""
    names = header_names(header)
    schema = ", ".join(f"`_{k}` string" for k in range(len(names)))
    if spans_lines:
        parsed = F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE"})
        frame = joined_records(spark, paths, encoding).select(parsed.alias("r"), "file").select("r.*", "file")
    else:
        frame = (
            spark.read.schema(schema).option("header", True).option("encoding", encoding).option("escape", '"')
            .csv(list(paths)).select("*", F.col("_metadata.file_name").alias("file"))
        )
    last = {name.strip().lower(): k for k, name in enumerate(names)}
    kept = [F.col(f"_{k}").alias(names[k]) for k in sorted(last.values()) if names[k].strip()]
    return frame.select(*kept, F.col("file").alias("__source_file"))


def joined_records(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """``(file, record)`` of files with quoted line breaks, headers left out, in Spark's own splits.

    A line that begins outside quotes begins a record. Whether a split begins inside quotes
    follows from the quotes of the splits of its file before it: their counts are summed, a
    row for each split. Most records are one line; only lines of longer ones are exchanged.
    """
    raw = F.col("value")
    text = raw if encoding == "UTF-8" else F.decode(raw.cast("binary"), encoding)
    lines = spark.read.text(list(paths)).select(
        text.alias("value"), _odd_quotes(raw).alias("odd"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"),
    )
    # places are numbered once: a later job must meet the same ones
    lines = written(lines, "csv-lines")
    of_file = W.partitionBy("path").orderBy("split")
    earlier = of_file.rowsBetween(W.unboundedPreceding, -1)
    splits = lines.groupBy("path", "split").agg(F.sum("odd").alias("quotes"))
    opens = splits.select("path", "split", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).alias("open"))
    before = W.partitionBy("path", "split").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("odd").over(before), F.lit(0)) + F.col("open")) % 2
    stated = lines.join(opens, ["path", "split"]).withColumn("inside", inside)
    first = F.min_by("place", F.struct("split", "place"))
    heads = lines.groupBy("path").agg(first.alias("head"))
    alone = (F.col("inside") == 0) & (F.col("odd") == 0)
    whole = (
        stated.where(alone).join(heads, "path").where((F.col("place") != F.col("head")) & (F.trim("value") != ""))
        .select("file", F.col("value").alias("record"))
    )
    # lines of longer records, in order: one that begins outside quotes begins the next record
    parts = stated.where(~alone)
    starts = (F.col("inside") == 0).cast("long")
    so_far = W.partitionBy("path", "split").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = parts.groupBy("path", "split").agg(F.sum(starts).alias("n"))
    ahead = counts.select("path", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    numbered = parts.withColumn("nth", F.sum(starts).over(so_far)).join(ahead, ["path", "split"])
    long = (
        numbered.groupBy("path", "file", (F.col("ahead") + F.col("nth")).alias("k"))
        .agg(F.array_sort(F.collect_list(F.struct("split", "place", "value"))).alias("lines"))
        .join(heads, "path").where(F.col("lines")[0]["place"] != F.col("head"))
        .select("file", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"))
    )
    return whole.unionByName(long)


def header_audit(
    spark: SparkSession, folder: str, aliases: Mapping[str, Sequence[str]] = AUDIT_ALIASES
) -> DataFrame:
    """One row per file: which of its columns matches each alias list."""
    names = list(aliases)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                [pick_column(header_names(header), aliases[n]) for n in names]
                for header in batch["header"]
            ]
            hits = pd.DataFrame(found, columns=names, index=batch.index, dtype=object)
            yield pd.concat([batch[["path", "encoding"]], hits], axis=1)

    schema = "path string, encoding string, " + ", ".join(f"{n} string" for n in names)
    matched = file_headers(spark, folder).mapInPandas(match, schema)
    return matched.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "encoding", *names
    )
