"""Flow files: reading, checking, retrying."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwatch import config
from rillwatch.schema import FLOW
from rillwatch.session import cut_lineage

FLOW_FILES = "flows_*.csv"


def _keeping_corrupt(reader, schema: T.StructType, corrupt: str | None):
    if corrupt is None:
        return reader.schema(schema)
    kept = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    return reader.schema(kept).option("columnNameOfCorruptRecord", corrupt)


def _one_slash(path: str) -> Column:
    """Paths of listings and of rows differ in the slashes after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def dead_letters(rows: DataFrame, corrupt: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and the lines that did not, as they are in the file; the latter are kept before they are used."""
    lines = cut_lineage(rows.filter(F.col(corrupt).isNotNull()))
    # a field that nobody asks for is not parsed, and then a bad one passes: this condition, always true, asks for all
    asked = F.concat_ws("", *[F.col(c).cast("string") for c in rows.columns if c != corrupt]) != "\0"
    return rows.filter(F.col(corrupt).isNull() & asked).drop(corrupt), lines.select(F.col(corrupt).alias("line"))


def read_flow_files(spark: SparkSession, path: str, schema: T.StructType = FLOW, settle_seconds: int = 0,
                    pattern: str | None = FLOW_FILES, corrupt: str | None = None) -> DataFrame:
    """All flow files below ``path``; files touched within ``settle_seconds`` are left for the next run.

    With ``corrupt`` a column of that name holds the whole line of a row that does not parse, see ``dead_letters``.
    """
    reader = _keeping_corrupt(spark.read, schema, corrupt).option("header", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if settle_seconds:
        until = dt.datetime.now(dt.timezone.utc) - dt.timedelta(seconds=settle_seconds)
        reader = reader.option("modifiedBefore", until.strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    return reader.csv(path)


def stream_flow_files(spark: SparkSession, path: str, schema: T.StructType = FLOW, clean: str = "off",
                      archive: str | None = None, files_per_batch: int = 1000, pattern: str | None = FLOW_FILES,
                      corrupt: str | None = None) -> DataFrame:
    """New flow files as a stream. The stream checkpoint remembers processed files; ``clean="delete"`` removes
    them afterwards (``"archive"`` moves them). Files must appear complete, by a move into ``path``."""
    reader = (_keeping_corrupt(spark.readStream, schema, corrupt).option("header", True).option("maxFilesPerTrigger", files_per_batch)
              .option("cleanSource", clean))
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    return reader.csv(path)


def check_files(spark: SparkSession, path: str, required: list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """One row per file: data rows, missing columns, and whether it can be loaded.

    A file needs a header with every required column and at least one data row. Files are read as text in
    parallel; those without a single byte, which no scan reaches, come from the listing the scan is planned with.
    """
    required = config.REQUIRED_FLOW_COLUMNS if required is None else required
    reader = spark.read.format("text")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    scan = reader.load(path)
    lines = scan.select(_one_slash("_metadata.file_path").alias("file"), F.col("value"), at.alias("at"))
    seen = lines.filter(F.length(F.trim("value")) > 0).groupBy("file").agg(
        F.min_by("value", "at").alias("header"), (F.count(F.lit(1)) - 1).alias("data_rows"))
    listed = spark.createDataFrame([(f,) for f in scan.inputFiles()], "file string").select(_one_slash("file").alias("file"))
    seen = listed.join(seen, "file", "left").fillna("", ["header"]).fillna(0, ["data_rows"])
    header = F.transform(F.split("header", ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    out = seen.withColumn("missing", F.array_except(F.array(*map(F.lit, required)), header))
    return out.withColumn("valid", (F.size("missing") == 0) & (F.col("data_rows") > 0)).drop("header")


def read_csv_by_encoding(spark: SparkSession, path: str, schema: T.StructType, fallback: str = "ISO-8859-1") -> DataFrame:
    """CSV files in mixed encodings: a file whose every line is valid UTF-8 is read as such, others as ``fallback``.

    A line that does not parse is kept whole in ``corrupt_record``. The check reads whole files, in parallel, not a
    prefix, and its verdicts are joined with the rows by file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    verdict = lines.groupBy("file").agg(F.every("ok").alias("_utf8"))
    both = [
        _keeping_corrupt(spark.read, schema, "corrupt_record").option("header", True).option("encoding", encoding).csv(path)
        .withColumn("file", F.col("_metadata.file_path")).join(verdict.filter(F.col("_utf8") == wanted), "file").drop("file", "_utf8")
        for encoding, wanted in (("UTF-8", True), (fallback, False))
    ]
    return both[0].unionByName(both[1])


def read_many(spark: SparkSession, paths: list[str] | str, fmt: str = "parquet") -> DataFrame:
    """Several Parquet or CSV data sets as one table; Parquet columns are merged by name."""
    reader = spark.read.option("mergeSchema", True) if fmt == "parquet" else spark.read.option("header", True)
    return reader.format(fmt).load(paths)


def retry_state(tries: DataFrame, max_retries: int = 3) -> DataFrame:
    """Failed attempts per file since its last success (``file, us, ok``), and whether to give the file up."""
    last = tries.groupBy("file").agg(F.max(F.when(F.col("ok"), F.col("us"))).alias("_last"))
    since = tries.join(last, "file").withColumn("_late", ~F.col("ok") & (F.col("us") >= F.coalesce("_last", F.lit(-(1 << 62)))))
    return since.groupBy("file").agg(F.count(F.when(F.col("_late"), 1)).alias("attempts")).withColumn(
        "dead", F.col("attempts") >= max_retries)
