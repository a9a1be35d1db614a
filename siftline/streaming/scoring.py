"""Apply a fitted transformation to files as they arrive."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siftline.plans.scoring import Scorer
from siftline.sources.csv import DIALECT, header_groups, normalise_missing, read_csv

#: Column of a line that has more cells than its header.
_LINE = "_refused_line"


def arriving_files(
    spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", pattern: str | None = None
) -> DataFrame:
    """A stream of the rows of new files. A schema is required, as for any file stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        # A file whose header names other columns, or in another order, is an error.
        reader = reader.options(header=True, comment="#", enforceSchema=False, **DIALECT)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def run_available(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, fmt: str = "parquet"
) -> StreamingQuery:
    """Process what is there, then stop; a later run goes on after the last processed file."""
    query = (
        transform(stream)
        .writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return query


def run_continuously(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    every: str = "1 minute",
    fmt: str = "parquet",
) -> StreamingQuery:
    return (
        transform(stream)
        .writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(processingTime=every)
        .start(out)
    )


@dataclass(frozen=True)
class Inbox:
    """Where the batches of arriving CSV files go: a folder for each kind of result, one below it for each batch."""

    out: str

    def scored(self, spark: SparkSession) -> DataFrame:
        """All scored rows, with the columns of their files."""
        return spark.read.parquet(f"{self.out}/scored")

    def refused_files(self, spark: SparkSession) -> DataFrame:
        """``(file, reason)`` of files that lack a feature or have no header."""
        return spark.read.parquet(f"{self.out}/refused_files")

    def refused_rows(self, spark: SparkSession) -> DataFrame:
        """``(line)``: whole lines with more cells than their header."""
        return spark.read.parquet(f"{self.out}/refused_rows")

    def totals(self, spark: SparkSession) -> DataFrame:
        """Rows, positives and refused rows and files over all batches so far."""
        parts = spark.read.parquet(f"{self.out}/totals")
        names = ("rows", "positives", "refused_rows", "refused_files")
        return parts.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names))


def score_arriving_csv(
    spark: SparkSession,
    folder: str,
    scorer: Scorer,
    out: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    trailing_comments: bool = False,
) -> Inbox:
    """Score the CSV files that have arrived since the last run; what can't be scored is reported, not lost.

    The stream is one of files, so that files may differ in the order of their columns and in columns that
    the scorer doesn't need. A file without one of the features, or without a header, is refused as a whole;
    a line with more cells than its header by itself. A batch has at most ``files_per_batch`` files, whose
    names the driver holds. It writes its results over those of an earlier attempt at the same batch, so rows
    appear once however often a run fails, and a run after the last file adds nothing.
    """
    inbox = Inbox(out)
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path")  # the content isn't read here
    )
    query = (
        files.writeStream.foreachBatch(lambda batch, number: _score_batch(batch, number, scorer, inbox, trailing_comments))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return inbox


def _one_slash(file: str) -> str:
    """A path with one slash behind its scheme, however it was written."""
    return re.sub(r"^(\w+):/+", r"\1:/", file)


def _score_batch(batch: DataFrame, number: int, scorer: Scorer, inbox: Inbox, trailing_comments: bool) -> None:
    spark, features = batch.sparkSession, scorer.preparation.features
    files = sorted(r.path for r in batch.select("path").collect())
    if not files:
        return
    groups = header_groups(spark, files, trailing_comments)
    refused, good = [], []
    for names, own in groups.items():
        lacking = [name for name in features if name not in names]
        if lacking:
            refused += [(file, "Missing columns: " + ", ".join(lacking)) for file in own]
        else:
            good += own
    known = {_one_slash(file) for own in groups.values() for file in own}
    refused += [(file, "no header") for file in files if _one_slash(file) not in known]

    def write(rows: DataFrame, kind: str) -> DataFrame:
        path = f"{inbox.out}/{kind}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    counts = {"rows": 0, "positives": 0, "refused_rows": 0}
    if good:
        types = {name: "double" for name in features}
        rows = read_csv(spark, good, types, trailing_comments, corrupt=_LINE)
        whole = rows.where(F.col(_LINE).isNull()).drop(_LINE)
        scored = write(scorer.transform(normalise_missing(whole, features)), "scored")
        lines = write(rows.where(F.col(_LINE).isNotNull()).select(F.col(_LINE).alias("line")), "refused_rows")
        found = scored.agg(F.count("*").alias("rows"), F.coalesce(F.sum("prediction"), F.lit(0)).alias("positives")).first()
        counts = {**found.asDict(), "refused_rows": lines.count()}
    write(spark.createDataFrame(refused, "file string, reason string"), "refused_files")
    totals = [(counts["rows"], int(counts["positives"]), counts["refused_rows"], len(refused))]
    write(spark.createDataFrame(totals, "rows bigint, positives bigint, refused_rows bigint, refused_files bigint"), "totals")
