"""Registration of queries and the table views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.tables import paired
from siftline.session import stored
from siftline.spec import TableSpec

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register under the function's name. Without SQL only the rows are checked."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounded because the order of float additions is not fixed."""
    return df.withColumns({name: F.round(F.col(name).cast("double"), digits) for name in names})


def big(column: Column) -> Column:
    return column.cast("bigint")


# lineitem: label from the return flag, gaps by line number, a score with ties.
LINE_MAP = {"N": 0, "A": 1, "R": 1}
LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_GAP_FEATURES = ("quantity_gaps", "l_extendedprice", "discount_sparse", "l_tax")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "score": F.floor(F.col("l_extendedprice") / 105.0).cast("double") / 1000.0,
            "quantity_gaps": F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")),
            "discount_sparse": F.when(F.col("l_linenumber") <= 2, F.col("l_discount")),
        }
    )


LINES = """
lines AS (
  SELECT *,
    CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 1 END AS label,
    floor(l_extendedprice / 105e0) / 1000e0 AS score,
    CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END AS quantity_gaps,
    CASE WHEN l_linenumber <= 2 THEN l_discount END AS discount_sparse,
    CASE WHEN floor(l_extendedprice / 105e0) / 1000e0 >= 0.5 THEN 1 ELSE 0 END AS prediction
  FROM lineitem)
"""

# orders: label from the status, unique key, features with gaps; one of them is mostly missing.
ORDER_SPEC = TableSpec(
    key=("o_orderkey",),
    features=("price", "customer", "priority", "sparse"),
    category="o_orderstatus",
    label_map={"F": 0, "O": 1, "P": 1},
    positive_text="Open",
    negative_text="Finished",
)
KEPT = ("price", "customer", "priority")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("double")).alias("customer"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        F.when(F.col("o_orderkey") % 5 < 2, F.col("o_totalprice")).alias("sparse"),
    )


ORDERS = """
raw AS (
  SELECT o_orderkey, o_orderstatus,
    CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 1 END AS label,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS customer,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
    CASE WHEN o_orderkey % 5 < 2 THEN o_totalprice END AS sparse
  FROM orders)
"""

# documents with quality labels, as SQL; the key of a hash is the id alone.
TEXT_LABELS = """
raw AS (
  SELECT d.doc_id, l.quality AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id
  WHERE l.quality IN (0, 1))
"""


def split_sql(raw: str, key: str) -> str:
    """Exact stratified split: quotas by largest remainder, members by hash order of the key."""
    return (
        raw
        + f""",
classes AS (SELECT label, count(*) AS rows, sum(count(*)) OVER () AS total FROM raw GROUP BY label),
rest1 AS (SELECT *, total - CAST(ceil(0.2::DOUBLE * total) AS BIGINT) AS rest FROM classes),
rest2 AS (SELECT *, rows * rest / total::DOUBLE AS share FROM rest1),
rest3 AS (SELECT *, floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, label)
            <= rest - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS rest_rows FROM rest2),
train1 AS (SELECT *, rest - CAST(ceil(0.125::DOUBLE * rest) AS BIGINT) AS train FROM rest3),
train2 AS (SELECT *, rest_rows * train / rest::DOUBLE AS train_share FROM train1),
train3 AS (SELECT *, floor(train_share)
            + CASE WHEN row_number() OVER (ORDER BY train_share - floor(train_share) DESC, label)
              <= train - sum(floor(train_share)) OVER () THEN 1 ELSE 0 END AS train_rows FROM train2),
ranked AS (SELECT raw.*, row_number() OVER (PARTITION BY raw.label ORDER BY md5('42:' || {key})) AS place,
             c.rows - c.rest_rows AS test_stop, c.rows - c.train_rows AS val_stop
           FROM raw JOIN train3 c ON c.label = raw.label),
members AS (SELECT *, CASE WHEN place <= test_stop THEN 'test'
                           WHEN place <= val_stop THEN 'val' ELSE 'train' END AS split FROM ranked)
"""
    )


SPLIT = split_sql(ORDERS, "o_orderkey")
TEXT_SPLIT = split_sql(TEXT_LABELS, "doc_id")

# The prepared table: medians over all rows, scales over the training rows.
PREPARED = (
    SPLIT
    + """,
medians AS (SELECT median(price) AS price, median(customer) AS customer, median(priority) AS priority FROM raw),
filled AS (SELECT m.o_orderkey, m.label, m.split, coalesce(m.price, d.price) AS price,
             coalesce(m.customer, d.customer) AS customer, coalesce(m.priority, d.priority) AS priority
           FROM members m, medians d),
scales AS (SELECT min(price) AS price_min, max(price) AS price_max, min(customer) AS customer_min,
             max(customer) AS customer_max, min(priority) AS priority_min, max(priority) AS priority_max,
             avg(price) AS price_mean, stddev_pop(price) AS price_std,
             avg(customer) AS customer_mean, stddev_pop(customer) AS customer_std,
             avg(priority) AS priority_mean, stddev_pop(priority) AS priority_std
           FROM filled WHERE split = 'train'),
prepared AS (SELECT f.*, (price - price_min) / (price_max - price_min) AS price_scaled,
               (customer - customer_min) / (customer_max - customer_min) AS customer_scaled,
               (priority - priority_min) / (priority_max - priority_min) AS priority_scaled
             FROM filled f, scales)
"""
)

# documents with quality labels: features counted over the whole texts.
TEXT_SPEC = TableSpec(
    key=("doc_id",),
    features=("n_chars", "n_words", "digit_share", "upper_share", "n_lines", "word_length"),
    category="quality",
    label_map={"0": 0, "1": 1},
    positive_text="Good",
    negative_text="Poor",
)


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every document, stored, so that the texts are read once however often they are used."""
    chars = F.greatest(F.length("text"), F.lit(1)).cast("double")
    words = F.size(F.split(F.trim("text"), r"\s+")).cast("double")
    features = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.alias("n_words"),
        (F.regexp_count("text", F.lit("[0-9]")) / chars).alias("digit_share"),
        (F.regexp_count("text", F.lit("[A-Z]")) / chars).alias("upper_share"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("double").alias("n_lines"),
        (chars / words).alias("word_length"),
    )
    return stored(features, "text-features")


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the labelled documents, which is what a fit and its metrics are about."""
    return stored(paired(text_features(spark, sf_dir), text_labels(spark, sf_dir), ["doc_id"]), "texts")
