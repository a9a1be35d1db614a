"""Preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import derived
from siftline.operators import impute as imputing
from siftline.operators.labeling import label_distribution as label_rows
from siftline.operators.labeling import with_label
from siftline.operators.split import stratified_folds, stratified_split
from siftline.operators.tables import paired, stacked
from siftline.plans.prepare import Preparation, prepare
from siftline.session import new_path
from siftline.sources.prepared import preparation_summary, read_prepared, write_prepared
from siftline.workload.registry import (
    KEPT,
    LINES,
    ORDER_SPEC,
    ORDERS,
    PREPARED,
    SPLIT,
    lines,
    orders,
    query,
    rounded,
    table,
)

_SCALED = [f"{name}_scaled" for name in KEPT]
_VALUES = ", ".join(f"round({c}, 6) AS {c}" for c in (*KEPT, *_SCALED))
_MEMBERS = ", ".join(f"round({c}, 9) AS {c}" for c in _SCALED)


def labelled_orders(spark, sf_dir):
    return with_label(orders(spark, sf_dir), ORDER_SPEC.category, ORDER_SPEC.label_map)


def prepared_orders(spark, sf_dir, **options):
    return prepare(orders(spark, sf_dir), ORDER_SPEC, **options)


def stored_orders(spark, sf_dir):
    """The prepared table, written once and read back."""
    df, state = prepared_orders(spark, sf_dir)
    path = new_path(spark, "prepared")
    write_prepared(df, path)
    return path, state


@query(
    f"""WITH {ORDERS}, medians AS (SELECT median(price) AS price, median(customer) AS customer FROM raw)
    SELECT o_orderkey, coalesce(raw.price, m.price) AS price, coalesce(raw.customer, m.customer) AS customer
    FROM raw, medians m"""
)
def impute_median(spark, sf_dir):
    df = orders(spark, sf_dir)
    medians = imputing.fit_medians(df, ["price", "customer"])
    return imputing.impute(df, medians).select("o_orderkey", "price", "customer")


@query(
    f"""WITH {SPLIT}, m AS (SELECT median(price) AS price, median(customer) AS customer, median(priority) AS priority
      FROM members WHERE split = 'train')
    SELECT 'price' AS feature, price AS median FROM m UNION ALL SELECT 'customer', customer FROM m
    UNION ALL SELECT 'priority', priority FROM m"""
)
def train_only_medians(spark, sf_dir):
    _, state = prepared_orders(spark, sf_dir, fit_on="train")
    return state.parameters(spark).select("feature", "median")


@query(
    f"""WITH {PREPARED}
    SELECT split, count(*) AS rows, {", ".join(f"round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}" for c in _SCALED)}
    FROM prepared GROUP BY split"""
)
def scaled_ranges(spark, sf_dir):
    df, _ = prepared_orders(spark, sf_dir)
    limits = [f(c).alias(f"{n}_{c}") for c in _SCALED for n, f in (("min", F.min), ("max", F.max))]
    found = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *limits)
    return rounded(found, *[c for c in found.columns if c.startswith(("min_", "max_"))])


@query(f"WITH {PREPARED} SELECT o_orderkey, label, split, {_MEMBERS} FROM prepared")
def scale_minmax(spark, sf_dir):
    df, _ = prepared_orders(spark, sf_dir)
    return rounded(df.select("o_orderkey", "label", "split", *_SCALED), *_SCALED, digits=9)


_STANDARD = ", ".join(f"round(({c} - {c}_mean) / {c}_std, 6) AS {c}_scaled" for c in KEPT)


@query(f"WITH {PREPARED} SELECT o_orderkey, {_STANDARD} FROM filled, scales")
def scale_standard(spark, sf_dir):
    df, _ = prepared_orders(spark, sf_dir, method="standard")
    return rounded(df.select("o_orderkey", *_SCALED), *_SCALED)


@query(
    f"""WITH {LINES}, s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lines)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.0::DOUBLE AS constant_scaled,
      round((l_quantity - lo) / (hi - lo), 9) AS l_quantity_scaled FROM lines, s"""
)
def scale_constant_column(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("constant", F.lit(5.0))
    names = ["l_quantity", "constant"]
    scaled = imputing.scale(df, imputing.fit_scales(df, names))
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(scaled.select(*keep, "l_quantity_scaled", "constant_scaled"), "l_quantity_scaled", digits=9)


@query(f"WITH {PREPARED} SELECT o_orderkey, {', '.join(f'round({c}, 4) AS {c}' for c in KEPT)} FROM prepared")
def inverse_scale(spark, sf_dir):
    df, state = prepared_orders(spark, sf_dir)
    back = imputing.unscale(df.select("o_orderkey", *_SCALED), state.scales)
    return rounded(back.select("o_orderkey", *KEPT), *KEPT, digits=4)


@query(f"WITH {SPLIT} SELECT split, label, count(*) AS rows FROM members GROUP BY split, label")
def stratified_split_counts(spark, sf_dir):
    df = stratified_split(labelled_orders(spark, sf_dir), "label", ["o_orderkey"])
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {SPLIT} SELECT o_orderkey, label, split FROM members")
def stratified_split_members(spark, sf_dir):
    df = stratified_split(labelled_orders(spark, sf_dir), "label", ["o_orderkey"])
    return df.select("o_orderkey", "label", "split")


# Five columns identify a line. Each part of a hashed key has its length before it.
_FOLD_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_day"]
_KEY_TEXT = " || ':' || ".join(f"length({c}::VARCHAR) || ':' || {c}::VARCHAR" for c in _FOLD_KEY)


def _folds_sql(order):
    """Folds of lines in an order: classes one behind the other are dealt in turn, each fold a run of its class."""
    return f"""WITH {LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
        {order}) AS place
        FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS ship_day FROM lines)),
    c AS (SELECT label, count(*) AS rows FROM lines GROUP BY label),
    w AS (SELECT label, coalesce(sum(rows) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS start, rows FROM c),
    f AS (SELECT label, fold, (SELECT count(*) FROM range(5) r(x) WHERE x = fold) * (
        floor((start + rows - 1 - fold) / 5.0) - floor((start - 1 - fold) / 5.0)) AS size FROM w, range(5) t(fold)),
    e AS (SELECT label, fold, sum(size) OVER (PARTITION BY label ORDER BY fold) AS stop, size FROM f)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ship_day, k.label, e.fold::INT AS fold
    FROM k JOIN e ON k.label = e.label AND k.place <= e.stop AND k.place > e.stop - e.size"""


@query(_folds_sql(f"md5('7:' || {_KEY_TEXT})"))
def fold_assignment(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("ship_day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    df = with_label(df, "l_returnflag", {"N": 0, "A": 1, "R": 1})
    return stratified_folds(df, "label", _FOLD_KEY, 5, seed=7).select(*_FOLD_KEY, "label", "fold")


@query(_folds_sql(", ".join(_FOLD_KEY)))
def fold_assignment_in_order(spark, sf_dir):
    """Unshuffled folds: consecutive lines of each class, in the order of their key."""
    df = table(spark, sf_dir, "lineitem").withColumn("ship_day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    df = with_label(df, "l_returnflag", {"N": 0, "A": 1, "R": 1})
    return stratified_folds(df, "label", _FOLD_KEY, 5, shuffle=False).select(*_FOLD_KEY, "label", "fold")


_LINE_DERIVED = derived.DerivedFeatures(
    ratios={"price_per_quantity": ("l_extendedprice", "l_quantity"), "tax_per_discount": ("l_tax", "l_discount")},
    products={"discounted": ("l_extendedprice", "l_discount"), "taxed": ("l_extendedprice", "l_tax")},
    logs=("l_extendedprice", "l_quantity", "not_there"),
    squares=("l_quantity", "l_tax"),
)
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE_KEY_SQL = ", ".join(_LINE_KEY)


def _derived_lines(spark, sf_dir, names):
    df = derived.with_derived(table(spark, sf_dir, "lineitem"), _LINE_DERIVED).select(*_LINE_KEY, *names)
    return rounded(df, *names, digits=9)


@query(
    f"""SELECT {_LINE_KEY_SQL}, round(l_extendedprice / (l_quantity + 1), 9) AS price_per_quantity,
      round(l_tax / (l_discount + 1), 9) AS tax_per_discount FROM lineitem"""
)
def ratio_features(spark, sf_dir):
    return _derived_lines(spark, sf_dir, ["price_per_quantity", "tax_per_discount"])


@query(
    f"""SELECT {_LINE_KEY_SQL}, round(l_extendedprice * l_discount, 9) AS discounted,
      round(l_extendedprice * l_tax, 9) AS taxed FROM lineitem"""
)
def product_features(spark, sf_dir):
    return _derived_lines(spark, sf_dir, ["discounted", "taxed"])


@query(
    f"""SELECT {_LINE_KEY_SQL}, round(ln(1 + l_extendedprice), 9) AS l_extendedprice_log,
      round(ln(1 + l_quantity), 9) AS l_quantity_log FROM lineitem"""
)
def log_features(spark, sf_dir):
    return _derived_lines(spark, sf_dir, ["l_extendedprice_log", "l_quantity_log"])


@query("SELECT event_id, round(ln(1 + value), 6) AS value_log FROM events")
def log_of_skewed(spark, sf_dir):
    df = derived.with_derived(table(spark, sf_dir, "events"), derived.DerivedFeatures(logs=("value",)))
    return rounded(df.select("event_id", "value_log"), "value_log")


@query(
    f"""SELECT {_LINE_KEY_SQL}, l_quantity * l_quantity AS l_quantity_squared,
      round(l_tax * l_tax, 9) AS l_tax_squared FROM lineitem"""
)
def square_features(spark, sf_dir):
    return _derived_lines(spark, sf_dir, ["l_quantity_squared", "l_tax_squared"])


@query(
    f"""WITH {PREPARED}
    SELECT o_orderkey, round(price_scaled / (customer_scaled + 1), 6) AS ratio,
      round(price_scaled * priority_scaled, 6) AS product, round(ln(1 + price_scaled), 6) AS price_scaled_log,
      round(price_scaled * price_scaled, 6) AS price_scaled_squared FROM prepared"""
)
def derived_from_scaled(spark, sf_dir):
    df, _ = prepared_orders(spark, sf_dir)
    wanted = derived.DerivedFeatures(
        ratios={"ratio": ("price_scaled", "customer_scaled")},
        products={"product": ("price_scaled", "priority_scaled")},
        logs=("price_scaled",),
        squares=("price_scaled",),
    )
    names = wanted.names(df.columns)
    return rounded(derived.with_derived(df, wanted).select("o_orderkey", *names), *names)


@query(f"WITH {PREPARED} SELECT o_orderkey, label, split, {_VALUES} FROM prepared")
def prepared_table(spark, sf_dir):
    df, _ = prepared_orders(spark, sf_dir)
    return rounded(df, *KEPT, *_SCALED)


@query(
    f"""WITH {PREPARED}
    SELECT split, 3 AS n_features, 'price, customer, priority' AS features, count(*) AS rows,
      round(avg(label) * 100, 6) AS positive_percent FROM prepared GROUP BY split"""
)
def prepared_summary(spark, sf_dir):
    path, state = stored_orders(spark, sf_dir)
    return rounded(preparation_summary(read_prepared(spark, path), state.features), "positive_percent")


@query(f"WITH {PREPARED} SELECT o_orderkey, label, {_VALUES} FROM prepared WHERE split = 'train'")
def load_train_split(spark, sf_dir):
    path, _ = stored_orders(spark, sf_dir)
    return rounded(read_prepared(spark, path, ["train"]).drop("split"), *KEPT, *_SCALED)


@query(f"WITH {PREPARED} SELECT o_orderkey, label, {_VALUES} FROM prepared WHERE split = 'test'")
def demonstration_set(spark, sf_dir):
    path, _ = stored_orders(spark, sf_dir)
    return rounded(read_prepared(spark, path, ["test"]).drop("split"), *KEPT, *_SCALED)


@query(f"WITH {SPLIT} SELECT o_orderkey, label, split FROM members WHERE split IN ('train', 'val')")
def train_val_union(spark, sf_dir):
    path, _ = stored_orders(spark, sf_dir)
    train, val = read_prepared(spark, path, ["train"]), read_prepared(spark, path, ["val"])
    return stacked(train, val).select("o_orderkey", "label", "split")


@query(
    f"""WITH {SPLIT}
    SELECT split, count(*) AS rows, count_if(label = 1) AS positives, count_if(label = 0) AS negatives,
      round(count_if(label = 1) * 100.0 / count(*), 6) AS positive_percent FROM members GROUP BY split"""
)
def label_distribution_by_split(spark, sf_dir):
    df = stratified_split(labelled_orders(spark, sf_dir), "label", ["o_orderkey"])
    return rounded(label_rows(df, "label", ["split"]), "positive_percent")


@query(
    f"""WITH {PREPARED} """
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS feature, round(d.{c}, 6) AS median, round({c}_min, 6) AS min,
        round({c}_max, 6) AS max, round({c}_mean, 6) AS mean, round({c}_std, 6) AS std_pop FROM scales, medians d"""
        for i, c in enumerate(KEPT)
    )
)
def fitted_parameters(spark, sf_dir):
    _, state = prepared_orders(spark, sf_dir)
    path = new_path(spark, "parameters")
    state.save(spark, path)
    loaded = Preparation.load(spark, path)
    return rounded(loaded.parameters(spark), "median", "min", "max", "mean", "std_pop")


@query(
    """SELECT l.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
)
def features_with_labels(spark, sf_dir):
    features = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return paired(features, labels, ["doc_id"])


@query(
    f"""WITH {SPLIT}, m AS (SELECT median(price) AS v FROM raw)
    SELECT o_orderkey, round(coalesce(price, v) - v, 6) AS centred_price FROM raw, m"""
)
def attach_parameters(spark, sf_dir):
    df = orders(spark, sf_dir)
    median = imputing.fit_medians(df, ["price"])
    centred = imputing.impute(df, median).withColumn("centred_price", F.col("price") - F.lit(median["price"]))
    return rounded(centred.select("o_orderkey", "centred_price"), "centred_price")
