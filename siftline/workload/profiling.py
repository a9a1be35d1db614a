"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import labels
from siftline.functions.display import KOI_DISPLAY, percent, with_unit
from siftline.operators import correlation, labeling, profile
from siftline.operators.histogram import histogram, histogram_by_class
from siftline.operators.impute import fit_medians, impute
from siftline.operators.tables import available, first_rows, numeric_columns, row_at
from siftline.spec import KOI
from siftline.workload.registry import (
    LINE_FEATURES,
    LINE_GAP_FEATURES,
    LINE_MAP,
    LINES,
    ORDER_SPEC,
    ORDERS,
    lines,
    orders,
    query,
    rounded,
    table,
)


def labelled_lines(spark, sf_dir):
    return labeling.with_label(lines(spark, sf_dir), "l_returnflag", LINE_MAP)


def per_feature(names, expression):
    return " UNION ALL ".join(expression.format(c=name) for name in names)


@query("SELECT count(*) AS rows, 6 AS columns FROM orders")
def table_shape(spark, sf_dir):
    return profile.shape(table(spark, sf_dir, "orders"))


@query(
    f"""WITH {ORDERS}
    SELECT count(*) AS rows, count_if(label = 1) AS positives, count_if(label = 0) AS negatives,
      round(count_if(label = 1) * 100.0 / count(*), 6) AS positive_percent FROM raw WHERE label IS NOT NULL"""
)
def label_distribution(spark, sf_dir):
    labelled = labeling.with_label(orders(spark, sf_dir), ORDER_SPEC.category, ORDER_SPEC.label_map)
    return rounded(labeling.label_distribution(labelled, "label"), "positive_percent")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS label FROM orders")
def mapped_label(spark, sf_dir):
    label = labels.mapped_label("o_orderstatus", {"F": 0, "O": 1})
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


@query("SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def unmapped_values(spark, sf_dir):
    return labeling.unmapped_values(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": 0, "O": 1})


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS label
    FROM orders WHERE o_orderstatus IN ('F', 'O')"""
)
def mapped_rows_only(spark, sf_dir):
    kept = labeling.with_label(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": 0, "O": 1})
    return kept.select("o_orderkey", "label")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 AND o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END
      AS is_open FROM orders"""
)
def membership_flags(spark, sf_dir):
    gaps = table(spark, sf_dir, "orders").withColumn(
        "status", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus"))
    )
    return gaps.select("o_orderkey", labels.membership_flag("status", ["O", "P"]).alias("is_open"))


@query(
    """WITH g AS (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS status FROM orders)
    SELECT status, count(*) AS rows, round(count(*) * 100.0 / (SELECT count(*) FROM g), 6) AS percent
    FROM g WHERE status IS NOT NULL GROUP BY status"""
)
def category_counts(spark, sf_dir):
    gaps = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("status")
    )
    return rounded(labeling.category_counts(gaps, "status"), "percent")


@query(
    f"""WITH {LINES}
    SELECT round(count_if(label = 0) / count_if(label = 1)::DOUBLE, 9) AS class_ratio FROM lines"""
)
def class_ratio(spark, sf_dir):
    df = labelled_lines(spark, sf_dir).agg(labeling.class_ratio("label").alias("class_ratio"))
    return rounded(df, "class_ratio", digits=9)


@query(
    f"""WITH {LINES}, ratio AS (SELECT count_if(label = 0) / count_if(label = 1)::DOUBLE AS r FROM lines)
    SELECT label, round(CASE WHEN label = 1 THEN r ELSE 1 END, 9) AS class_weight, count(*) AS rows
    FROM lines, ratio GROUP BY ALL"""
)
def class_weight_column(spark, sf_dir):
    weighted = labeling.with_class_weight(labelled_lines(spark, sf_dir), "label")
    df = weighted.groupBy("label", "class_weight").agg(F.count(F.lit(1)).alias("rows"))
    return rounded(df, "class_weight", digits=9)


DESCRIBE = """SELECT '{c}' AS feature, count({c}) AS rows, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lines"""


DESCRIBE_EXACTLY = """SELECT '{c}' AS feature, count({c}) AS rows, avg({c}) AS mean, stddev_samp({c}) AS std,
  min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75,
  max({c}) AS max FROM lines"""


@query(f"WITH {LINES} {per_feature(LINE_GAP_FEATURES, DESCRIBE)}")
def describe_features(spark, sf_dir):
    df = profile.describe(lines(spark, sf_dir), LINE_GAP_FEATURES)
    return rounded(df, "mean", "std", "min", "p25", "p50", "p75", "max")


@query(
    """SELECT 'value' AS feature, count(value) AS rows, round(avg(value), 6) AS mean,
      round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25,
      round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max
    FROM events"""
)
def describe_skewed(spark, sf_dir):
    df = profile.describe(table(spark, sf_dir, "events"), ["value"])
    return rounded(df, "mean", "std", "p25", "p50", "p75")


_MISSING = """SELECT '{c}' AS feature, count_if({c} IS NULL) AS missing,
  round(count_if({c} IS NULL) * 100.0 / count(*), 6) AS percent FROM lines"""


@query(f"WITH {LINES} SELECT * FROM ({per_feature(LINE_GAP_FEATURES, _MISSING)}) WHERE missing > 0")
def missing_by_column(spark, sf_dir):
    return rounded(profile.missing_by_column(lines(spark, sf_dir).select(*LINE_GAP_FEATURES)), "percent")


_MISSING_CELLS = " + ".join(f"count_if({c} IS NULL)" for c in LINE_GAP_FEATURES)


@query(
    f"""WITH {LINES}
    SELECT 2::BIGINT AS columns_with_missing, ({_MISSING_CELLS})::BIGINT AS missing_cells,
      round(({_MISSING_CELLS}) * 100.0 / (count(*) * {len(LINE_GAP_FEATURES)}), 6) AS missing_percent FROM lines"""
)
def missing_totals(spark, sf_dir):
    return rounded(profile.missing_totals(lines(spark, sf_dir).select(*LINE_GAP_FEATURES)), "missing_percent")


@query(
    f"""WITH {LINES}
    SELECT 0::BIGINT AS columns_with_missing, 0::BIGINT AS missing_cells, 0.0::DOUBLE AS missing_percent FROM lines
    LIMIT 1"""
)
def missing_totals_after_imputing(spark, sf_dir):
    df = lines(spark, sf_dir).select(*LINE_GAP_FEATURES)
    return profile.missing_totals(impute(df, fit_medians(df, LINE_GAP_FEATURES)))


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity_gaps, l_extendedprice, l_tax FROM lines")
def drop_sparse_features(spark, sf_dir):
    df = lines(spark, sf_dir)
    wanted = available(df, [*LINE_GAP_FEATURES, "not_there"])
    kept = profile.dense_features(df, wanted)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *kept)


@query(
    """SELECT event_id, user_id, value FROM events"""
)
def numeric_column_selection(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(*numeric_columns(events))


@query(
    f"""WITH {LINES} {per_feature(LINE_FEATURES, "SELECT label, '{c}' AS feature, round(avg({c}), 6) AS mean, "
    "round(median({c}), 6) AS median FROM lines GROUP BY label")}"""
)
def mean_median_by_class(spark, sf_dir):
    df = profile.class_comparison(labelled_lines(spark, sf_dir), LINE_FEATURES, "label")
    return rounded(df, "mean", "median")


@query(
    f"""WITH {LINES} SELECT label, avg(quantity_gaps) AS mean_quantity, count(quantity_gaps) AS rows
    FROM lines WHERE label = 1 AND quantity_gaps IS NOT NULL GROUP BY label"""
)
def class_filter(spark, sf_dir):
    df = labelled_lines(spark, sf_dir).dropna(subset=["quantity_gaps"]).where(F.col("label") == 1)
    return df.groupBy("label").agg(F.avg("quantity_gaps").alias("mean_quantity"), F.count("quantity_gaps").alias("rows"))


_CORRELATED = (*LINE_GAP_FEATURES, "constant")


@query(
    f"""WITH {LINES} {per_feature(LINE_GAP_FEATURES, "SELECT '{c}' AS feature, "
    "round(corr({c}, label), 6) AS r FROM lines")}
    UNION ALL SELECT 'constant', NULL UNION ALL SELECT 'label', 1.0"""
)
def correlation_with_target(spark, sf_dir):
    df = labelled_lines(spark, sf_dir).withColumn("constant", F.lit(5.0))
    return rounded(correlation.correlation_with_target(df, [*_CORRELATED, "label"], "label"), "r")


def matrix_sql(names=LINE_GAP_FEATURES, constants=()):
    cells = []
    for x in names:
        for y in names:
            r = "1.0" if x == y else f"round(corr({x}, {y}), 6)"
            r = "NULL" if {x, y} & {*constants} else r
            cells.append(f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, {r} AS r FROM lines")
    return " UNION ".join(cells)


@query(f"WITH {LINES} {matrix_sql()}")
def correlation_matrix(spark, sf_dir):
    return rounded(correlation.correlation_matrix(lines(spark, sf_dir), LINE_GAP_FEATURES), "r")


def histogram_sql(names, bins, by_class):
    parts = []
    for c in names:
        for label in (0, 1) if by_class else (None,):
            condition = f"{c} IS NOT NULL" + (f" AND label = {label}" if by_class else "")
            shown = f"{label} AS label, " if by_class else ""
            density = ", round(coalesce(rows, 0) / (total * ((hi - lo) / {0})), 9) AS density".format(bins) if by_class else ""
            parts.append(
                f"""SELECT {shown}'{c}' AS feature, b.bin::INT AS bin,
                  round(b.bin * ((hi - lo) / {bins}) + lo, 6) AS bin_low,
                  round(CASE WHEN b.bin = {bins - 1} THEN hi ELSE (b.bin + 1) * ((hi - lo) / {bins}) + lo END, 6) AS bin_high,
                  coalesce(rows, 0) AS rows {density}
                FROM (SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS total FROM lines WHERE {condition}) m
                CROSS JOIN range({bins}) b(bin)
                LEFT JOIN (
                  SELECT CASE WHEN {c} < guess * ((hi - lo) / {bins}) + lo THEN guess - 1
                    WHEN {c} >= (guess + 1) * ((hi - lo) / {bins}) + lo AND guess < {bins - 1} THEN guess + 1
                    ELSE guess END AS bin, count(*) AS rows
                  FROM (SELECT {c}, lo, hi, least(floor(({c} - lo) / (hi - lo) * {bins}), {bins - 1}) AS guess
                    FROM lines, (SELECT min({c}) AS lo, max({c}) AS hi FROM lines WHERE {condition}) n
                    WHERE {condition}) g GROUP BY 1) h ON h.bin = b.bin"""
            )
    return " UNION ALL ".join(parts)


@query(f"WITH {LINES} {histogram_sql(LINE_GAP_FEATURES, 50, False)}")
def histogram_50(spark, sf_dir):
    return rounded(histogram(lines(spark, sf_dir), LINE_GAP_FEATURES, 50), "bin_low", "bin_high")


@query(f"WITH {LINES} {histogram_sql(('l_extendedprice', 'quantity_gaps'), 30, True)}")
def histogram_by_class_30(spark, sf_dir):
    df = histogram_by_class(labelled_lines(spark, sf_dir), ("l_extendedprice", "quantity_gaps"), "label", 30)
    return rounded(rounded(df, "bin_low", "bin_high"), "density", digits=9)


@query(
    f"""WITH {LINES}
    SELECT round(least(min(l_quantity), min(l_discount), min(l_tax)), 6) AS low,
      round(greatest(max(l_quantity), max(l_discount), max(l_tax)), 6) AS high FROM lines"""
)
def global_value_range(spark, sf_dir):
    return rounded(profile.value_range(lines(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"]), "low", "high")


@query(
    f"""WITH {LINES}
    SELECT count(*) AS rows, count_if(label = 1) AS positives, count_if(label = 0) AS negatives,
      round(count_if(label = 1) * 100.0 / count(*), 6) AS positive_percent, 5 AS columns,
      round(count_if(label = 0) / count_if(label = 1)::DOUBLE, 6) AS class_ratio,
      2::BIGINT AS columns_with_missing, ({_MISSING_CELLS})::BIGINT AS missing_cells,
      round(({_MISSING_CELLS}) * 100.0 / (count(*) * 5), 6) AS missing_percent FROM lines"""
)
def profile_report(spark, sf_dir):
    df = profile.profile_report(labelled_lines(spark, sf_dir).select(*LINE_GAP_FEATURES, "label"), "label")
    return rounded(df, "positive_percent", "class_ratio", "missing_percent")


_RANGES = {"l_quantity": (2.0, 49.0), "l_extendedprice": (1000.0, 100000.0), "l_discount": (0.0, 0.09)}


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count_if({c} < {lo}::DOUBLE OR {c} > {hi}::DOUBLE) AS violations FROM lineitem"
        for c, (lo, hi) in _RANGES.items()
    )
)
def range_violations(spark, sf_dir):
    return profile.range_violations(table(spark, sf_dir, "lineitem"), _RANGES)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',',
      CASE WHEN l_quantity < 2 OR l_quantity > 49 THEN 'l_quantity' END,
      CASE WHEN l_extendedprice < 1000 OR l_extendedprice > 100000 THEN 'l_extendedprice' END,
      CASE WHEN l_discount < 0 OR l_discount > 0.09::DOUBLE THEN 'l_discount' END) AS violations FROM lineitem"""
)
def range_violation_names(spark, sf_dir):
    named = profile.with_range_violations(table(spark, sf_dir, "lineitem"), _RANGES)
    return named.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(",", "violations").alias("violations")
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def row_preview(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 5)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def single_row(spark, sf_dir):
    return row_at(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 42)


_WIDE = {
    **{name: name for name in (*LINE_GAP_FEATURES, "l_quantity", "l_discount")},
    "price_gaps": "CASE WHEN l_partkey % 3 <> 0 THEN l_extendedprice END",
    "tax_gaps": "CASE WHEN l_suppkey % 2 = 0 THEN l_tax END",
    "part": "l_partkey::DOUBLE",
    "supplier": "l_suppkey::DOUBLE",
    "line": "l_linenumber::DOUBLE",
    "constant": "CASE WHEN l_partkey % 5 <> 0 THEN 7.25::DOUBLE END",
}
_WIDE_SQL = ", ".join(f"{value} AS {name}" for name, value in _WIDE.items())


@query(
    f"""WITH {LINES}, wide AS (SELECT {_WIDE_SQL} FROM lines)
    {matrix_sql(tuple(_WIDE), ("constant",)).replace("FROM lines", "FROM wide")}"""
)
def correlation_matrix_wide(spark, sf_dir):
    """Twelve columns, some of them with gaps, one constant where it isn't missing."""
    spellings = {name: value.replace("::DOUBLE", "") for name, value in _WIDE.items()}
    columns = [F.expr(value).cast("double").alias(name) for name, value in spellings.items()]
    wide = lines(spark, sf_dir).select(*columns)
    return rounded(correlation.correlation_matrix(wide, list(_WIDE)), "r")


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, count_if(l_extendedprice * {k + 1} / 100 < {low}
          OR l_extendedprice * {k + 1} / 100 > {high}) AS violations FROM lineitem"""
        for k, (name, (low, high, _)) in enumerate(KOI.ranges.items())
    )
)
def range_violations_of_preset(spark, sf_dir):
    """The preset's ranges as they are, with their default values."""
    df = table(spark, sf_dir, "lineitem")
    values = {name: F.col("l_extendedprice") * (k + 1) / 100 for k, name in enumerate(KOI.ranges)}
    return profile.range_violations(df.withColumns(values), KOI.ranges)


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp"}


@query(
    "SELECT column_name, CASE column_type "
    + " ".join(f"WHEN '{theirs}' THEN '{ours}'" for theirs, ours in _KINDS.items())
    + " END AS column_type FROM (DESCRIBE SELECT * FROM lineitem)"
)
def column_types(spark, sf_dir):
    kinds = [(name, kind.removesuffix("_ntz")) for name, kind in profile.column_types(table(spark, sf_dir, "lineitem"))]
    return spark.createDataFrame(kinds, "column_name string, column_type string")


def _even_text(value, decimals):
    """Text of a multiple of 1/8 with ties to the even digit."""
    return f"printf('%.{decimals}f', round_even(({value})::DECIMAL(20, 3), {decimals})::DOUBLE)"


@query(
    f"""WITH e AS (SELECT event_id, floor(value * 8) / 8 AS v, floor(value) * 25 / 8 AS p FROM events)
    SELECT event_id, {_even_text('v', 1)} || ' ppm' AS with_unit, {_even_text('v', 0)} || ' K' AS whole,
      {_even_text('p', 2)} || '%' AS percent_text FROM e"""
)
def display_formats(spark, sf_dir):
    """Eighths, of which many are ties at one place or another: ties go to the even digit."""
    decimals, unit = KOI_DISPLAY["koi_teq"]
    eighths = F.floor(F.col("value") * 8).cast("double") / 8
    return table(spark, sf_dir, "events").select(
        "event_id",
        with_unit(eighths, 1, "ppm").alias("with_unit"),
        with_unit(eighths, decimals, unit).alias("whole"),
        percent(F.floor("value") / 32).alias("percent_text"),
    )
