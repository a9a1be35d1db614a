"""File and stream jobs: CSV in and out, batch scoring, arriving files, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions.derived import DerivedFeatures
from siftline.operators import evaluate
from siftline.operators.labeling import with_label
from siftline.plans import ensemble, importance, reports, training
from siftline.plans.engineer import engineer
from siftline.plans.scoring import Scorer
from siftline.session import new_path
from siftline.sources.csv import read_csv, read_features_csv, write_csv
from siftline.sources.prepared import preparation_summary, read_summary, write_summary
from siftline.streaming.scoring import arriving_files, run_available, score_arriving_csv
from siftline.workload.evaluation import scored_lines
from siftline.workload.models import SMALL_BOOSTING, SPLITS, order_tables, text_tables
from siftline.workload.preparation import prepared_orders
from siftline.workload.profiling import DESCRIBE_EXACTLY, histogram_sql, matrix_sql, per_feature
from siftline.workload.registry import (
    KEPT,
    LINE_MAP,
    LINES,
    ORACLES,
    ORDER_SPEC,
    PREPARED,
    SPLIT,
    TEXT_SPLIT,
    lines,
    orders,
    query,
    rounded,
    table,
)


_EVENTS = """SELECT event_id, CASE WHEN event_id % 10 <> 9 THEN value END AS value, event_type FROM events"""


@query(_EVENTS)
def csv_with_comment_lines(spark, sf_dir):
    return _csv_events(spark, sf_dir, False)


@query(_EVENTS)
def csv_with_trailing_comments(spark, sf_dir):
    return _csv_events(spark, sf_dir, True)


def _csv_events(spark, sf_dir, trailing):
    """Events as CSV with a comment line before every event; no value where the id ends in 9."""
    path = new_path(spark, "events-csv")
    value = F.when(F.col("event_id") % 10 != 9, F.col("value").cast("string")).otherwise("")
    text = F.concat_ws(",", F.col("event_id").cast("string"), value, F.col("event_type"))
    if trailing:
        text = F.concat(text, F.when(F.col("event_id") % 2 == 0, F.lit(" # even")).otherwise(F.lit("")))
    text = F.concat(F.lit("# user "), F.col("user_id").cast("string"), F.lit("\n"), text)
    # The first row of a partition starts its file: it also carries the header.
    header = F.lit("# exported events\nevent_id,value,event_type\n")
    starts = F.monotonically_increasing_id() % F.lit(2**33) == 0
    table(spark, sf_dir, "events").select(
        F.when(starts, F.concat(header, text)).otherwise(text).alias("value")
    ).write.text(path)
    types = {"event_id": "bigint", "value": "double"}
    return read_csv(spark, path, types, trailing_comments=trailing)


def _written_lines(spark, df, line, header):
    """Lines as CSV files, the first one of each file with the header before it."""
    path = new_path(spark, "lines-csv")
    starts = F.monotonically_increasing_id() % F.lit(2**33) == 0
    df.select(F.when(starts, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value")).write.text(path)
    return path


@query("SELECT event_id, event_type || ' # no comment' AS event_type FROM events")
def csv_quoted_comment_sign(spark, sf_dir):
    """A # in quotes is text; the header and every line end in a comment."""
    id_text = F.col("event_id").cast("string")
    line = F.concat(id_text, F.lit(',"'), F.col("event_type"), F.lit(' # no comment" # a "comment"'))
    path = _written_lines(spark, table(spark, sf_dir, "events"), line, "event_id,event_type # the header")
    return read_csv(spark, path, {"event_id": "bigint"}, trailing_comments=True)


@query(
    """SELECT event_id, event_type, CASE WHEN event_id % 10 <> 1 THEN user_id END AS user_id,
      CASE WHEN event_id % 10 = 0 THEN event_id || ',' || event_type || ',' || user_id || ',' END AS whole_line
    FROM events"""
)
def csv_ragged_rows_reported(spark, sf_dir):
    """A missing cell is NULL; a line with one too many, an empty one, is kept whole beside its cells."""
    cells = F.concat_ws(",", F.col("event_id").cast("string"), "event_type")
    user, last = F.concat(F.lit(","), F.col("user_id").cast("string")), F.col("event_id") % 10
    line = F.concat(cells, F.when(last == 1, "").when(last == 0, F.concat(user, F.lit(","))).otherwise(user))
    path = _written_lines(spark, table(spark, sf_dir, "events"), line, "event_id,event_type,user_id")
    return read_csv(spark, path, {"event_id": "bigint", "user_id": "bigint"}, corrupt="whole_line")


@query("SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN user_id END AS user_id FROM events")
def csv_files_of_different_column_order(spark, sf_dir):
    """Columns go by name, file by file; one kind of file lacks a column."""
    events, path = table(spark, sf_dir, "events"), new_path(spark, "events-csv")
    for part, names in enumerate((["event_id", "event_type", "user_id"], ["event_type", "event_id"])):
        some = events.where(F.col("event_id") % 2 == part).select(*names)
        some.write.mode("append").csv(path, header=True)
    types = {"event_id": "bigint", "user_id": "bigint"}
    return read_csv(spark, path, types).select("event_id", "event_type", "user_id")


def order_scorer(spark, sf_dir):
    tables = order_tables(spark, sf_dir)
    with tables.kept() as (train, _):
        model = training.fit(training.boosted_trees({**SMALL_BOOSTING, "n_estimators": 4}), train).model
    return Scorer.of(tables.state, model, ORDER_SPEC.positive_text, ORDER_SPEC.negative_text)


def _valid(scored, *more):
    """What is certain about scored rows: every key once, a probability, the label and the text that follow."""
    p, one = F.col("probability"), F.col("prediction") == 1
    return scored.select(
        "o_orderkey",
        p.between(0, 1).alias("probability_valid"),
        F.when(p == 0.5, True).otherwise(one == (p > 0.5)).alias("prediction_valid"),
        (F.col("prediction_text") == F.when(one, "Open").otherwise("Finished")).alias("text_valid"),
        *more,
    )


_VALID = """SELECT o_orderkey, true AS probability_valid, true AS prediction_valid, true AS text_valid"""


@query(f"{_VALID}, true AS confidence_valid FROM orders")
def batch_score(spark, sf_dir):
    scored = order_scorer(spark, sf_dir).transform(orders(spark, sf_dir))
    larger = F.greatest(F.col("probability"), 1 - F.col("probability"))
    return _valid(scored, (F.abs(F.col("confidence") - larger) < 1e-9).alias("confidence_valid"))


@query(
    f"""WITH {PREPARED} SELECT r.o_orderkey, r.price, r.customer, r.priority, true AS probability_valid,
    true AS confidence_valid, true AS text_valid FROM raw r"""
)
def csv_upload_scored(spark, sf_dir):
    """A CSV file goes in, a scored CSV file comes out with the uploaded columns unchanged."""
    scorer = order_scorer(spark, sf_dir)
    uploaded = write_csv(orders(spark, sf_dir), new_path(spark, "upload"), "orders")
    result, _ = scorer.score_csv(spark, uploaded, new_path(spark, "scored"))
    p, text = F.col("probability"), F.col("prediction_text")
    return result.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        *KEPT,
        p.between(0, 1).alias("probability_valid"),
        (F.abs(F.col("confidence") - F.greatest(p, 1 - p)) < 1e-9).alias("confidence_valid"),
        (text == F.when(F.col("prediction") == 1, "Open").otherwise("Finished")).alias("text_valid"),
    )


@query(
    f"""WITH {PREPARED} SELECT round(price, 6) AS price, round(customer, 6) AS customer, round(priority, 6) AS priority,
      true AS score_is_the_row_of_medians FROM medians"""
)
def typical_record_score(spark, sf_dir):
    """One record, made of the medians of the table, scored on its own and as a row without any value."""
    scorer = order_scorer(spark, sf_dir)
    alone = scorer.score_record(spark, scorer.preparation.medians)
    empty = scorer.score_record(spark, {}).first()["probability"]
    same = (F.abs(F.col("probability") - F.lit(empty)) < 1e-12).alias("score_is_the_row_of_medians")
    return rounded(alone.select(*KEPT, same), *KEPT)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def csv_export(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = write_csv(df, new_path(spark, "export"), "orders")
    return read_csv(spark, path, {"o_orderkey": "bigint", "o_totalprice": "double"})


@query("SELECT 'customer, sparse_too' AS missing_columns, count(*) AS rows FROM orders")
def required_columns_reported(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "price", "priority")
    path = write_csv(df, new_path(spark, "upload"), "orders")
    try:
        read_features_csv(spark, path, ["price", "customer", "priority", "sparse_too"])
        message = ""
    except ValueError as problem:
        message = str(problem).removeprefix("Missing columns: ")
    return read_csv(spark, path).agg(F.lit(message).alias("missing_columns"), F.count(F.lit(1)).alias("rows"))


_SCALED = [f"{name}_scaled" for name in KEPT]


@query(
    f"""WITH {PREPARED} SELECT o_orderkey, {', '.join(f'round({c}, 6) AS {c}' for c in (*KEPT, *_SCALED))}
    FROM prepared"""
)
def stream_prepare(spark, sf_dir):
    """Stored parameters applied to arriving files."""
    _, state = prepared_orders(spark, sf_dir)
    raw = orders(spark, sf_dir)
    inbox = new_path(spark, "inbox")
    raw.write.parquet(inbox)
    out = new_path(spark, "stream-out")
    run_available(arriving_files(spark, inbox, raw.schema), state.transform, out, new_path(spark, "progress"))
    return rounded(spark.read.parquet(out).select("o_orderkey", *KEPT, *_SCALED), *KEPT, *_SCALED)


@query("SELECT count(*) AS rows, 0::BIGINT AS differing FROM orders")
def stream_score_agreement(spark, sf_dir):
    """Rows that arrive in two batches get the scores of the batch job, each exactly once."""
    scorer = order_scorer(spark, sf_dir)
    raw = orders(spark, sf_dir)
    inbox, out, progress = (new_path(spark, n) for n in ("inbox", "stream-out", "progress"))
    for part in (0, 1):
        raw.where(F.col("o_orderkey") % 2 == part).write.mode("append").parquet(inbox)
        run_available(arriving_files(spark, inbox, raw.schema), scorer.transform, out, progress)
    batch = scorer.transform(raw).select("o_orderkey", F.col("probability").alias("expected"))
    joined = spark.read.parquet(out).select("o_orderkey", "probability").join(batch, "o_orderkey")
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(F.col("probability") - F.col("expected")) > 1e-12).alias("differing"),
    )


@query(f"{_VALID} FROM orders")
def stream_score_csv(spark, sf_dir):
    scorer = order_scorer(spark, sf_dir)
    raw = orders(spark, sf_dir)
    inbox, out = new_path(spark, "inbox"), new_path(spark, "stream-out")
    raw.write.csv(inbox, header=True)
    stream = arriving_files(spark, inbox, raw.schema, "csv")
    run_available(stream, scorer.transform, out, new_path(spark, "progress"))
    return _valid(spark.read.parquet(out))


@query(
    """SELECT count_if(o_orderkey % 10 < 8) AS rows, count(DISTINCT o_orderkey) FILTER (o_orderkey % 10 < 8) AS keys,
      0::BIGINT AS differing, count_if(o_orderkey % 10 = 8) AS refused_rows, 1 AS refused_files,
      'Missing columns: customer' AS reason, true AS totals_agree, true AS next_run_adds_nothing FROM orders"""
)
def stream_refuses_bad_files(spark, sf_dir):
    """Files that arrive in two runs, in two column orders, with lines of too many cells, and one without a feature.

    Good rows are scored once, as in a batch; the others are reported.
    """
    scorer = order_scorer(spark, sf_dir)
    raw = orders(spark, sf_dir)
    inbox, out, progress = (new_path(spark, n) for n in ("inbox", "scored", "progress"))
    names, last = ["o_orderkey", *KEPT, "sparse"], F.col("o_orderkey") % 10
    raw.where(last < 4).select(*names).coalesce(2).write.mode("append").csv(inbox, header=True)
    lacking = [name for name in names if name != "customer"]
    raw.where(last == 9).select(*lacking).coalesce(1).write.mode("append").csv(inbox, header=True)
    score_arriving_csv(spark, inbox, scorer, out, progress, files_per_batch=2)
    raw.where(last.between(4, 7)).select(*reversed(names)).coalesce(2).write.mode("append").csv(inbox, header=True)
    text = F.concat_ws(",", *(F.coalesce(F.col(name).cast("string"), F.lit("")) for name in names))
    ragged = raw.where(last == 8).coalesce(1)
    lines = _written_lines(spark, ragged, F.concat(text, F.lit(",more")), ",".join(names))
    spark.read.text(lines, wholetext=False).coalesce(1).write.mode("append").text(inbox)
    done = score_arriving_csv(spark, inbox, scorer, out, progress, files_per_batch=2)
    before = done.totals(spark).first()
    again = score_arriving_csv(spark, inbox, scorer, out, progress).totals(spark).first()
    expected = scorer.transform(raw).select("o_orderkey", F.col("probability").alias("expected"))
    scored = done.scored(spark).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "probability", "prediction")
    found = scored.join(expected, "o_orderkey").agg(
        F.count("*").alias("rows"),
        F.count_distinct("o_orderkey").alias("keys"),
        F.count_if(F.abs(F.col("probability") - F.col("expected")) > 1e-9).alias("differing"),
        F.sum("prediction").alias("positives"),
    ).first()
    files = done.refused_files(spark).collect()
    same = (before["rows"], before["positives"]) == (found["rows"], found["positives"])
    row = (found["rows"], found["keys"], found["differing"], done.refused_rows(spark).count(), len(files),
           files[0]["reason"], same, before == again)
    return spark.createDataFrame(
        [row],
        "rows bigint, keys bigint, differing bigint, refused_rows bigint, refused_files int, reason string,"
        " totals_agree boolean, next_run_adds_nothing boolean",
    )


_TYPED_EVENTS = """SELECT event_id::INT AS event_id, CASE WHEN event_id % 10 <> 9 THEN value END AS value, event_type,
  user_id % 2 = 0 AS even_user, CAST(ts AS DATE) AS day FROM events"""
_TYPED_COLUMNS = "event_id int, value double, event_type string, even_user boolean, day date"


def _typed_events(spark, sf_dir):
    value = F.when(F.col("event_id") % 10 != 9, F.col("value"))
    return table(spark, sf_dir, "events").select(
        "event_id", value.alias("value"), "event_type", (F.col("user_id") % 2 == 0).alias("even_user"),
        F.to_date("ts").alias("day"),
    )


def _with_types(df, wanted):
    """The rows, if the columns have these types: another inferred type is an error here."""
    found = ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
    if found != wanted:
        raise ValueError(f"inferred {found}, not {wanted}")
    return df


@query(_TYPED_EVENTS)
def csv_types_with_trailing_comments(spark, sf_dir):
    """No types are given; every line ends in a comment, which is no part of the last cell."""
    df = _typed_events(spark, sf_dir)
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in df.columns]
    line = F.concat(F.concat_ws(",", *cells), F.lit(" # 1, "), F.col("event_type"))
    path = _written_lines(spark, df, line, ",".join(df.columns) + " # header")
    return _with_types(read_csv(spark, path, trailing_comments=True), _TYPED_COLUMNS)


@query(_TYPED_EVENTS)
def csv_types_of_different_headers(spark, sf_dir):
    """No types are given; files have their columns in other orders, and types go by name."""
    df, path = _typed_events(spark, sf_dir), new_path(spark, "events-csv")
    for part in (0, 1, 2):
        order = df.columns[part:] + df.columns[:part]
        df.where(F.col("event_id") % 3 == part).select(*order).write.mode("append").csv(path, header=True)
    names = df.columns
    return _with_types(read_csv(spark, path).select(*names), _TYPED_COLUMNS)


WIDTH = 8


#: Digits of the parts of a report. Shares of counts and statistics of small numbers have nine, as a sixth digit
#: may hang on a tie that the order of additions decides.
DIGITS = {"metrics": 9, "classes": 9, "roc": 9, "statistics": 9, "history": 9}
_LARGE, _DIGITS_OF_LARGE = 1000, 6


def _cell(value, part):
    digits = DIGITS.get(part, 6)
    value = F.col(value).cast("double")
    return F.when(F.abs(value) >= _LARGE, F.round(value, _DIGITS_OF_LARGE)).otherwise(F.round(value, digits))


def _cell_sql(value, part):
    digits = DIGITS.get(part, 6)
    return f"CASE WHEN abs({value}) >= {_LARGE} THEN round({value}::DOUBLE, {_DIGITS_OF_LARGE}) ELSE round({value}::DOUBLE, {digits}) END"


def _long(report, shape):
    """The rows of all tables of a report: part, name, and up to eight numbers."""
    rows = None
    for part, (name, values) in shape.items():
        cells = [_cell(v, part) for v in values]
        cells += [F.lit(None).cast("double")] * (WIDTH - len(cells))
        one = report[part].select(
            F.lit(part).alias("part"),
            (F.concat_ws("|", *name) if name else F.lit("")).alias("name"),
            *(cell.alias(f"v{k}") for k, cell in enumerate(cells)),
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _long_sql(shape, sources):
    parts = []
    for part, (name, values) in shape.items():
        cells = [f"{_cell_sql(v, part)} AS v{k}" for k, v in enumerate(values)]
        cells += [f"NULL::DOUBLE AS v{k}" for k in range(len(values), WIDTH)]
        named = "concat_ws('|', " + ", ".join(name) + ")" if name else "''"
        parts.append(f"SELECT '{part}' AS part, {named} AS name, {', '.join(cells)} FROM ({sources[part]}) {part}")
    return " UNION ALL ".join(parts)


_EXPLORED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_EXPLORER = {
    "balance": ([], ["rows", "positives", "negatives", "positive_percent"]),
    "histograms": (["feature", "bin"], ["bin_low", "bin_high", "rows"]),
    "correlations": (["feature_x", "feature_y"], ["r"]),
    "statistics": (["feature"], ["rows", "mean", "std", "min", "p25", "p50", "p75", "max"]),
}


@query(
    _long_sql(
        _EXPLORER,
        {
            "balance": f"""WITH {LINES} SELECT count(*) AS rows, count_if(label = 1) AS positives,
              count_if(label = 0) AS negatives, count_if(label = 1) * 100.0 / count(*) AS positive_percent FROM lines""",
            "histograms": f"WITH {LINES} {histogram_sql(_EXPLORED, 50, False)}",
            "correlations": f"WITH {LINES} {matrix_sql(_EXPLORED)}",
            "statistics": f"WITH {LINES} {per_feature(_EXPLORED, DESCRIBE_EXACTLY)}",
        },
    )
)
def explorer_report(spark, sf_dir):
    df = with_label(lines(spark, sf_dir), "l_returnflag", LINE_MAP)
    return _long(reports.explorer_report(df, _EXPLORED), _EXPLORER)


_PERFORMANCE = {
    "metrics": (["metric"], ["score"]),
    "confusion": ([], ["tn", "fp", "fn", "tp"]),
    "classes": (["class"], ["precision", "recall", "f1_score", "support"]),
    "roc": ([], ["threshold", "fpr", "tpr"]),
    "calibration": (["bin"], ["mean_predicted", "fraction_positive", "rows"]),
    "score_histogram": (["label", "bin"], ["bin_low", "bin_high", "rows", "density"]),
}


@query(
    _long_sql(
        _PERFORMANCE,
        {
            "metrics": ORACLES["all_metrics"],
            "confusion": ORACLES["confusion_matrix"],
            "classes": ORACLES["classification_report"],
            "roc": ORACLES["roc_curve"],
            "calibration": ORACLES["calibration_curve"],
            "score_histogram": ORACLES["probability_histogram"],
        },
    )
)
def performance_report(spark, sf_dir):
    names = ("Non-Planet", "Planet")
    return _long(reports.performance_report(scored_lines(spark, sf_dir), class_names=names), _PERFORMANCE)


@query(
    f"""WITH {TEXT_SPLIT}, t AS (SELECT count(*) AS n, count_if(label = 1) AS p FROM members WHERE split = 'test'),
    e AS (SELECT count(*) AS n FROM members)
    SELECT part, rows, true AS valid FROM (
      SELECT 'metrics' AS part, 5 AS rows UNION ALL SELECT 'confusion', n FROM t UNION ALL SELECT 'classes', p FROM t
      UNION ALL SELECT 'roc', 1 UNION ALL SELECT 'calibration', n FROM t UNION ALL SELECT 'score_histogram', n FROM t
      UNION ALL SELECT 'importance', 6 UNION ALL SELECT 'history', n FROM e)"""
)
def model_report(spark, sf_dir):
    """The report of a fitted forest, importances and history included: what its tables must agree on.

    The test rows are in the confusion matrix, the calibration bins and the histogram; the positives among
    them are the support of class 1; the metrics are those of the history's row of the test split;
    the curve ends at (1, 1); the importances fall and sum up to one.
    """
    tables = text_tables(spark, sf_dir)
    with tables.kept() as (train, _):
        fitted = training.fit_forest(training.FOREST_BASELINE, train)
    report = reports.performance_report(
        training.scored(fitted.model, tables.test),
        importance.gain_importance(spark, fitted.model, tables.state.features),
        training.history("forest", "baseline", fitted, tables.all),
        class_names=("Poor", "Good"),
    )
    long = {r["metric"]: r["score"] for r in report["metrics"].collect()}
    confusion = report["confusion"].first()
    classes = {r["class"]: r for r in report["classes"].collect()}
    curve = report["roc"].agg(F.max("fpr"), F.max("tpr"), F.min("fpr"), F.min("tpr")).first()
    binned = report["calibration"].agg(F.sum("rows"), F.sum(F.col("rows") * F.col("fraction_positive"))).first()
    histogram = report["score_histogram"].agg(F.sum("rows"), F.max("bin")).first()
    weights = [r["importance"] for r in report["importance"].collect()]
    stages = {r["split"]: r for r in report["history"].collect()}
    rows = sum(confusion[name] for name in ("tn", "fp", "fn", "tp"))
    positives = confusion["fn"] + confusion["tp"]
    same = all(abs(long[name] - stages["test"][name]) < 1e-9 for name in evaluate.METRICS)
    ends = tuple(curve) == (1, 1, 0, 0) if 0 < positives < rows else True
    checks = [
        ("metrics", len(long), same),
        ("confusion", rows, abs(long["accuracy"] - (confusion["tn"] + confusion["tp"]) / rows) < 1e-9),
        ("classes", classes["Good"]["support"], abs(classes["Good"]["f1_score"] - long["f1_score"]) < 1e-9),
        ("roc", 1, ends),
        ("calibration", binned[0], abs(binned[1] - positives) < 1e-6),
        ("score_histogram", histogram[0], histogram[1] == 29),
        ("importance", len(weights), abs(sum(weights) - 1) < 1e-9 and weights == sorted(weights, reverse=True)),
        ("history", tables.all.count(), set(stages) == set(SPLITS) and all(r["seconds"] > 0 for r in stages.values())),
    ]
    return spark.createDataFrame(checks, "part string, rows bigint, valid boolean")


@query("SELECT count(*) AS rows, 0::BIGINT AS differing, 0::BIGINT AS other_texts FROM orders")
def standard_scorer_reloaded(spark, sf_dir):
    """A scorer with standard scaling comes back with that scaling and its class texts."""
    prepared, state = prepared_orders(spark, sf_dir, method="standard")
    rows = training.assembled(prepared, state.inputs, ["o_orderkey", "label", "split"])
    model = training.fit(training.forest({"n_estimators": 4, "max_depth": 4}), rows.where("split = 'train'")).model
    return _agreement(spark, Scorer.of(state, model), orders(spark, sf_dir))


_ORDER_DERIVED = DerivedFeatures(
    ratios={"price_per_customer": ("price", "customer")},
    products={"price_priority": ("price", "priority")},
    logs=("price", "not_there"),
    squares=("customer",),
)


def _engineered_scorer(spark, sf_dir, members):
    tables = order_tables(spark, sf_dir)
    ready, engineering = engineer(tables.stored, tables.state, _ORDER_DERIVED)
    inputs = [*tables.state.inputs, *engineering.inputs]
    rows = training.assembled(ready, inputs, ["o_orderkey", "label", "split"])
    train, val = (rows.where(F.col("split") == split) for split in ("train", "val"))
    settings = {**SMALL_BOOSTING, "n_estimators": 3}
    with training.Kept(train, val) as (train, val):
        found = ensemble.fit_seed_ensemble(train, val, settings, members=members, patience=2)
    return Scorer.of(tables.state, found.models, engineering=engineering)


def _agreement(spark, scorer, raw):
    """Rows whose score by the reloaded scorer, in a batch or over a stream, isn't that of the fitted one."""
    path, inbox, out = (new_path(spark, n) for n in ("scorer", "inbox", "stream-out"))
    scorer.save(spark, path)
    loaded = Scorer.load(spark, path)
    raw.write.parquet(inbox)
    run_available(arriving_files(spark, inbox, raw.schema), loaded.transform, out, new_path(spark, "progress"))
    first = scorer.transform(raw).select("o_orderkey", "probability", "prediction_text")
    rows = first
    for k, again in enumerate((loaded.transform(raw), spark.read.parquet(out))):
        again = again.select("o_orderkey", F.col("probability").alias(f"p{k}"), F.col("prediction_text").alias(f"t{k}"))
        rows = rows.join(again, "o_orderkey", "left")
    p, t = F.col("probability"), F.col("prediction_text")
    far = [F.coalesce(F.abs(p - F.col(f"p{k}")) > 1e-12, F.lit(True)) for k in (0, 1)]
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(far[0] | far[1]).alias("differing"),
        F.count_if((t != F.col("t0")) | (t != F.col("t1")) | ~t.isin("Open", "Finished")).alias("other_texts"),
    )


@query("SELECT count(*) AS rows, 0::BIGINT AS differing, 0::BIGINT AS other_texts FROM orders")
def engineered_scorer_agreement(spark, sf_dir):
    """One model on derived features: as fitted, reloaded, and over a stream."""
    return _agreement(spark, _engineered_scorer(spark, sf_dir, 1), orders(spark, sf_dir))


@query("SELECT count(*) AS rows, 0::BIGINT AS differing, 0::BIGINT AS other_texts FROM orders")
def ensemble_scorer_agreement(spark, sf_dir):
    """Three models on derived features: as fitted, reloaded, and over a stream."""
    return _agreement(spark, _engineered_scorer(spark, sf_dir, 3), orders(spark, sf_dir))


@query(
    f"""WITH {SPLIT} SELECT split, 3 AS n_features, '{", ".join(KEPT)}' AS features, count(*) AS rows,
      round(count_if(label = 1) * 100.0 / count(*), 6) AS positive_percent FROM members GROUP BY split"""
)
def written_summary(spark, sf_dir):
    prepared, state = prepared_orders(spark, sf_dir)
    path = new_path(spark, "summary")
    write_summary(preparation_summary(prepared, state.features), path)
    return rounded(read_summary(spark, path), "positive_percent")
