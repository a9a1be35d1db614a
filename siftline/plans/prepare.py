"""Label, select, impute, split and scale a raw table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.naming import col
from siftline.functions.scaling import missing_as_null
from siftline.operators import impute as imputing
from siftline.operators import quantiles
from siftline.operators.labeling import with_label
from siftline.operators.split import stratified_split
from siftline.operators.tables import available, require_columns
from siftline.sources.prepared import parameter_table, read_parameters, write_parameters
from siftline.spec import TableSpec

SCALED = "_scaled"


@dataclass(frozen=True)
class Preparation:
    """Fitted state: what imputing and scaling a new row needs."""

    medians: Mapping[str, float | None]
    scales: Mapping[str, Mapping[str, float]]
    label_map: Mapping[str, int]
    method: str = "minmax"
    positive: str = "Positive"
    negative: str = "Negative"

    @property
    def features(self) -> list[str]:
        return list(self.scales)

    @property
    def inputs(self) -> list[str]:
        return [name + SCALED for name in self.scales]

    def transform(self, df: DataFrame) -> DataFrame:
        """Impute, then put scaled columns beside the raw ones. No job, no shuffle."""
        require_columns(df, self.features)
        return imputing.scale(imputing.impute(df, self.medians), self.scales, self.method, SCALED)

    def parameters(self, spark: SparkSession) -> DataFrame:
        return parameter_table(spark, self.medians, self.scales)

    def save(self, spark: SparkSession, path: str) -> None:
        parameters = self.parameters(spark)
        write_parameters(parameters, self.label_map, path, self.method, self.positive, self.negative)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preparation:
        """With the scaling and the class texts that it was saved with."""
        medians, scales, label_map, settings = read_parameters(spark, path)
        return Preparation(medians, scales, label_map, **settings)


def prepare(
    df: DataFrame,
    spec: TableSpec,
    method: str = "minmax",
    fit_on: str = "all",
    max_missing: float = 0.5,
    test_size: float = 0.2,
    val_size: float = 0.125,
    seed: int = 42,
) -> tuple[DataFrame, Preparation]:
    """(key, label, split, imputed features, scaled features) and the fitted state.

    Reads the table five times beside the final use, twice for key and label alone, so store it
    first if it is costly to make.
    ``fit_on="all"`` takes the medians from every labelled row, ``"train"`` from the training
    rows only. Scaling is always fitted on the training rows.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be 'all' or 'train', not {fit_on!r}")
    require_columns(df, [*spec.key, spec.category])
    labelled = with_label(df, spec.category, spec.label_map, spec.label)
    wanted = available(df, spec.features)
    values = {name: missing_as_null(col(name)) for name in wanted}

    table = labelled.select(*map(col, spec.key), spec.label, *[v.alias(n) for n, v in values.items()])
    # The cuts of the split are found from key and label alone.
    table = stratified_split(table, spec.label, spec.key, test_size, val_size, seed, spec.split)

    # Missing shares and training moments come from the pass that checks the medians.
    in_train = F.col(spec.split) == "train"
    everywhere = {n: col(n) for n in wanted}
    trained = {n: F.when(in_train, col(n)) for n in wanted}
    along = [
        F.count_if(in_train).alias("train_rows"),
        *[F.avg(v.isNull().cast("double")).alias(f"missing:{n}") for n, v in everywhere.items()],
        *[F.count(v).alias(f"present:{n}") for n, v in trained.items()],
        *imputing.moments(trained),
    ]
    fitted = everywhere if fit_on == "all" else trained
    found, first = quantiles.exact_quantiles(table, fitted, (0.5,), along)
    features = [n for n in wanted if (first[f"missing:{n}"] or 0.0) <= max_missing and found[n][0] is not None]
    medians = {n: found[n][0] for n in features}
    scales = {}
    for n in features:
        raw = {stat: first[f"{stat}:{n}"] for stat in imputing.STATS}
        present = first[f"present:{n}"]
        scales[n] = imputing.scale_after_filling(raw, present, first["train_rows"] - present, medians[n])

    state = Preparation(medians, scales, dict(spec.label_map), method, spec.positive_text, spec.negative_text)
    prepared = imputing.scale(imputing.impute(table, medians), scales, method, SCALED)
    columns = [*spec.key, spec.label, spec.split, *features, *state.inputs]
    return prepared.select(*map(col, columns)), state
