"""Derived features of prepared rows, with the values that stand in for undefined ones."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.derived import DerivedFeatures, with_derived
from siftline.functions.naming import col
from siftline.operators.quantiles import exact_quantiles
from siftline.plans.prepare import SCALED, Preparation

SCHEMA = "position int, kind string, name string, sources array<string>, fill double"


@dataclass(frozen=True)
class Engineering:
    """Features derived from scaled columns. A ratio by zero or the logarithm of -1 or less takes ``fills``."""

    derived: DerivedFeatures
    fills: Mapping[str, float]

    @property
    def inputs(self) -> list[str]:
        return list(self.fills)

    def transform(self, df: DataFrame) -> DataFrame:
        """Derived columns beside the prepared ones. No job, no shuffle."""
        fills = {name: F.coalesce(col(name), F.lit(float(fill))) for name, fill in self.fills.items()}
        return with_derived(df, self.derived, SCALED).withColumns(fills)

    def save(self, spark: SparkSession, path: str) -> None:
        parts = [
            *(("ratio", name, list(pair)) for name, pair in self.derived.ratios.items()),
            *(("product", name, list(pair)) for name, pair in self.derived.products.items()),
            *(("log", f"{name}_log", [name]) for name in self.derived.logs),
            *(("square", f"{name}_squared", [name]) for name in self.derived.squares),
        ]
        rows = [(i, kind, name, sources, self.fills.get(name)) for i, (kind, name, sources) in enumerate(parts)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Engineering:
        rows = spark.read.parquet(path).orderBy("position").collect()
        of = {kind: [r for r in rows if r["kind"] == kind] for kind in ("ratio", "product", "log", "square")}
        derived = DerivedFeatures(
            ratios={r["name"]: tuple(r["sources"]) for r in of["ratio"]},
            products={r["name"]: tuple(r["sources"]) for r in of["product"]},
            logs=tuple(r["sources"][0] for r in of["log"]),
            squares=tuple(r["sources"][0] for r in of["square"]),
        )
        return Engineering(derived, {r["name"]: r["fill"] for r in rows if r["fill"] is not None})


def engineer(prepared: DataFrame, state: Preparation, derived: DerivedFeatures) -> tuple[DataFrame, Engineering]:
    """Prepared rows with derived columns, and the fitted fills: medians over the training rows.

    A feature that is undefined in every training row gets 0. Sources that were dropped as sparse
    are an error, but for logarithms, which are left out.
    """
    known = set(state.features)
    pairs = {**derived.ratios, **derived.products, **{name: (name,) for name in derived.squares}}
    missing = sorted({part for sources in pairs.values() for part in sources} - known)
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    raw = with_derived(prepared, derived, SCALED)
    names = derived.names(state.features)
    train = raw.where(F.col("split") == "train")
    found, _ = exact_quantiles(train, {name: col(name) for name in names}, (0.5,), [])
    fitted = Engineering(derived, {name: 0.0 if found[name][0] is None else found[name][0] for name in names})
    return fitted.transform(prepared), fitted
