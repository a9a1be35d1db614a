"""Scoring rows, files and single records with a fitted pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.labels import class_text, mean_probability, thresholded
from siftline.functions.naming import col
from siftline.operators.tables import require_columns
from siftline.plans.engineer import Engineering
from siftline.plans.ensemble import with_member_scores
from siftline.plans.prepare import Preparation
from siftline.plans.training import with_vector
from siftline.sources.csv import DIALECT, read_features_csv, write_csv
from siftline.sources.models import load_pipelines, save_pipeline

MANIFEST = "members int, inputs array<string>, engineered boolean"


@dataclass(frozen=True)
class Scorer:
    """Fitted preparation, optional derived features and one or more models; for batches and streams alike."""

    preparation: Preparation
    models: tuple[Model, ...]
    positive: str = "Positive"
    negative: str = "Negative"
    engineering: Engineering | None = None

    @staticmethod
    def of(
        preparation: Preparation,
        models: Model | Sequence[Model],
        positive: str | None = None,
        negative: str | None = None,
        engineering: Engineering | None = None,
    ) -> Scorer:
        """Class texts come from the preparation where they aren't given."""
        models = tuple(models) if isinstance(models, Sequence) else (models,)
        if not models:
            raise ValueError("a scorer needs a model")
        return Scorer(
            preparation, models, positive or preparation.positive, negative or preparation.negative, engineering
        )

    @property
    def inputs(self) -> list[str]:
        """Columns of the feature vector, in the models' order."""
        return [*self.preparation.inputs, *(self.engineering.inputs if self.engineering else [])]

    def transform(self, df: DataFrame) -> DataFrame:
        """The input columns, then prediction, its text, class-1 probability and confidence.

        A missing feature value is replaced by the stored median for scoring only, an undefined
        derived one by its own. Several models average their probabilities; class 1 from 0.5
        upwards. A single model predicts by its own rule, for trees class 1 above 0.5.
        """
        require_columns(df, self.preparation.features)
        # Raw values travel beside the imputed ones and are restored in the result.
        raw = {f"raw:{name}": col(name) for name in self.preparation.features}
        ready = self.preparation.transform(df.withColumns(raw))
        if self.engineering:
            ready = self.engineering.transform(ready)
        scored, names = with_member_scores(self.models, with_vector(ready, self.inputs), predictions=True)
        p = mean_probability(names)
        predicted = F.col("prediction_0").cast("int") if len(names) == 1 else thresholded(p)
        scored = scored.withColumns({"probability": p, "prediction": predicted})
        return scored.select(
            *[col(f"raw:{n}").alias(n) if f"raw:{n}" in raw else col(n) for n in df.columns],
            "prediction",
            class_text("prediction", self.positive, self.negative).alias("prediction_text"),
            "probability",
            F.greatest(F.col("probability"), 1 - F.col("probability")).alias("confidence"),
        )

    def report_columns(self, scored: DataFrame, features: int = 4) -> DataFrame:
        return scored.select("prediction_text", "probability", *map(col, self.preparation.features[:features]))

    def score_record(self, spark: SparkSession, record: Mapping[str, float]) -> DataFrame:
        names = self.preparation.features
        schema = ", ".join(f"`{name}` double" for name in names)
        row = tuple(None if record.get(n) is None else float(record[n]) for n in names)
        return self.transform(spark.createDataFrame([row], schema))

    def score_csv(self, spark: SparkSession, path: str, out: str, at: datetime | None = None) -> tuple[DataFrame, str]:
        """Score a CSV file and export the result under a time-stamped name."""
        result = self.transform(read_features_csv(spark, path, self.preparation.features))
        written = write_csv(result, out, "predictions", at)
        return spark.read.options(**DIALECT).csv(written, header=True, schema=result.schema), written

    def save(self, spark: SparkSession, path: str) -> None:
        self.preparation.save(spark, f"{path}/preparation")
        if self.engineering:
            self.engineering.save(spark, f"{path}/engineering")
        for k, model in enumerate(self.models):
            save_pipeline(PipelineModel([model]), f"{path}/members/{k}")
        manifest = [(len(self.models), self.inputs, self.engineering is not None)]
        spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.parquet(f"{path}/scorer")

    @staticmethod
    def load(spark: SparkSession, path: str, positive: str | None = None, negative: str | None = None) -> Scorer:
        """A folder that doesn't say how many models and which inputs it holds is an error."""
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/scorer").collect()
        preparation = Preparation.load(spark, f"{path}/preparation")
        if len(manifest) != 1:
            raise ValueError(f"{path} doesn't hold a whole scorer")
        found = load_pipelines({str(k): f"{path}/members/{k}" for k in range(manifest[0]["members"])})
        if len(found) < manifest[0]["members"]:
            raise ValueError(f"{path} lacks a model")
        engineering = Engineering.load(spark, f"{path}/engineering") if manifest[0]["engineered"] else None
        models = [found[str(k)].stages[0] for k in range(len(found))]
        scorer = Scorer.of(preparation, models, positive, negative, engineering)
        if scorer.inputs != list(manifest[0]["inputs"]):
            raise ValueError(f"the models of {path} were fitted on other inputs: {manifest[0]['inputs']}")
        return scorer
