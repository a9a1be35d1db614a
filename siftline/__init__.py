"""Tabular binary classification on Spark: profile, prepare, train, tune, score, evaluate."""

from siftline.plans.prepare import Preparation, prepare
from siftline.plans.scoring import Scorer
from siftline.spec import KOI, TableSpec

__all__ = ["KOI", "Preparation", "Scorer", "TableSpec", "prepare"]
