"""Named queries over the given tables, each with the SQL that must give the same rows."""

from siftline.workload import evaluation, jobs, models, preparation, profiling
from siftline.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "jobs", "models", "preparation", "profiling"]
