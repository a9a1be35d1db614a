"""Saving and loading fitted pipelines together with what scoring needs."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.ml import PipelineModel


def save_pipeline(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load_pipelines(paths: Mapping[str, str]) -> dict[str, PipelineModel]:
    """Models that can be read; a missing one is reported and skipped, none at all is an error."""
    models = {}
    for name, path in paths.items():
        try:
            models[name] = PipelineModel.load(path)
        except Exception as problem:
            warnings.warn(f"could not load {name}: {str(problem).splitlines()[0]}", stacklevel=2)
    if not models:
        raise FileNotFoundError("no model could be loaded")
    return models
