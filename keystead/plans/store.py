"""Fitted models in numbered versions.

A version is a folder beside the others. The empty file ``_WHOLE`` is written
into it last, and only folders that hold it count, so a reader never sees half
a model: a write that was torn leaves a folder that is ignored, and the version
before it stays in use. Works on any file system that Spark writes to; nothing
is renamed or overwritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from keystead.storage import delete, exists, names_in, touch

WHOLE = "_WHOLE"


def versions(spark: SparkSession, path: str) -> list[str]:
    """The folders of whole versions, oldest first."""
    found = [name for name in names_in(spark, path) if name.startswith("v") and exists(spark, f"{path}/{name}/{WHOLE}")]
    return sorted(found)


def save(spark: SparkSession, model: PipelineModel, path: str) -> str:
    """A new version of the model at ``path``; returns its folder. Of two writers at once both versions stay."""
    taken = [int(name[1:11]) for name in names_in(spark, path) if name[1:11].isdigit()]
    folder = f"{path}/v{max(taken, default=0) + 1:010d}-{uuid.uuid4().hex[:8]}"
    model.write().save(f"{folder}/model")
    touch(spark, f"{folder}/{WHOLE}")
    return folder


def load(spark: SparkSession, path: str) -> PipelineModel | None:
    """The newest whole version, or None if there is none."""
    found = versions(spark, path)
    return PipelineModel.load(f"{path}/{found[-1]}/model") if found else None


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The stored model, or a new one fitted and stored if there is none."""
    model = load(spark, path)
    if model is None:
        model = fit()
        save(spark, model, path)
    return model


def keep_newest(spark: SparkSession, path: str, n: int = 3) -> None:
    """Remove whole versions but the newest ``n``."""
    for name in versions(spark, path)[:-n]:
        delete(spark, f"{path}/{name}")
