"""Saved models: a fresh folder for every save, made visible by one manifest.

A model is written whole into a folder of its own below ``models/<name>/``.  Only then a
manifest (JSON: folder, kind, settings, metrics, state of the input) is written beside it
under a passing name and renamed into ``models/<name>/manifests/``, whose names grow with
time.  Readers take the newest manifest and nothing else, so that a run that is killed, or
two at once, never show half a model: a folder without a manifest is not a model.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from trustlens.ml.boosting import BoostedModel
from trustlens.ml.cluster import CentreModel
from trustlens.ml.forest import ForestModel
from trustlens.session import scratch_path


def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"models/{name}")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _publish(spark: SparkSession, name: str, folder: str, manifest: dict) -> dict:
    manifest = manifest | {"name": name, "folder": folder, "written": time.time_ns()}
    target = f"{_folder(spark, name)}/manifests/{manifest['written']:020d}-{uuid.uuid4().hex[:8]}"
    passing = f"{_folder(spark, name)}/.passing-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(passing)
    fs, source = _files(spark, passing)
    _, goal = _files(spark, target)
    fs.mkdirs(goal.getParent())
    if not fs.rename(source, goal):
        raise OSError(f"could not publish {target}")
    return manifest


def manifest(spark: SparkSession, name: str) -> dict:
    """The newest manifest of a model; KeyError where none is published."""
    fs, folder = _files(spark, f"{_folder(spark, name)}/manifests")
    found = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    if not found:
        raise KeyError(name)
    return json.loads(spark.read.text(f"{folder.toString()}/{found[-1]}").first()["value"])


def _rows(table: DataFrame) -> list[dict]:
    return [r.asDict() for r in table.collect()]  # tables of metrics: a few rows


def publish_clusters(spark: SparkSession, name: str, model: CentreModel, metrics: dict[str, DataFrame], state: str) -> dict:
    folder = f"{_folder(spark, name)}/{uuid.uuid4().hex}"
    model.table(spark).write.parquet(folder)
    return _publish(spark, name, folder, {"kind": "centres", "settings": {"k": len(model.centres)}, "state": state,
                                          "metrics": {k: _rows(v) for k, v in metrics.items()}})


def publish_classifier(spark: SparkSession, name: str, result: dict, state: str) -> dict:
    """The best classifier of a ``train_classifier`` result with its imputer, assembler and
    scaler."""
    folder = f"{_folder(spark, name)}/{uuid.uuid4().hex}"
    best = result["best_model_name"]
    model = result["fitted"][best]
    boosted = isinstance(model, BoostedModel)
    if isinstance(model, ForestModel):
        model = model.as_spark(spark)
    PipelineModel([*result["prep"].stages, *([] if boosted else [model])]).write().save(f"{folder}/pipeline")
    if boosted:
        model.save(spark, f"{folder}/trees")
    return _publish(spark, name, folder, {
        "kind": "boosted" if boosted else "pipeline", "model": best, "state": state, "features": result["features"],
        "settings": repr(result["settings"]), "metrics": {"test": _rows(result["metrics"])}})


class PreparedBooster:
    """Imputer, assembler and scaler, then boosted trees."""

    def __init__(self, prep: PipelineModel, model: BoostedModel):
        self.prep, self.model = prep, model

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.prep.transform(rows))


def load(spark: SparkSession, name: str):
    """The model that the newest manifest names; it has ``transform``."""
    said = manifest(spark, name)
    if said["kind"] == "centres":
        return CentreModel.load(spark, said["folder"])
    pipeline = PipelineModel.load(f"{said['folder']}/pipeline")
    return PreparedBooster(pipeline, BoostedModel.load(spark, f"{said['folder']}/trees")) if said["kind"] == "boosted" else pipeline
