"""Model store: save any fitted model and load it back
with the class written in its own metadata (no guessing of the class)."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import SparkSession

_MODULES = ["pyspark.ml", "pyspark.ml.classification", "pyspark.ml.tuning", "pyspark.ml.feature"]


def save_model(model, path: str, overwrite: bool = False) -> str:
    w = model.write()
    if overwrite:
        w = w.overwrite()
    w.save(path)
    return path


def model_class(spark: SparkSession, path: str) -> str:
    """The JVM class name stored in ``path/metadata`` (read by Spark, so any
    file system the cluster can reach works)."""
    line = spark.read.text(f"{path}/metadata").first()[0]
    return json.loads(line)["class"]


def load_model(path: str, spark: SparkSession | None = None):
    spark = spark or SparkSession.getActiveSession()
    cls = model_class(spark, path).rsplit(".", 1)[-1]
    for mod in _MODULES:
        m = importlib.import_module(mod)
        if hasattr(m, cls):
            return getattr(m, cls).load(path)
    raise ValueError(f"unknown model class {cls} in {path}")
