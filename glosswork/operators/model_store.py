"""A folder of model versions that can be loaded again, with everything that scoring needs.

Each version is written to a folder of its own: the weights and the loss history as tables, and a manifest with the inputs and their
order, scaling, the medians that fill gaps, known categories, the configuration and a digest of it all. A version counts once its
marker exists: an empty file, made in one step after everything else, whose name holds number and folder. A reader takes the
marker with the greatest name, so it sees the version before or the new one, never half of one, and two writers do not disturb
each other.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.operators import features as feat
from glosswork.operators.neural import NetConfig, NetMembers, indicators
from glosswork.session import local_table
from glosswork.sources.csv import require_columns

_MARKERS = "versions"


@dataclass(frozen=True)
class StoredModel:
    """A model with the preparation of its inputs: medians for gaps, columns in which a gap is 0, and known categories."""
    model: NetMembers
    version: int
    fill: Mapping[str, float]
    zero: Sequence[str]
    categories: Sequence[tuple[str, str]]

    def columns(self) -> list[str]:
        """The columns that a table must have to be scored."""
        made = set(indicators(self.categories))
        return list(dict.fromkeys([*(f for f in self.model.features if f not in made), *(f for f, _ in self.categories)]))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with its gaps filled, indicator columns and the members' predictions."""
        df = feat.Imputer(dict(self.fill)).transform(feat.zero_filled(require_columns(df, self.columns()), list(self.zero)))
        return self.model.score(df.withColumns(indicators(self.categories)) if self.categories else df)


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Number and folder of every finished version, oldest first."""
    target, files = _folder(spark, f"{path}/{_MARKERS}")
    found = sorted(f.getPath().getName() for f in files.listStatus(target)) if files.exists(target) else []
    return {int(number): name for number, name in (n.split("-", 1) for n in found)}


def _digest(manifest: Mapping, flat: np.ndarray) -> str:
    text = json.dumps({k: v for k, v in manifest.items() if k != "digest"}, sort_keys=True)
    return hashlib.sha256(text.encode() + np.ascontiguousarray(flat, "<f8").tobytes()).hexdigest()


def save_model(spark: SparkSession, model: NetMembers, path: str, fill: Mapping[str, float] | None = None,
               zero: Sequence[str] = (), categories: Sequence[tuple[str, str]] = ()) -> int:
    """Add a version, which becomes the newest, and return its number."""
    name = uuid.uuid4().hex
    manifest = {
        "features": list(model.features), "config": asdict(model.config), "mean": model.mean.tolist(), "scale": model.scale.tolist(),
        "target_mean": float(model.target_mean), "target_scale": float(model.target_scale), "fill": dict(fill or {}),
        "zero": list(zero), "categories": [list(c) for c in categories]}
    manifest = json.loads(json.dumps(manifest))
    manifest["digest"] = _digest(manifest, model.flat)
    model.table(spark).write.parquet(f"{path}/{name}/weights")
    model.history_table(spark).write.parquet(f"{path}/{name}/history")
    local_table(spark, [(json.dumps(manifest),)], "value string").write.text(f"{path}/{name}/manifest")
    number = max(versions(spark, path), default=0) + 1
    marker, files = _folder(spark, f"{path}/{_MARKERS}/{number:010d}-{name}")
    files.createNewFile(marker)
    return number


def load_model(spark: SparkSession, path: str, version: int | None = None) -> StoredModel:
    """A version, the newest unless named. What does not agree with its digest is an error."""
    known = versions(spark, path)
    number = max(known, default=None) if version is None else version
    if number not in known:
        raise ValueError(f"{path} has no version {'at all' if version is None else version}; known: {list(known)}")
    at = f"{path}/{known[number]}"
    stored = json.loads(spark.read.text(f"{at}/manifest", wholetext=True).first()["value"])
    config = NetConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in stored["config"].items()})
    model = NetMembers(tuple(stored["features"]), config, np.zeros((len(config.seeds), 0)), np.array(stored["mean"]),
                       np.array(stored["scale"]), stored["target_mean"], stored["target_scale"])
    model = model.with_table(spark.read.parquet(f"{at}/weights"))
    if _digest(stored, model.flat) != stored["digest"]:
        raise ValueError(f"{at} does not agree with its digest")
    history = spark.read.parquet(f"{at}/history").orderBy("member", "epoch").collect()
    return StoredModel(replace(model, history=tuple(map(tuple, history))), number, stored["fill"], stored["zero"], [
        tuple(c) for c in stored["categories"]])
