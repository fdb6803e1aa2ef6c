"""Pipelines from short descriptions such as ``Scaler{col=X scale=minMax}``, with tagged branches."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from ..operators import density
from ..operators import transforms as X
from . import trainers
from .language import parse

#: Names, in lower case, of the transforms that a description may use.
TRANSFORMS = {
    "scaler": X.Scaler, "poly": X.Polynomial, "detrend": X.Detrend, "addrandom": X.AddRandom, "arnd": X.AddRandom,
    "resample": X.Resample, "splittraintest": X.SplitTrainTest, "multitobinary": X.MultiToBinary, "m2b": X.MultiToBinary,
    "sortdf": X.SortRows, "sortmem": X.SortRows, "cachedf": X.Cache, "pass": X.PassThrough, "dumpview": X.PassThrough,
    "concat": X.Concat, "extconv": X.KeyToLabel, "mcconv": X.KeyToLabel,
    "knntr": density.NearestNeighbors, "dbscan": density.DBScan, "optics": density.Optics, "opticsord": density.OpticsOrder,
    "ul2r4": X.CodeToLabel, "describe": X.Describe, "nafilter": X.MissingFilter, "drop": X.DropColumns,
}



def build(text: str) -> X.Transform:
    """A transform from its description; ``+`` and ``-`` are true and false."""
    name, options = parse(text)
    if name.lower() not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}")
    kind = TRANSFORMS[name.lower()]
    fields = {f.name: f for f in dataclasses.fields(kind)}
    aliases = {"lambda": "l", "d": "d", "label": "lab"}
    values = {}
    for key, value in options.items():
        key = key if key in fields else aliases.get(key, key)
        if key not in fields:
            raise ValueError(f"{name} has no option {key}")
        default = fields[key].default
        values[key] = value == "+" if isinstance(default, bool) else type(default)(value) if isinstance(default, (int, float)) else value
    return kind(**values)


def fitted(step: X.Transform, path: str) -> dict:
    """What a step learned, as JSON holds it; rows that it keeps are stored at ``path``."""
    rows = getattr(step, "items", None)
    if isinstance(rows, DataFrame):
        rows.write.mode("overwrite").parquet(path)
    return {"params": getattr(step, "params", None), "rows": isinstance(rows, DataFrame)}


def refit(spark: SparkSession, step: X.Transform, kept: dict, path: str) -> None:
    """Give a step what ``fitted`` stored."""
    params = kept["params"]
    if params is not None:
        step.params = [tuple(p) if isinstance(p, list) else p for p in params] if isinstance(step.params, list) else tuple(params)
    if kept["rows"]:
        step.items = spark.read.parquet(path)


class Pipeline:
    """Transforms, fitted one after the other, and an optional trainer on a vector and a label column.

    Steps are descriptions or transforms (such as lambdas); only pipelines of descriptions can be saved.
    """

    def __init__(self, steps: list[str | X.Transform], trainer: str | None = None, features: str = "Features", label: str = "Label"):
        self.texts, self.trainer, self.features, self.label = list(steps), trainer, features, label
        self.steps = [s if isinstance(s, X.Transform) else build(s) for s in steps]
        self.model = None

    def train(self, df: DataFrame) -> Pipeline:
        for step in self.steps:
            df = step.fit(df).transform(df)
        if self.trainer:
            self.model = trainers.make(self.trainer, self.features, self.label).fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.transform(df))

    def save(self, spark: SparkSession, path: str) -> None:
        """Descriptions and fitted numbers as JSON text; rows that steps keep and the trained model, of any trainer, beside them."""
        steps = [fitted(step, f"{path}/rows{i}") for i, step in enumerate(self.steps)]
        trainers.write_json(spark, f"{path}/steps", {"texts": self.texts, "trainer": self.trainer, "features": self.features, "label": self.label, "steps": steps})
        if self.model is not None:
            self.model.save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Pipeline:
        kept = trainers.read_json(spark, f"{path}/steps")
        out = cls(kept["texts"], kept["trainer"], kept["features"], kept["label"])
        for i, (step, own) in enumerate(zip(out.steps, kept["steps"], strict=True)):
            refit(spark, step, own, f"{path}/rows{i}")
        if out.trainer:
            out.model = trainers.load(spark, f"{path}/model", out.features)
        return out


class Tags:
    """Named frames: branches of a graph."""

    def __init__(self):
        self.frames: dict[str, DataFrame] = {}

    def tag(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.frames:
            raise ValueError(f"{name} is taken")
        self.frames[name] = df
        return df

    def select(self, name: str, store: str | None = None, current: DataFrame | None = None) -> DataFrame:
        """Go on from ``name``; the current frame may be stored under another tag first."""
        if store is not None:
            self.tag(store, current)
        if name not in self.frames:
            raise KeyError(name)
        return self.frames[name]

    def append(self, df: DataFrame, *names: str) -> DataFrame:
        """``df`` and the tagged frames under its schema."""
        for name in names:
            df = df.unionByName(self.select(name).select(*df.columns))
        return df
