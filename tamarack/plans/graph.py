"""Branching runs of described steps: tags, selection, appending, training and scoring on the way."""

from __future__ import annotations

import re

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trainers
from .language import parse
from .pipeline import Tags, build


class Graph:
    """Steps over a current frame, with named frames and predictors beside it.

    Steps: any transform's description, and ``Chain``, ``Tag``, ``SelTag``, ``Append``, ``TagTrainScore``,
    ``TagScore``, ``TagPredict`` and ``Predict``. Names are case-insensitive.
    """

    def __init__(self, tags: Tags | None = None):
        self.tags, self.models = tags or Tags(), {}

    def run(self, df: DataFrame, steps: list[str]) -> DataFrame:
        known = {
            "chain": self.chain, "tag": self.tag, "seltag": self.select, "append": self.append, "tagtrainscore": self.train_score,
            "tagscore": self.score, "tagpredict": self.predict, "predict": self.predict,
        }
        for text in steps:
            name, options = parse(text)
            if name.lower() in known:
                df = known[name.lower()](df, **options)
            else:
                df = build(text).fit(df).transform(df)
        return df

    def chain(self, df: DataFrame, **steps: str) -> DataFrame:
        """``xf1=… xf2=…`` in the order of their numbers."""
        return self.run(df, [steps[k] for k in sorted(steps, key=lambda k: int(re.sub(r"\D", "", k) or 0))])

    def tag(self, df: DataFrame, t: str) -> DataFrame:
        return self.tags.tag(t, df)

    def select(self, df: DataFrame, t: str | None = None, s: str | None = None, f: str | None = None) -> DataFrame:
        """The current frame is stored as ``t``; go on from tag ``s`` or the Parquet file ``f``."""
        if (s is None) == (f is None):
            raise ValueError("either a tag or a file is needed")
        if s is not None:
            return self.tags.select(s, t, df)
        if t is not None:
            self.tags.tag(t, df)
        return df.sparkSession.read.parquet(f)

    def append(self, df: DataFrame, t: str) -> DataFrame:
        return self.tags.append(df, *t.split(","))

    def train_score(self, df: DataFrame, tr: str, tag: str, out: str | None = None, feat: str = "Features", lab: str = "Label") -> DataFrame:
        """Train on the current frame now, keep the predictor as ``tag`` (and save it in ``out``), and score."""
        if tag in self.models:
            raise ValueError(f"{tag} is taken")
        self.models[tag] = trainers.make(tr, feat, lab).fit(df)
        if out is not None:
            self.models[tag].save(out)
        return self.models[tag].transform(df)

    def _model(self, df: DataFrame, tag: str | None, f: str | None, feat: str):
        if f is not None:
            return trainers.load(df.sparkSession, f, feat)
        if tag not in self.models:
            raise KeyError(tag)
        return self.models[tag]

    def score(self, df: DataFrame, tag: str | None = None, f: str | None = None, feat: str = "Features") -> DataFrame:
        """All columns of a tagged or saved predictor."""
        return self._model(df, tag, f, feat).transform(df)

    def predict(self, df: DataFrame, tag: str | None = None, f: str | None = None, feat: str = "Features", col: str = "Score", p: str = "-") -> DataFrame:
        """Only the raw score, or the probability of the last class (``p=+``), as ``col``."""
        scored = self._model(df, tag, f, feat).transform(df)
        source = "probability" if p == "+" else "rawPrediction"
        value = vector_to_array(F.col(source))[1] if source in scored.columns else F.col("prediction").cast("double")
        return scored.withColumn("_value", value).select(*df.columns, F.col("_value").alias(col))
