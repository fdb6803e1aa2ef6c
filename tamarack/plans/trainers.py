"""Trainers by name: those of ``pyspark.ml``, nearest neighbours, and one-against-all over expanded classes.

A trainer has ``fit(df)``; the model that it returns has ``transform(df)``, which adds ``prediction`` and the
columns of its scores. Features are an array column, labels a numeric one. Every model can be saved and loaded again.
"""

from __future__ import annotations

import json

from pyspark.ml import classification, clustering, regression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbors, ranking
from ..operators import transforms as X
from ..operators.calibration import Isotonic, Platt
from ..operators.transforms import uniform
from ..session import durable
from .language import number, parse

#: Names, in lower case, of the trainers that ``pyspark.ml`` has.
LIBRARY = {
    "lr": classification.LogisticRegression, "mlr": classification.LogisticRegression, "km": clustering.KMeans,
    "ols": regression.LinearRegression, "sasdcar": regression.LinearRegression, "ft": classification.GBTClassifier,
    "ap": classification.LinearSVC, "ftr": regression.GBTRegressor,
}

_VECTORS = "_features"


def with_vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn(_VECTORS, array_to_vector(F.col(f"`{features}`").cast("array<double>")))


class Model:
    """What a trainer, ``made``, fits. ``values`` stores inner models and rows below ``path`` and gives the fitted numbers as JSON holds them."""

    def __init__(self, made):
        self.made = made

    def values(self, path: str) -> dict:
        raise NotImplementedError

    def save(self, path: str) -> None:
        """A folder with the trainer's description and the fitted numbers as JSON, inner models and rows beside them; it replaces what was there."""
        made = self.made
        kept = {"trainer": made.text, "features": made.features, "label": made.label, "values": self.values(path)}
        write_json(SparkSession.active(), f"{path}/about", kept)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, default=float),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


class LibraryModel(Model):
    """A fitted model of ``pyspark.ml`` that reads an array column."""

    def __init__(self, made: Library, model):
        super().__init__(made)
        self.model, self.features = model, made.features

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(with_vectors(df, self.features)).drop(_VECTORS)

    def values(self, path: str) -> dict:
        self.model.write().overwrite().save(f"{path}/model")
        return {}


class Library:
    """An estimator of ``pyspark.ml`` under its short name."""

    def __init__(self, name: str, options: dict[str, str], features: str, label: str):
        self.features, self.label = features, label
        self.estimator = LIBRARY[name](featuresCol=_VECTORS, **{k: number(v) for k, v in options.items()})
        if self.estimator.hasParam("labelCol"):
            self.estimator.setLabelCol(label)

    def fit(self, df: DataFrame) -> LibraryModel:
        return LibraryModel(self, self.estimator.fit(with_vectors(df, self.features)))

    def restored(self, spark: SparkSession, path: str, values: dict) -> LibraryModel:
        return LibraryModel(self, DefaultParamsReader.loadParamsInstance(f"{path}/model", spark))


class Neighbors:
    """Votes of the ``k`` nearest training rows: a share for the positive class, or one for each class."""

    def __init__(self, options: dict[str, str], features: str, label: str, multi: bool):
        self.k, self.metric = int(options.get("k", 5)), options.get("d", "L2")
        self.weighting, self.id = options.get("w", "uniform"), options.get("id", "id")
        self.features, self.label, self.multi = features, label, multi

    def fit(self, df: DataFrame) -> NeighborsModel:
        classes = [r[0] for r in df.select(self.label).distinct().orderBy(self.label).collect()]  # one row a class
        return NeighborsModel(self, df.select(self.id, self.features, self.label), classes)

    def restored(self, spark: SparkSession, path: str, values: dict) -> NeighborsModel:
        return NeighborsModel(self, spark.read.parquet(f"{path}/items").toDF(self.id, self.features, self.label), values["classes"])


class NeighborsModel(Model):
    """Adds ``score`` (the share of the largest label; ``multi``: a map of all labels) and ``prediction``."""

    def __init__(self, made: Neighbors, items: DataFrame, classes: list):
        super().__init__(made)
        self.items, self.classes = items, classes

    def values(self, path: str) -> dict:
        self.items.write.mode("overwrite").parquet(f"{path}/items")
        return {"classes": self.classes}

    def transform(self, df: DataFrame) -> DataFrame:
        m = self.made
        votes = neighbors.knn_classify(df, self.items, m.label, m.k, m.metric, m.weighting, m.id, m.features)
        best = F.max_by("label", F.struct("score", -F.col("label"))).alias("prediction")  # ties: the smaller label
        positive = F.sum(F.when(F.col("label") == F.lit(self.classes[-1]), F.col("score")).otherwise(0.0))
        score = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "score")))) if m.multi else positive
        found = votes.groupBy(F.col("id").alias("_id")).agg(score.alias("score"), best)
        return df.join(found, F.col(f"`{m.id}`").cast("long") == F.col("_id"), "left").drop("_id")


class Expanded:
    """One model for all classes: each row meets each class, and the class joins the features.

    The base trainer learns whether the class is the row's; ``ranking``: a relevance of 4 or 0. The class
    enters as one number, or as a slot of its own (``onehot``).
    """

    def __init__(self, options: dict[str, str], features: str, label: str, ranking: bool):
        self.base = options.get("p", "ftr" if ranking else "ft")
        self.onehot = options.get("onehot", "+") == "+"
        self.features, self.label, self.ranking = features, label, ranking

    def wide(self, df: DataFrame, classes: list, candidate: str) -> DataFrame:
        c = F.col(f"`{candidate}`")
        slots = [F.when(c == F.lit(x), 1.0).otherwise(0.0) for x in classes] if self.onehot else [c.cast("double")]
        return df.withColumn("_wide", F.concat(F.col(f"`{self.features}`").cast("array<double>"), F.array(*slots)))

    def fit(self, df: DataFrame) -> ExpandedModel:
        expansion = X.MultiToBinary(self.label, "_target", "Ranking" if self.ranking else "Default", m=1 << 30).fit(df)
        classes = [c for c, _ in expansion.params]
        rows = self.wide(expansion.transform(df), classes, "_target_class").withColumn("_target", F.col("_target").cast("double"))
        return ExpandedModel(self, classes, make(self.base, "_wide", "_target").fit(rows.select("_wide", "_target")))

    def restored(self, spark: SparkSession, path: str, values: dict) -> ExpandedModel:
        return ExpandedModel(self, values["classes"], load(spark, f"{path}/base"))


class ExpandedModel(Model):
    """Adds ``scores``, an array in the order of the classes, and ``prediction``, the class of the highest."""

    def __init__(self, made: Expanded, classes: list, model):
        super().__init__(made)
        self.classes, self.model = classes, model

    def values(self, path: str) -> dict:
        self.model.save(f"{path}/base")
        return {"classes": self.classes}

    def transform(self, df: DataFrame) -> DataFrame:
        scored = df
        for i, c in enumerate(self.classes):  # a column a class: no row is multiplied and none is shuffled
            one = self.made.wide(scored.withColumn("_class", F.lit(c)), self.classes, "_class")
            one = self.model.transform(one)
            score = vector_to_array(F.col("rawPrediction"))[1] if "rawPrediction" in one.columns else F.col("prediction")
            scored = one.withColumn(f"_score{i}", score.cast("double")).select(*scored.columns, f"_score{i}")
        scored = scored.withColumn("scores", F.array(*(F.col(f"_score{i}") for i in range(len(self.classes)))))
        at = F.array_position("scores", F.array_max("scores")).cast("int")
        named = scored.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), at))
        return named.drop(*(f"_score{i}" for i in range(len(self.classes))))


class OneAgainstAll:
    """A binary model for each class, their scores calibrated to probabilities that sum to 1.

    ``p``: the base trainer; ``useprob`` (``-``: highest margin, no probabilities); ``cali``: platt, isotonic or none (scores in 0 to 1 as they are);
    ``ds``: the share of the other classes' rows that each base model leaves out, drawn by a hash of the row's features; the calibrator
    sees all rows. Rows without label are left out.
    """

    def __init__(self, options: dict[str, str], features: str, label: str):
        self.base, self.features, self.label = options.get("p", "lr"), features, label
        self.useprob, self.cali, self.ds = options.get("useprob", "+") == "+", options.get("cali", "platt").lower(), float(options.get("ds", 0))
        if self.cali not in ("platt", "isotonic", "none") or not 0 <= self.ds < 1:
            raise ValueError(f"cali={self.cali} ds={self.ds}")

    def fit(self, df: DataFrame) -> OneAgainstAllModel:
        label = F.col(f"`{self.label}`")
        known = df.where(label.isNotNull() & ~F.isnan(label.cast("double")))
        classes = [r[0] for r in known.select(self.label).distinct().orderBy(self.label).collect()]  # one row a class
        models = []
        for i, c in enumerate(classes):
            mine = known.withColumn("_target", (label == F.lit(c)).cast("double"))
            if self.ds:
                mine = mine.where((F.col("_target") == 1) | (uniform(i, F.xxhash64(f"`{self.features}`")) >= self.ds))
            models.append(make(self.base, self.features, "_target").fit(mine.select(self.features, "_target")))
        out = OneAgainstAllModel(self, classes, models, [])
        if self.useprob and self.cali != "none":
            margins = durable(out.margins(known, "_m").select("_m", label.alias("_y")))
            scores = [F.col("_m")[i] for i in range(len(classes))]
            targets = [(F.col("_y") == F.lit(c)).cast("double") for c in classes]
            out.calibrators = Platt.fit_all(margins, scores, targets) if self.cali == "platt" else [Isotonic.fit(margins, x, t) for x, t in zip(scores, targets, strict=True)]
        return out

    def restored(self, spark: SparkSession, path: str, values: dict) -> OneAgainstAllModel:
        models = [load(spark, f"{path}/class{i}", self.features) for i in range(len(values["classes"]))]
        kind = Platt if self.cali == "platt" else Isotonic
        return OneAgainstAllModel(self, values["classes"], models, [kind(**c) for c in values["calibrators"]])


class OneAgainstAllModel(Model):
    """Adds ``scores`` (an array in the order of the classes) and ``prediction`` (the class of the highest, the smaller of equals)."""

    def __init__(self, made: OneAgainstAll, classes: list, models: list, calibrators: list):
        super().__init__(made)
        self.classes, self.models, self.calibrators = classes, models, calibrators

    def values(self, path: str) -> dict:
        for i, model in enumerate(self.models):
            model.save(f"{path}/class{i}")
        return {"classes": self.classes, "calibrators": [vars(c) for c in self.calibrators]}

    def margins(self, df: DataFrame, name: str) -> DataFrame:
        names, out = [], df
        for i, model in enumerate(self.models):
            one = model.transform(out)
            score = vector_to_array(F.col("rawPrediction"))[1] if "rawPrediction" in one.columns else F.col("prediction")
            out = one.withColumn(f"_score{i}", score.cast("double")).select(*out.columns, f"_score{i}")
            names.append(f"_score{i}")
        return out.withColumn(name, F.array(*names).cast("array<double>")).drop(*names)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.margins(df, "scores")
        if self.made.useprob:
            raw = [F.col("scores")[i] for i in range(len(self.classes))]
            raw = [c.column(x) for c, x in zip(self.calibrators, raw, strict=True)] if self.calibrators else raw
            out = out.withColumn("scores", normalised(raw))
        if not self.classes:
            return out.withColumn("prediction", F.lit(None).cast("double"))
        at = F.array_position("scores", F.array_max("scores")).cast("int")
        return out.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), at))


def normalised(scores: list[Column]) -> Column:
    """Probabilities from scores: cut to 0 to 1, missing ones 0, divided by their sum; all equal where that is 0."""
    cut = F.array(*(F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))) for x in scores))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.transform(cut, lambda x: F.when(total(cut) > 0, x / total(cut)).otherwise(F.lit(1.0 / max(1, len(scores)))))


class Ranker:
    """Linear ranking by pairs inside the rows' ``group``; the label is the relevance. Adds ``prediction``, the score."""

    def __init__(self, options: dict[str, str], features: str, label: str):
        self.group, self.l2, self.features, self.label = options.get("group", "GroupId"), float(options.get("l2", 1)), features, label

    def fit(self, df: DataFrame) -> RankerModel:
        return RankerModel(self, ranking.fit_ranker(df, self.features, self.label, self.group, self.l2))

    def restored(self, spark: SparkSession, path: str, values: dict) -> RankerModel:
        return RankerModel(self, values["weights"])


class RankerModel(Model):
    def __init__(self, made: Ranker, weights: list[float]):
        super().__init__(made)
        self.features, self.weights = made.features, weights

    def values(self, path: str) -> dict:
        return {"weights": self.weights}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", ranking.dot(F.col(f"`{self.features}`"), self.weights) if self.weights else F.lit(0.0))


class ClassRanker:
    """Classes ranked for each row: the row's candidates are a group, its own class is to come first."""

    def __init__(self, options: dict[str, str], features: str, label: str):
        self.l2, self.features, self.label = float(options.get("l2", 1)), features, label

    def fit(self, df: DataFrame) -> ClassRankerModel:
        label = F.col(f"`{self.label}`")
        classes = [r[0] for r in df.where(label.isNotNull()).select(self.label).distinct().orderBy(self.label).collect()]  # one row a class
        return ClassRankerModel(self, classes, ranking.fit_class_ranker(df, self.features, self.label, classes, self.l2))

    def restored(self, spark: SparkSession, path: str, values: dict) -> ClassRankerModel:
        return ClassRankerModel(self, values["classes"], values["weights"])


class ClassRankerModel(Model):
    """Adds ``scores``, an array in the order of the classes, and ``prediction``, the class of the highest."""

    def __init__(self, made: ClassRanker, classes: list, weights: list[list[float]]):
        super().__init__(made)
        self.features, self.classes, self.weights = made.features, classes, weights

    def values(self, path: str) -> dict:
        return {"classes": self.classes, "weights": self.weights}

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.col(f"`{self.features}`")
        scored = df.withColumn("scores", F.array(*(ranking.dot(x, w[:-1]) + F.lit(w[-1]) for w in self.weights)).cast("array<double>"))
        at = F.array_position("scores", F.array_max("scores")).cast("int")
        return scored.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), at) if self.classes else F.lit(None).cast("double"))


class Around:
    """Transforms before the trainer (``pre``), before it while training only (``pret``), and after the model (``post``)."""

    def __init__(self, options: dict[str, str], features: str, label: str):
        self.options, self.features, self.label = options, features, label

    def _steps(self) -> dict[str, X.Transform]:
        from .pipeline import build  # descriptions of transforms; that module knows this one

        return {k: build(self.options[k]) for k in ("pre", "pret", "post") if k in self.options}

    def fit(self, df: DataFrame) -> AroundModel:
        steps = self._steps()
        if "pre" in steps:
            df = steps["pre"].fit(df).transform(df)
        learned = steps["pret"].fit(df).transform(df) if "pret" in steps else df
        model = make(self.options.get("p", "lr"), self.features, self.label).fit(learned)
        if "post" in steps:
            steps["post"].fit(model.transform(df))
        return AroundModel(self, steps, model)

    def restored(self, spark: SparkSession, path: str, values: dict) -> AroundModel:
        from .pipeline import refit

        steps = self._steps()
        for k, fitted in values["steps"].items():
            refit(spark, steps[k], fitted, f"{path}/{k}")
        return AroundModel(self, steps, load(spark, f"{path}/model", self.features))


class AroundModel(Model):
    def __init__(self, made: Around, steps: dict[str, X.Transform], model):
        super().__init__(made)
        self.steps, self.model = steps, model

    def values(self, path: str) -> dict:
        from .pipeline import fitted

        self.model.save(f"{path}/model")
        return {"steps": {k: fitted(step, f"{path}/{k}") for k, step in self.steps.items()}}

    def transform(self, df: DataFrame) -> DataFrame:
        if "pre" in self.steps:
            df = self.steps["pre"].transform(df)
        df = self.model.transform(df)
        return self.steps["post"].transform(df) if "post" in self.steps else df


def make(text: str, features: str = "Features", label: str = "Label"):
    """A trainer from its description, such as ``lr{maxIter=20}`` or ``iOVA{p=ft{maxIter=5}}``."""
    made = _make(*parse(text), features, label)
    made.text = text
    return made


def _make(name: str, options: dict[str, str], features: str, label: str):
    name = name.lower()
    if name in ("knn", "knnmc"):
        return Neighbors(options, features, label, name == "knnmc")
    if name == "iovark" and parse(options.get("p", "rank"))[0].lower() == "rank":
        return ClassRanker(parse(options.get("p", "rank"))[1], features, label)
    if name == "rank":
        return Ranker(options, features, label)
    if name in ("iova", "iovark"):
        return Expanded(options, features, label, name == "iovark")
    if name in ("oova", "ova"):
        return OneAgainstAll(options, features, label)
    if name == "prepost":
        return Around(options, features, label)
    if name not in LIBRARY:
        raise ValueError(f"unknown trainer {name}")
    return Library(name, options, features, label)


def load(spark: SparkSession, path: str, features: str | None = None) -> Model:
    """A saved model; ``features``: the column it reads now, if not the one it learned from."""
    kept = read_json(spark, f"{path}/about")
    return make(kept["trainer"], features or kept["features"], kept["label"]).restored(spark, path, kept["values"])
