"""Fitted pipelines as numbers alone: predictions as Spark expressions, or row by row in plain Python.

Nothing of ``pyspark.ml`` is needed to predict: an exported pipeline is a JSON document.
"""

from __future__ import annotations

import json
import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import transforms as X
from ..operators.calibration import Isotonic, Platt
from . import trainers
from .pipeline import Pipeline


def _tree(node) -> dict:
    """A tree of the library as nested dictionaries, node by node."""
    if node.getClass().getSimpleName() == "LeafNode":
        return {"value": node.prediction()}
    split = node.split()
    rule = {"slot": split.featureIndex()}
    if split.getClass().getSimpleName() == "ContinuousSplit":
        rule["at"] = split.threshold()
    else:
        rule["left_values"] = list(split.leftCategories())
    return rule | {"left": _tree(node.leftChild()), "right": _tree(node.rightChild())}


def _model(model) -> dict:
    """The numbers of a fitted model."""
    if isinstance(model, trainers.OneAgainstAllModel):
        cali = [{"kind": "platt", "a": c.a, "b": c.b} if isinstance(c, Platt) else {"kind": "isotonic", "starts": c.starts, "values": c.values} for c in model.calibrators]
        return {"kind": "oova", "classes": model.classes, "models": [_model(m) for m in model.models], "calibrators": cali, "useprob": model.made.useprob}
    if isinstance(model, trainers.RankerModel):
        return {"kind": "linear", "weights": model.weights, "bias": 0.0}
    if isinstance(model, trainers.ClassRankerModel):
        return {"kind": "scores", "classes": model.classes, "lines": [{"weights": w[:-1], "bias": w[-1]} for w in model.weights]}
    inner = getattr(model, "model", None)
    name = type(inner).__name__
    if name == "LinearRegressionModel":
        return {"kind": "linear", "weights": inner.coefficients.toArray().tolist(), "bias": inner.intercept}
    if name == "LinearSVCModel" or (name == "LogisticRegressionModel" and inner.numClasses <= 2):
        cut = inner.getThreshold() if name == "LinearSVCModel" else math.log(inner.getThreshold() / (1 - inner.getThreshold())) if 0 < inner.getThreshold() < 1 else math.copysign(math.inf, inner.getThreshold() - 0.5)
        return {"kind": "binary", "weights": inner.coefficients.toArray().tolist(), "bias": inner.intercept, "cut": cut}
    if name == "LogisticRegressionModel":
        lines = [{"weights": w, "bias": b} for w, b in zip(inner.coefficientMatrix.toArray().tolist(), inner.interceptVector.toArray().tolist(), strict=True)]
        return {"kind": "scores", "classes": [float(i) for i in range(len(lines))], "lines": lines}
    if name in ("GBTRegressionModel", "GBTClassificationModel"):
        trees = [_tree(t._java_obj.rootNode()) for t in inner.trees]
        # the library's margin of a boosted classifier is twice the sum
        return {"kind": "trees", "trees": trees, "weights": list(inner.treeWeights), "class": name == "GBTClassificationModel"}
    raise TypeError(f"{name or type(model).__name__} can't be exported")


def export(pipeline: Pipeline) -> Exported:
    """The numbers of a trained pipeline of scalers, polynomials, drops of columns and a linear, boosted, ranking or one-against-all model."""
    steps = []
    for step in pipeline.steps:
        if isinstance(step, X.Scaler):
            new, _, old = step.col.partition(":")
            steps.append({"kind": "scaler", "new": new, "old": old or new, "params": [list(p) for p in step.params]})
        elif isinstance(step, X.Polynomial):
            steps.append({"kind": "poly", "col": step.col, "d": step.d})
        elif isinstance(step, X.DropColumns):
            continue
        else:
            raise TypeError(f"{type(step).__name__} can't be exported")
    return Exported({"steps": steps, "features": pipeline.features, "model": _model(pipeline.model)})


def _single(x: float) -> float:
    return struct.unpack("f", struct.pack("f", x))[0]


class Exported:
    """An exported pipeline. ``transform(df)`` adds ``prediction`` by expressions; ``predict_row(row)`` gives it for a dictionary.

    A missing row value, vector or slot has no prediction (null, None).
    """

    def __init__(self, document: dict):
        self.document = document

    def to_json(self) -> str:
        return json.dumps(self.document)

    @classmethod
    def from_json(cls, text: str) -> Exported:
        return cls(json.loads(text))

    # --- as expressions ---

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for s in self.document["steps"]:
            if s["kind"] == "scaler":
                out = X.Scaler(f"{s['new']}:{s['old']}", params=[tuple(p) for p in s["params"]]).transform(out)
            else:
                out = X.Polynomial(s["col"], s["d"]).transform(out)
        x = F.col(f"`{self.document['features']}`").cast("array<double>")
        whole = x.isNotNull() & F.forall(x, lambda v: v.isNotNull())
        return out.withColumn("prediction", F.when(whole, _prediction(self.document["model"], x)))

    # --- row by row ---

    def predict_row(self, row: dict, singles: bool = False) -> float | None:
        """``singles``: the row's vectors have 32-bit slots, as have those that scalers make of them."""
        row = dict(row)
        for s in self.document["steps"]:
            if s["kind"] != "scaler":
                new, _, old = s["col"].partition(":")
                row[new] = _monomials(row.get(old or new), s["d"], singles)
                continue
            value = row.get(s["old"])
            if value is None:
                row[s["new"]] = None
            elif isinstance(value, (list, tuple)):
                made = [None if v is None else (v - a) * k for v, (a, k) in zip(value, s["params"], strict=True)]
                row[s["new"]] = [None if v is None else _single(v) for v in made] if singles else made
            else:
                a, k = s["params"][0]
                row[s["new"]] = (value - a) * k
        x = row.get(self.document["features"])
        return None if x is None or any(v is None for v in x) else _predict(self.document["model"], [float(v) for v in x])


def _monomials(x: list | None, degree: int, singles: bool) -> list | None:
    if x is None or any(v is None for v in x):
        return None
    out, level = list(x), [(v, i) for i, v in enumerate(x)]
    for _ in range(degree - 1):
        level = [(_single(v * x[j]) if singles else v * x[j], j) for v, i in level for j in range(i, len(x))]
        out += [v for v, _ in level]
    return out


def _line(x: Column, weights: list[float], bias: float) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.lit(float(bias))


def _branch(x: Column, node: dict) -> Column:
    if "value" in node:
        return F.lit(float(node["value"]))
    slot = F.get(x, F.lit(node["slot"]))
    left = slot <= F.lit(float(node["at"])) if "at" in node else slot.isin([float(v) for v in node["left_values"]])
    return F.when(left, _branch(x, node["left"])).otherwise(_branch(x, node["right"]))


def _margin(model: dict, x: Column) -> Column:
    """The score that a one-against-all model takes from a base model."""
    if model["kind"] == "trees":
        total = F.lit(0.0)
        for tree, w in zip(model["trees"], model["weights"], strict=True):
            total = total + F.lit(float(w)) * _branch(x, tree)
        return total
    return _line(x, model["weights"], model["bias"])


def _best(scores: Column, classes: list) -> Column:
    return F.element_at(F.array(*(F.lit(float(c)) for c in classes)), F.array_position(scores, F.array_max(scores)).cast("int"))


def _prediction(model: dict, x: Column) -> Column:
    if model["kind"] == "scores":
        return _best(F.array(*(_line(x, m["weights"], m["bias"]) for m in model["lines"])), model["classes"])
    if model["kind"] == "oova":
        scores = [_margin(m, x) for m in model["models"]]
        if model["useprob"]:
            curves = [Platt(c["a"], c["b"]) if c["kind"] == "platt" else Isotonic(c["starts"], c["values"]) for c in model["calibrators"]]
            return _best(trainers.normalised([c.column(s) for c, s in zip(curves, scores, strict=True)] if curves else scores), model["classes"])
        return _best(F.array(*scores), model["classes"])
    score = _margin(model, x)
    if model["kind"] == "binary":
        return (score > F.lit(float(model["cut"]))).cast("double")
    return (score > 0).cast("double") if model.get("class") else score


def _walk(node: dict, x: list[float]) -> float:
    while "value" not in node:
        v = x[node["slot"]]
        node = node["left"] if (v <= node["at"] if "at" in node else v in node["left_values"]) else node["right"]
    return node["value"]


def _score(model: dict, x: list[float]) -> float:
    if model["kind"] == "trees":
        return sum(w * _walk(t, x) for t, w in zip(model["trees"], model["weights"], strict=True))
    return sum(a * b for a, b in zip(x, model["weights"], strict=True)) + model["bias"]


def _predict(model: dict, x: list[float]) -> float:
    if model["kind"] in ("scores", "oova"):
        if model["kind"] == "scores":
            scores = [sum(a * b for a, b in zip(x, m["weights"], strict=True)) + m["bias"] for m in model["lines"]]
        else:
            scores = [_score(m, x) for m in model["models"]]
            curves = [Platt(c["a"], c["b"]) if c["kind"] == "platt" else Isotonic(c["starts"], c["values"]) for c in model["calibrators"]]
            scores = [c.value(s) for c, s in zip(curves, scores, strict=True)] if curves else scores
            if model["useprob"]:
                scores = [min(max(s, 0.0), 1.0) if s == s else 0.0 for s in scores]
        return float(model["classes"][scores.index(max(scores))])
    score = _score(model, x)
    if model["kind"] == "binary":
        return float(score > model["cut"])
    return float(score > 0) if model.get("class") else score
