"""The trained model and its application to a column of features."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from importlib import resources
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.batches import Lines
from ..operators.flat import settled
from ..schema import LABELS
from .encode import ATTRIBUTES, attributes
from .kernels import log_partition, path_score, viterbi

PREDICTION = "struct<labels:array<string>,confidences:array<double>,marginals:array<array<double>>,probability:double>"


def default_model_path() -> str:
    """Where the bundled model is."""
    return str(resources.files("mailsieve.resources").joinpath("model.json"))


@dataclass
class CrfModel:
    """Weights of (attribute, label) and (label, next label)."""

    labels: list[str] = field(default_factory=lambda: list(LABELS))
    state: np.ndarray = field(default_factory=lambda: np.zeros((len(ATTRIBUTES), len(LABELS))))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    @classmethod
    def load(cls, path: str | None = None) -> CrfModel:
        """From a JSON file, or the one that comes with the package."""
        if path is None:
            text = resources.files("mailsieve.resources").joinpath("model.json").read_text("utf-8")
        else:
            if not Path(path).exists():
                raise FileNotFoundError(f"no model at {path}")
            text = Path(path).read_text("utf-8")
        try:
            d = json.loads(text)
            state = np.zeros((len(ATTRIBUTES), len(d["labels"])))
            for a, row in d["state"].items():
                for label, w in row.items():
                    state[ATTRIBUTES.index(a), d["labels"].index(label)] = w
            return cls(d["labels"], state, np.array([[d["transition"][x].get(y, 0.0) for y in d["labels"]] for x in d["labels"]]))
        except (ValueError, KeyError, TypeError) as e:
            raise RuntimeError(f"{path or 'the bundled file'} is no model: {e}") from e

    def save(self, path: str) -> None:
        state = {a: {y: float(w) for y, w in zip(self.labels, row, strict=True) if w} for a, row in zip(ATTRIBUTES, self.state, strict=True)}
        transition = {x: dict(zip(self.labels, map(float, row), strict=True)) for x, row in zip(self.labels, self.transition, strict=True)}
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps({"labels": self.labels, "state": state, "transition": transition}, ensure_ascii=False, indent=0), "utf-8")

    def predict_batch(self, x: np.ndarray, own: Lines, separators: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Final labels and marginals of the six labels per row, and the probability of the final labels per sequence."""
        e = x @ self.state
        codes = settled(own, viterbi(e, self.transition, own.offsets), separators, self.labels)
        names = [*self.labels, *(y for y in ("BODY", "SIGNATURE") if y not in self.labels)]
        z, m, _ = log_partition(e, self.transition, own.offsets)
        known = codes < len(self.labels)
        score = path_score(e, self.transition, own.offsets, np.where(known, codes, 0)) if len(codes) else np.zeros(len(own.sizes))
        probability = np.minimum(np.exp(score - z), 1.0)
        probability[np.bincount(own.mail, ~known, len(own.sizes)) > 0] = 0.0
        six = np.zeros((len(m), len(LABELS)))
        for k, v in enumerate(LABELS):
            if v in self.labels:
                six[:, k] = m[:, self.labels.index(v)]
        return pa.array(names, pa.string()).take(pa.array(codes)), six, probability

    def prediction(self, numbers: np.ndarray, own: Lines) -> pa.StructArray:
        """The same as rows of ``PREDICTION``."""
        labels, marginals, probability = self.predict_batch(numbers, own, numbers[:, ATTRIBUTES.index("is_delimiter")] > 0)
        place = pc.index_in(labels, pa.array(LABELS)).to_numpy(zero_copy_only=False)
        confidence = marginals[np.arange(len(marginals)), place] if len(marginals) else np.zeros(0)
        ends = pa.array(own.offsets, pa.int32())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(marginals) + 1) * len(LABELS), pa.int32()), pa.array(marginals.ravel()))
        lists = [pa.ListArray.from_arrays(ends, v) for v in (labels, pa.array(confidence), rows)]
        return pa.StructArray.from_arrays([*lists, pa.array(probability)], names=["labels", "confidences", "marginals", "probability"])

    def predict(self, features: Column) -> Column:
        """Labels, their confidences, all marginals and the probability, from an array of features; a null gives a null,
        a mail without lines no labels and the probability 1."""
        model = self

        def run(x: pa.Array, sizes: pa.Array) -> pa.Array:
            numbers, offsets = attributes(x)
            # only the places of the lines matter here
            return model.prediction(numbers, Lines(offsets, np.zeros(len(numbers), np.int32), pa.array([], pa.string())))

        run.__annotations__ = {"x": pa.Array, "sizes": pa.Array, "return": pa.Array}
        # the column is named twice, so that what makes it stays a step of its own and is not moved into this call
        return F.arrow_udf(run, PREDICTION).asNondeterministic()(features, F.size(features))


def labeled_lines(texts: Column, prediction: Column) -> Column:
    """Text, label, confidence and the probabilities of all labels, for each line."""
    names = F.array(*map(F.lit, LABELS))

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            x.alias("text"),
            F.get(prediction["labels"], i).alias("label"),
            F.get(prediction["confidences"], i).alias("confidence"),
            F.map_from_arrays(names, F.get(prediction["marginals"], i)).alias("label_probabilities"),
        )

    return F.transform(texts, one)
