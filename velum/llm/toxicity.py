"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents are the positives; everything else, whatever its label, is
unlabelled and a mixture with the class prior as its share of toxic texts. The risk of a
linear classifier is estimated as prior * loss(positives, +) plus the loss of the negative
part, loss(unlabelled, -) - prior * loss(positives, -), and where that difference falls
below zero, which only overfitting can bring about, the step is taken to raise it again.

Features are the distinct lower-case words of the whole text and their beginnings, so that
one stem counts in all its forms. The classifier is fitted in numpy on a bounded sample of
hashed features; scoring is one pass over the texts with the fitted weights."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from velum.llm.shared import Scratch, col, fraction, give_back

FOLDS = 5
PREFIXES = (4, 5, 6, 7)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample and settings of the learner."""

    positives: int = 6_000
    unlabelled: int = 12_000
    least_documents: int = 5
    deviations: float = 5.0
    features: int = 20_000
    steps: int = 200
    rate: float = 0.05
    decay: float = 0.015
    seed: int = 11


@dataclass(frozen=True)
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float


def word_features(word: str) -> list[int]:
    """Hashes of a word and its beginnings; markup around its letters is left out."""
    out = []
    for run in LETTERS.findall(word):
        out.append(zlib.crc32(run.encode()))
        out += [zlib.crc32(f"{run[:n]}-".encode()) for n in PREFIXES if len(run) >= n]
    return out


def features(text: str) -> np.ndarray:
    """The distinct features of a text, sorted."""
    found: set[int] = set()
    for word in set(text.lower().split()):
        found.update(word_features(word))
    return np.array(sorted(found), "u4")


def _telling(at: np.ndarray, in_pos: np.ndarray, rows: list, positive: list, fit: Fit) -> np.ndarray:
    """The features whose share of documents differs between the two samples by more than
    ``fit.deviations`` standard errors: a rare word of one document tells nothing."""
    n_p, n_u = len(positive), len(rows) - len(positive)
    p = np.bincount(at[in_pos], minlength=at.max() + 1 if len(at) else 0)
    u = np.bincount(at[~in_pos], minlength=len(p))
    both = (p + u) / (n_p + n_u)
    error = np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u)) + 1e-12
    z = np.abs(p / n_p - u / n_u) / error
    return (z > fit.deviations) & (p + u >= fit.least_documents)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, fit: Fit = Fit()) -> Model:
    """Fit the classifier; both lists hold arrays of distinct feature hashes."""
    if not positive or not unlabelled:
        return Model(np.empty(0, "u4"), np.empty(0), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    rows = positive + unlabelled
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    keys, at = np.unique(flat, return_inverse=True)
    keys = keys[_telling(at, np.repeat(np.arange(len(rows)) < len(positive), lengths), rows, positive, fit)]
    place = np.searchsorted(keys, flat)
    place[place == len(keys)] = 0
    known = keys[place] == flat if len(keys) else np.zeros(len(flat), bool)
    row, place = np.repeat(np.arange(len(rows)), lengths)[known], place[known]
    is_pos = np.arange(len(rows)) < len(positive)
    share = np.where(is_pos, prior / len(positive), 1 / len(unlabelled))
    w, b = np.zeros(len(keys)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0
    for step in range(1, fit.steps + 1):
        z = np.bincount(row, w[place], len(rows)) + b
        up = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss_neg = np.logaddexp(0, z) * share
        negative = loss_neg[~is_pos].sum() - loss_neg[is_pos].sum()
        # Slope of the loss in z: as a positive it is up - 1, as a negative it is up.
        as_pos, as_neg = (up - 1) * share * is_pos, up * share * np.where(is_pos, -1, 1)
        slope = as_pos + as_neg if negative >= 0 else -as_neg
        g = np.bincount(place, slope[row], len(keys)) + fit.decay * w / len(keys) ** 0.5
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= fit.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= fit.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(keys, w, float(b))


class Scorer:
    """Scores of texts; what a word adds is worked out once."""

    MOST_WORDS = 150_000

    def __init__(self, model: Model):
        self.weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
        self.bias = model.bias
        self.words: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> float:
        found: set[int] = set()
        known, weights = self.words, self.weights
        for word in set(text.lower().split()):
            ids = known.get(word)
            if ids is None:
                if len(known) >= self.MOST_WORDS:
                    known.clear()
                ids = tuple(f for f in word_features(word) if f in weights)
                if len(word) <= 40:
                    known[word] = ids
            found.update(ids)
        z = self.bias + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is in the fold whose labels are never learned from."""
    remainder = F.crc32(col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(False))


def _chosen(share: float, fit: Fit):
    return fraction(F.col("doc_id"), F.lit(fit.seed)) < share


def _sample(docs: DataFrame) -> DataFrame:
    """``found``: the features (32-bit numbers) of each row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch["text"].slice(at, 256).to_pylist()
                found = pa.array([features(t).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([found], names=["found"])

    return docs.select("text").mapInArrow(extract, "found binary")


def _unpacked(found: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "u4") for b in found.to_pylist()]


def _telling_rows(sample: DataFrame, fit: Fit) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Both samples with only those features that tell them apart. Features are counted
    on the cluster; the driver gets at most ``fit.features`` of them."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return [], []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = _unpacked(part["found"])
                flat = np.concatenate(rows) if rows else np.empty(0, "u4")
                toxic = np.repeat(np.asarray(part["toxic"]), [len(r) for r in rows])
                f, place = np.unique(flat, return_inverse=True)
                p = np.bincount(place[toxic], minlength=len(f))
                u = np.bincount(place[~toxic], minlength=len(f))
                yield pa.RecordBatch.from_pydict({"f": f.astype("i8"), "p": p, "u": u})

    counts = sample.select("toxic", "found").mapInArrow(count, "f long, p long, u long")
    counts = counts.groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    error = F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u)) + 1e-12
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / error
    telling = (
        counts.filter(F.col("p") + F.col("u") >= fit.least_documents)
        .select("f", z.alias("z"))
        .filter(F.col("z") > fit.deviations)
        .orderBy(F.desc("z"), "f")
        .limit(fit.features)
        .select("f")
    )
    keys = np.sort(telling.toArrow()["f"].to_numpy())

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [r[np.isin(r, keys)].tobytes() for r in _unpacked(batch["found"])]
            kept = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch["toxic"], kept], names=["toxic", "found"])

    narrowed = sample.select("toxic", "found").mapInArrow(narrow, "toxic boolean, found binary").toArrow()
    rows = list(zip(narrowed["toxic"].to_pylist(), _unpacked(narrowed["found"])))
    return [r for t, r in rows if t], [r for t, r in rows if not t]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
    label: str = "toxic", fit: Fit = Fit(),
) -> Model:
    """Learn from labels of rows that are not held out. The class prior is the share of
    toxic ones among them; the samples of both kinds are bounded by ``fit``."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    marks = (
        labels.select(col(doc_id).alias("doc_id"), col(label).alias("label"))
        .filter(~held_out() & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = min(max(toxic / n, 1e-4), 0.9) if n else 1e-4
    open_rows = rows.filter(~held_out())
    # Identifiers are sampled before they meet the texts: about ``fit.positives`` of them,
    # so they can be broadcast at any size of the tables and no text is shuffled.
    share = fit.positives / max(toxic, fit.positives)
    ids = marks.filter("label = 1").filter(_chosen(share, fit)).select("doc_id")
    ids = F.broadcast(scratch.keep(ids, "ids"))
    sample = _sample(open_rows.join(ids, "doc_id", "left_semi")).withColumn("toxic", F.lit(True))
    share = fit.unlabelled / max(open_rows.count(), fit.unlabelled)
    rest = _sample(open_rows.filter(_chosen(share, fit))).withColumn("toxic", F.lit(False))
    positive, unlabelled = _telling_rows(scratch.keep(sample.unionByName(rest), "sample"), fit)
    return train(positive, unlabelled, prior, fit)


def score_toxicity(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``toxicity``, a score from 0 to 1 for each whole text. A null text is
    empty; a column of that name is replaced."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop("toxicity")
    names, at = df.columns, df.columns.index(text)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    schema = StructType([*plain.schema.fields, StructField("toxicity", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            # A few texts at a time as strings; the batch itself stays as it came.
            texts = (t for k in range(0, batch.num_rows, 128) for t in batch.column(at).slice(k, 128).to_pylist())
            scores = pa.array([scorer(t or "") for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, scores], names=[*batch.schema.names, "toxicity"]
            )
        del scorer
        give_back()

    return plain.mapInArrow(score, schema).toDF(*names, "toxicity")


def toxicity(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Without any positive label every score is the class prior. Null identifiers are not
    held out and have no label; equal rows get equal scores."""
    model = fit_toxicity(docs, labels, **columns)
    text, doc_id = columns.get("text", "text"), columns.get("doc_id", "doc_id")
    scored = score_toxicity(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), model)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
