"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import Scratch
from .tables import id_and_text, only_ids

#: Labelled documents that the model is fitted on, drawn by the hash of their ids, at most.
FIT_DOCUMENTS = 10_000
#: Words and word beginnings with a weight of evidence, at most, and the labelled texts one must be
#: in.  Beginnings of these lengths stand for the many forms of one stem.
VOCABULARY, LEAST_TEXTS, STEMS = 5_000, 5, (3, 4, 5, 6)
#: Words whose class a task remembers before it starts anew.
REMEMBERED = 500_000
#: Classes of evidence: class 0 has none, the others split the log odds at these values.
CLASSES = (1.5, 2.5, 3.5, 4.5)
#: Tokens around a word of evidence that training looks at, and sequences it looks at, at most.
REACH, SEQUENCES = 6, 4_000

TOKEN = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """``emission`` scores a toxic token by the classes of it, its left and its right neighbour."""

    evidence: dict[str, int]
    emission: np.ndarray  # (3, classes)
    transition: np.ndarray  # (2, 2), from row to column
    document: np.ndarray  # weights of ``document_features``


class Reading(NamedTuple):
    """A text's tokens, where those with evidence stand among them, their classes and, once read, their places."""

    tokens: int
    at: list[int]
    classes: list[int]
    places: list[tuple[int, int]] = []


def keys_of(word: str) -> list[str]:
    """The word and its beginnings, marked as such."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


class Reader:
    """Reads texts by a table of evidence; a word counts as the highest class among its keys."""

    def __init__(self, evidence: dict[str, int]):
        self.evidence, self.known = evidence, {}

    def class_of(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = max(self.evidence.get(key, 0) for key in keys_of(word.lower()))
        return found

    def read(self, text: str) -> Reading:
        classes = [*map(self.class_of, TOKEN.findall(text))]
        at = [i for i, c in enumerate(classes) if c]
        return Reading(len(classes), at, [classes[i] for i in at])


def with_places(reading: Reading, text: str) -> Reading:
    """The reading with places, which cost a second pass that few texts need."""
    wanted = set(reading.at)
    return reading._replace(places=[match.span() for i, match in enumerate(TOKEN.finditer(text)) if i in wanted])


def _power(matrix: np.ndarray, exponent: int) -> np.ndarray:
    """A power of a positive matrix, scaled to a largest entry of 1."""
    return _remembered_power(matrix.tobytes(), exponent)


@lru_cache(50_000)
def _remembered_power(matrix: bytes, exponent: int) -> np.ndarray:
    base = np.frombuffer(matrix).reshape(2, 2)
    result, base = np.eye(2), base / base.max()
    while exponent:
        if exponent & 1:
            result = result @ base
            result /= result.max()
        base = base @ base
        base /= base.max()
        exponent >>= 1
    return result


def marginals(reading: Reading, model: Model) -> dict[int, float]:
    """Probability of a toxic tag, by forward and backward passes, where evidence is near.

    Tokens that are not beside evidence all score alike, so a run of them is one matrix power: the
    passes cost steps by the evidence, not by the length of the text.
    """
    n, classes = reading.tokens, dict(zip(reading.at, reading.classes))
    active = sorted({j for i in reading.at for j in (i - 1, i, i + 1) if 0 <= j < n})
    if not active:
        return {}
    step = np.exp(model.transition)
    plain = np.array([1.0, math.exp(model.emission[:, 0].sum())])
    run = step * plain
    scores = {
        j: np.array([1.0, math.exp(sum(model.emission[k, classes.get(j + d, 0)] for k, d in enumerate((0, -1, 1))))])
        for j in active
    }

    def between(gap: int) -> np.ndarray:
        return _power(run, gap)

    forward, state, last = [], np.ones(2), -1
    for j in active:
        if last < 0:
            state = scores[j] if j == 0 else (plain @ between(j - 1)) @ step * scores[j]
        else:
            state = (state @ between(j - last - 1)) @ step * scores[j]
        state = state / state.sum()
        forward.append(state)
        last = j
    found, state, later = {}, between(n - 1 - active[-1]) @ np.ones(2), None
    for j, ahead in zip(reversed(active), reversed(forward)):
        if later is not None:
            state = between(later - j - 1) @ (step @ (scores[later] * state))
        state = state / state.sum()
        both = ahead * state
        found[j] = float(both[1] / both.sum())
        later = j
    return found


def document_features(reading: Reading, probabilities: dict[int, float]) -> np.ndarray:
    """1, the largest marginal, the expected toxic tokens and their share of the text."""
    total = sum(probabilities.values())
    return np.array(
        [1.0, max(probabilities.values(), default=0.0), math.log1p(total), math.sqrt(total / max(reading.tokens, 1))]
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sequences(readings: list[tuple[Reading, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of tokens as padded classes, tags and lengths: evidence and its surroundings."""
    classes, tags = [], []
    for reading, toxic in readings:
        by_place = dict(zip(reading.at, reading.classes))
        at = 0
        while at < len(reading.at):
            start, end = max(0, reading.at[at] - REACH), reading.at[at]
            while at < len(reading.at) and reading.at[at] <= end + REACH and reading.at[at] - start < 8 * REACH:
                end = reading.at[at]
                at += 1
            stop = min(reading.tokens, end + REACH + 1)
            classes.append([by_place.get(j, 0) for j in range(start, stop)])
            tags.append([int(toxic and c > 0) for c in classes[-1]])
    every = max(1, -(-len(classes) // SEQUENCES))  # the readings are sorted, so this draws all lengths alike
    classes, tags = classes[::every], tags[::every]
    lengths = np.array([len(x) for x in classes], int)
    width = int(lengths.max(initial=1))
    pad = lambda rows: np.array([row + [0] * (width - len(row)) for row in rows], int).reshape(-1, width)
    return pad(classes), pad(tags), lengths


def fit_chain(readings: list[tuple[Reading, int]], rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by gradient ascent on the conditional likelihood."""
    n_classes = len(CLASSES) + 1
    emission, transition = np.zeros((3, n_classes)), np.zeros((2, 2))
    emission[0, 0] = -4.0
    classes, tags, lengths = _sequences(readings)
    if not len(classes):
        return emission, transition
    n, width = classes.shape
    inside = np.arange(width) < lengths[:, None]
    left = np.pad(classes, ((0, 0), (1, 0)))[:, :-1]
    right = np.pad(classes, ((0, 0), (0, 1)))[:, 1:] * np.pad(inside, ((0, 0), (0, 1)))[:, 1:]
    views = (classes, left, right)

    def counted(weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(x[inside], weights[inside], n_classes) for x in views])

    seen = counted(tags.astype(float))
    pairs = inside[:, 1:]
    moved = np.array([[((tags[:, :-1] == a) & (tags[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    mean_e, mean_t = [np.zeros_like(emission), np.zeros_like(emission)], [np.zeros((2, 2)), np.zeros((2, 2))]
    for turn in range(1, rounds + 1):
        score = sum(emission[k][x] for k, x in enumerate(views)) * inside
        weight = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], -1)
        step = np.exp(transition)
        forward, backward = np.empty((n, width, 2)), np.ones((n, width, 2))
        forward[:, 0] = weight[:, 0] / weight[:, 0].sum(-1, keepdims=True)
        for t in range(1, width):
            ahead = (forward[:, t - 1] @ step) * weight[:, t]
            forward[:, t] = np.where(inside[:, t, None], ahead / ahead.sum(-1, keepdims=True), forward[:, t - 1])
        expected = np.zeros((2, 2))
        for t in range(width - 2, -1, -1):
            behind = (weight[:, t + 1] * backward[:, t + 1]) @ step.T
            behind /= behind.sum(-1, keepdims=True)
            backward[:, t] = np.where(inside[:, t + 1, None], behind, 1.0)
            joint = forward[:, t, :, None] * step * (weight[:, t + 1] * backward[:, t + 1])[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            expected += (joint * inside[:, t + 1, None, None]).sum(0)
        posterior = forward * backward
        toxic = posterior[..., 1] / posterior.sum(-1)
        gradients = (
            (seen - counted(toxic) - 0.5 * emission) / n,
            (moved - expected - 0.5 * transition) / n,
        )
        for value, gradient, means in ((emission, gradients[0], mean_e), (transition, gradients[1], mean_t)):
            means[0] += 0.1 * (gradient - means[0])
            means[1] += 0.01 * (gradient**2 - means[1])
            value += 0.1 * (means[0] / (1 - 0.9**turn)) / (np.sqrt(means[1] / (1 - 0.99**turn)) + 1e-6)
    return emission, transition


def fit_logistic(features: np.ndarray, labels: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton steps on the penalised logistic likelihood."""
    weights = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = _sigmoid(features @ weights)
        gradient = features.T @ (labels - p) - 0.01 * weights
        curve = (features * (p * (1 - p))[:, None]).T @ features + 0.01 * np.eye(len(weights))
        weights = weights + np.clip(np.linalg.solve(curve, gradient), -5, 5)
    return weights


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of ``labels`` (doc_id, toxic): one label per id, the larger where they differ.

    Fitting reads ``FIT_DOCUMENTS`` labelled texts at most.  The evidence of a word or a beginning
    is its log odds between toxic and other texts; in toxic texts the words of evidence are the tokens labelled
    toxic.  The chain learns from these tokens, the document weights from its marginals.  Without
    texts of both labels every score is the share of toxic ones, or 0.5.
    """
    drawn = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_DOCUMENTS)
    )
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    texts = only_ids(docs.filter("text is not null"), drawn, FIT_DOCUMENTS)
    scratch = Scratch(docs.sparkSession)
    # written, so that all documents are read once for it
    sample = scratch.write(
        texts.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(F.broadcast(drawn), "doc_id")
    )
    counts = sample.groupBy("toxic").count().collect()
    many = sum(row["count"] for row in counts if row.toxic == 1)
    few = sum(row["count"] for row in counts if row.toxic != 1)
    empty = Model({}, np.zeros((3, len(CLASSES) + 1)), np.zeros((2, 2)), np.zeros(4))
    if not many or not few:
        share = 0.0 if not many + few else (40.0 if many else -40.0)
        return empty._replace(document=np.array([share, 0.0, 0.0, 0.0]))
    odds = F.log((F.col("in_toxic") + 0.5) / (many + 1)) - F.log((F.col("texts") - F.col("in_toxic") + 0.5) / (few + 1))
    words = (
        sample.mapInArrow(_distinct_words, "word string, toxic int")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("toxic").alias("in_toxic"))
        .filter(F.col("texts") >= LEAST_TEXTS)
        .withColumn("odds", odds)
        .filter(F.col("odds") > CLASSES[0])
        .orderBy(F.desc(F.col("odds") * F.sqrt("in_toxic")), "word")
        .limit(VOCABULARY)
        .collect()
    )
    evidence = {row.word: int(np.searchsorted(CLASSES, row.odds)) for row in words}
    rows = sample.mapInArrow(_read_sample(evidence), "toxic int, tokens long, at array<long>, classes array<long>").toArrow()
    readings = [
        (Reading(tokens, at, classes), toxic)
        for toxic, tokens, at, classes in zip(*(rows.column(k).to_pylist() for k in range(4)))
    ]
    readings.sort(key=lambda x: (x[0], x[1]))  # the order of rows decides nothing
    emission, transition = fit_chain(readings)
    chain = Model(evidence, emission, transition, np.zeros(4))
    features = np.array([document_features(reading, marginals(reading, chain)) for reading, _ in readings])
    return chain._replace(document=fit_logistic(features, np.array([float(toxic == 1) for _, toxic in readings])))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            mine = {key for word in {*TOKEN.findall(text)} for key in keys_of(word.lower())}
            words += mine
            toxic += [int(label == 1)] * len(mine)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "toxic"])


def _read_sample(evidence: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(evidence)
        for batch in batches:
            readings = [reader.read(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic").cast(pa.int32()),
                    pa.array([r.tokens for r in readings], pa.int64()),
                    pa.array([r.at for r in readings], pa.list_(pa.int64())),
                    pa.array([r.classes for r in readings], pa.list_(pa.int64())),
                ],
                names=["toxic", "tokens", "at", "classes"],
            )

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.evidence)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column(1):
                whole = text.as_py() or ""
                reading = reader.read(whole)
                found = marginals(reading, model)
                scores.append(float(_sigmoid(document_features(reading, found) @ model.document)))
                if any(found[j] >= 0.5 for j in reading.at):
                    reading = with_places(reading, whole)
                spans.append([{"start": a, "end": b} for j, (a, b) in zip(reading.at, reading.places) if found[j] >= 0.5])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, SPANS)],
                names=["doc_id", "score", "spans"],
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` from 0 to 1 and the toxic ``spans`` (code points, end exclusive).

    Every row's whole text is scored by itself; null and empty texts have no spans and the score
    of a text without evidence.
    """
    mine = id_and_text(docs, id_col, text_col)
    kind = mine.schema["doc_id"].dataType.simpleString()
    return mine.mapInArrow(_score(model), f"doc_id {kind}, score double, spans array<struct<start: long, end: long>>")
