"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier on the presence of hashed word features (the lower-cased word and its beginnings of 3 to
8 bytes) is trained from confirmed toxic documents (P) and unlabelled ones (U: all training documents, whatever
their label), by minimising

    prior * E_P[loss(f, 1)] + max(0, E_U[loss(f, 0)] - prior * E_P[loss(f, 0)])

with the sigmoid loss, loss(f, 1) = sigmoid(-f) and loss(f, 0) = sigmoid(f); where the second part turns negative
its gradient is reversed.  The class prior is the share of toxic rows among all labelled training rows.

1.  Spark counts in how many documents of P and U each of ``SPACE`` hashed features occurs.  Features whose
    shares differ by ``SCREEN * log(size of P)`` standard errors take part, however many they are (``SPACE`` at most).
2.  Every training document is read as the set of its features that take part; equal sets become one row with
    their number, so clean documents, which have few such features, are few rows.
3.  From zero weights, accelerated proximal gradient steps over all these rows: each is one pass in numpy batches,
    whose sums Spark adds in whole numbers, so that their order doesn't matter.  Features are centred and
    scaled by their spread; a small L1 penalty drops those that others explain.

P is a documented sample: ``SAMPLE_P`` toxic documents at most, those with the least hashes of doc_id.  Near copies
in P (equal least hash over word shingles) count once, or a copied text's own words would look toxic.

Defined cases: a null text counts as empty and scores what the bias says; without any toxic training label the
score is 0 everywhere, and the prior if no feature tells P from U; labels with null or repeated doc_id: null ids are
ignored, of repeats the largest label counts; a null doc_id is training text without label.  Other columns never
reach the classifier.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import bound_batches, folded, keyed, lean, least_uint, pack, release, shingle_set, text_rows, unpack, word_hashes, written

#: Toxic documents that the classifier is fitted on, and the hashed feature space.
SAMPLE_P, SPACE = 4_000, 1 << 20
#: Standard errors, for each e-fold of P, by which a feature's shares must differ; counts added to its spread; penalty; steps.
SCREEN, SMOOTH, PENALTY, STEPS, STRETCH = 0.35, 3.0, 0.05, 40, 0.15
_BLOCK = 1 << 13
#: ASCII letters and digits and all bytes of other characters stay; what is left of ASCII parts words.
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Bytes of a word's beginnings that are features.
PREFIXES = (3, 4, 5, 6, 8)
#: Words that a worker remembers.
MEMO = 200_000


def words_of(text: str) -> set[bytes]:
    """Distinct lower-cased words."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(_APART).split())


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of one lower-cased word: the word and its beginnings."""
    digest, mask, size = xxhash.xxh3_64_intdigest, SPACE - 1, len(word)
    return (digest(word) & mask, *[digest(word[:n], n) & mask for n in PREFIXES if size > n])


class _Reader:
    """Features of a text; ``known`` says which of them count.  Words are memoised up to a fixed number."""

    def __init__(self, known=None):
        self.known, self.memo = known, {}

    def __call__(self, text: str) -> set:
        out: set = set()
        get = self.memo.get
        for w in words_of(text):
            got = get(w)
            if got:
                out.update(got)
            elif got is None:
                out.update(self.learn(w))
        return out

    def learn(self, w: bytes) -> tuple[int, ...]:
        known = self.known
        if known is None:
            got = word_features(w)
        else:
            got = tuple([i for i in word_features(w) if i in known])
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(w) <= 64:
            self.memo[w] = got
        return got


@dataclass
class Model:
    """Features that take part, their weights and the bias; ``constant`` stands in where nothing could be learned."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def scorer(self):
        if self.constant is not None:
            return lambda text: self.constant
        weight = dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))
        read = _Reader(weight.keys())
        return lambda text: float(1 / (1 + np.exp(-np.clip(self.bias + sum(weight[i] for i in sorted(read(text))), -30, 30))))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, int] = {}
    for batch in batches:
        least = [int(s[0]) if len(s) else 0 for s in (shingle_set(word_hashes(t.lower().encode("utf-8", "surrogatepass").split(), cache), 4) for _, t in text_rows(iter([batch])))]
        yield batch.append_column("near", pa.array(np.array(least, np.uint64).view(np.int64)))


_COUNT = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])
_COUNT_SQL = "part int, block int, counts binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, SPACE), np.int64)
    read = _Reader()
    for batch in batches:
        for (_, t), positive in zip(text_rows(iter([batch])), batch.column("positive").to_pylist(), strict=True):
            found = read(t)
            total[int(positive), np.fromiter(found, np.int64, len(found))] += 1
    blocks = [i for i in range(0, SPACE, _BLOCK) if total[:, i : i + _BLOCK].any()]
    if blocks:
        data = [pack([least_uint(row[i : i + _BLOCK]) for row in total]) for i in blocks]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array([i // _BLOCK for i in blocks], pa.int32()), pa.array(data, pa.binary())], schema=_COUNT)


def _sum(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = [unpack(x.as_py()) for x in table["counts"]]
    u, p = (sum(r[i].astype(np.int64) for r in rows) for i in (0, 1))
    return u, p


def _add(table: pa.Table) -> pa.Table:
    return pa.table([table["part"][:1], table["block"][:1], pa.array([pack(list(_sum(table)))], pa.binary())], schema=_COUNT)


def _telling(n_p: int, n_u: int):
    """Of a block of features those whose shares of P and U differ, with the share of U and the spread."""

    def run(table: pa.Table) -> pa.Table:
        u, p = _sum(table)
        share = u / n_u
        spread = np.sqrt(share * (1 - share) + SMOOTH / n_p)
        z = (p / n_p - share) / spread * np.sqrt(n_p)
        at = np.flatnonzero(np.abs(z) > SCREEN * np.log(n_p))
        return pa.table([pa.array(table["block"][0].as_py() * _BLOCK + at, pa.int64()), pa.array(share[at]), pa.array(spread[at]), pa.array(z[at])], names=["feature", "share", "spread", "z"])

    return run


_SETS = pa.schema([("positive", pa.bool_()), ("found", pa.binary()), ("n", pa.int64())])


def _sets(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(features.tolist())}
        read = _Reader(place.keys())
        for batch in batches:
            got: Counter = Counter()
            for (_, t), positive in zip(text_rows(iter([batch])), batch.column("positive").to_pylist(), strict=True):
                got[positive, np.sort(np.fromiter(map(place.__getitem__, read(t)), np.int32)).tobytes()] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.bool_()), pa.array([k[1] for k in got], pa.binary()), pa.array(list(got.values()), pa.int64())], schema=_SETS)

    return run


#: One in the whole numbers that sums are made of; a sum over P or U stays under a few hundred.
_ONE = float(1 << 50)


def _slopes(shared, n_p: int, n_u: int, linear: bool):
    """Sums over a task's rows of P and U, by feature: of sigmoid'(f), or of f itself if ``linear``.  Feature -1
    has them without regard to features, and feature -2 the sums of sigmoid(f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        total = np.zeros((2, len(weights) + 2))
        for batch in batches:
            found = [np.frombuffer(x, np.int32) for x in batch.column("found").to_pylist()]
            lengths = np.array([len(x) for x in found])
            row, col = np.repeat(np.arange(len(found)), lengths), np.concatenate([*found, np.empty(0, np.int32)])
            f = bias + np.bincount(row, weights=weights[col], minlength=len(found))
            s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            slope = f if linear else s * (1 - s)
            positive, n = np.array(batch.column("positive").to_pylist(), bool), np.array(batch.column("n").to_pylist(), float)
            for side, mine, size in ((0, positive, n_p), (1, ~positive, n_u)):
                part = np.where(mine, n / size, 0.0)
                total[side, 2:] += np.bincount(col, weights=(part * slope)[row], minlength=len(weights))
                total[side, :2] += (part * s).sum(), (part * slope).sum()
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at - 2, pa.int64()), *[pa.array(np.rint(total[i, at] * _ONE).astype(np.int64)) for i in (0, 1)]], names=["feature", "p", "u"])

    return run


def _total(sets: DataFrame, weights: np.ndarray, bias: float, n_p: int, n_u: int, linear: bool = False) -> np.ndarray:
    """What ``_slopes`` sums, over all rows: two rows (P, U), columns for -2, -1 and each feature."""
    shared = sets.sparkSession.sparkContext.broadcast((weights, bias))
    out = np.zeros((2, len(weights) + 2))
    for r in sets.mapInArrow(_slopes(shared, n_p, n_u, linear), "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect():
        out[:, r.feature + 2] = r.p / _ONE, r.u / _ONE
    shared.unpersist()
    return out


def fit(total, share: np.ndarray, spread: np.ndarray, z: np.ndarray, n_p: int, prior: float, steps: int = STEPS, nonnegative: bool = True) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative PU risk, by accelerated proximal gradient steps from zero weights.

    ``total(weights, bias, linear)``: sums over P and U (see ``_total``).  The step follows from the
    largest curvature, found by powers of the features' covariance.  ``nonnegative=False`` leaves the
    correction out (for comparison).
    """
    v = z / np.linalg.norm(z)
    curve = 0.0
    for _ in range(4):
        got = total(v / spread, -float(v / spread @ share), True)[1]
        after = (got[2:] - share * got[1]) / spread
        curve = float(np.linalg.norm(after))
        v = after / curve
    step, penalty = 1 / (0.1 * curve * STRETCH), PENALTY * prior * 0.5 / np.sqrt(n_p)
    w, b = np.zeros(len(z)), float(np.log(prior / (1 - prior)))
    at, at_b, turn = w, b, 1.0
    for _ in range(steps):
        scaled = at / spread
        p, u = total(scaled, at_b - float(scaled @ share), False)
        if u[0] - prior * p[0] >= 0 or not nonnegative:
            slope = u[1:] - 2 * prior * p[1:]
        else:
            slope = prior * p[1:] - u[1:]
        new = at - step * (slope[1:] - share * slope[0]) / spread
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = at_b - step * min(curve, 4.0) * slope[0]
        then = (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        at, at_b = new + (turn - 1) / then * (new - w), new_b + (turn - 1) / then * (new_b - b)
        w, b, turn = new, new_b, then
    weights = w / spread
    return weights, b - float(weights @ share)


def train(docs: DataFrame, labels: DataFrame, training: Column, steps: int = STEPS, nonnegative: bool = True) -> Model:
    """``training``: a condition on doc_id; only labels of rows that meet it are ever read."""
    none = np.empty(0, np.int64), np.empty(0), 0.0
    order = F.xxhash64("doc_id", F.lit(11))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & training)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, known = labels.agg(F.sum("toxic"), F.count("*")).first()
    if not toxic:
        return Model(*none, constant=0.0)
    prior = min(max(toxic / known, 1e-4), 0.9)
    docs = keyed(docs).where(training)
    ids = written(labels.where("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(SAMPLE_P), "sample-ids")
    # the ids are SAMPLE_P at most, so they may be broadcast
    p = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInArrow(lean(_near), "doc_id long, text string, near long").dropDuplicates(["near"])
    p = written(p.select("doc_id", "text"), "toxic")
    both = docs.withColumn("positive", F.lit(False)).unionByName(p.withColumn("positive", F.lit(True)))
    n_p, n_u = p.count(), docs.count()
    if not n_p:
        return Model(*none, constant=0.0)
    counts = folded(both.mapInArrow(lean(_counts), _COUNT_SQL), docs, ["block"], _add, _COUNT_SQL)
    chosen = counts.groupBy("block").applyInArrow(_telling(n_p, n_u), "feature long, share double, spread double, z double")
    chosen = np.array(sorted(tuple(r) for r in chosen.collect()), float).reshape(-1, 4)  # SPACE rows at most
    if not len(chosen):
        return Model(*none, constant=prior)
    features, (share, spread, z) = chosen[:, 0].astype(np.int64), chosen[:, 1:].T
    sets = both.mapInArrow(lean(_sets(features)), "positive boolean, found binary, n long").groupBy("positive", "found").agg(F.sum("n").alias("n"))
    sets = written(sets.sortWithinPartitions("positive", "found"), "feature-sets")
    weights, bias = fit(lambda w, b, linear: _total(sets, w, b, n_p, n_u, linear), share, spread, z, n_p, prior, steps, nonnegative)
    release(ids, p, sets)
    return Model(features[weights != 0], weights[weights != 0], bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, a hash of the text (text_key) and score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([of(t) for _, t in text_rows(iter([batch]))], pa.float64())], schema=schema)

    return keyed(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(run), "doc_id long, text_key long, score double")


def held_out() -> Column:
    """Whether a doc_id is kept from training: crc32 of its text modulo 3 is 1 (never for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op9: doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents that score at or above ``threshold``; all columns as they were."""
    model = train(docs, labels, ~held_out())
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t) < threshold for _, t in text_rows(iter([batch]))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
