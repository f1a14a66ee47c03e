"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

A token's probability is P(class | context) * P(slot | class, context) * P(token | class, slot).  A word's last
letters hash to one of ``SUFFIXES`` groups; groups that keep the same company are clustered into classes, and those
of a class into its slots: Spark counts which groups follow which in the training documents (a table of fixed
size), and the driver factors and clusters it.  The first two factors are maximum-entropy models over hashed features
of the context: the word before, the word before that (skip one), the kinds before and the kinds with a skip;
in the second each is joined with the class.  P(token | class, slot) comes from the counts of all training
tokens with one added to each, one share being kept for unknown tokens, so the probabilities of a context sum to one.

Training: in each of ``ROUNDS`` rounds, over a part of the training documents of its own, every task runs
gradient steps (AdaGrad by feature row) from the shared weights; Spark averages the tasks' weights by block of
rows, weighted by how often each row was met, in a tree.  The feature rows grow with the corpus, a row for each
``ROW_BYTES`` of it, to ``MOST_ROWS`` (16 MB of weights), so that the weights may be broadcast.  Counts grow
with the corpus without a bound: mappers send each chunk's distinct tokens packed by hash bucket, with the documents
that hold them; a bucket's reducer adds up the counts and answers with sums for each document of each chunk.
Nothing that grows with the corpus reaches the driver.

Defined cases: a null text counts as empty and is its end token alone; a null doc_id is a training document;
repeated rows are repeated (and count in training as often); without training documents every count is 0;
other columns are ignored; an empty table gives no rows.  Tokens are told apart by 54-bit hashes and
the group of their last letters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import CHUNK_WORDS, FAN, ascii_lower, bucket_count, folded, keyed, lean, least_uint, mix, pack, table_bytes, text_rows, unpack, written

CLASSES, SLOTS, SUFFIXES, BLOCK, ROUNDS, RATE = 16, 16, 1024, 64, 2, 0.4
#: Feature rows of each factor: the least, the most, and bytes of table for each.
LEAST_ROWS, MOST_ROWS, ROW_BYTES = 1 << 14, 1 << 17, 1 << 15
_END = 0  # group 0 and class 0 are the end's own
_PAIR_BLOCK = 16
_PUNCTUATION = b".,;:!?%&*$#|\"'()"


def held_out() -> Column:
    """Whether a doc_id is kept from training: crc32 of its text modulo 7 is 2 (never for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


class Reader:
    """Token hashes of a text, the end token last; the low ten bits are the group of its last letters."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        out = []
        add = out.append
        for w in ascii_lower(text.encode("utf-8", "surrogatepass")).split():
            token = known.get(w)
            if token is None:
                if len(known) > 100_000:
                    known.clear()
                group = 1 + zlib.crc32(w.rstrip(_PUNCTUATION)[-3:]) % (SUFFIXES - 1)
                token = known[w] = xxhash.xxh3_64_intdigest(w) & -SUFFIXES | group
            add(token)
        add(_END)
        return np.array(out, np.uint64)


def groups_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(SUFFIXES - 1)).astype(np.int64)


def _cluster(points: np.ndarray, weight: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """Weighted k-means, started from points far apart."""
    centers = [points[weight.argmax()]]
    nearest = ((points - centers[0]) ** 2).sum(axis=1)
    for _ in range(min(k, len(points)) - 1):
        centers.append(points[(nearest * weight).argmax()])
        nearest = np.minimum(nearest, ((points - centers[-1]) ** 2).sum(axis=1))
    middle = np.array(centers)
    for _ in range(rounds):
        of = ((points[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        for j in range(len(middle)):
            if (mine := weight * (of == j)).any():
                middle[j] = (points * mine[:, None]).sum(axis=0) / mine.sum()
    return of


def induce(pairs: np.ndarray, size: int = 12) -> np.ndarray:
    """The kind (class * SLOTS + slot) of each group, by the leading factors of its neighbours' frequencies."""
    near = np.hstack([pairs, pairs.T]).astype(float)
    total = near.sum(axis=1)
    share = np.sqrt(near / np.maximum(total, 1)[:, None]) / np.sqrt(np.sqrt((near.sum(axis=0) + 1e-9) / max(near.sum(), 1)))
    share[total < 5] = 0
    values, vectors = np.linalg.eigh(share @ share.T)
    points = vectors[:, -size:] * np.sqrt(np.maximum(values[-size:], 0))
    weight = np.sqrt(total)
    weight[_END] = 0
    of = 1 + _cluster(points, weight, CLASSES - 1)
    of[_END] = 0
    kinds = of * SLOTS
    for c in range(1, CLASSES):
        if (mine := np.flatnonzero(of == c)).size:
            kinds[mine] += _cluster(points[mine], weight[mine], SLOTS)
    return kinds


_START = np.full(3, 1 << 40, np.uint64)


def features(padded: np.ndarray, kinds: np.ndarray, n_rows: int) -> np.ndarray:
    """Rows of the weights of both factors (four each) for every token but the first three, from the three tokens before it and their kinds."""
    one, two = padded[2:-1], padded[1:-2]
    kinds = kinds.astype(np.uint64)
    k1, k2, c2, c3, mine = kinds[2:-1], kinds[1:-2], kinds[1:-2] // np.uint64(SLOTS), kinds[:-3] // np.uint64(SLOTS), kinds[3:] // np.uint64(SLOTS)
    wide, shift = np.uint64(CLASSES * SLOTS), np.uint64(64 - n_rows.bit_length() + 1)
    with np.errstate(over="ignore"):
        context = (one + np.uint64(1), k1 * wide + c2 + np.uint64(1 << 50), two + np.uint64(3), c2 * wide + c3 + np.uint64(1 << 51))
        inside = (one + np.uint64(5), k1 * wide + c2 + np.uint64(1 << 52), two + np.uint64(7), k2 + np.uint64(1 << 53))
        inside = [k + (mine + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) for k in inside]
        return np.stack([((k * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64) for k in (*context, *inside)])


@dataclass
class Model:
    """Weights of both factors (2 x rows x columns), the kind of each group, and the log10 size of each kind."""

    rows: np.ndarray
    kinds: np.ndarray
    spare: np.ndarray | None = None

    @property
    def allowed(self) -> np.ndarray:
        """The slots that each class has."""
        out = np.zeros((CLASSES, SLOTS), bool)
        out.flat[np.unique(self.kinds)] = True
        return out


def _batches(docs: Iterator[np.ndarray], kinds: np.ndarray, n_rows: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, kinds, document lengths) of about ``size`` tokens at a time."""

    def made(held: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        padded = np.concatenate([x for t in held for x in (_START, t)])
        # where a document's own tokens stand, behind its three starting ones
        at = np.arange(lengths.sum()) + np.repeat(3 * np.arange(len(lengths)), lengths)
        of = kinds[groups_of(padded)]
        return features(padded, of, n_rows)[:, at], of[3:][at], lengths

    held: list[np.ndarray] = []
    n = 0
    for tokens in docs:
        held.append(tokens)
        n += len(tokens)
        if n >= size:
            yield made(held, np.array([len(t) for t in held]))
            held, n = [], 0
    if held:
        yield made(held, np.array([len(t) for t in held]))


class Weights:
    """Feature rows of both factors, with what AdaGrad has gathered and how often each row was met."""

    def __init__(self, model: Model):
        self.rows = model.rows.copy()
        self.gathered = np.full(model.rows.shape[:2], 1e-3, np.float32)
        self.met = np.zeros(model.rows.shape[:2], np.float32)
        self.closed = np.where(model.allowed, 0, -1e9).astype(np.float32)

    def scores(self, factor: int, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Scores of the classes (factor 0), or of the slots of each token's class (factor 1); never so large that exp would overflow."""
        rows, at = self.rows[factor], at[4 * factor : 4 * factor + 4]
        out = rows.take(at[0], axis=0)
        for x in at[1:]:
            out += rows.take(x, axis=0)
        np.minimum(out, 60, out=out)
        return out if factor == 0 else out + self.closed.take(kinds // SLOTS, axis=0)

    def score(self, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Natural log of P(class | context) * P(slot | class, context) of each token."""
        n, total = np.arange(len(kinds)), np.zeros(len(kinds), np.float32)
        for factor, target in ((0, kinds // SLOTS), (1, kinds % SLOTS)):
            out = self.scores(factor, at, kinds)
            total += out[n, target] - np.log(np.exp(out).sum(axis=1))
        return total

    def learn(self, at: np.ndarray, kinds: np.ndarray) -> None:
        n = len(kinds)
        small = np.uint16 if self.rows.shape[1] <= 1 << 16 else np.uint32
        for factor, target in ((0, kinds // SLOTS), (1, kinds % SLOTS)):
            slope = np.exp(self.scores(factor, at, kinds))
            slope /= slope.sum(axis=1, keepdims=True)
            slope[np.arange(n), target] -= 1
            flat = at[4 * factor : 4 * factor + 4].ravel()
            order = np.argsort(flat.astype(small), kind="stable")
            ordered = flat.take(order)
            start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            rows, times = ordered[start], np.diff(np.append(start, len(ordered))).astype(np.float32)
            gradient = np.add.reduceat(slope.take(order % n, axis=0), start, axis=0) / times[:, None]
            self.gathered[factor, rows] += (gradient**2).mean(axis=1)
            self.rows[factor, rows] -= RATE * gradient / np.sqrt(self.gathered[factor, rows])[:, None] / 4
            self.met[factor, rows] += times


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("data", pa.binary())])
_BLOCK_SQL = "part int, block int, data binary"


def _trainer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights, read = Weights(model), Reader()
        for at, kinds, _ in _batches((read(t) for _, t in text_rows(batches)), model.kinds, model.rows.shape[1], 32_768):
            for i in range(0, len(kinds), 4096):
                weights.learn(at[:, i : i + 4096], kinds[i : i + 4096])
        met, rows, before = weights.met.reshape(-1, BLOCK), weights.rows.reshape(-1, BLOCK, SLOTS), model.rows.reshape(-1, BLOCK, SLOTS)
        blocks = np.flatnonzero(met.any(axis=1))
        # what changed, weighted by how often a row was met, so that sums of sums can be averaged
        data = [pack([met[i].astype(np.float64), ((rows[i] - before[i]) * met[i][:, None]).ravel()]) for i in blocks]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(data, pa.binary())], schema=_BLOCK)

    return run


def _add(table: pa.Table) -> pa.Table:
    """Blocks of one part, added up array by array."""
    sums = [sum(x) for x in zip(*(unpack(x.as_py()) for x in table["data"]), strict=True)]
    return pa.table([table["part"][:1], table["block"][:1], pa.array([pack(sums)], pa.binary())], schema=_BLOCK)


def train(docs: DataFrame, kinds: np.ndarray) -> Model:
    """Weights from all rows of ``docs``, each of which takes part in one round."""
    docs = keyed(docs)
    n_rows = 1 << int(np.clip(table_bytes(docs) // ROW_BYTES, LEAST_ROWS, MOST_ROWS)).bit_length() - 1
    rows = np.zeros((2, n_rows, SLOTS), np.float32)
    turn = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(ROUNDS))
    for r in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(Model(rows, kinds))
        blocks = folded(docs.where(turn == r).mapInArrow(lean(_trainer(shared)), _BLOCK_SQL), docs, ["block"], _add, _BLOCK_SQL)
        blocks = blocks.groupBy("block").applyInArrow(_add, _BLOCK_SQL)
        rows = rows.copy()
        flat = rows.reshape(-1, BLOCK, SLOTS)
        for b in blocks.collect():  # a bounded number of rows of a fixed size
            met, change = unpack(b.data)
            flat[b.block] += (change.reshape(BLOCK, SLOTS) / (met + 1e-6)[:, None]).astype(np.float32)
        shared.unpersist()
    return Model(rows, kinds)


_ROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("suffix", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), ("data", pa.binary())])
_ROW_SQL = "bucket long, kind int, chunk long, suffix int, n long, v long, data binary"
_TOKENS, _SUMS, _STATS, _DOCS, _PAIRS = 0, 1, 2, 3, 4


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW, strict=True)], schema=_ROW)


def _chunk(chunk: int, held: list[tuple], buckets: int) -> Iterator[tuple]:
    lengths = np.array([len(h[4]) for h in held])
    tokens = np.concatenate([h[4] for h in held])
    doc = np.repeat(np.arange(len(held)), lengths)
    known, place = np.unique(tokens, return_inverse=True)
    counts = np.bincount(place, weights=np.array([h[3] for h in held], float)[doc], minlength=len(known)).astype(np.int64)
    pairs, times = np.unique(place * len(held) + doc, return_counts=True)
    of, doc = np.divmod(pairs, len(held))
    begin = np.searchsorted(of, np.arange(len(known) + 1))
    data = pack([np.array([h[0] or 0 for h in held], np.int64), np.array([h[0] is None for h in held]), np.array([h[1] for h in held], np.int64), lengths.astype(np.int64)])
    yield chunk % buckets, _DOCS, chunk, None, None, None, data
    spread = (mix(known) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(spread, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(spread[order])) + 1):
        sizes = begin[part + 1] - begin[part]
        at = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        data = pack([known[part], least_uint(counts[part]), least_uint(sizes), least_uint(doc[at]), least_uint(times[at])])
        yield int(spread[part[0]]), _TOKENS, chunk, None, None, None, data


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        chunk = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        words = 0
        follow = np.zeros(SUFFIXES * SUFFIXES, np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            learned = [h[4] for h in held if h[3]]
            if learned:
                # an end comes before every first word, as a document's start does
                groups = groups_of(np.concatenate([[np.uint64(_END)], *learned]))
                np.add(follow, np.bincount(groups[:-1] * SUFFIXES + groups[1:], minlength=len(follow)), out=follow)
            for r in _chunk(chunk, held, buckets) if held else ():
                rows.append(r)
                if len(rows) >= 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        for batch in batches:
            keys, training = batch.column("text_key").to_pylist(), batch.column("training").to_pylist()
            for (k, t), key, learn in zip(text_rows(iter([batch])), keys, training, strict=True):
                held.append((k, key, None, learn, read(t)))
                words += len(held[-1][4])
                if words >= CHUNK_WORDS:
                    yield from sent()
                    held, words = [], 0
                    chunk += 1
        yield from sent()
        if follow.any():
            rows = follow.reshape(-1, _PAIR_BLOCK * SUFFIXES)
            # of ``FAN`` tasks together: no group has a row of every task
            part = TaskContext.get().partitionId() // FAN
            yield _batch([(-1 - i - part * len(rows), _PAIRS, i, part, None, None, pack([least_uint(r)])) for i, r in enumerate(rows)])

    return run


def _adder(table: pa.Table) -> pa.Table:
    """A bucket's counts, and for each document of each chunk sums over the bucket's tokens."""
    rows: list[tuple] = []
    parts = []
    pairs: dict[tuple[int, int], np.ndarray] = {}
    for bucket, kind, chunk, part, data in zip(*(table[c].to_pylist() for c in ("bucket", "kind", "chunk", "suffix", "data")), strict=True):
        if kind == _DOCS:
            rows.append((bucket, kind, chunk, None, None, None, data))
        elif kind == _PAIRS:
            pairs[chunk, part] = pairs.get((chunk, part), 0) + unpack(data)[0].astype(np.int64)
        else:
            parts.append((chunk, unpack(data)))
    if parts:
        tokens, place = np.unique(np.concatenate([p[0] for _, p in parts]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([p[1] for _, p in parts]).astype(float), minlength=len(tokens))
        groups = groups_of(tokens)
        n, v = (np.bincount(groups, weights=w, minlength=SUFFIXES).astype(np.int64) for w in (counts, counts > 0))
        rows += [(-1, _STATS, None, k, int(n[k]), int(v[k]), None) for k in range(SUFFIXES) if v[k]]
        worth = np.log10(counts + 1)
        at = 0
        for chunk, (own, _, sizes, doc, times) in parts:
            mine = np.repeat(place[at : at + len(own)], sizes)
            at += len(own)
            docs, where = np.unique(doc, return_inverse=True)
            total = np.bincount(where, weights=worth[mine] * times)
            known = np.bincount(where, weights=(counts[mine] > 0) * times).astype(np.int64)
            rows.append((-1, _SUMS, chunk, None, None, None, pack([least_uint(docs), total, least_uint(known)])))
    rows += [(-1, _PAIRS, i, part, None, None, pack([r])) for (i, part), r in pairs.items()]
    return pa.Table.from_batches([_batch(rows)] if rows else [], _ROW)


_BASE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64())])
_BASE_SQL = "doc_id long, text_key long, n_tokens long, n_known long, log_counts double"


def _gather(table: pa.Table) -> pa.Table:
    """A chunk's documents with their sums over all buckets."""
    kinds = table["kind"].to_pylist()
    ids, blank, keys, lengths = unpack(table["data"][kinds.index(_DOCS)].as_py())
    total, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for kind, data in zip(kinds, table["data"], strict=True):
        if kind == _SUMS:
            docs, part, seen = unpack(data.as_py())
            total[docs] += part
            known[docs] += seen.astype(np.int64)
    return pa.table([pa.array(ids, mask=blank), pa.array(keys), pa.array(lengths), pa.array(known), pa.array(total)], schema=_BASE)


def counts(docs: DataFrame, training: Column) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """For each row its tokens, known tokens and sum of log10(count + 1); tokens and types by group of last
    letters; and how often groups follow each other.  The last three have fixed sizes."""
    docs = keyed(docs)
    mapped = docs.withColumn("text_key", F.xxhash64("text")).withColumn("training", training).mapInArrow(lean(_counter(bucket_count(docs))), _ROW_SQL)
    table = written(mapped.groupBy("bucket").applyInArrow(_adder, _ROW_SQL), "counts")
    n, v = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in table.where(f"kind = {_STATS}").groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r.suffix], v[r.suffix] = r.n, r.v
    follow = np.zeros((SUFFIXES // _PAIR_BLOCK, _PAIR_BLOCK * SUFFIXES), np.int64)
    pairs = table.where(f"kind = {_PAIRS}").select(F.col("suffix").alias("part"), F.col("chunk").cast("int").alias("block"), "data")
    for r in folded(pairs, docs, ["block"], _add, _BLOCK_SQL).groupBy("block").applyInArrow(_add, _BLOCK_SQL).collect():
        follow[r.block] = unpack(r.data)[0]
    base = table.where(f"kind IN ({_SUMS}, {_DOCS})").groupBy("chunk").applyInArrow(_gather, _BASE_SQL)
    return base, n, v, follow.reshape(SUFFIXES, SUFFIXES)


_SCORE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("class_score", pa.float64())])


def _scorer(shared):
    """Sum over a document's tokens of log10 P(class, slot | context) less the log10 size of the kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights, read = Weights(model), Reader()
        for batch in batches:
            sums = []
            for at, kinds, lengths in _batches((read(t) for _, t in text_rows(iter([batch]))), model.kinds, model.rows.shape[1], 65_536):
                logs = np.empty(len(kinds))
                for i in range(0, len(kinds), 4096):
                    logs[i : i + 4096] = weights.score(at[:, i : i + 4096], kinds[i : i + 4096])
                sums.append(np.add.reduceat(logs / np.log(10) - model.spare[kinds], np.cumsum(lengths) - lengths))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(np.concatenate(sums) if sums else [], pa.float64())], schema=_SCORE)

    return run


def fit(docs: DataFrame, training: Column) -> tuple[DataFrame, int, int, Model]:
    """The base columns of every row, training tokens and types, and the trained model."""
    docs = keyed(docs)
    base, n, v, follow = counts(docs, training)
    model = train(docs.where(training), induce(follow))
    model.spare = np.log10(np.bincount(model.kinds, weights=n + v, minlength=CLASSES * SLOTS) + 1.0)
    return base, int(n.sum()), int(v.sum()), model


def score(docs: DataFrame, training: Column) -> DataFrame:
    """op1's columns for every row: token counts, the unigram base and the model's log10 probability."""
    docs = keyed(docs)
    base, total, types, model = fit(docs, training)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(_scorer(shared)), "doc_id long, text_key long, class_score double")
    scored = scored.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.first("class_score").alias("class_score"))
    out = base.join(scored, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return out.select(
        "doc_id", (~training).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(total + types + 1)))).alias("base_score"), (F.col("log_counts") + F.col("class_score")).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """op1: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(docs, ~held_out())
