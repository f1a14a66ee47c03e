"""Document fingerprints: MinHash by universal hash permutations over word shingles.

A fingerprint is the least value of each of ``COUNT`` universal hashes over the distinct five-word shingles of
the lower-cased (A-Z) text, 32 bits each, as hexadecimal.  The likeness of two fingerprints is the share of
equal values, an unbiased estimate of the Jaccard similarity with a standard error of at most 0.5 / sqrt(COUNT).

``compare`` holds every document against an edit of itself and against the next document by doc_id, and gives
its group of similar documents.  The documents are dealt into ranges of doc_id (and, within a doc_id that many rows
have, of a hash of the text) whose bounds come from a summary of all ids; the first document of each range also
goes, as a bystander, to the range before it (of the first, to the last), so each text is shuffled once (compressed)
and only the running row and its successor are in memory.  As ranges are streamed, ``RANGES`` of them are enough
at any size, and bounds and first documents have that bound too.

Similar documents: bands of ``neardup.ROWS`` of the fingerprint's values are joined in Spark, and documents that
share one are confirmed by Jaccard similarity of their full sets (5-word shingles, 0.8), all by ``neardup``'s
joins but on this module's fingerprints.  A group is what links connect.

Defined cases: a null text counts as empty; the fingerprint of a text without words is all ones, alike only to
its own; fewer words than a shingle form one; null doc_ids come before all others; repeated doc_ids are in
order of a hash of the text, and equal rows of one doc_id stay in one range; a single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm import neardup
from tablewarden.llm.common import ascii_lower, keyed, lean, minima, permutations, shingle_set, table_bytes, text_rows, word_hashes, written

WIDTH, COUNT, SEED = 5, 128, 77
#: Bytes of table that one range of documents has about, and the largest number of ranges.
RANGE_BYTES, RANGES = 8 << 20, 1 << 16
_FIRST = -(1 << 63)
#: Values with the highest byte first, as they are shown.
_BIG = np.dtype(">u4")


class Fingerprinter:
    def __init__(self, width: int = WIDTH, count: int = COUNT):
        self.width, self.seeds, self.cache = width, permutations(count, SEED), {}

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The shingle set and the fingerprint."""
        words = ascii_lower(text.encode("utf-8", "surrogatepass")).split()
        shingles = shingle_set(word_hashes(words, self.cache), self.width)
        return shingles, minima(shingles, *self.seeds)

    def __call__(self, text: str) -> np.ndarray:
        return self.read(text)[1]


def shown(signature: np.ndarray) -> str:
    return signature.astype(_BIG).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal values."""
    return float((a == b).mean())


def edit(text: str, other: str) -> str:
    """The last half of ``text`` (rounded down) gives way to as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Fingerprinter()
        for batch in batches:
            rows = [(k, shown(of(t))) for k, t in text_rows(iter([batch]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return keyed(docs).mapInArrow(lean(run), "doc_id long, fingerprint string")


_MARKED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("mark", pa.binary())])
_MARKED_SQL = "doc_id long, text_key long, n_shingles long, h1 long, h2 long, mark binary"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = Fingerprinter()
    for batch in batches:
        rows = []
        for (k, t), key in zip(text_rows(iter([batch])), batch.column("text_key").to_pylist(), strict=True):
            shingles, mark = of.read(t)
            rows.append((k, key, len(shingles), *neardup.set_key(shingles), mark.astype(_BIG).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _MARKED, strict=True)], schema=_MARKED)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [np.frombuffer(m, _BIG).astype(np.uint32) for m in batch.column("mark").to_pylist()]
        batch = batch.drop_columns(["mark"]).append_column("signature", pa.array([neardup.low_bits(m) for m in marks], pa.binary()))
        yield batch.append_column("bands", pa.array([neardup.band_keys(m).tolist() for m in marks], pa.list_(pa.int64())))


def _grouped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (with text_key, n_shingles, h1, h2 and mark) and the group of each."""
    classes = neardup.classes_of(rows, "mark").mapInArrow(_banded, "h1 long, h2 long, least long, key long, n_shingles long, signature binary, bands array<long>")
    return neardup.named(rows, classes, docs, WIDTH, 80, 100)


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the group of similarity 0.8 and more) and class_id (of equal sets) of every row."""
    docs = keyed(docs)
    rows = written(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(_marked), _MARKED_SQL), "marks")
    return _grouped(rows, docs).select("doc_id", "n_shingles", "component_id", "class_id")


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_chars", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("edited_sha256", pa.string()),
    ("mark", pa.binary()), ("edited_mark", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])
_OUT_SQL = "doc_id long, text_key long, n_chars long, n_shingles long, h1 long, h2 long, edited_sha256 string, mark binary, edited_mark binary, near_edited double, near_next double"
_DEALT = pa.schema([("part", pa.int32()), ("own", pa.bool_()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("packed", pa.binary())])


def _ranks(ids: pa.Array) -> np.ndarray:
    return np.array([_FIRST if k is None else k for k in ids.to_pylist()], np.int64)


class _Ranges:
    """Bounds (doc_id, hash of the text), each the last key of its range; a doc_id that cuts repeat is parted by hash."""

    def __init__(self, cuts: list[float]):
        ids, times = np.unique(np.array([int(x) for x in cuts], np.int64), return_counts=True)
        self.ids = np.repeat(ids, times)
        last = (1 << 63) - 1
        self.keys = np.array([last - (1 << 64) * (n - 1 - i) // n for n in times.tolist() for i in range(n)], np.int64)

    def of(self, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.ids, ids, "left"), np.searchsorted(self.ids, ids, "right")
        for i in np.flatnonzero(hi - lo > 1):
            lo[i] += np.searchsorted(self.keys[lo[i] : hi[i]], keys[i], "left")
        return lo


def _least(bounds: _Ranges):
    """The least key of each range, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _ranks(batch.column("doc_id")), np.array(batch.column("text_key").to_pylist(), np.int64)
            order = np.lexsort((keys, ids))
            ids, keys = ids[order], keys[order]
            part, first = np.unique(bounds.of(ids, keys), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ids[first]), pa.array(keys[first])], names=["part", "id", "key"])

    return run


def _deal(bounds: _Ranges, guests: dict[tuple[int, int], int]):
    """Compressed texts with their range; rows of a range's least key go to the range before it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows: list[tuple] = []
            rank, keys = _ranks(batch.column("doc_id")), batch.column("text_key").to_pylist()
            part = bounds.of(rank, np.array(keys, np.int64)).tolist()
            for (k, t), key, p, r in zip(text_rows(iter([batch])), keys, part, rank.tolist(), strict=True):
                packed = z.compress(t.encode("utf-8", "surrogatepass"))
                rows.append((p, True, k, key, packed))
                if (r, key) in guests:
                    rows.append((guests[r, key], False, k, key, packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _DEALT, strict=True)], schema=_DEALT)

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, then doc_id, then text; bystanders come last, and the first of them counts."""
    of, z = Fingerprinter(), zstandard.ZstdDecompressor()
    held: tuple | None = None
    for batch in batches:
        rows: list[tuple] = []
        for k, key, part, own, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "part", "own")), batch.column("packed"), strict=True):
            text = z.decompress(packed.as_py()).decode("utf-8", "surrogatepass")
            shingles, mark = of.read(text)
            if held is not None and held[0] == part:
                _, before, said, mine, n, old = held
                changed = edit(mine, text)
                edited = of(changed)
                rows.append((*before, len(mine), n, *said, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), old.astype(_BIG).tobytes(), edited.astype(_BIG).tobytes(), likeness(old, edited), likeness(old, mark)))
            held = (part, (k, key), neardup.set_key(shingles), text, len(shingles), mark) if own else None
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)


def compare(docs: DataFrame) -> DataFrame:
    """op10's columns for every row of ``docs``, and component_id and class_id as ``similar`` has them."""
    docs = keyed(docs)
    spark = docs.sparkSession
    ranges = int(min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), table_bytes(docs) // RANGE_BYTES, 1)))
    ids = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).cast("double").alias("id"))
    # a summary of all ids whose size depends on the number of ranges alone; so does what else the driver gets
    cuts = ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = _Ranges(cuts)
    hashed = docs.withColumn("text_key", F.xxhash64("text"))
    firsts = hashed.select("doc_id", "text_key").mapInArrow(lean(_least(bounds)), "part int, id long, key long").groupBy("part").agg(F.min(F.struct("id", "key")).alias("least"))
    firsts = sorted((r.part, (r.least.id, r.least.key)) for r in firsts.collect())
    guests = {least: firsts[i - 1][0] for i, (_, least) in enumerate(firsts)}
    dealt = hashed.mapInArrow(lean(_deal(bounds, guests)), "part int, own boolean, doc_id long, text_key long, packed binary")
    dealt = dealt.repartitionById(ranges, F.col("part"))
    order = ["part", F.desc("own"), F.asc_nulls_first("doc_id"), "text_key"]
    rows = written(dealt.sortWithinPartitions(*order).mapInArrow(lean(_compare), _OUT_SQL), "compared")
    out = _grouped(rows, docs)
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("mark")).alias("fingerprint"), F.lower(F.hex("edited_mark")).alias("edited_fingerprint"), "near_edited", "near_next", "component_id", "class_id")
