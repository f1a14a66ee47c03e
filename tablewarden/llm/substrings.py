"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A window is ``width`` consecutive words of one document.  It is *repeated* where its word sequence also
starts in a document with a smaller doc_id; every word that a repeated window covers is removed, and
overlapping repeated windows merge into maximal removal intervals.

Plan: mappers hash all windows of a chunk of documents.  Whether a window is repeated depends on its hash and
its document's doc_id alone, so a chunk sends each distinct hash once, with its least doc_id of the chunk,
packed by hash bucket; what repeats inside the chunk is settled there.  A bucket's reducer finds the least
doc_id of each hash and flags it for larger documents.  Flags (document, hash) are written, then met with the
(compressed) texts, whose windows are hashed again and looked up among the document's flagged hashes.
A window that a third of all documents share therefore costs one entry a chunk.

A document is told by its doc_id and a hash of its text (a unit), so that rows of one doc_id, or all rows
without one, spread over tasks; equal rows of a batch travel as one with their number.

Defined cases: a null text has no words; a null doc_id counts as larger than every other, and several rows
of one doc_id don't make each other's windows repeated; fewer words than ``width`` have no window; an empty
table gives no rows.  Other columns of the input are ignored.  Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import CHUNK_WORDS, bucket_count, keyed, lean, least_uint, mix, pack, rolling, text_rows, unpack, word_hashes, written

_LAST = (1 << 63) - 1
_ROWS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("copies", pa.int64()), ("data", pa.binary())])
_ROWS_SQL = "bucket long, kind int, doc_id long, copies long, data binary"
_ENTRIES, _FLAGS, _TEXT = 0, 1, 2
#: A unit: doc_id (null as the largest) and a hash of the text.
_UNIT = np.dtype([("doc", np.int64), ("mark", np.uint64)])


def _unit(k: int | None, data: bytes) -> tuple[int, int]:
    return _LAST if k is None else k, xxhash.xxh3_64_intdigest(data) >> 32


def _packed(units: np.ndarray, of: np.ndarray, hashes: np.ndarray) -> bytes:
    """Hashes in order of their units (``of`` ascends), and how many each unit has."""
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    there = units[of[begin]]
    return pack([there["doc"], there["mark"].astype(np.uint32), least_uint(np.diff(np.append(begin, len(of)))), hashes])


def _unpacked(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All units, the unit of each hash, and the hashes."""
    rows = [unpack(p) for p in parts]
    doc, mark, sizes, hashes = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    units = np.empty(len(doc), _UNIT)
    units["doc"], units["mark"] = doc, mark
    return units, np.repeat(np.arange(len(doc)), sizes.astype(np.int64)), hashes


def _split(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each remainder of ``keys`` by ``n`` that occurs, the places that have it, in order."""
    rest = (keys % np.uint64(n)).astype(np.int64)
    order = np.argsort(rest, kind="stable")
    cuts = np.flatnonzero(np.diff(rest[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(rest[part[0]]), part


def _group_of(units: np.ndarray) -> np.ndarray:
    return mix(units["doc"].astype(np.uint64) ^ (units["mark"] << np.uint64(24)))


def _flag_rows(units: np.ndarray, of: np.ndarray, hashes: np.ndarray, groups: int) -> Iterator[tuple]:
    order = np.argsort(of, kind="stable")
    of, hashes = of[order], hashes[order]
    for group, part in _split(_group_of(units)[of], groups):
        yield group, _FLAGS, None, None, _packed(units, of[part], hashes[part])


def _chunk_rows(docs: list[tuple[tuple[int, int], np.ndarray]], width: int, buckets: int) -> Iterator[tuple]:
    docs = sorted(((u, h) for u, h in docs if len(h) >= width), key=lambda x: x[0])
    if not docs:
        return
    lengths = np.array([len(h) for _, h in docs])
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(docs)), lengths)
    pos = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    valid = pos <= np.repeat(lengths, lengths) - width
    hashes = rolling(np.concatenate([h for _, h in docs]), width)[np.flatnonzero(valid)]
    units, unit_of = np.unique(np.array([u for u, _ in docs], _UNIT), return_inverse=True)
    of = unit_of[row[valid]]
    # by hash, then unit; of a unit's equal windows one is enough
    order = np.argsort(hashes, kind="stable")
    ordered, mine = hashes[order], of[order]
    start = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    once = start | np.concatenate([[True], mine[1:] != mine[:-1]])
    doc = units["doc"][mine]
    late = doc > doc[np.flatnonzero(start)][np.cumsum(start) - 1]
    if (again := late & once).any():
        yield from _flag_rows(units, mine[again], ordered[again], buckets)
    first = np.flatnonzero(~late & once)
    first = first[np.argsort(mine[first], kind="stable")]
    for bucket, part in _split(ordered[first] >> np.uint64(20), buckets):
        part = first[part]
        yield bucket, _ENTRIES, None, None, _packed(units, mine[part], ordered[part])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS, strict=True)], schema=_ROWS)


def _mapper(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}

        def sent(held: list) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for r in _chunk_rows(held, width, buckets):
                rows.append(r)
                if len(rows) >= 64:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

        held: list = []
        words = 0
        for k, t in text_rows(batches):
            data = t.encode("utf-8", "surrogatepass")
            h = word_hashes(data.split(), cache)
            held.append((_unit(k, data), h))
            words += len(h)
            if words >= CHUNK_WORDS:
                yield from sent(held)
                held, words = [], 0
        yield from sent(held)

    return run


def _reducer(groups: int):
    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        parts = []
        for bucket, kind, data in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["data"], strict=True):
            if kind == _FLAGS:
                rows.append((bucket, kind, None, None, data.as_py()))
            else:
                parts.append(data.as_py())
        if parts:
            units, of, hashes = _unpacked(parts)
            order = np.argsort(hashes)
            ordered, of = hashes[order], of[order]
            start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            doc = units["doc"][of]
            late = doc > np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(doc))))
            if late.any():
                rows += _flag_rows(units, of[late], ordered[late], groups)
        return pa.Table.from_batches([_batch(rows)] if rows else [], _ROWS)

    return run


def _compressed(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = []
            for (k, t), n in Counter(text_rows(iter([batch]))).items():
                data = t.encode("utf-8", "surrogatepass")
                group = int(_group_of(np.array([_unit(k, data)], _UNIT))[0] % np.uint64(groups))
                rows.append((group, _TEXT, k, n, z.compress(data)))
            if rows:
                yield _batch(rows)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_text", pa.string()), ("copies", pa.int64())])


def _finisher(width: int):
    def run(table: pa.Table) -> pa.Table:
        cache: dict[bytes, int] = {}
        z = zstandard.ZstdDecompressor()
        kinds = table["kind"].to_pylist()
        units, of, hashes = _unpacked([d.as_py() for k, d in zip(kinds, table["data"], strict=True) if k == _FLAGS])
        known, place = np.unique(units, return_inverse=True)
        of = place[of] if len(of) else of
        order = np.argsort(of, kind="stable")
        of, hashes = of[order], hashes[order]
        at = {u: i for i, u in enumerate(known.tolist())}
        out: list[tuple] = []
        for kind, k, copies, data in zip(kinds, table["doc_id"].to_pylist(), table["copies"].to_pylist(), table["data"], strict=True):
            if kind != _TEXT:
                continue
            text = z.decompress(data.as_py())
            words = text.split()
            keep = np.ones(len(words), bool)
            i = at.get(_unit(k, text))
            if i is not None:
                lo, hi = np.searchsorted(of, [i, i + 1])
                repeated = np.flatnonzero(np.isin(rolling(word_hashes(words, cache), width), hashes[lo:hi]))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, repeated, 1)
                np.add.at(edge, repeated + width, -1)
                keep = np.cumsum(edge[:-1]) == 0
            turn = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
            kept = b" ".join(w for w, y in zip(words, keep.tolist(), strict=True) if y)
            out.append((k, len(words), int(len(words) - keep.sum()), turn[::2].tolist(), turn[1::2].tolist(), kept.decode("utf-8", "replace"), copies))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT, strict=True)], schema=_OUT) if out else _OUT.empty_table()

    return run


def dedup_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removal intervals (``starts`` and ``ends`` in words,
    end exclusive) and ``kept_text``, the kept words joined by one space."""
    docs = keyed(docs)
    n = bucket_count(docs)  # of windows by hash, and of documents by unit
    found = docs.mapInArrow(lean(_mapper(width, n)), _ROWS_SQL).groupBy("bucket").applyInArrow(_reducer(n), _ROWS_SQL)
    flags = written(found, "repeats")
    texts = docs.mapInArrow(lean(_compressed(n)), _ROWS_SQL)
    schema = "doc_id long, n_words long, n_removed long, starts array<long>, ends array<long>, kept_text string, copies long"
    out = flags.unionByName(texts).groupBy("bucket").applyInArrow(_finisher(width), schema)
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def removal_intervals(docs: DataFrame, width: int = 13) -> DataFrame:
    """The maximal removal intervals alone: doc_id, start_word, end_word (exclusive)."""
    return dedup_substrings(docs, width).select("doc_id", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("doc_id", F.col("x.starts").alias("start_word"), F.col("x.ends").alias("end_word"))


def digest(docs: DataFrame) -> DataFrame:
    """op2: doc_id, n_words, n_removed, kept_sha256."""
    out = dedup_substrings(docs, 13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("starts").cast("long").alias("n_intervals"))
