"""Near-duplicate detection with b-bit MinHash.

A document's set is its distinct word shingles; two documents are linked when the Jaccard similarity of
their sets reaches the threshold, and a group is what links connect.

1.  Each document gets ``BANDS * ROWS`` minima, of which the low ``BITS`` bits are packed as its signature
    and each band of full minima is hashed as a bucket.  Documents of equal sets form one class, which goes
    on under a number of its own (rep) with the text of one of its rows, so exact copies cost nothing further.
2.  In each bucket of two or more classes, similarity is estimated from bit counts of the packed
    signatures, corrected for chance collisions; the cut lies 5.5 standard errors below the
    threshold.  A class goes with its least neighbour (its hub), where full sets confirm links by counting
    shared shingles through postings.  A set travels once for this, and components of the links are taken.
3.  What is left are estimated pairs in different components.  Buckets that hold several components are read
    again, and of each such pair, in its first common bucket alone and if the sizes of both sets allow a link,
    one class visits the other's block, where full sets decide.  Blocks are parts of a large component, or of
    all small ones that estimates connect; the smaller side visits.  So a set travels once at home and once
    for each foreign block with a doubtful neighbour, and what links have joined costs nothing further.
    At 32 bands of 4 rows a pair at similarity 0.8 shares no bucket with probability 5e-8.
4.  Components of the confirmed links give each class, and so each document, its group.

Buckets and hubs of any size are split into blocks; a task holds two blocks, and all pairs of blocks are
visited, so nothing is capped.  Pairs are never rows, but for a spanning forest of each two blocks.

Defined cases: a null text counts as empty; a text without words has an empty set, is linked with nothing
and is its own group; fewer words than the shingle width form one shingle.  A group is named by its least
doc_id, and by null only if it has none; groups that share a name (null or repeated ids) stay apart.  All rows
that bear their group's name are marked as kept in the result, of which ``dedup`` keeps one.  Repeated rows are
repeated in the result.  Other input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import ascii_lower, keyed, lean, lean_groups, minima, mix, permutations, release, set_aside, shingle_set, table_bytes, text_rows, word_hashes, written
from tablewarden.llm.components import components

BANDS, ROWS, BITS, SEED = 32, 4, 4, 20240607
#: Classes in a block of a bucket, and classes that meet with their sets.
BUCKET_BLOCK, SET_BLOCK = 512, 128
#: Files of the ids and hashes of texts that are wanted, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20

_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
_SIGNATURE_SQL = "doc_id long, text_key long, n_shingles long, h1 long, h2 long, signature binary, bands array<long>"


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(BANDS * ROWS, SEED)
        cache: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for (k, t), same in zip(text_rows(iter([batch])), batch.column("text_key").to_pylist(), strict=True):
                s = shingle_set(word_hashes(ascii_lower(t.encode("utf-8", "surrogatepass")).split(), cache), width)
                if len(s) == 0:
                    rows.append((k, same, 0, 0, 0, b"", []))
                    continue
                m = minima(s, a, b)
                rows.append((k, same, len(s), *set_key(s), low_bits(m), band_keys(m).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _SIGNATURE, strict=True)], schema=_SIGNATURE)

    return run


def _blocks(members: DataFrame, size: DataFrame, block: int) -> DataFrame:
    """Rows of ``members`` (bucket, rep) with the blocks (lo, hi) that they are to meet in, and their own.

    ``size``: bucket and its number of members ``c``.  Within a block pairs meet where lo = hi, and nowhere else.
    """
    n = F.ceil(F.col("c") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(7), "rep"), n).cast("int")
    out = members.join(size, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "c")


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_NIBBLE = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=_EDGE)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature to others, from counts of equal 4-bit values, corrected for chance."""
    equal = _NIBBLE[one[None, :] ^ many].sum(axis=1, dtype=np.int64) / (BANDS * ROWS)
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of blocks: order of rows by rep, reps, signatures, and the side that each row meets (its own block if there is but one)."""
    reps, own = (np.array(table[c].to_pylist(), np.int64) for c in ("rep", "own"))
    sigs = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(reps), -1)
    order = np.argsort(reps)
    reps, sigs, own = reps[order], sigs[order], own[order]
    return order, reps, sigs, np.stack([own, np.where(table["lo"][0].as_py() == table["hi"][0].as_py(), own, table["lo"][0].as_py() + table["hi"][0].as_py() - own)])


def least_estimate(num: int, den: int) -> float:
    """The estimate from which a pair is looked at: 5.5 standard errors below the threshold."""
    sigma = (num / den * (1 - num / den) / (BANDS * ROWS)) ** 0.5 / (1 - 2.0**-BITS)
    return num / den - 5.5 * sigma


def _bucket_links(cut: float):
    """A spanning forest of what the estimate connects within one pair of blocks of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        _, reps, sigs, (own, meets) = _met(table)
        left = np.arange(len(reps))
        pairs: list[tuple[int, int]] = []
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                x = front.pop()
                near = np.zeros(len(left), bool)
                opposite = own[left] == meets[x]
                near[opposite] = estimate(sigs[x], sigs[left[opposite]]) >= cut
                found = left[near]
                pairs += [(int(reps[x]), int(reps[y])) for y in found]
                front += found.tolist()
                left = left[~near]
        return _edges(pairs)

    return run


_VISIT = pa.schema([("pool", pa.int64()), ("block", pa.int32()), ("rep", pa.int64()), ("label", pa.int64()), ("from_pool", pa.int64()), ("from_block", pa.int32())])
_VISIT_SQL = "pool long, block int, rep long, label long, from_pool long, from_block int"
#: Classes of a block that visit another one by themselves; of more, the whole block goes.
ALONE = 4


def _visits(num: int, den: int):
    """Of each pair that may be linked by estimate and sizes, that no link joins yet, and that has no earlier band
    in common, the class of the smaller pool (or block), with the pool and block that it is to visit; or, where
    many of a block do, that block (from_pool, from_block)."""

    def run(table: pa.Table) -> pa.Table:
        order, reps, sigs, (own, meets) = _met(table)
        label, size, pool, block, n = (np.array(table[c].to_pylist(), np.int64)[order] for c in ("label", "size", "pool", "block", "n_shingles"))
        bands = np.array(table["bands"].to_pylist(), np.int64)[order]
        band = int((bands[0] == table["bucket"][0].as_py()).argmax())
        out: dict[tuple[int, int, int, int], set[int]] = {}
        for x in range(len(reps)):
            mine, theirs = (size[x], pool[x], block[x], reps[x]), (size, pool, block, reps)
            after, same = np.zeros(len(reps), bool), np.ones(len(reps), bool)
            for a, b in zip(mine, theirs, strict=True):
                after, same = after | (same & (b > a)), same & (b == a)
            y = np.flatnonzero(after & (own == meets[x]) & (label != label[x]) & (den * np.minimum(n, n[x]) >= num * np.maximum(n, n[x])))
            y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
            y = y[estimate(sigs[x], sigs[y]) >= least_estimate(num, den)]
            for p, at in set(zip(pool[y].tolist(), block[y].tolist(), strict=True)):
                out.setdefault((p, at, int(pool[x]), int(block[x])), set()).add(x)
        rows = []
        for (p, at, *home), who in sorted(out.items()):
            rows += [(p, at, None, None, *home)] if len(who) > ALONE else [(p, at, int(reps[x]), int(label[x]), None, None) for x in sorted(who)]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_VISIT)], schema=_VISIT)

    return run


_SET_SQL = "rep long, shingles binary"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            rows = [(k, shingle_set(word_hashes(ascii_lower(t.encode("utf-8", "surrogatepass")).split(), cache), width).tobytes()) for k, t in text_rows(iter([batch]), "rep")]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["rep", "shingles"])

    return run


def confirmed(reps: np.ndarray, sets: list[np.ndarray], num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links on full sets (den * shared >= num * union) that span the components among ``reps``.

    ``known``: components that links join already.  One count through postings gives the shared shingles of a
    document with all others.  What no link joins yet is counted first; then all others are, but for those in
    the component with most of them left.
    """
    n = len(reps)
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    by_id = np.argsort(ids, kind="stable")
    postings, starts = owner[by_id], np.searchsorted(ids[by_id], np.arange(ids.max() + 2))
    ends = np.cumsum(sizes)
    label = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    pairs: list[tuple[int, int]] = []

    def count(x: int) -> None:
        own = ids[ends[x] - sizes[x] : ends[x]]
        lengths = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(postings[at], minlength=n)
        linked = np.flatnonzero(den * shared >= num * (sizes[x] + sizes - shared))
        for y in linked[label[linked] != label[x]].tolist():
            if label[y] != label[x]:
                pairs.append((int(reps[x]), int(reps[y])))
                lo, hi = min(label[x], label[y]), max(label[x], label[y])
                label[label == hi] = lo

    counted = np.zeros(n, bool)
    for x in range(n):
        if np.count_nonzero(label == label[x]) == 1:
            count(x)
            counted[x] = True
    # one component, the same to the end, is met from the other side: of two components one isn't this one
    home = int(np.flatnonzero(label == np.bincount(label, weights=~counted).argmax())[0])
    for x in np.flatnonzero(~counted).tolist():
        if label[x] != label[home]:
            count(x)
    return pairs


def _set_links(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        rows = {r: (s, k) for r, s, k in zip(*(table[c].to_pylist() for c in ("rep", "shingles", "label")), strict=True)}
        reps = np.array(sorted(rows), np.int64)
        sets = [np.frombuffer(rows[r][0], np.uint64) for r in reps.tolist()]
        return _edges(confirmed(reps, sets, num, den, np.array([rows[r][1] for r in reps.tolist()])) if len(reps) > 1 else [])

    return run


def _links(classes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """rep and component of every class that a confirmed link joins to another."""
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    many = written(buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    members = written(_blocks(buckets, many, BUCKET_BLOCK), "members")
    near = members.join(classes.select("rep", "signature"), "rep").groupBy("bucket", "lo", "hi").applyInArrow(lean_groups(_bucket_links(least_estimate(num, den))), "u long, v long")
    near = written(near.select(F.greatest("u", "v").alias("rep"), F.least("u", "v").alias("hub")).distinct(), "near")
    release(many, members)

    nodes = written(near.select("rep").union(near.select("hub")).distinct(), "nodes")
    wanted = written(nodes.join(classes, "rep").select("rep", F.col("least").alias("_id"), F.col("key").alias("_key")), "wanted")
    near_by = F.broadcast(wanted) if table_bytes(wanted) <= BROADCAST_BYTES else wanted
    texts = docs.join(near_by, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))).groupBy("rep").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(lean(_sets(width)), _SET_SQL), "sets")

    # each class with its hub, in parts of a bounded number
    hubs = written(near.groupBy("rep").agg(F.min("hub").alias("hub")), "hubs")
    size = written(hubs.groupBy("hub").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("n")), "sizes")
    part = F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("n")).cast("int")
    own = hubs.join(size, "hub").select("hub", part.alias("part"), "rep")
    meet = own.unionByName(size.select("hub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.col("hub").alias("rep"))).withColumn("label", F.col("rep"))
    links = written(meet.join(sets, "rep").groupBy("hub", "part").applyInArrow(lean_groups(_set_links(num, den)), "u long, v long").distinct(), "links")
    joined = written(components(links), "joined")
    release(hubs, size, links)

    # estimated pairs that no link joins yet meet by blocks: of large components, and of all small ones of a cluster
    clusters = components(near.select(F.col("rep").alias("u"), F.col("hub").alias("v"))).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    labels = clusters.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "cluster", F.coalesce("component", "rep").alias("label"))
    labels = written(labels, "clusters")
    large = labels.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") >= SET_BLOCK)
    pooled = written(labels.join(large, "label", "left").select("rep", "label", F.when(F.col("size").isNull(), -1 - F.col("cluster")).otherwise(F.col("label")).alias("pool")), "pooled")
    counted = pooled.groupBy("pool").agg(F.count("*").alias("size"))
    block = F.pmod(F.xxhash64(F.lit(9), "rep"), F.ceil(F.col("size") / SET_BLOCK)).cast("int").alias("block")
    homes = written(pooled.join(counted, "pool").select("rep", "label", "pool", "size", block), "homes")
    seen = buckets.join(homes, "rep")
    mixed = written(seen.groupBy("bucket").agg(F.count("*").alias("c"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket", "c"), "mixed")
    met = _blocks(seen, mixed, BUCKET_BLOCK).join(classes.select("rep", "signature", "bands", "n_shingles"), "rep")
    visits = written(met.groupBy("bucket", "lo", "hi").applyInArrow(lean_groups(_visits(num, den)), _VISIT_SQL).distinct(), "visits")
    moved = visits.where("rep IS NULL").select("pool", "block", "from_pool", "from_block")
    home = homes.select(F.col("pool").alias("from_pool"), F.col("block").alias("from_block"), "rep", "label")
    moved = moved.join(home, ["from_pool", "from_block"]).select("pool", "block", "rep", "label")
    asked, visits = visits, written(visits.where("rep IS NOT NULL").select("pool", "block", "rep", "label").union(moved).distinct(), "visits")
    size = written(visits.groupBy("pool", "block").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("n")), "sizes")
    guests = visits.join(size, ["pool", "block"]).select("pool", "block", part.alias("part"), "rep", "label")
    hosts = homes.join(size, ["pool", "block"]).select("pool", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "rep", "label")
    more = guests.unionByName(hosts).join(sets, "rep").groupBy("pool", "block", "part").applyInArrow(lean_groups(_set_links(num, den)), "u long, v long")
    a, b = (labels.select(F.col("rep").alias(r), F.col("label").alias(to)) for r, to in (("u", "a"), ("v", "b")))
    last = written(components(more.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))), "last")
    out = labels.join(last.select(F.col("node").alias("label"), F.col("component").alias("last")), "label", "left").select("rep", F.coalesce("last", "label").alias("component"))
    # a class alone in its component has no link
    count = out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    out = written(out.join(count, "component").select("rep", "component"), "groups")
    release(near, nodes, sets, joined, labels, pooled, homes, mixed, asked, visits, size, last)
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a shingle set, by which equal sets form a class; two zeros for an empty one."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist()) if len(s) else (0, 0)


def band_keys(m: np.ndarray) -> np.ndarray:
    """The bucket of each band of minima."""
    wide = m.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = mix(key ^ wide[:, j])
    return key.view(np.int64)


def low_bits(m: np.ndarray) -> bytes:
    """The low ``BITS`` bits of minima, packed."""
    low = (m & np.uint32(15)).astype(np.uint8)
    return ((low[::2] << 4) | low[1::2]).tobytes()


def classes_of(rows: DataFrame, *firsts: str) -> DataFrame:
    """A row per class of equal sets (h1, h2): its least doc_id, the text_key of a row that stands for it, and ``firsts`` of any row."""
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "text_key"))
    return rows.where("n_shingles > 0").groupBy("h1", "h2").agg(pick.alias("pick"), *[F.first(c).alias(c) for c in ("n_shingles", *firsts)]).select(
        "h1", "h2", F.col("pick.doc_id").alias("least"), F.col("pick.text_key").alias("key"), "n_shingles", *firsts
    )


def named(rows: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``rows`` (doc_id, h1, h2 and others) with their group: component_id, class_id, group_id (null without words).

    ``classes``: as ``classes_of`` gives them, with signature and bands; ``docs``: as ``keyed`` gives them."""
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = _links(classes, docs, width, num, den)
    names = found.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("name"))
    found = written(found.join(names, "component").select("rep", "component", "name"), "names")
    by_class = classes.select("rep", "h1", "h2", "least").join(found, "rep", "left")
    by_class = written(by_class.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("component", "rep").alias("group_id"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("name"), "least"), "classes")
    release(classes, found)
    out = rows.join(by_class, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    alone = F.col("group_id").isNull()
    return out.select(*rows.columns, *[F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(to) for c, to in (("name", "component_id"), ("least", "class_id"))], "group_id")


def _grouped(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """What ``groups`` gives, and the group's number (group_id), null without words."""
    docs = keyed(docs)
    rows = written(docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(_signatures(width)), _SIGNATURE_SQL), "signatures")
    out = named(rows.select("doc_id", "text_key", "n_shingles", "h1", "h2"), classes_of(rows, "signature", "bands"), docs, width, num, den)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, a hash of the text (text_key),
    n_shingles, component_id, kept, and the class of equal sets (class_id)."""
    return _grouped(docs, width, num, den).select("doc_id", "text_key", "n_shingles", "component_id", "class_id", "kept")


def dedup(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay, one row of each group, all columns as they were.

    Of a group's rows with the least doc_id the one with the least text stays.  Rows without words all stay.
    """
    found = _grouped(docs, width, num, den).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text")).agg(F.first("group_id").alias("_group"), F.count("*").alias("_n"))
    found = written(found, "candidates")
    times = found.groupBy("_group").agg(F.sum("_n").alias("_copies"))
    alone = found.where("_group IS NULL").select("_id", "_text", "_group", F.lit(1).cast("long").alias("_copies"))
    found = written(found.where("_group IS NOT NULL").join(times, "_group").select("_id", "_text", "_group", "_copies").unionByName(alone), "kept")
    docs, restore = set_aside(docs, ["doc_id", "text"])
    kept = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col("_text")))
    once = kept.where("_copies = 1").select(*docs.columns)
    more = kept.where("_copies > 1").groupBy("_group").agg(F.min_by(F.struct(*docs.columns), "text").alias("_row")).select("_row.*")
    return restore(once.unionByName(more))


def digest(docs: DataFrame) -> DataFrame:
    """op4: four-word shingles, 100 * intersection >= 80 * union."""
    return groups(docs, 4, 80, 100).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
