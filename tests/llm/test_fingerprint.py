import hashlib

import numpy as np
import xxhash

from tablewarden.llm import fingerprint, neardup
from tablewarden.llm.common import permutations
from tablewarden.llm.fingerprint import COUNT, SEED, Fingerprinter, compare, edit, fingerprints, likeness, shown, similar
from tests.llm.test_neardup import brute

BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def plain_mix(x):
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * by) & MASK
    return x


def plain_fingerprint(text):
    """The least value of each universal hash over the distinct shingles, in whole numbers without numpy's arrays."""
    words = [xxhash.xxh3_64_intdigest(w) for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()]
    inverse = pow(BASE, -1, 1 << 64)
    shingles = set()
    for i in range(len(words) - 4):
        h = sum(w * pow(inverse, i + j, 1 << 64) for j, w in enumerate(words[i : i + 5])) * pow(BASE, i, 1 << 64) & MASK
        shingles.add(plain_mix(h))
    if 0 < len(words) < 5:
        shingles.add(plain_mix(sum(w * pow(inverse, j, 1 << 64) for j, w in enumerate(words)) & MASK) ^ len(words))
    a, b = (x.tolist() for x in permutations(COUNT, SEED))
    return [min((((x * s + y) & MASK) >> 32 for s in shingles), default=0xFFFFFFFF) for x, y in zip(a, b)]


def test_fingerprints_equal_plain_ones():
    for t in ["", "one", "A b c d", "a B c d e", "the same words the same words the same words again", "é 🙂 x y z " * 7]:
        assert shown(Fingerprinter()(t)) == "".join(f"{v:08x}" for v in plain_fingerprint(t))


def test_groups_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {(d, n, c) for d, n, c, _ in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in similar(docs).collect()} == want
    assert {(r.doc_id, r.component_id) for r in compare(docs).collect()} == {(d, c) for d, _, c in want}


def test_a_hot_doc_id_spreads_over_ranges():
    bounds = fingerprint._Ranges([3.0, 7.0, 7.0, 7.0, 7.0, 9.0])
    keys = np.random.default_rng(0).integers(-(1 << 63), (1 << 63) - 1, 4000)
    part = bounds.of(np.full(4000, 7), keys)
    assert set(part.tolist()) == {1, 2, 3, 4} and np.bincount(part).max() < 1200
    order = np.argsort(keys)
    assert (np.diff(part[order]) >= 0).all()
    assert bounds.of(np.array([1, 3, 4, 8, 9, 10]), np.zeros(6, np.int64)).tolist() == [0, 0, 1, 5, 5, 6]


def test_rows_of_one_doc_id_in_many_ranges(spark):
    rows = [(7, f"text {i} of many words here") for i in range(60)] + [(None, f"no id {i}") for i in range(40)] + [(8, "last")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    (last,) = [r for r in got if r.doc_id == 8]
    firsts = {hashlib.sha256(edit("last", t).encode()).hexdigest() for d, t in rows if d is None}
    assert last.edited_sha256 in firsts


def test_bands_find_every_link_of_a_family(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SET_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"k{x}" for x in range(s, s + 120))) for i, s in enumerate(rng.permutation(rng.integers(0, 400, 60)))]
    got = {(r.doc_id, r.component_id) for r in similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(d, c) for d, _, c, _ in brute(rows, 5, 80, 100)}


def test_whole_table_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    of = Fingerprinter()
    marks = [of(t) for _, t in rows]
    got = {r.doc_id: r for r in compare(docs).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        j = (i + 1) % len(rows)
        changed = edit(t, rows[j][1])
        r, m = got[d], of(changed)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (shown(marks[i]), shown(m))
        assert (r.near_edited, r.near_next) == (likeness(marks[i], m), likeness(marks[i], marks[j]))


def test_likeness_estimates_jaccard():
    rng = np.random.default_rng(5)
    of, errors = Fingerprinter(), []
    for share in np.linspace(0.1, 0.95, 40):
        a = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
        cut = int(400 * share)
        b = a[:cut] + [f"v{x}" for x in rng.integers(0, 10**9, 400 - cut)]
        sets = [{tuple(x[i : i + 5]) for i in range(396)} for x in (a, b)]
        errors.append(likeness(of(" ".join(a)), of(" ".join(b))) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_odd_rows(spark):
    rows = [(3, None), (None, "five words are here now"), (7, ""), (7, "x y"), (2**60, "z" * 100_000), (-5, "é🙂 abc"), (7, "x y")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(3)
    got = compare(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t or "")) for d, t in rows)
    by = {r.doc_id: r for r in got}
    assert by[2**60].edited_sha256 == hashlib.sha256(edit("z" * 100_000, rows[1][1]).encode()).hexdigest()
    assert by[-5].edited_sha256 == hashlib.sha256(edit("é🙂 abc", "").encode()).hexdigest()
    assert by[3].fingerprint == "f" * 1024 == by[3].edited_fingerprint and by[3].near_edited == 1
    one = compare(docs.where("doc_id = -5")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert compare(docs.limit(0)).collect() == []
    assert fingerprints(docs).where("doc_id = 7").distinct().count() == 2
