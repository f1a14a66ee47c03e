import numpy as np

from tablewarden.llm import neardup
from tablewarden.llm.components import components
from tablewarden.llm.neardup import confirmed, dedup, digest, groups


def brute(rows, width, num, den):
    sets = []
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append((d, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    post = {}
    for i, (_, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in post.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            post[x].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j][1]) - n):
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, digest(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 80, 100)


def family(n, length, edits, seed):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, length, edits):
            w[at] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_family_over_many_blocks_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(neardup, "SET_BLOCK", 5)
    texts = family(60, 100, 4, 1) + family(20, 60, 2, 2) + ["a b", "A B", "a  b", "", None, "solo words here", "x" * 100_000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(4, texts[1]), (None, "a b"), (None, "quite alone")]
    docs = spark.createDataFrame([(*r, "q", 0) for r in rows], "doc_id long, text string, _copies string, _id int").repartition(3)
    got = sorted(map(tuple, groups(docs, 3).select("doc_id", "n_shingles", "component_id", F_kept()).collect()), key=str)
    want = [(d, n, c, (d is None and c is None) or bool(k)) for d, n, c, k in brute(rows, 3, 80, 100)]
    assert got == sorted(want, key=str)
    kept = dedup(docs, 3)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {w[0] for w in want if w[3]}


def F_kept():
    from pyspark.sql import functions as F

    return F.col("kept")


def test_empty_table(spark):
    assert groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, x) for x in range(101, 160)]
    got = dict(map(tuple, components(spark.createDataFrame(path + star + [(7, 7), (900, 900)], "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def spanned(sets, pairs):
    up = list(range(len(sets)))
    for u, v in pairs:
        up = [up[u] if x == up[v] else x for x in up]
    return [up.index(x) for x in up]


def test_chains_of_versions_in_any_order_stay_whole():
    rng = np.random.default_rng(7)
    orders = [[0, 1, 3, 2, 4], *(rng.permutation(n) for n in (5, 12, 30) for _ in range(100))]
    for order in orders:
        # neighbours share 18 of 22 shingles, next but one 16 of 24; every third chain is cut in two
        apart = len(order) // 2 if rng.random() < 1 / 3 else len(order)
        sets = [np.arange(20, dtype=np.uint64) + np.uint64(2 * v + 1000 * (v >= apart)) for v in order]
        near = [(i, j) for i in range(len(order)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 100 >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert all(abs(order[i] - order[j]) == 1 for i, j in near)
        got = confirmed(np.arange(len(order)), sets, 80, 100)
        assert spanned(sets, got) == spanned(sets, near)
        assert len(got) == len(order) - len(set(spanned(sets, near)))


def intervals(starts, length):
    return [(i, " ".join(f"k{x}" for x in range(s, s + length))) for i, s in enumerate(starts)]


def test_random_intervals_in_any_order(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for block in (4, 512):
        monkeypatch.setattr(neardup, "BUCKET_BLOCK", block)
        monkeypatch.setattr(neardup, "SET_BLOCK", block)
        rows = intervals([0, 1, 10, 30, 31, 32, 20], 103)
        for family in range(1, 25):
            at = np.concatenate([rng.permutation(rng.integers(0, 160, rng.integers(3, 20)))])
            rows += [(1000 * family + i, " ".join(f"f{family}" + w for w in t.split())) for i, t in intervals(at, 103)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted(map(tuple, digest(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
        want = brute(rows, 4, 80, 100)
        assert got == want and {w[2] for w in want if w[0] < 7} == {0}


def test_known_components_are_not_linked_again():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(2, 20))
        sets = [np.arange(20, dtype=np.uint64) + np.uint64(s) for s in rng.integers(0, 3 * n, n)]
        near = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 100 >= 80 * len(np.union1d(sets[i], sets[j]))]
        some = [e for e in near if rng.random() < 0.5]
        known = np.array(spanned(sets, some))
        got = confirmed(np.arange(n), sets, 80, 100, known)
        assert spanned(sets, some + got) == spanned(sets, near)
        assert len(set(known)) - len(got) == len(set(spanned(sets, near)))


def test_null_and_repeated_ids_lose_no_text_and_no_link(spark):
    one, two, three = (family(4, 100, 1, seed) for seed in (11, 12, 13))
    loose = [f"text number {i} " + " ".join(f"q{i}x{j}" for j in range(30)) for i in range(12)]
    rows = [(None, t) for t in one + loose[:4]] + [(7, t) for t in two + loose[4:8]] + [(None, loose[8]), (3, loose[8]), (5, three[0]), (None, three[1]), (9, three[2]), (9, three[3])]
    rows += [(None, loose[9])] * 3 + [(7, loose[10])] * 3 + [(None, ""), (None, None), (7, "  "), (7, "  ")]
    docs = spark.createDataFrame([(*r, {"row": i}) for i, r in enumerate(rows)], "doc_id long, text string, at map<string,int>").repartition(5)
    got = sorted(map(tuple, groups(docs, 3).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted((w[:3] for w in brute(rows, 3, 80, 100)), key=str)
    kept = dedup(docs, 3)
    assert kept.columns == docs.columns
    kept = [r.at["row"] for r in kept.collect()]
    stay = [(None, min(one)), (7, min(two)), *((None, t) for t in loose[:4]), *((7, t) for t in loose[4:8]), (3, loose[8]), (5, three[0]), (None, loose[9]), (7, loose[10]), *rows[-4:]]
    assert sorted((rows[i] for i in kept), key=str) == sorted(stay, key=str)
