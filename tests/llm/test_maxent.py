import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tablewarden.llm.maxent import CLASSES, SLOTS, SUFFIXES, Model, Reader, Weights, _batches, digest, features, fit, groups_of, held_out, induce


def tokens(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() + [None]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def base(rows):
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    n, v = c.total(), len(c)
    return [(d, held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, t in rows for w in [tokens(t)]]


def same(df, rows):
    got = sorted(map(tuple, df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=str)
    for g, w in zip(got, sorted(base(rows), key=str), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_whole_table_base_and_held_out_gain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = digest(docs).cache()
    same(out, [(r.doc_id, r.text) for r in docs.collect()])
    apart = out.where("held_out").toPandas()
    assert apart.score.sum() > apart.base_score.sum() + 0.2 * apart.n_tokens.sum()
    assert (apart.score < 0).all()


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "A a B"), (2, "A a B"), (2, "other"), (9, "x " * 60_000), (16, "é É \x0bq")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double").repartition(3)
    same(digest(docs), rows)
    assert digest(docs.limit(0)).collect() == []
    assert digest(docs.where("doc_id = 9")).count() == 1


def test_score_equals_a_plain_sum_from_the_same_weights(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, total, types, model = fit(docs, ~held_out())
    got = {r.doc_id: r for r in digest(docs).collect()}
    c = Counter(x for d, t in rows if not held(d) for x in tokens(t))
    read, allowed = Reader(), model.allowed
    group = {w: int(groups_of(read((w or b"").decode()))[0]) for w in {x for _, t in rows for x in tokens(t)}}
    assert sum(group[w] == 0 for w in group) == 1  # the end's alone
    size = Counter()
    for w, n in c.items():
        size[model.kinds[group[w]]] += n + 1
    for d, t in rows[:8]:
        want = 0.0
        padded = np.concatenate([np.full(3, 1 << 40, np.uint64), read(t)])
        kinds = model.kinds[groups_of(padded)]
        at = features(padded, kinds, model.rows.shape[1])
        for i, w in enumerate(tokens(t)):
            kind = int(kinds[i + 3])
            for factor, target in ((0, kind // SLOTS), (1, kind % SLOTS)):
                z = [sum(float(model.rows[factor, r, k]) for r in at[4 * factor : 4 * factor + 4, i]) for k in range(SLOTS)]
                z = [x if factor == 0 or allowed[kind // SLOTS, k] else -1e9 for k, x in enumerate(z)]
                want += (z[target] - max(z) - math.log(sum(math.exp(x - max(z)) for x in z))) / math.log(10)
            want += math.log10((c[w] + 1) / (size[kind] + 1))
        assert got[d].score == pytest.approx(want, rel=1e-3)
    assert total == c.total() and types == len(c)


def test_learning_lowers_the_loss_of_both_factors():
    rng = np.random.default_rng(0)
    read = Reader()
    words = [f"w{i}" for i in range(40)]
    text = [0]
    for _ in range(8000):
        text.append((text[-1] * 3 + 1) % 40 if rng.random() < 0.9 else int(rng.integers(40)))
    t = read(" ".join(words[i] for i in text))
    kinds = np.concatenate([[0], SLOTS + np.arange(SUFFIXES - 1) % (SLOTS * (CLASSES - 1))])
    model = Model(np.zeros((2, 1 << 14, SLOTS), np.float32), kinds)
    ((at, of, lengths),) = _batches(iter([t]), kinds, 1 << 14, 1 << 20)
    assert lengths.tolist() == [len(t)] and (of == kinds[groups_of(t)]).all() and at.max() < 1 << 14
    w = Weights(model)
    n = np.arange(len(of))
    chance = lambda f: np.exp(w.scores(f, at, of)) / np.exp(w.scores(f, at, of)).sum(axis=1, keepdims=True)
    loss = lambda: (-np.log(chance(0)[n, of // SLOTS]).mean(), -np.log(chance(1)[n, of % SLOTS]).mean())
    before = loss()
    for _ in range(8):
        for i in range(0, len(of), 1000):
            w.learn(at[:, i : i + 1000], of[i : i + 1000])
    after = loss()
    assert before == pytest.approx((np.log(CLASSES), np.log(SLOTS)), rel=1e-3) and after[0] < 0.4 * before[0] and after[1] < 0.4 * before[1]
    assert w.score(at, of).mean() == pytest.approx(-sum(after), rel=1e-4)
    assert (chance(1)[~model.allowed[of // SLOTS]] == 0).all()


def test_groups_of_one_language_share_classes():
    rng = np.random.default_rng(1)
    pairs = np.zeros((SUFFIXES, SUFFIXES))
    for k in range(4):  # four languages of a hundred suffixes each, that hardly mix
        at = slice(1 + 100 * k, 101 + 100 * k)
        pairs[at, at] = rng.poisson(20, (100, 100))
    of = induce(pairs) // SLOTS
    assert of[0] == 0 and of.max() < CLASSES
    used = [set(of[1 + 100 * k : 101 + 100 * k].tolist()) for k in range(4)]
    assert all(not (used[i] & used[j]) for i in range(4) for j in range(i))
