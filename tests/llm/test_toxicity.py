import numpy as np
import pytest

from tablewarden.llm import toxicity
from tablewarden.llm.toxicity import digest, fit, held_out, rejected, score, train, word_features

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")


def test_held_out_accuracy_needs_training_and_the_correction(spark, tables):
    docs, labels = tables
    got = digest(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / max(1, (got.predicted == 1).sum()) > 0.97
    assert hit.sum() / (got.toxic == 1).sum() > 0.77
    assert got.score.between(0, 1).all()

    def found(**other):
        rows = score(docs, train(docs, labels, ~held_out(), **other)).join(labels, "doc_id").where(held_out() & (labels.toxic == 1))
        return rows.where("score >= 0.7").count()

    assert found(steps=0) == 0
    assert found(nonnegative=False) < 0.93 * hit.sum()


def risk(rows, positive, w, b, prior):
    s = np.array([1 / (1 + np.exp(-b - sum(w[c] for c in r))) for r in rows])
    return prior * (1 - s[positive]).mean(), s[~positive].mean() - prior * s[positive].mean()


def plain_total(rows, positive):
    def total(w, b, linear):
        out = np.zeros((2, len(w) + 2))
        for r, y in zip(rows, positive):
            f = b + sum(w[c] for c in r)
            s = 1 / (1 + np.exp(-f))
            slope = (f if linear else s * (1 - s)) / (positive.sum() if y else (~positive).sum())
            out[int(not y), 0] += s / (positive.sum() if y else (~positive).sum())
            out[int(not y), 1] += slope
            for c in r:
                out[int(not y), c + 2] += slope
        return out

    return total


def test_risk_finds_the_toxic_feature_and_stays_non_negative():
    rng = np.random.default_rng(0)
    rows = [[0, *rng.integers(1, 30, 5)] for _ in range(60)] + [[0] * (i % 10 == 0) + rng.integers(1, 30, 5).tolist() for i in range(300)]
    rows = [sorted(set(map(int, r))) for r in rows]
    positive = np.arange(360) < 60
    share = np.array([sum(c in r for r in rows[60:]) / 300 for c in range(30)])
    spread = np.sqrt(share * (1 - share) + 0.05)
    z = np.array([sum(c in r for r in rows[:60]) / 60 for c in range(30)]) - share
    total = plain_total(rows, positive)
    w, b = fit(total, share, spread, z, 60, 0.1)
    assert b < -1 and b + w[0] > 1 and w[0] > 4 * np.abs(w[1:]).max()
    free_w, free_b = fit(total, share, spread, z, 60, 0.25, nonnegative=False)
    kept_w, kept_b = fit(total, share, spread, z, 60, 0.25)
    assert risk(rows, positive, free_w, free_b, 0.25)[1] < -0.05 < risk(rows, positive, kept_w, kept_b, 0.25)[1]


def test_sums_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    rows = [sorted(set(rng.integers(0, 6, rng.integers(0, 4)).tolist())) for _ in range(80)]
    positive = rng.random(80) < 0.3
    data = [(bool(y), np.array(r, np.int32).tobytes(), 1) for r, y in zip(rows, positive)]
    sets = spark.createDataFrame(data, "positive boolean, found binary, n long").repartition(3)
    for linear in (False, True):
        got = toxicity._total(sets, np.arange(6) / 3.0, -0.5, int(positive.sum()), int((~positive).sum()), linear)
        assert got == pytest.approx(plain_total(rows, positive)(np.arange(6) / 3.0, -0.5, linear), abs=1e-9)


def test_long_words_differ_to_their_end():
    one, other = (set(word_features(b"a" * 1000 + x)) for x in (b"b", b"c"))
    assert len(one & other) == len(one) - 1 == len(other) - 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "fine words " * 50_000, 3.0), (2, "idiot", 4.0), (2, "idiot", 4.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (1, None), (7, 0)], "doc_id long, toxic int")
    got = digest(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got[-2:]}) == 1
    assert digest(docs, labels.limit(0)).agg({"score": "max"}).first()[0] == 0
    assert rejected(docs, labels.limit(0)).columns == docs.columns
    assert digest(docs.limit(0), labels).collect() == []
