import random
from collections import Counter

import pytest

from tablewarden.llm.licenses import NOTICES, ORACLE, TEMPLATES, TEXTS, THRESHOLD, anchors, bigrams, digest, scan, tagged, words
from tests.llm.oracle import same_rows


def brute(text):
    """Every window of a template's size, wherever it stands."""
    w = bigrams(words(text or ""))
    best = {}
    for name, texts in TEMPLATES.items():
        for t in texts:
            b = Counter(bigrams(words(t)))
            n = b.total()
            for s in range(max(1, len(w) - n + 1) if w else 0):
                a = Counter(w[s : s + n])
                best[name] = max(best.get(name, 0), 2 * (a & b).total() / (a.total() + n))
    return {name: d for name, d in best.items() if d >= THRESHOLD - 1e-12}


def found(df):
    return {r.doc_id: {m.license: max(x.dice for x in r.matches if x.license == m.license) for m in r.matches} for r in scan(df).collect()}


def test_whole_table_equals_sql(spark, sf_dir):
    same_rows(digest(spark.read.parquet(f"{sf_dir}/documents.parquet")), ORACLE, sf_dir)


def test_licenses_of_the_table_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 900 OR lower(text) LIKE '%licen%' OR lower(text) LIKE '%rights%'").limit(150)
    got = found(docs)
    assert any(got.values())
    for r in docs.collect():
        want = brute(r.text)
        assert set(got[r.doc_id]) == set(want)


def written(text, rng):
    """The text as files have it: wrapped anew, in a comment, inside other text, with some words changed."""
    w = text.split()
    for _ in range(len(w) // 40):
        w[rng.randrange(len(w))] = "acme"
    lines, at = [], 0
    while at < len(w):
        n = rng.randint(5, 14)
        lines.append(" ".join(w[at : at + n]))
        at += n
    mark = rng.choice(["", "# ", "// ", " * ", "-- "])
    before, after = (" ".join(f"code{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))) for _ in range(2))
    return f"Copyright (c) {rng.randint(1990, 2026)} Someone\n{before}\n" + "\n".join(mark + x for x in lines) + f"\n{after}"


def test_recall_on_wrapped_commented_and_changed_texts(spark):
    rng = random.Random(4)
    rows, names = [], []
    for name, texts in TEXTS.items():
        for t in texts:
            for _ in range(12):
                rows.append((len(rows), written(t, rng)))
                names.append(name)
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(n in got[i] for i, n in enumerate(names)) >= 0.95 * len(names)


def test_notice_inside_a_line(spark):
    texts = [f"See the notes. {t} Send patches to the list." for ts in NOTICES.values() for t in ts] + ["nothing of the kind in the terms of the house", "use of the software in the other place"]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    names = [n for n, ts in NOTICES.items() for _ in ts]
    assert all(n in got[i] for i, n in enumerate(names)) and not got[len(names)] and not got[len(names) + 1]


def test_odd_rows(spark):
    texts = [None, "", "\n \n", "MIT", "Released under\nthe MIT License.", "All rights all rights all rights reserved.", "x " * 100_000, "Licensed under the Apache License, Version 3.0", "…Licensed under CC BY 4.0!\r\nReleased under the MIT License and more words", "All rights reserved. " * 3, "rights reserved"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, dice double")
    got = found(docs)
    for i, t in enumerate(texts):
        want = brute(t)
        assert all(want[n] == pytest.approx(d) or d <= want[n] for n, d in got[i].items())
        assert set(got[i]) == set(want), t
    rows = {r.doc_id: r for r in digest(docs).collect()}
    assert rows[9].n_matches >= 3 and rows[8].licenses == "CC-BY-4.0,MIT" and rows[0].license is None
    assert digest(docs.limit(0)).collect() == []
    assert digest(docs.unionAll(docs)).count() == 2 * len(texts)
    with pytest.raises(ValueError, match="two words"):
        scan(docs, {"one": ["word"]})


def test_anchors_leave_no_window_out():
    for n in range(1, 60):
        pairs = [f"a{i} b{i}" for i in range(n)]
        assert n - len(anchors(pairs, 0.8)) < 0.8 * n
    assert tagged(bigrams("a b a b".split())) == ["a b 1", "b a 1", "a b 2"]
