import hashlib
import random

from tablewarden.llm.substrings import dedup_substrings, digest, removal_intervals

SCHEMA = "doc_id long, text string"


def brute(rows, width):
    least = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    big = 1 << 70
    for d, w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            least[k] = min(least.get(k, big), big if d is None else d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < (big if d is None else d):
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(map(tuple, digest(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(5, line), (3, line), (3, line), (3, "x " + line), (None, line + " tail"), (9, None), (10, ""), (11, "short one"), (12, "a " * 50), (13, "a " * 40), (-4, "  q\x0bq " * 9), (2, "  q\x0bq " * 9)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", data string, bucket int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(docs, 4).collect()), key=str)
    assert got == brute(rows, 4)
    spans = {(r.doc_id, r.start_word, r.end_word) for r in removal_intervals(docs, 4).collect()}
    assert (5, 0, 20) in spans and (13, 0, 40) in spans and not any(d == 3 for d, _, _ in spans)


def results(df, width):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in dedup_substrings(df, width).collect()), key=str)


def test_rows_of_one_doc_id_in_any_partitions(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(1, line), (3, line), (3, "x " + line)]
    first = spark.createDataFrame(rows[:1], SCHEMA).coalesce(1)
    apart = first.unionByName(spark.createDataFrame(rows[1:], SCHEMA).coalesce(1))
    assert results(apart, 13) == results(apart.coalesce(1), 13) == brute(rows, 13)
    assert {r.n_removed for r in dedup_substrings(apart).where("doc_id = 3").collect()} == {20}


def test_random_rows_in_random_partitions(spark):
    rng = random.Random(3)
    passages = [[f"p{i}w{j}" for j in range(rng.randint(3, 9))] for i in range(12)]
    rows = []
    for _ in range(120):
        t = " ".join(w for p in rng.choices(passages, k=rng.randint(0, 6)) for w in p)
        rows += [(rng.choice([None, 1, 2, 2, 5, 9, -3, 30]), t)] * rng.choice([1, 1, 1, 3])
    want = brute(rows, 4)
    for n in (1, 2, 7):
        rng.shuffle(rows)
        assert results(spark.createDataFrame(rows, SCHEMA).repartition(n), 4) == want


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []
