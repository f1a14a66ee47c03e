import hashlib
import re

from tablewarden.llm.decontaminate import clean, digest, hits

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, width=10):
    windows = {}
    for i, t in bench:
        w = low(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + width]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, items = low(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    items |= {str(i) for i in windows[k] if i is not None}
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = rows(digest(docs, bench))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(r[5] for r in got)


def test_odd_rows(spark):
    a = " ".join(f"a{i}" for i in range(14))
    bench = [(1, a), (2, "Éa short one"), (3, None), (4, "..."), (10, a.upper()), (None, "nobody knows me"), (1, "x x x x x x x x x x x x"), (5, "of of of")]
    docs = [(1, "..." + a + "!"), (2, "x " * 30), (3, None), (4, ""), (5, "éa short one"), (6, "ÉA Short, one of of OF of"), (7, a[:20] + " z " + a), (7, a[:20]), (None, "so nobody knows me"), (8, "a1 " * 3000 + a), (8, "a1 " * 3000 + a)]
    d = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, _id int, _key string").repartition(3)
    b = spark.createDataFrame([(*r, 3) for r in bench], "item_id int, text string, doc_id int")
    assert rows(digest(d, b)) == brute(docs, bench)
    left = clean(d, b)
    assert left.columns == d.columns and sorted((r.doc_id for r in left.collect())) == [3, 4, 5, 7]
    assert all(not r[5] for r in rows(digest(d, b.limit(0)))) and digest(d.limit(0), b).collect() == []


def test_proximity(spark):
    d = spark.createDataFrame([(1, "one two extra three four five"), (2, "five four three two one")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four five")], "item_id int, text string")
    assert [r.n_hit > 0 for r in hits(d, b).orderBy("doc_id").collect()] == [False, False]
    assert [r.n_hit > 0 for r in hits(d, b, slop=1).orderBy("doc_id").collect()] == [True, False]


def test_proximity_with_a_word_put_in_or_left_out_anywhere(spark):
    item = "one two three four five six".split()
    texts = [item[:i] + ["extra"] + item[i:] for i in range(7)] + [["of", "one"], ["far", "one"] + ["x"] * 9 + item[1:]]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(100 + i, "two one two four two six four") for i in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    b = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    got = {r.doc_id for r in hits(d, b, slop=1).where("n_hit > 0").collect()}
    assert got == set(range(7))


def test_whole_table_equals_sql(spark, sf_dir):
    from tablewarden.llm.decontaminate import ORACLE
    from tests.llm.oracle import same_rows

    same_rows(digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), ORACLE, sf_dir)
