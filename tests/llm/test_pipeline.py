import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tablewarden.llm import toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_neardup import brute as grouped
from tests.llm.test_pii import plain


def test_rows_equal_a_plain_version(spark, sf_dir):
    docs, labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    of = toxicity.train(docs, labels, ~toxicity.held_out()).scorer()
    rows = [(r.doc_id, r.text) for r in docs.collect() if of(r.text) < 0.7]
    keep = {d for d, _, _, kept in grouped(rows, 5, 80, 100) if kept}
    rows = [r for r in rows if r[0] in keep]
    bad = {r[0] for r in contaminated(rows, [(r.item_id, r.text) for r in bench.collect()]) if r[5]}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, t in rows:
        if d not in bad:
            for k, s, e in sorted(plain(t), key=lambda x: -x[1]):
                t = t[:s] + ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[k] + t[e:]
            want[d] = tok.encode(t, add_special_tokens=False).ids
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert 0 < len(want) < docs.count()
    assert got == want


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, "en", "s", 0), (1, "", "en", "s", 0), (1, "", None, None, None), (2, "a b " * 20_000, "en", "s", 80_000)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf_dir)
            assert name == "bpe" or out.columns == docs.columns
            table = out
        table.collect()
