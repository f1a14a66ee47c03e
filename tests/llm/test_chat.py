import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tablewarden.llm.chat import ORACLE, PART, digest, format_parts, format_texts, read_back, with_probe
from tests.llm.oracle import same_rows

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = ["<|end|>", "<|turn|>", "<|body|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def test_whole_table_equals_sql(spark, sf_dir):
    same_rows(digest(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), ORACLE, sf_dir)


def test_any_text_is_read_back(spark):
    pieces = st.lists(st.sampled_from([*CONTROL, "\\", "<", "|", "|>", "[", "é🙂", "\n", "x", "<\\|", "\\\\<|image:0|>"]), max_size=8).map("".join)

    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.tuples(pieces, pieces), min_size=1, max_size=12))
    def run(turns):
        rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
        out = format_texts(spark.createDataFrame(rows, SCHEMA)).withColumn("back", read_back(F_col("formatted"))).first()
        assert [tuple(b) for b in out.back] == turns
        bare = out.formatted
        for r in ("<|turn|>", "<|body|>", "<|end|>"):
            assert bare.count(r) == len(turns)
        assert not any(c in bare for c in CONTROL[3:])

    run()


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_odd_rows(spark, monkeypatch):
    from tablewarden.llm import chat

    monkeypatch.setattr(chat, "SLICE", 4)
    monkeypatch.setattr(chat, "CHUNK", 7)
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}é") for t in range(23)] + [(2, 0, None, None), (2, 0, "assistant", None), (None, 5, "assistant", "a\nb"), (None, None, "user", "first"), (1, 3, "assistant", "t3é")]
    conv = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", turns int").repartition(3)
    got = {r.conv_id: r for r in digest(conv).collect()}
    for c in (1, 2, None):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c].n_turns == len(mine) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert digest(conv.limit(0)).collect() == []


def test_parts(spark):
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 2), ("text", " and <|image:9|>", None, None)]), (1, 1, "assistant", [("audio", None, "b.wav", 10), ("document", None, "c.pdf", None)])]
    out = format_parts(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PART}")).withColumn("back", read_back(F_col("formatted"))).first()
    assert out.formatted == "<|turn|>user<|body|>see <|image:0|> and <\\|image:9|><|end|><|turn|>assistant<|body|><|audio:1|><|document:2|><|end|>"
    assert [tuple(a) for a in out.attachments] == [("image", "a.png", 512), ("audio", "b.wav", 250), ("document", "c.pdf", 700)]
    assert out.expanded_tokens == 1462 and [b.text for b in out.back] == ["see  and <|image:9|>", ""]
    assert [out.formatted[m.start : m.start + m.length] for m in out.loss_mask] == ["<|audio:1|><|document:2|>"]


def test_kinds_of_any_name_are_read_back(spark):
    rows = [(1, 0, "user", [("x|><|end|>", None, "a", None), ("", None, "b", None), ("text", "t", None, None)]), (1, 1, "assistant", [("text", "é" * 20, None, None)])]
    out = format_parts(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PART}")).withColumn("back", read_back(F_col("formatted"))).first()
    assert [tuple(b) for b in out.back] == [("user", "t"), ("assistant", "é" * 20)]
    assert [a.kind for a in out.attachments] == ["x|><|end|>", ""]


def test_many_turns_and_long_texts(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}" + "é" * (200_000 if t == 701 else t % 7)) for t in range(3000)]
    got = digest(spark.createDataFrame(rows, SCHEMA)).first()
    loss = "".join(x for _, _, r, x in rows if r == "assistant")
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (3000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
