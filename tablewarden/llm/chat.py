r"""Chat formatting with typed content parts, with DataFrame operations only.

A turn's content is a list of typed parts.  A visitor walks them in order: text is escaped and written,
and an image, audio or document part becomes a placeholder ``<|kind:k|>`` that names its number in the
conversation's list of attachments; the attachment's reference and its expanded token count go on record.

The template of a turn is ``<|turn|>role<|body|>content<|end|>``.  Control strings inside roles and texts
are escaped: a backslash is doubled, and one is put after the first character of ``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>`` and ``<</SYS>>``.  Dropping each backslash and keeping what follows it
undoes this, so every role and text can be read back from the formatted string.

The loss mask holds (start, length) in code points of the contents of assistant turns.

Turns are gathered in two steps, first in slices of ``SLICE`` turns, so a conversation with very many turns
meets no other task's rows until its slices are sorted; what follows goes slice by slice too.

Defined cases: a null text is the empty text, a null role the empty role; turns come in order of turn (null
first), then role, then text; repeated rows are repeated turns; a null conv_id is one conversation; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE, CHUNK = 512, 1 << 16
#: Tokens that a unit of an attachment expands to: an image tile, a second of audio, a document's page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 700}
PART = "array<struct<kind:string,text:string,ref:string,units:int>>"
_CONTROL = r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)"
_TURN, _BODY, _END = "<|turn|>", "<|body|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def running(numbers: Column) -> Column:
    """For each number the sum of those before it."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    return F.aggregate(numbers, start, step, lambda acc: acc["out"])


def format_parts(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role and parts (type ``PART``).  One row per conversation: conv_id, formatted,
    attachments (kind, ref, tokens), expanded_tokens (of attachments) and loss_mask (start, length)."""
    other = lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"
    order = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PART)).alias("parts"))
    slices = turns.select("conv_id", (F.col("turn") / SLICE).cast("long").alias("slice"), order.alias("turn")).groupBy("conv_id", "slice").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = slices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", "turns"))).alias("slices"))
    # slices anew, of equal length: repeated turns may have made some of them long
    whole = whole.withColumn("turns", F.flatten(F.transform("slices", lambda s: s["turns"])))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / SLICE).cast("int")), lambda i: F.slice("turns", i * SLICE + 1, F.lit(SLICE)))
    out = whole.select("conv_id", cut.alias("slices"))

    # running sums go by slices, then within each, so their cost stays in proportion to the turns
    out = out.withColumn("counts", F.transform("slices", lambda s: F.transform(s, lambda t: F.size(F.filter(t["parts"], other)))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    out = out.withColumn("firsts", running(F.transform("counts", total)))
    out = out.withColumn("firsts", F.zip_with("counts", "firsts", lambda s, first: F.transform(running(s), lambda x: x + first)))

    def visit(t: Column, first: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            number = first + F.size(F.filter(F.slice(t["parts"], F.lit(1), i), other))
            # a placeholder's kind is one word, whatever an attachment calls itself
            kind = F.regexp_replace(F.concat(p["kind"], F.when(p["kind"] == "", F.lit("_")).otherwise(F.lit(""))), r"\W", "_")
            return F.when(other(p), F.concat(F.lit("<|"), kind, F.lit(":"), number.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

        return F.array_join(F.transform(t["parts"], one), "")

    def written(t: Column, first: Column) -> Column:
        head = F.concat(F.lit(_TURN), escape(t["role"]), F.lit(_BODY))
        return F.struct(head.alias("head"), visit(t, first).alias("body"), (t["role"] == "assistant").alias("loss"))

    out = out.withColumn("pieces", F.zip_with("slices", "firsts", lambda s, f: F.zip_with(s, f, written)))
    out = out.withColumn("texts", F.transform("pieces", lambda s: F.array_join(F.transform(s, lambda p: F.concat(p["head"], p["body"], F.lit(_END))), "")))
    out = out.withColumn("formatted", F.array_join("texts", ""))
    kinds = F.create_map(*[F.lit(x) for pair in UNIT_TOKENS.items() for x in pair])
    attached = F.filter(F.flatten(F.flatten(F.transform("slices", lambda s: F.transform(s, lambda t: t["parts"])))), other)
    out = out.withColumn("attachments", F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), (F.coalesce(kinds[p["kind"]], F.lit(1)) * F.coalesce(p["units"], F.lit(1))).alias("tokens"))))
    out = out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]))

    # a span wherever the loss applies: where its slice starts, where its turn starts in the slice, and its head
    sizes = F.transform("pieces", lambda s: F.transform(s, lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["loss"].alias("loss"))))
    out = out.withColumn("sizes", sizes).withColumn("begin", running(F.transform("texts", F.length)))

    def spans(s: Column, first: Column) -> Column:
        at = running(F.transform(s, lambda p: p["head"] + p["body"] + len(_END)))
        all_ = F.zip_with(s, at, lambda p, x: F.struct(p["loss"].alias("loss"), (first + x + p["head"]).alias("start"), p["body"].alias("length")))
        return F.transform(F.filter(all_, lambda p: p["loss"]), lambda p: F.struct(p["start"], p["length"]))

    out = out.withColumn("loss_mask", F.flatten(F.zip_with("sizes", "begin", spans)))
    return out.select("conv_id", "formatted", "attachments", "expanded_tokens", "loss_mask")


def under_mask(formatted: str, mask: str) -> Column:
    """The strings that the spans of ``mask`` cover, in order, cut from chunks of the text."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(formatted) / CHUNK).cast("int")), lambda i: F.substring(F.col(formatted), i * CHUNK + 1, F.lit(CHUNK)))

    def cut(s: Column, chunks: Column) -> Column:
        first, last = F.floor(s["start"] / CHUNK).cast("int"), F.floor((s["start"] + s["length"]) / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), s["start"] - first * CHUNK + 1, s["length"])

    # an array of one element stands for a local name
    return F.flatten(F.transform(F.array(chunks), lambda c: F.transform(mask, lambda s: cut(s, c))))


def format_texts(conversations: DataFrame) -> DataFrame:
    """``format_parts`` for conversations (conv_id, turn, role, text) whose turns are one text part each."""
    part = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))
    return format_parts(conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), part.alias("parts")))


def read_back(formatted: Column) -> Column:
    """(role, text) of each turn, from the formatted string; placeholders of attachments are no text."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")
    def parse(t: Column) -> Column:
        halves = F.split(F.substring(t, len(_TURN) + 1, 1 << 30), r"<\|body\|>", 2)
        body = F.regexp_replace(F.get(halves, F.lit(1)), r"<\|\w+:\d+\|>", "")
        return F.struct(unescape(F.get(halves, F.lit(0))).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, parse)


def digest(conversations: DataFrame) -> DataFrame:
    """op8: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from the formatted string and its mask."""
    out = format_texts(conversations).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("loss", F.array_join(F.transform(under_mask("formatted", "loss_mask"), unescape), ""))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g') AS erole, regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g') AS etext FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(erole) + length(etext)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
