"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

The index stores a posting (document, position, term) for every training token whose term occurs in the
benchmark; it is written once.  Each benchmark window looks up its rarest terms by collection frequency; their
lists, adjusted by their offsets, are intersected first, and what is left are alignments of an item with a
document.  The lists of the item's other terms are then intersected with the index at those alignments, and
every window whose terms all stand at their places is a match.  With ``slop`` above 0 each term may stand
that far from its place, seen from the rarest one: a proximity match.  Then that one alone aligns.

The vocabulary, the marks and the aligned documents are written first and broadcast only while their files stay
under ``BROADCAST_BYTES``; beyond that they are shuffled.  Common terms are counted by partial sums and are
never marks unless a window has no rarer one.

Defined cases: a null text has no words; an item of fewer words than a window, but not none, is one window;
a null item_id takes no part in ``items`` but its windows hit; null and repeated doc_id: rows are told apart
by doc_id and text, equal rows have equal results; other columns are ignored; empty tables give no rows, or
no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import set_aside, table_bytes, written

WIDTH, BROADCAST_BYTES, MARKS = 10, 16 << 20, 2
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Words in order; the first and the last entry may be empty."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), _SEPARATORS)


def _ascii_lower(word: Column) -> Column:
    """A-Z only: other letters that ``lower`` would change stay."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def _count(words: Column) -> Column:
    blank = lambda w: F.coalesce((w == "").cast("int"), F.lit(0))
    n = F.size(words)
    return (n - blank(F.get(words, F.lit(0))) - F.when(n > 1, blank(F.get(words, n - 1))).otherwise(0)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if its files are small."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df


def _tokens(table: DataFrame, key: list[str]) -> DataFrame:
    """key, pos and lower-cased word of every word; positions start at 0."""
    out = table.select(*key, F.posexplode(split_words(F.col("text"))).alias("pos", "word")).where("word <> ''")
    return out.withColumn("word", _ascii_lower(F.col("word")))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of the training tokens whose term is in ``vocabulary`` (word, term), written."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    # a text that starts with a separator has an empty first entry, which shifts all positions alike
    postings = _tokens(docs, ["doc_id", "text_key"]).join(_small(vocabulary), "word").select("doc_id", "text_key", "pos", "term")
    return written(postings, "postings")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """doc_id, text_key, item (row number of the item's text), item_id, and the matched document positions."""
    texts = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).withColumn("item", F.xxhash64("text"))
    items = written(_tokens(texts.select("item", "text").distinct(), ["item"]).withColumn("term", F.xxhash64("word")), "items")
    first = items.groupBy("item").agg(F.min("pos").alias("first"), F.count("*").alias("length"))
    items = items.join(first, "item").withColumn("at", F.col("pos") - F.col("first")).select("item", "at", "term", "word", "length")
    items = written(items, "items")
    index = build_index(docs, written(items.select("word", "term").distinct(), "vocabulary"))

    # of each window the rarest term; windows with a term that no document has can't occur exactly
    frequency = index.groupBy("term").agg(F.count("*").alias("frequency"))
    starts = items.where(F.col("at") <= F.greatest(F.col("length") - width, F.lit(0))).select("item", F.col("at").alias("start"), F.least("length", F.lit(width)).alias("size"))
    places = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1).cast("array<int>")).alias("at")
    window = starts.select("item", "start", places).join(items, ["item", "at"])
    rated = window.join(frequency, "term", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    # the rarest terms of each window; a window that occurs has all of them at one alignment (with slop the first only)
    n_marks = MARKS if slop == 0 else 1
    ranked = F.slice(F.sort_array(F.collect_list(F.struct("frequency", "at", "term"))), 1, n_marks)
    marks = rated.groupBy("item", "start").agg(ranked.alias("marks")).where(F.get("marks", F.lit(0))["frequency"] > 0)
    marks = marks.select("item", F.explode("marks").alias("m")).select("item", "m.at", "m.term").distinct()
    marks = written(marks.join(first.select("item", "length"), "item").withColumn("needed", F.least("length", F.lit(n_marks))), "marks")

    places = index.join(_small(marks), "term").select("doc_id", "text_key", "item", (F.col("pos") - F.col("at")).alias("shift"), "needed")
    aligned = places.groupBy("doc_id", "text_key", "item", "shift").agg(F.count("*").alias("met"), F.first("needed").alias("needed"))
    aligned = written(aligned.where(F.col("met") >= F.col("needed")).select("doc_id", "text_key", "item", "shift"), "aligned")
    same = index["doc_id"].eqNullSafe(F.col("_id")) & (index["text_key"] == F.col("_key"))
    held = written(aligned.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "aligned-documents")
    lists = index.join(_small(held), same, "left_semi")
    wanted = aligned.join(_small(written(items.select("item", "at", "term", "length"), "wanted")), "item").withColumn("place", F.col("at") + F.col("shift"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("pos"), F.col("term").alias("_term"))
    met = (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("term") == F.col("_term"))
    met = met & ((F.col("place") == F.col("pos")) if slop == 0 else (F.abs(F.col("place") - F.col("pos")) <= slop))
    found = wanted.join(lists, met).groupBy("doc_id", "text_key", "item", "shift", "length").agg(F.sort_array(F.collect_set("at")).alias("there"))

    # windows of which every place is there: a start whose place ``size - 1`` entries on is ``size - 1`` away
    size = F.least("length", F.lit(width)).cast("int")
    full = F.filter(F.col("there"), lambda s: F.array_contains(F.col("there"), s + size - 1) & (F.array_position(F.col("there"), s + size - 1) - F.array_position(F.col("there"), s) == size - 1))
    found = found.withColumn("full", full).where(F.size("full") > 0)
    covered = F.array_distinct(F.flatten(F.transform("full", lambda s: F.sequence(s, s + size - 1))))
    found = found.select("doc_id", "text_key", "item", F.transform(covered, lambda p: p + F.col("shift")).alias("positions"))
    return found.join(texts.select("item", "item_id"), "item")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_words, n_hit, the sorted ids of items found (``items``)."""
    found = matches(docs, benchmark, width, slop)
    by_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("positions")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), _count(split_words(F.col("text"))).alias("n_words"))
    out = words.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op7: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns as they were."""
    found = matches(docs, benchmark, width).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    found = _small(written(found, "contaminated"))
    docs, restore = set_aside(docs, ["doc_id", "text"])
    return restore(docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key")), "left_anti"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, s, s + 9), ' ') AS words
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS words
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, s, size, item_id FROM dw JOIN bw USING (size, words)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
