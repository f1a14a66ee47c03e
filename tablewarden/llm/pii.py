"""Personal data: base patterns and bootstrapped contextual extraction.

Base spans come from fixed expressions (e-mail, IPv4 address, payment card, phone number) and are the seed
entities.  What stands around seeds induces lexical patterns, in which marks are tokens of their own: the two
tokens before, the two words before whatever marks there are, and the token before with the one after.  The same
patterns around other identifier-shaped strings (numbers in groups, dotted numbers, strings with an @) make
candidate instances.  Spark scores the pattern-instance graph in rounds: a pattern is worth the share that trusted
instances of its kind have among all trusted ones that stand in it, whatever their kind, and half of the others;
it needs ``MIN_SEEDS`` different trusted instances.  An instance is worth its best pattern, and from then on
supports further patterns.  Every occurrence of a candidate worth ``CONFIDENCE`` becomes a span.  Learned spans
never replace base spans.

The graph has a row per identifier-shaped string, not per word; scores are sums and maxima, so hot patterns
are combined before any shuffle.

Defined cases: a null text is empty; positions count code points, end exclusive; of overlapping learned
spans all are kept, but a candidate that overlaps a base span isn't one; repeated rows are repeated; a null
doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import keyed, lean, release, set_aside, text_rows, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, CONFIDENCE, MIN_SEEDS, DOUBT = 3, 0.8, 5, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always begins where a run of digits begins, and saying so keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: What may be an identifier: a string with an @, four numbers with dots or commas, a long number, a number in groups.
_CANDIDATE = re.compile(r"[^\s@<>()\[\]{}\"',;]+@[^\s@<>()\[\]{}\"',;]+|(?<![0-9.,])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9])|(?<![0-9])[0-9]{7,19}(?![0-9])|(?<![0-9])\(?[0-9]{1,4}(?:(?:\)[ ./-]?|[ ./-]{1,2})\(?[0-9]{2,4}){1,6}(?![0-9])")
_EDGE = "().,;:!?/- "


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the longest run of local characters before an @, then a dotted domain."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and (len(p) <= 4 or not p[:-4].strip("0")) for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _shape(token: str) -> list[int]:
    """Kinds whose shape a candidate has."""
    if "@" in token:
        return [0]
    n = sum(c in "0123456789" for c in token)
    dotted = _FOUR.fullmatch(token) is not None
    return [1] * dotted + [2] * (13 <= n <= 19 and not dotted) + [3] * (7 <= n <= 15 and not dotted)


_FOUR = re.compile(r"[0-9]{1,3}(?:[.,][0-9]{1,3}){3}")
_EDGES = [("instance", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]


def _tokens_before(text: str, at: int) -> list[str]:
    """The tokens before a place, back to two words; read in growing steps, so that a long word is read whole."""
    reach = 64
    while True:
        begin = max(0, at - reach)
        found = [m for m in _TOKEN.finditer(text, begin, at) if begin == 0 or m.start() > begin]
        words = [i for i, m in enumerate(found) if m.group()[0].isalnum() or m.group()[0] == "_"]
        if begin == 0 or len(words) >= 2:
            return [m.group().lower() for m in found[words[-2] if len(words) >= 2 else 0 :]]
        reach *= 4


def _patterns(text: str, start: int, stop: int) -> list[str]:
    before = _tokens_before(text, start)
    words = [w for w in before if w[0].isalnum() or w[0] == "_"][-2:]
    after = _TOKEN.search(text, stop)
    out = {" ".join(before[-2:]) + " _"} if len(before) >= 2 else set()
    if len(words) == 2:
        out.add(" ".join(words) + " ~ _")
    if before and after:
        out.add(f"{before[-1]} _ {after.group().lower()}")
    return sorted(out)


def occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and candidates with the patterns that they stand in."""
    marks = [(s, e, k, True) for k, s, e in spans]
    if any(c in text for c in "0123456789@"):
        taken = sorted((s, e) for _, s, e in spans)
        at = 0
        for m in _CANDIDATE.finditer(text):
            core = m.group().strip(_EDGE if ")" not in m.group() else " ")
            start = m.start() + m.group().index(core) if core else m.start()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if core and not (at < len(taken) and taken[at][0] < start + len(core)):
                marks += [(start, start + len(core), k, False) for k in _shape(core)]
    return [{"instance": text[s:e].lower(), "start": s, "stop": e, "kind": k, "seed": y, "patterns": _patterns(text, s, e)} for s, e, k, y in marks]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("base", pa.list_(_SPAN)), ("edges", pa.list_(pa.struct(_EDGES)))])
_SQL = "doc_id long, text_key long, base array<struct<kind:int,start:long,stop:long>>, edges array<struct<instance:string,start:long,stop:long,kind:int,seed:boolean,patterns:array<string>>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for (k, t), key in zip(text_rows(iter([batch])), batch.column("text_key").to_pylist(), strict=True):
            spans = base_spans(t)
            rows.append((k, key, [{"kind": a, "start": s, "stop": e} for a, s, e in spans], occurrences(t, spans)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _SCHEMA, strict=True)], schema=_SCHEMA)


def score_graph(edges: DataFrame) -> DataFrame:
    """Candidates worth trusting (kind, instance), from edges (pattern, kind, instance, seed)."""
    graph = written(edges.groupBy("pattern", "kind", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph")
    trust = written(graph.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("trust")), "trust")
    for _ in range(ROUNDS):
        sure = F.col("trust") >= CONFIDENCE
        by_kind = graph.join(trust, ["kind", "instance"]).groupBy("pattern", "kind").agg(
            F.sum(F.when(sure, F.col("n") * F.col("trust")).otherwise(0.0)).alias("good"), F.sum(F.when(sure, 0).otherwise(F.col("n"))).alias("open"), F.sum(sure.cast("int")).alias("sure")
        )
        by_kind = written(by_kind, "patterns")
        whole = by_kind.groupBy("pattern").agg(F.sum("good").alias("all_good"))
        worth = by_kind.where(F.col("sure") >= MIN_SEEDS).join(whole, "pattern").select("pattern", "kind", (F.col("good") / (F.col("all_good") + DOUBT * F.col("open") + 0.5)).alias("worth"))
        best = graph.join(worth.where(F.col("worth") >= CONFIDENCE), ["pattern", "kind"], "left")
        best = best.groupBy("kind", "instance").agg(F.greatest(F.max(F.col("seed").cast("double")), F.max(F.coalesce("worth", F.lit(0.0)))).alias("trust"), F.max("seed").alias("seed"))
        best = written(best, "trust")
        release(trust, by_kind)
        trust = best
    return trust.where((F.col("trust") >= CONFIDENCE) & ~F.col("seed")).select("kind", "instance")


def _occurring(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans and occurrences of every row, and the occurrences as rows."""
    rows = written(keyed(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(_read), _SQL), "spans")
    return rows, rows.select("doc_id", "text_key", F.explode("edges").alias("e")).select("doc_id", "text_key", "e.*")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base spans and all spans of every row, as arrays of (kind, start, stop)."""
    rows, marks = _occurring(docs)
    trusted = score_graph(marks.select(F.explode("patterns").alias("pattern"), "kind", "instance", "seed"))
    learned = marks.where("not seed").join(trusted, ["kind", "instance"], "left_semi")
    learned = learned.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("kind", "start", "stop")).alias("learned"))
    out = rows.select("doc_id", "text_key", "base").join(learned, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select("doc_id", "text_key", "base", F.when(F.col("learned").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "learned"))).alias("spans"))


def rediscovered(docs: DataFrame, percent: int = 20) -> tuple[int, int, int]:
    """How well the method works on ``docs``: of the different seeds ``percent`` are hidden, so that they are
    candidates.  Returns how many were hidden, how many of them the method found, and how many others it found."""
    _, marks = _occurring(docs)
    hidden = F.col("seed") & (F.pmod(F.xxhash64("instance", F.lit(3)), F.lit(100)) < percent)
    marks = marks.withColumn("hidden", hidden).withColumn("seed", F.col("seed") & ~hidden)
    found = score_graph(marks.select(F.explode("patterns").alias("pattern"), "kind", "instance", "seed"))
    all_ = marks.groupBy("kind", "instance").agg(F.max("hidden").alias("hidden"))
    hits = found.join(all_, ["kind", "instance"]).groupBy("hidden").count().collect()
    by = {r.hidden: r["count"] for r in hits}
    return all_.where("hidden").count(), by.get(True, 0), by.get(False, 0)


def said(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """op6: doc_id, counts of base spans by kind, base_sha256, spans."""
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_learned"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where it is there, follows the text."""
    found = find(docs).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.first("spans").alias("_spans"))
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    kind_of_n = dict(docs.dtypes).get("n_chars")
    docs, restore = set_aside(docs, ["doc_id", "text", "n_chars"] if kind_of_n else ["doc_id", "text"])
    joined = docs.join(written(found, "mask"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_key")), "left")
    ordered = F.array_sort(F.transform("_spans", lambda x: F.struct(x["start"].cast("int").alias("start"), x["stop"].cast("int").alias("stop"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, x: Column) -> Column:
        put = F.struct(x["stop"].alias("at"), F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, x["start"] - done["at"]), F.get(kind, x["kind"])).alias("out"))
        return F.when(x["start"] >= done["at"], put).otherwise(F.struct(F.greatest(done["at"], x["stop"]).alias("at"), done["out"].alias("out")))

    masked = F.aggregate(ordered, start, step, lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    out = joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(masked))
    if kind_of_n:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind_of_n)))
    return restore(out)


def sha(spans: list[tuple[int, int, int]]) -> str:
    """The digest of spans as ``digest`` has it, in plain Python."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
