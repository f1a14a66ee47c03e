"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring symbols (byte characters, the last of a word with its end mark) that stand side by side
inside no vocabulary token can never be merged across, so a cut between them is certain.  A word is cut at
all such places, its fragments are encoded independently of each other and the ids are concatenated.
Fragments and whole words are memoised per Python worker, in memos of a fixed size.

The vocabulary is read from a tokenizer file whose path is a parameter.  It must be a BPE with an end-of-word
suffix over byte characters, a lower-casing NFC normalizer and a regular expression that picks words; other
files are refused.  The file is read on the driver and broadcast: its size is that of a vocabulary, not of
the data.

Defined cases: a null text counts as empty and has no ids; strings of the special tokens are found in the
raw text, as the tokenizers library does; very long words are merged with a heap, in n log n; repeated rows
are repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tablewarden.llm.common import keyed, lean, text_rows

#: Entries of a worker's memos.
MEMO_WORDS, MEMO_FRAGMENTS = 75_000, 10_000
_NONE = 1 << 60


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


#: Outside scripts long settled, versions of Unicode differ in what they call a letter.
_NEWER = regex.compile("[^\0-\u052f\u2000-\u2070\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fef\uac00-\ud7a3]")


class Memo:
    """What was looked up lately, in two halves: the older goes when the newer is full.  Long keys aren't kept."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.recent: dict = {}
        self.older: dict = {}

    def put(self, key, value) -> None:
        if len(key) <= 64:
            if len(self.recent) >= self.size // 2:
                self.older, self.recent = self.recent, {}
            self.recent[key] = value

    def get(self, key):
        found = self.recent.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self.put(key, found)
        return found


class Codec:
    """Encoder and decoder of one vocabulary file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        if model["type"] != "BPE" or not self.suffix or kinds != ["NFC", "Replace", "Lowercase"] or len(split) != 1 or spec["decoder"] or model.get("ignore_merges"):
            raise ValueError("not a lower-casing byte-level BPE with an end-of-word suffix")
        # the file's white space class is Unicode's
        pattern = split[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern)
        self.ids: dict[str, int] = model["vocab"]
        self.merges = {tuple(m if isinstance(m, list) else m.split(" ")): rank for rank, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.bytes = byte_characters()
        self.unbyte = {c: b for b, c in enumerate(self.bytes)}
        self.library = Tokenizer.from_str(content)
        self.joined = {pair for token in self.ids for symbols in [self._symbols_of(token)] for pair in zip(symbols, symbols[1:])}
        self.seen_words, self.seen_fragments = Memo(MEMO_WORDS), Memo(MEMO_FRAGMENTS)

    def _symbols_of(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def fragments(self, word: str) -> list[tuple[str, ...]]:
        """A word's symbols, cut between every two that no token holds side by side."""
        table = self.bytes
        symbols = [table[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.suffix
        out, start = [], 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.joined:
                out.append(tuple(symbols[start:i]))
                start = i
        out.append(tuple(symbols[start:]))
        return out

    def merge(self, fragment: tuple[str, ...]) -> list[str]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        if len(fragment) > 48:
            return self._merge_long(fragment)
        parts, rank = list(fragment), self.merges.get
        ranks = [rank(p, _NONE) for p in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NONE)
        return parts

    def _merge_long(self, fragment: tuple[str, ...]) -> list[str]:
        """The same with a heap, for long fragments."""
        parts: list[str | None] = list(fragment)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.merges
        heap = [(rank[p], i) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or rank.get((parts[i], parts[j])) != r:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (parts[i], parts[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p], i))
            if before[i] >= 0 and (p := (parts[before[i]], parts[i])) in rank:
                heapq.heappush(heap, (rank[p], before[i]))
        return [p for p in parts if p is not None]

    def _merged(self, fragment: tuple[str, ...]) -> list[int]:
        return [self.ids[t] for t in self.merge(fragment) if t in self.ids]

    def _word(self, word: str) -> list[int]:
        fragments = self.fragments(word)
        if len(fragments) == 1:  # the word itself is memoised
            return self._merged(fragments[0])
        out: list[int] = []
        for fragment in fragments:
            ids = self.seen_fragments.get(fragment)
            if ids is None:
                ids = self._merged(fragment)
                self.seen_fragments.put(fragment, ids)
            out += ids
        return out

    def _split(self, text: str) -> list[str]:
        """The words of a text.  Where it has letters that not every version of Unicode knows, the tokenizers
        library's own normalizer and splitter say what they are."""
        if text.isascii():
            return self.words.findall(text.lower())
        if _NEWER.search(text):
            split = self.library.pre_tokenizer.pre_tokenize_str
            table = self.unbyte
            return [bytes(table[c] for c in w).decode() for w, _ in split(self.library.normalizer.normalize_str(text))]
        # letter by letter, so that a final sigma gets no form of its own
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.seen_words
        recent = memo.recent
        for word in self._split(text):
            ids = recent.get(word)
            if ids is None:
                ids = memo.get(word)
                if ids is None:
                    ids = self._word(word)
                    memo.put(word, ids)
                recent = memo.recent
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if not self.specials:
            return self._plain(text)
        out: list[int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The tokens' own strings with one space between: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def _codec(content: str) -> Codec:
    key = hashlib.md5(content.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content)
    return _CODECS[key]


def _rows(content, make, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            rows = [make(codec, k, t) for k, t in text_rows(iter([batch]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)
        codec.seen_words.clear()
        codec.seen_fragments.clear()

    return run


def _content(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and the decoded text of every document."""

    def make(codec: Codec, k: int | None, t: str) -> tuple:
        ids = codec.encode(t)
        return k, len(ids), ids, codec.decode(ids)

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
    docs = keyed(docs)
    return docs.mapInArrow(lean(_rows(_content(docs, path), make, schema)), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """op3: doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256."""

    def make(codec: Codec, k: int | None, t: str) -> tuple:
        ids = codec.encode(t)
        return k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    docs = keyed(docs)
    return docs.mapInArrow(lean(_rows(_content(docs, path), make, schema)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
