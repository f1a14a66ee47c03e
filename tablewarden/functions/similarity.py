"""String similarities, vectorised in numpy over many pairs at a time."""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


MOST_MASKS = 1 << 22  # integers of ``lcs_table``'s bit masks at a time


def sorted_tokens(value: str) -> str:
    return " ".join(sorted(value.split()))


def _codes(values: list[str], index: dict[str, int]) -> np.ndarray:
    width = max((len(v) for v in values), default=0)
    out = np.full((len(values), max(width, 1)), len(index), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = [index[c] for c in v]
    return out


def _lcs_long(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_lengths(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of left[i] and right[j], bit-parallel (Hyyro, 2004)."""
    index = {c: n for n, c in enumerate(sorted(set("".join(left)) | set("".join(right))))}
    long = np.array([len(v) > 64 for v in left], bool)[i]
    out = np.zeros(len(i), np.int64)
    masks = np.zeros((len(left), len(index) + 1), np.uint64)
    for k, v in enumerate(left):
        if len(v) <= 64:
            for n, c in enumerate(v):
                masks[k, index[c]] |= np.uint64(1 << n)
    codes = _codes(right, index)
    short = np.flatnonzero(~long)
    a, b = i[short], j[short]
    v = np.full(len(short), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for step in range(codes.shape[1]):
            u = v & masks[a, codes[b, step]]
            v = (v + u) | (v - u)
    sizes = np.array([min(len(x), 64) for x in left], np.uint64)[a]
    keep = np.where(sizes == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (sizes % np.uint64(64))) - np.uint64(1))
    out[short] = np.bitwise_count(~v & keep)
    for at in np.flatnonzero(long):
        out[at] = _lcs_long(left[i[at]], right[j[at]])
    return out


def ratios(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Indel ratio, 0 to 100, of already token-sorted strings."""
    total = np.array([len(x) for x in left], np.int64)[i] + np.array([len(x) for x in right], np.int64)[j]
    return np.where(total == 0, 100.0, 200.0 * lcs_lengths(left, right, i, j) / np.maximum(total, 1))


def _shared(words: list[str]) -> tuple[int, int]:
    """Lengths of the prefix and of the suffix behind it that all words have."""
    head = len(commonprefix(words))
    return head, len(commonprefix([w[head:][::-1] for w in words]))


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, a row each, -1 behind their ends; and their lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), int(sizes.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def lcs_table(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each left word (rows) with each right one (columns).

    Bit-parallel as ``lcs_lengths``, but a step works on whole rows of the table, in the narrowest integers that hold
    the right words; what all words share at their ends is cut off before and added after.
    """
    out = np.zeros((len(left), len(right)), np.int32)
    if not out.size:
        return out
    head, tail = _shared([*left, *right])
    (a, a_sizes), (b, b_sizes) = (_padded([w[head : len(w) - tail] for w in side]) for side in (left, right))
    letters, codes = np.unique(np.concatenate([a.ravel(), b.ravel(), [-1]]), return_inverse=True)
    a, b = codes[: a.size].reshape(a.shape), codes[a.size : a.size + b.size].reshape(b.shape)
    kinds = np.array([8, 16, 32, 64])
    width = np.where(b_sizes > 64, -(-b_sizes // 64) * 64, kinds[np.searchsorted(kinds, np.minimum(b_sizes, 64))])
    groups = []
    for bits in np.unique(width).tolist():
        same, most = np.flatnonzero(width == bits), max(1, MOST_MASKS // (-(-bits // 64) * len(letters)))
        groups += [(bits, same[k : k + most]) for k in range(0, len(same), most)]
    for bits, at in groups:
        kind, size = np.dtype(f"u{min(bits, 64) // 8}"), min(bits, 64)
        masks, keep = (np.zeros((bits // size, n, len(at)), kind) for n in (len(letters), 1))
        for p in range(int(b_sizes[at].max())):
            has = np.flatnonzero(b_sizes[at] > p)
            bit = kind.type(1 << p % size)
            masks[p // size, b[at[has], p], has] |= bit
            keep[p // size, 0, has] |= bit
        rows = max(1, (1 << 16) // (len(at) * kind.itemsize))
        for start in range(0, len(left), rows):
            some = slice(start, start + rows)
            v = np.full((len(masks), len(a[some]), len(at)), np.iinfo(kind).max, kind)
            for step in range(int(a_sizes[some].max())):
                carry = None
                for part, mask in zip(v, masks, strict=True):
                    u = part & mask.take(a[some, step], 0)
                    total = part + u
                    rest = part ^ u
                    if len(masks) > 1:
                        over = total < u
                        if carry is not None:
                            total += carry
                            over |= carry & (total == 0)
                        carry = over
                    np.bitwise_or(total, rest, out=part)
            counts = np.bitwise_count(~v & keep)
            out[some, at] = counts[0] if len(counts) == 1 else counts.sum(0, dtype=np.int32)
    return out + np.int32(head + tail)


def ratio_table(left: list[str], right: list[str]) -> np.ndarray:
    """Indel ratio, 0 to 100, of each left word with each right one, already token-sorted."""
    total = np.add.outer(*(np.array([len(w) for w in side], np.int64) for side in (left, right)))
    return np.where(total == 0, 100.0, 200.0 * lcs_table(left, right) / np.maximum(total, 1))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Case-sensitive Indel ratio of the strings' sorted words, 0 to 100; null if either is null."""
    known = a.notna() & b.notna()
    left, right = [sorted_tokens(x) for x in a[known]], [sorted_tokens(x) for x in b[known]]
    out = pd.Series(np.nan, index=a.index)
    at = np.arange(len(left))
    if len(left):
        out[known] = ratios(left, right, at, at)
    return out.astype(object).where(known, None)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity, 0 to 1: prefix of 4 at most, weight 0.1, where Jaro is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
