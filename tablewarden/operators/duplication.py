"""Exact and near-duplicate rows.

Exact repeats come from partial aggregates over whole rows.  Near-duplicates compare an identity column:
distinct values are gathered into tiles of ``TILE`` within a block, tiles meet pairwise, and numpy scores all
pairs of two tiles at once.  One pass returns a histogram of rounded scores (every pair counts with the product of
its values' row counts), from which the threshold is calibrated, and the best score of each value; another finds
rows of (nearly) equal values that agree in the other columns.  No pair becomes a row there: pairs of rows are made
only where they are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions import text as t
from tablewarden.functions.similarity import lcs_table, ratio_table, sorted_tokens
from tablewarden.operators.calibration import Threshold, duplicate_threshold
from tablewarden.operators.profile import TEXT, Table

# Identity names in order of preference and the limits of the method.
IDENTITY_HINTS = ("business_name", "company_name", "vendor_name", "name")
LEAST_IDENTITY_SHARE, LEAST_IDENTITY_VALUES = 0.3, 5
BLOCKING_ABOVE, EXACT_SCORE, ROW_SHARE, DOMINANT_SHARE = 800, 99.5, 0.8, 0.5
TILE = 512
SPACES = r"(?U)[\s\x1C-\x1F]+"  # what Python's split parts words by
LEAST_LONG = 99  # words of fewer characters score 99.5 or more only with equal words
MOST_BINS = 1 << 20  # of a tile's counts that are kept in one array


@dataclass
class DuplicationResult:
    exact_rows: int
    identity: str | None
    threshold: Threshold
    n_rows: int
    rows_involved: int = 0
    fuzzy_rows: int = 0
    first_pair: tuple | None = None
    exact: DataFrame | None = None
    pairs: DataFrame | None = None  # not worked out before it is read; it can have far more rows than the table
    histogram: dict[float, int] = field(default_factory=dict)

    def release(self) -> None:
        """Give the executors' memory back; what is asked for later is worked out again."""
        for kept in (self.exact, self.pairs):
            if kept is not None:
                kept.unpersist()

    @property
    def percentage(self) -> float:
        return round(self.rows_involved / self.n_rows * 100, 2) if self.n_rows else 0.0

    @property
    def score(self) -> float:
        return round(max(0.0, 100.0 - (self.rows_involved / self.n_rows * 100 if self.n_rows else 0.0)), 2)


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """_row_id of every row that repeats an earlier one in all ``columns`` (nulls equal nulls)."""
    first = df.groupBy(*columns).agg(F.min("_row_id").alias("_row_id"), F.count("*").alias("n"))
    return df.select("_row_id").join(first.select("_row_id"), "_row_id", "left_anti")


def column_shapes(profile: DataFrame) -> DataFrame:
    """col, present values, distinct stripped values and the count of the most frequent one."""
    values = profile.where(~t.is_blank(F.col("raw"))).groupBy("col", t.strip(F.col("raw")).alias("v")).agg(F.sum("cnt").alias("cnt"))
    return values.groupBy("col").agg(F.sum("cnt").alias("present"), F.count("*").alias("values"), F.max("cnt").alias("largest"))


def choose_identity(names: list[str], types: dict[str, str], shapes: dict[int, tuple[int, int]]) -> str | None:
    """``shapes``: column position to (present, distinct).  A hinted text column first, then the first that fits."""

    def fits(n: str) -> bool:
        present, distinct = shapes.get(names.index(n), (0, 0))
        return present > 0 and distinct >= LEAST_IDENTITY_VALUES and distinct / present >= LEAST_IDENTITY_SHARE

    texts = [n for n in names if types.get(n) == TEXT]
    hinted = [n for h in IDENTITY_HINTS for n in texts if h in n.lower()]
    return next((n for n in hinted + texts if fits(n)), None)


def low_information(names: list[str], identity: str | None, shapes: dict[int, tuple[int, int]]) -> set[str]:
    """``shapes``: column position to (present, largest)."""
    return {n for i, n in enumerate(names) if n != identity and (i not in shapes or shapes[i][1] / shapes[i][0] >= DOMINANT_SHARE)}


def _tiles(items: DataFrame) -> DataFrame:
    """``items``: block, n and what tells the items of a block apart.  Pairs of tiles of one block, each once, as
    arrays of items; items that can't be in a pair are left out."""
    told = [c for c in items.columns if c not in ("block", "n")]
    size = items.groupBy("block").agg(F.count("*").alias("in_block"))
    tile = F.pmod(F.xxhash64(*told), F.ceil(F.col("in_block") / TILE)).cast("int")
    tiles = F.ceil(F.col("in_block") / TILE).cast("int")
    packed = items.join(size.where("in_block > 1"), "block", "left").where("in_block > 1 OR n > 1").withColumn("in_block", F.coalesce("in_block", F.lit(1)))
    packed = packed.groupBy("block", tile.alias("tile"), tiles.alias("tiles")).agg(F.sort_array(F.collect_list(F.struct(*told, "n"))).alias("rows"))
    # a tile meets itself and the half of the others that follow it in a ring, so that all have equally many pairs
    steps = F.sequence(F.lit(0), F.expr("CAST(tiles / 2 AS INT)"))
    a = packed.select("block", F.col("tile").alias("a"), "tiles", F.col("rows").alias("left_rows"), F.explode(steps).alias("step"))
    a = a.where("2 * step < tiles OR 2 * a < tiles").withColumn("b", F.expr("(a + step) % tiles"))
    b = packed.select("block", F.col("tile").alias("b"), F.col("rows").alias("right_rows"))
    return a.join(b, ["block", "b"]).select("a", "b", "left_rows", "right_rows")


@dataclass
class _Tile:
    values: list[str]
    n: np.ndarray
    words: list[str]
    cells: list[list[str]] | None


def _read_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, _Tile, _Tile]]:
    """Whether a tile meets itself, and both tiles."""
    for batch in batches:
        own = pc.equal(batch.column("a"), batch.column("b")).to_pylist()
        for i in range(batch.num_rows):
            pair = []
            for side in ("left_rows", "right_rows"):
                items = pa.StructArray.from_arrays(batch.column(side)[i].values.flatten(), fields=list(batch.schema.field(side).type.value_type))
                values = items.field("value").to_pylist()
                cells = items.field("cells").to_pylist() if items.type.get_field_index("cells") >= 0 else None
                pair.append(_Tile(values, items.field("n").to_numpy(), [sorted_tokens(v) for v in values], cells))
            yield own[i], *pair


def _pairings(copies: bool):
    """Row pairs by score (score, n), and each value's best score with another one in its block (value, best) as far
    as it is below ``EXACT_SCORE``; with ``copies`` any score, and 100 for values of several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        best: dict[str, float] = {}
        for own, left, right in _read_tiles(batches):
            # pairs by their lengths and what they share
            (la, i), (lb, j) = (np.unique([len(w) for w in side.words], return_inverse=True) for side in (left, right))
            bins = lcs_table(left.words, right.words).astype(np.int64)
            width = int(bins.max()) + 1
            bins += np.add.outer(i * len(lb), j) * width
            lengths = np.add.outer(la, lb).ravel()
            if len(lengths) * width > MOST_BINS:
                known, bins = np.unique(bins, return_inverse=True)
            else:
                known = np.arange(len(lengths) * width)
            length, common = lengths[known // width], known % width
            scores = np.where(length == 0, 100.0, 200.0 * common / np.maximum(length, 1))
            n, m = left.n, right.n
            weight = None if (n == 1).all() and (m == 1).all() else np.outer(n, m).ravel()
            counts = np.bincount(bins.ravel(), weights=weight, minlength=len(known)).astype(np.int64)
            found: Counter = Counter()
            for score, k in zip(np.round(scores[counts > 0], 2).tolist(), counts[counts > 0].tolist(), strict=True):
                found[score] += k
            if own:  # every pair twice, and each row with itself
                found[100.0] -= int(n.sum())
                found = Counter({score: k // 2 for score, k in found.items()})
            total.update(found)

            table = np.where(copies | (scores < EXACT_SCORE), scores, -1.0)[bins.reshape(len(n), len(m))]
            if own:
                np.fill_diagonal(table, np.where(copies & (n > 1), 100.0, -1.0))
            for side, top in ((left, table.max(1)), (right, table.max(0))):
                for value, score in zip(side.values, top.tolist(), strict=True):
                    if score > best.get(value, -1.0):
                        best[value] = score
        total += Counter()
        rows = len(total), len(best)
        columns = [[*total.keys(), *[None] * rows[1]], [*total.values(), *[None] * rows[1]], [*[None] * rows[0], *best.keys()], [*[None] * rows[0], *best.values()]]
        kinds = pa.float64(), pa.int64(), pa.string(), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["score", "n", "value", "best"])

    return run


def _matching(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, left, right in _read_tiles(batches):
            scores = ratio_table(left.words, right.words)
            i, j = np.nonzero(np.triu(scores >= threshold, 1) if own else scores >= threshold)
            many = [left.values[k] for k in np.flatnonzero(left.n > 1)] if own else []
            one, two = [left.values[k] for k in i] + many, [right.values[k] for k in j] + many
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(scores[i, j].tolist() + [100.0] * len(many), pa.float64())], names=["value_a", "value_b", "similarity"])

    return run


def _agreement(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Share of equal cells of each left row with each right one."""
    same = np.zeros((len(left), len(right)), np.int64)
    for cells in zip(zip(*left, strict=True), zip(*right, strict=True), strict=True):
        codes = {c: k for k, c in enumerate(dict.fromkeys(cells[0] + cells[1]))}
        same += np.equal.outer(*(np.array([codes[c] for c in side]) for side in cells))
    return same / max(len(left[0]), 1)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of several rows, or with a partner of (nearly) equal words that agrees in enough cells.  What a task has
    found is sent once, at its end."""
    found: dict[tuple, None] = {}
    for own, left, right in _read_tiles(batches):
        hit = ratio_table(left.words, right.words) >= EXACT_SCORE
        if hit.any():
            hit &= _agreement(left.cells, right.cells) >= ROW_SHARE
        if own:
            np.fill_diagonal(hit, left.n > 1)
        for side, at in ((left, hit.any(1)), (right, hit.any(0))):
            found.update(((side.values[k], tuple(side.cells[k])), None) for k in np.flatnonzero(at))
    yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([list(c) for _, c in found], pa.list_(pa.string()))], names=["value", "cells"])


def _scored_against(value: str):
    words = [sorted_tokens(value)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = ratio_table(words, [sorted_tokens(v) for v in batch.column("value").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores[0], pa.float64())], names=[*batch.schema.names, "similarity"])

    return run


def _block(n: int) -> Column:
    return t.block_key(F.col("value")) if n > BLOCKING_ABOVE else F.lit("")


def block_values(candidates: DataFrame, n: int) -> DataFrame:
    """``candidates``: _row_id, value.  block, value and its number of rows; one block up to 800 rows."""
    return candidates.groupBy("value").agg(F.count("*").alias("n")).select(_block(n).alias("block"), "value", "n")


def pairings(values: DataFrame, copies: bool = False) -> DataFrame:
    """Of all pairs of rows within blocks, rows of score (two decimals) and n, and rows of value and best (unrounded)."""
    return _tiles(values).mapInArrow(_pairings(copies), "score double, n long, value string, best double")


def _by_score(paired: DataFrame) -> DataFrame:
    return paired.where("score IS NOT NULL").groupBy("score").agg(F.sum("n").alias("n"))


def score_histogram(values: DataFrame) -> DataFrame:
    """score (two decimals) and number of row pairs, over all pairs of rows within blocks."""
    return _by_score(pairings(values))


def value_pairs(values: DataFrame, threshold: float) -> DataFrame:
    """value_a, value_b, similarity of all pairs of values in a block at or above the threshold."""
    return _tiles(values).mapInArrow(_matching(threshold), "value_a string, value_b string, similarity double")


def _cells(columns: list[str]) -> list[Column]:
    return [F.lower(t.strip(F.coalesce(F.col(c), F.lit("nan")))) for c in columns]


def repeated_cells(candidates: DataFrame, n_cells: int) -> DataFrame:
    """``candidates``: block, value, cells.  value and cells of rows that another row of a (nearly) equal value equals
    in enough cells.

    Rows that differ in at most d cells are equal in one of d + 1 parts of them, and values that are nearly equal
    without having the same words are long: only rows that share such a part, and their words or length, meet.
    """
    least = next(k for k in range(n_cells + 1) if k / n_cells >= ROW_SHARE)
    parts = [F.array(*[F.col("cells")[i] for i in range(p, n_cells, n_cells - least + 1)]) for p in range(n_cells - least + 1)]
    words = F.array_join(F.array_sort(F.filter(F.split("value", SPACES), lambda w: w != "")), " ")
    meet = F.struct(F.col("block").alias("block"), F.when(F.length(words) < LEAST_LONG, words).alias("words"))
    items = candidates.groupBy("block", "value", "cells").agg(F.count("*").alias("n")).withColumn("meet", F.to_json(meet))
    items = items.select("meet", "value", "cells", "n", F.posexplode(F.array(*parts)).alias("part", "equal"))
    items = items.select(F.to_json(F.struct("meet", "part", "equal")).alias("block"), "value", "cells", "n")
    return _tiles(items).mapInArrow(_repeated, "value string, cells array<string>").distinct()


def fuzzy_rows(candidates: DataFrame, paired: DataFrame, threshold: float, n_cells: int | None) -> DataFrame:
    """_row_id of every row that is in a pair of ``row_pairs``, without making the pairs.  ``candidates``: _row_id,
    block, value, cells; ``n_cells``: their number (``None``: there are no other columns, and ``paired`` has copies)."""
    rows = candidates.join(paired.where(F.col("best") >= threshold).select("value").distinct(), "value", "left_semi").select("_row_id")
    if n_cells:
        rows = rows.unionByName(candidates.join(repeated_cells(candidates, n_cells), ["value", "cells"], "left_semi").select("_row_id")).distinct()
    return rows


def _first_pair(candidates: DataFrame, first: int, threshold: float, n_cells: int | None) -> tuple[str, str]:
    """Values of row ``first``, the least row that is in a pair, and of the least row that it makes one with."""
    row = candidates.where(F.col("_row_id") == first).first()
    others = candidates.where((F.col("_row_id") > first) & (F.col("block") == row.block))
    scored = others.mapInArrow(_scored_against(row.value), "_row_id long, block string, value string, cells array<string>, similarity double")
    pair = F.col("similarity") >= threshold
    if n_cells is not None:
        same = reduce(lambda x, y: x + y, [(F.col("cells")[i] == F.lit(c)).cast("int") for i, c in enumerate(row.cells)], F.lit(0))
        pair = pair & ((F.col("similarity") < EXACT_SCORE) | (same / max(n_cells, 1) >= ROW_SHARE))
    return row.value, scored.where(pair).agg(F.min_by("value", "_row_id").alias("value")).first().value


def row_pairs(df: DataFrame, candidates: DataFrame, matches: DataFrame, informative: list[str] | None) -> DataFrame:
    """row_a < row_b of matching values; where those are (nearly) equal, only if enough of the informative
    columns agree (``None``: there are no other columns, so any pair counts)."""
    a = candidates.select(F.col("_row_id").alias("id_1"), F.col("value").alias("value_a"))
    b = candidates.select(F.col("_row_id").alias("id_2"), F.col("value").alias("value_b"))
    pairs = matches.join(a, "value_a").join(b, "value_b").where((F.col("value_a") != F.col("value_b")) | (F.col("id_1") < F.col("id_2")))
    swap = F.col("id_1") > F.col("id_2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = pairs.select(pick("id_1", "id_2").alias("row_a"), pick("id_2", "id_1").alias("row_b"), pick("value_a", "value_b").alias("value_a"), pick("value_b", "value_a").alias("value_b"), "similarity")
    if informative is None:
        return pairs
    sure, near = pairs.where(F.col("similarity") < EXACT_SCORE), pairs.where(F.col("similarity") >= EXACT_SCORE)
    if not informative:
        return sure
    cells = _cells(informative)
    one = df.select(F.col("_row_id").alias("row_a"), *[c.alias(f"l_{n}") for c, n in zip(cells, informative, strict=True)])
    two = df.select(F.col("_row_id").alias("row_b"), *[c.alias(f"r_{n}") for c, n in zip(cells, informative, strict=True)])
    same = reduce(lambda x, y: x + y, [(F.col(f"l_{n}") == F.col(f"r_{n}")).cast("int") for n in informative])
    near = near.join(one, "row_a").join(two, "row_b").where(same / len(informative) >= ROW_SHARE).select(*pairs.columns)
    return sure.unionByName(near)


def duplication(table: Table) -> DuplicationResult:
    columns = [f"c{i}" for i in range(len(table.names))]
    exact = exact_duplicates(table.df, columns).persist()
    shapes = {r.col: r for r in column_shapes(table.profile).collect()}
    identity = choose_identity(table.names, table.types, {i: (r.present, r["values"]) for i, r in shapes.items()})
    out = DuplicationResult(exact.count(), identity, duplicate_threshold({}), table.n_rows, exact=exact)
    out.rows_involved = out.exact_rows
    if identity is None:
        return out
    own = table.column(identity)
    poor = low_information(table.names, identity, {i: (r.present, r.largest) for i, r in shapes.items()})
    others = [n for n in table.names if n != identity]
    informative = [table.column(n) for n in others if n not in poor] if others else None
    n_cells = None if informative is None else len(informative)
    value, cells = t.strip(F.col(own)), F.array(*_cells(informative or [])).cast("array<string>")
    rows = table.df.where(value != "").select("_row_id", value.alias("value"), cells.alias("cells")).join(exact, "_row_id", "left_anti").persist()
    n = rows.count()
    candidates = rows.select("_row_id", _block(n).alias("block"), "value", "cells")
    values = block_values(rows, n).persist()
    paired = pairings(values, n_cells is None).persist()
    # at most 10,001 rows, as scores have two decimals
    out.histogram = {r.score: r.n for r in _by_score(paired).collect()}
    out.threshold = duplicate_threshold(out.histogram)
    # no candidate is an exact repeat
    found = fuzzy_rows(candidates, paired, out.threshold.value, n_cells).agg(F.count("*").alias("n"), F.min("_row_id").alias("first")).first()
    out.fuzzy_rows = found.n
    out.rows_involved = out.exact_rows + found.n
    out.first_pair = _first_pair(candidates, found.first, out.threshold.value, n_cells) if found.n else None
    out.pairs = row_pairs(table.df, rows.select("_row_id", "value"), value_pairs(values, out.threshold.value), informative)
    for kept in (paired, values, rows):
        kept.unpersist()
    return out


def duplicated_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The window form of exact repeats: every row with its number among its equals (1 for the first)."""
    return df.withColumn("copy", F.row_number().over(Window.partitionBy(*columns).orderBy("_row_id")))
