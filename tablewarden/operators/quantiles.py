"""Exact quantiles of columns with any number of distinct values.

No task and no driver ever holds a column: a bracket around each wanted rank shrinks, cut by cut, until it has few
distinct values, and only those are put in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 4096  # distinct values that are put in order in one task
CUTS = 64  # parts of a bracket that is too large


@dataclass
class _Bracket:
    """The values of a column above ``low`` up to ``high`` (None: no bound), ``below`` rows before them."""

    col: int
    low: float | None
    high: float | None
    below: int
    distinct: int
    ranks: list[int] = field(default_factory=list)

    def holds(self) -> Column:
        x, held = F.col("x"), F.col("col") == self.col
        if self.low is not None:
            held = held & (x > self.low)
        return held if self.high is None else held & (x <= self.high)


def _numbered(values: DataFrame, brackets: list[_Bracket], extra: list[Column]) -> DataFrame:
    """The rows of the brackets, with the number of their bracket and what ``extra`` has for it."""
    number, other = F.lit(None).cast("int"), F.lit(None)
    for i, b in reversed(list(enumerate(brackets))):
        number, other = F.when(b.holds(), i).otherwise(number), F.when(b.holds(), extra[i]).otherwise(other)
    return values.select("x", "cnt", number.alias("bracket"), other.alias("extra")).where("bracket IS NOT NULL")


def _numbers(xs: list, kind: str) -> Column:
    return F.array(*map(F.lit, xs)).cast(f"array<{kind}>")


def _shrunk(values: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """Each bracket cut in parts of about equally many distinct values; the parts that hold wanted ranks."""
    none = [F.lit(None).cast("array<double>")] * len(brackets)
    at = F.percentile_approx("x", [i / CUTS for i in range(1, CUTS)])
    cuts = {r.bracket: sorted(set(r.cuts)) for r in _numbered(values, brackets, none).groupBy("bracket").agg(at.alias("cuts")).collect()}
    parts = _numbered(values, brackets, [_numbers(cuts[i], "double") for i in range(len(brackets))])
    parts = parts.withColumn("part", F.size(F.filter("extra", lambda cut: cut < F.col("x"))))
    edges = [[b.low, *cuts[i], b.high] for i, b in enumerate(brackets)]
    below, out = [b.below for b in brackets], []
    for r in parts.groupBy("bracket", "part").agg(F.sum("cnt").alias("n"), F.count("*").alias("distinct")).orderBy("bracket", "part").collect():
        b = brackets[r.bracket]
        ranks = [k for k in b.ranks if below[r.bracket] <= k < below[r.bracket] + r.n]
        if ranks:
            out.append(_Bracket(b.col, *edges[r.bracket][r.part : r.part + 2], below[r.bracket], r["distinct"], ranks))
        below[r.bracket] += r.n
    return out


def exact_quantiles(values: DataFrame, shares: tuple[float, ...]) -> dict[int, tuple[list[float], int]]:
    """``values``: col, x (not null) and cnt, the number of rows that a value stands for.

    For each col the quantiles at ``shares``, linear between neighbouring rows, and its number of distinct values.
    """
    values = values.groupBy("col", "x").agg(F.sum("cnt").alias("cnt")).persist()
    try:
        totals = {r.col: (r.n, r["distinct"]) for r in values.groupBy("col").agg(F.sum("cnt").alias("n"), F.count("*").alias("distinct")).collect()}
        places = {c: [share * (n - 1) for share in shares] for c, (n, _) in totals.items()}
        brackets = [_Bracket(c, None, None, 0, totals[c][1], sorted({k for p in at for k in (floor(p), ceil(p))})) for c, at in places.items()]
        while any(b.distinct > MOST for b in brackets):
            brackets = [b for b in brackets if b.distinct <= MOST] + _shrunk(values, [b for b in brackets if b.distinct > MOST])
        rows = []
        if brackets:
            # rows up to and with each value, ranks counted from the start of the bracket
            inside = _numbered(values, brackets, [_numbers([k - b.below for k in b.ranks], "long") for b in brackets])
            inside = inside.withColumn("upto", F.sum("cnt").over(Window.partitionBy("bracket").orderBy("x")))
            held = F.filter("extra", lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("cnt")))
            rows = inside.withColumn("held", held).where(F.size("held") > 0).select("bracket", "x", "held").collect()
    finally:
        values.unpersist()
    found = {(brackets[r.bracket].col, k + brackets[r.bracket].below): r.x for r in rows for k in r.held}

    def between(c: int, place: float) -> float:
        a, b = found[c, floor(place)], found[c, ceil(place)]
        return a if a == b else (ceil(place) - place) * a + (place - floor(place)) * b

    return {c: ([between(c, p) for p in at], totals[c][1]) for c, at in places.items()}
