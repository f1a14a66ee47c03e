"""Tables of string cells, and their value profile: every distinct value of every column with its count and
first row.  Almost every check on a column is an aggregate over the profile, with counts as weights."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import text as t

TYPE_SHARE = 0.7  # fixed value: share of values that decides a type
NUMERIC, TEXT, DATE, BOOLEAN, UNKNOWN = "numeric", "text", "date", "boolean", "unknown"
EMPTY_MESSAGE = "There are no data rows below the header."


@dataclass
class Table:
    """``df``: _row_id (unique, in row order) and string columns c0, c1, ... whose names are ``names``."""

    name: str
    df: DataFrame
    names: list[str]
    n_rows: int = 0
    types: dict[str, str] = field(default_factory=dict)
    ragged_rows: int = 0
    data_records: int = 0
    skipped_rows: int = 0
    encoding_warning: str | None = None
    profile: DataFrame | None = None

    def column(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def named(self) -> DataFrame:
        """The cells under their own names, in row order's columns only."""
        return self.df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(self.names)])


def from_dataframe(df: DataFrame, name: str, key: str) -> Table:
    """``key``: a unique whole-number column that gives the row order; it stays a column of the table."""
    cells = [F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)]
    return Table(name, df.select(F.col(f"`{key}`").cast("long").alias("_row_id"), *cells), list(df.columns))


def value_profile(table: Table) -> DataFrame:
    """col (position), raw, cnt, first_row."""
    columns = [f"c{i}" for i in range(len(table.names))]
    entries = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).alias("raw")) for i, c in enumerate(columns)])
    cells = table.df.select("_row_id", F.explode(entries).alias("x")).select("_row_id", "x.col", "x.raw")
    return cells.groupBy("col", "raw").agg(F.count("*").alias("cnt"), F.min("_row_id").alias("first_row"))


def prepare(table: Table, as_types: dict[str, str] | None = None) -> Table:
    """Profile the table and infer its types; an empty table is an error."""
    if not table.names:
        raise ValueError(EMPTY_MESSAGE)
    table.profile = value_profile(table).persist()
    rows = {r.col: r for r in _type_counts(table.profile).collect()}
    table.n_rows = max((r.n_rows for r in rows.values()), default=0)
    if not table.n_rows:
        raise ValueError(EMPTY_MESSAGE)
    table.types = {n: _type_of(rows[i]) for i, n in enumerate(table.names)} | (as_types or {})
    return table


def _type_counts(profile: DataFrame) -> DataFrame:
    v = t.strip(F.col("raw"))
    word = F.lower(v)
    present = ~t.is_blank(F.col("raw"))
    # two steps, so that distinct words are counted without a second shuffle of every value
    words = profile.select("col", "cnt", F.when(present, word).alias("word"), *[c.alias(n) for n, c in (("n", F.when(present, F.col("cnt"))), ("b", F.when(present & word.isin(*t.BOOLEAN_WORDS), F.col("cnt"))), ("d", F.when(present & t.looks_date(v), F.col("cnt"))), ("x", F.when(present & t.looks_numeric(v), F.col("cnt"))))])
    words = words.groupBy("col", "word").agg(*[F.sum(c).alias(c) for c in ("cnt", "n", "b", "d", "x")])
    return words.groupBy("col").agg(F.sum("cnt").alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("present"), F.coalesce(F.sum("b"), F.lit(0)).alias("booleans"), F.coalesce(F.sum("d"), F.lit(0)).alias("dates"), F.coalesce(F.sum("x"), F.lit(0)).alias("numbers"), F.count("word").alias("words"))


def _type_of(r) -> str:
    if not r.present:
        return UNKNOWN
    if r.booleans / r.present >= TYPE_SHARE and r.words <= 2:
        return BOOLEAN
    if r.dates / r.present >= TYPE_SHARE:
        return DATE
    if r.numbers / r.present >= TYPE_SHARE:
        return NUMERIC
    return TEXT


def infer_types(profile: DataFrame) -> DataFrame:
    """col, its counts and inferred_type, as a query."""
    share = lambda c: F.col(c) / F.col("present") >= TYPE_SHARE
    kind = F.when(F.col("present") == 0, UNKNOWN).when(share("booleans") & (F.col("words") <= 2), BOOLEAN).when(share("dates"), DATE).when(share("numbers"), NUMERIC).otherwise(TEXT)
    return _type_counts(profile).withColumn("inferred_type", kind)
