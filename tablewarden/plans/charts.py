"""One chart dataset per column: a histogram, category counts or counts by month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import text as t
from tablewarden.operators.profile import BOOLEAN, DATE, NUMERIC, TEXT, Table
from tablewarden.plans.findings import Finding

BINS, TOP, FEW = 10, 10, 3  # fixed values: bins of a histogram, categories shown, values worth a chart
LABELS = {
    "missing_data": "missing", "inconsistent_format_numeric": "inconsistent format", "inconsistent_format_date": "inconsistent format",
    "inconsistent_format_text": "inconsistent format", "invalid_type_in_numeric": "invalid", "invalid_type_in_date": "invalid",
    "categorical_inconsistency": "inconsistent spelling", "domain_outlier": "out of range", "missing_value_representation": "disguised missing",
}


@dataclass
class Chart:
    column: str
    kind: str
    annotation: str | None
    rows: list[tuple[str, int]]


def histogram(values: DataFrame) -> DataFrame:
    """``values``: x, cnt.  bucket (from 1), lo, hi, n of equal-width buckets, closed on the right."""
    known = values.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("x").agg(F.sum("cnt").alias("cnt"))
    size = known.agg(F.min("x").alias("least"), F.max("x").alias("most"), F.least(F.count("*"), F.lit(BINS)).cast("int").alias("bins")).where("bins > 0")
    placed = known.crossJoin(F.broadcast(size))  # one row
    width = (F.col("most") - F.col("least")) / F.col("bins")
    bucket = F.when(F.col("bins") == 1, 1).otherwise(F.greatest(F.lit(1), F.least(F.col("bins"), F.ceil((F.col("x") - F.col("least")) / width).cast("int"))))
    counts = placed.groupBy(bucket.alias("bucket")).agg(F.sum("cnt").alias("n"))
    frame = size.select(F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bucket"), "least", width.alias("width"))
    out = frame.join(counts, "bucket", "left")
    return out.select("bucket", (F.col("least") + (F.col("bucket") - 1) * F.col("width")).alias("lo"), (F.col("least") + F.col("bucket") * F.col("width")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def category_counts(values: DataFrame) -> DataFrame:
    """``values``: v, cnt, first_row.  label, n, place: the ten most frequent, then Other."""
    counts = values.groupBy("v").agg(F.sum("cnt").alias("n"), F.min("first_row").alias("first_row"))
    top = counts.orderBy(F.desc("n"), "first_row", "v").limit(TOP)
    total = counts.agg(F.sum("n").alias("all_rows"))
    shown = top.agg(F.sum("n").alias("in_top"))
    rest = total.crossJoin(shown).select(F.lit("Other").alias("label"), (F.col("all_rows") - F.col("in_top")).alias("n"), F.lit(None).cast("long").alias("first_row")).where("n > 0")
    return top.select(F.col("v").alias("label"), "n", "first_row").unionByName(rest)


def month_counts(values: DataFrame) -> DataFrame:
    """``values``: v, cnt.  month and n, ascending."""
    day = t.parsed_date(F.col("v"))
    return values.select(F.date_format(day, "yyyy-MM").alias("month"), "cnt").where("month IS NOT NULL").groupBy("month").agg(F.sum("cnt").alias("n")).orderBy("month")


def annotation(column: str, findings: list[Finding]) -> str | None:
    f = next((f for f in findings if f.column == column and f.issue in LABELS), None)
    return f"⚠ {f.percentage:.1f}% {LABELS[f.issue]}" if f else None


def charts(table: Table, findings: list[Finding]) -> list[Chart]:
    out = []
    for i, n in enumerate(table.names):
        values = table.profile.where((F.col("col") == i) & ~t.is_blank(F.col("raw"))).select(t.strip(F.col("raw")).alias("v"), "cnt", "first_row")
        kind, note = table.types[n], annotation(n, findings)
        if kind == NUMERIC:
            rows = histogram(values.select(F.col("v").try_cast("double").alias("x"), "cnt")).orderBy("bucket").collect()
            chart = Chart(n, "numeric_distribution", note, [(f"({r.lo:.4g}, {r.hi:.4g}]", r.n) for r in rows])
        elif kind in (TEXT, BOOLEAN):
            rows = category_counts(values).collect()
            chart = Chart(n, "category_counts", note, [(r.label, r.n) for r in sorted(rows, key=lambda r: (r.first_row is None, -r.n, r.first_row or 0))])
        elif kind == DATE:
            chart = Chart(n, "date_over_time", note, [(r.month, r.n) for r in month_counts(values).collect()])
        else:
            chart = Chart(n, "unsupported", note, [])
        out.append(chart if chart.rows else Chart(n, "unsupported", note, []))
    return out


def low_cardinality_note(table: Table, name: str) -> str | None:
    """A sentence in place of a chart of fewer than three different values."""
    i = table.names.index(name)
    values = table.profile.where((F.col("col") == i) & ~t.is_blank(F.col("raw"))).groupBy(t.strip(F.col("raw")).alias("v")).agg(F.sum("cnt").alias("n"), F.min("first_row").alias("first_row"))
    rows = values.orderBy(F.desc("n"), "first_row").limit(FEW).collect()
    if len(rows) >= FEW:
        return None
    if not rows:
        return f"'{name}' has no values."
    total = values.agg(F.sum("n")).first()[0]
    return f"'{name}' has {len(rows)} different value(s); the most frequent is '{rows[0].v}' ({rows[0].n / total:.0%} of the rows)."
