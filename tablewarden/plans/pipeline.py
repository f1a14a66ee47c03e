"""The scorecard of a table and of a batch of tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.text import NULL_CELLS
from tablewarden.operators import checks, duplication, validity
from tablewarden.operators.calibration import Threshold
from tablewarden.operators.profile import Table, prepare
from tablewarden.plans import findings as f
from tablewarden.plans.phrasing import phrase_all

# Weights of the dimensions, with and without validity.
WEIGHTS = {"completeness": 0.27, "consistency": 0.22, "duplication": 0.20, "validity": 0.16, "structure": 0.15}
WEIGHTS_WITHOUT_VALIDITY = {"completeness": 0.30, "consistency": 0.25, "duplication": 0.25, "structure": 0.20}
STAGES = ("profile", "completeness", "consistency", "duplication", "structure", "validity", "score", "fix list")


@dataclass
class Scorecard:
    overall: float
    dimensions: dict[str, float]
    columns: dict[str, dict[str, float]]


@dataclass
class TableResult:
    table: Table
    scorecard: Scorecard
    findings: list[f.Finding]
    critical: Threshold
    moderate: Threshold
    completeness: checks.DimensionResult
    consistency: checks.DimensionResult
    duplication: duplication.DuplicationResult
    structure: checks.StructureResult
    validity: validity.ValidityResult

    def release(self) -> None:
        """Drop what the table keeps in the executors, once charts and cleaning are done; later use works it out again."""
        self.table.profile.unpersist()
        self.duplication.release()


@dataclass
class TableFailure:
    name: str
    error: str


@dataclass
class Summary:
    results: list[TableResult] = field(default_factory=list)
    failures: list[TableFailure] = field(default_factory=list)

    @property
    def overall(self) -> float:
        scores = [r.scorecard.overall for r in self.results]
        return round(sum(scores) / len(scores), 2) if scores else 0.0

    @property
    def findings(self) -> list[f.Finding]:
        return sorted((x for r in self.results for x in r.findings), key=lambda x: (f.RANK[x.severity], -x.percentage))

    def severities(self) -> dict[str, int]:
        return {s: sum(x.severity == s for x in self.findings) for s in f.RANK}


def tier(score: float) -> str:
    return "good" if score >= 80 else "warn" if score >= 50 else "bad"


def scorecard(completeness, consistency, duplication, structure, validity=None) -> Scorecard:
    """Weighted overall score; per column the mean of its scores."""
    scores = {"completeness": completeness.score, "consistency": consistency.score, "duplication": duplication.score, "structure": structure.score}
    if validity is not None:
        scores["validity"] = validity.score
    weights = WEIGHTS if validity is not None else WEIGHTS_WITHOUT_VALIDITY
    parts = {"completeness": completeness, "consistency": consistency} | ({"validity": validity} if validity is not None else {})
    columns: dict[str, dict[str, float]] = {}
    for dimension, result in parts.items():
        for c in result.columns:
            columns.setdefault(c.name, {})[dimension] = c.score
    for c in columns.values():
        c["combined"] = round(sum(c.values()) / len(c), 2)
    return Scorecard(round(sum(weights[d] * scores[d] for d in weights), 2), scores, columns)


def score_table(table: Table, on_stage: Callable[[str], None] | None = None, parallel: bool = True, model: Callable[[str], str] | None = None, overrides: dict | None = None, as_of_year: int | None = None, types: dict[str, str] | None = None) -> TableResult:
    """All checks of one table; ``on_stage`` is told of each stage before it starts.

    The dimensions need nothing of each other, so their jobs share the cluster unless ``parallel`` is off.
    """
    tell = on_stage or (lambda stage: None)
    tell(STAGES[0])
    prepare(table, types)
    steps = (("completeness", checks.completeness), ("consistency", checks.consistency), ("duplication", duplication.duplication), ("structure", checks.structure), ("validity", lambda t: validity.validity(t, overrides, as_of_year)))
    with ThreadPoolExecutor(len(steps) if parallel else 1) as pool:
        started = {}
        for name, run in steps:
            tell(name)
            started[name] = pool.submit(run, table)
            if not parallel:
                started[name].result()
        done = {name: job.result() for name, job in started.items()}
    tell("score")
    card = scorecard(*done.values())
    tell("fix list")
    raw = f.collect(table.types, **done)
    found, critical, moderate = f.grade(raw, table.name)
    phrase_all(found, model)
    return TableResult(table, card, found, critical, moderate, **done)


def rescore(result: TableResult, cleaned: DataFrame, **options) -> TableResult:
    """The scorecard of a cleaned table (``_row_id`` and the table's columns), as if its file were read again."""
    columns = [F.when(F.col(f"`{n}`").isin(*NULL_CELLS), None).otherwise(F.col(f"`{n}`")).alias(f"c{i}") for i, n in enumerate(result.table.names)]
    return score_table(Table(f"{result.table.name} (cleaned)", cleaned.select("_row_id", *columns), list(result.table.names)), **options)


def score_all(spark: SparkSession, paths: list[str], **options) -> Summary:
    """Every table of every file; a table that can't be read or scored becomes a failure and stops nothing."""
    from tablewarden.sources.files import load_all_tables

    out = Summary()
    for path in paths:
        for name, table, error in load_all_tables(spark, path):
            if table is None:
                out.failures.append(TableFailure(name, error))
                continue
            try:
                out.results.append(score_table(table, **options))
            except Exception as e:  # isolation of tables is the point
                out.failures.append(TableFailure(name, f"This table couldn't be scored: {e}"))
    return out


def findings_frame(spark: SparkSession, found: list[f.Finding]) -> DataFrame:
    rows = [(i, x.table, x.column, x.check, x.issue, x.percentage, x.severity, x.display, x.example) for i, x in enumerate(found)]
    return spark.createDataFrame(rows, "position int, table_name string, column_name string, check_type string, issue_type string, percentage double, severity string, description string, example string")


def columns_frame(spark: SparkSession, result: TableResult) -> DataFrame:
    rows = [(i, n, result.table.types[n], s.get("completeness"), s.get("consistency"), s.get("validity"), s["combined"]) for i, (n, s) in enumerate(result.scorecard.columns.items())]
    return spark.createDataFrame(rows, "position int, column_name string, column_type string, completeness double, consistency double, validity double, combined double")


def profile_stages(table: Table) -> dict[str, float]:
    """Seconds of each stage of ``score_table``, one after another."""
    marks: list[tuple[str, float]] = []
    score_table(table, on_stage=lambda s: marks.append((s, time.perf_counter())), parallel=False).release()
    ends = [at for _, at in marks[1:]] + [time.perf_counter()]
    return {s: end - at for (s, at), end in zip(marks, ends, strict=True)}
