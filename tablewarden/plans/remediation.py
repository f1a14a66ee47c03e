"""Cleaning: every finding is either repaired, with an audit entry, or left for manual review.

Repairs are column expressions applied one after another, each to what the one before left.  The values
before and after every step stay beside the cells until one aggregate has counted all changes and fetched
the first example of each; only steps that need a statistic of the cleaned column (a median, a mode, a
dominant spelling) run a query of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions import text as t
from tablewarden.operators.duplication import DuplicationResult
from tablewarden.operators.profile import Table
from tablewarden.operators.quantiles import exact_quantiles
from tablewarden.plans.findings import Finding

CASE_SHARE = 0.8  # fixed value: share of a spelling that may set the case of the rest
LEAVE, DROP_ROW, CONSTANT, MEDIAN, MODE = "leave", "drop_row", "constant", "median", "mode"
BLANK, CLIP = "blank", "clip"


@dataclass(frozen=True)
class CleaningConfig:
    normalize_case: bool = False
    fuzzy_threshold: float = 88.0
    outliers: str = BLANK
    missing: str = LEAVE
    constant: str = ""
    overrides: dict[str, dict] = field(default_factory=dict)


PRESETS = {
    "Conservative": CleaningConfig(),
    "Standard": CleaningConfig(normalize_case=True, fuzzy_threshold=90.0),
    "Aggressive": CleaningConfig(normalize_case=True, fuzzy_threshold=88.0, outliers=CLIP),
}


@dataclass
class Action:
    column: str
    action: str
    count: int
    before: str | None
    after: str | None
    finding: Finding
    notes: str | None = None


@dataclass
class Review:
    finding: Finding
    reason: str


@dataclass
class Remediation:
    cleaned: DataFrame
    actions: list[Action]
    reviews: list[Review]


@dataclass
class _Step:
    finding: Finding
    action: str
    refused: str
    notes: str | None = None
    shown: Callable[[str | None], str | None] = lambda v: v
    declined: Column | None = None


class _Cleaner:
    def __init__(self, table: Table, config: CleaningConfig, duplicates: DuplicationResult | None):
        self.table, self.config, self.duplicates = table, config, duplicates
        self.df = table.df.withColumn("_gone", F.lit(False)).withColumn("_drop", F.lit(False))
        self.actions: dict[int, Action] = {}
        self.reviews: dict[int, Review] = {}
        self.pending: dict[int, _Step] = {}

    def change(self, k: int, finding: Finding, value: Callable[[Column], Column], step: _Step) -> None:
        c = self.table.column(finding.column)
        self.df = self.df.withColumn(f"_b{k}", F.col(c)).withColumn(f"_a{k}", F.when(F.col("_gone"), F.col(c)).otherwise(value(F.col(c)))).withColumn(c, F.col(f"_a{k}"))
        if step.declined is not None:
            self.df = self.df.withColumn(f"_d{k}", step.declined)
        self.pending[k] = step

    def run(self, findings: list[Finding]) -> Remediation:
        for k, f in enumerate(findings):
            needs_column = f.issue not in ("exact_duplicate_rows", "fuzzy_duplicate_rows", "structural_issue")
            if needs_column and f.column not in self.table.names:
                self.reviews[k] = Review(f, f"Column '{f.column}' isn't in the data.")
                continue
            handler = getattr(self, f"on_{f.issue}", None)
            if handler is None:
                self.reviews[k] = Review(f, "This kind of finding has no automatic repair.")
            else:
                handler(k, f)
        self.settle()
        columns = [F.col(f"c{i}").alias(n) for i, n in enumerate(self.table.names)]
        cleaned = self.df.where(~F.col("_gone") & ~F.col("_drop")).select("_row_id", *columns)
        return Remediation(cleaned, [self.actions[k] for k in sorted(self.actions)], [self.reviews[k] for k in sorted(self.reviews)])

    def settle(self) -> None:
        """Counts and first examples of all steps, in one aggregate."""
        if not self.pending:
            return
        sums = []
        for k in self.pending:
            changed = ~F.col(f"_b{k}").eqNullSafe(F.col(f"_a{k}"))
            sums.append(F.count_if(changed).alias(f"n{k}"))
            sums.append(F.min(F.when(changed, F.struct("_row_id", F.col(f"_b{k}").alias("before"), F.col(f"_a{k}").alias("after")))).alias(f"x{k}"))
            if f"_d{k}" in self.df.columns:
                sums.append(F.count_if(F.col(f"_d{k}") & ~F.col("_gone")).alias(f"d{k}"))
        row = self.df.agg(*sums).first().asDict()
        for k, step in self.pending.items():
            left = row.get(f"d{k}") or 0
            if not row[f"n{k}"]:
                self.reviews[k] = Review(step.finding, step.refused)
                continue
            x = row[f"x{k}"]
            after = step.shown(x["after"]) if x["after"] is not None else "(blank)"
            notes = step.notes or (f"{left} value(s) were left alone as their meaning isn't certain." if left else None)
            self.actions[k] = Action(step.finding.column, step.action, row[f"n{k}"], step.shown(x["before"]) if x["before"] is not None else "(blank)", after, step.finding, notes)

    # -- one method for each kind of finding

    def on_inconsistent_format_numeric(self, k: int, f: Finding) -> None:
        self._guarded(k, f, t.clean_number, ~t.is_plain_number(F.col(self.table.column(f.column))), "strip_numeric_formatting", "Every value's grouping is ambiguous.")

    def on_inconsistent_format_date(self, k: int, f: Finding) -> None:
        self._guarded(k, f, t.clean_date, F.lit(True), "normalize_date_format", "Day and month can't be told apart in any value.")

    def _guarded(self, k: int, f: Finding, clean: Callable[[Column], Column], wanted: Column, action: str, refused: str) -> None:
        c = F.col(self.table.column(f.column))
        present = ~t.is_blank(c)
        self.change(k, f, lambda v: F.when(present, F.coalesce(clean(v), v)).otherwise(v), _Step(f, action, refused, declined=present & wanted & clean(c).isNull()))

    def on_inconsistent_format_text(self, k: int, f: Finding) -> None:
        usual = self._dominant_case(f) if self.config.normalize_case else None

        def value(v: Column) -> Column:
            bare = t.strip(v)
            return bare if usual is None else F.when(F.lower(bare) == usual.lower(), F.lit(usual)).otherwise(bare)

        notes = f"Case follows the dominant spelling '{usual}'." if usual is not None else None
        self.change(k, f, value, _Step(f, "trim_whitespace", "No white space to trim; other differences aren't repaired automatically.", notes, shown=repr))

    def _live(self) -> DataFrame:
        return self.df.where(~F.col("_gone"))

    def _dominant_case(self, f: Finding) -> str | None:
        c = F.col(self.table.column(f.column))
        counts = self._live().where(~t.is_blank(c)).groupBy(t.strip(c).alias("v")).agg(F.count("*").alias("n"), F.min("_row_id").alias("first"))
        r = counts.agg(F.min(F.struct(-F.col("n"), "first", "v")).alias("best"), F.sum("n").alias("all")).first()
        return r.best[2] if r.best is not None and -r.best[0] / r["all"] >= CASE_SHARE else None

    def on_invalid_type_in_numeric(self, k: int, f: Finding) -> None:
        self.change(k, f, lambda v: F.when(t.coerced(t.strip(v)).isNotNull(), v), _Step(f, "coerce_invalid_numeric", "No invalid values were left.", "Values that aren't numbers were set to blank."))

    def on_invalid_type_in_date(self, k: int, f: Finding) -> None:
        self.change(k, f, lambda v: F.when(t.is_date(t.strip(v)), v), _Step(f, "coerce_invalid_date", "No invalid values were left.", "Values that aren't dates were set to blank."))

    def on_missing_value_representation(self, k: int, f: Finding) -> None:
        self.change(k, f, lambda v: F.when(~t.is_token(v), v), _Step(f, "normalize_missing_token", "No stand-ins for missing values were left."))

    def on_categorical_inconsistency(self, k: int, f: Finding) -> None:
        trusted = {key: m["canonical"] for key, m in f.details["canonical"].items() if m["score"] >= self.config.fuzzy_threshold}
        weak = len(f.details["canonical"]) - len(trusted)
        refused = "No mapping is certain enough for the chosen threshold."
        if not trusted:
            self.reviews[k] = Review(f, refused)
            return
        table = F.create_map(*[F.lit(x) for pair in sorted(trusted.items()) for x in pair])
        notes = f"{weak} less certain mapping(s) were left for review." if weak else None
        self.change(k, f, lambda v: F.coalesce(F.when(~t.is_blank(v), F.element_at(table, t.category_key(v))), v), _Step(f, "standardize_categorical_spelling", refused, notes))

    def on_domain_outlier(self, k: int, f: Finding) -> None:
        d = f.details
        clip = self.config.outliers == CLIP and "allowed" not in d

        def value(v: Column) -> Column:
            x = t.coerced(t.strip(v))
            if "allowed" in d:
                return F.when(x.isNull() | x.isin(*[float(a) for a in d["allowed"]]), v)
            low, high = d.get("lower"), d.get("upper")
            below = F.lit(False) if low is None else (x <= low) if d.get("exclusive") else (x < low)
            above = F.lit(False) if high is None else x > high
            out = F.when(F.coalesce(below, F.lit(False)), F.lit(f"{low:g}") if clip and low is not None and not d.get("exclusive") else F.lit(None).cast("string"))
            return out.when(F.coalesce(above, F.lit(False)), F.lit(f"{high:g}") if clip and high is not None else F.lit(None).cast("string")).otherwise(v)

        notes = "Values out of range were moved to the nearest bound." if clip else "Values out of range were set to blank."
        self.change(k, f, value, _Step(f, "clip_domain_outlier" if clip else "neutralize_domain_outlier", "No value was out of range any more.", notes))

    def on_exact_duplicate_rows(self, k: int, f: Finding) -> None:
        n = self.duplicates.exact_rows if self.duplicates is not None else 0
        if not n:
            self.reviews[k] = Review(f, "No exact duplicates to remove.")
            return
        ids = self.duplicates.exact.select("_row_id", F.lit(True).alias("_copy"))
        self.df = self.df.join(ids, "_row_id", "left").withColumn("_gone", F.col("_gone") | F.coalesce("_copy", F.lit(False))).drop("_copy")
        self.actions[k] = Action(f.column, "remove_exact_duplicate_rows", n, f"{n} repeated row(s)", "row(s) removed", f)

    def on_missing_data(self, k: int, f: Finding) -> None:
        how, c = self.config.missing, F.col(self.table.column(f.column))
        if how == LEAVE:
            self.reviews[k] = Review(f, "Missing values are left as they are unless a strategy is chosen.")
            return
        if how not in (DROP_ROW, CONSTANT, MEDIAN, MODE):
            self.reviews[k] = Review(f, f"Unknown strategy '{how}'.")
            return
        if how == DROP_ROW:
            n = self._live().where(t.is_blank(c)).count()
            if n:
                self.df = self.df.withColumn("_drop", F.col("_drop") | t.is_blank(c))
                self.actions[k] = Action(f.column, "drop_rows_missing_value", n, f"{n} row(s) with '{f.column}' blank", "row(s) removed", f)
            else:
                self.reviews[k] = Review(f, "No missing values were left.")
            return
        fill: str | None = self.config.constant
        present = self._live().where(~t.is_blank(c))
        if how == MEDIAN:
            numbers = present.select(F.lit(0).alias("col"), t.coerced(t.strip(c)).alias("x"), F.lit(1).alias("cnt")).where("x IS NOT NULL")
            median = exact_quantiles(numbers, (0.5,)).get(0)
            fill = f"{median[0][0]:g}" if median is not None else None
        elif how == MODE:
            best = present.groupBy(c.alias("v")).agg(F.count("*").alias("n")).agg(F.min(F.struct(-F.col("n"), "v")).alias("best")).first().best
            fill = best[1] if best is not None else None
        if fill is None:
            self.reviews[k] = Review(f, "The column has no values to take a fill from.")
            return
        self.change(k, f, lambda v: F.when(t.is_blank(v), F.lit(fill)).otherwise(v), _Step(f, f"fill_missing_{how}", "No missing values were left.", f"Filled by the chosen strategy '{how}'."))

    def on_fuzzy_duplicate_rows(self, k: int, f: Finding) -> None:
        self.reviews[k] = Review(f, "Likely duplicates need a person's decision.")

    def on_structural_issue(self, k: int, f: Finding) -> None:
        self.reviews[k] = Review(f, "Structural problems need a person's decision.")


def remediate(table: Table, findings: list[Finding], duplicates: DuplicationResult | None = None, config: CleaningConfig | None = None) -> Remediation:
    """Clean a scored table; the input stays as it is."""
    return _Cleaner(table, config or CleaningConfig(), duplicates).run(findings)
