"""Findings: raw issues of all dimensions, graded by calibrated severities, put into sentences and sorted."""

from __future__ import annotations

from dataclasses import dataclass, field

from tablewarden.operators.calibration import Threshold, severity_thresholds
from tablewarden.operators.checks import DimensionResult, StructureResult
from tablewarden.operators.duplication import DuplicationResult
from tablewarden.operators.profile import DATE, NUMERIC, TEXT, UNKNOWN
from tablewarden.operators.validity import ValidityResult

CRITICAL, MODERATE, MINOR = "critical", "moderate", "minor"
RANK = {CRITICAL: 0, MODERATE: 1, MINOR: 2}
# The dimension of each issue, the issues that are at least moderate, names of optional free text.
DIMENSION_OF = {
    "missing_data": "completeness",
    "inconsistent_format_numeric": "consistency",
    "inconsistent_format_date": "consistency",
    "inconsistent_format_text": "consistency",
    "exact_duplicate_rows": "duplication",
    "fuzzy_duplicate_rows": "duplication",
    "structural_issue": "structure",
    "invalid_type_in_numeric": "validity",
    "invalid_type_in_date": "validity",
    "categorical_inconsistency": "validity",
    "domain_outlier": "validity",
    "missing_value_representation": "validity",
}
AT_LEAST_MODERATE = ("exact_duplicate_rows", "invalid_type_in_numeric", "invalid_type_in_date", "domain_outlier")
OPTIONAL_HINTS = ("notes", "note", "comment", "comments", "remark", "remarks", "description", "additional_info", "additional_information", "feedback", "memo")
MANDATORY_HINTS = ("mandatory", "required", "compulsory", "must_")

_URGENCY = {CRITICAL: ("Fix this before the table is used", "This needs attention first"), MODERATE: ("Plan a repair", "Worth repairing soon"), MINOR: ("Tidy up when convenient", "A small clean-up")}
_FACTS = {
    "missing_data": ("{percentage}% of the cells in '{field}' are empty.", "'{field}' lacks a value in {percentage}% of the rows.", "In '{field}', {percentage}% of the values are missing."),
    "inconsistent_format_numeric": ("{percentage}% of the numbers in '{field}' aren't written as plain numbers, such as '{example}'.", "'{field}' mixes number formats in {percentage}% of its values, such as '{example}'."),
    "inconsistent_format_date": ("{percentage}% of the dates in '{field}' leave its usual format, such as '{example}'.", "'{field}' mixes date formats in {percentage}% of its values, such as '{example}'."),
    "inconsistent_format_text": ("{percentage}% of the values in '{field}' stray in case or spacing, such as '{example}'.", "'{field}' has {percentage}% of its values in unusual spellings, such as '{example}'."),
    "exact_duplicate_rows": ("{percentage}% of the rows repeat an earlier row exactly.", "Exact copies make up {percentage}% of the rows."),
    "fuzzy_duplicate_rows": ("{percentage}% of the rows look like another row, such as {example}.", "Likely duplicates involve {percentage}% of the rows, such as {example}."),
    "structural_issue": ("The table's structure has a problem: {example}", "A structural problem was found: {example}"),
    "invalid_type_in_numeric": ("{percentage}% of the values in '{field}' aren't numbers, such as '{example}'.", "'{field}' holds {percentage}% values that can't be numbers, such as '{example}'."),
    "invalid_type_in_date": ("{percentage}% of the values in '{field}' aren't dates, such as '{example}'.", "'{field}' holds {percentage}% values that can't be dates, such as '{example}'."),
    "categorical_inconsistency": ("{percentage}% of the values in '{field}' spell a category differently ({example}).", "'{field}' names the same categories in several ways in {percentage}% of its values ({example})."),
    "domain_outlier": ("{percentage}% of the values in '{field}' are out of range, such as {example}.", "'{field}' has {percentage}% improbable values, such as {example}."),
    "missing_value_representation": ("{percentage}% of the cells in '{field}' hold a stand-in for a missing value, such as '{example}'.", "'{field}' writes missing values as words in {percentage}% of its cells, such as '{example}'."),
}
#: Sentences by issue and severity: three variants for missing data, two for the rest.
TEMPLATES = {issue: {s: [f"{fact} {_URGENCY[s][i % 2]}." for i, fact in enumerate(facts)] for s in RANK} for issue, facts in _FACTS.items()}


@dataclass
class Finding:
    table: str
    column: str
    check: str
    issue: str
    percentage: float
    severity: str
    sentence: str
    example: str | None = None
    details: dict = field(default_factory=dict)
    phrased: str | None = None

    @property
    def display(self) -> str:
        return self.phrased or self.sentence


@dataclass
class Raw:
    issue: str
    column: str
    percentage: float
    example: str | None = None
    details: dict = field(default_factory=dict)
    cap: str | None = None


def is_optional_text(name: str, kind: str | None) -> bool:
    low = name.lower()
    return not any(h in low for h in MANDATORY_HINTS) and kind in (None, TEXT, UNKNOWN) and any(h in low for h in OPTIONAL_HINTS)


def severity_of(percentage: float, critical: float, moderate: float) -> str:
    return CRITICAL if percentage > critical else MODERATE if percentage >= moderate else MINOR


def collect(types: dict[str, str], completeness: DimensionResult, consistency: DimensionResult, duplication: DuplicationResult, structure: StructureResult, validity: ValidityResult | None) -> list[Raw]:
    """Issues without severity, in the order of dimensions."""
    out = [Raw("missing_data", c.name, c.percentage, cap=MINOR if is_optional_text(c.name, types.get(c.name)) else None) for c in completeness.columns if c.percentage > 0]
    issue = {NUMERIC: "inconsistent_format_numeric", DATE: "inconsistent_format_date", TEXT: "inconsistent_format_text"}
    out += [Raw(issue[c.kind], c.name, c.percentage, c.examples[0] if c.examples else "N/A") for c in consistency.columns if c.kind in issue and c.percentage > 0]
    if duplication.exact_rows:
        out.append(Raw("exact_duplicate_rows", "(whole row)", round(duplication.exact_rows / duplication.n_rows * 100, 2)))
    if duplication.first_pair:
        out.append(Raw("fuzzy_duplicate_rows", duplication.identity or "(row)", round(duplication.fuzzy_rows / duplication.n_rows * 100, 2), " vs ".join(duplication.first_pair)))
    out += [Raw("structural_issue", i.column or "(dataset)", i.percentage, i.description) for i in structure.issues]
    out += [Raw(c.issue, c.column, c.percentage, c.example, c.details) for c in (validity.candidates if validity else ())]
    return out


def grade(raw: list[Raw], table: str) -> tuple[list[Finding], Threshold, Threshold]:
    """Sorted findings and the cutoffs; issues with a cap take no part in the calibration."""
    critical, moderate = severity_thresholds([r.percentage for r in raw if r.cap is None])
    used: dict[tuple[str, str], int] = {}
    out = []
    for r in raw:
        severity = severity_of(r.percentage, critical.value, moderate.value)
        if r.issue in AT_LEAST_MODERATE and RANK[severity] > RANK[MODERATE]:
            severity = MODERATE
        if r.cap and RANK[severity] < RANK[r.cap]:
            severity = r.cap
        variants = TEMPLATES[r.issue][severity]
        k = used.get((r.issue, severity), 0)
        used[r.issue, severity] = k + 1
        sentence = variants[k % len(variants)].format(field=r.column, percentage=r.percentage, example=r.example)
        out.append(Finding(table, r.column, DIMENSION_OF[r.issue], r.issue, r.percentage, severity, sentence, r.example, r.details))
    return sorted(out, key=lambda f: (RANK[f.severity], -f.percentage)), critical, moderate
