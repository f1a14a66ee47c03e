"""Reports of results: an HTML scorecard, a text audit of a cleaning, and a cleaned CSV."""

from __future__ import annotations

import html
import re

from tablewarden.plans.pipeline import Summary, TableResult, tier
from tablewarden.plans.remediation import Remediation

ACTION_LABELS = {
    "strip_numeric_formatting": "Plain numbers", "normalize_date_format": "One date format", "trim_whitespace": "White space trimmed",
    "remove_exact_duplicate_rows": "Repeated rows removed", "coerce_invalid_numeric": "Invalid numbers blanked", "coerce_invalid_date": "Invalid dates blanked",
    "normalize_missing_token": "Stand-ins blanked", "standardize_categorical_spelling": "Spellings unified", "neutralize_domain_outlier": "Outliers blanked",
    "clip_domain_outlier": "Outliers clipped", "drop_rows_missing_value": "Rows without a value removed", "fill_missing_constant": "Filled with a constant",
    "fill_missing_median": "Filled with the median", "fill_missing_mode": "Filled with the mode",
}


def file_stub(name: str) -> str:
    """A name that is safe in a file's name."""
    return re.sub(r"[^A-Za-z0-9_-]+", "_", name).strip("_") or "table"


def audit_text(result: TableResult, cleaning: Remediation, preset: str) -> str:
    lines = [f"Cleaning of {result.table.name} ({preset})", "", "Changes"]
    for a in cleaning.actions:
        lines.append(f"- {a.column}: {ACTION_LABELS.get(a.action, a.action)}, {a.count} cell(s) or row(s); {a.before} -> {a.after}" + (f". {a.notes}" if a.notes else ""))
    lines += ["(none)"] * (not cleaning.actions) + ["", "For manual review"]
    lines += [f"- {r.finding.column} ({r.finding.issue.replace('_', ' ')}, {r.finding.percentage}%): {r.reason}" for r in cleaning.reviews] or ["(nothing)"]
    return "\n".join(lines) + "\n"


def _row(*cells: object, tag: str = "td") -> str:
    return "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"


def _table_section(r: TableResult) -> str:
    notices = [f"The first {r.table.skipped_rows} row(s) before the header were skipped."] * bool(r.table.skipped_rows) + [r.table.encoding_warning] * bool(r.table.encoding_warning)
    dimensions = "".join(f'<li class="{tier(s)}">{d}: {s}</li>' for d, s in r.scorecard.dimensions.items())
    columns = "".join(_row(n, r.table.types[n], *(s.get(d, "") for d in ("completeness", "consistency", "validity", "combined"))) for n, s in r.scorecard.columns.items())
    found = "".join(_row(f.severity, f.column, f.display) for f in r.findings)
    return (
        f'<section><h2>{html.escape(r.table.name)}: <span class="{tier(r.scorecard.overall)}">{r.scorecard.overall}</span></h2>'
        + "".join(f"<p>{html.escape(n)}</p>" for n in notices)
        + f"<ul>{dimensions}</ul><p>Critical above {r.critical.value}%, moderate from {r.moderate.value}%{' (calibrated)' if r.critical.was_calibrated else ''}.</p>"
        + f"<table>{_row('Column', 'Type', 'Completeness', 'Consistency', 'Validity', 'Combined', tag='th')}{columns}</table>"
        + f"<table>{_row('Severity', 'Column', 'Finding', tag='th')}{found}</table></section>"
    )


def html_report(summary: Summary) -> str:
    counts = ", ".join(f"{n} {s}" for s, n in summary.severities().items())
    failed = "".join(f"<li>{html.escape(f.name)}: {html.escape(f.error)}</li>" for f in summary.failures)
    style = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px}.good{color:#207227}.warn{color:#8a5a00}.bad{color:#a11}"
    body = "".join(_table_section(r) for r in summary.results) + (f"<h2>Tables that could not be scored</h2><ul>{failed}</ul>" if failed else "")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Scorecard</title><style>{style}</style></head><body><h1>Overall: <span class="{tier(summary.overall)}">{summary.overall}</span></h1><p>{counts}</p>{body}</body></html>'


def write_csv(cleaning: Remediation, path: str) -> None:
    """The cleaned table as CSV with a header; blanks are empty fields."""
    cleaning.cleaned.orderBy("_row_id").drop("_row_id").write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
