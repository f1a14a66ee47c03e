"""A sample of 40 rows with known problems, from file to cleaned file."""

import pytest

from tablewarden.plans import pipeline, remediation, report
from tablewarden.sources.files import load_dataset

HEADER = "Business_Name,GST_Number,Contact_Number,Email,City,Registration_Date,Annual_Revenue,Employee_Count"
FIRST, LAST = ("Asha", "Bharat", "Chandra", "Deepak", "Esha", "Firoz", "Gita", "Hari"), ("Metals", "Spices", "Cables", "Glass", "Timber")


def lines():
    out = []
    for i in range(39):
        name = f"{FIRST[i % 8]} {LAST[i % 5]} {chr(65 + i % 26)}{i}"
        contact = "" if i % 13 in (1, 4, 7, 9, 12) else str(9_800_000_000 + i * 7_919)
        date = {3: "15-03-2019", 11: "25/12/2020", 20: "04-05-2018"}.get(i, f"2020-{i % 12 + 1:02d}-{i % 28 + 1:02d}")
        revenue = f'"{i},{50 + i},000"' if i in (2, 8, 14, 21, 33) else str(100_000 + 7_000 * i)
        gst = "24AAA0005" if i == 30 else f"24AAA{i:04d}"
        out.append(f"{name},{gst},{contact},info{i}@shop.example,{('Surat', 'Pune', 'Indore')[i % 3]},{date},{revenue},{5 + i % 30}")
    return [HEADER, *out, out[18]]


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("known") / "sample.csv"
    path.write_text("\n".join(lines()) + "\n", encoding="utf-8")
    return pipeline.score_table(load_dataset(spark, str(path)), as_of_year=2024)


def test_findings(result):
    assert result.table.n_rows == 40 and result.duplication.exact_rows == 1
    assert result.table.types["Annual_Revenue"] == "numeric" and result.table.types["Registration_Date"] == "date" and result.table.types["Contact_Number"] == "numeric"
    by = {(f.column, f.issue): f for f in result.findings}
    assert by["Contact_Number", "missing_data"].percentage == 37.5
    assert by["Annual_Revenue", "inconsistent_format_numeric"].percentage == 12.5
    assert by["Registration_Date", "inconsistent_format_date"].percentage == 7.5
    assert by["GST_Number", "structural_issue"].percentage == 10.0
    assert by["(whole row)", "exact_duplicate_rows"].severity == "moderate"


def test_cleaning_and_reading_back(spark, result, tmp_path):
    done = remediation.remediate(result.table, result.findings, result.duplication)
    by = {a.action: a for a in done.actions}
    assert by["strip_numeric_formatting"].count == 5 and by["remove_exact_duplicate_rows"].count == 1
    assert by["normalize_date_format"].count == 2 and by["normalize_date_format"].notes.startswith("1 value")
    assert {r.finding.column for r in done.reviews} >= {"Contact_Number", "GST_Number"}
    report.write_csv(done, str(tmp_path / "out"))
    again = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert again.count() == 39 and again.where("Annual_Revenue LIKE '%,%'").count() == 0
    after = pipeline.rescore(result, done.cleaned, as_of_year=2024)
    assert after.duplication.exact_rows == 0 and after.scorecard.overall > result.scorecard.overall
    assert result.scorecard == pipeline.scorecard(result.completeness, result.consistency, result.duplication, result.structure, result.validity)
