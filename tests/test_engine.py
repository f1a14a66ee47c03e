"""Behaviours of the table checks on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.functions import text as t
from tablewarden.functions.similarity import jaro_winkler, jaro_winkler_similarity, ratios, sorted_tokens, token_sort_ratio
from tablewarden.operators import calibration, checks, duplication, validity
from tablewarden.operators.profile import Table, prepare
from tablewarden.plans import charts, findings, phrasing, pipeline, remediation, report


def table(spark, columns, types=None, name="t"):
    n = max(len(v) for v in columns.values())
    rows = [(i, *[v[i] for v in columns.values()]) for i in range(n)]
    schema = "_row_id long, " + ", ".join(f"c{i} string" for i in range(len(columns)))
    return prepare(Table(name, spark.createDataFrame(rows, schema), list(columns)), types)


def values(spark, column, items):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_types(spark):
    got = table(spark, {"id": ["0001"] * 5, "at": ["23:49:28", "01:02:03", "11:11:11", "00:00:01", "05:05"], "reg": ["2020.01.15", "2020.02.16", "2019.12.31", "2020.03.01", "2020.05.05"], "ok": ["yes", "no", "yes", "no", "yes"], "none": [None, "", " ", None, None], "word": ["a", "b", "c", "d", "e"]}).types
    assert got == {"id": "numeric", "at": "text", "reg": "date", "ok": "boolean", "none": "unknown", "word": "text"}


def test_missing_and_plain_numbers(spark):
    assert values(spark, t.is_missing, ["Good", "N/A", "", "Fine", "unknown", " ", None]) == [False, True, True, False, True, True, True]
    assert values(spark, t.is_plain_number, ["1", "1e5", "12d", "1,0", " 7 ", "inf"]) == [True, True, False, False, True, True]
    assert values(spark, t.category_key, ["B.M.W", "New Delhi", "સુરત"]) == ["bmw", "newdelhi", ""]
    assert values(spark, t.block_key, ["Shree Ganesh", "ganesh  SHREE"]) == ["gane", "gane"]


def test_guarded_numbers(spark):
    assert values(spark, t.clean_number, ["₹12,50,000", "6,60,000.00", "2,500,000", "-1,200", "+5"]) == ["1250000", "660000.00", "2500000", "-1200", "5"]
    assert values(spark, t.clean_number, ["1,2,345", "9,87,6", "12,34", "1234,567", "5.", "2.500.000,75", "1e5"]) == [None] * 7


def test_guarded_dates(spark):
    assert values(spark, t.clean_date, ["15-03-2019", "12/25/2020", "2021-1-5", "2020.04.12", "2020-02-31", "Jan 22, 2021", "10-Feb-2018", "3 Feb 2021"]) == ["2019-03-15", "2020-12-25", "2021-01-05", "2020-04-12", "2020-02-31", "2021-01-22", "2018-02-10", "2021-02-03"]
    assert values(spark, t.clean_date, ["03-04-2020", "05-05-2020", "2020-13-05", "03-2020-04", "20200115", "x", None]) == [None] * 7


def test_similarities(spark):
    import random

    def naive(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
        total = len(a) + len(b)
        return 200 * row[-1] / total if total else 100.0

    rng = random.Random(3)
    words = ["".join(rng.choice("abcde ") for _ in range(rng.choice([0, 1, 5, 20, 64, 65, 90]))) for _ in range(30)]
    words = [sorted_tokens(w) for w in words]
    i, j = (x.ravel() for x in np.meshgrid(range(30), range(30), indexing="ij"))
    assert ratios(words, words, i, j) == pytest.approx([naive(words[a], words[b]) for a, b in zip(i, j)])
    df = spark.createDataFrame([("Shree Ganesh Traders", "Shri Ganesh Traders"), ("Krishna Auto Parts", "Krishna Auto Part"), (None, "x")], "a string, b string")
    assert [r[0] and round(r[0], 2) for r in df.select(token_sort_ratio("a", "b")).collect()] == [92.31, 97.14, None]
    assert [round(jaro_winkler(a, b), 4) for a, b in [("dizel", "diesel"), ("diesal", "diesel"), ("chennnai", "chennai"), ("abcd", "axyz")]] == [0.8578, 0.9333, 0.975, 0.5]
    assert df.select(jaro_winkler_similarity("a", "a").alias("x")).where("x = 1").count() == 2


@pytest.mark.parametrize("most", [1 << 22, 60])
def test_tables_of_similarities_equal_single_pairs(monkeypatch, most):
    import random

    from tablewarden.functions import similarity
    from tablewarden.functions.similarity import lcs_table, ratio_table

    monkeypatch.setattr(similarity, "MOST_MASKS", most)

    rng = random.Random(5)
    for letters, head, tail in [("ab", "", ""), ("abcde ", "Supplier#", " ltd"), ("aé😀", "x" * 70, "")]:
        left, right = ([head + "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 8, 9, 16, 17, 33, 64, 65, 129, 200]))) + tail for _ in range(n)] for n in (25, 40))
        i, j = (x.ravel() for x in np.meshgrid(range(25), range(40), indexing="ij"))
        assert (ratio_table(left, right).ravel() == ratios(left, right, i, j)).all()
    assert lcs_table(["ab"], []).shape == (1, 0) and lcs_table([""], ["", "a"]).tolist() == [[0, 0]]


def test_consistency(spark):
    got = checks.consistency(table(spark, {"City": ["Ahmedabad", "ahmedabad", None], "When": ["2020-01-01", "2020-01-02", "05/06/2020"], "Sum": ["1", "1,000", "2"]}))
    assert [(c.bad, c.total) for c in got.columns] == [(1, 2), (1, 3), (1, 3)]
    assert [c.examples for c in got.columns] == [["ahmedabad"], ["05/06/2020"], ["1,000"]]


def test_structure(spark):
    got = checks.structure(table(spark, {"Order_ID": ["1", "1", "2"], "Customer_ID": ["7", "7", "7"], "Unnamed: 2": ["a", "b", "c"], "Invoice_No": ["a", "a", "a"]}))
    assert [(i.kind, i.column, i.count) for i in got.issues] == [("unnamed_column", "Unnamed: 2", 1), ("duplicate_identifier", "Order_ID", 2), ("duplicate_identifier", "Invoice_No", 3)]
    assert got.score == 55


def outlier(spark, name, items):
    r = validity.validity(table(spark, {name: [str(x) for x in items]}, {name: "numeric"}), as_of_year=2024)
    return next((c for c in r.candidates if c.issue == "domain_outlier"), None)


def test_outliers(spark):
    q = outlier(spark, "Quantity", [2, 3, 1, 4, 5, 6, 7, 8, 2, 3, 999])
    assert (q.details["lower"], q.details["upper"], q.details["exclusive"]) == (0.0, 18.5, True) and q.example.startswith("999 ")
    q = outlier(spark, "Quantity", [2, 3, 1, 4, 5, 6, 7, 0, -1])
    assert q.percentage == 22.22 and q.details["upper"] is None and q.details["exclusive"]
    assert outlier(spark, "Total_Amount", [1000, 1200, 950, 1100, 1050, 990, 1150, 999999]).details["upper"] == 1657.5
    assert outlier(spark, "Doors", [4, 2, 4, 5, 9]).details == {"rule": "allowed values: 2, 3, 4, 5", "allowed": [2, 3, 4, 5]}
    assert outlier(spark, "Year", [2000, 2050]).percentage == 50.0 and outlier(spark, "Annual_Revenue", [1, 2, 3, 4, 5, 6, 7, 10**9]) is None


FUEL = ["Diesel"] * 6 + ["diesel", "Diesal", "Dizel"] + ["Petrol"] * 3


def test_categories(spark):
    r = validity.validity(table(spark, {"Fuel_Type": FUEL}))
    c = r.candidates[0]
    assert c.issue == "categorical_inconsistency" and c.percentage == 25.0 and c.example == "Diesal -> Diesel"
    assert c.details["canonical"] == {"diesal": {"canonical": "Diesel", "score": 93.33}, "dizel": {"canonical": "Diesel", "score": 85.78}, "diesel": {"canonical": "Diesel", "score": 100.0}}
    r = validity.validity(table(spark, {"Payment": ["DC", "NB", "UPI", "UPI", "Cash"], "City": ["Dilli", "Madras", "Pune", "Pune", "New Delhi"], "Name": ["Ana Bo", "Cy Dee", "Eff Gee", "Ha Ii", "Jo Kay"]}))
    assert {c.column: set(m["canonical"] for m in c.details["canonical"].values()) for c in r.candidates} == {"Payment": {"Debit Card", "Net Banking"}, "City": {"Delhi", "Chennai"}}
    assert not validity.validity(table(spark, {"City": ["સુરત", "સુરત ", "રાજકોટ"]})).candidates


def test_invalid_values(spark):
    r = validity.validity(table(spark, {"Price": ["1", "2", "high", "4", "ask", "unknown", "N/A", "??", "TBD"], "Sold": ["2020-01-01", "2020-01-02", "soon", "2020-05-05", "later"] + [None] * 4}, {"Price": "numeric", "Sold": "date"}))
    got = {c.issue: c for c in r.candidates}
    assert got["invalid_type_in_numeric"].details["examples"] == ["high", "ask", "??"]
    assert got["missing_value_representation"].details["tokens"] == ["N/A", "TBD", "unknown"]
    assert got["invalid_type_in_date"].percentage == 40.0


def test_calibration():
    hist = lambda xs: {x: xs.count(x) for x in xs}
    assert calibration.duplicate_threshold(hist([12, 15, 18, 20, 22, 25, 28, 30])) == calibration.Threshold(90.0, False)
    low, high = [10, 15, 20, 22, 25, 28, 30, 32, 28, 28], [92, 94, 95, 96, 97, 98]
    got = calibration.duplicate_threshold(hist(low + high))
    assert got.was_calibrated and got.value == round((sum(low) / 10 + sum(high) / 6) / 2, 2)
    assert calibration.severity_thresholds([1, 2, 3])[0] == calibration.Threshold(30.0, False)
    critical, moderate = calibration.severity_thresholds([1, 2, 3, 20, 22, 60, 62])
    assert (critical.value, moderate.value) == (41.0, 11.5)


def test_exact_and_fuzzy_duplicates(spark):
    names = ["Shree Ganesh Traders", "Shri Ganesh Traders", "Alpha Steel", "Beta Foods", "Gamma Textiles", "Delta Motors", "Delta Motors", "Omega Paper"]
    r = duplication.duplication(table(spark, {"Business_Name": names, "City": ["Surat", "Surat", "Pune", "Goa", "Agra", "Delhi", "Delhi", "Kochi"]}))
    assert r.exact_rows == 1 and r.first_pair == ("Shree Ganesh Traders", "Shri Ganesh Traders") and r.threshold.was_calibrated and r.rows_involved == 5
    n = 7
    assert sum(r.histogram.values()) == n * (n - 1) // 2


def test_histogram_equals_all_pairs_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(duplication, "TILE", 7)
    words = [f"name {i % 40} of {i * 7919 % 101}" for i in range(60)]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "_row_id long, value string")
    got = {r.score: r.n for r in duplication.score_histogram(duplication.block_values(rows, 60)).collect()}
    s = [sorted_tokens(w) for w in words]
    i, j = np.triu_indices(60, 1)
    want: dict = {}
    for x in np.round(ratios(s, s, i, j), 2).tolist():
        want[x] = want.get(x, 0) + 1
    assert got == want


def test_row_pairs_equal_a_plain_loop(spark):
    """Pairs over the threshold; (nearly) equal names count only where four fifths of the other columns agree."""
    cities, kinds = ["Surat", "surat ", "Pune", None], ["a", "b"]
    rows = [(i, f"trader {i % 7} of {'north' if i % 3 else 'nord'}", cities[i % 4], kinds[i % 2]) for i in range(48)]
    df = spark.createDataFrame(rows, "_row_id long, c0 string, c1 string, c2 string")
    named = df.select("_row_id", F.col("c0").alias("value"))
    matches = duplication.value_pairs(duplication.block_values(named, len(rows)), 90.0)
    got = {(r.row_a, r.row_b) for r in duplication.row_pairs(df, named, matches, ["c1", "c2"]).collect()}
    cell = lambda v: "nan" if v is None else v.strip().lower()
    words, want = [sorted_tokens(r[1]) for r in rows], set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            score = ratios(words, words, np.array([i]), np.array([j]))[0]
            agree = sum(cell(x) == cell(y) for x, y in zip(a[2:], rows[j][2:], strict=True)) / 2
            if score >= 90 and (score < 99.5 or agree >= 0.8):
                want.add((i, j))
    assert want and got == want


@pytest.mark.parametrize("others", [0, 1, 5, 7])
def test_fuzzy_rows_without_their_pairs(spark, monkeypatch, others):
    """Rows in a pair and the first pair equal a plain loop over all pairs, though no pair becomes a row."""
    import random

    def pairs_made(threshold):
        def run(batches):
            raise AssertionError("pairs were made")

        return run

    rng = random.Random(others)
    long = "x" * 120
    base = ["shree ganesh", "north steel", "a b", "b a", f"{long} y", f"{long[1:]} y z", f"y {long}", f"{long * 2} q", f"{long * 2} p", "naïve é co"]
    names = [(rng.choice(base) + (f" {rng.randrange(200)}" if rng.random() < 0.4 else "")).replace(" ", rng.choice([" ", " ", "\x1c"])) for _ in range(90)]
    cells = [[rng.choice([None, "A ", "a", "b", "c"]) for _ in range(others)] for _ in names]
    with monkeypatch.context() as patch:
        patch.setattr(duplication, "_matching", pairs_made)
        patch.setattr(duplication, "TILE", 16)
        r = duplication.duplication(table(spark, {"Name": names} | {f"k{c}": [x[c] for x in cells] for c in range(others)}, {"Name": "text"}))
    rows, seen = [], set()
    for i, row in enumerate(zip(names, map(tuple, cells), strict=True)):
        if row not in seen:
            rows.append((i, *row))
        seen.add(row)
    cell = lambda v: "nan" if v is None else v.strip().lower()
    words, want = [sorted_tokens(n) for _, n, _ in rows], []
    informative = [c for c in range(others) if max([x[c] for x in cells].count(v) for v in ("A ", "a", "b", "c")) / sum(x[c] is not None for x in cells) < 0.5]
    assert len(informative) == others
    for x, y in zip(*np.triu_indices(len(rows), 1)):
        score = ratios(words, words, np.array([x]), np.array([y]))[0]
        agree = not others or sum(cell(a) == cell(b) for a, b in zip(rows[x][2], rows[y][2], strict=True)) / others >= 0.8
        if score >= r.threshold.value and (score < 99.5 or agree):
            want.append((rows[x][0], rows[y][0]))
    assert r.identity == "Name" and want and r.fuzzy_rows == len({i for pair in want for i in pair})
    assert r.rows_involved == r.fuzzy_rows + r.exact_rows and r.first_pair == tuple(names[i] for i in min(want))


def test_columns_of_many_keys_get_no_category_work(spark, monkeypatch):
    seen = []
    groups = validity.category_groups
    monkeypatch.setattr(validity, "category_groups", lambda values: seen.append(sorted(r.col for r in values.select("col").distinct().collect())) or groups(values))
    names = [f"trader {i} x" for i in range(60)]
    assert validity.validity(table(spark, {"Name": names})).candidates == [] and seen == []
    got = validity.validity(table(spark, {"Name": names, "Fuel": ["Diesel", "diesel", "Petrol"] * 20, "One": ["only"] * 60}, {"Fuel": "text", "One": "text"}))
    assert seen == [[1]] and [(c.issue, c.column) for c in got.candidates] == [("categorical_inconsistency", "Fuel")]


def test_repeat_customers_are_no_duplicates(spark):
    names = ["Asha Rao", "Asha Rao", "Asha Rao", "Ben Roy", "Cyra Nair", "Dev Shah", "Eli Joshi", "Fay Kurup"]
    r = duplication.duplication(table(spark, {"Customer_Name": names, "Order_Amount": [str(100 * i) for i in range(8)], "Order_Date": [f"2024-01-0{i + 1}" for i in range(8)]}))
    assert r.exact_rows == 0 and not r.first_pair and r.score == 100.0


def car_prices(spark):
    return table(spark, {
        "Brand": ["Honda", "honda ", "BMW", "B.M.W", "BMW", "Honda", "Tata", "Tata"], "Fuel_Type": ["Diesel", "Diesel", "Diesal", "Petrol", "Petrol", "Petrol", "Diesel", "N/A"],
        "Year": ["2015", "2050", "2018", "2012", "2016", "2019", "2011", "2010"], "Price": ["5,00,000", "450000", "ask", "300000", "700000", "650000", "unknown", "250000"], "Doors": ["4", "4", "9", "4", "2", "4", "5", None],
    }, {"Price": "numeric"})


def test_every_finding_is_acted_on_or_reviewed(spark):
    result = pipeline.score_table(car_prices(spark), as_of_year=2024)
    for preset, config in remediation.PRESETS.items():
        out = remediation.remediate(result.table, result.findings, result.duplication, config)
        assert len(out.actions) + len(out.reviews) == len(result.findings)
        assert report.audit_text(result, out, preset).count("\n- ") == len(result.findings)
    rows = out.cleaned.orderBy("_row_id").collect()
    assert [r.Price for r in rows][:3] == ["500000", "450000", None] and rows[6].Price is None
    assert rows[2].Doors is None and rows[1].Year == "2025" and rows[2].Fuel_Type == "Diesel" and rows[3].Brand == "BMW"
    assert 0 < result.scorecard.overall < 100 and "Brand" in report.html_report(pipeline.Summary([result]))
    assert result.findings == sorted(result.findings, key=lambda f: (findings.RANK[f.severity], -f.percentage))


def test_same_table_same_findings(spark):
    one, two = (pipeline.score_table(car_prices(spark), as_of_year=2024) for _ in range(2))
    assert one.findings == two.findings and one.scorecard == two.scorecard
    assert [s for s, _ in zip(pipeline.profile_stages(car_prices(spark)), pipeline.STAGES, strict=True)] == list(pipeline.STAGES)


def f(issue, column, details=None):
    return findings.Finding("t", column, findings.DIMENSION_OF[issue], issue, 1.0, "minor", "", None, details or {})


def test_missing_strategies_and_duplicates(spark):
    t1 = table(spark, {"City": ["Goa", None, " ", "Agra", "Goa", "N/A"], "Sum": ["1", "2", "3", None, "1", "7"]})
    fill = lambda how, c, **k: [r[c] for r in remediation.remediate(t1, [f("missing_data", c)], None, remediation.CleaningConfig(missing=how, **k)).cleaned.orderBy("_row_id").collect()]
    assert fill("mode", "City") == ["Goa", "Goa", "Goa", "Agra", "Goa", "N/A"] and fill("median", "Sum")[3] == "2"
    assert fill("constant", "City", constant="x")[1:3] == ["x", "x"] and fill("drop_row", "City") == ["Goa", "Agra", "Goa", "N/A"]
    assert fill("leave", "City")[1] is None
    dup = duplication.duplication(t1)
    out = remediation.remediate(t1, [f("exact_duplicate_rows", "(whole row)"), f("fuzzy_duplicate_rows", "City")], dup)
    assert out.cleaned.count() == 5 and out.actions[0].count == 1 and len(out.reviews) == 1


def test_trim_clip_and_severity(spark):
    t1 = table(spark, {"City": ["Goa ", "Goa", "GOA", "Goa", "Goa", "Goa"], "Mileage": ["-500", "10", "20", "30", "40", "50"]})
    done = remediation.remediate(t1, [f("inconsistent_format_text", "City"), f("domain_outlier", "Mileage", {"lower": 0.0, "upper": 1e6, "exclusive": False})], None, remediation.CleaningConfig(normalize_case=True, outliers="clip"))
    assert [tuple(r)[1:] for r in done.cleaned.orderBy("_row_id").collect()][:3] == [("Goa", "0"), ("Goa", "10"), ("Goa", "20")]
    assert done.actions[0].before == "'Goa '" and done.actions[0].count == 2
    assert [findings.severity_of(p, 30, 10) for p in (30.0, 30.01, 10.0, 9.99)] == ["moderate", "critical", "moderate", "minor"]
    assert findings.is_optional_text("Notes", "unknown") and not findings.is_optional_text("Mandatory_Notes", "text") and not findings.is_optional_text("Notes", "numeric")
    assert sum(pipeline.WEIGHTS.values()) == pytest.approx(1) == sum(pipeline.WEIGHTS_WITHOUT_VALIDITY.values())
    assert {k: {len(v) for v in s.values()} for k, s in findings.TEMPLATES.items() if k == "missing_data"} == {"missing_data": {3}}


def test_charts(spark):
    t1 = table(spark, {"x": ["1", "2", "3", "10"], "c": ["a", "b", "a", None], "d": ["2020-01-05", "2020-01-09", "2021-03-01", "2020-12-31"]})
    by = {c.column: c for c in charts.charts(t1, [f("missing_data", "c")])}
    assert [n for _, n in by["x"].rows] == [3, 0, 0, 1] and by["c"].rows == [("a", 2), ("b", 1)] and by["c"].annotation == "⚠ 1.0% missing"
    assert by["d"].rows == [("2020-01", 2), ("2020-12", 1), ("2021-03", 1)]
    assert "most frequent is 'a'" in charts.low_cardinality_note(t1, "c") and charts.low_cardinality_note(t1, "x") is None


def test_phrasing_guards():
    x = f("missing_data", "City")
    assert phrasing.phrase(x, lambda p: "About 1 percent of City is empty, which is little. More.") == "About 1 percent of City is empty, which is little."
    for bad in ("short", "The missing_data issue touches 1 percent of City cells.", "A few of the cells in City are empty today.", "Rephrase: 1 percent of the cells are empty"):
        assert phrasing.phrase(x, lambda p, bad=bad: bad) is None
    clock = iter([0.0, 0.0, 9.0, 9.0])
    many = [f("missing_data", "City") for _ in range(3)]
    phrasing.phrase_all(many, lambda p: "About 1 percent of City is empty today.", lambda: next(clock))
    assert [m.phrased is not None for m in many] == [True, False, False]


def test_guards_of_a_rephrasing():
    from tablewarden.plans.findings import Finding
    from tablewarden.plans.phrasing import phrase

    f = Finding("t", "City", "consistency", "inconsistent_format_text", 12.5, "moderate", "x", "Pune vs pune ")
    said = lambda text: phrase(f, lambda _: text)
    assert said("About 12% of City differ, as in Pune.") == "About 12% of City differ, as in Pune."
    assert said("About 12% of City differ, as in Goa.") is None and said("About 112 of City differ, as in Pune.") is None
    assert said("The made_up code hits 12% of City, as in Pune.") is None


def test_names_and_hints():
    from tablewarden.operators.checks import is_identifier

    assert is_identifier("node_id") and is_identifier("order_id") and not is_identifier("customer_id") and not is_identifier("my_order_idx") and not is_identifier("angst")


def test_months_by_their_short_names(spark):
    from pyspark.sql import functions as F

    from tablewarden.functions.text import clean_date

    values = {"15-Sept-2020": "2020-09-15", "Sept 5, 2020": "2020-09-05", "5 sep 2020": "2020-09-05", "May 7, 2021": "2021-05-07", "1 Sex 2020": None}
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.v: r.d for r in df.select("v", clean_date(F.col("v")).alias("d")).collect()} == values
