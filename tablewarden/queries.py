"""Every table check as a query over the standard tables, and the same rows in SQL.

The tables are clean, so dirt is derived from keys, by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions import text as t
from tablewarden.functions.similarity import jaro_winkler_similarity, token_sort_ratio
from tablewarden.operators import checks, duplication, validity
from tablewarden.operators.profile import Table, from_dataframe, infer_types, prepare, value_profile
from tablewarden.plans import charts, findings, pipeline, remediation
from tablewarden.plans.findings import AT_LEAST_MODERATE, Finding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_of(values: DataFrame, key: str, value: Column, name: str = "v") -> Table:
    """A table of one derived column, in the order of a key."""
    return Table(name, values.select(F.col(key).cast("long").alias("_row_id"), value.cast("string").alias("c0")), [name])


def _mod(key: str, n: int) -> Column:
    return F.pmod(F.col(key), F.lit(n))


def _named(counts: DataFrame, names: list[str]) -> DataFrame:
    return counts.withColumn("column_name", F.element_at(F.array(*map(F.lit, names)), F.col("col") + 1)).drop("col")


_TOKENS = "('n/a', 'na', 'null', 'none', 'nan', '?', 'unknown', 'tbd', 'n.a.', 'n.a')"


def _union(table: str, columns: list[str], body: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {body.format(c=f'CAST({c} AS VARCHAR)')} FROM {table}" for c in columns)


_MISSING = f"count(*) FILTER ({{c}} IS NULL OR trim({{c}}) = '' OR lower(trim({{c}})) IN {_TOKENS}) AS missing, count(*) AS total"


def _completeness(table: str, key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = from_dataframe(read(spark, sf_dir, table), table, key)
        return _named(checks.missing_counts(made), made.names)

    return run


_COLUMNS = {
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
}


def _dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(_mod("event_id", 7) == 0, "N/A").when(_mod("event_id", 11) == 0, " unknown ").when(_mod("event_id", 13) == 0, "").when(_mod("event_id", 17) == 0, None).otherwise(F.col("event_type"))
    return read(spark, sf_dir, "events").withColumn("kind", kind)


_DIRTY_EVENTS = "(SELECT *, CASE WHEN event_id % 7 = 0 THEN 'N/A' WHEN event_id % 11 = 0 THEN ' unknown ' WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN NULL ELSE event_type END AS kind FROM events)"


@query(f"SELECT count(*) FILTER (kind IS NULL OR trim(kind) = '' OR lower(trim(kind)) IN {_TOKENS}) AS missing, count(*) AS total FROM {_DIRTY_EVENTS}")
def completeness_dirty_events(spark, sf_dir):
    return checks.missing_counts(column_of(_dirty_events(spark, sf_dir), "event_id", F.col("kind"))).drop("col")


@query(f"SELECT count(*) FILTER (lower(trim(kind)) IN {_TOKENS}) AS n, array_to_string(list_sort(list(DISTINCT trim(kind)) FILTER (lower(trim(kind)) IN {_TOKENS}))[1:5], ',') AS tokens FROM {_DIRTY_EVENTS}")
def missing_tokens(spark, sf_dir):
    return validity.token_counts(value_profile(column_of(_dirty_events(spark, sf_dir), "event_id", F.col("kind")))).select("n", F.array_join("tokens", ",").alias("tokens"))


@query("SELECT 0 AS col, coalesce(kind, '<null>') AS raw, count(*) AS cnt, min(event_id) AS first_row FROM " + _DIRTY_EVENTS + " GROUP BY kind")
def value_profile_events(spark, sf_dir):
    return value_profile(column_of(_dirty_events(spark, sf_dir), "event_id", F.col("kind"))).withColumn("raw", F.coalesce("raw", F.lit("<null>")))


@query("""SELECT column_name, CASE column_name WHEN 'o_orderkey' THEN 'numeric' WHEN 'o_custkey' THEN 'numeric' WHEN 'price' THEN 'numeric' WHEN 'day' THEN 'date' WHEN 'flag' THEN 'boolean' ELSE 'text' END AS inferred_type, n AS present
FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'price', 'day', 'flag', 'o_orderpriority']) AS column_name, (SELECT count(*) FROM orders) AS n)""")
def type_inference_orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.format_number("o_totalprice", 2).alias("price"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"), F.when(_mod("o_orderkey", 3) == 0, "Yes").otherwise("no").alias("flag"), "o_orderpriority")
    made = from_dataframe(o, "orders", "o_orderkey")
    return _named(infer_types(value_profile(made)).select("col", "inferred_type", "present"), made.names)


_SPELLED = "CASE WHEN p_partkey % 9 = 0 THEN upper(p_brand) || ' ' WHEN p_partkey % 5 = 0 THEN lower(p_brand) ELSE p_brand END"


def _spelled(spark, sf_dir):
    v = F.when(_mod("p_partkey", 9) == 0, F.concat(F.upper("p_brand"), F.lit(" "))).when(_mod("p_partkey", 5) == 0, F.lower("p_brand")).otherwise(F.col("p_brand"))
    return value_profile(column_of(read(spark, sf_dir, "part"), "p_partkey", v))


@query(f"""WITH v AS (SELECT p_partkey, {_SPELLED} AS raw FROM part),
c AS (SELECT raw, lower(trim(raw)) AS norm, count(*) AS n, min(p_partkey) AS first FROM v GROUP BY raw),
d AS (SELECT norm, raw AS dominant FROM c QUALIFY row_number() OVER (PARTITION BY norm ORDER BY n DESC, first) = 1)
SELECT norm, dominant, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (raw <> dominant OR raw <> trim(raw) OR raw LIKE '%  %'), 0) AS BIGINT) AS stray FROM c JOIN d USING (norm) GROUP BY norm, dominant""")
def dominant_spelling(spark, sf_dir):
    return checks.spellings(_spelled(spark, sf_dir)).groupBy("norm", "dominant").agg(F.sum("cnt").alias("n"), F.sum(F.when(F.col("stray"), F.col("cnt")).otherwise(0)).alias("stray"))


@query(f"SELECT count(*) FILTER (raw <> trim(raw) OR raw LIKE '%  %') AS n FROM (SELECT {_SPELLED} AS raw FROM part)")
def whitespace_issues(spark, sf_dir):
    return _spelled(spark, sf_dir).agg(F.sum(F.when(t.has_whitespace_issue(F.col("raw")), F.col("cnt")).otherwise(0)).alias("n"))


_GROUPED = "CASE o_orderkey % 6 WHEN 0 THEN '₹' || CAST(o_custkey AS VARCHAR) || ',' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN CAST(o_custkey AS VARCHAR) || ',5' WHEN 2 THEN '+' || CAST(o_custkey AS VARCHAR) || '.50' WHEN 3 THEN '1,' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') || ',000' ELSE CAST(o_custkey AS VARCHAR) END"


def _grouped() -> Column:
    c, m = F.col("o_custkey").cast("string"), _mod("o_orderkey", 6)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.when(m == 0, F.concat(F.lit("₹"), c, F.lit(","), pad(_mod("o_orderkey", 1000), 3))).when(m == 1, F.concat(c, F.lit(",5"))).when(m == 2, F.concat(F.lit("+"), c, F.lit(".50"))).when(m == 3, F.concat(F.lit("1,"), pad(_mod("o_custkey", 100), 2), F.lit(",000"))).otherwise(c)


_SURE = r"regexp_matches(b, '^[+-]?(\d+|\d{1,3},\d{3}|\d{1,3}(,\d{2})+,\d{3}|\d{1,3}(,\d{3})+,\d{3})(\.\d+)?$')"


@query(f"SELECT o_orderkey, raw, CASE WHEN {_SURE} THEN regexp_replace(b, '[,+]', '', 'g') END AS cleaned FROM (SELECT o_orderkey, raw, regexp_replace(raw, '[₹$€£\\s]', '', 'g') AS b FROM (SELECT o_orderkey, {_GROUPED} AS raw FROM orders))")
def guarded_numeric_clean(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", _grouped().alias("raw")).withColumn("cleaned", t.clean_number(F.col("raw")))


@query(f"SELECT count(*) FILTER (try_cast(raw AS DOUBLE) IS NULL) AS bad, count(*) AS total FROM (SELECT {_GROUPED} AS raw FROM orders)")
def numeric_format_issues(spark, sf_dir):
    p = value_profile(column_of(read(spark, sf_dir, "orders"), "o_orderkey", _grouped()))
    return p.agg(F.sum(F.when(~t.is_plain_number(F.col("raw")), F.col("cnt")).otherwise(0)).alias("bad"), F.sum("cnt").alias("total"))


_DATED = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 2 THEN strftime(o_orderdate, '%b %d, %Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END"


def _dated() -> Column:
    m = _mod("o_orderkey", 5)
    f = lambda p: F.date_format("o_orderdate", p)
    return F.when(m == 0, f("dd/MM/yyyy")).when(m == 1, f("dd-MMM-yyyy")).when(m == 2, f("MMM dd, yyyy")).otherwise(f("yyyy-MM-dd"))


@query(f"""WITH v AS (SELECT o_orderkey, {_DATED} AS raw FROM orders),
f AS (SELECT CASE WHEN regexp_matches(raw, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN 'YYYY-MM-DD' WHEN regexp_matches(raw, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN 'DD/MM/YYYY' WHEN regexp_matches(raw, '^\\d{{1,2}}-[A-Za-z]{{3}}-\\d{{4}}$') THEN 'DD-Mon-YYYY' ELSE 'Month DD, YYYY' END AS date_format, o_orderkey FROM v)
SELECT date_format, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) = 1 AS dominant FROM f GROUP BY date_format""")
def date_format_mode(spark, sf_dir):
    return checks.dominant_date_formats(value_profile(column_of(read(spark, sf_dir, "orders"), "o_orderkey", _dated()))).select("date_format", "n", "dominant")


@query(f"SELECT o_orderkey, raw, CASE WHEN o_orderkey % 5 = 0 AND day(o_orderdate) <= 12 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS cleaned FROM (SELECT o_orderkey, o_orderdate, replace({_DATED}, 'Sep', CASE WHEN o_orderkey % 2 = 0 THEN 'Sept' ELSE 'September' END) AS raw FROM orders)")
def guarded_date_normalize(spark, sf_dir):
    september = F.replace(_dated(), F.lit("Sep"), F.when(_mod("o_orderkey", 2) == 0, "Sept").otherwise("September"))
    return read(spark, sf_dir, "orders").select("o_orderkey", september.alias("raw")).withColumn("cleaned", t.clean_date(F.col("raw")))


@query("SELECT count(*) FILTER (o_orderkey % 10 = 3) AS bad, count(*) AS total FROM orders")
def invalid_numeric(spark, sf_dir):
    v = F.when(_mod("o_orderkey", 10) == 3, "call us").otherwise(F.format_number("o_totalprice", 2))
    p = validity.checkable(value_profile(column_of(read(spark, sf_dir, "orders"), "o_orderkey", v)))
    return p.agg(F.sum(F.when(F.col("x").isNull(), F.col("cnt")).otherwise(0)).alias("bad"), F.sum("cnt").alias("total"))


@query("SELECT count(*) FILTER (o_orderkey % 8 = 1) AS bad, count(*) AS total FROM orders")
def invalid_date(spark, sf_dir):
    v = F.when(_mod("o_orderkey", 8) == 1, "next week").otherwise(_dated())
    p = validity.checkable(value_profile(column_of(read(spark, sf_dir, "orders"), "o_orderkey", v)))
    return p.agg(F.sum(F.when(~t.is_date(F.col("v")), F.col("cnt")).otherwise(0)).alias("bad"), F.sum("cnt").alias("total"))


def _numbers(spark, sf_dir, table: str, column: str) -> DataFrame:
    return read(spark, sf_dir, table).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("cnt")).withColumn("col", F.lit(0))


def _outliers(spark, sf_dir, table: str, column: str) -> DataFrame:
    """Rows outside a column's rule or its fences (with their bounds)."""
    numbers = _numbers(spark, sf_dir, table, column)
    rule, fences, _ = validity.outlier_rule(column, validity.quartiles(numbers).get(0), as_of_year=2024)
    x = F.col("x")
    bad = validity.violates(x, rule) if rule else F.lit(False)
    if fences:
        bad = bad | (x < fences[0]) | (x > fences[1])
    return numbers.agg(F.sum(F.when(bad, F.col("cnt")).otherwise(0)).alias("bad"), F.sum("cnt").alias("total"))


def _fences(table: str, column: str, floor: str = "false") -> str:
    return f"WITH q AS (SELECT quantile_cont({column}::DOUBLE, 0.25) AS a, quantile_cont({column}::DOUBLE, 0.75) AS b, count(DISTINCT {column}) AS d FROM {table}) SELECT count(*) FILTER ({floor} OR (d >= 8 AND a <> b AND ({column} < a - 3 * (b - a) OR {column} > b + 3 * (b - a)))) AS bad, count(*) AS total FROM {table}, q"


for _name, _table, _column, _sql in (
    ("domain_outlier_discount", "lineitem", "l_discount", "SELECT count(*) FILTER (l_discount < 0 OR l_discount > 100) AS bad, count(*) AS total FROM lineitem"),
    ("domain_outlier_quantity", "lineitem", "l_quantity", _fences("lineitem", "l_quantity", "l_quantity <= 0")),
    ("domain_outlier_page_age", "pages", "page_id", "SELECT count(*) FILTER (page_id < 0 OR page_id > 120) AS bad, count(*) AS total FROM pages"),
    ("iqr_acctbal", "customer", "c_acctbal", _fences("customer", "c_acctbal")),
    ("iqr_events_value", "events", "value", _fences("events", "value")),
):
    QUERIES[_name] = lambda spark, sf_dir, a=_table, b=_column: _outliers(spark, sf_dir, a, b)
    ORACLES[_name] = _sql
for _table, (_key, _columns) in _COLUMNS.items():
    QUERIES[f"completeness_{_table}"] = _completeness(_table, _key)
ORACLES["completeness_customer"] = _union("customer", _COLUMNS["customer"][1], _MISSING)
ORACLES["completeness_orders"] = _union("orders", _COLUMNS["orders"][1], _MISSING)

_SEGMENT = "CASE WHEN c_custkey % 50 = 0 THEN c_mktsegment || 'S' WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 11 = 0 THEN replace(c_mktsegment, 'U', '.U') ELSE c_mktsegment END"


def _segments(spark, sf_dir) -> DataFrame:
    m = F.col("c_mktsegment")
    v = F.when(_mod("c_custkey", 50) == 0, F.concat(m, F.lit("S"))).when(_mod("c_custkey", 7) == 0, F.lower(m)).when(_mod("c_custkey", 11) == 0, F.replace(m, F.lit("U"), F.lit(".U"))).otherwise(m)
    return value_profile(column_of(read(spark, sf_dir, "customer"), "c_custkey", v))


@query(f"""WITH v AS (SELECT c_custkey, {_SEGMENT} AS raw FROM customer), k AS (SELECT regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '', 'g') AS key, raw, count(*) AS n, min(c_custkey) AS first FROM v GROUP BY ALL)
SELECT key, CAST(sum(n) AS BIGINT) AS n, count(*) AS spellings, arg_min(raw, (-n, first)) AS canonical FROM k GROUP BY key""")
def categorical_key_groups(spark, sf_dir):
    return validity.category_groups(_segments(spark, sf_dir)).select("key", "n", "spellings", "canonical")


@query(f"""WITH v AS (SELECT c_custkey, {_SEGMENT} AS raw FROM customer), k AS (SELECT regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '', 'g') AS key, count(*) AS n FROM v GROUP BY ALL)
SELECT a.key AS key_a, b.key AS key_b, jaro_winkler_similarity(a.key, b.key) >= 0.85 AS alike FROM k a, k b WHERE a.key < b.key""")
def categorical_fuzzy(spark, sf_dir):
    keys = validity.category_groups(_segments(spark, sf_dir)).select("key")  # at most 40 keys
    a, b = keys.withColumnRenamed("key", "key_a"), F.broadcast(keys.withColumnRenamed("key", "key_b"))
    return a.join(b, F.col("key_a") < F.col("key_b")).select("key_a", "key_b", (jaro_winkler_similarity("key_a", "key_b") >= 0.85).alias("alike"))


_ODD_SEGMENT = "CASE c_custkey WHEN 77 THEN c_mktsegment || 'Z' WHEN 78 THEN 'Q' || c_mktsegment WHEN 79 THEN 'zq' ELSE " + _SEGMENT + " END"


@query(f"""WITH v AS (SELECT c_custkey, {_ODD_SEGMENT} AS raw FROM customer), s AS (SELECT regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '', 'g') AS key, trim(raw) AS sp, count(*) AS n, min(c_custkey) AS first FROM v GROUP BY ALL),
k AS (SELECT key, sum(n) AS n, min(first) AS first, count(*) AS spellings, arg_min(sp, (-n, first)) AS canonical, max(n) AS canonical_n FROM s GROUP BY key),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS rank FROM k), std AS (SELECT * FROM r WHERE n >= 2 AND rank <= 12),
f AS (SELECT r.key, arg_max(std.canonical, (jaro_winkler_similarity(r.key, std.key), -std.rank)) AS canonical, max(jaro_winkler_similarity(r.key, std.key)) * 100 AS score, any_value(r.n) AS changed FROM r, std WHERE r.key NOT IN (SELECT key FROM std) GROUP BY r.key)
SELECT key, canonical, round(score, 2) AS score, CAST(changed AS BIGINT) AS changed FROM f WHERE score >= 85 UNION ALL SELECT key, canonical, 100.0::DOUBLE, CAST(n - canonical_n AS BIGINT) FROM std WHERE spellings > 1""")
def categorical_changes(spark, sf_dir):
    made = column_of(read(spark, sf_dir, "customer"), "c_custkey", F.expr(_ODD_SEGMENT))
    return validity.category_changes(validity.category_groups(value_profile(made))).select("key", "canonical", "score", "changed")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS n FROM documents) WHERE n > 1")
def exact_duplicates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_row_id"), F.col("text").alias("c0"), F.col("lang").alias("c1"))
    return duplication.exact_duplicates(d, ["c0", "c1"]).withColumnRenamed("_row_id", "doc_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS copy FROM documents")
def duplicated_rows(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_row_id"), "text", "lang")
    return duplication.duplicated_rows(d, ["text", "lang"]).select(F.col("_row_id").alias("doc_id"), "copy")


@query("SELECT (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1)) AS conv_id, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM events GROUP BY event_id HAVING count(*) > 1)) AS event_id")
def identifier_duplicates(spark, sf_dir):
    one = lambda table, c: checks.repeated_values(read(spark, sf_dir, table).groupBy(F.col(c).cast("string").alias("raw")).agg(F.count("*").alias("cnt")).withColumn("col", F.lit(0))).select(F.col("repeated").alias(c))
    return one("conversations", "conv_id").crossJoin(one("events", "event_id"))  # one row each


@query("SELECT column_name, present, distinct_values FROM (SELECT 'c_name' AS column_name, count(*) AS present, count(DISTINCT c_name) AS distinct_values FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer)")
def column_shapes(spark, sf_dir):
    made = from_dataframe(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "customer", "c_custkey")
    shapes = _named(duplication.column_shapes(value_profile(made)), made.names)
    return shapes.where("column_name <> 'c_custkey'").select("column_name", "present", F.col("values").alias("distinct_values"))


def _shapes(made: Table) -> dict[int, Row]:
    return {r.col: r for r in duplication.column_shapes(made.profile).collect()}


@query("SELECT column_name AS identity FROM (SELECT 'c_mktsegment' AS column_name, count(c_mktsegment) AS n, count(DISTINCT c_mktsegment) AS d FROM customer UNION ALL SELECT 'c_name', count(c_name), count(DISTINCT c_name) FROM customer) WHERE d >= 5 AND d >= 0.3 * n ORDER BY CASE WHEN column_name LIKE '%name%' THEN 0 ELSE 1 END LIMIT 1")
def identity_column(spark, sf_dir):
    made = prepare(from_dataframe(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name"), "customer", "c_custkey"))
    chosen = duplication.choose_identity(made.names, made.types, {i: (r.present, r["values"]) for i, r in _shapes(made).items()})
    made.profile.unpersist()
    return spark.createDataFrame([(chosen,)], "identity string")


@query("SELECT column_name, 2 * largest >= present AS low_information FROM (SELECT 'p_brand' AS column_name, max(n) AS largest, CAST(sum(n) AS BIGINT) AS present FROM (SELECT count(*) AS n FROM part GROUP BY p_brand) UNION ALL SELECT 'one', count(*), count(*) FROM part)")
def low_information_columns(spark, sf_dir):
    made = from_dataframe(read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lit("x").alias("one")), "part", "p_partkey")
    prepare(made)
    poor = duplication.low_information(made.names, "p_partkey", {i: (r.present, r.largest) for i, r in _shapes(made).items()})
    made.profile.unpersist()
    return spark.createDataFrame([(n, n in poor) for n in made.names if n != "p_partkey"], "column_name string, low_information boolean")


@query("SELECT p_partkey, substr(array_to_string(list_sort(regexp_split_to_array(lower(trim(p_name)), '\\s+')), ' '), 1, 4) AS block FROM part")
def block_keys(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", t.block_key(F.col("p_name")).alias("block"))


@query("SELECT p_partkey, 100.0::DOUBLE AS same_words, 200.0::DOUBLE * length(p_name) / (2 * length(p_name) + 2) AS one_more FROM part")
def token_sort_scores(spark, sf_dir):
    name = F.col("p_name")
    turned = F.array_join(F.reverse(F.split(name, " ")), " ")
    return read(spark, sf_dir, "part").select("p_partkey", token_sort_ratio(name, turned).alias("same_words"), token_sort_ratio(name, F.concat(F.lit("~ "), name)).alias("one_more"))


def _supplier_values(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("_row_id"), F.col("s_name").alias("value"))
    return s, duplication.block_values(s, s.count())


@query()
def score_histogram(spark, sf_dir):
    return duplication.score_histogram(_supplier_values(spark, sf_dir)[1])


@query()
def fuzzy_pairs(spark, sf_dir):
    rows, values = _supplier_values(spark, sf_dir)
    return duplication.row_pairs(rows, rows, duplication.value_pairs(values, 94.0), None)


# three findings a table: too few to calibrate on, so the cutoffs are the defaults
_GRADED = [(i, i // 3, issue, float(p)) for i, (issue, p) in enumerate(zip(["missing_data", "missing_data", "domain_outlier", "exact_duplicate_rows", "missing_data", "inconsistent_format_text", "domain_outlier", "domain_outlier", "domain_outlier"] * 2, [0.5, 1, 12, 2, 31, 30, 9.99, 10, 30.01, 44, 36, 8, 90, 17, 5, 60, 22, 70], strict=True))]
_GRADED_SQL = ", ".join(f"({i}, {g}, '{s}', {p}::DOUBLE)" for i, g, s, p in _GRADED)
_SEVERITY = f"CASE WHEN p > 30 THEN 'critical' WHEN p >= 10 OR issue IN {AT_LEAST_MODERATE} THEN 'moderate' ELSE 'minor' END"
_GRADED_ROWS = f"(SELECT *, {_SEVERITY} AS severity FROM (VALUES {_GRADED_SQL}) t(position, g, issue, p))"


def _graded(spark) -> DataFrame:
    """What ``findings.grade`` makes of the issues above, table by table."""
    rows = []
    for g in sorted({x[1] for x in _GRADED}):
        raw = [findings.Raw(issue, str(i), p) for i, table, issue, p in _GRADED if table == g]
        for place, f in enumerate(findings.grade(raw, str(g))[0], 1):
            variants = [v.format(field=f.column, percentage=f.percentage, example=f.example) for v in findings.TEMPLATES[f.issue][f.severity]]
            rows.append((int(f.column), g, f.issue, f.percentage, f.severity, variants.index(f.sentence), place))
    return spark.createDataFrame(rows, "position int, g int, issue string, p double, severity string, variant long, place long")


@query(f"SELECT position, issue, p, severity FROM {_GRADED_ROWS}")
def severity_classify(spark, sf_dir):
    return _graded(spark).select("position", "issue", "p", "severity")


@query(f"SELECT position, (row_number() OVER (PARTITION BY g, issue, severity ORDER BY position) - 1) % CASE issue WHEN 'missing_data' THEN 3 ELSE 2 END AS variant FROM {_GRADED_ROWS}")
def round_robin_variant(spark, sf_dir):
    return _graded(spark).select("position", "variant")


@query(f"SELECT position, row_number() OVER (PARTITION BY g ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, p DESC, position) AS place FROM {_GRADED_ROWS}")
def findings_sorted(spark, sf_dir):
    return _graded(spark).select("position", "place")


def _clean(table: Table, issue: str, config: remediation.CleaningConfig | None = None, details: dict | None = None) -> DataFrame:
    found = Finding(table.name, table.names[0], "", issue, 1.0, "minor", "", None, details or {})
    return remediation.remediate(table, [found], None, config).cleaned.select(F.col("_row_id").alias("id"), F.col(f"`{table.names[0]}`").alias("v"))


@query(f"SELECT p_partkey AS id, trim({_SPELLED}) AS v FROM part")
def clean_trim(spark, sf_dir):
    v = F.when(_mod("p_partkey", 9) == 0, F.concat(F.upper("p_brand"), F.lit(" "))).when(_mod("p_partkey", 5) == 0, F.lower("p_brand")).otherwise(F.col("p_brand"))
    return _clean(column_of(read(spark, sf_dir, "part"), "p_partkey", v), "inconsistent_format_text")


@query(f"SELECT event_id AS id, CASE WHEN lower(trim(kind)) IN {_TOKENS} THEN NULL ELSE kind END AS v FROM {_DIRTY_EVENTS}")
def clean_missing_tokens(spark, sf_dir):
    return _clean(column_of(_dirty_events(spark, sf_dir), "event_id", F.col("kind")), "missing_value_representation")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders")
def clean_invalid_numbers(spark, sf_dir):
    return _clean(column_of(read(spark, sf_dir, "orders"), "o_orderkey", F.when(_mod("o_orderkey", 10) == 3, "call us").otherwise(F.col("o_custkey").cast("string"))), "invalid_type_in_numeric")


_BOUNDS = {"lower": 10.0, "upper": 40.0, "exclusive": False}


def _quantities(spark, sf_dir) -> Table:
    return column_of(read(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "id", F.col("l_quantity").cast("int").cast("string"))


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_quantity < 10 OR l_quantity > 40 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS v FROM lineitem")
def clean_outlier_blank(spark, sf_dir):
    return _clean(_quantities(spark, sf_dir), "domain_outlier", None, _BOUNDS)


@query("SELECT l_orderkey * 10 + l_linenumber AS id, CAST(CAST(least(greatest(l_quantity, 10), 40) AS INT) AS VARCHAR) AS v FROM lineitem")
def clean_outlier_clip(spark, sf_dir):
    return _clean(_quantities(spark, sf_dir), "domain_outlier", remediation.PRESETS["Aggressive"], _BOUNDS)


_FILLED = "SELECT event_id AS id, CASE WHEN kind IS NULL OR trim(kind) = '' THEN {fill} ELSE kind END AS v FROM " + _DIRTY_EVENTS


@query(_FILLED.format(fill="'none given'"))
def clean_fill_constant(spark, sf_dir):
    return _clean(column_of(_dirty_events(spark, sf_dir), "event_id", F.col("kind")), "missing_data", remediation.CleaningConfig(missing="constant", constant="none given"))


@query(_FILLED.format(fill=f"(SELECT kind FROM {_DIRTY_EVENTS} WHERE kind IS NOT NULL AND trim(kind) <> '' GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)"))
def clean_fill_mode(spark, sf_dir):
    return _clean(column_of(_dirty_events(spark, sf_dir), "event_id", F.col("kind")), "missing_data", remediation.CleaningConfig(missing="mode"))


@query(f"SELECT event_id AS id, kind AS v FROM {_DIRTY_EVENTS} WHERE kind IS NOT NULL AND trim(kind) <> ''")
def clean_drop_rows(spark, sf_dir):
    return _clean(column_of(_dirty_events(spark, sf_dir), "event_id", F.col("kind")), "missing_data", remediation.CleaningConfig(missing="drop_row"))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 9 = 0 THEN CAST((SELECT quantile_cont(o_custkey::DOUBLE, 0.5) FROM orders WHERE o_orderkey % 9 <> 0) AS BIGINT) ELSE o_custkey END AS VARCHAR) AS v FROM orders")
def clean_fill_median(spark, sf_dir):
    out = _clean(column_of(read(spark, sf_dir, "orders"), "o_orderkey", F.when(_mod("o_orderkey", 9) != 0, F.col("o_custkey").cast("string"))), "missing_data", remediation.CleaningConfig(missing="median"))
    return out.withColumn("v", F.rint(F.col("v").cast("double")).cast("long").cast("string"))


@query(f"SELECT o_orderkey AS id, CASE WHEN {_SURE} THEN regexp_replace(b, '[,+]', '', 'g') ELSE raw END AS v FROM (SELECT o_orderkey, raw, regexp_replace(raw, '[₹$€£\\s]', '', 'g') AS b FROM (SELECT o_orderkey, {_GROUPED} AS raw FROM orders))")
def clean_numbers(spark, sf_dir):
    return _clean(column_of(read(spark, sf_dir, "orders"), "o_orderkey", _grouped()), "inconsistent_format_numeric")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 AND day(o_orderdate) <= 12 THEN raw ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v FROM (SELECT o_orderkey, o_orderdate, {_DATED} AS raw FROM orders)")
def clean_dates(spark, sf_dir):
    return _clean(column_of(read(spark, sf_dir, "orders"), "o_orderkey", _dated()), "inconsistent_format_date")


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 <> 1 THEN {_DATED} END AS v FROM orders")
def clean_invalid_dates(spark, sf_dir):
    return _clean(column_of(read(spark, sf_dir, "orders"), "o_orderkey", F.when(_mod("o_orderkey", 8) == 1, "next week").otherwise(_dated())), "invalid_type_in_date")


@query(f"SELECT c_custkey AS id, CASE WHEN regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') IN ('building', 'buildings') THEN 'BUILDING' ELSE raw END AS v FROM (SELECT c_custkey, {_SEGMENT} AS raw FROM customer)")
def clean_categories(spark, sf_dir):
    m = F.col("c_mktsegment")
    v = F.when(_mod("c_custkey", 50) == 0, F.concat(m, F.lit("S"))).when(_mod("c_custkey", 7) == 0, F.lower(m)).when(_mod("c_custkey", 11) == 0, F.replace(m, F.lit("U"), F.lit(".U"))).otherwise(m)
    mapping = {"building": {"canonical": "BUILDING", "score": 100.0}, "buildings": {"canonical": "BUILDING", "score": 97.78}, "machinery": {"canonical": "never", "score": 86.0}}
    return _clean(column_of(read(spark, sf_dir, "customer"), "c_custkey", v), "categorical_inconsistency", None, {"canonical": mapping})


@query("SELECT min(doc_id) AS id, text AS v FROM documents GROUP BY text")
def clean_exact_duplicates(spark, sf_dir):
    made = column_of(read(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    exact = duplication.exact_duplicates(made.df, ["c0"])
    found = duplication.DuplicationResult(exact.count(), None, duplication.duplicate_threshold({}), 0, exact=exact)
    out = remediation.remediate(made, [Finding("t", "(whole row)", "duplication", "exact_duplicate_rows", 1.0, "minor", "")], found)
    return out.cleaned.select(F.col("_row_id").alias("id"), "v")


@query(f"SELECT severity, count(*) AS n FROM {_GRADED_ROWS} GROUP BY severity")
def severity_counts(spark, sf_dir):
    return _graded(spark).groupBy("severity").agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'often' ELSE 'seldom' END AS v FROM customer), n AS (SELECT v, count(*) AS n FROM v GROUP BY v) SELECT '''v'' has ' || count(*) || ' different value(s); the most frequent is ''' || arg_max(v, n) || ''' (' || CAST(round(100.0 * max(n) / sum(n)) AS INT) || '% of the rows).' AS note FROM n")
def low_cardinality(spark, sf_dir):
    made = prepare(column_of(read(spark, sf_dir, "customer"), "c_custkey", F.when(_mod("c_custkey", 4) == 0, "often").otherwise("seldom")))
    note = charts.low_cardinality_note(made, "v")
    made.profile.unpersist()
    return spark.createDataFrame([(note,)], "note string")


@query("WITH x AS (SELECT l_quantity::DOUBLE AS x FROM lineitem), s AS (SELECT min(x) AS lo, max(x) AS hi, least(count(DISTINCT x), 10) AS bins FROM x) SELECT bucket, count(*) AS n FROM (SELECT greatest(1, CAST(ceil((x - lo) / ((hi - lo) / bins)) AS INT)) AS bucket FROM x, s) GROUP BY bucket")
def chart_histogram(spark, sf_dir):
    return charts.histogram(_numbers(spark, sf_dir, "lineitem", "l_quantity")).select("bucket", "n")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def chart_month_counts(spark, sf_dir):
    days = read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("v")).agg(F.count("*").alias("cnt"))
    return charts.month_counts(days)


@query("WITH c AS (SELECT c_nationkey, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS k FROM c) SELECT CASE WHEN k <= 10 THEN CAST(c_nationkey AS VARCHAR) ELSE 'Other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def category_top10_other(spark, sf_dir):
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("v")).agg(F.count("*").alias("cnt"), F.min("c_custkey").cast("long").alias("first_row"))
    return charts.category_counts(c).select("label", "n")


def _scored(spark, sf_dir, table: str, key: str) -> pipeline.TableResult:
    result = pipeline.score_table(from_dataframe(read(spark, sf_dir, table), table, key), as_of_year=2024)
    result.release()
    return result


@query()
def scorecard_supplier(spark, sf_dir):
    r = _scored(spark, sf_dir, "supplier", "s_suppkey")
    return spark.createDataFrame([(d, float(s)) for d, s in {**r.scorecard.dimensions, "overall": r.scorecard.overall}.items()], "dimension string, score double")


@query()
def column_scores_part(spark, sf_dir):
    return pipeline.columns_frame(spark, _scored(spark, sf_dir, "part", "p_partkey"))


@query()
def findings_nation(spark, sf_dir):
    return pipeline.findings_frame(spark, _scored(spark, sf_dir, "nation", "n_nationkey").findings)
