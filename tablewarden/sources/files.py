"""CSV and workbook files as tables of strings, by Python data sources and Spark's own readers.

A file's head decides its encoding and where its header is.  The records themselves are read on an executor,
one file a partition, and keep their number of fields, so ragged rows can be told.  Large clean CSV files are
better read with ``load_large_csv``, which leaves splitting to Spark.
"""

from __future__ import annotations

import csv
import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from charset_normalizer import from_bytes
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablewarden.functions.text import NULL_CELLS
from tablewarden.operators.profile import EMPTY_MESSAGE, Table

# Rows of a head, and the shares that make a row a header.
HEAD, NARROW, LIKE_HEADER, LEAST_WIDTH, ROWS_AFTER = 10, 0.5, 0.6, 3, 2
CHAOS = 0.2
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def decode(raw: bytes) -> tuple[str, str | None]:
    """The text, and a warning where it isn't UTF-8."""
    try:
        return raw.decode("utf-8-sig"), None
    except UnicodeDecodeError:
        pass
    best = from_bytes(raw).best()
    if best is not None and best.chaos <= CHAOS:
        return str(best), f"This file isn't UTF-8; it was read as {best.encoding}."
    return raw.decode("latin-1"), "This file isn't UTF-8 and its encoding is unclear; it was read as Latin-1."


def filled(row: list) -> int:
    return sum(1 for c in row if c is not None and str(c).strip() != "")


def header_row(rows: list[list]) -> int:
    """Index of the header among the first rows: below a narrow preamble, above rows of its width."""
    widths = [filled(r) for r in rows[:HEAD]]
    most = max(widths, default=0)
    at = widths.index(most) if widths else 0
    after = widths[at + 1 : at + 1 + ROWS_AFTER]
    fits = most >= LEAST_WIDTH and at > 0 and all(w <= NARROW * most for w in widths[:at]) and len(after) == ROWS_AFTER and all(w >= LIKE_HEADER * most for w in after)
    return at if fits else 0


def mangled(header: list) -> list[str]:
    """Column names: blanks numbered, repeats marked."""
    out: list[str] = []
    for i, h in enumerate(header):
        name = f"Unnamed: {i}" if h is None or str(h) == "" else str(h)
        base, k = name, 0
        while name in out:
            k += 1
            name = f"{base}.{k}"
        out.append(name)
    return out


class _Whole(InputPartition):
    pass


class _RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.skip = options["path"], int(options["skip"])

    def partitions(self):
        return [_Whole(0)]

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            text, _ = decode(f.read())
        records = csv.reader(io.StringIO(text))
        for i, row in enumerate(records):
            if i > self.skip:
                yield i - self.skip - 1, len(row), row


class RecordSource(DataSource):
    """Records of a CSV file after its header: _row_id, _n_fields, cells."""

    @classmethod
    def name(cls) -> str:
        return "csv_records"

    def schema(self) -> str:
        return "_row_id long, _n_fields int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options)


def sheet_names(raw: bytes) -> list[tuple[str, str]]:
    """(name, member of the archive) of each sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return [(s.get("name"), "xl/" + links[s.get(_REL)].removeprefix("/xl/")) for s in book.iter(f"{_SHEET}sheet")]


def _place(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


# Numbers of the formats that workbooks come with and that show days or times.
_DAY_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _day_styles(z: zipfile.ZipFile) -> set[str]:
    """Cell styles whose format shows days or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {f.get("numFmtId"): re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{_SHEET}numFmt")}
    days = {n for n, code in own.items() if re.search("[dmyhs]", code.lower().replace("general", ""))}
    cells = styles.find(f"{_SHEET}cellXfs")
    return {str(i) for i, x in enumerate(cells if cells is not None else ()) if x.get("numFmtId") in days or (x.get("numFmtId") not in own and int(x.get("numFmtId", 0)) in _DAY_FORMATS)}


def _day(serial: str, late: bool) -> str:
    """The day and time that a serial number stands for; ``late``: days count from 1904."""
    n = float(serial)
    first = datetime.datetime(1904, 1, 1) if late else datetime.datetime(1899, 12, 31 if n < 60 else 30)
    when = first + datetime.timedelta(seconds=round(n * 86_400))
    return str(when.time()) if 0 <= n < 1 else str(when)


def sheet_rows(raw: bytes, member: str) -> Iterator[list]:
    """Cells of a sheet as strings, days as yyyy-mm-dd hh:mm:ss; None where there is none."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        days = _day_styles(z)
        settings = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_SHEET}workbookPr")
        late = settings is not None and settings.get("date1904") in ("1", "true")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        sheet = ElementTree.fromstring(z.read(member))
    last = 0
    for row in sheet.iter(f"{_SHEET}row"):
        number = int(row.get("r", last + 1))
        yield from ([] for _ in range(number - last - 1))
        last = number
        cells: list = []
        for c in row.iter(f"{_SHEET}c"):
            at = _place(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            v = c.find(f"{_SHEET}v")
            if c.get("t") == "s":
                cells[at] = shared[int(v.text)]
            elif c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            elif v is not None and c.get("s") in days and c.get("t", "n") == "n" and v.text and float(v.text) >= 0:
                cells[at] = _day(v.text, late)
            elif v is not None:
                cells[at] = {"1": "True", "0": "False"}.get(v.text, v.text) if c.get("t") == "b" else v.text
        yield cells


def _table(name: str, records: DataFrame, header: list, skipped: int, warning: str | None, keep_blank: bool) -> Table:
    """``records``: _row_id, _n_fields, cells."""
    names = mangled(header)
    if not names:
        raise ValueError(EMPTY_MESSAGE)
    first = records.agg(F.max("_n_fields").alias("widest"), F.count("*").alias("n"), F.count_if(F.col("_n_fields") != len(names)).alias("ragged")).first()
    if (first.widest or 0) > len(names):
        raise ValueError(f"A row has {first.widest} fields where the header has {len(names)}.")
    if not keep_blank:
        records = records.where("_n_fields > 0")
    cell = lambda i: F.get("cells", F.lit(i))
    columns = [F.when(cell(i).isin(*NULL_CELLS), None).otherwise(cell(i)).alias(f"c{i}") for i in range(len(names))]
    df = records.select("_row_id", *columns)
    if df.isEmpty():
        raise ValueError(EMPTY_MESSAGE)
    return Table(name, df, names, ragged_rows=first.ragged, data_records=first.n, skipped_rows=skipped, encoding_warning=warning)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read()
    if not raw:
        raise ValueError("Nothing to read: the file is empty.")
    return raw


def load_csv(spark: SparkSession, path: str, name: str | None = None) -> Table:
    text, warning = decode(_read(path))
    head = [r for r, _ in zip(csv.reader(io.StringIO(text)), range(HEAD), strict=False)]
    at = header_row(head)
    if not head or len(head) <= at or not any(head):
        raise ValueError(EMPTY_MESSAGE)
    spark.dataSource.register(RecordSource)
    records = spark.read.format("csv_records").option("path", path).option("skip", at).load()
    return _table(name or path.rsplit("/", 1)[-1], records, head[at], at, warning, keep_blank=at > 0)


def load_sheet(spark: SparkSession, raw: bytes, member: str, name: str) -> Table:
    rows = list(sheet_rows(raw, member))
    at = header_row(rows)
    if len(rows) <= at + 1:
        raise ValueError(EMPTY_MESSAGE)
    width = len(rows[at])
    body = [(i, width, [*r[:width], *[None] * (width - len(r))]) for i, r in enumerate(rows[at + 1 :])]
    table = _table(name, spark.createDataFrame(body, "_row_id long, _n_fields int, cells array<string>"), rows[at], at, None, keep_blank=True)
    table.ragged_rows = 0
    return table


def load_dataset(spark: SparkSession, path: str) -> Table:
    """One table: a CSV file, or the first sheet of a workbook."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return load_csv(spark, path)
    if kind == "xls":
        raise ValueError("Workbooks of the old .xls kind can't be read; save the file as .xlsx.")
    if kind == "xlsx":
        raw = _read(path)
        return load_sheet(spark, raw, sheet_names(raw)[0][1], path.rsplit("/", 1)[-1])
    raise ValueError(f"Unsupported file type '.{kind}'; use .csv or .xlsx.")


def load_all_tables(spark: SparkSession, path: str) -> list[tuple[str, Table | None, str | None]]:
    """(name, table, error) of every table of a file; nothing is raised."""
    base = path.rsplit("/", 1)[-1]

    def attempt(name: str, load) -> tuple[str, Table | None, str | None]:
        try:
            return name, load(), None
        except ValueError as e:
            return name, None, str(e)
        except Exception as e:  # a broken table must not stop the others
            return name, None, f"This table couldn't be read: {e}"

    if not path.lower().endswith(".xlsx"):
        return [attempt(base, lambda: load_dataset(spark, path))]
    try:
        raw = _read(path)
        sheets = sheet_names(raw)
    except Exception as e:  # not a workbook
        return [(base, None, str(e) if isinstance(e, ValueError) else f"This table couldn't be read: {e}")]
    return [attempt(f"{base} -> {n}", lambda m=m, n=n: load_sheet(spark, raw, m, f"{base} -> {n}")) for n, m in sheets]


def load_large_csv(spark: SparkSession, path: str, name: str) -> Table:
    """A clean CSV file (header first, UTF-8) that Spark splits; row order follows the file's splits."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    cells = [F.when(F.col(f"`{c}`").isin(*NULL_CELLS), None).otherwise(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    return Table(name, df.select(F.monotonically_increasing_id().alias("_row_id"), *cells), list(df.columns))


# Words and ranges of the synthetic directory.
FRONT = ("Shree", "Royal", "National", "Modern", "Sunrise", "Golden", "Eastern", "Prime", "Lotus", "Crown", "Union", "Metro")
BACK = ("Traders", "Textiles", "Foods", "Motors", "Steel", "Papers", "Chemicals", "Ceramics", "Timber", "Exports", "Garments", "Tools")
GIVEN, FAMILY = ("Asha", "Ben", "Cyra", "Dev", "Eli", "Fay", "Gita", "Hari"), ("Rao", "Roy", "Nair", "Shah", "Joshi", "Kurup")
TOWNS, TRADES = ("Surat", "Pune", "Indore", "Nagpur", "Rajkot"), ("Manufacturing", "Trading", "Services", "Retail", "Wholesale")


def directory(spark: SparkSession, n: int, seed: int = 7, misspelled: int = 40, copied: int = 60) -> DataFrame:
    """A synthetic business directory of n rows: one name in ``misspelled`` has two letters turned round, and one row
    in ``copied`` is the row before it under another key (0: none).  Each cell is a function of seed and row number,
    so any part of any size can be made again."""
    own = F.col("id") - (F.pmod("id", F.lit(copied)) == copied - 1).cast("long") if copied > 1 else F.col("id")
    number = lambda salt, top: F.pmod(F.xxhash64("own", F.lit(seed), F.lit(salt)), F.lit(top))
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (number(salt, len(words)) + 1).cast("int"))
    df = spark.range(n).withColumn("own", own).withColumn("name", F.concat_ws(" ", pick(FRONT, 1), pick(BACK, 2)))
    turned = F.concat(F.substring("name", 1, 1), F.substring("name", 3, 1), F.substring("name", 2, 1), F.expr("substring(name, 4)"))
    return df.select(
        F.col("id").alias("row"), (F.when(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(misspelled)) == 0, turned).otherwise(F.col("name")) if misspelled else F.col("name")).alias("Business_Name"),
        F.concat_ws(" ", pick(GIVEN, 3), pick(FAMILY, 4)).alias("Owner_Name"), F.format_string("GST%09d", number(5, 10**9)).alias("GST_Number"), pick(TRADES, 6).alias("Business_Category"), pick(TOWNS, 7).alias("City"),
        (number(8, 9000) * 1000 + 150_000).cast("string").alias("Annual_Turnover"), F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), number(9, 3200).cast("int")), "yyyy-MM-dd").alias("Registration_Date"),
        (number(10, 59) + 2).cast("string").alias("Employee_Count"), F.format_string("9%09d", number(11, 10**9)).alias("Phone_Number"), F.concat(F.lower(F.replace("name", F.lit(" "), F.lit(""))), F.lit("@example.com")).alias("Email"),
    )
