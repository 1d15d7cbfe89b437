"""Reading one table from files, a SQL database or document exports."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistrata.functions.columns import NUMBER, col, finite_frame, quoted, to_number
from vistrata.functions.names import drop_document_id, flatten
from vistrata.session import stage

# Words read as missing in text files, and number words.
MISSING_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                 "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
INFINITE = r"(?i)^[+-]?(inf|infinity|nan)$"
BOOLEAN_WORDS = ["true", "false", "TRUE", "FALSE", "True", "False"]

# Source kind by suffix, then by scheme.
SUFFIX_KINDS = {".csv": "csv", ".xlsx": "excel", ".xls": "excel"}
SCHEME_KINDS = {
    "sqlite://": "sqlite",
    "postgres://": "postgres",
    "postgresql": "postgres",
    "mysql": "mysql",
    "mongodb://": "mongodb",
    "mongodb+srv://": "mongodb",
    "oracle": "oracle",
}

# JDBC sub-protocol, driver class and table listing per database.
JDBC = {
    "sqlite": ("sqlite", "org.sqlite.JDBC", "SELECT name AS table_name FROM sqlite_master WHERE type = 'table'"),
    "postgres": ("postgresql", "org.postgresql.Driver",
                 "SELECT table_name FROM information_schema.tables "
                 "WHERE table_schema = current_schema() AND table_type = 'BASE TABLE'"),
    "mysql": ("mysql", "com.mysql.cj.jdbc.Driver",
              "SELECT table_name FROM information_schema.tables "
              "WHERE table_schema = database() AND table_type = 'BASE TABLE'"),
    "oracle": ("oracle:thin", "oracle.jdbc.OracleDriver", "SELECT table_name FROM user_tables"),
}


def detect_source(uri: str) -> str:
    """csv, excel, sqlite, postgres, mysql, mongodb or oracle; case and outer blanks do not matter."""
    text = uri.strip().lower()
    for suffix, kind in SUFFIX_KINDS.items():
        if text.endswith(suffix):
            return kind
    for scheme, kind in SCHEME_KINDS.items():
        if text.startswith(scheme):
            return kind
    raise ValueError(f"unsupported source: {uri}")


def jdbc_url(uri: str) -> tuple[str, dict[str, str]]:
    """Database URL (`postgres://user:pw@host:5432/db`, any `+driver` part) -> JDBC URL and properties."""
    uri = uri.strip()
    protocol, driver, _ = JDBC[detect_source(uri)]
    _, _, rest = uri.partition("://")
    credentials, at, place = rest.rpartition("@")
    properties = {"driver": driver}
    if at:
        user, _, password = credentials.partition(":")
        properties["user"] = unquote(user)
        if password:
            properties["password"] = unquote(password)
    if protocol == "sqlite":
        return f"jdbc:sqlite:{rest.removeprefix('/')}", properties
    if protocol == "oracle:thin":
        return f"jdbc:oracle:thin:@//{place}", properties
    return f"jdbc:{protocol}://{place}", properties


def list_tables(spark: SparkSession, uri: str | None = None) -> DataFrame:
    """table_name rows of a database, or of the session's own catalog."""
    if uri is None:
        names = [(t.name,) for t in spark.catalog.listTables()]
        return spark.createDataFrame(names, "table_name string")
    url, properties = jdbc_url(uri)
    query = JDBC[detect_source(uri)][2]
    return spark.read.jdbc(url, f"({query}) tables", properties=properties)


def read_sql_table(spark: SparkSession, uri: str, table: str | None = None,
                   partition_column: str | None = None, partitions: int | None = None) -> DataFrame:
    """A database table, the first one if none is named. Filters, columns and limits reach the database.

    With a numeric `partition_column` the table is read by parallel range queries.
    """
    url, properties = jdbc_url(uri)
    if table is None:
        found = list_tables(spark, uri).limit(1).collect()
        if not found:
            raise ValueError("the database holds no table")
        table = found[0][0]
    if partition_column is None:
        return spark.read.jdbc(url, table, properties=properties)
    low, high = spark.read.jdbc(
        url, f"(SELECT min({partition_column}), max({partition_column}) FROM {table}) bounds",
        properties=properties).first()
    if low is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=int(low), upperBound=int(high) + 1,
                           numPartitions=partitions or spark.sparkContext.defaultParallelism,
                           properties=properties)


def infer_text_columns(df: DataFrame) -> DataFrame:
    """Give all-text columns their type: missing words become NULL, then whole number, double, boolean or text.

    One pass over the data decides for every column. Dates stay text.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    clean = df.withColumns({c: F.when(~F.trim(col(c)).isin(MISSING_WORDS), col(c)) for c in texts})
    checks = []
    for i, c in enumerate(texts):
        text = F.trim(col(c))
        checks += [F.count(col(c)).alias(f"n{i}"),
                   F.count_if(text.rlike(NUMBER) | text.rlike(INFINITE)).alias(f"d{i}"),
                   F.count(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))).alias(f"w{i}"),
                   F.count_if(text.isin(BOOLEAN_WORDS)).alias(f"b{i}")]
    seen = clean.agg(*checks).first()
    out = {}
    for i, c in enumerate(texts):
        n = seen[f"n{i}"]
        if n == 0:
            out[c] = F.lit(None).cast("double")
        elif seen[f"w{i}"] == n:
            out[c] = F.trim(col(c)).cast("bigint")
        elif seen[f"d{i}"] == n:
            out[c] = to_number(col(c))
        elif seen[f"b{i}"] == n:
            out[c] = F.lower(F.trim(col(c))).cast("boolean")
    return clean.withColumns(out) if out else clean


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header row, typed by `infer_text_columns`.

    Where the caller does not say whether records run over several lines, one scan decides: such a record has a line
    with an odd number of quotes. Then records are put together from lines, and the file is still read by many tasks.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    if not multi_line:
        return infer_text_columns(spark.read.csv(path, header=True, escape='"'))
    return infer_text_columns(split_records(csv_records(spark, path)))


SPLIT = ["file", "block"]
LINE_SCHEMA = "file string, block bigint, seq bigint, record bigint, alone boolean, value string"


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of lines of one split of a file."""
    blocks = batch.column("block").to_numpy(zero_copy_only=False)
    files = batch.column("file").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1).tolist(), len(blocks)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.column("file")[a].as_py(), int(blocks[a]), batch.slice(a, b - a)


def _odd_before(lines: pa.RecordBatch, odd: int) -> tuple[np.ndarray, int]:
    """Whether the quotes before each line are odd in number, and those before the next lines."""
    quotes = pc.count_substring(lines.column("value"), '"').to_numpy(zero_copy_only=False)
    total = odd + np.cumsum(quotes)
    return (total - quotes) % 2, int(total[-1] % 2)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record, value: the records of CSV files by their number in the file, line breaks inside quotes kept.

    Every split of a file is read by a task of its own. A first pass counts, for each split, its quotes and its lines
    that begin after an even number of them. Running sums over the splits of a file - a row per split - tell whether a
    split begins inside quotes and which number its first record has. In the second pass, records of one line go
    straight on; only the lines of longer records are shuffled, to meet by record number.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, odd, even_lines, n = None, 0, 0, 0
        give = lambda: pa.RecordBatch.from_pydict({"file": [split[0]], "block": [split[1]], "odd": [odd], "even_lines": [even_lines], "n": [n]})
        for batch in batches:
            for file, block, part in _stretches(batch):
                if split != (file, block):
                    if split is not None:
                        yield give()
                    split, odd, even_lines, n = (file, block), 0, 0, 0
                before, odd = _odd_before(part, odd)
                even_lines += int((before == 0).sum())
                n += part.num_rows
        if split is not None:
            yield give()

    counted = stage(lines.mapInArrow(count, "file string, block bigint, odd bigint, even_lines bigint, n bigint"), "splits")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2
    starts = counted.withColumn("inside", inside).withColumn("begun", F.when(F.col("inside") == 0, F.col("even_lines")).otherwise(F.col("n") - F.col("even_lines")))
    starts = starts.select("file", "block", "inside", F.coalesce(F.sum("begun").over(earlier), F.lit(0)).alias("first"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, odd, record, seq = None, 0, 0, 0
        for batch in batches:
            for file, block, part in _stretches(batch):
                if split != (file, block):
                    split, odd, seq = (file, block), part.column("inside")[0].as_py(), 0
                    record = part.column("first")[0].as_py() - 1
                before, odd = _odd_before(part, odd)
                begins = before == 0
                # A line that begins a record is all of it if no quote is open at its end.
                alone = begins & (np.append(before[1:], odd) == 0)
                records, place = record + np.cumsum(begins), seq + np.arange(part.num_rows)
                record, seq = int(records[-1]), seq + part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("file"), part.column("block"), pa.array(place), pa.array(records), pa.array(alone), part.column("value")],
                                                 names=["file", "block", "seq", "record", "alone", "value"])

    # A row per split of the input.
    numbered = lines.join(F.broadcast(starts), SPLIT).select(*SPLIT, "inside", "first", "value").mapInArrow(number, LINE_SCHEMA)
    # An empty line outside quotes is no record.
    single = numbered.where("alone AND value NOT IN ('', '\r')").select("file", "record", "value")
    joined = numbered.where("NOT alone").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"))
    return single.unionByName(joined.select("file", "record", F.array_join("parts.value", "\n").alias("value"))).withColumn(
        "value", F.regexp_replace("value", "\r$", ""))


def split_records(records: DataFrame) -> DataFrame:
    """Text columns of CSV records; the first record of each file is its header, and the first file's names hold."""
    heads = records.where("record = 0")
    head = heads.orderBy("file").limit(1).collect()
    if not head:
        raise ValueError("the file has no header row")
    first = next(csv.reader(io.StringIO(head[0]["value"].removeprefix("\ufeff"), newline="")))
    names: list[str] = []
    for i, name in enumerate(first):
        names.append(f"_c{i}" if name == "" else name if first.count(name) == 1 else f"{name}{i}")
    made = F.from_csv("value", ", ".join(f"{quoted(n)} string" for n in names), {"escape": '"'})
    return records.where("record > 0").select(made.alias("r")).select("r.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON document exports, one a line: nested fields become dotted columns, the document id is dropped. A field of
    mixed types gets the type most of its values have (see `read_mixed_documents`)."""
    return read_mixed_documents(spark, path)[0]


# Kinds of JSON values by the types a variant reports, and what a column of each kind becomes.
KINDS = [("whole", "^BIGINT$", "bigint"), ("number", "^(DECIMAL|DOUBLE|FLOAT)", "double"), ("truth", "^BOOLEAN$", "boolean"),
         ("text", "^STRING$", None), ("nested", "^(OBJECT|ARRAY)", None)]


def _string_paths(kind: T.StructType, above: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    """Paths of text fields: what Spark's inference gives a field of mixed types."""
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _string_paths(f.dataType, (*above, f.name))
        elif isinstance(f.dataType, T.StringType):
            yield (*above, f.name)


def _variant_path(path: tuple[str, ...]) -> str:
    return "$" + "".join("[\"" + name.replace("\\", "\\\\").replace('"', '\\"') + "\"]" for name in path)


def read_mixed_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The documents, and a report of fields with values of several types: column, kind, values, kept.

    Spark's inference makes a field text as soon as two values differ in type. Such fields are looked at again as
    variants: one scan counts the types of all of them, and where most values are numbers or truth values the column
    is of that type. Its other values stand as text in a further column, `<name>_other`. Where text or nested values
    are the most, all values stay text.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    schema = spark.read.json(path).schema
    schema = T.StructType([f for f in schema.fields if f.name != spark.conf.get("spark.sql.columnNameOfCorruptRecord")])
    paths = list(_string_paths(schema))
    docs = lines.select(F.from_json("value", schema).alias("d"), F.try_parse_json("value").alias("v"))
    empty = spark.createDataFrame([], "column string, kind string, values bigint, kept boolean")
    if not paths:
        return drop_document_id(flatten(docs.select("d.*"))), empty
    at = {p: _variant_path(p) for p in paths}
    types = F.array(*[F.struct(F.lit(i).alias("i"), F.schema_of_variant(F.try_variant_get("v", at[p], "variant")).alias("type")) for i, p in enumerate(paths)])
    kind = F.coalesce(*[F.when(F.col("type").rlike(pattern), F.lit(name)) for name, pattern, _ in KINDS])
    counted = docs.select(F.inline(types)).select("i", kind.alias("kind")).where("kind IS NOT NULL").groupBy("i", "kind").agg(F.count("*").alias("values"))
    found: dict[int, dict[str, int]] = {}
    for r in counted.collect():  # a few rows per field
        found.setdefault(r["i"], {})[r["kind"]] = r["values"]
    changed, report = {}, []
    for i, p in enumerate(paths):
        kinds = found.get(i, {})
        if len(kinds) < 2:
            continue
        numbers = kinds.get("whole", 0) + kinds.get("number", 0)
        best = max([("number" if kinds.get("number") else "whole", numbers), *((k, kinds.get(k, 0)) for k in ("truth", "text", "nested"))], key=lambda x: x[1])[0]
        to = {name: target for name, _, target in KINDS}[best]
        kept = {"whole", "number"} if best in ("whole", "number") else {best}
        report += [(".".join(p), k, n, to is None or k in kept) for k, n in sorted(kinds.items())]
        if to:
            changed[p] = (to, kept)
    out = []
    for f in flatten(docs.select("d.*")).columns:
        p = next((x for x in changed if ".".join(x) == f), None)
        if p is None:
            out.append((f, None))
        else:
            out += [(f, p), (f"{f}_other", p)]
    plain = flatten(docs.select("d.*", F.col("v").alias("_variant")))
    cells = []
    for name, p in out:
        if p is None:
            cells.append(col(name))
            continue
        to, kept = changed[p]
        value = F.try_variant_get("_variant", at[p], "variant")
        patterns = "|".join(pattern for k, pattern, _ in KINDS if k in kept)
        fits = F.schema_of_variant(value).rlike(patterns)
        cells.append((F.when(~fits, col(".".join(p))) if name.endswith("_other") else F.when(fits, F.try_variant_get("_variant", at[p], to))).alias(name))
    return drop_document_id(plain.select(*cells)), spark.createDataFrame(report, empty.schema)


# Databases a document server keeps for itself.
INTERNAL_DATABASES = ["admin", "local", "config"]


def first_collection(listing: dict[str, list[str]], database: str = "", collection: str = "") -> tuple[str, str]:
    """Database and collection to read from a server's listing: the named ones, else the first of each."""
    names = [d for d in listing if d not in INTERNAL_DATABASES]
    if not names:
        raise ValueError("the server holds no database")
    database = database or names[0]
    if not listing.get(database):
        raise ValueError(f"database {database} holds no collection")
    return database, collection or listing[database][0]


# --- workbooks -------------------------------------------------------------------------------------------

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
SHEET_SCHEMA = "path string, row bigint, cells array<string>"


def _sheet_rows(content: bytes, sheet: str | None) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cell texts) of one sheet, the first one if none is named. Dates come out as ISO text."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for item in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ET.fromstring(book.read("xl/styles.xml"))
        custom = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt")
                  if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
        formats = styles.find(f"{_MAIN}cellXfs")
        dated = [int(x.get("numFmtId", 0)) in DATE_FORMATS | custom for x in (formats if formats is not None else [])]
    workbook = ET.fromstring(book.read("xl/workbook.xml"))
    sheets = [(s.get("name"), s.get(f"{_REL}id")) for s in workbook.iter(f"{_MAIN}sheet")]
    settings = workbook.find(f"{_MAIN}workbookPr")
    old_mac = settings is not None and settings.get("date1904", "0") in ("1", "true")
    epoch = datetime(1904, 1, 1) if old_mac else datetime(1899, 12, 30)
    wanted = sheets[0][1] if sheet is None else dict(sheets)[sheet]
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[wanted].lstrip("/")
    with book.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
        number = 0
        for _, node in ET.iterparse(stream):
            if node.tag != f"{_MAIN}row":
                continue
            number = int(node.get("r", number + 1))
            cells: list[str | None] = []
            for c in node.iter(f"{_MAIN}c"):
                place = 0
                for letter in re.match("[A-Z]*", c.get("r", "")).group():
                    place = place * 26 + ord(letter) - 64
                while len(cells) < (place or len(cells) + 1):
                    cells.append(None)
                kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif kind == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                elif kind == "n" and value and dated and dated[int(c.get("s", 0))]:
                    moment = epoch + timedelta(days=float(value))
                    value = (moment + timedelta(microseconds=500)).replace(microsecond=0).isoformat()
                cells[-1] = value
            yield number, cells
            node.clear()


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Sheet of one workbook, or of every workbook in a folder. Only `.xlsx` is read."""
    if path.strip().lower().endswith(".xls"):
        raise ValueError("workbooks in the older .xls format are not read; save them as .xlsx")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
    return read_workbooks(files.select("path", "content"), sheet)


def read_workbooks(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Rows of (path, content) workbooks; one task reads one workbook at a time.

    The first row of a sheet names its columns, and columns of several workbooks meet by name; one that a workbook
    lacks is missing there. The first sheet is read if none is named.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                part = []
                for number, cells in _sheet_rows(content, sheet):
                    part.append((name, number, cells))
                    if len(part) == 10_000:
                        yield pd.DataFrame(part, columns=["path", "row", "cells"])
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=["path", "row", "cells"])

    # Parsed once: the header, the types and every later query read the staged cells.
    cells = stage(files.repartition("path").mapInPandas(rows, SHEET_SCHEMA), "sheets")
    named = F.transform("cells", lambda n, i: F.coalesce(n, F.concat(F.lit("Unnamed: "), i.cast("string"))))
    heads = cells.where("row = 1").select("path", named.alias("names"))
    # One row per distinct header.
    layouts = heads.groupBy("names").agg(F.min("path").alias("path")).orderBy("path").collect()
    if not layouts:
        raise ValueError("the workbooks have no rows")
    names = list(dict.fromkeys(n for layout in layouts for n in layout["names"]))
    if len(layouts) == 1:
        body = cells.where("row > 1").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    else:
        body = cells.where("row > 1").join(heads, "path").select(*[
            F.when(F.array_contains("names", n), F.get("cells", (F.array_position("names", n) - 1).cast("int"))).alias(n) for n in names])
    return infer_text_columns(body)


# --- entry point -----------------------------------------------------------------------------------------

def load_table(spark: SparkSession, uri: str, table: str | None = None, multi_line: bool | None = None,
               partition_column: str | None = None, partitions: int | None = None) -> DataFrame:
    """One table from any supported source, with NaN and infinities missing and decimals as doubles.

    `multi_line` is for CSV (see `read_csv`); `partition_column` and `partitions` let a database table be read by
    parallel range queries.
    """
    kind = detect_source(uri)
    if kind == "csv":
        df = read_csv(spark, uri.strip(), multi_line)
    elif kind == "excel":
        df = read_excel(spark, uri.strip(), table)
    elif kind == "mongodb":
        df = read_collection(spark, uri.strip(), table)
    else:
        df = read_sql_table(spark, uri, table, partition_column, partitions)
    return finite_frame(df)


def read_collection(spark: SparkSession, uri: str, collection: str | None) -> DataFrame:
    """`database.collection` of a document server, through its Spark connector (not bundled)."""
    if not collection or "." not in collection:
        raise ValueError("name the collection as database.collection")
    database, _, name = collection.partition(".")
    df = (spark.read.format("mongodb").option("connection.uri", uri)
          .option("database", database).option("collection", name).load())
    return drop_document_id(flatten(df))
