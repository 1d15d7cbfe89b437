"""Source detection, readers and writers."""

import csv
import io
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vistrata.catalog.files import workbook
from vistrata.plans.dashboard import dashboard
from vistrata.sources import load, sinks


@pytest.mark.parametrize("uri, kind", [
    (" Data.CSV ", "csv"), ("book.xlsx", "excel"), ("old.XLS", "excel"), ("sqlite:///a.db", "sqlite"),
    ("postgres://h/d", "postgres"), ("postgresql+asyncpg://h/d", "postgres"), ("mysql+pymysql://h/d", "mysql"),
    ("mongodb+srv://h", "mongodb"), ("MONGODB://h", "mongodb"), ("oracle+cx_oracle://h/d", "oracle")])
def test_detection(uri, kind):
    assert load.detect_source(uri) == kind


def test_unknown_source():
    with pytest.raises(ValueError):
        load.detect_source("data.parquet.gz")


@pytest.mark.parametrize("uri, url, user", [
    ("postgres://me:pw@host:5432/db", "jdbc:postgresql://host:5432/db", "me"),
    ("postgresql+psycopg2://me:p@ss@host/db", "jdbc:postgresql://host/db", "me"),
    ("mysql://host/db", "jdbc:mysql://host/db", None),
    ("oracle://me:pw@host:1521/service", "jdbc:oracle:thin:@//host:1521/service", "me"),
    ("sqlite:///data/a.db", "jdbc:sqlite:data/a.db", None)])
def test_jdbc_url(uri, url, user):
    got, properties = load.jdbc_url(uri)
    assert got == url and properties.get("user") == user and properties["driver"]


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,price,ok,day,note,empty\n1,1.5,True,2024-01-01,"a, ""b""",\n2,NA,False,2024-01-02,,\n3,inf,True,x,null,NA\n')
    df = load.load_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double"]
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows == [(1, 1.5, True, "2024-01-01", 'a, "b"', None), (2, None, False, "2024-01-02", None, None),
                    (3, None, True, "x", None, None)]


def test_dashboard_of_a_file_with_odd_names(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("Order Date,Total (USD),Qty.;=,Seg{x}\n" + "".join(
        f"2024-{1 + i // 28:02d}-{1 + i % 28:02d},{100 + i * 1.5},{i % 5},{'AB'[i % 2]}\n" for i in range(100)))
    board = dashboard(load.load_table(spark, str(path)))
    assert board.cleaned.columns == ["Order Date", "Total (USD)", "Qty_;=", "Seg{x}"]
    assert dict(board.labelled.dtypes)["Order Date"] == "timestamp"
    assert board.forecasts.where("series = 'Total (USD)'").count() == 30
    assert board.profile["statistics"].where("column = 'Order Date'").count() == 1
    points = board.charts["group_means"]["avg_Total (USD)_by_Seg{x}"]["points"].orderBy("position").collect()
    assert [r["category"] for r in points] == ["B", "A"]


def test_csv_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"x\ny"\n')
    assert load.read_csv(spark, str(path), multi_line=True).first()["b"] == "x\ny"


def test_workbook_folder(spark, tmp_path):
    for i in range(2):
        rows = pd.DataFrame({"k": [i, i + 10], "t": ["x<y", "z"], "d": pd.to_datetime(["2024-03-01 00:00", "2024-03-02 12:30"]),
                             "v": [1.5, None]})
        (tmp_path / f"b{i}.xlsx").write_bytes(workbook(rows))
    df = load.read_excel(spark, str(tmp_path))
    assert dict(df.dtypes) == {"k": "bigint", "t": "string", "d": "string", "v": "double"}
    rows = [tuple(r) for r in df.orderBy("k").collect()]
    assert rows[0] == (0, "x<y", "2024-03-01T00:00:00", 1.5) and rows[3] == (11, "z", "2024-03-02T12:30:00", None)


def test_workbook_shared_strings_and_sheet_names(spark, tmp_path):
    main = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f"<workbook {main} xmlns:r='{office}'><sheets><sheet name='A' sheetId='1' r:id='r1'/>"
                      "<sheet name='B' sheetId='2' r:id='r2'/></sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='r1' Target='worksheets/a.xml'/>"
                      "<Relationship Id='r2' Target='/xl/worksheets/b.xml'/></Relationships>")
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>two </t></r><r><t>parts</t></r></si></sst>")
        book.writestr("xl/worksheets/a.xml", f"<worksheet {main}><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>0</v></c></row></sheetData></worksheet>")
        book.writestr("xl/worksheets/b.xml", f"<worksheet {main}><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='inlineStr'><is><t>ok</t></is></c></row>"
                      "<row r='2'><c r='A2' t='s'><v>1</v></c><c r='B2' t='b'><v>1</v></c></row></sheetData></worksheet>")
    path = tmp_path / "book.xlsx"
    path.write_bytes(out.getvalue())
    row = load.load_table(spark, str(path), "B").first()
    assert row["name"] == "two parts" and row["ok"] is True


def test_catalog_listing(spark):
    spark.range(1).createOrReplaceTempView("listed_view")
    assert load.list_tables(spark).where("table_name = 'listed_view'").count() == 1


def test_upload_modes(spark):
    with pytest.raises(ValueError):
        sinks.write_sql_table(spark.range(1), "postgres://h/d", "t", mode="ignore")


def test_documents_are_appended(spark, tmp_path):
    path = str(tmp_path / "docs")
    for _ in range(2):
        sinks.write_documents(spark.range(3), path)
    assert load.read_documents(spark, path).count() == 6


def test_collection_needs_a_name(spark):
    with pytest.raises(ValueError):
        load.load_table(spark, "mongodb://host")


def test_quoted_line_breaks_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"line one\nline ""two"""\n2,plain\n')
    rows = load.load_table(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'line one\nline "two"'), (2, "plain")]


def test_codes_and_long_ids_keep_their_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,id,x\n1d,1234567890123456789,0x1p3\n2f,1234567890123456788,1\n3D,1234567890123456787,2\n")
    df = load.load_table(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"code": "string", "id": "bigint", "x": "string"}
    assert df.select("id").distinct().count() == 3


def test_workbook_names_and_old_format(spark, tmp_path):
    import pandas as pd

    from vistrata.catalog.files import workbook
    (tmp_path / "R.XLSX").write_bytes(workbook(pd.DataFrame({"a": [1.5], "b": ["x"]})))
    (tmp_path / "s.xlsx").write_bytes(workbook(pd.DataFrame({"b": ["y"], "a": [2.5]})))
    assert load.load_table(spark, str(tmp_path / "R.XLSX")).first().asDict() == {"a": 1.5, "b": "x"}
    assert sorted(tuple(r) for r in load.read_excel(spark, str(tmp_path)).select("a", "b").collect()) == [(1.5, "x"), (2.5, "y")]
    with pytest.raises(ValueError, match="xlsx"):
        load.load_table(spark, str(tmp_path / "t.xls"))


def test_credentials_are_decoded():
    _, properties = load.jdbc_url("postgres://us%40er:p%40s%3As@host:5432/db")
    assert (properties["user"], properties["password"]) == ("us@er", "p@s:s")


def scrambled(tmp_path, name, rows, end="\n"):
    """A CSV file with line breaks, quotes and blank lines inside quotes."""
    path = tmp_path / name
    with open(path, "w", newline="") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(["id", "text", "n"])
        out.writerows(rows)
    return path


@pytest.mark.parametrize("size", [300, 4096])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_in_many_splits(spark, tmp_path, size, end):
    """The same rows however a file is split; records may span splits."""
    rng = random.Random(5)
    words = ["plain", "two\nlines", 'a "quoted" word', "blank\n\n\nlines", "", 'ends with "', '"', "\n", "x" * 200 + "\n" + "y" * 200, "comma, here", "é\nü"]
    rows = [(i, rng.choice(words) + rng.choice(words), i * 2) for i in range(90)]
    scrambled(tmp_path, "a.csv", rows, end)
    scrambled(tmp_path, "b.csv", rows[:3], end)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = load.csv_records(spark, str(tmp_path / "*.csv"))
        # More than one task reads the file.
        assert spark.read.text(str(tmp_path / "a.csv")).select(F.spark_partition_id().alias("p")).distinct().count() > 1
        made = load.split_records(records).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(str(i), t or None, str(n)) for i, t, n in rows + rows[:3]]
    assert sorted([(r["id"], r["text"] or None, r["n"]) for r in made], key=repr) == sorted(want, key=repr)


def test_csv_with_line_breaks_is_typed(spark, tmp_path):
    path = scrambled(tmp_path, "a.csv", [(1, "a\nb", 2.5), (2, "NA", ""), (3, 'say "hi"', 4)])
    df = load.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "text": "string", "n": "double"}
    assert sorted(map(tuple, df.collect())) == [(1, "a\nb", 2.5), (2, None, None), (3, 'say "hi"', 4.0)]


def test_csv_of_a_header_alone(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"a\nb",c\n')
    assert load.read_csv(spark, str(tmp_path / "h.csv")).columns == ["a\nb", "c"]
    (tmp_path / "e.csv").write_text('')
    with pytest.raises(ValueError):
        load.split_records(load.csv_records(spark, str(tmp_path / "e.csv")))


def documents(spark, tmp_path, lines):
    (tmp_path / "d.json").write_text("\n".join(lines) + "\n")
    return load.read_mixed_documents(spark, str(tmp_path / "d.json"))


def test_fields_of_mixed_types(spark, tmp_path):
    df, report = documents(spark, tmp_path, [
        '{"_id": 1, "a": 1, "b": {"c.d": 2.5, "e": "x"}, "f": true, "g": "12"}', '{"a": "one", "b": {"c.d": 3, "e": "y"}, "f": true, "g": "x"}',
        '{"a": 3, "b": {"c.d": "n/a", "e": null}, "f": "no", "h": [1, "2"]}', '{"a": {"deep": 1}, "b": {"c.d": [4]}, "f": false}', "", "not json", '{"a": 5, "b": {"c.d": 7}}'])
    assert [(c, t) for c, t in df.dtypes] == [("a", "bigint"), ("a_other", "string"), ("b.c.d", "double"), ("b.c.d_other", "string"), ("b.e", "string"),
                                              ("f", "boolean"), ("f_other", "string"), ("g", "string"), ("h", "array<string>")]
    rows = [(r["a"], r["a_other"], r["b.c.d"], r["b.c.d_other"], r["f"], r["f_other"]) for r in df.collect() if r["b.c.d"] or r["b.c.d_other"]]
    assert rows == [(1, None, 2.5, None, True, None), (None, "one", 3.0, None, True, None), (3, None, None, "n/a", None, "no"),
                    (None, '{"deep":1}', None, "[4]", False, None), (5, None, 7.0, None, None, None)]
    assert {(r["column"], r["kind"]): (r["values"], r["kept"]) for r in report.collect()} == {
        ("a", "whole"): (3, True), ("a", "text"): (1, False), ("a", "nested"): (1, False), ("b.c.d", "number"): (1, True), ("b.c.d", "whole"): (2, True),
        ("b.c.d", "text"): (1, False), ("b.c.d", "nested"): (1, False), ("f", "truth"): (3, True), ("f", "text"): (1, False)}


def test_documents_of_plain_types_keep_their_columns(spark, tmp_path):
    df, report = documents(spark, tmp_path, ['{"_id": "x", "n": 1, "s": "t", "o": {"p": 2}}', '{"n": 2.5, "s": null}'])
    assert dict(df.dtypes) == {"n": "double", "s": "string", "o.p": "bigint"} and report.count() == 0


def test_first_database_and_collection():
    listing = {"admin": ["x"], "config": ["y"], "shop": ["orders", "people"], "log": [], "local": []}
    assert load.first_collection(listing) == ("shop", "orders")
    assert load.first_collection(listing, collection="people") == ("shop", "people")
    assert load.first_collection(listing, "admin") == ("admin", "x")
    for bad in ({"admin": ["x"]}, {}):
        with pytest.raises(ValueError):
            load.first_collection(bad)
    with pytest.raises(ValueError):
        load.first_collection(listing, "log")
