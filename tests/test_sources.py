"""Readers, writers and streams on files written by the tests."""

import json

import pytest
from pyspark.sql import functions as F

from cairnspark.sources import readers, writers
from cairnspark.streaming import events


def test_header_detection():
    assert readers.detect_column(["Company Name", "x"], ["CompanyName"]) == "Company Name"
    assert readers.detect_column(["a"], ["b"]) is None


def test_csv_family(spark, tmp_path):
    for name in ("north", "south"):
        (tmp_path / f"{name}.csv").write_text("Company Name,Paid\nA,1\n")
    got = readers.read_family(spark, str(tmp_path), {"company": ["CompanyName"], "absent": ["nope"]}).collect()
    assert {(r.company, r.absent, r.source) for r in got} == {("A", None, "north"), ("A", None, "south")}


def test_csv_family_with_other_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text("Company,Status\nalpha,ACTV\n")
    (tmp_path / "two.csv").write_text("Status,Company Name\nACTV,zeta\n")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "three.csv").write_text('"Status"\ngone\n')
    columns = {"company": ["Company", "CompanyName"], "status": ["Status"]}
    got = {tuple(r) for r in readers.read_family(spark, str(tmp_path), columns).collect()}
    assert got == {("alpha", "ACTV", "one"), ("zeta", "ACTV", "two")}
    got = {tuple(r) for r in readers.read_family(spark, str(tmp_path), columns, recursive=True).collect()}
    assert (None, "gone", "three") in got and len(got) == 3
    assert readers.read_family(spark, str(tmp_path / "*.none"), columns).count() == 0


def test_csv_family_of_odd_files(spark, tmp_path):
    """A mark before the header, quotes, separators inside them, short rows, blank lines, repeated headers, no rows, an empty file."""
    (tmp_path / "a.csv").write_text('\ufeff"Company Name",Paid,Paid\n"x, y",1,2\n\nshort\n"Company Name",Paid,Paid\nz,,3\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("paid;other\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("Paid\n9\n")
    got = sorted(readers.read_family(spark, str(tmp_path), {"company": ["companyname"], "paid": ["Paid"]}).collect(), key=str)
    assert {tuple(r) for r in got} == {("x, y", "1", "a"), ("short", None, "a"), ("z", None, "a")}


def test_ten_thousand_files_are_one_scan(spark, tmp_path):
    """Headers are found by tasks: no file is opened by the driver, and the number of jobs does not depend on the number of files."""
    for i in range(10_000):
        head, row = ("Status,Company", f"s{i % 7},n{i}") if i % 3 else ("Company Name,City,Status", f"n{i},c,s{i % 7}")
        (tmp_path / f"f{i}.csv").write_text(f"{head}\n{row}\n")
    spark.sparkContext.setJobGroup("family", "family")
    df = readers.read_family(spark, str(tmp_path), {"company": ["Company", "CompanyName"], "status": ["Status"]})
    r = df.agg(F.count("*").alias("n"), F.countDistinct("company").alias("names"), F.countDistinct("source").alias("files"), F.count_if(F.concat(F.lit("s"), (F.substring("company", 2, 9).cast("int") % 7).cast("string")) == F.col("status")).alias("right")).first()
    assert (r.n, r.names, r.files, r.right) == (10_000,) * 4
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("family")) < 40


def test_reshape_and_defaults(spark):
    raw = spark.createDataFrame([(" 1 ", "a", "5"), ("", "b", "6"), ("3", "", "x")], "`District Code` string, Name string, growth string")
    got = [tuple(r) for r in readers.reshape(raw, {"code": ["districtcode"], "name": ["Name"], "none": ["zz"]}, ["code"], {"aliases": ""}).collect()]
    assert got == [("1", "a", None, ""), ("3", "", None, "")]
    got = [tuple(r) for r in readers.numeric_defaults(raw, ["District", "Name"], {"growth": (["decadal", "growth"], 12.5), "literacy": (["literacy"], 78.0)}).collect()]
    assert got == [("a", 5.0, 78.0), ("b", 6.0, 78.0)]


def test_tables_without_headers(spark):
    cells = [("d", 1, ["Sr", "Code", "Address"]), ("d", 2, ["1", "K1", "x 641001"]), ("d", 3, ["2", "K1", "y 500001"]), ("d", 4, ["3", "K2", "none"])]
    df = spark.createDataFrame(cells, "doc string, row_no int, cells array<string>")
    got = {(r.code, r.address, r.pin) for r in readers.positional_rows(df, ["row_no"], {"code": 1, "address": 2}, "code", "address").collect()}
    assert got == {("K1", "x 641001", "641001"), ("K2", "none", None)}
    cells = [("d", 1, ["Total", "1,200", "7"]), ("d", 2, ["RURAL", "800", "x"]), ("d", 3, ["Total", "9", "9"]), ("e", 1, ["Urban", "4", "5"])]
    df = spark.createDataFrame(cells, "doc string, row_no int, cells array<string>")
    got = {r.doc: r for r in readers.labelled_rows(df, 0, {"people": 1, "homes": 2}, ["Total", "Rural", "Urban"]).collect()}
    assert (got["d"].people_total, got["d"].people_rural, got["d"].homes_rural, got["d"].people_urban, got["e"].people_urban) == (1200.0, 800.0, None, None, 4.0)


def test_literals_and_outputs(spark, tmp_path):
    assert {tuple(r) for r in readers.literal_table(spark, {"a": 1.5, "b": 2}, "name", "population").collect()} == {("a", 1.5), ("b", 2.0)}
    (tmp_path / "scores.csv").write_text("id,score\n1,2.5\n")
    (tmp_path / "meta.json").write_text('{\n"n": 3\n}')
    got = readers.load_outputs(spark, str(tmp_path), ["scores.csv", "meta.json", "none.csv"])
    assert set(got) == {"scores", "meta"} and got["scores"].first().score == 2.5 and got["meta"].first().n == 3


def test_inventory_counts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n\n3,4\n")
    (tmp_path / "b.json").write_text('{"k": 1, "l": {"m": 2}}')
    (tmp_path / "c.yaml").write_text("top: 1\nlist:\n  - inner: 2\n")
    got = {r.path.rpartition("/")[2]: (r.n_rows, r.n_columns, r["keys"]) for r in readers.inventory(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (2, 2, None), "b.json": (None, None, ["k", "l"]), "c.yaml": (None, None, ["top", "list"])}


def test_csv_with_repeated_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("State,%,n,%\nX,1,2,3\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert len(set(df.columns)) == 4 and [*df.first()] == ["X", "1", "2", "3"]


def test_entity_master(spark):
    rows = spark.createDataFrame([("7", " A ", "1", "G", ""), ("x", "B", "1", "G", "5")], "entity_id string, name string, group_id string, group_name string, census_code string")
    assert [tuple(r) for r in readers.entity_master(rows).collect()] == [(7, "A", 1, "G", 0)]


def test_multi_value(spark):
    assert spark.range(1).select(readers.multi_value(F.lit("a| b ||")).alias("x")).first().x == ["a", "b"]


def test_inventory(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    r = readers.inventory(spark, str(tmp_path)).first()
    assert (r.extension, r.bytes, r.category, r.sha16) == ("json", 2, "CONFIG", "44136fa355b3678a")


def test_facility_table(spark):
    cells = [("d", 1, 1, ["State/UT", "Name of the District", "Sub Centres", "PHCs"]), ("d", 1, 2, ["Goa", "North", "A1,200", "5"]), ("d", 1, 3, ["", "South", "NA", "-"]), ("d", 1, 4, ["", "Total", "9", "9"]), ("d", 2, 1, ["", "East", "3", "4"])]
    df = spark.createDataFrame(cells, "doc string, page int, row_no int, cells array<string>")
    got = {tuple(r) for r in readers.facility_rows(df, ["page", "row_no"], 4, ["sub", "phc"]).collect()}
    assert got == {("d", "Goa", "North", 1200.0, 5.0), ("d", "Goa", "South", None, None), ("d", "Goa", "East", 3.0, 4.0)}


def test_header_is_carried_across_pages(spark):
    cells = [("d", 1, 1, ["Sr.No", "Code", "District Name"]), ("d", 1, 2, ["1", "K1", "A"]), ("d", 2, 1, ["2", "K2", "B"])]
    df = spark.createDataFrame(cells, "doc string, page int, row_no int, cells array<string>")
    got = {(r.code, r.district) for r in readers.header_map(df, ["page", "row_no"], {"code": "code", "district": "district"}).collect()}
    assert got == {("K1", "A"), ("K2", "B")}


def test_key_values_take_the_first_hit(spark):
    lines = spark.createDataFrame([("d", 1, "Literacy rate 81.5"), ("d", 2, "Literacy rate 9"), ("d", 3, "Sex ratio 930")], "doc string, line_no int, line string")
    got = {r.label: r.value for r in readers.key_values(lines, {"literacy": "literacy", "sex": "sex ratio"}).collect()}
    assert got == {"literacy": 81.5, "sex": 930.0}


def test_company_classification(spark):
    rows = [("A", "ACTV", "21001 drugs", "x 641001"), ("B", "STRIKE OFF", "pharma", "641001"), ("C", "", "pharma", "none"), ("D", "ACTIVE", "steel", "641001")]
    df = spark.createDataFrame(rows, "company string, status string, activity string, address string")
    got = {r.company: r.reason for r in readers.classify_companies(df, ["21001"], ["pharma"], ["ACTV", "ACTIVE"]).collect()}
    assert got == {"A": None, "B": "not active", "C": "no postal code", "D": "not in the activity"}


def test_writers(spark, tmp_path):
    cells = spark.createDataFrame([(1, "a", 2.0, "OBSERVED"), (1, "b", None, "MISSING")], "id long, indicator string, value double, status string")
    w = writers.wide(cells, ["a", "b"])
    assert w.columns == ["id", "a", "a__status", "b", "b__status"]
    writers.write_table(writers.blank_missing(w), str(tmp_path / "w"), "csv", single=True)
    assert [*spark.read.option("header", True).csv(str(tmp_path / "w")).first()] == ["1", "2.0", "OBSERVED", None, "MISSING"]
    writers.write_table(cells, str(tmp_path / "p"), partition_by=["indicator"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.write_json_row(spark.range(1), str(tmp_path / "j"))
    assert json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "j")).collect())) == {"id": 0}
    with pytest.raises(ValueError):
        writers.write_json_row(spark.range(2), str(tmp_path / "k"))
    assert writers.first_rows(spark.range(9), ["id"], 2).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = events.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    pick = lambda df: {(r.start, r.event_type, r.n) for r in df.collect()}
    assert pick(spark.table("tumbling")) == pick(events.tumbling(e))


def test_stream_without_repeats(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:06:00")], "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    q = events.first_of_each(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), ["user_id"]).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2


def test_presence(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    got = {r.source: (r.n_files, r.status) for r in readers.presence(spark, {"a": str(tmp_path / "*.csv"), "b": str(tmp_path / "*.pdf")}).collect()}
    assert got == {"a": (1, "PRESENT"), "b": (0, "ABSENT")}
    assert readers.first_present(spark, [str(tmp_path / "*.pdf"), str(tmp_path / "*.csv")]).endswith("*.csv")
    assert readers.first_present(spark, [str(tmp_path / "*.pdf")]) is None
