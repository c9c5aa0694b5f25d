"""Rejects of faulty CSV, and files in order."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from offerloom.operators.combine import TARGET
from offerloom.plans import modelling
from offerloom.sources import ordered_files, rejects

SCHEMA = StructType(
    [StructField("id", IntegerType(), False), StructField("name", StringType()), StructField("day", DateType())]
)


def test_faulty_rows_go_to_the_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,day\n1,one,01/02/20\n2,"two, too",31/02/20\nx,three,2020-02-01\n4,,\n')
    (tmp_path / "b.csv").write_text("id,name,day\n5,five\n,six,03/02/20\n7,seven,1/2/20\n8,eight,04/02/20,more\n9999999999,nine,\n")
    checked = rejects.read_checked(spark, str(tmp_path), SCHEMA, {"day": "dd/MM/yy"})
    assert sorted((r.id, r.name, r.day) for r in checked.rows.collect()) == [
        (1, "one", datetime.date(2020, 2, 1)),
        (4, None, None),
    ]
    found = sorted((r.file, r.column_name, r.reason, r.value or "") for r in checked.rejects.collect())
    assert found == [
        ("a.csv", "day", "not of type date", "2020-02-01"),
        ("a.csv", "day", "not of type date", "31/02/20"),
        ("a.csv", "id", "not of type int", "x"),
        ("b.csv", "(row)", "number of values", "5,five"),
        ("b.csv", "(row)", "number of values", "8,eight,04/02/20,more"),
        ("b.csv", "day", "not of type date", "1/2/20"),
        ("b.csv", "id", "missing", ""),
        ("b.csv", "id", "not of type int", "9999999999"),
    ]
    texts = {r.row_text for r in checked.rejects.where("column_name = 'id'").collect()}
    assert "x,three,2020-02-01" in texts
    counts = {(r.file, r.column_name): r.n for r in rejects.reject_counts(checked.rejects).collect()}
    assert counts["a.csv", "day"] == 2 and counts["b.csv", "(row)"] == 2
    rejects.read_checked(spark, str(tmp_path), SCHEMA, {"day": "dd/MM/yy"}, most_rejects=8)
    with pytest.raises(rejects.TooManyRejects, match="8 values"):
        rejects.read_checked(spark, str(tmp_path), SCHEMA, {"day": "dd/MM/yy"}, most_rejects=7)


def concatenated(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*"))).splitlines()


@pytest.fixture
def many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_files_in_order_make_one_table(spark, tmp_path, many_files):
    df = spark.range(3000).select("id", F.xxhash64("id").alias("k"), F.concat(F.lit('a "b", '), "id").alias("name")).repartition(7)
    path = tmp_path / "out"
    ordered_files.write_ordered(df, str(path), ["k"], drop=["k"])
    lines = concatenated(path)
    want = [r.id for r in df.orderBy("k").collect()]
    assert lines[0] == "id,name" and [int(x.split(",")[0]) for x in lines[1:]] == want
    assert len(list(path.glob("part-*"))) > 1 and not list(tmp_path.glob("*.writing-*"))
    schema = StructType([StructField("id", IntegerType()), StructField("name", StringType())])
    back = ordered_files.read_ordered(spark, str(path), schema).orderBy(*ordered_files.LINE).collect()
    assert [r.id for r in back] == want and back[5].name == f'a "b", {want[5]}'
    ordered_files.write_ordered(df.limit(0), str(path), ["k"], drop=["k"])  # over the old files
    assert concatenated(path) == ["id,name"]


def test_submission_keeps_the_order_of_the_template(spark, tmp_path):
    ids = [5, 3, 9, 1, 7, 2]
    for i, part in enumerate((ids[:4], ids[4:])):
        (tmp_path / f"template-{i}.csv").write_text("".join(f"{x}\n" for x in part))
    template = ordered_files.with_line(spark.read.schema("id int").csv(str(tmp_path / "template-*.csv")))
    scores = spark.createDataFrame([(i, i / 10) for i in ids if i != 9], "id int, s double").repartition(3)
    path = tmp_path / "sent"
    modelling.write_ordered_submission(template, scores, "s", str(path), ordered_files.LINE)
    assert concatenated(path) == [f"id,{TARGET}", "5,0.5", "3,0.3", "9,", "1,0.1", "7,0.7", "2,0.2"]
