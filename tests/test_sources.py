import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions.columns import level_text, require_rows
from tablescope.functions.tables import small_table
from tablescope.sources.catalog import (
    default_query,
    list_tables,
    preview,
    register,
    run_query,
    shape,
    write_table,
)
from tablescope.sources.csv_files import detect_separator, location_label, read_csv, write_csv
from tablescope.sources.demo import GAPPY, READINGS, demo_table, planted_rows


def put(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_separator_is_detected(spark, tmp_path, separator):
    rows = [["a", "b", "c"], ["1", "x", "2.5"], ["2", "y", "3.5"]]
    df = read_csv(spark, put(tmp_path, "\n".join(separator.join(r) for r in rows) + "\n"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "x", 2.5), (2, "y", 3.5)]


def test_separator_rules():
    assert detect_separator(['"a;b",c', '"d;e",f']) == ","
    assert detect_separator(["x;y", "1,5;2,5", "1,7;3,1"]) == ";"
    assert detect_separator(["single", "1"]) == ","
    assert detect_separator(["a;b;c", "1;2", ""]) == ";"
    assert detect_separator([]) == ","


def test_types_and_missing_texts(spark, tmp_path):
    text = (
        "whole,gaps,real,flag,text,nothing,odd,inf\n"
        "1,5,1e3,True,R,,1d,inf\n"
        "-2,NA,.5,False,NaN,NaN,2,-1.0\n"
        "3,7,n/a,True,2024-01-01,,3,2\n"
    )
    df = read_csv(spark, put(tmp_path, text))
    assert dict(df.dtypes) == {
        "whole": "bigint", "gaps": "bigint", "real": "double", "flag": "boolean", "text": "string",
        "nothing": "double", "odd": "string", "inf": "double",
    }
    rows = df.orderBy("whole").collect()
    assert [r["gaps"] for r in rows] == [None, 5, 7]
    assert [r["real"] for r in rows] == [0.5, 1000.0, None]
    assert [r["text"] for r in rows] == [None, "R", "2024-01-01"]
    assert rows[1]["inf"] == float("inf")


def test_given_schema_needs_no_type_scan(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a,b\n1,2\n3,\n"), schema="x double, y string")
    assert df.dtypes == [("x", "double"), ("y", "string")]
    assert [tuple(r) for r in df.collect()] == [(1.0, "2"), (3.0, None)]


def test_long_integers_fall_back_to_double(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a,b\n1,99999999999999999999\n2,5\n"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double"}


def test_empty_file_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        read_csv(spark, put(tmp_path, ""))


def test_write_then_read(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', 0.5), (2, None, None)], "k bigint, s string, x double")
    write_csv(df, str(tmp_path / "out"), separator=";")
    back = read_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [(1, 'say "hi", you', 0.5), (2, None, None)]


def test_label():
    assert location_label("s3a://bucket/folder/iris.csv") == "iris.csv"
    assert location_label("hdfs:///data/table/") == "table"


def test_register_query_and_defaults(spark, tmp_path):
    write_table(spark.range(7).select("id", (F.col("id") % 2).alias("odd")), str(tmp_path / "numbers"))
    write_table(spark.range(9).select("id", (F.col("id") % 2).alias("odd")), str(tmp_path / "numbers"))
    register(spark, "numbers", str(tmp_path / "numbers"))
    assert "numbers" in list_tables(spark)
    found = run_query(spark, "SELECT odd, count(*) AS n FROM numbers GROUP BY odd")
    assert sorted(map(tuple, found.collect())) == [(0, 5), (1, 4)]
    assert default_query(["numbers", "others"]) == "SELECT * FROM numbers LIMIT 1000"
    assert run_query(spark, default_query(["numbers"])).count() == 9
    with pytest.raises(ValueError, match="no table"):
        default_query([])
    assert shape(spark.table("numbers")) == (9, 2)


def test_preview(spark):
    df = spark.range(80).select("id", F.when(F.col("id") > 0, F.lit("s")).alias("s"), F.lit(float("nan")).alias("x"))
    rows = preview(df.coalesce(1)).collect()
    assert len(rows) == 50
    assert tuple(rows[0]) == ("0", "—", "—")


def test_empty_tables_are_refused(spark):
    with pytest.raises(ValueError):
        require_rows(spark.range(0))
    with pytest.raises(ValueError):
        require_rows(spark.range(3).select())
    assert require_rows(spark.range(1)).count() == 1


def test_level_texts(spark):
    df = spark.sql(
        """SELECT * FROM VALUES (1.0D, 1, true, 'x', DATE'2024-01-02'), (12345678.0D, 2, false, '', null),
           (2.5D, null, null, null, null), (double('NaN'), 3, true, 'y', null), (1e18D, 4, true, 'z', null)
           AS t(d, i, b, s, day)"""
    )
    rows = [tuple(r) for r in df.select(*[level_text(df, c).alias(c) for c in df.columns]).collect()]
    assert rows == [
        ("1.0", "1", "True", "x", "2024-01-02"),
        ("12345678.0", "2", "False", "", "nan"),
        ("2.5", "nan", "nan", "nan", "nan"),
        ("nan", "3", "True", "y", "nan"),
        ("1.0E18", "4", "True", "z", "nan"),
    ]


def test_small_tables(spark):
    df = small_table(spark, [(1, None, ["a"]), (2, 0.5, [])], "k int, x double, names array<string>")
    assert [tuple(r) for r in df.collect()] == [(1, None, ["a"]), (2, 0.5, [])]
    assert small_table(spark, [], "k int, x double").count() == 0
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_demo_table(spark):
    pdf = demo_table(spark, 2000, partitions=2).toPandas().set_index("row_id").sort_index()
    assert pdf.shape == (2000, 8) and list(pdf) == list(READINGS)
    for name, row in planted_rows(2000).items():
        centre, spread, *_ = READINGS[name]
        assert abs(pdf.loc[row, name] - centre) > 7 * spread
    gaps = pdf.isna().mean()
    assert gaps[list(GAPPY)].between(0.02, 0.06).all() and gaps.drop(list(GAPPY)).eq(0).all()
    related = pdf.drop(index=list(planted_rows(2000).values())).corr()
    assert related.loc["throughput", "power_kw"] > 0.7 and related.loc["vibration", "noise_db"] > 0.7
    assert abs(related.loc["pressure_bar", "stops"]) < 0.1 and abs(related["ambient_c"].drop("ambient_c")).max() < 0.1


def test_demo_table_survives_csv(spark, tmp_path):
    df = demo_table(spark, 240, partitions=1).drop("row_id")
    write_csv(df, str(tmp_path / "demo"))
    back = read_csv(spark, str(tmp_path / "demo"))
    assert shape(back) == (240, 8)
    pd.testing.assert_series_equal(back.toPandas().isna().sum(), df.toPandas().isna().sum())


def test_a_surplus_field_fails_the_read(spark, tmp_path):
    table = read_csv(spark, put(tmp_path, "a,b\n1,2\n3,4,5\n"), schema="a bigint, b bigint")
    for columns in (["a", "b"], ["a"]):
        with pytest.raises(Exception, match="more than 2 fields, such as 5"):
            table.select(*columns).collect()
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, put(tmp_path, "a,b\n1,2\n3,4,5\n", "u.csv"))


def test_short_rows_have_nulls(spark, tmp_path):
    table = read_csv(spark, put(tmp_path, "a,b,c\n1,2,3\n4\n5,6\n"))
    assert [tuple(r) for r in table.orderBy("a").collect()] == [(1, 2, 3), (4, None, None), (5, 6, None)]


def test_a_schema_names_every_column(spark, tmp_path):
    path = put(tmp_path, "a,b,c\n1,2,x\n")
    with pytest.raises(ValueError, match="names 2 columns"):
        read_csv(spark, path, schema="a bigint, b bigint")
    assert read_csv(spark, path, schema="c string, a bigint, b double").first().asDict() == {"c": "x", "a": 1, "b": 2.0}


def test_more_lines_decide_the_separator(spark, tmp_path):
    path = put(tmp_path, "x;y\n1,5;2\n" + "3;4\n" * 3)
    assert read_csv(spark, path, sniff_lines=1).columns == ["x", "y"]


def test_a_read_parses_only_the_columns_it_asks_for(spark, tmp_path):
    table = read_csv(spark, put(tmp_path, "a,b,c\n1,2,x\n3,4,y\n5\n"))
    plan = table.select("b")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:string>" in plan and "Filter (" not in plan
    assert [r["b"] for r in table.orderBy("a").select("b").collect()] == [2, 4, None]
    assert table.count() == 3


def test_types_of_many_parts_combine(spark, tmp_path):
    """Each file alone would give another type."""
    folder = tmp_path / "parts"
    folder.mkdir()
    for i, row in enumerate(["1,1,True,7", "2,2.5,5,NA", "NA,null,False,-8", "+4,1e400,True, 9 "]):
        put(folder, f"whole,real,mixed,spaced\n{row}\n", f"{i}.csv")
    table = read_csv(spark, str(folder))
    assert dict(table.dtypes) == {"whole": "bigint", "real": "double", "mixed": "string", "spaced": "bigint"}
    assert sorted(r["whole"] for r in table.where("whole IS NOT NULL").collect()) == [1, 2, 4]
