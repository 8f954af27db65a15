"""Faulty CSV rows are set aside and counted in the pass that types the others."""

import datetime as dt
import os

import pytest
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from cohortlens.__main__ import main
from cohortlens.sources.csv_load import TooManyRejects, load_csv
from cohortlens.sources.events import REFERENCE_CSV_TYPES

TYPES = StructType([StructField("id", LongType()), StructField("rejected", IntegerType()), StructField("at", TimestampType()),
                    StructField("x", DoubleType()), StructField("it's", StringType())])


def write(folder, *texts):
    os.makedirs(folder)
    for i, t in enumerate(texts):
        with open(f"{folder}/{i}.csv", "w") as fh:
            fh.write(t)
    return folder


def load(spark, tmp, *texts, **kw):
    return load_csv(spark, write(f"{tmp}/src", *texts), TYPES, f"{tmp}/staged", "id", **{"max_reject_share": 1.0, **kw})


def test_types_and_faults(spark, tmpdir_path):
    text = ("x,id,rejected,at,it's,other\n"
            "1.5,1,2,2016-04-29T18:38:08Z,a,z\n"
            "1.5,2.98e13,,2016-04-29,\"b, c\",z\n"
            ",29872499824296.0,7,2016-04-29T23:30:00-03:00,,z\n"
            "abc,4,2.5,never,d,z\n"
            "1,five,1,2016-04-29,e,z\n"
            "1,,1,2016-04-29,f,z\n"
            "1,7\n"
            "1,8,1,2016-04-29,g,z,more\n")
    got = load(spark, tmpdir_path, text)
    assert (got.total_rows, got.rejected_rows) == (8, 5)
    assert got.rows.dtypes == [("id", "bigint"), ("rejected", "int"), ("at", "timestamp"), ("x", "double"), ("it's", "string")]
    rows = {r["id"]: (r["rejected"], r["at"].strftime("%F %T"), r["x"], r["it's"]) for r in got.rows.selectExpr("*").collect()}
    day = dt.datetime(2016, 4, 29)
    assert rows.keys() == {1, 29800000000000, 29872499824296} and rows[29800000000000] == (None, day.strftime("%F %T"), 1.5, "b, c")
    faults = sorted((r["row_key"] or "", r["column"], r["raw"] or "", r["reason"]) for r in got.rejects.collect())
    assert [f[1:] for f in faults if f[0] == "4"] == [("at", "never", "not a timestamp"), ("rejected", "2.5", "not a int"), ("x", "abc", "not a double")]
    assert ("five", "id", "five", "not a bigint") in faults and ("", "id", "", "missing") in faults
    assert {f[2] for f in faults if f[3] == "malformed line"} == {"1,7", "1,8,1,2016-04-29,g,z,more"}
    assert all(r["source_file"].endswith("0.csv") for r in got.rejects.collect())
    assert {(r["column"], r["reason"]): r["faults"] for r in got.report().collect()}["", "malformed line"] == 2


def test_limit(spark, tmpdir_path):
    text = "id,rejected,at,x,it's\n" + "".join(f"{i},{'abc' if i < 5 else 1},2016-04-29,1,a\n" for i in range(100))
    with pytest.raises(TooManyRejects, match="5 of 100 rows") as caught:
        load(spark, tmpdir_path, text, max_reject_share=0.04)
    assert caught.value.load.rejects.count() == 5
    os.makedirs(f"{tmpdir_path}/2")
    assert load(spark, f"{tmpdir_path}/2", text, max_reject_share=0.05).rejected_rows == 5


def test_several_files_and_none(spark, tmpdir_path):
    head = "id,rejected,at,x,it's\n"
    got = load(spark, tmpdir_path, head + "1,1,2016-04-29,1,a\n", head, head + "x,1,2016-04-29,1,a\n")
    assert (got.total_rows, got.rejected_rows, got.rows.count()) == (2, 1, 1)
    os.makedirs(f"{tmpdir_path}/2")
    empty = load(spark, f"{tmpdir_path}/2", head)
    assert (empty.total_rows, empty.rows.count(), empty.rejects.count()) == (0, 0, 0)
    os.makedirs(f"{tmpdir_path}/3")
    with pytest.raises(ValueError, match="lacks columns"):
        load(spark, f"{tmpdir_path}/3", "id,x\n1,2\n")


def test_bad_values_neither_end_a_run_nor_count(spark, tmpdir_path):
    """An age that is no number is no adult, and a bad id or day does not end the audit."""
    cols = [f.name for f in REFERENCE_CSV_TYPES.fields]
    good = ["29872499824296.0", "1", "F", "2016-04-29T18:38:08Z", "2016-05-10T00:00:00Z", "8", "X", "0", "0", "0", "0", "0", "0", "No"]

    def row(i, **kw):
        return ",".join(str(kw.get(c, i if c == "AppointmentID" else v)) for c, v in zip(cols, good))

    lines = [row(i) for i in range(10)] + [row(10, Age="abc"), row(11, PatientId="abc"), row(12, AppointmentDay="soon")]
    src = write(f"{tmpdir_path}/src", ",".join(cols) + "\n" + "\n".join(lines) + "\n")
    args = ["--events", src, "--format", "csv", "--out", f"{tmpdir_path}/out", "--audits", "age_class_outcome,integrity"]
    with pytest.raises(TooManyRejects):
        main(args, spark=spark)
    main([*args, "--max-rejects", "0.25"], spark=spark)
    out = spark.read.parquet(f"{tmpdir_path}/out/age_class_outcome").collect()
    assert [(r["advocacy_type"], r["total_patient_volume"]) for r in out] == [("Guardian-Advocate (Minor)", 10)]
    assert sorted(r["row_key"] for r in spark.read.parquet(f"{tmpdir_path}/out/rejects").collect()) == ["10", "11", "12"]
