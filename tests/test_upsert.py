"""Upsert scenarios: ids, addresses, ambiguity, errors."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators.upsert import match_columns, upsert_baseline


def rows(spark, names, data, error=False):
    full = ["scope_id", "row_ord", "source_file", *(["error"] if error else []), *names]
    schema = ", ".join(f"`{c}` {'bigint' if c == 'row_ord' else 'string'}" for c in full)
    filled = [("s", i, f"f{i}", *([None] if error else []), *r) for i, r in enumerate(data)]
    return spark.createDataFrame(filled, schema)


def run(spark, fields, old, new, overwrite, headers=None):
    out = upsert_baseline(rows(spark, headers or fields, old), rows(spark, fields, new, error=True), fields, overwrite)
    return [r.asDict() for r in out.orderBy("part_ord", "row_ord").collect()]


LOC = ["Location Number", "Street Address", "City", "State", "Zip", "Building Values"]


def test_overwrite_by_id_keeps_extra_columns(spark):
    old = [("1", "1 A St", "Rome", "NY", "1", "100", "keep"), ("2", "2 B St", "Rome", "NY", "2", "200", "note")]
    new = [("1", "1 A Street", "Rome", "NY", "1", None), ("3", "3 C St", "Rome", "NY", "3", "300")]
    out = run(spark, LOC, old, new, True, LOC + ["Owner Note"])
    assert [r["record_status"] for r in out] == ["updated", "not_found", "new"]
    # a blank overwrites a filled value, columns that were not extracted stay
    assert out[0]["Building Values"] == "" and out[0]["Owner Note"] == "keep"
    assert out[2]["Owner Note"] == ""


def test_address_key_without_overwrite(spark):
    fields = LOC[1:]
    old = [("1 A St.", "Rome", "NY", "", "100"), ("2 B St", "Rome", "", "", "200")]
    new = [("1 a ST", "ROME", "ny", None, "999"), ("2 B St", "Rome", "", "", "5")]
    out = run(spark, fields, old, new, False)
    assert [r["record_status"] for r in out] == ["matched_preserved", None, "new"]
    assert out[0]["Building Values"] == "100"


def test_repeated_baseline_id_never_matches(spark):
    fields = ["Location Number", "TIV"]
    out = run(spark, fields, [("1", "a"), ("1", "b")], [("1", "c")], True)
    assert [r["record_status"] for r in out] == [None, None, "new"]


def test_second_new_row_of_a_key_is_appended(spark):
    fields = ["Vehicle #", "Make"]
    out = run(spark, fields, [("7", "x")], [("7", "first"), ("7", "second")], True)
    assert [(r["record_status"], r["Make"]) for r in out] == [("updated", "first"), ("new", "second")]


def test_only_errors_leave_the_baseline_alone(spark):
    fields = ["Vehicle #", "Make"]
    new = rows(spark, fields, [("7", "y")], error=True).withColumn("error", F.lit("failed"))
    out = upsert_baseline(rows(spark, fields, [("7", "x")]), new, fields, True).collect()
    assert [(r["record_status"], r["Make"]) for r in out] == [(None, "x")]


def test_phone_is_no_id(spark):
    out = run(spark, ["Name", "Phone #", "City", "State", "Zip"], [("A", "1", "Rome", "NY", "1")], [("B", "1", "Rome", "NY", "1")], True)
    assert [r["record_status"] for r in out] == [None, "new"]


@pytest.mark.parametrize("name,is_id", [
    ("Invoice #", True), ("Employee No.", True), ("Policy ID", True), ("# of Units", False), ("Number of Floors", False),
    ("VIN", True), ("Fax Number", False), ("Location", True), ("Amount", False),
])
def test_id_names(name, is_id):
    assert (match_columns([name], [name]).ident == name) is is_id


def test_upsert_with_itself_adds_nothing(spark):
    fields = ["Vehicle #", "Make"]
    data = [(str(i), "m") for i in range(20)]
    assert {r["record_status"] for r in run(spark, fields, data, data, True)} == {"updated"}
