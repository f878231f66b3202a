"""Record clean-up and merging, with shuffled input and brute force."""

import random
from xml.etree import ElementTree

from pyspark.sql import functions as F

from tabloom.functions import expr as X
from tabloom.functions import sql
from tabloom.operators import records as R
from tabloom.operators.quality import key_columns, quality_report
from tabloom.schema import records_type
from tabloom.sources import sinks


def frame(spark, fields, data, scope="s"):
    filled = [(scope, i, "f", None, *r) for i, r in enumerate(data)]
    random.Random(3).shuffle(filled)
    return spark.createDataFrame(filled, records_type(fields))


ANON = ["Column A", "Column B", "Column C", "Metric X"]


def test_split_rows_of_an_entity_merge(spark):
    data = [
        ("1", "12 Main Street", None, "$1,000"), ("1", "12 Main Street", "Brick", None),
        ("2", "99 Long Road", "Frame", "$2,000"), (None, None, None, None),
    ]
    df = frame(spark, ANON, data)
    keys = key_columns(df, ANON).first()
    assert (keys["id_field"], keys["address_field"]) == ("Column A", "Column B")
    out = R.finalise_records(df, ANON).orderBy("row_ord").collect()
    assert [(r["Column A"], r["Column C"], r["Metric X"]) for r in out] == [("1", "Brick", "$1,000"), ("2", "Frame", "$2,000")]


def test_finalise_twice_changes_nothing_more(spark):
    data = [(str(i // 2), f"{i // 2} Elm Street", "x" if i % 2 else None, None) for i in range(12)]
    once = R.finalise_records(frame(spark, ANON, data), ANON)
    again = R.finalise_records(once, ANON)
    assert sorted(tuple(r) for r in once.select(*ANON).collect()) == sorted(tuple(r) for r in again.select(*ANON).collect())


def test_distinct_serials_keep_rows_apart(spark):
    fields = ["Unit #", "Garage", "Serial"]
    data = [("A1", "1 Dock Street", f"SN number {i}") for i in range(3)]
    out = R.merge_by_identifier(frame(spark, fields, data), fields)
    assert out.count() == 3


def test_scope_without_keys_is_returned_unchanged(spark):
    fields = ["Remark"]
    data = [("some words of text",)] * 4
    assert R.finalise_records(frame(spark, fields, data), fields).count() == 4


def test_dominant_value_fills_gaps(spark):
    df = frame(spark, ["Vendor"], [("Acme",), ("Acme",), (None,), ("n/a",), ("Other",)])
    assert sorted(r["Vendor"] for r in R.propagate_dominant(df, ["Vendor"]).collect()) == ["Acme"] * 4 + ["Other"]


def test_quality_report_of_an_empty_scope(spark):
    df = frame(spark, ["Amount", "Date"], [("$5", "1/2/2020"), ("x", "")])
    scopes = spark.createDataFrame([("s",), ("empty",)], "scope_id string")
    out = {r["scope_id"]: r for r in quality_report(df, ["Amount", "Date"], scopes).collect()}
    assert (out["s"]["field_fill_rate"], out["s"]["numeric_parse_rate"], out["s"]["date_parse_rate"]) == (0.75, 0.5, 1.0)
    assert (out["empty"]["row_count"], out["empty"]["field_fill_rate"], out["empty"]["numeric_parse_rate"]) == (0, 0.0, 1.0)


def test_values(spark):
    cases = [("$1,000 million", "$1,000", "0.00", True), ("(12.5)", "(12.5)", "-12.50", True), ("5 million", "5 million", "0.00", True),
             ("1_000", "1_000", "1000.00", True), ("5d", "5d", "0.00", False), ("inf%", "inf%", "0.00", True)]
    df = spark.createDataFrame([(c[0],) for c in cases], "v string")
    got = df.select("v", X.clean_money("v"), X.clean_amount("v"), X.parses_as_number("v")).collect()
    assert [tuple(r) for r in got] == cases


def test_dates(spark):
    cases = [("3/4/2021", "2021-03-04"), ("25/12/2020", "2020-12-25"), ("1-2-75", "1975-01-02"), ("1-2-68", "2068-01-02"), ("March 5, 2020", "2020-03-05"),
             ("5 Sep 2020", "2020-09-05"), ("20200131", "2020-01-31"), ("12312020", "2020-12-31"), ("2/30/2020", None), ("soon", None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "v string")
    assert [(r[0], None if r[1] is None else str(r[1])) for r in df.select("v", X.parse_date("v")).collect()] == cases


def test_dates_in_sql_are_those_of_columns(spark):
    sql.register(spark)
    values = ["3/4/2021", "25/12/2020", "1-2-75", "1-2-68", "March 5, 2020", "5 Sep 2020", "5-sept-2020", "20200131", "12312020", "2/30/2020", "soon",
              None, "", " 3/4/2021\t", "\u00a0March\u2003 5 2020", "2021/3/4", "13/13/2020", "MAY 1, 1999", "a 20200131 b", "31/4/21"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", X.parse_date("v").alias("a"), F.expr("parse_date(v)").alias("b"))
    rows = df.collect()
    assert [r.b for r in rows] == [r.a for r in rows] and sum(r.b is not None for r in rows) >= 12


def test_accounting_csv_is_written(spark, tmp_path):
    df = frame(spark, ["Date", "Description", "Amount"], [("3/4/2021", 'Fee, "monthly"', "(12.5)"), ("soon", "x", "1"), ("2021-03-05", "", "2"), ("20200131", "Rent", "$1,000")])
    sinks.write_accounting_csv(df, str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), header=True, escape='"').select("scope_id", "Date", "Description", "Amount").collect()
    assert sorted(map(tuple, got)) == [("s", "01/31/2020", "Rent", "1000.00"), ("s", "03/04/2021", 'Fee  "monthly"', "-12.50")]


def test_names_and_tags(spark):
    df = spark.createDataFrame([("Docs <d+team-K1@x.org>, e+z_9@x.org", "Élodie Durand")], "t string, n string")
    row = df.select(X.tag_candidates("t").alias("t"), X.slug_name("n").alias("n"), X.humanise(F.lit("Page2[0].Loss[0].yearBuilt_A1[0]")).alias("h")).first()
    assert row["t"] == ["team-k1", "team", "k1", "z_9", "z", "9"]
    assert (row["n"], row["h"]) == ("elodie", "Year Built")


def test_statement_of_merged_rows(spark):
    rows = [("a", [0, 2], None, "2024-01-02", "x", "5"), ("a", [70000, 1], None, "2024-01-03", "y", "-1"), ("a", [0, 1], None, "2024-01-01", "z", "(2)")]
    df = spark.createDataFrame(rows, "scope_id string, row_ord array<bigint>, error string, Date string, Description string, Amount string")
    assert [r["name"] for r in sinks.statement_entries(df).orderBy("number").collect()] == ["z", "x", "y"]


def test_sitemap_is_framed(spark, tmp_path):
    df = spark.createDataFrame([("b", "published"), ("a", "published"), ("c", "draft")], "slug string, indexationStatus string")
    sinks.write_sitemap(df.selectExpr("*", "'2024-01-02' AS updatedAt", "'' AS publishedAt"), str(tmp_path / "map"), "https://x.org", "2024-02-03")
    text = "".join(p.read_text() for p in sorted((tmp_path / "map").glob("part-*")))
    root = ElementTree.fromstring(text.encode())
    assert [url[0].text for url in root] == [f"https://x.org/resources{end}" for end in ("", "/a", "/b")]


def test_scope_without_shared_keys_keeps_its_order(spark):
    fields = ["Unit #", "Street Address"]
    data = [(None, None), ("A1", "1 Dock Street"), (None, "x"), ("B2", "2 Dock Street")]
    plain, keys = frame(spark, fields, data), None
    keys = spark.createDataFrame([("s", "Unit #", "Street Address", [])], "scope_id string, id_field string, address_field string, distinguishers array<string>")
    order = [r["Unit #"] for r in R.merge_by_identifier(plain, fields, keys).orderBy("row_ord").collect()]
    assert order == [None, "A1", None, "B2"]
    twice = frame(spark, fields, [*data, ("A1", "1 Dock Street")])
    order = [r["Unit #"] for r in R.merge_by_identifier(twice, fields, keys).orderBy("row_ord").collect()]
    assert order[-1] is None and set(order[:-1]) == {None, "A1", "B2"}


def test_statement_of_many_merged_rows_of_one_scope(spark):
    n = 120_000
    rows = spark.range(0, n, 1, 8).select(
        F.lit("a").alias("scope_id"), F.array(F.lit(0).cast("bigint"), (F.col("id") * 7919) % n).alias("row_ord"), F.lit(None).cast("string").alias("error"),
        F.lit("2024-01-02").alias("Date"), F.lit("x").alias("Description"), F.lit("5").alias("Amount"),
    )
    got = sinks.statement_entries(rows).select("row_ord", "number")
    assert got.filter(F.col("row_ord")[1] + 1 != F.col("number")).count() == 0 and got.count() == n


def test_slugs_fold_by_decomposition(spark):
    import unicodedata

    names = [
        "Élodie Durand", "Łukasz Ż", "Ｗｉｄｅ name", "ﬁnn", "𝐉𝐨𝐡𝐧 Doe", "Nguyễn", "Ǆon", "Ⅷ", "½half", "Ωmega", "日本", "İzmir", "ß", "Åse-Lill", "ñ", "①②", "", None, "Ǩate", "ﷺ",
    ]
    got = [r.s for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", X.slug_name("n").alias("s")).orderBy("k").collect()]

    def plain(name):
        first = (name or "").split()[:1]
        told = unicodedata.normalize("NFKD", first[0]).encode("ascii", "ignore").decode().lower() if first else ""
        return "".join(ch for ch in told if ch.isalnum())[:12] or "user"

    assert got == [plain(n) for n in names]
