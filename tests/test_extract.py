"""Back-fill rounds, scope by scope."""

import time
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tabloom.operators import extract as E
from tabloom.operators import records as R
from tabloom.operators import skew
from tabloom.operators import usage as G
from tabloom.schema import records_type
from tabloom.session import scratch_path

FIELDS = ["A", "B", "C"]


def test_one_scope_does_not_stop_another(spark):
    rows = [("a", 0, "f", None, "x", None, None), ("b", 0, "f", None, "y", None, None), ("c", 0, "f", None, "p", "q", "r"), ("a", 1, "f", "bad", None, None, None)]
    df = spark.createDataFrame(rows, records_type(FIELDS))
    matches = spark.createDataFrame([], "scope_id string, field string, matched boolean")
    texts = spark.createDataFrame([], "scope_id string, text string")
    seen = []

    def backfill(active):
        scopes = sorted({r["scope_id"] for r in active.collect()})
        seen.append(scopes)
        field = FIELDS[len(seen)] if len(seen) < 3 else "C"
        return active.filter("scope_id = 'a' and error is null").select(
            "scope_id", "row_ord", F.lit(field).alias("field"), F.lit("found").alias("value"), F.lit(0).alias("patch_ord")
        )

    out = E.post_process(df, FIELDS, matches, matches, texts, schedule=False, dominant=False, backfill=backfill)
    got = {(r["scope_id"], r["row_ord"]): (r["A"], r["B"], r["C"]) for r in out.collect()}
    assert seen == [["a", "b"], ["a"]]
    assert got == {("a", 0): ("x", "found", "found"), ("a", 1): (None,) * 3, ("b", 0): ("y", None, None), ("c", 0): ("p", "q", "r")}


def test_latency_ranks_of_repeated_values(spark):
    values = [5.0] * 70 + [7.5] * 25 + [9.0] * 4 + [100.0]
    rows = spark.createDataFrame([("e", v, 200, i) for i, v in enumerate(values)], "endpoint string, latency_ms double, status int, s int")
    out = G.request_latency_report(rows.withColumn("ts", F.timestamp_seconds("s"))).first()
    assert (out["p50_ms"], out["p95_ms"], out["p99_ms"], out["max_ms"]) == (5.0, 7.5, 9.0, 100.0)


def test_rows_of_long_grids_have_positions_of_their_own(spark):
    head = "| Name | City |\n| --- | --- |"
    grid = lambda n, name: head + "".join(f"\n| {name}{k} | Rome |" for k in range(n))
    tables = spark.createDataFrame(
        [("D1", 0, grid(100_005, "a")), ("D1", 1, grid(2, "b")), ("D1", 2, "no grid"), ("D2", 1, grid(100_000, "c")), ("D2", 2, grid(2, "d")),
         (None, 0, grid(100_005, "e")), (None, 1, grid(1, "f"))],
        "doc_id string, table_ord int, markdown string",
    )
    got = E.extract_from_tables(tables, ["name"]).select("scope_id", "row_ord", "name").toPandas().fillna({"scope_id": "null"})
    for scope, wanted in [("D1", [*(f"a{k}" for k in range(100_005)), "b0", "b1"]), ("null", [*(f"e{k}" for k in range(100_005)), "f0"])]:
        own = got[got.scope_id == scope].sort_values("row_ord")
        assert own.row_ord.is_unique and own.name.tolist() == wanted
    # the table's number is in the upper 32 bits, whatever the length of its grid
    own = got[got.scope_id == "D2"].sort_values("row_ord")
    assert own.row_ord.tolist() == [*range(1 << 32, (1 << 32) + 100_000), 2 << 32, (2 << 32) + 1]


def test_repair_chain_reads_its_records_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [("a", k, "f", None, f"id {k}", f"{k} Main Street", "x") for k in range(40)]
    kind = records_type(FIELDS)
    df = spark.createDataFrame(rows, kind).mapInPandas(counted, kind)
    matches = spark.createDataFrame([("a", f, True) for f in FIELDS], "scope_id string, field string, matched boolean")
    texts = spark.createDataFrame([("a", "x")], "scope_id string, text string")
    out = E.post_process(df, FIELDS, matches, matches, texts, schedule=True)
    assert out.count() == 40 and read.value == 40


FILED = ["Unit", "Address", "Kind", "Note"]


def filed(spark, rows):
    """Records of three scopes and none: repeated ids, exact copies, a copied column, a uniform one, gaps, errors."""
    data = []
    for k in range(rows):
        cells = (None if k % 7 == 0 else f"U-{k // 3}", None if k % 5 == 0 else f"{k // 3} Main  Street", "same", f"note {k % 11}" if k % 2 else None)
        data.append((None if k % 50 == 3 else f"s{k % 3}", k, "f", "bad" if k % 31 == 0 else None, *cells))
    data += [(scope, rows + i, *rest) for i, (scope, _, *rest) in enumerate(data[::20])]
    names = "scope_id string, row_ord bigint, source_file string, error string, "
    return spark.createDataFrame(data, names + ", ".join(f"{f} string" for f in FILED))


def test_repair_chain_leaves_little_on_disk(spark):
    def held(folder):
        return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())

    def shuffled():
        places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {p for place in places for p in Path(place).rglob("shuffle_*.data")}

    def backfill(active):
        return active.select("scope_id", "row_ord", F.lit("Note").alias("field"), F.lit("found").alias("value"), F.lit(0).alias("patch_ord"))

    matches = spark.createDataFrame([(f"s{i}", f, f != "Kind") for i in range(3) for f in FILED], "scope_id string, field string, matched boolean")
    texts = spark.createDataFrame([("s0", "other"), ("s1", "the same"), ("s2", "")], "scope_id string, text string")
    place = Path(urlparse(scratch_path(spark, "x")).path).parent
    before, files = held(place), shuffled()
    out = E.post_process(filed(spark, 6000), FILED, matches, matches, texts, schedule=True, backfill=backfill, rounds=1)
    left = held(place) - before
    alone = Path(urlparse(scratch_path(spark, "alone")).path)
    out.write.option("compression", "zstd").parquet(str(alone))
    # the rows that the round began with, those that it ended with, and small lists
    assert left < 3 * held(alone)
    # files go a moment after their query; those of two lists of two tasks, and what runs now, may be there
    until = time.time() + 20
    while len(shuffled() - files) > 20 and time.time() < until:
        time.sleep(0.2)
    assert len(shuffled() - files) <= 20


def test_entities_merge_whatever_hashes_and_sizes_say(spark, monkeypatch):
    def rows():
        return sorted(map(repr, R.finalise_records(filed(spark, 300), FILED).collect()))

    wanted = rows()
    assert 100 < len(wanted) < 300
    with monkeypatch.context() as m:
        # hashes that always agree: keys decide
        m.setattr(F, "xxhash64", lambda *columns: F.lit(7).cast("bigint"))
        assert rows() == wanted
    # lists too long to be sent
    monkeypatch.setattr(skew, "BESIDE_BYTES", -1)
    assert rows() == wanted
