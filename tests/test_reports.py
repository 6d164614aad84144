"""Reports, robustness runs and storage against SQL and on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from logsift.operators import degrade
from logsift.plans.reports import QUERIES, SQL
from logsift.sources import store

from .conftest import SMALL

SHOWN = ["rp6_reports", "rp7_combined", "d1_incidents", "d3_quality_figures", "n15_case_list", "n16_case_details", "l2_evidence", "l2_evidence_parts", "s1_kept_events", "s3_jittered", "s4_order_kept", "s5_chain_order", "s10_surviving", "s12_removal_scores", "d1_severity_counts", "d6_run_summary", "io9_appended", "s12_run_scores", "s11_accuracy_by_run", "s9_degraded_results", "io7_by_case", "io10_replaced", "io12_stored", "io12_all_artefacts"]


@pytest.mark.parametrize("name", SHOWN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    got, want = QUERIES[name](spark, SMALL), con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect())))
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_degraded_results_at_level_0_equal_the_plain_ones(spark):
    runs = {r.case_id: r for r in QUERIES["s9_degraded_results"](spark, SMALL).collect()}
    plain = {r.case_id: r for r in QUERIES["d6_run_counts"](spark, SMALL).collect()}
    assert len(runs) == 13 * len(plain)
    assert all(runs[f"{c}#0#1"].alert_count == r.alerts for c, r in plain.items())
    assert all(r.alert_count <= 1.5 * plain[k.split("#")[0]].alerts for k, r in runs.items())


def test_chain_order(spark):
    an = spark.createDataFrame([("a", [(1,), (1,), (3,)]), ("b", [(2,), (1,)]), ("c", None)], "case_id string, attack_chain array<struct<step: int>>")
    an = an.withColumn("attack_chain", F.transform("attack_chain", lambda s: F.struct(s["step"].alias("step"), F.lit("e").alias("event_id"), F.lit("d").alias("description"))))
    assert {r.case_id: r.chain_in_order for r in degrade.chain_in_order(an).collect()} == {"a": True, "b": False, "c": True}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "e1", 1), ("c1", "e1", 2), ("c2", "e2", 3), ("c2", None, 4)], "case_id string, event_id string, v long")
    first = store.append_new(rows.where("event_id = 'e1'"), f"{tmp_path}/t", f"{tmp_path}/s1")
    assert first.count() == 1
    assert {r.case_id: (r.in_file, r.inserted) for r in store.load_events(rows, f"{tmp_path}/t", f"{tmp_path}/s2").collect()} == {"c1": (2, 0), "c2": (2, 2)}
    again = store.load_events(rows, f"{tmp_path}/t", f"{tmp_path}/s2")  # all are stored now, the one without a key too
    assert {r.case_id: r.inserted for r in again.collect()} == {"c1": 0, "c2": 0} and spark.read.parquet(f"{tmp_path}/t").count() == 3
    keyed = rows.groupBy("case_id").agg(F.max("v").alias("v"))
    assert store.latest(spark, f"{tmp_path}/k", keyed).count() == 0
    store.replace_keyed(keyed, f"{tmp_path}/k")
    (tmp_path / "k" / "data" / "0").mkdir()  # a write that failed
    new = store.replace_keyed(keyed.where("case_id = 'c2'").withColumn("v", F.lit(9).cast("long")), f"{tmp_path}/k")
    assert [tuple(r) for r in store.of_case(new).collect()] == [("c1", 2), ("c2", 9)]
    assert store.read_case(spark, str(tmp_path / "t"), "event_id string, v long", "c9").count() == 0


def test_answers_are_read_from_files(spark, tmp_path):
    import json

    from logsift.sources.raw import read_answers

    (tmp_path / "scenario_7_llm_response.json").write_text(json.dumps({"verdict": "YES", "suspect": None, "attack_chain": [{"step": 1, "event_id": "e1", "description": "a \"b\" {c}"}], "evidence_for": ["e1"], "narrative": "x", "other": 3}, indent=1))
    (tmp_path / "scenario_12_llm_response.json").write_text("{}")
    got = {r.case_id: r for r in read_answers(spark, str(tmp_path)).collect()}
    assert got["7"].verdict == "YES" and got["7"].attack_chain[0]["description"] == 'a "b" {c}' and got["7"].evidence_for == ["e1"]
    assert set(got) == {"7", "12"} and got["12"].verdict is None and got["12"].attack_chain is None


def test_counts_of_nothing(spark):
    from logsift.operators import reports

    none = spark.createDataFrame([], "case_id string, severity string, alert_count long")
    assert tuple(reports.severity_counts(none).collect()[0]) == (0, 0, 0, 0)


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/k"
    rows = spark.createDataFrame([(f"c{i}", i) for i in range(200)] + [(None, -1)], "case_id string, v long")
    store.replace_keyed(rows, path, buckets=16)
    before = store._manifest(spark, path)[1]["folders"]
    new = spark.createDataFrame([("c7", 700), ("c7", 701), (None, -2)], rows.schema)
    got = store.replace_keyed(new, path, buckets=4)  # the table has its number of buckets
    number, after = store._manifest(spark, path)
    assert number == 2 and after["buckets"] == 16 and 1 <= sum(before[k] != after["folders"][k] for k in before) <= 2
    want = [(r.case_id, r.v) for r in rows.collect() if r.case_id not in ("c7", None)] + [("c7", 700), ("c7", 701), (None, -2)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    store.vacuum(spark, path)
    assert sorted(map(repr, map(tuple, store.latest(spark, path, rows).collect()))) == sorted(map(repr, want)) and len(list((tmp_path / "k" / "manifest").glob("*.json"))) == 1


def test_two_writers_of_a_keyed_table_lose_nothing(spark, tmp_path, monkeypatch):
    path, commit, row = f"{tmp_path}/k", store._commit, lambda c, v: spark.createDataFrame([(c, v)], "case_id string, v long")
    store.replace_keyed(row("a", 1), path, buckets=2)

    def late(*args):
        monkeypatch.setattr(store, "_commit", commit)  # another writer comes between
        store.replace_keyed(row("b", 2), path)
        store.replace_keyed(row("a", 3), path)
        return commit(*args)

    monkeypatch.setattr(store, "_commit", late)
    got = store.replace_keyed(row("c", 4), path)
    assert {tuple(r) for r in got.collect()} == {("a", 3), ("b", 2), ("c", 4)} and store._manifest(spark, path)[0] == 4


def test_a_large_case_is_several_files(spark, tmp_path):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 70)).otherwise("hot").alias("case_id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        store.write_by_case(rows, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "t").glob("case_id=*")}
    assert files["case_id=hot"] > 2 and min(files.values()) == 1  # small cases dealt to the hot one's partition are cut with it
    assert spark.read.parquet(f"{tmp_path}/t").count() == 40_000


def test_evidence_put_together_equals_the_whole(spark):
    from logsift.operators import reports
    from logsift.plans import queries
    from logsift.sources.driver import baselines, events

    ev, bl = events(spark, SMALL), baselines(spark, SMALL)
    found = queries.alerts(spark, SMALL).where("rule_id in ('R003', 'R006')")
    parts, whole = store.written(reports.evidence_parts(ev, bl, found, 7)), reports.evidence(ev, bl, found)
    for row in whole.limit(3).collect():
        assert [tuple(r) for r in reports.evidence_of(parts, row.case_id).collect()] == [tuple(row)]
    assert reports.evidence_of(parts, "none").count() == 0 and parts.agg(F.max("n")).first()[0] == 7


def test_one_case_is_read_from_its_folder_alone(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("x y", 3)], "case_id string, n long")
    store.write_by_case(rows, f"{tmp_path}/cases")
    found = store.read_case(spark, f"{tmp_path}/cases", "n long", "b")
    assert found.inputFiles() and all("case_id=b" in f for f in found.inputFiles()) and [tuple(r) for r in found.collect()] == [(2, "b")]
    assert [r.n for r in store.read_case(spark, f"{tmp_path}/cases", "n long", "x y").collect()] == [3]
    assert store.read_case(spark, f"{tmp_path}/cases", "n long", "none").count() == 0


def test_details_run_the_rules_once(spark, monkeypatch):
    from logsift.plans import cases
    from logsift.plans import reports as plans

    def again(*_):
        raise AssertionError("the alerts are there already")

    monkeypatch.setattr(cases, "intervals", again)
    assert plans.details(spark, SMALL).count() == 3
