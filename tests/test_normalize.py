"""Raw files to unified events, and the normalisers' queries against SQL."""

import json

import duckdb
import pytest

from logsift.operators import normalize
from logsift.plans.logs import QUERIES, SQL
from logsift.sources import raw

from .conftest import SMALL

T = "2026-04-01T02:47:00+06:00"


def put(folder, name, rows):
    (folder / name).write_text(json.dumps(rows))


def test_files_to_events(spark, tmp_path):
    put(tmp_path, "scenario_7_auth_logs.json", [
        {"timestamp": T, "event_type": "login", "username": "u", "ip_address": "1.1.1.1", "result": "Failure", "session": "s"},
        {"event_type": "logout", "username": None},
    ])
    put(tmp_path, "scenario_7_web_logs.json", [
        {"timestamp": T, "method": "GET", "url": "/", "status_code": 403, "duration_ms": 0}, {"timestamp": T, "url": "/x"},
        {"timestamp": T, "url": "/y", "status_code": "odd"}, {"timestamp": T, "url": "/z", "status_code": "500"},
    ])
    put(tmp_path, "scenario_7_network_logs.json", {"timestamp": T, "event_type": "dns_query", "dst_ip": "d", "action": "blocked", "src_port": 0, "bytes_transferred": 5})
    put(tmp_path, "scenario_8_email_logs.json", [{"timestamp": T, "event_type": "mail_sent", "sender": "u", "recipients": ["a", "b"], "attachments": []}, {"timestamp": T, "event_type": "mail_sent"}])
    put(tmp_path, "scenario_8_db_logs.json", [{"timestamp": T, "event_type": "db_schema_change", "query": "q", "rows_affected": 0}])
    put(tmp_path, "scenario_8_file_logs.json", [{"timestamp": T, "event_type": "file_delete", "file_path": "/a", "file_size_bytes": 0}])
    put(tmp_path, "scenario_8_admin_logs.json", [])
    got = normalize.normalize({k: raw.read_raw(spark, str(tmp_path), k) for k in raw.RAW})
    rows = {r.event_id: r for r in got.collect()}
    line = lambda r: (r.source_type, r.user, r.action, r.resource, r.status, r.severity)
    assert [line(rows[f"evt_s7_{i:03d}"]) for i in range(1, 8)] == [
        ("auth", None, "logout", None, None, "info"), ("auth", "u", "login", None, "Failure", "warning"), ("network", None, "blocked", "d", "blocked", "info"),
        ("web_server", None, "http_error", "/", "403", "warning"), ("web_server", None, "http_request", "/x", "200", "info"),
        ("web_server", None, "http_request", "/y", "odd", "info"), ("web_server", None, "http_error", "/z", "500", "warning"),
    ]
    assert [line(rows[f"evt_s8_{i:03d}"]) for i in range(1, 5)] == [
        ("file_access", None, "file_delete", "/a", None, "warning"), ("database", None, "db_schema_change", "q", None, "critical"),
        ("email", "u", "mail_sent", "a, b", None, "info"), ("email", None, "mail_sent", "", None, "info"),
    ]
    net, web, file = rows["evt_s7_003"], rows["evt_s7_004"], rows["evt_s8_001"]
    assert (net.metadata.src_port, net.metadata.bytes_transferred, net.bytes, net.local_minute) == (None, 5, 5, 167)
    assert (web.metadata.duration_ms, web.metadata.status_code, file.metadata.file_size_bytes) == (None, "403", 0)
    assert rows["evt_s7_001"].t is None and len(rows) == 11


def test_baselines_and_truth(spark, tmp_path):
    put(tmp_path, "b.json", {"u": {"normal_hours": "08:30-18:05", "normal_ips": ["1.1.1.1"]}, "v": {}})
    got = {r.user: (r.start_minute, r.end_minute, r.normal_ips) for r in raw.read_baselines(spark, str(tmp_path / "b.json")).collect()}
    assert got == {"u": (510, 1085, ["1.1.1.1"]), "v": (None, None, None)}
    put(tmp_path, "t.json", {"scenarios": [{"id": "scenario_12", "label": "BENIGN", "attack_steps": []}]})
    assert [(r.case_id, r.label) for r in raw.read_truth(spark, str(tmp_path / "t.json")).collect()] == [("12", "BENIGN")]
    put(tmp_path, "c.json", {"scenario_id": "scenario_3", "events": [{"event_id": "e1", "timestamp": T, "action": "login"}]})
    assert [(r.case_id, r.event_id, r.local_minute) for r in raw.read_cases(spark, str(tmp_path / "c.json")).collect()] == [("3", "e1", 167)]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    got, want = QUERIES[name](spark, SMALL), con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect())))
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in cols)).fetchall()))


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_one_array_is_read_in_blocks(spark, tmp_path, size):
    odd = ['a "b" {c}', "}{", "\\", '\\"}', "x" * 200, "", "{[\n", "é}ü", '"', "\\\\}\\"]
    rows = [{"timestamp": T, "event_type": f"e{i}", "sender": odd[i % 10], "recipients": [odd[(i + 3) % 10], "}"], "nested": {"k": [{"z": odd[(i + 5) % 10]}]}, "subject": None} for i in range(60)]
    (tmp_path / "scenario_1_email_logs.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "scenario_2_email_logs.json").write_text(json.dumps(rows[:7], ensure_ascii=False))
    (tmp_path / "scenario_3_email_logs.json").write_text(json.dumps(rows[0]))
    (tmp_path / "scenario_4_email_logs.json").write_text("[]\n")
    (tmp_path / "scenario_5_email_logs.json").write_text("")
    (tmp_path / "scenario_6_email_logs.json").write_text(json.dumps(rows[:2])[:-30])  # cut off
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = raw.read_raw(spark, str(tmp_path), "email").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted({r.case_id for r in got}) == ["1", "2", "3", "6"]
    for case, want in (("1", rows), ("2", rows[:7]), ("3", rows[:1]), ("6", rows[:1])):
        mine = sorted((r for r in got if r.case_id == case), key=lambda r: r.pos)
        assert [(r.pos, r.event_type, r.sender, r.recipients) for r in mine] == [(i, r["event_type"], r["sender"], r["recipients"]) for i, r in enumerate(want)]
