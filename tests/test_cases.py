"""Answer checks and scores on hand-made answers, and on the driver's events against SQL."""

import duckdb
import pytest

from logsift.operators import answers as A
from logsift.operators import evaluate as E
from logsift.operators import measures as M
from logsift.operators import claims as C
from logsift.plans.cases import QUERIES, SQL

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if not k.endswith("_all_rules")))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL)
    rows = got.collect()
    assert rows and name in SQL
    if name in SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
        cols, want = sorted(got.columns), con.sql(SQL[name])
        assert cols == sorted(want.columns)
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in rows))) == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_parse(spark):
    texts = ['{"verdict": "YES"}', 'x ```json\n{"verdict": "NO"}\n``` y', 'so {"verdict": "YES"} then', "{broken", "", None]
    rows = A.parse(spark.createDataFrame(list(enumerate(texts)), "case_id int, raw string")).orderBy("case_id").collect()
    assert [r.verdict for r in rows] == ["YES", "NO", "YES", None, None, None]
    assert [r.parse_failed for r in rows] == [False] * 3 + [True] * 3


def test_checks_and_empty_answer(spark):
    kind = "case_id string, event_id string, t long, user string, source_ip string, resource string, action string, bytes long"
    ev = spark.createDataFrame([("c", "evt_1", 5, "user_1", None, None, "x", None), ("c", "evt_2", 3, "user_2", None, None, "x", None)], kind)
    chain = [(1, "evt_1", "privilege use by user_7"), (2, "evt_2", "b"), (3, "evt_9", "c"), (4, None, "d")]
    rows = [("c", "YES", "user_2", chain, ["evt_9", "evt_1"], None, "no ids"), ("d", None, None, None, None, None, None)]
    an = spark.createDataFrame(rows, f"case_id string, {A.SCHEMA}")
    by = lambda df: {r.case_id: tuple(r)[1:] for r in df.collect()}
    assert by(A.event_references(an, ev)) == {"c": (5, 2, 1), "d": (0, 0, 0)}
    assert by(A.timeline_correctness(an, ev)) == {"c": (4, 1, False), "d": (0, 0, True)}
    assert by(A.unsupported_claims(an)) == {"c": (5, 2, 60.0), "d": (0, 0, 100.0)}
    assert by(C.unknown_entities(an, ev)) == {"c": ("user", "user_7")}
    assert by(C.temporal_claims(an, ev)) == {"c": (0, 0), "d": (0, 0)} and by(C.volume_claims(an, ev))["d"] == (0, 0, 0, 0, 0, 0)
    assert by(M.report(an, ev))["c"][0] == 6 and by(M.report(an, ev))["d"][1]
    truth = spark.createDataFrame([("c", "ATTACK", ["privilege_escalation", "odd_step"]), ("d", "BENIGN", [])], "case_id string, label string, attack_steps array<string>")
    texts = an.select("case_id", an.attack_chain[0]["description"].alias("text"))
    assert by(E.recall(truth, texts)) == {"c": (2, 1, 50.0, "odd_step"), "d": (0, 0, 100.0, "")}


def told(spark, chain=(), narrative=None):
    rows = [("c", [(i + 1, e, d) for i, (e, d) in enumerate(chain)], narrative)]
    return spark.createDataFrame(rows, f"case_id string, attack_chain {C.CHAIN}, narrative string")


EVENT = "case_id string, event_id string, t long, user string, source_ip string, resource string, action string, bytes long"


def test_times_told(spark):
    minute = 60_000_000
    ev = spark.createDataFrame([("c", f"evt_{i}", i * minute, "user_1", None, None, "x", None) for i in (0, 10, 15, 16, 65)], EVENT)
    check = lambda *a: tuple(C.temporal_claims(told(spark, *a), ev).collect()[0])[1:]
    assert check([("evt_0", "10 Minutes after evt_10")]) == (1, 0)
    assert check([("evt_0", "20 minutes later than evt_15")]) == (1, 0) and check([("evt_0", "22 minutes later than evt_16")]) == (1, 1)
    assert check([("evt_0", "shortly after evt_15")]) == (1, 0) and check([("evt_0", "shortly after evt_16")]) == (1, 1)
    assert check([("evt_0", "within 1 hour of evt_65")]) == (2, 0)  # two patterns fit
    assert check([("evt_0", "5 hours after evt_0")]) == (1, 0) and check([("evt_0", "5 hours after evt_99")]) == (1, 0)  # one known event
    assert check([], "3 hours after evt_0 and evt_0") == (1, 1)  # a list: the same event twice
    assert check([("evt_0", "600 seconds before evt_10; within 2 hours")]) == (2, 1)


def test_volumes_told(spark):
    day = 86_400_000_000
    ev = spark.createDataFrame([("c", f"evt_{i}", i * day, "user_1", None, None, "file_download", 1 << 20) for i in range(5)], EVENT)
    check = lambda *a: tuple(C.volume_claims(told(spark, *a), ev).collect()[0])[1:]
    assert check([], "downloaded 6 files") == (1, 0, 0, 0, 0, 0) and check([], "stole 7 documents") == (1, 1, 0, 0, 0, 0)
    assert check([], "7 files" + "." * 40 + "download") == (0,) * 6 and check([], "7 files" + "." * 32 + "download") == (1, 1, 0, 0, 0, 0)
    assert check([], "10 MB, 11 MB, 2.5 MB, 2.4 mb, 1 GB") == (0, 0, 5, 3, 0, 0)
    assert check([("evt_0", "one of 900 MB")]) == (0,) * 6 and check([("evt_0", "a total of 900 MB")]) == (0, 0, 1, 1, 0, 0)
    assert check([], "over 5 days, in 6 days, across 1 week, within 96 hours, in 98 hours") == (0, 0, 0, 0, 5, 3)
    none = ev.where("false")
    assert tuple(C.volume_claims(told(spark, [], "downloaded 1 file, 3 MB in 2 days"), none).collect()[0])[1:] == (1, 0, 0, 0, 1, 1)


def test_names_told(spark):
    ev = spark.createDataFrame([("c", "evt_1", 1, "user_1", "10.0.0.1", "/data/a/b.txt", "x", None), ("d", "evt_1", 1, "user_2", "10.0.0.2", "/var/x", "x", None)], EVENT)
    text = "user_1 user_2 user_10 from 10.0.0.1 10.0.0.2 1.2.3.4 to /data/a /data/a/b.txt.old /data/ab /var/x /home/q"
    assert sorted(tuple(r)[1:] for r in C.unknown_entities(told(spark, [(None, text)]), ev).collect()) == [
        ("file_path", "/data/ab"), ("file_path", "/home/q"), ("file_path", "/var/x"), ("ip_address", "1.2.3.4"), ("ip_address", "10.0.0.2"), ("user", "user_10"), ("user", "user_2"),
    ]


def test_times_to_detect_and_precision(spark):
    ev = spark.createDataFrame([("c", f"evt_{i}", i * 1_000_000, a, None, None) for i, a in enumerate(["view", "privilege_change", "log_delete"])], "case_id string, event_id string, t long, action string, resource string, status string")
    truth = spark.createDataFrame([("c", "ATTACK", ["privilege_escalation", "log_deletion"]), ("d", "BENIGN", [])], "case_id string, label string, attack_steps array<string>")
    alerts = spark.createDataFrame([("c", "R003", "privilege_escalation", "x", 500_000), ("c", "R002", "off_hours_access", "y", 900_000)], "case_id string, rule_id string, rule_name string, description string, t long")
    an = told(spark, [("evt_2", "log deletion"), ("evt_9", "nothing")])
    by = lambda df: {r.case_id: tuple(r)[1:] for r in df.collect()}
    assert by(E.time_to_detect(truth, alerts, an, ev)) == {"c": (-0.5, 1.0), "d": (None, None)}
    assert by(E.rule_scores(truth, alerts)) == {"c": (0.5, 0.5), "d": (None, None)}
    assert by(E.answer_precision(truth, an)) == {"c": (0.5,), "d": (None,)}
    assert by(E.rule_breakdown(truth, alerts).drop("rule_id").groupBy("case_id").agg({"alert_count": "sum"}))["c"] == (2,)


def test_unknown_paths_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: "/" + "".join(rng.choice("ab/\u00e9\U0001f600~") for _ in range(rng.randrange(6)))
    paths, known = ({(rng.choice("cd"), word()) for _ in range(n)} for n in (300, 60))
    known = {(c, r) for c, r in known if len(r) > 1} | {("c", "/"), ("d", "")} - {("c", "/")}
    paths |= {("e", "/a")}  # a case without resources
    df = lambda rows, names: spark.createDataFrame([*rows, *list(rows)[:5]], names)
    got = {tuple(r) for r in C.unknown_paths(df(sorted(paths), "case_id string, value string"), df(sorted(known), "case_id string, resource string"), 3).collect()}
    assert got == {(c, v) for c, v in paths if not any(k == c and r and (r.startswith(v) or v.startswith(r)) for k, r in known)} and 20 < len(got) < len(paths)
