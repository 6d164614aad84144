"""Rules and patterns on hand-made events, against slow plain Python, and on the driver's events against SQL."""

import random

import duckdb
import pytest

from logsift.operators import correlate, rules, runs, timeline
from logsift.operators.windows import sliding, trailing
from logsift.plans.queries import QUERIES, SQL

from .conftest import SMALL

COLUMNS = "case_id string, event_id string, timestamp string, t long, local_minute int, seq long, source_type string, user string, action string, resource string, source_ip string, status string, session_id string, severity string, bytes long"
MIN = 60_000_000


def table(spark, rows):
    base = dict(case_id="c", timestamp="", t=0, local_minute=600, source_type="auth", user="u", action="login", resource=None, source_ip="1.1.1.1", status="success", session_id=None, severity="info", bytes=None)
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    full = [base | {"event_id": f"e{i:03d}", "seq": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], COLUMNS)


def known(spark, ips=("1.1.1.1",)):
    return spark.createDataFrame([("u", 540, 1020, list(ips), ["/a/"])], "user string, start_minute int, end_minute int, normal_ips array<string>, normal_directories array<string>")


def literal(events, width, more_than):
    """Each window [t, t + width] with more than so many events, if it holds one that no earlier window held."""
    seen, out = set(), []
    rows = sorted(events, key=lambda e: (e[1], e[2]))
    for i, e in enumerate(rows):
        ids = [x[0] for x in rows[i:] if x[1] <= e[1] + width]
        if len(ids) > more_than and set(ids) - seen:
            out.append(",".join(ids))
            seen |= set(ids)
    return sorted(out)


def test_sliding_with_ties(spark):
    rng = random.Random(5)
    rows = [{"user": f"u{rng.randrange(6)}" if rng.random() < 0.9 else None, "t": rng.randrange(40)} for _ in range(300)]
    ev = table(spark, rows)
    got = sliding(ev, ["case_id", "user"], 4, "n > 3").collect()
    for user in {r["user"] for r in rows}:
        mine = [(f"e{i:03d}", r["t"], i) for i, r in enumerate(rows) if r["user"] == user]
        assert sorted(g.event_ids for g in got if g.user == user) == literal(mine, 4, 3)


def test_windows_across_slices(spark):
    """Widths far below the span of the events: windows and suppression cross the borders of slices."""
    rng = random.Random(6)
    rows = [{"user": rng.choice(["u", None]), "t": rng.randrange(-150, 150)} for _ in range(500)]
    ev = table(spark, rows)
    for width, more_than in ((1, 2), (3, 6), (5, 9)):
        got = sliding(ev, ["case_id", "user"], width, f"n > {more_than}").collect()
        back = trailing(ev, ["case_id", "user"], width, more_than).collect()
        for user in ("u", None):
            mine = sorted([(f"e{i:03d}", r["t"], i) for i, r in enumerate(rows) if r["user"] == user], key=lambda e: (e[1], e[2]))
            assert sorted(g.event_ids for g in got if g.user == user) == literal(mine, width, more_than)
            want, starts = [], set()
            for j, e in enumerate(mine):
                window = [x[0] for x in mine[: j + 1] if x[1] >= e[1] - width]
                if len(window) > more_than and window[0] not in starts:
                    starts.add(window[0])
                    want.append(",".join(window))
            assert sorted(g.event_ids for g in back if g.user == user) == sorted(want)


def test_sums_and_kinds_across_slices(spark):
    rng = random.Random(7)
    kinds = [("auth", "login"), ("database", "db_login"), ("web_server", "http_request")]
    rows = []
    for _ in range(300):
        source, action = rng.choice(kinds)
        rows.append({"t": rng.randrange(400) * MIN, "source_type": source, "action": action, "user": rng.choice(["u", "", None, "v"])})
    rows += [{"t": rng.randrange(400) * MIN, "source_type": "network", "action": "x", "bytes": rng.randrange(60) << 20, "user": None} for _ in range(120)]
    rng.shuffle(rows)
    found = rules.run_rules(table(spark, rows), None, registry={k: rules.REGISTRY[k] for k in ("R011", "R012")}).collect()
    order = sorted(((r["t"], i, r) for i, r in enumerate(rows)), key=lambda x: x[:2])
    want, seen = [], set()
    net = [x for x in order if x[2]["source_type"] == "network" and x[2]["bytes"]]
    for k, (t, _, _) in enumerate(net):
        window = [x for x in net[k:] if x[0] <= t + 30 * MIN]
        ids = [f"e{x[1]:03d}" for x in window]
        if sum(x[2]["bytes"] for x in window) > 100 << 20 and set(ids) - seen:
            seen |= set(ids)
            want.append(("R011", "N/A", ",".join(ids)))
    for user in ("u", "v"):
        own, times = [x for x in order if x[2]["user"] == user and x[2]["source_type"] != "network"], set()
        for k, (t, _, _) in enumerate(own):
            window = [x for x in own[k:] if x[0] <= t + 30 * MIN]
            if len({x[2]["source_type"] for x in window}) > 1 and t not in times:
                times.add(t)
                want.append(("R012", user, ",".join(f"e{x[1]:03d}" for x in window)))
    assert sorted((r.rule_id, r.user, r.event_ids) for r in found) == sorted(want)


def test_severities_names_and_missing_lists(spark):
    rows = [{"action": "file_download", "source_type": "file_access", "resource": "/a/x", "t": i} for i in range(6)]
    found = {r.rule_id: r for r in rules.run_rules(table(spark, rows + [{"t": 9}, {"t": 9, "source_type": "database", "action": "db_login"}]), known(spark)).collect()}
    assert (found["R004"].severity, found["R012"].severity) == ("critical", "warning")
    assert found["R004"].rule_name == "bulk_download" and found["R004"].description.startswith("Bulk download detected: 6 files downloaded within 30 minutes")
    bare = spark.createDataFrame([("u", 540, 1020, None, None)], "user string, start_minute int, end_minute int, normal_ips array<string>, normal_directories array<string>")
    assert [r.description for r in rules.one_rule("R001", table(spark, [{}]), bare).collect()] == ["Login from unusual IP 1.1.1.1. Normal IPs: []"]
    assert correlate.unusual_login_ip(table(spark, [{}]), bare).count() == 0
    change = table(spark, [{"action": "privilege_change", "source_type": "admin"}, {"t": 5, "source_type": "file_access", "action": "file_read", "resource": "/z"}])
    assert [r.severity for r in correlate.new_access_after_privilege(change, bare).collect()] == ["warning"]
    others = table(spark, [{"source_type": "database", "source_ip": "9.9.9.9", "session_id": "s"}, {"source_type": "admin", "session_id": "s"}, {"source_type": "admin", "session_id": ""}])
    assert correlate.unusual_login_ip(others, known(spark)).count() == 0
    assert [r.event_ids for r in correlate.session_gap(others, known(spark)).collect()] == ["e001"]


def test_alerts_in_order_of_time(spark):
    ev = table(spark, [{"action": "log_delete", "timestamp": "2024-01-02"}, {"action": "privilege_change", "timestamp": "2024-01-02"}, {"action": "log_delete", "timestamp": "2024-01-01"}])
    got = rules.ordered_alerts(rules.run_rules(ev, None, registry={k: rules.REGISTRY[k] for k in ("R003", "R006")})).collect()
    assert [(r.rule_id, r.event_ids) for r in sorted(got, key=lambda r: r.position)] == [("R006", "e002"), ("R003", "e001"), ("R006", "e000")]


def test_trailing_once_per_start(spark):
    rows = [{"t": t} for t in (0, 0, 1, 2, 9, 10, 11, 11)]
    got = sorted(r.event_ids for r in trailing(table(spark, rows), ["case_id", "user"], 3, 2).collect())
    assert got == ["e000,e001,e002", "e004,e005,e006"]


def test_window_ends_are_closed(spark):
    at = lambda *ts: table(spark, [{"action": "login_failed", "t": t} for t in ts])
    assert rules.one_rule("R007", at(0, 5 * MIN), None).count() == 1
    assert rules.one_rule("R007", at(0, 5 * MIN + 1), None).count() == 0


def test_row_rules(spark):
    ev = table(spark, [
        {"source_ip": "9.9.9.9"}, {"source_ip": None}, {"user": "stranger", "source_ip": "9.9.9.9"}, {"local_minute": 540}, {"local_minute": 1021},
        {"source_type": "web_server", "action": "x", "status": "500", "resource": "/?q=1 or  1=1"}, {"source_type": "web_server", "action": "x", "status": "odd", "resource": "union"},
        {"source_type": "file_access", "action": "file_read", "resource": "/b/x"}, {"source_type": "file_access", "action": "file_read", "resource": "role"},
    ])
    bl = known(spark)
    ids = lambda df: sorted(r.event_ids for r in df.collect())
    assert ids(rules.one_rule("R001", ev, bl)) == ["e000"]
    assert ids(rules.one_rule("R002", ev, bl)) == ["e004"]
    assert ids(rules.one_rule("R010", ev, bl)) == ["e005"]
    assert ids(rules.one_rule("R005", ev, bl)) == ["e007"]
    assert len(ids(rules.one_rule("R001", ev, known(spark, ())))) == 3  # one login has no address


def test_privilege_then_download_is_after_only(spark):
    ev = table(spark, [{"action": "file_download", "t": 5}, {"action": "privilege_change", "t": 5}, {"action": "file_download", "t": 6}, {"action": "file_download", "t": 5 + 30 * MIN}, {"action": "file_download", "t": 6 + 30 * MIN}])
    assert [r.event_ids for r in rules.one_rule("R008", ev, None).collect()] == ["e001,e002,e003"]


def test_silent_case_and_verdicts(spark):
    ev = table(spark, [{"case_id": "quiet"}, {"case_id": "bad", "action": "log_delete"}, {"case_id": "odd", "source_ip": "9.9.9.9"}])
    got = {r.case_id: r.verdict for r in rules.rule_results(rules.run_rules(ev, known(spark)), ev).collect()}
    assert got == {"quiet": "no_alert", "bad": "attack", "odd": "suspicious"}


def test_stuffing_run_is_ended_by_any_login(spark):
    f, ok, no = {"action": "login_failed"}, {}, {"status": "failure"}
    ev = table(spark, [r | {"t": i} for i, r in enumerate([f, f, ok, f, no, ok, f])])
    assert [r.event_ids for r in correlate.credential_stuffing(ev, None).collect()] == ["e000,e001,e002"]


def test_timeline_and_removal(spark):
    ev = table(spark, [{"t": i, "session_id": ""} for i in range(11)])
    assert timeline.summary(ev).collect()[0].total_events == 11
    assert timeline.grouped(ev, "session_id", "no_session").collect()[0].session_id == "no_session"
    left = {(r.level, r.trial): r["count"] for r in runs.unfolded(runs.with_runs(ev), runs.grid()).groupBy("level", "trial").count().collect()}
    assert left == {(0, 1): 11} | {(p, k): 11 - 11 * p // 100 for p in (20, 40, 60, 80) for k in (1, 2, 3)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    got = QUERIES[name](spark, SMALL)
    want = con.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect())))
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_a_burst_gives_a_row_for_each_event(spark):
    n = 100_000  # a download a second: 1,800 in each window, so that lists of ids would hold 177 million
    ev = spark.range(n).selectExpr(
        "'c' AS case_id", "concat('e', id) AS event_id", "id * 1000000 AS t", "cast(id AS string) AS timestamp", "id AS seq", "'file_access' AS source_type", "'u' AS user", "'file_download' AS action",
        "'/d/x' AS resource", "'1.1.1.1' AS source_ip", "'success' AS status", "'s' AS session_id", "'info' AS severity", "cast(1 AS bigint) AS bytes", "60 AS local_minute",
    )
    found = rules.run_rules(ev, None, {}, {"R004": rules.REGISTRY["R004"]}, ids=False)
    # every window that ends at an event of its own: the last 1,800 starts end where one before them has
    assert found.count() == n - 1800
    ends = {r.first_event: (r.last_event, r.n_events) for r in found.where("t % 10000000000 = 0").collect()}
    assert ends["e0"] == ("e1800", 1801) and ends["e90000"] == ("e91800", 1801)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "sequence(" not in plan


def test_intervals_are_the_ends_of_the_lists(spark):
    from logsift.plans.queries import alerts, intervals

    lists = alerts(spark, SMALL).selectExpr("case_id", "rule_id", "t", "description", "split(event_ids, ',') AS x").selectExpr("*", "x[0] AS first_event", "element_at(x, -1) AS last_event", "size(x) AS n_events").drop("x")
    cols = lists.columns
    assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, intervals(spark, SMALL).select(*cols).collect()))


def test_events_of_named_alerts(spark):
    """Ties, null users, a change at the time of its downloads, single events, and no alerts."""
    acts = ["file_download"] * 4 + ["privilege_change"] + ["login_failed"] * 2 + ["login", "db_login"]
    kinds = {"db_login": "database", "file_download": "file_access"}
    draw = random.Random(5)
    ev = table(spark, [dict(action=(a := draw.choice(acts)), source_type=kinds.get(a, "auth"), user=draw.choice(["u", "v", None]), t=draw.randrange(40) * 2 * MIN) for _ in range(150)])
    args = {"R004": {"threshold": 2}, "R008": {"width": 9 * MIN}}
    picked = {k: rules.REGISTRY[k] for k in ("R003", "R004", "R007", "R008", "R012")}
    lists = rules.run_rules(ev, None, args, picked).collect()
    want = sorted((r.rule_id, r.event_ids.split(",")[0], x) for r in lists for x in r.event_ids.split(","))
    named = rules.run_rules(ev, None, args, picked, ids=False)
    assert {r.rule_id for r in lists} == set(picked)
    assert sorted((r.rule_id, r.first_event, r.event_id) for r in rules.alert_events(named, ev, args, picked).collect()) == want
    one = named.where("rule_id = 'R008'").orderBy("first_event").limit(1)
    first = one.first().first_event
    assert sorted(r.event_id for r in rules.alert_events(one, ev, args, picked).collect()) == sorted(x for k, f, x in want if (k, f) == ("R008", first))
    assert rules.alert_events(named.limit(0), ev, args, picked).count() == 0
    assert rules.alert_events(named.where("rule_id = 'R003'"), ev, {}, {"R003": picked["R003"]}).count() == sum(k == "R003" for k, *_ in want)


def test_sliced_sums_and_rows_before(spark):
    """A key of many slots, slots without rows between, null keys, null slots, null values and ties in all but the order."""
    import random

    from pyspark.sql import functions as F

    from logsift.operators.windows import previous, running

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(0, 400, 7)]), i, rng.choice(["x", "y", None]), rng.randrange(3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, v string, w long").repartition(5)
    slot, seen, want = F.floor(F.col("t") / 50), {}, {}
    for k, t, seq, v, w in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2])):
        total, last = seen.get(k, (0, None))
        want[seq], seen[k] = (total, last), (total + w, v)
    sums = {r.seq: r.s for r in running(df, ["k"], slot, ["t", "seq"], F.col("w"), "s").collect()}
    before = {r.seq: r.b for r in previous(df, ["k"], slot, ["t", "seq"], "v", "b").collect()}
    assert {i: (sums[i], before[i]) for i in sums} == want
