"""Evaluation measures against the single checks, run bitmaps against a slow version, on small and odd tables."""

import hashlib

from pyspark.sql import functions as F

from logsift.operators import answers as A
from logsift.operators import claims as C
from logsift.operators import evaluate as E
from logsift.operators import measures as M
from logsift.operators import rules, runs
from logsift.plans.cases import answers, truth
from logsift.sources.driver import baselines, events

from .conftest import SMALL

EVENT = "case_id string, event_id string, t long, seq long, user string, source_ip string, resource string, action string, status string, bytes long"
ANSWER = "case_id string, verdict string, attack_chain array<struct<step: int, event_id: string, description: string>>, evidence_for array<string>, evidence_against array<string>, narrative string"


def by(df, *columns):
    return {r.case_id: tuple(r[c] for c in columns) for r in df.collect()}


def odd(spark):
    minute = 60_000_000
    ev = [("c", f"evt_{i}", i * minute, i, "user_1" if i % 2 else None, "10.0.0.1", f"/data/f{i}" if i % 3 else None, ("file_download", "log_delete", "login")[i % 3], "success", 1 << 20) for i in range(9)]
    ev += [("d", "evt_0", None, 1, None, None, None, None, None, None), ("d", "evt_1", 5, 2, "user_2", "10.0.0.2", "", "login", None, None)]
    an = [
        ("c", "YES", [(1, "evt_5", "log deletion shortly after evt_1"), (2, "evt_2", "downloaded 9 files, a total of 50 MB within 3 minutes"), (3, None, "5 hours after evt_3"), (4, "evt_x", None)], ["evt_1", None, "evt_y", "evt_y"], None, "user_1 and user_7 at 10.0.0.9 read /data/f1 over 30 days; 1 hour after evt_1 and evt_8"),
        ("d", None, None, None, None, None),
        ("e", "INSUFFICIENT", [], [], ["evt_1"], "nothing"),
    ]
    return spark.createDataFrame(ev, EVENT), spark.createDataFrame(an, ANSWER)


def agree(an, ev):
    """Each column of the checks equals what the single check gives."""
    got = M.checks(an, ev)
    for part in (A.event_references(an, ev), A.timeline_correctness(an, ev), A.unsupported_claims(an), C.temporal_claims(an, ev), C.volume_claims(an, ev)):
        names = [c for c in part.columns if c != "case_id"]
        assert by(got, *names) == by(part, *names), names
    named = lambda rows: sorted((r.case_id, r.type, r.value) for r in rows.collect())
    assert named(got.select("case_id", F.explode("unknown_names").alias("x")).select("case_id", "x.*")) == named(C.unknown_entities(an, ev))


def test_checks_agree_with_single_ones(spark):
    agree(answers(spark, SMALL), events(spark, SMALL))
    ev, an = odd(spark)
    agree(an, ev)
    agree(an, ev.limit(0))
    assert M.checks(an.limit(0), ev).count() == 0


def test_evaluation_of_odd_cases(spark):
    ev, an = odd(spark)
    tr = spark.createDataFrame([("c", "ATTACK", ["log_deletion", "privilege_escalation"]), ("d", "BENIGN", []), ("e", "ATTACK", []), ("f", "ATTACK", ["logout"])], "case_id string, label string, attack_steps array<string>")
    al = spark.createDataFrame(
        [("c", "R006", "log_deletion", "critical", "Log deletion detected", 60_000_000), ("c", "R002", "off_hours_access", "warning", "early", 0), ("d", "R002", "off_hours_access", "warning", "late", 5)],
        "case_id string, rule_id string, rule_name string, severity string, description string, t long",
    )
    got = {r.case_id: r for r in M.evaluation(tr, al, an, ev).collect()}
    assert set(got) == set("cdef")
    c, d, e, f = (got[k] for k in "cdef")
    assert (c.rule_verdict, c.llm_verdict, c.rule_correct, c.llm_correct) == ("attack", "YES", True, True)
    assert (c.total_steps, c.detected_steps, c.recall_pct, c.missed_steps) == (2, 1, 50.0, "privilege_escalation")
    assert (c.rule_precision, c.llm_precision, c.rule_f1, c.llm_f1) == (0.5, 0.25, 0.5, 0.3333)
    assert [tuple(x) for x in c.rule_breakdown] == [("R002", 1, False), ("R006", 1, True)]
    assert c.rule_seconds == 0.0 and c.llm_seconds == 120.0  # no event tells of a step, so times count from the first; evt_2 is the first cited
    assert (d.rule_verdict, d.llm_verdict, d.llm_mapped, d.rule_fp_count, d.false_positive_rate_pct, d.recall_pct, d.llm_seconds) == ("suspicious", None, "UNKNOWN", 1, 50.0, None, None)
    assert (e.rule_verdict, e.llm_mapped, e.total_steps, e.recall_pct, e.llm_f1, e.false_positive_rate_pct) == ("no_alert", "BENIGN", 0, 100.0, 0.0, 0.0)
    assert (f.llm_verdict, f.hallucination_count, f.evidence_grounding_pct, f.timeline_correct, f.rule_seconds) == (None, 0, 100.0, True, None)
    single = E.false_positives(tr, al, ev, an)
    assert by(M.evaluation(tr, al, an, ev), "rule_fp_count", "llm_fp", "false_positive_rate_pct") == by(single, "rule_fp_count", "llm_fp", "false_positive_rate_pct")
    assert M.evaluation(tr.limit(0), al, an, ev).count() == 0


def test_evaluation_reads_events_twice(spark, tmp_path):
    ev, an = odd(spark)
    for name, rows in (("ev", ev), ("an", an), ("tr", truth(spark, SMALL).limit(2)), ("al", spark.createDataFrame([], "case_id string, rule_id string, rule_name string, severity string, description string, t long"))):
        rows.write.parquet(f"{tmp_path}/{name}")
    ev, an, tr, al = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("ev", "an", "tr", "al"))
    plan = M.evaluation(tr, al, an, ev)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "bytes#" in line for line in plan.splitlines()) == 2


def test_runs_equal_a_slow_version(spark):
    ev = events(spark, SMALL).unionByName(events(spark, SMALL).where("false"))
    got = {}
    for r in runs.with_runs(ev).select("case_id", "event_id", "runs").collect():
        got[r.case_id, r.event_id] = r.runs
    rows = {}
    for r in ev.select("case_id", "event_id", "seq").collect():
        rows.setdefault(r.case_id, []).append((r.event_id, r.seq))
    want = dict.fromkeys(got, 0)
    for case, own in rows.items():
        for i, (level, trial) in enumerate(runs.grid()):
            order = sorted(own, key=lambda e: (hashlib.md5(f"{e[0]}|{level}|{trial}|42".encode()).hexdigest(), e[1]))
            for e, _ in order[len(own) * level // 100 :]:
                want[case, e] |= 1 << i
    assert got == want


def test_runs_of_few_events_and_none(spark):
    ev = spark.createDataFrame([("a", "e1", 1, 1), ("a", "e2", 2, 2), ("b", "e3", 3, 3)], "case_id string, event_id string, t long, seq long")
    left = {(r.case_id, r.level, r.trial): r.n for r in runs.unfolded(runs.with_runs(ev), runs.grid()).groupBy("case_id", "level", "trial").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert left == {(c, p, k): n - n * p // 100 for c, n in (("a", 2), ("b", 1)) for p, k in runs.grid()}
    assert runs.with_runs(ev.limit(0)).count() == 0


def test_runs_are_no_copies_before_the_windows(spark):
    ev = events(spark, SMALL)
    plan = runs.with_runs(ev)._jdf.queryExecution().optimizedPlan().toString()
    # counting by slot and the few rows of the slots that are cut; what is joined last is the events themselves
    assert plan.count("Generate") == 2 and plan.splitlines()[0].startswith("Project")


def test_orders_kept_equal_a_slow_version(spark):
    hour = 3_600_000_000
    rows = [("a", f"e{i}", i * hour // 7, i) for i in range(40)] + [("b", "x1", 5, 1), ("b", "x2", 5, 2), ("c", "y", None, 1), ("d", "z", 9, 1)]
    ev = spark.createDataFrame(rows, "case_id string, event_id string, t long, seq long")
    widths = (0, 60_000_000, 2 * hour)
    want = {}
    for case in "abd":
        own = [(t, s, e) for c, e, t, s in rows if c == case]
        for w in widths:
            def moved(x, w=w):
                u = int(hashlib.md5(f"{x[2]}|{w}|42".encode()).hexdigest()[:8], 16) / 2**32
                v = (2 * u - 1) * w
                return (x[0] + (int(v + 0.5) if v >= 0 else -int(-v + 0.5)), x[1])
            want[case, w] = sorted(own, key=lambda x: x[:2]) == sorted(own, key=moved)
    assert {(r.case_id, r.jitter): r.order_kept for r in runs.orders_kept(ev, widths).collect()} == want


def test_modes_and_accuracy(spark):
    ev, an = odd(spark)
    tr = spark.createDataFrame([("c", "ATTACK", ["log_deletion"]), ("d", "BENIGN", []), ("z", "ATTACK", ["logout"])], "case_id string, label string, attack_steps array<string>")
    got = {(r.case_id, r["mode"]): (r.verdict, r.correct, r.recall_pct, r.hallucinations) for r in runs.mode_scores({"raw": an.withColumn("verdict", F.lit("NO")), "whole": an}, tr, ev).collect()}
    assert got[("c", "whole")] == ("YES", True, 100.0, 2) and got[("c", "raw")][:2] == ("NO", False)
    assert got[("d", "whole")] == ("UNKNOWN", True, 100.0, 0) and got[("z", "raw")] == ("UNKNOWN", False, 0.0, 0)
    scores = runs.all_scores(runs.removal_scores(an, tr, runs.with_runs(ev)), runs.jitter_scores(an, tr, ev, (0,)), runs.mode_scores({"whole": an}, tr, ev))
    level = {(r.kind, r.level): r.runs for r in runs.accuracy_by_run(scores).collect()}
    assert level == {("removal", "0"): 2, **{("removal", str(p)): 6 for p in (20, 40, 60, 80)}, ("jitter", "0"): 2, ("mode", "whole"): 3}


def test_removal_exchanges_no_hashes(spark):
    ev = events(spark, SMALL)
    plan = runs.with_runs(ev)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    depth = plan[join + 1].index(":")
    side = [line for line in plan[join + 1 :] if line[depth : depth + 1] == ":"]  # the events that meet the cuts
    assert any("md5(" in line for line in plan[:join]) and side and not any("md5(" in line for line in side)


def test_large_cases_have_the_same_runs(spark):
    ev = events(spark, SMALL)
    by = lambda rows: {(r.case_id, r.event_id): r.runs for r in rows.collect()}
    assert by(runs.with_runs(ev, whole=300)) == by(runs.with_runs(ev)) == by(runs.with_runs(ev, whole=0))


def test_windows_of_all_runs_equal_each_run_alone(spark):
    hour, rows = 3_600_000_000, []
    kinds = [("auth", "login", None), ("database", "db_login", None), ("network", "dns_query", None), ("network", "firewall_allow", 40 << 20), ("file_access", "file_download", None), ("auth", "login_failed", None), ("admin", "privilege_change", None)]
    for i in range(420):
        source, action, size = kinds[(i * 5 + i // 7) % 7]
        rows.append((f"c{i % 2}", f"e{i}", None if i % 41 == 0 else (i // 3) * hour // 20, "2024", i, source, action, f"u{i % 3}" if i % 5 else None, "d.org", size))
    ev = spark.createDataFrame(rows, "case_id string, event_id string, t long, timestamp string, seq long, source_type string, action string, user string, resource string, bytes long").withColumn("runs", F.xxhash64("event_id").bitwiseAND(F.lit(7)))
    made = [rules.bulk_download(hour, 2), rules.failed_login_spike(hour), rules.dns_tunnel(hour, 2), rules.exfiltration_volume(hour), rules.lateral_movement(hour)]
    tell = lambda rows: sorted((r.case_id, r.rule_id, r.severity, r.n) for r in rows.groupBy("case_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n")).collect())
    together, pairs = rules.window_runs(ev, made, 3).cache(), rules.privilege_then_download_runs(ev, hour).cache()
    for r in range(3):
        kept = ev.where(runs.bit(r) == 1)
        want = tell(rules.window_alerts(kept, made, ids=False))
        assert {x[1] for x in want} == {"R004", "R007", "R009", "R011", "R012"} and tell(together.where(F.col("run") == r)) == want
        assert tell(pairs.where(runs.bit(r) == 1)) == tell(rules.privilege_then_download(kept, hour, ids=False)) != []


def test_degraded_results_copy_no_events(spark):
    ev = runs.with_runs(events(spark, SMALL)).localCheckpoint()
    plan = runs.degraded_results(ev, baselines(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    # case_id is put together with level and trial in rows of sums only, none of which feeds a window
    assert not any("concat_ws(#" in line for line in plan[plan.rindex("Window [") :].splitlines())


def test_intervals_meet_in_one_exchange(spark):
    rows = rules.window_alerts(events(spark, SMALL), [rules.bulk_download(), rules.failed_login_spike()], ids=False)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
