"""Queries of reports, figures, robustness runs and storage over the driver's events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlate, degrade, measures, reports, rules, runs, timeline
from ..sources import store
from ..sources.store import shared_folder, written
from ..sources.driver import EVENTS_SQL, baselines, dense_events, events
from .cases import BASE, SCORES, answers, evaluations, results, truth
from .logs import raw_rows
from .queries import ALERTS_SQL, FINDINGS_SQL, PARAMS, alerts, findings, intervals

def rows_of_cases(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    rows = written(evaluations(spark, d, found))
    return written(reports.case_rows(rows.drop(*measures.ALERTS), measures.results_of(rows), answers(spark, d), timeline.summary(events(spark, d))))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    found = written(alerts(spark, d))
    return reports.reports(rows_of_cases(spark, d, found), reports.key_findings(found))


def flat_reports(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _reports(spark, d).select(
        "case_id", "report_id", "executive_summary", c("case.name").alias("name"), c("timeline_summary.total_events").alias("total_events"), c("timeline_summary.start").alias("start"), c("rule_analysis.verdict").alias("rule_verdict"),
        c("rule_analysis.alert_count").alias("alert_count"), F.array_join("rule_analysis.key_findings", "|").alias("key_findings"), F.size("llm_analysis.attack_chain").cast("long").alias("steps"), c("comparative_assessment.agreement").alias("agreement"),
        c("comparative_assessment.added_value").alias("added_value"), c("evidence_integrity.hallucination_count").alias("hallucination_count"), F.array_join("recommendations", "|").alias("recommendations"),
    )


def bitmaps(spark: SparkSession, d: str) -> DataFrame:
    return written(runs.with_runs(events(spark, d)))


def citable(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the events with the runs that keep them."""
    return written(runs.with_runs(events(spark, d).select("case_id", "event_id", "seq")))


def degraded_results(spark: SparkSession, d: str) -> DataFrame:
    """Rule results of every removal run. Only the runs of rules over single events and of R008 depend on no width."""
    return runs.degraded_results(bitmaps(spark, d), baselines(spark, d), PARAMS)


def removal_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = runs.removal_scores(written(answers(spark, d)), written(truth(spark, d)), citable(spark, d))
    return rows.withColumn("case_id", runs.run_name("case_id", "level", "trial")).drop("trial")


def raw_answers(rows: DataFrame) -> DataFrame:
    """Answers as from raw logs alone: every fifth case undecided, every second step of a chain missing, a false id cited."""
    n = F.regexp_extract("case_id", r"\d+", 0).cast("long")
    verdict = F.when(n % 5 == 0, "INSUFFICIENT").otherwise(F.col("verdict"))
    chain = F.filter("attack_chain", lambda s, i: i % 2 == 0)
    return rows.withColumn("verdict", verdict).withColumn("attack_chain", chain).withColumn("evidence_against", F.array(F.lit("evt_raw"))).withColumn("narrative", F.lit(None).cast("string"))


def all_run_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of removal and jitter runs and of both modes. Events of the jitter runs are those in compressed time."""
    an, tr = written(answers(spark, d)), written(truth(spark, d))
    modes = runs.mode_scores({"raw_logs": raw_answers(an), "full_pipeline": an}, tr, events(spark, d))
    return runs.all_scores(runs.removal_scores(an, tr, citable(spark, d)), runs.jitter_scores(an, tr, dense_events(spark, d)), modes)


def jitter_orders(spark: SparkSession, d: str) -> DataFrame:
    return runs.orders_kept(dense_events(spark, d))


def limited_answers(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).where("seq % 3 <> 0")
    return degrade.surviving(answers(spark, d), ev).select("case_id", F.size("attack_chain").cast("long").alias("steps"), F.size("evidence_for").cast("long").alias("evidence"))


def stored_twice(spark: SparkSession, d: str) -> DataFrame:
    """Events stored with even seq first, then all of them and some again: how many were given and added then."""
    folder, ev = shared_folder(spark), events(spark, d)
    store.append_new(ev.where("seq % 2 = 0"), f"{folder}/events", f"{folder}/first")
    return store.load_events(ev.unionByName(ev.where("seq % 5 = 0")), f"{folder}/events", f"{folder}/second")


def all_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """All artefacts loaded, then loaded again with answers and evaluations of some cases only: what the second load gave and stored."""
    folder, ev, an = shared_folder(spark), events(spark, d), answers(spark, d).select("case_id", "verdict")
    found, scores = store.written(alerts(spark, d).select("case_id", "rule_id", "severity", "t", "event_ids")), store.written(evaluations(spark, d).select("case_id", "recall_pct"))
    store.load_all(f"{folder}/t", f"{folder}/s1", ev.where("seq % 3 = 0"), found.where("severity = 'critical'"), an, scores)
    counts = store.load_all(f"{folder}/t", f"{folder}/s2", ev, found, an.where("length(case_id) % 2 = 0").withColumn("verdict", F.lit("INSUFFICIENT")), scores.where("length(case_id) % 2 = 0"))
    held = store.latest(spark, f"{folder}/t/answers", an).groupBy("case_id").agg(F.min("verdict").alias("verdict"))
    return counts.join(held, "case_id", "left").select("case_id", "artefact", "in_file", "stored", "verdict")


def appended(spark: SparkSession, d: str) -> DataFrame:
    """Critical alerts stored, then warnings beside them, read back and counted by case and severity."""
    path, columns = shared_folder(spark), ("case_id", "rule_id", "severity", "t", "event_ids")
    for severity in ("critical", "warning"):  # a rule has one severity, so only its own rules run
        own = {k: f for k, f in rules.REGISTRY.items() if rules.RULES[k][1] == severity}
        rows = rules.run_rules(events(spark, d), baselines(spark, d), PARAMS, own).select(*columns)
        store.append(rows.where(F.col("severity") == severity), path)
    return store.stored(spark, path, rows).groupBy("case_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rule_id").alias("rules"))


def replaced(spark: SparkSession, d: str) -> DataFrame:
    """Answers' verdicts stored, then those of every third case replaced, and read back in order."""
    path, rows = shared_folder(spark), answers(spark, d).select("case_id", "verdict")
    store.replace_keyed(rows, path)
    store.replace_keyed(rows.where(F.length("case_id") % 2 == 0).withColumn("verdict", F.lit("INSUFFICIENT")), path)
    return store.of_case(store.latest(spark, path, rows))


def by_case(spark: SparkSession, d: str) -> DataFrame:
    """Alerts written by case, one case of them overwritten, and one read back."""
    path, rows = shared_folder(spark), alerts(spark, d).select("case_id", "rule_id", "severity", "t", "event_ids")
    store.write_by_case(rows, path)
    store.write_by_case(rows.where("case_id = 'case_1' and severity = 'critical'"), path)
    return store.read_case(spark, path, "rule_id string, severity string, t long, event_ids string", "case_1").unionByName(store.read_case(spark, path, "rule_id string, severity string, t long, event_ids string", "case_2"))


def details(spark: SparkSession, d: str) -> DataFrame:
    ev, found = events(spark, d), written(alerts(spark, d))
    rows = reports.case_details(truth(spark, d), ev, found, answers(spark, d), evaluations(spark, d, found))
    return rows.select("case_id", "label", F.size("events").cast("long").alias("n_events"), F.get("events", F.lit(0))["event_id"].alias("first_event"), F.coalesce(F.size("alerts"), F.lit(0)).cast("long").alias("n_alerts"), F.col("answer.verdict").alias("verdict"), F.col("evaluation.recall_pct").alias("recall_pct"))


def summaries_of_run(spark: SparkSession, d: str) -> DataFrame:
    found = written(intervals(spark, d))
    return reports.run_summary(reports.run_counts(events(spark, d), found, _all_raw(spark, d)), evaluations(spark, d, found))


def parts_of_evidence(spark: SparkSession, d: str) -> DataFrame:
    return reports.evidence_parts(events(spark, d), baselines(spark, d), alerts(spark, d), 50)


def documents_of_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = reports.evidence(events(spark, d), baselines(spark, d), alerts(spark, d))
    count = lambda p: F.regexp_count("document", F.lit(p)).cast("long")
    return rows.select("case_id", count('"event_id":').alias("events"), count('"rule_id":').alias("alerts"), count('"normal_ips":').alias("baselines"))


QUERIES = {
    "rp2_summaries": lambda s, d: reports.executive_summary(rows_of_cases(s, d)),
    "rp3_recommendations": lambda s, d: reports.recommendations(rows_of_cases(s, d)),
    "rp4_key_findings": lambda s, d: reports.key_findings(alerts(s, d)),
    "rp5_added_value": lambda s, d: reports.added_value(rows_of_cases(s, d)),
    "rp6_reports": flat_reports,
    "rp7_combined": lambda s, d: reports.combined(_reports(s, d)),
    "d1_incidents": lambda s, d: reports.incidents(rows_of_cases(s, d)),
    "d1_severity_counts": lambda s, d: reports.severity_counts(reports.incidents(rows_of_cases(s, d))),
    "d6_run_summary": summaries_of_run,
    "io9_appended": appended,
    "d3_quality_figures": lambda s, d: reports.quality_figures(evaluations(s, d)),
    "d4_rule_failures": lambda s, d: reports.rule_failures(evaluations(s, d), truth(s, d)),
    "d5_disagreements": lambda s, d: reports.disagreements(evaluations(s, d)),
    "d6_run_counts": lambda s, d: reports.run_counts(events(s, d), intervals(s, d), _all_raw(s, d)),
    "n15_case_list": lambda s, d: reports.case_list(truth(s, d), truth(s, d).where("label = 'ATTACK'").select("case_id", F.concat("name", F.lit(" of the driver")).alias("description"))),
    "n16_case_details": details,
    "n17_one_case": lambda s, d: reports.select_case(results(s, d), "case_3"),
    "l2_evidence": documents_of_evidence,
    "l2_evidence_parts": parts_of_evidence,
    "s1_kept_events": lambda s, d: runs.unfolded(runs.with_runs(events(s, d).select("case_id", "event_id", "seq")), runs.grid()).select("case_id", "level", "trial", "event_id"),
    "s3_jittered": lambda s, d: degrade.jitter(events(s, d), 30 * 60_000_000).select("case_id", "event_id", "t"),
    "s4_order_kept": jitter_orders,
    "s5_chain_order": lambda s, d: degrade.chain_in_order(answers(s, d)),
    "s6_step_recall": lambda s, d: degrade.step_recall(truth(s, d), answers(s, d)),
    "s9_degraded_results": degraded_results,
    "s10_surviving": limited_answers,
    "s12_removal_scores": removal_scores,
    "s12_run_scores": all_run_scores,
    "s11_accuracy_by_run": lambda s, d: runs.accuracy_by_run(all_run_scores(s, d)),
    "s11_accuracy_by_level": lambda s, d: _by_level(removal_scores(s, d)),
    "io7_by_case": by_case,
    "io10_replaced": replaced,
    "io12_stored": stored_twice,
    "io12_all_artefacts": all_artefacts,
    "c10_findings_by_type": lambda s, d: correlate.by_type(findings(s, d)),
}


def _all_raw(spark: SparkSession, d: str) -> DataFrame:
    parts = [x.select("case_id") for x in raw_rows(spark, d).values()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _by_level(scores: DataFrame) -> DataFrame:
    from ..operators.evaluate import accuracy_by_level

    return accuracy_by_level(scores).select("level", "runs", F.bround("accuracy", 6).alias("accuracy"))


_ROWS = f"""{SCORES}, cr AS (SELECT x10.*, an.suspect, an.narrative, an.n, coalesce(an.steps, 0) AS chain_steps, x10.case_id AS id, an.number, string_agg(ch.description, '; ' ORDER BY ch.pos) AS told,
  CASE WHEN rule_verdict IN ('attack', 'suspicious') THEN 'ATTACK' ELSE 'BENIGN' END AS rule_label, CASE WHEN llm_verdict = 'YES' THEN 'ATTACK' ELSE 'BENIGN' END AS llm_label
  FROM x10 JOIN an ON an.case_id = x10.case_id LEFT JOIN ch ON ch.case_id = x10.case_id GROUP BY ALL),
sm AS (SELECT case_id, trim(CASE WHEN label = 'BENIGN' AND alert_count > 0 THEN case_name || ' is benign but raised ' || alert_count || ' alert(s) (' || replace(rules_triggered, ',', ', ') || '), which are false positives; the answer is ' || llm_verdict || '. ' || narrative
  WHEN label = 'BENIGN' THEN case_name || ' is benign and raised no alert (' || rule_verdict || '); the answer is ' || llm_verdict || '. ' || narrative
  ELSE case_name || ' is an incident. The rules raised ' || alert_count || ' alert(s) and say ' || rule_verdict || '; the answer is ' || llm_verdict || ' with confidence HIGH. Suspect: ' || suspect || '.' || CASE WHEN chain_steps > 0 THEN ' Steps: ' || told || '.' ELSE '' END || ' ' || narrative END) AS summary FROM cr),
rc AS (SELECT case_id, array_to_string(list_filter([CASE WHEN rule_label = 'ATTACK' OR llm_label = 'ATTACK' THEN 'Isolate the account ' || suspect || ', end its sessions and reset its credentials.' END,
  CASE WHEN (rule_label = 'ATTACK' OR llm_label = 'ATTACK') AND criticals > 0 THEN 'Start incident response for the critical alerts.' END,
  CASE WHEN (rule_label = 'ATTACK' OR llm_label = 'ATTACK') AND (contains(rules_triggered, 'R003') OR contains(rules_triggered, 'R008')) THEN 'Tighten the control of privilege changes.' END,
  CASE WHEN (rule_label = 'ATTACK' OR llm_label = 'ATTACK') AND (contains(rules_triggered, 'R004') OR contains(rules_triggered, 'R008')) THEN 'Limit and watch bulk downloads.' END,
  CASE WHEN rule_label = 'BENIGN' AND llm_label = 'BENIGN' AND alert_count > 0 THEN 'Tune rule thresholds to raise fewer false alerts.' END,
  CASE WHEN rule_label = 'BENIGN' AND llm_label = 'BENIGN' THEN 'Keep the users'' baselines up to date.' END, CASE WHEN n % 2 = 0 THEN 'Close the gap: no endpoint logs' END,
  CASE WHEN rule_label <> llm_label THEN 'Find out why the detectors disagree.' END, 'Log network traffic, processes and endpoints too.', 'Test both detectors in regular exercises.', 'Keep a chain of custody for all evidence.'], lambda x: x IS NOT NULL)[1:5], '|') AS recommendations FROM cr),
av AS (SELECT case_id, CASE WHEN llm_correct AND NOT rule_correct THEN 'Only the answer is right: ' || label || '.' WHEN rule_correct AND NOT llm_correct THEN 'Only the rules are right: ' || label || '.' WHEN NOT rule_correct THEN 'Neither is right; review by hand.'
  WHEN rule_fp_count > 0 THEN 'Both are right; the answer spares ' || rule_fp_count || ' false alert(s).' ELSE 'Both are right; the answer adds a narrative' || CASE WHEN n % 2 = 0 THEN ', 1 gap(s)' ELSE '' END || CASE WHEN chain_steps > 0 THEN ', a chain of steps' ELSE '' END || '.' END AS added_value FROM cr),
kf AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY severity, k) AS position, rule_id, description FROM
  (SELECT *, row_number() OVER (PARTITION BY case_id, severity ORDER BY t, rule_id, event_ids) AS k FROM al) WHERE (severity = 'critical' AND k <= 3) OR (severity = 'warning' AND k <= 2))"""
_KEPT = """g AS (SELECT * FROM (VALUES (0, 1), (20, 1), (20, 2), (20, 3), (40, 1), (40, 2), (40, 3), (60, 1), (60, 2), (60, 3), (80, 1), (80, 2), (80, 3)) AS v(level, trial)),
gr AS (SELECT ev.*, level, trial, row_number() OVER (PARTITION BY case_id, level, trial ORDER BY md5(event_id || '|' || level || '|' || trial || '|42'), seq) AS k, count(*) OVER (PARTITION BY case_id, level, trial) AS total FROM ev, g),
kept AS (SELECT * FROM gr WHERE k > total * level // 100)"""
_MOVED = "t + cast(round((2 * (('0x' || substr(md5(event_id || '|' || {w} || '|42'), 1, 8))::BIGINT / 4294967296::DOUBLE) - 1) * {w}) AS BIGINT)"
_RUN = f"""{BASE}, {_KEPT}, rn AS (SELECT DISTINCT case_id, level, trial FROM kept), ct AS (SELECT case_id, level, trial, count(*) AS events_remaining FROM kept GROUP BY ALL),
kz AS (SELECT * FROM (VALUES ('privilege_escalation', 'privilege'), ('privilege_escalation', 'escalat'), ('privilege_escalation', 'read_write'), ('log_deletion', 'log delet'), ('log_deletion', 'anti-forensic'), ('log_deletion', 'cover track'),
  ('bulk_file_download', 'bulk download'), ('bulk_file_download', 'exfiltrat'), ('bulk_file_download', 'mass download'), ('bulk_file_download', 'multiple file'), ('logout', 'logout'), ('logout', 'session end')) AS v(step, word)),
zs AS (SELECT case_id, step, bool_or(contains(lower(coalesce(chain, '') || ' ' || narrative), word)) AS told FROM an, kz WHERE NOT benign GROUP BY case_id, step),
rl AS (SELECT an.case_id, CASE WHEN count(step) = 0 THEN 100.0 ELSE round_even(100.0 * count(*) FILTER (told) / count(step)::DOUBLE, 2) END AS recall_pct FROM an LEFT JOIN zs USING (case_id) GROUP BY an.case_id),
fi AS (SELECT rn.case_id, rn.level, rn.trial, count(DISTINCT ci.event_id) FILTER (kept.event_id IS NULL) AS hallucinations FROM rn LEFT JOIN ci USING (case_id)
  LEFT JOIN kept ON kept.case_id = rn.case_id AND kept.level = rn.level AND kept.trial = rn.trial AND kept.event_id = ci.event_id GROUP BY ALL),
sc AS (SELECT rn.case_id || '#' || rn.level || '#' || rn.trial AS case_id, rn.level, verdict, (verdict = 'YES') = (NOT benign) AS correct, recall_pct, hallucinations, events_remaining
  FROM rn JOIN an USING (case_id) JOIN rl USING (case_id) JOIN fi ON fi.case_id = rn.case_id AND fi.level = rn.level AND fi.trial = rn.trial JOIN ct ON ct.case_id = rn.case_id AND ct.level = rn.level AND ct.trial = rn.trial)"""
_ORDERS = " UNION ALL ".join(
    f"""SELECT case_id, {w} AS jitter, bool_and(a = b) AS order_kept FROM (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY t, seq) AS a, row_number() OVER (PARTITION BY case_id ORDER BY {_MOVED.format(w=w)}, seq) AS b FROM dn) GROUP BY case_id"""
    for w in (0, 300000000, 1800000000, 7200000000)
)
_ALL_RUNS = f"""{_RUN},
rw AS (SELECT an.case_id, CASE WHEN number % 5 = 0 THEN 'INSUFFICIENT' ELSE verdict END AS verdict, benign, string_agg(ch.description, ' ' ORDER BY pos) FILTER (pos % 2 = 1) AS chain FROM an LEFT JOIN ch ON ch.case_id = an.case_id GROUP BY ALL),
rz AS (SELECT case_id, step, bool_or(contains(lower(coalesce(chain, '')), word)) AS told FROM rw, kz WHERE NOT benign GROUP BY case_id, step),
rr AS (SELECT rw.case_id, CASE WHEN count(step) = 0 THEN 100.0 ELSE round_even(100.0 * count(*) FILTER (told) / count(step)::DOUBLE, 2) END AS recall_pct FROM rw LEFT JOIN rz USING (case_id) GROUP BY rw.case_id),
ri AS (SELECT case_id, event_id FROM (SELECT case_id, cited AS event_id FROM ch WHERE cited IS NOT NULL AND pos % 2 = 1 UNION SELECT case_id, event_id FROM ev WHERE action = 'login_failed' UNION SELECT case_id, 'evt_raw' FROM an)),
rf AS (SELECT ri.case_id, count(*) FILTER (ev.event_id IS NULL) AS lost FROM ri LEFT JOIN ev ON ev.case_id = ri.case_id AND ev.event_id = ri.event_id GROUP BY ri.case_id),
jo AS ({_ORDERS}),
ar AS (SELECT string_split(sc.case_id, '#')[1] AS case_id, 'removal' AS kind, substr(sc.case_id, position('#' IN sc.case_id) + 1) AS run, verdict, correct, recall_pct, hallucinations, events_remaining, NULL::BOOLEAN AS order_kept, NULL::BOOLEAN AS chain_in_order FROM sc
  UNION ALL SELECT case_id, 'jitter', cast(jitter AS VARCHAR), verdict, (verdict = 'YES') = (NOT benign), recall_pct, NULL, NULL, order_kept, true FROM jo JOIN an USING (case_id) JOIN rl USING (case_id)
  UNION ALL SELECT case_id, 'mode', 'full_pipeline', verdict, (verdict = 'YES') = (NOT benign), recall_pct, distinct_invalid, NULL, NULL, NULL FROM an JOIN rl USING (case_id) JOIN h1 USING (case_id)
  UNION ALL SELECT case_id, 'mode', 'raw_logs', verdict, (verdict = 'YES') = (NOT benign), recall_pct, lost, NULL, NULL, NULL FROM rw JOIN rr USING (case_id) JOIN rf USING (case_id))"""
# the rules' own SQL, over the kept events of each run in the place of the events
_OVER_RUNS = ALERTS_SQL.replace(f"{EVENTS_SQL},", "WITH").replace(f"{EVENTS_SQL} SELECT", "SELECT")
_DEGRADED = f"""{EVENTS_SQL.replace("ev AS (", "ev0 AS (").replace("FROM ev)", "FROM ev0)")}, {_KEPT.replace("ev.*", "ev0.*").replace("FROM ev, g", "FROM ev0, g")},
ev AS MATERIALIZED (SELECT ev0.* REPLACE (ev0.case_id || '#' || level || '#' || trial AS case_id) FROM kept JOIN ev0 ON kept.event_id = ev0.event_id), al AS ({_OVER_RUNS})
SELECT c.case_id, count(rule_id) AS alert_count, count(DISTINCT rule_id) AS rules_triggered,
  CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'attack' WHEN count(*) FILTER (severity = 'warning') >= 3 THEN 'suspicious' ELSE 'no_alert' END AS verdict
FROM (SELECT DISTINCT case_id FROM ev) c LEFT JOIN al USING (case_id) GROUP BY c.case_id"""
SQL = {
    "rp2_summaries": f"{_ROWS} SELECT * FROM sm",
    "rp3_recommendations": f"{_ROWS} SELECT * FROM rc",
    "rp4_key_findings": f"{_ROWS} SELECT * FROM kf",
    "rp5_added_value": f"{_ROWS} SELECT * FROM av",
    "rp6_reports": f"""{_ROWS} SELECT cr.case_id, printf('FR-2026-%03d', number) AS report_id, summary AS executive_summary, case_name AS name, n AS total_events, start, rule_verdict, alert_count, coalesce(key_findings, '') AS key_findings, chain_steps AS steps,
  rule_mapped = llm_mapped AS agreement, added_value, hallucination_count, recommendations FROM cr JOIN sm USING (case_id) JOIN rc USING (case_id) JOIN av USING (case_id) JOIN (SELECT case_id, arg_min(timestamp, t) AS start FROM ev GROUP BY case_id) USING (case_id)
  LEFT JOIN (SELECT case_id, string_agg(description, '|' ORDER BY position) AS key_findings FROM kf GROUP BY case_id) USING (case_id)""",
    "rp7_combined": f"{SCORES} SELECT count(*) AS reports, count(*) FILTER (label = 'ATTACK') AS attacks, count(*) FILTER (rule_correct) || '/' || count(*) AS rule_accuracy, count(*) FILTER (llm_correct) || '/' || count(*) AS llm_accuracy FROM x10",
    "d1_incidents": f"""{SCORES} SELECT case_id, cast(substr(case_id, 6) AS BIGINT) AS number, label, llm_verdict AS verdict, alert_count, CASE WHEN llm_verdict = 'YES' THEN 'critical' WHEN rule_verdict = 'suspicious' THEN 'warning' ELSE 'clear' END AS severity,
  CASE WHEN llm_verdict = 'YES' THEN 0 WHEN rule_verdict = 'suspicious' THEN 1 ELSE 2 END AS rank FROM x10""",
    "d1_severity_counts": f"""{SCORES} SELECT count(*) FILTER (llm_verdict = 'YES') AS threats, count(*) FILTER (llm_verdict <> 'YES' AND rule_verdict = 'suspicious') AS warnings,
  count(*) FILTER (llm_verdict <> 'YES' AND rule_verdict <> 'suspicious') AS clear, cast(sum(alert_count) AS BIGINT) AS alerts FROM x10""",
    "d6_run_summary": f"{SCORES} SELECT x10.case_id, n AS raw_rows, n AS events, alert_count AS alerts, rule_verdict, llm_verdict, hallucination_count FROM x10 JOIN cs USING (case_id)",
    "io9_appended": f"WITH al AS ({ALERTS_SQL}) SELECT case_id, severity, count(*) AS n, count(DISTINCT rule_id) AS rules FROM al GROUP BY case_id, severity",
    "d3_quality_figures": f"""{SCORES} SELECT count(*) AS cases, round_even(count(*) FILTER (rule_correct) / count(*)::DOUBLE, 4) AS rule_accuracy, round_even(count(*) FILTER (llm_correct) / count(*)::DOUBLE, 4) AS llm_accuracy, round_even(avg(hallucination_count), 4) AS avg_hallucinations,
  round_even(avg(evidence_grounding_pct) FILTER (evidence_grounding_pct > 0), 4) AS avg_grounding, count(*) FILTER (timeline_correct) AS timeline_correct, cast(sum(rule_fp_count) AS BIGINT) AS rule_fp, count(*) FILTER (llm_fp) AS llm_fp FROM x10""",
    "d4_rule_failures": f"{SCORES} SELECT case_id, case_name, label, upper(replace(rule_verdict, '_', ' ')) AS rule_verdict, 'few events' AS challenge FROM x10 WHERE NOT rule_correct",
    "d5_disagreements": f"{SCORES} SELECT case_id, CASE rule_verdict WHEN 'attack' THEN 'YES' ELSE 'UNKNOWN' END AS rule_says, llm_verdict AS answer_says, CASE rule_verdict WHEN 'attack' THEN 'YES' ELSE 'UNKNOWN' END <> llm_verdict AS disagree FROM x10",
    "d6_run_counts": f"{SCORES} SELECT case_id, n AS raw_rows, n AS events, coalesce(k, 0) AS alerts FROM cs LEFT JOIN ac USING (case_id)",
    "n15_case_list": f"{BASE} SELECT case_id, 'Case ' || number AS name, CASE WHEN benign THEN 'BENIGN' ELSE 'ATTACK' END AS label, CASE WHEN NOT benign THEN 'Case ' || number || ' of the driver' END AS description FROM an",
    "n16_case_details": f"{SCORES} SELECT x10.case_id, label, n AS n_events, first AS first_event, alert_count AS n_alerts, llm_verdict AS verdict, recall_pct FROM x10 JOIN cs USING (case_id)",
    "n17_one_case": f"{SCORES} SELECT case_id, alert_count, rules_triggered, warnings, criticals, rule_verdict AS verdict FROM x10 WHERE case_id = 'case_3'",
    "l2_evidence_parts": f"""{EVENTS_SQL}, al AS ({ALERTS_SQL}), told AS (
SELECT case_id, 'baselines' AS part, row_number() OVER (PARTITION BY case_id ORDER BY user) AS k,
  '{{"user":"' || user || '","start_minute":540,"end_minute":1020,"normal_ips":["' || ip || '"],"normal_directories":["' || directory || '"]}}' AS item FROM (SELECT DISTINCT case_id, user FROM ev) JOIN bl USING (user)
UNION ALL SELECT case_id, 'events', row_number() OVER (PARTITION BY case_id ORDER BY t, seq), '{{' || concat_ws(',', '"event_id":"' || event_id || '"', '"timestamp":"' || timestamp || '"', '"source_type":"' || source_type || '"',
  '"user":"' || user || '"', '"action":"' || action || '"', '"resource":"' || resource || '"', '"source_ip":"' || source_ip || '"', '"status":"' || status || '"', '"session_id":"' || session_id || '"', '"severity":"' || severity || '"') || '}}' FROM ev
UNION ALL SELECT case_id, 'alerts', row_number() OVER (PARTITION BY case_id ORDER BY t, rule_id, rule_name, severity, user, event_ids, description),
  '{{' || concat_ws(',', '"timestamp":"' || strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"', '"rule_id":"' || rule_id || '"', '"rule_name":"' || rule_name || '"', '"severity":"' || severity || '"',
  '"user":"' || user || '"', '"event_ids":"' || event_ids || '"', '"description":"' || description || '"') || '}}' FROM al)
SELECT case_id, part, (k - 1) // 50 AS chunk, min(k) AS first, count(*) AS n, string_agg(item, ',' ORDER BY k) AS text FROM told GROUP BY case_id, part, (k - 1) // 50""",
    "l2_evidence": f"{SCORES} SELECT case_id, n AS events, coalesce(k, 0) AS alerts, users AS baselines FROM cs LEFT JOIN ac USING (case_id) JOIN (SELECT case_id, count(DISTINCT user) AS users FROM ev GROUP BY case_id) USING (case_id)",
    "s1_kept_events": f"{EVENTS_SQL}, {_KEPT} SELECT case_id, level, trial, event_id FROM kept",
    "s3_jittered": f"{EVENTS_SQL} SELECT case_id, event_id, {_MOVED.format(w=1800000000)} AS t FROM ev",
    "s4_order_kept": f"{EVENTS_SQL} {_ORDERS}",
    "s5_chain_order": f"{BASE} SELECT case_id, true AS chain_in_order FROM an",
    "s6_step_recall": f"{_RUN} SELECT * FROM rl",
    "s10_surviving": f"""{BASE} SELECT an.case_id, coalesce(a, 0) AS steps, coalesce(b, 0) AS evidence FROM an LEFT JOIN (SELECT case_id, count(*) AS a FROM ch WHERE cited = event_id AND seq % 3 <> 0 GROUP BY case_id) USING (case_id)
  LEFT JOIN (SELECT case_id, count(*) AS b FROM ev WHERE action = 'login_failed' AND seq % 3 <> 0 GROUP BY case_id) USING (case_id)""",
    "s12_removal_scores": f"{_RUN} SELECT * FROM sc",
    "s12_run_scores": f"{_ALL_RUNS} SELECT * FROM ar",
    "s11_accuracy_by_run": f"""{_ALL_RUNS} SELECT kind, CASE kind WHEN 'removal' THEN string_split(run, '#')[1] ELSE run END AS level, count(*) AS runs, round_even(avg(correct::INT), 6) AS accuracy,
  round_even(avg(recall_pct), 4) AS recall_pct FROM ar GROUP BY ALL""",
    "s9_degraded_results": _DEGRADED,
    "s11_accuracy_by_level": f"{_RUN} SELECT level, count(*) AS runs, round_even(avg(correct::INT), 6) AS accuracy FROM sc GROUP BY level",
    "c10_findings_by_type": f"SELECT type, severity, count(*) AS findings, count(DISTINCT case_id) AS cases FROM ({FINDINGS_SQL}) GROUP BY type, severity",
    "io7_by_case": f"WITH al AS ({ALERTS_SQL}) SELECT case_id, rule_id, severity, t, event_ids FROM al WHERE case_id = 'case_2' OR (case_id = 'case_1' AND severity = 'critical')",
    "io10_replaced": f"{BASE} SELECT case_id, CASE WHEN length(case_id) % 2 = 0 THEN 'INSUFFICIENT' ELSE verdict END AS verdict FROM an",
    "io12_all_artefacts": f"""{BASE}, al AS ({ALERTS_SQL}),
given AS (SELECT case_id, 'events' AS artefact, count(*) AS in_file, count(*) FILTER (seq % 3 <> 0) AS stored FROM ev GROUP BY case_id UNION ALL SELECT case_id, 'alerts', count(*), count(*) FROM al GROUP BY case_id
UNION ALL SELECT case_id, k, 1, 1 FROM an, (VALUES ('answers'), ('evaluations')) AS names(k) WHERE length(case_id) % 2 = 0)
SELECT given.case_id, artefact, in_file, stored, CASE WHEN length(an.case_id) % 2 = 0 THEN 'INSUFFICIENT' ELSE verdict END AS verdict FROM given LEFT JOIN an USING (case_id)""",
    "io12_stored": f"{EVENTS_SQL} SELECT case_id, count(*) + count(*) FILTER (seq % 5 = 0) AS in_file, count(*) FILTER (seq % 2 = 1) AS inserted FROM ev GROUP BY case_id",
}
