"""Queries of the answer checks and scores, over answers and truths that are derived from the driver's events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import claims as C
from ..operators import evaluate as E
from ..operators import measures as M
from ..operators import rules
from ..sources.driver import EVENTS_SQL, events
from ..sources.store import written
from .queries import ALERTS_SQL, alerts, intervals

STEPS = ("privilege_escalation", "log_deletion", "bulk_file_download", "logout")


def _case_number():
    return F.regexp_extract("case_id", r"\d+", 0).cast("long")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each case: its privilege changes and log deletions not quite in order, some without or with a false
    id, and claims of times, volumes and names of which some are wrong."""
    ev = events(spark, sf_dir)
    told = F.when(F.col("seq") % 11 == 0, F.lit(None)).when(F.col("seq") % 13 == 0, F.concat(F.lit("evt_x"), "seq")).otherwise(F.col("event_id"))
    step = F.when(F.col("action").isin("privilege_change", "log_delete"), F.struct((F.col("seq") % 5).alias("r"), "seq", told.alias("event_id"), F.regexp_replace("action", "_", " ").alias("d")))
    rows = ev.groupBy("case_id").agg(
        F.array_sort(F.collect_list(step)).alias("c"), F.array_sort(F.collect_list(F.when(F.col("action") == "login_failed", F.col("event_id")))).alias("evidence_for"), F.min("user").alias("u"),
        F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("t", "seq")).alias("first"), F.count_if(F.col("action") == "file_download").alias("dl"),
    )
    q = lambda x: F.pmod(x["seq"], F.lit(4))
    more = lambda x: F.when(q(x) == 0, F.concat(F.lit(" shortly after "), "first")).when(q(x) == 1, F.concat(F.lit(" 30 minutes after "), "first", F.lit(" near 10.9.9.9"))).when(q(x) == 2, F.lit(", a total of 5 MB by user_7")).otherwise("")
    chain = F.transform("c", lambda x, i: F.struct((i + 1).alias("step"), x["event_id"].alias("event_id"), F.concat(x["d"], more(x)).alias("description")))
    suspect = F.when(F.col("n") % 4 == 0, "user_none").otherwise(F.col("u"))
    files = F.concat(F.lit(" downloaded "), (F.col("dl") + F.col("n") % 3).cast("string"), F.lit(" files ("), (F.col("n") % 4 + 1).cast("string"), F.lit(" MB) over 30 days from 10.0.0.99 and /data/x"))
    narrative = F.concat(suspect, F.when(F.col("n") % 2 == 0, " and user_99999999, see evt_1,").otherwise(""), files)
    verdict = F.when(F.col("n") % 3 == 0, "NO").otherwise("YES")
    gaps = F.when(F.col("n") % 2 == 0, F.array(F.lit("no endpoint logs"))).otherwise(F.array().cast("array<string>"))
    return rows.select("case_id", verdict.alias("verdict"), F.lit("HIGH").alias("confidence"), suspect.alias("suspect"), chain.alias("attack_chain"), "evidence_for", F.array().cast("array<string>").alias("evidence_against"), gaps.alias("gaps"), narrative.alias("narrative"), F.lit("mock").alias("source"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, label, attack_steps and challenge of each case."""
    benign = _case_number() % 3 == 0
    cases = events(spark, sf_dir).select("case_id").distinct()
    return cases.select("case_id", F.concat(F.lit("Case "), _case_number()).alias("name"), F.when(benign, "BENIGN").otherwise("ATTACK").alias("label"), F.when(benign, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, STEPS))).alias("attack_steps"), F.lit("few events").alias("challenge"))


def results(spark: SparkSession, d: str) -> DataFrame:
    return rules.rule_results(intervals(spark, d), events(spark, d))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    found = results(spark, d).select("case_id", F.col("verdict").alias("rule_verdict"))
    return truth(spark, d).join(found, "case_id").join(answers(spark, d).select("case_id", F.col("verdict").alias("llm_verdict")), "case_id")


def parsed(spark: SparkSession, d: str) -> DataFrame:
    """Answers written as text, bare, fenced, among words or broken, and parsed again."""
    body, n = F.to_json(F.struct("verdict", "suspect", "attack_chain", "evidence_for", "narrative")), _case_number() % 4
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 1, F.concat(F.lit("So: "), body, F.lit(" Done."))).when(n == 2, body).otherwise(F.lit("{broken"))
    return A.parse(answers(spark, d).select("case_id", raw.alias("raw"))).select("case_id", "parse_failed", "verdict", "suspect", F.size("attack_chain").cast("long").alias("steps"))


def evaluations(spark: SparkSession, d: str, found: DataFrame | None = None) -> DataFrame:
    """The evaluation row of every case. Alerts and answers are written once, as several parts read them."""
    an, found = written(answers(spark, d)), written(intervals(spark, d)) if found is None else found
    return M.evaluation(written(truth(spark, d)), found, an, events(spark, d))


def f1_scores(spark: SparkSession, d: str) -> DataFrame:
    both = E.rule_scores(truth(spark, d), alerts(spark, d))
    return both.select("case_id", F.bround("rule_recall", 4).alias("rule_recall"), E.f1(F.col("rule_precision"), F.col("rule_recall")).alias("f1"))


QUERIES = {
    "l1_parsed": parsed,
    "h1_event_references": lambda s, d: A.event_references(answers(s, d), events(s, d)),
    "h2_timeline": lambda s, d: A.timeline_correctness(answers(s, d), events(s, d)),
    "h3_unsupported": lambda s, d: A.unsupported_claims(answers(s, d)),
    "h4_actors": lambda s, d: A.actor_references(answers(s, d), events(s, d)),
    "h5_temporal_claims": lambda s, d: C.temporal_claims(answers(s, d), events(s, d)),
    "h6_volume_claims": lambda s, d: C.volume_claims(answers(s, d), events(s, d)),
    "h9_unknown_entities": lambda s, d: C.unknown_entities(answers(s, d), events(s, d)),
    "h_report": lambda s, d: M.report(written(answers(s, d)), events(s, d)),
    "e1_verdicts": lambda s, d: E.verdict_accuracy(verdicts(s, d)),
    "e2_recall": lambda s, d: E.recall(truth(s, d), E.chain_texts(answers(s, d))),
    "e3_false_positives": lambda s, d: E.false_positives(truth(s, d), alerts(s, d), events(s, d), answers(s, d)),
    "e4_answer_quality": lambda s, d: E.answer_quality(M.report(written(answers(s, d)), events(s, d))),
    "e5_precision": lambda s, d: E.rule_precision(truth(s, d), alerts(s, d)).join(E.answer_precision(truth(s, d), answers(s, d)), "case_id"),
    "e6_f1": f1_scores,
    "e8_time_to_detect": lambda s, d: E.time_to_detect(truth(s, d), alerts(s, d), answers(s, d), events(s, d)),
    "e9_rule_breakdown": lambda s, d: E.rule_breakdown(truth(s, d), alerts(s, d)),
    "e10_evaluation": lambda s, d: evaluations(s, d).drop(*M.ALERTS),
    "e10_with_rules": lambda s, d: evaluations(s, d).withColumn("rule_breakdown", M.breakdown_text()),
    "e11_comparison": lambda s, d: E.comparison(evaluations(s, d)),
}

QUERIES |= {
    "h9_unknown_users": lambda s, d: C.unknown_entities(answers(s, d), events(s, d)).where("type = 'user'").select("case_id", F.col("value").alias("user")),
    "e5_rule_precision": lambda s, d: E.rule_precision(truth(s, d), alerts(s, d)),
} | {f"{k}_all_rules": QUERIES[k] for k in ("e1_verdicts", "e3_false_positives", "e6_f1", "e9_rule_breakdown")}  # names of before

BASE = f"""{EVENTS_SQL}, cs AS (SELECT case_id, count(*) AS n, min(user) AS u, arg_min(event_id, t) AS first, count(*) FILTER (action = 'file_download') AS dl,
  cast(coalesce(sum(bytes) FILTER (action = 'file_download'), 0) AS BIGINT) AS total_bytes, max(t) - min(t) AS span, cast(substr(case_id, 6) AS BIGINT) AS number FROM ev GROUP BY case_id),
ch AS (SELECT ev.case_id, seq, event_id, t, row_number() OVER (PARTITION BY ev.case_id ORDER BY seq % 5, seq) AS pos, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 13 = 0 THEN 'evt_x' || seq ELSE event_id END AS cited,
  replace(action, '_', ' ') || CASE seq % 4 WHEN 0 THEN ' shortly after ' || first WHEN 1 THEN ' 30 minutes after ' || first || ' near 10.9.9.9' WHEN 2 THEN ', a total of 5 MB by user_7' ELSE '' END AS description
  FROM ev JOIN cs USING (case_id) WHERE action IN ('privilege_change', 'log_delete')),
cc AS (SELECT case_id, count(*) AS steps, count(*) FILTER (coalesce(cited, '') <> '') AS good, string_agg(description, ' ' ORDER BY pos) AS chain FROM ch GROUP BY case_id),
an AS (SELECT *, CASE WHEN n % 4 = 0 THEN 'user_none' ELSE u END AS suspect, CASE WHEN n % 3 = 0 THEN 'NO' ELSE 'YES' END AS verdict,
  CASE WHEN n % 4 = 0 THEN 'user_none' ELSE u END || CASE WHEN n % 2 = 0 THEN ' and user_99999999, see evt_1,' ELSE '' END || ' downloaded ' || (dl + n % 3) || ' files (' || (n % 4 + 1) || ' MB) over 30 days from 10.0.0.99 and /data/x' AS narrative,
  number % 3 = 0 AS benign FROM cs LEFT JOIN cc USING (case_id)),
ci AS (SELECT case_id, cited AS event_id FROM ch WHERE cited IS NOT NULL UNION ALL SELECT case_id, event_id FROM ev WHERE action = 'login_failed'),
h1 AS (SELECT an.case_id, count(c.event_id) AS total_references, count(c.event_id) FILTER (e.event_id IS NULL) AS invalid_references, count(DISTINCT c.event_id) FILTER (e.event_id IS NULL) AS distinct_invalid
  FROM an LEFT JOIN ci c USING (case_id) LEFT JOIN ev e ON e.case_id = c.case_id AND e.event_id = c.event_id GROUP BY an.case_id),
lt AS (SELECT case_id, count(*) FILTER (t < before) AS late FROM (SELECT case_id, t, lag(t) OVER (PARTITION BY case_id ORDER BY pos) AS before FROM ch WHERE cited = event_id) GROUP BY case_id),
h2 AS (SELECT case_id, coalesce(steps, 0) AS chain_length, coalesce(late, 0) AS out_of_order, coalesce(late, 0) = 0 AS chronologically_correct FROM an LEFT JOIN lt USING (case_id)),
h3 AS (SELECT case_id, coalesce(steps, 0) + 1 AS total_claims, coalesce(steps, 0) + 1 - coalesce(good, 0) - (n % 2 = 0)::INT AS unsupported_claims,
  round_even(100.0 * (coalesce(good, 0) + (n % 2 = 0)::INT) / (coalesce(steps, 0) + 1)::DOUBLE, 2) AS evidence_grounding FROM an),
tx AS (SELECT case_id, pos, cited AS own, description AS text FROM ch UNION ALL SELECT case_id, NULL, NULL, narrative FROM an),
tc AS (SELECT case_id, coalesce(pos, -1) AS p, unnest(list_concat(regexp_extract_all(text, '(?i)\\d+\\s*(?:minutes?|hours?|seconds?)\\s*(?:after|before|later|of)'),
  regexp_extract_all(text, '(?i)within\\s+\\d+\\s*(?:minutes?|hours?|seconds?)'), regexp_extract_all(text, '(?i)shortly\\s+after'))) AS claim FROM tx),
ti AS (SELECT case_id, coalesce(pos, -1) AS p, unnest(CASE WHEN pos IS NULL THEN regexp_extract_all(text, 'evt_\\w+') ELSE list_distinct(list_concat(regexp_extract_all(text, 'evt_\\w+'), [own])) END) AS event_id FROM tx),
tg AS (SELECT ti.case_id, p, count(*) AS k, (max(t) - min(t)) / 6e7 AS gap FROM ti JOIN ev ON ti.case_id = ev.case_id AND ti.event_id = ev.event_id GROUP BY ti.case_id, p),
te AS (SELECT tc.case_id, coalesce(k >= 2 AND CASE WHEN lower(claim) LIKE 'shortly%' THEN gap > 15 ELSE abs(gap - cast(regexp_extract(claim, '\\d+') AS DOUBLE) * CASE WHEN claim LIKE '%hour%' THEN 60 WHEN claim LIKE '%second%' THEN 1 / 60 ELSE 1 END) > 5 END, false) AS wrong
  FROM tc LEFT JOIN tg ON tc.case_id = tg.case_id AND tc.p = tg.p),
h5 AS (SELECT an.case_id, count(wrong) AS temporal_claims, count(*) FILTER (wrong) AS temporal_errors FROM an LEFT JOIN te USING (case_id) GROUP BY an.case_id),
vf AS (SELECT case_id, unnest(regexp_extract_all(text, '(?i)\\d+\\s*(?:files?|documents?)')) AS claim FROM tx WHERE contains(lower(text), 'download')),
vs AS (SELECT case_id, unnest(regexp_extract_all(text, '(?i)\\d+(?:\\.\\d+)?\\s*(?:bytes?|KB|MB|GB)')) AS claim FROM tx WHERE pos IS NULL OR contains(lower(text), 'total')),
vt AS (SELECT case_id, unnest(regexp_extract_all(text, '(?i)(?:over|within|in|across)\\s+\\d+\\s*(?:minutes?|hours?|days?|weeks?)')) AS claim FROM tx),
f6 AS (SELECT case_id, count(*) AS a, count(*) FILTER (abs(cast(regexp_extract(claim, '\\d+') AS BIGINT) - dl) > 1) AS b FROM vf JOIN cs USING (case_id) GROUP BY case_id),
s7 AS (SELECT case_id, count(*) AS a, count(*) FILTER (m > 2 * total_bytes OR m < 0.5 * total_bytes) AS b FROM (SELECT case_id, total_bytes, cast(regexp_extract(claim, '\\d+') AS DOUBLE) * 1048576 AS m FROM vs JOIN cs USING (case_id) WHERE total_bytes > 0) GROUP BY case_id),
p8 AS (SELECT case_id, count(*) AS a, count(*) FILTER (abs(span - cast(regexp_extract(claim, '\\d+') AS BIGINT) * 86400000000) > 86400000000) AS b FROM vt JOIN cs USING (case_id) GROUP BY case_id),
h6 AS (SELECT an.case_id, coalesce(f6.a, 0) AS file_claims, coalesce(f6.b, 0) AS file_errors, coalesce(s7.a, 0) AS size_claims, coalesce(s7.b, 0) AS size_errors, coalesce(p8.a, 0) AS span_claims, coalesce(p8.b, 0) AS span_errors
  FROM an LEFT JOIN f6 USING (case_id) LEFT JOIN s7 USING (case_id) LEFT JOIN p8 USING (case_id)),
en AS (SELECT DISTINCT case_id, 'user' AS type, unnest(regexp_extract_all(text, '\\buser_\\d+\\b')) AS value FROM tx UNION SELECT case_id, 'ip_address', unnest(regexp_extract_all(text, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) FROM tx
  UNION SELECT case_id, 'file_path', unnest(regexp_extract_all(text, '/(?:data|var|etc|tmp|home|opt)/[\\w./\\-]+')) FROM tx),
h9 AS (SELECT en.case_id, type, value FROM en WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.case_id = en.case_id AND
  CASE type WHEN 'user' THEN ev.user = value WHEN 'ip_address' THEN ev.source_ip = value ELSE ev.resource <> '' AND (starts_with(ev.resource, value) OR starts_with(value, ev.resource)) END)),
h9n AS (SELECT case_id, count(*) AS unknown_entities FROM h9 GROUP BY case_id),
hr AS (SELECT h1.case_id, invalid_references, out_of_order, unsupported_claims, temporal_errors, file_errors, size_errors, span_errors, coalesce(unknown_entities, 0) AS unknown_entities, evidence_grounding, chronologically_correct
  FROM h1 JOIN h2 USING (case_id) JOIN h3 USING (case_id) JOIN h5 USING (case_id) JOIN h6 USING (case_id) LEFT JOIN h9n USING (case_id)),
hh AS (SELECT *, invalid_references + out_of_order + unsupported_claims + temporal_errors + file_errors + size_errors + span_errors + unknown_entities AS hallucination_count FROM hr),
kw AS (SELECT * FROM (VALUES ('privilege_escalation', 'privilege'), ('privilege_escalation', 'escalat'), ('log_deletion', 'log delet'), ('log_deletion', 'log removal'), ('log_deletion', 'anti-forensic'), ('log_deletion', 'deleted'),
  ('bulk_file_download', 'bulk'), ('bulk_file_download', 'download'), ('bulk_file_download', 'exfiltrat'), ('logout', 'logout'), ('logout', 'logged out'), ('logout', 'session end')) AS v(step, word)),
st AS (SELECT DISTINCT case_id, step FROM an, kw WHERE NOT benign)"""
SCORES = f"""{BASE}, al AS ({ALERTS_SQL}),
am AS (SELECT al.*, EXISTS (SELECT 1 FROM kw WHERE NOT benign AND contains(lower(description || ' ' || rule_name), word)) AS match FROM al JOIN an USING (case_id)),
ac AS (SELECT case_id, count(*) AS k, count(*) FILTER (match) AS m, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'warning') AS warn, min(t) AS first_alert, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS fired FROM am GROUP BY case_id),
x1 AS (SELECT case_id, label, rule_mapped, llm_mapped, rule_mapped = label AS rule_correct, llm_mapped = label AS llm_correct FROM (SELECT case_id, CASE WHEN benign THEN 'BENIGN' ELSE 'ATTACK' END AS label,
  CASE WHEN crit > 0 THEN 'ATTACK' ELSE 'BENIGN' END AS rule_mapped, CASE verdict WHEN 'YES' THEN 'ATTACK' ELSE 'BENIGN' END AS llm_mapped FROM an LEFT JOIN ac USING (case_id))),
sd AS (SELECT st.case_id, st.step, bool_or(contains(lower(coalesce(chain, '')), word)) AS told FROM st JOIN kw ON st.step = kw.step JOIN an ON an.case_id = st.case_id GROUP BY st.case_id, st.step),
x2 AS (SELECT an.case_id, count(step) AS total_steps, count(*) FILTER (told) AS detected_steps, CASE WHEN count(step) = 0 THEN 100.0 ELSE round_even(100.0 * count(*) FILTER (told) / count(step)::DOUBLE, 2) END AS recall_pct,
  coalesce(string_agg(CASE WHEN NOT told THEN step END, ',' ORDER BY step), '') AS missed_steps FROM an LEFT JOIN sd USING (case_id) GROUP BY an.case_id),
x3 AS (SELECT case_id, CASE WHEN benign THEN coalesce(k, 0) ELSE 0 END AS rule_fp_count, benign AND verdict = 'YES' AS llm_fp, round_even(CASE WHEN benign THEN 100.0 * coalesce(k, 0) / n::DOUBLE ELSE 0 END, 2) AS false_positive_rate_pct FROM an LEFT JOIN ac USING (case_id)),
cm AS (SELECT case_id, count(*) AS k, count(*) FILTER (EXISTS (SELECT 1 FROM kw WHERE contains(lower(description), word))) AS m FROM ch GROUP BY case_id),
rr AS (SELECT st.case_id, avg(EXISTS (SELECT 1 FROM al JOIN kw ON kw.step = st.step AND contains(lower(description || ' ' || rule_name), word) WHERE al.case_id = st.case_id)::INT) AS rule_recall FROM st GROUP BY st.case_id),
x5 AS (SELECT an.case_id, CASE WHEN NOT benign THEN round_even(ac.m / ac.k::DOUBLE, 4) END AS rule_precision, CASE WHEN NOT benign THEN round_even(cm.m / cm.k::DOUBLE, 4) END AS llm_precision
  FROM an LEFT JOIN ac USING (case_id) LEFT JOIN cm USING (case_id)),
fa AS (SELECT ev.case_id, coalesce(min(t) FILTER (EXISTS (SELECT 1 FROM kw WHERE contains(lower(action || ' ' || coalesce(resource, '') || ' ' || status || ' '), word))), min(t)) AS start FROM ev JOIN an USING (case_id) WHERE NOT benign GROUP BY ev.case_id),
fc AS (SELECT case_id, min(t) AS cited_at FROM ch WHERE cited = event_id GROUP BY case_id),
x8 AS (SELECT an.case_id, round_even((first_alert - start) / 1e6, 2) AS rule_seconds, round_even((cited_at - start) / 1e6, 2) AS llm_seconds FROM an LEFT JOIN fa USING (case_id) LEFT JOIN ac USING (case_id) LEFT JOIN fc USING (case_id)),
x10 AS (SELECT an.case_id, 'Case ' || number AS case_name, label, CASE WHEN k IS NULL THEN 'no_alert' WHEN crit > 0 THEN 'attack' ELSE 'suspicious' END AS rule_verdict, an.verdict AS llm_verdict, 'HIGH' AS llm_confidence, true AS is_mock,
  rule_mapped, llm_mapped, rule_correct, llm_correct, total_steps, detected_steps, CASE WHEN benign THEN NULL ELSE recall_pct END AS recall_pct, missed_steps, rule_fp_count, llm_fp, false_positive_rate_pct, rule_precision, llm_precision,
  CASE WHEN rule_precision + rule_recall > 0 THEN round_even(2 * rule_precision * rule_recall / (rule_precision + rule_recall), 4) ELSE 0.0::DOUBLE END AS rule_f1,
  CASE WHEN llm_precision + recall_pct > 0 THEN round_even(2 * llm_precision * (recall_pct / 100) / (llm_precision + recall_pct / 100), 4) ELSE 0.0::DOUBLE END AS llm_f1,
  rule_seconds, llm_seconds, hallucination_count, evidence_grounding AS evidence_grounding_pct, chronologically_correct AS timeline_correct, coalesce(k, 0) AS alert_count, coalesce(crit, 0) AS criticals, coalesce(warn, 0) AS warnings, coalesce(fired, '') AS rules_triggered
  FROM an JOIN x1 USING (case_id) JOIN x2 USING (case_id) JOIN x3 USING (case_id) JOIN x5 USING (case_id) JOIN x8 USING (case_id) JOIN hh USING (case_id) LEFT JOIN rr USING (case_id) LEFT JOIN ac USING (case_id))"""
SQL = {
    "l1_parsed": f"{BASE} SELECT case_id, number % 4 = 3 AS parse_failed, CASE WHEN number % 4 < 3 THEN verdict END AS verdict, CASE WHEN number % 4 < 3 THEN suspect END AS suspect, CASE WHEN number % 4 < 3 THEN coalesce(steps, 0) END AS steps FROM an",
    "h1_event_references": f"{BASE} SELECT * FROM h1",
    "h2_timeline": f"{BASE} SELECT * FROM h2",
    "h3_unsupported": f"{BASE} SELECT * FROM h3",
    "h4_actors": f"""{BASE} SELECT an.case_id, suspect, EXISTS (SELECT 1 FROM ev WHERE ev.case_id = an.case_id AND ev.user = suspect) AS suspect_in_events, actors
FROM an JOIN (SELECT case_id, string_agg(DISTINCT user, ',' ORDER BY user) AS actors FROM ev GROUP BY case_id) USING (case_id)""",
    "h5_temporal_claims": f"{BASE} SELECT * FROM h5",
    "h6_volume_claims": f"{BASE} SELECT * FROM h6",
    "h9_unknown_entities": f"{BASE} SELECT * FROM h9",
    "h_report": f"{BASE} SELECT *, hallucination_count = 0 AS clean FROM hh",
    "e1_verdicts": f"{SCORES} SELECT * FROM x1",
    "e2_recall": f"{SCORES} SELECT * FROM x2",
    "e3_false_positives": f"{SCORES} SELECT * FROM x3",
    "e4_answer_quality": f"{BASE} SELECT case_id, hallucination_count, evidence_grounding AS evidence_grounding_pct, chronologically_correct AS timeline_correct FROM hh",
    "e5_precision": f"{SCORES} SELECT * FROM x5",
    "e6_f1": f"""{SCORES} SELECT case_id, round_even(rule_recall, 4) AS rule_recall, CASE WHEN rule_precision + rule_recall > 0 THEN round_even(2 * rule_precision * rule_recall / (rule_precision + rule_recall), 4) ELSE 0.0::DOUBLE END AS f1
FROM x5 LEFT JOIN rr USING (case_id)""",
    "e8_time_to_detect": f"{SCORES} SELECT * FROM x8",
    "e9_rule_breakdown": f"{SCORES} SELECT case_id, rule_id, count(*) AS alert_count, bool_or(match) AS contributed FROM am GROUP BY case_id, rule_id",
    "e10_evaluation": f"{SCORES} SELECT * EXCLUDE (alert_count, criticals, warnings, rules_triggered) FROM x10",
    "e10_with_rules": f"""{SCORES}, rb AS (SELECT case_id, string_agg(rule_id || ' ' || k || CASE WHEN told THEN ' told' ELSE '' END, ', ' ORDER BY rule_id) AS rule_breakdown
  FROM (SELECT case_id, rule_id, count(*) AS k, bool_or(match) AS told FROM am GROUP BY case_id, rule_id) GROUP BY case_id)
SELECT x10.* EXCLUDE (rules_triggered), coalesce(rule_breakdown, '') AS rule_breakdown FROM x10 LEFT JOIN rb USING (case_id)""",
    "e11_comparison": f"""{SCORES} SELECT case_id, case_name, label, rule_verdict || CASE WHEN rule_correct THEN ' [OK]' ELSE ' [X]' END AS rule, llm_verdict || CASE WHEN llm_correct THEN ' [OK]' ELSE ' [X]' END AS llm, recall_pct, rule_f1, llm_f1, rule_fp_count,
  hallucination_count, 'Mock' || CASE WHEN rule_correct THEN '' ELSE '; Rule wrong' END || CASE WHEN llm_correct THEN '' ELSE '; LLM wrong' END || CASE WHEN missed_steps = '' THEN '' ELSE '; Missed: ' || replace(missed_steps, ',', ', ') END
  || CASE WHEN timeline_correct THEN '' ELSE '; Timeline err' END AS notes FROM x10""",
}
SQL |= {
    "h9_unknown_users": f"{BASE} SELECT case_id, value AS user FROM h9 WHERE type = 'user'",
    "e5_rule_precision": f"{SCORES} SELECT case_id, rule_precision FROM x5",
} | {f"{k}_all_rules": SQL[k] for k in ("e1_verdicts", "e3_false_positives", "e6_f1", "e9_rule_breakdown")}
QUERIES["e5_rule_precision_all_rules"], SQL["e5_rule_precision_all_rules"] = QUERIES["e5_rule_precision"], SQL["e5_rule_precision"]
