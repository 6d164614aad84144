"""Registered queries over the driver's events, and their SQL, which states every constant by itself.

The rules' windows are wide, as the events are sparse; queries named _default keep the rules' own windows and run over
the same events in compressed time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlate, reports, rules, runs, timeline
from ..operators.windows import DAY
from ..sources.driver import EVENTS_SQL, baselines, dense_events, events
from ..sources.store import written

PARAMS = {"R004": {"width": 10 * DAY}, "R007": {"width": 2 * DAY}, "R008": {"width": 5 * DAY}, "R009": {"width": 10 * DAY, "threshold": 3}, "R011": {"width": 5 * DAY}, "R012": {"width": DAY}}
DENSE = {"R009": {"threshold": 3}}
CORRELATE = {"unusual_volume": {"width": 2 * DAY}, "privilege_then_download": {"width": 5 * DAY}, "new_access_after_privilege": {"width": 5 * DAY}}


def _rule(rule: str) -> Callable:
    return lambda spark, d: rules.one_rule(rule, events(spark, d), baselines(spark, d), **PARAMS.get(rule, {})).drop("timestamp")


def _default_rule(rule: str) -> Callable:
    return lambda spark, d: rules.one_rule(rule, dense_events(spark, d), baselines(spark, d), **DENSE.get(rule, {})).drop("timestamp")


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return rules.run_rules(events(spark, d), baselines(spark, d), PARAMS)


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """The same alerts with their first and last event in the place of all ids."""
    return rules.run_rules(events(spark, d), baselines(spark, d), PARAMS, ids=False)


def _row_sql(rule: str, name: str, severity: str, text: str, where: str) -> str:
    return f"""{EVENTS_SQL} SELECT case_id, '{rule}' AS rule_id, '{name}' AS rule_name, '{severity}' AS severity, user, t, event_id AS event_ids, {text} AS description
FROM ev LEFT JOIN bl USING (user) WHERE {where}"""


def _list(order: str, of: str = "event_id") -> str:
    return f"string_agg({of}, ',' ORDER BY {order})"


def _sliding_sql(rule: str, name: str, severity: str, text: str, where: str, keys: str, minutes: int, hit: str, weight: str = "1", user: str = "a.user", table: str = "ev") -> str:
    names, width = keys.split(", "), minutes * 60000000
    return f"""{EVENTS_SQL}, q AS (SELECT *, coalesce(resource, '') AS domain FROM {table} WHERE {where}),
n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t, seq) AS rn FROM q),
m AS (SELECT *, max(rn) OVER w AS last FROM n WINDOW w AS (PARTITION BY {keys} ORDER BY t RANGE BETWEEN CURRENT ROW AND {width} FOLLOWING)),
l AS (SELECT a.*, last - rn + 1 AS n, (SELECT sum({weight}) FROM n b WHERE {" AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in names)} AND b.rn BETWEEN a.rn AND a.last) AS total FROM m a),
h AS (SELECT *, ({hit}) AS hit FROM l),
s AS (SELECT *, max(CASE WHEN hit THEN last END) OVER (PARTITION BY {keys} ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
f AS (SELECT * FROM s WHERE hit AND last > coalesce(before, 0))
SELECT a.case_id, '{rule}' AS rule_id, '{name}' AS rule_name, '{severity}' AS severity, {user} AS user, a.t, {_list("b.rn", "b.event_id")} AS event_ids, any_value({text.replace("MINUTES", str(minutes))}) AS description
FROM f a JOIN n b ON {" AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in names)} AND b.rn BETWEEN a.rn AND a.last
GROUP BY {", ".join(dict.fromkeys(["a.case_id", *(f"a.{k}" for k in names), "a.t", "a.rn"]))}"""


def _r004(minutes: int, table: str = "ev") -> str:
    text = "'Bulk download detected: ' || a.n || ' files downloaded within MINUTES minutes (window start: ' || a.timestamp || ')'"
    return _sliding_sql("R004", "bulk_download", "critical", text, "action = 'file_download'", "case_id, user", minutes, "n > 5", table=table)


def _r007(minutes: int, table: str = "ev") -> str:
    text = "'Failed login spike: ' || a.n || ' failures within MINUTES minutes for ' || a.user || ' (window start: ' || a.timestamp || ')'"
    return _sliding_sql("R007", "failed_login_spike", "warning", text, "action = 'login_failed'", "case_id, user", minutes, "n >= 2", table=table)


def _r009(minutes: int, table: str = "ev") -> str:
    text = "'Possible DNS tunnel: ' || a.n || ' DNS queries to ' || a.domain || ' within MINUTES minutes (window start: ' || a.timestamp || ')'"
    return _sliding_sql("R009", "dns_tunnel_detection", "critical", text, "source_type = 'network' AND action = 'dns_query'", "case_id, domain", minutes, "n > 3", user="'N/A'", table=table)


def _r011(minutes: int, table: str = "ev") -> str:
    text = "'High data exfiltration volume: ' || cast(cast(round_even(a.total / 1048576::DOUBLE, 1) AS DECIMAL(20, 1)) AS VARCHAR) || ' MB transferred in MINUTES minutes (window start: ' || a.timestamp || ')'"
    return _sliding_sql("R011", "data_exfiltration_volume", "critical", text, "source_type = 'network' AND bytes > 0", "case_id", minutes, "total > 104857600", "bytes", user="'N/A'", table=table)


def _r012(minutes: int, table: str = "ev") -> str:
    return f"""{EVENTS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY case_id, user ORDER BY t, seq) AS rn FROM {table}
  WHERE user <> '' AND ((source_type = 'auth' AND action = 'login') OR (source_type = 'database' AND action = 'db_login') OR (source_type = 'web_server' AND action = 'http_request'))),
w AS (SELECT a.case_id, a.user, a.t, a.seq, any_value(a.timestamp) AS timestamp, list_sort(list(DISTINCT b.source_type)) AS kinds, {_list("b.rn", "b.event_id")} AS event_ids
  FROM q a JOIN q b ON a.case_id = b.case_id AND a.user = b.user AND b.rn >= a.rn AND b.t <= a.t + {minutes * 60000000} GROUP BY a.case_id, a.user, a.t, a.seq)
SELECT case_id, 'R012' AS rule_id, 'lateral_movement' AS rule_name, 'warning' AS severity, user, t, event_ids,
  'Lateral movement detected: ' || user || ' authenticated across [''' || array_to_string(kinds, ''', ''') || '''] within {minutes} minutes (window start: ' || timestamp || ')' AS description
FROM w WHERE len(kinds) >= 2 QUALIFY row_number() OVER (PARTITION BY case_id, user, t ORDER BY seq) = 1"""


def _after_sql(later: str, head: str, tail: str, minutes: int = 7200, table: str = "ev") -> str:
    return f"""{EVENTS_SQL}, d AS (SELECT * FROM {table} LEFT JOIN bl USING (user) WHERE {later})
SELECT c.case_id, {head}, c.user, c.event_id || ',' || string_agg(d.event_id, ',' ORDER BY d.t, d.seq) AS event_ids, {tail}
FROM {table} c JOIN d ON c.case_id = d.case_id AND c.user IS NOT DISTINCT FROM d.user AND d.t > c.t AND d.t <= c.t + {minutes * 60000000}
WHERE c.action = 'privilege_change' GROUP BY c.case_id, c.user, c.t, c.event_id, c.timestamp"""


def _r008(minutes: int, table: str = "ev") -> str:
    text = f"'Privilege escalation at ' || c.timestamp || ' followed by ' || count(*) || ' file download(s) within {minutes} minutes' AS description"
    return _after_sql("action = 'file_download'", "'R008' AS rule_id, 'privilege_then_download' AS rule_name, 'critical' AS severity, c.t", text, minutes, table)


def _find_sql(kind: str, severity: str, body: str, ids: str = "string_agg(event_id, ',' ORDER BY t, seq)") -> str:
    return f"{EVENTS_SQL} SELECT case_id, '{kind}' AS type, user, {ids} AS event_ids, '{severity}' AS severity FROM {body}"


def _volume_sql(minutes: int, table: str = "ev") -> str:
    return f"""{EVENTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY case_id, user ORDER BY t, seq) AS rn FROM {table}),
s AS (SELECT *, min(rn) OVER (PARTITION BY case_id, user ORDER BY t RANGE BETWEEN {minutes * 60000000} PRECEDING AND CURRENT ROW) AS start FROM n),
f AS (SELECT case_id, user, start, min(rn) AS last FROM s WHERE rn - start + 1 > 5 GROUP BY ALL)
SELECT f.case_id, 'unusual_volume' AS type, f.user, {_list("n.rn", "n.event_id")} AS event_ids, 'warning' AS severity
FROM f JOIN n ON f.case_id = n.case_id AND f.user = n.user AND n.rn BETWEEN f.start AND f.last GROUP BY f.case_id, f.user, f.start, f.last"""


SQL = {
    "r001": _row_sql("R001", "unusual_login_ip", "warning", "'Login from unusual IP ' || source_ip || '. Normal IPs: [''' || ip || ''']'", "action = 'login' AND source_ip <> ip"),
    "r002": _row_sql("R002", "off_hours_access", "warning", "printf('Activity at %02d:%02d outside normal hours (09:00-17:00)', local_minute // 60, local_minute % 60)", "local_minute NOT BETWEEN 540 AND 1020"),
    "r003": _row_sql("R003", "privilege_escalation", "critical", "'Privilege change detected for ' || user || '. Resource: ' || coalesce(resource, 'N/A')", "action = 'privilege_change'"),
    "r004": _r004(14400),
    "r005": _row_sql(
        "R005", "cross_department_access", "warning", "'Cross-department access: ' || resource || ' is outside normal directories [''' || directory || ''']'",
        "source_type = 'file_access' AND coalesce(resource, '') NOT IN ('', 'null', 'role') AND NOT starts_with(resource, directory)",
    ),
    "r006": _row_sql("R006", "log_deletion", "critical", "'Log deletion detected by ' || user || '. Target: ' || coalesce(resource, 'N/A')", "action = 'log_delete'"),
    "r007": _r007(2880),
    "r008": _r008(7200),
    "r009": _r009(14400),
    "r010": _row_sql(
        "R010", "sql_injection_attempt", "critical", "'Possible SQL injection: URL ' || resource || ' returned 500 and contains SQL keywords'",
        "source_type = 'web_server' AND status = '500' AND regexp_matches(resource, '(?i)(UNION|SELECT|DROP|--|OR\\s+1\\s*=\\s*1)')",
    ),
    "r011": _r011(7200),
    "r012": _r012(1440),
    "c1_credential_stuffing": f"""{EVENTS_SQL}, q AS (SELECT *, coalesce(sum((action = 'login')::INT) OVER (PARTITION BY case_id, user ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
FROM ev WHERE source_type = 'auth' AND action IN ('login', 'login_failed')) SELECT case_id, 'credential_stuffing' AS type, user, {_list("t, seq")} AS event_ids, 'critical' AS severity FROM q GROUP BY case_id, user, island
HAVING count(*) FILTER (action = 'login_failed') > 0 AND count(*) FILTER (action = 'login' AND status = 'success') > 0""",
    "c2_unusual_login_ip": _find_sql("unusual_login_ip", "warning", "ev JOIN bl USING (user) WHERE source_type = 'auth' AND action = 'login' AND status = 'success' AND source_ip <> ip", "event_id"),
    "c3_privilege_download": _after_sql("action = 'file_download'", "'privilege_escalation_then_download' AS type", "'critical' AS severity"),
    "c4_new_access": _after_sql("source_type = 'file_access' AND NOT starts_with(resource, directory)", "'new_resource_access_after_privilege_change' AS type", "'warning' AS severity"),
    "c5_after_hours": _find_sql("after_hours_activity", "warning", "ev WHERE local_minute NOT BETWEEN 540 AND 1020 GROUP BY case_id, user"),
    "c6_unusual_volume": _volume_sql(2880),
    "c6_default": _volume_sql(30, "dn"),
    "c7_cross_source": _find_sql("cross_source_activity", "info", "ev GROUP BY case_id, user HAVING count(DISTINCT source_type) >= 2", _list("source_type, t, seq")),
    "c8_session_gap": _find_sql("session_continuity_gap", "warning", """ev a WHERE source_type IN ('file_access', 'admin') AND session_id <> '' AND NOT EXISTS
(SELECT 1 FROM ev b WHERE b.case_id = a.case_id AND b.user = a.user AND b.session_id = a.session_id AND b.source_type = 'auth' AND b.action = 'login' AND b.status = 'success') GROUP BY case_id, user"""),
    "tl1_timeline": f"{EVENTS_SQL} SELECT case_id, event_id, row_number() OVER (PARTITION BY case_id ORDER BY t, seq) AS position FROM ev",
    "tl2_by_user": f"{EVENTS_SQL} SELECT case_id, coalesce(nullif(user, ''), 'unknown_user') AS user, count(*) AS n, {_list('t, seq')} AS event_ids FROM ev GROUP BY ALL",
    "tl3_by_session": f"{EVENTS_SQL} SELECT case_id, coalesce(nullif(session_id, ''), 'no_session') AS session_id, count(*) AS n, {_list('t, seq')} AS event_ids FROM ev GROUP BY ALL",
    "tl4_groups": f"""{EVENTS_SQL}, g AS (SELECT case_id, 'user' AS kind, coalesce(nullif(user, ''), 'unknown_user') AS name, event_id, t, seq FROM ev
UNION ALL SELECT case_id, 'session', coalesce(nullif(session_id, ''), 'no_session'), event_id, t, seq FROM ev)
SELECT case_id, kind, name, count(*) AS n, arg_min(event_id, (t, seq)) AS first_event, arg_max(event_id, (t, seq)) AS last_event FROM g GROUP BY ALL""",
    "tl4_summary": f"""{EVENTS_SQL} SELECT case_id, count(*) AS total_events, arg_min(timestamp, t) AS first, arg_max(timestamp, t) AS last, count(DISTINCT user) AS users,
count(DISTINCT coalesce(session_id, 'no_session')) AS sessions FROM ev GROUP BY case_id""",
    "x1_session_hijack": f"""{EVENTS_SQL} SELECT case_id, session_id, event_id, before, source_ip FROM (SELECT *, lag(source_ip) OVER (PARTITION BY case_id, session_id ORDER BY t, seq) AS before
FROM ev WHERE session_id IS NOT NULL) WHERE source_ip <> before""",
    "x2_low_and_slow": f"""{EVENTS_SQL}, q AS (SELECT case_id, user, substr(timestamp, 1, 10) AS day, count(*) AS n FROM ev JOIN bl USING (user)
WHERE action = 'file_download' AND NOT starts_with(resource, directory) GROUP BY ALL)
SELECT case_id, user, count(*) AS days, cast(sum(n) AS BIGINT) AS downloads, max(n) AS most FROM q GROUP BY case_id, user HAVING count(*) >= 2 AND max(n) <= 5""",
    "x3_failed_only": f"""{EVENTS_SQL}, w AS (SELECT case_id, user, max(t) AS won FROM ev WHERE action = 'login' AND status = 'success' GROUP BY ALL)
SELECT e.case_id, e.user, count(*) AS failures FROM ev e LEFT JOIN w ON e.case_id = w.case_id AND e.user = w.user WHERE action = 'login_failed' AND (won IS NULL OR t > won) GROUP BY ALL""",
    "x4_login_after_access": f"""{EVENTS_SQL} SELECT case_id, source_ip, min(t) FILTER (source_type IN ('file_access', 'database')) AS accessed, min(t) FILTER (action IN ('login', 'vpn_connect')) AS logged_in
FROM ev GROUP BY case_id, source_ip HAVING accessed < logged_in""",
    "d2_by_source": f"""{EVENTS_SQL}, c AS (SELECT source_type, count(*) AS n FROM ev GROUP BY source_type)
SELECT source_type, n, round(100.0 * n / (sum(n) OVER ())::DOUBLE, 4) AS percent, round(100.0 * n / (max(n) OVER ())::DOUBLE, 4) AS bar_width FROM c""",
    "s1_removal": f"""{EVENTS_SQL}, g AS (SELECT * FROM (VALUES (0, 1), (20, 1), (20, 2), (20, 3), (40, 1), (40, 2), (40, 3), (60, 1), (60, 2), (60, 3), (80, 1), (80, 2), (80, 3)) AS v(level, trial)),
c AS (SELECT case_id, count(*) AS n FROM ev GROUP BY case_id) SELECT case_id, level, trial, n - n * level // 100 AS events FROM c, g""",
}
SQL |= {"r004_default": _r004(30, "dn"), "r007_default": _r007(5, "dn"), "r008_default": _r008(30, "dn"), "r009_default": _r009(5, "dn"), "r011_default": _r011(30, "dn"), "r012_default": _r012(30, "dn")}
ALL_RULES = [f"r{k:03}" for k in range(1, 13)]
ALERTS_SQL = " UNION ALL ".join(f"SELECT case_id, rule_id, rule_name, severity, user, t, event_ids, description FROM ({SQL[k]})" for k in ALL_RULES)
FINDINGS = ["c1_credential_stuffing", "c2_unusual_login_ip", "c3_privilege_download", "c4_new_access", "c5_after_hours", "c6_unusual_volume", "c7_cross_source", "c8_session_gap"]
FINDINGS_SQL = " UNION ALL ".join(f"SELECT case_id, type, severity FROM ({SQL[k]})" for k in FINDINGS)
_RESULTS = f"""{EVENTS_SQL}, al AS ({ALERTS_SQL}), c AS (SELECT DISTINCT case_id FROM ev)
SELECT c.case_id, count(rule_id) AS alert_count, coalesce(string_agg(DISTINCT rule_id, ',' ORDER BY rule_id), '') AS rules_triggered, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'critical') AS criticals, CASE WHEN count(rule_id) = 0 THEN 'no_alert' WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'attack' ELSE 'suspicious' END AS verdict
FROM c LEFT JOIN al USING (case_id) GROUP BY c.case_id"""
SQL |= {
    "r13_ordered_alerts": f"""WITH al AS ({ALERTS_SQL}) SELECT case_id, rule_id, severity, t, event_ids, row_number() OVER (PARTITION BY case_id ORDER BY t, rule_id, event_ids) AS position FROM al""",
    "r13_alert_events": f"""{EVENTS_SQL}, al AS ({ALERTS_SQL}), x AS (SELECT case_id, rule_id, string_split(event_ids, ',')[1] AS first_event, unnest(string_split(event_ids, ',')) AS event_id
  FROM al WHERE severity = 'critical' OR rule_id IN ('R007', 'R012')) SELECT x.case_id, x.rule_id, x.first_event, ev.t, x.event_id FROM x JOIN ev ON x.case_id = ev.case_id AND x.event_id = ev.event_id""",
    "r13_intervals": f"""WITH al AS ({ALERTS_SQL}) SELECT case_id, rule_id, severity, user, t, description, string_split(event_ids, ',')[1] AS first_event, string_split(event_ids, ',')[-1] AS last_event,
  len(string_split(event_ids, ',')) AS n_events FROM al""",
    "r14_rule_results": _RESULTS,
    "c9_severity_summary": f"SELECT case_id, severity, count(*) AS findings FROM ({FINDINGS_SQL}) GROUP BY case_id, severity",
    "c10_totals": f"SELECT count(*) AS findings, count(DISTINCT case_id) AS cases FROM ({FINDINGS_SQL})",
}


def _chunks_sql(table: str, keys: str, order: str, size: int = 20) -> str:
    """Lists cut to rows of size events."""
    return f"""SELECT {keys}, (position - 1) // {size} AS chunk, min(position) AS first, count(*) AS n, string_agg(event_id, ',' ORDER BY position) AS event_ids
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS position FROM {table}) GROUP BY ALL"""


SQL |= {
    "tl2_user_chunks": f"{EVENTS_SQL} {_chunks_sql("(SELECT case_id, coalesce(nullif(user, ''), 'unknown_user') AS user, event_id, t, seq FROM ev)", 'case_id, user', 't, seq')}",
    "tl3_session_chunks": f"{EVENTS_SQL} {_chunks_sql("(SELECT case_id, coalesce(nullif(session_id, ''), 'no_session') AS session_id, event_id, t, seq FROM ev)", 'case_id, session_id', 't, seq')}",
    "c5_activity_chunks": f"""{EVENTS_SQL}, listed AS (
SELECT 'after_hours_activity' AS type, 'warning' AS severity, case_id, user, '' AS place, t, seq, event_id FROM ev WHERE local_minute NOT BETWEEN 540 AND 1020
UNION ALL SELECT 'cross_source_activity', 'info', case_id, user, source_type, t, seq, event_id FROM ev WHERE (case_id, user) IN (SELECT (case_id, user) FROM ev GROUP BY case_id, user HAVING count(DISTINCT source_type) >= 2)
UNION ALL SELECT 'session_continuity_gap', 'warning', case_id, user, '', t, seq, event_id FROM ev a WHERE source_type IN ('file_access', 'admin') AND session_id <> '' AND NOT EXISTS
(SELECT 1 FROM ev b WHERE b.case_id = a.case_id AND b.user = a.user AND b.session_id = a.session_id AND b.source_type = 'auth' AND b.action = 'login' AND b.status = 'success'))
{_chunks_sql('listed', 'case_id, type, user, severity', 'place, t, seq')}""",
}

_EV = lambda f: lambda spark, d: f(events(spark, d))
_EB = lambda f, **k: lambda spark, d: f(events(spark, d), baselines(spark, d), **k)


def findings(spark: SparkSession, d: str) -> DataFrame:
    return correlate.correlate(events(spark, d), baselines(spark, d), CORRELATE)


QUERIES = {f"r{k[1:]}": _rule(k) for k in rules.REGISTRY} | {f"r{k}_default": _default_rule(f"R{k}") for k in ("004", "007", "008", "009", "011", "012")} | {
    "r13_ordered_alerts": lambda spark, d: rules.ordered_alerts(alerts(spark, d)).select("case_id", "rule_id", "severity", "t", "event_ids", "position"),
    "r13_alert_events": lambda spark, d: rules.alert_events(written(intervals(spark, d)).where("severity = 'critical' OR rule_id IN ('R007', 'R012')"), events(spark, d), PARAMS),
    "r13_intervals": lambda spark, d: intervals(spark, d).drop("timestamp", "rule_name"),
    "r14_rule_results": lambda spark, d: rules.rule_results(intervals(spark, d), events(spark, d)),
    "c1_credential_stuffing": _EB(correlate.credential_stuffing), "c2_unusual_login_ip": _EB(correlate.unusual_login_ip),
    "c3_privilege_download": _EB(correlate.privilege_then_download, width=5 * DAY), "c4_new_access": _EB(correlate.new_access_after_privilege, width=5 * DAY),
    "c5_after_hours": _EB(correlate.after_hours), "c6_unusual_volume": _EB(correlate.unusual_volume, width=2 * DAY),
    "c6_default": lambda spark, d: correlate.unusual_volume(dense_events(spark, d), baselines(spark, d)),
    "c7_cross_source": _EB(correlate.cross_source), "c8_session_gap": _EB(correlate.session_gap),
    "c9_severity_summary": lambda spark, d: correlate.severity_summary(findings(spark, d)),
    "c10_totals": lambda spark, d: correlate.totals(findings(spark, d)),
    "tl1_timeline": _EV(lambda e: timeline.timeline(e).select("case_id", "event_id", "position")),
    "tl2_by_user": _EV(lambda e: timeline.grouped(e, "user", "unknown_user")), "tl3_by_session": _EV(lambda e: timeline.grouped(e, "session_id", "no_session")),
    "tl2_user_chunks": _EV(lambda e: timeline.grouped_chunks(e, "user", "unknown_user", 20)),
    "tl3_session_chunks": _EV(lambda e: timeline.grouped_chunks(e, "session_id", "no_session", 20)),
    "c5_activity_chunks": _EB(correlate.activity_chunks, size=20),
    "tl4_groups": _EV(timeline.groups), "tl4_summary": _EV(timeline.summary), "x1_session_hijack": _EV(correlate.session_hijack), "x2_low_and_slow": _EB(correlate.low_and_slow, days=2),
    "x3_failed_only": _EV(correlate.failed_only), "x4_login_after_access": _EV(correlate.login_after_access),
    "d2_by_source": _EV(reports.by_source), "s1_removal": _EV(lambda e: runs.unfolded(runs.with_runs(e.select("case_id", "event_id", "seq")), runs.grid()).groupBy("case_id", "level", "trial").agg(F.count(F.lit(1)).alias("events"))),
}
