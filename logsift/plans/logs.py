"""Queries of the normalisers and event mappings over raw rows that are derived from the driver's events, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize
from ..sources.driver import EVENTS_SQL, events

#: Raw columns of each log type as expressions over unified events, where they aren't null.
_FROM_EVENTS = {
    "auth": "action AS event_type, user AS username, source_ip AS ip_address, status AS result, session_id AS session",
    "file": "action AS event_type, user AS username, resource AS file_path, source_ip AS ip_address, status AS result, session_id AS session, bytes AS file_size_bytes",
    "admin": "action AS event_type, user AS username, resource AS target, cast(NULL AS string) AS detail, source_ip AS ip_address, status AS result",
    "network": "action AS event_type, 'tcp' AS protocol, source_ip AS src_ip, resource AS dst_ip, cast(NULL AS int) AS src_port, 0 AS dst_port, 'allowed' AS action, '' AS rule_name, bytes AS bytes_transferred",
    "db": "action AS event_type, user AS username, 'main' AS database, resource AS query, source_ip AS src_ip, status AS result, 0L AS rows_affected, seq AS duration_ms",
    "web": "'GET' AS method, resource AS url, source_ip AS src_ip, CASE WHEN action = 'http_error' THEN status END AS status_code, '' AS user_agent, bytes AS response_size, seq AS duration_ms",
    "email": "action AS event_type, user AS sender, array(user, 'all') AS recipients, '' AS subject, cast(array() AS array<string>) AS attachments, 0L AS attachment_size_bytes, status AS result",
}


def raw_rows(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw rows by log type, as the seven kinds of server would have logged the driver's events."""
    ev = events(spark, sf_dir)
    return {k: ev.where(F.col("source_type") == normalize.SOURCE_TYPE[k]).selectExpr("case_id", "cast(seq AS int) AS pos", "timestamp", *_split(x)) for k, x in _FROM_EVENTS.items()}


def _split(columns: str) -> list[str]:
    out, depth = [""], 0
    for c in columns:
        depth += (c in "(<") - (c in ")>")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.normalize(raw_rows(spark, sf_dir), prefix="evt_")
    return rows.select("case_id", "event_id", "timestamp", "source_type", "user", "action", "resource", "source_ip", "status", "session_id", "severity", "metadata.file_size_bytes", "metadata.bytes_transferred", "metadata.duration_ms", "metadata.status_code")


def ocsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.to_ocsf(events(spark, sf_dir))
    return rows.select("case_id", "event_uid", "time_dt", "category_uid", "category_name", "activity_id", "activity_name", "severity_id", "status_id", "status", F.col("principal.user.uid").alias("user"), F.col("principal.ip").alias("ip"), F.col("resource.name").alias("resource"), F.col("metadata.product.name").alias("product"), "raw_data")


def ecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalize.to_ecs(events(spark, sf_dir))
    return rows.select("case_id", F.col("event.id").alias("event_id"), F.col("event.category")[0].alias("category"), F.col("event.action").alias("action"), F.col("event.outcome").alias("outcome"), F.col("event.severity").alias("severity"), F.col("file.path").alias("path"), F.col("session.id").alias("session"))


QUERIES = {
    "n8_normalized": normalized,
    "n10_ocsf": ocsf,
    "n11_ecs": ecs,
    "n12_counts": lambda spark, d: normalize.counted(normalize.select_events(events(spark, d), ["file_access", "network"], "file_download")),
    "n12_selected": lambda spark, d: normalize.select_events(events(spark, d), ["file_access", "network"], "file_download").select("case_id", "event_id", "user", "resource"),
    "n13_source_types": lambda spark, d: normalize.source_types(events(spark, d)),
    "n14_chart_rows": lambda spark, d: normalize.chart_rows(events(spark, d)),
}
SQL = {
    "n8_normalized": f"""{EVENTS_SQL}, r AS (SELECT *, list_position(['auth', 'file_access', 'admin', 'network', 'database', 'web_server', 'email'], source_type) AS rank FROM ev)
SELECT case_id, 'evt_' || case_id || '_' || printf('%03d', row_number() OVER (PARTITION BY case_id ORDER BY timestamp, rank, seq)) AS event_id, timestamp, source_type,
  CASE WHEN source_type NOT IN ('network', 'web_server') THEN user END AS user, CASE source_type WHEN 'network' THEN 'allowed' ELSE action END AS action,
  CASE source_type WHEN 'email' THEN user || ', all' ELSE resource END AS resource, CASE WHEN source_type <> 'email' THEN source_ip END AS source_ip,
  CASE WHEN source_type = 'network' THEN 'allowed' WHEN source_type = 'web_server' AND action = 'http_request' THEN '200' ELSE status END AS status, session_id,
  CASE WHEN action = 'log_delete' THEN 'critical' WHEN action IN ('login_failed', 'privilege_change', 'http_error') THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN source_type = 'file_access' THEN bytes END AS file_size_bytes, CASE WHEN source_type = 'network' THEN bytes END AS bytes_transferred,
  CASE WHEN source_type IN ('database', 'web_server') THEN nullif(seq, 0) END AS duration_ms, CASE WHEN source_type = 'web_server' THEN CASE action WHEN 'http_error' THEN '500' ELSE '200' END END AS status_code
FROM r""",
    "n10_ocsf": f"""{EVENTS_SQL} SELECT case_id, event_id AS event_uid, timestamp AS time_dt,
  CASE source_type WHEN 'auth' THEN 3 WHEN 'file_access' THEN 4 WHEN 'admin' THEN 1 ELSE 0 END AS category_uid,
  CASE source_type WHEN 'auth' THEN 'Identity & Access Management' WHEN 'file_access' THEN 'Discovery' WHEN 'admin' THEN 'System Activity' ELSE 'Unknown' END AS category_name,
  CASE action WHEN 'login' THEN 1 WHEN 'logout' THEN 2 WHEN 'login_failed' THEN 1 WHEN 'file_read' THEN 1 WHEN 'file_download' THEN 5 WHEN 'privilege_change' THEN 3 WHEN 'log_delete' THEN 4 ELSE 0 END AS activity_id,
  CASE action WHEN 'login' THEN 'Logon' WHEN 'logout' THEN 'Logoff' WHEN 'login_failed' THEN 'Logon' WHEN 'file_read' THEN 'Read' WHEN 'file_download' THEN 'Download' WHEN 'privilege_change' THEN 'Grant' WHEN 'log_delete' THEN 'Delete' ELSE 'Unknown' END AS activity_name,
  CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 3 WHEN 'critical' THEN 5 ELSE 0 END AS severity_id, CASE status WHEN 'success' THEN 1 ELSE 2 END AS status_id, status, user, source_ip AS ip, resource, 'logsift' AS product, '{{}}' AS raw_data FROM ev""",
    "n11_ecs": f"""{EVENTS_SQL} SELECT case_id, event_id, source_type AS category, action, status AS outcome, CASE severity WHEN 'warning' THEN 50 WHEN 'critical' THEN 100 ELSE 0 END AS severity, nullif(resource, '') AS path, session_id AS session FROM ev""",
    "n12_counts": f"{EVENTS_SQL} SELECT case_id, count(*) AS n FROM ev WHERE source_type IN ('file_access', 'network') AND action = 'file_download' GROUP BY case_id",
    "n12_selected": f"{EVENTS_SQL} SELECT case_id, event_id, user, resource FROM ev WHERE source_type IN ('file_access', 'network') AND action = 'file_download'",
    "n13_source_types": f"{EVENTS_SQL} SELECT case_id, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types FROM ev GROUP BY case_id",
    "n14_chart_rows": f"""{EVENTS_SQL} SELECT case_id, event_id, t AS "start", t + 120000000 AS "end", CASE WHEN k > 1 THEN user ELSE source_type END AS category
FROM ev JOIN (SELECT case_id, count(DISTINCT user) AS k FROM ev GROUP BY case_id) USING (case_id)""",
}
