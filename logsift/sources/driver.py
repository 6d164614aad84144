"""The driver's events as unified log events, and baselines derived for their users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (event type, k below, source, action) in order: the first row that fits an event names it.
ACTIONS = [
    ("click", 70, "auth", "login"), ("click", 85, "database", "db_login"), ("click", 100, "web_server", "http_request"),
    ("error", 70, "auth", "login_failed"), ("error", 85, "web_server", "http_error"), ("error", 100, "admin", "log_delete"),
    ("view", 80, "file_access", "file_read"), ("view", 100, "network", "dns_query"),
    ("purchase", 80, "file_access", "file_download"), ("purchase", 100, "network", "firewall_allow"),
    ("signup", 60, "admin", "privilege_change"), ("signup", 100, "email", "mail_sent"),
]

_RESOURCE = """CASE WHEN source_type = 'file_access' THEN '/dept' || cast(CASE WHEN k % 9 = 0 THEN (user_id + 1) % 7 ELSE user_id % 7 END AS {text}) || '/f' || cast(k AS {text})
  WHEN action = 'dns_query' THEN 'd' || cast(k % 4 AS {text}) || '.example.org'
  WHEN action = 'http_error' THEN CASE WHEN k % 2 = 0 THEN '/q?x=1 or 1=1' ELSE '/q?x=1' END END"""


def _case(field: int) -> str:
    return "CASE " + " ".join(f"WHEN event_type = '{a[0]}' AND k < {a[1]} THEN '{a[field]}'" for a in ACTIONS) + " END"


def events_of(raw: DataFrame) -> DataFrame:
    """Unified events of the table events; case, user, address, session and resource follow from user_id and props."""
    base = raw.withColumn("k", F.regexp_extract("props", r"\d+", 0).cast("int")).withColumn("source_type", F.expr(_case(2))).withColumn("action", F.expr(_case(3)))
    day = F.date_format("ts", "yyyyMMdd")
    size = F.when(F.col("action") == "file_download", F.floor("value")).when(F.col("action") == "firewall_allow", F.floor(F.col("value") * 1048576))
    return base.select(
        F.concat(F.lit("case_"), F.floor(F.col("user_id") / 5)).alias("case_id"), F.concat(F.lit("evt_"), "event_id").alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"), F.expr("unix_micros(cast(ts AS timestamp))").alias("t"),
        (F.hour("ts") * 60 + F.minute("ts")).alias("local_minute"), F.col("event_id").alias("seq"), "source_type",
        F.concat(F.lit("user_"), "user_id").alias("user"), "action", F.expr(_RESOURCE.format(text="string")).alias("resource"),
        F.concat(F.lit("10.0."), F.col("user_id") % 250, F.when(F.col("k") % 10 == 0, ".99").otherwise(".1")).alias("source_ip"),
        F.when(F.col("action") == "http_error", "500").when(F.col("action") == "login_failed", "failure").otherwise("success").alias("status"),
        F.when(F.col("source_type").isin("auth", "file_access"), F.concat(F.lit("s"), "user_id", F.lit("_"), day)).alias("session_id"),
        F.when(F.col("action").isin("login_failed", "privilege_change", "log_delete", "http_error"), "warning").otherwise("info").alias("severity"),
        F.when(size != 0, size).cast("long").alias("bytes"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, first and last minute of normal hours, normal_ips and normal_directories of every user with events."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    return ids.select(
        F.concat(F.lit("user_"), "user_id").alias("user"), F.lit(540).alias("start_minute"), F.lit(1020).alias("end_minute"),
        F.array(F.concat(F.lit("10.0."), F.col("user_id") % 250, F.lit(".1"))).alias("normal_ips"), F.array(F.concat(F.lit("/dept"), F.col("user_id") % 7, F.lit("/"))).alias("normal_directories"),
    )


#: The same for SQL, written by hand: table ev of unified events, dn of the same in compressed time, bl of baselines.
EVENTS_SQL = """WITH e0 AS (SELECT *, cast(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
e1 AS (SELECT *,
  CASE event_type WHEN 'click' THEN CASE WHEN k < 70 THEN 'auth' WHEN k < 85 THEN 'database' ELSE 'web_server' END
    WHEN 'error' THEN CASE WHEN k < 70 THEN 'auth' WHEN k < 85 THEN 'web_server' ELSE 'admin' END
    WHEN 'view' THEN CASE WHEN k < 80 THEN 'file_access' ELSE 'network' END
    WHEN 'purchase' THEN CASE WHEN k < 80 THEN 'file_access' ELSE 'network' END
    WHEN 'signup' THEN CASE WHEN k < 60 THEN 'admin' ELSE 'email' END END AS source_type,
  CASE event_type WHEN 'click' THEN CASE WHEN k < 70 THEN 'login' WHEN k < 85 THEN 'db_login' ELSE 'http_request' END
    WHEN 'error' THEN CASE WHEN k < 70 THEN 'login_failed' WHEN k < 85 THEN 'http_error' ELSE 'log_delete' END
    WHEN 'view' THEN CASE WHEN k < 80 THEN 'file_read' ELSE 'dns_query' END
    WHEN 'purchase' THEN CASE WHEN k < 80 THEN 'file_download' ELSE 'firewall_allow' END
    WHEN 'signup' THEN CASE WHEN k < 60 THEN 'privilege_change' ELSE 'mail_sent' END END AS action FROM e0),
e2 AS (SELECT *,
  CASE WHEN action IN ('file_read', 'file_download') THEN '/dept' || (CASE WHEN k % 9 = 0 THEN user_id + 1 ELSE user_id END % 7) || '/f' || k
    WHEN action = 'dns_query' THEN 'd' || (k % 4) || '.example.org' WHEN action = 'http_error' THEN '/q?x=1' || CASE WHEN k % 2 = 0 THEN ' or 1=1' ELSE '' END END AS resource,
  CASE WHEN action = 'file_download' THEN floor(value) WHEN action = 'firewall_allow' THEN floor(value * 1048576) END AS size FROM e1),
ev AS (SELECT 'case_' || (user_id // 5) AS case_id, 'evt_' || event_id AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp,
  epoch_us(ts) AS t, cast(hour(ts) * 60 + minute(ts) AS INTEGER) AS local_minute, event_id AS seq, source_type, 'user_' || user_id AS user, action, resource,
  '10.0.' || (user_id % 250) || CASE WHEN k % 10 = 0 THEN '.99' ELSE '.1' END AS source_ip,
  CASE WHEN action = 'http_error' THEN '500' WHEN action = 'login_failed' THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN source_type IN ('auth', 'file_access') THEN 's' || user_id || '_' || strftime(ts, '%Y%m%d') END AS session_id,
  CASE WHEN action IN ('login_failed', 'privilege_change', 'log_delete', 'http_error') THEN 'warning' ELSE 'info' END AS severity,
  cast(nullif(size, 0) AS BIGINT) AS bytes, user_id FROM e2),
d0 AS (SELECT * EXCLUDE (t, timestamp), 1704067200000000 + (t - 1704067200000000) // 500 AS t FROM ev),
dn AS (SELECT *, strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp FROM d0),
bl AS (SELECT DISTINCT 'user_' || user_id AS user, 540 AS start_minute, 1020 AS end_minute, '10.0.' || (user_id % 250) || '.1' AS ip, '/dept' || (user_id % 7) || '/' AS directory FROM events)"""
#: Where compressed time starts, and how much faster it runs.
START, FASTER = 1704067200000000, 500


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events() in time that runs FASTER times as fast, so that windows of minutes hold several of a user's events."""
    t = F.lit(START) + F.expr(f"(t - {START}) div {FASTER}")
    return events(spark, sf_dir).withColumn("t", t).withColumn("timestamp", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
