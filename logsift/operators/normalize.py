"""Raw rows of seven log types to unified events, and unified events to two public event schemas."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.raw import META, RAW, with_times
from .windows import placed

#: Severities that aren't info, by log type and event type.
SEVERITY = {
    "auth": {"login_failed": "warning"},
    "file": {"file_delete": "warning"},
    "admin": {"privilege_change": "warning", "log_delete": "critical", "config_change": "warning"},
    "network": {"firewall_block": "warning"},
    "db": {"db_login_failed": "warning", "db_export": "warning", "db_schema_change": "critical"},
    "email": {},
}
#: Source types of the unified events.
SOURCE_TYPE = {"auth": "auth", "file": "file_access", "admin": "admin", "network": "network", "db": "database", "web": "web_server", "email": "email"}
#: OCSF 1.1 categories and activities, and the severity numbers of OCSF and ECS.
OCSF_CATEGORY = {"auth": (3, "Identity & Access Management"), "file_access": (4, "Discovery"), "admin": (1, "System Activity")}
OCSF_ACTIVITY = {
    "login": (1, "Logon"), "logout": (2, "Logoff"), "login_failed": (1, "Logon"), "file_read": (1, "Read"), "file_download": (5, "Download"),
    "privilege_change": (3, "Grant"), "log_delete": (4, "Delete"),
}
OCSF_SEVERITY = {"info": 1, "warning": 3, "critical": 5}
ECS_SEVERITY = {"info": 0, "warning": 50, "critical": 100}


def looked_up(table: dict, key: Column, default: object) -> Column:
    """The entry of a small table for key, or the default."""
    if not table:
        return F.lit(default)
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[key], F.lit(default))


def _meta(kept: tuple[str, ...], drop_falsy: bool) -> Column:
    """The metadata struct with the kept columns of the row; with drop_falsy, zero, empty text and empty lists count as absent."""

    def field(name: str, kind: str) -> Column:
        if name not in kept:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name).cast(kind)
        if not drop_falsy or name == "status_code":
            return c.alias(name)
        return F.when(F.size(c) > 0 if kind.startswith("array") else c != ("" if kind == "string" else 0), c).alias(name)

    return F.struct(*(field(*x.split()) for x in META.split(", ")))


def _event(rows: DataFrame, log_type: str, severity: Column, user: Column, action: Column, resource: Column, ip: Column, status: Column, session: Column, meta: Column) -> DataFrame:
    return rows.select(
        "case_id", "pos", F.lit(list(RAW).index(log_type)).alias("rank"), "timestamp", F.lit(SOURCE_TYPE[log_type]).alias("source_type"), user.cast("string").alias("user"), action.alias("action"),
        resource.alias("resource"), ip.cast("string").alias("source_ip"), status.alias("status"), session.cast("string").alias("session_id"), severity.alias("severity"), meta.alias("metadata"),
    )


def _kind(log_type: str) -> tuple[Column, Column]:
    action = F.coalesce("event_type", F.lit("unknown"))
    return action, looked_up(SEVERITY[log_type], action, "info")


def auth_events(rows: DataFrame) -> DataFrame:
    """A login whose result is failure, in any case of letters, is a warning."""
    action, severity = _kind("auth")
    severity = F.when((action == "login") & (F.lower("result") == "failure"), "warning").otherwise(severity)
    return _event(rows, "auth", severity, F.col("username"), action, F.lit(None).cast("string"), F.col("ip_address"), F.col("result"), F.col("session"), _meta((), False))


def file_events(rows: DataFrame) -> DataFrame:
    action, severity = _kind("file")
    return _event(rows, "file", severity, F.col("username"), action, F.col("file_path"), F.col("ip_address"), F.col("result"), F.col("session"), _meta(("file_size_bytes",), False))


def admin_events(rows: DataFrame) -> DataFrame:
    action, severity = _kind("admin")
    return _event(rows, "admin", severity, F.col("username"), action, F.col("target"), F.col("ip_address"), F.col("result"), F.lit(None), _meta(("detail",), False))


def network_events(rows: DataFrame) -> DataFrame:
    """Severity goes by the event type, the action by the raw action where there is one."""
    action, severity = _kind("network")
    kept = ("protocol", "dst_ip", "src_port", "dst_port", "rule_name", "bytes_transferred")
    return _event(rows, "network", severity, F.lit(None), F.coalesce("action", action), F.col("dst_ip"), F.col("src_ip"), F.col("action"), F.lit(None), _meta(kept, True))


def db_events(rows: DataFrame) -> DataFrame:
    action, severity = _kind("db")
    return _event(rows, "db", severity, F.col("username"), action, F.col("query"), F.col("src_ip"), F.col("result"), F.lit(None), _meta(("database", "rows_affected", "duration_ms"), True))


def web_events(rows: DataFrame) -> DataFrame:
    """A missing status code counts as 200; one that isn't a number is kept as it is and is no error."""
    rows = rows.withColumn("status_code", F.coalesce("status_code", F.lit("200")))
    code = F.when(F.col("status_code").rlike("^[0-9]+$"), F.col("status_code").try_cast("long"))
    severity = F.when((code >= 500) | code.isin(401, 403), "warning").otherwise("info")
    kept = ("user_agent", "response_size", "duration_ms", "method", "status_code")
    return _event(rows, "web", severity, F.lit(None), F.when(code >= 400, "http_error").otherwise("http_request"), F.col("url"), F.col("src_ip"), F.coalesce(code.cast("string"), F.col("status_code")), F.lit(None), _meta(kept, True))


def email_events(rows: DataFrame) -> DataFrame:
    action, severity = _kind("email")
    to = F.array_join(F.coalesce("recipients", F.array().cast("array<string>")), ", ")
    return _event(rows, "email", severity, F.col("sender"), action, to, F.lit(None), F.col("result"), F.lit(None), _meta(("subject", "attachments", "attachment_size_bytes"), True))


NORMALIZERS = {"auth": auth_events, "file": file_events, "admin": admin_events, "network": network_events, "db": db_events, "web": web_events, "email": email_events}


def normalize(raw: dict[str, DataFrame], prefix: str = "evt_s") -> DataFrame:
    """Unified events of the raw rows by log type, numbered within each case in order of time; ids are prefix, case and number.

    Missing times come first; ties go by log type, then by place in the file. Rows are numbered by hour as written, so that
    a case of any size is many tasks' work.
    """
    rows = reduce(DataFrame.unionByName, (NORMALIZERS[k](df) for k, df in raw.items()))
    rows = placed(rows, ["case_id"], F.substring("timestamp", 1, 13), [F.col("timestamp").asc_nulls_first(), F.col("rank"), F.col("pos")])
    rows = rows.withColumn("seq", F.col("position")).drop("rank", "pos", "position", "total_rows")
    return with_times(rows.withColumn("event_id", F.format_string("%s%s_%03d", F.lit(prefix), "case_id", "seq")))


def to_ocsf(events: DataFrame, product: str = "logsift", vendor: str = "logsift") -> DataFrame:
    """Events by OCSF 1.1: category, activity, severity and status numbers, principal, resource, product and the event's own metadata as JSON."""
    part = lambda table, k: {x: v[k] for x, v in table.items()}
    return events.select(
        "case_id", F.col("event_id").alias("event_uid"), F.col("timestamp").alias("time_dt"), F.lit("1.1.0").alias("version"),
        looked_up(part(OCSF_CATEGORY, 0), F.col("source_type"), 0).alias("category_uid"), looked_up(part(OCSF_CATEGORY, 1), F.col("source_type"), "Unknown").alias("category_name"),
        looked_up(part(OCSF_ACTIVITY, 0), F.col("action"), 0).alias("activity_id"), looked_up(part(OCSF_ACTIVITY, 1), F.col("action"), "Unknown").alias("activity_name"),
        looked_up(OCSF_SEVERITY, F.col("severity"), 0).alias("severity_id"), F.when(F.col("status") == "success", 1).otherwise(2).alias("status_id"), "status",
        F.struct(F.struct(F.col("user").alias("uid")).alias("user"), F.col("source_ip").alias("ip"), F.struct(F.col("session_id").alias("uid")).alias("session")).alias("principal"),
        F.struct(F.col("resource").alias("name")).alias("resource"),
        F.struct(F.lit("1.1.0").alias("version"), F.struct(F.lit(product).alias("name"), F.lit(vendor).alias("vendor_name")).alias("product")).alias("metadata"),
        (F.to_json("metadata") if "metadata" in events.columns else F.lit("{}")).alias("raw_data"),
    )


def to_ecs(events: DataFrame) -> DataFrame:
    """Events by ECS 8; file is null where there is no resource."""
    return events.select(
        "case_id", F.col("timestamp").alias("@timestamp"),
        F.struct(
            F.col("event_id").alias("id"), F.array(F.coalesce("source_type", F.lit(""))).alias("category"), F.coalesce("action", F.lit("")).alias("action"),
            F.coalesce("status", F.lit("")).alias("outcome"), looked_up(ECS_SEVERITY, F.col("severity"), 0).alias("severity"),
        ).alias("event"),
        F.struct(F.col("user").alias("id")).alias("user"), F.struct(F.col("source_ip").alias("ip")).alias("source"),
        F.when(F.col("resource") != "", F.struct(F.col("resource").alias("path"))).alias("file"), F.struct(F.col("session_id").alias("id")).alias("session"),
    )


def select_events(events: DataFrame, source_types: list[str] | None = None, action: str | None = None, user: str | None = None) -> DataFrame:
    """Events that meet all the conditions given."""
    if source_types:
        events = events.where(F.col("source_type").isin(*source_types))
    if action:
        events = events.where(F.col("action") == action)
    return events.where(F.col("user") == user) if user else events


def counted(events: DataFrame) -> DataFrame:
    """Events by case, as the count beside a selection; one row of each case that has any."""
    return events.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def source_types(events: DataFrame) -> DataFrame:
    """The distinct source types of each case, sorted and joined by commas."""
    return events.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"))


def chart_rows(events: DataFrame, minutes: int = 2) -> DataFrame:
    """Start and end (micros) of each event with a time; the category is the user in cases of several users, else the source type."""
    users = events.groupBy("case_id").agg(F.countDistinct("user").alias("_users"))
    rows = events.where("t is not null").join(users, "case_id")
    return rows.select("case_id", "event_id", F.col("t").alias("start"), (F.col("t") + minutes * 60_000_000).alias("end"), F.when(F.col("_users") > 1, F.coalesce("user", F.lit("unknown"))).otherwise(F.col("source_type")).alias("category"))
