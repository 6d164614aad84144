"""Correlation patterns over the events of a case; each gives findings (case_id, type, user, event_ids, severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import DAY, HOUR, MINUTE, chunked, followed_by, id_list, previous, running, same, trailing

KEY = ["case_id", "user"]


def _in_order(*order: str) -> Column:
    return id_list(F.collect_list(F.struct(*order, "event_id")))


def finding(rows: DataFrame, kind: str, severity: str) -> DataFrame:
    return rows.select("case_id", F.lit(kind).alias("type"), "user", "event_ids", F.lit(severity).alias("severity"))


def credential_stuffing(events: DataFrame, baselines: DataFrame) -> DataFrame:
    """Runs of failed logins of a user that a successful login ends; any other login ends a run without a finding."""
    rows = events.where((F.col("source_type") == "auth") & F.col("action").isin("login", "login_failed"))
    runs = running(rows, KEY, F.floor(F.col("t") / HOUR), ["t", "seq"], F.when(F.col("action") == "login", 1).otherwise(0), "island")
    groups = runs.groupBy(*KEY, "island").agg(
        F.count_if(F.col("action") == "login_failed").alias("failed"), F.count_if((F.col("action") == "login") & (F.col("status") == "success")).alias("won"), _in_order("t", "seq").alias("event_ids")
    )
    return finding(groups.where("failed > 0 and won > 0"), "credential_stuffing", "critical")


def unusual_login_ip(events: DataFrame, baselines: DataFrame) -> DataFrame:
    rows = events.where("source_type = 'auth' and action = 'login' and status = 'success'").join(baselines.select(F.col("user").alias("_user"), "normal_ips"), F.col("user") == F.col("_user"))
    rows = rows.where((F.size("normal_ips") > 0) & ~F.array_contains("normal_ips", F.col("source_ip")))
    return finding(rows.withColumn("event_ids", F.col("event_id")), "unusual_login_ip", "warning")


def privilege_then_download(events: DataFrame, baselines: DataFrame, width: int = DAY) -> DataFrame:
    pairs = followed_by(events.where("action = 'privilege_change'"), events.where("action = 'file_download'"), KEY, width)
    ids = F.concat_ws(",", F.col("c.event_id"), id_list(F.collect_list(F.struct("d.t", "d.seq", "d.event_id"))))
    return finding(pairs.groupBy("c.case_id", "c.user", "c.t", "c.seq", "c.event_id").agg(ids.alias("event_ids")), "privilege_escalation_then_download", "critical")


def new_access_after_privilege(events: DataFrame, baselines: DataFrame, width: int = DAY) -> DataFrame:
    """File accesses outside normal directories after a privilege change; a user without a baseline has none."""
    files = events.where("source_type = 'file_access' and coalesce(resource, '') <> ''").join(baselines.select(F.col("user").alias("_user"), "normal_directories"), F.col("user") == F.col("_user"), "left")
    files = files.where(~F.coalesce(F.exists("normal_directories", lambda d: F.col("resource").startswith(d)), F.lit(False)))
    pairs = followed_by(events.where("action = 'privilege_change'"), files, KEY, width)
    ids = F.concat_ws(",", F.col("c.event_id"), id_list(F.collect_list(F.struct("d.t", "d.seq", "d.event_id"))))
    return finding(pairs.groupBy("c.case_id", "c.user", "c.t", "c.seq", "c.event_id").agg(ids.alias("event_ids")), "new_resource_access_after_privilege_change", "warning")


def _after_hours(events: DataFrame, baselines: DataFrame) -> DataFrame:
    return events.join(baselines.select(F.col("user").alias("_user"), "start_minute", "end_minute"), F.col("user") == F.col("_user")).where("not local_minute between start_minute and end_minute")


def after_hours(events: DataFrame, baselines: DataFrame) -> DataFrame:
    return finding(_after_hours(events, baselines).groupBy(*KEY).agg(_in_order("t", "seq").alias("event_ids")), "after_hours_activity", "warning")


def unusual_volume(events: DataFrame, baselines: DataFrame, width: int = 30 * MINUTE, threshold: int = 5) -> DataFrame:
    return finding(trailing(events.where("user <> ''"), KEY, width, threshold), "unusual_volume", "warning")


def cross_source(events: DataFrame, baselines: DataFrame) -> DataFrame:
    rows = events.where("user <> '' and source_type <> ''").groupBy(*KEY).agg(F.countDistinct("source_type").alias("k"), _in_order("source_type", "t", "seq").alias("event_ids"))
    return finding(rows.where("k >= 2"), "cross_source_activity", "info")


def _without_login(events: DataFrame) -> DataFrame:
    logins = events.where("source_type = 'auth' and action = 'login' and status = 'success' and session_id <> ''").select(*KEY, "session_id").distinct().alias("b")
    rows = events.where("source_type in ('file_access', 'admin') and session_id <> ''").alias("a")
    return rows.join(logins, same("a", "b", [*KEY, "session_id"]), "left_anti")


def session_gap(events: DataFrame, baselines: DataFrame) -> DataFrame:
    """File and admin events of a session in which the user has no successful login, whenever it was."""
    return finding(_without_login(events).groupBy(*KEY).agg(_in_order("t", "seq").alias("event_ids")), "session_continuity_gap", "warning")


def activity_chunks(events: DataFrame, baselines: DataFrame, size: int = 1000) -> DataFrame:
    """The findings of after_hours, cross_source and session_gap with their events in rows of size each (chunk, first, n, event_ids):
    a finding lists all a user did, so its row would grow with the user."""
    hour, order = F.floor(F.col("t") / HOUR), [F.col("t"), F.col("seq")]
    several = events.where("user <> '' and source_type <> ''")
    wide = several.groupBy(*KEY).agg(F.countDistinct("source_type").alias("_k")).where("_k >= 2")
    parts = [
        ("after_hours_activity", "warning", _after_hours(events, baselines), hour, order),
        ("cross_source_activity", "info", several.join(wide, KEY), F.struct("source_type", hour.alias("hour")), [F.col("source_type"), *order]),
        ("session_continuity_gap", "warning", _without_login(events), hour, order),
    ]
    made = [chunked(rows.select(*KEY, "t", "seq", "event_id", "source_type"), KEY, slot, by, F.col("event_id"), "event_ids", size).withColumn("type", F.lit(kind)).withColumn("severity", F.lit(severity)) for kind, severity, rows, slot, by in parts]
    return reduce(DataFrame.unionByName, made).select("case_id", "type", "user", "severity", "chunk", "first", "n", "event_ids")


PATTERNS = [credential_stuffing, unusual_login_ip, privilege_then_download, new_access_after_privilege, after_hours, unusual_volume, cross_source, session_gap]


def correlate(events: DataFrame, baselines: DataFrame, params: dict[str, dict] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, (f(events, baselines, **(params or {}).get(f.__name__, {})) for f in PATTERNS))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("case_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


def session_hijack(events: DataFrame) -> DataFrame:
    """Events whose source address differs from the one before in their session."""
    rows = previous(events.where("session_id is not null"), ["case_id", "session_id"], F.floor(F.col("t") / HOUR), ["t", "seq"], "source_ip", "before")
    return rows.where("source_ip <> before").select("case_id", "session_id", "event_id", "before", "source_ip")


def failed_only(events: DataFrame) -> DataFrame:
    """Users with failed logins after their last successful one, or without any."""
    won = events.where("action = 'login' and status = 'success'").groupBy(*KEY).agg(F.max("t").alias("won")).alias("b")
    lost = events.where("action = 'login_failed'").alias("a").join(won, same("a", "b", KEY), "left").where("won is null or t > won")
    return lost.groupBy("a.case_id", "a.user").agg(F.count(F.lit(1)).alias("failures"))


def low_and_slow(events: DataFrame, baselines: DataFrame, days: int = 3, per_day: int = 5, action: str = "file_download") -> DataFrame:
    """Users who download from outside their directories on at least so many days, with at most per_day on any of them."""
    known = baselines.select(F.col("user").alias("_user"), "normal_directories").where(F.size("normal_directories") > 0)
    rows = events.where((F.col("action") == action) & (F.col("resource") != "")).join(known, F.col("user") == F.col("_user"))
    rows = rows.where(~F.exists("normal_directories", lambda d: F.col("resource").startswith(d)))
    daily = rows.groupBy(*KEY, F.substring("timestamp", 1, 10).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    sums = daily.groupBy(*KEY).agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("downloads"), F.max("n").alias("most"))
    return sums.where((F.col("days") >= days) & (F.col("most") <= per_day))


def login_after_access(events: DataFrame, access: tuple[str, ...] = ("file_access", "database"), logins: tuple[str, ...] = ("login", "vpn_connect")) -> DataFrame:
    """Addresses of a case that are first used for access before any login or VPN connection from them is logged."""
    rows = events.where("source_ip <> ''").groupBy("case_id", "source_ip").agg(
        F.min(F.when(F.col("source_type").isin(*access), F.col("t"))).alias("accessed"), F.min(F.when(F.col("action").isin(*logins), F.col("t"))).alias("logged_in")
    )
    return rows.where("accessed < logged_in")


def totals(findings: DataFrame) -> DataFrame:
    """Findings of all cases together, and cases that have any."""
    return findings.agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("case_id").alias("cases"))


def by_type(findings: DataFrame) -> DataFrame:
    """Findings of each type over all cases, and the cases that have them."""
    return findings.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("case_id").alias("cases"))
