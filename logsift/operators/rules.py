"""Detection rules: each takes events and baselines and gives alerts (ALERT columns).

A rule over single events is a condition and a text (Row), a rule over windows a choice of events, a key, a width and a
threshold (Windowed). All rules of a kind run together, over one read and one exchange of the events.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import MINUTE, followed_by, id_list, placed, same, sliding, sliding_runs

ALERT = ["case_id", "rule_id", "rule_name", "severity", "user", "t", "timestamp", "event_ids", "description"]
#: The same with the first and last event and their number in the place of all ids, so that no row grows with a window.
ENDS = ["first_event", "last_event", "n_events"]
INTERVAL = [*(c for c in ALERT if c != "event_ids"), *ENDS]
KEY = ["case_id", "user"]
#: Names and severities of the rules.
RULES = {
    "R001": ("unusual_login_ip", "warning"), "R002": ("off_hours_access", "warning"), "R003": ("privilege_escalation", "critical"),
    "R004": ("bulk_download", "critical"), "R005": ("cross_department_access", "warning"), "R006": ("log_deletion", "critical"),
    "R007": ("failed_login_spike", "warning"), "R008": ("privilege_then_download", "critical"), "R009": ("dns_tunnel_detection", "critical"),
    "R010": ("sql_injection_attempt", "critical"), "R011": ("data_exfiltration_volume", "critical"), "R012": ("lateral_movement", "warning"),
}
#: Fixed value: text of a statement in a request.
INJECTION = r"(?i)(UNION|SELECT|DROP|--|OR\s+1\s*=\s*1)"
#: Texts of the alerts, in which the evaluation looks for words.
TEXTS = {
    "R001": "Login from unusual IP %s. Normal IPs: %s",
    "R002": "Activity at %02d:%02d outside normal hours (%02d:%02d-%02d:%02d)",
    "R003": "Privilege change detected for %s. Resource: %s",
    "R004": "Bulk download detected: %d files downloaded within %d minutes (window start: %s)",
    "R005": "Cross-department access: %s is outside normal directories %s",
    "R006": "Log deletion detected by %s. Target: %s",
    "R007": "Failed login spike: %d failures within %d minutes for %s (window start: %s)",
    "R008": "Privilege escalation at %s followed by %d file download(s) within %d minutes",
    "R009": "Possible DNS tunnel: %d DNS queries to %s within %d minutes (window start: %s)",
    "R010": "Possible SQL injection: URL %s returned 500 and contains SQL keywords",
    "R011": "High data exfiltration volume: %s MB transferred in %d minutes (window start: %s)",
    "R012": "Lateral movement detected: %s authenticated across %s within %d minutes (window start: %s)",
}


@dataclass(frozen=True)
class Row:
    """A rule over single events; known: their user must have a baseline, whose columns it uses."""

    rule: str
    when: Column
    text: Column
    known: bool = False


@dataclass(frozen=True)
class Windowed:
    """A rule over windows; by: what its key is besides the case; once: the first hit of each time alerts."""

    rule: str
    when: Column
    by: Column
    width: int
    hit: Column
    text: Column
    user: Column
    weight: Column | None = None
    kinds: tuple[str, ...] = ()


def quoted(items: Column) -> Column:
    """A list of texts in brackets, each in quotes."""
    return F.when(F.size(items) > 0, F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))).otherwise("[]")


def _text(rule: str, *parts: Column | str | int) -> Column:
    return F.format_string(TEXTS[rule], *(F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x for x in parts))


def _named(rows: DataFrame, rule: Column, keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """Name and severity of each alert's rule."""
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("name"), F.lit(x[1]).alias("severity")) for k in RULES.items() for x in k))
    return rows.withColumn("rule_name", table[rule]["name"]).withColumn("severity", table[rule]["severity"]).select(*(ALERT if ids else INTERVAL), *keep)


def row_alerts(events: DataFrame, baselines: DataFrame | None, rules: list[Row], keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """Alerts of rules over single events, in one pass, with the events' columns to keep. The baselines' size decides how Spark joins them."""
    has = F.lit(False)
    if any(r.known for r in rules):
        own = baselines.withColumnRenamed("user", "_user").withColumn("_known", F.lit(True))
        events, has = events.join(own, F.col("user") == F.col("_user"), "left"), F.coalesce("_known", F.lit(False))
    hits = [F.when((has & r.when) if r.known else r.when, F.struct(F.lit(r.rule).alias("rule_id"), r.text.alias("description"))) for r in rules]
    rows = events.withColumn("_a", F.explode(F.array_compact(F.array(*hits))))
    of = [F.col("event_id").alias("event_ids")] if ids else [F.col("event_id").alias("first_event"), F.col("event_id").alias("last_event"), F.lit(1).cast("long").alias("n_events")]
    return _named(rows.select("case_id", "_a.rule_id", "user", "t", "timestamp", *of, "_a.description", *keep), F.col("rule_id"), keep, ids)


def _looked(events: DataFrame, rules: list[Windowed], keep: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...], Column | None, Callable]:
    """Events once for each rule that looks at them, with its key, width and weight; the kinds that count, where one hit of a time counts, and a choice by rule."""
    spec = [F.when(r.when, F.struct(F.lit(r.rule).alias("rule_id"), r.by.cast("string").alias("by"), F.lit(r.width).cast("long").alias("width"), (F.lit(1) if r.weight is None else r.weight).cast("long").alias("weight"))) for r in rules]
    pick = lambda of: reduce(lambda rest, r: F.when(F.col("rule_id") == r.rule, of(r)).otherwise(rest), rules, F.lit(None))
    rows = events.select("case_id", "t", "seq", "source_type", "user", *keep, F.explode(F.array_compact(F.array(*spec))).alias("_a"))
    rows = rows.select("*", "_a.rule_id", "_a.by", "_a.width", "_a.weight").drop("_a")
    kinds = tuple(dict.fromkeys(k for r in rules for k in r.kinds))
    return rows, kinds, F.col("rule_id").isin([r.rule for r in rules if r.kinds]) if kinds else None, pick


def window_alerts(events: DataFrame, rules: list[Windowed], ids: bool = True) -> DataFrame:
    """Alerts of rules over windows, over one exchange of the events that any of them looks at."""
    rows, kinds, once, pick = _looked(events, rules, ("event_id", "timestamp"))
    found = sliding(rows, ["case_id", "rule_id", "by"], F.col("width"), pick(lambda r: r.hit), "weight", ("width",), kinds, once, ids)
    of = ["event_ids"] if ids else ["first_event", "last_event", F.col("n").cast("long").alias("n_events")]
    minutes = F.floor(F.col("width") / MINUTE)
    out = found.withColumn("minutes", minutes).withColumn("kinds", quoted(F.col("found_kinds")))
    return _named(out.select("case_id", "rule_id", pick(lambda r: r.user).alias("user"), "t", "timestamp", *of, pick(lambda r: r.text).alias("description")), F.col("rule_id"), ids=ids)


def window_runs(events: DataFrame, rules: list[Windowed], runs: int) -> DataFrame:
    """case_id, rule_id, severity and run of each alert that window_alerts gives for the events of a run, of so many; events have the bitmap runs."""
    rows, kinds, once, pick = _looked(events, rules, ("runs",))
    found = sliding_runs(rows.drop("user"), ["case_id", "rule_id", "by"], F.col("width"), pick(lambda r: r.hit), runs, "weight", kinds, once)
    return found.select("case_id", "rule_id", _severity(), "run")


def _severity() -> Column:
    return F.create_map(*(F.lit(x) for k, (_, severity) in RULES.items() for x in (k, severity)))[F.col("rule_id")].alias("severity")


NO_USER = "N/A"
_or_na = lambda c: F.coalesce(F.col(c), F.lit(NO_USER))


def unusual_ip(actions=("login",)) -> Row:
    """A missing list of addresses is an empty one: every address is unusual."""
    ips = F.coalesce("normal_ips", F.array().cast("array<string>"))
    return Row("R001", F.col("action").isin(*actions) & (F.col("source_ip") != "") & ~F.array_contains(ips, F.col("source_ip")), _text("R001", "source_ip", quoted(ips)), True)


def off_hours() -> Row:
    clock = lambda c: (F.floor(F.col(c) / 60), F.pmod(F.col(c), F.lit(60)))
    return Row("R002", ~F.col("local_minute").between(F.col("start_minute"), F.col("end_minute")), _text("R002", *clock("local_minute"), *clock("start_minute"), *clock("end_minute")), True)


def privilege_escalation(action="privilege_change") -> Row:
    return Row("R003", F.col("action") == action, _text("R003", _or_na("user"), _or_na("resource")))


def bulk_download(width=30 * MINUTE, threshold=5, action="file_download") -> Windowed:
    return Windowed("R004", F.col("action") == action, F.col("user"), width, F.col("n") > threshold, _text("R004", "n", "minutes", "timestamp"), F.col("by"))


def cross_department() -> Row:
    odd = (F.size("normal_directories") > 0) & ~F.exists("normal_directories", lambda d: F.col("resource").startswith(d))
    return Row("R005", (F.col("source_type") == "file_access") & ~F.coalesce("resource", F.lit("")).isin("", "null", "role") & odd, _text("R005", "resource", quoted(F.col("normal_directories"))), True)


def log_deletion(action="log_delete") -> Row:
    return Row("R006", F.col("action") == action, _text("R006", _or_na("user"), _or_na("resource")))


def failed_login_spike(width=5 * MINUTE, threshold=2, action="login_failed") -> Windowed:
    return Windowed("R007", F.col("action") == action, F.col("user"), width, F.col("n") >= threshold, _text("R007", "n", "minutes", _or_na("by"), "timestamp"), F.col("by"))


def dns_tunnel(width=5 * MINUTE, threshold=20, action="dns_query") -> Windowed:
    when = (F.col("source_type") == "network") & (F.col("action") == action)
    return Windowed("R009", when, F.coalesce("resource", F.lit("")), width, F.col("n") > threshold, _text("R009", "n", "by", "minutes", "timestamp"), F.lit(NO_USER))


def sql_injection() -> Row:
    return Row("R010", (F.col("source_type") == "web_server") & (F.expr("try_cast(status AS int)") == 500) & F.col("resource").rlike(INJECTION), _text("R010", "resource"))


def exfiltration_volume(width=30 * MINUTE, threshold=100 * 1024 * 1024) -> Windowed:
    when = (F.col("source_type") == "network") & (F.col("bytes") > 0)
    return Windowed("R011", when, F.lit(None), width, F.col("total") > threshold, _text("R011", F.bround(F.col("total") / 1048576, 1).cast("decimal(20,1)").cast("string"), "minutes", "timestamp"), F.lit(NO_USER), F.col("bytes"))


def lateral_movement(width=30 * MINUTE, kinds=(("auth", "login"), ("database", "db_login"), ("web_server", "http_request"))) -> Windowed:
    fit = reduce(lambda a, b: a | b, ((F.col("source_type") == s) & (F.col("action") == a) for s, a in kinds))
    return Windowed("R012", fit & (F.col("user") != ""), F.col("user"), width, F.col("n_kinds") >= 2, _text("R012", "by", "kinds", "minutes", "timestamp"), F.col("by"), kinds=tuple(s for s, _ in kinds))


def privilege_then_download(events, width=30 * MINUTE, change="privilege_change", action="file_download", ids=True) -> DataFrame:
    pairs = followed_by(events.where(F.col("action") == change), events.where(F.col("action") == action), KEY, width)
    listed = F.concat_ws(",", F.col("c.event_id"), id_list(F.collect_list(F.struct("d.t", "d.seq", "d.event_id")))).alias("event_ids")
    ends = [F.first("c.event_id").alias("first_event"), F.max_by("d.event_id", F.struct("d.t", "d.seq")).alias("last_event"), (F.count(F.lit(1)) + 1).alias("n_events")]
    rows = pairs.groupBy("c.case_id", "c.user", "c.t", "c.seq", "c.event_id", "c.timestamp").agg(*([listed] if ids else ends), F.count(F.lit(1)).alias("n"))
    return _named(rows.select("case_id", F.lit("R008").alias("rule_id"), "user", "t", "timestamp", *(["event_ids"] if ids else ENDS), _text("R008", "timestamp", "n", width // MINUTE).alias("description")), F.col("rule_id"), ids=ids)


def privilege_then_download_runs(events, width=30 * MINUTE, change="privilege_change", action="file_download") -> DataFrame:
    """case_id, rule_id, severity and runs of each change: those that keep it and a download after it."""
    pairs = followed_by(events.where(F.col("action") == change), events.where(F.col("action") == action), KEY, width)
    rows = pairs.groupBy("c.case_id", "c.user", "c.t", "c.seq", "c.event_id").agg(F.bit_or(F.col("c.runs").bitwiseAND(F.col("d.runs"))).alias("runs"))
    return rows.select("case_id", F.lit("R008").alias("rule_id"), "runs").select("case_id", "rule_id", _severity(), "runs")


#: What makes each rule; R008 is a join and gives alerts itself. A caller's own rule is a function that gives a Row, a
#: Windowed, or, from events, alerts.
REGISTRY: dict[str, Callable] = {
    "R001": unusual_ip, "R002": off_hours, "R003": privilege_escalation, "R004": bulk_download, "R005": cross_department, "R006": log_deletion,
    "R007": failed_login_spike, "R008": privilege_then_download, "R009": dns_tunnel, "R010": sql_injection, "R011": exfiltration_volume, "R012": lateral_movement,
}
JOINED = ("R008",)


def run_rules(events: DataFrame, baselines: DataFrame | None, params: dict[str, dict] | None = None, registry: dict[str, Callable] = REGISTRY, ids: bool = True) -> DataFrame:
    """Alerts of all rules of the registry; params: keyword arguments by rule. Sort by ORDER for the order of time.

    Without ids they are interval-coded (INTERVAL columns): a burst of n events gives n rows of bounded size, not n windows of up
    to n ids. Counts, verdicts and evaluations need no more.
    """
    args = params or {}
    made = [f(**args.get(k, {})) for k, f in registry.items() if k not in JOINED]
    parts = [registry[k](events, **args.get(k, {}), **({} if ids else {"ids": False})) for k in JOINED if k in registry]
    if rows := [r for r in made if isinstance(r, Row)]:
        parts.append(row_alerts(events, baselines, rows, ids=ids))
    if windowed := [r for r in made if isinstance(r, Windowed)]:
        parts.append(window_alerts(events, windowed, ids))
    return reduce(DataFrame.unionByName, parts)


def alert_events(named: DataFrame, events: DataFrame, params: dict[str, dict] | None = None, registry: dict[str, Callable] = REGISTRY) -> DataFrame:
    """case_id, rule_id, first_event, t and event_id of each event of the named alerts (INTERVAL columns): what ids of run_rules lists.

    params and registry are those of the run that gave the alerts; event_id is unique within a case. An alert's first and last event
    are looked up by id, which gives its key and its ends; the events between meet it by key and slot of the rule's width, of which
    an alert has two at most. Rows are as many as the named alerts have events. Those of a rule over single events have one.
    named is read twice and should be written.
    """
    args = params or {}
    made = {k: f(**args.get(k, {})) for k, f in registry.items() if k not in JOINED}
    windowed = [r for r in made.values() if isinstance(r, Windowed)]
    looks = [(r.rule, r.when, r.by.cast("string"), r.width, F.lit(False)) for r in windowed]
    for k in JOINED:
        if k in registry:  # a change and the downloads after it
            at = {n: p.default for n, p in inspect.signature(registry[k]).parameters.items()} | args.get(k, {})
            is_later = F.col("action") == at["action"]
            looks.append((k, (F.col("action") == at["change"]) | is_later, F.col("user"), at["width"], is_later))
    spec = [F.when(when, F.struct(F.lit(k).alias("rule_id"), by.alias("by"), F.lit(width).cast("long").alias("width"), later.alias("later"))) for k, when, by, width, later in looks]
    if not spec:
        spec = [F.lit(None).cast("struct<rule_id: string, by: string, width: bigint, later: boolean>")]
    rows = events.withColumn("_a", F.explode(F.array_compact(F.array(*spec)))).select("case_id", "event_id", F.struct("t", "seq").alias("at"), "_a.*")
    ends = named.select("case_id", "rule_id", "first_event", "last_event")
    start = rows.select("case_id", "rule_id", F.col("event_id").alias("first_event"), "by", "width", F.col("at").alias("start"))
    stop = rows.select("case_id", "rule_id", F.col("event_id").alias("last_event"), F.col("at").alias("stop"))
    ends = ends.where(F.col("rule_id").isin([k for k, *_ in looks])).join(start, ["case_id", "rule_id", "first_event"]).join(stop, ["case_id", "rule_id", "last_event"])
    slot = lambda c: F.floor(F.col(c)["t"] / F.col("width"))
    a = ends.withColumn("slot", F.explode(F.sequence(slot("start"), slot("stop")))).alias("a")
    b = rows.withColumn("slot", slot("at")).alias("b")
    paired = F.col("a.rule_id").isin(*JOINED)
    between = F.col("b.at").between(F.col("a.start"), F.col("a.stop")) & (~paired | (F.col("b.later") & (F.col("b.at")["t"] > F.col("a.start")["t"])))
    joined = a.join(b, same("a", "b", ["case_id", "rule_id", "by", "slot"]) & (between | (F.col("a.first_event") == F.col("b.event_id"))))
    found = joined.select("a.case_id", "a.rule_id", "a.first_event", F.col("b.at")["t"].alias("t"), "b.event_id")
    single = named.where(~F.col("rule_id").isin([k for k, *_ in looks])).select("case_id", "rule_id", "first_event", "t", F.col("first_event").alias("event_id"))
    return found.unionByName(single)


def one_rule(rule: str, events: DataFrame, baselines: DataFrame | None, **params) -> DataFrame:
    return run_rules(events, baselines, {rule: params}, {rule: REGISTRY[rule]})


#: The order of a case's alerts: by time, then by rule.
ORDER = ["case_id", "timestamp", "rule_id", "event_ids"]


def ordered_alerts(found: DataFrame, k: str = "position") -> DataFrame:
    """Alerts with their place in their case; hours of the timestamp are numbered by themselves, so a case is many tasks' work."""
    return placed(found, ["case_id"], F.substring("timestamp", 1, 13), [F.col(c) for c in ORDER[1:]]).withColumnRenamed("position", k).drop("total_rows")


def rule_results(found: DataFrame, cases: DataFrame) -> DataFrame:
    """alert_count, rules_triggered, warnings, criticals and verdict of every case; cases without alerts too."""
    sums = found.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"),
        F.count_if(F.col("severity") == "warning").alias("w"), F.count_if(F.col("severity") == "critical").alias("c"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    verdict = F.when(zero("n") == 0, "no_alert").when(F.col("c") > 0, "attack").otherwise("suspicious")
    return cases.select("case_id").distinct().join(sums, "case_id", "left").select("case_id", zero("n").alias("alert_count"), F.coalesce("rules", F.lit("")).alias("rules_triggered"), zero("w").alias("warnings"), zero("c").alias("criticals"), verdict.alias("verdict"))
