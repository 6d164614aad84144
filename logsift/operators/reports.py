"""Reports and figures over the results of all cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .claims import chain_of
from .rules import ORDER, RULES
from .windows import HOUR, chunked


def by_source(events: DataFrame) -> DataFrame:
    """Events of each source type, their percentage of all, and of the largest type's."""
    counts, all_ = events.groupBy("source_type").agg(F.count(F.lit(1)).alias("n")), Window.partitionBy()  # a row for each type
    share = lambda of: F.round(100.0 * F.col("n") / of("n").over(all_), 4)
    return counts.withColumn("percent", share(F.sum)).withColumn("bar_width", share(F.max))


def report_label(verdict: Column) -> Column:
    """What a verdict of either detector stands for in reports; here suspicious counts as an attack."""
    v = F.lower(F.trim(F.coalesce(verdict, F.lit(""))))
    return F.when(v.isin("attack", "yes", "suspicious"), "ATTACK").when(v.isin("no_alert", "no", "benign", "insufficient"), "BENIGN").otherwise("UNKNOWN")


def key_findings(alerts: DataFrame, critical: int = 3, warning: int = 2) -> DataFrame:
    """case_id, position and description of each case's first critical alerts, then of its first warnings."""
    rank = F.row_number().over(Window.partitionBy("case_id", "severity").orderBy(*ORDER[1:]))
    # the plain bound lets Spark cut each task's alerts before they are exchanged
    top = alerts.where("severity in ('critical', 'warning')").withColumn("_k", rank).where(f"_k <= {max(critical, warning)}").where(f"(severity = 'critical' and _k <= {critical}) or (severity = 'warning' and _k <= {warning})")
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("severity", "_k"))  # a few rows a case
    return top.select("case_id", place.cast("long").alias("position"), "rule_id", "description")


def case_rows(evaluations: DataFrame, results: DataFrame, answers: DataFrame, timelines: DataFrame) -> DataFrame:
    """What reports need of each case in one row: its evaluation, the rules' results, the answer and the timeline's summary."""
    said = answers.select("case_id", "suspect", F.coalesce("narrative", F.lit("")).alias("narrative"), F.coalesce("gaps", F.array().cast("array<string>")).alias("gaps"), chain_of().alias("chain"))
    rows = evaluations.join(results.drop("verdict"), "case_id", "left").join(said, "case_id", "left").join(timelines, "case_id", "left")
    return rows.withColumn("rule_label", report_label(F.col("rule_verdict"))).withColumn("llm_label", report_label(F.col("llm_verdict")))


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def summary_of() -> Column:
    """A summary of each row of case_rows(), worded by truth and alerts."""
    c = F.col
    steps = F.when(F.size("chain") > 0, _say(" Steps: ", F.array_join(F.transform("chain", lambda s: F.coalesce(s["description"], F.lit(""))), "; "), ".")).otherwise("")
    suspect = F.when(c("suspect") != "", _say(" Suspect: ", c("suspect"), ".")).otherwise("")
    noisy = _say(c("case_name"), " is benign but raised ", c("alert_count"), " alert(s) (", F.replace("rules_triggered", F.lit(","), F.lit(", ")), "), which are false positives; the answer is ", c("llm_verdict"), ". ", c("narrative"))
    quiet = _say(c("case_name"), " is benign and raised no alert (", c("rule_verdict"), "); the answer is ", c("llm_verdict"), ". ", c("narrative"))
    attack = _say(c("case_name"), " is an incident. The rules raised ", c("alert_count"), " alert(s) and say ", c("rule_verdict"), "; the answer is ", c("llm_verdict"), " with confidence ", c("llm_confidence"), ".", suspect, steps, " ", c("narrative"))
    return F.trim(F.when(c("label") != "BENIGN", attack).when(c("alert_count") > 0, noisy).otherwise(quiet))


def executive_summary(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", summary_of().alias("summary"))


#: What is recommended when, in order; the last three fill up.
ADVICE = {
    "account": "Isolate the account %s, end its sessions and reset its credentials.", "critical": "Start incident response for the critical alerts.", "privilege": "Tighten the control of privilege changes.",
    "download": "Limit and watch bulk downloads.", "tune": "Tune rule thresholds to raise fewer false alerts.", "baseline": "Keep the users' baselines up to date.", "gap": "Close the gap: %s",
    "disagree": "Find out why the detectors disagree.", "logs": "Log network traffic, processes and endpoints too.", "exercise": "Test both detectors in regular exercises.", "custody": "Keep a chain of custody for all evidence.",
}


def advice(most: int = 5) -> Column:
    """Up to so many recommendations, joined by |, for each row of case_rows()."""
    attack = (F.col("rule_label") == "ATTACK") | (F.col("llm_label") == "ATTACK")
    benign = (F.col("rule_label") == "BENIGN") & (F.col("llm_label") == "BENIGN")
    fired = lambda *ids: F.arrays_overlap(F.split("rules_triggered", ","), F.array(*map(F.lit, ids)))
    names = lambda *words: [k for k, (name, _) in RULES.items() if any(w in name for w in words)]
    when = {
        "account": attack & (F.col("suspect") != ""), "critical": attack & (F.col("criticals") > 0), "privilege": attack & fired(*names("privilege")), "download": attack & fired(*names("bulk", "download")),
        "tune": benign & (F.col("alert_count") > 0), "baseline": benign, "gap": F.size("gaps") > 0, "disagree": F.col("rule_label") != F.col("llm_label"),
    }
    fill = {"account": F.col("suspect"), "gap": F.get("gaps", F.lit(0))}
    items = [F.when(when.get(k, F.lit(True)), F.format_string(v, fill[k]) if k in fill else F.lit(v)) for k, v in ADVICE.items()]
    return F.array_join(F.slice(F.array_compact(F.array(*items)), 1, most), "|")


def recommendations(rows: DataFrame, most: int = 5) -> DataFrame:
    return rows.select("case_id", advice(most).alias("recommendations"))


def value_added() -> Column:
    """What the answer adds to the rules, or they to it, for each row of case_rows()."""
    rule, llm, fp = F.coalesce("rule_correct", F.lit(False)), F.coalesce("llm_correct", F.lit(False)), F.coalesce("rule_fp_count", F.lit(0))
    extras = F.concat_ws(", ", F.when(F.col("narrative") != "", "a narrative"), F.when(F.size("gaps") > 0, _say(F.size("gaps"), " gap(s)")), F.when(F.size("chain") > 0, "a chain of steps"))
    both = F.when(fp > 0, _say("Both are right; the answer spares ", fp, " false alert(s).")).when(extras != "", _say("Both are right; the answer adds ", extras, ".")).otherwise("Both are right.")
    return F.when(llm & ~rule, _say("Only the answer is right: ", F.col("label"), ".")).when(rule & ~llm, _say("Only the rules are right: ", F.col("label"), ".")).when(rule & llm, both).otherwise("Neither is right; review by hand.")


def added_value(rows: DataFrame) -> DataFrame:
    return rows.select("case_id", value_added().alias("added_value"))


def reports(rows: DataFrame, findings: DataFrame, prefix: str = "FR-2026-") -> DataFrame:
    """The report of each row of case_rows() as nested structs; events and alerts stay in tables of their own."""
    first = findings.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "description"))), lambda x: x["description"]).alias("key_findings"))
    parts = rows.withColumn("summary", summary_of()).withColumn("recommendations", advice()).withColumn("added_value", value_added()).join(first, "case_id", "left")
    number = F.regexp_extract("case_id", r"(\d+)", 1).cast("long")
    return parts.select(
        "case_id", F.format_string("%s%03d", F.lit(prefix), number).alias("report_id"), F.col("summary").alias("executive_summary"),
        F.struct(F.col("case_name").alias("name"), F.col("label").alias("ground_truth")).alias("case"),
        F.struct(F.coalesce("total_events", F.lit(0)).alias("total_events"), F.coalesce("first", F.lit("N/A")).alias("start"), F.coalesce("last", F.lit("N/A")).alias("end"), "users", "sessions").alias("timeline_summary"),
        F.struct(F.coalesce("rule_verdict", F.lit("N/A")).alias("verdict"), "alert_count", "rules_triggered", "criticals", "warnings", F.coalesce("key_findings", F.array().cast("array<string>")).alias("key_findings")).alias("rule_analysis"),
        F.struct(F.coalesce("llm_verdict", F.lit("N/A")).alias("verdict"), F.col("llm_confidence").alias("confidence"), "suspect", "narrative", F.col("chain").alias("attack_chain"), "gaps").alias("llm_analysis"),
        F.struct((F.col("rule_mapped") == F.col("llm_mapped")).alias("agreement"), "rule_correct", "llm_correct", "added_value").alias("comparative_assessment"),
        F.struct("hallucination_count", "evidence_grounding_pct", "timeline_correct").alias("evidence_integrity"), F.split("recommendations", r"\|").alias("recommendations"),
    )


def combined(reported: DataFrame) -> DataFrame:
    """Reports, attacks among them, and how many of them each detector got right, as k/n."""
    share = lambda c: F.concat(F.count_if(F.col(f"comparative_assessment.{c}")), F.lit("/"), F.count(F.lit(1)))
    return reported.agg(F.count(F.lit(1)).alias("reports"), F.count_if(F.col("case.ground_truth") == "ATTACK").alias("attacks"), share("rule_correct").alias("rule_accuracy"), share("llm_correct").alias("llm_accuracy"))


def incidents(rows: DataFrame) -> DataFrame:
    """Cases with the severity that the console shows, and their place: critical, warning, clear, then by number."""
    severity = F.when(F.col("llm_verdict") == "YES", "critical").when(F.col("rule_verdict") == "suspicious", "warning").otherwise("clear")
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    out = rows.withColumn("severity", severity).withColumn("rank", rank).withColumn("number", F.regexp_extract("case_id", r"(\d+)", 1).cast("long"))
    return out.select("case_id", "number", F.coalesce("label", F.lit("UNKNOWN")).alias("label"), F.coalesce("llm_verdict", F.lit("UNKNOWN")).alias("verdict"), F.coalesce("alert_count", F.lit(0)).cast("long").alias("alert_count"), "severity", "rank")


def severity_counts(shown: DataFrame) -> DataFrame:
    """How many incidents the console counts as threats, warnings and clear cases, and their alerts."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return shown.agg(of("critical").alias("threats"), of("warning").alias("warnings"), of("clear").alias("clear"), F.coalesce(F.sum("alert_count"), F.lit(0)).alias("alerts"))


def quality_figures(evaluations: DataFrame) -> DataFrame:
    """Accuracy of both detectors, average false claims, average grounding of the answers with any, and sums."""
    n = F.count(F.lit(1))
    share = lambda c: F.bround(F.count_if(F.col(c)) / n, 4)
    return evaluations.agg(
        n.alias("cases"), share("rule_correct").alias("rule_accuracy"), share("llm_correct").alias("llm_accuracy"), F.bround(F.avg("hallucination_count"), 4).alias("avg_hallucinations"),
        F.coalesce(F.bround(F.avg(F.when(F.col("evidence_grounding_pct") > 0, F.col("evidence_grounding_pct"))), 4), F.lit(0.0)).alias("avg_grounding"),
        F.count_if("timeline_correct").alias("timeline_correct"), F.coalesce(F.sum("rule_fp_count"), F.lit(0)).alias("rule_fp"), F.count_if("llm_fp").alias("llm_fp"),
    )


def rule_failures(evaluations: DataFrame, truth: DataFrame) -> DataFrame:
    """Cases that the rules got wrong, with what made them hard."""
    verdict = F.upper(F.replace("rule_verdict", F.lit("_"), F.lit(" ")))
    return evaluations.where(~F.col("rule_correct")).join(truth.select("case_id", "challenge"), "case_id", "left").select("case_id", "case_name", "label", verdict.alias("rule_verdict"), F.coalesce("challenge", F.lit("")).alias("challenge"))


def disagreements(evaluations: DataFrame) -> DataFrame:
    """Whether the console shows a disagreement; here suspicious maps to UNKNOWN."""
    mapped = F.when(F.col("rule_verdict") == "attack", "YES").when(F.col("rule_verdict") == "clear", "NO").otherwise("UNKNOWN")
    return evaluations.select("case_id", mapped.alias("rule_says"), F.col("llm_verdict").alias("answer_says"), (~mapped.eqNullSafe(F.col("llm_verdict"))).alias("disagree"))


def run_counts(events: DataFrame, alerts: DataFrame, raw_rows: DataFrame) -> DataFrame:
    """Raw rows, events and alerts of each case that has any of them."""
    each = [rows.groupBy("case_id").agg(F.count(F.lit(1)).alias(name)) for name, rows in (("raw_rows", raw_rows), ("events", events), ("alerts", alerts))]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    return all_.groupBy("case_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw_rows", "events", "alerts")))


def run_summary(counts: DataFrame, evaluations: DataFrame) -> DataFrame:
    """What a run over all cases reports of each: raw rows, events, alerts, both verdicts and the answer's false claims."""
    own = evaluations.select("case_id", "rule_verdict", "llm_verdict", "hallucination_count")
    return counts.join(own, "case_id", "left").select("case_id", "raw_rows", "events", "alerts", F.coalesce("rule_verdict", F.lit("")).alias("rule_verdict"), F.coalesce("llm_verdict", F.lit("")).alias("llm_verdict"), F.coalesce("hallucination_count", F.lit(0)).cast("long").alias("hallucination_count"))


def case_list(truth: DataFrame, cases: DataFrame) -> DataFrame:
    """Every case of the truth with its description, if cases (case_id, description) has one."""
    return truth.join(cases.select("case_id", "description"), "case_id", "left").select("case_id", "name", "label", "description")


def case_details(truth: DataFrame, events: DataFrame, alerts: DataFrame, answers: DataFrame, evaluations: DataFrame) -> DataFrame:
    """All there is of each case in one row, events and alerts as arrays in order of time: for a few cases, select_case first."""
    nested = lambda rows, name, *order: rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rows.columns if c not in ("case_id", *order))))).alias(name))
    out = truth.join(nested(events, "events", "t", "seq"), "case_id", "left").join(nested(alerts, "alerts", "t", "rule_id"), "case_id", "left")
    for name, rows in (("answer", answers), ("evaluation", evaluations)):
        out = out.join(rows.select("case_id", F.struct(*(c for c in rows.columns if c != "case_id")).alias(name)), "case_id", "left")
    return out


def select_case(rows: DataFrame, case_id: str) -> DataFrame:
    return rows.where(F.col("case_id") == case_id)


#: What evidence tells of an event and an alert.
TOLD = ("event_id", "timestamp", "source_type", "user", "action", "resource", "source_ip", "status", "session_id", "severity")
TOLD_ALERT = ("timestamp", "rule_id", "rule_name", "severity", "user", "event_ids", "description")


def evidence_parts(events: DataFrame, baselines: DataFrame, alerts: DataFrame, size: int = 1000) -> DataFrame:
    """The evidence of all cases in rows of size JSON objects, joined by commas: case_id, part (baselines, events, alerts), chunk, first, n, text."""
    users = events.select("case_id", "user").distinct().join(baselines, "user").select("case_id", "user", *(c for c in baselines.columns if c != "user"))
    json = lambda cols: F.to_json(F.struct(*cols))
    parts = [
        ("baselines", users, F.lit(0), [F.col("user")], json(users.columns[1:])),
        ("events", events, F.floor(F.col("t") / HOUR), [F.col("t"), F.col("seq")], json(TOLD)),
        ("alerts", alerts, F.substring("timestamp", 1, 13), [F.col(c) for c in TOLD_ALERT], json(TOLD_ALERT)),
    ]
    return reduce(DataFrame.unionByName, (chunked(rows, ["case_id"], slot, order, item, "text", size).withColumn("part", F.lit(part)) for part, rows, slot, order, item in parts))


def evidence_of(parts: DataFrame, case_id: str, template: str = "Baselines:\n%s\n\nEvents in order of time:\n%s\n\nAlerts:\n%s\n") -> DataFrame:
    """case_id and document of one case, put together from its parts; no row if it has none."""
    mine = parts.where(F.col("case_id") == case_id)
    whole = lambda part: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("chunk", "text")))), lambda x: x["text"]), ","), F.lit("]"))
    return mine.groupBy("case_id").agg(F.format_string(template, whole("baselines"), whole("events"), whole("alerts")).alias("document"))


def evidence(events: DataFrame, baselines: DataFrame, alerts: DataFrame, template: str = "Baselines:\n%s\n\nEvents in order of time:\n%s\n\nAlerts:\n%s\n") -> DataFrame:
    """case_id and document: the baselines of a case's users, its events and its alerts as JSON, put into the template."""
    told = events.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", F.struct(*TOLD).alias("e")))), lambda x: x["e"]).alias("_e"))
    found = alerts.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*TOLD_ALERT))).alias("_a"))
    users = events.select("case_id", "user").distinct().join(baselines, "user").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("user", *(c for c in baselines.columns if c != "user")))).alias("_b"))
    text = lambda c: F.coalesce(F.to_json(c), F.lit("[]"))
    return told.join(found, "case_id", "left").join(users, "case_id", "left").select("case_id", F.format_string(template, text("_b"), text("_e"), text("_a")).alias("document"))
