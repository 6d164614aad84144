"""Scores of rules and answers against the truth (case_id, label, attack_steps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import chain_of

#: Words that tell of an attack step; other steps go by their own name with blanks. A caller may pass its own.
KEYWORDS = {
    "failed_login_attempts": ["failed login", "failed auth", "brute"],
    "login_unusual_ip": ["unusual ip", "tor", "login", "successful login", "initial access"],
    "privilege_escalation": ["privilege", "escalat"],
    "bulk_file_download": ["bulk", "download", "exfiltrat"],
    "log_deletion": ["log delet", "log removal", "anti-forensic", "deleted"],
    "logout": ["logout", "logged out", "session end"],
    "login_normal": ["login", "logged in", "authentication"],
    "minor_privilege_change": ["privilege", "role", "permission"],
    "slow_scope_expansion_day1": ["scope", "expansion", "day 1", "day1", "additional"],
    "slow_scope_expansion_day2": ["scope", "expansion", "day 2", "day2", "continued", "further"],
    "systematic_download_day3": ["download", "systematic", "day 3", "day3", "exfiltrat"],
    "data_exfiltration_complete": ["exfiltrat", "complete", "final", "transfer"],
    "session_hijack_ip_change": ["hijack", "ip change", "session", "unusual ip"],
    "unauthorized_hr_access_1": ["unauthorized", "hr", "access"],
    "unauthorized_hr_access_2": ["unauthorized", "hr", "access"],
    "unauthorized_hr_access_3": ["unauthorized", "hr", "access"],
}
#: What a verdict of the rules and of an answer stands for.
LABELS = {"no_alert": "BENIGN", "suspicious": "BENIGN", "attack": "ATTACK", "NO": "BENIGN", "INSUFFICIENT": "BENIGN", "YES": "ATTACK"}


def label_of(verdict: str, known: tuple[str, ...]) -> Column:
    out = F.lit("UNKNOWN")
    for v in known:
        out = F.when(F.col(verdict) == v, LABELS[v]).otherwise(out)
    return out


def verdict_accuracy(verdicts: DataFrame) -> DataFrame:
    """Labels of rule_verdict and llm_verdict, and whether they equal label."""
    rows = verdicts.withColumn("rule_mapped", label_of("rule_verdict", ("no_alert", "suspicious", "attack"))).withColumn("llm_mapped", label_of("llm_verdict", ("NO", "INSUFFICIENT", "YES")))
    return rows.select("case_id", "label", "rule_mapped", "llm_mapped", (F.col("rule_mapped") == F.col("label")).alias("rule_correct"), (F.col("llm_mapped") == F.col("label")).alias("llm_correct"))


def step_words(truth: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """case_id and _steps, an array of (step, words), of each case."""

    def words(step: Column) -> Column:
        out = F.array(F.replace(step, F.lit("_"), F.lit(" ")))
        for name, own in keywords.items():
            out = F.when(step == name, F.array(*map(F.lit, own))).otherwise(out)
        return out

    return truth.select("case_id", F.transform("attack_steps", lambda s: F.struct(s.alias("step"), words(s).alias("words"))).alias("_steps"))


def told_steps(text: Column) -> Column:
    """The steps of _steps that the text, in lower case, has a word of."""
    return F.transform(F.filter("_steps", lambda s: F.exists(s["words"], lambda w: F.contains(text, w))), lambda s: s["step"])


def _missed(steps: Column, told: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(steps, lambda s: ~F.array_contains(told, s))), ",")


def recall(truth: DataFrame, texts: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Attack steps that texts (case_id, text: one for each case) tell of; cases without steps have 100."""
    rows = truth.join(step_words(truth, keywords), "case_id").join(texts.select("case_id", F.lower("text").alias("_x")), "case_id", "left")
    rows = rows.withColumn("_told", told_steps(F.coalesce("_x", F.lit(""))))
    n, d = F.size("attack_steps").cast("long"), F.size("_told").cast("long")
    return rows.select("case_id", n.alias("total_steps"), d.alias("detected_steps"), F.when(n == 0, 100.0).otherwise(F.bround(100.0 * d / F.nullif(n, F.lit(0)), 2)).alias("recall_pct"), _missed(F.col("attack_steps"), F.col("_told")).alias("missed_steps"))


def chain_texts(answers: DataFrame, narrative: bool = False) -> DataFrame:
    """case_id and text: the descriptions of an answer's chain, and its narrative if that is asked for."""
    told = F.array_join(F.transform(chain_of(), lambda s: F.coalesce(s["description"], F.lit(""))), " ")
    return answers.select("case_id", (F.concat_ws(" ", told, "narrative") if narrative else told).alias("text"))


def alert_matches(truth: DataFrame, alerts: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """alerts, the steps of their case that each tells of (told), and whether there are any (match)."""
    rows = alerts.join(step_words(truth, keywords), "case_id", "left").withColumn("_x", F.lower(F.concat_ws(" ", "description", "rule_name")))
    rows = rows.withColumn("told", F.coalesce(told_steps(F.col("_x")), F.array().cast("array<string>")))
    return rows.withColumn("match", F.size("told") > 0).drop("_x", "_steps")


def rule_scores(truth: DataFrame, alerts: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Share of a case's alerts that tell of an attack step (null without steps or alerts), and of its steps that alerts tell of."""
    sums = alert_matches(truth, alerts, keywords).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("match").alias("k"), F.array_distinct(F.flatten(F.collect_set("told"))).alias("_told"))
    steps = F.size("attack_steps")
    told = F.size(F.filter("attack_steps", lambda s: F.coalesce(F.array_contains("_told", s), F.lit(False))))
    return truth.join(sums, "case_id", "left").select("case_id", F.when(steps > 0, F.bround(F.col("k") / F.col("n"), 4)).alias("rule_precision"), F.when(steps > 0, told / F.nullif(steps, F.lit(0))).alias("rule_recall"))


def rule_precision(truth: DataFrame, alerts: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    return rule_scores(truth, alerts, keywords).select("case_id", "rule_precision")


def answer_precision(truth: DataFrame, answers: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Share of an answer's steps that tell of an attack step; null without attack steps or steps."""
    rows = truth.join(step_words(truth, keywords), "case_id").join(answers.select("case_id", "attack_chain"), "case_id", "left")
    good = F.size(F.filter("attack_chain", lambda s: F.size(told_steps(F.lower(F.coalesce(s["description"], F.lit(""))))) > 0))
    return rows.select("case_id", F.when((F.size("attack_steps") > 0) & (F.size("attack_chain") > 0), F.bround(good / F.size("attack_chain"), 4)).alias("llm_precision"))


def f1(precision: Column, recall: Column) -> Column:
    """0 where it is undefined."""
    return F.when(precision + recall > 0, F.bround(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), 4)).otherwise(0.0)


def rule_breakdown(truth: DataFrame, alerts: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Alerts of each case and rule, and whether one of them tells of an attack step."""
    return alert_matches(truth, alerts, keywords).groupBy("case_id", "rule_id").agg(F.count(F.lit(1)).alias("alert_count"), F.max("match").alias("contributed"))


def false_positives(truth: DataFrame, alerts: DataFrame, events: DataFrame, answers: DataFrame) -> DataFrame:
    """Of BENIGN cases: alerts, their percentage of the case's events, and whether the answer is YES."""
    n = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    k = alerts.groupBy("case_id").agg(F.count(F.lit(1)).alias("k"))
    benign = F.col("label") == "BENIGN"
    count = F.when(benign, F.coalesce("k", F.lit(0))).otherwise(0).cast("long")
    rows = truth.join(n, "case_id", "left").join(k, "case_id", "left").join(answers.select("case_id", F.col("verdict").alias("_v")), "case_id", "left")
    return rows.select("case_id", count.alias("rule_fp_count"), F.coalesce(benign & (F.col("_v") == "YES"), F.lit(False)).alias("llm_fp"), F.coalesce(F.bround(100.0 * count / F.col("n"), 2), F.lit(0.0)).alias("false_positive_rate_pct"))


def time_to_detect(truth: DataFrame, alerts: DataFrame, answers: DataFrame, events: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Seconds from the first event that tells of an attack step to the first alert, and to the first event that the
    answer's chain cites; from the case's first event if none tells. May be negative. Null without attack steps, events
    or what was to be detected.
    """
    said = F.lower(F.concat(*(x for c in ("action", "resource", "status") for x in (F.coalesce(c, F.lit("")), F.lit(" ")))))
    rows = events.select("case_id", "event_id", "t", said.alias("_x")).join(step_words(truth.where(F.size("attack_steps") > 0), keywords), "case_id")
    tells = F.size(told_steps(F.col("_x"))) > 0
    first = rows.groupBy("case_id").agg(F.coalesce(F.min(F.when(tells, F.col("t"))), F.min("t")).alias("_start"))
    alert = alerts.groupBy("case_id").agg(F.min("t").alias("_alert"))
    cited = answers.select("case_id", F.explode("attack_chain").alias("s")).select("case_id", F.col("s.event_id").alias("event_id")).where("event_id <> ''")
    cited = cited.join(events.select("case_id", "event_id", "t"), ["case_id", "event_id"]).groupBy("case_id").agg(F.min("t").alias("_cited"))
    seconds = lambda c: F.bround((F.col(c) - F.col("_start")) / 1e6, 2)
    out = truth.select("case_id").join(first, "case_id", "left").join(alert, "case_id", "left").join(cited, "case_id", "left")
    return out.select("case_id", seconds("_alert").alias("rule_seconds"), seconds("_cited").alias("llm_seconds"))


def answer_quality(report: DataFrame) -> DataFrame:
    """False claims, grounding and order of an answer, by its report; what is missing counts as faultless."""
    return report.select(
        "case_id", F.coalesce("hallucination_count", F.lit(0)).cast("long").alias("hallucination_count"),
        F.coalesce("evidence_grounding", F.lit(100.0)).alias("evidence_grounding_pct"), F.coalesce("chronologically_correct", F.lit(True)).alias("timeline_correct"),
    )


def comparison(evaluations: DataFrame) -> DataFrame:
    """Both detectors side by side, with notes on what went wrong."""
    note = lambda cond, text: F.when(cond, text)
    notes = F.concat_ws(
        "; ", note(F.col("is_mock"), F.lit("Mock")), note(~F.col("rule_correct"), F.lit("Rule wrong")), note(~F.col("llm_correct"), F.lit("LLM wrong")),
        note(F.col("missed_steps") != "", F.concat(F.lit("Missed: "), F.replace("missed_steps", F.lit(","), F.lit(", ")))), note(~F.col("timeline_correct"), F.lit("Timeline err")),
    )
    mark = lambda v, ok: F.concat(v, F.when(F.col(ok), " [OK]").otherwise(" [X]"))
    return evaluations.select("case_id", "case_name", "label", mark("rule_verdict", "rule_correct").alias("rule"), mark("llm_verdict", "llm_correct").alias("llm"), "recall_pct", "rule_f1", "llm_f1", "rule_fp_count", "hallucination_count", F.coalesce(F.nullif(notes, F.lit("")), F.lit("-")).alias("notes"))


def accuracy_by_level(scores: DataFrame) -> DataFrame:
    """Runs and share of right verdicts by level of degradation."""
    return scores.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
