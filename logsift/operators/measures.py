"""What scores answers and rules, measured in one read of the events for their facts and one for the ids that answers cite.

Everything an answer says is first taken from its row alone: its citations, each tagged with where it stands, its claims and
the names in its texts. Citations meet events by id and are summed in two levels, by the text that has them and by case; facts
of a case are one aggregate of its events, and alerts are summed by case and rule, then by case. What is left is arithmetic
on one row for each case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import claims as C
from .evaluate import KEYWORDS, f1, label_of, step_words, told_steps

IDS = "array<string>"
CITED = "array<struct<event_id: string, cite: boolean, pos: int, row: int>>"
#: What counts as an error of an answer.
ERRORS = ("invalid_references", "out_of_order", "unsupported_claims", "temporal_errors", "file_errors", "size_errors", "span_errors", "unknown_entities")


def _list(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(IDS))


def _texts() -> Column:
    """(row, event_id, text) of each text of an answer that isn't empty: row -1 is the narrative, others are steps."""
    steps = F.transform(C.chain_of(), lambda s, i: F.struct(i.alias("row"), s["event_id"].alias("event_id"), s["description"].alias("text")))
    told = F.array(F.struct(F.lit(-1).alias("row"), F.lit(None).cast("string").alias("event_id"), F.col("narrative").alias("text")))
    some = F.filter(F.concat(told, steps), lambda x: x["text"] != "")
    return F.transform(some, lambda x: F.struct(x["row"].alias("row"), x["event_id"].alias("event_id"), F.replace(x["text"], F.lit(C.MARK), F.lit(" ")).alias("text")))


def _claims(pattern: str, reach: int, words: tuple[str, ...], narrative: bool = False) -> Column:
    """Claims of all texts that have one of words around them; those of the narrative count without if that is said."""
    near = lambda x: lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c["context"], w)) | (F.lit(narrative) & (x["row"] < 0))
    return F.flatten(F.transform("_texts", lambda x: F.transform(F.filter(C.with_context(x["text"], pattern, reach), near(x)), lambda c: c["claim"])))


def said(answers: DataFrame) -> DataFrame:
    """answers with what their texts say: _times (row, claims, ids), _files, _sizes, _spans (claims) and _named (type, value)."""
    rows = answers.withColumn("_texts", _texts())

    def times(x: Column) -> Column:
        ids = C.matches(x["text"], C.EVENT_ID)
        own = F.when(x["event_id"] != "", F.array(x["event_id"])).otherwise(F.array().cast(IDS))
        cited = F.when(x["row"] < 0, ids).otherwise(F.array_distinct(F.concat(ids, own)))
        return F.struct(x["row"].alias("row"), F.flatten(F.array(*(C.matches(x["text"], p) for p in C.TIMES))).alias("claims"), cited.alias("ids"))

    text = F.concat_ws(" ", "narrative", F.transform(C.chain_of(), lambda s: s["description"]))
    typed = lambda kind: lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    named = F.concat(*(F.transform(F.array_distinct(C.matches(text, p)), typed(k)) for k, p in C.ENTITIES.items()))
    return rows.select(
        *answers.columns, F.filter(F.transform("_texts", times), lambda x: F.size(x["claims"]) > 0).alias("_times"), _claims(C.FILES, 40, C.DOWNLOAD_WORDS).alias("_files"),
        _claims(C.SIZES, 60, C.TOTAL_WORDS, True).alias("_sizes"), F.flatten(F.transform("_texts", lambda x: C.matches(x["text"], C.SPANS))).alias("_spans"), named.alias("_named"),
    )


def citations(said_: DataFrame, events: DataFrame) -> DataFrame:
    """Of each case: references, false ones and distinct false ones, chain times, time of the first cited step, and known ids of the texts with claims of time (_gaps, by row).

    event_id is unique within a case.
    """
    chain = F.filter(F.transform(C.chain_of(), lambda s, i: _cited(s["event_id"], True, i, None)), lambda x: x["event_id"] != "")
    listed = F.transform(F.concat(_list("evidence_for"), _list("evidence_against")), lambda x: _cited(x, True, None, None))
    texts = F.flatten(F.transform("_times", lambda x: F.concat(F.array(_cited(F.lit(None).cast("string"), False, None, x["row"])), F.transform(x["ids"], lambda i: _cited(i, False, None, x["row"])))))
    wanted = said_.select("case_id", F.explode(F.concat(*(c.cast(CITED) for c in (chain, listed, texts)))).alias("_x")).select("case_id", "_x.*")
    found = wanted.join(events.select("case_id", "event_id", "t", F.lit(True).alias("_known")), ["case_id", "event_id"], "left")
    cite, lost = F.col("cite"), F.col("_known").isNull()
    by_row = found.groupBy("case_id", "row").agg(
        F.count_if(cite).alias("n"), F.count_if(cite & lost).alias("bad"), F.collect_set(F.when(cite & lost, F.col("event_id"))).alias("bad_ids"),
        F.collect_list(F.when(F.col("pos").isNotNull() & ~lost, F.struct("pos", "t"))).alias("chain"), F.min(F.when(F.col("pos").isNotNull(), F.col("t"))).alias("cited"),
        F.struct("row", F.count_if(~cite & F.col("t").isNotNull()).alias("k"), (F.max(F.when(~cite, F.col("t"))) - F.min(F.when(~cite, F.col("t")))).alias("gap")).alias("gap"),
    )
    return by_row.groupBy("case_id").agg(
        F.sum("n").alias("_refs"), F.sum("bad").alias("_bad"), F.array_distinct(F.flatten(F.collect_list("bad_ids"))).alias("_bad_ids"), F.array_sort(F.flatten(F.collect_list("chain"))).alias("_chain"),
        F.min("cited").alias("_cited"), F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), F.col("gap")))).alias("_gaps"),
    )


def _cited(event_id: Column, cite: bool, pos: Column | None, row: Column | None) -> Column:
    of = lambda c: F.lit(None).cast("int") if c is None else c
    return F.struct(event_id.alias("event_id"), F.lit(cite).alias("cite"), of(pos).alias("pos"), of(row).alias("row"))


def facts(events: DataFrame, wanted: DataFrame, size: Column | None = None) -> DataFrame:
    """Of each case of wanted (case_id, _steps, _named) that has events: their number, downloads, bytes, first and last time, the first time that tells of a step, and the named that are in them.

    A path is in them if a resource begins it or it begins a resource.
    """
    size = size if size is not None else F.col("metadata.file_size_bytes") if "metadata" in events.columns else F.col("bytes") if "bytes" in events.columns else F.lit(0)
    have = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    words = F.lower(F.concat(*(x for c in ("action", "resource", "status") for x in (F.coalesce(have(c), F.lit("")), F.lit(" ")))))
    rows = events.select("case_id", "t", "action", size.cast("long").alias("_size"), have("user").alias("_user"), have("source_ip").alias("_ip"), F.nullif(have("resource"), F.lit("")).alias("_res"), words.alias("_x")).join(wanted, "case_id")
    v = lambda x: x["value"]
    met = lambda x: ((x["type"] == "user") & (v(x) == F.col("_user"))) | ((x["type"] == "ip_address") & (v(x) == F.col("_ip"))) | ((x["type"] == "file_path") & (F.startswith(F.col("_res"), v(x)) | F.startswith(v(x), F.col("_res"))))
    rows = rows.withColumn("_hit", F.filter("_named", met)).withColumn("_tells", F.size(told_steps(F.col("_x"))) > 0)
    download = F.col("action") == "file_download"
    return rows.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_events"), F.count_if(download).alias("_downloads"), F.coalesce(F.sum(F.when(download, F.col("_size"))), F.lit(0)).alias("_bytes"), F.min("t").alias("_first"), F.max("t").alias("_last"),
        F.min(F.when(F.col("_tells"), F.col("t"))).alias("_told_at"), F.array_distinct(F.flatten(F.collect_set(F.when(F.size("_hit") > 0, F.col("_hit"))))).alias("_met"),
    )


def checks(answers: DataFrame, events: DataFrame, truth: DataFrame | None = None, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """A row for each answer: its own columns, all its fact checks, and facts of its case; steps of truth are looked for in events."""
    say = said(answers)
    steps = step_words(truth, keywords) if truth is not None else None
    wanted = say.select("case_id", "_named")
    if steps is not None:
        wanted = wanted.join(steps, "case_id", "full").withColumn("_named", F.coalesce("_named", F.array().cast("array<struct<type: string, value: string>>")))
    else:
        wanted = wanted.withColumn("_steps", F.array().cast("array<struct<step: string, words: array<string>>>"))
    known = facts(events, wanted.withColumn("_steps", F.coalesce("_steps", F.array().cast("array<struct<step: string, words: array<string>>>"))))
    rows = say.join(citations(say, events), "case_id", "left").join(known, "case_id", "full" if truth is not None else "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    number = C._number
    # times: the claims of a text and the known ids of the same text stand at the same place
    shortly = lambda c: F.lower(c).startswith("shortly")
    claimed = lambda c: number(c) * C._unit(c, {"second": 1 / 60, "minute": 1.0, "hour": 60.0})
    off = lambda c, gap: F.when(shortly(c), gap > C.SHORTLY + C.TOLERANCE).otherwise(F.abs(gap - claimed(c)) > C.TOLERANCE)
    wrong_times = F.zip_with("_times", "_gaps", lambda x, g: F.size(F.filter(x["claims"], lambda c: (g["k"] >= 2) & off(c, g["gap"] / 6e7))))
    total = zero("_bytes")
    bytes_ = lambda c: number(c) * C._unit(c, {"byte": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3})
    minute = 6e7
    lasted = lambda c: number(c) * C._unit(c, {"minute": minute, "hour": 60 * minute, "day": 1440 * minute, "week": 10080 * minute})
    slack = lambda c: C._unit(c, {"minute": 5 * minute, "hour": 60 * minute, "day": 1440 * minute, "week": 1440 * minute})
    span = F.coalesce(F.col("_last") - F.col("_first"), F.lit(0))
    count = lambda column, bad: F.size(F.filter(column, bad)).cast("long")
    chain, told = C.chain_of(), F.coalesce("narrative", F.lit(""))
    stated = F.size(chain) + F.when(told != "", 1).otherwise(0)
    good = F.size(F.filter(chain, lambda s: F.coalesce(s["event_id"], F.lit("")) != "")) + F.when(told.rlike(r"(?U)evt_\w+"), 1).otherwise(0)
    late = F.coalesce(F.size(F.filter(F.transform("_chain", lambda x, i: F.struct(x["t"].alias("t"), F.when(i > 0, F.get(F.col("_chain"), i - 1)["t"]).alias("b"))), lambda x: x["t"] < x["b"])), F.lit(0))
    met = F.coalesce("_met", F.array().cast("array<struct<type: string, value: string>>"))
    parts = {
        "total_references": zero("_refs"), "invalid_references": zero("_bad"), "distinct_invalid": F.coalesce(F.size("_bad_ids"), F.lit(0)).cast("long"),
        "chain_length": F.size(chain).cast("long"), "out_of_order": late.cast("long"), "chronologically_correct": late == 0,
        "total_claims": stated.cast("long"), "unsupported_claims": (stated - good).cast("long"), "evidence_grounding": F.when(stated == 0, 100.0).otherwise(F.bround(100.0 * good / F.nullif(stated, F.lit(0)), 2)),
        "temporal_claims": F.aggregate(F.transform("_times", lambda x: F.size(x["claims"])), F.lit(0), lambda a, x: a + x).cast("long"),
        "temporal_errors": F.coalesce(F.aggregate(wrong_times, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        "file_claims": F.size("_files").cast("long"), "file_errors": count("_files", lambda c: F.abs(number(c) - zero("_downloads")) > 1),
        "size_claims": F.when(total > 0, F.size("_sizes")).otherwise(0).cast("long"), "size_errors": F.when(total > 0, count("_sizes", lambda c: (bytes_(c) > 2 * total) | (bytes_(c) < 0.5 * total))).otherwise(0).cast("long"),
        "span_claims": F.size("_spans").cast("long"), "span_errors": count("_spans", lambda c: F.abs(span - lasted(c)) > slack(c)),
        "unknown_names": F.array_except("_named", met), "unknown_entities": F.size(F.array_except("_named", met)).cast("long"),
    }
    rows = rows.select(*answers.columns, "_events", "_first", "_told_at", "_cited", *(c.alias(k) for k, c in parts.items()))
    errors = sum((F.col(c) for c in ERRORS[1:]), F.col(ERRORS[0]))
    return rows.withColumn("hallucination_count", errors).withColumn("clean", errors == 0)


def report(answers: DataFrame, events: DataFrame) -> DataFrame:
    """All checks of each answer and their errors in all: false citations, steps out of order, claims without evidence,
    wrong times, volumes and names. The suspect's check isn't counted."""
    return checks(answers, events).select("case_id", "hallucination_count", "clean", *ERRORS, "evidence_grounding", "chronologically_correct")


def alert_facts(alerts: DataFrame, truth: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Of each case with alerts: their number, warnings, criticals, those that tell of a step, the steps told of, the first time, and its rules (rule_id, alert_count, contributed).

    Alerts are summed by case and rule, then by case.
    """
    rows = alerts.join(step_words(truth, keywords), "case_id", "left").withColumn("_x", F.lower(F.concat_ws(" ", "description", "rule_name")))
    rows = rows.withColumn("_t", F.coalesce(told_steps(F.col("_x")), F.array().cast(IDS)))
    match = F.size("_t") > 0
    kind = lambda s: F.count_if(F.col("severity") == s)
    by_rule = rows.groupBy("case_id", "rule_id").agg(
        F.count(F.lit(1)).alias("n"), kind("warning").alias("w"), kind("critical").alias("c"), F.count_if(match).alias("k"), F.array_distinct(F.flatten(F.collect_set("_t"))).alias("told"), F.min("t").alias("t")
    )
    return by_rule.groupBy("case_id").agg(
        F.sum("n").alias("alert_count"), F.sum("w").alias("warnings"), F.sum("c").alias("criticals"), F.sum("k").alias("_matched"), F.array_distinct(F.flatten(F.collect_list("told"))).alias("_alert_steps"), F.min("t").alias("_alert"),
        F.array_sort(F.collect_list(F.struct("rule_id", F.col("n").alias("alert_count"), (F.col("k") > 0).alias("contributed")))).alias("rule_breakdown"),
    )


def evaluation(truth: DataFrame, alerts: DataFrame, answers: DataFrame, events: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """The evaluation row of each case of truth, with its alerts by rule (rule_breakdown) and their severities.

    Recall, precision and time to detect are for ATTACK cases only, null in others. A case without an answer has a null
    verdict, which maps to UNKNOWN; one without alerts is no_alert. Events are read twice, alerts, answers and truth more often:
    the last three should be written.
    """
    for c in ("confidence", "source"):
        answers = answers if c in answers.columns else answers.withColumn(c, F.lit(None).cast("string"))
    own = answers.select("case_id", F.col("verdict").alias("llm_verdict"), "confidence", "source", "attack_chain", "evidence_for", "evidence_against", "narrative")
    attack = F.col("label") == "ATTACK"
    rows = truth.select("case_id", "label", "attack_steps", (F.col("name") if "name" in truth.columns else F.col("case_id")).alias("case_name"))
    rows = rows.join(step_words(truth, keywords), "case_id").join(checks(own, events, truth, keywords), "case_id", "left").join(alert_facts(alerts, truth, keywords), "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = rows.withColumn("alert_count", zero("alert_count")).withColumn("warnings", zero("warnings")).withColumn("criticals", zero("criticals"))
    rows = rows.withColumn("rule_verdict", F.when(F.col("alert_count") == 0, "no_alert").when(F.col("criticals") > 0, "attack").otherwise("suspicious"))
    rows = rows.withColumn("rule_mapped", label_of("rule_verdict", ("no_alert", "suspicious", "attack"))).withColumn("llm_mapped", label_of("llm_verdict", ("NO", "INSUFFICIENT", "YES")))
    chain = C.chain_of()
    text = F.lower(F.array_join(F.transform(chain, lambda s: F.coalesce(s["description"], F.lit(""))), " "))
    n = F.size("attack_steps")
    rows = rows.withColumn("_told", told_steps(text)).withColumn("_good", F.size(F.filter(chain, lambda s: F.size(told_steps(F.lower(F.coalesce(s["description"], F.lit(""))))) > 0)))
    some = attack & (n > 0)
    d = F.size("_told").cast("long")
    alert_recall = F.size(F.filter("attack_steps", lambda s: F.coalesce(F.array_contains("_alert_steps", s), F.lit(False)))) / F.nullif(n, F.lit(0))
    rows = rows.select(
        "*", F.when(attack, F.when(n == 0, 100.0).otherwise(F.bround(100.0 * d / F.nullif(n, F.lit(0)), 2))).alias("recall_pct"), F.when(some, F.bround(F.col("_matched") / F.nullif("alert_count", F.lit(0)), 4)).alias("rule_precision"),
        F.when(some & (F.size(chain) > 0), F.bround(F.col("_good") / F.nullif(F.size(chain), F.lit(0)), 4)).alias("llm_precision"), F.when(some, alert_recall).alias("_rule_recall"),
    )
    start = F.when(some, F.coalesce("_told_at", "_first"))
    seconds = lambda c: F.bround((F.col(c) - start) / 1e6, 2)
    benign = F.col("label") == "BENIGN"
    false = F.when(benign, F.col("alert_count")).otherwise(0).cast("long")
    missed = F.array_join(F.array_sort(F.filter("attack_steps", lambda s: ~F.array_contains("_told", s))), ",")
    return rows.select(
        "case_id", "case_name", "label", "rule_verdict", "llm_verdict", F.coalesce("confidence", F.lit("N/A")).alias("llm_confidence"), F.coalesce(F.upper("source") == "MOCK", F.lit(False)).alias("is_mock"),
        "rule_mapped", "llm_mapped", (F.col("rule_mapped") == F.col("label")).alias("rule_correct"), (F.col("llm_mapped") == F.col("label")).alias("llm_correct"),
        F.when(attack, n).otherwise(0).cast("long").alias("total_steps"), F.when(attack, d).otherwise(0).cast("long").alias("detected_steps"), "recall_pct", F.when(attack, missed).otherwise("").alias("missed_steps"),
        false.alias("rule_fp_count"), F.coalesce(benign & (F.col("llm_verdict") == "YES"), F.lit(False)).alias("llm_fp"), F.coalesce(F.bround(100.0 * false / F.col("_events"), 2), F.lit(0.0)).alias("false_positive_rate_pct"),
        "rule_precision", "llm_precision", F.when(attack, f1(F.col("rule_precision"), F.col("_rule_recall"))).otherwise(0.0).alias("rule_f1"), F.when(attack, f1(F.col("llm_precision"), F.col("recall_pct") / 100)).otherwise(0.0).alias("llm_f1"),
        seconds("_alert").alias("rule_seconds"), F.when(attack, seconds("_cited")).alias("llm_seconds"), zero("hallucination_count").alias("hallucination_count"),
        F.coalesce("evidence_grounding", F.lit(100.0)).alias("evidence_grounding_pct"), F.coalesce("chronologically_correct", F.lit(True)).alias("timeline_correct"),
        "alert_count", "warnings", "criticals", F.coalesce("rule_breakdown", F.array().cast("array<struct<rule_id: string, alert_count: bigint, contributed: boolean>>")).alias("rule_breakdown"),
    )


#: Columns of the evaluation that are about a case's alerts as such.
ALERTS = ("alert_count", "warnings", "criticals", "rule_breakdown")


def breakdown_text() -> Column:
    """rule_breakdown as text: each rule with its alerts, and whether one tells of a step."""
    return F.array_join(F.transform("rule_breakdown", lambda r: F.concat(r["rule_id"], F.lit(" "), r["alert_count"].cast("string"), F.when(r["contributed"], " told").otherwise(""))), ", ")


def results_of(evaluations: DataFrame) -> DataFrame:
    """The rules' result of each case, as the rules' own summary gives it."""
    rules = F.array_join(F.transform("rule_breakdown", lambda r: r["rule_id"]), ",")
    return evaluations.select("case_id", "alert_count", rules.alias("rules_triggered"), "warnings", "criticals", F.col("rule_verdict").alias("verdict"))
