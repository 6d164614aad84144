"""Analysts' answers: parsing, and fact checks against the events of their case.

An answer is a row (case_id, verdict, suspect, attack_chain array of (step, event_id, description), evidence_for,
evidence_against, narrative); null lists and texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .claims import CHAIN, chain_of

SCHEMA = f"verdict string, suspect string, attack_chain {CHAIN}, evidence_for array<string>, evidence_against array<string>, narrative string"
_IDS = ("evidence_for", "evidence_against")


def _list(column: str, kind: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast(kind))


def parse(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Answer fields from free text: a fenced block, else the whole text, else what the outermost braces hold."""
    body = F.coalesce(F.col(text), F.lit(""))
    tries = [F.regexp_extract(body, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.trim(body), F.regexp_extract(body, r"(?s)(\{.*\})", 1)]
    found = F.coalesce(*(F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t) for t in tries))
    return raw.withColumn("_a", F.from_json(found, SCHEMA)).select(*(c for c in raw.columns if c != text), "_a.*", found.isNull().alias("parse_failed"), F.when(found.isNull(), body).alias("raw"))


def citations(answers: DataFrame) -> DataFrame:
    """case_id and event_id of every citation, repeats too."""
    chain = F.filter(F.transform(chain_of(), lambda s: s["event_id"]), lambda x: x.isNotNull() & (x != ""))
    return answers.select("case_id", F.explode(F.concat(chain, *(_list(c, "array<string>") for c in _IDS))).alias("event_id"))


def event_references(answers: DataFrame, events: DataFrame) -> DataFrame:
    """Citations of each answer, and how many aren't events of its case."""
    known = events.select("case_id", "event_id").distinct().withColumn("_known", F.lit(True))
    hits = citations(answers).join(known, ["case_id", "event_id"], "left")
    sums = hits.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_known").isNull()).alias("bad"), F.countDistinct(F.when(F.col("_known").isNull(), F.col("event_id"))).alias("bad_ids"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return answers.select("case_id").join(sums, "case_id", "left").select("case_id", zero("n").alias("total_references"), zero("bad").alias("invalid_references"), zero("bad_ids").alias("distinct_invalid"))


def timeline_correctness(answers: DataFrame, events: DataFrame) -> DataFrame:
    """Steps of each chain that stand earlier in time than the step before, among steps that cite known events."""
    steps = answers.select("case_id", F.posexplode(chain_of()).alias("pos", "s")).select("case_id", "pos", F.col("s.event_id").alias("event_id"))
    timed = steps.join(events.select("case_id", "event_id", "t"), ["case_id", "event_id"])
    timed = timed.withColumn("_before", F.lag("t").over(Window.partitionBy("case_id").orderBy("pos")))
    sums = timed.groupBy("case_id").agg(F.count_if(F.col("t") < F.col("_before")).alias("late"))
    size = F.size(chain_of()).cast("long")
    late = F.coalesce("late", F.lit(0)).cast("long")
    return answers.select("case_id", size.alias("chain_length")).join(sums, "case_id", "left").select("case_id", "chain_length", late.alias("out_of_order"), (late == 0).alias("chronologically_correct"))


def unsupported_claims(answers: DataFrame) -> DataFrame:
    """Claims (steps, and a narrative if there is one) without an event id, and the percentage of those with one."""
    told, chain = F.coalesce("narrative", F.lit("")), chain_of()
    total = F.size(chain) + F.when(told != "", 1).otherwise(0)
    good = F.size(F.filter(chain, lambda s: F.coalesce(s["event_id"], F.lit("")) != "")) + F.when(told.rlike(r"(?U)evt_\w+"), 1).otherwise(0)
    return answers.select("case_id", total.cast("long").alias("total_claims"), (total - good).cast("long").alias("unsupported_claims"), F.when(total == 0, 100.0).otherwise(F.bround(100.0 * good / F.nullif(total, F.lit(0)), 2)).alias("evidence_grounding"))


def actor_references(answers: DataFrame, events: DataFrame) -> DataFrame:
    """Whether the suspect is a user of the case, and the case's users in order."""
    users = events.where("user <> ''").groupBy("case_id").agg(F.array_sort(F.collect_set("user")).alias("_u"))
    named = answers.select("case_id", "suspect").join(users, "case_id", "left")
    return named.select("case_id", "suspect", F.coalesce(F.array_contains("_u", F.col("suspect")), F.lit(False)).alias("suspect_in_events"), F.coalesce(F.array_join("_u", ","), F.lit("")).alias("actors"))
