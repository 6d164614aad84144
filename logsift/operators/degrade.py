"""Degraded events and answers, and what their runs are scored by; all random choices are seeded hashes, alike on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import chain_of
from .evaluate import chain_texts, recall
from .windows import HOUR, MINUTE

LEVELS, TRIALS = (0, 20, 40, 60, 80), 3
JITTERS = (0, 5 * MINUTE, 30 * MINUTE, 2 * HOUR)
#: Words that tell of an attack step in robustness runs.
KEYWORDS = {
    "failed_login_attempts": ["failed login", "brute", "credential"],
    "login_unusual_ip": ["unusual ip", "tor", "external ip", "185.220"],
    "privilege_escalation": ["privilege", "escalat", "read_write"],
    "bulk_file_download": ["bulk download", "exfiltrat", "mass download", "multiple file"],
    "log_deletion": ["log delet", "anti-forensic", "cover track"],
    "logout": ["logout", "session end"],
    "login_normal": ["login", "normal login", "authenticated"],
    "minor_privilege_change": ["privilege", "access grant", "role change"],
    "slow_scope_expansion_day1": ["day 1", "reconnaissance", "read"],
    "slow_scope_expansion_day2": ["day 2", "lateral", "download"],
    "systematic_download_day3": ["day 3", "systematic", "bulk"],
    "data_exfiltration_complete": ["exfiltrat", "collection", "download"],
    "session_hijack_ip_change": ["session hijack", "ip change", "ip switch"],
    "unauthorized_hr_access_1": ["hr", "unauthorized", "human resource"],
    "unauthorized_hr_access_2": ["hr", "unauthorized", "human resource"],
    "unauthorized_hr_access_3": ["hr", "unauthorized", "human resource"],
    "sql_injection_probe": ["sql injection", "sql", "injection"],
    "credential_dump": ["credential dump", "credential", "dump"],
    "authentication_with_stolen_creds": ["stolen cred", "compromised cred", "login"],
    "database_exfiltration": ["database", "exfiltrat", "db"],
    "file_server_access": ["file server", "lateral", "file access"],
    "dns_tunnel_exfiltration": ["dns tunnel", "tunnel", "dns exfil"],
    "log_deletion_cleanup": ["log delet", "cleanup", "anti-forensic"],
}


def _unit(digest: Column) -> Column:
    """A number from 0 to 1 of a digest's first 32 bits."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def moved(micros: int, seed: int = 42) -> Column:
    """An event's time moved by up to micros either way; null stays null."""
    unit = _unit(F.md5(F.concat(F.col("event_id"), F.lit(f"|{micros}|{seed}"))))
    return F.col("t") + F.round((2 * unit - 1) * micros).cast("long")


def jitter(events: DataFrame, micros: int, seed: int = 42) -> DataFrame:
    return events.withColumn("t", moved(micros, seed))


def chain_in_order(answers: DataFrame) -> DataFrame:
    """Whether the step numbers of each answer's chain never fall."""
    steps = F.transform(chain_of(), lambda s: F.coalesce(s["step"], F.lit(0)))
    return answers.select("case_id", F.forall(F.transform(steps, lambda x, i: F.struct(x.alias("x"), F.get(steps, i - 1).alias("b"))), lambda p: F.coalesce(p["b"] <= p["x"], F.lit(True))).alias("chain_in_order"))


def step_recall(truth: DataFrame, answers: DataFrame, keywords: dict[str, list[str]] = KEYWORDS) -> DataFrame:
    """Percentage of attack steps that an answer's chain or narrative tells of."""
    return recall(truth, chain_texts(answers, narrative=True), keywords).select("case_id", "recall_pct")


def verdict_correct(verdict: Column, label: Column) -> Column:
    """YES stands for an attack, all else for none."""
    return F.when(F.trim(F.upper(verdict)) == "YES", "ATTACK").otherwise("BENIGN") == label


def surviving(answers: DataFrame, events: DataFrame) -> DataFrame:
    """Answers with the steps and evidence only whose ids are still among their case's events; steps without an id go."""
    ids = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in (F.transform(chain_of(), lambda s: s["event_id"]), F.col("evidence_for"), F.col("evidence_against"))))
    cited = answers.select("case_id", F.explode(F.array_distinct(ids)).alias("event_id"))
    left = cited.join(events.select("case_id", "event_id").distinct(), ["case_id", "event_id"], "left_semi").groupBy("case_id").agg(F.collect_set("event_id").alias("_ids"))
    known = lambda x: F.coalesce(F.array_contains("_ids", x), F.lit(False))
    rows = answers.join(left, "case_id", "left").withColumn("attack_chain", F.filter(chain_of(), lambda s: known(s["event_id"])))
    for c in ("evidence_for", "evidence_against"):
        rows = rows.withColumn(c, F.filter(c, known))
    return rows.drop("_ids")
