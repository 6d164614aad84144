"""Robustness runs as bitmaps: each event carries the set of runs that keep it, a bit for each, so that rules over single events,
citations and counts are worked out once for all runs, and window rules count all runs beside each other. No event is copied by run.

A removal run (level, trial) takes away the level's percentage of a case's events, rounded down, those with the least seeded hash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .degrade import JITTERS, LEVELS, TRIALS, chain_in_order, moved, step_recall, verdict_correct
from .rules import REGISTRY, Row, Windowed, privilege_then_download_runs, row_alerts, window_runs
from .windows import HOUR

#: First hexadecimal digits of a hash by which a large case's events are counted before any are put in order.
SLOT_DIGITS = 2
#: Events of a case whose ids may meet in one row.
WHOLE = 20_000
LAST = "struct<h: string, seq: bigint>"


def grid(levels: tuple[int, ...] = LEVELS, trials: int = TRIALS) -> list[tuple[int, int]]:
    """(level, trial) of each run; level 0 is one run."""
    return [(p, k) for p in levels for k in range(1, (trials if p else 1) + 1)]


def bit(r: int | Column, column: str = "runs") -> Column:
    """1 if the bitmap has run r, else 0."""
    return F.shiftright(F.col(column), r).bitwiseAND(F.lit(1)) if isinstance(r, int) else F.call_function("shiftright", F.col(column), r).bitwiseAND(F.lit(1))


def with_runs(events: DataFrame, levels: tuple[int, ...] = LEVELS, trials: int = TRIALS, seed: int = 42, whole: int = WHOLE) -> DataFrame:
    """events with runs, the bitmap of the runs (by place in grid) that keep each.

    Of a case of up to whole events the last one that each run takes is found among its ids, which meet in one row; of a
    larger one by hash slots. Hashes are worked out where they are compared and never exchanged. Only case_id, event_id and
    seq are used: callers that need no other columns should give no others.
    """
    plan = grid(levels, trials)
    text = lambda p, k: F.lit(f"|{p}|{k}|{seed}")
    large = F.broadcast(events.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select("case_id"))
    ids = events.select("case_id", "event_id", "seq")
    last = _last_of_small(ids.join(large, "case_id", "left_anti"), plan, text).unionByName(_last_of_large(ids.join(large, "case_id", "left_semi"), plan, text))
    gone = lambda r, p, k: F.struct(F.md5(F.concat("event_id", text(p, k))).alias("h"), F.col("seq").alias("seq")) <= F.get("_last", F.lit(r))
    drop = reduce(Column.bitwiseOR, [F.when(gone(r, p, k), F.lit(1 << r)).otherwise(F.lit(0)).cast("long") for r, (p, k) in enumerate(plan)])
    every = (1 << len(plan)) - 1
    return events.join(last.hint("shuffle_hash"), "case_id", "left").withColumn("runs", F.lit(every).cast("long").bitwiseXOR(drop)).drop("_last")


def _last_of_small(ids: DataFrame, plan: list[tuple[int, int]], text: Callable[[int, int], Column]) -> DataFrame:
    """case_id and _last: hash and seq of the last event that each run takes, null for a run that takes none."""
    rows = ids.groupBy("case_id").agg(F.collect_list(F.struct("event_id", "seq")).alias("_e"))
    ranked = lambda p, k: F.sort_array(F.transform("_e", lambda x: F.struct(F.md5(F.concat(x["event_id"], text(p, k))).alias("h"), x["seq"].alias("seq"))))
    cut = lambda p: F.floor(F.size("_e") * p / 100).cast("int")
    return rows.select("case_id", F.array(*(F.when(cut(p) > 0, F.get(ranked(p, k), cut(p) - 1)).cast(LAST) if p else F.lit(None).cast(LAST) for p, k in plan)).alias("_last"))


def _last_of_large(ids: DataFrame, plan: list[tuple[int, int]], text: Callable[[int, int], Column]) -> DataFrame:
    """The same of cases of any size: events are counted by run and hash slot, and only those of the slot in which a run's cut
    falls are put in order, so a case is many tasks' work."""
    hashed = ids.withColumn("_h", F.array(*(F.md5(F.concat("event_id", text(p, k))) for p, k in plan)))
    slot = lambda h: F.substring(h, 1, SLOT_DIGITS)
    counts = hashed.select("case_id", F.posexplode(F.transform("_h", slot)).alias("run", "slot")).groupBy("case_id", "run", "slot").agg(F.count(F.lit(1)).alias("n"))
    level = F.array(*(F.lit(p) for p, _ in plan))[F.col("run")]
    by = Window.partitionBy("case_id", "run")
    counts = counts.withColumn("through", F.sum("n").over(by.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))).withColumn("cut", F.floor(F.sum("n").over(by) * level / 100))
    cuts = counts.where("through >= cut and through - n < cut").groupBy("case_id").agg(F.collect_list(F.struct("run", "slot", (F.col("cut") - F.col("through") + F.col("n")).alias("need"))).alias("_cuts"))
    near = hashed.join(F.broadcast(cuts), "case_id").withColumn("_c", F.explode(F.filter("_cuts", lambda c: slot(F.get(F.col("_h"), c["run"])).eqNullSafe(c["slot"]))))
    near = near.select("case_id", "_c.run", "_c.need", F.struct(F.get(F.col("_h"), F.col("_c.run")).alias("h"), "seq").alias("last"))
    found = near.withColumn("_k", F.row_number().over(by.orderBy("last"))).where("_k = need")
    return found.groupBy("case_id").agg(F.array(*(F.max(F.when(F.col("run") == r, F.col("last"))).cast(LAST) for r in range(len(plan)))).alias("_last"))


def unfolded(rows: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """rows (with runs) once for each run that keeps them, with its level and trial."""
    runs = F.filter(F.array(*(F.struct(F.lit(i).alias("run"), F.lit(p).alias("level"), F.lit(k).alias("trial")) for i, (p, k) in enumerate(plan))), lambda g: bit(g["run"]) == 1)
    return rows.withColumn("_g", F.explode(runs)).select(*(c for c in rows.columns if c != "runs"), "_g.level", "_g.trial")


def _per_run(sums: DataFrame, plan: list[tuple[int, int]], *keys: str) -> DataFrame:
    """Rows (keys, level, trial, n) of sums whose column n is an array by run."""
    runs = F.array(*(F.struct(F.lit(p).alias("level"), F.lit(k).alias("trial")) for p, k in plan))
    return sums.select(*keys, F.explode(F.arrays_zip(runs.alias("g"), F.col("n").alias("n"))).alias("_x")).select(*keys, "_x.g.level", "_x.g.trial", "_x.n")


def _kept(plan: list[tuple[int, int]]) -> Column:
    return F.array(*(F.sum(bit(i)) for i in range(len(plan)))).alias("n")


def run_name(*columns: str) -> Column:
    return F.concat_ws("#", *(F.col(c).cast("string") for c in columns))


def degraded_results(events: DataFrame, baselines: DataFrame, params: dict[str, dict] | None = None, levels: tuple[int, ...] = LEVELS, trials: int = TRIALS, suspicious: int = 3) -> DataFrame:
    """alert_count, number of distinct rules, and verdict of every removal run of events with runs (case_id#level#trial).

    Rules over single events run once, their alerts count for all runs that keep the event. So do pairs, for the runs that keep
    both, and windows, which count the events of each run beside each other. suspicious needs as many warnings.
    """
    plan, args = grid(levels, trials), params or {}
    made = {k: f(**args.get(k, {})) for k, f in REGISTRY.items() if k != "R008"}
    single = row_alerts(events, baselines, [r for r in made.values() if isinstance(r, Row)], ("runs",), ids=False)
    columns = ("case_id", "rule_id", "severity")
    once = single.select(*columns, "runs").unionByName(privilege_then_download_runs(events, **args.get("R008", {})))
    name = run_name("case_id", "level", "trial").alias("case_id")
    all_ = _per_run(once.groupBy(*columns).agg(_kept(plan)), plan, *columns).where("n > 0").select(name, "rule_id", "severity", "n")
    windows = window_runs(events, [r for r in made.values() if isinstance(r, Windowed)], len(plan)).groupBy(*columns, "run").agg(F.count(F.lit(1)).alias("n"))
    runs = F.array(*(F.struct(F.lit(p).alias("level"), F.lit(k).alias("trial")) for p, k in plan))
    all_ = all_.unionByName(windows.withColumn("_g", F.get(runs, F.col("run"))).select("*", "_g.*").select(name, "rule_id", "severity", "n"))
    kind = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0))
    sums = all_.groupBy("case_id").agg(F.sum("n").alias("n"), F.countDistinct("rule_id").alias("k"), kind("critical").alias("c"), kind("warning").alias("w"))
    cases = _per_run(events.groupBy("case_id").agg(_kept(plan)), plan, "case_id").where("n > 0").select(name)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    verdict = F.when(F.col("c") > 0, "attack").when(F.col("w") >= suspicious, "suspicious").otherwise("no_alert")
    return cases.join(sums, "case_id", "left").select("case_id", zero("n").alias("alert_count"), zero("k").alias("rules_triggered"), verdict.alias("verdict"))


def cited_ids(answers: DataFrame) -> DataFrame:
    """case_id and each distinct event id that an answer's chain or evidence cites."""
    from .answers import citations

    return citations(answers).where("event_id is not null").distinct()


def removal_scores(answers: DataFrame, truth: DataFrame, events: DataFrame, levels: tuple[int, ...] = LEVELS, trials: int = TRIALS) -> DataFrame:
    """Of each case and removal run: verdict, whether it is right, recall, distinct citations that the run doesn't keep, and events left.

    events have runs. Recall is an answer's, the same in all runs; citations meet the events once.
    """
    plan = grid(levels, trials)
    left = _per_run(events.groupBy("case_id").agg(_kept(plan)), plan, "case_id").where("n > 0").withColumnRenamed("n", "events_remaining")
    met = cited_ids(answers).join(events.select("case_id", "event_id", "runs"), ["case_id", "event_id"], "left").withColumn("runs", F.coalesce("runs", F.lit(0).cast("long")))
    lost = met.groupBy("case_id").agg(F.array(*(F.sum(1 - bit(i)) for i in range(len(plan)))).alias("n"))
    lost = _per_run(lost, plan, "case_id").withColumnRenamed("n", "hallucinations")
    rows = left.join(_scored(answers, truth), "case_id").join(lost, ["case_id", "level", "trial"], "left")
    return rows.select("case_id", "level", "trial", "verdict", "correct", "recall_pct", F.coalesce("hallucinations", F.lit(0)).cast("long").alias("hallucinations"), F.col("events_remaining").cast("long").alias("events_remaining"))


def _scored(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Verdict, whether it is right, and recall of each case of truth; no answer: UNKNOWN."""
    rows = truth.join(answers.select("case_id", "verdict"), "case_id", "left").join(step_recall(truth, answers), "case_id")
    return rows.select("case_id", F.coalesce("verdict", F.lit("UNKNOWN")).alias("verdict"), verdict_correct(F.coalesce("verdict", F.lit("")), F.col("label")).alias("correct"), "recall_pct")


def orders_kept(events: DataFrame, jitters: tuple[int, ...] = JITTERS) -> DataFrame:
    """case_id, jitter and order_kept: whether each case's events stay in their order of time if times move by up to jitter.

    One pass for all jitters. An order is kept if every event stays after the one before it, which is looked at within slices
    of an hour, and between the last and first events of slices that follow each other; so a case is many tasks' work.
    """
    places = F.array(*(F.struct(moved(w).alias("t"), F.col("seq").alias("seq")) for w in jitters))
    rows = events.where("t is not null").select("case_id", "t", "seq", F.floor(F.col("t") / HOUR).alias("slice"), places.alias("at"))
    before = F.lag("at").over(Window.partitionBy("case_id", "slice").orderBy("t", "seq"))
    good = lambda a, b: F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] < x["b"])
    rows = rows.withColumn("_b", before).withColumn("ok", F.when(F.col("_b").isNull(), F.array_repeat(F.lit(True), len(jitters))).otherwise(good(F.col("_b"), F.col("at"))))
    every = lambda c: [F.bool_and(F.get(F.col(c), F.lit(i))) for i in range(len(jitters))]
    ends = rows.groupBy("case_id", "slice").agg(F.array(*every("ok")).alias("ok"), F.min_by("at", F.struct("t", "seq")).alias("first"), F.max_by("at", F.struct("t", "seq")).alias("last"))
    ends = ends.withColumn("_b", F.lag("last").over(Window.partitionBy("case_id").orderBy("slice")))
    ends = ends.withColumn("across", F.when(F.col("_b").isNull(), F.array_repeat(F.lit(True), len(jitters))).otherwise(good(F.col("_b"), F.col("first"))))
    sums = ends.groupBy("case_id").agg(F.array(*(a & b for a, b in zip(every("ok"), every("across"), strict=True))).alias("kept"))
    widths = F.array(*(F.lit(w).cast("long") for w in jitters))
    return sums.select("case_id", F.explode(F.arrays_zip(widths.alias("jitter"), F.col("kept").alias("order_kept"))).alias("_x")).select("case_id", "_x.*")


def jitter_scores(answers: DataFrame, truth: DataFrame, events: DataFrame, jitters: tuple[int, ...] = JITTERS) -> DataFrame:
    """Of each case and jitter: verdict, whether it is right, recall, whether the order of time is kept and the chain's steps are in order."""
    rows = orders_kept(events, jitters).join(_scored(answers, truth), "case_id").join(chain_in_order(answers), "case_id", "left")
    return rows.select("case_id", "jitter", "verdict", "correct", "recall_pct", "order_kept", F.coalesce("chain_in_order", F.lit(True)).alias("chain_in_order"))


def mode_scores(by_mode: dict[str, DataFrame], truth: DataFrame, events: DataFrame) -> DataFrame:
    """Of each case and mode (from raw logs, from the whole pipeline): verdict, whether it is right, recall and distinct false citations.

    The answers of all modes meet the events once.
    """
    name = "mode"
    all_ = reduce(DataFrame.unionByName, [a.select("case_id", "verdict", "attack_chain", "evidence_for", "evidence_against", "narrative", F.lit(m).alias(name)) for m, a in by_mode.items()])
    tagged = all_.withColumn("case_id", run_name("case_id", name))
    ids = cited_ids(tagged).withColumn("_case", F.substring_index("case_id", "#", 1))
    known = events.select(F.col("case_id").alias("_case"), "event_id", F.lit(True).alias("_known"))
    lost = ids.join(known, ["_case", "event_id"], "left").groupBy("case_id").agg(F.count_if(F.col("_known").isNull()).alias("_n"))
    of_mode = reduce(DataFrame.unionByName, [truth.select("case_id", "label", "attack_steps", F.lit(m).alias(name)) for m in by_mode]).withColumn("case_id", run_name("case_id", name))
    rows = _scored(tagged, of_mode).join(lost, "case_id", "left")
    return rows.select(F.substring_index("case_id", "#", 1).alias("case_id"), F.substring_index("case_id", "#", -1).alias(name), "verdict", "correct", "recall_pct", F.coalesce("_n", F.lit(0)).cast("long").alias("hallucinations"))


def all_scores(removal: DataFrame, jitter: DataFrame, mode: DataFrame) -> DataFrame:
    """One table of the scores of all kinds of runs: kind, run, and null for what a kind doesn't have."""
    none = lambda t: F.lit(None).cast(t)
    shape = lambda rows, kind, run, lost=none("long"), left=none("long"), kept=none("boolean"), chain=none("boolean"): rows.select(
        "case_id", F.lit(kind).alias("kind"), run.alias("run"), "verdict", "correct", "recall_pct", lost.alias("hallucinations"), left.alias("events_remaining"), kept.alias("order_kept"), chain.alias("chain_in_order")
    )
    return (
        shape(removal, "removal", run_name("level", "trial"), F.col("hallucinations"), F.col("events_remaining"))
        .unionByName(shape(jitter, "jitter", F.col("jitter").cast("string"), kept=F.col("order_kept"), chain=F.col("chain_in_order")))
        .unionByName(shape(mode, "mode", F.col("mode"), F.col("hallucinations")))
    )


def accuracy_by_run(scores: DataFrame) -> DataFrame:
    """Runs, share of right verdicts and mean recall by kind and level of degradation (trials of a level together)."""
    level = F.when(F.col("kind") == "removal", F.substring_index("run", "#", 1)).otherwise(F.col("run"))
    return scores.groupBy("kind", level.alias("level")).agg(F.count(F.lit(1)).alias("runs"), F.bround(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), F.bround(F.avg("recall_pct"), 4).alias("recall_pct"))
