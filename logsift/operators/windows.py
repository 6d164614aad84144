"""Sliding windows over events that start or end at an event, and what they need.

Windows are worked out per key and slice of time, so a key that holds any share of the events is many tasks' work, and with
running counts only, so that dense windows cost no more than sparse ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
#: Widths of a window in one slice of time.
SLICE = 8


def same(left: str, right: str, keys: list[str]) -> Column:
    """Equality of keys of two aliased tables, null equal to null."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys))


def id_list(ids: Column) -> Column:
    """Event ids of an array of structs (order, event_id) in order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(ids), lambda x: x["event_id"]), ",")


def attach_ids(found: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """found (keys, rn, last) with event_ids of the rows rn to last of their key: an equality join on the place."""
    places = found.withColumn("_k", F.explode(F.sequence("rn", "last")))
    joined = places.alias("a").join(rows.select(*keys, "rn", "event_id").alias("b"), same("a", "b", keys) & (F.col("a._k") == F.col("b.rn")))
    cols = dict.fromkeys([*keys, "rn", "last", *columns])
    return joined.groupBy(*(F.col(f"a.{c}") for c in cols)).agg(id_list(F.collect_list(F.struct(F.col("b.rn").alias("rn"), F.col("b.event_id").alias("event_id")))).alias("event_ids"))


def sliced(rows: DataFrame, width: Column, before: int, after: int) -> DataFrame:
    """rows with a time, by slice (_s) of SLICE widths; _own is false for those that only help a slice next to theirs.

    A row also goes to the slice after if it is within before widths of it, and to the one before if within after widths.
    """
    size = width * SLICE
    at = F.pmod(F.col("t"), size)
    own = F.expr("t - _at") / size
    rows = rows.where("t is not null").withColumn("_at", at).withColumn("_slice", F.round(own).cast("long"))
    spot = lambda k, mine: F.struct((F.col("_slice") + k).alias("s"), F.lit(mine).alias("own"))
    spots = F.array(spot(0, True), F.when(F.col("_at") < after * width, spot(-1, False)), F.when(F.col("_at") >= size - before * width, spot(1, False)))
    return rows.withColumn("_x", F.explode(F.array_compact(spots))).withColumn("_s", F.col("_x.s")).withColumn("_own", F.col("_x.own")).drop("_x", "_at", "_slice")


def _numbered(rows: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """rn, the place of each row within its key, and cum, the sum of weight through it."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    return rows.withColumn("rn", F.row_number().over(order)).withColumn("cum", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def sliding(
    events: DataFrame, keys: list[str], width: Column | int, hit: Column | str, weight: Column | str | None = None, columns: tuple[str, ...] = (), kinds: tuple[str, ...] = (), once: Column | None = None, ids: bool = True
) -> DataFrame:
    """Windows [t, t + width] from each event on that meet hit (over n, their events, total, the sum of weight, and
    n_kinds, how many of the source types in kinds they hold).

    A window counts only if it holds an event that no earlier hit of its key holds. Ends never go back, so that is a last
    row beyond the hit's before. Where once is true, the first hit of each time counts instead. Gives keys, t, seq,
    timestamp, n, total, found_kinds, columns and event_ids. Events without a time are in no window.

    Without ids a window has its first and last event in their place: one row for each hit, however many events it holds. The
    last one comes with the running counts, so rows meet by exchange once only.
    """
    width = F.lit(width).cast("long") if isinstance(width, int) else width
    weight = F.lit(1) if weight is None else F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0))
    part = [*keys, "_s"]
    rows = _numbered(sliced(events.withColumn("_width", width).withColumn("_weight", weight.cast("long")), F.col("_width"), 1, 1), part, F.col("_weight"))
    # each row again at the end of its window: what has come by then
    ends = rows.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", F.col("t") + F.col("_end") * F.col("_width"))
    by_then = Window.partitionBy(*part).orderBy("_at", "_end", "t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    come = F.col("_end") == 0
    ends = ends.withColumn("last", F.max(F.when(come, F.col("rn"))).over(by_then)).withColumn("top", F.max(F.when(come, F.col("cum"))).over(by_then))
    ends = ends.withColumn("last_event", F.max(F.when(come, F.struct("rn", "event_id"))).over(by_then)["event_id"])
    latest = F.array(*(F.struct(F.lit(k).alias("kind"), F.max(F.when(come & (F.col("source_type") == k), F.col("rn"))).over(by_then).alias("rn")) for k in sorted(kinds)))
    if kinds:
        ends = ends.withColumn("_latest", latest).where("_end = 1").withColumn("found_kinds", F.transform(F.filter("_latest", lambda x: x["rn"] >= F.col("rn")), lambda x: x["kind"]))
    else:
        ends = ends.where("_end = 1").withColumn("found_kinds", F.array().cast("array<string>"))
    ends = ends.withColumn("n_kinds", F.size("found_kinds")).withColumn("n", F.col("last") - F.col("rn") + 1).withColumn("total", F.col("top") - F.col("cum") + F.col("_weight"))
    order = Window.partitionBy(*part).orderBy("t", "seq")
    hits = ends.where(hit).withColumn("_last", F.lag("last").over(order)).withColumn("_t", F.lag("t").over(order))
    fresh = F.col("last") > F.coalesce("_last", F.lit(0))
    if once is not None:
        fresh = F.when(once, F.coalesce(F.col("_t") != F.col("t"), F.lit(True))).otherwise(fresh)
    hits, of_hit = hits.where(fresh & F.col("_own")), ["t", "seq", "timestamp", "n", "total", "found_kinds", *columns]
    return attach_ids(hits, rows, part, of_hit) if ids else hits.select(*part, "rn", "last", *of_hit, F.col("event_id").alias("first_event"), "last_event")


def sliding_runs(events: DataFrame, keys: list[str], width: Column, hit: Column, runs: int, weight: Column | str, kinds: tuple[str, ...] = (), once: Column | None = None) -> DataFrame:
    """keys and run of each window that sliding() finds among the events of a run; runs, a column, has bit r set for the
    events of run r, of so many. Events aren't copied by run: each has its running counts of all runs beside each other, and
    only windows are told apart.
    """
    part, of = [*keys, "_s"], range(runs)
    weight = F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0)).cast("long")
    has = lambda r: F.col("runs").bitwiseAND(F.lit(1 << r).cast("long")) != 0
    rows = sliced(events.withColumn("_width", width).withColumn("_weight", weight), F.col("_width"), 1, 1)
    through = Window.partitionBy(*part).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(F.when(has(r), v).otherwise(F.lit(0))).over(through).alias(f"{c}{r}") for r in of for c, v in (("_rn", F.lit(1)), ("_cum", F.col("_weight")))))
    ends = rows.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", F.col("t") + F.col("_end") * F.col("_width"))
    by_then = Window.partitionBy(*part).orderBy("_at", "_end", "t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    top = lambda c, r, when=F.lit(True): F.max(F.when((F.col("_end") == 0) & when, F.col(f"{c}{r}"))).over(by_then)
    tops = [top(c, r).alias(f"_top{c}{r}") for r in of for c in ("_rn", "_cum")]
    ends = ends.select("*", *tops, *(top("_rn", r, (F.col("source_type") == k) & has(r)).alias(f"_kind{i}_{r}") for r in of for i, k in enumerate(kinds))).where("_end = 1")
    n_kinds = lambda r: reduce(lambda a, b: a + b, (F.when(F.col(f"_kind{i}_{r}") >= F.col(f"_rn{r}"), 1).otherwise(0) for i in range(len(kinds))), F.lit(0))
    windows = [
        F.when(has(r), F.struct(F.lit(r).alias("run"), F.col(f"_top_rn{r}").alias("last"), (F.col(f"_top_rn{r}") - F.col(f"_rn{r}") + 1).alias("n"), (F.col(f"_top_cum{r}") - F.col(f"_cum{r}") + F.col("_weight")).alias("total"), n_kinds(r).alias("n_kinds")))
        for r in of
    ]
    found = ends.select(*part, "t", "seq", "_own", F.explode(F.array_compact(F.array(*windows))).alias("_w")).select(*part, "t", "seq", "_own", "_w.*").where(hit)
    order = Window.partitionBy(*part, "run").orderBy("t", "seq")
    found = found.withColumn("_last", F.lag("last").over(order)).withColumn("_t", F.lag("t").over(order))
    fresh = F.col("last") > F.coalesce("_last", F.lit(0))
    if once is not None:
        fresh = F.when(once, F.coalesce(F.col("_t") != F.col("t"), F.lit(True))).otherwise(fresh)
    return found.where(fresh & F.col("_own")).select(*keys, "run")


def trailing(events: DataFrame, keys: list[str], width: int, threshold: int) -> DataFrame:
    """Windows [t - width, t] with more than threshold events, the first to end for each first event."""
    part = [*keys, "_s"]
    rows = _numbered(sliced(events, F.lit(width).cast("long"), 2, 0), part, F.lit(1))
    starts = rows.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", F.col("t") - F.col("_end") * F.lit(width).cast("long"))
    by_then = Window.partitionBy(*part).orderBy("_at", F.col("_end").desc(), "t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = starts.withColumn("start", F.coalesce(F.max(F.when(F.col("_end") == 0, F.col("rn"))).over(by_then), F.lit(0)) + 1)
    found = starts.where((F.col("_end") == 1) & (F.col("rn") - F.col("start") + 1 > threshold))
    found = found.withColumn("_k", F.row_number().over(Window.partitionBy(*part, "start").orderBy("rn"))).where("_k = 1 and _own")
    found = found.withColumn("last", F.col("rn")).withColumn("rn", F.col("start"))
    return attach_ids(found, rows, part, ["t", "timestamp"])


def followed_by(first: DataFrame, later: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of an event (aliased c) and one of the same key after it, within width (aliased d).

    Time is cut to slots of width: an event looks in its own slot and the next one.
    """
    c = first.withColumn("slot", F.explode(F.array(F.floor(F.col("t") / width), F.floor(F.col("t") / width) + 1))).alias("c")
    d = later.withColumn("slot", F.floor(F.col("t") / width)).alias("d")
    return c.join(d, same("c", "d", keys) & (F.col("c.slot") == F.col("d.slot")) & (F.col("d.t") > F.col("c.t")) & (F.col("d.t") <= F.col("c.t") + width))


def placed(rows: DataFrame, keys: list[str], slot: Column, order: list[Column]) -> DataFrame:
    """rows with position, their place from 1 within keys in order of slot and then order.

    Rows are counted by slot and numbered within it, so a key that holds any share of the rows is many tasks' work.
    """
    rows = rows.withColumn("_slot", slot)
    counts = rows.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col("_slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_before", before).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))).drop("_n")
    local = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order)))
    joined = local.alias("a").join(offsets.alias("b"), same("a", "b", [*keys, "_slot"]))
    return joined.select("a.*", (F.col("b._before") + F.col("a._k")).cast("long").alias("position"), F.col("b._total").alias("total_rows")).drop("_k", "_slot")


def running(rows: DataFrame, keys: list[str], slot: Column, order: list[Column | str], weight: Column, name: str) -> DataFrame:
    """rows with name, the sum of weight over the rows before each within keys, in order of slot and then order.

    Each slot sums up by itself and is given the sum of the slots before it, so a key that holds any share of the rows is many
    tasks' work. A row of sums for each slot is all that meets by key.
    """
    rows = rows.withColumn("_slot", slot).withColumn("_w", weight.cast("long"))
    earlier = Window.partitionBy(*keys).orderBy(F.col("_slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_slot").agg(F.sum("_w").alias("_n")).withColumn("_c", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_k", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    joined = local.alias("a").join(carry.alias("b"), same("a", "b", [*keys, "_slot"]))
    return joined.select("a.*", (F.col("b._c") + F.col("a._k")).alias(name)).drop("_k", "_slot", "_w")


def previous(rows: DataFrame, keys: list[str], slot: Column, order: list[str], column: str, name: str) -> DataFrame:
    """rows with name, the column of the row before within keys, in order of slot and then order; sliced as in running()."""
    rows, it = rows.withColumn("_slot", slot), F.struct(F.col(column).alias("v"))
    lasts = rows.groupBy(*keys, "_slot").agg(F.max_by(it, F.struct(*order)).alias("_l"))
    carry = lasts.withColumn("_c", F.lag("_l").over(Window.partitionBy(*keys).orderBy(F.col("_slot").asc_nulls_first()))).drop("_l")
    local = rows.withColumn("_k", F.lag(it).over(Window.partitionBy(*keys, "_slot").orderBy(*order)))
    joined = local.alias("a").join(carry.alias("b"), same("a", "b", [*keys, "_slot"]))
    return joined.select("a.*", F.coalesce("a._k", "b._c")["v"].alias(name)).drop("_k", "_slot")


def chunked(rows: DataFrame, keys: list[str], slot: Column, order: list[Column], item: Column, name: str, size: int, by: str = ",") -> DataFrame:
    """The items of each key in order, joined, in rows of size items: keys, chunk (from 0), first (place from 1), n and name.

    No row grows with its key; whoever wants one key's list whole joins its chunks. Null items count as empty ones.
    """
    at = placed(rows.withColumn("_i", F.coalesce(item, F.lit(""))), keys, slot, order)
    cut = at.withColumn("chunk", F.floor((F.col("position") - 1) / size))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("_i").alias("i")))), lambda x: x["i"]), by)
    return cut.groupBy(*keys, "chunk").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("n"), listed.alias(name))
