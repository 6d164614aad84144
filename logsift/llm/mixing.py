"""Mixing sources to target weights by pivotal rounding: fractional copy probabilities are paired, mass in words moves
at random until one of a pair is integral, and what stays fractional goes up a reduction tree."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, words_of

#: Weights of the sources in order, repeating, and the share of all words that the mix takes.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
#: Documents that one task rounds, and tasks whose remainders the next level of the tree combines.
LEAF_ROWS = 20_000
FAN_IN = 64


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Words to take of each source: by weight, at most limit times its own, the excess shared anew by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    size, total = dict(order), share * sum(n for _, n in order)
    done: dict[str | None, float] = {}
    while len(done) < len(size):
        left = total - sum(done.values())
        whole = sum(w for s, w in weight.items() if s not in done)
        over = [s for s in size if s not in done and left * weight[s] / whole > limit * size[s]]
        if not over:
            return done | {s: left * weight[s] / whole for s in size if s not in done}
        done |= {s: limit * size[s] for s in over}
    return done


def _coin(seed: str, *ids: int) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{ids}".encode(), digest_size=7).digest(), "big") / 2**56


def pivotal(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, seed: str) -> np.ndarray:
    """Probabilities after pairing: all integral but one at most, and the sum of sizes * p is as before.

    Documents are taken largest first, each paired with all smaller ones as one pool that shares a probability shift:
    while they have the same probability the pool is one unit; mass moves up or down, with the chances that keep the
    expectation, until the document or the pool is integral. What stays fractional is small, unless a document is larger
    than all smaller ones together: the pool may then be integral first, and the document is rounded by itself, which
    puts its source off by half that document at most.
    """
    order = np.lexsort((ids, -sizes))
    out = p.astype(float).copy()
    if len(set(np.round(p, 12))) > 1:  # remainders of other tasks: pairs, smaller ones first
        return _pairs(ids, sizes, out, order[::-1], seed)
    q = float(out[order[0]]) if len(order) else 0.0
    rest = float(sizes.sum())
    for k in order:
        s = float(sizes[k])
        rest -= s
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[k] = round(q)
            continue
        if rest <= 0.5:
            out[k] = q
            continue
        up, down = min(1 - q, q * rest / s), min(q, (1 - q) * rest / s)
        step = up if _coin(seed, int(ids[k])) < down / (up + down) else -down
        out[k] = q + step
        q -= step * s / rest
        out[k] = round(out[k]) if abs(out[k] - round(out[k])) < 1e-9 else out[k]
        q = round(q) if abs(q - round(q)) < 1e-9 else q
    open_ = np.flatnonzero((out > 0) & (out < 1))
    return _pairs(ids, sizes, out, open_, seed) if len(open_) > 1 else out


def _pairs(ids: np.ndarray, sizes: np.ndarray, p: np.ndarray, order: np.ndarray, seed: str) -> np.ndarray:
    """Classical pairs along order: each step makes one of two integral."""
    hold = -1
    for k in order:
        if p[k] <= 1e-9 or p[k] >= 1 - 1e-9:
            p[k] = round(p[k])
            continue
        if hold < 0:
            hold = k
            continue
        a, b, r = p[hold], p[k], sizes[k] / sizes[hold]
        up, down = min(1 - a, b * r), min(a, (1 - b) * r)  # of hold
        step = up if _coin(seed, int(ids[hold]), int(ids[k])) < down / (up + down) else -down
        p[hold], p[k] = a + step, b - step / r
        for j in (hold, k):
            if abs(p[j] - round(p[j])) < 1e-9:
                p[j] = round(p[j])
        hold = next((j for j in (hold, k) if 0 < p[j] < 1), -1)
    return p


def _leaf(seed: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rid")
        rows["p"] = pivotal(rows["_rid"].to_numpy(np.int64), rows["size"].to_numpy(float), rows["p"].to_numpy(float), seed)
        return rows

    return run


def copies(sized: DataFrame, seed: str = "mix") -> DataFrame:
    """_rid, copies and the size, source_size and target of every row of sized (_rid, source, size).

    Rows without words have no copy. The last remainder of a source is rounded to the nearer whole number.
    """
    spark = sized.sparkSession
    sources = [(r["source"], r["n"] or 0, r["k"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k")).collect()]  # a row for each source
    want = targets([(s, n) for s, n, _ in sources])
    rows = [(s, n, float(want[s]), want[s] / n if n else 0.0, max(1, -(-k // LEAF_ROWS))) for s, n, k in sources]
    facts = spark.createDataFrame(rows, "_s string, source_size long, target double, rate double, leaves int") if rows else spark.createDataFrame([], "_s string, source_size long, target double, rate double, leaves int")
    joined = sized.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("_s")))
    whole = F.floor(F.col("rate") + 1e-12)
    joined = joined.select("_rid", "source", "size", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p"), F.pmod(F.xxhash64("_rid"), F.col("leaves")).cast("int").alias("leaf"))
    schema = "_rid long, source string, size long, source_size long, target double, whole long, p double, leaf int"
    settled, level, most = joined.where("size = 0").withColumn("p", F.lit(0.0)), 0, max([1, *(r[4] for r in rows)])
    open_ = joined.where("size > 0")
    while True:
        done = materialize(open_.groupBy("source", "leaf").applyInPandas(_leaf(f"{seed}{level}"), schema))
        if most == 1:
            settled = settled.unionByName(done)
            break
        settled = settled.unionByName(done.where("p = 0 or p = 1"))
        open_ = done.where("p > 0 and p < 1").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("int"))
        most, level = -(-most // FAN_IN), level + 1
    return settled.select("_rid", "size", "source_size", "target", (F.col("whole") + F.when(F.col("p") >= 0.5, 1).otherwise(0)).cast("long").alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    """_rid, doc_id, source and size: the number of words of the whole text (null: 0)."""
    rows = keyed(docs, "source")
    return materialize(rows.select("_rid", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (copies times size) of every row of docs (doc_id, text, source).

    Null source is a source of its own, the last. Null or empty text: size 0, nothing taken. A source without words has
    target 0. Rows that repeat a doc_id count each on its own. Reruns give the same rows.
    """
    rows = sized(docs)
    return rows.select("_rid", "doc_id").join(copies(rows.drop("doc_id")), "_rid").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the mix, with the named columns: each document of docs (doc_id, text, source) as often as it is taken.

    Rows without words aren't taken. Null source is a source of its own. Rows that repeat a doc_id count each on its own.
    No rows: no rows.
    """
    base = keyed(docs, *columns)
    rows = materialize(base.select("_rid", F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size")))
    taken = copies(rows).where("copies > 0").select("_rid", F.expr("array_repeat(0, cast(copies as int))").alias("_n"))
    return base.join(taken.hint("shuffle_hash"), "_rid").select(*columns, F.explode("_n").alias("_x")).drop("_x")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
