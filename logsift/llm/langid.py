"""Language by words first: known words count by their log frequency in each language, unseen words by
their longest known character n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, materialize, small_batches

#: Documents whose words are learned, for each language about; all of them if there are fewer.
FIT_ROWS = 1000
#: Rank in count, for each language, of the last words and n-grams of each order that the model keeps; all that share
#: that rank's count are kept too.
TOP_WORDS = 20_000
TOP_GRAMS = 20_000
#: Words seen less often are told by their n-grams.
KNOWN_TIMES = 2
ORDERS = (5, 4, 3, 2, 1)
#: Log of the weight that a step to shorter n-grams costs.
BACKOFF = math.log(0.4)
CACHE = 150_000
ALNUM = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def words_in(text: str | None) -> list[str]:
    """Runs of letters in lower case; figures such as ½ or Ⅷ aren't letters."""
    found = ALNUM.findall((text or "").lower())
    if "".join(found).isalpha():
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and n-grams by language in a task's rows, given out whenever they grow large."""

    def out() -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "kind", "item", "n"])

    seen: dict[tuple[str, int, str], int] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            words: dict[str, int] = {}
            for w in words_in(text):
                words[w] = words.get(w, 0) + 1
            for w, n in words.items():
                seen[lang, 0, w] = seen.get((lang, 0, w), 0) + n
                padded = f"<{w}>"
                for k in ORDERS:
                    for i in range(len(padded) - k + 1):
                        g = (lang, k, padded[i : i + k])
                        seen[g] = seen.get(g, 0) + n
            if len(seen) > CACHE:
                yield out()
                seen = {}
    yield out()


class WordModel:
    """Log frequencies of words and n-grams by language; score() caches what it has worked out."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        totals = np.ones((len(ORDERS) + 1, len(self.langs)))
        for lang, kind, _, n in rows:
            totals[kind, at[lang]] += n
        self.items: dict[tuple[int, str], np.ndarray] = {}
        for lang, kind, item, n in rows:
            self.items.setdefault((kind, item), np.full(len(self.langs), 0.5))[at[lang]] += n
        for (kind, item), x in self.items.items():
            self.items[kind, item] = np.log(x / totals[kind])
        self.floor = np.full(len(self.langs), -18.0)
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def word(self, w: str) -> np.ndarray:
        """The word's own log frequencies or, unseen, the mean of those of its n-grams."""
        known = self.items.get((0, w))
        if known is not None:
            return known
        padded, total, n, i = f"<{w}>", np.zeros(len(self.langs)), 0, 0
        while i < len(padded):
            cost = BACKOFF
            for k in ORDERS:
                if i + k <= len(padded) and (x := self.items.get((k, padded[i : i + k]))) is not None:
                    total += x + cost
                    i += k
                    break
                cost += BACKOFF
            else:
                total += self.floor
                i += 1
            n += 1
        return total / max(1, n)

    def row(self, w: str) -> int:
        k = self.index.get(w)
        if k is None:
            if len(self.index) >= CACHE:
                self.index.clear()
            k = self.index[w] = len(self.index)
            if k >= len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[k] = self.word(w)
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_in(text)
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        for i in range(0, len(words), 4096):  # the cache may be emptied between runs, not within one
            part = words[i : i + 4096]
            if len(self.index) + len(part) > CACHE:
                self.index.clear()
            total += self.table[[self.row(w) for w in part]].sum(0) if all(w in self.index for w in part) else self._fresh(part)
        mean = total / len(words) * min(len(words), 20)
        p = np.exp(mean - mean.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())

    def _fresh(self, words: list[str]) -> np.ndarray:
        rows = [self.row(w) for w in words]
        return self.table[rows].sum(0)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[str, int, str, int]]:
    """(language, 0 or the n-gram's length, item, count) of the labelled documents outside the held-out fold.

    About fit_rows documents of each language are learned from, chosen by a hash of doc_id. Of their words and n-grams the
    most frequent ones are kept, through rank TOP_WORDS and TOP_GRAMS, with all of the last one's count.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id")))
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, fit_rows / r["count"]))).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    counts = picked.mapInArrow(_counts, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where((F.col("kind") > 0) | (F.col("n") >= KNOWN_TIMES)))
    # the count of the item at the last rank, from the number of items of each count: few, as the counts' sum is bounded
    hist: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for r in counts.groupBy("lang", "kind", "n").count().collect():
        hist.setdefault((r["lang"], r["kind"]), []).append((r["n"], r["count"]))
    least: dict[tuple[str, int], int] = {}
    for (lang, kind), found in hist.items():
        left = TOP_GRAMS if kind else TOP_WORDS
        for n, items in sorted(found, reverse=True):
            least[lang, kind] = n
            left -= items
            if left <= 0:
                break
    keep = F.lit(False)
    for (lang, kind), c in least.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("kind") == kind) & (F.col("n") >= c))
    rows = [(r["lang"], r["kind"], r["item"], r["n"]) for r in counts.where(keep).collect()]
    return sorted(rows)


def predict_language(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text, lang).

    Learned from text and lang of the rows outside the held-out fold only. Null text or none with a letter:
    'und', score 0; so are all rows if nothing was learned. A null doc_id is in no fold and isn't learned from.
    Rows that repeat a doc_id are predicted each on its own.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordModel(model.value)
        for batch in batches:
            found = [words.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), in_fold(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return predict_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))
