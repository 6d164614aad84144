"""Toxicity through a noisy channel: what leetspeak, spacing and repetition may stand for forms a lattice,
which is decoded by Viterbi under a character model of the corpus; the restored words are scored."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_fold, materialize, slices, small_batches

#: Labelled documents that the scorer learns from at most, chosen by a hash of doc_id.
FIT_ROWS = 6_000
#: Classes of characters: 0 for what isn't a letter, 1 to 26 for a to z with and without accents, the rest for the letters
#: of other scripts, dealt by code point. From FROM_HERE on every character counts as a letter.
CLASSES = 64
FROM_HERE = 0x3400
PREFIXES = (4, 5, 6, 7)
#: Least log likelihood ratio by which a feature's toxic rate is above the base rate.
EVIDENCE = 14.0
THRESHOLD = 0.3
CACHE = 100_000
#: Least hashes that tell near copies among the labelled documents: half of them are equal.
SIGNS = 32
SIGN_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, SIGNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: What a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
_UNIT = "(?:[^\\W\\d_]|[01345789@$!|+])"
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_-]{1,2}[^\W\d_]){2,}(?![^\W_])")
#: The same with letters and what may stand for one, and words in pieces of up to three.
MIXED = re.compile(rf"(?<![^\W_]){_UNIT}(?:[ .*_-]{{1,2}}{_UNIT}){{2,}}(?![^\W_])")
PIECES = re.compile(rf"(?<![^\W_]){_UNIT}{{1,3}}(?:[ .*_-]{{1,2}}{_UNIT}{{1,3}})+(?![^\W_])")
#: The last two characters of whatever SPACED or MIXED find; far faster to look for, and few texts have any.
ENDING = re.compile(rf"[ .*_-]{_UNIT}[ .*_-]{{1,2}}{_UNIT}(?![^\W_])")
CUT = re.compile(r"[ .*_-]+")
CLOSING = tuple(",.;:?")
INNER = re.compile(r"[^\w@$!|+]+|_+")
PART = re.compile(r"[^\W_]+(?:[@$!|+]+[^\W_]+)*|[@$][^\W\d_][^\W_]*")
REPEATED = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"(.)\1")


def letter_class(c: str) -> int:
    low = c.lower()[:1]
    base = unicodedata.normalize("NFD", low)[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 + ord(low) % (CLASSES - 27) if low.isalpha() or ord(low) >= FROM_HERE else 0


@lru_cache(1)
def class_table() -> np.ndarray:
    """letter_class of every code point."""
    table = 27 + np.arange(0x110000) % (CLASSES - 27)
    table[:FROM_HERE] = [letter_class(chr(c)) for c in range(FROM_HERE)]
    return table.astype(np.uint8)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, table = np.zeros(CLASSES**3, np.int64), class_table()
    for batch in batches:
        for part in slices(batch):
            text = "\n".join(x or "" for x in part.column("text").to_pylist())
            x = np.concatenate(([0, 0], table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], [0])).astype(np.int32)
            total += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=CLASSES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a class of letter (0: anything else) after two others, from the trigrams of all whole texts."""
    small_batches(docs.sparkSession)
    sums = docs.select(docs["text"].alias("text")).mapInArrow(_trigrams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    for r in sums:  # CLASSES**3 at most
        n[r["gram"]] = r["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    uni = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    bi = (n.sum(0) + 5 * uni) / (n.sum((0, 2))[:, None] + 5)
    return np.log((n + 5 * bi[None]) / (n.sum(2, keepdims=True) + 5))


class Restorer:
    """Words that a token of a text stands for."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.classes: dict[str, int] = {}

    def decode(self, seen: str, drop_spaces: bool = False) -> str:
        """The likeliest letters behind the characters seen; best paths are kept for each pair of last letters."""
        lm = self.model
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for i, c in enumerate(seen):
            if c in " .*_-" and drop_spaces:
                continue
            options: list[tuple[str, float]] = [(x, -1.0) for x in LEET.get(c, "")]
            if c.isalpha():
                options.append((c, 0.0))
            run = (i and seen[i - 1] == c) or seen[i + 1 : i + 2] == c
            if i and seen[i - 1] == c and (seen[i - 2 : i - 1] == c or seen[i + 1 : i + 2] == c):
                options.append(("", -0.5))  # one of three or more in a row
            if not options or not (c.isalpha() or c in LEET):
                options.append((c, -4.0))
            elif c.isdigit() and not run:
                options.append((c, -8.0))
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (p, s) in states.items():
                for x, cost in options:
                    if not x:
                        key, q, t = (a, b), p + cost, s
                    else:
                        k = self.classes.get(x)
                        if k is None:
                            k = self.classes[x] = letter_class(x)
                        key, q, t = (b, k), p + cost + lm[a][b][k], s + x
                    if key not in nxt or q > nxt[key][0]:
                        nxt[key] = (q, t)
            states = nxt
        return max((p + lm[a][b][0], s) for (a, b), (p, s) in states.items())[1]

    def token(self, token: str) -> list[str]:
        """Restored words of one token without blanks, in lower case."""
        if token.isalpha() and not REPEATED.search(token):
            return [token]
        out = []
        for part in PART.findall(token):
            if part.isalpha() and not REPEATED.search(part):
                out.append(part)
            elif any(c.isalpha() for c in part):
                out.append(self.decode(part))
        return out

    def spaced(self, text: str) -> list[str]:
        """Words written letter by letter."""
        if not ENDING.search(text):
            return []
        mixed = [m for m in MIXED.findall(text) if any(c.isalpha() for c in m) and any(c in LEET for c in m)]
        return [self.decode(m, True) for m in [*SPACED.findall(text), *mixed]]

    def text(self, text: str | None) -> str:
        """The whole restored text: its words, and those spelled out."""
        low = (text or "").lower()
        return " ".join([*(w for t in low.split() for w in self.token(t)), *self.spaced(low)])


def beginnings(word: str) -> list[str]:
    return [f"{word[:k]}~" for k in PREFIXES if len(word) > k]


def features(word: str) -> list[str]:
    return [word, *beginnings(word)]


def fit(docs: DataFrame, labels: DataFrame, lm: np.ndarray, fit_rows: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """Toxic rates of telling words, and of beginnings of words that don't tell themselves; the rate of documents without any.

    Learned from at most fit_rows labelled documents outside the held-out fold. A beginning is judged by the words left
    once the telling ones are taken out, so that no word makes others that begin alike suspect.
    """
    spark = docs.sparkSession
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").alias("_id"), "toxic")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    shared = spark.sparkContext.broadcast(lm)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            words = [set(restore.text(t).split()) for t in batch.column("text").to_pylist()]
            signs = [word_signature(x).tobytes() for x in words]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(map(sorted, words), pa.list_(pa.string())), pa.array(signs, pa.binary())], names=["toxic", "words", "sign"])

    texts = materialize(sample.mapInArrow(restored, "toxic int, words array<string>, sign binary"))
    whole = texts.agg(F.count_if(F.col("toxic") <= 0).alias("clean"), F.count_if(F.col("toxic") > 0).alias("bad")).first()
    if not whole["bad"]:
        discard(texts)
        return {}, 0.0
    base = (whole["bad"] + 1) / (whole["clean"] + whole["bad"] + 2)
    words = telling(texts, lambda w: [w], base)
    weights = words | telling(texts, lambda w: [] if w in words else beginnings(w), base)
    kept = spark.sparkContext.broadcast(set(weights))

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = [not any(f in kept.value for w in x for f in features(w)) for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.bool_()), batch.column("toxic")], names=["none", "toxic"])

    left = texts.select("words", "toxic").mapInArrow(without, "none boolean, toxic int").where("none").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") > 0).alias("bad")).first()
    discard(texts)
    return weights, min(THRESHOLD / 2, (left["bad"] + base) / (left["n"] + 1))


def telling(texts: DataFrame, of: Callable[[str], list[str]], base: float) -> dict[str, float]:
    """Toxic rates of the features of words (of) that texts (toxic, words, sign) give evidence for, near copies counted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["feature", "clean", "bad"])

        for batch in batches:
            for words, toxic in zip(batch.column("words").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f in {f for w in words for f in of(w)}:
                    seen.setdefault(f, [0, 0])[int(toxic > 0)] += 1
            if len(seen) > CACHE:
                yield out()
                seen.clear()
        yield out()

    sums = texts.select("words", "toxic").mapInArrow(count, "feature string, clean long, bad long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    rate = F.col("bad") / (F.col("clean") + F.col("bad"))
    gain = F.col("bad") * F.log(rate / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    rows = sums.where(F.col("bad") > 1).withColumn("gain", gain).where((rate >= 0.5) & (F.col("gain") > EVIDENCE)).orderBy("feature").collect()  # as many as FIT_ROWS documents give evidence for
    rates = {r["feature"]: (r["bad"] + base) / (r["bad"] + r["clean"] + 1) for r in rows}
    share = texts.sparkSession.sparkContext.broadcast(set(rates))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in x for f in of(w)} & share.value) for x in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column("sign")], names=["found", "sign"])

    bad = texts.where("toxic > 0").select("words", "sign").mapInArrow(held, "found array<string>, sign binary").collect()  # FIT_ROWS at most
    return {f: rates[f] for f in spread([(x["found"], x["sign"]) for x in sorted(bad)], {r["feature"]: r["clean"] for r in rows}, base)}


def word_signature(words: set[str]) -> np.ndarray:
    """Least hashes of the words; near copies share most of them."""
    codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words] or [0], np.uint64)
    return ((codes[:, None] * SIGN_FACTORS) >> np.uint64(32)).min(0).astype(np.uint32)


def spread(bad: list[tuple[list[str], bytes]], clean: dict[str, int], base: float) -> set[str]:
    """The features with evidence if near copies among the documents of label 1 (features, signature) count once.

    clean: documents of label 0 with each feature. Else any word of a toxic text that has many copies would tell.
    """
    signs = np.array([np.frombuffer(x, np.uint32) for _, x in bad]).reshape(len(bad), SIGNS)
    families: dict[str, set[int]] = {f: set() for f in clean}
    for i, (found, _) in enumerate(bad):
        first = int(((signs[: i + 1] == signs[i]).sum(1) * 2 >= SIGNS).argmax())  # the earliest near copy, or itself
        for f in found:
            families[f].add(first)
    out = set()
    for f, n in clean.items():
        k = len(families[f])
        rate = k / max(1, k + n)
        gain = k * math.log(max(rate, 1e-9) / base) + (n * math.log((1 - rate) / (1 - base)) if n else 0.0)
        if k > 1 and rate >= 0.5 and gain > EVIDENCE:
            out.add(f)
    return out


class Scorer:
    def __init__(self, lm: np.ndarray, weights: dict[str, float], base: float):
        self.restore, self.weights, self.base = Restorer(lm), weights, base
        self.cache: dict[str, tuple[float, bool]] = {}
        self.begins = {f.rstrip("~")[:k] for f in weights for k in range(len(f) + 1)}
        self.heads = {f.rstrip("~")[: PREFIXES[0]] for f in weights}

    def _step(self, found: set[str], c: str) -> set[str]:
        """Beginnings of telling features that found and one more character may stand for."""
        options = LEET.get(c, "") + (c if c.isalpha() else "")
        out = {b for p in found for x in options if (b := p + x) in self.begins}
        return out | {p for p in found if p and p[-1] in options}  # one of two in a row

    def doubled(self, t: str) -> tuple[float, bool]:
        """Rate of what a token with doubled letters stands for if copies are dropped, and whether a whole word tells."""
        best, found = (0.0, False), {""}
        for i, c in enumerate(t):
            if not (found := self._step(found, c)):
                return best
            if i + 1 < len(t):
                best = max(best, *((self.weights.get(f"{p}~", 0.0), False) for p in found))
        return max(best, *((self.weights.get(p, 0.0), True) for p in found))

    def pieces(self, text: str) -> list[float]:
        """Rates of the telling words that stand in pieces of one to three characters, from any piece to any later one."""
        rates = []
        for run in PIECES.findall(text):
            units = CUT.split(run)
            for i in range(len(units) - 1):
                found, letters = {""}, False
                for k in range(i, len(units)):
                    for c in units[k]:
                        letters |= c.isalpha()
                        if not (found := self._step(found, c)):
                            break
                    if not found:
                        break
                    if k > i and letters:
                        rates += [w for p in found if (w := self.weights.get(p, 0.0))]
        return rates

    def word(self, w: str) -> tuple[float, bool]:
        """Rate of a word, and whether the whole word tells."""
        if w in self.weights:
            return self.weights[w], True
        return max((self.weights.get(f, 0.0) for f in beginnings(w)), default=0.0), False

    def token(self, t: str) -> tuple[float, bool]:
        """Rate of a token, and whether a whole word tells; plain words that begin as no telling one have none."""
        t = t[:-1] if t.endswith(CLOSING) and t[:-1].isalpha() else t
        if t.isalpha() and t[: PREFIXES[0]] not in self.heads and not DOUBLED.search(t):
            return 0.0, False
        best = max((self.word(w) for w in self.restore.token(t)), default=(0.0, False))
        return max(best, *map(self.doubled, PART.findall(t))) if not best[0] and DOUBLED.search(t) and PART.search(t) else best

    def score(self, text: str | None) -> float:
        """1 less the product of 1 less the rates of the telling words, or the rate of documents without any.

        One word that only begins as toxic ones do counts half: nothing else in the text bears it out.
        """
        low, cache, rates, sure = (text or "").lower(), self.cache, [], False
        if len(cache) > CACHE:
            cache.clear()
        for t in set(low.split()):
            p = cache.get(t)
            if p is None:
                p = cache[t] = self.token(t)
            if p[0]:
                rates.append(p[0])
                sure |= p[1]
        spelled = [p for w in self.restore.spaced(low) if (p := self.word(w))[0]]
        rates += [p for p, _ in spelled]
        sure |= any(x for _, x in spelled)
        pieces = self.pieces(low)
        rates += pieces
        if not rates:
            return self.base
        return max(self.base, rates[0] / 2) if len(rates) == 1 and not (sure or pieces) else 1 - math.prod(1 - p for p in rates)


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    The character model counts all whole texts; labels are learned outside the held-out fold only. Null, empty or
    wordless text scores as a document without telling words does. Without labels every score is 0. A null doc_id
    is in no fold. Rows that repeat a doc_id are scored each on its own; of several labels of an id the higher counts.
    """
    small_batches(docs.sparkSession)
    lm = character_model(docs)
    model = docs.sparkSession.sparkContext.broadcast((lm, *fit(docs, labels, lm, fit_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            scores = np.array([scorer.score(x) for x in batch.column("_text").to_pylist()], float)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), in_fold(docs["doc_id"]).alias("held_out"), docs["text"].alias("_text"))
    return rows.mapInArrow(run, SCHEMA)


def keep_nontoxic(docs: DataFrame, labels: DataFrame, columns: list[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, with the named columns, that aren't predicted toxic.

    Null, empty and wordless texts stay, as do all rows if there are no labels. Rows that repeat a doc_id are judged each on
    its own. No rows: no rows.
    """
    small_batches(docs.sparkSession)
    lm = character_model(docs)
    model = docs.sparkSession.sparkContext.broadcast((lm, *fit(docs, labels, lm, fit_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(x) < THRESHOLD for x in batch.column("text").to_pylist()], pa.bool_()))

    rows = docs.select(*columns)
    return rows.mapInArrow(run, rows.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
