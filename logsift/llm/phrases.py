"""Phrase collocations by prefix-free parsing: texts are cut where their content says so into overlapping chunks, which form a
dictionary with the number of times each is parsed; n-grams are counted inside distinct chunks, each times the chunk's number,
and belong to the chunk they start in, so that overlaps count once."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hot_join, materialize, mix, salted_join, slices, small_batches, text_bytes
from .terms import LOWER, Spans, byte_set, token_spans

BLANKS, BREAKS = byte_set(b" \t"), byte_set(b".,;:!?\n\x0b\x0c\r")
LONGEST = 5
LEAST = 100
TOP = 2_000
#: A chunk starts at one in so many pairs of words, by their hash; it overlaps the next one by LONGEST - 1 words.
TRIGGER = 64
#: Bytes of chunks that a task counts or holds at once.
BLOCK_BYTES = 4 << 20
HELD_BYTES = 32 << 20
#: Bits of the filter that tells which shorter phrases are frequent; a power of two. All that is broadcast.
FILTER_BITS = 1 << 26
SALTS = 64


def lang_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def parse(docs: DataFrame, longest: int = LONGEST, trigger: int = TRIGGER) -> DataFrame:
    """lang, chunk, own, n: the dictionary of distinct chunks, the words of each that are its own (the others are the next one's) and its parses.

    A chunk's words stand with one blank between those of a piece and a line feed between pieces, A-Z in lower case.
    """
    small_batches(docs.sparkSession)
    apart = BLANKS | BREAKS

    def cut(part: pa.RecordBatch) -> Iterator[tuple[str, bytes, int]]:
        data, offsets = text_bytes(part.column("text"))
        data = LOWER[data]
        starts, stops, owner = token_spans(data, offsets, apart)
        if not len(starts):
            return
        piece = np.concatenate(([0], np.cumsum(BREAKS[data])))[starts] + owner
        sizes = stops - starts + 1
        ends = np.cumsum(sizes)
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        last = ends - 1
        at[last] = 0
        line = data[at]
        line[last] = np.where(np.concatenate((piece[1:] != piece[:-1], [True])), 10, 32)
        head = ends - sizes
        pairs = Spans(line).one(head[:-1], last[1:]) if len(head) > 1 else np.zeros(0, np.uint64)
        begins = np.concatenate(([True], (owner[1:] != owner[:-1])))
        begins[:-1] |= pairs % np.uint64(trigger) == 0
        first = np.flatnonzero(begins)
        stop = np.concatenate((first[1:], [len(head)]))
        # words that follow within the piece of the chunk's last word
        piece_end = np.searchsorted(piece, piece[stop - 1], side="right")
        reach = np.minimum(stop + longest - 1, piece_end)
        raw, langs = line.tobytes(), part.column("lang").to_pylist()
        for a, b, own, o in zip(head[first], last[reach - 1], stop - first, owner[first], strict=True):
            yield langs[o], raw[a:b], int(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0

        def out() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int64()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "chunk", "own", "n"])

        for batch in batches:
            for part in slices(batch):
                for key in cut(part):
                    held[key] += 1
                    size += len(key[1]) + 200
                if size > HELD_BYTES:
                    yield out()
                    size = 0
        yield out()

    rows = docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"].alias("text"))
    chunks = rows.mapInArrow(run, "lang string, chunk binary, own long, n long")
    return chunks.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def frequent(chunks: DataFrame, n: int, least: int, shorter: DataFrame | None, bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, f: the phrases of n words with f >= least.

    Only those whose first and last n - 1 words may both be frequent are counted: a filter of fixed size has all frequent
    ones (and others by chance, which cost time only), as no phrase stands more often than a part of it.
    """
    mask = chunks.sparkSession.sparkContext.broadcast(membership(shorter, bits)) if shorter is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "chunk", BLOCK_BYTES):
                yield count_block(part, n, mask and mask.value)

    rows = chunks.mapInArrow(run, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def count_block(part: pa.RecordBatch, n: int, mask: np.ndarray | None) -> pa.RecordBatch:
    """Distinct phrases of n words of some chunks, each with its occurrences times the chunks' parses."""
    data, offsets = text_bytes(part.column("chunk"))
    starts, stops, owner = token_spans(data, offsets, byte_set(b" \n"))
    names = part.column("lang").dictionary_encode()
    codes = np.array([lang_code(x) for x in names.dictionary.to_pylist()], np.uint64)
    lang = names.indices.to_numpy(zero_copy_only=False)[owner]
    own, times = (part.column(c).to_numpy(zero_copy_only=False) for c in ("own", "n"))
    piece = np.concatenate(([0], np.cumsum(data == 10)))[starts] + owner
    place = np.arange(len(starts)) - np.searchsorted(owner, owner)
    m = max(0, len(starts) - n + 1)
    begin = np.flatnonzero((piece[:m] == piece[len(starts) - m :]) & (place[:m] < own[owner[:m]]))
    hashes = Spans(data)
    if mask is not None:
        for shift in (0, 1):
            i = begin + shift
            begin = begin[may_hold(mask, hashes.one(starts[i], stops[i + n - 2]) ^ codes[lang[i]])] if len(begin) else begin
    a, b = starts[begin], stops[begin + n - 1]
    one, two = hashes.one(a, b) ^ codes[lang[begin]], hashes.two(a, b)
    _, first, group = np.unique(one, return_index=True, return_inverse=True)
    if len(first) and (two != two[first][group]).any():  # one hash for two phrases: both hashes tell them apart
        _, first, group = np.unique(np.stack((one, two), 1), axis=0, return_index=True, return_inverse=True)
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, group, times[owner[begin]])
    a, b = a[first], b[first]
    ends = np.cumsum(b - a)
    at = np.repeat(a - (ends - (b - a)), b - a) + np.arange(ends[-1] if len(ends) else 0)
    text = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(data[at])).cast(pa.string())
    names = names.dictionary.take(pa.array(lang[begin[first]], pa.int32())) if len(first) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays([names, text, pa.array(sums)], names=["lang", "phrase", "f"])


def probes(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a filter."""
    return keys & np.uint64(bits - 1), mix(keys) & np.uint64(bits - 1)


def may_hold(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = probes(keys, len(mask) * 64)
    held = lambda x: (mask[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
    return held(one) & held(two)


def membership(phrases: DataFrame, bits: int) -> np.ndarray:
    """The filter that has all phrases, as words of 64 bits: bits / 64 rows at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("phrase"))
            codes = np.array([lang_code(x) for x in batch.column("lang").to_pylist()], np.uint64)
            at = np.unique(np.concatenate(probes(Spans(data).one(offsets[:-1], offsets[1:]) ^ codes, bits))).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = phrases.select("lang", "phrase").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    mask = np.zeros(bits // 64, np.uint64)
    mask[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return mask


def cut_score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """1000 * a * n div (l * r), exact: decimals of up to 38 digits."""
    big = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (big(a) * big(n)), big(l) * big(r)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the top collocations of each language.

    Texts in lower case (A-Z only) are split at [.,;:!?] and line breaks into pieces, pieces at blanks and tabs into words. A
    candidate is a phrase of 2 to longest words that stands at least least times in a language's pieces, overlaps
    included; null lang is und. Its score is that of its worst cut, of equal ones the shortest first part; a candidate that is
    part of a longer one that stands as often is dropped. Equal scores go by a, then by the phrase's bytes. Null and empty
    texts have no words; very long ones are parsed whole. Ids are not read: rows that repeat count each. No rows: no rows.
    """
    chunks = materialize(parse(docs, longest))
    written, tables = [chunks], []
    for n in range(1, longest + 1):
        tables.append(materialize(frequent(chunks, n, least, tables[-1] if tables else None, bits).withColumn("words", F.lit(n))))
    words = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    every, found = tables[0], tables[1]
    for t in tables[1:]:
        every = every.unionByName(t)
    for t in tables[2:]:
        found = found.unionByName(t)
    split = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = materialize(cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(split, 1, F.col("k")), " ").alias("first"), F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest")))
    count = lambda name, as_: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(as_))
    lefts = materialize(hot_join(cuts, count("first", "l"), "lang", "first"))
    both = salted_join(hot_join(lefts, count("rest", "r"), "lang", "rest"), words, "lang")
    scored = both.withColumn("score", cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "n", "c.score", "c.l", "c.r")
    # a longer one that stands as often is a candidate, and so is any phrase between the two: one word more is enough
    inner = lambda at: found.where("words > 2").select("lang", F.array_join(F.slice(split, at, F.col("words") - 1), " ").alias("phrase"), F.col("f").alias("a"))
    kept = worst.join(inner(1).unionByName(inner(2)).distinct(), ["lang", "phrase", "a"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_salt")
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    result = materialize(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(*written, *tables, cuts, lefts)
    return result


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, array_to_string(ws[i:i+{k - 1}], ' ') AS phrase, {k} AS words FROM w WHERE i + {k - 1} <= len(ws)" for k in range(1, LONGEST + 1))
SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p)),
f AS (SELECT lang, phrase, words, count(*) AS f FROM ({_GRAMS}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= {LEAST}),
k AS (SELECT *, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k+1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = first JOIN f y ON y.lang = k.lang AND y.phrase = rest JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.a >= b.a AND len(c.phrase) > len(b.phrase) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= {TOP}
"""
