"""MinHash fingerprints: universal hash permutations over word shingles in numpy; bands of the signatures are
joined in Spark and pairs verified by the Jaccard similarity of the shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounds_of, discard, hot_join, keyed, materialize, partitions, salted_join, small_batches, text_bytes, window_hashes, word_hashes, word_spans
from .jaccard import GROUP_ROWS, components

PERMUTATIONS = 128
SHINGLE = 5
BANDS = 32
SIMILAR = 0.8
#: Ranges of row keys for each partition.
RANGES_EACH = 4
_rng = np.random.Generator(np.random.PCG64(7))
#: Universal hashing by multiply and shift: odd factors and offsets of the permutations.
FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
NEXT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def shingle_hashes(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts, and each text's first, with the end of the last.

    A text with fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    data, offsets = text_bytes(texts)
    starts, stops, owner = word_spans(data, offsets)
    codes, n = word_hashes(data, starts, stops), len(texts)
    first = bounds_of(owner, n)
    counts = np.diff(first)
    wide = window_hashes(codes, width)
    inside = owner[: len(wide)] == owner[width - 1 :] if len(wide) else np.zeros(0, bool)
    hashes, whose = wide[inside], owner[: len(wide)][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = np.array([window_hashes(codes[first[i] : first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        whose = np.concatenate((whose, short))
        order = np.argsort(whose, kind="stable")
        hashes, whose = np.concatenate((hashes, own))[order], whose[order]
    return hashes, bounds_of(whose, n)


def signatures(texts: pa.Array) -> np.ndarray:
    """Least hash of each text's shingles under each permutation, 32 bits; a text without words has all ones."""
    hashes, bounds = shingle_hashes(texts)
    out = np.full((len(texts), PERMUTATIONS), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    for begin in range(0, len(full), 256):  # runs of texts, so that a permuted run stays in cache
        rows = full[begin : begin + 256]
        part, cuts = hashes[bounds[rows[0]] : bounds[rows[-1] + 1]], bounds[rows] - bounds[rows[0]]
        buffer = np.empty_like(part)
        for k in range(PERMUTATIONS):
            np.multiply(part, FACTORS[k], out=buffer)
            np.add(buffer, OFFSETS[k], out=buffer)
            out[rows, k] = (np.minimum.reduceat(buffer, cuts) >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal entries of signatures, row by row."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """_rid and signature (binary, 4 bytes for each permutation) of every row of docs (_rid, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("_rid"), pa.array([x.tobytes() for x in signatures(part.column("text"))], pa.binary())], names=["_rid", "signature"])

    return docs.select("_rid", "text").mapInArrow(run, "_rid long, signature binary")


def least_equal(threshold: float) -> int:
    """Equal entries below which signatures are far: six deviations under the mean of sets as alike as the threshold.

    At 0.8 these are 75 of 128, which a pair at the threshold misses once in a hundred million.
    """
    return max(0, int(PERMUTATIONS * threshold - 6 * (PERMUTATIONS * threshold * (1 - threshold)) ** 0.5))


def _close(least: int):
    """Pairs with different labels and least equal entries in each cell (key, lo, hi); rows come sorted by those."""

    def give(rows: list[tuple]) -> pa.RecordBatch:
        rid, label, side = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        sign = np.frombuffer(b"".join(r[6] for r in rows), np.uint32).reshape(len(rows), PERMUTATIONS)
        one = rows[0][1] == rows[0][2]  # a block with itself, otherwise one block with another
        others, left, right = np.flatnonzero(side == rows[0][2]), [], []
        for i in np.flatnonzero(side == rows[0][1]):
            near = others[others > i] if one else others
            near = near[label[near] != label[i]]
            near = near[np.count_nonzero(sign[near] == sign[i], axis=1) >= least]
            left.append(np.minimum(rid[i], rid[near]))
            right.append(np.maximum(rid[i], rid[near]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (left, right)], names=["left", "right"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "_rid", "label", "side", "signature")), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield give(held)
                    held = []
                held.append(row)
        if held:
            yield give(held)

    return run


def _across(members: DataFrame, prints: DataFrame, least: int) -> DataFrame:
    """Pairs (left, right) of rows with different labels that share a key and whose signatures have least equal entries.

    members: key, _rid, label, each once; prints: _rid, signature. Groups with the same members count once. They are cut to blocks
    of GROUP_ROWS; two blocks at a time meet in a task, which compares signatures alone.
    """
    same = [F.bit_xor(F.xxhash64("_rid", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    groups = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k"), *same).where("x <> y")
    groups = groups.groupBy("k", "x", "y", "h1", "h2").agg(F.min("key").alias("key"))
    rest = salted_join(members, groups.select("key", F.ceil(F.col("k") / GROUP_ROWS).cast("int").alias("nb")), "key")
    cells = rest.withColumn("side", F.pmod(F.xxhash64("_rid"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    order = ["key", "lo", "hi"]
    cells = materialize(cells.select("key", "_rid", "label", "side", F.least("side", "j").alias("lo"), F.greatest("side", "j").alias("hi")))
    rows = cells.join(prints.hint("shuffle_hash"), "_rid").repartition(partitions(members.sparkSession), *order).sortWithinPartitions(*order)
    found = materialize(rows.select(*order, "_rid", "label", "side", "signature").mapInArrow(_close(least), "left long, right long"))
    near = materialize(found.distinct())
    discard(cells, found)
    return near


def _likely(pairs: DataFrame, prints: DataFrame, least: int) -> DataFrame:
    """The pairs (left, right) whose signatures have least equal entries."""
    pairs = materialize(pairs)
    both = hot_join(pairs, prints.select(F.col("_rid").alias("left"), F.col("signature").alias("a")), "left").join(prints.select(F.col("_rid").alias("right"), F.col("signature").alias("b")), "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, PERMUTATIONS) for c in ("a", "b"))
            yield batch.select(["left", "right"]).filter(pa.array(np.count_nonzero(a == b, axis=1) >= least))

    near = materialize(both.select("left", "right", "a", "b").mapInArrow(run, "left long, right long"))
    discard(pairs)
    return near


def similar_pairs(docs: DataFrame, threshold: float = SIMILAR, bands: int = BANDS) -> DataFrame:
    """left, right (row keys) and jaccard of documents (_rid, text) that are linked; every document that shares a band
    with a similar one is in one component with it.

    Signatures are cut to bands; documents with an equal band are compared to the bucket's first one, then those of a
    bucket that no links join yet to each other. Texts are joined only for pairs whose signatures aren't far (least_equal); a pair is
    kept if the Jaccard similarity of the whole shingle sets is at least the threshold. Texts without words have no link.
    """
    rows, least = PERMUTATIONS // bands, least_equal(threshold)
    docs = docs.select("_rid", "text")
    prints = materialize(fingerprints(docs).where(F.col("signature") != F.lit(b"\xff" * (4 * PERMUTATIONS))))
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * (4 * rows) + 1, F.lit(4 * rows))))
    keys = materialize(prints.select("_rid", F.explode(band).alias("key")))
    first = keys.groupBy("key").agg(F.min("_rid").alias("left"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = _verified(_likely(salted_join(keys, first, "key").where("_rid > left").select("left", F.col("_rid").alias("right")).distinct(), prints, least), docs, threshold)
    labels = materialize(components(links.select(F.col("left").alias("a"), F.col("right").alias("b"))))
    members = materialize(keys.join(labels, "_rid", "left").select("key", "_rid", F.coalesce("label", "_rid").alias("label")))
    more = _verified(_across(members, prints, least), docs, threshold)
    discard(prints, keys, labels, members)
    return links.unionByName(more)


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (left, right; a written table, deleted then) whose whole shingle sets are alike, and how much."""
    left = hot_join(pairs, docs.select(F.col("_rid").alias("left"), F.col("text").alias("a")), "left").join(docs.select(F.col("_rid").alias("right"), F.col("text").alias("b")), "right")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, p), (y, q) = shingle_hashes(batch.column("a")), shingle_hashes(batch.column("b"))
            sims = []
            for i in range(batch.num_rows):
                s, t = np.unique(x[p[i] : p[i + 1]]), np.unique(y[q[i] : q[i + 1]])
                both = len(np.intersect1d(s, t, assume_unique=True))
                sims.append(both / max(1, len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column("left"), batch.column("right"), pa.array(sims, pa.float64())], names=["left", "right", "jaccard"])

    alike = materialize(left.select("left", "right", "a", "b").mapInArrow(verify, "left long, right long, jaccard double").where(F.col("jaccard") >= threshold))
    discard(pairs)
    return alike


def with_next(rows: DataFrame) -> DataFrame:
    """rows (_rid, ...) dealt to ranges of _rid, with the first row of each range also at the end of the range before.

    Adds _p, the range, and _extra, 1 for such a copy; sorted by both and _rid in each partition. The first row of all
    follows the last. Ranges are several for each partition, and dealt in order, so that partitions hold about as many.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    k = RANGES_EACH * n
    cuts = sorted({int(x) for x in rows.select("_rid").approxQuantile("_rid", [i / k for i in range(1, k)], 0.25 / k)})
    rank = F.size(F.filter(F.array(*(F.lit(c).cast("long") for c in cuts)), lambda c: c <= F.col("_rid"))) if cuts else F.lit(0)
    ids = rows.select("_rid", rank.alias("_p"))
    heads = sorted((r["_p"], r["h"]) for r in ids.groupBy("_p").agg(F.min("_rid").alias("h")).collect())  # a row for each partition
    back = spark.createDataFrame([(h, heads[i - 1][0]) for i, (_, h) in enumerate(heads)], "_rid long, _c int")
    spots = F.array_compact(F.array(F.struct(F.col("_p").alias("p"), F.lit(0).alias("e")), F.when(F.col("_c").isNotNull(), F.struct(F.col("_c").alias("p"), F.lit(1).alias("e")))))
    dealt = rows.withColumn("_p", rank).join(F.broadcast(back), "_rid", "left").withColumn("_x", F.explode(spots)).withColumn("_p", F.col("_x.p")).withColumn("_extra", F.col("_x.e")).drop("_x", "_c")
    return dealt.repartitionByRange(max(1, n), "_p").sortWithinPartitions("_p", "_extra", "_rid")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text, and how like they are.

    The last quarter of the code points (rounded down) gives way to as many (or all) first ones of the next row in order
    of doc_id; the last row is followed by the first, and an only row by itself. Null text is empty. Texts without words
    have one fingerprint in common. Rows that repeat a doc_id follow each other in order of text, null ids come last.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs).select("_rid", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = with_next(rows)

    def work(run: list[tuple]) -> pa.RecordBatch:
        """run: consecutive rows (doc_id, text); the last is only the next one of the row before."""
        texts = [x[1] for x in run]
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts[:-1], texts[1:], strict=True)]
        own, new = signatures(pa.array(texts, pa.string())), signatures(pa.array(edited, pa.string()))
        hexes = [x.astype("<u4").tobytes().hex() for x in own[:-1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in run[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(hexes), pa.array([x.astype("<u4").tobytes().hex() for x in new]), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, at = 0, None
        for batch in batches:
            for p, extra, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_p", "_extra", "doc_id", "text")), strict=True):
                if p != at:
                    held, size, at = [], 0, p
                held.append((doc_id, text))
                size += len(text)
                if len(held) > 1 and (extra or size > CHUNK_BYTES):
                    yield work(held)
                    held, size = held[-1:], len(text)

    return dealt.select("_p", "_extra", "doc_id", "text").mapInArrow(run, NEXT_SCHEMA)


def near_copies(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """doc_id, component_id (the smallest doc_id that links reach) and n_links of every row of docs (doc_id, text).

    Of equal texts the first stands for all, which link to it alone; the bands are joined between such first ones.
    Two documents that share no band, or whose signatures are far, aren't linked: at a similarity of 0.8 that is one pair in about two million. Null, empty
    and wordless texts have no link. Rows that repeat a doc_id are documents of their own; null ids come last in order.
    """
    rows = keyed(docs)
    worded = rows.where(F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False)))
    digest = materialize(worded.select("_rid", F.sha2("text", 256).alias("key"), F.length("text").alias("n")))
    first = digest.groupBy("key", "n").agg(F.min("_rid").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    same = materialize(hot_join(digest, first, "key", "n").where("_rid > rep").select("_rid", "rep"))
    links = materialize(similar_pairs(worded.join(same.hint("shuffle_hash"), "_rid", "left_anti"), threshold).select(F.col("left").alias("a"), F.col("right").alias("b")))
    links = links.unionByName(same.select(F.col("rep").alias("a"), F.col("_rid").alias("b")))
    counts = links.select(F.explode(F.array("a", "b")).alias("_rid")).groupBy("_rid").agg(F.count(F.lit(1)).alias("n_links"))
    ids = rows.select("_rid", F.col("doc_id").cast("long").alias("doc_id"))
    labels = ids.join(components(links), "_rid", "left").join(counts, "_rid", "left").select("doc_id", F.coalesce("label", "_rid").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return hot_join(materialize(labels), ids.select(F.col("_rid").alias("label"), F.col("doc_id").alias("component_id")), "label").select("doc_id", "component_id", "n_links")


def fingerprint_near_copies(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
