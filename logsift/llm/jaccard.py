"""N-gram Jaccard join by parity sketches: each shingle flips one bit of a sketch, so the Hamming distance of two
sketches is at most the size of the sets' symmetric difference. Within a band of set sizes the sketch is cut to more
parts than linked sets can differ in; documents with an equal part are candidates and are verified on their sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS_EACH, POSTINGS, bounds_of, by_bucket, dealt, discard, hot_join, keyed, materialize, mix, partitions, postings, salted_join, slices, small_batches, text_bytes, window_hashes, word_hashes, word_spans

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Bits of a part of the sketch.
PART_BITS = 1 << 20
#: Bits of a whole sketch for each shingle, at least.
BITS_EACH = 4
#: Documents of a group that are compared at once with as many others.
GROUP_ROWS = 2048
#: Row keys that are broadcast at most (8 bytes each).
BROADCAST_KEYS = 500_000
LOOK_ROWS = 8192
COMMON = 4
SMALLEST = 4  # smaller sets link with equal ones only


def band_floors(upto: int) -> list[int]:
    """Least set size of each band, the next band's last."""
    out = [SMALLEST]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's start, with the end of the last.

    A to Z count as a to z. With fewer words the whole sequence is the one shingle; without words there is none.
    """
    data, offsets = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
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
        hashes, whose = np.concatenate((hashes, own)), np.concatenate((whose, short))
    order = np.lexsort((hashes, whose))
    hashes, whose = hashes[order], whose[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (whose[1:] != whose[:-1])
    return hashes[new], bounds_of(whose[new], n)


def is_in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _odd_parts(x: np.ndarray, owner: np.ndarray, parts: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts (text * parts + part) with an odd bit, their odd bits as one number, and each text's parts without."""
    cell = owner * parts + (x % np.uint64(parts)).astype(np.int64)
    code = mix((x >> np.uint64(40)) % np.uint64(PART_BITS) + np.uint64(1))  # the exclusive or of the odd bits' codes
    order = np.argsort(cell, kind="stable")
    cell, code = cell[order], code[order]
    at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    odd = np.bitwise_xor.reduceat(code, at) if len(at) else np.zeros(0, np.uint64)
    cell, odd = cell[at][odd != 0], odd[odd != 0]
    return cell, odd, parts - np.bincount(cell // parts, minlength=texts)


def sketch_keys(hashes: np.ndarray, bounds: np.ndarray, which: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch parts of the texts in which, and the text of each.

    In a band with sets of at most s shingles, linked sets differ in d = 2 s / 9 at most, and so do they without their
    common shingles; of p parts at least p - d are equal. If a text has fewer than p - d parts without an odd bit, an equal
    part with one remains, so such parts needn't meet. A text that has more of them gives the parts of its whole set too,
    and if it has too many of those, also the parts without an odd bit: two such texts meet there.
    """
    sizes = np.diff(bounds)
    floors = band_floors(int(sizes.max(initial=0)) * 2 + 8)
    keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def give(band: int, parts: int, whole: int, texts: np.ndarray, cell: np.ndarray, odd: np.ndarray) -> None:
        keys.append(mix(odd ^ mix((cell % parts).astype(np.uint64) + np.uint64((2 * band + whole) << 40) + np.uint64(1))))
        docs.append(texts[cell // parts])

    for b in range(len(floors) - 1):
        low, high = floors[b], floors[b + 1] - 1
        chosen = which[(sizes[which] <= high) & (100 * sizes[which] >= PERCENT * low) & (sizes[which] >= SMALLEST)]
        if not len(chosen):
            continue
        differ = 2 * high * (100 - PERCENT) // (100 + PERCENT)
        parts = differ + 1 + max(2, -(-differ // 5))
        x = np.concatenate([hashes[bounds[i] : bounds[i + 1]] for i in chosen])
        owner = np.repeat(np.arange(len(chosen)), sizes[chosen])
        rare = ~is_in(x, common)
        x = mix(x ^ np.uint64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        cell, odd, even = _odd_parts(x[rare], owner[rare], parts, len(chosen))
        give(b, parts, 0, chosen, cell, odd)
        weak = even >= parts - differ
        if weak.any():
            mine = weak[owner]
            cell, odd, even = _odd_parts(x[mine], (np.cumsum(weak) - 1)[owner[mine]], parts, int(weak.sum()))
            give(b, parts, 1, chosen[weak], cell, odd)
            bare = np.flatnonzero(even >= parts - differ)
            blank = np.setdiff1d((bare[:, None] * parts + np.arange(parts)).ravel(), cell, assume_unique=True)
            give(b, parts, 1, chosen[weak], blank, np.zeros(len(blank), np.uint64))
    return np.concatenate(keys), np.concatenate(docs)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that stand in COMMON or more of about LOOK_ROWS texts, chosen by a hash of the row key.

    They only choose which parts meet: links don't depend on them. There are at most LOOK_ROWS / COMMON for each shingle
    of a mean text.
    """
    n = docs.count()
    look = docs.where(F.pmod(F.xxhash64("_rid"), F.lit(1 << 20)) < int(min(1.0, LOOK_ROWS / max(1, n)) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, bounds = shingle_sets(part.column("text"))
                sets = {hashes[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)}
                keys, counts = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    counts = look.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["key"] for r in counts.select("key").collect()], np.int64).view(np.uint64))


def parity_sketch(hashes: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, odd or even; the length is a power of two that grows with the set."""
    size = 64 << max(0, (BITS_EACH * len(hashes) // 64).bit_length())
    at = (mix(hashes ^ np.uint64(3)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two parity sketches, the longer one folded to the shorter one's length."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def set_facts(docs: DataFrame) -> DataFrame:
    """_rid, n (set size), two sums that tell sets apart, and the parity sketch, of every row of docs (_rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, bounds = shingle_sets(part.column("text"))
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(k)), dtype=np.uint64))) for k in (1, 2)]
                sketch = pa.array([parity_sketch(hashes[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_rid"), pa.array(np.diff(bounds).astype(np.int64)), *(pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums), sketch], names=["_rid", "n", "h1", "h2", "sketch"])

    return docs.select("_rid", "text").mapInArrow(run, "_rid long, n long, h1 long, h2 long, sketch binary")


def sketches(docs: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
    """Postings of the sketch parts of every row of docs (_rid, text); of equal sets in a run of rows one gives them."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, bounds = shingle_sets(part.column("text"))
                rid = part.column("_rid").to_numpy()
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)))
                kind = np.stack((np.diff(bounds).astype(np.uint64), sums[bounds[1:]] - sums[bounds[:-1]]), 1)
                order = np.argsort(rid, kind="stable")
                _, first = np.unique(kind[order], axis=0, return_index=True)
                keys, at = sketch_keys(hashes, bounds, np.sort(order[first]), shared.value)
                yield postings(keys, rid[at], buckets)

    return docs.select("_rid", "text").mapInArrow(run, POSTINGS)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group with an equal key: the pairs with its first document (kind 0), and its members if three or more (kind 1)."""
    for keys, docs in by_bucket(batches):
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        start = np.concatenate(([True], keys[1:] != keys[:-1]))
        group = np.cumsum(start) - 1
        first, size = docs[start][group], np.bincount(group)[group]
        other = docs != first
        pairs = np.unique(np.stack((first[other], docs[other]), 1), axis=0)
        many = size > 2
        kind = np.concatenate((np.zeros(len(pairs), np.int32), np.ones(int(many.sum()), np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((pairs[:, 0], keys[many].view(np.int64)))), pa.array(np.concatenate((pairs[:, 1], docs[many])))], names=["kind", "a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            hashes, bounds = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("_rid"), pa.array([hashes[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["_rid", "set"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches are no farther apart than linked sets' may be."""
    for batch in batches:
        na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        most = (na + nb) * (100 - PERCENT) // (100 + PERCENT)
        fit = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        keep = [bool(f) and sketch_distance(x.as_py(), y.as_py()) <= m for f, m, x, y in zip(fit, most, batch.column("sketch_a"), batch.column("sketch_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _side(k: str, cols: tuple[str, ...]) -> list:
    return [F.col("_rid").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols)]


def near_pairs(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches are near."""
    left = hot_join(pairs, facts.select(*_side("a", ("n", "sketch"))), "a")
    both = left.join(facts.select(*_side("b", ("n", "sketch"))), "b")
    return materialize(both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_near, "a long, b long"))


def verified(near: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets link."""
    needed = materialize(near.select(F.explode(F.array("a", "b")).alias("_rid")).distinct())
    few = F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed
    sets = materialize(docs.select("_rid", "text").join(few, "_rid", "left_semi").mapInArrow(_sets, "_rid long, set binary"))
    left = hot_join(near, sets.select(*_side("a", ("set",))), "a")
    both = left.join(sets.select(*_side("b", ("set",))), "b")
    links = materialize(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long"))
    discard(needed, sets)
    return links


def _near_across(rid: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: list[bytes], side: np.ndarray | None) -> np.ndarray:
    """Pairs of documents with different labels whose sketches are near; side: which of two blocks each is in."""
    words = np.array([len(x) // 8 for x in sketch])
    classes = {int(w): np.flatnonzero(words == w) for w in np.unique(words)}
    bits = {w: np.stack([np.frombuffer(sketch[i], np.uint64) for i in at]) for w, at in classes.items()}
    found = []
    for u, at in classes.items():
        for v, bt in classes.items():
            if v < u:
                continue
            x, y = bits[u], bits[v]
            while y.shape[1] > u:
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            step = max(1, (1 << 20) // max(1, y.size))
            for i in range(0, len(at), step):
                k = at[i : i + step]
                far = np.bitwise_count(x[i : i + step, None, :] ^ y[None]).sum(2, dtype=np.int64)
                both, least = n[k][:, None] + n[bt][None], np.minimum(n[k][:, None], n[bt][None])
                fit = (far <= both * (100 - PERCENT) // (100 + PERCENT)) & (100 * least >= PERCENT * (both - least)) & (label[k][:, None] != label[bt][None])
                if side is not None:
                    fit &= side[k][:, None] != side[bt][None]
                p, q = np.nonzero(fit)
                found.append(np.stack((rid[k[p]], rid[bt[q]]), 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs across labels within each group; rows come sorted by key, lo and hi."""

    def give(rows: list[tuple]) -> pa.RecordBatch:
        rid, label, n, side = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 7))
        pairs = _near_across(rid, label, n, [r[6] for r in rows], side if rows[0][1] != rows[0][2] else None)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "b", "label", "n", "sketch", "side")), strict=True):
            if held and held[-1][:3] != row[:3]:
                yield give(held)
                held = []
            held.append(row)
    if held:
        yield give(held)


def near_across(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Near pairs of documents that share a key and have different labels; members: key, b, label, each once.

    Groups with the same members count once. They are cut to blocks of GROUP_ROWS, and two blocks at a time meet in a task.
    Sketches are joined to the rows of blocks, never broadcast, as they grow with the corpus.
    """
    same = [F.bit_xor(F.xxhash64("b", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    groups = members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k"), *same).where("x <> y")
    groups = groups.groupBy("k", "x", "y", "h1", "h2").agg(F.min("key").alias("key"))  # of groups with the same members one
    rest = salted_join(members, groups.select("key", F.ceil(F.col("k") / GROUP_ROWS).cast("int").alias("nb")), "key")
    cells = rest.withColumn("side", F.pmod(F.xxhash64("b"), F.col("nb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = materialize(cells.select("key", "b", "label", "side", F.least("side", "j").alias("lo"), F.greatest("side", "j").alias("hi")))
    order = ["key", "lo", "hi"]
    rows = cells.join(facts.select(F.col("_rid").alias("b"), "n", "sketch").hint("shuffle_hash"), "b").repartition(partitions(members.sparkSession), *order).sortWithinPartitions(*order)
    found = materialize(rows.select(*order, "b", "label", "n", "sketch", "side").mapInArrow(_across, "a long, b long"))
    near = materialize(found.distinct())
    discard(cells, found)
    return near


def components(links: DataFrame) -> DataFrame:
    """_rid and the smallest row key that links (a, b) reach from it, for every row key in a link.

    Large and small stars in turn until no link changes; links are written after each round.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialize(small.where("u <> v").distinct())
        discard(before, large)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if now == mark:
            return edges.select(F.col("u").alias("_rid"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("_rid"), F.col("v").alias("label")).distinct())
        mark = now


def classes(docs: DataFrame) -> DataFrame:
    """_rid, n_shingles and label, the smallest row key reachable by links, of every row of docs (_rid, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    facts = materialize(set_facts(docs))
    first = facts.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("_rid").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    salt = F.pmod(F.xxhash64("_rid"), F.lit(16)).cast("int")
    copied = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    # equal sets link; every other link is looked for between the first ones of equal sets
    same = materialize(facts.where("n > 0").withColumn("_salt", salt).join(copied, ["n", "h1", "h2", "_salt"]).where("_rid > rep").select("_rid", "rep"))
    buckets = BUCKETS_EACH * partitions(spark)
    met = materialize(dealt(sketches(docs, buckets, common_shingles(docs))).mapInArrow(_meet, "kind int, a long, b long"))

    def represented(rows: DataFrame, column: str) -> DataFrame:
        to = same.select(F.col("_rid").alias(column), "rep")
        return rows.join(to, column, "left").withColumn(column, F.coalesce("rep", column)).drop("rep")

    pairs = represented(represented(met.where("kind = 0").select("a", "b").distinct(), "a"), "b")
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    facts = facts.drop("h1", "h2")
    near = near_pairs(pairs, facts)
    links = verified(near, docs)
    discard(pairs, near)
    labels = materialize(components(links))
    # groups whose documents aren't all in one component yet: all their pairs across components
    members = represented(met.where("kind = 1").select(F.col("a").alias("key"), "b"), "b").join(labels.select(F.col("_rid").alias("b"), "label"), "b", "left").select("key", "b", F.coalesce("label", "b").alias("label"))
    members = materialize(members.distinct())
    discard(met, labels)
    near = near_across(members, facts)
    more = verified(near, docs)
    discard(members, near)
    labels = components(links.unionByName(more).unionByName(same.select(F.col("rep").alias("a"), F.col("_rid").alias("b"))))
    discard(links, more, same)
    return facts.select("_rid", "n").join(labels, "_rid", "left").select("_rid", F.col("n").alias("n_shingles"), F.coalesce("label", "_rid").alias("label"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of docs (doc_id, text).

    Null, empty or wordless text: no shingle, no link, its own doc_id. Rows that repeat a doc_id are documents of
    their own; null ids come last in order, and a class of only those has a null component_id.
    """
    rows = keyed(docs)
    out = classes(rows)
    ids = rows.select("_rid", F.col("doc_id").cast("long").alias("doc_id"))
    named = out.join(ids, "_rid")
    return salted_join(named.select("label", "doc_id", "n_shingles", "_rid"), ids.select(F.col("_rid").alias("label"), F.col("doc_id").alias("component_id")), "label").select("doc_id", "n_shingles", "component_id")


def keep_first_of_class(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs (doc_id, text), with the named columns, that come first in their class of linked ones.

    Null, empty and wordless texts stay, each on its own. Of rows that repeat a doc_id the one with the smaller text comes
    first; null ids come last. No rows: no rows.
    """
    rows = keyed(docs, *columns)
    gone = classes(rows).where("label <> _rid").select("_rid")
    return rows.join(gone.hint("shuffle_hash"), "_rid", "left_anti").select(*columns)  # texts aren't sorted


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
