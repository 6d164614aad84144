"""Finding repeated windows of a corpus, shared by the two operators that remove them.

Every window of `width` tokens has one anchor: its `gram`-token run with the least hash, the first of equals. Equal
windows have equal anchors, so only anchors are exchanged: those found twice give their stretches of windows as
snippets, which meet by anchor. An anchor that stands in very many documents would bring too many snippets together;
its windows meet by their own hash instead. A snippet that stands earlier among the rows of its task isn't sent again;
each task's rows come in order of their key, so that a task that is run again sends the same. Texts are dealt by row key
once: where snippets are cut and where covered tokens go, one plan reads the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS_EACH, BYTE_CODE, POSTINGS, by_bucket, dealt, mix, partitions, postings, slices, small_batches, squeezed, text_bytes, unsqueezed, window_hashes, word_hashes, word_spans

#: Documents whose anchors show which ones are very common, and the share of them that makes one so.
#: These only choose how windows meet, not which; at most 1 / COMMON anchors for each one of a mean document are common.
LOOK_ROWS = 4096
COMMON = 0.01
CHUNK = 1 << 20
#: Snippets of a task that are remembered at once, by digest; what is forgotten is sent again.
SEEN = 500_000
#: Bytes of snippets that a task packs together.
PACK_BYTES = 8 << 20
#: Documents of an anchor beyond which its windows meet by their own hash; its key is marked by HOT_BIT.
HOT_DOCS = 10_000
HOT_BIT = np.uint64(1 << 60)
MASK48 = np.uint64((1 << 48) - 1)
META = np.dtype([("key", "<u8"), ("rid", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("size", "<i4")])
SNIPPETS = "bucket int, n int, meta binary, body binary"
RUNS = "_rid long, start int, stop int"


@dataclass(frozen=True)
class Kind:
    """words: tokens are words, else bytes. again: a window that stands twice in one document counts as repeated."""

    words: bool
    width: int
    gram: int
    again: bool


def first_least(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value, the first of equals, in each run of width values."""
    at, span = np.arange(len(x), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        right = x[step:] < x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at


class Chunk:
    """Tokens of a few texts, with their windows' anchors."""

    def __init__(self, texts: pa.Array, kind: Kind):
        self.data, self.offsets = text_bytes(texts)
        self.kind = kind
        if kind.words:
            self.starts, self.stops, owner = word_spans(self.data, self.offsets)
            codes = word_hashes(self.data, self.starts, self.stops)
            self.first = np.searchsorted(owner, np.arange(len(texts) + 1))
        else:
            codes, self.first = BYTE_CODE[self.data], self.offsets
            owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.offsets))
        self.codes, n = codes, len(codes) - kind.width + 1
        if n <= 0:
            self.windows = self.anchor = self.owner = np.zeros(0, np.int64)
            self.grams = np.zeros(0, np.uint64)
            return
        self.grams = window_hashes(codes, kind.gram) & MASK48
        inside = owner[:n] == owner[kind.width - 1 :]
        self.windows = np.flatnonzero(inside)
        self.anchor = first_least(self.grams, kind.width - kind.gram + 1)[self.windows]
        self.owner = owner[self.windows]

    def stretches(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last (by index in windows) of each run of windows with one anchor."""
        if not len(self.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.flatnonzero((np.diff(self.anchor) != 0) | (np.diff(self.windows) != 1)) + 1
        return np.concatenate(([0], new)), np.concatenate((new, [len(self.windows)])) - 1

    def body(self, start: int, tokens: int) -> bytes:
        """The tokens from start on; words joined by a blank."""
        if not self.kind.words:
            return self.data[start : start + tokens].tobytes()
        raw = self.data[self.starts[start] : self.stops[start + tokens - 1]].tobytes()
        return b" ".join(raw.split())


def _anchors(kind: Kind, buckets: int, common: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=CHUNK):
                c, rid = Chunk(part.column("text"), kind), part.column("_rid").to_numpy()
                a, _ = c.stretches()
                keys, whose = c.grams[c.anchor[a]], c.owner[a]
                rare = ~np.isin(keys, common)
                keys, whose = keys[rare], whose[rare]
                order = np.lexsort((keys, whose))
                keys, whose = keys[order], whose[order]
                back = 2 if kind.again else 1  # of an anchor in a document: two at most, or one
                same = np.zeros(len(keys), bool)
                same[back:] = (keys[back:] == keys[:-back]) & (whose[back:] == whose[:-back])
                yield postings(_spread(keys[~same]), rid[whose[~same]], buckets)

    return run


def _spread(keys: np.ndarray) -> np.ndarray:
    """48-bit keys with their bucket's bits above."""
    return keys | (mix(keys) << np.uint64(48))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, docs in by_bucket(batches):
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        group = np.cumsum(np.concatenate(([True], keys[1:] != keys[:-1]))) - 1
        size = np.bincount(group)[group]
        many = size > 1
        keys = np.where(size > HOT_DOCS, keys | HOT_BIT, keys)
        rows = np.unique(np.stack((docs[many], keys[many].view(np.int64)), 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["_rid", "key"])


def _packed(meta: np.ndarray, bodies: list[bytes], buckets: int) -> pa.RecordBatch:
    """Rows of SNIPPETS; a snippet without a body is settled and goes by its row key."""
    by = np.where(meta["size"] > 0, meta["key"], meta["rid"].view(np.uint64))
    bucket = (mix(by) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    body = [pa.compress(b"".join([bodies[i] for i in p]), codec="zstd", asbytes=True) for p in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([len(p) for p in parts], pa.int32()), pa.array([squeezed(meta[p]) for p in parts], pa.binary()), pa.array(body, pa.binary())],
        names=["bucket", "n", "meta", "body"],
    )


def _unpacked(n: int, meta: bytes, body: bytes) -> tuple[np.ndarray, bytes]:
    rows = unsqueezed(meta, n, META)
    return rows, pa.decompress(body, int(rows["size"].sum()), codec="zstd", asbytes=True)


def _joined(meta: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Settled snippets of a row whose windows follow each other as one, so that a copy gives one row, not one for each anchor."""
    if not len(meta):
        return meta, bodies
    done = meta["size"] == 0
    follows = done[1:] & done[:-1] & (meta["rid"][1:] == meta["rid"][:-1]) & (meta["start"][1:] == meta["start"][:-1] + meta["windows"][:-1])
    first = np.flatnonzero(np.concatenate(([True], ~follows)))
    out = meta[first]
    out["windows"] = np.add.reduceat(meta["windows"], first)
    return out, [bodies[i] for i in first.tolist()]


def _snippets(kind: Kind, buckets: int, common: np.ndarray) -> Callable:
    def cut(c: Chunk, rid: np.ndarray, known: list, seen: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, list[bytes]]:
        a, b = c.stretches()
        keys, whose = c.grams[c.anchor[a]], c.owner[a]
        hot = np.isin(keys, common)
        want = hot.copy()
        for i in np.unique(whose):
            if known[i] is not None:
                mine = slice(*np.searchsorted(whose, (i, i + 1)))
                listed = np.array(known[i], np.int64).view(np.uint64)
                want[mine] |= np.isin(keys[mine], listed & MASK48)
                hot[mine] |= np.isin(keys[mine] | HOT_BIT, listed)
        a, b, keys, whose, hot = a[want], b[want], keys[want], whose[want], hot[want]
        start, count = c.windows[a], b - a + 1
        if hot.any():  # each window by itself
            reps = np.where(hot, count, 1)
            at = np.repeat(np.arange(len(start)), reps)
            step = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)
            start, whose, count = start[at] + step, whose[at], np.where(hot[at], 1, count[at])
            keys = np.where(hot[at], (window_hashes(c.codes, kind.width) & MASK48)[start], keys[at])
        local = start - c.first[whose]
        meta, bodies = np.zeros(len(start), META), []
        if len(seen) > SEEN:
            seen.clear()
        for k, i in enumerate(np.lexsort((local, rid[whose])).tolist()):
            body, here = c.body(int(start[i]), int(count[i]) + kind.width - 1), (int(rid[whose[i]]), int(local[i]))
            digest = blake2b(body, digest_size=16, key=int(keys[i]).to_bytes(8, "little")).digest()
            first = seen.get(digest)
            if first is None or here < first:
                seen[digest] = here
            elif first[0] != here[0] or (kind.again and first != here):
                body = b""  # all its windows stand earlier in this task
            meta[k] = (keys[i], *here, count[i], len(body))
            bodies.append(body)
        return _joined(meta, bodies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        metas, bodies, size = [], [], 0
        for batch in batches:
            for part in slices(batch, limit=CHUNK):
                meta, own = cut(Chunk(part.column("text"), kind), part.column("_rid").to_numpy(), part.column("keys").to_pylist(), seen)
                metas.append(meta)
                bodies += own
                size += int(meta["size"].sum()) + meta.nbytes
                if size > PACK_BYTES:
                    yield _packed(np.concatenate(metas), bodies, buckets)
                    metas, bodies, size = [], [], 0
        if metas:
            yield _packed(np.concatenate(metas), bodies, buckets)

    return run


def sent_snippets(found: DataFrame, kind: Kind, buckets: int, common: np.ndarray) -> DataFrame:
    """SNIPPETS of found (_rid, text, keys and more), the same in whatever order a task gets its rows."""
    return found.sortWithinPartitions("_rid").mapInArrow(_snippets(kind, buckets, common), SNIPPETS)


Decide = Callable[[np.ndarray, bytes], tuple[np.ndarray, np.ndarray]]


def _decided(decide: Decide) -> Callable:
    """Runs of tokens that the repeated windows of each bucket cover."""

    def runs(meta: np.ndarray, body: bytes, width: int) -> pa.RecordBatch:
        settled = meta[meta["size"] == 0]
        open_ = meta[meta["size"] > 0]
        rid, start = decide(open_, body)
        order = np.lexsort((start, rid))
        rid, start = rid[order], start[order]
        new = np.flatnonzero(np.concatenate(([True], (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + 1)))) if len(rid) else np.zeros(0, np.int64)
        last = np.concatenate((new[1:], [len(rid)])) - 1 if len(rid) else new
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((rid[new], settled["rid"]))), pa.array(np.concatenate((start[new], settled["start"])).astype(np.int32)), pa.array(np.concatenate((start[last] + width, settled["start"] + settled["windows"] + width - 1)).astype(np.int32))],
            names=["_rid", "start", "stop"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, metas, bodies = None, [], []
        for batch in batches:
            for bucket, n, meta, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "meta", "body")), strict=True):
                if bucket != at and metas:
                    yield runs(np.concatenate(metas), b"".join(bodies), decide.width)
                    metas, bodies = [], []
                at = bucket
                meta, body = _unpacked(n, meta, body)
                metas.append(meta)
                bodies.append(body)
        if metas:
            yield runs(np.concatenate(metas), b"".join(bodies), decide.width)

    return run


def common_anchors(rows: DataFrame, kind: Kind) -> np.ndarray:
    """Sorted anchors that stand in at least COMMON of about LOOK_ROWS documents, chosen by a hash of the row key."""
    n = rows.count()
    if not n:
        return np.zeros(0, np.uint64)
    share = min(1.0, LOOK_ROWS / n)
    look = rows.where(F.pmod(F.xxhash64("_rid"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=CHUNK):
                c = Chunk(part.column("text"), kind)
                a, _ = c.stretches()
                pairs = np.unique(np.stack((c.owner[a].astype(np.uint64), c.grams[c.anchor[a]]), 1), axis=0)
                keys, counts = np.unique(pairs[:, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    least = max(32, int(COMMON * share * n))
    counts = look.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["key"] for r in counts.select("key").collect()], np.int64).view(np.uint64))


def listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The values of each _rid as an array; dealt first, as few of a key meet in a task before."""
    return rows.repartition(partitions(rows.sparkSession), "_rid").groupBy("_rid").agg(F.collect_list(value).alias(name)).hint("shuffle_hash")  # texts aren't sorted


def with_runs(rows: DataFrame, kind: Kind, decide: Decide) -> DataFrame:
    """rows (_rid, doc_id, text) and runs: an array of (start, stop), in tokens, of what repeated windows cover (null: none).

    Runs may overlap. decide gets the snippets of a bucket (META, and their bodies end to end) and gives row key and start
    of each window that also stands earlier.
    """
    spark = rows.sparkSession
    small_batches(spark)
    buckets = BUCKETS_EACH * partitions(spark)
    common = common_anchors(rows, kind)
    found = dealt(rows.select("_rid", "text").mapInArrow(_anchors(kind, buckets, common), POSTINGS)).mapInArrow(_repeated, "_rid long, key long")
    # both joins read one exchange of the texts, so they must ask for the same rows and columns
    texts = rows.where("_rid is not null").select("_rid", "doc_id", "text").repartition(partitions(spark), "_rid")
    cut = texts.join(listed(found, F.col("key"), "keys"), "_rid", "left" if len(common) else "inner")
    runs = dealt(sent_snippets(cut, kind, buckets, common)).mapInArrow(_decided(decide), RUNS)
    return texts.join(listed(runs, F.struct("start", "stop"), "runs"), "_rid", "left")


def covered(n: int, runs: list | None) -> np.ndarray:
    """Which of n tokens lie in a run."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs or ():
        edge[r["start"]] += 1
        edge[min(n, r["stop"])] -= 1
    return np.cumsum(edge)[:n] > 0
