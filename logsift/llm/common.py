"""What the corpus operators share: shared folders, row keys, word arrays and packed postings."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, and code points 9 to 13.
SPACE_RE = "[ \\t-\\r]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Text bytes that a task works on at once.
CHUNK_BYTES = 1 << 20
ARROW_ROWS = 256
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one given to setCheckpointDir.

    Without either a session that runs in one process takes a folder of its own, and any other one fails: executors with
    disks of their own would miss each other's rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and (given := spark._jsc.sc().getCheckpointDir()).isDefined():
        root = given.get()
    if not root and re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
        _local[:] = _local or [tempfile.mkdtemp(prefix="logsift-")]
        root = _local[0]
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back, which cuts its lineage there."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from materialize. No plan that is still to run may read them."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(table.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows, as a row here is a whole document."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def words_of(text: Column) -> Column:
    """Array of the words of a text; of null none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text falls in the fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs' named columns and _rid, a long that is unique and rises with doc_id.

    _rid is doc_id itself where that is unique and never null. Otherwise rows are put in
    order of doc_id (nulls last), then text, numbered in that order and written, so that of rows
    that repeat a doc_id the one with the smaller text counts as the earlier one.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("k"), F.countDistinct("doc_id").alias("d")).first()
    cols = [docs[c] for c in dict.fromkeys(("doc_id", "text", *columns))]
    if ids.n == ids.k == ids.d:
        return docs.select(*cols, docs["doc_id"].cast("long").alias("_rid"))
    ordered = docs.select(*cols).orderBy(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first())
    return materialize(ordered.withColumn("_rid", F.monotonically_increasing_id()))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have limit bytes in all, or that are one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(ends[stop - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each text starts, with the end of the last (null: empty)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = b"".join(x.as_buffer().to_pybytes() for x in column if x.is_valid) if column.null_count else _raw(column)
    return np.frombuffer(data, np.uint8), offsets


def _raw(column: pa.Array) -> bytes:
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return column.buffers()[2].slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes() if column.buffers()[2] is not None else b""


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and the text (by index) that holds it."""
    space = np.concatenate(([True], IS_SPACE[data], [True]))
    inner = np.zeros(len(space), bool)  # a text's first byte starts a word whatever stands before it
    inner[offsets[1:-1] + 1] = True
    begins = ~space[1:-1] & (space[:-2] | inner[1:-1])
    ends = ~space[1:-1] & (space[2:] | inner[2:])
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


_rng = np.random.Generator(np.random.PCG64(20240531))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base and its inverse to the powers 0 to n, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[base] = tuple(both)
    up, down = _powers[base]
    return up[: n + 1], down[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(codes: np.ndarray, base: int) -> np.ndarray:
    """Rolling sums: [i] is the sum of codes[j] * base**j for j < i, modulo 2**64."""
    up, _ = powers(base, len(codes))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)))


def span_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Hash of each span [start, stop), the same wherever the same codes stand."""
    _, down = powers(base, len(sums))
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_sums(BYTE_CODE[data], BASE), starts, stops, BASE)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width codes."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    at = np.arange(len(codes) - width + 1)
    return span_hashes(prefix_sums(codes, BASE2), at, at + width, BASE2)


def bounds_of(owner: np.ndarray, n: int) -> np.ndarray:
    """Where each of n owners' entries start in a sorted owner array, with the end of the last."""
    return np.searchsorted(owner, np.arange(n + 1))


POSTINGS = "bucket int, base long, keys binary, docs binary"
#: Buckets for each shuffle partition, so that a task holds one bucket at a time.
BUCKETS_EACH = 4
KEY_BYTES = 6


def squeezed(rows: np.ndarray) -> bytes:
    """The bytes of equal-sized items, those of one place together, compressed: high bytes of small numbers take no room."""
    planes = np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int, kind: np.dtype | str) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(pa.decompress(data, n * kind.itemsize, codec="zstd", asbytes=True), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def postings(keys: np.ndarray, docs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of POSTINGS for 64-bit keys and the row key of the document of each, by bucket."""
    if not len(keys):
        return pa.RecordBatch.from_pylist([], schema=_POSTINGS)
    bucket = ((keys >> np.uint64(48)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    keys, docs, bucket = keys[order], docs[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    base = int(docs.min())
    small = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
    near, rows = (docs - base).astype("<i8"), range(len(starts))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[starts]), pa.array([base] * len(starts), pa.int64()),
            pa.array([small[starts[i] : stops[i]].tobytes() for i in rows], pa.binary()), pa.array([squeezed(near[starts[i] : stops[i]]) for i in rows], pa.binary()),
        ],
        schema=_POSTINGS,
    )


_POSTINGS = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and row keys of each bucket in turn; rows come sorted by bucket."""
    at, keys, docs = None, [], []
    for batch in batches:
        for bucket, base, k, d in zip(*(batch.column(c).to_pylist() for c in ("bucket", "base", "keys", "docs")), strict=True):
            if bucket != at and keys:
                yield np.concatenate(keys), np.concatenate(docs)
                keys, docs = [], []
            at = bucket
            n = len(k) // KEY_BYTES
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :KEY_BYTES] = np.frombuffer(k, np.uint8).reshape(n, KEY_BYTES)
            keys.append(wide.view("<u8").ravel())
            docs.append(unsqueezed(d, n, "<i8") + base)
    if keys:
        yield np.concatenate(keys), np.concatenate(docs)


def dealt(rows: DataFrame, column: str = "bucket") -> DataFrame:
    """rows with all of a bucket in one task, sorted by bucket."""
    return rows.repartition(partitions(rows.sparkSession), column).sortWithinPartitions(column)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join of left, where a key may hold any share of the rows, to right, where it stands once.

    Always a merge join: the copies of right would otherwise be broadcast up to Spark's threshold.
    """
    cols = [F.col(c) for c in left.columns]
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    copied = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copied.hint("merge"), [key, "_salt"], how).drop("_salt")


#: Rows of a key beyond which it is spread over tasks; at least one of HOT_SHARE of all rows, so that few keys are and
#: all their copies together are at most HOT_SHARE more.
HOT_ROWS = 2_000
HOT_SHARE = 20_000


def hot_join(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Join of left, where a key may hold any share of the rows, to right, where it stands once and its rows may be large.

    Only keys with many rows are spread, so right is copied for those alone: at most HOT_SHARE keys, which are broadcast.
    left is read more than once and should be written.
    """
    keys = list(key)
    limit = max(HOT_ROWS, left.count() // HOT_SHARE)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > limit)
    hot = F.broadcast(materialize(hot.select(*keys, F.ceil(F.col("_c") / limit).cast("int").alias("_s"))))
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), F.coalesce("_s", F.lit(1))).cast("int")
    spread = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_s")
    copied = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1))).drop("_s")
    return spread.join(copied, [*keys, "_salt"]).drop("_salt")
