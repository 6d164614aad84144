"""Packing by non-negative least squares: shallow combinations of lengths that fill a window are fitted to the
histogram of lengths, repeat counts are rounded down, and what is left is packed greedily, cut at window ends."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches

WINDOW = 4096
END_ID = 2
#: Lengths whose triples are enumerated: those with the most pieces.
HEAVY = 48
SWEEPS = 40
#: Rows of the length table that one bucket of documents aims at.
BUCKET_ROWS = 20_000
CACHE_WORDS = 64_000
TOKENIZER = "word_bpe_49k.json"
IDS_SCHEMA = "_rid long, doc_id long, n long, ids binary"
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words of these characters only are cut by PIECE just as the tokenizer's own pattern does.
PLAIN = re.compile("[!-~¡-©«-±´-¸»¿-ſ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w]|_)+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of words, for a vocabulary whose pieces never cross white space.

    The first words met are cached. Others of plain characters are cut into pieces and merged together in one
    call by byte ranks, in which END marks a piece's end; all that is unusual goes to the tokenizer itself.
    """

    END = "\x01"
    ODD = re.compile("[\x01\x1c-\x1f]|<[|]")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        vocab = self.full.get_vocab(with_added_tokens=False)
        plain = {c: b for b, c in _byte_letters().items()}
        ranks: dict[bytes, int] = {}
        self.ends = np.zeros(1 << 16, bool)
        for token, i in vocab.items():
            end = token.endswith("</w>")
            body = token[:-4] if end else token
            if body and all(c in plain for c in body):
                ranks[bytes(plain[c] for c in body) + self.END.encode() * end] = i
                self.ends[i] = end
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{self.END}]+{self.END}", mergeable_ranks=ranks, special_tokens={}) if len(ranks) >= 49_000 else None
        self.cache: dict[str, bytes] = {}

    def fresh(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't cached."""
        out: list[bytes] = [b""] * len(words)
        pieces, counts, at = [], [], []
        for k, w in enumerate(words):
            low = w.lower()
            if self.fast is None or not (w.isascii() or PLAIN.fullmatch(w) and PLAIN.fullmatch(low) and unicodedata.is_normalized("NFC", w)):
                out[k] = array("H", self.full.encode(w, add_special_tokens=False).ids).tobytes()
                continue
            body = low.rstrip(".,;:!?#*$%&|)")
            if body.isalpha():
                parts = (body,) if len(body) == len(low) else (body, low[len(body) :])
            else:
                parts = PIECE.findall(low)
            pieces += parts
            counts.append(len(parts))
            at.append(k)
        if pieces:
            ids = np.array(self.fast.encode_ordinary(self.END.join(pieces) + self.END), "<u2")
            last = np.flatnonzero(self.ends[ids])[np.cumsum(counts) - 1] + 1
            data, start = ids.tobytes(), 0
            for k, stop in zip(at, (2 * last).tolist(), strict=True):
                out[k] = data[start:stop]
                start = stop
        return out

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 16-bit numbers."""
        known, rows, new = self.cache.get, [], {}
        for text in texts:
            if text and self.ODD.search(text):
                rows.append([array("H", self.full.encode(text, add_special_tokens=False).ids).tobytes()])
                continue
            words = text.split() if text else []
            ids = list(map(known, words))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = new.setdefault(words[i], len(new))
            rows.append(ids)
        found = self.fresh(list(new))
        for w, x in zip(new, found, strict=True):
            if len(self.cache) >= CACHE_WORDS:
                break
            self.cache[w] = x
        return [b"".join([found[x] if type(x) is int else x for x in ids]) for ids in rows]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own WordIds, kept from task to task with its cache."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """_rid, doc_id, n and ids (16 bits each, the end id last) of every whole text (null: empty)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for part in slices(batch):
                ids = [x + end for x in words.texts(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("_rid"), part.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["_rid", "doc_id", "n", "ids"])

    return docs.select("_rid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, IDS_SCHEMA)


def combinations(hist: np.ndarray) -> list[tuple[int, ...]]:
    """Lengths, two or three, that fill a window exactly: all pairs, and triples over the heaviest lengths."""
    window = len(hist) - 1
    have = [int(x) for x in np.flatnonzero(hist[:window]) if x]
    out = [(a, window - a) for a in have if a <= window - a and hist[window - a]]
    heavy = sorted(sorted(have, key=lambda x: (-hist[x], x))[:HEAVY])
    for a in have:
        for b in heavy:
            c = window - a - b
            if c >= max(a, b) and a <= b and hist[c]:
                out.append((a, b, c))
    return sorted(set(out))


def repeats(hist: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """Counts x >= 0 of the combinations that fit the histogram by least squares (cyclic coordinate descent),
    rounded down, so that no length is used more often than it occurs."""
    x, left = np.zeros(len(combos)), hist.astype(float)
    uses = [{l: c.count(l) for l in c} for c in combos]
    norm = [sum(v * v for v in u.values()) for u in uses]
    for _ in range(SWEEPS):
        moved = 0.0
        for j, u in enumerate(uses):
            step = max(-x[j], sum(v * left[l] for l, v in u.items()) / norm[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for l, v in u.items():
                    left[l] -= v * step
        if moved < 0.25:
            break
    out, room = np.zeros(len(combos), np.int64), hist.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        out[j] = min(int(x[j]), *(room[l] // v for l, v in uses[j].items()))
        for l, v in uses[j].items():
            room[l] -= v * out[j]
    return out


def plan(hist: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset, base) rows that say where the pieces of a length go.

    A combination's rows give its pieces, in order of rank, one sequence each (base -1). The last row of each length
    gives what is left: piece after piece from token base on, cut at window ends, in sequences after the first.
    """
    window = len(hist) - 1
    rows, used, sequence = [], np.zeros(window + 1, np.int64), 0
    combos = combinations(hist)
    for c, n in zip(combos, repeats(hist, combos), strict=True):
        if n:
            offset = 0
            for length in c:
                rows.append((length, int(used[length]), int(used[length] + n - 1), sequence, offset, -1))
                used[length] += n
                offset += length
            sequence += int(n)
    full = int(hist[window])
    if full:
        rows.append((window, 0, full - 1, sequence, 0, -1))
        used[window] = full
        sequence += full
    base = 0
    for length in range(window - 1, 0, -1):  # longest first
        if left := int(hist[length] - used[length]):
            rows.append((length, int(used[length]), int(hist[length] - 1), sequence, 0, base))
            base += left * length
    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each document, with the checksum of their ids."""
    for batch in batches:
        cols: list[list[int]] = [[] for _ in range(7)]
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], "<u2").astype("<u4")
            for p in sorted(row["pieces"], key=lambda p: p["start"]):
                part = ids[p["start"] : p["start"] + p["length"]]
                for c, v in zip(cols, (row["doc_id"], p["start"], p["length"], zlib.crc32(part.tobytes()), row["n"], p["sequence_id"], p["offset"]), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def placed(sizes: DataFrame, window: int = WINDOW) -> DataFrame:
    """_rid, start, length, sequence_id, offset of the pieces of documents (_rid, n) cut to windows.

    Ranks within a length are counted by bucket of documents, so no length, however common, meets in one task.
    """
    spark = sizes.sparkSession
    buckets = max(1, -(-sizes.count() // BUCKET_ROWS))
    pieces = sizes.select("_rid", F.explode(F.expr(f"sequence(0L, n - 1, {window}L)")).alias("start"), "n")
    pieces = pieces.select("_rid", "start", F.least(F.col("n") - F.col("start"), F.lit(window)).cast("int").alias("length"), F.pmod(F.xxhash64("_rid"), F.lit(buckets)).cast("int").alias("_b"))
    counts = pieces.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("c"))
    hist = np.zeros(window + 1, np.int64)
    counts = materialize(counts)
    for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect():  # window rows at most
        hist[r["length"]] = r["c"]
    rows = plan(hist) or [(0, 0, 0, 0, 0, 0)]
    where = spark.createDataFrame(rows, "_l int, lo long, hi long, first long, at long, base long")  # some rows for each combination
    from pyspark.sql import Window as W

    before = counts.withColumn("before", F.sum("c").over(W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).select("length", "_b", F.coalesce("before", F.lit(0)).alias("before"))
    local = pieces.repartition("_b", "length").withColumn("k", F.row_number().over(W.partitionBy("_b", "length").orderBy("_rid", "start")))
    ranked = local.join(before, ["_b", "length"]).select("_rid", "start", "length", (F.col("before") + F.col("k") - 1).alias("rank"))
    # the plan's rows by length as one array each (at most a few thousand short ones in all)
    table = where.groupBy("_l").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "at", "base"))).alias("plan"))
    hit = ranked.join(F.broadcast(table), F.col("length") == F.col("_l")).withColumn("p", F.filter("plan", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") <= x["hi"]))[0])
    i = F.col("rank") - F.col("p.lo")
    whole = F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), (F.col("p.first") + i).alias("sequence_id"), F.col("p.at").alias("offset"))
    pos = F.col("p.base") + i * F.col("length")
    head = F.least(F.col("length").cast("long"), window - F.pmod(pos, F.lit(window)))
    first = F.struct(F.col("start").cast("long").alias("start"), head.alias("length"), (F.col("p.first") + F.floor(pos / window)).cast("long").alias("sequence_id"), F.pmod(pos, F.lit(window)).cast("long").alias("offset"))
    second = F.struct((F.col("start") + head).cast("long").alias("start"), (F.col("length") - head).cast("long").alias("length"), (F.col("p.first") + F.floor(pos / window) + 1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cut = F.when(F.col("p.base") < 0, F.array(whole)).when(head == F.col("length"), F.array(first)).otherwise(F.array(first, second))
    return hit.select("_rid", F.explode(cut).alias("x")).select("_rid", "x.*")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece of docs (doc_id, text): where its ids stand in the document and in a sequence.

    A document is its ids and the end id; null or empty text is the end id alone. Documents are cut to windows, the
    ends are combined to full windows, and those left are laid end to end and cut. Only the last sequence may be
    short. Rows that repeat a doc_id are packed each on its own, null ids too. No rows: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"], docs["text"], F.monotonically_increasing_id().alias("_rid"))
    ids = materialize(token_ids(rows, path or tokenizer_path()))  # written, so that each row keeps its key
    small_batches(spark)
    pieces = placed(ids.select("_rid", "n"), window).groupBy("_rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    return ids.join(pieces.hint("shuffle_hash"), "_rid").select("doc_id", "n", "ids", "pieces").mapInArrow(_cut, PIECES_SCHEMA)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
