"""Ranked lexical search: documents are sparse vectors of what each term adds to a score, in ball trees of a few thousand
rows. A subtree's best possible score is bounded by its centroid and radius with rounding upwards, subtrees are taken best
first, and leaves are scored in exact integers."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, slices, small_batches, text_bytes
from .terms import LOWER, Spans, byte_set, token_spans

#: Bytes that are no part of a term: all ASCII but digits and letters.
SPLITS = ~byte_set([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
TOP = 50
#: Documents of a tree, and of a leaf.
TREE_ROWS = 8_192
LEAF_ROWS = 48
#: Items and bytes of their texts that are searched in one pass over the documents; both bound what is broadcast.
BLOCK_ITEMS = 2_000
BLOCK_BYTES = 1 << 18
#: Groups whose best rows are found before all of an item's meet.
SALTS = 64
LAST = (1 << 63) - 1  # where a null doc_id stands among ties
_NONE = np.zeros(0, np.int64)


def lookup(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second hash of each term, ordered by the first, and the term's number."""
    ends = np.cumsum([0, *map(len, terms)])
    both = Spans(np.frombuffer(b"".join(terms), np.uint8))
    one, two = both.one(ends[:-1], ends[1:]), both.two(ends[:-1], ends[1:])
    order = np.argsort(one, kind="stable")
    return one[order], two[order], order.astype(np.int64)


def split_terms(text: str | None) -> set[bytes]:
    data = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    starts, stops, _ = token_spans(data, np.array([0, len(data)]), SPLITS)
    raw = data.tobytes()
    return {raw[a:b] for a, b in zip(starts, stops, strict=True)}


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (all terms), terms and counts (those of the list, ascending, by number) of every whole text."""
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(lookup(terms))  # terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, number = table.value
        for batch in batches:
            for part in slices(batch, "_text"):
                data, offsets = text_bytes(part.column("_text"))
                data = LOWER[data]
                starts, stops, owner = token_spans(data, offsets, SPLITS)
                n = np.bincount(owner, minlength=part.num_rows)
                docs_, ids = _NONE, _NONE
                if len(starts) and len(one):
                    hashes = Spans(data)
                    h = hashes.one(starts, stops)
                    left, right = np.searchsorted(one, h), np.searchsorted(one, h, side="right")
                    hit = np.flatnonzero(left < right)
                    h2 = hashes.two(starts[hit], stops[hit])
                    for k in range(int((right - left).max())):  # once, unless two terms have one hash
                        at = left[hit] + k
                        good = (at < right[hit]) & (two[np.minimum(at, len(two) - 1)] == h2)
                        docs_, ids = np.concatenate((docs_, owner[hit[good]])), np.concatenate((ids, number[at[good]]))
                pairs, counts = np.unique(docs_ * max(1, len(one)) + ids, return_counts=True)
                rows, ids = pairs // max(1, len(one)), pairs % max(1, len(one))
                cuts = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, t)) for x, t in ((ids, pa.int32()), (counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def term_weights(counted: DataFrame, n_docs: int, width: int) -> np.ndarray:
    """Weight of each term by the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=width)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["term", "df"])

    df = np.zeros(width, np.int64)
    for row in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row["term"]] = row["df"]  # a row for each term of the block's items at most
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def gains(n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each term of each document adds to a score; sizes are the documents' numbers of terms in the flat arrays."""
    if len(n) and 50 * int(n.max()) * n_docs >= 1 << 62:
        m = np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    else:
        m = 50 + 50 * n * n_docs // max(1, n_terms)
    return weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * np.repeat(m, sizes)))


class BallTree:
    """Balls over sparse vectors (rows end to end: starts, terms, values; none empty), and the best score each allows for each item."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, items: np.ndarray, cuts: np.ndarray, leaf: int = LEAF_ROWS):
        self.items, self.cuts = items, cuts  # terms of the items end to end, none of them empty
        # a sum of up to width products in doubles is off by less than this share
        self.slack = (width + 64) * 2.0**-51
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, last row + 1, left and right child (or -1)
        self.bounds: list[np.ndarray] = []
        sizes = np.diff(starts)
        norms = np.add.reduceat(values.astype(float) ** 2, starts[:-1])
        order = np.arange(len(sizes))
        todo = [(0, len(sizes), -1, 0)]
        floats = values.astype(float)
        while todo:
            low, high, parent, side = todo.pop()
            rows = order[low:high]
            at = np.repeat(starts[rows] - np.concatenate(([0], np.cumsum(sizes[rows])[:-1])), sizes[rows]) + np.arange(sizes[rows].sum())
            begin = np.concatenate(([0], np.cumsum(sizes[rows])[:-1]))
            t, v = terms[at], floats[at]
            centre = np.bincount(t, weights=v, minlength=width) / len(rows)
            own = float(centre @ centre)
            # |x - c|^2 with all that rounding may have taken away
            far2 = norms[rows] - 2 * np.add.reduceat(v * centre[t], begin) + own
            radius = math.sqrt(max(0.0, float((far2 + self.slack * (norms[rows] + 3 * own)).max())))
            # terms that no row of the ball holds add nothing: an item's vector is as long as the terms that the centre has
            root = np.sqrt(np.add.reduceat((centre[items] > 0).astype(float), cuts[:-1]))
            bound = (np.add.reduceat(centre[items], cuts[:-1]) + root * radius) * (1 + self.slack) + 1
            me = len(self.nodes)
            self.nodes.append((low, high, -1, -1))
            self.bounds.append(bound)
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, me, right) if side == 0 else (a, b, left, me)
            if len(rows) > leaf and radius > 0:
                ends = [np.bincount(terms[starts[r] : starts[r + 1]], weights=floats[starts[r] : starts[r + 1]], minlength=width) for r in self._poles(rows, far2, t, v, begin, starts, terms, floats, norms, width)]
                side_of = np.add.reduceat(v * (ends[0] - ends[1])[t], begin)
                half = len(rows) // 2
                order[low:high] = rows[np.argsort(side_of, kind="stable")]
                todo += [(low + half, high, me, 1), (low, low + half, me, 0)]
        self.order = order
        # rows in the tree's order, so that a leaf is one range
        at = np.repeat(starts[order] - np.concatenate(([0], np.cumsum(sizes[order])[:-1])), sizes[order]) + np.arange(sizes.sum())
        self.starts, self.terms, self.values = np.concatenate(([0], np.cumsum(sizes[order]))), terms[at], values[at]
        self.wanted = np.zeros(width, bool)

    @staticmethod
    def _poles(rows, far2, t, v, begin, starts, terms, floats, norms, width) -> tuple[int, int]:
        """The row farthest from the centre, and the one farthest from that."""
        a = rows[int(far2.argmax())]
        dense = np.bincount(terms[starts[a] : starts[a + 1]], weights=floats[starts[a] : starts[a + 1]], minlength=width)
        away = norms[rows] - 2 * np.add.reduceat(v * dense[t], begin)
        return int(a), int(rows[int(away.argmax())])

    def search(self, item: int, best: list[tuple[int, int]], ids: np.ndarray, top: int) -> int:
        """Put the rows that rank among the first into best, a heap of (score, -id); the number of rows that were scored."""
        own = self.items[self.cuts[item] : self.cuts[item + 1]]
        self.wanted[own] = True
        queue, scored = [(-self.bounds[0][item], 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == top and -bound < best[0][0]:
                break  # no other subtree can do better
            low, high, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(queue, (-self.bounds[left][item], left))
                heapq.heappush(queue, (-self.bounds[right][item], right))
                continue
            a, b = self.starts[low], self.starts[high]
            scores = np.add.reduceat(np.where(self.wanted[self.terms[a:b]], self.values[a:b], 0), self.starts[low:high] - a)
            scored += high - low
            least = best[0][0] if len(best) == top else 1
            for k in np.flatnonzero(scores >= max(1, least)):
                entry = (int(scores[k]), -int(ids[self.order[low + k]]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        self.wanted[own] = False
        return scored


def search_block(counted: DataFrame, names: list, item_terms: list[list[int]], width: int, top: int = TOP, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The best rows of each task for each item: item (by place in names), doc_id, score."""
    spark = counted.sparkSession
    sums = counted.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = sums["docs"], sums["terms"]
    cuts = np.cumsum([0, *map(len, item_terms)])
    items = np.array([t for x in item_terms for t in x], np.int64)
    shared = spark.sparkContext.broadcast((items, cuts, term_weights(counted, n_docs, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, cuts, weights = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in range(len(cuts) - 1)]
        held: list[tuple[np.ndarray, ...]] = []

        def grow() -> None:
            ids, n, sizes, terms, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            starts = np.concatenate(([0], np.cumsum(sizes)))
            tree = BallTree(starts, terms, gains(n, sizes, terms, counts, weights, n_docs, n_terms), width, items, cuts)
            for i, heap in enumerate(best):
                tree.search(i, heap, ids, top)

        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy()).astype(np.int64)
            some = sizes > 0  # the others score 0
            ids = batch.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy()
            terms, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts"))
            if some.any():
                held.append((ids[some], n[some], sizes[some], terms, counts))
            if sum(len(x[0]) for x in held) >= tree_rows:
                grow()
        if held:
            grow()
        rows = [(i, None if -d == LAST else -d, s) for i, heap in enumerate(best) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))], names=["item", "doc_id", "score"])

    return counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents with a score above 0 for each item (item_id, text).

    Terms are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. Equal scores go by ascending
    doc_id, a null one last. Items are searched in blocks, each in one pass over all documents. Rows that repeat an
    item_id, null too, are one item with the terms of all of them; an item without terms has no rows. Rows that repeat a
    doc_id are documents of their own. Null, empty and wordless texts have no terms and no rank; very long texts are read
    whole. No documents or no items: no rows.
    """
    spark = docs.sparkSession
    queries = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text"))
    sizes = queries.agg(F.countDistinct("item_id").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-(sizes["n"] + 1) // block_items), -(-sizes["b"] // block_bytes))
    found = None
    for block in range(blocks):
        own: dict = {}
        for row in queries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            own.setdefault(row["item_id"], set()).update(split_terms(row["text"]))
        names = [k for k, v in own.items() if v]
        terms = sorted(set().union(*(own[k] for k in names)))
        if not names:
            continue
        number = {t: i for i, t in enumerate(terms)}
        counted = materialize(term_counts(docs, terms))
        rows = search_block(counted, names, [sorted(number[t] for t in own[k]) for k in names], len(terms), top)
        ids = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")  # one block's
        part = materialize(best_rows(rows, top).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
        discard(counted)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def best_rows(rows: DataFrame, top: int) -> DataFrame:
    """The top rows of each item with their rank: first of each of SALTS groups, then of what those leave."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH t AS (SELECT r, doc_id, unnest({_TERMS.format("text")}) AS term FROM (SELECT row_number() OVER () AS r, * FROM documents)),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
sizes AS (SELECT r, sum(tf)::BIGINT AS size FROM tf GROUP BY r),
whole AS (SELECT count(*) AS docs, sum(size)::BIGINT AS all_terms FROM sizes),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * size * docs) // all_terms))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN sizes USING (r), whole GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
