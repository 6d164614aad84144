"""Removing repeated passages by suffix automata: the corpus is cut to shards of snippets that can hold a repeated
passage, each shard's automaton is built where the snippets that may match it are sent, and the snippets are streamed
through it in order of document for their matching statistics; spans of the threshold length or more are removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, slices
from .repeats import CHUNK, Kind, covered, with_runs

WIDTH = 20
GRAM = 8
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SuffixAutomaton:
    """All substrings of the token sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.last = [-1], [0], 0

    def add(self, tokens: list[bytes]) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for t in tokens:
            p = last
            q = nxt[p].get(t)
            if q is not None and size[q] == size[p] + 1:  # known from another sequence
                last = q
                continue
            if q is not None:
                last = self._split(p, q, t)
                continue
            last = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[p] + 1)
            while p >= 0 and t not in nxt[p]:
                nxt[p][t] = last
                p = link[p]
            if p >= 0:
                q = nxt[p][t]
                link[last] = q if size[q] == size[p] + 1 else self._split(p, q, t)

    def _split(self, p: int, q: int, t: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        c = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        size.append(size[p] + 1)
        while p >= 0 and nxt[p].get(t) == q:
            nxt[p][t] = c
            p = link[p]
        link[q] = c
        return c

    def matching(self, tokens: list[bytes]) -> Iterator[int]:
        """Length of the longest suffix of tokens up to each one that was added before."""
        nxt, link, size = self.next, self.link, self.size
        state = n = 0
        for t in tokens:
            while state and t not in nxt[state]:
                state = link[state]
                n = size[state]
            if t in nxt[state]:
                state, n = nxt[state][t], n + 1
            yield n


class ByAutomaton:
    """Windows of a bucket's snippets that also stand earlier (smaller row key, or earlier in the same text)."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, meta: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        rids, starts = [], []
        offset = np.concatenate(([0], np.cumsum(meta["size"])))
        order = np.lexsort((meta["start"], meta["rid"], meta["key"]))
        cuts = np.flatnonzero(np.diff(meta["key"][order])) + 1
        for shard in np.split(order, cuts) if len(order) else ():
            if len(shard) < 2:
                continue
            automaton, whole = SuffixAutomaton(), set()
            for i in shard.tolist():
                text, rid, start = body[offset[i] : offset[i + 1]], int(meta["rid"][i]), int(meta["start"][i])
                if text in whole:
                    found = range(int(meta["windows"][i]))
                else:
                    whole.add(text)
                    tokens = text.split(b" ")
                    found = [k - self.width + 1 for k, n in enumerate(automaton.matching(tokens)) if n >= self.width] if len(whole) > 1 else []
                    automaton.add(tokens)
                rids += [rid] * len(found)
                starts += [start + k for k in found]
        return np.array(rids, np.int64), np.array(starts, np.int64)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """_rid, doc_id, text and runs: the words of each row of docs (doc_id, text) that repeated windows cover."""
    return with_runs(keyed(docs), Kind(True, width, GRAM, True), ByAutomaton(width))


def kept_words(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, kept (words joined by one blank), n_words and n_removed of every row of docs (doc_id, text).

    A word goes if a window of width words over it also starts earlier: in a smaller doc_id, or earlier in its document.
    Null, empty and wordless texts have no word. Of rows that repeat a doc_id the one with the smaller text is earlier;
    rows with a null id are later than all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=CHUNK):
                out = [_kept(text, runs) for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])

    return remove_repeats(docs, width).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs").mapInArrow(run, "doc_id long, kept string, n_words long, n_removed long")


def _kept(text: str | None, runs: list | None) -> tuple[str, int, int]:
    words = [w.decode() for w in (text or "").encode().split()]  # bytes split at the six white space bytes only
    if not runs:
        return " ".join(words), len(words), 0
    gone = covered(len(words), runs)
    return " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), len(words), int(gone.sum())


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = kept_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
