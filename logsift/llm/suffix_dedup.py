"""Removing bytes that repeat across documents by a depth-limited radix sort: suffixes are put in order by passes
over eight bytes at a time, most significant first, through the threshold length only; a group that is down to one
document drops out, and groups still equal at that depth are exactly the repeated windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, slices
from .repeats import CHUNK, Kind, covered, with_runs

WIDTH = 50
GRAM = 20
DIGIT = 8


class ByRadix:
    """Windows of a bucket's snippets that also stand in a row with a smaller key."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, meta: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        rid, step, at = self._windows(meta)
        # whole equal snippets of one anchor: all windows of those after the first document's stand in it
        groups, least = np.zeros(len(meta), np.int64), {}
        for i, (key, start, size) in enumerate(zip(meta["key"].tolist(), at.tolist(), meta["size"].tolist(), strict=True)):
            groups[i] = least.setdefault((key, body[start : start + size]), len(least))
        first = np.full(len(least), np.iinfo(np.int64).max)
        np.minimum.at(first, groups, rid)
        copy = rid > first[groups]
        late, steps = self._sorted(meta[~copy], at[~copy], body) if len(least) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        which = np.repeat(np.flatnonzero(copy), step[copy])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(step[copy]) - step[copy], step[copy])
        late = np.flatnonzero(~copy)[late]
        return np.concatenate((rid[which], rid[late])), np.concatenate((meta["start"][which] + inner, meta["start"][late] + steps)).astype(np.int64)

    @staticmethod
    def _windows(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row key, number of windows, and place of the body of each snippet."""
        ends = np.cumsum(meta["size"], dtype=np.int64)
        return meta["rid"].astype(np.int64), meta["windows"].astype(np.int64), ends - meta["size"]

    def _sorted(self, meta: np.ndarray, offset: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Snippet and step of each window that also stands in one of a smaller row key: passes of eight bytes, most
        significant first."""
        none = np.zeros(0, np.int64)
        anchors, group = np.unique(meta["key"], return_inverse=True)
        several = np.bincount(group, minlength=len(anchors)) > 1
        reps = np.where(several[group], meta["windows"].astype(np.int64), 0)
        which = np.repeat(np.arange(len(meta)), reps)
        if not len(which):
            return none, none
        step = np.arange(len(which)) - np.repeat(np.cumsum(reps) - reps, reps)
        data = np.frombuffer(body + bytes(DIGIT), np.uint8)
        at, rid, group = offset[which] + step, meta["rid"][which].astype(np.int64), group[which]
        live = np.argsort(group, kind="stable")
        group = group[live]
        for depth in [*range(0, self.width - DIGIT + 1, DIGIT), *([self.width - DIGIT] if self.width % DIGIT else [])]:
            digit = np.zeros(len(live), np.uint64)
            for k in range(DIGIT):
                digit = (digit << np.uint64(8)) | data[at[live] + (depth + k)]
            order = np.lexsort((digit, group))
            live, digit, group = live[order], digit[order], group[order]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
            begin = np.flatnonzero(new)
            apart = np.minimum.reduceat(rid[live], begin) != np.maximum.reduceat(rid[live], begin)
            group = np.cumsum(new) - 1
            keep = apart[group]
            live, group = live[keep], group[keep]
            if not len(live):
                return none, none
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.repeat(np.minimum.reduceat(rid[live], begin), np.diff(np.concatenate((begin, [len(live)]))))
        late = live[rid[live] > least]
        return which[late], step[late]


def remove_bytes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed and n_spans of every row of docs (doc_id, text).

    A byte goes if a string of width bytes over it also starts in a document with a smaller doc_id. Null text is empty.
    Of rows that repeat a doc_id the one with the smaller text counts as the smaller; null ids are the largest.
    """
    both = with_runs(keyed(docs), Kind(False, width, GRAM, False), ByRadix(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=CHUNK):
                out = []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    data = (text or "").encode()
                    gone = covered(len(data), runs)
                    n = int(gone.sum())
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    out.append((np.frombuffer(data, np.uint8)[~gone].tobytes() if n else data, len(data), n, spans))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in out], pa.binary()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return both.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs").mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
