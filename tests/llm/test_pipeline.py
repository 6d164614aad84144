"""Each stage of the pipeline against a slow version over its own input, on the small table and on edge cases."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
import regex

import corpus_pipeline
from logsift.llm import mixing, packing, pii, toxicity

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, label string, key string, toxic long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module", params=["table", "edge", "empty"])
def steps(spark, request, tmp_path_factory):
    """Input and output of each stage, in order."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    if request.param != "table":
        long = " ".join(f"w{i % 977}" for i in range(9_000))
        rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (1, "other words here", "en", None), (None, "no id, Mr. Smith", None, "a"), (None, None, None, None), (2, "", "en", "b"), (3, " \n ", "de", "b"), (4, long, "en", "a"), (5, long, "en", "a")]
        docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", "y", 9) for r in rows if request.param == "edge"], SCHEMA)
    out, folder = [], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        new = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, new))
        docs = new
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return collections.Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_columns_and_order(steps):
    assert list(steps) == ["toxicity", "ngram_jaccard", "pii", "mixing", "packing"]
    assert all(b.columns == COLUMNS for name, (_, b) in steps.items() if name != "packing")


def test_toxicity_drops_what_it_predicts(spark, steps):
    docs, kept = steps["toxicity"]
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    bad = collections.Counter(r.doc_id for r in scored.where("predicted = 1").collect())
    gone = rows(docs) - rows(kept)
    assert not rows(kept) - rows(docs) and collections.Counter(k[0] for k in gone.elements()) == bad
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [k[0] for k in rows(docs).elements() if labels.get(k[0]) == 0]
    assert sum(d in bad for d in clean) <= 0.05 * len(clean)


def test_first_of_each_class_stays(steps):
    docs, kept = steps["ngram_jaccard"]
    order = sorted(rows(docs).elements(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = []
    for r in order:
        w = [x for x in re.split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in r[1] or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for _ in range(3):
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label[a] = label[b] = min(label[a], label[b])
    assert rows(kept) == collections.Counter(order[i] for i, k in enumerate(label) if k == i)


def test_personal_data_goes(steps):
    docs, new = steps["pii"]
    old, now = sorted(rows(docs).elements(), key=repr), rows(new)
    found = regex.compile("|".join(f"(?:{p})" for k, p in pii.PATTERNS.items() if k in ("email", "ssn", "access")))
    same = [r for r in old if not re.search("[0-9@=]|" + "|".join(map(re.escape, pii.SIGNS)), r[1] or "")]
    assert not collections.Counter(same) - now and len(old) == sum(now.values())
    before = {x for r in old for x in found.findall(r[1] or "")}
    assert not any(x in before for r in now for x in found.findall(r[1] or ""))
    assert all(r[4] == len(r[1]) for r in now if r[1] is not None and r[:2] not in {x[:2] for x in old})


def test_mix_takes_whole_copies(steps):
    docs, mix = steps["mixing"]
    taken, want = rows(mix), collections.Counter()
    size = lambda t: len([x for x in re.split(r"[ \t-\r]+", t or "") if x])
    own, largest = collections.Counter(), collections.Counter()
    for r in rows(docs).elements():
        own[r[3]] += size(r[1])
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    targets = mixing.targets(list(own.items())) if own else {}
    for r, n in taken.items():
        assert n <= 2 * rows(docs)[r]
        want[r[3]] += n * size(r[1])
    assert all(abs(want[s] - t) <= max(0.01 * t, largest[s] / 2 + 1) for s, t in targets.items())


def test_pieces_hold_every_id(steps):
    from tokenizers import Tokenizer

    docs, pieces = steps["packing"]
    full = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for r, n in rows(docs).items():
        ids = np.array([*full.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r[0], len(ids)] += n * len(ids)
    got, at = collections.Counter(), {}
    for p in sorted(pieces.collect(), key=lambda p: (p.sequence_id, p.offset)):
        got[p.doc_id, p.doc_tokens] += p.length
        assert p.offset == at.get(p.sequence_id, 0)
        at[p.sequence_id] = p.offset + p.length
    assert got == want and all(n <= 4096 for n in at.values()) and sum(n < 4096 for n in at.values()) <= 1
    assert all(p.ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) for p in pieces.where("doc_tokens = 1").collect())
