"""License scan, ranked search and phrases against SQL and slow versions, on the small table and on odd ones."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from logsift.llm import lexical, licenses, phrases, toxicity
from logsift.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "Released undr the MIT-Licence. mit license, MIT license!", "en"), (1, "Released undr the MIT-Licence. mit license, MIT license!", "en"), (2, None, "en"), (3, "", None), (None, "all rights resérved now", None),
    (4, f"{LONG} general public license {LONG}", "en"), (5, "permit license; mit\nlicense", "de"), (6, " . , ", "de"), (7, "GNU  Lesser__General (Public) License x", None), (8, "é" * 50 + " gnu affero genral publc license", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in TEXTS], "doc_id long, text string, lang string, n long, term string, rank string, score int")


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_lexical_search", "op13_collocations"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got, want = QUERIES[name](spark, SMALL), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    near = lambda r: tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in r)
    rows = sorted(map(repr, (near(r[c] for c in want.columns) for r in got.collect())))
    assert rows == sorted(map(repr, map(near, want.fetchall())))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def slow_licenses(text: str | None) -> tuple:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    at = [(i, label) for i in range(len(words)) for p, label in licenses.PHRASES if words[i : i + len(p.split())] == p.split()]
    labels, score = {x for _, x in at}, 1.0 if at else 0.0
    for label, notice in licenses.NOTICES:
        k = len(notice) // licenses.CHARS_PER_EDIT
        for i in range(len(words)):
            part = ""
            for w in words[i : i + len(notice)]:
                part = f"{part} {w}" if part else w
                if len(part) > len(notice) + k:
                    break
                if len(part) >= len(notice) - k and (d := edits(part, notice)) <= k:
                    labels.add(label)
                    score = max(score, 1 - d / len(notice))
    first = min((i for i, _ in at), default=None)
    return len(words), len(at), first, max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), score


def test_licenses_equal_a_slow_version():
    rng = random.Random(5)
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_PER_EDIT)
    for n in range(120):
        notice = rng.choice(licenses.NOTICES)[1]
        chars = list(notice)
        for _ in range(rng.randint(0, len(notice) // 10 + 2)):
            i = rng.randrange(len(chars))
            chars[i : i + 1] = rng.choice([[], [chars[i], rng.choice("ab é")], [rng.choice("xyz -")]])
        pad = lambda: " ".join(rng.choice(["mit", "license", "the", "öde", "public", "q"]) for _ in range(rng.randint(0, 6)))
        text = f"{pad()}{rng.choice(['. ', ' ', 'é'])}{''.join(chars).title() if n % 3 else ''.join(chars)}{rng.choice([', ', ' ', ''])}{pad()}"
        got = scanner.scan(text)
        want = slow_licenses(text)
        assert got[:6] == want[:6] and abs(got[6] - want[6]) < 1e-12, (text, got, want)
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
        for s in got[7]:  # each span is what it says
            assert edits(" ".join(words[s["first_word"] : s["last_word"] + 1]), s["notice"]) == s["edits"] <= len(s["notice"]) // 10


def test_odd_texts_are_scanned(odd):
    got = {r.doc_id: r for r in licenses.scan_licenses(odd).collect()}
    assert licenses.scan_licenses(odd).count() == len(TEXTS) and licenses.scan_licenses(odd.limit(0)).count() == 0
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (2, 5, 7, "mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0) and got[3].n_words == 0
    assert (got[4].n_words, got[4].first_word, got[4].base_labels) == (60_003, 30_000, "gpl")
    assert (got[5].n_base, got[7].labels, got[8].labels, got[None].labels) == (1, "gpl,lgpl", "agpl", "proprietary")
    with pytest.raises(ValueError):
        licenses.scan_licenses(odd, [("x", "Not  plain")])


def slow_search(docs, items, top=50):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = set()
    for i, own in wanted.items():
        scored = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out |= {(i, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)}
    return out


def test_search_equals_a_slow_version(spark, odd):
    items = [(1, "The MIT license"), (1, "w5 Public"), (2, None), (3, ""), (None, "now gnu"), (4, "w1 w2 w3 nowhere"), (5, "...")]
    it = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id int, rank string")
    as_set = lambda df: {(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()}
    want = slow_search([t[:2] for t in TEXTS], items)
    got = lexical.ranked_search(odd, it)
    assert as_set(got) == want and got.count() == len(want)
    assert as_set(lexical.ranked_search(odd, it, block_items=2)) == want  # several blocks
    assert lexical.ranked_search(odd.limit(0), it).count() == 0 == lexical.ranked_search(odd, it.limit(0)).count()


def test_trees_prune_and_lose_nothing():
    rng = np.random.Generator(np.random.PCG64(2))
    width, n = 300, 3_000
    rows = []
    for k in range(n):  # clusters of alike rows, many ties
        base = (k % 30) * 10
        rows.append(np.unique(rng.integers(base, base + 12, 8) % width))
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    terms = np.concatenate(rows)
    values = rng.integers(1, 50, len(terms)) * 1_000_000_007
    items = [np.unique(rng.integers(0, width, 6)) for _ in range(25)] + [np.arange(40, 52)]
    cuts = np.cumsum([0, *map(len, items)])
    tree = lexical.BallTree(starts, terms, values, width, np.concatenate(items), cuts)
    ids, scored = rng.permutation(n), 0
    for i, own in enumerate(items):
        best: list = []
        scored += tree.search(i, best, ids, 20)
        dense = np.array([values[starts[r] : starts[r + 1]][np.isin(rows[r], own)].sum() for r in range(n)])
        assert sorted(best, reverse=True) == sorted(((int(s), -int(d)) for s, d in zip(dense, ids, strict=True) if s > 0), reverse=True)[:20]
    assert scored < 0.9 * n * len(items)  # subtrees were left out


def slow_phrases(docs, least, top=2_000):
    f: Counter = Counter()
    n: Counter = Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in cands.items():
        if any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in cands.items()):
            continue
        cuts = [(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]]).__floor__(), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        s, _, l, r = min(cuts)
        out.append((lang, " ".join(p), a, l, r, n[lang], s))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def test_phrases_equal_a_slow_version(spark, odd, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(["A", "b", "cé", "New York", "the", "*|"]) + rng.choice([" ", " ", "\t", ", ", "\n", "  "]) for _ in range(rng.randint(0, 150)))) for _ in range(60)]
    rows += [("en", "new york city hall is open. ")] * 9 + [("fr", "x " * 5_000), ("fr", None), ("fr", "")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "lang string, text string, n long, phrase string, rank string")
    as_list = lambda d: sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in d.collect())
    want = slow_phrases(rows, 5)
    assert len(want) > 100 and as_list(phrases.collocations(df, 5)) == want
    assert as_list(phrases.collocations(df, 5, bits=64)) == want  # a filter that is full lets all through
    assert as_list(phrases.collocations(df, 5, top=3)) == slow_phrases(rows, 5, 3)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    assert as_list(phrases.collocations(df, 5)) == want
    assert phrases.collocations(df.limit(0)).count() == 0 and as_list(phrases.collocations(odd, 20)) == slow_phrases([(t[2], t[1]) for t in TEXTS], 20)


def test_scores_beyond_64_bits(spark):
    rows = [(10**12 + 7, 10**14 + 3, 10**12 + 9, 10**12 + 11), (100, 10**15, 100, 101), (3, 7, 10**13, 10**13)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [x[0] for x in df.select(phrases.cut_score(*(df[c] for c in "anlr"))).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_toxic_words_are_found_and_clean_ones_left(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    marked = labels.where("toxic is not null")
    got = Counter((r.toxic, r.predicted) for r in toxicity.score_toxicity(docs.join(marked.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out").join(marked, "doc_id").collect())
    assert got[1, 1] >= 0.94 * (got[1, 0] + got[1, 1]) and got[0, 1] <= 0.015 * (got[0, 0] + got[0, 1])
    lm = toxicity.character_model(docs)
    scorer = toxicity.Scorer(lm, *toxicity.fit(docs, labels, lm))
    for text in ("worth it", "pathway and pathology", "Worte und Wörter", "clownfish", "disguise, disgruntled idiom"):
        assert scorer.score(text) < toxicity.THRESHOLD
    for text in ("you 1d10t", "w o r t h l e s s", "morrron", "st up id", "iddiot"):
        assert scorer.score(text) >= toxicity.THRESHOLD
    none = spark.createDataFrame([(1, 1, None), (2, 0, None)], "doc_id long, quality int, toxic int")
    few = docs.limit(50)
    assert {r.score for r in toxicity.score_toxicity(few, none).collect()} == {r.score for r in toxicity.score_toxicity(few, none.limit(0)).collect()} == {0.0}
