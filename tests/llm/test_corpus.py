"""Corpus operators against brute force on the small table, and on nulls, repeated rows and empty tables."""

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from logsift.llm import fingerprint, jaccard, langid, mixing, packing, pii, quality, repeats, substring_dedup, suffix_dedup, toxicity
from logsift.llm.queries import ORACLE_SQL

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, label string, key string, rep long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def edge(spark):
    """Null, empty, blank, repeated and very long texts, null and repeated ids, columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (1, "other words here", "en", None), (None, "no id at all", None, "a"), (None, None, None, None), (2, "", "en", "b"), (3, " \n\t ", "de", "b"), (4, long, "en", "a"), (5, long, "en", "a")]
    return spark.createDataFrame([(*r, 0, 7, "x", "y", 9) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")


def test_edge_and_empty(spark, edge, labels):
    runs = {
        "quality": quality.host_quality, "substring": substring_dedup.kept_words, "suffix": suffix_dedup.remove_bytes, "pii": pii.replace_entities,
        "lang": langid.predict_language, "toxic": lambda d: toxicity.score_toxicity(d, labels), "jaccard": jaccard.jaccard_classes, "print": fingerprint.edited_likeness, "mix": mixing.mix,
    }
    for name, f in runs.items():
        assert f(edge).count() == 9, name
        assert f(edge.limit(0)).count() == 0, name
    pieces = packing.pack(edge).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 5, None}
    assert packing.pack(edge.limit(0)).count() == 0


def test_edge_results(edge):
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.kept_words(edge).collect())
    assert (5, 30_000, 30_000) in got and (0, 0, 0) in got
    ids = [(r.doc_id, r.component_id, r.n_shingles) for r in jaccard.jaccard_classes(edge).collect()]
    assert (5, 4, 977) in ids and (3, 3, 0) in ids and ids.count((1, 1, 2)) == 2
    assert [r.lang_pred for r in langid.predict_language(edge).where("doc_id in (2, 3)").collect()] == ["und", "und"]


def test_quality_equals_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want, got = con.sql(ORACLE_SQL["op1_quality_rules"]), quality.host_quality(docs)
    cols = ", ".join(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.select(cols).fetchall())


def test_repeated_words(texts, docs):
    seen, want = set(), {}
    for d, t in texts:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone[i : i + 20] = True
            seen.add(g)
        want[d] = (len(w), int(gone.sum()), b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.kept_words(docs).collect()} == want


def test_repeated_bytes(texts, docs):
    seen, want = {}, {}
    for d, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], d) < d:
                gone[i : i + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[d] = (len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_bytes(docs).collect()} == want


def test_packing_round_trip(texts, docs):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d: np.array([*full.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts}
    rows = sorted(packing.pack(docs).collect(), key=lambda r: (r.doc_id, r.start))
    for d, own in itertools.groupby(rows, key=lambda r: r.doc_id):
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids[d])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[d][r.start : at].tobytes())
        assert at == len(ids[d])
    sizes = []
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert max(sizes) <= 4096 and sum(x < 4096 for x in sizes) <= 1


def test_mixing_near_targets(docs):
    rows = mixing.mix(docs).collect()
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs).collect()))
    assert abs(sum(r.taken for r in rows) / (1.5 * sum(r.size for r in rows)) - 1) < 0.05
    assert mixing.targets([("a", 100), ("b", 10), (None, 10)]) == {"a": 140.0, "b": 20.0, None: 20.0}


def test_jaccard_equals_brute_force(texts, docs):
    sets = {}
    for d, t in texts:
        w = [x for x in re.split(r"[ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    for _ in range(3):
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()} == {d: (len(s), label[d]) for d, s in sets.items()}


def test_surrogates(spark):
    text = "Mr. John Smith met Mrs. Smith; call +1 (743) 555-3824 or a.b1@mail5.example.com, card 4871316720949013, at 70.23.22.57."
    rows = [(1, text), (2, "a.b1@mail5.example.com again"), (3, "CC BY-NC 4.0, 12 pages"), (4, None)]
    out = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    new = out[1].text
    assert not any(x in new for x in ("Smith", "743", "a.b1@", "4871316720949013", "70.23.22.57"))
    m = re.fullmatch(r"Mr\. \w+ (\w+) met Mrs\. (\w+); call \+1 \(\d{3}\) \d{3}-\d{4} or (\S+@\S+\.com), card (4\d{15}), at ([\d.]+)\.", new)
    assert m and m[1] == m[2] and m[3] in out[2].text
    digits = [int(x) for x in m[4]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    assert out[3].text == rows[2][1] and out[4].text is None


def test_fingerprints(texts, docs):
    rows = sorted(fingerprint.edited_likeness(docs).collect(), key=lambda r: r.doc_id)
    for i, (r, (d, t)) in enumerate(zip(rows, texts, strict=True)):
        u, k = texts[(i + 1) % len(texts)][1], len(t) // 4
        assert (r.doc_id, r.n_chars) == (d, len(t))
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
    assert np.mean([r.near_edited for r in rows]) > 0.5 > np.mean([r.near_next for r in rows])


def test_language_and_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = langid.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    labels = spark.read.parquet(f"{d}/labels.parquet")
    tox = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.score for r in tox if r.toxic]) > 0.5 > 0.1 > np.mean([r.score for r in tox if not r.toxic])


def test_restored_words():
    lm = np.full((27, 27, 27), -5.0)
    for w in ("idiot", "loser"):
        x = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            lm[a, b, c] = -0.5
    r = toxicity.Restorer(lm)
    assert "idiot" in r.text("you 1d10t").split() and "loser" in r.text("l.o.s.e.r").split() and "idiot" in r.text("idioooot!").split()


def test_snippets_in_any_order(spark):
    kind, common = substring_dedup.Kind(True, 20, 8, True), np.zeros(0, np.uint64)
    text = " ".join(f"w{i}" for i in range(40))
    whole = repeats.Chunk(pa.array([text]), kind)
    keys = sorted({int(k) for k in whole.grams[whole.anchor].view(np.int64)})
    rows = [(5, text, keys), (10, text, keys), (7, text + " tail", keys)]
    sent = lambda x: [tuple(map(bytes, r[1:])) + r[:1] for r in repeats.sent_snippets(spark.createDataFrame(x, "_rid long, text string, keys array<long>").coalesce(1), kind, 64, common).collect()]
    assert sent(rows) and sent(rows) == sent(rows[::-1])


def test_personal_data_of_any_length(spark):
    private = [
        "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "IT60 X054 2811 1010 0000 0123 456", "NL91ABNA0417164300", "NO93 8601 1117 947", "QA58 DOHA 0000 1234 5678 90AB CDEF G",
        f"{'x' * 70}@mail.example.com", "378282246310005", "3782 822463 10005", "30569309025904", "4222222222222", "6304000000000000000", "+49 30 901820", "+44 (0)20 7946 0958", "+33 1 42 68 53 00", "+393331234567",
    ]
    secret = "ab1" * 100
    rows = [(i, f"see {x}, or so") for i, x in enumerate(private)] + [(100, f"password={secret} end"), (101, "built 1732790400123 at 378282246310006"), (102, "NO93 8601 1117 947 OK 12"), (103, "DE89 3704 0044 0532 0130 00 IS 12")]
    out = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in enumerate(private):
        groups = [g for g in re.split(r"[ ,]+", x) if len(re.sub(r"\D", "", g)) > 3 or "@" in g]
        assert out[i].n_replaced == 1 and len(out[i].text) == len(rows[i][1]) and not any(g in out[i].text for g in groups), (x, out[i].text)
    assert out[100].n_replaced == 1 and "ab1ab1" not in out[100].text and out[100].text.startswith("password=") and out[100].text.endswith(" end")
    assert (out[101].text, out[101].n_replaced) == (rows[-3][1], 0)
    assert out[102].text.endswith(" OK 12") and out[103].text.endswith(" IS 12") and out[103].n_replaced == 1
    assert out[103].text[:-6] == out[1].text[4:-7]


def test_mixed_disguises():
    lm = np.full((27, 27, 27), -5.0)
    for w in ("idiot", "moron", "trash", "loser", "worthless", "stupid"):
        x = [0, 0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            lm[a, b, c] = -0.5
    r = toxicity.Restorer(lm)
    for seen, word in {"i d 1 o t": "idiot", "m.0.r.0.n": "moron", "1.d.1.o.t": "idiot", "t r 4 s h": "trash", "l 0 s e r": "loser", "w-o-r-t-h-l-3-s-s": "worthless"}.items():
        assert word in r.text(f"you {seen}").split(), seen
    s = toxicity.Scorer(lm, dict.fromkeys(("idiot", "moron", "trash", "loser", "worthless", "stupid"), 0.9), 0.1)
    for seen in ("i d 1 o t", "st up id", "5t up 1d", "wor-th-l3-ss", "a l 0 s e r", "5 l o s e r", "iddiot", "1ddi0t", "moronn", "l.o.s.e.r", "you are st up id ok"):
        assert s.score(f"x1 {seen}") > 0.8, seen
    for seen in ("it is an id", "we st 1 2 3", "0 1 3 4 5", "middle letter", "a + b = c", ""):
        assert s.score(seen) == 0.1, seen


def test_similar_pairs_behind_an_unrelated_head(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "fingerprints", lambda d: d.select("_rid", F.lit(bytes(512)).alias("signature")))  # one bucket
    words = [[f"{k}w{i}" for i in range(60)] for k in range(3)]
    rows = [(0, "a head of its own kind"), (1, " ".join(words[0])), (2, " ".join(words[0] + ["x"])), (3, " ".join(words[1])), (4, " ".join(words[2])), (5, " ".join(["y"] + words[1]))]
    got = fingerprint.similar_pairs(spark.createDataFrame(rows, "_rid long, text string"), bands=2).collect()
    assert sorted((r.left, r.right) for r in got) == [(1, 2), (3, 5)] and all(r.jaccard >= 0.8 for r in got)


def test_families_are_distinct_and_coreferent(spark, monkeypatch):
    monkeypatch.setattr(pii, "SYLLABLES", {True: ["ba", "do"], False: ["ба", "до"]})  # sixteen families at first
    monkeypatch.setattr(pii, "NAMES", {k: v[:2] for k, v in pii.NAMES.items()})
    family = lambda i: "Q" + "".join("aeiou"[i // 5**k % 5] for k in range(3))
    first = ("Zed", "Yan", "Xio", "Wim", "Vic")
    rows = [(i, f"Mr. {family(i)}, Mrs. {first[i % 5]} {family(i)} and Mr. {first[i // 5 % 5]} {family(i)}; г-н Я{'аеиоу'[i % 5]}к") for i in range(60)]
    out = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parts = {i: re.fullmatch(r"Mr\. (\S+), Mrs\. (\S+) (\S+) and Mr\. (\S+) (\S+); г-н (\S+)", t) for i, t in out.items()}
    assert all(m and m[1] == m[3] == m[5] for m in parts.values())
    assert len({m[1] for m in parts.values()}) == 60 and len({m[6] for m in parts.values()}) == 5
    assert len({(i % 5, m[2]) for i, m in parts.items()}) == 5 == len({m[2] for m in parts.values()})
    assert len({m[4] for m in parts.values()}) == 5


def test_letters_of_any_script():
    assert langid.words_in("½ x²y Ⅷ 12 Straße_ÉTÉ") == ["x", "y", "straße", "été"] and langid.words_in("½ Ⅷ ²") == []
    assert langid.WordModel([("en", 0, "x", 3)]).predict("½ ² Ⅷ") == ("und", 0.0)
    table = toxicity.class_table()
    assert all(table[ord(c)] == toxicity.letter_class(c) for c in "aZéßÅñжЖ漢1½ _\n")
    assert toxicity.letter_class("É") == 5 and toxicity.letter_class("ж") == toxicity.letter_class("Ж") > 26 and toxicity.letter_class("½") == 0


def test_language_model_keeps_whole_ties(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOP_WORDS", 3)
    rows = [(i, "alpha alpha beta beta gamma gamma delta delta rare " + "omega " * 40_000, "en") for i in (1, 2, 3, 4, 5)]
    kept = {item for _, kind, item, _ in langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")) if kind == 0}
    assert kept == {"alpha", "beta", "gamma", "delta", "omega"}


def test_signatures_by_hand(texts, docs):
    own = {d: t or "" for d, t in texts[:40]}
    sign = lambda t: fingerprint.signatures(pa.array([t], pa.string()))[0]
    for t in own.values():
        hashes, _ = fingerprint.shingle_hashes(pa.array([t], pa.string()))
        want = [min(((int(h) * int(a) + int(b)) % 2**64 for h in hashes), default=2**64 - 1) >> 32 for a, b in zip(fingerprint.FACTORS, fingerprint.OFFSETS, strict=True)]
        assert sign(t).tolist() == want
        assert len(set(hashes.tolist())) == len({tuple(w) for w in _shingles(t)})
    rows = {r.doc_id: r for r in fingerprint.edited_likeness(docs).collect()}
    after = dict(zip([d for d, _ in texts], [*texts[1:], texts[0]], strict=True))
    by_text: dict = {}
    for d, t in own.items():
        u = after[d][1] or ""
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        r = rows[d]
        assert r.fingerprint == sign(t).astype("<u4").tobytes().hex() == by_text.setdefault(t, r.fingerprint)
        assert r.edited_fingerprint == sign(edited).astype("<u4").tobytes().hex()
        assert r.near_edited == np.mean(sign(t) == sign(edited)) and r.near_next == np.mean(sign(t) == sign(u))


def _shingles(t):
    w = [x for x in re.split(r"[ \t-\r]+", t or "") if x]
    return [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []


def test_near_copies_recall(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = {d: {tuple(w) for w in _shingles(t)} for d, t in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in fingerprint.near_copies(docs).collect()}
    assert links and np.mean([got[a] == got[b] for a, b in links]) >= 0.9
    label = {d: d for d in sets}
    for _ in range(4):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert all(label[d] == label[c] for d, c in got.items())  # no link that isn't one
    rows = [(r.doc_id, r.component_id, r.n_links) for r in fingerprint.near_copies(edge).collect()]
    assert len(rows) == 9 and (5, 4, 1) in rows and (2, 2, 0) in rows and (3, 3, 0) in rows and rows.count((1, 1, 1)) == 2
    assert fingerprint.near_copies(edge.limit(0)).count() == 0


def test_blocks_of_signatures(spark, monkeypatch):
    """Groups of several blocks, one with the same members as another, against all pairs; far signatures don't meet."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, (3, fingerprint.PERMUTATIONS), dtype=np.uint32)
    sign = {i: np.where(rng.random(fingerprint.PERMUTATIONS) < 0.2, rng.integers(0, 1 << 32, fingerprint.PERMUTATIONS, dtype=np.uint32), base[i % 3]) for i in range(30)}
    label = {i: i // 2 for i in sign}
    members = [(1, i, label[i]) for i in sign] + [(2, i, label[i]) for i in sign] + [(3, i, label[i]) for i in (0, 1)] + [(4, i, label[i]) for i in (0, 3, 6)]
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 7)
    prints = spark.createDataFrame([(i, x.tobytes()) for i, x in sign.items()], "_rid long, signature binary")
    got = fingerprint._across(spark.createDataFrame(members, "key long, _rid long, label long"), prints, 75)
    want = {(a, b) for a, b in itertools.combinations(sign, 2) if label[a] != label[b] and (sign[a] == sign[b]).sum() >= 75}
    assert {(0, 3), (1, 4)} <= want and not any((a - b) % 3 for a, b in want)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert fingerprint.least_equal(0.8) == 75 and fingerprint.least_equal(1.0) == 128


def test_large_branches(spark, docs, edge, monkeypatch):
    want = sorted(map(tuple, jaccard.jaccard_classes(docs).collect()))
    for k, v in {"BROADCAST_KEYS": -1, "GROUP_ROWS": 3}.items():
        monkeypatch.setattr(jaccard, k, v)
    assert sorted(map(tuple, jaccard.jaccard_classes(docs).collect())) == want
    plain = sorted(map(repr, quality.host_quality(edge).collect()))
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", -1)
    assert sorted(map(repr, quality.host_quality(edge).collect())) == plain


def test_windows_of_hot_anchors_meet_by_themselves(texts, monkeypatch):
    def removed(kind, decide):
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts], pa.int64()), pa.array([t for _, t in texts], pa.string())], names=["_rid", "text"])
        none = np.zeros(0, np.uint64)
        sent = sorted((r for b in repeats._anchors(kind, 8, none)(iter([batch])) for r in b.to_pylist()), key=lambda r: r["bucket"])
        keys: dict = {}
        for b in repeats._repeated(iter([pa.RecordBatch.from_pylist(sent)])):
            for r in b.to_pylist():
                keys.setdefault(r["_rid"], []).append(r["key"])
        cut = batch.append_column("keys", pa.array([keys.get(d) for d, _ in texts], pa.list_(pa.int64())))
        sent = sorted((r for b in repeats._snippets(kind, 8, none)(iter([cut])) for r in b.to_pylist()), key=lambda r: r["bucket"])
        out: dict = {}
        for b in repeats._decided(decide)(iter([pa.RecordBatch.from_pylist(sent)])):
            for r in b.to_pylist():
                out.setdefault(r["_rid"], set()).update(range(r["start"], r["stop"]))
        return out

    kinds = [(repeats.Kind(True, 20, 8, True), substring_dedup.ByAutomaton(20)), (repeats.Kind(False, 50, 20, False), suffix_dedup.ByRadix(50))]
    want = [removed(*k) for k in kinds]
    monkeypatch.setattr(repeats, "HOT_DOCS", 1)
    assert [removed(*k) for k in kinds] == want and all(want)


def test_mixing_near_each_target(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(0.005 * own[0].target, max(r.size for r in own) / 2), source


def test_words_of_one_text_with_many_copies_tell_nothing():
    copies = [["idiot", "lamp"]] * 40
    others = [["idiot"]] * 40
    sign = lambda x: toxicity.word_signature(set(x)).tobytes()
    bad = [(f, sign([f"same{k}" for k in range(50)] + [f"new{i}"])) for i, f in enumerate(copies)]
    bad += [(f, sign([f"own{i}x{k}" for k in range(50)])) for i, f in enumerate(others)]
    assert toxicity.spread(bad, {"idiot": 0, "lamp": 0}, 0.1) == {"idiot"}
    assert toxicity.spread([], {}, 0.1) == set()


def test_settled_snippets_of_a_copy_are_one_row():
    import numpy as np

    from logsift.llm.repeats import META, _joined

    meta = np.array([(9, 1, 0, 4, 0), (8, 1, 4, 3, 0), (7, 1, 7, 2, 60), (6, 1, 9, 5, 0), (5, 1, 15, 1, 0), (4, 2, 16, 1, 0), (3, 2, 17, 2, 0)], META)
    out, bodies = _joined(meta, [b"", b"", b"x", b"", b"", b"", b""])
    assert [tuple(r)[1:] for r in out.tolist()] == [(1, 0, 7, 0), (1, 7, 2, 60), (1, 9, 5, 0), (1, 15, 1, 0), (2, 16, 3, 0)] and bodies == [b"", b"x", b"", b"", b""]
    assert len(_joined(meta[:0], [])[0]) == 0
