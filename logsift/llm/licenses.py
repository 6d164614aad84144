"""License scan: short notices are found in whole texts though a few characters differ. A notice with k edits allowed is
split into k + 1 pieces, one of which must stand exactly (pigeonhole); an automaton finds the pieces, and bounded-error
matching of the regex library checks the window around each and gives the span and its edits."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Phrases that label a text wherever their words stand in a row.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Notices searched with edits, as lower-case words with one blank between, and the label of each.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("cc", "licensed under cc by"),
    ("cc", "creative commons attribution"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
]
#: A notice may differ by one edit for each so many of its characters.
CHARS_PER_EDIT = 10
#: Window results that a task keeps.
CACHE = 50_000
#: Bytes of words: digits, letters and all of other scripts; A-Z become a-z, all else a blank.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label string, notice string, first_word long, last_word long, edits long>>"
)
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN)),
])


def plain(text: str | None) -> bytes:
    """The words of a text with one blank before, between and after them."""
    return b" %s " % b" ".join((text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split())


def seeds(notice: str, k: int) -> list[tuple[str, int]]:
    """k + 1 pieces of a notice and where each starts: k edits leave one of them whole."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Scanner:
    def __init__(self, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], chars_per_edit: int):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices, self.rules, self.cache = notices, [], {}
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, notice) in enumerate(notices):
            k = len(notice) // chars_per_edit
            pattern = regex.compile(rf"(?<= )(?:{regex.escape(notice)}){{e<={k}}}(?= )", regex.BESTMATCH)
            self.rules.append((len(notice.encode()), k, pattern))
            for piece, at in seeds(notice, k):
                # pieces are searched as bytes, a character each
                found.setdefault(piece.encode().decode("latin-1"), []).append((i, len(notice[:at].encode())))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def places(self, words: bytes) -> tuple[list[int], set[str]]:
        """Byte of each place of a phrase, and the labels found."""
        at, labels = [], set()
        for phrase, label in self.phrases:
            i = words.find(phrase)
            if i >= 0:
                labels.add(label)
            while i >= 0:
                at.append(i)
                i = words.find(phrase, i + 1)
        return at, labels

    def window(self, i: int, part: bytes) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match of notice i within a window, in bytes of it."""
        if (i, part) not in self.cache:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            head = part.decode("utf-8", "ignore")
            # a character cut by the window's edge is dropped: those at the front shift all later bytes
            shift = len(part) - len(part.lstrip(bytes(range(128, 192)))) if part[:1] >= b"\x80" else 0
            m = self.rules[i][2].search(head)
            self.cache[i, part] = m and (shift + len(head[: m.start()].encode()), shift + len(head[: m.end()].encode()), sum(m.fuzzy_counts))
        return self.cache[i, part]

    def matches(self, words: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of all matches; of matches of one notice that overlap, the one with the fewest edits, then the first."""
        found: dict[tuple[int, int, int], int] = {}
        for end, (size, where) in self.automaton.iter(words.decode("latin-1")):
            for i, at in where:
                length, k, _ = self.rules[i]
                begin = end + 1 - size - at
                low = max(0, begin - 4 * k - 1)
                if m := self.window(i, words[low : begin + length + 4 * k + 1]):
                    found[i, low + m[0], low + m[1]] = m[2]
        out: list[tuple[int, int, int, int]] = []
        taken: dict[int, tuple[list[int], list[int]]] = {}
        for (i, a, b), edits in sorted(found.items(), key=lambda x: (x[0][0], x[1], x[0][1], x[0][2])):
            starts, stops = taken.setdefault(i, ([], []))
            k = int(np.searchsorted(starts, b))  # accepted spans are apart, so only the last one that starts before b can overlap
            if k and stops[k - 1] > a:
                continue
            starts.insert(k, a)
            stops.insert(k, b)
            out.append((i, a, b, edits))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def scan(self, text: str | None) -> tuple:
        words = plain(text)
        at, base = self.places(words)
        hits = self.matches(words)
        spans, labels, score = [], set(base), 1.0 if at else 0.0
        blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) if at or hits else None
        for i, a, b, edits in hits:
            label, notice = self.notices[i]
            labels.add(label)
            score = max(score, 1 - edits / len(notice))
            first, last = (int(x) - 1 for x in np.searchsorted(blanks, (a, b)))
            spans.append({"label": label, "notice": notice, "first_word": first, "last_word": last, "edits": edits})
        ends = [int(np.searchsorted(blanks, x)) for x in (min(at), max(at))] if at else [None, None]
        n_words = max(0, words.count(b" ") - 1) if len(words) > 2 else 0
        return n_words, len(at), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Labels and places of license phrases and notices, one row for each row of docs (doc_id, text).

    n_base counts all places where a phrase's words stand in a row, first_word and last_word are the smallest and largest
    word they start at (null: none). A notice is found where whole words differ from it by at most one edit (a character
    put in, left out or changed) for each chars_per_edit of its characters; spans has each such place, by first and last
    word, with its edits. score: 1 with a phrase, else 1 less the least share of edits of a notice found, else 0.
    Null and empty texts have no words, so no labels (empty strings) and score 0. Very long texts are scanned whole.
    Rows that repeat a doc_id are scanned each on its own; a null doc_id stays null. No rows: no rows.
    """
    if any(n != " ".join(n.translate({i: b for i, b in enumerate(PLAIN[:128])}).split()) or not n for _, n in notices):
        raise ValueError("notices are lower-case words with one blank between")
    small_batches(docs.sparkSession)
    notices = list(notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(PHRASES, notices, chars_per_edit)
        for batch in batches:
            rows = [scanner.scan(x) for x in batch.column("_text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(ARROW)[1:], strict=True))], schema=ARROW)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("_text")).mapInArrow(run, SCHEMA)


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _sql() -> str:
    """Runs of words that hold a piece and whose length is within the edits of a notice's, by the engine's own edit distance."""
    rows = ", ".join(f"('{label}', '{n}', {len(n) // CHARS_PER_EDIT}, {[x for x, _ in seeds(n, len(n) // CHARS_PER_EDIT)]})" for label, n in NOTICES)
    longest = max(len(n) + len(n) // CHARS_PER_EDIT for _, n in NOTICES)
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    return rf"""
WITH notices(label, notice, k, pieces) AS (VALUES {rows}), phrases(phrase, label, n) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT r, i - 1 AS i, unnest([array_to_string(ws[i:i+1], ' '), array_to_string(ws[i:i+2], ' ')]) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM (SELECT DISTINCT r, i, g FROM p) JOIN phrases ON g = phrase GROUP BY r),
-- one character for each of other scripts, so that bytes are characters; no word has none, so {longest} words are enough
v AS (SELECT r, list_transform(ws, lambda w: regexp_replace(w, '[^\x00-\x7F]', '~', 'g')) AS ws FROM d),
x AS (SELECT r, left(array_to_string(ws[i:i+{longest // 2}], ' '), {longest + 1}) || ' ' AS s FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM v)),
e AS (SELECT r, label, notice, k, s FROM x, notices WHERE len(list_filter(pieces, lambda y: contains(s, y))) > 0),
c AS (SELECT r, label, notice, k, left(s, j) AS s FROM (SELECT *, unnest(range(length(notice) - k, length(notice) + k + 1)) AS j FROM e) WHERE length(s) > j AND substr(s, j + 1, 1) = ' '),
f AS (SELECT r, label, min(levenshtein(s, notice) / length(notice)) AS far FROM c WHERE levenshtein(s, notice) <= k GROUP BY r, label),
m AS (SELECT r, list(DISTINCT label) AS labels, 1 - min(far) AS near FROM f GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(near, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""


SQL = _sql()
