"""Phrase mining against plain counting, and the parse on its own."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import phrases as PH


def plain(rows, max_words=3, least=10, cover=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[s:s + k]) for k in range(1, max_words + 1) for s in range(len(w) - k + 1))
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = []
    for g, a in cand.items():
        lang, w = g[0], g[1:]
        if any(100 * b >= cover * a for h, b in cand.items() if len(h) > len(g) and h[0] == lang
               and any(h[1 + s:1 + s + len(w)] == w for s in range(len(h) - len(g) + 1))):
            continue
        score, cut = min((1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[(lang, *w[:cut])], f[(lang, *w[cut:])], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    return [(r[0], rank.update([r[0]]) or rank[r[0]], *r[1:]) for r in out]


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    vocab = ["the", "of", "Über", "é", "New", "york", "times", "a-b", "x\x00y", "ß", "☃", "in", "to", "1"]
    line = " ".join(rnd.choice(vocab) for _ in range(90))
    out = []
    for i in range(docs):
        words = [rnd.choice(vocab) + rnd.choice([" "] * 9 + ["\t", "  ", ". ", ",", "\n", " ;\r\n "]) for _ in range(rnd.randint(0, 150))]
        out.append((rnd.choice(["en", "en", "de", None]), "".join(words) + (line if i % 4 == 0 else "")))
    return out + [("en", None), ("en", ""), (None, " . , "), ("fr", "only once"), ("de", " " * 50_000 + "." * 50_000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, t, 5, "n") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, lang string, text string, n int, phrase string")


@pytest.mark.parametrize("max_words,cover,flush", [(3, 50, 1 << 23), (2, 50, 1 << 23), (4, 80, 3000)])
def test_equals_plain_counting(spark, monkeypatch, max_words, cover, flush):
    monkeypatch.setattr(PH, "FLUSH_BYTES", flush)
    rows = corpus(max_words)
    found = PH.collocations(frame(spark, rows), max_words=max_words, cover_percent=cover)
    got = PH.best_phrases(found, 10_000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = plain(rows, max_words, cover=cover)
    assert len(want) > 50 and sorted(map(tuple, got)) == sorted(want)


def test_rank_limit_and_ties(spark):
    rows = [("en", "b a. d c. f e")] * 12
    found = PH.best_phrases(PH.collocations(frame(spark, rows)), 2).orderBy("rank").collect()
    assert [(r["rank"], r["phrase"], r["score"]) for r in found] == [(1, "b a", 1000000), (2, "d c", 1000000)]


def test_scores_past_64_bits(spark):
    big = 9_000_000_000
    parts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7)], "lang string, phrase string, f long")
    got = PH._scored(spark.createDataFrame([("en", "a b", big - 5)], "lang string, phrase string, f long"), parts).first()
    assert got["score"] == 1000000 * (big - 5) ** 2 // (big * (big + 7))


def test_empty_table(spark):
    assert PH.collocations(frame(spark, [])).count() == 0


def test_parse_covers_each_word_once_and_cuts_alike():
    rnd = random.Random(1)
    words = [f"w{rnd.randint(0, 400)}" for _ in range(20_000)]
    text = " ".join(words).encode()
    for overlap in (1, 2, 3):
        chunks, own = PH.parse(text, overlap)
        assert sum(own) == len(words) and len(chunks) > 200
        again = [w for c, k in zip(chunks, own) for w in c.split()[:k]]
        assert again == [w.encode() for w in words]
        for a, b, k in zip(chunks, chunks[1:], own):
            assert a.split()[k:] == b.split()[:overlap]
    other, _ = PH.parse(b"some other words first " + text, 2)
    assert len(set(other) & set(PH.parse(text, 2)[0])) >= len(other) - 3


def test_normal_text():
    assert PH.normal("  A\tB  c .. DÉ ;\r\n e!".encode()) == "a b c\ndÉ\ne".encode()


def test_lost_occurrences_never(spark, monkeypatch):
    """A full bit set lets everything through; the counts stay."""
    rows = corpus(9)
    want = {tuple(r) for r in PH.collocations(frame(spark, rows)).collect()}
    monkeypatch.setattr(PH, "bit_set", lambda phrases: b"\xff" * (1 << (PH.FILTER_BITS - 3)))
    assert {tuple(r) for r in PH.collocations(frame(spark, rows)).collect()} == want


def test_dictionary_counts_repeats(spark):
    rows = [("en", " ".join(f"z{i}" for i in range(3000)))] * 5
    got = PH.dictionary(frame(spark, rows).repartition(5), 2).agg(F.sum(F.col("words") * F.col("n"))).first()[0]
    assert got == 15_000
