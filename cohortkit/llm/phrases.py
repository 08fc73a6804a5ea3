"""Phrase collocation mining over a prefix-free parse.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and the pieces into words
at spaces and tabs. A word's end is a trigger where the hash of the eight bytes before it has
five given bits of zero, so the same passage is cut alike wherever it stands. A chunk runs
from one trigger to ``max_words - 1`` words past the next: neighbours share these words, and a
phrase is counted in the chunk that holds its first word outside the shared end, hence once.
Texts of one language in a batch are parsed as one, a piece ending between them.

The dictionary holds each distinct chunk with its frequency in the parse, and phrases are
counted inside distinct chunks, weighted. It is done by length: a phrase of k words can reach
``least`` only if both phrases of k - 1 words in it do, and a bit set of those (a fixed size,
``2 ** FILTER_BITS`` bits, whatever the corpus; collisions only let more through) thins the
occurrences before they are shuffled. Sums by phrase are exact.

A phrase's score is that of its lowest-scoring cut, ``floor(scale * a * a / (l * r))`` in
decimals of 38 digits; phrases that a longer one covers are left out.

Defined cases: a null text is empty, a null language ``und``; repeated rows count again; a
text of any length is parsed whole; an empty table gives an empty one; ties of cuts go to the
shortest first part. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortkit.llm.common import fitting_broadcast, ship_by_value, staged, text_or_empty

ship_by_value(__name__)
SCALE = 1_000_000
WINDOW, TRIGGER_BITS = 8, 5     # bytes a trigger looks at; one word in 2 ** 5 ends a chunk
FILTER_BITS = 26               # 8 MB
BLOCK_BITS = 16                # of the bit set, in one row
RANK_PARTS = 4
FLUSH_BYTES = 12 << 20         # chunk text counted together in a task
ODD = 0x9E3779B97F4A7C15
CHUNK = pa.schema([("lang", pa.string()), ("chunk", pa.binary()), ("open", pa.bool_()), ("words", pa.int64())])
COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


# ---------------------------------------------------------------- parsing
def _table() -> bytes:
    out = bytearray(range(256))
    out[65:91] = bytes(range(97, 123))
    out[9] = 32
    for c in b".,;:!?\n\x0b\x0c\r":
        out[c] = 10
    return bytes(out)


def normal(text: bytes) -> bytes:
    """Words of one piece joined by a space each, pieces by a line end each."""
    import re
    out = re.sub(rb" {2,}", b" ", text.translate(_table()))
    return re.sub(rb" ?\n[ \n]*", b"\n", out).strip(b" \n")


def parse(text: bytes, overlap: int) -> tuple[list[bytes], list[int]]:
    """Chunks of a normal text and the words each holds before the shared end (all of the
    last chunk's are its own)."""
    if not text:
        return [], []
    raw = np.frombuffer(text, dtype=np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10))
    at = ends[ends >= WINDOW]
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(1, WINDOW + 1):
        h = (h + raw[at - j]) * np.uint64(ODD)
    hit = np.flatnonzero(h >> np.uint64(64 - TRIGGER_BITS) == 0) + (len(ends) - len(at)) + 1
    total = len(ends) + 1
    cuts = np.append(0, hit[hit + overlap <= total])
    start = np.append(0, ends + 1)[cuts]
    stop = np.append(np.append(ends, len(text))[cuts[1:] + overlap - 1], len(text))
    return [text[s:e] for s, e in zip(start.tolist(), stop.tolist())], np.diff(np.append(cuts, total)).tolist()


def _parsed(overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                texts.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            for lang, parts in texts.items():
                chunks, words = parse(normal(b"\n".join(parts)), overlap)
                own = [True] * (len(chunks) - 1) + [False] * bool(chunks)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(chunks), pa.string()), pa.array(chunks, pa.binary()),
                                                  pa.array(own, pa.bool_()), pa.array(words, pa.int64())], schema=CHUNK)
    return run


def dictionary(docs: DataFrame, overlap: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, chunk, open (ends in shared words), words (its own) and n, its frequency."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                       text_or_empty(text_col).cast("binary").alias("text")).where(F.octet_length("text") > 0)
    chunks = rows.mapInArrow(_parsed(overlap), "lang string, chunk binary, open boolean, words long")
    return chunks.groupBy("lang", "chunk", "open").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- counting
def _hashes(words: pa.Array) -> np.ndarray:
    """A number for each word, the same in every task."""
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)


def _bit(lang: np.ndarray, words: list[np.ndarray], bits: int) -> np.ndarray:
    h = lang.copy()
    for w in words:
        h = (h ^ w) * np.uint64(ODD)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _count(rows: list, k: int, overlap: int, known: np.ndarray | None) -> pa.RecordBatch:
    """Phrases of ``k`` words in the given chunks, each with the sum of its weights."""
    langs = sorted({r[0] for r in rows})
    text = b"\n".join(r[1] for r in rows)
    raw = np.frombuffer(text, dtype=np.uint8)
    gap = (raw == 32) | (raw == 10)
    ends = np.append(np.flatnonzero(gap), len(raw))
    offsets = np.append(0, ends - np.arange(len(ends))).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap].tobytes())])
    coded = words.dictionary_encode()
    ids, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    joined = np.append(raw[ends[:-1]] == 32, False)          # goes on to the next word of the piece
    own = np.array([r[3] for r in rows])
    size = own + overlap * np.array([r[2] for r in rows], dtype=np.int64)
    first = np.append(0, size.cumsum()[:-1])
    counted = np.arange(len(ends)) - np.repeat(first, size) < np.repeat(own, size)
    lang = np.repeat(np.array([langs.index(r[0]) for r in rows], dtype=np.int64), size)
    weight = np.repeat(np.array([r[4] for r in rows], dtype=np.int64), size)

    for j in range(k - 1):
        counted[:len(counted) - j] &= joined[j:]
        counted[len(counted) - j:] = False
    at = np.flatnonzero(counted)
    if k > 1 and len(at):
        number, tongue = _hashes(terms), _hashes(pa.array(langs))
        for shift in (0, 1):
            bit = _bit(tongue[lang[at]], [number[ids[at + shift + j]] for j in range(k - 1)], FILTER_BITS)
            at = at[(known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
    code = lang[at]
    for j in range(k):
        code = code * len(terms) + ids[at + j]
        if j < k - 1:
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    new = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(at) else np.zeros(0, dtype=np.int64)
    sums = np.add.reduceat(weight[at[order]], new) if len(at) else np.zeros(0, dtype=np.int64)
    where = at[order[new]]
    phrase = terms.take(pa.array(ids[where]))
    for j in range(1, k):
        phrase = pc.binary_join_element_wise(phrase, terms.take(pa.array(ids[where + j])), " ")
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(lang[where])),
                                       phrase.cast(pa.string()), pa.array(sums)], schema=COUNT)


def _counted(k: int, overlap: int, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        bits = None if known is None else np.frombuffer(known.value, dtype=np.uint8)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(row)
                size += len(row[1]) + 1
                if size >= FLUSH_BYTES:
                    yield _count(rows, k, overlap, bits)
                    rows, size = [], 0
        if rows:
            yield _count(rows, k, overlap, bits)
    return run


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tongues = b.column(0).dictionary_encode()
        tongue = _hashes(tongues.dictionary)[tongues.indices.to_numpy()]
        split = pc.split_pattern(b.column(1), " ")
        k = len(split[0]) if len(split) else 0
        flat = split.flatten().dictionary_encode()
        number = _hashes(flat.dictionary)[flat.indices.to_numpy()].reshape(-1, k) if k else np.zeros((0, 0), np.uint64)
        bit = np.unique(_bit(tongue, [number[:, j] for j in range(k)], FILTER_BITS))
        yield pa.RecordBatch.from_arrays([pa.array(bit >> BLOCK_BITS), pa.array(bit & ((1 << BLOCK_BITS) - 1))],
                                         names=["block", "bit"])


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
    out[rows["bit"].to_numpy()] = 1
    return pd.DataFrame({"block": rows["block"].head(1), "packed": [np.packbits(out, bitorder="little").tobytes()]})


def bit_set(phrases: DataFrame) -> bytes:
    """``2 ** FILTER_BITS`` bits, one set for each phrase (of one length); packed in blocks by
    the executors, so that the driver gets no more than the bit set."""
    bits = phrases.select("lang", "phrase").mapInArrow(_bits, "block long, bit long").distinct()
    out = bytearray(1 << (FILTER_BITS - 3))
    step = 1 << (BLOCK_BITS - 3)
    for r in bits.groupBy("block").applyInPandas(_packed, "block long, packed binary").toLocalIterator():
        out[r["block"] * step:(r["block"] + 1) * step] = r["packed"]
    return bytes(out)


def frequent(chunks: DataFrame, max_words: int, least: int) -> list[DataFrame]:
    """For each length lang, phrase, f of the phrases of ``least`` occurrences or more."""
    out, known = [], None
    spark = chunks.sparkSession
    for k in range(1, max_words + 1):
        if k > 1:
            known = spark.sparkContext.broadcast(bit_set(out[-1]))
        part = chunks.select("lang", "chunk", "open", "words", "n").mapInArrow(
            _counted(k, max_words - 1, known), "lang string, phrase string, n long")
        sums = part.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        out.append(staged(sums, f"phrases{k}"))
    return out


# ---------------------------------------------------------------- scores
def _joined(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def _scored(found: DataFrame, parts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score by the lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"),
                        F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined("w", F.lit(1), F.col("cut")).alias("left"),
                       _joined("w", F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right"))
    side = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rated = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    rated = rated.withColumns({"top": F.lit(SCALE).cast("decimal(38,0)") * wide("a") * wide("a"), "below": wide("l") * wide("r")})
    lowest = F.min(F.struct(F.expr("top div below").alias("score"), "cut", "l", "r")).alias("x")
    return rated.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def _covers(found: DataFrame, max_words: int) -> DataFrame:
    """lang, phrase, top: the most frequent longer phrase that holds the phrase."""
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size(w) - n + 1), lambda s: _joined(w, s, n))))
    longer = found.where(F.size(w) > 2)
    return (longer.select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("top")))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 3,
                 least: int = 10, cover_percent: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of 2 to ``max_words`` words that occurs
    ``least`` times and that no longer one with ``cover_percent`` of its occurrences holds."""
    chunks = staged(dictionary(docs, max_words - 1, lang_col, text_col), "chunks")
    counts = frequent(chunks, max_words, least)
    found, parts = counts[1], counts[0]
    for c in counts[2:]:
        found = found.unionByName(c)
    for c in counts[1:-1]:
        parts = parts.unionByName(c)
    rated = _scored(found, parts).join(_covers(found, max_words), ["lang", "phrase"], "left")
    kept = rated.where(F.col("top").isNull() | (100 * F.col("top") < cover_percent * F.col("a"))).drop("top")
    totals = staged(chunks.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n")), "totals")
    return kept.join(fitting_broadcast(totals, totals.count(), 100), "lang")


def best_phrases(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank: the first of each of
    ``RANK_PARTS`` parts of a language, then the first of these, so that the last task of a
    language reads no more than ``RANK_PARTS * top`` rows."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    inside = F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))
    first = parts.withColumn("rank", inside).where(F.col("rank") <= top).drop("part", "rank")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
