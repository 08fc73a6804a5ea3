"""Language identification of mixed-language text.

A model holds, for each learned language, log probabilities of hashed letter trigrams and
the scripts it is written in. Reading a text, the script of a word narrows the candidate
languages; each word gets one score per candidate (sum over its trigrams); Viterbi with a
switching penalty labels the words, and runs of one label are the spans. A document's
language is the label with the most letters, its score that label's share of the letters.

Learning sums trigram counts over all training rows (map-side in each task, then one
aggregate); the model has a fixed size per language (``BUCKETS`` numbers), so it may be
broadcast. Prediction is one map over the rows: no shuffle, no state.

Edge cases: null or letterless texts are ``und`` with score 0 and no spans; ties go to the
first label in code-point order; rows without a label teach nothing; without any training
row everything is ``und``; repeated rows and extra columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import small_batches

UND = "und"
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
SMOOTHING = 0.1
SCRIPT_SHARE = 0.01            # a language uses a script that has this share of its letters
CHUNK_CELLS = 4 << 20         # characters times languages held at once
LANGS_AT_ONCE = 64
BLOCK = 128
ROWS_AT_ONCE = 1000            # rows of a batch that are Python strings at a time

# Code-point ranges of scripts.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("arabic", 0xFB50, 0xFDFF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x3FFFF),
)
SCRIPTS = (*dict.fromkeys(name for name, _, _ in SCRIPT_RANGES), "other")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: script number + 1 (0: no letter) and its single-character lower case."""
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
    letter = np.fromiter(map(str.isalpha, chars), bool, len(chars))
    script = np.where(letter, len(SCRIPTS), 0).astype(np.uint8)
    for name, first, last in SCRIPT_RANGES:
        part = slice(first, last + 1)
        script[part] = np.where(letter[part], SCRIPTS.index(name) + 1, 0)
    lower = np.arange(len(chars), dtype=np.uint32)
    for c in np.flatnonzero(letter):
        low = chars[c].lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return script, lower


@dataclass
class Words:
    """Words of a chunk of texts: trigram buckets of all letters, where each word's
    letters begin among them, and each word's place in its text."""
    buckets: np.ndarray        # per letter
    scripts: np.ndarray        # per letter, number + 1
    first: np.ndarray          # per word: index of its first letter
    text: np.ndarray           # per word: number of its text
    start: np.ndarray          # per word: code-point offsets in its text
    end: np.ndarray

    @property
    def letters(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.buckets)))


def find_words(texts: list[str]) -> Words:
    script_of, lower_of = _tables()
    code = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1] if texts else np.zeros(0, np.int64)
    script = script_of[code]
    letter = script > 0
    low = np.where(letter, lower_of[code], 0)
    at = np.flatnonzero(letter)
    h = low[at - 1] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + low[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    is_first = ~letter[at - 1]
    first = np.flatnonzero(is_first)
    last = at[np.append(first[1:] - 1, len(at) - 1)] if len(first) else first
    text = np.searchsorted(begins, at[first], side="right") - 1
    return Words((h >> np.uint32(16)).astype(np.int32) % BUCKETS, script[at], first, text,
                 at[first] - begins[text], last + 1 - begins[text])


# ---------------------------------------------------------------- learning
def learn_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows with a label; buckets from BUCKETS on count scripts."""
    width = BUCKETS + len(SCRIPTS)
    small_batches(df.sparkSession)

    def flush(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n[b])],
                ["lang", "bucket", "n"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for part in _parts(texts, CHUNK_CELLS // 4):
                for lang in sorted(set(langs[part])):
                    words = find_words([texts[i] for i in part if langs[i] == lang])
                    n = counts.setdefault(lang, np.zeros(width, np.int64))
                    n[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(words.scripts - 1, minlength=len(SCRIPTS))
                if len(counts) > LANGS_AT_ONCE:
                    yield from flush(counts)
        yield from flush(counts)

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    return (rows.mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray          # (BUCKETS, languages) log probabilities
    allowed: np.ndarray        # (scripts, languages)


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    counts = learn_counts(df, text_col, lang_col).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    n[counts["bucket"].to_numpy(), np.searchsorted(langs, counts["lang"]) if langs else []] = counts["n"]
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    table = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, table, allowed)


# ---------------------------------------------------------------- labelling
def viterbi(scores: np.ndarray, fresh: np.ndarray, penalty: float, block: int = BLOCK) -> np.ndarray:
    """Best label per word; a change of label costs ``penalty`` except at ``fresh`` words
    (a text's first). Exact: blocks of words are run side by side, first for every entry
    label (which gives the value each block is entered with), then once more with
    back pointers, which are followed from the last block to the first."""
    n, k = scores.shape
    if n == 0:
        return np.zeros(0, np.int64)
    blocks = -(-n // block)
    # blocks lie along the last axis, so every step is a few long vector operations
    s = np.zeros((blocks * block, k), np.float32)
    s[:n] = scores - scores.max(axis=1, keepdims=True)   # per word, only differences matter
    s = np.ascontiguousarray(s.reshape(blocks, block, k).transpose(1, 2, 0))
    cost = np.zeros(blocks * block, np.float32)
    cost[:n] = np.where(fresh, 0, penalty)
    cost = np.ascontiguousarray(cost.reshape(blocks, block).T)

    through = np.full((k, k, blocks), -np.inf, np.float32)   # entry label, label
    through[np.arange(k), np.arange(k)] = 0
    for t in range(block):
        change = through.max(axis=1) - cost[t]
        np.maximum(through, change[:, None], out=through)
        through += s[t]
    steps = np.ascontiguousarray(through.transpose(2, 0, 1))
    value = np.zeros((blocks, k), np.float32)
    for b in range(1, blocks):
        v = (value[b - 1][:, None] + steps[b - 1]).max(axis=0)
        value[b] = v - v.max()

    value = np.ascontiguousarray(value.T)
    came = np.empty((block, k, blocks), np.int16)
    own = np.arange(k, dtype=np.int16)[:, None]
    for t in range(block):
        best = value.argmax(axis=0)
        change = value.max(axis=0) - cost[t]
        came[t] = np.where(value >= change, own, best)
        np.maximum(value, change, out=value)
        value += s[t]
    end = value.argmax(axis=0)

    entry = np.repeat(np.arange(k)[:, None], blocks, axis=1)     # end label -> entry label
    rows = np.arange(blocks)
    for t in range(block - 1, -1, -1):
        entry = came[t][entry, rows]
    state = np.empty(blocks, np.int64)
    state[-1] = end[-1]
    for b in range(blocks - 1, 0, -1):
        state[b - 1] = entry[state[b], b]
    labels = np.empty((block, blocks), np.int64)
    for t in range(block - 1, -1, -1):
        labels[t] = state
        state = came[t][state, rows]
    return labels.T.reshape(-1)[:n]


def label_words(model: Model, words: Words, penalty: float) -> np.ndarray:
    scores = np.add.reduceat(model.table[words.buckets], words.first, axis=0)
    script = words.scripts[words.first] - 1
    if not model.allowed[np.unique(script)].all():
        scores = np.where(model.allowed[script], scores, scores.min(axis=1, keepdims=True) - 1e4)
    return viterbi(scores, np.append(True, words.text[1:] != words.text[:-1]), penalty)


def label_texts(model: Model, texts: list[str], penalty: float = SWITCH_PENALTY) -> pa.StructArray:
    """Per text: lang_pred, score, spans."""
    n, k = len(texts), len(model.langs)
    words = find_words(texts)
    names = np.array([*model.langs, UND], object)
    pred, score = np.full(n, k), np.zeros(n)
    span = [np.zeros(0, np.int64)] * 4
    if k and len(words.first):
        labels = label_words(model, words, penalty)
        per = np.bincount(words.text * k + labels, weights=words.letters, minlength=n * k).reshape(n, k)
        total = per.sum(axis=1)
        some = total > 0
        pred[some] = per[some].argmax(axis=1)
        score[some] = per[some].max(axis=1) / total[some]
        change = np.append(True, (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1]))
        a = np.flatnonzero(change)
        z = np.append(a[1:], len(labels)) - 1
        span = [words.text[a], words.start[a], words.end[z], labels[a]]
    offsets = np.append(0, np.cumsum(np.bincount(span[0], minlength=n))).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(span[1].astype(np.int64)), pa.array(span[2].astype(np.int64)),
         pa.array(names[span[3]], pa.string())], ["start", "end", "lang"])
    return pa.StructArray.from_arrays(
        [pa.array(names[pred], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), spans)],
        ["lang_pred", "score", "spans"])


def _parts(texts: list[str], most: int) -> Iterator[list[int]]:
    """Runs of text numbers of about ``most`` characters."""
    part, held = [], 0
    for i, t in enumerate(texts):
        if part and held + len(t) > most:
            yield part
            part, held = [], 0
        part.append(i)
        held += len(t)
    if part:
        yield part


def predict(df: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``df`` without the text, with lang_pred, score and spans (start, end, lang)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    new = ("lang_pred", "score", "spans")
    keep = [f for f in df.schema.fields if f.name != text_col and f.name not in new]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            for part in _parts(texts, CHUNK_CELLS // max(4, len(m.langs))):
                found = label_texts(m, [texts[i] for i in part], penalty)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(part[0], len(part)).columns[:-1], *found.flatten()], [*names, *new])

    schema = T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("spans", T.ArrayType(T.StructType([
                               T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                               T.StructField("lang", T.StringType())])))])
    return df.select(*names, text_col).mapInArrow(run, schema)


def drop_unknown(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which no language is found. A row's text enters the task
    once and leaves it only if it is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column, at = batch.column(place), 0
            while at < len(column):
                texts = [t or "" for t in column.slice(at, ROWS_AT_ONCE).to_pylist()]
                for part in _parts(texts, CHUNK_CELLS // max(4, len(m.langs))):
                    found = label_texts(m, [texts[i] for i in part], SWITCH_PENALTY).field("lang_pred")
                    yield batch.slice(at + part[0], len(part)).filter(pc.not_equal(found, UND))
                at += len(texts)

    return docs.mapInArrow(run, docs.schema)
