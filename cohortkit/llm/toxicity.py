"""Toxic passages as maximum-scoring segments of token log-odds.

1. Log-odds with a Dirichlet prior: for each word and word stem, the numbers of toxic and of
   clean labelled texts that hold it are compared under a prior proportional to the number of
   all documents that do (a stem's numbers are the sums over the labelled texts' words). An
   entry's log-odds count, of either sign, where they stand ``z_least`` deviations from 0.
   A token scores the log-odds of its word, else of its longest stem that has an entry;
   a token without one scores ``-drift``.
2. Segments: all maximal-scoring segments of a text (a linear scan with linked candidates).
3. Extreme values: in clean labelled texts the segments' scores have an exponential tail;
   its rate and density give each segment's E-value at a text's length. A text's evidence
   is the sum of -ln p over its segments, and a logistic fit of the labels on it gives
   the score.

Words are counted in one pass over all documents and one over the labelled texts, by the
distinct words of a batch; a task hands on its distinct words only, and stems are made from
the summed words. The lexicon is a table of any size: its ``broadcast_words`` entries of most
documents are broadcast; where there are more, the others are joined with the words of the
texts (an entry beyond that many more frequent ones is no hot key; a bit set of fixed size
keeps other words out of the join). The logistic fit reads a histogram of fixed width.

Edge cases: null and empty texts have no segment and the base score; rows without a label
teach nothing; equal labelled texts teach once; several labels of one id count as toxic if
one is; without toxic or clean training rows the lexicon is empty; entries of equally many
documents at the broadcast bound go by the word, and the scores do not depend on where the
bound lies; segments never overlap, so that equal scores need no rule; repeated rows pass
through. Columns named n_words and segments are replaced, others pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import fitting_broadcast, ship_by_value, staged, text_or_empty

WORD = re.compile(r"[^\W\d_]+")
PRIOR_DOCS = 50.0              # weight of the prior, in documents
Z_LEAST = 3.5
BROADCAST_WORDS = 200_000      # lexicon entries that are broadcast; the others are joined
DRIFT = 0.05
LEAST_TEXTS = 3                # labelled texts of its side that an entry is in
STEMS = range(8, 3, -1)        # lengths of the stems that count as features, longest first
BITS = 1 << 23
WORDS_AT_ONCE = 500_000        # distinct words a task counts before it hands them on
LABEL_BYTES = 128 << 20        # labels that are broadcast; more are joined by a shuffle of the texts
BINS = 400                     # histogram of the evidence for the logistic fit
BIN_WIDTH = 0.05
ship_by_value(__name__)


def lowered(text: str) -> str:
    """Lower case of the same length, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return WORD.findall(lowered(text))


def features(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its stems, marked by a hyphen, from
    the most special one on."""
    return [word, *(word[:n] + "-" for n in STEMS if n < len(word))]


def coded_words(texts: list[str]) -> tuple[list[int], np.ndarray, list[str]]:
    """Number of words of each text, and all words as numbers of the distinct ones."""
    found = [words_of(t) for t in texts]
    flat = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
    return [len(ws) for ws in found], flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()


# ---------------------------------------------------------------- counting
def count_words(df: DataFrame) -> DataFrame:
    """(word, toxic, clean, docs): in how many texts a word is, by the label column
    ``toxic`` (1, 0 or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter(), Counter())   # toxic, clean, unlabelled

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(set().union(*counts))
            per = [np.fromiter((c[w] for w in names), np.int64, len(names)) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(per[0]), pa.array(per[1]), pa.array(sum(per))],
                ["word", "toxic", "clean", "docs"])
            for c in counts:
                c.clear()

        for batch in batches:
            sizes, codes, words = coded_words(batch.column(0).to_pylist())
            if not words:
                continue
            side = np.array([2 if y is None else 1 - y for y in batch.column(1).to_pylist()], np.int64)
            pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(words) + codes)
            of, word = side[pairs // len(words)], pairs % len(words)
            for k, c in enumerate(counts):
                n = np.bincount(word[of == k], minlength=len(words))
                for i in np.flatnonzero(n).tolist():
                    c[words[i]] += int(n[i])
            if sum(map(len, counts)) > WORDS_AT_ONCE:
                yield from flush()
        yield from flush()

    return (df.select(text_or_empty().alias("text"), F.col("toxic").cast("int").alias("toxic"))
            .mapInArrow(run, "word string, toxic long, clean long, docs long")
            .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")]))


def bit_set(words: DataFrame) -> np.ndarray:
    """Bits of the words, and of their first letters marked by a caret. At most BITS numbers
    reach the driver, however many words there are."""
    head = F.concat(F.lit("^"), F.substring("word", 1, STEMS[-1]))
    keys = words.select(F.explode(F.array("word", head)).alias("key"))
    at = keys.select((F.crc32(F.col("key").cast("binary")) % BITS).cast("int").alias("b")).distinct().toPandas()
    bits = np.zeros(BITS, bool)
    bits[at["b"].to_numpy()] = True
    return bits


def lexicon_table(docs: DataFrame, labelled: DataFrame, prior_docs: float = PRIOR_DOCS,
                  z_least: float = Z_LEAST) -> DataFrame | None:
    """(word, score, docs) of the whole lexicon, None without toxic or clean training rows.
    ``docs``: text of all documents; ``labelled``: text and toxic of the training rows."""
    once = (labelled.select(text_or_empty().alias("text"), "toxic")
            .groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("n"))
            .agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("text", "toxic"))
    seen = staged(count_words(once).select("word", "toxic", "clean"), "labelled_words")
    every = count_words(docs.select("text", F.lit(None).cast("int").alias("toxic"))).select("word", "docs")
    words = staged(seen.join(every, "word"), "words")
    totals = words.agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")]).first()
    n_docs = docs.count()
    if not totals["toxic"] or not totals["clean"]:
        return None
    size = F.length("word")
    own = F.array(F.col("word"), *[F.when(size > n, F.concat(F.substring("word", 1, n), F.lit("-"))) for n in STEMS])
    table = (words.select(F.explode(F.array_compact(own)).alias("word"), "toxic", "clean", "docs")
             .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")]))
    y, x, prior = F.col("toxic"), F.col("clean"), F.col("docs") * (prior_docs / n_docs)
    whole = totals["docs"] * (prior_docs / n_docs)

    def log_odds(count, total):
        return F.log((count + prior) / F.greatest(F.lit(total + whole) - count - prior, F.lit(0.5)))

    score = log_odds(y, totals["toxic"]) - log_odds(x, totals["clean"])
    z = score / F.sqrt(1 / (y + prior) + 1 / (x + prior))
    sure = ((z >= z_least) & (y >= LEAST_TEXTS)) | ((z <= -z_least) & (x >= LEAST_TEXTS))
    return staged(table.where(sure).select("word", score.alias("score"), "docs"), "lexicon")


def split_lexicon(table: DataFrame | None, broadcast_words: int = BROADCAST_WORDS) \
        -> tuple[dict[str, float], DataFrame | None]:
    """The words of most documents, to be broadcast, and the table of all others, if any."""
    if table is None:
        return {}, None
    most = table.orderBy(F.desc("docs"), "word").limit(broadcast_words).toPandas()
    scores = dict(zip(most["word"], most["score"].astype(float)))
    if len(most) < broadcast_words:
        return scores, None
    last = most.iloc[-1]
    n, word = F.lit(int(last["docs"])), F.lit(last["word"])
    rest = table.where((F.col("docs") < n) | ((F.col("docs") == n) & (F.col("word") > word)))
    return scores, None if rest.isEmpty() else rest.select("word", "score")


def fit_lexicon(docs: DataFrame, labelled: DataFrame, prior_docs: float = PRIOR_DOCS,
                z_least: float = Z_LEAST) -> dict[str, float]:
    """The whole lexicon on the driver, for tables that are known to be small."""
    table = lexicon_table(docs, labelled, prior_docs, z_least)
    return {} if table is None else {r["word"]: r["score"] for r in table.collect()}


# ---------------------------------------------------------------- segments
def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, last token, score) of a text's tokens."""
    sums = np.append(0.0, np.cumsum(scores))
    kept: list[list] = []      # first, last, sum before, sum after, link to the candidate left of it
    hits = np.flatnonzero(scores > 0)
    for token, before, after in zip(hits.tolist(), sums[hits].tolist(), sums[hits + 1].tolist()):
        item = [token, token, before, after, -1]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= item[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= item[3]:
                item[4] = j
                kept.append(item)
                break
            item[0], item[2] = kept[j][0], kept[j][2]
            left = kept[j][4]
            del kept[j:]
            j = left
    return [(a, b, r - l) for a, b, l, r, _ in kept]


def joined_scores(df: DataFrame, table: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``__more``: word and score of the entries of ``table`` (word, score) that
    are in the row's text. Texts are known by a hash: where two share one, each also gets
    entries of the other, which it has no word for."""
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(bit_set(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.unpackbits(shared.value).tobytes()

        def is_set(key: str) -> int:
            return chosen[zlib.crc32(key.encode()) % BITS]

        def wanted(word: str) -> list[str]:
            return [f for f in features(word) if is_set(f)] if is_set("^" + word[:STEMS[-1]]) else []

        def flush() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words, pa.string())],
                                             ["__text", "word"])
            keys.clear()
            words.clear()

        keys, words = [], []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set().union(*map(wanted, set(words_of(text))))
                keys += [key] * len(found)
                words += found
                if len(words) > WORDS_AT_ONCE:
                    yield from flush()
        yield from flush()

    key = F.xxhash64(text_or_empty(text_col))
    more = (df.select(key.alias("__text"), text_or_empty(text_col).alias("text"))
            .mapInArrow(run, "__text long, word string").distinct().join(table, "word")
            .groupBy("__text").agg(F.collect_list(F.struct("word", "score")).alias("__more")))
    return df.withColumn("__text", key).join(more, "__text", "left").drop("__text")


def score_segments(df: DataFrame, lexicon: dict[str, float], drift: float = DRIFT,
                   text_col: str = "text", rest: DataFrame | None = None) -> DataFrame:
    """``df`` without the text, with n_words and segments (code points start, end; score).
    ``rest``: the entries (word, score) of a lexicon that are not in ``lexicon``."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    keep = [f for f in df.schema.fields if f.name not in (text_col, "n_words", "segments")]
    names = [f.name for f in keep]
    none = F.lit(None).cast("array<struct<word:string,score:double>>")
    df = df.withColumn("__more", none) if rest is None else joined_scores(df, rest, text_col)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                     T.StructField("score", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, none, memo = shared.value, {}, {}

        def score_of(word: str, more: dict[str, float]) -> float:
            for f in features(word):
                s = scores.get(f, more.get(f))
                if s is not None:
                    return s
            return -drift

        def remembered(word: str) -> float:
            s = memo.get(word)
            if s is None:
                s = memo[word] = score_of(word, none)
            return s

        def found(text: str, tokens: np.ndarray) -> list[dict]:
            if not (tokens > 0).any():
                return []
            spans = [m.span() for m in WORD.finditer(lowered(text))]
            return [{"start": spans[a][0], "end": spans[b][1], "score": s} for a, b, s in maximal_segments(tokens)]

        for batch in batches:
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            sizes, codes, words = coded_words(texts)
            if len(memo) > WORDS_AT_ONCE:
                memo.clear()
            per_word = np.array([remembered(w) for w in words], float)
            tokens = np.split(per_word[codes] if words else np.zeros(0), np.cumsum(sizes)[:-1]) if texts else []
            for i, entries in enumerate(batch.column(len(names) + 1).to_pylist()):
                if entries:
                    more = {e["word"]: e["score"] for e in entries}
                    tokens[i] = np.array([score_of(w, more) for w in words_of(texts[i])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(sizes, pa.int64()),
                 pa.array([found(t, k) for t, k in zip(texts, tokens)], arrow)], [*names, "n_words", "segments"])

    schema = T.StructType([*keep, T.StructField("n_words", T.LongType()), T.StructField("segments", kind)])
    return df.select(*names, text_col, "__more").mapInArrow(run, schema)


# ---------------------------------------------------------------- calibration
@dataclass(frozen=True)
class Calibration:
    rate: float                # of the exponential tail of segment scores in clean texts
    density: float             # clean segments per token
    intercept: float
    slope: float


def evidence(rate: float, density: float):
    """Column: ln(1 + sum of -ln p) over a row's segments, p = 1 - exp(-E) and
    E = density * n_words * exp(-rate * score)."""
    e = lambda s: F.lit(density) * F.col("n_words") * F.exp(-F.lit(rate) * s["score"])
    p = lambda s: F.greatest(-F.expm1(-e(s)), F.lit(1e-300))                              # noqa: E731
    return F.log1p(F.aggregate("segments", F.lit(0.0), lambda a, s: a - F.log(p(s))))


def fit_logistic(x: np.ndarray, n: np.ndarray, ones: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton steps on grouped counts; the penalty keeps separable data finite."""
    w = np.zeros(2)
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (ones - n * p) - ridge * w
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + ridge * np.eye(2), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def calibrate(segments: DataFrame) -> Calibration:
    """``segments``: n_words, segments and toxic of the training rows."""
    clean = segments.where("toxic = 0").agg(
        F.sum(F.size("segments")).alias("k"), F.sum("n_words").alias("words"),
        F.sum(F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["score"])).alias("total")).first()
    k, words, total = clean["k"] or 0, clean["words"] or 0, clean["total"] or 0.0
    rate, density = (k + 1) / (total + 1.0), (k + 1) / (words + 1)
    x = evidence(rate, density)
    bins = (segments.select(F.least(F.floor(x / BIN_WIDTH), F.lit(BINS)).alias("b"), "toxic")
            .groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("ones")).toPandas())
    if not len(bins):
        return Calibration(rate, density, -3.0, 1.0)
    a, b = fit_logistic((bins["b"].to_numpy(float) + 0.5) * BIN_WIDTH, bins["n"].to_numpy(float),
                        bins["ones"].to_numpy(float))
    return Calibration(rate, density, a, max(b, 0.0))


def toxicity(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text",
             broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, n_words, segments, evidence, score of every row of ``docs``; ``labels`` has
    id and toxic (1 or 0); ``train`` is a condition on the id column."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = (labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where("toxic in (0, 1)").where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    marked = staged(marked, "marked")      # up to some five million labels the texts need no shuffle
    marked = fitting_broadcast(marked, marked.count(), 24, LABEL_BYTES)
    lexicon, rest = split_lexicon(lexicon_table(rows, rows.join(marked, "doc_id")), broadcast_words)
    found = staged(score_segments(rows, lexicon, rest=rest), "segments")
    cal = calibrate(found.join(marked, "doc_id"))
    x = evidence(cal.rate, cal.density)
    return found.select("doc_id", "n_words", "segments", x.alias("evidence"),
                        (1 / (1 + F.exp(-(cal.intercept + cal.slope * x)))).alias("score"))
