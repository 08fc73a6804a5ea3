"""Benchmark decontamination as a prefix-filtered set join, with built-in functions only.

An item's windows (``window`` consecutive words; a shorter item is one window) are sets of
word shingles. A window lies in a document only if each of its shingles does, so one
shingle is a sufficient prefix; the rarest one is taken, with rarity counted over all
documents. Shingles of documents that occur in no item are dropped while they are
generated; a position is its number and a hash, whichever way the join goes. Prefix matches
give a start position; starts outside the document are dropped (length and positional
bound). The texts with a start are read again and their words there compared with the
window's.

Edge cases: a null or empty text has no words; an item without words has no windows;
a null item id marks words but is not listed; repeated rows are judged alike; empty tables
give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import fitting_broadcast, staged, text_key, text_or_empty, without_rows

WINDOW = 10
SHINGLE = 3
KEY_PARTS = 1 << 20            # numbers that name documents with a possible window
ROWS = 4096                    # numbers that stand for a shingle's hash in a document's own row
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: the word pattern, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(F.translate(text_or_empty(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _shingle(k: Column, at: Column) -> Column:
    """Hash of the k (1 to SHINGLE) words of column ``w`` from 0-based position ``at``."""
    return F.xxhash64(k, *[F.when(k > j, F.get("w", at + j)) for j in range(SHINGLE)])


def _key() -> list[Column]:
    """Rows with one id and one text are judged once; a hash stands for the text."""
    return [F.col("doc_id"), text_key()]


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, w) windows."""
    items = benchmark.select("item_id", words().alias("w")).withColumn("n", F.size("w")).where("n > 0")
    last = F.greatest(F.col("n") - window, F.lit(0))
    return (items.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
            .select("item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("w")).distinct())


def _positions(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle position of ``w``: k, at, shingle beside the other columns."""
    df = df.where(F.size("w") > 0).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("at"))
    df = (df.select("*", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k")) if len(sizes) > 1
          else df.withColumn("k", F.lit(sizes[0])))
    return df.where(F.col("at") + F.col("k") <= F.size("w")).withColumn(
        "shingle", _shingle(F.col("k"), F.col("at")))


def _document_positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, tk, n_words, at, shingle of every position, and one row at -1 per document
    whose shingle is below ROWS; the words themselves go no further."""
    df = docs.select(*_key(), words().alias("w"))
    df = df.select("*", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    if len(sizes) > 1:
        df = df.select("*", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k")).where("at >= 0 OR k = %d" % sizes[0])
    else:
        df = df.withColumn("k", F.lit(sizes[0]))
    shingle = F.when(F.col("at") < 0, F.pmod("tk", F.lit(ROWS))).otherwise(_shingle(F.col("k"), F.col("at")))
    return (df.where((F.col("at") < 0) | (F.col("at") + F.col("k") <= F.size("w")))
            .select("doc_id", "tk", F.size("w").alias("n_words"), "at", shingle.alias("shingle")))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, items): rows are doc_id, tk, n_words of every document; hits are doc_id,
    tk, start, n, wid of verified window occurrences; items map wid to the item ids that
    have the window."""
    wins = windows(benchmark, window).withColumn("wid", F.md5(F.array_join("w", " ").cast("binary")))
    wins = staged(wins, "windows")
    texts = wins.select("wid", "w").distinct()
    sizes = sorted(r[0] for r in texts.select(F.least(F.size("w"), F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    own = staged(_positions(texts, sizes).where(F.col("k") == F.least(F.size("w"), F.lit(SHINGLE))), "shingles")
    own_rows = docs.sparkSession.range(ROWS).select(F.col("id").alias("shingle"))
    vocabulary = own.select("shingle").union(own_rows).distinct()
    n_own = own.count()

    # One pass over the documents: positions of shingles that some item has, and the rows.
    seen = staged(_document_positions(docs, sizes).join(fitting_broadcast(vocabulary, n_own + ROWS, 40), "shingle"), "seen")
    rows = seen.where("at < 0").select("doc_id", "tk", F.col("n_words").cast("long").alias("n_words"))
    seen = seen.where("at >= 0")

    # Rarity over all documents; a window with a shingle that occurs nowhere cannot occur.
    counted = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = own.join(counted, "shingle", "left")
    prefix = (ranked.groupBy("wid", "w")
              .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "at")).alias("p"))
              .where("p.df > 0")
              .select("wid", "w", F.col("p.shingle").alias("shingle"), F.col("p.at").alias("offset")))
    begin = F.col("at") - F.col("offset")
    starts = (seen.join(fitting_broadcast(prefix, n_own, 400), "shingle")
              .where((begin >= 0) & (begin + F.size("w") <= F.col("n_words")))
              .groupBy(F.col("doc_id").alias("c_id"), F.col("tk").alias("c_tk"))
              .agg(F.collect_set(F.struct(begin.alias("start"), "wid", "w")).alias("starts")))
    starts = staged(starts, "starts")

    # The words of the few documents with a start are taken again and compared there; a
    # set of KEY_PARTS numbers at most keeps nearly all other texts out of the join. A
    # document's starts come as one list, so its words are not repeated by start.
    part = F.pmod("tk", F.lit(KEY_PARTS))
    parts = F.broadcast(starts.select(F.pmod("c_tk", F.lit(KEY_PARTS)).alias("part")).distinct())
    read = docs.select(*_key(), text_or_empty().alias("text")).join(parts, part == F.col("part"), "left_semi")
    read = read.join(starts, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tk") == F.col("c_tk")))
    real = F.filter("starts", lambda c: F.slice("w_all", c["start"] + 1, F.size(c["w"])) == c["w"])
    hits = (read.select("doc_id", "tk", words("text").alias("w_all"), "starts")
            .select("doc_id", "tk", F.explode(real).alias("c"))
            .select("doc_id", "tk", "c.start", F.size("c.w").alias("n"), "c.wid"))
    return rows, hits, wins.select("wid", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tk, n_words, n_hit, item_ids (sorted strings) for every row of ``docs``.

    ``tk`` is a hash of the text, so that rows which share an id are told apart.
    """
    base, hits, items = find_windows(docs, benchmark, window)
    none = F.array().cast("array<string>")
    # item_id is null-free in the list; the covered words are a union of intervals
    hits = staged(hits.distinct(), "hits")
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "n"))), state,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["start"] + x["n"]).alias("end"),
            (s["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(s["end"], x["start"])))
            .alias("hit")), lambda s: s["hit"])
    spans = hits.groupBy("doc_id", "tk").agg(covered.cast("long").alias("n_hit"))
    named = (hits.select("doc_id", "tk", "wid").distinct().join(items, "wid")
             .groupBy("doc_id", "tk")
             .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")))
    found = spans.join(named, on=[spans["doc_id"].eqNullSafe(named["doc_id"]), spans["tk"] == named["tk"]],
                       how="left").select(spans["doc_id"].alias("h_id"), spans["tk"].alias("h_tk"),
                                          "n_hit", "item_ids")
    return (base.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tk") == F.col("h_tk")), "left")
            .select("doc_id", "tk", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("item_ids", none).alias("item_ids")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which an item's window occurs."""
    return without_rows(docs, decontaminate(docs, benchmark, window).where("n_hit > 0"))
