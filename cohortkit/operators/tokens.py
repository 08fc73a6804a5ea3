"""Packed multi-value columns -> long form, vocabularies and indicators.

The reference materialises one dense 0/1 column per token (15k columns, one full
table pass each). Here the canonical form is *long*: one row per (key, token) that
is present. Zeros are never stored; wide output is opt-in and capped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The two packing separators of the source data.
DRUG_SEP = " | "
COMORBIDITY_SEP = ","
SHARD_NAMES = 200_000          # names of one automaton
PAIR_ROWS = 500_000            # (key, name) rows among which one task looks for repeats


def _ship_by_value() -> None:
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


def split_packed(col: str, sep: str):
    """Literal split (``F.split`` takes a regex, so the separator is escaped)."""
    return F.split(F.col(col), re.escape(sep))


def to_long(df: DataFrame, key: str | Sequence[str], col: str, sep: str,
            out: str = "token", keep: Sequence[str] = (), unique_key: bool = False) -> DataFrame:
    """(key, packed) -> distinct (key, token). Null packed values contribute no rows;
    tokens are trimmed and empty tokens skipped. Where the caller knows that each key has
    one row (``unique_key``), repeats are removed inside the row and nothing is shuffled."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = F.array_distinct(F.transform(split_packed(col, sep), lambda x: F.trim(x)))
    long = (df.filter(F.col(col).isNotNull())
              .select(*keys, *keep, F.explode(parts).alias(out))
              .filter(F.col(out) != ""))
    return long if unique_key else long.distinct()


def vocabulary(long: DataFrame, token: str = "token", key: str = "person_id",
               approx_rsd: float | None = None) -> DataFrame:
    """G1: distinct tokens with the number of keys holding each. Exact by default (the
    distinct is planned on (token, key), so a token held by a third of all keys is
    spread over many tasks); ``approx_rsd`` switches to HyperLogLog sketches
    (``approx_count_distinct``), one small mergeable state per token and map task."""
    if approx_rsd is not None:
        return long.groupBy(token).agg(F.approx_count_distinct(key, approx_rsd).alias("n_keys"))
    return long.groupBy(token).agg(F.countDistinct(key).alias("n_keys"))


def levels(df: DataFrame, col: str, max_levels: int = 10000) -> list:
    """Sorted distinct non-null values of a low-cardinality column, with a hard cap:
    this is the only place a level list reaches the driver."""
    rows = (df.select(col).where(F.col(col).isNotNull()).distinct()
              .orderBy(col).limit(max_levels + 1).collect())
    if len(rows) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels; use the long form")
    return [r[0] for r in rows]


def indicators_wide(df: DataFrame, key: str, col: str, sep: str, level_list: Sequence[str],
                    prefix: str = "", underscore_to_space: bool = True,
                    keep: Sequence[str] = (), max_levels: int = 200) -> DataFrame:
    """E1/E2 wide form: one 0/1 column per level, the packed column dropped.

    Token equality (``level in split(packed)``), null packed -> 0. The level list comes
    from the caller (derive it once from train with ``levels``), which keeps train and
    test schemas equal. Built with ``arrays_overlap``-style lookups on the row itself:
    no explode, no shuffle.
    """
    if len(level_list) > max_levels:
        raise ValueError(f"{len(level_list)} levels > max_levels={max_levels}; use to_long")
    arr = F.transform(split_packed(col, sep), lambda x: F.trim(x))
    cols = []
    for lv in level_list:
        name = prefix + (lv.replace("_", " ") if underscore_to_space else lv)
        cols.append(F.coalesce(F.array_contains(arr, F.lit(lv)).cast("int"), F.lit(0)).alias(name))
    base = [c for c in ([key] + list(keep)) if c != col]
    return df.select(*base, *cols)


def substring_long(long: DataFrame, key: str = "person_id", token: str = "token",
                   vocab: DataFrame | None = None, vocab_col: str = "token",
                   out: str = "match", sep_char: str = "|") -> DataFrame:
    """Substring indicators in long form -- (key, name) for every vocabulary name
    that occurs *anywhere* in the key's packed string.

    Exact without ever pairing persons with the vocabulary: a trimmed name without
    the separator cannot straddle a separator, so it occurs in the packed string iff
    it occurs inside one token. The distinct names are dealt into shards of at most about
    ``SHARD_NAMES``; a shard's names become one automaton (a trie with failure links), and
    each distinct token is scanned once by each shard. A task holds one shard and as many
    tokens; work is linear in the tokens' text and independent of the person count.
    Repeats of a pair are removed by tasks of about ``PAIR_ROWS`` rows each, whatever the
    partitions of ``long`` hold.
    """
    from cohortkit.session import materialise
    # the distinct tokens (vocabulary-sized) are read by several jobs: write them once
    toks = materialise(long.groupBy(F.col(token).alias("_text")).agg(F.count(F.lit(1)).alias("_rows")))
    names = (vocab.select(F.col(vocab_col).alias("_name")) if vocab is not None else toks.select(F.col("_text").alias("_name")))
    names = materialise(names.where(F.length("_name") > 0).distinct())
    # exactness precondition: names/tokens are trimmed and free of the separator
    # character, so no match can straddle a separator (one aggregate over the vocabulary)
    size = names.agg(F.count(F.lit(1)).alias("n"), F.count_if(
        F.col("_name").contains(sep_char) | (F.trim("_name") != F.col("_name"))).alias("bad")).first()
    if size["bad"]:
        raise ValueError("substring indicators need trimmed names without the separator character")
    shards, chunks = -(-size["n"] // SHARD_NAMES) or 1, -(-toks.count() // SHARD_NAMES) or 1
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sharded = names.select("_name", deal("_name", shards).alias("_shard"), every(chunks).alias("_part"))
    chunked = toks.select("_text", every(shards).alias("_s"), deal("_text", chunks).alias("_c"))
    token_map = materialise(sharded.groupBy("_shard", "_part").cogroup(chunked.groupBy("_s", "_c"))
                            .applyInPandas(_names_inside, "text string, name string")
                            .select(F.col("text").alias(token), F.col("name").alias(out)))
    rows = token_map.join(toks, F.col(token) == F.col("_text")).agg(F.sum("_rows")).first()[0] or 0
    pairs = long.join(token_map, token).select(key, out)
    if rows > PAIR_ROWS:
        pairs = pairs.repartition(-(-rows // PAIR_ROWS), key, out)
    return pairs.distinct()


def _names_inside(names: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """(text, name) of every name inside a text: the automaton reports each occurrence, a
    name's repeats in one text count once."""
    import ahocorasick
    found, held = [], []
    if len(names) and len(texts):
        machine = ahocorasick.Automaton()
        for name in names["_name"]:
            machine.add_word(name, name)
        machine.make_automaton()
        for text in texts["_text"]:
            inside = {name for _, name in machine.iter(text)}
            found += inside
            held += [text] * len(inside)
    return pd.DataFrame({"text": pd.Series(held, dtype="object"), "name": pd.Series(found, dtype="object")})
