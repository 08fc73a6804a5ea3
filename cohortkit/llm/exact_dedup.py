"""Exact deduplication against an index of historical digests.

The index is a set of minimal perfect hash functions, one per shard of the digest
space. A shard's slots ``[0, n)`` each hold one full 32-byte digest, the locator of the
winning row and the number of rows seen. A digest hashes to at most one slot; the slot's
bytes are compared in full, so a foreign digest that lands on an occupied slot is told
apart. Digests that are not in the index form groups of their own.

Rows are reduced to (digest, winner, count) by a map-side combined aggregate before
anything is sharded, so a text that fills a third of the table is one row per map task.
Digests are uniform, so shards are even whatever the texts are.

Edge cases: a null text is the empty text; a null id never beats another id; of repeated
rows with one id exactly one wins; an empty table gives an empty result; columns other
than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import only_rows, staged, text_key, text_or_empty, without_rows

SHARD_ROWS = 1 << 16          # digests per shard, on average
GAMMA = 2.0                   # bits per remaining key at each level
MAX_LEVELS = 200

INDEX_SCHEMA = ("shard int, n long, sizes array<long>, bits array<binary>, digests binary, "
                "winner_id binary, winner_null binary, winner_row binary, counts binary")
GROUP_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long, historical boolean"


# ---------------------------------------------------------------- the hash function
def _mix(words: np.ndarray, level: int) -> np.ndarray:
    """64-bit hash of (n, 4) digest words, seeded by the level."""
    h = np.full(len(words), np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (2**64 - 1)))
    for j in range(4):
        h ^= words[:, j]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 4)


def build_mph(digests: bytes) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """Slots of n distinct digests (a permutation of 0..n-1), level sizes and level bits.

    At each level a key keeps a position that it alone hashes to; the rest go on to the
    next level. A key's slot is the rank of its bit among all levels' bits.
    """
    words = _words(digests)
    left = np.arange(len(words))
    slots = np.zeros(len(words), dtype=np.int64)
    sizes, bits, base = [], [], 0
    for level in range(MAX_LEVELS):
        if not len(left):
            return slots, sizes, bits
        size = max(64, int(GAMMA * len(left)))
        at = (_mix(words[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        placed = alone[at]
        slots[left[placed]] = base + rank[at[placed]]
        base += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(alone))
        left = left[~placed]
    raise ValueError("digests of a shard are not distinct")


def find_slots(digests: bytes, sizes: list[int], bits: list[np.ndarray]) -> np.ndarray:
    """The slot each digest hashes to, -1 where every level's bit is unset."""
    words = _words(digests)
    found = np.full(len(words), -1, dtype=np.int64)
    left, base = np.arange(len(words)), 0
    for level, (size, packed) in enumerate(zip(sizes, bits)):
        alone = np.unpackbits(packed, count=size).astype(bool)
        rank = np.cumsum(alone) - 1
        at = (_mix(words[left], level) % np.uint64(size)).astype(np.int64)
        hit = alone[at]
        found[left[hit]] = base + rank[at[hit]]
        base += int(alone.sum())
        left = left[~hit]
    return found


# ---------------------------------------------------------------- Spark side
def digest_rows(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """id, text key, digest and a row number that stays fixed because the table is written."""
    return staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text),
                              F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)).alias("digest"),
                              F.monotonically_increasing_id().alias("row")), "digests")


def digest_groups(rows: DataFrame, shards: int) -> DataFrame:
    """One row per distinct digest: winner locator (largest id, then row) and row count."""
    return (rows.groupBy("digest")
            .agg(F.max(F.struct("doc_id", "row")).alias("w"), F.count(F.lit(1)).alias("n"))
            .select(F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"), "digest",
                    F.col("w.doc_id").alias("winner_id"), F.col("w.row").alias("winner_row"), "n"))


def _ids(col: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    null = col.isna().to_numpy()
    return col.fillna(0).to_numpy(dtype=np.int64), null


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = b"".join(pdf["digest"])
    slots, sizes, bits = build_mph(digests)
    order = np.empty(len(slots), dtype=np.int64)
    order[slots] = np.arange(len(slots))
    ids, null = _ids(pdf["winner_id"])
    return pd.DataFrame([{
        "shard": int(pdf["shard"].iloc[0]), "n": len(slots), "sizes": sizes,
        "bits": [b.tobytes() for b in bits], "digests": _words(digests)[order].tobytes(),
        "winner_id": ids[order].tobytes(), "winner_null": null[order].tobytes(),
        "winner_row": pdf["winner_row"].to_numpy(np.int64)[order].tobytes(),
        "counts": pdf["n"].to_numpy(np.int64)[order].tobytes()}])


def build_index(groups: DataFrame) -> DataFrame:
    """One row per shard: levels of the hash function and the slots' contents."""
    return groups.groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)


def _lookup_shard(index: pd.DataFrame, incoming: pd.DataFrame) -> pd.DataFrame:
    """Index slots with incoming repeats folded in, then the nonmembers' own groups."""
    new_ids, new_null = _ids(incoming["winner_id"])
    new_rows, new_n = incoming["winner_row"].to_numpy(np.int64), incoming["n"].to_numpy(np.int64)
    digests = b"".join(incoming["digest"])
    parts = []
    member = np.zeros(len(incoming), dtype=bool)
    if len(index):
        ix = index.iloc[0]
        slots = _words(ix["digests"])
        ids = np.frombuffer(ix["winner_id"], np.int64).copy()
        null = np.frombuffer(ix["winner_null"], bool).copy()
        rows = np.frombuffer(ix["winner_row"], np.int64).copy()
        counts = np.frombuffer(ix["counts"], np.int64).copy()
        at = find_slots(digests, list(ix["sizes"]), [np.frombuffer(b, np.uint8) for b in ix["bits"]])
        member = at >= 0
        member[member] = (slots[at[member]] == _words(digests)[member]).all(axis=1)  # full bytes
        s, m = at[member], np.flatnonzero(member)
        counts[s] += new_n[m]
        later = ~new_null[m] & (null[s] | (new_ids[m] > ids[s]) | ((new_ids[m] == ids[s]) & (new_rows[m] > rows[s])))
        later |= new_null[m] & null[s] & (new_rows[m] > rows[s])
        ids[s[later]], null[s[later]], rows[s[later]] = new_ids[m][later], False, new_rows[m][later]
        null[s[later & new_null[m]]] = True
        raw = ix["digests"]
        parts.append(pd.DataFrame({"digest": [raw[i:i + 32] for i in range(0, len(raw), 32)],
                                   "keep_id": pd.Series(ids, dtype="Int64").mask(null),
                                   "keep_row": rows, "group_size": counts, "historical": True}))
    rest = np.flatnonzero(~member)
    parts.append(pd.DataFrame({"digest": [digests[32 * i:32 * i + 32] for i in rest],
                               "keep_id": pd.Series(new_ids[rest], dtype="Int64").mask(new_null[rest]),
                               "keep_row": new_rows[rest], "group_size": new_n[rest], "historical": False}))
    return pd.concat(parts, ignore_index=True)


def lookup(index: DataFrame, incoming_groups: DataFrame) -> DataFrame:
    """All distinct digests of index and incoming rows with their winner and size."""
    return (index.groupBy("shard").cogroup(incoming_groups.groupBy("shard"))
            .applyInPandas(_lookup_shard, GROUP_SCHEMA))


def exact_dedup(docs: DataFrame, historical: Column, id_col: str = "doc_id",
                text: str | Column = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, tk, digest, keep_id, group_size, kept, historical for every row of ``docs``.

    ``historical`` marks the rows whose digests make up the index (it may use the id
    column only, as ``doc_id``); the other rows are looked up in it. Either way a group's
    winner is its largest id. The last join is the only step that touches all rows of a
    hot group at once; both of its sides are shuffled directly, so adaptive execution
    splits the hot partition.
    """
    rows = digest_rows(docs, id_col, text)
    shards = max(1, -(-rows.count() // shard_rows))
    marked = F.coalesce(historical, F.lit(False))
    index = build_index(digest_groups(rows.where(marked), shards))
    groups = staged(lookup(index, digest_groups(rows.where(~marked), shards)), "groups")
    return (rows.join(groups, "digest")
            .select("doc_id", "tk", "digest", "keep_id", "group_size",
                    (F.col("row") == F.col("keep_row")).alias("kept"), "historical"))


def drop_copies(docs: DataFrame, historical: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; of rows that share id and text
    any one stays."""
    per = staged(exact_dedup(docs, historical, id_col, text_col).groupBy("doc_id", "tk").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdicts")
    twice = per.where("kept and n > 1")
    once = without_rows(docs, per.where("not kept or n > 1"), id_col, text_col)
    return once.unionByName(only_rows(docs, twice, id_col, text_col).dropDuplicates([id_col, text_col]))
