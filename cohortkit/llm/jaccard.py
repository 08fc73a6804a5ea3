"""Exact Jaccard join of word n-gram sets by PartEnum signatures.

Sets that are equal form a class and take part once. An n-gram that only one class has is
in no intersection: a set whose ``u`` such n-grams leave ``size - u`` below the wanted share
of its size can be linked with nothing. This is tested first with the n-grams of a quarter
of the hash domain (a lower bound of ``u``), then, among the sets that are left, with all of
them; unique n-grams are found by a map-side combined minimum and maximum of the classes.
What is left of a set without its unique n-grams goes on.

Signatures. Sets are put into size bands so wide that two sets with the wanted similarity
lie in one band or in neighbouring ones; a set takes part in the band of its own size and
in the next one. In a band the similarity bounds the sets' symmetric difference by ``k``.
The feature domain is hashed into ``groups`` groups of three parts. As a group with at most
one difference leaves two of its three parts equal, and ``groups`` is chosen so that at
least two groups have at most one, similar sets agree on a pair of parts in two groups or
more. A signature is such a pair's content. Pairs of parts that are empty would be shared
by many sets; they are only used two by two, from different groups (two agreeing groups
are both empty, or one of them is not), which keeps the join whole and these keys rare.

Comparison. In a bucket (sets with one signature) no pairs are enumerated at first: each
set is compared with one hub, the bucket minimum it shares most buckets with, and
components are formed from the verified links. Sets with one hub, four hubs on, are a cluster
(those of small hubs share one); a cluster's sets are dealt into blocks of bounded size and compared
block by block inside the tasks, which hand on a spanning forest of the links found. Of two
clusters only the sets meet that share a bucket with a set of the other one and of another
component, and whose sizes allow a link. So a large group of near copies
costs one comparison a set where they are linked, and where they are just below the
similarity it costs block products but no rows for pairs. The sets of a cluster's largest
component are compared with the others only. No two components that a link joins stay apart.

Edge cases: texts with fewer words than the n-gram are one n-gram; null texts and texts
without words have an empty set and are linked with nothing; a null id stays null; repeated
rows are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import fitting_broadcast, staged, text_key, text_or_empty, without_rows
from cohortkit.llm.components import components

CHUNK_BYTES = 1 << 19
PARTS = 3                      # parts of a group; two of them make a signature
AGREE = 2                      # groups on which similar sets agree at least
SAMPLED = 4                    # the first test of unique n-grams takes one hash in so many
BLOCK_SETS, BLOCK_BYTES = 1024, 4 << 20
COLUMNS = 512                  # n-grams of a block product at once
DENSE, CODES = 64, 1 << 18     # rows above which an n-gram is counted densely; pairs counted at once
ROWS = 128                     # rows of a block whose links are judged at once
TASK_GROUPS = 256              # pairs of blocks in a task, however small
MOST_TASKS = 100_000
HOPS = 2                       # times that a set takes its hub's hub
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
WORD_AT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# ---------------------------------------------------------------- sets of n-grams
def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_CODE = BYTE[_LOWER]


def ngram_sets(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each text, one text after the other; their number
    per text). ``data``: UTF-8 bytes of the texts in a row; ``ends``: where each ends."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= _SPACE[data[:-1]]
    edge = starts[starts < len(data)]
    first[edge] = word[edge]                     # a word never reaches into the next text
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    letters = np.flatnonzero(word)
    of = np.cumsum(first[letters]) - 1
    place = letters - at[of]
    value = _CODE[data[letters]] * _powers(int(place.max()) + 1)[place]
    begin = np.searchsorted(letters, at)
    words = mix(np.add.reduceat(value, begin))
    text = np.searchsorted(ends, at, side="right")
    n_words = np.bincount(text, minlength=len(ends))
    base = np.cumsum(n_words) - n_words
    # the j-th word of the n-gram from each word on; words beyond the text add nothing
    order = np.arange(len(words)) - base[text]
    left = n_words[text] - order
    total = np.zeros(len(words), np.uint64)
    for j in range(n):
        inside = np.flatnonzero(left > j)
        total[inside] += words[inside + j] * WORD_AT[j]
    keep = (left >= n) | (order == 0)
    grams = mix(total[keep] + np.minimum(left[keep], n).astype(np.uint64))
    owner = text[keep]
    by = np.lexsort((grams, owner))
    grams, owner = grams[by], owner[by]
    new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))
    return grams[new], np.bincount(owner[new], minlength=len(ends))


def set_ids(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One signed 64-bit id per set; sets without elements get 0."""
    some = sizes > 0
    out = np.zeros(len(sizes), np.uint64)
    if some.any():
        begin = (np.cumsum(sizes) - sizes)[some]
        out[some] = mix(np.add.reduceat(mix(grams ^ WORD_AT[40]), begin) + sizes[some].astype(np.uint64))
    return out.view(np.int64)


def _chunks(texts: pa.StringArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, ends) of runs of about CHUNK_BYTES; at least one row."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1)
        b = min(b, len(texts))
        yield a, b - a, data[offsets[a]:offsets[b]], offsets[a + 1:b + 1] - offsets[a]
        a = b


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tk, set_id, n_shingles of every row (doc_id, tk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, rows, data, ends in _chunks(batch.column(2)):
                grams, sizes = ngram_sets(data, ends, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), batch.column(1).slice(a, rows),
                     pa.array(set_ids(grams, sizes)), pa.array(sizes)],
                    ["doc_id", "tk", "set_id", "n_shingles"])

    return docs.mapInArrow(run, "doc_id long, tk long, set_id long, n_shingles long")


# ---------------------------------------------------------------- signatures
def bands(most: int, num: int, den: int) -> np.ndarray:
    """Last size of each band: the next band begins after the largest size that can be
    similar to the first size of this one."""
    last, size = [0], 1
    while last[-1] < most:
        last.append(size * den // num)
        size = last[-1] + 1
    return np.array(last, np.int64)


def signatures(grams: np.ndarray, held: np.ndarray, sizes: np.ndarray, num: int,
               den: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the set, signature) of all signatures. ``held``: n-grams of each set in
    ``grams``; ``sizes``: with those that no other set has."""
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = bands(int(sizes.max()), num, den)
    ends = np.append(ends, (ends[-1] + 1) * den // num)
    own = np.searchsorted(ends, sizes)
    sets = np.repeat(np.arange(len(sizes)), held)
    parted = mix(grams ^ WORD_AT[41])
    value = mix(grams ^ WORD_AT[42])
    out_set, out_sig = [], []
    for step in (0, 1):
        band = own + step
        # |x ^ y| <= (den - num) / (den + num) * (|x| + |y|), sizes up to the band's last
        k = (den - num) * 2 * ends[band] // (den + num)
        groups = np.where((sizes > 0) & (k > 0), k // 2 + AGREE, 0)   # k = 0: equal sets only
        base = PARTS * (np.cumsum(groups) - groups)
        total = int(PARTS * groups.sum())
        if not total:
            continue
        active = groups[sets] > 0
        who = sets[active]
        # the part depends on the band's number of groups, alike for all sets of the band
        cell = base[who] + (parted[active] % (PARTS * groups[who]).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, cell, value[active])
        filled = np.bincount(cell, minlength=total).reshape(-1, PARTS)
        sums = sums.reshape(-1, PARTS)
        owner = np.repeat(np.arange(len(sizes)), groups)
        group = np.arange(len(owner)) - (np.cumsum(groups) - groups)[owner]
        label = mix(band[owner].astype(np.uint64) << np.uint64(32) | group.astype(np.uint64))
        empty_set, empty_key, empty_group = [], [], []
        for left_out in range(PARTS):
            sig = mix(sums.sum(axis=1) - sums[:, left_out] + label * np.uint64(2 * left_out + 1))
            empty = filled.sum(axis=1) - filled[:, left_out] == 0
            out_set.append(owner[~empty])
            out_sig.append(sig[~empty])
            empty_set.append(owner[empty])
            empty_key.append(mix(label[empty] + np.uint64(left_out + 7)))
            empty_group.append(group[empty])
        pair_set, pair_sig = _empty_pairs(*map(np.concatenate, (empty_set, empty_group, empty_key)))
        out_set.append(pair_set)
        out_sig.append(pair_sig)
    if not out_set:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_set), np.concatenate(out_sig)


def _empty_pairs(sets: np.ndarray, groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of two empty pairs of parts of different groups of one set."""
    by = np.lexsort((groups, sets))
    sets, groups, keys = sets[by], groups[by], keys[by]
    out_set, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for gap in range(1, len(sets)):
        same = sets[gap:] == sets[:-gap]
        if not same.any():
            break
        pick = np.flatnonzero(same & (groups[gap:] != groups[:-gap]))
        out_set.append(sets[pick])
        out_sig.append(mix(keys[pick] * np.uint64(3) + keys[pick + gap]))
    return np.concatenate(out_set), np.concatenate(out_sig)


def signature_rows(sets: DataFrame, num: int, den: int) -> DataFrame:
    """sig, set_id of rows (set_id, size, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for a, rows, data, ends in _chunks(batch.column(2)):
                held = np.diff(np.append(0, ends)) // 8
                who, sig = signatures(np.frombuffer(data.tobytes(), np.uint64), held, sizes[a:a + rows], num, den)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), batch.column(0).slice(a, rows).take(pa.array(who))],
                    ["sig", "set_id"])

    return sets.mapInArrow(run, "sig long, set_id long")


# ---------------------------------------------------------------- unique n-grams
def sampled_grams(rows: DataFrame, n: int) -> DataFrame:
    """gram, set_id of one n-gram hash in SAMPLED, of rows (text); a task hands on each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, ends in _chunks(batch.column(0)):
                grams, sizes = ngram_sets(data, ends, n)
                ids = set_ids(grams, sizes)
                fresh = np.zeros(len(ids), bool)
                fresh[np.unique(ids, return_index=True)[1]] = True
                fresh &= ~np.isin(ids, seen)
                seen = np.union1d(seen, ids)
                pick = np.repeat(fresh, sizes) & (grams % np.uint64(SAMPLED) == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[pick].view(np.int64)), pa.array(np.repeat(ids, sizes)[pick])],
                    ["gram", "set_id"])

    return rows.mapInArrow(run, "gram long, set_id long")


def all_grams(contents: DataFrame) -> DataFrame:
    """gram, set_id of rows (set_id, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, rows, data, ends in _chunks(batch.column(1)):
                held = np.diff(np.append(0, ends)) // 8
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(data.tobytes(), np.int64)),
                     batch.column(0).slice(a, rows).take(pa.array(np.repeat(np.arange(rows), held)))],
                    ["gram", "set_id"])

    return contents.select("set_id", "grams").mapInArrow(run, "gram long, set_id long")


def unique_grams(grams: DataFrame) -> DataFrame:
    """gram, set_id of the n-grams that one set only has."""
    return (grams.groupBy("gram").agg(F.min("set_id").alias("set_id"), F.max("set_id").alias("last"))
            .where("set_id = last").select("gram", "set_id"))


def may_link(size, unique, num: int, den: int):
    """The set's other n-grams can still be the wanted share of a union."""
    return F.lit(den) * (size - unique) >= F.lit(num) * size


# ---------------------------------------------------------------- comparison
def set_contents(docs: DataFrame, n: int) -> DataFrame:
    """set_id, size, grams (sorted 64-bit hashes) of rows (set_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, rows, data, ends in _chunks(batch.column(1)):
                grams, sizes = ngram_sets(data, ends, n)
                parts = np.split(grams, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), pa.array(sizes),
                     pa.array([p.tobytes() for p in parts], pa.binary())], ["set_id", "size", "grams"])

    return docs.mapInArrow(run, "set_id long, size long, grams binary")


def reduced_sets(contents: DataFrame, num: int, den: int) -> DataFrame:
    """set_id, size, grams without unique ones, of the sets that may link with others."""
    unique = (unique_grams(all_grams(contents)).groupBy("set_id")
              .agg(F.count(F.lit(1)).alias("u"), F.collect_list("gram").alias("unique")))
    left = (contents.join(unique, "set_id", "left")
            .where(may_link(F.col("size"), F.coalesce("u", F.lit(0)), num, den))
            .select("set_id", "size", "grams", "unique"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                grams, drop = np.frombuffer(raw, np.uint64), batch.column(3)[i].values
                if drop is not None and len(drop):
                    grams = np.setdiff1d(grams, drop.to_numpy().view(np.uint64), assume_unique=True)
                out.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                                             ["set_id", "size", "grams"])

    return left.mapInArrow(run, "set_id long, size long, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, sizes = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_numpy()
            ok = np.zeros(len(left), bool)
            for i, (x, y) in enumerate(zip(left, right)):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok[i] = den * shared >= num * (sizes[i] - shared)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("grams").alias(f"g_{c}"),
                                 F.col("size").alias(f"n_{c}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .select("a", "b", "g_a", "g_b", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(run, "a long, b long"))


def spanning_links(linked: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Of the links of a symmetric matrix, so few that no circle is left, where the rows of
    one group count as joined already."""
    names, group = np.unique(group, return_inverse=True)
    order = np.argsort(group, kind="stable")
    members = np.split(order, np.searchsorted(group[order], np.arange(1, len(names))))
    seen, out = np.zeros(len(names), bool), []
    for start in range(len(names)):
        todo = [] if seen[start] else [start]
        seen[start] = True
        while todo:
            for u in members[todo.pop()]:
                new = np.nonzero(linked[u] & ~seen[group])[0]
                found, first = np.unique(group[new], return_index=True)
                out += [(int(u), int(v)) for v in new[first]]
                seen[found] = True
                todo += found.tolist()
    return out


def shared_counts(parts: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many n-grams each row of ``left`` has in common with each row of ``right`` (two
    blocks, or one block twice). N-grams that few rows have are counted by their pairs of
    rows, the others by products of dense columns; those of one row only take no part."""
    m, wide = len(parts), len(right)
    grams = np.concatenate(parts)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    new = np.append(True, grams[1:] != grams[:-1])[:len(grams)]
    del grams
    row = np.repeat(np.arange(m, dtype=np.int32), [len(p) for p in parts])[order]
    del order
    held = np.diff(np.append(np.flatnonzero(new), len(new))).astype(np.int32)
    held_at = np.repeat(held, held)
    at_left, at_right = np.full(m, -1), np.full(m, -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(wide)
    out = np.zeros(len(left) * wide, np.int32)

    def count(a: np.ndarray, b: np.ndarray) -> None:
        code = at_left[a] * wide + at_right[b]
        code = code[(at_left[a] >= 0) & (at_right[b] >= 0)]
        if len(code):
            np.add(out, np.bincount(code, minlength=len(out)), out=out, casting="unsafe")

    for c in np.unique(held[(held > 1) & (held <= DENSE)]).tolist():
        rows = row[held_at == c].reshape(-1, c)
        a, b = np.triu_indices(c, 1)
        step = max(1, CODES // len(a))
        for at in range(0, len(rows), step):
            x, y = rows[at:at + step, a].ravel(), rows[at:at + step, b].ravel()
            count(x, y)
            count(y, x)
    out = out.reshape(len(left), wide)
    heavy = np.flatnonzero(held_at > DENSE)
    if len(heavy):
        row, column = row[heavy], np.cumsum(new[heavy]) - 1
        for first in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, (first, first + COLUMNS))
            part = np.zeros((m, COLUMNS), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            np.add(out, part[left] @ part[right].T, out=out, casting="unsafe")
    return out


def _compare_blocks(num: int, den: int):
    """A spanning forest of the links between components of one block or of two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        comp, block = pdf["component"].to_numpy(), pdf["block"].to_numpy()
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        if (comp == comp[0]).all() or (p != q and (block == block[0]).all()):
            return none
        parts = [np.frombuffer(g, np.uint64) for g in pdf["grams"]]
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        if not sum(map(len, parts)):
            return none
        shared = shared_counts(parts, left, right)
        size = pdf["size"].to_numpy()
        ok = np.zeros((len(parts), len(parts)), bool)
        for at in range(0, len(left), ROWS):
            some, both = left[at:at + ROWS], shared[at:at + ROWS].astype(np.int64)
            linked = den * both >= num * (size[some][:, None] + size[right][None, :] - both)
            ok[np.ix_(some, right)] = linked & (comp[some][:, None] != comp[right][None, :])
        ok |= ok.T
        pairs = np.array(spanning_links(ok, comp), np.int64).reshape(-1, 2)
        ids = pdf["set_id"].to_numpy()
        return pd.DataFrame({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return run


def block_plan(members: DataFrame) -> DataFrame:
    """cluster, its largest component, its blocks (same, apart) and their pairs as multiples of
    a pair of full blocks (work), of rows (cluster, component, set_id, grams).

    The sets of a cluster's largest component need no comparison with one another: they are
    dealt into blocks 0, 1, ... of their own, and the other sets into the blocks after them. A
    cluster that fits one block is one."""
    sizes = (members.groupBy("cluster", "component")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("grams")).alias("bytes")))
    largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
    main = F.col("component") == F.col("largest")
    of = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    full = lambda c: F.greatest(of(c, "n") / BLOCK_SETS, of(c, "bytes") / BLOCK_BYTES)
    one = F.col("f_all") <= 1
    return (sizes.join(largest, "cluster").groupBy("cluster", "largest")
            .agg(full(main).alias("f_same"), full(~main).alias("f_apart"), full(F.lit(True)).alias("f_all"))
            .select("cluster", "largest", F.when(one, 0).otherwise(F.ceil("f_same")).cast("int").alias("same"),
                    F.when(one & (F.col("f_apart") > 0), 1).otherwise(F.ceil("f_apart")).cast("int").alias("apart"),
                    (F.col("f_apart") * (F.col("f_same") + F.col("f_apart"))).alias("work")))


def compare_tasks(plan: DataFrame, least: int) -> int:
    """One task for as much as two full blocks are, or for TASK_GROUPS pairs of small ones."""
    pairs = F.col("apart").cast("double") * (F.col("same") + F.col("apart"))
    work, groups = plan.agg(F.sum("work"), F.sum(pairs)).first()
    return min(max(least, int(work or 0), int((groups or 0) / TASK_GROUPS)), MOST_TASKS)


def neighbourhoods(sets: DataFrame, hubs: DataFrame) -> DataFrame:
    """set_id, cluster of rows (set_id, grams). Sets with one hub, 2 ** HOPS hubs on, are a
    cluster; those of small hubs share clusters of about a block."""
    homes = sets.join(hubs, "set_id", "left").select(
        "set_id", F.coalesce("hub", "set_id").alias("home"), F.octet_length("grams").alias("bytes"))
    for _ in range(HOPS):
        homes = staged(homes, "homes")
        homes = homes.join(homes.select(F.col("set_id").alias("home"), F.col("home").alias("next")), "home").select(
            "set_id", F.col("next").alias("home"), "bytes")
    homes = staged(homes, "homes")
    full = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("bytes") / BLOCK_BYTES)
    filled = staged(homes.groupBy("home").agg(full.alias("f")), "filled")
    small = F.col("f") <= 0.5
    pools = int(filled.where(small).agg(F.ceil(F.sum("f"))).first()[0] or 1)
    cluster = F.when(small, F.pmod(F.xxhash64("home"), F.lit(pools))).otherwise(F.col("home"))
    return homes.join(filled.select("home", cluster.alias("cluster")), "home").select("set_id", "cluster")


def meetings(placed: DataFrame, num: int, den: int) -> DataFrame:
    """set_id, component, cluster, held, other: the other clusters in which a set may have a link, of
    rows (sig, set_id, component, cluster, size, held): one of its buckets holds a set of that
    cluster, of another component, with which it can have the wanted share of a union."""
    apart = (placed.groupBy("sig")
             .agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                  F.min("cluster").alias("first"), F.max("cluster").alias("last"))
             .where("lo <> hi AND first <> last").select("sig"))
    apart = staged(apart, "apart")
    across = staged(placed.join(fitting_broadcast(apart, apart.count(), 24), "sig"), "across")
    reach = (across.groupBy("sig", F.col("cluster").alias("other"))
             .agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                  F.min("size").alias("least"), F.max("held").alias("most")))
    shareable = F.lit(num + den) * F.least("held", "most") >= F.lit(num) * (F.col("size") + F.col("least"))
    return (across.join(reach, "sig")
            .where((F.col("cluster") != F.col("other")) & shareable)
            .where((F.col("lo") != F.col("component")) | (F.col("hi") != F.col("component")))
            .select("set_id", "component", "cluster", "held", "other").distinct())


def across_plan(met: DataFrame) -> DataFrame:
    """cluster, other (the smaller one first), the blocks of the sets of each that meet the other
    (same, apart) and their pairs as multiples of a pair of full blocks (work), of rows
    (cluster, other, held)."""
    full = F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("held") * 8 / BLOCK_BYTES)
    sides = met.groupBy("cluster", "other").agg(full.alias("f"))
    right = sides.select(F.col("cluster").alias("other"), F.col("other").alias("cluster"), F.col("f").alias("g"))
    return (sides.where("cluster < other").join(right, ["cluster", "other"])
            .select("cluster", "other", F.ceil("f").cast("int").alias("same"), F.ceil("g").cast("int").alias("apart"),
                    (F.col("f") * F.col("g")).alias("work")))


def _cluster_links(shared: DataFrame, part: DataFrame, hubs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between sets that share a bucket and are in different components."""
    near = neighbourhoods(sets, hubs)
    near = near.join(part, near["set_id"] == part["node"], "left").select(
        "set_id", "cluster", F.coalesce("component", "set_id").alias("component"))
    members = staged(near.join(sets, "set_id"), "cluster_sets")
    known = members.select("set_id", "component", "cluster", "size", (F.octet_length("grams") / 8).cast("long").alias("held"))
    placed = shared.join(fitting_broadcast(known, members.count(), 56), "set_id").select("sig", *known.columns)
    met = staged(meetings(staged(placed, "placed"), num, den), "met")
    slot = F.xxhash64("set_id")

    # inside a cluster
    plan = staged(block_plan(members), "blocks")
    main = F.col("component") == F.col("largest")
    block = F.when(main & (F.col("same") > 0), F.pmod(slot, F.col("same"))).otherwise(F.col("same") + F.pmod(slot, F.col("apart"))).cast("int")
    others = F.sequence(F.col("same"), F.col("same") + F.col("apart") - 1)
    every = F.sequence(F.lit(0), F.col("same") + F.col("apart") - 1)
    row = ["set_id", "component", "size", "grams"]
    inside = (members.join(plan, "cluster").where("apart > 0")
              .withColumn("block", block).withColumn("at", F.explode(F.when(main & (F.col("same") > 0), others).otherwise(every)))
              .select("cluster", F.col("cluster").alias("other"), F.least("block", "at").alias("p"),
                      F.greatest("block", "at").alias("q"), "block", *row))

    # between two clusters
    pairs = staged(across_plan(met), "pairs")
    first = F.col("cluster") < F.col("other")
    sides = met.join(sets, "set_id").select(F.least("cluster", "other").alias("cluster"), F.greatest("cluster", "other").alias("other"),
                       first.alias("first"), *row).join(pairs, ["cluster", "other"])
    block = F.when(F.col("first"), F.pmod(slot, F.col("same"))).otherwise(F.col("same") + F.pmod(slot, F.col("apart"))).cast("int")
    facing = F.when(F.col("first"), others).otherwise(F.sequence(F.lit(0), F.col("same") - 1))
    across = (sides.withColumn("block", block).withColumn("at", F.explode(facing))
              .select("cluster", "other", F.least("block", "at").alias("p"), F.greatest("block", "at").alias("q"), "block", *row))

    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(compare_tasks(plan, tasks), compare_tasks(pairs, tasks))
    group = ["cluster", "other", "p", "q"]
    return (inside.union(across).repartition(tasks, *group).groupBy(*group)
            .applyInPandas(_compare_blocks(num, den), "a long, b long"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tk, n_shingles, set_id, component_id (smallest id reachable over links), and
    ``first``: whether the row is the component's first one by id and text key."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col),
                       text_or_empty(text_col).alias("text"))
    sets = staged(set_rows(rows, n), "sets")
    classes = staged(sets.where("n_shingles > 0").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "tk")).alias("first_row"), F.max("n_shingles").alias("size")), "classes")

    # sets that their unique n-grams keep from any link go, the others are read again
    some_unique = unique_grams(sampled_grams(rows.select("text"), n)).groupBy("set_id").agg(F.count(F.lit(1)).alias("u"))
    chosen = staged(classes.join(some_unique, "set_id", "left")
                    .where(may_link(F.col("size"), F.coalesce("u", F.lit(0)), num, den))
                    .select("set_id", "first_row.*"), "chosen")
    small = fitting_broadcast(chosen, chosen.count(), 56)
    contents = staged(set_contents(
        rows.join(small, rows["doc_id"].eqNullSafe(small["doc_id"]) & (rows["tk"] == small["tk"]))
        .select("set_id", "text"), n).dropDuplicates(["set_id"]), "contents")
    reduced = staged(reduced_sets(contents, num, den), "reduced")

    # buckets that two different sets share; the hub is the smallest set of the bucket
    sigs = signature_rows(reduced, num, den)       # quick to make, so made twice rather than written
    spans = (sigs.groupBy("sig").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("last"))
             .where("hub <> last").select("sig", "hub"))
    shared = staged(sigs.join(spans, "sig").select("sig", "set_id", "hub"), "shared")

    # each set against one hub, then what is still apart in a bucket, block by block
    hubs = staged(shared.where("set_id <> hub").groupBy("set_id", "hub").agg(F.count(F.lit(1)).alias("n"))
                  .groupBy("set_id").agg(F.max_by("hub", F.struct("n", "hub")).alias("hub")), "hubs")
    stars = hubs.select(F.col("hub").alias("a"), F.col("set_id").alias("b"))
    links = staged(verified(stars, reduced, num, den), "star_links")
    more = staged(_cluster_links(shared, components(links), hubs, reduced, num, den), "cluster_links")
    joined = components(links.union(more))
    least = (joined.join(classes, joined["node"] == classes["set_id"])
             .groupBy("component").agg(F.min("first_row").alias("least")))
    final = staged(classes.join(joined, classes["set_id"] == joined["node"], "left")
                   .join(least, "component", "left")
                   .select("set_id", F.coalesce("least", "first_row").alias("least")), "final")
    some = F.col("n_shingles") > 0
    return (sets.join(final, "set_id", "left")
            .select("doc_id", "tk", "n_shingles", "set_id",
                    F.when(some, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    (~some | F.struct("doc_id", "tk").eqNullSafe(F.col("least"))).alias("first")))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with the first row of each component (repeated rows stay repeated)."""
    return without_rows(docs, jaccard_components(docs, n, num, den).where(~F.col("first")))
