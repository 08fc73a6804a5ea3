"""Removal of repeated passages with suffix arrays, sharded by content.

A byte goes when it is covered by a ``least``-byte string that also starts anywhere else.

Sharding. Every ``least``-byte window has one anchor: the leftmost smallest hash among its
``GRAM``-byte substrings. Equal windows have equal anchors at equal offsets, so windows
need only be compared with windows of the same anchor content. The run of windows that
share an anchor position, with the bytes they cover, is a context. Equal contexts are
counted first (map-side), and only anchors that occur twice or more go on, each distinct
context once. Contexts are dealt by anchor content into shards of about ``SHARD_BYTES``.

Suffix sorting. A shard's contexts lie in one text. Suffixes that are smaller than their
successor are sorted directly; the others follow from them by one scan over the buckets of
the first byte (a suffix's predecessor goes to the next place of its own bucket). Windows
whose common prefix with a neighbour in the suffix array reaches ``least`` bytes repeat;
so do all windows of a context that was counted twice.

Hot anchors. An anchor with more than ``HOT_CONTEXTS`` distinct contexts would make one
shard too large. Its windows are dealt out singly by their own 128-bit content hash.

Edge cases: null texts are empty; texts shorter than ``least`` bytes stay; repeated rows
are copies of each other; a null id is an id; an empty table gives an empty result; extra
columns are ignored. Removal may cut a character, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.common import fitting_broadcast, staged, text_or_empty

LEAST = 400
GRAM = 16                      # a power of two
CHUNK_BYTES = 4 << 20
SHARD_BYTES = 1 << 20
HOT_CONTEXTS = 4096
SLICE = 8 << 20
_rng = np.random.default_rng(20240301)
TABLES = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base % 2**64))
    out[0] = 1
    return np.multiply.accumulate(out)


class RangeHash:
    """Hash of any byte range of a text, from sums of byte values times powers."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLES[which][data] * _powers(base, len(data))[:-1], out=self.sums[1:])
        self.back = _powers(pow(base, -1, 2**64), len(data))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


# ---------------------------------------------------------------- anchors
def find_anchors(data: np.ndarray, ends: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Contexts of all texts: text number, start in the text, bytes, anchor offset, and the
    hashes of anchor (fp) and context (ctx)."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    long = ends - starts >= least
    none = np.zeros(0, np.int64)
    if not long.any():
        return {"text": none, "start": none, "size": none, "off": none, "fp": none, "ctx": none}
    h, step = TABLES[0][data], 1
    for level in range(GRAM.bit_length() - 1):
        h = h[:-step] * np.uint64((BASES[0] * (2 * level + 3)) % 2**64 | 1) + h[step:]
        step *= 2
    h = mix(h)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width = least - GRAM + 1
    padded = np.full(-(-len(key) // width) * width, np.uint64(2**64 - 1))
    padded[:len(key)] = key
    blocks = padded.reshape(-1, width)
    n = len(data) - least + 1
    head = np.minimum.accumulate(blocks, axis=1).reshape(-1)[width - 1:width - 1 + n]
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:n]
    at = (np.minimum(head, tail) & np.uint64(0xFFFFFFFF)).astype(np.int64)   # leftmost smallest
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - least + 1, -1)
    inside = np.cumsum(change[:n]) > 0
    new = inside.copy()
    new[1:] &= at[1:] != at[:-1]
    new[starts[long]] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(ends, first, side="right")
    last = np.minimum(np.append(first[1:], n) - 1, ends[text] - least)
    end = last + least
    off = at[first] - first
    ctx = mix(RangeHash(data)(first, end) + mix(off.astype(np.uint64) + np.uint64(77)))
    return {"text": text, "start": first - starts[text], "size": end - first, "off": off,
            "fp": h[at[first]].view(np.int64), "ctx": ctx.view(np.int64)}


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, ends) of runs of about CHUNK_BYTES; at least one row."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1))
        yield a, b - a, data[offsets[a]:offsets[b]], offsets[a + 1:b + 1] - offsets[a]
        a = b


def anchor_rows(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, tk, start, size, off, fp, ctx of rows (doc_id, tk, text)."""
    names = ["doc_id", "tk", "start", "size", "off", "fp", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, ends in _chunks(batch.column(2)):
                found = find_anchors(data, ends, least)
                who = pa.array(found["text"] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(who), batch.column(1).take(who), pa.array(found["start"]),
                     pa.array(found["size"].astype(np.int32)), pa.array(found["off"].astype(np.int32)),
                     pa.array(found["fp"]), pa.array(found["ctx"])], names)

    return rows.mapInArrow(run, "doc_id long, tk long, start long, size int, off int, fp long, ctx long")


# ---------------------------------------------------------------- suffix sorting
def _sort_direct(at: np.ndarray, key8: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` bytes, eight at a time; a group of
    ties is only sorted again where its next eight bytes differ."""
    k = key8[at]
    order = np.argsort(k, kind="stable")
    at, k = at[order], k[order]
    tied = np.append(False, k[1:] == k[:-1])
    for d in range(8, depth, 8):
        near = tied.copy()
        near[:-1] |= tied[1:]
        idx = np.flatnonzero(near)
        if not len(idx):
            break
        k, inner = key8[at[idx] + min(d, depth - 8)], tied[idx]
        differs = inner & np.append(False, k[1:] != k[:-1])
        if not differs.any():
            continue
        group = np.cumsum(~inner) - 1
        open_ = np.zeros(group[-1] + 1, bool)
        open_[group[differs]] = True
        pick = np.flatnonzero(open_[group])
        order = pick[np.lexsort((k[pick], group[pick]))]
        at[idx[pick]] = at[idx[order]]
        tied[idx[pick]] = np.append(False, (group[order][1:] == group[order][:-1]) & (k[order][1:] == k[order][:-1]))
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(wanted positions in the order of their suffixes, to at least ``depth`` bytes; the
    eight bytes at each position as a number).

    Two stages: a suffix smaller than its successor is sorted directly, any other one is
    induced from its successor; ``text`` ends in at least ``depth`` + 8 zero bytes.
    """
    n = len(text)
    key8 = np.zeros(n, np.uint64)
    for j in range(8):
        key8[:n - 7] |= text[j:n - 7 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    # the first later byte that differs decides the type
    differs = np.flatnonzero(text[1:] != text[:-1])
    nxt = np.full(n, n - 1)
    if len(differs):
        k = np.searchsorted(differs, np.arange(n))
        nxt = np.where(k < len(differs), differs[np.minimum(k, len(differs) - 1)] + 1, n - 1)
    smaller = text < text[nxt]                       # smaller than the successor
    # a suffix that is induced needs its successor, up to the next directly sorted one
    needed = np.zeros(n + 1, np.int32)
    direct_at = np.flatnonzero(smaller)
    stop = np.searchsorted(direct_at, wanted)
    stop = np.where(stop < len(direct_at), direct_at[np.minimum(stop, max(len(direct_at) - 1, 0))], n - 1) \
        if len(direct_at) else np.full(len(wanted), n - 1)
    np.add.at(needed, wanted, 1)
    np.add.at(needed, stop + 1, -1)
    needed = np.cumsum(needed[:n]) > 0
    direct = _sort_direct(np.flatnonzero(needed & smaller), key8, depth)
    heads = np.searchsorted(text[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    if needed[n - 1] and not smaller[n - 1]:
        pending[text[n - 1]].append(np.array([n - 1]))
    induced = needed & ~smaller
    out = []

    def pass_on(part: np.ndarray) -> np.ndarray:
        """Deals the induced predecessors of sorted suffixes to their buckets."""
        before = part[part > 0] - 1
        before = before[induced[before]]
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for piece in np.split(before, cuts) if len(before) else ():
            pending[text[piece[0]]].append(piece)

    for c in range(256):
        done = 0
        while done < len(pending[c]):                # runs of one byte induce into their own bucket
            part = pending[c][done]
            done += 1
            out.append(part)
            pass_on(part)
        part = direct[heads[c]:heads[c + 1]]
        out.append(part)
        pass_on(part)
        pending[c] = []
    order = np.concatenate(out)
    is_wanted = np.zeros(n, bool)
    is_wanted[wanted] = True
    return order[is_wanted[order]], key8


def repeated_windows(text: np.ndarray, wanted: np.ndarray, least: int) -> np.ndarray:
    """Of the wanted positions (ascending), which share ``least`` bytes with another one:
    those whose common prefix with a neighbour in the suffix array is that long."""
    order, key8 = suffix_order(text, wanted, least)
    here, there = order[1:], order[:-1]
    maybe = (key8[here] == key8[there]) & (key8[here + least - 8] == key8[there + least - 8])
    here, there = here[maybe], there[maybe]
    by = np.argsort(here)
    here, shift = here[by], (here - there)[by]
    again = np.zeros(len(text), bool)
    # neighbours at one distance for a run of positions: their bytes are compared once
    cut = np.flatnonzero((np.diff(here) != 1) | (np.diff(shift) != 0)) + 1
    first = np.concatenate(([0], cut)).astype(np.int64) if len(here) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(here)))
    size = count + least - 1
    part = np.cumsum(size) // SLICE
    for p in np.unique(part):
        runs = np.flatnonzero(part == p)
        ends = np.cumsum(size[runs])
        base = ends - size[runs]
        idx = np.arange(ends[-1]) + np.repeat(here[first[runs]] - base, size[runs])
        other = idx - np.repeat(shift[first[runs]], size[runs])
        wrong = np.append(0, np.cumsum(text[idx] != text[other]))
        k = np.arange(count[runs].sum()) - np.repeat(np.cumsum(count[runs]) - count[runs], count[runs])
        at = np.repeat(base, count[runs]) + k
        ok = wrong[at + least] == wrong[at]
        member = np.repeat(first[runs], count[runs]) + k
        again[here[member[ok]]] = True
        again[here[member[ok]] - shift[member[ok]]] = True
    return again[wanted]


def _runs(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Byte ranges covered by flagged windows, joined where they touch."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > least)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + least).tolist()))


# ---------------------------------------------------------------- Spark side
SPANS = "fp long, ctx long, spans array<struct<start:int,end:int>>"


def _shard(least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["body"].map(len).to_numpy()
        text = np.frombuffer(b"".join(pdf["body"]) + bytes(least + 8), np.uint8)
        base = np.cumsum(sizes) - sizes
        windows = sizes - least + 1
        first = np.cumsum(windows) - windows
        wanted = np.arange(windows.sum()) + np.repeat(base - first, windows)
        again = repeated_windows(text, wanted, least) | np.repeat(pdf["n"].to_numpy() > 1, windows)
        spans = [_runs(again[a:a + w], least) for a, w in zip(first, windows)]
        return pd.DataFrame({"fp": pdf["fp"], "ctx": pdf["ctx"],
                             "spans": [[{"start": a, "end": b} for a, b in s] for s in spans]})
    return run


def _bodies(rows: DataFrame) -> DataFrame:
    """fp, ctx, n, off, hot, body: the bytes of the contexts listed for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(0).to_pylist()):
                asked = batch.column(1)[i].values
                flat = {k: asked.field(k) for k in ("fp", "ctx", "n", "off", "hot")}
                at = zip(asked.field("start").to_pylist(), asked.field("size").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*flat.values(), pa.array([text[a:a + z] for a, z in at], pa.binary())], [*flat, "body"])

    return rows.mapInArrow(run, "fp long, ctx long, n long, off int, hot boolean, body binary")


def _single_windows(rows: DataFrame, least: int) -> DataFrame:
    """fp, ctx, n, place, h1, h2: every window of hot contexts, by offset and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            for i, body in enumerate(cols["body"]):
                data = np.frombuffer(body, np.uint8)
                start = np.arange(len(data) - least + 1)
                h = [RangeHash(data, w)(start, start + least).view(np.int64) for w in (0, 1)]
                k = len(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, cols["fp"][i])), pa.array(np.full(k, cols["ctx"][i])),
                     pa.array(np.full(k, cols["n"][i])), pa.array(start.astype(np.int32)),
                     pa.array(h[0]), pa.array(h[1])], ["fp", "ctx", "n", "place", "h1", "h2"])

    return (rows.select("fp", "ctx", "n", "body")
            .mapInArrow(run, "fp long, ctx long, n long, place int, h1 long, h2 long"))


def _hot_spans(rows: DataFrame, least: int) -> DataFrame:
    one = _single_windows(rows, least)
    often = (one.groupBy("fp", "h1", "h2").agg(F.sum("n").alias("total")).where("total > 1")
             .select("fp", "h1", "h2"))
    return (one.join(often, ["fp", "h1", "h2"]).groupBy("fp", "ctx")
            .agg(F.collect_list(F.struct(F.col("place").alias("start"), (F.col("place") + least).alias("end")))
                 .alias("spans")))


def _cut(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (joined), kept of rows (doc_id, body, spans)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def one(body: bytes, spans: list[dict]) -> tuple[list[dict], bytes]:
        joined: list[list[int]] = []
        for a, b in sorted((s["start"], s["end"]) for s in spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        kept, at = [], 0
        for a, b in joined:
            kept.append(body[at:a])
            at = b
        return [{"start": a, "end": b} for a, b in joined], b"".join([*kept, body[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            made = [one(b, s) for b, s in zip(bodies, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, bodies)), pa.int64()),
                 pa.array([s for s, _ in made], kind), pa.array([k for _, k in made], pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def remove_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                   shard_bytes: int = SHARD_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges), kept (binary) of every row."""
    if least < GRAM or least % 8:
        raise ValueError(f"least must be a multiple of 8 and at least {GRAM}")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"))
    key = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tk"] == b["tk"])
    anchors = staged(anchor_rows(rows, least), "anchors")

    # equal contexts are counted before they meet; anchors that occur once are done
    contexts = staged(anchors.groupBy("fp", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tk", "start", "size", "off")).alias("r")), "contexts")
    twice = (contexts.groupBy("fp").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
             .where("total > 1").select("fp", (F.col("kinds") > hot_contexts).alias("hot")))
    asked = staged(contexts.join(twice, "fp").select("fp", "ctx", "n", "hot", "r.*"), "asked")
    total = asked.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    # one representative of each context brings the bytes
    by_doc = staged(asked.groupBy("doc_id", "tk").agg(
        F.collect_list(F.struct("fp", "ctx", "n", "off", "hot", "start", "size")).alias("asked")), "by_doc")
    wanted = fitting_broadcast(by_doc.select("doc_id", "tk"), by_doc.count(), 40)
    texts = rows.join(wanted, key(rows, wanted), "left_semi").dropDuplicates(["doc_id", "tk"])
    bodies = staged(_bodies(texts.join(by_doc, key(texts, by_doc))
                            .select(F.col("text").cast("binary").alias("body"), "asked")), "bodies")
    even = (bodies.where("not hot").select("fp", "ctx", "n", "body",
                                           F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard"))
            .groupBy("shard").applyInPandas(_shard(least), SPANS))
    spans = staged(even.unionByName(_hot_spans(bodies.where("hot"), least)).where(F.size("spans") > 0), "spans")

    # back to every text that has the context
    found = anchors.join(spans, ["fp", "ctx"]).select(
        "doc_id", "tk", F.explode(F.transform("spans", lambda s: F.struct(
            (F.col("start") + s["start"]).alias("start"), (F.col("start") + s["end"]).alias("end")))).alias("s"))
    per_doc = staged(found.groupBy("doc_id", "tk").agg(F.collect_set("s").alias("spans")), "per_doc")
    n = per_doc.count()
    touched = fitting_broadcast(per_doc.select("doc_id", "tk"), n, 40)
    clean = rows.join(touched, key(rows, touched), "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"))
    hit = rows.join(touched, key(rows, touched), "left_semi")
    return clean.unionByName(_cut(hit.join(per_doc, key(hit, per_doc)).select(
        hit["doc_id"], F.col("text").cast("binary").alias("body"), "spans")))
