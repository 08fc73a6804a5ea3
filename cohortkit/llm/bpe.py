"""Byte-level BPE encoding and decoding with an index of pair occurrences.

Texts are cut into pieces by the vocabulary's split pattern; merges never cross pieces, so
a task encodes each distinct piece of a chunk once. The symbols of all those pieces lie in
one array. An index maps each pair that some rank can merge to all its positions. The
active ranks are taken in ascending order; a rank merges all its positions at once, and
only the pairs beside a merged position change, so only their lists are updated. A worker
keeps the ids of the pieces it has met, up to a bound, for the chunks that follow.

The vocabulary (a fixed file, some MB) is read by the driver and broadcast. There is no
shuffle; a chunk bounds what a task holds beside the Arrow batch.

Edge cases: null is the empty text, which has no ids; strings of added tokens become their
ids; ids without a token and invalid byte sequences decode to U+FFFD or to nothing as the
public library does; repeated rows and extra columns pass through; an empty table is empty.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortkit.llm.common import small_batches

CHUNK_CHARS = 1 << 20
PIECES_AT_ONCE = 1 << 18
MET_PIECES, MET_CHARS = 400_000, 8 << 20   # a worker forgets its pieces beyond either
ROWS_AT_ONCE = 1000                        # rows of a batch that are Python strings at a time
IDS_AT_ONCE = 1 << 18                      # ids whose bytes are looked up together
# The split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SMALL = 0x3000                # texts below this code point use a bitmap pattern


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merge table, token bytes and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("byte_fallback") \
                or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.new = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = self.left << 32 | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.byte_ids = np.array([ids[c] for c in chars], np.int32)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.tokens[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.tokens[i] = token.encode()
        self.met = MetPieces()


# ---------------------------------------------------------------- splitting
@lru_cache(maxsize=1)
def _splitters() -> tuple:
    """(finds code points from SMALL on, pattern for texts without them, general splitter).

    Which code points are letters or numbers depends on the Unicode version, so the
    pattern's classes are asked of the public splitter; it also cuts the other texts."""
    from tokenizers.pre_tokenizers import ByteLevel
    general = ByteLevel(add_prefix_space=False, use_regex=True)

    def joins(c: str, with_: str) -> bool:
        return len(general.pre_tokenize_str(with_ + c + with_)) == 1

    def ranges(test: Callable[[str], bool]) -> str:
        points = [c for c in range(SMALL) if test(chr(c))]
        cuts = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
        runs = zip([0, *cuts], [*cuts, len(points)])
        return "".join(f"\\u{points[i]:04x}-\\u{points[j - 1]:04x}" for i, j in runs)

    letter, number = ranges(lambda c: joins(c, "a")), ranges(lambda c: joins(c, "1"))
    space = ranges(lambda c: not any(joins(c, w) for w in "a1!"))
    plain = (PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
             .replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
             .replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))
    return re.compile(f"[\\u{SMALL:04x}-\\U0010ffff]"), re.compile(plain), general


def split_pieces(text: str) -> Iterator[list[str]]:
    """Lists of pieces, in order."""
    large, plain, general = _splitters()
    if large.search(text):
        yield [text[a:b] for _, (a, b) in general.pre_tokenize_str(text)]
    elif len(text) < PIECES_AT_ONCE:
        yield plain.findall(text)
    else:
        found = (m.group() for m in plain.finditer(text))
        while part := list(islice(found, PIECES_AT_ONCE)):
            yield part


# ---------------------------------------------------------------- merging
class PairIndex:
    """Symbols of many pieces as linked lists, and rank -> positions of its pair."""

    def __init__(self, vocab: Vocabulary, pieces: list[bytes]):
        self.v = vocab
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.symbol = vocab.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(self.symbol)
        ends = np.cumsum(self.sizes)
        self.after = np.arange(1, n + 1, dtype=np.int32)
        self.before = np.arange(-1, n - 1, dtype=np.int32)
        some = self.sizes > 0
        self.after[ends[some] - 1] = -1
        self.before[(ends - self.sizes)[some]] = -1
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.insert(np.flatnonzero(self.after >= 0).astype(np.int32))

    def insert(self, at: np.ndarray) -> None:
        """Add positions of pairs to the lists of their ranks."""
        keys = self.symbol[at].astype(np.int64) << 32 | self.symbol[self.after[at]]
        k = np.searchsorted(self.v.keys, keys)
        k[k == len(self.v.keys)] = 0
        known = self.v.keys[k] == keys
        at, ranks = at[known], self.v.ranks[k[known]]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.active, rank)
            self.lists[rank].append(part)

    def merge_all(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each piece has."""
        symbol, after, before = self.symbol, self.after, self.before
        while self.active:
            rank = heapq.heappop(self.active)
            parts = self.lists.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.v.left[rank], self.v.right[rank]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # in a run of one symbol every second pair goes
                at = np.sort(at)
                chained = np.concatenate(([False], at[1:] == after[at[:-1]]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.v.new[rank]
            symbol[gone] = -1
            follow = after[gone]
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            ahead = before[at]
            self.insert(np.unique(np.concatenate((ahead[ahead >= 0], at[has]))))
        alive = symbol >= 0
        total = np.concatenate(([0], np.cumsum(alive)))
        ends = np.cumsum(self.sizes)
        return symbol[alive], total[ends] - total[ends - self.sizes]


class Codes(dict):
    """Numbers keys in the order of their first lookup."""

    def __missing__(self, key: str) -> int:
        self[key] = code = len(self)
        return code


class MetPieces:
    """Ids of the pieces met so far; a piece's code tells where its ids lie."""

    def __init__(self):
        self.codes = Codes()
        self.chars = 0
        self.ids = np.zeros(0, np.int32)
        self.counts = np.zeros(0, np.int64)

    def learn(self, vocab: Vocabulary, specials: dict[int, int]) -> None:
        """Encode the pieces that got a code since the last call; ``specials``: codes that
        stand for an added token, with its id."""
        fresh = list(islice(self.codes, len(self.counts), None))
        if not fresh:
            return
        first = len(self.counts)
        raw = [b"" if first + i in specials else key.encode() for i, key in enumerate(fresh)]
        ids, counts = PairIndex(vocab, raw).merge_all()
        for code in sorted(c for c in specials if c >= first):
            at = code - first
            ids = np.insert(ids, int(counts[:at].sum()), specials[code])
            counts[at] = 1
        self.chars += sum(map(len, fresh))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.counts = np.concatenate((self.counts, counts))

    @property
    def full(self) -> bool:
        return len(self.codes) > MET_PIECES or self.chars > MET_CHARS


def encode_texts(vocab: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text)."""
    added = (re.compile("(" + "|".join(map(re.escape, sorted(vocab.added, key=len, reverse=True))) + ")")
             if vocab.added else None)
    met = vocab.met
    code_of = met.codes.__getitem__
    runs: list[np.ndarray] = []
    per_text = np.zeros(len(texts), np.int64)
    specials: dict[int, int] = {}
    for i, text in enumerate(texts):
        for j, part in enumerate(added.split(text) if added and added.search(text) else [text]):
            if j % 2:
                code = code_of("\0added" + part)
                specials[code] = vocab.added[part]
                runs.append(np.array([code], np.int32))
                per_text[i] += 1
                continue
            for pieces in split_pieces(part):
                run = np.fromiter(map(code_of, pieces), np.int32, len(pieces))
                runs.append(run)
                per_text[i] += len(run)
    met.learn(vocab, specials)
    ids, counts = met.ids, met.counts
    starts = np.cumsum(counts) - counts
    if met.full:
        vocab.met = MetPieces()
    flat = np.concatenate(runs) if runs else np.zeros(0, np.int32)
    sizes = counts[flat]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    take = np.repeat(starts[flat] - (ends - sizes), sizes) + np.arange(total)
    bounds = np.concatenate(([0], ends))
    text_ends = np.cumsum(per_text)
    return ids[take], bounds[text_ends] - bounds[text_ends - per_text]


class TokenBytes:
    """The bytes of all tokens one after the other; a last empty token stands for ids without one."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, [*tokens, b""]), np.int64, len(tokens) + 1)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, where each id's bytes begin, and the end)."""
        last = len(self.size) - 1
        ids = np.where((ids >= 0) & (ids < last), ids, last)
        bounds = np.concatenate(([0], np.cumsum(self.size[ids])))
        out = np.empty(int(bounds[-1]), np.uint8)
        for a in range(0, len(ids), IDS_AT_ONCE):
            part = ids[a:a + IDS_AT_ONCE]
            first, size = int(bounds[a]), self.size[part]
            total = int(size.sum())
            place = np.repeat(self.start[part] - (bounds[a:a + len(part)] - first), size) + np.arange(total)
            out[first:first + total] = self.data[place]
        return out, bounds


def decode_texts(tokens: TokenBytes, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts whose ids lie between neighbouring ``ends``."""
    data, bounds = tokens.join(ids[ends[0]:ends[-1]])
    at = bounds[ends - ends[0]]
    texts = pa.Array.from_buffers(pa.string(), len(at) - 1,
                                  [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:      # some text is no UTF-8
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.string())


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    return decode_texts(TokenBytes(vocab.tokens), np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


# ---------------------------------------------------------------- Spark side
def _strings(column: pa.Array) -> Iterator[str | None]:
    for a in range(0, len(column), ROWS_AT_ONCE):
        yield from column.slice(a, ROWS_AT_ONCE).to_pylist()


def _chunks(texts: Iterable[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        if part and held + len(t or "") > most:
            yield part
            part, held = [], 0
        part.append(t or "")
        held += len(t or "")
    if part:
        yield part


def _kept(df: DataFrame, *dropped: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in dropped]


def _encoder(vocab: Broadcast, names: list[str], text_col: str, out: str):
    """Batches with ``names`` and the text -> batches with ``names`` and the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            column = batch.column(batch.schema.get_field_index(text_col))
            rest = batch.select(names)
            for texts in _chunks(_strings(column)):
                ids, counts = encode_texts(vocab.value, texts)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                arrays = rest.slice(at, len(texts)).columns
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [*names, out])
    return run


def encode(df: DataFrame, vocab_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` without the text column and with an array<int> column of ids."""
    spark = df.sparkSession
    small_batches(spark)
    vocab = spark.sparkContext.broadcast(Vocabulary(vocab_path))
    keep = _kept(df, text_col, out)
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.select(*names, text_col).mapInArrow(_encoder(vocab, names, text_col, out), schema)


def _runs(ends: np.ndarray, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, one past the last) of about ``most`` ids, one row at least."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, min(b, len(ends) - 1)
        a = b


def _decoder(tokens: Broadcast, names: list[str], ids_col: str, out: str):
    """Batches with ``names`` and the ids -> batches with ``names`` and the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            ids = column.values.fill_null(-1).to_numpy()
            ends = column.offsets.to_numpy().astype(np.int64)
            rest = batch.select(names)
            for a, b in _runs(ends):
                texts = decode_texts(tokens.value, ids, ends[a:b + 1])
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, texts], [*names, out])
    return run


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", out: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """``df`` with the decoded text (null ids: empty text); the ids stay only with ``keep_ids``."""
    tokens = df.sparkSession.sparkContext.broadcast(TokenBytes(Vocabulary(vocab_path).tokens))
    keep = _kept(df, out, *([] if keep_ids else [ids_col]))
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(out, T.StringType())])
    return df.select(*dict.fromkeys([*names, ids_col])).mapInArrow(_decoder(tokens, names, ids_col, out), schema)


def encode_decode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """What ``decode`` makes of ``encode``'s rows, ids kept: the text column is the text decoded
    from the ids. Both run in one Python worker, chunk by chunk; as two steps of one stage every
    task has two workers, and the ids pass through the JVM between them."""
    spark = df.sparkSession
    small_batches(spark)
    vocabulary = Vocabulary(vocab_path)
    vocab = spark.sparkContext.broadcast(vocabulary)
    tokens = spark.sparkContext.broadcast(TokenBytes(vocabulary.tokens))
    keep = _kept(df, text_col, ids_col)
    names = [f.name for f in keep]
    to_ids = _encoder(vocab, names, text_col, ids_col)
    to_text = _decoder(tokens, [*names, ids_col], ids_col, text_col)
    schema = T.StructType([*keep, T.StructField(ids_col, T.ArrayType(T.IntegerType())),
                           T.StructField(text_col, T.StringType())])
    return df.select(*names, text_col).mapInArrow(lambda batches: to_text(to_ids(batches)), schema)
