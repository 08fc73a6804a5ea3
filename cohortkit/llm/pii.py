"""Personal data spans by weak supervision.

Base spans come from exact patterns and always stay. Around them, wider candidate patterns
propose further spans (addresses with letters beyond ASCII or written with "(at)", numbers
without a plus sign or of other lengths, secrets after a keyword). Five labelers vote on
each candidate (for, against or not at all): the strict pattern, a check of digits and
shape, a gazetteer, the words around it, and its edges. Expectation-maximisation (one
two-class model per kind) estimates the labelers' reliabilities and each vote pattern's
probability; these soft labels train the final span classifier, a logistic model over
votes, kind and length. The base spans are candidates too: their votes count for EM and the
fit. Candidates the classifier accepts, and that lie in no base span, are added.

The texts are read once, by a map without shuffle. Voting patterns are counted map-side;
there are at most ``kinds * 3**labelers * lengths`` of them, so EM and the fit run on a
table of fixed size however many texts there are.

Edge cases: null and empty texts have no spans; a failing match is dropped and not tried
again from within; repeated rows give repeated results; an empty table is empty; a table
without candidates adds nothing; columns named base, added, candidates and known are
replaced, others pass through. Wider forms have bounds: an address is proposed with the last
64 characters before its @, a secret with 16 to 128. Candidates are looked up among the base
spans by binary search, so a text of very many spans takes time in proportion.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortkit.llm.common import staged

KINDS = ("email", "ip", "card", "phone", "secret")     # base spans are of the first four
LABELERS = ("pattern", "shape", "gazetteer", "context", "edges")
LENGTHS = (8, 12, 16, 20, 32, 64)                      # bounds of the length classes
ACCEPT = 0.5
CONTEXT = 24                                           # characters looked at on either side

# The base patterns.
LOCAL = r"[A-Za-z0-9._%+-]"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_RUN = re.compile(f"{LOCAL}+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Wider forms, each of bounded length.
WIDE_DOMAIN = re.compile(r"[\w-]{1,63}(?:\.[\w-]{1,63}){1,6}")
WIDE_LOCAL = re.compile(r"[\w.%+-]{1,64}\Z")
SPELLED = re.compile(r"[\w.+-]{1,64}\s?[\[(]\s?(?:at|AT)\s?[\])]\s?[\w-]{1,63}"
                     r"(?:(?:\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\.)[\w-]{1,63}){1,4}")
NUMBER = re.compile(r"(?<![\w+.-])\(?[0-9]{1,19}(?:[)\x20./-]{1,2}[0-9]{1,19}){0,6}(?![\w-])")
SECRET = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{16,128}(?![\w+/=-])")

# Gazetteers.
TOP_DOMAINS = frozenset("com net org edu gov mil int info biz io de fr es it uk eu at ch nl be pt pl ru cn jp us ca "
                        "au br mx in".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46",
                 "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81",
                 "82", "84", "86", "90", "91")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35")
NEAR = {
    "email": re.compile(r"(?i)e-?mail|mail|correo|courriel|contact|kontakt|write to|@"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server|login|adresse"),
    "card": re.compile(r"(?i)card|visa|master|amex|karte|carte|tarjeta|payment"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax|ruf|handy|llame|appel|portable|m[oó]vil"),
    "secret": re.compile(r"(?i)token|secret|passw|api.?key|\bkey\b|credential|bearer"),
}
FAR = re.compile(r"(?i)version|isbn|issn|\bno\.|\bnr\.|page|seite|copyright|license|\$|€|£|%|http|www|sha|commit")


# ---------------------------------------------------------------- base spans
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from the @ signs, so that
    long runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text)
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- candidates and votes
def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    at = text.find("@")
    while at >= 0:
        left = WIDE_LOCAL.search(text[max(0, at - 64):at])
        right = WIDE_DOMAIN.match(text, at + 1)
        if left and right:
            yield "email", at - len(left.group()), right.end()
        at = text.find("@", at + 1)
    if "(at" in text or "[at" in text or "( at" in text or "[ at" in text or "(AT" in text or "[AT" in text:
        for m in SPELLED.finditer(text):
            yield "email", *m.span()
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            n = len(_digits(m.group()))
            if n >= 7:
                dots = m.group().count(".")
                yield ("ip" if dots == 3 and " " not in m.group() else "card" if n >= 13 else "phone"), *m.span()
        for m in SECRET.finditer(text):
            s = m.group()
            if DIGIT.search(s) and not s.isdecimal() and any(c.isalpha() for c in s):
                yield "secret", *m.span()


class Spans:
    """Spans by start, so that a lookup is a binary search; of one kind none overlap."""

    def __init__(self, base: list[tuple[str, int, int]]):
        self.kinds: dict[str, tuple[list[int], list[int]]] = {}
        for kind, a, b in base:
            starts, ends = self.kinds.setdefault(kind, ([], []))
            starts.append(a)
            ends.append(b)

    def overlaps(self, kind: str, start: int, end: int) -> bool:
        starts, ends = self.kinds.get(kind, ((), ()))
        i = bisect_left(starts, end) - 1           # the last span that starts before the end
        return i >= 0 and ends[i] > start

    def contains(self, start: int, end: int) -> bool:
        """Whether one span of any kind holds all of it."""
        for starts, ends in self.kinds.values():
            i = bisect_right(starts, start) - 1
            if i >= 0 and ends[i] >= end:
                return True
        return False


def votes(kind: str, start: int, end: int, text: str, base: Spans) -> tuple[int, ...]:
    """One vote per labeler: 1, -1 or 0."""
    s = text[start:end]
    d = _digits(s)
    pattern = 1 if base.overlaps(kind, start, end) else 0
    if kind == "email":
        domain = s.rsplit("@", 1)[-1]
        shape = 1 if "@" in s and "." in domain and not domain.endswith((".", "-")) else 0
        gazetteer = 1 if re.split(r"[.\s)\]]+", s.lower())[-1] in TOP_DOMAINS else -1
    elif kind == "ip":
        parts = [p for p in s.split(".") if p.isdecimal()]
        shape = 1 if len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if s.startswith(("0.", "10.", "127.", "192.168.", "255.")) else 0
    elif kind == "card":
        shape = 1 if 13 <= len(d) <= 19 and luhn(d) else -1
        gazetteer = 1 if d.startswith(ISSUERS) else -1
    elif kind == "phone":
        shape = (1 if re.search(r"[()\x20-]", s) and 9 <= len(d) <= 13 else 0) if len(set(d)) > 2 else -1
        gazetteer = 1 if s.startswith("(") or d.startswith(("00", *("0" + c for c in CALLING_CODES[:9]))) else -1
    else:
        kinds = sum((any(c.isdigit() for c in s), any(c.islower() for c in s), any(c.isupper() for c in s)))
        shape = 1 if len(s) >= 20 and kinds >= 2 and len(set(s)) >= 8 else -1
        gazetteer = 1 if re.fullmatch(r"(?:[0-9a-f]{2}){8,64}|(?:sk|pk|gh[pousr]|xox[abp]|AKIA)[-_]?\w+", s) else 0
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    context = 1 if NEAR[kind].search(before) or (kind != "email" and NEAR[kind].search(after)) else 0
    if FAR.search(before):
        context -= 1
    edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    tabular = before.rstrip()[-1:] in ("|", "/", "=", "-") or after.lstrip()[:1] in ("|", "/", "=")
    return pattern, shape, gazetteer, context, -1 if not edge else (0 if tabular else 1)


def pattern_code(kind: str, given: tuple[int, ...], size: int) -> int:
    """Kind, votes and length class as one number."""
    code = KINDS.index(kind)
    for v in given:
        code = code * 3 + v + 1
    return code * (len(LENGTHS) + 1) + int(np.searchsorted(LENGTHS, size))


def read_code(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes (n, labelers), length class)."""
    code, length = np.divmod(np.asarray(code, np.int64), len(LENGTHS) + 1)
    given = np.empty((len(code), len(LABELERS)), np.int64)
    for j in range(len(LABELERS) - 1, -1, -1):
        code, v = np.divmod(code, 3)
        given[:, j] = v - 1
    return code, given, length


def find_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` without the text, with base (kind, start, end), candidates outside the base
    spans (also code) and ``known``, the codes of the base spans."""
    keep = [f for f in df.schema.fields if f.name not in (text_col, "base", "candidates", "known")]
    names = [f.name for f in keep]
    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    base_type, cand_type = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("code", pa.int32())]))

    def one(text: str) -> tuple[list[dict], list[dict], list[int]]:
        base = base_spans(text)
        held = Spans(base)
        code = lambda kind, a, b: pattern_code(kind, votes(kind, a, b, text, held), b - a)
        found = []
        for kind, a, b in dict.fromkeys(candidates(text)):
            if not held.contains(a, b):
                found.append({"kind": kind, "start": a, "end": b, "code": code(kind, a, b)})
        return [{"kind": k, "start": a, "end": b} for k, a, b in base], found, [code(*s) for s in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(t or "") for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([b for b, _, _ in made], base_type),
                 pa.array([c for _, c, _ in made], cand_type),
                 pa.array([k for _, _, k in made], pa.list_(pa.int32()))], [*names, "base", "candidates", "known"])

    fields = [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
              T.StructField("end", T.LongType())]
    schema = T.StructType([*keep, T.StructField("base", T.ArrayType(T.StructType(fields))),
                           T.StructField("candidates", T.ArrayType(T.StructType(
                               [*fields, T.StructField("code", T.IntegerType())]))),
                           T.StructField("known", T.ArrayType(T.IntegerType()))])
    return df.select(*names, text_col).mapInArrow(run, schema)


# ---------------------------------------------------------------- learning
def em_posteriors(kind: np.ndarray, given: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(personal data) of each vote pattern: per kind, a two-class model whose labelers
    vote independently given the class; pseudo-counts favour labelers that are right."""
    p = 1 / (1 + np.exp(-1.5 * given.sum(axis=1)))       # start: the majority
    value = (given + 1)[:, :, None] == np.arange(3)
    for k in np.unique(kind):
        rows = kind == k
        w, v = n[rows].astype(float), value[rows]
        prior = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])  # of -1, 0, 1 given no, yes
        for _ in range(rounds):
            post = np.stack([1 - p[rows], p[rows]])
            share = (post * w).sum(axis=1) + 1.0
            table = np.einsum("cp,plv->clv", post * w, v) + prior[:, None]
            table /= table.sum(axis=2, keepdims=True)
            score = np.einsum("plv,clv->cp", v, np.log(table)) + np.log(share / share.sum())[:, None]
            p[rows] = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return p


def _design(kind: np.ndarray, given: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(kind)), given == 1, given == -1, kind[:, None] == np.arange(len(KINDS)),
                            length[:, None] == np.arange(len(LENGTHS) + 1)]).astype(float)


def fit_classifier(x: np.ndarray, soft: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights from soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w)),
                               x.T @ (n * (soft - p)) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def accepted_codes(found: DataFrame, kinds: tuple[str, ...] = KINDS) -> list[int]:
    counts = (found.select(F.explode(F.concat("candidates.code", "known")).alias("code")).groupBy("code")
              .agg(F.count(F.lit(1)).alias("n")).toPandas())
    if not len(counts):
        return []
    kind, given, length = read_code(counts["code"].to_numpy())
    n = counts["n"].to_numpy(float)
    soft = em_posteriors(kind, given, n)
    x = _design(kind, given, length)
    p = 1 / (1 + np.exp(-x @ fit_classifier(x, soft, n)))
    wanted = np.isin(kind, [KINDS.index(k) for k in kinds])
    return sorted(counts["code"][(p >= ACCEPT) & wanted].astype(int).tolist())


def personal_data(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` without the text, with base and added spans (kind, start, end); added ones
    are of the given kinds (without ``secret``: personal data in the narrow sense)."""
    found = staged(find_spans(docs, text_col), "spans")
    codes = F.array(*[F.lit(c) for c in accepted_codes(found, kinds)]).cast("array<int>")
    chosen = F.filter("candidates", lambda c: F.array_contains(codes, c["code"]))
    added = F.transform(chosen, lambda c: F.struct(c["kind"], c["start"], c["end"]))
    return found.withColumn("added", added).drop("candidates", "known")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    order = F.transform(spans, lambda s: F.struct(
        F.array_position(F.lit(list(KINDS)), s["kind"]).alias("k"), s["start"].alias("a"), s["end"].alias("b"),
        F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("t")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: s["t"]), ",")
