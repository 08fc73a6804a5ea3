"""Chat formatting: layouts are recognised by a fingerprint of their field paths.

``fingerprint`` hashes the sorted nested field paths of a schema (element paths of arrays
end in ``[]``). Each known layout is a declarative mapping: the fingerprint of the fields
it needs and expressions that yield canonical turn rows (id, turn, role, text). JSON
records get the same fingerprint per row (``json_fingerprint``), so one table may mix
layouts. Only built-in functions are used.

The template writes a prompt turn as ``[INST]role<<SYS>>text[/INST]`` and an assistant
turn as ``<s>role<<SYS>>text</s>``. Inside roles and texts a backslash is doubled and a
control string gets a backslash after its first character, so control strings occur only
where the template puts them and ``unescape`` restores the input.

Edge cases: null texts and roles are empty; rows with one turn number are ordered by role
and text; repeated rows are repeated turns; a null conversation id is one conversation;
other columns are ignored; an unknown layout raises (frames) or is listed as null (JSON).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# The template's control strings.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


# ---------------------------------------------------------------- fingerprints
def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Sorted leaf paths: ``messages[].role``, ``messages[].content``."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields
                      for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def hash_paths(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def fingerprint(schema: T.StructType, ignore: tuple[str, ...] = ()) -> str:
    return hash_paths([p for p in field_paths(schema) if p.split(".")[0].split("[")[0] not in ignore])


@dataclass(frozen=True)
class Layout:
    """``paths``: the fields a record has; ``turns``: an array of (role, text) structs made
    from them, or None where the rows are turns already."""
    name: str
    paths: tuple[str, ...]
    turns: Callable[[], Column] | None
    json_type: str = ""

    @property
    def key(self) -> str:
        return hash_paths(list(self.paths))


def _turn(role, text) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(role: Column) -> Column:
    out = role
    for old, new in ROLE_NAMES.items():
        out = F.when(role == old, F.lit(new)).otherwise(out)
    return out


def _each(col: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(col), lambda m: _turn(_renamed(m[role]), m[text]))


def _pair(prompt: str, answer: str) -> Callable[[], Column]:
    return lambda: F.array(_turn("user", F.col(prompt)), _turn(ASSISTANT, F.col(answer)))


def _instruction() -> Column:
    more = F.coalesce(F.col("input"), F.lit(""))
    return F.array(_turn("user", F.concat(F.coalesce("instruction", F.lit("")),
                                          F.when(more != "", F.concat(F.lit("\n"), more)).otherwise(""))),
                   _turn(ASSISTANT, F.col("output")))


LAYOUTS = (
    Layout("turn_rows", ("role", "text", "turn"), None),
    Layout("messages", ("messages[].content", "messages[].role"), _each("messages", "role", "content"),
           "messages array<struct<role:string,content:string>>"),
    Layout("conversations", ("conversations[].from", "conversations[].value"),
           _each("conversations", "from", "value"), "conversations array<struct<from:string,value:string>>"),
    Layout("instruction_input", ("input", "instruction", "output"), _instruction,
           "instruction string, input string, output string"),
    Layout("instruction", ("instruction", "output"), _pair("instruction", "output"),
           "instruction string, output string"),
    Layout("prompt_completion", ("completion", "prompt"), _pair("prompt", "completion"),
           "prompt string, completion string"),
    Layout("prompt_response", ("prompt", "response"), _pair("prompt", "response"),
           "prompt string, response string"),
)
BY_KEY = {x.key: x for x in LAYOUTS}


def _exploded(df: DataFrame, id_col: str, turns: Column) -> DataFrame:
    return (df.select(F.col(id_col).alias("id"), F.posexplode(turns).alias("turn", "t"))
            .select("id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text"))


def canonical_turns(df: DataFrame, id_col: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """id, turn, role, text of a frame whose schema (without the id and ``ignore``) has the
    fingerprint of a known layout; where it has more fields, the one layout with the most
    fields that it contains is taken."""
    kept = T.StructType([f for f in df.schema.fields if f.name not in {id_col, *ignore}])
    layout = BY_KEY.get(fingerprint(kept))
    if layout is None:
        have = set(field_paths(kept))
        fits = sorted((x for x in LAYOUTS if set(x.paths) <= have), key=lambda x: -len(x.paths))
        if not fits or (len(fits) > 1 and len(fits[0].paths) == len(fits[1].paths)):
            raise ValueError(f"no single layout for the fields {sorted(have)}")
        layout = fits[0]
    if layout.turns is None:
        return df.select(F.col(id_col).alias("id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    return _exploded(df, id_col, layout.turns())


def json_fingerprint(record: str) -> Column:
    """The record's nested field names, without the types of their values, hashed."""
    shape = F.schema_of_variant(F.try_parse_json(F.col(record)))
    return F.xxhash64(F.regexp_replace(shape, r": (?!ARRAY<|OBJECT<)[A-Z]+(\([0-9,]+\))?", ""))


def _json_shape(layout: Layout) -> str:
    """What json_fingerprint hashes for a layout's records."""
    tops: dict[str, list[str]] = {}
    for p in layout.paths:
        top, _, leaf = p.partition("[].")
        tops.setdefault(top, []).extend([leaf] if leaf else [])
    return "OBJECT<" + ", ".join(
        f"{t}: ARRAY<OBJECT<{', '.join(sorted(v))}>>" if v else t for t, v in sorted(tops.items())) + ">"


def json_turns(df: DataFrame, id_col: str, record: str) -> DataFrame:
    """id, turn, role, text, layout of JSON records of mixed layouts (one scan: a record's
    fingerprint picks its mapping); records of no known layout give one row with a null
    layout and no turn."""
    known = [x for x in LAYOUTS if x.turns is not None]
    fields = ", ".join(dict.fromkeys(p for x in known for p in x.json_type.split(", ")))
    parsed = df.select(F.col(id_col).alias("id"), json_fingerprint(record).alias("fp"),
                       F.from_json(record, fields).alias("r")).select("id", "fp", "r.*")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    layout = F.lit(None).cast("string")
    for x in known:
        hit = F.col("fp") == F.xxhash64(F.lit(_json_shape(x)))
        turns, layout = F.when(hit, x.turns()).otherwise(turns), F.when(hit, F.lit(x.name)).otherwise(layout)
    return (parsed.select("id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t"))
            .select("id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", "layout"))


# ---------------------------------------------------------------- template
def escape(col: Column) -> Column:
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """id, formatted, loss_spans (code-point [start, end) of each assistant text) from
    canonical turn rows. Offsets are a running sum within a conversation."""
    answer = F.col("role") == ASSISTANT
    head = F.concat(F.when(answer, "<s>").otherwise("[INST]"), escape(F.col("role")), F.lit("<<SYS>>"))
    tail = F.when(answer, "</s>").otherwise("[/INST]")
    pieces = turns.select("id", "turn", "role", "text", head.alias("head"),
                          escape(F.col("text")).alias("body"), tail.alias("tail"))
    order = W.partitionBy("id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + F.length("tail")
    placed = pieces.select(
        "id", F.row_number().over(order).alias("at"), F.concat("head", "body", "tail").alias("piece"),
        (F.sum(size.cast("long")).over(order.rowsBetween(W.unboundedPreceding, 0)) - size
         + F.length("head")).alias("start"), F.length("body").alias("n"), answer.alias("loss"))
    rows = F.array_sort(F.collect_list(F.struct("at", "piece", "start", "n", "loss")))
    return (placed.groupBy("id").agg(rows.alias("rows"))
            .select("id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
                    F.transform(F.filter("rows", lambda r: r["loss"]),
                                lambda r: F.struct(r["start"].alias("start"),
                                                   (r["start"] + r["n"]).alias("end"))).alias("loss_spans")))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Beside the given columns: ``turns`` (role, text) and ``loss_texts``, both read from
    ``formatted`` (and the mask) alone. Code points are addressed in a fixed-width
    encoding, so reading the mask is linear; the character before a span is taken along
    so that a leading byte-order mark is not eaten by the decoder."""
    ends = r"\[/INST\]|</s>"
    pieces = F.filter(F.split("formatted", ends), lambda p: p != "")
    body = lambda p: F.regexp_replace(p, r"\A(?:\[INST\]|<s>)", "")
    role = lambda p: F.substring_index(body(p), "<<SYS>>", 1)        # noqa: E731
    text = lambda p: F.substring_index(body(p), "<<SYS>>", -1)       # noqa: E731
    turns = F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"),
                                                   unescape(text(p)).alias("text")))
    wide = F.encode("formatted", "UTF-32")
    return (formatted.withColumn("wide", wide)
            .withColumn("loss_texts", F.transform("loss_spans", lambda s: unescape(_cut(s))))
            .withColumn("turns", turns).drop("wide"))


def _cut(span: Column) -> Column:
    first = (span["start"] * 4 - 3).cast("int")
    piece = F.substring(F.col("wide"), first, ((span["end"] - span["start"] + 1) * 4).cast("int"))
    whole = F.decode(piece, "UTF-32")
    return F.substring(whole, F.lit(2), F.length(whole))
