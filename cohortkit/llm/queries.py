"""Driver queries of the text operators: thin digests over the operators' real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import bpe as BP
from cohortkit.llm import chat as CH
from cohortkit.llm import decontam as DC
from cohortkit.llm import exact_dedup as ED
from cohortkit.llm import htmltext as HT
from cohortkit.llm import jaccard as JA
from cohortkit.llm import langid as LI
from cohortkit.llm import phrases as PH
from cohortkit.llm import pii as PI
from cohortkit.llm import suffix as SU
from cohortkit.llm import toxicity as TX
from cohortkit.llm import turnrepair as TR
from cohortkit.llm import urlrules as UR
from cohortkit.llm.common import held_out, read_table, text_or_empty

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def history_half():
    """The half of the ids that an earlier run is taken to have seen."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0


@register
def op1_exact_dedup(spark, sf_dir):
    out = ED.exact_dedup(read_table(spark, sf_dir, "documents"), history_half())
    return out.select("doc_id", "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op1_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@register
def op4_chat_format(spark, sf_dir):
    """The conversations table has the turn-rows layout; conversation -7 arrives as a
    message list. Both are recognised by their fingerprints."""
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"""SELECT CAST(-7 AS BIGINT) AS conv_id, array(
        named_struct('role', 'user', 'content', '{said}'),
        named_struct('role', 'assistant', 'content', '{said}')) AS messages""")
    turns = CH.canonical_turns(table, "conv_id").unionByName(CH.canonical_turns(extra, "conv_id"))
    out = CH.parse_chats(CH.format_chats(turns))
    flat = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return out.select(F.col("id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(F.array_join(flat, "").cast("binary"), 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"),
                      F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped_sql(col: str) -> str:
    out = f"replace({col}, '\\', '\\\\')"
    for c in CH.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE["op4_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, length({_escaped_sql('role')}) + length({_escaped_sql('text')}) + 7
             + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS piece FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum(piece)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


@register
def op5_decontaminate(spark, sf_dir):
    out = DC.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op5_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
     FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
     FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + 10], ' ') AS g FROM starts),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, s, p.n, item_id
        FROM (SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS g FROM pos) p JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT x)::BIGINT AS n_hit
            FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS x FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items,
            sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
          FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def vocab_path() -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op7_bpe(spark, sf_dir):
    """The decoded text comes from the ids alone."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return BP.encode_decode(docs, vocab_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@register
def op3_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = LI.fit(docs.where(~held_out()))
    out = LI.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


TOXIC_FROM = 0.3


@register
def op10_toxicity(spark, sf_dir):
    out = TX.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "score",
                      (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@register
def op6_jaccard_join(spark, sf_dir):
    out = JA.jaccard_components(read_table(spark, sf_dir, "documents"), n=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


@register
def op8_suffix_dedup(spark, sf_dir):
    out = SU.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register
def op2_personal_data(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = PI.personal_data(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in PI.KINDS[:4]],
                      F.sha2(PI.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      PI.span_text(F.concat("base", "added")).alias("spans"))


@register
def op9_html_text(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = HT.extract(pages, HT.fit_extractor(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with a fault each by the checksum of their id and number; dropped turns
    stay as rows marked ``gone``."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                                fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (rows.withColumn("again", F.explode(times))
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("fate") == 0).alias("gone")))


@register
def op11_turn_repair(spark, sf_dir):
    turns = damaged(read_table(spark, sf_dir, "conversations"))
    out = TR.repair(turns, absent=F.col("gone"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


# The grammar's states: 0 start, 1 after s, 2 after u, 3 after a (0 and 3 accept).
ORACLE["op11_turn_repair"] = r"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b::BIGINT] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM (SELECT unnest(range(256)) AS b))),
raw AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fated AS (SELECT raw.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 20 AS fate FROM raw, crc_table),
dmg AS (SELECT id, conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, again
  FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS again FROM fated WHERE fate <> 0)),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
ordered AS (SELECT c, d.*, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, id, again) AS i,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM dmg d JOIN ids ON d.conv_id IS NOT DISTINCT FROM ids.conv_id),
judged AS (SELECT *, CASE WHEN body = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prior FROM ordered),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND coalesce(prior || letter, '') NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY c),
edges(st, letter, nx) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(st, nx, cost, audit, made) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 2, 2, 'I', ['user:']),
  (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 3, 2, 'I', ['assistant:']), (2, 2, 4, 'II', ['assistant:', 'user:']),
  (3, 2, 2, 'I', ['user:']), (3, 3, 4, 'II', ['user:', 'assistant:'])),
walk AS (
  SELECT c, 0::BIGINT AS i, ins.nx AS st, ins.cost::BIGINT AS cost, ins.audit, ins.made FROM ids, ins WHERE ins.st = 0
  UNION ALL
  SELECT c, i, st, cost, audit, made FROM (
    SELECT c, i, ins.nx AS st, z.cost + ins.cost AS cost, z.audit || ins.audit AS audit, z.made || ins.made AS made,
      row_number() OVER (PARTITION BY c, ins.nx ORDER BY z.cost + ins.cost, z.audit || ins.audit) AS best
    FROM (
      SELECT w.c, j.i, w.st, w.cost + 3 AS cost, w.audit || 'D' AS audit, w.made
      FROM walk w JOIN judged j ON j.c = w.c AND j.i = w.i + 1
      UNION ALL
      SELECT w.c, j.i, e.nx, w.cost + CASE WHEN j.letter = e.letter THEN 0 ELSE 2 END + (j.fault = 'truncated')::INT,
        w.audit || CASE WHEN j.letter = e.letter THEN 'K' ELSE 'R' END,
        list_append(w.made, CASE WHEN j.letter = e.letter THEN j.role WHEN e.letter = 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text)
      FROM walk w JOIN judged j ON j.c = w.c AND j.i = w.i + 1 JOIN edges e ON e.st = w.st
      WHERE j.fault NOT IN ('blank', 'duplicate') AND (j.letter = e.letter OR e.letter <> 's')) z JOIN ins ON ins.st = z.st)
  WHERE best = 1),
ended AS (SELECT w.*, row_number() OVER (PARTITION BY w.c ORDER BY w.cost, w.audit) AS best
  FROM walk w LEFT JOIN counts USING (c) WHERE w.st IN (0, 3) AND w.i = coalesce(n, 0))
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
  sha256(array_to_string(made, chr(10))) AS repaired_sha256
FROM ids JOIN ended ON ended.c = ids.c AND ended.best = 1 LEFT JOIN counts ON counts.c = ids.c
"""


# The four site rules, the longest of which decides (tier 0).
SITE_RULES = ("||net/", "@@||example.net/en/", "||example.com/de/", "@@||org/fr/")
# The list that judges the other URLs (tier 1).
PATTERN_RULES = ("||ads-", "||ad.", "||adult-", "||casino-", "||spam-", "-pills.", "-bets.", "/ads/", "^affid=*^",
                 "/popup^", "@@/about/ads/")


@register
def op12_url_rules(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    lines = [(0, f"{x}$match-case") for x in SITE_RULES] + [(1, x) for x in PATTERN_RULES]
    out = UR.judge(pages, spark.createDataFrame(lines, "tier int, line string"))
    site = F.regexp_replace("rule", r"^(@@)?\|\||\$match-case$", "")
    return out.select("page_id", "host", "path", F.when(F.col("tier") == 0, site).alias("rule"), "verdict")


ORACLE["op12_url_rules"] = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
b AS (SELECT page_id, u, regexp_extract(u, '^[^/?#]*') AS h FROM a),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        substr(u, length(h) + 1) AS rest, regexp_extract(substr(u, length(h) + 1), '^[^?#]*') AS path FROM b),
rules(h, q, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
        ('org', '/fr/', 'allow')),
s AS (SELECT p.*, (SELECT arg_max([h || q, verdict], length(h || q)) FROM rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS r, host || rest AS x FROM p)
SELECT page_id, host, path, r[1] AS rule, CASE WHEN r IS NOT NULL THEN r[2]
    WHEN regexp_matches(x, '(?is)/about/ads/') THEN 'allow'
    WHEN regexp_matches(x, '(?is)^([^/?#]*[.])?(ads-|ad[.]|adult-|casino-|spam-)') OR regexp_matches(x, '(?is)-(pills|bets)[.]|/ads/')
      OR regexp_matches(x, '(?is)[^A-Za-z0-9_.%-]affid=.*([^A-Za-z0-9_.%-]|$)') OR regexp_matches(x, '(?is)/popup([^A-Za-z0-9_.%-]|$)')
    THEN 'block' ELSE 'allow' END AS verdict FROM s
"""


@register
def op13_collocations(spark, sf_dir):
    found = PH.collocations(read_table(spark, sf_dir, "documents"))
    return PH.best_phrases(found, 2000).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE["op13_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
      FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS x
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, x, count(*) AS n FROM g GROUP BY ALL),
tot AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, x, n AS a, string_split(x, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT *, array_to_string(w[1 : cut], ' ') AS lx, array_to_string(w[cut + 1 :], ' ') AS rx
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
rated AS (SELECT c.lang, c.k, c.x, c.a, c.cut, fl.n AS l, fr.n AS r,
            ((1000000::HUGEINT * c.a * c.a) // (fl.n::HUGEINT * fr.n))::BIGINT AS score
          FROM cuts c JOIN f fl ON fl.lang = c.lang AND fl.x = c.lx JOIN f fr ON fr.lang = c.lang AND fr.x = c.rx),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, cut) = 1),
cover AS (SELECT lang, x, max(a) AS top FROM (SELECT lang, a, array_to_string(w[1:2], ' ') AS x FROM cand WHERE k = 3
          UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN cover USING (lang, x) WHERE s.k = 3 OR top IS NULL OR 100 * top < 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, x) AS rank, x AS phrase, a, l, r, tot.n, score
FROM kept JOIN tot USING (lang) QUALIFY rank <= 2000
"""
