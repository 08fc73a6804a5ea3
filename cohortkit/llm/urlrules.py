"""URL filters: pattern rules found by their rarest literal token.

A rule is a line of the public filter-list syntax: literal text with ``*`` (any text) and
``^`` (a separator or the end), ``||`` (start of the host or of one of its labels), ``|``
(start or end), ``@@`` in front (allow instead of block) and ``$match-case`` behind. A URL is
matched without its scheme, its host in lower case.

The literal tokens of a rule that every matching URL must hold as whole tokens are counted
over the URLs; the rule is indexed under the rarest of them. The tokens of each distinct URL
fetch the rules indexed under them by an equality join, and only these run their regular
expressions. Rules without such a token are fetched by every URL. Of the rules that match,
the one of the lowest tier wins, then the longest pattern, then allow, then the least line.

Defined cases: a null URL or one without ``://`` has an empty host and path; an empty table
gives an empty one; repeated rows each get their row; a rule without any text is refused.
Columns named host, path, rule, tier and verdict are replaced, all others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortkit.llm.common import fitting_broadcast, ship_by_value, staged

ship_by_value(__name__)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9%]+"
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\z)"
EVERY = ""                      # index entry of rules without a sure token
COMPILED = "tier int, line string, allow boolean, size int, regex string, tokens array<string>"


# ---------------------------------------------------------------- rules
def compile_rule(line: str) -> tuple[bool, int, str, list[str]]:
    """allow, length of the pattern, its regular expression, its sure tokens."""
    body, allow = line.strip(), line.strip().startswith("@@")
    body = body.removeprefix("@@")
    exact = body.endswith("$match-case")
    body = body.removesuffix("$match-case")
    host, start = body.startswith("||"), body.startswith("|")
    body = body.removeprefix("||") if host else body.removeprefix("|")
    end = body.endswith("|")
    body = body.removesuffix("|")
    if not body.strip("*"):
        raise ValueError(f"rule without text: {line!r}")
    parts = re.split(r"([*^])", body)
    regex = r"\A(?:[^/?#]*\.)?" if host else r"\A" if start else ""
    sure = []
    for k, part in enumerate(parts):
        if part == "*":
            regex += ".*"
        elif part == "^":
            regex += SEPARATOR
        else:
            regex += re.sub(r"[^A-Za-z0-9\u0080-\U0010ffff]", lambda m: "\\" + m[0], part)
            low = part.translate(str.maketrans(UPPER, LOWER))
            bound_left = parts[k - 1] == "^" if k else start
            bound_right = parts[k + 1] == "^" if k + 1 < len(parts) else end
            sure += [m[0] for m in re.finditer(TOKEN, low)
                     if (m.start() or bound_left) and (m.end() < len(low) or bound_right)]
    return allow, len(body), f"(?s{'' if exact else 'i'}){regex}" + (r"\z" if end else ""), sorted(set(sure))


def compiled(rules: DataFrame) -> DataFrame:
    """Compiled rules from (tier, line); blank lines and ``!`` comments are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, line, *compile_rule(line)) for t, line in zip(b["tier"], b["line"])],
                               columns=["tier", "line", "allow", "size", "regex", "tokens"])

    lines = rules.select("tier", "line").where((F.trim("line") != "") & ~F.ltrim("line").startswith("!")).distinct()
    return lines.mapInPandas(run, COMPILED)


# ---------------------------------------------------------------- URLs
def url_parts(url: str) -> tuple[Column, Column, Column]:
    """Host, path, and host with all that follows."""
    u = F.col(url)
    at = F.coalesce(F.locate("://", u), F.lit(0))
    after = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    raw = F.regexp_extract(after, r"\A[^/?#]*", 0)
    rest = F.substr(after, F.length(raw) + 1)
    host = F.translate(raw, UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^?#]*", 0), F.concat(host, rest)


def url_tokens(subject: str, every: bool) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.translate(F.col(subject), UPPER, LOWER), F.lit(f"({TOKEN})")))
    return F.array_append(found, F.lit(EVERY)) if every else found


def token_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Compiled rules with the token under which each is found: of its sure tokens the one
    in the fewest URLs (then the longest, then the first)."""
    own = rules.select("line", "tier", F.explode_outer("tokens").alias("token"))
    wanted = own.where(F.col("token").isNotNull()).select("token").distinct()
    seen = tokens.join(fitting_broadcast(wanted, wanted.count(), 60), "token", "left_semi")
    uses = seen.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    rank = W.partitionBy("line", "tier").orderBy(F.coalesce("uses", F.lit(0)), F.length("token").desc(), "token")
    best = (own.join(uses, "token", "left").withColumn("at", F.row_number().over(rank)).where("at = 1")
            .select("line", "tier", F.coalesce("token", F.lit(EVERY)).alias("token")))
    return rules.drop("tokens").join(best, ["line", "tier"])


def matches(subjects: DataFrame, rules: DataFrame) -> DataFrame:
    """subject, tier, line, allow, size of each rule that matches a distinct ``subject``."""
    rules = staged(compiled(rules), "rules")
    every = not rules.where(F.size("tokens") == 0).isEmpty()
    tokens = subjects.select("subject", F.explode(url_tokens("subject", every)).alias("token"))
    index = staged(token_index(rules, tokens.select("token")), "index")
    width = 200 + (index.agg(F.max(F.length("regex") + 2 * F.length("line"))).first()[0] or 0)
    fetched = tokens.join(fitting_broadcast(index, index.count(), width), "token")
    return fetched.where(F.rlike("subject", F.col("regex"))).select("subject", "tier", "line", "allow", "size")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``urls`` with host, path, the line and tier of the winning rule (null
    where none matches) and a verdict: allow or block."""
    host, path, subject = url_parts(url_col)
    urls = urls.drop("host", "path", "rule", "tier", "verdict") if url_col not in ("host", "path") else urls
    parted = urls.withColumns({"host": host, "path": path, "__subject": subject})
    found = matches(parted.select(F.col("__subject").alias("subject")).distinct(), rules)
    order = F.struct(-F.col("tier"), "size", "allow")
    best = W.partitionBy("subject").orderBy(order.desc(), "line")
    won = (found.withColumn("at", F.row_number().over(best)).where("at = 1")
           .select(F.col("subject").alias("__subject"), F.col("line").alias("rule"), "tier", "allow"))
    won = staged(won, "won")
    size = won.agg(F.count(F.lit(1)), F.max(F.length("__subject"))).first()
    joined = parted.join(fitting_broadcast(won, size[0], 100 + 4 * (size[1] or 0)), "__subject", "left")
    verdict = F.when(F.col("allow"), "allow").when(~F.col("allow"), "block").otherwise(default)
    return joined.withColumn("verdict", verdict).drop("__subject", "allow")
