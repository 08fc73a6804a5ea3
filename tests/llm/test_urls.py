"""URL rules against running every rule on every URL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import urlrules as UR

LINES = [(0, "||net/$match-case"), (0, "@@||example.net/en/$match-case"), (1, "||ads-"), (1, "-pills."), (1, "/ads/"),
         (1, "^affid=*^"), (1, "/popup^"), (1, "@@/about/ads/"), (1, "|a.org/x|"), (1, "track"), (1, "x*y^z"),
         (2, "@@||b.example.net/en/"), (2, "%41"), (1, "  "), (1, "! a comment")]


def expected(url):
    u = url if url and "://" in url else "://"
    u = u[u.index("://") + 3:]
    host = re.match(r"[^/?#]*", u)[0]
    low = "".join(c.lower() if c.isascii() else c for c in host)
    rest = u[len(host):]
    best = None
    for tier, line in LINES:
        if not line.strip() or line.startswith("!"):
            continue
        allow, size, regex, _ = UR.compile_rule(line)
        if re.search(regex.replace(r"\z", r"\Z"), low + rest):
            best = max(best or (-9,), (-tier, size, allow, [-ord(c) for c in line], line))
    return (low, re.match(r"[^?#]*", rest)[0], best and best[-1], best and -best[0],
            "allow" if best is None or best[2] else "block")


def urls():
    rnd = random.Random(5)
    hosts = ["example.net", "B.example.NET", "badexample.net", "a.org", "ads-track.example.com", "my.ads-x.com",
             "cheap-pills.example.org", "net", "x.net:80", "é.net", "", "pills.com", "www.track.example.com"]
    paths = ["", "/", "/en/", "/en/1?x=2#t", "/EN/", "/ads/", "/about/ads/", "/x", "/popup", "/popup.html", "/popup?affid=1&b",
             "?affid=7", "/a?affid=7&c=d", "/xay/z", "/xy.z", "/%41b", "/%41", "#track", "/tracks", "/\n/ads/\n", "/" + "a-" * 5000]
    out = [f"{rnd.choice(['http', 'https', 'x'])}://{h}{p}" for h in hosts for p in paths]
    return out + ["no scheme", "", None, "://net/", "a://b://net/", "http://a.org/x", "http://a.org/x|"]


@pytest.mark.parametrize("limit", [str(64 << 20), "-1"])
def test_equals_all_rules_on_all_urls(spark, limit, monkeypatch):
    if limit == "-1":
        monkeypatch.setattr(UR, "fitting_broadcast", lambda df, rows, row_bytes: df)
    given = urls()
    df = spark.createDataFrame([(i, u, "h", 5) for i, u in enumerate(given + given[:40])],
                               "page_id long, url string, host string, size int")
    rules = spark.createDataFrame(LINES, "tier int, line string")
    got = {r["page_id"]: r for r in UR.judge(df, rules).collect()}
    assert len(got) == len(given) + 40 and set(got[0].asDict()) == {"page_id", "url", "size", "host", "path", "rule", "tier", "verdict"}
    for i, u in enumerate(given + given[:40]):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["tier"], r["verdict"]) == expected(u), u


def test_rarest_token_is_the_index(spark):
    df = spark.createDataFrame([(f"http://common.com/{'rare' if i == 0 else 'often'}/x",) for i in range(9)], "url string")
    subject = UR.url_parts("url")[2]
    tokens = df.select(subject.alias("s")).select(F.explode(UR.url_tokens("s", False)).alias("token"))
    rules = UR.compiled(spark.createDataFrame([(0, "||common.com/rare/"), (0, "||common.com/often^never^"), (0, "often/x")],
                                              "tier int, line string"))
    got = {r["line"]: r["token"] for r in UR.token_index(rules, tokens).collect()}
    assert got == {"||common.com/rare/": "rare", "||common.com/often^never^": "never", "often/x": UR.EVERY}


def test_sure_tokens_and_bad_rules():
    tokens = lambda line: UR.compile_rule(line)[3]
    assert tokens("||a.b/c") == ["a", "b"] and tokens("ab*cd") == [] and tokens("|x^y|") == ["x", "y"]
    assert tokens("/Ad/*/T%20x/") == ["ad", "t%20x"]
    for bad in ("**", "@@||", "|"):
        with pytest.raises(ValueError):
            UR.compile_rule(bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(LINES, "tier int, line string")
    assert UR.judge(none, rules).count() == 0
    one = UR.judge(spark.createDataFrame([(1, "http://a.net/")], none.schema), rules.limit(0)).first()
    assert (one["host"], one["path"], one["rule"], one["tier"], one["verdict"]) == ("a.net", "/", None, None, "allow")
