"""Conversation structure repair against a plain search over the grammar's states."""

import random

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import turnrepair as TR
from cohortkit.llm.queries import damaged

EDGES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain(letters):
    """Least (cost, audit) by states; inserts are closed twice, which is as far as they help."""
    def closed(best):
        for _ in range(2):
            for st, (c, a) in list(best.items()):
                for x, to in EDGES[st].items():
                    if x != "s":
                        best[to] = min(best.get(to, (9**9, "")), (c + 2, a + "I"))
        return best

    best = closed({0: (0, "")})
    for x in letters:
        new = {}
        for st, (c, a) in best.items():
            new[st] = min(new.get(st, (9**9, "")), (c + 3, a + "D"))
            if x != "x":
                for y, to in EDGES[st].items():
                    if x.lower() == y or y != "s":
                        e = (c + (0 if x.lower() == y else 2) + x.isupper(), a + ("K" if x.lower() == y else "R"))
                        new[to] = min(new.get(to, (9**9, "")), e)
        best = closed(new)
    return min(best[s] for s in (0, 3) if s in best)


@pytest.mark.parametrize("most", [1, 4, 9, 70])
def test_alignment_equals_plain_search(most):
    rnd = random.Random(most)
    for _ in range(1500 if most < 10 else 60):
        letters = "".join(rnd.choice("xsuaouauaSUAO" if rnd.random() < 0.6 else "ua") for _ in range(rnd.randint(0, most)))
        cost, audit, source, role = TR.align(letters)
        assert (cost, audit) == plain(letters), letters
        made = "".join((r or letters[i])[0].lower() for i, r in zip(source, role))
        assert made in ("", *(s + "ua" * k for s in ("", "s") for k in range(1, len(made))))


def test_long_conversation_is_fast_and_right():
    rnd = random.Random(3)
    letters = "".join(rnd.choice("uauauaUAxso") for _ in range(1000))
    cost, audit, *_ = TR.align(letters)
    assert (cost, audit) == plain(letters)


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, id int, fault string")


def test_faults_and_repair(spark):
    data = [(1, 0, "user", "Hi.", 0, ""), (1, 1, "user", "More?", 0, ""), (1, 3, "assistant", "no end", 0, ""),
            (1, 3, "assistant", "no end", 0, ""), (1, 5, "user", " \n", 0, "")]
    got = TR.repair(rows(spark, data)).first()
    assert (got["gaps"], got["blank"], got["duplicate"], got["truncated"], got["illegal"]) == (2, 1, 1, 1, 2)
    # Delete one user (3) against reroling or inserting an answer (2 and 2)
    assert (got["cost"], got["audit"]) == (min((3 + 0 + 1 + 6, "DKKDD"), (2 + 1 + 6, "KIKKDD"))[0], "KIKKDD")
    assert [(t["role"], t["text"]) for t in got["repaired"]] == [
        ("user", "Hi."), ("assistant", ""), ("user", "More?"), ("assistant", "no end")]


def test_nulls_ties_empty_and_clashing_names(spark):
    data = [(None, None, None, None, 1, "x"), (None, 0, "assistant", "b.", 1, "x"), (None, 0, "assistant", "a.", 1, "x"),
            (2, None, "user", "q.", 1, "x"), (2, 7, "", "odd role.", 1, "x"), (3, 1, "system", "s.", 1, "x")]
    got = {r["conv_id"]: r for r in TR.repair(rows(spark, data)).collect()}
    assert set(got) == {None, 2, 3}
    assert (got[None]["blank"], got[None]["audit"]) == (1, "DRK")          # by text: a., then b.
    assert [t["text"] for t in got[None]["repaired"]] == ["a.", "b."]
    assert (got[2]["audit"], got[2]["cost"], got[2]["gaps"]) == ("KR", 2, 0)
    assert (got[3]["audit"], got[3]["cost"], got[3]["repaired"]) == ("D", 3, [])
    assert TR.repair(rows(spark, [])).count() == 0


def test_conversation_without_turns_is_returned(spark):
    df = rows(spark, [(1, 0, "user", "a", 0, ""), (1, 1, "user", "a", 0, "")])
    got = TR.repair(df, absent=F.lit(True)).first()
    assert (got["gaps"], got["blank"], got["illegal"], got["cost"], got["audit"], got["repaired"]) == (0, 0, 0, 0, "", [])


def test_very_long_text_and_many_spaces(spark):
    df = rows(spark, [(1, 0, "user", "x" * 200_000 + " " * 200_000, 0, ""), (1, 1, "assistant", "ok." + "\t" * 100_000, 0, "")])
    got = TR.repair(df).first()
    assert (got["truncated"], got["cost"], got["audit"]) == (1, 1, "KK")


def test_damage_follows_the_checksum(spark):
    import zlib
    data = [(c, t, "assistant", "a. b!", 0, "") for c in range(40) for t in range(6)]
    kept = damaged(rows(spark, data)).collect()
    fate = lambda c, t: zlib.crc32(f"{c}:{t}".encode()) % 20
    for r in kept:
        f = fate(r["conv_id"], r["turn"])
        assert (r["gone"], r["text"], r["role"]) == (f == 0, {1: "", 2: "a b"}.get(f, "a. b!"),
                                                   "user" if f == 4 else "assistant")
    assert len(kept) == len(data) + sum(fate(c, t) == 3 for c, t, *_ in data)
