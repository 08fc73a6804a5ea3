"""Exact dedup, n-gram Jaccard join and suffix dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import exact_dedup as ED
from cohortkit.llm import jaccard as JA
from cohortkit.llm import suffix as SU
from cohortkit.llm.components import components

DOCS = "doc_id long, text string, lang string, digest string, n long, set_id int, sig string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 7, "s") for i, t in rows], DOCS)


# ---------------------------------------------------------------- exact dedup
def test_mph_is_a_permutation_and_tells_strangers_apart():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    slots, sizes, bits = ED.build_mph(b"".join(keys))
    assert sorted(slots.tolist()) == list(range(5000))
    assert (ED.find_slots(b"".join(keys), sizes, bits) == slots).all()
    strangers = [hashlib.sha256(f"no{i}".encode()).digest() for i in range(2000)]
    at = ED.find_slots(b"".join(strangers), sizes, bits)
    held = {int(s): k for s, k in zip(slots, keys)}
    assert all(held[int(a)] != k for a, k in zip(at, strangers) if a >= 0)
    assert ED.build_mph(b"")[0].size == 0


@pytest.mark.parametrize("historical", ["doc_id % 2 = 0", "true", "false", "cast(null as boolean)"])
def test_exact_dedup_brute_force(spark, historical):
    rows = [(i, f"t{i % 7}") for i in range(40)] + [(50, None), (51, ""), (52, "T1"), (53, "x" * 200_000), (54, "x" * 200_000),
                                                    (None, "t1"), (60, "twice"), (60, "twice")]
    out = ED.exact_dedup(docs(spark, rows), F.expr(historical), shard_rows=5).collect()
    assert len(out) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for r in out:
        text = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r["digest"]))
        assert r["keep_id"] == max(i for i in groups[text] if i is not None)
        assert r["group_size"] == len(groups[text])
    kept = [r["doc_id"] for r in out if r["kept"]]
    assert sorted(kept) == sorted(max(i for i in g if i is not None) for g in groups.values())


def test_drop_copies_keeps_one_row_each(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None), (5, ""), (6, "c"), (6, "d")]
    out = ED.drop_copies(docs(spark, rows), F.expr("doc_id % 2 = 0"))
    assert out.columns == docs(spark, rows).columns
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == [(2, "a"), (3, "b"), (5, ""), (6, "c"), (6, "d")]


def test_exact_dedup_empty(spark):
    assert ED.exact_dedup(docs(spark, []), F.lit(True)).count() == 0


# ---------------------------------------------------------------- Jaccard join
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ngrams(text, n):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, num, den):
    sets = [(i, ngrams(t, n)) for i, t in rows]
    part = {k: k for k in range(len(sets))}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                part[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(i, least.get(root(k), i))
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


def near_rows(seed, base_words, copies, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{rng.integers(60)}" for _ in range(base_words)]
    out = []
    for c in range(copies):
        words = list(base)
        for _ in range(int(rng.integers(0, edits + 1))):
            words[int(rng.integers(len(words)))] = f"e{rng.integers(5)}" if rng.random() < 0.5 else f"u{seed}x{c}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n,num", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_brute_force(spark, n, num):
    texts = near_rows(1, 60, 30, 4) + near_rows(2, 25, 20, 2) + near_rows(3, 9, 15, 1) + near_rows(4, 200, 12, 9)
    texts += ["A b C", "a B c", "a b c d", "", None, " \t ", "one", "one", "z " * 3000, "z " * 2999]
    rows = list(enumerate(texts))
    out = JA.jaccard_components(docs(spark, rows), n, num, 100).collect()
    want = brute_components(rows, n, num, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert sum(r["first"] for r in out) == len({c for s, c in want.values() if s}) + 3  # the three empty sets


def test_similar_sets_share_a_signature():
    """Any two sets with the wanted similarity agree on a signature, whatever the sizes."""
    rng = np.random.default_rng(5)
    for trial in range(400):
        size = int(rng.choice([3, 7, 8, 12, 20, 45, 90, 300]))
        x = rng.integers(1, 2**63, size, dtype=np.uint64)
        k = int(size * 0.17) + 1
        y = np.concatenate((x[int(rng.integers(0, k + 1)):], rng.integers(1, 2**63, int(rng.integers(0, k + 1)), dtype=np.uint64)))
        x, y = np.unique(x), np.unique(y)
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 85 * (len(x) + len(y) - shared) or shared == len(x) == len(y):
            continue
        sizes = np.array([len(x), len(y)])
        who, sig = JA.signatures(np.concatenate((x, y)), sizes, sizes, 85, 100)
        assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist()), (trial, sizes)


def test_near_copies_below_the_similarity_make_no_rows(spark):
    """A group that is alike but not similar enough is compared in blocks, not as pairs."""
    rows = list(enumerate(near_rows(9, 80, 60, 12)))
    out = JA.jaccard_components(docs(spark, rows), 4, 85, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, 4, 85, 100)


def test_drop_near_copies_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text + " x"), (9, "other words here that are alone"), (None, "no id"), (2, None), (7, "")]
    kept = JA.drop_near_copies(docs(spark, rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "9", "None", "2", "7"])
    assert JA.jaccard_components(docs(spark, [])).count() == 0


def test_block_comparison_hands_on_a_forest():
    import pandas as pd
    common = np.arange(1, 41, dtype=np.uint64)
    grams = [np.sort(np.append(common, np.uint64(1000 + i))).tobytes() for i in range(30)]
    grams += [np.arange(5000 + 100 * i, 5041 + 100 * i, dtype=np.uint64).tobytes() for i in range(3)]
    rows = pd.DataFrame({"p": 0, "q": 0, "block": 0, "set_id": np.arange(33), "size": 41, "grams": grams,
                         "component": [i // 2 if i < 10 else i + 100 for i in range(33)]})
    run = JA._compare_blocks(9, 10)
    for q, block, want in ((0, 0, 24), (1, np.arange(33) % 2, None)):
        links = run(rows.assign(q=q, block=block))
        joined = {i: i for i in range(33)}

        def top(i):
            while joined[i] != i:
                i = joined[i]
            return i

        for i in range(1, 10, 2):
            joined[top(i)] = top(i - 1)
        for a, b in zip(links["a"], links["b"]):
            assert q == 0 or a % 2 != b % 2
            assert top(a) != top(b)                     # no link closes a circle
            joined[top(a)] = top(b)
        assert len({top(i) for i in range(30)}) == 1 and len({top(i) for i in range(33)}) == 4
        assert want is None or len(links) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 102), (102, 101), (200, 200)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- suffix dedup
def test_suffix_order_and_repeats_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(300):
        least = int(rng.choice([8, 16]))
        body = bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 120))).astype(np.uint8))
        if trial % 3 == 0 and len(body) > 20:
            body = body[:20] * 5
        if trial % 7 == 0:
            body = body.replace(b"a", b"\0")
        text = np.frombuffer(body + bytes(least + 8), np.uint8)
        if len(body) < least:
            continue
        wanted = np.sort(rng.choice(len(body) - least + 1, int(rng.integers(1, len(body) - least + 2)), replace=False))
        order, _ = SU.suffix_order(text, wanted, least)
        keys = [text.tobytes()[i:i + least] for i in order]
        assert sorted(order.tolist()) == wanted.tolist() and keys == sorted(keys)
        all_keys = [text.tobytes()[i:i + least] for i in wanted]
        assert SU.repeated_windows(text, wanted, least).tolist() == [all_keys.count(k) > 1 for k in all_keys]


def brute_repeats(rows, least):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in bodies:
        for s in range(len(b) - least + 1):
            seen[b[s:s + least]] = seen.get(b[s:s + least], 0) + 1
    out = []
    for i, b in bodies:
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - least + 1):
            if seen[b[s:s + least]] > 1:
                cover[s:s + least] = True
        out.append((i, len(b), int((cover & ~np.append(False, cover[:-1])).sum() if len(b) else 0),
                    bytes(np.frombuffer(b, np.uint8)[~cover])))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 0])
def test_remove_repeats_brute_force(spark, hot):
    rng = np.random.default_rng(11)
    word = lambda: "".join(chr(int(c)) for c in rng.integers(97, 100, int(rng.integers(1, 6))))
    passage = " ".join(word() for _ in range(30))
    rows = []
    for i in range(40):
        t = " ".join(word() for _ in range(int(rng.integers(0, 60))))
        if i % 3 == 0:
            t = t[:50] + passage[int(rng.integers(0, 40)):] + t[50:]
        rows.append((i, t + ("é" if i % 5 == 0 else "")))
    rows += [(100, "a" * 300), (101, None), (102, ""), (103, rows[3][1]), (104, "ab" * 100), (105, "short"), (None, passage),
             (106, "same"), (106, "same")]
    out = SU.remove_repeats(docs(spark, rows), least=32, shard_bytes=2000, hot_contexts=hot).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in out), key=str)
    assert got == brute_repeats(rows, 32)
    assert all(b["start"] > a["end"] for r in out for a, b in zip(r["spans"], r["spans"][1:]))


def test_remove_repeats_empty(spark):
    assert SU.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("dense", [64, 3, 1])
def test_shared_counts_of_blocks(monkeypatch, dense):
    monkeypatch.setattr(JA, "DENSE", dense)
    monkeypatch.setattr(JA, "COLUMNS", 16)
    monkeypatch.setattr(JA, "CODES", 40)
    rng = np.random.default_rng(dense)
    parts = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in parts] for a in parts])
    every, left = np.arange(30), np.flatnonzero(rng.random(30) < 0.4)
    right = np.setdiff1d(every, left)
    got = JA.shared_counts(parts, every, every)
    assert (got[~np.eye(30, dtype=bool)] == want[~np.eye(30, dtype=bool)]).all()
    assert (JA.shared_counts(parts, left, right) == want[np.ix_(left, right)]).all()


def test_small_clusters_share_tasks(spark):
    """Tasks follow the pairs of sets to compare, not the number of clusters."""
    rows = [(c, s % 2, 10 * c + s, bytes(80)) for c in range(300) for s in range(4)]
    rows += [(-1, s if s < 700 else -1, 10_000 + s, bytes(8)) for s in range(2500)]
    members = spark.createDataFrame(rows, "cluster long, component long, set_id long, grams binary")
    plan = JA.block_plan(members)
    got = {r["cluster"]: (r["same"], r["apart"]) for r in plan.collect()}
    assert got.pop(-1) == (2, 1) and set(got.values()) == {(0, 1)}
    assert JA.compare_tasks(plan, 8) == 8
    assert JA.compare_tasks(plan.withColumn("work", F.lit(50.0)), 8) == 301 * 50


def test_sets_of_two_clusters_meet_by_bucket(spark):
    # 40 clusters of 50 sets in a chain: one set of each shares a bucket with one of the next
    per = [(c, c * 1000 + i) for c in range(1, 41) for i in range(50)]
    inner = [(c, s, s % 25, c, 100, 100) for c, s in per]                       # a bucket a cluster
    chain = [(10_000 + c, s, s, k, 100, 100) for c in range(1, 40) for k, s in ((c, c * 1000 + 1), (c + 1, (c + 1) * 1000))]
    schema = "sig long, set_id long, component long, cluster long, size long, held long"
    met = {(r.set_id, r.other) for r in JA.meetings(spark.createDataFrame(inner + chain, schema), 80, 100).collect()}
    want = {(c * 1000 + 1, c + 1) for c in range(1, 40)} | {((c + 1) * 1000, c) for c in range(1, 40)}
    assert met == want                                                          # 2,000 sets, all in 40 blocks before
    # one component, sizes that allow no link, too few n-grams that others have: no meeting
    rows = [(1, 1, 5, 1, 100, 100), (1, 2, 5, 2, 100, 100), (2, 3, 3, 1, 100, 100), (2, 4, 4, 2, 79, 79),
            (3, 5, 5, 1, 100, 100), (3, 6, 6, 2, 100, 88), (4, 7, 7, 1, 100, 100), (4, 8, 8, 2, 80, 80)]
    met = {(r.set_id, r.other) for r in JA.meetings(spark.createDataFrame(rows, schema), 80, 100).collect()}
    assert met == {(7, 2), (8, 1)}


@pytest.mark.parametrize("sets", [1024, 4])
def test_jaccard_over_many_clusters(spark, monkeypatch, sets):
    monkeypatch.setattr(JA, "BLOCK_SETS", sets)          # small: clusters of one hub, several blocks
    texts = [t for seed in range(5, 17) for t in near_rows(seed, 14 + 3 * seed, 8, 5)]
    texts += [" ".join(t.split()[2:]) + " tail" for t in texts[::3]] + near_rows(30, 40, 25, 12)
    rows = list(enumerate(texts))
    out = JA.jaccard_components(docs(spark, rows), 3, 70, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 3, 70, 100)


def test_block_comparison_is_bounded_in_memory():
    """Two full blocks take little beside their own bytes."""
    import tracemalloc

    import pandas as pd
    rng = np.random.default_rng(3)
    common = rng.integers(1, 2**63, 3000, dtype=np.uint64)
    grams = [np.unique(rng.choice(common, 400, replace=False)).tobytes() for _ in range(2 * JA.BLOCK_SETS)]
    rows = pd.DataFrame({"p": 0, "q": 1, "block": np.arange(len(grams)) // JA.BLOCK_SETS, "set_id": np.arange(len(grams)),
                         "size": 400, "component": np.arange(len(grams)), "grams": grams})
    run = JA._compare_blocks(80, 100)
    tracemalloc.start()
    try:
        run(rows)
        assert tracemalloc.get_traced_memory()[1] < 56 << 20
    finally:
        tracemalloc.stop()
