"""Chat formatting, decontamination, BPE, language ID, personal data, toxicity and HTML."""

import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import bpe, chat, decontam, htmltext, langid, pii, toxicity
from cohortkit.llm.common import held_out
from cohortkit.llm.queries import vocab_path

SF = "/root/testdata/sf0.01"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, "w") for i, t in rows],
                                 "doc_id long, text string, tk string, n_words int, w string")


# ---------------------------------------------------------------- chat
def test_fingerprint_picks_the_layout(spark):
    a = spark.createDataFrame([(1, [("user", "hi"), ("assistant", None)])],
                              "id int, messages array<struct<role:string,content:string>>")
    b = spark.createDataFrame([(2, [("human", "hi"), ("gpt", "yo")])],
                              "id int, conversations array<struct<from:string,value:string>>")
    c = spark.createDataFrame([(3, "do", "this", "done")], "id int, instruction string, input string, output string")
    d = spark.createDataFrame([(4, "p", "r", 5)], "id int, prompt string, response string, extra int")
    rows = lambda df: [tuple(r) for r in chat.canonical_turns(df, "id").orderBy("turn").collect()]
    assert rows(a) == [(1, 0, "user", "hi"), (1, 1, "assistant", "")]
    assert rows(b) == [(2, 0, "user", "hi"), (2, 1, "assistant", "yo")]
    assert rows(c) == [(3, 0, "user", "do\nthis"), (3, 1, "assistant", "done")]
    assert rows(d) == [(4, 0, "user", "p"), (4, 1, "assistant", "r")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "id int, stuff string"), "id")


def test_json_records_of_mixed_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
               {"conversations": [{"from": "human", "value": "b"}]}, {"prompt": "c", "completion": "d"},
               {"instruction": "e", "output": "f"}, {"what": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "not json"), (10, None)],
                               "id int, record string")
    got = sorted((r["id"], r["turn"], r["role"], r["text"], r["layout"]) if r["turn"] is not None else (r["id"],)
                 for r in chat.json_turns(df, "id", "record").collect())
    assert got == [(0, 0, "user", "a", "messages"), (0, 1, "assistant", "", "messages"),
                   (1, 0, "user", "b", "conversations"), (2, 0, "user", "c", "prompt_completion"),
                   (2, 1, "assistant", "d", "prompt_completion"), (3, 0, "user", "e", "instruction"),
                   (3, 1, "assistant", "f", "instruction"), (4,), (9,), (10,)]


def test_format_round_trip_and_mask(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "", None, "﻿bom", "🙂 é", "<<SYS>>\n<</SYS>>", "[\\INST]", "x" * 50_000]
    rows = [(c, t, r, x, "clash") for c in (1, 2, None) for t, (r, x) in enumerate(
        zip(["system", "user", "assistant", None, "a\nb", "assistant", "assistant", "us</s>er", "assistant", "user"], texts))]
    rows += [(5, 0, "assistant", "b", ""), (5, 0, "assistant", "a", ""), (5, 0, "assistant", "a", "")]
    df = spark.createDataFrame(rows, "id int, turn int, role string, text string, formatted string")
    out = chat.parse_chats(chat.format_chats(chat.canonical_turns(df, "id"))).collect()
    assert len(out) == 4
    for r in out:
        mine = sorted((t, role or "", x or "") for c, t, role, x, _ in rows if c == r["id"])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for _, a, b in mine]
        assert r["loss_texts"] == [b for _, a, b in mine if a == "assistant"]
        for s, x in zip(r["loss_spans"], r["loss_texts"]):
            piece = r["formatted"][s["start"]:s["end"]]
            assert re.sub(r"(?s)\\(.)", r"\1", piece) == x
    assert chat.format_chats(chat.canonical_turns(df.limit(0), "id")).count() == 0


# ---------------------------------------------------------------- decontamination
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(rows, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[s:s + window]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, named = words(t), set(), set()
        for win, ids in wins.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    named |= ids
        out.append((i, len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=str)


def test_decontaminate_brute_force(spark):
    rng = random.Random(4)
    vocab = ["the", "of", "a", "b1", "É", "é", "x-y", "Zed", "日本"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.randint(1, 14))) for i in range(12)] + [(50, "the"), (51, ""), (52, None), (53, "!!"), (None, line(6)),
                                                                 (54, "the of a"), (54, "the of a"), (55, "of a")]
    rows = [(i, line(rng.randint(0, 40))) for i in range(60)]
    rows += [(100 + i, line(3) + ", " + (t or "").upper() + ". " + line(2)) for i, (_, t) in enumerate(items)]
    rows += [(200, None), (201, ""), (None, items[0][1]), (202, rows[0][1]), (202, rows[0][1]), (203, line(20_000))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, wid string")
    got = decontam.decontaminate(docs(spark, rows), bench, 5).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["item_ids"])) for r in got), key=str) == brute_hits(rows, items, 5)


def test_decontaminate_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontam.decontaminate(docs(spark, []), bench).count() == 0
    some = decontam.decontaminate(docs(spark, [(1, "one two three"), (2, None)]), bench.limit(0))
    assert sorted(r["n_hit"] for r in some.collect()) == [0, 0]
    kept = decontam.drop_contaminated(docs(spark, [(1, "x ONE two; three"), (1, "clean"), (None, "one two")]), bench)
    assert sorted(r["text"] for r in kept.collect()) == ["clean", "one two"]


# ---------------------------------------------------------------- BPE
@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocab_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(library):
    vocab = bpe.Vocabulary(vocab_path())
    rng = random.Random(1)
    alphabet = ["a", "b", "A", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "1", "23", "é", "²", "Ⅷ",
                "中", "한", "🙂", "👨‍👩‍👧", "́", "<|endoftext|>", "<|", "endof", "text|>", "the", " the", "!!!", "_", "﻿", "𝒜",
                "aaaa", "    ", "՘", "࢏", "ᲊ", "\x00"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(4000)] + ["", "a" * 5000, " " * 3000, "ab " * 200_000]
    ids, counts = bpe.encode_texts(vocab, texts)
    at = 0
    for t, n in zip(texts, counts):
        mine = ids[at:at + n].tolist()
        at += n
        want = library.encode(t, add_special_tokens=False).ids
        assert mine == want
        assert bpe.decode_ids(vocab, mine) == library.decode(want, skip_special_tokens=False)
    assert bpe.decode_ids(vocab, [10**6, -1, 0]) == "!"


def test_bpe_on_frames(spark, library):
    rows = [(1, "héllo world"), (2, None), (3, ""), (None, "x"), (1, "héllo world")]
    df = docs(spark, rows).withColumn("ids", F.lit("clash"))
    enc = bpe.encode(df, vocab_path())
    dec = bpe.decode(enc.withColumn("kept", F.col("ids")), vocab_path()).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in dec) == sorted((str(i), t or "") for i, t in rows)
    assert all(r["kept"] == library.encode(r["text"], add_special_tokens=False).ids for r in dec)
    assert bpe.encode(df.limit(0), vocab_path()).count() == 0
    both = bpe.decode(enc, vocab_path(), keep_ids=True)
    assert both.columns == [*enc.columns, "text"]
    assert sorted(r["text"] for r in both.collect()) == sorted(r["text"] for r in dec)


def test_bpe_encodes_and_decodes_in_one_worker(spark):
    """One Python step a task, with what the two operators give one after the other."""
    import corpus_pipeline
    rows = [(1, "héllo world"), (2, None), (3, ""), (None, "x"), (1, "héllo world"), (5, "a\u6f22b <|endoftext|> c")]
    df = docs(spark, rows).withColumn("ids", F.lit("clash")).repartition(2)
    both = bpe.encode_decode(df, vocab_path())
    one_by_one = bpe.decode(bpe.encode(df, vocab_path()), vocab_path(), keep_ids=True)
    assert both.schema == one_by_one.schema
    assert sorted(map(str, both.collect())) == sorted(map(str, one_by_one.collect()))
    assert bpe.encode_decode(df.limit(0), vocab_path()).count() == 0
    stage = corpus_pipeline.token_ids(spark, df.withColumns({"lang": F.lit("en"), "source": F.lit("s")}), "")
    assert [r["round_trip"] for r in stage.collect()] == [True] * len(rows)
    for plan in (both, stage):
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_bpe_forgets_its_pieces(library, monkeypatch):
    """Ids are the same whether a worker knows a chunk's pieces, some of them or none."""
    texts = ["one two two", "two <|endoftext|> three", "", "four<|endoftext|>", "one \u00e9 \u6f22 four"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (0, 3, 10**6):
        monkeypatch.setattr(bpe, "MET_PIECES", most)
        vocab = bpe.Vocabulary(vocab_path())
        for _ in range(2):
            for text, ids in zip(texts, want):
                assert bpe.encode_texts(vocab, [text])[0].tolist() == ids


def test_bpe_decodes_what_is_no_utf8(library):
    tokens = bpe.TokenBytes(bpe.Vocabulary(vocab_path()).tokens)
    ids = library.encode("a\u6f22b", add_special_tokens=False).ids
    cut = [ids[:2], ids[2:], [], ids]
    ends = np.cumsum([0, *map(len, cut)])
    got = bpe.decode_texts(tokens, np.concatenate([np.array(c, np.int64) for c in cut]), ends).to_pylist()
    assert got == [library.decode(c, skip_special_tokens=False) for c in cut]


# ---------------------------------------------------------------- language ID
def test_viterbi_brute_force():
    rng = np.random.default_rng(0)

    def value(labels, s, fresh, penalty):
        return sum(s[t, k] for t, k in enumerate(labels)) - sum(
            penalty for t in range(1, len(labels)) if labels[t] != labels[t - 1] and not fresh[t])

    for n in (1, 2, 7, 8, 9, 50):
        for k in (1, 2, 4):
            s, fresh = rng.normal(size=(n, k)) * 3, rng.random(n) < 0.05
            fresh[0] = True
            best = s[0].copy()
            for t in range(1, n):
                best = np.maximum(best, best.max() - (0 if fresh[t] else 4.0)) + s[t]
            assert abs(value(langid.viterbi(s, fresh, 4.0, block=8), s, fresh, 4.0) - best.max()) < 1e-3


def test_language_spans_and_edge_cases(spark):
    en, de, ru = "the cat and the dog with that thing ", "der hund und die katze mit dem ding ", "кошка и собака вместе "
    train = spark.createDataFrame([(en * 5, "en"), (de * 5, "de"), (ru * 5, "ru"), (None, "en"), ("x", None)], "text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["de", "en", "ru"]
    df = spark.createDataFrame([(1, en * 4 + de * 2), (2, ru), (3, None), (4, "123 !"), (5, ""), (5, ""), (6, "ΑΒΓ"), (None, de)],
                               "doc_id long, text string")
    out = {(r["doc_id"], i): r for i, r in enumerate(langid.predict(df, model).collect())}
    by = {k[0]: r for k, r in out.items()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 5, None)] == ["en", "ru", "und", "und", "und", "de"]
    assert [s["lang"] for s in by[1]["spans"]] == ["en", "de"]
    assert by[1]["spans"][1]["start"] == len(en * 4) and 0.5 < by[1]["score"] < 1
    assert by[3]["score"] == 0.0 and by[6]["lang_pred"] in model.langs and len(out) == 8
    nothing = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    assert sorted(str(r["doc_id"]) for r in langid.drop_unknown(df, model).collect()) == ["1", "2", "6", "None"]


def test_language_accuracy_held_out(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table.where(~held_out()))
    got = langid.predict(table.where(held_out()).select("doc_id", "lang", "text"), model)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


# ---------------------------------------------------------------- personal data
def reference_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
                  if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = list("ab1239.@@+- ()é٣²_%") + ["1.2.3.4", "4242424242424242", "+1 (171) 555-2028", "a@b.c", ".com", "@x-y.de", "0000"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 18)))
        assert pii.base_spans(t) == reference_spans(t), t
    pii.base_spans("a" * 200_000 + "@" + "1" * 200_000)  # long runs stay linear


def test_added_spans_and_edge_cases(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, f'api token = "{key[i:] + key[:i]}" end') for i in range(12)]
    rows += [(20 + i, f"write to josé.{i}@mail.example.com please") for i in range(12)]
    rows += [(40 + i, f"number 44177442803515{i:02d} here") for i in range(8)] + [(60, None), (61, ""), (None, "a@b.de"), (61, "")]
    out = pii.personal_data(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert [s["kind"] for s in by[3]["added"]] == ["secret"]
    assert by[25]["base"] and all(s["kind"] == "email" for s in by[25]["added"])
    assert not by[60]["base"] and not by[60]["added"] and [s["kind"] for s in by[None]["base"]] == ["email"]
    assert pii.personal_data(docs(spark, [])).count() == 0
    code = pii.pattern_code("phone", (1, -1, 0, 0, 1), 12)
    kind, given, length = pii.read_code(np.array([code]))
    assert pii.KINDS[kind[0]] == "phone" and given[0].tolist() == [1, -1, 0, 0, 1] and length[0] == 1


def test_base_spans_teach_but_are_not_added(spark):
    rows = [(i, f"mail me at user{i % 10}@mail.example.com or call +1 (171) 555-20{i % 10}8 now") for i in range(40)]
    found = pii.find_spans(docs(spark, rows))
    assert not any(r["candidates"] for r in found.collect())
    kind, given, _ = pii.read_code(np.array(pii.accepted_codes(found)))
    assert {pii.KINDS[k] for k in kind} == {"email", "phone"} and (given[:, 0] == 1).all()
    out = pii.personal_data(docs(spark, rows)).collect()
    assert all(len(r["base"]) == 2 and not r["added"] for r in out) and "known" not in out[0]


def test_span_lookup_equals_plain_search():
    rng = random.Random(4)
    for _ in range(300):
        base = []
        for kind in ("email", "ip", "card"):
            at = 0
            while (at := at + rng.randint(0, 9)) < 40:
                end = at + rng.randint(1, 6)
                base.append((kind, at, end))
                at = end
        spans = pii.Spans(base)
        a = rng.randint(0, 40)
        b = a + rng.randint(1, 8)
        assert spans.contains(a, b) == any(x <= a and b <= y for _, x, y in base)
        for kind in ("email", "phone"):
            assert spans.overlaps(kind, a, b) == any(k == kind and x < b and a < y for k, x, y in base)


def test_text_of_very_many_spans(spark):
    import time
    text = " ".join(f"mail{i}@example.com or (030) 555-{i % 10}{i % 7}12 12" for i in range(50_000))
    started = time.time()
    row = pii.personal_data(docs(spark, [(1, text)])).first()
    assert len(row["base"]) == 50_000 and time.time() - started < 60


def test_secrets_are_returned(spark):
    secret = "api_key = sk_live4f9A8b7C6d5E4f3A2b1C"
    rows = [(i, f"Some words, {secret}{i:04d} and more." if i % 2 else "Only words here.") for i in range(80)]
    out = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in pii.personal_data(docs(spark, rows)).collect()}
    assert all(("secret" in out[i]) == bool(i % 2) for i in out)


# ---------------------------------------------------------------- toxicity
def test_maximal_segments_brute_force():
    rng = np.random.default_rng(2)

    def brute(scores, lo, hi):
        """The best segment, then the same to its left and right."""
        best = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = sum(scores[a:b])
                if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                    best = (a, b, s)
        if best is None:
            return []
        return brute(scores, lo, best[0]) + [best] + brute(scores, best[1], hi)

    for _ in range(200):
        n = int(rng.integers(0, 16))
        scores = [float(rng.integers(1, 6)) + float(rng.random()) if rng.random() < 0.4 else -0.7 - float(rng.random())
                  for _ in range(n)]
        got = toxicity.maximal_segments(np.array(scores))
        want = brute(scores, 0, n)
        assert [(a, b + 1) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def test_lexicon_equals_brute_force(spark):
    """Entries of both signs, with stems summed over the labelled texts' words."""
    rnd = random.Random(11)
    calm, harsh = [f"calm{i % 9}{c}word" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")], [f"harsh{c}ly" for c in "abcdefg"]
    texts = []
    for i in range(400):
        words = rnd.choices(calm, k=12) + ["everywhere", "İdea,harsh"] + ["kindly"] * (i % 4 > 0)
        if i % 4 == 0:
            words += rnd.choices(harsh, k=3)
        texts.append((" ".join(words) + f" nr{i}", 1 if i % 4 == 0 else 0 if i % 4 < 3 else None))
    texts += [(texts[0][0], 1), (None, None), ("", 0)]                      # an equal text teaches once
    frame = spark.createDataFrame(texts, "text string, toxic int")
    got = toxicity.fit_lexicon(frame, frame.where("toxic is not null"))
    sets = [(set(toxicity.words_of(t or "")), y) for t, y in texts]
    taught = {t: y for t, y in texts if y is not None}
    count = {f: [0, 0, 0] for t in taught for w in toxicity.words_of(t) for f in toxicity.features(w)}
    total, n = [0, 0, 0], len(texts)
    for w in {w for t in taught for w in toxicity.words_of(t)}:
        per = [sum(w in toxicity.words_of(t) and y == k for t, y in taught.items()) for k in (1, 0)] + [sum(w in s for s, _ in sets)]
        total = [a + b for a, b in zip(total, per)]
        for f in toxicity.features(w):
            count[f] = [a + b for a, b in zip(count[f], per)]
    want = {}
    for f, (y, x, docs_) in count.items():
        p, whole = docs_ * toxicity.PRIOR_DOCS / n, total[2] * toxicity.PRIOR_DOCS / n
        odds = lambda c, m: math.log((c + p) / max(m + whole - c - p, 0.5))
        score = odds(y, total[0]) - odds(x, total[1])
        z = score / math.sqrt(1 / (y + p) + 1 / (x + p))
        if z >= toxicity.Z_LEAST and y >= toxicity.LEAST_TEXTS or z <= -toxicity.Z_LEAST and x >= toxicity.LEAST_TEXTS:
            want[f] = score
    assert min(want.values()) < 0 < max(want.values()) and got == pytest.approx(want)


def test_segments_equal_plain_scores(spark):
    """A token has its word's score, else that of its longest stem, else the drift."""
    lexicon = {"scum": 2.0, "vile-": 1.5, "vilenes-": -1.0, "kind": -3.0}
    rng = random.Random(8)
    vocab = ["scum", "vile", "vilest", "vileness", "kind", "Scum,", "x_1", "été", "vilenes"]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "scum " * 50_000]
    out = toxicity.score_segments(docs(spark, list(enumerate(texts))), lexicon).collect()
    for r in out:
        low = texts[r["doc_id"]] or ""
        words = toxicity.words_of(low)
        value = lambda w: next((lexicon[f] for f in toxicity.features(w) if f in lexicon), -toxicity.DRIFT)
        spans = [m.span() for m in toxicity.WORD.finditer(low.lower())]
        want = toxicity.maximal_segments(np.array([value(w) for w in words]))
        assert r["n_words"] == len(words) and [(s["start"], s["end"]) for s in r["segments"]] == [
            (spans[a][0], spans[b][1]) for a, b, _ in want]
        assert [s["score"] for s in r["segments"]] == pytest.approx([s for _, _, s in want])
        assert (r["tk"], r["w"]) == ("x", "w")


def test_toxicity_edge_cases(spark):
    rng = random.Random(3)
    line = lambda bad: " ".join((["idiot", "scum"] if bad else []) + [f"w{rng.randint(0, 40)}" for _ in range(20)])
    rows = [(i, line(i % 4 == 0)) for i in range(200)] + [(300, None), (301, ""), (302, "idiot scum"), (None, "fine"), (301, "")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(160)] + [(161, None, 1), (0, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    out = toxicity.toxicity(docs(spark, rows), labels, F.lit(True)).collect()
    assert len(out) == len(rows)
    score = {r["doc_id"]: r["score"] for r in out}
    assert score[302] > 0.5 > score[301] == score[300] >= 0 and score[None] < 0.5
    assert all(score[i] > 0.5 for i in range(160, 200, 4)) and all(score[i] < 0.5 for i in range(161, 200, 4))
    none = toxicity.toxicity(docs(spark, rows), labels.limit(0), F.lit(True)).collect()
    assert all(0 <= r["score"] < 0.3 for r in none)
    assert toxicity.toxicity(docs(spark, []), labels, F.lit(True)).count() == 0


@pytest.mark.parametrize("words", [1, 3])
def test_words_beyond_the_broadcast_ones_score_alike(spark, words):
    rng = random.Random(5)
    harsh = [f"vile{c}{c}ness" for c in "abcdefghijklmn"]
    rows = [(i, " ".join((rng.sample(harsh, 3) if i % 3 == 0 else []) + [f"w{rng.randint(0, 60)}" for _ in range(15)]))
            for i in range(900)] + [(1400, None), (1401, ""), (None, harsh[0]), (1401, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(800)], "doc_id long, toxic int")
    frame = docs(spark, rows)
    assert len(toxicity.fit_lexicon(frame, frame.join(labels, "doc_id"))) > 3
    key = lambda r: (str(r["doc_id"]), r["n_words"], r["segments"], r["score"])
    want, got = ([key(r) for r in toxicity.toxicity(frame, labels, F.lit(True), **k).collect()]
                 for k in ({}, {"broadcast_words": words}))
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(rows)


# ---------------------------------------------------------------- HTML
PAGE = ('<html><head><title>t</title><script>x="</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        '<div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p><b>First  text.<br><p>Second\n paragraph of '
        'the page, {i}.</p></article><footer>&copy; me</footer></body></html>')


def test_main_text(spark):
    pages = [PAGE.format(i=i) for i in range(60)]
    trees = htmltext.fit_pages(pages)
    want = "Title & more\nFirst text.\nSecond paragraph of the page, 7."
    assert htmltext.main_texts(trees, [pages[7], "", PAGE.format(i=7).split("</footer>")[0]]) == [want, "", want]
    df = spark.createDataFrame([(i, "u", p, "clash") for i, p in enumerate([*pages, None, "", "<p", pages[0]])],
                               "page_id long, url string, html string, text string")
    out = htmltext.extract(df, htmltext.fit_extractor(df)).orderBy("page_id").collect()
    assert out[7]["text"] == want and out[60]["text"] == "" and out[61]["text"] == "" and len(out) == 64
    assert htmltext.extract(df.limit(0), htmltext.fit_extractor(df.limit(0))).count() == 0


@pytest.mark.parametrize("n", [199, 200, 201, 2000])
def test_sibling_share_does_not_depend_on_the_number_of_siblings(n):
    kinds = ["p", "p", "p", "h2", "ul"]
    page = "".join(f"<{kinds[i % 5]}>text {i}.</{kinds[i % 5]}>" for i in range(n))
    nodes, blocks = htmltext.parse(f"<body>{page}</body>")
    share = htmltext.features(nodes, blocks)[1:, htmltext.N_FEATURES - 15 + 2]
    tags = [kinds[i % 5] for i in range(n)]
    assert share.tolist() == pytest.approx([tags.count(t) / n for t in tags])


def test_pages_without_weak_label_in_the_first_draw(spark):
    want = lambda i: f"Title & more\nFirst text.\nSecond paragraph of the page, {i}."
    frame = lambda pages: spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    read = lambda df, **k: [r["text"] for r in htmltext.extract(
        df, htmltext.fit_extractor(df, **k)).orderBy("page_id").collect()]
    pages = [PAGE.format(i=i) for i in range(40)]
    assert read(frame(pages), sample_chars=50) == [want(i) for i in range(40)]       # all longer
    plain = ["<div>no mark</div>"] * 60
    assert read(frame(plain + pages), sample_pages=3)[60:] == [want(i) for i in range(40)]
    divs = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    assert read(frame(divs)) == [want(i) for i in range(40)]                         # none has one
    assert read(frame(["", "<p"])) == ["", ""]


def test_decoding_is_the_likeliest_consistent_labelling():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 9))
        nodes = [htmltext.Node("div", int(rng.integers(-1 if i == 0 else 0, max(i, 1))) if i else -1, 0, []) for i in range(n)]
        odds = rng.normal(size=n) * 2
        best = None
        for mask in range(2 ** n):
            keep = [bool(mask >> i & 1) for i in range(n)]
            if any(keep[i] and nodes[i].parent >= 0 and not keep[nodes[i].parent] for i in range(n)):
                continue
            value = sum(-np.logaddexp(0, -odds[i]) if keep[i] else -np.logaddexp(0, odds[i]) for i in range(n))
            if best is None or value > best[0]:
                best = (value, keep)
        assert htmltext.decode(nodes, odds).tolist() == best[1]


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and all(r["round_trip"] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    kept = [texts[r["doc_id"]] for r in rows]
    assert len({hashlib.sha256(t.encode()).digest() for t in kept}) == len(kept)
