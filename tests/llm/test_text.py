"""Pseudonyms, quality rules, chat formatting, toxicity and language-model scoring."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL, rows_of
from treeline.llm import chat, pii, quality, suffix_tree, toxicity
from treeline.llm.queries import ORACLE_SQL, QUERIES

KEY = "test key"


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL)))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)


VALUES = [
    "the.72@mail3.example.com", "4952935900253052", "4111 1111 1111 1111", "3782-822463-10005", "+1 (017) 555-7713", "(415) 555-2671", "+33 6 12 34 56 78",
    "97.51.17.173", "255.0.0.1", "078-05-1120", "GB82 WEST 1234 5698 7654 32", "1999-12-31", "31.12.1999", "12/31/1999", "29.02.2000", "1/2/2003", "x@y.io",
]
LEFT = ["9807915762804491", "999.1.1.1", "2023-02-30", "000-12-3456", "GB83 WEST 1234 5698 7654 32", "Version 2.0.", "4.0.0", "12345", "a@b", "0000-00-00", "31/31/1999"]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    rows = [(k, f"before {v}, after {v}$$$") for k, v in enumerate(VALUES)] + [(100 + k, f"keep {v} here") for k, v in enumerate(LEFT)]
    rows += [(200, None), (201, ""), (202, "no digits " * 3000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, _found string, n long")
    out = pii.pseudonymise(df, KEY)
    got = {r.doc_id: r for r in out.collect()}
    for k, v in enumerate(VALUES):
        new = got[k].text
        one, two = re.fullmatch(r"before (.*), after (.*)\$\$\$", new).groups()
        assert one == two != v and len(got[k]._pii) == 2
        if "/" not in v and not re.fullmatch(r"[\d.]+", v):
            assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", one))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", v)))
    for k in (1, 2, 3):
        assert luhn(re.search(r"before (.*),", got[k].text)[1])
    for k, v in enumerate(LEFT):
        assert got[100 + k].text == f"keep {v} here", v
    assert got[200].text is None and got[201].text == "" and got[202].text == rows[-1][1]
    back = {r.doc_id: r.text for r in pii.pseudonymise(out.drop("_pii"), KEY, reverse=True).collect()}
    assert back == dict(rows)
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "another key").collect()}
    assert sum(other[k] != got[k].text for k in range(len(VALUES))) >= len(VALUES) - 1


def test_permutations_are_bijective(spark):
    df = spark.range(1000).select(F.format_string("%03d", "id").alias("s"), (F.col("id") % 27).alias("a"), F.floor(F.col("id") / 27).alias("b"))
    out = df.select(pii.feistel_text(F.col("s"), KEY, "t").alias("t"), pii.feistel_pair(F.col("a"), F.col("b"), 27, 38, KEY, "p").alias("p")).collect()
    assert len({r.t for r in out}) == 1000 and all(re.fullmatch(r"\d{3}", r.t) for r in out)
    assert len({(r.p.a, r.p.b) for r in out}) == 1000 and all(0 <= r.p.a < 27 and 0 <= r.p.b < 38 for r in out)


def test_pii_is_native(spark):
    plan = QUERIES["op3_pii"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, cov = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            cov |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov)


def test_quality_counts(spark):
    texts = [None, "", "a", "a b", "a b c a b c", "a a a a", "x\ny\nx\n\n \n", "é 日 # $ | <b>", "a b c d a b c", "\x0bq\x0c r\ts", "same line\n" * 50, "w " * 5000, " ".join(str(k % 7) for k in range(3000))]
    df = spark.createDataFrame([(k, t, 7, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_words long, _w string")
    for r in quality.score_quality(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.score_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_against_labels(spark):
    got = quality.score_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1 and not r.base_failed], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.02 * len(bad)


CHATS = [
    (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "a<\\|b"), (1, 2, "assistant", "<|im_start|>assistant\nok"), (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", "last"),
    (2, 0, "assistant", None), (3, None, None, "x"), (3, 0, "a b\n<|", "y"), (4, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, "assistant", "é🙂" * 1000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "t", 3) for r in CHATS], "conv_id long, turn long, role string, text string, turns string, example long")
    out = chat.expand_chat(df)
    got = out.select("*", chat.read_turns(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss")).collect()
    for conv in {r[0] for r in CHATS}:
        turns = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in CHATS if r[0] == conv))
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.example)
        assert [(x.role, x.text) for x in mine[-1]["read"]] == [t[1:] for t in turns]
        assert [r.loss for r in mine if r.loss_length is not None] == [t[2] for t in turns if t[1] == "assistant"]
        for r in mine:
            assert len(r["read"]) == r.n_turns and r.formatted.count("<|im_start|>") == r.n_turns
    assert chat.expand_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_is_native(spark):
    plan = QUERIES["op8_chat_formatting"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_kernel_tolerates_gaps():
    near, far = toxicity.kernel(["idiot", "idxiot", "iidiot", "table"], ["idiot"])[:, 0][1:3], toxicity.kernel(["table"], ["idiot"])[0, 0]
    assert toxicity.kernel(["clown"], ["clown"])[0, 0] == pytest.approx(1, abs=0.1)
    assert min(near) > 0.4 and far < 0.1
    assert toxicity.parts("i-d.i_o*t!!!") == ["idiot"] and ["idiot"] in toxicity.sentences("you i d i o t you")


def test_toxicity_held_out(spark):
    rows = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tox, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    english = [r for r in tox if r.lang == "en"]
    assert sum(r.predicted for r in english) >= 0.7 * len(english)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 0), (3, "x " * 50000, 2)], "doc_id long, text string, score long")
    for machine in (toxicity.fit([], []), toxicity.fit(["a b"] * 3, [0, 0, 0])):
        assert [r.score for r in toxicity.score(df, machine).collect()] == [0.0] * 3
    assert toxicity.score(df.limit(0), toxicity.fit([], [])).count() == 0


def test_suffix_tree_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    depth, p_min = 3, 1e-3
    model = suffix_tree.train(spark.createDataFrame([(t,) for t in texts], "text string"), depth=depth, p_min=p_min)
    counts = {}
    for t in texts:
        s = suffix_tree.END * depth + suffix_tree.symbols(t)
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    total, stay = sum(counts[b""].values()), {b""}
    for ctx, c in counts.items():
        n = sum(c.values())
        if ctx and n >= max(1, p_min * total):
            up = counts[ctx[1:]]
            gain = sum(x * math.log((x / n) / (up[a] / sum(up.values()))) for a, x in c.items())
            if gain > len(c) * suffix_tree.KIND_COST * math.log(total + 1):
                stay |= {ctx[j:] for j in range(len(ctx) + 1)}

    def prob(ctx, a):
        c = counts[ctx]
        novel = suffix_tree.NOVEL * len(c)
        return (c[a] + novel * (prob(ctx[1:], a) if ctx else 1 / 256)) / (sum(c.values()) + novel)

    def score(t):
        s, out = suffix_tree.END * depth + suffix_tree.symbols(t), 0.0
        for i in range(depth, len(s)):
            h = s[i - depth : i]
            while h not in stay:
                h = h[1:]
            out += math.log10(prob(h, s[i]))
        return out

    tests = [texts[3], texts[20][:3000], "", "日本 XYZ", "unseen \x00 bytes"]
    assert model.scores(tests) == pytest.approx([score(t) for t in tests], rel=1e-4)
    assert len(stay) > 20


def test_lm_query_against_brute_force(spark):
    import zlib

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op7_lm_scoring"](spark, SMALL).collect()}
    c = Counter()
    for d in docs:
        if zlib.crc32(str(d.doc_id).encode()) % 10:
            c.update(suffix_tree.tokens(d.text))
    n, v = sum(c.values()), len(c)
    for d in docs:
        r, toks = got[d.doc_id], suffix_tree.tokens(d.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(toks), sum(t in c for t in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks))
        assert r.score < 0 and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 10 == 0)


def test_lm_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "a A b", 6)], "doc_id long, text string, n long")
    none = df.limit(0)
    model, counts = suffix_tree.train(none), suffix_tree.unigrams(none)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in suffix_tree.score(df, model, counts).collect())
    one = round(math.log10(1 / 256), 6)
    assert got[:2] == [(1, 1, 0, 0, one)] * 2 and got[2][:4] == (2, 4, 0, 0)
    assert suffix_tree.score(none, model, counts).count() == 0


def test_sha_of_probe(spark):
    r = QUERIES["op8_chat_formatting"](spark, SMALL).filter("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_toxicity_learns_from_all_toxic_rows():
    clean = [f"you clean person stand by window {k % 50}" for k in range(600)]
    early, late = ["you grobnik person"] * (toxicity.CLEAN_SENTENCES + 10), ["you zwaffel person"] * 40
    machine = toxicity.fit(clean + early + late, [0] * 600 + [1] * (len(early) + len(late)))
    early_word, late_word = machine.words(["grobnik", "zwaffel"])
    assert late_word > 0.5 * early_word > 0


def test_lm_beats_word_counts_held_out(spark):
    rows = [r for r in QUERIES["op7_lm_scoring"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(rows) > 50
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_tree_dealt_to_several_automata(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    df = spark.createDataFrame([(k, t, "w") for k, t in enumerate(texts)], "word long, text string, _row string")
    one = suffix_tree.train(df, min_count=30)
    many = suffix_tree.Tree(one.rows, one.depth, 4)
    assert many.scores(texts[:20]) == pytest.approx(one.scores(texts[:20]), rel=1e-6)
    counts = suffix_tree.unigrams(df)
    a, b = ({r.word: (r.score, r.base_score, r._row) for r in suffix_tree.score(df, m, counts, key="word", carry=("_row",)).collect()} for m in (one, many))
    assert set(a) == set(b) == set(range(len(texts)))
    assert all(a[k] == (pytest.approx(b[k][0]), pytest.approx(b[k][1]), "w") for k in a)
    assert one.rows.select("d", "ctx").distinct().count() < suffix_tree.train(df, min_count=5).rows.select("d", "ctx").distinct().count()


def test_suffix_tree_automaton_is_small(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(600).collect()]
    model = suffix_tree.train(spark.createDataFrame([(t,) for t in texts], "text string"), min_count=5)
    shard = model.automaton(0)
    scores = shard.scores([*texts[:50], "Zq\x01 \u4e2d", ""])
    assert shard.given is None  # the automaton took their place
    parts = [*vars(shard.built).values(), *vars(getattr(shard.built, "entries", shard.built)).values()]
    held = sum(x.nbytes for x in {id(x): x for x in parts if isinstance(x, np.ndarray)}.values())
    contexts, width = model.rows.agg(F.count_distinct("d", "ctx"), F.count_distinct("a")).first()
    assert held < 0.75 * 8 * contexts * width  # of following states and probabilities for all symbols
    for whole in (0, suffix_tree.DEPTH):
        monkeypatch.setattr(suffix_tree, "WHOLE", whole)
        monkeypatch.setattr(suffix_tree, "AT_ONCE", 100)
        assert model.automaton(0).scores([*texts[:50], "Zq\x01 \u4e2d", ""]) == pytest.approx(scores, rel=1e-6)
