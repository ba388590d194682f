"""Byte-level BPE, packing and the pipeline."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict
from fractions import Fraction

import public_tokenizers
import pytest

from tests.conftest import SMALL
from treeline.llm import bpe, packing
from treeline.llm.queries import QUERIES

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("ab thé  \n\t'sll12   日本🙂.!?\x1c\u0085 Zz")


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(ours):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def odd_texts(n=6000):
    rng = random.Random(3)
    yield from ["", " ", "\n", " a", "a ", "a  b", "a\n\nb", "<|endoftext|>", "a" * 20000 + "x" * 5000, "don't they'll", " a b"]
    for _ in range(n):
        yield "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30)))


def test_same_ids_as_tiktoken(ours, theirs):
    for t in odd_texts():
        assert ours.encode(t).tolist() == theirs.encode_ordinary(t), t


def test_same_ids_on_random_bytes(ours, theirs):
    rng = random.Random(9)
    for _ in range(2000):
        data = bytes(rng.choice(b"aeiothns \xc3\xa9") for _ in range(rng.randint(1, 40)))
        assert b"".join(ours.tokens[i] for i in ours.encode_piece(data)) == data
        if data not in ours.ranks:
            assert ours.encode_piece(data) == ours.merge(data)


def test_compatibility_is_what_merging_says(ours):
    rng = random.Random(4)
    ids = [i for i in ours.right if len(ours.tokens[i]) < 9]
    for _ in range(20000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert ours.fit(a, b) == (ours.merge(ours.tokens[a] + ours.tokens[b]) == [a, b])


def test_unit_cache_keeps_results_when_full(theirs):
    small = bpe.UnitCache(bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN).cache.encode_units, limit=50)
    for t in odd_texts(500):
        assert list(struct.unpack(f"<{len(small.ids(t)) // 4}I", small.ids(t))) == theirs.encode_ordinary(t)


def test_tokenizers_units():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    units = packing.tokenizer(JSON)
    for t in odd_texts(3000):
        ids = made.encode(t, add_special_tokens=False).ids
        assert units.ids(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_bpe_query(spark, theirs):
    got = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids, r = theirs.encode_ordinary(d.text), got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_bpe_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "ab", "z")], "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in out) == [(1, b""), (2, b""), (2, b"ab")]
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def check_pieces(rows, window=1024):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for ps in docs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == ps[0].doc_tokens
    sizes = []
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    assert max(sizes) <= window and sum(s < window for s in sizes) <= 1
    assert sorted(seqs) == list(range(len(seqs)))
    return docs, seqs


def test_packing_query(spark):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(JSON)
    rows = QUERIES["op9_packing"](spark, SMALL).collect()
    docs, _ = check_pieces(rows)
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = [*made.encode(d.text, add_special_tokens=False).ids, 0]
        for p in docs[d.doc_id]:
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[p.start : p.start + p.length]))
            assert p.doc_tokens == len(ids)


@pytest.mark.parametrize("targets", [None, {"src1": 5, "src2": 1, "src3": 0.5}, {f"src{k}": 1 for k in range(20)}, {"nowhere": 1}])
def test_packing_targets(spark, targets):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    rows = packing.pack(df, JSON, 0, window=256, targets=targets).drop("ids").collect()
    _, seqs = check_pieces(rows, 256)
    total = defaultdict(int)
    for r in rows:
        total[r.source] += r.length
    if targets is None:
        for ps in seqs.values():
            size = sum(p.length for p in ps)
            for s in total:
                assert abs(sum(p.length for p in ps if p.source == s) - size * total[s] / sum(total.values())) < 6
    elif "src2" in targets and len(targets) == 3:
        first = defaultdict(int)
        for p in seqs[0]:
            first[p.source] += p.length
        assert first["src1"] > 4 * first["src2"] > 0 and set(first) <= set(targets)


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, "", "a", 1), (2, "hello world", "a", 1), (3, "x " * 20000, "b", 1)], "doc_id long, text string, source string, n long")
    rows = packing.pack(df, JSON, 0, window=64).collect()
    assert sum(r.length for r in rows) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in rows}.values())
    whole = packing.sequences(packing.pack(df, JSON, 0, window=64)).collect()
    assert sorted(len(r.input_ids) // 4 for r in whole)[1:] == [64] * (len(whole) - 1)
    assert packing.pack(df.limit(0), JSON, 0).count() == 0


def test_share_is_monotone_and_exact():
    weights = [5, 0, 1, 1000, 3, 77]
    rows = [packing.share(x, weights, lambda x, a, b: x * a // b) for x in range(sum(weights) + 1)]
    assert rows[-1] == weights
    for a, b in zip(rows, rows[1:]):
        assert sum(b) - sum(a) == 1 and all(y >= x for x, y in zip(a, b))


def test_pipeline_against_plain_version(spark, tmp_path):
    """Every stage on what the one before it kept, against a plain version of its decision."""
    import corpus_pipeline as pipe
    from tests.llm.test_dedup import brute_exact, brute_join

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in pipe.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(pipe.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == pipe.COLUMNS
        after = {r.doc_id for r in docs.collect()}
        if name == "exact dedup":
            assert after == {i for i, (keep, _) in brute_exact([(i, r.text) for i, r in before.items()]).items() if keep == i}
        elif name == "n-gram Jaccard join":
            assert after == {i for i, (root, _) in brute_join([(i, r.text) for i, r in before.items()]).items() if root == i}
        else:
            assert after <= set(before) and (k == 0 or after == set(before))
    check_pieces(docs.collect())
    got = pipe.run(spark, SMALL)
    assert got.count() == docs.count()


def test_packing_targets_of_small_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 10)
    rows = [(k, "some words of a text " * 40, "big") for k in range(20)] + [(100, "rare words " * 20, "small"), (101, "other words " * 10, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, seqs = check_pieces(packing.pack(df, JSON, 0, window=128, targets={"big": 3, "small": 1}).collect(), 128)
    first = [sum(p.length for p in seqs[0] if p.source == s) for s in ("big", "small", "tiny")]
    assert abs(first[1] - 32) <= 2 and first[2] == 0 and first[0] > 90
    assert {p.source for p in seqs[max(seqs)]} == {"tiny"}


def test_hundreds_of_sources(spark):
    """Every queue is cut as the closed form says, and what a task keeps of the plan stays bounded."""
    rng = random.Random(11)
    totals = [rng.randrange(1, 40) for _ in range(300)]
    plan = packing.Plan(64, packing.Plan.phases(totals, [Fraction(n) for n in totals]))
    filler = packing.Filler(plan)
    seen, hint = {}, {}
    for q, n in enumerate(totals):
        for start, length, sequence, offset in filler.pieces(q, 0, n, hint):
            for a, k, w, o in zip(start.tolist(), length.tolist(), sequence.tolist(), offset.tolist()):
                seen.setdefault(w, []).append((o, k, q, a))
    held = sum(x.nbytes for g in filler.groups.values() for x in g)
    assert held < 200_000_000 and len(filler.groups) <= filler.kept
    taken = dict.fromkeys(range(300), 0)
    for w in sorted(seen):
        at = 0
        for o, k, q, a in sorted(seen[w]):
            assert (o, a) == (at, taken[q])
            at, taken[q] = at + k, a + k
        assert at == 64 or w == max(seen)
    assert [taken[q] for q in range(300)] == totals
    df = spark.createDataFrame([(k, f"s{k % 200}", "some words") for k in range(4000)], "doc_id long, source string, text string")
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), 0).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values()) and len({r.doc_id for r in got}) == 4000
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
