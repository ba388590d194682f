"""Line dedup, exact dedup and the Jaccard join against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from tests.conftest import SMALL
from treeline.llm import exact_dedup, fingerprint, jaccard_join, line_dedup

ODD = [(1, "a b c"), (2, "abc "), (3, "abd"), (4, None), (5, ""), (6, "xyz"), (7, "xy z  "), (8, " \n\t"), (9, "q" * 5000), (10, "q" * 5000), (11, "é日🙂"), (12, "é 日\x0b🙂")]
EXTRA = "doc_id long, text string, key string, print string, n long, path long, want string"


def extra(spark, rows):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "k", "p", 1, 2, "w") for k, t in rows], EXTRA)


def test_fingerprints_compose():
    rng = random.Random(1)
    data = rng.randbytes(200_000)
    whole = fingerprint.of(data)
    for _ in range(20):
        a, b = sorted(rng.randrange(len(data)) for _ in range(2))
        left, mid, right = (fingerprint.of(x) for x in (data[:a], data[a:b], data[b:]))
        assert left.then(mid).then(right) == left.then(mid.then(right)) == whole
    p = fingerprint.MODULI[0]
    assert fingerprint.of(b"ab").hashes[0] == (97 * fingerprint.BASE + 98) % p


def brute_exact(rows):
    groups = defaultdict(list)
    for k, t in rows:
        t = t or ""
        groups["".join(c for c in t if c not in " \t\n\v\f\r")].append((-len(t), k))
    return {k: (min(g)[1], len(g)) for g in groups.values() for _, k in g}


@pytest.mark.parametrize("moduli", [fingerprint.MODULI, (2,), (5, 3)])
def test_exact_dedup(spark, moduli):
    got = exact_dedup.exact_dedup(extra(spark, ODD), moduli=moduli, chunk=3, segment=4).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == brute_exact(ODD)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got) and len(got) == len(ODD)


def test_exact_dedup_large_group_and_ties(spark):
    rows = [(k, "same text" + " " * (k % 3)) for k in range(700)] + [(1000 + k, f"own {k}") for k in range(50)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == brute_exact(rows)


def test_exact_dedup_empty_and_repeated_rows(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(1, 2, False), (1, 2, True), (2, 1, True)]  # one of equal rows stays


def plain_chunks(lines):
    """All chunks (first, last) of two lines and more: cut where the top bit of a roll over two hashes is 0."""
    hashes, out = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lines], set()
    for k in range(6):
        factor, at = int.from_bytes(hashlib.blake2b(b"roll %d" % k, digest_size=8).digest(), "little") | 1, 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or ((hashes[i - 1] * factor + hashes[i]) * factor) % 2**64 < 2**63:
                if i - at > 1:
                    out.add((at, i - 1))
                at = i
    return out


def brute_lines(rows):
    """Lines go if they lie in a run of neighbours that occurred before, around a chunk that did."""
    pairs, had, out = set(), set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[k] = None
            continue
        lines = t.split("\n")
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        runs = []
        for i, j in zip(worded, worded[1:]):
            if (lines[i], lines[j]) in pairs:
                runs = [*runs[:-1], [*runs[-1], j]] if runs and runs[-1][-1] == i else [*runs, [i, j]]
            pairs.add((lines[i], lines[j]))
        run_of, gone = {i: n for n, r in enumerate(runs) for i in r}, set()
        for i, j in sorted(plain_chunks(lines)):
            inside, body = [w for w in worded if i <= w <= j], tuple(lines[i : j + 1])
            if len(inside) > 1:
                if body in had and len({run_of.get(w) for w in inside}) == 1 and inside[0] in run_of:
                    gone |= {*range(runs[run_of[inside[0]]][0], runs[run_of[inside[0]]][-1] + 1)}
                had.add(body)
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    passage = "\n".join(f"shared line {i} of a passage" for i in range(30))
    rows = [(k, "\n".join([*(f"own {k} {rng.random()}" for _ in range(rng.randint(0, 9))), *([passage] if k % 2 else []), "the end"])) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, "x"), (105, "x"), (106, rows[3][1]), (107, "long\n" * 3000)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(extra(spark, rows)).collect()}
    want = brute_lines(rows)
    assert {k: r.text for k, r in got.items()} == want
    assert got[5].removed_lines > 15 and got[102].removed_lines == 0 and got[100].n_lines == 0
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_on_documents(spark):
    from treeline.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.text for r in QUERIES["op1_line_dedup"](spark, SMALL).collect()}
    assert got == brute_lines(docs)


def test_chunk_boundaries_shift():
    rng = random.Random(5)
    lines = [f"{rng.random()}".encode() for _ in range(200)]
    moved = [b"new", b"lines", *lines]
    for one, two in zip(line_dedup.chunks(lines), line_dedup.chunks(moved), strict=True):
        assert one[0][0] == 0 and one[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(one, one[1:]))
        assert [(i + 2, j + 2) for i, j in one[1:]] == two[-len(one) + 1 :] and len({j - i for i, j in one}) > 3
    text = [x.decode() for x in lines]
    assert {(i, j - 1) for one in line_dedup.chunks(lines) for i, j in one if j - i > 1} == plain_chunks(text)


def brute_join(rows, threshold=0.8):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().split()
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()
    by, links, up = defaultdict(list), defaultdict(int), {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for o in by[x]:
                both[o] += 1
            by[x].append(k)
        for o, n in both.items():
            if n >= threshold * (len(s) + len(sets[o]) - n) - 1e-9:
                links[k] += 1
                links[o] += 1
                a, b = find(k), find(o)
                up[max(a, b)] = min(a, b)
    return {k: (find(k), links[k]) for k in sets}


def test_jaccard_join(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for k in range(350):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = rng.choice(words)
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join(base[:15] + [rng.choice(words) for _ in range(60)])) for k in range(350, 500)]
    rows += [(700, None), (701, ""), (702, "a b"), (703, "a  b"), (704, rows[5][1]), (705, "solo")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(extra(spark, rows), bucket=64, block=100).collect()}
    want = brute_join(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(v[1] for v in got.values()) >= jaccard_join.RECALL * sum(v[1] for v in want.values())


def test_jaccard_join_on_documents(spark):
    from treeline.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op5_ngram_jaccard_join"](spark, SMALL).collect()}
    assert got == brute_join(docs)
    assert jaccard_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    from treeline.llm.components import components

    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = {x: find(x) for x in up}
    assert {k: got.get(k, k) for k in want} == want


NULLS = "doc_id long, text string"


def test_exact_dedup_null_and_shared_keys(spark):
    rows = [(None, "a b"), (1, "a b"), (2, "ab"), (None, "c  d"), (3, "cd"), (None, "solo"), (5, "A"), (6, "A"), (5, "B"), (6, "B"), (None, "z"), (None, "z")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, NULLS)).collect()
    assert len(got) == len(rows)
    kept = [(r.doc_id, r.keep_id, r.group_size) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted([(1, 1, 3), (None, None, 2), (None, None, 1), (5, 5, 2), (5, 5, 2), (None, None, 2)], key=str)
    assert sorted(r.keep_id for r in got if r.keep_id is not None) == [1, 1, 1, 5, 5, 5, 5]
    odd = exact_dedup.exact_dedup(spark.createDataFrame(rows, NULLS), moduli=(2,), chunk=3, segment=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, odd), key=str)


def test_jaccard_join_null_and_shared_keys(spark):
    words = [f"w{k}" for k in range(100)]
    base, other = " ".join(words), " ".join(words[::-1])
    rows = [(None, base), (7, base), (4, base + " x"), (5, "one text of a key"), (5, other), (6, other + " y"), (None, "alone without a key"), (None, ""), (8, "")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, NULLS)).collect()
    want = [(None, 4, 7, 2), (7, 4, 7, 2), (4, 4, 4, 2), (5, 5, 5, 0), (5, 5, 5, 1), (6, 5, 6, 1), (None, None, None, 0), (None, None, None, 0), (8, 8, 8, 0)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pipeline_keeps_null_and_shared_keys(spark):
    import corpus_pipeline as pipe

    base = " ".join(f"w{k}" for k in range(100))
    rows = [(None, base), (1, "a b"), (None, "a b"), (None, "c  d"), (3, "cd"), (5, "A"), (6, "A"), (5, "B"), (6, "B"), (7, base + " x"), (8, "q"), (8, "q")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = pipe.drop_exact_copies(spark, docs, "")
    want = [(None, base), (1, "a b"), (None, "c  d"), (5, "A"), (5, "B"), (7, base + " x"), (8, "q")]
    assert sorted([(r.doc_id, r.text) for r in exact.collect()], key=str) == sorted(want, key=str)
    near = pipe.drop_near_copies(spark, exact, "")
    assert sorted([(r.doc_id, r.text) for r in near.collect()], key=str) == sorted(want[1:], key=str)


def test_short_passages_leave_the_text(spark):
    """A passage of some lines in two texts of otherwise own lines: the share that leaves ``text`` whole."""
    rng, rows, sizes = random.Random(6), [], {}
    for k in range(6000):
        size = (2, 3, 4, 5, 6, 12)[k % 6]
        own = [[f"{k} {rng.random()}" for _ in range(n)] for n in (size, rng.randint(3, 9), 6, rng.randint(3, 9), 6)]
        rows += [(2 * k, "\n".join(own[1] + own[0] + own[2])), (2 * k + 1, "\n".join(own[3] + own[0] + own[4]))]
        sizes[2 * k + 1] = size
    got = {r.doc_id: r.removed_lines for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] in (0, n) for k, n in sizes.items()) and not any(got[k] for k in got if k % 2 == 0)
    share = {n: sum(got[k] > 0 for k in sizes if sizes[k] == n) / 1000 for n in (2, 3, 4, 5, 6, 12)}
    assert all(share[n] >= least for n, least in ((2, 0.28), (3, 0.65), (4, 0.9), (5, 0.97), (6, 0.99), (12, 0.999))), share


def test_jaccard_join_at_a_lower_threshold(spark):
    rng = random.Random(8)
    rows = []
    for k in range(80):
        w = [f"{k}-{i}" for i in range(104)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: 68 + k % 10] + [f"own {rng.random()}" for _ in range(13)]))]
    want, got = brute_join(rows, 0.5), jaccard_join.jaccard_join(spark.createDataFrame(rows, NULLS), threshold=0.5).collect()
    assert sum(v[1] for v in want.values()) > 100
    assert sum(r.n_links for r in got) >= 0.97 * sum(v[1] for v in want.values())
    assert all(r.n_links <= want[r.doc_id][1] for r in got)
    assert jaccard_join.likely_for(0.99, 0.8) == 38 and jaccard_join.likely_for(0.99, 0.5) < 20


def brute_runs(rows):
    """Lines go if they lie in two neighbouring worded lines that occurred before."""
    had, out = set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[k] = None
            continue
        lines, gone = t.split("\n"), set()
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        for i, j in zip(worded, worded[1:]):
            if (lines[i], lines[j]) in had:
                gone |= {*range(i, j + 1)}
            had.add((lines[i], lines[j]))
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_runs(spark):
    rng = random.Random(11)
    shared = [[f"passage {p} line {i} {rng.random()}" for i in range(n)] for p, n in enumerate((1, 2, 2, 3, 4, 6))]
    rows = []
    for k in range(80):
        blocks = [[f"own {k} {rng.random()}"] for _ in range(rng.randint(1, 6))]
        for p in rng.sample(shared, rng.randint(0, 3)):
            blocks.insert(rng.randint(0, len(blocks)), p if k % 3 else [x for line in p for x in (line, "", " ")])
        rows.append((k, "\n".join(x for b in blocks for x in b)))
    rows += [(100, None), (101, ""), (102, "long\n" * 2000), (103, rows[7][1]), (104, "x\ny"), (105, "x\ny")]
    got = line_dedup.line_dedup(extra(spark, rows)).collect()
    want = brute_runs(rows)
    assert {r.doc_id: r.text_without_runs for r in got} == want
    sizes = {k: len(t.split("\n")) if t is not None else 0 for k, t in rows}
    assert all(r.run_lines == sizes[r.doc_id] - (len(want[r.doc_id].split("\n")) if want[r.doc_id] else 0) for r in got if r.doc_id < 100)
    late = [r for r in got if 5 < r.doc_id < 80]
    assert not any(r.text_without_runs.count(f"passage {p} ") for r in late for p in (1, 2, 3, 4, 5) if r.doc_id > 40)


def test_line_runs_on_documents(spark):
    from treeline.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {r.doc_id: r.text_without_runs for r in QUERIES["op1_line_dedup"](spark, SMALL).collect()} == brute_runs(docs)


def test_line_dedup_shared_keys_and_names(spark):
    """Rows that share a key keep their own unique lines; internal names may be columns of the input."""
    passage = "\n".join(f"line {i} of all" for i in range(12))
    unique = "\n".join(f"unique {i}" for i in range(12))
    rows = [(1, passage), (2, passage), (2, unique), (None, passage), (None, unique + " more"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(k, t, 1, "p", 5) for k, t in rows], "doc_id long, text string, row long, pairs string, `first` int").withColumn("__want", F_lit())
    got = line_dedup.line_dedup(df).collect()
    assert sorted(((r.doc_id, r.text_without_runs) for r in got), key=str) == sorted([(1, passage), (2, ""), (2, unique), (None, ""), (None, unique.replace("unique 11", "unique 11 more").split("\n")[11]), (3, "x"), (3, "x")], key=str)
    assert [r.text for r in got if r.doc_id == 2 and r.text_without_runs] == [unique] and all(r["row"] == 1 and r["pairs"] == "p" for r in got)


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("w")


def test_line_removal_is_linear(spark):
    import time

    text = "\n".join(f"{k} line" for k in range(100_000))
    began = time.time()
    got = line_dedup.line_dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted(len(r.text_without_runs) for r in got) == [0, len(text)] and time.time() - began < 60


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_jaccard_join_dense_and_split_nodes(spark, threshold):
    """A large group of near copies (united, in blocks) and a passage in many texts (split)."""
    rng = random.Random(12)
    base, passage = [f"b{i}" for i in range(90)], [f"p{i}" for i in range(40)]
    rows = []
    for k in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(90)] = f"edit {rng.random()}"
        rows.append((k, " ".join(w)))
    for k in range(500, 800):
        own = [f"{k}-{i}" for i in range(40)]
        rows.append((k, " ".join(own[:20] + passage + own[20:])))
        if k % 5 == 0:
            rows.append((k + 1000, " ".join(own[:20] + passage + own[20:] + ["more"])))
    want = brute_join(rows, threshold)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, NULLS), threshold=threshold, bucket=50, block=200).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(v[1] for v in got.values()) >= jaccard_join.RECALL * sum(v[1] for v in want.values())
