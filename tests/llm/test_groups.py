"""Source divergence, embedding near-dedup and centroid clustering against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import SMALL
from treeline.llm import clustering, divergence, embedding_dedup
from treeline.llm.queries import QUERIES

# Source divergence -----------------------------------------------------------------------------


def plain_audit(docs, min_docs, top):
    """docs: (lang, source, text)."""
    find = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+").findall
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    had, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        said = find((text or "").translate(lower))
        had[lang or ""].update(set(said))
        groups[lang or "", source or ""].update(said)
    out = []
    for lang in had:
        kept = [t for t, n in had[lang].items() if n >= min_docs]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        own[None] = sum(own.values(), Counter())
        p = {}
        for s, c in own.items():
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in own:
            if s is None:
                continue
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o not in (None, s)]
            more = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(more)[:top], 1)]
    return sorted(out)


def audited(spark, docs, **more):
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "lang string, source string, text string, id long, term string, row long")
    return sorted(tuple(r) for r in divergence.audit(frame, **more).collect())


@pytest.mark.parametrize("min_docs,top", [(1, 3), (2, 50), (30, 2)])
def test_audit(spark, min_docs, top, monkeypatch):
    rng = random.Random(min_docs)
    words = ["Un", "deux", "TROIS", "quatre5cinq", "é", "ÉÉ", "日本", "a", "b", "c_d", "İ", "퟿", "🙂"]
    docs = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "Ω", "ß", None, "z"]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(150)]
    docs += docs[:5]  # repeated rows
    docs += [("only", "one", "alone alone"), ("mute", "m1", None), ("mute", "m2", "1 2 3"), ("mute", "m3", ""), (None, None, None), ("en", "none", "")]
    assert audited(spark, docs, min_docs=min_docs, top=top) == plain_audit(docs, min_docs, top)


def test_audit_empty(spark):
    assert audited(spark, []) == []
    assert audited(spark, [(None, None, None)]) == []


def test_audit_in_parts_and_long_texts(spark, monkeypatch):
    for name, value in (("PART_BITS", 2), ("PIECE", 50), ("COUNTED", 100)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    docs = [("en", f"s{k % 4}", " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(5))}" for _ in range(300)) + " " + "x" * 170 + " tail") for k in range(12)]
    assert audited(spark, docs, min_docs=2, top=9) == plain_audit(docs, 2, 9)
    text = "a" * 49 + "É" + " b " + "c" * 500 + "-d"
    assert [t for some in divergence.terms(text.encode()) for t in some] == [("a" * 49 + "É").encode(), b"b", b"c" * 500, b"d"]


def test_gallop():
    rng = np.random.default_rng(2)
    for n, m in ((0, 5), (3, 0), (10, 1000), (500, 700), (1000, 1000)):
        short, long = (np.sort(rng.choice(3000, k, replace=False)) for k in (n, m))
        want = {int(x): k for k, x in enumerate(long)}
        assert divergence.gallop(short, long).tolist() == [want.get(int(x), -1) for x in short]


def test_shares_of_huge_counts_are_exact():
    for n, total, kept in ((7 * 10**12, 9 * 10**13, 10**6), (0, 9 * 10**13, 10**7), (0, 0, 1)):
        assert divergence._shares(np.array([n]), total, kept)[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)


# Embedding near-dedup --------------------------------------------------------------------------


def plain_links(rows, threshold=0.93):
    """rows: (vec_id, embedding, label), ids unique -> {vec_id: (links, component)}."""

    def fine(e, label):
        return label is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e)

    own = {k: k for k, *_ in rows}
    count = Counter()
    good = [(k, np.array(e, "f8"), label) for k, e, label in rows if fine(e, label)]

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[i + 1 :]:
            if la == lb and len(x) == len(y) and (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= threshold:
                count[a] += 1
                count[b] += 1
                low, high = sorted((root(a), root(b)))
                own[high] = low
    return {k: (count[k], root(k)) for k, *_ in rows}


def deduped(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, label int, rep long, row long")
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_dedup(frame, **more).collect()}


def near(rng, x, cosine):
    """A unit vector at just that cosine from the unit vector x."""
    y = rng.standard_normal(len(x))
    y -= (y @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def test_near_dedup(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        for _ in range(25):
            x = rng.standard_normal(64)
            x /= np.linalg.norm(x)
            rows += [(x, label)] + [(near(rng, x, c) * rng.uniform(0.1, 9), label) for c in (0.99, 0.96, 0.935, 0.92, 0.5)] + [(x, label + 1)]
        rows += [(rows[-1][0], label)] * 5  # copies
        chain = [rows[-1][0]]
        for _ in range(20):  # a chain: each is near the one before only
            chain.append(near(rng, chain[-1], 0.95))
        rows += [(x, label) for x in chain]
    order = rng.permutation(len(rows))
    rows = [(k, rows[j][0].tolist(), rows[j][1]) for k, j in enumerate(order)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [float("nan")] * 64, 1), (904, [None] + [1.0] * 63, 1), (905, rows[0][1], None)]
    rows += [(906, [float("inf")] + [1.0] * 63, 1), (907, [3e38] * 64, 1), (908, [1e-40] * 64, 1), (909, [1.0] * 3, 1), (910, [2.0] * 3, 1)]
    got, want = deduped(spark, rows), plain_links(rows)
    assert got.keys() == want.keys()
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)
    sure = deduped(spark, rows, recall=1.0)  # every pair is verified
    assert sure == want


def test_near_dedup_blocks(spark, monkeypatch):
    for name, value in (("SMALL_BLOCK", 20), ("BLOCK", 40), ("TILE", 16)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(6)
    middle = rng.standard_normal(16)
    middle /= np.linalg.norm(middle)
    rows = [(k, near(rng, middle, 0.97).tolist() if k % 3 else rng.standard_normal(16).tolist(), 7) for k in range(300)]
    assert deduped(spark, rows, recall=1.0) == plain_links(rows)


def test_near_dedup_repeated_and_empty_rows(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert embedding_dedup.near_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1e300, 1e300], "a"), (1, [1e300, 1e300], "a"), (None, [1e-300, 1e-300], "a"), (None, None, None), (5, [1.0, -1.0], "a")]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("5", 0, "5", True), ("None", 0, "None", True), ("None", 2, "1", False)]


def test_collisions_and_calibration():
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((40, 31)), rng.standard_normal((130, 31))
    assert (embedding_dedup.collisions(a, b, 0.4) == (np.abs(a[:, None] - b[None]) <= 0.4).sum(2)).all()
    half, least = embedding_dedup.calibrated()
    x = np.zeros(64)
    x[0] = 1
    reached = 0
    for k in range(400):  # pairs at the threshold, each with directions of its own
        y = near(np.random.default_rng(k), x, 0.93)
        seen = np.random.default_rng([k, 1]).standard_normal((64, 31))
        reached += (np.abs(x @ seen - y @ seen) <= half).sum() >= least
    assert reached >= 390


def test_unite():
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randrange(1, 60)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(50))]
        want = list(range(n))
        for a, b in links * n:
            want[a] = want[b] = min(want[a], want[b])
        i, j = (np.array([x[k] for x in links], "i8") for k in (0, 1))
        assert embedding_dedup.unite(np.arange(n), i, j).tolist() == want


def test_near_dedup_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op12_embedding_dedup"](spark, SMALL).collect()}
    assert got == plain_links(rows)


# Centroid clustering ---------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, dim=64):
    points = {}
    for key, e in rows:
        if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) and abs(x) < clustering.LIMIT for x in e):
            points[key] = [int(np.floor(1024 * float(np.float32(x)))) for x in e]
    first = sorted(points, key=lambda key: hashlib.sha256(f"3:{key}".encode()).hexdigest())[:k]
    centroids = [points[key] for key in first]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = defaultdict(list)
        for p in points.values():
            own[nearest(p)[1]].append(p)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if own[n] else c for n, c in enumerate(centroids)]
    found = {key: nearest(p) for key, p in points.items()}
    inertia = Counter()
    for d, c in found.values():
        inertia[c] += d
    return {key: (c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for key, (d, c) in found.items()}


def clustered(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, [2]) for r in rows], "vec_id long, embedding array<float>, cluster long, point array<int>")
    return {r.vec_id: tuple(r)[1:] for r in clustering.cluster(frame, **more).collect()}


@pytest.mark.parametrize("k,rounds", [(1, 2), (3, 4), (8, 10), (40, 3)])
def test_clustering(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(j, (rng.standard_normal(6) + 3 * (j % 5)).round(1).tolist()) for j in range(200)] + [(j, [1.0] * 6) for j in range(200, 230)]  # ties and repeated vectors
    rows += [(300, None), (301, [1.0] * 5), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("-inf")] * 6), (305, [65536.0] * 6), (306, [65535.0] * 6), (307, [-65535.0] * 6)]
    assert clustered(spark, rows, k=k, rounds=rounds, dim=6) == plain_clusters(rows, k, rounds, 6)


def test_clustering_few_and_empty(spark):
    assert clustered(spark, []) == {}
    assert clustered(spark, [(1, [1.0])]) == {}
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert clustered(spark, rows) == plain_clusters(rows)
    twice = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [3.0, 3.0])], "vec_id long, embedding array<double>")
    assert clustering.cluster(twice, k=2, dim=2).count() == 3


def test_search_is_exact_and_skips():
    rng = np.random.default_rng(9)
    centroids = rng.integers(-3, 4, (50, 3))
    points = rng.integers(-4, 5, (500, 3))
    best, dist = clustering.search(points, centroids, *clustering.lists(centroids))
    d = ((points[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (dist == d.min(1)).all()
