"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is the byte sequence of its words (ASCII lower case, joined by one space) and an end symbol.
The tree holds contexts of up to DEPTH bytes, across words.  Training:

1. Tasks count all windows of DEPTH + 1 bytes of the training texts, and Spark sums them up; shorter
   windows are sums of these.
2. A context seen often enough is a candidate: once in RARE positions, but from MIN_COUNT sightings on in any
   corpus and never for fewer than LEAST_COUNT, so a small corpus has a tree too and a large one a larger one.
3. Divergence test: a context stays if the information that it adds over its suffix, its count times
   the Kullback-Leibler divergence of the two next-symbol distributions, exceeds the cost of
   describing it, KIND_COST of its number of next symbols times the log of all positions.  Suffixes of
   what stays stay.
4. Next-symbol distributions are smoothed towards the suffix's, the root's towards all 256 bytes
   alike, so the probabilities of all texts sum to one.  The suffix weighs as much as NOVEL sightings
   for each next symbol of a context (Witten-Bell's rule is NOVEL = 1).

KIND_COST and NOVEL were chosen within the training rows: learned from remainders 1 to 8, judged on 9.

Scoring walks an automaton whose state is the longest suffix of the history among the contexts, many
stretches of text at a time; each stretch is led in by the DEPTH bytes before it, which fix its state.
The states and their following states are a table; probabilities are held by the longer contexts for
the symbols seen there only and found by the place of a bit, all others follow from the suffix.
The tree is a written table.  It is dealt to as many automata as keep each under SHARD_BYTES, were each
context to hold 8 bytes for all symbols (it takes about a third of that), by the last two bytes of the contexts: a position is scored by the automaton of the two bytes before it, which
has all contexts that end so.  Each is sent to the tasks on its own, and texts are read once for each.

``unigrams`` is the smoothed word baseline.  The most frequent words, at most HEAVY (all those above
some power of two), are looked up in each task; all others go through a join on the word, so neither
the vocabulary nor a frequent word lands in one place.

Null text counts as empty: the end symbol alone.  Rows are scored one by one, repeated ones too.
Without a training text all 256 bytes are alike, and the baseline has no known token.  Only key and
text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.bpe import slices
from treeline.llm.common import written

DEPTH = 6  # depth + 1 bytes make a code of 56 bits
MIN_COUNT, LEAST_COUNT, RARE = 100, 3, 1_000_000
KIND_COST, NOVEL = 0.1, 4.0
SHARD_BYTES = 192_000_000
HEAVY = 200_000
STRETCH = 512
WHOLE = 4  # contexts up to this depth hold probabilities of all symbols
AT_ONCE = 10_000  # contexts that are built together
TOGETHER = 12_000  # positions whose probabilities are looked up together: more of them leave the cache
END = b"\n"  # never part of a word
_FLUSH = 300_000


def symbols(text: str) -> bytes:
    return b" ".join(text.encode().lower().split()) + END


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def count_windows(df: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """Rows (code bigint, n): windows of depth + 1 bytes, the history of a text begins with END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, "i8"), np.zeros(0, "i8")

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])

        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                seqs = [symbols(t) for t in batch.column("text").to_pylist()]
                data = np.frombuffer(b"".join(END * depth + s for s in seqs), "u1")
                real = np.ones(len(data), bool)
                starts = np.cumsum([0, *(len(s) + depth for s in seqs)])[:-1]
                for k in range(depth):
                    real[starts + k] = False
                code = np.zeros(len(data) - depth, "i8")
                for k in range(depth + 1):
                    code = code << 8 | data[k : len(data) - depth + k]
                new, n = np.unique(code[real[depth:]], return_counts=True)
                both = np.concatenate([codes, new])
                codes, back = np.unique(both, return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, n])).astype("i8")
                if len(codes) > 4 * _FLUSH:
                    yield out()
                    codes, counts = np.zeros(0, "i8"), np.zeros(0, "i8")
        if len(codes):
            yield out()

    rows = _texts(df, text).mapInArrow(run, "code bigint, n bigint")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


class Entries:
    """The probabilities (log10) that contexts have of their own, by context * width + symbol: a bit for each
    that there is, and how many there are before each 64 of them.  All others are those of the suffix times
    the share that a context leaves to it."""

    def __init__(self, contexts: int, width: int, size: int):
        words = contexts * width // 64 + 1
        self.width, self.size, self.contexts = width, 0, 0
        self.bits, self.before, self.logp = np.zeros(words, "u8"), np.zeros(words, "i4"), np.zeros(size + 1, "f4")
        self.up, self.left = np.zeros(contexts, "i4"), np.zeros(contexts, "f4")

    def add(self, contexts: np.ndarray, symbols: np.ndarray, logp: np.ndarray, up: np.ndarray, left: np.ndarray) -> None:
        """More entries, in order, of the next contexts, whose suffixes and shares (log10) are up and left."""
        keys = contexts.astype("i8") * self.width + symbols
        words = keys >> 6
        starts = np.flatnonzero(np.diff(words, prepend=-1))
        new = self.bits[words[starts]] == 0  # else the first word goes on
        self.before[words[starts][new]] = self.size + starts[new]
        self.bits[words[starts]] |= np.bitwise_or.reduceat(np.uint64(1) << (keys & 63).astype("u8"), starts)
        self.logp[self.size : self.size + len(logp)] = logp
        self.up[self.contexts : self.contexts + len(up)], self.left[self.contexts : self.contexts + len(up)] = up, left
        self.size, self.contexts = self.size + len(logp), self.contexts + len(up)

    def of(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        keys = contexts * np.int64(self.width) + symbols
        word, shift = keys >> 6, (keys & 63).view("u8")
        bits = self.bits[word]
        out = self.logp[self.before[word] + np.bitwise_count(bits & ((np.uint64(1) << shift) - np.uint64(1)))].astype("f8")
        lacks = np.flatnonzero(~bits >> shift & np.uint64(1))
        if len(lacks):
            out[lacks] = self.left[contexts[lacks]] + self.of(self.up[contexts[lacks]], symbols[lacks])
        return out


@dataclass(frozen=True)
class Automaton:
    """next: the following state by row * width + symbol, where states that nothing goes on from share the
    row of their suffix; row * width and longest context by state; symbol: by byte, others share one.
    owns: by the two bytes before a position, whether this automaton scores it (none: all positions)."""

    depth: int
    width: int
    symbol: np.ndarray
    next: np.ndarray
    row: np.ndarray
    context: np.ndarray
    entries: Entries
    owns: np.ndarray | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each text (of the positions that are owned)."""
        seqs = [symbols(t) for t in texts]
        d = self.depth
        none = self.width  # for places behind a text's end
        rows, owner, raw = [], [], []
        for k, s in enumerate(seqs):
            x = np.frombuffer(END * d + s, "u1")
            n = -(-len(s) // STRETCH)
            padded = np.full(n * STRETCH + d, none, self.symbol.dtype)
            padded[: len(x)] = self.symbol[x]
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, STRETCH + d)[::STRETCH])
            owner += [k] * n
            if self.owns is not None:
                padded = np.zeros(n * STRETCH + d, "i4")
                padded[: len(x)] = x
                raw.append(np.lib.stride_tricks.sliding_window_view(padded, STRETCH + d)[::STRETCH])
        if not rows:
            return np.zeros(0)
        steps = np.ascontiguousarray(np.concatenate(rows).T)
        bytes_ = np.ascontiguousarray(np.concatenate(raw).T) if raw else None
        real, steps, m = steps < none, np.minimum(steps, none - 1), steps.shape[1]
        state, total = np.zeros(m, "i8"), np.zeros(m)
        held = max(1, TOGETHER // m)  # steps whose probabilities are looked up together
        states = np.zeros((held, m), "i4")
        for t, sym in enumerate(steps):
            if t >= d:
                states[(t - d) % held] = state
            if t >= d and ((t - d + 1) % held == 0 or t + 1 == len(steps)):
                some = slice(t - (t - d) % held, t + 1)
                found, wanted, syms = states[: some.stop - some.start], real[some], steps[some]
                if bytes_ is None:
                    total += (self.entries.of(self.context[found.ravel()], syms.ravel()).reshape(syms.shape) * wanted).sum(0)
                else:
                    wanted = wanted & self.owns[bytes_[some.start - 2 : some.stop - 2] * 256 + bytes_[some.start - 1 : some.stop - 1]]
                    logp = np.zeros(syms.shape)
                    logp[wanted] = self.entries.of(self.context[found[wanted]], syms[wanted])
                    total += logp.sum(0)
            state = self.next[self.row[state] + sym]
        return np.bincount(owner, total, len(seqs))


def _place(level: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the codes are in a sorted level, and whether they are."""
    at = np.minimum(np.searchsorted(level, codes), max(len(level) - 1, 0))
    return at, level[at] == codes if len(level) else np.zeros(len(codes), bool)


def _suffix(codes: np.ndarray, k: int) -> np.ndarray:
    return codes & ((1 << 8 * k) - 1)


def build(d: np.ndarray, ctx: np.ndarray, a: np.ndarray, n: np.ndarray, depth: int, owns: np.ndarray | None = None) -> Automaton:
    """From the contexts that stay (depth, code, next byte, count), sorted by these, the root (depth 0) included."""
    seen = np.flatnonzero(np.bincount(a, minlength=256))
    width = len(seen) + 1  # any other byte
    symbol = np.full(256, len(seen), "u1" if width < 256 else "u2")
    symbol[seen] = np.arange(len(seen))
    of = [slice(*np.searchsorted(d, (k, k + 1))) for k in range(depth + 1)]
    starts = [np.flatnonzero(np.diff(ctx[o], prepend=-1)) for o in of]
    contexts = [ctx[o][s] for o, s in zip(of, starts, strict=True)]
    contexts[0] = np.zeros(1, "i8")
    # All prefixes of contexts are states, level by level.
    states = list(contexts)
    for k in range(depth - 1, -1, -1):
        states[k] = np.union1d(states[k], states[k + 1] >> 8)
    inner = [np.unique(states[k + 1] >> 8) for k in range(depth)]  # states that go on
    first, begin = np.cumsum([0, *map(len, states)]), np.cumsum([0, *map(len, contexts)])
    row, context = np.zeros(first[-1], "i4"), np.zeros(first[-1], "i4")
    nexts = np.zeros((max(1, sum(map(len, inner))), width), "i4")
    entries, rows = Entries(begin[-1], width, sum(len(contexts[k]) * width if k <= WHOLE else len(range(*of[k].indices(len(d)))) for k in range(depth + 1))), 0
    for k, level in enumerate(states):
        if not len(level):
            break
        own = slice(first[k], first[k + 1])
        if k:  # the longest proper suffix that is a state
            link = np.zeros(len(level), "i4")
            for j in range(1, k):
                at, found = _place(states[j], _suffix(level, j))
                link[found] = first[j] + at[found]
            row[own], context[own] = row[link], context[link]
        if k < depth and len(inner[k]):
            at = first[k] + np.searchsorted(level, inner[k])
            nexts[rows : rows + len(at)] = nexts[row[at]]  # those of the suffix, the root has zeros
            row[at] = rows + np.arange(len(at))
            nexts[rows + np.searchsorted(inner[k], states[k + 1] >> 8), symbol[_suffix(states[k + 1], 1)]] = first[k + 1] + np.arange(len(states[k + 1]))
            rows += len(at)
        # Of other states the distribution is that of the longest context, their suffix's.
        context[first[k] + np.searchsorted(level, contexts[k])] = begin[k] + np.arange(len(contexts[k]))
        up = begin[k - 1] + np.searchsorted(contexts[k - 1], _suffix(contexts[k], k - 1)) if k else np.zeros(1, "i8")
        ends = np.append(starts[k][1:], len(ctx[of[k]]))
        for c in range(0, len(contexts[k]), AT_ONCE):
            some = slice(c, c + AT_ONCE)
            lo, hi = (starts[k][c], ends[some][-1]) if len(starts[k]) else (0, 0)
            kinds = (ends - starts[k])[some] if hi else np.zeros(1, "i8")
            which, sym, count = np.repeat(np.arange(len(kinds)), kinds), symbol[a[of[k]][lo:hi]], n[of[k]][lo:hi]
            total = np.bincount(which, count, len(kinds)) + NOVEL * kinds
            if k <= WHOLE:
                counts = np.zeros((len(kinds), width))
                counts[which, sym] = count
                which, sym, count = np.repeat(np.arange(len(kinds)), width), np.tile(np.arange(width), len(kinds)), counts.ravel()
            share = np.where(total > 0, NOVEL * kinds / np.maximum(total, 1), 1.0)
            above = 10.0 ** entries.of(up[some][which], sym) if k else 1 / 256
            entries.add(begin[k] + c + which, sym, np.log10(above * share[which] + count / np.maximum(total[which], 1)), up[some], np.log10(share))
    return Automaton(depth, width, symbol, nexts.ravel(), row * np.int32(width), context, entries, owns)


class Shard:
    """Contexts as arrays, which is what is sent; a worker builds the automaton in their place when it
    first scores."""

    def __init__(self, d: np.ndarray, ctx: np.ndarray, a: np.ndarray, n: np.ndarray, depth: int, owns: np.ndarray | None):
        self.given, self.built = (d.astype("i1"), ctx, a.astype("u1"), n, depth, owns), None

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.built is None:
            self.built, self.given = build(*self.given), None
        return self.built.scores(texts)


@dataclass(frozen=True)
class Tree:
    """The contexts that stay, a written table (d, ctx, a, n), dealt to so many automata."""

    rows: DataFrame
    depth: int
    shards: int

    def automaton(self, shard: int) -> Shard:
        owner = F.pmod(F.hash(F.col("ctx").bitwiseAND(F.lit(0xFFFF))), F.lit(self.shards))
        got = self.rows.filter((F.col("d") < 2) | (owner == shard)).orderBy("d", "ctx", "a").toArrow()
        owns = None
        if self.shards > 1:
            pairs = self.rows.sparkSession.range(1 << 16).select("id", F.pmod(F.hash("id"), F.lit(self.shards)).alias("shard")).toArrow()
            owns = np.zeros(1 << 16, bool)
            owns[pairs["id"].to_numpy()] = pairs["shard"].to_numpy() == shard
        return Shard(*(got[c].to_numpy() for c in ("d", "ctx", "a", "n")), self.depth, owns)

    def scores(self, texts: list[str]) -> np.ndarray:
        return sum(self.automaton(k).scores(texts) for k in range(self.shards))


def train(df: DataFrame, text: str = "text", depth: int = DEPTH, p_min: float = 0.0, min_count: int | None = None, shard_bytes: int = SHARD_BYTES) -> Tree:
    """Learns from all rows.  A candidate is a context seen min_count times or more (None: the rule above),
    and in p_min of all positions, where that is asked for."""
    windows = written(count_windows(df, text, depth))
    total = windows.agg(F.sum("n")).first()[0] or 0
    if min_count is None:
        min_count = min(MIN_COUNT, max(LEAST_COUNT, total // RARE))
    cut = F.col("code").bitwiseAND(F.expr("shiftleft(1L, 8 * (d + 1)) - 1"))
    levels = (
        windows.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        .groupBy("d", cut.alias("code"))
        .agg(F.sum("n").alias("n"))
        .select("d", F.shiftright("code", 8).alias("ctx"), F.col("code").bitwiseAND(F.lit(255)).alias("a"), "n")
    )
    often = levels.groupBy("d", "ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    known = written(levels.join(often.filter((F.col("all") >= max(min_count, p_min * total)) | (F.col("d") == 0)), ["d", "ctx"]))
    up = known.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), "a", F.col("n").alias("up_n"), F.col("all").alias("up_all"))
    gain = F.sum(F.col("n") * F.log((F.col("n") / F.col("all")) / (F.col("up_n") / F.col("up_all"))))
    stay = (
        known.withColumn("up", F.col("ctx").bitwiseAND(F.expr("shiftleft(1L, 8 * (d - 1)) - 1")))
        .filter("d > 0")
        .join(up, ["d", "up", "a"])
        .groupBy("d", "ctx", "kinds")
        .agg(gain.alias("gain"))
        .filter(F.col("gain") > F.col("kinds") * (KIND_COST * math.log(total + 1)))
    )
    suffixes = stay.select(F.explode(F.sequence(F.lit(1), "d")).alias("d"), "ctx").select(
        "d", F.col("ctx").bitwiseAND(F.expr("shiftleft(1L, 8 * d) - 1")).alias("ctx")
    )
    kept = known.filter("d > 0").join(suffixes.distinct(), ["d", "ctx"], "left_semi").unionByName(known.filter("d = 0"))
    rows = written(kept.select("d", "ctx", F.col("a").cast("int").alias("a"), "n"))
    contexts, width = rows.agg(F.count_distinct("d", "ctx"), F.count_distinct("a")).first()
    return Tree(rows, depth, max(1, math.ceil(contexts * (width + 2) * 8 / shard_bytes)))


def unigrams(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, n): tokens of all texts and how often they occur; the end token is ``\\n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column("text").to_pylist():
                seen.update(tokens(t))
                if len(seen) > _FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return _texts(df, text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def score(df: DataFrame, model: Tree, counts: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, carry..., n_tokens, n_known, train_tokens, base_score, score)."""
    spark, names = df.sparkSession, [key, *carry]
    own = [f"_own{k}" for k in range(len(names))]  # so that no name can clash
    plain = df.select(
        F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(o) for c, o in zip(names, own, strict=True)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    )
    if model.shards > 1:  # texts are read once for each automaton: fix their numbers
        plain = written(plain)
    all_tokens, kinds = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    log_all = math.log10(all_tokens + 0.1 * (kinds + 1))
    # The lowest power of two that no more than HEAVY words reach.
    heavy_from, words = 1, 0
    power = F.floor(F.log2("n")).cast("int").alias("power")
    for r in counts.groupBy(power).count().orderBy(F.desc("power")).collect():  # 63 rows at most
        words += r["count"]
        if words > HEAVY:
            heavy_from = 1 << r["power"] + 1
            break
    often = counts.filter(F.col("n") >= heavy_from).toArrow()
    heavy = dict(zip((w.encode() for w in often["word"].to_pylist()), (np.log10(often["n"].to_numpy() + 0.1) - log_all).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((model.automaton(0), heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, heavy = shared.value
        for whole in batches:
            for batch in slices(whole, "_text", 1_000_000):
                texts, ids = batch.column("_text").to_pylist(), batch.column("_row").to_pylist()
                n, known, base, owner, words, times = [], [], [], [], [], []
                for i, t in zip(ids, texts, strict=True):
                    toks = tokens(t)
                    got = [*map(heavy.get, toks)]
                    rest = Counter([w for w, g in zip(toks, got, strict=True) if g is None]) if None in got else {}
                    found = [g for g in got if g is not None]
                    n.append(len(toks))
                    known.append(len(found))
                    base.append(math.fsum(found))
                    owner += [i] * len(rest)
                    words += rest.keys()
                    times += rest.values()
                m, w = len(texts), len(words)
                none = pa.nulls(w, pa.int64())
                cols = [
                    # A text's own row has a word that is none, and each another one.
                    pa.concat_arrays([pa.array([b"\n%d" % i for i in ids], pa.binary()), pa.array(words, pa.binary())]).cast(pa.string()),
                    pa.array(ids + owner, pa.int64()),
                    pa.array([0] * m + times, pa.int64()),
                    *(pa.concat_arrays([batch.column(c), pa.nulls(w, batch.column(c).type)]) for c in own),
                    pa.concat_arrays([pa.array(n, pa.int64()), none]),
                    pa.concat_arrays([pa.array(known, pa.int64()), none]),
                    pa.concat_arrays([pa.array(base, pa.float64()), pa.nulls(w, pa.float64())]),
                    pa.concat_arrays([pa.array(automaton.scores(texts), pa.float64()), pa.nulls(w, pa.float64())]),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["word", "_row", "_times", *own, "_tokens", "_known", "_base", "_score"])

    kinds_of = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"word string, _row bigint, _times bigint, {', '.join(f'{o} {kinds_of[c]}' for c, o in zip(names, own, strict=True))}, _tokens bigint, _known bigint, _base double, _score double"
    joined = plain.mapInArrow(run, schema).join(counts.filter(F.col("n") < heavy_from), "word", "left")
    had = F.coalesce("n", F.lit(0))
    by_word = F.sum(F.when(F.col("_times") > 0, F.col("_times") * (F.log10(had + 0.1) - F.lit(log_all))).otherwise(0.0))
    out = joined.groupBy("_row").agg(
        *[F.first(o, ignorenulls=True).alias(o) for o in own],
        F.max("_tokens").alias("_tokens"),
        (F.max("_known") + F.sum(F.when(had > 0, F.col("_times")).otherwise(0))).alias("_known"),
        (F.max("_base") + by_word).alias("_base"),
        F.max("_score").alias("_score"),
    )
    more = None
    for k in range(1, model.shards):
        part = _scored(plain, spark.sparkContext.broadcast(model.automaton(k)))
        more = part if more is None else more.unionByName(part)
    if more is not None:
        out = out.join(more.groupBy("_row").agg(F.sum("_more").alias("_more")), "_row").withColumn("_score", F.col("_score") + F.col("_more"))
    return out.select(
        *[F.col(o).alias(c) for c, o in zip(names, own, strict=True)],
        F.col("_tokens").alias("n_tokens"),
        F.col("_known").alias("n_known"),
        F.lit(all_tokens).cast("bigint").alias("train_tokens"),
        F.col("_base").alias("base_score"),
        F.col("_score").alias("score"),
    )


def _scored(plain: DataFrame, automaton: Broadcast[Shard]) -> DataFrame:
    """Rows (_row, _more): what one automaton adds to each text's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text", 1_000_000):
                yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(automaton.value.scores(batch.column("_text").to_pylist()))], ["_row", "_more"])

    return plain.select("_row", "_text").mapInArrow(run, "_row bigint, _more double")
