"""Mixture-controlled packing: queues of tokens by source fill windows to target proportions.

Every source is a queue: its documents' ids one after the other.  Windows of ``window`` tokens are
filled by hierarchical deficit round-robin: a binary tree over the queues, each inner node of which
serves its two sides by deficit round-robin (of x tokens the left side has had floor(x * left /
both); what is left over is its deficit, carried to the next window).  Deficits of any window have
a closed form, so every partition takes them up exactly where the one before it left them, without
a shuffle: a document's place in its queue comes from prefix sums of counts, and its windows from
that place.  With the default targets (each source's own share) all queues end together, and only
the last window is short.  Other targets run in phases: when a queue is empty the rest go on in
proportion; sources without a target come last.

Tokens are written once to the shared folder and read again, so a lost executor costs a re-read.
Only totals of sources of at least 1/100000 of all tokens reach the driver (at most 100000); all
others share one queue.

Null text counts as empty (its end token alone), null source as the source "".  Ties and repeated
rows are packed like others (doc_id need not be unique); an empty table gives no pieces.  Extra
columns are not read.  Cuts fall anywhere, and each id lies in exactly one piece.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.bpe import UnitCache, slices
from treeline.llm.common import written

GROUP = 256  # windows planned at a time
PLANNED = 1 << 22  # numbers of a plan of windows at most: one for each queue and window
CACHED = 1 << 24  # numbers of plans that a task keeps
BROADCAST_ROWS = 200_000
LEAST = 100_000  # sources under 1 / LEAST of all tokens share a queue

_TOKENIZERS: dict[str, UnitCache] = {}


def tokenizer(path: str) -> UnitCache:
    """A worker's tokenizers.Tokenizer behind a cache of units."""
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        def encode(units: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in made.encode_batch_fast(units, add_special_tokens=False)]

        _TOKENIZERS[path] = UnitCache(encode, encode_words=_word_encoder(path))
    return _TOKENIZERS[path]


def _word_encoder(path: str) -> Callable[[str], np.ndarray] | None:
    """Merges lines, each taken whole, by the tokenizer's own merges; None unless these are byte-level
    merges numbered in the order in which they apply."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    # Bytes that are printable stand for themselves in the vocabulary, others for 256 and on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    vocabulary, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [vocabulary.get(a + b, -1) for a, b in pairs]
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    single = [i for b, i in ranks.items() if len(b) == 1]
    if merged != sorted(set(merged)) or len(single) != 256 or max(single) > merged[0] or len(ranks) != 256 + len(merged):
        return None
    # Lines are words of letters: one match of the tokenizer's own pattern, so merging alone decides.
    lines = tiktoken.Encoding("words", pat_str=r"\n|[^\n]+", mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.array(lines.encode_ordinary(text), "<u4")


def tokenise(df: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (key, source, part, at, n, ids): ids as little-endian unsigned 32-bit, ``end`` appended;
    at: the tokens of this source before it in this partition ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, units = TaskContext.get().partitionId(), {}, tokenizer(path)
        for whole in batches:
            for batch in slices(whole, text, 8_000_000):
                ids, ends = units.flat(batch.column(text))
                ids = np.insert(ids, ends, end)  # after each text
                ends = np.r_[0, ends + np.arange(1, len(ends) + 1)]
                sizes, at = np.diff(ends), []
                for s, n in zip(batch.column(source).to_pylist(), sizes.tolist(), strict=True):
                    at.append(seen.get(s, 0))
                    seen[s] = at[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key),
                        batch.column(source),
                        pa.array(np.full(len(at), part, "i4")),
                        pa.array(at, pa.int64()),
                        pa.array(sizes),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((4 * ends).astype("i4")), pa.py_buffer(ids)]),
                    ],
                    [key, source, "part", "at", "n", "ids"],
                )

    kind = df.schema[key].dataType.simpleString()
    clean = df.select(key, F.coalesce(F.col(source).cast("string"), F.lit("")).alias(source), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    return clean.mapInArrow(run, f"`{key}` {kind}, `{source}` string, part int, at bigint, n bigint, ids binary")


@dataclass(frozen=True)
class Plan:
    """The windows: phases of (tokens taken from each queue), and what went before each phase."""

    window: int
    takes: tuple[tuple[int, ...], ...]

    @staticmethod
    def phases(totals: list[int], weights: list[Fraction]) -> tuple[tuple[int, ...], ...]:
        left, out = list(totals), []
        while any(left):
            on = [k for k, n in enumerate(left) if n and weights[k]] or [k for k, n in enumerate(left) if n]
            w = [weights[k] or Fraction(left[k]) for k in range(len(left))]
            span = min(Fraction(left[k]) / w[k] for k in on)
            take = tuple(int(w[k] * span) if k in on else 0 for k in range(len(left)))
            if not any(take):
                take = tuple(left[k] if k in on else 0 for k in range(len(left)))
            left = [n - t for n, t in zip(left, take, strict=True)]
            out.append(take)
        return tuple(out)

    def starts(self) -> list[int]:
        return [sum(map(sum, self.takes[:k])) for k in range(len(self.takes) + 1)]


def share(x, weights: list[int], take: Callable) -> list:
    """Of the first x tokens, those of each queue, by a tree of two-sided deficit round-robins.

    Each is monotone in x, they sum to x, and at x = sum(weights) they are the weights."""
    out = [None] * len(weights)

    def serve(lo: int, hi: int, x, total: int) -> None:
        if hi - lo == 1:
            out[lo] = x
            return
        mid = (lo + hi) // 2
        left = sum(weights[lo:mid])
        mine = take(x, left, total) if total else x * 0
        serve(lo, mid, mine, left)
        serve(mid, hi, x - mine, total - left)

    serve(0, len(weights), x, sum(weights))
    return out


class Filler:
    """Cuts stretches of a queue into pieces of windows."""

    def __init__(self, plan: Plan):
        self.plan, self.starts = plan, plan.starts()
        queues = len(plan.takes[0])
        self.size = plan.window * max(1, min(GROUP, PLANNED // queues))
        self.kept = max(2, CACHED // (2 * queues * (self.size // plan.window + 1)))
        self.before = [tuple(sum(t[s] for t in plan.takes[:p]) for s in range(len(plan.takes[0]))) for p in range(len(plan.takes) + 1)]
        self.groups: dict[tuple[int, int], tuple] = {}

    def _had(self, p: int, x: int) -> list[int]:
        """Tokens of each queue before global token x of phase p."""
        own = share(x - self.starts[p], list(self.plan.takes[p]), lambda x, a, b: x * a // b)
        return [a + b for a, b in zip(self.before[p], own, strict=True)]

    def _group(self, p: int, g: int) -> tuple:
        if (p, g) not in self.groups:
            if len(self.groups) >= self.kept:
                self.groups.clear()
            lo, hi = max(self.starts[p], g * self.size), min(self.starts[p + 1], (g + 1) * self.size)
            first, last = self._had(p, lo), self._had(p, hi)
            w = self.plan.window
            cuts = np.unique(np.r_[lo, np.arange(lo // w + 1, (hi - 1) // w + 1, dtype="i8") * w, hi])
            own = share(cuts - lo, [b - a for a, b in zip(first, last, strict=True)], lambda x, a, b: x * a // b)
            had = np.array(own) + np.array(first, "i8")[:, None]  # queue, cut
            sizes = np.diff(had, axis=1)
            lead = np.cumsum(sizes, axis=0) - sizes + cuts[:-1] % w
            self.groups[p, g] = had, lead, cuts[:-1] // w
        return self.groups[p, g]

    def pieces(self, s: int, at: int, n: int, hint: dict[int, tuple[int, int]]) -> Iterator[tuple]:
        """Arrays (start, length, sequence, offset) that cover tokens at .. at + n of queue s."""
        end, begin = at + n, at
        while at < end:
            p = bisect_right([b[s] for b in self.before], at) - 1
            p = min(p, len(self.plan.takes) - 1)
            g = hint.get(s, (p, -1))
            lo, hi = self.starts[p] // self.size, (self.starts[p + 1] - 1) // self.size
            if g[0] == p and g[1] >= 0:
                lo, hi = self._near(p, s, at, g[1], lo, hi)
            while lo < hi:  # the last group that begins at or before this token
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if self._had(p, max(self.starts[p], mid * self.size))[s] <= at else (lo, mid - 1)
            hint[s] = (p, lo)
            had, lead, window = self._group(p, lo)
            a = int(np.searchsorted(had[s], at, "right")) - 1
            b = int(np.searchsorted(had[s], min(end, int(had[s][-1])), "left"))
            start = np.maximum(had[s][a:b], at)
            length = np.minimum(had[s][a + 1 : b + 1], end) - start
            some = length > 0
            yield start[some] - begin, length[some], window[a:b][some], (lead[s][a:b] + start - had[s][a:b])[some]
            at = min(end, int(had[s][-1]))

    def _near(self, p: int, s: int, at: int, g: int, lo: int, hi: int) -> tuple[int, int]:
        had = self._group(p, g)[0][s]
        if had[0] <= at < had[-1]:
            return g, g
        return (min(g + 1, hi), hi) if at >= had[-1] else (lo, max(g - 1, lo))


def pack(
    df: DataFrame,
    path: str,
    end: int,
    window: int = 1024,
    targets: dict[str, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pieces: key, source, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.  targets: weight by source; null: each source's own share."""
    tokens = written(tokenise(df, path, end, key, text, source))
    sums = tokens.groupBy(source, "part").agg(F.sum("n").alias("n")).checkpoint()
    all_tokens = sums.agg(F.sum("n")).first()[0] or 0
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{source}` string, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, `offset` bigint"
    if not all_tokens:
        return df.sparkSession.createDataFrame([], schema)
    # At most LEAST rows, each with that part of all tokens, and those that targets name.
    own = (F.col("n") * LEAST >= all_tokens) | F.coalesce(F.col(source).isin([*(targets or {})]), F.lit(False))
    large = sums.groupBy(source).agg(F.sum("n").alias("n")).filter(own).orderBy(source).collect()
    names, totals = [r[source] for r in large], [r["n"] for r in large]
    rest = all_tokens - sum(totals)
    if rest * LEAST >= all_tokens or not names or (rest and targets is not None):
        names.append(None)
        totals.append(rest)
        other = len(names) - 1
    else:  # too few for a queue of their own
        other = totals.index(min(totals))
        totals[other] += rest
    weights = [Fraction(totals[k] if targets is None else targets.get(n, 0)) for k, n in enumerate(names)]
    plan = Plan(window, Plan.phases(totals, weights))
    queues = df.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names) if n is not None], f"`{source}` string, queue int")
    before = Window.partitionBy("queue").orderBy(source, "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.join(F.broadcast(queues), source, "left").withColumn("queue", F.coalesce("queue", F.lit(other)))  # at most LEAST queues
    base = placed.select(source, "part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A row for each source and partition: sent to all where that is small, joined by shuffle else.
    if sums.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = tokens.join(base, [source, "part"]).select(key, source, "queue", (F.col("base") + F.col("at")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, hint = Filler(plan), {}
        for whole in batches:
            for batch in slices(whole, "ids"):
                queue, at, n = (batch.column(c).to_pylist() for c in ("queue", "at", "n"))
                got = [[*filler.pieces(q, a, k, hint)] for q, a, k in zip(queue, at, n, strict=True)]
                row = np.repeat(np.arange(len(n)), [sum(len(x[0]) for x in g) for g in got])
                start, length, sequence, offset = (np.concatenate([x[k] for g in got for x in g]) for k in range(4))
                # Pieces of a document follow each other, so their ids are the batch's ids as they lie.
                data = b"".join(batch.column("ids").to_pylist())
                ends = np.r_[0, np.cumsum(length * 4)].astype("i4")
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                rows = pa.array(row)
                for k in range(0, len(row), 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [
                            x[k : k + 100_000]
                            for x in (
                                batch.column(key).take(rows),
                                batch.column(source).take(rows),
                                pa.array(start, pa.int64()),
                                pa.array(length, pa.int64()),
                                ids,
                                pa.array(np.array(n, "i8")[row], pa.int64()),
                                pa.array(sequence, pa.int64()),
                                pa.array(offset, pa.int64()),
                            )
                        ],
                        [key, source, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                    )

    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whole windows: sequence_id, input_ids (binary as in the pieces), segments (key, offset, length)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", F.col(key), "length")))
    made = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return made.select(
        "sequence_id",
        F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("input_ids"),
        F.transform("p", lambda x: F.struct(x[key].alias(key), x["offset"].alias("offset"), x["length"].alias("length"))).alias("segments"),
    )
