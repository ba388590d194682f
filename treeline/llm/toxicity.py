"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Words are lower-cased, reduced to letters and digits and given border marks.  The kernel of two
words is the inner product of their gapped subsequences of three characters (weight DECAY to the
power of the span, spans up to SPAN) and of five (one gap at most), normalised; a gap or an inserted
character lowers it a little.  In words of more than STEM letters those of five count more, so that
words of one stem are told from others.  The kernel of two sentences is the sum over their distinct
words.  Single characters in a row ("i d i o t") also count as the word they spell.

Training, on a bounded sample of labelled documents (``fit_rows`` of them at most, those with the
smallest hash of their key, the shortest of them as far as ``fit_chars`` characters go; of rows that share a key one), from
which ``landmarks`` and ``clean_sentences`` bound what the machine is made of: sentences of clean documents are negative; of toxic documents those are positive
that hold a word typical of them, by log odds over documents, and after the first fit, where none does, the
one that looks worst.  Landmarks are the typical words and
frequent ones.  Sentences are mapped to the landmarks' kernel space (Nyström), a linear machine with
squared hinge loss is fitted, the clean sentences that it scores highest are added and it is fitted
again.  The machine is linear in subsequences, so it folds into one weight per subsequence: scoring
a word takes one table look-up for each of its subsequences.  A logistic curve over a document's
three highest sentence scores gives its score in 0..1.

Null text counts as empty and gets a score like any text.  Rows are scored one by one, repeated ones
too.  Without labels of both kinds the score is the share of toxic labels, 0 without any.  An empty
table gives an empty result.  Only key, text and the columns to carry are read.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.bpe import slices

DECAY, SPAN, LONG = 0.6, 6, 24
FIVE_WEIGHT, STEM_WEIGHT = 0.3, 1.0  # of five characters in a row, against DECAY ** 3 of three
STEM = 6  # words of more letters take STEM_WEIGHT: by threes alone long words are alike by chance
FIT_ROWS, FIT_CHARS = 5000, 100_000_000  # of labelled documents that the machine is fitted on, at most
TYPICAL, FREQUENT = 300, 100  # landmarks
CLEAN_SENTENCES = 3000  # of each round
ROUNDS = 2  # of labelling sentences and fitting
CACHE_WORDS = 200_000
TOP = 3

# Digits that stand for letters inside words.
DIGITS = str.maketrans("0134579", "oieastg")
_SENTENCE = re.compile(r"[.!?]+(?:\s+|\Z)|\n")
_SPELLED = re.compile(r"(?<!\S)\w(?:[\s.*_-]+\w(?!\w)){2,}")
_FIVE = [tuple(int(k == gap) + 1 for k in range(4)) for gap in range(-1, 4)]
TABLE = 1 << 19  # three characters: exact codes; five: hashed into the upper half
_PATTERNS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
_BORDER = (61, 62)


def sentences(text: str) -> list[list[str]]:
    """The distinct raw words of each sentence."""
    lower = text.lower()
    out = [[*dict.fromkeys(s.split())] for s in _SENTENCE.split(lower)]
    for m in _SPELLED.finditer(lower):
        out.append(["".join(c for c in m[0] if c.isalnum())])
    return [s for s in out if s]


def parts(word: str) -> list[str]:
    """Letters and digits of a word, in stretches of LONG that overlap by half."""
    plain = "".join(c for c in word if c.isalnum())
    if not plain.isdigit():
        plain = plain.translate(DIGITS)
    return [plain[k : k + LONG] for k in range(0, max(len(plain) - LONG // 2, 1), LONG // 2)]


def _code(c: str) -> int:
    n = ord(c) - 96
    return n if 1 <= n <= 26 else 27 + ord(c) % 34


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (0: none) and weights of the gapped subsequences of each word, one row a word; the
    weights of a word's occurrences have length 1."""
    m = np.zeros((len(words), LONG + 2), "u4")
    for k, w in enumerate(words):
        m[k, : len(w) + 2] = [_BORDER[0], *map(_code, w), _BORDER[1]]
    width = m.shape[1]
    five = np.where(np.count_nonzero(m, axis=1) - 2 > STEM, STEM_WEIGHT, FIVE_WEIGHT).astype("f4")[:, None]
    codes, weights = [], []
    for a, b in _PATTERNS:
        n = width - a - b
        last = m[:, a + b :]
        codes.append(np.where(last > 0, m[:, :n] << 12 | m[:, a : a + n] << 6 | last, 0))
        weights.append(np.full((len(words), n), DECAY ** (a + b + 1), "f4"))
    for steps in _FIVE:
        span = sum(steps)
        n, x, at = width - span, m[:, : width - span], 0
        for step in steps:
            at += step
            x = x * np.uint32(1_000_003) ^ m[:, at : at + n]
        x = (x ^ x >> 13) * np.uint32(0x9E3779B1) >> 14 | 1 << 18
        codes.append(np.where(m[:, span:] > 0, x, 0))
        weights.append(np.repeat(five * np.float32(DECAY ** (span - 4)), n, axis=1))
    code = np.concatenate(codes, axis=1)
    weight = np.where(code > 0, np.concatenate(weights, axis=1), np.float32(0))
    return code, weight / np.sqrt(np.maximum((weight**2).sum(axis=1, keepdims=True), 1e-12))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The kernel of each word with each landmark."""
    code, weight = subsequences(landmarks)
    known = np.unique(code[code > 0])
    place = np.zeros(TABLE, "i4")
    place[known] = np.arange(1, len(known) + 1)
    by_code = np.zeros((len(known) + 1, len(landmarks)), "f4")
    np.add.at(by_code, (place[code], np.arange(len(landmarks))[:, None]), weight)
    by_code[0] = 0
    out = np.zeros((len(words), len(landmarks)), "f4")
    for k in range(0, len(words), 2000):
        code, weight = subsequences(words[k : k + 2000])
        at = place[code]
        for j in range(at.shape[1]):
            hit = np.flatnonzero(at[:, j])
            if len(hit):
                out[k + hit] += by_code[at[hit, j]] * weight[hit, j, None]
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine, by Newton steps."""
    x = np.c_[x, np.ones(len(x), "f4")].astype("f8")
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa = x[active]
        new = np.linalg.solve(ridge + (xa * cost[active, None]).T @ xa, (xa * (cost * y)[active, None]).sum(axis=0))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Machine:
    """weight by subsequence; offset; logistic curve over the TOP highest sentence scores."""

    weight: np.ndarray
    offset: float
    curve: np.ndarray
    share: float
    cache: dict[str, float] = field(default_factory=dict)

    def words(self, words: list[str]) -> list[float]:
        """Decision values; of a long word the highest of its stretches."""
        pieces = [parts(w) for w in words]
        flat = [p for ps in pieces for p in ps]
        values = np.zeros(len(flat))
        for k in range(0, len(flat), 4000):
            code, weight = subsequences(flat[k : k + 4000])
            values[k : k + 4000] = (self.weight[code] * weight).sum(axis=1)
        out, at = [], 0
        for ps in pieces:
            out.append(float(values[at : at + len(ps)].max()))
            at += len(ps)
        return out

    def tops(self, texts: list[list[list[str]]]) -> np.ndarray:
        """The TOP highest sentence values of each text (given as sentences)."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [*{w for t in texts for s in t for w in s if w not in self.cache}]
        self.cache.update(zip(new, self.words(new), strict=True))
        get = self.cache.__getitem__
        out = np.full((len(texts), TOP), self.offset)
        for k, t in enumerate(texts):
            best = sorted([math.fsum(map(get, s)) + self.offset for s in t], reverse=True)[:TOP]
            out[k, : len(best)] = best
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(texts), self.share)
        z = self.tops([sentences(t) for t in texts]) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], toxic: list[int], landmarks: tuple[int, int] = (TYPICAL, FREQUENT), clean_sentences: int = CLEAN_SENTENCES) -> Machine:
    # Words are interned: the lists of a document's sentences then hold references alone.
    docs = [[[sys.intern(w) for w in s] for s in sentences(t)] for t in texts]
    label = np.array(toxic, int)
    share = float(label.mean()) if len(label) else 0.0
    n_tox, n_clean = int(label.sum()), int((1 - label).sum()) if len(label) else 0
    none = Machine(np.zeros(TABLE, "f4"), 0.0, np.zeros(0), share)
    if not n_tox or not n_clean:
        return none
    known: dict[str, list[str]] = {}
    for d in docs:
        for w in (w for s in d for w in s if w not in known):
            known[w] = [sys.intern(p) for p in parts(w) if p]
    plain = [[[p for w in s for p in known[w]] for s in d] for d in docs]
    known.clear()
    tox, clean = Counter(), Counter()
    for d, y in zip(plain, toxic, strict=True):
        (tox if y else clean).update({w for s in d for w in s})
    odds = {w: math.log((n + 0.5) / (n_tox + 1)) - math.log((clean[w] + 0.5) / (n_clean + 1)) for w, n in tox.items() if n >= 3}
    typical = {w for w in odds if odds[w] > 2}
    marks = sorted(typical, key=lambda w: (-odds[w] * math.sqrt(tox[w]), w))[: landmarks[0]]
    if not marks:
        return none
    marks += [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[: landmarks[1]] if w not in typical]
    positive = [s for d, y in zip(plain, toxic, strict=True) if y for s in d if typical.intersection(s)]
    toxic_docs = [d for d, y in zip(plain, toxic, strict=True) if y]
    negative = [s for d, y in zip(plain, toxic, strict=True) if not y for s in d]
    some = min(len(negative), clean_sentences)
    chosen = [negative[k * len(negative) // some] for k in range(some)]  # spread over all of them
    k_mm = kernel(marks, marks).astype("f8")
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = value > 1e-4
    root = vector[:, keep] / np.sqrt(value[keep])  # K_mm^-1/2
    code, weight = subsequences(marks)
    machine = none
    for round_ in range(ROUNDS):
        rows = positive + chosen
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for s in rows for w in s))}
        k_wm = kernel([*vocabulary], marks)
        x = np.array([k_wm[[vocabulary[w] for w in dict.fromkeys(s)]].sum(axis=0) if s else np.zeros(len(marks), "f4") for s in rows]) @ root
        del k_wm
        y = np.r_[np.ones(len(positive)), -np.ones(len(chosen))]
        w = _squared_hinge(x, y, np.where(y > 0, len(chosen) / max(len(positive), 1), 1.0).clip(0.2, 5))
        alpha = root @ w[:-1]
        table = np.zeros(TABLE, "f8")
        np.add.at(table, code, weight * alpha[:, None])
        table[0] = 0
        machine = Machine(table.astype("f4"), float(w[-1]), np.zeros(0), share)
        if round_ == ROUNDS - 1:
            break
        # What the machine makes of all sentences of the sample.
        every = [*dict.fromkeys(v for s in chain(negative, *toxic_docs) for v in s)]
        score_of: dict[str, float] = {}
        for k in range(0, len(every), 4000):
            score_of.update(zip(every[k : k + 4000], machine.words(every[k : k + 4000]), strict=True))
        del every

        def value(s: list[str]) -> float:
            return sum(map(score_of.__getitem__, dict.fromkeys(s))) + machine.offset

        # A toxic document has a toxic sentence: where none holds a typical word, the one that looks worst.
        positive += [max(d, key=value) for d in toxic_docs if d and not any(typical.intersection(s) for s in d)]
        chosen = chosen + sorted(negative, key=lambda s: -value(s))[:clean_sentences]  # the clean ones that look worst
    curve = _logistic(np.concatenate([machine.tops(docs[k : k + 200]) for k in range(0, len(docs), 200)]), label)
    machine.curve = curve
    machine.cache.clear()
    return machine


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    fit_rows: int = FIT_ROWS,
    fit_chars: int = FIT_CHARS,
    landmarks: tuple[int, int] | None = None,
    clean_sentences: int | None = None,
) -> Machine:
    """Fits on at most fit_rows rows of docs (key, text) with labels (key, label in 0, 1), and
    fit_chars characters of text.

    Of the drawn rows the shortest come first, until fit_chars is reached, so a huge text leaves out itself
    alone.  All sentences of toxic rows with a typical word are learned from, and of those of clean rows
    clean_sentences spread over all and as many that look worst.  landmarks: typical words, frequent
    words.  Where these two aren't given they grow with fit_rows beyond FIT_ROWS.

    The sample is drawn from the labels, so at most fit_rows keys are sent to find its texts, and
    one task fits the machine; only the machine comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("key", "text", "label")), strict=True)]
        rows.sort(key=lambda r: (str(r[0]), r[1], r[2]))  # the same machine from any order of rows
        m = fit([r[1] for r in rows], [r[2] for r in rows], landmarks, clean_sentences)
        cols = [[m.weight.tobytes()], [m.offset], [m.curve.astype("f8").tobytes()], [m.share]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.float64(), pa.binary(), pa.float64()), strict=True)], ["weight", "offset", "curve", "share"])

    more = max(1.0, fit_rows / FIT_ROWS)
    landmarks = landmarks or (int(TYPICAL * more), int(FREQUENT * more))
    clean_sentences = clean_sentences or int(CLEAN_SENTENCES * more)
    own = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.col(label).cast("int")).alias("label"))
    drawn = own.orderBy(F.xxhash64("key"), "key").limit(fit_rows)
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(drawn), "key").groupBy("key", "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.length("text"), F.xxhash64("key"), "key"))  # of fit_rows rows at most
    sample = one.withColumn("so_far", so_far).filter(F.col("so_far") <= fit_chars).select("key", "text", "label")
    row = sample.repartition(1).mapInArrow(run, "weight binary, offset double, curve binary, share double").first()
    if row is None:  # an empty sample may have no task at all
        return fit([], [])
    return Machine(np.frombuffer(row["weight"], "f4"), row["offset"], np.frombuffer(row["curve"], "f8"), row["share"])


def score(df: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """df's key, carried columns and text with ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    names = list(dict.fromkeys([key, *carry]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for whole in batches:
            for batch in slices(whole, "_text", 1_000_000):
                scores = machine.scores([t or "" for t in batch.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "_score"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return (
        df.select(*names, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{schema}, _score double").withColumnRenamed("_score", "score")
    )
