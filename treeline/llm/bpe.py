"""Byte-level BPE encoding and decoding with exact merges, and the unit cache that packing shares.

``ByteBpe`` holds a rank table (the ``.tiktoken`` format).  A piece (one match of the splitting
pattern) is encoded without a merge loop: an Aho-Corasick automaton over the tokens, bytes mapped
to Latin-1 characters, lists the tokens at each position; from left to right the longest one that
is compatible with its left neighbour is taken, and where none is, the walk steps back and never
enters the abandoned position again.  Two tokens are compatible if plain merging of their joined
bytes gives just these two; that answer is memoised.  A token sequence whose neighbours are all
compatible is the one that merging gives, so results equal the merge loop's, in time linear in the
piece.

Texts are first cut at single spaces and line feeds between non-space characters, where every
match of the pattern ends anyway; ids of such units are kept in a bounded cache.

Null text counts as empty: no ids, decoded to empty bytes.  Rows are independent: ties, repeated
rows, empty tables and clashing extra columns need nothing special (only the named columns are
read).  Whole texts are encoded, never prefixes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units a worker's cache holds, and their bytes; beyond, the KEEP part that came first (the frequent
#: ones) stays.
CACHE_UNITS, CACHE_BYTES, KEEP = 600_000, 64_000_000, 0.5
CACHE_PAIRS = 200_000

_CUT = re.compile(r"(?<=\S)([ \n])(?=\S)")
#: White space other than single spaces and line feeds between words.
_ODD = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"

_TAIL = ".,!?;:$%&*#"
_BEFORE_TAIL = r"(?s)\A.*[^.,!?;:$%&*#]"


def ragged(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of data that codes number, one after the other, and their sizes."""
    each = sizes[codes]
    ends = np.cumsum(each)
    at = np.repeat(starts[codes] - (ends - each), each)
    at += np.arange(len(at))
    return data[at], each


def pool(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), "i8", len(ids)) // 4


class UnitCache:
    """ids of whole texts by units, each worked out once for a batch of texts.

    A unit is what stands between spaces and line feeds, with the one before it.  Punctuation after
    a letter is cut off: there, too, a match of the pattern ends anyway.  ``encode_units`` gives the
    ids (little-endian unsigned 32-bit bytes) of units, which are kept; ``encode_words``, where given,
    those of words of letters, perhaps after a space, joined by line feeds, which are not."""

    def __init__(self, encode_units: Callable[[list[str]], list[bytes]], limit: int = CACHE_UNITS, encode_words: Callable[[str], np.ndarray] | None = None):
        self.encode_units, self.limit, self.encode_words = encode_units, limit, encode_words
        self.known: dict[str, bytes] = {}
        self.weight = 0  # bytes of units and ids, about
        self.line = encode_units(["\n"])[0]
        self.feed = np.frombuffer(self.line, "<u4")

    def _trim(self) -> None:
        if len(self.known) > self.limit or self.weight > CACHE_BYTES:
            kept, left, most = {}, int(CACHE_BYTES * KEEP), int(self.limit * KEEP)
            for unit, ids in self.known.items():
                left -= len(unit) + len(ids)
                if left < 0 or len(kept) >= most:
                    break
                kept[unit] = ids
            self.known, self.weight = kept, int(CACHE_BYTES * KEEP) - max(left, 0)

    def _ids(self, units: list[str]) -> list[bytes]:
        self._trim()
        got = [*map(self.known.get, units)]
        new = [u for u, i in zip(units, got, strict=True) if i is None]
        if not new:
            return got
        made = dict(zip(new, self.encode_units(new), strict=True))
        self.known |= made
        self.weight += sum(map(len, new)) + sum(map(len, made.values()))
        return [*map(self.known.__getitem__, units)]

    def _odd(self, text: str) -> bytes:
        bits = _CUT.split(text)
        units = [bits[0], *(" " + b if sep == " " else b for sep, b in zip(bits[1::2], bits[2::2], strict=True))]
        ids = self._ids(units)
        return ids[0] + b"".join(i if sep == " " else self.line + i for sep, i in zip(bits[1::2], ids[1:], strict=True))

    def _pooled(self, keys: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all keys (different strings; plain: words of letters), and how many each has."""
        if self.encode_words is None or not plain.any():
            return pool(self._ids(keys.to_numpy(zero_copy_only=False).tolist()))
        ids = self.encode_words("\n".join(keys.filter(pa.array(plain)).to_numpy(zero_copy_only=False).tolist()))
        feeds = np.flatnonzero(ids == self.feed[0])
        words = np.diff(np.r_[-1, feeds, len(ids)]) - 1
        rest, others = pool(self._ids(keys.filter(pa.array(~plain)).to_numpy(zero_copy_only=False).tolist()))
        sizes = np.empty(len(keys), "i8")
        sizes[plain], sizes[~plain] = words, others
        starts = np.empty(len(keys), "i8")
        starts[plain], starts[~plain] = np.cumsum(words) - words, words.sum() + np.cumsum(others) - others
        return ragged(np.concatenate([np.delete(ids, feeds), rest]), starts, sizes, np.arange(len(keys)))

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As _pooled, of units with the space or line feed before them."""
        from pyarrow import compute as pc

        feed = pc.starts_with(units, "\n")
        body = pc.if_else(feed, pc.utf8_slice_codeunits(units, 1), units)
        head = pc.utf8_rtrim(body, _TAIL)
        plain = pc.utf8_is_alpha(pc.utf8_ltrim(head, " "))
        keys = pc.if_else(plain, head, body).dictionary_encode()
        ends = pc.and_(plain, pc.not_equal(pc.binary_length(head), pc.binary_length(body))).to_numpy(zero_copy_only=False)
        tails = pc.replace_substring_regex(body.filter(pa.array(ends)), _BEFORE_TAIL, "").dictionary_encode()
        plain_keys = np.zeros(len(keys.dictionary), bool)
        plain_keys[keys.indices.to_numpy()] = plain.to_numpy(zero_copy_only=False)
        ids, sizes = self._pooled(keys.dictionary, plain_keys)
        tail_ids, tail_sizes = pool(self._ids(tails.dictionary.to_pylist()))
        # A unit is the line feed or none, a key, a tail or none.
        sizes = np.concatenate([[0, len(self.feed)], tail_sizes, sizes])
        pieces = np.zeros((len(units), 3), "i8")
        pieces[:, 0] = feed.to_numpy(zero_copy_only=False)
        pieces[:, 1] = 2 + len(tail_sizes) + keys.indices.to_numpy()
        pieces[ends, 2] = 2 + tails.indices.to_numpy()
        data, each = ragged(np.concatenate([self.feed, tail_ids, ids]), np.cumsum(sizes) - sizes, sizes, pieces.ravel())
        return data, each.reshape(-1, 3).sum(axis=1)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings, no nulls) in a row, and where each text's ids end."""
        from pyarrow import compute as pc

        odd = pc.match_substring_regex(texts, _ODD)
        # A line feed goes with the unit after it, like a space.
        parts = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n"), " ")
        words, odd = parts.flatten(), odd.to_numpy(zero_copy_only=False)
        counts = np.ones(len(texts), "i8")
        counts[~odd] = parts.value_lengths().to_numpy()
        first = np.cumsum(counts[~odd]) - counts[~odd]
        lead, rest = words.take(pa.array(first)).dictionary_encode(), words.dictionary_encode()
        codes = rest.indices.to_numpy().astype("i8")
        codes[first] = len(rest.dictionary) + lead.indices.to_numpy()
        after = rest.dictionary
        after = pc.if_else(pc.starts_with(after, "\n"), after, pc.binary_join_element_wise(pa.scalar(" "), after, ""))
        ids, sizes = self._units(pa.concat_arrays([after, lead.dictionary]))
        odd_ids, odd_sizes = pool([self._odd(t) for t in texts.filter(pa.array(odd)).to_pylist()])
        whole, is_odd = np.empty(counts.sum(), "i8"), np.repeat(odd, counts)
        whole[~is_odd], whole[is_odd] = codes, len(sizes) + np.arange(len(odd_sizes))
        sizes = np.concatenate([sizes, odd_sizes])
        data, each = ragged(np.concatenate([ids, odd_ids]), np.cumsum(sizes) - sizes, sizes, whole)
        return data, np.cumsum(each)[np.cumsum(counts) - 1] if len(texts) else np.zeros(0, "i8")

    def ids_many(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.flat(pa.array(texts, pa.string()))
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def ids(self, text: str) -> bytes:
        return self.ids_many([text])[0]


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens = {i: b for b, i in ranks.items()}
        self.auto = ahocorasick.Automaton()
        #: Of each token the edges that it has while it grows: (part, rank at which the part ends).
        self.right: dict[int, list[tuple[bytes, float]]] = {}
        self.left: dict[int, list[tuple[bytes, float]]] = {}
        for token, i in sorted(ranks.items(), key=lambda x: (len(x[0]), x[1])):
            parts = self._parts(token, i)
            if len(parts) > 2:  # can't come out of merging
                continue
            self.right[i], self.left[i] = [(token, float("inf"))], [(token, float("inf"))]
            if len(parts) == 2:
                head, tail = ranks[parts[0]], ranks[parts[1]]
                self.right[i] += [(parts[1], i), *self.right[tail][1:]]
                self.left[i] += [(parts[0], i), *self.left[head][1:]]
            self.auto.add_word(token.decode("latin-1"), (len(token), i))
        #: The longest token that is a proper prefix of a token.
        self.shorter: dict[int, int | None] = {}
        for i in self.right:
            cuts = (ranks.get(self.tokens[i][:k]) for k in range(len(self.tokens[i]) - 1, 0, -1))
            self.shorter[i] = next((c for c in cuts if c in self.right), None)
        self.auto.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache = UnitCache(lambda units: [*map(self._unit, units)])

    def _parts(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """Plain merging, leftmost of equal ranks first, by merges of a rank under ``below``."""
        get = self.ranks.get
        parts = [data[k : k + 1] for k in range(len(data))]
        found = [get(data[k : k + 2], below) for k in range(len(data) - 1)]
        while found and (rank := min(found)) < below:
            k = found.index(rank)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k:
                found[k - 1] = get(parts[k - 1] + parts[k], below)
            if k < len(found):
                found[k] = get(parts[k] + parts[k + 1], below)
        return parts

    def merge(self, data: bytes) -> list[int]:
        return [self.ranks[p] for p in self._parts(data)]

    def fit(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of tokens a and b gives a, b: no pair of edges that
        exist at the same time merges across the border before one of them ends."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHE_PAIRS:
                self.fits.clear()
            get = self.ranks.get
            known = self.fits[a, b] = not any(
                (rank := get(x + y)) is not None and rank < x_ends and rank <= y_ends for x, x_ends in self.right[a] for y, y_ends in self.left[b]
            )
        return known

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        return cls(ranks_of(path), pattern)

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, fit, known = data.decode("latin-1"), self.fit, self.fits.get
        longest = [i for _, (_, i) in self.auto.iter_long(text)]
        if all(known(pair) or fit(*pair) for pair in zip(longest, longest[1:])):
            return longest
        # Some longest match doesn't fit its neighbour: shorter ones, and steps back.
        open_ = bytearray(b"\1") * (len(data) + 1)
        stack: list[int] = []
        pos, token = 0, longest[0]
        while True:
            while token is not None:
                end = pos + len(self.tokens[token])
                if open_[end] and (not stack or fit(stack[-1], token)):
                    break
                token = self.shorter[token]
            if token is None:
                open_[pos] = 0
                token = stack.pop()
                pos -= len(self.tokens[token])
                token = self.shorter[token]
                continue
            stack.append(token)
            pos = end
            if pos == len(data):
                return stack
            token = next(self.auto.iter_long(text, pos))[1][1]

    def _unit(self, unit: str) -> bytes:
        pieces = self.split(unit)
        if len(pieces) == 1:
            return array("I", self.encode_piece(unit.encode())).tobytes()
        return b"".join(array("I", self.encode_piece(piece.encode())).tobytes() for piece in pieces)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.cache.ids(text), "<u4")


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe.load(path, pattern)
    return _LOADED[path, pattern]


def slices(batch: pa.RecordBatch, weigh: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose column ``weigh`` holds about ``limit`` bytes, one row at least."""
    from pyarrow import compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(weigh)), 0).to_pylist()
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def tokens_of(path: str) -> dict[int, bytes]:
    """Bytes by id, once for each worker process."""
    return {i: b for b, i in ranks_of(path).items()}


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>) for the rank file at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                ids, ends = bpe.cache.flat(batch.column("text"))
                lists = pa.ListArray.from_arrays(np.r_[0, ends].astype("i4"), ids.view("<i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with a binary column ``decoded``: the bytes of the ids.  Needs the rank table alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokens_of(path).__getitem__
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            column = batch.column(ids)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy()
            out = [b"".join(map(token, values[a:b].tolist())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, decoded binary")
