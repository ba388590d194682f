"""Source divergence audit: how far the term use of each source is from the others of its language.

Terms are runs of ASCII letters and characters beyond ASCII; only A-Z is lower-cased.  A language keeps
the terms that at least MIN_DOCS of its documents have.  A group is a (lang, source); it and its language
give each kept term the smoothed share p = 1 + floor(SCALE * (count + 5) / (N + 5 * V)) in exact integers,
N all its occurrences of kept terms, V the kept terms of the language.

pair    each other source of the language, valued with the sum of |p - q| over all kept terms
term    the group's kept terms that it uses more than the language does, valued with p - q; the first TOP

For ``pair`` each group has sorted arrays (term id, count), one for each part of the language's terms; terms are
dealt by hash to one part per 2 ** PART_BITS of them, so an array is bounded whatever the vocabulary.  Every unordered pair of groups is a task for each part: the two
groups' arrays are co-grouped, the ids of the shorter one gallop through the longer one, and overlaps and
terms of one side are priced; terms that both lack have one price and are multiplied out at the end.

Texts are counted in tasks before anything is shuffled, COUNTED tokens at a time, and huge texts piece
by piece.  Null text, lang and source count as ''.  Repeated rows are documents of their own.  Groups
without terms are compared like any other; where a language keeps no term all values are 0 and there are
no terms.  An only source has no pairs.  An empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from treeline.llm.common import numbered, written

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
PART_BITS = 16  # terms of a part, about
COUNTED = 2_000_000
PIECE = 1 << 20
GALLOP = 64  # ids that gallop together
#: Bytes as terms see them: A-Z lower, letters and bytes beyond ASCII as they are, all else a space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + PIECE].translate(BYTES)
        cut = len(piece) if at + PIECE >= len(text) else piece.rfind(b" ") + 1
        if not cut:  # one term fills the piece: all of it
            rest = text[at:].translate(BYTES)
            cut = max(rest.find(b" "), 0) or len(rest)
            piece = rest[:cut]
        yield piece[:cut].split()
        at += cut


def term_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) of docs (lang, source, text): occurrences, and documents with the
    term.  A row with a null term stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[tuple[str, str], tuple[list[bytes], list[bytes]]] = {}
        held = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (all_terms, by_doc) in said.items():
                n, has = Counter(all_terms), Counter(by_doc)
                own = [None, *n]
                cols = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own, pa.binary())]
                cols += [pa.array([0, *n.values()], pa.int64()), pa.array([0, *(has[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for k, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                all_terms, by_doc = said.setdefault(group, ([], []))
                met: set[bytes] = set()
                for some in terms(texts[k].as_py()):
                    new = set(some) - met
                    met |= new
                    all_terms += some
                    by_doc += new
                    held += len(some)
                    if held >= COUNTED:
                        yield from counted()
                        said = {group: ([], [])}
                        all_terms, by_doc = said[group]
                        held = 0
        yield from counted()

    each = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = each.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), by long division, so nothing overflows."""
    a, b = n + SMOOTH, F.greatest(total + SMOOTH * kept, F.lit(1))
    first = F.call_function("div", a * 100_000, b)
    rest = a * 100_000 - first * b
    return 1 + first * 10_000 + F.call_function("div", rest * 10_000, b)


def _shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """share in a task."""
    a, b = n.astype("i8") + SMOOTH, total + SMOOTH * kept
    first, rest = np.divmod(a * 100_000, b)
    return 1 + first * 10_000 + rest * 10_000 // b


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where in ``long`` each id of ``short`` is, -1 where it isn't; both sorted.  Runs of ids search
    from where the last one ended, in steps that double."""
    out, at = np.full(len(short), -1, "i8"), 0
    for k in range(0, len(short), GALLOP):
        run = short[k : k + GALLOP]
        step = GALLOP
        while at + step < len(long) and long[at + step] < run[-1]:
            step *= 2
        reach = long[at : at + step + 1]
        place = np.searchsorted(reach, run)
        hit = place < len(reach)
        hit[hit] = reach[place[hit]] == run[hit]
        out[k : k + GALLOP][hit] = at + place[hit]
        at += int(place[-1])
    return out


def _merged(left: pa.Table, right: pa.Table) -> pa.Table:
    """One row (pair, value, met) of one pair of groups and one part of the terms: the sum over terms that at least
    one of them has, and their number."""
    def side(table: pa.Table, other: pa.Table, name: str, over: str) -> tuple[np.ndarray, np.ndarray, int]:
        total = (table if table.num_rows else other).column(name if table.num_rows else over)[0].as_py()
        if not table.num_rows:
            return np.zeros(0, "i8"), np.zeros(0, "i8"), total
        ids, n = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "counts"))
        return ids, n, total

    some = left if left.num_rows else right
    kept, pair = some.column("kept")[0].as_py(), some.column("pair")[0].as_py()
    (a_ids, a_n, a_total), (b_ids, b_n, b_total) = side(left, right, "own_total", "other_total"), side(right, left, "own_total", "other_total")
    if len(a_ids) > len(b_ids):
        a_ids, a_n, a_total, b_ids, b_n, b_total = b_ids, b_n, b_total, a_ids, a_n, a_total
    zero = np.zeros(1, "i8")
    a_p, b_p = _shares(a_n, a_total, kept), _shares(b_n, b_total, kept)
    a_none, b_none = _shares(zero, a_total, kept)[0], _shares(zero, b_total, kept)[0]
    place = gallop(a_ids, b_ids)
    both = place >= 0
    only_b = np.ones(len(b_ids), bool)
    only_b[place[both]] = False
    value = np.abs(a_p[both] - b_p[place[both]]).sum() + np.abs(a_p[~both] - b_none).sum() + np.abs(b_p[only_b] - a_none).sum()
    return pa.table({"pair": [pair], "value": [int(value)], "met": [len(a_ids) + int(only_b.sum())]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank)."""
    counts = written(term_counts(docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))))
    own = counts.filter("term is not null")
    kept = numbered(own.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs).drop("docs"))
    known = written(own.join(kept, ["lang", "term"]).select("lang", "source", "term", F.col("row").alias("id"), "n", "lang_n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = numbered(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total", "kept", "lang_total")]))

    used = known.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    more = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = used.select("lang", "source", F.col("term").alias("item"), more.alias("value")).filter("value > 0").withColumn("rank", F.row_number().over(by_value))
    top_terms = ranked.filter(F.col("rank") <= top).withColumn("part", F.lit("term"))

    g, h = groups.select("lang", "kept", F.col("row").alias("a"), F.col("total").alias("a_total"), F.col("source").alias("a_source")), groups.select("lang", F.col("row").alias("b"), F.col("total").alias("b_total"), F.col("source").alias("b_source"))
    pairs = numbered(g.join(h, "lang").filter("a < b")).withColumnRenamed("row", "pair")  # these pairs are the result's rows
    part = F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / (1 << PART_BITS)).cast("bigint"))
    arrays = known.join(groups.select("lang", "source", "row", "kept"), ["lang", "source"]).groupBy("row", part.alias("share"))
    arrays = arrays.agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("x")).select("row", "share", F.col("x.id").alias("ids"), F.col("x.n").alias("counts"))
    arrays = written(arrays)

    def side(own_row: str, own_total: str, other_total: str) -> GroupedData:
        named = pairs.select("pair", "kept", F.col(own_row).alias("row"), F.col(own_total).alias("own_total"), F.col(other_total).alias("other_total"))
        both = named.join(arrays, "row")
        fields = ("pair", "share", "kept", "own_total", "other_total", "ids", "counts")
        return both.select(*[F.col(c).alias(c) for c in fields]).groupBy("pair", "share")  # columns of its own: the sides share a table

    left, right = side("a", "a_total", "b_total"), side("b", "b_total", "a_total")
    merged = left.cogroup(right).applyInArrow(_merged, "pair bigint, value bigint, met bigint")
    merged = merged.groupBy("pair").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    none = F.abs(share(F.lit(0).cast("bigint"), F.col("a_total"), F.col("kept")) - share(F.lit(0).cast("bigint"), F.col("b_total"), F.col("kept")))
    priced = pairs.join(merged, "pair", "left").withColumn(
        "value", F.when(F.col("kept") == 0, F.lit(0).cast("bigint")).otherwise(F.coalesce("value", F.lit(0)) + (F.col("kept") - F.coalesce("met", F.lit(0))) * none)
    )
    each = priced.select("lang", "value", F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))).alias("s"))
    pair_rows = each.select("lang", "s.source", "s.item", "value").withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    return pair_rows.unionByName(top_terms).select("lang", "source", "part", "item", "value", "rank")
