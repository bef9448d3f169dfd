"""Repeated passages by prefix-partitioned suffix trees.

Suffixes start at words. Which of them can lie below a deep node is found first: each window of
WINDOW words is anchored at its PREFIX words of smallest hash, so equal windows have equal anchors,
and one anchor serves the windows around it. Anchors that occur once are leaves and go no
further. The others split the suffixes into groups by their prefix, several small groups to
a task. There a group's suffixes are sorted, and the lengths of the prefixes that neighbours share
give the tree: leaves without a shallower place between them lie below one internal node. The leaves
below a node of depth WINDOW or more are occurrences of one passage, and all but the earliest are repeats.
Where too many suffixes share a prefix, the prefix is lengthened to the whole window, whose
node needs only its earliest leaf, a minimum that is combined before the shuffle.

A repeat is judged on the input: a window whose words also start in a document of smaller id, or
earlier in the same one. Every word that a repeat covers is removed.

Defined results: null, empty and blank texts have no words and stay as they are, as do texts under
WINDOW words. Rows that repeat an id and a text are one document and get the same result. Rows that
repeat an id with another text are documents of their own, in the order of their texts' hashes. Rows
without id come after all others and among themselves are held in the same way. Other columns take no
part. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import BROADCAST_IDS, folded, text_batches, written
from faregrid.llm.words import Words, scan

WINDOW = 20
PREFIX = 4
GROUP = 5_000  # anchored stretches of a group of prefixes, about 1 MB
SHARED = 20_000  # a prefix of more than a task holds at once, some 4 MB, is lengthened to the whole window
LAST = (1 << 63) - 1
_PLACE = np.uint64((1 << 28) - 1)
_KEY = ["doc", "twin"]  # id and, where rows share an id, the hash of the text
_RUNS = "prefix long, doc long, twin long, first int, n int"


def anchored(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and prefix of each stretch with one anchor."""
    n, wide = len(words.hash), WINDOW - PREFIX + 1
    none = np.empty(0, np.int64)
    if n < WINDOW:
        return none, none, none, none
    grams = words.grams(PREFIX)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    single, step = least, 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(single) - wide + 1], least[wide - step : len(single) - step + 1])
    at = (least & _PLACE).astype(np.int64)
    row = words.row_of()
    whole = (words.first[1:][row] - np.arange(n) >= WINDOW)[: len(at)]
    fresh = whole.copy()
    fresh[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    starts = np.flatnonzero(fresh)
    ends = np.flatnonzero(whole & np.append(fresh[1:] | ~whole[1:], True)) + 1
    return row[starts], starts - words.first[row[starts]], ends - starts, grams[at[starts]].view(np.int64)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            words = [(t or "").encode().split() for t in batch.column(2).slice(at, 64).to_pylist()]
            sums = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            key = [batch.column(i).slice(at, 64) for i in range(2)]
            columns = [*key, pa.array([len(w) for w in words], pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, "n_words", "digest"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, to, words in scan(batch.column(2)):
            of, first, n, prefix = anchored(words)
            key = [batch.column(i).slice(row, to - row).take(pa.array(of, pa.int64())) for i in range(2)]
            columns = [pa.array(prefix, pa.int64()), *key, pa.array(first, pa.int32()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["prefix", *_KEY, "first", "n"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, as Python objects take many times their bytes."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each stretch of (doc, twin, text, runs)."""
    for batch in _slices(batches):
        out: list[tuple] = []
        for doc, twin, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            words = text.encode().split()
            for r in runs:
                end = r["first"] + r["n"] + WINDOW - 1
                out.append((r["prefix"], r["first"], r["n"], doc, twin, b" ".join(words[r["first"] : end])))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["prefix", "first", "n", *_KEY, "words"])


def _leaves(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretch of each window, and its place there."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _numbered(said: list[bytes] | pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Number of each word of stretches whose words are joined by one space; equal words have equal numbers.

    A few bytes a word, where a Python object takes ten times that.
    """
    chunks = said.chunks if isinstance(said, pa.ChunkedArray) else [pa.array(said, pa.binary())]
    words = pa.chunked_array([pc.split_pattern(c, pattern=b" ").flatten() for c in chunks], pa.binary())
    parts = words.dictionary_encode().unify_dictionaries().chunks
    return np.concatenate([np.empty(0, np.int32), *(c.indices.to_numpy(zero_copy_only=False) for c in parts)])


def subtree(said: list[bytes] | pa.Array | pa.ChunkedArray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that start windows, sorted, and how many words (to WINDOW) each shares with the one before.

    Windows are numbered in order of stretches. Ranks of suffixes by their first words double in
    depth; two suffixes share what the depths at which their ranks agree, tried from the largest, add up to.
    """
    ranks = {1: _numbered(said)}
    # Four bytes a word are enough: a group has far fewer than 2**31.
    ranked = lambda x, y: np.unique(x[: len(y)].astype(np.int64) * (int(y.max()) + 1) + y, return_inverse=True)[1].astype(np.int32)
    depth = 1
    while 2 * depth <= WINDOW:
        ranks[2 * depth] = ranked(ranks[depth], ranks[depth][depth:])
        depth *= 2
    whole, at = ranks[depth], depth
    while at < WINDOW:
        more = max(d for d in ranks if d <= WINDOW - at)
        whole, at = ranked(whole, ranks[more][at:]), at + more
    of, place = _leaves(n)
    length = n + WINDOW - 1
    start = (np.cumsum(length) - length)[of] + place
    order = np.argsort(whole[start], kind="stable")
    left, right = start[order][:-1], start[order][1:]
    shared = np.zeros(len(left), np.int64)
    for d in sorted(ranks, reverse=True):
        fits = shared + d <= WINDOW
        a, b = (np.where(fits, x + shared, 0) for x in (left, right))
        shared += np.where(fits & (ranks[d][a] == ranks[d][b]), d, 0)
    return order, np.append(0, shared)[: len(order)]


def _subtrees(group: pa.Table) -> pa.Table:
    """Ranges (doc, twin, start, n) of windows that aren't the earliest below their deep node."""
    n, doc, twin, first = (group.column(c).to_numpy() for c in ("n", *_KEY, "first"))
    order, shared = subtree(group.column("words"), n)
    of, place = _leaves(n)
    start = first[of] + place
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(shared < WINDOW)
    order = np.lexsort((start, twin[of], doc[of], node))
    lead = np.ones(len(order), bool)
    lead[1:] = node[order][1:] != node[order][:-1]
    earliest = order[lead][np.cumsum(lead) - 1]
    later = np.empty(len(order), bool)
    here, there = of[order], of[earliest]
    later[order] = (doc[here] != doc[there]) | (twin[here] != twin[there]) | (start[order] != start[earliest])
    fresh, last = later.copy(), later.copy()
    fresh[1:] &= ~later[:-1] | (of[1:] != of[:-1])
    last[:-1] &= ~later[1:] | (of[1:] != of[:-1])
    a, b = np.flatnonzero(fresh), np.flatnonzero(last)
    return pa.table({"doc": doc[of[a]], "twin": twin[of[a]], "start": start[a].astype(np.int32), "n": (b - a + 1).astype(np.int32)})


def _whole_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of each stretch under the digest of its words."""
    for batch in _slices(batches, 512):
        out: list[tuple] = []
        for first, n, doc, twin, text in zip(*(batch.column(c).to_pylist() for c in ("first", "n", *_KEY, "words")), strict=True):
            words = text.split()
            out += [(hashlib.blake2b(b" ".join(words[j : j + WINDOW]), digest_size=16).digest(), doc, twin, first + j) for j in range(n)]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        columns = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["window", *_KEY, "start"])


def _kept(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words outside the repeats of (doc, twin, text, ranges)."""
        for batch in _slices(batches):
            out = []
            for doc, twin, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.encode().split()
                edges = np.zeros(len(words) + 1, np.int64)
                for r in ranges:
                    edges[r["start"]] += 1
                    edges[r["start"] + r["n"] + WINDOW - 1] -= 1
                stays = np.cumsum(edges[:-1]) == 0
                left = b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s])
                out.append((doc, twin, int((~stays).sum()), hashlib.sha256(left).hexdigest() if digests else left.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, "n_removed", "kept"])

    return run


def _among(df: DataFrame, keys: DataFrame, keep: bool) -> DataFrame:
    """Rows of ``df`` whose key is (``keep``) or isn't among the written, distinct ``keys``."""
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys.hint("merge")
    return df.join(keys, _KEY, "left_semi" if keep else "left_anti")


def _beside_text(texts: DataFrame, rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """(doc, twin, text, rows of the document as an array); a document has no more rows than words."""
    rows = rows.groupBy(*_KEY).agg(F.collect_list(F.struct(*fields)).alias(name))
    keys = folded(rows.select(*_KEY), "keys")
    return _among(texts, keys, keep=True).join(rows, _KEY).select(*_KEY, "text", name)


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """Written (doc, twin, start, n): n windows from word start on are repeats. ``texts`` has doc, twin, text, a row per key."""
    runs = written(texts.mapInArrow(_stretches, _RUNS), "runs")
    counts = written(runs.groupBy("prefix").agg(F.count(F.lit(1)).alias("shared")).where("shared > 1"), "prefixes")
    open_runs = written(runs.join(counts, "prefix"), "open")
    fields = ["prefix", "first", "n"]
    kinds = "prefix long, first int, n int, doc long, twin long, words binary"

    def followed(part: DataFrame) -> DataFrame:
        return _beside_text(texts, part, fields, "runs").mapInArrow(_with_words, kinds)

    few = open_runs.where(F.col("shared") <= SHARED)
    tasks = max(1, -(-few.count() // GROUP))
    bins = followed(few).withColumn("bin", F.pmod(F.xxhash64("prefix"), F.lit(tasks)))
    ranges = bins.groupBy("bin").applyInArrow(_subtrees, "doc long, twin long, start int, n int")
    place = F.struct(*_KEY, "start")
    hot = followed(open_runs.where(F.col("shared") > SHARED))
    windows = written(hot.mapInArrow(_whole_windows, "window binary, doc long, twin long, start int"), "windows")
    earliest = windows.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size"))
    earliest = folded(earliest.where("size > 1").select("window", "first"), "earliest")
    later = windows.join(earliest, "window").where(place != F.col("first"))
    return written(ranges.unionByName(later.select(*_KEY, "start", F.lit(1).alias("n"))), "ranges")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and ``kept``.

    ``kept`` is the words that stay, joined by one space, or their SHA-256 with ``digests``.
    """
    with text_batches(docs.sparkSession):
        return _without_repeats(docs, id_col, text_col, digests)


def _without_repeats(docs: DataFrame, id_col: str, text_col: str, digests: bool) -> DataFrame:
    own, text = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(own.alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))
    profiles = written(texts.mapInArrow(_profiles, "doc long, twin long, n_words long, digest string"), "profiles")
    ids = profiles.groupBy("doc").agg(F.min("twin").alias("a"), F.max("twin").alias("b"))
    if ids.where("a < b").isEmpty():
        # The id alone is the key; a constant costs the shuffles nothing.
        texts, profiles = (df.withColumn("twin", F.lit(0).cast("long")) for df in (texts, profiles))
    # Of equal texts only the first can hold the earliest windows; the others go as a whole.
    long = profiles.where(F.col("n_words") >= WINDOW)
    copies = long.groupBy("digest").agg(F.min(F.struct(*_KEY)).alias("lead"), F.max(F.struct(*_KEY)).alias("last"))
    copies = folded(copies.where("lead < last").select("digest", "lead"), "copies")
    gone = folded(long.join(copies, "digest").where(F.struct(*_KEY) > F.col("lead")).select(*_KEY).distinct(), "gone")
    leads = _among(texts, gone, keep=False)
    # Rows that repeat a document's id and text are searched once.
    again = folded(long.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEY), "again")
    if not again.isEmpty():
        once = written(_among(leads, again, keep=True).dropDuplicates(_KEY), "once")
        leads = _among(leads, again, keep=False).unionByName(once)
    ranges = repeated_ranges(leads)
    stripped = _beside_text(leads, ranges, ["start", "n"], "ranges")
    stripped = stripped.mapInArrow(_kept(digests), "doc long, twin long, n_removed long, kept string")
    nothing = hashlib.sha256(b"").hexdigest() if digests else ""
    emptied = gone.withColumns({"n_removed": F.lit(-1).cast("long"), "kept": F.lit(nothing)})
    changed = written(stripped.unionByName(emptied), "changed")
    if digests:
        plain = profiles.withColumn("own", F.col("digest"))
    else:
        spaced = F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "))
        plain = texts.select(*_KEY, spaced.alias("own"))
        plain = plain.withColumn("n_words", F.coalesce(F.regexp_count("own", F.lit("[^ ]+")), F.lit(0)).cast("long"))
    removed = F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return plain.join(changed, _KEY, "left").select(
        F.nullif(F.col("doc"), F.lit(LAST)).alias("doc_id"),
        "n_words",
        removed.cast("long").alias("n_removed"),
        F.coalesce("kept", "own").alias("kept"),
    )
