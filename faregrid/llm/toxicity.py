"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words and their
letter groups, and the document's score is their noisy-or: 1 - product of (1 - sentence score).
Only documents are labelled; the gradient of the noisy-or hands the blame to sentences, so
the trained model also says which ones offend.

The model is fitted on at most SAMPLE labelled ids, picked by hash, with one text each and SAMPLE_BYTES
of text in all, none of it above LONGEST bytes; scoring reads every whole text. A sentence ends at . ! ? or a line break, and after MOST_WORDS words.

Defined results: null, empty and blank texts have one empty sentence and its base score. Labels
that are null, or of ids without text, are left out; a label repeated for an id counts as toxic if
one says so, and of rows that repeat an id the text of smallest hash is learned from. Without both classes among the labels every score is the share of toxic labels (0
without labels). Rows that repeat an id are scored each on its own. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm.common import with_ids, written
from faregrid.llm.words import Words, buffers, pieces, words_of

SAMPLE = 12_000
SAMPLE_BYTES = 64 << 20
LONGEST = 1 << 20
HOLD_OUT = 5
LEAST_TOXIC = 0.5
BITS = 20
GROUPS = (4, 6)  # bytes of a letter group
MOST_WORDS = 32
LEAST_DOCS = 6
MOST_FEATURES = 20_000
LEAST_LEAN = 3.5  # standard errors between the classes
STEPS, RATE, DECAY = 200, 0.12, 2e-6
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n\r", np.uint8))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per feature bucket
    base: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % HOLD_OUT == 0


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence, and the row of each sentence that has words."""
    n = len(words.start)
    row = words.row_of()
    ends = np.concatenate([[0], np.cumsum(_ENDS[words.data])])[words.start]
    fresh = np.ones(n, bool)
    fresh[1:] = (row[1:] != row[:-1]) | (ends[1:] != ends[:-1])
    begin = np.flatnonzero(fresh)
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    first = np.flatnonzero(place % MOST_WORDS == 0)
    return first, row[first]


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word of every feature: the words themselves and their letter groups."""
    up = np.uint64(64 - BITS)
    ids, of = [words.hash >> up], [np.arange(len(words.start))]
    for size in GROUPS:
        count = np.maximum(words.end - words.start - size + 1, 0)
        before = np.cumsum(count) - count
        at = np.arange(count.sum()) + np.repeat(words.start - before, count)
        ids.append(((words.spans(at, at + size) + np.uint64(size)) * np.uint64(0x9FB21C651E98DF25)) >> up)
        of.append(np.repeat(np.arange(len(count)), count))
    return np.concatenate(ids).astype(np.int64), np.concatenate(of)


def _scan(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, at = buffers(texts)
    for row, to in pieces(at, 1 << 19):
        yield row, to, words_of(data[at[row] : at[to]], at[row : to + 1] - at[row], lower=True, letters=True)


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Train on a bounded sample of documents, on the driver."""
    weights, positive = np.zeros(1 << BITS), float(labels.mean()) if len(labels) else 0.0
    if not 0 < positive < 1:
        return Model(weights, np.inf if positive else -np.inf)
    seen = np.zeros((2, 1 << BITS), np.int64)
    for row, to, words in _scan(texts):
        ids, of = features(words)
        pairs = np.unique((words.row_of()[of] << BITS) | ids)
        label = labels[row + (pairs >> BITS)]
        for y in (0, 1):
            seen[y] += np.bincount(pairs[label == y] & ((1 << BITS) - 1), minlength=1 << BITS)
    total = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    rate = (seen + 0.5) / (total + 1)
    lean = np.abs(np.log(rate[1]) - np.log(rate[0])) / np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    lean[seen.sum(axis=0) < LEAST_DOCS] = 0
    chosen = np.flatnonzero(lean > LEAST_LEAN)
    chosen = chosen[np.argsort(-lean[chosen], kind="stable")[:MOST_FEATURES]]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    used, owner, rows, done = [], [], [], 0
    for row, _, words in _scan(texts):
        first, of_row = sentences(words)
        ids, of = features(words)
        kept = place[ids] >= 0
        used.append(place[ids[kept]].astype(np.int32))
        owner.append((np.searchsorted(first, of[kept], "right") - 1 + done).astype(np.int32))
        rows.append(of_row + row)
        done += len(first)
    x, sentence, doc = np.concatenate(used), np.concatenate(owner), np.concatenate(rows)
    # Sentences without a chosen feature have the base score; a count per document will do.
    said, sentence = np.unique(sentence, return_inverse=True)
    plain = np.bincount(doc, minlength=len(texts)) - np.bincount(doc[said], minlength=len(texts))
    doc = doc[said]
    w, base = np.zeros(len(chosen)), -6.0
    mean, square = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, STEPS + 1):
        z = np.clip(np.bincount(sentence, w[x], len(said)) + base, -30, 30)
        p, rest = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-base))
        clean = np.bincount(doc, np.log1p(-p), len(texts)) + plain * np.log1p(-rest)  # log of the chance that nothing offends
        none = np.exp(clean)
        pull = np.where(labels == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        push = -p * pull[doc] / len(texts)  # d loss / d z
        bias = push.sum() - rest * (pull * plain).sum() / len(texts)
        slope = np.append(np.bincount(x, push[sentence], len(w)) + DECAY * w, bias)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, base = w - move[:-1], base - move[-1]
    weights[chosen] = w
    return Model(weights.astype(np.float32), float(base))


def _logistic(z: np.ndarray | float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-np.asarray(z, np.float64)))


def _noisy_or(p: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return -np.expm1(np.bincount(of, np.log1p(-p), rows))


def _sentence_scores(words: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, row and score of each sentence."""
    first, row = sentences(words)
    ids, of = features(words)
    per_word = np.bincount(of, model.weights[ids], len(words.start))
    z = np.add.reduceat(per_word, first) + model.base if len(first) else np.empty(0)
    return first, row, _logistic(z)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Written (by, then, toxic, text) of labelled ids that aren't held out, a row per id.

    The ``sample`` of smallest hash at most, and of these as many as ``sample_bytes`` hold.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    total = known.count()
    if total > sample:
        # The sample's size varies by its root; a tenth less keeps it under the bound.
        known = known.where(rank < F.lit(int((1 << 30) * 0.9 * sample / total)))
    known = written(known, "labels")
    short = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST)
    texts = with_ids(short, "doc_id", written(known.select("doc_id"), "ids"), keep=True)
    # One text an id, combined before the shuffle.
    text = F.min(F.struct(F.xxhash64("text").alias("then"), "text")).alias("t")
    rows = texts.groupBy("doc_id").agg(text).join(known, "doc_id")
    rows = written(rows.select(F.xxhash64("doc_id").alias("by"), "t.then", "toxic", "t.text"), "training")
    size = F.octet_length("text").cast("long").alias("size")
    if (rows.agg(F.sum(size)).first()[0] or 0) > sample_bytes:
        # At most ``sample`` slim rows in the window.
        running = F.sum("size").over(Window.orderBy("by").rowsBetween(Window.unboundedPreceding, 0))
        fits = rows.select("by", size).withColumn("total", running).where(F.col("total") <= sample_bytes)
        rows = rows.join(F.broadcast(fits.select("by")), "by")
    return rows


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows that aren't held out (:func:`training_rows`)."""
    rows = training_rows(docs, labels, sample).select("by", "then", "toxic", "text").toArrow()
    # A fixed order, so that sums and with them the model do not depend on the tasks' order.
    order = rows.select(["by", "then"]).to_pandas().sort_values(["by", "then"]).index.to_numpy()
    labels = (rows.column("toxic").to_numpy()[order] > 0).astype(np.int64)
    ordered = rows.column("text").combine_chunks().cast(pa.large_string()).take(pa.array(order))
    del rows
    return fit(ordered, labels)


def _scores(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, Words, tuple]]:
    """Row range, score of each row, words and their sentences, piece by piece."""
    blank = _logistic(model.base)
    for row, to, words in _scan(texts):
        found = _sentence_scores(words, model)
        score = np.where(words.counts() > 0, _noisy_or(found[2], found[1], to - row), blank)
        yield row, to, score, words, found


def _offences(words: Words, raw: np.ndarray, found: tuple, score: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """Sentences that offend by themselves, and the worst sentence of each row found toxic, the first of equals."""
    first, of, p = found
    count = np.bincount(of, p >= LEAST_TOXIC, len(score)).astype(np.int64)
    last = np.append(first[1:], len(words.start)) - 1
    order = np.lexsort((-np.arange(len(p)), p, of))
    ends = np.flatnonzero(np.append(of[order][1:] != of[order][:-1], True)) if len(of) else np.empty(0, np.int64)
    texts: list[str | None] = [None] * len(score)
    for i in order[ends]:
        if score[of[i]] >= LEAST_TOXIC:
            texts[of[i]] = raw[words.start[first[i]] : words.end[last[i]]].tobytes().decode()
    return count, texts


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_offending and worst_sentence of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            for row, to, score, words, found in _scores(batch.column(1), shared.value):
                count, texts = _offences(words, data[at[row] : at[to]], found, score)
                columns = [batch.column(0).slice(row, to - row), pa.array(score), pa.array(count), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "n_offending", "worst_sentence"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_offending long, worst_sentence string")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Sentences with a score of ``least`` or more: doc_id, sentence (from 0), score, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(1))
            for row, to, words in _scan(batch.column(1)):
                first, of, p = _sentence_scores(words, shared.value)
                number = np.arange(len(first)) - np.searchsorted(of, of)
                last = np.append(first[1:], len(words.start)) - 1
                hit = np.flatnonzero(p >= least)
                raw = data[at[row] : at[to]]
                texts = [raw[words.start[first[i]] : words.end[last[i]]].tobytes().decode() for i in hit]
                ids = batch.column(0).slice(row, to - row).take(pa.array(of[hit]))
                columns = [ids, pa.array(number[hit], pa.int64()), pa.array(p[hit]), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sentence", "score", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence long, score double, text string")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and what makes it toxic.

    ``n_offending`` counts sentences that reach LEAST_TOXIC by themselves; ``worst_sentence`` is the
    one of highest score in rows predicted toxic, null in the others and where a text has no words.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(slim, trained(slim, labels))
    return out.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= LEAST_TOXIC).cast("int").alias("predicted"),
        "n_offending",
        "worst_sentence",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay.

    Each row goes or stays by its own text, whether its id is null or shared with other rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(trained(slim, labels))
    place = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, score, *_ in _scores(batch.column(place), shared.value):
                yield batch.slice(row, to - row).filter(pa.array(score < LEAST_TOXIC))

    return docs.mapInArrow(run, docs.schema)
