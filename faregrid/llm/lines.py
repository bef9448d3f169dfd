"""Lines that repeat across documents.

Texts are exploded into the keys of their lines, each key once a row, as 128-bit digests. One
shuffle with map-side sums counts the documents of each key; keys at the threshold meet the
rows that hold them again, and each text is reassembled from the lines that stay, by position.
A key counts once a row before the shuffle, so a very common line arrives as one row per task.

Defined results: null and empty texts are one empty line and stay. A document is a ``doc_id``: rows
that repeat one count once, and all of them keep the lines of the largest id. Rows without an id
are documents of their own, told apart by their texts, and rank before all ids; where only such
rows hold a key, the rows of one of the texts keep it. A line that repeats inside one document counts
once and goes or stays with all its copies. Other columns take no part. Empty tables give empty
results. A long text is searched a megabyte at a time; memory follows its size, not its lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import BROADCAST_IDS, folded, unused, with_ids, written

MIN_CHARS = 40
MIN_DOCS = 5
_SPACE = b" \t\n\v\f\r"
_BLOCK = 1 << 20
_ROWS = 64
_EMIT = 1 << 16


def long_lines(raw: bytes, least: int) -> Iterator[tuple[int, int, int]]:
    """(line number, start, end) of the lines of at least ``least`` bytes."""
    view, number, opened = np.frombuffer(raw, np.uint8), 0, 0
    for at in range(0, len(raw), _BLOCK):
        ends = np.flatnonzero(view[at : at + _BLOCK] == 10) + at
        if len(ends):
            starts = np.concatenate(([opened], ends[:-1] + 1))
            for i in np.flatnonzero(ends - starts >= least).tolist():
                yield number + i, int(starts[i]), int(ends[i])
            number, opened = number + len(ends), int(ends[-1]) + 1
    if len(raw) - opened >= least:
        yield number, opened, len(raw)


def keyed(raw: bytes, least: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(line number, start, end, digest of the key) of the lines whose key has ``least`` code points."""
    for number, start, end in long_lines(raw, least):
        key = raw[start:end].strip(_SPACE).lower()  # of bytes: ASCII letters only
        if len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least):
            yield number, start, end, hashlib.blake2b(key, digest_size=16).digest()


def without(raw: bytes, gone: frozenset[bytes] | set[bytes], least: int) -> tuple[int, list[bytes]]:
    """Lines dropped, and the stretches of text between them; joined by newlines they are what stays."""
    dropped, parts, number, at = 0, [], 0, 0
    for line, start, end, key in keyed(raw, least) if gone else ():
        if key in gone:
            if line > number:
                parts.append(raw[at : start - 1])
            dropped, number, at = dropped + 1, line + 1, end + 1
    if at <= len(raw):
        parts.append(raw[at:])
    return dropped, parts


def _own(doc: Column, text: Column) -> Column:
    """Tells rows without an id apart."""
    return F.when(doc.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))


def _keys(least: int):
    """(doc, own, key) of each distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "own", "key"]
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            columns: list[list] = [[], [], []]
            for at in range(0, len(batch), _ROWS):
                docs, owns, texts = (batch.column(i).slice(at, _ROWS) for i in range(3))
                for doc, own, text in zip(docs.to_pylist(), owns.to_pylist(), texts, strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    found = {key for *_, key in keyed(raw, least)}
                    for column, values in zip(columns, ([doc] * len(found), [own] * len(found), found), strict=True):
                        column.extend(values)
                    if len(columns[0]) >= _EMIT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                        columns = [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def repeated_keys(keys: DataFrame, again: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, keep_doc, keep_own): keys of at least ``min_docs`` documents and the document that keeps them.

    ``keys`` has a row per key and row of documents. Rows are counted first; what rows without an id
    or with one of the ids ``again`` count too much is taken off again, at the cost of those rows only.
    """
    own = F.max(F.when(F.col("doc").isNull(), F.col("own")))
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keep_doc"), own.alias("keep_own"))
    often = counts.where(F.col("n") >= min_docs)
    unsure = with_ids(keys, "doc", again, keep=True).unionByName(keys.where("doc is null"))
    extra = unsure.groupBy("key", "doc", "own").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")
    extra = folded(extra.groupBy("key").agg(F.sum("extra").alias("extra")), "lines-extra")
    if not extra.isEmpty():
        often = often.join(extra, "key", "left").where(F.col("n") - F.coalesce(F.col("extra"), F.lit(0)) >= min_docs)
    return often.select("key", "keep_doc", "keep_own")


def gone_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, own, gone): per document the keys whose lines it loses. Written."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    slim = docs.select(doc.alias("doc"), _own(doc, text).alias("own"), text.alias("text"))
    keys = written(slim.mapInArrow(_keys(min_chars), "doc long, own long, key binary"), "lines")
    ids = slim.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    found = written(repeated_keys(keys, folded(ids.where("n > 1").select("doc"), "lines-again"), min_docs), "lines-repeated")
    keeps = F.when(F.col("keep_doc").isNotNull(), F.col("doc").eqNullSafe(F.col("keep_doc"))).otherwise(F.col("own") == F.col("keep_own"))
    hits = keys.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, "key").where(~keeps)
    # At most the distinct lines of one document.
    return written(hits.groupBy("doc", "own").agg(F.collect_set("key").alias("gone")), "lines-gone")


def _met(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with the keys each row loses, and the name of that column.

    Up to BROADCAST_IDS keys go to the executors and texts stay where they are; more are joined by shuffle.
    """
    name, doc, own = (unused(docs, x) for x in ("gone", "gone_doc", "gone_own"))
    gone = gone.select(F.col("doc").alias(doc), F.col("own").alias(own), F.col("gone").alias(name))
    total = gone.agg(F.coalesce(F.sum(F.size(name)), F.lit(0))).scalar()
    small = not gone.sparkSession.range(1).where(total <= BROADCAST_IDS).isEmpty()
    mine = docs[id_col].cast("long")
    same = mine.eqNullSafe(gone[doc]) & (_own(mine, docs[text_col]) == gone[own])
    return docs.join(F.broadcast(gone) if small else gone, same, "left").drop(doc, own), name


def without_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digests: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped and ``kept``, the text or its SHA-256."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    met, name = _met(slim, gone_keys(docs, id_col, text_col, min_chars, min_docs), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                ids, texts, gone = (batch.column(i).slice(at, _ROWS) for i in range(3))
                lines, dropped, kept = [], [], []
                for text, keys in zip(texts, gone.to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    n, parts = without(raw, set(keys or ()), min_chars)
                    lines.append(raw.count(b"\n") + 1)
                    dropped.append(n)
                    kept.append(_sha256(parts) if digests else b"\n".join(parts).decode("utf-8", "replace"))
                columns = [ids.cast(pa.int64()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept"])

    slim = met.select("doc_id", "text", name)
    return slim.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def _sha256(parts: list[bytes]) -> str:
    state = hashlib.sha256()
    for i, part in enumerate(parts):
        state.update(b"\n" if i else b"")
        state.update(part)
    return state.hexdigest()


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with their texts reassembled from the lines that stay; all columns and rows stay, null texts too."""
    met, name = _met(docs, gone_keys(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
    columns = [F.col(text_col), F.col(name)]

    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([_text(t, k, min_chars) for t, k in zip(texts, gone, strict=True)], dtype=object)

    changed = F.when(F.col(name).isNull(), F.col(text_col)).otherwise(cut(*columns))
    return met.withColumn(text_col, changed).select(docs.columns)


def _text(text: str | None, gone, min_chars: int) -> str | None:
    if text is None or gone is None:
        return text
    return b"\n".join(without(text.encode(), {bytes(k) for k in gone}, min_chars)[1]).decode()
