"""Document chunks, exact similarity search and context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.functions.text import action_lines, chunk_spans, clean_chunk, strip
from faregrid.params import DEFAULTS, Params
from faregrid.plans.columns import with_computed
from faregrid.plans.positions import running_offsets
from faregrid.storage import staged

# Query vectors of a block, and the bytes of all blocks that may go to every task.
BLOCK_QUERIES = 256
BROADCAST_BYTES = 32 << 20
# Bytes of vectors that either side of a tile holds.
TILE_BYTES = 32 << 20
# Dot products held at once.
PRODUCT = 1 << 22
BASE_ROWS = 4096
# Rounding of a matrix product; pairs this close are measured again, each the same way.
MARGIN = 1e-9


def chunk_documents(df: DataFrame, key: str = "doc_id", text: str = "text", p: Params = DEFAULTS) -> DataFrame:
    """Overlapping chunks of whole lines: key, chunk number and chunk text.

    Linear in the lines of a document; a document is one row and stays in one task.
    """
    texts = df.where(F.col(text).isNotNull()).select(key, text)
    size, overlap = p.chunk_size, p.chunk_overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "chunk_no", "first_line", "stop_line", "chunk_text"]
        for batch in batches:
            for row in range(batch.num_rows):
                lines = batch.column(1)[row].as_py().split("\n")
                spans = chunk_spans(lines, size, overlap)
                numbers = [pa.array(x, pa.int32()) for x in (range(len(spans)), *zip(*spans))]
                said = pa.array(["\n".join(lines[a:b]) for a, b in spans], pa.string())
                keys = batch.column(0).take(pa.array([row] * len(spans)))
                yield pa.RecordBatch.from_arrays([keys, *numbers, said], names)

    kind = dict(texts.dtypes)[key]
    return texts.mapInArrow(run, f"`{key}` {kind}, chunk_no int, first_line int, stop_line int, chunk_text string")


def clean_chunks(chunks: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Chunks without code fences and outer white space, short ones dropped."""
    return with_computed(chunks, {"chunk_text": clean_chunk(F.col("chunk_text"))}).where(
        F.length("chunk_text") >= p.min_chunk_chars
    )


def numbered_chunks(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``number``: the place of a chunk among all, from 0, by document and chunk number.

    Chunks are counted per document; documents are ordered by ranges of their key, a long.
    """
    sizes = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    offsets = running_offsets(sizes, key, "_size").select(key, F.col("before"))
    inside = F.row_number().over(Window.partitionBy(key).orderBy("chunk_no"))
    return chunks.withColumn("_inside", inside).join(offsets, key).withColumn("number", F.col("before") + F.col("_inside") - 1).drop("before", "_inside")


def repair_vectors(df: DataFrame, dim: int | Column, vector: str = "embedding") -> DataFrame:
    """Zero vector where the embedding is missing, short or not a number."""
    v = F.col(vector)
    valid = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return df.withColumn(vector, F.when(F.coalesce(valid, F.lit(False)), v).otherwise(zero))


def top_similar(
    base: DataFrame,
    queries: DataFrame,
    k: int = 3,
    base_id: str = "vec_id",
    query_id: str = "query_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k base vectors with the largest dot product for each query.

    Queries of up to BROADCAST_BYTES go to the tasks in blocks, and the base stays where it is. More
    queries meet the base in tiles (:func:`tile_grid`), whose sides fit a task whatever the tables' sizes.
    A tile gives k rows per query. Missing and malformed vectors count as zero vectors.
    """
    queries = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    base = base.select(F.col(base_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    queries = staged(queries, "queries")
    dims, n = queries.agg(F.greatest(F.max(F.size("vector")), F.lit(1)), F.count(F.lit(1))).first()
    dims = dims or 1
    queries, base = repair_vectors(queries, F.lit(dims), "vector"), repair_vectors(base, F.lit(dims), "vector")
    if n * dims * 8 <= BROADCAST_BYTES:
        blocks = max(1, -(-n // BLOCK_QUERIES))
        pack = [F.collect_list("id").alias("query_ids"), F.flatten(F.collect_list("vector")).alias("query_vectors")]
        packed = staged(queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(*pack), "query-blocks")
        met = base.mapInArrow(_packed, "ids array<long>, vectors array<double>")
        met = met.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = met.join(F.broadcast(packed), "block")
        found = pairs.select("ids", "vectors", "query_ids", "query_vectors").mapInArrow(_best(k), FOUND)
    else:
        across, down = tiled(queries, base, *tile_grid(n * dims * 8, base.count() * dims * 8))
        found = across.groupBy("row", "column").cogroup(down.groupBy("row", "column")).applyInArrow(_tile(k, dims), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "base_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


FOUND = "query_id long, base_id long, similarity double"


def tile_grid(query_bytes: int, base_bytes: int, tile: int | None = None) -> tuple[int, int]:
    """Rows and columns of tiles. Each query lies in one row and is copied to all columns, each base vector the
    other way round: ``query_bytes * columns + base_bytes * rows`` are shuffled, where a copy of the base
    per block of queries would cost ``base_bytes`` for every block."""
    size = tile or TILE_BYTES
    return max(1, -(-query_bytes // size)), max(1, -(-base_bytes // size))


def tiled(queries: DataFrame, base: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, vector) with the ``row`` and ``column`` of each tile they belong to."""

    def spread(df: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        place = F.pmod(F.xxhash64("id", "vector"), F.lit(own_n)).cast("int").alias(own)
        return df.select("id", "vector", place, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other))

    return spread(queries, "row", rows, "column", columns), spread(base, "column", columns, "row", rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the base, a row each."""
    for batch in batches:
        for at in range(0, batch.num_rows, BASE_ROWS):
            ids, vectors = (batch.column(i).slice(at, BASE_ROWS) for i in (0, 1))
            columns = [pa.array([ids.to_numpy(zero_copy_only=False)]), pa.array([vectors.flatten().to_numpy(zero_copy_only=False)])]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "vectors"])


def _nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of a block of the base for each of a block of queries."""
    scores = asked @ vectors.T
    at = max(len(ids) - k, 0)
    least = np.partition(scores, at, axis=1)[:, at] - MARGIN
    out = []
    for query, own, line, bound in zip(query_ids, asked, scores, least):
        near = np.flatnonzero(line >= bound)
        exact = (vectors[near] * own).sum(axis=1)
        best = np.lexsort((ids[near], -exact))[:k]
        out.append((np.full(len(best), query), ids[near][best], exact[best]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "base_id", "similarity"])


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, flat, query_ids, query_flat = (batch.column(i).slice(row, 1).flatten().to_numpy(zero_copy_only=False) for i in range(4))
                if len(ids) and len(query_ids):
                    yield _nearest(ids, flat.reshape(len(ids), -1), query_ids, query_flat.reshape(len(query_ids), -1), k)

    return run


def _tile(k: int, dims: int):
    """The k best of a tile's part of the base for each of its queries, some queries at a time."""
    none = pa.schema([("query_id", pa.int64()), ("base_id", pa.int64()), ("similarity", pa.float64())]).empty_table()

    def side(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table.column("id").to_numpy(), flat.reshape(-1, dims)

    def run(across: pa.Table, down: pa.Table) -> pa.Table:
        if not len(across) or not len(down):
            return none
        (query_ids, asked), (ids, vectors) = side(across), side(down)
        step = max(1, PRODUCT // len(ids))
        parts = [_nearest(ids, vectors, query_ids[i : i + step], asked[i : i + step], k) for i in range(0, len(asked), step)]
        return pa.Table.from_batches(parts)

    return run


def assemble_context(ranked: DataFrame, text: str = "chunk_text") -> DataFrame:
    """One text per query: its sources in rank order, empty ones too. At most k rows per query."""
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]\n"), F.coalesce(F.col(text), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    joined = F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n")
    return ranked.groupBy("query_id").agg(
        strip(F.concat(F.lit("RELEVANT DOCUMENTATION:\n\n"), joined)).alias("context")
    )


def extract_actions(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per recommendation line of each text."""
    lines = df.withColumn("_lines", action_lines(F.col(text)))
    others = [c for c in df.columns if c != text]
    return lines.select(*others, F.posexplode("_lines").alias("line_no", "line"))
