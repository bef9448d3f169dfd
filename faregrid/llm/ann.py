"""Approximate nearest neighbours by an adaptive scan of dimensions.

Vectors are dealt to lists around centres and rotated at random, so that any leading dimensions
estimate the whole distance. A list is stored in blocks of rows, each as column blocks of
dimensions. A query scans the lists of its nearest centres column block by column block; a
candidate whose partial distance shows, by a hypothesis test, that the whole one is very
probably beyond the k-th best so far is abandoned. A first scan of the nearest list sets that
bound for the others. What remains is measured exactly on the original vectors. Queries that then
have fewer than k rows measure whole lists, twice as many each time, until they have k.

There are as many lists as the root of the rows, up to MOST_LISTS. Centres and the number of lists to
probe come from a sample of at most SAMPLE vectors, or PER_LIST a list where that is more (so at most
PER_LIST * MOST_LISTS); beyond FLAT_LISTS lists, centres are trained in two levels. Every vector is indexed. The number of probes is the smallest whose recall on the sample reaches
SAMPLE_RECALL; a sample is sparser than the table, so the table's recall is no lower.

Vectors of floats are kept as floats, others as doubles; lists, rotation and tests use single
precision in either case, the measure that ranks uses doubles.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do those with components beyond single precision's range,
nor rows without id. Rows that repeat an id count once, by
the smallest vector. Equal scores are ranked by id. Other columns take no part. Empty tables give
empty results; with fewer candidates than k all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm.common import folded, written

SAMPLE = 8192
PER_LIST = 16
MOST_LISTS = 8192
FLAT_LISTS = 1024
DISTANCES = 1 << 22  # between vectors and centres, held at once
SAMPLE_RECALL = 0.97
BLOCK_ROWS = 2048
QUERY_ROWS = 128
COLUMNS = 16
EPSILON = 2.1
SLACK, NOISE = 1.0001, 1e-9  # for single precision in the rotated space, of the bound and of the vector's square


def usable(vector: Column) -> Column:
    """Not null, all components finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def wanted_lists(rows: int) -> int:
    return max(1, min(MOST_LISTS, int(rows**0.5)))


def sample_size(rows: int) -> int:
    return max(SAMPLE, PER_LIST * wanted_lists(rows))


class Index:
    """Centres, rotation and the number of probes."""

    def __init__(self, sample: np.ndarray, rows: int, k: int) -> None:
        rng = np.random.default_rng(11)
        dims = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0].astype(np.float32)
        # Equal vectors count once, or equal centres would split them at random.
        pool = np.unique(sample, axis=0)
        lists = max(1, min(wanted_lists(rows), len(pool) // PER_LIST))
        centres = self._trained(pool, lists, rng) if lists <= FLAT_LISTS else self._two_levels(pool, lists, rng)
        self.centres = centres
        self.probes = self._calibrated(sample, k)

    @classmethod
    def _trained(cls, pool: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
        centres = pool[rng.permutation(len(pool))[:lists]]
        for _ in range(10):
            own = cls._nearest(pool, centres, 1)[:, 0]
            sums, count = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
            np.add.at(sums, own, pool)
            centres = sums[count > 0] / count[count > 0, None]
        return centres

    @classmethod
    def _two_levels(cls, pool: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
        """The root of the lists as coarse centres; each one's vectors get their share of the lists."""
        own = cls._nearest(pool, cls._trained(pool, int(lists**0.5), rng), 1)[:, 0]
        cells = [pool[own == c] for c in np.unique(own)]
        return np.concatenate([cls._trained(cell, max(1, round(lists * len(cell) / len(pool))), rng) for cell in cells])

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
        square, out = (centres**2).sum(axis=1), np.empty((len(x), min(n, len(centres))), np.int64)
        rows = max(1, DISTANCES // len(centres))
        for at in range(0, len(x), rows):
            far = square - 2 * x[at : at + rows] @ centres.T
            out[at : at + rows] = np.argsort(far, axis=1, kind="stable")[:, :n] if n > 1 else far.argmin(axis=1)[:, None]
        return out

    def lists(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return self._nearest(x, self.centres, n)

    def _calibrated(self, sample: np.ndarray, k: int) -> int:
        """Fewest probes that find SAMPLE_RECALL of the sample's own neighbours."""
        asked = np.arange(0, len(sample), max(1, len(sample) // 256))
        own, order = self.lists(sample)[:, 0], self.lists(sample[asked], len(self.centres))
        place = np.argsort(order, axis=1)
        needed = []
        for i, q in enumerate(asked):
            far = ((sample - sample[q]) ** 2).sum(axis=1)
            far[q] = np.inf
            near = np.argsort(far, kind="stable")[: min(k, len(sample) - 1)]
            needed.append(place[i, own[near]] + 1)
        found = np.concatenate(needed) if needed else np.ones(1, np.int64)
        return int(np.quantile(found, SAMPLE_RECALL, method="higher")) if len(found) else 1


def _matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 1), kind)


def _scan(q: np.ndarray, columns: list[np.ndarray], k: int, bound: float) -> np.ndarray:
    """Rows of a block that may be among the k nearest of ``q``; ``bound`` is a squared distance."""
    dims, noise = len(q), NOISE * float(q @ q)
    rows = len(columns[0])
    head = slice(0, min(rows, 4 * k))  # measured whole, for a first bound of the block
    first = sum(((c[head] - q[i * COLUMNS : i * COLUMNS + c.shape[1]]) ** 2).sum(axis=1) for i, c in enumerate(columns))
    if len(first) >= k:
        bound = min(bound, float(np.partition(first, k - 1)[k - 1]))
    alive, partial, seen = np.arange(rows), np.zeros(rows, np.float32), 0
    for i, c in enumerate(columns):
        part = c if len(alive) == rows else c[alive]
        partial = partial + ((part - q[seen : seen + c.shape[1]]) ** 2).sum(axis=1)
        seen += c.shape[1]
        limit = bound * SLACK if seen == dims else bound * seen / dims * (1 + EPSILON / seen**0.5) ** 2
        stays = partial <= limit + noise
        alive, partial = alive[stays], partial[stays]
    return alive


def nearest(vectors: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest others of each row whose id fulfils ``asked``.

    ``asked`` is a condition on the column ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    given = rows.dtypes[1][1]
    element, exact = ("float", np.float32) if given == "array<float>" else ("double", np.float64)
    rows = rows.withColumn("vector", F.col("vector").cast(f"array<{element}>"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")) & F.forall("vector", lambda x: F.abs(x) < float(np.finfo(np.float32).max)))
    rows = folded(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == usual["dims"])
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 0.9 * sample_size(usual["n"]) / usual["n"])))
    sample = rows.where(share).orderBy("vec_id").select("vector").toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(1).select("vector").toArrow().column(0).combine_chunks()
    shared = spark.sparkContext.broadcast(Index(_matrix(sample), usual["n"], k))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value.lists(_matrix(batch.column(1)))[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], ["list", "vec_id", "vector"])

    def probing(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = shared.value.lists(_matrix(batch.column(1)), most)
                n = lists.shape[1]
                take = pa.array(np.repeat(np.arange(len(batch)), n))
                columns = [pa.array(lists.ravel(), pa.int32()), pa.array(np.tile(np.arange(n), len(batch)), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns + [c.take(take) for c in batch.columns], ["list", "probe", "vec_id", "vector"])

        return run

    def block(group: pa.Table) -> pa.Table:
        """A block of a list: ids, original vectors, and rotated ones by column blocks."""
        x = _matrix(group.column("vector").combine_chunks(), exact)
        turned = x.astype(np.float32, copy=False) @ shared.value.rotation
        cut = b"".join(np.ascontiguousarray(turned[:, i : i + COLUMNS]).tobytes() for i in range(0, turned.shape[1], COLUMNS))
        ids = group.column("vec_id").to_numpy().tobytes()
        return pa.table({"list": group.column("list")[:1], "ids": [ids], "originals": [x.tobytes()], "rotated": [cut]})

    in_lists = written(rows.mapInArrow(listed, f"list int, vec_id long, vector array<{element}>"), "lists")
    sizes = in_lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).alias("blocks"))
    # At most MOST_LISTS rows.
    dealt = in_lists.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    blocks = dealt.select("list", "block", "vec_id", "vector").groupBy("list", "block")
    blocks = written(blocks.applyInArrow(block, "list int, ids binary, originals binary, rotated binary"), "blocks")
    probe_kinds = f"list int, probe int, vec_id long, vector array<{element}>"
    probes = written(rows.where(asked).mapInArrow(probing(shared.value.probes), probe_kinds), "probes")

    def found(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
        index, dims = shared.value, usual["dims"]
        for batch in batches:
            queries, bounds, originals, rotated, ids = (batch.column(c).to_pylist() for c in ("queries", "bounds", "originals", "rotated", "ids"))
            vectors = batch.column("vectors").to_pylist()
            for at in range(len(batch)):
                own = np.frombuffer(ids[at], np.int64)
                x = np.frombuffer(originals[at], exact).reshape(-1, dims)
                flat, columns, start = np.frombuffer(rotated[at], np.float32), [], 0
                for i in range(0, dims, COLUMNS):
                    wide = min(COLUMNS, dims - i)
                    columns.append(flat[start : start + len(own) * wide].reshape(-1, wide))
                    start += len(own) * wide
                asked_vectors = np.array(vectors[at], exact).reshape(-1, dims)
                turned = asked_vectors.astype(np.float32, copy=False) @ index.rotation
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for query, bound, q, t in zip(queries[at], bounds[at], asked_vectors, turned, strict=True):
                    # The query itself may be in the block: one more than k.
                    near = np.arange(len(own)) if whole else _scan(t, columns, k + 1, np.inf if bound is None else bound * bound * SLACK)
                    near = near[own[near] != query]
                    apart = x[near].astype(np.float64) - q.astype(np.float64)
                    score = np.sqrt((apart * apart).sum(axis=1))
                    best = np.lexsort((own[near], score))[:k]
                    out.append((np.full(len(best), query), own[near][best], score[best]))
                columns_out = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns_out)), ["query_id", "vec_id", "score"])

    def searched(asked_rows: DataFrame, whole: bool = False) -> DataFrame:
        """Queries of a list in groups, each group against each block of the list."""
        sizes = asked_rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).alias("groups"))
        dealt = asked_rows.join(F.broadcast(sizes), "list").withColumn("group", F.pmod(F.xxhash64("vec_id"), F.col("groups")))
        grouped = dealt.groupBy("list", "group").agg(F.collect_list(F.struct("vec_id", "bound", "vector")).alias("q"))
        grouped = grouped.select("list", F.col("q.vec_id").alias("queries"), F.col("q.bound").alias("bounds"), F.flatten("q.vector").alias("vectors"))
        pairs = blocks.join(grouped, "list").select("queries", "bounds", "vectors", "ids", "originals", "rotated")
        return pairs.mapInArrow(lambda batches: found(batches, whole), "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = folded(ranked(searched(probes.where("probe = 0").withColumn("bound", F.lit(None).cast("double")))), "first")
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    others = probes.where("probe > 0").join(bounds, "vec_id", "left")
    both = first.drop("rank").unionByName(searched(others))
    best_rows = folded(ranked(both), "best")
    # Queries with fewer than k rows measure all of twice as many lists, until they have k or no list is left.
    most, lists = shared.value.probes, len(shared.value.centres)
    enough = min(k, usual["n"] - 1)
    full = lambda df: df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select("query_id")
    queries = rows.where(asked)
    short = queries.join(full(best_rows), F.col("vec_id") == F.col("query_id"), "left_anti") if enough else queries.limit(0)
    short = folded(short, "short")
    while not short.isEmpty():
        most = min(2 * most, lists)
        wider = short.mapInArrow(probing(most), probe_kinds).withColumn("bound", F.lit(None).cast("double"))
        more = folded(ranked(searched(written(wider, "wider"), whole=True)), "more")
        ids = short.select(F.col("vec_id").alias("query_id"))
        best_rows = folded(best_rows.join(ids, "query_id", "left_anti").unionByName(more), "best")
        if most == lists:
            break
        short = folded(short.join(full(more), F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    return best_rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
