"""Near-duplicates by MinHash: many universal hash minima, banding, verification, components.

Texts with the same words are one class, stood for by its smallest id. Classes that agree in a
whole band share a bucket. In each bucket one class, picked by hash, is the hub; the others are
compared with it, first by signature, then on the full sets. Buckets that then still hold several
components compare every member outside their largest component with all the others, in
blocks. So each pair in a common bucket is either compared or known to be connected, and
no bucket, however large, is listed as pairs or held by one task.

With 32 bands of 4, a pair at the threshold shares no bucket with probability 5e-6; one whose
signatures agree in less than LEAST_AGREEMENT is at the threshold with probability 4e-6.

Defined results: null, empty and blank texts have no shingles and are linked with nothing. Rows
with a null id have a null component and are kept. Rows that repeat an id are one document.
Other columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import folded, unused, with_ids, written
from faregrid.llm.components import components
from faregrid.llm.words import Words, mixed, scan

SHINGLE = 5
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
LEAST_PERCENT = 75
LEAST_AGREEMENT = 0.58
BLOCK, CHUNK = 100_000, 500_000  # shingles of a block of minor members and of a chunk of all members
SKETCH = "doc_id long, n_shingles long, digest binary, signature binary, bands array<long>"

_draw = np.random.default_rng(20)
_FACTORS = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _draw.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer than k words are one shingle."""
    grams, first = words.grams(k), words.first
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            own = hashlib.blake2b(words.hash[a:b].tobytes(), digest_size=8).digest()
            sets.append(np.frombuffer(own, np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of the universal hashes (a x + b mod 2**64, upper half) over non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    values, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out, room = np.empty((len(sets), HASHES), np.uint32), np.empty_like(values)
    for j in range(HASHES):
        np.multiply(values, _FACTORS[j], out=room)
        np.add(room, _SHIFTS[j], out=room)
        out[:, j] = np.minimum.reduceat(room, starts) >> np.uint64(32)
    return out


def _band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(BAND_ROWS):
        keys = mixed(keys * _MIX + parts[:, :, j])
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, to, words in scan(batch.column(1), lower=True):
            sets = shingle_sets(words)
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            signature = signatures([sets[i] for i in some]) if len(some) else np.empty((0, HASHES), np.uint32)
            keys = _band_keys(signature)
            at = dict(zip(some.tolist(), range(len(some)), strict=True))
            first = words.first
            digests = [hashlib.blake2b(words.hash[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() for i in range(to - row)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, to - row).cast(pa.int64()),
                    pa.array(sizes),
                    pa.array(digests, pa.binary()),
                    pa.array([signature[at[i]].tobytes() if i in at else None for i in range(to - row)], pa.binary()),
                    pa.array([keys[at[i]] if i in at else None for i in range(to - row)], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "signature", "bands"],
            )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (hub, member) whose signatures agree often enough."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, HASHES) for i in (2, 3))
        enough = (left == right).mean(axis=1) >= LEAST_AGREEMENT
        yield batch.filter(pa.array(enough)).select([0, 1])


def _close(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= LEAST_PERCENT * (len(a) + len(b) - common)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (hub, member) that reach the threshold on their full sets."""
    last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        good = np.zeros(len(batch), bool)
        hubs = batch.column(2)
        for row, to, words in scan(batch.column(3), lower=True):
            for i, own in zip(range(row, to), shingle_sets(words), strict=True):
                text = hubs[i].as_py()
                if text != last[0]:
                    last = (text, shingle_sets(next(scan(pa.array([text]), lower=True))[2])[0])
                good[i] = _close(own, last[1])
        yield batch.filter(pa.array(good)).select([0, 1])


def _confirmed(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Written links (u, v) among (hub, member)."""
    pairs = folded(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select(F.col("hub").alias("u"), F.col("member").alias("v"))
    ends = lambda p: folded(p.select(F.explode(F.array("hub", "member")).alias("id")).distinct(), "ends")

    def beside(p: DataFrame, values: DataFrame, column: str) -> DataFrame:
        """A hub's value meets its pairs last, so that only members' values are shuffled per pair."""
        v = with_ids(values.select("doc_id", column), "doc_id", ends(p), keep=True)
        member = p.join(v.toDF("member", "m"), "member")
        return member.join(v.toDF("hub", "h"), "hub").select("hub", "member", "h", "m")

    close = beside(pairs, sketches, "signature").mapInArrow(_agreeing, "hub long, member long")
    close = folded(close.distinct(), "close")
    links = beside(close, texts, "text").mapInArrow(_linked, "hub long, member long")
    return written(links.select(F.col("hub").alias("u"), F.col("member").alias("v")), "links")


def _settled(group: pa.Table) -> pa.Table:
    """Links between one block of minor members and one chunk of all members of a bucket.

    A pair that shares several buckets is compared in that of its first common band. One link of a
    member to another component is enough, so the likeliest candidate of each is tried first.
    """
    minor = group.column("minor").to_numpy(zero_copy_only=False)
    ids, component, sizes = (group.column(c).to_numpy() for c in ("member", "component", "n_shingles"))
    sign = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
    keys = _band_keys(sign)
    band = int(np.flatnonzero(keys[0] == group.column("key")[0].as_py())[0])
    hub, major = group.column("hub")[0].as_py(), group.column("major")[0].as_py()
    texts, sets = group.column("text").combine_chunks(), {}

    def shingles(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_sets(next(scan(texts.slice(i, 1), lower=True))[2])[0]
        return sets[i]

    links: list[tuple[int, int]] = []
    others = np.flatnonzero(~minor & (ids != hub))
    for i in np.flatnonzero(minor & (ids != hub)):
        near = others[(component[others] != component[i]) & ((component[others] == major) | (ids[others] < ids[i]))]
        small, large = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        near = near[100 * small >= LEAST_PERCENT * large]
        near = near[(keys[near] == keys[i]).argmax(axis=1) == band]
        agreement = (sign[near] == sign[i]).mean(axis=1)
        done: set[int] = set()
        for j in near[np.argsort(-agreement, kind="stable")][: int((agreement >= LEAST_AGREEMENT).sum())]:
            if component[j] not in done and _close(shingles(i), shingles(j)):
                done.add(component[j])
                links.append((ids[i], ids[j]))
    u, v = zip(*links, strict=True) if links else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _unsettled(shared: DataFrame, parts: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Written links between different components in a common bucket that no hub has settled."""
    labelled = shared.join(parts, shared["member"] == parts["node"], "left")
    labelled = folded(labelled.select("key", "hub", "member", "n_shingles", F.coalesce("component", "member").alias("component")), "labelled")
    sizes = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    buckets = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"),
        F.sum("n").alias("total"),
        F.sum("shingles").alias("shingles"),
        F.max(F.struct("n", "component", F.col("shingles").alias("own"))).alias("top"),
    )
    blocks = F.ceil((F.col("shingles") - F.col("top.own")) / F.lit(BLOCK))
    chunks = F.ceil(F.col("shingles") / F.lit(CHUNK))
    buckets = buckets.where("parts > 1 and total > 2").select("key", F.col("top.component").alias("major"), blocks.alias("blocks"), chunks.alias("chunks"))
    buckets = folded(buckets, "buckets")
    if buckets.isEmpty():
        return None
    rows = labelled.join(buckets, "key")
    ids = folded(rows.select("member").distinct(), "ends")
    sign = with_ids(sketches.select("doc_id", "signature"), "doc_id", ids, keep=True)
    bodies = sign.join(with_ids(texts, "doc_id", ids, keep=True), "doc_id").withColumnRenamed("doc_id", "member")
    rows = rows.join(bodies, "member")
    spot = lambda n: F.pmod(F.xxhash64("member"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["key", "hub", "major", "member", "component", "n_shingles", "signature", "text"]
    minor = rows.where("component <> major")
    minor = minor.select(*columns, spot("blocks").alias("block"), every("chunks").alias("chunk"), F.lit(True).alias("minor"))
    others = rows.select(*columns, every("blocks").alias("block"), spot("chunks").alias("chunk"), F.lit(False).alias("minor"))
    links = minor.unionByName(others).groupBy("key", "block", "chunk").applyInArrow(_settled, "u long, v long")
    return folded(links.distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = written(texts.mapInArrow(_sketch, SKETCH), "sketches")
    known = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = folded(known.groupBy("digest").agg(F.min("doc_id").alias("class")), "classes")
    mine = (known["digest"] == classes["digest"]) & (known["doc_id"] == classes["class"])
    keys = known.join(classes, mine).select(F.col("class").alias("member"), "n_shingles", F.explode("bands").alias("key"))
    keys = written(keys, "keys")
    hub = F.min(F.struct(F.xxhash64("member", "key").alias("by"), "member"))["member"]
    hubs = keys.groupBy("key").agg(hub.alias("hub"), F.min("member").alias("low"), F.max("member").alias("high"))
    hubs = folded(hubs.where("low < high").select("key", "hub"), "hubs")
    shared = written(keys.join(hubs, "key").select("key", "hub", "member", "n_shingles"), "shared")
    links = _confirmed(shared.where("hub <> member").select("hub", "member").distinct(), sketches, texts)
    parts = folded(components(links), "parts")
    more = _unsettled(shared, parts, sketches, texts)
    if more is not None and not more.isEmpty():
        stars = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
        parts = folded(components(stars.unionByName(more)), "parts")
    groups = classes.join(parts, classes["class"] == parts["node"], "left")
    groups = folded(groups.select("digest", F.coalesce("component", "class").alias("component_id")), "groups")
    slim = sketches.select("doc_id", "n_shingles", "digest")
    # Rows without shingles or id stay out of the join: their common digest would be a hot key.
    joins = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    own = slim.where(~joins).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    all_rows = slim.where(joins).join(groups, "digest").select("doc_id", "n_shingles", "component_id").unionByName(own)
    return all_rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_row: bool = False) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates; all columns stay.

    Rows that repeat the id of a document that stays all stay. With ``by_row`` each row is a
    document of its own, also without an id: the row of smallest id stays, null being last.
    """
    if by_row:
        return _one_row_of_each(docs, id_col, text_col)
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select("doc_id").distinct()
    return with_ids(docs, id_col, folded(gone, "gone"), keep=False)


def _one_row_of_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    number = unused(docs, "row")
    # Written, so that a row that is read again has its number again.
    docs = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = written(near_duplicates(docs, number, text_col).select(F.col("doc_id").alias("row"), "component_id"), "rows")
    groups = folded(rows.where("row <> component_id").select("component_id").distinct(), "groups")
    members = folded(with_ids(rows, "component_id", groups, keep=True), "members")
    ids = docs.select(F.col(number).alias("row"), F.col(id_col).alias("id"))
    ids = with_ids(ids, "row", members.select("row"), keep=True)
    members = folded(members.join(ids, "row"), "named")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("stays"))
    first = folded(first.select(F.col("stays").alias("row")), "first")
    gone = folded(with_ids(members.select("row"), "row", first, keep=False), "gone")
    return with_ids(docs, number, gone, keep=False).drop(number)
