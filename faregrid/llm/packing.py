"""Packing token sequences shortest-pack-first over the histogram of lengths.

Each document is tokenized, closed by an end id and cut into pieces of at most ``room`` ids; all
but its last piece are full. The histogram of lengths (``room`` numbers, whatever the corpus)
is packed from the longest length down: each length goes to the pack pattern with the
least in it, and patterns carry counts. A pattern takes an interval of the ranks of each of its
lengths, so pieces find their sequence by length and rank.

Defined results: null text counts as empty and gives one piece with the end id. Special-token
strings inside a text are ordinary text. Rows that repeat an id are packed each on its own. Other
columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm.common import folded, written

ROOM = 1024
END_ID = 0
ROWS = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer file.

    Vocabulary and ranks come from the file; they are applied by the faster of the two libraries
    that read such ranks, to the same ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        source = Tokenizer.from_file(path)
        source.encode_special_tokens = True
        special = {t.content for t in source.get_added_tokens_decoder().values()}
        # Byte-level vocabularies write a byte as its own character if that is visible, else from 256 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in word): i for word, i in source.get_vocab().items() if word not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "Don't pack 12 ß\u00a0words,\n\n  twice <|x|> "
        if self.encoding.encode_ordinary(probe) != source.encode(probe, add_special_tokens=False).ids:
            raise ValueError("the file's tokenizer isn't the byte-level BPE this expects")

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def _tokenized(path: str, room: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        part, places = TaskContext.get().partitionId(), [0] * (room + 1)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                ids, texts = (batch.column(i).slice(at, ROWS).to_pylist() for i in (0, 1))
                rows: list[tuple] = []
                for doc, text in zip(ids, texts, strict=True):
                    tokens = encoder.encode(text or "") + end
                    total = len(tokens) // 4
                    for start in range(0, total, room):
                        length = min(room, total - start)
                        rows.append((doc, start, length, zlib.crc32(tokens[4 * start : 4 * (start + length)]), total, part, places[length]))
                        places[length] += 1
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def pack_histogram(counts: dict[int, int], room: int = ROOM) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) and how many packs follow each."""
    # By room left: packs with the same room, each as [pattern, count].
    left: list[list[list]] = [[] for _ in range(room + 1)]
    most = 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        todo = counts[length]
        while todo:
            while most and not left[most]:
                most -= 1
            if most < length:
                break
            pattern, count = left[most].pop()
            used = min(todo, count)
            if count > used:
                left[most].append([pattern, count - used])
            left[most - length].append([_with(pattern, length, 1), used])
            todo -= used
        if todo:
            fit = room // length
            for times, packs in ((fit, todo // fit), (todo % fit, 1)):
                if times and packs:
                    free = room - times * length
                    left[free].append([((length, times),), packs])
                    most = max(most, free)
    return [(pattern, count) for group in left for pattern, count in group]


def _with(pattern: tuple[tuple[int, int], ...], length: int, times: int) -> tuple[tuple[int, int], ...]:
    if pattern and pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + times))
    return (*pattern, (length, times))


def slots(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, times, offset) per pattern and length."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            low = taken.get(length, 0)
            taken[length] = low + times * count
            rows.append((length, low, taken[length], base, times, offset))
            offset += length * times
        base += count
    return rows


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM, end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = written(slim.mapInArrow(_tokenized(path or tokenizer_path(), room, end_id), PIECES), "pieces")
    sizes = folded(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("size")), "lengths")
    # Ranks of a length: those of earlier tasks, then the place in its task.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("size").alias("n")).collect()}  # at most ``room`` rows
    table = slots(pack_histogram(counts, room)) or [(0, 0, 0, 0, 1, 0)]
    # At most two patterns per length, and distinct lengths that fit one pack: bounded by ``room`` alone.
    places = F.broadcast(spark.createDataFrame(table, "slot_length long, low long, high long, base long, times long, at long"))
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    inside = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    turn = F.col("rank") - F.col("low")
    return ranked.join(places, inside).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("base") + F.floor(turn / F.col("times"))).alias("sequence_id"),
        (F.col("at") + F.pmod(turn, F.col("times")) * F.col("length")).alias("offset"),
    )
