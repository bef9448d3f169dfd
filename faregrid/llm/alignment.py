"""Tokens of two tokenizers aligned by byte offsets.

A text is cut into byte ranges; each range is encoded on its own, at places where neither its
tokens nor their boundaries can depend on what lies outside. The ends that tokens of both sides share
cut a range into groups. What a range knows is a fragment: an open prefix (tokens up to the first
shared end), closed groups, and an open suffix (tokens after the last one). Fragments of neighbours
compose: a suffix and the prefix after it give further closed groups. Composition is associative, so
the ranges of a very long text are encoded by different tasks and their open ends are composed in a
tree, a few neighbours at a time; closed groups stay where they were found. Both sides of a range
may be cut at different places, as each side has its own safe ones.

Texts of up to RANGE bytes are one range. There both sides are cut at words, and each distinct word of
a block of documents is aligned once. A block lists its distinct id pairs, sends their counts, and gets the corpus-wide counts of its own pairs back: a product of a sparse matrix by
a vector without a broadcast of pairs or a row per link. What else a block has is one compressed value,
which Spark moves as it is; only Python unpacks it, one block at a time, when the counts of its pairs arrive.

Each position where a token of either side ends closes one link (the two tokens that cover the bytes
before it), so a document has as many links as its sides have tokens, less the shared ends.

Defined results: null and empty texts, and texts that either side doesn't give back byte by byte, have
no tokens and count for nothing. Special-token strings are ordinary text. Rows that repeat an id, or
have none, are documents of their own. Other columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import folded, row_groups, text_batches, written
from faregrid.llm.packing import Encoder, tokenizer_path

RANGE = 1 << 18  # bytes of a range
BLOCK = 2 << 20  # bytes of text whose documents share a list of pairs
BLOCK_DOCS = 4096
GROUP = 8  # blocks of a row group
FAN = 16  # fragments composed at once
TOGETHER = 1 << 15  # characters of distinct words that are encoded at once
_SHIFT = 32
# The code points that the byte-level pattern takes for white space.
WHITE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ANY, _CUT = re.escape(WHITE), " \n"
_REST = re.escape("".join(c for c in WHITE if c not in _CUT))
# White space and what follows, up to the next space or line feed after something else.
_WORDS = re.compile(f"[{_ANY}]*[^{_ANY}]+(?:[{_REST}][{_ANY}]*[^{_ANY}]+)*(?:[{_REST}][{_ANY}]*\\Z)?|[{_ANY}]+\\Z")
_BEFORE_SPACE = re.compile(f"(?<=[^{_ANY}])[ \n]")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Sides:
    """Both tokenizers, the bytes of their entries and the places where a text may be cut."""

    def __init__(self, byte_path: str, model_path: str) -> None:
        import sentencepiece

        self._bytes = Encoder(byte_path).encoding
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = max(self._bytes._mergeable_ranks.values()) + 1
        self.a = [b""] * size
        for token, i in self._bytes._mergeable_ranks.items():
            self.a[i] = token
        names = [self._pieces.id_to_piece(i) for i in range(self._pieces.get_piece_size())]
        single = {f"<0x{b:02X}>": bytes([b]) for b in range(256)}
        self.b = [single[x] if x in single else x.replace("▁", " ").encode() for x in names]
        texts = list(map(str, range(max(len(self.a), len(self.b)))))
        self.said = {mark: np.array([x + mark for x in texts], object) for mark in ",|;"}
        self.a_len = np.array([len(x) for x in self.a], np.int64)
        self.b_len = np.array([len(x) for x in self.b], np.int64)
        # Neighbours inside some piece: elsewhere no merge can cross.
        self.joined = {x[i : i + 2] for n in names if n not in single for x in [n.replace("▁", " ")] for i in range(len(x) - 1)}
        self.space = self._pieces.encode("\n")[0]
        if self.b[self.space] != b" " or any(c != " " and (c + " " in self.joined) for c in {x[0] for x in self.joined}):
            raise ValueError("expected pieces that have spaces at their beginning only")
        if any("\n" in x for x in self.joined):
            raise ValueError("expected line feeds to be bytes of their own")

    def encode_a(self, text: str) -> Sequence[int]:
        return self._bytes.encode_ordinary(text)

    def encode_b(self, text: str) -> list[int]:
        """Pieces of a stretch that begins with a space or where no piece can cross its beginning."""
        if text[:1] == " ":  # the model adds it again
            return self._pieces.encode(text[1:]) if len(text) > 1 else [self.space]
        return self._pieces.encode(text)[1:] if text else []

    def cut_a(self, text: str, at: int) -> int:
        """The first safe place from ``at`` on: white space after something else."""
        found = _BEFORE_SPACE.search(text, at) if at < len(text) else None
        return found.start() if found else len(text)

    def cut_b(self, text: str, at: int) -> int:
        """As above: neighbours that no piece holds."""
        while 0 < at < len(text) and (text[at - 1 : at + 1] in self.joined or (text[at] != " " and " " + text[at] in self.joined)):
            at += 1
        return min(at, len(text))

    def same(self, ids: Sequence[int], entries: list[bytes], raw: bytes) -> bool:
        return b"".join([entries[i] for i in ids]) == raw


@lru_cache(maxsize=2)
def sides(byte_path: str, model_path: str) -> Sides:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Sides(byte_path, model_path)



Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # ids and ends of either side
_ZERO = np.empty(0, np.int64)
NOTHING: Tokens = (_ZERO, _ZERO, _ZERO, _ZERO)


def linked(known: Sides, tokens: Tokens) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens whose sides begin and end together: the text of the groups, a part per token with what
    follows it, the ends of the groups, and the linked id pairs with their ends."""
    a, a_end, b, b_end = tokens
    ends = np.concatenate((a_end, b_end))
    ends.sort(kind="stable")
    again = np.diff(ends, append=-1) == 0
    shared, ends = ends[again], ends[~again]
    pairs = a[np.searchsorted(a_end, ends)] << _SHIFT | b[np.searchsorted(b_end, ends)]
    said = np.empty(len(a) + len(b), object)
    a_to, b_to = (np.concatenate(([0], np.searchsorted(x, shared) + 1)) for x in (a_end, b_end))
    for ids, to, other, mark in ((a, a_to, b_to[:-1], "|"), (b, b_to, a_to[1:], ";")):
        texts = known.said[","][ids]
        texts[to[1:] - 1] = known.said[mark][ids[to[1:] - 1]]
        said[np.arange(len(ids)) + np.repeat(other, np.diff(to))] = texts
    return said.tolist(), shared, pairs, ends


@dataclass
class Closed:
    """Closed groups: runs of (first end, text), their number and the pairs linked in them."""

    runs: list[tuple[int, str]] = field(default_factory=list)
    groups: int = 0
    pairs: list[np.ndarray] = field(default_factory=list)

    def add(self, known: Sides, tokens: Tokens) -> None:
        said, shared, pairs, _ = linked(known, tokens)
        self.runs.append((int(tokens[1][0]), "".join(said)[:-1]))
        self.groups += len(shared)
        self.pairs.append(pairs)


@dataclass
class Fragment:
    """What is open at the ends of a range. Without a shared end inside (``cut``) all is prefix."""

    prefix: Tokens = NOTHING
    suffix: Tokens = NOTHING
    cut: bool = False


def _between(tokens: Tokens, low: int, high: int) -> Tokens:
    """Tokens that end after ``low`` and not after ``high``."""
    a, a_end, b, b_end = tokens
    i, i_to = np.searchsorted(a_end, (low, high), "right")
    j, j_to = np.searchsorted(b_end, (low, high), "right")
    return a[i:i_to], a_end[i:i_to], b[j:j_to], b_end[j:j_to]


def _after(left: Tokens, right: Tokens) -> Tokens:
    return tuple(np.concatenate(x) for x in zip(left, right))  # type: ignore[return-value]


def fragment(known: Sides, tokens: Tokens, closed: Closed, begun: bool) -> Fragment:
    """Fragment of consecutive tokens; groups that close go to ``closed``. ``begun``: both sides begin at one place."""
    shared = np.intersect1d(tokens[1], tokens[3], assume_unique=True)
    if not len(shared):
        return Fragment(suffix=tokens, cut=True) if begun else Fragment(prefix=tokens)
    first, last = -1 if begun else int(shared[0]), int(shared[-1])
    if last > first:
        closed.add(known, _between(tokens, first, last))
    return Fragment(_between(tokens, -1, first), _between(tokens, last, 1 << 62), True)


def composed(known: Sides, left: Fragment, right: Fragment, closed: Closed) -> Fragment:
    """Fragment of two neighbours; groups that close between them go to ``closed``. Associative."""
    if left.cut:
        met = fragment(known, _after(left.suffix, right.prefix), closed, True)
        return Fragment(left.prefix, right.suffix if right.cut else met.suffix, True)
    met = fragment(known, _after(left.prefix, right.prefix), closed, False)
    return Fragment(met.prefix, right.suffix, True) if right.cut else met


def range_tokens(known: Sides, a_text: str, a_at: int, b_text: str, b_at: int) -> Tokens | None:
    """Tokens of a range; None where a side doesn't give its bytes back."""
    a, b = known.encode_a(a_text), known.encode_b(b_text)
    if not known.same(a, known.a, a_text.encode()) or not known.same(b, known.b, b_text.encode()):
        return None
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return a, a_at + np.cumsum(known.a_len[a]), b, b_at + np.cumsum(known.b_len[b])


def ranges(known: Sides, text: str, size: int = RANGE) -> Iterator[tuple[str, int, str, int]]:
    """Per range its text and byte offset on either side; together they are a space and the text."""
    full = " " + text
    a = b = a_at = b_at = 0
    for at in range(size, len(full) + size, size):
        a_to, b_to = known.cut_a(full, max(at, a)), known.cut_b(full, max(at, b))
        a_text, b_text = full[a:a_to], full[b:b_to]
        yield a_text, a_at, b_text, b_at
        a, b, a_at, b_at = a_to, b_to, a_at + len(a_text.encode()), b_at + len(b_text.encode())


@dataclass
class Words:
    """Alignment of distinct words; numbers count per word."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    said: list[str]  # their groups, each with a mark behind
    lengths: np.ndarray  # links per word
    pairs: np.ndarray  # of all words, in order
    bad: np.ndarray


def aligned_words(known: Sides, words: list[str]) -> Words:
    """Words are encoded many at once: what both sides cut off on its own is encoded alike among others."""
    counts = np.zeros((4, len(words)), np.int64)
    said, pairs, bad = [""] * len(words), [_ZERO], np.zeros(len(words), bool)
    todo, size, low = [], 0, 0
    for i, word in enumerate(words):
        size += len(word)
        alone = word[-1] in WHITE  # it would run on into the next word
        if alone and i > low:
            todo.append((low, i))
            low = i
        if alone or size >= TOGETHER or i == len(words) - 1:
            todo.append((low, i + 1))
            size, low = 0, i + 1
    todo.reverse()
    while todo:
        low, high = todo.pop()
        text = "".join(words[low:high])
        tokens = range_tokens(known, text, 0, text, 0)
        if tokens is None:
            if high - low == 1:
                bad[low] = True
            else:
                todo += [((low + high) // 2, high), (low, (low + high) // 2)]
            continue
        ends = np.cumsum([len(w.encode()) for w in words[low:high]])
        parts, shared, links, link_ends = linked(known, tokens)
        for row, places in enumerate((tokens[1], tokens[3], shared, link_ends)):
            counts[row, low:high] = np.bincount(np.searchsorted(ends, places), minlength=high - low)
        pairs.append(links)
        at = 0
        for i, to in enumerate(np.cumsum(counts[0, low:high] + counts[1, low:high]).tolist(), low):
            said[i] = "".join(parts[at:to])
            at = to
    return Words(*counts[:3], said, counts[3], np.concatenate(pairs), bad)


class _Block(dict):
    """Documents that share lists of words and pairs. The dictionary numbers their words."""

    def __init__(self) -> None:
        super().__init__()
        self.size = 0
        self.docs: list[int | None] = []
        self.words: list[np.ndarray] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number

    def add(self, doc: int | None, text: str | None) -> None:
        words = list(map(self.__getitem__, _WORDS.findall(" " + text))) if text else []
        self.docs.append(doc)
        self.words.append(np.array(words, np.int32))
        self.size += len(text or "")

    def batch(self, known: Sides, number: int) -> pa.RecordBatch:
        found = aligned_words(known, list(self))
        none = np.empty(0, np.int32)
        rows = [none if found.bad[x].any() else x for x in self.words]
        said = found.said
        digests = [hashlib.sha256("".join([said[i] for i in x.tolist()])[:-1].encode()).hexdigest() if len(x) else "" for x in rows]
        words = np.concatenate(rows)
        at = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        sums = [_per_run(n[words], at) for n in (found.n_a, found.n_b, found.n_groups)]
        used = np.repeat(np.bincount(words, minlength=len(said)), found.lengths)
        return _block_row(number, self.docs, [None] * len(rows), sums, digests, at, words, found.lengths, found.pairs, used)


def _per_run(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``at``."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


def _block_row(number, docs, keys, sums, digests, at, words, lengths, flat, used) -> pa.RecordBatch:
    """One block: units with their words, words with their pairs, and the pairs with their counts."""
    pairs, place = np.unique(flat, return_inverse=True)
    counts = np.bincount(place, weights=used, minlength=len(pairs)).astype(np.int64)  # exact: far below 2**53
    units = {"doc": (docs, pa.int64()), "key": (keys, pa.int64()), **{n: (x, pa.int64()) for n, x in zip(_SUMS, sums)}, "digest": (digests, pa.string())}
    body = _packed(units | {n: (x, pa.int32()) for n, x in (("words_at", at), ("words", words), ("lengths", lengths), ("place", place))})
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x).cast(pa.int64())) for x in (pairs, counts)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([body], pa.binary()), *lists], _BLOCK)


def _packed(values: dict[str, tuple[Sequence, pa.DataType]]) -> bytes:
    """Lists of any lengths as one row of lists, compressed."""
    columns = []
    for x, kind in values.values():
        flat = pa.array(x, kind) if isinstance(x, list) else pa.array(x).cast(kind)
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
    row, sink = pa.RecordBatch.from_arrays(columns, list(values)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> dict[str, pa.Array]:
    row = pa.ipc.open_stream(body).read_next_batch()
    return {n: row.column(n).flatten() for n in row.schema.names}


_SUMS = ["n_a", "n_b", "n_groups"]
_BLOCK = ["block", "body", "pairs", "counts"]
_BLOCK_TYPE = "block long, body binary, pairs array<long>, counts array<long>"


def _numbers() -> Iterator[int]:
    """Numbers no other task of a stage gives."""
    part = TaskContext.get().partitionId()
    yield from range(part << 33, (part + 1) << 33)


def _documents(paths: tuple[str, str]):
    """Blocks of short documents (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known, block = _numbers(), sides(*paths), _Block()
        for batch in batches:
            for at in range(0, len(batch), 64):
                for doc, text in zip(*(batch.column(i).slice(at, 64).to_pylist() for i in (0, 1)), strict=True):
                    block.add(doc, text)
                    if block.size >= BLOCK or len(block.docs) >= BLOCK_DOCS:
                        yield block.batch(known, next(numbers))
                        block = _Block()
        if block.docs:
            yield block.batch(known, next(numbers))

    return run


def _ranges(paths: tuple[str, str], size: int):
    """Ranges of long documents (doc, text), under a key that no other row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known = _numbers(), sides(*paths)
        for batch in batches:
            for i in range(len(batch)):
                doc, key = batch.column(0)[i].as_py(), next(numbers)
                for no, cut in enumerate(ranges(known, batch.column(1)[i].as_py(), size)):
                    values = zip((key, doc, no, *cut), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in values], _RANGE)

    return run


_RANGE = ["key", "doc", "no", "a_text", "a_at", "b_text", "b_at"]
_OPEN = [f"{part}_{x}" for part in ("prefix", "suffix") for x in ("a", "a_end", "b", "b_end")]
_PIECE = ["key", "no", "ok", "n_a", "n_b", "cut", *_OPEN, "first", "said", "n_groups", "pairs", "counts"]
_PIECE_TYPE = (
    "key long, no long, ok boolean, n_a long, n_b long, cut boolean, "
    + ", ".join(f"{x} array<long>" for x in _OPEN)
    + ", first array<long>, said array<string>, n_groups long, pairs array<long>, counts array<long>"
)


def _piece(key: int, no: int, ok: bool, n_a: int, n_b: int, open_: Fragment, closed: Closed) -> list:
    pairs, counts = np.unique(np.concatenate([_ZERO, *closed.pairs]), return_counts=True)
    first, said = [x for x, _ in closed.runs], [x for _, x in closed.runs]
    return [key, no, ok, n_a, n_b, open_.cut, *open_.prefix, *open_.suffix, first, said, closed.groups, pairs, counts]


def _fragments(paths: tuple[str, str]):
    """A piece per range: its open ends, and what closes inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sides(*paths)
        schema = None
        for batch in batches:
            schema = schema or _arrow_schema()
            for i in range(len(batch)):
                row = [batch.column(name)[i].as_py() for name in _RANGE]
                tokens, closed = range_tokens(known, *row[3:]), Closed()
                got = fragment(known, tokens or NOTHING, closed, row[2] == 0)
                n_a, n_b = (len(tokens[0]), len(tokens[2])) if tokens else (0, 0)
                piece = _piece(row[0], row[2], tokens is not None, n_a, n_b, got, closed)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(piece, schema)], schema=schema)

    return run


def _arrow_schema() -> pa.Schema:
    scalars = {"ok": pa.bool_(), "cut": pa.bool_(), "said": pa.list_(pa.string())}
    plain = ("key", "no", "n_a", "n_b", "n_groups")
    return pa.schema([(x, scalars.get(x, pa.int64() if x in plain else pa.list_(pa.int64()))) for x in _PIECE])


def _composing(paths: tuple[str, str]):
    """One piece from up to FAN neighbours: their outer open ends, and what closes between them."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["no"])
        known, closed, state = sides(*paths), Closed(), Fragment()
        for at, row in enumerate(rows):
            ends = [np.array(row[x], np.int64) for x in _OPEN]
            right = Fragment(tuple(ends[:4]), tuple(ends[4:]), row["cut"])
            state = composed(known, state, right, closed) if at else right
        piece = _piece(rows[0]["key"], rows[0]["group"], True, 0, 0, state, closed)
        schema = _arrow_schema()
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(piece, schema)], schema=schema)

    return run


def long_documents(docs: DataFrame, paths: tuple[str, str], size: int = RANGE) -> tuple[DataFrame, DataFrame] | None:
    """(pieces, digests) of documents (doc, text) that are cut into ranges; None if there are none.

    ``pieces`` has every closed group once; ``digests`` one row (key, doc, digest) per document.
    """
    kind = "key long, doc long, no long, a_text string, a_at long, b_text string, b_at long"
    cut = written(docs.mapInArrow(_ranges(paths, size), kind), "align-ranges")
    most = cut.agg(F.max("no")).scalar()
    n_ranges = 1 + (cut.sparkSession.range(1).select(most.alias("m")).first()["m"] or 0)
    if cut.isEmpty():
        return None
    level = written(cut.repartition("key", "no").mapInArrow(_fragments(paths), _PIECE_TYPE), "align-fragments")
    bad = folded(level.where("not ok").select("key").distinct(), "align-bad")
    pieces = [level := level.join(bad, "key", "left_anti")]
    while n_ranges > 1:
        grouped = level.select("key", "no", "cut", *_OPEN, F.floor(F.col("no") / FAN).alias("group"))
        level = written(grouped.groupBy("key", "group").applyInArrow(_composing(paths), _PIECE_TYPE), "align-composed")
        pieces.append(level)
        n_ranges = -(-n_ranges // FAN)
    every = pieces[0]
    for more in pieces[1:]:
        every = every.unionByName(more)
    runs = every.select("key", F.inline(F.arrays_zip("first", "said")))
    # A digest needs its text in order: a document streams through a task, a run at a time.
    digests = runs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key long, digest string")
    heads = cut.where("no = 0").select("key", "doc")
    return every, heads.join(digests, "key", "left")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    done: list[tuple[int, str]] = []
    for batch in batches:
        for one, said in zip(batch.column("key").to_pylist(), batch.column("said")):
            if one != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = one, hashlib.sha256()
            else:
                state.update(b";")
            state.update(said.as_buffer())
    if state:
        done.append((key, state.hexdigest()))
    keys, texts = zip(*done) if done else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], ["key", "digest"])


def _piece_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of long documents as blocks of one unit; numbers below those of documents."""
    numbers = _numbers()
    for batch in batches:
        for key, n_a, n_b, groups, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
            flat, used = np.array(pairs, np.int64), np.array(counts, np.int64)
            sums = [np.array([x]) for x in (n_a, n_b, groups)]
            # The unit's one word has each pair as often as it occurs.
            row = _block_row(-1 - next(numbers), [None], [key], sums, [""], np.array([0, 1]), np.array([0]), np.array([used.sum()]), np.repeat(flat, used), np.ones(used.sum()))
            yield row


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the units of blocks, which come one after the other: the body of each among its answers (block, body, i, value)."""
    block, body, found = None, None, []
    for batch in batches:
        numbers, at, value = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "i", "value"))
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)]):
            if low < high and numbers[low] != block:
                if body is not None:
                    yield _units(body, found)
                block, body, found = numbers[low], None, []
            for row in np.flatnonzero(at[low:high] < 0).tolist():
                body = batch.column("body")[low + row].as_py()
            answers = np.flatnonzero(at[low:high] >= 0) + low
            found.append((at[answers], value[answers]))
    if body is not None:
        yield _units(body, found)


def _units(body: bytes, answers: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of a block's units from the corpus-wide counts of its pairs (place, twice the count plus whether it is the best)."""
    got = _unpacked(body)
    number = {n: got[n].to_numpy(zero_copy_only=False) for n in ("words_at", "words", "lengths", "place")}
    value = np.zeros(int(number["place"].max(initial=-1)) + 1, np.int64)
    for at, values in answers:
        value[at] = values
    starts = np.concatenate(([0], np.cumsum(number["lengths"])))
    per_word = [_per_run(x[number["place"]], starts) for x in (value & 1, value >> 1)]
    best, total = (_per_run(x[number["words"]], number["words_at"]) for x in per_word)
    names = ["doc_id", "key", *_SUMS, "n_best", "count_sum", "groups_sha256"]
    return pa.RecordBatch.from_arrays([got["doc"], got["key"], *(got[n] for n in _SUMS), pa.array(best), pa.array(total), got["digest"]], names)


def _with_counts(blocks: DataFrame) -> DataFrame:
    """Units of written blocks with the corpus-wide counts of their links.

    A block sends each of its distinct pairs once and gets it back once, however often it occurs there.
    """
    sent = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("i", "x")).select(
        "block", "i", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")
    )
    counted = written(sent.groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    mine = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    # A row per id of the second side at most: bounded by its vocabulary.
    best = F.broadcast(folded(counted.groupBy(mine.alias("b")).agg(F.max("n").alias("most")), "align-best"))
    value = F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")
    known = counted.join(best, mine == F.col("b")).select("pair", value.alias("value"))
    back = sent.select("block", "i", "pair").join(known, "pair").select("block", F.lit(None).cast("binary").alias("body"), "i", "value")
    bodies = blocks.select("block", "body", F.lit(-1).alias("i"), F.lit(0).cast("long").alias("value"))
    # A block streams through a task, so no list of its answers is held in a row, and none of its body's beside it.
    met = bodies.unionByName(back).repartition("block").sortWithinPartitions("block")
    kind = "doc_id long, key long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string"
    with text_batches(blocks.sparkSession):
        return written(met.mapInArrow(_answered, kind), "align-rows")


def aligned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str | None = None, model_path: str | None = None, size: int = RANGE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = (byte_path or tokenizer_path(), model_path or piece_path())
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    wide = F.coalesce(F.octet_length("text") > size, F.lit(False))
    with text_batches(docs.sparkSession), row_groups(docs.sparkSession, GROUP):
        blocks = written(slim.where(~wide).mapInArrow(_documents(paths), _BLOCK_TYPE), "align-blocks")
    found = long_documents(slim.where(wide), paths, size)
    if found:
        pieces, digests = found
        units = pieces.select("key", "n_a", "n_b", "n_groups", "pairs", "counts").mapInArrow(_piece_blocks, _BLOCK_TYPE)
        with row_groups(docs.sparkSession, GROUP):
            blocks = blocks.unionByName(written(units, "align-units"))
    rows = _with_counts(blocks)
    numbers = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]
    if found:
        sums = rows.where("key is not null").groupBy("key").agg(*(F.sum(c).alias(c) for c in numbers))
        long_rows = digests.join(sums, "key", "left").select(
            F.col("doc").alias("doc_id"),
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
            F.coalesce("digest", F.lit("")).alias("groups_sha256"),
        )
        rows = rows.where("key is null").select("doc_id", *numbers, "groups_sha256").unionByName(long_rows)
    links = F.col("n_a") + F.col("n_b") - F.col("n_groups")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", links.alias("n_links"), "n_best", "count_sum", "groups_sha256")
