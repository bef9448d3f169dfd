"""Reply trees as conversations.

Replies point to what they answer. Self-joins that double their reach find, for each message, the
way to its root and the scores along it, in rounds logarithmic in the depth. Per tree the branches
are ranked by the mean score of their messages; each chosen root-to-leaf path becomes one text with a
mask over what the assistant says.

Template: ``<s>``, then per turn an opening string, one space, the text, one space and a closing
string. Inside texts a backslash is doubled and the first character of a control string is written
as a backslash and a letter, so no text can open or close a turn, and reading back is exact.

Defined results: null roles and texts are empty. A parent that is null, missing or the message itself
makes a root. Rows that repeat a message id of a tree count once, the least by parent, role and
text. Messages on or below a cycle have no root and belong to no path. Rows without tree or message
id take no part. Null scores count as 0. Other columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm.common import written

BEGIN = "<s>"
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER, NAMED = ("[ROLE]", "[/ROLE]"), "[SEP]"
CONTROLS = (BEGIN, *(c for pair in TURNS.values() for c in pair), *OTHER, NAMED)
_ESCAPED = re.compile("|".join([re.escape("\\"), *map(re.escape, CONTROLS)]))
_LETTER = {"\\": "\\", "<": "l", "[": "b"}
_PLAIN = {v: k for k, v in _LETTER.items()}
_OPENINGS = {opening: (role, closing) for role, (opening, closing) in TURNS.items()} | {OTHER[0]: (None, OTHER[1])}
_TURN = re.compile("|".join(f"({re.escape(o)}) (.*?) {re.escape(c)}" for o, (_, c) in _OPENINGS.items()), re.DOTALL)


def escaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + _LETTER[m[0][0]] + m[0][1:], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.DOTALL)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the code points [a, b) the loss is taken on."""
    parts, at, spans = [BEGIN], len(BEGIN), []
    for role, text in turns:
        opening, closing = TURNS.get(role, OTHER)
        body = escaped(text)
        head = f"{opening} " if role in TURNS else f"{opening} {escaped(role)} {NAMED} "
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body} {closing}"
        parts.append(piece)
        at += len(piece)
    return "".join(parts), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns = []
    for m in _TURN.finditer(text, len(BEGIN)):
        opening, body = next((m[i], m[i + 1]) for i in range(1, len(m.groups()) + 1, 2) if m[i])
        role = _OPENINGS[opening][0]
        if role is None:
            role, _, body = body.partition(f" {NAMED} ")
            role = unescaped(role)
        turns.append((role, unescaped(body)))
    return turns


def root_paths(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total) of messages with a root, and per k the 2**k-th ancestors.

    ``messages`` is a written table of tree, node, parent, score, without repeats.
    """
    ids = messages.select("tree", F.col("node").alias("parent"))
    hung = messages.where("parent <> node").join(ids, ["tree", "parent"], "left_semi").select("tree", "node", "parent")
    state = written(
        messages.select("tree", "node", "score").join(hung, ["tree", "node"], "left").select(
            "tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")
        ),
        "ancestors",
    )
    levels, still = [], None
    limit = messages.count().bit_length() + 1  # no path is longer than 2**limit
    while len(levels) <= limit:
        still = state.where("up is not null")
        if still.isEmpty():
            break
        levels.append(state.where("up is not null").select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"), F.col("total").alias("_t"))
        moved = still.join(above, ["tree", "up"]).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("total") + F.col("_t")).alias("total")
        )
        state = written(moved.unionByName(state.where("up is null")), "ancestors")
    return state.where("up is null").select("tree", "node", "depth", "total"), levels


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, place, role, text) of the best ``branches`` paths per tree."""
    known = messages.where("tree is not null and node is not null").withColumns(
        {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit("")), "score": F.coalesce("score", F.lit(0.0))}
    )
    once = known.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
    known = written(once.select("tree", "node", "m.*"), "messages")
    rooted, levels = root_paths(known.select("tree", "node", "parent", "score"))
    parents = known.where("parent <> node").select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("node"))
    leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    path = written(leaves.select("tree", F.col("node").alias("leaf"), "rank", "depth", "node", F.col("depth").alias("place")), "paths")
    for k, level in enumerate(levels):
        further = path.join(level, ["tree", "node"]).select(
            "tree", "leaf", "rank", "depth", F.col("up").alias("node"), (F.col("place") - 2**k).alias("place")
        )
        path = written(path.unionByName(further), "paths")
    return path.join(known.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "rank", "place", "role", "text"
    )


def conversations(paths: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, spans): one row per path, as one conversation is one text."""
    turns = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    grouped = paths.groupBy("tree", "leaf", "rank").agg(turns.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text, spans = formatted([(t["role"], t["text"]) for t in batch.column(3)[i].as_py()])
                masks = pa.array([[{"a": a, "b": b} for a, b in spans]], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))
                columns = [batch.column(c).slice(i, 1) for c in range(3)] + [pa.array([text], pa.string()), masks]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "rank", "formatted", "spans"])

    kinds = dict(grouped.dtypes)
    schema = f"tree {kinds['tree']}, leaf {kinds['leaf']}, rank int, formatted string, spans array<struct<a:long,b:long>>"
    return grouped.mapInArrow(run, schema)


def digests(formatted_rows: DataFrame) -> DataFrame:
    """What the formatted texts say when read back, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescaped(text[s["a"] : s["b"]]) for s in spans)
                sums = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
                out.append((len(turns), sums[0], len(loss), sums[1], len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = dict(formatted_rows.dtypes)["tree"]
    schema = f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted_rows.select("tree", "formatted", "spans").mapInArrow(run, schema)


def chained(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of linear conversations: each row answers the one before it.

    Rows of one turn follow each other by role and text; a null turn comes first. A null
    conversation id is kept as the smallest long.
    """
    tree = F.coalesce(F.col(conv_col).cast("long"), F.lit(-(2**63)))
    rows = turns.select(
        tree.alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    line = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = rows.withColumn("node", F.row_number().over(line).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
