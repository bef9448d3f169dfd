"""Two tokenizers aligned: against whole texts encoded by the libraries themselves."""

import bisect
import hashlib
import random
import urllib.parse
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from faregrid.llm import alignment as al
from tests.llm import brute

PATHS = (al.tokenizer_path(), al.piece_path())


def brute_tokens(texts):
    """Per text the (id, first byte, last byte + 1) of both sides, or nothing; by the libraries as they are."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATHS[0])
    tok.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    out = []
    for text in texts:
        if not text:
            out.append(([], []))
            continue
        raw = (" " + text).encode()
        a = [(i, bytes(to_byte[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in pieces.encode(text):
            p = pieces.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
        sides = []
        for side in (a, b):
            ends = np.cumsum([len(x) for _, x in side]).tolist()
            sides.append([(i, e - len(x), e) for (i, x), e in zip(side, ends)])
        same = all(b"".join(x for _, x in side) == raw for side in (a, b))
        out.append(tuple(sides) if same else ([], []))
    return out


def brute_rows(rows):
    tokens = brute_tokens([t for _, t in rows])
    links = []
    for a, b in tokens:
        mine, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            at = first
            while at < len(b) and b[at][1] < e:
                mine.append((i, b[at][0]))
                at += 1
        links.append(mine)
    counts = Counter(p for mine in links for p in mine)
    best = Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    out = []
    for (doc, _), (a, b), mine in zip(rows, tokens, links):
        shared = sorted({e for *_, e in a} & {e for *_, e in b})
        members = [[[] for _ in shared] for _ in (a, b)]
        for side, groups in zip((a, b), members):
            for i, _, e in side:
                groups[bisect.bisect_left(shared, e)].append(str(i))
        said = ["|".join(map(",".join, x)) for x in zip(*members)]
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if a else ""
        top = sum(counts[p] == best[p[1]] for p in mine)
        out.append((doc, len(a), len(b), len(shared), len(mine), top, sum(counts[p] for p in mine), digest))
    return out


RNG = random.Random(7)
ODD = ["", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb \n c\t\td", "　x  y z", "<|endoftext|> </s> <s> [INST] <0x41>",
       "it's 3.5% ▁ held", "▁", "nul \x00 \x1c\x1d x\x85 y", "ﬁne éé \U0001f600\U0001f600 中文没有空格", "x" * 300, "\t a\tb\t", "don't 'll  'S",
       "  lead", "trail \t\n ", "абв где", "a​b ​ c"]
LONG = " ".join(brute.prose(RNG, 9) + RNG.choice([".", "\n", " \t", "中文" * 40, "", "=="]) for _ in range(60))


def documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, LONG), (101, LONG + "▁ x"), (101, LONG[:900]), (None, "no id"), (None, "no id"), (102, "z" * 5000)]
    return rows, brute.documents(spark, rows)


@pytest.mark.parametrize("size", [al.RANGE, 97, 7])
def test_rows(spark, size):
    rows, docs = documents(spark)
    got = [tuple(r) for r in al.aligned(docs, size=size).collect()]
    assert sorted(got, key=str) == sorted(brute_rows(rows), key=str)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(tuple(r) for r in entry.queries()["op13_aligned_tokens"](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(brute_rows(rows))


def test_empty(spark):
    assert al.aligned(brute.documents(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


def test_without_any_tokens(spark):
    got = al.aligned(brute.documents(spark, [(1, None), (2, ""), (None, "▁")])).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, None)), key=str)


TEXTS = st.text(st.sampled_from("ab 1.'s\n\t　 中é\U0001f600\x1c-Th"), max_size=60)


@given(TEXTS, st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_ranges_encode_like_the_whole(text, size):
    known = al.sides(*PATHS)
    cuts = list(al.ranges(known, text, size))
    for side, encode, whole in ((0, known.encode_a, known.encode_a(" " + text)), (2, known.encode_b, known.encode_b(" " + text))):
        assert "".join(c[side] for c in cuts) == " " + text
        assert [i for c in cuts for i in encode(c[side])] == list(whole)
    words = al._WORDS.findall(" " + text)
    assert "".join(words) == " " + text
    assert [i for w in words for i in known.encode_a(w)] == list(known.encode_a(" " + text))
    assert [i for w in words for i in known.encode_b(w)] == list(known.encode_b(" " + text))


def said_of(closed):
    return [x for _, run in sorted(closed.runs) for x in run.split(";")]


@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=40), st.integers(0, 10**6))
@settings(max_examples=200, deadline=None)
def test_composition_is_associative(a_sizes, b_sizes, seed):
    rng = random.Random(seed)
    total = max(sum(a_sizes), sum(b_sizes))
    sides = []
    for sizes in (a_sizes, b_sizes):
        if sum(sizes) < total:
            sizes = [*sizes, total - sum(sizes)]
        sides += [np.arange(len(sizes)), np.cumsum(sizes)]
    known, whole = al.sides(*PATHS), al.Closed()
    al.fragment(known, tuple(sides), whole, True)
    cuts = [sorted(rng.randrange(len(sides[i]) + 1) for _ in range(5)) for i in (0, 2)]
    parts = []
    closed = al.Closed()
    for k in range(6):
        tokens = []
        for side, cut in zip((0, 2), cuts):
            low, high = [0, *cut][k], [*cut, len(sides[side])][k]
            tokens += [sides[side][low:high], sides[side + 1][low:high]]
        parts.append(al.fragment(known, tuple(tokens), closed, k == 0))
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [al.composed(known, parts[i], parts[i + 1], closed)]
    assert said_of(closed) == said_of(whole) and closed.groups == whole.groups
    assert sorted(np.concatenate([[], *closed.pairs])) == sorted(np.concatenate([[], *whole.pairs]))
    assert not any(len(x) for x in (*parts[0].prefix, *parts[0].suffix))


def test_few_texts_go_to_python_at_once(spark, monkeypatch):
    sizes = {}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept, before = al.written, spark.conf.get(key)
    monkeypatch.setattr(al, "written", lambda df, label: sizes.update({label: int(spark.conf.get(key))}) or kept(df, label))
    assert al.aligned(brute.documents(spark, [(1, "a text"), (2, None)])).count() == 2
    assert sizes["align-blocks"] <= 1000 and spark.conf.get(key) == before


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_a_body_may_come_anywhere_among_its_answers(size):
    known, rng = al.sides(*PATHS), random.Random(3)
    groups = [[(1, "a b a"), (2, LONG[:300]), (None, None)], [(4, "x y")], [(5, None)], [(6, "a b"), (6, "b  a")]]
    blocks = []
    for number, rows in enumerate(groups):
        block = al._Block()
        for doc, text in rows:
            block.add(doc, text)
        blocks.append(block.batch(known, number).to_pylist()[0])
    counts, best = Counter(), Counter()
    for x in blocks:
        counts.update(dict(zip(x["pairs"], x["counts"])))
    for pair, n in counts.items():
        best[pair & 0xFFFFFFFF] = max(best[pair & 0xFFFFFFFF], n)
    rows = []
    for x in blocks:
        mine = [(x["block"], None, i, 2 * counts[p] + (counts[p] == best[p & 0xFFFFFFFF])) for i, p in enumerate(x["pairs"])]
        mine.append((x["block"], x["body"], -1, 0))
        rng.shuffle(mine)
        rows += mine
    kinds = {"block": pa.int64(), "body": pa.binary(), "i": pa.int32(), "value": pa.int64()}
    table = pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(kinds.items())})
    got = [r for batch in al._answered(iter(table.to_batches(max_chunksize=size))) for r in batch.to_pylist()]
    said = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_a"] + r["n_b"] - r["n_groups"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got]
    assert said == brute_rows([r for rows in groups for r in rows])


def test_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    kept, found = al.written, {}
    monkeypatch.setattr(al, "written", lambda df, label: found.setdefault(label, kept(df, label)))
    rows = (al.GROUP + 2) * al.BLOCK_DOCS
    docs = spark.range(0, rows, 1, 1).selectExpr("id AS doc_id", "concat('a b ', id % 7) AS text")
    assert al.aligned(docs).select("n_links").where("n_links > 0").count() == rows
    files = [pq.ParquetFile(urllib.parse.urlparse(f).path).metadata for f in found["align-blocks"].inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == al.GROUP + 2 and max(groups) <= al.GROUP
    assert dict(found["align-blocks"].dtypes) == {"block": "bigint", "body": "binary", "pairs": "array<bigint>", "counts": "array<bigint>"}
    assert spark.conf.get("parquet.block.row.count.limit", None) is None
