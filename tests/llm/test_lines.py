"""Repeated lines, against a plain restatement."""

import hashlib

import pytest

from faregrid.llm import lines
from tests.llm import brute

SPACE = " \t\n\v\f\r"


def keys_of(text):
    found = (text or "").split("\n")
    return found, ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE)) for x in found]


def without_repeats(rows, least=40, docs=5):
    """(doc_id, n_lines, n_dropped, kept) per row. A document is an id, or without one a text."""
    holders: dict = {}
    who = [(0, 0, t) if i is None else (1, i, "") for i, t in rows]
    for (_, text), mine in zip(rows, who):
        for key in keys_of(text)[1]:
            if len(key) >= least:
                holders.setdefault(key, set()).add(mine)
    out = []
    for (doc, text), mine in zip(rows, who):
        found, keys = keys_of(text)
        kept = []
        for line, key in zip(found, keys):
            held = holders.get(key, ())
            with_id = [h for h in held if h[0]]
            # Among rows without an id any one text may keep the line.
            keeps = mine == max(with_id) if with_id else None
            kept.append((line, len(held) < docs or keeps))
        out.append((doc, len(found), kept))
    return out


COMMON = "The very same line Of Boilerplate, at the end of many pages."
WIDE = "é" * 40
SHORT = "x" * 39
ROWS = [
    (1, None),
    (2, ""),
    (3, "\n"),
    (4, f"{COMMON}\nown text four"),
    (5, f"  {COMMON.upper()}\t\r\nown text five\n{COMMON}"),
    (6, f"first\n{COMMON.lower()}\n\nlast"),
    (7, COMMON),
    (8, f"a\n{COMMON}\n"),
    (9, f"{COMMON}\nthe largest keeps it\n{COMMON}"),
    *[(10 + i, f"{WIDE}\n{SHORT}\n{i}") for i in range(5)],
    *[(20 + i, f"{WIDE[:-1]}\nonly four hold: this line, long enough to count, is here" + "!" * (i == 9)) for i in range(4)],
    *[(30, f"a line that rows of one id repeat, so one document holds it {i}") for i in (1, 1, 1, 1, 1, 1)],
    *[(40 + i // 3, f"four documents hold this line, though seven rows repeat the ids\n{i}") for i in range(12)],
    (50, "y" * 2_000_000 + "\n" + COMMON + "\n" + "\n" * 100_000 + COMMON + "\nend"),
    (None, f"{COMMON}\nno id"),
    (None, f"{COMMON}\nno id"),
    (60, COMMON),
]


def test_rows(spark):
    got = lines.without_repeated_lines(brute.documents(spark, ROWS)).collect()
    want = [(d, n, sum(not keep for _, keep in kept), "\n".join(x for x, keep in kept if keep)) for d, n, kept in without_repeats(ROWS)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    digests = lines.without_repeated_lines(brute.documents(spark, ROWS), digests=True).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in digests if r["doc_id"]) == sorted(
        (d, hashlib.sha256(t.encode()).hexdigest()) for d, _, _, t in want if d
    )


def test_one_text_keeps_a_line_that_only_rows_without_id_hold(spark):
    rows = [(None, f"{COMMON}\n{i}") for i in range(7)] + [(None, f"{COMMON}\n3")]
    got = lines.without_repeated_lines(brute.documents(spark, rows)).collect()
    kept = {r["kept"].split("\n")[-1] for r in got if r["n_dropped"] == 0}
    assert len(kept) == 1 and len(got) == 8
    four = [(None, f"{COMMON}\n{i % 4}") for i in range(12)]
    assert {r["n_dropped"] for r in lines.without_repeated_lines(brute.documents(spark, four)).collect()} == {0}


def test_other_bounds_and_shuffled_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_IDS", 0)
    rows = [r for r in ROWS if r[0]]
    got = lines.without_repeated_lines(brute.documents(spark, rows), min_chars=5, min_docs=2).collect()
    want = [(d, n, sum(not keep for _, keep in kept), "\n".join(x for x, keep in kept if keep)) for d, n, kept in without_repeats(rows, 5, 2)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_documents_keep_their_columns(spark):
    docs = brute.documents(spark, ROWS)
    got = lines.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    want = ["\n".join(x for x, keep in kept if keep) for _, _, kept in without_repeats(ROWS)]
    texts = [r["text"] for r in got.collect()]
    assert sorted(t or "" for t in texts) == sorted(want) and texts.count(None) == 1


def test_empty(spark):
    nothing = brute.documents(spark, ROWS).where("doc_id < 0")
    assert lines.without_repeated_lines(nothing).count() == 0 and lines.drop_repeated_lines(nothing).count() == 0


@pytest.mark.parametrize("raw", [b"", b"\n", b"a\n", b"\na", b"abc\nde\n\nfghi"])
def test_spans(raw):
    got = [(n, raw[a:b]) for n, a, b in lines.long_lines(raw, 0)]
    assert got == list(enumerate(raw.split(b"\n")))
