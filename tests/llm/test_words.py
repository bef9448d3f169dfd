import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from faregrid.llm.words import pieces, scan

TEXT = st.text(alphabet="aB é\t\n\x0b\x1c .字", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_runs_of_other_bytes(texts):
    found = []
    for row, to, words in scan(pa.array(texts, pa.string())):
        for i in range(to - row):
            span = range(words.first[i], words.first[i + 1])
            found.append([words.data[words.start[j] : words.end[j]].tobytes() for j in span])
    assert found == [(t or "").encode().split() for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_are():
    texts = ["the cat  sat", "on\nthe mat the cat", "THE"]
    words = next(scan(pa.array(texts), lower=True))[2]
    said = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    assert len(set(words.hash.tolist())) == len(set(said))
    pairs = [tuple(said[i : i + 2]) for i in range(len(said) - 1)]
    grams = words.grams(2).tolist()
    assert [pairs.index(p) for p in pairs] == [grams.index(g) for g in grams]


def test_pieces_cover_all_rows_and_hold_one_long_row_alone():
    at = np.cumsum([0, 5, 5, 100, 1, 1])
    assert list(pieces(at, 10)) == [(0, 2), (2, 3), (3, 5)]


def test_slices_of_arrays():
    texts = pa.array(["a", None, "b c", "d"]).slice(2, 2)
    words = next(scan(texts))[2]
    assert words.counts().tolist() == [2, 1]
