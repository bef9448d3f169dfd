"""Chunk spans, and text expressions for clean-up and line extraction."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space removed at both ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
CODE_FENCE = "```"
# Words that mark a recommendation and the lines used without any.
ACTION_WORDS = ("solution", "recommend", "action")
DEFAULT_LINES = (
    "Investigate zone characteristics further",
    "Consider pricing adjustments",
    "Monitor for trend changes",
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def chunk_spans(lines: Sequence[str], chunk_size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (first line, last line + 1) of the chunks of a text's lines.

    A line that would exceed ``chunk_size`` closes the open chunk; its last lines, up to the first
    that brings them to ``overlap`` characters, are repeated at the start of the next, which
    takes the new line whatever its size. Each span is found by bisection on running lengths.
    """
    total = [0, *accumulate(map(len, lines))]
    spans, first, least, n = [], 0, 1, len(lines)
    while True:
        stop = bisect_right(total, total[first] + chunk_size, least + 1, n + 1) - 1 if least < n else n
        spans.append((first, stop))
        if stop >= n:
            return spans
        repeated = bisect_right(total, total[stop] - overlap, first, stop) - 1
        first, least = max(first, repeated), stop + 1


def clean_chunk(text: Column) -> Column:
    return strip(F.replace(text, F.lit(CODE_FENCE), F.lit("")))


def action_lines(text: Column, words: Sequence[str] = ACTION_WORDS) -> Column:
    """Lines with one of the words, trimmed, or the default lines."""

    def wanted(line: Column) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(F.lower(line), F.lit(word))
        return test

    found = F.transform(F.filter(F.split(text, "\n"), wanted), strip)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(line) for line in DEFAULT_LINES]))
