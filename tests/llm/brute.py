"""Plain restatements of what the operators return."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns named like the operators' own, in other cases too.
CLASHING = ("kept", "Digest", "_id", "_size", "_TURN", "rank", "size", "copies", "__doc_id", "_digest")


def documents(spark, rows):
    """Documents (id, text[, source]) with extra columns."""
    data = [(i, t, "en", *(s or ["s"]), len(t or "")) for i, t, *s in rows]
    df = spark.createDataFrame(data, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(c) for c in CLASHING})


def words(text):
    return (text or "").encode().split()


def prose(rng, n, vocabulary=900):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def mutated(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def shingles(text):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    if len(ws) >= 5:
        return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    return frozenset([tuple(ws)]) if ws else frozenset()


def near_components(rows):
    """Smallest reachable id per document."""
    sets = defaultdict(set)
    for i, t, *_ in rows:
        sets[i].add(shingles(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, group in sets.items() for s in group if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            common = len(a & b)
            if 100 * common >= 75 * (len(a) + len(b) - common):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def without_repeats(rows, window=20):
    """(words, removed, digest of the rest) per id; repeated rows count once."""
    seen, out = set(), {}
    for i, t in sorted({(i, t or "") for i, t, *_ in rows}):
        ws = words(t)
        gone = [False] * len(ws)
        for j in range(len(ws) - window + 1):
            w = tuple(ws[j : j + window])
            if w in seen:
                gone[j : j + window] = [True] * window
            seen.add(w)
        left = [w for w, g in zip(ws, gone, strict=True) if not g]
        out[i] = (len(ws), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def normalised_digest(text):
    return hashlib.sha256(re.sub(b"[\x20\x09-\x0d]+", b" ", (text or "").encode())).hexdigest()


def seeded(n=5):
    return random.Random(n)
