"""Language of web pages by fusing evidence.

Bayes' rule joins what the visible text says under each language, the language that the markup
declares, the suffix of the address and a prior for the host. Text likelihoods come from documents
whose language is known, at most SAMPLE of them. How far declarations and suffixes can be trusted, and
the priors, are grouped counts over all pages of the language their text alone suggests: the prior of
a host leans on its domain's, that on the one of all pages, the more the fewer pages there are; a
page's own vote is left out of its host's and domain's counts.

Defined results: null or empty pages and addresses give no evidence, so the rest decides. Rows that
repeat an id are judged each on its own. Equal posteriors go to the language first by name. Without
labelled documents the language is null. Other columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import written
from faregrid.llm.words import Words, buffers, pieces, words_of

SAMPLE = 8000
BITS = 15
GROUPS = (2, 4)  # bytes of a letter group, besides whole words
EVIDENCE = 40.0  # features a text counts for at most: neighbouring features aren't independent
SMOOTH = 0.5
LEAN = 5.0  # pages that a parent's prior counts for
_UNSHOWN = re.compile(r"<(script|style)\b", re.IGNORECASE)
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in ("script", "style")}
_VALUE = r"\s*+=\s*+(?:[\"']\s*+)?([a-zA-Z]{2,3})(?![a-zA-Z])"
_HTML, _LANG = re.compile(r"<html\b", re.IGNORECASE), re.compile(rf"\slang{_VALUE}", re.IGNORECASE)
_META, _NAME = re.compile(r"<meta\b", re.IGNORECASE), re.compile("content-language", re.IGNORECASE)
_CONTENT = re.compile(rf"content{_VALUE}", re.IGNORECASE)


def _end(at: int, page: str) -> int:
    return at if at >= 0 else len(page)


def visible(page: str) -> str:
    """Text outside tags, comments, scripts and styles, in one pass forward."""
    parts, shown, at, closes = [], 0, 0, True
    while (at := page.find("<", at)) >= 0:
        if hidden := _UNSHOWN.match(page, at):
            close = _CLOSE[hidden[1].lower()].search(page, hidden.end())
            to = close.end() if close else len(page)
        elif page.startswith("<!--", at):
            to = _end(page.find("-->", at + 4), page)
            to = min(to + 3, len(page))
        else:
            to = page.find(">", at) + 1 if closes else 0
            if not to:  # no tag ends from here on
                closes, at = False, at + 1
                continue
        parts += [page[shown:at], " "]
        shown = at = to
    return html.unescape("".join([*parts, page[shown:]]))


def _tags(opening: re.Pattern, page: str) -> Iterator[tuple[int, int]]:
    """Where the inside of each such tag begins and ends. What begins inside another is part of that."""
    at = 0
    while found := opening.search(page, at):
        at = _end(page.find(">", found.end()), page)
        yield found.end(), at


def declared(page: str) -> str | None:
    """Language of the first page tag that states one, else of the first meta tag for it."""
    for at, to in _tags(_HTML, page):
        if found := _LANG.search(page, at, to):
            return found[1].lower()
    for at, to in _tags(_META, page):
        if (name := _NAME.search(page, at, to)) and (found := [m[1] for m in _CONTENT.finditer(page, name.end(), to)]):
            return found[-1].lower()
    return None


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word and letter group."""
    up, row = np.uint64(64 - BITS), words.row_of()
    ids, of = [words.hash >> up], [row]
    for size in GROUPS:
        count = np.maximum(words.end - words.start - size + 1, 0)
        at = np.arange(count.sum()) + np.repeat(words.start - (np.cumsum(count) - count), count)
        ids.append(((words.spans(at, at + size) + np.uint64(size)) * np.uint64(0x9FB21C651E98DF25)) >> up)
        of.append(np.repeat(row, count))
    return np.concatenate(ids).astype(np.int64), np.concatenate(of)


def _scan(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, at = buffers(texts)
    for row, to in pieces(at, 1 << 19):
        yield row, to, words_of(data[at[row] : at[to]], at[row : to + 1] - at[row], lower=True, letters=True)


def sampled_texts(known: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, text, copies) of at most ``sample`` distinct pairs of ``known`` (lang, text), picked by hash."""
    by = F.xxhash64("lang", "text")
    total = known.select(by).distinct().count()
    if total > sample:
        # The sample's size varies by its root; a tenth less keeps it under the bound.
        known = known.where(F.pmod(by, F.lit(1 << 30)) < F.lit(int((1 << 30) * 0.9 * sample / total)))
    return known.groupBy("lang", "text").agg(F.count(F.lit(1)).alias("copies"))


def text_model(documents: DataFrame, sample: int = SAMPLE, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and log probability of each bucket under each, from at most ``sample`` distinct texts.

    A text counts as often as it occurs.
    """
    known = documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, copies = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(2).to_numpy()
            for row, to, words in _scan(batch.column(1)):
                ids, of = buckets(words)
                own, times = langs[row:to][of], copies[row:to][of]
                for lang in set(langs[row:to]):
                    counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    counts[lang] += np.bincount(ids[own == lang], times[own == lang], 1 << BITS).astype(np.int64)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = sampled_texts(known, sample).mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # 2**BITS rows a language at most
    langs = sorted(table["lang"].unique())
    counts = np.full((len(langs), 1 << BITS), SMOOTH)
    counts[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["bucket"].to_numpy(int)] += table["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _likelihoods(counts: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """(key, array over languages of log P(key | language)) from (key, lang, n)."""
    total = counts.agg(*[F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n{i}") for i, x in enumerate(langs)], F.countDistinct(key).alias("kinds"))
    per = counts.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"c{i}") for i, x in enumerate(langs)])
    sums = total.first()
    logs = [F.log((F.col(f"c{i}") + SMOOTH) / F.lit((sums[f"n{i}"] or 0) + SMOOTH * (sums["kinds"] + 1))) for i in range(len(langs))]
    return per.select(key, F.array(*logs).alias(f"{key}_log"))


def languages(pages: DataFrame, documents: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, lang, posterior, text_lang, declared, host."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[id_col]
    langs, logs = text_model(documents)
    host = _host(F.col(url_col))
    slim = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    if not langs:
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("posterior", "double"), ("text_lang", "string"), ("declared", "string"))]
        return slim.select("page_id", *nothing, "host")
    shared = spark.sparkContext.broadcast(logs.astype(np.float32))  # 2**BITS floats a language

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                raw = batch.column(2).slice(at, 256).to_pylist()
                texts, said = pa.array([visible(x) for x in raw], pa.string()), [declared(x) for x in raw]
                for row, to, words in _scan(texts):
                    ids, of = buckets(words)
                    n = np.bincount(of, minlength=to - row)
                    sums = np.stack([np.bincount(of, w[ids], to - row) for w in shared.value], axis=1)
                    sums *= np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
                    columns = [c.slice(at + row, to - row) for c in batch.columns[:2]]
                    columns += [pa.array(said[row:to], pa.string()), pa.array(list(sums), pa.list_(pa.float64())), pa.array(n > 0)]
                    yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "declared", "text_log", "has_text"])

    schema = f"page_id {kind}, host string, declared string, text_log array<double>, has_text boolean"
    top = lambda logs: F.element_at(F.array(*map(F.lit, langs)), F.array_position(logs, F.array_max(logs)).cast("int"))
    read_pages = slim.mapInArrow(read, schema)
    read_pages = written(read_pages.withColumn("text_lang", F.when(F.col("has_text"), top(F.col("text_log")))), "pages")
    # Declarations outside the languages known are one kind, so the table of kinds is bounded.
    stated = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other")).otherwise(F.lit("none"))
    votes = read_pages.where("text_lang is not null").select("host", stated.alias("stated"), F.col("text_lang").alias("lang"))
    by_host = written(votes.groupBy("host", "lang").agg(F.count(F.lit(1)).alias("n")), "hosts")
    by_stated = votes.groupBy("stated", "lang").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("host", r"\.")
    domain = F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)))
    hosts = read_pages.select("host").distinct().withColumns({"domain": domain, "suffix": F.element_at(labels, -1)})
    suffix_votes = by_host.withColumn("suffix", F.element_at(labels, -1)).groupBy("suffix", "lang").agg(F.sum("n").alias("n"))
    suffixes = _likelihoods(written(suffix_votes, "suffixes"), "suffix", langs)
    counts = lambda df, key: df.groupBy(key).agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).cast("double") for x in langs]).alias(f"{key}_n")
    )
    overall = by_host.groupBy("lang").agg(F.sum("n").alias("n")).collect()  # one row per language
    n_all = {r["lang"]: r["n"] for r in overall}
    whole = sum(n_all.values())
    world = F.array(*[F.lit((n_all.get(x, 0) + 1.0) / (whole + len(langs))) for x in langs])
    zero = F.array(*[F.lit(0.0) for _ in langs])
    hosts = (
        hosts.join(counts(by_host, "host"), "host", "left")
        .join(counts(by_host.withColumn("domain", domain), "domain"), "domain", "left")
        .join(suffixes, "suffix", "left")
    )
    hosts = written(
        hosts.select(
            "host",
            *[F.coalesce(F.col(c), zero).alias(c) for c in ("host_n", "domain_n", "suffix_log")],
        ),
        "priors",
    )
    stated_logs = F.broadcast(_likelihoods(written(by_stated, "stated"), "stated", langs))
    # One row per host and kind on the right, so a hot host can be split.
    joined = read_pages.withColumn("stated", stated).join(hosts, "host").join(stated_logs, "stated", "left")
    own = [(F.col("text_lang") == x).cast("double") for x in langs]
    less = lambda name: [F.col(name)[i] - F.coalesce(own[i], F.lit(0.0)) for i in range(len(langs))]

    def leaned(counts: list[Column], parent: list[Column]) -> list[Column]:
        size = sum(counts, F.lit(0.0))
        return [(c + LEAN * p) / (size + LEAN) for c, p in zip(counts, parent, strict=True)]

    prior = leaned(less("host_n"), leaned(less("domain_n"), [world[i] for i in range(len(langs))]))
    evidence = [
        F.col("text_log")[i] + F.log(p) + F.col("suffix_log")[i] + F.coalesce(F.col("stated_log")[i], F.lit(0.0)) for i, p in enumerate(prior)
    ]
    scored = joined.select("page_id", "text_lang", "declared", "host", F.array(*evidence).alias("logs"))
    best = F.array_max("logs")
    share = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    return scored.select("page_id", top(F.col("logs")).alias("lang"), (F.lit(1.0) / share).alias("posterior"), "text_lang", "declared", "host")
