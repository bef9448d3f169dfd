import numpy as np
import pyarrow as pa
import pytest

from faregrid.llm import ann, language, licenses, toxicity
from tests.llm import brute

from pyspark.sql import functions as F

MEDIUM = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def read(spark, name, sf=MEDIUM):
    return spark.read.parquet(f"{sf}/{name}.parquet")


class TestToxicity:
    def test_held_out_accuracy(self, spark):
        docs, labels = read(spark, "documents", LARGER), read(spark, "labels", LARGER)
        got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
        assert (got["predicted"] == got["toxic"]).mean() > 0.95
        assert got[got["toxic"] == 1]["score"].median() > 0.9
        assert got["score"].between(0, 1).all()

    def rows(self):
        rng = brute.seeded(4)
        rows, labels = [], []
        for i in range(600):
            text = ". ".join(brute.prose(rng, 12) for _ in range(6))
            bad = i % 4 == 0
            rows.append((i, text.replace("w", "vile ", 1) if bad else text))
            labels.append((i, 1, int(bad)))
        return rows, labels

    def test_sentences_and_edges(self, spark):
        rows, labels = self.rows()
        extra = [(1000, None), (1001, ""), (1002, " \n"), (1003, "You vile one. Nice day."), (None, "plain w1"), (1003, "You vile one. Nice day.")]
        docs = brute.documents(spark, rows + extra)
        known = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1), (77_777, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
        got = toxicity.toxicity(docs, known).collect()
        assert len(got) == len(rows) + len(extra)
        score = {r["doc_id"]: r for r in got}
        assert score[1003]["predicted"] == 1 and score[1001]["predicted"] == score[1000]["predicted"] == 0
        assert score[1000]["score"] == score[1001]["score"] == score[1002]["score"]
        model = toxicity.trained(docs.select("doc_id", "text"), known)
        found = toxicity.offending(docs, model).where("doc_id = 1003").collect()
        assert [(r["sentence"], r["text"]) for r in found] == [(0, "You vile one"), (0, "You vile one")]
        left = toxicity.drop_toxic(docs, known)
        assert left.columns == docs.columns
        assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in got if not (r["predicted"] and r["doc_id"] is not None)}

    def test_rows_go_by_their_own_text(self, spark):
        rows, labels = self.rows()
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        extra = [(None, "You vile one"), (None, "plain w1"), (2000, "A vile day"), (2000, "plain w2")]
        docs = brute.documents(spark, rows + extra)
        left = toxicity.drop_toxic(docs, known)
        assert left.schema == docs.schema
        got = sorted((str(r["doc_id"]), r["text"]) for r in left.collect() if r["doc_id"] in (None, 2000))
        assert got == [("2000", "plain w2"), ("None", "plain w1")]
        clean = toxicity.toxicity(docs, known).where("predicted = 0").count()
        assert left.count() == clean

    def test_sample_is_bounded_in_rows_and_bytes(self, spark):
        """An id in thousands of rows, with other texts or the same one, is one training row."""
        rows, labels = self.rows()
        hot = next(i for i in range(600) if not brute_held_out(i))
        rows += [(hot, f"other {i % 7}") for i in range(3000)] + [(5000, "long " * 300_000)]
        labels += [(i, 1, 0) for i in range(5000, 5002)]
        docs = brute.documents(spark, rows).select("doc_id", "text")
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        whole = toxicity.training_rows(docs, known)
        learned = [i for i, *_ in labels if not brute_held_out(i) and i < 5000]
        assert whole.count() == whole.select("by").distinct().count() == len(learned)
        few = toxicity.training_rows(docs, known, sample=100)
        assert 0 < few.count() <= 100
        size = F.sum(F.octet_length("text")).alias("n")
        all_bytes = whole.agg(size).first()["n"]
        part = toxicity.training_rows(docs, known, sample_bytes=all_bytes // 3)
        assert 0.3 * all_bytes < part.agg(size).first()["n"] <= all_bytes // 3

    def test_worst_sentence(self, spark):
        rows, labels = self.rows()
        extra = [(1000, "Plain w1. You vile one! A vile day. Nice w2."), (1001, None), (1002, "plain w1"), (None, "\u00e9t\u00e9 vile w3\nw4")]
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = {r["doc_id"]: r for r in toxicity.toxicity(brute.documents(spark, rows + extra), known).collect()}
        assert got[1000]["n_offending"] == 2 and got[1000]["worst_sentence"] in ("You vile one", "A vile day")
        assert (got[None]["n_offending"], got[None]["worst_sentence"]) == (1, "\u00e9t\u00e9 vile w3")
        assert all((got[i]["n_offending"], got[i]["worst_sentence"]) == (0, None) for i in (1001, 1002))
        assert all((r["worst_sentence"] is not None) == (r["predicted"] == 1) for r in got.values())

    def test_labels_of_held_out_rows_are_not_learned(self, spark):
        rows, labels = self.rows()
        docs = brute.documents(spark, rows).select("doc_id", "text")
        flipped = [(i, q, 1 - t if brute_held_out(i) else t) for i, q, t in labels]
        one, two = (toxicity.trained(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
        assert one.base == two.base and (one.weights == two.weights).all()

    @pytest.mark.parametrize(("toxic", "score"), [(None, 0.0), (0, 0.0), (1, 1.0)])
    def test_one_class_and_empty(self, spark, toxic, score):
        docs = brute.documents(spark, [(i, f"text {i}") for i in range(20)])
        labels = spark.createDataFrame([(i, 1, toxic) for i in range(20)], "doc_id long, quality int, toxic int")
        assert {r["score"] for r in toxicity.toxicity(docs, labels).collect()} == {score}
        assert toxicity.toxicity(docs.where("doc_id < 0"), labels).count() == 0


def brute_held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


class TestNearest:
    def brute(self, rows, k=10):
        out = {}
        for q, v in rows.items():
            if q % 100 == 0:
                far = sorted((float(np.sqrt(((np.array(v, np.float64) - np.array(w, np.float64)) ** 2).sum())), i) for i, w in rows.items() if i != q)
                out[q] = far[:k]
        return out

    @pytest.mark.parametrize("flat", [ann.FLAT_LISTS, 8])
    def test_recall(self, spark, monkeypatch, flat):
        monkeypatch.setattr(ann, "FLAT_LISTS", flat)  # 8: centres trained in two levels
        vectors = read(spark, "embeddings", LARGER)
        rows = {r["vec_id"]: np.array(r["embedding"], np.float32) for r in vectors.collect()}
        got: dict = {}
        for r in ann.nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        want = self.brute(rows)
        assert all(len(got[q]) == 10 and got[q] == sorted(got[q]) for q in want)
        assert np.mean([len({i for _, i in got[q]} & {i for _, i in w}) / 10 for q, w in want.items()]) >= 0.9
        for q, found in got.items():
            exact = {i: float(np.sqrt(((rows[q].astype(float) - rows[i].astype(float)) ** 2).sum())) for _, i in found}
            assert all(abs(exact[i] - s) < 1e-12 for s, i in found)

    def test_lists_grow_with_the_root_of_the_rows(self):
        assert [ann.wanted_lists(n) for n in (1, 10_000, 4_000_000, 10**12)] == [1, 100, 2000, ann.MOST_LISTS]
        assert [ann.sample_size(n) for n in (1, 10_000, 4_000_000, 10**12)] == [8192, 8192, 32_000, ann.PER_LIST * ann.MOST_LISTS]
        rng = np.random.default_rng(6)
        middles = rng.standard_normal((3000, 16)).astype(np.float32)
        vectors = (middles[rng.integers(0, 3000, 32_000)] + 0.2 * rng.standard_normal((32_000, 16))).astype(np.float32)
        index = ann.Index(vectors, 4_000_000, 10)
        assert 0.85 * 2000 <= len(index.centres) <= 1.05 * 2000
        sizes = np.bincount(index.lists(vectors)[:, 0], minlength=len(index.centres))
        assert sizes.max() <= 10 * sizes.mean()
        # What a query scans is a small share of the rows.
        assert index.probes / len(index.centres) <= 0.1

    def test_nearest_centres_by_pieces(self, monkeypatch):
        rng = np.random.default_rng(7)
        x, centres = rng.standard_normal((100, 5)).astype(np.float32), rng.standard_normal((9, 5)).astype(np.float32)
        whole = [ann.Index._nearest(x, centres, n) for n in (1, 4, 20)]
        monkeypatch.setattr(ann, "DISTANCES", 30)
        for n, want in zip((1, 4, 20), whole, strict=True):
            assert np.array_equal(ann.Index._nearest(x, centres, n), want) and want.shape == (100, min(n, 9))
        assert ann.Index._nearest(x[:0], centres, 4).shape == (0, 4)

    def test_odd_vectors_ties_and_repeats(self, spark):
        rng = np.random.default_rng(1)
        good = {i: rng.standard_normal(20).astype(np.float32).tolist() for i in (0, 1, 2, 3)}
        good |= {i: good[1] for i in (100, 101, 102)}
        odd = [(50, None), (51, []), (52, [0.0] * 20), (53, [float("nan")] * 20), (54, [float("inf")] + [1.0] * 19), (55, [None] + [1.0] * 19), (200, [1.0, 2.0]), (None, good[1])]
        rows = [(i, v, i) for i, v in [*good.items(), *odd, (2, good[2])]]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank long")
        got: dict = {}
        for r in ann.nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((round(r["score"], 12), r["vec_id"]))
        assert got == {q: [(round(s, 12), i) for s, i in w] for q, w in self.brute(good).items()}

    def test_doubles_are_measured_as_doubles(self, spark):
        """Vectors that single precision can't tell apart are ranked by their distances."""
        rng = np.random.default_rng(8)
        base = rng.standard_normal(24)
        good = {i: (base + 1e-9 * rng.standard_normal(24)).tolist() for i in range(120)}
        good |= {i: rng.standard_normal(24).tolist() for i in range(120, 160)}
        odd = [(500, [float("nan")] * 24), (600, [0.0] * 24), (700, [float("-inf")] * 24), (801, [1e300] * 24)]
        vectors = spark.createDataFrame([*good.items(), *odd], "vec_id long, embedding array<double>")
        got: dict = {}
        for r in ann.nearest(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        want = self.brute(good)
        assert [[i for _, i in got[q]] for q in (0, 100)] == [[i for _, i in want[q]] for q in (0, 100)]
        assert all(abs(s - e) < 1e-15 and s > 0 for q in got for (s, _), (e, _) in zip(got[q], want[q], strict=True))
        assert set(got) == {0, 100}

    def test_queries_with_few_vectors_in_their_lists(self, spark, monkeypatch):
        monkeypatch.setattr(ann.Index, "_calibrated", lambda self, sample, k: 1)
        rng = np.random.default_rng(3)
        centre = rng.standard_normal(8)
        good = {i: (centre + 0.01 * rng.standard_normal(8) if i % 10 else 50 * rng.standard_normal(8)).astype(np.float32).tolist() for i in range(400)}
        vectors = spark.createDataFrame(list(good.items()), "vec_id long, embedding array<float>")
        got = {r["query_id"]: r["count"] for r in ann.nearest(vectors, F.col("vec_id") % 10 == 0).groupBy("query_id").count().collect()}
        assert got == dict.fromkeys(range(0, 400, 10), 10)

    def test_empty(self, spark):
        vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
        got = ann.nearest(vectors, F.col("vec_id") % 100 == 0)
        assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 0

    def test_common_vector_is_split_and_ranked_by_id(self, spark, monkeypatch):
        monkeypatch.setattr(ann, "BLOCK_ROWS", 50)
        rng = np.random.default_rng(2)
        same = rng.standard_normal(16).astype(np.float32).tolist()
        rows = [(i, same if i % 2 == 0 else rng.standard_normal(16).astype(np.float32).tolist()) for i in range(600)]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 100).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18] and {r["score"] for r in got} == {0.0}


class TestLicenses:
    def brute(self, text, least=licenses.LEAST):
        import re

        def grams(t):
            ws = re.findall(rb"(?:[0-9a-z]|[\x80-\xff])+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
            return {tuple(ws[i : i + 2]) for i in range(len(ws) - 1)}

        text = text or ""
        units = [text, *text.split("\n"), *re.split(r"\n(?:[^\w\n]*\n)+", text)]
        best = (0.0, None)
        for name, other in ((n, grams(t)) for n, t in sorted(licenses.TEMPLATES.items())):
            for unit in units:
                own = grams(unit)
                if own and other:
                    dice = 2 * len(own & other) / (len(own) + len(other))
                    if dice >= least and dice > best[0]:
                        best = (dice, name)
        return best

    def test_pruned_equals_unpruned(self, spark):
        rng = brute.seeded(6)
        rows = [(1, None), (2, ""), (3, "license"), (4, "Released under the MIT License."), (5, "x\nreleased UNDER the mit license\ny")]
        for n, text in enumerate(licenses.TEMPLATES.values()):
            for i, share in enumerate((0.0, 0.05, 0.1, 0.2)):
                said = brute.mutated(rng, text, share)
                rows.append((100 * n + 10 + i, f"{brute.prose(rng, 40)}\n{said}\n\n{brute.prose(rng, 30)}"))
                words = said.split()
                middle = len(words) // 2
                rows.append((100 * n + 20 + i, f"{brute.prose(rng, 40)}\n\n{' '.join(words[:middle])}\n{' '.join(words[middle:])}\n\n{brute.prose(rng, 5)}"))
        rows += [(5000, brute.prose(rng, 50_000)), (4, "Released under the MIT License.")]
        got = licenses.scanned(brute.documents(spark, rows)).collect()
        assert len(got) == len(rows)
        texts = dict(rows)
        for r in got:
            dice, name = self.brute(texts[r["doc_id"]])
            assert (r["license"], round(r["dice"], 12)) == (name, round(dice, 12)), r["doc_id"]

    def test_whole_table(self, spark):
        docs = read(spark, "documents")
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        got = {r["doc_id"]: (r["dice"], r["license"]) for r in licenses.scanned(docs).collect()}
        assert got == {i: self.brute(t) for i, t in texts.items()}

    def stretches(self, text, least=licenses.LEAST):
        """Best (dice, license) over all stretches in the templates' size ranges, one by one."""
        import re

        words = lambda t: re.findall(r"[0-9a-z]+", t.lower())
        said, best = words(text), (0.0, None)
        said = list(zip(said, said[1:], strict=False))
        for name, template in sorted(licenses.TEMPLATES.items()):
            other = words(template)
            other = set(zip(other, other[1:], strict=False))
            for a in range(len(said)):
                for b in range(a + 1, min(len(said), a + int(len(other) * (2 - least) / least + 1e-9)) + 1):
                    own = set(said[a:b])
                    dice = 2 * len(own & other) / (len(own) + len(other))
                    if dice >= least and dice > best[0]:
                        best = (dice, name)
        return best

    def test_notices_inside_lines(self, spark):
        rng = brute.seeded(7)
        rows = [
            (1, "Copyright (c) 2020 Jane Doe. Released under the MIT License."),
            (2, f"{brute.prose(rng, 30)} licensed under CC BY 4.0, {brute.prose(rng, 40)}"),
            (3, f"// {licenses.TEMPLATES['BSD'][:40]}\n// {licenses.TEMPLATES['BSD'][40:]} {brute.prose(rng, 9)}"),
            (4, "under the license " * 60),
            (5, None),
        ]
        for n, name in enumerate(("GPL-2.0", "MIT", "MPL-2.0", "Unlicense")):
            for i in range(4):
                said = brute.mutated(rng, licenses.TEMPLATES[name], 0.05 * i)
                rows.append((10 * n + 10 + i, f"{brute.prose(rng, 9)} {said} {brute.prose(rng, 5)}"))
        got = {r["doc_id"]: (r["dice"], r["license"]) for r in licenses.scanned(brute.documents(spark, rows), inline=True).collect()}
        assert (got[1], got[2], got[3]) == ((1.0, "MIT"), (1.0, "CC-BY-4.0-short"), (got[3][0], "BSD"))
        for i, text in rows:
            dice, name = max(self.stretches(text or ""), self.brute(text), key=lambda x: x[0])
            assert (got[i][1], round(got[i][0], 12)) == (name, round(dice, 12)), i

    def test_sister_licences_and_all_notices(self, spark):
        header = licenses.TEMPLATES["GPL-3.0-header"].replace
        conditions = licenses.TEMPLATES["BSD-2-Clause"]
        texts = {
            "GPL-2.0-header": header("version 3", "version 2"),
            "GPL-3.0-header": header("", ""),
            "LGPL-3.0-header": header("GNU General", "GNU Lesser General"),
            "AGPL-3.0-header": header("GNU General", "GNU Affero General"),
            "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
            "BSD-2-Clause": f"Copyright (c) 2020 Jane Doe. {conditions}",
            "BSD-3-Clause": f"{conditions}\n{licenses.TEMPLATES['BSD-3-Clause'][len(conditions):]}",
        }
        rows = list(enumerate(texts.values()))
        rows.append((101, licenses.TEMPLATES["BSD-3-Clause"].replace("the copyright holder", "Doe Inc.")))
        rows.append((100, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."))
        got = {r["doc_id"]: r for r in licenses.scanned(brute.documents(spark, rows), inline=True).collect()}
        assert [(got[i]["license"], got[i]["dice"]) for i in range(len(texts))] == [(name, 1.0) for name in texts]
        assert got[101]["license"] == "BSD-3-Clause" and 0.9 < got[101]["dice"] < 1
        both = {n["license"]: n["dice"] for n in got[100]["notices"]}
        assert both["MIT"] == both["Apache-2.0"] == 1.0
        for r in got.values():
            ranked = [(-n["dice"], n["license"]) for n in r["notices"]]
            assert ranked == sorted(ranked) and (-r["dice"], r["license"]) in ranked and -ranked[-1][0] >= licenses.LEAST

    def test_empty(self, spark):
        assert licenses.scanned(brute.documents(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


class TestLanguage:
    def test_agrees_with_the_address(self, spark):
        pages = read(spark, "pages")
        got = language.languages(pages, read(spark, "documents")).join(pages, "page_id").toPandas()
        assert (got["lang"] == got["url"].str.extract(r"://[^/]+/([a-z]+)/")[0]).mean() > 0.97
        assert len(got) == pages.count() and got["posterior"].between(0, 1.0000001).all()

    def test_sample_counts_copies_without_reading_them(self, spark):
        """A text in thousands of rows is one of the sample's texts, weighed by its copies."""
        rows = [(brute.prose(brute.seeded(i), 30), "en" if i % 2 else "de") for i in range(300)]
        rows += [("the same text again", "en")] * 3000 + [("the same text again", "de"), ("", "de"), (None, "en"), ("x", None)]
        docs = spark.createDataFrame(rows, "text string, lang string")
        langs, logs = language.text_model(docs)
        counts = np.full((2, 1 << language.BITS), float(language.SMOOTH))
        for text, lang in rows[:-2]:
            ids, _ = language.buckets(next(language._scan(pa.array([text])))[2])
            np.add.at(counts[langs.index(lang)], ids, 1)
        assert langs == ["de", "en"] and np.allclose(logs, np.log(counts / counts.sum(axis=1, keepdims=True)))
        known = docs.where("lang is not null and text is not null")
        assert language.sampled_texts(known).agg(F.sum("copies")).first()[0] == len(rows) - 2
        assert 0 < language.sampled_texts(known, 100).count() <= 100

    def test_evidence_takes_over_where_text_says_nothing(self, spark):
        docs = read(spark, "documents")
        by_lang = {r["lang"]: r["text"] for r in docs.where("n_chars > 600").orderBy("doc_id").collect()}
        page = lambda lang, declared="": f"<html{declared}><script>if (a<b) the and of</script><p>{by_lang[lang]}</p></html>"
        rows = [(i, f"http://a.firma.de/{i}", page("de"), "x") for i in range(30)] + [(100 + i, f"http://b.site.es/{i}", page("es", ' lang="es"'), "x") for i in range(30)]
        rows += [
            (200, "http://a.firma.de/empty", "", "x"),
            (201, "https://new.firma.de/", None, "x"),
            (202, "http://other.es/x", "<p></p>", "x"),
            (203, None, '<html lang="es-MX"></html>', "x"),
            (204, None, None, "x"),
            (205, "http://a.firma.de/y", page("fr", ' lang="de"'), "x"),
            (200, "http://a.firma.de/empty", "", "x"),
        ]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
        got = language.languages(pages, docs).collect()
        assert len(got) == len(rows)
        lang = {r["page_id"]: r["lang"] for r in got}
        assert (lang[200], lang[201], lang[202], lang[203], lang[205]) == ("de", "de", "es", "es", "fr")
        assert lang[204] in by_lang

    def test_empty(self, spark):
        pages, docs = read(spark, "pages"), read(spark, "documents")
        assert language.languages(pages.where("page_id < 0"), docs).count() == 0
        assert {r["lang"] for r in language.languages(pages, docs.where("doc_id < 0")).collect()} == {None}
