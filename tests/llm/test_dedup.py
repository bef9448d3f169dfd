import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faregrid.llm import components, exact_dedup, minhash, substrings
from tests.llm import brute

RNG = brute.seeded()
BASE = [brute.prose(RNG, 60) for _ in range(4)]
LONG = brute.prose(RNG, 30_000, 10**6)
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "one two three"), (7, "One  two\nthree"), (8, LONG), (9, LONG + " tail"), (9, LONG + " tail")]


def near_rows():
    """Exact copies, chains of small changes, changes around the threshold, unrelated texts."""
    rows = list(EDGES)
    for n, base in enumerate(BASE):
        rows += [(100 * (n + 1) + i, base) for i in range(5)]
        text = base
        for i in range(6):
            text = brute.mutated(RNG, text, 0.012)
            rows.append((100 * (n + 1) + 20 + i, text))
        rows += [(100 * (n + 1) + 40 + i, brute.mutated(RNG, base, 0.02 * RNG.random() + 0.01)) for i in range(25)]
    rows += [(1000 + i, brute.prose(RNG, 30)) for i in range(30)]
    return rows


def empty(spark):
    return brute.documents(spark, [(1, "a")]).where("doc_id < 0")


class TestExact:
    ROWS = [*EDGES, (20, "x  y"), (21, "x y"), (22, "x\ny "), (23, "x y "), (None, "x y"), (20, "x  y"), (20, "other"), (24, " "), (25, " ")]

    @pytest.mark.parametrize("words", [1, 64, exact_dedup.FILTER_WORDS])
    def test_groups(self, spark, words):
        got = [tuple(r) for r in exact_dedup.exact_groups(brute.documents(spark, self.ROWS), words=words).collect()]
        groups: dict = {}
        for i, t in self.ROWS:
            groups.setdefault(brute.normalised_digest(t), []).append(i)
        assert sorted(((r[0], r[4]) for r in got), key=str) == sorted(((i, brute.normalised_digest(t)) for i, t in self.ROWS), key=str)
        for i, keep, size, _, digest in got:
            known = [x for x in groups[digest] if x is not None]
            assert (keep, size) == (min(known) if known else None, len(groups[digest])), i
        kept = [r[4] for r in got if r[3]]
        assert sorted(kept) == sorted(groups)

    def test_no_python_in_the_plan(self, spark):
        df = exact_dedup.exact_groups(brute.documents(spark, self.ROWS))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan

    def test_dropping_keeps_columns_and_one_row_per_text(self, spark):
        docs = brute.documents(spark, self.ROWS)
        got = exact_dedup.drop_exact_copies(docs)
        assert got.columns == docs.columns
        left = [(r["doc_id"], brute.normalised_digest(r["text"])) for r in got.collect()]
        assert len(left) == len({d for _, d in left}) == len({brute.normalised_digest(t) for _, t in self.ROWS})

    def test_empty(self, spark):
        assert exact_dedup.exact_groups(empty(spark)).count() == 0
        assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0


class TestComponents:
    def test_against_union(self, spark):
        rng = brute.seeded(3)
        links = [(i, i + 1) for i in range(200)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)] + [(900, i) for i in range(901, 960)]
        got = dict(components.components(spark.createDataFrame(links, "u long, v long")).distinct().collect())
        parent = {x: x for p in links for x in p}
        for _ in range(len(parent)):
            moved = False
            for a, b in links:
                low = min(parent[a], parent[b])
                moved |= parent[a] != low or parent[b] != low
                parent[a] = parent[b] = low
            if not moved:
                break
        alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: p for x, p in parent.items() if x not in alone}

    def test_empty(self, spark):
        assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


class TestNear:
    def check(self, spark, rows):
        got = minhash.near_duplicates(brute.documents(spark, rows)).collect()
        want = brute.near_components(rows)
        assert len(got) == len(rows)
        for r in got:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (want[r["doc_id"]] == r["doc_id"])
        sizes = {(i, len(brute.shingles(t))) for i, t, *_ in rows}
        assert {(r["doc_id"], r["n_shingles"]) for r in got} == sizes

    def test_against_all_pairs(self, spark):
        self.check(spark, near_rows())

    def test_buckets_without_a_common_hub(self, spark, monkeypatch):
        # Few, coarse bands give buckets of strangers, so the block comparison has to find links.
        monkeypatch.setattr(minhash, "BLOCK", 150)
        monkeypatch.setattr(minhash, "CHUNK", 400)
        rng = brute.seeded(8)
        base = brute.prose(rng, 50)
        rows = [(i, brute.mutated(rng, base, 0.03)) for i in range(60)]
        self.check(spark, rows)

    def test_null_id_and_columns(self, spark):
        docs = brute.documents(spark, [(None, BASE[0]), (1, BASE[0]), (2, BASE[0] + " end"), (3, None)])
        got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
        assert got == {None: (None, True), 1: (1, True), 2: (1, False), 3: (3, True)}
        left = minhash.drop_near_copies(docs)
        assert left.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "None"]

    def test_empty(self, spark):
        assert minhash.near_duplicates(empty(spark)).count() == 0


class TestNearByRow:
    def test_one_row_of_each_group_stays(self, spark):
        a, b, c = BASE[:3]
        rows = [(None, a + " end"), (7, a), (None, "alone " + brute.prose(brute.seeded(11), 40)), (None, c), (None, c + " end")]
        # The two texts of id 5 are documents of their own: 4 stands for one, 5 for the other.
        rows += [(5, a + " tail"), (5, b), (4, a + " more"), (9, b + " end"), (10, None), (None, None), (None, "")]
        docs = brute.documents(spark, rows)
        for left in (minhash.drop_near_copies(docs, by_row=True), corpus_pipeline.near(spark, docs, "")):
            assert left.columns == docs.columns
            got = [(r["doc_id"], r["text"]) for r in left.collect()]
            assert len(got) == 7
            assert {(4, a + " more"), (5, b), rows[2], (10, None), (None, None), (None, "")} < set(got)
            assert len({(None, c), (None, c + " end")} & set(got)) == 1

    def test_as_by_id_where_ids_are_unique(self, spark):
        rows = near_rows()[:-1]
        rows = list({i: (i, t) for i, t in rows}.values())
        got = sorted(r["doc_id"] for r in minhash.drop_near_copies(brute.documents(spark, rows), by_row=True).collect())
        assert got == sorted(set(brute.near_components(rows).values()))

    def test_empty(self, spark):
        assert minhash.drop_near_copies(empty(spark), by_row=True).count() == 0


class TestSubstrings:
    def rows(self):
        rng = brute.seeded(9)
        passage, shared = brute.prose(rng, 70, 10**6), brute.prose(rng, 19, 10**6)
        rows = [*EDGES[:-2], (9, LONG + " tail"), (9, LONG + " tail"), (30, "same " * 200), (31, "same same " * 30)]
        for i in range(40, 80):
            rows.append((i, f"{brute.prose(rng, 25)} {passage if i % 2 else shared} {brute.prose(rng, rng.randrange(30))}"))
        rows += [(90, rows[20][1]), (91, rows[20][1] + " more words"), (92, f"{passage}\n{passage}")]
        return rows

    @pytest.mark.parametrize(("shared", "group"), [(1000, 20_000), (3, 20), (1, 5)])
    def test_against_brute_force(self, spark, monkeypatch, shared, group):
        monkeypatch.setattr(substrings, "SHARED", shared)
        monkeypatch.setattr(substrings, "GROUP", group)
        rows = self.rows()
        got = substrings.without_repeats(brute.documents(spark, rows), digests=True).collect()
        want = brute.without_repeats(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]], r["doc_id"]

    def test_texts(self, spark):
        rows = self.rows()[-12:] + [(None, "a  b"), (95, None)]
        docs = brute.documents(spark, rows)
        by_text = {r["doc_id"]: r["kept"] for r in substrings.without_repeats(docs).collect()}
        by_digest = {r["doc_id"]: r["kept"] for r in substrings.without_repeats(docs, digests=True).collect()}
        import hashlib

        assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in by_text.items()} == by_digest
        assert by_text[None] == "a b" and by_text[95] == ""

    def test_empty(self, spark):
        assert substrings.without_repeats(empty(spark), digests=True).count() == 0

    @pytest.mark.parametrize(("shared", "group"), [(1000, 20_000), (2, 20)])
    def test_rows_that_share_an_id_or_have_none(self, spark, monkeypatch, shared, group):
        monkeypatch.setattr(substrings, "SHARED", shared)
        monkeypatch.setattr(substrings, "GROUP", group)
        rng = brute.seeded(21)
        said = lambda n: brute.prose(rng, n, 10**6)
        passage, whole, own = said(40), said(60), said(60)
        rows = [
            (1, f"{said(30)} {passage} {said(30)}"), (None, f"{said(30)} {passage} {said(30)}"), (None, said(100)),
            (2, f"{said(30)} {passage} {said(30)}"), (2, said(100)), (3, whole), (None, whole),
            (None, f"{whole[: len(whole) // 2]} {said(50)}"), (None, f"{own} {said(5)}"), (None, f"{own} {said(6)}"),
            (4, f"{passage}  {said(9)}"), (5, "a b"), (5, None), (None, None), (None, "few words"), (6, f"{whole} {whole}"),
        ]
        rows += [rows[1], rows[3], rows[8], rows[8], (7, rows[3][1]), (8, f"{own}\n{own}"), (8, f"{own}\n{own}")]
        docs = brute.documents(spark, rows)
        twins = [r[0] for r in docs.select(F.xxhash64(F.coalesce("text", F.lit(""))), F.monotonically_increasing_id().alias("i")).orderBy("i").collect()]
        keyed = [((i is None, i or 0, twin), t) for (i, t), twin in zip(rows, twins, strict=True)]
        want = brute.without_repeats(keyed)
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substrings.without_repeats(docs, digests=True).collect()]
        order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
        assert sorted(got, key=order) == sorted(((i, *want[key]) for (i, _), (key, _) in zip(rows, keyed, strict=True)), key=order)
        assert want[keyed[2][0]][1] == want[keyed[4][0]][1] == 0 and want[keyed[1][0]][1] == 40

    def test_unshared_ids_are_keys_alone(self, spark, monkeypatch):
        """One row without id, all others with their own: no hash of a text is in any written table."""
        seen = []
        kept = substrings.written
        monkeypatch.setattr(substrings, "written", lambda df, label: seen.append(kept(df, label)) or seen[-1])
        docs = brute.documents(spark, [*self.rows()[-6:], (None, LONG)])
        assert substrings.without_repeats(docs, digests=True).count() == 7
        runs = [df for df in seen if "first" in df.columns]
        assert runs and all(df.where("twin <> 0").isEmpty() for df in runs)

    def test_subtree_follows_words(self):
        said = [b" ".join(b"%d" % (i % 7) for i in range(30)), b" ".join(b"%d" % ((i + 3) % 7) for i in range(25))]
        said.append(b" ".join([*said[0].split()[:17], b"x", b"y", b"z", b"0"]))
        n = np.array([11, 6, 2])
        words = [t.split() for t in said]
        windows = [tuple(w[j : j + 20]) for w, c in zip(words, n, strict=True) for j in range(c)]
        order, shared = substrings.subtree(said, n)
        assert sorted(order.tolist()) == list(range(len(windows))) and shared[0] == 0
        for before, at, length in zip(order, order[1:], shared[1:], strict=False):
            a, b = windows[before], windows[at]
            assert length == next((k for k in range(20) if a[k] != b[k]), 20)
        # Equal windows are neighbours.
        nodes = np.empty(len(order), int)
        nodes[order] = np.cumsum(shared < 20)
        assert [windows.index(w) for w in windows] == [nodes.tolist().index(x) for x in nodes]

    def test_subtree_numbers_words_in_few_bytes(self):
        """No Python object per word; chunks of a column number equal words alike."""
        import tracemalloc

        import pyarrow as pa

        said = [b" ".join(b"word%06d" % (i * k % 9973) for i in range(36)) for k in range(1, 4001)]
        n = np.full(len(said), 17)
        column = pa.chunked_array([said[:1500], said[1500:]], pa.binary())
        order, shared = substrings.subtree(column, n)
        tracemalloc.start()
        plain = substrings.subtree(said, n)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 * 36 * len(said)
        assert np.array_equal(order, plain[0]) and np.array_equal(shared, plain[1])

    def test_groups_hold_fewer_stretches_than_a_prefix_may(self):
        """Large prefixes that meet in a group don't add up to several times what a task holds."""
        assert substrings.GROUP * 4 <= substrings.SHARED

    def test_few_texts_go_to_python_at_once(self, spark, monkeypatch):
        sizes = []
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        kept, before = substrings.written, spark.conf.get(key)
        monkeypatch.setattr(substrings, "written", lambda df, label: sizes.append(int(spark.conf.get(key))) or kept(df, label))
        docs = brute.documents(spark, self.rows()[-6:])
        assert substrings.without_repeats(docs, digests=True).count() == 6
        assert sizes and max(sizes) <= 1000 and spark.conf.get(key) == before


def test_unsettled_pairs_are_compared_in_blocks():
    import numpy as np
    import pyarrow as pa

    base = brute.prose(brute.seeded(1), 60)
    texts = {1: base, 2: base + " end", 3: "other " + brute.prose(brute.seeded(2), 60), 4: base + " more words"}
    sets = {i: minhash.shingle_sets(next(minhash.scan(pa.array([t]), lower=True))[2])[0] for i, t in texts.items()}
    sign = {i: minhash.signatures([s])[0] for i, s in sets.items()}
    key = int(minhash._band_keys(sign[1][None])[0][0])
    assert all(int(minhash._band_keys(sign[i][None])[0][0]) == key for i in (2, 4))
    # 4 is minor; 1 and 2 are in the major component, so one link to it is enough.
    rows = [(4, 4, True), (1, 1, False), (2, 1, False), (4, 4, False)]
    table = pa.table(
        {
            "key": [key] * 4, "hub": [9] * 4, "major": [1] * 4, "member": [m for m, *_ in rows], "component": [c for _, c, _ in rows],
            "n_shingles": [len(sets[m]) for m, *_ in rows], "signature": [sign[m].tobytes() for m, *_ in rows],
            "text": [texts[m] for m, *_ in rows], "minor": [x for *_, x in rows],
        }
    )
    found = minhash._settled(table).to_pydict()
    assert found["u"] == [4] and found["v"][0] in (1, 2)
    assert np.array_equal(sets[1], np.unique(sets[1]))
