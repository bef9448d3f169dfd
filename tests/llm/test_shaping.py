import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faregrid.llm import chat, mixing, packing
from tests.llm import brute


class TestMixing:
    ROWS = [(i, " ".join(["w"] * (1 + i % 17)), f"s{i % 3}") for i in range(300)] + [
        (1000, None, "s0"),
        (1001, "", None),
        (1002, "a b c", None),
        (1003, "one two", "tiny"),
        (1004, None, "void"),
        (None, "x y z", "s1"),
        (5, " ".join(["w"] * 6), "s2"),
        (2000, "long " * 5000, "s9"),
    ]

    def targets(self, rows, most=3):
        size = defaultdict(int)
        for _, t, s in rows:
            size[s] += len(brute.words(t))
        names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        total, capped = sum(size.values()), set()
        while True:
            rest = [s for s in names if s not in capped]
            level = (total - sum(most * size[s] for s in capped)) / max(1, sum(weight[s] for s in rest))
            over = {s for s in rest if most * size[s] < level * weight[s]}
            if not over:
                return size, {s: most * size[s] if s in capped else level * weight[s] for s in names}
            capped |= over

    def test_targets_and_copies(self, spark):
        docs = brute.documents(spark, self.ROWS)
        got = mixing.mixture(docs).collect()
        size, target = self.targets(self.ROWS)
        assert len(got) == len(self.ROWS)
        taken, largest = Counter(), Counter()
        for r in got:
            assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-12)
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert sum(target.values()) == pytest.approx(sum(size.values()))
        for s in size:
            assert abs(taken[s] - target[s]) <= 3 * largest[s], s
        again = mixing.mixture(docs.repartition(7)).collect()
        assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)

    def test_rows_come_as_often_as_drawn(self, spark):
        docs = brute.documents(spark, self.ROWS)
        out = mixing.mixed(docs)
        assert out.columns == docs.columns
        want = Counter()
        for r in mixing.mixture(docs).collect():
            want[(r["doc_id"], r["source"])] += r["copies"]
        assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +want

    @pytest.mark.parametrize("broadcast", [1 << 20, 0])
    def test_many_rows_alike(self, spark, monkeypatch, broadcast):
        """Rows without id, of one source and size, are drawn each on its own, in any order of arrival."""
        monkeypatch.setattr(mixing, "BROADCAST_IDS", broadcast)
        rows = [(None, f"w{i} x", "s0") for i in range(700)] + [(7, "same text", "s1")] * 300 + [(i, "a b c", "s2") for i in range(100)]
        docs = brute.documents(spark, rows)
        size, target = self.targets(rows)
        out = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(docs).collect())
        for s in size:
            assert abs(sum(n * len(brute.words(t)) for (_, t, x), n in out.items() if x == s) - target[s]) <= 3
        given, drawn = Counter(rows), {"s0": [], "s1": [], "s2": []}
        for row, n in given.items():
            drawn[row[2]].append(out[row] / n)
        rate = {s: target[s] / size[s] for s in size}
        assert all(int(rate[s]) <= x <= int(rate[s]) + 1 for s, xs in drawn.items() for x in xs)
        assert out == Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(docs.repartition(5)).collect())

    def test_empty(self, spark):
        docs = brute.documents(spark, self.ROWS).where("doc_id < 0")
        assert mixing.mixture(docs).count() == 0 and mixing.mixed(docs).count() == 0
        none = brute.documents(spark, [(1, None, "a"), (2, "", "b")])
        assert {(r["target"], r["taken"]) for r in mixing.mixture(none).collect()} == {(0.0, 0)}


class TestPacking:
    ROWS = [(1, None), (2, ""), (3, "a"), (4, "words " * 3000), (5, "don't  stop\n\n now"), (6, "<|endoftext|> x"), (5, "don't  stop\n\n now")] + [
        (100 + i, "some plain text here " * (i % 60)) for i in range(150)
    ]

    @pytest.fixture
    def tokens(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(packing.tokenizer_path())
        t.encode_special_tokens = True
        return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in self.ROWS}

    def test_pieces_and_sequences(self, spark, tokens):
        got = packing.packed(brute.documents(spark, self.ROWS)).collect()
        ids = Counter(i for i, _ in self.ROWS)
        covered, packs = defaultdict(Counter), defaultdict(list)
        for r in got:
            own = tokens[r["doc_id"]]
            assert r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
            covered[r["doc_id"]][(r["start"], r["length"])] += 1
            packs[r["sequence_id"]].append((r["offset"], r["length"]))
        for i, pieces in covered.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at and pieces[(start, length)] == ids[i]
                at += length
            assert at == len(tokens[i])
        assert set(covered) == set(ids)
        for pack in packs.values():
            at = 0
            for offset, length in sorted(pack):
                assert offset == at
                at += length
            assert at <= packing.ROOM
        total = sum(r["length"] for r in got)
        assert len(packs) <= -(-total // packing.ROOM) * 1.1 + 1

    def test_empty(self, spark):
        assert packing.packed(brute.documents(spark, self.ROWS).where("doc_id < 0")).count() == 0

    @settings(max_examples=30, deadline=None)
    @given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=10), st.just(40))
    def test_histogram_equals_piece_by_piece(self, counts, room):
        patterns = packing.pack_histogram(counts, room)
        assert all(sum(n * t for n, t in p) <= room for p, _ in patterns)
        used = Counter()
        for p, c in patterns:
            for n, t in p:
                used[n] += t * c
        assert used == Counter(counts)
        packs: list[int] = []
        for n in sorted(Counter(counts).elements(), reverse=True):
            fits = [i for i, x in enumerate(packs) if x + n <= room]
            if fits:
                best = min(fits, key=lambda i: packs[i])
                packs[best] += n
            else:
                packs.append(n)
        assert sum(c for _, c in patterns) == len(packs)
        rows = packing.slots(patterns)
        places = Counter()
        for length, low, high, base, times, at in rows:
            for rank in range(low, high):
                turn = rank - low
                places.update((base + turn // times, at + turn % times * length + j) for j in range(length))
        assert max(places.values(), default=1) == 1


TEXT = st.text(alphabet="ab <>/[]s\\INSTAR\n\U0001f600", max_size=30) | st.sampled_from([*chat.CONTROLS, "</s>[INST] ok [/INST]", "\\", "\\ls>"])


class TestChat:
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[SEP]", "a\nb"]), TEXT), max_size=6))
    def test_round_trip(self, turns):
        text, spans = chat.formatted(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]

    @given(TEXT)
    def test_no_control_string_is_left(self, text):
        assert not any(c in chat.escaped(text) for c in chat.CONTROLS)

    def test_branches(self, spark):
        # 1 -> 2 -> 3 (score 5), 1 -> 2 -> 4 (9), 1 -> 5 (1); 6 -> 7 on a cycle; 8 answers nobody known.
        rows = [
            ("t", 1, None, "user", "q", 0.0),
            ("t", 2, 1, "assistant", "a", 0.0),
            ("t", 3, 2, "user", "x", 5.0),
            ("t", 4, 2, "user", None, 9.0),
            ("t", 5, 1, "assistant", "z", 1.0),
            ("t", 6, 7, "user", "c", 1.0),
            ("t", 7, 6, "user", "c", 1.0),
            ("t", 70, 7, "user", "below", 1.0),
            ("t", 8, 99, None, "lost", None),
            ("t", 2, 1, "assistant", "a", 0.0),
            ("u", 1, 1, "user", "self", 1.0),
            (None, 1, None, "user", "none", 1.0),
            ("u", None, None, "user", "none", 1.0),
        ]
        messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
        got = defaultdict(list)
        for r in chat.chosen_paths(messages.select("*", messages.text.alias("depth")), branches=2).collect():
            got[(r["tree"], r["rank"], r["leaf"])].append((r["place"], r["role"], r["text"]))
        assert {k: sorted(v) for k, v in got.items()} == {
            ("t", 1, 4): [(1, "user", "q"), (2, "assistant", "a"), (3, "user", "")],
            ("t", 2, 3): [(1, "user", "q"), (2, "assistant", "a"), (3, "user", "x")],
            ("u", 1, 1): [(1, "user", "self")],
        }

    def test_deep_and_odd_conversations(self, spark):
        rows = [(1, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(100)]
        rows += [(2, 0, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, None, "system", "first"), (None, 0, "user", "nobody")]
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        texts = chat.conversations(chat.chosen_paths(chat.chained(turns)))
        got = {r["tree"]: r for r in chat.digests(texts).collect()}
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in sorted(rows[:100]))
        assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[1]["n_turns"] == 100
        assert got[2]["n_turns"] == 4 and got[-(2**63)]["n_turns"] == 1
        assert chat.conversations(chat.chosen_paths(chat.chained(turns.where("turn > 500")))).count() == 0
