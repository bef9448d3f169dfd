import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bindings.tables import QUESTIONS
from faregrid.functions import text as tx
from faregrid.operators import retrieval, tagging
from faregrid.params import Params
from faregrid.storage import staged


def expected_spans(lines, size, overlap):
    """Spans by prefix sums: where a chunk ends follows from where it starts."""
    total = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    spans, first, seen = [], 0, 0
    while True:
        stop = next((i for i in range(max(seen, first + 1), len(lines)) if total[i + 1] - total[first] > size), None)
        if stop is None:
            return spans + [(first, len(lines))]
        spans.append((first, stop))
        back = [k for k in range(first, stop) if total[stop] - total[k] >= overlap]
        first, seen = (max(back) if back else first), stop + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=14), min_size=1, max_size=25), st.integers(1, 40), st.integers(1, 30))
def test_spans_equal_prefix_sums(lines, size, overlap):
    spans = tx.chunk_spans(lines, size, overlap)
    assert spans == expected_spans(lines, size, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(lines)
    for (_, stop), (first, _) in zip(spans, spans[1:]):
        assert first <= stop


def test_many_blank_lines_stay_cheap():
    lines = ("\n" * 20_000 + "a" * 100 + "\n" * 20_000 + "b" * 600).split("\n")
    assert tx.chunk_spans(lines, 600, 150) == [(0, 40_000), (0, 40_001)]


def test_chunks_keep_the_key_type(spark):
    df = spark.createDataFrame([("k", "aa\nbb")], "key string, text string")
    got = retrieval.chunk_documents(df, "key").first()
    assert tuple(got) == ("k", 0, 0, 2, "aa\nbb")


def test_chunks_of_a_long_line_and_of_no_text(spark):
    df = spark.createDataFrame([(1, "x" * 5000), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_no): len(r.chunk_text) for r in retrieval.chunk_documents(df).collect()}
    assert got == {(1, 0): 5000, (2, 0): 0}


def test_clean_chunks(spark):
    rows = [(1, 0, " 　\n```python\n" + "a" * 60 + "```\x85"), (1, 1, "``` short ```")]
    df = spark.createDataFrame(rows, "doc_id long, chunk_no int, chunk_text string")
    got = retrieval.clean_chunks(df).collect()
    assert [r.chunk_text for r in got] == ["python\n" + "a" * 60]


def test_action_lines(spark):
    rows = [("Step\n  RECOMMENDED: lower prices \nnothing",), ("nothing\nhere",)]
    df = spark.createDataFrame(rows, "text string")
    got = [r[0] for r in df.select(tx.action_lines(F.col("text"))).collect()]
    assert got == [["RECOMMENDED: lower prices"], list(tx.DEFAULT_LINES)]


@pytest.mark.parametrize(("block", "sent"), [(256, 1 << 20), (2, 1 << 20), (2, 0)])
def test_top_similar_against_numpy(spark, monkeypatch, block, sent):
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", block)
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", sent)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 8))
    base[400:] = base[17]  # many copies of one vector
    asked = np.concatenate([rng.normal(size=(6, 8)), base[17:18]])
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
    got = retrieval.top_similar(b.repartition(5), q, 3).orderBy("query_id", "rank").collect()
    scores = np.round(asked @ base.T, 9)
    want = [(i, int(j)) for i in range(7) for j in np.lexsort((np.arange(500), -scores[i]))[:3]]
    assert [(r.query_id, r.base_id) for r in got] == want


def test_top_similar_of_nothing(spark):
    b = spark.createDataFrame([], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert retrieval.top_similar(b, q).count() == 0
    assert retrieval.top_similar(q.withColumnRenamed("query_id", "vec_id"), q.where("false")).count() == 0


def test_failed_embeddings_score_zero(spark):
    rows = [(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fixed = retrieval.repair_vectors(df, 2)
    got = {r.vec_id: r.embedding for r in fixed.collect()}
    assert got == {1: [3.0, 4.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [0.0, 0.0]}


def test_context_in_rank_order(spark):
    df = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_id long, rank int, chunk_text string")
    assert retrieval.assemble_context(df).first().context == (
        "RELEVANT DOCUMENTATION:\n\n[Source 1]\nfirst\n\n[Source 2]\nsecond"
    )


# question, intent, hour, weekday, part of the day
TAGS = [
    ("Name the zones with the highest revenue", "top_revenue", None, None, None),
    ("Tell me the average margin of profit", "general", None, None, None),
    ("Which zones need our focus and improvement?", "improvement", None, None, None),
    ("Compare zones 3 and 4", "compare", None, None, None),
    ("Compare zones 3 and 99", "general", None, None, None),
    ("Compare zone 3 and zone 99", "unknown_zone", None, None, None),
    ("Zones of the lowest demand, please", "bottom_demand", None, None, None),
    ("Lowest performance?", "bottom_revenue", None, None, None),
    ("Best place to improve", "general", None, None, None),
    ("Where to deploy cars at 12 am on Monday?", "deployment", 0, 0, None),
    ("most rides at 12pm sunday evening", "peak_cell", 12, 6, None),
    ("top revenue at 5pm", "general", 17, None, None),
    ("hour 7 please", "general", 7, None, None),
    ("19:00 tonight", "general", 19, None, None),
    ("Should we do a fare increase at night?", "price_increase", None, None, "night"),
]


def test_question_tags(spark):
    known = spark.createDataFrame([(3,), (4,), (237,)], "cluster_id int")
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(TAGS)], "i int, text string")
    got = tagging.tag_questions(df, known).orderBy("i").collect()
    for row, (_, intent, hour, weekday, part) in zip(got, TAGS):
        assert (row.text, row.intent) == (row.text, intent)
        assert (row.asked_hour, row.asked_weekday, row.asked_day_part) == (hour, weekday, part), row.text
    assert got[3].named_zones == []  # the plural form is not seen
    assert got[5].named_zones == [3, 99]
    assert (got[1].wants_overall, got[1].wants_margin) == (1, 1)


def test_lookup_zone(spark):
    known = spark.createDataFrame([(7,)], "cluster_id int")
    df = spark.createDataFrame([("Zone 7 profit?",), ("which zone 7?",), ("zone 99999999999999999999",)], "text string")
    got = tagging.tag_questions(df, known).collect()
    assert [r.lookup_zone for r in got] == [7, None, None]
    assert got[2].intent == "unknown_zone"


def test_chunk_parameters(spark):
    df = spark.createDataFrame([(1, "aaaa\nbbbb\ncccc")], "doc_id long, text string")
    got = retrieval.chunk_documents(df, p=Params(chunk_size=8, chunk_overlap=4)).orderBy("chunk_no").collect()
    assert [r.chunk_text for r in got] == ["aaaa\nbbbb", "bbbb\ncccc"]


def test_every_question_template_is_distinct():
    assert len(set(QUESTIONS)) == len(QUESTIONS)


def test_chunks_are_numbered_in_order(spark):
    rows = [(d, c, f"t{d}-{c}") for d in (9000, 3, 5, 12) for c in (4, 0, 2)][::-1]
    df = spark.createDataFrame(rows, "doc_id long, chunk_no int, chunk_text string")
    got = {r.chunk_text: r.number for r in retrieval.numbered_chunks(df).collect()}
    assert got == {text: i for i, (_, _, text) in enumerate(sorted(rows))}


def test_context_keeps_ranks_without_a_text(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c")], "query_id long, rank int, chunk_text string")
    text = retrieval.assemble_context(ranked).first().context
    assert [line for line in text.split("\n") if line.startswith("[Source")] == ["[Source 1]", "[Source 2]", "[Source 3]"]


def test_tiles_copy_each_side_by_the_other_sides_tiles(spark):
    assert retrieval.tile_grid(1, 1) == (1, 1)
    rows, columns = retrieval.tile_grid(10 * retrieval.TILE_BYTES, 40 * retrieval.TILE_BYTES)
    assert (rows, columns) == (10, 40)  # 400 tiles; 10 * 40 + 40 * 10 tile sides are shuffled
    vectors = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
    across, down = retrieval.tiled(vectors.where("id < 500"), vectors, 3, 4)
    assert (across.count(), down.count()) == (500 * 4, 3000 * 3)
    met = across.alias("a").join(down.alias("b"), ["row", "column"]).groupBy("a.id", "b.id").count()
    assert met.count() == 500 * 3000 and met.agg(F.max("count")).first()[0] == 1


def test_tiles_give_what_blocks_give(spark, monkeypatch):
    base = spark.range(700).select(F.col("id").alias("vec_id"), F.array(*(F.round(F.rand(i), 1) for i in range(4))).alias("embedding"))
    base = staged(base, "tile-base")
    asked = base.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, retrieval.top_similar(base, asked, 5).collect()))
    for name, value in (("BROADCAST_BYTES", 0), ("TILE_BYTES", 2000), ("PRODUCT", 500)):
        monkeypatch.setattr(retrieval, name, value)
    assert sorted(map(tuple, retrieval.top_similar(base, asked, 5).collect())) == want
