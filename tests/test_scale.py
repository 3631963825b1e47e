"""What leaves a task at once, how work is dealt out and what is shuffled stay bounded as tables grow."""

import json
import random
from dataclasses import replace
from itertools import pairwise

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from kanasift import engine as E
from kanasift import functions as K
from kanasift import queries, sample
from kanasift.engine import Engine
from kanasift.operators import analyze as core

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "a", "abあ1é 😀", "…", "a-b あア漢" * 60, "x" * 400, "\n"]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, sample.parts({"pathRewritePlugin": []}))


class Direct:
    """Stands for a table of doc_id and text, and gives the function that tasks would run."""

    schema = T.StructType([T.StructField("doc_id", T.LongType())])
    columns = ["doc_id", "text"]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, out):
        return run


def batches(make, texts):
    return list(make(Direct())(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})])))


def test_rows_with_many_values_leave_in_small_batches(engine, monkeypatch):
    monkeypatch.setattr(E, "VALUES", 5000)
    texts = [f"{k} " + "ab 京都" * 200 for k in range(40)]
    out = batches(lambda d: engine.normalize(d), texts)
    assert sum(b.num_rows for b in out) == 40 and max(b.num_rows for b in out) <= 2
    assert [x for b in out for x in b.column("modified").to_pylist()] == texts
    assert max(b.num_rows for b in batches(lambda d: engine.lattice(d), ["東京都に行った" + str(k) for k in range(40)])) <= 3


def test_figures_of_texts_equal_their_arrays(engine, spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in engine.normalize(df).collect()}
    assert all(len(r["cats"]) == len(r["can_bow"]) == len(r["mod2orig"]) - 1 == len(r["modified"]) for r in rows.values())
    got = engine.normalize(df, columns=["n_bow"])
    assert {r["doc_id"]: r["n_bow"] for r in got.collect()} == {k: sum(r["can_bow"]) for k, r in rows.items()}
    got = engine.normalize(df, columns=["n_runs"])
    runs = lambda c: sum(not a & b for a, b in pairwise(c)) + bool(c)
    assert {r["doc_id"]: r["n_runs"] for r in got.collect()} == {k: runs(r["cats"]) for k, r in rows.items()}
    for q in (queries.bow_positions, queries.category_runs):
        plan = q(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "can_bow" not in plan and "cats" not in plan


@pytest.mark.parametrize("kind", ["plain", "numbers", "katakana", "runs"])
def test_figures_of_lattices_equal_their_json(spark, kind):
    texts = [None, "", "東京都に行った", "二三に東京都", "カカカアイに12,000", "東" * 200 + "x" * 200, "ab cd " * 80]
    # The templates of this kind are for Latin letters only.
    texts = [t for t in texts if kind != "runs" or not t or t.isascii()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    e = queries.engine(spark, kind)
    rows = {r["doc_id"]: r for r in e.lattice(df, columns=["n_nodes", "lattice", "n_best"]).collect()}
    whole = {r["doc_id"]: json.loads(r["lattice"]) for r in e.lattice(df).collect()}
    assert {k: (r["n_nodes"], r["n_best"], json.loads(r["lattice"])) for k, r in rows.items()} == {k: (len(x["lattice"]), len(x["bestPath"]), x) for k, x in whole.items()}
    alone = {r["doc_id"]: (r["n_nodes"], r["n_best"]) for r in e.lattice(df, columns=["n_nodes", "n_best"]).collect()}
    assert alone == {k: (r["n_nodes"], r["n_best"]) for k, r in rows.items()}


def test_tasks_are_as_many_as_the_table_asks_for(spark, monkeypatch):
    few = queries.lattice_nodes(spark, DATA).rdd.getNumPartitions()
    monkeypatch.setattr(queries, "SHARE", 1000)
    many = queries.lattice_nodes(spark, DATA)
    assert few == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() > 30
    assert many.count() == spark.read.parquet(f"{DATA}/orders.parquet").count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_matches_move_no_texts(spark, monkeypatch):
    few = queries.lexicon_prefix_matches(spark, DATA)
    assert "SortMergeJoin" not in plan(few) and plan(few).count("BroadcastHashJoin") == 2
    monkeypatch.setattr(K, "SENT", 5)
    large = queries.lexicon_prefix_matches(spark, DATA)
    assert plan(large).count("BroadcastHashJoin") == 1 and few.exceptAll(large).count() == large.exceptAll(few).count() == 0
    none = spark.createDataFrame([(1, None, 0)], "word_no int, headword string, left_id int")
    assert K.prefix_matches(spark.createDataFrame([(1, "東京")], "doc_id long, text string"), none).count() == 0


def test_stored_tokens_are_as_narrow_as_what_is_made_of_them(spark):
    for q in (queries.format_tokens, queries.wakati):
        made = plan(q(spark, DATA)).split("MapInArrow")[1].split("\n")[0]
        assert "surface" in made and not any(c in made for c in ("begin_cp", "word_id", "mode", "sent_begin"))
    # Half a MB of keys are a task's, so what it sorts by sentence fits its memory.
    assert queries.SHARE <= 1 << 19


def test_sentences_without_their_figures_equal_whole_ones(engine, spark):
    words = ["な。な", "。", "東京都", "に行った", "京都（東。", "）", "…", "！？", "a.b", "か\n", "😀", "㈱", "徳島（とく）に", "「あ。」と"]
    rng = random.Random(5)
    rows = [(k, "".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(300)] + [(300, "東京。" * 700), (301, None), (302, "あ" * 5000 + "。" + "い" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = engine.sentences(df).select("doc_id", "original", "sent_id", "sent_begin").collect()
    made = engine.sentences(df, columns=["original", "sent_id", "sent_begin"]).collect()
    assert sorted(map(str, whole)) == sorted(map(str, made)) and len(made) > 1000


def test_words_across_ends_are_those_of_all_prefixes(engine):
    parts, rng = engine.parts, random.Random(6)
    looked = []

    class Slow(dict):
        def get(self, *a):
            looked.append(a)
            return super().get(*a)

    letters = "".join(sorted(parts.lookup.starts)) + "。a😀é"
    for _ in range(400):
        text = "".join(rng.choices(letters, k=rng.randint(1, 40)))
        begin = rng.randrange(len(text))
        crossed, end = core._crossing(parts, text, begin), rng.randint(begin, len(text))
        want = any(len(text[k:end].encode()) <= 64 and any(stop > end or stop == end and end - k > 1 for stop, _ in parts.lookup.prefixes(text, k)) for k in range(end))
        assert crossed(end - begin) == want
    # A long text's end is looked at as far back as a headword goes, not 64 bytes.
    parts = replace(parts, lookup=replace(parts.lookup, reach=Slow(parts.lookup.reach)))
    core._crossing(parts, "ん" * 1000, 0)(1000)
    assert len(looked) == parts.lookup.longest < 21


def test_table_function_makes_only_columns_asked_for(engine, spark):
    spark.createDataFrame([(1, "東京都に行った。京都"), (2, None), (3, "")], "doc_id long, text string").createOrReplaceTempView("docs_of_scale")
    engine.register("analyze_all")
    engine.register("analyze_some", columns=["tok_id", "synonym_group_ids", "end"])
    sql = "select d.doc_id, t.* from docs_of_scale d, lateral {}(d.text, 'C') t"
    whole, some = spark.sql(sql.format("analyze_all")), spark.sql(sql.format("analyze_some"))
    assert whole.columns == ["doc_id", *(c for c in E.TOKENS if c != "mode")] and some.columns == ["doc_id", "tok_id", "synonym_group_ids", "end"]
    assert some.collect() == whole.select(*some.columns).collect() and some.count() == 6
    assert "reading_form" not in plan(queries.analyze_in_sql(spark, DATA))


def test_resplit_moves_tokens_once_and_only_to_their_sentences(spark, monkeypatch):
    few = queries.resplit_stored_tokens(spark, DATA)
    assert "SortMergeJoin" not in plan(few) and plan(few).count("Exchange hashpartitioning(doc_id") == 1 and plan(few).count("Window [") == 1
    made = plan(few).split("MapInArrow")[1].split("\n")[0]
    assert "pos_id" in made and "begin_cp" not in made and "synonym_group_ids" not in made
    monkeypatch.setattr(E, "SENT", 0)
    large = queries.resplit_stored_tokens(spark, DATA)
    assert few.count() == large.count() and few.exceptAll(large).count() == 0
