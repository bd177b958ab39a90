"""What queries leave on disk: copies go as soon as nothing reads them, shuffle files when a query ends."""

import os
import time

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from checks.model_queries import CHECK
from conftest import AS_OF, FOLDER
from tallyhouse.operators import requests
from tallyhouse.plans import analysis, training
from tallyhouse.session import kept, materialize, new_path, released, shared_folder


def copies(spark):
    folder = f"{shared_folder(spark).removeprefix('file:')}/tallyhouse"
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


def labels(names):
    return sorted(name.rsplit("-", 1)[0] for name in names)


@pytest.mark.parametrize("name, left", [
    ("T3_match_terms_by_join", {"matched"}),
    ("T7_scenarios_dashboard", {"matched", "per-key", "grouped-medians"}),
    ("T8_score_scenarios", {"matched", "per-key", "grouped-medians"}),
    ("T8_score_baseline", {"matched", "per-key", "grouped-medians"}),
    ("T8_prediction_answers", {"matched", "per-key", "grouped-medians"}),
    ("T9_answers", {"book", "topics", "per-key"}),
    ("T9_answers_notebook", {"book", "topics", "per-key"}),
    ("IO8_clean_again", {"distinct-rows"}),
    ("P1_quality_summary", {"dirty", "repeated"}),
    ("M6_forest_scores", {"features"}),
])
def test_only_what_the_result_reads_stays(spark, name, left):
    before = copies(spark)
    result = queries()[name](spark, FOLDER)
    found = labels(copies(spark) - before)
    assert set(found) == left and len(found) == len(left)
    assert result.count() > 0  # which the copies that stay are enough for


def test_training_keeps_the_frame_alone(spark, fact):
    before = copies(spark)
    result = training.train(fact, AS_OF, CHECK)
    assert labels(copies(spark) - before) == ["metrics", "model-frame"]
    assert result.train.count() + result.test.count() == fact.count() and result.test.count() > 0
    assert result.leaderboard.count() == 3


def test_a_hand_off_takes_the_place_of_the_distinct_rows(spark, dirty):
    before = copies(spark)
    artifacts = analysis.analyze(dirty, AS_OF)
    found = labels(copies(spark) - before)
    assert "clean" in found and "distinct-rows" not in found and "medians" not in found
    assert artifacts.prepared.cleaned.count() == artifacts.clean.count() == artifacts.prepared.counted.distinct


def test_lookup_tables_outlive_the_frame(spark, fact):
    before = copies(spark)
    _, context = training.manual_analysis(fact, AS_OF, new_path(spark, "hand-off"))
    assert "model-frame" not in labels(copies(spark) - before)
    assert all(table.count() > 0 for table in context.values())


def test_kept_copies_belong_to_the_block_around(spark):
    before = copies(spark)
    with released(spark):
        with released(spark):
            materialize(spark.range(1), "inner")
            with kept():
                materialize(spark.range(1), "outer")
        assert labels(copies(spark) - before) == ["outer"]
    assert copies(spark) == before


def test_shuffle_files_go_with_their_query(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {str(f) for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = shuffled()
    rows = spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string"))).repartition(4, "h")
    assert materialize(rows, "shuffled").count() == 1000
    for _ in range(50):  # they are deleted in the background
        if not shuffled() - before:
            return
        time.sleep(0.2)
    assert not shuffled() - before


def test_one_automaton_for_all_roles(spark, monkeypatch):
    """Texts are folded over once; a term may be of several roles, a role without terms finds nothing."""
    made, make = [], requests.term_automaton
    monkeypatch.setattr(requests, "term_automaton", lambda *a, **k: made.append(1) or make(*a, **k))
    known = {"product": ["Blue Ring", "ring", "Blue", None], "category": ["RING", "blue", "Large"], "region": []}
    texts = ["a blue ring", "RINGS of blue", "large", "bl ue", "", None, "Blue  Ring large"]
    messages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id int, text string")
    words = {c: spark.createDataFrame([(t,) for t in v], "term string") for c, v in known.items()}
    got = {r["msg_id"]: r for r in requests.match_known(messages, words, -1).collect()}
    assert len(made) == 1
    for i, text in enumerate(texts):
        for role, terms in known.items():
            hits = [t for t in terms if t and text and t.lower() in text.lower()]
            assert got[i][role] == min(hits, key=lambda t: (-len(t), t), default=None), (text, role)


def test_many_anchors_come_in_passes(spark, monkeypatch):
    """More anchors than one broadcast holds: still no position travels that starts no term."""
    written, write = [], requests.materialize

    def counted(df, label):
        if label == "starts":
            assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()
        out = write(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(requests, "BROADCAST_TERMS", 28)
    monkeypatch.setattr(requests, "BROADCAST_ANCHORS", 7)
    monkeypatch.setattr(requests, "materialize", counted)
    terms = [f"{i:02d} many terms" for i in range(30)]
    texts = {1: "ab 07 MANY TERMS", 2: "07 many term", 3: "29 many terms, 03 many terms", 4: "zzz"}
    vocab = spark.createDataFrame([(t,) for t in terms], "term string")
    messages = spark.createDataFrame(list(texts.items()), "msg_id long, text string")
    got = {r["msg_id"]: r["term"] for r in requests.match_terms(messages, vocab, "term", 0).collect()}
    assert got == {1: terms[7], 2: None, 3: terms[3], 4: None}
    starts = [n for label, n in written if label == "starts"]
    assert len(starts) == 5 and sum(starts) == 4
