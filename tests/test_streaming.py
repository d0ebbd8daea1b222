"""The registered streaming queries give their batch result over several files and restarts."""

import pytest

from termflow.operators import ontology as onto
from termflow.plans import QUERIES
from termflow.plans import streaming_q as sq
from termflow.sources import fixtures as fx
from termflow.streaming import ingest as st

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    """events and lineitem as folders of four files, in no order of time."""
    for name in ("events", "lineitem"):
        fx.table(spark, SF, name).repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stream_dedupe_over_files(spark, folder):
    got = QUERIES["st1_stream_dedupe"](spark, folder)
    batch = st.dedupe_annotations(st.annotation_rows(fx.table(spark, SF, "events"))).select("entry", "term", "source")
    assert rows(got) == rows(batch)
    assert rows(QUERIES["st1_stream_dedupe"](spark, SF)) == rows(batch)


def test_restart_resumes(spark, folder):
    first = rows(QUERIES["st1_stream_dedupe"](spark, folder))
    extra = fx.table(spark, SF, "events").selectExpr("event_id", "ts", "user_id + 1000000 AS user_id", "event_type", "value", "props")
    extra.union(fx.table(spark, SF, "events")).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    again = rows(QUERIES["st1_stream_dedupe"](spark, folder))
    assert len(again) == 2 * len(first) and set(first) < set(again)


def test_rewritten_folder_starts_afresh(spark, folder):
    """Appended files go on with the job; a folder that is written anew is another input."""
    first = rows(QUERIES["st1_stream_dedupe"](spark, folder))
    job = st.job_name(spark, "st1", folder, "events")
    assert st.job_name(spark, "st1", folder, "events") == job
    few = fx.table(spark, SF, "events").where("user_id % 3 = 0")
    few.selectExpr("event_id", "ts", "user_id + 7000000 AS user_id", "event_type", "value", "props").repartition(3).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    again = rows(QUERIES["st1_stream_dedupe"](spark, folder))
    assert st.job_name(spark, "st1", folder, "events") != job
    assert again and not set(again) & set(first)
    assert rows(QUERIES["st1_stream_dedupe"](spark, folder)) == again


def test_snapshot_compare_over_files(spark, folder):
    old, new = fx.snapshot(spark, SF, fx.OLD_SNAPSHOT), fx.snapshot(spark, SF, fx.NEW_SNAPSHOT)
    want = old.select("entry", "term").distinct().join(new.select("entry", "term").distinct(), ["entry", "term"], "left_anti")
    assert rows(sq.st4_snapshot_compare_batches(spark, folder)) == rows(want)


def test_top_k_scores_rowwise(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, v array<float>")
    out = st.top_k_scores(df, "v", [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], k=2).collect()
    got = {(r.id, r.rank): r.label for r in out}
    assert got == {(1, 1): 0, (1, 2): 2, (2, 1): 1, (2, 2): 2}


def test_many_roots(spark):
    """A DAG may have any number of roots; every entry meets all of them."""
    terms = spark.range(200).selectExpr("id AS term", "0L AS namespace")
    edges = spark.createDataFrame([(199, 0)], "child long, parent long")
    pos = spark.createDataFrame([(1, 0), (2, 5)], "entry long, term long")
    got = onto.ternary_labels(pos, pos, edges, terms, onto.roots(terms, edges))
    assert got.count() == 2 * 199 + 1 and got.where("label = 1").count() == 2


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(12)], "child long, parent long")
    assert onto.closure(edges).df.count() == 13 * 12 // 2
