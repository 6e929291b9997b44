"""The state graph with errors and branches, and models behind one interface."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.plans import state_graph
from textloom.sources import models


def test_states(spark):
    rows = [(1, "parse complex trees quickly", None), (2, "the data set", None), (3, "network graphs", "Connection reset"), (4, "network graphs", "no such model"), (5, None, None), (6, "lists and maps", "temporary, twice")]
    df = spark.createDataFrame(rows, "id int, text string, fault string")
    error = F.when((F.col("id") == 6) & (F.col("retry_count") >= 2), None).otherwise(F.col("fault"))
    got = {r.id: r for r in state_graph.keywords(df, error=error).collect()}
    assert len(got) == 6 and got[1].stages_completed == ["generate", "validate", "rank", "consensus"]
    assert [(t.term, t.score, t.models_agreed) for t in got[1].final_terms][0] == ("parse", 1.0, 3)
    assert got[2].stages_completed == ["generate", "validate", "consensus"] and got[2].final_terms == [] and [t.reason for t in got[2].excluded_terms] == ["too generic"] * len(got[2].excluded_terms)
    assert (got[3].retry_count, len(got[3].errors), got[3].stages_completed) == (3, 4, [])
    assert (got[4].retry_count, got[4].errors, got[4].final_terms) == (0, ["no such model"], [])
    assert got[5].final_terms is None or got[5].final_terms == []
    assert (got[6].retry_count, len(got[6].errors), len(got[6].stages_completed)) == (2, 2, 4) and got[6].final_terms
    assert state_graph.keywords(df.where("id > 9")).count() == 0


def test_models_are_loaded_once_a_worker_and_asked_once_a_text(spark, tmp_path):
    log = tmp_path / "log"
    log.touch()

    def load():
        import os

        with log.open("a") as f:
            print("load", os.getpid(), file=f)

        def model(texts):
            with log.open("a") as f:
                for t in texts:
                    print("ask", t, file=f)
            return [[t.upper()] for t in texts]

        return model

    provider = models.Provider("upper", "1", load, "array<string>", batch=2)
    texts = ["a", "b", None, "a", "c", "b"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(6)
    cache = str(tmp_path / "cache")
    for extra in ([], [], ["d"]):
        more = df.unionByName(spark.createDataFrame([(1000, t) for t in extra], "id int, text string")) if extra else df
        got = models.answers(more, "text", provider, "value", cache).collect()
        assert {r.id: r.value for r in got} == {i: None if t is None else [t.upper()] for i, t in [*enumerate(texts), *[(1000, t) for t in extra]]}
    lines = log.read_text().split("\n")
    assert sorted(x for x in lines if x.startswith("ask")) == ["ask a", "ask b", "ask c", "ask d"]
    loads = [x for x in lines if x.startswith("load")]
    assert len(loads) == len(set(loads)) >= 1


@pytest.mark.parametrize("provider", [models.hash_embedder(8), models.word_generator(2, 3), models.pooled_embedder(8)])
def test_offline_providers(spark, provider):
    df = spark.createDataFrame([(1, "alpha beta alpha x"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.value for r in models.answers(df, "text", provider, "value").collect()}
    assert got[3] is None
    if provider.returns == "array<string>":
        assert got[1] == ["alpha", "beta"] and got[2] == []
    else:
        assert sum(x * x for x in got[1]) == pytest.approx(1) and len(got[2]) == 8
