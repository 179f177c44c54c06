"""The driver contract and the intermediate tables."""

import re

import pytest

import __spark_entry__ as entry
from creditweave.sources import workspace
from creditweave.operators import metrics


def test_every_twin_belongs_to_a_query():
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries)
    fitted = {"logistic_fit", "gbt_fit", "tree_contributions", "training_run", "sigmoid_fit"}
    own = {q for q in queries if not re.match(r"op\d+_|pipeline$", q)}
    assert own - set(twins) == fitted


@pytest.mark.parametrize("schema", ["SK_ID_CURR long, target int, probability double, model_version string, split string"])
def test_empty_frames_can_be_stored_and_ranked(spark, schema):
    empty = spark.createDataFrame([], schema)
    kept = workspace.store(empty)
    assert kept.rows == 0 and kept.frame.schema.names == empty.schema.names
    assert metrics.riskiest_first(kept).count() == 0


def test_stored_frames_live_below_the_shared_folder(spark):
    kept = workspace.store(spark.range(3).toDF("id"))
    assert kept.rows == 3
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in path for path in kept.frame.inputFiles())


def test_a_cluster_must_name_the_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Session())


def test_dashboard_export_scores_and_splits_the_mart_once(spark, monkeypatch):
    from workload import model_queries as mq

    calls = []
    for owner, name in ((mq, "scored_mart"), (mq.splits, "stratified_split")):
        real = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, real=real, name=name: calls.append(name) or real(*a))
    exported = entry.queries()["dashboard_export"](spark, entry.SMALL)
    assert exported.count() == 8
    assert sorted(calls) == ["scored_mart", "stratified_split"]


def test_the_mart_joins_the_installments_once(spark, capsys):
    """The digests read a written copy; only the source's own join knows `l_partkey`."""
    entry.queries()["mart_full"](spark, entry.SMALL).explain()
    assert "l_partkey" not in capsys.readouterr().out
