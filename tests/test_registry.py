"""The driver contract and the plans behind it."""

import os
import re
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tagloom.checks.oracle import ORACLE
from tagloom.checks.queries import QUERIES
from tagloom.operators.infer import batch_map
from tools.compare import compare

ROWS_ONLY = {"pca_2d", "kmeans_sweep", "kmeans_sweep_squared", "tfidf_2d", "sweep_by_analyzer", "coreset_sweep", "subword_encode",
             "neighbour_links", "layout_2d"}
FAST = [
    "tag_split", "clean_sentence", "prepare_train", "tag_share_mean", "entity_dictionary", "label_indicators",
    "row_numbering", "stratified_folds", "index_gather", "entity_swap", "encode_ids", "decode_ids", "segment_parse",
    "entity_f1_acc", "bleu_rows", "evaluation_report", "batch_predict", "submission_csv", "text_lines", "noun_csv",
    "tfidf_weights", "silhouette_rows", "silhouette_sq_rows", "silhouette_profile", "label_fold_quotas",
    "label_fold_balance", "value_quantiles", "subword_round_trip", "subword_reserved", "run_notes", "quoted_csv", "top_terms",
    "silhouette_sampled_rows", "entity_counts_long_rows",
]


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert {r.tag for r in entry(spark).collect()} == {"DT", "LC", "OG", "PS", "QT", "TI"}


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, small, name):
    assert compare(spark, small, name).startswith("ok"), compare(spark, small, name)


def plan(spark, small, name):
    return queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in FAST if n != "silhouette_rows"])
def test_no_cross_join(spark, small, name):
    text = plan(spark, small, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["stratified_folds", "entity_dictionary", "row_numbering", "train_valid_split"])
def test_rows_are_numbered_in_partitions(spark, small, name):
    """Only running totals of counts may use a window without partitions."""
    for line in plan(spark, small, name).splitlines():
        hit = re.search(r"\bWindow \[(row_number|sum).*?windowspecdefinition\((.*?)specifiedwindowframe", line)
        if hit and hit.group(1) == "row_number":
            assert "_bucket" in line.split("],")[1]


def test_preparation_and_scoring_do_not_shuffle_rows(spark, small):
    for name in ("prepare_test", "entity_precision", "bleu_rows"):
        exchanges = [x for x in plan(spark, small, name).splitlines() if re.search(r"\bExchange ", x)]
        assert all("REPARTITION_BY_NUM" in x for x in exchanges), exchanges


def test_scans_read_only_needed_columns(spark, small):
    text = plan(spark, small, "tag_counts")
    orders = next(x for x in text.splitlines() if "orders.parquet" in x)
    assert "o_totalprice" not in orders and "PushedFilters: [IsNotNull(o_custkey)]" in orders


def test_batch_map_drops_other_columns(spark):
    frame = spark.createDataFrame([(1, "a", "x")], "row_id long, t string, unused string")
    out = batch_map(frame, lambda pdf: pdf[["row_id"]].assign(n=pdf["t"].str.len()), "row_id long, n long", ["row_id", "t"])
    assert [tuple(r) for r in out.collect()] == [(1, 1)]


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """Run from another folder: workers cannot import the package and must not have to."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from __spark_entry__ import queries\n"
        "from tagloom.session import build_session\n"
        "spark = build_session(master='local[2]', spark__ui__enabled='false', spark__sql__shuffle__partitions='2')\n"
        "d = '/root/testdata/sf0.001'\n"
        "print('RESULT', queries()['batch_predict'](spark, d).count(), queries()['silhouette_mean'](spark, d).count(),\n"
        "      queries()['bleu_stats'](spark, d).first()[0] > 0)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "RESULT 1500 1 True" in done.stdout, done.stderr[-2000:]
