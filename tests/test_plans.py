"""Physical plans: what reaches the scan, and which joins must not appear."""

import os
import re

import pytest
from eventide import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "src_parquet")
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>", text)


@pytest.mark.parametrize("name,columns", [("agg_basic", "o_totalprice:double,o_orderpriority:string"), ("txt_word_count", "doc_id:bigint,text:string"), ("join_semi", "o_orderkey:bigint,o_orderdate:timestamp_ntz"), ("agg_nunique", "user_id:bigint,event_type:string")])
def test_scans_read_only_needed_columns(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


@pytest.mark.parametrize("name", ["join_asof_lt", "join_asof_global", "join_event_window", "join_calendar_window", "join_fold", "win_event_rv_close", "reg_dual_mandate", "txt_novelty_prev", "txt_word_vol_corr", "agg_auc", "vrp_by_regime_nw", "iv_chain_bracket"])
def test_no_theta_join_over_data(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    # nested loops only against broadcast one-row or configuration tables
    for join in re.findall(r"BroadcastNestedLoopJoin[^\n]*", text):
        assert "Cross" in join or "Inner" in join


@pytest.mark.parametrize("name", ["prj_arith", "vol_garman_klass", "opt_black76", "win_ewma", "txt_tfidf", "agg_two_level", "ev_bootstrap_rmse", "sim_event_mc"])
def test_hot_paths_stay_in_the_jvm(spark, name):
    assert not re.search(r"Python|Pandas|Arrow", plan(spark, name))
