"""Physical-plan checks: pruned scans, no cartesian products in the hot queries."""

import pytest

from horosphere.plans import catalog as CAT
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_block_stats_reads_only_needed_columns(spark):
    p = plan(CAT.q_block_stats(spark, SF["0.01"]))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in p \
        or "event_id:bigint,ts:timestamp_ntz,event_type:string" in p
    assert "props" not in p and "user_id" not in p
    # texts are read for their null test only and go no further than the scan
    assert "IsNotNull(text)" in p or "isnotnull(text" in p
    exchanged = [x for x in p.splitlines() if "Exchange" in x]
    assert exchanged and not any("text#" in x for x in exchanged)


PLANNED = ["scores_all", "label_encode", "split_70_20_10", "time_features", "hashed_embed", "block_assign",
           "word_vector_mean", "cache_apply", "cache_misses", "prompt_build", "summary_defaults"]


@pytest.mark.parametrize("name", PLANNED)
def test_no_products_of_tables(spark, name):
    """No cartesian product; nested-loop joins only with a one-row aggregate on one side."""
    p = plan(CAT.queries()[name](spark, SF["0.01"]))
    assert "CartesianProduct" not in p
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastNestedLoopJoin" in line and "LeftOuter" not in line:
            inside = "\n".join(lines[i + 1:])
            assert "HashAggregate(keys=[]" in inside, line


def test_top_k_does_not_sort_a_whole_group(spark):
    keys = CAT.block_keys(spark, SF["0.01"])
    top = CAT.top_k_per_group(keys, ["block_id"], ["created_at", "msg_id"], CAT.block_k(keys))
    p = plan(top)
    # both rank filters act before their shuffle, and the first one ranks parts of a group
    assert p.count("WindowGroupLimit") >= 3 and "_salt" in p
    want = keys.toPandas().sort_values(["created_at", "msg_id"]).groupby("block_id").msg_id.apply(
        lambda x: list(x))
    k = {r.block_id: r.k for r in CAT.block_k(keys).collect()}
    got = top.toPandas().sort_values("cluster").groupby("block_id").msg_id.apply(list)
    assert all(got[b] == want[b][:k[b]] for b in k)


def test_features_of_a_split_do_not_read_text(spark):
    p = plan(CAT.queries()["split_70_20_10"](spark, SF["0.01"]))
    assert "text:string" not in p or "isnotnull(text" in p
