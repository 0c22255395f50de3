"""Plan shape guards: the properties the design relies on at scale."""

import io
import re
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(spark, name) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        E.queries()[name](spark, SF).explain("formatted")
    return buf.getvalue()


def shuffles(p: str) -> int:
    return len(re.findall(r"\bExchange\b", p.split("\n\n")[0]))


@pytest.mark.parametrize("name", ["cascade", "score_batch", "html_to_text", "salary_range", "request_json",
                                  "argmax_class", "log_softmax", "verbalise", "url_id"])
def test_row_local_queries_do_not_shuffle(spark, name):
    assert shuffles(plan(spark, name)) == 0


def test_scans_read_only_needed_columns(spark):
    p = plan(spark, "cascade")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in p
    p = plan(spark, "phone_normalise")
    assert "ReadSchema: struct<p_partkey:bigint>" in p


def test_key_range_is_pushed_to_the_scan(spark):
    p = plan(spark, "key_range_scan")
    assert re.search(r"PushedFilters: \[.*GreaterThan\(o_orderkey,\d+\).*LessThanOrEqual\(o_orderkey,\d+\)", p)


def test_metrics_combine_before_the_shuffle(spark):
    p = plan(spark, "cls_metrics")
    assert "partial_count" in p


def test_numbering_broadcasts_only_the_offsets(spark):
    p = plan(spark, "trigger_batches")
    assert "BroadcastExchange" in p and "Window" in p
    # the only unpartitioned windows run over the offsets (one row per partition)
    assert "Scan ExistingRDD" in p
