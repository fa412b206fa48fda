"""Plans of the registered queries: no pair joins, no row-at-a-time Python, pushed filters."""

import contextlib
import io

import pytest

from threadlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
BATCH = sorted(k for k in QUERIES if not k.startswith("stream_") and k != "dead_letter")
# Python on purpose: the embedder, kNN products, signatures, the needles' automaton, state machines.
ARROW = {"hash_embed", "vector_knn", "vector_knn_bounded", "vector_knn_recall", "vector_leg",
         "rrf_fusion", "hybrid_search", "hybrid_search_documents", "rerank_overlap",
         "pack_to_budget", "build_context", "map_citations", "eval_retrieval", "eval_compare",
         "text_contains", "text_contains_short", "anchor_join", "rate_limit", "rate_limit_split",
         "breaker_windows", "breaker_windows_split"}


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("key", BATCH)
def test_no_pair_joins_and_no_row_python(spark, key):
    text = plan(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if key not in ARROW:
        assert "Python" not in text and "InPandas" not in text and "InArrow" not in text


def test_extract_reaches_the_scan(spark):
    text = plan(QUERIES["incremental_extract"](spark, SF))
    assert "GreaterThan(l_shipdate" in text and "ReadSchema: struct<l_shipdate" in text


def test_flagship_reads_few_columns_and_cuts_early(spark):
    text = plan(QUERIES["q_active_rooms"](spark, SF))
    assert "WindowGroupLimit" in text and "TakeOrderedAndProject" in text
    assert "value:double" not in text


def test_search_reads_the_stored_index_and_embeds_no_corpus(spark):
    """The lexical leg scans postings of the wanted tokens; vectors come from the stored points."""
    text = plan(QUERIES["lexical_leg"](spark, SF))
    assert "postings" in text and "conversations.parquet" not in text
    text = plan(QUERIES["vector_leg"](spark, SF))
    assert "conversations.parquet" not in text and "documents.parquet" not in text


def test_packing_searches_once_and_hits_pick_the_texts(spark):
    """The list is stored before it is read twice; the fused list before the texts are joined."""
    text = plan(QUERIES["pack_to_budget"](spark, SF))
    assert "FlatMapCoGroups" not in text and "postings" not in text
    text = plan(QUERIES["hybrid_search"](spark, SF))
    assert "FlatMapCoGroups" not in text and "LeftSemi" in text
