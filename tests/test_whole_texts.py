"""Queries without an SQL twin read whole texts: what stands far behind a text's beginning counts."""

import pytest

from textloom.functions import edits, guard
from textloom.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two turns that are alike in their first 300 characters and differ behind."""
    at = str(tmp_path_factory.mktemp("turns"))
    head = "same words here " * 20
    rows = [(1, 0, "user", head + "seven 7 apples"), (1, 1, "user", head + "some 8 pears and plums")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at, [r[3] for r in rows]


def _rows(spark, name, folder):
    return {int(r.turn if "turn" in r else r.revision_no): r for r in QUERIES[name](spark, folder).collect()}


def test_alignment_of_whole_turns(spark, folder):
    at, (a, b) = folder
    got = _rows(spark, "f7_align_and_apply", at)[0]
    assert (got.n_edits, got.rebuilt) == (len(edits.align(a, b)), True) and got.n_edits > 0


def test_word_distance_of_whole_turns(spark, folder):
    at, (a, b) = folder
    got = _rows(spark, "f1_word_edit_distance", at)[0]
    assert (got.errors, got.units) == (edits.distance(a.split(), b.split()), len(a.split()))


def test_vetoes_on_whole_turns(spark, folder):
    at, texts = folder
    got = _rows(spark, "f18_reject_reasons", at)
    assert [got[i].reasons for i in (0, 1)] == [guard.reject_reasons(t, t[: len(t) // 2]) for t in texts]
    assert "numeric_value_mismatch" in got[0].reasons


def test_stability_of_whole_hypotheses(spark, folder):
    at, texts = folder
    got = _rows(spark, "t2_hypothesis_stability", at)
    assert [got[i].text for i in (0, 1)] == texts
