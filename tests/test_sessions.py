"""The mechanism session as one call, and source links by the set."""

import pytest

from verbena.contracts import ContractError
from verbena.functions.providers import FunctionEmbedding
from verbena.operators import evidence, hypotheses

FIELDS = "provider_id string, release_id string, source_id string, receipt_id string, source_row_id string, field_path string, value string"


def fields(spark, *rows):
    return spark.createDataFrame([("p", "r", s, "rc", f"{s}#{path}", path, v) for s, path, v in rows], FIELDS)


def test_mechanism_session(spark):
    f = fields(
        spark, ("a", "/pathophysiology/0/name", "leak"), ("a", "/pathophysiology/0/description", "calcium leak"), ("a", "/pathophysiology/1/name", "loss"), ("a", "/pathophysiology/1/description", "loss of collagen"),
        ("b", "/pathophysiology/0/name", "gain"), ("b", "/pathophysiology/0/description", "calcium calcium"), ("a", "/pathophysiology/0/evidence/0/reference", "PMID:1"), ("a", "/pathophysiology/0/evidence/0/supports", "SUPPORT"),
        ("a", "/pathophysiology/0/evidence/1/reference", "PMID:2"), ("a", "/pathophysiology/1/evidence/0/reference", "PMID:3"), ("b", "/pathophysiology/0/name/other", "x"),
    )
    asked = []
    provider = FunctionEmbedding("words", lambda ts: asked.append(len(ts)) or [[t.count("calcium"), t.count("collagen")] for t in ts])
    q = spark.createDataFrame([(1, "calcium"), (2, "collagen"), (3, None)], "question_id int, question string")
    found = evidence.mechanism_session(f, q, provider, top_k=2)
    assert sorted((r["question_id"], r["rank"], r["mechanism"], r["score"], r["cited_references"]) for r in found.ranked.collect()) == [("1", 1, "gain", 2.0, 0), ("1", 2, "leak", 1.0, 2), ("2", 1, "loss", 1.0, 1), ("2", 2, "leak", 0.0, 2)]
    assert sorted((r["question_id"], r["reference"], r["supports"]) for r in found.best.collect()) == [("1", "PMID:1", "SUPPORT"), ("1", "PMID:2", None), ("2", "PMID:3", None)]
    empty = evidence.mechanism_session(f.limit(0), q, provider)
    assert empty.ranked.count() == empty.best.count() == 0


def test_source_links_by_the_set(spark):
    f = fields(spark, ("a", "/x", "aaa bb"), ("b", "/x", "other"), ("b", "/y", "  "), ("c", "/z", "whole")).drop("receipt_id")
    kinds = "hypothesis_id string, source_relation string, field_path string, text string, citation string, evidence_role string, source_row_id string"
    rows = [
        ("1", "t", "/x", "bb", "c", "support", "a#/x"), ("2", "t", "/x", "aa", "c", "support", "a#/x"), ("3", "t", "/x", None, "c", "support", None), ("4", "t", "/z", None, "c", "context", None), ("5", "t", "/none", None, "c", "context", None),
        ("6", "t", "/y", None, "c", "context", None), ("7", "t", "/z", "w", "", "context", None), ("8", "t", "/z", "w", "c", "guess", None), ("9", "t", "/z", "", "c", "context", None), (None, "t", "/z", None, "c", "context", None),
    ]
    links = spark.createDataFrame(rows, kinds)
    got = {r["hypothesis_id"]: r for r in hypotheses.resolved_links(links, f).collect()}
    want = {"1": None, "2": "exactly once", "3": "exactly one source field", "4": None, "5": "exactly one source field", "6": "blank", "7": "citation must", "8": "outside its list", "9": "exactly once", None: "hypothesis_id must"}
    assert all((got[k]["reason"] is None) if v is None else v in got[k]["reason"] for k, v in want.items())
    assert (got["1"]["start_offset"], got["1"]["end_offset"], got["1"]["source_span"]) == (4, 6, "bb") and (got["4"]["start_offset"], got["4"]["end_offset"], got["4"]["source_span"]) == (0, 5, "whole")
    one = hypotheses.hypothesis_source("1", f, "t", "/x", "bb", "c", "support", "a#/x").first()
    good = hypotheses.hypothesis_sources(links.where("hypothesis_id = '1'"), f)
    assert good.first() == one and good.columns == list(hypotheses.SOURCE_COLUMNS)
    with pytest.raises(ContractError, match="exactly"):
        hypotheses.hypothesis_sources(links, f)
