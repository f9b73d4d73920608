"""Writes in versions: whole or not at all, and no more than what they touch."""

import os

import pytest

from verbena.contracts import ContractError
from verbena.operators.versions import Store, Transaction


def graph_of(spark, *ids):
    nodes = spark.createDataFrame([(i, "f", f"label {i}") for i in ids], "node_id string, family string, label string")
    aliases = nodes.selectExpr("node_id", "label AS alias", "'label' AS alias_kind")
    return nodes, aliases, nodes.selectExpr("node_id AS from_id", "'p' AS predicate", "'root' AS to_id")


def ids(df):
    return sorted(r[0] for r in df.select("node_id").collect())


def size(root, below="data"):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/{below}") for f in fs if f.endswith(".parquet"))


def test_a_write_cut_off_between_relations_changes_nothing(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path), buckets=4)
    assert s.table("nodes").count() == 0 and s.versions() == []
    assert s.write_graph(*graph_of(spark, "a", "b")) == 1
    old = s.table("nodes")
    real, calls = Store._write, []

    def dies(self, relation, *rest):
        calls.append(relation)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(self, relation, *rest)

    with monkeypatch.context() as m:
        m.setattr(Store, "_write", dies)
        for replace in (False, True):
            calls.clear()
            with pytest.raises(RuntimeError, match="lost"):
                s.write_graph(*graph_of(spark, "c"), replace=replace)
            assert calls == ["nodes", "aliases"]
    assert s.versions() == [1] and ids(s.table("nodes")) == ["a", "b"] and s.table("edges").count() == 2
    assert s.write_graph(*graph_of(spark, "b", "c")) == 2
    assert ids(s.table("nodes")) == ["a", "b", "c"] and ids(s.table("aliases")) == ["a", "b", "c"] and ids(s.table("alias_index")) == ["a", "b", "c"]
    assert ids(old) == ids(s.table("nodes", 1)) == ["a", "b"]
    assert s.write_graph(*graph_of(spark, "z"), replace=True) == 3 and ids(s.table("nodes")) == ["z"] and s.table("edges").count() == 1
    s.views("v")
    assert spark.table("v_nodes").count() == 1
    with pytest.raises(ContractError, match="no version 9"):
        s.table("nodes", 9)


def test_contracts_hold_before_anything_is_written(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=4)
    s.write_graph(*graph_of(spark, "a"))
    with pytest.raises(ContractError, match="unique"):
        s.write_graph(spark.createDataFrame([("a", "other")], "node_id string, family string"))
    with pytest.raises(ContractError, match="dim must be non-missing"):
        s.write_embeddings(spark.createDataFrame([("x", "n", "p", None, [1.0])], "subject_id string, subject_kind string, provider string, dim int, embedding array<float>"))
    assert s.versions() == [1]


def test_of_two_writers_the_second_is_refused(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=2)
    first, second = Transaction(s), Transaction(s)
    nodes = graph_of(spark, "a")[0].selectExpr("node_id", "family", "label", "'' AS description", "'' AS attrs", "'' AS trust")
    first.append("nodes", nodes)
    second.append("nodes", nodes)
    assert first.commit() == 1
    with pytest.raises(ContractError, match="someone else"):
        second.commit()
    assert s.table("nodes").count() == 1 and not [n for n in s._names("manifests") if not n.endswith(".json")]


def test_bytes_written_follow_the_replaced_subjects(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=64)
    kinds = "subject_id string, subject_kind string, provider string, dim int, embedding array<float>"
    rows = [(f"s{i}", "node", "p", 8, [float(i * k % 97) for k in range(8)]) for i in range(4000)]
    s.write_embeddings(spark.createDataFrame(rows, kinds))
    s.write_embeddings(spark.createDataFrame(rows[:10], kinds))  # an append repeats subjects
    whole, before = size(tmp_path), s.table("embeddings")
    assert before.count() == 4010
    s.write_embeddings(spark.createDataFrame([("s7", "node", "p", 8, [0.5] * 8)], kinds), replace=True)
    assert size(tmp_path) - whole < whole / 20
    after = s.table("embeddings")
    assert after.count() == 4009 and [list(r[0]) for r in after.where("subject_id = 's7'").select("embedding").collect()] == [[0.5] * 8]
    assert before.where("subject_id = 's7'").count() == 2
    same = before.where("subject_id <> 's7'").exceptAll(after).count()
    assert same == 0
    gone = s.vacuum()
    assert gone and s.versions() == [3] and s.table("embeddings").count() == 4009 and s.vacuum() == []


def test_tokens_and_judgments(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=2)
    t = spark.createDataFrame([("s", "node", "p", w, [v]) for w, v in (("b", 1.0), ("a", 2.0))], "subject_id string, subject_kind string, provider string, token string, embedding array<float>").selectExpr("*", "1 AS dim").coalesce(1)
    s.write_token_embeddings(t)
    assert sorted((r["token_index"], r["token"], r["block_id"]) for r in s.table("token_embeddings").collect()) == [(0, "b", "p|node|s"), (1, "a", "p|node|s")]
    s.record(spark.createDataFrame([("j", "m", "p", "keep")], "judgment_id string, subject_id string, predicate string, decision string"), "judgments")
    assert s.table("judgments").first()["recorded_at"] is not None
