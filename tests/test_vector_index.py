"""Searches by tiles and by the inverted file against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbena.contracts import ContractError
from verbena.operators import retrieval
from verbena.operators import vector_index as I

P = I.Params(block_rows=7, tile_queries=8, step_queries=3, first_probes=2, recall_queries=20)
COLUMNS = "subject_id string, subject_kind string, provider string, dim int, embedding array<float>, note int"


def vectors(seed=2):
    """Clusters, copies of one vector, zero vectors, a second width and a null."""
    r = np.random.default_rng(seed)
    centres = 4 * r.standard_normal((5, 6))
    x = [(centres[i % 5] + r.standard_normal(6) / 4).astype(np.float32) for i in range(90)] + [np.ones(6, np.float32)] * 40 + [np.zeros(6, np.float32)] * 2
    rows = [(f"s{i * 37 % 200:03}", "node", "p", 6, [float(v) for v in e], i) for i, e in enumerate(x)]
    return rows + [("w1", "node", "p", 2, [1.0, 2.0], 900), ("w2", "node", "p", 2, [2.0, 1.0], 901), ("none", "node", "p", 6, None, 902)]


def brute(rows, queries, metric, k):
    out = []
    for qid, q in queries:
        scored = []
        for r in rows:
            if r[4] is None or len(r[4]) != len(q):
                continue
            x, y = np.array(r[4], np.float64), np.array(q, np.float64)
            n = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
            cosine = (x * y).sum() / n if n else np.nan
            s = {"cosine": cosine, "cosine_distance": 1 - cosine, "l2": np.sqrt(((x - y) ** 2).sum()), "inner_product": (x * y).sum()}[metric]
            rank = -s if metric in ("l2", "cosine_distance") else s
            rank = (np.inf if metric == "cosine" else -np.inf) if np.isnan(s) else rank
            scored.append((-round(rank, 6), r[0], r[5]))
        out += [(qid, note, k) for k, (_, _, note) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def asked(rows):
    return [(f"q{i}", [float(v) for v in rows[i][4]]) for i in (0, 1, 2, 7, 33, 90, 91)] + [("far", [9.0, -3.0, 0.5, 1.0, 1.0, -2.0])]


@pytest.mark.parametrize("metric", ["cosine", "cosine_distance", "l2", "inner_product"])
def test_tiles_and_index_find_what_all_pairs_give(spark, metric, tmp_path):
    rows = vectors()
    queries = [*asked(rows), ("narrow", [1.0, 1.0])]
    x, q = spark.createDataFrame(rows, COLUMNS).repartition(3), spark.createDataFrame(queries, "query_id string, query array<double>")
    answer = lambda df: sorted((r["query_id"], r["note"], r["rank"]) for r in df.collect())
    want = brute(rows, queries, metric, 5)
    assert answer(I.search_tiles(x.where("embedding IS NOT NULL"), q, metric, 5, P)) == want
    assert answer(retrieval.embedding_search_block(x, q, metric=metric, top_k=5)) == want
    index = I.build(x, 6, metric, str(tmp_path / metric), 5, P)
    assert index.cells.counts.sum() == 132 and index.blocks.select(F.max(F.size("ids"))).first()[0] <= 7
    wide = q.where("query_id <> 'narrow'")
    assert answer(I.search(index, wide, 5, p=P)) == [w for w in want if w[0] != "narrow"]
    some = I.search(index, wide, 5, exact=False, probes=len(index.cells.radii), p=P)
    assert answer(some) == [w for w in want if w[0] != "narrow"]
    with pytest.raises(ContractError, match="width"):
        I.search(index, q, 5, p=P)


def test_many_queries_are_not_broadcast(spark, monkeypatch):
    rows = vectors(3)
    x, q = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(asked(rows), "query_id string, query array<double>")
    few = sorted(map(tuple, retrieval.embedding_search_block(x, q, top_k=3).select("query_id", "note", "rank").collect()))
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_DOUBLES", 0)
    many = retrieval.embedding_search_block(x, q, top_k=3)
    assert sorted(map(tuple, many.select("query_id", "note", "rank").collect())) == few
    assert set(many.columns) == {*x.columns, "query_id", "score", "rank"}


def test_clustered_rows_are_mostly_ruled_out(spark, tmp_path, monkeypatch):
    """In exact mode cells far from a query are never probed."""
    r = np.random.default_rng(5)
    centres = 50 * r.standard_normal((20, 4))
    x = np.concatenate([c + r.standard_normal((50, 4)) / 10 for c in centres])
    rows = spark.createDataFrame([(str(i), "node", "p", 4, [float(v) for v in e], i) for i, e in enumerate(x)], COLUMNS)
    q = rows.where("note % 50 = 0").select(F.col("note").alias("query_id"), F.col("embedding").alias("query"))
    index = I.build(rows, 4, "l2", str(tmp_path / "i"))
    seen, real = [], I.materialize
    monkeypatch.setattr(I, "materialize", lambda df, name: seen.append(real(df, name)) or seen[-1])
    found = I.search(index, q, 10)
    assert found.where("query_id = note").count() == 20 and found.count() == 200
    probed = sum(s.count() for s in seen if s.columns == ["query_no", "query", "cell"])
    assert probed < 0.5 * 20 * len(index.cells.radii)


def test_index_of_nothing(spark, tmp_path):
    index = I.build(spark.createDataFrame([], COLUMNS), 6, "cosine", str(tmp_path / "e"))
    q = spark.createDataFrame([("q", [1.0] * 6)], "query_id string, query array<double>")
    assert I.search(index, q).count() == 0 and I.search_tiles(spark.createDataFrame([], COLUMNS), q, "l2", 3).count() == 0


def test_approximate_mode_reaches_its_recall(spark, tmp_path):
    """On vectors without any clusters, the worst case, for all of a set of queries."""
    r = np.random.default_rng(9)
    rows = spark.createDataFrame([(f"{i:05}", "node", "p", 16, [float(v) for v in e], i) for i, e in enumerate(r.standard_normal((3000, 16)))], COLUMNS)
    q = rows.where("note % 50 = 0").select(F.col("note").alias("query_id"), F.col("embedding").alias("query"))
    index = retrieval.approximate_index(rows, 16, path=str(tmp_path / "i"))
    true = I.search_tiles(rows, q, "cosine", 10).select("query_id", "note")
    hits = I.search(index, q, 10, exact=False).select("query_id", "note").intersect(true).count()
    assert hits >= 0.9 * 600 and index.probes < len(index.cells.radii)
