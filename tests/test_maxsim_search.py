"""Late interaction by bounds against all blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbena.operators import maxsim_search as M
from verbena.operators import retrieval

ROWS = "provider string, subject_kind string, subject_id string, block_id string, dim int, token_index int, token string, embedding array<float>"
P = M.Params(sketch_bytes=60, tile_tokens=5)


def blocks(seed=4, n=40, dim=6):
    """Blocks of 1 to 8 tokens, one of 90, two that are equal, and one of another width."""
    r = np.random.default_rng(seed)
    sizes = {f"b{i:02}": (int(r.integers(1, 9)) if i else 90) for i in range(n)}
    rows = [("p", "k", b, b, dim, t, f"{b}.{t}", [float(v) for v in r.standard_normal(dim).astype(np.float32)]) for b, m in sizes.items() for t in range(m)]
    rows += [(*x[:2], "b99", "b99", *x[4:]) for x in rows if x[2] == "b05"]
    return rows + [("p", "k", "w", "w", 2, 0, "w", [1.0, 2.0])]


def asked(rows, seed=6, dim=6):
    r = np.random.default_rng(seed)
    return [(f"q{i}", t, [float(v) for v in (rows[100 + 3 * i][7] if t == 0 else r.standard_normal(dim))]) for i in range(7) for t in range(1 + i % 3)] + [("narrow", 0, [1.0, 0.0])]


def brute(rows, queries, k):
    out, unit = [], lambda v: np.array(v, np.float64) / np.sqrt((np.array(v, np.float64) ** 2).sum())
    for qid in {q[0] for q in queries}:
        own = [unit(x) for i, _, x in sorted(queries, key=lambda q: q[1]) if i == qid]
        found = []
        for b in {r[3] for r in rows if r[4] == len(own[0])}:
            tokens = sorted((r for r in rows if r[3] == b), key=lambda r: r[5])
            s = np.array([[float(q @ unit(t[7])) for t in tokens] for q in own])
            best = s.argmax(1)
            found.append((-round(s.max(1).sum(), 9), b, len(tokens), ",".join(str(tokens[i][5]) for i in best), "".join(tokens[i][6] for i in best), round(s.max(1).mean(), 6)))
        out += [(qid, *f[1:], rank) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("p", [P, M.Params()])
def test_bounds_lose_no_block(spark, p):
    rows = blocks()
    queries = asked(rows)
    x, q = spark.createDataFrame(rows, ROWS).repartition(5), spark.createDataFrame(queries, "query_id string, query_token int, query array<double>")
    cols = ["query_id", "block_id", "candidate_token_count", "best_token_index", "best_token", F.round("score_mean", 6), "rank"]
    want = brute(rows, queries, 4)
    assert sorted(map(tuple, M.search(x, q, 4, p).select(*cols).collect())) == want
    assert sorted(map(tuple, retrieval.late_interaction_search_block(x, q, top_k=4).select(*cols).collect())) == want


def test_few_blocks_are_scored(spark):
    """On vectors without any structure, the worst case for bounds by cells."""
    r = np.random.default_rng(1)
    rows = [("p", "k", f"{i // 8}", f"{i // 8}", 32, i % 8, "t", [float(v) for v in e]) for i, e in enumerate(r.standard_normal((4000, 32)))]
    x = spark.createDataFrame(rows, ROWS)
    q = spark.createDataFrame([(f"q{i}", t, [float(v) for v in r.standard_normal(32)]) for i in range(20) for t in range(3)], "query_id string, query_token int, query array<double>")
    _, _, pairs = M.pairs_left(x, q, 10)
    assert 200 <= pairs.count() < 0.1 * 20 * 500


def test_large_query_sets_go_by_bounds(spark, monkeypatch):
    rows = blocks(8, 12)
    x, q = spark.createDataFrame(rows, ROWS), spark.createDataFrame(asked(rows)[:4], "query_id string, query_token int, query array<double>")
    few = retrieval.late_interaction_search_block(x, q, top_k=2)
    monkeypatch.setattr(retrieval, "MAX_BROADCAST_DOUBLES", 0)
    many = retrieval.late_interaction_search_block(x, q, top_k=2)
    assert many.columns == few.columns
    same = lambda df: sorted(map(tuple, df.withColumn("score", F.round("score", 9)).select("query_id", "block_id", "score", "best_token").collect()))
    assert same(many) == same(few)
    with pytest.raises(Exception, match="non-zero norm"):
        retrieval.late_interaction_search_block(x.withColumn("embedding", F.transform("embedding", lambda v: v * 0)), q).collect()
