"""Searches where many rows or queries have equal vectors: the same answers, from distinct texts and vectors alone."""

import random
from dataclasses import replace

from test_sessions import FIELDS

from verbena.functions.providers import FunctionEmbedding
from verbena.operators import evidence, retrieval


def test_session_embeds_each_description_once(spark, monkeypatch):
    def letters(texts):
        assert len(texts) == len(set(texts)), "a text is embedded twice"
        return [[t.count("a"), t.count("b"), t.count("c")] for t in texts]

    rng = random.Random(7)
    rows, entries = [], []
    for n in range(240):
        source, at, text = f"s{n // 4}", f"/pathophysiology/{n % 4}", rng.choice(("ab", "ba", "aab", "c", "bcc", "abc"))
        path, key = f"{at}/description", f"s{n // 4}#{at}/description"
        rows += [("p", "r", source, "rc", f"{source}#{at}/name", f"{at}/name", f"name {n}"), ("p", "r", source, "rc", key, path, text)]
        cited = [f"PMID:{n}{i}" for i in range(n % 3 if n > 60 else 0)]  # the first ones have none
        for i, reference in enumerate(cited):
            rows += [("p", "r", source, "rc", f"{key}{i}", f"{at}/evidence/{i}/reference", reference), ("p", "r", source, "rc", f"{key}{i}s", f"{at}/evidence/{i}/supports", "yes")]
        entries.append((f'{{"provider_id":"p","release_id":"r","source_id":"{source}","source_row_id":"{key}"}}', f"name {n}", text, cited))
    questions = {str(n): "".join(rng.choice("abc") for _ in range(3)) + " " * n for n in range(30)}  # different texts, few different vectors
    found = evidence.mechanism_session(spark.createDataFrame(rows, FIELDS), spark.createDataFrame(list(questions.items()), "question_id string, question string"), FunctionEmbedding("letters", letters), top_k=4)
    dot = lambda a, b: float(sum(a.count(x) * b.count(x) for x in "abc"))
    ranked, best = [], []
    for q, text in questions.items():
        order = sorted(entries, key=lambda e: (-dot(e[2], text), e[0]))
        ranked += [(q, k, dot(e[2], text), e[1], len(e[3])) for k, e in enumerate(order[:4], 1)]
        first = next(e for e in order if e[3])
        best += [(q, first[1], reference, "yes") for reference in first[3]]
    assert sorted((r["question_id"], r["rank"], r["score"], r["mechanism"], r["cited_references"]) for r in found.ranked.collect()) == sorted(ranked)
    for most in (evidence.MAX_BROADCAST_SOURCES, 0):  # by the found sources, and by joins
        monkeypatch.setattr(evidence, "MAX_BROADCAST_SOURCES", most)
        assert sorted((r["question_id"], r["mechanism"], r["reference"], r["supports"]) for r in replace(found).best.collect()) == sorted(best)


def test_alike_rows_and_queries_keep_their_answers(spark):
    rng = random.Random(3)
    some = [[1.0, 0.0], [0.0, -0.0], [1.0, 2.0], [-1.0, 0.5]]
    rows = spark.createDataFrame([(f"{n:03d}", "k", "p", 2, rng.choice(some), n) for n in range(200)], "subject_id string, subject_kind string, provider string, dim int, embedding array<float>, more int")
    queries = spark.createDataFrame([(n, rng.choice(some[2:])) for n in range(20)], "query_id int, query array<float>")
    for metric in ("inner_product", "l2"):
        plain, alike = (sorted(map(tuple, retrieval.embedding_search_block(rows, queries, metric=metric, top_k=60, alike=a).select("query_id", "subject_id", "more", "score", "rank").collect())) for a in (False, True))
        assert plain == alike and len(plain) == 20 * 60
