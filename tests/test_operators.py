import hashlib
import math
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verbena import contracts as C
from verbena.functions import text as X
from verbena.functions import vectors as V
from verbena.operators import graph, judgments, literature, observations, retrieval
from verbena.operators import releases as R
from verbena.sources import obo, receipts


def test_entry_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_maxsim_definition_and_nulls(spark):
    one = lambda a, b: spark.range(1).select(V.maxsim(F.expr(a), F.expr(b)).alias("s")).first()["s"]
    assert one("array(array(1,0),array(0,1))", "array(array(.5,.5),array(1,0))") == 1.5
    assert one("array(array(1,2,3))", "array(array(-1,-1,-1),array(0,0,1))") == 3
    assert one("cast(null as array<array<float>>)", "array(array(1.0))") is None
    assert one("cast(array() as array<array<float>>)", "array(array(1.0))") is None
    with pytest.raises(Exception, match="rectangular"):
        one("array(array(1,0),array(0))", "array(array(1,0))")


def test_literal_spans_where_lower_case_changes_the_length(spark):
    texts = ["İabc abc", "ABCẞabc", "ΑΣ σ Σ", None, "", "x" * 50 + "abc" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    began = time.time()
    got = {r["id"]: r["s"] and [tuple(x) for x in r["s"]] for r in df.select("id", X.literal_spans(F.col("text"), "aBc").alias("s")).collect()}
    assert got[0] == [(1, 4), (5, 8)] and got[1] == [(0, 3), (4, 7)] and got[2] == got[4] == [] and got[3] is None
    assert len(got[5]) == 100_000 and got[5][-1] == (50 + 299_997, 50 + 300_000) and time.time() - began < 10
    sigma = X.literal_hits(df, "text", "Σ").select("id", "h.*").collect()
    assert [tuple(r) for r in sorted(sigma)] == [(2, 1, 2), (2, 3, 4), (2, 5, 6)]
    dotted = X.literal_hits(df, "text", "iAb").select("id", "h.*").collect()
    assert [tuple(r) for r in dotted] == [(0, 0, 3)]
    assert df.where("id = 0").select(X.normalize(F.col("text"))).first()[0] == "iabc abc"


def test_token_and_literal_spans_reproduce_text(spark):
    text = "  The cat—2 cats; CAT!é cat"
    df = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    for r in X.tokens(df, "id", "text").collect():
        assert text[r["start_offset"] : r["end_offset"]] == r["token"]
    short = df.where("id = 1").select(X.token_spans(F.col("text")).alias("s")).first()["s"]
    assert [(s["start_offset"], s["end_offset"]) for s in short] == [m.span() for m in re.finditer("[A-Za-z0-9]+", text)]
    got = df.where("id = 1").select(X.literal_spans(F.col("text"), "cat").alias("s")).first()["s"]
    assert [(s[0], s[1]) for s in got] == [m.span() for m in re.finditer("cat", text, re.I)]
    assert spark.sql("select 'aaa' t, 'aa' p").select(X.occurs_once(F.col("t"), F.col("p"))).first()[0] is False


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "q", "z")], "from_id string, predicate string, to_id string")
    assert graph.closure(e, ["p"]).count() == 9
    assert graph.closure(e, []).count() == 0
    chain = spark.createDataFrame([(f"{i}", "p", f"{i + 1}") for i in range(37)], "from_id string, predicate string, to_id string")
    assert graph.closure(chain, ["p"]).count() == 37 * 38 // 2
    chain.createOrReplaceTempView("chain_edges")
    spark.sql(graph.closure_sql(["p"], "chain_edges", "chain_closed"))
    assert spark.table("chain_closed").count() == 37 * 38 // 2
    spark.sql(graph.closure_sql([], "chain_edges", "chain_closed"))
    assert spark.table("chain_closed").count() == 0
    spark.sql(graph.projection_sql("chain_edges", "from_id", "predicate", "to_id", "chain_projected"))
    assert spark.table("chain_projected").columns == ["from_id", "predicate", "to_id", "attrs", "trust"]


def test_closure_equals_search(spark):
    import random

    r = random.Random(4)
    pairs = {(r.randrange(30), r.randrange(30)) for _ in range(45)}
    want = set()
    for a in range(30):
        todo = [b for x, b in pairs if x == a]
        seen = set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += [c for x, c in pairs if x == b]
        want |= {(str(a), str(b)) for b in seen}
    e = spark.createDataFrame([(str(a), "p", str(b)) for a, b in pairs] * 2, "from_id string, predicate string, to_id string")
    assert {(x["from_id"], x["to_id"]) for x in graph.closure(e, ["p"]).collect()} == want


def test_spans_are_numbered_in_order(spark):
    text = "one Two three four"
    d = spark.createDataFrame([("d", text), ("e", None), ("f", "!")], "id string, text string")
    for most in (1, 2, 3, 9):
        got = sorted((r["ordinal"], r["normalized_span"], r["span"]) for r in X.ngrams(d, "id", "text", most).collect())
        words = text.split()
        want = [" ".join(words[i : i + n]) for i in range(4) for n in range(1, most + 1) if i + n <= 4]
        assert got == [(k, w.lower(), w) for k, w in enumerate(want, 1)]
    few = {(r["ordinal"], r["span"]) for r in X.ngrams(d, "id", "text", 3, frozenset({"two three", "four", "one x"})).collect()}
    assert few == {(5, "Two three"), (9, "four")}


def test_insert_absent_is_null_safe(spark):
    e = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    assert sorted(map(tuple, graph.insert_absent(e, e).collect()), key=str) == sorted([("a", None), ("b", "x")], key=str)


def test_annotation_prefers_longest(spark):
    a = spark.createDataFrame([("HP:0004322", "Short stature", "label", "t", 1.0, None), ("X:1", "stature", "label", "t", 1.0, None), ("HP:0001250", "seizures", "label", "t", None, None)], "node_id string, alias string, alias_kind string, source string, weight double, attrs string")
    d = spark.createDataFrame([("d", "The patient has SHORT---stature and seizures.")], "document_id string, text string")
    got = {r["node_id"]: (r["start_offset"], r["end_offset"]) for r in graph.annotate(d, graph.alias_index(a)).collect()}
    assert got == {"HP:0004322": (16, 31), "HP:0001250": (36, 44)}
    assert graph.annotate(d, graph.alias_index(a), longest_match=False).count() == 3
    rows = graph.annotate(d, graph.alias_index(a), ordered=True).collect()
    assert [(r["mention_id"], r["span"], r["score"], r["method"]) for r in rows] == [("d:000008", "SHORT---stature", 1.0, "lexical_alias"), ("d:000013", "seizures", 1.0, "lexical_alias")]
    graph_limit, graph.MAX_BROADCAST_ALIASES = graph.MAX_BROADCAST_ALIASES, 0
    try:
        assert graph.annotate(d, graph.alias_index(a), ordered=True).collect() == rows
    finally:
        graph.MAX_BROADCAST_ALIASES = graph_limit


def test_search_rejects_bad_queries(spark):
    rows = spark.createDataFrame([("a", "node", "t", 2, [1.0, 0.0]), ("b", "node", "t", 2, [0.0, 1.0]), ("c", "node", "t", 3, [1.0, 0.0, 0.0])], "subject_id string, subject_kind string, provider string, dim int, embedding array<float>")
    assert retrieval.embedding_search(rows, [1.0, 0.0], top_k=1).first()["subject_id"] == "a"
    with pytest.raises(C.ContractError):
        retrieval.embedding_search(rows, [0.0, 0.0])
    with pytest.raises(C.ContractError):
        retrieval.embedding_search(rows, [math.nan, 0.0], metric="l2")


@pytest.mark.parametrize("metric", list(V.METRICS))
def test_block_search_equals_one_search_a_query(spark, metric):
    rows = [(f"s{i:02d}", "node", "p", 3, [float(i % 7 - 3), float(i % 5), float(i % 3 + 1)]) for i in range(60)]
    x = spark.createDataFrame(rows, "subject_id string, subject_kind string, provider string, dim int, embedding array<float>").repartition(5)
    block = spark.createDataFrame([(i, rows[i][4]) for i in range(0, 60, 10)], "query_id int, query array<float>")
    got = retrieval.embedding_search_block(x, block, top_k=4, metric=metric).orderBy("query_id", "rank").collect()
    assert len(got) == 24
    for i in range(0, 60, 10):
        want = [r["subject_id"] for r in retrieval.embedding_search(x, rows[i][4], top_k=4, metric=metric).collect()]
        assert [r["subject_id"] for r in got if r["query_id"] == i] == want


def test_widths_are_held(spark):
    rows = spark.createDataFrame([("a", "node", "t", 2, [1.0, 0.0, 3.0])], "subject_id string, subject_kind string, provider string, dim int, embedding array<float>")
    with pytest.raises(Exception, match="as long as dim"):
        retrieval.embedding_search(rows, [1.0, 0.0]).collect()


def test_release_contracts(spark):
    facts = spark.createDataFrame([("G", "D", "r1", "p", "1"), ("G", "D", "r1", "p", "1"), ("H", "D", "r2", "p", "1")], "gene_id string, disease_id string, release_id string, provider_id string, source_version string")
    releases = spark.createDataFrame([("p", "r1", 1.0), ("p", "r2", 2.0)], "provider_id string, release_id string, source_ordinal double")
    assert R.monarch_import(facts, releases, "gene_disease").count() == 2
    assert [r["gene_id"] for r in R.holdout_audit(facts, releases, "p", "r1", "r2").collect()] == ["H"]
    with pytest.raises(C.ContractError, match="catalog"):
        R.monarch_import(facts, releases.where("release_id = 'r1'"), "gene_disease")
    words = spark.createDataFrame([(w,) for w in (None, "", "true", " False ", "t", "1", "f", "0")], "w string")
    assert [r[0] for r in words.select(R.negation_status(F.col("w"))).collect()] == ["not_provided", "not_provided", "negated", "not_negated", *["malformed"] * 4]
    s = spark.createDataFrame([("p", "s", 3)], "provider_id string, snapshot_id string, high_water_ordinal long")
    assert literature.literature_snapshot_catalog(s).first()["effective_at"] is None
    for bad in (s.union(s), s.selectExpr("provider_id", "snapshot_id", "0.5D AS high_water_ordinal"), s.selectExpr("provider_id", "'' AS snapshot_id", "high_water_ordinal")):
        with pytest.raises(C.ContractError):
            literature.literature_snapshot_catalog(bad)


def test_block_of_late_interactions_equals_one_a_query(spark):
    import random

    r = random.Random(5)
    rows = [(f"b{i // 4}", f"s{i // 4}", "node", "p", i % 4, "t", 3, [r.uniform(-1, 1) for _ in range(3)]) for i in range(80)]
    x = spark.createDataFrame(rows, "block_id string, subject_id string, subject_kind string, provider string, token_index int, token string, dim int, embedding array<float>").repartition(3)
    asked = {q: [[r.uniform(-1, 1) for _ in range(3)] for _ in range(1 + q)] for q in range(3)}
    queries = spark.createDataFrame([(q, k, v) for q, tokens in asked.items() for k, v in enumerate(tokens)], "query_id int, query_token int, query array<double>")
    got = retrieval.late_interaction_search_block(x, queries, top_k=5).orderBy("query_id", "rank").collect()
    for q, tokens in asked.items():
        want = retrieval.late_interaction_search(x, tokens, top_k=5).collect()
        assert [(g["block_id"], g["candidate_token_count"], g["query_token_count"]) for g in got if g["query_id"] == q] == [(w["block_id"], 4, len(tokens)) for w in want]
        assert [g["score"] for g in got if g["query_id"] == q] == pytest.approx([w["score"] for w in want])
    with pytest.raises(C.ContractError, match="non-zero"):
        retrieval.late_interaction_search_block(x, queries.selectExpr("query_id", "query_token", "array(0D, 0D, 0D) AS query"))
    x.createOrReplaceTempView("token_rows")
    assert retrieval.late_interaction_search_block("token_rows", queries, top_k=1).count() == 3


def test_observation_rules(spark):
    d = spark.createDataFrame([("d", "Patient has seizures.")], "document_id string, source_text string")
    row = ("d", "HP:0001250", 12, 20, "seizures", "present", "m", "p", "1", 0.9, "accepted")
    schema = "document_id string, hpo_id string, start_offset int, end_offset int, source_text string, context_status string, method string, provider_id string, provider_version string, confidence double, status string"
    assert observations.hpo_observations(d, spark.createDataFrame([row], schema)).count() == 1
    for known in ("absent/negated", "family_history", "conflict", "unsupported", "uncertain"):
        assert observations.hpo_observations(d, spark.createDataFrame([tuple(known if i == 5 else v for i, v in enumerate(row))], schema)).count() == 1
    assert observations.hpo_proband_present(spark.createDataFrame([row, tuple("conflict" if i == 5 else v for i, v in enumerate(row))], schema)).count() == 1
    for at, bad in ((5, "historical"), (10, "rejected")):
        with pytest.raises(C.ContractError):
            observations.hpo_proband_present(spark.createDataFrame([tuple(bad if i == at else v for i, v in enumerate(row))], schema))
    for at, bad in ((1, "HP:1"), (2, 11), (3, 99), (4, "seizure"), (5, "maybe"), (9, 1.5), (10, "rejected"), (0, "x")):
        with pytest.raises(C.ContractError):
            observations.hpo_observations(d, spark.createDataFrame([tuple(bad if i == at else v for i, v in enumerate(row))], schema))


def test_obo_and_receipts(spark, tmp_path):
    f = tmp_path / "a.obo"
    f.write_text('format-version: 1.2\n\n[Term]\nid: HP:1\nname: All\ndef: "Root \\"term\\"" [x]\nalt_id: HP:OLD\nsynonym: "whole phenotype" EXACT []\nno colon here\nis_a: HP:0 {x="y"} ! root\nrelationship: part_of HP:2 ! two\n\n[Term]\nid: HP:9\nis_obsolete: TRUE\n\n[Typedef]\nid: part_of\n')
    o = obo.read_obo(spark, str(f), "hpo")
    n = o.nodes.collect()
    assert [(r["node_id"], r["label"], r["description"]) for r in n] == [("HP:1", "All", 'Root "term"')]
    assert {r["alias"] for r in o.aliases.collect()} == {"All", "HP:OLD", "whole phenotype"}
    assert {(r["predicate"], r["to_id"]) for r in o.edges.collect()} == {("is_a", "HP:0"), ("part_of", "HP:2")}
    assert [r["trust"] for r in n] == [None] and {r["alias_kind"] for r in o.aliases.collect()} == {"label", "alt_id", "synonym:exact"}
    assert [(r["tag_ordinal"], r["tag"], r["value"]) for r in o.tags.orderBy("tag_ordinal").collect()][5:7] == [(6, "no colon here", "no colon here"), (7, "is_a", 'HP:0 {x="y"} ! root')]
    digest = hashlib.sha256(f.read_bytes()).hexdigest()
    assert receipts.admit(spark, str(f), digest) == f.read_bytes()
    with pytest.raises(C.ContractError):
        receipts.admit(spark, str(f), "0" * 64)
    assert receipts.flatten({"a/b": [1, True, None, {}], "c~": 1.5}) == [("/a~1b/0", "integer", "1"), ("/a~1b/1", "logical", "TRUE"), ("/a~1b/2", "null", None), ("/c~0", "double", "1.5")]


def test_judgments_are_accepted_by_call(spark):
    ask = [("a", 0, "m1", "n1"), ("a", 1, "m2", "n2")]
    ok = '[{"mention_id":"m1","decision":"keep","confidence":"x"},{"mention_id":"m2","decision":"replace","replacement_node_id":"c"}]'
    cases = [
        (ok, None), ("Here: " + ok, None), ('{"results":' + ok + "}", None), (None, 0), ("none", 0), ("[1]", 0), (ok + " done", 0), ('[{"mention_id":"m1","decision":""},' + ok[1:], 1), ("[]", 2), (ok.replace("m1", "m9"), 2),
        (ok.replace("keep", "maybe"), 3), (ok.replace('"x"', "1.5"), 4), (ok.replace(',"replacement_node_id":"c"', ""), 5), (ok.replace('"c"', '"z"'), 6),
    ]
    r = spark.createDataFrame([(f"{n}", t) for n, (t, _) in enumerate(cases)] + [("none", "{}")], "call_id string, response string")
    c = spark.createDataFrame([(f"{n}", *a[1:]) for n in range(len(cases)) for a in ask], "call_id string, position int, mention_id string, node_id string")
    x = spark.createDataFrame([(f"{n}", "c") for n in range(len(cases))], "call_id string, node_id string")
    got = {v["call_id"]: v["reason"] for v in judgments.violations(r, c, x).collect()}
    assert got == {f"{n}": None if rule is None else judgments.RULES[rule] for n, (_, rule) in enumerate(cases)} | {"none": None}
    rows = judgments.judgments(r.where("call_id = '0'"), c, "m", x).orderBy("subject_id").collect()
    assert [(v["judgment_id"], v["object_id"], v["decision"], v["confidence"]) for v in rows] == [("judgment:m1", "n1", "keep", None), ("judgment:m2", "c", "replace", None)]
    assert judgments.judgments(r.limit(0), c.limit(0), "m").count() == 0


def reach(edges):
    out = set(edges)
    while more := {(a, p, d) for a, p, b in out for c, q, d in edges if (b, p) == (c, q)} - out:
        out |= more
    return out


def test_closure_of_strong_parts_and_increments(spark):
    """Cycles in cycles, a dense part, chains between them; edges inserted one part after the other."""
    import random

    r = random.Random(3)
    edges = {(f"n{a}", "p", f"n{b}") for a, b in [(i, i + 1) for i in range(12)] + [(5, 2), (9, 7), (11, 6), (3, 3)]}
    edges |= {(f"d{r.randrange(8)}", "p", f"d{r.randrange(8)}") for _ in range(25)} | {("n12", "p", "d0"), ("d1", "q", "n0"), ("n0", "q", "d1")}
    df = lambda e: spark.createDataFrame(sorted(e), "from_id string, predicate string, to_id string")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(graph.closure(df(edges), ["p", "q"])) == sorted(reach(edges))
    first = {e for e in edges if r.random() < 0.6}
    closed = graph.closure(df(first), ["p", "q"])
    assert rows(graph.closure_insert(closed, df(edges - first), ["p", "q"])) == sorted(reach(edges))
    assert rows(graph.closure_insert(closed, df(first), ["p", "q"])) == sorted(reach(first))


def test_annotation_with_more_aliases_than_travel(spark, monkeypatch):
    aliases = ["heart", "heart attack", "acute heart attack", "attack of the heart", "the", "of the", "1 2 3", "Größe"]
    index = graph.alias_index(spark.createDataFrame([(f"n{i}", a, "label", "s", 1.0, None) for i, a in enumerate(aliases)], "node_id string, alias string, alias_kind string, source string, weight double, attrs string"))
    texts = ["An acute HEART attack; the attack of the heart.", "1-2-3 of the", None, "", "none here", "gr e gr the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id int, text string")
    columns = ("document_id", "mention_id", "node_id", "span", "start_offset", "end_offset")
    longer = every = None
    for longest in (True, False):
        few, many = (sorted(map(tuple, graph.annotate(docs, index, longest_match=longest, max_broadcast=n).select(*columns).collect()), key=str) for n in (100, 0))
        assert few == many and few
        longer, every = (few, every) if longest else (longer, few)
    inside = lambda x, y: x[0] == y[0] and y[4] <= x[4] and x[5] <= y[5] and (x[4], x[5]) != (y[4], y[5])
    assert longer == [x for x in every if not any(inside(x, y) for y in every)] and len(longer) < len(every)
    held = X.alias_filter(index, 8)
    begins = held.beginnings(4)
    assert held.has("heart attack") and list(begins("acute")) == [3] and list(begins("heart")) == [1, 2]
    words = [f"w{i}" for i in range(2000)]
    assert sum(map(held.has, words)) < 20 and sum(bool(begins(w)) for w in words) < 60
