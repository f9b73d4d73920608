import pytest

from pyspark.sql import functions as F

from verbena.contracts import ContractError
from verbena.functions import providers as P
from verbena.operators import graph, packs, store


def test_graph_writes(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS verbena_t LOCATION '{tmp_path}/db'")
    spark.sql("USE verbena_t")
    try:
        nodes = spark.createDataFrame([("n1", "f", "Marfan"), ("n1", "f", "Marfan"), ("n2", "f", None)], "node_id string, family string, label string")
        aliases = spark.createDataFrame([("n1", "Marfan's"), ("n1", "--")], "node_id string, alias string").selectExpr("*", "'label' AS alias_kind")
        for _ in range(2):
            store.write_graph(spark, nodes, aliases, prefix="s")
        assert spark.table("s_nodes").count() == 2 and spark.table("s_aliases").count() == 2
        assert [r["normalized_alias"] for r in spark.table("s_alias_index").collect()] == ["marfan s"]
        with pytest.raises(ContractError, match="unique"):
            store.write_graph(spark, spark.createDataFrame([("n1", "other")], "node_id string, family string"), prefix="s")
        store.write_graph(spark, nodes.where("node_id = 'n2'"), replace=True, prefix="s")
        assert [r["node_id"] for r in spark.table("s_nodes").collect()] == ["n2"]

        provider = P.FunctionEmbedding("len", lambda texts: [[len(t), 1] for t in texts])
        assert isinstance(provider, P.EmbeddingProvider)
        texts = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id int, t string")
        rows = P.embedding_batch(texts, provider, "id", "t", "node")
        for _ in range(2):
            store.write_embeddings(spark, rows, replace=True, prefix="s")
        assert sorted((r["subject_id"], r["dim"], r["embedding"]) for r in spark.table("s_embeddings").collect()) == [("1", 2, [2, 1]), ("3", 2, [0, 1])]
        store.write_embeddings(spark, rows, prefix="s")
        assert spark.table("s_embeddings").count() == 4
        with pytest.raises(ContractError, match="length"):
            store.write_embeddings(spark, rows.selectExpr("subject_id", "subject_kind", "provider", "3 AS dim", "embedding"), prefix="s")
        tokens = P.token_embedding_batch(texts, P.FunctionTokenEmbedding("chars", lambda ts: [[(c, [ord(c)]) for c in t] for t in ts]), "id", "t", "node")
        store.write_token_embeddings(spark, tokens, prefix="s")
        assert sorted((r["token_index"], r["token"]) for r in spark.table("s_token_embeddings").collect()) == [(0, "a"), (1, "b")]
        judged = spark.createDataFrame([("j", "m", "p", "keep")], "judgment_id string, subject_id string, predicate string, decision string")
        store.record(spark, judged, "judgments", prefix="s")
        assert spark.table("s_judgments").first()["model"] is None and spark.table("s_judgments").first()["recorded_at"] is not None

        (tmp_path / "a.obo").write_text("[Term]\nid: T:1\nname: Short stature\n\n[Term]\nid: T:2\nname: stature\nis_a: T:1\n")
        for _ in range(2):
            store.write_obo(spark, str(tmp_path / "a.obo"), "t", prefix="o")
        assert spark.table("o_nodes").count() == 2 and spark.table("o_edges").count() == 1
        texts = spark.createDataFrame([("d1", "Short stature, stature"), ("d2", "none")], "document_id string, text string")
        mentions = store.annotate(spark, texts, store=True, prefix="o")
        assert spark.table("o_mentions").count() == mentions.count() == 2 and graph.LexicalAnnotator().ground(spark, "stature", prefix="o").first()["mention_id"] == "mention:000001"
        assert isinstance(graph.LexicalAnnotator(), P.Annotator)
        said = '[{"mention_id": "d1:000002", "decision": "keep"}, {"mention_id": "d1:000005", "decision": "replace", "replacement_node_id": "T:9"}]'
        context = spark.createDataFrame([("d1", "T:9")], "document_id string, node_id string")
        judged = store.judge(texts, mentions, P.FunctionRunner(lambda ps: [said] * len(ps)), context, store=True, prefix="o")
        assert sorted(r["object_id"] for r in judged.collect()) == ["T:1", "T:9"] and spark.table("o_judgments").count() == 2
        with pytest.raises(ContractError, match="candidate or context"):
            store.judge(texts, mentions, P.FunctionRunner(lambda ps: [said] * len(ps)), prefix="o")
        unnamed = spark.createDataFrame([("s", "node", "p", 3, 5, [1.0]), ("s", "node", "p", 0, 2, [2.0])], "subject_id string, subject_kind string, provider string, start_offset int, end_offset int, embedding array<float>")
        assert sorted((r["block_id"], r["token_index"], r["start_offset"]) for r in store.token_defaults(unnamed).collect()) == [("p|node|s", 0, 0), ("p|node|s", 1, 3)]
    finally:
        spark.sql("USE default")
        spark.sql("DROP DATABASE verbena_t CASCADE")


def test_runner(spark):
    asked = spark.createDataFrame([(1, "a"), (2, None)], "id int, prompt string")
    got = P.run_prompts(asked, P.FunctionRunner(lambda ps: [p.upper() for p in ps]))
    assert sorted((r["id"], r["response"]) for r in got.collect()) == [(1, "A"), (2, None)]
    with pytest.raises(Exception, match="results for"):
        P.run_prompts(asked, P.FunctionRunner(lambda ps: [])).collect()


def pack_frames(spark, edges):
    kinds = {packs.TEXT: "string", packs.TEXTS: "array<string>", packs.NUMBER: "double"}
    schema = lambda r: ", ".join(f"{c} {kinds[k]}" for k, names in packs.CONTRACT[r].items() for c in names.split())
    names = [c for n in packs.CONTRACT["denormalized_edges"].values() for c in n.split()]
    pack = {r: spark.createDataFrame([], schema(r)) for r in packs.RELATIONS}
    pack["denormalized_edges"] = spark.createDataFrame([tuple(e.get(c) for c in names) for e in edges], schema("denormalized_edges"))
    pack["nodes"] = spark.createDataFrame([("x", "c", "n", "s", [], [])], schema("nodes"))
    return pack


def test_pack_views(spark, tmp_path):
    edge = lambda i, s, o, sc, oc, neg=None: {"id": i, "predicate": "biolink:p", "negated": neg, "subject": s, "object": o, "subject_category": sc, "object_category": oc, "subject_label": f"l{s}", "subject_closure": ["z"]}
    gene, disease = "biolink:Gene", "biolink:Disease"
    pack = pack_frames(spark, [edge("1", "G", "D", gene, disease), edge("2", "D", "G", disease, gene), edge("3", "G", "D", gene, disease, "true"), edge("4", None, "D", gene, disease), edge("5", "G", "H", gene, gene), edge("6", "G", "D", gene, disease, "t")])
    releases = spark.createDataFrame([("r1", "p", 1.0)], "release_id string, provider_id string, source_ordinal double").selectExpr("*", "date'2025-01-01' AS effective_date")
    names = packs.project_pack(spark, pack, releases, "p", "r1", "vp")
    assert names.count() == 7 and [spark.table("vp_nodes").first()[c] for c in ("id", "provider_id", "release_id")] == ["x", "p", "r1"]
    rows = {r["edge_id"]: r for r in spark.table("vp_gene_disease").collect()}
    assert [rows[k]["association_status"] for k in "123456"] == ["supported_subject_to_object", "supported_object_to_subject", "negated", "missing_endpoint", "unsupported_orientation", "malformed_negation"]
    assert [(rows[k]["gene_id"], rows[k]["disease_id"], rows[k]["source_direction"]) for k in "123"] == [("G", "D", "subject_to_object"), ("G", "D", "object_to_subject"), (None, None, None)]
    assert rows["2"]["disease_label"] == "lD" and rows["2"]["source_subject"] == "D" and rows["1"]["gene_closure"] == ["z"]
    edges = pack["denormalized_edges"]
    broken = ({"nodes": edges}, pack | {"denormalized_edges": edges.drop("negated")}, pack | {"denormalized_edges": edges.withColumn("negated", F.lit(True))}, pack | {"information_content": pack["information_content"].withColumn("ic", F.lit("1"))})
    for bad in ({"release_id": "latest"}, {"release_id": "r2"}, *({"pack": b} for b in broken)):
        with pytest.raises(ContractError):
            packs.project_pack(spark, **({"pack": pack, "releases": releases, "provider_id": "p", "release_id": "r1", "prefix": "vq"} | bad))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("vq")]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS verbena_pack LOCATION '{tmp_path}/pack'")
    try:
        for name, df in pack.items():
            df.write.saveAsTable(f"verbena_pack.{name}")
        releases.createOrReplaceTempView("pack_releases")
        assert packs.project_pack(spark, packs.attached_pack(spark, "verbena_pack"), "pack_releases", "p", "r1", "va").count() == 7
        assert spark.table("va_associations").count() == 6
        with pytest.raises(ContractError, match="current"):
            packs.attached_pack(spark, spark.catalog.currentDatabase())
    finally:
        spark.sql("DROP DATABASE verbena_pack CASCADE")
