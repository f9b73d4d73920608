"""Judging by one pass: the rules of the three-relation form, answers read once and nothing shuffled behind them."""

import json

import pytest
from pyspark.sql import functions as F

from verbena.contracts import ContractError
from verbena.functions.providers import FunctionRunner
from verbena.operators import judgments, store


def kept(*ids, **more):
    return json.dumps([{"mention_id": i, "decision": "keep"} | more for i in ids])


RESPONSES = (
    kept("a", "b"), "Results: " + kept("a", "b", confidence=0.5), kept("a"), kept("b", "a"), kept("a", "a"), kept("a", "b", "c"), "", None, "no", "[]", kept("a", "b", confidence=2), kept("a", "b", decision="replace"),
    kept("a", "b", decision="replace", replacement_node_id="Q:9"), kept("a", "b", decision="replace", replacement_node_id="N:1"), kept("a", "b", decision="replace", replacement_node_id="X:1"), kept("a", "b", decision="guess"), kept("", "b"),
    '[{"mention_id": "a", "decision": "keep", "x": ' + "[" * 900 + "]" * 900 + '}, {"mention_id": "b", "decision": "keep"}]', kept("a", "b", note='", "'),
)


def test_rules_where_a_call_lies(spark):
    said = spark.createDataFrame(list(enumerate(RESPONSES)), "call_id int, response string")
    ids = said.select("call_id")
    candidates = ids.crossJoin(spark.createDataFrame([(0, "a", "N:1"), (1, "b", "N:2")], "position int, mention_id string, node_id string"))
    context = ids.withColumn("node_id", F.lit("X:1"))
    asked = F.array(F.struct(F.lit("a").alias("mention_id"), F.lit("N:1").alias("node_id")), F.struct(F.lit("b").alias("mention_id"), F.lit("N:2").alias("node_id")))
    calls = said.select("call_id", F.col("response").alias("prompt"), F.lit(False).alias("repeated"), asked.alias("asked"), F.array(*map(F.lit, ("N:1", "N:2", "X:1"))).alias("nodes"))
    rows = judgments.judged_calls(calls, lambda prompts: prompts)
    want = {r["call_id"]: r["reason"] for r in judgments.violations(said, candidates, context).collect()}
    got = {r["call_id"]: None if r["rule"] is None else judgments.RULES[r["rule"]] for r in rows.groupBy("call_id").agg(F.min("rule").alias("rule")).collect()}
    assert got == want and sum(v is None for v in want.values()) >= 5
    good = [k for k, v in want.items() if v is None]
    plain = judgments.judgments(said.where(F.col("call_id").isin(good)), candidates, "m", context).drop("recorded_at")
    once = judgments.judgment_rows(rows.where(F.col("call_id").isin(good)), "m").drop("recorded_at")
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, once.collect()))


def test_answers_are_read_once(spark):
    documents = spark.createDataFrame([(str(n), f"text {n}") for n in range(50)] + [("silent", ""), ("alone", "no mention")], "document_id string, text string")
    mentions = spark.createDataFrame([(str(n % 50), f"{n % 50}/{n // 50}", f"N:{n}", n // 50) for n in range(150)] + [("silent", "s", "N:0", 0)], "document_id string, mention_id string, node_id string, start_offset int")
    answer = lambda prompts: [json.dumps([{"mention_id": m["mention_id"], "decision": "keep"} for m in json.loads(p.split("CANDIDATES_JSON:\n")[1].split("\n")[0])]) for p in prompts]
    found = store.judge(documents, mentions, FunctionRunner(answer))
    assert sorted((r["subject_id"], r["object_id"]) for r in found.collect()) == sorted((f"{n % 50}/{n // 50}", f"N:{n}") for n in range(150))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    with pytest.raises(ContractError, match="exactly one result"):
        store.judge(documents.unionByName(documents.where("document_id = '7'")), mentions, FunctionRunner(answer))
