import pytest

from verbena.functions import providers
from verbena.operators import prompts


def test_prompts(spark):
    documents = spark.createDataFrame([("a", "Marfan here"), ("b", "none"), ("c", None)], "document_id string, text string")
    mentions = spark.createDataFrame([("a", "m2", 7, None), ("a", "m1", 0, "s")], "document_id string, mention_id string, start_offset int, source string")
    got = {r["document_id"]: r["prompt"] for r in prompts.judgment_prompts(documents, mentions, spark.createDataFrame([("a", "n")], "document_id string, node_id string"), "DO").collect()}
    assert got["a"] == 'DO\n\nTEXT:\nMarfan here\n\nCANDIDATES_JSON:\n[{"mention_id":"m1","start_offset":0,"source":"s"},{"mention_id":"m2","start_offset":7}]\n\nGRAPH_CONTEXT_JSON:\n[{"node_id":"n"}]'
    assert got["b"].endswith("CANDIDATES_JSON:\n[]\n\nGRAPH_CONTEXT_JSON:\n[]") and "c" not in got
    assert prompts.judgment_prompts(documents, mentions).where("document_id = 'b'").first()["prompt"].startswith(prompts.default_judgment_instructions())


def test_parsers():
    assert isinstance(prompts.ToolJudgmentParser(), providers.JudgmentParser)
    want = [{"mention_id": "m", "decision": "keep"}]
    assert prompts.JsonJudgmentParser().parse('So: {"results": [{"mention_id": "m", "decision": "keep"}]}') == want
    call = "x <|tool_call_start|>[judge(mention_id='m', decision='keep'), other(a=1)]<|tool_call_end|> y"
    assert prompts.ToolJudgmentParser("judge").parse(call) == want and len(prompts.ToolJudgmentParser().parse(call)) == 2
    assert prompts.ToolJudgmentParser().parse('<|tool_call_start|>[{"mention_id": "m", "decision": "keep"}]<|tool_call_end|>') == want
    for bad in ("nothing", "", None, "<|tool_call_start|>f(x)(<|tool_call_end|>"):
        with pytest.raises(ValueError):
            prompts.ToolJudgmentParser().parse(bad)
