"""Judgments that a model returned as JSON, one per candidate and in candidate order.

Many calls are judged at once: ``responses`` (call_id, response), ``candidates`` (call_id, position from 0,
mention_id, node_id) and, if given, ``context`` (call_id, node_id) with further nodes a replacement may name.
A call is accepted or rejected as a whole.  A null, empty or unreadable response is rejected; a call without
candidates is accepted when its response holds no result.  call_id must be unique in ``responses``.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena import contracts as C

# Keys that may wrap the results, and the decisions (fixed values).
WRAPPERS = ("array", "judgments", "results", "items", "arguments", "args")
DECISIONS = ("keep", "drop", "replace", "enrich")

ITEM = "mention_id: string, decision: string, confidence: double, replacement_node_id: string, value_json: string"
ITEM_NAMES = tuple(f.split(":")[0] for f in ITEM.split(", "))
PARSED = f"ok boolean, items array<struct<{ITEM}>>"
RULES = (
    "response must hold valid JSON results", "mention_id and decision must be non-empty text", "exactly one result per candidate, in candidate order", "decision is unknown",
    "confidence must be null or from 0 to 1", "replace needs replacement_node_id", "replacement_node_id must be a candidate or context node",
)


_READ = json.JSONDecoder().raw_decode


def read_json(response: str):
    """The response if it begins with JSON, else its first suffix that is JSON; ValueError if there is none."""
    text = (response or "").strip()
    if text[:1] in ("[", "{"):
        return json.loads(text)
    for m in re.finditer(r"[\[{]", text) if text[-1:] in ("]", "}") else ():
        try:
            found, end = _READ(text, m.start())
        except (ValueError, RecursionError):
            continue
        if end == len(text):
            return found
    raise ValueError("no JSON")


def results(payload) -> list[dict]:
    """The results in a payload, out of their wrappers; ValueError for other shapes."""
    while isinstance(payload, dict) and payload:
        inside = next((payload[k] for k in WRAPPERS if payload.get(k) is not None), None)
        payload = [payload] if inside is None and {"mention_id", "decision"} <= payload.keys() else inside
    if payload is None or not isinstance(payload, list | dict) or not all(isinstance(x, dict) for x in payload):
        raise ValueError("not a list of results")
    return list(payload)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _number(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def _dumped(values: list[dict]) -> list[str]:
    """Each value as JSON, by one call for all: a mark that no value can hold stands after each."""
    if not values:
        return []
    mark = uuid.uuid4().hex
    text = json.dumps([x for v in values for x in (v, mark)])
    return text[1 : -len(f', "{mark}"]')].split(f', "{mark}", ')


def parsed(responses: Iterable[str | None]) -> pa.Array:
    """Whether each response can be read, and its results, as an array of ``PARSED``."""
    ok, ends, found = [], [0], []
    for text in responses:
        try:
            found += results(read_json(text))
        except (ValueError, RecursionError):
            ok.append(False)
        else:
            ok.append(True)
        ends.append(len(found))
    try:
        texts = _dumped(found)
    except RecursionError:  # by a response that is read but too deep to write: it alone is refused
        return parsed(_shallow(responses))
    texts_of = lambda key: [_text(x.get(key)) for x in found]
    columns = (texts_of("mention_id"), texts_of("decision"), [_number(x.get("confidence")) for x in found], [t or None for t in texts_of("replacement_node_id")], texts)
    kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string())
    items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ITEM_NAMES)
    return pa.StructArray.from_arrays([pa.array(ok, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["ok", "items"])


def _shallow(responses: Iterable[str | None]) -> list[str | None]:
    """Responses without those whose results can't be written as JSON."""
    out = []
    for text in responses:
        try:
            _dumped(results(read_json(text)))
            out.append(text)
        except (ValueError, RecursionError):
            out.append(None)
    return out


def _broken(unknown: Column) -> Column:
    """The number of the first rule that a candidate (asked_id) and its result break; ``unknown``: its replacement is not a node of the call."""
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    given = F.col("value_json").isNotNull()
    broken = [
        given & (empty("mention_id") | empty("decision")), ~F.col("asked_id").eqNullSafe(F.col("mention_id")), given & ~F.col("decision").isin(*DECISIONS),
        ~F.isnan("confidence") & ~F.col("confidence").between(0, 1), (F.col("decision") == "replace") & F.col("replacement_node_id").isNull(), unknown,
    ]
    return F.coalesce(*(F.when(F.coalesce(b, F.lit(False)), F.lit(n)) for n, b in enumerate(broken, 1)))


def _judged(responses: DataFrame, candidates: DataFrame, context: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One row per candidate or result, and per call the number of the first broken rule."""
    C.columns(responses, ["call_id", "response"], "responses")
    C.columns(candidates, ["call_id", "position", "mention_id", "node_id"], "candidates")
    parse = F.arrow_udf(lambda response: parsed(response.to_pylist()), PARSED)
    calls = responses.select("call_id", parse("response").alias("p")).select("call_id", "p.ok", "p.items")
    got = calls.select("call_id", F.posexplode("items").alias("position", "item")).select("call_id", "position", "item.*")
    asked = candidates.select("call_id", F.col("position").cast("int").alias("position"), F.col("mention_id").alias("asked_id"), "node_id")
    nodes = candidates.select("call_id", "node_id")
    nodes = (nodes.union(context.select("call_id", "node_id")) if context is not None else nodes).distinct().select("call_id", F.col("node_id").alias("replacement_node_id"), F.lit(True).alias("allowed"))
    rows = asked.join(got, ["call_id", "position"], "full").join(nodes, ["call_id", "replacement_node_id"], "left")
    first = _broken(F.col("replacement_node_id").isNotNull() & F.col("allowed").isNull())
    worst = rows.groupBy("call_id").agg(F.min(first).alias("rule"), (F.count("mention_id") > F.count_distinct("mention_id")).alias("twice"))
    rule = F.when(~F.col("ok"), 0).otherwise(F.least("rule", F.when(F.col("twice"), 2)))
    return rows, calls.select("call_id", "ok").join(worst, "call_id", "left").select("call_id", rule.alias("rule"))


def judged_calls(calls: DataFrame, run: Callable[[list[str | None]], Sequence[str | None]]) -> DataFrame:
    """Calls (call_id, prompt, repeated, asked, nodes) as one row per candidate or result, with ``rule``, the number of a broken rule.

    ``asked`` holds a call's candidates (mention_id, node_id) in order, ``nodes`` what a replacement may name, and a call whose
    id is ``repeated`` has no one result per candidate.  A call is run, read and held against its rules where it lies, and nothing is
    shuffled.  The least rule of a call's rows is the first it breaks; a call without rows has one, without ids.
    """
    answer = F.arrow_udf(lambda prompt: parsed(run(prompt.to_pylist())), PARSED).asNondeterministic()
    x = calls.select("call_id", "repeated", "asked", "nodes", answer("prompt").alias("p"))
    named = F.array_compact("p.items.mention_id")
    twice = F.col("repeated") | (F.size(F.array_distinct(named)) < F.size(named))
    stray = F.size(F.array_except(F.array_compact("p.items.replacement_node_id"), "nodes")) > 0
    of_call = F.when(~F.col("p.ok"), 0).when(twice, 2).when(stray, 6)
    x = x.select("call_id", of_call.alias("of_call"), F.explode_outer(F.arrays_zip("asked", F.col("p.items").alias("items"))).alias("z"))
    rows = x.select("call_id", "of_call", F.col("z.asked.mention_id").alias("asked_id"), F.col("z.asked.node_id").alias("node_id"), "z.items.*")
    return rows.withColumn("rule", F.least("of_call", _broken(F.lit(False)))).drop("of_call")


def violations(responses: DataFrame, candidates: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Each call with ``reason``: the first rule it breaks, null if none."""
    _, calls = _judged(responses, candidates, context)
    return calls.select("call_id", F.coalesce(*(F.when(F.col("rule") == n, F.lit(m)) for n, m in enumerate(RULES))).alias("reason"))


def judgments(responses: DataFrame, candidates: DataFrame, model: str, context: DataFrame | None = None) -> DataFrame:
    """Judgment rows of accepted calls; a drop has no object, a replacement takes the candidate's place."""
    rows, calls = _judged(responses, candidates, context)
    return judgment_rows(rows.join(calls.where("rule IS NULL").select("call_id"), "call_id", "left_semi"), model)


def judgment_rows(rows: DataFrame, model: str) -> DataFrame:
    """Candidates and their accepted results in the columns of ``judgments``."""
    return rows.select(
        F.concat(F.lit("judgment:"), "mention_id").alias("judgment_id"), F.col("mention_id").alias("subject_id"), F.lit("semantic:grounding_decision").alias("predicate"),
        F.when(F.col("decision") != "drop", F.coalesce("replacement_node_id", "node_id")).alias("object_id"), "value_json", "decision", F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence"),
        F.lit(None).cast("string").alias("evidence"), F.lit(model).alias("model"), F.current_timestamp().alias("recorded_at"), F.lit(None).cast("string").alias("attrs"),
    )
