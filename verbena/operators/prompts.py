"""Prompts that ask a model to judge mentions, and parsers of what it answers."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbena import contracts as C
from verbena.operators.judgments import read_json, results

# Instructions and the mention columns that a prompt shows (fixed values).
INSTRUCTIONS = """You adjudicate deterministic semantic grounding candidates.
Return one JSON object per supplied candidate in order with mention_id, decision, and optional confidence.
Use drop for negated, uncertain, family-history-only, not-about-the-subject, duplicate, or unsupported candidates.
Never invent identifiers; replacements must come from supplied candidates or graph context."""
SHOWN = ("mention_id", "node_id", "span", "start_offset", "end_offset", "score", "alias", "alias_kind", "source")


def default_judgment_instructions() -> str:
    return INSTRUCTIONS


def _gathered(rows: DataFrame, shown: list[str], order: list[str], name: str) -> DataFrame:
    """Each document's rows as one list, in order."""
    first = [c for c in order if c in shown]
    items = F.array_sort(F.collect_list(F.struct(*first, *(c for c in shown if c not in first))))
    return rows.groupBy("document_id").agg(items.alias(name))


def _listed(items: str, shown: list[str]) -> Column:
    """Rows as one JSON list; a row leaves out what is null."""
    return F.coalesce(F.to_json(F.transform(items, lambda m: F.struct(*(m[c].alias(c) for c in shown)))), F.lit("[]"))


def asked(documents: DataFrame, mentions: DataFrame, context: DataFrame | None = None, instructions: str = INSTRUCTIONS, how: str = "left") -> DataFrame:
    """``judgment_prompts`` with the mentions and the context that each prompt shows, as lists ``m`` and ``g`` in its order."""
    C.columns(documents, ["document_id", "text"], "documents")
    C.columns(mentions, ["document_id", "mention_id"], "mentions")
    shown = [c for c in SHOWN if c in mentions.columns]
    x = documents.where(F.length("text") > 0).select("document_id", "text").join(_gathered(mentions, shown, ["start_offset", "end_offset", "mention_id"], "m"), "document_id", how)
    given = F.lit("[]")
    if context is not None:
        extra = [c for c in context.columns if c != "document_id"]
        x, given = x.join(_gathered(context, extra, extra, "g"), "document_id", "left"), _listed("g", extra)
    prompt = F.concat_ws("\n", F.lit(instructions), F.lit(""), F.lit("TEXT:"), F.col("text"), F.lit(""), F.lit("CANDIDATES_JSON:"), _listed("m", shown), F.lit(""), F.lit("GRAPH_CONTEXT_JSON:"), given)
    return x.select("document_id", prompt.alias("prompt"), "m", *(["g"] if context is not None else []))


def judgment_prompts(documents: DataFrame, mentions: DataFrame, context: DataFrame | None = None, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(document_id, prompt) of every document with text, its mentions in text order; context rows are shown whole.

    A document's mentions are gathered into its prompt, which must hold them anyway.  Null or empty texts have none.
    """
    return asked(documents, mentions, context, instructions).select("document_id", "prompt")


@dataclass(frozen=True)
class JsonJudgmentParser:
    """Results in the first JSON that a response holds."""

    def parse(self, response: str) -> list[dict]:
        return results(read_json(response))


@dataclass(frozen=True)
class ToolJudgmentParser:
    """Results in the arguments of tool calls, written as Python calls between markers; else JSON in a block or the response."""

    tool_name: str | None = None

    def parse(self, response: str) -> list[dict]:
        blocks = re.findall(r"<\|tool_call_start\|>(.*?)<\|tool_call_end\|>", response or "", re.S)
        found = [arguments for b in blocks for name, arguments in self.calls(b) if self.tool_name in (None, name)]
        if found:
            return found
        for text in (*blocks, response):
            try:
                return results(read_json(text))
            except ValueError:
                continue
        raise ValueError("no JSON")

    @staticmethod
    def calls(block: str) -> list[tuple[str, dict]]:
        """Names and literal keyword arguments; a block that isn't calls of that kind has none."""
        try:
            tree = ast.parse(block.strip(), mode="eval").body
            nodes = tree.elts if isinstance(tree, ast.List) else [tree]
            return [(n.func.id, {k.arg: ast.literal_eval(k.value) for k in n.keywords}) for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)]
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
