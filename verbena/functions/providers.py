"""What a caller may plug in: prompt runners, embedding providers and judgment parsers, run batch by batch on executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from verbena.contracts import ContractError


@runtime_checkable
class PromptRunner(Protocol):
    def run(self, prompts: Sequence[str]) -> Sequence[str]: ...


@runtime_checkable
class EmbeddingProvider(Protocol):
    name: str

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


@runtime_checkable
class TokenEmbeddingProvider(Protocol):
    name: str

    def token_embed(self, texts: Sequence[str]) -> Sequence[Sequence[tuple[str, Sequence[float]]]]: ...


@runtime_checkable
class JudgmentParser(Protocol):
    def parse(self, response: str) -> list[dict]: ...


@runtime_checkable
class Annotator(Protocol):
    def ground(self, spark: SparkSession, text: str, document_id: str | None = None, prefix: str = "semantic", longest_match: bool = True) -> DataFrame: ...


@dataclass(frozen=True)
class FunctionRunner:
    """A function of prompts as a runner."""

    function: Callable[[Sequence[str]], Sequence[str]]

    def run(self, prompts: Sequence[str]) -> Sequence[str]:
        return self.function(prompts)


@dataclass(frozen=True)
class FunctionEmbedding:
    """A function of texts as a provider of one vector a text."""

    name: str
    function: Callable[[Sequence[str]], Sequence[Sequence[float]]]

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        return self.function(texts)


@dataclass(frozen=True)
class FunctionTokenEmbedding:
    """A function of texts as a provider of (token, vector) pairs."""

    name: str
    function: Callable[[Sequence[str]], Sequence[Sequence[tuple[str, Sequence[float]]]]]

    def token_embed(self, texts: Sequence[str]) -> Sequence[Sequence[tuple[str, Sequence[float]]]]:
        return self.function(texts)


def _each(given: Sequence[str], made: Sequence, what: str) -> Sequence:
    if len(made) != len(given):
        raise ContractError(f"{what} gave {len(made)} results for {len(given)} inputs")
    return made


def answers(prompts: Sequence[str | None], runner: PromptRunner) -> list[str | None]:
    """A response for each prompt; null prompts get none."""
    given = [p for p in prompts if p is not None]
    made = iter(_each(given, runner.run(given), "the runner") if given else ())
    return [None if p is None else next(made) for p in prompts]


def run_prompts(rows: DataFrame, runner: PromptRunner, prompt_col: str = "prompt") -> DataFrame:
    """``rows`` with ``response``; null prompts get none."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            prompts = x[prompt_col].astype(object).where(x[prompt_col].notna(), None).tolist()
            yield x.assign(response=pd.Series(answers(prompts, runner), index=x.index, dtype=object))

    return rows.mapInPandas(batches, rows.drop("response").schema.add("response", "string"))


def embedding_batch(rows: DataFrame, provider: EmbeddingProvider, id_col: str, text_col: str, subject_kind: str) -> DataFrame:
    """Rows of ``embeddings``, one a text that isn't null."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            texts = x["text"].tolist()
            v = [list(map(float, e)) for e in _each(texts, provider.embed(texts), provider.name)] if texts else []
            yield pd.DataFrame({"subject_id": x["subject_id"], "subject_kind": subject_kind, "provider": provider.name, "text": texts, "dim": pd.Series(map(len, v), dtype="int32", index=x.index), "embedding": pd.Series(v, dtype=object, index=x.index)})

    given = rows.selectExpr(f"cast(`{id_col}` as string) as subject_id", f"`{text_col}` as text").where("text IS NOT NULL")
    return given.mapInPandas(batches, "subject_id string, subject_kind string, provider string, text string, dim int, embedding array<float>")


def token_embedding_batch(rows: DataFrame, provider: TokenEmbeddingProvider, id_col: str, text_col: str, subject_kind: str) -> DataFrame:
    """Rows of ``token_embeddings``; tokens count from zero, and a text's block bears its subject's id."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            texts = x["text"].tolist()
            made = _each(texts, provider.token_embed(texts), provider.name) if texts else []
            out = [(s, s, subject_kind, provider.name, i, t, len(e), list(map(float, e))) for s, tokens in zip(x["subject_id"], made, strict=True) for i, (t, e) in enumerate(tokens)]
            yield pd.DataFrame(out, columns=["block_id", "subject_id", "subject_kind", "provider", "token_index", "token", "dim", "embedding"])

    given = rows.selectExpr(f"cast(`{id_col}` as string) as subject_id", f"`{text_col}` as text").where("text IS NOT NULL")
    return given.mapInPandas(batches, "block_id string, subject_id string, subject_kind string, provider string, token_index int, token string, dim int, embedding array<float>")
