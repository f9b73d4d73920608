"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialize, scratch, shared_dir

__all__ = ["Memo", "fold", "fresh", "held_out", "materialize", "q", "scratch", "shared_dir", "table", "words_lower"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of ``sf_dir``, pruned to ``cols`` when some are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (case-insensitive)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> str:
    """``name`` quoted, so that dots and blanks in column names are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def fold(doc_id, folds: int):
    """The fold of an id; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def held_out(doc_id, folds: int):
    """True for ids in the fold that training must not see."""
    return fold(doc_id, folds) == 0


def words_lower(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z in lower case.  ``bytes`` methods do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Memo(dict):
    """Results by text, for corpora in which many texts are copies.

    Keys are 128-bit digests, so no text is held; beyond ``size`` results all are forgotten.
    """

    def __init__(self, compute: Callable, size: int = 50_000):
        self.compute, self.size = compute, size

    def __call__(self, text: str | None):
        if not text:
            return self.compute(text)
        key = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
        if key not in self:
            if len(self) >= self.size:
                self.clear()
            self[key] = self.compute(text)
        return self[key]
