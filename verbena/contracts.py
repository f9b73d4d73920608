"""Relation contracts: a relation is accepted as a whole or rejected with the first rule it breaks."""

from __future__ import annotations

import functools
import inspect
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A relation breaks its contract."""


def identifier(name: str, what: str = "prefix") -> str:
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ContractError(f"{what} must be a valid identifier")
    return name


def takes_tables(f: Callable) -> Callable:
    """``f`` with table names taken wherever it asks for a DataFrame; a name may be qualified by dots."""
    signature = inspect.signature(f)
    relations = [n for n, p in signature.parameters.items() if "DataFrame" in str(p.annotation)]

    @functools.wraps(f)
    def named(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        for n in relations:
            if isinstance(given := bound.arguments.get(n), str):
                for part in given.split("."):
                    identifier(part, n)
                bound.arguments[n] = SparkSession.active().table(given)
        return f(*bound.args, **bound.kwargs)

    return named


def columns(df: DataFrame, required: Sequence[str], what: str) -> None:
    if missing := [c for c in required if c not in df.columns]:
        raise ContractError(f"{what} is missing columns: {', '.join(missing)}")


def typed(df: DataFrame, names: Sequence[str], kinds: tuple, what: str) -> None:
    for c in names:
        if not isinstance(df.schema[c].dataType, kinds):
            raise ContractError(f"{what}.{c} has type {df.schema[c].dataType.simpleString()}")


def with_defaults(df: DataFrame, defaults: dict[str, T.DataType]) -> DataFrame:
    """``df`` with null columns added for the optional columns it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in defaults.items() if c not in df.columns})


def required_text(*names: str) -> list[tuple[str, Column]]:
    return [(f"{c} must be non-missing and non-empty text", F.coalesce(F.length(F.col(c)) == 0, F.lit(True))) for c in names]


def optional_text(*names: str) -> list[tuple[str, Column]]:
    return [(f"{c} must be missing or non-empty text", F.coalesce(F.length(F.col(c)) == 0, F.lit(False))) for c in names]


def offsets(start: str, end: str) -> list[tuple[str, Column]]:
    ok = (F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(start) == F.floor(start)) & (F.col(end) == F.floor(end))
    return [(f"{start} and {end} must be zero-based half-open offsets", ~F.coalesce(ok, F.lit(False)))]


def written_time(time: Column) -> Column:
    """A timestamp as text with milliseconds."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSS")


def check(df: DataFrame, rules: list[tuple[str, Column]], what: str) -> None:
    """All rules (message, violated) in one aggregation; raises for the first broken one in order."""
    row = df.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(str(n)) for n, (_, bad) in enumerate(rules))).first()
    for n, (message, _) in enumerate(rules):
        if row[n]:
            raise ContractError(f"{what}: {message} ({row[n]} rows)")


def unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    if df.groupBy(*keys).count().where("count > 1").take(1):
        raise ContractError(f"{what} must be unique by {', '.join(keys)}")


def unique_each(df: DataFrame, keys: Sequence[Sequence[str]], what: str) -> None:
    """Every list of ``keys`` is unique by itself; all are looked at in one shuffle of the rows' key hashes and keys."""
    sets = F.array(*(F.struct(F.lit(n).alias("n"), F.to_json(F.struct(*k), {"ignoreNullFields": "false"}).alias("key")) for n, k in enumerate(keys)))
    twice = df.select(F.explode(sets).alias("s")).groupBy("s.n", "s.key").count().where("count > 1").select("n").take(1)
    if twice:
        raise ContractError(f"{what} must be unique by {', '.join(keys[twice[0]['n']])}")


@dataclass(frozen=True)
class Relation:
    """What ``check_relations`` holds against a relation: rules of a row, lists of columns that are unique, keys that
    others may refer to and keys that must be among those; the latter two by a name and columns, a reference with its message."""

    df: DataFrame
    what: str
    rules: Sequence[tuple[str, Column]] = ()
    unique: Sequence[Sequence[str]] = ()
    held: Sequence[tuple[str, Sequence[str]]] = ()
    needed: Sequence[tuple[str, Sequence[str], str]] = ()


def check_relations(*relations: Relation) -> None:
    """All rules of all relations in one pass over each; raises for the first broken one in order.

    A row gives its keys and the rules that it breaks, keys meet in one shuffle, and a row a rule comes back.
    """
    messages: list[str] = []
    parts = []

    def tag(message: str) -> Column:
        messages.append(message)
        return F.lit(len(messages) - 1)

    names: dict[str, Column] = {}
    for r in relations:
        key = lambda columns: F.to_json(F.struct(*(F.col(c).alias(str(k)) for k, c in enumerate(columns))), {"ignoreNullFields": "false"})
        row = lambda n, k, own, other, bad: F.struct(n.cast("int").alias("n"), k.alias("key"), F.lit(own).alias("own"), F.lit(other).alias("other"), bad.alias("bad"))
        none, no = F.lit(None).cast("string"), F.lit(False)
        said = [row(tag(f"{r.what}: {m}"), none, 0, False, F.coalesce(bad, no)) for m, bad in r.rules]
        said += [row(tag(f"{r.what} must be unique by {', '.join(c)}"), key(c), 1, True, no) for c in r.unique]
        for name, c, message in r.needed:
            names[name] = tag(message)
            said.append(row(names[name], key(c), 0, False, no))
        said += [row(names.setdefault(name, tag("")), key(c), 0, True, no) for name, c in r.held]
        parts.append(r.df.select(F.explode(F.filter(F.array(*said), lambda s: s["bad"] | s["key"].isNotNull())).alias("s")).select("s.*"))
    rows = functools.reduce(DataFrame.unionByName, parts)
    met = rows.groupBy("n", "key").agg(F.sum("own").alias("own"), F.max("other").alias("other"), F.count_if("bad").alias("bad"))
    broken = F.when(F.col("key").isNull(), F.col("bad")).when((F.col("own") > 1) | ~F.col("other"), 1).otherwise(0)
    found = met.groupBy("n").agg(F.sum(broken).alias("broken")).where("broken > 0").orderBy("n").collect()
    if found:
        message, n = messages[found[0]["n"]], found[0]["broken"]
        raise ContractError(f"{message} ({n} rows)" if ": " in message else message)


def observed(df: DataFrame, rules: list[tuple[str, Column]], what: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df``, and a function that raises for the first rule which a row of it broke.

    The rows are looked at in the job that reads ``df``, all of them, whatever is filtered out behind; the function is to be called after that job.
    """
    seen = Observation()

    def verify() -> None:
        counts = seen.get
        for n, (message, _) in enumerate(rules):
            if counts[str(n)]:
                raise ContractError(f"{what}: {message} ({counts[str(n)]} rows)")

    return df.observe(seen, *(F.count_if(F.coalesce(bad, F.lit(False))).alias(str(n)) for n, (_, bad) in enumerate(rules))), verify


def contained(df: DataFrame, other: DataFrame, keys: Sequence[str], message: str) -> None:
    if df.join(other.select(*keys).distinct(), list(keys), "left_anti").take(1):
        raise ContractError(message)
