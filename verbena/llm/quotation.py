"""Chat formatting by quotation linking.

Lines that start with ``>`` are quotes; the number of marks is the level.  Quoted passages (runs of
lines of one level) and their lines are normalised and hashed, and join the message of the same
conversation that first said the same in its own words.  A message replies to the earlier message to
which most of its first-level quotes lead.  Threads come from pointer jumping over those replies, and
the result is reply-ordered: by conversation, by the thread's first turn, then each message before the replies to
it and these, each with all that follows from it, by turn.  ``position`` numbers a thread's messages so, from 0, and
outlasts any storage; texts have their quotes taken out.

Joins are on (conversation, hash) against one row per hash, found by partial aggregation, so a line that
very many messages share is split by adaptive skew handling, and never meets itself in pairs.  The order
is a range partitioning that cuts through a large conversation.

Positions need no thread in one task.  A message's follower is its first reply or else the next reply beside its
nearest ancestor (itself included) that has one; that ancestor comes out of the same pointer jumping.  Followers
make each thread a list, and jumping along it backwards counts what comes before a message.  Each message has one
follower and one forerunner, so these joins have no hot key.  Replies to one message are put in order by spans of turns.

Defined results: a null text counts as empty and stays null; null conversations are one conversation;
null turns come first and never are quoted; of rows that repeat a turn the first as read is the
original; quotes without an original are taken out and link to nothing; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, materialize, q

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
# Lines that introduce a quote in the languages at hand: how they begin and end (fixed values), or the verb that they hold.
_INTRO_ENDS = {"on ": "wrote", "le ": "a écrit", "el ": "escribió"}
_INTRO_HOLDS = {"am ": re.compile(r"\bschrieb")}

PARSED = T.StructType([
    T.StructField("own", T.StringType()), T.StructField("own_hashes", T.ArrayType(T.LongType())),
    T.StructField("quotes", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("passage", T.IntegerType()), T.StructField("hash", T.LongType())]))),
])


def quote_level(line: str) -> tuple[int, str]:
    """Quote level of a line and what follows its marks."""
    m = _MARKS.fullmatch(line)
    return (m[1].count(">"), m[2]) if m else (0, line)


def introduces(line: str) -> bool:
    """Whether a line introduces a quote, as ``On Monday x wrote:`` does."""
    head = line.strip()
    if not head.endswith(":"):
        return False
    head = head[:-1].rstrip().lower()
    verb = _INTRO_ENDS.get(head[:3])
    if verb:
        before = head[-len(verb) - 1 : -len(verb)]
        return head.endswith(verb) and len(head) >= 3 + len(verb) and not (before.isalnum() or before == "_")
    holds = _INTRO_HOLDS.get(head[:3])
    return bool(holds and holds.search(head, 3))


def normalised(text: str) -> str:
    return " ".join(text.split()).lower()


def passage_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42) - (1 << 63)


def parse(text: str | None) -> tuple:
    """(own text, hashes of what it says itself, (level, passage, hash) of what it quotes)."""
    if not text:
        return text, [], []
    lines = [quote_level(x) for x in text.split("\n")]
    runs: list[tuple[int, list[str]]] = []
    for level, rest in lines:
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(rest)
    own_lines, quotes, n = [], [], 0
    for k, (level, part) in enumerate(runs):
        said = [x for x in map(normalised, part) if x]
        if level == 0:
            if k + 1 < len(runs) and part and introduces(part[-1]):
                part = part[:-1]
            own_lines += part
        elif said:
            quotes += [(level, n, passage_hash(x)) for x in dict.fromkeys([" ".join(said), *said])]
            n += 1
    own = "\n".join(own_lines) if any(level for level, _ in lines) else text
    own = own.strip("\n") if own is not text else text
    paragraphs = [" ".join(x for x in map(normalised, p.split("\n")) if x) for p in re.split(r"\n[ \t]*\n", own)]
    units = dict.fromkeys([*(normalised(x) for x in own.split("\n")), *paragraphs, " ".join(p for p in paragraphs if p)])
    return own, [passage_hash(x) for x in units if x], quotes


@F.pandas_udf(PARSED)
def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    memo = Memo(parse)
    for texts in batches:
        rows = [memo(t) for t in texts]
        yield pd.DataFrame({"own": [r[0] for r in rows], "own_hashes": [r[1] for r in rows], "quotes": [[{"level": a, "passage": b, "hash": c} for a, b, c in r[2]] for r in rows]})


def beside(replies: DataFrame, span: int = 512) -> DataFrame:
    """(n, parent, beside): the next reply to the same message by turn.  Replies to one message are ordered inside spans
    of turns; the last of a span is followed by the first of the next span that has any."""
    x = replies.withColumn("span", F.floor(F.col("turn") / span))
    heads = x.groupBy("parent", "span").agg(F.min(F.struct("turn", "n"))["n"].alias("head"))
    later = heads.select(F.col("parent").alias("hp"), F.col("span").alias("hs"), F.lead("head").over(Window.partitionBy("parent").orderBy("span")).alias("later"))
    x = x.withColumn("next", F.lead("n").over(Window.partitionBy("parent", "span").orderBy("turn", "n")))
    return x.join(later, (F.col("parent") == F.col("hp")) & (F.col("span") == F.col("hs"))).select("n", "parent", F.coalesce("next", "later").alias("beside"))


def positions(order: DataFrame, exits: DataFrame, max_rounds: int) -> DataFrame:
    """(n, position) of all replies; ``order`` is ``beside``'s, ``exits`` (n, exit) the ancestor beside which a branch goes on."""
    first = order.join(order.select(F.col("beside").alias("n")).where("n IS NOT NULL"), "n", "left_anti").select("n", F.col("parent").alias("before"))
    leaves = exits.join(order.select(F.col("parent").alias("n")), "n", "left_anti")
    after = leaves.join(order.where("beside IS NOT NULL").select(F.col("n").alias("exit"), "beside"), "exit").select(F.col("beside").alias("n"), F.col("n").alias("before"))
    state = materialize(first.unionByName(after).withColumn("position", F.lit(1).cast("long")), "followers")
    for _ in range(max_rounds):
        ahead = state.select(F.col("n").alias("an"), F.col("before").alias("ab"), F.col("position").alias("ap"))
        if not state.join(ahead, F.col("before") == F.col("an"), "left_semi").take(1):
            return state.select("n", "position")
        j = state.join(ahead, F.col("before") == F.col("an"), "left")
        state = materialize(j.select("n", F.coalesce("ab", "before").alias("before"), (F.col("position") + F.coalesce("ap", F.lit(0))).alias("position")), "followers")
    raise RuntimeError(f"positions did not settle in {max_rounds} rounds")


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_rounds: int = 40) -> DataFrame:
    """One row per message: conv_id, thread_turn, position, turn, reply_to, depth, role, text (without quotes),
    n_passages (quoted) and n_linked (those that led to an original)."""
    x = messages.select(F.col(q(conv)).alias("conv_id"), F.col(q(turn)).alias("turn"), F.col(q(role)).alias("role"), parsed(F.col(q(text))).alias("p"))
    x = materialize(x.select("conv_id", "turn", "role", "p.*", F.monotonically_increasing_id().alias("n")), "messages")
    quotes = x.select("conv_id", "turn", "n", F.explode("quotes").alias("u")).select("conv_id", "turn", "n", "u.*")
    quotes = materialize(quotes, "quotes")
    # Only passages that someone quotes are looked for.
    wanted = quotes.select(F.col("conv_id").alias("wc"), F.col("hash").alias("wh")).distinct()
    said = x.where("turn IS NOT NULL").select("conv_id", "turn", "n", F.explode("own_hashes").alias("hash"))
    said = said.join(wanted, F.col("conv_id").eqNullSafe(F.col("wc")) & (F.col("hash") == F.col("wh")), "left_semi")
    first = said.groupBy("conv_id", "hash").agg(F.min(F.struct("turn", "n")).alias("o")).select(F.col("conv_id").alias("oc"), F.col("hash").alias("oh"), "o")
    found = quotes.join(first, F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("hash") == F.col("oh")) & (F.col("o.turn") < F.col("turn")))
    votes = found.groupBy("n", "turn", F.col("o.n").alias("parent"), F.col("o.turn").alias("reply_to")).agg(F.count_if(F.col("level") == 1).alias("v"))
    chosen = votes.where("v > 0").groupBy("n", "turn").agg(F.max_by(F.struct("parent", "reply_to"), F.struct("v", "reply_to", "parent")).alias("r")).select("n", "turn", "r.*")
    chosen = materialize(chosen, "replies")
    order = materialize(beside(chosen), "beside")
    state = chosen.join(order.select("n", "beside"), "n")
    state = materialize(state.select("n", "reply_to", F.col("parent").alias("up"), F.col("parent").alias("root"), F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth"), F.when(F.col("beside").isNotNull(), F.col("n")).alias("exit")), "threads")
    for _ in range(max_rounds):
        above = state.select(F.col("n").alias("an"), F.col("up").alias("aup"), F.col("root").alias("aroot"), F.col("root_turn").alias("at"), F.col("depth").alias("ad"), F.col("exit").alias("ae"))
        if not state.join(above, F.col("up") == F.col("an"), "left_semi").take(1):
            break
        j = state.join(above, F.col("up") == F.col("an"), "left")
        state = materialize(j.select("n", "reply_to", F.coalesce("aup", "up").alias("up"), F.coalesce("aroot", "root").alias("root"), F.coalesce("at", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("ad", F.lit(0))).alias("depth"), F.coalesce("exit", "ae").alias("exit")), "threads")
    else:
        raise RuntimeError(f"threads did not settle in {max_rounds} rounds")
    counts = quotes.groupBy("n").agg(F.countDistinct("passage").alias("n_passages"))
    linked = found.groupBy("n").agg(F.countDistinct("passage").alias("n_linked"))
    placed = state.select("n", "reply_to", "root", "root_turn", "depth").join(positions(order, state.select("n", "exit"), max_rounds), "n")
    out = x.join(placed, "n", "left").join(counts, "n", "left").join(linked, "n", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = out.orderBy("conv_id", F.coalesce("root_turn", "turn"), F.coalesce("root", "n"), F.coalesce("position", F.lit(0)))
    return out.select("conv_id", F.coalesce("root_turn", "turn").alias("thread_turn"), zero("position"), "turn", "reply_to", zero("depth"), "role", F.col("own").alias("text"), zero("n_passages"), zero("n_linked"))
