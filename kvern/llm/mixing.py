"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells (source, language, topic).  Raking scales the cells' token weights to
each dimension's target shares in turn, until all hold within a tolerance; a document is then sampled with a
probability in proportion to its cell's weight per token, scaled so that the expected tokens are the budget.  Where
targets contradict each other, or a cell has too few tokens, `margins` says what is reached instead.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvern.llm.util import written

NONE = "(none)"
#: Rounds at least; more follow, so many at a time, while a share is off by more than the tolerance, up to the most.
ROUNDS, TOLERANCE, MOST_ROUNDS = 8, 1e-3, 80
BUDGET = 0.5
#: Steps at least to find the scale of the chances; it is final when a step doesn't change it.
SCALING_STEPS = 8
#: Cells that are broadcast at most (about 100 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 50_000
#: Cells of one value of a dimension that one task may add up (by a window); with more cells sums are aggregated and joined.
WINDOW_CELLS = 500_000
#: A dimension's target: shares by value, or the power to which its shares in the corpus are raised.
TARGETS: dict[str, Mapping[str, float] | float] = {"source": 0.5, "lang": 0.7, "topic": {"legal": 0.05, "contact": 0.05, "symbols": 0.02, "prose": 0.88}}


def checked(targets: Mapping[str, Mapping[str, float] | float]) -> None:
    """Refuses what can't be a share or a power."""
    for dim, target in targets.items():
        shares = list(target.values()) if isinstance(target, Mapping) else [target]
        if not all(math.isfinite(x) for x in shares) or isinstance(target, Mapping) and any(x < 0 for x in shares):
            raise ValueError(f"targets: {dim} has a share below 0 or one that is no number")


def topic(text: Column) -> Column:
    """A topic by the first rule that the whole text meets; a null text is prose."""
    text = F.coalesce(text, F.lit(""))
    legal = reduce(lambda a, b: a | b, (F.contains(text, F.lit(s)) for s in ("License", "Copyright", "All rights reserved")))
    return F.when(legal, "legal").when(F.contains(text, F.lit("@")), "contact").when(F.contains(text, F.lit("###")), "symbols").otherwise("prose")


def tokens(text: Column) -> Column:
    """Words between blanks, plus one for the end of the text."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) + 1).cast("long")


def _target(cells: DataFrame, dim: str, target: Mapping[str, float] | float) -> DataFrame:
    """(dim, t): the dimension's shares, which add up to 1 over the values that there are."""
    own = cells.groupBy(dim).agg(F.sum("n_tokens").cast("double").alias("n"))
    total = cells.agg(F.sum("n_tokens").cast("double").alias("all"))
    own = own.crossJoin(F.broadcast(total))  # one row
    if isinstance(target, Mapping):
        fixed = F.create_map(*(F.lit(x) for item in target.items() for x in (item[0], float(item[1])))) if target else F.create_map().cast("map<string,double>")
        wanted = F.coalesce(fixed[F.col(dim)], F.col("n") / F.col("all"))
    else:
        wanted = F.pow(F.col("n") / F.col("all"), F.lit(float(target)))
    own = own.select(dim, wanted.alias("t"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("t").alias("s")))).select(dim, _over(F.col("t"), F.col("s")).alias(f"t_{dim}"))


def _over(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0: nothing of a value is wanted, or there is nothing of it."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (a column for each dimension, n_tokens) with `w`: weights that add up to 1 and meet the targets t_<dimension>.

    Values without a given share keep their own; a dimension's shares are scaled to add up to 1.  A share of 0 leaves its
    value out.  Targets that contradict each other are met as far as MOST_ROUNDS rounds go, with a warning.
    """
    checked(targets)
    state = cells
    for dim, target in targets.items():
        state = state.join(_target(cells, dim, target), dim)
    state = written(state.withColumn("w", F.col("n_tokens").cast("double")))
    few = state.count() <= WINDOW_CELLS
    done, off = 0, math.inf
    while done < rounds or off > tolerance and done < MOST_ROUNDS:
        for _ in range(max(1, rounds)):
            # Few cells are one task's work: a round needs no exchange, and its sorts are all that a plan holds.
            state = state.coalesce(1) if few else state
            for dim in targets:
                if few:
                    state = state.withColumn("w", _over(F.col("w"), F.sum("w").over(Window.partitionBy(dim))) * F.col(f"t_{dim}"))
                else:
                    sums = state.groupBy(dim).agg(F.sum("w").alias("s"))
                    state = written(state.join(sums, dim).withColumn("w", _over(F.col("w"), F.col("s")) * F.col(f"t_{dim}")).drop("s"))
            state = written(state) if few else state
        done, off = done + max(1, rounds), _residual(state, list(targets))
    if off > tolerance:
        logging.getLogger("kvern").warning("raking: after %d rounds a share is off by %.2g; the targets contradict each other", done, off)
    return state


def _residual(state: DataFrame, dims: list[str]) -> float:
    """By how much a share is off at most."""
    return max((state.groupBy(d).agg(F.abs(F.sum("w") - F.first(f"t_{d}")).alias("off")).agg(F.max("off")).first()[0] or 0.0 for d in dims), default=0.0)


def margins(chances: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, value, target, expected): the shares that were asked for, and those of the tokens that the chances `p` let one expect."""
    total = chances.agg(F.sum(F.col("p") * F.col("n_tokens")).alias("all"))
    each = [chances.groupBy(F.col(d).alias("value")).agg(F.first(f"t_{d}").alias("target"), F.sum(F.col("p") * F.col("n_tokens")).alias("n")).select(F.lit(d).alias("dimension"), "*") for d in dims]
    # One row of totals.
    return reduce(DataFrame.unionByName, each).crossJoin(F.broadcast(total)).select("dimension", "value", "target", _over(F.col("n"), F.col("all")).alias("expected"))


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """raked with `p`: the chance of a cell's documents, min(1, scale * w / n_tokens); expected tokens are budget * all tokens.

    Where a cell is exhausted (chance 1), the scale of the others makes up for it.
    """
    ratio = F.col("w") / F.col("n_tokens")
    total = raked.agg(F.sum("n_tokens")).first()[0] or 0
    scale = budget * total
    step = 0
    while True:
        full = scale * ratio >= 1
        got = raked.agg(F.sum(F.when(full, F.col("n_tokens"))), F.sum(F.when(~full, F.col("w")))).first()
        if not got[1]:
            break
        was, scale, step = scale, (budget * total - (got[0] or 0)) / got[1], step + 1
        # More cells are full after each step, until they stay the same.
        if abs(scale - was) <= 1e-12 * was or step >= SCALING_STEPS and scale < was:
            break
    return raked.withColumn("p", F.least(F.lit(1.0), F.lit(float(scale)) * ratio))


def luck(doc_id: Column, text: Column) -> Column:
    """0 to 1 by the MD5 of the id (of the text where that is null): the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), text, F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text", topic_column: str | None = None) -> DataFrame:
    """All rows and columns of docs, and __kvern_topic, __kvern_tokens, __kvern_weight (of its cell), __kvern_chance, __kvern_selected.

    A null source, language or topic is the value "(none)".  Repeated rows with one id share their luck.
    An empty table gives an empty one.
    """
    if not 0 < budget <= 1:
        raise ValueError("budget: above 0, 1 at most")
    text = F.col(text_column)
    made = docs.withColumn("__kvern_topic", F.col(topic_column) if topic_column else topic(text)).withColumn("__kvern_tokens", tokens(text))
    of = {dim: F.coalesce(F.col("__kvern_topic" if dim == "topic" else dim).cast("string"), F.lit(NONE)) for dim in targets}
    cells = written(made.groupBy(*(c.alias(dim) for dim, c in of.items())).agg(F.sum("__kvern_tokens").alias("n_tokens")))
    chances = written(probabilities(rake(cells, targets, rounds), budget).select(*(F.col(d).alias(f"__kvern_d_{d}") for d in targets), F.col("w").alias("__kvern_weight"), F.col("p").alias("__kvern_chance")))
    same = reduce(lambda a, b: a & b, (of[d] == F.col(f"__kvern_d_{d}") for d in targets))
    joined = made.join(F.broadcast(chances) if chances.count() <= BROADCAST_CELLS else chances, same)
    return joined.withColumn("__kvern_selected", luck(F.col(id_column), text) < F.col("__kvern_chance")).drop(*(f"__kvern_d_{d}" for d in targets))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, with its columns."""
    return mixed(docs, **options).where("__kvern_selected").select(*docs.columns)
