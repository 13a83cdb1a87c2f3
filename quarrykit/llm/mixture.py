"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection.

A text that stands in several sources is one unit that any of them can use; the second copy of a
text in a source is a unit of its own, and so on, so that each document belongs to one unit and can
be drawn.  Units are aggregated by the set of a plan's sources they belong to; per plan a min-cost
flow routes the patterns' tokens to the sources' quotas, where each further use of a unit costs more.
The units of a pattern lie on a line in seeded order, once per repetition, and each source gets an
interval of that line.

Defined results: texts that are null or have no tokens are never drawn, but null and unplanned
sources count in the size of all documents; a source with weight zero or without documents
appears in the shares with what it gets; a null ``max_repeats`` is no cap; a plan whose sources are
all short reaches less than its budget, and the shares are those of what was reached.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm import tokens
from quarrykit.session import cut

SEED = 7
#: Units in a bucket of the seeded order, on average.
BUCKET = 1000
#: Parts into which the copies of one text in one source are split while they are numbered.
SALTS = 64
#: Membership patterns of a plan that are routed in one task; they are sets of sources, not of documents.
PATTERNS = 20_000


def units(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **tokenizer: str) -> DataFrame:
    """(unit, tokens, members): units with their size and, per source, the document; cut by a checkpoint."""
    sizes = tokens.sizes(docs, id, text, **tokenizer).select(F.col(id).alias("_q_id"), "tokens")
    rows = docs.select(F.col(id).alias("_q_id"), F.xxhash64(F.col(id)).alias("_q_o"), F.unhex(F.sha2(F.col(text), 256)).alias("key"), F.col(source).alias("source")).join(sizes, "_q_id")
    rows = rows.where("tokens > 0").withColumn("salt", F.pmod(F.col("_q_o"), F.lit(SALTS)))
    # the number of a copy: its place within its salt, behind all copies of the salts before
    part = Window.partitionBy("key", "source", "salt").orderBy("_q_o", "_q_id")
    counts = rows.groupBy("key", "source", "salt").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("key", "source").orderBy("salt")) - F.col("held")
    counts = counts.select(F.col("key").alias("k"), F.col("source").alias("s"), F.col("salt").alias("t"), before.alias("before"))
    same = (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t"))
    rows = rows.withColumn("copy", F.row_number().over(part)).join(counts, same).withColumn("copy", F.col("copy") + F.col("before"))
    # a unit has at most one document of each source
    found = rows.groupBy("key", "copy").agg(F.min("_q_id").alias("unit"), F.max("tokens").alias("tokens"), F.collect_list(F.struct("source", F.col("_q_id").alias("doc"))).alias("members"))
    return cut(found.select("unit", "tokens", "members"))


def flow(supply: list[int], access: list[dict[int, int | None]], quota: list[int]) -> list[dict[int, int]]:
    """Tokens that each pattern gives to each source: as much of the quotas as possible at least cost.

    ``supply``: size of each pattern; ``access``: per pattern its sources with the most repetitions;
    ``quota``: of each source.  Only uses cost, the r-th use of a pattern r - 1, so the cheapest
    augmenting path begins at the least used pattern from which some quota can still be filled, by
    giving tokens directly or by passing on those of other patterns.
    """
    n, m = len(supply), len(quota)
    room = [{s: quota[s] if c is None else min(quota[s], c * supply[p]) for s, c in access[p].items()} for p in range(n)]
    given: list[dict[int, int]] = [dict.fromkeys(a, 0) for a in access]
    users: list[list[int]] = [[p for p in range(n) if s in access[p]] for s in range(m)]
    left, used = list(quota), [0] * n

    def ways() -> tuple[dict[int, int], dict[int, tuple[int, int] | None]]:
        """Per pattern that can reach an open quota its next source; per source the pattern that could give way."""
        by: dict[int, int] = {}
        give: dict[int, tuple[int, int] | None] = {s: None for s in range(m) if left[s] > 0}
        todo = list(give)
        while todo:
            s = todo.pop(0)
            for p in users[s]:
                if p not in by and room[p][s] > given[p][s]:
                    by[p] = s
                    for t, x in given[p].items():
                        if x > 0 and t not in give:  # what p gives to t could go to s, and t take from others
                            give[t] = (p, s)
                            todo.append(t)
        return by, give

    while True:
        by, give = ways()
        able = [p for p in by if supply[p] > 0]
        if not able:
            return [{s: x for s, x in g.items() if x > 0} for g in given]
        level = {p: used[p] // supply[p] for p in able}
        p = min(able, key=lambda p: (level[p], p))
        # the pattern stays the cheapest until it is used as often as the next one, at least for one use
        others = min((level[x] for x in able if x != p), default=None)
        most = None if others is None else max(others, level[p] + 1) * supply[p] - used[p]
        steps, s = [(p, by[p], 1)], by[p]
        while give[s] is not None:
            q, t = give[s]
            steps += [(q, s, -1), (q, t, 1)]
            s = t
        amount = min([left[s], *([] if most is None else [most])] + [room[a][b] - given[a][b] if sign > 0 else given[a][b] for a, b, sign in steps])
        for a, b, sign in steps:
            given[a][b] += sign * amount
        used[p] += amount
        left[s] -= amount


_ROUTE = "plan_id string, pattern string, size bigint, source string, low bigint, high bigint"


def _route(key: tuple, patterns: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """The intervals of one plan's sources on the lines of its patterns."""
    targets = targets.rename(columns=lambda c: c.removeprefix("t_")).sort_values("source")
    sources = targets["source"].tolist()
    caps = {s: None if pd.isna(c) else int(c) for s, c in zip(sources, targets["max_repeats"])}
    if len(patterns) > PATTERNS:
        raise ValueError(f"plan {key[0]} has more than {PATTERNS} membership patterns")
    patterns = patterns.sort_values("pattern")
    place = {s: i for i, s in enumerate(sources)}
    access = [{place[s]: caps[s] for s in names} for names in patterns["names"]]
    got = flow([int(x) for x in patterns["size"]], access, [int(x) for x in targets["quota"]])
    rows = []
    for name, size, given in zip(patterns["pattern"], patterns["size"], got):
        low = 0
        for s in sorted(given):
            rows.append((key[0], name, int(size), sources[s], low, low + given[s]))
            low += given[s]
    return pd.DataFrame(rows, columns=["plan_id", "pattern", "size", "source", "low", "high"])


def selection(found: DataFrame, plans: DataFrame, targets: DataFrame, total: int, seed: int = SEED) -> DataFrame:
    """(plan_id, source, doc_id, tokens, times): the drawn units, and how often each stands in the mixture."""
    quotas = quota(plans, targets, total).drop("share")
    # membership by way of the sources: targets are a small fixed table
    links = found.select("unit", "tokens", F.explode("members.source").alias("source")).join(F.broadcast(quotas.select("plan_id", "source")), "source")
    member = links.groupBy("plan_id", "unit", "tokens").agg(F.array_sort(F.collect_set("source")).alias("names")).withColumn("pattern", F.to_json("names"))
    patterns = member.groupBy("plan_id", "pattern", "names").agg(F.sum("tokens").alias("size"), F.count("*").alias("n"))
    aims = quotas.select(*[F.col(c).alias("t_" + c) for c in ("plan_id", "source", "max_repeats", "quota")])
    routes = patterns.groupBy("plan_id").cogroup(aims.groupBy("t_plan_id")).applyInPandas(_route, _ROUTE)
    # the place of each unit on its pattern's line: sums of buckets, then sums within a bucket
    order = F.xxhash64(F.lit(seed), "unit")
    buckets = F.greatest(F.ceil(F.col("n") / BUCKET), F.lit(1))
    placed = member.join(patterns.select("plan_id", "pattern", "n"), ["plan_id", "pattern"]).withColumn("order", order)
    placed = placed.withColumn("bucket", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets))
    sums = placed.groupBy("plan_id", "pattern", "bucket").agg(F.sum("tokens").alias("held"))
    before = F.sum("held").over(Window.partitionBy("plan_id", "pattern").orderBy("bucket")) - F.col("held")
    within = F.sum("tokens").over(Window.partitionBy("plan_id", "pattern", "bucket").orderBy("order", "unit")) - F.col("tokens")
    line = placed.withColumn("within", within).join(sums.withColumn("before", before).drop("held"), ["plan_id", "pattern", "bucket"])
    drawn = line.withColumn("at", F.col("before") + F.col("within")).join(routes, ["plan_id", "pattern"])
    turns = lambda edge: F.ceil((F.col(edge) - F.col("at")) / F.col("size"))
    drawn = drawn.withColumn("times", (turns("high") - turns("low")).cast("bigint")).where("times > 0")
    docs = found.select("unit", F.inline("members"))
    return drawn.join(docs, ["unit", "source"]).select("plan_id", "source", F.col("doc").alias("doc_id"), "tokens", "times")


def quota(plans: DataFrame, targets: DataFrame, total: int) -> DataFrame:
    """(plan_id, source, weight, max_repeats, share, quota): the sources of each plan with their tokens."""
    rows = targets.groupBy("plan_id", "source").agg(F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.where(F.col("source").isNotNull()).join(F.broadcast(plans.groupBy("plan_id").agg(F.max("budget_ratio").alias("ratio"))), "plan_id")
    share = F.col("weight") / F.nullif(F.sum("weight").over(Window.partitionBy("plan_id")), F.lit(0.0))
    rows = rows.withColumn("share", F.coalesce(share, F.lit(0.0)))
    return rows.withColumn("quota", F.floor(F.col("share") * F.col("ratio") * F.lit(total)).cast("bigint")).drop("ratio")


def mixed(docs: DataFrame, plans: DataFrame, targets: DataFrame, seed: int = SEED, **tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The selection, and per plan and source the target and the reached share."""
    found = units(docs, **tokenizer)
    total = found.agg(F.sum(F.col("tokens") * F.size("members"))).first()[0] or 0
    drawn = selection(found, plans, targets, total, seed)
    reached = drawn.groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("reached"), F.count("*").alias("documents"), F.max("times").alias("most_times"))
    rows = quota(plans, targets, total).join(reached, ["plan_id", "source"], "left").fillna(0, ["reached", "documents", "most_times"])
    all_ = F.sum("reached").over(Window.partitionBy("plan_id"))
    shares = rows.select(
        "plan_id", "source", "max_repeats", F.col("share").alias("target_share"), F.col("quota").alias("target_tokens"), F.col("reached").alias("reached_tokens"),
        F.coalesce(F.col("reached") / F.nullif(all_, F.lit(0)), F.lit(0.0)).alias("reached_share"), "documents", "most_times",
    )
    return drawn, shares
