"""Mixing sources to target weights by pivotal rounding of fractional copies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.plans.lineage import cut
from spanloom.sources.tables import latest_by

#: Documents of one source that a first-level group holds on average.
LEAF = 4_096
#: Residuals combined at once on each further level.
FAN = 64
SEED = 20_011


def _draws(ids: np.ndarray, level: int) -> np.ndarray:
    """A number in [0, 1) for each id and level, the same in every run (splitmix64)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED + level * 7919)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def pivot(ids: np.ndarray, sizes: np.ndarray, parts: np.ndarray, level: int = 0) -> np.ndarray:
    """Copies in [0, 1] for fractional ``parts``, integral but for at most one of them.

    Two open documents at a time: mass moves from one to the other, in tokens, so that the sum of size times copies
    stays, until one of them has no or a whole copy. Which way is drawn so that each document's expectation stays.
    Documents of no tokens can't carry mass and are rounded by a draw of their own.
    """
    out = parts.astype(np.float64).copy()
    draw = _draws(ids, level)
    open_ = -1
    for k in range(len(out)):
        p = out[k]
        if sizes[k] <= 0:
            out[k] = float(draw[k] < p) if 0 < p < 1 else p
            continue
        if not 1e-12 < p < 1 - 1e-12:
            out[k] = round(p)
            continue
        if open_ < 0:
            open_ = k
            continue
        i, s, t = open_, float(sizes[open_]), float(sizes[k])
        a, b = out[i], p
        give = min((1 - a) * s, b * t)  # tokens that k can give to i
        take = min(a * s, (1 - b) * t)  # tokens that i can give to k
        if draw[k] < take / (give + take):
            a, b = a + give / s, b - give / t
        else:
            a, b = a - take / s, b + take / t
        a, b = (float(round(x)) if abs(x - round(x)) < 1e-9 else x for x in (a, b))
        out[i], out[k] = a, b
        open_ = i if 0 < a < 1 else k if 0 < b < 1 else -1
    return out


def _round_group(level: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        ids = group["doc_id"].to_numpy()
        parts = pivot(ids, group["n_tokens"].to_numpy(), group["part"].to_numpy(), level)
        if last:
            rest = (parts > 0) & (parts < 1)
            parts = np.where(rest, (_draws(ids, 1_000) < parts).astype(float), parts)
        return group.assign(part=parts)

    return run


def plan_shares(stats: list, targets: list, size: float | None) -> dict:
    """Of each usable source: share of the mix, tokens wanted and fractional copies of each document.

    ``size`` None: the largest mix in which every usable source can have its share within its cap. A source without
    tokens, weight or repeats is not usable; its weight is spread over the others in proportion to their weights.
    """
    wanted: dict = {}
    for t in sorted(targets, key=lambda t: (-(t["weight"] or 0.0), -(t["max_repeats"] or 0))):
        if t["source"] is not None and t["weight"] and t["weight"] > 0 and (t["max_repeats"] or 0) > 0:
            wanted.setdefault(t["source"], (float(t["weight"]), int(t["max_repeats"])))
    have = {s["source"]: s for s in stats if s["source"] in wanted and (s["tokens"] or 0) > 0}
    total = sum(wanted[s][0] for s in have)
    if not have:
        return {}
    limit = min(wanted[s][1] * have[s]["tokens"] * total / wanted[s][0] for s in have)
    mix = limit if size is None else size
    plan = {}
    for s, row in have.items():
        share = wanted[s][0] / total
        times = min(share * mix / row["tokens"], float(wanted[s][1]))
        plan[s] = {"share": share, "tokens": times * row["tokens"], "times": times, "groups": max(1, math.ceil(row["docs"] / LEAF))}
    return plan


def _choose(source: Column, plan: dict, field: str, default) -> Column:
    found = F.lit(default)
    for name, entry in plan.items():
        found = F.when(source == name, F.lit(entry[field])).otherwise(found)
    return found


def mix_copies(sized: DataFrame, targets: DataFrame, size: float | None = None) -> tuple[DataFrame, dict]:
    """Copies of each document in the mix, and the plan.

    ``sized`` has doc_id, source, n_tokens, one row for each document; ``targets`` has source, weight, max_repeats and
    is of fixed size (one row a source; of repeated rows that of the greatest weight, then cap, counts). Result: doc_id, source, n_tokens, copies, for
    every document whose source is usable. No document has more than max_repeats copies, because the fraction is
    rounded to the whole number below or above it. Documents with a null source or id or one without target take no
    part; empty documents have copies like others but no tokens; empty tables give no rows.

    Method: documents of a source fall into groups by a hash of their id (a source of any size is spread); each group
    is rounded by pivotal sampling and leaves at most one open document; the open ones are combined 64 groups at a
    time, level by level, until one is left for each source, which is drawn.
    """
    sized = cut(sized.filter(F.col("doc_id").isNotNull() & F.col("source").isNotNull()))
    stats = sized.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()
    plan = plan_shares(stats, targets.collect(), size)
    source = F.col("source")
    rows = sized.filter(source.isin(list(plan))) if plan else sized.filter(F.lit(False))
    times = _choose(source, plan, "times", 0.0)
    rows = rows.withColumn("base", F.floor(times + F.lit(1e-12)).cast("int"))
    rows = rows.withColumn("part", F.greatest(F.lit(0.0), times - F.col("base"))).withColumn("grp", F.pmod(F.xxhash64("doc_id"), _choose(source, plan, "groups", 1).cast("long")))
    schema = "doc_id bigint, source string, n_tokens bigint, base int, part double, grp bigint"
    rows = rows.select("doc_id", "source", "n_tokens", "base", "part", "grp")
    groups, level, whole = max([p["groups"] for p in plan.values()], default=1), 0, []
    while True:
        done = cut(rows.groupBy("source", "grp").applyInPandas(_round_group(level, groups == 1), schema))
        is_open = (F.col("part") > 0) & (F.col("part") < 1)
        whole.append(done.filter(~is_open))
        if groups == 1:
            break
        rows = done.filter(is_open).withColumn("grp", F.floor(F.col("grp") / FAN).cast("long"))
        groups, level = math.ceil(groups / FAN), level + 1
    found = whole[0]
    for more in whole[1:]:
        found = found.unionByName(more)
    return found.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("part").cast("int")).alias("copies")), plan


def share_report(copies: DataFrame, targets: DataFrame, plan: dict) -> DataFrame:
    """Of each target: weight, cap, documents and tokens there are, tokens wanted and taken, and the share they make."""
    source = F.col("source")
    taken = copies.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.sum("copies").alias("copies"),
        F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("taken_tokens"),
    )
    goals = targets.filter(source.isNotNull()).groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    # One row a target, of which there is a fixed number, so one task can hold them.
    report = goals.join(taken, "source", "left").withColumn("_all", F.sum("taken_tokens").over(Window.partitionBy(F.lit(1))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return report.select(
        "source", "weight", "max_repeats", zero("docs"), zero("tokens"), zero("copies"), zero("most_copies"),
        F.round(_choose(source, plan, "tokens", 0.0)).cast("bigint").alias("wanted_tokens"), zero("taken_tokens"),
        F.round(_choose(source, plan, "share", 0.0), 6).alias("wanted_share"),
        F.round(F.coalesce(F.try_divide("taken_tokens", "_all"), F.lit(0.0)), 6).alias("actual_share"),
    )


def sized_documents(docs: DataFrame, counted: Column) -> DataFrame:
    """doc_id, source, n_tokens: counted first, so that only numbers are shuffled; the latest row of an id counts."""
    rows = docs.select("doc_id", "source", counted.alias("n_tokens"), "added_at")
    return latest_by(rows, ["doc_id"], ["source", "n_tokens"], "added_at")
