"""Mixing of sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact token length). For every source the budget is met by whole passes
over all its documents, then by a quota of documents of each length, then by a bounded-knapsack dynamic
program for what is left, and last by taking, within each length, the documents first in a seeded order.
A source whose last pass cannot meet its budget, as one of a few documents, uses them less evenly, within
its repeats.

Only length counts reach the driver, one a distinct length of a source of the target table. k distinct
lengths need k * k / 2 tokens at least, so they grow at most as the root of a source's tokens. Long documents
take part in quota and knapsack like all others.
"""

from __future__ import annotations

import math
import random
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftmark.llm.tokenize import encode_texts
from weftmark.runtime import materialize

WINDOW = 8192
SLACK = 65536  # tokens of a source's budget that the knapsack fills
SLICES = 1024
CELLS = 2_000_000_000  # bits that the sums of a knapsack larger than the slack may take


def fit_budget(counts: dict[int, int], budget: int, slack: int = SLACK, seed: int = 0) -> dict[int, int]:
    """How many documents of each length to take so that the lengths sum to ``budget``, or as near below as can be.

    ``counts``: documents available by length (1 or more). All but ``slack`` of the budget goes to the lengths in
    proportion, the rounding carried from length to length; the rest is filled by a bounded-knapsack program
    over what is still free, in a seeded order of the lengths. A budget up to ``slack`` is met as well as any
    choice can meet it. The quota leaves less than ``slack`` and the longest length; a knapsack over more than
    ``slack`` stops adding lengths at CELLS bits. All sums are exact integers.
    """
    total = sum(length * n for length, n in counts.items())
    if budget >= total:
        return dict(counts)
    taken, want, have, share = {}, 0, 0, max(0, budget - slack)
    for length in sorted(counts, reverse=True):
        want += length * counts[length]
        due = share * want // total - have
        taken[length] = min(counts[length], max(0, due // length))
        have += taken[length] * length
    rest = budget - have
    # sums reachable with the first i groups as bits of one integer; groups double, so n copies take log n groups
    groups, reach = [], [1]
    mask = (1 << (rest + 1)) - 1
    most = CELLS // (rest + 1) if rest > slack else math.inf
    order = sorted(counts)
    random.Random(seed).shuffle(order)
    for length in order:
        free, step = min(counts[length] - taken[length], rest // length), 1
        while free > 0 and not reach[-1] >> rest & 1 and len(reach) < most:
            step = min(step, free)
            more = (reach[-1] | reach[-1] << (length * step)) & mask
            if more != reach[-1]:
                groups.append((length, step))
                reach.append(more)
            free -= step
            step *= 2
    at = reach[-1].bit_length() - 1
    for (length, step), before in zip(reversed(groups), reversed(reach[:-1])):
        if not before >> at & 1:
            taken[length] += step
            at -= length * step
    return taken


def fit_repeats(counts: dict[int, int], whole: int, rest: int, most: int, slack: int = SLACK, seed: int = 0) -> dict[int, int]:
    """Copies of each length beyond ``whole`` passes, fewer if negative, so that they come to ``rest`` or as near below as can be.

    First each document is used ``whole`` times or once more. Only while that misses ``rest`` may uses differ by
    more, up to all from 0 to ``most``; the narrowest range that comes nearest is taken. Each range is filled by
    ``fit_budget``, as near as that can.
    """
    total = sum(length * n for length, n in counts.items())
    least = (whole * total + rest) % math.gcd(*counts)  # no choice leaves less
    best, missed, spread = {}, math.inf, 0
    while True:
        low, high = max(0, whole - spread), min(most, whole + 1 + spread)
        budget = rest + (whole - low) * total
        taken = fit_budget({length: n * (high - low) for length, n in counts.items()}, budget, slack, seed)
        short = budget - sum(length * n for length, n in taken.items())
        if short < missed:
            best, missed = {length: n - (whole - low) * counts[length] for length, n in taken.items()}, short
        if missed == least or (low, high) == (0, most):
            return best
        spread = 2 * spread or 1


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total_tokens: int | None = None) -> dict[str, tuple[int, int]]:
    """(whole passes, budget left for one further pass) of each source.

    ``targets``: weight and most repeats. Sources without tokens or weight get none, and the weights of the
    others are taken in proportion. Without ``total_tokens`` the mixture is the largest in which every such
    source reaches its share; with it, a source that cannot is used as often as allowed.
    """
    usable = {s: (Fraction(str(w)), r) for s, (w, r) in targets.items() if w and w > 0 and r and r > 0 and sizes.get(s, 0) > 0}
    if not usable:
        return {}
    weight = sum(w for w, _ in usable.values())
    most = min(sizes[s] * r * weight / w for s, (w, r) in usable.items())
    total = most if total_tokens is None else Fraction(total_tokens)
    out = {}
    for s, (w, r) in usable.items():
        budget = min(math.floor(total * w / weight), sizes[s] * r)
        out[s] = divmod(budget, sizes[s])
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | None = None, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) of a mixture.

    ``documents``: doc_id, source, text. ``targets``: source, weight, max_repeats, one row a source (a fixed,
    short table). Selection: (doc_id, source, n_tokens, copies) with copies from 1 to max_repeats. Shares:
    (source, weight, available_tokens, target_tokens, tokens, documents, share), one row a target source.
    Documents of no target source, of null source, or without tokens are not selected. Equal lengths are
    ordered by a seeded hash of doc_id, then doc_id. ``window`` has no effect: every length is counted exactly.
    """
    spark = documents.sparkSession
    wanted = {r["source"]: (r["weight"], r["max_repeats"]) for r in targets.collect() if r["source"] is not None}
    named = documents.filter(F.col("source").isin(list(wanted)))
    sized = materialize(
        encode_texts(named.select(F.struct("doc_id", "source").alias("key"), "text"), "key", counts_only=True)
        .filter("n_tokens > 0")
        .select("key.doc_id", "key.source", "n_tokens")
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
        .withColumn("slice", F.pmod("order", F.lit(SLICES)).cast("int"))
    )
    rows = sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).collect()
    by_source: dict[str, dict[int, int]] = {}
    for r in rows:
        by_source.setdefault(r["source"], {})[r["n_tokens"]] = r["n"]
    sizes = {s: sum(length * n for length, n in counts.items()) for s, counts in by_source.items()}
    passes = plan(sizes, wanted, total_tokens)
    quota = [
        (s, length, *divmod(n, by_source[s][length]))
        for s, (w, rest) in passes.items() for length, n in fit_repeats(by_source[s], w, rest, wanted[s][1], seed=seed).items() if n
    ]
    quotas = spark.createDataFrame(quota, "source string, n_tokens long, more long, quota long")
    whole = spark.createDataFrame([(s, w) for s, (w, _) in passes.items()], "source string, whole long")
    # rank in the seeded order without one task a length: ranks within slices, and counts of the slices before
    per_slice = sized.groupBy("source", "n_tokens", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_slice.select("source", "n_tokens", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    in_slice = F.row_number().over(Window.partitionBy("source", "n_tokens", "slice").orderBy("order", "doc_id"))
    selection = materialize(
        sized.withColumn("at", in_slice)
        .join(offsets, ["source", "n_tokens", "slice"])
        .join(F.broadcast(whole), "source")
        .join(F.broadcast(quotas), ["source", "n_tokens"], "left")
        .withColumn("copies", F.col("whole") + F.coalesce("more", F.lit(0)) + (F.col("at") + F.col("before") <= F.coalesce("quota", F.lit(0))).cast("long"))
        .filter("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    goal = spark.createDataFrame(
        [(s, float(w) if w is not None else None, sizes.get(s, 0), passes[s][0] * sizes[s] + passes[s][1] if s in passes else 0) for s, (w, _) in wanted.items()],
        "source string, weight double, available_tokens long, target_tokens long",
    )
    used = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"))
    everything = selection.agg(F.sum(F.col("n_tokens") * F.col("copies"))).scalar()
    shares = goal.join(used, "source", "left").select(
        "source", "weight", "available_tokens", "target_tokens",
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"),
        (F.coalesce("tokens", F.lit(0)) / everything).alias("share"),
    )
    return selection, shares
