"""Temperature mixing: source weights from token shares raised to an exponent, realised as block permutations.

With token shares p, weights are ``p**a`` normalised. The exponent a is bisected between 0 (uniform) and 1
(as found): to the largest value whose weights reach a target entropy (a share of the greatest possible,
ln of the number of sources), or to the smallest whose weights repeat no source more often than allowed,
whichever asks for the larger exponent. Given a budget of tokens, source s gets ``budget * weight`` of them.

The documents of a source are dealt into blocks by a hash. A pass over a source is a permutation of its
blocks, drawn anew for each pass and source; whole passes take every block, the last, partial pass takes
blocks in order while the budget lasts and documents of the block at the cut in hashed order up to the
document that reaches it (equal rows come together). Only a source's block counts and the documents of one of
its blocks are sorted together, never all its documents.

A document's tokens are its white-space separated words (at least 1, so empty texts can be drawn); null
sources are one source of their own. An empty table gives an empty result. Rows repeat as they do in the
input; equal rows share a block and are taken together. Extra columns are kept, whatever their names, and columns
named like the outputs are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused

#: Blocks that the documents of each source are dealt into.
BLOCKS = 1024
SEED = 20_24
STEPS = 60


@dataclass(frozen=True)
class Mix:
    """What the weights of a mix have to meet.

    ``entropy``: least entropy as a share of the greatest possible. ``max_passes``: how often a document
    may be used. ``budget``: tokens of the result; None: the least with which no document is left out."""

    entropy: float | None = None
    max_passes: float | None = 4.0
    budget: float | None = None


def weights(tokens: dict[str | None, int], mix: Mix) -> tuple[dict[str | None, float], float]:
    """Weight of each source, and the exponent."""
    total = float(sum(tokens.values()))
    if not total:
        return {}, 1.0
    logs = {s: math.log(n / total) for s, n in tokens.items() if n}

    def at(a: float) -> dict[str | None, float]:
        raw = {s: math.exp(a * x) for s, x in logs.items()}
        return {s: x / sum(raw.values()) for s, x in raw.items()}

    def entropy_met(a: float) -> bool:
        w = at(a).values()
        return -sum(x * math.log(x) for x in w) >= mix.entropy * math.log(len(logs)) - 1e-12

    def passes_met(a: float) -> bool:
        w = at(a)
        return max(passes(tokens, w, mix).values()) <= mix.max_passes + 1e-9

    def bisect(met, low: float, high: float) -> float:
        """The exponent nearest to ``high`` for which ``met`` turns, seen from ``low``."""
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (middle, high) if met(middle) else (low, middle)
        return low

    exponent = 0.0
    if mix.entropy is not None:
        exponent = 1.0 if entropy_met(1.0) else bisect(entropy_met, 0.0, 1.0)
    if mix.max_passes is not None and not passes_met(exponent):
        exponent = bisect(passes_met, 1.0, exponent)
    return at(exponent), exponent


def passes(tokens: dict[str | None, int], w: dict[str | None, float], mix: Mix) -> dict[str | None, float]:
    """How often each source is passed over."""
    budget = mix.budget if mix.budget is not None else max(tokens[s] / x for s, x in w.items())
    return {s: budget * x / tokens[s] for s, x in w.items()}


def token_count(text: str = "text") -> Column:
    """White-space separated words of a text, at least 1."""
    return F.greatest(F.size(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+")), F.lit(1)).cast("long")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), seed: int = SEED) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` (doc_id, text, source) once for each use, with tokens, pass (0 for the first), block,
    order (by which a pass sorts its blocks) and weight of the source.

    Whole passes come before the partial one. One row per source reaches the driver and is broadcast: its weight,
    its whole passes, the order of the block at the cut and the draw of the document there. So the number of
    sources has to fit on the driver; blocks and documents never get there, and documents are not shuffled."""
    names = ("tokens", "pass", "block", "order", "weight")
    spark, kept = docs.sparkSession, docs.drop(*names).columns
    draw, source, whole, order_, last = unused([*kept, *names], "draw", "source_", "whole", "order_", "last")
    rows = docs.drop(*names).withColumns({"tokens": token_count(), draw: F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))})
    rows = rows.withColumn("block", F.pmod(F.xxhash64(draw), F.lit(BLOCKS)).cast("int"))

    def order(use: Column) -> Column:
        """A block's place in a pass: a hash, made unique by the block's number."""
        return F.xxhash64(F.lit(seed), F.col("source"), use, F.col("block")).bitwiseAND(F.lit(-BLOCKS)).bitwiseOR(F.col("block").cast("long"))

    narrow = stored(rows.select("source", "block", F.col(draw).alias("_draw"), "tokens"), "tokens")
    sizes = narrow.groupBy("source", "block").agg(F.sum("tokens").alias("n"))
    tokens = {r.source: r.n for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    w, _ = weights(tokens, mix)
    plan = [(s, w[s], int(p + 1e-9), max(0.0, p - int(p + 1e-9)) * tokens[s]) for s, p in (passes(tokens, w, mix) if w else {}).items()]
    told = spark.createDataFrame(plan, "source string, weight double, whole int, part double")

    # The block at the cut of each partial pass, and the last document of it that is taken.
    blocks = sizes.join(F.broadcast(told), sizes["source"].eqNullSafe(told["source"])).where("part > 1e-6").select(sizes["source"], "block", "n", "whole", "part")
    blocks = blocks.withColumn("order", order(F.col("whole")))
    sofar = Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("before", F.sum("n").over(sofar) - F.col("n")).where("before <= part AND before + n > part")
    cut = blocks.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "order", (F.col("part") - F.col("before")).alias("left"))
    at_cut = narrow.join(F.broadcast(cut), narrow["source"].eqNullSafe(cut["_source"]) & (narrow["block"] == cut["_block"]))
    within = Window.partitionBy("source").orderBy("_draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = at_cut.withColumn("before", F.sum("tokens").over(within) - F.col("tokens"))
    ends = at_cut.groupBy("source", "order").agg(F.max(F.when(F.col("before") < F.col("left") - 1e-6, F.col("_draw"))).alias("draw"))
    cuts = {r.source: (r.order, r.draw) for r in ends.collect()}
    plan = [(*x[:3], *cuts.get(x[0], (None, None))) for x in plan]
    told = F.broadcast(spark.createDataFrame(plan, f"{source} string, weight double, {whole} int, {order_} long, {last} long"))

    used = rows.join(told, rows["source"].eqNullSafe(told[source]))
    here = order(F.col(whole))
    again = (here < F.col(order_)) | ((here == F.col(order_)) & (F.col(draw) <= F.col(last)))
    count = F.col(whole) + F.coalesce(again, F.lit(False)).cast("int")
    uses = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    used = used.withColumn("pass", F.explode(uses)).withColumn("order", order(F.col("pass")))
    return used.select(*kept, *names)
