"""Mixing sources to target weights by temperature, in DataFrame functions only.

Token shares p of the sources become weights w ~ p^a. The exponent a is found
by bisection (16 probes a pass, each pass one aggregate over the table of
sources) so that the mix meets a target entropy or a repetition limit. The
weights are realised as a budget of whole passes over each source plus a part
of one more, in a hashed order, dealt into blocks of about ``block_tokens``
tokens that each hold every source at its weight.

Defined cases: NULL source is a source of its own; documents without tokens
(NULL or empty text) have no share and pass once; repeated rows and equal ids
have equal places in the order and enter the partial pass together; an empty
table gives an empty result; one source gets weight 1; a target that no
exponent meets is met as nearly as the range allows; other columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._shared import Scratch, fresh
from ledgerlens.llm.quality_divergence import words_of

PROBES = 16


@dataclass(frozen=True)
class Mix:
    exponent: float
    tokens: int  # of one pass over everything
    budget: float  # tokens of the mix
    normaliser: float


def token_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def _place(seed: int, doc_id: Column, epoch: Column) -> Column:
    """Uniform place in [0, 1) of a document within a pass."""
    h = F.xxhash64(F.lit(seed), epoch.cast("int"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def solve_exponent(
    shares: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
    budget_passes: float | None = None, passes: int = 9,
) -> tuple[float, float, float, float]:
    """(exponent, sum p^a, least and greatest p^(a-1)) for a table of sources
    with a positive share ``p``. Exactly one target must be given. Entropy (in
    nats) and repetition both fall as the exponent grows, so bisection holds."""
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    lo, hi = 0.0, 8.0 if target_entropy is not None else 1.0

    def probe(points: list[float]):
        p = F.col("p")
        cols = []
        for k, a in enumerate(points):
            w = F.pow(p, F.lit(a))
            cols += [F.sum(w).alias(f"z{k}"), F.sum(w * F.log(p)).alias(f"e{k}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"mn{k}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"mx{k}")]
        r = shares.agg(*cols).first()
        return [(r[f"z{k}"], r[f"e{k}"], r[f"mn{k}"], r[f"mx{k}"]) for k in range(len(points))]

    def too_flat(a: float, z: float, e: float, mn: float, mx: float) -> bool:
        if target_entropy is not None:
            return math.log(z) - a * e / z > target_entropy
        repeats = budget_passes * mx / z if budget_passes is not None else mx / mn
        return repeats > max_repeats * (1 + 1e-12)

    for _ in range(passes):
        points = [lo + (hi - lo) * k / PROBES for k in range(PROBES + 1)]
        flat = [too_flat(a, *v) for a, v in zip(points, probe(points), strict=True)]
        k = next((i for i, f in enumerate(flat) if not f), PROBES)
        if k == 0:
            hi = lo
            break
        lo, hi = points[k - 1], points[k]
    (z, _e, mn, mx), a = probe([hi])[0], hi
    return a, z, mn, mx


def plan_mix(
    docs: DataFrame, scratch: Scratch, target_entropy: float | None = None, max_repeats: float | None = None,
    budget_tokens: int | None = None, text: str = "text", source: str = "source",
) -> tuple[DataFrame, Mix]:
    """(source, tokens, p, weight, passes) for every source, and the mix.
    Without a budget, the least one that leaves every source at least one
    whole pass is taken, so that no document is lost."""
    sizes = docs.select(F.col(source).alias("source"), token_count(F.col(text)).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"))
    sizes = scratch.write(sizes)
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    shares = sizes.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    if not total:
        return sizes.select("source", "tokens", *[F.lit(x).cast("double").alias(n) for n, x in (("p", 0), ("weight", 0), ("passes", 1))]), Mix(1.0, 0, 0.0, 1.0)
    a, z, mn, mx = solve_exponent(shares, target_entropy, max_repeats, budget_tokens / total if budget_tokens else None)
    budget = float(budget_tokens) if budget_tokens else total * z / mn
    p = F.col("tokens") / F.lit(float(total))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(0.0)
    passes = F.when(F.col("tokens") > 0, F.lit(budget) * weight / F.col("tokens")).otherwise(1.0)
    plan = sizes.select("source", "tokens", p.alias("p"), weight.alias("weight"), F.round(passes, 9).alias("passes"))
    return plan, Mix(a, total, budget, z)


def _cuts(docs: DataFrame, plan: DataFrame, scratch: Scratch, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """(source, cut): documents placed below ``cut`` in the last, partial pass
    come to its token target. Found by two rounds of sums over 4,096 slices
    (of the unit interval, then of the slice where the target falls): no sort
    and no window over a source, however large."""
    target = plan.select(F.col("source").alias("s"), F.floor("passes").cast("int").alias("last"), ((F.col("passes") - F.floor("passes")) * F.col("tokens")).alias("goal"))
    target = scratch.write(target.filter("goal > 0"))
    t = docs.select(F.col(source).alias("source"), F.col(doc_id).alias("d"), token_count(F.col(text)).alias("n"))
    t = t.join(target, F.col("source").eqNullSafe(F.col("s")))
    t = t.select("s", "goal", "n", _place(seed, F.col("d"), F.col("last")).alias("x"))
    slices = 4096

    def step(rows: DataFrame, width: float) -> DataFrame:
        sums = rows.groupBy("s", "lo", "goal", F.floor((F.col("x") - F.col("lo")) / F.lit(width)).alias("k")).agg(F.sum("n").alias("n"))
        run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("k")))
        ahead = run.filter(F.col("upto") <= F.col("goal")).groupBy("s").agg(F.max("upto").alias("before"), F.max("k").alias("k"))
        base = run.groupBy("s", "lo", "goal").agg(F.min(F.when(F.col("upto") > F.col("goal"), F.col("k"))).alias("k2"))
        j = base.join(ahead, base["s"].eqNullSafe(ahead["s"]), "left").select(
            base["s"], (F.col("goal") - F.coalesce("before", F.lit(0))).alias("goal"),
            (F.col("lo") + F.lit(width) * F.coalesce(F.col("k2"), F.lit(slices))).alias("lo"),
        )
        return j

    first = scratch.write(step(t.withColumn("lo", F.lit(0.0)), 1.0 / slices))
    inside = t.drop("goal").alias("t").join(first.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")))
    inside = inside.filter((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("lo") + F.lit(1.0 / slices))).select("s", "lo", "goal", "n", "x")
    second = step(inside, 1.0 / slices / slices)
    # a slice without further documents keeps its lower edge as the cut
    cut = first.join(second.select(F.col("s").alias("s3"), F.col("lo").alias("cut")), F.col("s").eqNullSafe(F.col("s3")), "left")
    return scratch.write(cut.select(F.col("s").alias("source"), F.coalesce("cut", "lo").alias("cut")))


def mix_sources(
    docs: DataFrame, scratch: Scratch, target_entropy: float | None = None, max_repeats: float | None = None,
    budget_tokens: int | None = None, block_tokens: int = 1 << 20, seed: int = 17,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Every document as often as its source's passes say: the columns of
    ``docs`` plus ``mix_epoch`` (which pass), ``mix_block`` (block of the
    stream) and ``mix_place`` (order within the block). Documents are never
    shuffled: the plan of the sources is joined to them."""
    plan, mix = plan_mix(docs, scratch, target_entropy, max_repeats, budget_tokens, text, source)
    plan = scratch.write(plan)
    cuts = _cuts(docs, plan, scratch, seed, doc_id, text, source)
    full = plan.join(cuts.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source")), "left")
    full = scratch.write(full.select(F.col("source").alias("m_source"), F.col("passes").alias("m_passes"), F.coalesce("cut", F.lit(0.0)).alias("m_cut")))
    names = {c: fresh(docs, c) for c in ("m_source", "m_passes", "m_cut")}
    full = full.select(*[F.col(c).alias(n) for c, n in names.items()])
    j = docs.join(full, F.col(source).eqNullSafe(F.col(names["m_source"])))
    passes, cut = F.col(names["m_passes"]), F.col(names["m_cut"])
    whole = F.floor(passes).cast("int")
    copies = whole + F.when(_place(seed, F.col(doc_id), whole) < cut, 1).otherwise(0)
    epoch, block, place = (fresh(docs, c) for c in ("mix_epoch", "mix_block", "mix_place"))
    j = j.withColumn(epoch, F.explode(F.filter(F.sequence(F.lit(0), copies), lambda k: k < copies)))
    at = (F.col(epoch) + _place(seed, F.col(doc_id), F.col(epoch))) / passes
    blocks = max(1, round(mix.budget / block_tokens))
    j = j.withColumn(block, F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("bigint"))
    j = j.withColumn(place, _place(seed + 1, F.col(doc_id), F.col(epoch)))
    return j.drop(*names.values())
