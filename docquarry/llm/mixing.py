"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power a, normalised. a = 1 keeps the shares, a = 0 makes all sources equal.
The exponent is bisected for a target entropy, or for the flattest mix in which no source is repeated more often than a
limit. Each weight is then a budget of tokens, realised on blocks of documents: as many whole passes as fit, and of one
more pass the first blocks of a seeded permutation up to the budget; the block that reaches it is taken when that comes
nearer to the budget, so a source misses its budget by half a block at most. A source has LEAST_BLOCKS blocks at least, as far
as it has documents, so a block is at most about that share of it whatever else the corpus holds.

Edge cases: a null source is a source of its own; a null text has no tokens (its document follows its block); repeated rows
are taken together; sources without tokens get no weight and are left out (copies 0); an empty table gives an empty result;
a single source gets weight 1; a target beyond reach gives the nearest end of [0, 1].
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Least tokens of a block and most blocks (besides one for each source), so that the plan of blocks stays small at any size.
BLOCK_TOKENS, MOST_BLOCKS = 2_000, 40_000
#: Blocks of a source at least.
LEAST_BLOCKS = 64
#: Ranges of the permutation whose sums are taken first; exponents tried in one pass (five halvings), and passes.
RANGES, TRIED, PASSES = 64, 31, 7


@dataclass(frozen=True)
class Target:
    """Either ``entropy`` as a share of the largest possible (0 to 1), or the most ``repetitions`` of any source."""

    entropy: float | None = None
    repetitions: float | None = None
    budget: int | None = None  # tokens; all of the input's by default
    seed: int = 17


def word_tokens(text: Column) -> Column:
    """Words as tokens: how many begin in the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_key(source: Column) -> Column:
    """The source as a string that is never null; a null source is the empty one."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def weights(totals: DataFrame, target: Target) -> tuple[DataFrame, float]:
    """(source_key, tokens, weight) and the exponent. ``totals`` has source_key and tokens.

    Bisection runs over the table of sources: every pass tries the inner points of five halvings at once, so sources stay
    distributed and the driver sees a few sums.
    """
    totals = common.stage(totals.where("tokens > 0"), "source-totals")
    n, whole = totals.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    budget = whole if target.budget is None else target.budget
    share = totals.withColumn("share", F.col("tokens") / F.lit(float(whole or 1)))
    low, high = 0.0, 1.0
    for _ in range(PASSES if n > 1 else 0):
        points = [low + (high - low) * k / (TRIED + 1) for k in range(TRIED + 2)]
        sums = [F.min("share").alias("least")]
        for k, a in enumerate(points):
            power = F.pow("share", F.lit(a))
            sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.ln("share") * F.lit(a)).alias(f"e{k}")]
        row = share.agg(*sums).first()

        def flat_enough(k: int) -> bool:
            """Whether the mix is flatter than the target allows (repetitions) or at least as flat as it asks (entropy)."""
            z = row[f"z{k}"]
            if target.entropy is not None:
                return log(z) - row[f"e{k}"] / z >= target.entropy * log(n)
            return budget * row["least"] ** points[k] / z > (target.repetitions or 1.0) * row["least"] * whole

        # Entropy and repetition fall as the exponent grows, so the test holds up to one point only.
        held = sum(flat_enough(k) for k in range(1, TRIED + 1))
        low, high = points[held], points[held + 1]
    exponent = 1.0 if n <= 1 else low if target.entropy is not None else high
    z = share.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    return share.select("source_key", "tokens", (F.pow("share", F.lit(exponent)) / F.lit(z)).alias("weight")), exponent


@dataclass(frozen=True)
class Plan:
    """Sources (source_key, n_blocks, weight) and blocks (source_key, block, copies, position), with their row counts."""

    sources: DataFrame
    n_sources: int
    blocks: DataFrame
    n_blocks: int
    seed: int

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with source_key and _mix_id) with block, copies, position; both tables are broadcast when counted as small."""
        sources = common.broadcast_if_small(self.sources, self.n_sources)
        out = rows.join(sources, "source_key", "left").withColumn("block", block_of(F.col("_mix_id"), self.seed))
        return out.join(common.broadcast_if_small(self.blocks, self.n_blocks, 100_000), ["source_key", "block"], "left")


def block_of(doc_id: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.col("n_blocks"))


def make_plan(sized: DataFrame, target: Target) -> Plan:
    """The plan for rows of (doc_id, source_key, tokens)."""
    mix, _ = weights(sized.groupBy("source_key").agg(F.sum("tokens").alias("tokens")), target)
    n_sources, whole = mix.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    budget = whole if target.budget is None else target.budget
    per_block = max(BLOCK_TOKENS, -(-whole // MOST_BLOCKS))
    mix = mix.select(
        "source_key",
        "weight",
        F.col("tokens").alias("source_tokens"),
        F.greatest(F.ceil(F.col("tokens") / per_block), F.lit(LEAST_BLOCKS)).cast("bigint").alias("n_blocks"),
        F.round(F.col("weight") * budget).cast("bigint").alias("source_budget"),
    )
    mix = common.stage(mix, "mix-weights")
    keyed = sized.join(common.broadcast_if_small(mix, n_sources), "source_key").withColumn("block", block_of(F.col("doc_id"), target.seed))
    blocks = common.stage(_block_copies(keyed, target.seed), "mix-blocks")
    return Plan(mix.select("source_key", "n_blocks", "weight"), n_sources, blocks, blocks.count(), target.seed)


def _block_copies(keyed: DataFrame, seed: int) -> DataFrame:
    """(source_key, block, copies, position): whole passes, and one more for the blocks that a last, partial pass reaches.

    The running sum over a source's permuted blocks is taken in two steps, over ranges of the permutation and within each, so
    a source with a third of all blocks is no single task.
    """
    size = keyed.groupBy("source_key", "block", "source_tokens", "source_budget").agg(F.sum("tokens").alias("tokens"))
    order = F.pmod(F.xxhash64("source_key", "block", F.lit(seed + 1)), F.lit(1 << 40))
    size = common.stage(size.withColumn("position", order).withColumn("range", F.floor(F.col("position") * RANGES / (1 << 40))), "block-sizes")
    by_range = size.groupBy("source_key", "range").agg(F.sum("tokens").alias("in_range"))
    earlier = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.select("source_key", "range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before_range"))
    within = Window.partitionBy("source_key", "range").orderBy("position", "block").rowsBetween(Window.unboundedPreceding, -1)
    run = size.join(by_range, ["source_key", "range"]).withColumn("before", F.col("before_range") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    passes = F.floor(F.col("source_budget") / F.col("source_tokens"))
    rest = F.col("source_budget") - passes * F.col("source_tokens")
    reached = (F.col("before") < rest) & (2 * (rest - F.col("before")) >= F.col("tokens"))
    return run.select("source_key", "block", (passes + F.when(reached, 1).otherwise(0)).cast("bigint").alias("copies"), "position")


def report(documents: DataFrame, target: Target) -> DataFrame:
    """(doc_id, source, tokens, weight, block, copies, position) of every row: how often it is taken, and where its block stands
    in its source's permutation."""
    rows = documents.select(F.col("doc_id"), F.col("source"), source_key(F.col("source")).alias("source_key"), word_tokens(F.col("text")).alias("tokens"))
    rows = common.stage(rows, "mix-rows")
    placed = make_plan(rows, target).apply(rows.withColumn("_mix_id", F.col("doc_id")))
    return placed.select("doc_id", "source", "tokens", "weight", "block", F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"), "position")


def mixed(documents: DataFrame, target: Target) -> DataFrame:
    """``documents`` with each row taken as often as the plan says, all columns; the texts are not shuffled."""
    sized = documents.select("doc_id", source_key(F.col("source")).alias("source_key"), word_tokens(F.col("text")).alias("tokens"))
    made = make_plan(common.stage(sized, "mix-rows"), target)
    rows = common.packed(documents, source_key=source_key(F.col("source")), _mix_id=F.col("doc_id"))
    taken = made.apply(rows).where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return common.unpacked(taken, documents)
