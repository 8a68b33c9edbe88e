"""Mixing sources to target weights by Pareto order sampling.

The largest mix in which every source reaches its share without using a document more than
``max_repeats`` times (or one of ``total_tokens``, if that is less) fixes the tokens each source
gives. A document is to be used in proportion to its tokens to the power ``size_power``, up to
max_repeats times; the factor is solved per source from the histogram of its sizes. The whole
part of that number is allocated for certain, the rest is its inclusion probability: documents
are ranked by the odds of a random number divided by their inclusion odds, and the first of them
get one more copy until the source has its tokens, a fixed size. The cut is found on a histogram
of the logarithm of the ranks, which spreads them however small the probabilities are, so no
source, however large, is sorted in one task.

Defined cases: null and empty texts have no tokens and are not used; sources without target,
or with a null or non-positive weight, are left out; the weights of sources without tokens are
shared out among the others; null max_repeats counts as 1; ties in rank go by document id;
empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint
from .tokenizer import VOCABULARY, count_tokens

#: Bins of the rank histogram, between these logarithms; only the bin that holds the cut is ordered exactly (0.03 % of a source).
BINS, LOG_RANK = 100_000, 60.0
#: Documents of a source are used in proportion to the root of their size.
SIZE_POWER = 0.5


def _uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double") + 0.5) / float(1 << 52)


def source_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per usable source: weight (as given), share (rescaled), max_repeats, available, wanted tokens."""
    target = targets.where("source is not null and weight > 0").groupBy("source").agg(
        F.max("weight").alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats")
    )
    available = sizes.groupBy("source").agg(F.sum("tokens").alias("available")).where("available > 0")
    usable = target.join(available, "source").where("max_repeats > 0")
    whole = usable.agg(F.sum("weight").alias("weights"))
    shares = usable.crossJoin(whole).withColumn("share", F.col("weight") / F.col("weights"))  # one row
    most = F.min(F.col("available") * F.col("max_repeats") / F.col("share"))
    total = shares.agg((most if total_tokens is None else F.least(most, F.lit(float(total_tokens)))).alias("total"))
    return shares.crossJoin(total).select(  # one row
        "source", "weight", "share", "max_repeats", "available",
        F.floor(F.col("total") * F.col("share") + 1e-6).alias("wanted"),
    )


def size_factors(sizes: DataFrame, plan: DataFrame, size_power: float = SIZE_POWER) -> DataFrame:
    """Per source: factor, with which min(max_repeats, factor * tokens ** size_power) copies of each document give the wanted tokens.

    Documents from some size on are used max_repeats times. That size is the one from which the
    factor, solved for the smaller ones, really reaches max_repeats; null if all are used so.
    """
    histogram = sizes.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).join(plan, "source")
    weight = F.pow("tokens", F.lit(size_power))
    upto = W.partitionBy("source").orderBy("tokens").rowsBetween(W.unboundedPreceding, 0)  # a row per size
    after = W.partitionBy("source").orderBy("tokens").rowsBetween(1, W.unboundedFollowing)
    solved = histogram.withColumn("full", F.coalesce(F.sum(F.col("n") * F.col("tokens")).over(after), F.lit(0)) * F.col("max_repeats")).withColumn(
        "factor", (F.col("wanted") - F.col("full")) / F.sum(F.col("n") * F.col("tokens") * weight).over(upto)
    )
    fits = solved.where((F.col("factor") >= 0) & (F.col("factor") * weight < F.col("max_repeats")))
    return plan.join(fits.groupBy("source").agg(F.max_by("factor", "tokens").alias("factor")), "source", "left")


def mix_documents(
    documents: DataFrame, targets: DataFrame, seed: int = 11, vocabulary: str = VOCABULARY, total_tokens: int | None = None, size_power: float = SIZE_POWER
) -> tuple[DataFrame, DataFrame]:
    """(mix, plan): mix has doc_id, source, tokens, copies (> 0) of every document used."""
    sizes = count_tokens(documents.where("source is not null").select("doc_id", "source", "text"), vocabulary=vocabulary)
    sizes = checkpoint(sizes.where("tokens > 0"))
    # mix_target is a small table that does not grow; one row per source in it.
    plan = checkpoint(size_factors(sizes, source_plan(sizes, targets, total_tokens), size_power))
    most = F.col("max_repeats").cast("double")
    expected = F.least(most, F.coalesce(F.col("factor") * F.pow("tokens", F.lit(size_power)), most))
    certain = F.floor(expected + 1e-12)
    rest = F.greatest(F.least(expected - certain, F.lit(1 - 1e-9)), F.lit(0.0))
    draw = _uniform("doc_id", seed)
    rank = F.log(draw / (1 - draw)) - F.log(rest / (1 - rest))
    drawn = sizes.join(plan, "source").select(
        "doc_id", "source", "tokens", "wanted", certain.alias("certain"), "max_repeats",
        F.when((certain < F.col("max_repeats")) & (rest > 0), rank).alias("rank"),
    )
    drawn = checkpoint(drawn.withColumn("bin", F.floor((F.col("rank") + LOG_RANK) * (BINS / (2 * LOG_RANK))).cast("int")))
    open_tokens = drawn.groupBy("source").agg(
        (F.max("wanted") - F.sum(F.col("certain") * F.col("tokens"))).alias("open_tokens")
    )
    bins = drawn.where("bin is not null").groupBy("source", "bin").agg(F.sum("tokens").alias("bin_tokens"))
    by_bin = W.partitionBy("source").orderBy("bin")  # at most BINS rows per source
    cuts = bins.withColumn("through", F.sum("bin_tokens").over(by_bin)).join(open_tokens, "source").select(
        "source", "bin", (F.col("through") - F.col("bin_tokens")).alias("before"), "through", "open_tokens"
    )
    placed = drawn.join(cuts, ["source", "bin"], "left")
    inside = placed.where("through <= open_tokens").select("doc_id", F.lit(1).alias("extra"))
    edge = placed.where("before < open_tokens and through > open_tokens")
    in_edge = W.partitionBy("source", "bin").orderBy("rank", "doc_id")
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(in_edge))
    edge = edge.where("upto <= open_tokens").select("doc_id", F.lit(1).alias("extra"))
    extra = checkpoint(inside.unionByName(edge))
    # What is open then goes to one document more, of those left the one whose size comes closest to it.
    taken = drawn.join(extra, "doc_id").groupBy("source").agg(F.sum("tokens").alias("taken"))
    remainder = open_tokens.join(taken, "source", "left").select("source", (F.col("open_tokens") - F.coalesce("taken", F.lit(0))).alias("open"))
    left = drawn.where("rank is not null").join(extra, "doc_id", "left_anti").join(remainder, "source")
    last = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("tokens") - F.col("open")).alias("off"), "rank", "doc_id", "open")).alias("last"))
    extra = extra.unionByName(last.where("last.off < last.open").select("last.doc_id", F.lit(1).alias("extra")))
    mix = drawn.join(extra, "doc_id", "left").select(
        "doc_id", "source", "tokens", (F.col("certain") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies")
    )
    return mix.where("copies > 0"), plan


def mix_shares(mix: DataFrame, plan: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets: weight, share, wanted and used tokens, reached share, most copies of a document."""
    used = mix.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("documents")
    )
    total = used.agg(F.sum("used").alias("total"))
    rows = targets.where("source is not null").select("source", "weight").distinct().join(
        plan.select("source", "share", "max_repeats", "available", "wanted"), "source", "left"
    ).join(used, "source", "left").crossJoin(total)  # one row
    return rows.select(
        "source", "weight", "share", "max_repeats", "available", "wanted", F.coalesce("used", F.lit(0)).alias("used"),
        (F.coalesce("used", F.lit(0)) / F.col("total")).alias("reached_share"), "most_copies", "documents",
    )
