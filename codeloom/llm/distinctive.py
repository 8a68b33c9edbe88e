"""How distinctive a term is per record: two-Poisson mixtures and the classic weight.

For each term the histogram of its occurrences over all records (zeros included) is fitted by
expectation-maximisation with two Poisson rates: an elite one for records the term is about and
a common one. The posterior of the elite component scores each occurrence count; beside it
stands the exact weight c * log2((N + 1) / d).

Defined cases: tokens are trimmed and lower-cased, empty and null ones dropped; records with null
tokens and null ids do not count; a repeated id counts once (its greatest token list); records
without tokens count in N but have no rows; a term in every record keeps its (small) weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Rounds of expectation-maximisation; stops early when no rate moves by TOLERANCE.
ROUNDS, TOLERANCE = 60, 1e-6
#: Terms in more than 1/HEAD of the records: fewer than HEAD times the mean number of terms of a record.
HEAD = 1000
#: Frequent terms that are broadcast at most (about 100 bytes each); more are joined by shuffle.
MAX_BROADCAST = 200_000
#: Cells of a padded block of histograms.
CELLS = 2_000_000


def fit_two_poisson(counts: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share, elite rate, common rate) per row; counts and records are padded histograms (records 0: padding)."""
    total = records.sum(1)
    mean = (counts * records).sum(1) / total
    held = np.where(counts > 0, records, 0.0)
    d = np.maximum(held.sum(1), 1e-12)
    share = np.clip(d / total / 2, 1e-6, 0.5)
    high = np.maximum((counts * held).sum(1) / d + 0.5, mean * 1.5)
    low = np.maximum(mean / 2, 1e-9)
    for _ in range(ROUNDS):
        odds = np.log(share / (1 - share))[:, None] + counts * np.log(high / low)[:, None] - (high - low)[:, None]
        elite = records / (1 + np.exp(-np.clip(odds, -700, 700)))
        weight = np.maximum(elite.sum(1), 1e-12)
        rest = np.maximum(total - weight, 1e-12)
        new_high = np.maximum((elite * counts).sum(1) / weight, 1e-9)
        new_low = np.maximum(((records - elite) * counts).sum(1) / rest, 1e-9)
        moved = max(np.abs(new_high - high).max(), np.abs(new_low - low).max())
        share, high, low = np.clip(weight / total, 1e-9, 1 - 1e-9), new_high, new_low
        if moved < TOLERANCE:
            break
    return share, high, low


def elite_posterior(count: np.ndarray, share: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    odds = np.log(share / (1 - share)) + count * np.log(high / low) - (high - low)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers by rising length, in blocks of at most CELLS padded cells (or one row)."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * (lengths[order[end]] + 1) <= CELLS:
            end += 1
        yield order[at:end]
        at = end


def _fit_batches(records: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rows in _blocks(np.fromiter(map(len, b.counts), int, len(b))):
                part = b.iloc[rows]
                width = max(map(len, part.counts)) + 1
                counts = np.zeros((len(part), width))
                freq = np.zeros((len(part), width))
                for i, (c, n) in enumerate(zip(part.counts, part.freq)):
                    counts[i, 1 : len(c) + 1], freq[i, 1 : len(c) + 1] = c, n
                freq[:, 0] = records - part.d.to_numpy()
                share, high, low = fit_two_poisson(counts, freq)
                yield pd.DataFrame({"term": part.term, "d": part.d, "elite_share": share, "elite_rate": high, "common_rate": low})

    return run


def term_counts(entries: DataFrame, key: str = "id", tokens: str = "tokens") -> tuple[DataFrame, int]:
    """((key, term, c) of every record, N): the occurrences of each cleaned term."""
    once = entries.where(F.col(key).isNotNull() & F.col(tokens).isNotNull()).groupBy(key).agg(F.max(tokens).alias("_tokens"))
    once = checkpoint(once)
    clean = lambda t: F.lower(F.regexp_replace(t, r"^\s+|\s+$", ""))
    terms = once.select(key, F.explode("_tokens").alias("t")).select(key, clean(F.col("t")).alias("term")).where("term != ''")
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("c")), once.count()


def score_terms(entries: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """key, term, c, d, weight, posterior of every term of every record."""
    counts, n = term_counts(entries, key, tokens)
    counts = checkpoint(counts)
    histogram = counts.groupBy("term", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(
        F.collect_list(F.col("c").cast("double")).alias("counts"), F.collect_list(F.col("n").cast("double")).alias("freq"), F.sum("n").alias("d")
    )
    fitted = checkpoint(histogram.mapInPandas(_fit_batches(n), "term string, d long, elite_share double, elite_rate double, common_rate double"))
    # Frequent terms would be hot keys of the join; there are at most HEAD times the mean record's terms of them,
    # counted before they are broadcast. Beyond that the skew join splits their rows.
    head = F.col("d") > n / HEAD
    if fitted.where(head).limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        common = counts.join(F.broadcast(fitted.where(head)), "term")
        rare = counts.join(F.broadcast(fitted.where(head).select("term")), "term", "left_anti").join(fitted.where(~head), "term")
    else:
        common, rare = counts.join(fitted, "term"), counts.limit(0).join(fitted, "term")
    odds = (
        F.log(F.col("elite_share") / (1 - F.col("elite_share")))
        + F.col("c") * F.log(F.col("elite_rate") / F.col("common_rate"))
        - (F.col("elite_rate") - F.col("common_rate"))
    )
    return common.unionByName(rare).select(
        key, "term", "c", "d",
        (F.col("c") * F.log2(F.lit(n + 1.0) / F.col("d"))).alias("weight"),
        (1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(700.0)), F.lit(-700.0))))).alias("posterior"),
    )


def top_terms(entries: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """key, term: the shared term (d >= 2) of greatest weight, ties to the smallest term."""
    scored = score_terms(entries, key, tokens).where("d >= 2")
    return scored.groupBy(key).agg(F.min(F.struct((-F.col("weight")).alias("w"), "term")).alias("best")).select(key, "best.term")


def elite_terms(entries: DataFrame, key: str = "id", tokens: str = "tokens") -> DataFrame:
    """key, term, posterior: the shared term (d >= 2) the record is most surely about, by the mixture alone; ties to greater weight, then the smallest term."""
    scored = score_terms(entries, key, tokens).where("d >= 2")
    best = F.min(F.struct((-F.round("posterior", 9)).alias("p"), (-F.col("weight")).alias("w"), "term", "posterior"))
    return scored.groupBy(key).agg(best.alias("best")).select(key, "best.term", "best.posterior")
