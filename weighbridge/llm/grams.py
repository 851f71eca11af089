"""Hashed byte n-gram multinomials of a trusted target and of the raw corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


@dataclass
class Ratio:
    gram: int
    bits: int
    log_ratio: np.ndarray  # per slot, log of target over raw probability


def target_ids(labels: DataFrame, good, key: str, most: int) -> DataFrame:
    """Ids of at most ``most`` trusted rows, taken by hash: a bounded, repeatable sample of labels."""
    ids = labels.where(good).where(F.col(key).isNotNull()).select(F.col(key).alias("__id")).distinct()
    return ids.orderBy(F.xxhash64("__id"), "__id").limit(most)


def fit(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", gram: int = 4, bits: int = 18, smoothing: float = 8.0) -> Ratio:
    """Gram counts of the whole corpus and of the target documents, in one pass over the texts.

    ``targets`` (column __id) has a stated bound, so it is broadcast. A gram counts as if ``smoothing`` more
    had been seen in the corpus, and the target's share of them in the target: rare grams say little.
    """
    marked = docs.join(F.broadcast(targets.withColumn("__hit", F.lit(True))), F.col(key) == F.col("__id"), "left")
    rows = marked.select(F.col(text).alias("text"), F.coalesce("__hit", F.lit(False)).alias("hit"))

    def count(batches):
        total = {name: np.zeros(1 << bits, np.int64) for name in ("raw", "target")}
        for batch in batches:
            parts, hit = c.raw(batch, "text"), np.array(batch.column(1).to_pylist(), bool)
            for a, b in c.slices(parts):
                slots, counts = c.gram_slots(parts[a:b], gram, bits)
                total["raw"] += np.bincount(slots, minlength=1 << bits)
                total["target"] += np.bincount(slots[np.repeat(hit[a:b], counts)], minlength=1 << bits)
        yield from c.vector_rows(total)

    found = c.gather(c.summed(rows.mapInArrow(count, c.VECTOR)), 1 << bits)
    none = np.zeros(1 << bits, np.int64)
    raw, target = found.get("raw", none), found.get("target", none)
    if not target.any():  # nothing to trust: no text is better than another
        return Ratio(gram, bits, np.zeros(1 << bits))
    share = target.sum() / raw.sum()
    return Ratio(gram, bits, np.log((target + smoothing * share) / ((raw + smoothing) * share)))


def totals(model: Ratio, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log ratios over each text's grams, and the number of its grams."""
    total, many = np.zeros(len(parts)), np.zeros(len(parts), np.int64)
    for a, b in c.slices(parts):
        slots, counts = c.gram_slots(parts[a:b], model.gram, model.bits)
        total[a:b], many[a:b] = c.sums(model.log_ratio[slots], counts), counts
    return total, many
