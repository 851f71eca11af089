"""Quality rules: plain counts of a text, and a length-normalised log-likelihood ratio between a
trusted target and the raw corpus, cut at a fixed threshold.

Cases: a null text has no words and fails the base rules; a text with fewer bytes than a gram has
ratio 0. Without any trusted document all ratios are 0, so only the base rules decide. Repeated rows
get equal answers. Other columns pass through; columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c
from .grams import Ratio, totals

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, log_ratio double, kept boolean")


def repeated_words(words: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice, the first occurrence included."""
    keys = c.windows(words, 3)
    if not len(keys):
        return 0
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    inside = np.zeros(len(words), bool)
    for j in range(3):
        inside[j:j + len(twice)] |= twice
    return int(inside.sum())


def repeated_lines(text: bytes) -> int:
    seen, repeats = set(), 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            repeats += line in seen
            seen.add(line)
    return repeats


def judge(docs: DataFrame, model: Ratio, text: str = "text", threshold: float = -0.4) -> DataFrame:
    """``docs`` with the base counts, the mean log ratio per gram, and the verdict.

    base_failed: under 50 words, or more than half of the words repeat; kept: not base_failed and
    log_ratio >= threshold.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # one number per slot
    hashes = c.WordHash()

    def answer(batch: pa.RecordBatch) -> list:
        parts, strings = c.raw(batch, text), c.texts(batch, text)
        n_words, repeats = [], []
        for x in parts:
            words = x.split()
            n_words.append(len(words))
            repeats.append(repeated_words(hashes.of(words)))
        n, r = np.array(n_words, np.int64), np.array(repeats, np.int64)
        chars = [len(s) - sum(map(s.count, SPACES)) for s in strings]
        symbols = [sum(map(s.count, SYMBOLS)) for s in strings]
        failed = (n < 50) | (100 * r > 50 * n)
        total, grams = totals(held.value, parts)
        mean = total / np.maximum(grams, 1)
        return [n, pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(list(map(repeated_lines, parts)), pa.int64()), r,
                failed, mean, ~failed & (mean >= threshold)]

    return c.add_columns(docs, FIELDS, answer)
