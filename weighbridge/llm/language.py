"""Language of a text as a mixture of languages, fitted by expectation maximisation.

Each language is a multinomial over hashed byte n-grams of its letters. A document's grams are
drawn from a mixture of languages and a uniform background; EM gives the shares. The set of
languages grows from the best single one while the penalised likelihood rises.

Cases: a null text, or one without letters, is ``und`` with score 0; so is every text when nothing
could be learned. Rows without language or text teach nothing. Ties go to the first name.
Repeated rows get the same answer; other columns pass through, and columns named like an output
are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

GRAM, BITS = 3, 16
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass
class Model:
    names: list[str]
    log_p: np.ndarray  # slots x (languages, background)
    p: np.ndarray


def letters(text: str) -> bytes:
    """Lower-cased letter runs, each between single spaces; empty without letters."""
    found = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, found)):  # number signs such as ½ or ① are word characters, but no letters
        found = [x for w in found for x in "".join(ch if ch.isalpha() else " " for ch in w).split()]
    return f" {' '.join(found)} ".encode("utf-8", "surrogatepass") if found else b""


def learn(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", bits: int = BITS, smoothing: float = 0.5) -> Model | None:
    """Gram counts per language over all rows that ``where`` allows; None if there are none."""
    rows = docs.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(letters(t))
            for name, parts in by.items():
                v = total.setdefault(name, np.zeros(1 << bits, np.int64))
                for a, b in c.slices(parts):
                    v += np.bincount(c.gram_slots(parts[a:b], GRAM, bits)[0], minlength=1 << bits)
        yield from c.vector_rows(total)

    found = c.gather(c.summed(rows.mapInArrow(count, c.VECTOR)), 1 << bits)
    names = sorted(found)
    if not names:
        return None
    n = np.array([found[x] for x in names], float).T + smoothing
    p = np.column_stack([n / n.sum(axis=0), np.full(1 << bits, 1 / (1 << bits))])
    return Model(names, np.log(p), p)


def proportions(p: np.ndarray, start: np.ndarray, weight: np.ndarray, rounds: int, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """EM for mixture shares; p: grams x components, weight: how often each gram occurs."""
    share, n = start, weight.sum()
    for _ in range(rounds):
        mixed = p @ share
        new = share * (weight / mixed @ p) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < tolerance:
            break
    return share, float(weight @ np.log(p @ share))


def infer(model: Model, grams: np.ndarray, penalty: float, rounds: int) -> tuple[str, float]:
    """Language and its share. ``penalty`` times log(grams) is the price of one more component."""
    slot, weight = np.unique(grams, return_counts=True)
    weight = weight.astype(float)
    p, n = model.p[slot], weight.sum()
    alone = weight @ model.log_p[slot]
    best = int(np.argmax(alone[:-1]))
    chosen, share, fit, price = [best], np.ones(1), float(alone[best]), penalty * np.log(n + 1)
    while len(chosen) < p.shape[1]:
        # The likelihood is concave in the shares, so no component can gain more than its slope.
        slope = (weight / (p[:, chosen] @ share)) @ p - n
        slope[chosen] = -np.inf
        add = int(np.argmax(slope))
        if slope[add] <= price:
            break
        wider = [*chosen, add]
        new, reached = proportions(p[:, wider], np.append(share * 0.9, 0.1), weight, rounds)
        if reached - fit <= price:
            break
        chosen, share, fit = wider, new, reached
    full = np.zeros(p.shape[1])
    full[chosen] = share
    lead = int(np.argmax(full[:-1]))
    return model.names[lead], float(min(1.0, full[lead]))


def identify(docs: DataFrame, model: Model | None, text: str = "text", penalty: float = 4.0, rounds: int = 30,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its share of the text's grams (0 to 1), under ``names``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x 65,536 slots

    def answer(batch: pa.RecordBatch) -> list:
        langs, scores = [], []
        for t in c.texts(batch, text):
            m, part = held.value, letters(t)
            got = (UNKNOWN, 0.0)
            if m is not None and part:
                got = infer(m, c.gram_slots([part], GRAM, BITS)[0], penalty, rounds)
            langs.append(got[0])
            scores.append(got[1])
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return c.add_columns(docs, f"{names[0]} string, {names[1]} double", answer)


def accepted(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.25) -> DataFrame:
    """Documents with a recognised language that makes up at least ``least`` of the text."""
    out = identify(docs, model, text, names=("__lang", "__share"))
    return out.where((F.col("__lang") != UNKNOWN) & (F.col("__share") >= least)).drop("__lang", "__share")
