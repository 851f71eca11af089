"""Toxicity of texts: a convolutional classifier over hashed words, trained in numpy.

Words are runs of letters (ASCII lower-cased), hashed into 2^BITS buckets, each with an embedding. Filters
of one, two and three words run over a text, each keeps its greatest value (max pooling), and a logistic
layer adds them up. A bucket met in fewer than ``SEEN`` training texts has the zero embedding, as do the places
behind a text's end, so rare words say nothing.

All labelled rows teach: they are dealt by a hash of the key to as many tasks as make about ``WORDS`` words for each,
every task trains from the same model, and the models are averaged (a word's embedding by how many texts of a task have
the word), ``ROUNDS`` times if there are several tasks. A quarter of the rows
is kept apart to calibrate: per language the threshold with the best F1, where a class's rows weigh as much as the
class has in the labelled table. Their logits are counted in steps of 1/``STEPS``, so every row counts and few numbers travel. The language is guessed from the text by word counts of the training texts, so
``lang`` is never read when a text is scored. The threshold is taken off the logit: a score of 0.5 or more says toxic.
Everything else covers whole texts of all rows, in one pass without a shuffle.

Cases: null and empty texts are scored like texts without known words; a null key has no label; of repeated
rows of a key the least text teaches, and a key counts as toxic if any of its labels does; without
labels of both classes every score is the share of toxic rows (0 without labels); columns of the input stay, but
for one named ``score``, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import common as c

BITS = 18
DIM = 16
FILTERS = ((1, 24), (2, 8), (3, 8))  # width, how many
PADS = 4                             # zero words behind each text, so that no window reaches the next one
SEEN = 3
WORDS = 16_000_000                   # words that one task learns from, about
EPOCHS, BATCH, RATE, DECAY = 8, 48, 0.15, 2e-5
ROUNDS = 2                           # averages, if several tasks learn; the epochs are divided among them
STEPS = 256                          # logits are counted in steps of 1/STEPS
LANGS = 16                           # languages with a threshold of their own, at most
ENOUGH = 8                           # toxic rows that a language needs for it
WORK = 1 << 18                       # bytes scored at once

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def buckets(hashes: c.WordHash, text: bytes) -> np.ndarray:
    return (hashes.of(text.translate(LETTERS).split()) & ((1 << BITS) - 1)).astype(np.int32)


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts behind each other with zero words between, and for each text where its windows begin and
    end (one begins behind the last word, so an empty text has one too)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes + PADS) - sizes - PADS
    out = np.zeros(int((sizes + PADS).sum()), np.int64)
    if len(texts):
        out[np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)] = np.concatenate(texts)
    return out, np.stack((begins, begins + sizes + 1), 1)


def pooled(values: np.ndarray, spans: np.ndarray, how) -> np.ndarray:
    """``how`` (a ufunc) over each text's rows."""
    return how.reduceat(values, spans.ravel(), axis=0)[::2]


@dataclass
class Model:
    rows: np.ndarray                  # bucket -> row of the embeddings, 0 for unknown words
    embed: np.ndarray
    kernels: list[np.ndarray]         # per width: (width, DIM, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    base: float
    speech: np.ndarray                # row -> log probability in each language
    thresholds: np.ndarray            # of the languages

    def arrays(self) -> list[np.ndarray]:
        """What is learned, the embeddings first."""
        return [self.embed, *self.kernels, *self.bias, self.out, np.array([self.base], np.float32)]

    def tables(self) -> list[list[np.ndarray]]:
        """What a word adds at each place of each width's filters."""
        return [[self.embed @ k for k in kernel] for kernel in self.kernels]

    def logits(self, texts: list[np.ndarray], tables: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language (place in ``thresholds``) of texts of buckets."""
        x, spans = laid_out([self.rows[t] for t in texts])
        total = np.full(len(texts), self.base, np.float64)
        at = 0
        for parts, b in zip(tables, self.bias):
            end = len(x) - len(parts) + 1
            z = parts[0].take(x[:end], axis=0)
            for j, part in enumerate(parts[1:], 1):
                z += part.take(x[j:j + end], axis=0)
            h = np.maximum(pooled(z, spans, np.maximum) + b, 0)
            total += h.astype(np.float64) @ self.out[at:at + len(b)]
            at += len(b)
        if self.speech.shape[1] < 2:
            return total, np.zeros(len(texts), np.int64)
        return total, pooled(self.speech.take(x, axis=0), spans, np.add).argmax(axis=1)

    def scores(self, texts: list[np.ndarray], tables: list[list[np.ndarray]]) -> np.ndarray:
        logit, lang = self.logits(texts, tables)
        return 1 / (1 + np.exp(-np.clip(logit - self.thresholds[lang], -30, 30)))


# -- training ---------------------------------------------------------------------------------

class Steps:
    """Adagrad for one array."""

    def __init__(self, value: np.ndarray):
        self.value, self.square = value, np.full(value.shape, 1e-3, np.float32)

    def go(self, slope: np.ndarray, rows=slice(None)) -> None:
        self.square[rows] += slope * slope
        self.value[rows] -= RATE * slope / np.sqrt(self.square[rows])


def counted(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], names: list[str]) -> dict[str, np.ndarray]:
    """Per bucket: texts with it (``seen``), toxic ones (``hits``), and its words in each of the named languages."""
    none = np.empty(0, np.int32)
    total = lambda parts: np.bincount(np.concatenate([none, *parts]), minlength=1 << BITS)
    own = [np.unique(t) for t in texts]
    out = {"seen": total(own), "hits": total(o for o, y in zip(own, toxic) if y)}
    return out | {f"lang{n}": total(t for t, x in zip(texts, langs) if x == name) for n, name in enumerate(names)}


def fit(texts: list[np.ndarray], toxic: np.ndarray, langs: list[str | None], seed: int = 1) -> Model:
    """A model of texts of buckets, without thresholds."""
    rng = np.random.default_rng(seed)
    yes, no = int(toxic.sum()), int(len(toxic) - toxic.sum())
    names = _common([x for x in langs if x is not None])
    model = fresh(counted(texts, toxic, langs, names), yes, no, len(names), rng)
    run(model, [Steps(x) for x in model.arrays()], texts, toxic, yes, no, EPOCHS, rng)
    return model


def fresh(counts: dict[str, np.ndarray], yes: int, no: int, langs: int, rng: np.random.Generator) -> Model:
    """The model that training begins with."""
    none = np.zeros(1 << BITS, np.int64)
    seen, hits = counts.get("seen", none), counts.get("hits", none)
    known = np.flatnonzero(seen >= SEEN)
    rows = np.zeros(1 << BITS, np.int32)
    rows[known] = np.arange(1, len(known) + 1)
    embed = rng.normal(0, 0.05, (len(known) + 1, DIM)).astype(np.float32)
    # the first number of an embedding starts as the word's log odds of standing in a toxic text
    embed[1:, 0] = np.log((hits[known] + 0.5) / (yes + 1)) - np.log((seen[known] - hits[known] + 0.5) / (no + 1))
    embed[1:, 0] *= 0.1
    embed[0] = 0
    kernels, bias, out = [], [], []
    for width, many in FILTERS:
        k = rng.normal(0, 0.3 / width, (width, DIM, many)).astype(np.float32)
        k[:, 0] = np.abs(k[:, 0]) + 0.3 / width
        kernels.append(k)
        bias.append(np.zeros(many, np.float32))
        out.append(rng.normal(0.1, 0.1, many).astype(np.float32))
    speech = np.zeros((len(known) + 1, max(langs, 1)), np.float32)
    for n in range(langs):
        total = counts.get(f"lang{n}", none)[known]
        speech[1:, n] = np.log((total + 0.1) / (total.sum() + 0.1 * len(known) + 0.1))
    return Model(rows, embed, kernels, bias, np.concatenate(out), float(np.log((yes + 1) / (no + 1))), speech, np.zeros(speech.shape[1]))


def run(model: Model, steps: list[Steps], texts: list[np.ndarray], toxic: np.ndarray, yes: int, no: int, epochs: int, rng: np.random.Generator) -> None:
    """Some epochs over texts of buckets; ``yes`` and ``no`` are the classes' rows, here and in other tasks."""
    placed = [model.rows[t] for t in texts]
    weight = np.where(toxic, 0.5 / max(yes, 1), 0.5 / max(no, 1)) * (yes + no)  # both classes weigh alike
    by_size = np.array([len(t) for t in texts])
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        order = order[np.argsort(by_size[order] // 64, kind="stable")]  # texts of alike length together, batches in any order
        batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
        for i in rng.permutation(len(batches)):
            b = batches[i]
            _learn(model, steps[:-1], steps[-1], [placed[k] for k in b], toxic[b].astype(np.float32), weight[b].astype(np.float32))
    model.base = float(steps[-1].value[0])


def _common(names: list[str]) -> list[str]:
    found: dict[str, int] = {}
    for x in names:
        found[x] = found.get(x, 0) + 1
    return sorted(sorted(found, key=lambda x: (-found[x], x))[:LANGS])


def _learn(model: Model, steps: list[Steps], base: Steps, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
    """One step of gradient descent on a batch of texts of rows. Only the window that a filter keeps has a slope."""
    x, spans = laid_out(texts)
    widths = len(model.kernels)
    e = model.embed[x]
    tops, hidden = [], []
    for kernel, b in zip(model.kernels, model.bias):
        end = len(x) - len(kernel) + 1
        z = kernel[0].T @ e[:end].T
        for j in range(1, len(kernel)):
            z += kernel[j].T @ e[j:j + end].T
        at = np.stack([s + z[:, s:t].argmax(axis=1) for s, t in spans.tolist()])
        tops.append(at)
        hidden.append(z[np.arange(len(b)), at] + b)
    h = np.concatenate(hidden, axis=1)
    active = np.maximum(h, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ model.out + base.value[0], -30, 30)))
    wrong = (p - y) * weight / len(texts)
    back = wrong[:, None] * model.out * (h > 0)
    steps[1 + 2 * widths].go(active.T @ wrong)
    base.go(np.array([wrong.sum()], np.float32))
    ids, slopes, begin, kernel_slopes, bias_slopes = [], [], 0, [], []
    for at, kernel in zip(tops, model.kernels):
        d = back[:, begin:begin + at.shape[1]]
        begin += at.shape[1]
        k = np.empty_like(kernel)
        for j in range(len(kernel)):
            word = e[at + j]                                   # texts, filters, DIM
            k[j] = np.einsum("tf,tfd->df", d, word)
            ids.append(x[at + j].ravel())
            slopes.append((d[:, :, None] * kernel[j].T[None]).reshape(-1, kernel.shape[1]))
        kernel_slopes.append(k)
        bias_slopes.append(d.sum(axis=0))
    for n in range(widths):
        steps[1 + n].go(kernel_slopes[n] + DECAY * model.kernels[n])
        steps[1 + widths + n].go(bias_slopes[n])
    where, place = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.zeros((len(where), model.embed.shape[1]), np.float32)
    np.add.at(total, place, np.concatenate(slopes))
    real = where > 0  # the zero word stays
    steps[0].go(total[real] + DECAY * model.embed[where[real]], where[real])


def best_threshold(logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit from which on texts count as toxic with the best weighted F1: midway to the next text below."""
    order = np.argsort(-logit, kind="stable")
    z, w, y = logit[order], weight[order], toxic[order].astype(bool)
    hits, picked = np.cumsum(w * y), np.cumsum(w)
    last = np.append(z[1:] < z[:-1], True)  # a threshold between equal logits is none
    f1 = np.where(last, 2 * hits / (picked + (w * y).sum()), -1.0)
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


def calibrate(model: Model, texts: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> None:
    """Thresholds of the languages: a language's own where it has ENOUGH toxic rows, else that of all rows."""
    if not toxic.any() or toxic.all():
        return
    tables = model.tables()
    logit, lang = (np.concatenate(v) for v in zip(*(model.logits(texts[i:i + BATCH], tables) for i in range(0, len(texts), BATCH))))
    model.thresholds = thresholds(lang, logit, toxic, np.ones(len(toxic)), weight, model.speech.shape[1])


def thresholds(lang: np.ndarray, logit: np.ndarray, toxic: np.ndarray, many: np.ndarray, weight: np.ndarray, langs: int) -> np.ndarray:
    """Thresholds of the languages from groups of ``many`` rows of one logit, which weigh ``weight`` together."""
    every = best_threshold(logit, toxic, weight)
    own = []
    for n in range(langs):
        mine = lang == n
        own.append(best_threshold(logit[mine], toxic[mine], weight[mine]) if many[mine & toxic].sum() >= ENOUGH and not toxic[mine].all() else every)
    return np.array(own)


# -- the jobs ---------------------------------------------------------------------------------

def labelled(docs: DataFrame, labels: DataFrame, allowed: Column, key: str, text: str, lang: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, lang, fold, place, words: buckets) of the labelled rows, and how many labelled rows each class has."""
    marks = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(allowed, F.lit(False)))
             .groupBy(F.col(key).alias("__id")).agg(F.max((F.col(label) != 0).cast("int")).alias("__toxic")))
    totals = {r["__toxic"]: r["count"] for r in marks.groupBy("__toxic").count().collect()}
    place = F.xxhash64("__id")
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    # merged at every size: the labels grow with the corpus, and the sorted join groups rows without another shuffle
    taken = (rows.join(marks.hint("merge"), "__id").groupBy("__id").agg(F.min(F.struct("__text", "__lang")).alias("d"), F.max("__toxic").alias("toxic"))
             .select("toxic", F.col("d.__lang").alias("lang"), F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(4)).alias("fold"), place.alias("place"), F.col("d.__text").alias("text")))
    hashes = c.WordHash()

    def make(batch: pa.RecordBatch) -> list:
        return [pa.array([buckets(hashes, x).tobytes() for x in c.raw(batch, "text")], pa.binary())]

    return stored(c.add_columns(taken, "words binary", make, extra=["text"]), "labelled"), totals


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Model | float:
    """A model of the labelled rows for which ``allowed`` (over ``labels``) is true; a share if they have one class only."""
    rows, totals = labelled(docs, labels, allowed, key, text, lang, label)
    found = rows.groupBy("toxic", (F.col("fold") != 0).alias("teach")).agg(F.count("*").alias("n"), F.sum((F.length("words") / 4).cast("long")).alias("words")).collect()
    of = {(r["toxic"], r["teach"]): r["n"] for r in found}
    yes, no = of.get((1, True), 0), of.get((0, True), 0)
    if not yes or not no:
        return totals.get(1, 0) / max(sum(totals.values()), 1)
    teach = rows.where("fold != 0")
    often = teach.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    names = sorted(r["lang"] for r in often)
    counts = c.gather(c.summed(_counts(teach, names)), 1 << BITS)
    model = fresh(counts, yes, no, len(names), np.random.default_rng(1))
    tasks = max(1, -(-sum(r["words"] for r in found if r["teach"]) // WORDS))
    shares = teach.select("toxic", "place", "words").repartition(tasks, "place").sortWithinPartitions("place", "toxic", "words")
    squares, rounds = None, ROUNDS if tasks > 1 else 1
    for n in range(rounds):
        squares = _averaged(shares, model, squares, yes, no, EPOCHS // rounds, n)
    _calibrated(rows.where("fold = 0"), model, totals, of)
    return model


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(texts of buckets, toxic) and the other columns of rows (toxic, ..., words), by batch."""
    for batch in batches:
        yield [np.frombuffer(x, np.int32) for x in batch.column("words").to_pylist()], batch.column("toxic").to_numpy(zero_copy_only=False) == 1, batch


def _counts(teach: DataFrame, names: list[str]) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, c.ROWS):
                for texts, toxic, batch in _read([whole.slice(at, c.ROWS)]):
                    for name, v in counted(texts, toxic, batch.column("lang").to_pylist(), names).items():
                        total[name] = total[name] + v if name in total else v
        yield from c.vector_rows(total)

    return teach.select("toxic", "lang", "words").mapInArrow(count, c.VECTOR)


def _averaged(shares: DataFrame, model: Model, squares: list[np.ndarray] | None, yes: int, no: int, epochs: int, seed: int) -> list[np.ndarray]:
    """Train ``model`` on every partition of ``shares`` by itself and make it the average of the outcomes; its arrays'
    sums of squared slopes are averaged alike and returned."""
    held = shares.sparkSession.sparkContext.broadcast((model, squares))
    many = 1 << 13  # embeddings in a row

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        for some, toxic, _ in _read(batches):
            texts += some
            marks.append(toxic)
        if not texts:
            return
        mine, before = copy.deepcopy(held.value)  # a worker may meet it again
        steps = [Steps(x) for x in mine.arrays()]
        for s, old in zip(steps, before or []):
            s.square = old
        run(mine, steps, texts, np.concatenate(marks), yes, no, epochs, np.random.default_rng((1, seed)))
        seen = np.bincount(np.concatenate([np.unique(mine.rows[t]) for t in texts]), minlength=len(mine.embed)).astype(np.float32)
        share = np.float32(len(texts))
        small = np.concatenate([np.ones(1, np.float32), *(x.ravel() for s in steps[1:] for x in (s.value, s.square))]) * share
        yield c.vector_batch([("small", 0, small.astype(np.float32).tobytes())])
        for at in range(0, len(seen), many):
            w = seen[at:at + many]
            both = [(x[at:at + many] * w[:, None]).ravel() for x in (mine.embed, steps[0].square)]
            yield c.vector_batch([("embed", at // many, np.concatenate([w, *both]).astype(np.float32).tobytes())])

    arrays = model.arrays()
    new = [np.full(x.shape, 1e-3, np.float32) for x in arrays] if squares is None else squares
    sums = c.summed(shares.select("toxic", "words").mapInArrow(train, c.VECTOR), lambda v: v, np.float32)
    for r in sums.toLocalIterator():
        v = np.frombuffer(r["counts"], np.float64)
        if r["part"] == "small":
            at = 1
            for x, s in zip(arrays[1:], new[1:]):
                for to in (x, s):
                    to[...] = (v[at:at + to.size] / v[0]).reshape(to.shape)
                    at += to.size
            continue
        at = r["chunk"] * many
        w = v[:min(many, len(model.embed) - at)]
        met = np.flatnonzero(w)
        for to, part in zip((model.embed, new[0]), v[len(w):].reshape(2, len(w), -1)):
            to[at + met] = part[met] / w[met, None]
    model.embed[0], model.base = 0, float(arrays[-1][0])
    held.unpersist()
    return new


def _calibrated(rows: DataFrame, model: Model, totals: dict[int, int], of: dict[tuple[int, bool], int]) -> None:
    """Thresholds from all rows kept apart, whose logits are counted in steps."""
    if not of.get((1, False)) or not of.get((0, False)):
        return
    held = rows.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, found = held.value, Counter()
        tables = mine.tables()
        for texts, toxic, _ in _read(batches):
            for i in range(0, len(texts), BATCH):
                logit, lang = mine.logits(texts[i:i + BATCH], tables)
                found.update(zip(lang.tolist(), np.floor(np.clip(logit, -30, 30) * STEPS).astype(int).tolist(), toxic[i:i + BATCH].tolist()))
        if found:
            lang, step, toxic = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(step, pa.int32()), pa.array(toxic), pa.array(found.values(), pa.int64())], names=["lang", "step", "toxic", "n"])

    bars = rows.select("toxic", "words").mapInArrow(count, "lang int, step int, toxic boolean, n long").groupBy("lang", "step", "toxic").agg(F.sum("n").alias("n")).collect()
    lang, step, toxic, many = (np.array([r[k] for r in bars]) for k in ("lang", "step", "toxic", "n"))
    weight = many * np.where(toxic, totals[1] / of[1, False], totals[0] / of[0, False])
    model.thresholds = thresholds(lang, (step + 0.5) / STEPS, toxic, many, weight, model.speech.shape[1])
    held.unpersist()


def trained(rows: list[tuple[bool, str | None, bool, np.ndarray]], totals: dict[int, int]) -> Model | None:
    """A calibrated model of rows (toxic, language, whether it teaches, buckets); None without teaching rows of both classes."""
    toxic, teach = (np.array([r[n] for r in rows], bool) for n in (0, 2))
    if not (toxic & teach).any() or not (~toxic & teach).any():
        return None
    pick = lambda n, keep: [r[n] for r, k in zip(rows, keep) if k]
    model = fit(pick(3, teach), toxic[teach], pick(1, teach))
    weight = np.where(toxic, totals[1] / toxic.sum(), totals[0] / (~toxic).sum())
    calibrate(model, pick(3, ~teach), toxic[~teach], weight[~teach])
    return model


def score(docs: DataFrame, model: Model | float, text: str = "text", leave_out: tuple[str, ...] = ()) -> DataFrame:
    """All columns (but ``leave_out``) with score (0 to 1, 0.5 or more: toxic)."""
    if not isinstance(model, Model):
        return docs.drop("score", *leave_out).withColumn("score", F.lit(float(model)))
    held = docs.sparkSession.sparkContext.broadcast(model)
    hashes, ready = c.WordHash(), []

    def make(batch: pa.RecordBatch) -> list:
        if not ready:
            ready.append(held.value.tables())
        parts = c.raw(batch, text)
        found = [held.value.scores([buckets(hashes, x) for x in parts[a:b]], ready[0]) for a, b in c.slices(parts, WORK)]
        return [pa.array(np.concatenate(found) if found else [], pa.float64())]

    return c.add_columns(docs, "score double", make, extra=leave_out)
