"""Toxicity: the classifier against plain loops, thresholds against every choice, held-out rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm import common, queries, toxicity

from fixtures import ODD, documents, prose, write

BAD = {"en": ["idiot", "trash", "clown", "scum"], "de": ["achlichtz", "achkeit", "achlichu"], "fr": ["réeux", "réêou", "réêé"]}


def planted(r, lang, toxic, n=60):
    words = prose(r.randrange(10 ** 6), n, lang).split()
    for w in r.sample(BAD[lang], 3) if toxic else []:
        words.insert(r.randrange(len(words)), w + r.choice(["", ".", "###", "\n"]))
    return " ".join(words)


def tables(seed=1, n=420):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang, toxic = r.choice(list(BAD)), r.random() < 0.35
        rows.append((i, planted(r, lang, toxic), lang, int(toxic)))
    return rows


def features(model, text):
    """Logit and language by plain loops."""
    known = [int(model.rows[b]) for b in toxicity.buckets(common.WordHash(), text.encode())]
    total, at = model.base, 0
    for kernel, bias in zip(model.kernels, model.bias):
        for f in range(len(bias)):
            best = max(sum(float(model.embed[w] @ kernel[j][:, f]) for j, w in enumerate((known[i:] + [0] * 9)[:len(kernel)])) for i in range(len(known) + 1))
            total += max(best + float(bias[f]), 0) * float(model.out[at])
            at += 1
    votes = [sum(float(model.speech[w, n]) for w in known) for n in range(model.speech.shape[1])]
    return total, votes.index(max(votes))


@pytest.fixture(scope="module")
def trained():
    hashes = common.WordHash()
    rows = tables(2)
    sample = [(y == 1, lang, i % 4 != 0, toxicity.buckets(hashes, t.encode())) for i, t, lang, y in rows]
    return toxicity.trained(sample, {1: 40, 0: 380})


def test_scores_against_loops(trained):
    hashes = common.WordHash()
    texts = [t or "" for t in ODD] + [planted(random.Random(i), lang, i % 2, 12) for i, lang in enumerate(["en", "de", "fr"] * 5)]
    got = trained.scores([toxicity.buckets(hashes, t.encode()) for t in texts], trained.tables())
    for t, s in zip(texts, got):
        logit, lang = features(trained, t)
        assert s == pytest.approx(1 / (1 + math.exp(-max(min(logit - trained.thresholds[lang], 30), -30))), abs=1e-4)
        alone = trained.scores([toxicity.buckets(hashes, t.encode())], trained.tables())[0]
        assert alone == pytest.approx(s, abs=1e-6)


def test_slopes_against_differences():
    """The step on a batch goes down the loss as numerical differences say."""
    rng, r = np.random.default_rng(3), random.Random(3)
    texts = [rng.integers(0, 40, r.randint(0, 20)).astype(np.int32) for _ in range(40)]
    toxic = np.array([7 in t for t in texts])
    model = toxicity.fit(texts, toxic, [None] * 40)

    def loss():
        logit, _ = model.logits(texts, model.tables())
        return float(np.mean(np.log1p(np.exp(np.where(toxic, -logit, logit)))))

    class Seen:  # keeps the slopes, takes no step
        def __init__(self, value):
            self.value, self.slope = value, None

        def go(self, slope, rows=None):
            self.slope = slope if rows is None else (slope, rows)

    widths = len(model.kernels)
    steps = [Seen(x) for x in (model.embed, *model.kernels, *model.bias, model.out)]
    base = Seen(np.array([model.base], np.float32))
    toxicity._learn(model, steps, base, [model.rows[t] for t in texts], toxic.astype(np.float32), np.ones(40, np.float32))
    for array, slope, where in ((model.kernels[1], steps[2].slope, (1, 2, 3)), (model.kernels[2], steps[3].slope, (0, 0, 1)), (model.bias[0], steps[1 + widths].slope, (4,)),
                                (model.out, steps[-1].slope, (2,)), (model.embed, None, (int(model.rows[7]), 0))):
        slope = slope[where] if slope is not None else steps[0].slope[0][list(steps[0].slope[1]).index(where[0])][where[1]]
        old, h = array[where], 1e-2
        array[where] = old + h
        up = loss()
        array[where] = old - h
        down = loss()
        array[where] = old
        assert (up - down) / (2 * h) == pytest.approx(float(slope), abs=3e-3)


def test_best_threshold_against_all():
    r = random.Random(4)
    for _ in range(200):
        n = r.randint(2, 30)
        z = np.array([r.choice([-1.0, 0.0, 0.5, r.random()]) for _ in range(n)])
        y = np.array([r.random() < 0.5 for _ in range(n)])
        if not y.any():
            continue
        w = np.where(y, 0.5, 3.0)

        def f1(t):
            return 2 * (w * (y & (z >= t))).sum() / ((w * (z >= t)).sum() + (w * y).sum())

        assert f1(toxicity.best_threshold(z, y, w)) == pytest.approx(max(f1(t) for t in z))


def test_learn_and_score(spark):
    rows = tables(5)
    docs = documents(spark, [(i, t, lang) for i, t, lang, _ in rows] + [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(3, "again", "en"), (None, "idiot trash scum clown", "en")])
    labels = spark.createDataFrame([(i, 0, y) for i, _, _, y in rows] + [(5, 1, None), (None, 1, 1), (9999, 1, 1), (1001, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs.withColumn("toxic", F.lit("clash")), labels, F.col("doc_id") % 5 != 0)
    assert model.thresholds.shape == (3,)
    got = toxicity.score(docs.withColumn("SCORE", F.lit("clash")).withColumn("__id", F.lit(1)), model)
    assert got.columns == [*docs.columns, "__id", "score"] and got.count() == docs.count()
    found = {(r["doc_id"], r["text"]): r["score"] for r in got.collect()}
    assert all(0 <= s <= 1 for s in found.values()) and found[None, "idiot trash scum clown"] > 0.5
    held = [(found[i, t] >= 0.5, y == 1) for i, t, _, y in rows if i % 5 == 0 and i != 3]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_without_both_classes(spark):
    docs = documents(spark, [(1, "a b", "en"), (2, None, None)])
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for given, share in ((labels, 0.0), (labels.limit(0), 0.0), (labels.withColumn("toxic", F.lit(1)), 1.0)):
        model = toxicity.learn(docs, given, F.lit(True))
        assert [r["score"] for r in toxicity.score(docs.withColumn("Score", F.lit(1)), model).collect()] == [share] * 2


def test_labels_of_held_out_rows_are_not_read(spark, tmp_path):
    rows = tables(6, 200)
    write(tmp_path, "documents", {"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": ["s"] * 200})
    scores = []
    for flip in (0, 1):
        held = [zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows]
        write(tmp_path, "labels", {"doc_id": [r[0] for r in rows], "toxic": [r[3] ^ (flip & h) for r, h in zip(rows, held)], "quality": [0] * 200})
        got = queries.op12_toxicity(spark, str(tmp_path)).collect()
        assert all(x["held_out"] == held[x["doc_id"]] and x["predicted"] == int(x["score"] >= 0.5) for x in got)
        scores.append({x["doc_id"]: x["score"] for x in got})
    assert scores[0] == scores[1] and len(scores[0]) == 200


def test_held_out_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op12_toxicity(spark, sf).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert sum(p == y for p, y in held) >= 0.93 * len(held)  # a trained share of 40 toxic rows in four languages


def test_all_labelled_rows_teach(spark, monkeypatch):
    """However many rows there are, and in several tasks."""
    for name, value in (("TOXIC", 5), ("CLEAN", 9), ("WORDS", 5000)):  # limits of a sample once
        monkeypatch.setattr(toxicity, name, value, raising=False)
    rows = tables(7, 600)
    docs = documents(spark, [(i, t, lang) for i, t, lang, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    allowed = F.col("doc_id") % 5 != 0
    found, totals = toxicity.labelled(docs, labels, allowed, "doc_id", "text", "lang", "toxic")
    assert found.count() == sum(totals.values()) == 480
    words = {r["place"]: len(r["words"]) for r in found.collect()}
    assert sum(words.values()) > 4 * 3 * 5000  # several tasks' work
    model = toxicity.learn(docs, labels, allowed)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5, y == 1) for i, _, _, y in rows if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
