"""Language, quality, pieces, scores and resampling against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weighbridge.llm import common, grams, language, mixing, pieces, quality, queries, resample

from fixtures import ODD, documents, prose


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# -- language ---------------------------------------------------------------------------------

def corpus(spark):
    rows = [(i, prose(i, 40, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(7, prose(7, 40, "de"), "de"), (None, prose(1, 9), "en")]
    return documents(spark, rows)


def test_language_cases(spark):
    docs = corpus(spark)
    model = language.learn(docs, F.lit(True))
    assert model.names == ["de", "en", "fr"]
    got = language.identify(docs.withColumn("SCORE", F.lit("clash")), model)
    assert got.columns.count("score") + got.columns.count("SCORE") == 1 and got.count() == docs.count()
    for r in got.collect():
        assert 0 <= r["score"] <= 1
        if r["text"] is None or not any(ch.isalpha() for ch in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["lang"]:
            assert r["lang_pred"] == r["lang"] and r["score"] > 0.9


def test_language_mixture(spark):
    model = language.learn(corpus(spark), F.lit(True))
    text = prose(500, 200, "de") + " " + prose(501, 200, "fr")
    name, share = language.infer(model, common.gram_slots([language.letters(text)], language.GRAM, language.BITS)[0], 4.0, 30)
    sizes = [len(language.letters(prose(s, 200, x))) for s, x in ((500, "de"), (501, "fr"))]
    assert name == ["de", "fr"][int(np.argmax(sizes))] and abs(share - max(sizes) / sum(sizes)) < 0.05


def test_em_against_grid():
    rng = np.random.default_rng(1)
    p, w = rng.dirichlet(np.ones(30), 2).T, rng.integers(1, 9, 30).astype(float)
    share, fit = language.proportions(p, np.array([0.5, 0.5]), w, 500, 1e-9)
    grid = [w @ np.log(p @ np.array([x, 1 - x])) for x in np.linspace(1e-6, 1 - 1e-6, 2001)]
    assert fit >= max(grid) - 1e-3 and abs(share.sum() - 1) < 1e-9


def test_language_without_teachers(spark):
    docs = documents(spark, [(1, "words here", None)])
    assert language.learn(docs, F.lit(True)) is None
    assert rows_of(language.identify(docs, None))[1]["lang_pred"] == "und"
    assert language.accepted(docs, None).columns == docs.columns and language.accepted(docs, None).count() == 0
    assert language.identify(docs.limit(0), None).count() == 0


def test_op1_held_out(spark, sf):
    got = queries.op1_language_id(spark, sf)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = 0
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        held += r["held_out"]
        assert not r["held_out"] or r["lang_pred"] == lang[r["doc_id"]]
    assert held > 20 and got.count() == len(lang)


# -- quality ----------------------------------------------------------------------------------

def base_counts(text):
    spaces = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch in spaces:
            words += [word] if word else []
            word = ""
        else:
            word += ch
    three = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if three[tuple(words[i:i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(spaces):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(s) for s in "#*$%&|<>"), "n_dup_lines": dup,
            "n_repeat_words": len(inside), "base_failed": n < 50 or 100 * len(inside) > 50 * n}


def test_quality_base(spark, sf):
    texts = ODD + ["a b c a b c d", "x y z", "l\nl\n\nl", "#$ <b>|"] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    docs = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    model = grams.Ratio(4, 18, np.zeros(1 << 18))
    for r in quality.judge(docs, model).collect():
        want = base_counts(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["kept"] == (not want["base_failed"])


def test_quality_ratio(spark):
    rows = [(i, prose(i, 80) if i % 3 else prose(i, 80).upper().replace(" ", "!! "), None) for i in range(90)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (5, 1)], "doc_id long, quality int")
    model = grams.fit(docs, grams.target_ids(labels, F.col("quality") == 1, "doc_id", 100))
    got = rows_of(quality.judge(docs, model))
    assert [got[i]["kept"] for i in range(90)] == [i % 3 > 0 for i in range(90)]
    # the ratio itself, from counts made one gram at a time
    raw, good = Counter(), Counter()
    for i, t, _ in rows:
        slots, _ = common.gram_slots([t.encode()], 4, 18)
        raw.update(slots.tolist())
        good.update(slots.tolist() if i < 60 and i % 3 else [])
    share = sum(good.values()) / sum(raw.values())
    slots, _ = common.gram_slots([rows[4][1].encode()], 4, 18)
    want = np.mean([math.log((good[s] + 8 * share) / ((raw[s] + 8) * share)) for s in slots.tolist()])
    assert abs(got[4]["log_ratio"] - want) < 1e-9
    nothing = grams.fit(docs, grams.target_ids(labels.limit(0), F.col("quality") == 1, "doc_id", 100))
    assert not nothing.log_ratio.any()


def test_gram_slots_stay_inside_texts():
    parts = [b"abcdef", b"", b"ab", b"abcd", b"xyzabc"]
    slots, counts = common.gram_slots(parts, 4, 18)
    alone = [common.gram_slots([p], 4, 18)[0] for p in parts]
    assert counts.tolist() == [len(a) for a in alone] and slots.tolist() == np.concatenate(alone).tolist()
    assert common.sums(slots.astype(float), counts).tolist() == [a.astype(float).sum() for a in alone]


# -- resampling -------------------------------------------------------------------------------

def test_resample_takes_the_largest_keys(spark):
    rows = [(i, prose(i, 30)) for i in range(200)] + [(3, prose(3, 30)), (None, None), (900, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = grams.Ratio(4, 18, np.random.default_rng(2).normal(0, 0.05, 1 << 18))
    one = resample.sample(resample.weigh(docs, model), 0.4)
    got = sorted((r["gumbel_key"], r["selected"]) for r in one.collect())
    k = round(0.4 * len(rows))
    assert [s for _, s in got] == [False] * (len(got) - k) + [True] * k or sum(s for _, s in got) == k + 1
    assert sorted(map(str, one.collect())) == sorted(map(str, resample.sample(resample.weigh(docs.repartition(7), model), 0.4).collect()))
    for share, want in ((0, 0), (1, len(rows))):
        assert resample.sample(resample.weigh(docs, model), share).where("selected").count() == want
    assert resample.sample(resample.weigh(docs.limit(0), model), 0.5).count() == 0


def test_gumbel_noise(spark):
    g = [r[0] for r in spark.range(20000).select(resample.gumbel(F.col("id"), 3)).collect()]
    assert abs(np.mean(g) - 0.5772) < 0.05 and abs(np.var(g) - math.pi ** 2 / 6) < 0.1


# -- pieces -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))


def test_pieces_equal_library(spark, library, sf):
    r = random.Random(4)
    texts = [t or "" for t in ODD] + ["  a  b   c ", "▁x ▁", "<0x0A> <s> </s> <unk>", "ab" * 3000, "🙂" * 80, "x" + " " * 90 + "y", "á ﻿"]
    texts += ["".join(r.choice("aeiou th ▁\n<>0x🙂é日") for _ in range(r.randint(0, 150))) for _ in range(500)]
    texts += [d["text"] for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(-1, None, "clash")], "doc_id long, text string, IDS string")
    model = queries.piece_model()
    got = rows_of(pieces.encode(docs, model, decoded=True))
    assert list(got[-1])[2:] == [[], [], [], ""]
    for i, t in enumerate(texts):
        ids = library.encode(t)
        assert got[i]["ids"] == ids and got[i]["decoded"] == library.decode(ids)
        proto = library.encode(t, return_type="proto").pieces if i < 60 else []
        data = t.encode()
        for a, b, p in zip(got[i]["starts"], got[i]["ends"], proto):
            assert (a, b) == (len(t[:p.begin].encode()), len(t[:p.end].encode())) or data[a:b] == p.surface.encode()
        if ids:
            assert got[i]["starts"][0] == 0 and got[i]["ends"][-1] == len(data)
            assert got[i]["starts"][1:] == got[i]["ends"][:-1]
    back = rows_of(pieces.decode(pieces.encode(docs, model), model))
    assert back[5]["decoded"] == got[5]["decoded"]


def test_decode_any_ids(library):
    e, r = pieces.Encoder(queries.piece_model()), random.Random(5)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randint(0, 8))]
        assert e.decode(ids) == library.decode(ids)


def test_character_map_equals_library():
    import sentencepiece

    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    blob = dict(pieces.fields(dict(pieces.fields(normalizer.serialized_model_proto()))[3]))[2]
    model = pieces.Model(charmap=pieces.CharMap.read(blob))
    r = random.Random(6)
    for _ in range(400):
        t = "".join(r.choice("aé①ｱﾞ Å　ﬁ㌔  ½\t​x각") for _ in range(r.randint(0, 20)))
        normal, where = model.normalise(t)
        assert normal == normalizer.normalize(t)
        assert len(where) == len(normal) + 1 and where == sorted(where)


# -- scores -----------------------------------------------------------------------------------

def test_scores(spark):
    rows = [(i, prose(i % 25, 60) + ("\n" if i % 4 else " TheThe  x"), i) for i in range(120)] + [(500 + i, t, 0) for i, t in enumerate(ODD)] + [(None, "the an", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    learn = common.remainder(F.col("doc_id"), 7) != 2
    for head in (200_000, 5):  # with and without words that are looked up by a join
        got = {(r["doc_id"], r["n"]): r for r in mixing.score_texts(docs, learn, ["doc_id", "n"], head=head).collect()}
        assert len(got) == len(rows)
        tokens = lambda t: "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in (t or "")).encode().split() + [None]
        count = Counter(w for i, t, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
        n, v = sum(count.values()), len(count)
        for i, t, k in rows:
            r, ws = got[i, k], tokens(t)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
            assert abs(r["base_score"] - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
            assert r["score"] < 0
    held = [got[i, k] for i, t, k in rows if i is not None and i < 120 and zlib.crc32(str(i).encode()) % 7 == 2]
    bits = -sum(r["score"] for r in held) / math.log10(2) / sum(len(rows[r["doc_id"]][1]) for r in held)
    assert bits < 2.5  # eight without a model


def test_scores_learning_from_nothing(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = mixing.score_texts(docs, F.lit(False), ["doc_id"]).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["base_score"] == 0
    assert mixing.score_texts(docs.limit(0), F.lit(True), ["doc_id"]).count() == 0


def test_code_is_complete():
    code = mixing.Code.of(np.arange(1, 257, dtype=float) ** 3)
    assert abs(sum(2.0 ** -code.size) - 1) < 1e-12
    paths = {tuple(code.bit[b, :code.size[b]]) for b in range(256)}
    assert len(paths) == 256 and not any(p[:n] in paths for p in paths for n in range(len(p)))


def test_bit_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    inputs = [rng.normal(0, 30, (3, mixing.BLOCK)).astype(np.float32) for _ in range(3)]
    known = (rng.random((3, mixing.BLOCK)) < 0.5).astype(np.float32)
    sign = np.where(rng.random((3, mixing.BLOCK)) < 0.5, 1, -1).astype(np.float32)
    whole = []
    for last in (0, 1, -1):  # the last bit left out, 1, 0
        sign[2, 9:] = 0
        sign[2, 9] = last
        whole.append(10 ** mixing.mix_lanes(inputs, known, sign, np.array([3]))[0])
    assert whole[1] + whole[2] == pytest.approx(whole[0], rel=1e-4)


def test_score_is_the_texts_own():
    parts = [prose(i, 30).encode() for i in range(40)]
    code = mixing.Code.of(np.ones(256) + np.bincount(np.frombuffer(b" ".join(parts), np.uint8), minlength=256))
    totals = [np.zeros(2 << mixing.SLOT_BITS, np.int32) for _ in mixing.ORDERS]
    mixing.tally(parts, code, totals)
    # the first place of a cell takes what stands for bits behind a code's end
    assert sum(int(t.reshape(-1, 16, 2)[:, 1:].sum()) for t in totals) == 2 * sum(int(code.size[np.frombuffer(p + b"\xff", np.uint8)].sum()) for p in parts)
    tables = [mixing.odds(t) for t in totals] + [mixing.word_table(Counter(b" ".join(parts).split()), code)]
    together = mixing.score([b"", parts[3], b"x" * 9000, parts[3]], code, tables)
    alone = [mixing.score([p], code, tables)[0] for p in (b"", parts[3], b"x" * 9000, parts[3])]
    assert together == pytest.approx(alone, rel=1e-5) and (together < 0).all()
