"""Lines, n-gram joins, benchmark leaks, passages and chats against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, diff
from weighbridge.llm import chat, components, decontaminate, jaccard, passages, queries
from weighbridge.llm.lines import Cuckoo, LineStore

from fixtures import ODD, documents, prose, swap


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    assert diff(spark, connect(sf), sf, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_all_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


# -- lines ------------------------------------------------------------------------------------

def line_key(line):
    spaces = " \t\n\x0b\x0c\r"
    return "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in line.strip(spaces))


def kept_lines(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 10 and i is not None:
                holders[line_key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[line_key(x)]) < 2 or min(holders[line_key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def line_rows(n, seed):
    r = random.Random(seed)
    pool = [prose(i, 4) for i in range(30)] + ["short", "ÄÖÜ ist zehn lang", "ninechars", "tencharsss", ""]
    return [(seed * 1000 + i, "\n".join(r.choice([" ", "", "\t"]) + r.choice([x, x.upper(), x]) + r.choice(["", "  ", "\r"]) for x in r.choices(pool, k=r.randint(0, 6))))
            for i in range(n)]


def test_lines_insert_and_delete(spark):
    frame = lambda rows: spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, N_LINES int")
    one, two = line_rows(40, 1) + [(None, "\n".join(prose(i, 4) for i in range(9))), (3, None)], line_rows(30, 0)
    one += [(i + 9000, t) for i, t in enumerate(ODD)] + [one[4]]
    store = LineStore(spark, shards=4)
    check = lambda rows: sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in store.kept(frame(rows)).where("doc_id is not null").collect()) == \
        sorted(x for x in kept_lines(rows) if x[0] is not None)
    store.insert(frame(one))
    assert check(one)
    before = sorted(map(str, store.counts().collect()))
    store.insert(frame(two))
    assert check(one + two)
    store.insert(frame(two[:9]))  # what is in stays as it is
    assert check(one + two)
    known = store.counts().select("key")
    assert store.maybe_known(known).distinct().count() == known.count()
    store.delete(frame(two).select("doc_id").union(spark.range(5, 6)))
    assert check(one) and sorted(map(str, store.counts().collect())) == before
    gone = spark.createDataFrame([(bytes(16),)], "key binary")
    assert store.maybe_known(gone).count() == 0
    empty = LineStore(spark)
    empty.insert(frame(one).limit(0))
    assert empty.kept(frame(one)).where("n_dropped > 0").count() == 0


def test_cuckoo_filter():
    h = np.unique(np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, 5000))
    f = Cuckoo.sized(len(h))
    assert not len(f.add(h)) and f.contains(h).all()
    other = np.random.default_rng(2).integers(-2 ** 62, 2 ** 62, 20000)
    assert f.contains(other).mean() < 1e-3
    assert f.remove(h[:2500]).all() and f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.01
    full = Cuckoo(np.zeros((16, 4), np.uint16))
    left = full.add(h[:200])
    stay = np.setdiff1d(h[:200], left)
    assert len(left) and full.contains(stay).all()


# -- n-gram join ------------------------------------------------------------------------------

def shingle_set(text):
    w = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in (text or "")).encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows, t=0.8):
    sets = [shingle_set(x) for _, x in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) and bool(sets[i]) == bool(sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(n):
        least[find(i)].append(rows[i][0])
    return sorted((rows[i][0], min(least[find(i)]), sum(s == sets[i] for s in sets), links[i]) for i in range(n))


def near_rows():
    rows = [(100 + i, prose(i, 60)) for i in range(25)]
    for i in range(12):
        rows += [(200 + 10 * i + k, swap(prose(i, 60), every, k)) for k, every in enumerate((61, 58, 40, 25, 12))]
    rows += [(400 + i, prose(i, 60).upper()) for i in range(6)] + [(500 + i, t) for i, t in enumerate(ODD)] + [(600, "a b c"), (601, "A  b c"), (602, "a b")]
    return rows


def test_jaccard_join(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, class int")
    for block in (256, 3):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = sorted(tuple(r) for r in jaccard.join(docs).collect())
        assert got == brute_join(rows)
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs).collect()}
    assert kept == {c for _, c, _, _ in brute_join(rows)}
    assert jaccard.join(docs.limit(0)).count() == 0
    odd = documents(spark, [(None, prose(1, 60), "en"), (1, prose(1, 60), "en"), (1, prose(1, 60), "en")])
    assert sorted(map(str, (tuple(r)[:2] for r in jaccard.join(odd).collect()))) == ["(1, 1)", "(1, 1)", "(None, None)"]


def test_one_of_each_with_repeated_ids(spark):
    near = lambda i, k: swap(prose(i, 60), 61 - k, k)
    rows = [(1, prose(1, 60)), (5, near(1, 3)), (5, prose(2, 60)), (7, prose(3, 60)), (7, prose(3, 60)), (7, prose(3, 60).upper()),
            (8, prose(4, 60)), (8, near(4, 5)), (9, near(2, 4)), (10, prose(5, 60)), (10, prose(6, 60)), (11, near(5, 3)), (None, prose(1, 60)), (None, prose(1, 60)), (12, None), (12, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, class int")).collect()), key=str)
    eight = [x for x in got if x[0] == 8]
    assert len(eight) == 1 and eight[0] in rows
    want = [(1, rows[0][1]), (5, rows[2][1]), (7, rows[5][1]), *eight, (10, rows[9][1]), (10, rows[10][1]), rows[12], rows[13], (12, None)]
    assert got == sorted(want, key=str)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "BULK", 64)
    base = prose(77, 80).split(" ")
    rows = []
    for i in range(70):
        w = list(base)
        w[i] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in jaccard.join(documents(spark, [(i, t, "en") for i, t in rows])).collect())
    assert got == brute_join(rows)


def test_overlap_sizes():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 5, 80, 200, 120, 90, 33, 7)]
    x, y = np.triu_indices(len(sets), 1)
    x, y = np.tile(x, 3), np.tile(y, 3)
    assert jaccard.overlaps(sets, x, y).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y)]


def test_pruning_keeps_likely_pairs():
    least = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(5)
    match = rng.random((20000, jaccard.VALUES)) < 0.8
    alive = np.all([match[:, :n].sum(axis=1) >= m for n, m in least.items()], axis=0)
    assert alive.mean() > 0.9999
    unlike = rng.random((20000, jaccard.VALUES)) < 0.4
    assert np.all([unlike[:, :n].sum(axis=1) >= m for n, m in least.items()], axis=0).mean() < 0.001


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(200)] + [(500, 500 + i) for i in range(1, 90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x["id"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in ends}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- benchmark leaks --------------------------------------------------------------------------

def brute_leaks(docs, items, least=13):
    out = []
    for i, t in docs:
        h = decontaminate.words(t or "")
        for k, (j, x) in enumerate(items):
            w, best = decontaminate.words(x or ""), 0
            if len(w) < decontaminate.SHORTEST:
                continue
            for d in range(-len(w) + 1, len(h)):
                run = top = hit = 0
                for p in range(max(0, -d), min(len(w), len(h) - d)):
                    same = w[p] == h[p + d]
                    if run <= 0:
                        run = hit = 0
                    run += 1 if same else -decontaminate.MISS
                    hit += same
                    if run > top:
                        top, got = run, hit
                if top:
                    best = max(best, got)
            if best >= min(least, -(-4 * len(w) // 5)):
                out.append((i, j))
    return sorted(set(out), key=str)


def test_leaks(spark, monkeypatch):
    items = [(i, prose(900 + i, n)) for i, n in enumerate((40, 40, 25, 13, 6, 5, 4, 60))] + [(50, None), (51, ""), (0, prose(900, 40))]
    docs = [(i, prose(i, 50)) for i in range(20)] + [(300 + i, t) for i, t in enumerate(ODD)]
    for k, (j, t) in enumerate(items[:8]):
        for n, leak in enumerate((t, t.upper().replace(" ", ", "), swap(t, 9, 1), " ".join(t.split(" ")[3:20]), " ".join(t.split(" ")[:8]))):
            docs.append((1000 + 10 * k + n, prose(5000 + 10 * k + n, 15) + " " + leak + " " + prose(1, 9)))
    docs.append((2000, prose(5, 9) + " " + items[0][1] + " " + prose(5, 900) + " " + items[1][1]))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs] + [(None, items[0][1], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set(map(str, brute_leaks(docs, items)))
    for limit in (500_000, 30):  # in one block and in several
        got = decontaminate.contaminated(frame, bench, limit=limit).collect()
        assert {str((r["doc_id"], r["item_id"])) for r in got if r["doc_id"] is not None} == want
        for r in got:
            assert r["n_matched"] <= r["n_words"] and r["n_matched"] >= 4
    assert (None, 0) in {(r["doc_id"], r["item_id"]) for r in got}
    left = {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()}
    assert left & set(range(20)) == set(range(20)) and not {str(x) for x in left} & {w.split(",")[0][1:] for w in want}
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0 == decontaminate.contaminated(frame.limit(0), bench).count()


# -- passages ---------------------------------------------------------------------------------

def test_clean_goes_by_row(spark):
    leak = prose(1, 40)
    rows = [(None, leak, "en"), (None, prose(5, 40), "en"), (5, leak, "en"), (6, prose(2, 60), "en"), (6, "x " + leak, "en"), (7, None, None), (7, "", None)]
    docs = documents(spark, rows).withColumn("__gone", F.lit(1)).withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, leak), (2, prose(9, 30))], "item_id long, text string")
    for limit in (500_000, 35):  # one block, several
        got = decontaminate.clean(docs, items, limit=limit)
        assert got.columns == docs.columns
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect()) == sorted((str(i), str(t)) for i, t, _ in rows if leak not in (t or ""))


def test_passages(spark):
    common = prose(70, 70)
    docs = [(i, prose(i, 200)) for i in range(30)]
    docs += [(100 + i, prose(100 + i, 30 + i) + " " + common + " " + prose(200 + i, 40)) for i in range(15)]          # one passage in many
    docs += [(150, prose(150, 30) + " " + swap(common, 12, 1) + " " + prose(151, 9))]                                  # with replaced words
    cut = common.split(" ")
    docs += [(151, prose(152, 44) + " " + " ".join(cut[:33] + ["more", "words"] + cut[33:]) + " " + prose(153, 9))]    # with words put in
    docs += [(160, prose(154, 20) + " " + " ".join(cut[:40]) + " " + prose(155, 60))]                                  # too short a part
    docs += [(170, docs[3][1]), (171, docs[4][1].upper()), (None, docs[5][1])] + [(300 + i, t) for i, t in enumerate(ODD)] + [docs[6]]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int")
    got = [r.asDict() for r in passages.shared(frame).collect()]
    involved = {r["doc_id"] for r in got} | {r["other_id"] for r in got}
    assert involved == {3, 4, 150, 151, 170, 171, *range(100, 115)}
    texts = {i: (t or "").lower().encode().split() for i, t in docs}
    where = common.lower().encode().split()
    for r in got:
        a, b = texts[r["doc_id"]], texts[r["other_id"]]
        assert r["other_id"] < r["doc_id"] and min(r["n_words"], r["other_words"]) >= 50 and r["n_matched"] >= 40
        assert r["start"] + r["n_words"] <= len(a) and r["other_start"] + r["other_words"] <= len(b)
        if 100 <= r["doc_id"] < 115 and 100 <= r["other_id"] < 115:
            assert a[r["start"]:r["start"] + r["n_words"]] == b[r["other_start"]:r["other_start"] + r["other_words"]]
            assert r["n_words"] >= len(where) and r["n_matched"] == r["n_words"]
    assert passages.shared(frame.limit(0)).count() == 0


def test_seeds_are_least_in_a_window():
    rng = np.random.default_rng(7)
    for n in (0, 3, 5, 6, 9, 20, 21, 22, 90):
        h = rng.integers(0, 50, n)
        k = passages.c.windows(h, passages.SEED)
        size = min(passages.WINDOW, len(k))
        want = {j for i in range(len(k) - size + 1) for j in range(i, i + size) if k[j] == k[i:i + size].min()} if len(k) else set()
        at, keys = passages.seed_places(h)
        assert set(at.tolist()) == want and keys.view(np.uint64).tolist() == [k[j] for j in sorted(want)]


def test_chaining_is_optimal():
    r = random.Random(8)
    for _ in range(200):
        n = r.randint(1, 9)
        a, b = np.array([r.randint(0, 30) for _ in range(n)]), np.array([r.randint(0, 30) for _ in range(n)])
        best = {}
        for i in sorted(range(n), key=lambda i: (a[i], b[i])):
            before = [best[j] - passages.GAP * (a[i] - a[j] + b[i] - b[j]) for j in best if a[j] < a[i] and b[j] < b[i]]
            best[i] = passages.SEED + max([0, *before])
        found = passages.chains(a, b)
        assert sorted(x for c in found for x in c.tolist()) == list(range(n))
        c = found[0]
        gaps = sum((a[y] - a[x]) + (b[y] - b[x]) for x, y in zip(c, c[1:]))
        assert passages.SEED * len(c) - passages.GAP * gaps == pytest.approx(max(best.values()))


def fuzzy_pairs(n):
    """Pairs of texts (1000 i, 1000 i + 1) that share 50 words but for one in 5 to 12, or 10 to 20 in a hundred at random."""
    r, out = random.Random(13), []
    for i in range(n):
        words = prose(2000 + i, 50).split(" ")
        kind = i % 11
        if kind < 8:
            gone = r.choice([g for g in (range(off, 50, 5 + kind) for off in range(1, 5 + kind)) if 49 not in g])
        else:
            gone = r.sample(range(1, 49), (5, 7, 10)[kind - 8])
        copy = [f"y{r.randrange(10 ** 9)}" if j in gone else w for j, w in enumerate(words)]
        out += [(1000 * i, " ".join([prose(5000 + i, 30), *words, prose(6000 + i, 30)])), (1000 * i + 1, " ".join([prose(7000 + i, 40), *copy, prose(8000 + i, 20)]))]
    return out


def test_fuzzy_passages_are_found(spark):
    docs = fuzzy_pairs(220)
    got = passages.shared(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["other_id"], r["doc_id"]) for r in got} == {(1000 * i, 1000 * i + 1) for i in range(220)}
    texts = {i: t.lower().split() for i, t in docs}
    for r in got:
        a, b = (texts[r[k]][r[s]:r[s] + r[n]] for k, s, n in (("doc_id", "start", "n_words"), ("other_id", "other_start", "other_words")))
        assert min(len(a), len(b)) >= 50 and r["n_matched"] >= 0.8 * max(len(a), len(b))
        assert len(a) != len(b) or sum(x == y for x, y in zip(a, b)) == r["n_matched"]


def test_neighbours_of_seeds_meet(spark):
    """Every seed of the passage of 10 and 20 has other first and last holders, none with 50 words."""
    words = prose(500, 60).split(" ")
    parts = {1: words[:40], 99: words[:40], 2: words[20:], 98: words[20:], 10: words, 20: words}
    docs = [(i, " ".join([prose(600 + i, 30), *part, prose(700 + i, 30)])) for i, part in parts.items()]
    got = {(r["other_id"], r["doc_id"], r["n_words"]) for r in passages.shared(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(10, 20, 60)}


def test_documents_with_a_window_in_common_are_connected(spark):
    r = random.Random(15)
    pool = [prose(900 + i, 400).split(" ") for i in range(4)]
    docs = []
    for i in range(160):  # overlapping stretches of few texts, and a long one that changes its neighbours
        source, at = r.choice(pool), r.randrange(340)
        docs.append((i, " ".join([prose(1000 + i, r.randint(0, 20)), *source[at:at + r.choice([30, 45, 50, 55, 70, 400])], prose(1200 + i, 15)])))
    docs += [(200, " ".join(["the"] * 90)), (201, " ".join(["the"] * 60)), (202, " ".join(["the"] * 70)), (203, " ".join(["the"] * 30))]
    docs += [(i, " ".join([prose(1500, 5), *(w for w in prose(1501, 8).split(" ") for _ in range(45)), prose(1502, 7)])) for i in (204, 205)]
    holders, places = defaultdict(set), defaultdict(set)
    for i, t in docs:
        w = t.lower().split()
        for p in range(len(w) - 49):
            holders[tuple(w[p:p + 50])].add(i)
            places[tuple(w[p:p + 50]), i].add(p)
    met = defaultdict(set)
    for x in passages.shared(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        met[x["doc_id"]].add((x["start"], x["start"] + x["n_words"], x["other_id"], x["other_start"], x["other_words"]))
    for window, ids in holders.items():
        reached, more = {min(ids)}, True
        while more:
            more = {d for d in ids - reached for s, e, o, os, on in met[d] if o in reached
                    and any(s <= p and p + 50 <= e for p in places[window, d]) and any(os <= q and q + 50 <= os + on for q in places[window, o])}
            more |= {o for d in ids & reached for s, e, o, os, on in met[d] if o in ids - reached
                     and any(s <= p and p + 50 <= e for p in places[window, d]) and any(os <= q and q + 50 <= os + on for q in places[window, o])}
            reached |= more
        assert reached == ids


def families(n, copies):
    """Texts that each hold a noisy copy of the 60 words of their family, and where it begins."""
    r, docs, at = random.Random(21), [], {}
    for i in range(n):
        words = prose(9000 + i, 60).split(" ")
        for j in range(copies):
            gone = set(r.sample(range(60), r.choice((4, 7, 10))))
            copy = [f"z{r.randrange(10 ** 9)}" if k in gone else w for k, w in enumerate(words)]
            before, behind = ([f"b{r.randrange(10 ** 9)}" for _ in range(r.randint(0, 70))] for _ in range(2))
            docs.append((1000 * i + j, " ".join([*before, *copy, *behind])))
            at[1000 * i + j] = len(before)
    return docs, at


def diagonal_pairs(docs, at):
    """Documents of one family with a passage and a seed in it, where their copies stand beside each other; those with 50 equal words apart."""
    words = {i: np.array(t.split(" ")) for i, t in docs}
    fuzzy, equal = set(), set()
    for i in words:
        for j in words:
            if i < j and i // 1000 == j // 1000:
                same = words[i][at[i]:at[i] + 60] == words[j][at[j]:at[j] + 60]
                found = passages.best_stretch(same, 50)
                if found:
                    inner = "".join("01"[int(x)] for x in same[found[0]:found[1]])
                    if "1" * 50 in inner:
                        equal.add((i, j))
                    elif "1" * passages.SEED in inner or any(inner[k:k + 4] == inner[k + 5:k + 9] == "1111" for k in range(len(inner))):
                        fuzzy.add((i, j))
    return fuzzy, equal


@pytest.mark.parametrize("n, copies, block", [(40, 10, 2048), (3, 60, 2048), (2, 60, 16)])
def test_all_holders_of_a_seed_meet(spark, monkeypatch, n, copies, block):
    """Few copies, and so many that their seeds are crowded, in one block or in several."""
    monkeypatch.setattr(passages, "BLOCK", block)
    docs, at = families(n, copies)
    fuzzy, _ = diagonal_pairs(docs, at)
    got = passages.shared(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(fuzzy) > 500 and fuzzy <= {(r["other_id"], r["doc_id"]) for r in got}


def test_crowds_keep_fuzzy_links_of_copies(spark):
    """A line in 60 documents; four others go on with one text or a fuzzy copy of it, each in two equal documents."""
    line, words = prose(40, 10), prose(41, 50).split(" ")
    docs = [(i, " ".join([prose(2200 + i, 30), line, prose(2300 + i, 60)])) for i in range(60)]
    changed = [f"q{k}" if k % 12 == 7 else w for k, w in enumerate(words)]
    docs += [(i, " ".join([prose(2401, 70), line, *words, prose(2402, 70)])) for i in (100, 300)]
    docs += [(i, " ".join([prose(2403, 70), line, *changed[:30], "more", *changed[30:], prose(2404, 70)])) for i in (200, 400)]
    got = [r for r in passages.shared(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == {100, 200, 300, 400}
    pairs = {(r["other_id"], r["doc_id"]): (r["other_start"], r["other_words"], r["start"], r["n_words"]) for r in got}
    assert {(100, 300), (200, 400)} <= set(pairs) and pairs[100, 200] == (70, 60, 70, 61)


def test_common_tokens_as_sets():
    rng = np.random.default_rng(3)
    for rows in (1, 5, 90):
        x, y = (np.array([rng.choice(200, 12, replace=False) * (rng.random(12) < 0.8) for _ in range(m)], np.uint64) for m in (rows, 70))
        x[:, 0] = y[:, 0] = 1000  # in all
        want = [[len(set(a.tolist()) & set(b.tolist()) - {0}) for b in y] for a in x]
        assert passages._common(x, y).tolist() == want


def test_a_repeated_line_does_not_multiply_links(spark, monkeypatch):
    """Twelve documents hold a line twelve times, or seventy times: 144 or 4,900 links for each seed and two documents."""
    line, r = prose(60, 10), random.Random(22)
    docs = [(i, " ".join(f"{line} u{r.randrange(10 ** 9)}" for _ in range(12))) for i in range(12)]
    docs += [(i, " ".join(f"{prose(61, 10)} u{r.randrange(10 ** 9)}" for _ in range(70))) for i in (20, 21)]
    rows, whole = [], passages.crowd_links
    monkeypatch.setattr(passages, "crowd_links", lambda *args: rows.append(whole(*args)) or rows[-1])
    got = passages.shared(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["other_id"], r["doc_id"]) for r in got} == {(i, j) for i in range(12) for j in range(i + 1, 12)} | {(20, 21)}
    assert rows[0].where("a < 20").groupBy("a", "b").count().agg(F.max("count")).first()[0] <= 8 * 4  # seeds of a line, ends
    assert rows[0].where("a = 20").count() <= 8 * 70
    texts = {i: t.split(" ") for i, t in docs}
    for r in got:
        a, b = (texts[r[k]][r[s]:r[s] + r[n]] for k, s, n in (("doc_id", "start", "n_words"), ("other_id", "other_start", "other_words")))
        assert min(len(a), len(b)) >= 50 and r["n_matched"] >= 0.8 * max(len(a), len(b)) and passages.edit_matches(*(np.array([hash(w) for w in v]) for v in (a, b))) >= r["n_matched"]


def test_passages_do_not_depend_on_the_blocks(spark, monkeypatch):
    """Documents with the same words around some places of a line, so that a link may go to either of two."""
    line = prose(63, 10)
    texts = [" ".join([*[f"{line} {prose(64 + i + k % 2, 1)}" for k in range(14)], prose(70 + i, 60)]) for i in range(5)]
    docs = spark.createDataFrame([(10 * i + j, t if j else t + " more") for i, t in enumerate(texts) for j in range(3)], "doc_id long, text string").cache()
    found = []
    for block in (2048, 5):
        monkeypatch.setattr(passages, "BLOCK", block)
        monkeypatch.setattr(passages, "STRETCH", 2 * block)
        found.append(sorted(tuple(r) for r in passages.shared(docs).collect()))
    assert found[0] and found[0] == found[1]


def test_ends_and_bundles_of_links():
    rng = np.random.default_rng(23)
    for _ in range(200):
        n, m = rng.integers(1, 30, 2)
        doc, at = np.concatenate((np.sort(rng.integers(0, 4, n)), np.sort(rng.integers(0, 4, m)))), rng.integers(0, 99, n + m)
        one, two = np.arange(n), np.arange(n, n + m)
        good = rng.random((n, m)) < rng.choice([0.1, 0.6, 1.0])
        p, q = passages._outermost(good, doc[one], doc[two])
        assert good[p, q].all()
        for a in range(4):
            for b in range(4):
                x, y = np.nonzero(good & (doc[one] == a)[:, None] & (doc[two] == b))
                mine = (doc[one][p] == a) & (doc[two][q] == b)
                assert len(x) == mine.sum() == 0 or ({x.min(), x.max()} <= set(p[mine]) and {y.min(), y.max()} <= set(q[mine]))
        links, bundles = [], []
        passages._bundle(good.copy(), one, two, doc, at, bundles, links)
        got = [(doc[p], doc[q], at[p], at[q]) for p, q in zip(*links[0])]
        got += [(doc[p], doc[q], x, y) for p, q, data in bundles for x, y in zip(*passages._unbundled(data))]
        assert sorted(got) == sorted((doc[p], doc[n + q], at[p], at[n + q]) for p, q in zip(*np.nonzero(good)))


def test_a_stretch_is_looked_at_once(monkeypatch):
    """Two seeds on one diagonal, in chains of their own, grow to the same 24 words, too few for a passage."""
    asked, whole = [], passages.best_window
    monkeypatch.setattr(passages, "best_window", lambda words, *args: asked.append(args) or whole(words, *args))
    x, y = np.arange(200, dtype=np.uint32), np.arange(1000, 1200, dtype=np.uint32)
    y[80:104] = x[80:104]
    words = passages.Words(x, y, (False,) * 4)
    found = [passages.align(words, [p], [p], 50) for p in (80, 98)]
    assert found == [[(80, 104, 80, 104, 24)]] * 2
    assert len(asked) == len(set(asked)) == 1


def test_words_go_on_as_arrays_do():
    r = random.Random(24)
    for _ in range(300):
        n = r.choice([0, 5, 40, 64, 65, 300])
        same = np.array([r.random() < r.choice([0.5, 0.97]) for _ in range(n)], bool)
        x = np.arange(n)
        y = np.where(same, x, -1)
        far, met = passages.outward(same)
        assert passages.Words(x, y, (False,) * 4).outward(0, 0, 1, n) == (far, int(same[:far].sum()), met)
        assert passages.Words(x[::-1], y[::-1], (False,) * 4).outward(n - 1, n - 1, -1, n) == (far, int(same[:far].sum()), met)


def test_thinned_runs_keep_their_ends():
    r = random.Random(14)
    for _ in range(100):
        pairs = [(x + i, y + i) for x, y, n in [(r.randrange(60), r.randrange(60), r.randint(1, 30)) for _ in range(4)] for i in range(n)] * 2
        r.shuffle(pairs)
        a, b = passages.thinned(*(np.array(v) for v in zip(*pairs)))
        kept, whole = list(zip(a.tolist(), b.tolist())), set(pairs)
        assert len(kept) == len(set(kept)) and set(kept) <= whole
        assert {p for p in whole if (p[0] - 1, p[1] - 1) not in whole or (p[0] + 1, p[1] + 1) not in whole} <= set(kept)
        for x, y in whole:
            assert any((x - i, y - i) in kept for i in range(passages.SEED))


def test_a_far_passage_does_not_hide_nearer_seeds(spark):
    for first in (80, 200, 400):  # a first passage, and a second one 300 words later with a word put in
        x = [*range(0, first, 9), *range(first + 300, first + 380, 9)]
        a, b = np.array(x), np.array([p + (p >= first + 340) for p in x])
        late = [c.tolist() for c in passages.chains(a, b) if a[c[-1]] >= first + 300]
        assert len(late) == 1 and (a[late[0]] >= first + 300).sum() == len(range(first + 300, first + 380, 9))
    one, two = prose(400, 80), prose(401, 80).split(" ")
    docs = [(1, " ".join([one, prose(402, 300), *two])), (2, " ".join([one, prose(403, 300), *two[:40], "more", *two[40:]]))]
    got = [(r["other_start"], r["other_words"], r["n_words"]) for r in passages.shared(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got) == [(0, 80, 80), (380, 80, 81)]


def test_chains_reach_as_brute_force():
    r = random.Random(12)
    for _ in range(60):
        n = r.randint(2, 40)
        a, b = np.array([r.randint(0, 900) for _ in range(n)]), np.array([r.randint(0, 900) for _ in range(n)])
        b = np.where(np.arange(n) % 3, a + r.randint(0, 3), b)
        best = {}
        for i in sorted(range(n), key=lambda i: (a[i], b[i])):
            near = [j for j in best if 0 < a[i] - a[j] <= 4 * passages.REACH and 0 < b[i] - b[j] <= 4 * passages.REACH]
            best[i] = passages.SEED + max([0, *(best[j] - passages.GAP * (a[i] - a[j] + b[i] - b[j]) for j in near)])
        c = passages.chains(a, b)[0]
        gaps = sum((a[y] - a[x]) + (b[y] - b[x]) for x, y in zip(c, c[1:]))
        assert passages.SEED * len(c) - passages.GAP * gaps == pytest.approx(max(best.values()))


def test_edit_matches():
    r = random.Random(9)
    for _ in range(200):
        x, y = [r.randint(0, 3) for _ in range(r.randint(0, 7))], [r.randint(0, 3) for _ in range(r.randint(0, 7))]
        grid = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                grid[i + 1][j + 1] = max(grid[i][j + 1], grid[i + 1][j], grid[i][j] + (x[i] == y[j]))
        assert passages.edit_matches(np.array(x), np.array(y)) == grid[-1][-1]


# -- chats ------------------------------------------------------------------------------------

def test_chat_events(spark):
    r = random.Random(10)
    events, seq = [], 0
    pieces = [None, "", "a", "<b>", "&lt;", "</turn>\n", "<turn user>\n", "\\", "é🙂", "x\n"]
    for conv in (1, 2, None):
        for _ in range(300):
            seq += r.randint(1, 3)
            events.append((conv, seq, r.randint(0, 12), r.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None, "odd"]),
                           r.choice(["user", "assistant", "assistant", None, "a>b&<"]), r.choice(pieces)))
    events.append((4, 1, 1, "delta", None, None))
    final = {}
    for conv, s, m, kind, role, text in sorted(events, key=lambda e: e[1]):
        got = final.setdefault((conv, m), [s, "", ""])
        got[2] = got[2] + (text or "") if kind == "delta" else "" if kind == "regenerate" else (text or "")
        got[1] = role if role is not None else got[1]
    frame = spark.createDataFrame([(*e, 1) for e in events], "conv_id long, seq long, message long, kind string, role string, text string, conv int").repartition(5)
    folded = chat.fold(frame)
    assert {(x["conv"], x["message"]): [x["position"], x["role"], x["text"]] for x in folded.collect()} == final
    back = defaultdict(list)
    for x in chat.read_back(chat.render(folded)).orderBy("part").collect():
        back[x["conv"]].append(x)
    for conv in {e[0] for e in events}:
        want = [(v[1], v[2]) for v in sorted(v for (c, _), v in final.items() if c == conv)]
        assert [(t["role"], t["text"]) for x in back[conv] for t in x["turns"]] == want
        assert [t for x in back[conv] for t in x["learned"]] == [t for role, t in want if role == "assistant"]
    assert chat.digests(chat.render(chat.fold(frame.limit(0)))).count() == 0


def test_chat_stays_native(spark, sf):
    plan = queries.op7_chat_formatting(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
