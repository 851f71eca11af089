"""How far the sources of a language lie apart in their words, and which words mark a source.

Terms are runs of ASCII letters (A-Z lower-cased) and of code points beyond ASCII. A language keeps the
terms found in ``least`` or more of its documents. A group (language, source) or a whole language that uses a kept
term ``count`` times gives it the price 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)), with N its
occurrences of kept terms and V the number of kept terms; all of it in whole numbers.

* ``pairs``: for two sources of a language, the sum of price differences over all kept terms. A price
  depends on the count alone, so the joint table of two groups (how many terms have count c in the one and c'
  in the other) is all that is needed. The tables of all groups come from one matrix: a row per term, an
  indicator column per (group, count level), zero included; its product with its own transpose, in blocks of
  rows with few levels, holds every joint table, and float32 is exact for counts of rows in a block.
* ``markers``: the terms that a group prices higher than its language does, the ``top`` dearest differences.

At scale: counts are combined in each task, then per (language, term), so a common term has one row per
task and source. Terms below ``least`` go before anything else happens. A block of a product holds the
terms of a hash range and two ranges of sources, so neither a language with all rows, nor many terms, nor many
sources meet in one task; a block gives one sum per pair of sources. Markers are ranked with a limit that
tasks apply before the shuffle.

Cases: null text, language and source are empty strings; groups without terms take part with counts of 0;
a language without kept terms has pairs of value 0 and no markers; repeated rows count as often as they
occur; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from . import common as c

UNIT, PRIOR = 1_000_000_000, 5
COLUMNS = 512        # indicator columns of a product, or twice the groups if they are more
CELLS = 1 << 15      # counts (terms times sources) of a block
SOURCES = 256        # sources of a range
ROWS = 1 << 16       # rows of a batch of counts

KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(KEEP).split()


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, term, source, n, docs): occurrences and documents, combined within each task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, c.ROWS):
                batch = whole.slice(at, c.ROWS)
                keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for key, x in zip(keys, c.raw(batch, "text")):
                    found = terms(x)
                    n, docs = seen.setdefault(key, (Counter(), Counter()))
                    size -= len(n)
                    n.update(found)
                    docs.update(set(found))
                    size += len(n)
                if size > c.CACHED_WORDS:
                    yield from rows(seen)
                    seen, size = {}, 0
        yield from rows(seen)

    def rows(seen: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            words, many = list(n), list(n.values())
            held = [docs[w] for w in words]
            for at in range(0, len(words), ROWS):
                part = words[at:at + ROWS]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([source] * len(part), pa.string()),
                    pa.array(many[at:at + ROWS], pa.int64()), pa.array(held[at:at + ROWS], pa.int64())], names=["lang", "term", "source", "n", "docs"])

    named = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    return named.mapInArrow(count, "lang string, term string, source string, n long, docs long")


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, term, uses: array of (source, n)) of the terms in ``least`` or more documents of the language."""
    per_source = (counts.repartition("lang", "term").groupBy("lang", "term", "source")
                  .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return (per_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
            .where(F.col("docs") >= least).select("lang", "term", "uses"))


def group_sizes(docs: DataFrame, kept: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, n, lang_n, v, sources): every occurring group with its occurrences of kept terms, and
    those, the kept terms and the sources of its language."""
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    uses = kept.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("n"))
    sized = groups.join(uses, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    whole = sized.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("sources"))
    many = kept.groupBy("lang").agg(F.count("*").alias("v"))
    return sized.join(whole.join(many, "lang", "left").select("lang", "lang_n", F.coalesce("v", F.lit(0)).alias("v"), "sources"), "lang")


def price(count: Column, n: Column, v: Column) -> Column:
    exact = "decimal(20,0)"
    return F.call_function("div", (count + PRIOR).cast(exact) * F.lit(UNIT).cast("decimal(10,0)"), (n + PRIOR * v).cast(exact)) + 1


def prices(levels: np.ndarray, n: int, v: int) -> np.ndarray:
    """Prices of some counts of one group, in Python's whole numbers."""
    return np.array([1 + UNIT * (x + PRIOR) // (n + PRIOR * v) for x in levels.tolist()], np.int64)


# -- joint tables -----------------------------------------------------------------------------

def products(counts: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """For blocks of the rows (terms) of a table of counts, a column per group: the levels of each group there, where
    each group's indicator columns begin, and the product of the transposed indicator matrix with itself. Between the
    columns of two groups it holds their joint table over the block's terms."""
    most = max(COLUMNS, 2 * counts.shape[1])
    todo = [counts[np.argsort(counts.sum(axis=1), kind="stable")]]  # rows with alike counts have few levels
    while todo:
        rows = todo.pop()
        if not len(rows):
            continue
        sorted_rows = np.sort(rows, axis=0)
        columns = rows.shape[1] + int((sorted_rows[1:] != sorted_rows[:-1]).sum())
        if columns > most and len(rows) > 1:
            todo += [rows[len(rows) // 2:], rows[:len(rows) // 2]]
            continue
        levels, place = [], np.empty(rows.shape, np.int64)
        begins = np.zeros(rows.shape[1], np.int64)
        at = 0
        for g in range(rows.shape[1]):
            found, own = np.unique(rows[:, g], return_inverse=True)
            levels.append(found)
            place[:, g], begins[g] = own + at, at
            at += len(found)
        x = np.zeros((len(rows), at), np.float32)
        x[np.arange(len(rows))[:, None], place] = 1
        yield levels, begins, x.T @ x


def priced(counts: np.ndarray, n: list[int], v: int) -> np.ndarray:
    """Sums of price differences over the rows of ``counts``, group by group."""
    total = np.zeros((counts.shape[1],) * 2, np.int64)
    for levels, begins, joint in products(counts):
        p = np.concatenate([prices(x, m, v) for x, m in zip(levels, n)])
        cost = np.abs(p[:, None] - p[None, :]) * joint.astype(np.int64)
        total += np.add.reduceat(np.add.reduceat(cost, begins, axis=0), begins, axis=1)
    return total


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: the distance of each two sources of a language."""
    shape = groups.select("lang", "v", "sources").distinct()
    blocks = F.floor(F.col("v") * F.least(F.col("sources"), F.lit(2 * SOURCES)) / CELLS) + 1
    ranges = F.floor((F.col("sources") - 1) / SOURCES) + 1
    shape = shape.select("lang", blocks.alias("blocks"), ranges.alias("ranges"))
    own = lambda s: F.pmod(F.xxhash64(s), F.col("ranges"))
    numbers = lambda many: F.sequence(F.lit(0).cast("long"), many - 1)
    both = F.expr("explode(flatten(transform(sequence(0L, ranges - 1), i -> transform(sequence(i, ranges - 1), j -> named_struct('i', i, 'j', j)))))")
    rows = (kept.join(shape, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), both.alias("cut"), "uses", "ranges")
            .select("lang", "block", "cut.i", "cut.j", F.filter("uses", lambda u: own(u["source"]).isin(F.col("cut.i"), F.col("cut.j"))).alias("uses")))
    sides = (groups.join(shape, "lang").withColumn("own", own(F.col("source")))
             .select("lang", "source", "n", "v", "own", F.explode(numbers(F.col("blocks"))).alias("block"), both.alias("cut"))
             .where((F.col("own") == F.col("cut.i")) | (F.col("own") == F.col("cut.j")))
             .select("lang", "block", "cut.i", "cut.j", "source", "n", "v", "own"))

    def block(key: tuple, uses: pa.Table, groups: pa.Table) -> pa.Table:
        lang, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        groups = groups.sort_by("source")
        names, own = groups["source"].combine_chunks(), groups["own"].to_numpy()
        counts = np.zeros((uses.num_rows if len(names) > 1 else 0, len(names)), np.int64)
        if len(counts):
            lists = uses["uses"].combine_chunks()
            flat = lists.flatten()
            term = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            counts[term, pc.index_in(flat.field("source"), value_set=names).to_numpy()] = flat.field("n").to_numpy()
        total = priced(counts, groups["n"].to_pylist(), groups["v"][0].as_py() if len(counts) else 0)
        a, b = np.triu_indices(len(names), 1)
        wanted = own[a] != own[b] if i != j else np.ones(len(a), bool)
        a, b = a[wanted], b[wanted]
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)),
                         "value": pa.array(total[a, b], pa.int64())})

    keys = ["lang", "block", "i", "j"]
    parts = rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(block, "lang string, a string, b string, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def markers(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): terms that a source uses and prices higher than its language does."""
    whole = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["n"])
    used = kept.select("lang", "term", whole.alias("all"), F.explode("uses").alias("u")).select("lang", "term", "all", "u.source", F.col("u.n").alias("count"))
    gain = price(F.col("count"), F.col("n"), F.col("v")) - price(F.col("all"), F.col("lang_n"), F.col("v"))
    ranked = (used.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), gain.alias("value")).where(F.col("value") > 0)
              .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))))
    return ranked.where(F.col("rank") <= top)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the distance to every other source (item) of the
    language, part ``term`` the ``top`` terms (items) that mark the source. Ranks begin at 1 for each source and part,
    by falling value, then by item."""
    kept = stored(kept_terms(term_counts(docs, lang, source, text), least), "terms")
    groups = stored(group_sizes(docs, kept, lang, source), "groups")
    either = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    far = (pairs(kept, groups).select("lang", either.alias("p"), "value").select("lang", "p.source", "p.item", "value")
           .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return far.withColumn("part", F.lit("pair")).select(order).unionByName(markers(kept, groups, top).withColumn("part", F.lit("term")).select(order))
