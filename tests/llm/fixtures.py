"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

SYLLABLES = {"en": ["the", "ing", "er", "th", "an", "re", "tion", "st"], "de": ["sch", "ung", "ein", "ich", "ver", "keit", "ge", "ß"],
             "fr": ["eau", "que", "é", "oi", "ment", "elle", "ç", "aux"]}


def prose(seed, n, lang="en"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def swap(text, every, seed):
    """The text with one word in ``every`` replaced."""
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10 ** 6)}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


ODD = [None, "", " ", "\n\n", "...", "a", "word", "é ß\tx\n", "日本語 テキスト 🙂", "the " * 300, "x" * 5000, "\x00 nul", "A\nA\n a \nB", "12 34", "½ ² ① Ⅷ"]


def documents(spark, rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], columns)


def write(folder, name, data):
    pq.write_table(pa.table(data), f"{folder}/{name}.parquet")
