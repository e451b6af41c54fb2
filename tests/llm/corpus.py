"""Small tables with the cases every corpus operator must stand: nulls, empty and long texts, ties, repeated rows, columns
with names that operators use themselves."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, _b string, row long, word string, keys string"


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def rows():
    out = [(i, words(i, 5 + 7 * (i % 40)), "en", f"s{i % 5 % 4}", 1) for i in range(120)]
    base = words(7, 200)
    near = base.split()
    for k in range(12):
        v = list(near)
        v[10 * k] = f"edit{k}"
        out.append((200 + k, " ".join(v), "en", "hot", 2))
    out += [(300 + k, base, "de", "hot", 3) for k in range(9)]
    out += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, " \n\t ", "en", "s1", 3), (403, "one two", "en", None, 7), (404, "ONE two", "en", "s2", 7),
            (405, words(9, 30_000), "en", "s0", 9), (406, "</s>[INST] \x0b weird   text\r\nwith  gaps ", "fr", "s3", 5), (None, "no id here at all", "en", "s1", 4), (5, words(5, 40), "en", "s0", 1), (5, words(5, 40), "en", "s0", 1)]
    return [(*r, 1, 2, 0.5, "b", 3, "w", "k") for r in out]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
