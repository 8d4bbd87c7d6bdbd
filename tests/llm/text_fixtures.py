"""Small documents with the awkward cases of every column."""

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "run string, k int, host string, line int, _key string, fp double")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def documents(n=60, seed=3):
    """(doc_id, text, lang, source) rows with copies, near copies, shared lines, nulls, empty and long texts."""
    rng = random.Random(seed)
    rows = []
    common = "this line is on many pages of the host 12"
    for i in range(n):
        body = "\n".join(prose(rng, rng.randrange(8, 40)) for _ in range(3))
        if i % 3 == 0:
            body = common + "\n" + body
        rows.append((i, body, "en" if i % 2 else "de", f"s{i % 3}"))
    base = prose(rng, 200, 100000)
    for j in range(4):                                             # near copies
        ws = base.split()
        ws[20 * j + 5] = f"changed{j}"
        rows.append((100 + j, " ".join(ws), "en", "s0"))
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[5][1], "fr", "s2"), (202, rows[5][1], None, None)]   # copies
    repeat = prose(rng, 12)
    rows += [(210, " ".join([repeat] * 6), "en", "s0"),           # repeated windows
             (211, "# $ % & | < > *\nÜber Straße É\nÜber Straße É\n \t \nend", "de", "s1"),
             (212, prose(rng, 30000), "en", "s0"),                # very long
             (213, None, "en", "s0"), (214, "", "en", "s0"), (215, " \n\t ", "en", None),
             (216, "one", None, "s0"), (217, "one two three", "en", "s0"), (218, "a\x1cb \x85c d", "en", "s0"),
             (None, "a text without an id but with some words in it", "en", "s0"),
             (None, None, None, None),
             (220, rows[7][1], "en", "s1"), (220, rows[7][1], "en", "s1")]       # a repeated row
    return rows


def table(spark, rows=None):
    """With columns whose names the operators use inside."""
    rows = documents() if rows is None else rows
    extra = ("x", 1, "h", 2, "y", 0.5)
    full = [(d, t, g, s, None if t is None else len(t), *extra) for d, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
