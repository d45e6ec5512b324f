"""Small tables with everything that operators must bear, and the plain forms that they are held against."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, node string, bucket string, size string, n_words string, shard string, label string, kept string, line string, prefix string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def texts(seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    vocabulary = ["alpha", "beta", "gamma", "Delta,", "été", "straße.", "x1", "don't", "中文", "🎩", "the", "of"] + [f"w{i}" for i in range(60)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, passage = line(12), line(40)
    out: list[str | None] = [None, "", " ", "\n\n", "a", "a b c d", "only\nlines\nonly\nlines", "tab\tand no-break space\r\n\x1c end", "same same same same same same same same same same same same same same"]
    for i in range(40):
        body = "\n".join(line(r.randint(1, 25)) for _ in range(r.randint(1, 8)))
        out.append(body)
        if i % 5 == 0:
            out += [body, body + " more", shared + "\n" + body, body.replace("the", "The", 1)]
        if i % 7 == 0:
            out.append(line(20) + " " + passage + " " + line(5))
    out.append(line(12000))  # very long
    out.append("\n".join([shared, passage] * 30))
    return out


def rows(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    found = []
    for i, t in enumerate(texts(seed)):
        found.append((i * 3, t, r.choice(["en", "fr", None]), r.choice(["s0", "s0", "s1", "é", None])))
    found.append(found[12])  # repeated rows
    found.append(found[12])
    found.append((found[14][0], found[20][1], "en", "s1"))  # one id, another text
    found.append((None, found[15][1], "en", "s0"))
    found.append((None, None, None, None))
    return [(d, t, la, s, len(t or ""), *["x"] * 10) for d, t, la, s in found]


def table(spark: SparkSession, seed: int = 1) -> DataFrame:
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(5)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def unique_rows(seed: int = 1) -> list[tuple]:
    """Rows whose doc_id is a key."""
    seen: set = set()
    return [x for x in rows(seed) if x[0] is not None and not (x[0] in seen or seen.add(x[0]))]
