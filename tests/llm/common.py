"""Fixtures that every operator on documents has to stand: nulls, empty and long texts, ties, repeated rows."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ta", "ro", "mi", "sel", "un", "ké", "ü"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    base = [prose(s, 60) for s in range(6)]
    near = base[0].split(" ")
    near[30] = "changed"
    rows = [(k, t, "en", "a" if k % 2 else "b", len(t)) for k, t in enumerate(base)]
    rows += [
        (10, base[0], "en", "a", 1),
        (11, " ".join(near), None, None, None),
        (12, None, "en", "a", 0),
        (13, "", "en", "b", 0),
        (14, " \t\n ", "en", "b", 4),
        (15, "one", "en", "b", 3),
        (16, "two words", "en", "b", 9),
        (17, "\n".join([base[1], base[1], "", "short line", "short line"]), "en", "b", 9),
        (18, prose(99, 30_000), "en", "c", 9),
        (3, base[3], "en", "a", len(base[3])),
        (None, base[4], "en", "a", 5),
        (None, base[4], "en", "a", 5),
        (19, "THE LOUD\u00a0Ünïcode ✓ 🎉 text\r\nwith\vodd\fspaces and a#b$c%", "en", "c", 5),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ("fp", "component", "component_id", "kept", "llr", "copy", "shuffle_key", "ids", "score", "gone", "hex", "n_words", "n_lines", "doc", "version", "line", "rules", "body", "key")


def frame(spark, rows=None, clashes=False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    return df
