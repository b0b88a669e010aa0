"""Small document tables with the awkward cases, and where the driver's tables are."""

import os
import random

from pyspark.sql import types as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    bits = ["the", "of", "er", "tion", "an", "ing", "st", "ou", "é", "re"]
    return " ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def awkward(seed=3):
    """Nulls in any column, empty and long texts, repeated rows, near copies, odd bytes."""
    rng = random.Random(seed)
    long = "\n".join(prose(rng, 60) for _ in range(300))
    base = prose(rng, 120)
    near = base.replace(" the", " THE", 1) + " end"
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, "x" * 3000), (9, "a b a b a b " * 40),
        (10, "one two"), (10, "one two"), (None, prose(rng, 80)), (None, None), (11, "Ünï çødé 日本語 👍 <|endoftext|> 'S It's"),
        (12, "intro " + base[50:500] + " outro"), (13, "All rights reserved.\n" + prose(rng, 70)), (14, "menu | home | about | contact\n" * 20),
    ]
    rows += [(20 + i, prose(rng, rng.randint(1, 150))) for i in range(15)]
    return [(i, t, None if i and i % 3 == 0 else "en", "s", None if t is None else len(t)) for i, t in rows]


def frame(spark, rows, extra=()):
    """A documents table, with columns that clash with results."""
    schema = T.StructType([*T._parse_datatype_string(SCHEMA).fields, *(T.StructField(c, T.StringType()) for c in extra)])
    return spark.createDataFrame([(*r, *("clash" for _ in extra)) for r in rows], schema)
