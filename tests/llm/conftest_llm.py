import hashlib
import random
import re

import pytest

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="session")
def corpus(spark):
    """Ids and texts with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and ids, odd columns."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnöß") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    rows = [(i, text(rng.randint(20, 60))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(120 + i, rows[3][1] + " " + word()) for i in range(6)]
    rows += [(140 + i, text(15) + " " + shared + " " + text(12)) for i in range(8)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "One"), (204, "one"), (205, text(9000)), (7, rows[7][1]), (None, rows[8][1]), (None, "zz yy xx ww"), (206, "MIT License, the mit-license. Licensed under the Apache License, Version 2.0"), (207, "x" * 300), (208, "x" * 300)]
    rows += [(300 + i, shared[:200] + "é" * i) for i in range(4)]
    return spark.createDataFrame([(i, t, "en", 1, "a", 3) for i, t in rows], "doc_id long, text string, lang string, n_tokens int, score string, __extra int").repartition(3), rows
