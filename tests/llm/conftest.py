import random
import re

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed=5, n=60):
    """Random texts with copies, near copies, shared passages, odd white space and very long ones."""
    rng = random.Random(seed)
    names = ["ab", "cde", "été", "x", "Foo", "bar,", "qux.", "zz%", "日本", "ne"] + [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(names) for _ in range(60))
    out = []
    for i in range(n):
        words = [rng.choice(names) for _ in range(rng.choice([0, 1, 3, 12, 13, 40, 120, 400]))]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in words)
        kind = i % 6
        if kind == 1 and out:
            text = rng.choice(out)[1] or ""
        elif kind == 2 and out:
            old = (rng.choice(out)[1] or "").split(" ")
            if len(old) > 20:
                old[rng.randrange(len(old))] = "edited"
            text = " ".join(old)
        elif kind == 3:
            text = text + passage + " " + text[:30]
        out.append((3 * i + 2, text))
    out += [(900, None), (901, ""), (902, " \n\t "), (903, "only"), (904, "a a a a a a a a a a a a a a a a a a a a"),
            (905, passage * 60), (906, "x" * 5000), (907, passage)]
    rng.shuffle(out)
    return [(i, t, "en", "s", 1) for i, t in out]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Over several partitions, with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, DDL)
    more = ["place", "key", "p", "blob", "spans", "id", "h", "rules", "score", "bucket", "row", "text_hash", "component_id"]
    return df.selectExpr("*", *(f"'clash' AS {c}" for c in more)).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows and ids, null ids, null columns."""
    long = " ".join(f"t{i}" for i in range(80))
    return spark.createDataFrame([(1, long, None, None, None), (1, long, None, None, None), (1, "other words here", None, None, None),
                                  (None, long, None, None, None), (None, None, None, None, None), (2, None, None, None, None), (3, long + " end", None, None, None)], DDL)
