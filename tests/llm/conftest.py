import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("size", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("_text_key", T.StringType()),
        T.StructField("node", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text), with columns whose names clash with operators' own."""

    def made(rows):
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "s", "p", "k", "n") for i, t in rows], SCHEMA).repartition(3)

    return made


@pytest.fixture(scope="session")
def texts():
    """A corpus with copies, near copies, shared passages, junk and every odd case."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(60), say(120)
    rows = [(i, say(rng.randint(5, 150))) for i in range(30)]
    rows += [(100 + i, base) for i in range(6)]
    for i in range(8):  # near copies
        changed = base.split()
        changed[rng.randrange(len(changed))] = "edit"
        rows.append((200 + i, " ".join(changed)))
    rows += [(300 + i, say(20) + "\n" + passage + " " + say(20)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "one two"), (405, "a" * 5000), (406, "De " * 300), (407, "ÄÖ Straße 你好 😀 " * 40), (408, say(8000))]
    rows += [(None, say(50)), (None, base), (409, say(40))]
    rows.append(rows[-1])  # a repeated row
    rows.append((409, say(30)))  # another text under its id
    rows.append((405, "a" * 5000))
    return rows
