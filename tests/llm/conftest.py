import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of {doc_id: text} or of (doc_id, text) pairs."""

    def make(texts):
        pairs = texts.items() if isinstance(texts, dict) else texts
        return spark.createDataFrame(
            [(d, t, "en", "a", None if t is None else len(t)) for d, t in pairs], DOCUMENTS
        )

    return make


@pytest.fixture(scope="session")
def tangled():
    """Texts with exact and near copies, shared passages, repeats, nulls and odd characters."""
    draw = random.Random(5)
    vocabulary = [
        "".join(draw.choice("abcdeéßñ") for _ in range(draw.randint(1, 6))) for _ in range(400)
    ]

    def prose(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    texts = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "one two three four", 5: "ONE two three four"}
    passage, base = prose(60), prose(200)
    for d in range(6, 30):
        texts[d] = " ".join(prose(draw.randint(1, 150)))
    for d in range(30, 40):
        texts[d] = " ".join([*prose(20), *passage, *prose(20)])
    for d in range(40, 55):
        copy = list(base)
        for _ in range(draw.randint(0, 3)):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        texts[d] = " ".join(copy)
    for d in range(55, 60):
        texts[d] = texts[40]
    texts[60] = "the " * 300
    texts[61] = "the " * 80 + "of " * 80
    texts[62] = "ab cd " * 90
    texts[63] = "\n".join([" ".join(passage[:20])] * 6)
    texts[64] = "x" * 5000
    texts[65] = "x" * 130 + "é" * 300
    texts[66] = " ".join(passage[3:16])
    texts[67] = " ".join(passage[3:15])
    return texts
