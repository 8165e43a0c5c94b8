import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, repeated passages and lines, and the odd cases."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)] + ["é", "Ünder", "the", "The", "of"] * 3
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, runs = words(70), [" ".join(words(6)) for _ in range(8)]
    texts = []
    for k in range(120):
        w = words(rng.choice([0, 1, 2, 5, 40, 120, 300]))
        if k % 5 == 0:
            w = w[: len(w) // 2] + passage[rng.randrange(8) : 70 - rng.randrange(8)] + w[len(w) // 2 :]
        text = " ".join(w)
        if k % 7 == 0:
            at = rng.randrange(4)
            text = "\n".join([" ".join(words(4)), *runs[at : at + rng.randrange(2, 5)], text, " ".join(words(4))])
        texts.append(text)
    for k in range(20):  # copies and near copies
        texts.append(texts[k * 3])
        w = texts[k * 3].split(" ")
        if w:
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "a a a a " * 60, "x " * 3000, "same\n" * 9, "\n\n\n\n", None]
    return [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents under columns that operators use inside."""
    from pyspark.sql import functions as F

    names = ["chunk", "body", "kind", "bucket", "id", "n", "high", "low", "cluster", "block", "length", "score", "n_lines", "n_removed", "__text", "__toxicity"]
    return docs.withColumns({k: F.lit("clash") for k in names if k not in ("__text",)})
