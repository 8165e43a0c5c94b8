import random
import zlib

import pytest

from pointloom.llm.toxicity import SCORE, fit, score, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    syllables = ["an", "the", "or", "ing", "tion", "re", "st", "ou", "ble", "ha"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for k in range(1600):
        toxic = k % 5 == 0
        w = [word() for _ in range(rng.randrange(60, 200))]
        if toxic:
            for _ in range(max(4, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(["zwickel", "gnarfobat", "pluxed", "vomrick" + word()]))
        docs.append((k, " ".join(w)))
        if k % 4:
            labels.append((k, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, "  \n"), (5003, "x" * 30000)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")


def test_held_out_accuracy(labelled):
    got = {r.doc_id: r for r in toxicity(*labelled).collect()}
    assert len(got) == 1604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 1600]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    right = [r.predicted == int(r.doc_id % 5 == 0) for r in held]
    assert sum(right) >= 0.93 * len(right)


def test_all_columns_stay(labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    got = score(docs.withColumn(SCORE, F.lit("x")).withColumn("toxic", F.lit(1)), fit(docs, labels))
    assert got.columns == ["doc_id", "text", "toxic", SCORE] and got.count() == 1604


def test_too_few_labels(labelled, spark):
    docs, labels = labelled
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.1}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_one_long_text_and_repeated_ids_change_nothing(labelled, spark):
    """A labelled text beyond the sample's bounds is left out alone; of rows that share an id always the same counts."""
    from pyspark.sql import functions as F

    docs, labels = labelled
    model = fit(docs, labels)
    assert len(model.weights) and len(model.ordinary) > len(model.toxic) > 0
    ids = [k for k in range(7000, 7012)]
    long = spark.range(7000, 7012).select(F.col("id").alias("doc_id"), F.expr("repeat('pluxed word ', 200000)").alias("text"))
    more = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    huge = long.limit(1).select(F.lit(6999).cast("long").alias("doc_id"), F.expr("repeat(text, 15)").alias("text"))  # 36 MB
    got = fit(docs.unionByName(long).unionByName(huge), labels.unionByName(more).unionByName(spark.createDataFrame([(6999, 1)], "doc_id long, toxic int")))
    assert (got.toxic, got.ordinary) == (model.toxic, model.ordinary)
    twice = docs.unionByName(docs.where("doc_id < 300").withColumn("text", F.concat("text", F.lit(" other"))))
    one, two = fit(twice.repartition(3), labels), fit(twice.orderBy(F.desc("doc_id")).repartition(7), labels)
    assert (one.toxic, one.ordinary, one.weights.tolist()) == (two.toxic, two.ordinary, two.weights.tolist())
    assert toxicity(twice, labels).groupBy("doc_id").count().where("count > 1").count() == 300


def test_scoring_holds_one_slice_beside_a_batch(spark, monkeypatch):
    """Workers of an executor run side by side, so a batch's text is not copied whole."""
    import tracemalloc

    import pyarrow as pa

    from pointloom.llm.toxicity import train

    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    held = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: held.append(f))
    score(df, train([], (1.0, 1.0)))
    batch = pa.record_batch([pa.array(range(64)), pa.array(["word " * 100_000] * 64)], names=["doc_id", "text"])  # 32 MB
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in held[0](iter([batch]))) == 64
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()
