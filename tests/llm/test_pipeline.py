import corpus_pipeline as P
from pointloom.llm import decontam, lines, packing, toxicity
from pointloom.llm.jaccard import jaccard_join

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    step = P.written(P.reject_toxic(spark, docs, SF))
    assert step.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    assert ids(step) == sorted(set(ids(docs)) - toxic)
    after = P.written(P.dedup_lines(spark, step, SF))
    assert after.columns == docs.columns
    want = {r.doc_id: r.text for r in lines.line_dedup(step).collect() if not r.n_lines or r.n_removed < r.n_lines}
    assert {r.doc_id: r.text for r in after.collect()} == want
    alone = P.written(P.one_of_each_group(spark, after, SF))
    assert ids(alone) == sorted({r.component_id for r in jaccard_join(after).collect()})
    clean = P.written(P.decontaminate(spark, alone, SF))
    hit = {r.doc_id for r in decontam.decontaminate(alone, benchmark).where("n_hit > 0").collect()}
    assert ids(clean) == sorted(set(ids(alone)) - hit) and clean.columns == docs.columns
    assert packing.pack(clean, P.tokenizer_path()).select("doc_id").distinct().count() == clean.count()


def test_lines_go_by_words_too(spark):
    passage = " ".join(f"a{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"x\n{passage}", "en", "s", 1), (2, f"{passage}\ny", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.text for r in P.dedup_lines(spark, docs, SF).orderBy("doc_id").collect()] == [f"x\n{passage}", "y"]


def test_run(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    assert P.run(spark, SF).count() > 0 and P.ORACLE_SQL is None


def test_odd_rows(spark):
    rows = [(None, "text"), (1, None), (2, ""), (3, "words in a row"), (3, "words in a row")]
    docs = spark.createDataFrame([(a, b, None, None, None) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:4]:
        docs = P.written(stage(spark, docs, SF))
    assert {r.doc_id for r in docs.collect()} >= {1, 2, 3}
