"""The corpus pipeline, stage by stage, against what each stage's operator says of its own input."""

import corpus_pipeline as P
from terrace.llm import mixing, ngram_join, packing, quality_pu, toxicity
from terrace.llm.common import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    out = [docs]
    for _, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], sf_dir)))
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in out[:5]]
    assert all(d.columns == docs.columns for d in out[:5])
    assert ids[1] == sorted(r.doc_id for r in toxicity.op8(out[0], labels).where("score < 0.7").collect())
    assert ids[2] == sorted(r.doc_id for r in quality_pu.op2(out[1], labels).where(f"score >= {P.LEAST_QUALITY}").collect())
    assert ids[3] == sorted({r.component_id for r in ngram_join.jaccard_components(out[2], 5, 80).collect()})
    drawn = mixing.draw_blocks(mixing.sized(out[3]), block_words=None).where("shard IS NOT NULL")
    assert ids[4] == sorted(r.doc_id for r in drawn.collect())
    want = packing.op7(out[4]).groupBy().sum("length").first()[0]
    assert out[5].groupBy().sum("length").first()[0] == want
    whole = P.run(spark, sf_dir)
    keys = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(*keys).collect())) == sorted(map(str, out[5].select(*keys).collect()))


def test_texts_of_one_id_are_two_documents(spark, docs):
    """Unrelated texts under one id both stay; near copies and repeated rows go but for one, the same in every run."""
    one, two = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    table = docs((1, one), (1, two), (1, two), (2, one), (3, one + " end"), (4, None), (4, ""), (None, one), (5, "short"))
    got = sorted(((r.doc_id, r.text) for r in P.drop_copies(spark, table, "").collect()), key=str)
    assert got == sorted([(1, one), (1, two), (4, None), (4, ""), (None, one), (5, "short")], key=str)


def test_stages_take_empty_tables(spark, docs, sf_dir):
    none = docs((1, "x")).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, sf_dir).collect() == []


def test_clashing_and_missing_names(spark):
    from terrace.llm.common import columns_of

    df = spark.createDataFrame([(1, "a", "b")], "DOC_ID long, text string, TEXT string")
    assert tuple(columns_of(df, doc_id="long", text="string", lang="string").first()) == (1, "a", None)


def test_stages_take_clashing_and_missing_columns(spark, docs, sf_dir):
    """An extra TEXT, a column less: every stage but the last returns the columns of documents, from the column of the exact name."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80))) for i in range(6)]
    table = docs(*rows).drop("n_chars").selectExpr("*", "'clash' AS TEXT", "1 AS Source", "2 AS score")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, table, sf_dir)
        assert got.columns == P.COLUMNS and {r.text for r in got.collect()} <= {t for _, t in rows}
    assert P.STAGES[-1][1](spark, table, sf_dir).count() > 0
