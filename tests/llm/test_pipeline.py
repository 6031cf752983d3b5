"""The pipeline: stages over the small tables and over odd rows."""

import corpus_pipeline
from tests.llm.test_texts import linked

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stage(spark, docs, name, folder=SMALL):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, folder)


def test_stages_against_brute_force(spark, documents, tmp_path):
    docs, seen = documents, {}
    for name, _ in corpus_pipeline.STAGES:
        stage(spark, docs, name).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert docs.columns == COLUMNS
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = seen["quality_rules"].join(labels, "doc_id")
    assert kept.filter("quality = 0").count() == 0
    assert seen["line_dedup"].count() == seen["quality_rules"].count()
    rows = [(r["doc_id"], r["text"]) for r in seen["line_dedup"].collect()]
    want = {i for i, (_, c) in linked(rows, 5, 80).items() if c == i}
    assert {r["doc_id"] for r in seen["near_duplicates"].collect()} == want
    assert seen["decontamination"].count() <= seen["near_duplicates"].count()
    last = seen["tokens"]
    assert last.filter("same").count() == last.count() == seen["decontamination"].count()


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "same"]
    assert rows.filter("not same").count() == 0 < rows.count()


def test_stages_take_odd_rows(spark, odd, empty):
    for rows in (odd, empty):
        docs = rows.selectExpr("doc_id", "text", "lang", "cast(_row as string) source",
                               "cast(length(text) as long) n_chars")
        for name, _ in corpus_pipeline.STAGES:
            assert stage(spark, docs, name).count() <= rows.count()
        assert stage(spark, docs, "tokens").count() == rows.count()
        assert stage(spark, docs, "line_dedup").count() == rows.count()
