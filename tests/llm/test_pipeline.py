"""The pipeline, stage by stage, and the registration of all eleven queries."""
import __spark_entry__ as entry
import corpus_pipeline
from feedloom.llm import compress_quality, quality_rules
from feedloom.llm.common import table


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {n for n in range(1, 14)} == {int(x[2:].split("_")[0]) for x in names if x.startswith("op")}


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kinds = docs.dtypes
    first = corpus_pipeline.classify(spark, docs, sf).cache()
    model = compress_quality.fit(docs, table(spark, sf, "labels"))
    good = {r.doc_id for r in compress_quality.score(docs, model).filter("predicted = 1").collect()}
    assert first.dtypes == kinds and {r.doc_id for r in first.collect()} == good
    second = corpus_pipeline.rule(spark, first, sf).cache()
    kept = {r.doc_id for r in quality_rules.judge(first, table(spark, sf, "labels")).filter("kept").collect()}
    assert second.dtypes == kinds and {r.doc_id for r in second.collect()} == kept
    third = corpus_pipeline.deduplicate(spark, second, sf).cache()
    from feedloom.llm.simhash import near_duplicates

    stays = {r.component_id for r in near_duplicates(second).collect()}
    assert third.dtypes == kinds and {r.doc_id for r in third.collect()} == stays
    packed = corpus_pipeline.pack(spark, third, sf)
    assert {r.doc_id for r in packed.collect()} == stays
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 4


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns) and rows.count() > 0


def test_stored_stages_go(spark, sf, monkeypatch):
    from feedloom.streaming.tables import Folder

    made = []
    monkeypatch.setattr(corpus_pipeline, "Folder", lambda spark, path: made.append(path) or Folder(spark, path))
    corpus_pipeline.run(spark, sf).count()
    assert Folder(spark, made[0]).names("") == [str(len(corpus_pipeline.STAGES) - 1)]


def test_odd_rows_in_every_stage(spark, sf, odd_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables."""
    labels = [(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd_docs = odd_docs.withColumn("_v", odd_docs.lang).withColumn("_stays_id", odd_docs.lang)
    rows = odd_docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_docs, str(tmp_path))
        assert got.dtypes == odd_docs.dtypes, name
        assert all(r in rows for r in got.collect()), name
        assert stage(spark, odd_docs.limit(0), str(tmp_path)).count() == 0, name
    kept = corpus_pipeline.deduplicate(spark, odd_docs, str(tmp_path)).collect()
    from feedloom.llm.simhash import near_duplicates

    assert len(kept) == len({r.component_id for r in near_duplicates(odd_docs).collect()})
    # Ids that tell rows apart take the other way, to the same rows.
    told = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    some = {r.doc_id for r in corpus_pipeline.deduplicate(spark, told, str(tmp_path)).collect()}
    assert some == {r.component_id for r in near_duplicates(told).collect()}
    assert corpus_pipeline.pack(spark, odd_docs, str(tmp_path)).filter("start = 0").count() == len(rows)
    assert corpus_pipeline.pack(spark, no_docs, str(tmp_path)).count() == 0
