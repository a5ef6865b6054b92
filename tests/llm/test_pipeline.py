"""The pipeline against plain Python over the same decisions, stage by stage, and on awkward rows."""

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_operators import AWKWARD, SCHEMA, brute_hits, classes, spaced  # noqa: E402

from ringside.llm import language_id, quality  # noqa: E402

SF = "/root/testdata/sf0.001"
pipeline = importlib.import_module("corpus_pipeline")


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(pipeline.STAGES)
    assert list(stage) == ["language_id", "quality_classifier", "jaccard_join", "decontamination", "mixing"]

    first = stage["language_id"](spark, docs, SF).cache()
    marked = language_id.labelled(docs, language_id.fit(docs)).collect()
    assert ids(first) == sorted(r["doc_id"] for r in marked if not r["_lang_rejected"])

    second = stage["quality_classifier"](spark, first, SF).cache()
    figures = quality.measured(first.select("doc_id", "text"))
    scored = quality.scored(figures, quality.fit(figures.drop("text"), spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    assert ids(second) == sorted(r["doc_id"] for r in scored if r["_score"] >= quality.THRESHOLD)

    third = stage["jaccard_join"](spark, second, SF).cache()
    assert ids(third) == sorted({c for _, c in classes([(r["doc_id"], r["text"]) for r in second.collect()]).values()})

    fourth = stage["decontamination"](spark, third, SF).cache()
    assert ids(fourth) == sorted(r["doc_id"] for r in third.collect() if brute_hits(r["text"], benchmark)[1] == 0)
    for kept in (first, second, third, fourth):
        assert kept.columns == docs.columns

    last = stage["mixing"](spark, fourth, SF).collect()
    assert sorted((r["doc_id"], r["size"]) for r in last) == sorted((r["doc_id"], len(spaced(r["text"]))) for r in fourth.collect())
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, last))


def test_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    for rows in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns
        assert pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
