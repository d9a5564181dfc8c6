"""The pipeline: every stage works on what its predecessor kept, and its decisions take effect."""

import random

import pytest

import __spark_entry__ as entry
from tests.llm.test_operators import passage


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("tables"), random.Random(2)
    shared, rows, labels = passage(77, 60), [], []
    for i in range(400):
        words = passage(1000 + i, 90).split()
        if i % 5 == 0:
            words[rng.randrange(90)] = "idiot"
            words[rng.randrange(90)] = "worthless"
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(500, rows[1][1].upper(), "en", "s", 0), (501, rows[2][1].replace(" ", "  "), "en", "s", 0), (502, passage(5, 50) + " " + shared, "en", "s", 0), (503, shared + " " + passage(6, 50), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables).cache()
        if name != "packing":
            assert docs.columns == seen[0].columns
        seen.append(docs)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    toxic = {i for i in range(400) if i % 5 == 0}
    assert len(toxic - ids[1]) >= 0.9 * len(toxic) and not ({i for i in range(400)} - toxic) - ids[1]
    assert 1 not in ids[2] and 500 in ids[2]
    assert 501 not in ids[3] and 2 in ids[3]
    left = {r["doc_id"]: r["text"] for r in seen[4].where("doc_id in (502, 503)").collect()}
    assert left == {502: passage(5, 50), 503: passage(6, 50)}
    assert ids[5] == ids[4] == ids[3]


def test_registered(spark, tables):
    queries = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in queries if q.startswith("op")} and "pipeline" in queries
    assert queries["pipeline"](spark, tables).count() > 100
