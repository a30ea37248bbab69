import corpus_pipeline
import pytest

from .test_operators import SCHEMA, corpus, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    toxic = [(100 + i, " ".join([*words(500 + i, 30), "grobian", *words(700 + i, 20)]) + ".", "en", "s", 1, 1, 0.5, 7, "n") for i in range(60)]
    clean = [(300 + i, " ".join(words(2000 + i, 50)) + ".", "en", "s", 1, 1, 0.5, 7, "n") for i in range(60)]
    leak = (400, " ".join(words(41, 30)) + " " + " ".join(words(40, 12)), "en", "s", 1, 1, 0.5, 7, "n")
    spark.createDataFrame([*corpus(), *toxic, *clean, leak], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] < 200)) for r in [*toxic, *clean]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(40, 12)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run(spark, folder):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert not {i for i in got if i is not None and 100 <= i < 200}
    assert all(300 + i in got for i in range(60)) and 400 not in got
    assert 0 in got and not {1, 2} & set(got) and all(r.lossless for r in got.values())
    assert got[10].n_bytes < len(corpus()[10][1])


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0
