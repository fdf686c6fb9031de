"""The pipeline's stages against brute force, each on what the one before kept."""

import pytest

import corpus_pipeline
from sieveline.llm import decontaminate, jaccard_join
from tests.llm.test_operators import words

BAD = ["vile", "awful", "nasty"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs, labels = [], []
    for i in range(300):
        toxic, junk = i % 10 == 3, i % 10 == 6
        body = words(i, 120)
        if toxic:
            body[10:10] = BAD * 2
        if junk:
            body = ["||"] * 60 + body[:20]
        lines = [" ".join(body[:60]), "every site has this line of text", " ".join(body[60:])]
        docs.append((i, "\n".join(lines), "en", f"s{i % 12}", 0))
        if i % 3:  # of all kinds
            labels.append((i, int(not junk), int(toxic)))
    for k in range(20):  # near copies of document 1, and benchmark passages
        body = docs[1][1].split(" ")
        body[5 * k] = "changed"
        docs.append((400 + k, " ".join(body), "en", f"s{k % 12}", 0))
        docs.append((500 + k, " ".join(words(700 + k, 60) + words(2, 70)[k : k + 20] + words(800 + k, 60)), "en", "s0", 0))
    docs += [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(2, 70)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, kept[-1], tables)
        made.write.mode("overwrite").parquet(f"{tables}/out-{len(kept)}")
        kept.append(spark.read.parquet(f"{tables}/out-{len(kept)}"))
        if len(kept) < 6:
            assert kept[-1].columns == docs.columns, name
    texts = [{r.doc_id: r.text for r in k.collect()} for k in kept[:5]]
    bad = {i for i in range(300) if i % 10 in (3, 6)}
    assert not bad & set(texts[1]) and len(set(range(300)) - bad - set(texts[1])) <= 2
    line = "every site has this line of text"
    assert set(texts[2]) == set(texts[1]) and not any(line in t.split("\n") for t in texts[2].values())
    least = {c for _, _, c in jaccard_join.brute_force(list(texts[2].items()), 5, 80)}
    assert set(texts[3]) == least and len(least) < len(texts[2])
    hit = {r[0] for r in decontaminate.brute_force(list(texts[3].items()), [(1, " ".join(words(2, 70)))]) if r[5]}
    assert set(texts[4]) == set(texts[3]) - hit and hit
    assert {r.doc_id for r in kept[5].collect()} == set(texts[4])


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).count() > 100


def test_near_copies_go_by_rows(spark, tables):
    a, b, c = (" ".join(words(900 + k, 80)) for k in range(3))
    data = [(1, a), (2, a + " end"), (2, b), (None, a), (None, c), (None, c), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, tables).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, a), (2, b), (None, c), (3, "")], key=repr)


def test_workers_give_memory_back(spark, tables, monkeypatch):
    from sieveline.llm import common

    environment = spark.sparkContext.environment
    for key in ("MALLOC_ARENA_MAX", "MALLOC_TRIM_THRESHOLD_", "ARROW_DEFAULT_MEMORY_POOL"):
        monkeypatch.delitem(environment, key, raising=False)
    docs = common.read(spark, str(tables), "documents")

    def seen(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            row = [pa.default_memory_pool().backend_name, os.environ.get("MALLOC_ARENA_MAX"), os.environ.get("MALLOC_TRIM_THRESHOLD_")]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["pool", "arenas", "trim"])

    def of_a_worker():
        return tuple(spark.range(1).mapInArrow(seen, "pool string, arenas string, trim string").first())

    corpus_pipeline.keep_good(spark, docs, str(tables))
    assert of_a_worker() == ("system", "1", "131072")
    environment["MALLOC_TRIM_THRESHOLD_"] = "1000000"  # the session's own value stays
    corpus_pipeline.keep_good(spark, docs, str(tables))
    assert of_a_worker() == ("system", "1", "1000000")
