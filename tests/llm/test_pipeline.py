"""The corpus pipeline on planted documents, held against what each stage must keep."""

import random
import re

import pytest

import corpus_pipeline

RNG = random.Random(5)
WORDS = [f"voc{k}" for k in range(400)]


def prose(n=60):
    return ". ".join(" ".join(RNG.choice(WORDS) for _ in range(12)) for _ in range(n // 12)) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    clean = {k: prose() for k in range(120)}
    junk = {k: " ".join(w + "$$$###" for w in prose().split()) for k in range(200, 260)}
    items = [(k, prose(36)) for k in range(5)]
    held = list((clean | junk).items())
    held += [(300, clean[3]), (301, clean[4] + " more"), (3, clean[3]), (None, prose()), (None, None), (302, ""), (303, prose() + " " + items[2][1] + " " + prose())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in held], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, 0) for k in clean if k % 2] + [(k, 0, 0) for k in junk if k % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, clean


def test_pipeline_keeps_what_it_must(spark, planted):
    folder, clean = planted
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = sorted((r["doc_id"] for r in rows if r["piece"] == 0), key=str)
    assert kept == sorted([*clean, None], key=str)  # no junk, copy, near copy, passage or empty text; the null id stays
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096


def test_stages_return_the_columns_of_documents(spark, planted):
    folder, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_stages_begin_with_freed_memory_given_back(spark):
    jvm = spark._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, pid = field.get(None), jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) // 1024

    held = [unsafe.allocateMemory(64 << 10) for _ in range(1600)]
    for at in held:
        unsafe.setMemory(at, 64 << 10, 1)
    for at in held[:-1]:  # the last one keeps the allocator from giving back the rest by itself
        unsafe.freeMemory(at)
    before = resident()
    assert corpus_pipeline.tidy(lambda spark, docs, sf_dir: resident())(spark, spark.range(1), "") < before - 50
    unsafe.freeMemory(held[-1])
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
