"""The stages on a small corpus, against what plain Python says should happen."""

import random
import re

import pytest

import corpus_pipeline

SHARED = "This passage of more than fifty bytes stands in several documents of the corpus. "
ITEM = "Which of the seven bridges of the old town did the walker cross only once before noon on the second day"


@pytest.fixture
def folder(spark, docs, tmp_path):
    rng = random.Random(5)
    vocab = {"en": [f"the{i}ough" for i in "abcdefghij"] + ["the", "of", "and", "with", "that", "water", "light", "river", "stone", "bread"],
             "de": [f"sch{i}ung" for i in "abcdefghij"] + ["der", "und", "nicht", "mit", "das", "wasser", "licht", "fluss", "stein", "brot"]}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(vocab[lang]) for _ in range(rng.randint(40, 90))]
        rows.append([i, " ".join(words), lang, "abc"[i % 3]])
    rows[20][1] = rows[10][1]                                   # an exact copy
    rows[30][1] = rows[11][1] + " more"                         # a near copy
    for i in (40, 41, 42):
        rows[i][1] = SHARED + rows[i][1]
    rows[50][1] += " " + ITEM.upper()
    rows.append([200, "12345 !! 678", None, "a"])
    rows.append([201, None, None, None])
    docs([tuple(r) for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {r[0]: r[1] for r in rows}


def test_stages(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    gone = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        after = spark.read.parquet(f"{tmp_path}/stage{k}")
        gone[name] = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in after.select("doc_id").collect()}
        docs = after
    assert gone == {"language_id": {200, 201}, "jaccard_join": {20, 30}, "suffix_dedup": set(), "decontaminate": {50}}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept[40].startswith(SHARED) and SHARED[:50] not in kept[41] and SHARED[:50] not in kept[42]
    untouched = set(texts) - {200, 201, 20, 30, 50, 41, 42}
    assert all(kept[i] == texts[i] for i in untouched)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id: r.size for r in mixed} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in kept.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(map(tuple, mixed))
