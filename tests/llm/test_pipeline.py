"""The pipeline's stages on a small table: decisions take effect, clean documents stay."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.fixtures import documents, frames
from wordloom.llm import simhash


def first_of_components(texts):
    """By brute force: the smallest id of each component of fingerprints within three bits."""
    prints = {i: simhash.fingerprint((t or "").encode(), 3) for i, t in texts.items()}
    root = {i: i for i in prints}
    for _ in prints:
        for i in prints:
            root[i] = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
    return set(root.values())


def test_near_copies_go_and_unlike_texts_stay(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    one = " ".join(words)
    near = " ".join([*words[:200], "other", *words[201:]])
    far = " ".join(reversed(words))
    texts = {5: one, 6: near, 7: far, 8: "", 9: None, 10: " ".join(words[:-1])}
    docs = spark.createDataFrame(
        [(i, t, 0, 1) for i, t in texts.items()]
        + [(5, one, 1, 2), (None, one, 2, 3), (None, "lone text of no id", 3, 4)],
        "doc_id long, text string, gone_id int, gone_text int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    assert [i for _, i in ids] == [5, 5, 7, 8, None]
    assert {i for _, i in ids if i is not None} == first_of_components(texts) == {5, 7, 8}


def test_a_chain_of_near_copies_leaves_one(spark):
    words, texts = [f"w{i}" for i in range(3000)], {}
    for i in range(40):
        texts[i] = " ".join([*(f"v{n}" for n in range(i)), *words[i:]])
    texts |= {100 + i: f"another text {i} with no copy {i * 7}" for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stay = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert stay == first_of_components(texts)
    assert len([i for i in stay if i < 40]) < 5 and set(range(100, 120)) & stay


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, _ = frames(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    kept, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/{number}"
        after = stage(spark, kept, folder)
        if number < 4:
            assert after.columns == kept.columns
        after.write.parquet(out)
        kept = spark.read.parquet(out)
        seen.append({r["doc_id"] for r in kept.select("doc_id").collect()})
    everything = {row[0] for row in documents()}
    assert seen[0] == everything
    assert 8 in seen[1] and not {7, 9} & seen[1]
    assert not {0, 1, 2} & seen[1] - {2}
    assert seen[2] - {None} == first_of_components(
        {row[0]: row[1] for row in documents() if row[0] in seen[1] and row[0] is not None})
    assert seen[3] == seen[2] == seen[4]
    text = spark.read.parquet(f"{folder}/3").filter("doc_id = 14").first()["text"]
    assert "AKIA" not in text and "[secret]" in text


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
