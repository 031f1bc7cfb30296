"""The stages of the corpus pipeline on nulls, empties, repeats, copies and clashing columns, and the whole of it."""

import random
from collections import Counter

import corpus_pipeline


def test_stages_and_the_whole_pipeline(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n=60: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    clean = [text() for _ in range(30)]
    item = text(16)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0]), (101, clean[1] + " tail"), (102, clean[2]), (102, clean[2])]  # copies and near copies of earlier ones
    rows += [(200, f"{text(10)} {item} {text(10)}"), (201, " ".join(["again and again"] * 40)), (202, None), (203, ""), (204, "too short")]
    lone, twice = text(), text()
    rows += [(None, lone), (None, f"{text(8)} {item} {text(8)}"), (300, twice), (300, twice)]
    # further columns have the names of inner ones
    table = [(i, t, "en", None if k % 11 == 0 else f"s{k % 3}", len(t or ""), k, "x", k) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tokens long, shard string, __key long"
    spark.createDataFrame(table, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: Counter(str(r["doc_id"]) for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert ids(kept) == ids(docs) - Counter({"201": 1, "202": 1, "203": 1, "204": 1})
    single = stages["near_duplicates"](spark, kept, str(tmp_path))
    assert single.columns == docs.columns
    want = Counter([*map(str, range(30)), "200", "300", "None", "None"])
    assert ids(single) == want
    fair = stages["decontamination"](spark, single, str(tmp_path))
    assert fair.columns == docs.columns and ids(fair) == want - Counter(["200", "None"])
    assert [r["text"] for r in fair.where("doc_id is null").collect()] == [lone]
    mix = stages["mixing"](spark, fair, str(tmp_path))
    assert mix.columns == docs.columns and set(ids(mix)) <= set(ids(fair))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(str(r["doc_id"]) for r in out) == ids(mix)
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
