"""The corpus pipeline on a small folder, stage by stage."""

import random

import corpus_pipeline
from claimspan.llm.common import materialise


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(40)
    docs = [(i, text(rng.randint(30, 120))) for i in range(120)]
    for i in range(100, 112):
        docs[i] = (i, docs[i][1] + "\nShared notice, all rights\n" + text(10))
    docs[20] = (20, docs[3][1])
    near = docs[4][1].split()
    near[5] = "changed"
    docs[21] = (21, " ".join(near * 1)) if len(near) > 100 else (21, docs[4][1] + " ")
    docs[30] = (30, text(20) + " " + item + " " + text(20))
    docs[31] = (31, text(30) + " you idiot scum " + text(10) + " pathetic trash")
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs] + [(500, None, None, None, None), (501, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 31)) for i, _ in docs if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    every = {r[0] for r in rows}
    assert every - set(kept["toxicity"]) == {31}
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    assert "Shared notice" not in kept["line_dedup"][105]["text"] and kept["line_dedup"][105]["n_chars"] == len(kept["line_dedup"][105]["text"])
    assert set(kept["line_dedup"]) - set(kept["ngram_jaccard"]) == {20, 21}
    assert set(kept["ngram_jaccard"]) - set(kept["decontamination"]) == {30}
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in mixed} <= set(kept["decontamination"]) and len(mixed) > 100
    assert all(0 < r["taken"] <= 2 * r["size"] and r["taken"] == sum(x["n_words"] for x in r["parts"]) for r in mixed)
    assert all(r["text"] == kept["decontamination"][r["doc_id"]]["text"] for r in mixed)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _row long, _key long, predicted int, size long, taken int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(i, f"text number {i} of some words", "en", None, 1, 0.5, 1, 2, 3, 4, 5) for i in (1, 2, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            assert got.columns[:5] == list(corpus_pipeline.COLUMNS) and got.count() == len(rows), name


def test_rows_without_or_with_one_id(spark, tmp_path):
    rng = random.Random(15)
    vocab = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, a, b, c, d = text(40), text(60), text(60), text(60), text(60)
    leak, other = f"{text(20)} {item} {text(20)}", f"{text(20)} {item} {text(20)}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a), (7, a), (None, b), (None, b), (8, c), (8, c), (9, d), (9, leak), (None, other), (10, ""), (10, ""), (None, None), (11, None)]
    rows += [(i, text(60)) for i in range(100, 160)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    want = [(7, a), (None, b), (8, c), (9, d), (9, leak), (None, other), (10, ""), (None, None), (11, None)] + rows[-60:]
    assert sorted(near, key=str) == sorted(want, key=str)
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()]
    assert sorted(clean, key=str) == sorted((r for r in rows if r[1] not in (leak, other)), key=str)


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: sum(1 for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "shuffle_" in f)
    before = files()
    stored = materialise(spark.range(1000).repartition(3, "id"), "no-shuffle")
    left = files()
    assert left <= before and stored.count() == 1000
