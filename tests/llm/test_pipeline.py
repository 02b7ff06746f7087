import random

import corpus_pipeline
from evograph.llm import packing


def test_stages_on_a_planted_corpus(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passage = "\n".join(" ".join(word() for _ in range(30)) for _ in range(3))
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        lines = [" ".join(word() + ("%%%" if bad else "") for _ in range(rng.randint(8, 30))) for _ in range(rng.randint(2, 6))]
        if not bad and i % 10 == 1:
            lines.insert(1, passage)
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
        labels.append((i, 0 if bad else 1, 0))
    near = [(400 + i, rows[i][1].replace(" ", "  ", 3).upper() if i % 2 else rows[i][1], "en", "s0", 0) for i in range(3, 40, 4)]
    docs = spark.createDataFrame(rows + near, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "near-duplicates", "mixing", "packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = at.collect()
    good = {i for i in range(300) if i % 6} | {r[0] for r in near if (r[0] - 400) % 6}
    assert len({r.doc_id for r in kept["quality classifier"]} ^ good) <= 6
    assert len(kept["line dedup"]) == len(kept["quality classifier"])
    assert sum(passage in r.text for r in kept["line dedup"]) == 1
    ids = {r.doc_id for r in kept["near-duplicates"]}
    accepted = {r.doc_id for r in kept["quality classifier"]}
    assert {i for i in accepted if i < 300} <= ids
    # Copies are emptied by line dedup or found by their shingles; of the empty texts one stays.
    assert len([i for i in ids if i >= 400]) <= 1
    times = {}
    for r in kept["mixing"]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= ids and max(times.values()) <= 3
    encode = packing.Encoder(packing.tokenizer_path())
    want = sum(len(x) // 4 + 1 for x in encode([r.text for r in kept["mixing"]]))
    assert sum(r.length for r in kept["packing"]) == want


def test_stages_take_odd_rows_and_an_empty_table(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and no rows at all, through every stage."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(1, 90))), "en", f"s{i % 2}", 0, 0.5, 7, "x") for i in range(60)]
    rows += [(None, None, None, None, None, None, None, None), (None, rows[3][1], "en", None, 1, 0.1, 1, "y"), (100, "", "en", "s0", 0, None, 2, None), (101, None, "de", "s1", 0, 0.2, None, "z"), rows[5], rows[5], (102, " ".join(word() for _ in range(60_000)), None, "s0", None, 0.9, 3, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, _id long, _copy string")
    spark.createDataFrame([(i, i % 5 > 0, 0) for i in range(60)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "int(quality) as quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for k, start in enumerate((docs, docs.limit(0))):
        at = start
        for j, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if name != "packing":
                assert out.dtypes == docs.dtypes, name
            out.write.parquet(f"{tmp_path}/{k}-{j}")
            at = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}-{j}")
            if k:
                assert at.count() == 0, name
            elif name == "quality classifier":
                scores = {r.doc_id: (r.score, r._id, r._copy) for r in at.collect()}
                assert all(v == (0.5, 7, "x") for i, v in scores.items() if i is not None and i < 60)
