"""Each stage of the pipeline held against a plain version, on what its predecessor kept."""

import random

import corpus_pipeline

from . import brute


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    item = " ".join(rng.choice(plain) for _ in range(40))
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            words = [rng.choice(["vile", "rotten", "nasty"]) if rng.random() < 0.1 else w for w in words] + ["vile", "nasty"]
        text = " ".join(words[:30]) + "\n" + " ".join(words[30:])
        if i % 50 == 1:
            text = rows[-10][1] if len(rows) > 10 else text
        if i % 40 == 3:
            text += "\n" + item
        if i % 10 == 7:
            text = "A LINE that ten documents or more hold\n" + text
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, brute.DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(docs)
    assert all(x.columns == ["doc_id", "text", "lang", "source", "n_chars"] for x in kept[:-1])

    clean, lines, near, free = ([tuple(r) for r in x.collect()] for x in kept[:-1])
    rejected = {r[0] for r in rows} - {r[0] for r in clean}
    assert all(i % 6 == 0 for i in rejected) and len(rejected) > 85
    want = brute.kept_lines(clean)
    assert {r[0]: r[1] or "" for r in lines} == {d: t for d, (_, _, t) in want.items()}
    assert all(r[4] == len(r[1]) for r in lines if r[1] is not None)
    assert {r[0] for r in near} == {d for d, x in brute.components(lines).items() if x[2]}
    assert {r[0] for r in free} == {d for d, x in brute.contamination(near, [(7, item)]).items() if not x[4]}
    size, target = brute.targets(free)
    source = {r[0]: r[3] for r in free}
    taken = dict.fromkeys(size, 0)
    last = kept[-1].collect()
    assert {r["doc_id"] for r in last} == set(source)
    for r in last:
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size)

    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last))
