import zlib

import corpus_pipeline as C


def test_stages_on_odd_rows(spark, corpus, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int")
    path = f"file://{tmp_path}"
    labels.write.parquet(f"{path}/labels.parquet")
    docs = corpus
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{k}")
        back = spark.read.parquet(f"{path}/{k}")
        if name != "packing":
            assert back.columns == corpus.columns, name
        if name == "language_id":
            left = {r.doc_id for r in back.collect()}
            assert not left & {220, 221, 222, 227} and {223, 228} <= left
        if name == "ngram_join":
            ids = [r.doc_id for r in back.where("doc_id is not null").collect()]
            assert len(ids) == len(set(ids)) and not {224, 226} & set(ids)
        docs = back
    assert docs.count() > 0
    assert [n for n, _ in C.STAGES] == ["toxicity", "language_id", "ngram_join", "mixing", "packing"] and C.ORACLE_SQL is None


def test_empty_table(spark, corpus, tmp_path):
    path = f"file://{tmp_path}"
    corpus.limit(0).selectExpr("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert C.run(spark, path).count() == 0
    assert zlib.crc32(b"") == 0


def test_language_stage_rejects_what_no_language_is_near_to(spark):
    text = "the quick brown fox and the lazy dog went over the hill to see what was there for them"
    rows = [(i, " ".join(text.split()[i % 5 :]), "en" if i % 3 else None) for i in range(60)] + [(60, "ж # жщ фюэ!", None), (61, "123 !", None)]
    back = C.language_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r.doc_id for r in back.collect()) == list(range(60)) and back.columns == ["doc_id", "text", "lang"]


def test_each_stage_does_what_a_plain_version_does(spark, tmp_path):
    """Planted toxic documents, letterless texts, copies and near copies, and a small source, stage by stage."""
    import random
    from collections import Counter

    from test_jaccard_join import brute

    r = random.Random(21)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 8))) for _ in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows, toxic = [], set()
    for i in range(900):
        w = text(r.randint(30, 120))
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grobian", "dummkopf", "zimtzicke"]))
        rows.append((i, " ".join(w), "en", "big" if i % 5 else "small"))
    for i in range(900, 1000):
        w = rows[r.choice([k for k in range(900) if k % 6])][1].split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w), "en", "big"))
    rows += [(1000, "1 2 3", "en", "big"), (1001, "", "en", "big"), (1002, None, None, "small")]
    path = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(900)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")

    def stage(name, docs):
        dict(C.STAGES)[name](spark, docs, path).write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    kept = stage("toxicity", docs)
    ids = {x.doc_id for x in kept.collect()}
    assert not ids & toxic and len(ids) >= len(rows) - len(toxic) - 3
    spoken = stage("language_id", kept)
    assert {x.doc_id for x in spoken.collect()} == ids - {1000, 1001, 1002}
    once = stage("ngram_join", spoken)
    want = {d for d, _, least in brute([(x.doc_id, x.text) for x in spoken.collect()]) if d == least}
    assert {x.doc_id for x in once.collect()} == want and len(want) < len(ids) - 80
    mixed = stage("mixing", once)
    times = Counter(x.doc_id for x in mixed.collect())
    assert set(times) == want and times.total() > len(want) and mixed.distinct().count() == len(want)
    packed = stage("packing", mixed).collect()
    assert Counter(x.doc_id for x in packed if x.piece == 0) == times
    tokens = sum(x.length for x in packed)
    assert len({x.sequence_id for x in packed}) <= -(-tokens // 2048) + 1
