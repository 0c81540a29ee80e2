import math
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from foldstore.llm import hashing, toxicity

BAD = ["grobian", "dummkopf", "zimtzicke"]


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = i % 6 == 0
        for _ in range(2 if toxic else 0):
            # One family of expressions occurs in forms that are rare each.
            w.insert(r.randrange(len(w)), r.choice([*BAD, "flegel" + "".join(r.choice("abcdefgh") for _ in range(4))]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark, labelled):
    docs, labels = labelled
    got = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).join(labels, "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.tox_score >= 0.5) == (r.toxic == 1) for r in held)
    assert len(held) > 100 and right / len(held) > 0.97 and all(0 <= r.tox_score <= 1 for r in got)


def test_unseen_forms_and_empty_texts(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(1, "lamo rena flegelxyzq sor tul flegelqqq nam"), (2, ""), (3, None), (4, "tul nam sor"), (4, "tul nam sor")], "doc_id long, text string")
    s = {}
    for r in toxicity.score(new, model, ["doc_id"]).collect():
        s.setdefault(r.doc_id, []).append(r.tox_score)
    assert s[1][0] > 0.5 and s[2][0] < 0.5 and s[2] == s[3] and s[4][0] < 0.5 and s[4][0] == s[4][1] and len(s[4]) == 2


def test_labels_of_held_out_rows_are_never_seen(spark, labelled):
    from pyspark.sql import functions as F

    docs, labels = labelled
    lies = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, lies))
    assert (a[0] == b[0]).all() and (a[1].weights == b[1].weights).all()


def test_nulls_repeats_and_missing_classes(spark, labelled, corpus):
    docs, labels = labelled
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    twice = labels.union(labels).union(spark.createDataFrame([(5, None), (None, 1)], labels.schema))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, twice)
    assert (a[0] == b[0]).all()
    assert toxicity.score(corpus, a, corpus.columns).count() == corpus.count()
    assert toxicity.score(corpus.limit(0), a, ["doc_id"]).count() == 0
    assert toxicity.score(corpus, None, ["doc_id"]).where("tox_score <> 0").count() == 0


def test_evidence_does_not_fade_as_the_labelled_rows_grow(spark):
    from pyspark.sql import functions as F

    # 6 of 80 toxic and 3 of 1,520 ordinary documents hold the word, in new surroundings each time, 30-fold at first and then 300-fold.
    def learned(times):
        rows = spark.range(1600 * times).select("id", (F.col("id") % 20 == 0).alias("bad"), F.expr("pmod(xxhash64(id), 100000)").alias("h"))
        held = F.expr("(bad and id % 40 = 0 and id % 1600 < 240) or (not bad and id % 1600 in (1, 2, 3))")
        text = F.concat_ws(" ", *[F.expr(f"concat('w', pmod(xxhash64(id, {k}), 3000))") for k in range(4)], F.when(held, F.lit("grobian")), F.expr("concat('w', pmod(xxhash64(id, 9), 3000))"))
        model = toxicity.fit(rows.select(F.col("id").alias("doc_id"), text.alias("text")), rows.select(F.col("id").alias("doc_id"), F.col("bad").cast("int").alias("toxic")))
        return toxicity.features(pa.array(["grobian"]), model[0])[0, 0]

    few, many = learned(10), learned(100)
    assert few > 1 and abs(many - math.log((6 / 80) / (3 / 1520))) < 0.3


def test_words_of_one_stem_keep_their_own_evidence(spark):
    # A thousand ordinary words of four bytes, and as many that share six bytes with a toxic one, leave a toxic word's evidence alone.
    letters = "abcdefghij"
    plain = [f"{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in "xy"] + [f"grobia{a}{b}{c}" for a in letters for b in letters for c in letters]
    r = random.Random(9)
    docs = [(i, " ".join([*r.sample(plain, 200), *(["grobian", "zimt"] if i % 5 == 0 else [])])) for i in range(1000)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1000)], "doc_id long, toxic int"))
    got = toxicity.features(pa.array(["grobian", "zimt", *plain]), model[0])[:, 0]
    assert (got[:2] > 4).all() and (got[2:] < 2).all()


def plain_models(rows):
    """The evidence of stems, words and bigrams of (text, label), with dictionaries alone."""
    words, pairs, heads, seen = defaultdict(lambda: (set(), Counter())), defaultdict(lambda: [set(), 0]), Counter(), Counter()
    for text, label in rows:
        w = text.split()
        at = lambda k: w[k] if 0 <= k < len(w) else None  # noqa: E731, B023
        for k in {x: k for k, x in reversed(list(enumerate(w)))}.values():
            if label:
                words[w[k]][0].add((at(k - 2), at(k - 1), at(k + 1), at(k + 2)))
            else:
                words[w[k]][1]["documents"] += 1
        first = {}
        for k in range(1, len(w)):
            first.setdefault((w[k - 1], w[k]), k)
        for (v, x), k in first.items():
            heads[v, label] += 1
            if label:
                pairs[v, x][0].add((at(k - 2), at(k + 1)))
            else:
                seen[v, x] += 1
    toxic = sum(label for _, label in rows)
    D, firm, d = max(toxicity.DISCOUNT, toxic * toxicity.SHARE), toxic * toxicity.SHARE, max(toxicity.PAIR_DISCOUNT, toxic * toxicity.PAIR_SHARE)
    word_n = {w: (len(c[0]), c[1].total()) for w, c in words.items()}
    kinds = lambda group, n: {g: tuple(sum(n[w][k] for w in ws) for k in (0, 1)) for g, ws in group.items()}
    is_firm = {w: tuple(int(c > firm) for c in n) for w, n in word_n.items()}
    by_sub, by_stem, sub_of = defaultdict(list), defaultdict(list), defaultdict(set)
    for w in words:
        by_sub[w[:6]].append(w)
        by_stem[w[:4]].append(w)
        sub_of[w[:4]].add(w[:6])
    sub_n, stem_n = kinds(by_sub, is_firm), kinds(by_stem, is_firm)
    uses = lambda n: sum(c > 0 for c in n) + toxicity.SOME

    def level(counts, discount, below, share):
        whole = [sum(n[k] for n in counts.values()) for k in (0, 1)]
        lost = [sum(min(n[k], discount) for n in counts.values()) for k in (0, 1)]
        back = sum(lost) / sum(whole)
        return {x: tuple((1 - back) * max(n[k] - discount, 0) / (whole[k] - lost[k]) + back * below(x)[k] * share(x) for k in (0, 1)) for x, n in counts.items()}

    all_uses = sum(map(uses, stem_n.values()))
    p_stem = level(stem_n, toxicity.STEM_DISCOUNT, lambda x: (1, 1), lambda x: uses(stem_n[x]) / all_uses)
    p_sub = level(sub_n, toxicity.STEM_DISCOUNT, lambda x: p_stem[x[:4]], lambda x: uses(sub_n[x]) / sum(uses(sub_n[y]) for y in sub_of[x[:4]]))
    p_word = level(word_n, D, lambda x: p_sub[x[:6]], lambda x: uses(word_n[x]) / sum(uses(word_n[y]) for y in by_sub[x[:6]]))
    known = {x: (len(c) - d, max(seen[x] - d, 0)) for x, (c, _) in pairs.items() if len(c) > d}
    ratio = lambda p: math.log(p[0] / p[1])
    out, backs = {}, {}
    for v, x in known:
        begun = [max(1, heads[v, 1]), max(1, heads[v, 0])]
        back = [1 - sum(n[k] for (u, _), n in known.items() if u == v) / begun[k] for k in (0, 1)]
        out[v, x] = ratio([known[v, x][k] / begun[k] + back[k] * p_word[x][k] for k in (0, 1)])
        backs[v] = ratio(back)
    return {x: ratio(p) for x, p in p_word.items()}, {x: ratio(p) for x, p in p_sub.items()}, {x: ratio(p) for x, p in p_stem.items()}, out, backs


def test_models_against_dictionaries(spark):
    from pyspark.sql import functions as F

    r = random.Random(12)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(150)]
    docs = []
    for i in range(500):
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            for _ in range(3):
                k = r.randrange(len(w))
                w[k:k] = r.choice([["dumm", "kopf"], ["kopf", r.choice(words)], ["flegel" + r.choice(words)]])
        docs.append((i, " ".join(w)))
    docs += docs[:40]
    labels = [(i, int(i % 4 == 0)) for i in range(450)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table, _ = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    known = toxicity.labelled(df, spark.createDataFrame(labels, "doc_id long, toxic int")).cache()
    size = known.select("doc_id").distinct().count()
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(toxicity.CALIBRATION_SHARE, toxicity.CALIBRATION_ROWS / size) * (1 << 20))
    # D, firm words and the like follow the documents of both parts; this corpus is far below where they grow.
    word, sub, stem, pair, backs = plain_models([(x.text, x.label) for x in known.where(~aside).collect()])
    held = dict(zip(table["key"].tolist(), table["value"].tolist(), strict=True))
    of = lambda text, n: hashing.words(*(lambda b: (b[0], b[1]))(hashing.buffers(pa.array([text]))), hashing.ALNUM, (n,))[0][0]
    checked = 0
    for found, level, n in ((word, toxicity.WORD, None), (sub, toxicity.SUB, 6), (stem, toxicity.STEM, 4)):
        for x, value in found.items():
            got = held.pop(int(toxicity.keys(of(x, n), level)[0]), None)
            if got is not None:
                assert got == pytest.approx(value, abs=1e-9), (level, x)
                checked += 1
    for (v, x), value in pair.items():
        assert held.pop(int(toxicity.pair_keys(of(v, None), of(x, None))[0])) == pytest.approx(value, abs=1e-9)
    for v, value in backs.items():
        assert held.pop(int(toxicity.keys(of(v, None), toxicity.HEAD)[0])) == pytest.approx(value, abs=1e-9)
    assert not held and checked > 200 and pair


def test_bigrams_of_ordinary_words_are_found(spark):
    r = random.Random(13)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    docs = []
    for i in range(800):
        w = [r.choice(words) for _ in range(60)]
        for _ in range(6):  # both words are as frequent in ordinary documents, but never next to each other
            k = r.randrange(59)
            w[k : k + 2] = ["gelbe", "ruebe"] if i % 5 == 0 else [r.choice(["gelbe", "ruebe"]), r.choice(words)]
        docs.append((i, " ".join(w)))
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(800)], "doc_id long, toxic int"))
    apart, together = toxicity.features(pa.array(["ruebe gelbe", "gelbe ruebe"]), model[0])[:, 0]
    assert together > apart + 0.5


def test_long_texts_and_a_kept_score(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    plain = docs.where("doc_id = 1").first().text
    rows = [(1, plain, 5.0), (2, " ".join([plain] * 3000), 6.0), (3, "grobian dummkopf " + plain, 7.0)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, tox_score double"), model, ["doc_id", "tox_score"])
    assert got.columns == ["doc_id", "tox_score"]
    s = {x.doc_id: x.tox_score for x in got.collect()}
    assert s[1] < 0.5 and s[2] < 0.5 and s[3] > 0.5


def test_rare_words_are_entries_however_large_the_input(spark):
    from pyspark.sql import functions as F

    # 24,000 documents of either class; each of 200 words is in three documents of one class.
    toxic = F.col("id") % 2 == 1
    rare = F.when(F.col("id") < 600, F.concat(F.when(toxic, F.lit("bad")).otherwise(F.lit("gut")), F.expr("id div 6").cast("string")))
    text = F.concat_ws(" ", *[F.expr(f"concat('w', pmod(xxhash64(id, {k}), 1000))") for k in range(3)], rare, F.expr("concat('w', pmod(xxhash64(id, 9), 1000))"))
    rows = spark.range(48_000).select(F.col("id").alias("doc_id"), text.alias("text"), rare.alias("rare"), toxic.cast("int").alias("toxic"))
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "toxic")
    table, _ = toxicity.fit(docs, labels)
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(toxicity.CALIBRATION_SHARE * (1 << 20))
    counted = toxicity.labelled(docs, labels).where(~aside).join(rows.select("doc_id", "rare"), "doc_id").where("rare is not null").groupBy("rare").count().collect()
    words = [r.rare for r in counted if r["count"] > toxicity.DISCOUNT]
    assert any(r["count"] == 2 for r in counted) and len(words) > 100
    of = lambda text: hashing.words(*hashing.buffers(pa.array([text])), hashing.ALNUM, (None,))[0][0]
    held = set(table["key"].tolist())
    assert [w for w in words if int(toxicity.keys(of(w), toxicity.WORD)[0]) not in held] == []


def test_the_curve_is_fitted_on_every_row(spark):
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(30_000, toxicity.FEATURES)) * [1, 5, 0.1] + [0, 2, 1]
    y = (r.random(30_000) < 1 / (1 + np.exp(-(x @ [1.0, -0.4, 3.0] - 2)))).astype(int)
    y[-5000:] = 1  # what a part of the rows would show otherwise
    rows = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, label int").cache()
    got, again = toxicity.fit_curve(rows.repartition(3)), toxicity.fit_curve(rows.repartition(7))
    assert (got.weights == again.weights).all() and (got.mean == again.mean).all()
    z = np.c_[(x - x.mean(0)) / (x.std(0) + 1e-9), np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        q = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - q) - 1e-2 * w)
    assert got.weights == pytest.approx(w, abs=1e-5)
    assert toxicity.fit_curve(rows.where("label = 1")) is None and toxicity.fit_curve(rows.limit(0)) is None
