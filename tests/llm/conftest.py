import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Random documents with copies, near copies, nulls, empty, very short and long texts, repeated rows and a clashing extra column."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(1, 120)), r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    for i in range(120, 220):
        j = r.randrange(120)
        w = rows[j][1].split()
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else " ".join(w), "en", "a"))
    long = text(20_000)
    rows += [(220, None, "en", "a"), (221, "", "en", "a"), (222, "  \n\t ", None, "b"), (223, "one", "de", None), (224, "One", "de", "b"), (225, long, "en", "c"), (226, long + " end", "en", "c"), (7, rows[7][1], rows[7][2], rows[7][3]), (None, rows[3][1], "en", "a"), (227, "123 456 !", "en", "a"), (228, "Grüße ÉTÉ ¿qué? 你好 мир", "de", "a")]
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], DOCS)
    return df.withColumn("label", F.lit("mine")).withColumn("row", F.col("doc_id")).withColumn("mix_n", F.lit(1)).withColumn("score", F.lit(None).cast("double"))
