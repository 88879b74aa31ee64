import numpy as np
from pyspark.sql import functions as F

from prosaic.llm import quality


def _texts(spark):
    draw = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(400)])
    rows = []
    for i in range(2700):
        own = list(draw.choice(words, 60))
        text = " ".join(own) + "." if i % 4 else " ".join([own[0]] * 30 + [own[1]] * 30).upper() + "!!"
        rows.append((i, text, int(i % 4 > 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_accuracy(spark):
    rows = _texts(spark)
    labels = rows.filter("doc_id % 2 = 0").select("doc_id", "quality", F.lit(0).alias("toxic"))
    network, prior = quality.fit(rows, labels)
    assert 0.6 < prior < 0.9
    out = quality.scores(rows, network, prior).join(rows, "doc_id").filter("held_out").toPandas()
    assert ((out["score"] >= 0.5).astype(int) == out["quality"]).mean() > 0.97
    assert (out["predicted"] == (out["score"] >= 0.5)).all()


def test_labels_of_poor_quality_are_not_read(spark):
    rows = _texts(spark)
    labels = rows.select("doc_id", "quality")
    a = quality.fit(rows, labels)
    b = quality.fit(rows, labels.filter("quality = 1"))
    assert a[1] == b[1] and all((x == y).all() for x, y in zip(a[0].weights, b[0].weights))


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(7, 1), (None, 1), (8, None), (11, 1), (12, 1), (1, 1)], "doc_id long, quality int")
    out = quality.scores(odd, *quality.fit(odd, labels)).toPandas()
    assert len(out) == odd.count() and out["score"].between(0, 1).all()
    assert quality.scores(empty, *quality.fit(empty, labels)).count() == 0
    assert quality.scores(odd, *quality.fit(odd, labels.limit(0))).filter("score = 0.5").count() == odd.count()
