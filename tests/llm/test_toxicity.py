import inspect
import random

from cases import WORDS, documents
from pyspark.sql import functions as F

from keelson.llm import toxicity
from keelson.llm.toxicity import classify, train


def made(n=400):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(WORDS) for _ in range(rnd.randint(5, 40))]
        junk, toxic = rnd.random() < 0.3, False
        if junk:
            words += ["zzz!!"] * 3
        if rnd.random() < (0.5 if junk else 0.2):
            toxic = True
            words.insert(rnd.randrange(len(words)), "loweq" + rnd.choice("abcdefgh") + str(rnd.randint(0, 99)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(junk), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made()
    docs = documents(spark, [*rows, (9001, None), (9002, ""), (None, "loweqa1 here")])
    given = spark.createDataFrame([x for x in labels if x[0] % 4] + [(9001, None, 1), (5, 0, 0), (7777, 1, 1)], "doc_id long, junk int, toxic int")
    chain = train(docs.select("doc_id", "text"), given, ["junk", "toxic"])
    assert len(chain.models) == 2 and len(chain.models[1].earlier) == 1
    out = classify(docs, chain)
    assert out.columns == [*docs.columns, "p_junk", "p_toxic"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows) + 3
    unseen = [x for x in labels if x[0] % 4 == 0]
    right = sum((got[i]["p_toxic"] >= 0.5) == bool(t) for i, _, t in unseen), sum((got[i]["p_junk"] >= 0.5) == bool(j) for i, j, _ in unseen)
    assert min(right) >= 0.95 * len(unseen)
    assert got[9001]["p_toxic"] == got[9002]["p_toxic"] < 0.5 < got[None]["p_toxic"]


def test_one_class_and_nothing(spark):
    rows, labels = made(30)
    docs = documents(spark, rows)
    given = spark.createDataFrame([(i, 0, 0) for i, *_ in labels], "doc_id long, junk int, toxic int")
    chain = train(docs, given, ["junk", "toxic"])
    assert all(r["p_toxic"] < 0.01 for r in classify(docs, chain).collect())
    chain = train(docs, given.limit(0), ["toxic"])
    assert classify(docs.limit(0), chain).count() == 0
    again = classify(docs.withColumn("p_toxic", F.lit("old")), chain)
    assert dict(again.dtypes)["p_toxic"] == "double"


def test_steps_and_features_are_not_cut():
    assert inspect.signature(toxicity.fit).parameters["steps"].default >= 300
    assert inspect.signature(toxicity.train).parameters["max_features"].default >= 3000
