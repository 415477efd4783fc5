import random

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm import language_id as li, quality as ql

EN = "the house and garden with their thing which should never have been there".split()
DE = "das haus und der garten mit ihren dingen welche niemals dort gewesen sein sollten".split()


def trained():
    rng = random.Random(2)
    return li.fit([(x, [rng.choice(pool) for _ in range(30)]) for x, pool in (("en", EN), ("de", DE)) for _ in range(40)])


def test_spans_follow_the_switch(spark):
    mixed = "  The house and garden, with their thing; das Haus und der Garten mit ihren Dingen!"
    rows = [(1, mixed), (2, None), (3, ""), (4, "12 ?!"), (5, " ".join(EN * 3000)), (1, mixed), (None, "the house")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(0)).withColumn("lang", F.lit("x"))
    got = [(r["doc_id"], r["spans"]) for r in li.label_spans(table, trained()).collect()]
    assert len(got) == len(rows)
    by_id = dict(got)
    assert [mixed[s["start"] : s["start"] + s["length"]] for s in by_id[1]] == [
        "The house and garden, with their thing", "das Haus und der Garten mit ihren Dingen"
    ]
    assert [s["lang"] for s in by_id[1]] == ["en", "de"] and all(0.5 < s["chance"] <= 1 for s in by_id[1])
    assert by_id[2] == by_id[3] == by_id[4] == [] and [s["lang"] for s in by_id[5]] == ["en"] == [s["lang"] for s in by_id[None]]
    assert by_id[5][0]["length"] == len(rows[4][1])
    assert {len(r["spans"]) for r in li.label_spans(table, None).collect()} == {0}
    assert li.label_spans(table.limit(0), trained()).count() == 0


def test_spans_have_the_likeliest_label_of_each_word():
    """All labellings of a short text, each weighed by hand."""
    chain = trained()
    own = "the haus and der sein thing".split()
    score, n = chain.emissions(own), len(own)
    mass = np.zeros((n, 2))
    for code in range(2**n):
        path = [(code >> k) & 1 for k in range(n)]
        weight = np.exp(sum(score[k, x] for k, x in enumerate(path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:])))
        for k, x in enumerate(path):
            mass[k, x] += weight
    wanted = (mass / mass.sum(1, keepdims=True)).argmax(1)
    text = " ".join(own)
    labels = []
    for s in li.Labeller(chain).spans(text):
        labels += [chain.languages.index(s["lang"])] * len(text[s["start"] : s["start"] + s["length"]].split())
    assert labels == list(wanted)


def test_samples_bound_rows_of_one_id(spark, monkeypatch):
    ids = [k for k in range(40) if not spark.range(1).select(ql.held_out(F.lit(k))).first()[0]][:20]
    rng = random.Random(4)
    rows = [(ids[0], " ".join(rng.choices(EN, k=12)), "en") for _ in range(300)] + [(ids[0], "the house", "en")] * 300
    rows += [(k, " ".join(rng.choices(DE, k=12)) + "!!" * (k % 2), "de") for k in ids[1:]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).cache()
    seen = {}
    monkeypatch.setattr(li, "fit", lambda samples: seen.setdefault("li", samples) and None)
    li.train(table, sample_docs=50)
    assert len(seen["li"]) == 50 and {x for x, _ in seen["li"]} <= {"en", "de"}
    li_all = []
    monkeypatch.setattr(li, "fit", li_all.extend)
    li.train(table, sample_docs=5000)
    assert 19 < len(li_all) <= 320 and sum(own == ["the", "house"] for _, own in li_all) == 1
    fitted = []
    monkeypatch.setattr(ql, "fit_pairs", lambda x, good, *_: fitted.append((len(x), len(good))))
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    ql.train(table, labels, sample_rows=30)
    assert fitted == [(30, 30)]
