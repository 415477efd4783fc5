import random

import pytest
from conftest import one
from pyspark.sql import functions as F

from fathomline import fixed_values as fv
from fathomline.functions import sentiment as sn
from fathomline.operators import sentiment as sent
from fathomline.schemas import FILING_META

X = F.col("x")
GOOD = (
    "Sales were robust and profitability exceeded the plan. Growth showed strong momentum. "
    "The innovative line was profitable with upside. The record year was resilient."
)
BAD = (
    "An impairment and a writedown were booked. Litigation adds uncertainty. "
    "Headwinds led to a decline. Layoffs and restructuring followed the fraud."
)
PLAIN = "The report was filed with the agency. The year ended in December. Offices are in two towns."


def score(spark, text, **options):
    return one(spark, text, sn.score(X, options.pop("lexicon", fv.FINANCE_LEXICON), **options))


@pytest.mark.parametrize("rules", [True, False])
def test_signs_and_order(spark, rules):
    good, bad, plain = (score(spark, t, rules=rules) for t in (GOOD, BAD, PLAIN))
    assert good["compound"] > 0 > bad["compound"] and plain["compound"] == 0 and plain["neu"] == 1
    for s in (good, bad, plain):
        assert -1 <= s["compound"] <= 1 and abs(s["pos"] + s["neu"] + s["neg"] - 1) < 0.01


@pytest.mark.parametrize("text", ["", "  \n ", None])
def test_blank(spark, text):
    assert tuple(score(spark, text)) == (0.0, 1.0, 0.0, 0.0)


def test_override_effect(spark):
    assert score(spark, "Auditors found an impairment.")["compound"] < score(spark, "Auditors found a transaction.")["compound"]
    assert sn.override({"risk": 1.0, "odd": 2.0}, fv.FINANCE_LEXICON) == {"odd": 2.0, **fv.FINANCE_LEXICON}


def test_two_word_terms(spark):
    text = "There is doubt about the going concern."
    assert score(spark, text)["compound"] == 0
    assert score(spark, text, phrases=True)["compound"] < -0.3


def test_hyphenated_terms_are_single_tokens(spark):
    assert score(spark, "A (write-off), again.")["compound"] < 0


def test_head_or_whole_text(spark):
    text = "plain words " * 1000 + "fraud"
    assert score(spark, text, max_chars=10_000)["compound"] == 0
    assert score(spark, text)["compound"] < 0 and score(spark, text)["compound"] == score(spark, text, max_chars=None)["compound"]
    assert abs(score(spark, GOOD * 300)["compound"]) <= 1


def test_level_a_by_hand(spark):
    got = score(spark, "growth, risk RISK!", lexicon={"growth": 1.0, "risk": -1.0}, rules=False, digits=(6, 6))
    assert tuple(got) == (round(2 / 6, 6), 0.0, round(4 / 6, 6), round(-1 / 16**0.5, 6))


def test_rules(spark):
    c = lambda t: score(spark, t)["compound"]
    assert c("robust") > 0 > c("not robust") and c("it isn't robust") < 0
    assert c("very robust sales") > c("robust sales") > c("slightly robust sales")
    assert c("ROBUST sales here") > c("robust sales here") and c("robust sales!!!") > c("robust sales")
    assert c("robust but fraud") < c("robust and fraud")
    assert c("not so very robust") < 0 and c("not a b c robust") > 0


def by_hand(words, lexicon):
    """The rule layer word by word, in plain Python."""
    degree = {w: fv.DEGREE_STEP for w in fv.INTENSIFIERS} | {w: -fv.DEGREE_STEP for w in fv.DAMPENERS}
    low = [w.lower() for w in words]
    loud = [w.isupper() for w in words]
    mixed = 0 < sum(loud) < len(words)
    out = []
    for i, w in enumerate(low):
        if w not in lexicon or w in degree or low[i : i + 2] == ["kind", "of"]:
            out.append(0.0)
            continue
        back = lambda k: low[i - k] if i >= k else None
        v = 0.0 if w == "no" and i + 1 < len(low) and low[i + 1] in lexicon else lexicon[w]
        if "no" in (back(1), back(2)) or back(3) == "no" and back(1) in ("or", "nor"):
            v = lexicon[w] * fv.NEGATION_FACTOR
        if mixed and loud[i]:
            v += fv.CAPS_STEP if v > 0 else -fv.CAPS_STEP
        for k in (1, 2, 3):
            p = back(k)
            if p is None or p in lexicon:
                continue
            between = [back(j) for j in range(1, k)]
            d = degree.get(p, 0.0) + (fv.CAPS_STEP if mixed and loud[i - k] and p in degree else 0.0)
            v += d * ((v > 0) - (v < 0)) * fv.DISTANCE_DAMPING[k - 1]
            if p == "never" and {"so", "this"} & set(between):
                v *= fv.NEVER_SO_FACTOR
            elif p == "without" and "doubt" in between:
                pass
            elif p in fv.NEGATIONS or p.endswith("n't"):
                v *= fv.NEGATION_FACTOR
            if k == 3:
                gram = lambda a, b: " ".join(low[i + a : i + b + 1]) if i + b < len(low) else None
                for a, b in ((0, 2), (0, 1), (-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)):
                    if gram(a, b) in fv.IDIOMS:
                        v = fv.IDIOMS[gram(a, b)]
                        break
                v += sum(degree.get(gram(a, b), 0.0) for a, b in ((-3, -1), (-3, -2), (-2, -1)))
        if back(1) == "least" and "least" not in lexicon and back(2) not in ("at", "very"):
            v *= fv.NEGATION_FACTOR
        if "but" in low and i != low.index("but"):
            v *= fv.BUT_BEFORE if i < low.index("but") else fv.BUT_AFTER
        out.append(v)
    return out


def test_rules_equal_a_walk_by_hand(spark):
    lexicon = {"robust": 1.8, "fraud": -3.5, "kind": 2.4, "no": -1.2, "ass": -2.5, "heart": 1.1, "stop": -1.2}
    pool = (
        "robust fraud kind of sort just enough never so this without doubt least at very no or nor but not isn't bad ass "
        "broken heart kiss death bus stop slightly the town sales ROBUST VERY Fraud"
    ).split()
    rng = random.Random(5)
    texts = [[rng.choice(pool) for _ in range(rng.randint(1, 14))] for _ in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, words array<string>")
    got = {r["k"]: r["v"] for r in df.select("k", sn.rule_valences(F.col("words"), lexicon).alias("v")).collect()}
    for k, words in enumerate(texts):
        assert got[k] == pytest.approx(by_hand(words, lexicon)), words


def test_phrases_of_the_rules(spark):
    c = lambda t: score(spark, t)["compound"]
    assert c("the sales were kind of robust") < c("the sales were then so-called robust")
    assert c("sales were just enough robust") < c("sales were just about robust")
    assert c("they are never so robust") > 0 > c("they are never that robust")
    assert c("the least robust") < 0 < c("at least robust")


def test_phrases_are_looked_up_only_where_they_can_begin_and_end(spark):
    """Every word with a valence was joined to its neighbours and looked up ten times."""
    rules = str(sn.rule_valences(F.col("words"), {"robust": 1.8}))
    assert "begins" in rules and "ends" in rules
    words = [["robust"], ["kind", "of", "robust"], ["a", "b", "c", "bus", "stop"], ["x", "bad", "ass", "robust"], ["x", "robust", "bad", "ass"]]
    lexicon = {"robust": 1.8, "stop": -1.2, "ass": -2.5}
    df = spark.createDataFrame(list(enumerate(words)), "k int, words array<string>")
    got = {r["k"]: r["v"] for r in df.select("k", sn.rule_valences(F.col("words"), lexicon).alias("v")).collect()}
    for k, w in enumerate(words):
        assert got[k] == pytest.approx(by_hand(w, lexicon)), w


def test_many_terms_are_glued_in_one_walk(spark):
    lexicon = {"going concern": -3.5, "going concern basis": -1.0, "material weakness": -3.0, "concern": -0.5}
    got = one(spark, "A Going\n concern, going concern  basis; material weakness. concerned material", sn.join_phrases(X, lexicon)[0])
    assert got == "A Going_concern, going_concern_basis; material_weakness. concerned material"
    assert one(spark, "", sn.join_phrases(X, lexicon)[0]) == "" and one(spark, None, sn.join_phrases(X, lexicon)[0]) is None
    many = {f"term{k} word{k}": 1.0 for k in range(300)}
    assert score(spark, "Term7 word7 and term299  WORD299", lexicon=many, rules=False, phrases=True, digits=(6, 6))["pos"] == round(4 / 5, 6)


def rows(spark):
    data = [("BBB", "2021-05-01", "mda", GOOD), ("AAA", "2022-01-01", "mda", BAD), ("AAA", "2020-01-01", "risk", PLAIN), ("AAA", "bad", "mda", PLAIN)]
    return spark.createDataFrame(
        [(t, "Co", "1", "10-K", d, f"{t}-{d}", s, x) for t, d, s, x in data],
        ", ".join(f"{c} string" for c in [*FILING_META, "section", "text"]),
    )


def test_section_scores_and_series(spark):
    scored = sent.score_sections(rows(spark))
    assert {"pos", "neu", "neg", "compound", "section", *FILING_META} == set(scored.columns)
    series = sent.sentiment_series(scored)
    assert series.schema["filing_date"].dataType.typeName() == "timestamp_ntz"
    got = [(r["ticker"], str(r["filing_date"])[:10]) for r in series.collect()]
    assert got == [("AAA", "2020-01-01"), ("AAA", "2022-01-01"), ("AAA", "None"), ("BBB", "2021-05-01")]


def test_empty_series(spark):
    empty = sent.sentiment_series(sent.score_sections(rows(spark).limit(0)))
    assert empty.count() == 0 and set(empty.columns) == set(sent.empty_sentiment(spark).columns)


def test_missing_metadata_is_empty(spark):
    df = spark.createDataFrame([("mda", GOOD)], "section string, text string")
    assert sent.score_sections(df).first()["ticker"] == ""


def test_lexicon_table(spark):
    base = spark.createDataFrame([("risk", 3.0), ("calm", 1.0), ("calm", 0.5)], "term string, valence double")
    merged = sent.merged_lexicon(base, sent.lexicon_rows(spark))
    terms = {r["term"]: r["valence"] for r in merged.collect()}
    assert terms["risk"] == -1.0 and terms["calm"] == 1.0 and merged.count() == len(fv.FINANCE_LEXICON) + 1


def test_scores_by_table_equal_row_local_scores(spark):
    texts = [GOOD, BAD, PLAIN, "", None, "  \n", "Risk, risk (RISK)! growth...", "risk " * 20_000, "?!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    local = sent.score_texts(df, rules=False, digits=(6, 6)).drop("text")
    table = sent.lexicon_rows(spark).repartition(3)
    by_table = sent.score_by_table(df, "id", table)
    assert sorted(map(tuple, by_table.collect())) == sorted(map(tuple, local.collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a lexicon too large to be sent around
    try:
        assert sorted(map(tuple, sent.score_by_table(df, "id", table).collect())) == sorted(map(tuple, local.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scoring_stays_in_the_jvm(spark):
    plan = sent.score_sections(rows(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
