"""Hand-computed cases for the scoring rules and an independent Python transcription."""

import re

import pytest
from pyspark.sql import functions as F

from chatloom.functions import lexicon
from chatloom.functions.scoring import parse_score_reply, score, sentiment_flags


def py_score(text: str, continuing: bool = True):
    """Plain-Python transcription of the rules, used as an independent check."""
    low = text.lower()

    def count(fam):
        return sum(1 for p in lexicon.FAMILIES[fam] if re.search(r"\b(?:" + p + r")\b", low))

    sn, sp = count("strong_neg"), count("strong_pos")
    inst = count("instruction")
    if sn > 0:
        s = -0.8 * min(sn / 2.0, 1.0)
    elif sp > 0:
        s = 0.8 * min(sp / 2.0, 1.0)
    else:
        mn, mp = count("mod_neg"), count("mod_pos")
        s = 0.0
        if mn > mp:
            s -= 0.4 * (mn / (mn + mp + 1))
        elif mp > mn:
            s += 0.4 * (mp / (mn + mp + 1))
        if len(text) < 10 and continuing:
            s -= 0.1
        if low.count("?") > 2:
            s -= 0.15
        e = low.count("!")
        if e > 0:
            s = s + 0.1 * min(e, 2) if s >= 0 else s - 0.1 * min(e, 2)
        if inst > 0:
            s = max(s, 0.3)
        if continuing and s == 0:
            s = 0.1
        s = max(-1.0, min(1.0, s))
    w = 1.0
    if inst >= 2:
        w *= 3.0
    elif inst == 1:
        w *= 1.3
    w *= 1.0 + abs(s) * 0.5
    n = len(text)
    if n > 500:
        w *= 2.0
    elif n > 200:
        w *= 1.5
    elif n < 20:
        w *= 0.7
    w = min(w, 5.0)
    phrases = lexicon.DIRECTIVE_PHRASES
    g = w >= 5.0 or s >= 0.7 or (abs(s) >= 0.3 and any(p in low for p in phrases)) or (s < -0.6 and n > 300)
    return s, w, g


CASES = [
    "Thanks! That's a great explanation!",
    "Remember to always format code examples with syntax highlighting",
    "abcdefghi",
    "abcdefghij",
    "a" * 19,
    "a" * 20,
    "a" * 200,
    "a" * 201,
    "a" * 500,
    "a" * 501,
    "aaaaaaaaaa??",
    "aaaaaaaaaa???",
    "aaaaaaaaaa",
    "aaaaaaaaaa!",
    "aaaaaaaaaa!!",
    "aaaaaaaaaa!!!",
    "ñno way",
    "é no way",
    "nooo that is wrong",
    "there is a mistake, please change it",
    "good and helpful, ok",
    "From now on always answer in short form, it is important " + "x" * 500,
    "not good, there is an issue " + "y" * 320,
    "why? how? when? where?",
    "I prefer that you always remember this, it is crucial",
    "ok",
    "😀 emoji text with no feedback 😀",
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, user_message string")
    return {r.i: r for r in score(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scoring_matches_python_rules(scored, i):
    s, w, g = py_score(CASES[i])
    r = scored[i]
    assert r.sentiment == s
    assert r.weight == w
    assert r.is_golden == g


def test_example_dialogue_labels(scored):
    assert scored[0].sentiment == 0.4
    assert scored[1].sentiment == 0.3 and scored[1].is_golden


def test_length_and_punctuation_boundaries(scored):
    assert scored[2].sentiment == pytest.approx(-0.1)  # 9 characters
    assert scored[3].sentiment == 0.1  # 10 characters
    assert scored[4].weight == pytest.approx(1.05 * 0.7)
    assert scored[5].weight == pytest.approx(1.05)
    assert scored[7].weight == pytest.approx(1.05 * 1.5)
    assert scored[9].weight == pytest.approx(1.05 * 2.0)
    assert scored[10].sentiment == 0.1 and scored[11].sentiment == pytest.approx(-0.15)
    assert [scored[i].sentiment for i in (13, 14, 15)] == pytest.approx([0.1, 0.2, 0.2])


def test_unicode_word_boundary(scored):
    assert scored[16].sentiment != -0.4  # 'ñno' is one word
    assert scored[17].sentiment == -0.4


def test_weight_cap_makes_golden(scored):
    r = scored[21]
    assert r.weight == 5.0 and r.is_golden


def test_flags_at_thresholds(spark):
    df = spark.createDataFrame([(0.3,), (-0.3,), (0.31,), (-0.31,)], "sentiment double")
    f = sentiment_flags(F.col("sentiment"))
    rows = df.select(*[v.alias(k) for k, v in f.items()]).collect()
    assert [tuple(r) for r in rows] == [(False, False, True), (False, False, True), (True, False, False), (False, True, False)]


def test_parse_score_reply(spark):
    vals = ["0.7", "-0.35", "Score: .5", "1.9", "-3", "n/a", "", "  0.25  "]
    df = spark.createDataFrame([(v,) for v in vals], "r string")
    got = [r[0] for r in df.select(parse_score_reply(F.col("r"))).collect()]
    assert got == [0.7, -0.35, 1.0, 1.0, -1.0, 0.0, 0.0, 0.25]
    bad = spark.createDataFrame([("0.7", 500)], "r string, status int")
    assert bad.select(parse_score_reply(F.col("r"), F.col("status"))).first()[0] == 0.0


def test_fixture_class_counts_match_recorded_measurement(spark, sf_mid):
    """FIXTURES.md records 24 positive, 14 negative, 141 neutral and 27 golden pairs at sf0.01."""
    from chatloom.queries import QUERIES

    got = {r.sentiment_class: (r.interactions, r.golden) for r in QUERIES["entry_feedback_by_class"](spark, sf_mid).collect()}
    assert {k: v[0] for k, v in got.items()} == {"positive": 24, "negative": 14, "neutral": 141}
    assert sum(v[1] for v in got.values()) == 27
