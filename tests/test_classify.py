"""One pass for all terms against a test for each term, on texts made of terms and their parts run together."""

import random

from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions.text import normalize
from noticeflow.operators import classify


def test_one_pass_finds_what_each_term_finds(spark):
    rng = random.Random(12)
    terms = sorted({t for pack in (rules.CATEGORIES, rules.AREAS, rules.REQUIREMENTS) for some in pack.values() for t in some} | {t for g in rules.PSYCHOLOGY_GROUPS for t in g} | {"psicolog", "albo", "minori", "salute mentale"})
    texts = [None, "", "x"]
    for _ in range(1500):
        parts = []
        for _ in range(rng.randint(1, 6)):
            t = rng.choice(terms)
            parts.append(rng.choice([t, t, t[: rng.randint(1, len(t))], t[rng.randint(0, len(t) - 1) :], t.upper()]))
        texts.append(rng.choice(["", " ", " ", "-"]).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    t = normalize(F.col("text"))
    expected = df.select("id", classify.infer_category(t), classify.detect_areas(t), classify.extract_requirements(t), classify.relevance_score(t), classify.relevance_label(classify.relevance_score(t)))
    got = classify.classify(df, "text").select("id", "category_found", "areas_found", "requirements_found", "relevance_score_found", "relevance_found")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_tree_pattern_takes_the_longest():
    import re

    words = ["a", "ab", "abc", "abd", "b", " c ", "xyz", "xy"]
    pattern = re.compile(f"(?=({classify._tree_pattern(sorted(words))}))")
    text = "zabdabcab c xyxyz"
    longest = [max((w for w in words if text.startswith(w, k)), key=len, default=None) for k in range(len(text))]
    assert [m.group(1) for m in pattern.finditer(text)] == [w for w in longest if w]
