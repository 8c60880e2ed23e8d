import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.functions.distance import ALGORITHMS, batch_distance, byte_view, common_affixes, distance, generalized_distance, prefix_distance
from termweave.functions.phonetic import INTENDED, ORTHOGRAPHY, PHONETIC, orthography, rewrite
from termweave.functions.policy import PHONETIC_ENGLISH_BASIC, STANDARD_OPERATIONS, WITH_MERGE_SPLIT, Substitutions, operation


def textbook(a, b, algorithm):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            best = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if algorithm == "transposition" and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, d[i - 2][j - 2] + 1)
            if algorithm == "merge_and_split":
                best = min([best] + [d[i - 2][j - 1] + 1] * (i > 1) + [d[i - 1][j - 2] + 1] * (j > 1))
            d[i][j] = best
    return d[-1][-1]


TRUTH = [("kitten", "sitting", 3, 3, 3), ("test", "tset", 2, 1, 2), ("tset", "tester", 3, 3, 3), ("ab", "ba", 2, 1, 2), ("ca", "abc", 3, 3, 2), ("m", "rn", 2, 2, 1), ("rn", "m", 2, 2, 1), ("", "abc", 3, 3, 3), ("café", "cafe", 1, 1, 1), ("aahaara", "hr", 5, 5, 5)]


@pytest.mark.parametrize("k, algorithm", list(enumerate(ALGORITHMS)))
def test_truth(spark, k, algorithm):
    df = spark.createDataFrame([t[:2] for t in TRUTH], "a string, b string")
    assert [r[0] for r in df.select(distance(F.col("a"), F.col("b"), algorithm)).collect()] == [t[2 + k] for t in TRUTH]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=7), st.text("abcé", max_size=7)), max_size=20))
def test_batches_equal_dp(pairs):
    for algorithm in ALGORITHMS:
        assert batch_distance([p[0] for p in pairs], [p[1] for p in pairs], algorithm).tolist() == [textbook(*p, algorithm) for p in pairs]


def test_axioms():
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(7))) for _ in range(60)]
    for algorithm in ALGORITHMS:
        d = {(a, b): textbook(a, b, algorithm) for a in words for b in words}
        assert all(d[a, b] == d[b, a] and (d[a, b] == 0) == (a == b) and d[a, b] <= textbook(a, b, "standard") <= 2 * d[a, b] for a, b in d)


def test_bytes_nulls_prefix_affixes(spark):
    df = spark.createDataFrame([("café", "cafe"), (None, "x"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(distance(byte_view(F.col("a")), byte_view(F.col("b")))).collect()] == [2, None, 0]
    assert [r[0] for r in df.select(distance(F.col("a"), F.col("b"), "transposition")).collect()] == [1, None, 0]
    words = spark.createDataFrame([(w,) for w in ("test", "tester", "testing", "best", "tes", "te")], "t string")
    got = {r.t: r.d for r in words.select("t", prefix_distance(F.lit("test"), F.col("t"), 1).alias("d")).collect()}
    assert got == {"test": 0, "tester": 0, "testing": 0, "best": 1, "tes": 1, "te": None}
    x = spark.createDataFrame([("abcxef", "abcyyef"), ("aa", "aaa"), ("", "a")], "a string, b string").select(common_affixes(F.col("a"), F.col("b")).alias("x")).collect()
    assert [tuple(r.x) for r in x] == [(3, 2), (2, 0), (0, 0)]


def test_generalized(spark):
    rows = [("phone", "fone"), ("knight", "night"), ("ab", "ba"), ("m", "rn"), ("butter", "buter")]
    df = spark.createDataFrame(rows, "a string, b string")
    run = lambda ops, **k: [r[0] for r in df.select(generalized_distance(ops, **k)(F.col("a"), F.col("b"))).collect()]
    assert run(STANDARD_OPERATIONS) == [float(textbook(*r, "standard")) for r in rows]
    assert run(WITH_MERGE_SPLIT) == [float(textbook(*r, "merge_and_split")) for r in rows]
    assert [round(x, 2) for x in run(PHONETIC_ENGLISH_BASIC)] == [0.15, 0.2, 2.0, 2.0, 0.1]
    assert run(PHONETIC_ENGLISH_BASIC, floor_weights=True)[:2] == [0.0, 0.0]
    with pytest.raises(ValueError):
        operation("bad", 1, 0, 0.0)


def test_phonetic(spark):
    words = ["phone", "church", "enough", "city", "gem", "shcchgh", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(orthography(F.col("w"))).collect()] == [rewrite(w, ORTHOGRAPHY) for w in words]
    assert [rewrite(w) for w in words[:5]] == ["fone", "çurç", "enou", "kity", "gem"]
    assert rewrite("city", INTENDED) == "sity" and rewrite("gem", INTENDED) == "jem" and rewrite("cake", INTENDED) == "kak"
    assert rewrite("kw", PHONETIC) == "qu"
    r = random.Random(2)
    many = ["".join(r.choice("cghspeai") for _ in range(8)) for _ in range(300)]
    assert [x[0] for x in spark.createDataFrame([(w,) for w in many], "w string").select(orthography(F.col("w"))).collect()] == [rewrite(w) for w in many]


def test_substitutions():
    s = Substitutions().allow("ph", "f").allow("a", "e")
    assert s.contains("a", "e") and not s.contains("e", "a") and s.has_source("ph") and s.has_target_starting_with("ph", "f") and len(s) == 2
