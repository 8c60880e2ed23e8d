import random

import pytest

EXTRA = "id string, i int, t string, fp long, node long, key string, size long, src string, h long, v int, row long, w string, n int, u string, score double, label int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, a null id, and columns whose names clash with inner ones."""
    r = random.Random(3)
    words = ["the", "of", "Über", "naïve", "cat", "dog.", "[INST]", "x,y", "...", "\\", "中文", "éa", "a b"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(n))
    texts = [None, "", " \n\t ", "one", "two words", "line\n\nbreaks  and\ttabs \r\n", text(30), text(200), text(6000), "same text again and again", "same text again and again", "x" * 5000, "<|endoftext|> it's 12,3", "\x85odd\x1cmarks here\x00"]
    rows = [(k, t, "en" if k % 2 else None, [None, "a", "b", "Ä"][k % 4], None) for k, t in enumerate(texts)]
    rows += [rows[9], rows[7], (None, "null id", "en", "a", 7), (3, "another text of the same id", "en", "a", 1)]
    extra = ("x", 1, "y", 2, 3, "k", 4, "s", 5, 6, 7, "w", 8, "u", 9.0, 1)
    return spark.createDataFrame([x + extra for x in rows], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def rows_of(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
