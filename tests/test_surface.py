"""Engine, command line, SQL surface, documents, formats by content, large distances, generators."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from termweave import cli
from termweave.functions.distance import generalized_distance
from termweave.functions.phonetic import ORTHOGRAPHY, orthography, rewrite
from termweave.functions.policy import CYRILLIC_CASE_INSENSITIVE, DIACRITICS_LATIN, GREEK_CASE_INSENSITIVE, JAPANESE_HIRAGANA_KATAKANA, OCR_FRIENDLY, PHONETIC_ENGLISH_BASIC, WITH_MERGE_SPLIT, WITH_TRANSPOSITION
from termweave.functions.udtf import register
from termweave.operators import cache, context, dictionary, join, search, substring
from termweave.operators.join import similarity_join
from termweave.plans import shared
from termweave.sources import corpus, terms

from .test_distance import textbook


def table(spark, words, name="term"):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def random_words(seed, many, letters="abc", longest=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randrange(longest))) for _ in range(many)})


@pytest.mark.parametrize("algorithm", ["standard", "transposition", "merge_and_split"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_segments_miss_no_pair(spark, algorithm, n):
    words = random_words(n, 90)
    got = {tuple(r) for r in similarity_join(table(spark, words[::2], "query"), table(spark, words), n, algorithm, plan="segments").collect()}
    want = {(q, t, d) for q in words[::2] for t in words if (d := textbook(q, t, algorithm)) <= n}
    assert got == want


@pytest.mark.parametrize("algorithm", ["standard", "transposition", "merge_and_split"])
@pytest.mark.parametrize("n", [0, 1, 2])
def test_restricted_search_is_the_table(spark, algorithm, n):
    pairs = {("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("c", "a")}
    words = random_words(10 + n, 60, "abcd", 8)

    def one(t, q):
        cells = {(0, 0): 0}
        at = lambda i, j: cells.get((i, j), 99)
        for i in range(len(t) + 1):
            for j in range(len(q) + 1):
                best = [at(i, j), at(i - 1, j) + 1, at(i, j - 1) + 1]
                if i and j:
                    best.append(at(i - 1, j - 1) + (t[i - 1] != q[j - 1] and (t[i - 1], q[j - 1]) not in pairs))
                if algorithm == "transposition" and i > 1 and j > 1 and t[i - 2 : i] == q[j - 2 : j][::-1]:
                    best.append(at(i - 2, j - 2) + 1)
                if algorithm == "merge_and_split":
                    best += [at(i - 2, j - 1) + 1, at(i - 1, j - 2) + 1]
                cells[i, j] = min(best)
        return cells[len(t), len(q)]

    got = {tuple(r) for r in search.restricted_join(table(spark, words[::3], "query"), table(spark, words), n, pairs, algorithm).collect()}
    assert got == {(q, t, d) for q in words[::3] for t in words if (d := one(t, q)) <= n}


def test_large_distances_and_blocks(spark, monkeypatch):
    words = random_words(9, 40)
    want = {(q, t, textbook(q, t, "standard")) for q in words for t in words}
    assert {tuple(r) for r in similarity_join(table(spark, words, "query"), table(spark, words), 99).collect()} == want
    monkeypatch.setattr(join, "NESTED_MOST", 10)
    assert {tuple(r) for r in similarity_join(table(spark, words, "query"), table(spark, words), 99).collect()} == want
    with pytest.raises(ValueError):
        search.FuzzyIndex(table(spark, words), "no such algorithm")


def test_weighted_operations_are_the_table(spark):
    def one(ops, x, y):
        cells = {(0, 0): 0.0}
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                for o in ops:
                    cx, cy = o["consume_x"], o["consume_y"]
                    if cx > i or cy > j or (i - cx, j - cy) not in cells:
                        continue
                    s, t = x[i - cx : i], y[j - cy : j]
                    fits = (s, t) in o["pairs"] if o["pairs"] is not None else s == t if not o["weight"] else s == t[::-1] if cx == cy == 2 else True
                    if fits:
                        cells[i, j] = min(cells.get((i, j), 1e9), cells[i - cx, j - cy] + o["weight"])
        return cells[len(x), len(y)]

    words = ["phone", "fone", "knight", "night", "", "quick", "kwik", "school", "skool", "ba", "ab", "rn", "m"]
    pairs = spark.createDataFrame([(x, y) for x in words for y in words] + [(None, "x")], "x string, y string")
    for ops in (PHONETIC_ENGLISH_BASIC, WITH_TRANSPOSITION, WITH_MERGE_SPLIT):
        for r in pairs.withColumn("d", generalized_distance(ops)(F.col("x"), F.col("y"))).collect():
            assert r.d is None if r.x is None else abs(r.d - one(ops, r.x, r.y)) < 1e-9


def test_orthography_equals_rewriting(spark):
    words = random_words(3, 600, "ghspctie", 8)
    got = {r.term: r.s for r in table(spark, words).select("term", orthography(F.col("term")).alias("s")).collect()}
    assert got == {w: rewrite(w, ORTHOGRAPHY) for w in words}


def test_presets(spark):
    hit = lambda q, t, pairs: search.restricted_join(table(spark, [q], "query"), table(spark, [t]), 0, pairs).count()
    assert hit("cafe", "café", DIACRITICS_LATIN) and hit("ΑΒΓ", "αβγ", GREEK_CASE_INSENSITIVE) and hit("МИР", "мир", CYRILLIC_CASE_INSENSITIVE)
    assert hit("カキ", "かき", JAPANESE_HIRAGANA_KATAKANA) and hit("1O", "I0", OCR_FRIENDLY) and not hit("x", "y", OCR_FRIENDLY)


def test_substrings_of_documents(spark, monkeypatch):
    r = random.Random(2)
    docs = [(k, "".join(r.choice("abc") for _ in range(r.randrange(60)))) for k in range(20)] + [(50, None), (51, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    needles = random_words(5, 30, "abc", 5)
    find = lambda text, w: [a for a in range(len(text or "") - len(w) + 1) if text.startswith(w, a)] if w and text else []
    want = {(i, w, a, a + len(w)) for i, t in docs for w in needles for a in find(t, w)}
    near = {(q, i, a, t[a : a + n], d) for i, t in docs if t for q in needles[:8] for n in range(1, len(q) + 2) for a in range(len(t) - n + 1) if (d := textbook(q, t[a : a + n], "standard")) <= 1}
    for most in (substring.SENT_MOST, 30):  # all needles at once, and in blocks
        monkeypatch.setattr(substring, "SENT_MOST", most)
        assert {tuple(r) for r in substring.occurrences(df, table(spark, needles, "needle")).collect()} == want
        assert {tuple(r) for r in substring.fuzzy_occurrences(df, table(spark, needles[:8], "query"), 1).collect()} == near
    there = {r.needle: r.found for r in substring.contains_substring(df, table(spark, [*needles, "zz"], "needle")).collect()}
    assert there == {w: not w or any(x[1] == w for x in want) for w in [*needles, "zz"]}
    open_ = substring.fuzzy_occurrences_open(spark.createDataFrame([(1, "xaby")], "doc_id long, text string"), table(spark, ["abz"], "query"), 1)
    assert ("ab", 0) in {(r.term, r.distance) for r in open_.collect()}
    more = substring.insert_documents(df, spark.createDataFrame([(0, "other"), (99, "new"), (99, "new")], "doc_id long, text string"))
    assert {r.doc_id for r in more.collect()} == {*range(20), 50, 51, 99} and more.where("text = 'other'").count() == 0
    assert substring.remove_documents(more, spark.createDataFrame([(99,)], "doc_id long")).where("doc_id = 99").count() == 0 and substring.clear(df).count() == 0
    assert {r.doc_id for r in substring.source_texts(spark.createDataFrame([(1,), (1,)], "doc_id long"), df).collect()} == {1}


def test_engine_and_rejections(spark):
    scopes = spark.createDataFrame([(1, None), (2, 1), (3, 1)], "context_id long, parent_id long")
    log = [(2, 1, "insert", "hello"), (2, 2, "finalize", None), (2, 3, "undo", None), (3, 4, "insert", "help"), (3, 5, "finalize_direct", ""), (2, 6, "finalize", None), (9, 7, "insert", "x"), (3, 8, "fly", None), (1, 9, "finalize_direct", "hell")]
    engine = context.CompletionEngine(scopes).apply(spark.createDataFrame(log, "context_id long, seq long, op string, arg string"))
    assert {(r.context_id, r.seq, r.error) for r in engine.rejected().collect()} == {(2, 3, "NoCheckpoints"), (3, 5, "EmptyTerm"), (2, 6, "EmptyDraft"), (9, 7, "ContextNotFound"), (3, 8, "UnknownOperation")}
    assert {tuple(r) for r in engine.drafts().collect()} == {(3, "help")}
    assert {(r.term, tuple(r.contexts)) for r in engine.terms().collect()} == {("hello", (2,)), ("hell", (1,))}
    assert {tuple(r) for r in engine.has_term(table(spark, ["hello", "help"])).collect()} == {("hello", True), ("help", False)}
    seen = lambda c: {(r.term, r.is_draft) for r in engine.complete(spark.createDataFrame([(c, "hell")], "context_id long, query string"), 1).collect()}
    assert seen(2) == {("hell", False), ("hello", False)} and seen(3) == {("hell", False), ("help", True)}
    assert {r.context_id for r in engine.without_scope(1).scopes.collect()} == set()
    with pytest.raises(ValueError):
        engine.with_scopes(spark.createDataFrame([(5, 77)], "context_id long, parent_id long"))
    assert engine.with_scopes(spark.createDataFrame([(5, 3)], "context_id long, parent_id long")).scopes.count() == 4
    assert {tuple(r) for r in context.depth(scopes).collect()} == {(1, 0), (2, 1), (3, 1)}
    below = context.is_descendant(scopes, spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "context_id long, ancestor_id long"))
    assert [r.is_descendant for r in below.orderBy("context_id", "ancestor_id").collect()] == [False, False, True]


def test_static_order_ranks_drafts_like_terms(spark):
    scopes = spark.createDataFrame([(1, None)], "context_id long, parent_id long")
    done = spark.createDataFrame([("abd", [1])], "term string, contexts array<long>")
    drafts = spark.createDataFrame([(1, "abc")], "context_id long, term string")
    asked = spark.createDataFrame([(1, "ab")], "context_id long, query string")
    order = lambda by: [r.term for r in context.complete(asked, scopes, done, drafts, 1, by_draft=by).orderBy("rank").collect()]
    assert order(True) == ["abd", "abc"] and order(False) == ["abc", "abd"]


def test_dictionary_predicates(spark):
    words = spark.createDataFrame([("a", [1, 2]), ("b", [2]), ("c", [])], "term string, value array<int>")
    names = lambda df: {r.term for r in df.collect()}
    assert names(dictionary.any_value(words, lambda x: x == 2)) == {"a", "b"} and names(dictionary.every_value(words, lambda x: x == 2)) == {"b", "c"}
    values = spark.createDataFrame([("ab", 1), ("ac", 20)], "term string, value long")
    found = dictionary.contains_with_value(table(spark, ["ab", "ac", "x"], "query"), values, F.col("value") > 5)
    assert {tuple(r) for r in found.collect()} == {("ab", False), ("ac", True), ("x", False)}
    assert {tuple(r) for r in search.starts_with_values(table(spark, ["a"], "query"), values).collect()} == {("a", "ab", 1), ("a", "ac", 20)}
    assert names(dictionary.subtract(values, table(spark, ["ab"]))) == {"ac"} and dictionary.clear(values).count() == 0
    stats = cache.cache_stats(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "term string, ts int")).first()
    assert tuple(stats) == (3, 2, 3)
    built = search.FuzzyIndex(values, value_col="value").builder(table(spark, ["ab"], "query")).max_distance(1).filter(F.col("value") > 5).plan("nested").limit(1)
    assert built.collect() == [("ab", "ac", 1)]


def test_formats_by_content_and_lines(spark, tmp_path):
    words = ["pear", "fig", "naïve"]
    for fmt, compression in (("text", None), ("text", "gzip"), ("json", None), ("csv", None), ("parquet", None)):
        path = str(tmp_path / f"plain{fmt}{compression}")
        terms.write_terms(table(spark, words).coalesce(1), path, fmt, compression)
        assert terms.detect_content(spark, path) == fmt
        assert sorted(r.term for r in terms.read_terms(spark, path).collect()) == sorted(words)
    terms.convert(spark, str(tmp_path / "plaincsvNone"), str(tmp_path / "other"), target_format="json")
    assert sorted(r.term for r in terms.read_terms(spark, str(tmp_path / "other")).collect()) == sorted(words)
    (tmp_path / "tokens.txt.gz").write_bytes(gzip.compress("The\n the \n\ncat\n".encode()))
    assert {tuple(r) for r in corpus.read_token_lines(spark, str(tmp_path / "tokens.txt.gz")).collect()} == {("the", 2), ("cat", 1)}
    assert {tuple(r) for r in corpus.word_frequencies(spark.createDataFrame([("Naïve naïve ÜBER x9",)], "text string")).collect()} == {("naïve", 2), ("über", 1), ("x", 1)}


def test_generators_are_even_and_repeatable(spark):
    words = table(spark, ["a", "b", "c", "d"])
    even = corpus.uniform_workload(words, 400, 3)
    assert even.count() == 400 and all(r["count"] > 60 for r in even.groupBy("term").count().collect())
    assert sorted(map(tuple, even.collect())) == sorted(map(tuple, corpus.uniform_workload(words.repartition(3), 400, 3).collect()))
    assert corpus.query_list(words, 2, 1).count() == 2 and corpus.workload(words.limit(0).withColumn("freq", F.lit(1)), 5).count() == 0


def test_command_line_and_sql(spark, tmp_path):
    path = str(tmp_path / "words.txt")
    (tmp_path / "words.txt").write_text("kitten\nmitten\nsitting\n")
    lines = [f"query {path} kitten -n 1", f"query {path} kit --prefix -n 0 --limit 1", f"info {path}", f"insert {path} {tmp_path}/more.json bitten", f"query {tmp_path}/more.json kitten -n 1", f"delete {path} {tmp_path}/less mitten", f"convert {path} {tmp_path}/p.parquet", f"minimize {path}", f"clear {path}", "nonsense", "settings", "exit", f"info {path}"]
    got = cli.repl(spark, lines)
    assert got[:3] == ["kitten\t0", "mitten\t1", "kitten\t0"] and "terms\t3" in got and got.count("mitten\t1") == 2 and "bitten\t1" in got
    assert sum(x.startswith("error") for x in got) == 1
    for where, many in (("less", 2), ("p.parquet", 3), ("words.txt.parquet", 3)):
        assert terms.read_terms(spark, str(tmp_path / where)).count() == many
    register(spark)
    table(spark, ["ab", "ba", "xyz", None]).createOrReplaceTempView("words")
    assert {tuple(r) for r in spark.sql("SELECT * FROM fuzzy_search(TABLE(words), 'ab', 2)").collect()} == {("ab", 0), ("ba", 2)}
    assert tuple(spark.sql("SELECT osa_distance('ab', 'ba'), merge_split_distance('rn', 'm')").first()) == (1, 1)


def test_no_temporary_folder_on_a_cluster(spark):
    class Other:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        conf = {}

    with pytest.raises(RuntimeError):
        shared.shared_dir(Other())
