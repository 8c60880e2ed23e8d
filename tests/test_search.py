import random

import pytest
from pyspark.sql import functions as F

from termweave.operators import cache, context, dictionary, search, substring
from termweave.operators.join import similarity_join
from termweave.sources import corpus, terms
from tests.test_distance import textbook

WORDS = "a ab abc abcd abcde b bc bcd bcde test testing tested tester tests best rest nest west quest foo food fool football bar bark barn barley".split()


def table(spark, words, name="term"):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


@pytest.mark.parametrize("algorithm", ["standard", "transposition", "merge_and_split"])
def test_join_is_exact(spark, algorithm):
    r = random.Random(algorithm)
    word = lambda most: "".join(r.choice("abé") for _ in range(r.randrange(most)))
    have, ask = {word(10) for _ in range(150)} | {""}, {word(10) for _ in range(40)} | {""}
    for n in (0, 1, 2, 3):
        got = {tuple(x) for x in similarity_join(table(spark, ask, "query"), table(spark, [*have, *have]), n, algorithm).collect()}
        assert got == {(q, t, d) for q in ask for t in have if (d := textbook(q, t, algorithm)) <= n}


def test_regressions(spark):
    for words, q, n, expected in (
        (["z", "za"], "za", 1, {"za": 0, "z": 1}),
        (["test", "testing"], "testing", 3, {"testing": 0, "test": 3}),
        (["foo", "bar", "baz", "qux", "quo", "abcdefghijklmnopqrstuvwxyz"], "x", 30, {"foo": 3, "bar": 3, "baz": 3, "qux": 2, "quo": 3, "abcdefghijklmnopqrstuvwxyz": 25}),
    ):
        plan = "segments" if n < 5 else "nested"
        got = {r.term: r.distance for r in similarity_join(table(spark, [q], "query"), table(spark, words), n, plan=plan).collect()}
        assert got == expected
    for words, q, n in ((["ccbc"], "bc", 2), (["cbabc"], "ab", 3)):
        assert similarity_join(table(spark, [q], "query"), table(spark, words), n, "transposition").count() == 1
    assert similarity_join(table(spark, [""], "query"), table(spark, ["¡"]), 1).count() == 1
    assert similarity_join(table(spark, [""], "query"), table(spark, ["¡"]), 1, unit="byte").count() == 0
    assert similarity_join(table(spark, [""], "query"), table(spark, ["¡"]), 2, unit="byte").count() == 1
    with pytest.raises(ValueError):
        similarity_join(table(spark, [""], "query"), table(spark, [""]), 1, "other")


def test_index_and_builder(spark):
    valued = table(spark, WORDS).withColumn("value", F.when(F.length("term") > 3, F.length("term")))
    index = search.FuzzyIndex(valued, value_col="value")
    ask = table(spark, ["tset", "bar"], "query")
    assert index.builder(ask).max_distance(1).ordered().limit(2).collect() == [("bar", "bar", 0), ("bar", "bark", 1)]
    assert index.builder(ask).algorithm("transposition").max_distance(1).ordered().collect()[-1] == ("tset", "test", 1)
    kept = {r.term for r in index.query_filtered(table(spark, ["bar"], "query"), 2, F.col("value") == 4).collect()}
    assert kept == {w for w in WORDS if textbook("bar", w, "standard") <= 2 and len(w) <= 4}
    some = {r.term for r in index.query_by_value_set(table(spark, ["test"], "query"), 1, spark.createDataFrame([(5,)], "v int")).collect()}
    assert some == {"tests"}
    got = {(r.term, r.distance) for r in index.query_prefix(table(spark, ["test"], "query"), 1).collect()}
    best = lambda w: min(textbook("test", w[:k], "standard") for k in range(len(w) + 1))
    assert got == {(w, best(w)) for w in WORDS if best(w) <= 1}
    assert {r.term for r in search.starts_with(table(spark, ["bar"], "query"), valued).collect()} == {"bar", "bark", "barn", "barley"}


def test_prefix_join_is_exact_and_shuffles_no_prefixes(spark, monkeypatch):
    r = random.Random(5)
    word = lambda most: "".join(r.choice("abé") for _ in range(r.randrange(most)))
    have, ask = {word(9) for _ in range(80)} | {""}, {word(7) for _ in range(30)} | {""}
    least = {(q, t): min(textbook(q, t[:k], "standard") for k in range(len(t) + 1)) for q in ask for t in have}
    for n, most in ((1, 100_000), (1, 40), (2, 100_000), (5, 100_000)):  # 40 keys: several blocks
        monkeypatch.setattr(search, "PREFIX_KEYS_MOST", most)
        got = search.prefix_join(table(spark, ask, "query"), table(spark, [*have, *have]), n)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(prefix" not in plan and "SortMergeJoin" not in plan
        assert sorted(map(tuple, got.collect())) == sorted((q, t, d) for (q, t), d in least.items() if d <= n)


def test_join_of_numbered_names(spark, monkeypatch):
    """A segment that all names share is no key: deletions are."""
    from termweave.operators import join

    monkeypatch.setattr(join, "CROWD", 20)
    names = [f"Name#{k:05d}" for k in (*range(60), 100, 1000, 10000, 10001)] + ["Name#1", "Nam#00012", "bark"]
    for algorithm in ("standard", "transposition"):
        df = similarity_join(table(spark, names, "query"), table(spark, names), 1, algorithm)
        assert "termweave-crowded" in " ".join(df.inputFiles())
        assert sorted(map(tuple, df.collect())) == sorted((q, t, d) for q in names for t in names if (d := textbook(q, t, algorithm)) <= 1)


def test_restricted(spark):
    got = search.restricted_join(table(spark, ["t3st", "xest"], "query"), table(spark, ["test", "best"]), 0, [("e", "3")]).collect()
    assert [tuple(r) for r in got] == [("t3st", "test", 0)]
    one = {tuple(r) for r in search.restricted_join(table(spark, ["b3st"], "query"), table(spark, ["test", "best"]), 1, [("e", "3")]).collect()}
    assert one == {("b3st", "test", 1), ("b3st", "best", 0)}


def test_dictionary(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2), ("n", None)], "term string, value int"), spark.createDataFrame([("b", 5), ("c", 7)], "term string, value int")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(dictionary.union_with(left, right, lambda x, y: x + y)) == [("a", 1), ("b", 7), ("c", 7), ("n", None)]
    assert rows(dictionary.union_replace(left, right)) == [("a", 1), ("b", 5), ("c", 7), ("n", None)]
    assert rows(dictionary.remove(left, right)) == [("a", 1), ("n", None)]
    assert rows(dictionary.contains(table(spark, ["a", "x"], "query"), left)) == [("a", True), ("x", False)]
    last = dictionary.from_terms_with_values(spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "t string, v int, s int"), "t", "v", "s")
    assert rows(last) == [("a", 2)]
    assert dictionary.stats(table(spark, ["ab", "abc", "b"])).first().nodes == 5
    assert rows(dictionary.children(table(spark, WORDS), "bar")) == [("k",), ("l",), ("n",)]
    sets = spark.createDataFrame([("foo", [1, 2]), ("bar", [3]), ("baz", [4, 5])], "term string, value array<int>")
    near = similarity_join(table(spark, ["bat", "zzzzzz"], "query"), sets, 1)
    assert rows(dictionary.multimap(near, sets)) == [("bat", [3, 4, 5])]
    assert rows(dictionary.multimap(near, sets, "concat")) == [("bat", [3, 4, 5])]


def test_substrings(spark):
    docs = spark.createDataFrame([(1, "first document with test content"), (2, "tttt"), (3, None)], "doc_id int, text string")
    got = {tuple(r) for r in substring.occurrences(docs, table(spark, ["test", "tt"], "needle")).collect()}
    assert got == {(1, "test", 20, 24), (2, "tt", 0, 2), (2, "tt", 1, 3), (2, "tt", 2, 4)}
    near = {(r.start, r.term, r.distance) for r in substring.fuzzy_occurrences(docs.where("doc_id = 1"), table(spark, ["tesst"], "query"), 1).collect()}
    assert near == {(20, "test", 1)}


def test_fuzzy_occurrences_try_few_substrings(spark):
    r = random.Random(3)
    word = lambda most: "".join(r.choice("abé") for _ in range(r.randrange(1, most)))
    texts, ask = [word(26) for _ in range(12)], {word(9) for _ in range(12)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for n in (0, 1, 2, 3):
        got = sorted(map(tuple, substring.fuzzy_occurrences(docs, table(spark, ask, "query"), n).collect()))
        spans = [(k, a, x[a:e]) for k, x in enumerate(texts) for a in range(len(x)) for e in range(a + 1, len(x) + 1)]
        near = {(q, t): textbook(q, t, "standard") for q in ask for t in {t for *_, t in spans} if abs(len(q) - len(t)) <= n}
        assert got == sorted((q, k, a, t, near[q, t]) for q in ask for k, a, t in spans if near.get((q, t), n + 1) <= n)
    one = spark.createDataFrame([(1, "hippopotamus hippodromes xxhippo")], "doc_id int, text string")
    tried = substring._windows(one.select("doc_id", F.col("text").alias("x")), "int", ["hippopotami"], 1)
    assert sorted(r.term for r in tried.collect()) == ["hippopotam", "hippopotamu", "hippopotamus"]


def test_scopes_and_drafts(spark):
    scopes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 1)], "context_id long, parent_id long")
    seen = {(r.context_id, r.visible_id): r.depth for r in context.visible_scopes(scopes).collect()}
    assert seen[5, 1] == 4 and seen[5, 5] == 0 and (6, 2) not in seen and len(seen) == 17
    assert sorted(r.context_id for r in context.remove_scope(scopes, 3).collect()) == [1, 2, 6]
    done = spark.createDataFrame([("helper", [1]), ("hidden", [6])], "term string, contexts array<long>")
    drafts = spark.createDataFrame([(5, "helped"), (3, "helper")], "context_id long, term string")
    got = context.complete(spark.createDataFrame([(5, "helper")], "context_id long, query string"), scopes, done, drafts, 2).orderBy("rank").collect()
    assert [(r.term, r.distance, r.is_draft, r.contexts) for r in got] == [("helper", 0, True, [3]), ("helped", 1, True, [5])]
    log = [("checkpoint", None), ("insert", "hello"), ("checkpoint", None), ("insert", " world"), ("undo", None), ("insert", "!"), ("undo", None), ("undo", None), ("insert", "abc"), ("delete", None), ("finalize", None), ("finalize", None)]
    folded = context.fold_drafts(spark.createDataFrame([(1, k, op, arg) for k, (op, arg) in enumerate(log)], "context_id long, seq int, op string, arg string")).first()
    assert (folded.draft, folded.checkpoints, folded.finalized, folded.errors) == ("", 0, ["ab"], 2)


def test_cache(spark):
    log = spark.createDataFrame([("foo", "2024-01-01 00:00:00", 8), ("bar", "2024-01-01 00:01:00", 8), ("baz", "2024-01-01 00:02:00", 80), ("bar", "2024-01-01 00:03:00", 8)], "term string, ts string, size_bytes long").withColumn("ts", F.to_timestamp("ts"))
    meta = cache.metadata(log)
    first = lambda p: cache.victims(meta, p).first().term
    assert [first(p) for p in ("lru", "lfu", "age", "cost", "pressure")] == ["foo", "baz", "foo", "baz", "baz"]
    assert {r.term for r in cache.visible_within(log.select("term").distinct(), meta, 130).collect()} == {"bar", "baz"}
    assert cache.evict(log, cache.victims(meta, "lru")).where("term = 'foo'").count() == 0


def test_corpus_and_files(spark, tmp_path):
    typos = [r.typo for r in corpus.distance_one(table(spark, ["ab"])).collect()]
    assert len(typos) == 2 + 3 * 26 + 2 * 25 + 1 and "ba" in typos and all(textbook("ab", t, "transposition") <= 1 for t in typos)
    (tmp_path / "m.txt").write_text("$After\nArtair 1\nAfer\n$Big\nbg 12\n")
    got = {tuple(r) for r in corpus.read_misspellings(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {("After", "Artair", 1), ("After", "Afer", 1), ("Big", "bg", 12)}
    assert tuple(corpus.misspelling_stats(corpus.read_misspellings(spark, str(tmp_path / "m.txt"))).first()) == (2, 14, 3)
    draws = corpus.workload(spark.createDataFrame([("a", 1), ("b", 99)], "term string, freq long"), 200, 3).groupBy("term").count().collect()
    assert sum(r["count"] for r in draws) == 200
    for fmt, compression in (("text", None), ("text", "gzip"), ("json", None), ("csv", None), ("parquet", None)):
        path = str(tmp_path / f"{fmt}{compression}")
        terms.write_terms(table(spark, WORDS), path, fmt, compression)
        assert sorted(r.term for r in terms.read_terms(spark, path, fmt).collect()) == sorted(WORDS)
    assert [terms.detect_format(p) for p in ("a.json.gz", "b.csv", "c.parquet/", "d.txt", "e")] == ["json", "csv", "parquet", "text", "text"]


def test_draft_stream_equals_batch(spark, tmp_path):
    from termweave.streaming.drafts import draft_stream

    r = random.Random(4)
    rows = [(k % 3, k, r.choice(context.OPS), r.choice("abc"), f"2024-01-01 00:00:{k % 60:02d}") for k in range(120)]
    log = spark.createDataFrame(rows, "context_id long, seq long, op string, arg string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    for part in range(2):
        log.where((F.col("seq") >= 60 * part) & (F.col("seq") < 60 * part + 60)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = draft_stream(stream).writeStream.format("memory").queryName("drafts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    seen = spark.table("drafts").where("term is not null").groupBy("context_id").agg(F.array_sort(F.collect_set("term")).alias("f")).collect()
    batch = {x.context_id: x.finalized for x in context.fold_drafts(log).collect() if x.finalized}
    assert {x.context_id: x.f for x in seen} == batch


def test_join_plans_have_no_product(spark):
    for algorithm in ("standard", "transposition"):
        df = similarity_join(table(spark, WORDS, "query"), table(spark, WORDS), 2, algorithm)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
