"""Registered queries of the library's own operators, with DuckDB SQL for the same rows where SQL has an equivalent.

The dictionary is the vocabulary of all documents (runs of letters, lower-cased), its values the frequencies; the looked-up words are all
words of the benchmark table. Every query reads its whole tables. A session builds the dictionary of a folder once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.functions.distance import MERGE_AND_SPLIT, TRANSPOSITION, byte_view, common_affixes, distance, generalized_distance
from termweave.functions.phonetic import ZOMPIST, normalize, orthography
from termweave.functions.policy import DIACRITICS_LATIN, KEYBOARD_QWERTY, LEET_SPEAK, PHONETIC_ENGLISH_BASIC, WITH_MERGE_SPLIT, WITH_TRANSPOSITION
from termweave.functions.udtf import register
from termweave.operators import cache, context, dictionary, search, substring
from termweave.operators.join import similarity_join
from termweave.plans.shared import cut, fresh_path, ship
from termweave.sources import corpus
from termweave.sources import terms as files
from termweave.streaming.drafts import access_counts as stream_counts


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_built: dict[tuple[str, str], DataFrame] = {}


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """(term, value): the dictionary, written once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        _built[key] = cut(corpus.word_frequencies(table(spark, d, "documents")).withColumnRenamed("freq", "value"), "vocabulary")
    return _built[key]


def asked(spark: SparkSession, d: str) -> DataFrame:
    return corpus.word_frequencies(table(spark, d, "benchmark")).select(F.col("term").alias("query"))


def _matches(n: int, algorithm: str = "standard"):
    return lambda spark, d: similarity_join(asked(spark, d), vocabulary(spark, d), n, algorithm)


def word_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): neighbouring words of a benchmark text, of any script."""
    words = table(spark, d, "benchmark").select(F.split("text", " ").alias("w"))
    return words.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p")).select("p.a", "p.b").where("b IS NOT NULL").distinct()


def fuzzy_topk(spark, d):
    return search.top_k(_matches(2)(spark, d), 3).withColumn("rank", F.col("rank").cast("long"))


def fuzzy_prefix(spark, d):
    return search.prefix_join(asked(spark, d).where(F.length("query") >= 1), vocabulary(spark, d), 1)


def exact_prefix(spark, d):
    return search.starts_with(asked(spark, d), vocabulary(spark, d))


def contains_batch(spark, d):
    return dictionary.contains(asked(spark, d), vocabulary(spark, d))


def get_value_batch(spark, d):
    return dictionary.get_value(asked(spark, d), vocabulary(spark, d))


def fuzzy_value_filtered(spark, d):
    return search.FuzzyIndex(vocabulary(spark, d), value_col="value").query_filtered(asked(spark, d), 2, F.col("value") >= 10)


def fuzzy_value_set(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_size").cast("long").alias("v")).distinct()
    return search.FuzzyIndex(vocabulary(spark, d), value_col="value").query_by_value_set(asked(spark, d), 1, sizes)


def _by_language(spark, d) -> DataFrame:
    """(term, value): the languages of the documents that a term is in."""
    words = table(spark, d, "documents").select("lang", F.explode(corpus.words(F.col("text"))).alias("term"))
    return cut(words.groupBy("term").agg(F.array_sort(F.collect_set("lang")).alias("value")), "languages")


def fuzzy_multimap_union(spark, d):
    terms = _by_language(spark, d)
    return dictionary.multimap(similarity_join(asked(spark, d), terms, 1), terms)


def fuzzy_multimap_concat(spark, d):
    terms = _by_language(spark, d)
    return dictionary.multimap(similarity_join(asked(spark, d), terms, 1), terms, "concat")


def bench_self_join(spark, d):
    words = asked(spark, d)
    return similarity_join(words, words.withColumnRenamed("query", "term"), 2).where("query < term")


def _talk(spark, d) -> DataFrame:
    return corpus.word_frequencies(table(spark, d, "conversations")).withColumnRenamed("freq", "value")


def dict_union_merge(spark, d):
    return dictionary.union_with(vocabulary(spark, d), _talk(spark, d), lambda a, b: a + b)


def dict_union_replace(spark, d):
    return dictionary.union_replace(vocabulary(spark, d), _talk(spark, d))


def dict_remove(spark, d):
    return dictionary.remove(vocabulary(spark, d), _talk(spark, d))


def dict_insert_new(spark, d):
    return dictionary.newly_inserted(vocabulary(spark, d), _talk(spark, d))


def dict_intersect(spark, d):
    return dictionary.intersect(vocabulary(spark, d), _talk(spark, d))


def dict_last_value(spark, d):
    return dictionary.from_terms_with_values(table(spark, d, "events"), "event_type", "event_id", "event_id")


def dict_stats(spark, d):
    return dictionary.stats(vocabulary(spark, d))


def typos_distance1(spark, d):
    return corpus.distance_one(asked(spark, d), "query").groupBy("term", "typo").agg(F.count("*").alias("times"))


def substring_positions(spark, d):
    return substring.occurrences(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("text").alias("needle")))


def _names(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("text")).distinct().select(F.col("text").alias("doc_id"), "text")


def fuzzy_substring(spark, d):
    words = corpus.word_frequencies(_names(spark, d)).select(F.col("term").alias("query"))
    return substring.fuzzy_occurrences(_names(spark, d), words, 1)


def part_name_fuzzy(spark, d):
    names = _names(spark, d).select(F.col("text").alias("term"))
    return similarity_join(names.withColumnRenamed("term", "query"), names, 4)


def supplier_name_fuzzy(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_name").alias("term"))
    return similarity_join(names.withColumnRenamed("term", "query"), names, 1)


def _disguised(spark, d, plain: str, other: str) -> DataFrame:
    return asked(spark, d).select(F.translate("query", plain, other).alias("query")).distinct()


def restricted_leet(spark, d):
    return search.restricted_join(_disguised(spark, d, "aeiost", "431057"), vocabulary(spark, d), 0, LEET_SPEAK)


def restricted_keyboard(spark, d):
    return search.restricted_join(_disguised(spark, d, "ert", "rty"), vocabulary(spark, d), 1, KEYBOARD_QWERTY)


def phonetic_orthography(spark, d):
    return vocabulary(spark, d).select("term", orthography(F.col("term")).alias("sound"))


def phonetic_zompist(spark, d):
    ship(spark)
    return asked(spark, d).select("query", normalize(F.col("query"), ZOMPIST).alias("sound"))


def phonetic_match(spark, d):
    sounds = asked(spark, d).withColumn("sound", orthography(F.col("query")))
    return vocabulary(spark, d).withColumn("s", orthography(F.col("term"))).join(sounds, F.col("s") == F.col("sound")).select("query", "term")


def phonetic_distance(spark, d):
    ship(spark)
    return word_pairs(spark, d).withColumn("distance", F.round(generalized_distance(PHONETIC_ENGLISH_BASIC)(F.col("a"), F.col("b")), 6))


def distance_bytes(spark, d):
    pairs = word_pairs(spark, d)
    return pairs.select("a", "b", distance(byte_view(F.col("a")), byte_view(F.col("b"))).alias("distance"))


def distance_affixes(spark, d):
    return word_pairs(spark, d).select("a", "b", common_affixes(F.col("a"), F.col("b")).alias("x")).select("a", "b", "x.prefix", "x.suffix")


def distance_osa(spark, d):
    ship(spark)
    return word_pairs(spark, d).select("a", "b", distance(F.col("a"), F.col("b"), TRANSPOSITION).alias("distance"))


def distance_merge_split(spark, d):
    ship(spark)
    return word_pairs(spark, d).select("a", "b", distance(F.col("a"), F.col("b"), MERGE_AND_SPLIT).alias("distance"))


def accepts_n2(spark, d):
    return search.accepts(word_pairs(spark, d), byte_view(F.col("a")), byte_view(F.col("b")), 2)


def scopes(spark, d) -> DataFrame:
    """Region, nation and customer as a tree: ids of a level lie above those of the level before."""
    region = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("context_id"), F.lit(None).cast("long").alias("parent_id"))
    nation = table(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("context_id"), F.col("n_regionkey").cast("long").alias("parent_id"))
    customer = table(spark, d, "customer").select((F.col("c_custkey") + 1000).cast("long").alias("context_id"), (F.col("c_nationkey") + 100).cast("long").alias("parent_id"))
    return region.unionByName(nation).unionByName(customer)


def scope_visible(spark, d):
    return context.visible_scopes(scopes(spark, d)).withColumn("depth", F.col("depth").cast("long"))


def scope_completion(spark, d):
    """Requests of every customer for its segment's name less a letter; names stand in the scope of their nation or region."""
    return _completion(spark, d, True)


def _completion(spark, d, by_draft: bool):
    c = table(spark, d, "customer")
    requests = c.select((F.col("c_custkey") + 1000).cast("long").alias("context_id"), F.lower(F.expr("concat(left(c_mktsegment, 1), substring(c_mktsegment, 3))")).alias("query"))
    names = c.select(F.lower("c_mktsegment").alias("term"), (F.col("c_nationkey") + 100).cast("long").alias("s")).groupBy("term").agg(F.collect_set("s").alias("contexts"))
    drafts = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("context_id"), F.lit("building").alias("term"))
    return context.complete(requests, scopes(spark, d), names, drafts, 2, by_draft=by_draft).select("context_id", "query", "term", "distance", "is_draft", F.concat_ws(",", F.transform("contexts", lambda x: x.cast("string"))).alias("contexts"), F.col("rank").cast("long"))


def draft_fold(spark, d):
    """All events as an edit log: the type picks the operation."""
    return context.fold_drafts(_edit_log(spark, d))


def _log(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("term"), "ts", F.length("props").cast("long").alias("size_bytes"))


def cache_scores(spark, d):
    s = cache.scores(cache.metadata(_log(spark, d)))
    return s.select("term", "hits", "size_bytes", *[F.round(c, 4).alias(c) for c in ("lru", "lfu", "age", "cost", "pressure")])


def _victims(policy: str):
    return lambda spark, d: cache.victims(cache.metadata(_log(spark, d)), policy, count=10).withColumn("score", F.round("score", 4))


def cache_ttl(spark, d):
    log = _log(spark, d)
    return cache.visible_within(log.select("term").distinct(), cache.metadata(log), 29.9 * 86400)


def lazy_default(spark, d):
    return cache.with_default(dictionary.get_value(asked(spark, d), vocabulary(spark, d)), F.lit(0))


def workload_stats(spark, d):
    return corpus.workload_stats(vocabulary(spark, d), "value").withColumn("average", F.round("average", 6))


def generated_typos(spark, d):
    return corpus.typos(asked(spark, d), 2, 3, 7, "query")


def generated_workload(spark, d):
    return corpus.workload(vocabulary(spark, d).withColumnRenamed("value", "freq"), 1000, 7)


def recall(spark, d):
    """Words without their second letter and with up to two more, looked up in the words: which distances find the word again."""
    words = asked(spark, d)
    pairs = words.where(F.length("query") >= 3).select(F.expr("concat(left(query, 1), substring(query, 3), left('xy', length(query) % 3))").alias("query"), F.col("query").alias("term"))
    pairs = cut(pairs.withColumn("distance", F.levenshtein("query", "term")), "pairs")
    return corpus.recall_at(pairs, similarity_join(pairs.select("query"), words.withColumnRenamed("query", "term"), 3))


def dict_from_terms(spark, d):
    return dictionary.from_terms(table(spark, d, "conversations").select(F.explode(corpus.words(F.col("text"))).alias("term")))


def prefix_values(spark, d):
    return search.starts_with_values(asked(spark, d), vocabulary(spark, d))


def _round_trip(fmt: str, compression: str | None = None, then: str | None = None):
    def run(spark, d):
        path = fresh_path(spark, "terms")
        files.write_terms(vocabulary(spark, d).select("term"), path, fmt, compression)
        if then:
            files.convert(spark, path, f"{path}-{then}", target_format=then)
            path = f"{path}-{then}"
        return files.read_terms(spark, path).select("term")

    return run


def token_lines(spark, d):
    path = fresh_path(spark, "tokens")
    table(spark, d, "conversations").select(F.explode(corpus.words(F.col("text"))).alias("value")).select(F.concat(F.lit(" "), F.translate("value", corpus.LETTERS, corpus.LETTERS.upper()))).write.text(path)
    return corpus.read_token_lines(spark, path)


def _misspelled(spark, d) -> DataFrame:
    """A list of misspellings, each word of the benchmark without its second letter, as a file that is read back."""
    path = fresh_path(spark, "misspellings")
    words = asked(spark, d).where(F.length("query") >= 2)
    words.select(F.expr("concat('$', query, '\\n', left(query, 1), substring(query, 3), ' ', length(query), '\\n', query, 'x')")).write.text(path)
    return corpus.read_misspellings(spark, path)


def documents_insert(spark, d):
    new = table(spark, d, "benchmark").groupBy(F.col("item_id").alias("doc_id")).agg(F.min("text").alias("text"))
    return substring.insert_documents(table(spark, d, "documents").select("doc_id", "text"), new)


def documents_remove(spark, d):
    return substring.remove_documents(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").where("toxic = 1"))


def source_texts(spark, d):
    return substring.source_texts(substring_positions(spark, d), table(spark, d, "documents"))


def substring_contains(spark, d):
    needles = asked(spark, d).select(F.concat(F.lit(" "), F.col("query"), F.lit(" ")).alias("needle"))
    return substring.contains_substring(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text"), needles)


def fuzzy_substring_documents(spark, d):
    """Long words of the benchmark and their misspellings anywhere in the documents."""
    return substring.fuzzy_occurrences(table(spark, d, "documents"), asked(spark, d).where(F.length("query") >= 10), 1)


def _micros(ts: str):
    """Microseconds since 1970 of a time without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS TIMESTAMP_NTZ))")


def cache_stats(spark, d):
    return cache.cache_stats(_log(spark, d)).withColumn("last_access", _micros("last_access"))


def access_counts(spark, d):
    got = stream_counts(table(spark, d, "events").select(F.col("event_type").alias("term"), "ts"))
    return got.select((_micros("window.start") / 1000000).cast("long").alias("start"), "term", "hits", _micros("last_access").alias("last_access"))


def _edit_log(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    kinds = {"click": "insert", "view": "insert", "purchase": "finalize", "scroll": "delete", "hover": "checkpoint", "search": "insert", "login": "checkpoint", "logout": "undo"}
    op = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("undo"))
    return e.select(F.col("user_id").alias("context_id"), F.col("event_id").alias("seq"), op.alias("op"), F.substring("event_type", 1, 2).alias("arg"))


def draft_rejected(spark, d):
    """Scopes are the suppliers, so that some operations name a scope that is not there."""
    known = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("context_id"))
    return context.rejected(_edit_log(spark, d), known)


def _engine(spark, d) -> context.CompletionEngine:
    c = table(spark, d, "customer")
    names = c.select(F.lower("c_mktsegment").alias("term"), (F.col("c_nationkey") + 100).cast("long").alias("s")).groupBy("term").agg(F.collect_set("s").alias("contexts"))
    return context.CompletionEngine(scopes(spark, d), names).apply(_edit_log(spark, d).withColumn("context_id", (F.col("context_id") + 1000).cast("long")))


def engine_terms(spark, d):
    return _engine(spark, d).terms().select("term", F.concat_ws(",", F.transform("contexts", lambda x: x.cast("string"))).alias("contexts"))


def engine_has_term(spark, d):
    return _engine(spark, d).has_term(table(spark, d, "customer").select(F.lower("c_mktsegment").alias("term")).unionByName(asked(spark, d).withColumnRenamed("query", "term")))


def scope_remove(spark, d):
    return context.remove_scope(scopes(spark, d), 2)


def scope_descendants(spark, d):
    pairs = scopes(spark, d).select("context_id", (F.col("context_id") % 5).cast("long").alias("ancestor_id"))
    return context.is_descendant(scopes(spark, d), pairs)


def scope_completion_static(spark, d):
    """Ranked by distance and term only."""
    return _completion(spark, d, False)


def restricted_diacritics(spark, d):
    return search.restricted_join(_disguised(spark, d, "äçèéêíñóöüß", "aceeeinoous"), vocabulary(spark, d), 0, DIACRITICS_LATIN)


def _operations(ops: list[dict]):
    def run(spark, d):
        ship(spark)
        return word_pairs(spark, d).withColumn("distance", generalized_distance(ops)(F.col("a"), F.col("b")).cast("long"))

    return run


def query_builder(spark, d):
    index = search.FuzzyIndex(vocabulary(spark, d), value_col="value")
    return index.builder(asked(spark, d)).max_distance(1).filter(F.col("value") >= 2).ordered().limit(2).execute()


def large_distance(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("query"))
    terms = table(spark, d, "customer").select(F.col("c_mktsegment").alias("term")).unionByName(names.withColumnRenamed("query", "term"))
    return similarity_join(names, terms, 99)


def udtf_search(spark, d):
    register(spark)
    vocabulary(spark, d).createOrReplaceTempView("termweave_vocabulary")
    return spark.sql("SELECT term, distance FROM fuzzy_search(TABLE(SELECT term FROM termweave_vocabulary WHERE length(term) BETWEEN 3 AND 7), 'house', 2)")


def uniform_workload(spark, d):
    return corpus.uniform_workload(asked(spark, d).withColumnRenamed("query", "term"), 1000, 7)


def query_list(spark, d):
    return corpus.query_list(vocabulary(spark, d), 100, 7)


def queries() -> dict:
    return {
        "vocab_frequencies": lambda s, d: corpus.word_frequencies(table(s, d, "documents")),
        "words_by_frequency": lambda s, d: corpus.word_frequencies(table(s, d, "documents")).orderBy(F.desc("freq"), "term"),
        "workload_stats": workload_stats,
        "fuzzy_std_n1": _matches(1),
        "fuzzy_std_n2": _matches(2),
        "fuzzy_osa_n1": _matches(1, TRANSPOSITION),
        "fuzzy_osa_n2": _matches(2, TRANSPOSITION),
        "fuzzy_merge_split_n1": _matches(1, MERGE_AND_SPLIT),
        "fuzzy_topk": fuzzy_topk,
        "fuzzy_ranked": lambda s, d: search.FuzzyIndex(vocabulary(s, d)).query_ranked(asked(s, d), 1),
        "fuzzy_prefix": fuzzy_prefix,
        "exact_prefix": exact_prefix,
        "contains_batch": contains_batch,
        "get_value_batch": get_value_batch,
        "fuzzy_value_filtered": fuzzy_value_filtered,
        "fuzzy_value_set": fuzzy_value_set,
        "fuzzy_multimap_union": fuzzy_multimap_union,
        "fuzzy_multimap_concat": fuzzy_multimap_concat,
        "bench_self_join": bench_self_join,
        "dict_union_merge": dict_union_merge,
        "dict_union_replace": dict_union_replace,
        "dict_remove": dict_remove,
        "dict_insert_new": dict_insert_new,
        "dict_intersect": dict_intersect,
        "dict_last_value": dict_last_value,
        "dict_stats": dict_stats,
        "typos_distance1": typos_distance1,
        "substring_positions": substring_positions,
        "fuzzy_substring": fuzzy_substring,
        "part_name_fuzzy": part_name_fuzzy,
        "supplier_name_fuzzy": supplier_name_fuzzy,
        "restricted_leet": restricted_leet,
        "restricted_keyboard": restricted_keyboard,
        "phonetic_orthography": phonetic_orthography,
        "phonetic_zompist": phonetic_zompist,
        "phonetic_match": phonetic_match,
        "phonetic_distance": phonetic_distance,
        "distance_bytes": distance_bytes,
        "distance_affixes": distance_affixes,
        "distance_osa": distance_osa,
        "distance_merge_split": distance_merge_split,
        "accepts_n2": accepts_n2,
        "scope_visible": scope_visible,
        "scope_completion": scope_completion,
        "draft_fold": draft_fold,
        "cache_scores": cache_scores,
        "cache_lru": _victims("lru"),
        "cache_lfu": _victims("lfu"),
        "cache_age": _victims("age"),
        "cache_cost": _victims("cost"),
        "cache_pressure": _victims("pressure"),
        "cache_ttl": cache_ttl,
        "lazy_default": lazy_default,
        "generated_typos": generated_typos,
        "generated_workload": generated_workload,
        "recall": recall,
        "dict_from_terms": dict_from_terms,
        "dict_insert": lambda s, d: dictionary.insert(vocabulary(s, d), _talk(s, d)),
        "dict_subtract": lambda s, d: dictionary.subtract(vocabulary(s, d), _talk(s, d)),
        "dict_clear": lambda s, d: dictionary.clear(vocabulary(s, d)),
        "contains_with_value": lambda s, d: dictionary.contains_with_value(asked(s, d), vocabulary(s, d), F.col("value") >= 10),
        "values_any": lambda s, d: dictionary.any_value(_by_language(s, d), lambda x: x == "en").select("term"),
        "values_every": lambda s, d: dictionary.every_value(_by_language(s, d), lambda x: x == "en").select("term"),
        "prefix_values": prefix_values,
        "round_trip_text": _round_trip("text"),
        "round_trip_gzip": _round_trip("text", "gzip"),
        "round_trip_json": _round_trip("json"),
        "round_trip_csv": _round_trip("csv"),
        "round_trip_parquet": _round_trip("parquet"),
        "round_trip_convert": _round_trip("text", None, "json"),
        "token_lines": token_lines,
        "misspelling_list": _misspelled,
        "misspelling_stats": lambda s, d: corpus.misspelling_stats(_misspelled(s, d)),
        "documents_insert": documents_insert,
        "documents_remove": documents_remove,
        "source_texts": source_texts,
        "substring_contains": substring_contains,
        "fuzzy_substring_documents": fuzzy_substring_documents,
        "cache_stats": cache_stats,
        "access_counts": access_counts,
        "draft_rejected": draft_rejected,
        "engine_terms": engine_terms,
        "engine_has_term": engine_has_term,
        "scope_remove": scope_remove,
        "scope_depth": lambda s, d: context.depth(scopes(s, d)),
        "scope_descendants": scope_descendants,
        "scope_completion_static": scope_completion_static,
        "restricted_diacritics": restricted_diacritics,
        "operations_transposition": _operations(WITH_TRANSPOSITION),
        "operations_merge_split": _operations(WITH_MERGE_SPLIT),
        "query_builder": query_builder,
        "large_distance": large_distance,
        "udtf_search": udtf_search,
        "uniform_workload": uniform_workload,
        "query_list": query_list,
    }


#: Letters beyond a-z in the tables' words, and bytes for them, so that distances over bytes count letters.
_BYTES = "'ßäçèéêíñóöü', '0123456789_'"
_WORDS = r"unnest(regexp_extract_all(lower(text), '\p{L}+'))"
_V = f"v AS (SELECT term, translate(term, {_BYTES}) AS et, count(*) AS value FROM (SELECT {_WORDS} AS term FROM documents) GROUP BY 1, 2)"
_Q = f"q AS (SELECT DISTINCT query, translate(query, {_BYTES}) AS eq FROM (SELECT {_WORDS} AS query FROM benchmark))"
_T = f"t AS (SELECT term, count(*) AS value FROM (SELECT {_WORDS} AS term FROM conversations) GROUP BY 1)"
_L = f"l AS (SELECT term, translate(term, {_BYTES}) AS et, list_sort(list_distinct(list(lang))) AS value FROM (SELECT lang, {_WORDS} AS term FROM documents) GROUP BY 1, 2)"
_P = "p AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(text, ' ') AS w FROM benchmark)))"
_N = "n AS (SELECT DISTINCT p_name AS text FROM part)"
_S = """s AS (SELECT r_regionkey::BIGINT AS context_id, NULL::BIGINT AS parent_id FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100 FROM customer),
  z(context_id, visible_id, depth) AS (SELECT context_id, context_id, 0::BIGINT FROM s UNION ALL SELECT z.context_id, s.parent_id, depth + 1 FROM z JOIN s ON z.visible_id = s.context_id WHERE s.parent_id IS NOT NULL)"""
_C = """c AS (SELECT user_id AS term, min(ts) AS f, max(ts) AS l, count(*) AS hits, max(length(props))::BIGINT AS size_bytes FROM events GROUP BY 1),
  m AS (SELECT *, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(l)) / 1e6::DOUBLE AS lru, -hits::DOUBLE AS lfu, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(f)) / 1e6::DOUBLE AS age FROM c),
  x AS (SELECT *, age * size_bytes / (hits + 1) AS cost, size_bytes / 1.1::DOUBLE AS pressure FROM m)"""


def _near(n: int, where: str = "TRUE", more: str = "") -> str:
    return f"{_V}, {_Q}, m AS (SELECT query, term, levenshtein(eq, et) AS distance, value FROM q JOIN v ON abs(length(eq) - length(et)) <= {n} AND levenshtein(eq, et) <= {n} WHERE {where}){more}"


def _dp(a: str, b: str, *more: str, unit: int = 1) -> str:
    """The textbook table, row by row: x.i and y[1] count letters of a and b; r is the row at hand, s.p and s.pp those before."""
    cell = f"least(r[y[1]] + {unit}, s.p[y[1] + 1] + {unit}, s.p[y[1]] + CASE WHEN substr({a}, x.i, 1) = substr({b}, y[1], 1) THEN 0 ELSE {unit} END{''.join(f', {m}' for m in more)})"
    row = f"list_transform(range(0, length({b}) + 1), lambda j: j * {unit})"
    inner = f"list_reduce([[x.i * {unit}]] || list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda r, y: list_append(r, {cell}))"
    rows = f"list_transform(range(1, length({a}) + 1), lambda i: {{'i': i, 'pp': NULL::BIGINT[], 'p': NULL::BIGINT[]}})"
    return f"list_reduce([{{'i': 0::BIGINT, 'pp': {row}, 'p': {row}}}] || {rows}, lambda s, x: {{'i': x.i, 'pp': s.p, 'p': {inner}}}).p[length({b}) + 1]"


def _swap(a: str, b: str) -> str:
    return f"CASE WHEN x.i > 1 AND y[1] > 1 AND substr({a}, x.i, 1) = substr({b}, y[1] - 1, 1) AND substr({a}, x.i - 1, 1) = substr({b}, y[1], 1) THEN s.pp[y[1] - 1] + 1 ELSE 1000 END"


_MERGE, _SPLIT = "CASE WHEN x.i > 1 THEN s.pp[y[1]] + 1 ELSE 1000 END", "CASE WHEN y[1] > 1 THEN s.p[y[1] - 1] + 1 ELSE 1000 END"


def _weighted(op: dict, a: str, b: str) -> str:
    """An operation with pairs, in hundredths."""
    cx, cy = op["consume_x"], op["consume_y"]
    before = {(1, 1): "s.p[y[1]]", (2, 1): "s.pp[y[1]]", (1, 2): "s.p[y[1] - 1]", (2, 2): "s.pp[y[1] - 1]"}[cx, cy]
    listed = ", ".join(f"'{x}>{y}'" for x, y in sorted(op["pairs"]))
    return f"CASE WHEN x.i >= {cx} AND y[1] >= {cy} AND list_contains([{listed}], substr({a}, x.i - {cx - 1}, {cx}) || '>' || substr({b}, y[1] - {cy - 1}, {cy})) THEN {before} + {round(op['weight'] * 100)} ELSE 100000 END"


_SOUND = "replace(replace(replace(replace(replace(replace(replace(replace(replace({w}, 'ch', 'ç'), 'sh', '$'), 'ph', 'f'), 'c', 'k'), 'gh', ''), 'gh', ''), 'gh', ''), 'sh', '$'), 'ph', 'f')"


def _edited(w: str) -> str:
    """The list of a word's edits, in their order."""
    letters = "string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')"
    deleted = f"list_transform(range(1, length({w}) + 1), lambda i: left({w}, i - 1) || substr({w}, i + 1))"
    inserted = f"flatten(list_transform(range(1, length({w}) + 2), lambda i: list_transform({letters}, lambda c: left({w}, i - 1) || c || substr({w}, i))))"
    substituted = f"flatten(list_transform(range(1, length({w}) + 1), lambda i: list_transform(list_filter({letters}, lambda c: c <> substr({w}, i, 1)), lambda c: left({w}, i - 1) || c || substr({w}, i + 1))))"
    swapped = f"list_transform(range(1, length({w})), lambda i: left({w}, i - 1) || substr({w}, i + 1, 1) || substr({w}, i, 1) || substr({w}, i + 2))"
    return f"({deleted} || {inserted} || {substituted} || {swapped})"


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


_OPS = "CASE event_type WHEN 'click' THEN 'insert' WHEN 'view' THEN 'insert' WHEN 'purchase' THEN 'finalize' WHEN 'scroll' THEN 'delete' WHEN 'hover' THEN 'checkpoint' WHEN 'search' THEN 'insert' WHEN 'login' THEN 'checkpoint' ELSE 'undo' END"
_EMPTY = "'draft': ''::VARCHAR, 'marks': []::BIGINT[], 'done': []::VARCHAR[], 'bad': []::STRUCT(seq BIGINT, op VARCHAR, error VARCHAR)[]"
_FOLD = f"""e AS (SELECT user_id AS context_id, event_id AS seq, {_OPS} AS op, substr(event_type, 1, 2) AS arg FROM events),
  lo AS (SELECT context_id, list({{'seq': seq::BIGINT, 'op': op::VARCHAR, 'arg': arg::VARCHAR, {_EMPTY}}} ORDER BY seq) AS ops FROM e GROUP BY 1),
  f AS (SELECT context_id, list_reduce([{{'seq': 0::BIGINT, 'op': ''::VARCHAR, 'arg': ''::VARCHAR, {_EMPTY}}}] || ops, lambda s, x: {{'seq': x.seq, 'op': x.op, 'arg': x.arg,
    'draft': CASE WHEN x.op = 'insert' THEN s.draft || x.arg WHEN x.op = 'delete' AND s.draft <> '' THEN left(s.draft, length(s.draft) - 1) WHEN x.op = 'finalize' THEN '' WHEN x.op = 'undo' AND len(s.marks) > 0 THEN left(s.draft, s.marks[len(s.marks)]) ELSE s.draft END,
    'marks': CASE WHEN x.op = 'checkpoint' THEN list_append(s.marks, length(s.draft)) WHEN x.op = 'undo' THEN s.marks[1:len(s.marks) - 1] WHEN x.op = 'finalize' AND s.draft <> '' THEN []::BIGINT[] ELSE s.marks END,
    'done': CASE WHEN x.op = 'finalize' AND s.draft <> '' AND NOT list_contains(s.done, s.draft) THEN list_append(s.done, s.draft) ELSE s.done END,
    'bad': CASE WHEN x.op = 'undo' AND len(s.marks) = 0 THEN list_append(s.bad, {{'seq': x.seq, 'op': x.op, 'error': 'NoCheckpoints'}}) WHEN x.op = 'finalize' AND s.draft = '' THEN list_append(s.bad, {{'seq': x.seq, 'op': x.op, 'error': 'EmptyDraft'}}) ELSE s.bad END}}) AS s FROM lo)"""


def _pair_list(pairs) -> str:
    return "[" + ", ".join("'" + x + y + "'" for x, y in sorted(pairs)) + "]"


def _alike(i: str, j: str) -> str:
    """Whether the term's letter i and the query's letter j are the same or neighbours on the keyboard."""
    listed = " ".join(x + y for x, y in sorted(KEYBOARD_QWERTY))
    return f"(substr(et, {i}, 1) = substr(eq, {j}, 1) OR contains('{listed}', substr(et, {i}, 1) || substr(eq, {j}, 1)))"


def _completed(order: str) -> str:
    return f"""WITH RECURSIVE {_S},
  r AS (SELECT DISTINCT c_custkey + 1000 AS context_id, lower(left(c_mktsegment, 1) || substr(c_mktsegment, 3)) AS query FROM customer),
  g AS (SELECT DISTINCT lower(c_mktsegment) AS term, (c_nationkey + 100)::BIGINT AS visible_id, FALSE AS is_draft FROM customer UNION ALL SELECT 'building', r_regionkey, TRUE FROM region),
  m AS (SELECT r.context_id, query, term, is_draft, min(levenshtein(query, term)) AS distance, list_sort(list_distinct(list(g.visible_id))) AS contexts FROM r JOIN z USING (context_id) JOIN g ON g.visible_id = z.visible_id AND levenshtein(query, term) <= 2 GROUP BY 1, 2, 3, 4),
  k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY context_id, query, term ORDER BY is_draft DESC) = 1)
  SELECT context_id, query, term, distance, is_draft, array_to_string(contexts, ',') AS contexts, row_number() OVER (PARTITION BY context_id, query ORDER BY {order}) AS rank FROM k"""


def oracle_sql() -> dict[str, str]:
    deleted = "SELECT query AS term, left(query, i - 1) || substr(query, i + 1) AS typo FROM (SELECT query, unnest(range(1, length(query) + 1)) AS i FROM q)"
    letters = "(SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS c)"
    return {
        "vocab_frequencies": f"WITH {_V} SELECT term, value AS freq FROM v",
        "words_by_frequency": f"WITH {_V} SELECT term, value AS freq FROM v ORDER BY freq DESC, term",
        "workload_stats": f"WITH {_V} SELECT count(*) AS total, count(DISTINCT term) AS unique_terms, min(value) AS least, max(value) AS most, round(avg(value), 6) AS average FROM v",
        "fuzzy_std_n1": f"WITH {_near(1)} SELECT query, term, distance FROM m",
        "fuzzy_std_n2": f"WITH {_near(2)} SELECT query, term, distance FROM m",
        "fuzzy_osa_n1": f"WITH {_V}, {_Q} SELECT query, term, damerau_levenshtein(eq, et) AS distance FROM q JOIN v ON abs(length(eq) - length(et)) <= 1 AND levenshtein(eq, et) <= 2 AND damerau_levenshtein(eq, et) <= 1",
        "fuzzy_osa_n2": f"WITH {_V}, {_Q}, m AS (SELECT query, term, {_dp('eq', 'et', _swap('eq', 'et'))} AS distance FROM q JOIN v ON abs(length(eq) - length(et)) <= 2 AND levenshtein(eq, et) <= 4 AND damerau_levenshtein(eq, et) <= 2) SELECT query, term, distance FROM m WHERE distance <= 2",
        "fuzzy_merge_split_n1": f"WITH {_V}, {_Q}, m AS (SELECT query, term, {_dp('et', 'eq', _MERGE, _SPLIT)} AS distance FROM q JOIN v ON abs(length(eq) - length(et)) <= 1 AND levenshtein(eq, et) <= 2) SELECT query, term, distance FROM m WHERE distance <= 1",
        "distance_osa": f"WITH {_P} SELECT a, b, {_dp('a', 'b', _swap('a', 'b'))} AS distance FROM p",
        "distance_merge_split": f"WITH {_P} SELECT a, b, {_dp('a', 'b', _MERGE, _SPLIT)} AS distance FROM p",
        "operations_transposition": f"WITH {_P} SELECT a, b, {_dp('a', 'b', _swap('a', 'b'))} AS distance FROM p",
        "operations_merge_split": f"WITH {_P} SELECT a, b, {_dp('a', 'b', _MERGE, _SPLIT)} AS distance FROM p",
        "phonetic_distance": f"WITH {_P} SELECT a, b, round({_dp('a', 'b', *[_weighted(o, 'a', 'b') for o in PHONETIC_ENGLISH_BASIC if o['pairs']], unit=100)} / 100, 6) AS distance FROM p",
        "phonetic_zompist": f"WITH {_Q}, s AS (SELECT query, {_SOUND.format(w='query')} AS sound FROM q) SELECT query, replace(replace(replace(regexp_replace(sound, 'th+', 't', 'g'), 'kw', 'qu'), 'x', 'zz'), 'y', 'z') AS sound FROM s",
        "fuzzy_topk": f"WITH {_near(2)} SELECT query, term, distance, row_number() OVER (PARTITION BY query ORDER BY distance, term) AS rank FROM m QUALIFY rank <= 3",
        "fuzzy_ranked": f"WITH {_near(1)} SELECT query, term, distance FROM m ORDER BY query, distance, term",
        "fuzzy_prefix": f"WITH {_V}, {_Q}, x AS (SELECT query, term, eq, et, unnest(range(greatest(0, length(query) - 1), least(length(query) + 1, length(term)) + 1)) AS k FROM q JOIN v ON length(term) >= length(query) - 1 AND (left(term, 1) = left(query, 1) OR substr(term, 2, 1) = left(query, 1) OR left(term, 1) = substr(query, 2, 1) OR substr(term, 2, 1) = substr(query, 2, 1) OR length(query) <= 2)) SELECT query, term, min(levenshtein(eq, left(et, k))) AS distance FROM x GROUP BY 1, 2 HAVING min(levenshtein(eq, left(et, k))) <= 1",
        "exact_prefix": f"WITH {_V}, {_Q} SELECT query, term FROM q JOIN v ON starts_with(term, query)",
        "contains_batch": f"WITH {_V}, {_Q} SELECT query, term IS NOT NULL AS found FROM q LEFT JOIN v ON query = term",
        "get_value_batch": f"WITH {_V}, {_Q} SELECT query, value FROM q LEFT JOIN v ON query = term",
        "fuzzy_value_filtered": f"WITH {_near(2, 'value >= 10')} SELECT query, term, distance FROM m",
        "fuzzy_value_set": f"WITH {_near(1, 'value IN (SELECT p_size FROM part)')} SELECT query, term, distance FROM m",
        "fuzzy_multimap_union": f"WITH {_L}, {_Q}, m AS (SELECT query, value FROM q JOIN l ON abs(length(eq) - length(et)) <= 1 AND levenshtein(eq, et) <= 1) SELECT query, list_sort(list_distinct(flatten(list(value)))) AS value FROM m GROUP BY 1",
        "fuzzy_multimap_concat": f"WITH {_L}, {_Q}, m AS (SELECT query, term, levenshtein(eq, et) AS distance, value FROM q JOIN l ON abs(length(eq) - length(et)) <= 1 AND levenshtein(eq, et) <= 1) SELECT query, flatten(list(value ORDER BY distance, term)) AS value FROM m GROUP BY 1",
        "bench_self_join": f"WITH {_Q} SELECT a.query, b.query AS term, levenshtein(a.eq, b.eq) AS distance FROM q a JOIN q b ON a.query < b.query AND levenshtein(a.eq, b.eq) <= 2",
        "dict_union_merge": f"WITH {_V}, {_T} SELECT coalesce(v.term, t.term) AS term, coalesce(v.value, 0) + coalesce(t.value, 0) AS value FROM v FULL JOIN t ON v.term = t.term",
        "dict_union_replace": f"WITH {_V}, {_T} SELECT coalesce(v.term, t.term) AS term, coalesce(t.value, v.value) AS value FROM v FULL JOIN t ON v.term = t.term",
        "dict_remove": f"WITH {_V}, {_T} SELECT term, value FROM v WHERE term NOT IN (SELECT term FROM t)",
        "dict_insert_new": f"WITH {_V}, {_T} SELECT term FROM t WHERE term NOT IN (SELECT term FROM v)",
        "dict_intersect": f"WITH {_V}, {_T} SELECT term FROM v INTERSECT SELECT term FROM t",
        "dict_last_value": "SELECT event_type AS term, max(event_id) AS value FROM events GROUP BY 1",
        "dict_stats": f"WITH {_V}, x AS (SELECT DISTINCT left(term, k) AS p FROM (SELECT term, unnest(range(0, length(term) + 1)) AS k FROM v)) SELECT count(*) AS terms, sum(length(term))::BIGINT AS characters, max(length(term)) AS longest, (SELECT count(*) FROM x) AS nodes FROM v",
        "typos_distance1": f"WITH {_Q}, x AS ({deleted} UNION ALL SELECT query, left(query, i - 1) || c || substr(query, i) FROM (SELECT query, unnest(range(1, length(query) + 2)) AS i FROM q), {letters} UNION ALL SELECT query, left(query, i - 1) || c || substr(query, i + 1) FROM (SELECT query, unnest(range(1, length(query) + 1)) AS i FROM q), {letters} WHERE c <> substr(query, i, 1) UNION ALL SELECT query, left(query, i - 1) || substr(query, i + 1, 1) || substr(query, i, 1) || substr(query, i + 2) FROM (SELECT query, unnest(range(1, length(query))) AS i FROM q)) SELECT term, typo, count(*) AS times FROM x GROUP BY 1, 2",
        "substring_positions": "WITH RECURSIVE x AS (SELECT DISTINCT doc_id, b.text AS needle, d.text, instr(d.text, b.text) AS pos FROM documents d JOIN (SELECT DISTINCT text FROM benchmark WHERE text <> '') b ON contains(d.text, b.text) UNION ALL SELECT doc_id, needle, text, pos + instr(substr(text, pos + 1), needle) FROM x WHERE instr(substr(text, pos + 1), needle) > 0) SELECT doc_id, needle, pos - 1 AS start, pos - 1 + length(needle) AS \"end\" FROM x",
        "fuzzy_substring": f"WITH {_N}, q AS (SELECT DISTINCT query FROM (SELECT {_WORDS} AS query FROM n)), w AS (SELECT text AS doc_id, i AS start, unnest(range(1, length(text) - i + 1)) AS k, text FROM (SELECT text, unnest(range(0, length(text))) AS i FROM n)), u AS (SELECT doc_id, start, substr(text, start + 1, k) AS term FROM w) SELECT query, doc_id, start, term, levenshtein(query, term) AS distance FROM u JOIN q ON abs(length(term) - length(query)) <= 1 AND levenshtein(query, term) <= 1",
        "part_name_fuzzy": f"WITH {_N} SELECT a.text AS query, b.text AS term, levenshtein(a.text, b.text) AS distance FROM n a JOIN n b ON levenshtein(a.text, b.text) <= 4",
        "supplier_name_fuzzy": "WITH n AS (SELECT DISTINCT s_name AS x FROM supplier) SELECT a.x AS query, b.x AS term, levenshtein(a.x, b.x) AS distance FROM n a JOIN n b ON levenshtein(a.x, b.x) <= 1",
        "restricted_leet": f"WITH {_V}, {_Q}, r AS (SELECT DISTINCT translate(query, 'aeiost', '431057') AS query FROM q) SELECT query, term, 0 AS distance FROM r JOIN v ON length(query) = length(term) WHERE len(list_filter(range(1, length(term) + 1), lambda i: substr(term, i, 1) <> substr(query, i, 1) AND NOT list_contains({_pair_list(LEET_SPEAK)}, substr(term, i, 1) || substr(query, i, 1)))) = 0",
        "phonetic_orthography": f"WITH {_V} SELECT term, {_SOUND.format(w='term')} AS sound FROM v",
        "phonetic_match": f"WITH {_V}, {_Q} SELECT query, term FROM q JOIN v ON {_SOUND.format(w='term')} = {_SOUND.format(w='query')}",
        "distance_bytes": f"WITH {_P} SELECT a, b, levenshtein(a, b) AS distance FROM p",
        "distance_affixes": f"WITH {_P}, x AS (SELECT a, b, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: left(a, k) = left(b, k))) AS prefix FROM p) SELECT a, b, prefix, len(list_filter(range(1, least(length(a), length(b)) - prefix + 1), lambda k: right(a, k) = right(b, k))) AS suffix FROM x",
        "accepts_n2": f"WITH {_P} SELECT a, b, levenshtein(a, b) <= 2 AS accepts FROM p",
        "scope_visible": f"WITH RECURSIVE {_S} SELECT context_id, visible_id, depth FROM z",
        "scope_completion": _completed("distance, is_draft, term"),
        "scope_completion_static": _completed("distance, term"),
        "cache_scores": f"WITH {_C} SELECT term, hits, size_bytes, round(lru, 4) AS lru, round(lfu, 4) AS lfu, round(age, 4) AS age, round(cost, 4) AS cost, round(pressure, 4) AS pressure FROM x",
        **{f"cache_{p}": f"WITH {_C} SELECT term, round({p}, 4) AS score FROM x ORDER BY {p} DESC, term LIMIT 10" for p in ("lru", "lfu", "age", "cost", "pressure")},
        "cache_ttl": f"WITH {_C} SELECT term FROM x WHERE age <= 29.9 * 86400",
        "lazy_default": f"WITH {_V}, {_Q} SELECT query, coalesce(value, 0) AS value FROM q LEFT JOIN v ON query = term",
        "recall": f"WITH {_Q}, p AS (SELECT left(eq, 1) || substr(eq, 3) || left('xy', length(eq) % 3) AS a, eq AS b FROM q WHERE length(eq) >= 3), m AS (SELECT levenshtein(a, b) AS d FROM p) SELECT count(*) AS pairs, avg((d <= 1)::DOUBLE) AS recall_1, avg((d <= 2)::DOUBLE) AS recall_2, avg((d <= 3)::DOUBLE) AS recall_3 FROM m WHERE d <= 3",
        "dict_from_terms": f"WITH {_T} SELECT term FROM t",
        "dict_insert": f"WITH {_V}, {_T} SELECT term FROM v UNION SELECT term FROM t",
        "dict_subtract": f"WITH {_V}, {_T} SELECT term FROM v EXCEPT SELECT term FROM t",
        "dict_clear": f"WITH {_V} SELECT term, value FROM v LIMIT 0",
        "contains_with_value": f"WITH {_V}, {_Q} SELECT query, coalesce(value >= 10, FALSE) AS found FROM q LEFT JOIN v ON query = term",
        "values_any": f"WITH {_L} SELECT term FROM l WHERE list_contains(value, 'en')",
        "values_every": f"WITH {_L} SELECT term FROM l WHERE value = ['en'] OR len(value) = 0",
        "prefix_values": f"WITH {_V}, {_Q} SELECT query, term, value FROM q JOIN v ON starts_with(term, query)",
        **{f"round_trip_{k}": f"WITH {_V} SELECT term FROM v" for k in ("text", "gzip", "json", "csv", "parquet", "convert")},
        "token_lines": f"WITH {_T} SELECT term, value AS freq FROM t",
        "misspelling_list": f"WITH {_Q} SELECT query AS correct, left(query, 1) || substr(query, 3) AS misspelling, length(query)::INT AS freq FROM q WHERE length(query) >= 2 UNION ALL SELECT query, query || 'x', 1 FROM q WHERE length(query) >= 2",
        "misspelling_stats": f"WITH {_Q}, m AS (SELECT query AS c, left(query, 1) || substr(query, 3) AS m, length(query) AS f FROM q WHERE length(query) >= 2 UNION ALL SELECT query, query || 'x', 1 FROM q WHERE length(query) >= 2) SELECT count(DISTINCT c) AS correct_words, sum(f)::BIGINT AS total, count(DISTINCT m) AS unique_misspellings FROM m",
        "documents_insert": "SELECT doc_id, text FROM documents UNION ALL SELECT item_id, min(text) FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents) GROUP BY 1",
        "documents_remove": "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "source_texts": "SELECT doc_id, text FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE b.text <> '' AND contains(d.text, b.text))",
        "substring_contains": f"WITH {_Q}, a AS (SELECT DISTINCT ' ' || query || ' ' AS needle FROM q) SELECT needle, EXISTS (SELECT 1 FROM conversations c WHERE contains(c.text, needle)) AS found FROM a",
        "cache_stats": "SELECT count(*) AS accesses, count(DISTINCT user_id) AS terms, epoch_us(max(ts)) AS last_access FROM events",
        "access_counts": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type AS term, count(*) AS hits, epoch_us(max(ts)) AS last_access FROM events GROUP BY 1, 2",
        "draft_fold": f"WITH {_FOLD} SELECT context_id, s.draft AS draft, len(s.marks) AS checkpoints, list_sort(s.done) AS finalized, len(s.bad) AS errors FROM f",
        "draft_rejected": f"WITH {_FOLD}, k AS (SELECT s_suppkey AS k FROM supplier), r AS (SELECT context_id, unnest(s.bad) AS b FROM f WHERE context_id IN (SELECT k FROM k)) SELECT context_id, b.seq AS seq, b.op AS op, b.error AS error FROM r UNION ALL SELECT context_id, seq, op, 'ContextNotFound' FROM e WHERE context_id NOT IN (SELECT k FROM k)",
        "engine_terms": f"WITH {_FOLD}, g AS (SELECT lower(c_mktsegment) AS term, (c_nationkey + 100)::BIGINT AS c FROM customer UNION SELECT unnest(s.done), context_id + 1000 FROM f WHERE context_id IN (SELECT c_custkey FROM customer)) SELECT term, array_to_string(list_sort(list(c)), ',') AS contexts FROM g GROUP BY 1",
        "engine_has_term": f"WITH {_FOLD}, {_Q}, g AS (SELECT lower(c_mktsegment) AS t FROM customer UNION SELECT unnest(s.done) FROM f WHERE context_id IN (SELECT c_custkey FROM customer)), a AS (SELECT query AS term FROM q UNION SELECT lower(c_mktsegment) FROM customer) SELECT term, term IN (SELECT t FROM g) AS found FROM a",
        "scope_remove": f"WITH RECURSIVE {_S} SELECT context_id, parent_id FROM s WHERE context_id NOT IN (SELECT context_id FROM z WHERE visible_id = 2)",
        "scope_depth": f"WITH RECURSIVE {_S} SELECT context_id, max(depth) AS depth FROM z GROUP BY 1",
        "scope_descendants": f"WITH RECURSIVE {_S} SELECT s.context_id, s.context_id % 5 AS ancestor_id, EXISTS (SELECT 1 FROM z WHERE z.context_id = s.context_id AND z.visible_id = s.context_id % 5 AND depth > 0) AS is_descendant FROM s",
        "restricted_diacritics": f"WITH {_V}, {_Q}, r AS (SELECT DISTINCT translate(query, 'äçèéêíñóöüß', 'aceeeinoous') AS query FROM q) SELECT query, term, 0 AS distance FROM r JOIN v ON length(query) = length(term) AND left(translate(term, 'äçèéêíñóöüß', 'aceeeinoous'), 2) = left(query, 2) WHERE len(list_filter(range(1, length(term) + 1), lambda i: substr(term, i, 1) <> substr(query, i, 1) AND NOT list_contains({_pair_list(DIACRITICS_LATIN)}, substr(term, i, 1) || substr(query, i, 1)))) = 0",
        "restricted_keyboard": f"""WITH {_V}, {_Q}, r AS (SELECT DISTINCT translate(eq, 'ert', 'rty') AS eq, translate(query, 'ert', 'rty') AS query FROM q),
  c AS (SELECT query, term, eq, et, length(eq) AS a, length(et) AS b FROM r JOIN v ON abs(length(eq) - length(et)) <= 1 AND (length(eq) < 3 OR length(et) < 3 OR {_alike('1', '1')} OR {_alike('length(et)', 'length(eq)')})),
  m AS (SELECT query, term, a, b, list_transform(range(1, least(a, b) + 1), lambda i: {_alike('i', 'i')}) AS p, list_transform(range(0, least(a, b)), lambda i: {_alike('b - i', 'a - i')}) AS s FROM c),
  x AS (SELECT query, term, a, b, coalesce(nullif(list_position(p, FALSE), 0) - 1, len(p)) AS p, coalesce(nullif(list_position(s, FALSE), 0) - 1, len(s)) AS s FROM m)
  SELECT query, term, CASE WHEN a = b AND p = a THEN 0 ELSE 1 END AS distance FROM x WHERE p + s >= CASE WHEN a = b THEN a - 1 ELSE least(a, b) END""",
        "query_builder": f"WITH {_near(1, 'value >= 2')} SELECT query, term, distance FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, term) <= 2",
        "large_distance": "SELECT DISTINCT a.n_name AS query, t.term, levenshtein(a.n_name, t.term) AS distance FROM nation a, (SELECT c_mktsegment AS term FROM customer UNION SELECT n_name FROM nation) t",
        "udtf_search": f"WITH {_V} SELECT term, levenshtein('house', et) AS distance FROM v WHERE levenshtein('house', et) <= 2",
        "generated_typos": f"WITH {_Q}, d AS (SELECT query AS term, unnest([1, 2, 3]) AS draw FROM q), a AS (SELECT term, draw, {_edited('term')} AS e FROM d), b AS (SELECT term, draw, e[{_draw('7', 'term', 'draw', '0')} % len(e) + 1] AS w FROM a), c AS (SELECT term, draw, {_edited('w')} AS e FROM b) SELECT term, draw, e[{_draw('7', 'term', 'draw', '1')} % len(e) + 1] AS typo FROM c",
        "generated_workload": f"WITH {_V}, w AS (SELECT term, value, sum(value) OVER (ORDER BY term) AS upto FROM v), x AS (SELECT range AS draw, (({_draw('7', 'range')} * 65536 + {_draw('8', 'range')} % 65536) % (SELECT sum(value) FROM v))::BIGINT AS point FROM range(1000)) SELECT draw, term FROM x JOIN w ON point >= upto - value AND point < upto",
        "uniform_workload": f"WITH {_Q}, w AS (SELECT query AS term, row_number() OVER (ORDER BY query) - 1 AS k FROM q), x AS (SELECT range AS draw, (({_draw('7', 'range')} * 65536 + {_draw('8', 'range')} % 65536) % (SELECT count(*) FROM q))::BIGINT AS point FROM range(1000)) SELECT draw, term FROM x JOIN w ON point = k",
        "query_list": f"WITH {_V} SELECT term FROM v ORDER BY {_draw('7', 'term')}, term LIMIT 100",
    }
