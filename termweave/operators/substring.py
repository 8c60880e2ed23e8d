"""Substring search over documents: all exact occurrences, all approximate ones, and collections of documents.

Needles are dealt into blocks of a bounded number of characters. Each block is sent to all tasks, which build one
Aho-Corasick automaton from it and read every text once; texts are never shuffled, and only matches leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.operators.join import _numbers
from termweave.plans.shared import Cut, ship

#: Characters of the needles in a block, about, that are collected and sent at once.
SENT_MOST = 4_000_000


def _automaton(words):
    import ahocorasick

    out = ahocorasick.Automaton()
    for w, tag in words:
        out.add_word(w, tag)
    out.make_automaton()
    return out


def _blocks(sought: DataFrame, col: str) -> Iterator[list[str]]:
    """The distinct texts of a column in blocks of bounded size."""
    held = Cut(sought, "needles").df
    size = held.agg(F.coalesce(F.sum(F.length(col)), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // SENT_MOST))
    for b in range(blocks):
        yield [r[0] for r in held.where(F.pmod(F.xxhash64(col), F.lit(blocks)) == b).select(col).collect()]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("x")).where(F.col("x").isNotNull())


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def occurrences(docs: DataFrame, needles: DataFrame, id_col: str = "doc_id", text_col: str = "text", needle_col: str = "needle") -> DataFrame:
    """(doc_id, needle, start, end) of every occurrence, overlapping ones too; start counts from 0. Empty needles match nothing."""
    sought = needles.where(F.col(needle_col).isNotNull() & (F.length(needle_col) > 0)).select(F.col(needle_col).alias("needle")).distinct()
    texts = _texts(docs, id_col, text_col)
    kind = dict(texts.dtypes)["doc_id"]
    return _union([_exact(texts, kind, block) for block in _blocks(sought, "needle")])


def _exact(texts: DataFrame, kind: str, block: list[str]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        seek = _automaton((w, w) for w in words) if words else None
        for batch in batches:
            rows, found, ends = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist() if seek else []):
                for end, word in seek.iter(text):
                    rows.append(k)
                    found.append(word)
                    ends.append(end + 1)
            start = [e - len(w) for e, w in zip(ends, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(start, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "needle", "start", "end"])

    return texts.mapInArrow(run, f"doc_id {kind}, needle string, start int, end int")


def contains_substring(docs: DataFrame, needles: DataFrame, **names) -> DataFrame:
    """(needle, found) for each distinct needle: whether it stands in any document; the empty one does if there is a text."""
    column = names.get("needle_col", "needle")
    there = occurrences(docs, needles, **names).select(F.col("needle").alias("n")).distinct()
    some = F.lit(bool(docs.where(F.col(names.get("text_col", "text")).isNotNull()).limit(1).count()))
    asked = needles.select(F.col(column).alias("needle")).where("needle IS NOT NULL").distinct()
    return asked.join(there, F.col("needle") == F.col("n"), "left").select("needle", F.when(F.col("needle") == "", some).otherwise(F.col("n").isNotNull()).alias("found"))


def _pieces(query: str, n: int) -> list[tuple[str, int]]:
    """(segment, offset) of n + 1 segments: within n edits one of them stays as it is."""
    size, over = divmod(len(query), n + 1)
    out, at = [], 0
    for k in range(n + 1):
        end = at + size + (k >= n + 1 - over)
        out.append((query[at:end], at))
        at = end
    return out


def _sought(query: str, n: int) -> Iterator[tuple[str, tuple]]:
    """(segment, (query, back, k, left, right)) of n + 1 segments; back: from the segment's last character to the query's start.

    Some segment k is untouched with k operations on its left at most and n - k on its right. So are the two sides: each has a segment, of those
    for its operations, that stays as it is. left and right: those segments and where they may stand from the query's start; empty if all may.
    """
    for k, (piece, at) in enumerate(_pieces(query, n)):
        end = at + len(piece)
        left, right = query[:at], query[end:]
        yield piece, (
            query, end - 1, k,
            [(p, o + s) for j, (p, o) in enumerate(_pieces(left, k)) for s in range(j - k, k - j + 1)] if len(left) > k else [],
            [(p, end + o + s) for j, (p, o) in enumerate(_pieces(right, n - k)) for s in range(-j, j + 1)] if len(right) > n - k else [],
        )


def _there(text: str, first: int, places: list[tuple[str, int]]) -> bool:
    for p, o in places:
        if first + o >= 0 and text.startswith(p, first + o):
            return True
    return not places


def fuzzy_occurrences(docs: DataFrame, queries: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query") -> DataFrame:
    """(query, doc_id, start, term, distance): substrings within n of a query, wherever they stand.

    An automaton finds the segments of the queries; substrings around a hit are candidates if another segment stands beside it, and are compared natively. Queries
    of n characters or fewer have no segments, and all substrings of their length are candidates.
    """
    q = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).alias("query")).distinct()
    texts = _texts(docs, id_col, text_col)
    kind = dict(texts.dtypes)["doc_id"]
    near = _union([_windows(texts, kind, block, n) for block in _blocks(q, "query")])
    return near.withColumn("distance", F.levenshtein("query", "term", n)).where("distance >= 0").select("query", "doc_id", "start", "term", "distance")


def _windows(texts: DataFrame, kind: str, block: list[str], n: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[str, list[tuple]] = {}
        short = [w for w in sent.value if len(w) <= n]
        for w in sent.value:
            if len(w) > n:
                for piece, rest in _sought(w, n):
                    segments.setdefault(piece, []).append(rest)
        seek = _automaton((p, p) for p in segments) if segments else None
        for batch in batches:
            rows, words, starts, terms = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                spans: set[tuple[str, int, int]] = set()
                for end, piece in seek.iter(text) if seek else ():
                    for word, back, before, left, right in segments[piece]:
                        first = end - back
                        if _there(text, first, right) and _there(text, first, left):
                            last = first + len(word)
                            spans.update((word, a, e - a) for a in range(max(0, first - before), first + before + 1) for e in range(last - n + before, last + n - before + 1) if a < e <= len(text))
                for word in short:
                    spans.update((word, a, size) for size in range(1, len(word) + n + 1) for a in range(len(text) - size + 1))
                for word, a, size in spans:
                    rows.append(k)
                    words.append(word)
                    starts.append(a)
                    terms.append(text[a : a + size])
                if len(rows) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(terms, pa.string())], names=["query", "doc_id", "start", "term"])
                    rows, words, starts, terms = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(terms, pa.string())], names=["query", "doc_id", "start", "term"])

    return texts.mapInArrow(run, f"query string, doc_id {kind}, start int, term string")


def fuzzy_occurrences_open(docs: DataFrame, queries: DataFrame, n: int, **names) -> DataFrame:
    """The wider reading, in which the rest of the query or of the substring is free: min over prefixes of either side."""
    from termweave.functions.distance import prefix_distance

    q = queries.select("query").distinct()
    prefixes = q.select("query", F.explode(_numbers(F.lit(0), F.length("query"))).alias("k")).select("query", F.expr("substring(query, 1, k)").alias("part"))
    got = fuzzy_occurrences(docs, prefixes.where("part <> ''").select(F.col("part").alias("query")), n, **names).withColumnRenamed("query", "part")
    mine = got.join(prefixes, "part").groupBy("query", "doc_id", "start", "term").agg(F.min("distance").alias("distance"))
    return mine.withColumn("distance", F.least(F.col("distance"), F.coalesce(prefix_distance(F.col("query"), F.col("term"), n), F.col("distance"))))


def insert_documents(docs: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with those of new whose id it lacks; an id that is there keeps its text."""
    mine = docs.select(F.col(id_col).alias("__id")).distinct()
    return docs.unionByName(new.dropDuplicates([id_col]).join(mine, F.col(id_col) == F.col("__id"), "left_anti").select(*docs.columns))


def remove_documents(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.join(gone.select(F.col(id_col).alias("__id")).distinct(), F.col(id_col) == F.col("__id"), "left_anti")


def clear(docs: DataFrame) -> DataFrame:
    """No documents (or terms), with the same columns."""
    return docs.limit(0)


def source_texts(matches: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the documents that matches name, each once."""
    ids = matches.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, F.col(id_col) == F.col("__id"), "left_semi").select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
