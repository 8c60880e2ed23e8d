"""Exact top-k inner products by block-at-a-time pruning.

Vectors are integers, floor(scale * x) by component. Rows are dealt into document-range blocks: groups by the
signs of a few fixed directions, so that a block holds like vectors, and within a group ranges of ids of bounded
size. A block's forward index is its matrix; its term maxima are the largest positive and the largest negative value in each
component, and their sum with a query's weights bounds every score in the block.

Queries come in chunks of bounded size, which are broadcast. A first pass scores each query against sampled blocks
of its highest bounds to get a threshold no candidate list may fall under; the second gives each task its blocks, orders them per query
by bound, and scores through the forward indexes until the bound falls below the query's kth best score. Each task
returns k rows a query at most, and a window picks the best of those.

Cases: null vectors and those with a null or non-finite component take no part, nor do empty ones and ones of another
length than the query's; ties go to the smaller id; a query id that is repeated is one query, by its smallest vector (component by component)
where they differ, and all rows of that id are left out of its candidates; rows that repeat another id
are candidates each by itself; null ids take no part; with fewer candidates all are returned; vectors so large that a score might not fit 62 bits raise
a ValueError; an empty table gives no rows; other columns play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.plans.shared import Cut, fresh_path, ship

#: Rows of a block, queries of a chunk, directions that group vectors, and blocks a query's first pass scores.
BLOCK, CHUNK, DIRECTIONS, FIRST = 256, 8192, 4, 1
#: Below any score, and with a negative that fits.
NONE = -(1 << 62)
#: Scores that floating-point products give exactly.
EXACT = 1 << 53


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with integer components; exact, as a double times a power of two is."""
    x = F.col(vector_col).cast("array<double>")
    fit = F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(fit).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _directions(width: int) -> np.ndarray:
    """Fixed signs by a rule (bits of multiples of an odd constant), as columns."""
    at = np.arange(1, width + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) >> np.arange(20, 20 + DIRECTIONS, dtype=np.uint64)[None, :]
    return np.where(at & np.uint64(1), 1, -1).astype(np.int64)


def build_blocks(vectors: DataFrame) -> DataFrame:
    """(ids, width, cells): forward indexes, one row a block, with ids ascending; a task buffers one open block a group."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def emit(key: tuple[int, int]) -> pa.RecordBatch:
            got = held.pop(key)
            ids, m = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_arrays([pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([key[0]], pa.int32()), pa.array([m[order].astype("<i8").tobytes()], pa.binary())], names=["ids", "width", "cells"])

        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for width in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == width))
                ids, m = part.column(0).to_numpy(), _matrix(part.column(1)).astype(np.int64)
                group = ((m @ _directions(width) > 0) << np.arange(DIRECTIONS)).sum(axis=1)
                for g in np.unique(group).tolist():
                    rows = np.flatnonzero(group == g)
                    for at in range(0, len(rows), BLOCK):
                        own = rows[at : at + BLOCK]
                        held.setdefault((width, g), []).append((ids[own], m[own]))
                        if sum(len(x[0]) for x in held[width, g]) >= BLOCK:
                            yield emit((width, g))
        for key in list(held):
            yield emit(key)

    return vectors.repartitionByRange("id").mapInArrow(run, "ids binary, width int, cells binary")


class _Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.scores = np.full((count, k), NONE)
        self.ids = np.full((count, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate((self.scores[rows], scores), axis=1)
        i = np.concatenate((self.ids[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        i[:, self.k :][scores == NONE] = np.iinfo(np.int64).max
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def scan(blocks: list[tuple[np.ndarray, np.ndarray]], query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray, most: int | None = None) -> tuple[_Best, int]:
    """Best of these blocks of one width for these queries, and how many block scorings it took.

    A query leaves a block out if the bound is below its floor or its own kth score. With most, each query
    scores only so many blocks, those of its highest bounds.
    """
    best = _Best(len(query_ids), k)
    if not blocks:
        return best, 0
    most_score = max(int(np.abs(m).max()) for _, m in blocks) * max(1, int(np.abs(queries).max())) * queries.shape[1]
    if most_score < EXACT:  # products of matrices of doubles are exact then, and many times faster
        queries, blocks = queries.astype(float), [(ids, m.astype(float)) for ids, m in blocks]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = np.stack([up @ m.max(axis=0) + down @ m.min(axis=0) for _, m in blocks], axis=1)
    order, scored = np.argsort(-bounds, axis=1, kind="stable"), 0
    for turn in range(len(blocks) if most is None else min(most, len(blocks))):
        at = order[:, turn]
        bound = bounds[np.arange(len(at)), at]
        live = (bound >= floor) & (bound >= best.scores[:, -1])
        if not live.any():
            break
        for b in np.unique(at[live]).tolist():
            rows = np.flatnonzero(live & (at == b))
            ids, m = blocks[b]
            scores = (queries[rows] @ m.T).astype(np.int64)
            scores[query_ids[rows][:, None] == ids[None, :]] = NONE
            best.add(rows, scores, ids)
            scored += len(rows)
    return best, scored


def _read(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, w, cells in zip(*(batch.column(c).to_pylist() for c in ("ids", "width", "cells"))):
            if w == width:
                yield np.frombuffer(ids, "<i8"), np.frombuffer(cells, "<i8").reshape(-1, w)


def _groups(blocks: Iterator, size: int = 512) -> Iterator[list]:
    held: list = []
    for b in blocks:
        held.append(b)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _chunk_best(blocks: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((query_ids, queries))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        kth = np.full(len(ids), NONE)
        for group in _groups(_read(batches, q.shape[1])):
            best, _ = scan(group, ids, q, k, np.full(len(ids), NONE), FIRST)
            kth = np.maximum(kth, best.scores[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int32()), pa.array(kth)], names=["q", "kth"])

    # a task's kth best is no more than the kth best of all, so the largest of them is a floor
    floor = np.full(len(query_ids), NONE)
    for q, kth in blocks.mapInArrow(seeds, "q int, kth long").groupBy("q").agg(F.max("kth")).collect():  # one row a query of the chunk
        floor[q] = kth
    floors = spark.sparkContext.broadcast(floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        floor = floors.value.copy()
        total = _Best(len(ids), k)
        for group in _groups(_read(batches, q.shape[1])):
            best, _ = scan(group, ids, q, k, floor)
            total.add(np.arange(len(ids)), best.scores, best.ids)
            floor = np.maximum(floor, total.scores[:, -1])
        keep = (total.scores > NONE) & (total.scores >= floors.value[:, None])
        rows, _ = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(total.ids[keep]), pa.array(total.scores[keep])], names=["query_id", "vec_id", "score"])

    return blocks.mapInArrow(run, "query_id long, vec_id long, score long")


def _check_range(vectors: DataFrame, asked: DataFrame) -> None:
    """Raise where a score may overflow; components beyond 62 bits are already saturated and so are found, too."""
    largest = lambda df: df.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.max(F.size("v"))).first()
    (a, width), (b, _) = largest(vectors.select(F.transform("v", lambda c: F.greatest(c, F.lit(-(1 << 62)))).alias("v"))), largest(asked.select(F.transform("v", lambda c: F.greatest(c, F.lit(-(1 << 62)))).alias("v")))
    if a and b and a * b * width >= 1 << 62:
        raise ValueError("vectors are too large for integer scores")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of rows for each row of queries."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vector_col, scale)
    blocks = Cut(build_blocks(vectors), "blocks").df
    single = integer_vectors(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    asked = Cut(single.withColumn("width", F.size("v")), "queries").df
    _check_range(vectors, asked)
    path, wrote = fresh_path(spark, "best"), False
    for (width, chunk), ids, cells in _chunks(asked):
        del chunk
        got = _chunk_best(blocks.where(F.col("width") == width), ids, cells, k)
        got.write.mode("append" if wrote else "overwrite").parquet(path)
        wrote = True
    if not wrote:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _chunks(asked: DataFrame) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """Queries of one width, CHUNK at most at a time, as arrays; only one chunk is on the driver."""
    sizes = {w: n for w, n in asked.groupBy("width").count().collect()}
    for width, n in sorted(sizes.items()):
        parts = -(-n // CHUNK)
        for part in range(parts):
            own = asked.where((F.col("width") == width) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).select("id", "v").toArrow()
            for at in range(0, len(own), 2 * CHUNK):
                piece = own.slice(at, 2 * CHUNK).combine_chunks()
                cells = piece["v"].combine_chunks() if isinstance(piece["v"], pa.ChunkedArray) else piece["v"]
                yield (width, part), piece["id"].to_numpy(), _matrix(cells).astype(np.int64)


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, rows.where("vec_id % 100 = 0"))
