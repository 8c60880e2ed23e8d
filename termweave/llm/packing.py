"""Best-fit packing with certified bounds: documents into as few sequences of a fixed length as can be.

A document longer than a sequence is cut into full pieces, which are sequences of their own, and a last piece.
The other pieces are dealt into groups by a hash and packed by best-fit decreasing. Dual feasible functions
(u(k), and rounding at several thresholds) turn lengths into weights of which no sequence can hold more than
one; their sums bound from below how many sequences a group, and all pieces together, need. A group that meets
its bound is certified. While the total is above the bound of all, groups with a gap give the documents of their emptiest
sequences, as many as the gap calls for and a few more, to an exchange, and certified groups only the few, as each may have
left a sequence part-filled. What is given is dealt anew into groups of GROUP pieces, one if it is no more, and packed
again; the result replaces the old one if it has fewer sequences. This ends at the bound, or when one group holds all that is
given and gains nothing, or after EXCHANGES. The certificates, of groups and of the whole, are returned.

Cases: null and empty texts are one end id; a text of exactly one sequence is one full piece; repeated rows are
packed each by itself; equal lengths are packed in order of arrival; an empty table gives no rows; other columns
play no part, whatever they are called.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.tokenizing import by_bytes, encoder
from termweave.plans.shared import Cut, ship

#: Pieces in one group, groups at least in the first packing, exchanges at most, and sequences given to an exchange beyond a group's gap.
GROUP, GROUPS, EXCHANGES, SPARE = 20_000, 16, 12, 2
#: Bytes of texts that a worker encodes at once, about; a longer one is encoded alone.
HELD_BYTES = 2 << 20
PIECE = "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long, open boolean, g int, sequences long, bound long"


def weights(capacity: int) -> np.ndarray:
    """A row of weights by length (0 to capacity) for each dual feasible function; a row's unit is its last entry."""
    x = np.arange(capacity + 1)
    rows = [x]
    for k in range(1, 21):  # u(k): multiples of 1 / (k + 1) stay, others are rounded down to multiples of 1 / k
        up = (k + 1) * x
        rows.append(np.where(up % capacity == 0, x * k, (up // capacity) * capacity))
    for e in sorted({max(1, capacity * j // 64) for j in range(1, 33)}):
        rows.append(np.where(x > capacity - e, capacity, np.where(x >= e, x, 0)))
    return np.array(rows, np.int64)


def lower_bound(histogram: np.ndarray) -> int:
    """Sequences that pieces need at least; histogram: pieces by length, from 0 to the capacity."""
    w = weights(len(histogram) - 1)
    return int(max(-(-int(total) // int(unit)) for total, unit in zip(w @ histogram, w[:, -1])))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and what is left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[int] = []
    having: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit r is set if some bin has r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = present >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = having[room].pop()
            if not having[room]:
                present ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(0)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - n
        if room > n:
            having[room - n].append(b)
            present |= 1 << (room - n)
    return bins, offsets, left


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str, end_id: int) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(tokenizer, "<u4"), np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in by_bytes(batch, 1, HELD_BYTES):
                cols: list[list] = [[], [], [], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), words.encode_array(part.column(1)).to_pylist()):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        for c, v in zip(cols, (doc, uid, k, a // 4, len(own) // 4, zlib.crc32(own))):
                            c.append(v)
                        uid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "uid", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, PIECE)


def _pack_groups(items: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        group = table["g"][0].as_py()
        table = table.select(["doc_id", "uid", "piece", "start", "length", "ids_crc32"]).sort_by("uid")
        lengths, uids = table["length"].to_numpy(), table["uid"].to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        names = np.full(len(left), np.iinfo(np.int64).max)
        np.minimum.at(names, bins, uids)
        gap = len(left) - lower_bound(np.bincount(lengths, minlength=capacity + 1))
        give = np.zeros(len(left), bool)
        give[np.argsort(-np.array(left), kind="stable")[: SPARE + 4 * gap]] = True
        give &= np.array(left) > 0
        number = np.full(len(bins), group, np.int32)
        for name, v in (("sequence_id", names[bins]), ("offset", offsets), ("open", give[bins]), ("g", number), ("sequences", np.full(len(bins), len(left))), ("bound", np.full(len(bins), len(left) - gap))):
            table = table.append_column(name, pa.array(v))
        return table

    return items.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(groups)).cast("int")).groupBy("g").applyInArrow(run, PACKED)


@dataclass
class Packing:
    """rows: pieces with their places; groups: (exchange, g, sequences, bound, certified); sequences and bound of all, full pieces included."""

    rows: DataFrame
    groups: DataFrame
    sequences: int
    bound: int

    @property
    def certified(self) -> bool:
        return self.sequences == self.bound


def packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> Packing:
    everything = Cut(pieces(docs, tokenizer, capacity, id_col, text_col, end_id), "pieces").df
    own = everything.columns
    full = everything.where(F.col("length") == capacity).select(*own, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = everything.where(F.col("length") < capacity)
    histogram = np.zeros(capacity + 1, np.int64)
    for n, many in everything.groupBy("length").count().collect():  # at most one row for each length
        histogram[n] = many
    whole, histogram[capacity] = int(histogram[capacity]), 0
    count, bound = int(histogram.sum()), lower_bound(histogram)

    def packed(items: DataFrame, groups: int, salt: int) -> tuple[DataFrame, int]:
        got = Cut(_pack_groups(items, groups, salt, capacity), "packed").df
        certificates.append(got.select(F.lit(salt).alias("exchange"), "g", "sequences", "bound", (F.col("sequences") == F.col("bound")).alias("certified")).distinct())
        return got, int(certificates[-1].agg(F.coalesce(F.sum("sequences"), F.lit(0))).first()[0])

    certificates: list[DataFrame] = []
    placed = lambda df: df.select(*own, "sequence_id", "offset", (F.col("sequences") == F.col("bound")).alias("certified"))
    now, total = packed(rest, max(GROUPS, math.ceil(count / GROUP)), 0)
    done: list[DataFrame] = [full]
    for salt in range(1, EXCHANGES + 1):
        if total <= bound:
            break
        given = now.where("open")
        n, before = given.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        groups = max(1, math.ceil(n / GROUP))
        again, after = packed(given.select(*own), groups, salt)
        if after < before:
            done.append(placed(now.where("not open")))
            now, total = again, total + after - before
        else:
            certificates.pop()
            if groups == 1:
                break
    done.append(placed(now))
    rows, groups_seen = done[0], certificates[0]
    for df in done[1:]:
        rows = rows.unionByName(df)
    for df in certificates[1:]:
        groups_seen = groups_seen.unionByName(df)
    return Packing(rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"), groups_seen, whole + total, whole + bound)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified) of every piece; certified tells whether the group in
    which its sequence was packed met its bound."""
    return packing(docs, tokenizer, capacity, id_col, text_col, end_id).rows


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
