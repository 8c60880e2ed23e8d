"""SimHash near-duplicate detection by covering locality-sensitive hashing.

A text is lower-cased (A-Z only) and cut at ASCII white space into words; every run of ``words`` words
(repeats included) votes with its XXH64. Fingerprints within ``radius`` bits are linked, and documents
that links join, directly or not, form a group.

Candidate search is exact, and its keys keep about half of the 64 bits, so that chance meetings stay rare as documents
grow in number. The bits are dealt into ``parts`` parts; a pair within the radius differs
in at most r = radius // parts bits of some part. Bit i of a part has a vector m(i) in {0,1}^(r+1), and for
each v <> 0 one mask keeps the bits with <m(i), v> odd. At most r differing bits leave some v orthogonal
to all their vectors, so that mask drops them all and the pair agrees on the rest: no pair is missed.

Cases: null and empty texts, and texts of white space only, have fingerprint zero, which links like any
other; equal texts have equal fingerprints and one entry in the search; repeated rows stay repeated;
null ids are kept in the result but never name a group unless all ids of it are null; an empty table
gives no rows; columns other than id and text play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.plans.components import components
from termweave.plans.shared import Cut, cut, ship

SEED = 42
#: Words of the shingles that candidates are searched by where similarity is decided by longer ones: an edit touches fewer of them.
CANDIDATE_WORDS = 2
#: A bucket with more fingerprints than this is not compared pairwise but through midpoints.
PAIRWISE_MOST = 8192


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(parts))
    return np.array([xxh64_intdigest(flat[s:e], seed) for s, e in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """Bit set if it is set in over half of the hashes, as a signed 64-bit integer."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprint(text: bytes | None, words: int = 4, seed: int = SEED) -> int:
    return fold(shingle_hashes(text or b"", words, seed))


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for each hash, as of another seed (a finalizer of multiplications and shifts)."""
    with np.errstate(over="ignore"):
        x = hashes ^ (hashes >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def four_fingerprints(text: bytes | None, words: int) -> tuple[int, int, int, int]:
    """Two of shingles of ``words`` words, two of CANDIDATE_WORDS."""
    long, short = shingle_hashes(text or b"", words, SEED), shingle_hashes(text or b"", CANDIDATE_WORDS, SEED)
    return fold(long), fold(mixed(long)), fold(short), fold(mixed(short))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, confirm: bool) -> DataFrame:
    """(id, fp) per row, or with confirm (id, fp, fp2, c, c2): two fingerprints that decide and two for candidates."""
    ship(docs.sparkSession)
    prints = ["fp", "fp2", "c", "c2"] if confirm else ["fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [four_fingerprints(x, words) for x in texts] if confirm else [(fingerprint(x, words),) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(len(prints))]], names=["id", *prints])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return source.mapInArrow(run, "id long, " + ", ".join(f"{p} long" for p in prints))


def covering_masks(radius: int, parts: int = 1) -> list[int]:
    """Masks (unsigned) of which one at least drops all the differing bits of any pair within the radius."""
    r, masks = radius // parts, []
    for part in range(parts):
        bits = range(64 * part // parts, 64 * (part + 1) // parts)
        vector = {b: k % (2 ** (r + 1) - 1) + 1 for k, b in enumerate(bits)}
        masks += [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, 2 ** (r + 1))]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _apart(members: dict[str, np.ndarray], a: int, others: np.ndarray, name: str) -> np.ndarray:
    return np.bitwise_count(members[name][others] ^ members[name][a]).astype(np.int16)


def _forest(members: dict[str, np.ndarray], radius: int, both: int | None) -> list[tuple[int, int]]:
    """Edges that join the members of one bucket as their links do: one for each member but a root of each group."""
    edges: list[tuple[int, int]] = []
    free = np.arange(len(members["fp"]))
    while len(free):
        root, free = free[0], free[1:]
        front = [root]
        while front and len(free):
            at = front.pop()
            if both is None:
                ok = _apart(members, at, free, "fp") <= radius
            else:
                ok = (_apart(members, at, free, "c") <= radius) | (_apart(members, at, free, "c2") <= radius)
                ok &= _apart(members, at, free, "fp") + _apart(members, at, free, "fp2") <= both
            got = free[ok]
            free = free[~ok]
            edges += [(int(root), int(k)) for k in got]
            front += got.tolist()
    return edges


def _compare(groups: DataFrame, radius: int, both: int | None) -> DataFrame:
    """Edges (a, b) of the forests of groups (g: members of one bucket)."""
    ship(groups.sparkSession)
    prints = ["fp"] if both is None else ["fp", "fp2", "c", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values
            nodes = flat.field("node").to_numpy(zero_copy_only=False)
            columns = {p: flat.field(p).to_numpy(zero_copy_only=False).view(np.uint64) for p in prints}
            a, b = [], []
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                for i, j in _forest({p: x[start:end] for p, x in columns.items()}, radius, both):
                    a.append(nodes[start + i])
                    b.append(nodes[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("g").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int, parts: int, both: int | None, held: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """Edges (a, b) between rows of nodes (node, fp[, fp2, c, c2]) that connect what links connect.

    A first pass counts buckets, with sums made before the shuffle. Rows of buckets with more than one row come
    together in a second; up to PAIRWISE_MOST they are compared in numpy, and only a spanning forest leaves the task.
    Fingerprints of still larger buckets are exploded to every midpoint within half the radius: two of them are linked if they
    share one, and a midpoint has a bounded number of distinct fingerprints around it, so no group is ever unbounded. held writes a table.
    """
    cols = ["node", "fp"] if both is None else ["node", "fp", "fp2", "c", "c2"]
    masks = [(c, _signed(m)) for c in (["fp"] if both is None else ["c", "c2"]) for m in covering_masks(radius, parts)]
    keys = F.array(*[F.xxhash64(F.lit(k), F.col(c).bitwiseAND(F.lit(m))) for k, (c, m) in enumerate(masks)])
    dealt = nodes.select(*cols, F.explode(keys).alias("key"))
    buckets = held(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("bucket"), "n"), "buckets")
    me = F.struct(*cols)
    few = dealt.join(buckets.where(f"n <= {PAIRWISE_MOST}"), F.col("key") == F.col("bucket")).groupBy("key").agg(F.collect_list(me).alias("g"))
    edges = _compare(few, radius, both)
    large = buckets.where(f"n > {PAIRWISE_MOST}")
    if large.limit(1).count():
        edges = edges.unionByName(_of_large(dealt, large, cols, radius, both))
    return edges.distinct()


def _of_large(dealt: DataFrame, large: DataFrame, cols: list[str], radius: int, both: int | None) -> DataFrame:
    """Links inside buckets of any size. Two fingerprints within the radius have a common point at half of it or less."""
    half = (radius + 1) // 2
    if half > 2 or both is not None:
        return _by_blocks(dealt, large, cols, radius, both)
    many = dealt.join(large, F.col("key") == F.col("bucket")).select(*cols).distinct()
    flips = [0] + [1 << i for i in range(64)] + ([(1 << i) | (1 << j) for i in range(64) for j in range(i)] if half > 1 else [])
    around = F.explode(F.transform(F.array(*[F.lit(_signed(f)) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f)))
    points = many.select("node", "fp", around.alias("p"))
    if radius % 2:  # a point at half of an odd radius is common to pairs one bit too far, too: groups around it are compared
        return _compare(points.groupBy("p").agg(F.collect_list(F.struct("node", "fp")).alias("g")).where("size(g) > 1"), radius, None)
    hubs = points.groupBy("p").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return points.join(hubs, "p").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _by_blocks(dealt: DataFrame, large: DataFrame, cols: list[str], radius: int, both: int | None) -> DataFrame:
    """For wide radii: members of a large bucket are dealt into blocks by a hash, and each pair of blocks is
    compared by itself, so that every group has a bounded number of members; only forests leave the tasks."""
    sized = large.select("bucket", F.ceil(F.col("n") / max(1, PAIRWISE_MOST // 4)).cast("int").alias("k"))
    got = dealt.join(sized, F.col("key") == F.col("bucket")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    spread = got.select(*cols, "key", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    keyed = spread.groupBy("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).agg(F.collect_list(F.struct(*cols)).alias("g"))
    return _compare(keyed, radius, both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, parts: int = 1, both: int | None = None) -> DataFrame:
    """(id, fp, component) per row of docs; component is the smallest id of the row's group.

    Without ``both`` a pair is linked if and only if its fingerprints differ in at most ``radius`` bits. A similarity of 0.8 cannot be had so:
    bags of shingles of Jaccard similarity 0.8 differ in about
    0.15 of the bits, 19 of 128, and masks that cover all pairs at that radius would be thousands (the pipeline takes ``minhash``). With ``both``, two fingerprints of ``words`` words decide, which together may differ in that many bits; candidates
    are pairs of which one of two fingerprints of CANDIDATE_WORDS words differs in at most ``radius``. Links are between distinct
    fingerprints, so copies never multiply.
    """
    marks = Cut(fingerprints(docs, id_col, text_col, words, both is not None), "fingerprints").df
    prints = ["fp"] if both is None else ["fp", "fp2", "c", "c2"]
    nodes = Cut(marks.groupBy(*prints).agg(F.min("id").alias("first")).withColumn("node", F.col("fp") if both is None else F.xxhash64(*prints)), "nodes").df
    found = components(links(nodes, radius, parts, both), "a", "b")
    joined = nodes.join(found, "node").select("root", "first", "node")
    least = joined.groupBy("root").agg(F.min("first").alias("least"))
    moved = Cut(joined.join(least, "root").select("node", F.col("least").alias("to")), "moved").df
    named = Cut(nodes.join(moved, "node", "left").select(*[F.col(p).alias(f"n_{p}") for p in prints], F.coalesce("to", "first").alias("component")), "named").df
    on = [F.col(p) == F.col(f"n_{p}") for p in prints]
    return marks.join(named, on).select("id", "fp", "component")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = near_duplicates(docs, words=4, radius=4, parts=1, both=None)
    return got.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
