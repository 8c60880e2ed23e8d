"""Near duplicates by exact Jaccard similarity of word shingles; SimHash and MinHash only find the pairs to be compared.

A text is cut into words as in ``simhash``; its set is that of the XXH64 of every run of ``words`` words. Texts of equal
sets are one node. Two nodes are linked if and only if their sets have Jaccard similarity ``least`` or more, and rows that
links join, directly or not, form a group. Nodes are compared that the covering search of ``simhash`` links, as their fingerprints differ in
RADIUS bits at most: that finds near copies, and few of the pairs near similarity 0.8. For the rest, nodes that share one of BANDS keys of ROWS minima each are compared: at similarity
0.8 a pair shares none with probability (1 - 0.8^6)^40 = 0.000005, above it with less; pairs of
similarity 0.2, which share a passage and no more, meet in one case of 400.

The smallest node of a bucket is compared with all others of it. Where that leaves the rest of a bucket in several
components, the rest is compared in full, by an index from shingles to members, in groups of about BLOCK shingles.

What is shuffled: the keys once, to be counted; after that only rows that a ``Sieve`` of the repeated keys, the
compared nodes or the dropped rows lets through. Whole texts are shuffled only where they may be dropped or repeated.

Cases: null and empty texts, and texts of white space only, have the empty set, which is one node without links; a text of
fewer words than a shingle is one shingle; repeated rows stay repeated in ``near_duplicates`` and become one in ``survivors``;
null ids are kept but never name a group unless all ids of it are null; rows that share an id are told apart by
their texts; an empty table gives no rows; columns other than id and text play no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm import simhash
from termweave.llm.sieve import Sieve
from termweave.llm.simhash import SEED, shingle_hashes
from termweave.plans.components import components
from termweave.plans.shared import Cut, release, ship

#: Bits by which the fingerprints of nodes differ that the covering search links.
RADIUS = 4
BANDS, ROWS = 40, 6
#: Shingles of the members that a task compares with each other at once, about.
BLOCK = 1 << 20
#: Odd factors of 32 bits, one for each minimum: the first half for the lower halves of hashes, the others for the upper ones.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 31, (2, BANDS * ROWS // 2), np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", words, SEED))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band, as signed 64-bit integers; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(FACTORS.shape, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 512):  # bounded memory for very long texts
        part = hashes[at : at + 512]
        for k, half in enumerate((part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32))):
            least[k] = np.minimum(least[k], np.multiply.outer(FACTORS[k], half).min(axis=1))
    # a band has minima of both halves
    return [_signed(xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least.T.reshape(BANDS, ROWS))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _row_key(id_col: str, text_col: str) -> Column:
    """Tells rows of other ids or texts apart."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, u, t)"""
    return docs.select(F.col(id_col).cast("long").alias("id"), _row_key(id_col, text_col).alias("u"), F.col(text_col).cast("string").cast("binary").alias("t"))


def _marks(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, u, node, size, fp, keys) per row."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text, words)
                nodes.append(_signed(xxh64_intdigest(hashes.tobytes(), SEED)))
                sizes.append(len(hashes))
                prints.append(simhash.fold(hashes))
                keys.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "u", "node", "size", "fp", "keys"])

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, u long, node long, size long, fp long, keys array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, s): the set of each wanted (w, node); w is the u of a row that has it. Sets are shuffled, not texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(text, words).view(np.int64) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["u", "s"])

    rows, _ = Sieve(wanted, "w").split(_source(docs, id_col, text_col).select("u", "t"), F.col("u"))
    found = rows.mapInArrow(run, "u long, s array<long>")
    return found.join(wanted.hint("merge"), F.col("u") == F.col("w")).dropDuplicates(["u"]).select("node", "s")


def _alike(a: Column, b: Column, least: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both) >= F.lit(least)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of similarity ``least`` or more."""
    left = sets.select(F.col("node").alias("a_node"), F.col("s").alias("a_s")).hint("merge")
    right = sets.select(F.col("node").alias("b_node"), F.col("s").alias("b_s")).hint("merge")
    both = pairs.join(right, F.col("b") == F.col("b_node")).join(left, F.col("a") == F.col("a_node"))
    return both.where(_alike(F.col("a_s"), F.col("b_s"), least)).select("a", "b")


def link_members(sets: list[np.ndarray], roots: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between members of other roots: enough of them to join all that links join."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(codes))))
    at = np.concatenate(([0], np.cumsum(sizes)))
    _, label, many = np.unique(roots, return_inverse=True, return_counts=True)
    links: list[tuple[int, int]] = []
    for x in np.flatnonzero(label != many.argmax()).tolist():  # a link has an end outside of the largest component
        mine = codes[at[x] : at[x + 1]]
        lengths = begin[mine + 1] - begin[mine]
        places = np.repeat(begin[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owners[places], minlength=len(sets))
        for y in np.flatnonzero(shared / (sizes[x] + sizes - shared) >= least).tolist():
            if label[y] != label[x]:
                links.append((x, y))
                label[label == label[y]] = label[x]
    return links


def _rest(members: DataFrame, sets: DataFrame, sizes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members (bucket, node) of one bucket that are not in one component of found (node, root)."""
    joined = found.select(F.col("node").alias("f"), "root")
    tagged = Cut(members.join(joined.hint("merge"), F.col("node") == F.col("f"), "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "tagged").df
    mark = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    split = tagged.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"), *mark).where("x <> y")
    once = split.groupBy("n", "mark1", "mark2").agg(F.min("bucket").alias("b"))  # of buckets of the same members one
    chosen = tagged.join(once.select("b").hint("merge"), F.col("bucket") == F.col("b")).select("bucket", "node", "root")
    held = Cut(chosen.join(sizes.select(F.col("node").alias("s_node"), "size").hint("merge"), F.col("node") == F.col("s_node")).select("bucket", "node", "root", "size"), "rest").df
    blocks = held.groupBy(F.col("bucket").alias("b")).agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("k"))
    dealt = held.join(blocks, F.col("bucket") == F.col("b")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    spread = dealt.select("bucket", "node", "root", "mine", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    keyed = spread.select("bucket", "node", "root", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    filled = keyed.join(sets.withColumnRenamed("node", "s_node").hint("merge"), F.col("node") == F.col("s_node")).select("bucket", "x", "y", "node", "root", "s")

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        lists = table["s"].combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        got = link_members([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], table["root"].to_numpy(), least)
        return pa.table({"a": pa.array([nodes[i] for i, _ in got], pa.int64()), "b": pa.array([nodes[j] for _, j in got], pa.int64())})

    return filled.groupBy("bucket", "x", "y").applyInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Marks (id, u, node, ...) of all rows, and (n_node, component, best_u) of all nodes; best_u is the row that stands for the group.

    Joins are merge joins at any size, so that what is shuffled grows as the input does. All tables but the two are deleted at the end.
    """
    ship(docs.sparkSession)
    held: list[Cut] = []

    def cut(df: DataFrame, what: str) -> DataFrame:
        held.append(Cut(df, what))
        release(docs.sparkSession)
        return held[-1].df

    marks = Cut(_marks(docs, id_col, text_col, words), "marks").df
    best = F.struct(F.col("id").isNull().alias("none"), "id", "u")  # the smallest id, null last
    nodes = cut(marks.groupBy("node").agg(F.min(best).alias("first"), F.min("u").alias("w"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    buckets = cut(dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1"), "buckets")
    large = cut(buckets.where("n > 2").select(F.col("key").alias("bucket"), "lo"), "large")
    again, _ = Sieve(large, "bucket").split(dealt, F.col("key"))
    members = cut(again.join(large.hint("merge"), F.col("key") == F.col("bucket")).where("node <> lo").select("bucket", "lo", "node"), "members")
    near = simhash.links(nodes.where("size > 0").select("node", "fp"), RADIUS, 1, None, cut).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(near.unionByName(buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))).unionByName(members.select(F.col("lo").alias("a"), F.col("node").alias("b"))).distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("end")).unionByName(pairs.select(F.col("b").alias("end"))).distinct()
    wanted = cut(nodes.select("node", "w").join(ends.hint("merge"), F.col("node") == F.col("end"), "left_semi"), "wanted")
    sets = cut(_sets(docs, id_col, text_col, words, wanted), "sets")
    links = cut(_verified(pairs, sets, least), "links")
    found = cut(components(links, "a", "b"), "found")
    more = cut(_rest(members.select("bucket", "node"), sets, nodes.select("node", "size"), found, least), "more")
    if more.limit(1).count():
        found = components(links.unionByName(more), "a", "b")
    joined = nodes.select("node", "first").join(found.withColumnRenamed("node", "f"), F.col("node") == F.col("f")).select("root", "first", "node")
    lowest = joined.groupBy("root").agg(F.min("first").alias("to"))
    moved = cut(joined.join(lowest, "root").select(F.col("node").alias("m"), "to"), "moved")
    named = nodes.select("node", "first").join(moved, F.col("node") == F.col("m"), "left").withColumn("to", F.coalesce("to", "first"))
    out = Cut(named.select(F.col("node").alias("n_node"), F.col("to.id").alias("component"), F.col("to.u").alias("best_u")), "named").df
    for table in held:
        table.drop()
    return marks, out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(id, node, component) per row of docs; component is the smallest id of the row's group."""
    marks, named = _grouped(docs, id_col, text_col, words, least)
    return marks.select("id", "node").join(named.hint("merge"), F.col("node") == F.col("n_node")).select("id", "node", "component")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of docs for each group, with all its columns: that of the smallest id (null last), and of the smallest text hash
    where several rows have that id.

    Rows that are neither dropped nor repeated are passed on where they stand; only the others meet in a shuffle.
    """
    marks, named = _grouped(docs, id_col, text_col, words, least)
    rows = marks.select("u", "node").join(named.hint("merge"), F.col("node") == F.col("n_node"))
    gone = rows.where("u <> best_u").select(F.col("u").alias("__g"), F.lit(True).alias("__drop"))
    twice = marks.groupBy(F.col("u").alias("__g")).agg(F.count("*").alias("n")).where("n > 1").select("__g", F.lit(False).alias("__drop"))
    touched = Cut(gone.unionByName(twice), "touched").df
    held = docs.withColumn("__u", _row_key(id_col, text_col))
    hit, clear = Sieve(touched, "__g").split(held, F.col("__u"))
    once = hit.dropDuplicates(["__u"]).join(touched.where("__drop").select("__g").hint("merge"), F.col("__u") == F.col("__g"), "left_anti")
    return clear.unionByName(once).drop("__u")
