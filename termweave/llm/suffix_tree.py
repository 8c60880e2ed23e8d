"""Language-model scores by a probabilistic suffix tree over words.

Tokens are the words of a text (A-Z lower-cased, cut at ASCII white space) and one end. A context, the words just before a
token, is a candidate if its share of all tokens is at least ``CONTEXT``; it is retained if the distribution
of the next token differs from that of its longest retained suffix by ``DIVERGENCE`` nats or more. The
test is taken on the next tokens whose count in the context is at least ``NEXT`` of all tokens, and on the rest as one event. A retained
context has for those next tokens p = (n + SMOOTHING p') / (N + SMOOTHING), where p' is the suffix's probability, and gives
all others the suffix's probabilities in the mass that is left; the root has (c + 1) / (N + V + 1). So all
distributions sum to one. Scoring takes for each token the longest suffix state of the words before it.

Contexts grow by a word at a time, as long as longer ones are candidates, up to ``DEPTH`` words.

That is the crown of the tree. By its shares it has at most 1 / NEXT frequent words, 1 / CONTEXT contexts and 1 / NEXT entries a
depth, whatever the input, so it is broadcast. Its branches grow with the input and are never gathered: a token's longest candidate of the
crown, with one to ``BRANCH`` older words before it, is a candidate if it was learned ``EVIDENCE`` times or more, in plain numbers; it is retained
by the same test, on the next tokens seen twice or more, and has the same probabilities. There all words that are not frequent
are one next event, whose share is divided among them as at the root, and an older word that is not frequent is known by 31 bits of its hash.
The tokens of one candidate and its next older word come together in one bucket, so each branch is counted, tested and used to score
in one place. No context of a bucket has more than a CONTEXT of all learned tokens, as the crown would hold it.

Counts cover all learned texts: words are counted by a shuffle, and so are the pairs of each depth's candidates and next
tokens. Texts are turned into ids of frequent words once, in a written table that every depth reads; the other words are joined
by a shuffle, and none of them is frequent. To the buckets tokens go in columns, compressed, some bytes each.

Cases: null and empty texts are one end; a row with a null id is held out; repeated rows are learned from and scored each; with
nothing to learn from every token has probability one; an empty table gives no rows; other columns play no part, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.llm.tokenizing import by_bytes
from termweave.plans.shared import Cut, ship

CONTEXT, NEXT, DIVERGENCE, SMOOTHING, DEPTH = 5e-5, 1e-6, 0.02, 8.0, 8
#: Older words before a state of the crown, and how often a context of them must have been learned.
BRANCH, EVIDENCE = 2, 4
#: Tokens that a bucket of branches has, about.
BUCKET = 600_000
#: Stands for a word before the text's start.
NONE = 0x7FFFFFFF
END = b""
#: Words or pairs that a task holds before it passes counts on.
HELD = 400_000
#: Bytes of texts that a task encodes at once, and tokens that it sends to buckets at once, about.
HELD_BYTES, SENT = 1 << 20, 700_000


class Places:
    """Where each of many codes stands in its array; a table of hashed slots, as a search of a sorted array is slow for all tokens."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, (2 * len(codes)).bit_length())
        self.at, self.codes = np.full(1 << self.bits, -1, np.int32), codes
        left, slot = np.arange(len(codes), dtype=np.int32), self._slots(codes)
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several codes for a slot, one stays
            out = self.at[slot] != left
            left, slot = left[out], (slot[out] + 1) & ((1 << self.bits) - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, or -1."""
        slot = self._slots(codes)
        out = self.at[slot]
        going = np.flatnonzero(out >= 0)
        going = going[self.codes[out[going]] != codes[going]]
        while len(going):
            slot[going] = (slot[going] + 1) & ((1 << self.bits) - 1)
            out[going] = self.at[slot[going]]
            going = going[out[going] >= 0]
            going = going[self.codes[out[going]] != codes[going]]
        return out


@dataclass
class Tree:
    """words: frequent words, by id; state 0 is the root. Codes are state * base + word, sorted."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    step_codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    step_to: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(1))
    codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    logs: np.ndarray = field(default_factory=lambda: np.empty(0))
    depths: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    depth: int = DEPTH
    #: The last word of each state's context.
    newest: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int64))
    #: The longest retained suffix of each state.
    own: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @property
    def base(self) -> int:
        """One above the id of a word that is not frequent."""
        return len(self.words) + 1

    def roots(self) -> np.ndarray:
        return np.append(np.log10((self.counts + 1) / (self.total + self.distinct + 1)), 0.0)

    def state(self, ids: np.ndarray, at: np.ndarray, base: int | None = None) -> np.ndarray:
        """Longest suffix state before each place."""
        base = base or self.base
        first = np.zeros(base, np.int64)
        one = slice(0, int(np.searchsorted(self.step_codes, base)))
        first[self.step_codes[one]] = self.step_to[one]
        out = np.where(at >= 1, first[ids[at - 1]], 0)
        going, back = np.flatnonzero(out), 2
        while len(going):
            going = going[at[going] >= back]
            codes = out[going] * base + ids[at[going] - back]
            k = np.minimum(np.searchsorted(self.step_codes, codes), len(self.step_codes) - 1)
            hit = self.step_codes[k] == codes
            going = going[hit]
            out[going] = self.step_to[k[hit]]
            back += 1
        return out

    def log10(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of each word's probability in its state; of words not frequent without the root's part."""
        out, going, s = np.zeros(len(state)), np.arange(len(state)), self.own[state]
        while len(going):
            root = s[going] == 0
            out[going[root]] += self.roots_[word[going[root]]]
            going = going[~root]
            if not len(going):
                break
            codes = s[going] * self.base + word[going]
            k = self.places_.find(codes)
            hit = k >= 0
            out[going[hit]] += self.logs[k[hit]]
            going = going[~hit]
            out[going] += self.rest[s[going]]
            s[going] = self.own[self.parent[s[going]]]
        return out

    def __post_init__(self) -> None:
        self.roots_ = self.roots()
        self.places_ = Places(self.codes)


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(True))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("i"), held_out(F.col(id_col)).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))


def _count_words(learned: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])
            held.clear()
            return got

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(text.lower().split())
                held[END] += 1
                if len(held) > HELD:
                    yield out()
        yield out()

    return learned.select("t").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _ids(texts: list[bytes], known: dict[bytes, int], tree: Tree) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Ids of all texts in a row, each between two ends; the places of tokens; the words by text."""
    end, other = known[END], len(tree.words)
    docs = [t.lower().split() for t in texts]
    flat: list[int] = []
    get = known.get
    for d in docs:
        flat.append(end)
        flat += [get(w, other) for w in d]
        flat.append(end)
    ids = np.array(flat, np.int64)
    sizes = np.array([len(d) + 2 for d in docs])
    starts = np.cumsum(sizes) - sizes
    mask = np.ones(len(ids), bool)
    mask[starts] = False
    return ids, np.flatnonzero(mask), docs


def _encoded(learned: DataFrame, tree: Tree) -> DataFrame:
    """(blob) of some texts' ids, each text between two ends."""
    sent = learned.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        known = {w: i for i, w in enumerate(tree.words)}
        for batch in batches:
            for part in by_bytes(batch, 0, HELD_BYTES):
                ids, _, _ = _ids(part.column(0).to_pylist(), known, tree)
                yield pa.RecordBatch.from_arrays([pa.array([_packed([ids], 0)], pa.binary())], names=["blob"])

    return learned.select("t").mapInArrow(run, "blob binary")


def _count_next(encoded: DataFrame, tree: Tree, wanted: np.ndarray) -> DataFrame:
    """(code, n): how often each frequent word follows each wanted state."""
    sent = encoded.sparkSession.sparkContext.broadcast((replace(tree, words=[], counts=tree.counts[:0]), tree.base, wanted, tree.words.index(END)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, base, wanted, end = sent.value
        before = np.zeros(base, bool)
        before[tree.newest[wanted]] = True
        codes, counts, fresh, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            got, n = np.unique(np.concatenate(fresh) if fresh else np.empty(0, np.int64), return_counts=True)
            both, place = np.unique(np.concatenate((codes, got)), return_inverse=True)
            return both, np.bincount(place, np.concatenate((counts, n)), len(both)).astype(np.int64)

        for batch in batches:
            for blob in batch.column(0):
                ids = _unpacked(blob.as_py(), 1, 0)[0]
                mask = before[ids[:-1]] & (ids[1:] < base - 1)
                mask[np.flatnonzero(ids == end)[1:-1:2]] = False  # from one text's end to the next one's start
                at = np.flatnonzero(mask) + 1
                state = tree.state(ids, at, base)
                keep = wanted[state]
                fresh.append(state[keep] * base + ids[at[keep]])
                size += len(fresh[-1])
                if size > 4 * HELD:
                    codes, counts = merge()
                    fresh, size = [], 0
                    if len(codes) > 4 * HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])
                        codes, counts = codes[:0], counts[:0]
        codes, counts = merge()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["code", "n"])

    return encoded.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def grow(tree: Tree, count: Callable[[Tree, np.ndarray], tuple[np.ndarray, np.ndarray]], depth: int = DEPTH, context: float = CONTEXT, divergence: float = DIVERGENCE, smoothing: float = SMOOTHING) -> Tree:
    """Add the retained contexts depth by depth; count gives the codes and counts that pass NEXT for wanted states."""
    end = tree.words.index(END)
    # candidates of the first depth: frequent enough words, the end standing for a text's start
    step = np.flatnonzero(tree.counts >= context * tree.total)
    codes, sizes = step.astype(np.int64), tree.counts[step]
    last_word = {0: -1}
    for level in range(1, depth + 1):
        if not len(codes):
            break
        first = len(tree.parent)
        new = np.arange(first, first + len(codes))
        for s, c in zip(new.tolist(), codes.tolist()):
            last_word[s] = c % tree.base
        order = np.argsort(all_codes := np.concatenate((tree.step_codes, codes)), kind="stable")
        tree.step_codes, tree.step_to = all_codes[order], np.concatenate((tree.step_to, new))[order]
        tree.parent = np.concatenate((tree.parent, codes // tree.base))
        tree.rest = np.concatenate((tree.rest, np.zeros(len(new))))
        tree.newest = np.concatenate((tree.newest, codes if level == 1 else tree.newest[codes // tree.base]))
        tree.depths = np.concatenate((tree.depths, np.full(len(new), level)))
        wanted = np.zeros(len(tree.parent), bool)
        wanted[new] = True
        got, n = count(tree, wanted)
        state, word = got // tree.base, got % tree.base
        up = 10 ** tree.log10(tree.parent[state], word)
        k, size = state - first, sizes.astype(float)
        p = (n + smoothing * up) / (size[k] + smoothing)
        left = np.maximum(1 - np.bincount(k, p, len(new)), 1e-12)
        left_up = np.maximum(1 - np.bincount(k, up, len(new)), 1e-12)
        apart = np.bincount(k, p * np.log(p / up), len(new)) + left * np.log(left / left_up)
        kept = apart >= divergence
        tree.rest[new[kept]] = np.log10(left / left_up)[kept]
        tree.own = np.concatenate((tree.own, np.where(kept, new, tree.own[tree.parent[new]])))
        use = kept[k]
        order = np.argsort(more := np.concatenate((tree.codes, got[use])), kind="stable")
        tree.codes, tree.logs = more[order], np.concatenate((tree.logs, np.log10(p[use])))[order]
        tree.places_ = Places(tree.codes)
        # a context one word longer is frequent enough only if this one is: x before s ... w follows from counts of w after (x, ...)
        codes, sizes = _longer(tree, got, n, context, level, end, last_word)
    return tree


def _longer(tree: Tree, got: np.ndarray, n: np.ndarray, context: float, level: int, end: int, last_word: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of the next depth: the words of state s, then w, as steps from the state of all but the oldest word."""
    keep = n >= context * tree.total
    codes, sizes = [], []
    for c, m in zip(got[keep].tolist(), n[keep].tolist()):
        s, w = divmod(c, tree.base)
        if w == end:  # nothing follows an end but another text
            continue
        words = [w]  # newest first
        while s:
            words.append(last_word[s])  # the oldest word of s
            s = int(tree.parent[s])
        # words of s come oldest first here; the context is w, then s from its newest word
        path = [w, *words[1:][::-1]]
        at = 0
        for x in path[:-1]:
            code = at * tree.base + x
            k = int(np.searchsorted(tree.step_codes, code))
            if k == len(tree.step_codes) or tree.step_codes[k] != code:
                at = -1
                break
            at = int(tree.step_to[k])
        if at >= 0 and len(path) == level + 1:
            codes.append(at * tree.base + path[-1])
            sizes.append(m)
    return np.array(codes, np.int64), np.array(sizes, np.int64)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, context: float = CONTEXT) -> tuple[Tree, DataFrame]:
    """The tree, and the counts (w, n) of the words that are not frequent."""
    ship(docs.sparkSession)
    learned = _rows(docs, id_col, text_col).where("not held")
    counted = Cut(_count_words(learned), "words").df
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1.0, NEXT * total)
    frequent = sorted(((r.n, bytes(r.w)) for r in counted.where((F.col("n") >= least) | (F.length("w") == 0)).toLocalIterator()), key=lambda r: (-r[0], r[1]))
    if not frequent:
        frequent = [(0, END)]
    tree = Tree([w for _, w in frequent], np.array([n for n, _ in frequent], np.int64), total, distinct, depth=depth)

    encoded = Cut(_encoded(learned, tree), "encoded")

    def count(tree: Tree, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = _count_next(encoded.df, tree, wanted).where(F.col("n") >= max(2.0, NEXT * total)).toArrow()  # 1 / NEXT rows at most
        return got["code"].to_numpy(), got["n"].to_numpy()

    if total:
        tree = grow(tree, count, depth, context)
    encoded.drop()
    return tree, counted.where((F.col("n") < least) & (F.length("w") > 0))


def _packed(columns: list[np.ndarray], steps: int = 1) -> bytes:
    """Columns of unsigned 32-bit numbers, byte by byte of equal weight, compressed; the first ``steps`` are held as steps."""
    held = [*(np.diff(c, prepend=np.uint32(0)) for c in columns[:steps]), *columns[steps:]]
    raw = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in held)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpacked(blob: bytes, n: int, steps: int = 1) -> np.ndarray:
    raw = pa.Codec("zstd", 1).decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    got = np.frombuffer(raw, np.uint8).reshape(n, 4, -1).transpose(0, 2, 1).copy().view("<u4").reshape(n, -1)
    for c in got[:steps]:
        np.cumsum(c, dtype=np.uint32, out=c)
    return got


def _older(tree: Tree, ids: np.ndarray, names: np.ndarray, at: np.ndarray, start: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which tokens have a word before their state's words, and the BRANCH words there of these."""
    back = at - tree.depths[state] - 1
    some = (back >= start) & (tree.depths[state] < tree.depth)
    back, start = back[some], start[some]
    return some, [np.where(back - k >= start, names[np.maximum(back - k, 0)], NONE) for k in range(BRANCH)]


def branch(tree: Tree, learned: np.ndarray, state: np.ndarray, older: list[np.ndarray], word: np.ndarray, divergence: float = DIVERGENCE, smoothing: float = SMOOTHING) -> np.ndarray:
    """What each token of a bucket gains in log10 by the branches; all tokens of a (state, first older word) must be here."""
    other = tree.base - 1
    rest = np.log10(max(1 - (10 ** tree.roots_[:-1]).sum(), 1e-12))
    gained, going, group = np.zeros(len(word)), np.arange(len(word)), state
    for x in older:
        inside = x[going] != NONE
        going = going[inside]
        _, group = np.unique((group[inside].astype(np.int64) << 32) | x[going], return_inverse=True)
        often = np.bincount(group, learned[going]) >= EVIDENCE
        enough = often[group]
        going = going[enough]
        if not len(going):
            break
        group = (np.cumsum(often) - 1)[group[enough]]
        codes, lead, entry = np.unique(group * tree.base + word[going], return_index=True, return_inverse=True)
        n = np.bincount(entry, learned[going])
        seen, lead = n >= 2, going[lead]
        size, k, lead = np.bincount(group, learned[going]).astype(float), codes[seen] // tree.base, lead[seen]
        up = 10 ** (tree.log10(state[lead], word[lead]) + np.where(word[lead] == other, rest, 0.0) + gained[lead])
        p = (n[seen] + smoothing * up) / (size[k] + smoothing)
        left = np.maximum(1 - np.bincount(k, p, len(size)), 1e-12)
        left_up = np.maximum(1 - np.bincount(k, up, len(size)), 1e-12)
        kept = np.bincount(k, p * np.log(p / up), len(size)) + left * np.log(left / left_up) >= divergence
        gain = np.where(kept, np.log10(left / left_up), 0.0)[codes // tree.base]
        gain[seen] = np.where(kept[k], np.log10(p / up), 0.0)
        gained[going] += gain[entry]
    return gained


def score(docs: DataFrame, tree: Tree, others: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(i, held, n_tokens, n_known, base, score) per row of docs; branches learn from those of its rows that are not held out.

    Texts are read once: the sums of a part's rows travel beside their tokens, as a group of their own, below zero.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tree)
    buckets = 1 + tree.total // BUCKET

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        known = {w: i for i, w in enumerate(tree.words)}
        row, other = TaskContext.get().partitionId() << 36, len(tree.words)
        begun, waiting, size_waiting = row, [], 0

        def sent_on() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*waiting)]
            waiting.clear()
            bucket = columns.pop()
            order = np.argsort(bucket, kind="stable")
            columns = [c[order] for c in columns]
            named, starts = np.unique(bucket[order], return_index=True)
            blobs = [_packed([c[a:b] for c in columns]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)])]
            m = len(blobs)
            rows = [pa.array([begun] * m, pa.int64()), *(pa.nulls(m, f.type) for f in list(schema)[1:9]), pa.array(named.astype(np.int64)), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(rows, schema=schema)

        for batch in batches:
            for part in by_bytes(batch, 2, HELD_BYTES):
                ids, at, docs = _ids(part.column(2).to_pylist(), known, tree)
                word = ids[at]
                sizes = np.array([len(d) + 1 for d in docs])
                own = np.repeat(np.arange(len(docs)), sizes)
                total = lambda x: np.bincount(own, x, len(docs))  # noqa: E731, B023
                state = tree.state(ids, at)
                base, full = total(tree.roots_[word]), total(tree.log10(state, word))
                seen = total((word < other) & (tree.counts[np.minimum(word, other - 1)] > 0)).astype(np.int64)
                begin, rare, hashes = 0, [], []
                for d, size in zip(docs, sizes.tolist()):
                    found = [d[k] for k in np.flatnonzero(word[begin : begin + size - 1] == other).tolist()]
                    hashes += [zlib.crc32(w) for w in found]
                    rare.append(Counter(found))
                    begin += size
                n = len(docs)
                rows = [pa.array(range(row, row + n), pa.int64()), part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(seen), pa.array(base), pa.array(full), pa.array([list(c) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([-1 - row] * n, pa.int64()), pa.nulls(n, pa.binary())], schema=schema)

                names = ids.copy()
                names[ids == other] = np.array(hashes, np.int64) | 0x80000000
                start = np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes)
                some, older = _older(tree, ids, names, at, start, state)
                held = np.array(part.column(1).to_pylist(), bool)
                mark, state, word = ((own + row - begun) * 2 + held[own])[some], state[some], word[some]
                key = (state.astype(np.uint64) << np.uint64(32) | older[0].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                bucket = (key >> np.uint64(24)) % np.uint64(buckets)
                waiting.append([*(c.astype(np.uint32) for c in (mark, state, word, *older)), bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64)])
                size_waiting += len(word)
                row += n
                if size_waiting > SENT:
                    yield sent_on()
                    begun, size_waiting = row, 0
        if size_waiting:
            yield sent_on()

    def grown(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        tree = sent.value
        got = [_unpacked(b, 3 + BRANCH) for b in table.column("blob").to_pylist()]
        ends = np.cumsum([g.shape[1] for g in got])
        mark, state, word, *older = np.concatenate(got, axis=1)
        del got
        gains = branch(tree, mark % 2 == 0, state, older, word)
        parts, out = [], []
        for part, a, b in zip(table.column("row").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
            hit = a + np.flatnonzero(gains[a:b])
            if len(hit):
                places, place = np.unique(mark[hit] // 2, return_inverse=True)
                sums = np.bincount(place, gains[hit]).astype("<f4").view("<u4")
                parts.append(part)
                out.append(_packed([places, sums]))
        m = len(parts)
        rows = [pa.array(parts, pa.int64()), *(pa.nulls(m, f.type) for f in list(schema)[1:9]), pa.array([0] * m, pa.int64()), pa.array(out, pa.binary())]
        return pa.Table.from_arrays(rows, schema=schema)

    def summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        places, sums = np.concatenate([_unpacked(b, 2) for b in table.column("blob").to_pylist()], axis=1)
        gains = np.bincount(places, np.ascontiguousarray(sums.astype("<u4")).view("<f4").astype(float))
        return pa.table({"r2": pa.array(np.arange(len(gains)) + key[0].as_py(), pa.int64()), "gain": pa.array(gains)})

    types = [("row", pa.int64()), ("i", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("seen", pa.int64()), ("base", pa.float64()), ("full", pa.float64()), ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32())), ("bucket", pa.int64()), ("blob", pa.binary())]
    schema = pa.schema(types)
    fields = "row long, i long, held boolean, n_tokens long, seen long, base double, full double, words array<binary>, times array<int>, bucket long, blob binary"
    both = Cut(_rows(docs, id_col, text_col).mapInArrow(run, fields).groupBy("bucket").applyInArrow(grown, fields), "scored").df
    local = both.where("bucket < 0")
    gains = both.where("bucket = 0").select("row", "blob").groupBy("row").applyInArrow(summed, "r2 long, gain double")
    each = local.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("w"), F.col("x.times").alias("times"))
    counted = others.select(F.col("w").alias("o"), "n")
    found = each.join(counted, F.col("w") == F.col("o"), "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(tree.total + tree.distinct + 1)))
    sums = found.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also"))
    joined = local.select("row", "i", "held", "n_tokens", "seen", "base", "full").join(sums.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    joined = joined.join(gains, F.col("row") == F.col("r2"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select("i", "held", "n_tokens", (F.col("seen") + F.coalesce("also", F.lit(0))).alias("n_known"), (F.col("base") + more).alias("base"), (F.col("full") + more + F.coalesce("gain", F.lit(0.0))).alias("score"))


def op5_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tree, others = learn(docs)
    spark.sparkContext._jvm.System.gc()  # Spark's cleaner deletes the shuffle files of what is no longer referred to
    got = score(docs, tree, others)
    return got.select(F.col("i").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
