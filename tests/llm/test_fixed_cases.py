"""Odd inputs that once gave wrong results: folded letters, repeated ids, broken frames."""

import collections
import functools
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termweave.llm import media, minhash, mixing, queries, suffix_tree, tokenizing, topk, toxicity
from termweave.llm.sieve import Sieve
from termweave.plans.shared import cut

from .test_table_operators import as_sql


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library_on_every_letter_and_mark(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), tokenizing.WordEncoder(path, "<u4")
    points = [chr(c) for c in range(sys.maxunicode) if unicodedata.category(chr(c)) not in ("Cs", "Co") and (c < 0x3000 or c % 7 == 0)]
    texts = [f"{c}. a{c}, b{c} {c}x. {c}" for c in points if unicodedata.category(c) != "Cn"]
    texts += [f"İzmir geldi İ. son{c}" for c in points[:2000]]
    texts = [*texts, *["".join(r) for r in np.random.default_rng(4).choice(points[:900] + [" ", ".", ",", "'", "\n"] * 60, (20000, 12))]]
    for at in range(0, len(texts), 4096):
        part = texts[at : at + 4096]
        for text, want, got in zip(part, library.encode_batch(part, add_special_tokens=False), own.encode(part)):
            assert np.array(want.ids, "<u4").tobytes() == got, ascii(text)


class Counted:
    """A tokenizer that counts the calls to its encoding methods."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def __getattr__(self, name):
        self.calls += name.startswith("encode")
        return getattr(self.tokenizer, name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_of_a_batch_reach_the_library_together(name):
    """The library was called for the new words of every 64 texts. Slices, nulls and odd texts keep their places in an array."""
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), tokenizing.WordEncoder(path, "<u4")
    own.tokenizer = Counted(own.tokenizer)
    texts = [f"The naïve wörd{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}, of\n{'abcdefghij'[k % 10] * (k % 7 + 1)}. End." for k in range(1500)]
    assert [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)] == own.encode(texts)
    assert own.tokenizer.calls <= 4
    mixed = pa.array(["cut off", None, "", "a  b", "Ends. ", *texts[:3], "J\u030c, J.", "\u3000x", " led", "\nled", ".", "x<|endoftext|>", "", "no\u00a0break", "last,"]).slice(1)
    want = [np.array(library.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in mixed.to_pylist()]
    assert own.encode_array(mixed).to_pylist() == want
    assert own.encode_array(mixed.slice(0, 0)).to_pylist() == [] and own.encode_array(mixed.slice(1, 1)).to_pylist() == [b""]


def test_a_word_is_remembered_once_whatever_stands_around_it():
    """op3: Word, word. and a word behind a line feed were remembered, and looked up, each by itself."""
    own = tokenizing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), "<u4")
    got = own.encode(["Word word, word.\nWORD wört", "word", "wört word."])
    assert got[2] == got[0][-len(own.encode(["wört"])[0]) :] + got[1] + own.encode(["."])[0]
    assert len(own.known) == 4


def test_repeated_query_ids(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4)).round(3)
    rows = [(k % 40 if k < 50 else 0, x.tolist()) for k, x in enumerate(v)] + [(20, v[20].tolist()), (None, v[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter(map(tuple, topk.top_k(df, df.where("vec_id % 100 = 0"), 10).collect()))
    own = {"v": min(x for i, x in rows if i == 0)}
    q = [int(np.floor(1024 * c)) for c in own["v"]]
    want = sorted(((-sum(a * int(np.floor(1024 * c)) for a, c in zip(q, x)), i) for i, x in rows if i not in (0, None)))[:10]
    assert got == collections.Counter((0, k + 1, i, -s) for k, (s, i) in enumerate(want))
    columns, sql = as_sql(queries.OP8_SQL, embeddings=df.toPandas().astype({"vec_id": "Int64"}))
    assert sql == {tuple(dict(zip(("query_id", "rank", "vec_id", "score"), r))[c] for c in columns) for r in got}
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [3e38]), (1, [3e38])], "vec_id long, embedding array<double>"), df.where("vec_id = 0"))


def test_mixing_is_its_sql_with_repeated_and_null_ids(spark, odd):
    docs = spark.range(500).select((F.col("id") % 180).alias("doc_id"), F.expr("repeat('w ', cast(id % 9 as int))").alias("text"), F.expr("if(id % 3 = 0, 'a', if(id % 7 = 0, null, concat('s', id % 4)))").alias("source"))
    docs = docs.unionByName(odd.select("doc_id", "text", "source"))
    got = mixing.mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    columns, sql = as_sql(queries.OP9_SQL, documents=docs.toPandas().astype({"doc_id": "Int64"}))
    assert {tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in got.collect()} == sql
    copies = collections.Counter()
    for r in mixing.mix(docs).collect():
        copies[r.id, r.src, r["size"]] += r.copies
    rows = mixing.copied(docs.withColumn("s", F.lit(1)).withColumn("below", F.lit(2)).withColumn("h", F.lit(3)), "__copies")
    again = collections.Counter()
    for r in rows.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), "__copies").collect():
        again[r.doc_id, r.source, r["size"]] += r["__copies"]
    assert again == copies and rows.count() == docs.count()


def test_survivors_with_repeated_rows_and_ids(spark):
    long = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(1, long(1)), (1, long(1)), (1, long(2)), (2, long(2)), (None, long(3)), (4, long(3)), (None, long(5)), (7, ""), (6, None), (8, long(1) + " end")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "doc_id long, text string, u string, node long, g int, drop string")
    got = collections.Counter((r.doc_id, r.text) for r in minhash.survivors(docs).collect())
    assert got == collections.Counter([(1, long(1)), (1, long(2)), (4, long(3)), (None, long(5)), (6, None)])
    assert minhash.survivors(docs).columns == docs.columns and minhash.survivors(docs.limit(0)).count() == 0


def test_sieve_loses_no_key(spark):
    keys = cut(spark.range(3000).select((F.col("id") * 7919 - 900).alias("k")))
    hit, clear = Sieve(keys, "k").split(spark.range(30000).withColumn("key", F.col("id") - 900), F.col("key"))
    seen, rest = {r.key for r in hit.collect()}, {r.key for r in clear.collect()}
    want = {k * 7919 - 900 for k in range(3000)}
    assert not want & rest and len(seen) + len(rest) == 30000 and len(seen) < 4000 and hit.columns == ["id", "key"]


def test_broken_media_spare_their_neighbours(spark):
    payloads = [bytes([40 * k % 256]) * 192 * 70 for k in range(4)]
    good = media.to_avi(payloads)
    at = good[1].index(b"\xff\xd8")
    broken = [good[1][:at] + b"\x00\x00" + good[1][at + 2 :], good[1][: at + 60], good[1][:300], b"RIFF\x04\0\0\0AVI ", b"", None, good[1].replace(b"\xff\xc3", b"\xff\xc2"), good[1][: at + 200] + b"\xff" * 40 + good[1][at + 240 :]]
    rows = [(k, m) for k, m in enumerate([good[0], *broken, good[2], good[3]])]
    df = spark.createDataFrame(rows, "id long, media binary").coalesce(1)
    got = {i: p for (i, _), (p, _, _) in zip(rows, media._decoded([m for _, m in rows]))}
    assert got[0] == payloads[0] and got[9] == payloads[2] and got[10] == payloads[3] and not any(got[k] for k in range(1, 7))
    assert {r.id for r in media.clips(df).collect()} >= {0, 9, 10}
    digests = media.digests(df.select("id", F.lit(1).cast("long").alias("n_bytes"), "media")).collect()
    assert {r.doc_id for r in digests if r.payload_sha256 is not None} >= {0, 9, 10} and len(digests) == len(rows)


def test_only_the_first_video_stream_and_clusters():
    (avi,) = media.to_avi([b"\x10" * 192 * 64 * 2])
    frames, _ = media.read_avi(avi)
    head = avi[12 : avi.index(b"LIST", avi.index(b"strf"))]
    other = media._chunk(b"LIST", b"strl" + media._chunk(b"strh", b"auds" + b"\0" * 52))
    video = avi[avi.index(b"LIST", 30) :][: avi.index(b"LIST", avi.index(b"strf")) - avi.index(b"LIST", 30)]
    body = b"".join(media._chunk(b"LIST", b"rec " + media._chunk(b"00wb", b"sound") + media._chunk(b"01dc", f) + media._chunk(b"02dc", b"other")) for f in frames)
    made = media._chunk(b"RIFF", b"AVI " + media._chunk(b"LIST", b"hdrl" + other + video + video) + media._chunk(b"LIST", b"movi" + body))
    assert head and media.read_avi(made)[0] == frames


def test_standard_tables_are_whole():
    tables = media._standard_tables()
    assert {k: len(v) for k, v in tables.items()} == {0x00: 12, 0x01: 12, 0x10: 162, 0x11: 162}
    for codes in tables.values():  # no code begins with another, and none is all ones
        texts = [f"{c:0{n}b}" for c, n in codes.values()]
        assert all("0" in t for t in texts) and not any(a != b and b.startswith(a) for a in texts for b in texts)


def test_clips_are_brute_force_shots(spark):
    rng = np.random.default_rng(3)
    payload = b"".join(bytes(rng.integers(low, low + 30, 192 * 64, np.uint8)) for low in (10, 12, 11, 200, 201, 90, 91, 92, 10))
    stored = spark.createDataFrame([(1, media.to_avi([payload])[0])], "id long, media binary")
    frames = [np.frombuffer(payload[a : a + 192 * 64], np.uint8) for a in range(0, len(payload), 192 * 64)]
    cuts, run = [0], []
    for k in range(1, len(frames)):
        x, y = (np.histogram(f, 32, (0, 256))[0] / f.size for f in (frames[k - 1], frames[k]))
        d = abs(x - y).sum() / 2
        if d >= media.LEAST_CUT and (not run or d > np.mean(run) + media.ADAPT * np.std(run)):
            cuts, run = [*cuts, k], []
        else:
            run.append(d)
    want = [(k, a, b - a, a / 25, b / 25) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(frames)]))]
    assert [(r.clip, r.first_frame, r.frames, r.start_s, r.end_s) for r in media.clips(stored).orderBy("clip").collect()] == want and len(want) > 2


def test_toxicity_without_window_and_with_repeated_ids(spark):
    texts = [f"the {'idiot' if k % 3 == 0 else 'garden'} of word{k} and more" for k in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels, window=None)
    got = {r.doc_id: r.score for r in toxicity.score(docs, whole).collect()}
    assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(200))


def brute_tree(texts, context, rare, divergence, smoothing, depth):
    """log10 probability of a text by the definition, with contexts as tuples."""
    end = b""
    seqs = [[end, *t.encode().lower().split(), end] for t in texts]
    words = collections.Counter(w for q in seqs for w in q[1:])
    total, distinct = sum(words.values()), len(words)
    after = collections.defaultdict(collections.Counter)
    for q in seqs:
        for at in range(1, len(q)):
            for n in range(1, min(depth + suffix_tree.BRANCH, at) + 1):
                after[tuple(q[at - n : at])][q[at]] += 1
    frequent = {w for w, n in words.items() if n >= max(1, rare * total) or w == end}
    kept, seen = {}, {(): None}

    def prob(ctx, w):
        while ctx and (ctx not in kept or w not in kept[ctx][0]):
            if ctx in kept:
                left = kept[ctx][1]
                return left * prob(ctx[1:], w)
            ctx = ctx[1:]
        return kept[ctx][0][w] if ctx else (words[w] + 1) / (total + distinct + 1)

    level = {(w,): n for w, n in words.items() if w in frequent and n >= context * total}
    for _ in range(depth):
        new = {}
        for ctx in level:
            seen[ctx] = None
        found = {}
        for ctx, size in level.items():
            nexts = {w: n for w, n in after[ctx].items() if w in frequent and n >= max(2, rare * total)}
            up = {w: prob(ctx[1:], w) for w in nexts}
            p = {w: (n + smoothing * up[w]) / (size + smoothing) for w, n in nexts.items()}
            left, left_up = max(1 - sum(p.values()), 1e-12), max(1 - sum(up.values()), 1e-12)
            if sum(p[w] * np.log(p[w] / up[w]) for w in p) + left * np.log(left / left_up) >= divergence:
                found[ctx] = (p, left / left_up)
            new.update({(*ctx, w): n for w, n in nexts.items() if n >= context * total and w != end and (*ctx[1:], w) in seen})
        kept.update(found)
        level = new

    other = object()
    kind = lambda w: w if w in frequent else other
    classes = {ctx: collections.Counter() for ctx in after}
    for ctx, nexts in after.items():
        for w, n in nexts.items():
            classes[ctx][kind(w)] += n
    mass = 1 - sum((words[w] + 1) / (total + distinct + 1) for w in frequent)

    def crown(ctx, w):
        return prob(ctx, w) if w is not other else mass * np.prod([kept[ctx[k:]][1] for k in range(len(ctx)) if ctx[k:] in kept])

    @functools.cache
    def branched(ctx, k, w):
        """Probability of a word or of all others, k older words before a crown's context."""
        if not k:
            return crown(ctx, w)
        shorter = ctx[1:]
        size = classes[ctx].total() if ctx in classes else 0
        if size < suffix_tree.EVIDENCE:
            return branched(shorter, k - 1, w)
        up = {v: branched(shorter, k - 1, v) for v, n in classes[ctx].items() if n >= 2}
        p = {v: (classes[ctx][v] + smoothing * up[v]) / (size + smoothing) for v in up}
        left, left_up = max(1 - sum(p.values()), 1e-12), max(1 - sum(up.values()), 1e-12)
        if sum(p[v] * np.log(p[v] / up[v]) for v in p) + left * np.log(left / left_up) < divergence:
            return branched(shorter, k - 1, w)
        counted[0] += 1
        return p[w] if w in p else branched(shorter, k - 1, w) * left / left_up

    counted = [0]

    def score(text):
        q = [end, *text.encode().lower().split(), end]
        out = 0.0
        for at in range(1, len(q)):
            ctx = next((c for n in range(min(depth, at), 0, -1) if (c := tuple(q[at - n : at])) in kept), ())
            out += np.log10(prob(ctx, q[at]))
            s = next((n for n in range(min(depth, at), 0, -1) if tuple(q[at - n : at]) in seen), 0)
            k = min(suffix_tree.BRANCH, at - s) if s < depth else 0
            here = tuple(q[at - s - k : at])
            out += np.log10(branched(here, k, kind(q[at])) / crown(here[k:], kind(q[at])))
        return out, max(map(len, kept), default=0)

    score.counted = counted

    return score


@pytest.mark.parametrize(("context", "depth"), [(suffix_tree.CONTEXT, 5), (0.02, 5), (0.02, 1), (0.5, 5)])
def test_suffix_tree_is_the_definition(spark, monkeypatch, context, depth):
    rng = np.random.default_rng(8)
    passage = "one two three four five six seven eight nine ten eleven twelve"
    rare = "Ünder der rarest of words seldom seen elsewhere"
    texts = [" ".join([*rng.choice(["a", "b", "c", "d", f"r{k}"], 12), passage if k % 3 else "", rare if k % 17 == 0 else "", *rng.choice(["a", "b", "e"], 6)]) for k in range(90)] + ["", "A b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    monkeypatch.setattr(suffix_tree, "NEXT", 4e-3)
    monkeypatch.setattr(suffix_tree, "BUCKET", 300)
    brute = brute_tree([t for i, t in enumerate(texts) if not held(i)], context, 4e-3, suffix_tree.DIVERGENCE, suffix_tree.SMOOTHING, depth)
    tree, others = suffix_tree.learn(docs, depth=depth, context=context)
    got = {r.i: r.score for r in suffix_tree.score(docs, tree, others).collect()}
    assert all(abs(got[i] - brute(t)[0]) < 1e-4 for i, t in enumerate(texts))
    assert brute("a")[1] > 2 if context < 0.01 else brute.counted[0] > 0


def test_branches_grow_with_the_input(spark):
    """A passage of ten texts is remembered where a context needs one in a hundred of all tokens to be in the crown."""
    passage = [f"p{k}" for k in range(60)]
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["u", "v", "w", "x", "y"], 200)) for _ in range(300)]
    for k in range(0, 300, 30):
        texts[k] += " " + " ".join(passage)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree, others = suffix_tree.learn(docs, context=0.01)
    with_branches = {r.i: r.score for r in suffix_tree.score(docs, tree, others).collect()}
    plain = {r.i: r.base for r in suffix_tree.score(docs, tree, others).collect()}
    told = [(with_branches[k] - plain[k]) - (with_branches[k + 1] - plain[k + 1]) for k in range(0, 300, 30)]
    assert min(told) > 60  # a power of ten for each word of the passage, at the least


def test_wide_radii_in_large_buckets_are_compared_block_by_block(spark, monkeypatch):
    from termweave.llm import simhash
    from termweave.plans.components import components

    monkeypatch.setattr(simhash, "PAIRWISE_MOST", 8)
    rng = np.random.default_rng(6)
    fps = {0}
    while len(fps) < 50:
        f = int(rng.choice(list(fps)))
        fps.add(f ^ sum(1 << int(b) for b in rng.choice(40, 6, replace=False)))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes, 6, 1, None), "a", "b").collect()}
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if b < a and (a ^ b).bit_count() <= 6 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {f: got.get(f, f) for f in fps} == root
