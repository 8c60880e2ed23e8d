"""Operators over documents against brute force, with odd rows and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termweave.llm import media, mixing, packing, simhash, suffix_tree, token_files, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
key = lambda r: tuple((x is not None, x) for x in r)


def ids_of(path, text):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd, rows_of):
    files = token_files.TokenFiles(token_files.write_token_files(odd, BYTE))
    got = sorted((tuple(r) for r in files.documents(spark).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows_of), key=lambda i: (i is not None, i))
    start = 0
    for place, (_, at, n, _) in enumerate(got):
        assert at == start and files.document(place).size == n
        start += n
    want = sorted(((i, len(x), crc(x)) for i, t in rows_of for x in [ids_of(BYTE, t)]), key=key)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=key) == want
    nothing = token_files.TokenFiles(token_files.write_token_files(odd.limit(0), BYTE))
    assert nothing.documents(spark).count() == 0
    with pytest.raises(ValueError):
        token_files.local_path("hdfs://host/x")


def test_packing(odd, rows_of):
    got = packing.pack(odd, WORD, 256).collect()
    want = collections.Counter((i, k // 256, k, len(x[k : k + 256]), crc(x[k : k + 256])) for i, t in rows_of for x in [ids_of(WORD, t)] for k in range(0, len(x), 256))
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 256
    lengths = np.array([r.length for r in got if r.length < 256])
    assert len(bins) - sum(r.length == 256 for r in got) == packing.lower_bound(np.bincount(lengths, minlength=257))
    assert packing.pack(odd.limit(0), WORD, 256).count() == 0


def test_packing_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 64, rng.integers(1, 60))
        bins, offsets, left = packing.best_fit_decreasing(lengths, 64)
        used = np.bincount(bins, lengths)
        assert (used + np.array(left) == 64).all() and (offsets + lengths <= 64).all()
        assert math.ceil(lengths.sum() / 64) <= packing.lower_bound(np.bincount(lengths, minlength=65)) <= len(left)


def brute_components(fps, near):
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(2)
    for radius, parts in ((4, 1), (9, 2), (3, 1)):
        masks = simhash.covering_masks(radius, parts)
        for _ in range(2000):
            off = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, radius + 1), replace=False))
            assert any(not off & m for m in masks)


@pytest.mark.parametrize("most", [8192, 2])
def test_simhash(spark, odd, rows_of, monkeypatch, most):
    monkeypatch.setattr(simhash, "PAIRWISE_MOST", most)
    got = simhash.near_duplicates(odd, words=4, radius=4, parts=1, both=None).collect()
    marks = [(i, simhash.fingerprint((t or "").encode())) for i, t in rows_of]
    assert collections.Counter((r.id, r.fp) for r in got) == collections.Counter(marks)
    comps = brute_components([f for _, f in marks], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    least = {}
    for (i, _), c in zip(marks, comps):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    assert collections.Counter((r.id, r.fp, r.component) for r in got) == collections.Counter((i, f, least[c]) for (i, f), c in zip(marks, comps))
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_links_chains_and_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE_MOST", 4)
    rng = np.random.default_rng(5)
    fps = {0}
    for _ in range(60):
        f = int(rng.choice(list(fps)))
        fps.add(f ^ sum(1 << int(b) for b in rng.choice(63, 4, replace=False)))
    fps |= {int(x) for x in rng.integers(0, 2**63, 60)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    from termweave.plans.components import components

    got = {r.node: r.root for r in components(simhash.links(nodes, 4, 1, None), "a", "b").collect()}
    comps = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {f: got.get(f, f) for f in fps} == {f: fps[c] for f, c in zip(fps, comps)}


def test_simhash_fingerprint_is_the_definition():
    import xxhash

    text = "The cat SAT on the mat the cat sat on"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want and simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_mixing(spark, odd, rows_of):
    got = mixing.mix(odd).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.id, r["size"]) for r in got) == collections.Counter((i, size(t)) for i, t in rows_of)
    by = collections.defaultdict(int)
    for r in got:
        by[r.src] += r["size"]
        assert 0 <= r.copies <= 2
    assert all(r.source_size == by[r.src] for r in got)
    assert math.isclose(sum({r.src: r.target for r in got}.values()), 1.5 * sum(by.values()))
    again = mixing.mix(odd.repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_targets_and_thresholds(spark):
    sizes = {"a": 10, "b": 1000, "c": 5000, None: 300, "z": 0}
    got = {r.src: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "z", None], [5, 2, 1, 5, 2]))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while True:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: weights[s] * level for s in open_}
    assert all(math.isclose(got[s], target[s], abs_tol=1e-6) for s in sizes)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + cast(id % 7 as int))").alias("text"), F.expr("if(id % 3 = 0, 'big', concat('s', id % 5))").alias("source"))
    taken = mixing.mix(docs).groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.first("target").alias("target")).collect()
    assert all(abs(r.got - r.target) <= 7 for r in taken)


def test_suffix_tree(spark, odd, rows_of):
    tree, others = suffix_tree.learn(odd)
    got = suffix_tree.score(odd, tree, others).collect()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = collections.Counter(w for i, t in rows_of if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
    want = sorted(((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), round(base(t), 6)) for i, t in rows_of), key=key)
    assert sorted(((r.i, r.held, r.n_tokens, r.n_known, round(r.base, 6)) for r in got), key=key) == want
    assert all(r.score < 0 for r in got) and tree.total == n and tree.distinct == v
    states = sorted({0, *(tree.codes // tree.base).tolist()})
    for s in states[:20]:
        known = (10 ** tree.log10(np.full(len(tree.words), s), np.arange(len(tree.words)))).sum()
        rest, q = 0.0, s
        while q:
            rest, q = rest + tree.rest[q], int(tree.parent[q])
        assert math.isclose(known + 10**rest * (1 - (10 ** tree.roots_[:-1]).sum()), 1, abs_tol=1e-9)
    empty_tree, none = suffix_tree.learn(odd.limit(0))
    assert suffix_tree.score(odd.limit(0), empty_tree, none).count() == 0
    assert suffix_tree.score(odd, empty_tree, none).count() == len(rows_of)


def test_suffix_tree_learns_contexts(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat(if(id % 2 = 0, 'a b c ', 'a d d c '), 5)").alias("text"))
    tree, others = suffix_tree.learn(docs)
    r = suffix_tree.score(docs, tree, others).where("held").agg(F.sum("base").alias("b"), F.sum("score").alias("s")).first()
    assert r.s > 0.5 * r.b  # contexts halve the cost at least


def test_toxicity(spark, odd):
    texts = [f"the {w} of word{k} and more words here" for k in range(300) for w in (["idiot", "scumbag"][k % 2] if k % 3 == 0 else "garden",)]
    y = [int(k % 3 == 0) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, v) for k, v in enumerate(y)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    more = spark.createDataFrame([(900, "some idiott here"), (901, "a quiet scumbags day"), (902, "a garden of words"), (903, ""), (904, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs.unionByName(more), model).collect()}
    assert all((got[k] >= 0.5) == bool(v) for k, v in enumerate(y) if zlib.crc32(str(k).encode()) % 5 == 0)
    assert got[900] > 0.5 and got[901] > 0.5 and got[902] < 0.5 and got[903] == got[904]
    assert set(odd.columns) < set(toxicity.score(odd, model, out_col="tox").columns)
    assert toxicity.score(odd.drop("score"), model).count() == odd.count()
    alone = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs.limit(3), alone).where("score = 0.5").count() == 3


def test_media(spark, odd, rows_of):
    stored = media.store(odd)
    got = sorted((tuple(r) for r in media.digests(stored).collect()), key=key)
    files = {(r.id, r.n_bytes, bytes(r.media)) for r in stored.collect()}
    fill = lambda b: b + b" " * (-len(b) % 192 if b else 192)
    want = sorted(((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for i, t in rows_of for b in [(t or "").encode()] for p in [fill(b)]), key=key)
    assert [r[:5] for r in got] == want
    assert {(r[0], r[1], r[5], r[6]) for r in got} == {(i, n, len(m), hashlib.sha256(m).hexdigest()) for i, n, m in files}
    clips = media.clips(stored).groupBy("id").agg(F.sum("frames").alias("n"), F.min("start_s").alias("a")).collect()
    assert all(r.a == 0 and r.n >= 1 for r in clips)
    bad = spark.createDataFrame([(1, bytearray(b"no avi")), (2, None)], "id long, media binary")
    assert media.clips(bad).count() == 0 and media.store(odd.limit(0)).count() == 0


def test_media_shots_and_index():
    dark, light = b"\x10" * 192 * 64 * 3, b"\xd0" * 192 * 64 * 2
    (avi,) = media.to_avi([dark + light])
    frames, rate = media.read_avi(avi)
    assert len(frames) == 5 and rate == 25
    assert media.shots(media.decode(frames)) == [(0, 3), (3, 5)]
    cut = avi[: avi.rindex(b"idx1")]
    assert media.read_avi(cut)[0] == frames


def test_media_baseline_frames():
    """A baseline frame of flat blocks, coded here by hand: each block's level is its DC alone."""
    levels = [40, 200, 90, 120]
    dht = lambda kind, counts, symbols: b"\xff\xc4" + (19 + len(symbols)).to_bytes(2, "big") + bytes([kind, *counts, *symbols])
    dc = dht(0x00, [0, 0, 0, 12] + [0] * 12, range(12))  # categories 0 to 11 in four bits
    ac = dht(0x10, [1] + [0] * 15, [0])  # the end of the block in one bit
    bits, before = "", 0
    for level in levels:
        value = (level - 128) * 8
        d, before = value - before, value
        n = abs(d).bit_length()
        bits += f"{n:04b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    sof = b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x10\x01\x01\x11\x00"
    jpeg = b"\xff\xd8\xff\xdb\x00\x43\x00" + b"\x01" * 64 + dc + ac + sof + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + data + b"\xff\xd9"
    (image,) = media.decode([jpeg])
    assert [int(image[y, x]) for y, x in ((0, 0), (0, 8), (8, 0), (8, 8))] == levels and image.shape == (16, 16)
