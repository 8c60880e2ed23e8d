"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F

from termweave.llm import minhash, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(r, words, k, block, many):
    """words with ``many`` words changed, in one block or scattered."""
    out = list(words)
    at = range((start := r.randrange(len(words) - many)), start + many) if block else r.sample(range(len(words)), many)
    for i in at:
        out[i] = f"e{k}x{i}"
    return out


def planted():
    """Texts with similarities from 0.6 to 1.0 to a base, chains, and many that share a long passage."""
    r, texts = random.Random(11), []
    for k in range(60):
        base = [f"b{k}w{j}" for j in range(150 + r.randrange(150))]
        texts.append(base)
        for v in range(4):
            block = (k + v) % 2 == 0
            texts.append(edited(r, base, f"{k}v{v}", block, r.randrange(1, len(base) // 6) if block else r.randrange(1, 1 + len(base) // 22)))
    passage = [f"p{j}" for j in range(120)]
    texts += [passage + [f"q{k}w{j}" for j in range(10 + k)] for k in range(30)]
    chain = [f"c{j}" for j in range(200)]
    for k in range(8):
        chain = edited(r, chain, f"c{k}", True, 12)
        texts.append(chain)
    return [" ".join(t) for t in texts] + ["", "  \n", "one two", "ONE  two"]


def test_stage_is_brute_force(spark, tmp_path, monkeypatch):
    texts = planted()
    sets = [shingles(t) for t in texts]
    own = list(range(len(texts)))
    between = []
    for i in own:
        for j in range(i):
            s = jaccard(sets[i], sets[j])
            between.append(s)
            if s >= 0.8:
                a, b = own[i], own[j]
                own = [min(a, b) if x in (a, b) else x for x in own]
    assert sum(0.8 <= s < 0.85 for s in between) > 20 and sum(0.7 <= s < 0.8 for s in between) > 20
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate(texts)], COLUMNS).repartition(3)
    for block in (minhash.BLOCK, 2000):  # also with buckets in several blocks
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert {r.id: r.component for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(own))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == sorted(set(own))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_members_are_linked_as_all_pairs_are():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, 34)) for _ in range(60)]
    roots = np.arange(60)
    roots[20:50] = 20
    label, links = roots.copy(), minhash.link_members(sets, roots, 0.6)
    want = roots.copy()
    for i in range(60):
        for j in range(i):
            if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.6:
                want[want == want[i]] = want[j]
    for i, j in links:
        assert jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.6
        label[label == label[i]] = label[j]
    groups = lambda x: {tuple(np.flatnonzero(x == v)) for v in set(x.tolist())}
    assert groups(label) == groups(want)


def test_keys_meet_at_the_threshold():
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(300):  # 80 of 100 shared: a similarity of 0.8
        x = rng.integers(0, 1 << 63, 100, np.uint64)
        missed += not set(minhash.band_keys(x[:90])) & set(minhash.band_keys(x[10:]))
    assert missed == 0


def test_stages_give_back_freed_memory(spark, tmp_path, monkeypatch):
    from termweave.plans import shared

    assert "rim" in shared.release(spark)  # the JVM knows the command: it trims, or says that it cannot here
    calls = []
    monkeypatch.setattr(corpus_pipeline, "release", lambda s: calls.append("stage"))
    monkeypatch.setattr(minhash, "release", lambda s: calls.append("cut"))
    docs = spark.createDataFrame([(k, f"a text of its own w{k}", "en", "s", 1) for k in range(5)], COLUMNS)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).count() == 5
    assert calls.count("cut") > 5 and calls[-1] == "stage"


def test_fingerprints_find_what_their_radius_covers(spark, monkeypatch):
    """Without any key of minima, pairs within the radius are still found by their fingerprints, and links are still decided on the sets."""
    r, texts = random.Random(12), []
    for k in range(40):
        base = [f"b{k}w{j}" for j in range(400 + r.randrange(200))]
        texts += [" ".join(base), " ".join(edited(r, base, f"{k}", True, 1))]
    texts += ["", " ", "one two", "ONE two", "one two three"]
    marks = minhash._marks
    monkeypatch.setattr(minhash, "_marks", lambda *a: marks(*a).withColumn("keys", F.array().cast("array<long>")))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.id: x.component for x in minhash.near_duplicates(docs).collect()}
    prints = [simhash.fold(minhash.shingle_set(t.encode(), 5)) for t in texts]
    within = [k for k in range(0, 80, 2) if ((prints[k] ^ prints[k + 1]) & (2**64 - 1)).bit_count() <= minhash.RADIUS]
    assert len(within) > 20
    assert got == {k: k - 1 if k % 2 and k - 1 in within else k for k in range(80)} | {80: 80, 81: 80, 82: 82, 83: 82, 84: 84}
