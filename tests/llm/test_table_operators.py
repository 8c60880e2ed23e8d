"""URL filters, top-k and chat formatting against SQL or brute force, with odd rows and empty tables; the pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import chat, queries, topk, urls

URLS = ["http://a.com/x", "https://WWW.Example.com/en/1?q=1", "http://example.com/en/", "http://m.example.com/en", "http://a.net/es/1#x", "http://net/fr/", "http://x.net/de/", None, "no scheme", "http://", "ftp://u@h.org:80/a?b#c", "http://a.com", "http://a.com?x/y", "http://xcom/", "http://a.co.uk/1", "http://me:pw@b.co.uk:8080/2", "http://co.uk/", "http://h1.s1.org:81/a"]


def as_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    got = con.sql(sql)
    return got.columns, {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got.fetchall()}


def test_urls(spark):
    rng = np.random.default_rng(1)
    rows = [(k, URLS[k % len(URLS)]) for k in range(200)] + [(3, URLS[3])] + [(500 + k, f"http://h{k % 9}.s{k % 4}.org/a") for k in range(200)]
    pages = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, host string, mean double")
    labels = spark.createDataFrame([(k, int(rng.random() < (0.3 if k % 9 == 2 else 0.95))) for k in range(0, 700, 2)] + [(1, None)], "doc_id long, quality int")
    got = urls.judge(pages, labels.where("quality is not null"), outcome_id="doc_id", good_col="quality")
    cols, want = as_sql(queries.OP2_SQL, pages=pages.select("page_id", "url").toPandas(), labels=labels.toPandas().astype({"quality": "Int64"}))
    assert {tuple(r[c] if c != "page_id" else r["id"] for c in cols) for r in got.collect()} == want
    assert {"allow", "block"} <= {r.verdict for r in got.where("rule is null").collect()}
    assert urls.judge(pages.limit(0), labels.limit(0), outcome_id="doc_id", good_col="quality").count() == 0
    assert urls.judge(pages, labels.limit(0), outcome_id="doc_id", good_col="quality").count() == len(rows)


@pytest.mark.parametrize("chunk, block", [(8192, 256), (3, 4)])
def test_top_k(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    v[50:90] = v[7]  # many ties
    rows = [(k, x.tolist(), "x", 1) for k, x in enumerate(v)] + [(400, None, "x", 1), (401, [1.0, None] + [0.0] * 6, "x", 1), (402, [float("nan")] + [0.0] * 7, "x", 1), (403, [float("inf")] + [0.0] * 7, "x", 1), (404, [], "x", 1), (405, [1.0, 2.0], "x", 1), (60, v[60].tolist(), "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string, width int")
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 20 = 0 or vec_id = 405"), 10).collect()]
    q = np.floor(v * 1024).astype(np.int64)
    ids = np.append(np.arange(300), 60)
    cells = np.vstack([q, q[60]])
    for query in range(0, 300, 20):
        pairs = sorted((-int(cells[k] @ q[query]), int(ids[k])) for k in range(len(ids)) if ids[k] != query)[:10]
        mine = sorted(r[1:] for r in got if r[0] == query)
        want = [(n + 1, i, -s) for n, (s, i) in enumerate(pairs)]
        assert mine == want
    assert not [r for r in got if r[0] == 405]  # no candidate of its length
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_leaves_blocks_out():
    rng = np.random.default_rng(3)
    blocks = [(np.arange(100) + 100 * b, (rng.normal(size=(100, 8)) * 50 + (2000 if b == 3 else 0)).astype(np.int64)) for b in range(20)]
    asked = np.full((1, 8), 10, np.int64)
    best, scored = topk.scan(blocks, np.array([-1]), asked, 10, np.array([topk.NONE]))
    everything = sorted(((int(asked[0] @ x), int(i)) for ids, m in blocks for i, x in zip(ids, m)), key=lambda p: (-p[0], p[1]))[:10]
    assert list(zip(best.scores[0].tolist(), best.ids[0].tolist())) == everything and scored == 1


def test_chat_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<s> \\ [INST] x [/INST]</s>"), (2, 0, "system", None), (2, 1, "user", "<|im_end|>\n"), (2, 2, "assistant", ""), (3, 5, None, "x\ny"), (3, 5, None, "x\ny"), (3, 2, "tool", "\\\\<|im_sep|>\\"), (None, 1, "user", "no id"), (4, 0, "user", "a" * 50000), (4, 1, "assistant", "<" * 999), (4, None, "assistant", "first")]
    talk = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    back = {r.id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(chat.records_of(talk), "id", "record"))).collect()}
    for i in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == i))
        assert [(t.role, t.content) for t in back[i].turns] == [r[2:] for r in own]
        assert back[i].trained == [r[3] for r in own if r[2] == "assistant"]
    assert chat.records_of(talk.limit(0)).count() == 0


def test_chat_layouts(spark):
    records = {
        1: '{"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}',
        2: '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        3: '{"prompt": "q", "response": "a"}',
        4: '{"output": "a", "instruction": "q", "input": "more"}',
        5: '{"question": "q", "answer": null}',
        6: '{"unknown": 1}',
        7: "no json",
        8: None,
        9: '{"messages": []}',
    }
    got = {r.id: r for r in chat.canonical_turns(spark.createDataFrame(list(records.items()), "id int, record string"), "id", "record").collect()}
    turns = {k: None if r.turns is None else [(t.role, t.content) for t in r.turns] for k, r in got.items()}
    assert turns == {1: [("user", "q"), ("assistant", "a")], 2: [("user", "q"), ("assistant", "a")], 3: [("user", "q"), ("assistant", "a")], 4: [("user", "q\n\nmore"), ("assistant", "a")], 5: [("user", "q"), ("assistant", "")], 6: None, 7: None, 8: None, 9: []}
    assert [got[k].layout for k in (1, 2, 3, 4, 6)] == ["messages", "shared", "prompt_response", "instruction", None]
    assert chat.read_back(chat.format_turns(chat.canonical_turns(spark.createDataFrame([(9, records[9])], "id int, record string"), "id", "record"))).first().turns == []


def test_pipeline(spark, tmp_path, odd):
    import corpus_pipeline

    long = "a clean story of some length that goes on for a while with many plain words in it to make shingles of "
    docs = [(k, f"{long} number {k} " + " ".join(f"w{k * 31 + j}" for j in range(60)), "en", f"s{k % 3}", 1) for k in range(120)]
    docs += [(200 + k, docs[5][1], "en", "s0", 1) for k in range(5)]  # exact copies
    docs += [(300 + k, docs[7][1].replace(f"w{7 * 31 + 30}", f"x{k}"), "en", "s1", 1) for k in range(5)]  # near copies
    docs += [(400 + k, f"{long} you idiot scumbag {k} " + " ".join(f"v{k * 17 + j}" for j in range(20)), "en", "s2", 1) for k in range(60)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    base = spark.createDataFrame(docs, columns).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000))
    base.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], 1, int(d[0] >= 400)) for d in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    clean = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).cache()
    left = {r.doc_id for r in clean.collect()}
    assert set(range(120)) <= left and not any(x in left for x in range(400, 460)) and clean.columns == [c.split()[0] for c in columns.split(", ")]
    single = corpus_pipeline.STAGES[1][1](spark, clean, str(tmp_path))
    kept = sorted((r.doc_id for r in single.collect()), key=lambda x: (x is not None, x))
    assert set(range(120)) <= set(kept) and not any(x in kept for x in [*range(200, 205), *range(300, 305)]) and len(kept) == len(set(kept))
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} == {k.split("_")[0] for k in queries.queries()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
