"""The queries of this subpackage and, where SQL can express them, DuckDB SQL for the same rows."""

from __future__ import annotations

import corpus_pipeline
from termweave.llm import chat, media, mixing, packing, simhash, suffix_tree, token_files, topk, toxicity, urls

OP2_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
c AS (SELECT page_id, regexp_extract(coalesce(r, ''), '^[^?#]*') AS r FROM p),
u AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_replace(r, '^[^/]*', '') AS path FROM c),
o AS (SELECT doc_id, max(quality)::DOUBLE AS g FROM labels WHERE quality IS NOT NULL GROUP BY 1),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM u),
x AS (SELECT name AS host, string_split(name, '.') AS parts, count(g)::DOUBLE AS n, coalesce(sum(g), 0)::DOUBLE AS good FROM b LEFT JOIN o ON page_id = doc_id GROUP BY name),
h AS (SELECT host, array_to_string(parts[-(k + 1):], '.') AS domain, array_to_string(parts[-k:], '.') AS suffix, n, good FROM (SELECT *, CASE WHEN array_to_string(parts[-2:], '.') IN (SUFFIXES) THEN 2 ELSE 1 END AS k FROM x)),
a AS (SELECT (coalesce(sum(good), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT m FROM a) AS m FROM h WHERE n > 0 GROUP BY 1),
s1 AS (SELECT *, (SELECT 1 / coalesce(least(greatest(sum((good - n * m) ** 2 / n - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001::DOUBLE), 0.5::DOUBLE), 0.5::DOUBLE) - 1 FROM s0) AS k FROM s0),
s AS (SELECT suffix, (good + k * m) / (n + k) AS mean, (good + k * m) * (n - good + k * (1 - m)) / ((n + k) ** 2 * (n + k + 1)) AS var FROM s1),
d0 AS (SELECT h.domain, sum(n) AS n, sum(good) AS good, s.mean AS m FROM h JOIN s USING (suffix) WHERE n > 0 GROUP BY h.domain, s.mean),
d1 AS (SELECT *, (SELECT 1 / coalesce(least(greatest(sum((good - n * m) ** 2 / n - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001::DOUBLE), 0.5::DOUBLE), 0.5::DOUBLE) - 1 FROM d0) AS k FROM d0),
d AS (SELECT domain, (good + k * m) / (n + k) AS mean, (good + k * m) * (n - good + k * (1 - m)) / ((n + k) ** 2 * (n + k + 1)) AS var FROM d1),
h0 AS (SELECT h.host, n, good, d.mean AS m FROM h JOIN d USING (domain) WHERE n > 0),
h1 AS (SELECT *, (SELECT 1 / coalesce(least(greatest(sum((good - n * m) ** 2 / n - m * (1 - m)) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.001::DOUBLE), 0.5::DOUBLE), 0.5::DOUBLE) - 1 FROM h0) AS k FROM h0),
hh AS (SELECT host, (good + k * m) / (n + k) AS mean, (good + k * m) * (n - good + k * (1 - m)) / ((n + k) ** 2 * (n + k + 1)) AS var FROM h1),
r AS (SELECT h.host, coalesce(hh.mean, d.mean, s.mean, (SELECT m FROM a)) AS mean, coalesce(hh.var, d.var, s.var, (SELECT m * (1 - m) FROM a)) AS var FROM h LEFT JOIN hh USING (host) LEFT JOIN d ON h.domain = d.domain LEFT JOIN s ON h.suffix = s.suffix),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT b.page_id, b.host, b.path, f.rule, coalesce(f.v, CASE WHEN r.mean - 2 * sqrt(r.var) >= 0.8 THEN 'allow' ELSE 'block' END) AS verdict, round(r.mean, 6) AS mean, round(r.mean - 2 * sqrt(r.var), 6) AS bound
FROM b JOIN r ON b.name = r.host LEFT JOIN f ON f.page_id = b.page_id
""".replace("SUFFIXES", ", ".join(f"'{x}'" for x in urls.SUFFIXES))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN w * level >= cap THEN cap ELSE least(cap, w * max(CASE WHEN w * level < cap THEN level END) OVER ()) END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - whole * source_size AS budget FROM t),
g AS (SELECT source, h, sum(size)::DOUBLE AS words FROM d GROUP BY 1, 2),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
o AS (SELECT p.source, budget, min(h) AS h, arg_min(upto, h) AS over, arg_min(upto - words, h) AS done FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source WHERE budget > 0 AND upto > budget GROUP BY 1, 2),
b AS (SELECT source, h + CASE WHEN over - budget < budget - done THEN 1 ELSE 0 END AS below FROM o)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN h < coalesce(below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(role || chr(1) || text, '\', '\'), '<|im_start|>', '<\|im_start|>'), '<|im_sep|>', '<\|im_sep|>'), '<|im_end|>', '<\|im_end|>'),
  '<|endoftext|>', '<\|endoftext|>'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(escaped) - 1 + length('<|im_start|><|im_sep|><|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


OP8_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY 1),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_files": token_files.op1_token_files,
        "op2_urls": urls.op2_urls,
        "op3_packing": packing.op3_packing,
        "op4_simhash": simhash.op4_simhash,
        "op5_suffix_tree": suffix_tree.op5_suffix_tree,
        "op6_media": media.op6_media,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_top_k": topk.op8_top_k,
        "op9_mixing": mixing.op9_mixing,
        "op10_chat": chat.op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_urls": OP2_SQL, "op8_top_k": OP8_SQL, "op9_mixing": OP9_SQL, "op10_chat": OP10_SQL}
