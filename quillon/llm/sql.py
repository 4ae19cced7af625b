"""DuckDB SQL that the registered queries must equal, over whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP3 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, host, path, arg_max(struct_pack(r := h || p, v := verdict), length(h || p)) AS best
  FROM split JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY ALL
)
SELECT s.page_id, s.host, s.path, f.best.r AS rule, coalesce(f.best.v, 'allow') AS verdict
FROM split s LEFT JOIN (SELECT DISTINCT page_id, best FROM fits) f USING (page_id)
"""

OP5 = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(1, floor(sqrt((SELECT count(*) FROM documents)))::BIGINT) AS bucket
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source::BLOB) AS i FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((i - 1) % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM weighed
), fill AS (SELECT arg_min(lam, (cap / w, i)) AS lam FROM levels WHERE lam <= cap / w),
targets AS (
  SELECT l.source, source_size, least(cap, w * f.lam) AS target,
         ('0x' || substr(md5('20:' || coalesce(l.source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM levels l, fill f
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY s.source ORDER BY size, bucket, doc_id) AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(k * rate + u) - floor((k - 1) * rate + u)))::BIGINT AS taken FROM ranked
"""

_ESC = "replace(coalesce(text, ''), chr(92), chr(92) || chr(92))"
for _mark in ("</s>", "<</SYS>>", "<<SYS>>", "<s>", "[/INST]", "[/ROLE]", "[=]", "[INST]", "[ROLE]"):
    _ESC = f"replace({_ESC}, '{_mark}', '{_mark[0]}' || chr(92) || '{_mark[1:]}')"
_ESC_ROLE = _ESC.replace("coalesce(text, '')", "coalesce(role, '')")

OP9 = f"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         length({_ESC}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 16 + length({_ESC_ROLE}) END AS chars FROM turns
), moves AS (
  SELECT *, row_number() OVER w - 1 AS spot, lag(role, 1, '') OVER w AS prev, count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), judged AS (
  SELECT conv_id, min(spot) FILTER (WHERE (prev, role) NOT IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))) AS bad,
         max(n) FILTER (WHERE spot = n - 1 AND role != 'assistant') AS unended FROM moves GROUP BY conv_id
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars, any_value(coalesce(bad, unended)) IS NULL AS valid, any_value(coalesce(bad, unended))::BIGINT AS invalid_turn
FROM sized JOIN judged USING (conv_id) GROUP BY conv_id
"""

OP10 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM docs, lengths, unnest(range(1, len(w) - n + 2)) t(i)
), hits AS (SELECT doc_id, item_id, i, d.n FROM doc_windows d JOIN item_windows USING (n, phrase)),
hit_words AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hits, unnest(range(0, n)) t(o) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
), postings AS (
  SELECT doc_id, w[i] AS term, i FROM docs, unnest(range(1, len(w) + 1)) t(i)
), counts AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
ranked AS (
  SELECT item_id, w, term, row_number() OVER (PARTITION BY item_id, w ORDER BY coalesce(df, 0), term) AS k
  FROM (SELECT DISTINCT item_id, w, unnest(w) AS term FROM items WHERE len(w) > 0) LEFT JOIN counts USING (term)
  QUALIFY k <= 3
), needs AS (SELECT item_id, w, max(k) AS need FROM ranked GROUP BY ALL),
near AS (
  SELECT r.item_id, r.w, p.doc_id, p.i, count(DISTINCT o.k) AS k
  FROM ranked r JOIN postings p ON r.k = 1 AND r.term = p.term
  LEFT JOIN (SELECT s.item_id, s.w, s.k, q.doc_id, q.i FROM ranked s JOIN postings q ON s.k > 1 AND s.term = q.term) o
    ON o.item_id = r.item_id AND o.w = r.w AND o.doc_id = p.doc_id AND abs(o.i - p.i) <= 25
  GROUP BY ALL
), near_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN needs USING (item_id, w) WHERE k = need - 1 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""

OP6 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), []) AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

OP2 = rf"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM docs, unnest(range(1, len(w) - 18)) t(i)
), later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, i + o AS p FROM later, unnest(range(0, 20)) t(o)),
words AS (SELECT doc_id, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP11 = """
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
  SELECT a.id AS a, a.vec_id AS anchor_id, b.id AS b, b.vec_id, a.label = b.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score
  FROM kept a JOIN kept b ON a.id != b.id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST, s.b))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON p.a = s.a AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def _op13(clusters: int = 8, rounds: int = 10) -> str:
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < {clusters}
)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT id, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT k.id, k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept k, c{r} c
  ) GROUP BY id
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS v
    FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) t(i) GROUP BY c, i) GROUP BY c
  ) m USING (c)
)""")
    return ", ".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k USING (c)
"""


OP13 = _op13()

MEDIA_PAYLOADS = r"""
WITH sized AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
padded AS (SELECT doc_id, octet_length(b) AS n, (64 * greatest(1, ceil(octet_length(b) / 64)))::BIGINT AS p, b FROM sized)
SELECT doc_id, n::BIGINT AS n_bytes, p AS payload_bytes, sha256(b || repeat('\x00'::BLOB, p - n)) AS payload_sha256 FROM padded
"""

SHARD_LAWS = """
SELECT count(*)::BIGINT AS documents, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, 'bytes' AS law, 8::BIGINT AS shards, TRUE AS gapless, TRUE AS near_equal FROM documents
"""

SQL = {"media_payloads": MEDIA_PAYLOADS, "shard_laws": SHARD_LAWS, "op2_substring_dedup": OP2, "op3_url_filters": OP3, "op5_mixing": OP5, "op6_ngram_jaccard": OP6, "op9_chat_formatting": OP9, "op10_decontamination": OP10, "op11_hard_negatives": OP11, "op13_centroid_clustering": OP13}
