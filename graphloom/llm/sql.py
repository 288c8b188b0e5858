"""DuckDB SQL for the corpus queries that SQL can express, in the same words as the operators' definitions."""

from __future__ import annotations

from graphloom.llm import urls


def url_filter() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{h}{p}', '{v}')" for h, p, v in urls.RULES)
    return f"""
WITH rules(rh, rp, rule, verdict) AS (VALUES {rules}),
cut AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
links AS (SELECT DISTINCT host, path FROM cut),
best AS (SELECT host, path, arg_max(struct_pack(rule := rule, verdict := verdict), length(rule) * 10000 + length(rh)) AS r
         FROM links JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT c.page_id, c.host, c.path, b.r.rule AS rule, coalesce(b.r.verdict, '{urls.DEFAULT}') AS verdict
FROM cut c LEFT JOIN best b ON c.host = b.host AND c.path = b.path"""


LINE_DEDUP = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM docs WHERE text IS NOT NULL),
filled AS (SELECT doc_id, pos, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM numbered WHERE trim(line) <> ''),
windows AS (SELECT doc_id, n, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS win FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
placed AS (SELECT doc_id, n, first_value(doc_id) OVER w AS fd, first_value(n) OVER w AS fn, row_number() OVER w AS k
           FROM windows WHERE win IS NOT NULL WINDOW w AS (PARTITION BY win ORDER BY doc_id, n)),
spans AS (SELECT doc_id, CASE WHEN doc_id = fd THEN greatest(n, fn + 3) ELSE n END AS a, n + 2 AS b FROM placed WHERE k > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS n FROM spans),
gone AS (SELECT f.doc_id, f.pos FROM filled f SEMI JOIN covered c ON f.doc_id = c.doc_id AND f.n = c.n),
touched AS (SELECT DISTINCT doc_id FROM spans),
kept AS (SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.pos) AS text FROM numbered m SEMI JOIN touched t ON m.doc_id = t.doc_id
         ANTI JOIN gone g ON m.doc_id = g.doc_id AND m.pos = g.pos GROUP BY m.doc_id)
SELECT d.doc_id, CASE WHEN t.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN touched t ON d.doc_id = t.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""


PREFERENCE = """
WITH ordered AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
                        count(*) OVER (PARTITION BY conv_id) AS size FROM conversations),
last AS (SELECT conv_id, text FROM ordered WHERE n = size),
both_sides AS (SELECT o.conv_id, n, role, text AS c, text AS r, size FROM ordered o WHERE n < size
          UNION ALL SELECT o.conv_id, n, role, o.text, coalesce(p.text, ''), size FROM ordered o LEFT JOIN last p ON p.conv_id = xor(o.conv_id, 1) WHERE n = size),
cut AS (SELECT conv_id, coalesce(min(n) FILTER (WHERE c <> r) - 1, max(size)) AS k FROM both_sides GROUP BY conv_id),
shown AS (SELECT b.conv_id, b.n, b.n <= k AS head, k, role = 'assistant' AS own, length(role) + 5 AS h, '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS c,
                 '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS r, length(c) AS cn, length(r) AS rn FROM both_sides b JOIN cut USING (conv_id)),
placed AS (SELECT *, sum(CASE WHEN head THEN 0 ELSE length(c) END) OVER w - length(c) + h AS cs, sum(CASE WHEN head THEN 0 ELSE length(r) END) OVER w - length(r) + h AS rs
           FROM shown WINDOW w AS (PARTITION BY conv_id ORDER BY n))
SELECT conv_id, CAST(max(k) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(c, '' ORDER BY n) FILTER (WHERE head), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY n) FILTER (WHERE NOT head), '') AS chosen,
       coalesce(string_agg(cs || '-' || (cs + cn), ',' ORDER BY n) FILTER (WHERE NOT head AND own), '') AS chosen_mask,
       coalesce(string_agg(r, '' ORDER BY n) FILTER (WHERE NOT head), '') AS rejected,
       coalesce(string_agg(rs || '-' || (rs + rn), ',' ORDER BY n) FILTER (WHERE NOT head AND own), '') AS rejected_mask
FROM placed GROUP BY conv_id"""


PHRASES = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM worded, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size),
counted AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM counted WHERE size > 1),
scored AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cuts c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ') JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS p FROM scored) WHERE p = 1),
within AS (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM (SELECT lang, f, string_split(phrase, ' ') AS w FROM counted WHERE size = 3)),
covered AS (SELECT DISTINCT c.lang, c.phrase FROM lowest c JOIN within v ON c.lang = v.lang AND c.phrase = v.phrase WHERE 100 * v.f >= 50 * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest ANTI JOIN covered USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


_WHOLE = """whole AS (SELECT vec_id, {more}list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

TOPK = f"""
WITH {_WHOLE.format(more="")},
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM whole q, whole c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


def vector_codes(rounds: int = 4) -> str:
    """Each round: the nearest entry of each part by squared distance, then floors of means; sums of whole numbers below 2**53 are exact."""
    ctes = [
        _WHOLE.format(more="label, "),
        "parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM whole, range(4) r(p))",
        "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT 256))",
    ]
    for n in range(rounds + 1):
        ctes.append(f"""coded{n} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(i, (d, i)) AS i, min(d) AS d FROM (
  SELECT vec_id, label, b.p, x, i, list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c) AS d FROM parts a JOIN book{n} b ON a.p = b.p) GROUP BY vec_id, label, p, x)""")
        if n < rounds:
            ctes.append(f"""means{n} AS (SELECT p, i, list(m ORDER BY j) AS c FROM (SELECT p, i, j, floor(sum(y) / count(*)) AS m FROM (SELECT p, i, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM coded{n}) GROUP BY p, i, j) GROUP BY p, i)""")
            ctes.append(f"book{n + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN means{n} m ON b.p = m.p AND b.i = m.i)")
    ctes.append(f"final AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(i)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM coded{rounds} GROUP BY vec_id, label)")
    ctes.append(f"digest AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, i, j)) AS codebooks_sha256 FROM (SELECT p, i, unnest(c) AS y, generate_subscripts(c, 1) AS j FROM book{rounds}))")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM final, digest"


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP, "op3_url_filter": url_filter(), "op8_preference": PREFERENCE, "op11_phrases": PHRASES, "op12_topk": TOPK, "op13_codes": vector_codes()}
