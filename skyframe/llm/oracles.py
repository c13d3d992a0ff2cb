"""DuckDB SQL for those queries that SQL can express."""

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def _shingles(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s
      FROM (SELECT {key}, {_WORDS} AS ws FROM {table} WHERE text IS NOT NULL) WHERE len(ws) > 0"""


OP7 = f"""WITH RECURSIVE sh AS MATERIALIZED ({_shingles("documents", "doc_id")}),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
comp AS (SELECT d, min(r) AS c FROM reach GROUP BY 1)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.c AS component_id, documents.doc_id = comp.c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN comp ON comp.d = documents.doc_id"""

OP8 = f"""WITH d AS ({_shingles("documents", "doc_id")}), i AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS common FROM d JOIN i USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, common, n AS item_shingles FROM c JOIN n USING (item_id) WHERE 100 * common >= 80 * n"""

OP4 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 100 = 0 GROUP BY 1) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

OP10 = """WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(floor(turn / 512), -4611686018427387904)::BIGINT AS part FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, role, text) - 1 AS number FROM r),
p AS (SELECT *, number // 512 AS piece FROM n),
w AS (SELECT DISTINCT conv_id, role AS participant FROM r WHERE role <> 'system'),
e AS (SELECT p.*, participant, role = participant AS learn,
  '<|im_start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
  text || '<|im_end|>' || chr(10) AS body FROM p JOIN w ON p.conv_id IS NOT DISTINCT FROM w.conv_id),
f AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, part, piece ORDER BY number) AS stop FROM e),
g AS (SELECT conv_id, participant, part, piece, count(*) AS n_messages, string_agg(head || body, '' ORDER BY number) AS text,
  coalesce(string_agg((stop - length(body))::BIGINT || '-' || stop::BIGINT, ',' ORDER BY number) FILTER (WHERE learn), '') AS spans FROM f GROUP BY ALL)
SELECT conv_id, participant, part, piece, n_messages, (sum(length(text)) OVER (PARTITION BY conv_id, participant ORDER BY part, piece) - length(text))::BIGINT AS char_start, text, spans FROM g"""

#: Whole-number arithmetic but for one square root; the fold picks, slot by slot, the least deadline of what is released.
OP5 = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS s0, source, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS MATERIALIZED (SELECT s0, count(*) AS docs, floor(sqrt(count(*)::DOUBLE) * 1000)::BIGINT AS units FROM d GROUP BY 1),
b AS MATERIALIZED (SELECT greatest(64, max(ceil((docs * (SELECT sum(units) FROM u) // units + 1)::DOUBLE / 131072)))::BIGINT AS per FROM u),
l AS MATERIALIZED (SELECT list(s0 ORDER BY s0) AS s, list(units ORDER BY s0) AS w, sum(units)::BIGINT AS total,
  least(sum(units), max(((docs + per - 1) // per * (SELECT sum(units) FROM u) + units - 1) // units))::BIGINT AS slots FROM u, b),
f(t, had, pick) AS (
  SELECT -1::BIGINT, list_transform(w, lambda x: 0::BIGINT), 0::BIGINT FROM l
  UNION ALL
  SELECT t, list_transform(had, lambda h, i: CASE WHEN i = pick THEN h + 1 ELSE h END), pick FROM (
    SELECT t + 1 AS t, had, list_sort(list_transform(list_filter(range(1, len(w) + 1), lambda i: (had[i] * total) // w[i] <= t + 1),
      lambda i: ((had[i] + 1) * total + w[i] - 1) // w[i] * 1000000 + i))[1] % 1000000 AS pick FROM f, l WHERE t + 1 < slots)),
p AS MATERIALIZED (SELECT s[pick] AS s0, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM f, l WHERE t >= 0 AND pick IS NOT NULL),
n AS (SELECT doc_id, source, s0, row_number() OVER (PARTITION BY s0 ORDER BY h, doc_id) - 1 AS k FROM d)
SELECT doc_id, source, k // per AS mix_block, (k // per) // units * total + slot AS mix_slot, (k % per)::BIGINT AS mix_rank
FROM n JOIN u USING (s0) JOIN p ON p.s0 = n.s0 AND p.turn = (k // (SELECT per FROM b)) % units, l, b"""

OP11 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS MATERIALIZED (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN m USING (doc_id)),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT f.*, filter_order, step::INT AS step, filter_order[step] AS filter,
  length(translate(filter_order[:step - 1], fails, '')) < step - 1 AS earlier, contains(fails, filter_order[step]) AS here FROM f, o, range(1, 6) r(step)),
g AS (SELECT part, filter_order, step, filter, count(*) FILTER (WHERE NOT earlier AND NOT here) AS kept, count(*) FILTER (WHERE NOT earlier AND here) AS removed,
  count(*) FILTER (WHERE earlier AND here) AS redundant, count(*) FILTER (WHERE fails = filter) AS unique_fails,
  count(*) FILTER (WHERE NOT earlier AND here AND good) AS good_lost, count(*) FILTER (WHERE NOT earlier AND here AND toxic) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley, filter FROM g"""



def _lloyd(rounds: int = 4) -> str:
    """Plain Lloyd rounds over all pairs of a part and an entry; integers below 2^53 are exact as doubles."""
    sql = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, q) - 1 AS n, len(q) // 4 AS w FROM v),
x AS MATERIALIZED (SELECT n, part, q[part * w + 1 : part * w + w] AS x FROM n, range(4) r(part)),
b0 AS MATERIALIZED (SELECT part, n AS e, x AS c FROM x WHERE n < 256)"""
    for r in range(rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT n, part, any_value(x) AS x, min(256 * (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) + e)::BIGINT AS best FROM x JOIN b{r} USING (part) GROUP BY 1, 2)"""
        if r < rounds:
            sql += f""",
s{r} AS (SELECT part, best % 256 AS e, i, floor(sum(x[i]) / count(*)) AS m FROM a{r}, range(1, 1 + (SELECT max(w) FROM n)) t(i) GROUP BY 1, 2, 3),
b{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN (SELECT part, e, list(m ORDER BY i) AS c FROM s{r} GROUP BY 1, 2) m USING (part, e))"""
    return (
        sql
        + f""",
d AS (SELECT n, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256 FROM d JOIN n USING (n)"""
    )


OP13 = _lloyd()

ORACLES = {"op13_vector_codes": OP13, "op11_filter_audit": OP11, "op4_bit_sliced_top_k": OP4, "op5_source_mixing": OP5, "op7_minhash_near_dedup": OP7, "op8_decontamination": OP8, "op10_chat_formatting": OP10}
