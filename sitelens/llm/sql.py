"""What the registered queries return, in SQL over the given tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

def near_dup(documents: str = "documents", size: int = 4) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM {documents}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + {size - 1}], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {size - 1}) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r AS (SELECT DISTINCT i AS id, i AS reached FROM e UNION SELECT r.id, e.j FROM r JOIN e ON e.i = r.reached),
m AS (SELECT id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(m.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id
"""

# the table of the checksum: eight steps of the polynomial for each byte
_STEP = "CASE WHEN {0} % 2 = 1 THEN xor(3988292384, {0} // 2) ELSE {0} // 2 END"
_CRC_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, x8 AS v FROM " + "".join(f"(SELECT i, {_STEP.format(f'x{k}')} AS x{k + 1} FROM " for k in range(7, -1, -1)) + "(SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS x0 FROM range(256) AS r(i))" + ")" * 8 + ")"

def shards(documents: str = "documents") -> str:
    return f"""
WITH c AS ({_CRC_TABLE}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM {documents}),
y AS (SELECT doc_id, list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(concat('0x', h) AS BIGINT))) AS bytes FROM d),
k AS (SELECT d.doc_id, CAST(strlen(text) AS BIGINT) + 1 AS size, CAST(concat('0x', substr(md5(text), 1, 15)) AS BIGINT) AS h,
      xor(list_reduce(bytes, lambda a, x: xor(a // 256, c.t[CAST(xor(a, x) % 256 AS INT) + 1])), 4294967295) AS text_crc32
      FROM d JOIN y USING (doc_id), c),
o AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id) - size AS before FROM k),
g AS (SELECT h, min(before) AS first, max(before + size) AS last FROM o GROUP BY 1),
t AS (SELECT i, CAST(ceil(i * total / 16.0) AS BIGINT) AS target, CAST(floor(total * CAST(0.01 AS DOUBLE) / 16) AS BIGINT) AS tolerance FROM (SELECT unnest(range(1, 16)) AS i), (SELECT sum(size) AS total FROM k)),
b AS (SELECT i, CASE WHEN least(target - first, last - target) > tolerance THEN before + size WHEN target - first <= last - target THEN first ELSE last END AS at
      FROM t JOIN o ON before < target AND target <= before + size JOIN g USING (h)),
s AS (SELECT o.*, CAST((SELECT count(*) FROM b WHERE b.at <= o.before) AS INT) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""

_LEVELS = """
SELECT doc_id, lang, source, concat('d', CAST(coalesce(CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT) % 3, 0) AS VARCHAR)) AS l1,
  coalesce(lang, '(none)') AS l2, coalesce(source, '(none)') AS l3, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM {documents}
"""


def _filled(depth: int, epochs: int) -> str:
    """Budgets of the nodes of one level, from those of the level above."""
    path = [f"l{k}" for k in range(1, depth + 1)]
    above = path[:-1]
    over = f"PARTITION BY {', '.join(above)} " if above else ""
    weight = {1: "CASE l1 WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END", 2: "CASE l2 WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END", 3: "1"}[depth]
    order = f"{over}ORDER BY CAST(c AS DOUBLE) / w, {path[-1]}"
    parent = f"JOIN b{depth - 1} p USING ({', '.join(above)})" if above else f"CROSS JOIN (SELECT least(sum(n) * CAST(0.8 AS DOUBLE), CAST(sum(n) * {epochs} AS DOUBLE)) AS b FROM d) p"
    return f"""
n{depth} AS (SELECT {', '.join(path)}, sum(n) * {epochs} AS c, {weight} AS w FROM d GROUP BY {', '.join(path)}),
x{depth} AS (SELECT {', '.join(path)}, c, w, (b - coalesce(sum(c) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM n{depth} {parent}),
b{depth} AS (SELECT {', '.join(path)}, least(CAST(c AS DOUBLE), greatest(0.0, w * max(x) OVER ({over}))) AS b FROM x{depth})"""


def mix(documents: str = "documents", epochs: int = 3) -> str:
    return f"""
WITH d AS ({_LEVELS.format(documents=documents)}), {_filled(1, epochs)}, {_filled(2, epochs)}, {_filled(3, epochs)},
t AS (SELECT l1, l2, l3, sum(n) AS tokens, least(CASE WHEN sum(n) > 0 THEN floor(any_value(b) / sum(n)) ELSE 0 END, {epochs}) AS whole, any_value(b) AS b FROM d JOIN b3 USING (l1, l2, l3) GROUP BY 1, 2, 3),
o AS (SELECT d.*, whole, CASE WHEN whole < {epochs} THEN greatest(0, floor(t.b - whole * tokens)) ELSE 0 END AS rest, CAST(concat('0x', substr(md5(concat('0-', CAST(CAST(whole AS BIGINT) AS VARCHAR), '-', CAST(doc_id AS VARCHAR))), 1, 15)) AS BIGINT) AS h FROM d JOIN t USING (l1, l2, l3)),
u AS (SELECT *, sum(n) OVER (PARTITION BY l1, l2, l3 ORDER BY h, CAST(doc_id AS VARCHAR)) AS upto FROM o)
SELECT doc_id, lang, source, CAST(e AS INT) AS epoch, n AS n_tokens
FROM (SELECT *, unnest(range(0, CAST(whole AS BIGINT) + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS e FROM u)
"""

BACKOFF = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, k, w[k] AS w2, CASE WHEN k > 1 THEN w[k - 1] END AS w1 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
u AS (SELECT w2 AS w, count(*) AS c FROM t GROUP BY 1),
b AS (SELECT w1, w2, count(*) AS c FROM t WHERE w1 IS NOT NULL GROUP BY 1, 2),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
s AS (SELECT t.doc_id, sum(CASE WHEN b.c IS NOT NULL THEN log10(CAST(b.c AS DOUBLE) / x.c) WHEN t.w1 IS NULL THEN log10(y.c / n.n) ELSE log10(0.4) + log10(y.c / n.n) END) AS score
      FROM t JOIN u y ON y.w = t.w2 LEFT JOIN u x ON x.w = t.w1 LEFT JOIN b ON b.w1 = t.w1 AND b.w2 = t.w2, n GROUP BY 1)
SELECT doc_id, len(w) AS n_words, round(coalesce(score, 0), 4) AS log10_score FROM d LEFT JOIN s USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
WHERE rank <= 20
"""

_PARTS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontaminate(documents: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, {_PARTS} AS w FROM {documents}),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PARTS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[k:k + 12], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
x AS (SELECT doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)),
h AS (SELECT doc_id, k, x.size, item FROM x JOIN g ON g.win = x.win AND g.size = x.size),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""


#: The stages of the pipeline, each over the rows that the one before it kept.
PIPELINE = f"""
WITH s1 AS (SELECT * FROM documents WHERE regexp_matches(text, '\\pL')),
r2 AS ({near_dup("s1", 5)}), s2 AS (SELECT s1.* FROM s1 JOIN r2 USING (doc_id) WHERE kept),
r3 AS ({decontaminate("s2")}), s3 AS (SELECT s2.* FROM s2 JOIN r3 USING (doc_id) WHERE NOT contaminated),
r4 AS ({mix("s3", 1)}), s4 AS (SELECT s3.* FROM s3 JOIN r4 USING (doc_id)),
r5 AS ({shards("s4")})
SELECT s4.*, size, shard, slot FROM s4 JOIN r5 USING (doc_id)
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
