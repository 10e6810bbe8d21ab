"""DuckDB statements of the same results, for those queries that SQL can express."""

from __future__ import annotations

from .sharding import MULTIPLIER, SALTS
from .spotsigs import ANCHORS, CHAIN, NEAR, REACH

WORD = r"[^\x20\x09-\x0D]+"


def mixing() -> str:
    draw = "('0x' || substr(md5(coalesce('mix:' || source, 'mix;null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w, source_size * 2 AS cap,
  sum(source_size) OVER ()::DOUBLE * 1.5 AS budget FROM s),
f AS (SELECT *, cap * (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
  <= (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) * w AS is_full FROM r),
l AS (SELECT (max(budget) - coalesce(sum(cap) FILTER (is_full), 0)::DOUBLE) / nullif(coalesce(sum(w) FILTER (NOT is_full), 0), 0)::DOUBLE AS level FROM f),
g AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE least(level * w, cap::DOUBLE) END AS target FROM f, l),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id % 64, doc_id) AS nth FROM d),
t AS (SELECT n.doc_id, n.size, g.source_size, g.target, n.nth, {draw.replace("source", "n.source")} AS u,
  CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, least(floor(rate * nth + u) - floor(rate * (nth - 1) + u), 2)::BIGINT AS copies FROM t)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"""


def _jump(shards: int) -> tuple[str, str]:
    """Common table expressions j{shards}_0.. and the name of the last: (doc_id, b)."""
    at = f"j{shards}"
    out = [f"{at}_0 AS (SELECT DISTINCT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id END)::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM d)"]
    for i in range(shards):
        nxt = f"(k * {MULTIPLIER} + 1) % 18446744073709551616::HUGEINT"
        out.append(f"{at}_{i + 1} AS (SELECT doc_id, k2 AS k, CASE WHEN j < {shards} THEN j ELSE b END AS b, CASE WHEN j < {shards} THEN "
                   f"floor((j + 1) * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT ELSE j END AS j FROM (SELECT *, {nxt} AS k2 FROM {at}_{i}))")
    return ",\n".join(out), f"{at}_{shards}"


def sharding() -> str:
    eight, last8 = _jump(8)
    nine, last9 = _jump(9)
    return f"""
WITH RECURSIVE t(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT coalesce(doc_id, -1) AS doc_id, coalesce(text, '') AS text FROM documents),
{eight},
{nine},
h AS (SELECT *, hex(encode(text)) AS x FROM d),
s AS (SELECT h.doc_id, strlen(text) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) AS text_crc32,
  b8.b::INT AS shard, b9.b::INT AS grown_shard, (o.k // 4294967296) % {SALTS} AS salt
  FROM h JOIN {last8} b8 ON h.doc_id = b8.doc_id JOIN {last9} b9 ON h.doc_id = b9.doc_id JOIN j8_1 o ON h.doc_id = o.doc_id, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY salt, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s"""


def _signatures(table: str, text: str, name: str) -> str:
    anchors = ", ".join(f"'{w}'" for w in ANCHORS)
    ahead = " || ".join(f"coalesce(tails[i + {k}], '')" for k in range(1, REACH + 2))
    return f"""
{name}_w AS (SELECT *, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}]+'), lambda w: w <> '') AS words FROM {table}),
{name}_m AS (SELECT * EXCLUDE (words), array_to_string(list_transform(words, lambda w: CASE WHEN w IN ({anchors}) THEN '#' || w ELSE w END), ' ') || ' ' AS marked FROM {name}_w),
{name}_p AS (SELECT *, string_split(marked, '#') AS parts FROM {name}_m),
{name}_t AS (SELECT *, list_transform(parts, lambda s: substr(s, instr(s, ' ') + 1)) AS tails FROM {name}_p),
{name} AS (SELECT * EXCLUDE (marked, parts, tails), coalesce(list_sort(list_distinct(list_transform(CASE WHEN len(parts) > 1
  THEN list_transform(range(1, len(parts)), lambda i: string_split(parts[i + 1], ' ')[1] || ':' || array_to_string(string_split({ahead}, ' ')[1:{CHAIN}], ' '))
  WHEN {text} = '' THEN [] ELSE [CASE WHEN trim(marked) = '' THEN {text} ELSE marked END] END, lambda s: substr(md5(s), 1, 16)))), []) AS sigs FROM {name}_t)"""


def spotsigs() -> str:
    def near(a: str, b: str) -> str:
        both = f"len(list_intersect({a}, {b}))"
        return (f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 "
                f"ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END::DOUBLE")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{_signatures("d", "text", "a")},
n AS (SELECT *, length(text) AS n_chars, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
  coalesce(lead(sigs) OVER w, first_value(sigs) OVER w) AS next_sigs FROM a WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC)),
e AS (SELECT doc_id, n_chars, sigs AS own, next_sigs, left(text, n_chars - n_chars // 3) || CASE WHEN n_chars // 3 > 0 THEN left(next_text, n_chars // 3) ELSE '' END AS edited FROM n),
{_signatures("e", "edited", "f")}
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(sigs, '') AS edited_fingerprint,
  {near("own", "sigs")} AS near_edited, {near("own", "next_sigs")} AS near_next, len(own) AS n_signatures, {near("own", "next_sigs")} >= {NEAR} AS copy_of_next FROM f"""


def warc() -> str:
    """Base-32 from the hex digest: five hex digits make four letters."""
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * i + 1}, 5))::INT >> {15 - 5 * k}) % 32 + 1, 1)" for i in range(8) for k in range(4))
    return f"""
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {letters} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)"""


def topk() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def ngram_join() -> str:
    lower = f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS h, s FROM g),
c AS (SELECT h, min(doc_id) AS a, any_value(n) AS n, any_value(s) AS s FROM t WHERE n > 0 GROUP BY h),
e AS (SELECT a, n, unnest(s) AS x FROM c),
p AS (SELECT l.a, r.a AS b FROM e l JOIN e r ON l.x = r.x AND l.a < r.a GROUP BY l.a, r.a, l.n, r.n HAVING 100 * count(*) >= 75 * (l.n + r.n - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
k AS (SELECT a, a AS b FROM c UNION SELECT k.a, u.b FROM k JOIN u ON k.b = u.a),
m AS (SELECT a, min(b) AS least FROM k GROUP BY a)
SELECT t.doc_id, t.n AS n_shingles, coalesce(m.least, t.doc_id) AS component_id FROM t LEFT JOIN c ON t.h = c.h AND t.n > 0 LEFT JOIN m ON c.a = m.a"""


def filter_audit() -> str:
    """Every order is run, over groups of documents with equal flags."""
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END
  || CASE WHEN e THEN 'E' ELSE '' END) AS fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[:step - 1] AS earlier FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
j AS (SELECT m.*, s.*, contains(fails, own) AS hit, regexp_matches(fails, '[' || earlier || '-]') AS gone FROM m, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r"""


def spelling() -> str:
    """Near words share what is left of them without one place: a gap at it (replaced), or one word is left of the other (deleted)."""
    lower = f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return f"""
WITH RECURSIVE bit(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bit WHERE k = 8),
run AS (SELECT doc_id, unnest(regexp_extract_all({lower}, '[a-zÀ-ÿ]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM run WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) AS h FROM own, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i::INT - 1) AS l, substr(word, i::INT + 1) AS r FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pair AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.l || a.r = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.l || a.r = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pair GROUP BY word),
f AS (SELECT w.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.at = f.word WHERE f.form IS NOT NULL),
root AS (SELECT way.word, way.at AS root FROM way JOIN f ON way.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""


def substrings(window: int = 20) -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS x FROM d, LATERAL (SELECT unnest(range(1, len(w) - {window - 2})) AS i)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS again FROM s),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + {window})))) AS gone FROM f WHERE again GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""
