"""DuckDB SQL of the queries that SQL can express on whole tables."""

UP = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK_WORDS = r"'[^\x20\x09-\x0D]+'"
LETTER_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR = f"""WITH RECURSIVE W AS (SELECT doc_id, regexp_extract_all({UP}, {BLANK_WORDS}) AS w FROM documents),
S AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM W WHERE len(w) > 0),
C AS (SELECT doc_id, count(*) AS n FROM S GROUP BY 1),
L AS (SELECT a.doc_id AS u, b.doc_id AS v FROM S a JOIN S b ON a.s = b.s AND a.doc_id < b.doc_id JOIN C x ON x.doc_id = a.doc_id JOIN C y ON y.doc_id = b.doc_id
GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
E AS (SELECT u, v FROM L UNION ALL SELECT v, u FROM L),
R(u, v) AS (SELECT doc_id, doc_id FROM C UNION SELECT R.u, E.v FROM R JOIN E ON E.u = R.v)
SELECT doc_id, coalesce(C.n, 0) AS n_shingles, coalesce(Z.c, doc_id) AS component_id, coalesce(Z.c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN C USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS c FROM R GROUP BY 1) Z USING (doc_id)"""

HITS = f"""WITH D AS (SELECT doc_id, regexp_extract_all({UP}, {LETTER_WORDS}) AS w FROM documents),
I AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({UP}, {LETTER_WORDS}) AS w FROM benchmark),
IW AS (SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM I WHERE len(w) > 0)),
DW AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM D, (SELECT DISTINCT n FROM IW) WHERE len(w) >= n)),
H AS (SELECT DISTINCT doc_id, i, n, item_id FROM DW JOIN IW USING (n, g)),
P AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM H) GROUP BY 1),
T AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM H) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM D LEFT JOIN P USING (doc_id) LEFT JOIN T USING (doc_id)"""

MIX = f"""WITH Q AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, {BLANK_WORDS})) END AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u FROM documents),
S AS (SELECT source, sum(size) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM Q GROUP BY 1),
O AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k FROM S),
V AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM O),
F AS (SELECT *, min((k, level)) FILTER (level <= 2 * source_size / weight) OVER () AS first FROM V),
G AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(2.0 * source_size, weight * first[2]) AS target FROM F),
L AS (SELECT Q.*, source_size, target, CAST(sum(size) OVER (PARTITION BY Q.source ORDER BY u, doc_id, size) AS BIGINT) - size AS before FROM Q JOIN G ON Q.source IS NOT DISTINCT FROM G.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(least(size, greatest(0, floor(target) - before)) + least(size, greatest(0, floor(target) - source_size - before)) AS BIGINT) AS taken FROM L"""

RULES = {"allow": [("com", "/"), ("www.example.com", "/en/")], "block": [("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]}


def fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_longest_first = sorted(((len(h), len(p), h, p, v) for v, rules in RULES.items() for h, p in rules), reverse=True)
_rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, _, h, p, _ in _longest_first)
_verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for _, _, h, p, v in _longest_first)
URLS = f"""WITH R AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
H AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM R)
SELECT page_id, host, path, CASE {_rule} END AS rule, CASE {_verdict} ELSE 'allow' END AS verdict FROM H"""



def sketches(name: str, table: str, text: str) -> str:
    """name(k, s): 15 hexadecimal digits of the MD5 of each text's five-word shingles, those below an eighth, or the smallest."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shingle = "concat_ws(' ', w, " + ", ".join(f"lead(w, {i}) OVER o" for i in range(1, 5)) + ")"
    return f"""{name} AS (SELECT k, list_sort(coalesce(list(DISTINCT h) FILTER (h < '2'), [min(h)])) AS s FROM
(SELECT k, i, n, substr(md5({shingle}), 1, 15) AS h FROM (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM (SELECT k, regexp_extract_all({low}, {BLANK_WORDS}) AS w FROM {table})) WINDOW o AS (PARTITION BY k ORDER BY i))
WHERE i <= greatest(n - 4, 1) GROUP BY k)"""


SKETCH = f"""WITH D AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS k, count(*) OVER () AS m FROM documents),
{sketches('A', 'D', 't')},
E AS MATERIALIZED (SELECT x.doc_id, x.n, x.k, y.k AS after, left(x.t, x.n - x.n // 3) || left(y.t, x.n // 3) AS e FROM D x JOIN D y ON y.k = x.k % x.m + 1),
{sketches('B', 'E', 'e')},
G AS (SELECT doc_id, n, e, coalesce(A.s, []) AS a, coalesce(B.s, []) AS b, coalesce(C.s, []) AS c FROM E LEFT JOIN A ON A.k = E.k LEFT JOIN B ON B.k = E.k LEFT JOIN A C ON C.k = E.after)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
CASE WHEN a = b THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS near_edited, CASE WHEN a = c THEN 1.0 ELSE len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))) END AS near_next,
CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END AS contained_edited, CASE WHEN len(a) > 0 THEN len(list_intersect(a, c)) / len(a) ELSE 0.0 END AS contained_next FROM G"""

HARD = """WITH V AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
X AS MATERIALIZED (SELECT r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM V WHERE len(embedding) = (SELECT len(embedding) FROM V GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1) AND len(embedding) > 0),
S AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS s FROM X a JOIN X b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
P AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s DESC, vec_id NULLS LAST, o) AS k FROM S WHERE same) WHERE k <= 5),
N AS (SELECT P.anchor_id, P.vec_id AS positive_id, S.vec_id AS negative_id, P.s AS positive_score, S.s AS negative_score, row_number() OVER (PARTITION BY P.r, P.k ORDER BY S.s DESC, S.vec_id NULLS LAST, S.o) AS rank FROM P JOIN S ON S.r = P.r AND NOT S.same AND 50 * P.s <= 100 * S.s AND 100 * S.s <= 95 * P.s)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM N WHERE rank <= 3"""

SQL = {"op1_minhash": NEAR, "op2_winnowing": HITS, "op3_fair_queueing": MIX, "op6_bloom_cascade": URLS, "op12_scaled_sketch": SKETCH, "op13_bond_negatives": HARD}
