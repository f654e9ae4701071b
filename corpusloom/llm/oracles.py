"""DuckDB SQL for those opN_ queries that SQL can express whole."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOW}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP4 = f"""WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reached FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(reached) AS component_id FROM r GROUP BY id) m USING (doc_id)"""

_NORMAL = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""WITH i AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, len(w) + 1)) r(p) WHERE len(w) > 0 AND p <= len(w) - least(13, len(w)) + 1),
d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_NORMAL} END AS w FROM documents),
m AS (SELECT doc_id, p, k.k, array_to_string(w[p:p + k.k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM v) k, unnest(range(1, len(w) + 1)) r(p) WHERE p <= len(w) - k.k + 1),
h AS (SELECT m.doc_id, m.p, m.k, v.item_id FROM m JOIN v ON m.k = v.k AND m.g = v.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_REST = "CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] END"
_FITS = "(host = '{0}' OR suffix(host, '.{0}')) AND starts_with(path, '{1}')"

OP3 = f"""WITH u AS (SELECT page_id, coalesce(translate(regexp_extract({_REST}, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN {_FITS.format('example.net', '/en/')} THEN 'example.net/en/' WHEN {_FITS.format('example.com', '/de/')} THEN 'example.com/de/' WHEN {_FITS.format('org', '/fr/')} THEN 'org/fr/' WHEN {_FITS.format('net', '/')} THEN 'net/' END AS rule,
list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > 40 THEN '*' ELSE s END) AS seg FROM u),
g AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS good, array_to_string(seg, '/') AS leaf FROM r),
leaf AS (SELECT host, leaf, any_value(seg) AS seg, count(good) AS k, coalesce(sum(good), 0) AS good FROM g GROUP BY host, leaf),
a AS (SELECT (coalesce(sum(good), 0) + 1.0::DOUBLE) / (coalesce(sum(k), 0) + 2.0::DOUBLE) AS m FROM leaf),
steps AS (SELECT host, leaf, k, good, i AS level, seg[i] AS segment, array_to_string(seg[1:i - 1], '/') AS parent FROM leaf, unnest(range(1, len(seg) + 1)) t(i)),
node AS (SELECT host, parent, segment, sum(k) AS k, sum(good) AS good FROM steps GROUP BY ALL),
alike AS (SELECT host, parent, k, good, count(*) AS members, (good + 0.5::DOUBLE) / (k + 1.0::DOUBLE) AS share FROM node GROUP BY ALL),
z AS (SELECT *, lag(k) OVER w AS bk, lag(good) OVER w AS bg, lag(share) OVER w AS bs, (good + bg + 1.0::DOUBLE) / (k + bk + 2.0::DOUBLE) AS pool FROM alike WINDOW w AS (PARTITION BY host, parent ORDER BY share, k)),
br AS (SELECT host, parent, k, good, members, sum(CASE WHEN (share - bs) / sqrt(pool * (1 - pool) * (1 / (k + 1.0::DOUBLE) + 1 / (bk + 1.0::DOUBLE))) >= 1.96 THEN 1 ELSE 0 END) OVER (PARTITION BY host, parent ORDER BY share, k ROWS UNBOUNDED PRECEDING) AS branch FROM z),
sz AS (SELECT host, parent, branch, sum(members) AS size FROM br GROUP BY ALL),
named AS (SELECT node.host, node.parent, segment, CASE WHEN size > 1 THEN '*' || branch::BIGINT ELSE segment END AS name FROM node JOIN br USING (host, parent, k, good) JOIN sz USING (host, parent, branch)),
names AS (SELECT host, leaf, list(name ORDER BY level) AS names FROM steps JOIN named USING (host, parent, segment) GROUP BY host, leaf),
l2 AS (SELECT host, leaf, k, good, coalesce(names, []) AS names, '/' || array_to_string(coalesce(names, []), '/') AS template FROM leaf LEFT JOIN names USING (host, leaf)),
tree AS (SELECT host, template, k, good, i AS level, array_to_string(names[1:i], '/') AS prefix FROM l2, unnest(range(0, len(names) + 1)) t(i)),
stat AS (SELECT host, level, prefix, sum(k) AS k, sum(good) AS good FROM tree GROUP BY ALL),
walk AS (SELECT host, template, list(struct_pack(k := k, good := good) ORDER BY level) AS nodes FROM (SELECT DISTINCT host, template, level, prefix FROM tree) JOIN stat USING (host, level, prefix) GROUP BY host, template),
down AS (WITH RECURSIVE go AS (SELECT host, template, nodes, 0 AS i, (SELECT m FROM a) AS p FROM walk UNION ALL SELECT host, template, nodes, i + 1, (nodes[i + 1].good + 2.0::DOUBLE * p) / (nodes[i + 1].k + 2.0::DOUBLE) FROM go WHERE i < len(nodes)) SELECT host, template, p AS purity FROM go WHERE i = len(nodes))
SELECT page_id, host, path, rule, CASE WHEN host = '' THEN '' ELSE template END AS template, round(purity, 6)::DOUBLE AS purity,
CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN purity < 0.2 THEN 'block' ELSE 'allow' END AS verdict
FROM g JOIN l2 USING (host, leaf) JOIN down USING (host, template)"""

_H = "CAST('0x' || sha256('7:' || doc_id)[{0}:{1}] AS BIGINT)"

OP11 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, {_H.format(1, 8)} AS h1, {_H.format(9, 16)} AS h2, {_H.format(17, 24)} AS h3, {_H.format(25, 32)} AS h4 FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

OP13 = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)"""

ORACLE_SQL = {"op3_url_templates": OP3, "op4_jaccard": OP4, "op10_contamination": OP10, "op11_fill_in_middle": OP11, "op13_exact_dedup": OP13}
