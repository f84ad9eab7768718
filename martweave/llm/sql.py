"""DuckDB SQL of the queries whose rows SQL can express."""

from __future__ import annotations

from martweave.llm import licenses

SQL: dict[str, str] = {}

SQL["op2_warc"] = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_bytes, payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to, true AS digest_ok
FROM d LEFT JOIN g USING (payload_bytes, payload_digest)
"""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_TEXT = "coalesce(text, '')"
_LOWERED = f"translate({_TEXT}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op3_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWERED)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a AS p, b AS q FROM links UNION ALL SELECT b, a FROM links),
reach(p, q) AS (SELECT p, q FROM edges UNION SELECT r.p, e.q FROM reach r JOIN edges e ON e.p = r.q),
least_id AS (SELECT p, min(q) AS m FROM reach GROUP BY p)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_id ON p = w.doc_id
"""

SQL["op6_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(_TEXT)} AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
early AS (SELECT g, min((doc_id, i)) AS f FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM win JOIN early USING (g) WHERE (doc_id, i) <> f),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

SQL["op10_mixing"] = f"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS.format(_TEXT)}) AS size,
         -ln((('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497.0::DOUBLE)
         / greatest(CASE WHEN length({_TEXT}) > 0 THEN length(translate(text, '0123456789#*$%&|<>{{}}[]=_~^\', ''))::DOUBLE
                              / length(text)::DOUBLE ELSE 0 END, 0.01::DOUBLE) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
weighed AS (
  SELECT *, CAST((place - 1) % 3 + 1 AS BIGINT) AS w, (3 * s)::DOUBLE / ((place - 1) % 3 + 1)::DOUBLE AS ratio FROM sources),
steps AS (
  SELECT *, ((sum(s) OVER () - coalesce(sum(3 * s) OVER o, 0)) * 1000)::DOUBLE
            / ((sum(w) OVER () - coalesce(sum(w) OVER o, 0)) * 1000)::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, s, least((3 * s)::DOUBLE, w::DOUBLE * (SELECT arg_min(level, (ratio, place)) FROM steps WHERE level <= ratio)) AS target
  FROM steps),
e AS (
  SELECT d.*, t.s, t.target, CASE WHEN t.s > 0 THEN floor(t.target / t.s::DOUBLE) ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, s AS source_size, target,
       CAST(size * epochs + greatest(0, least(size, floor(target - epochs * s + 0.5::DOUBLE) - (upto - size))) AS BIGINT) AS taken
FROM e
"""


def _vector_codes(rounds: int = 6, parts: int = 8, entries: int = 16) -> str:
    """Lloyd rounds written out one after the other; ``d`` is the length of a part."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, part, any_value(v) AS v, any_value(d) AS d, min(struct_pack(dist := dist, entry := entry)) AS best
  FROM (SELECT p.row, p.part, p.v, p.d, c.entry,
               CAST(list_sum([(p.v[i] - c.v[i]) * (p.v[i] - c.v[i]) FOR i IN range(1, p.d + 1)]) AS BIGINT) AS dist
        FROM pieces p JOIN c{r} c ON c.part = p.part) GROUP BY row, part)""")
        if r < rounds:
            steps.append(f"""
u{r} AS (
  SELECT part, entry, place, sum(x) AS s, count(*) AS n
  FROM (SELECT part, best.entry AS entry, unnest(range(1, d + 1)) AS place, unnest(v) AS x FROM a{r}) GROUP BY part, entry, place),
m{r} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM u{r} GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pieces AS MATERIALIZED (
  SELECT row, vec_id, label, part, len(v) // {parts} AS d, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v
  FROM (SELECT *, unnest(range({parts})) AS part FROM kept)),
first AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept),
c0 AS MATERIALIZED (SELECT part, entry, v FROM pieces JOIN first USING (row) WHERE entry < {entries}),
{",".join(steps)},
codes AS (
  SELECT row, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.dist) AS BIGINT) AS error
  FROM a{rounds} GROUP BY row),
books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row), books
"""


SQL["op13_vector_codes"] = _vector_codes()

_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWERED)

SQL["op12_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS ws FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
q AS (SELECT item, t, count(*) AS c FROM (SELECT item, unnest(ws) AS t FROM i) GROUP BY ALL),
s AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0),
tf AS (SELECT row, t, count(*) AS tf FROM (SELECT row, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t),
m AS (SELECT row, doc_id, 100 - 25 + ((25 * len(ws) * n) // l) AS m FROM d, s WHERE len(ws) > 0),
score AS (
  SELECT item, row, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM tf JOIN q USING (t) JOIN w USING (t) JOIN m USING (row) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN i USING (item) WHERE rank <= 20
"""


def _licences() -> str:
    listed = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    words = [(t, label, i, w) for t, (label, own, _) in enumerate(licenses.NOTICES) for i, w in enumerate(own)]
    keys = [(t, i, len(k)) for t, (_, _, k) in enumerate(licenses.NOTICES) for i in k]
    phrases = [(label, i, w, len(licenses.cut(p))) for p, label in licenses.BASE.items() for i, w in enumerate(licenses.cut(p))]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT row, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
t(template, label, place, w) AS (VALUES {listed(words)}),
k(template, place, n_keys) AS (VALUES {listed(keys)}),
p(label, place, w, n_keys) AS (VALUES {listed(phrases)}),
base AS (
  SELECT row, label, pos - place AS begins FROM w JOIN p USING (w) GROUP BY row, label, pos - place HAVING count(*) = any_value(n_keys)),
df AS (SELECT t.w, count(DISTINCT row) AS df FROM (SELECT DISTINCT w FROM t) t LEFT JOIN w ON w.w = t.w GROUP BY t.w),
v AS (SELECT w, 1 + CAST(floor(1000 * ln(CAST(2 * (SELECT count(*) FROM d) + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM df),
rare AS (
  SELECT * FROM t JOIN v USING (w) QUALIFY row_number() OVER (PARTITION BY template ORDER BY weight DESC, place) <= {licenses.RARE}),
whole AS (SELECT template, sum(weight) AS whole FROM rare GROUP BY template),
likely AS (
  SELECT row, template, pos - place AS begins, sum(weight) AS got FROM w JOIN rare USING (w) WHERE pos >= place GROUP BY row, template, pos - place),
met AS (
  SELECT row, l.template, begins, any_value(got) AS got, any_value(whole) AS whole, any_value(t.label) AS label
  FROM likely l JOIN whole USING (template) JOIN k ON k.template = l.template
  JOIN t ON t.template = k.template AND t.place = k.place JOIN w USING (row) WHERE w.pos = begins + k.place AND w.w = t.w
  AND got * 100 >= whole * {licenses.SHARE} GROUP BY row, l.template, begins
  HAVING count(*) = any_value(n_keys)),
b AS (SELECT row, count(*) AS n, min(begins) AS lo, max(begins) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM base GROUP BY row),
a AS (
  SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT row, label FROM base UNION ALL SELECT row, label FROM met) GROUP BY row),
s AS (SELECT row, max(CAST(got AS DOUBLE) / CAST(whole AS DOUBLE)) AS score FROM met GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, lo AS first_word, hi AS last_word,
       coalesce(b.ls, '') AS base_labels, coalesce(a.ls, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN a USING (row) LEFT JOIN s USING (row)
"""


SQL["op11_license_scan"] = _licences()
