"""SQL that must give the rows of the registered queries, for the operators that SQL can express."""

OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
), recurring AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), starts AS (
  SELECT rid, i FROM windows SEMI JOIN recurring USING (h)
), words AS (
  SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs
), judged AS (
  SELECT words.rid, word, j, max(starts.i) OVER (PARTITION BY words.rid ORDER BY j ROWS UNBOUNDED PRECEDING) AS last_start
  FROM words LEFT JOIN starts ON words.rid = starts.rid AND words.j = starts.i
), cut AS (
  SELECT rid, count(*) FILTER (last_start IS NOT NULL AND j - last_start < 35) AS n_removed,
         string_agg(word, ' ' ORDER BY j) FILTER (last_start IS NULL OR j - last_start >= 35) AS rest
  FROM judged GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (rid)
"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


OP6_SQL = f"""
WITH RECURSIVE marks AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS bad
  FROM labels GROUP BY doc_id
), split AS (
  SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages
), shaped AS (
  SELECT split.page_id, host, path, bad,
         [CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > 40 THEN '*' ELSE x END FOR x IN string_split(path, '/') IF x <> ''] AS form
  FROM split LEFT JOIN marks ON split.page_id = marks.page_id
), leaves AS (
  SELECT host, form, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM shaped GROUP BY host, form
), hosts AS (
  SELECT host, sum(n)::DOUBLE AS hn, sum(b)::DOUBLE AS hb FROM leaves GROUP BY host
), grow AS (
  SELECT host, form, form AS rest, '' AS t, n, b, hn AS nl, hb AS nb, false AS done,
         (hb + 20 * (SELECT (coalesce(sum(hb), 0) + 1) / (coalesce(sum(hn), 0) + 2) FROM hosts)) / (hn + 20) AS share
  FROM leaves JOIN hosts USING (host)
  UNION ALL (
    WITH step AS (
      SELECT *, CASE WHEN len(rest) = 0 THEN '' ELSE rest[1] END AS seg FROM grow WHERE NOT done
    ), fan AS (
      SELECT *, CASE WHEN seg <> '' AND count(DISTINCT nullif(seg, '')) OVER (PARTITION BY host, t) > 20 THEN '*' ELSE seg END AS child FROM step
    ), kids AS (
      SELECT host, t, child, sum(n)::DOUBLE AS cn, sum(b)::DOUBLE AS cb, max(share) AS above, sum(n) > 0 AS known,
             sum(b)::DOUBLE / greatest(sum(n), 1)::DOUBLE AS ratio
      FROM fan GROUP BY host, t, child
    ), beside AS (
      SELECT *, count(*) OVER (PARTITION BY host, t) = 1 AS lone, lag(cn) OVER line AS n0, lag(cb) OVER line AS b0
      FROM kids WINDOW line AS (PARTITION BY host, t, known ORDER BY ratio, child)
    ), cuts AS (
      SELECT *, sum(CASE WHEN (b0 * cn - cb * n0) * (b0 * cn - cb * n0) * (n0 + cn)
                           > 3.84::DOUBLE * (n0 * cn) * ((b0 + cb) * (n0 + cn - (b0 + cb))) THEN 1 ELSE 0 END)
             OVER (PARTITION BY host, t, known ORDER BY ratio, child ROWS UNBOUNDED PRECEDING) AS grp
      FROM beside
    ), merged AS (
      SELECT *, sum(cn) OVER same AS gn, sum(cb) OVER same AS gb FROM cuts WINDOW same AS (PARTITION BY host, t, known, grp)
    )
    SELECT f.host, f.form, f.rest[2:], CASE WHEN f.child = '' THEN f.t ELSE f.t || '/' || f.child END, f.n, f.b,
           CASE WHEN lone THEN f.nl ELSE gn END, CASE WHEN lone THEN f.nb ELSE gb END, f.child = '',
           CASE WHEN lone THEN f.share ELSE (gb + 20 * above) / (gn + 20) END
    FROM fan f JOIN merged m ON f.host = m.host AND f.t = m.t AND f.child = m.child
  )
), ruled AS (
  SELECT *, CASE WHEN {_fits("example.net", "/en/")} THEN 'example.net/en/' WHEN {_fits("example.com", "/de/")} THEN 'example.com/de/'
                 WHEN {_fits("org", "/fr/")} THEN 'org/fr/' WHEN {_fits("net", "/")} THEN 'net/' END AS rule
  FROM shaped
)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE r.rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
                   WHEN 'net/' THEN 'block' ELSE CASE WHEN g.share * 100 > 50 THEN 'block' ELSE 'allow' END END AS verdict,
       CASE WHEN g.t = '' THEN '/' ELSE g.t END AS template, CAST(g.nl AS BIGINT) AS n_labelled, CAST(g.nb AS BIGINT) AS n_bad
FROM ruled r JOIN grow g ON r.host = g.host AND r.form = g.form AND g.done
"""

OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM docs GROUP BY source
), weighed AS (
  SELECT *, 2 * source_size AS full_size, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight FROM sizes
), levels AS (
  SELECT *, full_size / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(full_size) OVER before, 0)::DOUBLE)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY full_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, place % 3 AS slot,
         least(full_size::DOUBLE, (SELECT max(level) FROM levels WHERE ratio > level) * weight) AS target
  FROM weighed
), placed AS (
  SELECT docs.*, source_size, slot, target, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) AS asked,
         CAST(coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS BIGINT) AS start
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
), copies AS (
  SELECT *, greatest(0, least(size, asked - start)) AS w1, greatest(0, least(size, asked - source_size - start)) AS w2 FROM placed
), parts AS (
  SELECT *, CASE WHEN w1 > 0 THEN (start + w1::DOUBLE / 2) / target END AS p1,
         CASE WHEN w2 > 0 THEN (source_size + start + w2::DOUBLE / 2) / target END AS p2
  FROM copies
)
SELECT doc_id, size, source_size, target, CAST(w1 + w2 AS BIGINT) AS taken,
       CASE WHEN p1 IS NOT NULL THEN least(1::DOUBLE, CASE slot
         WHEN 0 THEN 2 * (p1 * 3) / (4 + sqrt(greatest(0, 16 - 4 * (p1 * 3))))
         WHEN 1 THEN 2 * p1 / (1 + sqrt(1))
         ELSE 2 * (p1 * 2) / (1 + sqrt(greatest(0, 1 + 4 * (p1 * 2)))) END) END AS first_position,
       CASE WHEN p2 IS NOT NULL THEN least(1::DOUBLE, CASE slot
         WHEN 0 THEN 2 * (p2 * 3) / (4 + sqrt(greatest(0, 16 - 4 * (p2 * 3))))
         WHEN 1 THEN 2 * p2 / (1 + sqrt(1))
         ELSE 2 * (p2 * 2) / (1 + sqrt(greatest(0, 1 + 4 * (p2 * 2)))) END) END AS second_position
FROM parts
"""


def _round(k: int) -> str:
    """One round: every vector to its nearest centroid, then the floor of the mean where a centroid has vectors."""
    return f"""near{k} AS MATERIALIZED (
  SELECT rid, list_position(d, list_min(d)) AS k, list_min(d) AS far
  FROM (SELECT rid, [list_sum([(v[i] - c[i]) * (v[i] - c[i]) FOR i IN range(1, 65)]) FOR c IN cs] AS d FROM vectors, centroids{k})
), centroids{k + 1} AS MATERIALIZED (
  SELECT list(coalesce(fresh.c, old.c) ORDER BY old.j) AS cs
  FROM (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) AS j FROM centroids{k}) old
  LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
    FROM (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{k} JOIN vectors USING (rid)) GROUP BY k, i)
    GROUP BY k
  ) fresh ON fresh.k = old.j
)"""


OP12_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(1024 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), centroids0 AS MATERIALIZED (
  SELECT list(v ORDER BY h, v) AS cs
  FROM (SELECT v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM vectors ORDER BY h, v LIMIT 8)
), {", ".join(_round(k) for k in range(11))}, sums AS (
  SELECT k, CAST(sum(far) AS BIGINT) AS cluster_inertia FROM near10 GROUP BY k
), names AS (
  SELECT j, sha256(array_to_string(c, ',')) AS centroid_sha256
  FROM (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) AS j FROM centroids10)
)
SELECT vec_id, CAST(k - 1 AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, cluster_inertia,
       CAST((SELECT sum(far) FROM near10) AS BIGINT) AS inertia, centroid_sha256
FROM near10 JOIN vectors USING (rid) JOIN sums USING (k) JOIN names ON j = k
"""

OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbers AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM drawn
), cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, substring(t, 1, a) AS head, substring(t, a + 1, b - a) AS body, substring(t, b + 1) AS tail FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || body
                   ELSE '<S>' || tail || '<P>' || head || '<M>' || body END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

OP8_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS seen
  FROM (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS h
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3))
), repeats AS (
  SELECT rid, sum(least(3, coalesce(next - i, 3))) AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next FROM windows WHERE seen > 1) GROUP BY rid
), normal AS (
  SELECT rid, host, list_transform(ls, lambda x: lower(array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' '))) AS ns FROM docs
), named AS (
  SELECT rid, host, ns, md5(array_to_string(ns, chr(10))) AS self FROM normal
), lines AS (
  SELECT rid, host, self, unnest(ns) AS line FROM named
), hosts AS (
  SELECT host, count(DISTINCT self) AS docs FROM named GROUP BY host
), common AS (
  SELECT host, line FROM lines JOIN hosts USING (host) GROUP BY host, line, docs
  HAVING count(DISTINCT self) > 10 AND count(DISTINCT self) * 100 > docs
), lost AS (
  SELECT rid, sum(len(string_split(line, ' '))) AS gone FROM lines SEMI JOIN common USING (host, line) GROUP BY rid
), counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) - coalesce(gone, 0) AS n_left
  FROM docs LEFT JOIN repeats USING (rid) LEFT JOIN lost USING (rid)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_left >= 50 AND n_left * 100 >= n_words * 50 AS kept, CAST(n_left AS BIGINT) AS n_left
FROM judged
"""
