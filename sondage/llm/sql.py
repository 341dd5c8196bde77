"""SQL for DuckDB that gives the rows of the queries SQL can express."""

from sondage.llm.licenses import LABEL_OF, TEMPLATES, pattern

MIXING_SQL = r"""
WITH base AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln(greatest((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE, pow(2.0::DOUBLE, -53)))
           / coalesce(w.weight, 1.0::DOUBLE) AS key
  FROM documents d
  LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS weight
             FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) w ON d.doc_id = w.doc_id),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sizes),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM ranked),
levels AS (
  SELECT a.source, a.full_at, (a.total - coalesce((SELECT sum(b.cap) FROM caps b WHERE b.full_at < a.full_at), 0)) / (SELECT sum(b.weight) FROM caps b WHERE b.full_at >= a.full_at) AS level
  FROM caps a),
chosen AS (SELECT arg_min(level, full_at) AS level FROM levels WHERE level < full_at),
targets AS (SELECT c.source, c.source_size, CASE WHEN k.level IS NULL THEN c.cap ELSE least(c.cap, k.level * c.weight) END AS target FROM caps c, chosen k),
placed AS (
  SELECT b.doc_id, b.source, b.size, t.source_size, t.target,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.key, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         round(t.target)::BIGINT AS goal
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (CASE WHEN source_size > 0 THEN goal // source_size * size + least(greatest(goal - goal // source_size * source_size - start, 0), size) ELSE 0 END)::BIGINT AS taken
FROM placed
"""

_CASES = ", ".join(f"CASE WHEN regexp_matches(flat, '{pattern(t)}') THEN '{LABEL_OF.get(n, n)}' END" for n, t in TEMPLATES.items())
_PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
_PLACES = " || ".join(
    f"CASE WHEN contains(flat, ' {p} ') THEN list_filter(range(1, n_words + 1), lambda i: {' AND '.join(f't[i + {k}] = {w!r}' for k, w in enumerate(p.split()))}) ELSE []::BIGINT[] END" for p in _PHRASES.values()
)
_BASE = ", ".join(f"CASE WHEN contains(flat, ' {p} ') THEN '{n}' END" for n, p in _PHRASES.items())

LICENSES_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
f AS (SELECT doc_id, t, len(t)::BIGINT AS n_words, ' ' || array_to_string(t, ' ') || ' ' AS flat FROM w),
p AS (SELECT doc_id, n_words, {_PLACES} AS places, list_filter([{_BASE}], lambda x: x IS NOT NULL) AS base, list_filter([{_CASES}], lambda x: x IS NOT NULL) AS more FROM f)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || more)), ',') AS labels,
       CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM p
"""
