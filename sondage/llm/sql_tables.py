"""SQL for DuckDB of the queries on ranked search, the Merkle manifest and the Hilbert shards."""

_ASCII_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

RANKED_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT item_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), {_ASCII_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
totals AS (SELECT count(*)::HUGEINT AS n, sum(len(t))::HUGEINT AS words FROM d WHERE len(t) > 0),
m AS (SELECT doc_id, row, (25 + (75 * len(t)::HUGEINT * n) // words)::BIGINT AS m FROM d, totals WHERE len(t) > 0),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY row, term),
w AS (SELECT term, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * n::DOUBLE + 2.0::DOUBLE) / (2.0::DOUBLE * df::DOUBLE + 1.0::DOUBLE)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
qt AS (SELECT item_id, row AS item, term, count(*)::BIGINT AS repeats FROM (SELECT item_id, row, unnest(t) AS term FROM q) GROUP BY item_id, row, term),
s AS (SELECT qt.item_id, qt.item, m.doc_id, m.row, sum(qt.repeats * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::BIGINT AS score
      FROM qt JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.row = tf.row GROUP BY qt.item_id, qt.item, m.doc_id, m.row),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


# crc32 (polynomial 0xEDB88320) of each byte, by its bits: one row
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY x) AS crc_t FROM (
  SELECT x, list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS v FROM (SELECT unnest(range(0, 256)) AS x)))"""


def _crc32(data: str) -> str:
    """crc32 of the bytes given as hex digits, beside the column ``crc_t`` of the table."""
    codes = f"list_transform(range(0, strlen({data}) // 2), lambda i: (('0x' || substr({data}, (2 * i + 1)::INT, 2))::BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, list_extract(crc_t, (xor(c & 255, b) + 1)::INT))), 4294967295::BIGINT)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"

MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
crc AS (SELECT row, {_crc32("h")} AS crc FROM (SELECT row_number() OVER () AS row, hex(doc_id::VARCHAR) AS h FROM documents), crc_table),
d AS (SELECT doc_id, lang, {_LEAF.format(text=_field("text"))} AS leaf,
             CASE WHEN crc % 3 = 0 THEN {_LEAF.format(text=_field(f"translate(text, {_ASCII_LOWER})"))} ELSE {_LEAF.format(text=_field("text"))} END AS present
      FROM (SELECT row_number() OVER () AS row, * FROM documents) JOIN crc USING (row)),
p AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, present) - 1)::BIGINT AS pos, count(*) OVER (PARTITION BY lang)::BIGINT AS n FROM d),
lower_tree(lang, k, n, pos, node) AS (
  SELECT lang, 0, n, pos, leaf FROM p
  UNION ALL
  SELECT lang, k + 1, (n + 7) // 8, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM lower_tree WHERE n > 1 GROUP BY lang, k, n, pos // 8),
subroots AS (SELECT lang, node AS subroot, (row_number() OVER (ORDER BY lang NULLS FIRST) - 1)::BIGINT AS pos, count(*) OVER ()::BIGINT AS n FROM lower_tree WHERE n = 1),
upper_tree(k, n, pos, node) AS (
  SELECT 0, n, pos, subroot FROM subroots
  UNION ALL
  SELECT k + 1, (n + 7) // 8, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY k, n, pos // 8),
top AS (SELECT node AS root FROM upper_tree WHERE n = 1),
low_steps AS (
  SELECT a.lang, a.k, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM lower_tree a JOIN lower_tree b ON a.lang IS NOT DISTINCT FROM b.lang AND a.k = b.k AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.lang, a.k, a.pos),
high_steps AS (
  SELECT a.k, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM upper_tree a JOIN upper_tree b ON a.k = b.k AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.k, a.pos),
steps AS (
  SELECT p.lang, p.pos, s.k, s.l, s.r FROM p JOIN low_steps s ON p.lang IS NOT DISTINCT FROM s.lang AND s.pos = p.pos // (8 ** s.k)::BIGINT
  UNION ALL
  SELECT p.lang, p.pos, 100 + s.k, s.l, s.r FROM p JOIN subroots x ON p.lang IS NOT DISTINCT FROM x.lang JOIN high_steps s ON s.pos = x.pos // (8 ** s.k)::BIGINT),
proofs AS (SELECT lang, pos, string_agg(l || r, '' ORDER BY k) AS siblings, list({{'l': l, 'r': r}} ORDER BY k) AS path FROM steps GROUP BY lang, pos),
folds AS (
  SELECT p.doc_id, p.leaf, p.lang, coalesce(x.siblings, '') AS siblings,
         CASE WHEN x.path IS NULL THEN p.present
              ELSE list_reduce(list_prepend({{'l': p.present, 'r': ''}}, x.path), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l END AS folded_root
  FROM p LEFT JOIN proofs x ON p.lang IS NOT DISTINCT FROM x.lang AND p.pos = x.pos)
SELECT f.doc_id, f.leaf, s.subroot, top.root, sha256(f.siblings) AS proof_sha256, f.folded_root, f.folded_root = top.root AS verified
FROM folds f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang, top
"""


def _name_cell(c: str) -> str:
    return f"SELECT {c} AS v, (row_number() OVER (ORDER BY {c} NULLS FIRST) - 1) * 256 // count(*) OVER () AS cell FROM (SELECT DISTINCT {c} FROM documents)"


def _hilbert_steps() -> tuple[str, str]:
    """The turns of the curve as one query after another, and the last one's name."""
    steps, last = [], "cells"
    for b in range(7, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(4):
            name, x = f"h{b}_{i}", f"x{i}"
            others = ", ".join(f"x{j}" for j in range(1, 4) if j != i)
            if i == 0:
                cols = f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {low}) ELSE x0 END AS x0, {others}"
            else:
                cols = f"CASE WHEN {x} & {q} <> 0 THEN xor(x0, {low}) ELSE xor(x0, xor(x0, {x}) & {low}) END AS x0, CASE WHEN {x} & {q} <> 0 THEN {x} ELSE xor({x}, xor(x0, {x}) & {low}) END AS {x}, {others}"
            steps.append(f"{name} AS MATERIALIZED (SELECT row, {cols} FROM {last})")
            last = name
    steps.append(f"gray AS MATERIALIZED (SELECT row, x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2, xor(xor(xor(x0, x1), x2), x3) AS x3 FROM {last})")
    turn = "0"
    for b in range(1, 8):
        turn = f"xor({turn}, CASE WHEN x3 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append(f"turned AS MATERIALIZED (SELECT row, " + ", ".join(f"xor(x{i}, {turn}) AS x{i}" for i in range(4)) + " FROM gray)")
    bits = " + ".join(f"(((x{i} >> {b}) & 1) << {4 * b + 3 - i})" for b in range(7, -1, -1) for i in range(4))
    steps.append(f"placed AS MATERIALIZED (SELECT row, {bits} AS place FROM turned)")
    return ",\n".join(steps), "placed"


_STEPS, _PLACED = _hilbert_steps()
# a size's power of two and the three bits below its leading one
_SIZE_STEP = "((strlen(bin({v} + 1)) - 1) * 8 + CASE WHEN strlen(bin({v} + 1)) > 3 THEN (({v} + 1) >> (strlen(bin({v} + 1)) - 4)) ELSE (({v} + 1) << (4 - strlen(bin({v} + 1)))) END - 8)"

HILBERT_SQL = f"""
WITH {_CRC_TABLE},
rows AS (SELECT row_number() OVER () AS row, doc_id, source, lang, n_chars, coalesce(text, '') AS text FROM documents),
sources AS ({_name_cell("source")}), langs AS ({_name_cell("lang")}),
ends AS (SELECT {_SIZE_STEP.format(v="greatest(min(n_chars), 0)")} AS low_s, {_SIZE_STEP.format(v="greatest(max(n_chars), 0)")} AS high_s, min(doc_id) AS low_i, max(doc_id) AS high_i FROM documents),
cells AS MATERIALIZED (
  SELECT row, s.cell::BIGINT AS x0, l.cell::BIGINT AS x1,
         CASE WHEN n_chars IS NULL THEN 0 ELSE ({_SIZE_STEP.format(v="greatest(n_chars, 0)")} - low_s) // ((high_s - low_s) // 256 + 1) END::BIGINT AS x2,
         CASE WHEN doc_id IS NULL THEN 0 ELSE (doc_id - low_i) // ((high_i - low_i) // 256 + 1) END::BIGINT AS x3
  FROM rows JOIN sources s ON source IS NOT DISTINCT FROM s.v JOIN langs l ON lang IS NOT DISTINCT FROM l.v, ends),
{_STEPS},
keyed AS (SELECT row, doc_id, strlen(text)::BIGINT + 8 AS size, {_crc32("h")}::BIGINT AS text_crc32, place FROM (SELECT *, hex(text) AS h FROM rows) JOIN {_PLACED} USING (row), crc_table),
numbered AS (SELECT *, (row_number() OVER (ORDER BY place, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS pos, count(*) OVER ()::BIGINT AS n FROM keyed)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 24 // n)::INT AS shard, (pos - (pos * 24 // n * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard
FROM numbered
"""
