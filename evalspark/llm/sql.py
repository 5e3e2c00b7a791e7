"""DuckDB twins of the registered training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL["op8_quality_rules"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT rid, unnest(generate_series(1, len(w) - 2)) AS p, w FROM d WHERE len(w) >= 3
), g AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, w[p], w[p + 1], w[p + 2]) AS c FROM grams
), covered AS (
  SELECT rid, count(DISTINCT q) AS n FROM (
    SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM g WHERE c > 1) GROUP BY rid
), s AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
         OR word_chars > 20 * n_words OR 100 * n_dup_lines > 60 * n_lines AS bad
  FROM s
), h AS (
  SELECT source, count(*) AS docs, count(*) FILTER (WHERE bad) AS failed FROM f GROUP BY source
), m AS (
  SELECT sum(docs)::DOUBLE AS n, sum(failed)::DOUBLE / sum(docs) AS m, count(*)::DOUBLE AS k,
         sum(docs * (failed::DOUBLE / docs)) AS s1, sum(docs * (failed::DOUBLE / docs) * (failed::DOUBLE / docs)) AS s2 FROM h
), b AS (
  SELECT m, m * (1 - m) AS v, greatest(s2 / n - (s1 / n) * (s1 / n) - m * (1 - m) * k / n, m * (1 - m) / 1e4) AS between_hosts FROM m
), p AS (SELECT m, least(greatest(v / between_hosts - 1, 2.0), 1e4) AS strength FROM b),
v AS (
  SELECT source, (failed + m * strength) / (docs + strength) AS host_rate FROM h, p
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR host_rate >= 0.8 OR (host_rate >= 0.02 AND bad)) AS kept, f.source,
       round(host_rate, 9) AS host_rate,
       CASE WHEN host_rate >= 0.8 THEN 'rejected' WHEN host_rate >= 0.02 THEN 'watched' ELSE 'trusted' END AS host_verdict
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


SQL["op1_mix_sources"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), lv AS (
  SELECT *, 3.0 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER o, 0) AS water, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS free
  FROM per WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source AS s, source_size, CASE WHEN water * w >= cap * free THEN cap ELSE
         (SELECT max(water) FROM lv WHERE NOT water * w >= cap * free)::DOUBLE * w / (SELECT max(free) FROM lv WHERE NOT water * w >= cap * free) END AS target
  FROM lv
), o AS (
  SELECT doc_id, source, size, source_size, target, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS token,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole,
         row_number() OVER (PARTITION BY source ORDER BY md5('42:' || coalesce(doc_id::VARCHAR, '')), doc_id, size) AS seq
  FROM d JOIN t ON source IS NOT DISTINCT FROM s
), fit AS (
  SELECT source, 0::BIGINT AS seq, round(target - whole * source_size)::BIGINT AS gap, 0 AS extra FROM o WHERE seq = 1
  UNION ALL
  SELECT o.source, o.seq, CASE WHEN size > 0 AND size <= gap THEN gap - size ELSE gap END, (size > 0 AND size <= gap)::INT
  FROM fit JOIN o ON o.source IS NOT DISTINCT FROM fit.source AND o.seq = fit.seq + 1
), got AS (
  SELECT o.*, extra FROM o JOIN fit ON o.source IS NOT DISTINCT FROM fit.source AND o.seq = fit.seq
), short AS (
  SELECT source AS s, round(max(target) - sum(size * (whole + extra)))::BIGINT AS gap,
         arg_min(seq, size * 100000000 + seq) FILTER (WHERE size > 0 AND extra = 0) AS free FROM got GROUP BY source
)
SELECT doc_id, size, source_size, target, size * (whole + extra + near) AS taken, source, whole + extra + near AS n_copies
FROM (SELECT got.*, coalesce(seq = free AND size < 2 * gap, false)::INT AS near FROM got JOIN short ON source IS NOT DISTINCT FROM s)
"""


def _hilbert_sql(bits: int, n: int, source: str) -> str:
    """CTEs h0.. over ``source`` (with x0 .. xn-1) that end in ``curve`` with column hilbert."""
    ctes, at = [], source
    step = 0
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        for i in range(n):
            cols = [f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, xor(x0, x{i}) & {q - 1}) END AS x0"]
            if i:
                cols.append(f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {q - 1}) END AS x{i}")
            ctes.append(f"h{step} AS (SELECT * REPLACE ({', '.join(cols)}) FROM {at})")
            at, step = f"h{step}", step + 1
    for i in range(1, n):
        ctes.append(f"h{step} AS (SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM {at})")
        at, step = f"h{step}", step + 1
    t = "0"
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        t = f"xor({t}, CASE WHEN x{n - 1} & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    flat = ", ".join(f"xor(x{i}, {t}) AS x{i}" for i in range(n))
    ctes.append(f"h{step} AS (SELECT * REPLACE ({flat}) FROM {at})")
    at = f"h{step}"
    index = " + ".join(
        f"((x{i} >> {b}) & 1) * {1 << (b * n + n - 1 - i)}" for b in range(bits - 1, -1, -1) for i in range(n)
    )
    ctes.append(f"curve AS (SELECT *, ({index})::BIGINT AS hilbert FROM {at})")
    return ",\n".join(ctes)


def _crc_table() -> str:
    """CRC-32 (reflected polynomial EDB88320) of the 16 nibbles."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(str(x))
    return "[" + ", ".join(table) + "]::BIGINT[]"


def _cell(name: str, i: int) -> str:
    return f"""q{i} AS (
  SELECT {name} AS v{i}, floor((sum(c) OVER (ORDER BY {name} NULLS LAST) - c) * 16 / sum(c) OVER ())::BIGINT AS x{i}
  FROM (SELECT {name}, count(*) AS c FROM d GROUP BY {name}))"""


SQL["op9_hilbert_shards"] = rf"""
WITH raw AS (
  SELECT doc_id, lang, source, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
         list_transform(string_split(regexp_replace(hex(coalesce(text, '')), '(.)(.)', '\2\1', 'g'), ''),
                        lambda c: instr('0123456789ABCDEF', c) - 1) AS nibbles
  FROM documents
), d AS (
  SELECT doc_id, lang, source, size, CASE WHEN size = 16 THEN 0 ELSE xor(4294967295, list_reduce(nibbles,
         lambda a, b: xor(({_crc_table()})[(xor(a, b) & 15) + 1], a >> 4), 4294967295::BIGINT)) END::BIGINT AS text_crc32
  FROM raw
), {_cell("lang", 0)}, {_cell("source", 1)}, {_cell("size", 2)},
x AS (
  SELECT d.*, x0, x1, x2 FROM d JOIN q0 ON lang IS NOT DISTINCT FROM v0 JOIN q1 ON source IS NOT DISTINCT FROM v1 JOIN q2 ON size = v2
), {_hilbert_sql(4, 3, "x")},
r AS (SELECT *, row_number() OVER (ORDER BY hilbert, doc_id, text_crc32) - 1 AS b, count(*) OVER () AS n FROM curve),
s AS (SELECT *, least(b * 40 // n, 39)::INT AS shard FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (b - min(b) OVER (PARTITION BY shard))::BIGINT AS slot,
       NULL::INT AS grown_shard, hilbert FROM s
"""

SQL["op10_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
), r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND (page_id IS NULL OR page_id > first) AS revisit FROM m)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first END AS refers_to, NULL::VARCHAR AS error
FROM r
"""

SQL["op3_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), w AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM d
), p AS (
  SELECT doc_id, line, place, row_number() OVER (ORDER BY doc_id NULLS LAST, place) AS g,
         row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM w WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), s AS (
  SELECT doc_id, list(line ORDER BY i) AS ls FROM p GROUP BY doc_id
), k AS (
  SELECT g, h, md5(array_to_string(ls[i:i + h - 1], chr(10))) AS run
  FROM p JOIN s ON p.doc_id IS NOT DISTINCT FROM s.doc_id, (SELECT 1::BIGINT << unnest(range(0, 16)) AS h) WHERE i + h - 1 <= n
), f AS (
  SELECT g, h, min(g) OVER (PARTITION BY h, run) AS q FROM k
), best AS (
  SELECT g, max(h) AS h, arg_max(q, h) AS q FROM f WHERE q < g GROUP BY g
), steps AS (
  SELECT g, q, unnest(range(0, 2 * h)) AS k FROM best
), lcp AS (
  SELECT s.g, min(s.k) FILTER (WHERE a.line IS DISTINCT FROM b.line OR a.line IS NULL) AS len
  FROM steps s JOIN p x ON x.g = s.g JOIN p y ON y.g = s.q
  LEFT JOIN p a ON a.g = s.g + s.k AND a.doc_id IS NOT DISTINCT FROM x.doc_id
  LEFT JOIN p b ON b.g = s.q + s.k AND b.doc_id IS NOT DISTINCT FROM y.doc_id GROUP BY s.g
), r AS (
  SELECT doc_id, len, g + len > coalesce(max(g + len) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS own
  FROM lcp JOIN p USING (g)
), c AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE own) AS n_runs, max(len) AS longest_run FROM r GROUP BY doc_id
), o AS (
  SELECT w.doc_id, string_agg(w.line, chr(10) ORDER BY w.place) AS kept
  FROM w LEFT JOIN p ON p.doc_id IS NOT DISTINCT FROM w.doc_id AND p.place = w.place LEFT JOIN best ON best.g = p.g WHERE best.g IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       coalesce(longest_run, 0)::BIGINT AS longest_run, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN o ON o.doc_id IS NOT DISTINCT FROM d.doc_id
"""

SQL["op4_substring_dedup"] = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50
), k AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS run FROM p
), f AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY run) AS least FROM k) WHERE doc_id > least
), g AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 49)) AS q FROM f
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS q FROM d
), o AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS kept FROM words ANTI JOIN g USING (doc_id, q) GROUP BY doc_id
), c AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""


def _enc(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _crc32(nibbles: str) -> str:
    step = f"xor(({_crc_table()})[(xor(a, b) & 15) + 1], a >> 4)"
    return f"xor(4294967295, list_reduce({nibbles}, lambda a, b: {step}, 4294967295::BIGINT))"


def _tree_sql(name: str, key: str, leaves: str) -> str:
    """CTE ``name`` (key, level, pos, h, n): the nodes of the trees over ``leaves`` (key, pos, h, n)."""
    return f"""{name} AS (
  SELECT {key}, 0 AS level, pos, h, n FROM {leaves}
  UNION ALL
  SELECT {key}, level + 1, pos // 2, sha256(h || coalesce(nxt, '')), n
  FROM (SELECT *, lead(h) OVER (PARTITION BY {key} ORDER BY pos) AS nxt FROM {name} WHERE n > (1::BIGINT << level)) WHERE pos % 2 = 0)"""


def _fold_sql(name: str, start: str, nodes: str, key: str) -> str:
    """CTE ``name``: the nodes on the way from each row of ``start`` (rid, key, pos, n, h) to its root, recomputed."""
    return f"""{name} AS (
  SELECT rid, {key}, pos, n, 0 AS level, h FROM {start}
  UNION ALL
  SELECT f.rid, f.{key}, f.pos // 2, f.n, f.level + 1,
         sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END)
  FROM {name} f LEFT JOIN {nodes} s ON f.{key} IS NOT DISTINCT FROM s.{key} AND f.level = s.level AND xor(f.pos, 1) = s.pos
  WHERE f.n > (1::BIGINT << f.level))"""


_SUBROOTS = """(SELECT l.rid, 0 AS one, b.pos, b.n, l.h FROM low l JOIN subs b ON l.lang IS NOT DISTINCT FROM b.lang
  WHERE l.n <= (1::BIGINT << l.level))"""

SQL["op13_merkle_manifest"] = rf"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, {_enc("doc_id")} || {_enc("source")} || {_enc("lang")} AS head,
         {_enc("n_chars")} AS chars, {_enc("(n_chars + 1)")} AS chars1, {_enc("text")} AS tail,
         list_transform(string_split(regexp_replace(hex(doc_id::VARCHAR), '(.)(.)', '\2\1', 'g'), ''),
                        lambda c: instr('0123456789ABCDEF', c) - 1) AS nibbles FROM documents
), hashed AS (
  SELECT rid, doc_id, lang, sha256(head || chars || tail) AS h,
         CASE WHEN {_crc32("nibbles")} % 7 = 0 THEN sha256(head || chars1 || tail) ELSE sha256(head || chars || tail) END AS changed
  FROM raw
), p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), {_tree_sql("nodes", "lang", "p")}, subs AS (
  SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM nodes
  WHERE pos = 0 AND n <= (1::BIGINT << level)
), {_tree_sql("top", "one", "subs")}, root AS (
  SELECT h AS root FROM top WHERE pos = 0 AND n <= (1::BIGINT << level)
), steps AS (
  SELECT p.rid, 0 AS part, s.level, s.h FROM (SELECT *, unnest(range(0, 40)) AS k FROM p) p
  JOIN nodes s ON p.lang IS NOT DISTINCT FROM s.lang AND p.k = s.level AND xor(p.pos >> p.k, 1) = s.pos AND p.n > (1::BIGINT << p.k)
  UNION ALL
  SELECT p.rid, 1, s.level, s.h FROM p JOIN (SELECT *, unnest(range(0, 40)) AS k FROM subs) b ON p.lang IS NOT DISTINCT FROM b.lang
  JOIN top s ON b.k = s.level AND xor(b.pos >> b.k, 1) = s.pos AND b.n > (1::BIGINT << b.k)
), proof AS (
  SELECT rid, sha256(string_agg(h, '' ORDER BY part, level)) AS proof_sha256 FROM steps GROUP BY rid
), {_fold_sql("low", "(SELECT rid, lang, pos, n, changed AS h FROM p)", "nodes", "lang")},
{_fold_sql("high", _SUBROOTS, "top", "one")}, folded AS (
  SELECT rid, h AS folded_root FROM high WHERE n <= (1::BIGINT << level)
)
SELECT doc_id, p.h AS leaf, subs.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang CROSS JOIN root LEFT JOIN proof USING (rid) JOIN folded USING (rid)
"""
