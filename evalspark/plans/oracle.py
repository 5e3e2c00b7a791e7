"""DuckDB SQL twins of the registered queries (independent formulations, used as the oracle).

The driver registers the parquet tables as views; every statement here starts from them.
Metric twins deliberately use a different method from the Spark plans: n-grams come from ``lead`` over
token rows, alignments from joins of ranked rows.
"""

from __future__ import annotations

# --- derived views -------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
ASCII = "[a-z0-9]+"

V_PAIRS = """
pairs AS (
  SELECT d.doc_id AS pair_id, b.item_id AS sno,
         'm' || CAST((d.doc_id // (SELECT count(*) FROM benchmark)) % 5 AS VARCHAR) AS model,
         d.text AS candidate, b.text AS reference
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
)"""

V_PAIRS_EDIT = f"""
doc_tokens AS (
  SELECT doc_id, regexp_extract_all(text, '{WORD}') AS r FROM documents
),
pairs_edit AS (
  SELECT CAST(doc_id AS VARCHAR) || '-' || model AS pair_id, doc_id AS sno, model,
         array_to_string(toks, ' ') AS candidate, array_to_string(r, ' ') AS reference
  FROM (
    SELECT doc_id, r, 'm_drop2' AS model, list_filter(r, lambda x, i: i % 2 <> 0) AS toks FROM doc_tokens
    UNION ALL
    SELECT doc_id, r, 'm_drop7', list_filter(r, lambda x, i: i % 7 <> 0) FROM doc_tokens
    UNION ALL
    SELECT doc_id, r, 'm_swap', CASE WHEN len(r) > 10 THEN r[11:] || r[1:10] ELSE r END FROM doc_tokens
  )
)"""


def overlap_ctes(src: str, kind: str, orders: list[int], prefix: str) -> str:
    """CTEs ``{prefix}_stats(pair_id, n, o, c, r)`` with clipped overlaps for every pair and order.

    Each text is split once; n-grams come from ``lead`` over the token rows (a list lambda that slices
    its own list copies that list per element)."""
    if kind == "treebank":
        ce, re_ = "c", "r"
        src = f"{src}_treebank"
    elif kind == "ascii":
        ce, re_ = f"regexp_extract_all(lower(candidate), '{ASCII}')", f"regexp_extract_all(lower(reference), '{ASCII}')"
    else:
        ce, re_ = f"regexp_extract_all(candidate, '{WORD}')", f"regexp_extract_all(reference, '{WORD}')"
    order_list = ", ".join(str(n) for n in orders)
    leads = "".join(f", lead(tok, {k}) OVER w AS t{k}" for k in range(1, max(orders)))
    grams = " UNION ALL ".join(
        f"SELECT pair_id, side, {n} AS n, {' || chr(32) || '.join(['tok', *[f't{k}' for k in range(1, n)]])} AS g FROM {prefix}_pos"
        + (f" WHERE t{n - 1} IS NOT NULL" if n > 1 else "")
        for n in orders
    )
    return f"""
{prefix}_tok AS MATERIALIZED (SELECT pair_id, {ce} AS c, {re_} AS r FROM {src}),
{prefix}_pos AS MATERIALIZED (
  SELECT pair_id, side, tok{leads} FROM (
    SELECT pair_id, 0 AS side, unnest(c) AS tok, generate_subscripts(c, 1) AS pos FROM {prefix}_tok
    UNION ALL SELECT pair_id, 1, unnest(r), generate_subscripts(r, 1) FROM {prefix}_tok
  ) WINDOW w AS (PARTITION BY pair_id, side ORDER BY pos)
),
{prefix}_cnt AS (
  SELECT pair_id, n, g, count(*) FILTER (WHERE side = 0) AS c, count(*) FILTER (WHERE side = 1) AS r
  FROM ({grams}) GROUP BY ALL
),
{prefix}_o AS (SELECT pair_id, n, sum(least(c, r)) AS o FROM {prefix}_cnt GROUP BY ALL),
{prefix}_stats AS (
  SELECT l.pair_id, o.n, coalesce(x.o, 0) AS o, greatest(len(l.c) - o.n + 1, 0) AS c, greatest(len(l.r) - o.n + 1, 0) AS r,
         len(l.c) AS lc, len(l.r) AS lr
  FROM {prefix}_tok l CROSS JOIN (SELECT unnest([{order_list}]) AS n) o
  LEFT JOIN {prefix}_o x ON x.pair_id = l.pair_id AND x.n = o.n
)"""


# Each word of a sentence stands between blanks of its own, so that a rule may use up the blank before or behind
# a word where a lookaround would be needed.  Sentences are rows; ^ and $ are their ends.
V_PAIRS_QUOTED = """
doc_words AS (
  SELECT doc_id, list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x, i: {mark}) AS r FROM documents
),
pairs_quoted AS (
  SELECT CAST(doc_id AS VARCHAR) || '-' || model AS pair_id, doc_id AS sno, model,
         array_to_string(toks, ' ') AS candidate, array_to_string(r, ' ') AS reference
  FROM (
    SELECT doc_id, r, 'm_drop2' AS model, list_filter(r, lambda x, i: i % 2 <> 0) AS toks FROM doc_words
    UNION ALL
    SELECT doc_id, r, 'm_drop7', list_filter(r, lambda x, i: i % 7 <> 0) FROM doc_words
    UNION ALL
    SELECT doc_id, r, 'm_swap', CASE WHEN len(r) > 10 THEN r[11:] || r[1:10] ELSE r END FROM doc_words
  )
)"""


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _marked() -> str:
    from evalspark.sources.views import MARKS

    x = "x"
    for period, place, before, after in MARKS:
        x = f"(CASE WHEN i % {period} = {place} THEN {_lit(before)} ELSE '' END || {x} || CASE WHEN i % {period} = {place} THEN {_lit(after)} ELSE '' END)"
    return x


V_PAIRS_QUOTED = V_PAIRS_QUOTED.replace("{mark}", _marked())


def _chain(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, {_lit(pattern)}, {_lit(to)}, 'g')"
    return x


def treebank_sentences(text: str) -> str:
    """List of a text's sentences: a blank ends one if stop marks stand before it and a capital or digit behind, and the
    word before the stop is no abbreviation."""
    short = "|".join(
        a.replace(".", "[.]") for a in (
            "mr mrs ms dr prof rev gen sen rep gov capt lt col sgt st jr sr messrs mt vs inc ltd co corp dept univ no nos vol fig figs eq "
            "pp eds al approx e.g i.e u.s u.k jan feb mar apr jun jul aug sep sept oct nov dec"
        ).split()
    )
    blank = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    wide = f"'  ' || regexp_replace({text}, {_lit(blank)}, '  ', 'g') || '  '"
    rules = [
        (rf"([^\p{{L}}\p{{N}}_.])((?:(?i:{short})|\p{{Lu}})[.]) ", r"\1\2" + "\x02"),
        (r"""([.?!…]['")\]}»”’]*) ( ['"(\[{«“‘]*[\p{Lu}\p{N}])""", r"\1" + "\x03" + r"\2"),
        ("\x02", " "),
    ]
    return f"list_filter(list_transform(string_split({_chain(wide, rules)}, '\x03'), lambda s: trim(regexp_replace(s, ' +', ' ', 'g'))), lambda s: s <> '')"


def treebank_words(sentence: str) -> str:
    """List of a sentence's tokens."""
    ends = [
        (r"([«“‘„]|`+)", r" \1 "),
        (r'^"', "``"),
        ("``", " `` "),
        (r"""([ (\[{<])(?:"|'')""", r"\1 `` "),
        (r"'([^\P{L}mtsdnMTSDN]|[\p{N}_])([^\p{L}\p{N}_]|$)", r"' \1\2"),
        (r"'([^\P{L}mtsdnMTSDN]|[\p{N}_])([^\p{L}\p{N}_]|$)", r"' \1\2"),
        (r"""([^.])[.]([\])}>"'»”’ ]*)$""", r"\1 . \2 "),
        (r"([:,])(\P{Nd})", r" \1 \2"),
        (r"([:,])$", r" \1 "),
        (r"([.][.]+)", r" \1 "),
        (r"([;@#$%&?!*])", r" \1 "),
        (r"([\]\[(){}<>])", r" \1 "),
        (r"([^'])' ", r"\1 ' "),
        ("--", " -- "),
        (r"^(.*)$", r" \1 "),
        (r"([»”’])", r" \1 "),
        (r"''", " '' "),
        (r'"', " '' "),
        (r" +", "  "),
        (r"([^' ])('[sSmMdD]|') ", r"\1  \2  "),
        (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1  \2  "),
    ]
    for two in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n")):
        ends.append((rf"(?i)([^\p{{L}}\p{{N}}_])({two[0]})({two[1]})([^\p{{L}}\p{{N}}_])", r"\1 \2  \3 \4"))
    ends += [
        (r"(?i)([^\p{L}\p{N}_])(wan)(na) ", r"\1 \2  \3  "),
        (r"(?i) ('t)(is|was)([^\p{L}\p{N}_])", r" \1  \2 \3"),
    ]
    return f"regexp_extract_all({_chain(sentence, ends)}, '[^ ]+')"


def treebank_ctes(src: str) -> str:
    """CTE ``{src}_treebank`` (pair_id, candidate, reference, c, r): both texts' tokens, sentence by sentence."""
    return f"""
{src}_lines AS (
  SELECT pair_id, side, unnest(s) AS s, generate_subscripts(s, 1) AS place FROM (
    SELECT pair_id, 0 AS side, {treebank_sentences('candidate')} AS s FROM {src}
    UNION ALL SELECT pair_id, 1, {treebank_sentences('reference')} FROM {src})
),
{src}_words AS (
  SELECT pair_id, side, count(*) AS n, flatten(list({treebank_words('s')} ORDER BY place)) AS w FROM {src}_lines GROUP BY ALL
),
{src}_treebank AS (
  SELECT p.pair_id, candidate, reference, coalesce(a.n, 0) AS n_c, coalesce(a.w, []) AS c, coalesce(b.w, []) AS r FROM {src} p
  LEFT JOIN {src}_words a ON a.pair_id = p.pair_id AND a.side = 0 LEFT JOIN {src}_words b ON b.pair_id = p.pair_id AND b.side = 1
)"""


def lcs_ctes(src: str) -> str:
    """CTE ``lcs(pair_id, lcs, lc, lr)``: longest common subsequence of the ascii tokens, for WITH RECURSIVE.

    The table of a pair is taken in blocks of 120 × 120 tokens, a bit for each reference token.  The rows of a block
    are one list, whose reduction adds v, v & m (m: the row's places) and the carry of the block on the left; the accumulator
    is [v, carries].  A block hands v down and its carries to the right, so the recursion runs over anti-diagonals."""
    full = (1 << 120) - 1
    total = "(acc[1] + (acc[1] & e[1]) + e[2])"
    step = f"lambda acc, e: [({total} & {full}::HUGEINT) | (acc[1] & ~e[1]), acc[2] | (({total} >> 120) << e[3]::INT)]"
    rows = "list_transform(ms, lambda m, i: [m, (coalesce(cin, 0::HUGEINT) >> (i - 1)::INT) & 1, (i - 1)::HUGEINT])"
    return f"""
lt AS MATERIALIZED (
  SELECT pair_id, regexp_extract_all(lower(candidate), '{ASCII}') AS c, regexp_extract_all(lower(reference), '{ASCII}') AS r FROM {src}
),
lbits AS (
  SELECT pair_id, tok, j // 120 AS b, sum(1::HUGEINT << (j % 120)::INT)::HUGEINT AS m
  FROM (SELECT pair_id, unnest(r) AS tok, generate_subscripts(r, 1) - 1 AS j FROM lt) GROUP BY ALL
),
lplaces AS (
  SELECT pair_id, tok, i, unnest(range(0, (n + 119) // 120)) AS b
  FROM (SELECT pair_id, unnest(c) AS tok, generate_subscripts(c, 1) - 1 AS i, len(r) AS n FROM lt)
),
lmask AS MATERIALIZED (
  SELECT pair_id, i // 120 AS a, b, list(coalesce(m, 0::HUGEINT) ORDER BY i) AS ms FROM lplaces LEFT JOIN lbits USING (pair_id, tok, b)
  GROUP BY ALL
),
lrun AS (
  SELECT pair_id, a, b, list_reduce(list_transform(ms, lambda m, i: [m, 0::HUGEINT, (i - 1)::HUGEINT]), {step}, [{full}::HUGEINT, 0::HUGEINT]) AS acc
  FROM lmask WHERE a = 0 AND b = 0
  UNION ALL
  SELECT pair_id, a, b, list_reduce({rows}, {step}, [coalesce(v, {full}::HUGEINT), 0::HUGEINT]) AS acc FROM (
    SELECT pair_id, a, b, max(v) AS v, max(cin) AS cin FROM (
      SELECT pair_id, unnest([a + 1, a]) AS a, unnest([b, b + 1]) AS b, unnest([acc[1], NULL]) AS v, unnest([NULL, acc[2]]) AS cin FROM lrun
    ) GROUP BY ALL
  ) JOIN lmask USING (pair_id, a, b)
),
lcs AS (
  SELECT pair_id, coalesce(zeros, 0)::BIGINT AS lcs, len(c) AS lc, len(r) AS lr FROM lt LEFT JOIN (
    SELECT pair_id, sum(120 - bit_count(acc[1])) AS zeros FROM lrun JOIN lt USING (pair_id) WHERE a = (len(c) - 1) // 120 GROUP BY pair_id
  ) USING (pair_id)
)"""


def f1_sql(o: str, c: str, r: str) -> str:
    p = f"({o}::DOUBLE / greatest({c}, 1))"
    q = f"({o}::DOUBLE / greatest({r}, 1))"
    return f"CASE WHEN {p} + {q} > 0 THEN 2.0 * {p} * {q} / ({p} + {q}) ELSE 0.0 END"


def rouge_n_sql(view_cte: str, src: str, n: int, alias: str) -> str:
    return f"""
WITH {view_cte},
{overlap_ctes(src, 'ascii', [n], 'x')}
SELECT s.pair_id, v.sno, v.model, round_even({f1_sql('s.o', 's.c', 's.r')}, 4) AS {alias}
FROM x_stats s JOIN {src} v USING (pair_id)"""


def bleu_select(stats: str) -> str:
    """BLEU from a stats CTE with rows per (pair_id, n) for n = 1..4."""
    return f"""
bleu_w AS (
  SELECT pair_id,
    max(CASE WHEN n = 1 THEN o END) AS o1, max(CASE WHEN n = 1 THEN c END) AS c1,
    max(CASE WHEN n = 2 THEN o END) AS o2, max(CASE WHEN n = 2 THEN c END) AS c2,
    max(CASE WHEN n = 3 THEN o END) AS o3, max(CASE WHEN n = 3 THEN c END) AS c3,
    max(CASE WHEN n = 4 THEN o END) AS o4, max(CASE WHEN n = 4 THEN c END) AS c4,
    max(lc) AS lc, max(lr) AS lr
  FROM {stats} GROUP BY pair_id
),
bleu_p AS (
  SELECT pair_id, lc, lr,
    CASE WHEN c1 > 0 THEN o1::DOUBLE / c1 ELSE 0.0 END AS p1,
    CASE WHEN c2 > 0 THEN o2::DOUBLE / c2 ELSE 0.0 END AS p2,
    CASE WHEN c3 > 0 THEN o3::DOUBLE / c3 ELSE 0.0 END AS p3,
    CASE WHEN c4 > 0 THEN o4::DOUBLE / c4 ELSE 0.0 END AS p4
  FROM bleu_w
),
bleu_s AS (
  SELECT pair_id,
    CASE WHEN lr = 0 THEN NULL WHEN lc = 0 THEN 0.0 ELSE round_even(
      (CASE WHEN least(p1, p2, p3, p4) > 0
            THEN exp(0.25 * ln(p1) + 0.25 * ln(p2) + 0.25 * ln(p3) + 0.25 * ln(p4)) ELSE 0.0 END)
      * (CASE WHEN lc::DOUBLE / lr > 1.0 THEN 1.0 ELSE exp(1.0 - 1.0 / (lc::DOUBLE / lr)) END), 4) END AS bleu
  FROM bleu_p
)"""


def bleu_sql(view_cte: str, src: str, kind: str = "word") -> str:
    return f"""
WITH {view_cte},
{overlap_ctes(src, kind, [1, 2, 3, 4], 'x')},
{bleu_select('x_stats')}
SELECT b.pair_id, v.sno, v.model, b.bleu FROM bleu_s b JOIN {src} v USING (pair_id)"""


SQL: dict[str, str] = {}
SQL["rouge1"] = rouge_n_sql(V_PAIRS, "pairs", 1, "rouge1")
SQL["rouge2"] = rouge_n_sql(V_PAIRS_EDIT, "pairs_edit", 2, "rouge2")
SQL["bleu"] = bleu_sql(V_PAIRS_EDIT, "pairs_edit")


_ROUGE_L = f"""
WITH RECURSIVE {V_PAIRS_EDIT},
{lcs_ctes('pairs_edit')}
SELECT v.pair_id, v.sno, v.model, round_even({f1_sql('l.lcs', 'l.lc', 'l.lr')}, 4) AS rouge_l FROM lcs l JOIN pairs_edit v USING (pair_id)"""
SQL["rouge_l"] = _ROUGE_L
SQL["rouge_l_blocks"] = _ROUGE_L
SQL["bleu_treebank"] = bleu_sql(f"{V_PAIRS_QUOTED},\n{treebank_ctes('pairs_quoted')}", "pairs_quoted", "treebank")
SQL["tokenize_treebank"] = f"""
WITH {V_PAIRS_QUOTED}, pq AS (SELECT pair_id, candidate, reference FROM pairs_quoted WHERE model = 'm_swap'),
{treebank_ctes('pq')}
SELECT pair_id, n_c::BIGINT AS n_sentences, len(c)::BIGINT AS n_words, array_to_string(c, ' ') AS words FROM pq_treebank"""


def meteor_ctes(src: str) -> str:
    """CTEs ending in ``met(pair_id, meteor)``."""
    return f"""
mt AS (SELECT pair_id, regexp_extract_all(lower(candidate), '{WORD}') AS c,
              regexp_extract_all(lower(reference), '{WORD}') AS r FROM {src}),
ct AS (SELECT pair_id, unnest(c) AS tok, generate_subscripts(c, 1) AS pos FROM mt),
rt AS (SELECT pair_id, unnest(r) AS tok, generate_subscripts(r, 1) AS pos FROM mt),
cr AS (SELECT pair_id, tok, pos, row_number() OVER (PARTITION BY pair_id, tok ORDER BY pos DESC) AS k FROM ct),
rr AS (SELECT pair_id, tok, pos, row_number() OVER (PARTITION BY pair_id, tok ORDER BY pos DESC) AS k FROM rt),
al AS (SELECT cr.pair_id, cr.pos AS cpos, rr.pos AS rpos FROM cr JOIN rr USING (pair_id, tok, k)),
ch AS (
  SELECT pair_id, cpos, rpos,
         CASE WHEN lag(cpos) OVER w IS NULL OR cpos <> lag(cpos) OVER w + 1 OR rpos <> lag(rpos) OVER w + 1
              THEN 1 ELSE 0 END AS brk
  FROM al WINDOW w AS (PARTITION BY pair_id ORDER BY cpos)
),
agg AS (SELECT pair_id, count(*) AS m, sum(brk) AS chunks FROM ch GROUP BY pair_id),
sc AS (
  SELECT mt.pair_id, coalesce(agg.m, 0) AS m, agg.chunks, len(mt.c) AS lc, len(mt.r) AS lr
  FROM mt LEFT JOIN agg USING (pair_id)
),
met AS (
  SELECT pair_id, CASE WHEN m = 0 THEN 0.0 ELSE round_even(
    (1.0 - 0.5 * pow(chunks::DOUBLE / m, 3.0))
    * ((m::DOUBLE / lc) * (m::DOUBLE / lr) / (0.9::DOUBLE * (m::DOUBLE / lc) + (1.0 - 0.9::DOUBLE) * (m::DOUBLE / lr))), 4) END AS meteor
  FROM sc
)"""


def meteor_sql(view_cte: str, src: str) -> str:
    return f"""
WITH {view_cte},
{meteor_ctes(src)}
SELECT v.pair_id, v.sno, v.model, met.meteor FROM met JOIN {src} v USING (pair_id)"""


SQL["meteor_exact"] = meteor_sql(V_PAIRS_EDIT, "pairs_edit")

SQL["tokenize"] = f"""
SELECT doc_id, len(regexp_extract_all(lower(text), '{ASCII}'))::BIGINT AS n_ascii,
       len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n_word,
       array_to_string(regexp_extract_all(lower(text), '{WORD}'), ' ') AS words_lower
FROM documents"""

V_VECTOR_PAIRS = """
anchor AS (SELECT label, min(vec_id) AS anchor_id FROM embeddings GROUP BY label),
vector_pairs AS (
  SELECT e.vec_id, e.label, a.anchor_id, e.embedding AS x, b.embedding AS y
  FROM embeddings e JOIN anchor a USING (label) JOIN embeddings b ON b.vec_id = a.anchor_id
)"""

SQL["cosine"] = f"""
WITH {V_VECTOR_PAIRS},
d AS (
  SELECT vec_id, label, anchor_id, len(x) AS lx, len(y) AS ly,
    list_reduce(list_transform(list_zip(x, y), lambda p: p[1]::DOUBLE * p[2]::DOUBLE), lambda a, b: a + b) AS dot,
    sqrt(list_reduce(list_transform(x, lambda v: v::DOUBLE * v::DOUBLE), lambda a, b: a + b))
      * sqrt(list_reduce(list_transform(y, lambda v: v::DOUBLE * v::DOUBLE), lambda a, b: a + b)) AS nrm
  FROM vector_pairs
)
SELECT vec_id, label, anchor_id, CASE WHEN lx = ly AND nrm > 0 THEN round_even(dot / nrm, 4) END AS cosine FROM d"""


# --- scores over pairs_edit and the report family -------------------------------------------------

V_SCORES = f"""{V_PAIRS_EDIT},
{overlap_ctes('pairs_edit', 'ascii', [1, 2], 'ra')},
{overlap_ctes('pairs_edit', 'word', [1, 2, 3, 4], 'bw')},
{bleu_select('bw_stats')},
{meteor_ctes('pairs_edit')},
wide AS (
  SELECT v.pair_id, v.sno, v.model,
    round_even({f1_sql('r1.o', 'r1.c', 'r1.r')}, 4) AS rouge1,
    round_even({f1_sql('r2.o', 'r2.c', 'r2.r')}, 4) AS rouge2,
    b.bleu, met.meteor
  FROM pairs_edit v
  JOIN ra_stats r1 ON r1.pair_id = v.pair_id AND r1.n = 1
  JOIN ra_stats r2 ON r2.pair_id = v.pair_id AND r2.n = 2
  JOIN bleu_s b ON b.pair_id = v.pair_id
  JOIN met ON met.pair_id = v.pair_id
),
scores AS (
  SELECT sno, model, 'ROUGE-1_F1' AS metric, rouge1 AS score FROM wide
  UNION ALL SELECT sno, model, 'ROUGE-2_F1', rouge2 FROM wide
  UNION ALL SELECT sno, model, 'BLEU', bleu FROM wide
  UNION ALL SELECT sno, model, 'METEOR', meteor FROM wide
),
prompts AS (SELECT doc_id AS sno, text AS prompt FROM documents)"""

METRICS = [
    "ROUGE-1_F1", "ROUGE-2_F1", "ROUGE-L_F1", "BLEU", "METEOR", "Cosine_Similarity_Score",
    "Coherence_Score", "Hallucination_Score", "Relevance_Score", "Faithfulness_Score",
]
V_REPORT = f"""
scores AS (
  SELECT user_id AS sno, event_type AS model, {[*METRICS, "generated_text"]}[event_id % 11 + 1] AS metric,
         CASE WHEN event_id % 11 <> 10 AND event_id % 13 <> 0 THEN (event_id * 37 % 101)::DOUBLE / 100 END AS score
  FROM events WHERE NOT (event_type = 'signup' AND event_id % 11 = 3)
),
prompts AS (SELECT doc_id AS sno, text AS prompt FROM documents)"""


def _pivot_cols(metric_list: list[str]) -> str:
    return ", ".join(f"round_even(avg(score) FILTER (WHERE metric = '{m}'), 9) AS \"{m}\"" for m in metric_list)


SQL["scores"] = f"WITH {V_SCORES} SELECT sno, model, metric, score FROM scores"
SQL["score_all"] = f"""
WITH RECURSIVE {V_SCORES},
{lcs_ctes('pairs_edit')},
rl AS (SELECT pair_id, round_even({f1_sql('lcs', 'lc', 'lr')}, 4) AS rougel FROM lcs),
five AS (SELECT wide.*, rougel FROM wide JOIN rl USING (pair_id)),
rows AS (
  SELECT pair_id, sno, model, 'ROUGE-1_F1' AS metric, rouge1 AS score FROM five
  UNION ALL SELECT pair_id, sno, model, 'ROUGE-2_F1', rouge2 FROM five
  UNION ALL SELECT pair_id, sno, model, 'ROUGE-L_F1', rougel FROM five
  UNION ALL SELECT pair_id, sno, model, 'BLEU', bleu FROM five
  UNION ALL SELECT pair_id, sno, model, 'METEOR', meteor FROM five
)
SELECT *, CASE WHEN score IS NULL THEN metric || ' could not be computed for this pair' END AS note FROM rows"""
SQL["assemble_report"] = f"""WITH {V_REPORT},
per AS (SELECT sno, model, count(*) AS k FROM (SELECT DISTINCT sno, model, metric FROM scores) GROUP BY ALL)
SELECT p.sno AS SNO, substring(pr.prompt, 1, 70) || '...' AS label,
       count(*)::INTEGER AS n_models, sum(k)::INTEGER AS n_scores
FROM per p LEFT JOIN prompts pr USING (sno) GROUP BY p.sno, pr.prompt"""
SQL["flatten_report"] = f"WITH {V_REPORT} SELECT sno, model, metric, round_even(avg(score), 9) AS score FROM scores GROUP BY ALL"
SQL["coerce_score"] = """
SELECT event_id,
  CASE WHEN isnan(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) THEN NULL
       ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k_score,
  CASE WHEN isnan(TRY_CAST(props AS DOUBLE)) THEN NULL ELSE TRY_CAST(props AS DOUBLE) END AS props_score
FROM events"""
SQL["filter_scores"] = f"WITH {V_REPORT} SELECT sno, model, metric, score FROM scores WHERE score IS NOT NULL AND metric IN ('BLEU', 'METEOR') AND model IN ('click', 'view', 'error')"
SQL["prompt_scores"] = f"WITH {V_REPORT} SELECT sno, model, metric, score FROM scores WHERE score IS NOT NULL AND sno = 7"
SQL["mean_scores"] = f"WITH {V_REPORT} SELECT model, metric, round_even(avg(score), 9) AS mean_score FROM scores WHERE score IS NOT NULL GROUP BY ALL"
SQL["score_matrix"] = f"WITH {V_REPORT} SELECT model, {_pivot_cols(METRICS)} FROM scores WHERE score IS NOT NULL GROUP BY model"
SQL["prompt_matrix"] = f"WITH {V_REPORT} SELECT sno, model, {_pivot_cols(METRICS)} FROM scores WHERE score IS NOT NULL GROUP BY sno, model"
_MEANS = "mm AS (SELECT model, metric, avg(score) AS mean_score FROM scores WHERE score IS NOT NULL GROUP BY ALL)"
SQL["overall_mean"] = f"WITH {V_REPORT}, {_MEANS} SELECT model, round_even(avg(mean_score), 9) AS overall_mean FROM mm GROUP BY model"
_OM = "om AS (SELECT model, avg(mean_score) AS overall_mean FROM mm GROUP BY model)"
SQL["overall_winner"] = f"""WITH {V_REPORT}, {_MEANS}, {_OM}
SELECT model, round_even(overall_mean, 9) AS overall_mean FROM om ORDER BY round_even(overall_mean, 9) DESC, model ASC LIMIT 1"""
SQL["prompt_winners"] = f"""WITH {V_REPORT},
pm AS (SELECT sno, model, avg(m) AS prompt_mean FROM
        (SELECT sno, model, metric, avg(score) AS m FROM scores WHERE score IS NOT NULL GROUP BY ALL) GROUP BY sno, model),
rk AS (SELECT *, row_number() OVER (PARTITION BY sno ORDER BY round_even(prompt_mean, 9) DESC, model ASC) AS r FROM pm)
SELECT sno, model, round_even(prompt_mean, 9) AS prompt_mean FROM rk WHERE r = 1"""
SQL["winner_profile"] = f"""WITH {V_REPORT}, {_MEANS}, {_OM},
win AS (SELECT model FROM om ORDER BY round_even(overall_mean, 9) DESC, model ASC LIMIT 1),
prof AS (SELECT mm.* FROM mm JOIN win USING (model)),
pts AS (SELECT model, metric, mean_score, row_number() OVER (PARTITION BY model ORDER BY metric) AS point_no FROM prof),
n AS (SELECT model, count(*) AS n_points, max(mean_score) AS vmax FROM prof GROUP BY model)
SELECT p.model, coalesce(p.point_no, n.n_points + 1)::INTEGER AS point_no, p.metric, round_even(p.mean_score, 9) AS value,
       round_even(greatest(1.0, n.vmax * 1.1), 9) AS axis_max
FROM (SELECT * FROM pts UNION ALL SELECT model, metric, mean_score, NULL FROM pts WHERE point_no = 1) p
JOIN n USING (model)
"""
SQL["distinct_metrics"] = f"WITH {V_REPORT} SELECT DISTINCT metric FROM scores"
SQL["distinct_prompts"] = f"WITH {V_REPORT} SELECT DISTINCT s.sno, p.prompt FROM scores s JOIN prompts p USING (sno)"
SQL["prompt_labels"] = "SELECT doc_id AS sno, substring(text, 1, 70) || '...' AS label FROM documents"
SQL["label_index"] = "SELECT substring(text, 1, 70) || '...' AS label, max(doc_id) AS sno FROM documents GROUP BY 1"
SQL["prompt_text"] = f"WITH {V_REPORT} SELECT s.sno, min(p.prompt) AS prompt FROM (SELECT DISTINCT sno FROM scores) s JOIN prompts p USING (sno) GROUP BY s.sno"
SQL["prompt_positions"] = f"WITH {V_REPORT} SELECT sno, (row_number() OVER (ORDER BY sno) - 1)::BIGINT AS position FROM (SELECT DISTINCT sno FROM scores)"


# --- requests family ------------------------------------------------------------------------------

from evalspark.functions.prompt import TEMPLATE_QUESTION_ONLY, TEMPLATE_WITH_CONTEXT  # noqa: E402
from evalspark.functions.scalar import PY_WHITESPACE_CLASS  # noqa: E402
from evalspark.operators.requests import DEFAULT_MODELS  # noqa: E402

V_REQUESTS = """
conv_w AS (
  SELECT conv_id, turn, role, text,
    lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
    lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
requests AS (
  SELECT conv_id, turn,
    CASE WHEN turn < 2 AND conv_id % 5 = 0 THEN NULL WHEN turn < 2 AND conv_id % 5 = 1 THEN '' ELSE text END AS prompt,
    CASE WHEN next_role = 'assistant' THEN next_text END AS reference_answer,
    CASE WHEN prev_role = 'assistant' THEN prev_text END AS context,
    CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 8 AS VARCHAR) AS batch_id,
    (row_number() OVER (PARTITION BY conv_id, turn // 8 ORDER BY turn) - 1)::INTEGER AS item_index
  FROM conv_w WHERE role = 'user'
),
extra AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || b.name AS batch_id, b.item_index, b.input, b.error
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 7 = 3),
    (VALUES ('items', 0, '17', 'item is not a JSON object'), ('items', 1, 'text', 'item is not a JSON object'),
            ('broken', NULL, '[{"prompt": "no end"', 'request body must be a JSON array of evaluation objects or a single evaluation object'))
    b(name, item_index, input, error)
),
errors AS (
  SELECT batch_id, item_index, 'Error processing item ' || item_index || ': Prompt is required for item ' || item_index || '.' AS error,
         NULL::VARCHAR AS input
  FROM requests WHERE prompt IS NULL OR prompt = ''
  UNION ALL
  SELECT batch_id, item_index, 'Error processing item ' || coalesce(CAST(item_index AS VARCHAR), '?') || ': ' || error, input FROM extra
),
evals AS (
  SELECT sha256(batch_id || '|' || CAST(item_index AS VARCHAR)) AS evaluation_id, * FROM requests
  WHERE prompt IS NOT NULL AND prompt <> ''
)"""

_MODELS_SQL = "[" + ", ".join("'" + m + "'" for m in DEFAULT_MODELS) + "]"


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill_sql(template: str, values: dict[str, str]) -> str:
    text = _sql_lit(template)
    for name, column in values.items():
        text = text.replace("{" + name + "}", f"' || coalesce({column}, 'None') || '")
    return text


_VISIBLE = f"(context IS NOT NULL AND length(regexp_replace(context, '{PY_WHITESPACE_CLASS}', '', 'g')) > 0)"
_RAW = (
    f"CASE WHEN {_VISIBLE} THEN {_fill_sql(TEMPLATE_WITH_CONTEXT, {'question': 'prompt', 'context': 'context'})} "
    f"ELSE {_fill_sql(TEMPLATE_QUESTION_ONLY, {'question': 'prompt'})} END"
)

SQL["parse_requests"] = f"WITH {V_REQUESTS} SELECT batch_id, item_index, prompt, reference_answer, context FROM requests UNION ALL SELECT batch_id, item_index, NULL, NULL, NULL FROM extra"
SQL["validate_requests"] = f"""WITH {V_REQUESTS}
SELECT batch_id, item_index, true AS is_valid, NULL::VARCHAR AS error FROM evals
UNION ALL SELECT batch_id, item_index, false, error FROM errors"""
SQL["request_errors"] = f"WITH {V_REQUESTS} SELECT batch_id, item_index, error, input FROM errors"
SQL["initiate_evaluations"] = f"""WITH {V_REQUESTS}
SELECT evaluation_id, batch_id, item_index, 'INITIATED' AS status,
       array_to_string({_MODELS_SQL}, ',') AS requested, len(list_distinct({_MODELS_SQL}))::INTEGER AS n_pending
FROM evals"""
SQL["fan_out"] = f"WITH {V_REQUESTS} SELECT evaluation_id, unnest(list_distinct({_MODELS_SQL})) AS model FROM evals"
SQL["initiated_events"] = f"""WITH {V_REQUESTS}
SELECT evaluation_id, prompt, reference_answer, context, array_to_string({_MODELS_SQL}, ',') AS selected_llms FROM evals"""
SQL["model_list_errors"] = f"""WITH {V_REQUESTS}
SELECT batch_id, item_index, error FROM errors
UNION ALL
SELECT batch_id, item_index, CASE WHEN length(batch_id) % 2 = 0 THEN
  'Error processing item ' || item_index || ': No models configured for evaluation.' END AS error FROM evals"""
SQL["resolve_label"] = """
SELECT substring(d.text, 1, 70) || '...' AS label, m.sno
FROM documents d JOIN (SELECT substring(text, 1, 70) AS t, max(doc_id) AS sno FROM documents GROUP BY 1) m ON m.t = substring(d.text, 1, 70)
WHERE d.doc_id % 3 = 0"""
SQL["read_report"] = SQL["flatten_report"]
SQL["response_key"] = f"""WITH {V_REQUESTS}
SELECT evaluation_id, model, evaluation_id || '/' || replace(lower(model), ' ', '_') || '_response.json' AS response_key
FROM (SELECT evaluation_id, unnest(list_distinct({_MODELS_SQL})) AS model FROM evals)"""
SQL["format_prompt"] = f"""WITH {V_REQUESTS},
raw AS (SELECT batch_id, item_index, {_RAW} AS raw FROM evals),
ls AS (SELECT batch_id, item_index,
         list_transform(string_split(raw, chr(10)),
           lambda x: CASE WHEN length(regexp_replace(x, '[ \t]', '', 'g')) = 0 THEN '' ELSE x END) AS ls FROM raw),
kk AS (SELECT *, coalesce(list_min(list_transform(list_filter(ls, lambda x: x <> ''),
                                   lambda x: length(x) - length(ltrim(x, ' ')))), 0) AS k FROM ls)
SELECT batch_id, item_index,
  array_to_string(list_transform(ls, lambda x: CASE WHEN x = '' THEN '' ELSE substring(x, k + 1) END), chr(10)) AS formatted_prompt
FROM kk"""
SQL["batch_summary"] = f"""WITH {V_REQUESTS}
SELECT batch_id, count(item_index) AS total_items_received, count(*) FILTER (WHERE ok) AS items_initiated_successfully,
  count(*) FILTER (WHERE NOT ok) AS n_errors, CASE WHEN bool_and(ok) THEN 200 ELSE 207 END AS status_code
FROM (SELECT batch_id, item_index, true AS ok FROM evals UNION ALL SELECT batch_id, item_index, false FROM errors)
GROUP BY batch_id"""

# --- status world views ---------------------------------------------------------------------------

V_STATUS = """
status_events AS (
  SELECT CAST(user_id AS VARCHAR) AS evaluation_id, event_type AS model,
    CASE WHEN event_id % 10 = 0 THEN 'LLMResponseFailed' ELSE 'LLMResponseReceived' END AS detail_type,
    CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'RECEIVED' END AS status,
    CASE WHEN event_id % 10 = 0 THEN 'error ' || props END AS error,
    ts AS event_time, event_id AS event_seq
  FROM events
),
evaluations AS (
  SELECT CAST(user_id AS VARCHAR) AS evaluation_id,
    (['click', 'error', 'purchase', 'signup', 'view'])[1:(user_id % 3) + 3] AS requested_models,
    (['INITIATED', 'PROCESSING', 'COMPLETED', 'FAILED'])[(user_id % 4) + 1] AS status
  FROM (SELECT DISTINCT user_id FROM events)
)"""

SQL["requested_only"] = f"""WITH {V_STATUS}
SELECT s.evaluation_id, s.model, s.event_seq FROM status_events s JOIN evaluations e USING (evaluation_id)
WHERE list_contains(e.requested_models, s.model)"""
SQL["parse_model_list"] = f"""
SELECT event_id, array_to_string(l, '|') AS models, len(l)::INTEGER AS n_models FROM (
  SELECT event_id, list_transform(string_split(event_type || ' ,' || chr(9) || upper(event_type) || ',, ' || props, ','),
     lambda s: regexp_replace(s, '^{PY_WHITESPACE_CLASS}+|{PY_WHITESPACE_CLASS}+$', '', 'g')) AS l
  FROM events)"""


# --- status, outcomes, judge ---------------------------------------------------------------------

V_STATUS2 = V_STATUS.replace(
    "FROM (SELECT DISTINCT user_id FROM events)",
    "FROM (SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id)",
).replace("AS status\n  FROM (SELECT user_id", "AS status, created_at\n  FROM (SELECT user_id") + """,
latest AS (
  SELECT evaluation_id, model,
    coalesce(status, CASE WHEN detail_type = 'LLMResponseFailed' THEN 'FAILED' ELSE 'RECEIVED' END) AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_id, model ORDER BY event_time DESC, event_seq DESC) AS rn
        FROM status_events) WHERE rn = 1
),
req AS (SELECT evaluation_id, unnest(list_distinct(requested_models)) AS model FROM evaluations),
cur AS (
  SELECT l.evaluation_id, l.model, l.status FROM latest l WHERE l.evaluation_id IN (SELECT evaluation_id FROM evaluations)
  UNION ALL
  SELECT r.evaluation_id, r.model, 'PENDING' FROM req r
  WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.evaluation_id = r.evaluation_id AND l.model = r.model)
),
wm AS (
  SELECT e.*, (SELECT count(*) FROM req r JOIN cur c USING (evaluation_id, model) WHERE r.evaluation_id = e.evaluation_id AND c.status = 'RECEIVED') AS n_received,
         (SELECT count(*) FROM req r JOIN cur c USING (evaluation_id, model) WHERE r.evaluation_id = e.evaluation_id AND c.status IN ('RECEIVED', 'FAILED')) AS n_done,
         len(list_distinct(e.requested_models)) AS n_requested
  FROM evaluations e
)"""

SQL["parse_events"] = f"""WITH {V_STATUS}
SELECT evaluation_id, model, detail_type, status, error, epoch_us(event_time) AS event_us, event_seq FROM status_events"""
SQL["latest_status"] = f"WITH {V_STATUS2} SELECT evaluation_id, model, status FROM latest"
SQL["status_map"] = f"""WITH {V_STATUS2}
SELECT e.evaluation_id, coalesce(string_agg(c.model || '=' || c.status, ';' ORDER BY c.model), '') AS entries,
       count(c.model)::INTEGER AS n_entries
FROM evaluations e LEFT JOIN cur c USING (evaluation_id) GROUP BY e.evaluation_id"""
SQL["open_evaluations"] = f"WITH {V_STATUS} SELECT evaluation_id, status FROM evaluations WHERE status IN ('INITIATED', 'PROCESSING')"
SQL["received_count"] = f"WITH {V_STATUS2} SELECT evaluation_id, n_requested::INTEGER AS n_requested, n_received::INTEGER AS n_received FROM wm"
SQL["ready_evaluations"] = f"""WITH {V_STATUS2}
SELECT evaluation_id, 'PROCESSING' AS new_status FROM wm
WHERE status IN ('INITIATED', 'PROCESSING') AND n_requested > 0 AND n_done = n_requested"""
SQL["evaluation_progress"] = f"""WITH {V_STATUS2}
SELECT w.evaluation_id,
  coalesce((SELECT string_agg(r.model, ',' ORDER BY r.model) FROM req r JOIN cur c USING (evaluation_id, model)
            WHERE r.evaluation_id = w.evaluation_id AND c.status <> 'RECEIVED'), '') AS missing,
  CAST(n_received AS VARCHAR) || '/' || CAST(n_requested AS VARCHAR) AS progress
FROM wm w WHERE status IN ('INITIATED', 'PROCESSING')"""
SQL["timed_out"] = f"""WITH {V_STATUS2}
SELECT evaluation_id, 'FAILED' AS new_status,
  (epoch(TIMESTAMP '2024-02-15 00:00:00') - floor(epoch(created_at)))::BIGINT AS age_seconds
FROM wm WHERE status IN ('INITIATED', 'PROCESSING') AND NOT (n_requested > 0 AND n_received = n_requested)
  AND (epoch(TIMESTAMP '2024-02-15 00:00:00') - floor(epoch(created_at))) > {20 * 24 * 3600}"""
SQL["lookup_evaluations"] = f"""WITH {V_STATUS}
SELECT i.evaluation_id, e.evaluation_id IS NOT NULL AS found, e.status
FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS evaluation_id FROM conversations) i
LEFT JOIN evaluations e USING (evaluation_id)"""
SQL["accepted_events"] = f"""WITH {V_STATUS}
SELECT evaluation_id, model, event_seq FROM status_events WHERE evaluation_id IN (SELECT evaluation_id FROM evaluations WHERE status IN ('INITIATED', 'PROCESSING'))"""
SQL["rejected_events"] = f"""WITH {V_STATUS}
SELECT evaluation_id, model, event_seq FROM status_events WHERE evaluation_id NOT IN (SELECT evaluation_id FROM evaluations WHERE status IN ('INITIATED', 'PROCESSING'))"""
SQL["evaluation_states"] = f"""WITH {V_STATUS2},
ready AS (SELECT evaluation_id FROM wm WHERE status IN ('INITIATED', 'PROCESSING') AND n_requested > 0 AND n_done = n_requested)
SELECT e.evaluation_id,
  CASE WHEN r.evaluation_id IS NOT NULL THEN 'COMPLETED' ELSE e.status END AS status,
  CASE WHEN r.evaluation_id IS NOT NULL THEN 'batch_id=0/' || e.evaluation_id END AS final_key
FROM evaluations e LEFT JOIN ready r USING (evaluation_id)"""
SQL["classify_outcomes"] = f"""WITH {V_STATUS2},
resp AS (
  SELECT l.evaluation_id, l.model, d.text AS response FROM
    (SELECT evaluation_id, model, max(event_seq) AS doc_id FROM status_events WHERE status = 'RECEIVED' GROUP BY ALL) l
  JOIN documents d USING (doc_id)
)
SELECT r.evaluation_id, r.model,
  CASE WHEN coalesce(c.status, '') <> 'RECEIVED' THEN 'SKIPPED_NOT_RECEIVED'
       WHEN x.evaluation_id IS NULL THEN 'ERROR_PROCESSING_S3_RESPONSE'
       WHEN x.response IS NULL OR x.response = '' THEN 'EMPTY_RESPONSE' ELSE 'COMPLETED' END AS outcome,
  (coalesce(c.status, '') = 'RECEIVED' AND x.evaluation_id IS NOT NULL AND coalesce(x.response, '') <> '') AS has_response
FROM req r LEFT JOIN cur c USING (evaluation_id, model) LEFT JOIN resp x USING (evaluation_id, model)"""
def _again() -> str:
    from evalspark.sources.views import AGAIN

    return " ".join(f"UNION ALL SELECT evaluation_id, model, event_seq, us + {m * 60_000_000}::BIGINT FROM ev WHERE event_seq % {k} = 0" for k, m in AGAIN)


SQL["drop_redelivered"] = f"""WITH RECURSIVE {V_STATUS},
ev AS (SELECT evaluation_id, model, event_seq, epoch_us(event_time) AS us FROM status_events),
d AS (SELECT evaluation_id, model, event_seq, us FROM ev {_again()}),
kept AS (
  SELECT evaluation_id, model, event_seq, min(us) AS us FROM d GROUP BY ALL
  UNION ALL
  SELECT d.evaluation_id, d.model, d.event_seq, min(d.us) FROM kept k
  JOIN d ON d.event_seq = k.event_seq AND d.evaluation_id = k.evaluation_id AND d.model = k.model AND d.us > k.us + 3600000000 GROUP BY ALL
)
SELECT evaluation_id, model, event_seq, us AS event_us FROM kept"""
SQL["route_events"] = f"""WITH {V_STATUS2}
SELECT s.evaluation_id, model, event_seq,
       CASE WHEN e.created_at BETWEEN s.event_time - INTERVAL 20 DAY AND s.event_time THEN 'accepted' ELSE 'quarantined' END AS route
FROM status_events s LEFT JOIN (SELECT * FROM evaluations WHERE evaluation_id::BIGINT % 3 <> 0) e USING (evaluation_id)"""
_READY = "ready AS (SELECT evaluation_id FROM wm WHERE status IN ('INITIATED', 'PROCESSING') AND n_requested > 0 AND n_done = n_requested)"
_OUTCOMES = """
resp AS (
  SELECT l.evaluation_id, l.model, d.text AS response FROM
    (SELECT evaluation_id, model, max(event_seq) AS doc_id FROM status_events WHERE status = 'RECEIVED' GROUP BY ALL) l
  JOIN documents d USING (doc_id)
),
outcome AS (
  SELECT r.evaluation_id, r.model, x.response,
    CASE WHEN coalesce(c.status, '') <> 'RECEIVED' THEN 'SKIPPED_NOT_RECEIVED'
         WHEN x.evaluation_id IS NULL THEN 'ERROR_PROCESSING_S3_RESPONSE'
         WHEN x.response IS NULL OR x.response = '' THEN 'EMPTY_RESPONSE' ELSE 'COMPLETED' END AS outcome
  FROM req r JOIN ready USING (evaluation_id) LEFT JOIN cur c USING (evaluation_id, model) LEFT JOIN resp x USING (evaluation_id, model)
)"""
SQL["completion_ledger"] = f"""WITH {V_STATUS2}, {_READY}, {_OUTCOMES},
lost AS (SELECT 'lost-' || conv_id AS evaluation_id FROM conversations WHERE turn = 0),
rows AS (
  SELECT evaluation_id, 'COMPLETED' AS status, 'batch_id=0/' || evaluation_id AS final_key, count(*)::INT AS n_models,
         count(*) FILTER (WHERE outcome = 'COMPLETED')::INT AS n_scored, NULL::VARCHAR AS error_message, evaluation_id AS opens
  FROM outcome GROUP BY evaluation_id
  UNION ALL
  SELECT evaluation_id, 'FAILED', NULL, 0, 0, 'Overall Calculation Failure: no evaluation record', NULL FROM lost
)
SELECT *, count(*) OVER () AS n_ready, count(*) FILTER (WHERE status = 'COMPLETED') OVER () AS n_completed,
       count(*) FILTER (WHERE status = 'FAILED') OVER () AS n_failed FROM rows"""
SQL["final_documents"] = f"""WITH {V_STATUS2}, {_READY}, {_OUTCOMES},
toks AS (
  SELECT o.*, d.text AS reference, regexp_extract_all(lower(o.response), '{ASCII}') AS c, regexp_extract_all(lower(d.text), '{ASCII}') AS r
  FROM outcome o LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = o.evaluation_id
),
pieces AS (
  SELECT evaluation_id, model, unnest(c) AS tok, 1 AS cc, 0 AS rc FROM toks WHERE outcome = 'COMPLETED'
  UNION ALL SELECT evaluation_id, model, unnest(r), 0, 1 FROM toks WHERE outcome = 'COMPLETED'
),
shared AS (
  SELECT evaluation_id, model, sum(least(c, r)) AS o FROM
    (SELECT evaluation_id, model, tok, sum(cc) AS c, sum(rc) AS r FROM pieces GROUP BY ALL) GROUP BY ALL
)
SELECT t.evaluation_id, t.model, 'question ' || t.evaluation_id AS prompt, length(reference)::INT AS reference_chars,
       e.requested_models[len(e.requested_models)] AS context, outcome AS status, CASE WHEN outcome = 'COMPLETED' THEN length(response) END::INT AS response_chars,
       CASE outcome WHEN 'ERROR_PROCESSING_S3_RESPONSE' THEN 'no response object at ' || t.evaluation_id || '/' || replace(lower(t.model), ' ', '_') || '_response.json'
         WHEN 'EMPTY_RESPONSE' THEN 'response object was empty or malformed' END AS error,
       CASE WHEN outcome = 'SKIPPED_NOT_RECEIVED' THEN 'response for ' || t.model || ' was not marked as RECEIVED' END AS message,
       CASE WHEN outcome = 'COMPLETED' AND reference IS NOT NULL THEN round_even({f1_sql('coalesce(s.o, 0)', 'len(c)', 'len(r)')}, 4) END AS rouge1,
       CASE WHEN outcome = 'COMPLETED' THEN 5 ELSE 0 END AS n_metrics
FROM toks t JOIN evaluations e USING (evaluation_id) LEFT JOIN shared s USING (evaluation_id, model)"""
SQL["response_store"] = """
SELECT 'doc-' || doc_id AS evaluation_id, CASE WHEN length(text) % 2 = 0 THEN 'model_one' ELSE 'two' END AS model_key,
       sha256(CASE WHEN length(text) % 5 = 0 THEN array_to_string(list_reverse(string_split(text, '')), '') ELSE text END) AS response_sha256,
       (length(text) % 5 = 0)::BIGINT AS batch_id
FROM documents WHERE length(text) % 3 <> 0"""
SQL["call_ledger"] = f"""WITH {V_REQUESTS},
work AS (
  SELECT evaluation_id, model, prompt, length(prompt) AS n,
         sha256(evaluation_id || chr(31) || model || chr(31) || sha256(prompt)) AS call_id
  FROM (SELECT evaluation_id, prompt, unnest({_MODELS_SQL}) AS model FROM evals)
),
made AS (SELECT *, n % 11 = 0 AS refused, n % 7 = 0 AS busy FROM work)
SELECT call_id, evaluation_id, model, CASE WHEN refused OR busy THEN 'FAILED' ELSE 'RECEIVED' END AS status,
       CASE WHEN NOT (refused OR busy) THEN model || ' ' || n END AS response,
       CASE WHEN refused THEN 'refused' WHEN busy THEN 'busy' END AS error,
       CASE WHEN refused THEN 1 WHEN busy THEN 3 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS attempts, 1::BIGINT AS n_calls,
       CASE WHEN refused OR busy THEN 'LLMResponseFailed' ELSE 'LLMResponseReceived' END AS detail_type,
       CASE WHEN NOT (refused OR busy) THEN evaluation_id || '/' || replace(lower(model), ' ', '_') || '_response.json' END AS response_key,
       ('0x' || substr(call_id, 1, 15))::BIGINT AS event_seq
FROM made"""
SQL["final_metrics_doc"] = f"""WITH {V_REPORT}
SELECT CAST(sno AS VARCHAR) AS evaluation_id, model, 'COMPLETED' AS status, metric, round_even(avg(score), 9) AS score
FROM scores GROUP BY ALL"""

V_VERDICTS = """
verdicts AS (
  SELECT d.lang AS evaluation_id, d.source AS model, 'faithfulness' AS criterion, l.doc_id AS unit_no, l.quality = 1 AS verdict
  FROM labels l JOIN documents d USING (doc_id)
  UNION ALL
  SELECT d.lang, d.source, 'toxicity', l.doc_id, l.toxic = 1 FROM labels l JOIN documents d USING (doc_id)
),
ratio AS (SELECT evaluation_id, model, criterion, avg(verdict::DOUBLE) AS score, count(verdict) AS n_verdicts FROM verdicts GROUP BY ALL)"""
SQL["verdict_ratio"] = f"WITH {V_VERDICTS} SELECT evaluation_id, model, criterion, round_even(score, 9) AS score, n_verdicts FROM ratio"
SQL["rubric_score"] = """
SELECT d.lang AS evaluation_id, d.source AS model, 'coherence' AS criterion,
       round_even(avg(l.quality * 2 + (1 - l.toxic)) / 3.0, 9) AS score
FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL"""
SQL["metric_pass"] = f"""WITH {V_VERDICTS},
th AS (SELECT * FROM (VALUES ('hallucination', 0.5, true), ('answer_relevancy', 0.5, false), ('faithfulness', 0.5, false),
   ('contextual_relevancy', 0.7, false), ('contextual_recall', 0.7, false), ('toxicity', 0.5, true), ('bias', 0.5, true))
   t(criterion, threshold, lower_is_better))
SELECT r.evaluation_id, r.model, r.criterion, round_even(r.score, 9) AS score,
  CASE WHEN th.threshold IS NULL OR r.score IS NULL THEN NULL
       WHEN th.lower_is_better THEN r.score <= th.threshold ELSE r.score >= th.threshold END AS passed
FROM ratio r LEFT JOIN th USING (criterion)"""
SQL["label_rate"] = """
SELECT d.source AS model, round_even(avg(l.toxic::DOUBLE), 9) AS rate, count(*) AS n_units
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source"""

SQL["distinct_models"] = """
SELECT event_type AS model, arg_min(user_id, event_id) AS first_sno, min(event_id) AS first_seen
FROM events WHERE NOT (event_type = 'signup' AND event_id % 11 = 3) GROUP BY 1"""
SQL["display_metrics"] = f"WITH {V_REPORT} SELECT DISTINCT metric FROM scores WHERE score IS NOT NULL AND metric <> 'generated_text'"


# --- judge criteria -------------------------------------------------------------------------------

V_JUDGE_CASES = """
turns AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
         lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
),
asked AS (
  SELECT conv_id || '-' || turn AS evaluation_id, text AS prompt, CASE WHEN next_role = 'assistant' THEN next_text END AS reference_answer,
         CASE WHEN prev_role = 'assistant' THEN prev_text END AS context
  FROM turns WHERE role = 'user'
),
halves AS (
  SELECT *, list_filter(string_split(coalesce(reference_answer, ''), ' '), lambda x: x <> '') AS rw,
         list_filter(string_split(coalesce(context, ''), ' '), lambda x: x <> '') AS cw FROM asked
),
cases AS (
  SELECT evaluation_id, 'm_drop7' AS model, prompt, reference_answer, context,
         array_to_string(list_filter(rw, lambda x, i: i % 7 <> 0), ' ') AS response FROM halves
  UNION ALL SELECT evaluation_id, 'm_echo', prompt, reference_answer, context, prompt FROM halves
  UNION ALL SELECT evaluation_id, 'm_mixed', prompt, reference_answer, context,
         array_to_string(cw[len(cw) // 2 + 1:] || rw[1:len(rw) // 2], ' ') FROM halves
)"""

_WORDS_OF = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def _request(criterion: str, units: str, against: str) -> str:
    return f"SELECT evaluation_id, model, '{criterion}' AS criterion, {units} AS units, {against} AS against FROM cases"


def _whole(c: str) -> str:
    return f"CASE WHEN regexp_matches(coalesce({c}, ''), '[^\\x00-\\x20]') THEN [{c}] ELSE [] END"


def _in_sentences(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN [] ELSE {treebank_sentences(c)} END"


SQL["judge_scores"] = f"""
WITH {V_JUDGE_CASES},
req AS (
  {_request("coherence", _whole("response"), "NULL::VARCHAR")}
  UNION ALL {_request("hallucination", _whole("context"), "response")}
  UNION ALL {_request("answer_relevancy", _in_sentences("response"), "prompt")}
  UNION ALL {_request("faithfulness", _in_sentences("response"), "context")}
  UNION ALL {_request("contextual_relevancy", _in_sentences("context"), "prompt")}
  UNION ALL {_request("contextual_recall", _in_sentences("reference_answer"), "context")}
),
noted AS (
  SELECT *, CASE WHEN len(units) = 0 THEN 'nothing to judge'
    WHEN criterion <> 'coherence' AND NOT regexp_matches(coalesce(against, ''), '[^\\x00-\\x20]') THEN 'nothing to judge against' END AS note FROM req
),
unit AS (
  SELECT evaluation_id, model, criterion, unnest(units) AS u, against FROM noted WHERE note IS NULL
),
w AS (
  SELECT evaluation_id, model, criterion, {_WORDS_OF.format("u")} AS uw, {_WORDS_OF.format("coalesce(against, '')")} AS aw FROM unit
),
o AS (
  SELECT evaluation_id, model, criterion, uw, list_distinct(CASE WHEN criterion = 'hallucination' THEN aw ELSE uw END) AS own,
         CASE WHEN criterion = 'hallucination' THEN uw ELSE aw END AS other FROM w
),
v AS (
  SELECT evaluation_id, model, criterion, CASE WHEN len(own) = 0 THEN NULL
    WHEN criterion = 'coherence' THEN 10.0 * len(list_distinct(uw)) / len(uw) / 10.0
    ELSE ((2 * len(list_intersect(own, other)) >= len(own)) <> (criterion = 'hallucination'))::INT::DOUBLE END AS x FROM o
),
agg AS (SELECT evaluation_id, model, criterion, avg(x) AS score, count(x) AS n FROM v GROUP BY ALL)
SELECT r.evaluation_id, r.model, r.criterion, round_even(score, 9) AS score, len(units)::INT AS n_units, coalesce(n, 0)::BIGINT AS n_verdicts,
       (CASE r.criterion WHEN 'hallucination' THEN score <= 0.5 WHEN 'answer_relevancy' THEN score >= 0.5 WHEN 'faithfulness' THEN score >= 0.5
         WHEN 'contextual_relevancy' THEN score >= 0.7 WHEN 'contextual_recall' THEN score >= 0.7 END)::INT AS passed,
       coalesce(note, CASE WHEN score IS NULL THEN 'no verdict' END) AS note
FROM noted r LEFT JOIN agg USING (evaluation_id, model, criterion)"""
