"""Clips and hypotheses derived from ``documents``, alike in Spark and in the SQL oracle.

A document's words are dealt into clips of ``CLIP`` consecutive words, so every word of every document is in one clip; a
document without words has one empty clip. Two systems (q = 1, 2) drop, replace or double words of a clip by integer
rules; by other rules hypotheses are missing, failed, empty, looping or written twice. Clips of one document share its
``text_id``, and a document's source is their block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lexicon import FUNCTION_WORDS

#: Words of a clip; and clips of a document at most, which keeps ids apart (2.4 million words).
CLIP, CLIPS = 24, 100_000
_WORDS = r"filter(split(lower(text), '[ \\t\\n\\r\\f]+'), t -> t <> '')"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, text_id, block, condition, duration_s, ref (tokens), terms."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "source as block", f"coalesce({_WORDS}, array()) as w")
    cut = rows.selectExpr("doc_id", "block", f"posexplode(transform(sequence(0, greatest(cast(ceil(size(w) / {CLIP}) as int), 1) - 1), k -> slice(w, k * {CLIP} + 1, {CLIP}))) as (k, ref)")
    made = cut.selectExpr(f"doc_id * {CLIPS} + k as clip_id", "doc_id as text_id", "block", "if((doc_id + k) % 2 = 0, 'clean', 'degraded') as condition", "length(array_join(ref, ' ')) / 15.0D as duration_s", "ref")
    terms = """case when clip_id % 4 = 0 then array() else filter(concat(array(get(ref, 2), concat(get(ref, 6), ' ', get(ref, 7))),
      if(clip_id % 5 = 0, array('zzz absent'), array())), t -> t is not null) end"""
    return made.selectExpr("*", f"{terms} as terms")


#: A clip's lines by system ``q``, as an array; none for clips that the system passed over. Functions of each word are few and told by
#: one look, as Spark interprets them; array_join passes over nulls.
_TOLD = "pmod(base + (p + 1) * step, 23)"
_KEPT = f"array_join(transform(ref, (t, p) -> if({_TOLD} > 2, t, case {_TOLD} when 0 then null when 1 then concat(reverse(t), 'x') else concat(t, ' ', t) end)), ' ')"
_LOOPED = f"if(clip_id % 41 = 6 and size(ref) > 0, concat_ws(' ', nullif({_KEPT}, ''), array_repeat(element_at(ref, -1), 5)), {_KEPT})"
_MAIN = f"named_struct('line_no', clip_id * 3 + 1, 'hyp', if(clip_id % 31 = 4 or clip_id % 37 = 5, '', {_LOOPED}), 'secs', if(clip_id % 31 = 4, null, duration_s / (q + 1)), 'error', if(clip_id % 31 = 4, 'failed', null))"
_OLD = "if(clip_id % 7 = 0, array(named_struct('line_no', clip_id * 3, 'hyp', 'old', 'secs', 1.0D, 'error', cast(null as string))), array())"
_LATE = "if(clip_id % 11 = 0, array(named_struct('line_no', clip_id * 3 + 2, 'hyp', '', 'secs', cast(null as double), 'error', 'late')), array())"
_LINES = f"if(clip_id % 29 <> 3, concat(array({_MAIN}), {_OLD}, {_LATE}), array())"


def lined(spark: SparkSession, sf_dir: str, *systems: int) -> DataFrame:
    """Clips of each system, with ``system`` and their ``lines`` (line_no, hyp, secs, error)."""
    each = clips(spark, sf_dir).selectExpr("*", f"explode(array({', '.join(map(str, systems))})) as q")
    dealt = each.selectExpr("*", "cast(pmod(clip_id * 31 + q, 23) as int) as base", "7 * q as step")
    return dealt.selectExpr("*", f"inline(array(struct({_LINES} as lines)))").drop("base", "step").withColumnRenamed("q", "system")


def hyps(spark: SparkSession, sf_dir: str, q: int) -> DataFrame:
    """Lines of system ``q``: clip_id, line_no, hyp (text), secs, error."""
    return lined(spark, sf_dir, q).selectExpr("clip_id", "inline(lines)")


#: The same in DuckDB: clips, lines(q, ...), best(q, clip_id, hyp, secs, error), pairs(q, ...).
SQL = rf"""
said AS (SELECT doc_id, source, coalesce(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f]+'), lambda t: t <> ''), []) AS w FROM documents),
cut AS (SELECT doc_id, source, k, w[k * {CLIP} + 1:k * {CLIP} + {CLIP}] AS ref FROM (SELECT *, unnest(range(0, greatest(1, (len(w) + {CLIP - 1}) // {CLIP}))) AS k FROM said)),
clips AS (SELECT *, CASE WHEN clip_id % 4 = 0 THEN [] ELSE list_filter(list_concat([ref[3], ref[7] || ' ' || ref[8]], CASE WHEN clip_id % 5 = 0 THEN ['zzz absent'] ELSE [] END), lambda t: t IS NOT NULL) END AS terms
  FROM (SELECT doc_id * {CLIPS} + k AS clip_id, doc_id AS text_id, source AS block, CASE WHEN (doc_id + k) % 2 = 0 THEN 'clean' ELSE 'degraded' END AS condition, length(array_to_string(ref, ' ')) / 15.0::DOUBLE AS duration_s, ref FROM cut)),
made AS (SELECT q, clip_id, duration_s, ref, flatten(list_transform(ref, lambda t, p: CASE (clip_id * 31 + p * 7 * q + q) % 23 WHEN 0 THEN [] WHEN 1 THEN [reverse(t) || 'x'] WHEN 2 THEN [t, t] ELSE [t] END)) AS kept
  FROM clips, (VALUES (1), (2)) AS s(q) WHERE clip_id % 29 <> 3),
lines AS (
  SELECT q, clip_id, clip_id * 3 + 1 AS line_no, CASE WHEN clip_id % 31 = 4 OR clip_id % 37 = 5 THEN '' ELSE array_to_string(CASE WHEN clip_id % 41 = 6 AND len(ref) > 0 THEN list_concat(kept, [ref[-1], ref[-1], ref[-1], ref[-1], ref[-1]]) ELSE kept END, ' ') END AS hyp,
    CASE WHEN clip_id % 31 = 4 THEN NULL ELSE duration_s / (q + 1) END AS secs, CASE WHEN clip_id % 31 = 4 THEN 'failed' END AS error FROM made
  UNION ALL SELECT q, clip_id, clip_id * 3, 'old', 1.0, NULL FROM made WHERE clip_id % 7 = 0
  UNION ALL SELECT q, clip_id, clip_id * 3 + 2, '', NULL, 'late' FROM made WHERE clip_id % 11 = 0),
best AS (SELECT q, clip_id, CASE WHEN error IS NULL THEN hyp ELSE '' END AS hyp, CASE WHEN error IS NULL THEN secs END AS secs, error FROM
  (SELECT *, row_number() OVER (PARTITION BY q, clip_id ORDER BY (error IS NULL) DESC, line_no DESC) AS rn FROM lines) WHERE rn = 1),
pairs AS (SELECT s.q, c.*, b.clip_id IS NULL AS missing, b.error, b.secs, list_filter(string_split(coalesce(b.hyp, ''), ' '), lambda t: t <> '') AS hyp
  FROM clips c CROSS JOIN (VALUES (1), (2)) AS s(q) LEFT JOIN best b ON b.q = s.q AND b.clip_id = c.clip_id)
"""
#: Edit counts by a fold over the reference: each cell carries (c, s, d, i).
EDITS_SQL = r"""
dp AS (
  SELECT q, clip_id, ref, hyp, 0 AS step, list_transform(range(0, len(hyp) + 1), lambda j: {'c': j, 's': 0, 'd': 0, 'i': j}) AS w FROM pairs
  UNION ALL
  SELECT q, clip_id, ref, hyp, step + 1,
    list_reduce(list_prepend([{'c': w[1].c + 1, 's': w[1].s, 'd': w[1].d + 1, 'i': w[1].i}], list_transform(range(1, len(hyp) + 1), lambda j: [{'c': j, 's': 0, 'd': 0, 'i': 0}])),
      lambda acc, x: list_append(acc, CASE
        WHEN ref[step + 1] = hyp[x[1].c] THEN w[x[1].c]
        WHEN acc[-1].c <= w[x[1].c + 1].c AND acc[-1].c <= w[x[1].c].c THEN {'c': acc[-1].c + 1, 's': acc[-1].s, 'd': acc[-1].d, 'i': acc[-1].i + 1}
        WHEN w[x[1].c + 1].c <= w[x[1].c].c THEN {'c': w[x[1].c + 1].c + 1, 's': w[x[1].c + 1].s, 'd': w[x[1].c + 1].d + 1, 'i': w[x[1].c + 1].i}
        ELSE {'c': w[x[1].c].c + 1, 's': w[x[1].c].s + 1, 'd': w[x[1].c].d, 'i': w[x[1].c].i} END))
  FROM dp WHERE step < len(ref)),
edits AS (SELECT q, clip_id, len(ref) AS n_ref, len(hyp) AS n_hyp, w[-1].s AS s, w[-1].d AS d, w[-1].i AS i FROM dp WHERE step = len(ref))
"""
_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(FUNCTION_WORDS)) + "]"
#: Terms found from left to right, the longest first, and edits that know which words belong to terms and are met (bits).
TERMS_SQL = rf"""
walk AS (
  SELECT clip_id, ref, terms, list_transform(terms, lambda t: string_split(t, ' ')) AS asked, 1 AS here, []::STRUCT(a BIGINT, z BIGINT)[] AS spans FROM clips WHERE len(terms) > 0
  UNION ALL
  SELECT clip_id, ref, terms, asked, here + greatest(n, 1), CASE WHEN n > 0 THEN list_append(spans, {{'a': here::BIGINT, 'z': (here + n - 1)::BIGINT}}) ELSE spans END
  FROM (SELECT *, CASE WHEN list_contains(asked, ref[here:here + 1]) AND here < len(ref) THEN 2 WHEN list_contains(asked, ref[here:here]) THEN 1 ELSE 0 END AS n FROM walk WHERE here <= len(ref))),
gold AS (SELECT clip_id, terms, spans, list_filter(flatten(list_transform(spans, lambda x: range(x.a, x.z + 1))), lambda p: NOT list_contains({_STOP}, ref[p])) AS words,
  list_filter(flatten(asked), lambda w: NOT list_contains({_STOP}, w)) AS vocabulary FROM walk WHERE here > len(ref)),
tdp AS (
  SELECT p.q, p.clip_id, p.ref, p.hyp, coalesce(g.words, []) AS tw, 0 AS step, list_transform(p.hyp, lambda w: CASE WHEN list_contains(coalesce(g.vocabulary, []), w) THEN 1 ELSE 0 END) AS tv,
    list_transform(range(0, len(p.hyp) + 1), lambda j: {{'c': j, 's': 0::BIGINT, 'd': 0::BIGINT, 'i': j, 't': coalesce(list_sum(list_transform(p.hyp[1:j], lambda w: CASE WHEN list_contains(coalesce(g.vocabulary, []), w) THEN 1 ELSE 0 END)), 0)::BIGINT, 'm': 0::BIGINT}}) AS w
  FROM pairs p LEFT JOIN gold g USING (clip_id)
  UNION ALL
  SELECT q, clip_id, ref, hyp, tw, step + 1, tv,
    list_reduce(list_prepend([{{'c': w[1].c + 1, 's': w[1].s, 'd': w[1].d + 1, 'i': w[1].i, 't': w[1].t + hit, 'm': w[1].m}}], list_transform(range(1, len(hyp) + 1), lambda j: [{{'c': j, 's': 0::BIGINT, 'd': 0::BIGINT, 'i': 0::BIGINT, 't': 0::BIGINT, 'm': 0::BIGINT}}])),
      lambda acc, x: list_append(acc, CASE
        WHEN ref[step + 1] = hyp[x[1].c] THEN {{'c': w[x[1].c].c, 's': w[x[1].c].s, 'd': w[x[1].c].d, 'i': w[x[1].c].i, 't': w[x[1].c].t, 'm': w[x[1].c].m | (1::BIGINT << step)}}
        WHEN acc[-1].c <= w[x[1].c + 1].c AND acc[-1].c <= w[x[1].c].c THEN {{'c': acc[-1].c + 1, 's': acc[-1].s, 'd': acc[-1].d, 'i': acc[-1].i + 1, 't': acc[-1].t + tv[x[1].c], 'm': acc[-1].m}}
        WHEN w[x[1].c + 1].c <= w[x[1].c].c THEN {{'c': w[x[1].c + 1].c + 1, 's': w[x[1].c + 1].s, 'd': w[x[1].c + 1].d + 1, 'i': w[x[1].c + 1].i, 't': w[x[1].c + 1].t + hit, 'm': w[x[1].c + 1].m}}
        ELSE {{'c': w[x[1].c].c + 1, 's': w[x[1].c].s + 1, 'd': w[x[1].c].d, 'i': w[x[1].c].i, 't': w[x[1].c].t + hit, 'm': w[x[1].c].m}} END))
  FROM (SELECT *, CASE WHEN list_contains(tw, step + 1) THEN 1 ELSE 0 END AS hit FROM tdp WHERE step < len(ref))),
full_facts AS (SELECT x.q, x.clip_id, len(x.ref) AS n_ref, len(x.hyp) AS n_hyp, x.w[-1].s AS s, x.w[-1].d AS d, x.w[-1].i AS i, coalesce(len(g.spans), 0) AS term_n,
  coalesce(len(list_filter(g.spans, lambda p: (x.w[-1].m >> (p.a - 1)::INT) & ((1::BIGINT << (p.z - p.a + 1)::INT) - 1) = (1::BIGINT << (p.z - p.a + 1)::INT) - 1)), 0) AS term_hits,
  coalesce(len(list_filter(g.terms, lambda t: NOT contains(' ' || array_to_string(x.ref, ' ') || ' ', ' ' || t || ' '))), 0) AS terms_not_in_ref,
  coalesce(len(g.words), 0) AS term_words, CASE WHEN g.clip_id IS NULL THEN 0 ELSE x.w[-1].t END AS term_word_errors,
  CASE WHEN g.clip_id IS NULL THEN 0 ELSE len(x.ref) - len(g.words) END AS other_words, CASE WHEN g.clip_id IS NULL THEN 0 ELSE x.w[-1].s + x.w[-1].d + x.w[-1].i - x.w[-1].t END AS other_word_errors
  FROM tdp x LEFT JOIN gold g USING (clip_id) WHERE x.step = len(x.ref))
"""
#: Loops: grams of 1 to 8 words back to back (four times one word, else three times), found from left to right; flags of each pair.
LOOPS_SQL = r"""
sides AS (SELECT q, clip_id, hyp AS w FROM pairs UNION ALL SELECT 0, clip_id, ref FROM clips),
scan AS (
  SELECT *, 1 AS here, NULL::VARCHAR AS gram FROM (
    SELECT q, clip_id, w, size::INT AS size, CASE WHEN size = 1 THEN 4 ELSE 3 END AS need, array_to_string(list_transform(range(1, len(w) - size + 1), lambda k: CASE WHEN w[k] = w[k + size] THEN '1' ELSE '0' END), '') AS bits
    FROM sides, range(1, 9) t(size) WHERE len(w) > size)
  WHERE contains(bits, repeat('1', size * (need - 1)))
  UNION ALL
  SELECT q, clip_id, w, size, need, bits, here + CASE WHEN times >= need THEN times * size ELSE 1 END, CASE WHEN times >= need THEN array_to_string(w[here:here + size - 1], ' ') END
  FROM (SELECT *, (1 + (length(substring(bits, here)) - length(ltrim(substring(bits, here), '1'))) // size)::INT AS times FROM scan WHERE here - 1 + size * need <= len(w))),
grams AS (SELECT DISTINCT q, clip_id, gram FROM scan WHERE gram IS NOT NULL),
fresh AS (SELECT h.q, h.clip_id, list_sort(list(h.gram)) AS fresh FROM grams h WHERE h.q > 0 AND NOT EXISTS (SELECT 1 FROM grams r WHERE r.q = 0 AND r.clip_id = h.clip_id AND r.gram = h.gram) GROUP BY h.q, h.clip_id),
rates AS (SELECT q, clip_id, len(w) AS n, CASE WHEN len(w) < 5 THEN 0.0 ELSE 1.0 - 1.0::DOUBLE * len(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))) / (len(w) - 4) END AS rate FROM sides),
judged AS (SELECT h.q, h.clip_id, h.rate, f.fresh, h.n = 0 AND r.n > 0 AS empty, h.n > 2 * r.n + 10 AS runaway, f.fresh IS NOT NULL OR h.n > 2 * r.n + 10 OR (h.rate > 0.05 AND h.rate > r.rate + 0.05) AS loop
  FROM rates h JOIN rates r ON r.q = 0 AND r.clip_id = h.clip_id LEFT JOIN fresh f ON f.q = h.q AND f.clip_id = h.clip_id WHERE h.q > 0),
flagged AS (SELECT *, concat_ws(',', CASE WHEN empty THEN 'empty' END, CASE WHEN loop THEN 'loop' END) AS flags FROM judged)
"""
