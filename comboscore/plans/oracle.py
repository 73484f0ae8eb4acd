"""Plain-SQL twins of the derived views, used to build the DuckDB oracle queries.

Each constant is a list of ``name AS (...)`` CTE bodies; ``with_ctes`` glues the ones a
query needs in front of its final SELECT.
"""

from __future__ import annotations

PAIR_SCORES = """ps AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
         CAST(l_partkey % 60 AS INTEGER) AS id_a,
         CAST((l_suppkey * 7 + l_orderkey) % 60 AS INTEGER) AS id_b,
         round(l_discount * 10 - 0.5, 4) AS bliss,
         round(l_tax * 10 - 0.4, 4) AS loewe,
         CAST(round((l_linenumber - 4) / CAST(10 AS DOUBLE), 4) AS DOUBLE) AS hsa,
         CASE WHEN l_returnflag = 'R' THEN round((l_quantity - 25) * CAST(0.8 AS DOUBLE), 4)
              ELSE round((l_quantity - 1) * CAST(0.4 AS DOUBLE), 4) END AS zip
  FROM lineitem
  WHERE l_partkey % 60 <> (l_suppkey * 7 + l_orderkey) % 60)"""

PAIR_SCORES_SPARSE = """ps AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal,
         CAST(l_partkey % 200 AS INTEGER) AS id_a,
         CAST(l_suppkey % 200 AS INTEGER) AS id_b,
         round(l_discount * 10 - 0.5, 4) AS bliss,
         round(l_tax * 10 - 0.4, 4) AS loewe,
         CAST(round((l_linenumber - 4) / CAST(10 AS DOUBLE), 4) AS DOUBLE) AS hsa,
         CASE WHEN l_returnflag = 'R' THEN round((l_quantity - 25) * CAST(0.8 AS DOUBLE), 4)
              ELSE round((l_quantity - 1) * CAST(0.4 AS DOUBLE), 4) END AS zip
  FROM lineitem
  WHERE l_partkey % 200 <> l_suppkey % 200)"""

PAIR_SCORES_GRAPH = """ps AS (
  SELECT CAST(l_partkey % 1000 AS INTEGER) AS id_a, CAST((l_suppkey * 7 + l_orderkey) % 1000 AS INTEGER) AS id_b
  FROM lineitem
  WHERE l_partkey % 1000 <> (l_suppkey * 7 + l_orderkey) % 1000)"""

# every item with the next line's item of its order
PAIR_SCORES_GROWING = """ps AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_partkey AS INTEGER) AS id_a,
           CAST(lead(l_partkey) OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS id_b,
           round(l_discount * 10 - 0.5, 4) AS bliss,
           round(l_tax * 10 - 0.4, 4) AS loewe,
           CAST(round((l_linenumber - 4) / CAST(10 AS DOUBLE), 4) AS DOUBLE) AS hsa,
           CASE WHEN l_returnflag = 'R' THEN round((l_quantity - 25) * CAST(0.8 AS DOUBLE), 4)
                ELSE round((l_quantity - 1) * CAST(0.4 AS DOUBLE), 4) END AS zip
    FROM lineitem)
  WHERE id_a <> id_b)"""

# names, canonical key and the loewe text built from integers
PAIR_NAMED = """psn AS (
  SELECT *, 'Drug-' || CAST(id_a AS VARCHAR) AS name_a, 'Drug-' || CAST(id_b AS VARCHAR) AS name_b,
         least(id_a, id_b) AS lo, greatest(id_a, id_b) AS hi,
         (CASE WHEN round(loewe * 10000) < 0 THEN '-' ELSE '' END)
           || CAST(CAST(abs(round(loewe * 10000)) AS BIGINT) // 10000 AS VARCHAR) || '.'
           || coalesce(nullif(rtrim(lpad(CAST(CAST(abs(round(loewe * 10000)) AS BIGINT) % 10000 AS VARCHAR), 4, '0'), '0'), ''), '0')
           AS loewe_text
  FROM ps)"""

FIRST_PAIR = """fp AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY ordinal) AS rn FROM psn) WHERE rn = 1)"""

LAST_PAIR = """lp AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY ordinal DESC) AS rn FROM psn) WHERE rn = 1)"""

COMBOS = """cf AS (
  SELECT l_orderkey AS combo_id, CAST(l_partkey % 60 AS INTEGER) AS id,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey % 60
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
         l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem),
cm AS (
  SELECT combo_id * 1000 + p // 5 AS combo_id, id, CAST(p % 5 + 1 AS BIGINT) AS pos FROM (
    SELECT combo_id, id, row_number() OVER (PARTITION BY combo_id
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS p
    FROM cf WHERE rn = 1)),
ck AS (SELECT combo_id, id, pos, count(*) OVER (PARTITION BY combo_id) AS n FROM cm),
combos AS (SELECT combo_id, id, pos FROM ck WHERE n >= 2),
combo_ids AS (
  SELECT combo_id, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY pos) AS drugs, count(*) AS k
  FROM combos GROUP BY combo_id)"""

COMBO_PAIRS = """cp AS (
  SELECT x.combo_id, CAST(x.pos - 1 AS INTEGER) AS i, CAST(y.pos - 1 AS INTEGER) AS j,
         x.id AS a, y.id AS b, least(x.id, y.id) AS lo, greatest(x.id, y.id) AS hi
  FROM combos x JOIN combos y ON x.combo_id = y.combo_id AND x.pos < y.pos)"""

# first-wins left lookup, the four labels, the sticky flag and the vote
SCORED = """lk AS (
  SELECT cp.*, fp.name_a, fp.name_b, fp.bliss, fp.loewe, fp.hsa, fp.zip,
         fp.lo IS NOT NULL AS found
  FROM cp LEFT JOIN fp ON fp.lo = cp.lo AND fp.hi = cp.hi),
lab AS (
  SELECT *,
    CASE WHEN bliss > 0.1 THEN 'Synergistic' WHEN bliss < -0.1 THEN 'Antagonistic' ELSE 'Additive' END AS bl,
    CASE WHEN loewe > 0.1 THEN 'Antagonistic' WHEN loewe < -0.1 THEN 'Synergistic' ELSE 'Additive' END AS lw,
    CASE WHEN hsa > 0.1 THEN 'Synergistic' WHEN hsa < -0.1 THEN 'Antagonistic' ELSE 'Additive' END AS hs,
    CASE WHEN zip > 15 THEN 'Highly Synergistic' WHEN zip < -15 THEN 'Highly Antagonistic'
         WHEN zip > 0 THEN 'Synergistic' WHEN zip < 0 THEN 'Antagonistic' ELSE 'Additive' END AS zl,
    bool_or(found AND coalesce(zip < -1, false)) OVER (PARTITION BY combo_id ORDER BY i, j
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sticky
  FROM lk),
cnt AS (
  SELECT *,
    (CASE WHEN bl = 'Antagonistic' THEN 1 ELSE 0 END) + (CASE WHEN lw = 'Antagonistic' THEN 1 ELSE 0 END)
      + (CASE WHEN hs = 'Antagonistic' THEN 1 ELSE 0 END) AS n_ant,
    (CASE WHEN bl = 'Synergistic' THEN 1 ELSE 0 END) + (CASE WHEN lw = 'Synergistic' THEN 1 ELSE 0 END)
      + (CASE WHEN hs = 'Synergistic' THEN 1 ELSE 0 END) AS n_syn,
    (CASE WHEN bl = 'Additive' THEN 1 ELSE 0 END) + (CASE WHEN lw = 'Additive' THEN 1 ELSE 0 END)
      + (CASE WHEN hs = 'Additive' THEN 1 ELSE 0 END) AS n_add
  FROM lab),
sc AS (
  SELECT *,
    CASE WHEN NOT found THEN NULL
         WHEN zip > 15 THEN 'Synergistic' WHEN zip < -15 THEN 'Antagonistic'
         WHEN n_ant > 1 OR sticky THEN 'Antagonistic' WHEN n_syn > 1 THEN 'Synergistic'
         WHEN n_add > 1 THEN 'Additive' ELSE lw END AS pair_label,
    CASE WHEN NOT found THEN NULL
         ELSE name_a || ' and ' || name_b || ' are ' ||
           (CASE WHEN zip > 15 THEN 'highly synergistic' WHEN zip < -15 THEN 'highly antagonistic'
                 WHEN n_ant > 1 OR sticky THEN 'antagonistic' WHEN n_syn > 1 THEN 'synergistic'
                 WHEN n_add > 1 THEN 'additive' ELSE lw END) || '. ' END AS sentence
  FROM cnt)"""

VERDICT = """vd AS (
  SELECT sc.combo_id,
    CASE WHEN count(*) FILTER (WHERE found) = 0 THEN NULL
         WHEN bool_or(found AND zip < -1) THEN 'Antagonistic'
         WHEN bool_or(found AND zip > 15) THEN 'Synergistic'
         ELSE 'Additive' END AS prediction,
    coalesce(string_agg(sentence, '' ORDER BY i, j) FILTER (WHERE found), '') AS reasoning,
    count(*) AS n_pairs,
    count(*) FILTER (WHERE NOT found) AS missing_pairs,
    count(*) FILTER (WHERE pair_label = 'Synergistic') AS synergistic,
    count(*) FILTER (WHERE pair_label = 'Additive') AS additive
  FROM sc GROUP BY sc.combo_id)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


CORE = (PAIR_SCORES, PAIR_NAMED, FIRST_PAIR, COMBOS, COMBO_PAIRS, SCORED, VERDICT)

PROMPTS = """pl AS (
  SELECT cp.*, lp.name_a, lp.name_b, lp.loewe, lp.loewe_text, lp.lo IS NOT NULL AS found
  FROM cp LEFT JOIN lp ON lp.lo = cp.lo AND lp.hi = cp.hi),
pr AS (
  SELECT combo_id,
    'Context: ' || coalesce(string_agg(name_a || ' and ' || name_b || ' have a Loewe score of: ' || loewe_text || '.',
                                       ' ' ORDER BY i, j) FILTER (WHERE found), '') AS context,
    coalesce(array_to_string(list_sort(list_distinct(flatten(list([name_a, name_b]) FILTER (WHERE found)))), ', '), '')
      AS names
  FROM pl GROUP BY combo_id),
prm AS (
  SELECT combo_id, context || '  ' || 'The drug combination to analyze is: ' || names || ' '
         || '. According to the rule, if Loewe > 0.1, the outcome is Antagonistic; if Loewe < -0.1, it is Synergistic; otherwise, it is Additive. Decide if the combination is synergistic, antagonistic, or additive.'
         AS prompt, context, names
  FROM pr)"""

FINAL = """fin AS (
  SELECT vd.combo_id, ci.drugs, vd.prediction, vd.reasoning, prm.prompt, prm.context
  FROM vd JOIN combo_ids ci ON ci.combo_id = vd.combo_id JOIN prm ON prm.combo_id = vd.combo_id)"""

RESPONSES = """resp AS (
  SELECT lk.combo_id,
    CASE WHEN NOT lk.found THEN 'no comment'
         WHEN lk.hsa = 0 THEN 'I cannot tell.'
         ELSE 'The outcome is ' || (CASE WHEN lk.loewe > 0.1 THEN 'Antagonistic'
                                         WHEN lk.loewe < -0.1 THEN 'Synergistic' ELSE 'Additive' END) END AS response
  FROM lk WHERE lk.i = 0 AND lk.j = 1)"""


def kw(expr: str) -> str:
    """Keyword label of a text expression, in SQL."""
    t = f"lower({expr})"
    return (f"CASE WHEN contains({t}, 'antagonistic') THEN 'antagonistic' "
            f"WHEN contains({t}, 'synergistic') THEN 'synergistic' "
            f"WHEN contains({t}, 'additive') THEN 'additive' ELSE 'no_pred' END")


EVAL = f"""ev AS (
  SELECT fin.combo_id, {kw('fin.prediction')} AS truth, {kw('resp.response')} AS pred
  FROM fin JOIN resp ON resp.combo_id = fin.combo_id)"""

TURNS = """turns AS (
  SELECT u.conv_id, u.turn, u.text AS ref_text, a.text AS cand_text
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

FULL = CORE + (LAST_PAIR, PROMPTS, FINAL)
COMBOS_GROWING = COMBOS.replace("l_partkey % 60", "l_partkey")
FULL_GROWING = (PAIR_SCORES_GROWING, PAIR_NAMED, FIRST_PAIR, COMBOS_GROWING, COMBO_PAIRS, SCORED, VERDICT,
                LAST_PAIR, PROMPTS, FINAL)
EVALS = FULL + (RESPONSES, EVAL)
