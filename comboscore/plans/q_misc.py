"""Queries: graph and cliques, vectors, word-id blocks, file sources and sinks, union."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from comboscore.functions.pairs import join_ids
from comboscore.operators import blocks as B
from comboscore.operators import cliques as G
from comboscore.operators import vectors as V
from comboscore.operators.ordinal import batches, with_ordinal
from comboscore.operators.pairs import dedup_pairs
from comboscore.plans import fixtures as fx
from comboscore.plans import lineage as L
from comboscore.plans import oracle as O
from comboscore.plans.q_text import nine_fields
from comboscore.plans.registry import register
from comboscore.session import cut_lineage
from comboscore.sources import files as S

SEED = L.SEED

# --------------------------------------------------------------------- graph

EDGES = """edges AS (
  SELECT DISTINCT src, dst FROM (SELECT id_a AS src, id_b AS dst FROM ps UNION ALL SELECT id_b, id_a FROM ps)),
adj AS (SELECT src AS id, list_sort(list(dst)) AS nb FROM edges GROUP BY src)"""


def sparse_adj(spark, sf):
    return G.adjacency(fx.pair_scores(spark, sf, sparse=True))


@register("adjacency", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, EDGES, select="""
SELECT id, array_to_string(nb, ', ') AS neighbours FROM adj"""))
def q_adjacency(spark, sf):
    return sparse_adj(spark, sf).select("id", join_ids("neighbours").alias("neighbours"))


# ids of one block in the queries below; the library's default is larger
SMALL_BLOCK = 128
BLOCK_LISTS = f"""bl AS (SELECT src AS id, dst // {SMALL_BLOCK} AS block, list_sort(list(dst)) AS nb
  FROM edges GROUP BY src, dst // {SMALL_BLOCK})"""


def graph_blocks(spark, sf):
    return G.adjacency_blocks(fx.pair_scores(spark, sf, graph=True), size=SMALL_BLOCK)


@register("adjacency_blocks", sql=O.with_ctes(O.PAIR_SCORES_GRAPH, EDGES, BLOCK_LISTS, select="""
SELECT id, CAST(block AS BIGINT) AS block, array_to_string(nb, ', ') AS neighbours FROM bl"""))
def q_adjacency_blocks(spark, sf):
    return graph_blocks(spark, sf).select("id", "block", join_ids("neighbours").alias("neighbours"))


@register("distinct_pairs", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, EDGES, select="SELECT src, dst FROM edges"))
def q_distinct_pairs(spark, sf):
    return G.edges(fx.pair_scores(spark, sf, sparse=True))


@register("is_valid_combination", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, EDGES, O.COMBOS, select="""
, grp AS (SELECT c.combo_id, c.id AS m FROM combos c JOIN combo_ids ci ON ci.combo_id = c.combo_id
          WHERE c.pos < ci.k),
newid AS (SELECT c.combo_id, c.id AS new_id FROM combos c JOIN combo_ids ci ON ci.combo_id = c.combo_id
          WHERE c.pos = ci.k)
SELECT g.combo_id AS key, bool_and(f.src IS NOT NULL AND b.src IS NOT NULL) AS valid
FROM grp g JOIN newid n ON n.combo_id = g.combo_id
LEFT JOIN edges f ON f.src = g.m AND f.dst = n.new_id
LEFT JOIN edges b ON b.src = n.new_id AND b.dst = g.m
GROUP BY g.combo_id"""))
def q_is_valid_combination(spark, sf):
    c = fx.combos(spark, sf)
    groups = c.select(F.col("combo_id").alias("key"),
                      F.slice("ids", 1, F.size("ids") - 1).alias("members"),
                      F.element_at("ids", -1).alias("new_id"))
    return G.valid_extensions(groups, G.edges(fx.pair_scores(spark, sf, sparse=True)))


@register("candidate_except", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, EDGES, O.COMBOS, select="""
, hits AS (SELECT c.combo_id, e.dst AS cand, count(*) AS h FROM combos c JOIN edges e ON e.src = c.id
           GROUP BY c.combo_id, e.dst),
ok AS (SELECT h.combo_id, h.cand FROM hits h JOIN combo_ids ci ON ci.combo_id = h.combo_id
       WHERE h.h = ci.k AND h.cand NOT IN (SELECT id FROM combos x WHERE x.combo_id = h.combo_id))
SELECT ci.combo_id, CAST(count(ok.cand) AS INTEGER) AS n_candidates,
       coalesce(string_agg(CAST(ok.cand AS VARCHAR), ', ' ORDER BY ok.cand), '') AS candidates
FROM combo_ids ci LEFT JOIN ok ON ok.combo_id = ci.combo_id GROUP BY ci.combo_id"""))
def q_candidate_except(spark, sf):
    c = G.common_neighbours(fx.combos(spark, sf), sparse_adj(spark, sf))
    return c.select("combo_id", F.size("candidates").cast("int").alias("n_candidates"),
                    join_ids("candidates").alias("candidates"))


@register("candidate_blocks", sql=O.with_ctes(O.PAIR_SCORES_GRAPH, EDGES, O.COMBOS, select=f"""
, hits AS (SELECT c.combo_id, e.dst AS cand, count(*) AS h FROM combos c JOIN edges e ON e.src = c.id
           GROUP BY c.combo_id, e.dst)
SELECT h.combo_id, CAST(h.cand // {SMALL_BLOCK} AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n_candidates,
       string_agg(CAST(h.cand AS VARCHAR), ', ' ORDER BY h.cand) AS candidates
FROM hits h JOIN combo_ids ci ON ci.combo_id = h.combo_id
WHERE h.h = ci.k AND h.cand NOT IN (SELECT id FROM combos x WHERE x.combo_id = h.combo_id)
GROUP BY h.combo_id, h.cand // {SMALL_BLOCK}"""))
def q_candidate_blocks(spark, sf):
    c = G.common_neighbour_blocks(fx.combos(spark, sf), graph_blocks(spark, sf), size=SMALL_BLOCK)
    return c.select("combo_id", "block", F.size("candidates").cast("int").alias("n_candidates"),
                    join_ids("candidates").alias("candidates"))


def _clique_sql() -> str:
    s = f"'{SEED}:'"
    ctes = [O.PAIR_SCORES_GRAPH, EDGES, f"""items AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM adj),
dr AS (
  SELECT o_orderkey AS draw,
    CAST(2 + ('0x' || substr(md5({s} || CAST(o_orderkey AS VARCHAR) || ':size'), 1, 8))::BIGINT % 4 AS INTEGER)
      AS target,
    ('0x' || substr(md5({s} || CAST(o_orderkey AS VARCHAR) || ':first'), 1, 8))::BIGINT % (SELECT count(*) FROM items)
      AS idx
  FROM orders),
s1 AS (
  SELECT dr.draw, dr.target, [it.id] AS combo, list_filter(adj.nb, lambda x: x <> it.id) AS cand
  FROM dr JOIN items it ON it.idx = dr.idx JOIN adj ON adj.id = it.id)"""]
    for k in range(2, 6):
        ctes.append(f"""p{k} AS (
  SELECT *, CASE WHEN len(combo) < target AND len(cand) > 0 THEN
    list_sort(cand)[CAST(('0x' || substr(md5({s} || CAST(draw AS VARCHAR) || ':{k}'), 1, 8))::BIGINT % len(cand) + 1
                    AS INTEGER)] END AS pick
  FROM s{k - 1}),
s{k} AS (
  SELECT p.draw, p.target,
    CASE WHEN p.pick IS NOT NULL THEN list_append(p.combo, p.pick) ELSE p.combo END AS combo,
    CASE WHEN p.pick IS NOT NULL THEN
      list_filter(list_intersect(p.cand, adj.nb), lambda x: NOT list_contains(list_append(p.combo, p.pick), x))
    ELSE p.cand END AS cand
  FROM p{k} p LEFT JOIN adj ON adj.id = p.pick)""")
    return O.with_ctes(*ctes, select="")


CLIQUES_SQL = _clique_sql()


def _cliques(spark, sf):
    draws = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"))
    return G.sample_cliques(G.adjacency(fx.pair_scores(spark, sf, graph=True)), draws, SEED)


@register("sample_cliques", sql=CLIQUES_SQL + """
SELECT draw, target, array_to_string(combo, ', ') AS combo FROM s5 WHERE len(combo) = target""")
def q_sample_cliques(spark, sf):
    return _cliques(spark, sf).select("draw", "target", join_ids("combo").alias("combo"))


@register("complete_only", sql=CLIQUES_SQL + """
SELECT target, count(*) FILTER (WHERE len(combo) = target) AS complete, count(*) AS draws FROM s5 GROUP BY target""")
def q_complete_only(spark, sf):
    draws = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"))
    # aggregate over the stored draws: fused into the sampler's codegen stage the partial
    # aggregate makes one oversized generated method
    done = cut_lineage(_cliques(spark, sf)).groupBy("target").agg(F.count(F.lit(1)).alias("complete"))
    lo, hi = 2, 5
    h = F.md5(F.concat(F.lit(f"{SEED}:"), F.col("draw").cast("string"), F.lit(":size")))
    tgt = (F.lit(lo) + F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % (hi - lo + 1)).cast("int")
    allc = draws.groupBy(tgt.alias("target")).agg(F.count(F.lit(1)).alias("draws"))
    return (allc.join(done, "target", "left")
            .select("target", F.coalesce("complete", F.lit(0)).alias("complete"), "draws"))


@register("complete_draws", sql=CLIQUES_SQL + """
SELECT draw, target, combo[1] AS first_id, combo[len(combo)] AS last_id FROM s5 WHERE len(combo) = target""",
          note="the kept draws themselves, from an adjacency in blocks")
def q_complete_draws(spark, sf):
    draws = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"))
    kept = G.sample_cliques(graph_blocks(spark, sf), draws, SEED, size=SMALL_BLOCK)
    return kept.select("draw", "target", F.element_at("combo", 1).alias("first_id"), F.element_at("combo", -1).alias("last_id"))


@register("number_combos", sql=CLIQUES_SQL + """
SELECT row_number() OVER (ORDER BY draw) AS combination_number, array_to_string(combo, ', ') AS drug_combination
FROM s5 WHERE len(combo) = target""")
def q_number_combos(spark, sf):
    c = with_ordinal(_cliques(spark, sf), "draw")
    return c.select((F.col("ordinal") + 1).alias("combination_number"), join_ids("combo").alias("drug_combination"))


@register("union_all", sql=O.with_ctes("""dense AS (SELECT CAST(l_partkey % 60 AS INTEGER) AS id_a,
  CAST((l_suppkey * 7 + l_orderkey) % 60 AS INTEGER) AS id_b FROM lineitem
  WHERE l_partkey % 60 <> (l_suppkey * 7 + l_orderkey) % 60),
sparse AS (SELECT CAST(l_partkey % 200 AS INTEGER) AS id_a, CAST(l_suppkey % 200 AS INTEGER) AS id_b,
  round(l_tax * 10 - 0.4, 4) AS loewe FROM lineitem WHERE l_partkey % 200 <> l_suppkey % 200)""", select="""
SELECT 'dense' AS src, id_a, id_b, CAST(NULL AS DOUBLE) AS loewe FROM dense
UNION ALL SELECT 'sparse', id_a, id_b, loewe FROM sparse"""))
def q_union_all(spark, sf):
    d = fx.pair_scores(spark, sf).select(F.lit("dense").alias("src"), "id_a", "id_b")
    s = fx.pair_scores(spark, sf, sparse=True).select(F.lit("sparse").alias("src"), "id_a", "id_b", "loewe")
    return d.unionByName(s, allowMissingColumns=True)


# --------------------------------------------------------------------- vectors

VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
SIL = VEC + """,
dd AS (SELECT a.vec_id, a.label, b.label AS c, sum(list_distance(a.x, b.x) * list_distance(a.x, b.x)) AS s, count(*) AS n
       FROM v a, v b GROUP BY a.vec_id, a.label, b.label),
own AS (SELECT vec_id, label, s / (n - 1) AS a, n FROM dd WHERE c = label),
oth AS (SELECT vec_id, min(s / n) AS b FROM dd WHERE c <> label GROUP BY vec_id),
sil AS (SELECT own.vec_id, own.label,
          CASE WHEN own.n <= 1 THEN 0.0 WHEN greatest(own.a, oth.b) > 0
               THEN (oth.b - own.a) / greatest(own.a, oth.b) ELSE 0.0 END AS score
        FROM own JOIN oth ON oth.vec_id = own.vec_id)"""


# squared Euclidean distance: the one with a linear closed form
METRIC = "sqeuclidean"


def _vectors(spark, sf):
    return fx.table(spark, sf, "embeddings")


@register("silhouette_samples", sql=O.with_ctes(SIL, select="SELECT vec_id, label, score FROM sil"))
def q_silhouette_samples(spark, sf):
    return V.silhouette_samples(_vectors(spark, sf), "vec_id", "embedding", "label", metric=METRIC)


@register("silhouette_by_label", sql=O.with_ctes(SIL, select="SELECT label, avg(score) AS label_avg FROM sil GROUP BY label"))
def q_silhouette_by_label(spark, sf):
    s = V.silhouette_samples(_vectors(spark, sf), "vec_id", "embedding", "label", metric=METRIC)
    return s.groupBy("label").agg(F.avg("score").alias("label_avg"))


@register("silhouette_points", sql=O.with_ctes(SIL, select="""
SELECT vec_id, label, score, avg(score) OVER (PARTITION BY label) AS label_avg FROM sil"""))
def q_silhouette_points(spark, sf):
    s = V.silhouette(_vectors(spark, sf), "vec_id", "embedding", "label", metric=METRIC)
    return s.select("vec_id", "label", "score", "label_avg")


@register("silhouette_sqeuclidean", sql=O.with_ctes(VEC, select="""
, dd AS (SELECT a.vec_id, a.label, b.label AS c,
                sum(list_distance(a.x, b.x) * list_distance(a.x, b.x)) AS s, count(*) AS n
         FROM v a, v b GROUP BY a.vec_id, a.label, b.label),
own AS (SELECT vec_id, label, s / (n - 1) AS a, n FROM dd WHERE c = label),
oth AS (SELECT vec_id, min(s / n) AS b FROM dd WHERE c <> label GROUP BY vec_id)
SELECT own.vec_id, own.label, CASE WHEN own.n <= 1 THEN 0.0 WHEN greatest(own.a, oth.b) > 0
         THEN (oth.b - own.a) / greatest(own.a, oth.b) ELSE 0.0 END AS score
FROM own JOIN oth ON oth.vec_id = own.vec_id"""), note="linear closed form; same metric as squared-euclidean")
def q_silhouette_sqeuclidean(spark, sf):
    return V.silhouette_samples(_vectors(spark, sf), "vec_id", "embedding", "label", metric="sqeuclidean")


@register("mean_pool", sql=O.with_ctes(VEC, select="""
SELECT label, CAST(k AS INTEGER) AS k, avg(val) AS mean FROM (
  SELECT label, unnest(range(len(x))) AS k, unnest(x) AS val FROM v) GROUP BY label, k"""))
def q_mean_pool(spark, sf):
    m = V.mean_pool(_vectors(spark, sf), "label", "embedding")
    return m.select("label", F.posexplode("embedding").alias("k", "mean"))


@register("label_mask", sql="SELECT vec_id FROM embeddings WHERE label = 3")
def q_label_mask(spark, sf):
    return _vectors(spark, sf).where(F.col("label") == 3).select("vec_id")


def _axis_ctes(source: str, axis: str, squarings: int = 24) -> str:
    """``axis`` (i, w, share): the first principal axis of the matrix ``source`` (i, j, val), its largest
    component positive, and the variance along it. Squaring the matrix over and over (scaled to
    trace 1) leaves the projector onto that axis."""
    steps, last = [], source
    for k in range(squarings):
        steps.append(f"""{axis}_{k} AS MATERIALIZED (
  SELECT a.i, b.j, sum(a.val * b.val) / (SELECT sum(val * val) FROM {last}) AS val
  FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY a.i, b.j)""")
        last = f"{axis}_{k}"
    return ",\n".join(steps) + f""",
{axis}_top AS (SELECT i AS j, val FROM {last} WHERE i = j ORDER BY val DESC, i LIMIT 1),
{axis}_w AS MATERIALIZED (SELECT m.i, m.val / sqrt(t.val) AS w FROM {last} m JOIN {axis}_top t ON t.j = m.j),
{axis} AS MATERIALIZED (SELECT i, w, (SELECT sum(p.w * s.val * q.w) FROM {source} s JOIN {axis}_w p ON p.i = s.i
                                      JOIN {axis}_w q ON q.i = s.j) AS share FROM {axis}_w)"""


PCA = f"""
, e AS MATERIALIZED (SELECT vec_id, label, unnest(range(len(x))) AS i, unnest(x) AS val FROM v),
mu AS (SELECT i, avg(val) AS m, count(*) AS n FROM e GROUP BY i),
cov AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum((a.val - p.m) * (b.val - q.m)) / (any_value(p.n) - 1) AS val
  FROM e a JOIN e b ON b.vec_id = a.vec_id JOIN mu p ON p.i = a.i JOIN mu q ON q.i = b.i GROUP BY a.i, b.i),
{_axis_ctes("cov", "ax1")},
rest AS MATERIALIZED (SELECT c.i, c.j, c.val - p.share * p.w * q.w AS val
                      FROM cov c JOIN ax1 p ON p.i = c.i JOIN ax1 q ON q.i = c.j),
{_axis_ctes("rest", "ax2")}"""


@register("pca_2d", sql=O.with_ctes(VEC, select=PCA + """
SELECT e.vec_id, e.label, sum(e.val * ax1.w) AS x, sum(e.val * ax2.w) AS y
FROM e JOIN ax1 ON ax1.i = e.i JOIN ax2 ON ax2.i = e.i GROUP BY e.vec_id, e.label"""))
def q_pca_2d(spark, sf):
    p = V.project_2d(_vectors(spark, sf), "embedding")
    return p.select("vec_id", "label", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


# --------------------------------------------------------------------- word-id blocks (F29, F30, W3 via q_eval)

_TOK = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
BLOCK_CTES = f"""tok AS (SELECT doc_id, {_TOK} AS t FROM documents),
voc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(t) AS token FROM tok) GROUP BY token),
vid AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) AS token_id FROM voc),
f128 AS (SELECT doc_id, unnest(t[1:128]) AS token, unnest(range(len(t[1:128]))) AS pos FROM tok),
ids AS (SELECT f.doc_id, list(v.token_id ORDER BY f.pos) AS ids FROM f128 f JOIN vid v ON v.token = f.token
        GROUP BY f.doc_id),
blk AS (SELECT tok.doc_id, coalesce(ids.ids, []) AS real, len(tok.t) AS n_tokens
        FROM tok LEFT JOIN ids ON ids.doc_id = tok.doc_id)"""


def _blocks(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return B.blocks(docs, "doc_id", "text", B.vocabulary(docs, "text"), size=128)


@register("fixed_blocks", sql=O.with_ctes(BLOCK_CTES, select="""
SELECT doc_id, array_to_string(real || list_transform(range(128 - len(real)), lambda x: 0), ' ') AS ids,
       CAST(len(real) AS INTEGER) AS mask_sum, CAST(n_tokens AS INTEGER) AS n_tokens, n_tokens > 128 AS truncated
FROM blk"""))
def q_fixed_blocks(spark, sf):
    b = _blocks(spark, sf)
    return b.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"), "n_tokens", "truncated")


@register("lm_labels", sql=O.with_ctes(BLOCK_CTES, select="""
SELECT doc_id, array_to_string(real || list_transform(range(128 - len(real)), lambda x: -100), ' ') AS labels
FROM blk"""))
def q_lm_labels(spark, sf):
    b = _blocks(spark, sf)
    lab = B.lm_labels("ids", "mask")
    return b.select("doc_id", F.array_join(F.transform(lab, lambda x: x.cast("string")), " ").alias("labels"))


@register("vocabulary", sql=O.with_ctes(BLOCK_CTES, select="SELECT token, cnt AS count, token_id FROM vid JOIN voc USING (token)"))
def q_vocabulary(spark, sf):
    return B.vocabulary(fx.table(spark, sf, "documents"), "text")


# --------------------------------------------------------------------- sources and sinks

PAIR_CSV_SCHEMA = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, "
                   "id_a int, id_b int, bliss double, loewe double, hsa double, zip double")
PAIR_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
             "id_a", "id_b", "bliss", "loewe", "hsa", "zip"]


@register("read_shards", sql=O.with_ctes(O.PAIR_SCORES, select="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, id_a, id_b, bliss, loewe,
       CASE WHEN l_linenumber <= 3 THEN hsa END AS hsa, zip FROM ps"""))
def q_read_shards(spark, sf):
    ps = fx.pair_scores(spark, sf).select(*PAIR_COLS)
    base = S.landing_dir(spark, "shards")
    a, b = f"{base}/a", f"{base}/b"
    S.write_table(ps.where(F.col("l_linenumber") <= 3), a)
    S.write_table(ps.where(F.col("l_linenumber") > 3).drop("hsa"), b)
    schema_b = PAIR_CSV_SCHEMA.replace("hsa double, ", "")
    return S.read_shards(spark, [a, b], [PAIR_CSV_SCHEMA, schema_b]).select(*PAIR_COLS)


def _ordered_shards(spark, sf):
    """Pair scores landed as two shard groups of several files each, read back with their file order:
    lines 1 to 3 of all orders first, then the others."""
    ps = fx.pair_scores(spark, sf).select(*PAIR_COLS)
    base = S.landing_dir(spark, "ordered")
    groups = {"a": F.col("l_linenumber") <= 3, "b": F.col("l_linenumber") > 3}
    for name, kept in groups.items():
        part = ps.where(kept).repartitionByRange(*fx.ORDER_COLS).sortWithinPartitions(*fx.ORDER_COLS)
        S.write_table(part.drop("hsa") if name == "b" else part, f"{base}/{name}")
    return S.read_shards(spark, [f"{base}/a", f"{base}/b"],
                         [PAIR_CSV_SCHEMA, PAIR_CSV_SCHEMA.replace("hsa double, ", "")], with_order=True)


SHARD_ORDER = f"l_linenumber > 3, {', '.join(fx.ORDER_COLS)}"


@register("shards_in_file_order", sql=O.with_ctes(O.PAIR_SCORES, select=f"""
SELECT l_orderkey, l_linenumber, id_a, id_b, row_number() OVER (ORDER BY {SHARD_ORDER}) - 1 AS file_row FROM ps"""))
def q_shards_in_file_order(spark, sf):
    rows = _ordered_shards(spark, sf).select("l_orderkey", "l_linenumber", "id_a", "id_b", S.ORDER)
    return with_ordinal(rows, S.ORDER, "file_row").drop(S.ORDER)


def _dedup_shards_sql(direction: str) -> str:
    return O.with_ctes(O.PAIR_SCORES, select=f"""
SELECT least(id_a, id_b) AS id_lo, greatest(id_a, id_b) AS id_hi, id_a, id_b, bliss, loewe,
       CASE WHEN l_linenumber <= 3 THEN hsa END AS hsa, zip, l_orderkey, l_linenumber
FROM ps QUALIFY row_number() OVER (PARTITION BY least(id_a, id_b), greatest(id_a, id_b)
                                   ORDER BY {direction}) = 1""")


def _dedup_shards(spark, sf, keep):
    d = dedup_pairs(_ordered_shards(spark, sf), [S.ORDER], keep=keep)
    return d.select("id_lo", "id_hi", "id_a", "id_b", "bliss", "loewe", "hsa", "zip", "l_orderkey", "l_linenumber")


@register("dedup_first_in_files", sql=_dedup_shards_sql(SHARD_ORDER))
def q_dedup_first_in_files(spark, sf):
    return _dedup_shards(spark, sf, "first")


@register("dedup_last_in_files", sql=_dedup_shards_sql(", ".join(f"{c} DESC" for c in SHARD_ORDER.split(", "))))
def q_dedup_last_in_files(spark, sf):
    return _dedup_shards(spark, sf, "last")


@register("read_csv_raw", sql=O.with_ctes(O.PAIR_SCORES, select="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, id_a, id_b, bliss, loewe, hsa, zip FROM ps"""))
def q_read_csv_raw(spark, sf):
    ps = fx.pair_scores(spark, sf).select(*PAIR_COLS)
    path = S.write_table(ps, S.landing_dir(spark, "raw"))
    raw = S.read_table(spark, path, ", ".join(f"{c} string" for c in PAIR_COLS))
    types = dict(t.split(" ") for t in PAIR_CSV_SCHEMA.split(", "))
    return raw.select(*[F.col(c).cast(types[c]).alias(c) for c in PAIR_COLS])


@register("read_csv_typed", sql=O.with_ctes(*O.FULL, select="SELECT combo_id, drugs, prediction, reasoning, prompt FROM fin"))
def q_read_csv_typed(spark, sf):
    f = L.final(spark, sf).select("combo_id", "drugs", "prediction", "reasoning", "prompt")
    path = S.write_table(f, S.landing_dir(spark, "final"))
    return S.read_table(spark, path, "combo_id long, drugs string, prediction string, reasoning string, prompt string",
                        multiline=True)


@register("write_csv", sql=O.with_ctes(*O.CORE, select="""
SELECT vd.combo_id, ci.drugs, vd.prediction, vd.reasoning, vd.n_pairs, vd.missing_pairs, vd.synergistic, vd.additive
FROM vd JOIN combo_ids ci ON ci.combo_id = vd.combo_id"""))
def q_write_csv(spark, sf):
    v = L.verdicts(spark, sf)
    path = S.write_table(v, S.landing_dir(spark, "verdicts"))
    return S.read_table(spark, path, "combo_id long, drugs string, prediction string, reasoning string, "
                                     "n_pairs long, missing_pairs long, synergistic long, additive long")


@register("read_headerless", sql=O.with_ctes(*O.EVALS, select="SELECT combo_id, response AS Response FROM resp"))
def q_read_headerless(spark, sf):
    r = L.responses(spark, sf).drop("k")
    path = S.write_table(r, S.landing_dir(spark, "responses"), header=False)
    h = S.read_headerless(spark, path, ["combo_id", "Response"])
    return h.select(F.col("combo_id").cast("long").alias("combo_id"), "Response")


@register("read_padded", sql=O.with_ctes(*O.EVALS, select="""
SELECT ev.pred AS Answer, ev.truth AS Truth, fin.drugs AS Reasoning FROM ev JOIN fin ON fin.combo_id = ev.combo_id"""))
def q_read_padded(spark, sf):
    d = L.Derived(spark, sf)
    e = d.eval_table.join(d.combos.select("combo_id", "drugs"), "combo_id")
    line = F.concat(F.col("pred"), F.lit(", "), F.col("truth"), F.lit(', "'), F.col("drugs"), F.lit('"'))
    path = S.landing_dir(spark, "padded")
    e.select(line.alias("value")).write.mode("overwrite").text(path)
    return S.read_table(spark, path, "Answer string, Truth string, Reasoning string", header=False, glob=None,
                        strip=True)


@register("paged_first_n", sql=O.with_ctes(O.PAIR_SCORES, O.PAIR_NAMED, select="""
SELECT name_a AS drugNameA, name_b AS drugNameB, id_a AS idDrugA, id_b AS idDrugB, l_orderkey AS comboId,
       bliss, loewe, hsa, zip FROM psn ORDER BY ordinal LIMIT 20000"""))
def q_paged_first_n(spark, sf):
    rows = _page_rows(fx.pair_scores(spark, sf))
    path = S.write_pages(rows, S.landing_dir(spark, "pages"), "_ord")
    return S.read_pages(spark, path, rows.schema, n=20000).select(*NINE)


NINE = ["drugNameA", "drugNameB", "idDrugA", "idDrugB", "comboId", "bliss", "loewe", "hsa", "zip"]


def _page_rows(ps):
    """The nine landed fields plus the file-order key the pages are cut by."""
    return ps.select(F.struct(*fx.ORDER_COLS).alias("_ord"), *[
        F.col("name_a").alias("drugNameA"), F.col("name_b").alias("drugNameB"),
        F.col("id_a").alias("idDrugA"), F.col("id_b").alias("idDrugB"),
        F.col("l_orderkey").alias("comboId"), "bliss", "loewe", "hsa", "zip"])


@register("json_adjacency", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, EDGES, select="""
SELECT id, array_to_string(nb, ', ') AS neighbours FROM adj"""))
def q_json_adjacency(spark, sf):
    path = S.write_adjacency(sparse_adj(spark, sf), S.landing_dir(spark, "adjacency"))
    back = S.read_adjacency(spark, path)
    return back.select("id", join_ids(F.array_sort("neighbours")).alias("neighbours"))


@register("json_adjacency_blocks", sql=O.with_ctes(O.PAIR_SCORES_GRAPH, EDGES, BLOCK_LISTS, select="""
SELECT id, CAST(block AS BIGINT) AS block, CAST(len(nb) AS INTEGER) AS n, array_to_string(nb, ', ') AS neighbours FROM bl"""))
def q_json_adjacency_blocks(spark, sf):
    path = S.write_adjacency(graph_blocks(spark, sf), S.landing_dir(spark, "adjacency-blocks"))
    back = S.read_adjacency(spark, path, in_blocks=True)
    return back.select("id", "block", F.size("neighbours").alias("n"), join_ids("neighbours").alias("neighbours"))


@register("write_adjacency", sql=O.with_ctes(O.PAIR_SCORES_SPARSE, EDGES, select="""
SELECT CAST(id AS VARCHAR) AS id, CAST(len(nb) AS INTEGER) AS degree, array_to_string(nb, ', ') AS neighbours FROM adj"""))
def q_write_adjacency(spark, sf):
    path = S.write_adjacency(sparse_adj(spark, sf), S.landing_dir(spark, "adjacency-w"))
    raw = spark.read.schema("id string, neighbours array<string>").json(path)
    ids = F.array_sort(F.transform("neighbours", lambda x: x.cast("int")))
    return raw.select("id", F.size("neighbours").alias("degree"), join_ids(ids).alias("neighbours"))



PROMPT_BUDGET = 924     # 1,024-token window minus 100 kept free for the answer

_PTOK = r"list_filter(string_split_regex(prompt, '\s+'), lambda x: x <> '')"


# prompts as word ids, cut into batches of eight in key order
_COLLATED = f"""
, ptok AS (SELECT combo_id, {_PTOK} AS t FROM fin),
pvoc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(t) AS token FROM ptok) GROUP BY token),
pvid AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) AS token_id FROM pvoc),
pf AS (SELECT combo_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM ptok),
pids AS (SELECT f.combo_id, list(v.token_id ORDER BY f.pos) AS ids FROM pf f JOIN pvid v ON v.token = f.token
         GROUP BY f.combo_id),
pb AS (SELECT combo_id, ids, len(ids) AS n, CAST(floor((row_number() OVER (ORDER BY combo_id) - 1) / 8) AS BIGINT) AS batch_id FROM pids)"""


def _prompt_ids(spark, sf):
    # the prompts feed the vocabulary and the ids, the ids are numbered: both are stored once
    f = cut_lineage(L.final(spark, sf).select("combo_id", "prompt"))
    return cut_lineage(B.token_ids(f, "combo_id", "prompt", B.vocabulary(f, "prompt")))


@register("padded_batches", sql=O.with_ctes(*O.FULL, select=_COLLATED + """
, pm AS (SELECT *, CAST(max(n) OVER (PARTITION BY batch_id) AS INTEGER) AS pad_len FROM pb)
SELECT combo_id, batch_id, pad_len, CAST(n AS INTEGER) AS mask_sum,
       array_to_string(list_transform(range(pad_len - n), lambda x: 0) || ids, ' ') AS ids FROM pm"""),
          note="dynamic padding: the longest row of each batch, left side")
def q_padded_batches(spark, sf):
    b = B.pad_batches(batches(_prompt_ids(spark, sf), "combo_id", 8), side="left")
    return b.select("combo_id", "batch_id", "pad_len", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                    F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@register("padded_longest", sql=O.with_ctes(*O.FULL, select=_COLLATED + """
, pm AS (SELECT *, CAST((SELECT max(n) FROM pb) AS INTEGER) AS pad_len FROM pb)
SELECT combo_id, pad_len, CAST(n AS INTEGER) AS mask_sum,
       array_to_string(ids || list_transform(range(pad_len - n), lambda x: 0), ' ') AS ids FROM pm"""),
          note="padding to the longest row of the table")
def q_padded_longest(spark, sf):
    b = B.pad_batches(_prompt_ids(spark, sf), batch=None)
    return b.select("combo_id", "pad_len", F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
                    F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@register("prompt_blocks", sql=O.with_ctes(*O.FULL, select=f"""
, ptok AS (SELECT combo_id, {_PTOK} AS t FROM fin),
pvoc AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(t) AS token FROM ptok) GROUP BY token),
pvid AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, token) AS token_id FROM pvoc),
pf AS (SELECT combo_id, unnest(t[1:{PROMPT_BUDGET}]) AS token, unnest(range(len(t[1:{PROMPT_BUDGET}]))) AS pos FROM ptok),
pids AS (SELECT f.combo_id, list(v.token_id ORDER BY f.pos) AS ids FROM pf f JOIN pvid v ON v.token = f.token
         GROUP BY f.combo_id)
SELECT ptok.combo_id, CAST({PROMPT_BUDGET} - len(pids.ids) AS INTEGER) AS n_pad,
       array_to_string(pids.ids, ' ') AS ids,
       CAST(len(ptok.t) AS INTEGER) AS n_tokens, len(ptok.t) > {PROMPT_BUDGET} AS truncated
FROM ptok JOIN pids ON pids.combo_id = ptok.combo_id"""), note="left-padded prompt budget")
def q_prompt_blocks(spark, sf):
    f = cut_lineage(L.final(spark, sf).select("combo_id", "prompt"))
    b = B.blocks(f, "combo_id", "prompt", B.vocabulary(f, "prompt"), size=PROMPT_BUDGET, side="left")
    # no lambdas: inside one the mask, an expression, would be made anew for every id
    n_pad = F.size(F.array_remove("mask", 1))
    real = F.slice("ids", n_pad + 1, F.size("ids") - n_pad)      # the padding is on the left
    return b.select("combo_id", n_pad.alias("n_pad"), join_ids(real, " ").alias("ids"), "n_tokens", "truncated")
