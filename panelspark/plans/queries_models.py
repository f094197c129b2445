"""Queries over splits, imputation, reduction, clustering, metrics and the ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import spec
from panelspark.functions import columns as fc
from panelspark.operators import cluster, impute, metrics, reduce, sampling
from panelspark.plans import panel
from panelspark.plans.panel import sql_key, table, with_sql
from panelspark.plans.registry import query

FT = panel.SQL_FEATURES


def r6(col):
    return F.round(col, 6) + 0.0


# ---- splits ----------------------------------------------------------------

def _sql_split(by, seed, share):
    return f"""
SELECT hhid, wave, rn <= ceil(n * {share}) AS is_test FROM (
  SELECT hhid, wave, row_number() OVER (PARTITION BY {by} ORDER BY {sql_key('hhid', seed)}, hhid) AS rn,
         count(*) OVER (PARTITION BY {by}) AS n FROM hh)"""


@query("m1_split", with_sql(f"""
SELECT 'plain' AS kind, * FROM ({_sql_split('1', 42, 0.3)})
UNION ALL SELECT 'stratified', * FROM ({_sql_split('wave', 43, 0.3)})""", panel.SQL_HOUSEHOLDS))
def split(spark, sf):
    hh = panel.households(spark, sf).select("hhid", "wave")
    plain = sampling.split(hh, "hhid", 42, 0.3, key_fn=fc.arithmetic_key)
    strata = sampling.split(hh, "hhid", 43, 0.3, stratify="wave", key_fn=fc.arithmetic_key)
    return plain.select(F.lit("plain").alias("kind"), "*").unionByName(
        strata.select(F.lit("stratified").alias("kind"), "*"))


@query("m26_stratified_folds", with_sql(f"""
SELECT hhid, rural_urban, CAST((row_number() OVER (PARTITION BY rural_urban ORDER BY {sql_key('hhid', 42)}, hhid) - 1) % 5
  AS INTEGER) AS fold FROM hh""", panel.SQL_HOUSEHOLDS))
def stratified_folds(spark, sf):
    return sampling.folds(panel.households(spark, sf).select("hhid", "rural_urban"), "hhid", 42, 5,
                          stratify="rural_urban", key_fn=fc.arithmetic_key)


# ---- documents with partly known labels ------------------------------------

DOC_COLUMNS = ["n_chars", "source_no", "lang_1", "lang_2", "lang_3", "quality", "toxic"]


def documents(spark, sf):
    """Document features; quality and toxicity are known where a label exists."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"),
        F.regexp_extract("source", "[0-9]+", 0).cast("double").alias("source_no"),
        *[(F.col("lang") == lang).cast("double").alias(f"lang_{i}") for i, lang in enumerate(("de", "en", "fr"), 1)],
        F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))


SQL_DOCS = """
d AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS n_chars,
        CAST(regexp_extract(source, '[0-9]+') AS DOUBLE) AS source_no,
        CAST(lang = 'de' AS DOUBLE) AS lang_1, CAST(lang = 'en' AS DOUBLE) AS lang_2,
        CAST(lang = 'fr' AS DOUBLE) AS lang_3, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic
      FROM documents LEFT JOIN labels USING (doc_id))"""
_SQUARE = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in DOC_COLUMNS[:5])
SQL_NEAREST = f"""{SQL_DOCS},
near AS (SELECT * FROM (
  SELECT a.doc_id, b.doc_id AS donor, d2, b.quality, b.toxic,
         row_number() OVER (PARTITION BY a.doc_id ORDER BY d2, b.doc_id) AS rank
  FROM (SELECT * FROM d WHERE quality IS NULL) a, (SELECT * FROM d WHERE quality IS NOT NULL) b,
       LATERAL (SELECT ({_SQUARE}) * 7 / 5 AS d2)) WHERE rank <= 5)"""


@query("m2_knn_impute", with_sql("""
SELECT doc_id, round(coalesce(d.quality, q), 6) + 0.0 AS quality, round(coalesce(d.toxic, t), 6) + 0.0 AS toxic
FROM d LEFT JOIN (SELECT doc_id, avg(quality) AS q, avg(toxic) AS t FROM near GROUP BY 1) USING (doc_id)""", SQL_NEAREST))
def knn_impute(spark, sf):
    filled = impute.knn_impute(documents(spark, sf), "doc_id", DOC_COLUMNS, {"label": ["quality", "toxic"]})
    return filled.select("doc_id", r6(F.col("quality")).alias("quality"), r6(F.col("toxic")).alias("toxic"))


@query("j9_nearest_donors", with_sql("""
SELECT doc_id, donor, CAST(rank AS INTEGER) AS rank, round(sqrt(d2), 6) + 0.0 AS distance FROM near""", SQL_NEAREST))
def nearest_donors(spark, sf):
    found = impute.nearest_donors(documents(spark, sf), "doc_id", DOC_COLUMNS, {"label": ["quality", "toxic"]})
    return found.select("doc_id", "donor", "rank", r6(F.col("distance")).alias("distance"))


@query("m2_household_impute")
def household_impute(spark, sf):
    """All gaps of the household design matrix filled, one neighbour list per question."""
    groups = {f: [f"{f}_{c}" for c in codes] for f, codes in panel.code_lists().items()}
    columns = [*panel.NUMERIC, *[c for g in groups.values() for c in g]]
    return impute.knn_impute(panel.design(spark, sf), "hhid", columns, groups)


# ---- scaling, components ---------------------------------------------------

_LINE = ["l_quantity", "l_extendedprice", "l_discount"]


def _z(c):
    return f"round(({c} - m.{c}) / s.{c}, 6) + 0.0 AS {c}"


@query("m3_standardise", f"""
WITH m AS (SELECT {', '.join(f'avg({c}) AS {c}' for c in _LINE)} FROM lineitem),
     s AS (SELECT {', '.join(f'stddev_pop({c}) AS {c}' for c in _LINE)} FROM lineitem)
SELECT l_orderkey AS hhid, {', '.join(_z('lineitem.' + c).replace('m.lineitem.', 'm.').replace('s.lineitem.', 's.').replace('AS lineitem.', 'AS ') for c in _LINE)}
FROM lineitem, m, s""")
def standardise(spark, sf):
    line = table(spark, sf, "lineitem")
    z = reduce.fit_scaler(line, _LINE).transform(line.select(F.col("l_orderkey").alias("hhid"), *_LINE))
    return z.select("hhid", *[r6(F.col(c)).alias(c) for c in _LINE])


@query("m4_principal_components", """
WITH s AS (SELECT avg(n_chars) AS ma, stddev_pop(n_chars) AS sa, avg(n_words) AS mb, stddev_pop(n_words) AS sb,
                  sign(corr(n_chars, n_words)) AS r
           FROM (SELECT CAST(n_chars AS DOUBLE) AS n_chars,
                        CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words FROM documents)),
z AS (SELECT doc_id, (CAST(n_chars AS DOUBLE) - ma) / sa AS a, (len(string_split(text, ' ')) - mb) / sb AS b, r
      FROM documents, s)
SELECT doc_id, round((a + r * b) / sqrt(2), 5) + 0.0 AS pc1, round((a - r * b) / sqrt(2), 5) + 0.0 AS pc2 FROM z""")
def principal_components(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", " ", -1)).cast("double").alias("n_words"))
    fitted = reduce.fit_reducer(docs, ["n_chars", "n_words"], "pca", 2)
    return fitted.transform(docs).select("doc_id", *[(F.round(p, 5) + 0.0).alias(p) for p in ("pc1", "pc2")])


# ---- clusters --------------------------------------------------------------

_DIM = 64
VECTOR = [f"e{i}" for i in range(_DIM)]


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    width = F.size("embedding")
    whole = F.when(width == _DIM, F.col("embedding")).otherwise(F.raise_error(F.concat(
        F.lit(f"vectors have {_DIM} values, not "), width.cast("string"))).cast("array<float>"))
    e = e.select("vec_id", "label", whole.alias("embedding"))
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(VECTOR)])


SQL_VECTORS = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
cell AS (SELECT vec_id, label, unnest(range(64)) AS j, unnest(v) AS x FROM e),
cent AS (SELECT label, list(c ORDER BY j) AS c, any_value(n) AS n
         FROM (SELECT label, j, avg(x) AS c, count(*) AS n FROM cell GROUP BY ALL) GROUP BY label)"""


def _label_centers(spark, sf):
    """Mean vector of each given label, ordered by label: one row per class."""
    rows = vectors(spark, sf).groupBy("label").agg(F.array(*[F.avg(c) for c in VECTOR]).alias("c")).orderBy("label")
    from panelspark.runtime import bounded_rows

    return [(r["label"], r["c"]) for r in bounded_rows(rows, 1000, "The set of labels")]


@query("m6_label_order", with_sql("""
SELECT label AS cluster, CAST(row_number() OVER (ORDER BY norm, label) - 1 AS INTEGER) AS label, round(norm, 6) + 0.0 AS norm
FROM (SELECT label, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM cent)""", SQL_VECTORS))
def label_order(spark, sf):
    centers = _label_centers(spark, sf)
    order = cluster.order_by_norm([c for _, c in centers])
    rank = {centers[old][0]: new for new, old in enumerate(order)}
    means = vectors(spark, sf).groupBy(F.col("label").alias("cluster")).agg(
        F.array(*[F.avg(c) for c in VECTOR]).alias("c"))
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    return means.select("cluster", ranks[F.col("cluster")].alias("label"), r6(fc.l2_norm(F.col("c"))).alias("norm"))


@query("m7_nearest_center", with_sql("""
SELECT vec_id, CAST(arg_min(label, d) AS INTEGER) AS cluster FROM (
  SELECT vec_id, cent.label, list_distance(v, c) AS d FROM e, cent) GROUP BY vec_id""", SQL_VECTORS))
def nearest_center(spark, sf):
    centers = _label_centers(spark, sf)
    return cluster.assign_nearest(vectors(spark, sf), VECTOR, [c for _, c in centers], "cluster").select(
        "vec_id", "cluster")


@query("m9_silhouette", with_sql("""
SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette
FROM (SELECT vec_id, max(n) FILTER (own) AS n, max(s / nullif(n - 1, 0)) FILTER (own) AS a, min(s / n) FILTER (NOT own) AS b
      FROM (SELECT p.vec_id, q.label = p.label AS own, count(*) AS n, sum(list_distance(p.v, q.v)) AS s
            FROM e p, e q GROUP BY p.vec_id, p.label, q.label) GROUP BY vec_id)""", SQL_VECTORS))
def silhouette(spark, sf):
    return cluster.silhouette(vectors(spark, sf), VECTOR, "label").select(r6(F.col("silhouette")).alias("silhouette"))


@query("m9_silhouette_squared", with_sql("""
SELECT round(avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) + 0.0 AS silhouette_squared
FROM (SELECT vec_id, max(n) FILTER (own) AS n, max(s / nullif(n - 1, 0)) FILTER (own) AS a, min(s / n) FILTER (NOT own) AS b
      FROM (SELECT p.vec_id, q.label = p.label AS own, count(*) AS n, sum(list_distance(p.v, q.v) ** 2) AS s
            FROM e p, e q GROUP BY p.vec_id, p.label, q.label) GROUP BY vec_id)""", SQL_VECTORS))
def silhouette_squared(spark, sf):
    """The silhouette of squared distances, from the sums of each cluster: linear in the rows."""
    value = cluster.squared_silhouette(vectors(spark, sf), VECTOR, "label")
    return spark.range(1).select((F.round(F.lit(value), 5) + 0.0).alias("silhouette_squared"))


@query("m10_calinski_harabasz", with_sql("""
SELECT round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 AS calinski_harabasz FROM (
  SELECT sum(n * vp) AS w, sum(n * (c - m) * (c - m)) AS b, max(total) AS n, max(k) AS k FROM (
    SELECT label, j, avg(x) AS c, var_pop(x) AS vp, count(*) AS n FROM cell GROUP BY ALL)
  JOIN (SELECT j, avg(x) AS m, count(*) AS total, count(DISTINCT label) AS k FROM cell GROUP BY j) USING (j))""",
                                           SQL_VECTORS))
def calinski_harabasz(spark, sf):
    return cluster.calinski_harabasz(vectors(spark, sf), VECTOR, "label").select(
        r6(F.col("calinski_harabasz")).alias("calinski_harabasz"))


@query("m11_davies_bouldin", with_sql("""
SELECT round(avg(r), 6) + 0.0 AS davies_bouldin FROM (
  SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM sp a JOIN sp b ON a.label <> b.label GROUP BY 1)""",
                                        SQL_VECTORS + """,
sp AS (SELECT e.label, any_value(c) AS c, avg(list_distance(v, c)) AS s FROM e JOIN cent USING (label) GROUP BY 1)"""))
def davies_bouldin(spark, sf):
    return cluster.davies_bouldin(vectors(spark, sf), VECTOR, "label").select(
        r6(F.col("davies_bouldin")).alias("davies_bouldin"))


# ---- metrics ---------------------------------------------------------------

def predictions(spark, sf):
    """Head attributes guessed from the member's price: truth, prediction and a score with ties."""
    line = table(spark, sf, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("hhid"), "l_linenumber",
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("truth"),
        F.when(F.col("l_quantity") > 30, 1).otherwise(0).alias("predicted"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("truth3"),
        F.when(F.col("l_quantity") > 40, 0).when(F.col("l_quantity") > 10, 1).otherwise(2).alias("predicted3"),
        (F.col("l_discount") * F.col("l_quantity")).alias("score"), F.col("l_tax").alias("score0"),
        F.col("l_quantity").alias("score1"), F.col("l_discount").alias("score2"))


SQL_PREDICTIONS = """
pr AS (SELECT l_orderkey AS hhid, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS truth,
         CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END AS predicted,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS truth3,
         CASE WHEN l_quantity > 40 THEN 0 WHEN l_quantity > 10 THEN 1 ELSE 2 END AS predicted3,
         l_discount * l_quantity AS score, l_tax AS score0, l_quantity AS score1, l_discount AS score2
       FROM lineitem)"""


@query("m12_confusion", with_sql("""
SELECT l_linenumber, t.v AS truth, p.v AS predicted,
       (SELECT count(*) FROM pr WHERE pr.l_linenumber = l.l_linenumber AND truth3 = t.v AND predicted3 = p.v) AS n
FROM (SELECT DISTINCT l_linenumber FROM pr) l, (VALUES (0), (1), (2)) t(v), (VALUES (0), (1), (2)) p(v)""",
                                   SQL_PREDICTIONS))
def confusion(spark, sf):
    return metrics.confusion(predictions(spark, sf), "truth3", "predicted3", ["l_linenumber"])


_SQL_LABELS = f"""{SQL_PREDICTIONS},
side AS (SELECT l_linenumber, truth3 AS label, count(*) AS t, 0 AS p, count(*) FILTER (truth3 = predicted3) AS tp
         FROM pr GROUP BY 1, 2
         UNION ALL SELECT l_linenumber, predicted3, 0, count(*), 0 FROM pr GROUP BY 1, 2),
lab AS (SELECT l_linenumber, label, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(p) AS DOUBLE) AS p,
               CAST(sum(tp) AS DOUBLE) AS tp FROM side GROUP BY 1, 2),
sc AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS precision, CASE WHEN t = 0 THEN 0 ELSE tp / t END AS recall,
              2 * tp / (t + p) AS f1, tp / (t + p - tp) AS jaccard FROM lab)"""
_MACRO = ["accuracy", "precision", "recall", "f1", "jaccard", "kappa", "mcc", "gmean"]


@query("m13_macro_metrics", with_sql(f"""
SELECT l_linenumber, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _MACRO)} FROM (
  SELECT l_linenumber, c / n AS accuracy, precision, recall, f1, jaccard,
         1 - (1 - c / n) / (1 - tp / (n * n)) AS kappa,
         (c * n - tp) / sqrt((n * n - pp) * (n * n - tt)) AS mcc, sqrt(precision * recall) AS gmean FROM (
    SELECT l_linenumber, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(jaccard) AS jaccard,
           sum(t) AS n, sum(tp) AS c, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp FROM sc GROUP BY 1))""",
                                       _SQL_LABELS))
def macro_metrics(spark, sf):
    return metrics.macro_metrics(confusion(spark, sf), ["l_linenumber"]).select(
        "l_linenumber", *[r6(F.col(c)).alias(c) for c in _MACRO])


@query("m14_per_class", with_sql("""
SELECT l_linenumber, label, round(recall, 6) + 0.0 AS recall, round(precision, 6) + 0.0 AS precision,
       round(f1, 6) + 0.0 AS f1 FROM sc WHERE t > 0""", _SQL_LABELS))
def per_class(spark, sf):
    return metrics.per_class(confusion(spark, sf), ["l_linenumber"]).select(
        "l_linenumber", "label", *[r6(F.col(c)).alias(c) for c in ("recall", "precision", "f1")])


_SQL_AUC = f"""{SQL_PREDICTIONS},
ovr AS (SELECT l_linenumber, c, truth3 = c AS pos, CASE c WHEN 0 THEN score0 WHEN 1 THEN score1 ELSE score2 END AS s
        FROM pr, (VALUES (0), (1), (2)) k(c)),
rk AS (SELECT l_linenumber, c, pos, rank() OVER w + (count(*) OVER (PARTITION BY l_linenumber, c, s) - 1) / 2.0 AS r
       FROM ovr WINDOW w AS (PARTITION BY l_linenumber, c ORDER BY s)),
au AS (SELECT l_linenumber, c, (sum(r) FILTER (pos) - np * (np + 1) / 2.0) / (np * nn) AS auc
       FROM rk JOIN (SELECT l_linenumber, c, CAST(count(*) FILTER (pos) AS DOUBLE) AS np,
                            CAST(count(*) FILTER (NOT pos) AS DOUBLE) AS nn FROM ovr GROUP BY 1, 2)
       USING (l_linenumber, c) GROUP BY l_linenumber, c, np, nn)"""


@query("m15_auc", with_sql("""
SELECT l_linenumber, round(avg(auc), 6) + 0.0 AS auc_macro FROM au GROUP BY 1""", _SQL_AUC))
def auc(spark, sf):
    scores = {0: "score0", 1: "score1", 2: "score2"}
    return metrics.macro_auc(predictions(spark, sf), "truth3", scores, ["l_linenumber"]).select(
        "l_linenumber", r6(F.col("auc_macro")).alias("auc_macro"))


@query("m16_train_test_gap", with_sql(f"""
SELECT round(tr, 6) + 0.0 AS train_accuracy, round(te, 6) + 0.0 AS test_accuracy, round(tr - te, 6) + 0.0 AS train_test_gap
FROM (SELECT avg(hit) FILTER (NOT test) AS tr, avg(hit) FILTER (test) AS te FROM (
  SELECT CAST(truth = predicted AS DOUBLE) AS hit, rn <= ceil(n * 0.3) AS test FROM pr JOIN (
    SELECT o_orderkey AS hhid, row_number() OVER (ORDER BY {sql_key('o_orderkey', 42)}, o_orderkey) AS rn,
           count(*) OVER () AS n FROM orders) USING (hhid)))""", SQL_PREDICTIONS))
def train_test_gap(spark, sf):
    keys = table(spark, sf, "orders").select(F.col("o_orderkey").alias("hhid"))
    sides = sampling.split(keys, "hhid", 42, 0.3, key_fn=fc.arithmetic_key)
    gap = metrics.train_test_gap(predictions(spark, sf).join(sides, "hhid"), "truth", "predicted")
    return gap.select(*[r6(F.col(c)).alias(c) for c in gap.columns])


def _runs(spark, sf):
    """Accuracy and gmean per run, one run per line number."""
    return macro_metrics(spark, sf).withColumnRenamed("l_linenumber", "seed").unpivot(
        ["seed"], ["accuracy", "gmean"], "metric", "value")


_SQL_RUNS = f"""{_SQL_LABELS},
runs AS (SELECT l_linenumber, 'accuracy' AS metric, round(sum(tp) / sum(t), 6) AS value FROM sc GROUP BY 1
         UNION ALL SELECT l_linenumber, 'gmean', round(sqrt(avg(precision) * avg(recall)), 6) FROM sc GROUP BY 1)"""


@query("a5_mean_std_over_seeds", with_sql("""
SELECT metric, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std FROM runs GROUP BY 1""",
                                            _SQL_RUNS))
def mean_std_over_seeds(spark, sf):
    return metrics.aggregate_runs(_runs(spark, sf)).select("metric", r6(F.col("mean")).alias("mean"),
                                                           r6(F.col("std")).alias("std"))


@query("a6_mean_std_over_folds", with_sql("""
SELECT metric, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std FROM runs GROUP BY 1""",
                                            _SQL_RUNS))
def mean_std_over_folds(spark, sf):
    return metrics.aggregate_folds(_runs(spark, sf)).select("metric", r6(F.col("mean")).alias("mean"),
                                                            r6(F.col("std")).alias("std"))


# ---- fitted clusters and ensembles -----------------------------------------

def quick_stacking(learners=("glm", "gbm", "drf", "xgb", "nn"), cv=3):
    """All model families with few iterations, for tests of other parts; no query fits it."""
    return spec.StackingSettings(base_learners=tuple(learners), cv=cv, glm_iterations=50, gbm_trees=5, drf_trees=10,
                                 drf_depth=6, xgb_trees=8, hidden_layers=(8,), nn_epochs=20)


def seeded(*seeds):
    """The full settings (five learners, five folds, ten K-Means starts) over these seeds instead of twenty."""
    return spec.Settings(experiment=spec.ExperimentSettings(seeds=seeds))


def document_design(spark, sf, truth=None):
    """All documents as a design with missing answers; quality and toxicity share their gaps."""
    from panelspark.plans.experiment import Design

    rows = documents(spark, sf)
    log = F.log1p("n_chars").alias("n_chars")
    columns = [c for c in DOC_COLUMNS if c != truth]
    groups = {"toxic": ["toxic"]} if truth == "quality" else {"label": ["quality", "toxic"]}
    table_ = rows.where(F.col(truth).isNotNull()) if truth else rows
    picked = table_.select("doc_id", log, *columns[1:], *([F.col(truth).cast("int").alias(truth)] if truth else []))
    return Design(picked, "doc_id", tuple(columns), groups, truth)


def scored_documents(spark, sf):
    """All documents with the columns a classifier sees; `quality` is null where there is no label."""
    columns = ["n_chars", "source_no", "lang_1", "lang_2", "lang_3"]
    rows = documents(spark, sf).withColumn("n_chars", F.log1p("n_chars"))
    return rows.select("doc_id", "lang", F.col("quality").cast("int").alias("quality"), *columns), columns


def labelled_documents(spark, sf):
    """Documents with a known label, ready for a classifier."""
    rows, columns = scored_documents(spark, sf)
    return rows.where("quality is not null"), columns


def _coordinates(spark, sf, n=2):
    v = vectors(spark, sf)
    fitted = reduce.fit_reducer(v, VECTOR, "pca", n)
    return fitted.transform(v).select("vec_id", "label", *fitted.outputs), fitted.outputs


@query("m5_kmeans", "SELECT vec_id, true AS settled, true AS least_cost FROM embeddings")
def kmeans(spark, sf):
    """Every vector; whether the centres are the means of what they attract, and the kept start costs least of ten."""
    points, outputs = _coordinates(spark, sf)
    best = cluster.fit_kmeans(points, outputs, 2)
    placed = best.assign(points, "cluster")
    means = {r["cluster"]: r for r in placed.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in outputs]).collect()}
    settled = all(abs(means[i][c] - v) < 1e-2 for i, center in enumerate(best.centers) for c, v in zip(outputs, center))
    costs = [s.cost for s in cluster.fit_starts(points, outputs, [2])[2]]
    return placed.select("vec_id", F.lit(settled).alias("settled"), F.lit(best.cost <= min(costs) * (1 + 1e-9)).alias("least_cost"))


@query("m8_choose_k")
def choose_k(spark, sf):
    points, outputs = _coordinates(spark, sf)
    best, scores = cluster.choose_k(points, outputs, spec.ClusterSettings().k_search_range)
    return spark.createDataFrame([(k, s, k == best) for k, s in scores.items()], "k int, silhouette double, chosen boolean")


def _checked(scored, loss, base):
    """Whether the probabilities of each document are proper, and whether the model beats the share of the classes in log-loss."""
    p = F.col("p")
    proper = (F.size("p") == 2) & (p[0] >= 0) & (p[1] >= 0) & (F.abs(p[0] + p[1] - 1) < 1e-9)
    return scored.select("doc_id", proper.alias("proper"), F.lit(loss < base).alias("learned"))


def _losses(scored):
    """Mean log-loss on the labelled documents, and that of always answering the share of the classes."""
    true = F.when(F.col("quality") == 1, F.col("p")[1]).otherwise(F.col("p")[0])
    share = F.avg("quality")
    base = -(share * F.ln(share) + (1 - share) * F.ln(1 - share))
    return scored.where("quality is not null").agg(F.avg(-F.ln(F.greatest(true, F.lit(1e-6)))), base).first()


def _learner(name):
    def run(spark, sf):
        from panelspark.operators.ensemble import fit_learner, probability_column
        from panelspark.runtime import cut_lineage

        rows, columns = scored_documents(spark, sf)
        rows = rows.select("doc_id", "quality", F.array(*columns).alias("features"))
        model = fit_learner(rows.where("quality is not null"), "doc_id", "quality", name, spec.StackingSettings(), 42, len(columns), 2)
        scored = cut_lineage(rows.withColumn("p", probability_column(F.col("features"), model.probabilities)))
        if name != "glm":
            return _checked(scored, *_losses(scored))
        # the penalised loss has one optimum: its gradient is 0 there
        known = scored.where("quality is not null").select("features", (F.col("p")[1] - F.col("quality")).alias("d"))
        means = known.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("features")[i] * F.col("d")).alias(f"g{i}") for i in range(len(columns))]).first()
        flat = max(abs(means[f"g{i}"] + w / means["n"]) for i, w in enumerate(model.weights[0])) < 1e-3
        return _checked(scored, 0.0, 1.0).withColumn("learned", F.lit(bool(flat)))

    return run


_SQL_CHECKED = "SELECT doc_id, true AS proper, true AS learned FROM documents"

for _id, _name, _short in (("m17", "glm", "logistic"), ("m18", "gbm", "boosting"), ("m19", "drf", "forest"),
                           ("m20", "xgb", "second_boosting"), ("m21", "nn", "neural_net")):
    query(f"{_id}_{_short}", _SQL_CHECKED)(_learner(_name))


@query("m22_stacking", _SQL_CHECKED)
def stacking(spark, sf):
    """All five learners; every document is scored."""
    from panelspark.operators.ensemble import fit_stack
    from panelspark.runtime import cut_lineage

    rows, columns = scored_documents(spark, sf)
    model = fit_stack(rows.where("quality is not null"), "doc_id", columns, "quality", spec.StackingSettings(), 42, 2)
    scored = cut_lineage(model.transform(rows).select("doc_id", "quality", F.col("probability").alias("p")))
    return _checked(scored, *_losses(scored))


@query("m24_experiment")
def experiment(spark, sf):
    from panelspark.plans.experiment import run_experiment

    return run_experiment(document_design(spark, sf), seeded(42, 43))["aggregate"]


@query("m25_outside_label", """
SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, quality AS label FROM documents JOIN labels USING (doc_id)""")
def outside_label(spark, sf):
    from panelspark.plans.experiment import build_design

    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("rooms"))
    truth = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    design = build_design(docs, "doc_id", truth=truth, truth_col="label")
    return design.table.select("doc_id", F.col(design.columns[0]).alias("n_chars"), "label")


@query("m25_outside_label_run")
def outside_label_run(spark, sf):
    from panelspark.plans.experiment import run_experiment

    return run_experiment(document_design(spark, sf, truth="quality"), seeded(42))["summary"]


@query("m26_fold_probe")
def fold_probe(spark, sf):
    from panelspark.plans.experiment import fold_probe as probe

    return metrics.aggregate_folds(probe(document_design(spark, sf), spec.Settings()))


@query("m27_random_label", f"""
SELECT o_orderkey AS hhid, CAST({sql_key('o_orderkey', 7)} >= 1073741824 AS INTEGER) AS label FROM orders""")
def random_label(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("hhid"), sampling.random_label(
        F.col("o_orderkey"), 7, fc.arithmetic_key).alias("label"))


@query("m27_random_label_probe")
def random_label_probe(spark, sf):
    from panelspark.plans.experiment import random_label_probe as probe

    return probe(document_design(spark, sf), spec.Settings(), (42,))


@query("m28_gap_probe")
def gap_probe(spark, sf):
    from panelspark.plans.experiment import gap_probe as probe

    return probe(document_design(spark, sf), spec.Settings(), (42,))


@query("m29_fit_full")
def fit_full(spark, sf):
    from panelspark.plans.experiment import fit_full as full

    prepared, model = full(document_design(spark, sf), spec.Settings())
    return model.transform(prepared.table).select("doc_id", "cluster_label", "prediction",
                                                  F.col("probability")[1].alias("probability"))
