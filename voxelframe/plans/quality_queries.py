"""Queries: scores, selection, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import model, quality
from voxelframe.operators.overlap import AT
from voxelframe.plans.grid_queries import fold_sql
from voxelframe.plans.measure_queries import rounded
from voxelframe.plans.registry import query

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a21_binary_scores", "c AS (SELECT image, count(*) FILTER (class = 1 AND l_quantity > 25) AS tp, count(*) FILTER (class = 0 AND l_quantity > 25) AS fp, count(*) FILTER (class = 1 AND l_quantity <= 25) AS fn, count(*) FILTER (class = 0 AND l_quantity <= 25) AS tn FROM feat GROUP BY 1), p AS (SELECT *, tp + fp + fn + tn AS n, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c) SELECT image, round((tp + fn) / n, 6) AS positive_ratio, round((tp + tn) / n, 6) AS accuracy, round(p, 6) AS precision_, round(r, 6) AS recall_, round(2 * p * r / (p + r), 6) AS f1, round(r * p + (1 - r) * (tp + fn) / n, 6) AS average_precision, round((r + tn / (tn + fp)) / 2, 6) AS auroc FROM p")
def a21(v):
    return rounded(quality.binary_scores(v.feat().withColumn("guess", (F.col("l_quantity") > 25).cast("int")), "class", "guess", ["image"]))


@query("a22_score_summary", "SELECT image, printf('%.3f (+/- %.3f)', avg(l_discount), 2 * stddev_pop(l_discount)) AS summary FROM feat GROUP BY 1")
def a22(v):
    return quality.score_summary(v.feat(), "image", "l_discount")


@query("a23_soft_iou", "SELECT z, round((sum(a.value / 255.0 * b.value / 255.0) + 1) / (sum(a.value / 255.0) + sum(b.value / 255.0) - sum(a.value / 255.0 * b.value / 255.0) + 1), 6) AS iou FROM msk_a a JOIN msk_b b USING (volume_id, z, y, x) GROUP BY 1")
def a23(v):
    both = v.msk_a().withColumn("a", F.col("value") / 255.0).drop("value").join(v.msk_b().withColumn("b", F.col("value") / 255.0).drop("value"), AT)
    return rounded(quality.soft_iou(both, "a", "b", ["z"]))


@query("a24_channel_scores", "g AS (SELECT class, CASE WHEN l_discount >= l_tax THEN 0 ELSE 1 END AS g FROM feat) SELECT round(count(*) FILTER (g = 1 AND class = 1) / count(*) FILTER (g = 1), 6) AS precision_, round(count(*) FILTER (g = 1 AND class = 1) / count(*) FILTER (class = 1), 6) AS recall_ FROM g")
def a24(v):
    return rounded(quality.channel_scores(v.feat().withColumn("t0", 1 - F.col("class")), ["t0", "class"], ["l_discount", "l_tax"], 1))


@query("a25_weighted_cross_entropy", "l AS (SELECT class, l_discount AS a, l_tax AS b, ln(exp(l_discount) + exp(l_tax)) AS s FROM feat) SELECT round(avg(CASE WHEN class = 0 THEN s - a ELSE 5 * (s - b) END), 6) AS loss FROM l")
def a25(v):
    return rounded(quality.weighted_cross_entropy(v.feat(), ["l_discount", "l_tax"], "class", [1.0, 5.0]))


def image_pair(v):
    return v.vox().withColumn("j", F.col("i") + (F.col("x") + F.col("y")) % 5)


@query("a26_psnr", "m AS (SELECT z, 10 * log10(255.0 * 255.0 / avg(((x + y) % 5) * ((x + y) % 5))) AS psnr FROM vox GROUP BY 1) SELECT z, round(avg(psnr), 6) AS psnr FROM m GROUP BY GROUPING SETS ((z), ())")
def a26(v):
    return rounded(quality.psnr(image_pair(v), "i", "j", ["z"], 255.0))


SSIM_SQL = f"""pair AS (SELECT z, y, x, i + 1000 * (i + (x + y) % 5) AS i FROM vox), {fold_sql("near", "pair", "i", 1)},
m AS (SELECT z, y, x, avg(a) AS a, avg(b) AS b, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM (SELECT z, y, x, CAST(v % 1000 AS DOUBLE) AS a, CAST(v // 1000 AS DOUBLE) AS b FROM near) GROUP BY 1, 2, 3),
t AS (SELECT z, a, b, 9.0 / 8 * (aa - a * a) AS va, 9.0 / 8 * (bb - b * b) AS vb, 9.0 / 8 * (ab - a * b) AS vab FROM m)
SELECT z, round(avg((2 * a * b + 6.5025) * (2 * vab + 58.5225) / ((a * a + b * b + 6.5025) * (va + vb + 58.5225))), 6) AS ssim FROM t GROUP BY 1"""


@query("a26_ssim", SSIM_SQL)
def a26_ssim(v):
    return rounded(quality.ssim(image_pair(v), "i", "j", 1, 255.0)).drop("volume_id")


@query("a28_marginal_means", "SELECT param, value, round(avg(score), 6) AS mean, count(*) AS n FROM (SELECT unnest(['image', 'class']) AS param, CAST(unnest([image, class]) AS VARCHAR) AS value, l_discount AS score FROM feat) GROUP BY 1, 2")
def a28(v):
    return rounded(quality.marginal_means(v.feat(), ["image", "class"], "l_discount"))


@query("a29_iou_histogram", "b AS (SELECT CAST(least(9, floor(l_discount * 10 * 10)) AS INT) AS bin, count(*) AS count FROM feat GROUP BY 1) SELECT bin, count, sum(count) OVER (ORDER BY bin DESC) AS at_least FROM b")
def a29(v):
    return quality.threshold_counts(v.feat().withColumn("s", F.col("l_discount") * 10), "s", 10)


@query("a30_feature_votes", "SELECT class_name, count(DISTINCT user_id) AS votes FROM (SELECT event_type AS class_name, user_id FROM events) GROUP BY 1 HAVING count(DISTINCT user_id) > 2")
def a30(v):
    return quality.votes(v.table("events").select(F.col("event_type").alias("class_name"), "user_id"), "class_name", "user_id", 2)


A31_SQL = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM feat" for k, a in enumerate(FEATURES) for b in FEATURES[k + 1 :])


@query("a31_correlations", A31_SQL)
def a31(v):
    found = quality.correlations(v.feat(), FEATURES).where("a <> b")
    pair = lambda f: f(*[F.when(F.col(c) == n, k) for c in "ab" for k, n in enumerate(FEATURES)])
    names = F.array(*[F.lit(n) for n in FEATURES])
    return found.select(names[pair(F.least)].alias("a"), names[pair(F.greatest)].alias("b"), (F.round("r", 6) + 0.0).alias("r")).distinct()


@query("a32_class_balance", "SELECT class, count(*) AS count, round((SELECT count(*) FROM feat) / count(*) - 1, 6) AS weight FROM feat GROUP BY 1")
def a32(v):
    return rounded(quality.class_balance(v.feat(), "class"))


@query("m2_stratified_split", "k AS (SELECT class, row_number() OVER (PARTITION BY class ORDER BY md5('0:' || user_id || '-' || event_id)) <= ceil(count(*) OVER (PARTITION BY class) * 0.1) AS test FROM (SELECT event_type AS class, user_id, event_id FROM events)) SELECT class, count(*) FILTER (test) AS n_test, count(*) FILTER (NOT test) AS n_train FROM k GROUP BY 1")
def m2(v):
    rows = v.table("events").select(F.col("event_type").alias("class"), F.concat_ws("-", "user_id", "event_id").alias("key"))
    return model.stratified_split(rows, "class", "key", 0.1).groupBy("class").agg(F.count_if("test").alias("n_test"), F.count_if(~F.col("test")).alias("n_train"))


@query("m3_group_folds", "s AS (SELECT image, (row_number() OVER (ORDER BY count(*) DESC, image) - 1) % 3 AS fold FROM feat GROUP BY 1) SELECT image, CAST(fold AS INT) AS fold, count(*) AS n FROM feat JOIN s USING (image) GROUP BY 1, 2")
def m3(v):
    return model.group_folds(v.feat(), "image", 3).groupBy("image", "fold").agg(F.count("*").alias("n"))


@query("m3_leave_one_out", "SELECT image, CAST(dense_rank() OVER (ORDER BY image) - 1 AS INT) AS fold, count(*) AS n FROM feat GROUP BY image")
def m3_leave(v):
    return model.leave_one_out(v.feat(), "image").groupBy("image", "fold").agg(F.count("*").alias("n"))


@query("m3_stratified_folds", "k AS (SELECT class, (row_number() OVER (PARTITION BY class) - 1) % 5 AS fold FROM feat) SELECT class, CAST(fold AS INT) AS fold, count(*) AS n FROM k GROUP BY 1, 2")
def m3_stratified(v):
    return model.stratified_folds(v.feat(), "class", "row_id", 5).groupBy("class", "fold").agg(F.count("*").alias("n"))


@query("m3_folds", """k AS (SELECT row_id, row_number() OVER (ORDER BY md5('0:' || row_id), row_id) - 1 AS r, count(*) OVER () AS n FROM feat),
f AS (SELECT CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1) ELSE n % 5 + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold, row_id FROM k)
SELECT CAST(fold AS INT) AS fold, count(*) AS n, min(row_id) AS first_row FROM f GROUP BY 1""")
def m3_folds(v):
    return model.folds(v.feat(), "row_id", 5).groupBy("fold").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query("m3_shuffled_groups", """g AS (SELECT image, split, row_number() OVER (PARTITION BY split ORDER BY md5('0:' || split || ':' || image), image) <= ceil(count(*) OVER (PARTITION BY split) * 0.3) AS test
FROM (SELECT DISTINCT image FROM feat), (SELECT unnest(range(3))::INT AS split)) SELECT image, split, test, count(*) AS n FROM feat JOIN g USING (image) GROUP BY 1, 2, 3""")
def m3_shuffled(v):
    return model.shuffled_groups(v.feat(), "image", 0.3, 3).groupBy("image", "split", "test").agg(F.count("*").alias("n"))


@query("f6_scored_folds")
def f6(v):
    hit = F.avg((F.col("class") == F.col("prediction")).cast("double"))
    gap = F.avg(F.pow(F.col("class") - F.col("probability_1"), F.lit(2)))
    return rounded(model.cross_scores(v.feat(), FEATURES, "class", F.col("image") % 5, 3, {"accuracy": hit, "brier": gap}, 5))


@query("m9_recursive_elimination")
def m9_elimination(v):
    return rounded(model.recursive_elimination(model.group_folds(v.feat(), "image", 3), FEATURES, "class", 3, 2, 5))


@query("m4_cross_validation")
def m4(v):
    rows = model.group_folds(v.feat(), "image", 3)
    return rounded(quality.binary_scores(model.cross_validated(rows, FEATURES, "class", 3, 5), "class", "prediction", ["fold"]))


@query("m5_threshold_prediction", "SELECT CAST(l_discount * 10 > 0.5 AS INT) AS prediction, count(*) AS n FROM feat GROUP BY 1")
def m5(v):
    return v.feat().groupBy((F.col("l_discount") * 10 > 0.5).cast("int").alias("prediction")).agg(F.count("*").alias("n"))


@query("m1_forest")
def m1(v):
    rows = model.stratified_split(v.feat(), "class", "row_id", 0.1)
    return rounded(quality.binary_scores(model.forest_scores(rows.where("NOT test"), rows.where("test"), FEATURES, "class", 10), "class", "prediction", ["test"]))


@query("m6_principal_components")
def m6(v):
    return model.principal_components(v.feat(), FEATURES, 3).groupBy("class").agg(*[F.round(F.avg(F.abs(f"pc_{k}")), 4).alias(f"pc_{k}") for k in (1, 2, 3)])


@query("m7_variance_filter", "SELECT feature, round(variance, 4) AS variance FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([var_pop(l_quantity), var_pop(l_extendedprice), var_pop(l_discount), var_pop(l_tax)]) AS variance FROM feat) WHERE variance > 1")
def m7(v):
    return rounded(model.varied(v.feat(), FEATURES, 1.0), 4)


MI_SQL = "l AS (SELECT class, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS v FROM feat), e AS (SELECT feature, v, floor(10 * (sum(count(*)) OVER (PARTITION BY feature ORDER BY v) - count(*)) / sum(count(*)) OVER (PARTITION BY feature)) AS bin FROM l GROUP BY 1, 2), c AS (SELECT feature, bin, class, count(*) AS n FROM l JOIN e USING (feature, v) GROUP BY ALL), t AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, class) AS nc FROM c) SELECT feature, round(sum(n / nn * ln(n * nn / (nb * nc))), 6) AS mi FROM t GROUP BY 1"


@query("m7_most_informative", MI_SQL + " ORDER BY mi DESC, feature LIMIT 2")
def m7_most(v):
    return rounded(model.most_informative(v.feat(), FEATURES, "class", 2))


@query("m7_significant")
def m7_significant(v):
    """Features that tell large orders of parts from small ones."""
    return model.significant(v.feat().withColumn("large", (F.col("l_quantity") > 25).cast("int")), FEATURES, "large", "fdr", 0.05)


@query("m7_mutual_information", MI_SQL)
def m7_mi(v):
    return rounded(model.mutual_information(v.feat(), FEATURES, "class"))


@query("m8_tree_importances")
def m8(v):
    return model.tree_importances(v.feat(), FEATURES, "class")


@query("m9_shadow_votes")
def m9(v):
    return model.shadow_votes(v.feat(), FEATURES, "class", "row_id", 2)


@query("m10_oversampled")
def m10(v):
    return model.oversampled(v.feat().where("class = 1"), FEATURES, "row_id", 5)


@query("m11_best_candidates")
def m11(v):
    grid = v.feat().select("l_quantity", "l_discount").distinct()
    return rounded(model.best_candidates(v.feat(), ["l_quantity", "l_discount"], "l_extendedprice", grid, 10), 3)
