"""Queries: overlaps of labels and classes, groups of cells, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import groups, overlap
from voxelframe.operators.overlap import AT
from voxelframe.plans.registry import query

#: Best overlap of l(volume_id, z, y, x, label) with r(..., label), as CTEs.
BEST = """
pairs AS (SELECT l.volume_id, l.label, r.label AS match, count(*) AS n, min((l.z * 25 + l.y) * 64 + l.x) AS first
  FROM l JOIN r USING (volume_id, z, y, x) WHERE l.label > 0 AND r.label > 0 GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, label ORDER BY n DESC, first) AS k FROM pairs) WHERE k = 1),
total AS (SELECT volume_id, label, count(*) AS total FROM l WHERE label > 0 GROUP BY ALL),
o AS (SELECT volume_id, label, match, n AS pixels, n / total AS fraction FROM best JOIN total USING (volume_id, label))
"""
#: Members of classes by a half or more of a cell's voxels.
MEMBERS = """
total AS (SELECT volume_id, label, count(*) AS total FROM lab GROUP BY ALL),
members AS (SELECT volume_id, class_name, label FROM lab JOIN masks USING (volume_id, z, y, x) JOIN total USING (volume_id, label)
  WHERE value > 128 GROUP BY volume_id, class_name, label, total HAVING count(*) / total >= 0.5)
"""
GROUPS = MEMBERS + """,
flags AS (SELECT t.volume_id, t.label, t.total, coalesce(bool_or(class_name = 'a'), false) AS a, coalesce(bool_or(class_name = 'b'), false) AS b
  FROM total t LEFT JOIN members USING (volume_id, label) GROUP BY ALL),
cube AS (SELECT 'all_cells' AS classes, * FROM flags UNION ALL SELECT 'no_class', * FROM flags WHERE NOT a AND NOT b
  UNION ALL SELECT 'a', * FROM flags WHERE a UNION ALL SELECT 'b', * FROM flags WHERE b UNION ALL SELECT 'a, b', * FROM flags WHERE a AND b)
"""


@query("j1_colocation", "SELECT volume_id, z, y, x, label, i, value FROM lab JOIN vox USING (volume_id, z, y, x) JOIN msk_a USING (volume_id, z, y, x)")
def j1(v):
    return overlap.colocate(overlap.colocate(v.lab(), v.vox()), v.msk_a())


@query("j2_label_overlap_argmax", f"l AS (SELECT * FROM lab), r AS (SELECT * FROM rlab), {BEST} SELECT volume_id, label, match, pixels, round(fraction, 6) AS fraction FROM o")
def j2(v):
    return overlap.best_overlap(v.lab(), v.rlab()).withColumn("fraction", F.round("fraction", 6))


J3 = f"l AS (SELECT * FROM lab), r AS (SELECT volume_id, z, y, x, value AS label FROM msk_a), {BEST} SELECT volume_id, t.label, CASE WHEN fraction >= 0.5 THEN match ELSE 0 END AS class, round(coalesce(fraction, 0), 6) AS fraction, coalesce(pixels, 0) AS pixels FROM total t LEFT JOIN o USING (volume_id, label)"


@query("j3_cell_class_from_areas", J3)
def j3(v):
    return overlap.classes_from_areas(v.lab(), v.msk_a(), 0.5).withColumn("fraction", F.round("fraction", 6))


@query("j4_cell_class_in_annotated_slices", J3.replace("l AS (SELECT * FROM lab)", "l AS (SELECT * FROM lab WHERE z BETWEEN 3 AND 9)").replace("FROM msk_a)", "FROM msk_a WHERE z BETWEEN 3 AND 9)"))
def j4(v):
    area = v.msk_a().where("z BETWEEN 3 AND 9")
    return overlap.classes_in_annotated_slices(v.lab(), area, v.vmeta()).withColumn("fraction", F.round("fraction", 6))


@query("j5_positive_cells", f"{MEMBERS} SELECT * FROM members")
def j5(v):
    return overlap.class_members(v.lab(), v.masks())


@query("j6_drop_labels_on_blobs", f"l AS (SELECT * FROM lab), r AS (SELECT volume_id, z, y, x, value AS label FROM msk_b), {BEST} SELECT * FROM lab WHERE label NOT IN (SELECT label FROM o WHERE match = 255 AND fraction >= 0.4)")
def j6(v):
    return overlap.without_blob_labels(v.lab(), v.msk_b().withColumnRenamed("value", "label"), 255, 0.4)


@query("j10_morphology_with_intensity", "a AS (SELECT label, count(*) AS area FROM lab GROUP BY 1), m AS (SELECT label, sum(i) AS total FROM lab JOIN vox USING (volume_id, z, y, x) GROUP BY 1) SELECT label, area, total FROM a JOIN m USING (label)")
def j10(v):
    shape = v.lab().groupBy("label").agg(F.count("*").alias("area"))
    light = overlap.colocate(v.lab(), v.vox()).groupBy("label").agg(F.sum("i").alias("total"), F.count("*").alias("area"))
    return shape.join(light.select("label", *[c for c in light.columns if c not in shape.columns]), "label")


@query("j11_class_group_column", f"{MEMBERS} SELECT t.volume_id, t.label, coalesce(string_agg(class_name, ', ' ORDER BY class_name), 'no_class') AS classes FROM total t LEFT JOIN members USING (volume_id, label) GROUP BY ALL")
def j11(v):
    return groups.exact_group(v.lab().select("volume_id", "label").distinct(), overlap.class_members(v.lab(), v.masks()))


@query("j12_attach_aggregates", f"{GROUPS}, x AS (SELECT CASE WHEN a AND b THEN 'a, b' WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'no_class' END AS classes, avg(total) AS m FROM flags GROUP BY 1 UNION ALL SELECT 'all_cells', avg(total) FROM flags) SELECT classes, count(*) AS cell_count, round(any_value(m), 6) AS mean_pixels FROM cube LEFT JOIN x USING (classes) GROUP BY 1")
def j12(v):
    members = overlap.class_members(v.lab(), v.masks())
    cells = v.lab().groupBy("volume_id", "label").agg(F.count("*").alias("pixels"))
    volume = groups.class_cube(cells, members, ["a", "b"]).groupBy("classes").agg(F.count("label").alias("cell_count"))
    means = groups.aggregate_by_group(groups.exact_group(cells, members), ["pixels"], ["mean"])
    return volume.join(means, "classes", "left").withColumn("mean_pixels", F.round("mean_pixels", 6))


@query("j13_attach_positions", f"{MEMBERS} SELECT m.class_name, m.label, round(avg(x), 6) AS position_x, round(avg(y), 6) AS position_y FROM members m LEFT JOIN lab USING (volume_id, label) GROUP BY 1, 2")
def j13(v):
    at = v.lab().groupBy("volume_id", "label").agg(F.round(F.avg("x"), 6).alias("position_x"), F.round(F.avg("y"), 6).alias("position_y"))
    return overlap.class_members(v.lab(), v.masks()).join(at, ["volume_id", "label"], "left").drop("volume_id")


@query("j14_known_cells_only", "SELECT DISTINCT label FROM lab WHERE label IN (SELECT label FROM rlab)")
def j14(v):
    return v.lab().select("label").distinct().join(v.rlab(), "label", "left_semi")


@query("a8_bounding_box", "SELECT volume_id, min(z) AS z_min, max(z) AS z_max, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max FROM seeds GROUP BY 1")
def a8(v):
    return overlap.bounding_box(v.seeds())


@query("a9_gap_test", "SELECT volume_id, count(DISTINCT z) < max(z) - min(z) + 1 AS gaps FROM seeds GROUP BY 1")
def a9(v):
    return overlap.has_gaps(v.seeds())


@query("a11_unique_labels", "SELECT count(DISTINCT label) AS cells FROM lab WHERE label > 0")
def a11(v):
    return v.lab().where("label > 0").agg(F.count_distinct("label").alias("cells"))


@query("a12_voxels_of_ids", f"{MEMBERS} SELECT class_name, count(*) AS pixels FROM lab JOIN members USING (volume_id, label) GROUP BY 1")
def a12(v):
    return v.lab().join(overlap.class_members(v.lab(), v.masks()), ["volume_id", "label"]).groupBy("class_name").agg(F.count("*").alias("pixels"))


A13 = f"""{GROUPS}, s AS (SELECT (max(z) + 1) * 25 * 64 * 0.25 AS whole FROM vox), n AS (SELECT count(*) AS n FROM total)
SELECT g.classes, count(cube.label) AS cell_count, round(count(cube.label) / whole, 9) AS density, round(coalesce(sum(total), 0) * 0.25 / whole, 6) AS ratio_of_volume,
  round(count(cube.label) / n, 6) AS ratio_of_cells, round(coalesce(sum(total), 0) * 0.25, 6) AS class_volume, round(whole, 6) AS sample_volume
FROM (SELECT unnest(['all_cells', 'no_class', 'a', 'b', 'a, b']) AS classes) g LEFT JOIN cube USING (classes), s, n GROUP BY g.classes, whole, n"""


@query("a13_volume_stats", A13)
def a13(v):
    stats = groups.volume_stats(v.lab(), overlap.class_members(v.lab(), v.masks()), ["a", "b"], v.vmeta())
    return stats.select("classes", "cell_count", F.round("density", 9).alias("density"), *[F.round(c, 6).alias(c) for c in ("ratio_of_volume", "ratio_of_cells", "class_volume", "sample_volume")])


@query("a14_cell_counts", "p AS (SELECT z, count(DISTINCT label) AS cells, count(DISTINCT CASE WHEN value = 255 THEN label END) AS positive_cells FROM lab JOIN msk_a USING (volume_id, z, y, x) GROUP BY z) SELECT s.z, coalesce(cells, 0) AS cells, coalesce(positive_cells, 0) AS positive_cells FROM (SELECT DISTINCT z FROM vox) s LEFT JOIN p USING (z) UNION ALL SELECT NULL, count(DISTINCT label), count(DISTINCT CASE WHEN value = 255 THEN label END) FROM lab JOIN msk_a USING (volume_id, z, y, x)")
def a14(v):
    positive = v.msk_a().select(*AT, (F.col("value") == 255).cast("double").alias("value"))
    return groups.cell_counts(v.lab(), v.vmeta(), positive).drop("volume_id")


@query("a15_class_cube", f"{GROUPS} SELECT classes, count(*) AS cells FROM cube GROUP BY 1")
def a15(v):
    return groups.class_cube(v.lab(), overlap.class_members(v.lab(), v.masks()), ["a", "b"]).groupBy("classes").agg(F.count("label").alias("cells"))


OBS_CLASSES = "(SELECT DISTINCT cell_id, class_name FROM obs WHERE class_name IN ('error', 'purchase'))"


@query("a16_exact_class_group", f"c AS {OBS_CLASSES} SELECT classes, count(*) AS cells FROM (SELECT o.cell_id, coalesce(string_agg(c.class_name, ', ' ORDER BY c.class_name), 'no_class') AS classes FROM (SELECT DISTINCT cell_id FROM obs) o LEFT JOIN c USING (cell_id) GROUP BY 1) GROUP BY 1")
def a16(v):
    rows = v.obs().select(F.lit("v0").alias("volume_id"), F.col("cell_id").alias("label"), "class_name")
    members = rows.where(F.col("class_name").isin("error", "purchase")).distinct()
    return groups.exact_group(rows.select("volume_id", "label").distinct(), members).groupBy("classes").agg(F.count("*").alias("cells"))


@query("a17_aggregate_by_group", f"{MEMBERS}, c AS (SELECT t.label, total AS pixels, coalesce(string_agg(class_name, ', ' ORDER BY class_name), 'no_class') AS classes FROM total t LEFT JOIN members USING (volume_id, label) GROUP BY ALL) SELECT coalesce(classes, 'all_cells') AS classes, round(avg(pixels), 6) AS mean_pixels, round(stddev_pop(pixels), 6) AS std_pixels, round(median(pixels), 6) AS median_pixels FROM c GROUP BY GROUPING SETS ((classes), ())")
def a17(v):
    cells = groups.exact_group(v.lab().groupBy("volume_id", "label").agg(F.count("*").alias("pixels")), overlap.class_members(v.lab(), v.masks()))
    rows = groups.aggregate_by_group(cells, ["pixels"], ["mean", "std", "median"])
    return rows.select("classes", *[F.round(c, 6).alias(c) for c in rows.columns if c != "classes"])


@query("u1_union", "SELECT *, 'lab' AS source FROM lab UNION ALL SELECT *, 'rlab' FROM rlab")
def u1(v):
    return v.lab().withColumn("source", F.lit("lab")).unionByName(v.rlab().withColumn("source", F.lit("rlab")))


@query("u2_in_all_classes", f"{MEMBERS} SELECT label FROM members GROUP BY label HAVING count(DISTINCT class_name) = 2")
def u2(v):
    return groups.in_all(overlap.class_members(v.lab(), v.masks()), ["a", "b"]).select("label")


@query("u3_in_no_class", f"{MEMBERS} SELECT label FROM total WHERE label NOT IN (SELECT label FROM members)")
def u3(v):
    return groups.in_none(v.lab(), overlap.class_members(v.lab(), v.masks())).select("label")


@query("u4_groups_disjoint", "SELECT count(*) AS shared FROM (SELECT image FROM feat WHERE image < 6 INTERSECT SELECT image FROM feat WHERE image >= 5)")
def u4(v):
    train, test = v.feat().where("image < 6"), v.feat().where("image >= 5")
    return train.select("image").intersect(test.select("image")).agg(F.count("*").alias("shared"))


@query("u5_volumes_equal", "SELECT count(*) AS differences FROM ((SELECT * FROM lab EXCEPT ALL SELECT * FROM rlab) UNION ALL (SELECT * FROM rlab EXCEPT ALL SELECT * FROM lab))")
def u5(v):
    return v.lab().exceptAll(v.rlab()).unionByName(v.rlab().exceptAll(v.lab())).agg(F.count("*").alias("differences"))


@query("p9_positive_class_labels", "SELECT volume_id, z, y, x, CASE WHEN value = 255 THEN label ELSE 0 END AS label FROM lab JOIN msk_a USING (volume_id, z, y, x)")
def p9(v):
    return overlap.colocate(v.lab(), v.msk_a()).select(*AT, F.when(F.col("value") == 255, F.col("label")).otherwise(0).alias("label"))


@query("p10_double_positives_removed", "SELECT volume_id, z, y, x, CASE WHEN a.value = 255 AND b.value = 255 THEN 0 ELSE a.value END AS value FROM msk_a a JOIN msk_b b USING (volume_id, z, y, x)")
def p10(v):
    both = overlap.colocate(v.msk_a(), v.msk_b().withColumnRenamed("value", "other"))
    return both.select(*AT, F.when((F.col("value") == 255) & (F.col("other") == 255), 0).otherwise(F.col("value")).alias("value"))


@query("p11_mask_domain", "SELECT class_name, count(*) FILTER (value < 0 OR value > 255) AS violations, count(*) FILTER (value > 128) AS positives FROM masks GROUP BY 1")
def p11(v):
    return v.masks().groupBy("class_name").agg(F.count_if(~F.col("value").between(0, 255)).alias("violations"), F.count_if(F.col("value") > 128).alias("positives"))


@query("a27_instance_matching", "both_ AS (SELECT l.label, r.label AS match, count(*) AS n FROM lab l JOIN rlab r USING (volume_id, z, y, x) GROUP BY 1, 2), a AS (SELECT label, count(*) AS na FROM lab GROUP BY 1), c AS (SELECT label AS match, count(*) AS nb FROM rlab GROUP BY 1), m AS (SELECT n / (na + nb - n) AS iou FROM both_ JOIN a USING (label) JOIN c USING (match) WHERE n / (na + nb - n) > 0.2), t AS (SELECT count(*) AS tp, sum(iou) AS s FROM m) SELECT tp, round(tp / (SELECT count(*) FROM c), 6) AS precision_, round(tp / (SELECT count(*) FROM a), 6) AS recall_, round(s / tp, 6) AS mean_iou FROM t")
def a27(v):
    found = overlap.one_to_one(v.lab(), v.rlab(), 0.2).agg(F.count("*").alias("tp"), F.sum("iou").alias("s"))
    sizes = v.lab().agg(F.count_distinct("label").alias("na")).join(v.rlab().agg(F.count_distinct("label").alias("nb")))  # one row each
    return found.join(sizes).select("tp", F.round(F.col("tp") / F.col("nb"), 6).alias("precision_"), F.round(F.col("tp") / F.col("na"), 6).alias("recall_"), F.round(F.col("s") / F.col("tp"), 6).alias("mean_iou"))
