"""Queries: training images, sinks and their round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.operators import crops, grid, labelling, measure, quality, training
from voxelframe.operators.overlap import AT, colocate
from voxelframe.plans.grid_queries import resampled_sql
from voxelframe.plans.measure_queries import BOTH_OF, LIT, TEXTURE_SQL, Q, moments_sql, nearest_digits, rounded
from voxelframe.plans.label_queries import cubes_sql
from voxelframe.plans.registry import query
from voxelframe.shared import new_path
from voxelframe.sources import catalog, channels


def shared(v, name):
    return new_path(v.spark, name)


@query("s19_tsv_round_trip", "SELECT label, count(*) AS area, min(z) AS first FROM lab GROUP BY 1")
def s19(v):
    path = shared(v, "tsv")
    catalog.to_tsv(v.lab().groupBy("label").agg(F.min("z").alias("first"), F.count("*").alias("area")), path, ["label"])
    return v.spark.read.schema("label int, area long, first int").option("header", True).csv(path, sep="\t")


@query("s20_series_files", "SELECT class_name AS name, count(*) AS n, round(sum(value), 4) AS total FROM obs GROUP BY 1")
def s20(v):
    path = shared(v, "series")
    training.by_folder(v.obs().select(F.col("class_name").alias("name"), "value"), path, "name", form="csv", header="false")
    return v.spark.read.schema("value double, name string").csv(path).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s22_projector_metadata", "SELECT row_id AS patch, class, image FROM feat")
def s22(v):
    return v.feat().select(F.col("row_id").alias("patch"), "class", "image")


@query("s22_projector_export", "SELECT max(l_quantity) AS l_quantity, max(l_tax) AS l_tax, max(class) AS class, image, row_id AS patch FROM feat GROUP BY image, row_id")
def s22_export(v):
    """Both files are written; the metadata is read back, with the features' file checked to have as many rows."""
    keyed = v.feat().groupBy("image", "row_id").agg(*[F.max(c).alias(c) for c in ("l_quantity", "l_tax", "class")])
    features, metadata = channels.projector_export(keyed.select("image", "row_id", "l_quantity", "l_tax"), keyed.select("image", "row_id", "class"), ("image", "row_id"), shared(v, "projector"))
    back = v.spark.read.schema("l_quantity double, l_tax double, class int, image int, patch string").option("header", True).csv(metadata, sep="\t")
    if back.count() != v.spark.read.csv(features, sep="\t").count():
        raise ValueError("features and metadata differ in rows")
    return back


@query("s25_output_names", "SELECT p_partkey, printf('sample-%d_z%d/size-%dpx', p_partkey, p_size, p_size * 2) AS path FROM part")
def s25(v):
    return v.table("part").select("p_partkey", F.format_string("sample-%d_z%d/size-%dpx", "p_partkey", "p_size", F.col("p_size") * 2).alias("path"))


@query("s25_partitioned_output", "SELECT p_partkey, p_retailprice, p_size % 5 AS sample, p_brand AS brand FROM part")
def s25_written(v):
    """Rows written below folders named by their parameters, and read back with these as columns."""
    path = shared(v, "partitioned")
    rows = v.table("part").select("p_partkey", "p_retailprice", (F.col("p_size") % 5).alias("sample"), F.col("p_brand").alias("brand"))
    rows.repartition("sample", "brand").write.partitionBy("sample", "brand").parquet(path)
    return v.spark.read.parquet(path)


@query("s26_crop_catalog_round_trip", "SELECT * FROM crops")
def s26(v):
    path = shared(v, "crops")
    v.crops().write.json(path)
    return v.spark.read.schema(v.crops().schema).json(path)


@query("s30_annotated_slices", "SELECT z, count(*) AS voxels FROM vox WHERE z BETWEEN (SELECT min(z) FROM seeds) AND (SELECT max(z) FROM seeds) GROUP BY 1")
def s30(v):
    return training.annotated_slices(v.vox(), v.seeds().withColumn("value", F.lit(1)), v.vmeta()).groupBy("z").agg(F.count("*").alias("voxels"))


@query("s31_crops_by_class", "SELECT CAST(label % 3 AS INT) AS class, count(*) AS voxels FROM lab GROUP BY 1")
def s31(v):
    path = shared(v, "classes")
    training.by_folder(v.lab().withColumn("class", F.col("label") % 3), path, "class")
    return v.spark.read.parquet(path).groupBy("class").agg(F.count("*").alias("voxels"))


@query("p2_channel_pick", "SELECT z, y, CAST(x // 3 AS INT) AS x, i FROM vox WHERE x % 3 = 1")
def p2(v):
    return v.vox().where("x % 3 = 1").select("z", "y", F.expr("int(x div 3)").alias("x"), "i")


@query("p3_channel_maximum", "SELECT z, y, CAST(x // 3 AS INT) AS x, max(i) AS i FROM vox GROUP BY 1, 2, 3")
def p3(v):
    return v.vox().groupBy("z", "y", F.expr("int(x div 3)").alias("x")).agg(F.max("i").alias("i"))


@query("p14_object_probability", "SELECT z, y, x, round(i / 255.0 * (1 - b % 10 / 10.0), 6) AS p FROM vox")
def p14(v):
    return v.vox().select("z", "y", "x", F.round(training.object_probability(F.col("i") / 255.0, v._block() % 10 / 10.0), 6).alias("p"))


@query("p15_certain_rows", "SELECT row_id FROM feat WHERE class <= 1 AND l_quantity >= 5")
def p15(v):
    return training.certain(v.feat(), "class", "l_quantity").select("row_id")


@query("p18_channel_markers", "SELECT l_linenumber, ['dapi', 'ki67', 'epith', 'none'][l_linenumber % 4 + 1] AS marker, count(*) AS n FROM lineitem GROUP BY 1, 2")
def p18(v):
    names = F.create_map(*[F.lit(x) for k, n in enumerate(("dapi", "ki67", "epith", "none")) for x in (k, n)])
    return v.table("lineitem").select("l_linenumber", names[F.col("l_linenumber") % 4].alias("marker")).groupBy("l_linenumber", "marker").agg(F.count("*").alias("n"))


@query("p24_frame_names", "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g'), '_+$', '') AS frame FROM part")
def p24(v):
    return v.table("part").select("p_partkey", F.regexp_replace(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_"), "_+$", "").alias("frame"))


@query("p29_label_arithmetic", "SELECT CAST(label % 256 AS INT) AS small, count(*) AS n FROM lab GROUP BY 1")
def p29(v):
    return v.lab().groupBy((F.col("label") % 256).alias("small")).agg(F.count("*").alias("n"))


EDGES = "d AS (SELECT v.z, v.y, v.x, coalesce(l.label, 0) AS label FROM vox v LEFT JOIN lab l USING (z, y, x)), e AS (SELECT DISTINCT a.z, a.y, a.x FROM d a JOIN d c ON a.z = c.z AND abs(a.y - c.y) + abs(a.x - c.x) = 1 AND a.label <> c.label)"


@query("p29_separated_labels", f"{EDGES} SELECT z, y, x, label, CAST(label % 256 AS INT) AS small, 1 AS lit FROM d ANTI JOIN e USING (z, y, x) WHERE label > 0")
def p29_separated(v):
    apart = labelling.separated(v.lab(), v.vmeta(), v.vox())
    return apart.select("z", "y", "x", "label", labelling.to_8bit(F.col("label")).alias("small"), labelling.to_binary(F.col("label")).alias("lit"))


@query("p31_training_channels", f"{EDGES} SELECT count(*) FILTER (e.z IS NOT NULL) AS boundary, count(*) FILTER (e.z IS NULL AND label > 0) AS object FROM d LEFT JOIN e USING (z, y, x)")
def p31(v):
    return training.with_channels(v.lab(), v.vmeta(), known=v.vox()).agg(F.count_if(F.col("boundary") > 0).alias("boundary"), F.count_if(F.col("object") > 0).alias("object"))


@query("p31_blobs_removed", "SELECT z, y, x, CASE WHEN label = 7 THEN 0 ELSE i END AS i, CASE WHEN label = 7 THEN 0 ELSE label END AS label FROM lab JOIN vox USING (volume_id, z, y, x)")
def p31_blobs(v):
    return training.without_blobs(colocate(v.lab(), v.vox()), 7).drop("volume_id")


@query("p32_three_classes", f"{EDGES} SELECT CAST(sum(CASE WHEN e.z IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS edge, CAST(sum(CASE WHEN e.z IS NULL AND label > 0 THEN 1 ELSE 0 END) AS BIGINT) AS interior FROM d LEFT JOIN e USING (z, y, x)")
def p32(v):
    return training.three_classes(training.with_channels(v.lab(), v.vmeta(), known=v.vox())).agg(F.sum("edge").alias("edge"), F.sum("interior").alias("interior"))


@query("p33_normalised_truth", "t AS (SELECT z, y, x, CASE WHEN value = 255 THEN 255 ELSE 0 END AS value FROM msk_a) SELECT z, y, x, value / 255.0 AS value FROM t")
def p33(v):
    return training.normalised(v.msk_a().withColumn("value", F.when(F.col("value") == 255, 255).otherwise(0)), ["volume_id", "z"], "value").drop("volume_id")


@query("p35_noise")
def p35(v):
    return rounded(training.noisy(v.vox().select(*AT, (F.col("i") / 255.0).alias("value")), "value", 0.1, 3))


@query("p36_feature_columns", "SELECT row_id, l_discount, l_tax FROM feat")
def p36(v):
    names = catalog.feature_columns(v.feat().columns, ["_tax", "_discount"], ["l"])
    return v.feat().select("row_id", *names)


@query("p37_step_count", "SELECT CAST(sum(n - 2) AS BIGINT) AS steps FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def p37(v):
    return training.steps(v.table("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("pages")), 3)


J9_SQL = """
c AS (SELECT image, row_id, max(class) AS class FROM feat WHERE l_tax < 0.06 GROUP BY 1, 2), f AS (SELECT image, row_id, sum(l_quantity) AS quantity, max(l_discount) AS discount FROM feat GROUP BY 1, 2)
SELECT image, row_id, class, quantity, discount FROM c JOIN f USING (image, row_id)"""


@query("j9_class_with_features", J9_SQL)
def j9(v):
    """Annotated rows' classes with the features that another table has of them, by image and row."""
    key = ["image", "row_id"]
    classes = v.feat().where("l_tax < 0.06").groupBy(*key).agg(F.max("class").alias("class"))
    features = v.feat().groupBy(*key).agg(F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"))
    return classes.join(features, key)


@query("j21_metrics_with_slices", "SELECT a.image, round(avg(l_discount), 6) AS score, n FROM feat a JOIN (SELECT z AS image, count(*) AS n FROM vox GROUP BY 1) s USING (image) GROUP BY 1, n")
def j21(v):
    slices = v.vox().groupBy(F.col("z").alias("image")).agg(F.count("*").alias("n"))
    return rounded(v.feat().groupBy("image").agg(F.avg("l_discount").alias("score")).join(slices, "image"))


METRICS_SQL = """m AS (SELECT l_suppkey AS frame, avg(l_discount) AS score FROM lineitem GROUP BY 1), a AS (SELECT 'set' || (crop_id % 7) AS name, z, dense_rank() OVER (PARTITION BY crop_id % 7 ORDER BY z) AS page FROM (SELECT DISTINCT crop_id % 7 AS crop_id, z FROM crops)),
k AS (SELECT s_suppkey AS frame, 'set' || (s_suppkey % 7) AS name, 1 + s_suppkey % 3 AS page FROM supplier)
SELECT frame, name, z, round(score, 6) AS score FROM m JOIN k USING (frame) JOIN a USING (name, page)"""


@query("j21_metrics_by_annotated_slice", METRICS_SQL)
def j21_slices(v):
    metrics = v.table("lineitem").groupBy(F.col("l_suppkey").alias("frame")).agg(F.avg("l_discount").alias("score"))
    name = lambda c: F.concat(F.lit("set"), (F.col(c) % 7).cast("string")).alias("name")
    mapping = v.table("supplier").select(F.col("s_suppkey").alias("frame"), name("s_suppkey"), (1 + F.col("s_suppkey") % 3).cast("int").alias("page"))
    return rounded(quality.metrics_by_slice(metrics, mapping, v.crops().select(name("crop_id"), "z")))


@query("g10_resize_in_plane", resampled_sql("(SELECT max(z) + 1 FROM vox)", "12", "32"))
def g10(v):
    return rounded(grid.resize_in_plane(v.vox().select(*AT, F.col("i").alias("value")), v.vmeta(), 1.0), 5).drop("volume_id")


G23_SQL = f"""{LIT}, {TEXTURE_SQL.replace("1 + i // 16", "greatest(1, i // 16)")}, m AS ({moments_sql("c", "light_")}),
q AS (SELECT label, quantile_cont(i, 0.25) AS p25, median(i) AS m, quantile_cont(i, 0.75) AS p75 FROM c GROUP BY 1),
r AS (SELECT label, round(any_value(p25), 6) AS light_p25, round(any_value(m), 6) AS light_median, round(any_value(p75), 6) AS light_p75, round(median(abs(i - m)), 6) AS light_mad FROM c JOIN q USING (label) GROUP BY 1),
s AS (SELECT label, count(*) AS area, round(avg(i), 6) AS light_mean, round(stddev_pop(i), 6) AS light_std, {Q.replace("AS percentile", "AS light_percentile")} FROM c GROUP BY 1),
x AS (SELECT label, {", ".join(f"round({f}, 5) + 0.0 AS light_{c}_{k}" for c, k, f in BOTH_OF)} FROM st GROUP BY 1)
SELECT s.*, r.* EXCLUDE (label), m.* EXCLUDE (label), x.* EXCLUDE (label) FROM s JOIN r USING (label) JOIN m USING (label) JOIN x USING (label)"""


@query("g23_all_features", G23_SQL)
def g23(v):
    found = measure.all_features(v.lab(), {"light": v.vox()}, grey=16).drop("volume_id", "second_ratio", "first_ratio", "light_displacement_in_majors")
    textures = {f"light_{c}_{k}" for c, k, _ in BOTH_OF}
    return found.select([(nearest_digits(c, 5) if c in textures else F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query("g5_resampled_cubes", f"{cubes_sql('vox', {'value': 'i'}, (4, 4, 4), (8, 4, 4), False)} SELECT CAST(cell AS VARCHAR) AS volume_id, z, y, x, round(value, 5) AS value FROM cubes")
def g5_resampled(v):
    centres = v.lab().groupBy(F.col("label").alias("crop_id")).agg(*[F.avg(c).alias(c) for c in "zyx"])
    cubes = crops.cut(crops.centred(centres, 4, 4, 4), v.vox(), pad=True)
    low = cubes.groupBy("crop_id").agg(F.min("z").alias("z0"))
    rows = cubes.join(low, "crop_id").select(F.col("crop_id").cast("string").alias("volume_id"), (F.col("z") - F.col("z0")).alias("z"), F.col("dy").alias("y"), F.col("dx").alias("x"), F.col("i").alias("value"))
    sizes = rows.select("volume_id").distinct().select("volume_id", *[F.lit(4).alias(f"size_{c}") for c in "zyx"], F.lit(1.0).alias("vz"), F.lit(0.5).alias("vy"), F.lit(0.5).alias("vx"))
    return rounded(grid.resample(rows, sizes, (0.5, 0.5, 0.5)), 5)
