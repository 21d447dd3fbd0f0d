"""Places, random transforms, cubes, rules and distributions against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import draws
from voxelframe.operators import augment, crops, grid, measure, model, rules, spatial
from voxelframe.sources import catalog

AT = ["z", "y", "x"]


def table(spark, a, name="i"):
    rows = [("v", *map(int, k), a[tuple(k)].item()) for k in np.argwhere(np.ones_like(a, bool))]
    return spark.createDataFrame(rows, f"volume_id string, z int, y int, x int, {name} {'double' if a.dtype == float else 'int'}")


def sizes(spark, shape, voxel=(1.0, 1.0, 1.0)):
    return spark.createDataFrame([("v", *shape, *voxel)], "volume_id string, size_z int, size_y int, size_x int, vz double, vy double, vx double")


def array(df, name, shape):
    out = np.full(shape, -1.0)
    rows = df.select(*AT, name).collect()
    for r in rows:
        out[r.z, r.y, r.x] = r[name]
    assert len(rows) == out.size and (out != -1).all()
    return out


def crop_rows(spark, layers):
    rows = [(k, int(y), int(x), float(a[y, x])) for k, a in enumerate(layers) for y, x in np.argwhere(np.ones_like(a, bool))]
    return spark.createDataFrame(rows, "layer int, dy int, dx int, i double")


def test_crops_are_found_again(spark):
    rng = np.random.default_rng(10)
    v = rng.random((6, 20, 20))
    part = v[3, 3:17, 4:8]
    for noise in (0.0, 0.05):
        rows = crops.localise(crop_rows(spark, [part + noise * rng.random(part.shape)]).drop("layer"), table(spark, v)).collect()
        best = min(rows, key=lambda r: r.difference)
        assert len(rows) == 6 and (best.z, best.oy, best.ox) == (3, 3, 4) and (best.difference == 0) == (noise == 0)
    assert crops.localise(crop_rows(spark, [rng.random((21, 4))]).drop("layer"), table(spark, v)).count() == 0


@pytest.mark.parametrize("slices, even", [((3, 5, 7), True), ((7, 5, 3), True), ((3, 6, 7), False), ((4,), True)])
def test_later_layers_are_found_at_the_first_ones_place(spark, slices, even):
    v = np.random.default_rng(11).random((10, 12, 14))
    rows = crops.localise_series(crop_rows(spark, [v[z, 2:9, 4:8] for z in slices]), table(spark, v)).orderBy("layer").collect()
    assert [(r.layer, r.z, r.oy, r.ox, round(r.difference, 9)) for r in rows] == [(k, z, 2, 4, 0) for k, z in enumerate(slices)]
    assert {r.arithmetic for r in rows} == {even}


def test_draws_depend_on_keys_alone(spark):
    keys = spark.range(500).withColumnRenamed("id", "crop_id")
    made = lambda df: {tuple(r) for r in crops.random_volumes(df, (4, 9, 8), 3, 9, 2, 1).collect()}
    one = made(keys)
    assert one == made(keys.repartition(7).orderBy(F.desc("crop_id"))) and len(one) == 1500
    assert {z for _, z, *_ in one} == {0, 1, 2, 3} and {y for _, _, y, *_ in one} == {0} and {r[3] for r in one} == set(range(7))
    assert one != {tuple(r) for r in crops.random_volumes(keys, (4, 9, 8), 3, 9, 2, 2).collect()}
    with pytest.raises(ValueError, match="larger"):
        crops.random_volumes(keys, (4, 9, 8), 5, 1, 1, 1)
    share = keys.agg(F.avg(draws.unit(3, "n", "crop_id")), F.min(draws.whole(F.lit(-2), F.lit(2), 3, "n", "crop_id")), F.max(draws.whole(F.lit(-2), F.lit(2), 3, "n", "crop_id"))).first()
    assert abs(share[0] - 0.5) < 0.05 and share[1:] == (-2, 2)


def test_flips_and_shifts_move_image_and_truth_alike(spark):
    a = np.random.default_rng(1).integers(0, 99, (3, 4, 5))
    v, s = table(spark, a).withColumn("truth", F.col("i") * 2), sizes(spark, a.shape)
    for k, axis in enumerate("zyx"):
        turned = augment.flips(v, s, 1, axis=axis)
        assert (array(turned, "i", a.shape) == np.flip(a, k)).all() and (array(turned, "truth", a.shape) == 2 * np.flip(a, k)).all()
    assert (array(augment.flips(v, s, 1, axis="x", probability=0.0), "i", a.shape) == a).all()
    drawn = array(augment.flips(v, s, 4), "i", a.shape)
    assert any((drawn == np.flip(a, k)).all() for k in range(3)) and (array(augment.flips(v.repartition(3), s, 4), "truth", a.shape) == 2 * drawn).all()
    for by in (-2, 0, 1, 3, 9):
        want = np.zeros_like(a)
        for z, y, x in np.argwhere(np.ones_like(a, bool)):
            if 0 <= y - by < 4 and 0 <= x - by < 5:
                want[z, y, x] = a[z, y - by, x - by]
        moved = augment.shifts(v, s, (by, by), 1, ["i", "truth"], axes="yx")
        assert (array(moved, "i", a.shape) == want).all() and (array(moved, "truth", a.shape) == 2 * want).all()


def test_cubes_of_channels_and_labels_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    a, b, labels = rng.random((4, 7, 8)), rng.random((4, 7, 8)), rng.integers(0, 4, (4, 7, 8))
    image = table(spark, a).join(table(spark, b, "j"), ["volume_id", *AT])
    got = crops.cell_cubes(table(spark, labels, "label").where("label > 0"), image, ["i", "j"], (1.0, 0.5, 0.5), 2.0, (0.5, 0.5, 0.8)).collect()
    old, new = (2, 4, 4), (4, 4, 3)
    want = {}
    for cell in (1, 2, 3):
        low = np.floor(np.argwhere(labels == cell).mean(0)).astype(int) - np.array(old) // 2
        for t in np.ndindex(*new):
            p = [k * (n - 1) / (m - 1) for k, n, m in zip(t, old, new, strict=True)]
            total = np.zeros(2)
            for d in np.ndindex(2, 2, 2):
                w = math.prod(q - math.floor(q) if e else 1 - q + math.floor(q) for q, e in zip(p, d, strict=True))
                at = tuple(low + np.floor(p).astype(int) + d)
                if w > 0 and all(0 <= c < n for c, n in zip(at, a.shape, strict=True)):
                    total += w * np.array([a[at], b[at]])
            near = tuple(low + [math.floor(q + 0.5) for q in p])
            want[cell, *t] = (*total, labels[near] if all(0 <= c < n for c, n in zip(near, a.shape, strict=True)) else 0)
    assert {(r.cell, r.z, r.y, r.x) for r in got} == set(want) and len(got) == len(want)
    assert all(np.allclose((r.i, r.j, r.label), want[r.cell, r.z, r.y, r.x]) for r in got)


def test_rules_are_data(spark):
    facts = spark.createDataFrame([(1, 5, "uint8", 0.5), (2, 9, "float", None), (3, None, None, 3.0)], "crop_id int, height int, dtype string, value double")
    own = [("tall", "height", 6.0, None, None), ("flat", "height", None, 7.0, None), ("kind", "dtype", None, None, ["uint8"]), ("range", "value", 0.0, 1.0, None), ("any", "value", None, None, None)]
    found = {(r.crop_id, r.rule, r.value) for r in rules.violations(facts, rules.rule_table(spark, own), "crop_id").collect()}
    assert found == {(1, "tall", "5"), (2, "flat", "9"), (3, "tall", None), (3, "flat", None), (2, "kind", "float"), (3, "kind", None), (2, "range", None), (3, "range", "3.0")}
    assert rules.violations(facts, rules.rule_table(spark, own).where("false"), "crop_id").count() == 0
    with pytest.raises(ValueError, match="width"):
        rules.violations(facts, rules.rule_table(spark, [("w", "width", 1.0, None, None)]), "crop_id")
    boxes = spark.createDataFrame([(1, 0, 2, 3, 4, 5, "uint8"), (1, 1, 1, 3, 6, 5, "uint8"), (2, 0, 0, 0, 1, 1, "x")], "crop_id int, z int, y int, x int, height int, width int, dtype string")
    drawn = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 1, 0, 0, 0)], "crop_id int, z int, dy int, dx int, value int")
    row = rules.annotation_facts(boxes, drawn).where("crop_id = 1").first()
    assert (row.height, row.width, row.top, row.left, row.bottom, row.right, row.value, row.annotated) == (4, 5, 1, 3, 7, 8, 2, 1)
    assert rules.annotation_facts(boxes, drawn).where("crop_id = 2").first()["annotated"] == 0


def plain_decimation(values, q):
    w, half = spatial.taps(q), 10 * q
    x = np.concatenate([np.zeros(half), np.sort(values), np.zeros(half)])
    return np.convolve(x, w, "valid")[::q]


def test_decimation_equals_a_direct_filter(spark):
    rng = np.random.default_rng(2)
    series = {"heavy": rng.pareto(1.2, 10_000), "tied": rng.integers(0, 7, 3_003).astype(float), "short": rng.random(11), "one": np.ones(1)}
    rows = spark.createDataFrame([(k, float(v)) for k, a in series.items() for v in a] + [("heavy", None), (None, 1.0)], "name string, value double").repartition(5)
    got = spatial.decimated(rows, "name", "value").collect()
    for k, a in series.items():
        found = [r.value for r in sorted((r for r in got if r.name == k), key=lambda r: r["rank"])]
        assert np.allclose(found, plain_decimation(a, 10), rtol=1e-6, atol=1e-9)
    assert len(got) == sum(-(-len(a) // 10) for a in series.values())
    down = spatial.down_sampled(rows, "name", "value", 100).collect()
    for k, a in series.items():
        while len(a) > 100:
            a = plain_decimation(a, 10)
        assert np.allclose(sorted(r.value for r in down if r.name == k), np.sort(a), rtol=1e-6, atol=1e-9)


def test_taps_are_a_low_pass():
    w = np.array(spatial.taps(10))
    assert len(w) == 201 and math.isclose(w.sum(), 1) and np.allclose(w, w[::-1])
    assert abs((w * np.cos(np.pi * 0.3 * np.arange(201))).sum()) < 0.01


def test_mutual_information_in_quantile_bins(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.pareto(1.0, 900), rng.integers(0, 3, 900).astype(float), rng.integers(0, 2, 900)
    b[c == 1] += 1
    rows = spark.createDataFrame([(float(p), float(q), int(r)) for p, q, r in zip(a, b, c, strict=True)] + [(None, 1.0, 0)], "a double, b double, c int")
    got = {r.feature: r.mi for r in model.mutual_information(rows, ["a", "b"], "c", 4).collect()}
    for name, v, y in (("a", a, c), ("b", np.append(b, 1.0), np.append(c, 0))):
        bins = np.array([np.floor(4 * (v < x).mean() + 1e-12) for x in v])
        want = sum(p * math.log(p / ((bins == i).mean() * (y == j).mean())) for i in np.unique(bins) for j in (0, 1) if (p := ((bins == i) & (y == j)).mean()))
        assert math.isclose(got[name], want, rel_tol=1e-9)
    assert got["b"] > 10 * got["a"] / 2 and [r.feature for r in model.most_informative(rows, ["a", "b"], "c", 1).collect()] == ["b"]
    assert [r.feature for r in model.significant(rows.where("a IS NOT NULL"), ["a", "b"], "c", "fdr", 0.01).collect()] == ["b"]


def test_running_sums_of_a_heavy_tail(spark):
    values = np.append(np.random.default_rng(0).pareto(0.5, 2000), 1e12)
    rows = spark.createDataFrame([("s", float(v)) for v in values] + [("t", 1.0), ("t", 1.0)], "name string, value double")
    got = {(r.name, r.value): r.cdf for r in spatial.empirical_cdf(rows, "name", "value").collect()}
    assert got["t", 1.0] == 1 and all(math.isclose(got["s", float(v)], (values <= v).mean()) for v in values)


def test_pairs_of_a_large_view_meet_in_blocks(spark):
    paths = spark.createDataFrame([("f", f"p{k:03}") for k in range(60)] + [("g", "a"), ("g", "b"), ("h", "z")], "fov string, path string")
    got = [tuple(r) for r in catalog.pairs_of_view(paths, block=7).collect()]
    assert sorted(got) == sorted([("f", f"p{a:03}", f"p{b:03}") for a in range(60) for b in range(a + 1, 60)] + [("g", "a", "b")])


def test_pairs_are_counted_without_being_made(spark):
    paths = spark.createDataFrame([("f", k % 50) for k in range(60)] + [("g", 1), ("g", 2), ("h", 5), ("h", 5), (None, 1), (None, 2), ("i", 0), ("i", 1), ("i", 2)], "fov string, path long")
    explicit = spark.createDataFrame([("i", 2, 0), ("k", 1, 1)], "fov string, a long, b long")
    for more in (None, explicit):
        want = catalog.pairs_of_view(paths, more).groupBy("fov").agg(F.count("*").alias("pairs"))
        found = catalog.count_pairs(paths, more)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    large = spark.range(400_000).select(F.lit("f").alias("fov"), F.col("id").alias("path"))  # 80 thousand million pairs
    assert catalog.count_pairs(large).first().pairs == 400_000 * 399_999 // 2


def test_colours_of_large_numbers(spark):
    row = spark.createDataFrame([(7 * 2**40 + 0x102030,)], "c long").select(catalog.rgb(F.col("c")).alias("c")).select("c.*").first()
    assert tuple(row) == (16, 32, 48)


def test_colours_of_many_parts(spark, tmp_path):
    from voxelframe import plans

    spark.createDataFrame([(300_000,), (1,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")  # 300,000 * 7919 is no int
    found = {r.p_partkey: (r.r, r.g, r.b) for r in plans.QUERIES["p19_colours"](spark, str(tmp_path)).collect()}
    assert found == {k: (k * 7919 >> 16 & 255, k * 7919 >> 8 & 255, k * 7919 & 255) for k in (300_000, 1)}


def test_eigenvectors_equal_numpys(spark):
    points = np.random.default_rng(7).integers(0, 30, (60, 3)) * [1, 2, 4]
    rows = spark.createDataFrame([("v", *map(int, p), 5) for p in points] , "volume_id string, z int, y int, x int, label int")
    size = np.array([1.0, 0.5, 0.25])
    values, vectors = np.linalg.eigh(np.cov((points * size).T, bias=True))
    got = sorted(measure.eigenvectors(rows, *size).collect(), key=lambda r: r.k)
    found = measure.morphology(rows, *size).first()
    assert np.allclose([found[f"eigenvalue_{k}"] for k in (1, 2, 3)], values) or np.allclose([found[f"eigenvalue_{k}"] for k in (3, 2, 1)], values)
    for r, v in zip(got, vectors.T, strict=True):
        assert math.isclose(abs(np.dot((r.z, r.y, r.x), v)), 1, abs_tol=1e-9) and max((r.z, r.y, r.x), key=abs) > 0


def test_resampling_keeps_labels_whole(spark):
    a = np.random.default_rng(9).integers(0, 5, (2, 5, 6))
    rows = table(spark, a.astype(float)).join(table(spark, a, "label"), ["volume_id", *AT])
    got = grid.resample(rows, sizes(spark, a.shape), (0.5, 0.5, 2.0), value="i", nearest=["label"])
    near = grid.resample(rows, sizes(spark, a.shape), (0.5, 0.5, 2.0), order=0, value="label")
    shape = (4, 10, 3)
    assert (array(got, "label", shape) == array(near, "label", shape)).all()
    with_shape = grid.resample(rows, sizes(spark, a.shape), (1.0, 1.0, 1.0), value=["i"], nearest=["label"], shape=(2, 5, 6))
    assert (array(with_shape, "i", a.shape) == a).all() and (array(with_shape, "label", a.shape) == a).all()


def test_channel_names_and_colours(spark):
    from voxelframe.sources import channels

    rows = spark.createDataFrame([(0,), (5,), (15,)], "k int").select(channels.denoising_meta(F.col("k")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in rows] == [("dapi", 8), ("pan-cytokeratin", 4), ("cd3", 1)]
    with pytest.raises(Exception, match="averaging steps"):
        spark.createDataFrame([(16,)], "k int").select(channels.denoising_meta(F.col("k"))).collect()
    code = spark.createDataFrame([(0x0A0B0CFF, 0), (-16776961, 1), (0, None)], "c long, k int")  # red, green, blue, alpha
    found = code.select(channels.rgba(F.col("c")).alias("c"), channels.marker_of(F.col("k"), channels.rgba(F.col("c")), {0: "a", 1: "b"}, {(10, 11, 12): "a", (0, 0, 0): "b"}).alias("m")).select("c.*", "m.*").collect()
    assert tuple(found[0]) == (10, 11, 12, "a", "a", False) and tuple(found[1])[:3] == (255, 0, 0) and found[1]["mismatch"] and tuple(found[2])[3:] == (None, "b", True)


def test_names_of_patients_and_frames(spark):
    names = spark.createDataFrame([("TestNewClasses S3",), ("TestNewClasses S12",)], "n string")
    assert [r[0] for r in names.select(catalog.patient(F.col("n"))).collect()] == ["3", "12"]
    assert [r[0] for r in catalog.without_named(names, "n", ["S1", "S2"]).collect()] == ["TestNewClasses S3"]
    with pytest.raises(Exception, match="no patient"):
        spark.createDataFrame([("x",)], "n string").select(catalog.patient(F.col("n"))).collect()
    frames = spark.createDataFrame([("1024 a 0.5um_dapi_stack.tif",), ("2048b_tif",), ("c 0x5um_dapi_stackd",)], "n string")
    assert [r[0] for r in frames.select(catalog.frame_name(F.col("n"))).collect()] == ["a", "b", "cd"]


def test_metrics_take_the_page_of_their_set(spark):
    from voxelframe.operators import quality

    metrics = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.9), (4, 0.1)], "frame int, f double")
    mapping = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, "b", 1), (4, "b", 2)], "frame int, name string, page int")
    slices = spark.createDataFrame([("a", 9), ("a", 4), ("a", 4), ("b", 7)], "name string, z int")
    found = quality.metrics_by_slice(metrics, mapping, slices).orderBy("z").collect()
    assert [(r.frame, r.name, r.z, r.f) for r in found] == [(2, "a", 4, 0.7), (3, "b", 7, 0.9), (1, "a", 9, 0.5)]


def test_preparations_by_name(spark):
    v, s = table(spark, np.random.default_rng(1).integers(0, 255, (1, 20, 20)), "value"), sizes(spark, (1, 20, 20))
    assert grid.prepared(v, s, "edges").count() == 400 and grid.prepared(v, s, "clahe").agg(F.max("value")).first()[0] <= 1
    with pytest.raises(ValueError, match="other"):
        grid.prepared(v, s, "other")


def test_projector_files_match_row_by_row(spark, tmp_path):
    from voxelframe.sources import channels

    features = spark.createDataFrame([("i2", "p1", 1.5), ("i1", "p2", 2.5), ("i1", "p1", 3.5)], "level_0 string, level_1 string, f double")
    labels = spark.createDataFrame([("i1", "p1", "x"), ("i2", "p1", "y"), ("i9", "p9", "z")], "level_0 string, level_1 string, label string")
    paths = channels.projector_export(features, labels, ("level_0", "level_1"), f"file://{tmp_path}/out", "a_")
    rows = spark.read.option("header", True).csv(paths[1], sep="\t")
    assert rows.columns == ["f", "label", "image", "patch"] and paths[0].endswith("a_features.tsv")
    texts = [[p.read_text().splitlines()[k:] for p in sorted((tmp_path / "out" / n).glob("part-*"))] for n, k in (("a_features.tsv", 0), ("a_metadata.tsv", 1))]
    flat = [[x for part in t for x in part] for t in texts]
    assert flat[0] == ["3.5", "2.5", "1.5"] and flat[1] == ["3.5\tx\ti1\tp1", "2.5\t\ti1\tp2", "1.5\ty\ti2\tp1"]


def test_separated_labels_touch_nothing(spark):
    from voxelframe.operators import labelling

    a = np.array([[[1, 1, 1, 2, 2, 0], [1, 1, 1, 2, 2, 0], [1, 1, 1, 2, 2, 300]]])
    rows = labelling.separated(table(spark, a, "label").where("label > 0"), sizes(spark, a.shape)).collect()
    assert {(r.y, r.x) for r in rows} == {(y, x) for y in range(3) for x in (0, 1)}


def test_resampling_makes_no_grid_from_one_row(spark):
    a = np.random.default_rng(3).integers(0, 99, (3, 4, 5))
    rows, s = table(spark, a.astype(float)), sizes(spark, a.shape)
    found = grid.resample(rows, s, (0.7, 2.0, 1.0), value="i")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(0, " not in plan  # targets are made from each voxel, not from a row of sizes, which would be broadcast
    steps = [np.linspace(0, n - 1, m) for n, m in zip(a.shape, (4, 2, 5), strict=True)]
    low = [np.minimum(np.floor(p).astype(int), n - 2) for p, n in zip(steps, a.shape, strict=True)]
    want = np.zeros((4, 2, 5))
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                w = [(p - q if d else 1 - p + q) for p, q, d in zip(steps, low, (dz, dy, dx), strict=True)]
                want += w[0][:, None, None] * w[1][None, :, None] * w[2][None, None] * a[np.ix_(low[0] + dz, low[1] + dy, low[2] + dx)]
    assert np.allclose(array(found, "i", want.shape), want)
    one = grid.resample(table(spark, a[:1, :1].astype(float)), sizes(spark, (1, 1, 5)), (0.25, 9.0, 2.0), value="i", side=lambda c: F.greatest(F.lit(1), F.floor(c)))
    assert np.allclose(array(one, "i", (4, 1, 2)), a[:1, :1, [0, 4]].repeat(4, 0))


def test_totals_of_overlaps_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(4)
    kinds = "crop_id int, z int, y int, x int, height int, width int"
    sides = [spark.createDataFrame([(k // 2 if k < 40 else k, *map(int, (z, y, x, h, w))) for k, (z, y, x, h, w) in enumerate(zip(rng.integers(0, 4, 150), rng.integers(-9, 30, 150), rng.integers(-9, 30, 150), rng.integers(0, 9, 150), rng.integers(0, 25, 150)))], kinds) for _ in range(2)]
    a, b = (c.dropDuplicates(["crop_id", "z"]) for c in sides)
    want = crops.overlaps(*sides).groupBy("z").agg(F.count("*").alias("pairs"), F.sum("area").alias("area"))
    assert sorted(map(tuple, crops.overlap_totals(*sides).collect())) == sorted(map(tuple, want.collect()))
    same = spark.createDataFrame([(900, 2, 5, 5, 6, 7)], kinds)
    for left, right in ((a, b), (a.unionByName(same), b.unionByName(same))):
        most = crops.volume_iou(left, right).groupBy("z").agg(F.round(F.max("iou"), 9), F.round(F.max("covered"), 9))
        assert sorted((r.z, round(r.iou, 9), round(r.covered, 9)) for r in crops.best_iou(left, right).collect()) == sorted(map(tuple, most.collect()))
    many = spark.range(300_000).select(F.col("id").alias("crop_id"), F.lit(0).alias("z"), (F.col("id") % 3).cast("int").alias("y"), F.lit(1).alias("x"), F.lit(4).alias("height"), F.lit(5).alias("width"))
    assert tuple(crops.overlap_totals(many, many).first()) == (0, 300_000**2, 5 * 100_000**2 * (3 * 4 + 4 * 3 + 2 * 2))
    assert tuple(crops.best_iou(many, many).first()) == (0, 1.0, 1.0)
