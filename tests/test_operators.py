"""Operators on small arrays with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import shape
from voxelframe.operators import crops, grid, groups, labelling, measure, overlap, spatial
from voxelframe.sources import catalog


def volume(spark, slices, name="label", keep_zero=False):
    rows = [("v", z, y, x, v) for z, plane in enumerate(slices) for y, line in enumerate(plane) for x, v in enumerate(line) if v or keep_zero]
    return spark.createDataFrame(rows, f"volume_id string, z int, y int, x int, {name} int")


def sizes(spark, z, y, x):
    return spark.createDataFrame([("v", z, y, x, 1.0, 1.0, 1.0)], "volume_id string, size_z int, size_y int, size_x int, vz double, vy double, vx double")


def test_best_overlap_takes_the_first_of_equal_matches(spark):
    labels = volume(spark, [[[1, 1, 1, 1], [2, 2, 2, 0]]])
    other = volume(spark, [[[5, 5, 4, 4], [0, 7, 0, 7]]])
    rows = {r.label: (r.match, r.pixels, round(r.fraction, 3)) for r in overlap.best_overlap(labels, other).collect()}
    assert rows == {1: (5, 2, 0.5), 2: (7, 1, 0.333)}


def test_cells_without_enough_area_have_class_0(spark):
    labels = volume(spark, [[[1, 1, 2, 2], [3, 3, 3, 3]]])
    areas = volume(spark, [[[9, 9, 0, 0], [8, 0, 0, 0]]], "value")
    rows = {r.label: (r["class"], r.pixels) for r in overlap.classes_from_areas(labels, areas, 0.5).collect()}
    assert rows == {1: (9, 2), 2: (0, 0), 3: (0, 1)}


def test_middle_slice_stands_in_for_annotation(spark):
    labels = volume(spark, [[[1]], [[2]], [[3]]])
    nothing = volume(spark, [], "value")
    assert [r.label for r in overlap.classes_in_annotated_slices(labels, nothing, sizes(spark, 3, 1, 1)).collect()] == [2]


def test_class_groups_overlap_and_keep_empty_ones(spark):
    cells = spark.createDataFrame([("v", 1), ("v", 2), ("v", 3)], "volume_id string, label int")
    members = spark.createDataFrame([("v", "ki67", 1), ("v", "ki67", 2)], "volume_id string, class_name string, label int")
    rows = groups.class_cube(cells, members, ["ki67", "epith"]).groupBy("classes").agg(F.count("label").alias("n")).collect()
    assert {r.classes: r.n for r in rows} == {"all_cells": 3, "no_class": 1, "ki67": 2, "epith": 0, "epith, ki67": 0}
    with pytest.raises(ValueError):
        groups.class_cube(cells, members, [])


def test_exact_groups_and_their_means(spark):
    cells = spark.createDataFrame([("v", 1, 2.0), ("v", 2, 4.0), ("v", 3, 9.0)], "volume_id string, label int, size double")
    members = spark.createDataFrame([("v", "b", 1), ("v", "a", 1), ("v", "a", 2)], "volume_id string, class_name string, label int")
    rows = groups.aggregate_by_group(groups.exact_group(cells, members), ["size"], ["mean", "std"]).collect()
    assert {r.classes: (r.mean_size, round(r.std_size, 3)) for r in rows} == {"a, b": (2.0, 0.0), "a": (4.0, 0.0), "no_class": (9.0, 0.0), "all_cells": (5.0, 2.944)}
    with pytest.raises(ValueError):
        groups.aggregate_by_group(cells, ["size"], ["mode"])


def test_cell_counts_keep_empty_slices(spark):
    labels = volume(spark, [[[1, 2]], [[2, 0]], [[0, 0]]])
    rows = groups.cell_counts(labels, sizes(spark, 3, 1, 2)).collect()
    assert {r.z: r.cells for r in rows} == {0: 2, 1: 1, 2: 0, None: 2}


def test_shape_scalars(spark):
    one = spark.range(1).select(shape.equivalent_diameter(F.lit(8)).alias("d"), shape.prolateness(F.lit(1.0), F.lit(3.0)).alias("p"), shape.oblateness(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("o"), shape.eigenvalues(*[F.lit(float(v)) for v in (2, 2, 3, 1, 0, 0)]).alias("e")).first()
    assert math.isclose(one.d, 1.24070098179, rel_tol=1e-9)
    assert math.isclose(one.p, (3**0.5 - 1) / 3**0.5) and math.isclose(one.o, 2 * (2**0.5 - 1) / (3**0.5 - 1) - 1)
    assert [round(v, 6) for v in one.e] == [1.0, 3.0, 3.0]
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(shape.prolateness(F.lit(-1.0), F.lit(3.0))).collect()


def test_empty_space_distance_is_exact(spark):
    import itertools
    import random

    random.seed(3)
    points = {p for p in itertools.product(range(3), range(5), range(6)) if random.random() < 0.08} | {(0, 0, 0)}
    rows = [("v", *p, p in points) for p in itertools.product(range(3), range(5), range(6))]
    dense = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, positive boolean")
    for r in spatial.empty_space_distance(dense, 2.0, 0.5, 1.0).collect():
        want = min(math.sqrt(4 * (r.z - a) ** 2 + 0.25 * (r.y - b) ** 2 + (r.x - c) ** 2) for a, b, c in points)
        assert math.isclose(r.distance, want, abs_tol=1e-9)
    none = spatial.empty_space_distance(dense.withColumn("positive", F.lit(False)), 1.0, 1.0, 1.0)
    assert none.where("distance IS NOT NULL").count() == 0


def test_dilation_stays_in_its_plane(spark):
    labels = volume(spark, [[[0] * 3] * 3, [[0, 0, 0], [0, 4, 0], [0, 0, 0]]])
    rows = grid.dilate(labels, grid.diamond(1), sizes(spark, 2, 3, 3)).collect()
    assert {(r.z, r.y, r.x) for r in rows} == {(1, 1, 1), (1, 0, 1), (1, 2, 1), (1, 1, 0), (1, 1, 2)}


def test_touching_boundaries_see_8_neighbours(spark):
    labels = volume(spark, [[[1, 0, 0, 0], [0, 2, 2, 0], [0, 2, 2, 0], [0, 0, 0, 3]]])
    assert {(r.y, r.x) for r in grid.touching_boundaries(labels).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_tiles_and_patches_go_back(spark):
    v = volume(spark, [[[y * 7 + x for x in range(7)] for y in range(5)]], "value", keep_zero=True)
    s = sizes(spark, 1, 5, 7)
    assert grid.stitch(grid.tiles(v, s, 3, 2), s, 3, 2).exceptAll(v).count() == 0
    merged = grid.merge_patches(grid.patches(v, s, 3, 1))
    assert merged.count() == 35 and merged.join(v.withColumnRenamed("value", "w"), grid.AT).where("value <> w").count() == 0
    assert grid.undo_dihedral(grid.dihedral(v.where("x < 5"), 5), 5).drop("turn", "flip").distinct().exceptAll(v.where("x < 5")).count() == 0


def test_gaps_are_filled_from_both_sides(spark):
    v = volume(spark, [[[3]], [[0]], [[0]], [[5]]], "value")
    assert {r.z: r.value for r in grid.fill_gaps(v, sizes(spark, 4, 1, 1)).collect()} == {0: 3, 1: 3, 2: 5, 3: 5}


def test_components_are_numbered_in_raster_order(spark):
    v = volume(spark, [[[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 1, 0]]]).drop("label")
    s = sizes(spark, 1, 3, 4)
    faces = {(r.y, r.x): r.label for r in labelling.connected_components(v, s).collect()}
    assert faces == {(0, 0): 1, (0, 1): 1, (0, 3): 2, (1, 3): 2, (2, 0): 3, (2, 2): 4}
    whole = {(r.y, r.x): r.label for r in labelling.connected_components(v, s, labelling.ALL, least_size=2).collect()}
    assert whole == {(0, 0): 1, (0, 1): 1, (0, 3): 2, (1, 3): 2, (2, 2): 2}


def test_remapping(spark):
    v = volume(spark, [[[1]], [[1]], [[2]], [[1]]])
    mapping = spark.createDataFrame([(1, 9)], "old int, new int")
    assert {r.z: r.label for r in labelling.remap_run(v, mapping, 0).collect()} == {0: 9, 1: 9, 2: 2, 3: 1}
    assert {r.z: r.label for r in labelling.remap(v, mapping, zero_unmapped=True).collect()} == {0: 9, 1: 9, 2: 0, 3: 9}


def test_crops(spark):
    kinds = "crop_id int, z int, y int, x int, height int, width int"
    a = spark.createDataFrame([(1, 0, 0, 0, 20, 20)], kinds)
    b = spark.createDataFrame([(2, 0, 10, 15, 20, 20), (3, 1, 0, 0, 5, 5), (4, 0, 20, 0, 5, 5)], kinds)
    assert [tuple(r) for r in crops.overlaps(a, b).collect()] == [(1, 2, 0, 50)]
    assert round(crops.volume_iou(a, b).first().iou, 6) == round(50 / 750, 6)
    cut = crops.restricted(b.withColumn("y", F.col("y") - 12), 1, 10, 30).collect()
    assert [(r.crop_id, r.y, r.height, r.x, r.width) for r in cut] == [(2, 0, 10, 15, 15), (4, 8, 2, 0, 5)]


def test_slices_compose_and_must_exist(spark):
    v = volume(spark, [[[k + 1]] for k in range(6)])
    twice = catalog.sliced(catalog.sliced(v, "z", [0, 3, 4, 5]), "z", [0, 1, 2])
    assert sorted(r.z for r in twice.collect()) == [0, 3, 4]
    with pytest.raises(Exception, match="no such z"):
        catalog.sliced(v, "z", [7]).collect()


def test_names(spark):
    row = spark.range(1).select(catalog.parameter(F.lit("thresh_0.4_med_3_fill_True"), "thresh").alias("t"), catalog.parameter(F.lit("a_True"), "a").alias("a"), catalog.parameter(F.lit("x"), "a").alias("n"), catalog.rgb(F.lit(0x102030)).alias("c")).first()
    assert (row.t, row.a, row.n, tuple(row.c)) == (0.4, 1.0, None, (16, 32, 48))


def test_named_pairs_and_merged_sets_are_checked(spark):
    names = lambda rows: spark.createDataFrame(rows, "dataset string, name string")
    inputs = names([("d", "img_1.tif"), ("d", "img_2.tif"), ("d", "img_3.tif")])
    good = catalog.paired(inputs, names([("d", "img_1_a.tif"), ("d", "img_2_a.tif")]), contained=True)
    assert sorted((r.input, r.annotation) for r in good.collect()) == [("img_1.tif", "img_1_a.tif"), ("img_2.tif", "img_2_a.tif"), ("img_3.tif", None)]
    with pytest.raises(Exception, match="no annotation of img_2"):
        catalog.paired(inputs, names([("d", "img_1_a.tif"), ("d", "img_9_a.tif")]), contained=True).collect()
    one, two = (spark.createDataFrame(rows, "label int, n int") for rows in ([(1, 5), (2, 6)], [(1, 7), (3, 8)]))
    assert [tuple(r) for r in catalog.merged_features({"a": one, "b": one}, ["label"]).orderBy("label").collect()] == [(1, 5, 5), (2, 6, 6)]
    with pytest.raises(Exception, match="not in every feature set"):
        catalog.merged_features({"a": one, "b": two}, ["label"]).collect()


def test_patches_must_cover_the_volume(spark):
    sizes = spark.createDataFrame([("v", 1, 2, 2)], "volume_id string, size_z int, size_y int, size_x int")
    places = [("v", 0, y, x, 1.0) for y in range(2) for x in range(2)]
    cut = spark.createDataFrame([*places, ("v", 0, 0, 0, 3.0)], "volume_id string, z int, y int, x int, value double")
    assert sorted(r.value for r in grid.merge_patches(cut, sizes=sizes).collect()) == [1.0, 1.0, 1.0, 2.0]
    with pytest.raises(Exception, match="places in no patch"):
        grid.merge_patches(cut.where("x = 0"), sizes=sizes).collect()


def test_texture_of_flat_and_single_voxels(spark):
    rows = [("v", 1, 0, 0, 0, 5), ("v", 2, 0, 5, 0, 1), ("v", 2, 0, 5, 1, 3), ("v", 3, 0, 9, 9, 0)]
    cells = spark.createDataFrame(rows, "volume_id string, label int, z int, y int, x int, g int")
    found = {r.label: r for r in measure.texture(cells, "g").collect()}
    assert set(found) == {1, 2, 3}
    assert (found[1].contrast_mean, found[1].energy_mean, found[1].correlation_mean, found[1].entropy_mean) == (0.0, 1.0, 1.0, 0.0)
    assert found[3].sum_average_mean == 2.0  # a value of 0 counts as 1
    # the pair of label 2 differs by 2 along x and, as the slice is taken twice, in both slanted directions, but not straight up
    assert (found[2].contrast_range, found[2].contrast_mean, found[2].sum_variance_range) == (4.0, 3.0, 4.0)


def test_moments_of_a_weighted_pair(spark):
    rows = spark.createDataFrame([("v", 1, 0, 0, 0, 1), ("v", 1, 0, 0, 4, 3), ("v", 2, 1, 1, 1, 0)], "volume_id string, label int, z int, y int, x int, i int")
    found = {r.label: r for r in measure.central_moments(rows, "i").collect()}
    assert abs(found[1].displacement - 1.0) < 1e-9 and abs(found[1].displacement_in_diameters - 1.0 / (12 / np.pi) ** (1 / 3)) < 1e-9
    assert abs(found[1].displacement_in_majors - 1.0 / (4 * 2.0)) < 1e-9  # the axis is four deviations long
    assert abs(found[1].moment_002 - (1 * 9 + 3 * 1) / 4 ** (2 / 3 + 1)) < 1e-9 and found[1].moment_200 == 0.0
    assert (found[2].displacement, found[2].moment_222) == (0.0, 0.0) and len(measure.POWERS) == 60


def dense(rng, *shape):
    return rng.integers(0, 9, shape).tolist()


def folded(a, k):
    """Index k of a list, folded back at its ends."""
    k %= 2 * len(a)
    return a[k] if k < len(a) else a[2 * len(a) - 1 - k]


@pytest.mark.parametrize("shape", [(2, 5, 7), (1, 1, 4), (1, 3, 1)])
def test_passes_along_lines_equal_plain_loops(spark, shape):
    a = dense(np.random.default_rng(4), *shape)
    v = volume(spark, a, "value", keep_zero=True)
    near = lambda z, y, x, r: [folded([folded(line, x + q) for line in a[z]], y + p) for p in range(-r, r + 1) for q in range(-r, r + 1)]
    at = [(z, y, x) for z in range(shape[0]) for y in range(shape[1]) for x in range(shape[2])]
    of = lambda df: {(r.z, r.y, r.x): r.value for r in df.collect()}
    mean = of(grid.box_mean(v, 2))
    assert len(mean) == len(at) and all(math.isclose(mean[k], np.mean(near(*k, 2))) for k in at)
    assert of(grid.median_filter(v, 1, sizes(spark, *shape))) == {k: np.median(near(*k, 1)) for k in at}
    line = grid.gaussian(0.8)
    r = len(line) // 2
    want = {k: sum(w * n for w, n in zip([p * q for p in line for q in line], near(*k, r), strict=True)) for k in at}
    got = of(grid.gaussian_filter(v, 0.8))
    assert all(math.isclose(got[k], want[k]) for k in at)
    largest = {k: max(near(*k, 1)) for k in at}
    bigger = [[[largest[z, y, x] for x in range(shape[2])] for y in range(shape[1])] for z in range(shape[0])]
    again = lambda z, y, x: min(folded([folded(line, x + q) for line in bigger[z]], y + p) for p in (-1, 0, 1) for q in (-1, 0, 1))
    assert of(grid.closing(v, 1)) == {k: again(*k) for k in at}
    assert of(grid.closing(v, 0)) == of(grid.opening(v, 0)) == {(z, y, x): a[z][y][x] for z, y, x in at}


def test_gap_filling_equals_repeated_passes(spark):
    rng = np.random.default_rng(8)
    a = np.where(rng.random((14, 2, 6)) < 0.25, rng.integers(1, 9, (14, 2, 6)), 0)
    a[3:6] = a[8] = a[12:] = 0
    b = a.copy()
    while not all(b[z].any() for z in range(min(np.flatnonzero(a.any((1, 2)))), max(np.flatnonzero(a.any((1, 2)))) + 1)):
        up, down = np.zeros_like(b), np.zeros_like(b)
        up[:-1], down[1:] = b[1:], b[:-1]
        b = np.where(b == 0, np.maximum(up, down), b)
    other = [("w", 3, 0, 0, 5), ("w", 4, 0, 0, 6)]  # a volume without gaps stays, whatever the others need
    rows = volume(spark, a.tolist(), "value").union(spark.createDataFrame(other, "volume_id string, z int, y int, x int, value int"))
    s = sizes(spark, 14, 2, 6).union(spark.createDataFrame([("w", 9, 1, 1, 1.0, 1.0, 1.0)], "volume_id string, size_z int, size_y int, size_x int, vz double, vy double, vx double"))
    found = grid.fill_gaps(rows, s).collect()
    assert {(r.z, r.y, r.x): r.value for r in found if r.volume_id == "v"} == {tuple(map(int, k)): int(b[tuple(k)]) for k in np.argwhere(b)}
    assert {(r.z, r.value) for r in found if r.volume_id == "w"} == {(3, 5), (4, 6)}


def test_envelopes_equal_all_pairs():
    rng = np.random.default_rng(6)
    for n, size in ((1, 1.0), (2, 0.5), (17, 0.3), (300, 2.0)):
        g = np.where(rng.random((40, n)) < 0.3, rng.integers(0, 900, (40, n)) / 4, np.inf)
        g[0], g[1] = np.inf, 0.0
        k = np.arange(n)
        want = (g[:, None, :] + ((k[:, None] - k) * size) ** 2).min(2)
        assert np.allclose(spatial._envelope(g, size), want)


def test_envelope_is_linear_in_a_line():
    """Each place of a line of 1,000 voxels costs about what one of 100 costs."""
    import time

    def seconds(n):
        g = np.random.default_rng(1).random((200, n)) * n
        began = time.perf_counter()
        spatial._envelope(g, 1.0)
        return (time.perf_counter() - began) / n

    assert min(seconds(1000) for _ in range(3)) < 4 * min(seconds(100) for _ in range(3))


def test_surfaces_of_known_shapes(spark):
    """A voxel is an octahedron; a block's faces, edges and corners are known; a ball is nearly round; every surface is closed."""
    def of(points, vz=1.0, vy=1.0, vx=1.0):
        rows = spark.createDataFrame([("v", *p, 1) for p in points], "volume_id string, z int, y int, x int, label int")
        r = measure.surface(rows, vz, vy, vx).collect()
        assert len(r) == 1
        return r[0]

    one = of([(5, 0, -3)])
    assert math.isclose(one.surface_area, math.sqrt(3)) and math.isclose(one.mesh_volume, 1 / 6)
    for a, b, c in ((4, 4, 4), (1, 6, 9), (2, 3, 5)):  # a cube, a plate, a block
        r = of([(z, y, x) for z in range(a) for y in range(b) for x in range(c)])
        d, e, f = a - 1, b - 1, c - 1  # sides between middles of voxels: flat faces, bevelled edges, corners of an octahedron
        assert math.isclose(r.surface_area, 2 * (d * e + e * f + d * f) + 4 * (d + e + f) * math.sqrt(0.5) + math.sqrt(3))
        assert math.isclose(r.mesh_volume, d * e * f + (d * e + e * f + d * f) + (d + e + f) * 0.5 + 1 / 6)
    ball = [(z, y, x) for z in range(-9, 10) for y in range(-9, 10) for x in range(-9, 10) if z * z + y * y + x * x <= 81]
    assert 0.9 < of(ball).sphericity < 1 and abs(of(ball).mesh_volume - len(ball)) < 0.02 * len(ball)
    flat = of([(z, y, x) for z in range(3) for y in range(3) for x in range(3)], 2.0, 0.5, 0.25)
    assert math.isclose(flat.mesh_volume, (8 + 12 + 3 + 1 / 6) * 0.25)


def test_surface_pieces_fit_together():
    """On each face of a cube the border is the same from both sides, so random volumes have closed surfaces."""
    from voxelframe.functions import cube

    table = {k: np.array(rest) for k, *rest in cube.pieces(1.0, 0.7, 1.3)}
    assert table[0][0] == table[255][0] == 0 and all(len(cube.loops(k)) <= 4 for k in range(256))
    rng = np.random.default_rng(2)
    a = np.zeros((9, 9, 9), int)
    a[1:-1, 1:-1, 1:-1] = rng.random((7, 7, 7)) < 0.5
    ends = {}
    total = np.zeros(3)
    for z in range(8):
        for y in range(8):
            for x in range(8):
                code = sum(int(a[z + p, y + q, x + r]) << (4 * p + 2 * q + r) for p, q, r in cube.CORNERS)
                total += table[code][1:4]
                for t in cube.triangles(code):
                    p = [tuple(2 * np.array((z, y, x)) + np.array(cube.CORNERS[cube.EDGES[e][0]]) + np.array(cube.CORNERS[cube.EDGES[e][1]])) for e in t]
                    for u, v in zip(p, p[1:] + p[:1], strict=True):
                        ends[u, v] = ends.get((u, v), 0) + 1
    assert np.allclose(total, 0) and all(ends.get((v, u), 0) == n for (u, v), n in ends.items())


def split_plainly(on, distance, apart):
    """(z, y, x) -> label: climbing, greedy spacing and numbering by loops."""
    around = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    part = {}
    for p in sorted(on):
        if p not in part:
            part[p], todo = p, [p]
            while todo:
                z, y, x = todo.pop()
                for q in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)):
                    if q in on and q not in part:
                        part[q] = part[p]
                        todo.append(q)
    rank = {p: (round(distance[p], 6), [-v for v in p]) for p in on}
    up = {p: max((q for q in ((p[0] + a, p[1] + b, p[2] + c) for a, b, c in around) if part.get(q) == part[p]), key=rank.get) for p in on}

    def peak(p):
        while up[p] != p:
            p = up[p]
        return p

    seeds, owner = [], {}
    for p in sorted((p for p in on if up[p] == p), key=rank.get, reverse=True):
        near = [q for q in seeds if part[q] == part[p] and all(abs(a - b) <= r for a, b, r in zip(p, q, apart, strict=True))]
        if near:
            owner[p] = min(near, key=lambda q: (sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), -rank[q][0], [-v for v in rank[q][1]]))
        else:
            owner[p] = p
            seeds.append(p)
    number = {q: k + 1 for k, q in enumerate(sorted(seeds))}
    return {p: number[owner[peak(p)]] for p in on}


def test_splits_by_peaks_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    on = {tuple(map(int, p)) for p in np.argwhere(rng.random((3, 9, 12)) < 0.7)}
    distance = {p: float(rng.integers(0, 30)) for p in on}
    rows = spark.createDataFrame([("v", *p, distance[p]) for p in on], "volume_id string, z int, y int, x int, distance double")
    for apart in ((0, 1, 1), (1, 3, 3), (5, 20, 20)):
        got = labelling.split_by_peaks(rows.drop("distance"), rows, sizes(spark, 3, 9, 12), apart).collect()
        assert {(r.z, r.y, r.x): r.label for r in got} == split_plainly(on, distance, apart)


def test_volumes_of_one_hash_stay_apart(spark, monkeypatch):
    """Numbers come from counts, so volumes and labels keep apart even if all hashes are equal."""
    monkeypatch.setattr(labelling, "PARTS", 1)
    v = volume(spark, [[[1, 0, 1]], [[1, 0, 0]]]).drop("label")
    both = v.union(v.withColumn("volume_id", F.lit("w"))).union(v.withColumn("volume_id", F.lit("a")))
    s = sizes(spark, 2, 1, 3)
    every = s.union(s.withColumn("volume_id", F.lit("w"))).union(s.withColumn("volume_id", F.lit("a")))
    rows = labelling.connected_components(both, every).collect()
    assert {(r.volume_id, r.z, r.x, r.label) for r in rows} == {(k, z, x, n) for k in "vwa" for z, x, n in ((0, 0, 1), (1, 0, 1), (0, 2, 2))}
    assert labelling.place(every, both).agg(F.count_distinct("id"), F.max("id")).first() == (9, 15)
    slabs = [("v", 0, 0, 0, 0, 4), ("v", 1, 0, 0, 0, 4), ("v", 1, 0, 0, 1, 9), ("v", 2, 0, 0, 1, 9), ("v", 2, 0, 5, 1, 3), ("w", 0, 0, 0, 0, 9), ("w", 1, 0, 0, 1, 4)]
    got = labelling.reconcile_slabs(spark.createDataFrame(slabs, "volume_id string, z int, y int, x int, slab int, label int")).collect()
    assert {(r.volume_id, r.z, r.x, r.label) for r in got} == {("v", 0, 0, 1), ("v", 1, 0, 1), ("v", 2, 0, 1), ("v", 2, 5, 2), ("w", 0, 0, 1), ("w", 1, 0, 2)}


def test_slabs_match_by_what_labels_have_become(spark):
    """Three of the later slab's labels: two join A and outweigh the largest alone, which joins B; A and B stay apart."""
    shared = [(1, 1)] * 3 + [(1, 2)] * 3 + [(1, 3)] * 5 + [(2, 3)] * 10
    slabs = [("v", 1, 0, x, slab, pair[slab]) for x, pair in enumerate(shared) for slab in (0, 1)]
    got = labelling.reconcile_slabs(spark.createDataFrame(slabs, "volume_id string, z int, y int, x int, slab int, label int")).collect()
    assert [r.label for r in sorted(got, key=lambda r: r.x)] == [1] * 6 + [2] * 15


def test_labels_of_one_later_object_become_one(spark):
    shared = [(1, 7)] * 3 + [(2, 7)] * 4 + [(3, 8)] * 2
    slabs = [("v", 1, 0, x, slab, pair[slab]) for x, pair in enumerate(shared) for slab in (0, 1)]
    got = labelling.reconcile_slabs(spark.createDataFrame(slabs, "volume_id string, z int, y int, x int, slab int, label int")).collect()
    assert [r.label for r in sorted(got, key=lambda r: r.x)] == [1] * 7 + [2] * 2
