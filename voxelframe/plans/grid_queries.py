"""Queries: distances, neighbourhoods, tiles, transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.functions import draws
from voxelframe.operators import augment, grid, spatial
from voxelframe.operators.overlap import AT, colocate
from voxelframe.plans.measure_queries import rounded
from voxelframe.plans.registry import query


def values(v):
    return v.vox().select(*AT, F.col("i").alias("value"))


ESD = "p AS (SELECT z, y, x FROM seeds), esd AS (SELECT v.volume_id, v.z, v.y, v.x, sqrt(min((v.z - p.z) * (v.z - p.z) + 0.25 * (v.y - p.y) * (v.y - p.y) + 0.25 * (v.x - p.x) * (v.x - p.x))) AS distance FROM vox v, p GROUP BY 1, 2, 3, 4)"


def esd(v):
    on = v.seeds().withColumn("positive", F.lit(True))
    dense = v.vox().select(*AT).join(on, AT, "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    return spatial.empty_space_distance(dense, 1.0, 0.5, 0.5, v.vmeta())


@query("j15_empty_space_distance", f"{ESD} SELECT volume_id, z, y, x, round(distance, 6) AS distance FROM esd")
def j15(v):
    return rounded(esd(v))


@query("j16_cell_distance", f"{ESD} SELECT label, round(min(distance), 6) AS distance FROM lab JOIN esd USING (volume_id, z, y, x) GROUP BY 1")
def j16(v):
    return rounded(spatial.class_distances(v.lab(), esd(v)).drop("volume_id"))


@query("w1_empirical_cdf", "d AS (SELECT DISTINCT class_name, value, cume_dist() OVER (PARTITION BY class_name ORDER BY value) AS cdf FROM obs) SELECT class_name, value, round(cdf, 6) AS cdf FROM d")
def w1(v):
    return spatial.empirical_cdf(v.obs(), "class_name", "value").withColumn("cdf", F.round("cdf", 6))


@query("w2_cdf_on_grid", "t AS (SELECT max(i) AS top FROM vox), g AS (SELECT unnest(range(0, 500)) AS k), s AS (SELECT DISTINCT z FROM vox), n AS (SELECT z, count(*) AS n FROM vox GROUP BY 1), b AS (SELECT z, CAST(least(499, ceil(round(i / (top / 499), 9))) AS INT) AS k, count(*) AS c FROM vox, t GROUP BY 1, 2) SELECT s.z, g.k, round(g.k * (top / 499), 6) AS pos, round(coalesce((SELECT sum(c) FROM b WHERE b.z = s.z AND b.k <= g.k), 0) / n, 6) AS cdf FROM s, g, t, n WHERE n.z = s.z")
def w2(v):
    return rounded(spatial.cdf_on_grid(v.vox(), "z", "i").withColumnRenamed("at", "pos"))


@query("w3_every_nth", "d AS (SELECT class_name, value, row_number() OVER (PARTITION BY class_name ORDER BY value) - 1 AS rank, count(*) OVER (PARTITION BY class_name) AS n FROM obs WHERE value > 0) SELECT class_name, value, rank FROM d WHERE rank % CAST(pow(10, ceil(greatest(0, log10(n / 100.0)))) AS BIGINT) = 0")
def w3(v):
    return spatial.every_nth(v.obs(), "class_name", "value", 100)


TAPS_SQL = "b AS (SELECT k, w / sum(w) OVER () AS w FROM (SELECT k, CASE WHEN k = 100 THEN 1 ELSE sin(pi() * (k - 100) / 10.0) / (pi() * (k - 100) / 10.0) END * (0.54 - 0.46 * cos(2 * pi() * k / 200)) AS w FROM (SELECT unnest(range(0, 201)) AS k)))"


@query("w3_decimated", f"{TAPS_SQL}, r AS (SELECT class_name, value, row_number() OVER (PARTITION BY class_name ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY class_name) AS n FROM obs), o AS (SELECT class_name, value, r, unnest(range(greatest(0, r // 10 - 11), least((n + 9) // 10, r // 10 + 12))) AS rank FROM r) SELECT class_name, rank, round(sum(w * value), 5) AS value FROM o JOIN b ON b.k = 100 + 10 * rank - r GROUP BY 1, 2")
def w3_decimated(v):
    return rounded(spatial.decimated(v.obs(), "class_name", "value"), 5)


@query("w7_slice_context", "c AS (SELECT volume_id, z, y, x, list(i) OVER (PARTITION BY volume_id, y, x ORDER BY z ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS vals FROM vox) SELECT z, y, x, vals[1] AS before, vals[2] AS here, vals[3] AS after FROM c WHERE len(vals) = 3")
def w7(v):
    c = grid.context(values(v), 1)
    return c.select("z", "y", "x", *[F.col("values")[k].alias(n) for k, n in enumerate(("before", "here", "after"))])


@query("w8_gap_fill", "f AS (SELECT z, y, x, label FROM lab WHERE z NOT IN (4, 5, 9)), one AS (SELECT z, y, x, max(label) AS label FROM (SELECT z - 1 AS z, y, x, label FROM f UNION ALL SELECT z + 1, y, x, label FROM f) WHERE z >= 0 AND z <= (SELECT max(z) FROM vox) GROUP BY 1, 2, 3) SELECT z, y, x, coalesce(f.label, one.label) AS label FROM f FULL JOIN one USING (z, y, x)")
def w8(v):
    return grid.fill_gaps(v.lab().where("NOT z IN (4, 5, 9)"), v.vmeta(), "label").drop("volume_id")


DIAMOND = ", ".join(f"({a}, {b})" for _, a, b in grid.diamond(2))


@query("g1_dilation", f"s AS (SELECT * FROM (VALUES {DIAMOND}) t(dy, dx)) SELECT z, y + dy AS y, x + dx AS x, max(label) AS label FROM lab, s WHERE y + dy BETWEEN 0 AND 24 AND x + dx BETWEEN 0 AND 63 GROUP BY 1, 2, 3")
def g1(v):
    return grid.dilate(v.lab(), grid.diamond(2), v.vmeta()).drop("volume_id")


FOLD = "s AS (SELECT dy, dx FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)), near AS (SELECT v.z, v.y, v.x, CASE WHEN v.y + dy < 0 THEN 0 WHEN v.y + dy > 24 THEN 24 ELSE v.y + dy END AS ny, CASE WHEN v.x + dx < 0 THEN 0 WHEN v.x + dx > 63 THEN 63 ELSE v.x + dx END AS nx FROM vox v, s), r AS (SELECT near.z, near.y, near.x, i FROM near JOIN vox ON vox.z = near.z AND vox.y = ny AND vox.x = nx)"


@query("g2_box_mean", f"{FOLD} SELECT z, y, x, round(avg(i), 5) AS value FROM r GROUP BY 1, 2, 3")
def g2(v):
    return rounded(grid.box_mean(values(v), 1, sizes=v.vmeta()), 5).drop("volume_id")


@query("g2_median", f"{FOLD} SELECT z, y, x, median(i) AS value FROM r GROUP BY 1, 2, 3")
def g2_median(v):
    return grid.median_filter(values(v), 1, v.vmeta()).drop("volume_id")


def fold_sql(name: str, source: str, value: str, radius: int) -> str:
    """CTE of (z, y, x, dy, dx, v): each voxel's reflected square neighbourhood in its plane."""
    at = lambda c, n: f"CASE WHEN a.{c} + d{c} < 0 THEN -1 - a.{c} - d{c} WHEN a.{c} + d{c} >= {n} THEN 2 * {n} - 1 - a.{c} - d{c} ELSE a.{c} + d{c} END"
    steps = f"range(-{radius}, {radius + 1})"
    return f"""{name} AS (SELECT m.z, m.y, m.x, m.dy, m.dx, b.{value} AS v FROM (
      SELECT a.z, a.y, a.x, dy, dx, {at("y", 25)} AS ny, {at("x", 64)} AS nx FROM {source} a, (SELECT unnest({steps}) AS dy), (SELECT unnest({steps}) AS dx)) m
      JOIN {source} b ON b.z = m.z AND b.y = m.ny AND b.x = m.nx)"""


EDGES_SQL = f"""{fold_sql("near", "vox", "i", 2)},
g AS (SELECT k, exp(-2.0 * k * k) / (SELECT sum(exp(-2.0 * j * j)) FROM (SELECT unnest(range(-2, 3)) AS j)) AS w FROM (SELECT unnest(range(-2, 3)) AS k)),
d AS (SELECT z, y, x, sum(a.w * b.w * dy / 0.25 * v) AS dy, sum(a.w * b.w * dx / 0.25 * v) AS dx FROM near JOIN g a ON a.k = near.dy JOIN g b ON b.k = near.dx GROUP BY 1, 2, 3),
edges AS (SELECT z, y, x, sqrt(dy * dy + dx * dx) AS value FROM d)"""
CLOSING_SQL = f"{fold_sql('n1', 'vox', 'i', 1)}, m1 AS (SELECT z, y, x, max(v) AS i FROM n1 GROUP BY 1, 2, 3), {fold_sql('n2', 'm1', 'i', 1)}, closed AS (SELECT z, y, x, min(v) AS value FROM n2 GROUP BY 1, 2, 3)"
OPENING_SQL = CLOSING_SQL.replace("max(v)", "min(v)", 1).replace("min(v) AS value", "max(v) AS value").replace("closed", "opened")


GAUSS_SQL = f"""{fold_sql("near", "vox", "i", 4)},
g AS (SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * j * j)) FROM (SELECT unnest(range(-4, 5)) AS j)) AS w FROM (SELECT unnest(range(-4, 5)) AS k))
SELECT z, y, x, round(sum(a.w * b.w * v), 5) AS value FROM near JOIN g a ON a.k = near.dy JOIN g b ON b.k = near.dx GROUP BY 1, 2, 3"""


@query("g2_gaussian", GAUSS_SQL)
def g2_gaussian(v):
    return rounded(grid.gaussian_filter(values(v), 1.0, sizes=v.vmeta()), 5).drop("volume_id")


@query("g2_edges", f"{EDGES_SQL} SELECT z, y, x, round(value, 5) + 0.0 AS value FROM edges")
def g2_edges(v):
    return rounded(grid.edges(values(v), 0.5, sizes=v.vmeta()), 5).drop("volume_id")


@query("g2_closing", f"{CLOSING_SQL} SELECT * FROM closed")
def g2_closing(v):
    return grid.closing(values(v), 1).drop("volume_id")


@query("g2_opening", f"{OPENING_SQL} SELECT * FROM opened")
def g2_opening(v):
    return grid.opening(values(v), 1).drop("volume_id")


DISK = ", ".join(f"({a}, {b})" for _, a, b in grid.disk(4))


@query("g3_membrane", f"""s AS (SELECT * FROM (VALUES {DISK}) t(dy, dx)),
ring AS (SELECT DISTINCT z, y + dy AS y, x + dx AS x FROM lab, s WHERE y + dy BETWEEN 0 AND 24 AND x + dx BETWEEN 0 AND 63),
d AS (SELECT v.z, v.y, v.x, coalesce(l.label, 0) AS label FROM vox v LEFT JOIN lab l USING (z, y, x)),
own AS (SELECT DISTINCT a.z, a.y, a.x FROM d a JOIN d b ON a.z = b.z AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.label <> b.label WHERE a.label > 0)
SELECT * FROM ring ANTI JOIN lab USING (z, y, x) UNION SELECT * FROM own""")
def g3(v):
    return grid.membrane(v.lab(), v.vmeta(), known=v.vox()).drop("volume_id")


@query("j24_touching_boundaries", "SELECT DISTINCT a.z, a.y, a.x FROM lab a JOIN lab b ON a.z = b.z AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.label <> b.label")
def j24(v):
    return grid.touching_boundaries(v.lab()).drop("volume_id")


@query("g8_label_edges", "d AS (SELECT v.z, v.y, v.x, coalesce(l.label, 0) AS label FROM vox v LEFT JOIN lab l USING (z, y, x)) SELECT DISTINCT a.z, a.y, a.x FROM d a JOIN d b ON a.z = b.z AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.label <> b.label")
def g8(v):
    return grid.label_edges(v.lab(), v.vmeta(), known=v.vox()).drop("volume_id")


@query("j7_clear_dilated_blob", "s AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx)), g AS (SELECT DISTINCT z, y + dy AS y, x + dx AS x FROM lab, s WHERE label = 7) SELECT z, y, x, i FROM vox ANTI JOIN g USING (z, y, x)")
def j7(v):
    from voxelframe.operators.overlap import without_area

    blob = grid.dilate(v.lab().where("label = 7"), grid.diamond(1), v.vmeta())
    return without_area(v.vox(), blob).drop("volume_id")


def resampled_sql(nz: str, ny: str, nx: str) -> str:
    """SQL of a linear resampling of `vox` to so many slices, lines and columns."""
    axis = lambda c, n, size: f"{c}s AS (SELECT t AS t{c}, d AS d{c}, CAST(floor(p) + d AS INT) AS {c}, CASE WHEN d = 1 THEN p - floor(p) ELSE 1 - p + floor(p) END AS w{c} FROM (SELECT t, t * ({size} - 1) / ({n} - 1.0) AS p FROM (SELECT unnest(range(CAST({n} AS BIGINT))) AS t)), (SELECT unnest(range(2)) AS d))"
    size_z = "(SELECT max(z) + 1 FROM vox)"
    return f"""{axis("z", nz, size_z)}, {axis("y", ny, "25")}, {axis("x", nx, "64")}
    SELECT CAST(tz AS INT) AS z, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, round(sum(wz * wy * wx * i), 5) AS value FROM vox JOIN zs USING (z) JOIN ys USING (y) JOIN xs USING (x) WHERE wz * wy * wx > 0 GROUP BY 1, 2, 3"""


@query("g9_resample_linear", resampled_sql("(SELECT greatest(2, round((max(z) + 1) / 2.0)) FROM vox)", "25", "32"))
def g9(v):
    return rounded(grid.resample(values(v), v.vmeta(), (2.0, 0.5, 1.0)), 5).drop("volume_id")


@query("g9_resample_same", "SELECT z, y, x, CAST(i AS DOUBLE) AS value FROM vox")
def g9_same(v):
    return rounded(grid.resample(values(v), v.vmeta(), (1.0, 0.5, 0.52)), 5).drop("volume_id")


@query("g11_dihedral_round_trip", "SELECT z, y, x, i AS value, CAST(8 AS BIGINT) AS variants FROM vox")
def g11(v):
    turned = grid.dihedral(values(v), 64)
    return grid.undo_dihedral(turned, 64).groupBy("z", "y", "x", "value").agg(F.count("*").alias("variants"))


#: Quarter turns one after another, each with and without a flip; (oy, ox) is where a voxel came from.
TURNED_SQL = """q AS (SELECT 0 AS turn, z, y AS oy, x AS ox, y, x, i FROM vox UNION ALL SELECT turn + 1, z, oy, ox, 63 - x, y, i FROM q WHERE turn < 3),
t AS (SELECT turn, flip, z, oy, ox, y, CASE flip WHEN 1 THEN 63 - x ELSE x END AS x, i FROM q, (SELECT unnest([0, 1]) AS flip))"""


@query("g11_dihedral_variants", f"{TURNED_SQL} SELECT CAST(turn AS INT) AS turn, CAST(flip AS INT) AS flip, z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, i AS value FROM t")
def g11_variants(v):
    return grid.dihedral(values(v), 64).drop("volume_id")


def sampled(v):
    """Image and labels, four times over."""
    both = v.vox().join(v.lab(), AT, "left").select(*AT, "i", F.coalesce("label", F.lit(0)).alias("label"))
    return both.withColumn("sample", F.explode(F.array(*[F.lit(k) for k in range(4)])))


DRAWN = "volume_id || ':' || sample"
SAMPLED_SQL = "s AS (SELECT v.volume_id, v.z, v.y, v.x, i, coalesce(label, 0) AS label, sample FROM vox v LEFT JOIN lab l USING (volume_id, z, y, x), (SELECT unnest(range(4)) AS sample)), n AS (SELECT max(z) + 1 AS nz FROM vox)"
FLIP_SQL = f"""{SAMPLED_SQL}, d AS (SELECT *, 1 + CAST(floor({draws.unit_sql(5, "axis", DRAWN)} * 3) AS INT) AS a, {draws.unit_sql(5, "flip", DRAWN)} < 0.8 AS f FROM s, n)
SELECT CAST(sample AS INT) AS sample, CASE WHEN f AND a = 1 THEN nz - 1 - z ELSE z END AS z, CASE WHEN f AND a = 2 THEN 24 - y ELSE y END AS y, CASE WHEN f AND a = 3 THEN 63 - x ELSE x END AS x, i, label FROM d"""


@query("g11_flips", FLIP_SQL)
def g11_flips(v):
    return augment.flips(sampled(v), v.vmeta(), 5, ("volume_id", "sample"), probability=0.8).drop("volume_id")


def moved(c: str) -> str:
    return f"{c} + CASE WHEN {draws.unit_sql(9, f'along_{c}', DRAWN)} < 0.5 THEN step ELSE 0 END"


SHIFT_SQL = f"""{SAMPLED_SQL}, d AS (SELECT *, -6 + CAST(floor({draws.unit_sql(9, "shift", DRAWN)} * 13) AS INT) AS step FROM s, n),
t AS (SELECT sample, nz, {moved("z")} AS z, {moved("y")} AS y, {moved("x")} AS x, i, label FROM d),
k AS (SELECT sample, z, y, x, i, label FROM t WHERE z >= 0 AND z < nz AND y BETWEEN 0 AND 24 AND x BETWEEN 0 AND 63)
SELECT CAST(s.sample AS INT) AS sample, s.z, s.y, s.x, coalesce(k.i, 0) AS i, coalesce(k.label, 0) AS label FROM s LEFT JOIN k USING (sample, z, y, x)"""


@query("g11_shifts", SHIFT_SQL)
def g11_shifts(v):
    return augment.shifts(sampled(v), v.vmeta(), (-6, 6), 9, ["i", "label"], ("volume_id", "sample")).drop("volume_id")


@query("a40_merge_transforms", "SELECT z, y, x, CAST(i AS DOUBLE) AS value FROM vox")
def a40(v):
    return grid.merge_transforms(grid.dihedral(values(v), 64), 64).drop("volume_id")


@query("a40_merged_predictions", f"{TURNED_SQL} SELECT z, oy AS y, ox AS x, median(CAST(i + (3 * turn + 5 * flip + y + 2 * x) % 7 AS DOUBLE)) AS value FROM t GROUP BY ALL")
def a40_predictions(v):
    """Predictions that differ between the variants."""
    predicted = grid.dihedral(values(v), 64).withColumn("value", F.expr("value + (3 * turn + 5 * flip + y + 2 * x) % 7"))
    return grid.merge_transforms(predicted, 64).withColumn("value", F.col("value").cast("double")).drop("volume_id")


def tiled_sql(c: str, size: int) -> str:
    """SQL of one side's tiles of 10 with 3 reflected voxels around: the tile, the place in it and the voxel there."""
    return f"{c}t AS (SELECT tile, d, CASE WHEN p < 0 THEN -1 - p WHEN p >= {size} THEN {2 * size - 1} - p ELSE p END AS {c} FROM (SELECT tile, d, least(tile * 10, {size - 10}) + d - 3 AS p FROM (SELECT unnest(range({-(-size // 10)})) AS tile), (SELECT unnest(range(16)) AS d)))"


@query("g12_tiles", f'{tiled_sql("y", 25)}, {tiled_sql("x", 64)} SELECT z, CAST(yt.tile AS INT) AS "row", CAST(xt.tile AS INT) AS col, CAST(yt.d AS INT) AS dy, CAST(xt.d AS INT) AS dx, i AS value FROM vox JOIN yt USING (y) JOIN xt USING (x)')
def g12_tiles(v):
    return grid.tiles(values(v), v.vmeta(), 10, 3).drop("volume_id")


@query("g15_slabs", "k AS (SELECT unnest(range(max(z) // 4 + 1)) AS slab FROM vox) SELECT CAST(slab AS INT) AS slab, z, y, x, i AS value FROM vox JOIN k ON z BETWEEN 4 * slab AND 4 * slab + 4")
def g15_slabs(v):
    return grid.slabs(values(v), 5).drop("volume_id")


@query("g12_tiles_round_trip", "SELECT z, y, x, i AS value FROM vox")
def g12(v):
    return grid.stitch(grid.tiles(values(v), v.vmeta(), 10, 3), v.vmeta(), 10, 3).drop("volume_id")


@query("g15_slabs_round_trip", "SELECT z, y, x, i AS value FROM vox")
def g15(v):
    return grid.stitch_slabs(grid.slabs(values(v), 5)).drop("volume_id")


@query("g17_patches", "k AS (SELECT unnest(range(0, 40)) * 4 AS p), c AS (SELECT z, y, x, a.p AS py, b.p AS px, i FROM vox, k a, k b WHERE y BETWEEN a.p AND a.p + 7 AND x BETWEEN b.p AND b.p + 7 AND a.p + 8 <= 25 AND b.p + 8 <= 64) SELECT z, y, x, avg(i) AS value, count(*) AS covers FROM c GROUP BY 1, 2, 3")
def g17(v):
    cut = grid.patches(values(v), v.vmeta(), 8, 4)
    covers = cut.groupBy(*AT).agg(F.count("*").alias("covers"))
    return grid.merge_patches(cut).join(covers, AT).drop("volume_id")


@query("g19_pad_reflect", "g AS (SELECT z, ny, nx FROM (SELECT DISTINCT z FROM vox), (SELECT unnest(range(0, 70)) AS ny), (SELECT unnest(range(0, 70)) AS nx)), m AS (SELECT z, ny, nx, ((ny - 22) % 50 + 50) % 50 AS fy, ((nx - 3) % 128 + 128) % 128 AS fx FROM g) SELECT m.z, ny AS y, nx AS x, i AS value FROM m JOIN vox v ON v.z = m.z AND v.y = CASE WHEN fy < 25 THEN fy ELSE 49 - fy END AND v.x = CASE WHEN fx < 64 THEN fx ELSE 127 - fx END")
def g19(v):
    return grid.pad_to(values(v), v.vmeta(), 70, "reflect").drop("volume_id")


@query("g19_pad_constant", "g AS (SELECT z, ny, nx FROM (SELECT DISTINCT z FROM vox), (SELECT unnest(range(0, 70)) AS ny), (SELECT unnest(range(0, 70)) AS nx)) SELECT g.z, ny AS y, nx AS x, coalesce(i, 0) AS value FROM g LEFT JOIN vox v ON v.z = g.z AND v.y = ny - 22 AND v.x = nx - 3")
def g19_constant(v):
    return grid.pad_to(values(v), v.vmeta(), 70).drop("volume_id")


EQUAL_SQL = """t AS (SELECT z, y, x, i AS v, CAST(y // 16 AS INT) AS ty, CAST(x // 16 AS INT) AS tx FROM vox), h AS (SELECT z, ty, tx, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY z, ty, tx) AS total FROM t GROUP BY 1, 2, 3, 4),
k AS (SELECT *, least(n, greatest(1.0, total * 0.01)) AS kept FROM h),
l AS (SELECT z, ty, tx, v, (sum(kept) OVER (PARTITION BY z, ty, tx ORDER BY v) + (total - sum(kept) OVER (PARTITION BY z, ty, tx)) * (v + 1) / 256.0) / total AS level, coalesce(lead(v) OVER (PARTITION BY z, ty, tx ORDER BY v), 256) AS upto FROM k),
p AS (SELECT z, y, x, v, (y + 0.5) / 16 - 0.5 AS py, (x + 0.5) / 16 - 0.5 AS px FROM t),
q AS (SELECT z, y, x, v, CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END * CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END AS w, least(greatest(floor(py) + dy, 0), 1) AS ty, least(greatest(floor(px) + dx, 0), 3) AS tx FROM p, (SELECT unnest(range(2)) AS dy), (SELECT unnest(range(2)) AS dx)),
equalised AS (SELECT q.z, y, x, sum(w * coalesce(level, 0)) AS value FROM q LEFT JOIN l ON l.z = q.z AND l.ty = q.ty AND l.tx = q.tx AND q.v >= l.v AND q.v < l.upto GROUP BY 1, 2, 3)"""


@query("g20_equalised", f"{EQUAL_SQL} SELECT 'v0' AS volume_id, z, y, x, round(value + 1e-9, 5) AS value FROM equalised")
def g20(v):
    found = grid.equalised(values(v), v.vmeta(), 16)
    return rounded(found.withColumn("value", F.col("value") + 1e-9), 5)  # whole parts of a tile fall on halves of the last digit


@query("g21_preprocessed_channel", f"{EQUAL_SQL}, {EDGES_SQL}, {CLOSING_SQL} SELECT z, 'clahe' AS preparation, round(avg(value), 6) AS mean FROM equalised GROUP BY 1 UNION ALL SELECT z, 'edges', round(avg(value), 6) FROM edges GROUP BY 1 UNION ALL SELECT z, 'memb', round(avg(value), 6) FROM closed GROUP BY 1")
def g21(v):
    """The three preparations of a channel, by name."""
    out = None
    for name in ("clahe", "edges", "memb"):
        rows = grid.prepared(values(v), v.vmeta(), name).groupBy("z").agg(F.avg("value").alias("mean")).withColumn("preparation", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 6)


@query("s2_voxels_round_trip", "SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def s2(v):
    rows = v.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    back = rows.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("a"))
    return back.select("vec_id", F.size("a").cast("long").alias("n"), F.col("a")[0]["value"].alias("first"), F.col("a")[63]["value"].alias("last"))


@query("p30_mask_difference", "SELECT a.z, a.y, a.x FROM msk_a a JOIN msk_b b USING (volume_id, z, y, x) WHERE a.value = 255 AND b.value <> 255")
def p30(v):
    on = v.msk_a().where("value = 255")
    return on.join(v.msk_b().where("value = 255"), AT, "left_anti").select("z", "y", "x")


@query("g7_gap_filled_classes", """f AS (SELECT z, y, x FROM msk_a WHERE value = 255 AND z NOT IN (4, 5)), a AS (SELECT z, y, x FROM f UNION SELECT z - 1, y, x FROM f WHERE z > 0 UNION SELECT z + 1, y, x FROM f WHERE z < (SELECT max(z) FROM vox)),
l AS (SELECT * FROM lab WHERE z BETWEEN (SELECT min(z) FROM a) AND (SELECT max(z) FROM a)), t AS (SELECT label, count(*) AS total, count(a.z) AS n FROM l LEFT JOIN a USING (z, y, x) GROUP BY 1)
SELECT 'v0' AS volume_id, label, CASE WHEN 1.0 * n / total >= 0.5 THEN 255 ELSE 0 END AS class, round(1.0 * n / total, 6) AS fraction, n AS pixels FROM t""")
def g7(v):
    from voxelframe.operators.overlap import classes_in_annotated_slices

    filled = grid.fill_gaps(v.msk_a().where("value = 255 AND NOT z IN (4, 5)"), v.vmeta())
    return rounded(classes_in_annotated_slices(v.lab(), filled, v.vmeta()))
