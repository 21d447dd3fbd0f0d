"""Queries: measurements of cells, histograms, texture."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelframe.functions import cube, shape
from voxelframe.operators import measure
from voxelframe.operators.overlap import colocate
from voxelframe.plans.registry import query


def rounded(df, digits=6, keep=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def nearest_digits(c, digits):
    """A double rounded as SQL's engine does: the nearest whole number of the product, halves away from zero. F.round goes by the decimal text instead."""
    product = F.col(c) * float(10**digits)
    return F.signum(product) * F.floor(F.abs(product) + 0.5) / float(10**digits) + 0.0


def lit_cells(v):
    return colocate(v.lab(), v.vox())


LIT = "c AS (SELECT volume_id, label, z, y, x, i FROM lab JOIN vox USING (volume_id, z, y, x))"
Q = ", ".join(f"round(quantile_cont(i, {p / 100}), 6) AS percentile_{p}" for p in range(10, 100, 10))


@query("a1_cell_intensity", f"{LIT} SELECT label, round(avg(i), 6) AS mean, round(stddev_pop(i), 6) AS std, {Q} FROM c GROUP BY 1")
def a1(v):
    return rounded(measure.intensity_stats(lit_cells(v), ["label"], "i"))


@query("a2_marker_frame", "SELECT cell_id, " + ", ".join(f"round(avg(value) FILTER (class_name = '{m}'), 6) AS {m}_mean, round(stddev_pop(value) FILTER (class_name = '{m}'), 6) AS {m}_std" for m in ("click", "purchase", "view", "error")) + " FROM obs GROUP BY 1")
def a2(v):
    return rounded(measure.marker_frame(v.obs(), ["cell_id"], "class_name", "value", ["click", "purchase", "view", "error"]))


@query("a3_robust_intensity", f"{LIT}, q AS (SELECT label, quantile_cont(i, 0.25) AS p25, median(i) AS m, quantile_cont(i, 0.75) AS p75 FROM c GROUP BY 1) SELECT label, round(p25, 6) AS p25, round(m, 6) AS median, round(p75, 6) AS p75, round(median(abs(i - m)), 6) AS mad FROM c JOIN q USING (label) GROUP BY label, p25, m, p75")
def a3(v):
    return rounded(measure.robust_stats(lit_cells(v), ["label"], "i"))


@query("a4_region_basics", "SELECT volume_id, label, count(*) AS area, " + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, round(avg({c}), 6) AS {c}_mean" for c in "zyx") + ", max(z) - min(z) + 1 AS size_z FROM lab GROUP BY 1, 2")
def a4(v):
    return rounded(measure.region_basics(v.lab()))


#: Traces are invariants of the eigenvalues that SQL can give.
@query("a5_morphology", "m AS (SELECT label, count(*) * 0.25 AS volume, avg(z) AS position_z, avg(y) * 0.5 AS position_y, avg(x) * 0.5 AS position_x, var_pop(z) + var_pop(y) * 0.25 + var_pop(x) * 0.25 AS trace, var_pop(z) AS zz, 0.25 * var_pop(y) AS yy, 0.25 * var_pop(x) AS xx, 0.5 * covar_pop(z, y) AS zy, 0.5 * covar_pop(z, x) AS zx, 0.25 * covar_pop(y, x) AS yx FROM lab GROUP BY 1) SELECT label, volume, round(position_z, 6) AS position_z, round(position_y, 6) AS position_y, round(position_x, 6) AS position_x, round(trace, 6) AS trace, round(zz * (yy * xx - yx * yx) - zy * (zy * xx - yx * zx) + zx * (zy * yx - yy * zx), 4) AS determinant, round(pow(0.75 * volume / pi(), 1.0 / 3), 6) AS equivalent_diameter FROM m")
def a5(v):
    m = measure.morphology(v.lab(), 1.0, 0.5, 0.5)
    e = [F.col(f"eigenvalue_{k}") for k in (1, 2, 3)]
    return m.select("label", "volume", *[F.round(f"position_{c}", 6).alias(f"position_{c}") for c in "zyx"], F.round(e[0] + e[1] + e[2], 6).alias("trace"), F.round(e[0] * e[1] * e[2], 4).alias("determinant"), F.round("equivalent_diameter", 6).alias("equivalent_diameter"))


def eigen_sql(z: float, y: float, x: float) -> str:
    """CTEs up to `eig`(label, n, l1, l2, l3): ascending eigenvalues of each cell's covariance, in closed form."""
    return f"""mm AS (SELECT label, count(*) AS n, {z * z}::DOUBLE * var_pop(z) AS zz, {y * y}::DOUBLE * var_pop(y) AS yy, {x * x}::DOUBLE * var_pop(x) AS xx, {z * y}::DOUBLE * covar_pop(z, y) AS zy, {z * x}::DOUBLE * covar_pop(z, x) AS zx, {y * x}::DOUBLE * covar_pop(y, x) AS yx FROM lab GROUP BY 1),
    mq AS (SELECT *, (xx + yy + zz) / 3 AS q FROM mm), mp AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (yx * yx + zx * zx + zy * zy)) / 6) AS p FROM mq),
    mr AS (SELECT *, acos(greatest(-1, least(1, (((xx - q) * ((yy - q) * (zz - q) - zy * zy) - yx * (yx * (zz - q) - zy * zx) + zx * (yx * zy - (yy - q) * zx)) / 2) / pow(p, 3)))) / 3 AS angle FROM mp),
    eig AS (SELECT label, n, q + 2 * p * cos(angle + 2 * pi() / 3) AS l1, q - 2 * p * cos(angle) - 2 * p * cos(angle + 2 * pi() / 3) AS l2, q + 2 * p * cos(angle) AS l3 FROM mr)"""


@query("a5_eigenvalues", f"{eigen_sql(1.0, 0.5, 0.5)} SELECT label, round(l1, 6) AS eigenvalue_1, round(l2, 6) AS eigenvalue_2, round(l3, 6) AS eigenvalue_3, round((sqrt(l3) - sqrt(l1)) / sqrt(l3), 6) AS prolateness, round(2 * (sqrt(l2) - sqrt(l1)) / (sqrt(l3) - sqrt(l1)) - 1, 6) AS oblateness FROM eig")
def a5_values(v):
    return rounded(measure.morphology(v.lab(), 1.0, 0.5, 0.5)).select("label", "eigenvalue_1", "eigenvalue_2", "eigenvalue_3", "prolateness", "oblateness")


@query("p28_principal_ratios", f"{eigen_sql(1.0, 1.0, 1.0)} SELECT label, round(sqrt(1 - l2 / l3), 6) AS first_ratio, round(sqrt(1 - l1 / l2), 6) AS second_ratio, round(4 * sqrt(l3) * 0.5, 6) AS major_length FROM eig")
def p28_principal(v):
    return rounded(measure.morphology(v.lab(), 1.0, 1.0, 1.0)).select("label", "first_ratio", "second_ratio", "major_length")


@query("a5_eigenvectors")
def a5_vectors(v):
    return measure.eigenvectors(v.lab(), 1.0, 0.5, 0.5)


PIECES = ", ".join(f"({k}, {', '.join(f'{v!r}::DOUBLE' for v in row)})" for k, *row in cube.pieces(1.0, 0.5, 0.5))
CORNERS = ", ".join(f"({a}, {b}, {c}, {1 << (4 * a + 2 * b + c)})" for a, b, c in cube.CORNERS)


@query("a6_surface", f"""t AS (SELECT * FROM (VALUES {PIECES}) t(code, area, nz, ny, nx, moment)), k AS (SELECT * FROM (VALUES {CORNERS}) k(dz, dy, dx, bit)),
c AS (SELECT label, z - dz AS z, y - dy AS y, x - dx AS x, sum(bit) AS code FROM lab, k GROUP BY ALL),
m AS (SELECT label, sum(area) AS a, sum(z * nz + 0.5 * y * ny + 0.5 * x * nx + moment) / 3 AS v FROM c JOIN t USING (code) GROUP BY 1)
SELECT label, round(a, 6) AS surface_area, round(v, 6) AS mesh_volume, round(pow(36 * pi() * v * v, 1.0 / 3) / a, 6) AS sphericity FROM m""")
def a6(v):
    return rounded(measure.surface(v.lab(), 1.0, 0.5, 0.5)).drop("volume_id")


def moments_sql(source: str, prefix: str = "") -> str:
    """SQL of central_moments() over source(label, z, y, x, i), without the distance in major axes."""
    terms = ", ".join(
        f"round(sum(i * pow(z - wz, {p}) * pow(y - wy, {q}) * pow(x - wx, {r})) / pow(w, {p + q + r} / 3.0 + 1), 6) + 0.0 AS {prefix}moment_{p}{q}{r}"
        for p, q, r in measure.POWERS
    )
    return f"""SELECT label, round(max(away), 6) AS {prefix}displacement, round(max(away / pow(6 * k / pi(), 1.0 / 3)), 6) AS {prefix}displacement_in_diameters, {terms}
    FROM (SELECT *, sqrt(pow(wz - cz, 2) + pow(wy - cy, 2) + pow(wx - cx, 2)) AS away FROM {source} JOIN (
      SELECT label, sum(i) AS w, count(*) AS k, sum(i * z) / sum(i) AS wz, sum(i * y) / sum(i) AS wy, sum(i * x) / sum(i) AS wx, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx
      FROM {source} GROUP BY 1) USING (label)) GROUP BY label, w"""


@query("a7_weighted_moments", f"{LIT} {moments_sql('c')}")
def a7(v):
    found = measure.central_moments(lit_cells(v), "i").drop("volume_id", "displacement_in_majors")
    return found.select([(F.round(c, 6) + 0.0).alias(c) if c != "label" else F.col(c) for c in found.columns])


STEPS = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(measure.DIRECTIONS))
TEXTURE_SQL = f"""
g AS (SELECT label, z, y, x, 1 + i // 16 AS g FROM c),
flat AS (SELECT label FROM g GROUP BY 1 HAVING min(z) = max(z)),
g2 AS (SELECT * FROM g UNION ALL SELECT label, z + 1, y, x, g FROM g JOIN flat USING (label)),
steps AS (SELECT * FROM (VALUES {STEPS}) t(d, dz, dy, dx)),
one AS (SELECT a.label, d, a.g AS a, b.g AS b FROM g2 a, steps, g2 b WHERE b.label = a.label AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
j AS (SELECT label, d, a, b, count(*) AS n FROM (SELECT * FROM one UNION ALL SELECT label, d, b, a FROM one) GROUP BY ALL),
j1 AS (SELECT label, d, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n * n) AS DOUBLE) AS nn, CAST(sum(n * a * a) AS DOUBLE) AS aa, CAST(sum(n * a * b) AS DOUBLE) AS ab,
  CAST(sum(n * a) AS DOUBLE) AS a1, CAST(sum(n * abs(a - b)) AS DOUBLE) AS d1, CAST(sum(n * (a - b) * (a - b)) AS DOUBLE) AS apart, CAST(sum(n * (a + b) * (a + b)) AS DOUBLE) AS added, sum(n * log2(n)) AS l_joint FROM j GROUP BY 1, 2),
j2 AS (SELECT label, d, sum(n * log2(n)) AS l_sum FROM (SELECT label, d, a + b AS k, sum(n) AS n FROM j GROUP BY ALL) GROUP BY 1, 2),
j3 AS (SELECT label, d, sum(n * log2(n)) AS l_difference, sum(n / (1.0 + k * k)) AS near FROM (SELECT label, d, abs(a - b) AS k, sum(n) AS n FROM j GROUP BY ALL) GROUP BY 1, 2),
j4 AS (SELECT label, d, sum(n * log2(n)) AS l_margin FROM (SELECT label, d, a AS k, sum(n) AS n FROM j GROUP BY ALL) GROUP BY 1, 2),
e AS (SELECT *, a1 / n AS mean, aa / n - (a1 / n) * (a1 / n) AS spread, apart / n AS contrast, log2(n) - l_joint / n AS entropy, log2(n) - l_margin / n AS margin
  FROM j1 JOIN j2 USING (label, d) JOIN j3 USING (label, d) JOIN j4 USING (label, d)),
st AS (SELECT label, nn / (n * n) AS energy, contrast, CASE WHEN spread <= 0 THEN 1.0 ELSE (ab / n - mean * mean) / spread END AS correlation, spread AS variance, near / n AS homogeneity,
  2 * mean AS sum_average, added / n - 4 * mean * mean AS sum_variance, log2(n) - l_sum / n AS sum_entropy, entropy, contrast - (d1 / n) * (d1 / n) AS difference_variance,
  log2(n) - l_difference / n AS difference_entropy, CASE WHEN margin = 0 THEN 0.0 ELSE (entropy - 2 * margin) / margin END AS information_1, sqrt(greatest(0.0, 1 - exp(-2 * (2 * margin - entropy)))) AS information_2 FROM e)"""
BOTH_OF = [(c, k, f) for c in measure.STATISTICS for k, f in (("mean", f"avg({c})"), ("range", f"max({c}) - min({c})"))]


@query("a7_displacement_in_majors", f"{eigen_sql(1.0, 1.0, 1.0)}, {LIT}, d AS (SELECT label, sqrt(pow(sum(i * z) / sum(i) - avg(z), 2) + pow(sum(i * y) / sum(i) - avg(y), 2) + pow(sum(i * x) / sum(i) - avg(x), 2)) AS away FROM c GROUP BY 1) SELECT label, round(away / (4 * sqrt(l3)), 6) AS displacement_in_majors FROM d JOIN eig USING (label)")
def a7_majors(v):
    return rounded(measure.central_moments(lit_cells(v), "i")).select("label", "displacement_in_majors")


@query("a10_texture", f"{LIT}, {TEXTURE_SQL} SELECT label, " + ", ".join(f"round({f}, 5) + 0.0 AS {c}_{k}" for c, k, f in BOTH_OF) + " FROM st GROUP BY 1")
def a10(v):
    t = measure.texture(lit_cells(v).withColumn("g", F.expr("1 + i div 16")), "g")
    return t.select("label", *[nearest_digits(f"{c}_{k}", 5).alias(f"{c}_{k}") for c, k, _ in BOTH_OF])


@query("a18_histogram", "e AS (SELECT min(i) AS low, max(i) AS high FROM vox) SELECT CAST(least(255, floor((i - low) * 256 / (high - low))) AS INT) AS bin, low, high, count(*) AS count FROM vox, e GROUP BY 1, 2, 3")
def a18(v):
    return measure.histogram(v.vox(), "i", 256)


@query("a19_slice_histograms", "SELECT z, CAST(i // 8 AS INT) AS bin, count(*) AS count FROM vox GROUP BY 1, 2")
def a19(v):
    return measure.fixed_histogram(v.vox(), "i", 8, ["z"])


OTSU = """v AS (SELECT i AS value, count(*) AS n FROM vox {where} GROUP BY 1), k AS (SELECT value, sum(n) OVER (ORDER BY value) AS n, sum(value * n) OVER (ORDER BY value) AS s, sum(n) OVER () AS nn, sum(value * n) OVER () AS ss FROM v)
SELECT value AS threshold FROM k WHERE n < nn ORDER BY round(CAST(n AS DOUBLE) * CAST(nn - n AS DOUBLE) * pow(s / n - (ss - s) / (nn - n), 2), 3) DESC, value LIMIT 1"""


@query("a20_otsu_threshold", OTSU.format(where=""))
def a20(v):
    counts = v.vox().groupBy("volume_id", F.col("i").alias("value")).agg(F.count("*").alias("count"))
    return measure.otsu(counts, ["volume_id"]).select("threshold")


LEVELS_SQL = """
v AS (SELECT i AS value, count(*) AS n FROM vox GROUP BY 1),
k AS (SELECT value, sum(n) OVER (ORDER BY value) AS n, sum(value * n) OVER (ORDER BY value) AS s, sum(n) OVER () AS nn, sum(value * n) OVER () AS ss FROM v),
t AS (SELECT value AS threshold FROM k WHERE n < nn ORDER BY round(CAST(n AS DOUBLE) * CAST(nn - n AS DOUBLE) * pow(s / n - (ss - s) / (nn - n), 2), 3) DESC, value LIMIT 1),
h AS (SELECT value, n, value > threshold AS upper FROM v, t),
hk AS (SELECT upper, value, sum(n) OVER w AS n, sum(value * n) OVER w AS s, sum(n) OVER p AS nn, sum(value * n) OVER p AS ss FROM h WINDOW w AS (PARTITION BY upper ORDER BY value), p AS (PARTITION BY upper)),
own AS (SELECT upper, value AS own FROM (SELECT upper, value, row_number() OVER (PARTITION BY upper
  ORDER BY round(CAST(n AS DOUBLE) * CAST(nn - n AS DOUBLE) * pow(s / n - (ss - s) / (nn - n), 2), 3) DESC, value) AS k FROM hk WHERE n < nn) WHERE k = 1)
SELECT CASE WHEN h.upper THEN CASE WHEN value > own THEN 0.9 ELSE 0.75 END ELSE CASE WHEN value > own THEN 0.25 ELSE 0.1 END END::DOUBLE AS level, CAST(sum(n) AS BIGINT) AS voxels
FROM h LEFT JOIN own ON h.upper = own.upper GROUP BY 1"""


@query("a20_four_levels", LEVELS_SQL)
def a20_levels(v):
    return measure.four_levels(v.vox(), "i", ["volume_id"]).groupBy("level").agg(F.count("*").alias("voxels"))


DESCRIBE_SQL = """
l AS (SELECT class, unnest(['l_quantity', 'l_discount']) AS feature, unnest([l_quantity, l_discount]) AS value FROM feat),
m AS (SELECT class, feature, avg(value) AS mu, var_pop(value) AS spread FROM l GROUP BY 1, 2)
SELECT class, feature, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance,
  round(avg(pow(value - mu, 3)) / pow(any_value(spread), 1.5), 6) + 0.0 AS skewness, round(avg(pow(value - mu, 4)) / pow(any_value(spread), 2) - 3, 6) + 0.0 AS kurtosis
FROM l JOIN m USING (class, feature) GROUP BY 1, 2"""


@query("a33_describe", DESCRIBE_SQL)
def a33(v):
    found = measure.describe(v.feat(), ["l_quantity", "l_discount"], ["class"])
    return found.select([(F.round(c, 6) + 0.0).alias(c) if c in ("mean", "variance", "skewness", "kurtosis") else F.col(c) for c in found.columns])


@query("a34_chunk_means", "SELECT volume_id, z // 3 AS chunk, y, x, CAST(sum(i) // 3 AS INT) AS i FROM vox GROUP BY 1, 2, 3, 4")
def a34(v):
    return measure.chunk_means(v.vox(), 3)


CELLS = "cells AS (SELECT label, count(*) AS n, min(z) AS z0, max(z) - min(z) + 1 AS h FROM lab GROUP BY 1)"


@query("p25_physical_volume", f"{CELLS} SELECT label, round(n * 1.0 * 0.5 * 0.5, 6) AS volume FROM cells")
def p25(v):
    cells = v.lab().groupBy("label").agg(F.count("*").alias("n"))
    return cells.select("label", F.round(shape.physical_volume(F.col("n"), F.lit(1.0), F.lit(0.5), F.lit(0.5)), 6).alias("volume"))


@query("p26_equivalent_diameter", f"{CELLS} SELECT label, round(pow(0.75 * n / pi(), 1.0 / 3), 6) AS diameter FROM cells")
def p26(v):
    return v.lab().groupBy("label").agg(F.count("*").alias("n")).select("label", F.round(shape.equivalent_diameter(F.col("n")), 6).alias("diameter"))


@query("p27_prolateness_oblateness", "e AS (SELECT l_orderkey AS k, l_quantity AS a, l_quantity + l_discount AS b, l_quantity + l_discount + 1 + l_tax AS c FROM lineitem) SELECT round(avg((sqrt(c) - sqrt(a)) / sqrt(c)), 6) AS prolateness, round(avg(2 * (sqrt(b) - sqrt(a)) / (sqrt(c) - sqrt(a)) - 1), 6) AS oblateness FROM e")
def p27(v):
    a, b = F.col("l_quantity"), F.col("l_quantity") + F.col("l_discount")
    c = b + 1 + F.col("l_tax")
    return v.table("lineitem").agg(F.round(F.avg(shape.prolateness(a, c)), 6).alias("prolateness"), F.round(F.avg(shape.oblateness(a, b, c)), 6).alias("oblateness"))


@query("p28_axis_ratios", "SELECT label, round(CASE WHEN var_pop(x) = 0 THEN 0 ELSE sqrt(greatest(0, 1 - var_pop(z) / var_pop(x))) END, 6) AS ratio, round(4 * sqrt(var_pop(x)) * 0.5, 6) AS length FROM lab GROUP BY 1")
def p28(v):
    m = v.lab().groupBy("label").agg(F.var_pop("x").alias("a"), F.var_pop("z").alias("b"))
    return m.select("label", F.round(shape.axis_ratio(F.col("a"), F.col("b")), 6).alias("ratio"), F.round(shape.axis_length(F.col("a")), 6).alias("length"))
