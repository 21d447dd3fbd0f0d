"""Near-duplicate embeddings by E8 lattice hashing, confirmed by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm._graph import components
from voxelframe.llm._store import written
from voxelframe.llm._text import _SLOTS, U, mix
from voxelframe.llm.near_dups import grouped

TABLES = 8
PROBES = 3  # lattice cells of each vector in each table, the nearest first
TILE = 512  # members of a part of a large cell
#: Width of a cell in lengths that two vectors just linked differ by after projection.
CELL = 2.4


def width(dim: int, least: float) -> float:
    """Unit vectors with a cosine of `least` differ by sqrt(2 - 2 * least), of which a map to 8 of `dim` dimensions keeps sqrt(8 / dim)
    on the average. Cells that are as wide in that measure find and part vectors alike in all dimensions."""
    return max(CELL * (2 - 2 * least) ** 0.5 * (8 / max(8, dim)) ** 0.5, 1e-9)


def projections(dim: int, seed: int = 7) -> np.ndarray:
    """TABLES maps to 8 dimensions with orthonormal rows, or as many as dim allows."""
    rng = np.random.default_rng(seed)
    out = np.zeros((TABLES, dim, 8))
    for t in range(TABLES):
        out[t, :, : min(8, dim)] = np.linalg.qr(rng.standard_normal((dim, min(8, dim))))[0]
    return out


def lattice_points(x: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` (up to 4) nearest found E8 points of each row of x, doubled to be whole numbers.

    E8 is D8 and D8 shifted by one half. In each, the nearest point with an even sum rounds every coordinate, and the
    second one turns over the cheapest coordinate or two.
    """
    n = len(x)
    points, costs = [], []
    for shift in (0.0, 0.5):
        y = x - shift
        near = np.rint(y)
        error = y - near
        order = np.argsort(-np.abs(error), axis=1)
        turn = np.where(error >= 0, 1.0, -1.0)
        odd = near.sum(1) % 2 != 0
        rows = np.arange(n)
        first, second = near.copy(), near.copy()
        a, b = order[:, 0], order[:, 1]
        first[rows[odd], a[odd]] += turn[rows[odd], a[odd]]
        second[rows[odd], b[odd]] += turn[rows[odd], b[odd]]
        for at in (a, b):
            second[rows[~odd], at[~odd]] += turn[rows[~odd], at[~odd]]
        for p in (first, second):
            points.append(2 * (p + shift))
            costs.append(((y - p) ** 2).sum(1))
    best = np.argsort(np.array(costs), axis=0, kind="stable")[:probes]
    return np.array(points)[best, np.arange(n)].transpose(1, 0, 2).astype(np.int64)


def cells(unit: np.ndarray, label: np.ndarray, maps: np.ndarray, scale: float) -> np.ndarray:
    """Cell numbers of each unit vector: one for each table and probe; label: hashes, and cells of different ones differ."""
    out = np.zeros((len(unit), TABLES * PROBES), np.int64)
    with np.errstate(over="ignore"):
        own = mix(label.astype(np.int64).view(U) + U(977))
        for t in range(TABLES):
            points = lattice_points(unit @ maps[t] / scale, PROBES)
            key = (points.view(U) * _SLOTS[:8]).sum(2) + own[:, None] + _SLOTS[20 + t]
            out[:, t * PROBES : (t + 1) * PROBES] = mix(key).view(np.int64)
    return out


def compared(ids: np.ndarray, side: np.ndarray, weight: np.ndarray, label: np.ndarray, unit: np.ndarray, marks: np.ndarray, cell: int, own: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links in a cell, or between two parts of it: ids, weight of links counted here, smallest id of each local group.

    Two vectors may meet in several cells; the link is counted in the smallest one that both have.
    """
    link = (unit @ unit.T >= least) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    if not own:
        link &= side[:, None] != side[None, :]
    rows, columns = np.nonzero(np.triu(link))
    counts = np.zeros(len(ids), np.int64)
    for at in range(0, len(rows), 1 << 15):  # in blocks: each pair looks at all cells of both
        r, c = rows[at : at + (1 << 15)], columns[at : at + (1 << 15)]
        smaller = np.where(marks < cell, marks, np.iinfo(np.int64).max)
        same = np.zeros(len(r), bool)
        for j in range(marks.shape[1]):
            mine = smaller[r, j]
            some = mine != np.iinfo(np.int64).max
            if some.any():
                same[some] |= (smaller[c[some]] == mine[some, None]).any(1)
        np.add.at(counts, r[~same], weight[c[~same]])
        np.add.at(counts, c[~same], weight[r[~same]])
    group = np.arange(len(ids))  # ids ascend
    while len(rows):
        low = np.minimum(group[rows], group[columns])
        new = group.copy()
        np.minimum.at(new, rows, low)
        np.minimum.at(new, columns, low)
        new = new[new]
        if (new == group).all():
            break
        group = new
    some = np.zeros(len(ids), bool)
    some[rows] = some[columns] = True
    return ids[some], counts[some], ids[group[some]]


def linked_vectors(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows(vec_id, embedding, label).

    Vectors with equal labels are linked if their cosine in double precision is `least` or more. A vector that is null, empty, zero or
    has null or non-finite components, and one whose label is null, links with nothing. Labels are of any type that can be
    grouped and are equal as Spark groups them. n_links: other rows linked
    directly; component_id: the smallest vec_id reachable; kept: vec_id is component_id. Rows with a null vec_id link with
    nothing, have a null component_id and are kept. Vectors of different lengths never link. Further columns are left out.

    Links are found from cells that both vectors are in, so a few near the threshold are missed: of pairs with a cosine of 0.98 to 0.985, at most
    one in a hundred in 4 to 1536 dimensions, none of those that are closer. In fewer than 4 dimensions there are few cells, and they are large.

    Equal vectors of one label become one class with a weight. Each class goes into PROBES lattice cells in each of TABLES
    tables; cells that only one class has are dropped before vectors travel. Large cells are cut into tiles, and all pairs of
    tiles are compared, so no cell is capped: counting a vector's links takes all pairs of its cell. Links are never rows: a task
    returns sums and a local group for each vector.
    """
    given = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    plain = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    classes = usable.select("vec_id", "label", plain.alias("v")).groupBy("label", "v").agg(F.min(F.struct("vec_id", F.col("label").cast("string").alias("said"))).alias("m"), F.count("*").alias("weight"))
    classes = written(classes.select("label", "v", F.monotonically_increasing_id().alias("rep"), F.col("m.vec_id").alias("first"), F.xxhash64("label").alias("mark"), F.col("m.said").alias("said"), "weight"), "vector-classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            v = batch.column("v")
            length = np.diff(v.offsets.to_numpy())
            flat, begin = v.values.to_numpy(), v.offsets.to_numpy()
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                x = flat[begin[at][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                if dim not in maps:
                    maps[dim] = projections(int(dim))
                with np.errstate(over="ignore"):
                    label = batch.column("mark").to_numpy()[at] + dim * 1_000_003
                marks = cells(unit, label, maps[dim], width(int(dim), least))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("rep", "weight", "said")), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(list(marks), pa.list_(pa.int64()))], ["rep", "weight", "said", "unit", "marks"])

    hashing = classes.select("rep", "weight", "said", "mark", "v").mapInArrow(hashed, "rep long, weight long, said string, unit binary, marks array<long>")
    unit = written(hashing, "vectors")
    held = unit.select("rep", F.octet_length("unit").alias("bytes"), F.explode(F.array_distinct("marks")).alias("cell"))
    sizes = held.groupBy("cell", "bytes").agg(F.count("*").alias("members")).where("members > 1")
    held = held.join(sizes, ["cell", "bytes"]).withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    held = held.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiled = held.select("cell", "bytes", "rep", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
    tiled = tiled.select("cell", "bytes", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), (F.col("tile") > F.col("with")).cast("int").alias("side"), "rep")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part in grouped(batches, ["cell", "bytes", "one", "two"]):
            ids, at = np.unique(np.asarray(part["rep"], np.int64), return_index=True)
            if len(ids) < 2:
                continue
            pick = lambda n, at=at, part=part: [part[n][k] for k in at]
            units = np.frombuffer(b"".join(pick("unit")), np.float64).reshape(len(ids), -1)
            label = np.unique(np.array(pick("said"), str), return_inverse=True)[1]
            found = compared(ids, np.asarray(pick("side")), np.asarray(pick("weight"), np.int64), label, units, np.asarray(pick("marks"), np.int64), key[0], key[2] == key[3], least)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "n", "b"])

    dealt = tiled.join(unit, "rep").repartition("cell", "bytes", "one", "two").sortWithinPartitions("cell", "bytes", "one", "two", "rep")
    found = written(dealt.mapInArrow(links, "a long, n long, b long"), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    linked = components(found.select("a", "b"))
    reps = unit.select("rep", "weight").join(counts, unit.rep == counts.a, "left").join(linked, F.col("rep") == F.col("node"), "left")
    reps = reps.select("rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    placed = classes.select("label", "v", "rep", "first").join(reps, "rep")
    owners = placed.join(placed.groupBy("component").agg(F.min("first").alias("component_id")), "component").drop("component", "first")
    same = (given["label"] == owners["label"]) & (F.transform(given["v"], lambda x: x + F.lit(0.0)) == owners["v"]) & given["vec_id"].isNotNull()
    out = given.join(owners, same, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
