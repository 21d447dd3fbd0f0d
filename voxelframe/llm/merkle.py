"""A Merkle manifest of a dataset: content-addressed records of a hash tree, proofs of leaves, and their check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm._store import written

#: Levels of the tree that one record spans; a record has at most 2 ** SPAN children.
SPAN = 6
FANOUT = 1 << SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: dict[str, Column]) -> Column:
    """Lowercase hex sha256 of the fields in their order: `-` for null, else the UTF-8 bytes' number, `:` and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields.values()]
    return F.sha2(F.concat(*parts), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests: list[str], height: int) -> list[list[str]]:
    """The digests and the `height` levels above them: each 2 neighbours, or a last single one, become one."""
    out = [digests]
    for _ in range(height):
        below = out[-1]
        out.append([_sha("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return out


def height(n: Column) -> Column:
    """Levels above n leaves, in whole numbers."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


@dataclass
class Forest:
    """layers[j]: (grp, number, height, children, digest), a record for each FANOUT nodes of a group at level j * SPAN.

    `digest` addresses the record: it is what its children hash to. The last layers hold large groups only. roots: (grp, root, n).
    """

    layers: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame, name: str) -> Forest:
    """The trees over leaves(grp, place, digest), places from 0 without gaps in each group; both are numbers without nulls.

    A record gathers at most FANOUT digests, so no group meets in one task, however large. Each layer is written.
    """
    sizes = written(leaves.groupBy("grp").agg(F.count("*").alias("n")), f"{name}-sizes")
    nodes, layers, most = leaves.select("grp", "place", "digest"), [], sizes.agg(F.max(height(F.col("n")))).first()[0]
    for j in range(max(1, -(-(most or 0) // SPAN))):
        grouped = nodes.groupBy("grp", F.expr(f"place div {FANOUT}").alias("number")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("c"))
        own = F.least(F.lit(SPAN), height(F.col("n")) - j * SPAN)
        alive = grouped.join(sizes, "grp").select("grp", "number", own.cast("int").alias("height"), F.transform("c", lambda x: x["digest"]).alias("children")).where(f"height > 0 OR {j} = 0")
        layers.append(written(alive.mapInArrow(_digested, "grp long, number long, height int, children array<string>, digest string"), f"{name}-{j}"))
        nodes = layers[-1].select("grp", F.col("number").alias("place"), "digest")
    last = F.greatest(F.lit(0), F.ceil(height(F.col("n")) / SPAN) - 1)
    tops = [layer.where("number = 0").join(sizes.where(last == j), "grp").select("grp", F.col("digest").alias("root"), "n") for j, layer in enumerate(layers)]
    roots = tops[0]
    for more in tops[1:]:
        roots = roots.unionByName(more)
    return Forest(layers, written(roots, f"{name}-roots"))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, a few hundred records at a time."""
    for batch in batches:
        for k in range(0, len(batch), 256):
            yield batch.slice(k, 256)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        children, heights = batch.column(3).to_pylist(), batch.column(2).to_pylist()
        tops = [levels(c, h)[-1][0] for c, h in zip(children, heights, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, "digest"])


def _steps(given: list[list[str]], digit: int) -> list[str]:
    """From a record's top down to its child `digit`: the child not chosen at each level, with its side, `-` where there is none."""
    out = []
    for k in range(len(given) - 2, -1, -1):
        at = digit >> k
        other = at ^ 1
        out.append("-" if other >= len(given[k]) else ("<" if other < at else ">") + given[k][other])
    return out


PATHS = "grp long, place long, digest string, claim string, path array<string>, marks array<string>"


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a record, the digest asked for, the path above it and the children chosen: each of these with its own path."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    for batch in _few(batches):
        rows = batch.to_pydict()
        for grp, number, h, children, digest, asked, above, marks, chosen in zip(*(rows[c] for c in ("grp", "number", "height", "children", "digest", "asked", "above", "marks", "chosen")), strict=True):
            given = levels(children, h)
            if not asked == digest == given[-1][0]:
                raise ValueError(f"record {number} of group {grp} is not the one that its parent names")
            out = [(grp, number * FANOUT + x["digit"], children[x["digit"]], x["claim"], _steps(given, x["digit"])[::-1] + above, marks) for x in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["grp", "place", "digest", "claim", "path", "marks"])


def descend(forest: Forest, tops: DataFrame, asked: DataFrame) -> DataFrame:
    """(grp, place, digest, claim, path, marks) of the leaves asked(grp, place, claim), from the roots down; places that are not there give no row.

    tops(grp, above, marks): each root's own path further up, empty for the last root, and what its leaves carry along. claim is any
    string that comes with a request. A layer is met by the distinct prefixes of the places asked, each once, so neither a root
    nor an often-asked leaf is a hot key. The path goes from the leaf's sibling up: `<` or `>` and a sibling to the left or
    right, or `-`.
    """
    wanted = asked.select("grp", "place", F.col("claim").cast("string")).distinct()
    deep = F.greatest(F.lit(1), F.ceil(height(F.col("n")) / SPAN)).cast("int")
    start = forest.roots.join(tops, "grp").select("grp", F.lit(0).cast("long").alias("number"), F.col("root").alias("asked"), "above", "marks", (deep - 1).alias("layer"))
    paths = None
    for j in range(len(forest.layers) - 1, -1, -1):
        here = start.where(F.col("layer") == j).drop("layer")
        if paths is not None:
            here = here.unionByName(paths.select("grp", F.col("place").alias("number"), F.col("digest").alias("asked"), F.col("path").alias("above"), "marks"))
        claim = F.col("claim") if j == 0 else F.lit(None).cast("string")
        prefixes = wanted.select("grp", F.expr(f"place div {FANOUT**j}").alias("place"), claim.alias("claim"))
        prefixes = prefixes.distinct() if j else prefixes
        one = F.struct((F.col("place") % FANOUT).cast("int").alias("digit"), "claim")
        chosen = prefixes.groupBy("grp", F.expr(f"place div {FANOUT}").alias("number")).agg(F.sort_array(F.collect_list(one)).alias("chosen"))
        met = forest.layers[j].join(chosen, ["grp", "number"]).join(here, ["grp", "number"])
        met = met.withColumn("chosen", F.filter("chosen", lambda x: x["digit"] < F.size("children")))
        paths = met.where(F.size("chosen") > 0).mapInArrow(_descend, PATHS)
    return paths


def siblings_digest(path: Column) -> Column:
    """Lowercase hex sha256 of a path's siblings in their order."""
    known = F.filter(path, lambda x: x != "-")
    return F.sha2(F.array_join(F.transform(known, lambda x: F.substring(x, 2, 64)), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with a path's siblings."""

    def step(found: Column, x: Column) -> Column:
        other = F.substring(x, 2, 64)
        return F.sha2(F.when(x == "-", found).when(F.substring(x, 1, 1) == "<", F.concat(other, found)).otherwise(F.concat(found, other)), 256)

    return F.aggregate(path, start, step)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with grp, the number of their value of `group` (null first, then by bytes), and place, their number in it by `order`; and (grp, n).

    Rows are dealt by ranges of both and sorted, then counted in each part. Only (part, group) pairs meet in windows; they are
    as many as parts and groups, not rows, so that a group holding a third of all rows is as good as any.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, name).withColumn("_part", F.shiftright("_at", 33))
    counts = written(dealt.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), f"{name}-counts")
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # groups of one part are counted there, and parts are few: a number is the groups that begin in parts before, and before it in its own
    begun = counts.groupBy("_group").agg(F.min("_part").alias("_part"), F.sum("_n").alias("n"))
    parts = begun.groupBy("_part").agg(F.count("*").alias("_m")).withColumn("_base", F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_first("_group"))) - 1
    groups = written(begun.withColumn("_inner", inner).join(parts, "_part").select("_group", (F.col("_base") + F.col("_inner")).cast("long").alias("grp"), "n"), f"{name}-groups")
    named = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("c").join(groups.alias("g"), F.col("c._group").eqNullSafe(F.col("g._group")))
    named = named.select("c._part", "c._group", "_first", "_base", "grp")
    both = dealt.join(named.withColumnRenamed("_part", "_own"), (F.col("_part") == F.col("_own")) & F.col(group).eqNullSafe(F.col("_group")))
    return both.select(*rows.columns, "grp", (F.col("_base") + F.col("_at") - F.col("_first")).cast("long").alias("place")), groups.select("grp", "n")


def manifest(docs: DataFrame, more: dict[str, Column] | None = None) -> tuple[DataFrame, Forest, Forest]:
    """Leaves (doc_id, lang, leaf, more..., grp, place), the trees of the langs, and the tree over their roots.

    docs: doc_id, source, lang, n_chars and text of any type; other columns are left out but those that `more` names, which may be
    expressions. Leaves of one lang go by doc_id, null first; rows of one doc_id by their leaves, so repeated rows are leaves of their own. No
    documents give no leaves and no root. Whole texts are hashed where they are read; only digests are shuffled.
    """
    more = more or {}
    rows = docs.select("doc_id", "lang", leaf({c: F.col(c) for c in FIELDS}).alias("leaf"), *[c.alias(n) for n, c in more.items()])
    rows = written(rows, "merkle-leaves")
    placed, _ = numbered(rows, "lang", ["doc_id", "leaf"], "merkle-order")
    placed = written(placed, "merkle-places")
    langs = grow(placed.select("grp", "place", F.col("leaf").alias("digest")), "merkle-langs")
    top = grow(langs.roots.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.col("root").alias("digest")), "merkle-top")
    return placed, langs, top


def proofs(langs: Forest, top: Forest, asked: DataFrame) -> DataFrame:
    """(grp, place, leaf, claim, subroot, root, path) of asked(grp, place, claim): path as in descend(), from the leaf to the root.

    One place should be asked with few claims; all those of a record are met in one row.
    """
    none = F.array().cast("array<string>")
    tops = top.roots.select("grp", none.alias("above"), F.array("root").alias("marks"))
    langs_asked = asked.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("place"), F.lit(None).cast("string").alias("claim"))
    above = descend(top, tops, langs_asked).select(F.col("place").alias("grp"), F.col("path").alias("above"), F.concat(F.array("digest"), "marks").alias("marks"))
    found = descend(langs, written(above, "merkle-above"), asked)
    return found.select("grp", "place", F.col("digest").alias("leaf"), "claim", F.col("marks")[0].alias("subroot"), F.col("marks")[1].alias("root"), "path")
