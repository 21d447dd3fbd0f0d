"""Near-duplicate documents: MinHash signatures in an LSH forest, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm._graph import components
from voxelframe.llm._store import written
from voxelframe.llm._text import BLANKS, _SLOTS, U, mix, runs, slices, spread, words

SIZE = 128  # values of a signature, a byte each
TREES = 32  # with PREFIX values each they use every value once: a pair at 0.75 meets in none with a chance of 5 in a million
DEPTH, PREFIX = 12, 4  # values of a label in a sorted order, and of those that members of a region share
FEW = 16  # members up to which a region gives all its pairs
FIRST = 8  # trees in which each member is compared with the one after it before any region gives more pairs
CROWD = 4096  # members that are sorted together
TILE, TILE_SETS = 768, 1 << 20  # members of a part of a region, and shingles of all their sets
LIKELY = 0.58  # least share of equal values for a pair to be confirmed; 4 standard deviations below 0.75
CHUNK = 512 << 10

_FLIPS = mix(np.arange(1, SIZE + 1, dtype=U)).astype(np.uint32)
_TURNS = (mix(np.arange(5000, 5000 + SIZE, dtype=U)) >> U(32)).astype(np.uint32) | np.uint32(1)
_ORDERS = np.argsort(mix(np.arange(SIZE, dtype=U) + U(1000)))[(PREFIX * np.arange(TREES)[:, None] + np.arange(DEPTH)) % SIZE]


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of the distinct word runs of each text, sorted; fewer words than size are one run."""
    w = words(texts, BLANKS, lower=True)
    hashes = w.hashes()
    at, found = runs(w, hashes, size)
    many = np.diff(w.first)
    short = np.flatnonzero((many > 0) & (many < size))
    group, place = spread(many[short])
    with np.errstate(over="ignore"):
        parts = hashes[w.first[short][group] + place] * _SLOTS[place]
        sums = np.zeros(len(short), U)
        np.add.at(sums, group, parts)
        sums = mix(sums + many[short].astype(U) * _SLOTS[40])
    doc = np.concatenate([w.doc[at], short])
    found = np.concatenate([found, sums])
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]


def signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text_hash, n_shingles, set_id (128 bits, from the whole set), signature."""
    for batch, texts in slices(batches, "text", CHUNK):
        doc, found = shingles(texts, size)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        many = np.diff(first)
        full = np.flatnonzero(many)
        sign = np.zeros((len(texts), SIZE), np.uint8)
        ids = np.zeros((len(texts), 2), U)
        if len(full):
            begin = first[full]
            low = found.astype(np.uint32)
            with np.errstate(over="ignore"):
                for k in range(SIZE):
                    least = np.minimum.reduceat((low ^ _FLIPS[k]) * _TURNS[k], begin)
                    sign[full, k] = (least * np.uint32(2654435761)) >> np.uint32(24)
                ids[full, 0] = np.add.reduceat(found, begin)
                ids[full, 1] = np.add.reduceat(mix(found ^ U(0x5851F42D4C957F2D)), begin)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(many, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in sign], pa.binary())],
            ["doc_id", "text_hash", "n_shingles", "set_id", "signature"],
        )


def hashed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The set of each text(b, signature, text) as sorted 64-bit hashes."""
    for batch, texts in slices(batches, "text", CHUNK):
        doc, found = shingles(texts, size)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        sets = [found[p:q].tobytes() for p, q in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("signature"), pa.array(sets, pa.binary())], ["rep", "signature", "hashes"])


def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the signature in the tree's order, as far as the forest is deep."""
    for batch in batches:
        n = batch.num_rows
        sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, SIZE)
        path = sign[:, _ORDERS]  # n x trees x depth
        rep = np.repeat(np.arange(n), TREES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep").take(pa.array(rep)), batch.column("n_shingles").take(pa.array(rep)), pa.array(np.tile(np.arange(TREES), n), pa.int32()), pa.array([x.tobytes() for x in path.reshape(n * TREES, -1)], pa.binary())],
            ["rep", "n_shingles", "tree", "label"],
        )


def regions(forest: DataFrame) -> DataFrame:
    """(region, tree, members, rep, n_shingles, label) of all regions of two members or more: a region is what shares a prefix in one tree."""
    keyed = forest.withColumn("region", F.xxhash64("tree", F.substring("label", 1, PREFIX)))
    return keyed.join(keyed.groupBy("region").agg(F.count("*").alias("members")).where("members > 1"), "region").select("region", "tree", "members", "rep", "n_shingles", "label")


def placed(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """The members of regions with their components; what has no link yet is a component of its own."""
    known = linked.select(F.col("node").alias("rep"), "component")
    return shared.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def neighbours(members: DataFrame, few: int) -> DataFrame:
    """(a, b) of different components: all pairs of regions of up to `few` members; of larger ones each member and the one after it in sorted order.

    Those share the longest prefixes: the more crowded a region, the deeper. Large regions are sorted in parts of about CROWD.
    Pairs inside a component make no rows: their links would join nothing.
    """
    part = F.pmod(F.xxhash64("rep"), F.ceil(F.col("members") / CROWD))
    order = Window.partitionBy("region", "part").orderBy("label", "rep")
    later = F.collect_list(F.struct("rep", "component")).over(order.rowsBetween(1, max(few - 1, 1)))
    lists = members.withColumn("part", part).withColumn("later", later)
    reach = F.slice("later", 1, F.when(F.col("members") <= few, few).otherwise(1))
    others = F.filter(reach, lambda x: x["component"] != F.col("component"))["rep"]
    pairs = lists.select("rep", F.explode(others).alias("other"))
    return pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).where("a < b").distinct()


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIZE) for k in ("x", "y"))
        yield batch.filter(pa.array((x == y).sum(1) >= LIKELY * SIZE)).select(["a", "b"])


def rest_tiles(ends: DataFrame) -> DataFrame:
    """(region, tree, one, two, side, rep, component) of the tile pairs in which members of different components meet.

    A region's largest component is dealt into tiles of its own, which aren't compared with each other; a region that is one
    component gives no rows. Tiles are bounded by members and by the sizes of their sets.
    """
    sizes = ends.groupBy("region", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("sets"))
    mixed = sizes.groupBy("region").agg(F.max(F.struct("n", "sets", "component")).alias("top"), F.sum("n").alias("n"), F.sum("sets").alias("sets"), F.count("*").alias("kinds")).where("kinds > 1")
    parts = lambda n, sets: F.ceil(F.greatest(n / TILE, sets / TILE_SETS)).cast("int")
    mixed = mixed.select("region", F.col("top.component").alias("main"), parts(F.col("top.n"), F.col("top.sets")).alias("main_tiles"), parts(F.col("n") - F.col("top.n"), F.col("sets") - F.col("top.sets")).alias("tiles"))
    inside = F.col("component") == F.col("main")
    tile = F.when(inside, F.col("tiles") + F.pmod(F.xxhash64("rep"), F.col("main_tiles"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("tiles"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(inside, F.col("tiles")).otherwise(F.col("tiles") + F.col("main_tiles")) - 1)
    rows = ends.join(mixed, "region").select("region", "tree", "rep", "component", tile.alias("tile"), F.explode(meets).alias("with"))
    return rows.select("region", "tree", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), (F.col("tile") > F.col("with")).cast("int").alias("side"), "rep", "component")


def _share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values are equal, for each row of x and each of y."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for k in range(SIZE):
        out += x[:, k][:, None] == y[:, k]
    return out


def rest_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that join components in the tile pairs of rest_tiles(), counted on full sets; rows sorted by (region, one, two).

    Every likely pair is counted but those whose ends have one component by then, and those that share a region of an
    earlier tree, which are counted there.
    """
    for key, rows in grouped(batches, ["region", "one", "two"]):
        ids, at = np.unique(np.asarray(rows["rep"], np.int64), return_index=True)
        sign = np.frombuffer(b"".join([rows["signature"][k] for k in at]), np.uint8).reshape(-1, SIZE)
        side, component = (np.asarray(rows[k], np.int64)[at] for k in ("side", "component"))
        own = key[1] == key[2]
        x, y = (np.arange(len(ids)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        many = np.array([len(rows["hashes"][k]) // 8 for k in at])
        share = _share(sign[x], sign[y]) >= LIKELY * SIZE
        share &= component[x][:, None] != component[y]
        share &= 100 * np.minimum(many[x][:, None], many[y]) >= percent * np.maximum(many[x][:, None], many[y])
        if own:
            share = np.triu(share)
        if not share.any():
            continue
        _, words_of = np.unique(np.frombuffer(b"".join([rows["hashes"][k] for k in at]), U), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(many)])
        roads = np.ascontiguousarray(sign[:, _ORDERS[: rows["tree"][0], :PREFIX]]).reshape(len(ids), -1).view(np.uint32)
        mark = np.zeros(words_of.max() + 1, bool)
        found = []
        for k in np.flatnonzero(share.any(1)):
            p = x[k]
            q = y[share[k]]
            q = q[component[q] != component[p]]
            q = q[~(roads[q] == roads[p]).any(1)]
            if not len(q):
                continue
            mark[words_of[first[p] : first[p + 1]]] = True
            group, place = spread(many[q])
            both = np.bincount(group, mark[words_of[first[q][group] + place]], len(q)).astype(np.int64)
            mark[words_of[first[p] : first[p + 1]]] = False
            for j in q[100 * both >= percent * (many[p] + many[q] - both)]:
                if component[j] != component[p]:
                    component[component == component[j]] = component[p]
                    found.append((ids[p], ids[j]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], ["a", "b"])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys, from sorted rows."""
    held: dict[str, list] = {}
    last: tuple | None = None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        marks = list(zip(*(columns[k] for k in keys), strict=True))
        at = 0
        for k in [*(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)]:
            if at == k:
                continue
            if marks[at] != last:
                if held:
                    yield last, held
                held, last = {n: [] for n in columns}, marks[at]
            for n, v in columns.items():
                held[n] += v[at:k]
            at = k
    if held:
        yield last, held


def confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (a, role), where role 0 has a's text and role 1 that of each b: the pairs that hold on full sets."""
    lead, owner = np.zeros(0, U), None
    for batch, texts in slices(batches, "text", CHUNK):
        doc, found = shingles(texts, size)
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        a, b, role = (batch.column(k).to_pylist() for k in ("a", "b", "role"))
        good = []
        for k in range(len(texts)):
            own = found[first[k] : first[k + 1]]
            if not role[k]:
                lead, owner = own, a[k]
                continue
            if owner != a[k]:
                raise ValueError(f"the text of document {a[k]} is missing")
            if 100 * min(len(lead), len(own)) < percent * max(len(lead), len(own)) or not len(lead):
                continue
            at = np.minimum(np.searchsorted(lead, own), len(lead) - 1)
            both = int((lead[at] == own).sum())
            if 100 * both >= percent * (len(lead) + len(own) - both):
                good.append(k)
        yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in good], pa.int64()), pa.array([b[k] for k in good], pa.int64())], ["a", "b"])


def confirmed(found: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of found(a, b) that hold on the full sets of texts(b, text). A member has a bounded number of pairs."""
    members = found.select("a", "b", F.lit(1).alias("role"))
    leads = found.select("a").distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("role"))
    loaded = members.unionByName(leads).join(texts, "b").select("a", "b", "role", "text")
    return loaded.repartition("a").sortWithinPartitions("a", "role", "b").mapInArrow(lambda it: confirm(it, size, percent), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    Words are parted by ASCII blanks and A-Z are lower-cased. A text's set has its distinct runs of `size` words; fewer words
    are one run; a text without words, or null, has an empty set and links with nothing. Two sets are linked if their
    intersection is at least `percent` hundredths of their union. component_id is the smallest doc_id reachable, kept whether it
    is the row's own. Rows that repeat a doc_id are judged by their own texts; a null doc_id links with nothing, has a null
    component_id and is kept. Further columns are left out; no documents give no rows.

    Texts with equal sets become one class, so exact copies cost nothing further. Every class goes into TREES sorted orders of
    its signature; classes with one prefix in one order are a region. At first each member is compared with the one after it in
    a few orders; this joins most of what belongs together. What is in one component by then is not compared again. Of the
    other pairs small regions give all, larger ones each member and the one after it. Then every large region whose members are
    in different components is compared whole, in pairs of tiles that carry the sets. Signatures only choose what is
    counted: every link is counted on the full sets, and no region, partner or candidate is capped.
    """
    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = written(given.mapInArrow(lambda it: signatures(it, size), "doc_id long, text_hash long, n_shingles long, set_id binary, signature binary"), "signatures", compression="snappy")
    known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash", "n_shingles", "signature")).alias("m")).select("set_id", "m.*")
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes", compression="snappy")
    sign = classes.select("rep", "signature")
    shared = written(regions(classes.select("rep", "n_shingles", "signature").mapInArrow(labels, "rep long, n_shingles long, tree int, label binary")), "regions", compression="snappy")
    x, y = sign.select(F.col("rep").alias("a"), F.col("signature").alias("x")), sign.select(F.col("rep").alias("b"), F.col("signature").alias("y"))

    needed = lambda reps: classes.select(F.col("rep").alias("b"), "doc_id", "text_hash", "signature").join(reps, "b", "left_semi")
    texts = lambda reps: given.join(needed(reps), ["doc_id", "text_hash"]).dropDuplicates(["b"]).select("b", "signature", "text")

    def links(pairs: DataFrame) -> DataFrame:
        found = written(pairs.join(x, "a").join(y, "b").mapInArrow(likely, "a long, b long"), "candidates")
        asked = found.select("b").unionByName(found.select(F.col("a").alias("b"))).distinct()
        return confirmed(found, texts(asked), size, percent)

    alone = shared.where(F.col("tree") < FIRST).withColumn("component", F.col("rep"))
    linked = components(links(neighbours(alone, few=0)))
    linked = components(links(neighbours(placed(shared, linked), FEW)).unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    large = shared.where(F.col("members") > FEW).select("region", "tree", "rep", "n_shingles")
    met = written(rest_tiles(placed(large, linked)), "rest")
    sets = texts(met.select(F.col("rep").alias("b")).distinct()).mapInArrow(lambda it: hashed(it, size), "rep long, signature binary, hashes binary")
    met = met.join(written(sets, "sets", compression="snappy"), "rep").repartition("region", "one", "two").sortWithinPartitions("region", "one", "two", "rep")
    more = written(met.mapInArrow(lambda it: rest_links(it, percent), "a long, b long"), "links")
    if not more.isEmpty():
        linked = components(more.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    ends = placed(classes.select("set_id", "rep", "doc_id"), linked)
    least = ends.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    owner = ends.join(least, "component").select("set_id", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "set_id").withColumn("set_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id"))).join(owner, "set_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
