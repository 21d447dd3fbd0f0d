"""Ranked search for texts by their terms, exact, with hierarchies over items and documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm._store import new_path, written
from voxelframe.llm._text import Words, slices, spread, words

#: Bytes of text cut into terms at a time, and about the bytes of items searched for in one pass over the documents.
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Nodes of the hierarchies, by members: over documents and over items.
DOC_NODES, ITEM_NODES = (256, 16, 1), (64, 8, 1)
#: Documents whose tree is built at a time, and about the sums made at a time.
TILE, SUMS = 8192, 1 << 20
#: One in so many documents is searched first; its kth scores are lower bounds for all.
SEEDS = 64

# Bytes that part terms.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def terms(texts: pa.Array) -> Words:
    return words(texts, SEPARATOR, lower=True)


class Vocabulary:
    """The distinct terms of a block of items; find(words) gives each word's number, or -1. Terms are told apart by their bytes."""

    def __init__(self, w: Words) -> None:
        data, hashes = w.data.tobytes(), w.hashes()
        first: dict[bytes, int] = {}
        for k, (a, b) in enumerate(zip(w.start.tolist(), w.end.tolist(), strict=True)):
            first.setdefault(data[a:b], k)
        own = np.array(list(first.values()), np.int64)
        own = own[np.argsort(hashes[own], kind="stable")]
        self.hashes, self.data, self.start, self.end = hashes[own], w.data, w.start[own], w.end[own]
        self.alike = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))  # most terms with one hash

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, w: Words) -> np.ndarray:
        hashes = w.hashes()
        found, at = np.full(len(hashes), -1), np.searchsorted(self.hashes, hashes)
        for k in range(self.alike):
            near = np.flatnonzero((found < 0) & (at + k < len(self)))
            near = near[self.hashes[at[near] + k] == hashes[near]]
            term = at[near] + k
            size = self.end[term] - self.start[term]
            same = w.end[near] - w.start[near] == size
            near, term, size = near[same], term[same], size[same]
            group, inside = spread(size)
            differ = w.data[w.start[near][group] + inside] != self.data[self.start[term][group] + inside]
            equal = np.ones(len(near), bool)
            equal[group[differ]] = False
            found[near[equal]] = term[equal]
        return found


@dataclass
class Level:
    """Nodes over items: for each term, from start[term] on, the nodes that have it and the largest weight in each."""

    start: np.ndarray
    node: np.ndarray
    weight: np.ndarray
    first: np.ndarray  # item of each node

    @staticmethod
    def of(item: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int, n_terms: int, size: int) -> Level:
        nodes = -(-n_items // size)
        key = term * nodes + item // size
        order = np.argsort(key, kind="stable")
        key, begin = np.unique(key[order], return_index=True)
        largest = np.maximum.reduceat(weight[order], begin) if len(begin) else np.zeros(0, np.int64)
        return Level(np.searchsorted(key // nodes, np.arange(n_terms + 1)), key % nodes, largest, np.arange(nodes) * size)


@dataclass
class Hierarchy:
    """The items of a block by their heaviest terms, as levels; numbers: what item each place holds."""

    levels: list[Level]
    numbers: np.ndarray
    weight: np.ndarray  # of each term
    home: np.ndarray  # first item of each term
    exact: bool  # sums fit into the whole numbers of a double
    sizes: tuple[tuple[int, ...], tuple[int, ...]]  # members of nodes, over documents and over items


def hierarchy(item: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, n_items: int) -> Hierarchy:
    own = count * weight[term]
    heaviest = np.full(n_items, len(weight))
    order = np.lexsort((own, item))
    heaviest[item[order]] = term[order]  # the last one written is the heaviest
    numbers = np.argsort(heaviest, kind="stable")
    place = np.empty(n_items, np.int64)
    place[numbers] = np.arange(n_items)
    levels = [Level.of(place[item], term, own, n_items, len(weight), size) for size in ITEM_NODES]
    home = np.append(levels[-1].node, 0)[levels[-1].start[:-1]]
    return Hierarchy(levels, numbers, weight, home, float(np.bincount(item, own, n_items).max(initial=0)) * 1e6 < 2**53, (DOC_NODES, ITEM_NODES))


class Best:
    """The `most` highest-scoring documents of each item so far, and each item's weakest score among them, or a bound known before."""

    def __init__(self, most: int, weakest: np.ndarray) -> None:
        self.most, self.weakest = most, weakest.copy()
        self.rows = np.zeros((5, 0), np.int64)  # item, score, whether doc_id is there, doc_id, row
        self.waiting: list[np.ndarray] = []

    def add(self, rows: np.ndarray) -> None:
        self.waiting.append(rows)
        if sum(x.shape[1] for x in self.waiting) > 256:
            self.settle()

    def settle(self) -> None:
        rows = np.concatenate([self.rows, *self.waiting], axis=1)
        self.waiting = []
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        begin = np.flatnonzero(np.diff(rows[0], prepend=-1))
        rank = np.arange(rows.shape[1]) - np.repeat(begin, np.diff(np.append(begin, rows.shape[1])))
        last = rows[:, rank == self.most - 1]
        self.weakest[last[0]] = np.maximum(self.weakest[last[0]], last[1])
        self.rows = rows[:, rank < self.most]


def _sums(node: np.ndarray, term: np.ndarray, most: np.ndarray, level: Level, n: int, alive: np.ndarray | None, ratios: tuple[int, int], exact: bool) -> np.ndarray:
    """[node, item node]: the sum over terms of the largest weight times the largest impact, where the pair of parents is alive."""
    width = len(level.first)
    out = np.zeros(n * width)
    many = level.start[term + 1] - level.start[term]
    upto = np.cumsum(many)
    cuts = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, SUMS), "right")
    for a, b in zip(cuts, np.append(cuts[1:], len(term)), strict=True):
        group, inside = spread(many[a:b])
        at = level.start[term[a:b]][group] + inside
        key = node[a:b][group] * width + level.node[at]
        if alive is not None:
            open_ = alive[key // width // ratios[0], key % width // ratios[1]]
            key, at, group = key[open_], at[open_], group[open_]
        value = level.weight[at] * most[a:b][group]
        if exact:
            out += np.bincount(key, value, n * width)
        else:
            whole = np.zeros(n * width, np.int64)
            np.add.at(whole, key, value)
            out = out.astype(np.int64) + whole
    return out.reshape(n, width)


def _maxima(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest impact of each term in each node of `size` documents."""
    key = doc // size * n_terms + term
    order = np.argsort(key, kind="stable")
    key, begin = np.unique(key[order], return_index=True)
    return key // n_terms, key % n_terms, np.maximum.reduceat(impact[order], begin)


def _visit(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: tuple[np.ndarray, ...], items: Hierarchy, best: Best) -> None:
    """Search a tile of documents, in order of their heaviest terms: from pairs of large nodes down to pairs of a document and an item.

    A pair of nodes is left when its bound is below the weakest kth score of all items in the node; equal ones stay, as ties go by doc_id.
    """
    lead = np.lexsort((items.weight[term] * impact, doc))
    lead = lead[np.diff(doc[lead], append=-1) != 0]  # each document's heaviest term
    there = doc[lead]
    order = np.argsort(items.home[term[lead]], kind="stable")
    place = np.empty(len(ids[0]), np.int64)
    place[there[order]] = np.arange(len(there))
    back = there[order]
    doc = place[doc]
    order = np.argsort(doc, kind="stable")
    doc, term, impact = doc[order], term[order], impact[order]
    n_terms, (doc_nodes, item_nodes) = len(items.weight), items.sizes
    large = _maxima(doc, term, impact, doc_nodes[0], n_terms)
    n = int(large[0][-1]) + 1
    bounds = _sums(*large, items.levels[0], n, None, (1, 1), items.exact)
    edges = np.searchsorted(doc, np.arange(n + 1) * doc_nodes[0])
    for top in np.argsort(-bounds.max(1), kind="stable").tolist():
        alive = bounds[top : top + 1] >= _least(best, items.levels[0])
        part = slice(edges[top], edges[top + 1])
        d, t, v = doc[part] - top * doc_nodes[0], term[part], impact[part]
        for k in (1, 2):
            if not alive.any():
                break
            ratios = (doc_nodes[k - 1] // doc_nodes[k], item_nodes[k - 1] // item_nodes[k])
            node, own, most = _maxima(d, t, v, doc_nodes[k], n_terms) if doc_nodes[k] > 1 else (d, t, v)
            open_ = alive.any(1)[node // ratios[0]]
            found = _sums(node[open_], own[open_], most[open_], items.levels[k], int(node[-1]) + 1, alive, ratios, items.exact)
            alive = found >= _least(best, items.levels[k])
        else:
            at, item = np.nonzero(alive)
            if len(at):
                own = back[at + top * doc_nodes[0]]
                best.add(np.stack([item, found[at, item].astype(np.int64), *(x[own] for x in ids)]))


def _least(best: Best, level: Level) -> np.ndarray:
    return np.maximum(1, np.minimum.reduceat(best.weakest, level.first))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for k in range(0, len(batch), TILE):
            held.append(batch.slice(k, TILE))
            if sum(map(len, held)) >= TILE:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def indexed(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, terms, counts) of documents with terms: n of all of them, and the numbers and repeats of those in the vocabulary."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", CHUNK):
            w = terms(texts)
            n, found = np.diff(w.first), vocabulary.find(w)
            base = max(1, len(vocabulary))
            key, many = np.unique((w.doc * base + found)[found >= 0], return_counts=True)
            begin = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * base), pa.int32())
            lists = [pa.ListArray.from_arrays(begin, pa.array(x.astype(np.int32))) for x in (key % base, many)]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(index, "doc_id long, n long, terms array<int>, counts array<int>")


def _searched(rows: DataFrame, items: Hierarchy, most: int, n_docs: int, total: int, weakest: np.ndarray) -> DataFrame:
    """(place, doc_id, score): each task's best for each place in the hierarchy that reach its bound."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(most, weakest)
        row = 0
        for tile in _tiles(batches):
            many = np.diff(np.concatenate([[0], np.cumsum(tile["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]))
            if not many.sum():
                continue
            doc, term, tf = np.repeat(np.arange(len(tile)), many), _flat(tile["terms"]).astype(np.int64), _flat(tile["counts"]).astype(np.int64)
            m = 75 + 25 * tile["n"].to_numpy() * n_docs // total
            ids = tile["doc_id"].combine_chunks()
            there, number = np.asarray(ids.is_valid()).astype(np.int64), ids.fill_null(0).to_numpy()
            _visit(doc, term, 1_000_000_000 * tf // (1000 * tf + 12 * m[doc]), (there, number, row + np.arange(len(tile))), items, best)
            row += len(tile)
        best.settle()
        item, score, there, number, _ = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(number, mask=there == 0), pa.array(score)], ["place", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(find, "place long, doc_id long, score long")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(docs: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) the `most` highest-scoring documents with a score above 0.

    docs: doc_id, a whole number, and text. Equal scores go by ascending doc_id, null first; repeated rows of either table are
    documents and items of their own, so equal documents fill several ranks. Null or empty texts have no terms and find nothing;
    other columns are left out. Items are taken in blocks of about BLOCK bytes; each block is one pass over the documents and comes to the
    driver, its vocabulary and hierarchy go to the tasks. A task builds trees over the documents that it reads, so nothing of a
    document is shuffled but its place among an item's best in its task. Scores are exact: nodes are left by bounds only.
    """
    spark = docs.sparkSession
    items = written(items.select(F.monotonically_increasing_id().alias("row"), "item_id", "text").where("text IS NOT NULL"), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()  # about BLOCK bytes
        w = terms(pa.array([r["text"] for r in rows], pa.large_string()))
        vocabulary = Vocabulary(w)
        path = new_path(spark, "terms")
        own = indexed(docs, vocabulary).withColumn("seed", F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEEDS)) == 0)
        own.write.partitionBy("seed").option("compression", "zstd").parquet(path)
        own = spark.read.schema(own.schema).parquet(path)
        n_docs, total = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        within = np.zeros(len(vocabulary), np.int64)
        for term, n in own.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many as the vocabulary
            within[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in within.tolist()], np.int64)
        key, count = np.unique(w.doc * max(1, len(vocabulary)) + vocabulary.find(w), return_counts=True)
        tree = hierarchy(key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), count, weight, len(rows))
        names = spark.createDataFrame([(k, rows[n]["item_id"]) for k, n in enumerate(tree.numbers.tolist())], items.select(F.col("row").alias("place"), "item_id").schema)
        weakest = np.zeros(len(rows), np.int64)
        if len(rows):
            for place, score in _ranked(_searched(own.where("seed"), tree, most, n_docs, max(1, total), weakest), most).where(F.col("rank") == most).select("place", "score").collect():
                weakest[place] = score
        found = _ranked(_searched(own, tree, most, n_docs, max(1, total), weakest), most) if len(rows) else _ranked(spark.createDataFrame([], "place long, doc_id long, score long"), most)
        found = found.join(names, "place").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
