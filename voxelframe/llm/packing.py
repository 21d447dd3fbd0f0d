"""Packing of documents' token ids into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm._store import written
from voxelframe.llm.token_files import encoded

#: Patterns offered to the fit, the most documents in one, the fit's steps, and how often what remains is fitted anew; all bound the driver's work whatever the corpus.
MOST_PATTERNS, WIDTH, STEPS, ROUNDS = 40_000, 6, 400, 8
#: About so many pieces of one length are numbered in one task.
LANE = 2_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents' ids with end_id last, cut only beyond capacity.

    A null text is empty and gives one piece with end_id. Further columns of docs are left out.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, begin in encoded(batches, tokenizer, end_id):
            many = np.maximum(1, -(-np.diff(begin) // capacity))
            doc = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            at = begin[doc] + start
            length = np.minimum(capacity, begin[doc + 1] - at)
            raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:  # pieces of a batch follow each other without gaps
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def patterns(counts: np.ndarray) -> np.ndarray:
    """Length patterns of up to WIDTH documents that fill a sequence well; rows of lengths from large to small, 0 for none.

    counts[n]: pieces of length n; the capacity is len(counts) - 1. Lengths of two out of three patterns are enumerated in even steps of the
    histogram's own distribution, each among those that still fit, and those of one in three in even steps of the lengths there are, so rare
    ones have patterns too; the last is the largest present one that fits. Patterns of least waste are offered, one of each content.
    """
    capacity = len(counts) - 1
    there = counts > 0
    there[0] = False
    floor = np.maximum.accumulate(np.where(there, np.arange(capacity + 1), 0))  # largest present length up to n
    rows = []
    for share, weights in ((2, counts * there), (1, there.astype(np.int64))):
        upto = np.cumsum(weights)
        n = share * MOST_PATTERNS
        room, own = np.full(n, capacity), np.zeros((n, WIDTH), np.int64)
        step = np.arange(1, n + 1)
        for j in range(WIDTH):
            at = (step * (2.0 ** ((j + 1) / (WIDTH + 1)))) % 1.0  # multiples of irrational numbers lie evenly in all places together
            if j == WIDTH - 1:
                drawn = floor[room]
            else:
                drawn = np.searchsorted(upto, np.floor(at * upto[room]), "right")
                # a place is the last one as soon as a present length fills the room
                drawn = np.where(floor[room] == room, np.where(at < 1 / (WIDTH - j), room, drawn), np.where(room > 0, drawn, 0))
                drawn = np.where(floor[room] > 0, np.minimum(drawn, room), 0)
            own[:, j] = drawn
            room = room - drawn
        rows.append(own)
    found = np.unique(-np.sort(-np.concatenate(rows), axis=1), axis=0)
    found = found[found[:, 0] > 0]
    waste = capacity - found.sum(1)
    order = np.lexsort((np.arange(len(found)) * 2654435761 % (1 << 32), waste))  # equal waste: an even mixture
    return found[order[:MOST_PATTERNS]]


def fit(found: np.ndarray, counts: np.ndarray, steps: int) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared distance of the patterns' lengths from the histogram.

    Accelerated projected gradients; the patterns are kept as lists of lengths, so a step is a gather and a sum.
    """
    goal = counts.astype(float)
    goal[0] = 0

    def lengths(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(found[:, j], weights=x, minlength=len(counts)) for j in range(found.shape[1]))
        total[0] = 0
        return total

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[found[:, j]] for j in range(found.shape[1]))

    norm, x = 1.0, np.ones(len(found))
    for _ in range(20):
        y = back(lengths(x))
        norm = np.linalg.norm(y) / max(np.linalg.norm(x), 1e-300)
        x = y / max(np.linalg.norm(y), 1e-300)
    x = ahead = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - back(lengths(ahead) - goal) / max(norm, 1e-300))
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, x, t = new + (t - 1) / later * (new - x), new, later
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how often) using each length exactly as often as the histogram says.

    Three ways are tried and the one with the fewest sequences is taken: all fitted patterns, only those whose waste no
    piece could fill, and none (short pieces go many to a sequence, patterns have three); among equals the first. Fitted patterns are
    rounded as far as pieces remain, and what remains is fitted anew with the patterns that it still allows, ROUNDS times at most; the rest
    goes by best fit, also into the patterns' free places. The work depends on the capacity, not on the number of pieces.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    full = int(left[capacity])
    left[capacity] = 0
    best: Counter = Counter()
    if left.any():
        found = patterns(left)
        waste = capacity - found.sum(1)
        tight = found[waste < np.flatnonzero(left)[0]]
        ways = [found, tight, found[:0]] if len(tight) < len(found) else [found, found[:0]]
        best = min((_filled(left, way) for way in ways), key=lambda out: out.total())
    if full:
        best[(capacity,)] += full
    return list(best.items())


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers with the sum of x up to any place kept within one half, so weights spread over many patterns don't all become 0."""
    return np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0).astype(np.int64)


def _filled(counts: np.ndarray, found: np.ndarray) -> Counter:
    """Sequences and how often: by the patterns found, those of least waste first, then by best fit."""
    capacity = len(counts) - 1
    left = counts.copy()
    room: dict[int, Counter] = defaultdict(Counter)  # free places -> bins
    waste = capacity - found.sum(1)
    for turn in range(ROUNDS):
        need = np.stack([(found == found[:, [j]]).sum(1) for j in range(found.shape[1])], axis=1) if len(found) else found
        found = found[((left[found] >= need) | (found == 0)).all(1)]
        if not len(found):
            break
        x = fit(found, left, STEPS if not turn else STEPS // 4)
        waste = capacity - found.sum(1)
        placed = 0
        order = np.lexsort((-x, waste))
        for k, n in zip(order.tolist(), rounded(x[order]).tolist(), strict=True):
            if not n:
                continue
            content = tuple(v for v in sorted(found[k].tolist(), reverse=True) if v)
            often = min(n, *(int(left[v]) // content.count(v) for v in content))
            if often > 0:
                room[capacity - sum(content)][content] += often
                placed += often
                for v in content:
                    left[v] -= often
        if not placed:
            break
    return _best_fit(left, room)


def _best_fit(left: np.ndarray, room: dict[int, Counter]) -> Counter:
    """The bins in `room` and new ones with what is left, largest first, each into the bin with least free places; bins of equal
    content are handled at once."""
    capacity = len(left) - 1
    free = np.zeros(capacity + 1, bool)
    free[[n for n in room if n]] = True
    for n in np.flatnonzero(left)[::-1].tolist():
        many = int(left[n])
        while many:
            fits = n + int(np.argmax(free[n:])) if free[n:].any() else capacity
            bins = room[fits] if free[fits] else Counter({(): -(-many // (capacity // n))})
            content, often = next(iter(bins.items()))
            each = min(fits // n, many)
            moved = min(often, many // each)
            bins[content] -= moved
            if not bins[content]:
                del bins[content]
            free[fits] = bool(bins) and bool(content)
            rest = fits - each * n
            room[rest][content + (n,) * each] += moved
            free[rest] = rest > 0
            many -= moved * each
    out: Counter = Counter()
    for bins in room.values():
        for content, often in bins.items():
            if often and content:
                out[content] += often
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank beyond the last, first sequence, offset) for each place of each pattern."""
    used: Counter = Counter()
    out, sequence = [], 0
    for content, often in planned:
        offset = 0
        for n in content:
            out.append((n, used[n], used[n] + often, sequence, offset))
            used[n] += often
            offset += n
        sequence += often
    return out


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """parts(doc_id, piece, length, ids_crc32, ...) with sequence_id and offset: places without gaps from 0.

    Only the histogram of lengths comes to the driver (capacity + 1 numbers); what goes back out is the plan's table of
    places, whose size depends on the capacity alone. Pieces of one length are numbered in lanes of about LANE pieces with counted
    offsets, so a length that many pieces share is not one task. Full pieces are sequences of their own and aren't
    numbered at all. `parts` is read three times and should be a written table.
    """
    spark = parts.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    counts[capacity] = 0
    planned = plan(counts)
    places = spark.createDataFrame(slots(planned) or [(0, 0, 0, 0, 0)], "length long, low long, high long, first long, offset long")
    lanes = int(-(-counts.max() // LANE)) or 1
    rows = parts.where(F.col("length") < capacity).withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes)))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "lane").count().select("length", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("place", F.row_number().over(order)).join(bases, ["length", "lane"])
    rank = F.col("base") + F.col("place") - 1
    placed = ranked.withColumn("rank", rank).join(F.broadcast(places), "length").where("rank >= low AND rank < high")
    placed = placed.select(*parts.columns, (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("offset"))
    full = parts.where(F.col("length") == capacity)
    own = F.monotonically_increasing_id() + sum(often for _, often in planned)
    return placed.unionByName(full.select(*parts.columns, own.alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) with their places; see pieces() and pack(). No documents give no rows.

    Repeated rows are documents of their own; null ids are kept.
    """
    return pack(written(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)
