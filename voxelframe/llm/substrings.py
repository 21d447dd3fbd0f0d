"""Repeated word windows across documents, by super-k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelframe.llm._store import written
from voxelframe.llm._text import _SLOTS, BLANKS, U, Words, mix, runs, slices, spread, words

CHUNK = 2 << 20  # bytes of text in which equal windows are found before anything travels
LAST = np.iinfo(np.int64).max  # stands for a null doc_id

GRAM = 3  # words of a minimiser
HELD = 64 << 20  # bytes of a bucket's words that are compared at once
MOST = HELD  # bytes of different super-k-mers that a bucket holds; beyond, it is dealt anew by the windows themselves
DEALS = 4096  # into how many parts a bucket is dealt then

SENT = "bucket long, deal int, n int, packed binary"
FLAGS = f"doc_id long, text_hash long, spans array<int>, {SENT}"
PARCEL = {"bucket": pa.int64(), "deal": pa.int32(), "n": pa.int32(), "packed": pa.binary()}
FLAG_NAMES = ["doc_id", "text_hash", "spans", *PARCEL]


def _groups(w: Words, at: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """A number for the window that begins at each word `at`: equal for equal words alone. keys: the windows' hashes."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    group = np.zeros(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    pairs = np.flatnonzero(~new)
    x, y = at[order[pairs]], at[order[pairs - 1]]
    unlike = np.zeros(len(pairs), bool)
    for j in range(size):
        lengths = w.end[x + j] - w.start[x + j]
        unlike |= lengths != w.end[y + j] - w.start[y + j]
        piece, byte = spread(np.where(unlike, 0, lengths))
        unlike[piece[w.data[w.start[x + j][piece] + byte] != w.data[w.start[y + j][piece] + byte]]] = True
    if unlike.any():  # one hash of different words: these groups are told apart by the words themselves
        seen: dict[tuple, int] = {}
        for k in np.flatnonzero(np.isin(group, group[order[pairs[unlike]]])).tolist():
            text = tuple(w.data[w.start[at[k] + j] : w.end[at[k] + j]].tobytes() for j in range(size))
            group[k] = seen.setdefault((int(group[k]), text), len(keys) + len(seen))
    return group


def _late(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a larger doc than the smallest of their group."""
    least = np.full(group.max() + 1 if len(group) else 0, LAST)
    np.minimum.at(least, group, doc)
    return doc > least[group]


def _spans(row: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows `at` of the same row, as row, first and last word; sorted input."""
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return row[begin], at[begin], at[end] + size


def _minimisers(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Of each window that begins at a word `at`, the smallest hash of its runs of GRAM words, by doubling."""
    gram = min(GRAM, size)
    least = np.zeros(len(hashes) - gram + 1, U)
    with np.errstate(over="ignore"):
        for j in range(gram):
            least += hashes[j : len(hashes) - gram + 1 + j] * _SLOTS[j]
    least, step, many = mix(least), 1, size - gram + 1
    while 2 * step <= many:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    return np.minimum(least[at], least[at + many - step])


def _packed(owner: np.ndarray, mark: np.ndarray, begin: np.ndarray, text: bytes) -> bytes:
    return owner.astype("<i8").tobytes() + mark.astype("<i8").tobytes() + begin.astype("<i4").tobytes() + text


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), np.frombuffer(data, "<i4", n, 16 * n), data[20 * n :]


def _parcels(w: Words, first: np.ndarray, last: np.ndarray, key: np.ndarray, owner: np.ndarray, mark: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(key, n, packed) for each key of the runs of words first to last: their words, one blank after each and one more after a run."""
    squeeze = zstandard.ZstdCompressor(level=1)
    order = np.argsort(key, kind="stable")
    first, last, key, owner, mark, begin = (x[order] for x in (first, last, key, owner, mark, begin))
    many = last - first + 1
    run, place = spread(many)
    word = first[run] + place
    lengths = w.end[word] - w.start[word] + 1
    lengths[np.cumsum(many) - 1] += 1
    piece, byte = spread(lengths)
    source = w.start[word][piece] + byte
    text = np.where(source < w.end[word][piece], w.data[np.minimum(source, len(w.data) - 1)], 32).astype(np.uint8)
    ends = np.cumsum(lengths)[np.cumsum(many) - 1]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    for c, d in zip(cut, np.append(cut[1:], len(key)), strict=True):
        lo = ends[c - 1] if c else 0
        yield int(key[c]), int(d - c), squeeze.compress(_packed(owner[c:d], mark[c:d], begin[c:d], text[lo : ends[d - 1]].tobytes()))


def super_kmers(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each chunk of texts: a row for each bucket with its super-k-mers, and rows of windows already known to repeat.

    Of a window that several documents of a chunk have, only its occurrences in the smallest doc_id travel; the others
    are flagged here (bucket -1). A super-k-mer is the longest run of travelling windows with one minimiser, the smallest
    hash of GRAM words; it goes as its words, parted by one space, to the minimiser's bucket. Several words make a
    minimiser, as a single frequent word would gather most windows in one bucket.
    """
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch, texts in slices(batches, "text", CHUNK):
        w = words(texts, BLANKS, lower=False)
        hashes = w.hashes()
        at, window = runs(w, hashes, size)
        if not len(at):
            continue
        row = w.doc[at]
        ids = batch.column("doc_id").fill_null(LAST).to_numpy()
        marks = batch.column("text_hash").to_numpy()
        late = _late(_groups(w, at, window, size), ids[row])
        columns: tuple[list, ...] = ([], [], [], [])
        r, a, b = _spans(row[late], at[late] - w.first[row[late]], size)
        if len(r):
            for column, value in zip(columns, (-1, int(ids[r[0]] % (1 << 31)), len(r), squeeze.compress(_packed(ids[r], marks[r], a, b.astype("<i4").tobytes()))), strict=True):
                column.append(value)
        at, row = at[~late], row[~late]
        if len(at):
            least = _minimisers(hashes, at, size)
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
            first = np.flatnonzero(new)
            last = at[np.append(first[1:], len(at)) - 1] + size - 1  # the run's last word
            bucket = (mix(least[first] ^ U(0x1234567)) % U(buckets)).astype(np.int64)
            part = row[first]
            for key, n, parcel in _parcels(w, at[first], last, bucket, ids[part], marks[part], at[first] - w.first[part]):
                for column, value in zip(columns, (key, 0, n, parcel), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "deal", "n", "packed"]
        )


def _flagged(ids: np.ndarray, marks: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """spans: (n, 2) of each row's document; a row for each document."""
    order = np.lexsort((spans[:, 0], marks, ids))
    ids, marks, spans = ids[order], marks[order], spans[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    begin = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)) * 2, pa.int32()), pa.array(spans.ravel().astype(np.int32)))
    none = [pa.nulls(len(begin), kind) for kind in PARCEL.values()]
    return pa.RecordBatch.from_arrays([pa.array(ids[begin], pa.int64()), pa.array(marks[begin], pa.int64()), lists, *none], FLAG_NAMES)


def _dealt(bucket: int, w: Words, at: np.ndarray, keys: np.ndarray, owner: np.ndarray, mark: np.ndarray, begin: np.ndarray, size: int) -> pa.RecordBatch:
    """Windows of a full bucket, one by one, in rows by the hash of their words, which go to a task each."""
    deal = 1 + (mix(keys ^ U(0x7654321)) % U(DEALS)).astype(np.int64)
    found = list(_parcels(w, at, at + size - 1, deal, owner, mark, begin))
    columns = [pa.array(c, kind) for c, kind in zip(([bucket] * len(found), *zip(*found, strict=True)), PARCEL.values(), strict=True)]
    return pa.RecordBatch.from_arrays([*[pa.nulls(len(found), kind) for kind in (pa.int64(), pa.int64(), pa.list_(pa.int32()))], *columns], FLAG_NAMES)


def counted(batches: Iterator[pa.RecordBatch], size: int, held_bytes: int | None = None, most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Flags of each bucket's windows; rows are sorted by bucket and deal.

    A bucket is held up to HELD bytes at a time: then its windows are compared and only super-k-mers with a first occurrence are
    held on, so a bucket takes the memory of its distinct windows, however often they repeat. A bucket (deal 0) whose distinct windows take over
    `most_bytes` is full: what it holds, and each further part once that is compared in itself, goes out as rows of single windows with a deal
    of their own, to be counted in another pass.
    """
    held_bytes, most_bytes = held_bytes or HELD, most_bytes or MOST
    plain = zstandard.ZstdDecompressor()
    held: list[tuple] = []
    last, now, most, full = (-1, 0), 0, held_bytes, False
    for batch in batches:
        for bucket, deal, n, packed in zip(*(batch.column(c).to_pylist() for c in PARCEL), strict=True):
            owner, mark, begin, rest = _unpacked(n, plain.decompress(packed))
            if bucket < 0:
                yield _flagged(owner, mark, np.column_stack([begin, np.frombuffer(rest, "<i4")]))
                continue
            same = (bucket, deal) == last
            if held and (not same or now > most):
                out, rest_of = _bucket(held, size, same and not full, last[0] if full else None)
                yield from out
                held, now = ([rest_of], len(rest_of[3])) if rest_of else ([], 0)
                full = same and (full or (not deal and now > most_bytes))
                most = now + held_bytes if full else max(held_bytes, 2 * now)
            last = (bucket, deal)
            held.append((owner, mark, begin, rest))
            now += len(rest)
    if held:
        yield from _bucket(held, size, False, last[0] if full else None)[0]


def _bucket(held: list[tuple], size: int, again: bool, full: int | None = None) -> tuple[list[pa.RecordBatch], tuple]:
    """Group the windows of a bucket's super-k-mers; flags of those of documents beyond each window's smallest, and, if it's
    asked for again, the super-k-mers that have any other. Of a full bucket (its number) the other windows are rows too."""
    owner, mark, begin = (np.concatenate([x[k] for x in held]) for k in range(3))
    data = b"".join(x[3] for x in held)
    held.clear()
    # a super-k-mer ends in two blanks; every other blank ends a word
    raw = np.frombuffer(data, np.uint8)
    double = np.flatnonzero((raw[:-1] == 32) & (raw[1:] == 32)) + 2
    texts = pa.LargeStringArray.from_buffers(len(double), pa.py_buffer(np.append(0, double).astype(np.int64).tobytes()), pa.py_buffer(data))
    w = words(texts, BLANKS, lower=False)
    at, keys = runs(w, w.hashes(), size)
    kmer = w.doc[at]
    late = _late(_groups(w, at, keys, size), owner[kmer])
    r, a, b = _spans(kmer[late], at[late] - w.first[kmer[late]], size)
    out = [_flagged(owner[r], mark[r], np.column_stack([a + begin[r], b + begin[r]]))] if len(r) else []
    if full is not None:
        own, k = at[~late], kmer[~late]
        return [*out, _dealt(full, w, own, keys[~late], owner[k], mark[k], begin[k] + own - w.first[k], size)], ()
    if not again:
        return out, ()
    some = np.unique(kmer[~late])
    edges = np.append(0, double)
    return out, (owner[some], mark[some], begin[some], b"".join([data[x:y] for x, y in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True)]))


def repeated_words(docs: DataFrame, size: int = 13, buckets: int | None = None, held_bytes: int = HELD, most_bytes: int = MOST) -> DataFrame:
    """(doc_id, text, kept_text, n_words, n_removed) for each row of docs(doc_id, text).

    A window is `size` consecutive words of one text; words are parted by ASCII blanks. A word is removed if a window over it
    has the same words as one of a document with a smaller doc_id; all windows are judged on the given texts. kept_text: the
    other words, joined by one space. A null text has no words and an empty kept_text. Rows with one doc_id do not remove each
    other's words; a null doc_id counts as larger than all others. Further columns are left out. No documents give no rows.

    buckets: how many the minimisers are dealt to; by default 8 for each shuffle partition, and more if their super-k-mers, of about three times
    the texts' bytes, would fill half of HELD on average. A passage that very many documents have comes once from each chunk of texts, not once from each document. held_bytes, most_bytes: a bucket is compared in parts
    of the first size; a minimiser with more different windows than the second fills its bucket, and the rest of that bucket is dealt
    by whole windows and counted in another pass. Rows of one doc_id are told apart by a 64-bit hash of the text.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = buckets or max(8 * parts, (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * 6 // HELD)
    sent = given.mapInArrow(lambda it: super_kmers(it, size, many), SENT)

    def passed(parcels: DataFrame) -> DataFrame:
        dealt = parcels.repartition("bucket", "deal").sortWithinPartitions("bucket", "deal")
        return written(dealt.mapInArrow(lambda it: counted(it, size, held_bytes, most_bytes), FLAGS), "repeats")

    flags = passed(sent)
    full = flags.where("packed IS NOT NULL").select(*PARCEL)
    if not full.isEmpty():
        flags = flags.where("packed IS NULL").unionByName(passed(full))
    spans = flags.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnRenamed("doc_id", "id")
    key = F.coalesce("doc_id", F.lit(int(LAST)))
    rows = given.withColumn("id", key).join(spans, ["id", "text_hash"], "left").select("doc_id", "text", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 1 << 20):
            w = words(texts, BLANKS, lower=False)
            data = w.data.tobytes()
            kept, removed = [], []
            for k, s in enumerate(batch.column("spans")):
                a, b = int(w.first[k]), int(w.first[k + 1])
                keep = np.ones(b - a + 1, bool)
                if s.is_valid and b > a:
                    own = s.values.to_numpy().reshape(-1, 2)
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, own[:, 0], 1)
                    np.add.at(edge, own[:, 1], -1)
                    keep = np.cumsum(edge) <= 0
                at = np.flatnonzero(keep[: b - a]) + a
                kept.append(b" ".join([data[x:y] for x, y in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]))
                removed.append(b - a - len(at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "kept_text", "n_words", "n_removed"])

    return rows.mapInArrow(apply, "doc_id long, text string, kept_text string, n_words long, n_removed long")
