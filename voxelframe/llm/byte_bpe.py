"""Byte-level BPE by a table of ranks: encoding with byte offsets, and decoding."""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from voxelframe.llm._text import Words, slices, spread
from voxelframe.llm._tokens import Encoder

#: Bytes of text encoded at a time.
CHUNK = 512 << 10
#: Beyond so many bytes a piece is merged with a heap, up to then side by side with others.
SHORT = 64

# Fixed value: the pattern whose matches are encoded separately; the transitions below stand for it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What a code point does to the piece that is being read. ONE and TWO are apostrophes of contractions with one or two letters,
#: MORE is a blank before another blank or the end, GLUE a space before another character, LAST any other blank before one.
LETTER, NUMBER, OTHER, ONE, TWO, MORE, GLUE, LAST = range(8)
#: States: a piece ended, or one of letters, numbers, others or blanks goes on, or a space waits for what it is glued to, or a
#: contraction waits for one or two letters.
ENDED, LETTERS, NUMBERS, OTHERS, BLANKS, GLUED, WAIT_ONE, WAIT_TWO = range(8)
#: For each symbol: the states that it goes on in, and where it leads from these; where it leads when it starts a piece.
GOES_ON = {
    LETTER: {LETTERS: LETTERS, GLUED: LETTERS, WAIT_ONE: ENDED, WAIT_TWO: WAIT_ONE},
    NUMBER: {NUMBERS: NUMBERS, GLUED: NUMBERS},
    OTHER: {OTHERS: OTHERS, GLUED: OTHERS},
    ONE: {OTHERS: OTHERS, GLUED: OTHERS},
    TWO: {OTHERS: OTHERS, GLUED: OTHERS},
    MORE: {BLANKS: BLANKS},
    GLUE: {},
    LAST: {},
}
BEGINS = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, ONE: WAIT_ONE, TWO: WAIT_TWO, MORE: BLANKS, GLUE: GLUED, LAST: ENDED}
#: Code points that the pattern's \s takes.
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point (MORE for all blanks), and the transitions: [symbol, state] -> next state, whether a piece starts.

    Symbol + 8 is the symbol at the beginning of a text, where the state before doesn't matter.
    """
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    classes[SPACES] = MORE
    to, starts = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, onward in GOES_ON.items():
        to[[symbol, symbol + 8]] = BEGINS[symbol]
        for state, after in onward.items():
            to[symbol, state], starts[symbol, state] = after, False
    return classes, to, starts


def _code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.concatenate([raw, np.zeros(3, np.uint8)])
    point = b[lead].astype(np.int32)
    for least, mask, size in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
        k = np.flatnonzero(b[lead] >= least)
        point[k] = b[lead[k]] & mask
        for j in range(1, size):
            point[k] = (point[k] << 6) | (b[lead[k] + j] & 0x3F)
    return point, lead


def _symbols(point: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A symbol for each code point from its class and at most two after it in its text; first: whether a text begins there."""
    n = len(point)
    kind = _tables()[0][point]
    last = np.append(first[1:], True)
    blank = kind == MORE
    before_text = blank & ~last & ~np.append(blank[1:], True)
    kind[before_text] = np.where(point[before_text] == 0x20, GLUE, LAST)
    quote = np.flatnonzero((point == 0x27) & ~last)
    one, two = point[quote + 1], np.where(last[quote + 1], 0, point[np.minimum(quote + 2, n - 1)])
    kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = ONE
    pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
    kind[quote[np.any([(one == a) & (two == b) for a, b in pairs], axis=0)]] = TWO
    return kind + 8 * first.astype(np.uint8)


def _states(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, by a scan over transition functions.

    A function is the vector of states that the 8 states lead to. Functions compose associatively, so blocks of symbols are composed
    side by side, the blocks' functions are scanned in the same way, and each block is then run from its own first state.
    """
    to = _tables()[1]
    n = len(symbols)
    if n <= 64:
        out, state = np.empty(n, np.uint8), ENDED
        for k, symbol in enumerate(symbols.tolist()):
            out[k] = state
            state = to[symbol, state]
        return out
    size = int(n**0.5)
    blocks = -(-n // size)
    grid = np.full(blocks * size, LAST, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(blocks, size).T)
    flat, row = to.ravel().astype(np.intp), grid.astype(np.intp) * 8
    whole = np.tile(np.arange(8), (blocks, 1))
    for column in row:
        whole = flat.take(column[:, None] + whole)
    begin, state = np.empty(blocks, np.intp), ENDED
    for k, function in enumerate(whole.tolist()):
        begin[k] = state
        state = function[state]
    out = np.empty((size, blocks), np.uint8)
    for k, column in enumerate(row):
        out[k] = begin
        begin = flat.take(column + begin)
    return out.T.ravel()[:n]


def cut(texts: pa.Array) -> Words:
    """The matches of PATTERN in a large_string array without nulls, as slices of its bytes that leave nothing out."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    if not len(raw):
        return Words(raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends), np.int64))
    point, lead = _code_points(raw)
    first = np.zeros(len(lead), bool)
    begins = ends[:-1][ends[:-1] < ends[1:]]
    first[np.searchsorted(lead, begins)] = True
    symbols = _symbols(point, first)
    start = lead[_tables()[2][symbols, _states(symbols)]]
    return Words(raw, start, np.append(start[1:], len(raw)), np.searchsorted(start, ends))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long piece: the pair of neighbours of least rank is merged, the leftmost first, until none has one."""
    n = len(piece)
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[piece[k : k + 2]], k, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, a, to = heapq.heappop(heap)
        b = right[a] if end[a] else n
        if b >= n or end[b] != to:
            continue  # one of the two has changed since
        end[a], right[a], end[b] = to, right[b], 0
        if right[a] < n:
            left[right[a]] = a
        for p, q in ((left[a], a), (a, right[a])):
            if p >= 0 and q < n and (rank := ranks.get(piece[p : end[q]])) is not None:
                heapq.heappush(heap, (rank, p, end[q]))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : end[k]]])
        k = right[k]
    return out


class Pairs:
    """Ranks of pairs of ids, and the merging of many short pieces side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.base = max(ranks.values()) + 1
        self.none = self.base
        found = {ranks[a] * self.base + ranks[b]: rank for word, rank in ranks.items() for k in range(1, len(word)) if (a := word[:k]) in ranks and (b := word[k:]) in ranks}
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.append(np.fromiter(map(found.__getitem__, self.keys.tolist()), np.int64, len(found)), self.none)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
        self.first = self.of(np.repeat(self.single, 256), np.tile(self.single, 256))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has. In each round each piece merges its leftmost pair of least rank."""
        piece = np.repeat(np.arange(len(sizes)), sizes)
        ids = self.single[raw]
        rank = np.full(len(ids), self.none)  # of an id and the one after it
        inner = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inner] = self.first[raw[inner].astype(np.int64) * 256 + raw[inner + 1]]
        done_ids, done_pieces = [], []
        while len(ids):
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            many = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(least < self.none, many)
            done_ids.append(ids[~open_])
            done_pieces.append(piece[~open_])
            at = np.flatnonzero((rank == np.repeat(least, many)) & open_)
            at = at[np.diff(piece[at], prepend=-1) != 0]  # the leftmost of each piece
            ids[at] = rank[at]
            rank[at] = self.none
            keep = open_
            keep[at + 1] = False
            # the merged id's own pair, and that of the one before it
            after = at + 2
            has = after < len(ids)
            has[has] = piece[after[has]] == piece[at[has]]
            rank[at[has]] = self.of(ids[at[has]], ids[after[has]])
            before = at[(at > 0) & (piece[np.maximum(at - 1, 0)] == piece[at])] - 1
            rank[before] = self.of(ids[before], ids[before + 1])
            ids, piece, rank = ids[keep], piece[keep], rank[keep]
        piece = np.concatenate([np.zeros(0, np.int64), *done_pieces])
        order = np.argsort(piece, kind="stable")
        return np.concatenate([np.zeros(0, np.int64), *done_ids])[order], np.bincount(piece, minlength=len(sizes))


class RankEncoder(Encoder):
    """encode(texts): all ids of a large_string array without nulls one after the other, and how many each text has.

    Distinct pieces are merged once and remembered by their bytes; the memory is emptied when full, which costs time only.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        if any(bytes([k]) not in self.ranks for k in range(256)):
            raise ValueError(f"not every single byte has a rank: {path}")
        self.pairs = Pairs(self.ranks)
        self.size = np.zeros(self.pairs.base, np.int64)
        for word, rank in self.ranks.items():
            self.size[rank] = len(word)
        self.at_byte = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.__getitem__)), np.uint8)
        self.forget()

    def learn(self, keys: list[bytes]) -> None:
        found: list = [self.ranks.get(key) for key in keys]
        parted = [k for k, rank in enumerate(found) if rank is None]
        short = [k for k in parted if len(keys[k]) <= SHORT]
        many = np.ones(len(keys), np.int64)
        ids, counts = self.pairs.merge(np.frombuffer(b"".join(keys[k] for k in short), np.uint8), np.array([len(keys[k]) for k in short], np.int64))
        many[short] = counts
        long = {k: merged(keys[k], self.ranks) for k in parted if len(keys[k]) > SHORT}
        many[list(long)] = [len(x) for x in long.values()]
        begin = np.cumsum(many) - many
        whole, own = [k for k, rank in enumerate(found) if rank is not None], np.zeros(int(many.sum()), np.uint32)
        own[begin[whole]] = [found[k] for k in whole]
        group, inside = spread(counts)
        own[begin[short][group] + inside] = ids
        for k, x in long.items():
            own[begin[k] : begin[k] + len(x)] = x
        ids, n = own, len(self.known)
        while n + len(keys) > len(self.at):
            self.at, self.many = np.concatenate([self.at, self.at]), np.concatenate([self.many, self.many])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.many[n : n + len(keys)] = many
        self.at[n : n + len(keys)] = self.used + begin
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._cut(cut(texts))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other, and where each id's bytes end."""
        sizes = self.size[ids]
        group, inside = spread(sizes)
        return self.bytes[self.at_byte[ids][group] + inside], np.cumsum(sizes)


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    """One for each worker process."""
    return RankEncoder(path)


def _bounds(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A row of bytes for each two neighbouring ends, in items of data."""
    width = data.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64) * width), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode_documents(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """docs without `text`, with n_tokens and the binary columns `ids` and `ends`, both little-endian unsigned 32-bit numbers.

    ranks: a file with a base64 word and its rank in each line. ends: where each token ends in the text's UTF-8 bytes, so that
    any run of tokens can be decoded and placed alone. A null text is empty and has no tokens; repeated rows stay; other columns
    are kept, and must not be named n_tokens, ids or ends. A text is encoded whole, in memory of some 30 times its size. No
    shuffle takes place.
    """
    kept = [c for c in docs.columns if c != text]
    if clash := {"n_tokens", "ids", "ends"} & set(kept):
        raise ValueError(f"columns named as the result's: {sorted(clash)}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(ranks)
        for batch, texts in slices(batches, text, CHUNK):
            ids, counts = own.encode(texts)
            begin = np.concatenate([[0], np.cumsum(counts)])
            ends = np.cumsum(own.size[ids])
            before = np.concatenate([[0], ends])[begin[:-1]]
            place = (ends - np.repeat(before, counts)).astype("<u4")
            new = [pa.array(counts, pa.int64()), _binary(ids.astype("<u4", copy=False), begin), _binary(place, begin)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *new], [*kept, "n_tokens", "ids", "ends"])

    added = [StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("ends", BinaryType())]
    return docs.select(*kept, text).mapInArrow(encode, StructType([*[docs.schema[c] for c in kept], *added]))


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded with the binary column `decoded`: the bytes of the ids, which must end where `ends` says.

    A null `ids` is empty. Ids beyond the ranks and offsets that don't fit are errors.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(ranks)
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)).cast(pa.large_binary()).fill_null(b"") for c in ("ids", "ends")]
            bounds = [_bounds(c) for c in columns]
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(bounds[0], bounds[0][at] + CHUNK, "right")) - 1)
                ids, ends = (np.frombuffer(c.buffers()[2], np.uint8)[b[at] : b[to]].view("<u4") if c.buffers()[2] else np.zeros(0, "<u4") for c, b in zip(columns, bounds, strict=True))
                data, after = own.decode(ids)
                tokens = (bounds[0][at : to + 1] - bounds[0][at]) // 4
                begin = np.concatenate([[0], after])[tokens]
                if not np.array_equal(after - np.repeat(begin[:-1], np.diff(tokens)), ends):
                    raise ValueError("offsets that are not the ids'")
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, _binary(data, begin)], [*names, "decoded"])
                at = to

    return encoded.mapInArrow(decode, StructType([*encoded.schema, StructField("decoded", BinaryType())]))


def token_lists(encoded: DataFrame) -> DataFrame:
    """encoded with `ids` and `ends` as arrays of long instead of bytes."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for c in ("ids", "ends"):
                packed = columns[c].cast(pa.large_binary()).fill_null(b"")
                bounds = _bounds(packed)
                data = packed.buffers()[2]
                numbers = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].view("<u4").astype(np.int64) if data else np.zeros(0, np.int64)
                columns[c] = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]) // 4, pa.int32()), pa.array(numbers))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kinds = {c: ArrayType(LongType()) for c in ("ids", "ends")}
    return encoded.mapInArrow(listed, StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in encoded.schema]))
