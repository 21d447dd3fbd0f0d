"""Ids of a public tokenizer for whole texts, with a memory of pieces already encoded."""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import pyarrow as pa

from voxelframe.llm._text import LOWER, U, Words, mix, spread

#: Of a worker's memory of pieces; it is emptied when full, which costs time only.
MOST_PIECES = 200_000

# The parts of a tokenizer file that the byte classes below stand for; a file that differs anywhere goes whole to the library.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
KNOWN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
BLANK, LETTER, NUMBER, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[48:58] = NUMBER
_CLASS[65:91] = _CLASS[97:123] = LETTER
_AFTER_C2 = np.full(256, OTHER, np.uint8)
_AFTER_C2[[0xAA, 0xB5, 0xBA]] = LETTER
_AFTER_C2[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
_AFTER_C3 = np.full(256, LETTER, np.uint8)
_AFTER_C3[[0x97, 0xB7]] = OTHER
_ODD = np.zeros(256, bool)
_ODD[0x1C:0x20] = _ODD[0xC4:] = True


class Encoder:
    """encode(texts): all ids of a large_string array without nulls one after the other, and how many each text has.

    For a file with all the parts above and no added tokens but those beginning with "<|", texts in Latin-1 without that mark and
    rare separators are lower-cased and cut into the pattern's pieces on their bytes. The library encodes each
    distinct piece once; as it encodes pieces independently, the ids are its own. Pieces are told apart by their bytes. Every
    other text, and every other file, goes whole to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")}
        added = [x["content"] for x in spec.get("added_tokens") or []]
        self.cuts = all(spec.get(k) == v for k, v in KNOWN.items()) and model == KNOWN_MODEL and all(x.startswith("<|") for x in added)
        mark = spec["model"].get("end_of_word_suffix") or "\0"
        self.last = np.zeros(self.whole.get_vocab_size(), bool)
        self.last[[v for k, v in spec["model"]["vocab"].items() if k.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(1 << 16, np.int64)  # of each known piece, in ids
        self.many = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, np.uint32) for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: list[bytes]) -> None:
        pieces = [k.decode("utf-8", "replace") for k in keys]
        joined = self.library([" ".join(pieces[k : k + 1000]) for k in range(0, len(pieces), 1000)])
        ids = np.concatenate(joined)
        ends = np.flatnonzero(self.last[ids]) + 1  # a piece's last id, and no other, carries the end mark
        if len(ends) != len(pieces):
            alone = self.library(pieces)
            ids, ends = np.concatenate(alone), np.cumsum([len(x) for x in alone])
        n = len(self.known)
        while n + len(keys) > len(self.at):
            self.at, self.many = np.concatenate([self.at, self.at]), np.concatenate([self.many, self.many])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.many[n : n + len(keys)] = np.diff(ends, prepend=0)
        self.at[n : n + len(keys)] = self.used + ends - self.many[n : n + len(keys)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            parts = self.library(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)
        w, odd = _pieces(texts)
        ids, counts = self._cut(w)
        for k in np.flatnonzero(odd)[::-1]:
            own, at = self.library([texts[int(k)].as_py()])[0], int(counts[:k].sum())
            ids = np.concatenate([ids[:at], own, ids[at + counts[k] :]])
            counts[k] = len(own)
        return ids, counts

    def _cut(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(w.first) - 1, np.int64)
        hashes = w.hashes()
        while True:
            _, sample, place = np.unique(hashes, return_index=True, return_inverse=True)
            odd = _differing(w, sample[place])
            if not len(odd):
                break
            hashes[odd] = mix(hashes[odd] + U(0x9E3779B97F4A7C15))  # other bytes, one hash: another number for them
        data = w.data.tobytes()
        listed = [data[a:b] for a, b in zip(w.start[sample].tolist(), w.end[sample].tolist(), strict=True)]
        if len(self.known) + len(listed) > MOST_PIECES:
            self.forget()
        if new := [key for key in listed if key not in self.known]:
            self.learn(new)
        slot = np.fromiter(map(self.known.__getitem__, listed), np.int64, len(listed))[place]
        many = self.many[slot]
        group, inside = spread(many)
        before = np.concatenate([[0], np.cumsum(many)])
        return self.ids[self.at[slot][group] + inside], np.diff(before[w.first])


def _differing(w: Words, like: np.ndarray) -> np.ndarray:
    """The words whose bytes are not those of the words `like`."""
    lengths = w.end - w.start
    short = lengths != lengths[like]
    group, place = spread(np.where(short, 0, lengths))
    unequal = w.data[w.start[group] + place] != w.data[w.start[like[group]] + place]
    return np.unique(np.concatenate([np.flatnonzero(short), group[unequal]]))


def _pieces(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Pieces of the lower-cased bytes, and which texts must go to the library; these have no pieces."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    n = len(raw)
    data = LOWER[raw]
    kind = _CLASS[data]
    bad = _ODD[raw]
    second = np.flatnonzero((raw[:-1] == 0xC2) | (raw[:-1] == 0xC3)) + 1
    if len(second):
        at, lead = raw[second], raw[second - 1]
        kind[second] = kind[second - 1] = np.where(lead == 0xC2, _AFTER_C2[at], _AFTER_C3[at])
        data[second[(lead == 0xC3) & (at >= 0x80) & (at <= 0x9E) & (at != 0x97)]] += 0x20
        bad[second[(lead == 0xC2) & ((at == 0x85) | (at == 0xA0))]] = True
    bad[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(ends, np.flatnonzero(bad), "right") - 1] = True

    start = kind != BLANK
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    begins = ends[:-1][ends[:-1] < n]
    start[begins] = kind[begins] != BLANK
    start[second] = False  # a character's second byte
    edge = np.zeros(n + 1, bool)  # where a piece can't go on
    edge[:n] = kind == BLANK
    edge[ends] = True
    quotes = np.flatnonzero((data == 39) & start)
    for tail in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        at = quotes[quotes + len(tail) < n]
        for j, letter in enumerate(tail):
            at = at[(data[at + 1 + j] == letter) & ~edge[at + 1 + j]]
        start[at + 1] = False
        after = at + 1 + len(tail)
        after = after[after < n]
        start[after[kind[after] == LETTER]] = True
    edge[:n] |= start
    edges = np.flatnonzero(edge)
    first = np.flatnonzero(start)
    if odd.any():
        first = first[~odd[np.searchsorted(ends, first, "right") - 1]]
    return Words(data, first, edges[np.searchsorted(edges, first, "right")], np.searchsorted(first, ends)), odd


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
