"""Language identification: the family first, then the languages inside it."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelframe.llm._text import LOWER, slices

#: Families of languages by code; a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "ar he mt",
}
ORDERS, BITS = (2, 3, 4), 11
WIDTH = len(ORDERS) << BITS
CHUNK, ROWS = 512 << 10, 128  # bytes of text, and texts, that are vectors at once
_LETTERS = LOWER.copy()  # all that isn't a letter parts words
_LETTERS[[*range(0, 65), *range(91, 97), *range(123, 128)]] = 32


def family(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v.split()), lang)


def _grams(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each text ends, and for each order the hashed n-grams of bytes at each place and whether they stay in one text."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.zeros(0, np.uint8)
    data, ends = _LETTERS[data].astype(np.uint32), ends - ends[0]
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    out = []
    for k, n in enumerate(ORDERS):
        size = max(0, len(data) - n + 1)
        code = np.zeros(size, np.uint32)
        for j in range(n):
            code |= data[j : j + size] << np.uint32(8 * j)
        with np.errstate(over="ignore"):
            code = (code * np.uint32(2654435761)) ^ (code >> np.uint32(15)) * np.uint32(2246822519)
            code = (code * np.uint32(3266489917)) >> np.uint32(32 - BITS)
        out.append((code.astype(np.int64) + (k << BITS), doc[:size] == doc[n - 1 :] if size else np.zeros(0, bool)))
    return ends, out


def _vectors(texts: pa.Array) -> np.ndarray:
    """Shares of each hashed n-gram, a row for each text."""
    ends, grams = _grams(texts)
    out = np.zeros((len(texts), WIDTH), np.float32)
    for d in range(len(texts)):
        part = slice(int(ends[d]), int(ends[d + 1]))
        own = np.concatenate([codes[part][inside[part]] for codes, inside in grams])
        out[d] = np.bincount(own, minlength=WIDTH) / max(1.0, float(ends[d + 1] - ends[d]))
    return out


def _has_letter(texts: pa.Array) -> np.ndarray:
    plain = pa.compute.match_substring_regex(texts, "[A-Za-z]").to_numpy(zero_copy_only=False).astype(bool)
    for k in np.flatnonzero(~plain):
        plain[k] = any(c.isalpha() for c in texts[int(k)].as_py())
    return plain


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss on some rows of x; y is -1 or 1, both sides
    weigh the same. One copy of these rows is made, in single precision."""
    blocks = [rows[k : k + 64] for k in range(0, len(rows), 64)]
    mean = sum(x[b].sum(0, dtype=float) for b in blocks) / len(rows)
    scale = np.sqrt(sum(((x[b] - mean) ** 2).sum(0) for b in blocks) / len(rows)) + 1e-5
    z = np.ones((len(rows), x.shape[1] + 1), np.float32)
    for k, b in enumerate(blocks):
        z[64 * k : 64 * k + len(b), :-1] = (x[b] - mean) / (scale * np.sqrt(x.shape[1]))
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    step = 0.5 / max(1e-12, float((weight * np.einsum("ij,ij->i", z, z)).sum()) + penalty)
    w = ahead = np.zeros(z.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        new = ahead - np.float32(step) * (np.float32(penalty) * ahead - 2 * ((weight * slack * y) @ z))
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + np.float32((t - 1) / later) * (new - w), new, later
    own = w[:-1] / scale / np.sqrt(x.shape[1])
    return own, float(w[-1] - own @ mean)


class Model:
    """Machines for each two families and for each two languages of one family."""

    def __init__(self, x: np.ndarray, langs: list[str], order: list[int]) -> None:
        """x: a row for each of langs; they are taken in the given order."""
        names = np.array(langs)
        kin = np.array([family(v) for v in langs])
        self.langs, self.families = sorted(set(langs)), sorted(set(kin.tolist()))
        self.of = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        self.pairs = [(kin, a, b) for a, b in itertools.combinations(self.families, 2)] + [(names, a, b) for f in self.families for a, b in itertools.combinations(self.of[f], 2)]
        fits = []
        for by, a, b in self.pairs:
            rows = np.array([k for k in order if by[k] in (a, b)], int)
            fits.append(svm(x, rows, np.where(by[rows] == a, 1.0, -1.0)))
        self.weights = np.array([w for w, _ in fits]).T.reshape(WIDTH, len(fits)) if fits else np.zeros((WIDTH, 0))
        self.bias = np.array([b for _, b in fits])
        self.names = [(a, b) for _, a, b in self.pairs]
        del self.pairs

    def _chosen(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of the machines between these names: most votes, then largest sum of margins; and how sure the weakest won machine is."""
        votes, least = np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
        pairs = list(itertools.combinations(range(len(names)), 2))
        own = [self.names.index((names[a], names[b])) for a, b in pairs]
        margins = x @ self.weights[:, own] + self.bias[own]
        for (a, b), m in zip(pairs, margins.T, strict=True):
            for k, own in ((a, m), (b, -m)):
                votes[:, k] += (own > 0) + 1e-3 * np.tanh(own)
                least[:, k] = np.minimum(least[:, k], own)
        best = votes.argmax(1)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(best)), best], -20, 20)))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        out, score = np.empty(len(texts), object), np.zeros(len(texts))
        for at in range(0, len(texts), ROWS):
            x = _vectors(texts.slice(at, ROWS)).astype(float)
            kin, sure = self._chosen(x, self.families)
            for k, f in enumerate(self.families):  # only the machines of the family that was chosen
                own = np.flatnonzero(kin == k)
                lang, inner = self._chosen(x[own], self.of[f])
                out[at + own] = np.array(self.of[f], object)[lang]
                score[at + own] = sure[own] * inner
        letters = _has_letter(texts)
        out[~letters] = "und"
        return out.tolist(), np.where(letters, score, 0.0)


def held_out() -> F.Column:
    """Documents never learnt from: crc32 of doc_id as text is a multiple of 5. False for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, most: int = 300) -> Model:
    """Learn from at most `most` labelled documents of each language, the first by a hash of doc_id.

    docs: doc_id, text, lang. Only rows with all three and a remainder other than 0 are learnt from. The bound keeps what the
    driver gathers (`most` rows of WIDTH numbers for each language) the same at every size; whole texts are read. Rows that repeat
    doc_id, lang and text are one.
    """
    given = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash"))
    key = ["lang", "doc_id", "text_hash"]
    rows = given.select(*key, F.xxhash64("doc_id").alias("h"))
    for by in (["lang", F.pmod("h", F.lit(64))], ["lang"]):
        rows = rows.withColumn("n", F.dense_rank().over(Window.partitionBy(*by).orderBy("h", "doc_id", "text_hash"))).where(F.col("n") <= most).drop("n").distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([v.tobytes() for v in _vectors(texts)], pa.binary())], ["lang", "v"])

    chosen = given.join(F.broadcast(rows.select(key)), key, "left_semi").dropDuplicates(key)  # at most `most` rows a language
    found = chosen.mapInArrow(vectors, "lang string, v binary").toArrow()
    x, langs = np.empty((len(found), WIDTH), np.float32), found.column("lang").to_pylist()
    for k, v in enumerate(found.column("v")):
        x[k] = np.frombuffer(v.as_buffer(), np.float32)
    del found
    pa.default_memory_pool().release_unused()  # the driver goes on with one copy
    order = sorted(range(len(langs)), key=lambda k: (langs[k], hashlib.sha1(x[k]).digest()))  # rows come in any order
    return Model(x, langs, order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (0 to 1), from the whole text alone.

    `und` and 0 where text is null or has no letter, or where nothing was learnt. All columns of docs are kept but those two
    names, which are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a column of WIDTH numbers for each two languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", CHUNK):
            langs, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(predict, schema)
