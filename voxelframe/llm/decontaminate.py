"""Benchmark passages in documents, by winnowed fingerprints; built-in functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm._store import written

GRAM = 4  # words of a fingerprint
PARTS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Fingerprints, and the words of items, are broadcast up to so many bytes each; beyond, both sides are shuffled, and large keys are split by
#: adaptive execution. A fingerprint takes FINGERPRINT bytes there, a word 16 and its own.
MOST_BROADCAST, FINGERPRINT = 64 << 20, 64


def words_of(text: Column) -> Column:
    """Words of digits, letters and all beyond ASCII, with A-Z lower-cased; no words for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    parts = F.split(lower, PARTS, -1)
    return F.filter(parts, lambda x: x != "")


def _with(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used, even if the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(many: Column) -> Column:
    """0, 1, ... so many; none for a number below 1."""
    return F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))


def _grams(words: Column) -> Column:
    """Hash of each GRAM consecutive words."""
    return F.transform(
        _places(F.size(words) - GRAM + 1),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]),
    )


def _marked(grams: Column, width: int) -> Column:
    """(fp, at) of each hash that is the smallest of some `width` consecutive ones around it."""

    def marked(g: Column) -> Column:
        lows = F.transform(_places(F.size(g) - width + 1), lambda i: F.least(*[F.get(g, i + j) for j in range(width)]))
        # a hash is marked if the largest of the minima around it is itself; places beyond the ends are null, which `greatest` skips
        around = lambda low, h, i: F.when(F.greatest(*[F.get(low, i - j) for j in range(width)]) == h, F.struct(h.alias("fp"), i.alias("at")))
        return _with(lows, lambda low: F.filter(F.transform(g, lambda h, i: around(low, h, i)), lambda x: x.isNotNull()))

    return _with(grams, marked)


def _heads(words: Column, sizes: list[int]) -> Column:
    """(fp, at) of each run of so many words."""

    def runs(w: Column, n: int) -> Column:
        return F.transform(_places(F.size(w) - n + 1), lambda i: F.struct(F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)]).alias("fp"), i.alias("at")))

    return _with(words, lambda w: F.concat(*[runs(w, n) for n in sizes]))


def _runs(there: Column, own: Column, least: Column) -> Column:
    """[at, to) of the runs of at least so many places where two arrays agree; where one has ended they don't."""
    breaks = F.filter(F.sequence(F.lit(0), F.size(own)), lambda i: ~F.get(there, i).eqNullSafe(F.get(own, i)) | (i == F.size(own)))
    return _with(breaks, lambda b: F.filter(F.transform(b, lambda x, k: F.struct(F.coalesce(F.get(b, k - 1) + 1, F.lit(0)).alias("at"), x.alias("to"))), lambda r: r["to"] - r["at"] >= least))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, item_ids) for each row of docs(doc_id, text) against items(item_id, text).

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window. spans: [at, to) of
    words that occurrences of windows cover, in order and possibly overlapping; item_ids: the items with occurrences, sorted as strings.
    Both are empty where nothing occurs; null texts have no words. Rows with one doc_id and different texts are judged by
    themselves. A null item_id is left out of item_ids, but its windows count. Further columns are left out.

    Both sides keep the smallest GRAM-word hash of each size - GRAM + 1 consecutive ones with its place, so a shared window shares a kept
    hash at the same place of it. Where fingerprints meet, the two places fix how the item lies in the document; the hit is
    extended there word for word, in a piece of the document no longer than the item, and runs of `size` words or more count. Shorter
    items meet by a hash of all their words. What is joined is a row for each fingerprint, without texts. Items of equal words are looked for
    once; their ids come back at the end.
    """
    width = size - GRAM + 1
    item = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    item = item.groupBy("w").agg(F.collect_set("item_id").alias("ids"))  # items of equal words are one from here on
    item = written(item.withColumn("number", F.monotonically_increasing_id()), "items")
    short = item.where(F.size("w") < size)
    sizes = sorted(r["n"] for r in short.select(F.size("w").alias("n")).distinct().collect())  # fewer than `size` numbers
    place = lambda rows, marks: rows.select("number", F.size("w").alias("n"), F.explode(marks).alias("p")).select("number", "n", "p.fp", F.col("p.at").alias("own"))
    prints = written(place(item.where(F.size("w") >= size), _marked(_grams(F.col("w")), width)), "prints")
    taken = item.agg(F.sum(F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + 16 + F.octet_length(x)) + F.aggregate("ids", F.lit(0).cast("long"), lambda n, x: n + 16 + F.octet_length(x)))).first()[0] or 0
    few_items, few_prints = taken <= MOST_BROADCAST, (prints.count() + short.count()) * FINGERPRINT <= MOST_BROADCAST
    small = lambda df, few: F.broadcast(df) if few else df

    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    words = words_of(F.col("text"))
    meets = lambda marks, known: given.select("doc_id", "text_hash", F.explode_outer(marks).alias("p")).select("doc_id", "text_hash", "p.fp", "p.at").join(small(known, few_prints), "fp")
    met = meets(_with(words, lambda w: _marked(_grams(w), width)), prints)
    if sizes:
        whole = lambda n: short.where(F.size("w") == n).select("number", F.lit(n).alias("n"), F.xxhash64(F.lit(n), *[F.get("w", F.lit(j)) for j in range(n)]).alias("fp"), F.lit(0).alias("own"))
        known = whole(sizes[0])
        for n in sizes[1:]:
            known = known.unionByName(whole(n))
        met = met.unionByName(meets(_heads(words, sizes), known))
    lies = met.select("doc_id", "text_hash", "number", "n", (F.col("at") - F.col("own")).alias("from")).distinct()

    per = lies.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("number", "n", "from")).alias("lies")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "lies")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))

    def pieces(w: Column) -> Column:
        """Of each place where an item lies: the document's words there, and blanks where the item begins before the document."""
        before = lambda x: F.greatest(-x["from"], F.lit(0))
        there = lambda x: F.concat(F.array_repeat(F.lit(""), before(x).cast("int")), F.slice(w, F.greatest(x["from"], F.lit(0)) + 1, x["n"] - before(x)))
        return F.transform("lies", lambda x: F.struct(x["number"].alias("number"), x["from"].alias("from"), there(x).alias("there")))

    hit = given.join(per, same).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode(_with(words, pieces)).alias("x")).select("doc_id", "text_hash", "x.*")
    runs = hit.join(small(item.select("number", "ids", "w"), few_items), "number")
    runs = runs.select("doc_id", "text_hash", "ids", "from", F.explode(_runs(F.col("there"), F.col("w"), F.least(F.lit(size), F.size("w")))).alias("r"))
    span = F.struct((F.col("from") + F.col("r.at")).alias("at"), (F.col("from") + F.col("r.to")).alias("to"))
    per = runs.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    per = per.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans", "item_ids")
    every = given.select("doc_id", "text_hash", F.size(words).cast("long").alias("n_words"))
    none = F.array().cast("array<struct<at:int,to:int>>")
    return every.join(per, same, "left").select("doc_id", "text_hash", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def hit_words(spans: Column) -> Column:
    """How many words sorted spans cover together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(total: Column, s: Column) -> Column:
        return F.struct((total["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(s["at"], total["end"]))).alias("n"), F.greatest(total["end"], s["to"]).alias("end"))

    return F.aggregate(spans, start, add)["n"].cast("long")
