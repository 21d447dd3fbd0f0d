"""Recurring lines across documents, by a fixed-depth template tree; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.llm._store import written

FIELD = "<*>"
#: Recurring leaves and templates are broadcast up to so many (24 and 56 bytes each); beyond, the lines are shuffled to them.
MOST_BROADCAST = 1_000_000


def _key(*parts: Column | str) -> Column:
    """128 bits of two hashes, so that different leaves, lines or templates don't meet by chance at any size."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _masked(line: Column) -> Column:
    """Tokens with a digit are variable fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(line)


def drop_template_lines(docs: DataFrame, depth: int = 4, least_docs: int = 3, literal: float = 0.7) -> DataFrame:
    """docs without lines whose template recurs in `least_docs` documents or more, except where it comes first.

    docs: doc_id, text and any other columns, all of which are kept; text holds the other lines as they were, joined by newlines,
    and n_lines and n_dropped are added (replacing columns of these names). Lines are parted by newlines and trimmed for
    comparison; blank lines never recur. A template comes from a tree of fixed depth: first the number of tokens, then the first `depth`
    tokens, where tokens with digits are variable fields; within a leaf, a position's token stays literal if `least_docs` documents have it
    there, and is a variable field otherwise. A line with fewer than `literal` of its tokens literal shares its
    template only with lines of the same text, digits included. A template's first line, by doc_id and place, stays, so one copy of everything is kept. A null text stays null, with no
    lines. Rows with one doc_id count as one document; rows with a null doc_id are compared with nothing.

    Only lines of leaves that recur travel, and equal ones are split once. Leaves and templates are counted after a partial aggregation, so a line that
    very many documents have is one row from each task.
    """
    kept = docs.drop("n_lines", "n_dropped")
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = source.select("doc_id", "text_key", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("doc_id", "text_key", "at", F.trim(F.regexp_replace("line", r"[\s]+", " ")).alias("line")).where("line <> ''")
    masked = lines.select("doc_id", "text_key", "at", _key("line").alias("raw_key"), _masked(F.col("line")).alias("line"))
    spaces = F.char_length("line") - F.char_length(F.replace("line", F.lit(" "))) + 1
    leaf = _key(spaces, F.substring_index("line", " ", depth))
    keyed = masked.select("doc_id", "text_key", "at", "raw_key", "line", leaf.alias("leaf"))
    many = written(_in_documents(keyed.select("leaf", "doc_id"), ["leaf"], least_docs), "leaves")
    shared = written(keyed.join(_small(many), "leaf").withColumn("line_key", _key("line")), "shared-lines")

    # equal lines are one row with the number of their documents; only lines of few documents are counted token by token
    lined = ["leaf", "line_key"]
    pairs = shared.select(*lined, "doc_id").distinct()
    docs_of = pairs.groupBy(*lined).agg(F.count("*").alias("n_docs"))
    distinct = written(shared.groupBy(*lined).agg(F.first("line").alias("line")).join(docs_of, lined), "distinct-lines")
    token = F.posexplode_outer(F.split("line", " ")).alias("k", "token")
    often = distinct.where(F.col("n_docs") >= least_docs).select("leaf", token)
    rare = distinct.where(F.col("n_docs") < least_docs).join(pairs, lined).select("leaf", "doc_id", token)
    words = ["leaf", "k", "token"]
    common = often.select(words).distinct().unionByName(_in_documents(rare, words, least_docs)).where(F.col("token") != FIELD).distinct()
    parts = distinct.select(*lined, token).join(common.withColumn("stays", F.lit(True)), words, "left")
    word = F.when(F.col("stays"), F.col("token")).otherwise(FIELD)
    templates = parts.groupBy(*lined).agg(F.array_sort(F.collect_list(F.struct("k", word.alias("word")))).alias("words"), F.count("stays").alias("n_literal"), F.count("*").alias("n"))
    filled = F.when(F.col("n_literal") >= literal * F.col("n"), _key("leaf", F.array_join(F.transform("words", lambda x: x["word"]), " ")))
    templates = templates.select(*lined, filled.alias("template"))
    own = F.coalesce("template", _key("leaf", "raw_key", F.lit("raw"))).alias("template")
    placed = written(shared.select("doc_id", "text_key", "at", "raw_key", *lined).join(templates, lined).select("doc_id", "text_key", "at", own), "templates")
    each = placed.groupBy("template", "doc_id").agg(F.min(F.struct("at", "text_key")).alias("m"))
    firsts = each.groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "m.at", "m.text_key")).alias("first")).where(F.col("docs") >= least_docs).drop("docs")
    drop = placed.join(_small(written(firsts, "recurring")), "template").where(F.struct("doc_id", "at", "text_key") != F.col("first"))
    drops = drop.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("drops"))
    drops = drops.withColumnsRenamed({"doc_id": "drop_doc", "text_key": "drop_key"})

    both = kept.join(drops, (F.col("doc_id") == F.col("drop_doc")) & (F.xxhash64("text") == F.col("drop_key")), "left")
    parts = F.split("text", "\n", -1)
    left = F.filter(F.transform(parts, lambda x, k: F.when(~F.array_contains(F.col("drops"), k), x)), lambda x: x.isNotNull())
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = [text.alias("text") if c == "text" else F.col(c) for c in kept.columns]
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(parts)), F.lit(0)).cast("long")
    return both.select(*out, n_lines.alias("n_lines"), F.coalesce(F.when(F.col("drops").isNotNull(), F.size("drops")), F.lit(0)).cast("long").alias("n_dropped"))


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its count allows; if not, the join is shuffled and its large keys are split by adaptive execution."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def _in_documents(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The keys that at least so many doc_ids have; rows are made distinct first, with a partial aggregation."""
    return rows.select(*keys, "doc_id").distinct().groupBy(*keys).agg(F.count("*").alias("docs")).where(F.col("docs") >= least).drop("docs")
