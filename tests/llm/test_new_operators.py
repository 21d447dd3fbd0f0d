"""Byte-level BPE, lexical search and the Merkle manifest on small cases."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import byte_bpe, lexical, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    own = byte_bpe.rank_encoder(queries.rank_file())
    assert public_tokenizers.PATTERN == byte_bpe.PATTERN
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids_of(texts):
    ids, counts = byte_bpe.rank_encoder(queries.rank_file()).encode(pa.array(texts, pa.large_string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_pieces_of_random_texts_are_the_librarys(library):
    random.seed(3)
    parts = ["'", "'s", "'ll", "'re", "'VE", " ", "  ", "\n", "\t ", " ", "　", "a", "b", "Z", "é", "日本", "1", "٣", "½", "!", "?!", "\U0001f600", "́", "​", "\x1c", "\x85", "v", "e", "d"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 60))) for _ in range(4000)] + ["", " ", "'", "'s", "a'", "x" * 400, "ab" * 700, " " * 500, "!?" * 300 + "x", "日本語" * 100]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_has_the_librarys_class(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = points[:0x3400] + points[0x3400::37]
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in points]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_the_scan_equals_one_step_after_another():
    rng = np.random.default_rng(0)
    to = byte_bpe._tables()[1]
    for n in (0, 1, 64, 65, 1000, 4099):
        symbols = rng.integers(0, 16, n).astype(np.uint8)
        state, want = byte_bpe.ENDED, []
        for s in symbols:
            want.append(state)
            state = to[s, state]
        assert byte_bpe._states(symbols).tolist() == want


def test_forgetting_pieces_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("voxelframe.llm._tokens.MOST_PIECES", 5)
    texts = [f"some words {k} and others" for k in range(50)]
    assert ids_of(texts) == [library.encode_ordinary(t) for t in texts]


def test_encoded_documents_decode_and_keep_offsets(spark, library):
    rows = [(1, "héllo wörld's", "x"), (2, None, "y"), (2, "", None), (None, "tail", "z"), (3, "tail", "z"), (3, "tail", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string")
    encoded = byte_bpe.encode_documents(docs, queries.rank_file())
    assert encoded.columns == ["doc_id", "place", "n_tokens", "ids", "ends"]
    found = byte_bpe.token_lists(byte_bpe.decode_documents(encoded, queries.rank_file())).collect()
    assert sorted((str(r.doc_id), r.place, r.n_tokens, bytes(r.decoded).decode()) for r in found if r.place) == sorted((str(k), p, len(library.encode_ordinary(t or "")), t or "") for k, t, p in rows if p)
    for r in found:
        data, begin = bytes(r.decoded), 0
        for token, end in zip(r.ids, r.ends, strict=True):
            assert library.decode_single_token_bytes(token) == data[begin:end]
            begin = end
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(docs.where("false"), queries.rank_file()), queries.rank_file()).count() == 0
    with pytest.raises(ValueError, match="ends"):
        byte_bpe.encode_documents(docs.withColumn("ends", F.lit(1)), queries.rank_file())
    with pytest.raises(Exception, match="offsets"):
        byte_bpe.decode_documents(encoded.withColumn("ends", F.col("ids")), queries.rank_file()).collect()


def plain_search(docs, items, most):
    import math
    import re
    from collections import Counter

    def terms(t):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    own = [(k, terms(t)) for k, t in docs]
    n_docs, total = sum(1 for _, w in own if w), sum(len(w) for _, w in own)
    df = Counter(x for _, w in own for x in set(w))
    out = []
    for item, t in items:
        scores = []
        for k, w in own:
            m, tf = 75 + 25 * len(w) * n_docs // max(1, total), Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * tf[x] // (1000 * tf[x] + 12 * m)) for x in terms(t) if tf[x])
            if s > 0:
                scores.append((-s, k))
        out += [(item, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scores)[:most])]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_search_equals_brute_force(spark, monkeypatch, block):
    """Ties, repeated rows, one block of items or several, nodes of a few documents, hashes that collide."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "DOC_NODES", (8, 2, 1))
    monkeypatch.setattr(lexical, "ITEM_NODES", (6, 2, 1))
    monkeypatch.setattr(lexical, "SEEDS", 3)
    random.seed(5)
    common, rare = [f"c{k}" for k in range(12)], [f"R{k}é" for k in range(120)]
    make = lambda n: " ".join(random.choice(common if random.random() < 0.6 else rare) for _ in range(n))
    docs = [(k, make(random.randint(1, 60))) for k in range(400)]
    docs += [(k + 400, docs[7][1]) for k in range(60)] + [(900, None), (901, "!?"), (902, ""), (903, "c1 " * 5000), (904, docs[3][1] * 40), (5, docs[9][1])]
    items = [(k, make(random.randint(1, 30))) for k in range(40)] + [(50, None), (51, "?"), (52, "unknown words"), (53, docs[7][1]), (54, docs[7][1]), (55, "c1 c1 C1")]
    # two places, so that several tasks each give their best
    got = lexical.search(spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, rank string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), most=5)
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == plain_search(docs, items, 5)


def test_search_keeps_repeated_items_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "a b"), (3, "z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "item_id long, text string")
    got = sorted((str(r.item_id), r["rank"], str(r.doc_id)) for r in lexical.search(docs, items, most=2).collect())
    assert got == sorted([("1", 1, "None"), ("1", 1, "None"), ("1", 2, "2"), ("1", 2, "2"), ("None", 1, "None"), ("None", 2, "2")])
    assert lexical.search(docs.where("false"), items, most=2).count() == 0 == lexical.search(docs, items.where("false"), most=2).count()


def test_terms_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical.Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64))
    w = lexical.terms(pa.array(["ab cd", "x yz zz"], pa.large_string()))
    vocabulary = lexical.Vocabulary(w)
    found = vocabulary.find(lexical.terms(pa.array(["cd zz ab q x yz cc"], pa.large_string())))
    data = vocabulary.data.tobytes()
    assert [data[vocabulary.start[k] : vocabulary.end[k]].decode() if k >= 0 else None for k in found] == ["cd", "zz", "ab", None, "x", "yz", None]


def test_sums_beyond_a_doubles_whole_numbers_are_exact():
    level = lexical.Level.of(np.array([0, 1]), np.array([0, 0]), np.array([2**40 + 1, 3]), 2, 1, 1)
    found = lexical._sums(np.array([0, 0]), np.array([0, 0]), np.array([2**20 + 1, 1]), level, 1, None, (1, 1), exact=False)
    assert found.tolist() == [[(2**40 + 1) * (2**20 + 2), 3 * (2**20 + 2)]]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def top_of(level):
    while len(level) > 1:
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("sizes", [[1], [1, 2], [3, 64, 65], [130, 1, 5, 4097]])
def test_proofs_fold_to_the_root_of_a_plain_tree(spark, sizes):
    langs = [None, "a", "b", "é"][: len(sizes)]
    rows = [(1000 * g + k, f"t{k}", lang, "s", k) for g, (lang, n) in enumerate(zip(langs, sizes, strict=True)) for k in range(n)]
    random.seed(1)
    random.shuffle(rows)
    leaves, trees, top = merkle.manifest(spark.createDataFrame(rows, DOCS))
    own = {g: [h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1]))) for r in sorted(rows) if r[2] == lang] for g, lang in enumerate(langs)}
    root = top_of([top_of(v) for v in own.values()])
    asked = leaves.select("grp", "place", F.col("leaf").alias("claim"))
    found = merkle.proofs(trees, top, asked).select("grp", "place", "leaf", "root", "subroot", merkle.folded(F.col("claim"), F.col("path")).alias("up")).collect()
    assert {(r.grp, r.place, r.leaf, r.root, r.subroot, r.up) for r in found} == {(g, k, x, root, top_of(v), root) for g, v in own.items() for k, x in enumerate(v)}
    assert len(found) == len(rows)


def test_only_the_leaves_asked_for_are_proved(spark):
    rows = [(k, f"t{k}", "a", "s", k) for k in range(300)]
    _, trees, top = merkle.manifest(spark.createDataFrame(rows, DOCS))
    asked = spark.createDataFrame([(0, 5, "x"), (0, 5, "x"), (0, 5, "y"), (0, 299, None), (0, 300, None), (7, 0, None)], "grp long, place long, claim string")
    found = sorted((r.place, str(r.claim), len(r.path)) for r in merkle.proofs(trees, top, asked).collect())
    assert found == [(5, "x", 9), (5, "y", 9), (299, "None", 9)]


def test_manifest_of_nulls_repeated_rows_and_nothing(spark):
    rows = [(None, None, None, None, None)] * 70 + [(1, "", "", "s", 0), (1, "", "", "s", 0), (1, "x", "", None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit(1)).withColumn("place", F.lit(2)).withColumn("grp", F.lit("g"))
    leaves, trees, top = merkle.manifest(docs)
    asked = leaves.select("grp", "place", F.col("leaf").alias("claim"))
    found = merkle.proofs(trees, top, asked).select("root", merkle.folded(F.col("claim"), F.col("path")).alias("up")).collect()
    assert len(found) == 73 and all(r.up == r.root for r in found) and len({r.root for r in found}) == 1
    leaves, trees, top = merkle.manifest(docs.where("false"))
    assert leaves.count() == 0 == merkle.proofs(trees, top, leaves.select("grp", "place", F.col("leaf").alias("claim"))).count()


def test_a_record_that_is_not_its_parents_is_an_error(spark):
    rows = [(k, f"t{k}", "a", "s", k) for k in range(200)]
    leaves, trees, top = merkle.manifest(spark.createDataFrame(rows, DOCS))
    trees.layers[0] = trees.layers[0].withColumn("children", F.reverse("children"))
    with pytest.raises(Exception, match="parent names"):
        merkle.proofs(trees, top, leaves.select("grp", "place", F.col("leaf").alias("claim"))).collect()
