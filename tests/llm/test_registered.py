"""The registered queries over a folder of small tables: every column of their contracts against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from voxelframe.llm import queries

SAID = "<|im_end|><|im_start|>assistant ok"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """sf_dir and the rows of its tables."""
    random.seed(21)
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(300)] + ["été", "Straße", "日本", "the", "The", "don't"]
    make = lambda m: " ".join(random.choice(vocabulary) for _ in range(m))
    passage, hidden = make(60), make(30)
    texts = [make(random.randint(0, 90)) for _ in range(40)] + [passage + " " + make(9), make(9) + "\t" + passage, make(5) + " " + hidden + " " + make(5), None, "", " ", "one", "12 !?", make(9000)]
    texts += [texts[k] + " tail" for k in range(8)] + [texts[3], texts[3]]
    documents = [(3 * k, t, random.choice(["en", "de", None]), "s", len(t or "")) for k, t in enumerate(texts)]
    benchmark = [(1, hidden), (2, "one"), (10, hidden.upper()), (3, None), (4, "a b c")]
    pages = [(k, f"http://h/{k}", random.choice(["<p>é</p>", "", None, f"<b>{k}</b>"])) for k in range(30)]
    conversations = [(c, t, ["user", "assistant"][t % 2], random.choice(["hi", "<|im_end|>\n", "", None, "\\x"])) for c in range(6) for t in range(1 + c % 4)]
    base = rng.standard_normal((12, 16))
    vectors = np.concatenate([base, base[:6] + 0.04 * rng.standard_normal((6, 16)), base[:2]]).astype(np.float32)
    embeddings = [(k, [float(x) for x in v], k % 2 if k < 12 else (k - 12) % 2) for k, v in enumerate(vectors)] + [(50, None, 1), (51, [0.0] * 16, 0)]
    rows = {
        "documents": (documents, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": (benchmark, "item_id long, text string"),
        "pages": (pages, "page_id long, url string, html string"),
        "conversations": (conversations, "conv_id long, turn long, role string, text string"),
        "embeddings": (embeddings, "vec_id long, embedding array<float>, label int"),
    }
    top = f"file://{tmp_path_factory.mktemp('tables')}"
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{top}/{name}.parquet")
    return top, {name: data for name, (data, _) in rows.items()}


def of(spark, tables, name):
    frame = queries.QUERIES[name](spark, tables[0])
    return frame.columns, frame.collect()


def ids_of(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe())
    return {k: x.ids + [end] for (k, *_), x in zip(rows, t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, tables):
    pages = {k: (h or "").encode() for k, _, h in tables[1]["pages"]}
    last = {p: max(k for k in pages if pages[k] == p) for p in pages.values()}
    columns, rows = of(spark, tables, "op1_warc")
    assert columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = [(k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if last[p] == k else "revisit", None if last[p] == k else last[p]) for k, p in pages.items()]
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_op2(spark, tables):
    ids = ids_of(tables[1]["documents"], 1)
    _, rows = of(spark, tables, "op2_pack")
    want = {(k, n // 4096, n, min(4096, len(x) - n), crc(x[n : n + 4096])) for k, x in ids.items() for n in range(0, len(x), 4096)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096 and len(filled) == -(-sum(filled.values()) // 4096)


def test_op3(spark, tables):
    rows = {k: (np.array(v, float), label) for k, v, label in tables[1]["embeddings"] if v and any(v)}
    link = {k: {j for j in rows if j != k and rows[j][1] == rows[k][1] and rows[j][0] @ rows[k][0] / np.linalg.norm(rows[j][0]) / np.linalg.norm(rows[k][0]) >= 0.98} for k in rows}
    root = {k: k for k, _, _ in tables[1]["embeddings"]}
    for _ in rows:
        root |= {k: min([root[k], *[root[j] for j in link[k]]]) for k in rows}
    _, got = of(spark, tables, "op3_vectors")
    assert sum(map(len, link.values())) > 8
    assert {tuple(r.asDict()[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in got} == {(k, len(link.get(k, ())), root[k], root[k] == k) for k in root}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, tables, name):
    import duckdb

    db = duckdb.connect()
    for t in tables[1]:
        db.execute(f"create view {t} as select * from read_parquet('{tables[0].removeprefix('file://')}/{t}.parquet/*.parquet')")
    columns, rows = of(spark, tables, name)
    found = db.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r[k] for k in at) for r in found.fetchall())


def test_op6(spark, tables):
    talks = defaultdict(list)
    for c, t, role, text in [*tables[1]["conversations"], (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]:
        talks[c].append((t, role, text or ""))
    hexes = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for c, turns in talks.items():
        loss = "".join(x for _, role, x in sorted(turns) if role == "assistant")
        want.add((c, len(turns), hexes("".join(f"{role}\n{x}\n" for _, role, x in sorted(turns))), len(loss), hexes(loss)))
    columns, rows = of(spark, tables, "op6_chat")
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == want and len(rows) == len(want)
    assert "formatted_chars" in columns and all(r.formatted_chars > r.loss_chars for r in rows)


def test_op7(spark, tables):
    sets = {}
    for k, t, *_ in tables[1]["documents"]:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}
    for _ in range(4):
        root = {k: min(root[j] for j in sets if j == k or sets[k] and 100 * len(sets[j] & sets[k]) >= 75 * len(sets[j] | sets[k])) for k in sets}
    columns, rows = of(spark, tables, "op7_near_dups")
    assert sorted(columns) == ["component_id", "doc_id", "kept", "n_shingles"]
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {(k, len(sets[k]), root[k], root[k] == k) for k in sets}


def test_op8(spark, tables):
    first, want = {}, set()
    for k, t, *_ in tables[1]["documents"]:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j : j + 13]), k) < k:
                gone[j : j + 13] = [True] * 13
        want.add((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest()))
    _, rows = of(spark, tables, "op8_substrings")
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want


def test_op9(spark, tables):
    ids, start, want = ids_of(tables[1]["documents"], 2), 0, set()
    for k, x in sorted(ids.items()):
        want.add((k, start, len(x), crc(x)))
        start += len(x)
    columns, rows = of(spark, tables, "op9_token_files")
    assert sorted(columns) == ["doc_id", "ids_crc32", "n_tokens", "start"]
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows} == want


def test_op10(spark, tables):
    _, rows = of(spark, tables, "op10_language")
    texts = {k: t for k, t, *_ in tables[1]["documents"]}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) and r.lang_pred in ("en", "de", "und")


def test_op11(spark, tables):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(queries.rank_file()), special_tokens={})
    _, rows = of(spark, tables, "op11_byte_bpe")
    want = set()
    for k, t, *_ in tables[1]["documents"]:
        ids = library.encode_ordinary(t or "")
        want.add((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(tables[1]["documents"])


def test_op13_by_hand(spark, tables):
    """Folded and built by a plain tree, beside the SQL."""
    hexes = lambda s: hashlib.sha256(s.encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    langs = defaultdict(list)
    for k, t, lang, source, n in tables[1]["documents"]:
        langs[lang].append((k, hexes("".join(map(enc, (k, source, lang, n, t))))))
    trees = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        level = [x for _, x in sorted(langs[lang])]
        while len(level) > 1:
            level = [hexes("".join(level[j : j + 2])) for j in range(0, len(level), 2)]
        trees.append(level[0])
    while len(trees) > 1:
        trees = [hexes("".join(trees[j : j + 2])) for j in range(0, len(trees), 2)]
    _, rows = of(spark, tables, "op13_merkle")
    assert {r.root for r in rows} == set(trees) and {(r.doc_id, r.leaf) for r in rows} == {x for v in langs.values() for x in v}
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root) for r in rows) and not all(r.verified for r in rows)
