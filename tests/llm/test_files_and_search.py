"""Packed token files, Merkle manifest and ranked search against brute force."""

from __future__ import annotations

import glob
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from glyphmill.llm import lexical_search, merkle, token_files  # noqa: E402
from glyphmill.llm.queries import BYTE_MODEL, QUERIES, piece_model  # noqa: E402

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two, one."), (6, "one\ntwo three"), (6, "one\ntwo three"), (None, "null id one"), (None, "null id one"),
    (7, "x" * 70_000), (8, "word " * 30_000), (9, "日本語 テキスト é🙂 a▁b ÉÀ"), (10, "a<|endoftext|> b ..!? c  d"), (-3, "two two two"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with further columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, id long, row long, n long, at int, node string, tree string, key int, place int, ids string, term string, source string, lang string, n_chars long"
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "a", "b", 5, 6, "c", "d", None if k % 3 == 0 else f"s{k % 3}", "", k) for k, (i, t) in enumerate(ODD)], schema)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(piece_model(BYTE_MODEL).decode())


# --- packed token files -------------------------------------------------------------------------------------------


def test_packing():
    r = random.Random(3)
    for bits in range(1, 33):
        for n in (0, 1, 63, 64, 65, 1000):
            ids = np.array([r.getrandbits(bits) for _ in range(n)], np.uint32)
            packed = token_files.pack(ids, bits)
            assert len(packed) == -(-n // 64) * 8 * bits and np.array_equal(token_files.unpack(packed, bits, n), ids)


@pytest.mark.parametrize("bits", [7, 16, 17])
def test_any_place_of_a_file(bits):
    r = random.Random(bits)
    docs = [np.array([r.getrandbits(bits) for _ in range(n)], np.uint32) for n in (0, 1, 500, 128, 3, 1000)]
    file = token_files.TokenFile(token_files.file_bytes([None, 3, 4, 4, 5, 9], docs, bits, block=128))
    flat = np.concatenate(docs)
    assert (file.n_docs, file.n_null, file.n_ids) == (6, 1, len(flat))
    assert all(np.array_equal(file.document(k), d) for k, d in enumerate(docs))
    for _ in range(200):
        a, b = sorted(r.randrange(len(flat) + 1) for _ in range(2))
        assert np.array_equal(file.ids(a, b), flat[a:b])
    with pytest.raises(IndexError):
        file.ids(0, len(flat) + 1)
    with pytest.raises(ValueError):
        token_files.TokenFile(bytes(100))


def test_units_are_those_of_the_library(library, monkeypatch):
    monkeypatch.setattr(token_files, "UNITS", 400)
    monkeypatch.setattr(token_files, "SPLIT_CHARS", 20)
    encoder = token_files.UnitEncoder(piece_model(BYTE_MODEL).decode(), 2)
    parts = ["a", "B", " ", "\n", "\t", " ", "\x1c", "\x85", "é", "日", "'s", "'", "!", "1", "<|endoftext|>", "<|", "_", "🙂", "́", "\r", "  ", "ß\n", ".", ", ", " ", "×", "word" * 20]
    r = random.Random(4)
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000)]
    for k in range(0, len(texts), 50):
        got = [np.frombuffer(x, encoder.width).tolist() for x in encoder.encode(texts[k : k + 50])]
        assert got == [e.ids + [2] for e in library.encode_batch(texts[k : k + 50], add_special_tokens=False)]


def _expected(rows, library):
    out, start = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = QUERIES["op11_token_files"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == _expected(rows, library)


def test_odd_rows_in_token_files(spark, odd, library, tmp_path):
    path = str(tmp_path / "made")
    token_files.write_token_files(odd, path, piece_model(BYTE_MODEL).decode(), 2, file_ids=5000, parts=5)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]  # nulls first, ascending
    texts = dict(ODD)
    want = _expected([(r.doc_id, texts[r.doc_id]) for r in got], library)
    assert [tuple(r)[:4] for r in got] == want and len(got) == len(ODD)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    files = [token_files.TokenFile(open(f, "rb").read()) for f in sorted(glob.glob(f"{path}/files/part-*"))]
    assert len(files) > 2 and sum(f.n_docs for f in files) == len(ODD)  # by name, as by id
    assert [int(d) for f in files for d in f.doc_ids[f.n_null :]] == [r.doc_id for r in got if r.doc_id is not None]
    many = odd.select(F.lit(7).cast("long").alias("doc_id"), F.col("n_chars").cast("string").alias("text"))
    token_files.write_token_files(many, str(tmp_path / "many"), piece_model(BYTE_MODEL).decode(), 2, parts=6)  # one id has all rows
    assert token_files.read_token_files(spark, str(tmp_path / "many")).count() == len(ODD)
    assert len(glob.glob(f"{tmp_path}/many/files/part-*")) > 2
    token_files.write_token_files(odd.filter("false"), str(tmp_path / "none"), piece_model(BYTE_MODEL).decode(), 2)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


# --- Merkle manifest ----------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes, arity):
    """Root of a list of digests, and the siblings of each leaf with its place in the run, by level."""
    paths = [[] for _ in nodes]
    under = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for k in range(0, len(nodes), arity):
            run = nodes[k : k + arity]
            for j in range(len(run)):
                for leaf in under[k + j]:
                    paths[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(H(*run))
            above.append([x for u in under[k : k + arity] for x in u])
        nodes, under = up, above
    return nodes[0], paths


def _manifest(rows, arity):
    """rows (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, proof)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, _leaf(r), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(groups[s])], arity) for s in order}
    root, high = _tree([trees[s][0] for s in order], arity)
    out = []
    for s, above in zip(order, high, strict=True):
        for x, path in zip(sorted(groups[s]), trees[s][1], strict=True):
            out.append((x[3], x[2], trees[s][0], root, tuple(path + above)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_of_odd_rows(odd, arity):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    made = merkle.merkle_manifest(odd, arity=arity).collect()
    got = sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.proof)) for r in made), key=repr)
    assert got == _manifest(rows, arity)


def test_manifest_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    want = {w[0]: w for w in _manifest(rows, 3)}
    got = QUERIES["op12_merkle_manifest"](spark, SF).collect()
    assert len(got) == len(rows) and {r.verified for r in got} == {True, False}
    texts = {r[0]: r for r in rows}
    for r in got:
        _, leaf, subroot, root, path = want[r.doc_id]
        node = leaf
        if zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
            row = texts[r.doc_id]
            node = _leaf((*row[:4], row[4].replace("\n", "")))
        for before, after in path:
            node = H(before, node, after)
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, H(*(b + a for b, a in path)))
        assert (r.folded_root, r.verified) == (node, node == root)


def test_manifest_edges(spark, odd):
    assert merkle.merkle_manifest(odd.filter("false")).count() == 0
    one = merkle.merkle_manifest(odd.filter("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof == []
    twice = merkle.merkle_manifest(odd.filter("doc_id = 6").withColumns({"n_chars": F.lit(1), "source": F.lit("s")})).collect()
    assert len({r.leaf for r in twice}) == 1 and len({str(r.proof) for r in twice}) == 2
    with pytest.raises(ValueError):
        merkle.merkle_manifest(odd, arity=1)
    changed = merkle.merkle_manifest(odd, forged=F.sha2(F.lit("forged"), 256))
    assert changed.filter(merkle.fold(F.col("forged"), F.col("proof")) == F.col("root")).count() == 0
    assert changed.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


# --- ranked search ------------------------------------------------------------------------------------------------


def _ranked(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // max(total, 1)
            score = sum(q * w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("vocabulary", [200_000, 5])
def test_search(spark, odd, vocabulary, monkeypatch):
    monkeypatch.setattr(lexical_search, "VOCABULARY", vocabulary)
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 1000)
    if vocabulary == 5:  # and candidates are joined with the lists
        monkeypatch.setattr(lexical_search, "FACTORS", 3)
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(6000)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randrange(60)))) for k in range(400)]
    docs += docs[:40] + ODD
    items = [(1, "w1 w2 w3"), (1, "w1 w2 w3"), (2, None), (3, "..."), (None, "one two W7 w7 w7"), (4, "absent"), (5, docs[7][1]), (6, "日本語 ÉÀ word"), (7, "w1 w1 w4 w9 w12 w33 w50")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").withColumns({"item": F.lit(1), "score": F.lit(""), "rank": F.lit(0)})
    for k in (1, 3, 10):
        got = lexical_search.best_documents(frame(docs, "doc_id"), frame(items, "item_id"), k=k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
        assert sorted(map(tuple, got.collect()), key=repr) == _ranked(docs, items, k)


def test_search_of_nothing(spark, odd):
    none = odd.filter("false")
    items = odd.withColumnRenamed("doc_id", "item_id")
    assert lexical_search.best_documents(none, items).count() == 0
    assert lexical_search.best_documents(odd, items.filter("false")).count() == 0
    assert lexical_search.best_documents(odd.filter("doc_id <= 3"), items).count() == lexical_search.best_documents(odd.filter("doc_id = -3"), items).count()


def test_search_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_lexical_search"](spark, SF).collect()), key=repr) == _ranked(docs, items, 10)
