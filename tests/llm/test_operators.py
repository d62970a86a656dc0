"""The corpus operators against brute force, held-out accuracy, exact round trips and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from glyphmill.llm import chat_format, decontaminate, jaccard_join, kernels, language_id, license_scan, pii, piece_dropout, quality_classifier, quality_rules, token_counts  # noqa: E402
from glyphmill.llm.queries import QUERIES, piece_model  # noqa: E402

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, "one\ntwo three four five six seven"), (6, "one\ntwo three four five six seven"),
    (None, "null id here and some words"), (7, "x" * 70_000), (8, "word " * 30_000), (9, "日本語 テキスト é🙂 a▁b"), (10, "Licensed under CC BY-NC 4.0. mit license"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with further columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, id long, sig long, n long, w string, words string, score string, spans int, kind int, label int, value int, lang string"
    return spark.createDataFrame([(i, t, 1, 2, 3, "a", "b", "c", 4, 5, 6, 7, "en" if i else None) for i, t in ODD], schema)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("false")


def shingles(text, size):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b)
            if same and den * same >= num * (len(a) + len(b) - same):
                parent[find(i)] = find(j)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            lowest[find(k)] = min(lowest.get(find(k), i), i)
    return sorted(((i, len(sets[k]), lowest.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80)])
def test_jaccard_components(docs, rows, size, num):
    got = jaccard_join.jaccard_components(docs, size=size, num=num).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, size, num, 100)


def test_jaccard_near_copies_with_pivots_and_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "FREQUENT_AT_LEAST", 4)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(w[: rng.choice([118, 120])])))
    rows += [(100 + k, " ".join(f"u{k}_{j}" for j in range(40)) + " " + " ".join(base[:12])) for k in range(20)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90, 100)


def test_prefix_signatures_lose_no_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 3))):
            b[int(rng.integers(len(b)))] = rng.integers(0, 2**63)
        b = np.unique(b)
        same, both = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * same < 80 * both:
            continue
        hot = kernels.mix(np.array([1], np.uint64))[0]
        mark = lambda x: kernels.mix(x ^ hot) % np.uint64(4) != 0
        sa, ua = jaccard_join.prefix_signatures(a, mark(a), 80, 100)
        sb, ub = jaccard_join.prefix_signatures(b, mark(b), 80, 100)
        need = -(-80 * (len(a) + len(b)) // 180)
        bounds = dict(zip(sb, ub, strict=True))
        assert any(s in bounds and min(u, bounds[s]) >= need for s, u in zip(sa, ua, strict=True)) or (len(a) == 1 and same == 1)


def test_jaccard_large_groups_are_split(spark, monkeypatch):
    """Pairs of buckets that are split into blocks, against brute force, also at the edges of the levels of length."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    rng = random.Random(9)
    rows = [(sig, rid, n, n, rng.randrange(60)) for sig, m in ((1, 300), (2, 17), (3, 16), (4, 1)) for rid, n in ((sig * 1000 + k, rng.choice([1, 9, 10, 11, 81, 90, 100, 101])) for k in range(m))]
    table = spark.createDataFrame(rows, "sig long, rid long, n long, ub long, comp long")
    for name, at in (("comp", 4), ("rid", 1)):
        wanted = {
            (min(x[1], y[1]), max(x[1], y[1]))
            for x in rows for y in rows
            if x[0] == y[0] and x[at] < y[at] and min(x[2], y[2]) * 100 >= max(x[2], y[2]) * 90 and min(x[3], y[3]) * 190 >= (x[2] + y[2]) * 90
        }
        got = [tuple(r) for r in jaccard_join._self_pairs(table, name, 90, 100).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    blocks = {(r.sig, r.here) for r in jaccard_join._blocks(table, 90, 100).collect()}
    assert {sig for sig, _ in blocks} == {1, 2} and max(here for _, here in blocks) > 2


def test_jaccard_one_head_of_many_distant_sets(spark, monkeypatch):
    """Sets that share a few rare tokens and link with none but their near copy: all their pairs are left to the last join."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 32)
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(4)]
    rows = []
    for k in range(400):
        own = shared + [f"w{rng.randrange(10**6)}" for _ in range(40)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own, "x"]))]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size=3, num=60).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(shingles(t, 3)), i - i % 2) for i, t in rows)


def test_jaccard_pivots_are_limited_before_the_shuffle(spark):
    """No task sees the whole of a group to choose its pivots."""
    table = spark.createDataFrame([(1, 2)], "sig long, rid long")
    order = jaccard_join.Window.partitionBy("sig").orderBy(F.xxhash64("rid", F.lit(1)), "rid")
    plan = table.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= jaccard_join.PIVOTS)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_jaccard_odd_rows(odd, none):
    got = sorted(map(tuple, jaccard_join.jaccard_components(odd).collect()), key=str)
    assert got == brute_components(ODD, 3, 90, 100)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_quality_scores_hold_out(spark, labels):
    sf = SF.replace("0.001", "0.01")
    found = quality_classifier.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in found)
    held = [(r.predicted, marks[r.doc_id]) for r in found if r.held_out and r.doc_id in marks]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95


def test_quality_odd_rows(odd, none, labels):
    got = quality_classifier.score_quality(odd, labels.withColumn("doc_id", F.col("doc_id") % 11)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score_quality(odd, labels.filter("false")).filter("score is null").count() == 0
    assert quality_classifier.score_quality(none, labels).count() == 0
    kept = quality_classifier.keep_quality(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)


def test_quality_statistics_do_not_depend_on_neighbours(rows):
    import pyarrow as pa

    texts = [t for _, t in rows[:40]] + ["", None, "a", "a a a\na a a\n"]
    whole = quality_classifier.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], quality_classifier.statistics(pa.array([t], pa.string()))[0])


def brute_rules(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else None
    if seen is None:
        from collections import Counter

        seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_rules_base(docs, rows, odd, none, labels):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for table, want in ((docs, rows), (odd, ODD)):
        got = [tuple(r) for r in quality_rules.apply_rules(table, labels).select(*columns).collect()]
        assert sorted(got, key=str) == sorted(((i, *brute_rules(t)) for i, t in want), key=str)
    assert quality_rules.apply_rules(none, labels).count() == 0
    assert quality_rules.apply_rules(odd, labels.filter("false")).filter("kept and base_failed").count() == 0


def test_rules_learn(spark):
    sf = SF.replace("0.001", "0.1")
    found = quality_rules.apply_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    both = found.join(marks, "doc_id").filter("n_words >= 10").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in both}
    assert share[1] > 0.98 and share[0] < 0.05


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, found = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places += at
        if at:
            found.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))


def brute_templates(text, templates=license_scan.TEMPLATES, following=None):
    """Labels by all windows of lines: a line and those after it, up to the end of the one with the last of the words that may follow."""
    out = set()
    num, den = license_scan.THRESHOLD
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    following = following or max(len(t.split()) for _, t in templates)
    lines = [word.findall(line.translate(LOWER)) for line in (text or "").split("\n")]
    for k, line in enumerate(lines):
        block, left = set(line), following
        for more in lines[k + 1 :]:
            if left <= 0:
                break
            block |= set(more)
            left -= len(more)
        for label, statement in templates:
            t = set(statement.split())
            if den * len(block & t) >= num * len(t):
                out.add(label)
    return out


def test_license_scan(docs, rows, odd, none):
    for table, want in ((docs, rows), (odd, ODD)):
        got = [tuple(r) for r in license_scan.scan_licenses(table).drop("blocks", "score").collect()]
        brute = []
        for i, t in want:
            base = brute_license(t)
            brute.append((i, *base, ",".join(sorted(brute_templates(t) | set(filter(None, base[4].split(",")))))))
        assert sorted(got, key=str) == sorted(brute, key=str)
    assert license_scan.scan_licenses(none).count() == 0
    assert license_scan.scan_licenses(docs).filter("labels like '%cc-by-nc%'").count() > 0


def test_token_counts(docs, rows, odd, none):
    model = piece_model()
    plain = token_counts.ChunkedEncoder(model).processor
    for table, want in ((docs, rows), (odd, ODD)):
        got = [tuple(r) for r in token_counts.count_tokens(table, model, chunk=300, overlap=16).collect()]
        brute = [(i, len((t or "").encode()), n := len(plain.encode(t or "")), n > 4096) for i, t in want]
        assert sorted(got, key=str) == sorted(brute, key=str)
    assert token_counts.count_tokens(none, model).count() == 0


def test_chunks_resynchronise():
    encoder = token_counts.ChunkedEncoder(piece_model(), chunk=64, overlap=4)
    rng = random.Random(4)
    texts = ["a" * 500, "  " * 300, "x " * 400, " " * 500 + "b", "ab" * 90 + " c" * 200, "é \n" * 200, "▁ " * 100, "<s> </s> " * 60, "日本語テキスト" * 40, "🙂é" * 99, "x" * 300 + "日" + "y" * 300]
    texts += ["".join(rng.choice("abcdetr  \n.,é日▁🙂") for _ in range(rng.randint(60, 900))) for _ in range(200)]
    for text in texts:
        assert encoder.encode(text) == encoder.processor.encode(text)
    assert encoder.widened


def test_chunks_that_do_not_align_are_widened(monkeypatch):
    encoder = token_counts.ChunkedEncoder(piece_model(), chunk=64, overlap=4)
    plain = encoder._aligned
    turns = iter([False, False, True] * 1000)
    monkeypatch.setattr(encoder, "_aligned", lambda *x: plain(*x) and next(turns))
    text = "some words and more words " * 60
    assert encoder.encode(text) == encoder.processor.encode(text) and encoder.widened >= 10


def test_chunks_of_long_texts_are_linear():
    import time

    encoder = token_counts.ChunkedEncoder(piece_model())
    for text in ("日本語のテキスト" * 125_000, "x" * 1_000_000, "words and " * 100_000):
        start = time.perf_counter()
        want = encoder.processor.encode(text)
        between = time.perf_counter()
        assert encoder.encode(text) == want
        assert time.perf_counter() - between < 3 * (between - start) + 0.5


def brute_contained(rows, items, size=5):
    out = []
    for j, item in items:
        w = WORDS.findall((item or "").translate(LOWER))
        if not w:
            continue
        k = min(size, len(w))
        want = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)}
        for i, text in rows:
            v = WORDS.findall((text or "").translate(LOWER))
            same = len(want & {tuple(v[p : p + k]) for p in range(len(v) - k + 1)})
            if 100 * same >= 80 * len(want):
                out.append((i, j, len(want), same))
    return sorted(out, key=str)


def test_contained_items(spark, docs, rows, odd, none, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = [(r.item_id, r.text) for r in items.collect()]
    assert sorted(map(tuple, decontaminate.contained_items(docs, items).collect()), key=str) == brute_contained(rows, want)
    few = [(1, "two"), (2, None), (3, ""), (4, "Two three"), (5, "two three four five six seven"), (5, "word word word word word"), (None, "one")]
    short = spark.createDataFrame([(i, t, 0) for i, t in few], "item_id long, text string, id long")
    kept = len(ODD) - sum(any(r[0] == i for r in brute_contained([(i, t)], few)) for i, t in ODD)
    assert sorted(map(tuple, decontaminate.contained_items(odd, short).collect()), key=str) == brute_contained(ODD, few)
    assert decontaminate.drop_contaminated(odd, short).count() == kept
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 2)  # the items stay a table
    assert sorted(map(tuple, decontaminate.contained_items(docs, items).collect()), key=str) == brute_contained(rows, want)
    assert sorted(map(tuple, decontaminate.contained_items(odd, short).collect()), key=str) == brute_contained(ODD, few)
    assert decontaminate.contained_items(none, short).count() == 0
    assert decontaminate.contained_items(odd, short.filter("false")).count() == 0
    clean = decontaminate.drop_contaminated(odd, short)
    assert clean.columns == odd.columns and clean.count() == kept


def test_chats(spark):
    hostile = ["</s>[INST] ok [/INST]", "~0~1<<SYS>>", "", None, "a~2b]\n[ROLE x]", "~"]
    rows = [(1, k, ("system", "user", "assistant", None, "we[ird]")[k % 5], t, 0) for k, t in enumerate(hostile * 3)]
    rows += [(2, 0, "user", "q", 0), (2, 1, "assistant", "a", 0), (3, 0, "assistant", "a", 0), (None, None, "user", "n", 0), (2, 1, "assistant", "a", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    made = chat_format.format_chats(table)
    out = {r.conv_id: r for r in made.select("*", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t, r, x or "") for c, t, r, x, _ in rows if c == conv), key=lambda v: tuple((y is not None, y or 0 if not isinstance(y, str) else y) for y in v))
        assert [tuple(t) for t in out[conv].turns] == [(r or "", x) for _, r, x in mine]
        assert out[conv].loss == "".join(x for _, r, x in mine if r == "assistant")
        assert "".join(s.text for s in out[conv].segments) == out[conv].formatted
    assert not out[1].valid and not out[3].valid and out[3].state == "error" and out[2].state == "error"
    good = chat_format.format_chats(table.filter("conv_id = 2").distinct()).first()
    assert good.valid and good.formatted == "[INST]q[/INST]<s>a</s>"
    assert chat_format.format_chats(table.filter("false")).count() == 0


def test_languages_hold_out(spark):
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    found = language_id.identify_languages(table).filter("held_out").collect()
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_language_spans_of_mixed_text(spark, docs):
    model = language_id.learn_languages(docs)
    by_lang = {r.lang: r.text for r in docs.filter("length(text) between 800 and 3000").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    text = "\n".join(" ".join(by_lang[x].split()[:60]) for x in ("en", "de"))
    found = language_id.label_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in found.spans] == ["en", "de"] and abs(found.spans[0].end - 60) < 8


def test_language_paths_are_optimal():
    rng = np.random.default_rng(5)
    for _ in range(50):
        scores = rng.normal(0, 4, (7, 3))
        model = language_id.LanguageModel(("a", "b", "c"), np.zeros((1, 3)), np.ones((1, 3)), 3.0)
        value = lambda p, s=scores: sum(s[k, x] for k, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        import itertools

        assert np.isclose(value(tuple(model.path(scores))), max(map(value, itertools.product(range(3), repeat=7))))


def test_language_odd_rows(odd, none):
    got = language_id.identify_languages(odd).collect()
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(ODD) and by_id[1] == by_id[2] == by_id[3] == "und" and by_id[9] == "en"
    assert language_id.identify_languages(none).count() == 0
    assert {r.lang_pred for r in language_id.label_languages(odd, None).collect()} == {"und"}


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_personal(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data_base(rows):
    tricky = [
        "a@b", "a@b.c@d.e", "@x.y", "a.b@c.d.", "x@y.z-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "000255.1.1.1", "4111 1111-1111 1111", "4111  1111", "+1 (234) 555-0199, +12", "+1++1 234 567 89",
        "é@a.b ok@é.com a@b.é", "٣.٣.٣.٣ 1.2.3.٣", "+1٣34567890",
    ]
    for text in [t for _, t in rows] + tricky:
        assert pii.base_spans(text) == brute_personal(text)


def test_personal_data_digests(spark):
    for r in QUERIES["op9_personal_data"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        base = brute_personal(r.text)
        listed = [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) and r.n_email == sum(k == 0 for _, k, _ in base) and r.n_phone == sum(k == 3 for _, k, _ in base)


def test_disclosing_terms(spark, odd, none):
    plain = [(k, f"some common words here {k}\nmore common words") for k in range(200)]
    told = [(1000 + k, f"some words\nchairman person{k}@example.com common words\nchairman") for k in range(12)]
    table = spark.createDataFrame(plain + told, "doc_id long, text string")
    found = pii.learn_disclosure(table.filter("doc_id <> 1000"))
    # "chairman" stands beside an address in half of its places: 1 + log(1/2) / log(share of context words)
    context, total = 11 * 3, sum(len(t.split()) for i, t in plain + told if i != 1000)
    assert 1 + np.log(11 / 22) / -np.log(context / total) < pii.DISCLOSURE and not len(found.terms[0])
    table = spark.createDataFrame(plain + [(i, t[:-9]) for i, t in told], "doc_id long, text string")
    found = pii.learn_disclosure(table)
    assert len(found.terms[0]) == 1
    clean = {r.doc_id: r.text for r in pii.sanitise(table, disclosure=found).collect()}
    assert clean[1003] == "some words\n[TERM] [EMAIL] common words" and clean[5] == plain[5][1]
    got = pii.find_personal_data(odd).collect()
    assert len(got) == len(ODD) and not any(r.spans for r in got)
    assert pii.find_personal_data(none).count() == 0 and pii.sanitise(odd).columns == odd.columns
    assert pii.sanitise(odd).filter("text is null").count() == 1


def test_bit_map_of_terms_and_its_tables(spark, monkeypatch):
    """A map whose size follows the terms, or that is too small for them, changes no result; written tables can be dropped."""
    assert pii.map_bits(0) == pii.map_bits(1000) == pii.MIN_BITS
    assert [pii.map_bits(n) for n in (2**21, 2**21 + 1, 2**40)] == [2**25, 2**26, pii.MAX_BITS]
    rows = [(k, f"some common words here {k}\nmore common words") for k in range(100)] + [(500 + k % 3, f"chairman p{k}@example.com common words", "x") for k in range(12)]
    table = spark.createDataFrame([(*r, None)[:3] for r in rows] * 2, "doc_id long, text string, GLYPHMILL_terms string")
    table = table.withColumn("glyphmill_key", F.lit(1))
    wanted = sorted(map(tuple, pii.sanitise(table).collect()), key=str)
    assert any("[TERM] [EMAIL]" in r[1] for r in wanted)
    monkeypatch.setattr(pii, "MIN_BITS", 64)
    monkeypatch.setattr(pii, "MAX_BITS", 64)
    out = pii.sanitise(table)
    assert out.columns == table.columns and sorted(map(tuple, out.collect()), key=str) == wanted
    under = [t._glyphmill_path for t in out._glyphmill_under]
    assert len(under) == 2 and all(spark.read.parquet(p).count() for p in under)
    jaccard_join.drop_table(out)
    for p in under:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(p)


def brute_spans(texts):
    """All spans of all texts by counting in dictionaries."""
    from collections import Counter

    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    base = [brute_personal(t) for t in texts]
    rest = [pii.blanked(t, b) for t, b in zip(texts, base, strict=True)]
    everywhere = Counter(m[0].translate(LOWER) for t in rest for m in word.finditer(t))
    near = Counter()
    for t, found in zip(rest, base, strict=True):
        for start, kind, end in found:
            line = t[t.rfind("\n", 0, start) + 1 : start], t[start:].split("\n")[0]
            beside = word.findall(line[0])[-pii.CONTEXT_WORDS :] + word.findall(line[1])[: pii.CONTEXT_WORDS]
            near.update((kind, w.translate(LOWER)) for w in beside)
    of_kind = Counter()
    for (kind, _), n in near.items():
        of_kind[kind] += n
    total = sum(everywhere.values())
    terms = set()
    for (kind, w), n in near.items():
        information = -np.log(min(0.5, of_kind[kind] / total))
        if 1 + np.log(min(1, n / everywhere[w])) / information >= pii.DISCLOSURE:
            terms.add(w)
    return [sorted(b + [(m.start(), 4, m.end()) for m in word.finditer(t) if m[0].translate(LOWER) in terms]) for t, b in zip(rest, base, strict=True)]


def test_personal_data_spans_are_those_of_brute_force(spark, rows):
    more = [(5000, "Mr Rarename, owner of ann@b.example and 10.0.0.1\nRARENAME! elsewhere"), (5001, "no address: rarename"), (5002, None)]
    table = spark.createDataFrame(rows + more, "doc_id long, text string")
    got = {r.doc_id: sorted((s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans) for r in pii.find_personal_data(table).collect()}
    want = brute_spans([t or "" for _, t in rows + more])
    assert got == dict(zip([i for i, _ in rows + more], want, strict=True))
    assert (3, 4, 11) in got[5000] and sum(k == 4 for spans in got.values() for _, k, _ in spans) > 3


def test_disclosing_terms_stand_anywhere(spark):
    plain = [(k, f"some common words here {k}\nmore common words") for k in range(200)]
    told = [(1000 + k, f"chairman person{k}@example.com common words") for k in range(12)]
    far = "é chairman one two three four five six person1@example.com\nnext\nchairman"
    table = spark.createDataFrame([*plain, *told, (2000, far), (2001, "no address, only a Chairman here")], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert clean[2000].startswith("é [TERM] ") and clean[2000].endswith("[EMAIL]\nnext\n[TERM]")
    assert clean[2001] == "no address, only a [TERM] here" and clean[5] == plain[5][1]


def test_disclosing_terms_of_single_entities_whatever_the_size(spark):
    told = [(k, f"some words chairman person{k}@example.com common words") for k in range(4)] + [(9, "write to Zebedee via zeb@example.com")]
    plain = [(100 + k, f"some common words write to us via {k}") for k in range(100)]
    many = spark.range(60_000).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("mail person"), "id", F.lit("x@example.com, some common words write to us via mail in some words to common")).alias("text"))
    more = spark.range(60_000).select((F.col("id") + 100_000).alias("doc_id"), F.lit("some common words write to us via mail in some words to common " * 5).alias("text"))
    small = spark.createDataFrame([*told, *plain], "doc_id long, text string")
    for table in (small, small.union(many).union(more)):
        clean = {r.doc_id: r.text for r in pii.sanitise(table).filter("doc_id < 1000").collect()}
        assert clean[1] == "some words [TERM] [EMAIL] common words" and clean[9] == "write to [TERM] via [EMAIL]" and clean[107] == plain[7][1]


def test_pieces_without_dropout_are_the_librarys(rows):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    encoder = piece_dropout.DropoutEncoder(piece_model(), 0.0)
    for text in [t for _, t in rows[:100]] + ["  a  b\n c <s> </s>", "é 世x 🙂\n", "a" * 300, " " * 50, "x\n\n  y"]:
        assert encoder.encode(text).tolist() == plain.encode(text)


def test_pieces_side_by_side_and_lossless(rows):
    for seed in (0, 1):
        encoder = piece_dropout.DropoutEncoder(piece_model(), 0.2, seed)
        units = sorted({u for _, t in rows[:60] for u in encoder.units.findall(" " + t)} | {" ▁a", " a🙂b", "  " * 20, " " + "ab" * 40})
        for variant in range(piece_dropout.VARIANTS):
            assert encoder.segment_many(units, variant) == [encoder.segment(u, variant) for u in units]
        for _, text in rows:
            assert encoder.decode(encoder.encode(text)) == text


def test_piece_variants(spark, rows, odd, none):
    a, b, c = (piece_dropout.DropoutEncoder(piece_model(), p, s) for p, s in ((0.1, 1), (0.1, 2), (0.0, 0)))
    text = rows[0][1]
    ids = [x.encode(text).tolist() for x in (a, b, c)]
    assert ids[0] != ids[1] and len(ids[2]) < min(len(ids[0]), len(ids[1])) and ids[0] == a.encode(text).tolist()
    got = piece_dropout.encode_pieces(odd, piece_model())
    assert got.filter("not lossless").count() == 0 and got.count() == len(ODD)
    assert piece_dropout.decode_pieces(got.withColumn("text", F.lit(1)), piece_model()).columns == [*got.columns, "text"]
    back = piece_dropout.decode_pieces(got, piece_model()).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in ODD), key=str)
    assert piece_dropout.encode_pieces(none, piece_model()).count() == 0


def test_pieces_vary_by_document_and_place(spark, monkeypatch):
    encoder = piece_dropout.DropoutEncoder(piece_model())
    text = "internationalisation " * 200
    ids = [x.tolist() for x in encoder.encode_many([text, text, text], [1, 2, 1])]
    assert ids[0] == ids[2] != ids[1]
    units = encoder.units.findall(" " + text)[:200]
    assert len(set(encoder.segment_many(units, np.arange(200)))) > 10
    plain = encoder.segment(units[0], None)
    kept = piece_dropout.DropoutEncoder(piece_model())
    kept._learn([units[0], " é世"])
    which, variants = np.array([0, 1] * 300), np.arange(600)
    got, alone = kept._pieces(which, variants)
    want = [kept.segment(kept.names[k], v) for k, v in zip(which, variants.tolist(), strict=True)]
    assert 20 < len(alone) < 400 and all(g == w for k, (g, w) in enumerate(zip(got, want, strict=True)) if k not in set(alone.tolist()))
    assert plain in got and len(set(want)) > 20 and len(kept.next) > 5
    monkeypatch.setattr(piece_dropout, "REMEMBERED", 4)
    few = piece_dropout.DropoutEncoder(piece_model())
    mixed = (text[:600] + " rare once ▁ " + "x" * 50 + " short words ") * 3
    pairs = enumerate(few.units.findall(" " + mixed))
    each = [few.segment(u, (zlib.crc32(f"7\n{mixed}".encode()) << 31) ^ k) for k, u in pairs]
    assert few.encode_many([mixed], [7])[0].tobytes() == b"".join(each)
    rows = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string")
    assert len({tuple(r.ids) for r in piece_dropout.encode_pieces(rows, piece_model()).collect()}) == 20
    assert len(set(encoder.segment_many([" internationalisation"] * 1000, np.arange(1000)))) > 20


def brute_links(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    links = lambda a, b: bool(a & b) and den * len(a & b) >= num * len(a | b)
    return sorted(((i, len(a), sum(links(a, b) for j, b in enumerate(sets) if j != k)) for k, ((i, _), a) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_jaccard_links(spark, odd):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(w[: rng.choice([118, 120])])))
    rows += [(200 + k, rows[k][1]) for k in range(5)] + [(300, None), (301, "alone")]
    got = sorted(map(tuple, jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_links(rows, 3, 90, 100) and max(r[2] for r in got) > 10
    assert sorted(map(tuple, jaccard_join.jaccard_links(odd).collect()), key=str) == brute_links(ODD, 3, 90, 100)


def test_licenses_on_wrapped_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General\n\nPublic License as published"
    rows = [(1, mit), (2, "x\n" + bsd), (3, gpl), (4, "\n".join(mit.split())), (5, mit.split("\n")[0]), (6, "some words\n\nof this software"), (7, "a\n" * 50 + bsd)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "mit", 2: "bsd", 3: "gpl", 4: "mit", 5: "", 6: "", 7: "bsd"}


def test_licenses_of_a_table_of_templates(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(60)]
    templates = [(f"t{k}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 14)))) for k in range(120)] + [(None, "v1"), ("none", " ,"), ("null", None)]
    rows = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for k in range(60)]
    rows += [(100 + k, t.replace(" ", rng.choice([" ", "\n", "\n# "]))) for k, (_, t) in enumerate(templates) if t]
    table = spark.createDataFrame(templates, "label string, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=table).collect()}
    good = [(label, t) for label, t in templates if label and t and t.strip(" ,")]
    assert got == {i: ",".join(sorted(brute_templates(t, good))) for i, t in rows}
    bare = license_scan.scan_licenses(spark.createDataFrame([(1, "v1 MIT license"), (2, "x")], "doc_id long, text string"), templates=table.filter("false"))
    assert {r.doc_id: (r.labels, r.score) for r in bare.collect()} == {1: ("mit", 1.0), 2: ("", 0.0)}


def test_quality_scores_are_those_of_the_densities(spark):
    """Each score against the log densities of two normal distributions with the shrunk class covariances."""
    table, marks = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(table, marks).collect()}
    features = {r.id: np.array(r.x) for r in quality_classifier.quality_features(table).collect()}
    label = {r.doc_id: r.quality for r in marks.collect() if r.quality in (0, 1)}
    learned = [i for i in features if i in label and zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([features[i] for i in learned]), np.array([label[i] for i in learned])
    scale = np.where(x.var(axis=0) > 1e-9, x.std(axis=0), 1.0)
    logs = []
    for c in (0, 1):
        own = x[y == c] / scale
        d = own - own.mean(axis=0)
        cov = (1 - quality_classifier.SHRINKAGE) * d.T @ d / len(own) + quality_classifier.SHRINKAGE * np.eye(x.shape[1])
        z = np.array(list(features.values())) / scale - own.mean(axis=0)
        density = -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1]
        logs.append(density + np.log((y == c).sum() + 1))
    want = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / quality_classifier.TEMPERATURE, -30, 30)))
    assert np.allclose(want, [got[i] for i in features], atol=1e-6)


def test_languages_are_those_of_brute_force(spark, docs):
    """Labels, scores and spans against plain loops over words, trigrams and all ends of paths."""
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").filter("length(text) < 1500").limit(25).collect()]
    by_lang = {r.lang: r.text for r in docs.filter("length(text) between 800 and 3000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    texts += [(9000 + k, "\n".join(" ".join(by_lang[x].split()[5 * k : 5 * k + 25]) for x in by_lang)) for k in range(4)] + [(9100, "日本 é ABC"), (9101, "12 34")]
    model = language_id.learn_languages(docs)
    found = {r.doc_id: r for r in language_id.label_languages(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, text in texts:
        words, letters = [], []
        data = text.encode()
        for m in re.finditer(rb"[A-Za-z\x80-\xff]+", data):
            w = bytes(b + 32 if 65 <= b <= 90 else b for b in m[0])
            total = np.zeros(len(model.languages))
            for a, b, c in zip(b"\0" + w, w, w[1:] + b"\0", strict=False):
                total += model.logs[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 16]
            code = 0
            for ch in m[0].decode():
                for name, lo, hi in language_id.SCRIPT_RANGES:
                    if lo <= ord(ch) <= hi:
                        code = max(code, language_id.SCRIPTS.index(name) + 1)
            words.append(np.where(model.allowed[code], total, total - 1e3))
            letters.append(len(w))
        r = found[i]
        if not words:
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
            continue
        best = [words[0]]
        for w in words[1:]:
            best.append(np.maximum(best[-1], best[-1].max() - model.penalty) + w)
        path = np.concatenate([[model.languages.index(s.lang)] * (s.end - s.first) for s in r.spans])
        value = sum(w[p] for w, p in zip(words, path, strict=True)) - model.penalty * (np.diff(path) != 0).sum()
        assert np.isclose(value, best[-1].max(), rtol=1e-4, atol=1e-2)
        weight = np.bincount(path, weights=letters, minlength=len(model.languages))
        total = np.sum(words, axis=0)
        k = int(weight.argmax())
        assert r.lang_pred == model.languages[k]
        assert np.isclose(r.score, weight[k] / weight.sum() / np.exp(np.clip(total - total[k], -700, 700)).sum(), rtol=1e-2, atol=1e-4)
    assert any(len(r.spans) > 2 for r in found.values())
    with pytest.raises(ValueError):
        language_id.learn_languages(docs, most=1)


def test_rules_hold_out(spark):
    """Verdicts on labelled rows that no rule was learned from."""
    table, marks = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    mine = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = quality_rules.apply_rules(table, marks.filter(~mine)).join(marks.filter(mine), "doc_id").select("kept", "base_failed", "quality").collect()
    dropped = [r.quality for r in found if not r.kept and not r.base_failed]
    assert len(found) > 500 and sum(r.quality == 1 and not r.kept for r in found) / sum(r.quality == 1 for r in found) < 0.03
    assert sum(r.kept for r in found if r.quality == 0) / sum(r.quality == 0 for r in found) < 0.06 and np.mean([q == 0 for q in dropped] or [1]) > 0.95


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op6_benchmark_decontamination", "op7_chat_format"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    from glyphmill.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)
