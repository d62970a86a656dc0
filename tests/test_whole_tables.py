"""Queries over whole tables against brute force."""

from __future__ import annotations

import hashlib
import re

from glyphmill.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.01"


def both(spark, name, table, *columns):
    return QUERIES[name](spark, SF).collect(), spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()


def test_messages(spark):
    got, rows = both(spark, "message_format", "events", "event_id", "user_id", "event_type")
    items = ("no items", "one item", "2 items")
    assert len(rows) > 3000
    assert sorted(map(tuple, got)) == sorted((r.event_id, f"user {r.user_id} had {items[r.event_id % 3]} in {r.event_type}") for r in rows)


def test_escapes(spark):
    got, rows = both(spark, "escape_round_trip", "conversations", "conv_id", "turn", "text")
    digest = lambda text: text if text is None else hashlib.md5(text.encode()).hexdigest()
    assert any(r.turn for r in rows)
    shown = lambda text: text if text is not None and re.fullmatch(r"[ -~]*", text) else None
    assert sorted(map(tuple, got), key=str) == sorted(((r.conv_id, r.turn, digest(r.text), shown(r.text)) for r in rows), key=str)


def test_durations(spark):
    got, rows = both(spark, "duration_format", "part", "p_partkey", "p_size")

    def shown(size):
        parts = [(size // 24, "day"), (size % 24, "hour"), (30, "minute")]
        return " ".join(f"{n} {unit}{'s' * (n != 1)}" for n, unit in parts if n)

    assert any(r.p_size >= 24 for r in rows)
    assert sorted(map(tuple, got)) == sorted((r.p_partkey, shown(r.p_size)) for r in rows)


def test_words(spark):
    got, rows = both(spark, "break_words", "documents", "doc_id", "text")
    plain = re.compile(r"[A-Za-z \n]*")
    want = {r.doc_id: len(r.text.split()) for r in rows if r.text is not None and plain.fullmatch(r.text.replace(". ", " ").replace(", ", " "))}
    assert want and len(got) == len(rows) and all(r.words == want[r.doc_id] for r in got if r.doc_id in want)
