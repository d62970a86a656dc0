"""Information-theoretic sanitisation of personal data (operator 9).

Protected entities are the matches of four patterns.  For each kind the corpus tells how strongly a term reveals it:
with p(k) the share of all words that stand in a context of kind k, and p(k | t) the share of a term's occurrences that
do, the disclosure of t is the pointwise mutual information of t and k over the information of k,

    D(t, k) = log(p(k | t) / p(k)) / -log p(k)  =  1 + log p(k | t) / -log p(k),

1 for a term that stands only there.  As p(e | t) <= p(k | t) for each entity e of kind k, a term that reveals one single
entity reveals its kind at least as surely, so one rule covers both, with no floor on the number of entities.  Terms at
or above the disclosure threshold are generalised to their mark wherever they stand, in every text.  Terms are runs of
letters and digits without regard to the case of A-Z; counts cover all documents, and words outside of matches.
Counts and terms are tables: words that pass a bit map, whose size follows the number of terms, are joined with them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from glyphmill.llm import kernels
from glyphmill.llm.common import bit_map, drop_table, map_batches, write_table

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity, within its line, that count as its context.
CONTEXT_WORDS = 5
DISCLOSURE = 0.85
#: Size of the bit map by which texts are searched for words that may be disclosing terms: BITS_A_TERM a term, so that few
#: other words pass, within 4 and 64 MB.  Beyond some 30 million terms more words pass to the join, and no term is lost.
BITS_A_TERM = 16
MIN_BITS, MAX_BITS = 1 << 25, 1 << 29

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A term, as bare words of the kernels are.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of all pattern matches, in that order; offsets in code points."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            found.append((left, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def contexts(rest: str, spans: list[Span]) -> Iterator[tuple[Span, list[str]]]:
    """Each span with the words beside it, within its line, of a text whose matches are blanks."""
    line_end, words, places = -1, [], []
    for span in spans:
        start, _, end = span
        if start >= line_end:
            begin = rest.rfind("\n", 0, start) + 1
            line_end = rest.find("\n", start)
            line_end = len(rest) if line_end < 0 else line_end
            words = [m for m in _WORD.finditer(rest, begin, line_end)]
            places = [m.start() for m in words]
        k = bisect_left(places, start)
        yield span, [m[0] for m in words[max(0, k - CONTEXT_WORDS) : k + CONTEXT_WORDS]]


def _hashes(words: list[str]) -> np.ndarray:
    return kernels.word_hashes(pa.array(words, pa.string()), bare=True)[0]


def blanked(text: str, spans: list[Span]) -> str:
    """The text with all its pattern matches (ASCII alone) as blanks, so that offsets stay."""
    out, done = [], 0
    for start, _, end in spans:
        if end > done:
            start = max(start, done)
            out += [text[done:start], " " * (end - start)]
            done = end
    return "".join((*out, text[done:])) if out else text


def all_spans(texts: list[str], known: np.ndarray) -> list[list[Span]]:
    """Pattern matches of each text and, wherever they stand outside of these, all words whose hash is in `known` (sorted)."""
    found = [base_spans(t) for t in texts]
    if not len(known):
        return found
    rest = pa.array([blanked(t, f) for t, f in zip(texts, found, strict=True)], pa.string())
    for start, stop in kernels.runs(rest):
        part = rest[start:stop]
        hashes, firsts, begins = kernels.word_hashes(part, places=True, bare=True)
        hits = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
        owners = np.searchsorted(firsts, hits, side="right") - 1
        data, bounds = kernels.buffer(part)
        at, done, last, text = 0, 0, -1, ""
        for k, byte in zip(owners.tolist(), begins[hits].tolist(), strict=True):
            if k != last:
                at, done, last, text = 0, int(bounds[k]), k, part[k].as_py()
            at += len(data[done:byte].tobytes().decode())
            done = byte
            found[start + k].append((at, 4, _WORD.match(text, at).end()))
    return [sorted(f) for f in found]


def _count_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(kind, term, n): occurrences of terms beside entities of a kind, and of all words outside entities as kind -1."""
    texts = kernels.plain(batch.column(0)).to_pylist()
    found = [base_spans(t) for t in texts]
    kinds: list[int] = []
    words: list[str] = []
    plain = [blanked(t, f) for t, f in zip(texts, found, strict=True)]
    for text, spans in zip(plain, found, strict=True):
        for (_, kind, _), near in contexts(text, spans):
            kinds += [kind] * len(near)
            words += near
    rest = pa.array(plain, pa.string())
    parts = [(np.array(kinds, np.int32), _hashes(words), np.ones(len(kinds), np.int64))]
    for start, stop in kernels.runs(rest):
        term, n = np.unique(kernels.word_hashes(rest[start:stop], bare=True)[0], return_counts=True)
        parts.append((np.full(len(term), -1, np.int32), term, n))
    kind, term, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(term.view(np.int64)), pa.array(n)], ["kind", "term", "n"])


def map_bits(terms: int) -> int:
    """Bits of the map of so many terms, a power of two."""
    return min(max(MIN_BITS, 1 << (BITS_A_TERM * terms - 1).bit_length()), MAX_BITS) if terms else MIN_BITS


@dataclass(frozen=True)
class Disclosure:
    """The disclosing terms, as a table `(kind, term)` of hashes."""

    table: DataFrame

    @property
    def terms(self) -> tuple[np.ndarray, ...]:
        """Sorted hashes of each base kind, on the driver: for small corpora."""
        found = self.table.toArrow()
        kind, term = (found.column(c).to_numpy() for c in ("kind", "term"))
        return tuple(np.sort(term[kind == k].view(np.uint64)) for k in range(4))

    def bits(self) -> np.ndarray:
        """Bit map of the terms' low bits: a word without its bit is no disclosing term."""
        return bit_map(self.table, "term", map_bits(self.table.count()))


def learn_disclosure(docs: DataFrame, text_col: str = "text", threshold: float = DISCLOSURE) -> Disclosure:
    """Disclosing terms of each kind, from co-occurrence counts over all rows of `docs`.

    Null and empty texts count for nothing; repeated rows count each; other columns are not read; an empty table, or one
    without entities, gives no terms.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    seen = write_table(map_batches(texts, _count_rows, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")))
    totals = {r.kind: r.n for r in seen.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    information = {k: -np.log(min(0.5, n / max(totals.get(-1, 0), 1))) for k, n in totals.items() if k >= 0}
    everywhere = seen.filter("kind = -1").select("term", F.col("n").alias("all"))
    near = seen.filter("kind >= 0").join(everywhere, "term", "left")
    share = F.least(F.col("n") / F.coalesce("all", "n"), F.lit(1.0))
    of_kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(i))) for k, i in information.items()], F.lit(1.0))
    chosen = write_table(near.filter(1 + F.log(share) / of_kind >= threshold).select("kind", "term"))
    drop_table(seen)
    return Disclosure(chosen)


def _with_terms(docs: DataFrame, disclosure: Disclosure, text_col: str) -> DataFrame:
    """`docs` with a last column, of a new name: hashes of the disclosing terms that stand in the text."""
    name, key = (_new_name(docs, n) for n in ("glyphmill_terms", "glyphmill_key"))
    bits = disclosure.bits()
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(LongType()))])
    sent, mask = docs.sparkSession.sparkContext.broadcast(bits), np.uint64(64 * len(bits) - 1)
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows with their distinct words that have their bit."""
        texts = kernels.plain(batch.column(at)).to_pylist()
        rest = pa.array([blanked(t, base_spans(t)) for t in texts], pa.string())
        for start, stop in kernels.runs(rest):
            hashes, firsts = kernels.word_hashes(rest[start:stop], bare=True)
            low = hashes & mask
            hits = np.flatnonzero(sent.value[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1))
            values, offsets = kernels.distinct_sorted(hashes[hits], np.searchsorted(hits, firsts))
            terms = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, terms], schema.names)

    if not bits.any():
        return docs.withColumn(name, F.array().cast("array<long>"))
    # written, as it is read three times, and so that no task holds two Python workers side by side
    marked = write_table(map_batches(docs, fn, schema))
    # rows that share a key share their terms, all of which are disclosing, so keys need not be unique
    some = marked.filter(F.size(name) > 0).withColumn(key, F.xxhash64(text_col))
    # equal texts have equal words, so a text of many copies is one key's work once
    words = some.dropDuplicates([key, name]).select(key, F.explode(name).alias("term"))
    sure = words.join(disclosure.table.select("term").distinct(), "term").groupBy(key).agg(F.collect_set("term").alias(name))
    some = some.drop(name).join(sure, key, "left").select(*docs.columns, F.coalesce(name, F.array().cast("array<long>")).alias(name))
    out = marked.filter(F.size(name) == 0).union(some)
    out._glyphmill_under = (marked,)
    return out


def _new_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of `docs` has it, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _over(out: DataFrame, rows: DataFrame, own: Disclosure | None) -> DataFrame:
    """`out` with the tables that it reads, for `drop_table` once it has been written."""
    out._glyphmill_under = (*getattr(rows, "_glyphmill_under", ()), *([] if own is None else [own.table]))
    return out


def _spans_of(texts: pa.Array, terms: pa.Array) -> list[list[Span]]:
    known = np.unique(terms.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    return all_spans(kernels.plain(texts).to_pylist(), known)


def find_personal_data(docs: DataFrame, disclosure: Disclosure | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `(id_col, spans)`, spans as an array of (kind, start, end) in code points.

    Null and empty texts have no spans; repeated rows each come back; a null id stays null; extra columns are ignored;
    an empty table gives an empty result.
    """
    own = None if disclosure else learn_disclosure(docs, text_col)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = _spans_of(batch.column(1), batch.column(2))
        flat = np.array([s for spans in found for s in spans], dtype=np.int32).reshape(-1, 3)
        kinds = pa.array(KINDS, pa.string()).take(pa.array(flat[:, 1]))
        spans = pa.StructArray.from_arrays([kinds, pa.array(flat[:, 0]), pa.array(flat[:, 2])], ["kind", "start", "end"])
        ends = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), spans)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _with_terms(rows, disclosure or own, "text")
    out = map_batches(rows, fn, "id long, spans array<struct<kind: string, start: int, end: int>>")
    return _over(out.withColumnRenamed("id", id_col), rows, own)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by its first span's mark."""
    out, done, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = end
    return "".join((*out, text[done:]))


def sanitise(docs: DataFrame, text_col: str = "text", disclosure: Disclosure | None = None) -> DataFrame:
    """`docs`, all columns as they were but for the text, in which all spans are generalised.

    Each run of overlapping spans gets the mark of the first of them.  A null text stays null and an empty one empty;
    repeated rows each come back, all changed alike; null ids and other columns are kept as they are, whatever their
    names; an empty table gives an empty result.
    """
    own = None if disclosure else learn_disclosure(docs, text_col)
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = _spans_of(batch.column(at), batch.column(batch.num_columns - 1))
        texts = [t if t is None else masked(t, f) for t, f in zip(batch.column(at).to_pylist(), found, strict=True)]
        columns = [*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 : -1]]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    rows = _with_terms(docs, disclosure or own, text_col)
    return _over(map_batches(rows, fn, docs.schema), rows, own)
