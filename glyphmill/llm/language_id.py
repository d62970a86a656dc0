"""Language identification of mixed-language text (operator 8).

A word's script (by code point ranges) narrows the languages to those that use the script; its score for a language is
the sum of log probabilities of its byte trigrams, learned from the labelled documents.  Viterbi over the words with a
switching penalty labels spans.  A document in which no stretch of words could gain the penalty by another language is
one span, which is proven from the largest gain of any stretch; only the others run the recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import kernels
from glyphmill.llm.common import bucket_of, map_batches

#: First and last code points of the scripts' main blocks.
SCRIPT_RANGES = (
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Hiragana", 0x3040, 0x309F), ("Katakana", 0x30A0, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)
SCRIPTS = tuple(dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))

#: Hash cells of the trigram table; it is the size of the model, whatever the corpus.
CELLS = 1 << 16
SWITCH_PENALTY = 12.0
SMOOTHING = 0.1
#: A language is a candidate for a script that at least this share of its words use.
SCRIPT_SHARE = 1e-3
#: The model is broadcast and has CELLS numbers a language, so their count is bounded (256 MB); more are an error.
MAX_LANGUAGES = 1024

_STARTS = np.array(sorted(lo for _, lo, _ in SCRIPT_RANGES))
_BY_START = sorted((lo, hi, SCRIPTS.index(name) + 1) for name, lo, hi in SCRIPT_RANGES)
_ENDS = np.array([hi for _, hi, _ in _BY_START])
_CODES = np.array([k for _, _, k in _BY_START], dtype=np.int8)


def _letter_table() -> np.ndarray:
    """Bytes as they count in trigrams: lower-case letters and all non-ASCII bytes; 0 ends a word."""
    table = np.zeros(256, dtype=np.uint32)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


_LETTERS = _letter_table()


def _trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash cell of the trigram around each byte, and where the byte is part of a word."""
    letters = _LETTERS[data]
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    inner = bounds[1:-1]
    before[inner[inner < len(data)]] = 0
    after[inner[(inner > 0)] - 1] = 0
    cells = ((before << np.uint32(16) | letters << np.uint32(8) | after) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return cells.astype(np.int64), letters > 0


def _words(inside: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the words: runs of letter bytes within a text."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(inside)]
    begins[edges] = inside[edges]
    return np.flatnonzero(begins)


def _scripts(data: np.ndarray) -> np.ndarray:
    """Script number at the first byte of each character (0: none), Latin for ASCII letters."""
    out = np.zeros(len(data), dtype=np.int8)
    out[(_LETTERS[data] > 0) & (data < 0x80)] = 1
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        b = np.zeros((4, len(lead)), dtype=np.int64)
        for k in range(4):
            b[k] = data[np.minimum(lead + k, len(data) - 1)] & (0xFF if k == 0 else 0x3F)
        two, three = b[0] < 0xE0, b[0] < 0xF0
        point = np.where(two, (b[0] & 0x1F) << 6 | b[1], np.where(three, (b[0] & 0x0F) << 12 | b[1] << 6 | b[2], (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
        at = np.searchsorted(_STARTS, point, side="right") - 1
        out[lead] = np.where((at >= 0) & (point <= _ENDS[at]), _CODES[at], 0)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities by trigram cell and language, languages allowed by script, and log priors."""

    languages: tuple[str, ...]
    logs: np.ndarray
    allowed: np.ndarray
    penalty: float

    def word_scores(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (words x languages), word starts and letter bytes per word."""
        cells, inside = _trigrams(data, bounds)
        starts = _words(inside, bounds)
        if not len(starts):
            return np.empty((0, len(self.languages))), starts, starts
        values = self.logs[cells]
        values[~inside] = 0
        scores = np.add.reduceat(values, starts, axis=0).astype(float)
        script = np.maximum.reduceat(_scripts(data), starts)
        scores[~self.allowed[script]] -= 1e3
        return scores, starts, np.add.reduceat(inside.astype(np.int64), starts)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """Best language of each word of one text."""
        total = scores.sum(axis=0)
        best = int(total.argmax())
        if len(self.languages) == 1:
            return np.zeros(len(scores), dtype=np.int64)
        gain = np.cumsum(np.delete(scores, best, axis=1).max(axis=1) - scores[:, best])
        if (gain - np.minimum.accumulate(np.concatenate(([0.0], gain[:-1])))).max() < self.penalty:
            return np.full(len(scores), best)
        return viterbi(scores, self.penalty)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the best path through `scores` (steps x labels) when each change of label costs `penalty`."""
    n, k = scores.shape
    back = np.empty((n, k), dtype=np.int16)
    stay = list(range(k))
    rows = scores.tolist()
    value = rows[0]
    back[0] = -1
    froms = [None] * n
    for t in range(1, n):
        top = max(value)
        j = value.index(top)
        floor = top - penalty
        froms[t] = [s if v >= floor else j for s, v in zip(stay, value, strict=True)]
        value = [(v if v >= floor else floor) + x for v, x in zip(value, rows[t], strict=True)]
    at = value.index(max(value))
    out = np.empty(n, dtype=np.int64)
    for t in range(n - 1, 0, -1):
        out[t] = at
        at = froms[t][at]
    out[0] = at
    return out


def _counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(lang, text) to counts by trigram cell, and by CELLS + script of words."""
    langs = batch.column(0).to_pylist()
    texts = kernels.plain(batch.column(1))
    names = sorted(set(langs))
    number = {x: k for k, x in enumerate(names)}
    width = CELLS + len(SCRIPTS) + 1
    total = np.zeros(len(names) * width, dtype=np.int64)
    for start, stop in kernels.runs(texts):
        data, bounds = kernels.buffer(texts[start:stop])
        if not len(data):
            continue
        owner = np.repeat(np.array([number[x] for x in langs[start:stop]]), np.diff(bounds))
        cells, inside = _trigrams(data, bounds)
        total += np.bincount((owner * width + cells)[inside], minlength=len(total))
        starts = _words(inside, bounds)
        if len(starts):
            script = np.maximum.reduceat(_scripts(data), starts)
            total += np.bincount(owner[starts] * width + CELLS + script, minlength=len(total))
    for k, name in enumerate(names):
        own = total[k * width : (k + 1) * width]
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], ["lang", "k", "n"])


def learn_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", penalty: float = SWITCH_PENALTY, most: int = MAX_LANGUAGES) -> LanguageModel | None:
    """Model of the languages of `docs` (rows with a null language are left out; none left: None).  All rows are counted.

    More than `most` languages raise ValueError: the model would be too large to send out.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null")
    sums = map_batches(rows, _counted, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    if not languages:
        return None
    if len(languages) > most:
        raise ValueError(f"more than {most} languages")
    number = {x: k for k, x in enumerate(languages)}
    table = np.zeros((CELLS + len(SCRIPTS) + 1, len(languages)))
    table[sums.column("k").to_numpy(), [number[x] for x in names]] = sums.column("n").to_numpy()
    grams, scripts = table[:CELLS], table[CELLS:]
    logs = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * CELLS))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), allowed, penalty)


def label_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `(id_col, lang_pred, score, spans)`.

    `spans` are runs of words (letter runs, from 0, end exclusive) of one language.  `lang_pred` has most letter bytes;
    `score` is its share of them, times the probability of the language against the others over the whole text.  Null
    texts and texts without a letter are `und` with score 0 and no spans, as is all without a model; repeated rows are
    labelled each; a null id stays null; extra columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = sent.value
        texts = kernels.plain(batch.column(1))
        preds, shares, spans = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
        for start, stop in kernels.runs(texts) if m else ():
            part = texts[start:stop]
            data, bounds = kernels.buffer(part)
            scores, starts, letters = m.word_scores(data, bounds)
            firsts = np.searchsorted(starts, bounds)
            ascii_letters = np.concatenate(([0], np.cumsum((_LETTERS[data] > 0) & (data < 0x80))))
            for k in range(stop - start):
                a, b = firsts[k], firsts[k + 1]
                if a == b or (ascii_letters[bounds[k]] == ascii_letters[bounds[k + 1]] and not any(map(str.isalpha, part[k].as_py()))):
                    continue
                path = m.path(scores[a:b])
                changes = np.flatnonzero(np.diff(path)) + 1
                edges = [0, *changes.tolist(), b - a]
                spans[start + k] = [{"first": x, "end": y, "lang": m.languages[path[x]]} for x, y in zip(edges, edges[1:], strict=False)]
                weight = np.bincount(path, weights=letters[a:b], minlength=len(m.languages))
                best = int(weight.argmax())
                total = scores[a:b].sum(axis=0)
                preds[start + k] = m.languages[best]
                shares[start + k] = weight[best] / weight.sum() / np.exp(np.clip(total - total[best], -700, 700)).sum()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(np.clip(shares, 0, 1)), pa.array(spans, pa.list_(span))], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(rows, fn, "id long, lang_pred string, score double, spans array<struct<first: int, end: int, lang: string>>")
    return out.withColumnRenamed("id", id_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", holdout_mod: int = 4, holdout_rest: int = 2) -> DataFrame:
    """`label_languages` with a model learned from the rows whose crc32(id as text) is not `holdout_rest` modulo
    `holdout_mod`, plus the column `held_out`."""
    model = learn_languages(docs.filter(bucket_of(F.col(id_col), holdout_mod) != holdout_rest), lang_col, text_col)
    out = label_languages(docs, model, id_col, text_col)
    return out.withColumn("held_out", bucket_of(F.col(id_col), holdout_mod) == holdout_rest)
