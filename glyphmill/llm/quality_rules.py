"""Learned quality rules (operator 3): document statistics and decision lists as DataFrame expressions.

Statistics are column expressions over whole texts.  Sequential covering on labelled statistics learns an ordered list
of threshold conjunctions that describe rejected documents: a rule grows condition by condition on one part of the
rows by information gain, is pruned on the other part, and is kept while it is precise there.  The list comes out as one
ordered `CASE WHEN` expression.  Learning uses a bounded sample of labelled rows on the driver; all else is Spark's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import write_table

SEPARATORS = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: At most so many labelled rows are learned from: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.9
MIN_COVERED = 5
THRESHOLDS = 48

FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words in windows found twice or more in the array of words, the first occurrence included."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return let(windows, of_windows)

    def of_windows(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, of_pairs))

    def of_pairs(p: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(p, i)["h"] == F.get(p, j)["h"], F.lit(False))
        places = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        starts = F.sort_array(F.transform(places, lambda j: F.get(p, j)["i"]))
        first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        covered = F.aggregate(
            starts, first, lambda a, s: F.struct((s + window).alias("end"), (a["n"] + s + window - F.greatest(s, a["end"])).alias("n"))
        )
        return covered["n"]

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)` and the learned features of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    raw = docs.select(
        F.col(id_col).cast("long").alias("id"),
        let(F.filter(F.split(text, SEPARATORS), lambda x: x != ""), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("n_upper"),
        F.regexp_count(text, F.lit("!")).alias("n_bangs"),
    )
    n = F.greatest(F.col("w.n_words"), F.lit(1))
    return raw.select(
        "id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        (F.col("w.word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("l.n_dup_lines") / F.greatest(F.col("l.n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("w.n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_upper") / F.greatest(F.col("w.word_chars"), F.lit(1))).alias("upper_share"),
        (F.col("n_bangs") / n).alias("bang_share"),
        (F.col("w.n_distinct") / n).alias("distinct_share"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value >= self.threshold if self.above else value <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _candidates(x: np.ndarray) -> list[Condition]:
    out = []
    for k, name in enumerate(FEATURES):
        values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, THRESHOLDS)))
        out += [Condition(name, above, float(v)) for v in values for above in (True, False)]
    return out


def _grown(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < MAX_CONDITIONS and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best, gain = None, 1e-9
        for c in _candidates(x[inside & bad]):
            holds = c.holds(x) & inside
            q, m = (holds & bad).sum(), (holds & ~bad).sum()
            if q >= MIN_COVERED and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _precision(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[float, int]:
    inside = _covers(rule, x)
    return (bad & inside).sum() / max(inside.sum(), 1), int((bad & inside).sum())


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest start of the rule with the best worth (p - n) / (p + n) on the pruning rows."""
    worth = [2 * _precision(rule[:k], x, bad)[0] - 1 for k in range(1, len(rule) + 1)]
    return rule[: int(np.argmax(worth)) + 1] if worth else ()


def learn_rules(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """Decision list for `bad` rows; a third of the rows, every third, prunes."""
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, check = left & ~prune, left & prune
        if (bad & grow).sum() < MIN_COVERED:
            break
        rule = _grown(x[grow], bad[grow])
        rule = _pruned(rule, x[check], bad[check])
        if not rule:
            break
        precision, covered = _precision(rule, x[left], bad[left])
        if precision < MIN_PRECISION or covered < MIN_COVERED:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does."""
    out = F
    for k, rule in enumerate(rules):
        condition = rule[0].column()
        for c in rule[1:]:
            condition &= c.column()
        out = out.when(condition, F.lit(k + 1))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def labelled_sample(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and the `bad` marks of at most `rows` labelled rows (labels 0 and 1, ids not null)."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    sample = stats.join(marks, "id").select(F.xxhash64("id").alias("h"), "id", "label", *[F.col(f).cast("double") for f in FEATURES])
    found = sample.orderBy("h", "id", "label", *FEATURES).limit(rows).toArrow()
    x = np.stack([found.column(f).to_numpy() for f in FEATURES], axis=1) if found.num_rows else np.empty((0, len(FEATURES)))
    return x, found.column("label").to_numpy() == 0


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of `docs`: `(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept)`.

    Null and empty texts have zero counts and fail the base rules; repeated rows are judged each; a null id stays null;
    without labels no rule is learned and the base rules decide; extra columns are ignored; an empty table gives an
    empty result.
    """
    stats = write_table(statistics(docs, id_col, text_col))
    rules = learn_rules(*labelled_sample(stats, labels, id_col, label_col))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept")
    )
