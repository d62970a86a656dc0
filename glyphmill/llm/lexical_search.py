"""Ranked lexical search (operator 13): the k best documents of each item by TPUT over term-partitioned postings.

The score of a document is the sum, over an item's terms, of the term's weight by an impact of the term in the document that
no item has a part in.  So one list per term, sorted by impact, serves all items, and three rounds find their best documents:

1. Heads: the k highest impacts of each list.  The k-th highest score of the documents there is a lower bound that the k-th
   best document reaches.  (Their sums over the heads alone would be one too, but with tens of lists a bound several times
   lower, and hardly a threshold.)
2. Threshold: with m lists, a document whose share in every list is under an m-th of the bound stays under it.  All entries
   from there up are fetched, uniformly from every list.  What they leave open of a list is bounded by the threshold and by
   the head of the list; the documents of the k highest sums give another bound, and those that cannot reach it go.
3. Lookup: the exact scores of the others, a document's for all items that it is a candidate of at a time.

Lists are dealt by term and impact, so that a frequent term spans partitions; entries meet the items' thresholds by term and
impact level, so that only entries of the threshold's own level are compared in vain.  All numbers are 64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import kernels
from glyphmill.llm.common import drop_table, map_batches, write_table

#: Documents of an item's result.
BEST = 10
#: Up to so many different terms of all items (some 20 MB) go to the tasks that read the documents, which then keep no
#: others; with more, all terms of a document are written, and a shuffled join keeps those of the items.
VOCABULARY = 200_000
#: Up to so many (item, term) pairs (some 30 MB) go to the tasks that look up exact scores; with more, candidates are joined
#: with the lists by a shuffle.
FACTORS = 1_000_000
#: Levels of impacts, which are below a million.
LEVELS = 40
#: Bytes of a text that are taken apart at a time.
SLICE_BYTES = 1 << 22

#: ASCII letters and digits and all bytes of other characters are of terms, A-Z as a-z; the rest separates them.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text; terms are UTF-8 bytes."""
    plain = text.translate(_TERM_BYTES)
    if len(plain) <= SLICE_BYTES:
        return Counter(plain.split())
    out: Counter = Counter()
    begin = 0
    while begin < len(plain):
        end = plain.find(b" ", begin + SLICE_BYTES)
        end = len(plain) if end < 0 else end
        out.update(plain[begin:end].split())
        begin = end
    return out


def _counted(rows: DataFrame, wanted) -> DataFrame:
    """(row, id, text) to (row, id, n, terms): number of terms and, of those wanted, `(term, tf)`."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted else None
        texts = kernels.plain(batch.column(2))
        sizes, terms, tfs, ends = [], [], [], [0]
        for text in texts:
            found = term_counts(text.as_buffer().to_pybytes())
            sizes.append(found.total())
            for term in found if keep is None else found.keys() & keep:
                terms.append(term)
                tfs.append(found[term])
            ends.append(len(terms))
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
        cols = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]
        yield pa.RecordBatch.from_arrays(cols, ["row", "id", "n", "terms"])

    return map_batches(rows, fn, "row long, id long, n long, terms array<struct<term:string,tf:long>>")


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _looked_up(candidates: DataFrame, factors: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(row, id, n, terms, items) to the exact scores `(item, id, row, score)` of the document for each of these items."""
    table = factors.select("term", "item", "f").orderBy("term").toArrow()
    of_item, number = np.unique(table.column("item").to_numpy(), return_inverse=True)
    terms, begins = np.unique(np.array(table.column("term").to_pylist(), dtype=object), return_index=True)
    ends = np.append(begins, len(table))[1:]
    slices = {t: (int(a), int(b)) for t, a, b in zip(terms, begins, ends, strict=True)}
    sent = candidates.sparkSession.sparkContext.broadcast((slices, of_item, number, table.column("f").to_numpy()))

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        slices, of_item, number, f = sent.value
        held = batch.column(3)
        owner = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy())
        pairs = held.flatten()
        found = np.array([slices.get(t, (0, 0)) for t in pairs.field("term").to_pylist()], np.int64).reshape(-1, 2)
        tf, n = pairs.field("tf").to_numpy(), batch.column(2).to_numpy()[owner]
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))
        many = found[:, 1] - found[:, 0]
        at = np.arange(many.sum()) + np.repeat(found[:, 0] - np.concatenate(([0], np.cumsum(many)[:-1])), many) if len(many) else np.zeros(0, np.int64)
        key = np.repeat(owner, many) * len(of_item) + number[at]
        order = np.argsort(key, kind="stable")
        key, share = key[order], (np.repeat(impact, many) * f[at])[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        keys, sums = key[first], np.add.reduceat(share, first) if len(first) else share
        asked = batch.column(4)
        row = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
        item = asked.flatten().to_numpy()
        wanted = row * len(of_item) + np.searchsorted(of_item, item)
        place = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        score = np.where(keys[place] == wanted, sums[place], 0) if len(keys) else np.zeros(len(wanted), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(item), batch.column(1).take(pa.array(row)), batch.column(0).take(pa.array(row)), pa.array(score)], ["item", "id", "row", "score"])

    return map_batches(candidates, fn, "item long, id long, row long, score long")


def _whole(a: Column, b: Column) -> Column:
    """Whole part of a quotient of numbers that are not negative."""
    return F.call_function("div", a, b)


def _level(impact: Column) -> Column:
    """Rises with the impact, by two for each doubling."""
    return F.floor(F.log2(impact + 1) * 2).cast("int")


def _highest(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k rows of the highest values of each item, and `at`, their places."""
    order = Window.partitionBy("item").orderBy(F.desc(value), "row")
    return rows.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def _kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    """`(item, name)`: the k-th highest score of each item, where it has so many."""
    return _highest(scores, "score", k).filter(F.col("at") == k).select("item", F.col("score").alias(name))


def _tied(scores: DataFrame, k: int) -> DataFrame:
    """The rows of each item that reach its k-th highest score."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    return scores.withColumn("at", F.rank().over(order)).filter(F.col("at") <= k).drop("at")


def best_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = BEST) -> DataFrame:
    """One row per item and one of its at most `k` best documents of a score over 0: `(item_col, rank, id_col, score)`.

    Equal scores are ranked by ascending document id, null ids last.  Null and empty texts and texts without letters,
    digits and characters beyond ASCII have no terms: such documents are no results and do not count as documents, such
    items have no rows.  Every row is a document or item of its own, also where rows or ids repeat; a null item id stays;
    other columns are ignored; without documents or without items there are no rows.
    """
    spark = docs.sparkSession
    asked = write_table(_counted(_rows(items, item_col, text_col), None))
    wants = asked.select(F.col("row").alias("item"), F.explode("terms").alias("t")).select("item", "t.term", F.col("t.tf").alias("qtf"))
    few = wants.select("term").distinct().limit(VOCABULARY + 1).count() <= VOCABULARY
    wanted = spark.sparkContext.broadcast({r.term.encode() for r in wants.select("term").distinct().collect()}) if few else None

    found = write_table(_counted(_rows(docs, id_col, text_col), wanted))
    total = found.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = total.n, total.terms or 1
    held = found.select("row", "n", F.explode("terms").alias("t")).select("row", "n", "t.term", "t.tf")
    if not few:
        held = held.join(wants.select("term").distinct(), "term", "left_semi")
    weight = F.floor(F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)) * 1000).cast("long")
    weights = write_table(held.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).filter("w > 0"))
    near = F.broadcast(weights) if few else weights

    length = F.lit(25) + _whole(F.col("n") * 75 * F.lit(n_docs), F.lit(n_terms))
    impact = _whole(F.col("tf") * 1_000_000_000, F.col("tf") * 1000 + length * 8).alias("impact")
    lists = held.join(near.select("term"), "term", "left_semi").select("term", "row", impact)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_impact = ("term", F.desc("impact"), "row")
    postings = write_table(lists.repartitionByRange(parts, *by_impact).sortWithinPartitions(*by_impact))
    factors = wants.join(near, "term").select("item", "term", (F.col("qtf") * F.col("w")).alias("f"))
    factors = write_table(factors.withColumn("m", F.count("*").over(Window.partitionBy("item"))))
    n_factors = factors.limit(FACTORS + 1).count()
    sent = F.broadcast if n_factors <= FACTORS else (lambda df: df)  # a row per item: at most as many as factors
    sent_levels = F.broadcast if n_factors * LEVELS <= FACTORS else (lambda df: df)

    def exact(candidates: DataFrame) -> DataFrame:
        """Scores `(item, id, row, score)` of `candidates(item, row)`."""
        terms = candidates.join(found, "row").select("item", "id", "row", "n", F.explode("terms").alias("t")).select("item", "id", "row", "t.term", "n", "t.tf")
        shares = terms.join(factors.select("item", "term", "f"), ["item", "term"]).select("item", "id", "row", (F.col("f") * impact).alias("share"))
        return shares.groupBy("item", "id", "row").agg(F.sum("share").alias("score"))

    # round 1
    heads = postings.withColumn("at", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))).filter(F.col("at") <= k)
    heads = write_table(heads)
    firsts = heads.select("term", "row").join(factors, "term").select("item", "row").distinct()
    tops = heads.groupBy("term").agg(F.max("impact").alias("top"))
    bounded = factors.join(tops, "term").join(_kth(exact(firsts), k, "bound"), "item", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    # of each list: the impact from which entries may pass (checked exactly below), and m times what other entries add at most
    least = F.floor(F.col("bound") / (F.col("m") * F.col("f"))).cast("long") - 1
    most = F.least(F.col("bound"), F.col("f") * F.col("top") * F.col("m"))
    floors = write_table(bounded.withColumns({"least": F.greatest(least, F.lit(0)), "most": most}))
    drop_table(heads)

    # round 2
    last = F.lit(LEVELS - 1)
    levels = floors.filter(_level(F.col("least")) < LEVELS).select("item", F.col("term").alias("of"), "f", "m", "bound", F.explode(F.sequence(_level(F.col("least")), last)).alias("level"))
    share = F.col("f") * F.col("impact")
    reached = postings.join(sent_levels(levels), (F.col("term") == F.col("of")) & (_level(F.col("impact")) == F.col("level")) & (share * F.col("m") >= F.col("bound")))
    met = reached.select("item", "row", share.alias("share")).repartition("item", "row")  # entries of a document hardly meet before
    sums = met.groupBy("item", "row").agg(F.sum("share").alias("sum"), F.count("*").alias("seen"))
    of_item = floors.groupBy("item", "m", "bound").agg(F.sum("most").alias("all"))
    sums = write_table(sums)
    again = _kth(exact(_highest(sums, "sum", k).select("item", "row")), k, "again")
    left = F.col("all") - F.col("seen") * F.col("bound")  # a list with entries that pass has the bound as its `most`
    reaches = F.col("sum") * F.col("m") + left >= F.greatest("bound", F.coalesce("again", F.lit(0))) * F.col("m")
    alive = write_table(sums.join(sent(of_item.join(again, "item", "left")), "item").filter(reaches).select("item", "row"))
    drop_table(sums)

    # round 3
    if n_factors <= FACTORS:
        per_document = alive.groupBy(F.col("row").alias("of")).agg(F.collect_list("item").alias("items"))
        scored = _looked_up(found.join(per_document, F.col("row") == F.col("of")).select("row", "id", "n", "terms", "items"), factors, n_docs, n_terms)
    else:
        scored = exact(alive)
    scored = _tied(scored.filter("score > 0"), k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    best = write_table(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    names = asked.select(F.col("row").alias("item"), F.col("id").alias(item_col))
    out = write_table(best.join(names, "item").select(item_col, "rank", F.col("id").alias(id_col), "score"))
    drop_table(asked, found, weights, postings, factors, floors, alive, best)
    return out
