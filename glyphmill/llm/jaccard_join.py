"""N-gram Jaccard join with token-combination prefixes (operator 1).

A document is the set of its distinct `size`-word shingles; two documents link when
`den * |x & y| >= num * |x | y|`.  The tokens of the set join are the shingle hashes.

1. Equal sets collapse into one class (128-bit digest of the sorted set), so exact copies are never paired.
2. Tokens that are frequent among the classes go last in the global order; all others are ordered by hash.  They are
   counted among the lowest-hash tokens of each class, and on whole sets where frequent ones crowd those out.  With
   e = |x| - ceil(t |x|) tokens to spare, rare tokens of the first e + 1 positions are indexed one by one.  A set
   that runs out of rare tokens extends its prefix into the frequent ones, which are split into hash classes and
   indexed as two-token combinations: a prefix of e + 1 + (number of its frequent classes) tokens shares
   e + 1 - e = 1 rare token, or two tokens of one frequent class, with each set that it links to.
3. Length and positional bounds drop candidates inside the bucket join; then a parity bit map of each set, whose bits that
   differ bound the symmetric difference from below, and the lowest-hash tokens refute most of the rest, and the survivors
   are verified on whole sets.
4. Buckets are not expanded into all pairs.  Each bucket names the one of its sets that meets most others as its head; sets
   that share a bucket then share a head, and near copies, which share many buckets, share one or a few.  In each group
   of a head, sets are verified against the head, then against pivots, and linked sets are contracted, as long as that
   goes on joining components; only pairs across components remain to be verified, and the bit maps refute most of them
   inside the join.  The components are exact: every candidate pair is refuted, verified, or inside one component.
5. A group of many sets is split into blocks by length and hash, and each pair of blocks that may hold links is a key of
   its own, so that no group is one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import kernels
from glyphmill.llm.common import components, drop_table, map_batches, write_table

#: A token is frequent when it is among the lowest-hash tokens of at least this many classes, doubled until at most
#: FREQUENT_TOKENS tokens are (8 MB in each task, whatever the corpus).
FREQUENT_AT_LEAST = 8
FREQUENT_TOKENS = 1_000_000
#: Sets of a group of one head that all others of the group are verified against in a round.  Rounds go on while each joins
#: more than a PROGRESS-th of the components of its groups; then all remaining pairs are verified.
PIVOTS = 16
PROGRESS = 16
#: Sets of one bucket or group and level of length that meet in one key; more are dealt over blocks, which meet pairwise.
BLOCK_SETS = 2_048
#: Words of 64 bits in the parity bit map of a set.
MAP_WORDS = 4
#: Up to so many wanted documents (20 MB) are looked up by a broadcast of their ids; beyond, by a shuffled join.
LOOKUP_ROWS = 200_000


def _spare(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Tokens that a set of n may miss of a linked one: n - ceil(n * num / den)."""
    return n - (n * num + den - 1) // den


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    words, firsts = kernels.word_hashes(texts)
    return kernels.distinct_sorted(*kernels.shingle_hashes(words, firsts, size))


def _digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over independently mixed elements: equal for equal sets only, up to 128-bit collisions."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernels.mix(hashes ^ np.uint64(salt)))))
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _parities(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Parity bit map of each set: bits that differ between two sets are at most their symmetric difference."""
    word = (hashes >> np.uint64(40)) % np.uint64(MAP_WORDS)
    bit = np.uint64(1) << (hashes >> np.uint64(50) & np.uint64(63))
    out = []
    for k in range(MAP_WORDS):
        total = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(np.where(word == k, bit, np.uint64(0)))))
        out.append((total[offsets[1:]] ^ total[offsets[:-1]]).view(np.int64))
    return out


MAP_COLUMNS = tuple(f"map{k}" for k in range(MAP_WORDS))


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _described(size: int, num: int, den: int):
    """(id, text) to (id, n, k1, k2, map0.., low): set size, digest, parity bit map and the lowest-hash tokens."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), kernels.plain(batch.column(1))
        for start, stop in kernels.runs(texts):
            hashes, offsets = _sets(texts[start:stop], size)
            n = np.diff(offsets)
            k1, k2 = _digests(hashes, offsets)
            first = _spare(n, num, den) + 1
            take = np.minimum(n, first + np.maximum(8, first // 4))
            ends = np.concatenate(([0], np.cumsum(take)))
            at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], take)
            maps = [pa.array(x) for x in _parities(hashes, offsets)]
            yield pa.RecordBatch.from_arrays(
                [ids[start:stop], pa.array(n), pa.array(k1), pa.array(k2), *maps, _list_array(hashes[at], ends)], ["id", "n", "k1", "k2", *MAP_COLUMNS, "low"]
            )

    return fn


def _levels(n: int, num: int, den: int) -> range:
    """log2 levels of the sizes that may link with n."""
    return range(max(1, -(-n * num // den)).bit_length() - 1, max(1, n * den // num).bit_length())


def prefix_signatures(hashes: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one whole set (rising hashes; `frequent` marks frequent ones) and, for each, the largest
    overlap that a set can have whose first shared signature it is."""
    n = len(hashes)
    first = int(_spare(np.int64(n), num, den)) + 1
    rare, often = hashes[~frequent], hashes[frequent]
    singles = rare[:first]
    signatures, bounds = [singles], [n - np.arange(len(singles))]
    if len(rare) < first and n > 1:
        place = np.arange(len(often))
        for level in _levels(n, num, den):
            group = (often >> np.uint64(7)) % np.uint64(max(1, (1 << level) // 16))
            new = np.zeros(len(often), bool)
            new[np.unique(group, return_index=True)[1]] = True
            classes = np.cumsum(new)  # of the tokens up to each one
            past = np.flatnonzero(len(rare) + place >= first + classes - new)
            stop = int(past[0]) if len(past) else len(often)
            by_class = np.argsort(group[:stop], kind="stable")
            sizes = np.unique(group[:stop], return_counts=True)[1]
            at = np.arange(stop) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of each token, how many of its class are before it
            after = np.repeat(by_class, at)
            ends = np.cumsum(at)
            before = by_class[np.arange(len(after)) - np.repeat(ends - at, at) + np.repeat(np.arange(stop) - at, at)]
            salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            signatures.append(kernels.mix(kernels.mix(often[before] ^ salt) ^ often[after]))
            bounds.append(n - len(rare) - before + classes[before])
    return np.concatenate(signatures).view(np.int64), np.concatenate(bounds)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of `x` are in the sorted `known`; nothing of the size of `known` is made."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _signed(num: int, den: int, often):
    """(rid, n, low) to (sig, rid, n, ub); sets whose low tokens do not suffice come back with a null sig."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = often.value
        rid, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        lists = batch.column(2)
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        low = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        hot = _among(low, known)
        owner = np.repeat(np.arange(len(n)), sizes)
        cold = np.concatenate(([0], np.cumsum(~hot)))
        place = cold[:-1] - cold[offsets[:-1]][owner]
        first = _spare(n, num, den) + 1
        enough = (cold[offsets[1:]] - cold[offsets[:-1]]) >= first
        pick = ~hot & (place < first[owner]) & enough[owner]
        at = owner[pick]
        if len(at):
            cols = (low[pick].view(np.int64), rid[at], n[at], n[at] - place[pick])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["sig", "rid", "n", "ub"])
        short = np.flatnonzero(~enough)
        if len(short):
            none = pa.nulls(len(short), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(rid[short]), pa.array(n[short]), none], ["sig", "rid", "n", "ub"])

    return fn


def _frequent(spark, counted: DataFrame):
    """Broadcast of the sorted frequent tokens of `counted(sig, c)`."""
    spread = counted.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
    limit = FREQUENT_AT_LEAST
    while sum(r.n for r in spread if 1 << r.k >= limit) > FREQUENT_TOKENS:
        limit *= 2
    often = counted.filter(F.col("c") >= limit).select("sig").toArrow().column("sig").to_numpy()
    return spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))


def _signed_whole(size: int, num: int, den: int, often):
    """(rid, k1, k2, text) to (sig, rid, n, ub) where the digest agrees."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = often.value
        rid, k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        texts = kernels.plain(batch.column(3))
        for start, stop in kernels.runs(texts):
            hashes, offsets = _sets(texts[start:stop], size)
            d1, d2 = _digests(hashes, offsets)
            hot = _among(hashes, known)
            right = np.flatnonzero((d1 == k1[start:stop]) & (d2 == k2[start:stop]) & (np.diff(offsets) > 0))
            if not len(right):
                continue
            found = [prefix_signatures(hashes[offsets[j] : offsets[j + 1]], hot[offsets[j] : offsets[j + 1]], num, den) for j in right.tolist()]
            many = [len(f[0]) for f in found]
            cols = (np.concatenate([f[0] for f in found]), np.repeat(rid[start:stop][right], many), np.repeat(np.diff(offsets)[right], many), np.concatenate([f[1] for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["sig", "rid", "n", "ub"])

    return fn


def _whole_sets(size: int):
    """(rid, k1, k2, text) to (rid, tokens) where the digest agrees."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        texts = kernels.plain(batch.column(3))
        for start, stop in kernels.runs(texts):
            hashes, offsets = _sets(texts[start:stop], size)
            d1, d2 = _digests(hashes, offsets)
            same = pa.array((d1 == k1[start:stop]) & (d2 == k2[start:stop]))
            out = pa.RecordBatch.from_arrays([batch.column(0)[start:stop], _list_array(hashes, offsets)], ["rid", "tokens"])
            yield out.filter(same)

    return fn


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is the `doc` of a row of `keys` (null ids too), with that row's columns."""
    small = keys.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    return docs.join(F.broadcast(keys) if small else keys, docs["id"].eqNullSafe(keys["doc"]))


def _may_link(na: Column, ua: Column, nb: Column, ub: Column, num: int, den: int) -> Column:
    """Length and positional bounds of one shared signature."""
    return (
        (F.least(na, nb) * den >= F.greatest(na, nb) * num)
        & (F.least(ua, ub) * (num + den) >= (na + nb) * num)
    )


class _Verifier:
    """Checks candidate pairs `(a, b)` of class ids: on their bit maps, on the low tokens, and then on whole sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, num: int, den: int):
        self.docs, self.classes, self.size, self.num, self.den = docs, classes, size, num, den

    def _joined(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets.select(*[F.col(c).alias(side if c == "rid" else f"{c}_{side}") for c in sets.columns]), side)
        return pairs

    def sets(self, wanted: DataFrame) -> DataFrame:
        """Whole sets `(rid, tokens)` of the classes `wanted(rid)`, written."""
        keys = write_table(wanted.join(self.classes.select("rid", "doc", "k1", "k2"), "rid"))
        texts = _texts_of(self.docs, keys).select("rid", "k1", "k2", "text")
        out = write_table(map_batches(texts, _whole_sets(self.size), "rid long, tokens array<long>").dropDuplicates(["rid"]))
        drop_table(keys)
        return out

    def links(self, pairs: DataFrame) -> DataFrame:
        num, den = self.num, self.den
        together = F.col("n_a") + F.col("n_b")
        near = self._joined(pairs, self.classes.select("rid", "n", *MAP_COLUMNS)).filter(_apart("{}_a", "{}_b") * (num + den) <= together * (den - num)).select("a", "b")
        most = F.size(F.array_intersect("low_a", "low_b")) + F.greatest(F.col("n_a") - F.size("low_a"), F.col("n_b") - F.size("low_b"))
        close = self._joined(near, self.classes.select("rid", "n", "low")).filter(most * (num + den) >= together * num).select("a", "b")
        close = write_table(close)
        sets = self.sets(close.select(F.col("a").alias("rid")).union(close.select("b")).distinct())
        both = self._joined(close, sets).select("a", "b", F.size("tokens_a").alias("n_a"), F.size("tokens_b").alias("n_b"), F.size(F.array_intersect("tokens_a", "tokens_b")).alias("same"))
        out = write_table(both.filter(F.col("same") * (num + den) >= together * num).select("a", "b"))
        drop_table(close, sets)
        return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of `docs`: `(id_col, n_shingles, component_id)`.

    `component_id` is the smallest id reachable by links, the row's own included.  Defined results: null, empty and
    wordless texts have 0 shingles and link with nothing; a text of fewer than `size` words has one shingle; repeated
    rows each come back; a null id never becomes a component id (a component of null ids only has a null one); extra
    columns are ignored, so none can clash; an empty table gives an empty result.
    """
    if not 0.6 * den <= num <= den:
        raise ValueError("the threshold must be between 0.6 and 1")
    docs, rows, classes = _classes(docs, id_col, text_col, size, num, den)
    labels = _class_components(docs, classes, size, num, den)
    named = write_table(classes.join(labels, classes["rid"] == labels["node"], "left").select("k1", "k2", "n", F.coalesce("label", "rid").alias("comp"), "doc"))
    drop_table(classes, labels)
    lowest = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    lowest = named.join(lowest, "comp").select("k1", "k2", "n", "component_id")
    out = write_table(rows.join(lowest, ["k1", "k2", "n"], "left"))
    drop_table(rows, named)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, text), one row per document with its digest, and one per class of equal sets."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    maps = ", ".join(f"{m} long" for m in MAP_COLUMNS)
    found = map_batches(docs, _described(size, num, den), f"id long, n long, k1 long, k2 long, {maps}, low array<long>")
    found = write_table(found.withColumn("uid", F.monotonically_increasing_id()))
    firsts = [F.first(c).alias(c) for c in (*MAP_COLUMNS, "low")]
    classes = write_table(
        found.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("uid").alias("rid"), F.min("id").alias("doc"), F.count("*").alias("w"), *firsts)
    )
    rows = write_table(found.select("id", "n", "k1", "k2"))
    drop_table(found)
    return docs, rows, classes


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of `docs`: `(id_col, n_shingles, n_links)`, the number of other rows that it links with.

    Every candidate pair of classes is verified, those inside one component too, so the work grows with the links
    between different sets.  Equal sets are counted by the size of their class.  Odd rows as in `jaccard_components`.
    """
    if not 0.6 * den <= num <= den:
        raise ValueError("the threshold must be between 0.6 and 1")
    docs, rows, classes = _classes(docs, id_col, text_col, size, num, den)
    at = _buckets(docs, classes, size, num, den)
    pairs = _self_pairs(at, "rid", num, den)
    links = _Verifier(docs, classes, size, num, den).links(pairs)
    drop_table(pairs, at)
    both = links.union(links.select("b", "a"))
    others = both.join(classes.select(F.col("rid").alias("b"), "w"), "b").groupBy(F.col("a").alias("rid")).agg(F.sum("w").alias("others"))
    counts = write_table(classes.join(others, "rid", "left").select("k1", "k2", "n", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    drop_table(links, classes)
    out = write_table(rows.join(counts, ["k1", "k2", "n"], "left"))
    drop_table(rows, counts)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _apart(left: str, right: str) -> Column:
    """Lower bound of the symmetric difference of two sets by their bit maps; the formats make their columns' names."""
    return sum((F.bit_count(F.col(left.format(m)).bitwiseXOR(F.col(right.format(m)))) for m in MAP_COLUMNS), F.lit(0))


def _pairs(x: DataFrame, y: DataFrame, which: Column, num: int, den: int, on: tuple[str, ...] = ("sig",)) -> DataFrame:
    """Distinct pairs `(a, b)`, a < b, of sets of bucket rows x and y that share a bucket and may link."""
    bounds = _may_link(F.col("x.n"), F.col("x.ub"), F.col("y.n"), F.col("y.ub"), num, den)
    if MAP_COLUMNS[0] in x.columns:
        bounds &= _apart("x.{}", "y.{}") * (num + den) <= (F.col("x.n") + F.col("y.n")) * (den - num)
    for c in on:
        bounds &= F.col(f"x.{c}") == F.col(f"y.{c}")
    found = x.alias("x").join(y.alias("y"), which & bounds)
    return found.select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct()


def _blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Numbers of blocks `(sig, level, here, below, above)` of the levels of length of buckets of more than BLOCK_SETS sets.

    Linked sets are on the same level or on neighbouring ones, whose numbers of blocks are `below` and `above`.
    """
    sizes = write_table(rows.groupBy("sig", _level(num, den).alias("level")).agg(F.count("*").alias("c")))
    large = sizes.groupBy("sig").agg(F.sum("c").alias("m")).filter(F.col("m") > BLOCK_SETS).select("sig")
    here = sizes.join(large, "sig", "left_semi").select("sig", "level", F.ceil(F.col("c") / BLOCK_SETS).cast("int").alias("here"))
    out = here
    for step, name in ((1, "below"), (-1, "above")):
        beside = here.select("sig", (F.col("level") + step).alias("level"), F.col("here").alias(name))
        out = out.join(beside, ["sig", "level"], "left")
    out = write_table(out.fillna(0))
    drop_table(sizes)
    return out


def _level(num: int, den: int) -> Column:
    """Level of length of a set: lengths that may link differ by one level at most (the levels are a little wider)."""
    return F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) + 1e-9))


def _self_pairs(rows: DataFrame, name: str, num: int, den: int) -> DataFrame:
    """`_pairs` of bucket rows among each other that differ in the column `name`.

    Buckets of more than BLOCK_SETS sets are split by level of length and, within it, by a hash of the set.  Each pair of
    blocks of one level or of neighbouring levels is a key of its own, so a bucket of m sets is the work of up to
    (m / BLOCK_SETS)^2 / 2 keys, none of which joins more than BLOCK_SETS sets with as many (but for the hash's spread).
    """
    blocks = _blocks(rows, num, den)
    small = blocks.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    rows = rows.withColumn("level", _level(num, den)).join(F.broadcast(blocks) if small else blocks, ["sig", "level"], "left")
    mine = F.pmod(F.xxhash64("rid"), F.col("here")).cast("int")

    def key(level: Column, up: bool, i: Column, j: Column) -> Column:
        return F.struct(level.alias("level"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"))

    def meets(first: Column, count: Column, of: Callable[[Column], Column]) -> Column:
        none = F.array().cast("array<struct<level: bigint, up: boolean, i: int, j: int>>")
        return F.when(count > first, F.transform(F.sequence(first, F.greatest(count - 1, first)), of)).otherwise(none)

    level, zero = F.col("level"), F.lit(0)
    whole = F.array(key(F.lit(-1).cast("long"), False, zero, zero))
    left = F.concat(meets(mine, F.col("here"), lambda j: key(level, False, mine, j)), meets(zero, F.col("above"), lambda j: key(level, True, mine, j)))
    right = F.concat(meets(zero, mine + 1, lambda i: key(level, False, i, mine)), meets(zero, F.col("below"), lambda i: key(level - 1, True, i, mine)))
    kept = [c for c in rows.columns if c not in ("level", "here", "below", "above")]
    x, y = (rows.select(*kept, F.explode(F.when(F.col("here").isNull(), whole).otherwise(side)).alias("block")) for side in (left, right))
    same = ~F.col("x.block.up") & (F.col("x.block.i") == F.col("x.block.j"))
    which = F.when(same, F.col(f"x.{name}") < F.col(f"y.{name}")).otherwise(F.col(f"x.{name}") != F.col(f"y.{name}"))
    out = write_table(_pairs(x, y, which, num, den, ("sig", "block")))
    drop_table(blocks)
    return out


def _buckets(docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Signatures `(sig, rid, n, ub)` of the classes."""
    spark = docs.sparkSession
    counted = write_table(classes.select(F.explode("low").alias("sig")).groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1"))
    often = _frequent(spark, counted)
    schema = "sig long, rid long, n long, ub long"
    keys = classes.select("rid", "doc", "k1", "k2")
    rows = classes.select("rid", "n", "low")
    if len(often.value):  # sets that run out of rare tokens are counted as a whole, so that their order is known too
        short = write_table(map_batches(rows, _signed(num, den, often), schema).filter("sig is null").select("rid").join(keys, "rid"))
        whole = map_batches(_texts_of(docs, short).select("rid", "k1", "k2", "text"), _whole_sets(size), "rid long, tokens array<long>")
        more = whole.dropDuplicates(["rid"]).select(F.explode("tokens").alias("sig")).groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1")
        both = write_table(counted.union(more).groupBy("sig").agg(F.sum("c").alias("c")))
        often.unpersist()
        often = _frequent(spark, both)
        drop_table(short, both)
    first = write_table(map_batches(rows, _signed(num, den, often), schema))
    short = write_table(first.filter("sig is null").select("rid").join(keys, "rid"))
    whole = _texts_of(docs, short).select("rid", "k1", "k2", "text")
    more = write_table(map_batches(whole, _signed_whole(size, num, den, often), schema).dropDuplicates(["sig", "rid"]))
    # whole sets reach beyond the counted tokens, so their signatures stay as they are
    shared = counted.select("sig").union(more.select("sig"))
    out = write_table(first.filter("sig is not null").join(shared, "sig", "left_semi").unionByName(more))
    often.unpersist()
    drop_table(counted, first, short, more)
    return out


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Bucket rows with the component of their set."""
    if labels is None:
        return rows.withColumn("comp", F.col("rid"))
    return rows.join(labels, rows["rid"] == labels["node"], "left").withColumn("comp", F.coalesce("label", "rid")).drop("node", "label")


def _groups(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Bucket rows by the heads of their buckets instead of their signatures, with the bit map of each set."""
    sizes = rows.groupBy("sig").agg(F.count("*").alias("m")).filter("m > 1")
    shared = rows.join(sizes, "sig").withColumn("met", F.sum("m").over(Window.partitionBy("rid")))
    shared = write_table(shared.select("sig", "rid", "n", "ub", "met"))
    heads = shared.groupBy("sig").agg(F.max(F.struct("met", "rid"))["rid"].alias("head"))
    groups = shared.join(heads, "sig").groupBy(F.col("head").alias("sig"), "rid", "n").agg(F.max("ub").alias("ub"))
    out = write_table(groups.join(classes.select("rid", *MAP_COLUMNS), "rid"))
    drop_table(shared)
    return out


def _class_components(docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Components `(node, label)` of the classes that have links."""
    verifier = _Verifier(docs, classes, size, num, den)
    buckets = _buckets(docs, classes, size, num, den)
    groups = _groups(buckets, classes)
    drop_table(buckets)
    across = F.col("x.comp") != F.col("y.comp")
    links = labels = None
    before, turn = float("inf"), 0
    while True:
        at = write_table(_labelled(groups, labels))
        mixed = at.groupBy("sig").agg((F.min("comp") < F.max("comp")).alias("mixed")).filter("mixed").select("sig")
        live = write_table(at.join(mixed, "sig", "left_semi"))
        drop_table(at)
        left = live.select("comp").distinct().count()
        last = left * PROGRESS >= before * (PROGRESS - 1)
        if last:
            pairs = _self_pairs(live, "comp", num, den)
        elif turn == 0:
            pairs = write_table(_pairs(live, live.filter("rid = sig"), across, num, den))
        else:
            order = Window.partitionBy("sig").orderBy(F.xxhash64("rid", F.lit(turn)), "rid")
            pivots = live.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PIVOTS).drop("k")
            pairs = write_table(_pairs(live, pivots, across, num, den))
        drop_table(live)
        new = verifier.links(pairs)
        drop_table(pairs)
        links, old = new if links is None else write_table(links.union(new)), (links, labels)
        labels = components(links)
        drop_table(*(x for x in (*old, new) if x is not None and x is not links))
        if last:
            drop_table(links, groups)
            return labels
        before, turn = left, turn + 1
