"""SentencePiece-type BPE with seeded merge dropout, and lossless decoding (operator 10).

Merges run from an agenda (best score first, then leftmost), as in the piece library; when a candidate merge is taken
from the agenda, a hash keyed by seed, document (id and text), place of the unit in it, unit, position and merged piece
says whether it is skipped.  The same key always gives the same segmentation, whichever task computes it; each occurrence
of a unit has its own.  Short units are worked on side by side: in each round every unit takes its best remaining
candidate, as its own agenda would.  Texts are cut into units at borders that no piece of the vocabulary crosses.

A worker remembers how agendas go on, not what keys decide: a state is a unit and the merges skipped in it so far, and
holds the merges that follow if no more are skipped and the pieces that these lead to.  Each occurrence asks its own
hash about each of these merges in turn, and the first one that it skips leads to the state of one more skipped merge.
Characters without a piece, and the space mark itself, fall back to bytes, so decoding is lossless.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill.llm import kernels
from glyphmill.llm.common import map_batches

SPACE = "▁"
DROPOUT = 0.1
#: Keys by which `segment` and `segment_many` are compared; the operator has a key for each occurrence of a unit.
VARIANTS = 2
#: States of units remembered by a worker; beyond, it starts afresh.
REMEMBERED = 250_000
#: A unit or a state is remembered when so many occurrences of a run meet in it; fewer are segmented on their own.
WORTH_STATE = 4
#: Bytes of texts handed to the encoder, and occurrences of units worked on, at a time: the more meet, the more they share.
RUN_BYTES = 1 << 21
OCCURRENCES = 1 << 18
#: Units of up to so many characters are worked on side by side.
SIDE_BY_SIDE = 32
#: No candidate merge, and no piece, in the 16-bit fields of a worked-on symbol.
_NONE = 0x7FFF
_EMPTY = 0xFFFF


class DropoutEncoder:
    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = 0):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [p.id_to_piece(k) for k in range(p.get_piece_size())]
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte_id: dict[int, int] = {}
        self.surface: list[bytes] = []
        for k, name in enumerate(names):
            if p.is_byte(k):
                self.byte_id[int(name[1:-1], 16)] = k
                self.surface.append(bytes([int(name[1:-1], 16)]))
            elif p.is_control(k) or p.is_unknown(k):
                self.surface.append(b"")
            else:
                self.rank[name] = (-p.get_score(k), k)
                self.surface.append(name.replace(SPACE, " ").encode())
        crossing = any(a != SPACE and b == SPACE for n in self.rank for a, b in zip(n, n[1:], strict=False))
        lines = not any("\n" in n for n in self.rank)
        self.units = re.compile(r"(?s).+" if crossing or not lines else r"\n| *[^ \n]+| +")
        self.limit = int(dropout * (1 << 32))
        self.seed = seed
        self._tables()
        self._forget()

    def _tables(self) -> None:
        """Piece ids by character, and merges by pair of piece ids as an open hash table."""
        self.by_char = np.full(0x110000, -1, dtype=np.int32)
        for name, (_, k) in self.rank.items():
            if len(name) == 1:
                self.by_char[ord(name)] = k
        self.by_char[ord(" ")] = self.by_char[ord(SPACE)]
        self.by_char[ord(SPACE)] = -1
        self.small = len(self.surface) <= _NONE  # ids and orders fit the packed symbols
        order = {s: k for k, s in enumerate(sorted({s for s, _ in self.rank.values()}))}
        self.order_of = np.full(len(self.surface), _NONE, dtype=np.int32)
        pairs: list[tuple[int, int, int]] = []
        for name, (s, k) in self.rank.items():
            self.order_of[k] = order[s]
            for cut in range(1, len(name)):
                a, b = self.rank.get(name[:cut]), self.rank.get(name[cut:])
                if a and b:
                    pairs.append((a[1], b[1], k))
        self.slots = 1 << max(4, (8 * len(pairs)).bit_length())
        self.pair_key = np.full(self.slots, -1, dtype=np.int64)
        self.pair_piece = np.zeros(self.slots, dtype=np.int32)
        for a, b, k in pairs:
            at = self._slot(a, b)
            while self.pair_key[at] >= 0:
                at = (at + 1) & (self.slots - 1)
            self.pair_key[at], self.pair_piece[at] = a << 32 | b, k

    def _slot(self, a, b):
        return (a * 0x9E3779B1 + b * 0x85EBCA77) >> 7 & (self.slots - 1)

    def _merges(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Order and piece of the candidate merge of each pair of ids (order _NONE: none, or skipped)."""
        want = left << 32 | right
        at = self._slot(left, right)
        piece = np.full(len(left), -1, dtype=np.int32)
        rest = np.flatnonzero((left != _EMPTY) & (right != _EMPTY))
        at, want = at[rest], want[rest]
        while len(rest):
            there = self.pair_key[at]
            hit = there == want
            piece[rest[hit]] = self.pair_piece[at[hit]]
            go = ~hit & (there >= 0)
            rest, at, want = rest[go], (at[go] + 1) & (self.slots - 1), want[go]
        order = np.where(piece >= 0, self.order_of[piece], _NONE)
        if self.limit and keys is not None:
            order[self._skipped(keys, place, piece)] = _NONE
        return order, piece

    def _skipped(self, keys: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        low = np.uint64(0xFFFFFFFF)
        h = (keys ^ (place.astype(np.uint64) * np.uint64(0x9E3779B1) + piece.astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE35))) & low
        h = (h ^ (h >> np.uint64(16))) * np.uint64(0x7FEB352D) & low
        h = (h ^ (h >> np.uint64(15))) * np.uint64(0x846CA68B) & low
        return (h ^ (h >> np.uint64(16))) < np.uint64(self.limit)

    def segment_many(self, units: list[str], variant: int | np.ndarray | None, paths: list | None = None) -> list[bytes]:
        """int32 ids of each unit; the same as `segment` unit by unit.  `variant` may hold one for each unit; with None
        no merge is skipped, and `paths` gets the merges taken, as (place, piece), of the units worked on side by side."""
        lengths = np.array([len(u) for u in units])
        chars = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        ids = self.by_char[chars]
        starts = np.concatenate(([0], np.cumsum(lengths)))
        plain = self.small & (lengths <= SIDE_BY_SIDE) & (np.add.reduceat(ids < 0, starts[:-1]) == 0)
        variants = None if variant is None else np.broadcast_to(np.asarray(variant, dtype=np.int64), len(units))
        keys = None if variants is None else self._keys(np.array([zlib.crc32(u.encode()) for u in units], dtype=np.uint64), variants)
        out: list[bytes] = [b""] * len(units)
        for k in np.flatnonzero(~plain):
            out[k] = self.segment(units[k], None) if keys is None else self._keyed(units[k], int(keys[k]))
        rows = np.flatnonzero(plain)
        if paths is not None:
            paths += [() if p else None for p in plain.tolist()]
        low = 0
        for size in (4, 6, 8, 10, 12, 16, 24, SIDE_BY_SIDE):
            some = rows[(lengths[rows] <= size) & (lengths[rows] > low)]
            low = size
            if len(some):
                self._side_by_side(ids, starts, lengths, some, size, None if keys is None else keys[some], out, paths)
        return out

    def _side_by_side(self, ids, starts, lengths, rows, size, keys, out, paths) -> None:
        many = lambda keys, n: None if keys is None else np.repeat(keys, n)
        # a symbol: order of its merge with the next one, piece of that merge, its own piece, its first character
        span = np.arange(size, dtype=np.int64)
        have = span[None, :] < lengths[rows][:, None]
        part = np.full((len(rows), size + 1), _EMPTY, dtype=np.int64)
        part[:, :size][have] = ids[(starts[rows][:, None] + span[None, :])[have]]
        order, piece = self._merges(part[:, :-1].ravel(), part[:, 1:].ravel(), np.tile(span, len(rows)), many(keys, size))
        grid = self._packed(order, piece, part[:, :-1].ravel(), np.tile(span, len(rows))).reshape(-1, size)
        empty = np.int64(_NONE << 48 | _EMPTY << 32 | _EMPTY << 16)
        while len(rows):
            at = grid.argmin(axis=1)
            line = np.arange(len(rows))
            best = grid[line, at]
            live = best < (_NONE << 48)
            for row, symbols in zip(rows[~live].tolist(), (grid[~live] >> 16 & 0xFFFF).astype(np.int32), strict=True):
                out[row] = symbols[symbols != _EMPTY].tobytes()
            if not live.all():
                rows, grid, at, best, keys = rows[live], grid[live], at[live], best[live], None if keys is None else keys[live]
                line = line[: len(rows)]
            if not len(rows):
                break
            nexts = np.full_like(grid, empty)
            nexts[:, :-1] = grid[:, 1:]
            np.copyto(grid, nexts, where=span[None, :] > at[:, None])  # what is right of the merged pair moves one to the left
            piece, place = best >> 32 & 0xFFFF, best & 0xFF
            if paths is not None:
                for row, *merge in zip(rows.tolist(), place.tolist(), piece.tolist(), strict=True):
                    paths[row] += (tuple(merge),)
            right = np.where(at + 1 < size, grid[line, np.minimum(at + 1, size - 1)] >> 16 & 0xFFFF, _EMPTY)
            grid[line, at] = self._packed(*self._merges(piece, right, place, keys), piece, place)
            more = np.flatnonzero(at > 0)
            if len(more):
                before = grid[more, at[more] - 1]
                part, place = before >> 16 & 0xFFFF, before & 0xFF
                grid[more, at[more] - 1] = self._packed(*self._merges(part, piece[more], place, None if keys is None else keys[more]), part, place)

    @staticmethod
    def _packed(order, piece, part, place) -> np.ndarray:
        return order.astype(np.int64) << 48 | (piece.astype(np.int64) & 0xFFFF) << 32 | part << 16 | place

    def _keys(self, units: np.ndarray, variants: np.ndarray) -> np.ndarray:
        """Hash keys of units (crc32) under their variants."""
        salt = np.uint64((self.seed * 0x9E3779B1 + 1) & 0xFFFFFFFF)
        return kernels.mix(kernels.mix(variants.astype(np.int64).view(np.uint64) ^ salt << np.uint64(32)) ^ units) & np.uint64(0xFFFFFFFF)

    def segment(self, unit: str, variant: int | None) -> bytes:
        """int32 ids of one unit (its spaces still as spaces); variant None: no merge is skipped."""
        if variant is None:
            return self._agenda(unit, lambda k, piece: False)
        return self._keyed(unit, int(self._keys(np.array([zlib.crc32(unit.encode())], np.uint64), np.array([variant]))[0]))

    def _keyed(self, unit: str, key: int) -> bytes:
        """`segment` by the unit's hash key."""
        limit = self.limit

        def skips(k: int, piece: int) -> bool:
            h = (key ^ (k * 0x9E3779B1 + piece * 0xC2B2AE35)) & 0xFFFFFFFF
            h = (h ^ (h >> 16)) * 0x7FEB352D & 0xFFFFFFFF
            h = (h ^ (h >> 15)) * 0x846CA68B & 0xFFFFFFFF
            return h ^ (h >> 16) < limit

        return self._agenda(unit, skips)

    def _agenda(self, unit: str, skips, path: list | None = None) -> bytes:
        """int32 ids of one unit when `skips(place, piece)` says which merges are skipped; `path` gets the others."""
        rank = self.rank
        part: list[str | None] = [SPACE if c == " " else c if c != SPACE else "" for c in unit]
        n = len(part)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for k in range(n - 1):
            if part[k] and part[k + 1] and (r := rank.get(part[k] + part[k + 1])):
                agenda.append((r[0], k, len(part[k]) + len(part[k + 1]), r[1]))
        heapq.heapify(agenda)
        while agenda:
            _, k, size, piece = heapq.heappop(agenda)
            left = part[k]
            if not left or (j := after[k]) >= n or not (right := part[j]) or len(left) + len(right) != size or skips(k, piece):
                continue
            if path is not None:
                path.append((k, piece))
            part[k] = left = left + right
            part[j] = None
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if part[j] and (r := rank.get(left + part[j])):
                    heapq.heappush(agenda, (r[0], k, len(left) + len(part[j]), r[1]))
            i = before[k]
            if i >= 0 and part[i] and (r := rank.get(part[i] + left)):
                heapq.heappush(agenda, (r[0], i, len(part[i]) + len(left), r[1]))
        ids: list[int] = []
        for k, piece in enumerate(part):
            if piece is None:
                continue
            if piece and (r := rank.get(piece)):
                ids.append(r[1])
            else:
                ids += [self.byte_id[b] for b in (piece or unit[k]).encode()]
        return np.array(ids, dtype=np.int32).tobytes()

    def _forget(self) -> None:
        #: First state of each unit, and the state after one more skipped merge by state and place in its path.
        self.number: dict[str, int] = {}
        self.next: dict[int, int] = {}
        #: Of each state: pieces if nothing more is skipped, unit and its crc32, skipped merges; `each`: worked on each time.
        self.known: list[bytes] = []
        self.names: list[str] = []
        self.skips: list[frozenset] = []
        self.each, self.crc = np.empty(0, bool), np.empty(0, np.uint64)
        #: Paths of the states one after another, from `first`; up to `fresh` a path is that of the state before.
        self.place, self.piece = np.empty(0, np.int64), np.empty(0, np.int64)
        self.first, self.fresh = np.zeros(1, np.int64), np.empty(0, np.int64)

    def _remember(self, units: list[str], known: list[bytes], paths: list, skips: list[frozenset], fresh: list[int]) -> range:
        at = range(len(self.names), len(self.names) + len(units))
        self.known += known
        self.names += units
        self.skips += skips
        self.each = np.append(self.each, [p is None for p in paths])
        flat = np.array([m for p in paths for m in p or ()], dtype=np.int64).reshape(-1, 2)
        self.place, self.piece = np.append(self.place, flat[:, 0]), np.append(self.piece, flat[:, 1])
        self.fresh = np.append(self.fresh, np.array(fresh, np.int64))
        self.first = np.append(self.first, self.first[-1] + np.cumsum([len(p or ()) for p in paths]))
        self.crc = np.append(self.crc, np.array([zlib.crc32(u.encode()) for u in units], dtype=np.uint64))
        return at

    def _learn(self, units: list[str]) -> None:
        paths: list = []
        known = self.segment_many(units, None, paths)
        made = self._remember(units, known, paths, [frozenset()] * len(units), [0] * len(units))
        self.number.update(zip(units, made, strict=True))

    def _one_more(self, states: np.ndarray, places: np.ndarray) -> np.ndarray:
        """States after those merges of the states' paths are skipped too; -1 where too few occurrences meet in a new one."""
        codes, back, counts = np.unique(states * SIDE_BY_SIDE + places, return_inverse=True, return_counts=True)
        out = np.array([self.next.get(c, -1) for c in codes.tolist()], dtype=np.int64)
        units, known, paths, skips, fresh = [], [], [], [], []
        missing = np.flatnonzero((out < 0) & (counts >= WORTH_STATE))
        for code in codes[missing].tolist():
            state, place = divmod(code, SIDE_BY_SIDE)
            at = int(self.first[state]) + place
            skipped = self.skips[state] | {(int(self.place[at]), int(self.piece[at]))}
            path: list = []
            known.append(self._agenda(self.names[state], lambda k, piece, s=skipped: (k, piece) in s, path))
            units.append(self.names[state])
            paths.append(path)
            skips.append(skipped)
            fresh.append(place)
        if len(missing):
            made = self._remember(units, known, paths, skips, fresh)
            out[missing] = np.array(made)
            self.next.update(zip(codes[missing].tolist(), made, strict=True))
        return out[back]

    def _pieces(self, which: np.ndarray, variants: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """ids of occurrences of known units, and the places of those that are left to be segmented on their own."""
        if not self.limit:
            return list(map(self.known.__getitem__, which.tolist())), np.empty(0, np.int64)
        keys = self._keys(self.crc[which], variants)
        state = which.copy()
        rows = np.arange(len(which))
        alone = [np.flatnonzero(self.each[which])]
        while len(rows):
            begin = self.first[state[rows]] + self.fresh[state[rows]]
            counts = self.first[state[rows] + 1] - begin
            owner = np.repeat(np.arange(len(rows)), counts)
            at = np.arange(len(owner)) + np.repeat(begin - np.cumsum(counts) + counts, counts)
            hits = np.flatnonzero(self._skipped(keys[rows][owner], self.place[at], self.piece[at]))
            who, firsts = np.unique(owner[hits], return_index=True)
            rows = rows[who]
            if len(rows):
                after = self._one_more(state[rows], at[hits[firsts]] - self.first[state[rows]])
                alone.append(rows[after < 0])
                rows = rows[after >= 0]
                state[rows] = after[after >= 0]
        return list(map(self.known.__getitem__, state.tolist())), np.concatenate(alone)

    def encode_many(self, texts: list[str], ids: list[int | None] | None = None) -> list[np.ndarray]:
        """Ids of whole texts, each led by a space as the model's texts are; `ids` tells documents of one text apart."""
        out = [np.empty(0, np.int32)] * len(texts)
        mine: list[tuple[int, list[str]]] = []
        total = 0
        for k, text in enumerate(texts):
            if text:
                mine.append((k, self.units.findall(" " + text)))
                total += len(mine[-1][1])
            if mine and (total >= OCCURRENCES or k == len(texts) - 1):
                self._encode_some(texts, ids, mine, out)
                mine, total = [], 0
        if mine:
            self._encode_some(texts, ids, mine, out)
        return out

    def _encode_some(self, texts, ids, mine, out) -> None:
        units = [u for _, some in mine for u in some]
        counts = Counter(units)
        new = [u for u, n in counts.items() if n >= WORTH_STATE and u not in self.number]
        if len(self.names) + len(new) > REMEMBERED:
            self._forget()
            new = [u for u, n in counts.items() if n >= WORTH_STATE]
        if new:
            self._learn(new)
        get = self.number.get
        which = np.array([get(u, -1) for u in units], dtype=np.int64)
        sizes = np.array([len(some) for _, some in mine])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        named = np.array([zlib.crc32(f"{ids[k] if ids else None}\n{texts[k]}".encode()) for k, _ in mine], dtype=np.int64)
        variants = np.repeat(named, sizes) << 31 ^ (np.arange(ends[-1]) - np.repeat(ends[:-1], sizes))
        found = np.empty(len(units), dtype=object)
        often = np.flatnonzero(which >= 0)
        found[often], alone = self._pieces(which[often], variants[often])
        rows = np.sort(np.concatenate((np.flatnonzero(which < 0), often[alone])))
        if len(rows):
            found[rows] = self.segment_many([units[k] for k in rows.tolist()], variants[rows])
        found = found.tolist()
        for (k, _), a, b in zip(mine, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[k] = np.frombuffer(b"".join(found[a:b]), dtype=np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def _encoder(model: bytes, dropout: float, seed: int) -> DropoutEncoder:
    return DropoutEncoder(model, dropout, seed)


def encode_pieces(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """One row per row of `docs`: `(id_col, ids, n_tokens, lossless)`; `lossless` says that decoding gives the text.

    Null and empty texts have no ids; repeated rows are encoded alike, equal texts of other ids are not; a null id stays null; extra columns are ignored;
    an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, dropout, seed)
        texts = kernels.plain(batch.column(1))
        for start, stop in kernels.runs(texts, RUN_BYTES):
            values = texts[start:stop].to_pylist()
            found = encoder.encode_many(values, batch.column(0)[start:stop].to_pylist())
            good = [encoder.decode(x) == t for x, t in zip(found, values, strict=True)]
            counts = np.array([len(x) for x in found], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], lists, pa.array(counts), pa.array(good)], ["id", "ids", "n_tokens", "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, fn, "id long, ids array<int>, n_tokens long, lossless boolean").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: bytes, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """`encoded` with the text of its ids as last column `to`, in the place of one that is named so already.

    Null ids give a null text, none an empty one; repeated rows are decoded alike; an empty table gives an empty result.
    """
    ids = [c for c in encoded.columns if c != to]
    rows = encoded.select(*[f"`{c}`" for c in ids], F.col(ids_col).alias("glyphmill_ids"))
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, 0.0, 0)
        texts = [None if x is None else encoder.decode(np.array(x, dtype=np.int32)) for x in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], to])

    return map_batches(rows, fn, StructType([*rows.schema.fields[:-1], StructField(to, StringType())]))
