"""SentencePiece encoding and decoding of texts with a BPE model, by suffix-array matching.

Texts fall into chunks that no piece crosses (a run of word marks with what follows up to the next mark, and single
characters that occur in no longer piece, such as a line feed). The distinct chunks of a batch that aren't known yet are
one text; it is indexed by a suffix array over the first characters of its suffixes, as many as the longest piece has.
Every piece is found in it by binary search as a range of suffixes; the ranges give edges (from, to, piece), which are
sorted by position and relaxed from left to right, for all chunks at once.

A place in a chunk is reached by one piece only: the last of the prefix's own encoding. An edge is relaxed if the piece
that reaches its start and the edge's piece stay apart, that is, if merging by rank never joins what stands at their
border (:meth:`Pieces.apart`). So the path is the encoding of the model, not only one of the highest score. Characters that are
no piece become byte pieces.

Defined results: a null text counts as empty and has no ids; the mark U+2581 in a text is decoded as a space, as the
model defines it, and every other text survives the round trip; rows are encoded one by one; an empty table gives an
empty result. Other columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memory, core, texts, tokenizer_path

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct chunks whose ids a worker remembers.
REMEMBERED = 600_000
#: Characters of new chunks that are indexed at once.
INDEXED = 400_000


class Pieces:
    """The pieces of a model, and how merging by rank makes each from two others."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.id = {names[i]: i for i in plain}
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(names[i][1:-1], 16)] = i
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = names[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte.tolist()):
            self.raw[i] = bytes([b])
        # rank: pieces merge in the order of their scores; characters are there from the start. One more row: no piece.
        self.rank = np.full(n + 1, -1, np.int64)
        longer = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: -model.get_score(i))
        self.rank[longer] = np.arange(len(longer))
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.usable = {names[i]: i for i in plain if len(names[i]) == 1}
        for i in longer:
            parts = self._halves(names[i])
            if parts:
                self.left[i], self.right[i] = parts
                self.usable[names[i]] = i
        made = np.array([i for i in longer if self.left[i] >= 0], np.int64)
        key = self.left[made] * (n + 1) + self.right[made]
        order = np.argsort(key)
        self.pairs, self.made = key[order], made[order]
        self.longest = max(map(len, self.usable))
        inside = {c for i in longer for c in names[i]}
        single = "" if "\n" in inside else "\n"
        self.chunk = re.compile(f"{MARK}*[^{MARK}{single}]+|{MARK}+|{single or '(?!)'}")
        if any(MARK in x.lstrip(MARK) for x in self.usable):
            raise ValueError("a piece crosses a word mark; texts can't be cut there")

    def _halves(self, name: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes ``name`` when its characters are merged by rank; None if they never do."""
        parts = [self.id.get(c, -1) for c in name]
        words = list(name)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(words[k] + words[k + 1])
                if i is not None and (best is None or self.rank[i] < self.rank[best]):
                    best, at = i, k
            if best is None:
                return None
            if len(parts) == 2:
                return (parts[0], parts[1]) if min(parts) >= 0 else None
            parts[at : at + 2] = [best]
            words[at : at + 2] = [words[at] + words[at + 1]]
        return None

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, stay as they are.

        Back in time from (a, b): whichever of the two at the border was made last is taken apart again. A merge across
        the border spoils the pair if it would have come before the one that ended either side; of equal ranks the left one
        comes first.
        """
        out = np.ones(len(a), bool)
        x, y = a.copy(), b.copy()
        ends_x = ends_y = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            key = x * (self.size + 1) + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = self.pairs[at] == key
            rank = self.rank[self.made[at]]
            bad = joined & (rank < ends_x) & (rank <= ends_y)
            out[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            later = rx >= ry
            ends_x, ends_y = np.where(later, rx, ends_x), np.where(later, ends_y, ry)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
            go = ~bad & (np.maximum(rx, ry) >= 0)
            live, x, y, ends_x, ends_y = live[go], x[go], y[go], ends_x[go], ends_y[go]
        return out


@lru_cache(2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Index:
    """A suffix array over the first ``width`` characters of each suffix."""

    def __init__(self, text: str, width: int) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.letters = np.unique(codes)
        dense = np.searchsorted(self.letters, codes).astype(np.uint64) + np.uint64(1)
        self.bits = max(1, int(len(self.letters)).bit_length())
        self.per = 63 // self.bits  # characters in a key
        self.keys = []
        for start in range(0, width, self.per):
            key = np.zeros(len(codes), np.uint64)
            for k in range(start, start + self.per):
                key <<= np.uint64(self.bits)
                if k < min(width, len(codes)):
                    key[: len(codes) - k] |= dense[k:]
            self.keys.append(key)
        self.order = np.lexsort(self.keys[::-1])
        self.keys = [k[self.order] for k in self.keys]

    def find(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each name the range of suffixes that begin with it."""
        low = [np.zeros(len(names), np.uint64) for _ in self.keys]
        high = [np.zeros(len(names), np.uint64) for _ in self.keys]
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        codes = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        there = self.letters[place] == codes
        starts = np.cumsum(lengths) - lengths
        known = np.logical_and.reduceat(there, starts)
        for k in range(self.per * len(self.keys)):
            has = k < lengths
            letter = np.where(has, place[np.minimum(starts + k, len(codes) - 1)] + 1, 0).astype(np.uint64)
            i, shift = k // self.per, np.uint64(self.bits)
            low[i] = (low[i] << shift) | letter
            high[i] = (high[i] << shift) | np.where(has, letter, np.uint64((1 << self.bits) - 1))
        first, last = self._search(low, False), self._search(high, True)
        return np.where(known, first, 0), np.where(known, last, 0)

    def _search(self, wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all names at once; after: behind equal keys."""
        n = len(self.order)
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = np.minimum(mid, n - 1)
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for key, w in zip(self.keys, wanted, strict=True):
                k = key[at]
                less |= same & (k < w)
                same &= k == w
            below = less | same if after else less
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        return lo


def encode_chunks(pieces: Pieces, chunks: list[str]) -> list[np.ndarray]:
    """The ids of each chunk; none is empty."""
    text = "".join(chunks)
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner_end = np.repeat(ends, lengths)
    offset = np.arange(len(text)) - np.repeat(starts, lengths)
    names = list(pieces.usable)
    ids = np.fromiter(pieces.usable.values(), np.int64, len(names))
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    index = Index(text, pieces.longest)
    lo, hi = index.find(names)
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(names)), count)
    begin = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(which))
    source = index.order[begin]
    target = source + sizes[which]
    fits = target <= owner_end[source]
    source, target, piece = source[fits], target[fits], ids[which[fits]]
    lone = np.ones(len(text), bool)  # characters that are no piece: an edge with the number after the last piece
    lone[source[target == source + 1]] = False
    at = np.flatnonzero(lone)
    source, target, piece = (np.concatenate(x) for x in ((source, at), (target, at + 1), (piece, np.full(len(at), pieces.size))))
    order = np.argsort(offset[source], kind="stable")
    source, target, piece = source[order], target[order], piece[order]
    bounds = np.searchsorted(offset[source], np.arange(int(lengths.max()) + 1))
    last = np.full(len(text) + 1, -1, np.int64)  # by the place before which a piece ends; -1: not reached
    length = np.zeros(len(text) + 1, np.int64)
    for step in range(len(bounds) - 1):
        s, e, p = (x[bounds[step] : bounds[step + 1]] for x in (source, target, piece))
        if step:
            held = last[s]
            s, e, p, held = (x[held >= 0] for x in (s, e, p, held))
            good = pieces.apart(held, p)
            s, e, p = s[good], e[good], p[good]
        last[e], length[e] = p, e - s
    found, owners = [], []
    place, own = ends.copy(), np.arange(len(chunks))
    while len(place):
        found.append(last[place])
        owners.append((own, place))
        place = place - length[place]
        more = place > starts[own]
        place, own = place[more], own[more]
    flat, who, where = np.concatenate(found), np.concatenate([o for o, _ in owners]), np.concatenate([p for _, p in owners])
    order = np.lexsort((where, who))
    flat, who, where = flat[order], who[order], where[order]
    if (flat == pieces.size).any():  # spell characters that are no piece in bytes
        out_ids, out_who = [], []
        for i, w, p in zip(flat.tolist(), who.tolist(), where.tolist(), strict=True):
            own_ids = pieces.byte[list(text[p - 1].encode("utf-8", "replace"))].tolist() if i == pieces.size else [i]
            out_ids += own_ids
            out_who += [w] * len(own_ids)
        flat, who = np.array(out_ids, np.int64), np.array(out_who, np.int64)
    return np.split(flat, np.searchsorted(who, np.arange(1, len(chunks))))


class Codec:
    """Encodes and decodes texts; remembers chunks."""

    def __init__(self, path: str) -> None:
        self.pieces = pieces_of(path)
        self.known = Memory(REMEMBERED)
        self.raw = np.array(self.pieces.raw, object)

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        split = [self.pieces.chunk.findall(MARK + x.replace(" ", MARK)) if x else [] for x in batch]
        new = self.known.missing(set().union(*split))
        lot, size = [], 0
        for x in new:
            lot.append(x)
            size += len(x)
            if size >= INDEXED:
                self._learn(lot)
                lot, size = [], 0
        if lot:
            self._learn(lot)
        known = self.known
        return [np.frombuffer(b"".join([known[c] for c in x]), "<u4") for x in split]

    def _learn(self, lot: list[str]) -> None:
        for x, ids in zip(lot, encode_chunks(self.pieces, lot), strict=True):
            self.known[x] = ids.astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(self.raw[ids].tolist())
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each worker process, which remembers chunks from task to task."""
    return Codec(path)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each row: id, n_ids, ids_crc32, round_trip (whether decoding gives the text again), and ids (little-endian, 32 bits)."""
    rows, path = core(docs, id_col, text_col), path or tokenizer_path(MODEL)
    schema = T.StructType(
        [rows.schema[id_col], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )

    def run(batches):
        own = codec(path)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                plain = list(texts(part, text_col))
                found = own.encode(plain)
                cols = [
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()),
                    pa.array([own.decode(x) == t.replace(MARK, " ") for x, t in zip(found, plain, strict=True)], pa.bool_()),
                ] + [pa.array([x.tobytes() for x in found], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays([part.column(id_col), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode_texts(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row for each row: id, text. Null ids are an empty text."""
    path = path or tokenizer_path(MODEL)
    rows = core(encoded, id_col, ids_col)
    schema = T.StructType([rows.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches):
        own = codec(path)
        for b in batches:
            found = [own.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(found, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
