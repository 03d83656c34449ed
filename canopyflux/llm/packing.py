"""Best-fit packing of token sequences by patterns fitted to the histogram of lengths.

1. Every text becomes its token ids and one end id, cut into pieces of at most ``capacity`` ids. This runs on the
   executors; only the lengths matter to what follows.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the corpus) goes to the driver. Patterns of few
   lengths that fill a sequence are enumerated, and repeat counts are fitted to the histogram by non-negative least
   squares, rounded down and held to what there is.
3. What the patterns leave (again a histogram) is packed best-fit decreasing into the room of the fitted sequences and new
   ones, by groups of equal sequences, so that it takes as long for 10 pieces of a length as for 10 million.
4. Both give patterns with repeat counts. A piece has a place among those of its length (numbered by partition, without a
   sort of all rows), and that place names its sequence and its offset.

Defined results: a null or empty text is one piece that holds the end id only. Rows that repeat an id are packed row by
row. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memory, core, cut, tokenizer_path

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Distinct parts of words whose ids a worker remembers.
REMEMBERED = 800_000
#: A plan: the lengths of a sequence in the order of their offsets, and how many such sequences there are.
Plan = list[tuple[tuple[int, ...], int]]


#: The signs by which byte-level models name bytes: themselves if printable, else the next free code points from U+0100.
BYTE_SIGNS = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
BYTE_SIGNS |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in BYTE_SIGNS)}


class WordIds:
    """Token ids of texts by way of their distinct words.

    The tokenizer drops white space and case, and no token crosses white space or the border between letters and the
    signs after them, so that the ids of a text are those of its words one after the other, and those of a word of
    letters and signs are those of its stem (in lower case) and of its signs. Splitting, finding distinct words and parts
    and putting ids together are array operations; each distinct part is encoded once for as long as it is remembered,
    many at a time, with a mark between them: a control character that is one token by itself. A part that holds the mark
    is encoded alone.
    """

    MARK = "\x01"
    #: Letters that have one code point in any form, and signs that are no part of a contraction.
    LETTERS, SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]", r"[!-&(-/:-@\[-`{-~]"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.stem = re.compile(f"{self.LETTERS}+")
        (self.mark,) = self._encode([self.MARK])[0]
        self.parts = Memory(REMEMBERED)

    def _encode(self, lines: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        stems = [x for x in new if x.isalpha() and (x.isascii() or self.stem.fullmatch(x))]
        others = new.difference(stems)
        alone = [x for x in others if self.MARK in x]
        for x, ids in zip(alone, self._encode(alone), strict=True):
            self.parts[x] = np.array(ids, "<u4").tobytes()
        self._learn_many(list(others.difference(alone)), self.tokenizer, str)
        # stems, in lower case as they are, need no more than their bytes as the model's signs
        self._learn_many(stems, self.plain, lambda x: x.encode().decode("latin-1").translate(BYTE_SIGNS | {32: " "}))

    def _learn_many(self, parts: list[str], tokenizer, spelt) -> None:
        between = f" {self.MARK} "
        for i in range(0, len(parts), 50_000):
            lots = [parts[j : j + 500] for j in range(i, min(i + 50_000, len(parts)), 500)]
            found = tokenizer.encode_batch_fast([spelt(between.join(x)) for x in lots], add_special_tokens=False)
            for lot, e in zip(lots, found, strict=True):
                row = np.array(e.ids, "<u4")
                raw, ends = row.tobytes(), np.flatnonzero(row == self.mark).tolist()
                if len(ends) != len(lot) - 1:
                    raise ValueError("the mark isn't a token of its own")
                for x, a, b in zip(lot, [-1, *ends], [*ends, len(row)], strict=True):
                    self.parts[x] = raw[4 * a + 4 : 4 * b]

    def _part_ids(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each part where its ids start in a pool and how many there are, and the pool."""
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(self.parts.missing(set(distinct)))
        blobs = [self.parts[x] for x in distinct]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        at = coded.indices.to_numpy()
        return (np.cumsum(sizes) - sizes)[at], sizes[at], np.frombuffer(b"".join(blobs), "<u4")

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_part_ids` for words."""
        simple = pc.match_substring_regex(words, f"^{self.LETTERS}+{self.SIGNS}*$")
        stems = pc.if_else(simple, pc.utf8_lower(pc.replace_substring_regex(words, f"{self.SIGNS}+$", "")), words)
        signs = pc.if_else(simple, pc.replace_substring_regex(words, f"^{self.LETTERS}+", ""), "")
        (at, n, pool), (sign_at, sign_n, sign_pool) = self._part_ids(stems), self._part_ids(signs)
        both = np.column_stack([n, sign_n]).ravel()
        start = np.column_stack([at, sign_at + len(pool)]).ravel()
        total = n + sign_n
        return np.cumsum(total) - total, total, _gather(start, both, np.concatenate([pool, sign_pool]))

    def __call__(self, column: pa.Array, at_once: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For so many texts at once their ids, one after the other without end ids, and how many each text has.

        Distinct words are looked up once for the whole column.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        words = lists.flatten().dictionary_encode()
        at, n, pool = self._words(words.dictionary)
        own = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        for lo in range(0, len(column), at_once):
            bounds = ends[lo : lo + at_once + 1]
            part = own[bounds[0] : bounds[-1]]
            total = np.concatenate([[0], np.cumsum(n[part])])[bounds - bounds[0]]
            yield _gather(at[part], n[part], pool), np.diff(total)


def _gather(start: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``start``, one after the other."""
    skip = start - (np.cumsum(sizes) - sizes)
    return pool[np.repeat(skip, sizes) + np.arange(int(sizes.sum()))]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    """One for each worker process, as loading takes longer than small tasks do."""
    return WordIds(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, ids, and the part and place there among its length."""
    rows, path = core(docs, id_col, text_col), path or tokenizer_path(TOKENIZER)
    kinds = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("ids", T.BinaryType()), ("part", T.LongType()), ("nth", T.LongType())]
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType)] + [T.StructField(n, t) for n, t in kinds])

    def run(batches):
        encode, part_id = word_ids(path), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            lo = 0
            for ids, counts in encode(b.column(text_col)):
                part = b.slice(lo, len(counts))
                lo += len(counts)
                raw, done = ids.tobytes(), 0
                at, rest = [], []
                for i, n in enumerate(counts.tolist()):
                    whole = raw[4 * done : 4 * (done + n)] + end
                    done += n
                    for k, start in enumerate(range(0, len(whole), 4 * capacity)):
                        own = whole[start : start + 4 * capacity]
                        length = len(own) // 4
                        at.append(i)
                        rest.append((k, start // 4, length, zlib.crc32(own), own if with_ids else None, part_id, seen[length]))
                        seen[length] += 1
                cols = list(zip(*rest, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array(at)), *arrays], names=schema.names)
        encode.parts.forget()  # the worker lives on, for other work
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


# --- the plan, on the driver, from the histogram alone -----------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Least squares of a @ x = b with x >= 0, by cyclic coordinate descent on the normal equations."""
    gram, x = a.T @ a, np.zeros(a.shape[1])
    slope = -(a.T @ b)
    scale = np.diag(gram).copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(scale):
            step = max(-x[j], -slope[j] / scale[j])
            if step:
                x[j] += step
                slope += step * gram[j]
                moved = max(moved, abs(step))
        if moved < 1e-3 * max(1.0, x.max(initial=0.0)):
            break
    return x


def spare(capacity: int) -> int:
    """Ids that a pattern may leave free; emptier sequences are left to best fit, which has all lengths to choose from."""
    return capacity // 128


def patterns(counts: np.ndarray, capacity: int, most: int = 1500) -> list[tuple[int, ...]]:
    """Multisets of lengths that there are pieces of, which fill a sequence but for :func:`spare` ids, fullest first.

    For each length: the best second one, and for pairs the best third and fourth ones, by the largest length that fits;
    and each length as often as it fits, with the largest ones that fit in what that leaves.
    """
    there = np.flatnonzero(counts)
    if not len(there):
        return []
    best = np.zeros(capacity + 1, np.int64)  # the largest length there is that is at most the room
    best[there] = there
    best = np.maximum.accumulate(best)
    out = {(x, capacity - x) for x in there.tolist() if 2 * x >= capacity > x and counts[capacity - x]}
    out |= {tuple(sorted((x, int(best[capacity - x])), reverse=True)) for x in there.tolist() if best[capacity - x]}
    for x in there.tolist():
        for times in range(capacity // x, max(0, capacity // x - 4), -1):
            held, room = [x] * times, capacity - times * x
            while best[room]:
                held.append(int(best[room]))
                room -= held[-1]
            out.add(tuple(sorted(held, reverse=True)))
    i, j = np.triu_indices(len(there))
    some = slice(None, None, 1 + len(i) // 300_000)
    first, second = there[j[some]], there[i[some]]
    room = capacity - first - second
    first, second, room = (x[room > 0] for x in (first, second, room))
    third = best[room]
    fourth = best[room - third]
    rows = np.stack([first, second, third, fourth], 1)[(third + fourth == room) & (third > 0)]
    out |= {tuple(sorted((x for x in row if x), reverse=True)) for row in rows.tolist()}
    full = sorted((p for p in out if sum(p) >= capacity - spare(capacity)), key=lambda p: (-sum(p), len(p), p))
    pairs = [p for p in full if len(p) == 2]
    others = [p for p in full if len(p) > 2]
    keep = max(most - len(pairs), most // 2)
    return pairs[: most] + others[:: max(1, len(others) // keep)][:keep]


def fitted(counts: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """Patterns with repeat counts fitted to the histogram (index: length), and the histogram of what they leave."""
    left = counts.copy()
    plan: Plan = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    found = patterns(left, capacity)
    if not found:
        return plan, left
    rows = {int(x): i for i, x in enumerate(np.flatnonzero(left))}
    a = np.zeros((len(rows), len(found)))
    for j, p in enumerate(found):
        for x in p:
            a[rows[x], j] += 1
    x = nnls(a, left[left > 0].astype(float))
    for j in np.argsort(-x, kind="stable").tolist():
        use = Counter(found[j])
        times = min([int(np.floor(x[j] + 1e-9))] + [int(left[v]) // k for v, k in use.items()])
        if times > 0:
            plan.append((found[j], times))
            for v, k in use.items():
                left[v] -= times * k
    return plan, left


def best_fit(counts: np.ndarray, capacity: int, begun: Plan = ()) -> Plan:
    """Best-fit decreasing over a histogram, into the room of sequences that are begun and into new ones.

    Sequences that hold the same lengths are one group with a count.
    """
    groups: dict[int, list[list]] = {}  # room: [lengths, count]
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, held: tuple[int, ...], n: int) -> None:
        groups.setdefault(room, []).append([held, n])
        rooms[room] = True

    for held, n in begun:
        put(capacity - sum(held), held, n)
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fitting = np.flatnonzero(rooms[length:])
            if not len(fitting):
                per = capacity // length
                if n >= per:
                    put(capacity - per * length, (length,) * per, n // per)
                    n %= per
                if n:
                    put(capacity - n * length, (length,) * n, 1)
                    n = 0
                continue
            room = int(fitting[0]) + length
            held, many = groups[room].pop()
            if not groups[room]:
                rooms[room] = False
            per = min(room // length, n)
            times = min(many, n // per)
            put(room - per * length, held + (length,) * per, times)
            if many > times:
                put(room, held, many - times)
            n -= times * per
    return [(held, n) for found in groups.values() for held, n in found]


def packed(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """The plan for a histogram (index: length): fitted patterns, then best fit for what they leave, into their room, too."""
    plan, left = fitted(counts, capacity)
    return best_fit(left, capacity, plan)


def slots(plan: Plan) -> list[tuple[int, int, int, list[int]]]:
    """Rows (length, first place, first sequence, offsets): where the pieces of a length go in turn.

    A pattern that holds a length k times takes k places for each of its sequences.
    """
    used: Counter[int] = Counter()
    out, sequence = [], 0
    for held, n in plan:
        offsets: dict[int, list[int]] = {}
        for x, at in zip(held, accumulate((0, *held)), strict=False):
            offsets.setdefault(x, []).append(at)
        for x, at in offsets.items():
            out.append((x, used[x], sequence, at))
            used[x] += n * len(at)
        sequence += n
    return out


# --- the assignment ----------------------------------------------------------------------------------------------------


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with part, length (1 to ``capacity``) and nth (their place in the part among that length).

    ``found`` must be written: it is read more than once.
    """
    by_part = cut(found.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length: capacity rows at most
        counts[r["length"]] = r["n"]
    rows = sorted(slots(packed(counts, capacity)))
    key = np.array([(x << 40) + first for x, first, _, _ in rows], np.int64)
    sequence = np.array([s for _, _, s, _ in rows], np.int64)
    first = np.array([f for _, f, _, _ in rows], np.int64)
    per = np.array([len(at) for *_, at in rows], np.int64)
    begin = np.cumsum(per) - per
    offsets = np.array([x for *_, at in rows for x in at], np.int64)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = found.join(base, ["part", "length"]).withColumn("place", F.col("base") + F.col("nth")).drop("base", "nth", "part")
    kept = [f for f in placed.schema.fields if f.name != "place"]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        for b in batches:
            length, place = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "place"))
            i = np.searchsorted(key, (length << 40) + place, "right") - 1
            turn = place - first[i]
            own = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            found_at = [pa.array(sequence[i] + turn // per[i]), pa.array(offsets[begin[i] + turn % per[i]])] if len(i) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*own, *found_at], names=schema.names)

    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each row: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    The ids are little-endian unsigned 32-bit numbers in ``ids``.
    """
    found = pieces(docs, id_col, text_col, capacity, path, with_ids)
    return pack(cut(found if with_ids else found.drop("ids")), capacity)
