"""Near-duplicates by SimHash with pigeonring filtering.

A text's fingerprint has 64 bits: each is 1 if it is set in over half of the XXH64 values (seed 42) of the text's
3-word shingles, repeats included. Two fingerprints link if at most :data:`BITS` bits differ.

Candidates. The 64 bits form a ring of 8 segments of 8 bits. If two fingerprints differ in at most 3 bits, then some
segment starts a chain of which every prefix of length l holds at most 3 * l / 8 differing bits (the pigeonring
principle): the first two segments are equal, the first five hold at most 1, the first seven at most 2 differing bits.
Of the 24 bits of segments 3 to 5, one half is then equal as well. So 16 keys (8 starts, 2 halves) of 28 bits find
every link; what shares a key is held against the chain's budgets before all 64 bits are compared. Nothing is capped.

Skew. Equal fingerprints are one node, however many rows have them. Fingerprints that share a key make a bucket; a bucket
gives no pairs but a spanning forest of its links (at most one edge for each member). A bucket that a sample shows to
be large is cut into blocks, and each pair of blocks is a task's group of its own. The sample decides only where the work
is done; the links found are the same.

Components are found by alternating large-star and small-star steps on fingerprints, each written to the shared folder.

Defined results: null and blank texts have fingerprint 0 and link like any other; texts of fewer than three words are
one shingle; rows that repeat a text or an id share the class; a null id gets a class too but never names one unless
all ids of the class are null; an empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflux.operators.components import components, cut

from .common import core, slices, texts, unused

BITS = 3
SHINGLE = 3
SEED = 42
STARTS = 8
#: Members of a bucket that one group handles; larger ones are cut into blocks of about this size.
BLOCK = 4096
#: One fingerprint in so many is looked at to find large buckets.
SAMPLED = 16

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_FIVE, _SEVEN = np.uint64(2**40 - 1), np.uint64(2**56 - 1)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words (ASCII letters in lower case) of the text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII changes, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) <= size:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str) -> int:
    """The text's fingerprint, unsigned."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    parts = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(parts[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, fp): each row's id and its fingerprint as a signed long."""
    rows = core(docs, id_col, text_col)

    def run(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(x) for x in texts(b, text_col)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc", "fp"])

    return rows.mapInArrow(run, "doc long, fp long")


def _ring(fp: Column, start: int) -> Column:
    """``fp`` turned so that segment ``start`` comes lowest."""
    return fp if not start else F.shiftrightunsigned(fp, 8 * start).bitwiseOR(F.shiftleft(fp, 64 - 8 * start))


def _keys(nodes: DataFrame) -> DataFrame:
    """(key, fp): the 16 keys of every fingerprint; a key's lowest 4 bits name its start and half."""
    out = []
    for start in range(STARTS):
        turned = _ring(F.col("fp"), start)
        chain, halves = turned.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(turned, 16)
        for half in range(2):
            part = F.shiftrightunsigned(halves, 12 * half).bitwiseAND(F.lit(0xFFF))
            out.append(F.shiftleft(F.shiftleft(part, 16).bitwiseOR(chain), 4).bitwiseOR(F.lit(2 * start + half)))
    return nodes.select(F.explode(F.array(*out)).alias("key"), "fp")


def linked(turned: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` link with ``turned``: the chain's budgets first, the rest only for those that keep them."""
    diff = turned ^ others
    near = np.bitwise_count(diff & _FIVE) <= 1
    near &= np.bitwise_count(diff & _SEVEN) <= 2
    at = np.flatnonzero(near)
    return at[np.bitwise_count(diff[at]) <= BITS]


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Edges that join the members of a bucket as their links do: a search over members not yet reached."""
    turned = (fps >> np.uint64(8 * start)) | (fps << np.uint64(64 - 8 * start)) if start else fps
    rest = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = linked(turned[at], turned[rest])
            if len(hit):
                found = rest[hit]
                edges += [(at, int(x)) for x in found]
                queue += found.tolist()
                rest = np.delete(rest, hit)
    return edges


def _bucket_edges(batches):
    """Forests of the buckets of rows that come sorted by bucket; a bucket may go on in the next batch."""

    def edges(fps: list[np.ndarray], key: int) -> list[np.ndarray]:
        members = np.unique(np.concatenate(fps)).view(np.uint64)
        found = forest(members, int(key & 15) >> 1)
        return [members[np.array(found)].view(np.int64).reshape(-1, 2)] if found else []

    def flush(out: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    last, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        key, block, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(key)]
        out: list[np.ndarray] = []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            now = (int(key[lo]), int(block[lo]))
            if now == last:
                held.append(fp[lo:hi].copy())
                continue
            if last is not None and sum(map(len, held)) > 1:
                out += edges(held, last[0])
            last, held = now, [fp[lo:hi].copy()]
        if out:
            yield flush(out)
    if last is not None and sum(map(len, held)) > 1 and (out := edges(held, last[0])):
        yield flush(out)


def fingerprint_links(nodes: DataFrame, block: int = BLOCK, sampled: int = SAMPLED) -> DataFrame:
    """(a, b): links between distinct fingerprints whose closure is that of all links."""
    keys = _keys(nodes)
    seen = _keys(nodes.filter(F.pmod(F.xxhash64("fp"), F.lit(sampled)) == 0))
    # members of a bucket, as estimated from the sample, are at least block / 2 here: there are at most 32 * nodes / block such keys
    large = seen.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * sampled > block // 2)
    large = cut(large.select("key", F.ceil(F.col("n") * sampled / block).cast("int").alias("blocks")))
    if large.isEmpty():
        dealt = keys.select("key", F.lit(0).alias("block"), "fp")
    else:
        side = keys.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int"))
        # a block meets every other one in the group named by the two
        met = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda o: F.least("own", o) * F.coalesce("blocks", F.lit(1)) + F.greatest("own", o))
        dealt = side.select("key", F.explode(met).alias("block"), "fp")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_bucket_edges, "a long, b long").distinct()


def _classes(found: DataFrame, block: int, sampled: int) -> tuple[DataFrame, DataFrame]:
    """(fp, component): for fingerprints that link with others, and for all."""
    nodes = cut(found.groupBy("fp").agg(F.min("doc").alias("least")))
    roots = components(fingerprint_links(nodes, block, sampled))
    member = nodes.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = member.groupBy("root").agg(F.min("least").alias("component"))
    return nodes, member.join(named, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, sampled: int = SAMPLED) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id (smallest id that links lead to)."""
    found = cut(fingerprints(docs, id_col, text_col))
    _, classes = _classes(found, block, sampled)
    return found.join(classes, "fp", "left").select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, sampled: int = SAMPLED) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class, one row with the smallest id.

    Whole rows are dealt out once, by id, past a hash table of the ids that stay. Rows that repeat an id count as one
    document; only they are held against each other, and only if there are any. Rows without an id can't be named by a
    class; they all stay.
    """
    fp_of, kind = unused(docs.columns, "least"), docs.schema[id_col].dataType
    found = cut(fingerprints(docs.filter(F.col(id_col).isNotNull()), id_col, text_col))
    nodes, classes = _classes(found, block, sampled)
    winners = nodes.join(classes, "fp").filter(F.col("least") == F.col("component")).select(F.col("least").cast(kind).alias(fp_of)).distinct()
    again = cut(found.groupBy("doc").count().filter("count > 1").select(F.col("doc").cast(kind).alias(fp_of)))

    def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(ids.hint("shuffle_hash"), F.col(id_col) == F.col(fp_of), how)

    kept = among(docs, winners, "left_semi")
    if not again.isEmpty():
        kept = among(kept, again, "left_anti").unionByName(among(kept, again, "left_semi").dropDuplicates([id_col]))
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
