"""Exact deduplication of texts, with DataFrame operations only.

Equal texts are found in three combining steps, and each step groups by the full normalised text, never by a digest
alone: (1) every task combines its own rows (the map side of the first aggregation; the salt is constant in a task, so
that a group of copies leaves a task as one row), (2) the rows of a salted digest group are merged, (3) the winners of
all salts are combined by digest. A group that holds a third of all rows therefore reaches step 3 as one row for each salt.

The winner of a group is the row with the most code points in its original text, then the smallest id. The decision is
then joined back to the rows by digest. Should a digest ever stand for two different contents, those rows, and only
those, are joined by digest and full content instead.

Defined results: a null text counts as empty, so null, empty and blank texts are one group. A null id ranks behind all
others. Rows that repeat id and text all name that id as the one to keep; :func:`drop_exact_copies` keeps one of them.
An empty table gives an empty result. Other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, core, cut, unused

#: Salts among which the rows of one digest are spread before they are combined for good.
SALTS = 32


def squeezed(text: Column) -> Column:
    """``text`` without ASCII white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in ASCII_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def _rank(chars: Column, doc: Column) -> Column:
    """A number that orders rows by code points, then by descending id; null ids come last."""
    place = F.coalesce(F.lit(str(2**63)).cast("decimal(20,0)") - doc.cast("decimal(20,0)"), F.lit("0").cast("decimal(20,0)"))
    return (chars.cast("decimal(11,0)") * F.lit(str(2**65)).cast("decimal(20,0)") + place).cast("decimal(38,0)")


def _contents(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    raw = F.coalesce(F.col(text_col), F.lit(""))
    return core(docs, id_col, text_col).select(
        F.col(id_col).cast("long").alias("doc"), squeezed(F.col(text_col)).alias("content"), F.char_length(raw).alias("chars")
    ).withColumn("digest", digest(F.col("content")))


def content_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row for each distinct content: digest, content, keep (id), rank, copies."""
    rows = _contents(docs, id_col, text_col, digest).select(
        (F.spark_partition_id() % salts).alias("salt"), "digest", "content", "doc", _rank(F.col("chars"), F.col("doc")).alias("rank")
    )
    merged = rows.groupBy("salt", "digest", "content").agg(
        F.max_by("doc", "rank").alias("keep"), F.max("rank").alias("rank"), F.count("*").alias("copies")
    )
    return merged.repartition("digest").groupBy("digest", "content").agg(
        F.max_by("keep", "rank").alias("keep"), F.max("rank").alias("rank"), F.sum("copies").alias("copies")
    )


def _decisions(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """By digest: keep, copies; and, for digests that stand for several contents, the same by digest and content."""
    found = content_groups(docs, id_col, text_col, salts, digest)
    by_digest = cut(
        found.groupBy("digest").agg(F.count("*").alias("contents"), F.max_by("keep", "rank").alias("keep"), F.sum("copies").alias("copies"))
    )
    plain = by_digest.filter("contents = 1").drop("contents")
    shared = by_digest.filter("contents > 1").select("digest")
    if shared.isEmpty():
        return plain, None
    return plain, found.join(shared, "digest", "left_semi").select("digest", "content", "keep", "copies")


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    plain, shared = _decisions(docs, id_col, text_col, salts, digest)
    rows = _contents(docs, id_col, text_col, digest)
    joined = rows.drop("content", "chars").join(plain, "digest", "left")  # left: no check for nulls makes the digest twice
    if shared is not None:
        joined = joined.filter("copies IS NOT NULL").unionByName(rows.join(shared, ["digest", "content"]).drop("content", "chars"))
    return joined.select(
        F.col("doc").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.col("doc").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """The rows of ``docs`` that stay, one for each content, with all their columns.

    What stays is decided by digests and ids alone. Whole rows are dealt out once, by digest and id, and pass a hash table of
    the decisions; they are neither sorted nor merged, and a hot digest's rows lie apart, as their ids differ. Only rows that
    repeat an id and a digest (null ids among them) are held against each other, and only if there are any.
    """
    plain, shared = _decisions(docs, id_col, text_col, salts, digest)
    names = docs.columns
    d, c, i, k = (unused(names, x) for x in ("digest", "content", "doc", "keep"))
    content = squeezed(F.col(text_col))
    again = cut(_contents(docs, id_col, text_col, digest).groupBy("digest", "doc").count().filter("count > 1").select("digest", "doc"))
    repeated = not again.isEmpty()

    def stay(rows: DataFrame, decided: DataFrame, *by: str) -> DataFrame:
        decided = decided.withColumnsRenamed({"digest": d, "content": c, "keep": k})
        same = [F.col(f"l.{x}") == F.col(f"r.{x}") for x in by] + [F.col(f"l.{i}").eqNullSafe(F.col(f"r.{k}"))]
        kept = rows.alias("l").join(decided.select(*by, k).hint("shuffle_hash").alias("r"), same, "left_semi")
        if repeated:
            twice = again.withColumnsRenamed({"digest": d, "doc": i}).alias("r")
            pair = (F.col(f"l.{d}") == F.col(f"r.{d}")) & F.col(f"l.{i}").eqNullSafe(F.col(f"r.{i}"))
            some = kept.alias("l").join(twice, pair, "left_semi").dropDuplicates([*by, i])
            kept = kept.alias("l").join(twice, pair, "left_anti").unionByName(some)
        return kept.select(*names)

    rows = docs.withColumn(i, F.col(id_col).cast("long"))
    out = stay(rows.withColumn(d, digest(content)), plain, d)
    if shared is not None:
        out = out.unionByName(stay(rows.withColumn(c, content).withColumn(d, digest(F.col(c))), shared, d, c))
    return out
