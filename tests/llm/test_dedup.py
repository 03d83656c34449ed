"""Exact copies and near-duplicates."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canopyflux.llm import exact_dedup as ex
from canopyflux.llm import simhash as sh
from canopyflux.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import SF, spark_rows, sql_rows

SCHEMA = "doc_id long, text string, kept string, digest int, FP string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


ROWS = [
    (1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \r\n"), (7, "a\u00a0b"), (8, "long " * 30000), (9, "long" * 30000),
    (10, "ab"), (10, "ab"), (None, "only null id"), (None, "ab"), (11, "é"), (12, "e\u0301"),
]


def brute(rows):
    out = []
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}), []).append((i, t or ""))
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(content.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [ex.sha256, lambda c: F.substring(ex.sha256(c), 1, 1), lambda c: F.lit("same")])
@pytest.mark.parametrize("salts", [1, 5])
def test_copies_equal_brute_force(spark, digest, salts):
    df = docs(spark, ROWS).repartition(3)
    got = [tuple(r) for r in ex.exact_copies(df, salts=salts, digest=digest).collect()]
    want = brute(ROWS)
    assert sorted(str(r[:4]) for r in got) == sorted(str(r[:4]) for r in want)
    if digest is ex.sha256:
        assert sorted(got, key=str) == want


def test_digests_that_collide_are_held_apart_by_content(spark):
    rows = [(i, f"text {i % 7}") for i in range(50)]
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in ex.exact_copies(docs(spark, rows), digest=lambda c: F.lit("same")).collect())
    assert got == [(i, i % 7, len(range(i % 7, 50, 7))) for i in range(50)]


def test_one_row_of_each_content_stays(spark):
    df = docs(spark, ROWS)
    for digest in (ex.sha256, lambda c: F.lit("same")):
        kept = ex.drop_exact_copies(df, digest=digest)
        assert kept.columns == df.columns
        ids = [r.doc_id for r in kept.collect()]
        assert set(ids) == {k for _, k, *_ in brute(ROWS)} and len(ids) == len({r[4] for r in brute(ROWS)})


def test_empty(spark):
    assert ex.exact_copies(docs(spark, [])).count() == 0 and ex.drop_exact_copies(docs(spark, [])).count() == 0
    assert sh.near_duplicates(docs(spark, [])).count() == 0 and sh.drop_near_duplicates(docs(spark, [])).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"own text {i}") for i in range(3000)]
    got = ex.exact_copies(docs(spark, rows).repartition(8)).groupBy("keep_id").agg(F.count("*").alias("n"), F.max("group_size").alias("g")).filter("n > 1").collect()
    assert [(r.keep_id, r.n, r.g) for r in got] == [(0, 1000, 1000)]


def test_native_plan(spark):
    plan = ex.exact_copies(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(spark):
    assert spark_rows(QUERIES["op2_exact_dedup"](spark, SF)) == sql_rows(ORACLE_SQL["op2_exact_dedup"])


# --- SimHash -----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows():
    r = random.Random(4)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    rows = [(100 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(60)]
    base = [r.choice(words) for _ in range(400)]
    for i in range(120):  # a large group of near copies
        own = base[:]
        for _ in range(r.randint(0, 3)):
            own[r.randrange(400)] = r.choice(words)
        rows.append((1000 + i, " ".join(own).title() if i % 2 else "\n".join(own)))
    return rows + [(5, None), (6, ""), (7, "One"), (8, "one"), (9, "one two"), (10, "x " * 50000), (None, "one two")]


def brute_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [(i, f"{f:016x}", least.get(x)) for (i, _), f, x in zip(rows, fps, label, strict=True)]


@pytest.mark.parametrize(("block", "sampled"), [(4096, 16), (8, 1)])
def test_classes_equal_brute_force(spark, block, sampled):
    rows = near_rows()
    got = sorted((tuple(r) for r in sh.near_duplicates(docs(spark, rows).repartition(3), block=block, sampled=sampled).collect()), key=str)
    assert got == sorted(brute_classes(rows), key=str)


def test_one_row_of_each_class_stays(spark):
    rows = near_rows()
    df = docs(spark, rows + [rows[0]])
    kept = sh.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, _, c in brute_classes(rows) if i is not None}) and ids.count(None) == 1


def test_pigeonring_keys_find_every_link():
    r = np.random.default_rng(0)
    for _ in range(3000):
        a = np.uint64(r.integers(0, 2**63))
        b = a
        for bit in r.choice(64, r.integers(0, 4), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        found = False
        for start in range(8):
            turn = lambda v: (v >> np.uint64(8 * start)) | (v << np.uint64(64 - 8 * start)) if start else v  # noqa: B023, E731
            x, y = turn(a), turn(b)
            key = lambda v, half: (int(v) & 0xFFFF, int(v) >> (16 + 12 * half) & 0xFFF)
            if any(key(x, h) == key(y, h) for h in (0, 1)) and len(sh.linked(x, np.array([y]))):
                found = True
        assert found


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op6_simhash_near_dedup"](spark, SF).collect())
    assert got == sorted(brute_classes(rows))
