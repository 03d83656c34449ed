"""Every registered time-series query, against its SQL where it has one."""

import collections
import math
import re
import shutil
import statistics
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from canopyflux.operators import kernel
from canopyflux.params import CcdParams
from canopyflux.plans import catalog, fixtures
from tests.helpers import SF, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == sql_rows(catalog.ORACLE_SQL[name])


def test_every_query_has_sql_or_a_test_of_its_own():
    """The others are held here or, for components, in test_operators."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {
        "ccd_last_break", "ccd_segments", "ccd_detection_struct", "tmask_outliers", "tm_round_trip", "event_components", "louvain_communities", "community_figures", "community_hulls",
    }


BANDS = ("green", "red", "nir", "swir2")


@pytest.fixture(scope="module")
def plain_series():
    """Each location's observations as DuckDB has them: days (ordinal) and bands in order, with the index."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{SF}/lineitem.parquet'")
    rows = con.sql(f"WITH {fixtures.OBSERVATIONS} SELECT l_suppkey, date_diff('day', DATE '1970-01-01', date) + 719163 AS day, {', '.join(BANDS)} FROM obs WHERE nir + red > 0 ORDER BY ALL").fetchall()
    out = {}
    for k, *values in rows:
        out.setdefault(k, []).append(values)
    series = {}
    for k, values in out.items():
        day, green, red, nir, swir2 = np.array(values, float).T
        series[k] = {"day": day.astype(int), "green": green, "red": red, "nir": nir, "swir2": swir2, "ndvi": 10000 * (nir - red) / (nir + red)}
    return series


def test_detection_queries_equal_the_kernel_on_each_series(spark, plain_series):
    want, marks = [], {}
    for k, s in plain_series.items():
        found, mask = kernel.detect(s["day"], s["ndvi"], s["green"], s["swir2"])
        marks[k] = mask.tolist()
        for x in found:
            first, last = s["day"].tolist().index(x.start_day), s["day"].tolist().index(x.end_day)
            value = lambda b, i: float(s[b][i]) if 0 <= i < len(s[b]) else None  # noqa: B023, E731
            ends = [value(b, i) for b in ("green", "red", "nir", "swir2") for i in (first, first + 1, last, last - 1)]
            want.append((k, *((d - 719163) * 86_400_000 for d in (x.start_day, x.end_day, x.break_day)), int(100 * x.change_probability), *ends))
    rows = catalog.QUERIES["ccd_segments"](spark, SF).collect()
    got = [(r.l_suppkey, r.tStart, r.tEnd, r.tBreak, r.changeProb, *(r[f"{b}{c}"] for b in ("green", "red", "nir", "swir2") for c in ("Start", "Start2", "End", "End2"))) for r in rows if r.tStart is not None]
    assert sorted(got) == sorted(want) and {r.l_suppkey for r in rows} == set(plain_series) and all(r.error is None for r in rows)
    nested = catalog.QUERIES["ccd_detection_struct"](spark, SF).collect()
    assert {r.l_suppkey: r.processing_mask for r in nested} == {k: [int(x) for x in v] for k, v in marks.items()}
    days = lambda ms: ms // 86_400_000 + 719163
    assert sorted((r.l_suppkey, m.start_day, m.end_day, m.break_day) for r in nested for m in r.change_models) == sorted((k, days(a), days(b), days(c)) for k, a, b, c, *_ in want)
    last = {}
    for k, a, _, c, prob, *_ in want:
        last.setdefault(k, []).append((a, c, prob))
    got = {r.l_suppkey: (r.tBreak, r.n_segments, r.n_breaks) for r in catalog.QUERIES["ccd_last_break"](spark, SF).collect()}
    assert got == {k: (max((c for _, c, p in v if p == 100), default=None), len(v), len(v) - 1) for k, v in last.items()}


def slow_robust(x, y, rounds=5):
    """Iteratively reweighted least squares, one weighted least-squares problem at a time."""
    now = np.linalg.lstsq(x, y, rcond=None)[0]
    q = np.linalg.qr(x)[0]
    lever = 1 / np.sqrt(1 - np.minimum((q**2).sum(1), 0.9999))
    for _ in range(rounds):
        r = (y - x @ now) * lever
        scale = max(np.finfo(float).eps * y.std(), np.median(np.sort(np.abs(r))[4:]) / 0.6745)
        u = r / scale / 4.685
        w = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0)
        before, now = now, np.linalg.lstsq(x * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if not (before - now > 1e-8).any():
            break
    return now


def test_outliers_equal_a_plain_robust_fit(spark, plain_series):
    got = {}
    for r in catalog.QUERIES["tmask_outliers"](spark, SF).orderBy("l_suppkey", "day").collect():
        got.setdefault(r.l_suppkey, []).append((r.day, r.outlier))
    p = CcdParams()
    for k, s in plain_series.items():
        days, names = s["day"], ("ndvi", "green", "swir2")
        lag = next((n for n in range(1, len(days)) if statistics.multimode(sorted((days[n:] - days[:-n]).tolist()))[0] > 30), None)
        w = 2 * np.pi / p.avg_days_yr
        years = math.ceil((days[-1] - days[0]) / p.avg_days_yr)
        x = np.column_stack([f(a * days) for a in ((w, w / years) if years > 1 else (w,)) for f in (np.cos, np.sin)] + [np.ones(len(days))])
        out = np.zeros(len(days), bool)
        for b in p.tmask_bands:
            y = s[names[b]]
            steps = np.abs(y[lag:] - y[:-lag])[days[lag:] - days[:-lag] > 30] if lag else np.abs(np.diff(y))
            out |= np.abs(x @ slow_robust(x, y) - y) > p.t_const * np.median(steps)
        assert sorted(got[k]) == sorted(zip(days.tolist(), out.tolist(), strict=True)), k


def test_community_queries_hang_together(spark):
    from canopyflux.operators import graph

    members = {r.id: r.community_id for r in catalog.QUERIES["louvain_communities"](spark, SF).collect()}
    edges = [(r.src, r.dst) for r in catalog.QUERIES["event_edges"](spark, SF).collect()]
    assert set(members) == {v for e in edges for v in e}
    degree, inner = collections.Counter(v for e in edges for v in e), sum(members[a] == members[b] for a, b in edges)
    mass = collections.Counter()
    for v, d in degree.items():
        mass[members[v]] += d
    modularity = inner / len(edges) - sum((m / (2 * len(edges))) ** 2 for m in mass.values())
    assert modularity > 0.5
    # no vertex gains by moving to a neighbour's community
    near = collections.defaultdict(collections.Counter)
    for a, b in edges:
        near[a][members[b]] += 1
        near[b][members[a]] += 1
    moves = sum(any(near[v][c] - near[v][own] > degree[v] * (mass[c] - mass[own] + degree[v]) / (2 * len(edges)) + 1e-9 for c in near[v] if c != own) for v, own in members.items())
    assert moves <= 0.02 * len(members)
    events = {r.id: r for r in catalog._vertices(spark, SF).collect()}
    groups = collections.defaultdict(list)
    for v, c in members.items():
        groups[c].append(events[v])
    large = {c: g for c, g in groups.items() if len(g) >= 10}
    assert large and min(large) in large
    got = {r.community_id: r for r in catalog.QUERIES["community_figures"](spark, SF).collect()}
    assert set(got) == set(large)
    for c, g in large.items():
        days = [e.tBreak_days for e in g if e.is_break == 1]
        assert got[c].events == len(g) and (got[c].tBreak_min, got[c].tBreak_max) == ((min(days), max(days)) if days else (None, None))
        assert not days or got[c].tBreak_mean == pytest.approx(sum(days) / len(days))
    hulls = {r.community_id: r for r in catalog.QUERIES["community_hulls"](spark, SF).collect()}
    assert {c: r.events for c, r in hulls.items()} == {c: len(g) for c, g in large.items()}
    for c, g in large.items():
        corners = [tuple(map(float, x.split())) for x in re.findall(r"[-0-9.E]+ [-0-9.E]+", hulls[c].geometry)]
        points = {(float(e.x_coord), float(e.y_coord)) for e in g}
        assert set(corners) <= points and {min(points), max(points)} <= set(corners)  # corners are events, the outermost among them
    assert len(graph.concave_hull(np.array([(x, y) for x in range(4) for y in range(4)], float))) >= 4


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_point_without_the_corpus_package(tmp_path):
    """Both folders of the corpus operators may be deleted; corpus_pipeline.py, if left behind, is then left out, too."""
    top = Path(__file__).parents[1]
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (top / name).exists():
            shutil.copy(top / name, tmp_path)
    shutil.copytree(top / "canopyflux", tmp_path / "canopyflux", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "canopyflux/llm/__pycache__").mkdir(parents=True)  # compiled files may stay
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split("\n")
    assert found[0].split() == sorted(catalog.QUERIES) and found[1].split() == sorted(catalog.ORACLE_SQL)


def test_projection_is_undone(spark):
    assert all(r.same for r in catalog.QUERIES["tm_round_trip"](spark, SF).collect())


def test_projection_of_a_known_point(spark):
    from pyspark.sql import functions as F

    from canopyflux.functions.geodesy import tm_forward

    e, n = tm_forward(F.lit(-9.0), F.lit(40.0))
    row = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(row.e - 500000) < 1e-6 and abs(row.n - 4427757.2187) < 1e-3  # the central meridian; the arc to 40 degrees times 0.9996
