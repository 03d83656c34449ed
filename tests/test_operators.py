"""Operators on hand-made rows, and on empty tables and nulls."""

import collections
import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyflux.functions import columns as C
from canopyflux.operators import detect, graph, raster, refdb, segments, series, spatial, validation
from canopyflux.operators.components import components, neighbourhoods

D = dt.date


def test_detect_changes_rows(spark):
    days = np.arange(736000, 736000 + 4 * 365, 5)
    w = 2 * np.pi / 365.2425
    r = np.random.default_rng(2)
    after = days >= 736730
    nir, red = 3000 - 1500 * after + r.normal(0, 40, len(days)), 800 + 20 * np.cos(w * days) + r.normal(0, 10, len(days))
    rows = [(1, int(d), float(600 + 300 * a + e), float(b), float(c), float(1500 + 900 * a + 2 * e)) for d, a, b, c, e in zip(days, after, red, nir, r.normal(0, 20, len(days)), strict=True)]
    rows += [(2, 736000, 1.0, 1.0, 1.0, 1.0), (3, 736000, 65535.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, date long, green double, red double, nir double, swir2 double")
    out = {(r.k, r.tStart): r for r in detect.detect_changes(df, ["k"]).collect()}
    first = out[1, (736000 - 719163) * 86400000]
    assert first.changeProb == 100 and first.tBreak == (736730 - 719163) * 86400000 and first.error is None
    assert first.greenStart == rows[0][2] and first.greenStart2 == rows[1][2]
    assert out[2, None].tBreak is None  # a location without a model is one row of nulls
    assert {k for k, _ in out} == {1, 2, 3} and out[3, None].tBreak is None  # so is one whose observations are all nodata
    nested = detect.detection_struct(df, ["k"]).filter("k = 1").first()
    assert nested.change_models[0].break_day == 736730 and len(nested.processing_mask) == len(days)


def test_a_failing_series_is_a_row_with_its_error(spark):
    def broken(*_):
        raise ValueError("no")

    rows = [(1, int(d), 1.0 + d % 3, 2.0, 5.0, 4.0 + d % 2) for d in range(736000, 737000, 5)]
    df = spark.createDataFrame(rows, "k long, date long, green double, red double, nir double, swir2 double")
    out = detect.detect_changes(df, ["k"], fitter=broken).collect()
    assert len(out) == 1 and out[0].error == "ValueError: no" and out[0].tBreak is None


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, date long, green double, red double, nir double, swir2 double")
    assert detect.detect_changes(empty, ["k"]).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    seg = spark.createDataFrame([], "x_coord long, y_coord long, tStart long, tBreak long, tEnd long, changeProb double")
    assert validation.filter_period(seg).count() == 0 and raster.break_grid(seg).count() == 0
    assert segments.select_break(seg, 0, 1).count() == 0


def test_second_latest_break(spark):
    rows = [(1, 1, 10, 100), (1, 1, 20, 300), (1, 1, 30, 300), (2, 2, 5, 50), (3, 3, 1, 9999)]
    df = spark.createDataFrame(rows, "x_coord long, y_coord long, tStart long, tBreak long")
    got = {(r.x_coord, r.tStart) for r in segments.select_break(df, 0, 1000).collect()}
    assert got == {(1, 30), (2, 5)}


def test_explode_keeps_empty_lists(spark):
    df = spark.createDataFrame([(1, [1, 2], [3, 4]), (2, [], [])], "k long, a array<long>, b array<long>")
    assert sorted(map(tuple, segments.explode_lists(df, ["a", "b"]).collect()), key=str) == [(1, 1, 3), (1, 2, 4), (2, None, None)]
    assert spark.range(1).select(segments.parse_number_list(F.lit("[1, 2.5]"))).first()[0] == [1.0, 2.5]


def test_points_on_borders_belong_to_one_of_two_neighbours(spark):
    squares = [(i, [(10.0 * i, 0.0), (10.0 * i + 10, 0.0), (10.0 * i + 10, 10.0), (10.0 * i, 10.0)]) for i in range(3)]
    polys = spark.createDataFrame(squares, "p long, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(j, j * 2.5, 5.0) for j in range(13)], "id long, x double, y double")
    got = sorted((r.id, r.p) for r in spatial.points_in_polygons(pts, polys, "x", "y", cell=7).collect())
    assert got == [(j, j * 25 // 100) for j in range(12)]
    area = polys.select(spatial.ring_area(F.col("ring"))).first()[0]
    assert area == 100.0


def test_neighbours_equal_brute_force(spark):
    r = np.random.default_rng(5)
    xy = np.round(r.uniform(-50, 50, (150, 2)), 1)
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")
    got = {(x.a, x.b) for x in spatial.neighbour_pairs(pts, 12).collect()}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if ((xy[i] - xy[j]) ** 2).sum() <= 144}
    assert got == want


def test_components_equal_brute_force(spark):
    r = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(60)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if find(v) != v}


def test_event_components_equal_brute_force(spark):
    from canopyflux.plans.catalog import QUERIES
    from tests.helpers import SF

    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for r in QUERIES["event_edges"](spark, SF).collect():
        a, b = find(r.src), find(r.dst)
        parent[max(a, b)] = min(a, b)
    want = {}
    for v in list(parent):
        want[find(v)] = want.get(find(v), 0) + 1
    assert want and {r.root: r.events for r in QUERIES["event_components"](spark, SF).collect()} == want


def test_event_components_are_joined_without_a_broadcast(spark):
    """Nor do rounds broadcast what a task has counted as small; what they write goes with them."""
    from canopyflux.operators.components import shared_dir
    from canopyflux.plans.catalog import QUERIES
    from tests.helpers import SF

    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    runs = lambda: bus.waitUntilEmpty() or {x.executionId(): x.physicalPlanDescription() for x in map(store.executionsList().apply, range(store.executionsList().size()))}
    before = runs()
    assert QUERIES["event_components"](spark, SF).count() == 1
    plans = [plan for k, plan in runs().items() if k not in before]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert not list(Path(shared_dir(spark).removeprefix("file://")).glob("components-*"))


def test_components_of_a_long_path_and_of_a_hub(spark):
    path, hub = [(f"p{i:04}", f"p{i + 1:04}") for i in range(300)], [("z", f"h{i:04}") for i in range(300)]
    got = {x.node: x.root for x in components(spark.createDataFrame(path + hub + hub + [("h0001", "z"), ("x", "x"), (None, "y")], "a string, b string")).collect()}
    assert got == {b: "p0000" for _, b in path} | {b: "h0000" for _, b in hub[1:]} | {"z": "h0000"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["event_edges", "event_components", "louvain_communities", "community_figures", "community_hulls"])
def test_event_tables_are_not_broadcast(spark, monkeypatch, query):
    """Files a tenth of their rows' size look small enough to broadcast; the driver's memory doesn't hold the rows."""
    from canopyflux.plans import catalog
    from tests.helpers import SF

    plans = []
    put = lambda edges: plans.append(_plan(edges)) or spark.createDataFrame([(1, 1)], "id long, community_id long")
    monkeypatch.setattr(graph, "communities", put)
    monkeypatch.setattr(catalog, "components", lambda edges: put(edges).toDF("node", "root"))
    plans.append(_plan(catalog.QUERIES[query](spark, SF)))
    assert len(plans) == 1 + (query != "event_edges")
    joined = [p for p in plans if "Join" in p]
    assert len(joined) == (2 if query.startswith("community") else 1) and "Broadcast" not in "".join(plans)


def test_communities_are_a_partition_of_good_modularity(spark):
    groups = [range(0, 12), range(12, 24), range(24, 36)]
    edges = [(i, j) for g in groups for i in g for j in g if i < j] + [(0, 12), (12, 24)]
    got = {x.id: x.community_id for x in graph.communities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert [len({got[i] for i in g}) for g in groups] == [1, 1, 1] and len(set(got.values())) == 3
    assert set(got) == set(range(36)) and all(got[i] <= i for i in got)


def test_communities_use_one_method_at_every_size(spark):
    r = np.random.default_rng(3)
    block = r.integers(0, 4, 60)
    edges = [(i, j) for i in range(60) for j in range(i) if r.random() < (0.4 if block[i] == block[j] else 0.06)]
    df = spark.createDataFrame(edges, "src long, dst long").coalesce(1)
    got = {x.id: x.community_id for x in graph.communities(df).collect()}
    assert {x.id: x.community_id for x in graph.communities(df).collect()} == got and len(set(got.values())) > 2


def test_large_components_move_in_parts_before_blocks(spark, monkeypatch):
    """Forty groups in a row: what a part holds whole needs no round of moves between blocks, of which each reads all edges."""
    edges = [(4 * k + i, 4 * k + j) for k in range(40) for i in range(4) for j in range(i + 1, 4)] + [(4 * k, 4 * k + 5) for k in range(39)]
    rounds, mover = [], graph._mover
    monkeypatch.setattr(graph, "_mover", lambda seed: rounds.append(seed) or mover(seed))
    found = graph.communities(spark.createDataFrame(edges, "src long, dst long"), block_edges=100)
    got = {x.id: x.community_id for x in found.collect()}
    assert set(got) == set(range(160)) and all(got[4 * k + i] == got[4 * k] for k in range(40) for i in range(4))
    assert sum(level == 0 for _, level, _ in rounds) <= 2


def test_parts_hold_no_more_than_they_may(spark):
    """Parts of a grid, by rounds and by the one task that ends them, are no larger than said, and not much smaller."""
    edges = [(100 * x + y, 100 * x + y + d) for x in range(30) for y in range(5) for d in (1, 100)]
    found = neighbourhoods(spark.createDataFrame(edges, "a long, b long"), 60).collect()
    ends, parts = collections.Counter(v for e in edges for v in e), collections.defaultdict(set)
    for r in found:
        parts[r.part].add(r.v)
    assert {r.v for r in found} == set(ends) and {r.root for r in found} == {0}
    assert max(sum(map(ends.get, p)) for p in parts.values()) <= 60 and 600 / 60 <= len(parts) < len(ends) / 3


def test_components_beyond_a_task_move_in_blocks(spark):
    """Two components, with repeated edges and a loop; blocks of a few edges end where no vertex gains, as one task does."""
    r = np.random.default_rng(5)
    block = r.integers(0, 4, 48)
    edges = [(i, j) for i in range(48) for j in range(i) if r.random() < (0.5 if block[i] == block[j] else 0.05)]
    edges += edges[:9] + [(7, 7)] + [(100, 101), (101, 102)]

    def modularity(got):
        edges_, inner, mass = edges[:-2], 0, {}
        for i, j in edges_:
            inner += got[i] == got[j]
            for v in (i, j):
                mass[got[v]] = mass.get(got[v], 0) + 1
        return inner / len(edges_) - sum((m / (2 * len(edges_))) ** 2 for m in mass.values())

    df = spark.createDataFrame(edges, "src long, dst long")
    one, many = ({x.id: x.community_id for x in graph.communities(df, block_edges=n).collect()} for n in (1000, 25))
    assert set(one) == set(many) == {v for e in edges for v in e} and many[100] == many[101] == many[102] == 100
    assert all(min(v for v in many if many[v] == c) == c for c in many.values())
    assert modularity(many) > 0.95 * modularity(one) > 0.3
    weights = {}
    for i, j in edges[:-2]:
        weights[min(i, j), max(i, j)] = weights.get((min(i, j), max(i, j)), 0.0) + 1
    moved = graph.settled(spark.createDataFrame([(0, a, b, w) for (a, b), w in weights.items()], "root long, a long, b long, w double"), 123, 0, 25)
    moved = {x.v: x.c for x in moved.collect()}
    best = modularity(moved)
    assert all(modularity(moved | {v: c}) <= best + 1e-9 for v in moved for c in set(moved.values()))


def test_sorted_row_pairs_hold_the_ties(spark):
    from canopyflux.plans.catalog import ORACLE_SQL, QUERIES
    from tests.helpers import SF, spark_rows, sql_rows

    df = QUERIES["sort_row_pairs"](spark, SF)
    assert df.filter("d0 = d1").count() > 0 and df.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert spark_rows(df) == sql_rows(ORACLE_SQL["sort_row_pairs"])


def test_hull_holds_its_points():
    r = np.random.default_rng(1)
    pts = r.uniform(0, 100, (200, 2))
    ring = graph.concave_hull(pts)
    x, y = ring.T
    area = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2
    assert 0.4 * 10_000 < area < 10_000


def test_confusion_rules(spark):
    schema = "c long, tStart date, tBreak date, data_1 date, data_3 date"
    rows = [
        (1, D(2019, 1, 1), D(2019, 6, 1), D(2019, 6, 20), None),  # near: true positive
        (2, D(2019, 1, 1), D(2019, 6, 1), D(2020, 6, 20), None),  # far: false positive and false negative
        (3, D(2019, 1, 1), None, D(2020, 6, 20), None),  # nothing found: false negative
        (4, D(2019, 1, 1), None, None, None),  # nothing to find: true negative
        (5, D(2019, 1, 1), D(2019, 6, 1), None, None),  # nobody saw it: false positive
        (6, D(2019, 1, 1), D(2019, 6, 1), D(2019, 6, 2), D(2019, 6, 3)),  # both analysts agree: two true positives
    ]
    scored = validation.score(validation.with_analysts(spark.createDataFrame(rows, schema), ["c"]), keys=["c"])
    got = {(r.c, r.nome): (r.VP, r.FP, r.FN, r.VN) for r in scored.collect()}
    assert got == {
        (1, "A"): (1, 0, 0, 0), (2, "A"): (0, 1, 1, 0), (3, "A"): (0, 0, 1, 0), (4, "A"): (0, 0, 0, 1), (5, "A"): (0, 1, 0, 0), (6, "A"): (1, 0, 0, 0), (6, "B"): (1, 0, 0, 0),
    }
    total = validation.accuracy(scored).first()
    assert (total.VP, total.FP, total.FN, total.VN) == (3, 2, 2, 1) and abs(total.f1 - 0.6) < 1e-12
    assert validation.accuracy(scored.filter("false")).first().f1 is None


def test_reference_join_makes_a_row_for_each_analyst(spark):
    seg = spark.createDataFrame([(5.0, 5.0, D(2019, 1, 1), D(2019, 6, 1)), (50.0, 50.0, D(2019, 1, 1), None)], "x_coord double, y_coord double, tStart date, tBreak date")
    poly = spark.createDataFrame([(1, [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)], 20190610, 20190701)], "p long, ring array<struct<x:double,y:double>>, data_1 int, data_3 int")
    got = {(r.x_coord, r.nome): (r.bordadura, r.delta_min, r.Valid_breaks) for r in validation.join_reference(seg, poly).collect()}
    assert got == {(5.0, "A"): (1, 9, 1), (5.0, "B"): (1, 30, 1), (50.0, "A"): (0, None, 0), (50.0, "B"): (0, None, 0)}


def test_sessions_from_start(spark):
    rows = [("a", D(2000, 1, 1)), ("a", D(2001, 6, 1)), ("a", D(2002, 6, 1)), ("a", D(2003, 1, 1)), ("b", None)]
    df = spark.createDataFrame(rows, "k string, d date")
    assert sorted(map(tuple, refdb.cut_sessions_from_start(df, "k", "d").collect())) == [("a", 0, D(2000, 1, 1), D(2001, 6, 1), 2), ("a", 1, D(2002, 6, 1), D(2003, 1, 1), 2)]
    assert sorted(map(tuple, refdb.cut_sessions(df, "k", "d").collect())) == [("a", 0, D(2000, 1, 1), D(2003, 1, 1), 4)]


def test_scalar_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(C.ndvi(F.lit(0), F.lit(0))) is None and get(C.ndvi(F.lit(3), F.lit(1))) == 5000
    assert get(C.parse_date_tolerant(F.lit("20190230"))) is None and get(C.parse_date_tolerant(F.lit("20190228"))) == D(2019, 2, 28)
    assert get(C.parse_day_first(F.lit("28022019"))) == "2019-02-28"
    assert get(C.midpoint_date(F.lit(D(2020, 1, 10)), F.lit(D(2020, 1, 7)))) == D(2020, 1, 8)
    assert get(C.yyyymmdd_to_date(F.lit(0))) is None
    assert get(C.binned(F.lit(0.5))) == 0 and get(C.binned(F.lit(41.0))) == 6 and get(C.binned(F.lit(None).cast("double"))) is None
    assert get(C.position_in_year(F.lit(D(2020, 12, 31)))) == 1.0
    assert get(C.ms_to_yyyymmdd(F.lit(-1))) == 19691231
    row, col = C.raster_index(F.lit(20), F.lit(80), F.lit(0), F.lit(100))
    assert (get(row), get(col)) == (2, 2)


def test_as_of_is_strictly_before(spark):
    ev = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "k long, at long")
    dates = spark.createDataFrame([(1, 3), (1, 4), (1, 5)], "k long, date long")
    assert sorted(map(tuple, series.closest_earlier(ev, dates, ["k"], "at", "date").collect()), key=str) == [(1, 3, None), (1, 5, 4), (2, 9, None)]


def test_clipping_and_projecting_rings(spark):
    from canopyflux.functions.geodesy import tm_forward, tm_inverse

    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))))
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(spatial.ring_area(spatial.clip_ring(ring, 5, 5, 50, 50))) == 25
    assert get(spatial.ring_area(spatial.clip_ring(ring, -5, -5, 50, 50))) == 100
    assert get(F.size(spatial.clip_ring(ring, 20, 20, 30, 30))) == 0
    lonlat = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-8.5, 40.0), (-8.4, 40.0), (-8.4, 40.1))))
    back = spatial.reproject_ring(spatial.reproject_ring(lonlat, tm_forward), tm_inverse)
    assert all(abs(p.x - x) < 1e-9 and abs(p.y - y) < 1e-9 for p, (x, y) in zip(get(back), ((-8.5, 40.0), (-8.4, 40.0), (-8.4, 40.1)), strict=True))
    assert get(spatial.parse_ring(F.lit("POINT (1 2)"))) is None


def test_a_date_that_only_repeats_is_no_session(spark):
    df = spark.createDataFrame([("a", D(2000, 1, 1))] * 3 + [("b", D(2000, 1, 1))] * 2, "k string, d date")
    assert [r.k for r in refdb.cut_sessions(df, "k", "d", repeats=False).collect()] == ["b"]


# --- detection over tables ---------------------------------------------------------------------------------------------


def _observations(days, green):
    """Locations 1 (valid), 2 (nothing but nodata) and 3 (too short)."""
    import datetime

    start = datetime.date(2016, 1, 1)
    rows = [(1, start + datetime.timedelta(int(d)), int(g), 600, 3000, 1500) for d, g in zip(days, green, strict=True)]
    rows += [(2, start + datetime.timedelta(int(d)), 65535, 65535, 65535, 65535) for d in days[:5]]
    return rows + [(3, start, 10, 600, 3000, 1500)]


OBS = "k long, date date, green long, red long, nir long, swir2 long"


def test_locations_without_valid_observations_are_rows_of_nulls(spark):
    days = np.arange(0, 1000, 5)
    df = spark.createDataFrame(_observations(days, 500 + 40 * np.sin(days)), OBS)
    found = detect.detect_changes(df, ["k"]).collect()
    assert {r.k for r in found} == {1, 2, 3}
    assert all(r.tStart is None and r.error is None for r in found if r.k != 1) and all(r.tStart is not None for r in found if r.k == 1)
    nested = {r.k: r for r in detect.detection_struct(df, ["k"]).collect()}
    assert nested[2].processing_mask == [] and nested[2].change_models == [] and nested[2].error is None and len(nested[1].processing_mask) == len(days)
    assert {r.k for r in detect.cloud_outlier_mask(df, ["k"]).collect()} == {1, 3}
    assert detect.detect_changes(df.limit(0), ["k"]).count() == 0


def test_one_bad_series_does_not_end_the_job(spark):
    days = np.arange(0, 1000, 5)
    df = spark.createDataFrame(_observations(days, 500 + 40 * np.sin(days)), OBS)

    def broken(*args):
        raise ValueError("no fit")

    found = {r.k: r for r in detect.detect_changes(df, ["k"], fitter=broken).collect()}
    assert found[1].error == "ValueError: no fit" and found[1].tStart is None and found[3].error is None
    nested = {r.k: r for r in detect.detection_struct(df, ["k"], fitter=broken).collect()}
    assert nested[1].error == "ValueError: no fit" and nested[1].change_models is None and nested[1].algorithm == "ccd" and nested[2].error is None


def test_variogram_lags_have_no_limit(spark):
    from canopyflux.operators import kernel, series

    r = np.random.default_rng(5)
    rows = [(1, d, float(r.integers(0, 9)), 1.0) for d in range(60)]  # daily: only lags over 30 days count
    rows += [(2, 40 * d, float(d % 3), None) for d in range(9)] + [(3, 7, 1.0, 2.0)] + [(4, d, float(d), 1.0) for d in range(3)]
    got = {x.k: x for x in series.adjusted_variogram(spark.createDataFrame(rows, "k long, day long, a double, b double"), ["k"], ["a", "b"]).collect()}
    mine = np.array([x[2] for x in rows if x[0] == 1])
    assert got[1].lag == 31 and got[1].a_variogram == kernel.adjusted_variogram(np.arange(60), mine[None])[0]
    assert got[2].lag == 1 and got[2].b_variogram is None and 3 not in got
    assert got[4].lag is None and got[4].a_variogram == 1.0


# --- polygons ----------------------------------------------------------------------------------------------------------


def test_polygons_in_polygons(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square = lambda x, y, s: ring((x, y), (x + s, y), (x + s, y + s), (x, y + s))
    left = spark.createDataFrame(
        [(1, square(1, 1, 2)), (2, square(8, 8, 4)), (3, square(50, 50, 1)), (4, square(-5, 4, 30)), (5, square(0, 0, 10)), (6, ring((4, -5), (6, -5), (6, 15), (4, 15)))],
        "id long, ring array<struct<x:double,y:double>>",
    )
    right = spark.createDataFrame([("a", square(0, 0, 10)), ("b", square(10, 0, 3))], "name string, other array<struct<x:double,y:double>>")
    for cell in (1.0, 7.0, 1000.0):
        join = lambda **how: sorted((r.id, r.name) for r in spatial.polygons_in_polygons(left, right, cell=cell, **how).collect())  # noqa: B023, E731
        assert join() == [(1, "a")]  # 5 shares its border, 2 and 6 cross it
        assert join(predicate="intersects") == [(1, "a"), (2, "a"), (4, "a"), (5, "a"), (5, "b"), (6, "a")]
        kept = {(r.id, r.name) for r in spatial.polygons_in_polygons(left, right, cell=cell, how="left").collect()}
        assert kept == {(1, "a"), (2, None), (3, None), (4, None), (5, None), (6, None)}


def test_fitter_by_name():
    from canopyflux.operators import kernel
    from canopyflux.params import named

    assert named("canopyflux.operators.kernel.fit_lasso") is kernel.fit_lasso
    with pytest.raises(AttributeError):
        named("canopyflux.operators.kernel.nothing")


def test_parts_of_texts(spark):
    texts = ["MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1)), ((9 9, 10 9, 10 10, 9 9)))", "POLYGON ((0 0, 4 0, 4 4, 0 0))", "POINT (1 2)", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", spatial.parse_parts(F.col("t")).alias("p"))
    got = {r.i: [[(p.x, p.y) for p in ring] for ring in r.p] for r in df.collect()}
    first = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]
    assert got == {0: [first, [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]], 1: [first], 2: [], 3: []}
    at = df.select("i", spatial.inside_any(F.lit(9.8), F.lit(9.5), F.col("p")).alias("a"), spatial.inside_any(F.lit(3.0), F.lit(1.0), F.col("p")).alias("b"))
    assert {r.i: (r.a, r.b) for r in at.collect()} == {0: (True, True), 1: (False, True), 2: (False, False), 3: (False, False)}


def test_rows_are_numbered_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("nth_x")).repartition(13)
    assert all(r.number == r.v + 1 for r in refdb.numbered_rows(df, ["v"]).collect())
    assert refdb.numbered_rows(df.limit(0), ["v"]).count() == 0
    assert sorted(r.v for r in refdb.first_part_of(df, ["v"], 0.25).collect()) == list(range(250))


def test_lists_in_texts(spark):
    df = spark.createDataFrame([("['a', 'b']",), ("a,b ",), ("[]",), (None,)], "t string").select(refdb.text_list(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == [["a", "b"], ["a", "b"], [], []]
