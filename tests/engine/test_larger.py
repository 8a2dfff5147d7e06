"""Queries against their twins, or operators against plain versions, on rows that the smallest tables don't hold."""

import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from kerbgraph.functions import columns as C
from kerbgraph.functions import texts
from kerbgraph.operators import graph, hours, linking, relational
from kerbgraph.plans import queries as plans
from kerbgraph.streaming import navigator


def against_sql(spark, tmp_path, name, **tables):
    """Rows of the query and of its twin over the given tables (SELECTs of DuckDB)."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"copy ({select}) to '{tmp_path}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    theirs = con.execute(f"select {', '.join(df.columns)} from ({plans.SQL[name]})").fetchall()
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted(theirs, key=repr)


def test_stretch_of_steps_without_a_way(spark, tmp_path):
    lines = """SELECT 1::BIGINT AS l_suppkey, i::BIGINT AS l_orderkey, (5 * i)::BIGINT AS l_partkey, CASE WHEN i < 3 THEN 6 ELSE 1 END::INT AS l_linenumber, 3.0::DOUBLE AS l_quantity,
      1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus FROM range(1, 5) t(i)"""
    mine, theirs = against_sql(spark, tmp_path, "path_stretches", lineitem=lines)
    assert [r[4] for r in mine] == [None, None] and mine == theirs


def test_nodes_at_mirrored_distances_are_equally_far(spark, tmp_path):
    stops = "SELECT i::BIGINT AS s_suppkey, 2::INT AS s_nationkey FROM range(1, 40) t(i)"
    junctions = "SELECT i::BIGINT AS p_partkey FROM range(1, 120000) t(i)"
    mine, theirs = against_sql(spark, tmp_path, "nearest_under_reach", supplier=stops, part=junctions)
    assert len(mine) == 3 * 39 and mine == theirs


def test_many_stops_and_nodes_at_one_place_are_one(spark, tmp_path, monkeypatch):
    """Stops of three reaches stand at 200 places, several at each, and many nodes at each of 500: what is searched is places, from a small radius on."""
    met = []
    monkeypatch.setattr(relational, "_dealt", lambda stored, asked, f=relational._dealt: met.append((stored.count(), asked.count())) or f(stored, asked))
    monkeypatch.setattr(relational, "NEAR_ROWS", 2)
    stops = "SELECT (i % 200 + 1000 * (i // 200))::BIGINT AS s_suppkey, (i // 200)::INT AS s_nationkey FROM range(0, 1200) t(i)"
    junctions = "SELECT (i % 500 + 1009 * 1013 * (i // 500))::BIGINT AS p_partkey FROM range(0, 4000) t(i)"
    mine, theirs = against_sql(spark, tmp_path, "nearest_under_reach", supplier=stops, part=junctions)
    assert mine == theirs and len(mine) > 300
    assert len(met) > 1 and all(stored <= 500 and asked <= 200 * 9 for stored, asked in met)


def test_notes_meet_edges_by_way_and_cell(spark):
    rng = random.Random(4)
    near = lambda: rng.choice([(rng.uniform(-0.004, 0.004), rng.uniform(55.0, 55.004)), (rng.choice([-179.999, 179.999]) + rng.uniform(-0.001, 0.001), rng.uniform(0, 0.004)), (rng.uniform(-180, 180), rng.uniform(89.998, 90))])
    notes = [(i, *near(), "b2" if i % 7 == 0 else "b1", [i, i + 1], [i % 2, 2]) for i in range(120)]
    edges = [(i, i % 3, [near() for _ in range(rng.randint(1, 3))]) for i in range(150)]

    def metres(a, b):
        x1, y1, x2, y2 = map(math.radians, (*a, *b))
        return 2 * C.EARTH_M * math.asin(min(1.0, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))

    expected = [(n[0], e) for n in notes if n[3] == "b2" for e in n[4]]
    expected += [(n[0], e[0]) for n in notes if n[3] != "b2" for w in n[5] for e in edges if e[1] == w and any(metres(p, n[1:3]) <= 200 for p in e[2])]
    found = linking.note_edges(spark.createDataFrame(notes, "note long, lon double, lat double, built string, edges array<long>, ways array<long>"), spark.createDataFrame(edges, "edge long, way long, line array<struct<lon:double,lat:double>>"), "b2")
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
    assert "cx" in joins(found)


def joins(df):
    """The lines of the plan that tell of joins."""
    return "\n".join(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


def test_index_of_a_search_is_not_sent_to_all(spark, tmp_path):
    part = "SELECT i::BIGINT AS p_partkey, CASE WHEN i % 9 = 0 THEN 'small box' ELSE 'red pipe ' || i END AS p_name FROM range(1, 400) t(i)"
    mine, theirs = against_sql(spark, tmp_path, "prefix_token_search", part=part)
    assert len(mine) == 44 and mine == theirs
    df = plans.QUERIES["prefix_token_search"](spark, str(tmp_path))
    assert "Broadcast" not in joins(df) and "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_common_items_are_counted_for_few_pairs(spark):
    rng = random.Random(9)
    # items below 6 are common; owners from 50 have hardly any others
    sets = {o: set(rng.sample(range(6), rng.randint(3, 6))) | {rng.randint(6, 40) for _ in range(0 if o > 49 else rng.randint(1, 5))} for o in range(70)}
    df = spark.createDataFrame([(o, i) for o, s in sets.items() for i in s], "o long, i long")
    for share in (0.3, 0.6, 0.9):
        expected = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= share * max(len(sets[a]), len(sets[b]))}
        for common in (0, 4, 12, 200):
            assert {(r["a"], r["b"]): r["shared"] for r in relational.alike_sets(df, "o", "i", share, common).collect()} == expected
    # owners without common items are counted where they meet: no join takes their whole sets again
    plan = relational.alike_sets(df, "o", "i", 0.3).groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(bs" in plan


def test_nearest_in_a_crowd(spark, monkeypatch):
    rng = random.Random(5)
    spot = [(rng.gauss(-3.0, 0.002), rng.gauss(56.0, 0.001)) for _ in range(150)]
    rows = [(i, *rng.choice(spot), rng.choice([0, 0, 0, 1, 2, None])) for i in range(500)] + [(500, -3.2, 56.0, 0), (501, None, 56.0, 1)]
    monkeypatch.setattr(relational, "NEAR_ROWS", 2)
    rank = lambda x, y, r: (2 * C.EARTH_M * math.asin(math.sqrt(math.sin(math.radians(r[2] - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(r[2])) * math.sin(math.radians(r[1] - x) / 2) ** 2)), r[0])
    df = spark.createDataFrame(rows, "a long, lon double, lat double, kind int")
    met = []
    monkeypatch.setattr(relational, "_dealt", lambda stored, asked, f=relational._dealt: met.append((stored, asked)) or f(stored, asked))
    for k in (1, 3):
        expected = set()
        for a in rows:
            if a[1] is not None and a[3] is not None:
                near = sorted(rank(a[1], a[2], b) for b in rows if b[1] is not None and b[3] is not None and b[3] != a[3])
                expected |= {(a[0], b, i + 1) for i, (d, b) in enumerate([x for x in near if x[0] <= 300][:k])}
        found = relational.nearest_join(df, df.withColumnRenamed("a", "b"), 300.0, k, unlike="kind")
        assert {(r["a"], r["b"], r["rank"]) for r in found.collect()} == expected and expected
    assert len(met) > 4  # smaller radii came before the whole one


def test_texts_are_split_once_whatever_they_say(spark):
    words = "the cat the of no x les not was is is und, der".split()
    rng = random.Random(6)
    texts_ = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 3, 10, 30, 200)] + ["thethe the a", "of the cat", "the cat is", None, "é" * 30 + " the cat"]
    pattern, before, after = r"(?i)the\s*\w?", r"(?i)(of|no)[\s\w]{0,9}$", r"(?i)^[\s\w]{0,2}(is|was)"

    def plain(t):
        t = t or ""
        return any(not re.search(before, t[max(m.start() - 24, 0) : m.start()]) and not re.search(after, t[m.end() : m.end() + 24]) for m in re.finditer(pattern, t))

    df = spark.createDataFrame(list(enumerate(texts_)), "i int, t string").select("i", texts.says(F.col("t"), pattern, before, after).alias("x"))
    assert [r["x"] for r in df.orderBy("i").collect()] == [plain(t) for t in texts_]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_steps_are_dealt_into_more_parts_as_they_grow(spark, monkeypatch):
    made = lambda name: plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(relational, "TASK_ROWS", 500)
    for name in ("steepest_window",):
        assert "REPARTITION_BY_NUM" in made(name)._jdf.queryExecution().executedPlan().toString()
    for name in ("slope_strip", "path_rides", "path_maneuvers", "path_hazards"):
        plan = made(name)._jdf.queryExecution().executedPlan().toString()
        # rows are shuffled once, into a number of parts that comes from theirs
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1 and "hashpartitioning(l_suppkey#" in plan, plan


def test_no_step_reads_all_that_follow(spark):
    plan = plans.QUERIES["path_maneuvers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing$())" not in plan.replace("unboundedpreceding$(), unboundedfollowing$())", "") and "lead(__far" in plan


def test_runs_of_turns_and_kerbs_are_folded_as_in_one_piece(spark, tmp_path):
    lines = """SELECT 1 + i % 2 AS l_suppkey, i::BIGINT AS l_orderkey, (i * 7 % 23)::BIGINT AS l_partkey, (CASE WHEN i % 5 < 3 THEN 3 ELSE 1 + i % 7 END)::INT AS l_linenumber, (i * i % 9)::DOUBLE AS l_quantity,
      i::DOUBLE AS l_extendedprice, 0.03::DOUBLE AS l_discount, 0.05::DOUBLE AS l_tax, 'R' AS l_returnflag, CASE WHEN i % 4 = 0 THEN 'O' ELSE 'F' END AS l_linestatus FROM range(1, 160) t(i)"""
    for name in ("path_maneuvers", "path_hazards", "path_directions"):
        mine, theirs = against_sql(spark, tmp_path, name, lineitem=lines)
        assert mine == theirs and len(mine) > 20, name


def test_a_large_frontier_meets_arcs_dealt_by_their_number(spark, monkeypatch):
    met = []
    monkeypatch.setattr(graph, "SMALL_FRONTIER", 0)
    monkeypatch.setattr(relational, "TASK_ROWS", 20)
    monkeypatch.setattr(graph, "spread", lambda df, rows, *keys: met.append((rows, keys)) or relational.spread(df, rows, *keys), raising=False)
    arcs = [(i, j, float((i * 7 + j * 3) % 11 + 1)) for i in range(12) for j in range(12) if (i + 2 * j) % 5 == 1]
    best = {0: 0.0}
    for _ in range(12):
        for a, b, c in arcs:
            if a in best and best[a] + c < best.get(b, math.inf):
                best[b] = best[a] + c
    found = graph.cheapest(spark.createDataFrame(arcs, "src long, dst long, cost double"), spark.createDataFrame([(0,)], "root long"))
    assert {r["node"]: r["cost"] for r in found.collect()} == best and len(best) > 4
    assert {rows for rows, _ in met} == {len(arcs)} and {("src", "dst"), ("node",), ("src",)} == {keys for _, keys in met}


def test_walkers_are_folded_as_arrow_tables(spark):
    rng = random.Random(8)
    line = [(i * 0.001 + rng.uniform(-0.0004, 0.0004), 56.0 + rng.uniform(-0.0004, 0.0004)) for i in range(30)]
    cum = [i * 60.0 for i in range(30)]
    plan = navigator._plan({"line": [{"lon": x, "lat": y} for x, y in line], "cum": cum, "turns": None, "hazards": None, "rides": None})
    for along in (0.0, 500.0, 1700.0, 9000.0):
        lon, lat = rng.uniform(0, 0.03), 56.0 + rng.uniform(-0.001, 0.001)
        k, best = math.cos(math.radians(lat)) * 111_320.0, (math.inf, along)
        for i in range(29):
            if cum[i + 1] >= along - navigator.BEHIND_M and cum[i] < along + navigator.AHEAD_M:
                (ax, ay), (bx, by) = (((p[0] - lon) * k, (p[1] - lat) * 111_320.0) for p in line[i : i + 2])
                share = min(max(-(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0.0), 1.0)
                best = min(best, (math.hypot(ax + share * (bx - ax), ay + share * (by - ay)), cum[i] + share * 60.0))
        assert all(math.isclose(a, b, rel_tol=1e-9) or a == b for a, b in zip(navigator._snap(plan, lon, lat, along), best, strict=True))
    fixes = spark.createDataFrame([("a", 0.001, 56.0, None), ("a", None, None, None)], "session string, lon double, lat double, accuracy double").withColumn("t", F.lit("2024-01-01").cast("timestamp"))
    plans_ = spark.createDataFrame([("a", line, cum, None, None, None)], "session string, " + navigator.PLAN)
    found = navigator.follow(fixes, plans_)
    assert found.count() == 2 and "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_hours_are_told_in_the_row_that_asks(spark):
    said = hours.parse(spark.createDataFrame([(1, "Mo-Su 22:00-02:00,02:00-03:00; PH off"), (2, "24/7"), (3, "Mo off")], "id long, hours string"))
    asked = spark.sql("select id * 10 + h as ask, id, timestamp'2024-12-24 00:30:00' + make_interval(0, 0, 0, 0, h * 12) as t from range(1, 4) lateral view explode(sequence(0, 3)) x as h")
    holidays = spark.sql("select date'2024-12-25' as date")
    found = hours.status(asked, said, holidays)
    assert {r["ask"]: r["text"] for r in found.collect()} == {
        10: "Open until 03:00", 11: "Closed, opens 22:00", 12: "Open until 02:00", 13: "Closed, opens tomorrow 02:00",
        **{20 + h: "Open 24 hours" for h in range(4)}, **{30 + h: "Closed" for h in range(4)},
    }
    plan = hours.status(asked.where("ask > 0").localCheckpoint(), said)._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Window" not in plan and "Generate" not in plan


def test_few_queries_are_sent_to_the_index(spark):
    plan = plans.QUERIES["place_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # hits of a kind or a beginning don't meet in one task
    assert "hashpartitioning(key#" not in plan and "hashpartitioning(cat#" not in plan
