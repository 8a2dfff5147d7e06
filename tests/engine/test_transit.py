"""Timetables and reports on small fixtures."""

from kerbgraph.operators import crowd, transit


def test_timetable(spark):
    text = lambda names, rows: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    calendar = text("service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date", [("w", *"1111100", "20260101", "20261231"), ("s", *"0000010", "20260101", "20261231"), ("old", *"1111111", "20250101", "20250601")])
    exceptions = text("service_id date exception_type", [("x", "20261007", "1"), ("s", "20261010", "2")])
    days = text("day_type date", [("wd", "20261007"), ("sa", "20261010")])
    services = transit.active_services(calendar, exceptions, days)
    assert {(r["day_type"], r["service_id"]) for r in services.collect()} == {("wd", "w"), ("wd", "x")}
    trips = text("trip_id route_id direction_id service_id", [("t1", "5", "0", "w"), ("t2", "5", "0", "x"), ("t3", "5", "1", "w"), ("t4", "5", "0", "s")])
    times = [("t1", "1", "a", "23:59:00", ""), ("t1", "2", "b", "24:05:00", ""), ("t1", "3", "c", "", "24:05:10"), ("t2", "1", "a", "08:00:00", ""), ("t2", "2", "b", "08:04:01", ""), ("t2", "3", "c", "08:04:21", ""), ("t3", "1", "c", "09:00:00", ""), ("t3", "2", "far", "09:01:00", ""), ("t4", "1", "a", "08:00:00", "")]
    called = transit.calls(trips, text("trip_id stop_sequence stop_id departure_time arrival_time", times), services, text("stop_id", [("a",), ("b",), ("c",)]))
    hours = {(r["line"], r["stop_id"]): {h: n for h, n in enumerate(r["per_hour"]) if n} for r in transit.departures(called).collect()}
    assert hours == {("5:0", "a"): {23: 1, 8: 1}, ("5:0", "b"): {0: 1, 8: 1}}
    assert {(r["a"], r["b"], r["seconds"], r["trips"]) for r in transit.rides(called).collect()} == {("a", "b", 300, 2), ("b", "c", 30, 2)}


def test_reports_find_their_edges(spark):
    m = 1 / 111_320
    edge = lambda i, kind, y: (i, kind, [(0.0, y * m), (100 * m, y * m)])
    edges = spark.createDataFrame([edge(1, "sidewalk", 0), edge(2, "crossing", 6), edge(3, "crossing", 10), edge(4, "crossing", 14), edge(5, "transit", 1), edge(6, "steps", 60)], "edge long, kind string, line array<struct<lon:double,lat:double>>")
    reports = spark.createDataFrame([(1, "no-dropped-kerb", 50 * m, 1 * m, "confirmed"), (2, "narrow-pavement", 50 * m, 2 * m, "reported"), (3, "steps", 50 * m, 1 * m, "reported"), (4, "seat", 50 * m, 1 * m, "reported"), (5, "steep", 50 * m, 40 * m, "reported"), (6, "steps", 50 * m, 52 * m, "faded")], "report long, category string, lon double, lat double, level string")
    assert {(r["report"], r["edge"]) for r in crowd.report_edges(reports, edges).collect()} == {(1, 2), (1, 3), (2, 1), (3, 1), (6, 6)}
    said = crowd.signals(reports.selectExpr("*", "0.8D as confidence", "'x' as detail"), edges).collect()
    assert {r["edge"]: [x["category"] for x in r["community"]] for r in said} == {1: ["narrow-pavement", "steps"], 2: ["no-dropped-kerb"], 3: ["no-dropped-kerb"]}
    asked = spark.createDataFrame([(1, None, 50 * m, 0.0), (2, "steps", 50 * m, 0.0)], "ask long, category string, lon double, lat double")
    near = crowd.nearby(asked, reports).collect()
    assert sorted(r["report"] for r in near if r["ask"] == 1) == [1, 2, 3, 4] and [r["report"] for r in near if r["ask"] == 2] == [3]
