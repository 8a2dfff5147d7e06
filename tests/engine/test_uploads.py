"""Uploads judged one by one in Python, and a stream of them that is stopped and goes on."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kerbgraph.streaming import uploads

KIND = "attempt long, id string, kind string, person int, network int, arrived timestamp, observed_at timestamp"
LIMITS = {"note": (3, None), "report": (2, 4)}
START = datetime(2024, 3, 1)


def made(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        arrived = START + timedelta(minutes=rng.choice([rng.randint(0, 6000), 1440 * rng.randint(0, 3)]))
        who = rng.choice([1, 1, 1, 2, 3, 4, 5, None])
        out.append((i, rng.choice([f"{who}-{rng.randint(0, 60)}", f"x{i}", f"x{i}", None]), rng.choice(["note", "report", "report", "other"]), who, rng.choice([7, 7, 8, None]), arrived, arrived + timedelta(hours=rng.randint(-50, 2))))
    return sorted(out, key=lambda u: (u[5], u[0]))


def plain(rows):
    kept, out = [], {}
    for attempt, ident, kind, person, network, arrived, _ in rows:
        near = [k for k in kept if k[1] == kind and k[4] > arrived - timedelta(days=1)]
        of_person, of_network = LIMITS.get(kind, (None, None))
        if ident is not None and any(k[0] == ident and k[1] == kind for k in kept):
            out[attempt] = "repeat"
        elif of_person is not None and person is not None and sum(k[2] == person for k in near) >= of_person:
            out[attempt] = "person"
        elif of_network is not None and network is not None and sum(k[3] == network for k in near) >= of_network:
            out[attempt] = "network"
        else:
            out[attempt] = "stored"
            kept.append((ident, kind, person, network, arrived))
    return out


def test_verdicts_one_by_one(spark):
    rows = made(260)
    got = {r["attempt"]: r["verdict"] for r in uploads.decide(spark.createDataFrame(rows, KIND), limits=LIMITS).collect()}
    want = plain(rows)
    assert got == want and set(want.values()) == {"stored", "repeat", "person", "network"}
    assert uploads.decide(spark.createDataFrame([], KIND)).collect() == []


def test_networks_that_share_nothing_are_judged_in_one_pass(spark, monkeypatch):
    def closed(rows):
        # persons and ids of their own network; one network is too large, one row has no network
        return [(a, i and f"{(w or 0) % 3}-{a % 25}", k, w, (w or 0) % 3, t, o) for a, i, k, w, _, t, o in rows]

    judged = lambda rows, stored=None: {r["attempt"]: r["verdict"] for r in uploads.decide(spark.createDataFrame(rows, KIND), stored, LIMITS).collect()}
    rows = closed(made(200, 3))
    settled, rounds = [], uploads._rounds
    monkeypatch.setattr(uploads, "_rounds", lambda df, *rest: settled.append(df.count()) or rounds(df, *rest))
    want = plain(rows)
    assert judged(rows) == want and set(want.values()) == {"stored", "repeat", "person", "network"} and not settled
    first, then = rows[:90], rows[90:]
    kept = [r for r in first if want[r[0]] == "stored"]
    stored = spark.createDataFrame(kept, KIND).select(*uploads.COLUMNS)
    assert judged(then, stored) == {r[0]: want[r[0]] for r in then} and not settled
    monkeypatch.setattr(uploads, "FOLD_ROWS", 60)
    mixed = sorted([*rows, (900, "0-x", "report", 77, None, START, START), (901, "0-x", "report", 77, 9, START, START)], key=lambda u: (u[5], u[0]))
    assert judged(mixed) == plain(mixed) and 0 < settled[0] < len(mixed)


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    rows = made(90, 5)
    feed, target, checkpoint = (str(tmp_path / d) for d in ("feed", "store", "checkpoint"))
    for part in (rows[:30], rows[30:31], rows[31:]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(feed)
        source = spark.readStream.schema(KIND).parquet(feed)
        uploads.store(source, target, checkpoint, LIMITS, available_now=True).awaitTermination()
    found = spark.read.parquet(target)
    got = {r["attempt"]: r for r in found.collect()}
    assert {a: r["verdict"] for a, r in got.items()} == plain(rows)
    assert all(r["observed_at"] <= r["arrived"] for r in got.values()) and found.where(F.col("observed_at") < F.col("arrived")).count() > 0
