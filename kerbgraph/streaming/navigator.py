"""A walker's progress along a plan, fix by fix: one fold for batches and for streams.

A plan is (line: array of (lon, lat), cum: metres at each point, turns: array of (at, text), hazards: array of (at, length, text), rides: array of (start, end,
alight)). A fix is (session, t, lon, lat, accuracy). Progress only goes forward, two fixes in a row off the line mean off the route, and
nothing is said twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Metres: off the route on foot and riding, warnings before a stop, a hazard, a turn, the end, search behind and ahead.
OFF_M, OFF_RIDING_M, ALIGHT_M, HAZARD_M, TURN_M, ARRIVED_M, BEHIND_M, AHEAD_M = 25.0, 150.0, 350.0, 60.0, 40.0, 15.0, 30.0, 400.0
PLAN = "line array<struct<lon:double,lat:double>>, cum array<double>, turns array<struct<at:double,text:string>>, hazards array<struct<at:double,length:double,text:string>>, rides array<struct<start:double,end:double,alight:string>>"
PROGRESS = "session string, t timestamp, along double, off_by double, off_route boolean, arrived boolean, said string"
TOLD = {"along": pa.float64(), "off_by": pa.float64(), "off_route": pa.bool_(), "arrived": pa.bool_(), "said": pa.string()}
STATE = "along double, off int, said array<string>"


def _snap(plan: dict, lon: float, lat: float, along: float) -> tuple[float, float]:
    """Metres off the line and along it, of the nearest point from 30 m behind to 400 m ahead."""
    if lon is None or lat is None or math.isnan(lon) or math.isnan(lat):
        return math.nan, along
    xs, ys, cum = plan["xs"], plan["ys"], plan["cum"]
    k = math.cos(math.radians(lat)) * 111_320.0
    best, place = math.inf, along
    for i in range(len(cum) - 1):
        if cum[i + 1] < along - BEHIND_M or cum[i] >= along + AHEAD_M:
            continue
        x, y = (xs[i] - lon) * k, (ys[i] - lat) * 111_320.0
        u, v = (xs[i + 1] - lon) * k - x, (ys[i + 1] - lat) * 111_320.0 - y
        share = min(1.0, max(0.0, -(x * u + y * v) / max(u * u + v * v, 1e-12)))
        far = math.hypot(x + share * u, y + share * v)
        if far < best:
            best, place = far, cum[i] + share * (cum[i + 1] - cum[i])
    return best, place


def advance(plan: dict, state: tuple[float, int, list[str]], lon: float, lat: float, accuracy: float | None) -> tuple[tuple[float, int, list[str]], dict]:
    """The state after a fix, and what there is to tell: at most one announcement, arrival before a stop, a wrong way, a hazard, a turn."""
    along, off, said = state
    off_by, place = _snap(plan, lon, lat, along)
    ride = lambda at: next((r for r in plan["rides"] if r["start"] - 5 <= at < r["end"]), None)
    limit = max(OFF_RIDING_M if ride(along) else OFF_M, 10.0 if accuracy is None or math.isnan(accuracy) else accuracy)
    off, along = (off + 1, along) if off_by > limit else (0, max(along, place))
    now, length = ride(along), plan["cum"][-1] if len(plan["cum"]) else 0.0
    arrived = length - along < ARRIVED_M
    hazard = next((i for i, h in enumerate(plan["hazards"]) if h["at"] + h["length"] > along and h["at"] - along <= HAZARD_M and f"h:{i}" not in said), None)
    turn = next((t for t in plan["turns"] if t["at"] > along + 2), None)
    options = (
        ("arrive", arrived, "You have arrived."), (f"alight:{now['end']}" if now else "", now is not None and now["end"] - along <= ALIGHT_M, f"Get ready to get off. Your stop is {now['alight']}." if now else ""),
        (f"off:{int(along / 50 + 0.5)}", off >= 2, "You're off the route. Working out a new one."), (f"h:{hazard}", hazard is not None, plan["hazards"][hazard]["text"] if hazard is not None else ""),
        (f"m:{turn['at']}" if turn else "", turn is not None and turn["at"] - along <= TURN_M, turn["text"] if turn else ""),
    )
    key, text = next(((k, words) for k, due, words in options if due and k not in said), (None, None))
    if key is not None:
        near = [f"h:{i}" for i, h in enumerate(plan["hazards"]) if hazard is not None and key == f"h:{hazard}" and abs(h["at"] - plan["hazards"][hazard]["at"]) <= 10]
        said = [*said, key, *[k for k in near if k not in said and k != key]]
    return (along, off, said), {"along": along, "off_by": off_by, "off_route": off >= 2, "arrived": arrived, "said": text}


def _told(rows: pa.Table, plan: dict, state: tuple[float, int, list[str]]) -> tuple[tuple[float, int, list[str]], pa.Table]:
    """The state after a session's rows, and what each tells, in the order of time."""
    rows = rows.take(pc.sort_indices(rows["t"], null_placement="at_end"))
    out = []
    for lon, lat, accuracy in zip(*(rows[c].to_pylist() for c in ("lon", "lat", "accuracy")), strict=True):
        state, told = advance(plan, state, lon, lat, accuracy)
        out.append(told)
    said = {k: pa.array([o[k] for o in out], kind) for k, kind in TOLD.items()}
    return state, pa.table({"session": rows["session"], "t": rows["t"]} | said)


def _plan(row: dict) -> dict:
    plan = {k: list(row[k]) if row[k] is not None else [] for k in ("line", "cum", "turns", "hazards", "rides")}
    return plan | {"xs": [p["lon"] for p in plan["line"]], "ys": [p["lat"] for p in plan["line"]]}


def follow(fixes: DataFrame, plans: DataFrame) -> DataFrame:
    """Progress for every fix of sessions that have a plan. A session, one walk of one person, is folded in one group."""

    def run(rows: pa.Table, plan: pa.Table) -> pa.Table:
        if not len(plan) or not len(rows):
            return pa.table({"session": pa.array([], pa.string()), "t": pa.array([], pa.timestamp("us", "UTC"))} | {k: pa.array([], kind) for k, kind in TOLD.items()})
        return _told(rows, _plan(plan.slice(0, 1).to_pylist()[0]), (0.0, 0, []))[1]

    return fixes.groupBy("session").cogroup(plans.groupBy("session")).applyInArrow(run, PROGRESS)


def follow_stream(fixes: DataFrame, plans: DataFrame, idle: str = "2 hours") -> DataFrame:
    """As follow, for a stream of fixes and a table of plans. State is a position, a count and what was said; it goes after two idle hours by
    event time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        along, off, said = state.get if state.exists else (0.0, 0, [])
        plan = _plan(rows.iloc[0].to_dict())
        fixes_ = pa.Table.from_pandas(rows[["session", "t", "lon", "lat", "accuracy"]], preserve_index=False)
        new, told = _told(fixes_, plan, (along, off, list(said)))
        state.update(new)
        state.setTimeoutTimestamp(int(rows["t"].max().timestamp() * 1000) + int(pd.Timedelta(idle).total_seconds() * 1000))
        yield told.to_pandas()

    rows = fixes.withWatermark("t", "10 minutes").join(F.broadcast(plans), "session")
    return rows.groupBy("session").applyInPandasWithState(run, PROGRESS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
