"""Stateful stream operators: tile ownership, navigation paths, the delay buffer, deferred positions.

Each keeps bounded state by key and yields the changes that a micro-batch makes. Within a batch rows are
taken in frame order; across batches the stream's order holds, so a source should deliver frames in order
or be re-ordered by ``in_order`` first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.operators.tiles import Competition

DELAY = 10


def _load(state: GroupState, default):
    return json.loads(state.get[0]) if state.exists else default


def _rows(parts: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    found = [p for p in parts if len(p)]
    return pd.concat(found).sort_values(list(order)) if found else pd.DataFrame()


def owner_stream(candidates: DataFrame, component: str = "component") -> DataFrame:
    """Takeovers (component, frame, i, j, previous) from candidates (component, frame, i, j, motion, focus, d2, full).

    A tile that a frame covers only in part is never taken.
    """

    def run(key, parts, state):
        held = _load(state, {"owner": [], "owned": []})
        c = Competition()
        c.owner = {(i, j): tuple(o) for i, j, o in held["owner"]}
        c.owned = {int(k): v for k, v in held["owned"]}
        out = []
        for r in _rows(parts, "frame", "i", "j").itertuples():
            before = c.owner.get((r.i, r.j))
            if r.full and c.offer((int(r.i), int(r.j)), int(r.frame), float(r.motion), float(r.focus), float(r.d2)):
                out.append((key[0], r.frame, r.i, r.j, before[0] if before else None))
        state.update((json.dumps({"owner": [[i, j, list(o)] for (i, j), o in c.owner.items()], "owned": list(c.owned.items())}),))
        yield pd.DataFrame(out, columns=["component", "frame", "i", "j", "previous"]).astype({"previous": "Int64"})

    kind = candidates.schema[component].dataType.simpleString()
    return candidates.groupBy(component).applyInPandasWithState(run, f"component {kind}, frame long, i int, j int, previous long", "state string", "append", GroupStateTimeout.NoTimeout)


def path_stream(frames: DataFrame, by: str = "slide") -> DataFrame:
    """(slide, frame, path): running number of magnification runs; frames of no component break no run and are left out."""

    def run(key, parts, state):
        mag, path = _load(state, [None, 0])
        out = []
        for r in _rows(parts, "frame").itertuples():
            if r.component < 0:
                continue
            if r.mag != mag:
                mag, path = r.mag, path + 1
            out.append((key[0], r.frame, path))
        state.update((json.dumps([mag, path]),))
        yield pd.DataFrame(out, columns=["slide", "frame", "path"])

    kind = frames.schema[by].dataType.simpleString()
    return frames.groupBy(by).applyInPandasWithState(run, f"slide {kind}, frame long, path long", "state string", "append", GroupStateTimeout.NoTimeout)


def delay_stream(frames: DataFrame, by: str = "slide", delay: int = DELAY) -> DataFrame:
    """(slide, frame, released_by): frames whose tiles are all covered wait until ``delay`` later frames have
    arrived; uncovered ones pass at once. Rows with ``last`` drain the buffer."""

    def run(key, parts, state):
        waiting = _load(state, [])
        out = []
        for r in _rows(parts, "frame").itertuples():
            waiting = [[f, n + 1] for f, n in waiting]
            if r.covered and not r.last:
                waiting.append([int(r.frame), 0])
            else:
                out.append((key[0], r.frame, r.frame))
            due = [f for f, n in waiting if n >= delay or r.last]
            out += [(key[0], f, r.frame) for f in due]
            waiting = [w for w in waiting if w[0] not in due]
        state.update((json.dumps(waiting),))
        yield pd.DataFrame(out, columns=["slide", "frame", "released_by"])

    kind = frames.schema[by].dataType.simpleString()
    return frames.groupBy(by).applyInPandasWithState(run, f"slide {kind}, frame long, released_by long", "state string", "append", GroupStateTimeout.NoTimeout)


def position_stream(edges: DataFrame, by: str = "slide") -> DataFrame:
    """(slide, frame, x, y, root) as soon as they are known: position = predecessor's - t, deferred until the
    predecessor resolves; an edge without one starts a component at (0, 0). Edges: (slide, frame, matched_to, t_x, t_y)."""

    def run(key, parts, state):
        known, waiting = _load(state, [{}, {}])
        out = []
        for r in _rows(parts, "frame").itertuples():
            todo = [[int(r.frame), None if pd.isna(r.matched_to) else int(r.matched_to), float(r.t_x or 0), float(r.t_y or 0)]]
            while todo:
                f, m, tx, ty = todo.pop()
                if m is None:
                    known[str(f)] = [0, 0, f]
                elif str(m) in known:
                    x, y, root = known[str(m)]
                    known[str(f)] = [int(x - tx), int(y - ty), root]
                else:
                    waiting.setdefault(str(m), []).append([f, m, tx, ty])
                    continue
                out.append((key[0], f, *known[str(f)]))
                todo += waiting.pop(str(f), [])
        state.update((json.dumps([known, waiting]),))
        yield pd.DataFrame(out, columns=["slide", "frame", "x", "y", "root"])

    kind = edges.schema[by].dataType.simpleString()
    return edges.groupBy(by).applyInPandasWithState(run, f"slide {kind}, frame long, x long, y long, root long", "state string", "append", GroupStateTimeout.NoTimeout)


def gate_stream(reports: DataFrame, by: str = "slide", reach: int = 3) -> DataFrame:
    """(slide, frame, valid): a frame is released once all frames from max(0, i - reach) to i + reach have
    reported; it is invalid if any of them is dark. ``last`` rows act as the frames that never come."""

    def run(key, parts, state):
        seen, done = _load(state, [{}, []])
        done, end = set(done), None
        for r in _rows(parts, "frame").itertuples():
            seen[str(int(r.frame))] = bool(r.dark)
            if r.last:
                end = int(r.frame)
        if end is not None:
            seen.update({str(end + k): False for k in range(1, reach + 1)})
        out = []
        for f in sorted(map(int, seen)):
            near = [str(k) for k in range(max(0, f - reach), f + reach + 1)]
            if f not in done and (end is None or f <= end) and all(k in seen for k in near):
                out.append((key[0], f, not any(seen[k] for k in near)))
                done.add(f)
        keep = min((f for f in map(int, seen) if f not in done), default=0) - reach
        seen = {k: v for k, v in seen.items() if int(k) >= keep}
        done = {f for f in done if f >= keep}
        state.update((json.dumps([seen, sorted(done)]),))
        yield pd.DataFrame(out, columns=["slide", "frame", "valid"])

    kind = reports.schema[by].dataType.simpleString()
    return reports.groupBy(by).applyInPandasWithState(run, f"slide {kind}, frame long, valid boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def frames_by_window(frames: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Frames and mean value by event-time window, late rows dropped past the watermark."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return frames.withWatermark(ts, late).groupBy(w, "event_type").agg(F.count("*").alias("frames"), F.avg("value").alias("mean"))


def latest_stream(frames: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Newest row's columns by key, for update or complete mode."""
    return frames.groupBy(by).agg(F.max_by(F.struct(*columns), order).alias("s")).select(by, "s.*")


def run_to_end(stream: DataFrame, checkpoint: str, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs a stream over all that is there now and returns its rows (from the memory sink: for small outputs)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def bounds_stream(frames: DataFrame, by: str = "component") -> DataFrame:
    """Bounds of each component as they grow, for update or complete mode."""
    return frames.groupBy(by).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
