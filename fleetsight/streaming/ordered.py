"""Keyed state that sees its rows in event-time order, with event-time timers.

Rows of a key may come in any order and in any number of files.  They wait in state until the
watermark has passed their time and are then worked through in order; what a processor promises for
a later time (a claim that lapses, an object that stays away) is kept by a timer, not by the next row.
Rows behind the watermark are late and are dropped.  A stream needs a column ``ts`` with a watermark and
``at``, the same time in microseconds (``timed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

import fleetsight
from fleetsight.functions.scalar import micros
from fleetsight.operators.blocks import plain
from fleetsight.operators.tracking import Replay, Rules
from fleetsight.session import ship


def timed(df: DataFrame, late: str) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", micros(F.col("ts"))).withWatermark("ts", late)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def _ms(at: int) -> int:
    """The first millisecond that is not before a time in microseconds."""
    return -(-int(at) // 1000)


class InOrder(StatefulProcessor):
    """Rows in time order.  A subclass names its rows (the first column is ``at``) and its output, keeps its state
    in ``open`` and works in ``step``."""

    ROWS = OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROWS)
        # The time of the oldest waiting row: one timer for it wakes the key, however many rows wait.
        self.oldest = handle.getValueState("oldest", "at long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: list[tuple], now: int) -> list[tuple]:
        """Work through rows that are due, oldest first, and keep promises up to ``now`` (microseconds)."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        oldest = before = self.oldest.get()[0] if self.oldest.exists() else None
        for frame in rows:
            frame = frame.loc[frame["at"] >= mark, _names(self.ROWS)]
            if len(frame):
                self.waiting.appendList([tuple(None if v is pd.NA or v != v else v for v in r)
                                         for r in plain(frame).astype(object).itertuples(index=False, name=None)])
                first = int(frame["at"].min())
                oldest = first if oldest is None else min(oldest, first)
        if oldest != before:
            self._wake(oldest)
        return iter(())

    def _wake(self, at: int) -> None:
        self.oldest.update((at,))
        self.handle.registerTimer(_ms(at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # A timer that only keeps a promise leaves the waiting rows alone.
        ripe = self.oldest.exists() and self.oldest.get()[0] <= now
        held = list(self.waiting.get()) if ripe else []
        due = sorted((r for r in held if r[0] <= now), key=lambda r: tuple((v is not None, v) for v in r))
        if due:
            rest = [r for r in held if r[0] > now]
            if rest:
                self.waiting.put(rest)
                self._wake(min(r[0] for r in rest))
            else:
                self.waiting.clear()
                self.oldest.clear()
        out = self.step(key, [tuple(r) for r in due], now)
        if out:
            yield plain(pd.DataFrame(out, columns=_names(self.OUT)))

    def close(self) -> None:
        pass


def keyed_state(df: DataFrame, keys: list[str], processor: StatefulProcessor) -> DataFrame:
    """Apply a processor.  It is sent with its code: Spark also starts it in a worker beside the driver, which does not
    get the files sent to executors."""
    ship(df.sparkSession)
    cloudpickle.register_pickle_by_value(fleetsight)
    try:
        return df.groupBy(*keys).transformWithStateInPandas(processor, processor.OUT, "append", "EventTime")
    finally:
        cloudpickle.unregister_pickle_by_value(fleetsight)


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class ClaimLifetimes(StatefulProcessor):
    """A claim that is not renewed becomes stale and then expires; a release ends it at once.

    One state holds the masks of a bucket, as there are very many masks with few rows each: their waiting rows as packed
    blocks, their open claims as one, and one timer for the first of them that is due.  Masks without an id are one
    mask, with a bucket of its own.
    """

    KIND = pa.schema([("mask_id", pa.int64()), ("stage", pa.int32()), ("at", pa.int64()), ("step", pa.int64()),
                      ("action", pa.string()), ("object_id", pa.string())])
    OUT = "mask_id long, object_id string, event string, at long"

    def __init__(self, stale_s: float = 0.5, expire_s: float = 1.0):
        self.stages = (("stale", int(stale_s * 1e6)), ("expired", int(expire_s * 1e6)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.claims = handle.getValueState("claims", "rows binary")
        self.first = handle.getValueState("first", "at long")

    def _wake(self, at: int) -> None:
        self.first.update((at,))
        self.handle.registerTimer(_ms(at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        first = before = self.first.get()[0] if self.first.exists() else None
        blocks = []
        for frame in rows:
            frame = frame[frame["at"] >= mark]
            if len(frame):
                frame = plain(frame).assign(stage=0)
                blocks.append((_packed(pa.table([pa.array(frame[f.name], f.type, from_pandas=True) for f in self.KIND],
                                                schema=self.KIND)),))
                at = int(frame["at"].min())
                first = at if first is None else min(first, at)
        if blocks:
            self.waiting.appendList(blocks)
        if first != before:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.first.exists() or self.first.get()[0] > now:
            return
        held = pa.concat_tables([self.KIND.empty_table(), *[_unpacked(r[0]) for r in self.waiting.get()]])
        ripe = pc.less_equal(held["at"], now)
        rest = held.filter(pc.invert(ripe))
        open_ = _unpacked(self.claims.get()[0]) if self.claims.exists() else self.KIND.empty_table()
        out, kept, due = self._lapsed(open_, held.filter(ripe), now)
        if len(rest) < len(held):
            if len(rest):
                self.waiting.put([(_packed(rest),)])
            else:
                self.waiting.clear()
        if len(kept):
            self.claims.update((_packed(kept),))
        else:
            self.claims.clear()
        due += [pc.min(rest["at"]).as_py()] if len(rest) else []
        if due:
            self._wake(min(due))
        else:
            self.first.clear()
        if len(out):
            if key[0] < 0:
                out["mask_id"] = None
            yield plain(out)

    def _lapsed(self, open_: pa.Table, rows: pa.Table, now: int) -> tuple[pd.DataFrame, pa.Table, list[int]]:
        """Events up to ``now`` of the open claims and the rows that follow them, the claims that stay open, and the time
        of the first event to come."""
        every = pa.concat_tables([open_, rows])
        every = every.append_column("new", pa.array(np.arange(len(every)) >= len(open_)))
        every = every.take(pc.sort_indices(every, [(c, "ascending") for c in (
            "mask_id", "new", "at", "step", "action", "object_id")], null_placement="at_start"))
        mask, at, stage = (every[c].to_numpy() for c in ("mask_id", "at", "stage"))
        last = np.append(mask[1:] != mask[:-1], True)[:len(mask)]
        # A renewal at the very limit still counts, so the moment before the next row is the last one without it.
        until = np.where(last, now, np.append(at[1:], 0)[:len(at)] - 1)
        live = ~pc.fill_null(pc.equal(every["action"], "release"), False).to_numpy(zero_copy_only=False)
        gone, found = live, []
        for place, (event, limit) in enumerate(self.stages):
            gone = gone & (at + limit <= until)
            fresh = np.flatnonzero(gone & (stage <= place))
            found.append(pd.DataFrame({"mask_id": mask[fresh], "object_id": every["object_id"].take(pa.array(fresh)).to_pandas(),
                                       "event": event, "at": at[fresh] + limit}))
            stage = np.where(gone, place + 1, stage)
        stay = np.flatnonzero(live & last & (stage < len(self.stages)))
        limits = np.array([limit for _, limit in self.stages])
        kept = every.take(pa.array(stay)).drop_columns(["new"]).set_column(1, self.KIND.field(1), pa.array(stage[stay], pa.int32()))
        due = [int((at[stay] + limits[stage[stay]]).min())] if len(stay) else []
        return pd.concat(found, ignore_index=True), kept, due

    def close(self) -> None:
        pass


#: Buckets of masks; a stream keeps theirs for as long as it goes on.
BUCKETS = 1024


def claim_lifetimes(log: DataFrame, stale_s: float = 0.5, expire_s: float = 1.0, late: str = "1 second") -> DataFrame:
    """``stale`` and ``expired`` events of a stream of claims, renewals and releases (``mask_id, object_id, ts, action,
    step``)."""
    known = F.col("mask_id").isNotNull()
    rows = timed(log, late).withColumn("bucket", F.when(known, F.pmod(F.xxhash64("mask_id"), F.lit(BUCKETS)).cast("int")).otherwise(-1))
    rows = rows.withColumn("mask_id", F.coalesce("mask_id", F.lit(0).cast("long")))
    return keyed_state(rows.select("bucket", "mask_id", "ts", "at", "step", "action", "object_id"), ["bucket"],
                       ClaimLifetimes(stale_s, expire_s))


class IdleObjects(InOrder):
    """An object that stays provisional and unseen for a while is asked for again, once after each sighting."""

    ROWS = "at long, tie long, status string"
    OUT = "id string, last_seen long, at long"

    def __init__(self, idle_s: float = 60.0):
        self.idle = int(idle_s * 1e6)

    def open(self, handle):
        self.seen = handle.getValueState("seen", "at long")

    def step(self, key, rows, now):
        last, out = self.seen.get()[0] if self.seen.exists() else None, []

        def fire(until: int):
            nonlocal last
            if last is not None and last + self.idle <= until:
                out.append((key[0], last, last + self.idle))
                last = None

        for at, _, status in rows:
            fire(at)
            last = at if status == "provisional" else None
        fire(now)
        if last is None:
            self.seen.clear()
        else:
            self.seen.update((last,))
            self.handle.registerTimer(_ms(last + self.idle))
        return out


def idle_objects(sightings: DataFrame, idle_s: float = 60.0, late: str = "1 second") -> DataFrame:
    """Objects to process again, from a stream of sightings (``id, ts, status, tie``)."""
    return keyed_state(timed(sightings, late), ["id"], IdleObjects(idle_s))


class ModeVotes(InOrder):
    """The mode in force at each frame of a camera: the most common of the last recommendations.

    A camera has very many rows: they wait as packed blocks and are worked through as columns.
    """

    ROWS = "at long, frame_no long, det_id long, recommended string"
    OUT = "camera_id string, frame_no long, det_id long, mode string"
    KIND = pa.schema([("at", pa.int64()), ("frame_no", pa.int64()), ("det_id", pa.int64()), ("recommended", pa.string())])
    #: Rows whose windows are held at once.
    SLICE = 100_000

    def __init__(self, n: int = 10, least_history: int = 5, least_votes: int = 3, start: str = "balanced"):
        self.n, self.least_history, self.least_votes, self.start = n, least_history, least_votes, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.oldest = handle.getValueState("oldest", "at long")
        self.recent = handle.getListState("recent", "mode string")
        self.mode = handle.getValueState("mode", "mode string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        oldest = before = self.oldest.get()[0] if self.oldest.exists() else None
        blocks = []
        for frame in rows:
            frame = plain(frame.loc[frame["at"] >= mark, self.KIND.names])
            if len(frame):
                blocks.append((_packed(pa.table([pa.array(frame[f.name], f.type, from_pandas=True) for f in self.KIND],
                                                schema=self.KIND)),))
                first = int(frame["at"].min())
                oldest = first if oldest is None else min(oldest, first)
        if blocks:
            self.waiting.appendList(blocks)
        if oldest != before:
            self._wake(oldest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if not self.oldest.exists() or self.oldest.get()[0] > now:
            return
        held = pa.concat_tables([self.KIND.empty_table(), *[_unpacked(r[0]) for r in self.waiting.get()]])
        ripe = pc.less_equal(held["at"], now)
        due, rest = held.filter(ripe), held.filter(pc.invert(ripe))
        if len(rest):
            self.waiting.put([(_packed(rest.slice(at, self.SLICE)),) for at in range(0, len(rest), self.SLICE)])
            self._wake(pc.min(rest["at"]).as_py())
        else:
            self.waiting.clear()
            self.oldest.clear()
        due = due.take(pc.sort_indices(due, [(c, "ascending") for c in self.KIND.names], null_placement="at_start"))
        for at in range(0, len(due), self.SLICE):
            part = due.slice(at, self.SLICE)
            yield plain(pd.DataFrame({"camera_id": key[0], "frame_no": part["frame_no"].to_pandas(), "det_id": part["det_id"].to_pandas(),
                                      "mode": self._elected(part["recommended"])}))

    def _elected(self, wanted: pa.ChunkedArray) -> np.ndarray:
        """Modes at the next recommendations: the oldest of the most common ones, kept while too few agree."""
        before = [r[0] for r in self.recent.get()]
        seen = pa.concat_arrays([pa.array(before, pa.string()), *wanted.chunks])
        coded = pc.dictionary_encode(seen, null_encoding="encode")
        code, names = coded.indices.to_numpy(), np.array([*coded.dictionary.to_pylist(), None], object)[:-1]
        window = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(self.n - 1, -1), code]), self.n)[len(before):]
        # How often the recommendation in each place of a window is in it; places before the first row are in none.
        votes = np.stack([(window == window[:, k:k + 1]).sum(1) for k in range(self.n)], axis=1)
        votes[window < 0] = 0
        first = votes.argmax(1)
        place = np.arange(len(window))
        clear = (votes[place, first] >= self.least_votes) & (np.minimum(self.n, len(before) + 1 + place) >= self.least_history)
        last = np.maximum.accumulate(np.where(clear, place, -1))
        mode = np.empty(len(window), object)
        mode[:] = self.mode.get()[0] if self.mode.exists() else self.start
        known = last >= 0
        mode[known] = names[window[last[known], first[last[known]]]]
        self.recent.put([(m,) for m in names[code[-self.n:]]])
        self.mode.update((mode[-1],))
        return mode


def mode_votes(frames: DataFrame, late: str = "1 second", **limits) -> DataFrame:
    """Modes of a stream of recommendations (``camera_id, frame_no, det_id, ts, recommended``)."""
    return keyed_state(timed(frames, late), ["camera_id"], ModeVotes(**limits))


class Tracker(InOrder):
    """Tracks of one camera: a map of live tracks by id, and a timer that empties it when the camera falls silent."""

    ROWS = "at long, frame_no long, det_id long, x1 double, y1 double, x2 double, y2 double"
    OUT = ("camera_id string, frame_no long, det_id long, birth_id long, state string, age int, hits int, missed int, "
           "vx double, vy double")
    TRACK = ("place int, x1 double, y1 double, x2 double, y2 double, state string, age int, hits int, gap int, "
             "vx double, vy double")

    def __init__(self, rules: Rules = Rules(), frame_us: int = 66_667):
        self.rules, self.frame_us = rules, frame_us

    def open(self, handle):
        self.tracks = handle.getMapState("tracks", "birth_id long", self.TRACK)
        self.last = handle.getValueState("last", "frame_no long, at long")

    def step(self, key, rows, now):
        last = tuple(self.last.get()) if self.last.exists() else None
        if not rows:
            if last is not None and last[1] + (self.rules.buffer + 1) * self.frame_us <= now:
                self.tracks.clear()
                self.last.clear()
            return []
        machine = Replay(self.rules)
        stored = {}
        if last is not None:
            machine.last = last[0]
            stored = {k[0]: tuple(v) for k, v in self.tracks.iterator()}
            for birth, (_, x1, y1, x2, y2, state, age, hits, gap, vx, vy) in sorted(stored.items(), key=lambda e: e[1][0]):
                machine.tracks.append([birth, np.array([x1, y1, x2, y2]), state, age, hits, gap,
                                       None if vx is None else (vx, vy), None])
        out, first = [], 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i][1] == rows[first][1]:
                continue
            part, first = rows[first:i], i
            boxes = np.array([r[3:7] for r in part], np.float64)
            for r, (t, missed) in zip(part, machine.frame(int(part[0][1]), boxes)):
                if t[0] is None:
                    t[0] = int(r[2])
                out.append((key[0], int(r[1]), int(r[2]), t[0], t[2], t[3], t[4], missed, *(t[6] or (None, None))))
        now_there = {t[0]: (j, *(float(x) for x in t[1]), t[2], int(t[3]), int(t[4]), int(t[5]),
                            *((float(v) for v in t[6]) if t[6] else (None, None))) for j, t in enumerate(machine.tracks)}
        for birth in stored.keys() - now_there.keys():
            self.tracks.removeKey((birth,))
        for birth, track in now_there.items():
            if stored.get(birth) != track:
                self.tracks.updateValue((birth,), track)
        self.last.update((int(machine.last), int(rows[-1][0])))
        self.handle.registerTimer(_ms(rows[-1][0] + (self.rules.buffer + 1) * self.frame_us))
        return out


def stream_tracks(det: DataFrame, rules: Rules = Rules(), frame_us: int = 66_667, late: str = "1 second") -> DataFrame:
    """Track rows of a stream of detections (``camera_id, ts, frame_no, det_id, confidence`` and a box).  All boxes of a
    frame have its time, ``frame_us`` after the frame before; they may come in several files."""
    # a row without a detection only moves the watermark
    active = det.filter(F.coalesce(F.col("confidence") >= rules.activate, F.lit(False)) | F.col("det_id").isNull())
    doubles = {c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")}
    return keyed_state(timed(active, late).withColumns(doubles), ["camera_id"], Tracker(rules, frame_us))


class Frames(StatefulProcessor):
    """Image rows of a frame, put together from pixels that come in any order and any number of files.

    Pixels come packed (``packed_pixels``).  A frame that waits keeps the values of its image and a bit for each pixel
    it has.  A frame leaves as soon as it is complete; one that is not when the watermark passes its time leaves as it
    is, with its gaps as zeros.
    """

    OUT = "frame_key long, v int, x array<int>, complete boolean"

    def __init__(self, width: int, height: int):
        self.width, self.height = width, height

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.image = handle.getValueState("image", "x binary, there binary")
        self.count = handle.getValueState("count", "pixels int")       # -1: the frame has left

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        n = self.count.get()[0] if self.count.exists() else 0
        parts = pd.concat(list(rows))
        parts = parts[parts["at"] >= mark]
        if n < 0 or not len(parts):
            return
        v, u, x = (np.concatenate([np.frombuffer(b, "<i4") for b in parts[c]]) for c in ("v", "u", "x"))
        image, there = self._image(max(self.height, int(v.max(initial=-1)) + 1), n > 0)
        image[v, u], there[v, u] = x, True
        n = int(there.sum())
        self.handle.registerTimer(_ms(parts["at"].max()))
        if n == self.width * self.height:
            yield self._leave(key, image, there, True)
            self.image.clear()
            n = -1
        elif n:
            self.image.update((image.tobytes(), np.packbits(there).tobytes()))
        self.count.update((n,))

    def _image(self, height: int, known: bool) -> tuple[np.ndarray, np.ndarray]:
        """What is known of a frame, with at least ``height`` rows."""
        image, there = np.zeros((height, self.width), "<i4"), np.zeros((height, self.width), bool)
        if known:
            x, bits = self.image.get()
            old = np.frombuffer(x, "<i4").reshape(-1, self.width)
            if len(old) > height:
                return self._image(len(old), known)
            image[:len(old)] = old
            there[:len(old)] = np.unpackbits(np.frombuffer(bits, np.uint8), count=old.size).reshape(old.shape)
        return image, there

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.count.exists():
            if self.count.get()[0] > 0:
                yield self._leave(key, *self._image(0, True), False)
                self.image.clear()
            self.count.clear()

    def _leave(self, key: tuple, image: np.ndarray, there: np.ndarray, complete: bool) -> pd.DataFrame:
        found = np.flatnonzero(there.any(1))
        return pd.DataFrame({"frame_key": [key[0]] * len(found), "v": found.astype(np.int32), "x": list(image[found]),
                             "complete": [complete] * len(found)})

    def close(self) -> None:
        pass


def packed_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels of a frame and moment that lie together in one row: ``frame_key, ts`` and ``v, u, x`` as lists of integers of
    four bytes.  What follows moves a few rows a frame."""
    def run(batches):
        for b in batches:
            # A row without a pixel only moves the watermark.
            none = b.filter(pc.is_null(b.column("v")))
            if none.num_rows:
                empty = pa.array([b""] * none.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([none.column("frame_key"), none.column("ts"), empty, empty, empty],
                                                 names=["frame_key", "ts", *"vux"])
            b = b.filter(pc.is_valid(b.column("v")))
            if not b.num_rows:
                continue
            b = b.take(pc.sort_indices(b, [("frame_key", "ascending"), ("ts", "ascending")]))
            code = [pc.fill_null(b.column(c).cast(pa.int64()), -1).to_numpy() for c in ("frame_key", "ts")]
            void = [~b.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("frame_key", "ts")]
            first = np.flatnonzero(np.any([np.diff(c, prepend=c[:1] - 1) != 0 for c in code]
                                          + [np.diff(c.astype(np.int8), prepend=-1) != 0 for c in void], axis=0))
            ends = pa.array(np.append(first, b.num_rows) * 4, pa.int32()).buffers()[1]
            lists = [pa.Array.from_buffers(pa.binary(), len(first), [None, ends, pa.py_buffer(
                np.ascontiguousarray(b.column(c).to_numpy(zero_copy_only=False).astype("<i4")))]) for c in "vux"]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(first)) for c in ("frame_key", "ts")], *lists],
                                             names=["frame_key", "ts", *"vux"])

    return pixels.select("frame_key", F.col("ts").cast("timestamp").alias("ts"), "v", "u", "x").mapInArrow(
        run, "frame_key long, ts timestamp, v binary, u binary, x binary")


def frames(pixels: DataFrame, width: int, height: int, late: str = "10 seconds") -> DataFrame:
    """Image rows of whole frames from a stream of pixels (``frame_key, ts, v, u, x``)."""
    return keyed_state(timed(packed_pixels(pixels), late), ["frame_key"], Frames(width, height))
