"""STR-07. The ordered drain of job queues as a stateful stream: a pass starts nothing while an earlier pass has active jobs."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PASSES = ["pass1", "pass2", "pass3"]
KINDS = ["queued", "beat", "done"]
STARTS = "queue long, poll timestamp, job_id long, job_type string, attempt int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows as the state keeps them: kind and stage are places in KINDS and PASSES.
ROW = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("job_id", "<i8"), ("kind", "i1"), ("stage", "i1"), ("priority", "<i8")])
JOB = np.dtype([("job_id", "<i8"), ("stage", "i1"), ("priority", "<i8"), ("queued", "<i8"), ("since", "<i8"), ("attempts", "<i4")])
#: Rows that are held before they go to the state, and jobs of one value of it.
HELD, PART = 1 << 20, 1 << 16


class Jobs:
    """The jobs of one queue. job_id -> [pass, priority, queued at, running since or -1, attempts]; those that wait are also on a heap of
    their pass, those that run in a set of as many as there are slots, so that a poll costs what it changes and not what waits."""

    def __init__(self, rows: np.ndarray):
        self.of, self.running, self.waiting, self.open = {}, set(), [[] for _ in PASSES], [0] * len(PASSES)
        for job, kind, priority, queued, since, attempts in rows.tolist():
            self.put(job, [kind, priority, queued, since, attempts])

    def put(self, job: int, row: list) -> None:
        self.of[job] = row
        self.open[row[0]] += 1
        if row[3] >= 0:
            self.running.add(job)
        else:
            self.wait(job, row)

    def wait(self, job: int, row: list) -> None:
        heappush(self.waiting[row[0]], (-row[1], row[2], job))

    def end(self, job: int) -> None:
        """Ends a job that runs."""
        self.running.discard(job)
        self.open[self.of.pop(job)[0]] -= 1

    def take(self, rows: np.ndarray) -> None:
        """Rows in order of time: a job is queued once; a beat keeps a running job alive; done ends a running one."""
        of, running = self.of, self.running
        for us, _, job, kind, job_type, priority in rows.tolist():
            if kind == 0:
                if job not in of:
                    self.put(job, [job_type, priority, us, -1, 0])
            elif job in running:
                if kind == 2:
                    self.end(job)
                else:
                    of[job][3] = max(of[job][3], us)

    def poll(self, t: int, stale: int, slots: int, most: int) -> list[tuple[int, str, int]]:
        """Running jobs without a sign of life go back to the queue, or out of it after their last attempt; then free slots are filled
        from the first pass that has jobs, highest priority first, then oldest."""
        for job in [j for j in self.running if self.of[j][3] < t - stale]:
            row = self.of[job]
            if row[4] >= most:
                self.end(job)
            else:
                row[3] = -1
                self.running.discard(job)
                self.wait(job, row)
        first = next((i for i, n in enumerate(self.open) if n), None)
        out = []
        while first is not None and self.waiting[first] and len(self.running) < slots:
            job = heappop(self.waiting[first])[2]
            row = self.of[job]
            row[3], row[4] = t, row[4] + 1
            self.running.add(job)
            out.append((job, PASSES[first], row[4]))
        return out

    def rows(self) -> np.ndarray:
        return np.array([(job, *row) for job, row in self.of.items()], JOB)


class Drain(StatefulProcessor):
    """The drain of one queue. Rows wait until event time has passed them; polls come at whole multiples of a period, so that neither the
    cut of the stream into batches nor a restart changes what starts when.

    arrived: (poll, part) -> rows that no poll has seen yet, as ROW, by the first poll that may see them. parts: how many parts there were.
    jobs: part -> jobs as JOB. So the state is read and written in blocks, and memory holds the rows of one period.
    """

    def __init__(self, period_s: int, stale_s: int, slots: int, most_attempts: int):
        self.period, self.stale, self.slots, self.most = period_s * 1_000_000, stale_s * 1_000_000, slots, most_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "part long", "rows binary")
        self.arrived = handle.getMapState("arrived", "poll long, part long", "rows binary")
        self.parts = handle.getValueState("parts", "n long")
        self.polled = handle.getValueState("polled", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, n, first = [], 0, None
        for frame in rows:
            block = np.empty(len(frame), ROW)
            for name in ROW.names:
                block[name] = frame[name].to_numpy()
            held.append(block)
            n += len(block)
            if n >= HELD:
                first, held, n = self.hold(held, first), [], 0
        if n:
            first = self.hold(held, first)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter([])

    def hold(self, held: list[np.ndarray], first: int | None) -> int:
        """Puts rows into the state, by poll; the first poll of these and those before."""
        rows = np.concatenate(held)
        polls = -(-rows["us"] // self.period) * self.period
        order = np.argsort(polls, kind="stable")
        rows, polls = rows[order], polls[order]
        cuts = np.flatnonzero(np.diff(polls, prepend=polls[0] - 1))
        part = self.parts.get()[0] if self.parts.exists() else 0
        for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            self.arrived.updateValue((int(polls[a]), part), (rows[a:b].tobytes(),))
        self.parts.update((part + 1,))
        return int(polls[0]) if first is None else min(first, int(polls[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All polls that event time has passed, one after the other; then a timer for the next one that has something to do."""
        until = timerValues.getCurrentWatermarkInMs() * 1000
        arrived = sorted(tuple(k) for k in self.arrived.keys())
        stored = [np.frombuffer(bytes(v[0]), JOB) for _, v in self.jobs.iterator()]
        jobs = Jobs(np.concatenate(stored) if stored else np.empty(0, JOB))
        done, out = 0, []
        last = self.polled.get()[0] if self.polled.exists() else None
        due = arrived[0][0] if arrived else None
        t = due if last is None else last + self.period if jobs.of else max(last + self.period, due or 0)
        polled = None
        while (jobs.of or done < len(arrived)) and t < until:
            while done < len(arrived) and arrived[done][0] <= t:
                now = done
                while done < len(arrived) and arrived[done][0] == arrived[now][0]:
                    done += 1
                jobs.take(self.ordered(arrived[now:done]))
            out += [(key[0], t, job, job_type, attempt) for job, job_type, attempt in jobs.poll(t, self.stale, self.slots, self.most)]
            polled = t
            t = t + self.period if jobs.of or done == len(arrived) else max(t + self.period, arrived[done][0])
        for k in arrived[:done]:
            self.arrived.removeKey(k)
        if polled is not None:
            self.polled.update((polled,))
            self.store(jobs.rows(), len(stored))
        if jobs.of or done < len(arrived):
            self.handle.registerTimer(t // 1000)
        yield pd.DataFrame(out, columns=["queue", "poll", "job_id", "job_type", "attempt"]).assign(poll=lambda x: pd.to_datetime(x["poll"], unit="us"))

    def ordered(self, keys: list[tuple[int, int]]) -> np.ndarray:
        """The rows of some parts in order of time."""
        rows = np.concatenate([np.frombuffer(bytes(self.arrived.getValue(k)[0]), ROW) for k in keys])
        return rows[np.lexsort([rows[c] for c in ("priority", "stage", "kind", "job_id", "event_id", "us")])]

    def store(self, rows: np.ndarray, before: int) -> None:
        parts = -(-len(rows) // PART)
        for i in range(parts):
            self.jobs.updateValue((i,), (rows[i * PART : (i + 1) * PART].tobytes(),))
        for i in range(parts, before):
            self.jobs.removeKey((i,))

    def close(self) -> None:
        pass


def starts(events: DataFrame, watermark: str = "10 minutes", period_s: int = 900, stale_s: int = 1800, slots: int = 4, most_attempts: int = 3) -> DataFrame:
    """queue, poll, job_id, job_type, attempt: what the drain of each queue starts, at which poll.

    events: a stream of queue, event_id, ts, job_id, kind (queued, beat or done), job_type and priority. Rows with a null in one of them,
    of another kind or another pass are left out. Polls as far as the watermark has come are out. Needs the state store that
    transformWithState asks for, which is set here.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = ["queue", "event_id", "ts", "job_id", "kind", "job_type", "priority"]
    rows = events.where(F.col("kind").isin(KINDS) & F.col("job_type").isin(PASSES)).dropna(subset=columns)
    place = lambda c, values: (F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1).cast("byte")
    numbers = [place("kind", KINDS).alias("kind"), place("job_type", PASSES).alias("stage"), F.unix_micros("ts").alias("us"), *(F.col(x).cast("long").alias(x) for x in ("event_id", "job_id", "priority"))]
    rows = rows.select(F.col("queue").cast("long"), "ts", *numbers).withWatermark("ts", watermark)
    return rows.groupBy("queue").transformWithStateInPandas(Drain(period_s, stale_s, slots, most_attempts), STARTS, "Append", "EventTime")
