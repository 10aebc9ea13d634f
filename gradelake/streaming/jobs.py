"""Streaming scoring, timing, peaks, timelines, completion and the journal sink."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gradelake.operators import scoring
from gradelake.operators.aggregates import millis, timing_columns, token_rate
from gradelake.operators.scale import keep_first
from gradelake.operators.telemetry import TIMELINE_CAP

#: State of the stateful jobs lives in RocksDB, not on the executor heap.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def score_stream(outputs: DataFrame, examples: DataFrame, packs: DataFrame) -> DataFrame:
    """Score outputs as they arrive (X1): a stateless stream-static join."""
    return scoring.score(outputs, examples, packs)


def timing_stream(events: DataFrame, watermark: str, gap: str) -> DataFrame:
    """Timing per generation once it has been quiet for ``gap``.

    ``events(generation_id, at TIMESTAMP)``, append mode. Events later than the
    watermark are dropped.
    """
    sessions = (
        events.withWatermark("at", watermark)
        .groupBy(F.session_window("at", gap), "generation_id")
        .agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"),
             F.count(F.lit(1)).alias("token_count"))
    )
    span = millis(F.col("last_at"), F.col("first_at"))
    return sessions.select(
        "generation_id", "first_at", "last_at", "token_count", span.alias("span_ms"),
        token_rate(F.col("token_count"), span).alias("tokens_per_second"),
    )


def generation_stream(events: DataFrame, watermark: str, gap: str) -> DataFrame:
    """First-token time, rate, wall time and count per generation, once quiet for ``gap`` (X2 with A13).

    ``events(generation_id, at TIMESTAMP, kind)`` with kinds ``start``, ``token`` and ``end`` in one
    stream, append mode. Starts, tokens and ends meet in one session window, so there is one
    shuffle and one state, bounded by the watermark and the gap; what a generation lacks is
    null or zero, as in an outer join.
    """
    def of(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    at = F.col("at")
    sessions = events.withWatermark("at", watermark).groupBy(F.session_window("at", gap), "generation_id").agg(
        F.min(of("start", at)).alias("started_at"), F.max(of("end", at)).alias("finished_at"),
        F.min(of("token", at)).alias("first_at"), F.max(of("token", at)).alias("last_at"),
        F.count(of("token", at)).alias("n"),
    )
    return sessions.select("generation_id", "started_at", "finished_at", *timing_columns())


def peak_stream(samples: DataFrame) -> DataFrame:
    """Running peak per candidate (X3), update or complete mode."""
    return samples.groupBy("candidate_id").agg(
        F.max("used_mib").alias("peak_mib"), F.count("used_mib").alias("n_samples")
    )


def peak_series(samples: DataFrame, watermark: str, width: str = "1 minute") -> DataFrame:
    """Peak per candidate and time window (X3), append mode."""
    return (
        samples.withWatermark("at", watermark)
        .groupBy(F.window("at", width), "candidate_id")
        .agg(F.max("used_mib").alias("peak_mib"))
        .select("candidate_id", F.col("window.start").alias("from"), "peak_mib")
    )


class Timeline(StatefulProcessor):
    """Bounded timeline of one candidate, in time order however its samples arrive.

    Samples wait in the state until the watermark has passed them and no earlier one can
    come; then they are taken in order of time and id. The state holds the waiting samples,
    at most ``cap`` kept ones, the peak and counters. After ``idle_ms`` without a sample
    the timeline is closed: it is emitted and its state goes.
    """

    schema = (
        "candidate_id bigint, kept array<struct<at:timestamp,used_mib:double>>, "
        "peak_mib double, sample_total bigint"
    )

    def __init__(self, cap: int = TIMELINE_CAP, idle_ms: int = 60_000) -> None:
        self.cap, self.idle_ms = max(2, cap), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, sample_id bigint, used_mib double")
        self.kept = handle.getListState("kept", "at bigint, used_mib double")
        self.totals = handle.getValueState("totals", "peak double, n bigint, last_at bigint")
        self.timers = handle.getValueState("timers", "take bigint, close bigint")

    def _wake(self, take: int, close: int) -> None:
        """When the earliest waiting sample can be taken, and when silence closes the timeline."""
        old = self.timers.get() if self.timers.exists() else (0, 0)
        for before, now in zip(old, (take, close)):
            if before != now:
                if before:
                    self.handle.deleteTimer(before)
        for now in {take, close} - {0}:
            self.handle.registerTimer(now)
        self.timers.update((take, close))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        take, close = self.timers.get() if self.timers.exists() else (0, 0)
        for batch in rows:
            at = batch["at"].to_numpy("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), batch["sample_id"].tolist(), batch["used_mib"].tolist())))
            first, last = int(at.min()) // 1000, -(-int(at.max()) // 1000)
            take, close = min(take or first, first), max(close, last + self.idle_ms)
        self._wake(max(take, 1), close)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        samples = sorted(tuple(row) for row in self.waiting.get()) if self.waiting.exists() else []
        ready = bisect_right(samples, passed * 1000, key=lambda s: s[0])
        kept = [tuple(row) for row in self.kept.get()] if self.kept.exists() else []
        peak, n, last_at = self.totals.get() if self.totals.exists() else (float("-inf"), 0, 0)
        closed = []
        start = 0
        for end in range(1, ready + 1):
            # A stretch without silence is taken as a whole.
            if end < ready and samples[end][0] - samples[end - 1][0] <= self.idle_ms * 1000:
                continue
            part = samples[start:end]
            if n and part[0][0] - last_at > self.idle_ms * 1000:
                closed.append((kept, peak, n))
                kept, peak, n = [], float("-inf"), 0
            kept = halved(kept, [(at, used) for at, _, used in part], self.cap)
            peak, n, last_at = max(peak, max(s[2] for s in part)), n + len(part), part[-1][0]
            start = end
        rest = samples[ready:]
        if n and -(-last_at // 1000) + self.idle_ms <= passed:
            closed.append((kept, peak, n))
            kept, peak, n = [], float("-inf"), 0
        if not n and not rest:
            for state in (self.waiting, self.kept, self.totals, self.timers):
                state.clear()
        else:
            for state, rows in ((self.waiting, rest), (self.kept, kept)):
                if rows:
                    state.put(rows)
                else:
                    state.clear()
            self.totals.update((peak, n, last_at))
            newest = rest[-1][0] if rest else last_at
            self._wake(max(rest[0][0] // 1000, 1) if rest else 0, -(-newest // 1000) + self.idle_ms)
        if closed:
            yield pd.DataFrame({
                "candidate_id": [key[0]] * len(closed),
                "kept": [[{"at": pd.Timestamp(at, unit="us"), "used_mib": used} for at, used in k] for k, _, _ in closed],
                "peak_mib": [peak for _, peak, _ in closed], "sample_total": [n for _, _, n in closed],
            })

    def close(self) -> None:
        pass


def halved(kept: list, more: list, cap: int) -> list:
    """``kept`` after ``more`` is appended; whenever it reaches ``cap``, every second entry goes."""
    while len(kept) + len(more) >= cap:
        room = cap - len(kept)
        kept, more = (kept + more[:room])[::2], more[room:]
    return kept + more


def timeline_stream(
    samples: DataFrame, cap: int = TIMELINE_CAP, watermark: str = "10 seconds", idle_ms: int = 60_000
) -> DataFrame:
    """Timeline of every candidate once it has been quiet for ``idle_ms`` of event time, append mode.

    ``samples(candidate_id, at, used_mib, sample_id)``. Samples may come in any order within the
    watermark, later ones are dropped; the result does not depend on how they were cut into
    batches. Samples without a value are skipped. A candidate that goes on after a
    silence starts a new timeline.
    """
    return (
        samples.filter(F.col("used_mib").isNotNull()).withWatermark("at", watermark).groupBy("candidate_id")
        .transformWithStateInPandas(
            statefulProcessor=Timeline(cap, idle_ms), outputStructType=Timeline.schema,
            outputMode="append", timeMode="EventTime",
        )
    )


class Completion(StatefulProcessor):
    """Closes a generation on its done or error line, or by timeout.

    What is closed is remembered for ``keep_closed_ms`` of event time, so that lines that
    follow do not open it again; then a timer clears its state.
    """

    schema = (
        "generation_id bigint, status string, done_reason string, failure_reason string, "
        "oom_suspect boolean, token_count bigint"
    )
    no_done = "generation stream ended without a done line"

    def __init__(self, timeout_ms: int, keep_closed_ms: int) -> None:
        self.timeout_ms, self.keep_closed_ms = timeout_ms, keep_closed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "tokens bigint, closed boolean, deadline bigint")

    def _close(self, tokens: int, at: int) -> None:
        forget = at + self.keep_closed_ms
        self.seen.update((tokens, True, forget))
        self.handle.registerTimer(forget)

    def _row(self, key, status, done_reason, failure, oom, tokens) -> pd.DataFrame:
        return pd.DataFrame({
            "generation_id": [key[0]], "status": [status], "done_reason": [done_reason],
            "failure_reason": [failure], "oom_suspect": [oom], "token_count": [tokens],
        })

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tokens, closed, deadline = (
            self.seen.get() if self.seen.exists() else (0, False, 0)
        )
        if closed:
            return
        if deadline:
            self.handle.deleteTimer(deadline)
        newest = 0
        for batch in rows:
            batch = batch.sort_values(["at", "seq"])
            newest = max(newest, int(batch["at"].max().timestamp() * 1000))
            ends = batch["kind"].isin(["done", "error"]).to_numpy()
            stop = int(ends.argmax()) if ends.any() else len(batch)
            tokens += int((batch["kind"].iloc[:stop] == "token").sum())
            if stop < len(batch):
                last = batch.iloc[stop]
                self._close(tokens, newest)
                if last["kind"] == "done":
                    yield self._row(key, "completed", last["done_reason"], None, False, tokens)
                else:
                    yield self._row(
                        key, "failed", None, last["message"], bool(last["oom_suspect"]), tokens
                    )
                return
        deadline = newest + self.timeout_ms
        self.seen.update((tokens, False, deadline))
        self.handle.registerTimer(deadline)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.seen.exists():
            return
        tokens, closed, deadline = self.seen.get()
        if closed:
            self.seen.clear()
            return
        self._close(tokens, deadline)
        yield self._row(key, "failed", None, self.no_done, True, tokens)

    def close(self) -> None:
        pass


def completion_stream(
    events: DataFrame, watermark: str, timeout_ms: int, keep_closed_ms: int = 86_400_000
) -> DataFrame:
    """Outcome of each generation (X6), append mode.

    ``events(generation_id, seq, at, kind, done_reason, message, oom_suspect)``.
    Without a done line for ``timeout_ms`` of event time it failed, and may have
    run out of memory. Lines of a closed generation are ignored for ``keep_closed_ms``;
    an id that comes back later is a new generation.
    """
    return (
        events.withWatermark("at", watermark)
        .groupBy("generation_id")
        .transformWithStateInPandas(
            statefulProcessor=Completion(timeout_ms, keep_closed_ms), outputStructType=Completion.schema,
            outputMode="append", timeMode="EventTime",
        )
    )


def completion_batch(events: DataFrame) -> DataFrame:
    """The same outcome over a finished log, as plain aggregates."""
    # Conditions stay inside the aggregates: a filter would be pushed below the
    # parsing and parse every line twice.
    place = F.when(F.col("kind").isin("done", "error"), F.struct("at", "seq"))
    first = F.min_by(
        F.struct("kind", "done_reason", "message", "oom_suspect", "at", "seq"), place
    )
    ends = events.groupBy("generation_id").agg(first.alias("end"))
    before = F.col("end").isNull() | (
        F.struct("at", "seq") < F.struct(F.col("end.at"), F.col("end.seq"))
    )
    counted = events.join(ends, "generation_id", "left").groupBy("generation_id").agg(
        F.count_if((F.col("kind") == "token") & before).alias("token_count")
    )
    done = F.coalesce(F.col("end.kind") == "done", F.lit(False))
    return counted.join(ends, "generation_id", "left").select(
        "generation_id",
        F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(done, F.col("end.done_reason")).alias("done_reason"),
        F.when(~done, F.coalesce("end.message", F.lit(Completion.no_done))).alias(
            "failure_reason"
        ),
        F.when(done, False).when(F.col("end").isNull(), True)
        .otherwise(F.col("end.oom_suspect")).alias("oom_suspect"),
        "token_count",
    )


def journal_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every unit of a run once (X5): a repeated batch replaces its own folder.

    Of different rows for one unit in one batch the same one is taken every time.
    """
    from gradelake.sources.journal import append_results

    def write(batch: DataFrame, batch_id: int) -> None:
        tie = F.xxhash64(F.to_json(F.struct(*batch.columns)))
        first = keep_first(batch.withColumn("_tie", tie), ["run_id", "unit_id"], ["_tie"])
        append_results(first.drop("_tie"), path, batch_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
