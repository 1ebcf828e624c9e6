"""Structured Streaming jobs. The batch operators are the specification: stateless parts reuse them inside
``foreachBatch``, windowed parts are plain event-time aggregations, the rest keeps small explicit state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import book as ob
from ..operators import flow as fl
from ..operators.joins import latest_positions
from ..operators.warning import warning_states


def event_time(df: DataFrame, ts: str = "ts", *, delay: str) -> DataFrame:
    """Epoch-ms column to an event-time column with a watermark."""
    return df.withColumn("event_time", F.timestamp_millis(ts)).withWatermark("event_time", delay)


def dedupe_fills(fills: DataFrame, key: Sequence[str], *, delay: str) -> DataFrame:
    """Each fill id once, as long as its repeats come within the watermark delay."""
    return event_time(fills, delay=delay).dropDuplicatesWithinWatermark(list(key))


def flow_rate(fills: DataFrame, keys: Sequence[str], *, window: str, slide: str, delay: str) -> DataFrame:
    """Notional per side over a sliding window."""
    usd = F.col("px") * F.col("sz")
    return (event_time(fills, delay=delay).groupBy(F.window("event_time", window, slide).alias("w"), *keys)
            .agg(F.count("*").alias("fills"), F.sum(F.when(F.col("side") == "B", usd).otherwise(0.0)).alias("buy_usd"), F.sum(F.when(F.col("side") == "A", usd).otherwise(0.0)).alias("sell_usd"))
            .select(F.unix_millis("w.start").alias("start_ts"), F.unix_millis("w.end").alias("end_ts"), *keys, "fills", "buy_usd", "sell_usd"))


def tumbling_bars(ticks: DataFrame, keys: Sequence[str], *, step: str, delay: str, tie: str = "event_id") -> DataFrame:
    """OHLC bars; in append mode a bar appears once, when the watermark has closed it."""
    order = F.struct("ts", tie)
    usd = F.col("px") * F.col("sz")
    return (event_time(ticks, delay=delay).groupBy(F.window("event_time", step).alias("w"), *keys)
            .agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("sz").alias("volume"),
                 F.sum(usd).alias("quote_volume"), F.count("*").alias("trades"), F.sum(F.when(F.col("side") == "B", usd).otherwise(0.0)).alias("taker_buy_quote"))
            .select(*keys, F.unix_millis("w.start").alias("ts"), "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_quote"))


def activity_sessions(events: DataFrame, keys: Sequence[str], *, gap: str, delay: str, coin: str) -> DataFrame:
    """Candidate lifetimes: a key lives while sightings are less than ``gap`` apart; first and last sighting and
    coins come out when the session closes."""
    return (event_time(events, delay=delay).groupBy(F.session_window("event_time", gap).alias("w"), *keys)
            .agg(F.min("ts").alias("first_seen_ts"), F.max("ts").alias("last_seen_ts"), F.array_sort(F.collect_set(coin)).alias("coins"), F.count("*").alias("sightings"))
            .drop("w"))


# -- candidate set -------------------------------------------------------------------------------------

CANDIDATE = T.StructType([T.StructField("user", T.LongType()), T.StructField("first_seen_ts", T.LongType()), T.StructField("last_seen_ts", T.LongType()), T.StructField("coins", T.ArrayType(T.StringType()))])
_ENTRY = T.StructType([*CANDIDATE.fields[1:], T.StructField("turn", T.LongType())])


class CandidateProcessor(StatefulProcessor):
    """Least-recently-seen set of at most ``limit`` users per key: a sighting brings its user to the front, users silent for more
    than ``ttl`` leave first, then the one whose last sighting is longest ago. Whoever returns starts a new life.

    The map state holds one entry per member and so at most ``limit`` per key; a batch's sightings of a key are taken in
    the order of their time and number."""

    def __init__(self, limit: int, ttl: int):
        self.limit, self.ttl = limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getMapState("members", T.StructType([T.StructField("user", T.LongType())]), _ENTRY)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        members = {k[0]: list(v) for k, v in sorted(self.members.iterator(), key=lambda e: e[1][3])}  # longest unseen first
        before = set(members)
        turn = max((m[3] for m in members.values()), default=0)
        seen = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for user, ts, coin in zip(seen["user"].astype("int64").tolist(), seen["ts"].astype("int64").tolist(), seen["coin"].tolist()):
            while members and ts - next(iter(members.values()))[1] > self.ttl:
                members.pop(next(iter(members)))
            first, _, coins, _ = members.pop(user, (ts, ts, [], 0))
            turn += 1
            members[user] = [first, ts, sorted({*coins, *([coin] if coin is not None else [])}), turn]
            if len(members) > self.limit:
                members.pop(next(iter(members)))
        for user in before - set(members):
            self.members.removeKey((user,))
        for user, entry in members.items():
            self.members.updateValue((user,), tuple(entry))
        out = [(key[0], turn, user, first, last, coins) for user, (first, last, coins, _) in members.items()]
        yield pd.DataFrame(out, columns=["stream", "turn", *CANDIDATE.names])

    def close(self) -> None:
        pass


def candidate_stream(sightings: DataFrame, *, limit: int, ttl: int) -> DataFrame:
    """Members of each stream's candidate set after every micro-batch; ``sightings``: stream, user, ts, seq, coin. ``turn``
    numbers the sightings taken so far, so the largest one is the latest set. Map state needs the RocksDB state store."""
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = T.StructType([sightings.schema["stream"], T.StructField("turn", T.LongType()), *CANDIDATE.fields])
    return sightings.groupBy("stream").transformWithStateInPandas(CandidateProcessor(limit, ttl), schema, "Append", "None")


def latest_candidates(snapshots: DataFrame) -> DataFrame:
    last = snapshots.groupBy("stream").agg(F.max("turn").alias("turn"))
    return snapshots.join(last, ["stream", "turn"], "left_semi").drop("turn")


# -- order lifecycle --------------------------------------------------------------------------------

LIFECYCLE = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("cum_sz", T.DoubleType()), T.StructField("last_fill_ts", T.LongType())])
_LIVES = {"order_id": T.LongType(), "unnamed": T.BooleanType(), "cum_sz": T.DoubleType(), "last_fill_ts": T.LongType(), "declared_sz": T.DoubleType(), "status": T.StringType(), "deadline": T.LongType()}
_LIFE_STATE = T.StructType([T.StructField(c, T.ArrayType(t)) for c, t in _LIVES.items()])
_LIFE_DTYPES = {"order_id": "int64", "unnamed": "bool", "cum_sz": "float64", "last_fill_ts": "int64", "declared_sz": "float64", "status": "object", "deadline": "int64"}


def order_lifecycle(fills: DataFrame, *, gap_ms: int, delay: str, completed: float = 0.98, buckets: int = 2048) -> DataFrame:
    """Status changes per order: completed at ``completed`` of the declared size, ended_suspected once the
    watermark passes the last fill by ``gap_ms``. ``fills``: order_id, ts, sz, declared_sz.

    Every order's state expires: a completed one after one silent gap, a suspected one after a second gap, until which
    a late fill goes on from the size so far.

    Python is called per bucket of orders (by the hash of their id), not per order: a bucket's state has one array per column,
    with an entry for each order not forgotten, and its timeout is the earliest of their deadlines."""
    ident = ["order_id", "unnamed"]

    def lives(state: GroupState) -> pd.DataFrame:
        columns = state.get if state.exists else [[] for _ in _LIVES]
        return pd.DataFrame({c: pd.Series(list(v), dtype=_LIFE_DTYPES[c]) for c, v in zip(_LIVES, columns)})

    def advance(known: pd.DataFrame, fills: pd.DataFrame, watermark: int) -> pd.DataFrame:
        """The orders with fills: their sums go on, and an order not completed before is open or completed now."""
        new = fills.groupby(ident, as_index=False).agg(add=("sz", "sum"), at=("ts", "max"), told=("declared_sz", "first"))
        d = new.merge(known, on=ident, how="left")
        d["cum_sz"] = d["cum_sz"].fillna(0.0) + d["add"]
        # Whole numbers of 64 bits, which a float would round.
        past = d[ident].merge(known[[*ident, "last_fill_ts"]], on=ident)
        d["last_fill_ts"] = d["at"].astype("int64")
        held = d["status"].notna().to_numpy()
        d.loc[held, "last_fill_ts"] = np.maximum(d.loc[held, "last_fill_ts"].to_numpy(), past["last_fill_ts"].to_numpy())
        d["declared_sz"] = d["told"].fillna(d["declared_sz"])
        was = (d["status"] == "completed").to_numpy()
        full = ((d["declared_sz"] != 0) & (d["cum_sz"] >= d["declared_sz"] * completed)).to_numpy()
        d["change"] = np.where(full & ~was, "completed", None)
        d["status"] = np.where(was | full, "completed", "open")
        d["deadline"] = np.maximum(d["last_fill_ts"] + gap_ms, watermark + 1)
        return d[[*_LIVES, "change"]]

    def expire(known: pd.DataFrame, watermark: int) -> pd.DataFrame:
        """The others: past its deadline an open order is suspected for one more gap, any other is forgotten."""
        d = known.assign(change=None)
        over, opened = (d["deadline"] < watermark).to_numpy(), (d["status"] == "open").to_numpy()
        d = d.astype({"change": "object"})
        d.loc[over & opened, ["change", "status"]] = "ended_suspected"
        d.loc[over & opened, "deadline"] = np.maximum(d.loc[over & opened, "last_fill_ts"] + gap_ms, watermark + gap_ms)
        return d[opened | ~over]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known, parts = lives(state), []
        if not state.hasTimedOut:
            fills = pd.concat(list(batches))
            touched = advance(known, fills, watermark)
            parts.append(touched)
            seen = pd.MultiIndex.from_frame(known[ident]).isin(pd.MultiIndex.from_frame(touched[ident]))
            known = known[~seen]
        parts.append(expire(known, watermark))
        now = pd.concat([p for p in parts if len(p)] or parts[-1:])
        if len(now):
            state.update(tuple(now[c].tolist() for c in _LIVES))
            state.setTimeoutTimestamp(max(int(now["deadline"].min()), watermark + 1))
        else:
            state.remove()
        out = now[now["change"].notna()]
        ids = pd.Series([None if u else i for i, u in zip(out["order_id"], out["unnamed"])], dtype="Int64")
        yield pd.DataFrame({"order_id": ids, "status": out["change"].to_numpy(), "cum_sz": out["cum_sz"].to_numpy(), "last_fill_ts": out["last_fill_ts"].to_numpy()})

    rows = event_time(fills, delay=delay).select("event_time", F.pmod(F.hash("order_id"), F.lit(buckets)).alias("bucket"), F.coalesce("order_id", F.lit(0)).cast("long").alias("order_id"),
                                                 F.col("order_id").isNull().alias("unnamed"), F.coalesce("ts", F.lit(0)).cast("long").alias("ts"),
                                                 F.col("sz").cast("double").alias("sz"), F.col("declared_sz").cast("double").alias("declared_sz"))
    return rows.groupBy("bucket").applyInPandasWithState(step, LIFECYCLE, _LIFE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# -- micro-batch jobs over the batch operators ---------------------------------------------------------

class VersionedTable:
    """A small state table kept as one folder per micro-batch. Writing version n reads version n-1 only, so a
    batch replayed after a failure produces the same folder again."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={version}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")


def _with_latest(known: DataFrame, batch: DataFrame) -> DataFrame:
    """Each user's latest successful read (success or empty); later reads replace it, failures do not."""
    new = batch.where(F.col("status").isin("success", "empty")).select("user", "observed_ts", "attempt_id", "status")
    last = known.unionByName(new).groupBy("user").agg(F.max_by(F.struct("observed_ts", "attempt_id", "status"), F.struct("observed_ts", "attempt_id")).alias("r"))
    return last.select("user", "r.*")


def latest_attempts_sink(table: VersionedTable) -> Callable[[DataFrame, int], None]:
    """Keep each user's latest successful read across batches."""

    def write(batch: DataFrame, version: int) -> None:
        table.write(_with_latest(table.read(version - 1), batch), version)

    return write


def observation_frames_sink(positions: DataFrame, accounts: VersionedTable, frames: VersionedTable, mid: Column, **bins) -> Callable[[DataFrame, int], None]:
    """One frame of bucket totals per micro-batch of account reads, over all accounts known by then, with the change to
    the frame before. The first frame has no change. Positions later than the frame's last read are not seen."""

    def write(batch: DataFrame, version: int) -> None:
        accounts.write(_with_latest(accounts.read(version - 1), batch), version)
        known = accounts.read(version)
        cutoff = batch.agg(F.max("observed_ts")).first()[0]
        seen = positions.where(F.col("ts") <= F.lit(cutoff).cast("long"))
        current = fl.bucket_totals(latest_positions(known, seen), mid, ["coin"], **bins)
        before = frames.read(version - 1).where("count > 0").select("coin", "bucket", F.col("notional").alias("_old"))
        new, old = F.coalesce("notional", F.lit(0.0)), F.coalesce("_old", F.lit(0.0))
        change = F.when(F.lit(version > 0), new - old)
        frame = current.join(before, ["coin", "bucket"], "full").select("coin", "bucket", new.alias("notional"), F.coalesce("count", F.lit(0)).alias("count"), change.alias("change"))
        frames.write(frame, version)

    return write


def wall_sink(last: VersionedTable, episodes: VersionedTable, *, max_gap: int, width: int, ts: str = "received_ms", persist: float = 0.5, approach: float = 20.0, **rule) -> Callable[[DataFrame, int], None]:
    """Wall episodes of each stream as they end, by the batch operator's fold.

    What is carried from batch to batch is one snapshot per stream (its levels' future is not known yet) and one row per open
    episode; neither grows with a wall's life. Each version of ``episodes`` holds the episodes that ended in its batch and,
    with a NULL end_reason, the open ones.
    """
    def write(batch: DataFrame, version: int) -> None:
        books = last.read(version - 1).unionByName(batch.select(*last.schema.names))
        until = books.groupBy("stream").agg(F.max(ts).alias("_until"))
        views = ob.level_views(books, width=width, ts=ts, **rule)
        opened = episodes.read(version - 1).where("end_reason IS NULL")
        episodes.write(ob.fold_walls(views, max_gap=max_gap, persist=persist, approach=approach, opened=opened), version)
        last.write(books.join(until, "stream").where(F.col(ts) == F.col("_until")).select(*last.schema.names), version)

    return write


def warning_sink(history: VersionedTable, out: str, keys: Sequence[str], *, step: int, width: int, need: int, **config) -> Callable[[DataFrame, int], None]:
    """Warning states of new bars: the bounded history and the batch go through the batch operator, the new rows'
    states are appended and the last ``need`` steps per key become the next history."""

    def write(batch: DataFrame, version: int) -> None:
        old = history.read(version - 1).withColumn("_new", F.lit(False))
        bars = old.unionByName(batch.select(*history.schema.names).withColumn("_new", F.lit(True)))
        states = warning_states(bars, keys, step=step, width=width, **config)
        states.where("_new").drop("_new").write.mode("overwrite").parquet(f"{out}/batch={version}")
        end = F.max("ts").over(Window.partitionBy(*keys))  # bounded history plus one batch of bars
        history.write(bars.withColumn("_end", end).where(F.col("ts") > F.col("_end") - need * step).drop("_end", "_new"), version)

    return write


CLOCKS = T.StructType([T.StructField("batch", T.LongType()), T.StructField("cutoff", T.LongType()), T.StructField("high", T.LongType())])


def two_clock_sink(clocks: VersionedTable, out: str, *, delay: int, ts: str = "ts", received: str = "received_ts") -> Callable[[DataFrame, int], None]:
    """Log every row of the batches by two clocks: rows come in the order of receipt, the watermark stands ``delay`` before the
    latest event time of earlier batches. ``status``: on_time (not before that time), late (behind it, inside the
    watermark) or dropped. ``clocks`` keeps one row per batch with its last receipt and the latest event time so far."""

    def write(batch: DataFrame, version: int) -> None:
        past = clocks.read(version - 1)
        high = past.agg(F.max("high")).first()[0]
        event = F.col(ts)
        status = F.when(event >= high, "on_time").when(event >= high - delay, "late").otherwise("dropped") if high is not None else F.lit("on_time")
        batch.select("*", F.lit(version).cast("long").alias("batch"), status.alias("status")).write.mode("overwrite").parquet(f"{out}/part={version}")
        now = batch.agg(F.lit(version).cast("long").alias("batch"), F.max(received).alias("cutoff"), F.greatest(F.max(ts), F.lit(high).cast("long")).alias("high"))
        clocks.write(past.unionByName(now.where("cutoff IS NOT NULL")), version)

    return write


def run_available(stream: DataFrame, *, checkpoint: str, path: str | None = None, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process everything available into Parquet or a micro-batch sink, then stop."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink else w.format("parquet").option("path", path).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
