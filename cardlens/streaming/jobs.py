"""Near-real-time metrics on Structured Streaming.

Streams come from a folder of files; event time is a column of type timestamp (files without a zone are cast). Each job
keeps its state bounded by a watermark and its progress in a checkpoint folder given by the caller.
"""
from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cardlens.functions.scalars import bool_to_flag, clean_mcc, parse_date_multi, ratio, to_int, to_money


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None,
                fmt: str = "parquet", **options: str) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append", keyed_state: bool = False) -> StreamingQuery:
    """Write the stream to Parquet until the present input is used up; ``keyed_state`` keeps its state in RocksDB."""
    conf = df.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    if keyed_state:
        conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if keyed_state:
            conf.set(STATE_STORE, before) if before else conf.unset(STATE_STORE)
    return query


def minute_metrics_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Per minute: count, volume, mean, cards (approximate, as streams need), fraud and maximum. A minute is emitted once
    the watermark has passed it."""
    fraud = F.count_if(F.col("is_fraud") == 1)
    minutes = events.withWatermark("event_time", late).groupBy(F.window("event_time", "1 minute").alias("w")).agg(
        F.count("*").alias("transactions_per_minute"), F.sum("amount").alias("volume_per_minute"),
        F.approx_count_distinct("card").alias("unique_cards"), fraud.alias("fraud_count"), F.max("amount").alias("max_amount"))
    return minutes.select(F.col("w.start").alias("minute"), "transactions_per_minute", "volume_per_minute",
                          ratio(F.col("volume_per_minute"), F.col("transactions_per_minute")).alias("avg_amount"),
                          "unique_cards", "fraud_count", "max_amount")


STATE_PARTS = 1000  # groups of cards; each keeps its cards' counts as one list


class CardCounts(StatefulProcessor):
    """Per group of cards a list of (card, at, n): events of a card counted by a unit of time. A list is read and written as a
    whole and one timer a group stands for the next thing to judge, so the calls of the state store grow neither with cards nor
    with events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "card string, at bigint, n bigint")
        self.judged = handle.getValueState("judged", "before bigint")

    def held(self) -> pd.DataFrame:
        """Counts in order of card and unit."""
        return _by_unit(pd.DataFrame(list(self.counts.get()), columns=["card", "at", "n"]))

    def keep(self, held: pd.DataFrame) -> None:
        if len(held):
            self.counts.put(_state_rows(held))
        else:
            self.counts.clear()

    def close(self) -> None:
        pass


def _state_rows(held: pd.DataFrame) -> list[tuple]:
    return list(zip(held["card"].tolist(), held["at"].tolist(), held["n"].tolist()))


def _by_unit(counts: pd.DataFrame) -> pd.DataFrame:
    """One row per card (``_c`` is its number) and unit, in order."""
    code, cards = pd.factorize(counts["card"].astype(object), use_na_sentinel=False)
    sums = pd.DataFrame({"_c": code, "at": counts["at"].astype("int64"), "n": counts["n"].astype("int64")}).groupby(["_c", "at"], as_index=False)["n"].sum()
    return sums.assign(card=pd.Series([None if c != c else c for c in cards], dtype=object).take(sums["_c"]).to_numpy())


def _arrived(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a batch as counts."""
    parts = [_by_unit(frame[["card", "at"]].dropna(subset=["at"]).assign(n=1)) for frame in rows]
    return _by_unit(pd.concat(parts, ignore_index=True))


class SlidingCounts(CardCounts):
    """Windows of a card with more events than the limit, told once the watermark has reached their end.

    Events are counted by the greatest unit that divides span and slide. A window that the watermark of a batch has reached is
    closed: rows of that batch no longer count in it.
    """

    def __init__(self, limit: int, span: int, slide: int):
        self.unit = math.gcd(span, slide)
        self.limit, self.span, self.slide = limit, span // self.unit, slide // self.unit

    def windows(self, held: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of a card, end and events of every window with events."""
        at, code = held["at"].to_numpy(), held["_c"].to_numpy()
        ends = at[:, None] // self.slide * self.slide + self.span - np.arange(-(-self.span // self.slide)) * self.slide
        row, place = np.nonzero(ends > at[:, None])
        low = at.min() - self.span
        stride = at.max() + self.span + 1 - low  # one line of time for each card, one after the other
        line, close = code * stride + at - low, np.unique(code[row] * stride + ends[row, place] - low)
        total = np.r_[0, np.cumsum(held["n"].to_numpy())]
        found = total[np.searchsorted(line, close)] - total[np.searchsorted(line, close - self.span)]
        return np.searchsorted(code, close // stride), close % stride + low, found

    def _step(self, now: int, came: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Tell what has closed by now, then add what came."""
        held = self.held()
        known = self.judged.get()
        if len(held):
            row, ends, found = self.windows(held)
            tell = (ends * self.unit <= now) & (found > self.limit)
            if known:
                tell &= ends * self.unit > known[0]
            if tell.any():
                yield pd.DataFrame({"card": held["card"].to_numpy()[row[tell]], "window_end": ends[tell] * self.unit, "n": found[tell]})
        held = _by_unit(pd.concat([held, came], ignore_index=True))
        held = _by_unit(held[(held["at"] // self.slide * self.slide + self.span) * self.unit > now])
        self.keep(held)
        if len(held):
            self.judged.update((now,))
            _, ends, found = self.windows(held)
            due = ends[(ends * self.unit > now) & (found > self.limit)]
            # The next window to tell, else the end of all: what is over need not be kept.
            self.handle.registerTimer(-(-int(due.min() if len(due) else ends.max()) * self.unit // 1000) - 1)
        else:
            self.judged.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step(timerValues.getCurrentWatermarkInMs() * 1000, _arrived(rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(timerValues.getCurrentWatermarkInMs() * 1000, pd.DataFrame({"card": [], "at": [], "n": []}))


def _by_card_group(counted: DataFrame, processor: CardCounts, card: str, told: str) -> DataFrame:
    """What the processor tells; cards travel as text, so that whole numbers beside NULL stay exact."""
    part = F.pmod(F.xxhash64("card"), F.lit(STATE_PARTS)).alias("part")
    grouped = counted.select(part, F.col("card").cast("string").alias("card"), *[c for c in counted.columns if c != "card"]).groupBy("part")
    found = grouped.transformWithStateInPandas(processor, outputStructType=f"card string, {told}", outputMode="append", timeMode="eventTime")
    return found.withColumn("card", F.col("card").cast(card))


def velocity_alerts_stream(events: DataFrame, limit: int = 10, span: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Cards above the limit in a sliding window.

    The state holds a card's events per slide, not per window, and only windows above the limit leave it. The stream needs the
    RocksDB state store (``run_to_end(..., keyed_state=True)``).
    """
    long, step = (int(pd.Timedelta(x) / pd.Timedelta(microseconds=1)) for x in (span, slide))
    unit, micros = math.gcd(long, step), F.unix_micros("event_time")
    # Without the event time itself, by which late rows would be dropped that still count in open windows.
    counted = events.withWatermark("event_time", late).where("event_time IS NOT NULL").select(
        "card", ((micros - F.pmod(micros, F.lit(unit))) / unit).cast("bigint").alias("at"))
    found = _by_card_group(counted, SlidingCounts(limit, long, step), dict(events.dtypes)["card"], "window_end bigint, n bigint")
    return found.select("card", F.timestamp_micros(F.col("window_end") - long).alias("window_start"), F.timestamp_micros("window_end").alias("window_end"), "n")


class TrailingCounts(CardCounts):
    """Per card the events of each second of the last span; a timer at the end of a minute judges all seconds of the minutes
    that the watermark has passed.

    The state of a card holds one count per second of a span, of the lateness and of the minutes still open, however many
    events there are; counts of the same second from several batches are added up when they are judged.
    """

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = _arrived(rows)
        if len(came):
            self.counts.appendList(_state_rows(came))
            self.handle.registerTimer(int(came["at"].min() // 60 + 1) * 60_000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = (timerValues.getCurrentWatermarkInMs() - 1) // 60_000 * 60
        before = self.judged.get()
        if before and before[0] >= upto:  # an earlier timer of the batch has judged it
            return
        held = self.held()
        second, n = held["at"].to_numpy(), held["n"].to_numpy()
        if not len(held):
            return
        line = held["_c"].to_numpy() * (second.max() - second.min() + self.span + 1) + second - second.min()
        total = np.r_[0, np.cumsum(n)]
        trailing = total[1:] - total[np.searchsorted(line, line - self.span)]
        tell = (second < upto) & (trailing > self.limit)
        if before:
            tell &= second >= before[0]
        self.judged.update((upto,))
        self.keep(held[second >= upto - self.span])
        ahead = second[second >= upto]
        if len(ahead):
            self.handle.registerTimer(int(ahead.min() // 60 + 1) * 60_000)
        if tell.any():
            yield pd.DataFrame({"card": held["card"].to_numpy()[tell], "event_time": pd.to_datetime(second[tell], unit="s"), "events": n[tell], "velocity_count": trailing[tell]})


def trailing_velocity_stream(events: DataFrame, limit: int = 10, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Alerts (card, event_time, events, velocity_count) for each second in which a card's events of the trailing span, both
    ends included, exceed the limit: the batch rule, for events in any order within the watermark.

    A second is judged once the watermark has passed its minute. The stream needs the RocksDB state store
    (``run_to_end(..., keyed_state=True)``).
    """
    per_second = events.withWatermark("event_time", late).select("card", "event_time", F.unix_timestamp("event_time").alias("at"))
    return _by_card_group(per_second, TrailingCounts(limit, seconds), dict(events.dtypes)["card"], "event_time timestamp, events bigint, velocity_count bigint")


# ---- daily totals ----------------------------------------------------------------------------------------------
#
# A folder of totals consists of data folders and of manifests. A data folder counts only once a manifest names it. A
# manifest is written under another name and renamed, so it is there whole or not at all. Batches are known by their
# stream (its checkpoint folder) and number; a base holds the sums of all batches up to a number of each stream.


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def _commit(spark: SparkSession, path: str, name: str, entry: dict) -> None:
    files, folder = _file_system(spark, f"{path}/manifests")
    files.mkdirs(folder)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/.{name}.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{name}")
    if not files.rename(draft, final):  # someone else has committed the same batch
        files.delete(draft, False)


def _manifests(spark: SparkSession, path: str) -> dict[str, dict]:
    """Committed entries by name."""
    files, folder = _file_system(spark, f"{path}/manifests")
    if not files.exists(folder):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    found = {}
    for name in names:
        if not name.startswith("."):
            stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{name}"))
            found[name] = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
    return found


def _current(manifests: dict[str, dict]) -> tuple[dict | None, dict[str, dict]]:
    """The newest base and the batches that it does not hold."""
    bases = [m for m in manifests.values() if m["kind"] == "base"]
    base = max(bases, key=lambda m: m["number"], default=None)
    upto = base["upto"] if base else {}
    return base, {n: m for n, m in manifests.items() if m["kind"] == "batch" and m["batch"] > upto.get(m["stream"], -1)}


def daily_rollup_stream(txn: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sum and count per day and code, kept current as rows arrive.

    Each batch writes its own partial sums and then its manifest; the stream keeps no state, so rows of any age count. A
    batch that is run again after its manifest is left out, one that is run again before it writes a new folder, so no stop
    doubles or loses a total. ``daily_rollup`` adds the parts up; ``compact_rollup`` folds them into one between batches.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def save(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"batch-{stream}-{number}"
        manifests = _manifests(spark, path)
        base, _ = _current(manifests)
        if name in manifests or (base and number <= base["upto"].get(stream, -1)):
            return
        folder = f"{path}/data/{name}-{uuid.uuid4().hex}"
        batch.groupBy(F.col("event_time").cast("date").alias("transaction_date"), "mcc").agg(
            F.sum("amount").alias("total_amount"), F.count("*").alias("transaction_count")).write.parquet(folder)
        _commit(spark, path, name, {"kind": "batch", "stream": stream, "batch": number, "folder": folder})

    query = txn.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _summed(spark: SparkSession, folders: list[str]) -> DataFrame:
    parts = [spark.read.parquet(f) for f in folders]
    return reduce(DataFrame.unionByName, parts).groupBy("transaction_date", "mcc").agg(
        F.sum("total_amount").alias("total_amount"), F.sum("transaction_count").alias("transaction_count"))


def compact_rollup(spark: SparkSession, path: str) -> None:
    """Fold all committed parts into one base, then delete what it holds and what was never committed.

    The base counts from its manifest on. A stop before it leaves the parts, one after it leaves parts that the base
    outdates; both read alike, and the next call cleans up. Not to be run while a batch is written.
    """
    base, batches = _current(_manifests(spark, path))
    if batches:
        folders = [m["folder"] for m in batches.values()] + ([base["folder"]] if base else [])
        upto = dict(base["upto"]) if base else {}
        for m in batches.values():
            upto[m["stream"]] = max(m["batch"], upto.get(m["stream"], -1))
        number = base["number"] + 1 if base else 0
        folder = f"{path}/data/base-{number}-{uuid.uuid4().hex}"
        _summed(spark, folders).write.parquet(folder)
        _commit(spark, path, f"base-{number}", {"kind": "base", "number": number, "upto": upto, "folder": folder})
    manifests = _manifests(spark, path)
    base, batches = _current(manifests)
    keep = {m["folder"].rpartition("/")[2] for m in [*batches.values(), *([base] if base else [])]}
    for name, m in manifests.items():
        if m["folder"].rpartition("/")[2] not in keep:
            _delete(spark, f"{path}/manifests/{name}")
    files, folder = _file_system(spark, f"{path}/data")
    for status in files.listStatus(folder) if files.exists(folder) else []:
        if status.getPath().getName() not in keep:
            files.delete(status.getPath(), True)


def daily_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Totals per day and code with the mean from them, from all committed parts; an error before the first one."""
    base, batches = _current(_manifests(spark, path))
    folders = [m["folder"] for m in batches.values()] + ([base["folder"]] if base else [])
    if not folders:
        raise FileNotFoundError(f"no batch has been committed in {path}")
    return _summed(spark, folders).select("transaction_date", "mcc", "total_amount", "transaction_count",
                                          ratio(F.col("total_amount"), F.col("transaction_count")).alias("avg_amount"))


def ingest_stream(raw: DataFrame, key: str = "transaction_id", late: str = "7 days", time_col: str = "ingest_time") -> DataFrame:
    """Arriving text rows as typed rows, one per transaction id within the watermark."""
    parsers = {"amount_uzs": to_money("amount_uzs"), "mcc": clean_mcc("mcc"), "hour_num": to_int("hour_num", None),
               "p2p_flag": bool_to_flag("p2p_flag"), "transaction_date": parse_date_multi("transaction_date", None)}
    typed = raw.withColumns({n: c for n, c in parsers.items() if n in raw.columns})
    if time_col not in typed.columns:
        typed = typed.withColumn(time_col, F.current_timestamp())
    return typed.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
