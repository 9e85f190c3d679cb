"""State machines per user on Structured Streaming: pins and snoozes, draws without repeats.

The state of a user lives in the state store, so a batch touches only users with events or timers in it, and a query that
starts again from its checkpoint goes on where it stopped.  Within a batch a user's events are folded by time and
number; batches come in the order of the source.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX_PINS, DECK = 3, 64
#: The store that keeps keyed state and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: Iterator[Row]) -> list[Row]:
    """The events of a user in a batch by time and number; the source's batches bound them."""
    return sorted(rows, key=lambda r: (r.ts is None, r.ts or 0, r.event_id is None, r.event_id or 0))


class PinMachine(StatefulProcessor):
    """Events ``drawn``, ``pinned``, ``unpinned``, ``snoozed`` and ``unsnoozed`` of a game; others change nothing.

    At most MAX_PINS games are pinned.  Pinning again changes nothing; a further game takes the place of ``replace`` if that is pinned.
    A snooze ends with ``unsnoozed`` or at ``until`` (milliseconds, null: never), when a timer fires; snoozing the current pick
    clears it.  A user has one timer, for the snooze that ends first; it ends all that the watermark has passed.
    """

    SCHEMA = "user_id long, step long, pins array<long>, snoozed array<long>, until array<long>, current long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.vault = handle.getValueState("vault", "step long, pins array<long>, snoozed array<long>, until array<long>, current long, timer long")

    def _read(self) -> tuple[int, list, dict, int | None, int | None]:
        held = self.vault.get()
        if held is None:
            return 0, [], {}, None, None
        step, pins, snoozed, until, current, timer = held
        return step, list(pins), dict(zip(snoozed, until, strict=True)), current, timer

    def _write(self, key, step: int, pins: list, snoozes: dict, current, timer: int | None, watermark: int) -> Row:
        """``timer`` is the one that is set, if any."""
        first = min((max(until, watermark + 1) for until in snoozes.values() if until is not None), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        games = sorted(snoozes)
        state = (step + 1, pins, games, [snoozes[g] for g in games], current)
        self.vault.update((*state, first))
        return Row("user_id", "step", "pins", "snoozed", "until", "current")(key[0], *state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        step, pins, snoozes, current, timer = self._read()
        for row in in_order(rows):
            event, game, other = row.event, row.appid, row.replace
            if event == "drawn":
                current = game
            elif event == "pinned" and game not in pins:
                if len(pins) < MAX_PINS:
                    pins.append(game)
                elif other in pins:
                    pins[pins.index(other)] = game
            elif event == "unpinned":
                pins = [p for p in pins if p != game]
            elif event == "snoozed":
                snoozes[game] = row.until
                current = None if current == game else current
            elif event == "unsnoozed":
                snoozes.pop(game, None)
        yield self._write(key, step, pins, snoozes, current, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        step, pins, snoozes, current, timer = self._read()
        watermark = timerValues.getCurrentWatermarkInMs()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), watermark)
        left = {game: until for game, until in snoozes.items() if until is None or until > now}
        yield self._write(key, step, pins, left, current, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, watermark)

    def close(self) -> None:
        pass


class DrawCycle(StatefulProcessor):
    """Draws that repeat no game until all have come up: a shuffle bag for each user.

    Requests: ``setup`` (another value empties the bag and the queue), ``draw``, ``again`` (the current pick goes to the end of the
    queue of deferred games first) and ``quick``.  Each draws from the deck without the games of the bag; if
    none is left, the bag is emptied.  The previous pick stands out unless it is alone.  ``roll`` is uniform in [0, 2^32): ``quick`` takes
    all games alike, the others the finalists by weight.
    """

    SCHEMA = "user_id long, event_id long, appid long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cycle = handle.getValueState("cycle", "setup long, bag array<long>, deferred array<long>, current long")
        self.pool = handle.getValueState("pool", "games array<long>, weights array<long>")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.pool.update((list(initialState.games), list(initialState.weights)))

    @staticmethod
    def gathered(pool: DataFrame) -> DataFrame:
        """Games and weights of each user by ``rank``, as the state takes them."""
        ranked = F.array_sort(F.collect_list(F.struct("rank", "appid", "weight")))
        return pool.groupBy("user_id").agg(ranked.alias("_r")).select("user_id", F.col("_r.appid").alias("games"), F.col("_r.weight").alias("weights"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        games, weights = self.pool.get() or ([], [])
        weight = dict(zip(games, weights, strict=True))
        held = self.cycle.get()
        setup, bag, deferred, current = held if held is not None else (None, [], [], None)
        bag, deferred, done = list(bag), list(deferred), Row("user_id", "event_id", "appid")
        for row in in_order(rows):
            event, wanted, roll = row.event, row.setup, row.roll
            if event == "setup":
                if wanted != setup:
                    setup, bag, deferred = wanted, [], []
                continue
            if event == "again" and current in weight:
                deferred = [g for g in deferred if g != current] + [current]
            later = set(deferred)
            deck = games if event == "quick" else ([g for g in games if g not in later] + [g for g in deferred if g in weight])[:DECK]
            seen = set(bag)
            left = [g for g in deck if g not in seen]
            if not left:
                bag, left = [], deck
            if len(left) > 1:
                left = [g for g in left if g != current]
            if not left:
                continue
            current = draw(left, [1] * len(left), roll) if event == "quick" else draw(final := left[: finalists(len(left))], [weight[g] for g in final], roll)
            bag.append(current)
            yield done(key[0], row.event_id, current)
        self.cycle.update((setup, bag, deferred, current))

    def close(self) -> None:
        pass


def finalists(n: int) -> int:
    """All of up to five; else 40 percent, between 3 and 20."""
    return n if n <= 5 else min(20, max(3, -(-2 * n // 5)))


def draw(games: list[int], weights: list[int], roll: int) -> int:
    """The first game where the running weight exceeds the share ``roll`` / 2^32 of their sum; the last one without weights."""
    total, upto = sum(weights), 0
    for game, weight in zip(games, weights, strict=True):
        upto += weight
        if upto << 32 > int(roll) * total:
            return game
    return games[-1]


def run_machine(stream: DataFrame, machine: StatefulProcessor, path: str, checkpoint: str, initial: DataFrame | None = None, late: str = "1 day") -> DataFrame:
    """Run ``machine`` per ``user_id`` over what the stream has and return all rows it has ever given below ``path``.

    ``ts`` is the event time; events later than ``late`` are left out.  Each batch writes its own folder, again if it is repeated.  Starting again
    with the same ``path`` and ``checkpoint`` takes up the state where it was.
    """
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    keyed = stream.withWatermark("ts", late).groupBy("user_id")
    start = {} if initial is None else {"initialState": machine.gathered(initial).groupBy("user_id")}
    out = keyed.transformWithState(statefulProcessor=machine, outputStructType=machine.SCHEMA, outputMode="Update", timeMode="EventTime", **start)
    spark.createDataFrame([], machine.SCHEMA).write.mode("append").parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    try:
        query = out.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(machine.SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def newest(states: DataFrame) -> DataFrame:
    """The last state of each user of a :class:`PinMachine`."""
    rest = [c for c in states.columns if c not in ("user_id", "step")]
    last = states.groupBy("user_id").agg(F.max_by(F.struct(*rest), "step").alias("last"))
    return last.select("user_id", "last.*")


def snoozed_at(now: Column) -> Column:
    """The games of ``snoozed`` whose snooze has not ended at ``now`` (milliseconds)."""
    pairs = F.filter(F.arrays_zip("snoozed", "until"), lambda s: s["until"].isNull() | (s["until"] > now))
    return F.transform(pairs, lambda s: s["snoozed"])
