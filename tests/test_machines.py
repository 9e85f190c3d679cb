"""State machines on streams: restarts, timers, replacement, exhaustion of a bag; SQL twins of their queries."""

import itertools
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shelfspark.plans import state_queries
from shelfspark.session import shared_path
from shelfspark.streaming import events as live
from shelfspark.streaming import machines

from .test_entry import test_against_sql as against_sql

PINS = "user_id long, ts timestamp, event_id long, event string, appid long, replace long, until long"
DRAWS = "user_id long, ts timestamp, event_id long, event string, setup long, roll long"


@pytest.mark.parametrize("name", state_queries.NAMES)
def test_states_against_sql(spark, name):
    against_sql(spark, name)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def land(spark, folder, rows, schema):
    timed = spark.createDataFrame([(r[0], None, *r[1:]) for r in rows], schema)
    timed.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 60)).coalesce(1).write.mode("append").parquet(folder)


def plain_pins(rows):
    out = {}
    for user, _, event, game, other, until in sorted(rows, key=lambda r: r[1]):
        pins, snoozes, current = out.setdefault(user, ([], {}, [None]))
        if event == "drawn":
            current[0] = game
        if event == "pinned" and game not in pins:
            if len(pins) < 3:
                pins.append(game)
            elif other in pins:
                pins[pins.index(other)] = game
        if event == "unpinned" and game in pins:
            pins.remove(game)
        if event == "snoozed":
            snoozes[game] = until
            current[0] = None if current[0] == game else current[0]
        if event == "unsnoozed":
            snoozes.pop(game, None)
    return {u: (p, sorted(s), c[0]) for u, (p, s, c) in out.items()}


def test_pins_go_on_after_a_restart(spark):
    rnd = random.Random(6)
    kinds = ["drawn", "pinned", "pinned", "unpinned", "snoozed", "unsnoozed", "unknown"]
    rows = [(rnd.randrange(5), k, rnd.choice(kinds), rnd.randrange(6), rnd.randrange(6), None) for k in range(400)]
    source, path, checkpoint = (shared_path(spark, name) for name in ("pin-source", "pin-path", "pin-checkpoint"))
    for begin, end in ((0, 150), (150, 290), (290, 400)):
        land(spark, source, rows[begin:end], PINS)
        states = machines.run_machine(stream(spark, source, PINS), machines.PinMachine(), path, checkpoint)
        got = {r.user_id: (r.pins, r.snoozed, r.current) for r in machines.newest(states).collect()}
        assert got == plain_pins(rows[:end])
    again = machines.run_machine(stream(spark, source, PINS), machines.PinMachine(), path, checkpoint)
    assert sorted(map(str, again.collect())) == sorted(map(str, states.collect()))


def test_a_snooze_ends_by_its_timer(spark):
    source, path, checkpoint = (shared_path(spark, name) for name in ("snooze-source", "snooze-path", "snooze-checkpoint"))
    start = 1_700_000_000_000
    land(spark, source, [(1, 0, "drawn", 7, None, None), (1, 1, "snoozed", 7, None, start + 3_600_000), (1, 2, "snoozed", 8, None, None)], PINS)
    states = machines.run_machine(stream(spark, source, PINS), machines.PinMachine(), path, checkpoint, late="1 second")
    assert [(r.snoozed, r.current) for r in machines.newest(states).collect()] == [([7, 8], None)]
    land(spark, source, [(2, 500, "drawn", 1, None, None)], PINS)  # hours later, of another user
    land(spark, source, [(2, 501, "drawn", 2, None, None)], PINS)
    states = machines.run_machine(stream(spark, source, PINS), machines.PinMachine(), path, checkpoint, late="1 second")
    assert {r.user_id: r.snoozed for r in machines.newest(states).collect()} == {1: [8], 2: []}


def draws(spark, requests, pool):
    source = shared_path(spark, "draw-source")
    land(spark, source, requests, DRAWS)
    initial = spark.createDataFrame(pool, "user_id long, appid long, weight long, rank long")
    out = machines.run_machine(stream(spark, source, DRAWS), machines.DrawCycle(), shared_path(spark, "draw-path"), shared_path(spark, "draw-checkpoint"), initial)
    return [r.appid for r in out.orderBy("user_id", "event_id").collect()]


def test_no_game_comes_twice_before_all_have_come(spark):
    rnd = random.Random(1)
    n = 7
    requests = [(1, k, rnd.choice(["draw", "quick", "again"]), None, rnd.randrange(1 << 32)) for k in range(4 * n)]
    got = draws(spark, requests, [(1, g, 1 + g % 3, g) for g in range(n)])
    assert len(got) == 4 * n and all(a != b for a, b in itertools.pairwise(got))
    assert sorted(got[:n]) == list(range(n))  # the first bag; later ones may start with a game that the one before has ended with


def test_one_game_a_new_setup_and_no_games(spark):
    request = lambda user, k, kind, setup=None: (user, k, kind, setup, 0)
    requests = [request(1, k, "draw") for k in range(3)] + [request(9, 5, "quick")]
    requests += [request(2, 10, "setup", 1), request(2, 11, "draw"), request(2, 12, "setup", 1), request(2, 13, "draw"), request(2, 14, "setup", 2), request(2, 15, "draw"), request(2, 16, "again")]
    got = draws(spark, requests, [(1, 5, 1, 1)] + [(2, g, 1, g) for g in (10, 20, 30)])
    # user 2: same setup keeps the bag, another one empties it but the last pick stands out; then 10 goes to the end of the queue
    assert got == [5, 5, 5, 10, 20, 10, 20]


def test_weights_decide_among_finalists():
    assert machines.draw([4, 5, 6], [1, 0, 3], (1 << 30) - 1) == 4 and machines.draw([4, 5, 6], [1, 0, 3], 1 << 30) == 6
    assert machines.draw([4, 5], [0, 0], 7) == 5
    assert [machines.finalists(n) for n in (1, 5, 6, 11, 49, 51, 64)] == [1, 5, 3, 5, 20, 20, 20]


def test_counters_take_late_requests_and_survive_a_restart(spark):
    schema = "bucket string, key string, ts timestamp"
    source, path, checkpoint = (shared_path(spark, name) for name in ("count-source", "count-path", "count-checkpoint"))
    at = lambda *minutes: spark.createDataFrame([("b", "k", m) for m in minutes], "bucket string, key string, m long").select("bucket", "key", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    run = lambda: {r.window_start.minute: (r.n, r.over) for r in live.run_counters(stream(spark, source, schema), path, checkpoint, 2, 600, "1 hour").collect()}
    at(1, 2, 12).coalesce(1).write.parquet(source)
    assert run() == {0: (2, False), 10: (1, False)}
    at(3, 25).coalesce(1).write.mode("append").parquet(source)
    assert run() == {0: (3, True), 10: (1, False), 20: (1, False)}


class Handle:
    """A handle that keeps one value and notes timers."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_user_has_one_timer():
    handle, machine = Handle(), machines.PinMachine()
    machine.init(handle)
    event = Row("ts", "event_id", "event", "appid", "replace", "until")
    snoozes = [event(k, k, "snoozed", k % 4, None, 1000 + 100 * k) for k in range(8)]  # the last four count: 1400 to 1700
    list(machine.handleInputRows((1,), iter(snoozes[::-1]), Clock(0)))
    assert handle.timers == [1400]
    handle.timers.clear()  # the timer fires late
    assert [r.snoozed for r in machine.handleExpiredTimer((1,), Clock(1550), Clock(1400))] == [[2, 3]] and handle.timers == [1600]
    list(machine.handleInputRows((1,), iter([event(9, 9, "unsnoozed", 2, None, None)]), Clock(1550)))
    assert handle.timers == [1700]


def test_a_pool_is_one_row_of_state(spark):
    pool = spark.createDataFrame([(1, 5, 2, 9), (1, 6, 3, 4), (2, 5, 1, 1)], "user_id long, appid long, weight long, rank long")
    assert sorted(map(tuple, machines.DrawCycle.gathered(pool).collect())) == [(1, [6, 5], [3, 2]), (2, [5], [1])]
