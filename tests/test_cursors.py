"""Consumption state: the stream against the batch and against a plain walk, over restarts and odd operations."""

import collections
import datetime as dt
import random

from claimloom.streaming import cursors

START = dt.datetime(2024, 3, 1)


def walk(rows):
    """One list per key, walked in order."""
    out, state = [], {}
    for key, ts, i, op in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        s = state.setdefault(key, {"version": 0, "n": 0, "gone": False})
        at, outcome = None, op
        if op == "define":
            s |= {"version": s["version"] + 1, "n": 0, "gone": False}
        elif op == "reset":
            s["n"] = 0
        elif op not in ("advance", "consume"):
            outcome = "refused:unknown"
        elif not s["version"]:
            outcome = "refused:undefined"
        elif s["gone"]:
            outcome = "refused:consumed"
        else:
            at, s["n"], s["gone"] = s["n"], s["n"] + 1, op == "consume"
        alias = None if at is None else f"@adv{at}" if at else f"@def{s['version']}"
        out.append((key, i, s["version"], at, alias, outcome))
    return collections.Counter(out)


def made(n, seed):
    rng = random.Random(seed)
    ops = ["define", "advance", "advance", "advance", "consume", "reset", "other", None]
    return [(rng.choice("abcde") if i % 3 else "hot", START + dt.timedelta(seconds=rng.randrange(0, 50_000)), i, rng.choice(ops)) for i in range(n)]


SCHEMA = "key string, ts timestamp, id long, op string"


def answer(df):
    return collections.Counter((r.key, r.id, r.version, r.occurrence, r.alias, r.outcome) for r in df.collect())


def test_batch(spark):
    rows = made(800, 1) + [(None, START, 5000, "define"), (None, START, 5001, "advance")]
    assert answer(cursors.batch(spark.createDataFrame(rows, SCHEMA))) == walk(rows)
    assert cursors.batch(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_over_restarts(spark, tmp_path):
    """Rows of one key spread over three runs, out of order within the delay; nothing comes out before its time, and all once."""
    rows = made(600, 2)
    runs = [[], [], []]
    for r in rows:  # up to a run late
        k = min(2, int((r[1] - START).total_seconds() // 17_000) + (r[2] % 7 == 0))
        runs[k].append(r)
    runs[2].append(("close", START + dt.timedelta(days=3), -1, "close"))
    for k, part in enumerate(runs):
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        cursors.append_to(cursors.stream(source, "35000 seconds", bucket_ms=600_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        if k == 0:  # the watermark is not past anything yet
            assert spark.read.schema(cursors.OUTPUT).parquet(f"{tmp_path}/out").count() == 0
    got = answer(spark.read.parquet(f"{tmp_path}/out"))
    assert got == walk(rows)
    # run again over the same files: no row twice
    source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    cursors.append_to(cursors.stream(source, "35000 seconds", bucket_ms=600_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert answer(spark.read.parquet(f"{tmp_path}/out")) == got


class Held:
    """A state or a handle that counts what is asked of it."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def __getattr__(self, name):
        do = {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
            "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k], "updateValue": self.map.__setitem__, "removeKey": self.map.pop, "registerTimer": self.timers.add,
        }[name]

        def call(*args):
            self.calls += 1
            return do(*args)

        return call


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_few_rows_take_few_messages():
    """A key's rows over many buckets, in two batches of input and two of time: the same answer whether they wait together or by bucket, or turn from one to the other."""
    rng = random.Random(4)
    rows = [(rng.randrange(0, 50_000_000), i, rng.choice(["define", "advance", "consume", "reset", None])) for i in range(200)]
    want, calls = walk([("k", r[0], r[1], r[2]) for r in rows]), {}
    for few in (0, 150, 500):
        c, out = cursors._Cursor(1000, few), []
        c.handle, c.now, c.first, c.waiting = states = Held(), Held(), Held(), Held()
        at = lambda ms: [out.extend(c.handleExpiredTimer(("k",), At(ms), At(t))) for t in sorted(c.handle.timers) if t <= ms and not c.handle.timers.discard(t)]
        rows.sort(key=lambda r: (r[0] > 30_000_000, r[1]))
        late = [r for r in rows if r[0] > 20_000_000 and r[1] % 3 == 0]
        c.handleInputRows(("k",), iter([cursors.Row(us=r[0], id=r[1], op=r[2]) for r in rows if r not in late]), At(0))
        at(20_000)
        seen = len(out)
        c.handleInputRows(("k",), iter([cursors.Row(us=r[0], id=r[1], op=r[2]) for r in late]), At(20_000))
        at(60_000)
        assert 0 < seen < 200 and collections.Counter((r.key, r.id, r.version, r.occurrence, r.alias, r.outcome) for r in out) == want, few
        calls[few] = sum(s.calls for s in states)
    assert calls[500] < 25 < 200 < calls[0]
