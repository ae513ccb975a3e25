"""File changes from a real folder across restarts, one debounce for all paths, live prefixes, markers piece by piece."""

import os
import random
import time

import pytest

from quern.queries import streams
from quern.sources.store import Store
from quern.streaming import files, markers, timers
from quern.streaming.conversations import Sticky, fingerprint


class Folder:
    """A watched folder: run() processes what is there and gives the changes by batch; a new query each time."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.tmp, self.options = spark, tmp_path, options
        self.root = tmp_path / "root"
        self.root.mkdir()
        spark.dataSource.register(files.FileChanges)

    def run(self, fail_at=None):
        seen = []

        def each(df, number):
            rows = [(r.path, r.type, r.text) for r in df.orderBy("seq").collect()]
            if number == fail_at:
                raise RuntimeError("lost")
            if rows:
                seen.append(rows)

        src = self.spark.readStream.format("file_changes").options(root=str(self.root), state=str(self.tmp / "state"), **self.options).load()
        q = src.writeStream.foreachBatch(each).option("checkpointLocation", str(self.tmp / "check")).start()
        try:
            q.processAllAvailable()
        except Exception:
            assert fail_at is not None
        finally:
            q.stop()
        return seen


def test_changes_arrive_once_across_restarts(spark, tmp_path):
    f = Folder(spark, tmp_path, extensions=".py,.md")
    (f.root / "sub").mkdir()
    (f.root / "a.py").write_text("one")
    (f.root / "sub/b.md").write_text("two")
    (f.root / "c.bin").write_text("no")
    assert sum(f.run(), []) == [("a.py", "create", "one"), ("sub/b.md", "create", "two")]
    assert f.run() == []
    (f.root / "a.py").write_text("one more")
    os.rename(f.root / "sub/b.md", f.root / "sub/z.md")
    assert sum(f.run(), []) == [("a.py", "change", "one more"), ("sub/b.md", "delete", None), ("sub/z.md", "create", "two")]
    (f.root / "sub/z.md").unlink()
    (f.root / "new.py").write_text("x")
    last = sorted(int(n) for n in os.listdir(tmp_path / "check/offsets") if n.isdigit())[-1]
    assert f.run(fail_at=last + 1) == []  # the batch is planned, then the query dies
    (f.root / "later.py").write_text("y")
    got = f.run()
    assert sum(got, []) == [("new.py", "create", "x"), ("sub/z.md", "delete", None), ("later.py", "create", "y")]


def test_no_batch_has_more_files_than_it_may(spark, tmp_path):
    f = Folder(spark, tmp_path, maxFiles=3)
    for i in range(8):
        (f.root / f"f{i}.txt").write_text(str(i))
    got = f.run()
    while more := f.run():
        got += more
    assert sorted(len(b) for b in got) == [2, 3, 3] and len({p for b in got for p, _, _ in b}) == 8


def test_differences():
    assert files.differences({"a": [1], "b": [1]}, {"a": [2], "c": [1]}) == [("a", "change"), ("b", "delete"), ("c", "create")]


class FakeState(dict):
    def getValue(self, k):
        return self.get(k)

    def updateValue(self, k, v):
        self[k] = v

    def iterator(self):
        return iter(self.items())


class FakeValue:
    v = None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class FakeHandle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *a, **k):
        return FakeState()

    def getValueState(self, *a, **k):
        return FakeValue()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_debounce_on_an_injected_clock():
    import pandas as pd

    now, handle = [0], FakeHandle()
    d = timers.Debounce(500, lambda _: now[0])
    d.init(handle)

    def come(at, *events):
        now[0] = at
        list(d.handleInputRows((0,), iter([pd.DataFrame(events, columns=["path", "type", "seq"])]), None))

    def tick(at):
        now[0] = at
        out = []
        for t in sorted(t for t in handle.timers if t <= at):
            handle.timers.remove(t)
            for frame in d.handleExpiredTimer((0,), None, None):
                out += list(frame.itertuples(index=False, name=None))
        return out

    come(0, ("a", "create", 1))
    assert handle.timers == {500}
    come(400, ("b", "create", 2), ("a", "change", 3))
    assert handle.timers == {900} and tick(899) == []
    come(899, ("a", "change", 2))  # an older event comes late: the later one stays
    assert handle.timers == {1399} and tick(1398) == []
    assert tick(1399) == [(1, "a", "change", 3), (1, "b", "create", 2)]
    assert tick(5000) == [] and handle.timers == set()
    come(6000, ("c", "delete", 9))
    assert tick(6500) == [(2, "c", "delete", 9)]


@pytest.fixture
def rocks(spark):
    key = next(iter(timers.STORE))
    before = spark.conf.get(key)
    spark.conf.set(key, timers.STORE[key])
    yield spark
    spark.conf.set(key, before)


def test_debounce_in_a_stream(rocks, tmp_path):
    spark, schema = rocks, "path string, type string, seq long"
    src = tmp_path / "in"

    def put(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(str(src))

    put(("a", "create", 1), ("b", "create", 2))
    events = spark.readStream.schema(schema).parquet(str(src))
    q = timers.debounced(events, 4000).writeStream.format("memory").queryName("flushes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        time.sleep(1)
        put(("a", "change", 3))
        deadline = time.time() + 90
        while time.time() < deadline and not spark.table("flushes").count():
            time.sleep(0.5)
        got = sorted(map(tuple, spark.table("flushes").collect()))
    finally:
        q.stop()
    assert [r[1:] for r in got] == [("a", "change", 3), ("b", "create", 2)] and len({r[0] for r in got}) == 1


def chats(seed):
    rnd = random.Random(seed)
    base = [[{"role": "user", "content": f"q{rnd.randrange(3)}"}] + [{"role": "user", "content": f"m{rnd.randrange(2)}"} for _ in range(rnd.randrange(4))] for _ in range(60)]
    return [(i, i * 40, b, rnd.random() < 0.4) for i, b in enumerate(base)]


def test_live_prefixes_in_batch_and_stream(rocks, tmp_path):
    """Both forms against the plain store with a clock, on conversations that share beginnings, with expiry."""
    import datetime as dt

    spark, store, want, rows = rocks, Sticky(ttl=300), {}, []
    for i, at, messages, upgraded in chats(4):
        want[i] = store.lookup(messages, at)
        if upgraded:
            store.store(messages, at)
        keys = [fingerprint(messages[:n]) for n in range(1, len(messages))]
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), keys, upgraded))
    assert len(set(want.values())) > 2
    schema = "request long, at timestamp, keys array<string>, upgraded boolean"
    df = spark.createDataFrame(rows, schema)
    assert {r.request: r.known for r in timers.live_prefixes(df).collect()} == want
    for k in range(3):
        df.where(f"request div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)

    def run(rows):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = timers.live_prefixes_stream(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        q = out.start()  # a query with timers goes on without new rows, so it is stopped once the rows are there
        deadline = time.time() + 120
        try:
            while time.time() < deadline and q.exception() is None:
                time.sleep(1)
                done = sum(p["numInputRows"] for p in q.recentProgress)
                if done >= rows and not q.status["isDataAvailable"] and spark.read.schema("request long").parquet(str(tmp_path / "out")).count() % 5 == 0:
                    break
        finally:
            q.stop()

    run(60)
    df.where("request < 5").selectExpr("request + 1000 AS request", "at + INTERVAL 39 MINUTES AS at", "keys", "upgraded").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(5)  # the state outlives the query
    got = {r.request: r.known for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {i: n for i, n in got.items() if i < 1000} == want and len(got) == 65


def decided(text):
    """The rule read as a whole: what is known once a text has come so far."""
    line = text.lstrip("\n\r")
    if not line:
        return markers.MORE
    first, broken, _ = line.partition("\n")
    for kind in markers.KINDS:
        head = markers.LEAD + kind
        if first == head + ">>>":
            return "matched-" + kind.lower()
        if first.startswith(head + ":") and first.endswith(">>>") and first[len(head) + 1 : -3].strip():
            return "matched-" + kind.lower()
    if broken:
        return markers.NONE
    for kind in markers.KINDS:
        head = markers.LEAD + kind
        tail = first[len(head) :]
        if head.startswith(first) or (first.startswith(head) and tail in ("", ">", ">>", ">>>")):
            return markers.MORE
        if first.startswith(head + ":"):
            reason, gt, more = tail[1:].partition(">")
            return markers.MORE if gt + more in ("", ">", ">>", ">>>") else markers.NONE
    return markers.NONE


def test_every_cutting_gives_one_verdict():
    rnd = random.Random(8)
    parts = ["<<<NEEDS_", "PRO", "FLASH", "PROXY", ">>>", ">", ":", " ", "why", "\n", "\r", "<", "x", ": because>>>", "<<<NEEDS_PRO: a", "\t"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(7)))
        want = next((v for n in range(1, len(text) + 1) if (v := decided(text[:n])) != markers.MORE), markers.MORE)
        for _ in range(3):
            line, verdict, at = "", markers.MORE, 0
            while at < len(text):
                n = rnd.randint(1, 6)
                line, verdict = markers.feed(line, verdict, text[at : at + n])
                at += n
            assert verdict == want, text
            assert len(line) <= len(markers.HEADS[1]) + 6


def test_verdicts_in_batch_and_stream(spark, tmp_path):
    rows = [("a", 0, "\n<<<NEE"), ("a", 1, "DS_PRO: too ha"), ("a", 2, "rd>>>\nx"), ("b", 0, "Hello"), ("b", 1, "<<<NEEDS_PRO>>>"), ("c", 0, "<<<"), ("c", 1, None)]
    schema = "stream string, seq long, piece string"
    want = {("a", 0): "need-more", ("a", 1): "need-more", ("a", 2): "matched-pro", ("b", 0): "no-marker", ("b", 1): "no-marker", ("c", 0): "need-more", ("c", 1): "need-more"}
    df = spark.createDataFrame(rows, schema)
    assert {(r.stream, r.seq): r.verdict for r in markers.verdicts(df).collect()} == want
    for k in range(3):
        df.where(f"seq = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = markers.verdicts(src).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([("c", 2, "NEEDS_FLASH>>>")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # after a restart the automaton goes on where it was
    got = {(r.stream, r.seq): r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want | {("c", 2): "matched-flash"}


def test_changes_into_the_store(spark, tmp_path):
    """The source and the store together: each batch is one commit that a replay does not repeat."""
    f = Folder(spark, tmp_path)
    for i in range(4):
        (f.root / f"f{i}.py").write_text(f"text {i}")
    store = Store(spark, str(tmp_path / "store"))

    def each(df, number):
        rows = df.where("type <> 'delete'").selectExpr("path AS id", "path AS file_path", "array(CAST(length(text) AS FLOAT), 1.0F) AS embedding")
        store.write(rows, df.where("type <> 'create'").selectExpr("path AS file_path"), batch=("files", number))

    def run():
        src = spark.readStream.format("file_changes").options(root=str(f.root), state=str(tmp_path / "state")).load()
        q = src.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()

    run()
    (f.root / "f1.py").unlink()
    (f.root / "f2.py").write_text("longer text")
    run()
    assert {r.id: r.embedding[0] for r in store.read().collect()} == {"f0.py": 6.0, "f2.py": 11.0, "f3.py": 6.0}
    assert streams.QUERIES["live_prefixes"] is not None


def test_verdicts_of_a_batch_are_streamed(spark):
    """No call of Python for each stream: whole sorted partitions go by, and a stream may cross batches."""
    rows = [(f"s{i}", k, p) for i in range(30) for k, p in enumerate(["<<<NEEDS", "_PRO", ">>>" if i % 2 else "x", None])]
    df = markers.verdicts(spark.createDataFrame(rows, "stream string, seq long, piece string"))
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    last = {r.stream: r.verdict for r in df.where("seq = 3").collect()}
    assert last == {f"s{i}": "matched-pro" if i % 2 else "no-marker" for i in range(30)}
