"""The job queue as a stream, and paged sources."""

import datetime
import json
import random
import shutil

import pytest
from pyspark.sql import Row

from lodestone.sources.paged import paged_source
from lodestone.streaming import jobs as stream

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "id string, kind string, at timestamp, seq long, due timestamp, priority int, max_attempts int, error string"


def replay(events, delay):
    out = {}
    ms = lambda t: None if t is None else round((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    for i, kind, at, _, due, priority, most, error in sorted(events, key=lambda e: (e[0], e[2], e[3])):
        job = stream.step(out.get(i), {"kind": kind, "at": ms(at), "due": ms(due), "priority": priority, "max_attempts": most, "error": error}, delay)
        if job:
            out[i] = job
    return out


def test_step_by_hand():
    e = lambda kind, at, **more: {"kind": kind, "at": at, "due": None, "priority": None, "max_attempts": None, "error": None} | more
    assert stream.step(None, e("claim", 1), 30) is None
    job = stream.step(None, e("enqueue", 5, priority=2, max_attempts=2), 30)
    assert (job["status"], job["attempts"], job["priority"], job["available_at"]) == ("pending", 0, 2, 5)
    assert stream.step(job, e("claim", 4), 30) == job  # not due
    job = stream.step(job, e("claim", 6), 30)
    assert (job["status"], job["attempts"], job["claimed_at"]) == ("running", 1, 6)
    assert stream.step(job, e("enqueue", 7), 30) == job and stream.step(job, e("claim", 7), 30) == job
    job = stream.step(job, e("fail", 8, error="x"), 30)
    assert (job["status"], job["available_at"], job["error"], job["claimed_at"]) == ("pending", 38, "x", None)
    assert stream.step(job, e("claim", 37), 30) == job
    job = stream.step(stream.step(job, e("claim", 38), 30), e("fail", 39, error="y"), 30)
    assert (job["status"], job["completed_at"], job["error"], job["attempts"]) == ("failed", 39, "y", 2)
    assert stream.step(job, e("claim", 90), 30) == job
    again = stream.step(job, e("requeue", 50), 30)
    assert (again["status"], again["attempts"], again["completed_at"]) == ("pending", 2, None) and stream.step(again, e("claim", 60), 30) == again
    assert stream.step(job, e("reset", 50), 30)["attempts"] == 0
    assert stream.step(job, e("enqueue", 60), 30)["status"] == "pending"
    done = stream.step(again, e("complete", 70), 30)
    assert (done["status"], done["completed_at"]) == ("completed", 70) and stream.step(done, e("enqueue", 80), 30) == done and stream.step(done, e("odd", 80), 30) == done


def test_job_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    r = random.Random(4)
    kinds = ["enqueue", "claim", "complete", "fail", "requeue", "reset", "odd", None]
    events = [(f"j{r.randrange(25)}", r.choice(kinds[:4] * 3 + kinds), T0 + datetime.timedelta(seconds=60 * n + r.randrange(60)), n, None if r.random() < 0.8 else T0 + datetime.timedelta(seconds=60 * n + 300), r.choice([None, 1, 5]), r.choice([None, 1, 2]), r.choice([None, "broken"])) for n in range(600)]
    for k in range(3):  # one run for each part, all on one checkpoint
        spark.createDataFrame(events[200 * k : 200 * (k + 1)], SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream.run_jobs(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", 90.0)
    got = {x.id: {f: x[f] for f in stream.FIELDS if f != "version"} for x in stream.jobs(spark, f"{tmp_path}/out").collect()}
    want = {i: {f: j[f] for f in stream.FIELDS if f != "version"} for i, j in replay(events, 90_000).items()}
    assert got == want
    notices = spark.read.parquet(f"{tmp_path}/out").where("notice").collect()
    assert notices and all(x.status == "pending" for x in notices)


def functions():
    """Made here, so that they travel to workers by value."""

    def told(request, cursor):
        with open(f"{request['path']}/{cursor or 'first'}.json") as f:
            return json.load(f)

    def advance(request, cursor, page):
        with open(request["log"], "a") as f:
            f.write(f"a{page}\n")
        return told(request, cursor)["next"]

    def fetch(request, cursor, page):
        if told(request, cursor).get("broken"):
            raise RuntimeError("the page is broken")
        for w in told(request, cursor)["works"]:
            yield (w, page)

    return advance, fetch


@pytest.fixture()
def pages(tmp_path):
    names = ["first", "c1", "c2", "c3", "c4"]
    (tmp_path / "p").mkdir()
    for i, n in enumerate(names):
        (tmp_path / "p" / f"{n}.json").write_text(json.dumps({"works": [f"w{i}{k}" for k in range(3)], "next": names[i + 1] if i < 4 else None}))
    return tmp_path


def test_paged_stream(spark, pages):
    spark.dataSource.register(paged_source("fixture", "work string, page int", *functions()))
    asked = lambda: len((pages / "log").read_text().split()) if (pages / "log").exists() else 0

    def run(q="x", n=2):
        d = spark.readStream.format("fixture").options(path=f"{pages}/p", log=f"{pages}/log", q=q, pages=n).load()
        s = d.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{pages}/check").format("parquet").option("path", f"{pages}/out").start()
        s.awaitTermination()
        return sorted(tuple(x) for x in spark.read.parquet(f"{pages}/out").collect())

    every = [(f"w{i}{k}", i) for i in range(5) for k in range(3)]
    assert run() == every[:6]
    # a page that fails leaves the checkpoint where it was
    good = (pages / "p" / "c3.json").read_text()
    (pages / "p" / "c3.json").write_text(json.dumps({"broken": True, "next": "c4"}))
    with pytest.raises(Exception):
        run()
    (pages / "p" / "c3.json").write_text(good)
    assert run() == every[:12]
    assert run() == every
    n = asked()
    assert run() == every and asked() == n  # the last page was read: nothing is asked
    with pytest.raises(Exception):
        run(q="another")
    shutil.rmtree(pages / "out")


def test_paged_batch(spark, pages):
    spark.dataSource.register(paged_source("fixture", "work string, page int", *functions()))
    read = spark.read.format("fixture").options(path=f"{pages}/p", log=f"{pages}/log")
    assert read.load().count() == 15 and read.option("pages", 2).load().count() == 6
    assert sorted(r.work for r in read.options(cursor="c4", pages=9).load().collect()) == ["w40", "w41", "w42"]


def test_a_job_costs_few_calls_of_its_state():
    """Rows of a job are stepped as they are, and timers are asked for only if one may be set."""
    calls = []

    class State:
        now = None
        exists = lambda self: self.now is not None
        get = lambda self: self.now

        def update(self, v):
            self.now = v

    class Handle:
        getValueState = lambda self, *a: State()
        listTimers = lambda self: calls.append("list") or [7]
        deleteTimer = lambda self, t: calls.append(("delete", t))
        registerTimer = lambda self, t: calls.append(("register", t))

    class Now:
        getCurrentWatermarkInMs = lambda self: 0

    row = lambda kind, at, seq: Row(kind=kind, at_ms=at, due_ms=None, seq=seq, priority=None, max_attempts=None, error="x")
    jobs = stream.Jobs(30)
    jobs.init(Handle())
    out = list(jobs.handleInputRows(("a",), iter([row("claim", 6, 2), row("enqueue", 5, 1)]), Now()))
    assert [(r.id, r.status, r.attempts, r.notice) for r in out] == [("a", "running", 1, False)] and calls == []
    assert [r.status for r in jobs.handleInputRows(("a",), iter([row("fail", 8, 3)]), Now())] == ["pending"] and calls == [("register", 38)]
    assert [r.status for r in jobs.handleInputRows(("a",), iter([row("complete", 9, 4)]), Now())] == ["completed"] and calls[1:] == ["list", ("delete", 7)]
