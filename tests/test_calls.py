"""Model calls side by side, their cache, and failures by the row."""

import os
import threading
import time
import uuid
from collections import Counter

import pytest

from foliant.plans import calls


class Refused(Exception):
    def __init__(self, status):
        self.status_code = status


class Stop(BaseException):
    """Ends a task, as a lost executor would."""


def stand_in(folder, stop_after=None, fails=()):
    """A model that notes each call as a file; it ends the task after some calls in it."""

    def make():
        lock, made = threading.Lock(), []

        def call(target, text):
            with lock:
                made.append(text)
                n = len(made)
            if stop_after and n > stop_after:
                raise Stop
            with open(f"{folder}/{text}-{uuid.uuid4().hex}", "w"):
                pass
            if text in fails:
                raise Refused(400)
            time.sleep(0.002)
            return f"{target}:{text}"

        return call

    return make


def noted(folder):
    return Counter(f.split("-")[0] for f in os.listdir(folder))


def test_lost_tasks_repeat_no_answer(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "kept")
    log.mkdir()
    asked = spark.createDataFrame([(f"k{k}", "facts", f"t{k}") for k in range(120)] * 2, "key string, target string, text string")
    with pytest.raises(Exception, match="Stop"):
        calls.answered(asked, stand_in(log, stop_after=9), path, buckets=4).collect()
    before, now = None, noted(log)
    while before != now:  # the job's other tasks end a little later
        time.sleep(2)
        before, now = now, noted(log)
    assert 0 < len(before) < 120 and set(before.values()) == {1}
    again = calls.answered(asked, stand_in(log, fails={"t5"}), path, buckets=4)
    got = {r.key: r for r in again.collect()}
    assert len(got) == 120 and set(noted(log).values()) == {1}  # every key was asked once, over both runs
    assert {k for k, r in got.items() if r.cached} == {"k" + t[1:] for t in before} - {"k5"}
    bad = got.pop("k5")
    assert (bad.answer, bad.error_kind, bad.cached) == (None, "rejected", False) if "t5" not in before else bad.answer
    assert all(r.answer == f"facts:t{k[1:]}" and r.error_kind is None for k, r in got.items())
    assert all(r.cached for r in calls.answered(asked.filter("key <> 'k5'"), stand_in(log), f"file://{path}", buckets=4).collect()) and set(noted(log).values()) == {1}
    assert calls.compact(spark, path, str(tmp_path / "small")).count() == 119 + ("t5" in before)


def test_calls_edges(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    frame = lambda rows: spark.createDataFrame(rows, "key string, target string, text string")
    got = {r.key: r.answer for r in calls.answered(frame([(None, "facts", "x"), ("a", None, "y"), ("a", None, "z")]), stand_in(log), str(tmp_path / "k"), buckets=2, keep_every=50).collect()}
    assert got == {None: "facts:x", "a": "None:y"} and calls.Kept(str(tmp_path / "k")).load(7) == {}
    assert sum(len(calls.Kept(str(tmp_path / "k")).load(b)) for b in range(2)) == 1  # the null key is not kept
    assert calls.answered(frame([]), stand_in(log), str(tmp_path / "k")).count() == 0


def test_kinds_and_pace():
    assert [calls.error_kind(e) for e in (TimeoutError(), ConnectionError(), Refused(429), Refused(503), Refused(404), ValueError())] == ["timeout", "connection", "rate_limit", "server", "rejected", "other"]
    now, waits = [0.0], []
    pace = calls.Pace(2.0, lambda: now[0], waits.append)
    for _ in range(4):
        pace.take()
    now[0] = 10.0
    pace.take()
    assert waits == [0.5, 1.0, 1.5]
