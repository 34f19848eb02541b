"""Retries, tokens, polled jobs and fetched files, without a network or a clock."""

import hashlib

import pytest

from narrata.functions import remote


def _failing(errors, value="ok"):
    left = list(errors)

    def f():
        if left:
            raise left.pop(0)
        return value

    return f


@pytest.mark.parametrize(
    ("retry", "errors", "slept"),
    [
        (remote.Retry(5, 1.0), [OSError()] * 4, [1, 2, 4, 8]),
        (remote.Retry(3, 2.0, "linear"), [OSError()] * 2, [2, 4]),
        (remote.Retry(11, 0.5, longest=3.0), [remote.Refused("x", 503)] * 5, [0.5, 1, 2, 3, 3]),
        (remote.Retry(2), [remote.RateLimited("slow", 429)] * 3, [180, 180, 180]),
    ],
)
def test_waits_between_attempts(retry, errors, slept):
    waits = []
    assert retry.call(_failing(errors), waits.append) == "ok" and waits == slept


def test_what_is_not_tried_again():
    waits, seen = [], []
    with pytest.raises(remote.Refused):
        remote.Retry(5).call(_failing([remote.Refused("no", 404)] * 2), waits.append)
    with pytest.raises(ValueError):
        remote.Retry(5).call(_failing([ValueError("bad")] * 2), waits.append)
    with pytest.raises(OSError):
        remote.Retry(3).call(_failing([OSError()] * 9), waits.append, lambda: seen.append(1))
    assert waits == [1, 2] and len(seen) == 3


def test_tokens_are_renewed():
    now, made = [0.0], []
    token = remote.Token(lambda: made.append(1) or f"t{len(made)}", 10, lambda: now[0])
    assert [token(), token()] == ["t1", "t1"]
    now[0] = 10.0
    assert token() == "t2"


def _job(states, **more):
    said, waits, now = [{"state": {"now": s}, **more} for s in states], [], [0.0]
    jobs = remote.Jobs("job.id", "state.now", "url", every=5, longest=12)

    def sleep(s):
        waits.append(s)
        now[0] += s

    submitted = []
    run = lambda: jobs.run(lambda: submitted.append(1) or {"job": {"id": 7}}, lambda job: said.pop(0), lambda job, url: f"{job}{url}".encode(), sleep, lambda: now[0])
    return run, waits, submitted


def test_jobs_are_polled_to_their_end():
    run, waits, submitted = _job(["queued", "RUNNING", " Done "], url="/a")
    assert run() == b"7/a" and waits == [5, 5] and len(submitted) == 1
    run, _, _ = _job(["failed"], detail={"why": "x"})
    with pytest.raises(RuntimeError, match=r'failed with state .failed.: \{"why": "x"\}'):
        run()
    run, _, _ = _job(["queued"] * 9)
    with pytest.raises(TimeoutError):
        run()
    with pytest.raises(RuntimeError, match="no job id"):
        remote.Jobs().run(lambda: {}, None, None)


def test_paths_into_documents():
    doc = {"a": [{"b": 1}], "c": None}
    assert [remote.at_path(doc, p) for p in ("a.0.b", "a.1.b", "c.d", "x", "")] == [1, None, None, None, doc]


def test_files_are_fetched_once(tmp_path):
    asked = []

    def fetch(name):
        asked.append(name)
        if name == "gone":
            raise OSError("no")
        return name.encode()

    for _ in range(2):
        got = remote.fetched(["a/b", "gone", "c"], tmp_path / "cache", fetch)
    assert [p.name for p in got] == ["a_b", "c"] and asked == ["a/b", "gone", "c", "gone"]
    remote.fetched(["c"], tmp_path / "cache", fetch, refresh=True)
    assert asked[-1] == "c" and remote.digest(got[0]) == hashlib.sha256(b"a/b").hexdigest()
