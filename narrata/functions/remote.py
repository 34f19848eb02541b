"""Calls to services: retries, tokens, jobs that are polled, and files fetched once. Every transport, clock and sleep is injectable.

None of it is a query; UDFs and drivers of the engine use it around the function that a user gives for a back end or a model.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from hashlib import sha256
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)
# States of a response that may pass.
TRANSIENT = frozenset({408, 409, 425, 429, 500, 502, 503, 504})


class Refused(Exception):
    """A response that isn't one of success; ``status`` is its number where it has one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class RateLimited(Refused):
    """Too many calls: waited out without counting as an attempt."""


@dataclass(frozen=True)
class Retry:
    """How often a call is tried and how long is waited between. ``growth`` is "double" (first, 2 first, 4 first, ... up to ``longest``), "linear" or "none"."""

    attempts: int = 5
    first: float = 1.0
    growth: str = "double"
    longest: float = float("inf")
    rate_limit: float = 180.0

    def delay(self, attempt: int) -> float:
        """Seconds after the failed attempt with this number, from 1."""
        grown = {"double": self.first * 2 ** (attempt - 1), "linear": self.first * attempt, "none": self.first}[self.growth]
        return min(self.longest, grown)

    def call(self, f: Callable[[], Any], sleep: Callable[[float], None] = time.sleep, before: Callable[[], None] | None = None) -> Any:
        """``f()`` until it succeeds. Refusals that can't pass and wrong values are raised at once, the last error after all attempts; ``before`` runs ahead of each."""
        attempt = 1
        while True:
            try:
                if before:
                    before()
                return f()
            except RateLimited as error:
                log.warning("rate limit: %s; waiting %s s", error, self.rate_limit)
                sleep(self.rate_limit)
                continue
            except Exception as error:
                if attempt >= self.attempts or isinstance(error, ValueError) or not passing(error):
                    raise
                log.warning("attempt %s of %s failed: %s", attempt, self.attempts, error)
                sleep(self.delay(attempt))
                attempt += 1


def passing(error: Exception) -> bool:
    """Whether an error may not come again: all but refusals of the 400s that aren't transient."""
    status = getattr(error, "status", None)
    return status is None or status in TRANSIENT or not 400 <= status < 500


class Token:
    """An access token that is renewed when it has lived ``lives`` seconds."""

    def __init__(self, get: Callable[[], str], lives: float = 541.0, clock: Callable[[], float] = time.monotonic):
        self._get, self._lives, self._clock = get, lives, clock
        self._value: str | None = None
        self._until = float("-inf")

    def __call__(self) -> str:
        if self._value is None or self._clock() >= self._until:
            self._value, self._until = self._get(), self._clock() + self._lives
        return self._value


def at_path(document: Any, path: str) -> Any:
    """A dotted path with numbers for places in lists; None where it leads nowhere."""
    for part in path.split(".") if path else []:
        try:
            document = document[int(part)] if isinstance(document, list) else document[part]
        except (KeyError, IndexError, ValueError, TypeError):
            return None
    return document


@dataclass(frozen=True)
class Jobs:
    """A service that takes a job, tells its state and hands out the result. States are compared in lower case."""

    id_path: str = "id"
    status_path: str = "status"
    url_path: str = "download_url"
    done: tuple[str, ...] = ("done", "completed", "succeeded", "success")
    failed: tuple[str, ...] = ("failed", "error", "cancelled")
    every: float = 120.0
    longest: float = 14400.0
    retry: Retry = Retry(attempts=11, first=0.5, longest=120.0)

    def run(self, submit: Callable[[], Any], status: Callable[[str], Any], download: Callable[[str, str | None], bytes], sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> bytes:
        """Submit once, ask until the job is done or failed, and download. A submission is never repeated: it might be done twice."""
        job = at_path(submit(), self.id_path)
        if not job:
            raise RuntimeError("no job id in the response")
        job, started = str(job), clock()
        while True:
            if clock() - started > self.longest:
                raise TimeoutError(f"job {job} did not finish within {self.longest} s")
            said = self.retry.call(lambda: status(job), sleep)
            state = str(at_path(said, self.status_path)).strip().lower()
            if state in self.done:
                url = at_path(said, self.url_path)
                return self.retry.call(lambda: download(job, url), sleep)
            if state in self.failed:
                why = next((w for k in ("error", "detail", "message") if (w := at_path(said, k))), None)
                why = json.dumps(why, ensure_ascii=False) if isinstance(why, (dict, list)) else why
                raise RuntimeError(f"job {job} failed with state {state!r}" + (f": {why}" if why else ""))
            sleep(self.every)


def fetched(names: Iterable[str], folder: str | Path, fetch: Callable[[str], bytes], refresh: bool = False) -> list[Path]:
    """The files below ``folder``; those that aren't there (or all, to refresh) are fetched first. What can't be fetched is a warning and is left out."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for name in names:
        path = folder / name.replace("/", "_")
        if refresh or not path.exists():
            try:
                path.write_bytes(fetch(name))
            except Exception as error:  # the source's own errors are not known here
                log.warning("%s was not fetched: %s", name, error)
                continue
        out.append(path)
    return out


def digest(path: str | Path) -> str:
    """SHA-256 of a file, in pieces."""
    h = sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()
