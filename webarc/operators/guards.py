"""Guards for code in Python workers: time and memory limits, loops that go on after errors, readers that retry."""

from __future__ import annotations

import ctypes
import functools
import os
import signal
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import ContextDecorator
from typing import Any


class ExecutionTimeout(Exception):
    """A time guard ran out."""


class MemoryLimitExceeded(Exception):
    """A memory guard was passed."""


_ACTIVE: dict[tuple[int, type], Any] = {}

EXCEPTION, SIGNAL, EXCEPTION_THEN_SIGNAL = "exception", "signal", "exception_then_signal"


def _raise_in(thread: int, kind: type) -> None:
    ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(thread), ctypes.py_object(kind))


class _Guard(ContextDecorator):
    error: type = Exception

    def __init__(self, grace: float, interrupt: str, kill: bool, interval: float):
        if interrupt not in (EXCEPTION, SIGNAL, EXCEPTION_THEN_SIGNAL):
            raise ValueError(f"unknown interrupt type {interrupt}")
        self.grace, self.interrupt, self.kill, self.interval = grace, interrupt, kill, interval

    def _recreate_cm(self):
        return self

    def __enter__(self):
        self.thread = threading.get_ident()
        key = (self.thread, type(self))
        if key in _ACTIVE:
            raise RuntimeError(f"guards of the type {type(self).__name__} can't be nested")
        _ACTIVE[key] = self
        self.stop = threading.Event()
        self.level, self.since = 0, time.monotonic()
        self.progress()
        self.watcher = threading.Thread(target=self._watch, daemon=True)
        self.watcher.start()
        return self

    def __exit__(self, *_):
        self.stop.set()
        _ACTIVE.pop((self.thread, type(self)), None)
        if threading.current_thread() is not self.watcher:
            self.watcher.join(5)
        return False

    def progress(self) -> None:
        """Starts the time anew."""
        self.began = time.monotonic()

    def _passed(self) -> bool:
        raise NotImplementedError

    def _watch(self) -> None:
        while not self.stop.wait(self.interval):
            if not self._passed():
                self.level = 0
                continue
            now = time.monotonic()
            if self.level and now - self.since < self.grace:
                continue
            self.since = now
            self.level += 1
            self._act()

    def _act(self) -> None:
        if self.interrupt == EXCEPTION or (self.interrupt == EXCEPTION_THEN_SIGNAL and self.level == 1):
            _raise_in(self.thread, self.error)
        elif self.level >= 3 and self.kill:
            os.kill(os.getpid(), signal.SIGKILL)
        else:
            signal.pthread_kill(self.thread, signal.SIGINT if self.level <= 2 else signal.SIGTERM)


class _TimeGuard(_Guard):
    error = ExecutionTimeout

    def __init__(self, timeout: float, grace: float, interrupt: str, kill: bool, interval: float):
        super().__init__(grace, interrupt, kill, interval)
        self.timeout = timeout

    def _passed(self) -> bool:
        return time.monotonic() - self.began > self.timeout


class _MemGuard(_Guard):
    error = MemoryLimitExceeded

    def __init__(self, most: int, absolute: bool, patience: float, grace: float, interrupt: str, kill: bool, interval: float):
        super().__init__(grace, interrupt, kill, interval)
        self.most, self.absolute, self.patience, self.over = most, absolute, patience, None

    def __enter__(self):
        self.base = 0 if self.absolute else resident_kib()
        return super().__enter__()

    def _passed(self) -> bool:
        if resident_kib() - self.base <= self.most:
            self.over = None
            return False
        now = time.monotonic()
        self.over = self.over or now
        return now - self.over >= self.patience


def resident_kib() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") // 1024


def _with(guard: _Guard, f: Callable | None):
    return guard if f is None else functools.wraps(f)(guard(f))


def time_guard(f: Callable | None = None, *, timeout: float = 60, timeout_ms: float | None = None, grace_period: float = 15, interrupt_type: str = EXCEPTION_THEN_SIGNAL, send_kill: bool = False, check_interval: float = 500):
    """A decorator or context: ExecutionTimeout is raised in its thread when time is up; then signals follow, a grace period apart. progress() starts the time anew. check_interval is in milliseconds."""
    seconds = timeout if timeout_ms is None else timeout_ms / 1000
    return _with(_TimeGuard(seconds, grace_period, interrupt_type, send_kill, check_interval / 1000), f)


def mem_guard(f: Callable | None = None, *, max_memory: int, absolute: bool = True, grace_period: float = 0, secondary_grace_period: float = 5, interrupt_type: str = EXCEPTION_THEN_SIGNAL, send_kill: bool = False, check_interval: float = 500):
    """MemoryLimitExceeded is raised when the process holds more than max_memory KiB (more than at the start, if not absolute) for a grace period."""
    return _with(_MemGuard(max_memory, absolute, grace_period, secondary_grace_period, interrupt_type, send_kill, check_interval / 1000), f)


def progress(guard: _Guard | None = None) -> None:
    """Tells a guard, or this thread's time guard, that there is progress."""
    guard = guard or _ACTIVE.get((threading.get_ident(), _TimeGuard))
    if guard is None:
        raise RuntimeError("no guard is active")
    guard.progress()


def progress_loop(it: Iterable, guard: _Guard | None = None) -> Iterator:
    for x in it:
        yield x
        progress(guard)


def exc_loop(it: Iterable) -> Iterator[tuple[Any, BaseException | None]]:
    """(item, None), or (None, error) where the iterator raises; ends where it ends."""
    it = iter(it)
    while True:
        try:
            yield next(it), None
        except StopIteration:
            return
        except Exception as e:
            yield None, e


def warc_retry(records: Iterable, reopen: Callable[[int], Iterable], retry_count: int | None = 3, seek: bool | None = True) -> Iterator:
    """Records of an archive; after an error they go on behind the last good one.

    reopen gives the records from a place on: from the last good record's (seek), or from 0, where those that came already are skipped; with seek None, from 0 and nothing
    is skipped. Errors of reopen count too. retry_count limits how often in a row it is tried; 0 or None don't.
    """
    at, tries, it = -1, 0, None
    try:
        it = iter(records)
    except Exception:
        tries = 1
    while True:
        try:
            if it is None:
                it = iter(reopen(max(at, 0) if seek else 0))
            for r in it:
                if seek is not None and at >= 0 and r.stream_pos <= at:
                    continue
                at, tries = r.stream_pos, 0
                yield r
            return
        except Exception:
            tries += 1
            if retry_count and tries > retry_count:
                raise
            it = None


def guarded(f: Callable, timeout_ms: float | None = None) -> Callable:
    """(value, error) of f: None and the error's text where f raises or takes too long. For use in UDFs."""

    def run(*args):
        try:
            if timeout_ms is None:
                return f(*args), None
            with time_guard(timeout_ms=timeout_ms, check_interval=max(1, timeout_ms / 10), interrupt_type=EXCEPTION):
                return f(*args), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}".rstrip(": ")

    return run
