"""Calls of a user's model with a time limit, several at a time."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

#: Calls that may hang in one task; with more of them the model is no longer called there.
MOST_HANGING = 32
#: Batches that are read while calls of an earlier one are still waited for.
AHEAD = 4


class _Batch:
    """The results and errors of a batch, and how many of its values are open."""

    def __init__(self, values: Sequence[tuple | None]):
        self.results: list = [None] * len(values)
        self.errors: list = [None] * len(values)
        self.todo = deque((self, place, value[0]) for place, value in enumerate(values) if value is not None)
        self.open = len(self.todo)

    def settle(self, place: int, result: Any, error: str | None) -> None:
        self.results[place], self.errors[place] = result, error
        self.open -= 1


class Caller:
    """Calls a function on many values; each gives a result or an error.

    With a `limit`, a call that takes more seconds is given up: its value gets an error at once, and the next one
    its turn. A thread cannot be stopped, so a call that is given up goes on in the background, its result unused;
    after `MOST_HANGING` of these the remaining values get errors without a call, so that a dead service ends the
    task soon instead of filling it with threads. The count sinks as such calls end. Without a limit, and one at a
    time, calls are plain ones.

    The threads take value after value themselves, so a call that answers costs no thread and no waking of another.
    """

    def __init__(self, function: Callable[[Any], Any], limit: float | None = None, at_once: int = 1):
        if at_once < 1 or (limit is not None and limit <= 0):
            raise ValueError("limit and at_once must be positive")
        self.function = function
        self.limit = limit
        self.at_once = at_once
        self._changed = threading.Condition()
        self._todo: deque[tuple[_Batch, int, Any]] = deque()
        self._running: dict[int, tuple[_Batch, int, float]] = {}  # number of the call: (batch, place, its start)
        self._number = 0
        self._workers = 0  # threads whose call is not given up
        self._hanging = 0

    def all(self, values: Sequence[tuple | None]) -> tuple[list, list]:
        """(results, errors) in the order of `values`: tuples of one value, or None to be passed over."""
        return next(self.batches([values]))

    def batches(self, batches: Iterable[Sequence[tuple | None]]) -> Iterator[tuple[list, list]]:
        """`all` for each batch, in order. Calls of the next ones begin while slow calls of one are waited for."""
        if self.limit is None and self.at_once == 1:
            for values in batches:
                batch = _Batch(values)
                for _, place, value in batch.todo:
                    batch.settle(place, *self._call(value))
                yield batch.results, batch.errors
            return
        waiting: deque[_Batch] = deque()
        try:
            for values in batches:
                batch = _Batch(values)
                waiting.append(batch)
                with self._changed:
                    self._todo.extend(batch.todo)
                self._settled(waiting[0], len(waiting) >= AHEAD)
                while waiting and not waiting[0].open:
                    done = waiting.popleft()
                    yield done.results, done.errors
            for batch in waiting:
                self._settled(batch, True)
                yield batch.results, batch.errors
        finally:  # a reader that stops early wants no more calls
            with self._changed:
                self._todo.clear()

    def _settled(self, batch: _Batch, whole: bool) -> None:
        """Waits until the batch has no open values or, if it need not be `whole`, until no value waits for its turn."""
        with self._changed:
            while batch.open:
                now = time.monotonic()
                if self.limit is not None:
                    self._give_up(now)
                if self._hanging >= MOST_HANGING:
                    while self._todo:
                        held, place, _ = self._todo.popleft()
                        held.settle(place, None, f"not called: {self._hanging} earlier calls do not end")
                    if not batch.open:
                        break
                while self._workers < min(self.at_once, len(self._todo) + len(self._running)):
                    self._workers += 1
                    threading.Thread(target=self._work, daemon=True).start()
                if not whole and not self._todo:
                    break
                # A call that begins later ends later than a limit from now.
                ends = [start + self.limit for _, _, start in self._running.values()] if self.limit else []
                self._changed.wait(None if self.limit is None else max(min([now + self.limit, *ends]) - now, 0))

    def _give_up(self, now: float) -> None:
        for number in [n for n, (_, _, start) in self._running.items() if start + self.limit <= now]:
            batch, place, _ = self._running.pop(number)
            batch.settle(place, None, self._timed_out())
            self._hanging += 1
            self._workers -= 1

    def _timed_out(self) -> str:
        return f"timed out after {self.limit:g} s"

    def _work(self) -> None:
        """Calls value after value; ends when none is left, or with a call that was given up."""
        while True:
            with self._changed:
                if not self._todo or self._hanging >= MOST_HANGING:
                    self._workers -= 1
                    self._changed.notify()
                    return
                batch, place, value = self._todo.popleft()
                self._number += 1
                number, start = self._number, time.monotonic()
                self._running[number] = (batch, place, start)
            result, error = self._call(value)
            with self._changed:
                if self._running.pop(number, None) is None:
                    self._hanging -= 1
                    return
                if self.limit is not None and time.monotonic() - start > self.limit:
                    result, error = None, self._timed_out()
                batch.settle(place, result, error)
                if not batch.open:
                    self._changed.notify()

    def _call(self, value: Any) -> tuple[Any, str | None]:
        try:
            return self.function(value), None
        except Exception as problem:  # a bad document must not stop the others
            return None, str(problem) or type(problem).__name__
