"""Calls of a slow, failing service: some at a time, each with a time limit, repeated within a budget, answers in order."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Awaitable, Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

Ask = Callable[[str], str] | Callable[[str], Awaitable[str]]


@dataclass(frozen=True)
class CallLimits:
    """What one task asks of a service.

    ``in_flight`` calls at a time, ``seconds`` for one call, ``tries`` calls for one request, ``pause`` seconds before the
    second call, doubled before each further one. ``retries`` bounds the repeated calls of a whole task: when they are spent, as
    when the service is down, each request is still sent once."""
    in_flight: int = 8
    seconds: float = 60.0
    tries: int = 3
    pause: float = 0.5
    retries: int = 1000


class Caller:
    """A client of one task with its limits.

    A coroutine function is cancelled at its time limit. A plain function runs in a thread, which can't be: it keeps its place among
    the ``in_flight`` until it returns, so the limit holds, and what waits for a place in vain is never sent."""

    def __init__(self, ask: Ask, limits: CallLimits = CallLimits()):
        self._ask, self._limits, self._retries = ask, limits, limits.retries
        self._runner, self._places = asyncio.Runner(), asyncio.Semaphore(limits.in_flight)
        plain = not (inspect.iscoroutinefunction(ask) or inspect.iscoroutinefunction(getattr(ask, "__call__", None)))
        self._threads = ThreadPoolExecutor(limits.in_flight) if plain else None

    def __enter__(self) -> Caller:
        return self

    def __exit__(self, *_) -> None:
        if self._threads is not None:
            self._threads.shutdown(wait=False, cancel_futures=True)
        self._runner.close()

    def answers(self, requests: Sequence[str]) -> list[tuple[str | None, str | None]]:
        """Answer and null, or null and the reason, per request and in their order."""
        return self._runner.run(self._all(requests))

    async def _all(self, requests: Sequence[str]) -> list[tuple[str | None, str | None]]:
        return await asyncio.gather(*[self._one(r) for r in requests])

    def _call(self, request: str) -> Awaitable[str]:
        if self._threads is None:
            return self._ask(request)
        return asyncio.get_running_loop().run_in_executor(self._threads, self._ask, request)

    async def _one(self, request: str) -> tuple[str | None, str | None]:
        reason, limits = None, self._limits
        for attempt in range(limits.tries):
            if attempt:
                if self._retries <= 0:
                    return None, f"{reason} (no retries left)"
                self._retries -= 1
                await asyncio.sleep(limits.pause * 2 ** (attempt - 1))
            async with self._places:
                try:
                    return await asyncio.wait_for(self._call(request), limits.seconds), None
                except Exception as error:  # noqa: BLE001  any failed call is recorded as a missing answer with its reason
                    said = str(error) or (f"no answer in {limits.seconds:g} s" if isinstance(error, TimeoutError) else "")
                    reason = f"{type(error).__name__}: {said}"
        return None, reason
