import asyncio
import threading
import time

from glosswork.operators.calls import Caller, CallLimits


def test_order_and_number_of_calls_at_a_time():
    lock, now, most = threading.Lock(), [0], [0]

    def ask(request):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 if int(request) % 3 else 0.06)
        with lock:
            now[0] -= 1
        return f"a{request}"

    with Caller(ask, CallLimits(in_flight=4)) as caller:
        assert caller.answers([str(i) for i in range(30)]) == [(f"a{i}", None) for i in range(30)]
        assert caller.answers([]) == [] and caller.answers(["7"]) == [("a7", None)]
    assert most[0] == 4


def test_coroutine_is_cancelled_at_its_limit():
    open_, most = [0], [0]

    async def ask(request):
        open_[0] += 1
        most[0] = max(most[0], open_[0])
        try:
            await asyncio.sleep(60 if request == "slow" else 0.01)
            return request
        finally:
            open_[0] -= 1

    began = time.time()
    with Caller(ask, CallLimits(in_flight=2, seconds=0.2, tries=1)) as caller:
        got = caller.answers(["slow", "x", "slow", "y"])
    assert got == [(None, "TimeoutError: no answer in 0.2 s"), ("x", None), (None, "TimeoutError: no answer in 0.2 s"), ("y", None)]
    assert open_[0] == 0 and most[0] <= 2 and time.time() - began < 5


def test_failed_calls_are_repeated():
    calls = []

    def ask(request):
        calls.append((request, time.time()))
        if sum(r == request for r, _ in calls) < 3:
            raise ConnectionError("down")
        return request

    with Caller(ask, CallLimits(in_flight=1, pause=0.05)) as caller:
        assert caller.answers(["a"]) == [("a", None)]
    times = [t for _, t in calls]
    assert len(times) == 3 and times[1] - times[0] >= 0.05 and times[2] - times[1] >= 0.1


def test_retries_of_a_task_are_bounded():
    calls = []

    def ask(request):
        calls.append(request)
        raise ConnectionError("down")

    with Caller(ask, CallLimits(in_flight=2, pause=0.0, tries=4, retries=5)) as caller:
        first, second = caller.answers(list("abcd")), caller.answers(list("ef"))
    assert len(calls) == 4 + 5 + 2
    assert all(a is None and e.startswith("ConnectionError: down") for a, e in first + second)
    assert second == [(None, "ConnectionError: down (no retries left)")] * 2


def test_a_thread_that_hangs_keeps_its_place():
    gate, sent = threading.Event(), []

    def ask(request):
        sent.append(request)
        gate.wait(20)
        return request

    try:
        with Caller(ask, CallLimits(in_flight=1, seconds=0.2, tries=1)) as caller:
            got = caller.answers(["a", "b"])
        assert [a for a, _ in got] == [None, None] and sent == ["a"]
    finally:
        gate.set()
