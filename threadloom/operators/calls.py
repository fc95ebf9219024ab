"""Calls of a task: at most so many in flight, failed ones put back until they are due."""

import heapq
import itertools
import time
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

MOST_WAIT = 3.0  # seconds a service may ask for


def wait_after(failure, attempt, first_wait, most_wait=MOST_WAIT):
    """Seconds until the next attempt, by the cause of the failure.

    What the service asks for (``retry_after``) counts up to ``most_wait``; after time-outs and
    other failures waits double.
    """
    asked = getattr(failure, "retry_after", None)
    if asked is not None:
        return min(max(float(asked), 0.0), most_wait)
    return first_wait * 2**attempt


class Call:
    """One call with its attempts: (start, end, cause), in seconds since 1970."""

    def __init__(self, place, ask):
        self.place, self.ask = place, ask
        self.attempts, self.answer, self.failure = [], None, None

    def attempt(self):
        start = time.time()
        try:
            self.answer, self.failure = self.ask(), None
        except Exception as failure:
            self.failure = failure
        self.attempts.append((start, time.time(), cause_of(self.failure)))

    def is_over(self, attempts):
        return self.failure is None or len(self.attempts) >= attempts or getattr(self.failure, "final", False)


def cause_of(failure):
    if failure is None:
        return "ok"
    if getattr(failure, "final", False):
        return "refused"
    if getattr(failure, "retry_after", None) is not None:
        return "asked"
    return "timeout" if isinstance(failure, TimeoutError) else "error"


def run_calls(asks, at_once=1, attempts=3, first_wait=1.0, most_wait=MOST_WAIT):
    """Make the calls, at most ``at_once`` of them in flight; they are returned in their order.

    A call that must wait goes back with the time when it is due, and others run meanwhile;
    calls that are due go first. With ``at_once`` above 1 the calls run in threads.
    """
    calls = [Call(place, ask) for place, ask in enumerate(asks)]
    fresh, due, running, turn = iter(calls), [], set(), itertools.count()
    of_future = {}
    with ThreadPoolExecutor(at_once) as pool:
        while True:
            while len(running) < at_once:
                if due and due[0][0] <= time.monotonic():
                    call = heapq.heappop(due)[-1]
                else:
                    call = next(fresh, None)
                if call is None:
                    break
                future = pool.submit(call.attempt)
                of_future[future] = call
                running.add(future)
            if not running and not due:
                return calls
            pause = max(0.0, due[0][0] - time.monotonic()) if due and len(running) < at_once else None
            if not running:
                time.sleep(pause)
                continue
            done, running = wait(running, pause, FIRST_COMPLETED)
            for future in done:
                call = of_future.pop(future)
                if not call.is_over(attempts):
                    waits = wait_after(call.failure, len(call.attempts) - 1, first_wait, most_wait)
                    heapq.heappush(due, (time.monotonic() + waits, next(turn), call))
