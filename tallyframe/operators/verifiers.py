"""A caller's verifier made safe: a pair on which it raises, or does not come back, costs only that pair's verdict."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

Verifier = Callable[[pd.Series, pd.Series], pd.DataFrame]

ERROR = "error"
VERDICT = "is_correct boolean, match_type string, error string"


def isolated(verifier: Verifier, seconds: float) -> Verifier:
    """The verifier on two series, with a third column ``error``: why a pair has no verdict.

    All pairs go to the verifier at once. If it raises, the pairs are halved until the one that raises is alone; if it takes
    longer than ``seconds``, smaller groups get as long each, and in the end a single pair. Python code is interrupted by the
    worker's alarm clock; native code that never comes back to Python is not.

    What follows is defined inside, so that it reaches workers that lack this package.
    """

    def judge(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
        import signal
        import threading

        import pandas as pd

        class Overtime(BaseException):
            """Not an Exception, so that a verifier which catches those is interrupted as well."""

        def ring(*_) -> None:
            raise Overtime

        def attempt(begin: int, end: int) -> pd.DataFrame:
            part = [x.iloc[begin:end].reset_index(drop=True) for x in (pred, gold)]
            out = verifier(*part)[["is_correct", "match_type"]].reset_index(drop=True)
            if len(out) != end - begin:
                raise ValueError(f"{len(out)} verdicts on {end - begin} pairs")
            return out.assign(error=None)

        clock = threading.current_thread() is threading.main_thread()
        found, todo = [], [(0, len(pred))]
        before = signal.signal(signal.SIGALRM, ring) if clock else None
        try:
            while todo:
                begin, end = todo.pop()
                size = end - begin
                if not size:
                    continue
                try:
                    try:
                        if clock:
                            signal.setitimer(signal.ITIMER_REAL, seconds)
                        found.append((begin, attempt(begin, end)))
                    finally:
                        if clock:
                            signal.setitimer(signal.ITIMER_REAL, 0)
                    continue
                except Overtime:
                    why, group = f"no verdict within {seconds} seconds", max(1, min(64, size // 8))
                except Exception as error:
                    why, group = f"{type(error).__name__}: {error}", (size + 1) // 2
                if size == 1:
                    found.append((begin, pd.DataFrame({"is_correct": [False], "match_type": ["error"], "error": [why[:500]]})))
                else:
                    todo += [(b, min(end, b + group)) for b in range(begin, end, group)]
        finally:
            if clock:
                signal.signal(signal.SIGALRM, before)
        empty = pd.DataFrame({"is_correct": pd.Series(dtype=bool), "match_type": pd.Series(dtype=object), "error": pd.Series(dtype=object)})
        return pd.concat([f for _, f in sorted(found, key=lambda x: x[0])] or [empty], ignore_index=True)

    return judge
