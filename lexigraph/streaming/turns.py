"""The per-session turn machine: which tools a session has, and which each turn promotes and demotes. One step function serves the
stream, where Spark keeps the state, and the batch, where a session's turns are folded in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST_DEMOTED, LOW_RANKS, WITHIN, BEHIND, RECENT, PROXIED = 3, 2, 2, 3, 3, 2
STEPS = "session long, turn long, promoted string, demoted string, active string"


def fresh() -> dict:
    return {"turn": 0, "active": [], "used": [], "low": {}, "proxied": {}, "promoted": [], "demoted": []}


def advance(state: dict, calls: list[str], proxies: list[str], ranked: list[str], k: int) -> dict:
    """The state after one turn: first the set of tools changes by the turn's ranking and what earlier turns called, then the turn's own
    calls are noted. Promoted is what ranks within k - 2, and what was reached by proxy in two of the last three turns. From the second
    turn on, an active tool that ranks k + 3 or later (from 0; unranked ones last) twice running goes, unless the turn before used it,
    three a turn at most, in the order in which they came."""
    turn, active = state["turn"] + 1, list(state["active"])
    recent = {t: [x for x in xs if x >= turn - RECENT] for t, xs in state["proxied"].items()}
    wanted = [*ranked[: max(1, k - WITHIN)], *(t for t, xs in recent.items() if len(xs) >= PROXIED)]
    promoted = [t for t in dict.fromkeys(wanted) if t not in active]
    active += promoted
    rank, low = {t: i for i, t in enumerate(ranked)}, dict(state["low"])
    if turn > 1:
        for t in active:
            low[t] = low.get(t, 0) + 1 if rank.get(t, len(ranked)) >= k + BEHIND else 0
        demoted = [t for t in active if low[t] >= LOW_RANKS and t not in state["used"]][:MOST_DEMOTED]
    else:
        demoted = []
    active = [t for t in active if t not in demoted]
    for t in dict.fromkeys(proxies):
        recent.setdefault(t, []).append(turn)
    return {
        "turn": turn, "active": active, "used": sorted({*calls, *proxies}), "low": {t: n for t, n in low.items() if n and t not in demoted}, "proxied": {t: xs for t, xs in recent.items() if xs}, "promoted": promoted, "demoted": demoted,
        "shown": sorted(active, key=lambda t: (rank.get(t, len(ranked)), t)),
    }


def _steps(session: int, rows: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
    out = []
    for row in rows.sort_values("turn").itertuples(index=False):
        state = advance(state, list(row.calls), list(row.proxies), list(row.ranked), int(row.k))
        out.append((session, row.turn, ",".join(state["promoted"]), ",".join(state["demoted"]), ",".join(state["shown"])))
    return pd.DataFrame(out, columns=["session", "turn", "promoted", "demoted", "active"]), state


def turns_batch(events: DataFrame) -> DataFrame:
    """(session, turn, promoted, demoted, active) of every turn, active by rank. events: session, turn, calls, proxies, ranked (all tools, best first), k."""
    return events.groupBy("session").applyInPandas(lambda key, rows: _steps(int(key[0]), rows, fresh())[0], STEPS)


def turns_stream(events: DataFrame, idle: int | None = 1_800_000) -> DataFrame:
    """The same of a stream; a session's state goes when it has been idle for so many milliseconds (None: never; a query that is to end
    once all is read needs that, as one with a timeout waits for it)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = json.loads(state.get[0]) if state.exists else fresh()
        done, now = _steps(int(key[0]), pd.concat(batches), now)
        state.update((json.dumps(now),))
        if idle is not None:
            state.setTimeoutDuration(idle)
        yield done

    return events.groupBy("session").applyInPandasWithState(step, STEPS, "state string", "append", "NoTimeout" if idle is None else "ProcessingTimeTimeout")


def polling(significance: list[tuple[float, float]], *, steps: tuple[int, ...] = (5, 10, 20, 30), idle: int = 2, enough: float = 1.0, quiet: float = 10.0) -> list[tuple[float, int, bool]]:
    """(time, interval, fires) for observations (time, significance): polls grow rarer after idle ones, and what has gathered fires
    once it is enough and the last time is long enough ago."""
    level, rests, gathered, last, out = 0, 0, 0.0, float("-inf"), []
    for at, s in significance:
        if s > 0:
            level, rests, gathered = 0, 0, gathered + s
        else:
            rests += 1
            if rests >= idle:
                level, rests = min(level + 1, len(steps) - 1), 0
        fires = gathered >= enough and at - last >= quiet
        if fires:
            gathered, last = 0.0, at
        out.append((at, steps[level], fires))
    return out
