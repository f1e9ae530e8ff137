"""Bootstrap sessions over an event log (A19, I18): the same answers in batch and as a stream.

A session begins with the regions of its packets, cut into chunks, and goes on by submissions of the current chunk. What an
event answers depends on the ones before it, so a small step is applied to each session's events in order of time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (I18): why a submission is refused.
UNKNOWN, OTHER_CHUNK, NOT_ONE_EACH, NO_PACKETS = "unknown or expired session", "not the current chunk", "not exactly one interpretation for every region of the chunk", "no region evidence packets"

EVENT = "session string, at timestamp, n long, kind string, chunk string, regions array<string>"
ANSWER = "session string, n long, result string, detail string, chunk string, chunk_index int, chunk_count int"
_COLUMNS = ["session", "n", "result", "detail", "chunk", "chunk_index", "chunk_count"]


def chunk_id(session: str, index: int, regions: list[str]) -> str:
    """The id of a session's chunk: its number and a hash of its regions."""
    return f"semantic-chunk-{index + 1}-" + hashlib.sha256(f"{session}:{index}:{':'.join(regions)}".encode()).hexdigest()[:10]


def step(session: str, state: dict | None, event: dict, size: int, ttl: float) -> tuple[dict | None, tuple]:
    """What a session (regions, next, at) becomes by an event (at, n, kind, chunk, regions), and the answer.

    A session that nothing touched for ``ttl`` seconds is gone. Beginning one that goes on issues its current chunk again. A refused
    submission leaves the session as it was, but touches nothing.
    """
    at = event["at"]
    if state is not None and at - state["at"] > ttl:
        state = None
    answer = lambda result, detail="", chunk=None, i=None, of=None: (session, event["n"], result, detail, chunk, i, of)
    part = lambda s, i: s["regions"][i * size: (i + 1) * size]
    count = lambda s: -(-len(s["regions"]) // size)
    if event["kind"] == "begin":
        if state is None:
            if not event["regions"]:
                return None, answer("refused", NO_PACKETS)
            state = {"regions": event["regions"], "next": 0}
        state = state | {"at": at}
        i = state["next"]
        return state, answer("issued", "", chunk_id(session, i, part(state, i)), i, count(state))
    if state is None:
        return None, answer("refused", UNKNOWN)
    i = state["next"]
    if event["chunk"] != chunk_id(session, i, part(state, i)):
        return state, answer("refused", OTHER_CHUNK)
    if sorted(part(state, i)) != sorted(event["regions"]):
        return state, answer("refused", NOT_ONE_EACH)
    i += 1
    if i == count(state):
        return None, answer("complete", "", None, i, count(state))
    state = state | {"next": i, "at": at}
    return state, answer("issued", "", chunk_id(session, i, part(state, i)), i, count(state))


def _event(r) -> dict:
    return {"at": r.at.timestamp(), "n": int(r.n), "kind": r.kind, "chunk": r.chunk, "regions": [x for x in r.regions if x is not None] if r.regions is not None else []}


def _answers(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"n": "int64", "chunk_index": "Int32", "chunk_count": "Int32"})


def _ordered(events: DataFrame) -> DataFrame:
    return events.select("session", "at", "n", "kind", "chunk", "regions").where("session is not null and at is not null and n is not null")


def answers(events: DataFrame, *, size: int = 1, ttl: float = 3600.0, late: str = "10 minutes") -> DataFrame:
    """(session, n, result, detail, chunk, chunk_index, chunk_count): the answer to each event of ``events`` (session, at, n, kind, chunk, regions).

    ``kind`` is begin (regions: those of the packets, in order) or submit (regions: those interpreted). Events of a session are taken in order
    of time and number. In batch, tasks read sorted sessions and hold one session's state. A stream holds events until the watermark,
    ``late`` behind the newest, has passed them, so events in any order of arrival get the answers of the batch; the state of a session and its
    waiting events lie in the state store (A19), from which a restart goes on, and a session without events for ``ttl`` seconds is removed by a timer.

    Events with a null session, time or number are left out; null regions are none. Repeated events are events of their own. A stream drops events that come
    after the watermark has passed them, as streams do. An empty log gives no rows. Other columns are not read.
    """
    if events.isStreaming:
        return _stream(events, size, ttl, late)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, None
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                if r.session != session:
                    session, state = r.session, None
                state, row = step(session, state, _event(r), size, ttl)
                rows.append(row)
            yield _answers(rows)

    return _ordered(events).repartition("session").sortWithinPartitions("session", "at", "n").mapInPandas(run, ANSWER)


def _stream(events: DataFrame, size: int, ttl: float, late: str) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, waiting = json.loads(held.get[0]) if held.exists else (None, [])
        passed = held.getCurrentWatermarkMs() / 1000
        for f in frames:
            waiting += [e for e in map(_event, f.itertuples(index=False)) if e["at"] >= passed]
        waiting.sort(key=lambda e: (e["at"], e["n"]))
        rows = []
        while waiting and waiting[0]["at"] < passed:
            state, row = step(key[0], state, waiting.pop(0), size, ttl)
            rows.append(row)
        if waiting:
            wake = waiting[0]["at"]
        elif state is not None and state["at"] + ttl >= passed:
            wake = state["at"] + ttl
        else:
            held.remove()
            wake = None
        if wake is not None:
            held.update((json.dumps((state, waiting)),))
            held.setTimeoutTimestamp(int(max(wake, passed) * 1000) + 1)
        if rows:
            yield _answers(rows)

    rows = _ordered(events).withWatermark("at", late)
    return rows.groupBy("session").applyInPandasWithState(run, ANSWER, "state string", "append", "EventTimeTimeout")


def still_open(events: DataFrame, *, size: int = 1, ttl: float = 3600.0) -> DataFrame:
    """(session, chunk, chunk_index, chunk_count): the sessions of a whole log whose last good answer issued a chunk that nothing has answered yet."""
    good = answers(events, size=size, ttl=ttl).where("result <> 'refused'")
    at = good.join(_ordered(events).select("session", "n", "at"), ["session", "n"])
    last = at.groupBy("session").agg(F.max_by(F.struct("result", "chunk", "chunk_index", "chunk_count", "at"), F.struct("at", "n")).alias("r"))
    newest = _ordered(events).agg(F.max("at")).first()[0]
    live = F.lit(newest).cast("double") - F.col("r.at").cast("double") <= ttl
    return last.where((F.col("r.result") == "issued") & live).select("session", "r.chunk", "r.chunk_index", "r.chunk_count")
