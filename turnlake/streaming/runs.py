"""Run assembly: one step function for batch and stream.

Turns of an agent are folded in time order. The state is the agent's runs, those of each session and its newest ones, and the
audits that were seen; `step` decides whether a turn continues a run, joins a like one, or opens a new one."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from turnlake.functions import text as T

#: Idle minutes, and how many of a session's and of an agent's runs are looked up.
IDLE_MINUTES, OF_SESSION, OF_AGENT = 30, 20, 12
OUT = "audit_id string, agent string, session string, run_id string, turn_no int, opened boolean, goal string"
TURN = ["audit_id", "agent", "session", "us", "text"]
_LOWER = str.maketrans(T.UPPER, T.LOWER)
_WORDS = re.compile(r"[^\W_]+")
_CJK = re.compile(f"[{T.CJK}]")


def keywords(text: str) -> set[str]:
    """As functions.text.keywords, for one text."""
    cjk = "".join(_CJK.findall(text))
    return {w for w in _WORDS.findall(text.translate(_LOWER)) if len(w.encode()) >= 3} | {cjk[k : k + 2] for k in range(len(cjk) - 1)}


def jaccard(a: str, b: str) -> float:
    x, y = keywords(a), keywords(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def is_bootstrap(text: str) -> bool:
    return any(m in text.translate(_LOWER) for m in T.BOOTSTRAP) or T.BOOTSTRAP_EXACT in text


def is_weak(goal: str) -> bool:
    t = goal.strip()
    return is_bootstrap(t) or t.lower() in ("unknown task", "openclaw") or t.startswith("You are ") or len(t) < 8


def is_bootstrap_goal(goal: str) -> bool:
    return is_bootstrap(goal) or goal.strip().lower() == "unknown task"


def related(a: str, b: str) -> bool:
    a, b = a.strip(), b.strip()
    return bool(a and b) and "Unknown task" not in (a, b) and (a in b or b in a or jaccard(a, b) >= 0.25)


def is_new_task(text: str, goal: str) -> bool:
    return not is_bootstrap(text) and (any(m in text.translate(_LOWER) for m in T.NEW_TASK) or (len(text) > 60 and jaccard(goal, text) < 0.12))


class Memory:
    """An agent's runs and audits in a batch task; `Kept` has the same members over a stream's keyed state."""

    def __init__(self):
        self.audits, self.by_id, self.by_session, self.newest = set(), {}, {}, []

    def seen(self, audit: str) -> bool:
        known = audit in self.audits
        self.audits.add(audit)
        return known

    def session(self, session: str) -> list[dict]:
        return [self.by_id[i] for i in self.by_session.get(session, [])]

    def last(self) -> list[dict]:
        return [self.by_id[i] for i in self.newest]

    def add(self, run: dict) -> None:
        """Lists are in order of start; they hold what is ever looked up, audits and runs themselves are never forgotten."""
        self.by_id[run["id"]] = run
        self.by_session[run["session"]] = [*self.by_session.get(run["session"], []), run["id"]][-OF_SESSION:]
        self.newest = [*self.newest, run["id"]][-OF_AGENT:]

    def save(self, run: dict) -> None:
        self.by_id[run["id"]] = run


class Kept(Memory):
    def __init__(self, audits, by_id, by_session, newest):
        self.state = audits, by_id, by_session, newest

    def seen(self, audit: str) -> bool:
        known = self.state[0].containsKey((audit,))
        if not known:
            self.state[0].updateValue((audit,), (True,))
        return known

    def _runs(self, ids: list[str]) -> list[dict]:
        return [json.loads(self.state[1].getValue((i,))[0]) for i in ids]

    def _of(self, session: str) -> list[str]:
        return json.loads(self.state[2].getValue((session,))[0]) if self.state[2].containsKey((session,)) else []

    def _newest(self) -> list[str]:
        return json.loads(self.state[3].get()[0]) if self.state[3].exists() else []

    def session(self, session: str) -> list[dict]:
        return self._runs(self._of(session))

    def last(self) -> list[dict]:
        return self._runs(self._newest())

    def add(self, run: dict) -> None:
        self.save(run)
        self.state[2].updateValue((run["session"],), (json.dumps([*self._of(run["session"]), run["id"]][-OF_SESSION:]),))
        self.state[3].update((json.dumps([*self._newest(), run["id"]][-OF_AGENT:]),))

    def save(self, run: dict) -> None:
        self.state[1].updateValue((run["id"],), (json.dumps(run),))


def new_state() -> Memory:
    return Memory()


def admits(run: dict, goal: str) -> bool:
    """Whether a run of about the same time may go on with this goal: like it, or a real goal where the run's is weak."""
    upgrade = (is_bootstrap_goal(run["goal"]) and not is_bootstrap_goal(goal)) or (is_weak(run["goal"]) and not is_weak(goal))
    return related(run["goal"], goal) or upgrade


def step(state: Memory, turn: dict) -> dict | None:
    """The turn's row of OUT; the state changes. None for an audit that was seen. A turn may carry the status it leaves its run in."""
    if state.seen(turn["audit_id"]):
        return None
    text = (turn["text"] or "").strip()
    real = text if text and not is_bootstrap(text) else ""
    goal = (text.split("\n")[0][:240] + ("…" if len(text.split("\n")[0]) > 240 else "")) if real else "Unknown task"
    idle = lambda r: r["ended"] is None or (turn["us"] - r["ended"]) // 60_000_000 > IDLE_MINUTES
    own = state.session(turn["session"])
    run = own[-1] if own else None
    fresh = bool(real) and is_new_task(real, run["goal"] if run else "")
    opened = run is None or run["status"] == "failed" or idle(run) or fresh
    if opened and not fresh:
        # The session's runs, and the agent's newest ones unless the goal is unknown.
        near = own + (state.last() if goal.strip() not in ("", "Unknown task") else [])
        like = [r for r in near if not idle(r) and admits(r, goal)]
        if like:
            run, opened = max(like, key=lambda r: (r["turns"], r["started"])), False
    if opened:
        name = hashlib.sha1(f"{turn['session']}:{turn['agent']}:{turn['us']}".encode()).hexdigest()
        run = {"id": name, "session": turn["session"], "goal": goal, "started": turn["us"], "turns": 0, "status": "running", "ended": None}
        state.add(run)
    elif is_weak(run["goal"]) and not is_weak(goal):
        run["goal"] = goal
    run["turns"] += 1
    run["ended"], run["status"] = turn["us"], turn.get("status") or "running"
    state.save(run)
    return {"audit_id": turn["audit_id"], "agent": turn["agent"], "session": turn["session"], "run_id": run["id"], "turn_no": run["turns"], "opened": opened, "goal": run["goal"]}


_NAMES = [c.split()[0] for c in OUT.split(", ")]
_ARROW = pa.schema([(n, pa.int32() if n == "turn_no" else pa.bool_() if n == "opened" else pa.string()) for n in _NAMES])


def _fold(state: Memory, rows: pd.DataFrame) -> pd.DataFrame:
    out = [r for t in rows.sort_values(["us", "audit_id"], kind="stable").to_dict("records") if (r := step(state, t))]
    return pd.DataFrame(out, columns=_NAMES)


def _columns(turns: DataFrame) -> DataFrame:
    status = F.col("status") if "status" in turns.columns else F.lit(None)
    return turns.select(*TURN, status.cast("string").alias("status"))


def assemble(turns: DataFrame) -> DataFrame:
    """Batch: each agent's turns in order, read one after the other from sorted partitions; a task holds the state of the agent
    it is at, not its turns. An agent's state depends on all its turns, so they can't be spread."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agent, state = None, None
        for batch in batches:
            out = []
            for turn in batch.to_pylist():
                if state is None or turn["agent"] != agent:
                    agent, state = turn["agent"], new_state()
                if row := step(state, turn):
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return _columns(turns).repartition("agent").sortWithinPartitions("agent", "us", "audit_id").mapInArrow(run, OUT)


class RunAssembler(StatefulProcessor):
    """The same steps in a stream, keyed by agent. Audits, runs and sessions are entries of keyed state, so none is forgotten
    and a turn reads only what it looks up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        text, yes = StructType([StructField("json", StringType())]), StructType([StructField("seen", BooleanType())])
        key = StructType([StructField("key", StringType())])
        self.state = handle.getMapState("audits", key, yes), handle.getMapState("runs", key, text), handle.getMapState("sessions", key, text), handle.getValueState("newest", text)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield _fold(Kept(*self.state), pd.concat(list(rows)))

    def close(self) -> None:
        pass


def assemble_stream(turns: DataFrame) -> DataFrame:
    """Streaming twin of `assemble`; needs the RocksDB state store. Turns within a micro-batch are put in order."""
    return _columns(turns).groupBy("agent").transformWithStateInPandas(statefulProcessor=RunAssembler(), outputStructType=OUT, outputMode="Append", timeMode="None")


def once_per_audit(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Exactly once by audit id within the watermark; `ts` is the event time."""
    return turns.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["audit_id"])
