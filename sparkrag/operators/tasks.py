"""Durable tasks in a store's folder: every transition is a file that can be made once only.

TASK-<id>-<n> holds the n-th state of a task. Who makes the next file of a task has made the transition; who comes second is refused. So each task is claimed
once whatever the number of drivers, a claim is a lease that runs out, and a former owner whose task was recovered cannot finish it: its number is not the last. Files
never change, so each is read once.
"""

from __future__ import annotations

import json
import time

from sparkrag.operators.store import Conflict, Store

QUEUED, RUNNING, SUCCEEDED, FAILED, CANCELLED = "queued", "running", "succeeded", "failed", "cancelled"
ACTIVE = (QUEUED, RUNNING)


class Tasks:
    """Sync tasks in order of submission: one active a source, idempotency keys, capped retries."""

    def __init__(self, store: Store, attempts: int = 3):
        self.store, self.attempts = store, attempts
        self._read: dict[str, dict] = {}

    def all(self) -> list[dict]:
        """The present state of every task, by id."""
        last: dict[int, int] = {}
        for name in self.store.names("TASK-"):
            task, n = map(int, name.split("-"))
            last[task] = max(last.get(task, 0), n)
        return [self._file(task, n) for task, n in sorted(last.items())]

    def _file(self, task: int, n: int) -> dict:
        name = f"TASK-{task}-{n}"
        if name not in self._read:
            self._read[name] = json.loads(self.store.text(name))
        return self._read[name]

    def get(self, task: int) -> dict:
        found = next((t for t in self.all() if t["id"] == task), None)
        if found is None:
            raise KeyError(task)
        return found

    def list(self, source: str | None = None, state: str | None = None) -> list[dict]:
        return [t for t in self.all() if source in (None, t["source"]) and state in (None, t["state"])]

    def _make(self, task: dict) -> dict:
        task = task | {"at": time.time()}
        self.store.create(f"TASK-{task['id']}-{task['n']}", json.dumps(task))
        return task

    def _next(self, task: dict, **given) -> dict:
        """The task's next state; refused if it has gone on since."""
        return self._make(task | given | {"n": task["n"] + 1})

    def submit(self, source: str, digest: str, base: int, key: str = "", **payload) -> dict:
        """A queued task. A key seen before for the source gives its task again, whatever became of it, if the digest is the same."""
        while True:
            known = self.all()
            if key:
                for t in known:
                    if t["source"] == source and t["key"] == key:
                        if t["digest"] != digest:
                            raise Conflict("idempotency_conflict")
                        return t
            try:
                return self._queued(known, source, digest, base, key, 1, None, payload)
            except Conflict as e:
                if str(e) == "active_task_conflict":
                    raise

    def _queued(self, known: list[dict], source: str, digest: str, base: int, key: str, attempt: int, parent: int | None, payload: dict) -> dict:
        if any(t["source"] == source and t["state"] in ACTIVE for t in known):
            raise Conflict("active_task_conflict")
        number = max((t["id"] for t in known), default=0) + 1
        return self._make({"id": number, "n": 0, "source": source, "digest": digest, "base": base, "key": key, "attempt": attempt, "parent": parent, "state": QUEUED, "owner": "", "until": 0.0, "report": None, "error": "", "payload": payload})

    def claim(self, owner: str, seconds: float = 600.0) -> dict | None:
        """The first queued task, now running and this owner's; None where there is none."""
        for t in self.list(state=QUEUED):
            try:
                return self._next(t, state=RUNNING, owner=owner, until=time.time() + seconds)
            except Conflict:
                continue  # another driver was first
        return None

    def renew(self, task: dict, seconds: float = 600.0) -> dict:
        return self._next(task, until=time.time() + seconds)

    def finish(self, task: dict, report: dict | None = None, error: str = "") -> dict:
        """Succeeded, or failed with an error; refused to a former owner."""
        return self._next(task, state=FAILED if error else SUCCEEDED, report=report, error=error, until=0.0)

    def cancel(self, task: int) -> dict:
        t = self.get(task)
        if t["state"] not in ACTIVE:
            raise Conflict("conflict")
        return self._next(t, state=CANCELLED, until=0.0)

    def recover(self, now: float | None = None) -> int:
        """Running tasks whose lease has run out fail; the number of them."""
        n = 0
        for t in self.list(state=RUNNING):
            if t["until"] <= (time.time() if now is None else now):
                try:
                    self._next(t, state=FAILED, error="interrupted", until=0.0)
                    n += 1
                except Conflict:
                    pass  # it went on, or another driver recovered it
        return n

    def retry(self, task: int, base: int) -> dict:
        """A failed or cancelled task once more, as a new task against the present revision."""
        while True:
            known = self.all()
            t = self.get(task)
            if t["state"] not in (FAILED, CANCELLED):
                raise Conflict("conflict")
            if t["attempt"] >= self.attempts:
                raise Conflict("retry_limit")
            try:
                return self._queued(known, t["source"], t["digest"], base, "", t["attempt"] + 1, t["id"], t["payload"])
            except Conflict as e:
                if str(e) == "active_task_conflict":
                    raise
