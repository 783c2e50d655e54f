"""Stores of task states, in memory or in the shared folder, behind one interface.

A state is the text map of `rillfold.operators.tasks.encode_state`, under the task key `keyspace.table:generation:vnode`.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Protocol

from pyspark.sql import SparkSession

from rillfold.folder import SharedFolder

State = dict[str, str]
KEYS = ("window_start", "window_end", "change_id_stream", "change_id_time")


def _start(state: Mapping[str, str]) -> int:
    return int(state["window_start"])


class StateStore(Protocol):
    def load(self, tasks: Iterable[str]) -> dict[str, State]: ...
    def save(self, states: Mapping[str, State]) -> None: ...
    def delete(self, tasks: Iterable[str]) -> None: ...
    def generation(self) -> int | None: ...
    def save_generation(self, ms: int) -> None: ...


class MemoryStore:
    """States of one process; copies go in and out."""

    def __init__(self) -> None:
        self._states: dict[str, State] = {}
        self._generation: int | None = None

    def load(self, tasks: Iterable[str]) -> dict[str, State]:
        return {t: dict(self._states[t]) for t in tasks if t in self._states}

    def save(self, states: Mapping[str, State]) -> None:
        self._states |= {t: {k: v for k, v in s.items() if k in KEYS} for t, s in states.items()}

    def delete(self, tasks: Iterable[str]) -> None:
        for t in tasks:
            self._states.pop(t, None)

    def generation(self) -> int | None:
        return self._generation

    def save_generation(self, ms: int) -> None:
        self._generation = ms


class FolderStore:
    """States of all tasks as one small file per generation in a shared folder, replaced by a rename.

    A generation's tasks are saved and loaded together, so a step of many tasks is one read and one write, however many they are.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._at = SharedFolder(spark, folder)
        self.folder = self._at.folder
        self._at.make("tasks")

    @staticmethod
    def _file(task: str) -> str:
        """Tasks of one generation share a file; a key without generation has its own."""
        part = task.split(":")
        return f"tasks/g{part[1]}" if len(part) == 3 and part[1].isdigit() else f"tasks/t{task.encode().hex()}"

    def _by_file(self, tasks: Iterable[str]) -> dict[str, list[str]]:
        files: dict[str, list[str]] = {}
        for t in tasks:
            files.setdefault(self._file(t), []).append(t)
        return files

    def _read(self, name: str) -> dict[str, State]:
        return json.loads(self._at.text(name) or "{}")

    def load(self, tasks: Iterable[str]) -> dict[str, State]:
        out: dict[str, State] = {}
        for name, some in self._by_file(tasks).items():
            states = self._read(name)
            out |= {t: states[t] for t in some if t in states}
        return out

    def save(self, states: Mapping[str, State]) -> None:
        for name, some in self._by_file(states).items():
            new = {t: {k: v for k, v in states[t].items() if k in KEYS} for t in some}
            self._at.publish(name, json.dumps(self._read(name) | new), replace=True)

    def delete(self, tasks: Iterable[str]) -> None:
        for name, some in self._by_file(tasks).items():
            gone = set(some)
            self._at.publish(name, json.dumps({t: s for t, s in self._read(name).items() if t not in gone}), replace=True)

    def generation(self) -> int | None:
        text = self._at.text("generation")
        return int(text) if text else None

    def save_generation(self, ms: int) -> None:
        self._at.publish("generation", str(ms), replace=True)


class Backend:
    """A store and the set of active tasks: a task that is no longer active can't move its state."""

    def __init__(self, store: StateStore) -> None:
        self.store, self.active = store, set[str]()

    def configure(self, generation_ms: int, tasks: Iterable[str]) -> dict[str, State]:
        """Make these the active tasks: states of others are deleted, the generation is saved, saved states of these come back."""
        new = set(tasks)
        self.store.delete(self.active - new)
        self.store.save_generation(generation_ms)
        self.active = new
        return self.store.load(new)

    def set_state(self, task: str, state: State) -> None:
        if task not in self.active:
            raise LookupError(f"task {task} isn't active")
        self.store.save({task: state})

    def all_past(self, until_ms: int) -> bool:
        """Whether every active task has moved past a time; none active, none past."""
        states = self.store.load(self.active)
        return bool(self.active) and all(t in states and _start(states[t]) > until_ms for t in self.active)
