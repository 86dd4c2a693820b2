"""Chains of stages, run in order."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.util import inheritable_thread_target

from tactuslab.model import State
from tactuslab.operators.relops import saved
from tactuslab.plans.projects import argumentations, export_work, import_work, work_calls
from tactuslab.plans.registry import Message, Registry, validate
from tactuslab.plans.stages import Stage, registry


class Pipeline:
    """Stages in the registry's order. What a stage has changed is written after it, so plans stay as short as one stage."""

    def __init__(self, stages: Iterable[Stage], stage_registry: Registry = registry) -> None:
        self.stages = stage_registry.sorted(stages)

    def validate(self) -> list[Message]:
        return validate(self.stages)

    def run(self, state: State, check: bool = True) -> State:
        problems = self.validate() if check else []
        if problems:
            raise ValueError("; ".join(m.message for m in problems))
        for stage in self.stages:
            state = stage.run(state, self._kept)
        return state

    @staticmethod
    def _kept(stage: Stage, before: State, state: State) -> State:
        """state with what differs from before written, all of it at once: they are jobs of their own, and most are short."""
        new = {"notes": (state.notes, before.notes), "pedals": (state.pedals, before.pedals)} | {f"table {k}": (t, before.tables.get(k)) for k, t in state.tables.items()}
        new = {k: t for k, (t, old) in new.items() if t is not old and not hasattr(t, "_saved_at")}
        write = inheritable_thread_target(state.spark)(lambda k: saved(new[k], f"{stage.name}-{k.split()[-1]}"))
        with ThreadPoolExecutor(max_workers=4) as jobs:
            written = dict(zip(new, jobs.map(write, new), strict=True))
        tables = {k: written.get(f"table {k}", t) for k, t in state.tables.items()}
        return replace(state, notes=written.get("notes", state.notes), pedals=written.get("pedals", state.pedals), tables=tables)


__all__ = ["Pipeline", "argumentations", "export_work", "import_work", "work_calls"]
