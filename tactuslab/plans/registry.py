"""Which stages there are, in what order a chain runs, and whether its requirements are met."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Message:
    index: int
    message: str


class Registry:
    """Stage classes by name, in their standard order."""

    def __init__(self) -> None:
        self._order: list[str] = []
        self._classes: dict[str, type] = {}

    def register(self, cls: type, after: str | None = None, before: str | None = None) -> None:
        """Add a stage at the end, or beside a registered one; a name that is there stays as it is."""
        name = cls.name
        if name in self._classes:
            return
        anchor = after or before
        if anchor is not None and anchor not in self._classes:
            raise KeyError(f"no stage named {anchor}")
        at = len(self._order) if anchor is None else self._order.index(anchor) + (1 if after else 0)
        self._order.insert(at, name)
        self._classes[name] = cls

    def create(self, name: str, **options):
        """A stage by name, or None where none has it."""
        cls = self._classes.get(name)
        return cls(**options) if cls else None

    def options(self, name: str) -> tuple[str, ...]:
        """Names of the options that a stage has."""
        return tuple(self._classes[name].defaults)

    def requirements(self, name: str) -> tuple[str, ...]:
        """Names of the stages that a stage requires."""
        return tuple(self._classes[name].requires)

    def stage(self, name: str) -> type:
        return self._classes[name]

    def ranged(self, name: str) -> bool:
        """Whether a stage covers a range of dates by which its calls are ordered."""
        return getattr(self._classes[name], "ranged", False)

    def order(self) -> list[str]:
        return list(self._order)

    def __contains__(self, name: str) -> bool:
        return name in self._classes

    def clear(self) -> None:
        self._order.clear()
        self._classes.clear()

    def place(self, name: str) -> int:
        """Place in the order, unknown names first."""
        return self._order.index(name) if name in self._classes else -1

    def sorted(self, chain: Iterable) -> list:
        """Stages by place. Those of one name keep their order, but of neighbours that both cover a range the earlier one comes first."""
        keyed, runs = [], {}
        for k, stage in enumerate(chain):
            start = stage.options.get("start") if getattr(stage, "ranged", False) else None
            runs[stage.name] = runs.get(stage.name, 0) + (start is None)  # one without a range parts those before it from those behind
            keyed.append(((self.place(stage.name), runs[stage.name], start is not None, start or 0.0, k), stage))
        return [stage for _, stage in sorted(keyed, key=lambda x: x[0])]


def validate(chain: list) -> list[Message]:
    """What each stage requires that doesn't stand before it."""
    done: set[str] = set()
    found = []
    for k, stage in enumerate(chain):
        found += [Message(k, f"{stage.name} requires {r} before it in the chain") for r in stage.requires if r not in done]
        done.add(stage.name)
    return found
