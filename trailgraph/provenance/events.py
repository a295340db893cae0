"""The closed vocabulary of provenance events."""

from __future__ import annotations

from dataclasses import dataclass, field

# The event types of the exported provenance graph.
ALGORITHM = "algorithm"
OPERATION = "operation"
PREGEL = "pregel"
PREGEL_START = "pregelStart"
PREGEL_STOP = "pregelStop"
PREGEL_ITERATION = "pregelIteration"

# The parameters of each algorithm event, in order.
ALGORITHM_PARAMETERS = {
    "BFS": ("source",),
    "SSSP": ("source",),
    "PageRank": ("numIter", "dampingFactor"),
    "WCC": ("maxIterations",),
    "LCC": (),
    "CDLP": ("maxIterations",),
}
UNBOUNDED_ITERATIONS = 2147483647


@dataclass(frozen=True)
class Event:
    event_type: str
    event_name: str
    params: tuple[tuple[str, str], ...] = field(default=())

    def __str__(self) -> str:
        values = ",".join(value for _, value in self.params)
        if self.event_type == OPERATION:
            values = self.event_name
        return f"{_CLASS_NAMES.get(self.event_type, self.event_name)}({values})"


# How non-algorithm events are written in an export.
_CLASS_NAMES = {
    OPERATION: "Operation",
    PREGEL: "PregelAlgorithm",
    PREGEL_START: "PregelLifecycleStart",
    PREGEL_STOP: "PregelLifecycleStop",
    PREGEL_ITERATION: "PregelIteration",
}


def operation(name: str) -> Event:
    return Event(OPERATION, name)


def algorithm(name: str, *values) -> Event:
    names = ALGORITHM_PARAMETERS[name]
    if len(names) != len(values):
        raise ValueError(f"{name} takes {names}, got {values}")
    return Event(ALGORITHM, name, tuple((n, str(v)) for n, v in zip(names, values)))


def pregel() -> Event:
    return Event(PREGEL, "PregelAlgorithm")


def pregel_start() -> Event:
    return Event(PREGEL_START, "PregelLifecycleStart")


def pregel_stop() -> Event:
    return Event(PREGEL_STOP, "PregelLifecycleStop")


def pregel_iteration(number: int) -> Event:
    return Event(PREGEL_ITERATION, "PregelIteration", (("i", str(number)),))
