"""Stepped streams of signed bags: delay, difference and running sum.

State is a table per ``state`` name.  It advances once a step, at the end of the step, however often a
plan is evaluated within it.  Each new state is cut from its lineage in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sortalis.operators import zset
from sortalis.plans.ops import Delay, Diff, Integrate, Plan, compiled, optimize
from sortalis.sources.shared import shared_folder
from sortalis.sources.structure import Structure


class StreamContext:
    """Evaluates plans step by step."""

    def __init__(self) -> None:
        self.timestep = 0
        self._state: dict[str, DataFrame] = {}
        self._next: dict[str, tuple[Plan, Structure, DataFrame]] = {}

    def execute(self, plan: Plan, model: Structure) -> DataFrame:
        """The consolidated result of a plan in this step."""
        shared_folder(model.spark)
        return zset.consolidate(compiled(optimize(plan, model.signature), model, lambda op, current: self._stream(op, current, model)))

    def step(self) -> int:
        """Ends the step; what plans have seen in it becomes the past."""
        self._state |= {k: new for k, (_, _, new) in self._next.items()}
        self._next = {}
        self.timestep += 1
        return self.timestep

    def reset(self) -> None:
        self.timestep, self._state, self._next = 0, {}, {}

    def run(self, plan: Plan, model: Structure) -> DataFrame:
        """Executes and steps; the result is cut from its lineage."""
        out = self.execute(plan, model).checkpoint()
        self.step()
        return out

    def _stream(self, op: Plan, current: DataFrame, model: Structure) -> DataFrame:
        """The new state is computed once a step, written, and what the operator gives is derived from it."""
        before = self._state.get(op.state)
        known = self._next.get(op.state)
        if known is not None and known[0] == op and known[1] is model:
            new = known[2]
        else:
            whole = zset.union(before, current) if isinstance(op, Integrate) and before is not None else current
            new = zset.consolidate(whole).checkpoint()
            self._next[op.state] = op, model, new
        match op:
            case Delay():
                return before if before is not None else new.limit(0)
            case Diff():
                return zset.difference(new, before) if before is not None else new
            case Integrate():
                return new
        raise TypeError(op)


def without_stream(op: Plan, current: DataFrame) -> DataFrame:
    """The batch reading of stream operators: each hands its input on."""
    return current


def batches_into(plan: Plan, model_of: Callable[[DataFrame], Structure], sink: Callable[[DataFrame, int], None], context: StreamContext | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch is a step of the plan over the model made of it.

    A batch that the engine hands over again after a failure is not stepped twice.
    """
    context = context or StreamContext()
    done = -1

    def each(batch: DataFrame, epoch: int) -> None:
        nonlocal done
        if epoch > done:
            sink(context.run(plan, model_of(batch)), epoch)
            done = epoch

    return each
