"""Workflows: a graph of operators, runs over bound inputs, and lineage queries along paths.

Building and running only compose DataFrames; work happens when a result is
asked for. Outputs that several operators read can be written once
(``keep``), and every run's lineage is held as its operators' strategies say.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .array import ArrayMeta, CellArray, domain
from .lineage.expr import Lineage
from .lineage.store import capture
from .operators.base import ArrayOp
from .plans.strategy import QUERY, Strategy, default_strategy
from .storage import written


@dataclass
class Run:
    inputs: dict[ArrayOp, list[CellArray]] = field(default_factory=dict)
    outputs: dict[ArrayOp, CellArray] = field(default_factory=dict)
    strategies: dict[ArrayOp, Strategy] = field(default_factory=dict)
    lineage: dict[tuple[ArrayOp, int], Lineage | None] = field(default_factory=dict)
    dropped: set[ArrayOp] = field(default_factory=set)


@dataclass
class PathResult:
    """``cells`` (i, j), and for each hop what was done: operator, argument, strategy, whether the answer is every cell."""

    cells: DataFrame
    hops: list[dict]

    def count(self) -> int:
        return self.cells.count()

    def union(self, other: PathResult) -> PathResult:
        return PathResult(self.cells.union(other.cells).distinct(), self.hops + other.hops)

    def intersect(self, other: PathResult) -> PathResult:
        return PathResult(self.cells.intersect(other.cells), self.hops + other.hops)


class Workflow:
    def __init__(self):
        self.ops: list[ArrayOp] = []
        self.edges: list[tuple[ArrayOp, ArrayOp, int]] = []
        self.static: dict[tuple[ArrayOp, int], CellArray] = {}
        self.asked: dict[ArrayOp, Strategy] = {}
        self.runs: dict[int, Run] = {}

    # --- graph --------------------------------------------------------------

    def register(self, op: ArrayOp) -> ArrayOp:
        if op not in self.ops:
            self.ops.append(op)
        return op

    def connect(self, parent: ArrayOp, child: ArrayOp, arg: int = 0) -> None:
        """The output of ``parent`` becomes argument ``arg`` of ``child``; two operators may be connected more than once."""
        for op in (parent, child):
            if op not in self.ops:
                raise ValueError(f"{op.name} isn't registered")
        if not 0 <= arg < child.n_args:
            raise ValueError(f"{child.name} has no argument {arg}")
        if self.parent(child, arg) is not None or (child, arg) in self.static:
            raise ValueError(f"argument {arg} of {child.name} is taken")
        self.edges.append((parent, child, arg))
        try:
            self.order()
        except ValueError:
            self.edges.pop()
            raise

    def bind(self, op: ArrayOp, arg: int, data: CellArray) -> None:
        """A fixed input, for an argument that nothing is connected to."""
        if self.parent(op, arg) is not None:
            raise ValueError(f"argument {arg} of {op.name} is connected")
        if not 0 <= arg < op.n_args:
            raise ValueError(f"{op.name} has no argument {arg}")
        self.static[op, arg] = data

    def parent(self, op: ArrayOp, arg: int) -> ArrayOp | None:
        return next((p for p, c, a in self.edges if c is op and a == arg), None)

    def parents(self, op: ArrayOp) -> list[tuple[ArrayOp, int]]:
        return [(p, a) for p, c, a in self.edges if c is op]

    def children(self, op: ArrayOp) -> list[tuple[ArrayOp, int]]:
        return [(c, a) for p, c, a in self.edges if p is op]

    def roots(self) -> list[ArrayOp]:
        """Operators with an argument that no operator feeds."""
        return [op for op in self.ops if any(self.parent(op, k) is None for k in range(op.n_args))]

    def order(self) -> list[ArrayOp]:
        """Topological order; each operator once."""
        out, left = [], list(self.ops)
        while left:
            ready = [op for op in left if all(p in out for p, _ in self.parents(op))]
            if not ready:
                raise ValueError("the graph has a cycle")
            out += ready
            left = [op for op in left if op not in ready]
        return out

    def visit(self, f: Callable[[ArrayOp], None]) -> None:
        for op in self.order():
            f(op)

    def reach(self, op: ArrayOp, steps: int, forward: bool = True) -> list[list[tuple[ArrayOp, int]]]:
        """Paths of at most ``steps`` hops from an operator, as (operator, argument) in query order; bounded breadth-first."""
        done, front = [], [[(op, k)] for k in range(op.n_args)] if not forward else [[(c, a)] for c, a in self.children(op)]
        for _ in range(max(0, steps)):
            done += front
            nxt = []
            for path in front:
                last, arg = path[-1]
                if forward:
                    nxt += [[*path, (c, a)] for c, a in self.children(last)]
                elif (p := self.parent(last, arg)) is not None:
                    nxt += [[*path, (p, k)] for k in range(p.n_args)]
            front = nxt
        return done

    # --- runs ---------------------------------------------------------------

    def set_strategy(self, op: ArrayOp, strategy: Strategy | None) -> None:
        """How the next runs capture the operator's lineage; None for its default."""
        if strategy is None:
            self.asked.pop(op, None)
        else:
            self.asked[op] = strategy

    def run(self, keep: tuple[ArrayOp, ...] = ()) -> int:
        """A new run over the bound inputs; returns its number, from 1. Outputs of ``keep`` are written now."""
        run = Run()
        for op in self.order():
            args = []
            for k in range(op.n_args):
                p = self.parent(op, k)
                if p is None and (op, k) not in self.static:
                    raise ValueError(f"argument {k} of {op.name} has no input")
                args.append(run.outputs[p] if p is not None else self.static[op, k])
            out = op.compute(args)
            if op in keep:
                out = CellArray(written(out.df, f"array-{op.name}"), out.meta)
            run.inputs[op], run.outputs[op] = args, out
            run.strategies[op] = default_strategy(op.modes, self.asked.get(op))
        number = len(self.runs) + 1
        self.runs[number] = run
        return number

    def output(self, op: ArrayOp, run: int) -> CellArray:
        return self.runs[run].outputs[op]

    def lineage(self, op: ArrayOp, arg: int, run: int, strategy: Strategy | None = None) -> Lineage:
        """An argument's lineage, captured on first use; operators that keep none, and dropped stores, are traced again."""
        r = self.runs[run]
        own = strategy or (QUERY if op in r.dropped else r.strategies[op])
        key = (op, arg, str(own))
        if key not in r.lineage:
            r.lineage[key] = capture(own, op, arg, r.inputs[op], r.outputs[op]) or op.lineage(arg, r.inputs[op], r.outputs[op])
        return r.lineage[key]

    def drop(self, op: ArrayOp, run: int) -> None:
        """Stop using the stored lineage of an operator; ``restore`` takes it up again."""
        self.runs[run].dropped.add(op)

    def restore(self, run: int) -> None:
        self.runs[run].dropped.clear()

    # --- queries --------------------------------------------------------------

    def _check(self, path, forward: bool) -> None:
        for (a, arg), (b, k) in zip(path, path[1:]):
            fed = self.parent(b, k) if forward else self.parent(a, arg)
            if fed is (a if forward else b):
                continue
            joined = any(p is a and c is b for p, c, _ in self.edges) if forward else any(p is b and c is a for p, c, _ in self.edges)
            if not joined:
                raise ValueError(f"{a.name} and {b.name} aren't connected")
            warnings.warn(f"the path names argument {k if forward else arg}, which isn't the one that connects {a.name} and {b.name}", stacklevel=3)

    def _walk(self, cells: DataFrame | None, path, run: int, forward: bool, pick, full: bool) -> PathResult:
        self._check(path, forward)
        spark = self.runs[run].outputs[path[0][0]].df.sparkSession
        hops = []
        for op, arg in path:
            strategy = pick(op, arg) if pick else None
            rel = self.lineage(op, arg, run, strategy)
            meta: ArrayMeta = rel.out if forward else rel.inp
            was = full
            full = was and (rel.full_fwd() if forward else rel.full_back())
            if full:
                cells = domain(spark, meta)  # every cell asked for every cell: nothing to join
            else:
                if cells is None:
                    cells = domain(spark, rel.inp if forward else rel.out)
                cells = rel.forward(cells) if forward else rel.backward(cells)
                if rel.expands_fwd if forward else rel.expands_back:
                    cells = cells.distinct()
            hops.append({"op": op.name, "arg": arg, "strategy": str(strategy or self.runs[run].strategies[op]), "full": full})
        return PathResult(cells.select("i", "j"), hops)

    def backward_path(self, cells: DataFrame | None, run: int, path: list[tuple[ArrayOp, int]], pick=None) -> PathResult:
        """Input cells that the output cells (i, j) of the path's first operator came from, hop by hop.

        ``cells`` None means every cell. ``pick(op, arg)`` may choose a
        strategy for a hop. The cells of a query are a set.
        """
        return self._walk(None if cells is None else cells.select(F.col("i").cast("long"), F.col("j").cast("long")).distinct(), path, run, False, pick, cells is None)

    def forward_path(self, cells: DataFrame | None, run: int, path: list[tuple[ArrayOp, int]], pick=None) -> PathResult:
        """Output cells of the path's last operator that these input cells went into."""
        return self._walk(None if cells is None else cells.select(F.col("i").cast("long"), F.col("j").cast("long")).distinct(), path, run, True, pick, cells is None)

    # --- manifest ---------------------------------------------------------------

    def manifest(self) -> str:
        """The graph and the runs' strategies as JSON; operators by position and class."""
        at = {op: k for k, op in enumerate(self.ops)}
        return json.dumps({
            "ops": [op.name for op in self.ops], "edges": [[at[p], at[c], a] for p, c, a in self.edges],
            "static": [[at[op], k, [a.meta.nrows, a.meta.ncols, a.meta.dtype]] for (op, k), a in self.static.items()],
            "runs": {n: {at[op]: str(s) for op, s in r.strategies.items()} for n, r in self.runs.items()},
        })

    @classmethod
    def from_manifest(cls, text: str, ops: list[ArrayOp], inputs: dict[tuple[int, int], CellArray]) -> Workflow:
        """A graph from its manifest, given operators of the same classes and the fixed inputs by (operator, argument)."""
        m = json.loads(text)
        if [op.name for op in ops] != m["ops"]:
            raise ValueError("the operators aren't those of the manifest")
        w = cls()
        for op in ops:
            w.register(op)
        for p, c, a in m["edges"]:
            w.connect(ops[p], ops[c], a)
        for k, a, _ in m["static"]:
            w.bind(ops[k], a, inputs[k, a])
        return w
