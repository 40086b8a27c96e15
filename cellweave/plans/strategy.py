"""How an operator's lineage is captured: modes, encodings, and their combinations.

A strategy is a set of layouts (buckets), each of which answers queries in one
direction; a layout is one or more captures whose answers are united. All are
plain values: equal ones compare and hash alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntFlag


class Mode(IntFlag):
    """Fixed values."""

    QUERY = 1
    FULL_MAPFUNC = 2
    FULL_MAPFUNC_BOX = 4
    PT_MAPFUNC = 8
    PT_MAPFUNC_BOX = 16
    PTR = 32
    NOOP = 64
    STAT = 128


class Spec(Enum):
    """Encoding of a cell set; fixed values, with the names they have in strategy strings."""

    ONE = 0
    MANY = 1
    BOX = 4
    KEY = 5
    BIN = 7
    GRID = 8
    NONE = -1


#: Names of modes that have no encoding.
_PLAIN = {Mode.NOOP: "NOOP", Mode.STAT: "STAT", Mode.FULL_MAPFUNC: "MAP", Mode.QUERY: "Q"}


@dataclass(frozen=True)
class Desc:
    """One capture: its mode, the encodings of output cells and of what they lead to, and its direction."""

    mode: Mode
    out: Spec = Spec.NONE
    inp: Spec = Spec.NONE
    backward: bool = True

    def __post_init__(self):
        if not self.backward and Spec.BOX in (self.out, self.inp):
            raise ValueError("boxes serve backward queries only")

    def __str__(self) -> str:
        if self.mode in _PLAIN:
            return _PLAIN[self.mode]
        name = lambda s: "-1" if s is Spec.NONE else s.name
        if self.mode == Mode.PT_MAPFUNC:
            return f"PTMAP_{name(self.out)}_{name(self.inp)}"
        if self.mode == Mode.PTR:
            return f"{name(self.out)}_{name(self.inp)}_{'b' if self.backward else 'f'}"
        return f"{int(self.mode)}_{self.out.value}_{self.inp.value}_{int(self.backward)}"


@dataclass(frozen=True)
class Strategy:
    buckets: tuple[tuple[Desc, ...], ...]

    @classmethod
    def single(cls, mode: Mode, out: Spec = Spec.NONE, inp: Spec = Spec.NONE, backward: bool = True) -> Strategy:
        """One layout; a combined mode becomes one capture for each of its modes."""
        return cls((tuple(Desc(m, out, inp, backward) for m in Mode if m & mode),))

    def __str__(self) -> str:
        return "___".join("__".join(map(str, b)) for b in self.buckets)

    @property
    def descs(self) -> list[Desc]:
        return [d for b in self.buckets for d in b]

    @property
    def modes(self) -> set[Mode]:
        return {d.mode for d in self.descs}


QUERY, MAP = Strategy.single(Mode.QUERY), Strategy.single(Mode.FULL_MAPFUNC)
NOOP, STAT = Strategy.single(Mode.NOOP), Strategy.single(Mode.STAT)
COMPOSITE = Mode.FULL_MAPFUNC | Mode.PT_MAPFUNC


def candidates() -> list[Strategy]:
    """What the optimizer chooses from: re-execution, map, 8 backward layouts, 4 forward ones, and all 32 pairs of both."""
    sets = [(o, i) for o in (Spec.ONE, Spec.MANY) for i in (Spec.KEY, Spec.MANY)]
    back = [Strategy.single(m, o, i) for m in (Mode.PT_MAPFUNC, Mode.PTR) for o, i in sets]
    fwd = [Strategy.single(Mode.PTR, o, i, False) for o, i in sets]
    return [QUERY, MAP, *back, *fwd, *(Strategy(b.buckets + f.buckets) for b in back for f in fwd)]


def default_strategy(modes: tuple[str, ...], asked: Strategy | None = None) -> Strategy:
    """The asked strategy, else MAP where the operator supports it by itself, else re-execution."""
    return asked or (MAP if "MAP" in modes else QUERY)
