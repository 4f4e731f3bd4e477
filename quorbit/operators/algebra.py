"""Sums of products of ladder operators, in driver Python; tables of masks for Spark."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quorbit.functions.bits import WORD_BITS, Narrow, Wide
from quorbit.functions.complex import TYPE

#: Merged terms with a coefficient this small vanish.
SMALLEST = 1e-8
Ladder = tuple[bool, int]  # creates, site


@dataclass(frozen=True)
class Product:
    ops: tuple[Ladder, ...] = ()

    def dagger(self) -> Product:
        return Product(tuple((not dag, site) for dag, site in reversed(self.ops)))

    @property
    def diagonal(self) -> bool:
        up = sorted(s for d, s in self.ops if d)
        return up == sorted(s for d, s in self.ops if not d)


def normal_order(ops: tuple[Ladder, ...], fermion: bool) -> dict[Product, float]:
    """Creations ascending, then annihilations descending, by (anti)commutation.

    Operators on different sites commute for hard-core bosons and anticommute
    for fermions; on one site a c+ = 1 - c+ c in both cases, and equal
    neighbours vanish.
    """
    out: dict[Product, float] = {}
    todo = [(list(ops), 1.0)]
    key = lambda op: (0, op[1]) if op[0] else (1, -op[1])
    while todo:
        held, sign = todo.pop()
        for i in range(len(held) - 1):
            a, b = held[i], held[i + 1]
            if a == b:
                break
            if key(a) > key(b):
                if a[1] == b[1]:
                    todo.append((held[:i] + held[i + 2 :], sign))
                    todo.append(([*held[:i], b, a, *held[i + 2 :]], -sign))
                else:
                    todo.append(([*held[:i], b, a, *held[i + 2 :]], -sign if fermion else sign))
                break
        else:
            p = Product(tuple(held))
            out[p] = out.get(p, 0.0) + sign
    return out


@dataclass
class Operator:
    """A sum of coefficient times product."""

    terms: dict[Product, complex] = field(default_factory=dict)
    fermion: bool = True

    def _with(self, pairs: Iterable[tuple[Product, complex]]) -> Operator:
        out: dict[Product, complex] = {}
        for p, c in pairs:
            out[p] = out.get(p, 0) + c
        return Operator({p: c for p, c in out.items() if abs(c) > SMALLEST}, self.fermion)

    def __add__(self, other: Operator) -> Operator:
        return self._with([*self.terms.items(), *other.terms.items()])

    def __neg__(self) -> Operator:
        return self * -1

    def __sub__(self, other: Operator) -> Operator:
        return self + -other

    def __mul__(self, other: Operator | complex) -> Operator:
        if isinstance(other, Operator):
            return self._with((Product(p.ops + q.ops), a * b) for p, a in self.terms.items() for q, b in other.terms.items())
        return self._with((p, c * other) for p, c in self.terms.items())

    __rmul__ = __mul__

    def dagger(self) -> Operator:
        return self._with((p.dagger(), c.conjugate()) for p, c in self.terms.items())

    def normal_ordered(self) -> Operator:
        return self._with((q, c * s) for p, c in self.terms.items() for q, s in normal_order(p.ops, self.fermion).items())

    def split(self) -> tuple[Operator, Operator]:
        """Diagonal and off-diagonal part."""
        diagonal = {p: c for p, c in self.terms.items() if p.diagonal}
        return Operator(diagonal, self.fermion), Operator({p: c for p, c in self.terms.items() if not p.diagonal}, self.fermion)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Operator) and not (self - other).terms

    __hash__ = None  # type: ignore[assignment]


def create(site: int, fermion: bool = True) -> Operator:
    return Operator({Product(((True, site),)): 1.0}, fermion)


def annihilate(site: int, fermion: bool = True) -> Operator:
    return Operator({Product(((False, site),)): 1.0}, fermion)


def identity(fermion: bool = True) -> Operator:
    return Operator({Product(): 1.0}, fermion)


def spin(kind: str, site: int) -> Operator:
    """Spin 1/2 on hard-core bosons, where an occupied site points down."""
    up, down = annihilate(site, False), create(site, False)  # s+, s-
    made = {
        "s+": lambda: up,
        "s-": lambda: down,
        "sx": lambda: (up + down) * 0.5,
        "sy": lambda: (up - down) * -0.5j,
        "sz": lambda: identity(False) * 0.5 - down * up,
    }
    return made[kind]()


TOKENS = {"c": annihilate, "cdag": create, "b": annihilate, "bdag": create}


def parse_operator(lines: Iterable[str]) -> Operator:
    """First value over 0: bosons or spins, else fermions; then ``coefficient (name site)*`` lines, ``#`` comments."""
    rows = [re.sub(r"#.*", "", line).split() for line in lines]
    rows = [r for r in rows if r]
    if not rows:
        raise ValueError("an operator file begins with its statistics")
    fermion = not float(rows[0][0]) > 0
    total = Operator({}, fermion)
    for row in rows[1:]:
        term = identity(fermion) * float(row[0])
        if len(row) % 2 == 0:
            raise ValueError(f"a name without a site: {' '.join(row)}")
        for name, site in zip(row[1::2], row[2::2], strict=True):
            term = term * (TOKENS[name](int(site), fermion) if name in TOKENS else spin(name, int(site)))
        total = total + term
    return total.normal_ordered()


def term_table(spark: SparkSession, operator: Operator, width: int | None = None) -> DataFrame:
    """Normal-ordered terms, greatest |coef| first: term_id, coef, create, annihilate (masks), ops, is_diag.

    Coefficients are structs of re and im where any has an imaginary part. Masks are
    as states of ``width`` sites are: arrays of words beyond ``WORD_BITS``.
    """
    rows, key = [], Wide() if width and width > WORD_BITS else Narrow()
    imaginary = any(abs(complex(c).imag) > SMALLEST for c in operator.normal_ordered().terms.values())
    for p, c in sorted(operator.normal_ordered().terms.items(), key=lambda x: (-abs(x[1]), x[0].ops)):
        up, down = (key.mask([s for d, s in p.ops if d is want], width or WORD_BITS) for want in (True, False))
        value = (float(complex(c).real), float(complex(c).imag)) if imaginary else float(complex(c).real)
        rows.append((len(rows), value, up, down, [{"dag": d, "site": s} for d, s in p.ops], p.diagonal))
    state = "array<bigint>" if isinstance(key, Wide) else "bigint"
    return spark.createDataFrame(rows, f"term_id int, coef {TYPE if imaginary else 'double'}, create {state}, annihilate {state}, ops array<struct<dag:boolean,site:int>>, is_diag boolean")
