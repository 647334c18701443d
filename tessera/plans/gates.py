"""The predicate language: a list of binary gates over columns, literals and earlier gates, compiled to one Column.

Operands are numbered: first the input columns, then the literals, then the gates' results. Gate i writes the i-th number
after columns and literals, so the list is in order; the last gate is the predicate and must be boolean.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bits import low_bits, wrap
from tessera.plans.schema import Kind, Schema


class Op(IntEnum):
    """Operations by number."""

    EQUALS = 1
    NOT_EQUALS = 2
    AND = 3
    OR = 4
    ADDITION = 5
    LESS_THAN = 6
    GREATER_THAN_EQUALS = 7
    XOR = 8


@dataclass(frozen=True)
class Gate:
    op: Op
    left: int
    right: int
    out: int


@dataclass(frozen=True)
class Operand:
    column: Column
    kind: Kind
    bits: int


#: Spellings of a boolean literal.
BOOLEANS = {"1": True, "true": True, "0": False, "false": False}


def signed_bits(value: int) -> int:
    """The least width that holds a whole number in two's complement."""
    return (value if value >= 0 else ~value).bit_length() + 1


def literal(text: str, kind: Kind) -> Operand:
    """The operand of a literal's text."""
    if kind == Kind.INT:
        value = int(text)
        if not -(2**63) <= value < 2**63:
            raise ValueError(f"{text} has more than 64 bits")
        return Operand(F.lit(value).cast("long"), kind, signed_bits(value))
    if kind == Kind.BOOLEAN:
        if text not in BOOLEANS:
            raise ValueError(f"{text!r} is no boolean")
        return Operand(F.lit(BOOLEANS[text]), kind, 1)
    if kind == Kind.STRING:
        return Operand(F.lit(text), kind, max(8, 8 * len(text.encode())))
    data = bytes.fromhex(text)
    return Operand(F.lit(data), kind, max(1, 8 * len(data)))


def bits_of(a: Operand, bits: int) -> Column:
    """The bits of an operand as hex of its bytes, the lowest first, filled up to a width: whole numbers by their sign, others with zeros."""
    size = -(-bits // 8)
    if a.kind in (Kind.STRING, Kind.BIN):
        return F.rpad(F.hex(a.column.cast("binary") if a.kind == Kind.STRING else a.column), 2 * size, "0")
    if a.bits > 64:
        raise TypeError("whole numbers of more than 64 bits are compared with their kind only")
    value = a.column.cast("int").cast("long") if a.kind == Kind.BOOLEAN else a.column.cast("long")
    word = F.lpad(F.hex(low_bits(value, bits)), 16, "0")
    low = F.concat(*[F.substring(word, 15 - 2 * i, 2) for i in range(min(size, 8))])
    if size <= 8:
        return low
    rest, top = size - 8, bits % 8  # of a width that ends inside a byte the bits above are zero
    fill = "FF" * (rest - bool(top)) + (f"{2**top - 1:02X}" if top else "")
    return F.concat(low, F.when(value < 0, F.lit(fill)).otherwise(F.lit("00" * rest)))


def apply(op: Op, a: Operand, b: Operand) -> Operand:
    """The result of one gate. Operands of different kinds are equal if their bits are, at the greater of their widths."""
    bits = max(a.bits, b.bits)
    if op in (Op.EQUALS, Op.NOT_EQUALS):
        x, y = (a.column, b.column) if a.kind == b.kind else (bits_of(a, bits), bits_of(b, bits))
        return Operand(x == y if op == Op.EQUALS else x != y, Kind.BOOLEAN, 1)
    if op in (Op.AND, Op.OR, Op.XOR):
        if a.kind != Kind.BOOLEAN or b.kind != Kind.BOOLEAN:
            raise TypeError(f"{op.name} needs booleans")
        return Operand({Op.AND: a.column & b.column, Op.OR: a.column | b.column, Op.XOR: a.column != b.column}[op], Kind.BOOLEAN, 1)
    if a.kind != Kind.INT or b.kind != Kind.INT:
        raise TypeError(f"{op.name} needs whole numbers")
    if op == Op.ADDITION:
        return Operand(wrap(a.column.cast("decimal(38,0)") + b.column.cast("decimal(38,0)") if bits >= 64 else a.column.cast("long") + b.column.cast("long"), bits), Kind.INT, bits)
    return Operand(a.column < b.column if op == Op.LESS_THAN else a.column >= b.column, Kind.BOOLEAN, 1)


def compile_gates(schema: Schema, gates: Sequence[Gate], inputs: Sequence[str], literals: Sequence[str] = (), kinds: Sequence[Kind] = ()) -> Column:
    """The predicate that a gate list stands for."""
    if len(literals) != len(kinds):
        raise ValueError("every literal needs a kind")
    if not gates:
        raise ValueError("a predicate needs a gate")
    slots = [Operand(F.col(schema[n].name), schema[n].kind, schema[n].bits) for n in inputs]
    slots += [literal(t, k) for t, k in zip(literals, kinds)]
    for g in gates:
        if g.out != len(slots):
            raise ValueError(f"gate must write operand {len(slots)}, not {g.out}")
        if not (0 <= g.left < len(slots) and 0 <= g.right < len(slots)):
            raise ValueError("gates read earlier operands only")
        slots.append(apply(Op(g.op), slots[g.left], slots[g.right]))
    if slots[-1].kind != Kind.BOOLEAN:
        raise TypeError("the last gate must be boolean")
    return slots[-1].column


class Builder:
    """Writes gate lists by name, with the operations that are no gates composed of those that are."""

    def __init__(self, schema: Schema, *inputs: str):
        self.schema, self.inputs = schema, list(inputs)
        self._literals: list[tuple[str, Kind]] = []
        self._gates: list[tuple[Op, object, object]] = []

    def col(self, name: str) -> tuple[str, int]:
        return "c", self.inputs.index(name)

    def lit(self, text: str, kind: Kind) -> tuple[str, int]:
        self._literals.append((text, kind))
        return "l", len(self._literals) - 1

    def gate(self, op: Op, a, b) -> tuple[str, int]:
        self._gates.append((op, a, b))
        return "g", len(self._gates) - 1

    def greater(self, a, b):
        return self.gate(Op.LESS_THAN, b, a)

    def less_equals(self, a, b):
        return self.gate(Op.GREATER_THAN_EQUALS, b, a)

    def negate(self, a):
        return self.gate(Op.XOR, a, self.lit("true", Kind.BOOLEAN))

    def between(self, a, low, high):
        return self.gate(Op.AND, self.gate(Op.GREATER_THAN_EQUALS, a, low), self.less_equals(a, high))

    def is_in(self, a, values: list):
        out = self.gate(Op.EQUALS, a, values[0])
        for v in values[1:]:
            out = self.gate(Op.OR, out, self.gate(Op.EQUALS, a, v))
        return out

    def build(self) -> tuple[list[Gate], list[str], list[str], list[Kind]]:
        first = {"c": 0, "l": len(self.inputs), "g": len(self.inputs) + len(self._literals)}
        at = lambda x: first[x[0]] + x[1]
        gates = [Gate(op, at(a), at(b), first["g"] + i) for i, (op, a, b) in enumerate(self._gates)]
        return gates, self.inputs, [t for t, _ in self._literals], [k for _, k in self._literals]

    def compile(self) -> Column:
        gates, inputs, literals, kinds = self.build()
        return compile_gates(self.schema, gates, inputs, literals, kinds)
