"""Column functions on whole numbers as bit strings, residues, linear codes and keyed names; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def _wide(n: int) -> Column:
    """A literal beyond the range of a long."""
    return F.lit(str(n)).cast(WIDE)


def wrap(value: Column, bits: int) -> Column:
    """A whole number reduced to two's complement of the given width (sums of 64 bits come as decimals)."""
    half, full = 1 << (bits - 1), 1 << bits
    if bits >= 63:
        v = value.cast(WIDE)
        return (F.pmod(v + _wide(half), _wide(full)) - _wide(half)).cast("long")
    low = F.pmod(value, F.lit(full).cast("long"))  # adding half first could overflow
    return F.when(low >= half, low - F.lit(full).cast("long")).otherwise(low)


def unsigned(value: Column, bits: int) -> Column:
    """The value of the same bits read without a sign (a decimal from 64 bits on)."""
    return F.pmod(value.cast(WIDE), _wide(1 << bits)) if bits >= 63 else F.pmod(value.cast("long"), F.lit(1 << bits).cast("long"))


def sign_extend(value: Column, bits: int) -> Column:
    """The low bits of a long with the top one repeated above."""
    return F.shiftright(F.shiftleft(value.cast("long"), 64 - bits), 64 - bits)


def sign(value: Column) -> Column:
    return value < 0


def bit(value: Column, i: int | Column) -> Column:
    return F.getbit(value.cast("long"), F.lit(i) if isinstance(i, int) else i).cast("int")


def low_bits(value: Column, bits: int) -> Column:
    """The value without what is above its width."""
    return value if bits >= 64 else value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def equal_bits(a: Column, b: Column, bits: int) -> Column:
    return low_bits(a, bits) == low_bits(b, bits)


def is_zero(value: Column, bits: int = 64) -> Column:
    """1 if all of the low bits are 0."""
    return F.when(low_bits(value.cast("long"), bits) == 0, 1).otherwise(0)


def bit_count(value: Column) -> Column:
    return F.bit_count(value.cast("long")).cast("long")


def negated(value: Column) -> Column:
    return F.bitwise_not(value)


def inject_bits(bits: Sequence[Column]) -> Column:
    """Bits, the lowest first, as one whole number."""
    out = F.lit(0).cast("long")
    for i, b in enumerate(bits):
        out = out + F.shiftleft(b.cast("long"), i)
    return out


def to_words(data: Column, size: int) -> Column:
    """The bytes of a binary as an array of unsigned whole numbers of ``size`` bytes (1, 2, 4), the lowest byte first; an error where they don't fill it."""
    if size not in (1, 2, 4):
        raise ValueError("a word has 1, 2 or 4 bytes")
    checked = F.when(F.length(data) % size == 0, data).otherwise(F.raise_error(F.lit(f"not a multiple of {size} bytes")).cast("binary"))
    parts = F.filter(F.split(F.regexp_replace(F.hex(checked), f"(.{{{2 * size}}})", "$1,"), ","), lambda x: x != "")
    return F.transform(parts, lambda x: F.conv(F.concat(*[F.substring(x, 2 * k + 1, 2) for k in reversed(range(size))]), 16, 10).cast("long"))


def from_words(words: Column, size: int) -> Column:
    """The inverse of ``to_words``."""
    one = lambda w: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(w, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)])
    return F.unhex(F.concat_ws("", F.transform(words, one)))


def cast_words(words: Column, size: int, to: int) -> Column:
    """The same bytes as words of another size."""
    return to_words(from_words(words, size), to)


#: The gates of a bit circuit, over whole words at once.
GATES = {
    "a": lambda a, b: a,
    "and": lambda a, b: a.bitwiseAND(b),
    "nand": lambda a, b: F.bitwise_not(a.bitwiseAND(b)),
    "or": lambda a, b: a.bitwiseOR(b),
    "nor": lambda a, b: F.bitwise_not(a.bitwiseOR(b)),
    "na_and": lambda a, b: F.bitwise_not(a).bitwiseAND(b),
    "nb_and": lambda a, b: a.bitwiseAND(F.bitwise_not(b)),
    "nb_or": lambda a, b: a.bitwiseOR(F.bitwise_not(b)),
    "xor": lambda a, b: a.bitwiseXOR(b),
    "nxor": lambda a, b: F.bitwise_not(a.bitwiseXOR(b)),
}


def circuit(gates: Sequence[tuple[str, int, int]], inputs: Sequence[Column]) -> list[Column]:
    """All wires of a circuit: the inputs, then one for each gate (name, wire, wire)."""
    wires = [c.cast("long") for c in inputs]
    for name, a, b in gates:
        if name not in GATES:
            raise ValueError(f"no gate {name!r}")
        wires.append(GATES[name](wires[a], wires[b]))
    return wires


def inline(gates: Sequence[tuple[str, int, int]], inputs: Sequence[Column], outputs: Sequence[int]) -> list[Column]:
    """A circuit as a part of another: the columns of its output wires, to be inputs there."""
    wires = circuit(gates, inputs)
    return [wires[i] for i in outputs]


def multiplex(choice: Column, if_true: Column, if_false: Column) -> Column:
    return F.when(choice, if_true).otherwise(if_false)


def transpose(df: DataFrame, value: str, bits: int) -> DataFrame:
    """One row (bit_idx, bit) for each bit of each value, with the other columns."""
    index = F.explode(F.sequence(F.lit(0), F.lit(bits - 1)))
    return df.withColumn("bit_idx", index).withColumn("bit", F.getbit(F.col(value).cast("long"), F.col("bit_idx")).cast("long"))


def mod3_add(a: Column, b: Column) -> Column:
    return F.pmod(F.pmod(a, F.lit(3)) + F.pmod(b, F.lit(3)), F.lit(3))


def mod3_sub(a: Column, b: Column) -> Column:
    return F.pmod(F.pmod(a, F.lit(3)) - F.pmod(b, F.lit(3)), F.lit(3))


def mod3_sample(seed: int, *keys: Column) -> Column:
    """A residue that seed and keys decide, so that a recomputed task agrees."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(3)).cast("int")


def f2_code(value: Column, rows: Sequence[int]) -> list[Column]:
    """The bits of a matrix over two elements times a bit vector: for each matrix row the parity of the common bits."""
    return [(F.bit_count(value.cast("long").bitwiseAND(F.lit(r).cast("long"))) % 2).cast("long") for r in rows]


def keyed_name(value: Column, key: str) -> Column:
    """A pseudonym of a value under a key (a plain keyed digest; no claim of privacy)."""
    return F.sha2(F.concat(F.lit(key), F.lit(":"), value.cast("string")), 256)


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def shuffle_index(i: Column, n: int) -> Column:
    """Where element i of n goes when two halves are interleaved (the first half gets the even places)."""
    half = (n + 1) // 2
    return F.when(i < half, 2 * i).otherwise(2 * (i - half) + 1)


def unshuffle_index(i: Column, n: int) -> Column:
    """The inverse of ``shuffle_index``."""
    half = (n + 1) // 2
    return F.when(i % 2 == 0, F.floor(i / 2)).otherwise(F.lit(half) + F.floor(i / 2)).cast("long")
