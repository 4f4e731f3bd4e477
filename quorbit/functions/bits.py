"""Bit-key expressions. A basis state is a BIGINT of at most 62 bits; bit i is site i, and text has the highest site first.

Wider states are arrays of 62-bit words, least significant word first. ``keys`` gives
what operators need of a state for either kind, so that they are written once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

WORD_BITS = 62
MASK64 = (1 << 64) - 1


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bit(i: Column | int) -> Column:
    """1 << i as BIGINT."""
    return F.lit(1 << i) if isinstance(i, int) else F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def to_text(det: Column | str, width: int) -> Column:
    return F.lpad(F.bin(col(det)), width, "0")


def from_text(text: Column | str, width: int | None = None) -> Column:
    """BIGINT of a 0/1 text; with ``width``, other lengths and characters raise an error."""
    text = col(text)
    value = F.conv(text, 2, 10).cast("long")
    if width is None:
        return value
    return F.when(text.rlike(f"^[01]{{{width}}}$"), value).otherwise(F.raise_error(F.concat(F.lit(f"not a bit string of {width}: "), text)).cast("long"))


def words_from_text(text: Column | str, width: int, word_bits: int = WORD_BITS) -> Column:
    """Array of words, least significant first."""
    text, cuts = col(text), range(0, width, word_bits)
    parts = [F.conv(F.substring(text, max(width - at - word_bits, 0) + 1, min(word_bits, width - at)), 2, 10).cast("long") for at in cuts]
    return F.array(*parts)


def words_to_text(words: Column | str, width: int, word_bits: int = WORD_BITS) -> Column:
    words, n = col(words), -(-width // word_bits)
    return F.concat(*[F.lpad(F.bin(F.get(words, F.lit(i))), min(word_bits, width - i * word_bits), "0") for i in reversed(range(n))])


def advanced(det: Column | str, width: int) -> Column:
    """The next state in order, which after the last one begins again with none occupied; words carry over."""
    det = col(det)
    none = F.struct(F.array().cast("array<bigint>").alias("words"), F.lit(1).cast("long").alias("carry"))

    def step(held: Column, word: Column) -> Column:
        total = word + held["carry"]
        return F.struct(F.concat(held["words"], F.array(total.bitwiseAND(F.lit((1 << WORD_BITS) - 1)))).alias("words"), F.shiftright(total, WORD_BITS).alias("carry"))

    made = F.aggregate(det, none, step, lambda held: held["words"])
    top = (1 << (width - 1) % WORD_BITS + 1) - 1
    return F.transform(made, lambda x, k: F.when(k == -(-width // WORD_BITS) - 1, x.bitwiseAND(F.lit(top))).otherwise(x))


def change_word_bits(words: Column | str, width: int, old: int, new: int) -> Column:
    return words_from_text(words_to_text(words, width, old), width, new)


def word_order(words: Column | str) -> Column:
    """Sort key of an array state: the most significant word decides first."""
    return F.reverse(col(words))


def occupied_at(det: Column | str, i: Column | int) -> Column:
    return F.getbit(col(det), F.lit(i) if isinstance(i, int) else i)


def set_bit(det: Column | str, i: int, value: int) -> Column:
    return col(det).bitwiseOR(bit(i)) if value else col(det).bitwiseAND(F.lit(~(1 << i)))


def n_set(det: Column | str) -> Column:
    return F.bit_count(col(det))


def sites(det: Column | str, width: int, value: int = 1) -> Column:
    """Sites that are occupied (or, with 0, open), ascending."""
    det = col(det)
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(det, i) == value)


def few_sites(det: Column | str, width: int) -> Column:
    """As ``sites`` of occupied ones, without a look at each site where two are occupied at most."""
    held = col(det).bitwiseAND(F.lit((1 << width) - 1))
    lowest, rest = lambda x: F.bit_count(x.bitwiseAND(-x) - 1), held.bitwiseAND(held - 1)
    count = F.bit_count(held)
    return F.when(count == 1, F.array(lowest(held))).when(count == 2, F.array(lowest(held), lowest(rest))).otherwise(sites(det, width))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def created(bra: Column | str, ket: Column | str, width: int) -> Column:
    """Sites of the bra that the ket has not."""
    return sites(col(bra).bitwiseAND(F.bitwise_not(col(ket))), width)


def minus_one_if(n: Column) -> Column:
    return (1 - 2 * n.bitwiseAND(F.lit(1))).cast("int")


def between_mask(start: Column, end: Column) -> Column:
    """Bits strictly between two sites, in either order."""
    low, high = F.least(start, end), F.greatest(start, end)
    return (bit(high) - 1).bitwiseAND(F.bitwise_not(bit(low + 1) - 1))


def parity(det: Column | str, start: Column, end: Column) -> Column:
    """Sign of the occupied sites strictly between two."""
    return minus_one_if(F.bit_count(col(det).bitwiseAND(between_mask(start, end))))


def string_sign(det: Column | str, site: Column) -> Column:
    """Jordan-Wigner sign: of the occupied sites below."""
    return minus_one_if(F.bit_count(col(det).bitwiseAND(bit(site) - 1)))


class Narrow:
    """States that are one BIGINT."""

    width = WORD_BITS

    def sites(self, det: Column | str, width: int | None = None, value: int = 1) -> Column:
        return sites(det, width or WORD_BITS, value)

    def few_sites(self, det: Column | str, width: int) -> Column:
        return few_sites(det, width)

    def has(self, det: Column | str, site: Column) -> Column:
        return F.getbit(col(det), site) == 1

    def flip(self, det: Column | str, *at: Column) -> Column:
        return reduce(lambda d, site: d.bitwiseXOR(bit(site)), at, col(det))

    def parity(self, det: Column | str, start: Column, end: Column) -> Column:
        return parity(det, start, end)

    def string_sign(self, det: Column | str, site: Column) -> Column:
        return string_sign(det, site)

    def differ(self, a: Column | str, b: Column | str) -> Column:
        return hamming(a, b)

    def holds(self, det: Column, mask: Column) -> Column:
        return det.bitwiseAND(mask) == mask

    def minus(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(F.bitwise_not(b))

    def apart(self, a: Column, b: Column) -> Column:
        return a.bitwiseAND(b) == 0

    def join(self, a: Column, b: Column) -> Column:
        return a.bitwiseOR(b)

    def ends(self, mask: Column) -> tuple[Column, Column]:
        """The lowest and the highest site of a mask; -1 for an empty one."""
        low = F.when(mask == 0, -1).otherwise(F.bit_count(mask.bitwiseAND(-mask) - 1))
        return low.cast("int"), F.when(mask == 0, -1).otherwise(F.length(F.bin(mask)) - 1).cast("int")

    def mask(self, at: list[int], width: int) -> int | list[int]:
        return sum(1 << i for i in at)


class Wide(Narrow):
    """States that are arrays of words. Arrays are keys of joins and sums as they are."""

    def sites(self, det: Column | str, width: int | None = None, value: int = 1) -> Column:
        det = col(det)
        last = F.size(det) * WORD_BITS - 1 if width is None else F.lit(width - 1)
        return F.filter(F.sequence(F.lit(0), last), lambda i: F.getbit(F.get(det, F.floor(i / WORD_BITS).cast("int")), i % WORD_BITS) == value)

    def few_sites(self, det: Column | str, width: int) -> Column:
        return self.sites(det, width)

    def has(self, det: Column | str, site: Column) -> Column:
        return F.getbit(F.get(col(det), F.floor(site / WORD_BITS).cast("int")), site % WORD_BITS) == 1

    def flip(self, det: Column | str, *at: Column) -> Column:
        def word(x: Column, k: Column) -> Column:
            return reduce(lambda d, site: F.when(F.floor(site / WORD_BITS) == k, d.bitwiseXOR(bit(site % WORD_BITS))).otherwise(d), at, x)

        return F.transform(col(det), word)

    def _below(self, site: Column, k: Column) -> Column:
        """Of word k, the bits under a site."""
        return bit(F.least(F.greatest(site - k * WORD_BITS, F.lit(0)), F.lit(WORD_BITS))) - 1

    def _count(self, words: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda n, x: n + F.bit_count(x))

    def parity(self, det: Column | str, start: Column, end: Column) -> Column:
        low, high = F.least(start, end), F.greatest(start, end)
        between = F.transform(col(det), lambda x, k: x.bitwiseAND(self._below(high, k)).bitwiseAND(F.bitwise_not(self._below(low + 1, k))))
        return minus_one_if(self._count(between))

    def string_sign(self, det: Column | str, site: Column) -> Column:
        return minus_one_if(self._count(F.transform(col(det), lambda x, k: x.bitwiseAND(self._below(site, k)))))

    def differ(self, a: Column | str, b: Column | str) -> Column:
        return self._count(F.zip_with(col(a), col(b), lambda x, y: x.bitwiseXOR(y)))

    def holds(self, det: Column, mask: Column) -> Column:
        return F.zip_with(det, mask, lambda x, y: x.bitwiseAND(y)) == mask

    def minus(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))

    def apart(self, a: Column, b: Column) -> Column:
        return self._count(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))) == 0

    def join(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))

    def ends(self, mask: Column) -> tuple[Column, Column]:
        held = self.sites(mask)
        return F.coalesce(F.array_min(held), F.lit(-1)).cast("int"), F.coalesce(F.array_max(held), F.lit(-1)).cast("int")

    def mask(self, at: list[int], width: int) -> int | list[int]:
        return [sum(1 << i - low for i in at if low <= i < low + WORD_BITS) for low in range(0, width, WORD_BITS)]


def keys(states: DataFrame, name: str = "det") -> Narrow:
    """What a table's states are."""
    return Wide() if isinstance(states.schema[name].dataType, ArrayType) else Narrow()


def spread(half: Column | str, width: int, offset: int) -> Column:
    """Bit i of a half state to bit 2i + offset."""
    half = col(half)
    terms = [F.shiftleft(half.bitwiseAND(F.lit(1 << i)), i + offset) for i in range(width)]
    return reduce(Column.bitwiseOR, terms)


def interleave(alpha: Column | str, beta: Column | str, width: int) -> Column:
    return spread(alpha, width, 0).bitwiseOR(spread(beta, width, 1))


def interleave_words(alpha: Column | str, beta: Column | str, width: int) -> Column:
    """Halves of at most 62 orbitals, which may be more than 31, to an array of words."""
    half = WORD_BITS // 2
    part = lambda x, at: F.shiftright(col(x), at).bitwiseAND(F.lit((1 << min(half, width - at)) - 1))
    return F.array(*[interleave(part(alpha, at), part(beta, at), min(half, width - at)) for at in range(0, width, half)])


def gather(det: Column | str, width: int, offset: int) -> Column:
    """Bit 2i + offset to bit i."""
    det = col(det)
    terms = [F.shiftright(det.bitwiseAND(F.lit(1 << (2 * i + offset))), i + offset) for i in range(width)]
    return reduce(Column.bitwiseOR, terms)


def alpha_of(det: Column | str, width: int) -> Column:
    return gather(det, width, 0)


def beta_of(det: Column | str, width: int) -> Column:
    return gather(det, width, 1)


def half_states(basis: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct halves with the number of states that have each: (adet, n) and (bdet, n)."""
    both = basis.select(alpha_of("det", width).alias("adet"), beta_of("det", width).alias("bdet"))
    return tuple(both.groupBy(h).agg(F.count("*").alias("n")) for h in ("adet", "bdet"))


def pair_index(i: Column, j: Column) -> Column:
    """Place of an unordered pair in the lower triangle."""
    high, low = F.greatest(i, j), F.least(i, j)
    return (F.shiftright(high * (high - 1), 1) + low).cast("long")


def unit_random(seed: int, stream: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Uniform [0, 1) numbers that depend on seed, stream and counter alone; counter-based, so any layout gives the same.

    The mixing is splitmix64's, with its published multipliers and shifts as fixed values.
    """
    x = np.uint64(seed & MASK64) ^ (stream.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ (counter.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def key_random(seed: int, *keys: Column) -> Column:
    """Uniform (-1, 1) by key, from 53 bits of a hash, the same however the rows lie."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) * F.lit(2.0**-52) - 1


def padded(number: Column | str, width: int = 6) -> Column:
    return F.lpad(col(number).cast("string"), width, "0")


def extension(path: Column | str) -> Column:
    return F.when(F.instr(col(path), ".") > 0, F.substring_index(col(path), ".", -1)).otherwise("")


def without_extension(path: Column | str) -> Column:
    return F.regexp_replace(col(path), "\\.[^.]*$", "")
