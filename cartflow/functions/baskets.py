"""Expressions over item arrays and rules."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_of(item: str) -> dict[str, Column]:
    """The aggregate that gathers a set as `items`, ascending."""
    return {"items": F.sort_array(F.collect_set(item))}


# Codes per number of a set of bits; the sign is left alone.
WORD_BITS = 63


def _words(codes: range) -> list[range]:
    return [codes[i : i + WORD_BITS] for i in range(0, len(codes), WORD_BITS)]


def bit_columns(codes: range) -> list[str]:
    return [f"bits_{n}" for n in range(len(_words(codes)))]


def set_bits(item: str, codes: range) -> dict[str, Column]:
    """Aggregates that gather a set of `codes` as bits, in one number per `WORD_BITS` codes."""
    one = F.lit(1).cast("long")

    def bit(word: range) -> Column:
        place = F.call_function("shiftleft", one, (F.col(item) - word.start).cast("int"))
        return F.when(F.col(item).between(word.start, word.stop - 1), place)

    return {name: F.bit_or(bit(word)) for name, word in zip(bit_columns(codes), _words(codes))}


def items_of_bits(codes: range, kind: str = "int") -> Column:
    """The codes, ascending, whose bits `set_bits` has gathered."""
    held = [
        F.when(F.col(name).bitwiseAND(F.lit(1 << place).cast("long")) != 0, F.lit(code).cast(kind))
        for name, word in zip(bit_columns(codes), _words(codes))
        for place, code in enumerate(word)
    ]
    return F.array_compact(F.array(*held).cast(f"array<{kind}>"))


def count_of_bits(codes: range) -> Column:
    counts = [F.coalesce(F.bit_count(name), F.lit(0)) for name in bit_columns(codes)]
    return reduce(add, counts, F.lit(0))


def config_id(min_support: float, min_confidence: float) -> str:
    return f"s{min_support:g}_c{min_confidence:g}"


def rule_id(antecedent="antecedent", consequent="consequent") -> Column:
    """SHA-256 of the JSON text of both sides, which must be sorted."""
    sides = F.struct(F.col(antecedent).alias("antecedent"), F.col(consequent).alias("consequent"))
    return F.sha2(F.to_json(sides), 256)


def rule_label(antecedent="antecedent_names", consequent="consequent_names") -> Column:
    """`a, b → c`"""
    return F.concat(F.array_join(antecedent, ", "), F.lit(" → "), F.array_join(consequent, ", "))


def has_repeats(name: str) -> Column:
    return F.size(F.array_distinct(name)) != F.size(name)


def overlaps(left: str, right: str) -> Column:
    return F.size(F.array_intersect(left, right)) > 0


def contains_all(items: str, wanted: str) -> Column:
    return F.forall(F.col(wanted), lambda item: F.array_contains(F.col(items), item))
