"""Strict nested configurations: every fault of a JSON text, by path.

A specification says what a text may hold: records with exactly their keys, lists with
bounds and a key that may not repeat, numbers with ranges, texts, flags.  faults() walks
it over a variant and lists what is wrong, instead of ending at the first error:
unknown and missing keys, wrong types, values out of range, broken rules between
fields.  A text that is no JSON has the fault `no JSON`.  Only what a specification
names is looked at, whatever the size of the text.

A text is parsed once and each value in it is taken once, by let(): Spark works an
expression out anew at each of its places in a branch or a lambda.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shared import let

_NONE = "array<string>"
_NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


@dataclass(frozen=True)
class Number:
    low: float | None = None
    high: float | None = None
    #: Whether low itself is out of range.
    above: bool = False
    integer: bool = False
    nullable: bool = False


@dataclass(frozen=True)
class Text:
    nonempty: bool = False
    one_of: tuple[str, ...] = ()
    nullable: bool = False


@dataclass(frozen=True)
class Flag:
    nullable: bool = False


@dataclass(frozen=True)
class Record:
    keys: dict[str, Spec]
    optional: tuple[str, ...] = ()
    nullable: bool = False


@dataclass(frozen=True)
class Items:
    each: Spec
    least: int = 0
    most: int | None = None
    #: A key of the records in it that no two may share the value of.
    unique: str | None = None
    nullable: bool = False


Spec = Number | Text | Flag | Record | Items


@dataclass(frozen=True)
class Rule:
    """A fault between fields: `broken` of the whole variant; what can't be told is no fault."""

    message: str
    broken: Callable[[Column], Column] = field(compare=False)


def number(v: Column, path: str) -> Column:
    """A number at a path of a variant, null where there is none."""
    return F.try_variant_get(v, path, "double")


def _one(test: Column, path: Column, what: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.concat(path, F.lit(f": {what}")))).otherwise(F.array().cast(_NONE))


def _all(*parts: Column) -> Column:
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def _number(x: Column, v: Column, spec: Number, path: Column) -> Column:
    outside = F.lit(False)
    if spec.low is not None:
        outside |= (x <= spec.low) if spec.above else (x < spec.low)
    if spec.high is not None:
        outside |= x > spec.high
    wrong = _all(_one(x != F.floor(x), path, "not an integer") if spec.integer else F.array().cast(_NONE), _one(outside, path, "out of range"))
    return F.when(~F.schema_of_variant(v).rlike(_NUMBERS), _one(F.lit(True), path, "not a number")).otherwise(wrong)


def _record(held: Column, spec: Record, path: Column) -> Column:
    """held: the record's values by key."""

    def each(keys: Column) -> Column:
        parts = [F.transform(F.array_except(keys, F.array(*map(F.lit, spec.keys))), lambda k: F.concat(path, F.lit("."), k, F.lit(": unknown")))]
        for k, own in spec.keys.items():
            at = F.concat(path, F.lit(f".{k}"))
            absent = F.array().cast(_NONE) if k in spec.optional else _one(F.lit(True), at, "missing")
            parts.append(F.when(~F.array_contains(keys, k), absent).otherwise(_walk(F.element_at(held, F.lit(k)), own, at)))
        return _all(*parts)

    return let(F.map_keys(held), each)


def _items(items: Column, spec: Items, path: Column) -> Column:
    each = F.flatten(F.transform(items, lambda x, i: _walk(x, spec.each, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    size = F.size(items)
    parts = [each, _one((size < spec.least) | ((size > spec.most) if spec.most is not None else F.lit(False)), path, "wrong number of items")]
    if spec.unique:
        names = F.array_compact(F.transform(items, lambda x: F.try_variant_get(x, f"$.{spec.unique}", "string")))
        parts.append(let(names, lambda n: _one(F.size(F.array_distinct(n)) < F.size(n), path, f"repeated {spec.unique}")))
    return _all(*parts)


def _walk(v: Column, spec: Spec, path: Column) -> Column:
    return let(v, lambda v: _found(v, spec, path))


def _found(v: Column, spec: Spec, path: Column) -> Column:
    if isinstance(spec, Number):
        found = let(F.try_variant_get(v, "$", "double"), lambda x: _number(x, v, spec, path))
    elif isinstance(spec, Text):
        x = F.try_variant_get(v, "$", "string")
        wrong = [_one(F.trim(x) == "", path, "empty")] if spec.nonempty else []
        wrong += [_one(~x.isin(*spec.one_of), path, "not allowed")] if spec.one_of else []
        found = F.when(F.schema_of_variant(v) != "STRING", _one(F.lit(True), path, "not a text")).otherwise(_all(*wrong) if wrong else F.array().cast(_NONE))
    elif isinstance(spec, Flag):
        found = _one(F.schema_of_variant(v) != "BOOLEAN", path, "not a flag")
    else:
        # What is no record or list can't be taken as one, and is null then.
        kind, what, own = ("map<string,variant>", "not a record", _record) if isinstance(spec, Record) else ("array<variant>", "not a list", _items)
        found = let(F.try_variant_get(v, "$", kind), lambda held: F.when(held.isNull(), _one(F.lit(True), path, what)).otherwise(own(held, spec, path)))
    return F.when(F.is_variant_null(v), F.array().cast(_NONE) if spec.nullable else _one(F.lit(True), path, "null")).otherwise(found)


def faults(text: Column, spec: Spec, rules: list[Rule] | None = None, root: str = "configuration") -> Column:
    """array<string> of all faults of a JSON text, sorted; empty for a right one.  A null text has the fault `no JSON`."""

    def told(v: Column) -> Column:
        broken = [_one(r.broken(v), F.lit(root), r.message) for r in rules or []]
        return F.when(v.isNull(), F.array(F.lit(f"{root}: no JSON"))).otherwise(F.array_sort(_all(_found(v, spec, F.lit(root)), *broken)))

    return let(F.try_parse_json(text), told)


def accepted(text: Column, kind: str, wrong: Column) -> Column:
    """The text as a struct of a kind, where its list of faults is empty; else null."""
    return F.when(F.size(wrong) == 0, F.from_json(text, kind))
