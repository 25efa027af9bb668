"""JSON documents against a contract table: typed records of those that keep it, and every fault of the others.

A document becomes a VARIANT once; each line of the contract looks up its path there and tests the kind of what it
finds. Nothing is joined or exploded until faults are listed, so a document is one row on the way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources.scratch import kept


@dataclass(frozen=True)
class Field:
    """A field of an object: its kind (string, number, boolean, object, array) and further rules.

    An array has the kind of its items in `items`, and their fields in `fields` where they are objects; null passes
    only where it may (`nullable`), and a missing field only where it need not be there (`optional`).
    """

    name: str
    kind: str
    nullable: bool = False
    optional: bool = False
    least: float | None = None
    among: tuple[str, ...] = ()
    items: str = ""
    fields: tuple[Field, ...] = ()


# The contract of a saved plan.
PLAN = (
    Field("budgetAnalysis", "string"),
    Field("estimatedCost", "number"),
    Field("safetyMargin", "number"),
    Field("status", "string", among=("comfortable", "optimized", "critical", "too_low")),
    Field("recommendedBudget", "number", nullable=True),
    Field("minimumBudget", "number", nullable=True),
    Field("mealPlan", "array", items="object", fields=(Field("day", "string"), Field("breakfast", "string"), Field("lunch", "string"), Field("dinner", "string"))),
    Field("groceryList", "array", items="object", fields=(Field("name", "string"), Field("quantity", "string"), Field("estimatedCost", "number", least=0), Field("category", "string"))),
    Field("savingTips", "array", items="string"),
)
PLAN_TYPE = """struct<budgetAnalysis: string, estimatedCost: double, safetyMargin: double, status: string, recommendedBudget: double, minimumBudget: double,
  mealPlan: array<struct<day: string, breakfast: string, lunch: string, dinner: string>>, groceryList: array<struct<name: string, quantity: string, estimatedCost: double, category: string>>, savingTips: array<string>>"""

FAULTS = "array<struct<path: string, reason: string>>"
_KINDS = {"string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), value being worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _fault(path: Column, reason: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(reason).alias("reason")))


def _faults(at: Column, value: Column, field: Field) -> Column:
    """The faults of one value (null: it is missing) at a path; of its items and their fields too."""
    none = F.array().cast(FAULTS)
    missing, wrong = none if field.optional else _fault(at, "missing"), _fault(at, f"expected {field.kind}")
    null = none if field.nullable else wrong
    if field.kind == "object" or field.kind == "array" and field.items:
        # read one level deep: its kind shows by whether that works, without a walk through all it holds
        parts = F.try_variant_get(value, "$", "map<string,variant>" if field.kind == "object" else "array<variant>")
        inner = _of_object if field.kind == "object" else _of_array
        tested = lambda got: F.when(got.isNotNull(), inner(at, got, field)).when(value.isNull(), missing).when(F.is_variant_null(value), null).otherwise(wrong)
        return _let(parts, tested)
    inner = none
    if field.among:
        inner = F.when(F.try_variant_get(value, "$", "string").isin(*field.among), none).otherwise(_fault(at, "not one of " + ", ".join(field.among)))
    elif field.least is not None:
        inner = F.when(F.try_variant_get(value, "$", "double") >= field.least, none).otherwise(_fault(at, f"below {field.least:g}"))
    kind = lambda said: reduce(lambda a, b: a | b, (said.startswith(k) for k in _KINDS[field.kind]))
    return _let(F.schema_of_variant(value), lambda said: F.when(said.isNull(), missing).when(kind(said), inner).when(said == "VOID", null).otherwise(wrong))


def _of_array(at: Column, values: Column, field: Field) -> Column:
    item = Field("", field.items, fields=field.fields)
    return F.flatten(F.transform(values, lambda v, i: _faults(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), v, item)))


def _of_object(at: Column, values: Column, field: Field) -> Column:
    own = lambda f: _let(F.try_element_at(values, F.lit(f.name)), lambda v: _faults(F.concat(at, F.lit(f".{f.name}")), v, f))
    return F.flatten(F.array(*[own(f) for f in field.fields]))


def checked(texts: DataFrame, contract: Sequence[Field], kind: str) -> tuple[DataFrame, DataFrame]:
    """(id, record of the given type) of the documents (id, document) that keep the contract, and (id, path, reason) of each fault.

    Every document is in one of the two: a null document, one that is no JSON and one that is no object have a fault
    at $. Fields that the contract lacks are let go.
    """
    value = texts.select("id", F.try_parse_json("document").alias("value"))
    faults = _faults(F.lit("$"), F.col("value"), Field("", "object", fields=tuple(contract)))
    whole = value.select("id", "value", F.when(F.col("value").isNull(), _fault(F.lit("$"), "no JSON")).otherwise(faults).alias("faults"))
    tested = kept(whole.select("id", "faults", F.when(F.size("faults") == 0, F.variant_get("value", "$", kind)).alias("record")))
    good = tested.where(F.size("faults") == 0).select("id", "record")
    return good, tested.select("id", F.explode("faults").alias("f")).select("id", "f.path", "f.reason")
