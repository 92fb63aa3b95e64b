"""Declared schemas, keys and value rules of the retail source tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from cartflow.functions import checks


@dataclass(frozen=True)
class TableSpec:
    """A source table.

    `free_text` tells that a quoted value may hold line breaks: such a CSV file takes one more pass to be split across tasks.
    """

    name: str
    file: str
    schema: T.StructType
    keys: tuple[str, ...]
    nullable: tuple[str, ...] = ()
    free_text: bool = False
    rules: dict[str, Callable[[], Column]] = field(default_factory=dict, compare=False)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def casts(self) -> list[str]:
        return [f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in self.schema]

    @property
    def required(self) -> list[str]:
        return [name for name in self.columns if name not in self.nullable]


# The source layout of the retail tables and the bounds of their columns.
AISLES = {"aisle_id": "integer", "aisle": "string"}
DEPARTMENTS = {"department_id": "integer", "department": "string"}
PRODUCTS = {"product_id": "integer", "product_name": "string", "aisle_id": "integer", "department_id": "integer"}
ORDERS = {
    "order_id": "integer",
    "user_id": "integer",
    "eval_set": "string",
    "order_number": "integer",
    "order_dow": "integer",
    "order_hour_of_day": "integer",
    "days_since_prior_order": "double",
}
ORDER_PRODUCTS = {"order_id": "integer", "product_id": "integer", "add_to_cart_order": "integer", "reordered": "integer"}
LAYOUT = {
    "aisles": ("aisles.csv", AISLES, ("aisle_id",)),
    "departments": ("departments.csv", DEPARTMENTS, ("department_id",)),
    "products": ("products.csv", PRODUCTS, ("product_id",)),
    "orders": ("orders.csv", ORDERS, ("order_id",)),
    "order_products_prior": ("order_products__prior.csv", ORDER_PRODUCTS, ("order_id", "product_id")),
    "order_products_train": ("order_products__train.csv", ORDER_PRODUCTS, ("order_id", "product_id")),
}
EVAL_SETS = ("prior", "train", "test")
FLAGS = (0, 1)
WEEKDAYS = (0, 6)
HOURS = (0, 23)
GAP_DAYS = (0, 30)
MIN_KEY = 1

GAP = "days_since_prior_order"

# Rules are built late: columns need a running session.
Rule = Callable[[], Column]


def key(name: str) -> Rule:
    return lambda: checks.not_positive(name, MIN_KEY)


def text(name: str) -> Rule:
    return lambda: checks.blank(name)


ITEM_RULES = {
    "order_id": key("order_id"),
    "product_id": key("product_id"),
    "add_to_cart_order": key("add_to_cart_order"),
    "reordered": lambda: checks.not_in("reordered", FLAGS),
}
RULES: dict[str, dict[str, Rule]] = {
    "aisles": {"aisle_id": key("aisle_id"), "aisle": text("aisle")},
    "departments": {"department_id": key("department_id"), "department": text("department")},
    "products": {
        "product_id": key("product_id"),
        "product_name": text("product_name"),
        "aisle_id": key("aisle_id"),
        "department_id": key("department_id"),
    },
    "orders": {
        "order_id": key("order_id"),
        "user_id": key("user_id"),
        "eval_set": lambda: checks.not_in("eval_set", EVAL_SETS),
        "order_number": key("order_number"),
        "order_dow": lambda: checks.outside("order_dow", *WEEKDAYS),
        "order_hour_of_day": lambda: checks.outside("order_hour_of_day", *HOURS),
        GAP: lambda: checks.outside_or_nan(GAP, *GAP_DAYS),
        f"{GAP}_consistency": lambda: checks.gap_mismatch("order_number", GAP),
    },
    "order_products_prior": ITEM_RULES,
    "order_products_train": ITEM_RULES,
}


def declared_schema(columns: dict[str, str], id_type: str = "integer") -> T.StructType:
    schema = T.StructType()
    for name, kind in columns.items():
        schema = schema.add(name, id_type if name.endswith("_id") else kind, nullable=True)
    return schema


def table_specs(id_type: str = "integer") -> dict[str, TableSpec]:
    """All source tables by name. `id_type="long"` serves key ranges beyond 32 bits."""
    specs = {}
    for name, (file, columns, keys) in LAYOUT.items():
        specs[name] = TableSpec(
            name=name,
            file=file,
            schema=declared_schema(columns, id_type),
            keys=keys,
            nullable=tuple(column for column in columns if column == GAP),
            free_text=name in ("aisles", "departments", "products"),
            rules=RULES[name],
        )
    return specs
