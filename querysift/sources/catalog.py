"""The model catalog that findings resolve against: a small list kept on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .captures import ORDER_COLUMNS, PART_COLUMNS


@dataclass(frozen=True)
class Field:
    """A field; `related` names the target table, `through` the joining table of a many-to-many field."""

    name: str
    attname: str = ""
    primary_key: bool = False
    db_index: bool = False
    unique: bool = False
    large: bool = False
    related: str | None = None
    accessor: str | None = None
    through: str | None = None

    @property
    def column(self) -> str:
        return self.attname or self.name


@dataclass(frozen=True)
class Model:
    """A model; `indexes`, `unique_together` and `constraints` (unique ones) list the fields of each."""

    app: str
    name: str
    table: str
    fields: tuple[Field, ...]
    indexes: tuple[tuple[str, ...], ...] = ()
    unique_together: tuple[tuple[str, ...], ...] = ()
    constraints: tuple[tuple[str, ...], ...] = ()


def indexed(model: Model, name: str) -> bool:
    """Whether an index serves a field, given by its own name or its column's; a field that is not known counts as
    served. In the names of an index's fields a trailing _id does not count."""
    own = next((f for f in model.fields if name in (f.name, f.column)), None)
    if own is None or own.primary_key or own.db_index or own.unique or (own.related and not own.through):
        return True
    return any(name in (x.removesuffix("_id") for x in names) for names in model.indexes) or any(name in names for names in (*model.unique_together, *model.constraints))


def _plain(names: tuple[str, ...], large: tuple[str, ...] = ()) -> tuple[Field, ...]:
    return tuple(Field(x, primary_key=x == "id", large=x in large) for x in names)


#: The shop's models, in registry order: the first match wins everywhere.
SHOP = (
    Model("shop", "Order", "shop_order", (*_plain(tuple(x for x in ORDER_COLUMNS if x != "customer_id")), Field("customer", "customer_id", related="shop_customer", accessor="orders"))),
    Model("shop", "Customer", "shop_customer", _plain(("id", "name"))),
    Model("shop", "Line", "shop_line", (*_plain(("id", "qty")), Field("order", "order_id", related="shop_order", accessor="lines"))),
    Model("shop", "Part", "shop_part", (*_plain(PART_COLUMNS, ("comment",)), Field("tags", related="shop_tag", through="shop_part_tags"))),
    Model("shop", "Tag", "shop_tag", _plain(("id",))),
    Model("shop", "Nation", "shop_nation", _plain(("id", "name"))),
    Model("shop", "Region", "shop_region", _plain(("id", "name"))),
)
#: A model in which each field is served, or not, for another reason.
CASES = (
    Model(
        "made", "Case", "made_case",
        (Field("id", primary_key=True), Field("code", unique=True), Field("day", db_index=True), Field("owner", "owner_id", related="made_owner"), Field("plain"), Field("second"), Field("ref"), Field("pair"), Field("lone"), Field("tags", related="made_tag", through="made_case_tags")),
        indexes=(("first", "second"), ("ref_id",)), unique_together=(("pair", "day"),), constraints=(("lone",),),
    ),
)


def _first(rows: list[tuple], keys: int) -> list[tuple]:
    """The first row of each key."""
    out: dict[tuple, tuple] = {}
    for row in rows:
        out.setdefault(row[:keys], row)
    return list(out.values())


class Catalog:
    """Lookups over a registry; each is a DataFrame as small as the registry."""

    def __init__(self, spark: SparkSession, models: tuple[Model, ...] = SHOP):
        self.spark, self.models = spark, models
        self._by_table = {m.table: m for m in reversed(models)}

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        """Rows that the plan itself holds: no Python process has to be started to read them."""
        kinds = [x.split() for x in schema.split(", ")]
        made = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(r, kinds)]) for r in rows or [[None] * len(kinds)]]
        return self.spark.range(int(bool(rows))).select(F.inline(F.array(*made)))

    def names(self) -> DataFrame:
        return self._frame(_first([(m.table, m.name, f"{m.app}.{m.name}") for m in self.models], 1), "t string, model_name string, label string")

    def through(self) -> DataFrame:
        return self._frame(_first([(f.through, m.name, f"{m.app}.{m.name}", f.name) for m in self.models for f in m.fields if f.through], 1), "t string, model_name string, label string, field string")

    def reverse(self) -> DataFrame:
        owners = [(m.table, f.column, self._by_table.get(f.related), f.accessor) for m in self.models for f in m.fields if f.related and not f.through]
        return self._frame(_first([(t, c, o.name, f"{o.app}.{o.name}", a) for t, c, o, a in owners if o and a], 2), "t string, c string, model_name string, label string, field string")

    def forward(self) -> DataFrame:
        """Foreign keys by target, with the owning table and their place in the registry."""
        found = [(f.related, m.table, m.name, f"{m.app}.{m.name}", f.name) for m in self.models for f in m.fields if f.related and not f.through]
        return self._frame([(*x, i) for i, x in enumerate(found) if x[0] != x[1]], "t string, source string, model_name string, label string, field string, place int")

    def unindexed(self) -> DataFrame:
        found = [(m.table, n, m.name) for m in self._by_table.values() for f in m.fields if not f.through for n in dict.fromkeys((f.name, f.column)) if not indexed(m, n)]
        return self._frame(_first(found, 2), "t string, c string, model_name string")

    def large(self) -> DataFrame:
        return self._frame([(m.table, f.column) for m in self._by_table.values() for f in m.fields if f.large], "t string, c string")

    @classmethod
    def read(cls, spark: SparkSession, models: DataFrame, fields: DataFrame, indexes: DataFrame) -> Catalog:
        """A catalog from tables: models (app, name, table, place), fields (table and the columns of Field) and indexes
        (table, kind: index, unique_together or constraint; fields). A registry is as long as a program has models."""
        by_table: dict[str, list[Field]] = {}
        for r in fields.orderBy("table", "place").collect():
            by_table.setdefault(r.table, []).append(Field(**{k: v for k, v in r.asDict().items() if k not in ("table", "place") and v is not None}))
        served: dict[tuple[str, str], list[tuple[str, ...]]] = {}
        for r in indexes.orderBy("table", "kind", "fields").collect():
            served.setdefault((r.table, r.kind), []).append(tuple(r.fields))
        of = lambda t, kind: tuple(served.get((t, kind), ()))
        rows = models.orderBy("place").collect()
        return cls(spark, tuple(Model(r.app, r.name, r.table, tuple(by_table.get(r.table, ())), of(r.table, "index"), of(r.table, "unique_together"), of(r.table, "constraint")) for r in rows))
