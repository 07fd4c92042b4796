"""Key figures under filters that travel along the relationships of a star schema.

A filter on a table reaches the tables that refer to it, directly or over others, and never
the other way: a year reaches orders but not customers, a segment reaches customers and their
orders. Filters become semi joins on the way; a table that no filter reaches is read as it
is. A calculation may take outer filters away again (``without``) or put its own in the place
of those on the same column (``instead``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientela.functions.scalars import money, safe_ratio
from clientela.operators.kpis import (
    RISK_DAYS,
    customer_measures,
    month_over_month,
    order_measures,
)
from clientela.operators.ordering import ranked_values

CUSTOMERS, ORDERS, CALENDAR, SEGMENTS, STATES = (
    "clientes", "pedidos", "calendario", "segmentos", "risco_uf"
)


@dataclass(frozen=True)
class Relationship:
    """Rows of ``many`` refer to one row of ``one``; the keys are SQL expressions."""

    many: str
    many_key: str
    one: str
    one_key: str


# The relationships of the marts.
RELATIONSHIPS = (
    Relationship(CUSTOMERS, "Cluster_Name", SEGMENTS, "Cluster_Name"),
    Relationship(ORDERS, "customer_unique_id", CUSTOMERS, "customer_unique_id"),
    Relationship(ORDERS, "date_format(order_purchase_timestamp, 'yyyy-MM-dd')", CALENDAR, "Data"),
    Relationship(ORDERS, "customer_state", STATES, "UF"),
)


@dataclass(frozen=True)
class Context:
    """Tables, how they relate, and the filters in force by table and column."""

    tables: Mapping[str, DataFrame]
    relationships: Sequence[Relationship] = RELATIONSHIPS
    filters: Mapping[tuple[str, str], Column] = None  # type: ignore[assignment]

    def _with(self, filters: Mapping[tuple[str, str], Column]) -> Context:
        return replace(self, filters=filters)

    def _in_force(self) -> dict[tuple[str, str], Column]:
        return dict(self.filters or {})

    def _check(self, table: str, column: str) -> None:
        if column not in self.tables[table].columns:
            raise ValueError(f"{table} has no column {column}")

    def where(self, table: str, column: str, condition: Column) -> Context:
        """One more filter; several on a column hold together."""
        self._check(table, column)
        filters = self._in_force()
        before = filters.get((table, column))
        filters[table, column] = condition if before is None else before & condition
        return self._with(filters)

    def instead(self, table: str, column: str, condition: Column) -> Context:
        """A filter in the place of any on this column."""
        self._check(table, column)
        return self._with(self._in_force() | {(table, column): condition})

    def without(self, table: str, column: str | None = None) -> Context:
        """No filter on the column; without one, none on the table and on those it refers to."""
        if column is not None:
            gone = {(table, column)}
        else:
            wide = {table, *self.referred(table)}
            gone = {key for key in self._in_force() if key[0] in wide}
        return self._with({k: c for k, c in self._in_force().items() if k not in gone})

    def referred(self, table: str) -> set[str]:
        """Tables that this one refers to, directly or over others."""
        direct = {r.one for r in self.relationships if r.many == table and r.one in self.tables}
        return direct.union(*[self.referred(one) for one in direct]) if direct else direct

    def reached(self, table: str) -> bool:
        """Whether any filter reaches the table."""
        filtered = {t for t, _ in self._in_force()}
        return bool(filtered & {table, *self.referred(table)})

    def rows(self, table: str) -> DataFrame:
        """The rows of a table that all filters leave."""
        own = [c for (t, _), c in self._in_force().items() if t == table]
        found = reduce(DataFrame.where, own, self.tables[table])
        for r in self.relationships:
            if r.many == table and r.one in self.tables and self.reached(r.one):
                keys = self.rows(r.one).select(F.expr(r.one_key).alias("__key"))
                found = (
                    found.withColumn("__key", F.expr(r.many_key))
                    .join(keys, "__key", "left_semi")
                    .drop("__key")
                )
        return found

    def attribute(self, table: str, of: str, column: str) -> DataFrame:
        """``rows(table)`` with a column of ``of``, a table that it is or refers to, as ``column``."""
        if of == table:
            return self.rows(table)
        for r in self.relationships:
            if r.many != table or r.one not in self.tables:
                continue
            if r.one == of or of in self.referred(r.one):
                wide = self.attribute(r.one, of, column).select(
                    F.expr(r.one_key).alias("__key"), F.col(column).alias("__attribute")
                )
                return (
                    self.rows(table)
                    .drop(column)
                    .withColumn("__key", F.expr(r.many_key))
                    .join(wide, "__key")
                    .drop("__key")
                    .withColumnRenamed("__attribute", column)
                )
        raise ValueError(f"{table} does not refer to {of}")


def star_context(
    customers: DataFrame,
    orders: DataFrame,
    calendar: DataFrame,
    segments: DataFrame,
    states: DataFrame | None = None,
) -> Context:
    """The marts and their dimensions, without any filter yet."""
    tables = {CUSTOMERS: customers, ORDERS: orders, CALENDAR: calendar, SEGMENTS: segments}
    return Context(tables if states is None else tables | {STATES: states})


def _figures(
    context: Context, table: str, aggregates: Mapping[str, Column], by: tuple[str, str] | None
) -> tuple[DataFrame, bool]:
    """Aggregates of a table, and whether they could be split by a column of a dimension."""
    listed = [c.alias(n) for n, c in aggregates.items()]
    if by is not None and by[0] in {table, *context.referred(table)}:
        return context.attribute(table, *by).groupBy(by[1]).agg(*listed), True
    return context.rows(table).agg(*listed), False


def measures(context: Context, by: tuple[str, str] | None = None) -> DataFrame:
    """All base figures in a context, in one row or for each value of a dimension's column.

    ``by`` is a table and a column. Figures of a table that the dimension does not reach are the
    same for every value: a year splits orders, not customers.
    """
    parts = [
        _figures(context, CUSTOMERS, customer_measures(), by),
        _figures(context, ORDERS, order_measures(), by),
    ]
    if by is None:
        both = parts[0][0].withColumn("__one", F.lit(1)).join(
            parts[1][0].withColumn("__one", F.lit(1)), "__one"
        ).drop("__one")
    else:
        both = context.rows(by[0]).select(by[1]).distinct()
        for figures, split in parts:
            if split:
                both = both.join(figures, by[1], "left")
            else:  # one row for all
                both = both.withColumn("__one", F.lit(1)).join(
                    F.broadcast(figures.withColumn("__one", F.lit(1))), "__one"
                ).drop("__one")
        # A value that occurs in neither table has no row.
        counts = [c for c, (_, split) in zip(("total_clientes", "total_pedidos"), parts, strict=True) if split]
        both = both.where(reduce(Column.__or__, [F.col(c).isNotNull() for c in counts]))
    return both.withColumns(
        {
            "ticket_medio": safe_ratio("receita_total", "total_pedidos"),
            "pct_em_risco": safe_ratio("clientes_em_risco", "total_clientes"),
            "pct_compra_unica": safe_ratio("clientes_1_compra", "total_clientes"),
            "pct_receita_em_risco": safe_ratio("receita_em_risco", "receita_total"),
        }
    )


def shares_of_segments(context: Context, names: Mapping[str, str]) -> DataFrame:
    """Customers of each named segment over those of the context, in one row.

    The numerator puts its own segment in the place of an outer filter on the customers'
    segment; one on the dimension stays.
    """
    whole = context.rows(CUSTOMERS).agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("__one"))
    parts = [
        context.instead(CUSTOMERS, "Cluster_Name", F.col("Cluster_Name") == name)
        .rows(CUSTOMERS)
        .agg(F.count(F.lit(1)).alias(column), F.lit(1).alias("__one"))
        for column, name in names.items()
    ]
    row = reduce(lambda a, b: a.join(b, "__one"), parts, whole)
    return row.select(*[F.try_divide(c, "n").alias(c) for c in names])


def revenue_at_risk(context: Context) -> DataFrame:
    """Customers and revenue at risk where the calculation's own bound on the recency replaces an
    outer one, next to all customers and revenue of the context."""
    def totals(of: Context, customers: str, revenue: str) -> DataFrame:
        return of.rows(CUSTOMERS).agg(
            F.count(F.lit(1)).alias(customers),
            F.sum(money("Monetary")).cast("double").alias(revenue),
            F.lit(1).alias("__one"),
        )

    risk = context.instead(CUSTOMERS, "Recency", F.col("Recency") > RISK_DAYS)
    both = totals(context, "clientes", "receita").join(
        totals(risk, "clientes_em_risco", "receita_em_risco"), "__one"
    )
    return both.drop("__one").withColumns(
        {
            "pct_em_risco": safe_ratio("clientes_em_risco", "clientes"),
            "pct_receita_em_risco": safe_ratio("receita_em_risco", "receita"),
        }
    )


def concentration(context: Context, share: float = 0.2) -> DataFrame:
    """Revenue of the strongest customers of all over the revenue of the context.

    As many customers are taken as ``share`` of those in the context, but among all customers: the
    filters on customers and their segments do not hold for the numerator. All customers tied
    with the last one taken count as well. So the ratio may exceed 1.
    """
    inside = context.rows(CUSTOMERS).agg(
        F.floor(F.count(F.lit(1)) * F.lit(share)).cast("bigint").alias("n_top"),
        F.sum(money("Monetary")).cast("double").alias("receita_total"),
        F.lit(1).alias("__one"),
    )
    everyone = context.without(CUSTOMERS).rows(CUSTOMERS)
    ranked = ranked_values(everyone, money("Monetary"), descending=True).withColumn("__one", F.lit(1))
    taken = (F.col("upto") - F.col("n")) < F.col("n_top")
    worth = (F.col("value") * F.col("n")).cast("decimal(38,2)")
    top = ranked.join(F.broadcast(inside.select("__one", "n_top")), "__one").groupBy("__one").agg(
        F.sum(F.when(taken, worth)).cast("double").alias("receita_top")
    )
    return inside.join(top, "__one", "left").select(
        "n_top",
        "receita_top",
        "receita_total",
        F.try_divide("receita_top", "receita_total").alias("pct_concentracao"),
    )


def months(context: Context) -> DataFrame:
    """The last closed month and the one before it, among the orders of the context."""
    return month_over_month(context.rows(ORDERS))
