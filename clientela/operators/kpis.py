"""Key figures over the customer mart and the order mart.

``customers`` holds one row per customer (recency, frequency, value, lifetime value, cluster
name). ``orders`` holds one row per order; where a figure is split by cluster, it carries the
customer's ``Cluster_Name`` too (``operators.orders.enrich_orders``).
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clientela.functions.scalars import (
    exact_mean,
    half_even,
    half_up,
    last_closed_month,
    money,
    safe_ratio,
)
from clientela.sources.dimensions import AT_RISK, BIG_SPENDERS, CHAMPIONS, NEW_OCCASIONAL

RISK_DAYS = 365  # fixed value: days without a purchase after which a customer is at risk
STATE_LIMIT = 10  # fixed value: states in the distribution
RANK_LIMIT = 14  # fixed value: states in the risk chart
ROW_LIMIT = 100  # fixed value: rows an ad-hoc query returns


def _count(condition: Column | None = None) -> Column:
    return F.count(F.lit(1)) if condition is None else F.count_if(condition)


def _revenue(condition: Column | None = None, value: str = "Monetary") -> Column:
    amount = money(value)
    return F.sum(amount if condition is None else F.when(condition, amount)).cast("double")


def _money_mean(name: str) -> Column:
    return exact_mean(F.sum(money(name)), F.count(name))


def _at_risk() -> Column:
    return F.col("Recency") > RISK_DAYS



def customer_measures() -> dict[str, Column]:
    """Aggregates over the customer mart."""
    return {
        "total_clientes": _count(),
        "receita_total": _revenue(),
        "recencia_media": F.avg("Recency"),
        "frequency_media": F.avg("Frequency"),
        "clv_medio": _money_mean("CLV_12m"),
        "ticket_medio_cliente": F.avg("Avg_Order_Value"),
        "clientes_em_risco": _count(_at_risk()),
        "clientes_1_compra": _count(F.col("Frequency") == 1),
        "receita_em_risco": F.coalesce(_revenue(_at_risk()), F.lit(0.0)),
    }


def order_measures() -> dict[str, Column]:
    """Aggregates over the order mart."""
    return {
        "total_pedidos": _count(),
        "receita_pedidos": _revenue(value="monetary_value"),
        "clientes_ativos": F.count_distinct("customer_unique_id"),
        "review_medio": F.avg("review_score"),
    }


def _side_by_side(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns of two aggregates in one row per group, groups of either side included."""
    stacked = left.unionByName(right, allowMissingColumns=True)
    figures = [c for c in stacked.columns if c not in by]
    return stacked.groupBy(*by).agg(*[F.max(c).alias(c) for c in figures])


def measures(
    customers: DataFrame, orders: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """All base figures, overall or per value of columns that both marts carry."""
    left = customers.groupBy(*by).agg(*[c.alias(n) for n, c in customer_measures().items()])
    right = orders.groupBy(*by).agg(*[c.alias(n) for n, c in order_measures().items()])
    both = _side_by_side(left, right, by)
    return both.withColumns(
        {
            "ticket_medio": safe_ratio("receita_total", "total_pedidos"),
            "pct_em_risco": safe_ratio("clientes_em_risco", "total_clientes"),
            "pct_compra_unica": safe_ratio("clientes_1_compra", "total_clientes"),
            "pct_receita_em_risco": safe_ratio("receita_em_risco", "receita_total"),
        }
    )


def cluster_shares(customers: DataFrame) -> DataFrame:
    """Share of customers in each named cluster."""
    names = {
        "pct_campeoes": CHAMPIONS,
        "pct_big_spenders": BIG_SPENDERS,
        "pct_novos": NEW_OCCASIONAL,
    }
    return customers.agg(
        *[
            F.try_divide(_count(F.col("Cluster_Name") == n), _count()).alias(c)
            for c, n in names.items()
        ]
    )


def overall_kpis(customers: DataFrame) -> DataFrame:
    """The whole base in one row. The ticket here is the mean value per customer."""
    row = customers.agg(
        _count().alias("total_clientes"),
        half_up(_revenue(), 2).alias("receita_total_brl"),
        half_up(_money_mean("Monetary"), 2).alias("ticket_medio_brl"),
        half_up(F.avg("Recency"), 1).alias("recency_media_dias"),
        half_up(F.avg("Frequency"), 2).alias("frequency_media"),
        _count(F.col("Frequency") == 1).alias("clientes_1_compra"),
        _count(_at_risk()).alias("clientes_em_risco"),
    )
    return row.withColumns(
        {
            "pct_1_compra": half_even(safe_ratio("clientes_1_compra", "total_clientes"), 4),
            "pct_em_risco": half_even(safe_ratio("clientes_em_risco", "total_clientes"), 4),
        }
    )


def cluster_summary(customers: DataFrame) -> DataFrame:
    """Size, mean profile and revenue per cluster, largest revenue first."""
    return (
        customers.groupBy("Cluster_Name")
        .agg(
            _count().alias("n_clientes"),
            half_up(F.avg("Recency"), 1).alias("recency_media_dias"),
            half_up(F.avg("Frequency"), 2).alias("frequency_media"),
            half_up(_money_mean("Monetary"), 2).alias("monetary_medio"),
            half_up(_revenue(), 2).alias("receita_total"),
            half_up(_money_mean("CLV_12m"), 2).alias("clv_12m_medio"),
            half_up(F.avg("Avg_Review"), 2).alias("review_score_medio"),
        )
        .orderBy(F.desc("receita_total"))
    )


def filter_by_state(
    customers: DataFrame, orders: DataFrame, state: str, cluster_name: str | None = None
) -> DataFrame:
    """Figures of the customers with an order from a state, optionally of one cluster."""
    in_state = (
        orders.where(F.col("customer_state") == F.upper(F.lit(state)))
        .select("customer_unique_id", "customer_state")
        .distinct()
    )
    chosen = customers.join(in_state, "customer_unique_id")
    if cluster_name is not None:
        chosen = chosen.where(F.col("Cluster_Name") == cluster_name)
    return chosen.agg(
        F.count_distinct("customer_unique_id").alias("n_clientes"),
        half_up(F.avg("Recency"), 1).alias("recency_media"),
        half_up(F.avg("Frequency"), 2).alias("frequency_media"),
        half_up(_money_mean("Monetary"), 2).alias("monetary_medio"),
        half_up(_revenue(), 2).alias("receita_total"),
        half_up(_money_mean("CLV_12m"), 2).alias("clv_medio"),
    ).withColumn("encontrado", F.col("n_clientes") > 0)


def top_customers(
    customers: DataFrame, cluster_name: str | None = None, limit: int = 10
) -> DataFrame:
    """Customers with the highest projected value; equal values by id."""
    if cluster_name is not None:
        customers = customers.where(F.col("Cluster_Name") == cluster_name)
    return (
        customers.select(
            "customer_unique_id",
            "Cluster_Name",
            "Recency",
            "Frequency",
            half_up(F.col("Monetary").cast("double"), 2).alias("Monetary"),
            half_up(F.col("CLV_12m").cast("double"), 2).alias("CLV_12m"),
        )
        .orderBy(F.desc("CLV_12m"), "customer_unique_id")
        .limit(limit)
    )


def state_distribution(orders: DataFrame, metric: str = "receita") -> DataFrame:
    """The ten strongest states, each with its share of those ten."""
    if metric == "clientes":
        name, value = "n_clientes", F.count_distinct("customer_unique_id")
    else:
        name, value = "receita_total", _revenue(value="monetary_value")
    top = (
        orders.where(F.col("customer_state").isNotNull())
        .groupBy(F.col("customer_state").alias("UF"))
        .agg(value.alias(name))
        .orderBy(F.desc(name), "UF")
        .limit(STATE_LIMIT)
    )
    total = F.sum(money(name)).over(Window.partitionBy()).cast("double")
    return top.withColumn("pct", half_even(F.col(name) / total * 100, 2))


def monthly(orders: DataFrame) -> DataFrame:
    """Revenue, orders, active customers and ticket per month of purchase."""
    return (
        orders.where(F.col("order_purchase_timestamp").isNotNull())
        .groupBy(F.trunc("order_purchase_timestamp", "month").alias("mes"))
        .agg(
            _revenue(value="monetary_value").alias("receita"),
            _count().alias("pedidos"),
            F.count_distinct("customer_unique_id").alias("clientes_ativos"),
            F.max("order_purchase_timestamp").alias("ultima_compra"),
        )
        .withColumn("ticket", safe_ratio("receita", "pedidos"))
    )


def _closed_month(months: DataFrame) -> DataFrame:
    """The first day of the last closed month, as one row. ``months`` has one row per month."""
    return months.agg(
        F.trunc(last_closed_month(F.max("ultima_compra")), "month").alias("referencia")
    )


def month_over_month(orders: DataFrame) -> DataFrame:
    """The last closed month, the one before it, and the relative change of four figures."""
    names = ["receita", "pedidos", "clientes_ativos", "ticket"]
    months = monthly(orders)
    latest = F.max("ultima_compra").over(Window.partitionBy())  # one row per month
    reference = F.trunc(last_closed_month(latest), "month")
    aged = months.withColumn("referencia", reference).withColumn(
        "age", F.months_between("referencia", "mes").cast("int")
    )
    current = {n: F.max(F.when(F.col("age") == 0, F.col(n))) for n in names}
    previous = {n: F.max(F.when(F.col("age") == 1, F.col(n))) for n in names}
    row = aged.agg(
        F.max("referencia").alias("referencia"),
        *[c.alias(f"{n}_mes") for n, c in current.items()],
        *[c.alias(f"{n}_mes_anterior") for n, c in previous.items()],
    )
    return row.select(
        F.date_format("referencia", "yyyy-MM").alias("mes_referencia"),
        *[F.col(f"{n}_mes") for n in names],
        *[F.col(f"{n}_mes_anterior") for n in names],
        *[
            F.try_divide(
                F.col(f"{n}_mes") - F.col(f"{n}_mes_anterior"), F.col(f"{n}_mes_anterior")
            ).alias(f"{n}_mom")
            for n in names
        ],
    )


def last_months(orders: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` closed months; a month without orders has no values."""
    months = monthly(orders)
    wanted = _closed_month(months).select(
        F.explode(
            F.sequence(
                F.add_months("referencia", -(n - 1)), "referencia", F.expr("interval 1 month")
            )
        ).alias("mes")
    )
    return wanted.join(months, "mes", "left").select(
        F.date_format("mes", "yyyy-MM").alias("mes"),
        "receita",
        "pedidos",
        "clientes_ativos",
        "ticket",
    )


def by_cluster(customers: DataFrame) -> DataFrame:
    """Customers and revenue per cluster, in all and at risk."""
    return customers.groupBy("Cluster_Name").agg(
        _count().alias("clientes"),
        _revenue().alias("receita"),
        _count(_at_risk()).alias("clientes_em_risco"),
        F.coalesce(_revenue(_at_risk()), F.lit(0.0)).alias("receita_em_risco"),
    )


def value_against_ticket(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Ticket and projected value per cluster as rows, and their ratio."""
    figures = measures(customers, orders, ["Cluster_Name"]).select(
        "Cluster_Name",
        F.col("ticket_medio").alias("Ticket atual"),
        F.col("clv_medio").alias("CLV 12m"),
        safe_ratio("clv_medio", "ticket_medio").alias("mult"),
    )
    return figures.unpivot(
        ["Cluster_Name", "mult"], ["Ticket atual", "CLV 12m"], "metrica", "valor"
    )


def action_plan(customers: DataFrame) -> DataFrame:
    """Revenue behind each action: at-risk customers only count when also inactive."""
    name = F.col("Cluster_Name")
    parts = {
        "receita_risco": (name == AT_RISK) & _at_risk(),
        "receita_big_spenders": name == BIG_SPENDERS,
        "receita_novos": name == NEW_OCCASIONAL,
        "receita_campeoes": name == CHAMPIONS,
    }
    return customers.agg(
        *[F.coalesce(_revenue(c), F.lit(0.0)).alias(n) for n, c in parts.items()],
        F.try_divide(_count(F.col("Frequency") == 1), _count()).alias("pct_compra_unica"),
    )


def diagnostic(customers: DataFrame, cohort: DataFrame) -> DataFrame:
    """Single purchases, retention after one month, revenue and customers at risk."""
    figures = customers.agg(
        F.try_divide(_count(F.col("Frequency") == 1), _count()).alias("pct_compra_unica"),
        F.coalesce(_revenue(_at_risk()), F.lit(0.0)).alias("receita_em_risco"),
        F.try_divide(_count(_at_risk()), _count()).alias("pct_em_risco"),
    )
    first_month = cohort.where(F.col("MesIndice") == 1).agg(
        F.try_divide(F.sum("Clientes_Retidos"), F.sum("Tamanho_Safra")).alias("retencao_mes_1")
    )
    return _side_by_side(figures, first_month)


def funnel(customers: DataFrame) -> DataFrame:
    """Customers with at least 1, 2, 3 and 5 purchases, and the step-to-step conversion."""
    f = F.col("Frequency")
    # Stage names.
    stages = [
        (1, "Base (1+ compra)", f == 1),
        (2, "2+ compras", f == 2),
        (3, "3+ compras", f.between(3, 4)),
        (4, "5+ compras", f >= 5),
    ]
    counts = customers.agg(*[_count(c).alias(f"s{o}") for o, _, c in stages])
    rows = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(o).alias("ord"), F.lit(n).alias("Etapa"), F.col(f"s{o}").alias("qtd"))
                    for o, n, _ in stages
                ]
            )
        ).alias("s")
    ).select("s.*")
    # Four rows from here on.
    down = Window.orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.orderBy("ord")
    stacked = rows.withColumn("cum", F.sum("qtd").over(down)).withColumn(
        "prev", F.lag("cum").over(up)
    )
    return stacked.select("ord", "Etapa", "qtd", "cum", safe_ratio("cum", "prev").alias("conv"))


def state_risk(scored: DataFrame, flag: str = "alto_risco") -> DataFrame:
    """Orders, high-risk orders and their share per state, riskiest first."""
    return (
        scored.groupBy(F.col("customer_state").alias("UF"))
        .agg(_count().alias("Pedidos"), F.sum(F.col(flag).cast("bigint")).alias("Alto_Risco"))
        .withColumn("Pct_Alto_Risco", half_even(F.col("Alto_Risco") / F.col("Pedidos"), 4))
        .orderBy(F.desc("Pct_Alto_Risco"), "UF")
    )


def risk_ranking(by_state: DataFrame, limit: int = RANK_LIMIT) -> DataFrame:
    """States up to rank ``limit``, ties kept, each next to the order-weighted mean of all.

    ``by_state`` has one row per state.
    """
    everything = Window.partitionBy()
    high = F.sum(F.col("Pct_Alto_Risco") * F.col("Pedidos")).over(everything)
    ranked = by_state.select(
        "UF",
        "Pedidos",
        "Pct_Alto_Risco",
        (high / F.sum("Pedidos").over(everything)).alias("media"),
        F.rank().over(Window.orderBy(F.desc("Pct_Alto_Risco"))).alias("rk"),
    )
    return ranked.where(F.col("rk") <= limit)


# Words that a read-only query must not contain.
FORBIDDEN = ["insert", "update", "delete", "drop", "create", "alter", "attach"]
# Functions that call into the virtual machine.
CALLS_OUT = r"\b(reflect|try_reflect|java_method)\b"
SQL_ON_FILES = "spark.sql.runSQLOnFiles"


def guarded_sql(spark: SparkSession, text: str) -> tuple[DataFrame | None, str | None]:
    """Run a read-only query over the registered marts.

    Gives ``(rows, None)`` or ``(None, reason)``. Only text that starts with SELECT or WITH
    is run; a forbidden word anywhere, even inside a name, refuses it, as do functions that call out
    and files as tables. Errors while it runs are reasons as well. At most 100 rows, which are
    fetched at once; a warning says if there are more.
    """
    lowered = text.strip().lower()
    if not re.match(r"select|with", lowered):
        return None, "only SELECT or WITH is allowed"
    if any(word in lowered for word in FORBIDDEN):
        return None, "operation not allowed (read only)"
    if re.search(CALLS_OUT, lowered):
        return None, "function not allowed"
    before = spark.conf.get(SQL_ON_FILES)
    spark.conf.set(SQL_ON_FILES, "false")
    try:
        rows = spark.sql(text).limit(ROW_LIMIT + 1)
        found = rows.collect()
        if len(found) > ROW_LIMIT:
            warnings.warn(f"only the first {ROW_LIMIT} rows are returned", stacklevel=2)
        return spark.createDataFrame(found[:ROW_LIMIT], rows.schema), None
    except PySparkException as problem:
        return None, str(problem)
    finally:
        spark.conf.set(SQL_ON_FILES, before)
