"""The semantic model of the order tables, used by the registered queries and the tests."""

from __future__ import annotations

from gaugeworks.model import Entity, Filter, Join, Metric, Model

_MONEY = "cast({} as decimal(18, 2))"

MODEL = Model(
    {
        "lines": Entity(
            table="lineitem",
            members={
                "order_id": "l_orderkey", "part_id": "l_partkey", "supplier_id": "l_suppkey", "line_number": "l_linenumber",
                "return_flag": "l_returnflag", "line_status": "l_linestatus", "shipped": "l_shipdate", "quantity": "l_quantity",
                "discount": "l_discount", "price": "l_extendedprice",
            },
            clock="shipped",
            joins=(
                Join("orders", (("order_id", "order_id"),), "many_to_one"),
                Join("parts", (("part_id", "part_id"),), "many_to_one"),
                Join("suppliers", (("supplier_id", "supplier_id"),), "many_to_one"),
            ),
            metrics={
                "units": Metric("sum", _MONEY.format("l_quantity")),
                "gross": Metric("sum", _MONEY.format("l_extendedprice")),
                "net": Metric("sum", "cast(l_extendedprice as decimal(18, 2)) * (1 - cast(l_discount as decimal(4, 2)))"),
                "lines": Metric("count"),
                "returned_units": Metric("sum", _MONEY.format("l_quantity"), filters=(Filter("return_flag", "=", "R"),)),
                "orders_shipped": Metric("count_distinct", "l_orderkey"),
                "return_rate": Metric("ratio", num="returned_units", den="units"),
                "discounted": Metric("derived", formula="{gross} - {net}"),
                "price_per_unit": Metric("derived", formula="{gross} / {units}"),
                "order_lines_once": Metric("sum_distinct_on", "l_linenumber", keys=("order_id",)),
            },
        ),
        "orders": Entity(
            table="orders",
            members={
                "order_id": "o_orderkey", "customer_id": "o_custkey", "status": "o_orderstatus", "ordered": "o_orderdate",
                "priority": "o_orderpriority", "total": "o_totalprice",
            },
            clock="ordered",
            joins=(Join("customers", (("customer_id", "customer_id"),), "many_to_one"),),
            metrics={
                "orders": Metric("count"),
                "revenue": Metric("sum", _MONEY.format("o_totalprice")),
                "buyers": Metric("count_distinct", "o_custkey"),
                "revenue_per_buyer": Metric("ratio", num="revenue", den="buyers"),
                "open_orders": Metric("count", filters=(Filter("status", "=", "O"),)),
                "last_day_revenue": Metric("sum", _MONEY.format("o_totalprice"), level=True),
                "first_day_revenue": Metric("sum", _MONEY.format("o_totalprice"), level=True, snapshot="first"),
                "segment_revenue": Metric("sum", _MONEY.format("o_totalprice"), must_pin=("segment",)),
                "last_day_orders": Metric("count", level=True),
                "load": Metric("ratio", num="orders", den="last_day_orders", weight="weeks"),
                "seen_buyers": Metric("count_distinct", "o_custkey", level=True, any_in_window=True),
                "urgent_revenue": Metric("sum", _MONEY.format("o_totalprice"), filters=(Filter("priority", "=", "1-URGENT"),)),
                "urgent_orders": Metric("count", filters=(Filter("priority", "=", "1-URGENT"),)),
            },
            clock_is_day=True,
            definitions={"large": "o_totalprice > 200000", "unfinished": "o_orderstatus <> 'F'"},
        ),
        "customers": Entity(
            table="customer",
            members={"customer_id": "c_custkey", "customer": "c_name", "nation_id": "c_nationkey", "segment": "c_mktsegment", "balance": "c_acctbal"},
            joins=(Join("nations", (("nation_id", "nation_id"),), "many_to_one"),),
            labels={"customer": "customer_id"},
            metrics={"customers": Metric("count"), "balance_total": Metric("sum", _MONEY.format("c_acctbal"))},
        ),
        "suppliers": Entity(
            table="supplier",
            members={"supplier_id": "s_suppkey", "supplier": "s_name", "supplier_nation_id": "s_nationkey"},
            joins=(Join("nations", (("supplier_nation_id", "nation_id"),), "many_to_one", role="supplier_nations"),),
            metrics={"suppliers": Metric("count")},
        ),
        "parts": Entity(
            table="part",
            members={"part_id": "p_partkey", "brand": "p_brand", "part_type": "p_type", "part_size": "p_size"},
            metrics={"parts": Metric("count"), "largest": Metric("max", "p_size"), "mean_size": Metric("avg", "p_size")},
        ),
        "nations": Entity(
            table="nation",
            members={"nation_id": "n_nationkey", "nation": "n_name", "region_id": "n_regionkey"},
            joins=(Join("regions", (("region_id", "region_id"),), "many_to_one"),),
        ),
        "regions": Entity(table="region", members={"region_id": "r_regionkey", "region": "r_name"}),
        "events": Entity(
            table="events",
            members={"event_id": "event_id", "at": "ts", "user": "user_id", "event": "event_type"},
            clock="at",
            population="user_id is not null",
            metrics={
                "events": Metric("count"),
                "users": Metric("count_distinct", "user_id"),
                "purchases": Metric("count", filters=(Filter("event", "=", "purchase"),)),
                "purchase_share": Metric("ratio", num="purchases", den="events"),
            },
        ),
    }
)
