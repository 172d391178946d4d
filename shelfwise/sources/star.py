"""Star-schema views over the given tables: dimensions, the sales fact and the raw feed.

The views join only what the asked-for columns need. Dimensions hang on left joins, so a sale whose
dimension row is missing keeps its place with nulls and the quality rules decide about it; leaving out
a left join to a keyed dimension never changes the other columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The part types that make up a division, and the market segments behind a sales channel.
DIVISION = (
    "CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'Pharma-OTC' WHEN p_type = 'LARGE' THEN 'Pharma-Rx' "
    "WHEN p_type = 'MEDIUM' THEN 'Consumer-Health' ELSE 'Personal-Care' END"
)
CHANNEL = (
    "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'distributor' "
    "WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'modern_trade' ELSE 'direct' END"
)
STATUS = (
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'backorder' WHEN l_returnflag = 'R' THEN 'cancelled' "
    "WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'partial' ELSE 'fulfilled' END"
)
SHELF_LIFE_DAYS = "120 + (p_size * 41) % 976"

# The brands and regions of the demand-surge questions.
SURGE_BRANDS = ("Brand#1", "Brand#4", "Brand#8", "Brand#16")
SURGE_REGIONS = ("ASIA", "EUROPE")

SALES_COLUMNS = (
    "sale_id", "product_id", "outlet_id", "dc_id", "account_id", "region", "province", "city", "division", "brand",
    "category", "order_ts", "ship_ts", "units_ordered", "units_fulfilled", "unit_price_idr", "gross_idr",
    "discount_idr", "net_idr", "channel", "promo_flag", "status",
)

#: The numbers behind outlet_id and product_id: what counts distinct ones by, instead of shuffling text.
SALES_KEYS = ("outlet_key", "product_key")

#: The numbers behind sale_id: an order and a line of it.
SALE_KEYS = ("order_key", "line_number")

# Which table a sales column comes from; the rest is on the line.
_FROM_CUSTOMER = {"region", "province", "city", "channel"}
_FROM_ORDER = {"outlet_id", "outlet_key", "account_id", "order_ts"} | _FROM_CUSTOMER
_FROM_SUPPLIER = {"dc_id"}
_FROM_PART = {"division", "brand", "category"}


# The schemas of the given tables, stated so that no job has to read footers to find them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
        "o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


class Tables:
    """The given tables by name, read lazily. With `gold`, a folder that plans.gold.build has written, the operational
    reads start there instead of at the raw feed."""

    def __init__(self, spark: SparkSession, sf_dir: str, gold: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.gold = gold.rstrip("/") if gold else None
        self._frames: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._frames:
            reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
            self._frames[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    @cached_property
    def geo(self) -> DataFrame:
        """One row per nation with the name of its region."""
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
            "n_nationkey", "n_name", "r_name"
        )

    def clock(self, days_back: int = 0) -> Column:
        """Newest order time of the feed, or that many days earlier; stands in for the wall clock.

        A scalar subquery that holds the whole bound, so a comparison with it is a plain column-to-value filter.
        """
        return self.orders.agg(F.max("o_orderdate") - F.expr(f"INTERVAL {days_back} DAYS")).scalar()

    def midnight(self, days_back: int) -> Column:
        """Start of the day that lies `days_back` days before the newest order's day."""
        start = F.date_sub(F.to_date(F.max("o_orderdate")), days_back).cast("timestamp_ntz")
        return self.orders.agg(start).scalar()


def order_headers(t: Tables, with_customer: bool) -> DataFrame:
    """Orders with their customer's place. Joined before the lines, so the wide side never shuffles on custkey."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    if not with_customer:
        return orders
    # Customer first, then its place: joined to each other first, Spark would multiply their sizes and never broadcast.
    customer = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return placed.join(t.geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")


# Worked out from a line before it meets the other tables: whole numbers are a fraction of the doubles in a shuffle.
_LINE_NUMBERS = (
    "cast(l_quantity AS bigint) AS l_units", "cast(round(l_extendedprice * 100) AS bigint) AS l_gross",
    "cast(round(l_discount * 100) AS bigint) AS l_pct", f"{STATUS} AS l_status",
)


def sales_lines(t: Tables, columns: Iterable[str], by_order: bool = False) -> DataFrame:
    """Order lines joined to the tables that the wanted sales columns come from.

    Lines and orders both grow with the data, so they meet in a sort-merge join: it spills, adaptive execution can
    split a hot order key, and the size guesses of an unanalyzed join cannot turn the lines into a broadcast. All
    other joins are left to Spark, which broadcasts a dimension only while its size is under the threshold. A line whose
    order is missing stays, with nulls. With `by_order` the orders come last, so that the lines lie by order afterwards.
    """
    wanted = set(columns)

    def with_orders(lines: DataFrame) -> DataFrame:
        headers = order_headers(t, bool(wanted & _FROM_CUSTOMER))
        return lines.join(headers.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left")

    lines = t.lineitem.selectExpr("*", *_LINE_NUMBERS)
    if wanted & _FROM_ORDER and not by_order:
        lines = with_orders(lines)
    if wanted & _FROM_SUPPLIER:
        lines = lines.join(
            t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left"
        )
    if wanted & _FROM_PART:
        lines = lines.join(
            t.part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"), "left"
        )
    if wanted & _FROM_ORDER and by_order:
        lines = with_orders(lines)
    return lines


# Sales columns in layers: a layer uses the columns of the ones before it.
_SALES_LAYERS = (
    {
        "sale_id": "concat('SAL-', l_orderkey, '-', l_linenumber)",
        "product_id": "concat('SKU-', l_partkey)",
        "outlet_id": "concat('OUT-', o_custkey)",
        "outlet_key": "o_custkey",
        "product_key": "l_partkey",
        "order_key": "l_orderkey",
        "line_number": "l_linenumber",
        "account_id": "concat('ACC-', o_custkey)",
        "dc_id": "concat('DC-', s_nationkey)",
        "region": "r_name",
        "province": "n_name",
        "city": "n_name",
        "division": f"CASE WHEN p_type IS NULL THEN NULL ELSE {DIVISION} END",
        "brand": "p_brand",
        "category": "p_type",
        "order_ts": "o_orderdate",
        "status": "l_status",
        "channel": f"CASE WHEN c_mktsegment IS NULL THEN NULL ELSE {CHANNEL} END",
        "units_ordered": "l_units",
        "gross_idr": "l_gross",
        "unit_price_idr": "l_gross div nullif(l_units, 0)",
        "discount_idr": "l_gross * l_pct div 100",
        "promo_flag": "cast(l_pct > 5 AS int)",
    },
    {
        "ship_ts": "CASE WHEN status IN ('backorder', 'cancelled') THEN NULL ELSE l_shipdate END",
        "units_fulfilled": (
            "CASE status WHEN 'fulfilled' THEN units_ordered WHEN 'partial' THEN units_ordered div 2 ELSE 0L END"
        ),
    },
    # What was served, at the discounted price.
    {"net_idr": "coalesce((gross_idr - discount_idr) * units_fulfilled div nullif(units_ordered, 0), 0L)"},
)
_SALES_INPUTS = {
    "ship_ts": {"status"},
    "units_fulfilled": {"status", "units_ordered"},
    "net_idr": {"units_fulfilled", "status", "discount_idr", "gross_idr", "units_ordered"},
}


def _with_sales_columns(lines: DataFrame, wanted: set[str]) -> DataFrame:
    todo = wanted.union(*[_SALES_INPUTS.get(c, set()) for c in wanted])
    for layer in _SALES_LAYERS:
        columns = [f"{text} AS {name}" for name, text in layer.items() if name in todo]
        if columns:
            lines = lines.selectExpr("*", *columns)
    return lines


def fact_sales(t: Tables, columns: Iterable[str] = SALES_COLUMNS, by_order: bool = False) -> DataFrame:
    """Sell-through fact, one row per order line. sale_id repeats by nature."""
    columns = list(columns)
    return _with_sales_columns(sales_lines(t, columns, by_order), set(columns)).select(*columns)


def sales_referenced(*texts: str) -> list[str]:
    """The sales columns that some SQL texts mention (naming one too many only costs a join)."""
    joined = " ".join(texts)
    return [c for c in SALES_COLUMNS if c in joined]


def raw_sales(t: Tables) -> DataFrame:
    """The untyped feed: every sales column of every order line as text."""
    return fact_sales(t).select(*_as_text(SALES_COLUMNS))


def raw_sales_by_order(t: Tables, columns: Iterable[str] = SALES_COLUMNS) -> DataFrame:
    """The untyped feed, or some of its columns, lying by order, with the numbers behind sale_id (SALE_KEYS)."""
    columns = list(columns)
    return fact_sales(t, [*columns, *SALE_KEYS], by_order=True).select(*_as_text(columns), *SALE_KEYS)


def _as_text(columns: Iterable[str]) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in columns]


def dim_product(t: Tables) -> DataFrame:
    return t.part.select(
        F.expr("concat('SKU-', p_partkey)").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.expr(DIVISION).alias("division"),
        F.col("p_type").alias("category"),
        F.expr(SHELF_LIFE_DAYS).alias("shelf_life_days"),
        F.expr("cast(round(p_retailprice * 100) AS bigint)").alias("unit_price_idr"),
    )


def dim_distribution_center(t: Tables) -> DataFrame:
    """One distribution centre per nation, on a made-up but fixed grid of coordinates."""
    return t.geo.select(
        F.expr("concat('DC-', n_nationkey)").alias("dc_id"),
        F.expr("concat('DC ', n_name)").alias("dc_name"),
        F.col("n_name").alias("city"),
        F.col("n_name").alias("province"),
        F.col("r_name").alias("region"),
        F.expr("cast(n_nationkey * 3 - 36 AS double)").alias("lat"),
        F.expr("cast(95 + n_nationkey AS double)").alias("lng"),
    )


def dim_outlet(t: Tables) -> DataFrame:
    customer = t.customer.join(t.geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return customer.select(
        F.expr("concat('OUT-', c_custkey)").alias("outlet_id"),
        F.expr("concat('Outlet ', c_custkey)").alias("outlet_name"),
        F.expr(CHANNEL).alias("outlet_type"),
        F.col("n_name").alias("city"),
        F.col("n_name").alias("province"),
        F.col("r_name").alias("region"),
        F.expr("concat('DC-', c_nationkey)").alias("dc_id"),
    )


# Which account columns hold personal data, and of which kind.
ACCOUNT_PII = {"contact_name": "name", "nik": "national_id", "email": "email", "phone": "phone"}


def dim_account(t: Tables) -> DataFrame:
    """Accounts with personal data; those columns carry a `pii` tag in their metadata."""
    customer = t.customer.join(t.geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    accounts = customer.select(
        F.expr("concat('ACC-', c_custkey)").alias("account_id"),
        F.expr("concat('OUT-', c_custkey)").alias("outlet_id"),
        F.col("c_name").alias("contact_name"),
        F.expr("lpad(cast(c_custkey AS string), 16, '0')").alias("nik"),
        F.expr("concat(replace(lower(c_name), '#', '.'), '@example.com')").alias("email"),
        F.expr("concat('+62', lpad(cast(c_custkey AS string), 9, '8'))").alias("phone"),
        F.col("r_name").alias("region"),
        F.expr("lower(c_mktsegment)").alias("account_type"),
    )
    for column, kind in ACCOUNT_PII.items():
        accounts = accounts.withMetadata(column, {"pii": kind})
    return accounts


# Who may see what.
ALLOWLIST = (
    ("admin@example.com", "ALL", True),
    ("analyst@example.com", "ALL", False),
    ("asia.rm@example.com", "ASIA", False),
    ("europe.rm@example.com", "EUROPE", False),
)


def access_allowlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALLOWLIST, "email string, allowed_region string, is_admin boolean")
