"""The retail tables expressed over the test tables.

Each function returns silver-shaped rows (or raw rows with contract violations, for the ingestion
steps). ``checks.oracle`` states the same mapping independently in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans import staging
from tallyforge.session import scratch_dir, shuffles_dropped

AS_OF = "2026-01-01 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


class Retail:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        # opening a file costs a job for its schema, so each is opened once per query
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame written once per query and read back, as the batch run stores its dimensions before the facts. Payloads and keys
        in hex take less room as zstd than as Spark's default, snappy, which codes repeats only."""
        if name not in self._tables:
            path = scratch_dir(self.spark, name)
            df = build()
            with shuffles_dropped(self.spark):
                df.write.option("compression", "zstd").parquet(path)
            self._tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self._tables[name]

    def stream(self, name: str) -> DataFrame:
        schema = self.table(name).schema
        reader = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
        return reader.parquet(self.sf_dir)

    # -- sales lines ------------------------------------------------------------------------

    def lines(self, lineitem: DataFrame | None = None) -> DataFrame:
        lineitem = self.table("lineitem") if lineitem is None else lineitem
        orders = self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"
        )
        joined = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.withColumns(
            {
                "line_id": F.concat_ws("-", "l_orderkey", "l_linenumber"),
                "qty": F.col("l_quantity").cast("int"),
                "unit_cents": F.expr(
                    "cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)"
                ),
                "pct": F.round(F.col("l_discount") * 100).cast("bigint"),
                "tax_pct": F.round(F.col("l_tax") * 100).cast("int"),
            }
        )

    @staticmethod
    def _channel() -> Column:
        priority = F.col("o_orderpriority")
        return (
            F.when(priority == "1-URGENT", "POS")
            .when(priority.isin("2-HIGH", "3-MEDIUM"), "WEBSITE")
            .otherwise("MOBILE_APP")
        )

    def transactions(self) -> DataFrame:
        return self.lines().select(
            F.col("line_id").alias("id"),
            F.col("l_orderkey").cast("string").alias("transaction_id"),
            F.when(F.col("tax_pct") != 8, F.col("o_custkey").cast("string")).alias("customer_id"),
            F.when(
                F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("l_suppkey").cast("string")
            ).alias("store_id"),
            self._channel().alias("channel"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("qty").alias("quantity"),
            F.expr("cast(unit_cents * 0.01 as decimal(18,2))").alias("unit_price"),
            F.expr("cast(pct * 2 as decimal(18,2))").alias("discount"),
            F.col("l_shipdate").alias("transaction_timestamp"),
        )

    def returns(self) -> DataFrame:
        reason = F.when(F.col("l_linestatus") == "F", "DEFECTIVE").otherwise("WRONG_ITEM")
        return (
            self.lines()
            .where(F.col("l_returnflag") == "R")
            .select(
                F.col("line_id").alias("id"),
                F.col("l_orderkey").cast("string").alias("transaction_id"),
                F.col("l_partkey").cast("string").alias("product_id"),
                F.col("qty").alias("quantity"),
                F.expr("cast(qty * unit_cents * 0.01 as decimal(18,2))").alias("refund_amount"),
                reason.alias("return_reason"),
                F.col("l_shipdate").alias("return_timestamp"),
            )
        )

    def movements(self) -> DataFrame:
        flag = F.col("l_returnflag")
        lineitem = self.table("lineitem")
        qty = F.col("l_quantity").cast("int")
        return lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            F.col("l_suppkey").cast("string").alias("store_id"),
            F.when(flag == "N", "SALE").when(flag == "R", "RETURN").otherwise("RESTOCK").alias("movement_type"),
            F.when(flag == "N", -qty).otherwise(qty).alias("quantity"),
            F.col("l_shipdate").alias("movement_timestamp"),
        )

    def regional_movements(self) -> DataFrame:
        """Movements of the fact's shape at brand and region grain."""
        brands = self.table("part").select("p_partkey", "p_brand")
        regions = self._supplier_geo().select("s_suppkey", "r_name")
        moved = self.movements()
        return (
            moved.join(brands, F.col("product_id").cast("bigint") == F.col("p_partkey"))
            .join(regions, F.col("store_id").cast("bigint") == F.col("s_suppkey"))
            .select(
                F.md5("p_brand").alias("product_key"),
                F.md5("r_name").alias("store_key"),
                F.to_date("movement_timestamp").alias("date_day"),
                "movement_type",
                "quantity",
            )
        )

    # -- dimensions -------------------------------------------------------------------------

    def customers(self) -> DataFrame:
        """One profile version per order of a customer."""
        geo = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        people = self.table("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        orders = self.table("orders")
        status = F.col("o_orderstatus")
        key = F.col("o_custkey").cast("string")
        return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
            key.alias("id"),
            F.col("c_name").alias("first_name"),
            F.col("c_mktsegment").alias("last_name"),
            F.concat(F.lower("c_mktsegment"), key, F.lit("@example.com")).alias("email"),
            F.concat(F.lit("+1-555-"), F.lpad(key, 4, "0")).alias("phone"),
            F.when(status == "F", "F").when(status == "O", "OTHER").otherwise("M").alias("gender"),
            F.upper(F.substring("r_name", 1, 2)).alias("state"),
            F.date_add(F.lit("1950-01-01").cast("date"), F.col("c_nationkey") * 400).alias("birth_date"),
            F.col("o_orderdate").cast("string").alias("event_timestamp"),
        )

    def products(self) -> DataFrame:
        """One price and cost version per restock of a part."""
        parts = self.table("part").select("p_partkey", "p_name", "p_brand", "p_type")
        restocked = self.lines().where(F.col("l_returnflag") == "A")
        return restocked.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_partkey").cast("string").alias("id"),
            F.col("p_brand").alias("sku"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.expr("cast(unit_cents * 0.01 as decimal(18,2))").alias("price"),
            F.expr("cast((unit_cents * 60 div 100) * 0.01 as decimal(18,2))").alias("cost"),
            F.col("l_shipdate").cast("string").alias("event_timestamp"),
        )

    def catalog(self) -> DataFrame:
        """Current products, one row per part, under the staged names."""
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.expr("cast(p_retailprice as decimal(18,2))").alias("price"),
            F.expr("cast(p_retailprice as decimal(18,2))").alias("cost"),
        )

    def _supplier_geo(self) -> DataFrame:
        geo = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return self.table("supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey"))

    def stores(self) -> DataFrame:
        return self._supplier_geo().select(
            F.col("s_suppkey").cast("string").alias("id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("city"),
            F.upper(F.substring("r_name", 1, 2)).alias("state"),
            F.col("r_name").alias("country"),
        )

    # -- events -----------------------------------------------------------------------------

    def events(self, source: DataFrame | None = None) -> DataFrame:
        source = self.table("events") if source is None else source
        return source.withColumns(
            {
                "k": F.get_json_object("props", "$.k").cast("int"),
                "amount": F.col("value").cast("decimal(18,2)"),
                "user": F.col("user_id").cast("string"),
                "basket": F.concat(F.lit("T"), F.expr("event_id div 3").cast("string")),
            }
        )

    def campaigns(self) -> DataFrame:
        """One row per campaign and day."""
        kind = F.col("event_type")
        code = F.expr("k div 10").cast("string")
        half = F.when(F.dayofmonth("ts") <= 15, " early").otherwise(" late")
        rows = self.events().select(
            F.concat(F.lit("CMP-"), code).alias("id"),
            F.concat(F.lit("Campaign "), code, half).alias("campaign_name"),
            F.when(F.col("k") < 50, "EMAIL").otherwise("SOCIAL").alias("channel"),
            "amount",
            kind,
            F.to_date("ts").cast("string").alias("campaign_date"),
        )
        return rows.groupBy("id", "campaign_name", "channel", "campaign_date").agg(
            F.sum("amount").cast("decimal(18,2)").alias("cost"),
            F.count_if(kind == "view").alias("impressions"),
            F.count_if(kind == "click").alias("clicks"),
            F.count_if(kind == "purchase").alias("conversions"),
        )

    def tickets(self) -> DataFrame:
        k = F.col("k")
        resolved = F.when(k >= 20, F.col("ts") + F.make_dt_interval(mins=k * 10))
        return (
            self.events()
            .where(F.col("event_type") == "error")
            .select(
                F.col("event_id").cast("string").alias("id"),
                F.col("user").alias("customer_id"),
                F.concat(F.lit("K"), F.expr("k div 25").cast("string")).alias("issue_category"),
                F.when(k >= 20, "RESOLVED").otherwise("OPEN").alias("status"),
                F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("priority"),
                F.col("ts").alias("ticket_timestamp"),
                resolved.alias("resolution_timestamp"),
            )
        )

    def members(self) -> DataFrame:
        """Customer versions of the events feed: one per signup."""
        k = F.col("k")
        return (
            self.events()
            .where(F.col("event_type") == "signup")
            .select(
                F.col("user").alias("id"),
                F.concat(F.lit("User"), F.col("user")).alias("first_name"),
                F.concat(F.lit("Version"), k.cast("string")).alias("last_name"),
                F.when(k < 90, F.concat(F.lit("malformed"), k.cast("string"), F.lit("#host")))
                .otherwise(F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")))
                .alias("email"),
                F.concat(F.lit("+1-555-"), F.lpad(k.cast("string"), 4, "0")).alias("phone"),
                F.when(k < 40, "M").when(k < 80, "F").otherwise("X").alias("gender"),
                F.lit("NY").alias("state"),
                F.lit("1990-01-01").cast("date").alias("birth_date"),
                F.col("ts").cast("string").alias("event_timestamp"),
            )
        )

    def baskets(self) -> DataFrame:
        """A time-dense sales feed: every event is a line, three event ids share a basket."""
        return self.events().select(
            F.col("event_id").cast("string").alias("id"),
            F.col("basket").alias("transaction_id"),
            F.when(F.col("k") != 7, F.col("user")).alias("customer_id"),
            F.lit(None).cast("string").alias("store_id"),
            F.lit("WEBSITE").alias("channel"),
            F.col("k").cast("string").alias("product_id"),
            F.expr("cast(k div 10 + 1 as int)").alias("quantity"),
            F.col("amount").alias("unit_price"),
            F.lit(0).cast("decimal(18,2)").alias("discount"),
            F.col("ts").alias("transaction_timestamp"),
        )

    def basket_returns(self) -> DataFrame:
        return (
            self.events()
            .where((F.col("event_type") == "error") & (F.col("k") < 60))
            .select(
                F.col("event_id").cast("string").alias("id"),
                F.col("basket").alias("transaction_id"),
                F.col("k").cast("string").alias("product_id"),
                F.expr("cast(k div 20 + 1 as int)").alias("quantity"),
                F.col("amount").alias("refund_amount"),
            )
        )

    def decisions(self) -> DataFrame:
        k = F.col("k")
        return (
            self.events()
            .where(F.col("event_type") == "click")
            .select(
                F.col("basket").alias("transaction_id"),
                F.when(k < 40, "Approved").when(k < 80, "Dismissed").otherwise("Pending").alias("status"),
                F.col("ts").alias("decided_at"),
            )
        )

    def order_sales(self) -> DataFrame:
        """Whole orders as sales, for customer segments."""
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("transaction_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            self._channel().alias("channel"),
            F.lit(1).alias("quantity"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("unit_price"),
            F.lit(0).cast("decimal(18,2)").alias("discount"),
            F.col("o_orderdate").alias("transaction_timestamp"),
        )

    # -- raw rows with violations -----------------------------------------------------------

    def raw_transactions(self, lineitem: DataFrame | None = None) -> DataFrame:
        priority = F.col("o_orderpriority")
        channel = (
            F.when(priority == "1-URGENT", "POS")
            .when(priority == "2-HIGH", "  WEBSITE ")
            .when(priority == "5-LOW", "KIOSK")
            .otherwise("MOBILE_APP")
        )
        lineitem = self.table("lineitem") if lineitem is None else lineitem
        return self.lines(lineitem).select(
            F.col("line_id").alias("id"),
            F.col("l_orderkey").cast("string").alias("transaction_id"),
            F.when(F.col("tax_pct") != 8, F.col("o_custkey").cast("string")).alias("customer_id"),
            F.col("l_suppkey").cast("string").alias("store_id"),
            channel.alias("channel"),
            F.col("l_partkey").cast("string").alias("product_id"),
            (F.col("qty") - 3).alias("quantity"),
            F.when(F.col("pct") != 10, F.expr("cast(unit_cents * 0.01 as decimal(18,2))")).alias("unit_price"),
            F.expr("cast(pct * 2 - 1 as decimal(18,2))").alias("discount"),
            F.col("l_shipdate").alias("transaction_timestamp"),
        )

    def raw_customers(self) -> DataFrame:
        """The customer feed with lower-case codes, a three-letter state, bad e-mails and genders."""
        people = self.customers()
        email = F.when(
            F.col("gender") == "OTHER", F.concat(F.lit("malformed-"), F.col("id"))
        ).otherwise(F.col("email"))
        return people.select(
            "id",
            F.concat(F.lit(" "), F.col("first_name")).alias("first_name"),
            "last_name",
            email.alias("email"),
            "phone",
            F.when(F.col("last_name") == "MACHINERY", "robot")
            .otherwise(F.lower("gender"))
            .alias("gender"),
            F.when(F.col("state") == "MI", "mid").otherwise(F.lower("state")).alias("state"),
            F.col("birth_date").cast("string").alias("birth_date"),
            F.col("event_timestamp").cast("timestamp_ntz").alias("updated_at"),
        )

    # -- staged -----------------------------------------------------------------------------

    def stg(self, name: str) -> DataFrame:
        silver = {
            "customers": self.customers,
            "products": self.products,
            "stores": self.stores,
            "transactions": self.transactions,
            "returns": self.returns,
            "inventory_movements": self.movements,
            "marketing_campaigns": self.campaigns,
            "support_tickets": self.tickets,
        }
        return staging.STAGING[name](silver[name]())

    def stg_members(self) -> DataFrame:
        return staging.stg_customers(self.members())
