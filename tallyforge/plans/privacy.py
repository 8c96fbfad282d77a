"""Masked views, keyed tokens, erasure requests and coarse birth dates."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.contracts import Contract
from tallyforge.sources.layers import Lakehouse

# Replacements for an erased customer.
ERASED_NAME = "DELETED_USER"
ERASED_EMAIL = "forgotten@compliance.com"
ERASED_PHONE = ""
ERASED = {"first_name": ERASED_NAME, "last_name": ERASED_NAME, "email": ERASED_EMAIL, "phone": ERASED_PHONE}


def mask_tail(text: Column) -> Column:
    """Three characters from the second on become stars; the length of longer text is kept."""
    return F.overlay(text, F.lit("***"), F.lit(2))


def mask_email(email: Column) -> Column:
    user = F.split_part(email, F.lit("@"), F.lit(1))
    return F.concat(mask_tail(user), F.lit("@"), F.split_part(email, F.lit("@"), F.lit(2)))


def mask_phone(phone: Column) -> Column:
    return F.concat(F.lit("***-***-"), F.right(phone, F.lit(4)))


def birth_month(birth_date: Column) -> Column:
    """First day of the birth month."""
    return F.trunc(birth_date.cast("date"), "month")


def masked_customers(dim: DataFrame) -> DataFrame:
    email = F.col("email")
    return dim.select(
        "customer_key",
        "customer_id",
        mask_tail(F.col("first_name")).alias("first_name_masked"),
        mask_tail(F.col("last_name")).alias("last_name_masked"),
        F.split_part(email, F.lit("@"), F.lit(1)).alias("email_user"),
        mask_email(email).alias("email_masked"),
        mask_phone(F.col("phone")).alias("phone_masked"),
        "gender",
        "state",
        "birth_date",
        "valid_from",
        "valid_to",
        "is_current",
    )


def mask_pii(df: DataFrame, contract: Contract) -> DataFrame:
    """Masks whatever the contract flags as personal, by the kind of column."""
    maskers = {"email": mask_email, "phone": mask_phone, "birth_date": birth_month}
    flagged = [c for c in contract.pii if c in df.columns]
    return df.withColumns({c: maskers.get(c, mask_tail)(F.col(c)) for c in flagged})


# Versioned tables that hold customers, with the column that names them.
CUSTOMER_TABLES = (
    ("source", "customers", "id"),
    ("staged", "customers", "id"),
    ("silver", "customers", "id"),
    ("light", "customers", "id"),
    ("gold", "dim_customer", "customer_id"),
)


def erase_customers(lake: Lakehouse, requests: DataFrame, key: str = "customer_id") -> None:
    """Anonymises the listed customers in every layer, in raw payloads and in quarantine too, and removes the older versions
    that still name them."""
    listed = requests.select(F.col(key).cast("string").alias("_id"))

    def named(column: str) -> DataFrame:
        return listed.withColumnRenamed("_id", column)

    # the last uploaded file, where there was one, is a customer table too
    for layer, name, column in (*CUSTOMER_TABLES, ("staged", "upload_customers", "id")):
        df = lake.read(layer, name)
        if df is not None:
            lake.write(forget(df, named(column), column), layer, name)
            lake.prune(layer, name)
    bronze = lake.read("bronze", "customers")
    if bronze is not None:
        lake.write(forget_payload(bronze, named("business_key")), "bronze", "customers")
        lake.prune("bronze", "customers")
    extracts = lake.read_runs("extracts", "customers")
    if extracts is not None:
        lake.rewrite_runs(forget_payload(extracts, named("business_key")), "extracts", "customers")
    held = lake.read_runs("quarantine", "customers")
    if held is not None:
        lake.rewrite_runs(forget(held, named("id"), "id"), "quarantine", "customers")


def forget_payload(bronze: DataFrame, requests: DataFrame) -> DataFrame:
    """Envelopes with the personal fields of the listed business keys replaced inside the JSON text."""
    listed = requests.select(F.col("business_key").alias("_erase")).where(F.col("_erase").isNotNull()).distinct()
    joined = bronze.join(listed, F.col("business_key") == F.col("_erase"), "left")
    fields = F.from_json("raw_payload", "map<string,string>")
    values = F.create_map(*[F.lit(x) for pair in ERASED.items() for x in pair])
    replaced = F.to_json(F.transform_values(fields, lambda k, v: F.coalesce(F.when(v.isNotNull(), values[k]), v)))
    payload = F.when(F.col("_erase").isNotNull(), replaced).otherwise(F.col("raw_payload"))
    return joined.withColumn("raw_payload", payload).select(*bronze.columns)


def forget(df: DataFrame, requests: DataFrame, key: str = "customer_id") -> DataFrame:
    """Anonymises the listed customers; every row and every other column stays.

    The request list joins by its size: broadcast while Spark finds it small, shuffled otherwise.
    """
    listed = requests.select(F.col(key).alias("_erase")).where(F.col("_erase").isNotNull()).distinct()
    joined = df.join(listed, F.col(key) == F.col("_erase"), "left")
    hit = F.col("_erase").isNotNull()
    erased = {
        c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in ERASED.items() if c in df.columns
    }
    return joined.withColumns(erased).select(*df.columns)


# -- keyed tokens ---------------------------------------------------------------------------

BLOCK_BYTES = 64


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of a text as lower-case hex, from built-in functions; NULL stays NULL.

    Without the key, tokens can neither be computed from guessed addresses nor be told from random.
    """
    block = (hashlib.sha256(key).digest() if len(key) > BLOCK_BYTES else key).ljust(BLOCK_BYTES, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def tokenize(df: DataFrame, key: bytes, columns: Sequence[str] = ("email", "phone")) -> DataFrame:
    """The columns replaced by their tokens. Equal values have equal tokens, in every table that shares the key, so joins and
    counts still work; e-mail addresses count without regard to case and surrounding blanks."""
    return df.withColumns({c: hmac_sha256(normal_value(c), key) for c in columns})


def normal_value(column: str) -> Column:
    value = F.trim(F.col(column))
    return F.lower(value) if column == "email" else value


def token_vault(df: DataFrame, key: bytes, columns: Sequence[str] = ("email", "phone")) -> DataFrame:
    """(kind, token, value): what re-identification joins with, once for each token. To be kept apart from the tokenised tables."""
    kinds = [F.struct(F.lit(c).alias("kind"), hmac_sha256(normal_value(c), key).alias("token"), normal_value(c).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*kinds))).where("token IS NOT NULL").distinct()


def reidentify(df: DataFrame, vault: DataFrame, columns: Sequence[str] = ("email", "phone")) -> DataFrame:
    """Tokens replaced by the values of the vault; a token that the vault does not hold stays."""
    for c in columns:
        known = vault.where(F.col("kind") == c).select(F.col("token").alias("_token"), F.col("value").alias("_value"))
        df = df.join(known, F.col(c) == F.col("_token"), "left").withColumn(c, F.coalesce("_value", c)).drop("_token", "_value")
    return df
