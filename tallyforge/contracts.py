"""Declarative data contracts and the checks that follow from them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str = "string"
    nullable: bool = True
    accepted_values: tuple[str, ...] = ()
    min_value: float | int | None = None
    length: int | None = None
    pattern: str | None = None
    primary_key: bool = False
    pii: bool = False


@dataclass(frozen=True)
class Contract:
    table: str
    columns: tuple[ColumnRule, ...]
    source_system: str = ""
    ownership: str = ""
    freshness_sla_hours: int | None = None
    # columns read as timestamps although the payload carries text
    timestamps: tuple[str, ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def pii(self) -> list[str]:
        return [c.name for c in self.columns if c.pii]


# Columns that are parsed as timestamps wherever they occur.
TIMESTAMP_COLUMNS = (
    "transaction_timestamp",
    "created_at",
    "updated_at",
    "ticket_timestamp",
    "resolution_timestamp",
    "birth_date",
    "return_timestamp",
    "movement_timestamp",
)


def contract_from_mapping(table: str, spec: Mapping) -> Contract:
    rules = []
    for name, rule in spec.get("columns", {}).items():
        known = {k: v for k, v in rule.items() if k in ColumnRule.__dataclass_fields__}
        if "accepted_values" in known:
            known["accepted_values"] = tuple(known["accepted_values"])
        rules.append(ColumnRule(name=name, **known))
    return Contract(
        table=table,
        columns=tuple(rules),
        source_system=spec.get("source_system", ""),
        ownership=spec.get("ownership", ""),
        freshness_sla_hours=spec.get("freshness_sla_hours"),
        timestamps=tuple(r.name for r in rules if r.name in TIMESTAMP_COLUMNS),
    )


def load_contracts(path: str) -> dict[str, Contract]:
    """Contracts from a YAML or JSON file with a top-level ``contracts`` mapping, over the defaults."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            document = json.load(handle)
        else:
            import yaml  # optional dependency, needed for YAML files only

            document = yaml.safe_load(handle)
    loaded = {t: contract_from_mapping(t, s) for t, s in (document.get("contracts") or {}).items()}
    return {**CONTRACTS, **loaded}


def contract_schema(contract: Contract) -> T.StructType:
    """Parse schema of the payload: everything nullable, dates and timestamps still text."""
    types = {
        "integer": T.IntegerType(),
        "decimal": T.DecimalType(18, 2),
        "double": T.DoubleType(),
    }
    return T.StructType(
        [T.StructField(c.name, types.get(c.type, T.StringType()), True) for c in contract.columns]
    )


def rule_not_null(rule: ColumnRule) -> tuple[Column, str]:
    return F.col(rule.name).isNull(), f"{rule.name} is null"


def rule_enum(rule: ColumnRule) -> tuple[Column, str]:
    value = F.col(rule.name)
    return value.isNotNull() & ~value.isin(list(rule.accepted_values)), f"{rule.name} not in accepted values"


def rule_min(rule: ColumnRule) -> tuple[Column, str]:
    return F.col(rule.name) < F.lit(rule.min_value), f"{rule.name} is below min value {rule.min_value}"


def rule_length(rule: ColumnRule) -> tuple[Column, str]:
    return F.length(rule.name) != rule.length, f"{rule.name} length does not equal {rule.length}"


def rule_pattern(rule: ColumnRule) -> tuple[Column, str]:
    return ~F.col(rule.name).rlike(rule.pattern), f"{rule.name} does not match pattern"


def contract_rules(contract: Contract, patterns: bool = False) -> list[tuple[Column, str]]:
    """(violated, reason) pairs in contract column order; pattern checks only on request."""
    rules = []
    for c in contract.columns:
        if not c.nullable:
            rules.append(rule_not_null(c))
        if c.accepted_values:
            rules.append(rule_enum(c))
        if c.min_value is not None:
            rules.append(rule_min(c))
        if c.length is not None:
            rules.append(rule_length(c))
        if patterns and c.pattern:
            rules.append(rule_pattern(c))
    return rules


def quarantine_reason(contract: Contract, patterns: bool = False) -> Column:
    """The first violated rule, NULL for a valid row."""
    reasons = [F.when(violated, F.lit(text)) for violated, text in contract_rules(contract, patterns)]
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def _text(nullable=False, **extra):
    return {"type": "string", "nullable": nullable, **extra}


def _money(**extra):
    return {"type": "decimal", "nullable": False, "min_value": 0.0, **extra}


# The retail contracts.
_DEFAULTS = {
    "customers": {
        "source_system": "CRM",
        "ownership": "crm-team",
        "freshness_sla_hours": 24,
        "columns": {
            "id": _text(primary_key=True),
            "first_name": _text(pii=True),
            "last_name": _text(pii=True),
            "email": _text(
                pii=True, pattern="^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$"
            ),
            "phone": _text(nullable=True, pii=True),
            "gender": _text(accepted_values=["M", "F", "OTHER", "UNKNOWN"]),
            "state": _text(length=2),
            "birth_date": {"type": "date", "nullable": True, "pii": True},
        },
    },
    "products": {
        "source_system": "INVENTORY",
        "ownership": "merchandising-team",
        "freshness_sla_hours": 12,
        "columns": {
            "id": _text(primary_key=True),
            "sku": _text(),
            "name": _text(),
            "category": _text(
                accepted_values=[
                    "Electronics",
                    "Apparel",
                    "Home & Kitchen",
                    "Beauty",
                    "Sports & Outdoors",
                    "Grocery",
                ]
            ),
            "price": _money(),
            "cost": _money(),
        },
    },
    "transactions": {
        "source_system": "POS_WEB_APP",
        "ownership": "sales-engineering-team",
        "freshness_sla_hours": 1,
        "columns": {
            "id": _text(primary_key=True),
            "transaction_id": _text(),
            "customer_id": _text(nullable=True),
            "store_id": _text(nullable=True),
            "channel": _text(accepted_values=["POS", "WEBSITE", "MOBILE_APP"]),
            "product_id": _text(),
            "quantity": {"type": "integer", "nullable": False, "min_value": 1},
            "unit_price": _money(),
            "discount": _money(),
            "transaction_timestamp": _text(),
        },
    },
    "stores": {
        "source_system": "STORES",
        "columns": {
            "id": _text(primary_key=True),
            "name": _text(),
            "city": _text(),
            "state": _text(),
            "country": _text(),
        },
    },
    "returns": {
        "source_system": "RETURNS",
        "columns": {
            "id": _text(primary_key=True),
            "transaction_id": _text(),
            "product_id": _text(),
            "quantity": {"type": "integer", "nullable": False, "min_value": 1},
            "refund_amount": _money(),
            "return_reason": _text(nullable=True),
            "return_timestamp": _text(nullable=True),
        },
    },
    "inventory_movements": {
        "source_system": "INVENTORY",
        "columns": {
            "id": _text(primary_key=True),
            "product_id": _text(),
            "store_id": _text(),
            "movement_type": _text(accepted_values=["RESTOCK", "DAMAGE", "SALE", "RETURN"]),
            "quantity": {"type": "integer", "nullable": False},
            "movement_timestamp": _text(nullable=True),
        },
    },
    "marketing_campaigns": {
        "source_system": "MARKETING",
        "columns": {
            "id": _text(primary_key=True),
            "campaign_name": _text(),
            "channel": _text(),
            "cost": _money(),
            "impressions": {"type": "integer", "nullable": True},
            "clicks": {"type": "integer", "nullable": True},
            "conversions": {"type": "integer", "nullable": True},
            "campaign_date": _text(nullable=True),
        },
    },
    "support_tickets": {
        "source_system": "CRM",
        "columns": {
            "id": _text(primary_key=True),
            "customer_id": _text(),
            "issue_category": _text(),
            "status": _text(accepted_values=["OPEN", "IN_PROGRESS", "RESOLVED"]),
            "priority": _text(nullable=True),
            "ticket_timestamp": _text(nullable=True),
            "resolution_timestamp": _text(nullable=True),
        },
    },
}

CONTRACTS = {t: contract_from_mapping(t, s) for t, s in _DEFAULTS.items()}
