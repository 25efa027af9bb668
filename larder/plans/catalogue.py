"""All queries of the basket engine by name, with the SQL that says the same."""

from __future__ import annotations

from larder.plans import cook, desk, kitchen, live, market, planning, pricing, recipes, records, shopping, tiers

ALL = pricing.QUERIES | planning.QUERIES | shopping.QUERIES | recipes.QUERIES | records.QUERIES | kitchen.QUERIES | market.QUERIES | tiers.QUERIES | live.QUERIES | cook.QUERIES | desk.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
