"""Operators for preparing language-model training data. Nothing else in the library imports this."""


def queries() -> dict:
    from pricetide.llm import registered as _  # noqa: F401
    from pricetide.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict:
    from pricetide.llm import registered as _  # noqa: F401
    from pricetide.llm.registry import SQL

    return dict(SQL)
