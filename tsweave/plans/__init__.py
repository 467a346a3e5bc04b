"""Queries of the library's operators over the driver's tables, each with SQL that gives the same rows."""


def queries() -> dict:
    from . import extras, files, inputs, market, research  # noqa: F401

    return dict(inputs.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    from . import inputs

    return dict(inputs.SQL)
