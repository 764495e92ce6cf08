"""Registered queries and their SQL. plans/ fills it on import."""
QUERIES: dict = {}
ORACLE: dict = {}
FLAGSHIP = "review_flow"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


from . import plans  # noqa: E402

plans.load()
