"""The registered queries: name, function of (spark, sf_dir), SQL that gives the same rows where SQL can."""

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
