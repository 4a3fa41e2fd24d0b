"""The registered queries of the library, with DuckDB SQL that gives the same rows."""

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir), and its SQL if there is any."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from . import capture, clouds, scalars, sessions, tensors  # noqa: E402, F401
