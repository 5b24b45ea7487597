"""A list of queries with their SQL, filled by a decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binding import Star


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None):
        """Registers a function of a Star under its name."""

        def put(f: Callable[[Star], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return put


def md5_mod(expr: str, n: int | str) -> str:
    """DuckDB: the 128-bit md5 of a text mod n, a number or a column."""
    half = lambda at: f"('0x' || substr(md5({expr}), {at}, 16))::UBIGINT"
    return f"((({half(1)} % {n})::HUGEINT * {2**64 % n if isinstance(n, int) else f"(18446744073709551616::HUGEINT % {n})"} + {half(17)} % {n}) % {n})::INTEGER"


def pick(options: list[str], expr: str) -> str:
    return f"[{', '.join(repr(o) for o in options)}][{md5_mod(expr, len(options))} + 1]"
