"""Registry of named queries; each has a Spark form and, where SQL can say it, a DuckDB form."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.stopwords import PROFILE, SCORING
from ..sources.fixtures import Fixture, duck_ctes

QUERIES: dict[str, Callable[[Fixture], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str | None = "decisions"):
    """Register a query. `sql` is the oracle body; `needs` names the derived views it reads."""

    def add(fn: Callable[[Fixture], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if needs is None:
                ORACLES[name] = body
            elif body.startswith("with "):
                ORACLES[name] = duck_ctes(*needs.split()) + ",\n" + body[len("with "):]
            else:
                ORACLES[name] = duck_ctes(*needs.split()) + "\n" + body
        return fn

    return add


def once(sql: str) -> str:
    """The text with every CTE worked out once and as it stands, so that no plan repeats it or reorders its joins."""
    return re.sub(r"(\w+) as \(\s*(?=select)", r"\1 as materialized (", sql)


# ---- snippets of DuckDB text used by several oracles

def _stop_list(stop) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in stop) + "]"


def sql_toks(expr: str, stop=SCORING) -> str:
    """Filtered token list, repeats kept."""
    return (f"list_filter(list_transform(regexp_extract_all({expr}, '[A-Za-z][A-Za-z0-9_-]+'), lambda x: lower(x)), "
            f"lambda x: not list_contains({_stop_list(stop)}, x))")


def sql_tokset(expr: str, stop=SCORING) -> str:
    return f"list_distinct({sql_toks(expr, stop)})"


def sql_words(expr: str) -> str:
    return rf"regexp_extract_all(lower({expr}), '[\p{{L}}\p{{N}}_]+')"


def sql_wordset(expr: str) -> str:
    return f"list_distinct({sql_words(expr)})"


def sql_common(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def sql_jaccard(a: str, b: str) -> str:
    return (f"(case when len({a}) + len({b}) = 0 then 0.0 else {sql_common(a, b)}::double / "
            f"(len({a}) + len({b}) - {sql_common(a, b)}) end)")


# sites of the training side of the group split
TRAIN_SITES = ("(select site_token from (select site_token, row_number() over (order by md5(concat('42|', site_token)), site_token) as k, count(*) over () as n from (select distinct site_token from decisions) q) z where k > ceil(n*0.2))")
PROFILE_TOKS = lambda e: sql_toks(e, PROFILE)
