"""Four ways to tell a test source, as the tools that use them differ, and other path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slashes(path: Column | str) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def is_test_source(path: Column | str) -> Column:
    """Case-sensitive; false for a null path."""
    p = slashes(path)
    return F.coalesce(p.contains("src/test/") | p.endswith("Test.java") | p.endswith("Tests.java") | p.endswith(".spec.ts"), F.lit(False))


def is_production_sql(path: Column | str) -> Column:
    """As a chain of NOT LIKE: blind to case, and null for a null path."""
    p = F.lower(_c(path))
    return ~p.like("%src/test/%") & ~p.like("%test.java") & ~p.like("%tests.java") & ~p.like("%.spec.ts")


def is_under_test_dir(path: Column | str) -> Column:
    p = slashes(path)
    return F.coalesce(p.startswith("src/test/") | p.contains("/src/test/"), F.lit(False))


def is_guard_test(path: Column | str) -> Column:
    p = slashes(path)
    return is_under_test_dir(path) | F.coalesce(p.endswith("Test.java") | p.endswith(".spec.ts") | p.startswith("e2e/") | p.contains("/e2e/"), F.lit(False))


def in_package(name: Column | str, package: str) -> Column:
    return (_c(name) == package) | _c(name).startswith(package + ".")


def below_package_sql(name: Column | str, package: str) -> Column:
    """As LIKE 'package.%': blind to case, without the package itself."""
    return F.lower(_c(name)).startswith(package.lower() + ".")


def path_contains(path: Column | str, part: str) -> Column:
    return F.lower(_c(path)).contains(part.lower())


def directory(path: Column | str) -> Column:
    return F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1)
