"""Normal forms of paths against the root of a repository."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Why a path has no normal form.
ABSOLUTE, OUTSIDE = "absolute, and no root is given", "outside the root"


def _steps(path: Column) -> Column:
    """The steps of a path without ``.``, doubled slashes and steps that are taken back; the first is empty."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    back = lambda held, x: F.when((x == "..") & ~F.element_at(held, -1).isin("", ".."), F.slice(held, 1, F.size(held) - 1)).otherwise(F.array_append(held, x))
    return F.aggregate(steps, F.array(F.lit("")), back)  # the root stands first, so nothing is taken from an empty list


def _joined(steps: Column) -> Column:
    return F.array_join(F.filter(steps, lambda x: x != ""), "/")


def normal_path(path: Column, root: str | None = None) -> Column:
    """``path`` and ``note`` of a path: its form below the root, as listings have it, or the reason why it has none.

    A relative path is taken from the root. An absolute one needs ``root``, and must lie below it. The root itself is empty. A
    null path has neither; a path without a normal form keeps the one it has, so that it can be shown.
    """
    steps = _steps(path)
    away = F.array_contains(steps, "..")
    relative = F.when(away, F.struct(path.alias("path"), F.lit(OUTSIDE).alias("note"))).otherwise(F.struct(_joined(steps).alias("path"), F.lit(None).cast("string").alias("note")))
    if root is None:
        absolute = F.struct(path.alias("path"), F.lit(ABSOLUTE).alias("note"))
    else:
        # from the root of the file system ".." leads nowhere
        whole = F.filter(steps, lambda x: x != "..")
        base = [x for x in root.split("/") if x]
        below = F.slice(whole, F.lit(2), len(base)) == F.array(*map(F.lit, base)).cast("array<string>")
        inside = F.lit(True) if not base else below
        rest = F.slice(whole, F.lit(len(base) + 2), F.greatest(F.size(whole) - len(base) - 1, F.lit(0)))
        absolute = F.when(inside, F.struct(_joined(rest).alias("path"), F.lit(None).cast("string").alias("note"))).otherwise(F.struct(path.alias("path"), F.lit(OUTSIDE).alias("note")))
    return F.when(path.isNotNull(), F.when(F.startswith(path, F.lit("/")), absolute).otherwise(relative))


def folders(path: Column) -> Column:
    """All folders that a path below the root lies in, the root (an empty path) among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
