"""Column functions over VARIANT objects."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.functions.scalars import variant_path

#: Levels that are opened by nested expressions; a loop opens what is nested deeper.
UNROLLED = 12

_ROW = "struct<path:string,value:string,value_type:string,n_children:int>"


def as_map(v: Column, *keys: str, of: str = "variant") -> Column:
    """An object, or the nested member of one, as map<string,variant>; null for anything that is not an object.

    ``of`` is another type of the values: those that do not fit it are null. Only VARIANT values are written anew.
    """
    whole = f"map<string,{of}>"
    return child(v, *keys, as_type=whole) if keys else v.try_cast(whole)


def child(v: Column, *keys: str, as_type: str = "variant") -> Column:
    """Nested member of an object, null when it is absent.

    The path is followed in the binary value; no map is built on the way. A JSON null is a member. A member that
    stays a VARIANT is written anew with all below it, so a long path is cheaper than a child of a child.
    """
    return F.try_variant_get(v, variant_path(*keys), as_type)


def is_object(v: Column) -> Column:
    """Is the value an object? Its members are counted at most, and none is written anew; a path that leads to nothing
    would cost more."""
    return v.try_cast("struct<_:boolean>").isNotNull()


def members(df: DataFrame, col: str, key: str, value: str) -> DataFrame:
    """Rows of an object's members, as slices of its binary value; one row with nulls for anything
    without members. A list counts as such."""
    exploded = df.sparkSession.tvf.variant_explode_outer(F.col("_object").outer())
    return (
        df.withColumn("_object", F.when(is_object(F.col(col)), F.col(col)))
        .lateralJoin(exploded)
        .drop("_object", "pos")
        .withColumnsRenamed({"key": key, "value": value})
    )


def has_key(v: Column, key: str) -> Column:
    return child(v, key).isNotNull()


def entries(v: Column) -> Column:
    """Members of an object as an array of (key, value); empty for anything else."""
    return F.coalesce(
        F.map_entries(as_map(v)),
        F.array().cast("array<struct<key:string,value:variant>>"),
    )


def first_block(v: Column, path: Sequence[str], other: Sequence[str], of: str = "variant") -> Column:
    """The object at the first path as a map, or the one at the other path where the first leads to nothing. Something
    that is no object is not nothing."""
    return F.coalesce(as_map(v, *path, of=of), F.when(child(v, *path).isNull(), as_map(v, *other, of=of)))


def text(v: Column) -> Column:
    """Scalar as its text, array or object as JSON text; null for JSON null."""
    return v.cast("string")


def above(value: Column, threshold: float = 0.0) -> Column:
    """Is the number above the threshold? Never null."""
    # Spark orders NaN above all numbers, but it exceeds none of them.
    return F.coalesce((value > threshold) & ~F.isnan(value), F.lit(False))


def is_true(v: Column, *keys: str) -> Column:
    return F.coalesce(F.lower(child(v, *keys, as_type="string")) == "true", F.lit(False))


def _bound(path: Column, value: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of a path and an opened value, each worked out once however often f uses it. Opening an object writes all
    that is below it anew."""
    held = F.struct(path.alias("path"), as_map(value).alias("opened"))
    return F.element_at(F.transform(F.array(held), lambda h: f(h.getField("path"), h.getField("opened"))), 1)


def flatten(
    v: Column,
    max_depth: int | None = None,
    skip: Callable[[Column], Column] | None = None,
    inner: bool = False,
    prefix: Column | None = None,
) -> Column:
    """All leaves of an object as an array of (path, value, value_type, n_children).

    Paths are dotted. Empty objects vanish, arrays are leaves, and a text that happens to hold JSON
    stays a text. The whole tree is opened in one expression, so a table of payloads is read once
    whatever its depth: ``UNROLLED`` levels by nested expressions, and objects below them level by level in a
    loop. With a ``max_depth``, objects below that stay JSON text. ``skip`` drops members of the top level by key;
    ``inner`` adds a row for every object as well. With the ``prefix`` of its own path, a value that is no object is
    a leaf.
    """
    limited = max_depth is not None
    levels = max_depth if limited else UNROLLED

    def row(path: Column, value: Column, sub: Column | None) -> Column:
        kind = F.schema_of_variant(value)
        n = F.lit(0)
        if sub is not None:
            kind = F.when(sub.isNotNull(), F.lit("OBJECT")).otherwise(kind)
            n = F.coalesce(F.size(sub), F.lit(0))
        return F.struct(
            path.alias("path"),
            (F.lit(None).cast("string") if sub is not None and inner else text(value)).alias("value"),
            kind.alias("value_type"),
            n.alias("n_children"),
        )

    def deep(path: Column, value: Column) -> Column:
        """Everything below an object of any depth."""

        def open_all(held: Column, _: Column) -> Column:
            def below(o: Column) -> Column:
                def member(e: Column) -> Column:
                    name = F.concat(o.getField("path"), F.lit("."), e.getField("key"))
                    return F.struct(name.alias("path"), e.getField("value").alias("value"))

                return F.transform(F.map_entries(as_map(o.getField("value"))), member)

            def one(m: Column) -> Column:
                value = m.getField("value")
                return row(m.getField("path"), value, as_map(value) if inner else None)

            def is_object(m: Column) -> Column:
                return as_map(m.getField("value")).isNotNull()

            found = F.flatten(F.transform(held.getField("open"), below))
            shown = found if inner else F.filter(found, lambda m: ~is_object(m))
            return F.struct(
                F.concat(held.getField("done"), F.transform(shown, one)).alias("done"),
                F.filter(found, is_object).alias("open"),
            )

        start = F.struct(
            F.array().cast(f"array<{_ROW}>").alias("done"),
            F.array(F.struct(path.alias("path"), value.alias("value"))).alias("open"),
        )
        # an object has no more levels than braces
        braces = F.length(F.regexp_replace(text(value), "[^{]", ""))
        return F.aggregate(F.sequence(F.lit(1), braces), start, open_all, lambda held: held.getField("done"))

    def leaves(sub: Column, prefix: Column | None, depth: int) -> Column:
        def one(e: Column) -> Column:
            key, value = e.getField("key"), e.getField("value")
            path = key if prefix is None else F.concat(prefix, F.lit("."), key)
            if depth <= 1 and limited:
                return F.array(row(path, value, None))

            def shown(path: Column, opened: Column) -> Column:
                below = leaves(opened, path, depth - 1) if depth > 1 else deep(path, value)
                if inner:
                    below = F.concat(F.array(row(path, value, opened)), below)
                return F.when(opened.isNotNull(), below).otherwise(F.array(row(path, value, None)))

            return _bound(path, value, shown)

        pairs = F.map_entries(sub)
        if prefix is None and skip is not None:
            pairs = F.filter(pairs, lambda e: ~skip(e.getField("key")))
        return F.flatten(F.transform(pairs, one))

    if prefix is None:
        return leaves(as_map(v), None, levels)
    whole = F.array(row(prefix, v, None))
    if levels < 1:
        return whole
    return _bound(
        prefix, v, lambda path, opened: F.when(opened.isNotNull(), leaves(opened, path, levels)).otherwise(whole)
    )


def open_levels(
    df: DataFrame, col: str, levels: int, skip: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Opens the upper levels of an object: rows of (path, held) beside the other columns.

    Members come as slices here, while opening a whole tree in one expression rewrites every leaf
    once per level, in an expression that is not compiled. A slice refers to the key dictionary of the whole
    payload, which is written out where the rows leave the compiled stage. ``skip`` drops members of the top level by key.
    """
    rest = [c for c in df.columns if c != col]
    rows = df.select(*rest, F.lit(None).cast("string").alias("path"), F.col(col).alias("held"))
    for level in range(levels):
        opened = members(rows, "held", "member_key", "member_value")
        if level == 0 and skip is not None:
            opened = opened.filter(F.col("member_key").isNotNull() & ~skip(F.col("member_key")))
        is_leaf = F.col("member_key").isNull()
        rows = opened.select(
            *rest,
            F.when(is_leaf, F.col("path"))
            .otherwise(F.concat_ws(".", "path", "member_key"))
            .alias("path"),
            F.when(is_leaf, F.col("held")).otherwise(F.col("member_value")).alias("held"),
        )
    return rows.filter(F.col("path").isNotNull())


def leaf_rows(
    df: DataFrame,
    col: str,
    upper_levels: int,
    max_depth: int | None = None,
    skip: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """All leaves of an object, as ``flatten`` gives them: rows of (path, value, value_type) beside the other columns.

    The upper levels become rows, and what is a leaf by then is done, in compiled code. Only objects below them are
    opened in one expression, so leaves go on without the VARIANT they came from.
    """
    levels = upper_levels if max_depth is None else min(upper_levels, max_depth)
    below = None if max_depth is None else max_depth - levels
    rest = [c for c in df.columns if c != col]
    opened = is_object(F.col("held"))
    rows = open_levels(df, col, levels, skip).select(
        *rest,
        "path",
        F.when(~opened, text(F.col("held"))).alias("value"),
        F.when(~opened, F.schema_of_variant("held")).alias("value_type"),
        F.when(opened, F.col("held")).alias("held"),
    )
    # A column of its own: a generator with the whole expression in it would not be compiled, for any row.
    deeper = F.when(F.col("held").isNotNull(), flatten(F.col("held"), below, prefix=F.col("path")))
    rows = rows.select(*rest, "path", "value", "value_type", deeper.alias("deeper"))
    leaf = F.struct("path", "value", "value_type", F.lit(0).alias("n_children"))
    found = F.inline(F.coalesce("deeper", F.array(leaf)))
    return rows.select(*rest, found.alias("leaf_path", "leaf_value", "leaf_type", "n_children")).select(
        *rest,
        F.col("leaf_path").alias("path"),
        F.col("leaf_value").alias("value"),
        F.col("leaf_type").alias("value_type"),
    )
