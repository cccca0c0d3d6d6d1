"""Nested columns as leaf entries with repetition and definition levels, and back.

``shred`` is a chain of generators, so it needs no shuffle. ``assemble`` groups
by the key columns once for each leaf; all its groupings and joins share that
partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Step:
    """A field of a struct (``name``), the elements of an array or the entries of a map."""

    kind: str  # field, element or entry
    name: str
    nullable: bool


@dataclass(frozen=True)
class Leaf:
    path: str
    steps: tuple[Step, ...]
    type: T.DataType
    max_rep: int
    max_def: int


def leaves(schema: T.StructType) -> list[Leaf]:
    """Every leaf column, its dotted path as in a file, and its largest levels. Nullable nodes and repeated ones add a definition level, repeated ones a repetition level."""
    out: list[Leaf] = []

    def walk(kind: T.DataType, steps: tuple[Step, ...], path: tuple[str, ...], rep: int, most: int) -> None:
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f.dataType, (*steps, Step("field", f.name, f.nullable)), (*path, f.name), rep, most + f.nullable)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, (*steps, Step("element", "", kind.containsNull)), (*path, "list", "element"), rep + 1, most + 1 + kind.containsNull)
        elif isinstance(kind, T.MapType):
            entry = (*steps, Step("entry", "", False))
            walk(kind.keyType, (*entry, Step("field", "key", False)), (*path, "key_value", "key"), rep + 1, most + 1)
            walk(kind.valueType, (*entry, Step("field", "value", kind.valueContainsNull)), (*path, "key_value", "value"), rep + 1, most + 1 + kind.valueContainsNull)
        else:
            out.append(Leaf(".".join(path), steps, kind, rep, most))

    walk(schema, (), (), 0, 0)
    return out


def leaf(schema: T.StructType, path: str) -> Leaf:
    found = [x for x in leaves(schema) if x.path == path]
    if not found:
        raise KeyError(f"no leaf {path}; there are {', '.join(x.path for x in leaves(schema))}")
    return found[0]


def shred(df: DataFrame, keys: list[str], path: str, schema: T.StructType | None = None) -> DataFrame:
    """``keys``, at, rep, def, max_def, value: one row for each entry of one leaf.

    ``at`` has the position in each list around the entry (from 0; 0 for the
    one entry that stands for a null or empty list). ``value`` is null wherever
    ``def`` is below ``max_def``. Levels are those of ``schema``, by default the
    frame's; Spark takes every column of a file for nullable, so a file with
    required nodes needs that of ``reader.stated_schema``.
    """
    of = leaf(schema or df.schema, path)
    held = [F.col(f"`{k}`") for k in keys]
    first, *rest = of.steps
    value = F.col(f"`{first.name}`")
    out = df.select(*held, value.alias("__v"), (value.isNotNull().cast("int") if first.nullable else F.lit(0)).alias("__d"), F.lit(0).alias("__r"), F.expr("cast(array() as array<int>)").alias("__at"))
    depth = 0
    for step in rest:
        v, d = F.col("__v"), F.col("__d")
        if step.kind == "field":
            v = v.getField(step.name)
            out = out.select(*held, v.alias("__v"), (d + (v.isNotNull().cast("int") if step.nullable else 0)).alias("__d"), "__r", "__at")
            continue
        depth += 1
        filled = F.coalesce((F.size(v) > 0).cast("int"), F.lit(0))
        out = out.select(*held, (d + filled).alias("__d"), "__r", "__at", F.posexplode_outer(F.map_entries(v) if step.kind == "entry" else v).alias("__p", "__v"))
        defined = F.col("__v").isNotNull().cast("int") if step.nullable else F.lit(0)
        at = F.coalesce("__p", F.lit(0))
        out = out.select(*held, "__v", (F.col("__d") + defined).alias("__d"), F.when(at > 0, depth).otherwise(F.col("__r")).alias("__r"), F.concat("__at", F.array(at)).alias("__at"))
    return out.select(*held, F.col("__at").alias("at"), F.col("__r").alias("rep"), F.col("__d").alias("def"), F.lit(of.max_def).alias("max_def"), F.col("__v").alias("value"))


def is_defined(shredded: DataFrame) -> Column:
    return shredded["def"] == shredded["max_def"]


def record_numbers(entries: DataFrame, position: str, by: list[str] | None = None) -> DataFrame:
    """``entries`` with row_id: the number, from 1, of the record each belongs to, within each column chunk (``by``).

    A record starts at every repetition level 0. Without ``by``, all entries
    are one chunk and go through one task; at scale give the file and row group.
    """
    from pyspark.sql import Window

    span = Window.partitionBy(*(by or [])).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("row_id", F.sum((F.col("rep") == 0).cast("bigint")).over(span))


def _nested(entries: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """keys, r: the entries of each key as arrays nested ``depth`` deep of (def, value)."""
    out = entries.select(*keys, "at", F.struct("def", "value").alias("r"))
    for level in range(depth, 0, -1):
        places = [F.col("at")[i].alias(f"__p{i}") for i in range(level)]
        grouped = out.select(*keys, *places, "r").groupBy(*keys, *(f"__p{i}" for i in range(level - 1)))
        out = grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"__p{level - 1}").alias("p"), F.col("r").alias("r")))), lambda x: x["r"]).alias("r"))
        out = out.select(*keys, F.array(*(f"__p{i}" for i in range(level - 1))).alias("at") if level > 1 else F.expr("cast(array() as array<int>)").alias("at"), "r")
    return out.select(*keys, "r")


def _build(kind: T.DataType, nullable: bool, path: tuple[str, ...], seen: int, nested: dict[str, tuple[Column, int]]) -> Column:
    """The value of a node from the nested entries of the leaves below it; ``seen``: the definition level around it."""
    some, depth = next(iter(nested.values()))
    for _ in range(depth):
        some = some[0]
    level = some.getField("def")
    here = seen + nullable
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind:
            inner = (*path, f.name)
            below = {p: x for p, x in nested.items() if p == ".".join(inner) or p.startswith(".".join(inner) + ".")}
            parts.append(_build(f.dataType, f.nullable, inner, here, below).alias(f.name))
        return F.when(level >= here, F.struct(*parts))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        first = next(iter(nested.values()))[0]
        count = F.sequence(F.lit(0), F.size(first) - 1)
        down = lambda i: {p: (x[i], n - 1) for p, (x, n) in nested.items()}
        if isinstance(kind, T.ArrayType):
            full = F.transform(count, lambda i: _build(kind.elementType, kind.containsNull, (*path, "list", "element"), here + 1, down(i)))
        else:
            entry = T.StructType([T.StructField("key", kind.keyType, False), T.StructField("value", kind.valueType, kind.valueContainsNull)])
            full = F.transform(count, lambda i: _build(entry, False, (*path, "key_value"), here + 1, down(i)))
        out = F.when(level > here, full).when(level == here, F.slice(full, 1, 0))
        return out if isinstance(kind, T.ArrayType) else F.map_from_entries(out)
    return F.when(level == here, some.getField("value"))


def assemble(parts: dict[str, DataFrame], keys: list[str], schema: T.StructType) -> DataFrame:
    """``keys`` and the columns of ``schema``, from the shredded form of each of its leaves by path.

    The leaves are zipped on the keys; a record that one of them lacks raises an
    error.
    """
    wanted = leaves(schema)
    missing = [x.path for x in wanted if x.path not in parts]
    if missing:
        raise KeyError(f"no entries for {', '.join(missing)}")
    frames = [_nested(parts[x.path], keys, x.max_rep).withColumnRenamed("r", f"__{i}") for i, x in enumerate(wanted)]
    joined = zip_columns(frames, keys)
    nested = {x.path: (F.col(f"__{i}"), x.max_rep) for i, x in enumerate(wanted)}
    columns = []
    for f in schema:
        below = {p: x for p, x in nested.items() if p == f.name or p.startswith(f.name + ".")}
        columns.append(_build(f.dataType, f.nullable, (f.name,), 0, below).alias(f.name))
    return joined.select(*keys, *columns)


def zip_columns(columns: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames that share ``keys``, side by side; a row that one of them lacks raises an error."""
    marks = [f"__there{i}" for i in range(len(columns))]
    joined = reduce(lambda a, b: a.join(b, keys, "full"), (c.withColumn(m, F.lit(True)) for c, m in zip(columns, marks)))
    everywhere = reduce(lambda a, b: a & b, (F.col(m).isNotNull() for m in marks))
    return joined.where(F.when(everywhere, True).otherwise(F.raise_error(F.lit("columns of different rows")).cast("boolean"))).drop(*marks)
