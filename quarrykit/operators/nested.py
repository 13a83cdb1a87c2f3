"""Deeply nested records to flat tables with parent-child links.

JSON text is read once into VARIANT.  Every level of nesting is a ``transform`` over the
nodes of the level above that attaches the ancestor's key and the index, ``flatten`` joins
the arrays of all parents, and one ``inline`` per target table emits the rows.  Nothing is
shuffled but the pick of one row per record key.

Defined results: null, empty and unreadable JSON, and JSON with text behind its end, give no
rows; JSON text inside one JSON string is read through, strings further in stay strings;
elements of arrays that are not objects give no row (their inner arrays are still entered).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.session import spread

#: Columns the operator makes while it works; prefixed so that input columns cannot clash.
_KEY, _NAME, _VALUE, _DEPTH = "_q_key", "_q_name", "_q_value", "_q_depth"


def latest(df: DataFrame, keys: Iterable[str], values: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row per key, that of the greatest ``order`` (nulls least, ties by the values).

    An aggregate with map-side combine: a key that holds a third of all rows is reduced before
    the shuffle.
    """
    keys, values, order = list(keys), list(values), list(order)
    rank = F.struct(*[F.col(c) for c in order], *[F.xxhash64(F.col(c)).alias(f"h{i}") for i, c in enumerate(values)])
    picked = df.groupBy(*[F.col(k).alias(k) for k in keys]).agg(F.max_by(F.struct(*values), rank).alias("_q_row"))
    return spread(picked.select(*keys, *[F.col("_q_row")[v].alias(v) for v in values]), *keys)


def json_text(column: Column) -> Column:
    """The JSON text itself, also where it is stored as one JSON string that holds it."""
    trimmed = F.btrim(column, F.lit(" \t\r\n"))
    inner = F.btrim(F.try_variant_get(F.try_parse_json(trimmed), "$", "string"), F.lit(" \t\r\n"))
    return F.when(trimmed.startswith('"') & trimmed.endswith('"'), inner).otherwise(trimmed)


def _brackets(text: Column) -> Column:
    """What is left of JSON text without strings and anything but brackets, as an array."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "")
    return F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")


def parsed(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """One row per record and readable JSON column: key, column name, variant and depth."""
    text = F.explode(F.array(*[F.struct(F.lit(c).alias("n"), json_text(F.col(c)).alias("t")) for c in columns]))
    rows = df.select(F.col(key).alias(_KEY), text.alias("_q_e")).select(_KEY, F.col("_q_e.n").alias(_NAME), F.col("_q_e.t").alias("_q_text"))
    t = F.col("_q_text")
    rows = rows.where((t.startswith("{") | t.startswith("[")) & (t.endswith("}") | t.endswith("]")))
    # depth: deepest nesting; ends: how often the outermost bracket closes (once in one document)
    fold = F.aggregate(
        _brackets(F.col("_q_text")),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("depth"), F.lit(0).alias("ends")),
        lambda a, c: F.struct(
            (a["now"] + _step(c)).alias("now"),
            F.greatest(a["depth"], a["now"] + _step(c)).alias("depth"),
            (a["ends"] + F.when((_step(c) == -1) & (a["now"] == 1), 1).otherwise(0)).alias("ends"),
        ),
    )
    rows = rows.select(_KEY, _NAME, F.try_parse_json("_q_text").alias(_VALUE), fold.alias("_q_f"))
    return rows.where(F.col(_VALUE).isNotNull() & (F.col("_q_f.ends") == 1)).select(_KEY, _NAME, _VALUE, F.col("_q_f.depth").alias(_DEPTH))


def _step(c: Column) -> Column:
    return F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)


_KIND = "substring(schema_of_variant({v}), 1, 5)"
#: A node: its members if it is an object, its items if it is an array; each value is looked at once, one level deep.
_MADE = """named_struct('path', {path}, 'owner', {owner}, 'item', {item},
  'members', map_entries(try_variant_get({v}, '$', 'map<string,variant>')), 'items', try_variant_get({v}, '$', 'array<variant>'), 'v', {v})"""
_OWNER = "if(n.item and n.members is not null, n.path, n.owner)"
#: What stands below the nodes of a level: per key of an object, per position of an array; scalars are dropped.
_CHILDREN = f"""filter(flatten(transform(acc.open, n -> concat(
  transform(coalesce(n.members, array()), e -> {_MADE.format(path="concat(n.path, '.', e.key)", owner=_OWNER, item="false", v="e.value")}),
  transform(coalesce(n.items, array()), (x, i) -> {_MADE.format(path="concat(n.path, '[', cast(i as string), ']')", owner=_OWNER, item="true", v="x")})))),
  c -> c.members is not null or c.items is not null)"""
_DONE = "transform(filter({nodes}, c -> c.item and c.members is not null), c -> named_struct('path', c.path, 'owner', c.owner, 'v', c.v))"


def element_objects(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Each JSON object that is an element of an array, at any depth: (key, path, parent_path, value).

    A fold with one step per level of the record's own nesting, so the depth has no bound.
    ``path`` begins with the column's name, adds ``.key`` and ``[i]``; ``parent_path`` is the
    path of the nearest enclosing object that is itself an array element, else the column's
    name.  ``value`` is the object as VARIANT.  Rows of the input are taken as records: pick one
    row per key first (:func:`latest`).
    """
    node = "array<struct<path:string,owner:string,item:boolean,members:array<struct<key:string,value:variant>>,items:array<variant>,v:variant>>"
    done = "array<struct<path:string,owner:string,v:variant>>"
    start = f"""named_struct(
      'open', cast(array({_MADE.format(path=_NAME, owner=_NAME, item="false", v=_VALUE)}) as {node}),
      'done', cast(array() as {done}))"""
    step = f"""transform(array({_CHILDREN}), kids -> named_struct(
      'open', cast(kids as {node}), 'done', cast(concat(acc.done, {_DONE.format(nodes="kids")}) as {done})))[0]"""
    rows = parsed(df, key, columns).select(
        _KEY, F.expr(f"aggregate(sequence(1, {_DEPTH}), {start}, (acc, level) -> {step}, acc -> acc.done)").alias("_q_all")
    )
    return rows.select(F.col(_KEY).alias(key), F.inline("_q_all").alias("path", "parent_path", "value"))


def flat_table(df: DataFrame, key: str, column: str, steps: Iterable[str], fields: Mapping[str, str]) -> DataFrame:
    """One target table: the objects in the arrays at ``steps``, below one another.

    ``steps`` are keys (dotted where objects lie between) whose arrays are entered in turn, as
    ``["modules", "files"]``; no step stands for a top-level array and is written ``""``.
    ``fields`` maps a dotted key of the object to its type; a field that is missing, null or of
    another type is null.  Result: key, path, parent_path, the fields.
    """
    steps = list(steps)
    nodes = f"array(named_struct('parent_path', cast(null as string), 'path', {_NAME}, 'v', {_VALUE}))"
    for s in steps:
        at = "$" + "".join(f'["{k}"]' for k in s.split(".") if k)
        dot = f".{s}" if s else ""
        nodes = f"""filter(flatten(transform({nodes}, n -> transform(
          coalesce(try_variant_get(n.v, '{at}', 'array<variant>'), array()), (x, i) -> named_struct(
          'parent_path', n.path, 'path', concat(n.path, '{dot}[', cast(i as string), ']'), 'v', x)))),
          n -> {_KIND.format(v="n.v")} = 'OBJEC')"""
    rows = parsed(df, key, [column]).select(F.col(_KEY).alias(key), F.inline(F.expr(nodes)).alias("parent_path", "path", _VALUE))
    values = [F.try_variant_get(_VALUE, "$" + "".join(f'["{k}"]' for k in f.split(".")), t).alias(f.replace(".", "_")) for f, t in fields.items()]
    return rows.select(key, "path", "parent_path", *values)
