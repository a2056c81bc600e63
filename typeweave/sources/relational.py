"""Graphs from relational tables, and snapshots of graphs in Parquet.

Every row of a node table is a node whose type is a name made of a prefix and the row's key; every
pair of keys of an edge table is an edge whose term is a constant of that pair of types. Nothing is
computed here: the graph's tables are plans over the given ones, so filters on constants, kinds and
properties prune whole branches and reach the scans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeweave.api import Graph
from typeweave.functions.errors import PatternError
from typeweave.functions.types import arrow_family, arrow_uid, var_uid
from typeweave.functions.values import PROPS, cell_column
from typeweave.operators.frames import ANY, EDGES, NODES, TABLES, TERMS, TYPES, Frames
from typeweave.plans.inference import Constant


@dataclass
class NodeTable:
    """Nodes prefix_<key> with a property for each column, and kind."""

    kind: str
    df: DataFrame
    key: str


@dataclass
class EdgeTable:
    """Edges constant: <start>_<key> -> <end>_<key>.

    Of several rows of one pair, that with the largest order stays, with a property for each of its other
    columns; without order, edges have no properties. repeats=False says that no pair comes twice,
    as with a key at the start, so that none need be looked for.
    """

    constant: str
    start: str
    end: str
    df: DataFrame
    start_key: str
    end_key: str
    order: tuple[str, ...] = ()
    repeats: bool = True


def _tag(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "i"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "d"
    return "b" if isinstance(kind, T.BooleanType) else "s"


def props_column(df: DataFrame, columns: list[str], **literals: str) -> Column:
    """A property map of columns, and of literal strings."""
    parts: list[Column] = []
    for name in columns:
        parts += [F.lit(name), cell_column(F.col(name), _tag(df.schema[name].dataType))]
    for name, value in literals.items():
        parts += [F.lit(name), cell_column(F.lit(value), "s")]
    if not parts:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<t:string,i:bigint,d:double,b:boolean,s:string,j:string>>")).cast(PROPS)
    return F.create_map(*parts)


def _name(kind: str, key: str) -> Column:
    return F.concat(F.lit(kind + "_"), F.col(key).cast("string"))


def _family(df: DataFrame, kind: str, key: str) -> str | None:
    """The family of a table's names; None if they may have several."""
    return kind if _tag(df.schema[key].dataType) == "i" and re.fullmatch("[A-Za-z0-9_]+", kind, re.ASCII) else ANY


def _empty(kind: str) -> Column:
    return F.lit(None).cast(kind)


def graph_from_tables(spark: SparkSession, nodes: list[NodeTable], edges: list[EdgeTable], constants: list[Constant] | None = None) -> Graph:
    """A graph over relational tables; edges of a constant T -> U are declared as (S:*) -> (T:*).

    Rows with a null key are no nodes, and pairs with one no edges. Keys of node tables are taken as unique.
    """
    kinds = [(t.start, t.end) for t in edges]
    if len(set(kinds)) < len(kinds) or len({t.kind for t in nodes}) < len(nodes):
        raise PatternError("each kind of nodes, and each pair of kinds, may have one table: an edge is named by its ends")
    parts: dict[str, dict] = {name: {} for name in TABLES}

    def add(name: str, key: object, df: DataFrame) -> None:
        parts[name][key] = parts[name][key].unionByName(df) if key in parts[name] else df

    for table in nodes:
        name, df = _name(table.kind, table.key), table.df.where(F.col(table.key).isNotNull())
        family = _family(df, table.kind, table.key)
        add("nodes", family, df.select(var_uid(name).alias("uid"), name.alias("type"), F.lit("n").alias("arrow"), props_column(df, df.columns, kind=table.kind).alias("props")))
        add("types", family, df.select(var_uid(name).alias("uid"), F.lit("var").alias("kind"), name.alias("name"), _empty("binary").alias("left_uid"), _empty("binary").alias("right_uid"), name.alias("repr")))
    for table in edges:
        df = table.df.where(F.col(table.start_key).isNotNull() & F.col(table.end_key).isNotNull())
        kept = [c for c in table.df.columns if c not in (table.start_key, table.end_key)] if table.order else []
        if table.order:
            top = F.max(F.struct(*table.order, *(c for c in kept if c not in table.order))).alias("_top")
            pairs = df.select(table.start_key, table.end_key).distinct()
            df = df.groupBy(table.start_key, table.end_key).agg(top).select(table.start_key, table.end_key, *(F.col("_top")[c].alias(c) for c in kept))
        else:
            df = pairs = df.select(table.start_key, table.end_key).distinct() if table.repeats else df
        start, end = _name(table.start, table.start_key), _name(table.end, table.end_key)
        uid = arrow_uid(var_uid(start), var_uid(end))
        shown = F.concat(F.lit("("), start, F.lit(" -> "), end, F.lit(")"))
        full = F.to_json(F.array(F.lit(table.constant), shown))
        ends = _family(df, table.start, table.start_key), _family(df, table.end, table.end_key)
        link, family = (ANY, ANY) if ANY in ends else (ends, arrow_family(*ends))
        add("edges", link, df.select(var_uid(start).alias("start_uid"), var_uid(end).alias("end_uid"), uid.alias("type_uid"), F.lit("base").alias("t_kind"), F.lit(table.constant).alias("t_name"), start.alias("start_type"), end.alias("end_type"), F.lit(table.constant).alias("term"), full.alias("full"), props_column(df, kept).alias("props")))
        add("types", family, pairs.select(uid.alias("uid"), F.lit("arr").alias("kind"), _empty("string").alias("name"), var_uid(start).alias("left_uid"), var_uid(end).alias("right_uid"), shown.alias("repr")))
        add("terms", family, pairs.select(uid.alias("type_uid"), F.lit("y").alias("arrow"), F.lit("base").alias("kind"), F.lit(table.constant).alias("name"), _empty("binary").alias("function_uid"), _empty("binary").alias("argument_uid"), F.lit(table.constant).alias("repr"), full.alias("full")))

    frames = Frames(*(parts[name] or spark.createDataFrame([], schema) for name, schema in zip(TABLES, (TYPES, TERMS, NODES, EDGES), strict=True)))
    named = {c.name: c for c in constants or []}
    for table in edges:
        named.setdefault(table.constant, Constant(table.constant, "(S:*) -> (T:*)"))
    return Graph.from_frames(spark, frames, list(named.values()))


def save(graph: Graph, path: str) -> None:
    """Writes a graph's tables as Parquet, edges ordered by their start so that scans skip."""
    frames = graph.frames()
    for name in TABLES:
        df = getattr(frames, name)
        (df.sortWithinPartitions("start_uid") if name == "edges" else df).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, constants: list[Constant] | None = None) -> Graph:
    """A graph that save() wrote."""
    schemas = dict(zip(TABLES, (TYPES, TERMS, NODES, EDGES), strict=True))
    frames = Frames(*(spark.read.schema(schemas[name]).parquet(f"{path}/{name}") for name in TABLES))
    return Graph.from_frames(spark, frames, constants)
