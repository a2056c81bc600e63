"""The public interface: Graph, Query, Constant and the elements that queries return."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.functions.conditions import lenient, to_sql, tokens
from typeweave.functions.errors import MissingError, PatternError
from typeweave.functions.types import show_term, show_type, shown_uid, type_uid
from typeweave.functions.values import PROPS, plain_props, props_of, show_props, shown_props
from typeweave.operators.frames import Frames, LocalStore, local_frame
from typeweave.operators.tables import TableStore, literal_props
from typeweave.plans.inference import Constant, bound, infer
from typeweave.plans.match import SHOWN, Matcher, Rows, column, edge_shown
from typeweave.plans.patterns import PathPattern, parse_path

#: Rows of bindings that a graph on the driver takes; with more, it moves into tables, where the same rules hold.
LOCAL_ROWS = 10_000


class _Element:
    """An element as it was when the query ran."""

    _fields: tuple[str, ...] = ()

    def __init__(self, **values: Any):
        for name in self._fields:
            setattr(self, "_" + name, values.get(name))

    def uid(self) -> Any:
        return self._uid

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and other._uid == self._uid

    def __hash__(self) -> int:
        return hash((type(self).__name__, self._uid))

    def __repr__(self) -> str:
        return str(self)


class Type(_Element):
    _fields = ("uid", "repr")

    def __str__(self) -> str:
        return self._repr


class Term(_Element):
    _fields = ("uid", "repr")

    def __str__(self) -> str:
        return self._repr


class Node(_Element):
    _fields = ("uid", "type", "term", "props")

    def type(self) -> Type:
        return Type(uid=self._uid, repr=self._type)

    def term(self) -> Term | None:
        return Term(uid=self._uid, repr=self._term) if self._term is not None else None

    def properties(self) -> dict[str, Any]:
        return dict(self._props)

    def __str__(self) -> str:
        return f"Node({self._type}:{self._term or ''} {show_props(self._props)})"


class Edge(_Element):
    _fields = ("uid", "type_uid", "type", "term", "props")

    def type(self) -> Type:
        return Type(uid=self._type_uid, repr=self._type)

    def term(self) -> Term:
        return Term(uid=self._type_uid, repr=self._term)

    def properties(self) -> dict[str, Any]:
        return dict(self._props)

    def __str__(self) -> str:
        return f"Edge({self._type}:{self._term} {show_props(self._props)})"


Element = Type | Term | Node | Edge


def _plain_uid(value: Any) -> Any:
    """A uid from a row in hex; the two of an edge as a tuple."""
    return tuple(map(_plain_uid, value)) if isinstance(value, tuple) else bytes(value).hex()


def _shown(kind: str, v: Column) -> Column:
    """A variable's column as users see it."""
    return F.struct(*(shown_uid(v[end]).alias(end) for end in ("start", "end"))) if kind == "edge" else shown_uid(v)


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Graph:
    """A typed property graph.

    It begins on the driver, and moves into tables when it is loaded from them or when a query
    gives it more than LOCAL_ROWS rows. strict_edge_props makes an edge that lacks a property fail
    a filter on it, as a node does.
    """

    def __init__(self, constants: list[Constant] | None = None, spark: SparkSession | None = None, strict_edge_props: bool = False):
        self.spark = _session(spark)
        self.constants = {c.name: c for c in constants or []}
        self.strict_edge_props = strict_edge_props
        self.store: LocalStore | TableStore = LocalStore(self.spark, self.constants)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Frames, constants: list[Constant] | None = None, **options: Any) -> Graph:
        graph = cls(constants, spark, **options)
        graph.store = TableStore(spark, graph.constants, frames)
        return graph

    def frames(self) -> Frames:
        return self.store.frames()

    def to_tables(self) -> None:
        """Moves a graph from the driver into tables."""
        if isinstance(self.store, LocalStore):
            self.store = TableStore(self.spark, self.constants, self.store.frames())

    def query(self) -> Query:
        return Query(self)

    def nodes(self) -> list[Node]:
        rows = Rows(self.frames().nodes.select(F.col("uid").alias(column("n"))), {"n": "node"})
        return [row["n"] for row in self.elements(rows, ("n",))]

    def edges(self) -> list[Edge]:
        rows = Rows(self.frames().edges.select(F.struct(F.col("start_uid").alias("start"), F.col("end_uid").alias("end")).alias("v_e")), {"e": "edge"})
        return [row["e"] for row in self.elements(rows, ("e",))]

    def set_node_properties(self, values: dict[str, dict[str, Any]], overwrite: bool = True) -> None:
        """Sets the properties of nodes by uid."""
        made = {self._hex(uid): props_of(own) for uid, own in values.items()}
        if isinstance(self.store, LocalStore):
            for uid in made:
                if uid not in self.store.nodes:
                    raise MissingError(f"there is no node {uid}")
            for uid, own in made.items():
                self.store.set_props("node", uid, own, overwrite)
        elif made:
            changes = local_frame(self.spark, [(uid, list(own.items())) for uid, own in made.items()], f"uid binary, props {PROPS}")
            self.store.set_props("node", changes.withColumnRenamed("props", "new"), overwrite)

    def set_edge_properties(self, values: dict[tuple[str, str], dict[str, Any]], overwrite: bool = True) -> None:
        """Sets the properties of edges by the uids of their ends."""
        made = {(self._hex(a), self._hex(b)): props_of(own) for (a, b), own in values.items()}
        if isinstance(self.store, LocalStore):
            for edge in made:
                if edge not in self.store.edges:
                    raise MissingError(f"there is no edge {edge}")
            for edge, own in made.items():
                self.store.set_props("edge", edge, own, overwrite)
        elif made:
            changes = local_frame(self.spark, [(*edge, list(own.items())) for edge, own in made.items()], f"start_uid binary, end_uid binary, props {PROPS}")
            self.store.set_props("edge", changes.withColumnRenamed("props", "new"), overwrite)

    @staticmethod
    def _hex(uid: str) -> str:
        try:
            if len(bytes.fromhex(uid)) == 32:
                return uid.lower()
        except (TypeError, ValueError):
            pass
        raise PatternError(f"not a uid: {uid!r}")

    # results

    def table(self, rows: Rows, names: tuple[str, ...]) -> DataFrame:
        """rows with struct columns for what elements show."""
        frames, df = self.frames(), rows.df
        for name in dict.fromkeys(names):
            kind, v, known = rows.kinds[name], F.col(column(name)), rows.families.get(column(name))
            types = frames.some("types", known).select("uid", "repr")
            terms = frames.some("terms", known).select(F.col("type_uid").alias("uid"), "repr")
            if kind in ("type", "term"):
                own = (types if kind == "type" else terms).select(F.col("uid").alias("_u"), F.struct(shown_uid(F.col("uid")).alias("uid"), "repr").alias(column(name, "r_")))
                df = df.join(own, v == F.col("_u"), "left").drop("_u")
            elif kind == "node":
                own = frames.some("nodes", known).join(terms, "uid", "left").withColumnRenamed("repr", "term")
                own = own.select(F.col("uid").alias("_u"), F.struct(shown_uid(F.col("uid")).alias("uid"), "type", "term", "props").alias(column(name, "r_")))
                df = df.join(own, v == F.col("_u"), "left").drop("_u")
            else:
                if column(name, SHOWN) not in df.columns:
                    own = frames.some("edges", known).select(F.col("start_uid").alias("_s"), F.col("end_uid").alias("_e"), edge_shown().alias(column(name, SHOWN)))
                    df = df.join(own, (v["start"] == F.col("_s")) & (v["end"] == F.col("_e")), "left").drop("_s", "_e")
                shown = F.col(column(name, SHOWN))
                df = df.withColumn(column(name, "r_"), F.struct(*(shown_uid(c).alias(n) for c, n in ((v["start"], "start_uid"), (v["end"], "end_uid"), (shown["type_uid"], "type_uid"))), *(shown[f].alias(f) for f in ("type", "term", "props"))))
        return df.select(*(F.col(column(name, "r_")).alias(name) for name in names)) if names else df.select(F.lit(0).alias("_"))

    def with_props(self, df: DataFrame, rows: Rows, name: str) -> DataFrame:
        """Rows with the properties of a variable in _props."""
        v, frames, known = F.col(column(name)), self.frames(), rows.families.get(column(name))
        if rows.kinds[name] == "node":
            return df.join(frames.some("nodes", known).select(F.col("uid").alias("_u"), F.col("props").alias("_props")), v == F.col("_u"), "left").drop("_u")
        if column(name, SHOWN) in df.columns:
            return df.withColumn("_props", F.col(column(name, SHOWN))["props"])
        own = frames.some("edges", known).select(F.col("start_uid").alias("_s"), F.col("end_uid").alias("_e"), F.col("props").alias("_props"))
        return df.join(own, (v["start"] == F.col("_s")) & (v["end"] == F.col("_e")), "left").drop("_s", "_e")

    @staticmethod
    def shown(df: DataFrame, name: str) -> Column:
        """The string of an element from its struct in table()."""
        x, fields = F.col(name), df.schema[name].dataType.fieldNames()
        if "props" not in fields:
            return x["repr"]
        begin = "Edge(" if "start_uid" in fields else "Node("
        return F.concat(F.lit(begin), x["type"], F.lit(":"), F.coalesce(x["term"], F.lit("")), F.lit(" "), shown_props(x["props"]), F.lit(")"))

    def elements(self, rows: Rows, names: tuple[str, ...]) -> Iterator[dict[str, Element]]:
        if isinstance(self.store, LocalStore):
            columns = [F.col(column(n)) for n in names] or [F.lit(0)]
            for row in rows.df.select(*columns).collect():
                yield {n: self._local(rows.kinds[n], _plain_uid(value)) for n, value in zip(names, row, strict=False)}
            return
        kinds = {"type": Type, "term": Term, "node": Node}
        for row in self.table(rows, names).collect():
            out: dict[str, Element] = {}
            for n in names:
                values = row[n].asDict()
                if "props" in values:
                    values["props"] = plain_props(values["props"])
                if rows.kinds[n] == "edge":
                    out[n] = Edge(uid=(values.pop("start_uid"), values.pop("end_uid")), **values)
                else:
                    out[n] = kinds[rows.kinds[n]](**values)
            yield out

    def _local(self, kind: str, value: Any) -> Element:
        store = self.store
        if kind == "type":
            return Type(uid=value, repr=show_type(store.types[value]))
        if kind == "term":
            return Term(uid=value, repr=show_term(store.terms[value]))
        if kind == "node":
            term = store.terms.get(value)
            return Node(uid=value, type=show_type(store.types[value]), term=show_term(term) if term else None, props=plain_props(store.nodes[value]))
        edge = value
        own = store.edge_type(edge)
        return Edge(uid=edge, type_uid=own, type=show_type(store.types[own]), term=show_term(store.terms[own]), props=plain_props(store.edges[edge]))


class Query:
    """Clauses in order; every method adds one and returns the query."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.clauses: list[tuple] = []

    def create(self, pattern: str) -> Query:
        self.clauses.append(("create", parse_path(pattern)))
        return self

    def match(self, pattern: str) -> Query:
        self.clauses.append(("match", parse_path(pattern)))
        return self

    def set(self, variable: str, properties: dict[str, Any], overwrite: bool = True) -> Query:
        self.clauses.append(("set", variable, dict(properties), props_of(properties), overwrite))
        return self

    def remove(self, *variables: str) -> Query:
        self.clauses.append(("remove", variables))
        return self

    def where(self, condition: Any) -> Query:
        """Keeps the rows that a condition holds for; null counts as false.

        A condition is a column over those of to_df(), or text as in functions.conditions.
        """
        self.clauses.append(("where", condition))
        return self

    def __str__(self) -> str:
        lines = []
        for clause, first, *rest in self.clauses:
            if clause == "set":
                lines.append(f"SET {first} {'=' if rest[2] else '+='} {show_props(rest[0])}")
            else:
                lines.append(f"{clause.upper()} {', '.join(first) if clause == 'remove' else first.text if isinstance(first, PathPattern) else first}")
        return "\n".join(lines)

    # running

    def execute(self) -> None:
        self.rows()

    def return_(self, *variables: str) -> list[dict[str, Element]]:
        rows = self.checked(self.rows(), variables)
        return list(self.graph.elements(rows, variables)) if rows else []

    def to_df(self, *variables: str) -> DataFrame:
        """The bindings, lazily: uids, or structs of uids for edges; all variables if none is named."""
        rows = self.rows()
        names = variables or tuple(rows.kinds)
        if (rows := self.checked(rows, names)) is None:
            raise MissingError("there is no such variable")
        return rows.df.select(*(_shown(rows.kinds[n], F.col(column(n))).alias(n) for n in names))

    def to_table(self, *variables: str) -> DataFrame:
        """The elements, lazily: a struct column for each variable."""
        rows = self.checked(self.rows(), variables)
        if rows is None:
            raise MissingError("there is no such variable")
        return self.graph.table(rows, variables)

    def to_strings(self, *variables: str) -> DataFrame:
        """The elements as str() shows them, lazily: a string column for each variable."""
        df = self.to_table(*variables)
        return df.select(*(self.graph.shown(df, name).alias(name) for name in variables))

    @staticmethod
    def checked(rows: Rows, names: tuple[str, ...]) -> Rows | None:
        """rows, or None if a variable is missing and there are no rows."""
        if rows.df is None:
            rows = Rows(_session(None).range(1).select(F.lit(0).alias("_seed")), {})
        for name in names:
            if name not in rows.kinds:
                rows.fail(MissingError(f"there is no variable {name}"))
                return None
        return rows

    def rows(self) -> Rows:
        """Runs the clauses; what they bind."""
        rows = Rows()
        for clause, *args in self.clauses:
            rows = getattr(self, "_" + clause)(rows, *args)
        return rows

    def _match(self, rows: Rows, path: PathPattern) -> Rows:
        return Matcher(self.graph.frames(), self.graph.constants, self.graph.strict_edge_props).match(path, rows)

    def _where(self, rows: Rows, condition: Any) -> Rows:
        rows = self.checked(rows, ())
        df, asked = rows.df, {}
        if isinstance(condition, str):

            def column_of(name: str, key: str, as_kind: str) -> str | None:
                kind = rows.kinds.get(name)
                if kind not in ("node", "edge") or kind == "edge" and key in ("start", "end"):
                    return None
                return asked.setdefault((name, key, as_kind), f"p:{len(asked)}")

            condition = F.expr(to_sql(tokens(condition), column_of))
            for name in dict.fromkeys(name for name, _, _ in asked):
                own = {made: lenient(F.col("_props")[key], as_kind) for (n, key, as_kind), made in asked.items() if n == name}
                df = self.graph.with_props(df, rows, name).withColumns(own).drop("_props")
        named = df.withColumns({n: _shown(kind, F.col(column(n))) for n, kind in rows.kinds.items()})
        return Rows(named.where(F.coalesce(condition, F.lit(False))).drop(*rows.kinds, *asked.values()), rows.kinds, rows.families)

    def _create(self, rows: Rows, path: PathPattern) -> Rows:
        path.check()
        graph = self.graph
        if isinstance(graph.store, LocalStore):
            local = self._local_rows(rows)
            if local is not None:
                return self._create_local(rows, path, local)
            graph.to_tables()
        return graph.store.create(path, rows)

    def _local_rows(self, rows: Rows) -> list[dict[str, Any]] | None:
        """The rows, if they are few enough for the driver."""
        if rows.df is None:
            return [{}]
        names = list(rows.kinds)
        got = rows.df.select(*(F.col(column(n)) for n in names), F.lit(0)).limit(LOCAL_ROWS + 1).collect()
        return None if len(got) > LOCAL_ROWS else [dict(zip(names, map(_plain_uid, row[: len(names)]), strict=True)) for row in got]

    def _create_local(self, rows: Rows, path: PathPattern, local: list[dict[str, Any]]) -> Rows:
        store = self.graph.store
        node_props, edge_props = ([props_of(p.props or {}) for p in ps] for ps in (path.nodes, path.edges))
        created = []
        for row in local:
            bindings = {}
            for name, value in row.items():
                kind = rows.kinds[name]
                if kind == "type":
                    bindings[name] = ("type", store.types[value])
                elif kind == "term":
                    bindings[name] = ("term", store.terms[value])
                elif kind == "node":
                    bindings[name] = ("node", (store.types[value], store.terms.get(value)))
                else:
                    bindings[name] = ("edge", store.terms[store.edge_type(value)])
            created.append(infer(path, bindings, store.constants))
        store.add([n for got in created for n in got.nodes], [e for got in created for e in got.edges], node_props, edge_props)
        out = [got.bindings for got in created]
        kinds = {name: kind for own in out for name, (kind, _) in own.items()}
        return self._from_bindings(out, kinds or rows.kinds)

    def _from_bindings(self, found: list[dict], kinds: dict[str, str]) -> Rows:
        parts, columns = [], []
        for name, kind in kinds.items():
            parts += [column(name, p) + " binary" for p in (("s_", "e_") if kind == "edge" else ("v_",))]
        for bindings in found:
            row: list[str] = []
            for name, kind in kinds.items():
                value = bound(bindings, name, kind)
                row += [type_uid(value)] if kind == "type" else [type_uid(value[0])] if kind == "node" else [type_uid(value[-1])] if kind == "term" else [type_uid(t) for t in value[-1]]
            columns.append((*row, "0"))
        df = local_frame(self.graph.spark, columns, ", ".join([*parts, "_seed string"]))
        for name, kind in kinds.items():
            if kind == "edge":
                start, end = column(name, "s_"), column(name, "e_")
                df = df.withColumn(column(name), F.struct(F.col(start).alias("start"), F.col(end).alias("end"))).drop(start, end)
        return Rows(df, dict(kinds))

    def _keys(self, rows: Rows, name: str, clause: str) -> DataFrame | None:
        """The distinct elements of a variable that can be changed; None without any."""
        if name not in rows.kinds:
            self.checked(rows, ()).fail(MissingError(f"there is no variable {name}"))
            return None
        kind, v = rows.kinds[name], F.col(column(name))
        if kind not in ("node", "edge"):
            rows.fail(PatternError(f"{clause} takes nodes and edges; {name} is a {kind}"))
            return None
        key = [v.alias("uid")] if kind == "node" else [v["start"].alias("start_uid"), v["end"].alias("end_uid")]
        return rows.df.select(*key).distinct()

    def _set(self, rows: Rows, name: str, plain: dict, props: dict, overwrite: bool) -> Rows:
        keys = self._keys(rows, name, "SET")
        if keys is not None:
            store, kind = self.graph.store, rows.kinds[name]
            if isinstance(store, LocalStore):
                for key in keys.collect():
                    store.set_props(kind, _plain_uid(key["uid"]) if kind == "node" else _plain_uid(key), props, overwrite)
            else:
                store.set_props(kind, keys.withColumn("new", literal_props(plain)), overwrite, rows.families.get(column(name)))
        return rows.bare()

    def _remove(self, rows: Rows, names: tuple[str, ...]) -> Rows:
        for name in names:
            keys = self._keys(rows, name, "REMOVE")
            if keys is None:
                continue
            store, kind = self.graph.store, rows.kinds[name]
            if isinstance(store, LocalStore):
                for key in keys.collect():
                    store.remove_node(_plain_uid(key["uid"])) if kind == "node" else store.remove_edge(_plain_uid(key))
            else:
                store.remove(kind, keys, rows.families.get(column(name)))
            rows = Rows(rows.df.drop(column(name)), {n: k for n, k in rows.kinds.items() if n != name}, {c: f for c, f in rows.families.items() if c != column(name)}).bare()
        return rows
