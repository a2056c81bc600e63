"""MATCH: a path pattern compiled to joins and filters over a graph's tables.

Rows of bindings are a DataFrame with a column v_<name> for each variable: the uid of a type, a
term (that of its type) or a node, or a struct of the uids of an edge's ends. Beside it, h:<name> holds what
shows an edge, as long as nothing has changed the graph since, and r:<name> how a type is shown. Schemas without
wildcards, captures and bound names are hashed here, so they become comparisons with a literal;
an edge's type is that of its ends, so its schema is split on them; a node that is reached by an
edge needs no look-up unless its properties are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.functions.errors import MissingError, PatternError
from typeweave.functions.types import arrow_family, family, sides, uid_lit
from typeweave.functions.values import matches
from typeweave.operators.frames import ANY, Frames, union
from typeweave.plans.inference import Constant, find_constant
from typeweave.plans.patterns import EdgePattern, NodePattern, PathPattern

#: The uid of the type that a path has come to, and how that type is shown.
CURSOR, CURSOR_REPR = "_cur", "_cur_repr"
#: What rows hold beside a variable: what shows an edge; how the type of a node, or a type, is shown.
SHOWN, REPR = "h:", "r:"
#: The edges of one node that are joined in one piece, where a path goes against their direction.
PIECE = 500


def column(name: str, prefix: str = "v_") -> str:
    """The column of a variable. Spark's names do not tell case apart, so places of capitals are added."""
    capitals = "".join(f":{k}" for k, c in enumerate(name) if c != c.lower())
    return f"{prefix}{name}{capitals}"


def never(df: DataFrame) -> bool:
    """Whether the plan alone shows that there are no rows."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() == 0


def both(a: set | None, b: set | None) -> set | None:
    """What two sets have in common, where None stands for everything."""
    return b if a is None else a if b is None else a & b


def edge_shown() -> Column:
    """What shows an edge, from the columns of the table of edges."""
    shown = F.concat(F.lit("("), F.col("start_type"), F.lit(" -> "), F.col("end_type"), F.lit(")"))
    return F.struct("type_uid", shown.alias("type"), "term", "props")


@dataclass
class Rows:
    """Rows of bindings; df is None for the one empty row that a query begins with."""

    df: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    #: The families that the types of variables may be of, and those of columns of uids; links of families for edges.
    families: dict[str, set] = field(default_factory=dict)

    def among(self, **found: set | None) -> Rows:
        """The rows, with what is known of columns; None if a column may hold any family."""
        return replace(self, families={k: v for k, v in (self.families | found).items() if v is not None})

    def bare(self) -> Rows:
        """The rows without what shows edges, which a change may have made untrue."""
        hidden = [c for c in self.df.columns if c.startswith(SHOWN)] if self.df is not None else []
        return replace(self, df=self.df.drop(*hidden)) if hidden else self

    def fail(self, error: Exception) -> None:
        """Errors that depend on rows are raised only if there are any."""
        if self.df is None or not self.df.isEmpty():
            raise error


class Matcher:
    def __init__(self, frames: Frames, constants: dict[str, Constant], strict_edge_props: bool = False):
        self.frames, self.constants, self.strict = frames, constants, strict_edge_props
        self.count = 0

    def fresh(self, name: str) -> str:
        self.count += 1
        return f"_{name}{self.count}"

    # schemas

    def ground(self, schema: tuple, kinds: dict[str, str]) -> object:
        """The type that a schema stands for wherever it is; None if that depends on the row."""
        if schema[0] == "arrow":
            left, right = self.ground(schema[1], kinds), self.ground(schema[2], kinds)
            return None if left is None or right is None else (left, right)
        return schema[1] if schema[0] == "name" and schema[1] not in kinds else None

    def type_filter(self, rows: Rows, uid: str, schema: tuple, prefix: str = "v_") -> Rows:
        """Rows whose type in the column uid fits a schema."""
        if schema[0] == "any":
            return rows
        if (t := self.ground(schema, rows.kinds)) is not None:
            return replace(rows, df=rows.df.where(F.col(uid) == uid_lit(t)))
        if schema[0] == "name":
            if rows.kinds[schema[1]] != "type":
                rows.fail(PatternError(f"the variable {schema[1]} is a {rows.kinds[schema[1]]}, not a type"))
            return replace(rows, df=rows.df.where(F.col(uid) == F.col(column(schema[1], prefix))))
        if schema[0] == "arrow":
            key, left, right = self.fresh("t"), self.fresh("l"), self.fresh("r")
            known = rows.families.get(uid)
            types = self.frames.some("types", known).where("kind = 'arr'").select(F.col("uid").alias(key), F.col("left_uid").alias(left), F.col("right_uid").alias(right))
            rows = replace(rows, df=rows.df.join(types, F.col(uid) == F.col(key)).drop(key)).among(**dict(zip((left, right), sides(known), strict=True)))
            rows = self.type_filter(rows, left, schema[1], prefix)
            return self.drop(self.type_filter(rows, right, schema[2], prefix), left, right)
        rows = self.type_filter(rows, uid, schema[2], prefix)
        return self.bind(rows, schema[1], "type", uid, prefix)

    def bind(self, rows: Rows, name: str, kind: str, uid: str, prefix: str = "v_") -> Rows:
        if name in rows.kinds:
            rows.fail(MissingError(f"the variable {name} is there already"))
            return rows
        df, shown = rows.df.withColumn(column(name, prefix), F.col(uid)).drop(column(name, REPR)), CURSOR_REPR
        if uid == CURSOR and prefix == "v_" and shown in df.columns:
            df = df.withColumn(column(name, REPR), F.col(shown))
        return replace(rows, df=df, kinds=rows.kinds | {name: kind}).among(**{column(name, prefix): rows.families.get(uid)})

    @staticmethod
    def drop(rows: Rows, *columns: str) -> Rows:
        return replace(rows, df=rows.df.drop(*columns))

    def with_terms(self, rows: Rows, uid: str, kept: Column | None, columns: list[Column], key: str, how: str) -> Rows:
        """rows joined to the terms of their types, or to those of them that are kept."""
        terms = self.frames.some("terms", rows.families.get(uid))
        terms = (terms if kept is None else terms.where(kept)).select(*columns)
        joined = replace(rows, df=rows.df.join(terms, F.col(uid) == F.col(key), how))
        return joined.among(**{uid: both(rows.families.get(uid), self.frames.families("terms"))})

    def term_filter(self, rows: Rows, uid: str, schema: tuple, known: tuple[str, str] | None = None) -> Rows:
        """Rows whose term of the type in the column uid fits a schema.

        known names columns that hold the term's kind and name, where the rows have them.
        """
        if schema[0] in ("any", "name"):
            if known is None:
                key = self.fresh("k")
                rows = self.with_terms(rows, uid, None, [F.col("type_uid").alias(key)], key, "left_semi")
            if schema[0] == "any":
                return rows
            if schema[1] not in rows.kinds:
                return self.bind(rows, schema[1], "term", uid)
            if rows.kinds[schema[1]] != "term":
                rows.fail(PatternError(f"the variable {schema[1]} is a {rows.kinds[schema[1]]}, not a term"))
            return replace(rows, df=rows.df.where(F.col(uid) == F.col(column(schema[1]))))
        if schema[0] == "app":
            key, function, argument = self.fresh("k"), self.fresh("f"), self.fresh("x")
            parts = [F.col("type_uid").alias(key), F.col("function_uid").alias(function), F.col("argument_uid").alias(argument)]
            rows = self.drop(self.with_terms(rows, uid, F.col("kind") == "app", parts, key, "inner"), key)
            rows = rows.among(**dict(zip((function, argument), self.frames.applied(rows.families.get(uid)), strict=True)))
            rows = self.term_filter(rows, function, schema[1])
            return self.drop(self.term_filter(rows, argument, schema[2]), function, argument)
        if schema[1] not in self.constants:
            rows.fail(MissingError(f"there is no constant {schema[1]}"))
            return replace(rows, df=rows.df.where(F.lit(False)))
        constant = find_constant(self.constants, schema[1])
        if known is None:
            key, kind, name = self.fresh("k"), self.fresh("kind"), self.fresh("name")
            rows = self.with_terms(rows, uid, (F.col("kind") == "base") & (F.col("name") == constant.name), [F.col("type_uid").alias(key)], key, "left_semi")
        else:
            rows = replace(rows, df=rows.df.where((F.col(known[0]) == "base") & (F.col(known[1]) == constant.name)))
        return self.constant_args(rows, uid, constant, schema[2])

    def constant_args(self, rows: Rows, uid: str, constant: Constant, args: tuple) -> Rows:
        """A term that has a constant's name has a type by its schema; its parameters fit the arguments."""
        if not args:
            return rows
        prefix = self.fresh("p") + "_"
        inner = self.type_filter(replace(rows, kinds={}), uid, constant.schema, prefix)
        rows = replace(rows, df=inner.df, families=inner.families)
        for name, arg in zip(constant.parameters, args, strict=False):
            rows = self.type_filter(rows, column(name, prefix), arg)
        return self.drop(rows, *(column(name, prefix) for name in inner.kinds))

    # elements

    def check_kind(self, rows: Rows, name: str, kind: str) -> None:
        if rows.kinds[name] != kind:
            rows.fail(PatternError(f"the variable {name} is a {rows.kinds[name]}, not a {kind}"))

    def fitting(self, p: NodePattern, rows: Rows) -> set | None:
        """The families of those nodes that may fit a pattern; None if these may be any."""
        found = rows.families.get(column(p.var)) if rows.kinds.get(p.var) == "node" else None
        if p.type and (t := self.ground(p.type, rows.kinds)) is not None:
            found = both(found, {family(t)})
        if p.term:
            found = both(found, self.frames.families("terms"))
        if p.props and self.frames.families("nodes") is not None:
            own = matches(F.col("props"), p.props, missing=False)
            found = {key for key in self.frames.keys("nodes", found) if not never(self.frames.parts["nodes"][key].where(own))}
        return found

    def first_node(self, rows: Rows, p: NodePattern) -> Rows:
        """Rows with the cursor on a node of the graph, or on a bound one."""
        if p.var in rows.kinds:
            self.check_kind(rows, p.var, "node")
            df, shown = rows.df.withColumn(CURSOR, F.col(column(p.var))), column(p.var, REPR)
            rows = rows.among(**{CURSOR: rows.families.get(column(p.var))})
            return self.node_filters(replace(rows, df=df.withColumn(CURSOR_REPR, F.col(shown)) if shown in df.columns else df), p)
        fitting = self.fitting(p, rows)
        nodes = self.frames.some("nodes", fitting)
        if p.props:
            nodes = nodes.where(matches(F.col("props"), p.props, missing=False))
        nodes = nodes.select(F.col("uid").alias(CURSOR), F.col("type").alias(CURSOR_REPR))
        if rows.df is None:
            rows = replace(rows, df=nodes)
        elif p.type and p.type[0] == "name" and rows.kinds.get(p.type[1]) == "type":
            rows = replace(rows, df=rows.df.join(nodes, F.col(column(p.type[1])) == F.col(CURSOR)))
        else:
            if p.type and (t := self.ground(p.type, rows.kinds)) is not None:
                nodes = nodes.where(F.col(CURSOR) == uid_lit(t))
            rows = replace(rows, df=rows.df.crossJoin(nodes))
        rows = rows.among(**{CURSOR: both(fitting, self.frames.families("nodes"))})
        rows = self.node_filters(rows, replace(p, props=None))
        return self.bind(rows, p.var, "node", CURSOR) if p.var else rows

    def node_filters(self, rows: Rows, p: NodePattern) -> Rows:
        if p.type:
            rows = self.type_filter(rows, CURSOR, p.type)
        if p.term:
            rows = self.term_filter(rows, CURSOR, p.term)
        if p.props:
            key, fitting = self.fresh("n"), both(rows.families.get(CURSOR), self.fitting(p, rows))
            nodes = self.frames.some("nodes", fitting).where(matches(F.col("props"), p.props, missing=False)).select(F.col("uid").alias(key))
            rows = replace(rows, df=rows.df.join(nodes, F.col(CURSOR) == F.col(key), "left_semi")).among(**{CURSOR: fitting})
        return rows

    def next_node(self, rows: Rows, p: NodePattern) -> Rows:
        if p.var in rows.kinds:
            self.check_kind(rows, p.var, "node")
            rows = replace(rows, df=rows.df.where(F.col(column(p.var)) == F.col(CURSOR)))
            return self.node_filters(rows, p)
        rows = self.node_filters(rows, p)
        return self.bind(rows, p.var, "node", CURSOR) if p.var else rows

    def edge_table(self, p: EdgePattern, rows: Rows, near: set | None, far: set | None) -> tuple[DataFrame, dict[str, str], dict[str, set | None]]:
        """The edges that may fit a pattern, from either end, the names of their columns, and what families these hold.

        near and far are the families that the nodes at both ends may be of.
        """
        kinds, frames = rows.kinds, self.frames
        c = {n: self.fresh(n) for n in ("start", "end", "start_type", "end_type", "uid", "kind", "name", "shown", "near", "far", "near_type", "far_type")}
        named = p.term[1] if p.term and p.term[0] == "const" and p.term[1] in self.constants else None
        limits = dict.fromkeys(("start", "end"))
        if p.type and p.type[0] == "arrow":
            grounds = {end: self.ground(side, kinds) for end, side in zip(limits, p.type[1:], strict=True)}
            limits = {end: None if t is None else {family(t)} for end, t in grounds.items()}

        def fits(part: DataFrame) -> DataFrame:
            part = part.where(matches(F.col("props"), p.props, missing=not self.strict)) if p.props else part
            return part if named is None else part.where((F.col("t_kind") == "base") & (F.col("t_name") == named))

        sides_of = {"forward": [(near, far)], "backward": [(far, near)], "any": [(near, far), (far, near)]}[p.direction]
        links = [frames.links(both(a, limits["start"]), both(b, limits["end"])) for a, b in sides_of]
        parts = {key: fits(frames.parts["edges"][key]) for key in dict.fromkeys(k for own in links for k in own)}
        if p.props or named is not None:
            parts = {key: df for key, df in parts.items() if not never(df)}
        links = [[key for key in own if key in parts] for own in links]

        def seen(own: list) -> DataFrame:
            whole = len(own) == len(frames.parts["edges"]) and not p.props and named is None
            return frames.edges if whole else union([parts[key] for key in own]) if own else frames.edges.where(F.lit(False))

        shown = [self.edge_columns(seen(own), p, kinds, c) for own in links]
        start, end = F.col(c["start"]), F.col(c["end"])
        ends = {side: {c[f"{at}{what}"]: F.col(c[f"{own}{what}"]) for at, own in (("near", side), ("far", other)) for what in ("", "_type")} for side, other in (("start", "end"), ("end", "start"))}
        if p.direction == "any":
            table = shown[0].withColumns(ends["start"]).unionByName(shown[1].withColumns(ends["end"]).where(start != end))
        else:
            table = shown[0].withColumns(ends["start" if p.direction == "forward" else "end"])
        every = [key for own in links for key in own]
        if ANY in every:
            return table, c, {}
        turned = [(own, p.direction == "backward" or k == 1) for k, own in enumerate(links)]
        held = {c["near"]: {key[back] for own, back in turned for key in own}, c["far"]: {key[not back] for own, back in turned for key in own}}
        held |= {c["start"]: {key[0] for key in every}, c["end"]: {key[1] for key in every}, c["uid"]: {arrow_family(*key) for key in every}, c["shown"]: set(every)}
        return table, c, held

    def edge_columns(self, edges: DataFrame, p: EdgePattern, kinds: dict[str, str], c: dict[str, str]) -> DataFrame:
        """Edges with the columns that a path asks for."""
        edges = edges.select(F.col("start_uid").alias(c["start"]), F.col("end_uid").alias(c["end"]), F.col("type_uid").alias(c["uid"]), F.col("t_kind").alias(c["kind"]), F.col("t_name").alias(c["name"]), edge_shown().alias(c["shown"]), F.col("start_type").alias(c["start_type"]), F.col("end_type").alias(c["end_type"]))
        if p.type and p.type[0] == "name" and p.type[1] not in kinds:
            edges = edges.where(F.lit(False))  # an edge's type is an arrow, never a name
        return edges

    def is_bound_edge(self, rows: Rows, p: EdgePattern, c: dict[str, str]) -> Column:
        self.check_kind(rows, p.var, "edge")
        v = F.col(column(p.var))
        return (v["start"] == F.col(c["start"])) & (v["end"] == F.col(c["end"]))

    def first_edge(self, rows: Rows, node: NodePattern, p: EdgePattern, far: NodePattern) -> Rows:
        """Rows with the cursor behind the first edge of a path whose first node is not bound.

        The ends of edges are nodes, so the path begins with the edges and scans no nodes.
        """
        edges, c, held = self.edge_table(p, rows, self.fitting(node, rows), self.fitting(far, rows))
        near = F.col(c["near"])
        if p.var in rows.kinds:
            df = rows.df.join(edges, self.is_bound_edge(rows, p, c))
        elif node.type and node.type[0] == "name" and rows.kinds.get(node.type[1]) == "type":
            df = rows.df.join(edges, F.col(column(node.type[1])) == near)
        else:
            if node.type and (t := self.ground(node.type, rows.kinds)) is not None:
                edges = edges.where(near == uid_lit(t))
            df = edges if rows.df is None else rows.df.crossJoin(edges)
        rows = replace(rows, df=df.withColumns({CURSOR: near, CURSOR_REPR: F.col(c["near_type"])})).among(**held | {CURSOR: held.get(c["near"])})
        rows = self.node_filters(rows, node)
        if node.var:
            rows = self.bind(rows, node.var, "node", CURSOR)
            if node.var == p.var:
                self.check_kind(rows, p.var, "edge")
        return self.edge_filters(rows, p, c)

    def edge(self, rows: Rows, p: EdgePattern, far: NodePattern) -> Rows:
        """Rows with the cursor moved along edges."""
        edges, c, held = self.edge_table(p, rows, rows.families.get(CURSOR), self.fitting(far, rows))
        condition = F.col(CURSOR) == F.col(c["near"])
        if p.var in rows.kinds:
            condition = condition & self.is_bound_edge(rows, p, c)
        df = rows.df
        if p.direction != "forward":
            df, edges, same = self.in_pieces(df, edges, c)
            condition = condition & same
        return self.edge_filters(replace(rows, df=df.join(edges, condition)).among(**held), p, c)

    def in_pieces(self, df: DataFrame, edges: DataFrame, c: dict[str, str]) -> tuple[DataFrame, DataFrame, Column]:
        """Rows and edges with a number of a piece each, and that these are the same.

        Many edges may lead to one node. They are dealt into pieces by their other end, and the rows at that
        node go to each piece, so that no task joins all edges of a node.
        """
        near, far, key, pieces, own, other = c["near"], c["far"], *map(self.fresh, ("node", "pieces", "piece", "piece"))
        many = edges.groupBy(F.col(near).alias(key)).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias(pieces))
        many = F.broadcast(many.where(F.col(pieces) > 1))
        dealt = F.coalesce(F.pmod(F.xxhash64(far), F.col(pieces)), F.lit(0)).cast("int")
        edges = edges.join(many, F.col(near) == F.col(key), "left").withColumn(other, dealt).drop(key, pieces)
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(pieces), F.lit(1)) - 1))
        df = df.join(many, F.col(CURSOR) == F.col(key), "left").withColumn(own, every).drop(key, pieces)
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(tasks, CURSOR, own), edges, F.col(own) == F.col(other)

    def edge_filters(self, rows: Rows, p: EdgePattern, c: dict[str, str]) -> Rows:
        rows = replace(rows, df=rows.df.withColumns({CURSOR: F.col(c["far"]), CURSOR_REPR: F.col(c["far_type"])}).drop(*(c[n] for n in ("near", "far", "near_type", "far_type")))).among(**{CURSOR: rows.families.get(c["far"])})
        if p.type:
            rows = self.edge_type(rows, p.type, c["start"], c["end"], c["uid"])
        if p.term:
            rows = self.term_filter(rows, c["uid"], p.term, (c["kind"], c["name"]))
        if p.var and p.var not in rows.kinds:
            ends = F.struct(F.col(c["start"]).alias("start"), F.col(c["end"]).alias("end"))
            made = rows.df.withColumns({column(p.var): ends, column(p.var, SHOWN): F.col(c["shown"])})
            rows = replace(rows, df=made, kinds=rows.kinds | {p.var: "edge"}).among(**{column(p.var): rows.families.get(c["shown"])})
        pieces = [n for n in rows.df.columns if n.startswith("_piece")]
        return self.drop(rows, *pieces, *(c[n] for n in ("start", "end", "start_type", "end_type", "uid", "kind", "name", "shown")))

    def edge_type(self, rows: Rows, schema: tuple, start: str, end: str, uid: str) -> Rows:
        if schema[0] == "arrow":
            return self.type_filter(self.type_filter(rows, start, schema[1]), end, schema[2])
        if schema[0] == "capture":
            return self.bind(self.edge_type(rows, schema[2], start, end, uid), schema[1], "type", uid)
        return self.type_filter(rows, uid, schema)

    def anchored(self, path: PathPattern, rows: Rows) -> PathPattern:
        """The path from its other end, if only that is selective and nothing depends on the order.

        Captures and term variables bind from left to right, so with these the order stays.
        """
        every = [*path.nodes, *path.edges]
        if any(p.type and _binds(p.type) or p.term and _term_binds(p.term) for p in every):
            return path
        first, last = (self.selective(p, rows) for p in (path.nodes[0], path.nodes[-1]))
        if first or not last:
            return path
        turned = {"forward": "backward", "backward": "forward", "any": "any"}
        return PathPattern(path.text, path.nodes[::-1], [replace(e, direction=turned[e.direction]) for e in path.edges[::-1]])

    def selective(self, p: NodePattern, rows: Rows) -> bool:
        return p.var in rows.kinds or bool(p.props) or bool(p.type) and (self.ground(p.type, rows.kinds) is not None or p.type[0] == "name")

    def match(self, path: PathPattern, rows: Rows) -> Rows:
        """Rows with those bindings that a path gives, for each row."""
        path = self.anchored(path.check(), rows)
        edges, nodes = path.edges, path.nodes
        if edges and nodes[0].var not in rows.kinds:
            rows = self.next_node(self.first_edge(rows, nodes[0], edges[0], nodes[1]), nodes[1])
            edges, nodes = edges[1:], nodes[1:]
        else:
            rows = self.first_node(rows, nodes[0])
        for edge, node in zip(edges, nodes[1:], strict=True):
            rows = self.next_node(self.edge(rows, edge, node), node)
        return self.drop(rows, CURSOR, CURSOR_REPR)


def _binds(schema: tuple) -> bool:
    """Whether a type schema binds a variable."""
    if schema[0] == "arrow":
        return _binds(schema[1]) or _binds(schema[2])
    return schema[0] == "capture"


def _term_binds(schema: tuple) -> bool:
    if schema[0] == "app":
        return _term_binds(schema[1]) or _term_binds(schema[2])
    return schema[0] == "name" or schema[0] == "const" and any(map(_binds, schema[2]))
