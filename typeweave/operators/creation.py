"""CREATE for all rows at once: the outcomes of a pattern's inference as columns.

Each outcome is a branch of a CASE over the answers it stands on; what a row adds is then a few
arrays of structs. What an outcome refers to in the graph is looked up by left joins on the uids of
types and terms, only where some expression needs it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeweave.functions.types import arrow_family, arrow_uid, family_column, show_type, sides, uid_lit
from typeweave.operators.frames import OF_EDGE, OF_NODE, PART, TERM_COLUMNS, TERMS, TYPE_COLUMNS, TYPES, Frames
from typeweave.plans.inference import CONSTANT, Answers, Bindings, Constant, Created, Ref, TermRef, decided, has_refs, infer, outcomes, type_of
from typeweave.plans.match import REPR, column
from typeweave.plans.patterns import PathPattern

NODE = "struct<k:int,uid:binary,type:string,arrow:string,full:string>"
EDGE = "struct<k:int,s:binary,e:binary,type_uid:binary,full:string,t_kind:string,t_name:string,start_type:string,end_type:string,term:string>"
KIND_OF = {part.split()[0]: part.split()[1] for part in f"{TYPES}, {TERMS}".split(", ")}
TYPE = "struct<" + ",".join(f"{c}:{KIND_OF[c]}" for c in TYPE_COLUMNS) + ">"
#: Terms come with the rank and place by which candidates of one type are taken, and with the family of that type.
TERM = "struct<rank:int,place:int,full:string," + ",".join(f"{c}:{KIND_OF[c]}" for c in TERM_COLUMNS if c != "full") + ",family:string>"


def is_arrow(shown: Column) -> Column:
    """Whether a type is an arrow, as tables say it, by how it is shown."""
    return F.when(F.startswith(shown, F.lit("(")), F.lit("y")).otherwise(F.lit("n"))


class Lookups:
    """Columns of what references stand for, over rows with variables of some kinds."""

    def __init__(self, kinds: dict[str, str], constants: dict[str, Constant]):
        self.kinds, self.constants = kinds, constants
        self.wanted: dict[tuple[str, tuple[str, ...]], Column] = {}
        self.parts: set[tuple[str, tuple[str, ...]]] = set()
        self.hashed: dict[tuple, Column] = {}

    def families(self, path: tuple[str, ...], held: dict[str, set], frames: Frames) -> set | None:
        """The families that a reference's type may be of, from those of variables; None if these are not known."""
        edge = self.kinds[path[0]] == "edge"
        found = held.get(column(path[0]))
        if edge and found is not None:
            found = {arrow_family(*link) for link in found} if len(path) == 1 or path[1] not in ("start", "end") else {link[path[1] == "end"] for link in found}
        for step in path[2:] if edge and len(path) > 1 and path[1] in ("start", "end") else path[1:]:
            found = sides(found)[step == "right"] if step in ("left", "right") else frames.applied(found)[step == "argument"]
        return found

    def joined(self, df: DataFrame, frames: Frames, held: dict[str, set]) -> DataFrame:
        """df with what was wanted so far; what rows hold themselves need not be looked up.

        held are the families of variables, without which no rows are looked for.
        """
        carried = set(df.columns)
        for (table, path), uid in self.wanted.items():
            found = frames.some(table, self.families(path, held, frames))
            key = "uid" if table == "types" else "type_uid"
            columns = TYPE_COLUMNS if table == "types" else TERM_COLUMNS
            if table == "types" and len(path) == 1 and column(path[0], REPR) in carried and (table, path) not in self.parts:
                df = df.withColumn(self.name(table, path, "repr"), F.col(column(path[0], REPR)))
                continue
            found = found.select(*(F.col(c).alias(self.name(table, path, c)) for c in columns))
            df = df.join(found, uid == F.col(self.name(table, path, key)), "left")
        for number, uid in enumerate(self.hashed.values()):
            df = df.withColumn(f"_uid{number}", uid)
        return df

    def name(self, table: str, path: tuple[str, ...], field: str) -> str:
        return f"_{table}{list(self.wanted).index((table, path))}_{field}"

    def field(self, table: str, path: tuple[str, ...], field: str) -> Column:
        if (table, path) not in self.wanted:
            self.wanted[table, path] = self.place(path)
        if field != "repr":
            self.parts.add((table, path))
        return F.col(self.name(table, path, field))

    def place(self, path: tuple[str, ...]) -> Column:
        """The uid of a reference's type."""
        if len(path) == 1:
            v = F.col(column(path[0]))
            return arrow_uid(v["start"], v["end"]) if self.kinds[path[0]] == "edge" else v
        if path[-1] in ("start", "end"):
            return F.col(column(path[0]))[path[-1]]
        return self.field("types" if path[-1] in ("left", "right") else "terms", path[:-1], path[-1] + "_uid")

    # types

    def uid(self, t: Any) -> Column:
        if isinstance(t, Ref):
            return self.place(t.path)
        if not has_refs(t):
            return uid_lit(t)
        if t not in self.hashed:
            own = arrow_uid(self.uid(t[0]), self.uid(t[1]))
            self.hashed[t] = own
        return F.col(f"_uid{list(self.hashed).index(t)}")

    def shown(self, t: Any) -> Column:
        if isinstance(t, Ref):
            return self.field("types", t.path, "repr")
        if not has_refs(t):
            return F.lit(show_type(t))
        return F.concat(F.lit("("), self.shown(t[0]), F.lit(" -> "), self.shown(t[1]), F.lit(")"))

    def arrow(self, t: Any) -> Column:
        return is_arrow(self.shown(t)) if isinstance(t, Ref) else F.lit("n" if isinstance(t, str) else "y")

    def type_rows(self, t: Any, into: dict[Any, list[Column]]) -> None:
        """Adds a type and those within, but for what rows hold already."""
        if isinstance(t, Ref) or t in into:
            return
        for part in () if isinstance(t, str) else t:
            self.type_rows(part, into)
        none = F.lit(None).cast("binary")
        rest = [F.lit("var"), F.lit(t), none, none] if isinstance(t, str) else [F.lit("arr"), F.lit(None).cast("string"), self.uid(t[0]), self.uid(t[1])]
        into[t] = [self.uid(t), *rest, self.shown(t)]

    # terms

    def constant(self, t: Any) -> Column:
        """The name of the first constant that a type fits; null if there is none."""
        fits = [F.when(self.fits(t, c.schema, {})[0], F.lit(c.name)) for c in self.constants.values()]
        return F.coalesce(*fits) if fits else F.lit(None).cast("string")

    def fits(self, t: Any, schema: tuple, own: dict[str, Any]) -> tuple[Column, dict[str, Any]]:
        """Whether a type fits a constant's schema, and what the schema's names then stand for."""
        if schema[0] == "any":
            return F.lit(True), own
        if schema[0] == "name":
            return self.uid(t) == self.uid(own.get(schema[1], schema[1])), own
        if schema[0] == "capture":
            good, own = self.fits(t, schema[2], own)
            return good, own | {schema[1]: t}
        if isinstance(t, str):
            return F.lit(False), own | dict.fromkeys(_captures(schema), t)
        good, sides = F.lit(True), t
        if isinstance(t, Ref):
            good, sides = self.field("types", t.path, "kind") == "arr", [Ref((*t.path, side)) for side in ("left", "right")]
        for side, part in zip(sides, schema[1:], strict=True):
            fits, own = self.fits(side, part, own)
            good = good & fits
        return good, own

    def base_name(self, term: Any) -> Column:
        if isinstance(term, TermRef):
            return self.constant(term.type) if term.path == CONSTANT else self.field("terms", term.path, "name")
        return F.lit(term[1])

    def kind(self, term: Any) -> Column:
        if isinstance(term, TermRef) and term.path != CONSTANT:
            return self.field("terms", term.path, "kind")
        return F.lit("base" if isinstance(term, TermRef) else term[0])

    def whole(self, term: Any, field: str) -> Column:
        """A term as written ("full") or shown ("repr")."""
        if isinstance(term, TermRef) and term.path != CONSTANT:
            return self.field("terms", term.path, field)
        if not isinstance(term, TermRef) and term[0] == "app":
            begin, between, end = ("[", ",", "]") if field == "full" else ("(", " ", ")")
            return F.concat(F.lit(begin), self.whole(term[1], field), F.lit(between), self.whole(term[2], field), F.lit(end))
        name = self.base_name(term)
        return name if field == "repr" else F.concat(F.lit('["'), name, F.lit('","'), self.shown(type_of(term)), F.lit('"]'))

    def term_rows(self, term: Any, rank: int, place: int, into: dict[Any, list[Column]], types: dict[Any, list[Column]]) -> None:
        """Adds a term and those within, but for what rows hold already; and their types."""
        held = isinstance(term, TermRef) and term.path != CONSTANT
        if held and rank == PART or (term, rank, place) in into:
            return
        app = not isinstance(term, TermRef) and term[0] == "app"
        for part in term[1:3] if app else ():
            self.term_rows(part, PART, 0, into, types)
        self.type_rows(type_of(term), types)
        none, t = F.lit(None).cast("binary"), type_of(term)
        if held:
            parts = [self.field("terms", term.path, c) for c in ("name", "function_uid", "argument_uid")]
        else:
            parts = [F.lit(None).cast("string"), self.uid(type_of(term[1])), self.uid(type_of(term[2]))] if app else [self.base_name(term), none, none]
        into[term, rank, place] = [F.lit(rank), F.lit(place), self.whole(term, "full"), self.uid(t), self.arrow(t), self.kind(term), *parts, self.whole(term, "repr"), family_column(self.shown(t))]

    # questions

    def answer(self, question: tuple) -> Column:
        what, x, *rest = question
        if what == "term":
            found = self.field("terms", (x,), "type_uid").isNotNull()
        elif what == "arrow":
            found = self.field("types", x.path, "kind") == "arr"
        elif what == "same":
            found = self.uid(x) == self.uid(rest[0])
        elif what == "same term":
            found = self.whole(x, "full") == self.whole(rest[0], "full")
        elif what == "application":
            found = self.field("terms", x.path, "kind") == "app"
        elif what == "base":
            found = (self.kind(x) == "base") & (self.base_name(x) == rest[0])
        else:
            found = self.constant(x).isNotNull()
        return F.coalesce(found, F.lit(False))


def _captures(schema: tuple) -> list[str]:
    if schema[0] == "arrow":
        return _captures(schema[1]) + _captures(schema[2])
    return [*_captures(schema[2]), schema[1]] if schema[0] == "capture" else []


def held_bindings(kinds: dict[str, str], used: set[str], answers: Answers) -> Bindings:
    """What rows of variables of some kinds hold; nodes may have a term."""
    out: Bindings = {}
    for name, kind in kinds.items():
        ref = Ref((name,))
        if kind == "type":
            out[name] = ("type", ref)
        elif kind == "edge":
            out[name] = ("edge", TermRef((name,), (Ref((name, "start")), Ref((name, "end")))))
        elif kind == "term":
            out[name] = ("term", TermRef((name,), ref))
        else:
            out[name] = ("node", (ref, TermRef((name,), ref) if name in used and answers.has_term(name) else None))
    return out


def _array(rows: list[list[Column]], kind: str) -> Column:
    names = [part.split(":")[0] for part in kind[len("struct<") : -1].split(",")]
    return F.array(*(F.struct(*(c.alias(n) for c, n in zip(row, names, strict=True))) for row in rows)).cast(f"array<{kind}>")


def _outputs(got: Created, at: Lookups) -> dict[str, Column]:
    """What one outcome gives."""
    types: dict[Any, list[Column]] = {}
    terms: dict[Any, list[Column]] = {}
    none = F.lit(None).cast("string")
    nodes, edges = [], []
    for k, t, term in got.nodes:
        at.type_rows(t, types)
        nodes.append([F.lit(k), at.uid(t), at.shown(t), at.arrow(t), none if term is None else at.whole(term, "full")])
        if term is not None:
            at.term_rows(term, OF_NODE, k, terms, types)
    for k, term, (left, right) in got.edges:
        at.type_rows((left, right), types)
        edges.append([F.lit(k), at.uid(left), at.uid(right), at.uid((left, right)), at.whole(term, "full"), at.kind(term), at.base_name(term) if isinstance(term, TermRef) or term[0] == "base" else none, at.shown(left), at.shown(right), at.whole(term, "repr")])
        at.term_rows(term, OF_EDGE, -k, terms, types)
    out = {"nodes": _array(nodes, NODE), "edges": _array(edges, EDGE), "types": _array(list(types.values()), TYPE), "terms": _array(list(terms.values()), TERM)}
    ends = {k: sides for k, _, sides in got.edges}
    for name, (kind, value) in got.bindings.items():
        if name in at.kinds:
            continue
        if kind == "edge":
            left, right = next((ends[k] for k, term, _ in got.edges if term == value), (None, None))
            out[column(name)] = F.struct(at.uid(left).alias("start"), at.uid(right).alias("end"))
        else:
            out[column(name)] = at.uid(value if kind == "type" else type_of(value) if kind == "term" else value[0])
    return out


def compiled(path: PathPattern, kinds: dict[str, str], constants: dict[str, Constant]) -> tuple[Callable[[DataFrame, Frames, dict[str, set]], DataFrame], dict[str, str], list[Exception], dict[str, bool]]:
    """(rows to rows with what they add, kinds of the new variables, the errors that rows may have, which outputs may be there)."""
    used = {p.var for p in [*path.nodes, *path.edges] if p.var}
    decision, found = decided(outcomes(lambda answers: infer(path, held_bindings(kinds, used, answers), constants, answers)), kinds)
    at = Lookups(kinds, constants)
    errors = [got for got in found if isinstance(got, Exception)]
    new: dict[str, str] = {}
    there = dict.fromkeys(("nodes", "edges", "types", "terms"), False)
    branches: list[dict[str, Column] | str] = []
    for got in found:
        if isinstance(got, Exception):
            branches.append(str(got))
            continue
        new |= {name: kind for name, (kind, _) in got.bindings.items() if name not in kinds}
        there["nodes"] |= bool(got.nodes)
        there["edges"] |= bool(got.edges)
        branches.append(_outputs(got, at))

    def choice(decision: Any) -> Column:
        if isinstance(decision, tuple):
            question, no, yes = decision
            return F.when(at.answer(question), choice(yes)).otherwise(choice(no))
        out = branches[decision]
        return F.raise_error(F.lit(out)).cast("int") if isinstance(out, str) else F.lit(decision)

    which = choice(decision)
    there["types"] = there["nodes"] or there["edges"]
    there["terms"] = there["edges"] or any(term is not None for got in found if isinstance(got, Created) for _, _, term in got.nodes)
    names = [*there, *(column(name) for name in new)]
    ddl = {"nodes": f"array<{NODE}>", "edges": f"array<{EDGE}>", "types": f"array<{TYPE}>", "terms": f"array<{TERM}>"}
    ddl |= {column(name): "struct<start:binary,end:binary>" if kind == "edge" else "binary" for name, kind in new.items()}

    def run(df: DataFrame, frames: Frames, held: dict[str, set]) -> DataFrame:
        kept, made = [column(name) for name in kinds], []
        for name in names:
            values = [(number, out[name].cast(ddl[name])) for number, out in enumerate(branches) if not isinstance(out, str) and name in out]
            cases = [value if len(values) == 1 else F.when(F.col("_which") == number, value) for number, value in values]
            made.append((F.coalesce(*cases) if cases else F.lit(None).cast(ddl[name])).alias(name))
        return at.joined(df, frames, held).withColumn("_which", which).where("_which IS NOT NULL").select(*kept, *made)

    return run, new, errors, there
