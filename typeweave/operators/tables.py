"""A graph in DataFrames: creation, removal and properties as transformations of its four tables.

A change writes what is new, or the keys of what goes, to the shared folder; the table is then the
old one with that added or taken away. A table with MAX_CHANGES of these is written anew. The store
points to new tables only once all of them are written and terms have spread, so a change that fails
leaves the graph as it was.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeweave.functions.errors import MissingError
from typeweave.functions.types import family_column, sides
from typeweave.functions.values import CELL, PROPS, props_of
from typeweave.operators.creation import KIND_OF, Lookups, compiled, is_arrow
from typeweave.operators.frames import ANY, EDGE_COLUMNS, NODES, OF_EDGE, TERM_COLUMNS, TERMS, TYPE_COLUMNS, Frames, union
from typeweave.plans.inference import CONSTANT, Constant, Ref, TermRef
from typeweave.plans.match import REPR, Rows, column
from typeweave.plans.patterns import PathPattern

MAX_CHANGES = 8
#: New rows of more families, and those of a table of more parts, become one part without a family.
MAX_FAMILIES, MAX_PARTS = 32, 128
#: The columns of saved rows that hold their families.
FAMILY, LINK = ["family"], ["start_family", "end_family"]


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a master of one process may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="typeweave-graph-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def own_folder(spark: SparkSession) -> str:
    """The folder of this application's tables; they may go once its graphs are no longer needed."""
    return f"{checkpoint_dir(spark)}/typeweave/{spark.sparkContext.applicationId}/graph"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    spark, path = df.sparkSession, f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def families_of(new: DataFrame, names: list[str] = FAMILY) -> set | None:
    """The families of saved rows, or the links of families of edges; None if there are many."""
    found = [tuple(row) for row in new.select(*names).distinct().limit(MAX_FAMILIES + 1).collect()]
    return None if len(found) > MAX_FAMILIES else {row if len(row) > 1 else row[0] for row in found}


def linked(edges: DataFrame) -> DataFrame:
    """Edges with the families of their ends."""
    return edges.withColumns({f"{end}_family": family_column(F.col(end + "_type")) for end in ("start", "end")})


def present(frames: Frames, name: str, new: DataFrame, families: set | None, key: list[str]) -> DataFrame | None:
    """The keys of new rows of some families that a table has; None if there are none.

    Only the parts of these families are read. Where the new rows are few beside those, the latter
    are not dealt anew, for Spark then finds the others small enough to send everywhere.
    """
    if not frames.keys(name, families):
        return None
    there = saved(frames.some(name, families).select(*key).join(new.select(*key).distinct(), key, "left_semi").distinct(), "present")
    return None if there.isEmpty() else there


def without(parts: dict, gone: DataFrame, families: set | None, key: list[str]) -> dict:
    """The parts of a table without the keys that go, which are of some families."""
    touched = [k for k in parts if k is ANY or families is None or k in families]
    return parts | {k: parts[k].join(gone, key, "left_anti").select(*parts[k].columns) for k in touched}


def grown(parts: dict, new: DataFrame, families: set | None, names: list[str] = FAMILY) -> dict:
    """The parts of a table with saved rows of some families."""
    columns = next(iter(parts.values())).columns
    if families is None or len(parts) + len(families) > MAX_PARTS:
        own = {ANY: new}
    elif len(families) == 1:
        own = dict.fromkeys(families, new)
    else:
        own = {k: new.where(" AND ".join(f"{n} = '{value}'" for n, value in zip(names, k if len(names) > 1 else (k,), strict=True))) for k in families}
    own = {k: df.select(*columns) for k, df in own.items()}
    return parts | {k: parts[k].unionByName(df) if k in parts else df for k, df in own.items()}


def literal_props(props: dict | None):
    """A map of cells as a literal."""
    cells = props_of(props or {})
    if not cells:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{CELL}>")).cast(PROPS)
    pairs = []
    for name, c in cells.items():
        kinds = {"t": "string", "i": "bigint", "d": "double", "b": "boolean", "s": "string", "j": "string"}
        pairs += [F.lit(name), F.struct(*(F.lit(c[k]).cast(kind).alias(k) for k, kind in kinds.items()))]
    return F.create_map(*pairs).cast(PROPS)


class TableStore:
    """A graph of any size."""

    def __init__(self, spark: SparkSession, constants: dict[str, Constant], frames: Frames):
        self.spark, self.constants, self._now = spark, constants, frames
        self._changes: dict[tuple, int] = {}

    def frames(self) -> Frames:
        return self._now

    @contextmanager
    def change(self) -> Iterator[None]:
        """What fails within it has changed nothing."""
        before = self._now, dict(self._changes)
        try:
            yield
        except BaseException:
            self._now, self._changes = before
            raise

    def take(self, **tables: dict) -> None:
        """Takes tables whose parts are plans over the old ones and what was saved."""
        for name, parts in tables.items():
            for key, df in parts.items():
                if df is self._now.parts[name].get(key):
                    continue
                self._changes[name, key] = self._changes.get((name, key), 0) + 1
                if self._changes[name, key] > MAX_CHANGES:
                    parts[key], self._changes[name, key] = saved(df, name), 0
        self._now = self._now.taken(**tables)

    def with_new(self, name: str, new: DataFrame, key: list[str]) -> None:
        """Adds those of new rows, which have a family, whose key isn't there."""
        parts = self._now.parts[name]
        new = saved(new, name)
        there = present(self._now, name, new, families_of(new), key)
        if there is not None:
            new = saved(new.join(there, key, "left_anti"), name)
        if found := families_of(new):
            self.take(**{name: grown(parts, new, found)})
        elif found is None:
            self.take(**{name: grown(parts, new, None)})

    def with_edges(self, new: DataFrame) -> None:
        """Adds saved edges, which have their link, in place of those of the same ends."""
        key, parts, links = ["start_uid", "end_uid"], self._now.parts["edges"], families_of(new, LINK)
        there = present(self._now, "edges", new, links, key)
        if there is not None:
            parts = without(parts, there, links, key)
        self.take(edges=grown(parts, new, links, LINK))

    # CREATE

    def create(self, path: PathPattern, rows: Rows) -> Rows:
        """Adds what a path gives for each row; the rows with the new bindings."""
        work, new, errors, there = compiled(path, rows.kinds, self.constants)
        df = rows.df if rows.df is not None else self.spark.range(1).select(F.lit(0).alias("_seed"))
        if not any(there.values()) and len(errors) == 1:  # no row can do anything but fail
            rows.fail(errors[0])
        with self.change():
            try:
                found = saved(work(df, self._now, rows.families), "create")
            except Exception as failed:
                for error in errors:
                    if str(error) in str(failed):
                        raise error from None
                raise
            self.add(found, path, there)
        names = [column(name) for name in [*rows.kinds, *new]]
        return Rows(found.select(*names, *([] if names else [F.lit(0).alias("_seed")])), rows.kinds | new, rows.families)

    @staticmethod
    def with_props(df: DataFrame, patterns: list) -> DataFrame:
        props = literal_props({})
        for k, p in enumerate(patterns):
            if p.props:
                props = F.when(F.col("k") == k, literal_props(p.props)).otherwise(props)
        return df.withColumn("props", props)

    def add(self, found: DataFrame, path: PathPattern, there: dict[str, bool]) -> None:
        """Merges candidates: nodes keep what they have, edges take what is new; then terms spread.

        Of several terms of one type, that of an edge is taken, of the last in the pattern; else one that is
        there; else that of a node, of the first in the pattern; else a part of these. Ties go to
        the smaller term as written.
        """
        each = lambda name: found.select(F.explode(name).alias("x")).select("x.*")
        now = self._now
        if there["types"]:
            self.with_new("types", each("types").dropDuplicates(["uid"]).withColumn("family", family_column(F.col("repr"))), ["uid"])
        fresh = None
        if there["terms"]:
            best = each("terms").groupBy("type_uid").agg(F.min(F.struct("rank", "place", "full", *(c for c in TERM_COLUMNS if c not in ("full", "type_uid")), *FAMILY)).alias("best"))
            best = saved(best.select("type_uid", "best.*"), "terms")
            families, parts, key = families_of(best), now.parts["terms"], ["type_uid"]
            known = present(now, "terms", best, families, key)
            new = fresh = best
            if known is not None:
                new = saved(best.join(known.withColumn("old", F.lit(True)), "type_uid", "left").where((F.col("rank") == OF_EDGE) | F.col("old").isNull()), "terms")
                if there["edges"]:
                    gone = best.where(F.col("rank") == OF_EDGE).join(known, "type_uid", "left_semi").select("type_uid")
                    parts = without(parts, gone, families, key)
                fresh = new.where("old IS NULL")
            self.take(terms=grown(parts, new, families))
        if there["nodes"]:
            nodes = self.with_props(each("nodes"), path.nodes)
            self.with_new("nodes", nodes.groupBy("uid").agg(F.min("type").alias("type"), F.min("arrow").alias("arrow"), F.min_by("props", "k").alias("props")).withColumn("family", family_column(F.col("type"))), ["uid"])
        if fresh is not None:
            fresh = saved(fresh.select(*TERM_COLUMNS, *FAMILY).join(each("nodes").select(F.col("uid").alias("type_uid")).distinct(), "type_uid", "left_semi"), "fresh") if there["nodes"] else None
        added = None
        if there["edges"]:
            first = F.struct((-F.col("k")).alias("place"), "full")
            edges = self.with_props(each("edges"), path.edges).groupBy("s", "e").agg(F.min(F.struct((-F.col("k")).alias("place"), "full", "type_uid", "t_kind", "t_name", "start_type", "end_type", "term")).alias("best"), F.min_by("props", first).alias("props"))
            edges = edges.select(F.col("s").alias("start_uid"), F.col("e").alias("end_uid"), "best.*", "props")
            added = saved(linked(edges.select(*EDGE_COLUMNS)), "edges")
            self.with_edges(added)
        self.spread(fresh if fresh is not None and not fresh.isEmpty() else None, added)

    # propagation

    def arrows_of(self, fresh: DataFrame) -> DataFrame | None:
        """Those of saved terms that are of arrow types, as the edges that they are; None if none is."""
        arrows = fresh.where("arrow = 'y'")
        if arrows.isEmpty():
            return None
        now, families = self._now, families_of(arrows)
        ends = now.some("types", families).where("kind = 'arr'").select(F.col("uid").alias("type_uid"), F.col("left_uid").alias("start_uid"), F.col("right_uid").alias("end_uid"))
        own = arrows.join(ends, "type_uid").withColumnsRenamed({"kind": "t_kind", "name": "t_name", "repr": "term"}).withColumn("props", literal_props({}))
        for end, known in zip(("start", "end"), sides(families), strict=True):
            own = own.join(now.some("types", known).select(F.col("uid").alias(end + "_uid"), F.col("repr").alias(end + "_type")), end + "_uid")
        return saved(linked(own.select(*EDGE_COLUMNS).dropDuplicates(["start_uid", "end_uid"])), "arrows")

    def with_ends(self, own: DataFrame) -> DataFrame | None:
        """Makes nodes of those ends of edges that are none; the terms that constants give these, saved; None without any."""
        both = own.select(F.explode(F.array(*(F.struct(F.col(e + "_uid").alias("uid"), F.col(e + "_type").alias("type"), F.col(e + "_family").alias("family")) for e in ("start", "end")))).alias("x")).select("x.*").distinct()
        both = saved(both, "both")
        there = present(self._now, "nodes", both, families_of(both), ["uid"])
        ends = both if there is None else saved(both.join(there, "uid", "left_anti"), "ends")
        if ends.isEmpty():
            return None
        families = families_of(ends)
        nodes = ends.withColumns({"arrow": is_arrow(F.col("type")), "props": literal_props({})})
        self.take(nodes=grown(self._now.parts["nodes"], nodes, families))
        made = saved(self.constant_terms(ends, families), "made")
        has = present(self._now, "terms", made, families_of(made), ["type_uid"])
        made = made if has is None else saved(made.join(has, "type_uid", "left_anti"), "made")
        return None if made.isEmpty() else made

    def spread(self, fresh: DataFrame | None, added: DataFrame | None) -> None:
        """Carries terms on, in rounds, until nothing changes.

        fresh(*terms, family) are nodes that just got a term, added new edges with their link; both are saved. A fresh
        term of an arrow type is an edge of its own, whose missing ends are made; then a node that has
        a term gives one to each node that its edges lead to and that has none, the smallest (start,
        function, argument) of several. A round joins what is new with the edges whose ends are
        of its families.
        """
        while fresh is not None or added is not None:
            own, made = None if fresh is None else self.arrows_of(fresh), None
            if own is not None:
                made = self.with_ends(own)
                if made is not None:
                    self.take(terms=grown(self._now.parts["terms"], made, families_of(made)))
                    fresh = fresh.unionByName(made)
                self.with_edges(own)
                added = own if added is None else added.unionByName(own)
            now, steps = self._now, []
            giver = [F.col("type_uid").alias("start_uid"), F.col("full").alias("argument"), F.col("repr").alias("shown")]
            if fresh is not None and (links := now.links(families_of(fresh), None)):
                steps.append(now.some("edges", links).drop("props").join(fresh.select(*giver), "start_uid").select(*EDGE_COLUMNS[:-1], "argument", "shown"))
            if added is not None:
                links = families_of(added, LINK)
                starts = None if links is None else {start for start, _ in links}
                if now.keys("terms", starts):
                    steps.append(added.join(now.some("terms", starts).select(*giver), "start_uid").select(*EDGE_COLUMNS[:-1], "argument", "shown"))
            if not steps:
                fresh, added = made, None
                continue
            best = F.min(F.struct("start_uid", F.col("full").alias("function"), "argument", "type_uid", "term", "shown")).alias("m")
            steps = saved(union(steps).groupBy("end_uid", "end_type").agg(best).select(F.col("end_uid").alias("to_uid"), is_arrow(F.col("end_type")).alias("arrow"), family_column(F.col("end_type")).alias("family"), "m.*"), "steps")
            fresh, added = made, None
            if not steps.isEmpty():
                shown = F.concat(F.lit("("), F.col("term"), F.lit(" "), F.col("shown"), F.lit(")"))
                full = F.concat(F.lit("["), F.col("function"), F.lit(","), F.col("argument"), F.lit("]"))
                got = steps.select(F.col("to_uid").alias("type_uid"), "arrow", F.lit("app").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("type_uid").alias("function_uid"), F.col("start_uid").alias("argument_uid"), shown.alias("repr"), full.alias("full"), *FAMILY)
                has = present(now, "terms", got, families_of(got), ["type_uid"])
                got = got if has is None else saved(got.join(has, "type_uid", "left_anti").select(*TERM_COLUMNS, *FAMILY), "got")
                if not got.isEmpty():
                    self.take(terms=grown(now.parts["terms"], got, families_of(got)))
                    fresh = got if made is None else got.unionByName(made)

    def constant_terms(self, ends: DataFrame, families: set | None) -> DataFrame:
        """Terms of the first constants that the types of ends(uid, type) fit; types that fit none have no row."""
        at, ref = Lookups({"end": "type"}, self.constants), Ref(("end",))
        term = TermRef(CONSTANT, ref)
        rows: dict = {}
        at.term_rows(term, OF_EDGE, 0, rows, {})
        (_, _, full, uid, kind, *rest), fits = rows[term, OF_EDGE, 0], at.constant(ref).isNotNull()
        named = dict(zip([*(c for c in TERM_COLUMNS if c != "full"), *FAMILY], [uid, kind, *rest], strict=True)) | {"full": full}
        held = {} if families is None else {column("end"): families}
        df = at.joined(ends.select(F.col("uid").alias(column("end")), F.col("type").alias(column("end", REPR))), self._now, held)
        return df.where(fits).select(*(c.cast(KIND_OF.get(name, "string")).alias(name) for name, c in named.items()))

    # REMOVE and SET

    def remove(self, kind: str, keys: DataFrame, families: set | None = None) -> None:
        """Removes nodes(uid) with their edges, or edges(start_uid, end_uid), that are of some families, or links of these."""
        now, keys = self._now, saved(keys.distinct(), "removed")
        if kind == "edge":
            self.take(edges=without(now.parts["edges"], keys, families, ["start_uid", "end_uid"]))
            return
        edges = now.parts["edges"]
        for end, links in (("start_uid", now.links(families, None)), ("end_uid", now.links(None, families))):
            edges = without(edges, keys.withColumnRenamed("uid", end), set(links), [end])
        self.take(nodes=without(now.parts["nodes"], keys, families, ["uid"]), edges=edges)

    def set_props(self, kind: str, changes: DataFrame, overwrite: bool, families: set | None = None) -> None:
        """Takes the property maps in changes(*key, new) of some families; of several for one element, one is taken."""
        now, name = self._now, "nodes" if kind == "node" else "edges"
        key = ["uid"] if kind == "node" else ["start_uid", "end_uid"]
        changes = saved(changes.dropDuplicates(key), "changes")
        if not changes.join(now.some(name, families).select(*key), key, "left_anti").isEmpty():
            raise MissingError(f"a {kind} to set properties of is not there")
        old, new = F.col("props"), F.col("new")
        merged = new if overwrite else F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
        parts = now.parts[name]
        out = {k: parts[k].join(changes, key, "left").withColumn("props", F.when(new.isNull(), old).otherwise(merged)).select(*parts[k].columns) for k in now.keys(name, families)}
        self.take(**{name: parts | out})


__all__ = ["NODES", "TERMS", "TYPE_COLUMNS", "TableStore", "checkpoint_dir", "literal_props", "saved"]
