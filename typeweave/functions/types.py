"""Types and terms of the simply typed lambda calculus, and their content addresses.

A type is a name, or a pair (left, right) for an arrow. A term is ("base", name, type) or
("app", function, argument, type).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from typeweave.functions.errors import GraphTypeError, PatternError

Type = Union[str, tuple]
Term = tuple

MAX_NAME_BYTES = 255
RESERVED = ("None", "True", "False")


def check_name(name: str) -> str:
    """name, if it may name a variable, a type or a constant."""
    if not 1 <= len(name.encode()) <= MAX_NAME_BYTES:
        raise PatternError(f"a name must have 1 to {MAX_NAME_BYTES} bytes: {name!r}")
    if name in RESERVED or not all(c.isalnum() or c == "_" for c in name) or not (name[0].isalpha() or name[0] == "_"):
        raise PatternError(f"not a valid name: {name!r}")
    return name


@functools.lru_cache(maxsize=100_000)
def type_uid(t: Type) -> str:
    """SHA-256 of a type in lower-case hex: of "var:" and its name, or of "arr:", left, ":", right."""
    if isinstance(t, str):
        return hashlib.sha256(b"var:" + t.encode()).hexdigest()
    return hashlib.sha256(b"arr:" + bytes.fromhex(type_uid(t[0])) + b":" + bytes.fromhex(type_uid(t[1]))).hexdigest()


def var_uid(name: Column) -> Column:
    """The uid of a named type in columns, where uids are the 32 bytes themselves."""
    return F.unhex(F.sha2(F.concat(F.lit("var:"), name), 256))


def arrow_uid(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit("arr:").cast("binary"), left, F.lit(":").cast("binary"), right), 256))


def uid_lit(t: Type) -> Column:
    return F.lit(bytes.fromhex(type_uid(t)))


def shown_uid(uid: Column) -> Column:
    """A uid as users see it: in lower-case hex."""
    return F.lower(F.hex(uid))


#: A name that ends in a whole number behind a "_" is of the family before that; an arrow between two such names is
#: of the family "a -> b". Other names are of NO_FAMILY, other arrows of NO_ARROW_FAMILY.
_MEMBER = "([A-Za-z0-9_]*)_-?[0-9]+"
NO_FAMILY, ARROW, NO_ARROW_FAMILY = "", " -> ", " -> "


def arrow_family(left: str, right: str) -> str:
    """The family of arrows between types of two families."""
    return left + ARROW + right if left and right and ARROW not in left + right else NO_ARROW_FAMILY


def family(t: Type) -> str:
    """The family of a type, which is known from the type alone."""
    if not isinstance(t, str):
        return arrow_family(family(t[0]), family(t[1]))
    found = re.fullmatch(_MEMBER, t, re.ASCII)
    return found[1] if found else NO_FAMILY


def family_column(shown: Column) -> Column:
    """The family of a type by how it is shown."""
    arrow = rf"^\({_MEMBER} -> {_MEMBER}\)\z"
    left, right = (F.regexp_extract(shown, arrow, k) for k in (1, 2))
    joined = F.when((left == "") | (right == ""), F.lit(NO_ARROW_FAMILY)).otherwise(F.concat(left, F.lit(ARROW), right))
    return F.when(F.startswith(shown, F.lit("(")), joined).otherwise(F.regexp_extract(shown, rf"^{_MEMBER}\z", 1))


def sides(families: set[str] | None) -> tuple[set[str] | None, set[str] | None]:
    """The families of both sides of arrows; None if they may be any."""
    if families is None or NO_ARROW_FAMILY in families:
        return None, None
    parted = [f.split(ARROW) for f in families if ARROW in f]
    return {left for left, _ in parted}, {right for _, right in parted}


def show_type(t: Type) -> str:
    return t if isinstance(t, str) else f"({show_type(t[0])} -> {show_type(t[1])})"


def read_type(shown: str) -> Type:
    """The type that show_type() shows so."""
    stack: list[list] = [[]]
    for token in shown.replace("(", " ( ").replace(")", " ) ").split():
        if token == "(":
            stack.append([])
        elif token == ")":
            left, right = stack.pop()
            stack[-1].append((left, right))
        elif token != "->":
            stack[-1].append(token)
    return stack[0][0]


def subtypes(t: Type) -> list[Type]:
    """t and all types within, inner ones first."""
    return [t] if isinstance(t, str) else [*subtypes(t[0]), *subtypes(t[1]), t]


def base(name: str, t: Type) -> Term:
    return ("base", name, t)


def apply(function: Term, argument: Term) -> Term:
    """The application of one term to another, if their types fit."""
    t = function[-1]
    if isinstance(t, str) or t[0] != argument[-1]:
        raise GraphTypeError(f"{show_term(function)} of type {show_type(t)} can't be applied to a term of type {show_type(argument[-1])}")
    return ("app", function, argument, t[1])


def show_term(t: Term) -> str:
    return t[1] if t[0] == "base" else f"({show_term(t[1])} {show_term(t[2])})"


def subterms(t: Term) -> list[Term]:
    """t and all terms within, inner ones first."""
    return [t] if t[0] == "base" else [*subterms(t[1]), *subterms(t[2]), t]


def _plain(t: Term) -> list:
    return [t[1], show_type(t[2])] if t[0] == "base" else [_plain(t[1]), _plain(t[2])]


def write_term(t: Term) -> str:
    """A term with the types of its base terms, as JSON without blanks between."""
    return json.dumps(_plain(t), ensure_ascii=False, separators=(",", ":"))


def _build(plain: list) -> Term:
    return base(plain[0], read_type(plain[1])) if isinstance(plain[0], str) else apply(_build(plain[0]), _build(plain[1]))


def read_term(written: str) -> Term:
    return _build(json.loads(written))
