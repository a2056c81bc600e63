"""Property values: cells of a property map, and their comparison as expressions.

A cell is a struct with a tag t: i, d, b, s for numbers, truth values and strings; n for null;
l and m for lists and dicts, whose canonical JSON stands in j and whose string in s; o for any other Python object,
which is kept on the driver under the number in i and equals itself only.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from typeweave.functions.errors import PatternError

CELL = "struct<t:string,i:bigint,d:double,b:boolean,s:string,j:string>"
PROPS = f"map<string,{CELL}>"
EPSILON = 2.0**-52

_OPAQUE: dict[int, Any] = {}


def _canonical(value: Any) -> Any:
    """A JSON value that tells apart what compares as different; floats by their shortest form."""
    if value is None:
        return {"n": 0}
    if isinstance(value, bool):
        return {"b": value}
    if isinstance(value, int):
        return {"i": value}
    if type(value) is float:
        return {"d": repr(value)}
    if isinstance(value, str):
        return {"s": value}
    if isinstance(value, list):
        return {"l": [_canonical(v) for v in value]}
    if isinstance(value, dict):
        return {"m": {str(k): _canonical(value[k]) for k in sorted(value, key=str)}}
    _OPAQUE[id(value)] = value
    return {"o": id(value)}


def _restore(plain: dict) -> Any:
    ((tag, value),) = plain.items()
    if tag == "l":
        return [_restore(v) for v in value]
    if tag == "m":
        return {k: _restore(v) for k, v in value.items()}
    return None if tag == "n" else float(value) if tag == "d" else _OPAQUE.get(value) if tag == "o" else value


def cell(value: Any) -> dict:
    """The cell of a Python value."""
    made = dict.fromkeys("tidbsj")
    ((tag, plain),) = _canonical(value).items()
    made["t"] = tag
    if tag in "lm":
        made["j"] = json.dumps({tag: plain}, ensure_ascii=False, sort_keys=True)
        made["s"] = show_value(value)
    elif tag == "d":
        made["d"] = value
    elif tag == "o" or tag == "i":
        if not -(2**63) <= plain < 2**63:
            raise OverflowError("an integer property must fit into 64 bits")
        made["i"] = plain
    elif tag != "n":
        made[tag] = plain
    return made


def value_of(c: dict) -> Any:
    """The Python value of a cell."""
    tag = c["t"]
    if tag in "lm":
        return _restore(json.loads(c["j"]))
    return None if tag == "n" else _OPAQUE.get(c["i"]) if tag == "o" else c[tag]


def props_of(values: dict) -> dict[str, dict]:
    return {check_key(k): cell(v) for k, v in values.items()}


def check_key(key: Any) -> str:
    if not isinstance(key, str):
        raise PatternError("property names must be strings")
    return key


def plain_props(props: dict | None) -> dict[str, Any]:
    return {k: value_of(c if isinstance(c, dict) else c.asDict()) for k, c in (props or {}).items()}


def show_value(value: Any) -> str:
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ", ".join(map(show_value, value)) + "]"
    if isinstance(value, dict):
        return show_props(value)
    return "()" if value is None else str(value)


def show_props(values: dict[str, Any]) -> str:
    return "{" + ", ".join(f"{k}: {show_value(values[k])}" for k in sorted(values)) + "}"


#: A float in canonical JSON. Quotes within strings are escaped there, so no string holds this.
_FLOAT = r'\{"d": "([^"]*)"\}'
_NO_FLOAT = '{"d": ""}'


def _nested_equals(j: Column, wanted: str) -> Column:
    """Whether canonical JSON is the wanted one, floats within EPSILON."""
    floats = [float(x) for x in re.findall(_FLOAT, wanted)]
    if not floats:
        return j == F.lit(wanted)
    own = F.transform(F.regexp_extract_all(j, F.lit(_FLOAT), F.lit(1)), lambda x: x.cast("double"))
    near = F.zip_with(own, F.array(*map(F.lit, floats)), lambda a, b: F.coalesce(~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) < F.lit(EPSILON)), F.lit(False)))
    return (F.regexp_replace(j, _FLOAT, _NO_FLOAT) == F.lit(re.sub(_FLOAT, _NO_FLOAT, wanted))) & F.forall(near, lambda x: x)


def cell_equals(c: Column, value: Any) -> Column:
    """Whether a cell equals a Python value: of the same kind, floats within EPSILON, null never.

    Null stands for false, as it does in a filter; so the comparison can reach a scan.
    """
    own = cell(value)
    tag = own["t"]
    if tag == "n":
        return F.lit(False)
    if tag == "d":
        same = F.lit(False) if math.isnan(value) else F.abs(c["d"] - F.lit(value)) < F.lit(EPSILON)
    elif tag in "lm":
        same = _nested_equals(c["j"], own["j"])
    else:
        field = "i" if tag in "io" else tag
        same = c[field] == F.lit(own[field])
    return (c["t"] == F.lit(tag)) & same


def matches(props: Column, wanted: dict[str, Any], missing: bool) -> Column:
    """Whether a property map has all wanted values; missing is what an absent name counts as."""
    out = F.lit(True)
    for name, value in wanted.items():
        c = props[name]  # over a map made of columns, this folds to the column
        same = cell_equals(c, value)
        out = out & (F.when(c.isNull(), F.lit(missing)).otherwise(same) if missing else same)
    return out


def shown_cell(c: Column) -> Column:
    """What show_value() gives, from a cell; floats as Spark shows them."""
    quoted = F.to_json(F.array(c["s"]))
    shown = F.when(c["t"] == "s", F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    shown = shown.when(c["t"] == "b", c["b"].cast("string")).when(c["t"] == "d", c["d"].cast("string"))
    return F.coalesce(shown.when(c["t"].isin("l", "m"), c["s"]).when(c["t"].isin("i", "o"), c["i"].cast("string")), F.lit("()"))


def shown_props(props: Column) -> Column:
    """What show_props() gives, from a property map."""
    pairs = F.transform(F.array_sort(F.map_keys(props)), lambda k: F.concat(k, F.lit(": "), shown_cell(props[k])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def cell_column(value: Column, tag: str) -> Column:
    """A cell from a column of long (i), double (d), boolean (b) or string (s) values; null has tag n."""
    kinds = {"i": "bigint", "d": "double", "b": "boolean", "s": "string"}
    fields = [value.cast(kinds[k]).alias(k) if k == tag else F.lit(None).cast(kinds[k]).alias(k) for k in "idbs"]
    return F.struct(F.when(value.isNull(), F.lit("n")).otherwise(F.lit(tag)).alias("t"), *fields, F.lit(None).cast("string").alias("j"))
