"""Column functions on JSON texts and on text that is shown. JSON of any nesting is read by Arrow-batched Python; a text that isn't JSON,
or null, gives null."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

COMPACT = {"ensure_ascii": False, "separators": (",", ":")}


def _on_json(kind: DataType, made: pa.DataType, change: Callable) -> Callable[[Column], Column]:
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append(None if text is None else change(json.loads(text)))
            except ValueError:
                out.append(None)
        return pa.array(out, made)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def _bare(value, name: str):
    if isinstance(value, dict):
        return {k: _bare(v, name) for k, v in value.items() if k != name}
    return [_bare(v, name) for v in value] if isinstance(value, list) else value


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings(v)


def _names(value) -> list[str]:
    held = value.get("properties") if isinstance(value, dict) else None
    return sorted(held) if isinstance(held, dict) else []


#: The same value always as the same text: keys sorted at all depths, no blanks.
canonical = _on_json(StringType(), pa.string(), lambda v: json.dumps(v, sort_keys=True, **COMPACT))
#: A schema without its descriptions, at all depths.
without_descriptions = _on_json(StringType(), pa.string(), lambda v: json.dumps(_bare(v, "description"), **COMPACT))
#: Every text value, at any depth.
string_values = _on_json(ArrayType(StringType()), pa.list_(pa.string()), lambda v: list(_strings(v)))
#: The sorted names of a schema's properties.
parameter_names = _on_json(ArrayType(StringType()), pa.list_(pa.string()), _names)


def token_estimate(text: Column) -> Column:
    """Half the characters of JSON, a quarter of other text, one at least."""
    per = F.when(F.startswith(text, F.lit("{")) | F.startswith(text, F.lit("[")), 2).otherwise(4)
    return F.greatest(F.lit(1), F.floor(F.length(text) / per)).cast("int")


def escaped(text: Column) -> Column:
    """Control characters as escapes."""
    for code in (*range(32), 127):
        text = F.replace(text, F.lit(chr(code)), F.lit({9: "\\t", 10: "\\n", 13: "\\r"}.get(code, f"\\x{code:02x}")))
    return text
