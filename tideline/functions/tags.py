"""Tags, series keys and names."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.errors import InvalidIdentifier, InvalidInterval, InvalidPoint


#: Fixed by JSON: two-character escapes, and six-character ones for all other control characters.
_JSON_CODES = [("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
_JSON_CODES += [(chr(c), f"\\u{c:04x}") for c in range(32) if chr(c) not in "\b\f\n\r\t"]


def _escaped(text: Column) -> Column:
    """A JSON string literal."""
    out = text
    for raw, code in _JSON_CODES:
        out = F.replace(out, F.lit(raw), F.lit(code))
    out = F.when(text.rlike(r'[\x00-\x1f"\\]'), out).otherwise(text)  # few texts need any
    return F.concat(F.lit('"'), out, F.lit('"'))


def tags_json(tags: Column) -> Column:
    """Canonical JSON of an array of (key, value) structs: sorted by key and value, duplicates kept, {} for none."""
    parts = F.transform(F.array_sort(tags), lambda t: F.concat(_escaped(t["key"]), F.lit(":"), _escaped(t["value"])))
    return F.concat(F.lit("{"), F.coalesce(F.array_join(parts, ","), F.lit("")), F.lit("}"))


def tags_of(**columns: Column) -> Column:
    """An array of (key, value) structs of named columns."""
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()])


def canonical_tags(tags: list[tuple[str, str]]) -> str:
    """Driver-side form of tags_json."""
    for key, _ in tags:
        if not key:
            raise InvalidPoint("empty tag key")
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json.dumps(v, ensure_ascii=False)}" for k, v in sorted(tags)) + "}"


def series_id(metric: Column, tags: Column) -> Column:
    """A surrogate key that needs no sequence: equal series get equal ids in every task."""
    return F.xxhash64(metric, tags)


def identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or "", re.ASCII):
        raise InvalidIdentifier(f"not an identifier: {name!r}")
    return name


def table_name(measurement: str) -> str:
    """The name of a measurement's table: itself if it is an identifier, else with every other character (and whatever
    looks like this code) as _x<hex>_, so that different measurements have different tables."""
    def code(c: str) -> str:
        return f"_x{ord(c):x}_"

    safe = re.sub(r"_(?=x[0-9a-f]+_)", code("_"), measurement)
    safe = re.sub(r"[^A-Za-z0-9_]", lambda m: code(m[0]), safe, flags=re.ASCII)
    return identifier(code(safe[0]) + safe[1:] if safe[:1].isdigit() else safe)


def unquoted(text: str) -> str:
    """Without one pair of matching quotes around it."""
    text = text.strip()
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"`" else text


def table_arguments(args: list[str]) -> tuple[str, int]:
    """Table name and chunk width in ns of a virtual table's arguments; a minute where no width is given."""
    name = identifier(unquoted(args[0])) if args else ""
    if not name:
        raise InvalidIdentifier("a table needs a name")
    width = int(unquoted(args[1])) if len(args) > 1 else 60_000_000_000
    if width <= 0:
        raise InvalidInterval(f"chunk width must be positive: {width}")
    return name, width


def row_arguments(args: list) -> tuple[int, float | None, int]:
    """(ts_ns, value, quality) of a row's arguments; quality 0 where none is given."""
    if len(args) < 2 or args[0] is None:
        raise InvalidPoint("a row needs a time and a value")
    return int(args[0]), None if args[1] is None else float(args[1]), int(args[2]) if len(args) > 2 and args[2] is not None else 0
