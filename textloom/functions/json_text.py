"""Column expressions on JSON kept as text. All stay in the JVM; unreadable JSON gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def json_object(text: Column) -> Column:
    """map<string,string> of a JSON object, null for anything else.

    Parsing alone would accept text after the closing brace; counting the members of the text in brackets doesn't.
    """
    whole = (F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1) & text.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(whole, F.from_json(text, "map<string,string>", _STRICT))


def json_field(entries: Column, name: str) -> Column:
    """Value of the key, whatever its case; the last one where several keys differ by case only; null if absent."""
    hits = F.filter(F.map_entries(entries), lambda e: F.lower(F.trim(e["key"])) == name.lower())
    return F.try_element_at(hits, F.lit(-1))["value"]


def json_strings(text: Column) -> Column:
    """array<string> of a JSON array, also of one that was encoded twice; an empty array for anything else."""
    once = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT), F.lit(0))
    members = F.when(once.rlike(r"(?s)^\s*\[.*\]\s*$"), F.from_json(once, "array<string>", _STRICT))
    return F.coalesce(members, F.array().cast("array<string>"))
