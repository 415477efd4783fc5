"""Lookup of a string in a fixed table, inside the JVM and without a join.

A map column in Spark is searched linearly, so one big literal map would cost a full scan
per lookup. The table is cut into many small maps by a checksum of the key instead.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, functions as F


def lookup(key: Column, table: dict, value_type: str = "double") -> Column:
    """``table[key]`` or null; ``table`` is a driver-side parameter and becomes one folded literal."""
    n = max(1, len(table))
    slots: list[dict] = [{} for _ in range(n)]
    for k, v in table.items():
        slots[zlib.crc32(k.encode()) % n][k] = v
    literal = F.from_json(F.lit(json.dumps(slots)), f"array<map<string,{value_type}>>")
    slot = F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int")
    return F.get(literal, slot)[key]
