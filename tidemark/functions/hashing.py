"""Seeded draws and record hashes as column expressions, the same on every engine and partitioning.

A draw is the first 15 hex digits of the SHA-256 of `seed:purpose:id`; it replaces random streams, whose
values depend on the order of rows.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def draw(seed: int, purpose: str, *ids: Column | str) -> Column:
    """A whole number in [0, 2^60) for each row."""
    parts = [F.col(i) if isinstance(i, str) else i for i in ids]
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def uniform(seed: int, purpose: str, *ids: Column | str) -> Column:
    """A number in (0, 1)."""
    return (draw(seed, purpose, *ids).cast("double") + 0.5) / float(1 << DRAW_BITS)


def normal(seed: int, purpose: str, *ids: Column | str) -> Column:
    """A standard normal number (Box-Muller)."""
    return F.sqrt(-2 * F.ln(uniform(seed, f"{purpose}-r", *ids))) * F.cos(2 * math.pi * uniform(seed, f"{purpose}-a", *ids))


def student3(seed: int, purpose: str, *ids: Column | str) -> Column:
    """A Student t number with three degrees of freedom."""
    z = [normal(seed, f"{purpose}-{k}", *ids) for k in range(4)]
    return z[0] / F.sqrt((z[1] * z[1] + z[2] * z[2] + z[3] * z[3]) / 3)


def sql_draw(seed: int, purpose: str, *ids: str) -> str:
    text = " || ':' || ".join([f"'{seed}:{purpose}'", *[f"({i})::VARCHAR" for i in ids]])
    return f"('0x' || substr(sha256({text}), 1, 15))::BIGINT"


def sql_uniform(seed: int, purpose: str, *ids: str) -> str:
    return f"(({sql_draw(seed, purpose, *ids)})::DOUBLE + 0.5) / {float(1 << DRAW_BITS)!r}"


def sql_normal(seed: int, purpose: str, *ids: str) -> str:
    return f"(sqrt(-2 * ln({sql_uniform(seed, purpose + '-r', *ids)})) * cos({2 * math.pi!r} * {sql_uniform(seed, purpose + '-a', *ids)}))"


def sql_student3(seed: int, purpose: str, *ids: str) -> str:
    z = [sql_normal(seed, f"{purpose}-{k}", *ids) for k in range(4)]
    return f"({z[0]} / sqrt((pow({z[1]}, 2) + pow({z[2]}, 2) + pow({z[3]}, 2)) / 3))"


def derived_seed(*parts) -> int:
    """A seed below 2^31 - 1 from the parts joined by colons."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16], 16) % (2**31 - 1)


def derived_seed_column(*parts: Column) -> Column:
    """derived_seed as a column expression."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(2**31 - 1)).cast("long")


def record_hash(*columns: Column) -> Column:
    """SHA-256 of a record's fields, each written with its length, a null as a tilde: no two records are written alike."""
    field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~"))
    return F.sha2(F.concat_ws("|", *[field(c.cast("string")) for c in columns]), 256)


def sql_record(*columns: str) -> str:
    """The text that record_hash hashes."""
    return "concat_ws('|', " + ", ".join(f"coalesce(length(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '~')" for c in columns) + ")"


def config_hash(config: object) -> str:
    """SHA-256 of a configuration as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def bundle_hash(*parts: str | None) -> str:
    """SHA-256 of an ordered list of component hashes; an absent one counts as NONE."""
    return hashlib.sha256("|".join(p or "NONE" for p in parts).encode()).hexdigest()
