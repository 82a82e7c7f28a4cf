"""Scalar functions as column expressions; Python only where the rule has no built-in form."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it; Java's \s alone is ASCII.
SPACES = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """The text without white space at its ends, line breaks included."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """Split at runs of white space; blank text has none."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, SPACES))


def fts_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits, the full-text token rule."""
    return F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def byte_tokens(c: Column | str) -> Column:
    """Token estimate: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(col(c)) / 4).cast("int")


def saturate(c: Column | str, half: float = 5.0) -> Column:
    """s / (s + half): maps a sparse score to 0..1."""
    return col(c) / (col(c) + half)


def rank_decay(rank: Column) -> Column:
    """1, 0.9, ... by rank from 0, never below 0.1."""
    return F.greatest(1.0 - rank * 0.1, F.lit(0.1))


def slug(c: Column | str) -> Column:
    """Lower case; runs of all but letters and digits become one '_', none at the ends; 'node' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("node")).otherwise(s)


def sha_prefix(n: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, n)


def node_id(kind: Column, *path: Column) -> Column:
    """Stable id of a navigation node from its place."""
    return F.concat(kind, F.lit(":"), slug(path[-1]), F.lit("-"), sha_prefix(32, F.lit("v2"), kind, *path))


def tunnel_ends(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))


def tunnel_id(a: Column | str, b: Column | str) -> Column:
    low, high = tunnel_ends(a, b)
    return F.concat(F.lit("tunnel-"), sha_prefix(32, F.lit("v2"), low, high))


def confidence(text: Column | str, count: Column | str) -> Column:
    """Percent: 50, more for length in bytes of the trimmed text and for repetitions, at most 95."""
    n, k = F.octet_length(strip(text)), col(count)
    length = F.when(n < 10, 0).when(n < 24, 5).when(n < 48, 10).otherwise(15)
    often = F.when(k <= 1, 0).when(k == 2, 10).when(k == 3, 20).otherwise(30)
    return F.least(F.lit(50) + length + often, F.lit(95))


def pattern_key(role: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("aaak-"), sha_prefix(12, F.initcap(col(role)), col(text)))


def lesson_id(project: Column | str, key: Column | str) -> Column:
    return F.concat(F.lit("lesson-"), sha_prefix(16, col(project), col(key)))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def like_contains(c: Column | str, query: str) -> Column:
    """lower(c) LIKE '%query%'; wildcards of the query keep their meaning."""
    return F.lower(col(c)).like(f"%{query.lower()}%")


def normal_entity(raw: str | None) -> str:
    """White space collapsed, punctuation cut from the ends, acronyms kept, longer words capitalised."""
    s = " ".join((raw or "").split()).strip("\"'.,()[]")
    letters = [c for c in s if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return s
    return " ".join(w if len(w.encode()) <= 2 else w[0].upper() + w[1:].lower() for w in s.split(" ")) if s else ""


@F.arrow_udf(StringType())
def entity_name(c: pa.Array) -> pa.Array:
    return pa.array([normal_entity(x) for x in c.to_pylist()], pa.string())


def calendar_like(c: Column | str) -> Column:
    """YYYY-MM-DD with months 1-12 and days 1-31 of any month."""
    return col(c).rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")


def valid_name(c: Column | str, longest: int = 128, pattern: str = r"^[A-Za-z0-9 _.:/\-]+$") -> Column:
    s = strip(c)
    return (s != "") & (F.length(s) <= longest) & s.rlike(pattern) & ~s.contains("..") & ~s.rlike(r"^[.\-]|[.\-]$")


def millis(c: Column | str) -> Column:
    """Milliseconds since 1970 of the written date and time, whatever the session's time zone."""
    d = F.date_diff(F.to_date(col(c)), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    return d + F.hour(col(c)) * 3_600_000 + F.minute(col(c)) * 60_000 + F.floor(F.extract(F.lit("SECOND"), col(c)) * 1000).cast("long")


def mime(path: Column | str) -> Column:
    """MIME type by extension."""
    e = F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))
    return F.when(e.isin("md", "markdown"), "text/markdown").when(e == "json", "application/json").when(e == "html", "text/html").when(e.isin("yml", "yaml"), "application/yaml").when(e == "toml", "application/toml").otherwise("text/plain")
