"""Label matchers, series keys and values. A missing label counts as the empty string."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Microseconds of the duration units.
_UNITS = {"s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def _zoned(c: Column) -> Column:
    """Whether a timestamp has a zone: known when the query is planned, so that the other branch costs nothing."""
    return F.typeof(c) == "timestamp"


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp; one without zone is in UTC, whatever the session's zone is."""
    c = F.col(ts) if isinstance(ts, str) else ts
    since = (c.cast("timestamp_ntz") - moment(0)).cast("interval second").cast("decimal(20,6)")
    return F.when(_zoned(c), F.unix_micros(c.cast("timestamp"))).otherwise((since * 1_000_000).cast("long"))


def moment(at: int) -> Column:
    """The timestamp without zone of microseconds since the epoch, as a constant that a scan can compare its column with."""
    return F.lit((datetime(1970, 1, 1) + timedelta(microseconds=at)).isoformat(" ")).cast("timestamp_ntz")


def later(ts: str | Column, at: int) -> Column:
    """Whether a timestamp is after ``at`` microseconds; the constant has the column's own type, so that scans prune by it."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.when(_zoned(c), c > F.timestamp_micros(F.lit(at))).otherwise(c > moment(at))


def not_later(ts: str | Column, at: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.when(_zoned(c), c <= F.timestamp_micros(F.lit(at))).otherwise(c <= moment(at))


def duration(text: str) -> int:
    """Microseconds of ``<n>{s,m,h,d}``."""
    return int(text[:-1]) * _UNITS[text[-1]]


def label(name: str | Column) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))


def equals(name: str | Column, value: str) -> Column:
    return label(name) == value


def differs(name: str | Column, value: str) -> Column:
    return label(name) != value


def whole_match(pattern: str) -> str:
    r"""A pattern for the whole value; ``\z``, as ``$`` would also stand before a last line end."""
    return rf"\A(?:{pattern})\z"


def matches(name: str | Column, pattern: str) -> Column:
    """The whole label matches the pattern."""
    return label(name).rlike(whole_match(pattern))


def matches_not(name: str | Column, pattern: str) -> Column:
    return ~matches(name, pattern)


def one_of(name: str | Column, choice: str | None) -> Column:
    """A dashboard variable: a value, or any non-empty label for None."""
    return label(name) != "" if choice is None else label(name) == choice


def series_key(labels: str | Column) -> Column:
    r"""``k=v,k=v`` by key of a label map, ``(total)`` of one without labels: groups, joins and distinct work on it.

    ``,``, ``=`` and backslashes inside names and values come with a backslash, so that different maps have different
    keys; labels that are null or empty count as missing.
    """
    kept = F.map_filter(labels, lambda k, v: label(v) != "")
    plain = lambda c: F.regexp_replace(c, r"([,=\\])", r"\\$1")
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(plain(e["key"]), F.lit("="), plain(e["value"]))), ",")
    return F.when(F.size(kept) > 0, pairs).otherwise("(total)")


def labelled(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the empty string for missing labels among ``by``; labels that aren't texts stay as they are."""
    return rows.withColumns({c: label(c) for c in by if rows.schema[c].dataType.simpleString() == "string"})


def matched(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on labels, in which missing ones are equal: the labels of ``a``, then the other columns of both (of ``a`` alone in
    semi and anti joins, in a's order)."""
    a, b = labelled(a, on), labelled(b, on)
    if not on:
        return a.join(b, F.lit(True), how)
    other = b.withColumnsRenamed({c: f"_{c}_b" for c in on})
    hit = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}_b")) for c in on))
    joined = a.join(other, hit, how)
    return joined if how.endswith(("semi", "anti")) else joined.select(*on, *[c for c in a.columns if c not in on], *[c for c in b.columns if c not in on])


def merged(base: str | Column, more: str | Column) -> Column:
    """Both maps; later keys win, missing maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(base, empty), F.coalesce(more, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def number(text: str | Column) -> Column:
    """A value sent as text; 0.0 if it is no number."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).try_cast("double"), F.lit(0.0))


def default(value: str | Column, text: str) -> Column:
    """The text for null and for the empty string."""
    return F.coalesce(F.nullif(value if isinstance(value, Column) else F.col(value), F.lit("")), F.lit(text))


def whole(value: str | Column, places: int = 1) -> Column:
    """Whole values without decimals, others with ``places``."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(c == F.floor(c), F.format_string("%.0f", c)).otherwise(F.format_string(f"%.{places}f", c))


def bar(value: str | Column, unit: int = 100, most: int = 40) -> Column:
    """A text bar of one mark a ``unit``, and one more, up to ``most``."""
    c = F.col(value) if isinstance(value, str) else value
    return F.repeat(F.lit("█"), F.least(F.floor(c / unit).cast("int") + 1, F.lit(most)))


def template(text: str, values: dict[str, Column]) -> Column:
    """An annotation: ``{{name}}`` replaced by a column."""
    parts, rest = [], text
    while "{{" in rest:
        before, _, rest = rest.partition("{{")
        name, _, rest = rest.partition("}}")
        parts += [F.lit(before), values[name.strip()].cast("string")]
    return F.concat(*parts, F.lit(rest))


def percent_encoded(text: str | Column) -> Column:
    """A text as part of a query: all bytes but letters, digits and ``-_.~`` as ``%XX``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def base64_text(data: str | Column) -> Column:
    """Bytes in base64 as one line; Spark's own breaks it after each 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def clock(ns: str | Column) -> Column:
    """``HH:mm:ss.SSS`` in UTC of nanoseconds since the epoch, without the session's zone."""
    c = F.col(ns) if isinstance(ns, str) else ns
    of_day = F.pmod(c, F.lit(86_400_000_000_000))
    ms = ((of_day - of_day % 1_000_000) / 1_000_000).cast("long")
    part = lambda unit, most, width: F.lpad((F.floor(ms / unit) % most).cast("string"), width, "0")
    return F.concat(part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))
