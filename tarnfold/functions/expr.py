"""Column expressions for filing metadata and text. None of them is a Python function at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILING_ID = "^" + "-".join((r"(.+?)", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", r"([a-zA-Z]+)", r"([A-Z][A-Z])", r"([0-9]+)")) + "$"
TOPIC = r"^[A-Z]+[0-9]+"
ANCHORS = (
    "ESRS",
    "sustainability statement",
    "Total GHG emissions",
    "Gross Scope 1 GHG emissions",
    "Scope 1 .{0,3} 3",
    "Water consumption",
    "Energy consumption and mix",
    "[Cc]onfirmed incidents of corruption",
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's variable instead of copies of the expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(c: Column) -> Column:
    """NULL for NULL and ''."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither NULL nor ''."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def part_of(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL without a match."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def filing_id_parts(c: Column) -> Column:
    """Struct (lei, period_end, report_type, country, seq) of a filing id; all NULL if it has another form."""
    ok = c.rlike(FILING_ID)
    piece = lambda g: F.when(ok, F.regexp_extract(c, FILING_ID, g))
    return F.struct(piece(1).alias("lei"), piece(2).alias("period_end"), piece(3).alias("report_type"), piece(4).alias("country"), piece(5).try_cast("int").alias("seq"))


def lei_of(entity_lei: Column, filing_id: Column) -> Column:
    """The entity's identifier, else that within the filing id."""
    return first_filled(entity_lei, filing_id_parts(filing_id)["lei"])


def lei_by_prefix(filing_id: Column, entity_lei: Column) -> Column:
    """The text before the filing id's first hyphen, else the entity's identifier, else ''."""
    return F.coalesce(first_filled(F.substring_index(filing_id, "-", 1), entity_lei), F.lit(""))


def fiscal_year(period_end: Column) -> Column:
    """The first four characters if they are digits."""
    return F.when(period_end.rlike(r"^\d{4}"), F.substring(period_end, 1, 4))


def fiscal_year_anywhere(period_end: Column, last_end: Column, url: Column) -> Column:
    """A year 20xx at the start of either date, else the first such in the URL."""
    return F.coalesce(part_of(first_filled(period_end, last_end), r"^(20\d{2})"), part_of(url, r"(20\d{2})"))


def report_year(period_end: Column) -> Column:
    """The year as a number; NULL where it is none."""
    return F.substring(period_end, 1, 4).try_cast("int")


def absolute_url(url: Column, base: str) -> Column:
    """base in front of a path; anything else as it is."""
    return F.when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)


def safe_name(c: Column, most: int = 120) -> Column:
    """Each character that a file name shouldn't have becomes '_'; cut to `most` characters."""
    return F.substring(F.regexp_replace(c, r"[^\w.\-]", "_"), 1, most)


def safe_upload_name(c: Column) -> Column:
    """The last path segment with runs of other characters as one '_', without dots and underscores at either end."""
    last = F.regexp_extract(c, r"([^/]+)$", 1)
    return F.regexp_replace(F.regexp_replace(last, r"[^\w.\-]+", "_"), r"^[._]+|[._]+$", "")


def package_name(lei: Column, period_end: Column, sha: Column) -> Column:
    short = F.coalesce(blank_to_null(F.substring(sha, 1, 8)), F.lit("nohash"))
    return F.concat(safe_name(F.coalesce(lei, F.lit(""))), F.lit("_"), safe_name(F.coalesce(period_end, F.lit(""))), F.lit("_"), short, F.lit(".zip"))


def object_key(country: Column, year: Column, name: Column, root: str = "esef") -> Column:
    """Where a package lies in an object store."""
    return F.concat_ws("/", F.lit(root), country, year, name)


def hash_of(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def stable_id(prefix: str, *keys: Column) -> Column:
    """The same id for the same keys, always: NULL and '' differ."""
    marked = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("!")) for k in keys]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *marked), 256), 1, 32))


def size_mb(n_bytes: Column) -> Column:
    return F.round(n_bytes / 1e6, 2)


def has_anchor(text: Column) -> Column:
    """1 if any disclosure phrase occurs, else 0; 0 for NULL."""
    return F.coalesce(text.rlike("|".join(ANCHORS)), F.lit(False)).cast("int")


def topic_of(code: Column) -> Column:
    """'E1-6' -> 'E1'."""
    return part_of(code, TOPIC, 0)


def flags(*pairs: tuple[Column, str | Column]) -> Column:
    """The names of those conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n) if isinstance(n, str) else n) for c, n in pairs)))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def box_size(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Struct (width, height) of a bounding box."""
    return F.struct((x1 - x0).alias("width"), (y1 - y0).alias("height"))


def fragment_kind_ok(kind: Column) -> Column:
    """Whether a value is one of the kinds of evidence; NULL is none."""
    from ..schemas import VOCABULARIES

    return F.coalesce(kind.isin(sorted(VOCABULARIES["evidence_kind"])), F.lit(False))
