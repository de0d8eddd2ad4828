"""Column expressions over names, URIs, table lists and settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which URI schemes each storage kind answers to.
SCHEME_PROVIDERS = {
    "file": "local",
    "local": "local",
    "s3": "s3",
    "s3a": "s3",
    "s3n": "s3",
    "azure": "azure",
    "az": "azure",
    "gcs": "gcs",
    "gs": "gcs",
}

# The accepted spellings of the backup types and dump formats.
BACKUP_TYPES = ["FULL", "INCREMENTAL", "DIFFERENTIAL"]
DUMP_FORMATS = ["PLAIN_SQL", "CUSTOM", "CUSTOM_FC", "DIRECTORY", "TAR", "BINLOG", "WAL", "OPLOG"]

# Destinations used when none is given.
DEFAULT_URI = "file:///backups/backup.sql"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What counts as white space in a blank test, and what is trimmed from both ends.
NOT_BLANK = r"[^\t-\r\x1C-\x20\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"
TRIMMED = "".join(map(chr, range(0x21)))


def trimmed(c: Column | str) -> Column:
    """Without control characters and spaces at both ends."""
    return F.btrim(col(c), F.lit(TRIMMED))


def blank_to_null(c: Column | str) -> Column:
    """Null for null, empty and whitespace-only text, otherwise the text unchanged."""
    return F.when(col(c).rlike(NOT_BLANK), col(c))


def first_given(*cs: Column | str) -> Column:
    """First argument that is not blank; the last one is taken as it is."""
    return F.coalesce(*[blank_to_null(c) for c in cs[:-1]], col(cs[-1]))


def decode_tables(c: Column | str) -> Column:
    """Comma text to a list: trimmed, empties dropped, null or blank gives an empty list."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), trimmed)
    return F.filter(parts, lambda x: x != "")


def encode_tables(c: Column | str) -> Column:
    return F.array_join(F.coalesce(col(c), F.array().cast("array<string>")), ",")


def table_set(c: Column | str) -> Column:
    """A comparable form of a table list seen as a set; null equals the empty set."""
    return F.array_sort(F.array_distinct(F.coalesce(col(c), F.array().cast("array<string>"))))


def safe_name(c: Column | str) -> Column:
    """Name that can be a path segment."""
    return F.regexp_replace(col(c), "[^a-zA-Z0-9._-]", "_")


def uri_scheme(c: Column | str) -> Column:
    uri = col(c)
    return (
        F.when(blank_to_null(uri).isNull(), F.lit("file"))
        .when(F.instr(uri, ":") > 0, F.lower(trimmed(F.substring_index(uri, ":", 1))))
        .otherwise(F.lit("file"))
    )


def uri_path(c: Column | str) -> Column:
    """The URI without its scheme, in either of the forms ``x://`` and ``x:``."""
    return F.regexp_replace(col(c), r"(?i)^(file|local|s3a|s3n|s3|azure|az|gcs|gs):(//)?", "")


def uri_bucket(c: Column | str) -> Column:
    return F.substring_index(uri_path(c), "/", 1)


def uri_key(c: Column | str) -> Column:
    """What follows the first slash; empty when there is none."""
    return F.regexp_extract(uri_path(c), r"(?s)^[^/]*/(.*)$", 1)


def object_id(c: Column | str) -> Column:
    """One spelling of the object a URI names: storage kind, then its path without repeated or leading slashes.

    ``file:///x/y``, ``file:/x/y`` and ``/x/y`` are one object, and so are ``s3://b/k`` and ``S3A://b/k``. A scheme no storage
    kind answers to stands for itself.
    """
    scheme = uri_scheme(c)
    kinds = F.create_map(*[F.lit(x) for pair in SCHEME_PROVIDERS.items() for x in pair])
    path = F.regexp_replace(F.regexp_replace(col(c), r"^[^:]*:(//)?", ""), "/+", "/")
    return F.concat(F.coalesce(F.element_at(kinds, scheme), scheme), F.lit(":"), F.regexp_replace(path, "^/", ""))


# The named schedules and their six fields.
CRON_NAMES = {
    "@yearly": "0 0 0 1 1 *",
    "@annually": "0 0 0 1 1 *",
    "@monthly": "0 0 0 1 * *",
    "@weekly": "0 0 0 * * 0",
    "@daily": "0 0 0 * * *",
    "@midnight": "0 0 0 * * *",
    "@hourly": "0 0 * * * *",
}


def normal_cron(c: Column | str) -> Column:
    """Six-field cron text; a five-field one gets second 0, a missing one runs hourly, a named one is spelled out."""
    text = trimmed(c)
    fields = F.size(F.split(text, r"\s+"))
    out = F.when(col(c).isNull(), F.lit("0 0 * * * *")).when(fields == 5, F.concat(F.lit("0 "), text))
    for name, spelled in CRON_NAMES.items():
        out = out.when(F.lower(text) == name, F.lit(spelled))
    return out.otherwise(text)
