"""Scalar functions over text, hashes, paths and identifiers, as Column expressions.

All stay inside whole-stage code generation where Spark has a generated form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Unicode White_Space, spelled out: Java's \s is ASCII only by default.
SPACE_CLASS = r"[\x09-\x0D\x20\x85\p{Z}]"
HASH_PREFIX = "sha256:"
TEMPLATE_FLOOR = 36
SHARED_BY = 3
PREVIEW_CHARS = 80


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def normalise(c) -> Column:
    """Every run of white space is one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), SPACE_CLASS + "+", " "))


def trim_space(c) -> Column:
    """White space of any kind cut from both ends."""
    return F.regexp_replace(col(c), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def is_normalised(c) -> Column:
    return col(c) == normalise(c)


def content_hash(c) -> Column:
    return F.concat(F.lit(HASH_PREFIX), F.sha2(col(c), 256))


def normalised_hash(c) -> Column:
    return content_hash(normalise(c))


def byte_hash(c) -> Column:
    return F.concat(F.lit(HASH_PREFIX), F.sha2(col(c).cast("binary"), 256))


def is_hash(c) -> Column:
    return col(c).rlike("^sha256:[0-9a-f]{64}$")


def framed_digest(*parts) -> Column:
    """A digest of parts each preceded by its length in bytes, so no two lists collide."""
    framed = [F.concat(F.octet_length(col(p)).cast("string"), F.lit(":"), col(p)) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def framed_list(c) -> Column:
    """The parts of an array, each with its length, as one string for ``framed_digest``."""
    return F.array_join(F.transform(col(c), lambda x: F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)), "")


def normal_path(c) -> Column:
    """Slashes forward, no empty or dot segments, lower case."""
    parts = F.split(F.replace(trim_space(c), F.lit("\\"), F.lit("/")), "/")
    return F.lower(F.array_join(F.filter(parts, lambda s: (s != "") & (s != ".")), "/"))


def subject_of_path(c) -> Column:
    return F.sha2(normal_path(c), 256)


def occurrence_id(rule, subject, summary, locations) -> Column:
    return framed_digest(rule, subject, summary, framed_list(locations))


def lineage_id(rule, subject, summary) -> Column:
    """The occurrence's identity without its locations."""
    return framed_digest(rule, subject, summary)


def heading_title(c) -> Column:
    return trim_space(F.regexp_replace(col(c), "^#+", ""))


def heading_depth(c) -> Column:
    return F.length(F.regexp_extract(col(c), "^(#*)", 1))


def template_key(text, title) -> Column:
    """Text with white space flattened and its section's title replaced by {}."""
    flat, name = normalise(text), normalise(title)
    return F.when((name != "") & name.isNotNull(), F.replace(flat, name, F.lit("{}"))).otherwise(flat)


def is_template_length(c, floor: int = TEMPLATE_FLOOR) -> Column:
    return F.length(normalise(c)) >= floor


def is_pipe_line(c) -> Column:
    t = trim_space(c)
    return (F.octet_length(t) >= 2) & t.startswith("|") & t.endswith("|")


def split_cells(c) -> Column:
    """Cells of a pipe line; a pipe after a backslash (itself not escaped) is text."""
    inner = F.regexp_replace(trim_space(c), r"^\|+|\|+$", "")
    # an escaped character passes over whole, so an escaped backslash does not escape a pipe
    marked = F.regexp_replace(inner, r"(\\.)|\|", "$1\x01")
    kept = F.regexp_replace(marked, r"(\\.)\x01", "$1")
    return F.transform(F.split(kept, "\x01"), trim_space)


def is_separator(cells) -> Column:
    """Non-empty cells are all runs of two or more dashes, with a colon at either end or not."""
    full = F.filter(col(cells), lambda x: x != "")
    return (F.size(full) > 0) & F.forall(full, lambda x: x.rlike("^:?-{2,}:?$"))


def statement_id_parts(c) -> Column:
    """prefix and number of PREFIX-NNN (three digits or more), else null."""
    shape = r"^([A-Z][A-Z0-9-]*)-([0-9]{3,})$"
    return F.when(col(c).rlike(shape), F.struct(F.regexp_extract(col(c), shape, 1).alias("prefix"), F.regexp_extract(col(c), shape, 2).cast("long").alias("number")))


def strip_first_segment(c) -> Column:
    return F.regexp_replace(col(c), "^[^/]*/", "")


def family_key(c) -> Column:
    """An identifier without its trailing -digits."""
    return F.regexp_replace(col(c), "-[0-9]+$", "")


def cited_source(path, ordinal, row, heading) -> Column:
    """path#block, path#block:row or path#heading; null where there is no path."""
    block = F.concat(col(path), F.lit("#"), col(ordinal).cast("string"))
    return F.when(col(ordinal).isNotNull() & col(row).isNotNull(), F.concat(block, F.lit(":"), col(row).cast("string"))).when(col(ordinal).isNotNull(), block).when(col(heading).isNotNull(), F.concat(col(path), F.lit("#"), col(heading))).otherwise(col(path))


def item_digest(identity, names, values, body) -> Column:
    """sha256 over an item's identity, its ordered fields and its body, unit-separated."""
    fields = F.array_join(F.zip_with(col(names), col(values), lambda n, v: F.concat(n, F.lit("\x1f"), v)), "\x1e")
    return F.sha2(F.concat_ws("\x1e", col(identity), fields, F.coalesce(col(body), F.lit(""))), 256)


def sorted_json(c) -> Column:
    return F.to_json(F.array_sort(col(c)))


def names_in_cell(c) -> Column:
    """Names in back quotes in a table cell, or the parts between commas."""
    quoted = F.regexp_extract_all(col(c), F.lit("`([^`]+)`"), F.lit(1))
    parts = F.filter(F.transform(F.split(col(c), ","), trim_space), lambda x: x != "")
    return F.when(F.size(quoted) > 0, quoted).otherwise(parts)


def preview(c, most: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("…"))).otherwise(col(c))


def first_contained(c, patterns: list[str]) -> Column:
    """The first of the patterns, in their order, that the text contains."""
    return F.coalesce(*[F.when(F.contains(col(c), F.lit(p)), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def is_link_list(c) -> Column:
    """Every non-blank line is a list item that is one markdown link."""
    lines = F.filter(F.split(col(c), "\n"), lambda x: trim_space(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: trim_space(x).rlike(r"^[-*+] \[[^\]]*\]\([^)]*\)$"))


def skip_front_matter(c) -> Column:
    """Text after a leading --- block (a byte order mark before it is passed over)."""
    return F.regexp_replace(col(c), r"(?s)^\x{FEFF}?[ \t]*---[ \t]*\r?\n(?:.*?\n)??[ \t]*---[ \t]*\r?(?:\n|$)", "")


def under_any(path, prefixes: list[str]) -> Column:
    """The path equals a prefix or stands under it."""
    if not prefixes:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [(col(path) == p) | col(path).startswith(p.rstrip("/") + "/") for p in prefixes])


def like_prefix(c, value: str) -> Column:
    """Text begins with the value, ASCII case ignored; % stands for itself, _ for any character."""
    escaped = value.replace("\\", "\\\\").replace("%", "\\%")
    return F.ilike(col(c), F.lit(escaped + "%"))
