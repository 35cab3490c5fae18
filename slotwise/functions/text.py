"""Scalar text functions of the log operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a file system may reserve.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
RAW_LENGTH = 500


def stripped(text: Column) -> Column:
    """Without Unicode white space at the ends (Spark's trim knows only spaces)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def raw_text(line: Column) -> Column:
    return F.substring(stripped(line), 1, RAW_LENGTH)


def plain_cpu(cpu: Column) -> Column:
    """'0' and null mean the board itself, as ''."""
    cpu = F.coalesce(stripped(cpu), F.lit(""))
    return F.when(cpu == "0", "").otherwise(cpu)


def slot_id(folder: Column) -> Column:
    """'slot_1' gives '1'; other names stand for themselves."""
    return F.when(folder.rlike("(?i)^slot_."), F.regexp_extract(folder, "(?i)^slot_(.+)", 1)).otherwise(folder)


def private_slot(folder: Column) -> Column:
    """struct(slot, cpu) of 'slot_1' and 'slot_1_cpu_2'; cpu is null where the name has none."""
    pattern = "(?i)^slot_(.+?)_cpu_(.+)"
    both = folder.rlike(pattern)
    return F.struct(F.when(both, F.regexp_extract(folder, pattern, 1)).otherwise(slot_id(folder)).alias("slot"), F.when(both, F.regexp_extract(folder, pattern, 2)).alias("cpu"))


def last_part(path: Column) -> Column:
    """The last part of a path that is not empty, '' if there is none."""
    parts = F.filter(F.transform(F.split(stripped(path), "/"), stripped), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def rotation(name: Column, java: str) -> Column:
    """The rotation number in a journal's name (group 1 at the start), 0 for the current one."""
    return F.coalesce(F.when(name.rlike(f"^(?:{java})"), F.regexp_extract(name, f"^(?:{java})", 1)).try_cast("int"), F.lit(0))


def is_compressed(name: Column, suffixes: list[str]) -> Column:
    found = F.lit(False)
    for s in suffixes:
        found = found | F.lower(name).endswith(s)
    return found


def dashed_process(name: Column, least_digits: int = 1) -> Column:
    """struct(process, pid) of 'name-123': the last dash and only digits behind it, ``least_digits`` at least; else pid ''."""
    pattern = r"^(?s)(.*)-(\d{%d,})$" % least_digits
    fits = name.rlike(pattern)
    return F.struct(F.when(fits, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("process"), F.when(fits, F.regexp_extract(name, pattern, 2)).otherwise("").alias("pid"))


def bracket_process(name: Column) -> Column:
    """struct(process, pid) of 'name[123]'."""
    pattern = r"^(.+?)\[(\d+)\]$"
    fits = name.rlike(pattern)
    return F.struct(F.when(fits, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("process"), F.when(fits, F.regexp_extract(name, pattern, 2)).otherwise("").alias("pid"))


def is_safe_segment(text: Column) -> Column:
    stem = F.upper(F.substring_index(text, ".", 1))
    return text.rlike(r"^[A-Za-z0-9_.-]+$") & ~text.isin(".", "..") & ~text.endswith(".") & ~stem.isin(RESERVED)


def safe_segment(value: Column) -> Column:
    """A path segment: safe text as it is, else each other character as ~U and eight hex digits, and a hash of the whole."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.when(c.rlike(r"^[A-Za-z0-9_.-]$"), c).otherwise(F.concat(F.lit("~U"), F.lpad(F.lower(F.hex(code_point(c))), 8, "0"))))
    coded = F.concat(F.array_join(chars, ""), F.lit("~H"), F.substring(F.sha2(text.cast("binary"), 256), 1, 16))
    return F.when(text == "", "unknown").when(is_safe_segment(text), text).otherwise(coded)


def code_point(char: Column) -> Column:
    """The code point of a one-character text, from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("long")


def log_file_name(process: Column, pid: Column) -> Column:
    """The evidence file of a process."""
    name, number = F.coalesce(process, F.lit("")), F.coalesce(pid, F.lit(""))
    plain = is_safe_segment(name) & ((number == "") | is_safe_segment(number))
    return F.when(plain, F.concat(name, F.when(number == "", "").otherwise(F.concat(F.lit("-"), number)), F.lit(".log"))).otherwise(
        F.concat(safe_segment(name), F.when(number == "", "").otherwise(F.concat(F.lit("~P"), safe_segment(number))), F.lit(".log"))
    )


def reference(*fields: Column) -> Column:
    """SHA-256 over fields with a unit separator between them."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def single_line(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def shortened(text: Column, width: int = 120) -> Column:
    """At most ``width`` characters; a cut text ends in an ellipsis without space before it."""
    return F.when(F.length(text) > width, F.concat(F.regexp_replace(F.substring(text, 1, width - 1), r"(?U)\s+\z", ""), F.lit("\u2026"))).otherwise(text)


def raw_preview(text: Column, width: int = 160) -> Column:
    """Line ends escaped, double quotes as single ones; a text over ``width`` characters is cut to end in dots."""
    one = F.replace(F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit("'"))
    return F.when(F.length(one) > width, F.concat(F.substring(one, 1, width - 3), F.lit("..."))).otherwise(one)


def name_shape(name: Column) -> Column:
    """A file name with each run of two or more digits as *."""
    return F.regexp_replace(name, r"\d{2,}", "*")


def sequence_label(sequence: Column) -> Column:
    """'[0007]', and dots where there is no sequence."""
    return F.when(sequence > 0, F.concat(F.lit("["), F.when(sequence < 10_000, F.lpad(sequence.cast("string"), 4, "0")).otherwise(sequence.cast("string")), F.lit("]"))).otherwise("[....]")


def folded(text: Column) -> Column:
    """Case folded: lower case, with sharp s as two."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def has_field(line: Column, alias: str) -> Column:
    """Whether a line names a field: the alias between no identifier characters, then colon, equals or white space."""
    import re

    return line.rlike(r"(?i)(?<![A-Za-z0-9_])" + re.escape(alias) + r"(?![A-Za-z0-9_])(?:\s*[:=]|\s)")
