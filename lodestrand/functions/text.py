"""Columns over text: tokens, identifiers, references, titles and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"
SPACE = " \n\r\t"


def tokens(text: Column) -> Column:
    """Lower-case tokens in order, repeats included; null gives no tokens."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def strip(text: Column, chars: str = SPACE) -> Column:
    """The text without leading and trailing characters of a set."""
    return F.btrim(text, F.lit(chars))


def labelled_items(text: Column, letter: str, label: str) -> Column:
    """What follows `[S<n>-<letter><n>] <label>:` on each line that has it, without asterisks at its end."""
    found = F.regexp_extract_all(text, F.lit(rf"\[S\d+-{letter}\d+\]\s*{label}:\s*([^\n]+)"), F.lit(1))
    cleaned = F.transform(found, lambda x: strip(F.rtrim(strip(x), F.lit("*"))))
    return F.coalesce(F.filter(cleaned, lambda x: x != ""), F.array().cast("array<string>"))


def topics(text: Column, fallback: Column | None = None) -> Column:
    """Topic titles of a summary; the fallback where it has none."""
    found = labelled_items(text, "T", "Topic")
    return found if fallback is None else F.when(F.size(found) > 0, found).otherwise(fallback)


def actions(text: Column) -> Column:
    """Action lines of a summary."""
    return labelled_items(text, "A", "Action")


def assignee(action: Column, names: Column) -> Column:
    """The first name in list order that equals or contains what stands before the first " to "; null if none."""
    who = F.lower(strip(F.split(action, " to ", 2)[0]))
    fits = F.filter(names, lambda n: F.contains(F.lower(n), who))
    return F.when(F.contains(action, F.lit(" to ")) & (who != ""), F.try_element_at(fits, F.lit(1)))


def summary_ids(text: Column) -> Column:
    """Identifiers S<n>-T<n> and S<n>-A<n> in brackets, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(r"\[(S\d+-[TA]\d+)\]"), F.lit(1))


def references(text: Column) -> Column:
    """Identifiers M<n>-T<n> and M<n>-A<n> behind the first `Reference:` of each line, in order, repeats included."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("Reference:")))
    return F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.regexp_extract(x, "Reference:(.*)", 1), F.lit(r"(M\d+-[TA]\d+)"), F.lit(1))))


def paragraph_range(reference: Column) -> Column:
    """Paragraph tags of a reference such as P001-P003,P007: ascending within a range, each once, in order of first
    mention. Dashes of either length count; parts that are not numbers are left out."""
    parts = F.transform(F.split(F.replace(reference, F.lit("–"), F.lit("-")), ","), lambda x: strip(x))
    good = F.filter(parts, lambda x: x.rlike(r"^P*\d+(\s*-\s*P*\d+)?$"))

    def numbers(part: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(part, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
        return F.sequence(F.array_min(ends), F.array_max(ends))

    return F.transform(F.array_distinct(F.flatten(F.transform(good, numbers))), lambda n: F.format_string("#P%03d", n))


def entry_id(text: Column) -> Column:
    """The first `- Topic id:` or `- Action id:` of an entry, null if none."""
    return F.nullif(strip(F.regexp_extract(text, r"-\s*(?:Topic id|Action id):\s*([^\n]+)", 1)), F.lit(""))


def entry_reference(text: Column) -> Column:
    """The reference of an entry: a listed `- Reference:` before one behind white space."""
    listed = F.nullif(strip(F.regexp_extract(text, r"-\s*Reference:\s*([^\n]+)", 1)), F.lit(""))
    plain = F.nullif(strip(F.regexp_extract(text, r"\s+Reference:\s*([^\n]+)", 1)), F.lit(""))
    return F.coalesce(listed, plain)


def without_fence(text: Column) -> Column:
    """What stands in a code fence, or the whole text without one."""
    inside = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\s*\n?(.*?)```", 1)
    return F.when(inside != "", strip(inside)).otherwise(strip(text))


def numbered(template: Column, number: Column, mark: str = "XXX") -> Column:
    """The template with its mark replaced by the three-digit number."""
    return F.replace(template, F.lit(mark), F.format_string("%03d", number))


def file_number(path: Column) -> Column:
    """The number at the end of a file's name before its extension, null if none."""
    return F.nullif(F.regexp_extract(path, r"(\d+)\.[A-Za-z0-9]+$", 1), F.lit("")).cast("int")
