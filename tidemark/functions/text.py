"""Text and number cleaning as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the first numeric run of a text; a sign counts unless glued to a word or point.
NUMBER = r"(?U)(?:(?<![\w.])-)?(?:\d[\d,]*(?:\.\d+)?|\.\d+)"


def coerce_number(text: Column) -> Column:
    """First number in a text, thousands commas dropped; null where none or not finite."""
    found = F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit(""))
    value = F.regexp_replace(found, ",", "").try_cast("double")
    return F.when((value < float("inf")) & (value > float("-inf")), value)


def squeeze(text: Column) -> Column:
    """Runs of any Unicode blank as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def squeeze_xml(text: Column) -> Column:
    """Like XPath normalize-space: space, tab, CR and LF only, other blanks stay."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t\r\n]+", " "), r"^ | $", "")


def markdown_cell(value: Column) -> Column:
    """A value safe inside a Markdown table; null is empty."""
    v = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(v, r"\|", r"\\|"), "\n", " ")


def mermaid_text(text: Column) -> Column:
    """Text without what would end a label in a Mermaid diagram."""
    return F.translate(text, '"|`\n\r', "'/'  ")


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def short_id(state_id: Column, title: Column | None = None, length: int = 12) -> Column:
    """A state's title where it has one, else the head of its id."""
    head = F.substring(state_id, 1, length)
    return head if title is None else F.coalesce(F.nullif(title, F.lit("")), head)


def action_label(name: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("(unnamed)"))


def human_age(seconds: Column) -> Column:
    """An age as text, as "3 hours ago"; never negative."""
    s = F.greatest(seconds.cast("bigint"), F.lit(0))
    out = F.lit("just now")
    for unit, size in (("minute", 60), ("hour", 3600), ("day", 86400)):
        n = F.floor(s / size)
        out = F.when(s >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))).otherwise(out)
    return out


def ax_string(value: Column) -> Column:
    """The string of an accessibility value object given as JSON; "" where absent."""
    return F.coalesce(F.get_json_object(value, "$.value"), F.lit(""))


def locator(tag: Column, element_id: Column, classes: Column) -> Column:
    """A CSS locator suggestion: id, else tag with classes, else tag."""
    named = F.coalesce(element_id, F.lit("")) != ""
    classed = F.coalesce(F.size(classes), F.lit(0)) > 0
    return F.when(named, F.concat(F.lit("#"), element_id)).when(classed, F.concat(tag, F.lit("."), F.array_join(classes, "."))).otherwise(tag)
