"""Text functions as Catalyst expressions: sections, phrases, names, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with marks and their ASCII letters, position by position.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"

#: Literal replacements of question texts, in order.
QUESTION_PARTS = (
    ("Does the note mention that the patient", "Does the note mention the patient"),
    ("Does the note mention ", ""),
    ("that the patient ", ""),
    ("the patient ", ""),
    ("engaging in ", ""),
    ("experiencing ", ""),
    ("having a ", ""),
    ("having ", ""),
    ("undergoing ", ""),
    ("requiring ", ""),
    ("needing ", ""),
    ("?", ""),
)


def sections(df: DataFrame, text: str, limit: int | None, keep: list[str]) -> DataFrame:
    """Rows of `keep` with section_id and section: slices of `limit` code points
    without overlap; one section where the text is no longer (also if empty)."""
    return df.select(*keep, F.posexplode(section_array(F.col(text), limit)).alias("section_id", "section"))


def section_array(text: Column, limit: int | None) -> Column:
    if limit is None:
        return F.array(text)
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(limit))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(limit)))


def fold(text: Column) -> Column:
    """Lower case, without marks and other non-ASCII characters."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"[^\x00-\x7F]", "")


def comma_tokens(text: Column) -> Column:
    """Comma phrases, trimmed and lower-cased; empty ones stay."""
    return F.transform(F.split(text, ",", -1), lambda x: F.lower(F.trim(x)))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Literal replacement of {name}, one after another."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def numbered(items: Column) -> Column:
    """'1 - first' lines, one per item."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(" - "), x, F.lit("\n"))), "")


def starred(items: Column) -> Column:
    """'* X0 = first' lines, one per item."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("* X"), i.cast("string"), F.lit(" = "), x, F.lit(" \n"))), "")


def fixed(x: Column, places: int) -> Column:
    """As Python's '%.{places}f' and C's printf: a double's exact binary value decides, exact ties go to the even
    digit. `format_string`, which rounds the shortest decimal form and ties away from 0, gives what is small and
    not near a tie; from 2**53 on and for NaN its text stays."""
    size, scale = F.abs(x), float(10**places)
    whole = F.floor(size)
    part = size - whole
    near = part * scale
    # the product's rounding error, exactly: halves of the factor times the scale have no error
    high = part * 134217729.0 - (part * 134217729.0 - part)
    lost = (high * scale - near) + (part - high) * scale
    off = near - F.rint(near)
    up = F.when((off == 0.5) & (lost > 0), 1).when((off == -0.5) & (lost < 0), -1).otherwise(0)
    units = F.rint(near).cast("long") + up
    carried = whole + F.when(units == int(scale), 1).otherwise(0)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    text = F.concat(sign, carried.cast("string"), F.lit("."), F.lpad((units % int(scale)).cast("string"), places, "0"))
    exactly = (size < 2.0**53) & ((size > 1e9) | (F.abs(near - F.floor(near) - 0.5) < 1e-6))
    return F.when(x.isNull(), None).when(exactly, text).otherwise(F.format_string(f"%.{places}f", x))


def coefficient_lines(rows: Column) -> Column:
    """CSV text of array<struct<feature, coef>>, scaled by the largest size if that is not 0; null with a null in it."""
    top = F.array_max(F.transform(rows, lambda r: F.abs(r["coef"])))
    scale = F.when(top > 0, top).otherwise(1.0)
    lines = F.transform(rows, lambda r: F.concat(r["feature"], F.lit(","), fixed(r["coef"] / scale, 3)))
    whole = F.forall(rows, lambda r: r["feature"].isNotNull() & r["coef"].isNotNull())
    return F.when(whole, F.concat(F.lit("feature,coef\n"), F.array_join(lines, "\n")))


def clean_concept(name: Column) -> Column:
    for old, new in QUESTION_PARTS:
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def display_name(name: Column) -> Column:
    """Underscores and dashes to spaces, words capitalised."""
    return F.initcap(F.trim(F.regexp_replace(name, r"[_\-]+", " ")))


def normalized_concept(name: Column) -> Column:
    """For comparison: lower case, letters and digits apart by single spaces."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "))


def value_type(question: Column) -> Column:
    """With a bound (> or ≥): a duration if an h or a d (hours, days) occurs, else a count."""
    bound = question.contains(">") | question.contains("≥")
    period = question.contains("h") | question.contains("d")
    return F.when(bound & period, "duration_days").when(bound, "count").otherwise("binary")


def clip(p: Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = 1e-15) -> Column:
    q = clip(p, eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inject(prompt: Column, section: Column, anchor: str) -> Column:
    """The section before the anchor, or at the end where there is none."""
    mark = F.lit(anchor)
    with_it = F.replace(prompt, mark, F.concat(section, F.lit("\n"), mark))
    return F.when(prompt.contains(anchor), with_it).otherwise(F.concat(prompt, F.lit("\n"), section))
