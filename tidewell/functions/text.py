"""Scalar text functions: cleaning, numbers as written, dates, classifiers and keys. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūýÿñçšž"
PLAIN = "aaaaaaaeeeeeiiiiioooooouuuuuyyncsz"
# Month names and short forms, English and Indonesian, by number.
MONTHS = {
    1: ("january", "januari", "jan"), 2: ("february", "februari", "feb"), 3: ("march", "maret", "mar"), 4: ("april", "apr"), 5: ("may", "mei"), 6: ("june", "juni", "jun"),
    7: ("july", "juli", "jul"), 8: ("august", "agustus", "aug", "agu", "agt"), 9: ("september", "sep", "sept"), 10: ("october", "oktober", "oct", "okt"), 11: ("november", "nov"), 12: ("december", "desember", "dec", "des"),
}


def clean(value: Column | str) -> Column:
    """Without white space, no-break spaces included, at either end."""
    c = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def collapse(value: Column | str) -> Column:
    """Single spaces, none at the ends."""
    c = F.col(value) if isinstance(value, str) else value
    return F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))


def fold(value: Column | str) -> Column:
    """Lower case without accents."""
    c = F.col(value) if isinstance(value, str) else value
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\p{M}", "")


def slug(value: Column | str) -> Column:
    """Folded letters and digits with single underscores between them."""
    return F.regexp_replace(F.regexp_replace(fold(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def loader_number(value: Column | str) -> Column:
    """A single comma without a point is a decimal comma, other commas are thousands; null if unreadable."""
    c = collapse(value)
    one = c.rlike(r"^[^,.]*,[^,.]*$")
    return _double(F.when(one, F.regexp_replace(c, ",", ".")).otherwise(F.regexp_replace(c, ",", "")))


def _double(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text).cast("double")


def table_number(value: Column | str) -> Column:
    """The last separator is the decimal mark if both kinds occur or it is followed by other than three digits; null if unreadable.

    Percent signs and spaces are dropped; a lone separator before exactly three digits parts thousands.
    """
    c = F.regexp_replace(collapse(value), r"[%\s\u00a0]", "")
    ok = c.rlike(r"^[+-]?\d[\d.,]*$")
    last_comma, last_point = F.length(c) - F.length(F.substring_index(c, ",", -1)), F.length(c) - F.length(F.substring_index(c, ".", -1))
    comma, point = c.contains(","), c.contains(".")
    european = comma & (~point | (last_comma > last_point))
    decimal = (comma & point) | (european & ~c.rlike(r"^[+-]?\d{1,3}(,\d{3})+$")) | (point & ~comma & ~c.rlike(r"^[+-]?\d{1,3}(\.\d{3})+$"))
    whole = F.regexp_replace(c, "[.,]", "")
    mark = F.when(european, F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(c, ",", ""))
    return F.when(ok, _double(F.when(decimal, mark).otherwise(whole)))


def portal_number(value: Column | str) -> Column:
    """Whole number with points or commas between thousands; 'nihil' is 0; null if unreadable."""
    c = F.lower(clean(value))
    return F.when(c == "nihil", F.lit(0).cast("long")).when(c.rlike(r"^[\d.,]+$") & c.rlike(r"\d"), F.regexp_replace(c, r"[.,]", "")).cast("long")


def digits(value: Column | str) -> Column:
    """The digits of a text as one number; null if there are none or more than eighteen."""
    c = F.regexp_replace(F.col(value) if isinstance(value, str) else value, r"\D", "")
    return F.when(c.rlike(r"^\d{1,18}$"), c).cast("long")


def year(value: Column | str) -> Column:
    """First year from 1900 to 2099 in a text; null if there is none."""
    c = F.col(value) if isinstance(value, str) else value
    y = F.regexp_extract(c, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return F.when(y != "", y).cast("int")


def month(value: Column | str) -> Column:
    """Number of the first month name in a text; null if there is none."""
    names = {name: n for n, several in MONTHS.items() for name in several}
    pattern = r"(?i)\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b"
    word = F.lower(F.regexp_extract(F.col(value) if isinstance(value, str) else value, pattern, 1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.when(word != "", word))


def iso_week_start(year_: Column, week: Column) -> Column:
    """Monday of an ISO week."""
    return F.date_add(F.date_trunc("week", F.make_date(year_, F.lit(1), F.lit(4))).cast("date"), (F.lit(7) * (week - 1)).cast("int"))


def first_match(value: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first pattern that a text matches."""
    out = None
    for label, pattern in rules:
        out = F.when(value.rlike(pattern), label) if out is None else out.when(value.rlike(pattern), label)
    return out.otherwise(otherwise)


def tags(value: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all patterns that a text matches, joined by '; '; empty if none."""
    return F.array_join(F.filter(F.array(*[F.when(value.rlike(p), label) for label, p in rules]), lambda x: x.isNotNull()), "; ")


def stable_id(prefix: str, columns: list[str]) -> Column:
    """prefix and the first 24 hex digits of the SHA-256 of the columns as JSON; nulls are part of the identity."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, 24))
