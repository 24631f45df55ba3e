"""Text normalization and canonical quantities, as Column expressions.

Each function is built from built-in expressions only and can be pushed wherever
Catalyst wants it. A value that an expression needs more than once is bound by
let(), so plans grow in proportion to what is written here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions import constants as C


#: What numbers and the blanks after them are made of.
DIGITS, BLANKS = "0123456789.", " \t\n\r\f\x0b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it.

    Catalyst copies an expression into every place that names it when it merges
    projections or pushes filters down; a lambda's variable is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _respelt(text: Column) -> Column:
    for found, instead in C.REPLACEMENTS:
        text = F.replace(text, F.lit(found), F.lit(instead))
    return text


def normalize(text: Column) -> Column:
    """Lower case, canonical unit spellings, other characters blanked, blanks collapsed; null gives ''."""
    return F.trim(F.regexp_replace(_respelt(F.lower(F.coalesce(text, F.lit("")))), C.BLANKED, " "))


def normalize_again(normalized: Column) -> Column:
    """normalize() of what normalize() gave: only spellings that blanked characters have hidden can change."""
    return _respelt(normalized)


def tokens(normalized: Column) -> Column:
    """Distinct words of normalized text; none for empty text."""
    return F.array_remove(F.array_distinct(F.split(normalized, " ")), "")


def token_overlap(expected: Column, text: Column) -> Column:
    """The share of expected's words that text has; both are normalized here, once more if they already were."""
    return word_share(tokens(normalize(expected)), tokens(normalize(text)))


def word_share(expected: Column, words: Column) -> Column:
    """The share of the expected words (an array of distinct ones) among words; 0 if either has none."""
    both = F.struct(expected.alias("a"), words.alias("b"))
    return let(both, lambda x: F.when((F.size(x["a"]) > 0) & (F.size(x["b"]) > 0), F.size(F.array_intersect(x["a"], x["b"])) / F.size(x["a"])).otherwise(F.lit(0.0)))


def canonical_number(quantity: Column) -> Column:
    """'750.0' and '0750' give '750', '1.50' gives '1.5'; what is no number is trimmed."""
    def written(x: Column) -> Column:
        d = x["d"]
        plain = F.when(d == F.floor(d), d.cast("decimal(38,0)").cast("string"))
        far = (d >= 1e7) | (d < 1e-3)  # doubles that would be printed with an exponent
        short = F.rtrim(d.cast("decimal(38,12)").cast("string"), F.lit("0"))
        return F.when(d.isNull(), F.trim(x["q"])).otherwise(F.coalesce(plain, F.when(far, short).otherwise(d.cast("string"))))

    return let(F.struct(quantity.alias("q"), quantity.try_cast("double").alias("d")), written)


def unit_form(unit: Column) -> Column:
    """ml, l, cl, and oz for all other units; unit is normalized."""
    return let(unit, lambda n: (
        F.when(F.contains(n, F.lit("millil")) | (n == "ml"), "ml")
        .when(F.contains(n, F.lit("liter")) | (n == "l"), "l")
        .when(n == "cl", "cl").otherwise("oz")
    ))


def canonical_quantity(quantity: Column, unit: Column) -> Column:
    """'750' and 'ml' give '750ml'; units are ml, l, cl, and oz for all others."""
    return F.concat(canonical_number(quantity), unit_form(normalize(unit)))


def leading_number(raw: Column) -> Column:
    """The digits and points that a match begins with."""
    return F.left(raw, F.char_length(raw) - F.char_length(F.ltrim(raw, F.lit(DIGITS))))


def quantity_form(raw: Column) -> Column:
    """The canonical form of a number and a normalized unit as they were matched in one piece."""
    return F.concat(canonical_number(leading_number(raw)), unit_form(F.ltrim(raw, F.lit(DIGITS + BLANKS))))


def expected_alcohol(value: Column) -> Column:
    """The first number of the text as it stands, as a double; null without one."""
    return F.nullif(F.regexp_extract(value, C.NUMBER, 1), F.lit("")).try_cast("double")


def expected_net(value: Column) -> Column:
    """The canonical quantity, else the normalized text; null stays null."""
    def form(x: Column) -> Column:
        return F.when(x["raw"] == "", x["n"]).otherwise(quantity_form(x["raw"]))

    matched = let(normalize(value), lambda n: F.struct(n.alias("n"), F.regexp_extract(n, C.NET_EXPECTED, 0).alias("raw")))
    return F.when(value.isNotNull(), let(matched, form))


def page_net_contents(value: Column) -> Column:
    """Net contents of a detail page: quantity as written and unit, else the trimmed text; null gives ''."""
    low = F.lower(F.trim(value))
    quantity, unit = F.regexp_extract(low, C.NET_ON_PAGE, 1), F.regexp_extract(low, C.NET_ON_PAGE, 2)
    short = (
        F.when(F.contains(unit, F.lit("millil")) | (unit == "ml"), "ml")
        .when(F.contains(unit, F.lit("liter")) | (unit == "l"), "l")
        .when(F.contains(unit, F.lit("oz")) | F.contains(unit, F.lit("ounce")), "oz")
    )
    return F.coalesce(F.when((quantity != "") & short.isNotNull(), F.concat(quantity, short)).otherwise(F.trim(value)), F.lit(""))


def page_alcohol(value: Column) -> Column:
    """The first number's text, else the trimmed text; null gives ''."""
    number = F.regexp_extract(value, C.NUMBER, 1)
    return F.coalesce(F.when(number != "", number).otherwise(F.trim(value)), F.lit(""))


def clean_label(label: Column) -> Column:
    """'8a. Brand  Name (Required)' gives 'BRAND NAME'."""
    out = F.trim(F.regexp_replace(label, r"^\d+[a-z]?\.\s*", ""))
    out = F.trim(F.regexp_replace(out, r"\s*\(.*?\)\s*", " "))
    return F.trim(F.upper(F.regexp_replace(out, r"\s+", " ")))


def clean_id(value: Column) -> Column:
    """Without blanks and then quotes around it."""
    return F.regexp_replace(F.trim(value), "^['\"]+|['\"]+$", "")


def file_suffix(name: Column, default: str = ".jpg") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"[^/.](\.[^./]*)$", 1), F.lit("")), F.lit(default))


def attachment_url(base: str, src: Column) -> Column:
    """An absolute URL with blanks escaped."""
    joined = F.when(src.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), src).when(src.startswith("//"), F.concat(F.lit(base.split("//")[0]), src)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(F.regexp_replace(src, "^/+", ""))))
    return F.replace(joined, F.lit(" "), F.lit("%20"))


def attachment_extension(content_type: Column, url: Column) -> Column:
    """By content type, else the URL's own suffix, else .jpg."""
    known = F.create_map(*[F.lit(x) for pair in C.EXTENSIONS.items() for x in pair])
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    own = F.lower(F.regexp_extract(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)), r"[^/](\.[^./]+)$", 1))
    return F.coalesce(F.try_element_at(known, kind), F.nullif(own, F.lit("")), F.lit(".jpg"))


def is_upload_type(content_type: Column) -> Column:
    """Whether an uploaded file's type is one that is accepted; a missing type is not."""
    return F.coalesce(content_type.isin(*C.UPLOAD_TYPES), F.lit(False))


def is_captcha(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(C.CAPTCHA_EXACT)) | F.contains(F.lower(text), F.lit(C.CAPTCHA_LOWER)), F.lit(False))


def escape_html(text: Column) -> Column:
    out = text
    for found, instead in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(found), F.lit(instead))
    return out
