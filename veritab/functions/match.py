"""Verdicts on expected values against normalized text, as Column expressions.

A verdict is a struct (raw_value, value, value_num, normalized_value,
confidence, status): value_num holds the number of an alcohol verdict, value
the text of the others. Status is found, partial or missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions import constants as C
from veritab.functions import text as T


def _verdict(raw, value, number, normalized, confidence, status) -> Column:
    as_string = lambda x: F.lit(None).cast("string") if x is None else x
    return F.struct(
        as_string(raw).alias("raw_value"), as_string(value).alias("value"),
        (F.lit(None) if number is None else number).cast("double").alias("value_num"), as_string(normalized).alias("normalized_value"),
        F.lit(confidence).cast("double").alias("confidence") if not isinstance(confidence, Column) else confidence.alias("confidence"),
        (status if isinstance(status, Column) else F.lit(status)).alias("status"),
    )


def nothing_expected() -> Column:
    return _verdict(None, None, None, None, None, "missing")


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _shown(known: Column, found: Column) -> tuple[Column, Column]:
    """Confidence and status: null confidence where nothing is expected."""
    return F.when(known, F.when(found, C.FOUND_CONFIDENCE).otherwise(0.0)), F.when(known & found, "found").otherwise("missing")


def match_alcohol(expected: Column, text: Column) -> Column:
    """The first percentage within tolerance is found; else the first one is reported as missing."""
    number = lambda raw: T.leading_number(raw).try_cast("double")
    asked = F.struct(expected.alias("expected"), T.expected_alcohol(expected).alias("want"), F.regexp_extract_all(text, F.lit(C.ALCOHOL_IN_TEXT), F.lit(0)).alias("raws"))

    def verdict(x: Column) -> Column:
        near = F.filter(x["raws"], lambda raw: F.abs(number(raw) - x["want"]) < C.ALCOHOL_TOLERANCE)
        return T.let(F.struct(_first(near).alias("hit"), F.when(x["want"].isNotNull(), _first(x["raws"])).alias("first")), lambda m: shown(x, m))

    def shown(x: Column, m: Column) -> Column:
        raw = F.coalesce(m["hit"], m["first"])
        return T.let(
            F.struct(raw.alias("raw"), F.coalesce(number(raw), x["want"]).alias("number")),
            lambda y: _verdict(y["raw"], F.when(x["want"].isNull(), x["expected"]), y["number"], y["number"].cast("string"), *_shown(x["expected"].isNotNull(), m["hit"].isNotNull())),
        )

    return T.let(asked, verdict)


def match_net(expected: Column, text: Column) -> Column:
    """The first quantity of the same canonical form is found; else the first one is reported as missing."""
    found = F.transform(F.regexp_extract_all(text, F.lit(C.NET_IN_TEXT), F.lit(0)), lambda raw: F.struct(raw.alias("raw"), T.quantity_form(raw).alias("form")))
    asked = F.struct(T.expected_net(expected).alias("want"), found.alias("found"))

    def verdict(x: Column) -> Column:
        known = x["want"].isNotNull()
        hit, first = _first(F.filter(x["found"], lambda m: m["form"] == x["want"])), _first(x["found"])
        return T.let(F.struct(hit.isNotNull().alias("is_hit"), F.when(known, F.coalesce(hit, first)).alias("m")), lambda y: (
            _verdict(y["m"]["raw"], F.coalesce(y["m"]["form"], x["want"]), None, F.coalesce(y["m"]["form"], x["want"]), *_shown(known, y["is_hit"]))
        ))

    return T.let(asked, verdict)


def _by_words(expected: Column, text: Column, contained, least: float) -> Column:
    """contained: from the normalized expected value and the text, whether it counts as found."""
    both = T.let(
        F.struct(expected.alias("expected"), T.normalize(expected).alias("want"), text.alias("text")),
        lambda x: F.struct(
            x["expected"].alias("expected"), x["want"].alias("want"), contained(x["want"], x["text"]).alias("is_in"),
            T.word_share(T.tokens(T.normalize_again(x["want"])), T.tokens(T.normalize_again(x["text"]))).alias("overlap"),
        ),
    )

    def verdict(x: Column) -> Column:
        known, value = x["expected"].isNotNull(), x["expected"]
        partial = x["overlap"] >= least
        return _verdict(
            F.when(x["is_in"] | partial, value), value, None, F.when(known, x["want"]),
            F.when(known, F.when(x["is_in"], C.FOUND_CONFIDENCE).when(partial, F.bround(x["overlap"], 3)).otherwise(0.0)),
            F.when(known & x["is_in"], "found").when(known & partial, "partial").otherwise("missing"),
        )

    return T.let(both, verdict)


def match_brand(expected: Column, text: Column) -> Column:
    """Contained in the text; a single short word must stand as a word. Else by the share of its words."""
    def contained(want: Column, inside: Column) -> Column:
        single = (want != "") & (F.char_length(want) < C.SHORT_BRAND) & ~F.contains(want, F.lit(" "))
        as_word = F.regexp_like(inside, F.concat(F.lit(r"\b\Q"), want, F.lit(r"\E\b")))
        return F.when(single, as_word).otherwise(F.contains(inside, want))

    return _by_words(expected, text, contained, C.BRAND_OVERLAP)


def match_text(expected: Column, text: Column) -> Column:
    return _by_words(expected, text, lambda want, inside: F.contains(inside, want), C.TEXT_OVERLAP)


def detect_warning(text: Column) -> Column:
    """A struct (status, confidence, groups_hit, matched_groups, matched_anchors) by groups of keywords."""
    words = [w for _, group in C.WARNING_GROUPS for w in group]
    anchors = F.array_remove(F.array(*[F.when(F.contains(text, F.lit(w)), w).otherwise("") for w in words]), "")

    def signals(x: Column) -> Column:
        has = lambda group: F.arrays_overlap(x["anchors"], F.array(*map(F.lit, group)))
        count = sum((has(group).cast("int") for _, group in C.WARNING_GROUPS), F.lit(0))
        return F.struct(x["anchors"].alias("anchors"), x["empty"].alias("empty"), count.alias("count"))

    def group_hits(x: Column, group: list[str]) -> Column:
        hits = F.array_intersect(F.array(*map(F.lit, group)), x["anchors"])
        return T.let(hits, lambda h: F.struct(h.alias("hits"), F.bround(F.size(h) / F.lit(len(group)), 3).alias("score")))

    def verdict(x: Column) -> Column:
        groups = F.map_from_arrays(F.array(*[F.lit(name) for name, _ in C.WARNING_GROUPS]), F.array(*[group_hits(x, group) for _, group in C.WARNING_GROUPS]))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<hits:array<string>,score:double>>"))
        return F.struct(
            F.when(x["count"] >= C.WARNING_FOUND, "found").when(x["count"] >= C.WARNING_PARTIAL, "partial").otherwise("missing").alias("status"),
            F.bround(x["count"] / F.lit(len(C.WARNING_GROUPS)), 3).alias("confidence"), x["count"].alias("groups_hit"),
            F.when(x["empty"], none).otherwise(groups).alias("matched_groups"), x["anchors"].alias("matched_anchors"),
        )

    return T.let(T.let(F.struct(anchors.alias("anchors"), (text == "").alias("empty")), signals), verdict)


def warnings_list(verdicts: dict[str, Column], warning: Column, required: Column) -> Column:
    """Codes in the fields' order, then the warning's if it is required."""
    of_field = [
        F.when(v["status"] == "missing", f"{name}_missing").when(v["status"] == "partial", f"{name}_partial_match")
        .when(v["confidence"] < C.LOW_CONFIDENCE, f"{name}_low_confidence")
        for name, v in verdicts.items()
    ]
    own = F.when(required & (warning["status"] == "missing"), "government_warning_missing").when(required & (warning["status"] == "partial"), "government_warning_partial")
    return F.array_compact(F.array(*of_field, own))


def needs_fallback(verdicts: dict[str, Column], warning: Column) -> Column:
    """Whether another attempt is worth it: a field is not found, or the warning is missing."""
    out = warning["status"] == "missing"
    for v in verdicts.values():
        out = out | (v["status"] != "found")
    return out


MATCHERS = {"brand_name": match_brand, "alcohol_content": match_alcohol, "net_contents": match_net}
