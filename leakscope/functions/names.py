"""Name rules: application junk, placement categories, creative names, identities."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.text import fold, strip, text_in


def app_junk_category(name: Column) -> Column:
    """Unresolved bundle, gaming or junk application; null for any other name."""
    n = strip(name)
    return (
        F.when(n.rlike(K.UNRESOLVED_APP), "Unresolved bundle")
        .when(n.rlike(K.GAMING_APP), "Gaming app")
        .when(n.rlike(K.JUNK_APP), "Junk app")
    )


def app_junk_reason(category: Column) -> Column:
    return (
        F.when(category == "Unresolved bundle", "unidentifiable app (raw bundle/ID)")
        .when(category == "Gaming app", "gaming inventory (block-by-default)")
        .when(category == "Junk app", "low-value utility/photo/junk app")
    )


def placement_category(name: Column) -> Column:
    """(category, concern) struct of a placement name by the first rule that matches."""
    n = strip(name)

    def verdict(category, concern):
        return F.struct(F.lit(category).alias("category"), F.lit(concern).alias("concern"))

    chain = F.when(F.coalesce(n, F.lit("")) == "", verdict(*K.BLANK_PLACEMENT_RULE))
    for category, concern, pattern in K.PLACEMENT_RULES:
        chain = chain.when(n.rlike(pattern), verdict(category, concern))
    return chain.otherwise(verdict(*K.OTHER_PLACEMENT_RULE))


def is_streaming_platform(name: Column) -> Column:
    low = F.coalesce(F.lower(name), F.lit(""))
    return reduce(lambda a, b: a | b, [low.contains(t) for t in K.STREAMING_PLATFORMS])


def blank_reason(name: Column) -> Column:
    """'empty', 'placeholder' or null (a usable creative name)."""
    s = F.coalesce(strip(name), F.lit(""))
    unnamed = s.rlike(K.UNNAMED_PREFIX) & (F.length(s) <= 24)
    return F.when(s == "", "empty").when(
        F.lower(s).isin(*K.PLACEHOLDER_NAMES) | unnamed | (F.length(s) <= 2), "placeholder"
    )


def split_name_id(value: Column) -> Column:
    """'Name (bundle.id)' -> struct(name, id); any other value is its own name and id."""
    v = strip(value)
    inner = strip(F.regexp_extract(v, K.COMPOSITE_ID, 2))
    outer = strip(F.regexp_extract(v, K.COMPOSITE_ID, 1))
    composite = v.rlike(K.COMPOSITE_ID) & (inner.contains(".") | inner.rlike(K.STORE_ID))
    name = F.when(composite, F.when(outer != "", outer).otherwise(inner)).otherwise(v)
    return F.struct(name.alias("name"), F.when(composite, inner).otherwise(v).alias("id"))


def looks_like_app(value: Column) -> Column:
    """Shape test: store ids, bare names, reverse-domain ids and unknown endings are apps."""
    v = F.coalesce(fold(value), F.lit(""))
    labels = F.split(v, r"\.")
    return (
        F.when(v.isin("", "nan", "none") | v.rlike(r"^(id)?\d{6,}$") | ~v.contains("."), True)
        .when((F.size(labels) >= 3) & F.get(labels, 0).isin(*K.BUNDLE_ROOTS), True)
        .otherwise(~F.element_at(labels, -1).isin(*K.SITE_TLDS))
    )


def family_name(name: Column) -> Column:
    """Display name without a platform suffix, the name a clone family shares."""
    return strip(F.regexp_replace(fold(name), K.PLATFORM_SUFFIX, ""))


def developer_prefix(app_id: Column) -> Column:
    """First two labels of a mobile bundle id; null for every other kind of id."""
    a = fold(app_id)
    return F.when(a.rlike(K.MOBILE_BUNDLE), F.substring_index(a, ".", 2))


def match_key(placement_type: Column, app_id: Column, placement: Column) -> Column:
    """Key that delivery and block list share: the app id, or the site's name."""
    return F.when(placement_type == "app", fold(app_id)).otherwise(fold(placement))


def display_name(placement: Column, app_id: Column) -> Column:
    """The placement's name, or its id where the name says nothing."""
    return F.when(text_in(placement, K.BLANK_PLACEMENTS), app_id).otherwise(placement)


def listed_name(placement_type: Column, placement: Column, app_id: Column) -> Column:
    """Name in block-list tables: apps read 'name - id' unless both are the same."""
    shown = display_name(placement, app_id)
    app = F.when(fold(shown) == fold(app_id), shown).otherwise(
        F.concat(shown, F.lit(" - "), app_id)
    )
    return F.when(placement_type == "app", app).otherwise(placement)


def is_combined_dsp(dsp: Column) -> Column:
    return F.coalesce(F.upper(dsp).rlike(K.DSP_MARKER), F.lit(False))


def known_products(product: Column) -> Column:
    """Aggregate: sorted, comma-separated known products of a group.

    One boolean per known product: the state of a group has a fixed size and stays in a hash
    aggregate, which a collected list would not.
    """
    names = sorted(K.PLACEMENT_PRODUCTS)
    return F.concat_ws(", ", *[F.when(F.bool_or(product == p), F.lit(p)) for p in names])


def category_flag(category: Column) -> Column:
    """'MFA + High CTR' -> 'Quality + High CTR': map every part, keep each flag once."""
    parts = F.filter(
        F.transform(F.split(F.coalesce(category, F.lit("")), r" \+ "), strip),
        lambda x: x != "",
    )
    flags = F.transform(
        parts,
        lambda x: F.when(x == K.HIGH_CTR_CATEGORY, "High CTR")
        .when(x == K.LOW_CTR_CATEGORY, "Low CTR")
        .otherwise("Quality"),
    )
    text = F.array_join(F.array_distinct(flags), " + ")
    return F.when(text == "", "Quality").otherwise(text)


