"""Creative sizes and URL tags."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions import constants as K
from leakscope.functions.text import fold, is_blank


def sizes_in(name: Column) -> Column:
    """Array of every WxH token of a name, written as '300x250'."""
    tokens = F.regexp_extract_all(name, F.lit(K.SIZE_TOKEN), F.lit(0))
    return F.coalesce(
        F.transform(tokens, lambda t: F.regexp_replace(t, r"\s?[xX×]\s?", "x")),
        F.array().cast("array<string>"),
    )


def first_size(name: Column) -> Column:
    """First WxH token of a name, or null."""
    width = F.regexp_extract(name, K.SIZE_TOKEN, 1)
    height = F.regexp_extract(name, K.SIZE_TOKEN, 2)
    return F.when(F.length(width) > 0, F.concat(width, F.lit("x"), height))


def size_family(size: Column) -> Column:
    """Planning label of a WxH size."""
    sides = F.split(F.lower(size), "x")
    w = F.get(sides, 0).try_cast("int")
    h = F.get(sides, 1).try_cast("int")
    shape = F.when(h != 0, w.cast("double") / h.cast("double")).otherwise(F.lit(0.0))
    return (
        F.when(w.isNull() | h.isNull(), "unknown")
        .when(size.isin(*K.BANNER_SIZES), "IAB display")
        .when(size.isin(*K.SOCIAL_SIZES), "social native")
        .when(shape >= 1.6, "landscape/video")
        .when(shape <= 0.7, "vertical/story")
        .otherwise("square-ish")
    )


def url_or_empty(url: Column) -> Column:
    return F.when(is_blank(url), "").otherwise(url)


def keys_present(url: Column, keys: list[str]) -> Column:
    """Comma-separated tracking keys that occur as 'key=' anywhere in the URL."""
    u = F.coalesce(fold(url), F.lit(""))
    return F.concat_ws(", ", *[F.when(u.contains(f"{k}="), F.lit(k)) for k in keys])


def key_count(url: Column, keys: list[str]) -> Column:
    u = F.coalesce(fold(url), F.lit(""))
    return sum((u.contains(f"{k}=").cast("int") for k in keys), F.lit(0))


def with_tags(df, url: str = "url"):
    """Add utm_params, utm_count, other_tracking and the four-way status of a URL column."""
    u = F.col(url)
    return df.withColumns(
        {
            "utm_params": keys_present(u, K.UTM_KEYS),
            "utm_count": key_count(u, K.UTM_KEYS),
            "other_tracking": keys_present(u, K.OTHER_TRACKING_KEYS),
            "status": utm_status(u),
        }
    )


def utm_status(url: Column) -> Column:
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "no clickthrough URL")
        .when(key_count(url, K.UTM_KEYS) == 0, "no UTM codes")
        .when(key_count(url, K.UTM_CORE) == len(K.UTM_CORE), "fully tagged")
        .otherwise("partially tagged")
    )


def site_domain(value: Column) -> Column:
    """Domain in matching form: no scheme, path, query, leading 'www.' or trailing dot."""
    s = F.regexp_replace(fold(value), r"^[a-z]+://", "")
    s = F.substring_index(F.substring_index(s, "/", 1), "?", 1)
    return F.rtrim(F.regexp_replace(s, r"^www\.", ""), F.lit("."))
