"""URL filter: explicit rules first, then a likelihood ratio of two character models.

Two variable-order Markov models, one of accepted and one of rejected urls, give each character a
probability from the counts of the contexts before it (up to four characters), each order smoothed
towards the next shorter one by the number of different characters seen behind the context
(Witten-Bell). A url's score is the mean log ratio of its characters; the threshold is calibrated
on urls that the counts leave out.

The models work on url shapes: host and path with each run of digits as one 0. Each distinct shape
is counted and scored once, so a host with a third of all urls costs as much as any other. All
steps are joins and aggregates of built-in expressions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import broadcast_if_small, written

ORDER = 5  # longest gram: a character and four before it
ALPHABET = 128  # characters that an unseen context may be followed by

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of host names that mark a url as an example of the rejected class.
REJECTED_WORDS = (
    "ad adult ads adserver affiliate bet bets betting bingo casino cheap-pills clickbait dating "
    "escort escorts gambling hentai jackpot loan loans lottery nude pharmacy phishing pills poker "
    "porn sex slots spam spyware torrent track tracker tracking viagra warez webcam xxx"
).split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"

    def part(i):
        return F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))

    return F.translate(part(1), UPPER, LOWER), part(2)


def by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is a host with a path: it fits that host and its subdomains if the path starts alike.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest ends outermost
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shape(host: Column, path: Column) -> Column:
    return F.regexp_replace(F.concat(host, path), "[0-9]+", "0")


def rejected_by_words(host: Column, words: list[str] = REJECTED_WORDS) -> Column:
    """Whether a label of the host, or a part of it between hyphens, is one of the words."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in words]))


def _grams(shapes: DataFrame, *keep: str) -> DataFrame:
    """All grams up to the longest order of each shape between a start and an end mark."""
    marked = F.concat(F.lit("\x02"), F.col("shape"), F.lit("\x03"))
    return (
        shapes.select(*keep, marked.alias("t"))
        .select(*keep, "t", F.explode(F.sequence(F.lit(2), F.length("t"))).alias("i"))
        .select(*keep, "t", "i", F.explode(F.array(*[F.lit(k) for k in range(1, ORDER + 1)]))
                .alias("k"))
        .where("k <= i")
        .select(*keep, "i", "k", F.expr("substring(t, i - k + 1, k)").alias("gram"))
    )


def _model(shapes: DataFrame) -> DataFrame:
    """(gram, ratio): log probability of its last character, rejected minus accepted.

    `shapes` has shape, rejected and train; each distinct shape counts once, and only those with
    `train` are counted. Every gram of every shape gets a row.
    """
    kinds = ("a", "r")
    counted = written(
        _grams(shapes, "rejected", "train").groupBy("k", "gram").agg(
            F.count_if(F.col("train") & ~F.col("rejected")).alias("a"),
            F.count_if(F.col("train") & F.col("rejected")).alias("r")),
        "url-grams")
    contexts = counted.groupBy(
        F.expr("substring(gram, 1, k - 1)").alias("context"), "k").agg(
        *[F.sum(c).alias(f"n_{c}") for c in kinds],
        *[F.count_if(F.col(c) > 0).alias(f"d_{c}") for c in kinds])
    rows = counted.withColumns({
        "context": F.expr("substring(gram, 1, k - 1)"), "suffix": F.expr("substring(gram, 2)"),
    }).join(contexts, ["context", "k"])
    rows = written(rows, "url-contexts")
    shorter = None
    out = None
    for k in range(1, ORDER + 1):
        level = rows.where(F.col("k") == k)
        if shorter is None:
            level = level.withColumns({f"q_{c}": F.lit(1.0 / ALPHABET) for c in kinds})
        else:
            level = level.join(
                shorter.select(F.col("gram").alias("suffix"),
                               *[F.col(f"p_{c}").alias(f"q_{c}") for c in kinds]), "suffix")
        level = level.select("gram", *[
            F.when(F.col(f"n_{c}") == 0, F.col(f"q_{c}")).otherwise(
                (F.col(c) + F.col(f"d_{c}") * F.col(f"q_{c}"))
                / (F.col(f"n_{c}") + F.col(f"d_{c}"))).alias(f"p_{c}") for c in kinds])
        shorter = written(level, "url-level") if k < ORDER else level
        out = shorter if out is None else out.union(shorter)
    return out.select("gram", (F.log("p_r") - F.log("p_a")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Score that best tells the classes of held-out shapes apart; 0 if one class is missing.

    The scores are counted in 2,001 steps of 0.005, so the figures looked at stay as few at any
    size of the input.
    """
    step = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("score") / 0.005)))
    counts = scored.where("not train").groupBy(step.cast("int").alias("s")).agg(
        F.count_if("rejected").alias("r"), F.count_if(~F.col("rejected")).alias("a")
    ).orderBy("s").collect()
    rejected, accepted = sum(x["r"] for x in counts), sum(x["a"] for x in counts)
    if not rejected or not accepted:
        return 0.0
    best, low, high, r, a = -1.0, 0, 0, rejected, 0
    for before, x in zip([None, *counts], [*counts, None]):
        # cut between two neighbouring steps: all from x upwards is rejected
        gain = r / rejected + a / accepted
        edge = x["s"] if x else before["s"] + 1
        if gain > best + 1e-12:
            best, low, high = gain, (before["s"] + 1 if before else edge), edge
        if x:
            r, a = r - x["r"], a + x["a"]
    return 0.005 * (low + high) / 2


def judge(urls: DataFrame, rules: list[tuple[str, str]],
          rejected: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of `urls` (columns page_id, url).

    verdict is that of the longest fitting rule, else `block` if the score reaches the calibrated
    threshold, else `allow`. `rejected` is a condition on the column `host` that marks examples of
    the rejected class (default: the fixed words); all other urls are examples of accepted ones. A
    fifth of the shapes, by hash, is left out of the counts and calibrates the threshold.

    Null urls and urls without a host and path have no score and are allowed unless a rule fits.
    Null page ids and repeated rows are kept. Without an example of one class the threshold is 0.
    """
    host, path = host_and_path(F.col("url"))
    parsed = urls.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "host", "path", rule.alias("rule"),
                           verdict.alias("ruled"), shape(F.col("host"), F.col("path")).alias("shape"))
    label = rejected_by_words(F.col("host")) if rejected is None else rejected
    shapes = written(
        parsed.where("shape != ''").groupBy("shape").agg(
            F.max(F.coalesce(label, F.lit(False))).alias("rejected"))
        .withColumn("train", F.pmod(F.xxhash64("shape"), F.lit(5)) != 0), "url-shapes")
    model = _model(shapes)
    longest = _grams(shapes, "shape").where(F.col("k") == F.least(F.col("i"), F.lit(ORDER)))
    scores = longest.join(model, "gram").groupBy("shape").agg(F.avg("ratio").alias("score"))
    scored = written(shapes.join(scores, "shape"), "url-scores")
    threshold = _threshold(scored)
    return parsed.join(
        broadcast_if_small(scored.select("shape", "score"), 200_000), "shape", "left"
    ).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
        .alias("verdict"), "score")
