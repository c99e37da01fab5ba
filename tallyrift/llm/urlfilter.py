"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Null urls and urls without ``://`` have an empty host and an empty path. An empty path starts
with no rule path but the empty one. Repeated rows are judged one by one; an empty table gives
no rows. Only the columns named are read, so further columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    id_cols: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    hash_chars: int = 8,
) -> DataFrame:
    """``id_cols``, host, path, rule, verdict: one row for each row of ``pages``.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the url's path
    starts with the rule's. The longest rule (host and path together) wins, then the one with
    the longer host, then ``block``.

    Each url is expanded into the suffixes of its host (no more labels than some rule has) times
    the prefixes of its path that end in a slash (no more slashes than some rule has). Rules are
    keyed by their host and by their path up to its last slash; the join is on the first
    ``hash_chars`` hex digits of that expression's SHA-256, and the full digest and the rest of
    the rule's path are confirmed afterwards. Both limits are read from the rules, so that no fit
    is lost. Rules are broadcast only if Spark's size threshold allows; else the join is by sort.
    """
    keyed = rules.select(
        F.translate("host", UPPER, LOWER).alias("_r_host"),
        F.col("path").alias("_r_path"),
        F.col("verdict").alias("_r_verdict"),
    ).where("_r_host is not null and _r_path is not null").withColumn(
        "_r_key", F.concat("_r_host", F.regexp_extract("_r_path", r"^(.*/)?", 1))
    ).withColumn("_r_digest", F.sha2("_r_key", 256)).withColumn("_r_hash", F.substring("_r_digest", 1, hash_chars))
    labels = F.size(F.split("_r_host", r"\.", -1))
    slashes = F.length("_r_path") - F.length(F.replace(F.col("_r_path"), F.lit("/")))
    most_labels, least_slashes, most_slashes = keyed.agg(
        F.coalesce(F.max(labels), F.lit(0)), F.coalesce(F.min(slashes), F.lit(0)), F.coalesce(F.max(slashes), F.lit(-1))
    ).first()

    base = pages.select(
        *[F.col(f"`{c}`") for c in id_cols],
        url_host(F.col(f"`{url_col}`")).alias("_host"),
        url_path(F.col(f"`{url_col}`")).alias("_path"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = base.withColumns({"_labels": F.split("_host", r"\.", -1), "_parts": F.split("_path", "/", -1)})
    n, m = F.size("_labels"), F.size("_parts") - 1
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(max(most_labels, 1)))),
        lambda k: F.array_join(F.slice("_labels", n - k + 1, k), "."),
    )
    upto = F.least(m, F.lit(most_slashes))
    prefixes = F.when(upto >= least_slashes, F.transform(
        F.sequence(F.lit(least_slashes), upto),
        lambda k: F.when(k > 0, F.concat(F.array_join(F.slice("_parts", 1, k), "/"), F.lit("/"))).otherwise(F.lit("")),
    )).otherwise(F.array().cast("array<string>"))
    wide = base.withColumn("_suffix", F.explode_outer(suffixes)).withColumn("_prefix", F.explode_outer(prefixes))
    wide = wide.withColumn("_digest", F.sha2(F.concat("_suffix", "_prefix"), 256))
    wide = wide.withColumn("_hash", F.substring("_digest", 1, hash_chars))
    fits = (
        (F.col("_hash") == F.col("_r_hash"))
        & (F.col("_digest") == F.col("_r_digest"))
        & F.col("_path").startswith(F.col("_r_path"))
    )
    found = F.struct(
        (F.length("_r_host") + F.length("_r_path")).alias("size"),
        F.length("_r_host").alias("host_size"),
        (F.col("_r_verdict") == "block").alias("blocks"),
        F.concat("_r_host", "_r_path").alias("rule"),
        F.col("_r_verdict").alias("verdict"),
    )
    return (
        wide.join(keyed, fits, "left")
        .groupBy("_row", *[F.col(f"`{c}`") for c in id_cols], "_host", "_path")
        .agg(F.max(F.when(F.col("_r_host").isNotNull(), found)).alias("_best"))
        .select(
            *[F.col(f"`{c}`") for c in id_cols],
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.col("_best.rule").alias("rule"),
            F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        )
    )
