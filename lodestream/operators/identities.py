"""Which of a list of companies an identity belongs to, by the owners and hosts that it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Companies in the order they are tried, with their labels, owner names and hosts.
COMPANIES = (
    ("Anthropic", ("anthropic", "anthropics", "anthropic-ai"), ("anthropic.com",)),
    ("OpenAI", ("openai",), ("openai.com",)),
    ("Google", ("google", "google-deepmind", "googledeepmind", "google-research", "googleapis"), ("google.com", "deepmind.google", "ai.google")),
    ("Microsoft", ("microsoft", "microsoftresearch"), ("microsoft.com", "azure.microsoft.com")),
    ("NVIDIA", ("nvidia", "nvlabs"), ("nvidia.com", "developer.nvidia.com", "research.nvidia.com")),
)


def companies(spark: SparkSession) -> DataFrame:
    """place, label, kind ("owner" or "host"), value: the list above as a table; longer lists have the same columns."""
    rows = [
        (i, label, kind, v) for i, (label, owners, hosts) in enumerate(COMPANIES) for kind,
        values in (("owner", owners), ("host", hosts)) for v in values
    ]
    return spark.createDataFrame(rows, "place int, label string, kind string, value string")


def _owner(value: Column) -> Column:
    """The owner that a key, link or name names, if any."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    to_slash = lambda c: F.substring_index(c, "/", 1)
    found = (
        F.when(v.startswith("github:"), to_slash(F.substring(v, 8, 1 << 30)))
        .when(v.contains("github.com/"), F.regexp_extract(v, r"github\.com/([^/]*)", 1))
        .when(v.startswith("npm:@"), to_slash(F.substring(v, 6, 1 << 30)))
        .when(v.startswith("@"), to_slash(F.substring(v, 2, 1 << 30)))
        .when(v.contains("/"), to_slash(v))
    )
    bare = F.btrim(F.trim(found), F.lit("@"))
    return F.when(F.trim(found) != "", bare)


def owners(name: Column, key: Column, link: Column) -> Column:
    """Distinct owners that an identity's name, key and link name."""
    return F.array_distinct(F.array_compact(F.array(_owner(name), _owner(key), _owner(link))))


def hosts(link: Column) -> Column:
    """The host of a web link and its suffixes of two and three labels, without a leading ``www.``."""
    v = F.lower(F.trim(F.coalesce(link, F.lit(""))))
    place = F.regexp_replace(F.regexp_extract(v, "^https?://([^/?#]*)", 1), "^.*@", "")
    host = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)", 1)).otherwise(F.substring_index(place, ":", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    labels = F.size(F.split(host, r"\."))
    suffixes = F.array(host, F.when(labels >= 2, F.substring_index(host, ".", -2)), F.when(labels >= 3, F.substring_index(host, ".", -3)))
    return F.when(
        v.rlike("^https?://") & (host != ""), F.array_distinct(F.array_compact(suffixes))
    ).otherwise(F.array().cast("array<string>"))


def company_of(
    rows: DataFrame, known: DataFrame, ident: str, name: str = "canonical_name", key: str = "canonical_key", link: str = "canonical_link"
) -> DataFrame:
    """ident, company: the first company, in declared order, of whose owners or hosts an identity names one; empty if none.

    What an identity names is exploded, so it meets a list of any length by equality.
    """
    kind = lambda k, values: F.transform(values, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    named = F.concat(kind("owner", owners(F.col(name), F.col(key), F.col(link))), kind("host", hosts(F.col(link))))
    each = rows.select(F.col(ident).alias("_id"), F.explode(named).alias("n")).select("_id", "n.kind", "n.value")
    first = each.join(known, ["kind", "value"]).groupBy("_id").agg(F.min(F.struct("place", "label"))["label"].alias("company"))
    return rows.select(ident).join(first, F.col(ident) == F.col("_id"), "left").select(
        ident, F.coalesce("company", F.lit("")).alias("company")
    )
