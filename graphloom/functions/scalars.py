"""Column expressions: similarity, names, hashes, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for another dimension or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def jaccard(a: Column, b: Column) -> Column:
    """Both empty 1, one empty 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def attribute_similarity(a: Column, b: Column) -> Column:
    """Share of keys of both maps that hold equal values; 1 without keys."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    same = F.size(F.filter(keys, lambda k: F.coalesce(F.element_at(a, k) == F.element_at(b, k), F.lit(False))))
    return F.when(F.size(keys) == 0, 1.0).otherwise(same / F.size(keys))


def normalize_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def scoped_id(name: Column, repository: Column, namespace: Column) -> Column:
    """repository::namespace::name, or the bare name if both others are empty."""
    r, n = F.coalesce(repository, F.lit("")), F.coalesce(namespace, F.lit(""))
    return F.when((r == "") & (n == ""), name).otherwise(F.concat_ws("::", r, n, name))


def service_id(path: Column) -> Column:
    """The parent folder, scoped by what is above it; a bare file gives its base name."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    n = F.size(parts)
    space = F.array_join(F.slice(parts, 1, F.greatest(n - 2, F.lit(0))), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    return F.when(n >= 2, scoped_id(F.try_element_at(parts, F.lit(-2)), F.lit(""), space)).otherwise(stem)


#: Folders whose child names a team.
TEAM_ROOTS = ["services", "teams", "apps", "cmd", "pkg", "internal"]


def team_owner(path: Column) -> Column:
    """The first folder after a team root that is a valid label, never the file itself."""
    parts = F.split(path, "/")
    spots = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (i < F.size(parts) - 1) & F.element_at(parts, i).isin(TEAM_ROOTS) & F.element_at(parts, i + 1).rlike("^[a-z][a-z0-9-]{0,62}$"))
    return F.when((F.size(parts) > 2) & (F.size(spots) > 0), F.try_element_at(parts, F.try_element_at(spots, F.lit(1)) + 1))


def six_decimals(x: Column) -> Column:
    """A float as C's printf shows it with %.6f: the exact value, ties to even (Java's formatter rounds them up). A float times 10^6 is exact as a double, so rint
    sees the ties. Null stays null; magnitudes from 9e12 on, which have no fraction, show Java's 17 significant digits."""
    d = x.cast("double")
    n = F.abs(F.rint(d * 1e6)).cast("long")
    sign = F.when(d < 0, "-").when((d == 0) & d.cast("string").startswith("-"), "-").otherwise("")
    plain = F.concat(sign, F.rint((n - n % 1000000) / 1000000).cast("long").cast("string"), F.lit("."), F.lpad((n % 1000000).cast("string"), 6, "0"))
    odd = F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(F.format_string("%.6f", d))
    return F.when(F.abs(d) < 9e12, plain).when(d.isNotNull(), odd)


def embedding_hash(v: Column) -> Column:
    """Null components don't count."""
    return F.substring(F.sha2(F.array_join(F.transform(v, six_decimals), "|"), 256), 1, 16)


def topology_hash(ids: Column) -> Column:
    return F.when(F.size(ids) == 0, "empty").otherwise(F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 16))


def adaptive_threshold(best: Column, second: Column, base: float = 0.92) -> Column:
    return F.coalesce(F.greatest(F.lit(0.85), F.least(F.lit(0.98), base + 0.15 * (0.5 - (best - second)))), F.lit(base))


def count_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one; none for the empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def quality(score: Column, low: float = 0.3, high: float = 0.7) -> Column:
    return F.when(score >= high, "high").when(score < low, "low").otherwise("adequate")


def edge_weight(rel: Column) -> Column:
    return F.when(rel.isin("PRODUCES", "CONSUMES"), 0.8).when(rel == "DEPLOYED_IN", 0.5).otherwise(1.0)


def collection_name(base: str, tenant: str, per_tenant: bool = True) -> str:
    import re

    return f"{base}_{re.sub('[^a-zA-Z0-9_-]', '_', tenant)}" if per_tenant and tenant else base


def budget_status(remaining: Column) -> Column:
    return F.when(remaining <= 0, "black").when(remaining < 0.05, "red").when(remaining < 0.25, "orange").when(remaining <= 0.5, "yellow").otherwise("green")


def redact_map(m: Column, markers: tuple[str, ...] = ("password", "secret", "token", "key", "credential", "authorization")) -> Column:
    """Values whose lower-case key holds a marker become [REDACTED]."""
    hit = lambda k: F.lower(k).rlike("|".join(markers))
    return F.transform_values(m, lambda k, v: F.when(hit(k), F.lit("[REDACTED]")).otherwise(v))


def is_subset(a: Column, b: Column) -> Column:
    """Whether b holds every value of a; the empty array is a subset of all."""
    return F.size(F.array_except(a, b)) == 0


def candidate_rank(score: Column, pagerank: Column) -> Column:
    """Page rank and score mixed where there is a page rank, else the score; missing values are 0."""
    s, p = F.coalesce(score, F.lit(0.0)), F.coalesce(pagerank, F.lit(0.0))
    return F.when(p > 0, 0.7 * p + 0.3 * s).otherwise(s)


def normalised_by_max(rows: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """rows and normalised: the score over its key's largest, 0 where that isn't positive.

    The largest is an aggregate that is joined back, so a hot key isn't gathered in one task.
    """
    top = rows.groupBy(*keys).agg(F.max(score).alias("_most"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    both = rows.alias("x").join(top.alias("y"), same).select("x.*", "y._most")
    return both.withColumn("normalised", F.when(F.col("_most") > 0, F.col(score) / F.col("_most")).otherwise(0.0)).drop("_most")
