"""Search over notices: predicates, sorting, paging, and facets that leave out their own filter in one scan."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import deadline_bucket
from ..functions.rules import LIVE
from ..functions.text import all_of
from .classify import matches_all


@dataclass(frozen=True)
class Params:
    q: str | None = None
    region: str | None = None
    province: str | None = None
    category: str | None = None
    entity_type: str | None = None
    area: str | None = None
    status: str | None = None
    deadline: str | None = None
    featured: bool | None = None
    include_review: bool = False
    default_status: bool = True


def default_status_rule(p: Params) -> Column:
    """Only live notices (and those in review if asked for), unless a status or an undated or past deadline is asked for."""
    if p.status or p.deadline in ("missing", "past") or not p.default_status:
        return F.lit(True)
    return F.coalesce(F.col("status").isin(*LIVE, *(["review"] if p.include_review else [])), F.lit(False))


def predicates(p: Params, as_of: Column) -> dict[str, Column]:
    """One condition for each filter; a null column never equals a wanted value."""
    equal = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False)) if v else F.lit(True)
    return {
        "approved": F.col("editorial_status").eqNullSafe("approved"),
        "default": default_status_rule(p),
        "q": matches_all(F.col("search_text"), p.q) if p.q else F.lit(True),
        "region": equal("region", p.region),
        "province": equal("province", p.province),
        "category": equal("category", p.category),
        "entity_type": equal("entity_type", p.entity_type),
        "area": F.coalesce(F.array_contains("areas", p.area), F.lit(False)) if p.area else F.lit(True),
        "status": equal("status", p.status),
        "featured": F.coalesce(F.col("is_featured") == p.featured, F.lit(False)) if p.featured is not None else F.lit(True),
        "deadline": deadline_bucket(F.col("deadline"), as_of, p.deadline),
    }


def filter_notices(notices: DataFrame, p: Params, as_of: Column) -> DataFrame:
    return notices.where(all_of(predicates(p, as_of).values()))


SORTS = {
    "deadline": lambda: [F.col("deadline").asc_nulls_last()],
    "recent": lambda: [F.coalesce("published_at", "updated_at").desc_nulls_last()],
    "relevance": lambda: [F.col("relevance_score").desc_nulls_last(), F.col("is_featured").desc_nulls_last()],
    "organization": lambda: [F.lower("organization").asc_nulls_first()],
    "region": lambda: [F.lower(F.coalesce("region", F.lit(""))).asc()],
}


def page(notices: DataFrame, sort: str = "deadline", limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows of a page; the id breaks ties."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset at least 0")
    return notices.orderBy(*SORTS[sort](), "id").offset(offset).limit(limit)


#: Each facet's column, and the filters that it leaves out.
FACETS = {"region": ("region", ("region", "province")), "province": ("province", ("province",)), "category": ("category", ("category",)), "entity_type": ("entity_type", ("entity_type",)), "area": ("areas", ("area",)), "status": ("status", ("status", "default"))}


def facets(notices: DataFrame, masks: dict[str, Column] | None = None, shown: dict[str, str] | None = None) -> DataFrame:
    """(facet, value, n) in one scan: a row counts for a facet where the facet's mask holds. shown has values of facets that
    are there even if no row counts for them."""
    def named(facet: str, column: str) -> Column:
        values = F.coalesce(F.col("areas"), F.array()) if column == "areas" else F.array(F.col(column))
        return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    values = [named(f, c) for f, (c, _) in FACETS.items()]
    if masks is not None:
        values = [F.when(masks[f], v).otherwise(F.array().cast("array<struct<facet:string,value:string>>")) for f, v in zip(FACETS, values, strict=True)]
    found = notices.select(F.explode(F.concat(*values)).alias("e")).select("e.*")
    found = found.where("value is not null and value <> ''").withColumn("n", F.lit(1).cast("long"))
    if shown:
        found = found.unionByName(notices.sparkSession.createDataFrame([(f, v, 0) for f, v in shown.items()], "facet string, value string, n long"))
    return found.groupBy("facet", "value").agg(F.sum("n").alias("n"))


def contextual_facets(notices: DataFrame, p: Params, as_of: Column) -> DataFrame:
    """Counts of each facet under all filters but its own; a selected value that has no row counts 0."""
    conditions = predicates(p, as_of)
    masks = {f: all_of(c for name, c in conditions.items() if name not in out) for f, (_, out) in FACETS.items()}
    return facets(notices, masks, {f.name: getattr(p, f.name) for f in fields(p) if f.name in FACETS and getattr(p, f.name)})
