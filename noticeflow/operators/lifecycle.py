"""State changes of notices: deadlines, visibility, duplicates, upsert, editing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import infer_status
from ..functions.text import any_of, has_substring, normalize
from ..functions.urls import normalized_url, search_url


def append_note(notes: Column, note: str) -> Column:
    """The notes with one more line, unless they have it."""
    return F.when(F.coalesce(notes, F.lit("")) == "", note).when(notes.contains(note), notes).otherwise(F.concat(notes, F.lit("\n" + note)))


def manual_hidden(status: Column, notes: Column) -> Column:
    start = F.ltrim(F.coalesce(notes, F.lit("")))
    return (status == "hidden") & ~any_of(start.startswith(p) for p in rules.AUTO_PREFIXES)


def only_deadline_notes(notes: Column) -> Column:
    """There are notes, and all are automatic ones about deadlines."""
    lines = F.filter(F.transform(F.split(F.coalesce(notes, F.lit("")), "\n"), F.trim), lambda x: x != "")
    return (F.size(lines) > 0) & (F.size(F.array_except(lines, F.array(F.lit(rules.NOTE_EXPIRED), F.lit(rules.NOTE_UNDATED)))) == 0)


def generic_title(title: Column) -> Column:
    return title.isin(*rules.GENERIC_TITLES) | any_of(title.startswith(t + " ") for t in rules.GENERIC_TITLES)


def non_opportunity(title: Column, url: Column, description: Column) -> Column:
    """Normalised columns."""
    return has_substring(title, rules.NON_OPPORTUNITY_TITLES) | has_substring(url, rules.NON_OPPORTUNITY_TITLES) | has_substring(description, rules.NON_OPPORTUNITY_CONTENT) | generic_title(title)


def undated_review(status: Column, deadline: Column, title: Column, raw_url: Column, url: Column, source_url: Column) -> Column:
    """An undated notice in review that comes from a search page or isn't a call; title and url are normalised."""
    return (status == "review") & deadline.isNull() & (search_url(source_url) | search_url(raw_url) | has_substring(title, rules.FOLLOWUP_TITLES) | has_substring(title, rules.NON_OPPORTUNITY_TITLES) | has_substring(url, rules.NON_OPPORTUNITY_TITLES) | generic_title(title))


def editorial_visibility(status: Column, duplicate_url: Column) -> Column:
    """struct(editorial_status, editorial_notes) of a new record."""
    made = lambda s, n: F.struct(F.lit(s).alias("editorial_status"), n.alias("editorial_notes"))
    prefix = rules.AUTO_PREFIXES[0]
    return (
        F.when(duplicate_url.isNotNull(), made("hidden", F.concat(F.lit(f"{prefix} probabile duplicato di "), duplicate_url)))
        .when(status == "closed", made("hidden", F.lit(f"{prefix} procedura scaduta.")))
        .otherwise(made("approved", F.lit(None).cast("string")))
    )


def refresh_lifecycle(notices: DataFrame, as_of: Column) -> DataFrame:
    """Deadline changes row by row, then duplicates by url. notices has id, source_id, title, description, official_url,
    source_url, status, deadline, editorial_status, editorial_notes; returns them with n_changes.

    An undated notice is only ever hidden; a dated one gets its status, is restored if it was hidden for its deadline
    alone, hidden if it isn't a call (and then done), or hidden if it is closed."""
    c = F.col
    title, url, description = c("__title"), c("__url"), c("__description")
    worded = notices.withColumns({"__title": normalize(c("title")), "__url": normalize(c("official_url")), "__description": normalize(c("description"))})
    step = worded.withColumns({"__new": infer_status(c("deadline"), as_of), "__non": non_opportunity(title, url, description), "__undated": undated_review(c("status"), c("deadline"), title, c("official_url"), url, c("source_url")) & (c("editorial_status") == "approved"), "__dated": c("deadline").isNotNull()})
    step = step.withColumns({"__restored": c("__dated") & (c("__new") != "closed") & (c("editorial_status") == "hidden") & only_deadline_notes(c("editorial_notes"))})
    step = step.withColumns({"__es": F.when(c("__restored"), "approved").otherwise(c("editorial_status")), "__en": F.when(~c("__restored"), c("editorial_notes"))})
    hide_non = c("__dated") & (c("__es") == "approved") & c("__non")
    hide_old = c("__dated") & ~hide_non & (c("__es") == "approved") & (c("__new") == "closed")
    count = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    changed = step.select(
        *[x for x in notices.columns if x not in ("status", "editorial_status", "editorial_notes")],
        F.when(c("__dated"), c("__new")).otherwise(c("status")).alias("status"),
        F.when(c("__undated") | hide_non | hide_old, "hidden").otherwise(c("__es")).alias("editorial_status"),
        F.when(c("__undated"), append_note(c("__en"), rules.NOTE_UNDATED)).when(hide_non, append_note(c("__en"), rules.NOTE_NON_OPPORTUNITY)).when(hide_old, append_note(c("__en"), rules.NOTE_EXPIRED)).otherwise(c("__en")).alias("editorial_notes"),
        (count(c("__undated")) + count(c("__dated") & ~c("status").eqNullSafe(c("__new"))) + count(c("__restored")) + count(hide_non) + count(hide_old)).alias("n_changes"),
    )
    return hide_url_duplicates(changed)


def keep_rank(partition: list[Column]):
    """Best of equals: live, dated, latest deadline, longest description, smallest id."""
    return Window.partitionBy(*partition).orderBy(F.col("status").isin(*rules.LIVE).desc(), F.col("deadline").isNotNull().desc(), F.col("deadline").desc_nulls_last(), F.length(F.coalesce("description", F.lit(""))).desc(), F.col("id").asc())


def hide_url_duplicates(notices: DataFrame) -> DataFrame:
    """Of approved notices of a source with one url all but the best are hidden; search and listing pages don't count."""
    key = normalized_url(F.col("official_url"))
    counts = (F.col("editorial_status") == "approved") & F.col("source_id").isNotNull() & (key != "") & (key != normalized_url(F.col("source_url"))) & ~search_url(F.col("official_url"))
    # Rows that don't count get a group of their own, so that they aren't dealt to one task.
    marked = notices.withColumn("__group", F.when(F.coalesce(counts, F.lit(False)), key).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))))
    ranked = marked.withColumn("__rank", F.row_number().over(keep_rank([F.col("source_id"), F.col("__group")])))
    extra = (F.col("__rank") > 1) & ~F.col("__group").startswith("#")
    return ranked.select(
        *[x for x in notices.columns if x not in ("editorial_status", "editorial_notes", "n_changes")],
        F.when(extra, "hidden").otherwise(F.col("editorial_status")).alias("editorial_status"),
        F.when(extra, rules.NOTE_URL_DUPLICATE).otherwise(F.col("editorial_notes")).alias("editorial_notes"),
        (F.col("n_changes") + extra.cast("int")).alias("n_changes"),
    )


def upsert_notices(existing: DataFrame, batch: DataFrame, order: str = "fetched") -> DataFrame:
    """By (source_id, external_id): the batch's last row (by `order`, then id) overwrites all but id; notices hidden by hand
    stay hidden with their notes. Both have id, source_id, external_id, editorial_status, editorial_notes and payload
    columns. Adds `outcome`: created, updated or kept."""
    keys = ["source_id", "external_id"]
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("id").desc())
    new = batch.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn", order)
    payload = [x for x in existing.columns if x not in (*keys, "id", "editorial_status", "editorial_notes")]
    old = existing.select(*keys, F.struct(*[x for x in existing.columns if x not in keys]).alias("o"))
    both = old.join(new.select(*keys, F.struct(*[x for x in existing.columns if x not in keys]).alias("n")), keys, "full_outer")
    has_old, has_new = F.col("o").isNotNull(), F.col("n").isNotNull()
    keep = ~has_new | (has_old & F.coalesce(manual_hidden(F.col("o.editorial_status"), F.col("o.editorial_notes")), F.lit(False)))
    return both.select(
        F.when(has_old, F.col("o.id")).otherwise(F.col("n.id")).alias("id"),
        *keys,
        *[F.when(has_new, F.col(f"n.{x}")).otherwise(F.col(f"o.{x}")).alias(x) for x in payload],
        *[F.when(keep, F.col(f"o.{x}")).otherwise(F.col(f"n.{x}")).alias(x) for x in ("editorial_status", "editorial_notes")],
        F.when(~has_old, "created").when(has_new, "updated").otherwise("kept").alias("outcome"),
    )


def close_not_seen(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """Open rows of a source that a full scan didn't see are closed, and hidden unless hidden by hand."""
    marked = existing.join(seen.select("source_id", "external_id").distinct().withColumn("__seen", F.lit(True)), ["source_id", "external_id"], "left")
    gone = F.col("__seen").isNull() & (F.col("status") != "closed")
    hide = gone & ~manual_hidden(F.col("editorial_status"), F.col("editorial_notes"))
    return marked.withColumns({"editorial_status": F.when(hide, "hidden").otherwise(F.col("editorial_status")), "status": F.when(gone, "closed").otherwise(F.col("status"))}).drop("__seen")


def apply_edits(notices: DataFrame, edits: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Edits have id and a nullable column for each field. Returns the edited notices and the audit: a row for each set field,
    with the old and the new value as text, also where they are equal."""
    named = edits.select("id", *[F.col(f).alias(f"__{f}") for f in fields])
    both = notices.join(named, "id", "left")
    edited = both.withColumns({f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}).drop(*[f"__{f}" for f in fields])
    rows = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"__{f}").cast("string").alias("new_value")) for f in fields]), lambda x: x["new_value"].isNotNull())
    audit = notices.join(named, "id").select("id", F.explode(rows).alias("e")).select("id", "e.*")
    return edited, audit
