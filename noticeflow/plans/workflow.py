"""Queries over joins, aggregates, windows, dates, urls, lifecycle, alerts, telemetry and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, rules, text, urls
from ..operators import alerts, classify, identity, lifecycle, snapshot, telemetry
from .base import AS_OF_SQL, has_sql, norm, query
from .fixtures import fixture
from .notices import DIRECT_SQL, FOCUS_FROM, FOCUSED_SQL, PRIMARY_SQL, PSY_SQL, STATUS_SQL, E, N, as_of, enriched

S, A, R, U = "fx_sources", "fx_attachments", "fx_runs", "fx_subscriptions"

# Joins


@query("join_runs_sources", f"SELECT r.id, s.name, r.status, r.started_at FROM fx_runs r JOIN fx_sources s ON r.source_id = s.id WHERE r.started_at >= (SELECT max(started_at) - INTERVAL 10 DAY FROM fx_runs)", R, S)
def join_runs_sources(spark, d):
    runs, s = fixture(spark, d, R), fixture(spark, d, S).select(F.col("id").alias("sid"), "name")
    latest = runs.agg((F.max("started_at") - F.expr("INTERVAL 10 DAYS")).alias("since"))
    recent = runs.join(F.broadcast(latest), F.col("started_at") >= F.col("since"))
    return recent.join(s, F.col("source_id") == F.col("sid")).select("id", "name", "status", "started_at")


@query("semi_published_sources", "SELECT id, name FROM fx_sources s WHERE EXISTS (SELECT 1 FROM fx_notices n WHERE n.source_id = s.id AND n.editorial_status = 'approved')", S, N)
def semi_published_sources(spark, d):
    used = fixture(spark, d, N).where("editorial_status = 'approved'").select("source_id").distinct()
    return fixture(spark, d, S).join(used, F.col("id") == F.col("source_id"), "left_semi").select("id", "name")


@query("anti_zero_result_sources", "SELECT id, name FROM fx_sources s WHERE NOT EXISTS (SELECT 1 FROM fx_notices n WHERE n.source_id = s.id AND n.is_featured AND n.relevance_score > 98)", S, N)
def anti_zero_result_sources(spark, d):
    used = fixture(spark, d, N).where("is_featured and relevance_score > 98").select("source_id").distinct()
    return fixture(spark, d, S).join(used, F.col("id") == F.col("source_id"), "left_anti").select("id", "name")


@query("in_list_sources", "SELECT id FROM fx_sources WHERE source_type IN ('html-list', 'xml-index') AND status NOT IN ('retired')", S)
def in_list_sources(spark, d):
    return fixture(spark, d, S).where(F.col("source_type").isin("html-list", "xml-index") & ~F.col("status").isin("retired")).select("id")


@query("anti_not_seen", "SELECT id, CASE WHEN gone THEN 'closed' ELSE st END AS status, CASE WHEN gone AND NOT manual THEN 'hidden' ELSE editorial_status END AS editorial_status FROM (SELECT *, st <> 'closed' AND NOT EXISTS (SELECT 1 FROM fx_notices q WHERE q.stored_status = 'open' AND q.source_id = x.source_id AND q.external_id = x.external_id) AS gone, editorial_status = 'hidden' AND NOT starts_with(coalesce(editorial_notes, ''), 'Nascosto automaticamente:') AS manual FROM (SELECT *, " + STATUS_SQL + " AS st FROM fx_notices) x)", N)
def anti_not_seen(spark, d):
    """A full scan of the sources saw the external ids that they still list as open."""
    n = enriched(spark, d)
    seen = n.where("stored_status = 'open'").select("source_id", "external_id")
    return lifecycle.close_not_seen(n, seen).select("id", "status", "editorial_status")


MATCH_SQL = "n.editorial_status = 'approved' AND n.status <> 'closed' AND (u.regions_csv = '' OR list_contains(string_split(u.regions_csv, ','), n.region)) AND (u.categories_csv = '' OR list_contains(string_split(u.categories_csv, ','), n.category)) AND (u.areas_csv = '' OR list_has_any(string_split(u.areas_csv, ','), n.areas)) AND (u.keywords_csv = '' OR len(list_filter(string_split(u.keywords_csv, ','), lambda k: NOT contains(n.search_text, k))) = 0)"


def _subscriptions(spark, d) -> DataFrame:
    arrays = {c: text.csv_array(f"{c}_csv") for c in ("regions", "categories", "areas", "keywords")}
    return fixture(spark, d, U).withColumns(arrays)


@query("alert_match", E + f"SELECT u.id AS subscription_id, n.id FROM fx_subscriptions u JOIN e n ON {MATCH_SQL}", N, U)
def alert_match(spark, d):
    return alerts.matches(enriched(spark, d), _subscriptions(spark, d)).select("subscription_id", "id")


@query("alert_top_items", E + f"SELECT u.id AS subscription_id, n.id, row_number() OVER (PARTITION BY u.id ORDER BY n.deadline NULLS LAST, lower(n.title), n.id) AS rank FROM fx_subscriptions u JOIN e n ON {MATCH_SQL} QUALIFY rank <= 12", N, U)
def alert_top_items(spark, d):
    return alerts.top_items(enriched(spark, d), _subscriptions(spark, d)).select("subscription_id", "id", F.col("rank").cast("long").alias("rank"))


DUE_SQL = f"u.status = 'active' AND (u.last_sent_at IS NULL OR u.last_sent_at <= {AS_OF_SQL} - CASE WHEN frequency = 'daily' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END)"


@query("alerts_due", f"SELECT id, email FROM fx_subscriptions u WHERE {DUE_SQL}", U)
def alerts_due(spark, d):
    return alerts.due(fixture(spark, d, U), as_of()).select("id", "email")


REPORT_SQL = E + f""", m AS (SELECT u.id AS sid, n.id, n.title, n.organization, n.region, n.deadline, n.official_url, row_number() OVER (PARTITION BY u.id ORDER BY n.deadline NULLS LAST, lower(n.title), n.id) AS rank FROM fx_subscriptions u JOIN e n ON {MATCH_SQL} WHERE {DUE_SQL} AND (u.last_sent_at IS NULL OR n.updated_at >= u.last_sent_at) QUALIFY rank <= 12),
 l AS (SELECT sid, count(*) AS n, string_agg(concat(rank, '. ', title, chr(10), '   Ente: ', organization, chr(10), '   Regione: ', coalesce(region, 'non indicata'), chr(10), '   Scadenza: ', coalesce(strftime(deadline, '%d/%m/%Y'), 'da verificare'), chr(10), '   Fonte: ', official_url), chr(10) ORDER BY rank) AS lines FROM m GROUP BY sid)
 SELECT u.id AS subscription_id, u.email, coalesce(n, 0) AS matched_count, concat('Risultati trovati: ', coalesce(n, 0), chr(10), coalesce(lines, 'Nessun nuovo bando corrisponde ai filtri salvati.')) AS body FROM fx_subscriptions u LEFT JOIN l ON l.sid = u.id WHERE {DUE_SQL}"""


@query("render_report", REPORT_SQL, N, U)
def render_report(spark, d):
    return alerts.report(enriched(spark, d), _subscriptions(spark, d), as_of())


@query("alert_report", REPORT_SQL.replace(", concat('Risultati", " -- ").split(" -- ")[0] + f" FROM fx_subscriptions u LEFT JOIN l ON l.sid = u.id WHERE {DUE_SQL}", N, U)
def alert_report(spark, d):
    return alerts.report(enriched(spark, d), _subscriptions(spark, d), as_of()).drop("body")


OUTBOX_SQL = REPORT_SQL.replace("SELECT u.id AS subscription_id, u.email,", "SELECT u.id AS subscription_id, u.email AS recipient, concat('Alert bandi: ', coalesce(n, 0), ' risultato/i') AS subject, 'sent' AS status, 'file' AS delivery_mode, " + AS_OF_SQL + " AS last_sent_at,").replace("coalesce(n, 0) AS matched_count, concat(", "md5(concat(").replace("AS body FROM", "AS body_md5 FROM").replace("ai filtri salvati.'))", "ai filtri salvati.')))")


@query("email_outbox_sink", OUTBOX_SQL, N, U)
def email_outbox_sink(spark, d):
    """The log of a delivery to files, with the last report that the subscriptions have after it."""
    subscriptions = _subscriptions(spark, d)
    log = alerts.deliver(alerts.report(enriched(spark, d), subscriptions, as_of()), "file", snapshot.scratch(spark, "outbox"), as_of())
    then = alerts.after_delivery(subscriptions, log).select(F.col("id").alias("subscription_id"), "last_sent_at")
    return log.hint("merge").join(then.hint("merge"), "subscription_id").select("subscription_id", "recipient", "subject", "status", "delivery_mode", F.md5("body").alias("body_md5"), "last_sent_at")


@query("render_confirmation", "SELECT id, concat('Regioni: ', coalesce(nullif(replace(regions_csv, ',', ', '), ''), 'tutte'), chr(10), 'Tipologie: ', coalesce(nullif(replace(categories_csv, ',', ', '), ''), 'tutte'), chr(10), 'Ambiti: ', coalesce(nullif(replace(areas_csv, ',', ', '), ''), 'tutti'), chr(10), 'Parole chiave: ', coalesce(nullif(replace(keywords_csv, ',', ', '), ''), 'nessuna'), chr(10), 'Frequenza: ', frequency, chr(10), 'https://example.org/alerts/confirm?token=', url_encode(email)) AS body FROM fx_subscriptions", U)
def render_confirmation(spark, d):
    line = lambda name, c, default: F.concat(F.lit(f"{name}: "), F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(default))
    s = _subscriptions(spark, d)
    return s.select("id", F.concat_ws("\n", line("Regioni", "regions", "tutte"), line("Tipologie", "categories", "tutte"), line("Ambiti", "areas", "tutti"), line("Parole chiave", "keywords", "nessuna"), F.concat(F.lit("Frequenza: "), "frequency"), F.concat(F.lit("https://example.org/alerts/confirm?token="), F.url_encode("email"))).alias("body"))


@query("alert_lifecycle", "SELECT user_id AS token, CASE WHEN bool_or(event_type = 'error') THEN 'unsubscribed' WHEN bool_or(event_type = 'purchase') THEN 'active' ELSE 'pending' END AS state FROM events GROUP BY user_id")
def alert_lifecycle(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "unsubscribe").when(F.col("event_type") == "purchase", "confirm").otherwise("create")
    return alerts.current_state(e.select(F.col("user_id").alias("token"), kind.alias("event")))


@query("issuer_region", f"SELECT id, region FROM (SELECT i.id, s.region, row_number() OVER (PARTITION BY i.id ORDER BY least(length(i.o), length(s.o)) DESC, s.id) AS rn FROM (SELECT id, {norm("replace(organization, 'Customer#0000000', 'Customer#')")} AS o FROM fx_notices) i JOIN (SELECT id, region, {norm("replace(organization, 'Customer#0000000', 'Customer#')")} AS o FROM fx_sources) s ON contains(i.o, s.o) OR contains(s.o, i.o)) WHERE rn = 1", N, S)
def issuer_region(spark, d):
    """Region of the source whose organisation overlaps the issuer's name most."""
    name = text.normalize(F.replace(F.col("organization"), F.lit("Customer#0000000"), F.lit("Customer#")))
    issuers = fixture(spark, d, N).select("id", name.alias("i"))
    s = fixture(spark, d, S).select("id", "region", name.alias("o"))
    best = identity.overlapping_region(issuers.select("i").distinct(), s)
    return issuers.join(best.hint("merge"), "i").select("id", "region")


@query("align_by_url", f"SELECT id, CASE WHEN n > 1 AND rn > 1 AND NOT manual THEN 'hidden' ELSE editorial_status END AS editorial_status FROM (SELECT *, row_number() OVER (PARTITION BY source_id, official_url ORDER BY editorial_status = 'approved' DESC, status IN ('open', 'closing_soon') DESC, deadline IS NOT NULL DESC, deadline DESC NULLS LAST, length(coalesce(description, '')) DESC, id) AS rn, count(*) OVER (PARTITION BY source_id, official_url) AS n, editorial_status = 'hidden' AND NOT starts_with(coalesce(editorial_notes, ''), 'Nascosto automaticamente:') AS manual FROM (SELECT *, {STATUS_SQL} AS status FROM fx_notices) WHERE NOT contains(official_url, '?s='))", N)
def align_by_url(spark, d):
    """Rows of a source with one url: the best keeps its state, the others are hidden unless hidden by hand."""
    n = enriched(spark, d).where(~urls.search_url(F.col("official_url")))
    w = Window.partitionBy("source_id", "official_url").orderBy((F.col("editorial_status") == "approved").desc(), F.col("status").isin(*rules.LIVE).desc(), F.col("deadline").isNotNull().desc(), F.col("deadline").desc_nulls_last(), F.length(F.coalesce("description", F.lit(""))).desc(), F.col("id").asc())
    hide = (F.row_number().over(w) > 1) & ~lifecycle.manual_hidden(F.col("editorial_status"), F.col("editorial_notes"))
    return n.select("id", F.when(hide, "hidden").otherwise(F.col("editorial_status")).alias("editorial_status"))


@query("sources_x_terms", "SELECT s.id, t.term, CASE WHEN contains(s.base_url, '?s=') THEN regexp_replace(s.base_url, '=.*$', '=') || t.term ELSE s.base_url || '?s=' || t.term END AS url FROM fx_sources s CROSS JOIN (VALUES ('psicolog'), ('psicoterap'), ('lm-51')) AS t(term)", S)
def sources_x_terms(spark, d):
    """Search urls of each source for a stated list of terms."""
    terms = F.explode(F.array(*[F.lit(t) for t in ("psicolog", "psicoterap", "lm-51")]))
    s = fixture(spark, d, S).select("id", "base_url", terms.alias("term"))
    has = urls.search_url(F.col("base_url"))
    return s.select("id", "term", F.when(has, F.concat(F.regexp_replace("base_url", "=.*$", "="), "term")).otherwise(F.concat("base_url", F.lit("?s="), "term")).alias("url"))


@query("fuzzy_duplicate")
def fuzzy_duplicate(spark, d):
    return identity.probable_duplicates(enriched(spark, d))


# Aggregates


@query("run_totals", "SELECT CAST(sum(created_count) AS BIGINT) AS created, CAST(sum(updated_count) AS BIGINT) AS updated, CAST(sum(skipped_count) AS BIGINT) AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'partial' ELSE 'completed' END AS overall FROM fx_runs", R)
def run_totals(spark, d):
    return telemetry.run_totals(fixture(spark, d, R))


@query("source_telemetry", "WITH t AS (SELECT source_id, bool_or(status = 'failed') AS f FROM fx_runs GROUP BY source_id) SELECT (SELECT count(*) FROM fx_sources) AS catalogued, count(*) AS attempted, count(*) FILTER (WHERE f) AS failed, count(*) FILTER (WHERE NOT f) AS successful, greatest((SELECT count(*) FROM fx_sources) - count(*), 0) AS not_attempted FROM t", R, S)
def source_telemetry(spark, d):
    return telemetry.source_telemetry(fixture(spark, d, S), fixture(spark, d, R))


@query("notices_per_source", "SELECT source_id, count(*) AS n FROM fx_notices GROUP BY source_id", N)
def notices_per_source(spark, d):
    return fixture(spark, d, N).groupBy("source_id").agg(F.count("*").alias("n"))


PROBE_SQL = "CASE WHEN error_message IS NULL THEN NULL WHEN contains(lower(error_message), 'timeout') OR contains(lower(error_message), 'timed out') THEN 'timeout-review' WHEN contains(lower(error_message), 'certificate_verify_failed') OR (contains(lower(error_message), 'ssl') AND (contains(lower(error_message), 'handshake') OR contains(lower(error_message), 'tls'))) THEN 'tls-review' ELSE 'unreachable' END"


@query("probe_status", f"SELECT r.id, coalesce({PROBE_SQL}, CASE WHEN r.id % 6 = 0 THEN 'access-challenge' WHEN r.id % 7 = 0 THEN 'http-error' WHEN s.status = 'active' THEN 'active' ELSE 'reachable' END) AS probe FROM fx_runs r LEFT JOIN fx_sources s ON r.source_id = s.id", R, S)
def probe_status(spark, d):
    """Runs as probes: some pages ask for cookies, some for a captcha by their address, some answer with an error."""
    s = fixture(spark, d, S).select(F.col("id").alias("sid"), F.col("status").alias("source_status"))
    r = fixture(spark, d, R).join(s, F.col("source_id") == F.col("sid"), "left")
    text = F.when(F.col("id") % 12 == 0, "<p>Please Enable JavaScript and cookies to go on</p>").otherwise("<p>Bandi di concorso</p>")
    url = F.when(F.col("id") % 12 == 6, "https://x.example/Captcha?x=1").otherwise("https://x.example/")
    return r.select("id", telemetry.probe_outcome(F.col("error_message"), F.when(F.col("id") % 7 == 0, 503).otherwise(200), url, text, F.col("source_status")).alias("probe"))


@query("audit_report", f"SELECT coalesce(source_type, 'unassigned') AS source_type, coalesce({PROBE_SQL}, 'ok') AS probe, EXISTS (SELECT 1 FROM fx_notices n WHERE n.source_id = r.source_id) AS with_results, count(*) AS n, count(DISTINCT r.source_id) FILTER (WHERE s.id IS NULL) AS unassigned_sources FROM fx_runs r LEFT JOIN fx_sources s ON r.source_id = s.id GROUP BY ALL", R, S, N)
def audit_report(spark, d):
    """Runs by kind of source, outcome, and whether the source has any notice; how many sources nobody knows."""
    s = fixture(spark, d, S).select(F.col("id").alias("sid"), "source_type")
    found = fixture(spark, d, N).select(F.col("source_id").alias("nid")).distinct()
    r = fixture(spark, d, R).join(s, F.col("source_id") == F.col("sid"), "left").join(found, F.col("source_id") == F.col("nid"), "left")
    keys = [F.coalesce("source_type", F.lit("unassigned")).alias("source_type"), F.coalesce(telemetry.probe_status(F.col("error_message")), F.lit("ok")).alias("probe"), F.col("nid").isNotNull().alias("with_results")]
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("sid").isNull(), F.col("source_id"))).alias("unassigned_sources"))


@query("approved_guard_count", "SELECT count(*) AS n FROM fx_notices WHERE editorial_status = 'approved'", N)
def approved_guard_count(spark, d):
    return fixture(spark, d, N).where("editorial_status = 'approved'").agg(F.count("*").alias("n"))


@query("pipeline_metrics", "SELECT source_id, CASE WHEN editorial_status = 'hidden' THEN coalesce(editorial_notes, 'altro') ELSE editorial_status END AS reason, count(*) AS n FROM fx_notices GROUP BY ALL", N)
def pipeline_metrics(spark, d):
    reason = F.when(F.col("editorial_status") == "hidden", F.coalesce("editorial_notes", F.lit("altro"))).otherwise(F.col("editorial_status"))
    return fixture(spark, d, N).groupBy("source_id", reason.alias("reason")).agg(F.count("*").alias("n"))


SNAPSHOT_COLUMNS = {"notices": ["id", "source_id", "external_id", "title", "description", "organization", "entity_type", "region", "province", "category", "areas_csv", "stored_status", "editorial_status", "relevance_score", "official_url"], "sources": ["id", "name", "source_type", "base_url", "region", "organization", "status"], "attachments": ["id", "notice_id", "title", "url"]}
#: The exported tables in SQL.
PUBLIC_SQL = "pn AS (SELECT n.* FROM fx_notices n JOIN fx_sources s ON n.source_id = s.id WHERE n.editorial_status = 'approved' AND s.source_type <> 'third-sector-hub'), ps AS (SELECT * REPLACE ('active' AS status, CAST(NULL AS TIMESTAMP) AS last_success_at) FROM fx_sources s WHERE source_type <> 'third-sector-hub' AND EXISTS (SELECT 1 FROM pn WHERE pn.source_id = s.id)), pa AS (SELECT a.* FROM fx_attachments a JOIN pn ON a.notice_id = pn.id)"


def _leaves_sql(table: str, rows: str) -> str:
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in SNAPSHOT_COLUMNS[table])
    return f"SELECT '{table}' AS table_name, bucket, count(*) AS n, sha256(concat_ws('|', count(*), sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)), sum(CAST('0x' || substr(h, 33, 15) AS BIGINT)))) AS digest FROM (SELECT substr(sha256(CAST(id AS VARCHAR)), 1, 2) AS bucket, sha256(concat_ws(chr(31), {cells})) AS h FROM {rows}) GROUP BY bucket"


def _public(spark, d, keep=None) -> dict[str, DataFrame]:
    return snapshot.public_tables(fixture(spark, d, N), fixture(spark, d, S), fixture(spark, d, A), keep)


@query("content_digest", f"WITH {PUBLIC_SQL} " + " UNION ALL ".join(_leaves_sql(t, r) for t, r in (("notices", "pn"), ("sources", "ps"), ("attachments", "pa"))), N, S, A)
def content_digest(spark, d):
    """The leaves of the hash tree over the three exported tables."""
    return snapshot.hash_tree(_public(spark, d), SNAPSHOT_COLUMNS)


# Windows


@query("keep_best_url_dup", f"SELECT id, source_id, official_url FROM (SELECT *, {STATUS_SQL} AS status FROM fx_notices WHERE editorial_status = 'approved' AND NOT contains(official_url, '?s=')) QUALIFY count(*) OVER (PARTITION BY source_id, rtrim(lower(official_url), '/')) > 1 AND row_number() OVER (PARTITION BY source_id, rtrim(lower(official_url), '/') ORDER BY status IN ('open', 'closing_soon') DESC, deadline IS NOT NULL DESC, deadline DESC NULLS LAST, length(coalesce(description, '')) DESC, id) = 1", N)
def keep_best_url_dup(spark, d):
    n = enriched(spark, d).where((F.col("editorial_status") == "approved") & ~urls.search_url(F.col("official_url")))
    key = [F.col("source_id"), urls.normalized_url(F.col("official_url"))]
    ranked = n.withColumn("n", F.count("*").over(Window.partitionBy(*key))).withColumn("rn", F.row_number().over(lifecycle.keep_rank(key)))
    return ranked.where("n > 1 and rn = 1").select("id", "source_id", "official_url")


@query("keep_best_extid_dup", "SELECT id, external_id FROM fx_notices QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY CASE editorial_status WHEN 'approved' THEN 0 WHEN 'pending' THEN 1 WHEN 'hidden' THEN 2 ELSE 3 END, updated_at, id) = 1", N)
def keep_best_extid_dup(spark, d):
    return identity.last_wins(fixture(spark, d, N), ["external_id"], identity.editorial_rank(F.col("editorial_status")), F.col("updated_at"), F.col("id")).select("id", "external_id")


@query("last_wins", "SELECT id, source_id, external_id FROM fx_notices QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY updated_at DESC, id DESC) = 1", N)
def last_wins(spark, d):
    return identity.last_wins(fixture(spark, d, N), ["source_id", "external_id"], F.col("updated_at").desc(), F.col("id").desc()).select("id", "source_id", "external_id")


@query("better_candidate", "SELECT official_url, id FROM fx_notices QUALIFY row_number() OVER (PARTITION BY official_url ORDER BY deadline IS NOT NULL DESC, length(coalesce(description, '')) DESC, id) = 1", N)
def better_candidate(spark, d):
    return identity.last_wins(fixture(spark, d, N), ["official_url"], F.col("deadline").isNotNull().desc(), F.length(F.coalesce("description", F.lit(""))).desc(), F.col("id")).select("official_url", "id")


@query("latest_by_publication", "SELECT id, published_at FROM fx_notices ORDER BY published_at DESC NULLS LAST, deadline DESC NULLS LAST, id LIMIT 25", N)
def latest_by_publication(spark, d):
    return fixture(spark, d, N).orderBy(F.col("published_at").desc_nulls_last(), F.col("deadline").desc_nulls_last(), "id").limit(25).select("id", "published_at")


@query("cap_per_source", "SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY relevance_score DESC, id) AS rank FROM fx_notices QUALIFY rank <= 30", N)
def cap_per_source(spark, d):
    w = Window.partitionBy("source_id").orderBy(F.col("relevance_score").desc(), "id")
    return fixture(spark, d, N).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 30").select("id", "source_id", "rank")


SLOT_SQL = f"CAST(floor(epoch({AS_OF_SQL}) / 43200) AS BIGINT)"


@query("rotation_batch", f"SELECT id, name, (k - ({SLOT_SQL} * 7) % n + n) % n AS offset_ FROM (SELECT id, name, row_number() OVER (ORDER BY lower(name), id) - 1 AS k, count(*) OVER () AS n FROM fx_sources) WHERE (k - ({SLOT_SQL} * 7) % n + n) % n < 7", S)
def rotation_batch(spark, d):
    """The slot's seven sources."""
    return telemetry.rotation_batch(fixture(spark, d, S), 7, dates.rotation_slot(as_of())).select("id", "name", F.col("offset").cast("long").alias("offset_"))


@query("source_refresh_order", "SELECT id, row_number() OVER (ORDER BY last_success_at ASC NULLS FIRST, lower(name), id) AS position FROM fx_sources", S)
def source_refresh_order(spark, d):
    return telemetry.refresh_order(fixture(spark, d, S)).select("id", F.col("position").cast("long").alias("position"))


# Sets


@query("union_sources", "SELECT external_id, title, NULL AS url FROM fx_notices UNION ALL SELECT id, title, url FROM fx_attachments", N, A)
def union_sources(spark, d):
    a = fixture(spark, d, A).select(F.col("id").alias("external_id"), "title", "url")
    return fixture(spark, d, N).select("external_id", "title").unionByName(a, allowMissingColumns=True)


@query("ordered_distinct", "SELECT official_url, min(id) AS position FROM fx_notices GROUP BY official_url", N)
def ordered_distinct(spark, d):
    return fixture(spark, d, N).groupBy("official_url").agg(F.min("id").alias("position"))


@query("array_intersect", E + "SELECT id FROM e WHERE list_has_any(areas, ['anziani', 'ricerca'])", N)
def array_intersect(spark, d):
    return enriched(spark, d).where(F.arrays_overlap("areas", F.array(F.lit("anziani"), F.lit("ricerca")))).select("id")


@query("array_subset", "SELECT id, coalesce(editorial_notes = 'Nascosto automaticamente: scadenza superata.', false) AS only_auto FROM fx_notices", N)
def array_subset(spark, d):
    return fixture(spark, d, N).select("id", lifecycle.only_deadline_notes(F.col("editorial_notes")).alias("only_auto"))


@query("set_difference", "SELECT DISTINCT source_id FROM fx_runs EXCEPT SELECT source_id FROM fx_runs WHERE status = 'failed' AND created_count = 4", R)
def set_difference(spark, d):
    """Sources that were tried, without those with a failure after four new notices."""
    r = fixture(spark, d, R)
    failed = r.where("status = 'failed' and created_count = 4").select("source_id").distinct()
    return r.select("source_id").distinct().join(failed, "source_id", "left_anti")


@query("array_funcs", E + "SELECT id, len(areas) AS n, coalesce(areas[1], '') AS first_area, array_to_string(list_sort(list_distinct(list_concat(areas, ['anziani']))), ',') AS merged FROM e", N)
def array_funcs(spark, d):
    return enriched(spark, d).select("id", F.size("areas").cast("long").alias("n"), F.coalesce(F.get("areas", F.lit(0)), F.lit("")).alias("first_area"), F.array_join(F.array_sort(F.array_distinct(F.concat("areas", F.array(F.lit("anziani"))))), ",").alias("merged"))


# Dates


@query("parse_date", "SELECT id, strftime(timezone('UTC', timezone('Europe/Rome', CAST(CAST(updated_at AS DATE) AS TIMESTAMP) + INTERVAL '23 hours 59 minutes')), '%Y-%m-%d %H:%M') AS found FROM fx_notices", N)
def parse_date(spark, d):
    return fixture(spark, d, N).select("id", F.date_format(dates.parse_date(F.col("deadline_text")), "yyyy-MM-dd HH:mm").alias("found"))


ROME_SQL = "strftime(timezone('UTC', timezone('Europe/Rome', CAST(CAST({0} AS DATE) AS TIMESTAMP) + INTERVAL '23 hours 59 minutes')), '%Y-%m-%d %H:%M')"


@query("parse_latest_date", "SELECT id, " + ROME_SQL.format("greatest(updated_at, TIMESTAMP '1997-03-05 00:00:00')") + " AS latest FROM fx_notices", N)
def parse_latest_date(spark, d):
    both = F.concat(F.lit("dal 5 marzo 1997, "), F.col("deadline_text"))
    return fixture(spark, d, N).select("id", F.date_format(dates.parse_latest_date(both), "yyyy-MM-dd HH:mm").alias("latest"))


@query("labelled_deadline", "SELECT id, CASE WHEN id % 5 <> 2 THEN " + ROME_SQL.format("updated_at") + " END AS found FROM fx_notices", N)
def labelled_deadline(spark, d):
    body = F.concat(F.when(F.col("id") % 5 == 2, "Scadenza graduatoria. ").otherwise("Avviso pubblicato il 01/01/1990. "), F.col("deadline_text"))
    return fixture(spark, d, N).select("id", F.date_format(dates.labelled_deadline(body), "yyyy-MM-dd HH:mm").alias("found"))


@query("labelled_publication", "SELECT id, " + ROME_SQL.format("updated_at") + " AS found FROM fx_notices", N)
def labelled_publication(spark, d):
    body = F.concat(F.lit("Data pubblicazione: "), F.regexp_extract("deadline_text", r"\d.*", 0), F.lit("; scadenza 31/12/2099"))
    return fixture(spark, d, N).select("id", F.date_format(dates.labelled_publication(body), "yyyy-MM-dd HH:mm").alias("found"))


@query("epoch_millis", "SELECT event_id, strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS instant FROM events")
def epoch_millis(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.date_format(F.timestamp_millis(F.unix_seconds(F.col("ts").cast("timestamp")) * 1000), "yyyy-MM-dd HH:mm:ss").alias("instant"))


@query("infer_status", f"SELECT id, {STATUS_SQL} AS status FROM fx_notices", N)
def infer_status(spark, d):
    return fixture(spark, d, N).select("id", dates.infer_status(F.col("deadline"), as_of()).alias("status"))


@query("status_override", f"SELECT id, CASE WHEN stored_status = 'closed' OR contains(t, 'graduatoria') THEN 'closed' WHEN st = 'review' AND stored_status = 'open' THEN 'open' ELSE st END AS status FROM (SELECT *, {norm('title')} AS t, {STATUS_SQL} AS st FROM fx_notices)", N)
def status_override(spark, d):
    """A source's own badge or title wins over the deadline."""
    n = fixture(spark, d, N).withColumns({"t": text.normalize(F.col("title")), "st": dates.infer_status(F.col("deadline"), as_of())})
    closed = (F.col("stored_status") == "closed") | F.col("t").contains("graduatoria")
    return n.select("id", F.when(closed, "closed").when((F.col("st") == "review") & (F.col("stored_status") == "open"), "open").otherwise(F.col("st")).alias("status"))


@query("rotation_slot", "SELECT event_id, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS slot FROM events")
def rotation_slot(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", dates.rotation_slot(F.col("ts").cast("timestamp")).alias("slot"))


# Text and urls


@query("positions", "SELECT id, CAST(id % 7 AS INT) AS posts FROM fx_notices", N)
def positions(spark, d):
    return fixture(spark, d, N).select("id", text.positions(F.col("title")).alias("posts"))


@query("title_pick", r"SELECT doc_id, CASE WHEN length(h) >= 12 THEN substr(h, 1, 500) ELSE substr(regexp_extract(text, '^((?s).*?)([.!?]\s|$)', 1) || CASE WHEN regexp_matches(text, '^((?s).*?)[.!?]\s') THEN regexp_extract(text, '^(?s).*?([.!?])\s', 1) ELSE '' END, 1, 500) END AS title FROM (SELECT doc_id, text, trim(regexp_replace(source, '\s+', ' ', 'g')) AS h FROM documents)")
def title_pick(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", text.title_pick(F.col("source"), F.col("text")).alias("title"))


@query("file_type", "SELECT id, upper(nullif(regexp_extract(lower(url), '\\.(pdf|docx?|odt|xlsx?|ods|zip|p7m|rtf)($|[?#])', 1), '')) AS kind FROM fx_attachments", A)
def file_type(spark, d):
    return fixture(spark, d, A).select("id", text.file_type(F.col("url")).alias("kind"))


@query("file_like_url", "SELECT id, regexp_matches(lower(url), '\\.(pdf|docx?|odt|xlsx?|zip|p7m)($|[?#])|/download|download=') AS hit FROM fx_attachments", A)
def file_like_url(spark, d):
    return fixture(spark, d, A).select("id", urls.file_like_url(F.col("url")).alias("hit"))


@query("search_url", "SELECT id, regexp_matches(official_url, '[?&](combine|q|s|search|text)=[^&]') AS hit FROM fx_notices", N)
def search_url(spark, d):
    return fixture(spark, d, N).select("id", urls.search_url(F.col("official_url")).alias("hit"))


@query("bad_url", "SELECT page_id, regexp_matches(url, '[?&](combine|q|s|search|text)=[^&]') OR contains(lower(url), '/page/') OR contains(lower(url), '/category/') AS hit FROM pages")
def bad_url(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", urls.bad_url(F.col("url")).alias("hit"))


STRUCTURAL_SQL = f"(regexp_matches(lower({{href}}), '[?&]({'|'.join(rules.PAGING_KEYS)})=[^&#]') OR regexp_matches(lower({{href}}), '^[a-z]+://[^/?#]*[^?#]*/page/[0-9]+/?($|[?#])') OR regexp_matches({norm('{label}')}, '^[0-9]*$') OR {has_sql(norm("concat_ws(' ', {label}, {href})"), rules.PAGING_TERMS)})"


@query("structural_link", f"SELECT page_id, {STRUCTURAL_SQL.format(label='label', href='url')} AS hit FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)<', 1) AS label FROM pages)")
def structural_link(spark, d):
    """Paging and frame links are no notices."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)<", 1).alias("label"))
    return p.select("page_id", classify.structural_link(F.col("label"), F.col("url")).alias("hit"))


@query("safe_http_url", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/@]+(/|$|[?#])') THEN url END AS safe FROM pages")
def safe_http_url(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", urls.safe_http_url(F.col("url")).alias("safe"))


NORMALIZED_SQL = "lower(regexp_extract({0}, '://([^/?#]*)', 1)) || rtrim(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '/') || regexp_extract({0}, '[?]([^#]*)', 1)"


@query("normalized_url", f"SELECT page_id, {NORMALIZED_SQL.format('url')} AS key FROM pages")
def normalized_url(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", urls.normalized_url(F.col("url")).alias("key"))


@query("same_url", f"SELECT n.id, {NORMALIZED_SQL.format('n.official_url')} = {NORMALIZED_SQL.format('s.base_url')} AS listing FROM fx_notices n JOIN fx_sources s ON n.source_id = s.id", N, S)
def same_url(spark, d):
    s = fixture(spark, d, S).select(F.col("id").alias("sid"), "base_url")
    return fixture(spark, d, N).join(s, F.col("source_id") == F.col("sid")).select("id", urls.same_url(F.col("official_url"), F.col("base_url")).alias("listing"))


@query("listing_page", f"SELECT n.id, {NORMALIZED_SQL.format('n.official_url')} = {NORMALIZED_SQL.format('s.base_url')} OR contains(n.official_url, '?s=') AS listing FROM fx_notices n JOIN fx_sources s ON n.source_id = s.id", N, S)
def listing_page(spark, d):
    s = fixture(spark, d, S).select(F.col("id").alias("sid"), "base_url")
    u = F.col("official_url")
    return fixture(spark, d, N).join(s, F.col("source_id") == F.col("sid")).select("id", (urls.same_url(u, F.col("base_url")) | urls.search_url(u)).alias("listing"))


@query("query_value", "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages")
def query_value(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", urls.query_value(F.col("url"), "page").alias("page"))


@query("urljoin", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/x' AS rooted, regexp_replace(url, '[?#].*$', '') || '?p=1' AS queried, regexp_extract(url, '^([a-z]+)://', 1) || '://cdn.example/y' AS protocol FROM pages")
def urljoin(spark, d):
    u = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", urls.urljoin(u, F.lit("/x")).alias("rooted"), urls.urljoin(u, F.lit("?p=1")).alias("queried"), urls.urljoin(u, F.lit("//cdn.example/y")).alias("protocol"))


SITE_SQL = "lower(regexp_extract({0}, '://([^/?#:]*)', 1))"


@query("same_site", f"SELECT page_id, {SITE_SQL.format('url')} = {SITE_SQL.format('other')} OR (regexp_matches({SITE_SQL.format('url')}, '(mim|miur|istruzione)[.]gov[.]it$') AND regexp_matches({SITE_SQL.format('other')}, '(mim|miur|istruzione)[.]gov[.]it$')) AS same FROM (SELECT a.page_id, CASE a.page_id % 4 WHEN 0 THEN 'https://www.miur.gov.it/a' ELSE a.url END AS url, CASE a.page_id % 8 WHEN 0 THEN 'https://usr.istruzione.gov.it/' || a.page_id WHEN 4 THEN 'https://istruzione.example.it/' ELSE b.url END AS other FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)")
def same_site(spark, d):
    """Each page against the next one, a quarter of them under the ministry's hosts."""
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    k = F.col("page_id")
    met = p.join(nxt, "page_id").withColumns({"url": F.when(k % 4 == 0, "https://www.miur.gov.it/a").otherwise(F.col("url")), "other": F.when(k % 8 == 0, F.concat(F.lit("https://usr.istruzione.gov.it/"), k.cast("string"))).when(k % 8 == 4, "https://istruzione.example.it/").otherwise(F.col("other"))})
    return met.select("page_id", urls.same_site(F.col("url"), F.col("other")).alias("same"))


@query("external_id", f"SELECT id, substr(sha256(concat_ws('|', CAST(source_id AS VARCHAR), {norm('official_url')}, CASE WHEN contains(official_url, '?s=') THEN {norm('title')} END)), 1, 24) AS external_id FROM fx_notices", N)
def external_id(spark, d):
    u = F.col("official_url")
    return fixture(spark, d, N).select("id", urls.external_id(F.col("source_id"), u, F.col("title"), urls.search_url(u)).alias("external_id"))


#: The rules of external_id_rules in the order of id modulo their number, in SQL.
_HEX = "substr(sha256({0}), 1, 24)".format
RULES_SQL = {
    "title_and_url": _HEX(f"concat_ws('|', CAST(source_id AS VARCHAR), {norm('title')}, {norm('official_url')})"),
    "lower_url": _HEX("concat_ws('|', CAST(source_id AS VARCHAR), lower(official_url), CASE WHEN contains(official_url, '?s=') THEN lower(title) END)"),
    "record": _HEX(f"concat_ws('|', CAST(source_id AS VARCHAR), CAST(id AS VARCHAR), {norm('title')}, {norm('official_url')})"),
    "title": _HEX(f"{norm('title')}"),
    "title_and_dates": _HEX(f"concat_ws('|', {norm('title')}, coalesce(strftime(published_at, '%Y-%m-%d'), ''), coalesce(strftime(deadline, '%Y-%m-%d'), ''), official_url)"),
    "trailing_number": f"CASE WHEN id % 4 = 0 THEN CAST(id AS VARCHAR) ELSE {_HEX('official_url')} END",
    "attachment": "CASE WHEN id % 4 = 0 THEN 'n ' || id ELSE substr(sha256(title || '|' || coalesce(strftime(deadline, '%d/%m/%Y'), '')), 1, 16) END",
    "last_segment": "regexp_extract(regexp_extract(official_url, '^[a-z]+://[^/]*([^?]*)', 1), '[^/]*$')",
    "redaction_code": "CASE WHEN id % 4 < 2 THEN '26A' || lpad(CAST(id % 100000 AS VARCHAR), 5, '0') END",
}


@query("external_id_rules", "SELECT id, CASE id % " + str(len(RULES_SQL)) + " " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(RULES_SQL.values())) + " END AS external_id FROM fx_notices", N)
def external_id_rules(spark, d):
    """Each notice by one of the other identity rules; some urls end in a number, some attachments and acts have a code."""
    c = F.col
    text, fourth = c("id").cast("string"), c("id") % 4
    rule = F.element_at(F.array(*map(F.lit, RULES_SQL)), (c("id") % len(RULES_SQL) + 1).cast("int"))
    code = F.concat(F.lit("26A"), F.lpad((c("id") % 100000).cast("string"), 5, "0"))
    url = F.when((rule == "trailing_number") & (fourth == 0), F.concat(F.lit("https://ente.example/avviso-2-"), text)).when((rule == "redaction_code") & (fourth == 0), F.concat(F.lit("https://ente.example/atto?atto.codiceRedazionale="), code)).otherwise(c("official_url"))
    attached = F.array(F.lit("https://ente.example/a.pdf"), F.when(fourth == 0, F.concat(F.lit("https://ente.example/get?x=1&id=n+"), text)))
    made = urls.external_id_by(rule, source_id=c("source_id"), url=url, title=c("title"), listing=urls.search_url(url), record_id=c("id"), published_at=c("published_at"), deadline_at=c("deadline"), section_url=c("official_url"), attachment_urls=attached, deadline_text=F.date_format("deadline", "dd/MM/yyyy"), text=F.when(fourth == 1, F.concat(F.lit("atto ("), code, F.lit(") del"))))
    return fixture(spark, d, N).select("id", made.alias("external_id"))


@query("content_hash", "SELECT id, sha256(concat_ws(chr(10), title, coalesce(description, ''), official_url)) AS hash FROM fx_notices", N)
def content_hash(spark, d):
    return fixture(spark, d, N).select("id", urls.content_hash(F.col("title"), F.col("description"), F.col("official_url")).alias("hash"))


@query("external_key", "SELECT id, sha256(concat(coalesce(CAST(source_id AS VARCHAR), ''), '|', coalesce(external_id, ''), '|', coalesce(official_url, ''))) AS key FROM fx_notices", N)
def external_key(spark, d):
    return fixture(spark, d, N).select("id", urls.external_key(F.col("source_id"), F.col("external_id"), F.col("official_url")).alias("key"))


@query("fingerprint", f"SELECT id, sha256({norm('title')} || '|' || {norm('organization')} || '|' || {norm("strftime(deadline, '%Y-%m-%d')")}) AS fingerprint FROM fx_notices", N)
def fingerprint(spark, d):
    return fixture(spark, d, N).select("id", urls.fingerprint(F.col("title"), F.col("organization"), F.date_format("deadline", "yyyy-MM-dd")).alias("fingerprint"))


@query("similarity")
def similarity(spark, d):
    """Each notice's title against that of the next id of its source."""
    n = fixture(spark, d, N).withColumn("other", F.lead("title").over(Window.partitionBy("source_id").orderBy("id"))).where("other is not null")
    pairs = n.select("title", "other").distinct()
    scored = pairs.select("title", "other", F.round(identity.similarity(text.normalize(F.col("title")), text.normalize(F.col("other"))), 6).alias("ratio"))
    return n.hint("merge").join(scored.hint("merge"), ["title", "other"]).select("id", "ratio")


@query("url_template", "SELECT id, concat('https://api.example.org/notices/', external_id, '/download?src=', source_id, '&h=', lower(hex(external_id))) AS url FROM fx_notices", N)
def url_template(spark, d):
    return fixture(spark, d, N).select("id", F.format_string("https://api.example.org/notices/%s/download?src=%d&h=%s", "external_id", "source_id", F.lower(F.hex("external_id"))).alias("url"))


@query("official_url_pick", "SELECT n.id, coalesce(min(CASE WHEN contains(lower(a.title), 'bando') THEN a.url END), min(a.url), n.official_url) AS url FROM fx_notices n LEFT JOIN fx_attachments a ON a.notice_id = n.id GROUP BY n.id, n.official_url", N, A)
def official_url_pick(spark, d):
    """An attachment that names the call, else any, else the page; the smallest url of equals."""
    a = fixture(spark, d, A).groupBy("notice_id").agg(F.min(F.when(F.lower("title").contains("bando"), F.col("url"))).alias("call"), F.min("url").alias("some"))
    return fixture(spark, d, N).join(a, F.col("id") == F.col("notice_id"), "left").select("id", F.coalesce("call", "some", "official_url").alias("url"))


@query("attachment_filter", "SELECT notice_id, url, title, row_number() OVER (PARTITION BY notice_id ORDER BY url) AS rank FROM (SELECT notice_id, url, arg_max(title, id) AS title FROM fx_attachments WHERE NOT contains(lower(title), 'commissione') AND NOT contains(lower(title), 'istruzioni') GROUP BY ALL) QUALIFY rank <= 6", A)
def attachment_filter(spark, d):
    """Attachments without excluded terms, the last one for each url, six at most."""
    t = F.lower("title")
    kept = fixture(spark, d, A).where(~t.contains("commissione") & ~t.contains("istruzioni")).groupBy("notice_id", "url").agg(F.max_by("title", "id").alias("title"))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("notice_id").orderBy("url")).cast("long")).where("rank <= 6")


# Lifecycle


@query("upsert_notices", "WITH b AS (SELECT * FROM fx_notices WHERE published_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY updated_at DESC NULLS LAST, id DESC) = 1), o AS (SELECT * FROM fx_notices WHERE stored_status <> 'open' QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY id) = 1) SELECT coalesce(o.id, b.id) AS id, source_id, external_id, CASE WHEN b.id IS NOT NULL THEN b.title || ' bis' ELSE o.title END AS title, CASE WHEN b.id IS NULL OR (o.id IS NOT NULL AND o.editorial_status = 'hidden' AND NOT starts_with(coalesce(o.editorial_notes, ''), 'Nascosto automaticamente:')) THEN o.editorial_status ELSE 'approved' END AS editorial_status, CASE WHEN o.id IS NULL THEN 'created' WHEN b.id IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM o FULL JOIN b USING (source_id, external_id)", N)
def upsert_notices(spark, d):
    n = fixture(spark, d, N)
    columns = ["id", "source_id", "external_id", "title", "editorial_status", "editorial_notes"]
    old = identity.last_wins(n.where("stored_status <> 'open'"), ["source_id", "external_id"], F.col("id")).select(*columns)
    batch = n.where("published_at is not null").withColumns({"title": F.concat("title", F.lit(" bis")), "editorial_status": F.lit("approved"), "editorial_notes": F.lit(None).cast("string")}).select(*columns, F.col("updated_at").alias("fetched"))
    return lifecycle.upsert_notices(old, batch).drop("editorial_notes")


@query("manual_hidden", "SELECT id, editorial_status = 'hidden' AND NOT starts_with(coalesce(editorial_notes, ''), 'Nascosto automaticamente:') AS manual FROM fx_notices", N)
def manual_hidden(spark, d):
    return fixture(spark, d, N).select("id", lifecycle.manual_hidden(F.col("editorial_status"), F.col("editorial_notes")).alias("manual"))


@query("editorial_visibility", f"SELECT id, CASE WHEN id % 9 = 0 OR st = 'closed' THEN 'hidden' ELSE 'approved' END AS editorial_status, CASE WHEN id % 9 = 0 THEN 'Escluso automaticamente: probabile duplicato di ' || official_url WHEN st = 'closed' THEN 'Escluso automaticamente: procedura scaduta.' END AS editorial_notes FROM (SELECT *, {STATUS_SQL} AS st FROM fx_notices)", N)
def editorial_visibility(spark, d):
    seen = F.when(F.col("id") % 9 == 0, F.col("official_url"))
    return enriched(spark, d).select("id", lifecycle.editorial_visibility(F.col("status"), seen).alias("e")).select("id", "e.*")


@query("editorial_from_match", f"SELECT id, CASE WHEN role THEN 'approved' WHEN contains(t, 'psicolog') THEN 'pending' ELSE 'hidden' END AS editorial_status FROM (SELECT id, t, regexp_matches(t, '{rules.ROLE_PATTERN}') AS role FROM (SELECT id, {norm('title')} AS t FROM fx_notices))", N)
def editorial_from_match(spark, d):
    n = fixture(spark, d, N).select("id", text.normalize(F.col("title")).alias("t"))
    return n.select("id", F.when(classify.role_match(F.col("t")), "approved").when(F.col("t").contains("psicolog"), "pending").otherwise("hidden").alias("editorial_status"))


NON_SQL = f"({has_sql('t', rules.NON_OPPORTUNITY_TITLES)} OR {has_sql('u', rules.NON_OPPORTUNITY_TITLES)} OR {has_sql('dd', rules.NON_OPPORTUNITY_CONTENT)} OR t IN ('bandi di concorso', 'concorsi', 'concorsi e selezioni') OR starts_with(t, 'bandi di concorso ') OR starts_with(t, 'concorsi '))"
UNDATED_SQL = f"(st0 = 'review' AND deadline IS NULL AND (contains(source_url, '?s=') OR contains(official_url, '?s=') OR {has_sql('t', rules.FOLLOWUP_TITLES)} OR {has_sql('t', rules.NON_OPPORTUNITY_TITLES)} OR {has_sql('u', rules.NON_OPPORTUNITY_TITLES)} OR t IN ('bandi di concorso', 'concorsi', 'concorsi e selezioni') OR starts_with(t, 'bandi di concorso ') OR starts_with(t, 'concorsi ')))"
#: Rows with a source's url and the stored status, and normalised texts.
L = f"WITH w AS (SELECT n.*, s.base_url AS source_url, CASE WHEN deadline IS NULL THEN 'review' ELSE stored_status END AS st0, {norm('n.title')} AS t, {norm('n.official_url')} AS u, {norm('n.description')} AS dd, {STATUS_SQL} AS st FROM fx_notices n LEFT JOIN fx_sources s ON n.source_id = s.id) "


def _stored(spark, d) -> DataFrame:
    s = fixture(spark, d, S).select(F.col("id").alias("sid"), F.col("base_url").alias("source_url"))
    n = fixture(spark, d, N).withColumn("status", F.when(F.col("deadline").isNull(), "review").otherwise(F.col("stored_status")))
    return n.join(s, F.col("source_id") == F.col("sid"), "left").select("id", "source_id", "title", "description", "official_url", "source_url", "status", "deadline", "editorial_status", "editorial_notes")


@query("undated_review_rule", L + f"SELECT id, {UNDATED_SQL} AS hit FROM w", N, S)
def undated_review_rule(spark, d):
    n = _stored(spark, d).withColumns({"t": text.normalize(F.col("title")), "u": text.normalize(F.col("official_url"))})
    return n.select("id", lifecycle.undated_review(F.col("status"), F.col("deadline"), F.col("t"), F.col("official_url"), F.col("u"), F.col("source_url")).alias("hit"))


@query("non_opportunity_rule", L + f"SELECT id, {NON_SQL} AS hit FROM w", N, S)
def non_opportunity_rule(spark, d):
    n = fixture(spark, d, N).select("id", *[text.normalize(F.col(c)).alias(c) for c in ("title", "official_url", "description")])
    return n.select("id", lifecycle.non_opportunity(F.col("title"), F.col("official_url"), F.col("description")).alias("hit"))


@query("append_note_once", f"SELECT id, CASE WHEN coalesce(editorial_notes, '') = '' THEN '{rules.NOTE_EXPIRED}' WHEN contains(editorial_notes, '{rules.NOTE_EXPIRED}') THEN editorial_notes ELSE editorial_notes || chr(10) || '{rules.NOTE_EXPIRED}' END AS notes FROM fx_notices", N)
def append_note_once(spark, d):
    return fixture(spark, d, N).select("id", lifecycle.append_note(F.col("editorial_notes"), rules.NOTE_EXPIRED).alias("notes"))


AUTO = f"'{rules.NOTE_EXPIRED}'"
LIFE_SQL = L + f""", a AS (SELECT *, deadline IS NULL AND editorial_status = 'approved' AND {UNDATED_SQL} AS undated, coalesce(deadline IS NOT NULL AND st <> 'closed' AND editorial_status = 'hidden' AND editorial_notes = {AUTO}, false) AS restored, {NON_SQL} AS non FROM w),
 b AS (SELECT *, CASE WHEN restored THEN 'approved' ELSE editorial_status END AS es, CASE WHEN NOT restored THEN editorial_notes END AS en FROM a),
 c AS (SELECT *, deadline IS NOT NULL AND es = 'approved' AND non AS hide_non, deadline IS NOT NULL AND es = 'approved' AND NOT non AND st = 'closed' AS hide_old FROM b),
 f AS (SELECT id, source_id, deadline, description, official_url, source_url, CASE WHEN deadline IS NULL THEN st0 ELSE st END AS status, CASE WHEN undated OR hide_non OR hide_old THEN 'hidden' ELSE es END AS editorial_status,
  CASE WHEN NOT (undated OR hide_non OR hide_old) THEN en ELSE concat(CASE WHEN coalesce(en, '') = '' THEN '' ELSE en || chr(10) END, CASE WHEN undated THEN '{rules.NOTE_UNDATED}' WHEN hide_non THEN '{rules.NOTE_NON_OPPORTUNITY}' ELSE {AUTO} END) END AS editorial_notes,
  CAST(undated AS INT) + CAST(deadline IS NOT NULL AND st0 <> st AS INT) + CAST(restored AS INT) + CAST(hide_non AS INT) + CAST(hide_old AS INT) AS n_changes FROM c),
 g AS (SELECT *, editorial_status = 'approved' AND NOT contains(official_url, '?s=') AND {NORMALIZED_SQL.format('official_url')} <> {NORMALIZED_SQL.format('source_url')} AS counts, {NORMALIZED_SQL.format('official_url')} AS k FROM f),
 h AS (SELECT *, coalesce(counts, false) AND row_number() OVER (PARTITION BY source_id, k, coalesce(counts, false) ORDER BY status IN ('open', 'closing_soon') DESC, deadline IS NOT NULL DESC, deadline DESC NULLS LAST, length(coalesce(description, '')) DESC, id) > 1 AS extra FROM g)
 SELECT id, status, CASE WHEN extra THEN 'hidden' ELSE editorial_status END AS editorial_status, CASE WHEN extra THEN '{rules.NOTE_URL_DUPLICATE}' ELSE editorial_notes END AS editorial_notes, n_changes + CAST(extra AS INT) AS n_changes FROM h"""


@query("refresh_lifecycle", LIFE_SQL, N, S)
def refresh_lifecycle(spark, d):
    return lifecycle.refresh_lifecycle(_stored(spark, d), as_of()).select("id", "status", "editorial_status", "editorial_notes", "n_changes")


def _recheck(name: str, hide, sql: str):
    @query(name, f"SELECT id, CASE WHEN {sql} THEN 'hidden' ELSE editorial_status END AS editorial_status {FOCUS_FROM}", N)
    def run(spark, d):
        """Rows that no longer pass a family's rule are hidden."""
        n = fixture(spark, d, N).select("id", "title", "official_url", "editorial_status", text.normalize(F.col("title")).alias("t"), text.normalize(F.concat_ws(" ", "title", "official_url")).alias("tu"), text.normalize(F.col("description")).alias("dd"))
        return n.select("id", F.when(hide(), "hidden").otherwise(F.col("editorial_status")).alias("editorial_status"))

    return run


_approved = lambda: F.col("editorial_status") == "approved"
DOCUMENT_SQL = f"({PSY_SQL} AND {has_sql('t', rules.DOCUMENT_TERMS)} AND NOT {has_sql('t', rules.SKIP_DOCUMENT_TERMS)})".replace("(t,", "(dd,")
ARTIFACT_SQL = f"(regexp_matches(lower(trim(official_url)), '^(mailto:|tel:)') OR regexp_matches(t, '^(telefono|email)') OR {STRUCTURAL_SQL.format(label='title', href='official_url')} OR NOT ({DIRECT_SQL} OR ({has_sql('t', rules.MULTI_PROFILE)} AND {DOCUMENT_SQL})))"
_recheck("hide_parser_artifacts", lambda: _approved() & classify.parser_artifact(F.col("title"), F.col("official_url"), F.col("t"), F.col("dd")), f"editorial_status = 'approved' AND {ARTIFACT_SQL}")
_recheck("hide_unfocused", lambda: _approved() & ~classify.focused_match(F.col("t"), F.col("tu"), F.col("dd")), f"editorial_status = 'approved' AND NOT {FOCUSED_SQL}")
_recheck("hide_non_primary", lambda: (F.col("editorial_status") != "hidden") & ~classify.primary_opportunity(F.col("t")), f"editorial_status <> 'hidden' AND NOT ({PRIMARY_SQL})")


@query("retire_demo", "SELECT 'notice' AS kind, n.id, NULL AS status FROM fx_notices n WHERE NOT EXISTS (SELECT 1 FROM fx_sources s WHERE s.id = n.source_id AND s.source_type = 'third-sector-hub') UNION ALL SELECT 'source', id, CASE WHEN source_type = 'third-sector-hub' THEN 'retired' ELSE status END FROM fx_sources", N, S)
def retire_demo(spark, d):
    """Notices of demo sources go; those sources stay, as retired."""
    s = fixture(spark, d, S)
    is_demo = F.col("source_type") == "third-sector-hub"
    demo = s.where(is_demo).select(F.col("id").alias("sid"))
    left = fixture(spark, d, N).join(demo, F.col("source_id") == F.col("sid"), "left_anti").select(F.lit("notice").alias("kind"), "id", F.lit(None).cast("string").alias("status"))
    return left.unionByName(s.select(F.lit("source").alias("kind"), "id", F.when(is_demo, "retired").otherwise(F.col("status")).alias("status")))


@query("editorial_actions", "SELECT id, 'title' AS field, title AS old_value, title || ' *' AS new_value FROM fx_notices WHERE editorial_status = 'pending' UNION ALL SELECT id, 'editorial_status', editorial_status, 'approved' FROM fx_notices WHERE editorial_status = 'pending' AND is_featured", N)
def editorial_actions(spark, d):
    n = fixture(spark, d, N)
    edits = n.where("editorial_status = 'pending'").select("id", F.concat("title", F.lit(" *")).alias("title"), F.when(F.col("is_featured"), "approved").alias("editorial_status"))
    return lifecycle.apply_edits(n, edits, ("title", "editorial_status"))[1]


@query("source_catalog_sync", "SELECT coalesce(n.name, o.name) AS name, coalesce(n.source_type, o.source_type) AS source_type, coalesce(o.status, 'catalogued') AS status FROM (SELECT name, source_type, status FROM fx_sources WHERE status <> 'retired') o FULL JOIN (SELECT name, source_type || '-v2' AS source_type FROM fx_sources WHERE last_success_at IS NOT NULL) n ON o.name = n.name", S)
def source_catalog_sync(spark, d):
    """Catalogue fields of new definitions win; the operational status is never reset."""
    s = fixture(spark, d, S)
    old = s.where("status <> 'retired'").select("name", F.col("source_type").alias("old_type"), "status")
    new = s.where("last_success_at is not null").select("name", F.concat("source_type", F.lit("-v2")).alias("new_type"))
    return old.join(new, "name", "full_outer").select("name", F.coalesce("new_type", "old_type").alias("source_type"), F.coalesce("status", F.lit("catalogued")).alias("status"))


# Telemetry and quality


@query("stale_runs", f"SELECT id, CASE WHEN s THEN 'failed' ELSE status END AS status, CASE WHEN s THEN 'Esecuzione interrotta' ELSE error_message END AS error_message FROM (SELECT *, status = 'running' AND started_at < (SELECT max(started_at) FROM fx_runs) - INTERVAL 30 MINUTE AS s FROM fx_runs)", R)
def stale_runs(spark, d):
    runs = fixture(spark, d, R)
    latest = runs.agg(F.max("started_at").alias("latest"))
    return telemetry.stale_runs(runs.crossJoin(F.broadcast(latest)), F.col("latest")).select("id", "status", "error_message")


@query("run_tracking", "SELECT source_id, count(*) AS attempts, CAST(sum(created_count) AS BIGINT) AS created, max(started_at) FILTER (WHERE status = 'success') AS last_success_at, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'success' END AS status FROM fx_runs GROUP BY source_id", R)
def run_tracking(spark, d):
    return fixture(spark, d, R).groupBy("source_id").agg(F.count("*").alias("attempts"), F.sum("created_count").alias("created"), F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success_at"), F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("success").alias("status"))


@query("telemetry_lines_sink", "SELECT id, concat('{\"source_id\":', source_id, ',\"status\":\"', status, '\"', CASE WHEN error_message IS NULL THEN '' ELSE ',\"error\":\"' || substr(error_message, 1, 240) || '\"' END, '}') AS line FROM fx_runs", R)
def telemetry_lines_sink(spark, d):
    """One JSON line for each attempt, in the shared folder and read back."""
    error = F.substring(F.regexp_replace("error_message", r"\s+", " "), 1, 240).alias("error")
    lines = fixture(spark, d, R).select("id", F.to_json(F.struct("source_id", "status", error)).alias("line"))
    out = snapshot.scratch(spark, "telemetry")
    lines.select(F.concat_ws("\t", F.col("id").cast("string"), "line")).write.text(out)
    return spark.read.text(out).select(F.split("value", "\t", 2)[0].cast("long").alias("id"), F.split("value", "\t", 2)[1].alias("line"))


@query("completeness_check", "WITH t AS (SELECT id, source_id, created_count + 1 AS pages, skipped_count + 1 AS seen, updated_count AS records, created_count AS acts FROM fx_runs WHERE status <> 'failed') SELECT id, source_id, 'incomplete' AS rule FROM t WHERE pages > seen UNION ALL SELECT id, source_id, 'empty' FROM t WHERE seen > 0 AND records = 0 UNION ALL SELECT id, source_id, 'unreadable' FROM t WHERE records > 0 AND acts = 0", R)
def completeness_check(spark, d):
    """Scans that reached fewer pages than there are, found nothing, or nothing that could be read."""
    runs = fixture(spark, d, R).where("status <> 'failed'")
    return telemetry.completeness(runs.select("id", "source_id", (F.col("created_count") + 1).alias("pages"), (F.col("skipped_count") + 1).alias("seen"), F.col("updated_count").alias("records"), F.col("created_count").alias("acts")))


@query("snapshot_export", f"WITH {PUBLIC_SQL} SELECT 'notices' AS kind, CAST(id AS VARCHAR) AS id, title AS text, CAST(NULL AS VARCHAR) AS private FROM pn UNION ALL SELECT 'sources', CAST(id AS VARCHAR), name || ' ' || status, NULL FROM ps UNION ALL SELECT 'attachments', id, title || ' ' || url, NULL FROM pa UNION ALL SELECT 'metadata', 'attachments_count', CAST(count(*) AS VARCHAR), NULL FROM pa UNION ALL SELECT 'metadata', 'generated_at', '1998-06-01T12:00:00Z', NULL UNION ALL SELECT 'metadata', 'notices_count', CAST(count(*) AS VARCHAR), NULL FROM pn UNION ALL SELECT 'metadata', 'schema_version', '1', NULL UNION ALL SELECT 'metadata', 'sources_count', CAST(count(*) AS VARCHAR), NULL FROM ps", N, S, A)
def snapshot_export(spark, d):
    """The three tables and their metadata, but for the digest, which content_digest has."""
    tables = _public(spark, d)
    tree = identity.kept(snapshot.hash_tree(tables, SNAPSHOT_COLUMNS), "tree")
    meta = snapshot.metadata(tree, "1998-06-01T12:00:00Z").where("key <> 'content_digest'")
    row = lambda kind, rows, i, text, private: rows.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), text.alias("text"), private.cast("string").alias("private"))
    notices = row("notices", tables["notices"], "id", F.col("title"), F.col("editorial_notes"))
    sources = row("sources", tables["sources"], "id", F.concat_ws(" ", "name", "status"), F.col("last_success_at"))
    held = row("attachments", tables["attachments"], "id", F.concat_ws(" ", "title", "url"), F.lit(None))
    return notices.unionByName(sources).unionByName(held).unionByName(row("metadata", meta, "key", F.col("value"), F.lit(None)))


@query("snapshot_validate", "SELECT 'notices_only_approved' AS rule, count(*) FILTER (WHERE editorial_status <> 'approved') AS violations FROM fx_notices UNION ALL SELECT 'notices_title_missing', count(*) FILTER (WHERE coalesce(title, '') = '') FROM fx_notices UNION ALL SELECT 'notices_url_credentials', count(*) FILTER (WHERE regexp_matches(official_url, '://[^/?#]*@')) FROM fx_notices UNION ALL SELECT 'notices_private', count(*) FILTER (WHERE editorial_notes IS NOT NULL) FROM fx_notices UNION ALL SELECT 'sources_name_missing', count(*) FILTER (WHERE coalesce(name, '') = '') FROM fx_sources UNION ALL SELECT 'sources_url_credentials', count(*) FILTER (WHERE regexp_matches(base_url, '://[^/?#]*@')) FROM fx_sources UNION ALL SELECT 'sources_private', count(*) FILTER (WHERE last_success_at IS NOT NULL) FROM fx_sources UNION ALL SELECT 'attachments_url_credentials', count(*) FILTER (WHERE regexp_matches(url, '://[^/?#]*@')) FROM fx_attachments UNION ALL SELECT 'attachments_private', 0", N, S, A)
def snapshot_validate(spark, d):
    """The suite on tables that were not exported, so that it finds something."""
    return snapshot.violations({"notices": fixture(spark, d, N), "sources": fixture(spark, d, S), "attachments": fixture(spark, d, A)})


@query("snapshot_publish", f"WITH {PUBLIC_SQL}, b AS (SELECT 'notices' AS table_name, substr(sha256(CAST(id AS VARCHAR)), 1, 2) AS bucket, id = (SELECT min(id) FROM pn) AS touched FROM pn UNION ALL SELECT 'sources', substr(sha256(CAST(id AS VARCHAR)), 1, 2), false FROM ps UNION ALL SELECT 'attachments', substr(sha256(CAST(id AS VARCHAR)), 1, 2), false FROM pa) SELECT table_name, count(*) AS n_rows, count(DISTINCT bucket) AS first_written, 0 AS again_written, count(DISTINCT bucket) FILTER (WHERE touched) AS changed_written FROM b GROUP BY table_name", N, S, A)
def snapshot_publish(spark, d):
    """Published; the same rows again, in another order, change nothing; one notice with another title changes one bucket."""
    tables = _public(spark, d, lambda rows, name: identity.kept(rows, f"public-{name}"))
    target = snapshot.Publication(spark, snapshot.scratch(spark, "published"))
    smallest = tables["notices"].agg(F.min("id").alias("least"))
    other = tables["notices"].join(smallest.hint("broadcast")).withColumn("title", F.when(F.col("id") == F.col("least"), F.concat("title", F.lit(" (rettifica)"))).otherwise(F.col("title"))).drop("least")
    versions = (tables, {name: rows.repartition("id") for name, rows in tables.items()}, tables | {"notices": other})
    written = [identity.kept(target.publish(v, SNAPSHOT_COLUMNS), "changes").groupBy("table_name").agg(F.count("*").alias("w")) for v in versions]
    out = None
    for name, rows in tables.items():
        n = target.current(name, rows.schema).agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    for w, c in zip(written, ("first_written", "again_written", "changed_written"), strict=True):
        out = out.join(w.withColumnRenamed("w", c).hint("merge"), "table_name", "left")
    return out.fillna(0)


@query("refresh_guard", "SELECT (SELECT count(*) FROM fx_runs WHERE status = 'success') > 0 OR (SELECT count(*) FROM fx_notices WHERE editorial_status = 'approved') > 0 AS publish", R, N)
def refresh_guard(spark, d):
    succeeded = fixture(spark, d, R).agg((F.count_if(F.col("status") == "success") > 0).alias("a"))
    approved = fixture(spark, d, N).agg((F.count_if(F.col("editorial_status") == "approved") > 0).alias("b"))
    return succeeded.crossJoin(F.broadcast(approved)).select((F.col("a") | F.col("b")).alias("publish"))


@query("seed_fixture_load", f"SELECT id, CASE WHEN relevance_score >= 35 THEN 'approved' ELSE 'pending' END AS editorial_status FROM fx_notices", N)
def seed_fixture_load(spark, d):
    """Sample rows are approved where their relevance is high or medium."""
    n = fixture(spark, d, N)
    return n.select("id", F.when(classify.relevance_label(F.col("relevance_score")).isin("alta", "media"), "approved").otherwise("pending").alias("editorial_status"))
