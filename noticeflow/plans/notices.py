"""Queries over notices: scans, projections, filters, classification, sorting, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, rules, text, urls
from ..operators import classify, search
from .base import AS_OF_SQL, any_sql, has_sql, norm, query
from .fixtures import AS_OF, fixture

N = "fx_notices"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_notices with search text, areas array and the status at AS_OF."""
    n = fixture(spark, sf_dir, N)
    return n.withColumns({"areas": text.csv_array("areas_csv"), "status": dates.infer_status(F.col("deadline"), as_of()), "search_text": text.search_text("title", "description", "organization", "region", "category", text.csv_array("areas_csv"))})


#: The same for DuckDB, as a table `e`.
STATUS_SQL = f"CASE WHEN deadline IS NULL THEN 'review' WHEN deadline < {AS_OF_SQL} THEN 'closed' WHEN deadline < {AS_OF_SQL} + INTERVAL 8 DAY THEN 'closing_soon' ELSE 'open' END"
E = f"""WITH e AS (SELECT *, list_filter(string_split(areas_csv, ','), lambda x: x <> '') AS areas, {STATUS_SQL} AS status,
 {norm("concat_ws(' ', title, description, organization, region, category, replace(areas_csv, ',', ' '))")} AS search_text FROM fx_notices) """


@query("scan_notices", "SELECT id, title, editorial_status FROM fx_notices WHERE editorial_status = 'pending'", N)
def scan_notices(spark, d):
    return fixture(spark, d, N).where("editorial_status = 'pending'").select("id", "title", "editorial_status")


@query("point_lookup", "SELECT n.id, n.title, count(a.id) AS n_attachments FROM fx_notices n LEFT JOIN fx_attachments a ON a.notice_id = n.id WHERE n.id = 5 AND n.editorial_status = 'approved' GROUP BY n.id, n.title", N, "fx_attachments")
def point_lookup(spark, d):
    n = fixture(spark, d, N).where("id = 5 and editorial_status = 'approved'").select("id", "title")
    a = fixture(spark, d, "fx_attachments").select("notice_id", F.col("id").alias("aid"))
    return n.join(a, F.col("notice_id") == F.col("id"), "left").groupBy("id", "title").agg(F.count("aid").alias("n_attachments"))


@query("scan_sources", "SELECT id, name, source_type, status FROM fx_sources", "fx_sources")
def scan_sources(spark, d):
    return fixture(spark, d, "fx_sources").select("id", "name", "source_type", "status")


@query("scan_import_runs", "SELECT id, source_id, status, started_at, row_number() OVER (ORDER BY started_at DESC, id) AS position FROM fx_runs QUALIFY position <= 100", "fx_runs")
def scan_import_runs(spark, d):
    """The hundred latest runs; a top-k report."""
    from pyspark.sql import Window

    latest = fixture(spark, d, "fx_runs").select("id", "source_id", "status", "started_at").orderBy(F.col("started_at").desc(), "id").limit(100)
    return latest.withColumn("position", F.row_number().over(Window.orderBy(F.col("started_at").desc(), "id")).cast("long"))


@query("list_item", "SELECT n.id, n.title, n.organization, n.entity_type, n.region, n.province, n.category, n.areas_csv, n.deadline, n.relevance_score, n.is_featured, n.official_url, s.name AS source_name FROM fx_notices n LEFT JOIN fx_sources s ON n.source_id = s.id", N, "fx_sources")
def list_item(spark, d):
    s = fixture(spark, d, "fx_sources").select(F.col("id").alias("sid"), F.col("name").alias("source_name"))
    n = fixture(spark, d, N).select("id", "title", "organization", "entity_type", "region", "province", "category", "areas_csv", "deadline", "relevance_score", "is_featured", "official_url", "source_id")
    return n.join(s, F.col("source_id") == F.col("sid"), "left").drop("sid", "source_id")


@query("detail_item", "SELECT n.id, n.title, n.description, n.published_at, coalesce(string_agg(a.title || '|' || a.url, ';' ORDER BY a.title, a.url), '') AS attachments FROM fx_notices n LEFT JOIN fx_attachments a ON a.notice_id = n.id GROUP BY ALL", N, "fx_attachments")
def detail_item(spark, d):
    a = fixture(spark, d, "fx_attachments").groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("title", "url"))).alias("l"))
    spelled = F.array_join(F.transform("l", lambda x: F.concat_ws("|", x["title"], x["url"])), ";")
    n = fixture(spark, d, N).select("id", "title", "description", "published_at")
    return n.join(a, F.col("id") == F.col("notice_id"), "left").select("id", "title", "description", "published_at", F.coalesce(spelled, F.lit("")).alias("attachments"))


@query("join_attachments", "SELECT n.id, count(a.id) AS n FROM fx_notices n LEFT JOIN fx_attachments a ON a.notice_id = n.id GROUP BY n.id", N, "fx_attachments")
def join_attachments(spark, d):
    a = fixture(spark, d, "fx_attachments").groupBy("notice_id").agg(F.count("*").alias("n"))
    return fixture(spark, d, N).select("id").join(a, F.col("id") == F.col("notice_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("join_source", "SELECT n.id, s.name, s.region AS source_region FROM fx_notices n LEFT JOIN fx_sources s ON n.source_id = s.id", N, "fx_sources")
def join_source(spark, d):
    s = fixture(spark, d, "fx_sources").select(F.col("id").alias("sid"), "name", F.col("region").alias("source_region"))
    return fixture(spark, d, N).select("id", "source_id").join(s, F.col("source_id") == F.col("sid"), "left").select("id", "name", "source_region")


@query("normalize", f"SELECT doc_id, md5({norm('text')}) AS norm_md5 FROM documents")
def normalize(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("norm_md5"))


@query("search_text", E + "SELECT id, search_text FROM e", N)
def search_text(spark, d):
    return enriched(spark, d).select("id", "search_text")


@query("clean_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_md5 FROM documents")
def clean_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("clean_md5"))


def _bucket_sql(b: str) -> str:
    within = {"7d": f"deadline BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + INTERVAL 7 DAY", "30d": f"deadline BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + INTERVAL 30 DAY", "future": f"deadline >= {AS_OF_SQL}", "past": f"deadline < {AS_OF_SQL}"}
    return f"SELECT id, '{b}' AS bucket FROM fx_notices WHERE " + ("deadline IS NULL" if b == "missing" else f"deadline IS NOT NULL AND {within[b]}")


@query("deadline_bucket", " UNION ALL ".join(_bucket_sql(b) for b in ("missing", "7d", "30d", "future", "past")), N)
def deadline_bucket(spark, d):
    buckets = ("missing", "7d", "30d", "future", "past")
    found = F.filter(F.array(*[F.when(dates.deadline_bucket(F.col("deadline"), as_of(), b), F.lit(b)) for b in buckets]), lambda x: x.isNotNull())
    return fixture(spark, d, N).select("id", F.explode(found).alias("bucket"))


FILTER = search.Params(q="psicologo pubblico", include_review=True)
LIVE_SQL = "editorial_status = 'approved' AND status IN ('open', 'closing_soon', 'review') AND contains(search_text, 'psicologo') AND contains(search_text, 'pubblico')"


@query("filter_notices", E + f"SELECT id, title, status FROM e WHERE {LIVE_SQL} AND region = 'EUROPE' AND list_contains(areas, 'anziani') IS NOT NULL", N)
def filter_notices(spark, d):
    p = search.Params(q="Psicologo  PUBBLICO", region="EUROPE", include_review=True)
    return search.filter_notices(enriched(spark, d), p, as_of()).select("id", "title", "status")


@query("default_status_rule", E + "SELECT id, 'live' AS rule FROM e WHERE status IN ('open', 'closing_soon') UNION ALL SELECT id, 'with_review' FROM e WHERE status IN ('open', 'closing_soon', 'review') UNION ALL SELECT id, 'past' FROM e", N)
def default_status_rule(spark, d):
    cases = {"live": search.Params(), "with_review": search.Params(include_review=True), "past": search.Params(deadline="past")}
    found = F.array_compact(F.array(*[F.when(search.default_status_rule(p), F.lit(k)) for k, p in cases.items()]))
    return enriched(spark, d).select("id", F.explode(found).alias("rule"))


@query("text_match_all", E + "SELECT id FROM e WHERE contains(search_text, 'psico') AND contains(search_text, 'posti')", N)
def text_match_all(spark, d):
    return enriched(spark, d).where(classify.matches_all(F.col("search_text"), "Psicò posti")).select("id")


@query("area_contains", E + "SELECT id FROM e WHERE list_contains(areas, 'anziani')", N)
def area_contains(spark, d):
    return enriched(spark, d).where(F.array_contains("areas", "anziani")).select("id")


@query("search_page", E + "SELECT id, title, deadline FROM e WHERE editorial_status = 'approved' AND status IN ('open', 'closing_soon') AND contains(search_text, 'psicologo') ORDER BY deadline NULLS LAST, id LIMIT 20", N)
def search_page(spark, d):
    found = search.filter_notices(enriched(spark, d), search.Params(q="psicologo"), as_of())
    return search.page(found).select("id", "title", "deadline")


SORT_SQL = {"deadline": "deadline ASC NULLS LAST", "recent": "coalesce(published_at, updated_at) DESC NULLS LAST", "relevance": "relevance_score DESC NULLS LAST, is_featured DESC NULLS LAST", "organization": "lower(organization) ASC", "region": "lower(coalesce(region, '')) ASC"}


def _sort(name):
    @query(f"sort_{name}", f"SELECT id, row_number() OVER (ORDER BY {SORT_SQL[name]}, id) AS position FROM fx_notices QUALIFY position <= 100", N)
    def run(spark, d):
        """First page of the order; a top-k report."""
        from pyspark.sql import Window

        top = search.page(fixture(spark, d, N), name, 100)
        return top.withColumn("position", F.row_number().over(Window.orderBy(*search.SORTS[name](), "id")).cast("long")).select("id", "position")

    return run


for _name in SORT_SQL:
    _sort(_name)


@query("paginate", "SELECT id, deadline FROM fx_notices ORDER BY deadline ASC NULLS LAST, id LIMIT 20 OFFSET 40", N)
def paginate(spark, d):
    return search.page(fixture(spark, d, N), "deadline", 20, 40).select("id", "deadline")


@query("total_count", E + f"SELECT count(*) AS n FROM e WHERE {LIVE_SQL}", N)
def total_count(spark, d):
    return search.filter_notices(enriched(spark, d), FILTER, as_of()).agg(F.count("*").alias("n"))


def _facet_sql(conditions: dict[str, str]) -> str:
    parts = []
    for f, (_, out) in search.FACETS.items():
        value = "unnest(areas)" if f == "area" else f
        where = " AND ".join(c for k, c in conditions.items() if k not in out) or "true"
        parts.append(f"SELECT '{f}' AS facet, value, count(*) AS n FROM (SELECT {value} AS value FROM e WHERE {where}) WHERE value IS NOT NULL AND value <> '' GROUP BY value")
    return " UNION ALL ".join(parts)


@query("facets", E + _facet_sql({}), N)
def facets(spark, d):
    return search.facets(enriched(spark, d))


CONTEXT = {"approved": "editorial_status = 'approved'", "default": "status IN ('open', 'closing_soon', 'review')", "q": "contains(search_text, 'psicologo')", "region": "region = 'EUROPE'", "province": "province = 'JAPAN'", "area": "list_contains(areas, 'anziani')"}


@query("contextual_facets", E + f", c AS ({_facet_sql(CONTEXT)}) SELECT * FROM c UNION ALL SELECT facet, value, 0 AS n FROM (VALUES ('region', 'EUROPE'), ('province', 'JAPAN'), ('area', 'anziani')) AS w(facet, value) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.facet = w.facet AND c.value = w.value)", N)
def contextual_facets(spark, d):
    return search.contextual_facets(enriched(spark, d), search.Params(q="psicologo", region="EUROPE", province="JAPAN", area="anziani", include_review=True), as_of())


TEXT = norm("concat_ws(chr(10), title, description)")


def _case_all(t: str, pack, default: str) -> str:
    listed = ", ".join(f"CASE WHEN {any_sql(t, terms)} THEN '{k}' END" for k, terms in pack.items())
    return f"coalesce(nullif(array_to_string(list_filter([{listed}], lambda x: x IS NOT NULL), ','), ''), '{default}')"


CATEGORY_SQL = "CASE " + " ".join(f"WHEN {any_sql('t', terms)} THEN '{k}'" for k, terms in rules.CATEGORIES.items()) + f" ELSE '{rules.OTHER}' END"
GROUPS_SQL = ["greatest(0, " + ", ".join(f"CASE WHEN contains(t, '{text.plain(k)}') THEN {w} ELSE 0 END" for k, w in g.items()) + ")" for g in rules.PSYCHOLOGY_GROUPS]
ROLE_SQL = rf"regexp_matches(t, '{rules.ROLE_PATTERN}')"
SCORE_SQL = f"CAST(least(100, CASE WHEN {ROLE_SQL} THEN greatest(70, {' + '.join(GROUPS_SQL)}) ELSE {' + '.join(GROUPS_SQL)} END + CASE WHEN contains(t, 'psicolog') AND contains(t, 'albo') THEN 20 ELSE 0 END + CASE WHEN contains(t, 'psicolog') AND (contains(t, 'minori') OR contains(t, 'salute mentale')) THEN 10 ELSE 0 END) AS INT)"
T = f"WITH x AS (SELECT *, {TEXT} AS t FROM fx_notices) "


def _worded(spark, d) -> DataFrame:
    return fixture(spark, d, N).withColumn("t", text.normalize(F.concat_ws("\n", "title", "description")))


@query("contains_any", f"SELECT doc_id, {any_sql('t', ('The', 'and', 'with', 'été', 'licensed under'))} AS hit FROM (SELECT doc_id, {norm('text')} AS t FROM documents)")
def contains_any(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.normalize(F.col("text")).alias("t"))
    return docs.select("doc_id", text.contains_any(F.col("t"), ("The", "and", "with", "été", "licensed under")).alias("hit"))


@query("infer_category", T + f"SELECT id, {CATEGORY_SQL} AS category_found FROM x", N)
def infer_category(spark, d):
    return _worded(spark, d).select("id", classify.infer_category(F.col("t")).alias("category_found"))


@query("detect_areas", T + f"SELECT id, {_case_all('t', rules.AREAS, rules.OTHER)} AS areas_found FROM x", N)
def detect_areas(spark, d):
    return _worded(spark, d).select("id", F.array_join(classify.detect_areas(F.col("t")), ",").alias("areas_found"))


@query("extract_requirements", T + f"SELECT id, {_case_all('t', rules.REQUIREMENTS, rules.UNDETERMINED)} AS requirements FROM x", N)
def extract_requirements(spark, d):
    return _worded(spark, d).select("id", F.array_join(classify.extract_requirements(F.col("t")), ",").alias("requirements"))


@query("relevance_groups", T + "SELECT id, " + ", ".join(f"CAST({g} AS INT) AS g{i}" for i, g in enumerate(GROUPS_SQL)) + " FROM x", N)
def relevance_groups(spark, d):
    return _worded(spark, d).select("id", *[g.cast("int").alias(f"g{i}") for i, g in enumerate(classify.group_scores(F.col("t")))])


@query("relevance_score", T + f"SELECT id, {SCORE_SQL} AS score FROM x", N)
def relevance_score(spark, d):
    return _worded(spark, d).select("id", classify.relevance_score(F.col("t")).alias("score"))


LABEL_SQL = "CASE WHEN {0} >= 70 THEN 'alta' WHEN {0} >= 35 THEN 'media' WHEN {0} >= 15 THEN 'bassa' ELSE 'esclusa' END"


@query("relevance_label", "SELECT id, " + LABEL_SQL.format("relevance_score") + " AS label FROM fx_notices", N)
def relevance_label(spark, d):
    return fixture(spark, d, N).select("id", classify.relevance_label(F.col("relevance_score")).alias("label"))


@query("classify", T + f", y AS (SELECT *, {SCORE_SQL} AS score FROM x) SELECT id, {CATEGORY_SQL} AS category, {_case_all('t', rules.AREAS, rules.OTHER)} AS areas, {_case_all('t', rules.REQUIREMENTS, rules.UNDETERMINED)} AS requirements, score, {LABEL_SQL.format('score')} AS relevance FROM y", N)
def classify_query(spark, d):
    c = classify.classify(fixture(spark, d, N), "title", "description")
    return c.select("id", F.col("category_found").alias("category"), F.array_join("areas_found", ",").alias("areas"), F.array_join("requirements_found", ",").alias("requirements"), F.col("relevance_score_found").alias("score"), F.col("relevance_found").alias("relevance"))


QUALIFIED_SQL = f"regexp_matches(t, '{rules.QUALIFYING_PATTERN}')"
DIRECT_SQL = f"({ROLE_SQL} OR {QUALIFIED_SQL} OR (regexp_matches(t, '{rules.CONTEXT_PATTERN}') AND regexp_matches(t, '{rules.CONTEXTUAL_PATTERN}')))"
PSY_SQL = f"({DIRECT_SQL} OR contains(t, 'neuropsicolog'))"
RELEVANT_SQL = f"({PSY_SQL} AND ({has_sql('t', rules.OPPORTUNITY_TERMS)} OR {ROLE_SQL}))"


def _flag(name: str, column, sql: str):
    @query(name, T + f"SELECT id, {sql} AS hit FROM x", N)
    def run(spark, d):
        return _worded(spark, d).select("id", column().alias("hit"))

    return run


t = F.col
_flag("direct_match", lambda: classify.direct_match(t("t")), DIRECT_SQL)
_flag("role_match", lambda: classify.role_match(t("t")), ROLE_SQL)
_flag("relevant_opportunity", lambda: classify.relevant_opportunity(t("t")), RELEVANT_SQL)
_flag("relevant_strict", lambda: classify.relevant_strict(t("t")), f"{RELEVANT_SQL} AND NOT {has_sql('t', rules.FOLLOWUP_CONTENT)} AND (NOT {has_sql('t', rules.SKIP_RECORD_TERMS)} OR {has_sql('t', rules.STRONG_OPPORTUNITY_TERMS)})")
_flag("followup_content", lambda: classify.followup_content(t("t")), has_sql("t", rules.FOLLOWUP_CONTENT))
_flag("psych_document", lambda: classify.psych_document(t("t")), f"{PSY_SQL} AND {has_sql('t', rules.DOCUMENT_TERMS)} AND NOT {has_sql('t', rules.SKIP_DOCUMENT_TERMS)}")
UPDATES = [x for x in rules.UPDATE_TERMS if "'" not in x]
PRIMARY_SQL = f"{PSY_SQL} AND {has_sql('t', rules.PRIMARY_TERMS)} AND NOT {has_sql('t', UPDATES)}"
_flag("primary_opportunity", lambda: classify.primary_opportunity(t("t")), PRIMARY_SQL)
_flag("text_length_gate", lambda: F.length("t").between(24, 2400), "length(t) BETWEEN 24 AND 2400")


@query("followup_title", f"SELECT id, {has_sql('t', rules.FOLLOWUP_TITLES)} AS hit FROM (SELECT id, {norm('title')} AS t FROM fx_notices)", N)
def followup_title(spark, d):
    return fixture(spark, d, N).select("id", text.normalize(F.col("title")).alias("t")).select("id", classify.followup_title(F.col("t")).alias("hit"))


TITLE_SQL = f"SELECT id, {PSY_SQL} OR ({has_sql('t', rules.MULTI_PROFILE)} AND {RELEVANT_SQL.replace('(t,', '(c,').replace('contains(t', 'contains(c')}) AS hit FROM (SELECT id, {norm('title')} AS t, {TEXT} AS c FROM fx_notices)"


@query("title_supports", TITLE_SQL, N)
def title_supports(spark, d):
    worded = _worded(spark, d).withColumn("title", text.normalize(F.col("title")))
    return worded.select("id", classify.title_supports(F.col("title"), F.col("t")).alias("hit"))


FOCUSED_SQL = f"({DIRECT_SQL.replace('(t,', '(tu,')} OR ({has_sql('t', rules.FOCUS_PROFILES)} AND {DIRECT_SQL.replace('(t,', '(dd,')}))"
FOCUS_FROM = f"FROM (SELECT *, {norm('title')} AS t, {norm("concat_ws(' ', title, official_url)")} AS tu, {norm('description')} AS dd FROM fx_notices)"


@query("focused_match", f"SELECT id, {FOCUSED_SQL} AS hit {FOCUS_FROM}", N)
def focused_match(spark, d):
    n = fixture(spark, d, N).select("id", text.normalize(F.col("title")).alias("t"), text.normalize(F.concat_ws(" ", "title", "official_url")).alias("tu"), text.normalize(F.col("description")).alias("dd"))
    return n.select("id", classify.focused_match(F.col("t"), F.col("tu"), F.col("dd")).alias("hit"))


@query("any_string_field_match", f"SELECT id, {DIRECT_SQL} AS hit FROM (SELECT id, {norm("concat_ws(' ', external_id, title, description, organization, entity_type, region, province, category)")} AS t FROM fx_notices)", N)
def any_string_field_match(spark, d):
    fields = ("external_id", "title", "description", "organization", "entity_type", "region", "province", "category")
    return fixture(spark, d, N).select("id", text.normalize(F.concat_ws(" ", *fields)).alias("t")).select("id", classify.direct_match(F.col("t")).alias("hit"))


def _direct_sql(of: str) -> str:
    return DIRECT_SQL.replace("(t,", f"({of},")


NAMED_SQL = " OR ".join(f"regexp_matches({x}, '{rules.INDIVIDUAL_PATTERN}') OR {_direct_sql(x)}" for x in ("f", "ta"))
PROFESSIONAL_SQL = f"""CASE WHEN regexp_matches(t, '{rules.REVOKED_PATTERN}') THEN NULL WHEN {NAMED_SQL} OR (contains(t, 'laurea') AND contains(t, 'psicologia')) THEN 'direct'
 WHEN (contains(dd, 'laurea in psicologia') OR contains(dd, 'lm 51')) AND (contains(dd, 'albo') OR contains(dd, 'abilitazione')) THEN 'eligible' WHEN regexp_matches(dd, '{rules.DESCRIBED_ROLE_PATTERN}') THEN 'direct'
 WHEN {_direct_sql("dd")} OR (contains(dd, 'scienze comportamentali') AND contains(dd, 'salute mentale')) THEN 'eligible' END"""


@query("professional_match", f"SELECT id, {PROFESSIONAL_SQL} AS kind FROM (SELECT *, replace(t, 'ordine degli psicologi', '') AS ta FROM (SELECT id, {norm('category')} AS f, {norm('title')} AS t, {norm('description')} AS dd FROM fx_notices))", N)
def professional_match(spark, d):
    n = fixture(spark, d, N).select("id", *(text.normalize(F.col(c)).alias(c) for c in ("category", "title", "description")))
    return n.select("id", classify.professional_match(F.col("category"), F.col("title"), F.col("description")).alias("kind"))


ENTITY_SQL = f"""CASE WHEN source_type = 'third-sector-hub' THEN 'terzo-settore' WHEN source_type = 'private-social-jobs' THEN 'privato-sociale' WHEN starts_with(o, 'comune') THEN 'comune' WHEN starts_with(o, 'regione') THEN 'regione'
 WHEN starts_with(o, 'universita') OR starts_with(o, 'politecnico') OR contains(o, 'alma mater') THEN 'universita' WHEN {" OR ".join(f"contains(o, '{x}')" for x in ("asl", "ast", "ats", "ausl", "usl", "azienda sanitaria", "arcs", "ares", "areus", "asdaa", "asrem", "asuit", "asp", "aulss", "azienda ospedaliera", "azienda zero", "estar", "irccs", "pugliasalute"))} THEN 'azienda-sanitaria' ELSE 'altro-ente-pubblico' END"""
ORGANIZATION_SQL = "concat(CASE id % 7 WHEN 0 THEN 'Comune di ' WHEN 1 THEN 'Università ' WHEN 2 THEN 'ASL ' WHEN 3 THEN 'Regione ' ELSE '' END, organization)"


@query("entity_type_infer", f"SELECT id, {ENTITY_SQL} AS entity_type FROM (SELECT id, source_type, {norm(ORGANIZATION_SQL)} AS o FROM fx_sources)", "fx_sources")
def entity_type_infer(spark, d):
    s = fixture(spark, d, "fx_sources").withColumn("o", text.normalize(F.expr(ORGANIZATION_SQL)))
    return s.select("id", classify.entity_type(F.col("source_type"), F.col("o")).alias("entity_type"))


@query("category_override", f"SELECT id, CASE WHEN contains(s, 'urgent') THEN 'concorso-pubblico' WHEN contains(s, 'low') THEN 'avviso-pubblico' ELSE {CATEGORY_SQL} END AS category FROM (SELECT id, {norm('category')} AS s, {TEXT} AS t FROM fx_notices)", N)
def category_override(spark, d):
    s = F.col("s")
    return _worded(spark, d).withColumn("s", text.normalize(F.col("category"))).select("id", F.when(s.contains("urgent"), "concorso-pubblico").when(s.contains("low"), "avviso-pubblico").otherwise(classify.infer_category(F.col("t"))).alias("category"))


@query("location_parts", "SELECT id, CASE WHEN swap THEN province ELSE region END AS region, CASE WHEN swap THEN region ELSE province END AS province FROM (SELECT id, a AS region, b AS province, a NOT IN (SELECT r_name FROM region) AND b IN (SELECT r_name FROM region) AS swap FROM (SELECT id, CASE id % 3 WHEN 0 THEN province ELSE region END AS a, CASE id % 3 WHEN 0 THEN region ELSE province END AS b FROM fx_notices))", N)
def location_parts(spark, d):
    """First two places of an array; swapped if only the second is a known region."""
    known = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("place"), F.lit(True).alias("known")).distinct()
    places = F.when(F.col("id") % 3 == 0, F.array("province", "region")).otherwise(F.array("region", "province"))
    n = fixture(spark, d, N).select("id", places.alias("p")).select("id", F.try_element_at("p", F.lit(1)).alias("a"), F.try_element_at("p", F.lit(2)).alias("b"))
    n = n.join(known.toDF("a", "a_known"), "a", "left").join(known.toDF("b", "b_known"), "b", "left")
    swap = F.col("a_known").isNull() & F.col("b_known").isNotNull()
    return n.select("id", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("region"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("province"))


@query("label_for", f"SELECT id, coalesce(l.label, k) AS label FROM (SELECT id, {CATEGORY_SQL} AS k FROM (SELECT id, {TEXT} AS t FROM fx_notices)) LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in rules.LABELS.items())}) AS l(code, label) ON l.code = k", N)
def label_for(spark, d):
    labels = spark.createDataFrame(list(rules.LABELS.items()), "code string, label string")
    coded = _worded(spark, d).select("id", classify.infer_category(F.col("t")).alias("k"))
    return coded.join(F.broadcast(labels), F.col("code") == F.col("k"), "left").select("id", F.coalesce("label", "k").alias("label"))


MONEY_SQL = "replace(printf('%,d', {0}), ',', '.')"


@query("format_fields", f"SELECT id, coalesce(strftime(deadline, '%d/%m/%Y'), 'Non indicata') AS date_text, coalesce(strftime(published_at, '%d/%m/%Y, %H:%M'), 'Non indicato') AS time_text, CASE WHEN id % 3 = 0 THEN 'Non indicato' WHEN id % 3 = 1 THEN {MONEY_SQL.format('id * 7')} || ' €' ELSE {MONEY_SQL.format('id * 7')} || '–' || {MONEY_SQL.format('id * 9')} || ' €' END AS money FROM fx_notices", N)
def format_fields(spark, d):
    """Dates, instants and amounts as people read them."""
    money = lambda c: F.translate(F.format_number(c, 0), ",", ".")
    low, high = F.when(F.col("id") % 3 != 0, F.col("id") * 7), F.when(F.col("id") % 3 == 2, F.col("id") * 9)
    amount = F.when(low.isNull() & high.isNull(), "Non indicato").otherwise(F.concat(F.concat_ws("–", money(low), money(high)), F.lit(" €")))
    return fixture(spark, d, N).select("id", F.coalesce(F.date_format("deadline", "dd/MM/yyyy"), F.lit("Non indicata")).alias("date_text"), F.coalesce(F.date_format("published_at", "dd/MM/yyyy, HH:mm"), F.lit("Non indicato")).alias("time_text"), amount.alias("money"))


@query("demo_flag", "SELECT id, source_type = 'third-sector-hub' OR contains(lower(name), '000000003') OR base_url LIKE 'https://ente1.%' AS demo FROM fx_sources", "fx_sources")
def demo_flag(spark, d):
    """Demo sources by type, name or host; here the pack's values are those of the derived table."""
    h = urls.host(F.col("base_url"))
    return fixture(spark, d, "fx_sources").select("id", ((F.col("source_type") == "third-sector-hub") | F.lower("name").contains("000000003") | (h == "ente1.example.org")).alias("demo"))


@query("adapter_family", "SELECT id, CASE WHEN status = 'retired' THEN 'retired' WHEN source_type LIKE '%json%' THEN 'json' WHEN source_type LIKE 'xml%' THEN 'xml' WHEN source_type LIKE '%hub' THEN 'hub' ELSE 'generic' END AS family FROM fx_sources", "fx_sources")
def adapter_family(spark, d):
    s = F.col("source_type")
    return fixture(spark, d, "fx_sources").select("id", F.when(F.col("status") == "retired", "retired").when(s.contains("json"), "json").when(s.startswith("xml"), "xml").when(s.endswith("hub"), "hub").otherwise("generic").alias("family"))


@query("build_notice", T + f", y AS (SELECT *, {SCORE_SQL} AS score, {STATUS_SQL} AS st FROM x) SELECT y.id, {norm('y.title')} AS normalized_title, substr(description, 1, 900) AS short_description, substr(description, 1, 420) AS summary, {CATEGORY_SQL} AS category, score, {LABEL_SQL.format('score')} AS relevance, s.organization, s.region, st AS status, CASE WHEN st = 'closed' THEN 'hidden' ELSE 'approved' END AS editorial_status, concat('Consultare la fonte ufficiale: ', s.name, '.') AS application_mode, sha256(concat_ws(chr(10), y.title, coalesce(y.description, ''), y.official_url)) AS content_hash FROM y LEFT JOIN fx_sources s ON y.source_id = s.id", N, "fx_sources")
def build_notice(spark, d):
    """Record, source and classification to the stored notice, one function for all families."""
    s = fixture(spark, d, "fx_sources").select(F.col("id").alias("sid"), "name", F.col("organization").alias("s_organization"), F.col("region").alias("s_region"))
    n = classify.classify(fixture(spark, d, N), "title", "description").join(s, F.col("source_id") == F.col("sid"), "left")
    status = dates.infer_status(F.col("deadline"), as_of())
    return n.select(
        "id",
        text.normalize(F.col("title")).alias("normalized_title"),
        F.substring("description", 1, 900).alias("short_description"),
        F.substring("description", 1, 420).alias("summary"),
        F.col("category_found").alias("category"),
        F.col("relevance_score_found").alias("score"),
        F.col("relevance_found").alias("relevance"),
        F.col("s_organization").alias("organization"),
        F.col("s_region").alias("region"),
        status.alias("status"),
        F.when(status == "closed", "hidden").otherwise("approved").alias("editorial_status"),
        F.concat(F.lit("Consultare la fonte ufficiale: "), F.col("name"), F.lit(".")).alias("application_mode"),
        urls.content_hash(F.col("title"), F.col("description"), F.col("official_url")).alias("content_hash"),
    )
