"""Rule-based classification of notices; all native columns."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import all_of, any_of, contains_any, has_substring, normalize, plain
from ..functions.urls import part


def infer_category(text: Column, pack=rules.CATEGORIES) -> Column:
    return F.coalesce(*[F.when(contains_any(text, terms), F.lit(name)) for name, terms in pack.items()], F.lit(rules.OTHER))


def _all_matching(text: Column, pack, default: str) -> Column:
    found = F.array_compact(F.array(*[F.when(contains_any(text, terms), F.lit(name)) for name, terms in pack.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def detect_areas(text: Column, pack=rules.AREAS) -> Column:
    return _all_matching(text, pack, rules.OTHER)


def extract_requirements(text: Column, pack=rules.REQUIREMENTS) -> Column:
    return _all_matching(text, pack, rules.UNDETERMINED)


def group_scores(text: Column, groups=rules.PSYCHOLOGY_GROUPS) -> list[Column]:
    """For each group of evidence the weight of its strongest term."""
    return [F.greatest(F.lit(0), *[F.when(text.contains(plain(t)), F.lit(w)).otherwise(0) for t, w in g.items()]) for g in groups]


def role_match(text: Column) -> Column:
    return text.rlike(rules.ROLE_PATTERN)


def relevance_score(text: Column, groups=rules.PSYCHOLOGY_GROUPS) -> Column:
    total = sum(group_scores(text, groups), F.lit(0))
    total = F.when(role_match(text), F.greatest(total, F.lit(rules.ROLE_LEAST))).otherwise(total)
    field = text.contains("psicolog")
    total = total + F.when(field & text.contains("albo"), rules.BONUS_ALBO).otherwise(0)
    total = total + F.when(field & (text.contains("minori") | text.contains("salute mentale")), rules.BONUS_FIELD).otherwise(0)
    return F.least(total, F.lit(rules.SCORE_MOST)).cast("int")


def relevance_label(score: Column) -> Column:
    (first, name), *rest = rules.RELEVANCE
    out = F.when(score >= first, name)
    for least, name in rest[:-1]:
        out = out.when(score >= least, name)
    return out.otherwise(rules.RELEVANCE[-1][1])


def _tree_pattern(words: list[str]) -> str:
    """A pattern for the longest of the words that begins at a place; common beginnings are looked at once."""
    if words == [""]:
        return ""
    branches: dict[str, list[str]] = {}
    for w in words:
        if w:
            branches.setdefault(w[0], []).append(w[1:])
    inner = "|".join(c + _tree_pattern(rest) for c, rest in sorted(branches.items()))
    return f"(?:{inner})?" if "" in words else inner if len(branches) == 1 else f"(?:{inner})"


class TermIndex:
    """Labels of many terms by one pass over a normalised text. The pass gives the longest term at each place; the others that
    begin there are beginnings of it, so each term stands for the labels of all its beginnings."""

    def __init__(self, labels: dict[str, set[str]]):
        """labels by term; a term with a space at both ends is a word of its own."""
        own = {t: sorted({x for k in range(1, len(t) + 1) for x in labels.get(t[:k], ())}) for t in labels if t.strip()}
        self.pattern = f"(?=({_tree_pattern(sorted(own))}))"
        self.of = own

    def found(self, text: Column) -> Column:
        terms = F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(self.pattern), F.lit(1)))
        known = F.from_json(F.lit(json.dumps(self.of)), "map<string,array<string>>")
        return F.array_distinct(F.flatten(F.transform(terms, lambda t: known[t])))


def _index(categories, areas, requirements, groups) -> TermIndex:
    labels: dict[str, set[str]] = {}
    for kind, pack in (("category", categories), ("area", areas), ("requirement", requirements)):
        for name, terms in pack.items():
            for t in map(plain, terms):
                labels.setdefault(f" {t} " if " " not in t and len(t) <= 4 else t, set()).add(f"{kind}:{name}")
    for k, group in enumerate(groups):
        for t, weight in group.items():
            labels.setdefault(plain(t), set()).add(f"group{k}:{weight}")
    for t in ("psicolog", "albo", "minori", "salute mentale"):
        labels.setdefault(t, set()).add(f"bonus:{t}")
    return TermIndex(labels)


def classify(notices: DataFrame, *text_columns: str, categories=rules.CATEGORIES, areas=rules.AREAS, requirements=rules.REQUIREMENTS, groups=rules.PSYCHOLOGY_GROUPS) -> DataFrame:
    """Adds category, areas, requirements, relevance_score and relevance, as infer_category and the others find them; the text
    is normalised once and read once for the terms of all packs."""
    t, has = F.col("__text"), lambda label: F.array_contains("__labels", label)
    text = notices.withColumn("__text", normalize(F.concat_ws("\n", *[F.col(c) for c in text_columns])))
    text = text.withColumn("__labels", _index(categories, areas, requirements, groups).found(t))
    all_of_kind = lambda kind, pack, default: F.array_compact(F.array(*[F.when(has(f"{kind}:{name}"), F.lit(name)) for name in pack])).alias(default)
    some = lambda found, default: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))
    total = F.lit(0)
    for k, group in enumerate(groups):
        total = total + F.greatest(F.lit(0), *[F.when(has(f"group{k}:{w}"), F.lit(w)).otherwise(0) for w in sorted(set(group.values()))])
    total = F.when(role_match(t), F.greatest(total, F.lit(rules.ROLE_LEAST))).otherwise(total)
    total = total + F.when(has("bonus:psicolog") & has("bonus:albo"), rules.BONUS_ALBO).otherwise(0)
    total = total + F.when(has("bonus:psicolog") & (has("bonus:minori") | has("bonus:salute mentale")), rules.BONUS_FIELD).otherwise(0)
    found = text.withColumns(
        {
            "category_found": F.coalesce(*[F.when(has(f"category:{name}"), F.lit(name)) for name in categories], F.lit(rules.OTHER)),
            "areas_found": some(all_of_kind("area", areas, "a"), rules.OTHER),
            "requirements_found": some(all_of_kind("requirement", requirements, "r"), rules.UNDETERMINED),
            "relevance_score_found": F.least(total, F.lit(rules.SCORE_MOST)).cast("int"),
        }
    )
    return found.withColumn("relevance_found", relevance_label(F.col("relevance_score_found"))).drop("__text", "__labels")


def direct_match(text: Column) -> Column:
    """A role, a qualification, or a context with contextual evidence."""
    return role_match(text) | text.rlike(rules.QUALIFYING_PATTERN) | (text.rlike(rules.CONTEXT_PATTERN) & text.rlike(rules.CONTEXTUAL_PATTERN))


def psychology_terms(text: Column) -> Column:
    return direct_match(text) | text.contains("neuropsicolog")


def opportunity_terms(text: Column) -> Column:
    return has_substring(text, rules.OPPORTUNITY_TERMS)


def relevant_opportunity(text: Column) -> Column:
    return psychology_terms(text) & (opportunity_terms(text) | role_match(text))


def followup_content(text: Column) -> Column:
    return has_substring(text, rules.FOLLOWUP_CONTENT)


def followup_title(title: Column) -> Column:
    return has_substring(title, rules.FOLLOWUP_TITLES)


def relevant_strict(text: Column, weak=rules.SKIP_RECORD_TERMS, strong=rules.STRONG_OPPORTUNITY_TERMS) -> Column:
    """Relevant, no follow-up act, and not only by weak terms."""
    return relevant_opportunity(text) & ~followup_content(text) & (~has_substring(text, weak) | has_substring(text, strong))


def title_supports(title: Column, context: Column) -> Column:
    return psychology_terms(title) | (has_substring(title, rules.MULTI_PROFILE) & relevant_opportunity(context))


def focused_match(title: Column, title_and_url: Column, description: Column, profiles=rules.FOCUS_PROFILES) -> Column:
    """The title or address matches, or a title of several profiles has a description that does."""
    return direct_match(title_and_url) | (has_substring(title, profiles) & direct_match(description))


def psych_document(text: Column, document=rules.DOCUMENT_TERMS, skip=rules.SKIP_DOCUMENT_TERMS) -> Column:
    return psychology_terms(text) & has_substring(text, document) & ~has_substring(text, skip)


def primary_opportunity(text: Column, primary=rules.PRIMARY_TERMS, update=rules.UPDATE_TERMS) -> Column:
    """Terms are looked for as they are written: one with an apostrophe is in no normalised text."""
    within = lambda terms: any_of(text.contains(t) for t in terms)
    return psychology_terms(text) & within(primary) & ~within(update)


def structural_link(label: Column, href: Column) -> Column:
    """Paging, a label without letters, or a link of the site's frame; label and href as they are."""
    keys = F.transform(F.split(F.lower(part(href, "QUERY")), "&"), lambda kv: F.when(kv.rlike("=."), F.substring_index(kv, "=", 1)))
    paged = F.coalesce(F.arrays_overlap(F.array_compact(keys), F.array(*map(F.lit, rules.PAGING_KEYS))), F.lit(False)) | F.lower(part(href, "PATH")).rlike(r"/page/\d+/?$")
    return paged | normalize(label).rlike(r"^\d*$") | has_substring(normalize(F.concat_ws(" ", label, href)), rules.PAGING_TERMS)


def parser_artifact(title: Column, url: Column, plain_title: Column, plain_description: Column) -> Column:
    """A contact or structural link, or a record that isn't about the profession; the last two are normalised."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    contact = any_of(low.startswith(x) for x in rules.CONTACT_SCHEMES) | any_of(plain_title.startswith(x) for x in rules.CONTACT_TITLES)
    focused = direct_match(plain_title) | (has_substring(plain_title, rules.MULTI_PROFILE) & psych_document(plain_description))
    return contact | structural_link(title, url) | ~focused


def professional_match(figure: Column, title: Column, description: Column) -> Column:
    """direct, eligible or null by ordered rules: a revoked procedure is null; a figure or title that names the profession or
    matches is direct, as is a title with a degree in psychology; a described degree with register or licence is eligible; a
    described role is direct; a matching description, or one of behavioural sciences in mental health, is eligible. Columns
    are normalised; an order's own name in a title doesn't count."""
    title_alone = F.replace(title, F.lit("ordine degli psicologi"), F.lit(""))
    named = any_of(c.rlike(rules.INDIVIDUAL_PATTERN) | direct_match(c) for c in (figure, title_alone))
    degree = (title.contains("laureat") | title.contains("laurea")) & title.contains("psicologia")
    described = (description.contains("laurea in psicologia") | description.contains("lm 51")) & (description.contains("albo") | description.contains("abilitazione"))
    return (
        F.when(title.rlike(rules.REVOKED_PATTERN), F.lit(None))
        .when(named | degree, "direct")
        .when(described, "eligible")
        .when(description.rlike(rules.DESCRIBED_ROLE_PATTERN), "direct")
        .when(direct_match(description) | (description.contains("scienze comportamentali") & description.contains("salute mentale")), "eligible")
    )


def entity_type(source_type: Column, organization: Column) -> Column:
    """Ordered rules on the source's type and the normalised organisation."""
    # Organisation tokens of each type.
    health = ("asl", "ast", "ats", "ausl", "usl", "azienda sanitaria", "arcs", "ares", "areus", "asdaa", "asrem", "asuit", "asp", "aulss", "azienda ospedaliera", "azienda zero", "estar", "irccs", "pugliasalute")
    return (
        F.when(source_type == "third-sector-hub", "terzo-settore")
        .when(source_type == "private-social-jobs", "privato-sociale")
        .when(organization.startswith("comune"), "comune")
        .when(organization.startswith("regione"), "regione")
        .when(organization.startswith("universita") | organization.startswith("politecnico") | organization.contains("alma mater"), "universita")
        .when(any_of(organization.contains(t) for t in health), "azienda-sanitaria")
        .otherwise("altro-ente-pubblico")
    )


def link_score(both: Column, href: Column) -> Column:
    """Additive score of a link: both is its label and target, normalised into a column; 0 is no candidate."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(has_substring(both, rules.LINK_TERMS), 4) + points(any_of(F.lower(href).rlike(p) for p in rules.DETAIL_PATHS), 5) + points(has_substring(both, rules.SEARCH_TERMS), 5) + points(has_substring(both, ("dettaglio", "scheda", "visualizza")), 1)
    low = has_substring(both, rules.LOW_SIGNAL_TERMS)
    skip = (both == "") | has_substring(both, rules.SKIP_LINK_TERMS)
    return F.when(skip, 0).otherwise(F.greatest(score - points(low & (score > 0), 1), F.lit(0))).cast("int")


def deep_link_score(label: Column, href: Column, rel: Column) -> Column:
    """Additive score of a link deeper into a site; pagination counts alone, but for the profession's terms; 0 is no candidate."""
    points = lambda c, n: F.when(c, rules.DEEP_WEIGHTS[n]).otherwise(0)
    spaced = lambda *c: F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *c)), r"\s+", " "))
    within = lambda text, terms: any_of(text.contains(t) for t in terms)
    both, low = spaced(label, href), F.lower(href)
    keys = F.transform(F.split(F.lower(part(href, "QUERY")), "&"), lambda kv: F.when(kv.rlike("=."), F.substring_index(kv, "=", 1)))
    page = F.when(F.lower(rel).contains("next"), rules.DEEP_WEIGHTS["rel"]).when(F.coalesce(F.arrays_overlap(F.array_compact(keys), F.array(*map(F.lit, rules.PAGE_KEYS))), F.lit(False)), rules.DEEP_WEIGHTS["key"]).when(within(spaced(label, href, rel), rules.PAGE_TERMS), rules.DEEP_WEIGHTS["label"]).otherwise(0)
    rest = points(within(both, rules.DEEP_OPPORTUNITY_TERMS), "opportunity") + points(any_of(low.rlike(p) for p in rules.DEEP_DETAIL_PATHS), "path") + points(within(both, rules.DEEP_DETAIL_TERMS), "detail")
    score = page + points(within(both, rules.DEEP_PSYCHOLOGY_TERMS), "psychology") + F.when(page == 0, rest).otherwise(0)
    return F.when((both == "") | within(both, rules.SKIP_LINK_TERMS), 0).otherwise(score).cast("int")


def matches_all(text: Column, query: str) -> Column:
    """Every word of the query is part of the text."""
    return all_of(text.contains(w) for w in plain(query).split())
