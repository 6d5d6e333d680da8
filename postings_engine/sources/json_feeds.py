"""JSON feeds as data: one field map per feed, one job that applies any of them.

A landed payload is a row (payload_id, payload, and per employer board: token, board_name,
board_website; per national market: market). Paths are read from a VARIANT, so payloads need
no schema; a payload that is not JSON yields no rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.dates import posted_timestamp
from ..functions.pay import amount
from ..functions.text import html_to_text, no
from ..registry import feed, register_feed
from ..schema import place_of, to_postings


@dataclass(frozen=True)
class FieldMap:
    """Paths are tried in order, the first non-blank wins; a callable gets a reader."""

    rows: tuple[str, ...]  # list path(s); "$" is the root array
    prefix: str
    id: object
    title: object
    company: object = ()
    url: object = ()
    apply_url: object = ()  # falls back to url
    description: object = ()
    location: object = ()
    location_default: str = ""
    posted: object = ()
    employment: object = ()
    salary_text: object = ()
    salary_min: object = ()
    salary_max: object = ()
    currency: object = ()
    logo: object = ()
    tags: tuple = ()
    tag_items: tuple = ()  # single values collected as tags
    company_default: str = ""
    keep: Callable | None = None  # reader -> boolean Column
    constants: dict = field(default_factory=dict)  # column -> literal or reader -> Column


class Reader:
    """Typed access to the current item (variant column `item`) and its payload row."""

    def __init__(self, item: Column, doc: Column):
        self.item, self.doc = item, doc

    def text(self, path: str, root: bool = False) -> Column:
        value = F.try_variant_get(self.doc if root else self.item, f"$.{path}", "string")
        return F.when(~value.isin("", "null", "false", "0", "[]", "{}"), value)

    def flag(self, path: str) -> Column:
        value = F.try_variant_get(self.item, f"$.{path}", "string")
        return value.isNotNull() & ~value.isin("", "null", "false", "0", "[]", "{}")

    def strings(self, path: str) -> Column:
        items = F.try_variant_get(self.item, f"$.{path}", "array<string>")
        items = F.filter(items, lambda x: x.isNotNull() & (x != ""))
        parts = F.filter(F.transform(F.split(self.text(path), ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.coalesce(items, parts, F.array().cast("array<string>"))

    def first(self, spec) -> Column:
        if callable(spec):
            return spec(self)
        spec = (spec,) if isinstance(spec, str) else spec
        return F.coalesce(*[self.text(p) for p in spec]) if spec else F.lit(None).cast("string")


def _joined(path):
    return lambda r: F.array_join(r.strings(path), ", ")


def _listed(*paths):
    return lambda r: F.nullif(F.concat_ws(", ", *[r.text(p) for p in paths]), F.lit(""))


def _spaced(path):
    return lambda r: F.replace(F.coalesce(r.text(path), F.lit("")), F.lit("_"), F.lit(" "))


def _time_flags(r):
    return F.concat(F.when(r.flag("partTime"), "Part Time").otherwise(""), F.when(r.flag("fullTime"), " Full Time").otherwise(""))


def _board_name(*fallbacks):
    """Employer: the board's own name, then payload fields, then the token."""
    def read(r):
        own = F.nullif(F.col("board_name"), F.lit(""))
        return F.coalesce(own, *[f(r) for f in fallbacks], F.initcap("token"))
    return read


def _placeholder_company(r):
    name = r.text("companyName")
    slug = F.initcap(F.replace(r.text("companySlug"), F.lit("-"), F.lit(" ")))
    return F.when(name.isNull() | F.lower(name).isin("name", "null", "none"), slug).otherwise(name)


def _first_option(r):
    options = F.try_variant_get(r.item, "$.apply_options", "array<struct<link:string>>")
    linked = F.filter(F.transform(options, lambda o: o["link"]), lambda x: x != "")
    return F.coalesce(F.get(linked, F.lit(0)), *[r.text(n) for n in ("apply_link", "share_link", "sharing_link", "link")])


def _paid(column):
    return lambda r: F.when(F.coalesce(amount(r.text("salary_min")), amount(r.text("salary_max"))).isNotNull(), "USD").otherwise("")


def _yearly(path):
    return lambda r: F.when(F.upper(r.text("salary_type")) == "Y", r.text(path))


_SNIPPET = {"truncated_description": True}
_ATS = lambda name, **more: {"direct_employer": True, "ats": name, "board_token": lambda r: F.col("token"),
                             "company_website": lambda r: F.coalesce("board_website", F.lit("")), **more}
_with_token = lambda spec: (lambda r: F.concat(F.col("token"), F.lit("-"), F.coalesce(r.first(spec), F.lit(""))))

MAPS = {
    "remoteok": FieldMap(("$",), "remoteok-", ("id", "slug"), "position", "company", "url", "apply_url", "description",
                         "location", "Remote", ("epoch", "date"), salary_min="salary_min", salary_max="salary_max",
                         currency=lambda r: F.lit("USD"), logo=("company_logo", "logo"), tags=("tags",),
                         keep=lambda r: F.try_variant_get(r.item, "$.position", "variant").isNotNull(), constants={"is_remote": True}),
    "remotive": FieldMap(("$.jobs",), "remotive-", "id", "title", "company_name", "url", (), "description",
                         "candidate_required_location", "Remote", "publication_date", "job_type", "salary",
                         logo="company_logo", tags=("tags",), constants={"is_remote": True}),
    "arbeitnow": FieldMap(("$.data",), "arbeitnow-", "slug", "title", "company_name", "url", (), "description", "location",
                          "", "created_at", _joined("job_types"), tags=("tags",), constants={"is_remote": lambda r: r.flag("remote")}),
    "jobicy": FieldMap(("$.jobs",), "jobicy-", "id", "jobTitle", "companyName", "url", (), ("jobDescription", "jobExcerpt"),
                       "jobGeo", "Anywhere", "pubDate", _joined("jobType"), (), "annualSalaryMin", "annualSalaryMax",
                       lambda r: F.upper(r.text("salaryCurrency")), "companyLogo", ("jobIndustry", "jobLevel"), constants={"is_remote": True}),
    "workingnomads": FieldMap(("$",), "workingnomads-", ("id", "slug"), "title", "company_name", "url", (), "description",
                              "location", "Remote", "pub_date", tags=("tags",), constants={"is_remote": True}),
    "himalayas": FieldMap(("$.jobs",), "himalayas-", ("guid", "title"), "title", _placeholder_company, ("applicationLink", "guid"),
                          "applicationLink", ("description", "excerpt"),
                          lambda r: F.nullif(F.coalesce(F.array_join(F.try_variant_get(r.item, "$.locationRestrictions", "array<string>"), ", "),
                                                        r.text("locationRestrictions")), F.lit("")), "Worldwide", "pubDate",
                          "employmentType", (), "minSalary", "maxSalary", lambda r: F.upper(r.first(("currency", "salaryCurrency"))),
                          "companyLogo", ("categories", "seniority"), constants={"is_remote": True}),
    "greenhouse": FieldMap(("$.jobs",), "gh-", _with_token("id"), "title", _board_name(), "absolute_url", (), "content", "location.name", "",
                           ("updated_at", "first_published"), constants=_ATS("greenhouse")),
    "lever": FieldMap(("$",), "lever-", _with_token("id"), "text", _board_name(), "hostedUrl", "applyUrl", ("descriptionPlain", "description"),
                      "categories.location", "", "createdAt", "categories.commitment", tag_items=("categories.team", "categories.department"),
                      constants=_ATS("lever")),
    "ashby": FieldMap(("$.jobs",), "ashby-", _with_token("id"), "title", _board_name(), "jobUrl", "applyUrl",
                      ("descriptionHtml", "descriptionPlain"), "location", "", ("publishedAt", "updatedAt"), "employmentType",
                      "compensation.compensationTierSummary", "compensation.summaryComponents[0].minValue", tag_items=("department", "team"),
                      constants=_ATS("ashby", is_remote=lambda r: r.flag("isRemote"))),
    "workable": FieldMap(("$.jobs",), "workable-", _with_token(("shortcode", "url", "application_url")), "title",
                         _board_name(lambda r: r.text("name", True)), ("url", "application_url"), "application_url", "description",
                         _listed("city", "country"), "", ("published_on", "created_at"), "employment_type",
                         constants=_ATS("workable", is_remote=lambda r: r.flag("telecommuting"))),
    "recruitee": FieldMap(("$.offers",), "recruitee-", _with_token("id"), "title", _board_name(lambda r: r.text("company_name")),
                          ("careers_url", "careers_apply_url"), "careers_apply_url", "description", _listed("city", "country"), "",
                          ("published_at", "created_at"), "employment_type_code", tag_items=("department",),
                          constants=_ATS("recruitee", is_remote=lambda r: F.coalesce(F.lower(r.text("remote")).isin("yes", "true", "fully"), no()))),
    "smartrecruiters": FieldMap(("$.content",), "sr-", _with_token("id"), "name", _board_name(lambda r: r.text("company.name"), lambda r: F.col("token")),
                                lambda r: F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), r.text("id")), (),
                                "jobAd.sections.jobDescription.text", _listed("location.city", "location.country"), "", "releasedDate",
                                constants=_ATS("smartrecruiters", is_remote=lambda r: r.flag("location.remote"))),
    "teamtailor": FieldMap(("$.items",), "tt-", _with_token(("id", "url", "external_url")), "title", _board_name(lambda r: r.text("title", True)),
                           ("url", "external_url"), (), ("content_html", "content_text"), "location", "", ("date_published", "date_modified"),
                           constants=_ATS("teamtailor")),
    "careerjet": FieldMap(("$.jobs",), "careerjet-", lambda r: r.text("url"), "title", "company", "url", (), "description",
                          "locations", "", "date", (), "salary", _yearly("salary_min"), _yearly("salary_max"), "salary_currency_code",
                          company_default="Undisclosed", keep=lambda r: r.text("url").isNotNull() & r.text("title").isNotNull(), constants=_SNIPPET),
    "adzuna": FieldMap(("$.results",), "adzuna-", "id", "title", "company.display_name", "redirect_url", (), "description",
                       lambda r: F.coalesce(r.text("location.display_name"), F.upper("market")), "", "created",
                       lambda r: F.trim(F.concat_ws(" ", _spaced("contract_time")(r), _spaced("contract_type")(r))), (), "salary_min", "salary_max",
                       lambda r: F.try_element_at(F.create_map(*[F.lit(x) for kv in fv.MARKET_CURRENCY.items() for x in kv]), F.col("market")),
                       tag_items=("category.label",), constants=_SNIPPET),
    "reed": FieldMap(("$.results",), "reed-", "jobId", "jobTitle", "employerName", "jobUrl", (), "jobDescription", "locationName",
                     "United Kingdom", "date", _time_flags, (), "minimumSalary", "maximumSalary",
                     lambda r: F.upper(F.coalesce(r.text("currency"), F.lit("GBP"))),
                     constants={**_SNIPPET, "direct_employer": lambda r: F.coalesce(F.try_variant_get(r.item, "$.postedByRecruitmentAgency", "boolean") == False, no())}),  # noqa: E712
    "jooble": FieldMap(("$.jobs",), "jooble-", "id", "title", "company", "link", (), "snippet", "location", "", "updated", "type", "salary", constants=_SNIPPET),
    "indeed": FieldMap(("$.results",), "indeed-", "jobkey", "jobtitle", "company", "url", (), "snippet", "formattedLocation", "", "date",
                       company_default="Undisclosed", constants=_SNIPPET),
    "ziprecruiter": FieldMap(("$.jobs",), "zip-", "id", "name", "hiring_company.name", "url", (), "snippet", "location", "", "posted_time", (), (),
                             "salary_min", "salary_max", _paid("USD"), company_default="Undisclosed", constants=_SNIPPET),
    "google_jobs": FieldMap(("$.jobs_results", "$.jobs"), "gj-", lambda r: F.coalesce(r.text("job_id"), _first_option(r)), "title", "company_name",
                            _first_option, (), "description", "location", "", "detected_extensions.posted_at",
                            ("detected_extensions.schedule_type", "detected_extensions.schedule"), "detected_extensions.salary",
                            tag_items=(lambda r: F.nullif(F.replace(r.text("via"), F.lit("via "), F.lit("")), F.lit("")),),
                            company_default="Undisclosed", keep=lambda r: _first_option(r).isNotNull(),
                            constants={"truncated_description": False, "aggregated_by": lambda r: F.coalesce("provider", F.lit(""))}),
}
for _name, _map in MAPS.items():
    register_feed(_name, _map)

_CONTEXT = ("token", "board_name", "board_website", "market", "provider")


def map_json_feed(payloads: DataFrame, name: str, run_ts: Column, default_location: str = "") -> DataFrame:
    """Landed payloads of one feed -> postings, with row_no = (payload, item) order."""
    spec: FieldMap = feed(name)
    for missing in set(_CONTEXT) - set(payloads.columns):
        payloads = payloads.withColumn(missing, F.lit("").cast("string"))
    docs = payloads.select("payload_id", *_CONTEXT, F.try_parse_json("payload").alias("doc"))
    lists = F.coalesce(*[F.try_variant_get("doc", path, "array<variant>") for path in spec.rows])
    items = docs.select("payload_id", *_CONTEXT, "doc", F.posexplode(lists).alias("pos", "item"))
    r = Reader(F.col("item"), F.col("doc"))
    if spec.keep is not None:
        items = items.where(spec.keep(r))
    text = lambda s: F.coalesce(r.first(s), F.lit(""))
    # a lone id path is taken as it stands, even when it is zero
    own_id = F.coalesce(F.try_variant_get("item", f"$.{spec.id}", "string"), F.lit("")) if isinstance(spec.id, str) else text(spec.id)
    url = text(spec.url)
    own_apply = r.first(spec.apply_url)
    tags = F.concat(*[r.strings(p) for p in spec.tags], F.filter(
        F.array(*[r.first(t) for t in spec.tag_items]).cast("array<string>"), lambda t: t.isNotNull()))
    constants = {k: (v(r) if callable(v) else F.lit(v)) for k, v in spec.constants.items()}
    apply_url = own_apply if name == "himalayas" else F.coalesce(own_apply, url)
    location = F.coalesce(F.nullif(r.first(spec.location), F.lit("")), F.lit(spec.location_default or default_location))
    out = items.select(
        place_of(F.col("payload_id"), F.col("pos")).alias("row_no"),
        F.concat(F.lit(spec.prefix), own_id).alias("source_id"), text(spec.title).alias("title"),
        F.coalesce(F.nullif(r.first(spec.company), F.lit("")), F.lit(spec.company_default)).alias("company"), url.alias("url"),
        apply_url.alias("apply_url"), html_to_text(r.first(spec.description)).alias("description"), location.alias("location_raw"),
        posted_timestamp(r.first(spec.posted), run_ts).alias("posted_at"), text(spec.employment).alias("employment_type_raw"),
        text(spec.salary_text).alias("salary_raw"), amount(r.first(spec.salary_min)).alias("salary_min"),
        amount(r.first(spec.salary_max)).alias("salary_max"), text(spec.currency).alias("salary_currency"),
        text(spec.logo).alias("company_logo"), tags.alias("tags"), *[v.alias(k) for k, v in constants.items()])
    return _finished(out, name)


def _finished(out: DataFrame, name: str) -> DataFrame:
    full = to_postings(out.withColumn("seq", F.col("row_no")))
    return full.withColumn("source", F.lit(name)).withColumn("posting_id", F.col("source_id")).withColumn("row_no", F.col("seq"))
