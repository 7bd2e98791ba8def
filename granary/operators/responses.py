"""What comes back from models and vendors as JSON: sections flattened, business profiles, contact details; and filings.

Shapes aren't known beforehand, so objects are VARIANT and are looked at key by key; nothing is parsed twice.

Defined results: null and malformed JSON, and JSON that is no object, has no fields, an empty profile and no contact;
objects with one name twice count as malformed; fields of wrong kinds are empty; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X

# Names of sections that only wrap fields, in the order in which their fields are taken over.
SECTIONS = ("COMPANY PROFILE", "Company Profile", "company_profile", "PROFILE", "EVIDENCE", "Evidence", "evidence_extraction", "EVIDENCE EXTRACTION", "SIGNALS", "Signals", "SIGNAL DETECTION", "DETECTED FACTORS", "Detected Factors", "FACTORS", "PAIN POINTS", "Pain Points", "REASONING CHAINS", "Reasoning Chains", "INTELLIGENCE", "Intelligence", "AI OPPORTUNITIES", "WHY CONTACT", "OUTREACH INTELLIGENCE", "Outreach Intelligence", "OUTREACH", "CONTACTS", "Contact Prioritization", "CONTACT PRIORITIZATION", "SCORING", "Scoring", "SCORE EXPLANATIONS", "METADATA", "Metadata", "URGENCY")
# The fields of a business profile, lists and texts.
LISTS, TEXTS = ("services", "problems_solved", "industries_served", "technical_capabilities", "business_outcomes"), ("ideal_customers", "target_company_size", "market_positioning")
# Forms of filings that often tell of changes, and how many of the latest filings count.
SIGNAL_FORMS, LATEST = ("8-K", "8-K/A", "DEF 14A", "S-1", "424B"), 8
PERSON = "struct<email:struct<email:string,status:string,revealed:boolean>,job_history:array<struct<title:string,current:boolean,seniority:string,departments:array<string>>>,location:struct<city:string,state:string,country:string>,headline:string,current_job_title:string>"
RESPONSE = f"struct<error:boolean,error_code:string,person:{PERSON},company:struct<employee_range:string,industry:string>>"


def kind_of(value: Column) -> Column:
    """object, array, string, boolean, null or number."""
    told = F.schema_of_variant(value)
    return (F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean")
            .when(told == "VOID", "null").when(told.isNotNull(), "number"))


def _entries(value: Column) -> Column:
    """The names and values of an object; none of anything else."""
    return F.when(kind_of(value) == "object", F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")))


def fields(rows: DataFrame, key: str, raw: str, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """key, name, value (VARIANT) of every field of a JSON object whose wrapping sections are taken apart.

    Of one name the field of the latest section counts, and before all the one outside; if no section is an object, all
    fields are as they stand.
    """
    top = rows.select(key, F.explode(_entries(F.try_parse_json(raw))).alias("e")).select(key, "e.key", "e.value")
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("e_name"))
    own = top.select(key, F.col("key").alias("e_name"), F.col("value").alias("e_value")).withColumn("place", place)
    wraps = (F.col("place") > 0) & (kind_of(F.col("e_value")) == "object")
    any_wrap = F.bool_or(wraps).over(Window.partitionBy(key))
    told = own.withColumn("wraps", wraps).withColumn("any", any_wrap)
    inner = told.where("wraps").select(key, "place", F.explode(_entries(F.col("e_value"))).alias("e")).select(key, "place", F.col("e.key").alias("name"), F.col("e.value").alias("value"))
    # a section's name that holds no object goes too, once there is a section
    outer = told.where(~F.col("any") | (F.col("place") == 0)).select(key, F.lit(len(sections) + 1).cast("long").alias("place"), F.col("e_name").alias("name"), F.col("e_value").alias("value"))
    latest = Window.partitionBy(key, "name").orderBy(F.desc("place"))
    return inner.unionByName(outer).withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(key, "name", "value")


def text_of(value: Column) -> Column:
    return F.when(kind_of(value) == "string", F.try_variant_get(value, "$", "string"))


def profiles(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """key, the eight fields of a business profile (lists of texts that aren't blank, and texts), is_empty; one row for each row given."""
    parsed = rows.select(key, F.try_parse_json(raw).alias("v"))
    text = lambda name: F.coalesce(X.strip(text_of(F.try_variant_get("v", f"$.{name}", "variant"))), F.lit(""))
    none = F.array().cast("array<string>")

    def listed(name):
        value = F.try_variant_get("v", f"$.{name}", "variant")
        items = F.when(kind_of(value) == "array", F.try_variant_get(value, "$", "array<variant>"))
        texts = F.transform(items, lambda x: X.strip(text_of(x)))
        return F.coalesce(F.filter(texts, lambda x: x.isNotNull() & (x != "")), none)

    out = parsed.select(key, *[listed(n).alias(n) for n in LISTS], *[text(n).alias(n) for n in TEXTS])
    empty = F.lit(True)
    for n in LISTS:
        empty = empty & (F.size(n) == 0)
    for n in TEXTS:
        empty = empty & (F.col(n) == "")
    return out.withColumn("is_empty", empty)


def contact_email(response: Column) -> Column:
    """status (found, not_found, error), email, confidence of a vendor's answer about a person."""
    answer = F.from_json(response, RESPONSE)
    mail = answer["person"]["email"]
    failed, none = F.coalesce(answer["error"], F.lit(False)), F.coalesce(mail["email"], F.lit("")) == ""
    hidden = F.coalesce(~mail["revealed"], F.lit(False))
    broken = F.coalesce(kind_of(F.try_parse_json(response)) != "object", F.lit(True))
    status = F.when(broken, "error").when(failed & (answer["error_code"] == "NO_MATCH"), "not_found").when(failed, "error").when(none | hidden, "not_found").otherwise("found")
    sure = F.when(F.coalesce(mail["status"], F.lit("")).rlike("(?i)verif"), "high").otherwise("medium")
    return F.struct(status.alias("status"), F.when(status == "found", mail["email"]).alias("email"), F.when(status == "found", sure).otherwise("none").alias("confidence"))


def contact_details(response: Column, known_size: Column, known_industry: Column) -> Column:
    """status (enriched, partial, not_found), department, seniority, location, role, headline, company_size, industry, confidence of the same answer."""
    answer = F.from_json(response, RESPONSE)
    person, jobs = answer["person"], answer["person"]["job_history"]
    job = F.coalesce(F.get(F.filter(jobs, lambda j: j["current"]), F.lit(0)), F.get(jobs, F.lit(0)))
    said = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    place = F.array_join(F.filter(F.array(*[person["location"][n] for n in ("city", "state", "country")]), lambda x: x != ""), ", ")
    size, industry = F.coalesce(said(answer["company"]["employee_range"]), known_size), F.coalesce(said(answer["company"]["industry"]), known_industry)
    lost = answer.isNull() | F.coalesce(answer["error"], F.lit(False)) | person.isNull()
    substance = said(job["seniority"]).isNotNull() | said(industry).isNotNull() | said(person["headline"]).isNotNull()
    status = F.when(lost, "not_found").when(substance, "enriched").otherwise("partial")
    sure = F.when(lost | ~substance, "low").when(said(job["seniority"]).isNotNull() & said(industry).isNotNull(), "high").otherwise("medium")
    kept = {"department": F.get(job["departments"], F.lit(0)), "seniority": job["seniority"], "location": said(place), "role": F.coalesce(person["current_job_title"], job["title"]), "headline": person["headline"], "company_size": size, "industry": industry}
    return F.struct(status.alias("status"), *[F.when(~lost, c).alias(n) for n, c in kept.items()], sure.alias("confidence"))


def ranked_filings(filings: DataFrame, key: str, latest: int = LATEST) -> DataFrame:
    """key, form, filed, place, nth, is_signal: of a company's latest filings (by place in its list) those of SIGNAL_FORMS first, then the newest.

    The cut comes before the order, so an old filing of such a form doesn't oust a new one of another.
    """
    first = filings.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("_n") <= latest)
    signal = F.coalesce(F.col("form").isin(*SIGNAL_FORMS), F.lit(False))
    order = Window.partitionBy(key).orderBy(F.desc("is_signal"), F.desc("filed"), "place")
    return first.withColumn("is_signal", signal).withColumn("nth", F.row_number().over(order)).select(key, "form", "filed", "place", "nth", "is_signal")
