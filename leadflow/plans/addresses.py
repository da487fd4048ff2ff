"""Queries over URL and domain columns."""

from pyspark.sql import functions as F

from leadflow.functions import urls
from leadflow.plans import views as v
from leadflow.plans.registry import query

# Every page address plus, from the same rows, forms that must be refused.
VARIANTS = {
    "as_is": ("url", "url"),
    "credentials": ("replace(url, '://', '://user:pw@')",) * 2,
    "file": ("replace(replace(url, 'https:', 'file:'), 'http:', 'file:')",) * 2,
    "port": ("regexp_replace(url, '(//[^/]*)', '$1:8443')", r"regexp_replace(url, '(//[^/]*)', '\1:8443')"),
    "port_443": ("regexp_replace(url, '(//[^/]*)', '$1:443')", r"regexp_replace(url, '(//[^/]*)', '\1:443')"),
    "local": ("regexp_replace(url, '//[^/]*', '//localhost')",) * 2,
    "internal": ("regexp_replace(url, '//[^/]*', '//wiki.internal')",) * 2,
    "private_ip": ("regexp_replace(url, '//[^/]*', '//10.1.2.3')",) * 2,
    "public_ip": ("regexp_replace(url, '//[^/]*', '//8.8.8.8')",) * 2,
    "space": ("concat(url, ' x')", "url || ' x'"),
}
VARIANTS_SQL = "variants_v AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT page_id, '{k}' AS form, {sql} AS url FROM pages" for k, (_, sql) in VARIANTS.items()) + ")"


def variants(spark, d):
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.expr(e).alias("url")) for k, (e, _) in VARIANTS.items()])
    return v.table(spark, d, "pages").select("page_id", F.explode(forms).alias("x")).select("page_id", "x.form", "x.url")


@query("canonical_url", f"SELECT page_id, {v.CANON_SQL} AS canonical FROM pages")
def canonical_url(spark, d):
    return v.table(spark, d, "pages").select("page_id", urls.canonical_url("url").alias("canonical"))


@query("safe_urls", v.with_views(VARIANTS_SQL) + """
SELECT page_id, form, form NOT IN ('credentials', 'file', 'port') AS safe FROM variants_v""")
def safe_urls(spark, d):
    return variants(spark, d).select("page_id", "form", urls.is_safe_url("url").alias("safe"))


@query("public_urls", v.with_views(VARIANTS_SQL) + """
SELECT page_id, form, form IN ('as_is', 'port_443', 'public_ip') AS public FROM variants_v""")
def public_urls(spark, d):
    return variants(spark, d).select("page_id", "form", urls.is_public_url("url").alias("public"))


@query("domain_allowed", r"""
SELECT page_id, regexp_matches(url, '^https?://([^/?#]*\.)?example\.(com|org)(:|/|\?|#|$)') AS allowed FROM pages""")
def domain_allowed(spark, d):
    domains = F.array(F.lit("example.com"), F.lit("Example.org"))
    return v.table(spark, d, "pages").select("page_id", urls.domain_allowed("url", domains).alias("allowed"))


HOST_FORMS = {
    "as_is": ("h", True), "upper": ("upper(h) || '.'", True), "dashed": ("'-' || h", False), "bare": ("split_part(h, '.', 1)", False),
    "reserved": ("h || '.test'", False), "numeric": ("h || '.123'", False), "long": ("repeat('a', 64) || '.' || h", False),
    "under": ("'a_b.' || h", False),
}


@query("valid_domains", "WITH h AS (SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS h FROM pages)" + " UNION ALL ".join(
    f" SELECT page_id, '{k}' AS form, {str(ok).lower()} AS valid FROM h" for k, (_, ok) in HOST_FORMS.items()))
def valid_domains(spark, d):
    hosts = v.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).alias("h"))
    forms = F.array(*[F.struct(F.lit(k).alias("form"), F.expr(e).alias("name")) for k, (e, _) in HOST_FORMS.items()])
    return hosts.select("page_id", F.explode(forms).alias("x")).select(
        "page_id", "x.form", urls.valid_domain("x.name").alias("valid"))


@query("allowed_url", v.with_views(VARIANTS_SQL) + r"""
SELECT page_id, form, CASE WHEN form IN ('as_is') OR (form = 'port_443' AND starts_with(url, 'https:'))
  THEN CASE WHEN regexp_matches(url, '^https?://([^/?#]*\.)?example\.(com|org)(:443)?(/|\?|#|$)')
    THEN regexp_replace(regexp_replace(url, '#.*$', ''), ':443/', '/') ELSE '' END
  ELSE '' END AS allowed FROM variants_v""")
def allowed_url(spark, d):
    domains = F.array(F.lit("example.com"), F.lit("example.org"))
    return variants(spark, d).select("page_id", "form", urls.allowed_url("url", domains).alias("allowed"))
