"""The audit of the derived crawl, stage by stage. Expected facts per template are written by
hand from the fragments in ``queries.crawl``; the SQL rolls them up per host."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.crawl import CTE, FRAGMENTS, PATHS, audited, facts
from queries.joins import vals
from queries.registry import query, spread
from sitelens.functions import urls as U
from sitelens.operators import checklist as C
from sitelens.operators import core_checks as E
from sitelens.operators import documents as W
from sitelens.operators import findings as Fi
from sitelens.operators import rules as R
from sitelens.operators.discovery import PLAN_GUESSES
from sitelens.operators.page_facts import page_facts
from sitelens.plans import report
from sitelens.sources.crawl import body_texts

c = F.col

# k, form type, personal categories, submit, boxes, prechecked, linked, text, button only, merged, newsletter, order, medical, file, confidence, consent confidence
FORMS = [
    (1, "callback", "name,phone", "Отправить заявку", 1, 0, 1, 1, 0, 0, 0, 0, 0, 0, 90, 80),
    (2, "order", "email,message", "Оформить", 1, 1, 0, 1, 0, 1, 0, 1, 0, 0, 85, 55),
    (3, "callback", "phone", "Жду звонка", 0, 0, 1, 0, 1, 0, 0, 0, 0, 0, 70, 35),
    (4, "newsletter", "email", "Подписаться на новости", 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 65, 0),
    (5, "medical", "file,medical,name", "Записаться", 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 75, 0),
    (9, "lead", "phone,name", "", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 55, 0),
]
FORM_COLS = ("k, form_type, personal, submit, boxes, prechecked, linked, has_text, button_only, merged, newsletter, is_order, "
             "is_medical, has_file, confidence, consent_confidence")


@query("h06_p02_p07_forms", f"""
SELECT page_id, {FORM_COLS.replace('k, ', '', 1)} FROM pages JOIN {vals(FORMS)} f({FORM_COLS}) ON page_id % 12 = k""")
def forms(spark, sf):
    f = facts(spark, sf).select("page_id", F.explode("forms").alias("f"))

    def n(x):
        return F.coalesce(x.cast("int"), F.lit(0))

    con = c("f.consent")
    return f.select(
        "page_id", "f.form_type", F.array_join("f.personal_data_fields", ",").alias("personal"), c("f.submit_text").alias("submit"),
        n(con["checkbox_found"]).alias("boxes"), n(con["checkbox_prechecked"]).alias("prechecked"), n(con["privacy_link_found"]).alias("linked"),
        n(con["consent_text_found"]).alias("has_text"), n(con["button_acceptance_only"]).alias("button_only"),
        n(con["merged_with_offer"]).alias("merged"), n(c("f.is_newsletter")).alias("newsletter"), n(c("f.is_order")).alias("is_order"),
        n(c("f.is_medical")).alias("is_medical"), n(c("f.has_file_upload")).alias("has_file"), c("f.confidence"),
        con["confidence"].alias("consent_confidence"))


FIELDS = [(1, 0, "user_name", "text", "Ваше имя", "name"), (1, 1, "t", "tel", "", "phone"), (1, 2, "ok", "checkbox", "Согласен с политикой", "consent"),
          (2, 0, "mail", "email", "", "email"), (2, 1, "message", "textarea", "", "message"),
          (2, 2, "ok", "checkbox", "Даю согласие и принимаю условия оферты", "consent"), (3, 0, "t", "tel", "", "phone"), (4, 0, "mail", "email", "", "email"),
          (5, 0, "user_name", "text", "", "name"), (5, 1, "c", "textarea", "Жалобы", "medical"), (5, 2, "scan", "file", "", "file")]


@query("h07_h08_fields", f"""
SELECT page_id, field_pos, name, field_type, label, category FROM pages JOIN {vals(FIELDS)} f(k, field_pos, name, field_type, label, category) ON page_id % 12 = k""")
def fields(spark, sf):
    f = facts(spark, sf).select("page_id", F.explode("forms").alias("f")).select("page_id", F.posexplode("f.fields").alias("field_pos", "x"))
    return f.select("page_id", "field_pos", "x.name", "x.field_type", "x.label", "x.category")


PAGE_HITS = [(6, "Яндекс.Метрика", "mc.yandex.ru", "script"), (6, "Google Tag Manager", "googletagmanager.com", "script"), (10, "Hotjar", "hotjar.com", "script")]


@query("h10_modal_forms", f"""
SELECT page_id, form_id, CASE WHEN form_id LIKE 'widget%' THEN 'widget' ELSE 'modal' END AS source, form_type, personal, submit, boxes, prechecked
FROM (SELECT page_id, CASE WHEN k = 9 THEN 'widget-marquiz' ELSE 'modal-0' END AS form_id, * FROM pages JOIN {vals(FORMS)} f({FORM_COLS}) ON page_id % 12 = k)""")
def modal_forms(spark, sf):
    """The same fragments, met in a dialog that opened on the page: no form in the page's own markup."""
    pages = spread(spark, sf, "pages").select("page_id", "url", F.regexp_replace("html", "(?is)<form.*?</form>", "").alias("html"), F.array(
        F.get(F.array(*map(F.lit, FRAGMENTS)), (c("page_id") % 12).cast("int"))).alias("modal_htmls"))
    f = page_facts(pages).select("page_id", F.explode("forms").alias("f")).where("f.source <> 'html'")
    return f.select(
        "page_id", "f.form_id", "f.source", "f.form_type", F.array_join("f.personal_data_fields", ",").alias("personal"), c("f.submit_text").alias("submit"),
        c("f.consent.checkbox_found").cast("int").alias("boxes"), F.coalesce(c("f.consent.checkbox_prechecked").cast("int"), F.lit(0)).alias("prechecked"))


@query("t_page_trackers", f"""
SELECT page_id, provider, domain, matched_on FROM pages JOIN {vals(PAGE_HITS)} h(k, provider, domain, matched_on) ON page_id % 12 = k""")
def page_trackers(spark, sf):
    return facts(spark, sf).select("page_id", F.explode("trackers").alias("t")).select(
        "page_id", c("t.provider_name").alias("provider"), c("t.matched_domain").alias("domain"), "t.matched_on")


@query("h04_p08_p15_page_resources", CTE + """
SELECT page_id, k IN (6, 7) OR (page_id = home_id AND k IN (1, 2)) AS banner, CASE k WHEN 6 THEN 2 WHEN 10 THEN 3 ELSE 0 END AS n_requests,
  CASE WHEN k = 10 THEN 'Fastly' ELSE '' END AS cdn, CASE WHEN k = 10 AND h.scheme = 'https' THEN 'http://static.example.org/pic.png' ELSE '' END AS insecure,
  CASE k WHEN 6 THEN 'Google Tag Manager,Яндекс.Метрика' WHEN 10 THEN 'Hotjar' ELSE '' END AS risky FROM base b JOIN hosts h USING (host)
UNION ALL SELECT NULL, FALSE, 0, '', '', '' FROM audited WHERE page_id IS NULL""")
def resources(spark, sf):
    return facts(spark, sf).select(
        "page_id", c("banner_found").alias("banner"), F.size("network_requests").alias("n_requests"), F.coalesce("cdn", F.lit("")).alias("cdn"),
        F.array_join("insecure", ",").alias("insecure"), F.array_join("risk_requests", ",").alias("risky"))


@query("d06_homepages", CTE + """
SELECT host, scheme || '://' || host AS base_url, scheme || '://' || host || '/' AS home_url, TRUE AS reachable FROM hosts""")
def homes(spark, sf):
    return audited(spark, sf).homes.select(c("site_id").alias("host"), "base_url", "home_url", "reachable")


@query("d07_audit_set", CTE + f"""
, p AS (SELECT host, unnest({sorted(set(PATHS) | set(PLAN_GUESSES))}) AS path FROM hosts)
SELECT host, path, page_id, is_home, TRUE AS stored, 0 AS n_errors FROM audited
UNION ALL SELECT host, path, NULL, FALSE, FALSE, 1 FROM p ANTI JOIN audited USING (host, path)""")
def audit_pages(spark, sf):
    """All audited pages of all hosts, with the planned ones that are not stored."""
    return audited(spark, sf).audit.select(c("site_id").alias("host"), U.url_path(c("url")).alias("path"), "page_id", (c("page_pos") == 0).alias("is_home"),
                                           "stored", F.size("errors").alias("n_errors"))


@query("a01_site_context", CTE + """
SELECT host, n_pd AS n_forms, n_pd AS n_pd_forms, n_linked AS n_pd_linked, k4 AS newsletter_form, k5 AS file_upload, k5 AS medical, children, hr, k2 AS ecommerce,
  trackers AS trackers_present, trackers AS foreign_trackers_present, cookies AS cookies_present, banner AS cookie_banner_found, cookies AS marketing_before_consent,
  d7 AS has_privacy_policy, d6 AND linked AS has_cookie_policy, d11 AND linked AS has_ad_consent, d8 AND linked AS has_user_agreement,
  scheme = 'https' AS https_enabled, k10 AND scheme = 'https' AS mixed_content_found FROM flags""")
def context(spark, sf):
    return audited(spark, sf).context.select(
        c("site_id").alias("host"), "n_forms", "n_pd_forms", "n_pd_linked", "newsletter_form", "file_upload", "medical", "children", "hr", "ecommerce",
        "trackers_present", "foreign_trackers_present", "cookies_present", "cookie_banner_found", "marketing_before_consent", "has_privacy_policy",
        "has_cookie_policy", "has_ad_consent", "has_user_agreement", "https_enabled", "mixed_content_found")


@query("a16_w_site_trackers", CTE + f"""
SELECT DISTINCT host, provider, domain FROM audited a JOIN {vals(PAGE_HITS)} h(k, provider, domain, matched_on) USING (k)""")
def site_trackers(spark, sf):
    return audited(spark, sf).trackers.select(c("site_id").alias("host"), c("provider_name").alias("provider"), c("matched_domain").alias("domain"))


@query("a17_site_cookies", CTE + """
SELECT DISTINCT host, name, CASE name WHEN 'sid' THEN 'shop.ru' ELSE host END AS domain, CASE name WHEN 'sid' THEN 'unknown' ELSE 'analytics' END AS category
FROM audited, (SELECT unnest(['sid', '_ga']) AS name) WHERE k = 4""")
def site_cookies(spark, sf):
    return audited(spark, sf).cookies.select(c("site_id").alias("host"), "name", "domain", "category")


@query("a02_before_consent", CTE + """
SELECT host, (CASE WHEN k6 THEN 2 ELSE 0 END) + (CASE WHEN k10 THEN 1 ELSE 0 END) + (CASE WHEN k4 THEN 1 ELSE 0 END) AS n_items FROM flags WHERE cookies""")
def before(spark, sf):
    return audited(spark, sf).context.where("marketing_before_consent").select(c("site_id").alias("host"), F.size("before_consent_items").alias("n_items"))


@query("w01_documents", CTE + """
, d AS (SELECT * FROM flags)
SELECT host, 'privacy_policy' AS doc_type, d7 AS readable, d7 AS present, d7 AS confirmed FROM d
UNION ALL SELECT host, 'cookie_policy', coalesce(d6 AND linked, FALSE), coalesce(d6 AND linked, FALSE), coalesce(d6 AND linked, FALSE) FROM d
UNION ALL SELECT host, 'user_agreement', coalesce(d8 AND linked, FALSE), coalesce(d8 AND linked, FALSE), coalesce(d8 AND linked, FALSE) FROM d
UNION ALL SELECT host, 'ad_consent', FALSE, d11, d11 FROM d WHERE linked
UNION ALL SELECT host, 'consent', FALSE, FALSE, FALSE FROM d UNION ALL SELECT host, 'offer', FALSE, FALSE, FALSE FROM d""")
def documents(spark, sf):
    d = audited(spark, sf).documents
    return d.select(c("site_id").alias("host"), "doc_type", (c("is_accessible") & (c("text_length") > 0)).alias("readable"), "present",
                    c("link_confirmed").alias("confirmed"))


@query("p14_document_attributes", CTE + """
, d AS (SELECT host, d11, unnest(['privacy_policy', 'cookie_policy', 'user_agreement', 'ad_consent', 'consent', 'offer']) AS doc_type, unnest([d7, d6, d8, FALSE, FALSE, FALSE]) AS readable FROM flags),
e AS (SELECT *, doc_type = 'ad_consent' AND d11 AS failed, CASE WHEN doc_type = 'privacy_policy' AND readable THEN TRUE END AS policy FROM d)
SELECT host, doc_type, CASE WHEN readable OR failed THEN 200 ELSE 0 END::INT AS status, failed, CASE WHEN readable THEN '' WHEN failed THEN 'text_extraction_failed' ELSE 'unreachable' END AS error,
  NOT readable AS manual, readable AND doc_type = 'user_agreement' AS placeholder, CASE WHEN policy THEN '01.02.2024' END AS dated, CASE WHEN policy THEN '2.1' END AS version FROM e""")
def document_attributes(spark, sf):
    """Date and version are compared for the policies, whose text is known."""
    policy = (c("doc_type") == "privacy_policy") & c("is_accessible")
    return audited(spark, sf).documents.select(
        c("site_id").alias("host"), "doc_type", c("status_code").cast("int").alias("status"), c("text_extraction_failed").alias("failed"),
        c("extraction_error").alias("error"), c("requires_manual_review").alias("manual"), "placeholder",
        F.when(policy, c("date_detected")).alias("dated"), F.when(policy, c("version_detected")).alias("version"))


#: every item of the readable documents: the fragments' words and the flags of the site decide
ITEMS_CTE = CTE + """
, never(item_id) AS (VALUES ('PP_007'), ('PP_014')),
always(item_id) AS (VALUES ('PP_001'), ('PP_003'), ('PP_004'), ('PP_005'), ('PP_006'), ('PP_008'), ('PP_009'), ('PP_010'), ('PP_011'), ('PP_013'), ('PP_015'),
  ('PP_016'), ('PP_017'), ('PP_018'), ('PP_019'), ('PP_025'), ('PP_026'), ('PP_031')),
p AS (SELECT * FROM flags WHERE d7), k AS (SELECT * FROM flags WHERE d6), u AS (SELECT * FROM flags WHERE d8),
items AS (
  SELECT host, 'privacy_policy' AS doc_type, item_id, 'found' AS status FROM p, always UNION ALL SELECT host, 'privacy_policy', item_id, 'not_found' FROM p, never
  UNION ALL SELECT host, 'privacy_policy', unnest(['PP_002', 'PP_012', 'PP_020', 'PP_021', 'PP_022', 'PP_023', 'PP_024', 'PP_027', 'PP_028', 'PP_029', 'PP_030', 'PP_032']), unnest([
    CASE WHEN NOT pd THEN 'not_applicable' WHEN n_linked > 0 THEN 'found' ELSE 'not_found' END,
    CASE WHEN NOT pd THEN 'not_applicable' WHEN k5 THEN 'unclear' ELSE 'found' END,
    CASE WHEN trackers THEN 'not_found' ELSE 'unclear' END,
    CASE WHEN pd THEN 'not_found' ELSE 'not_applicable' END,
    CASE WHEN trackers THEN 'found' ELSE 'not_applicable' END,
    CASE WHEN cookies THEN 'not_found' ELSE 'not_applicable' END,
    CASE WHEN NOT trackers THEN 'not_applicable' WHEN k6 THEN 'unclear' ELSE 'not_found' END,
    CASE WHEN k5 THEN 'not_found' ELSE 'not_applicable' END,
    CASE WHEN k5 THEN 'not_found' ELSE 'not_applicable' END,
    CASE WHEN children THEN 'not_found' ELSE 'not_applicable' END,
    'not_applicable',
    CASE WHEN mail7 THEN 'not_found' ELSE 'found' END]) FROM p
  UNION ALL SELECT host, 'cookie_policy', item_id, status FROM k, (VALUES ('Cookie_001', 'found'), ('Cookie_002', 'found'), ('Cookie_003', 'unclear'), ('Cookie_004', 'unclear'),
    ('Cookie_005', 'unclear'), ('Cookie_006', 'not_found'), ('Cookie_007', 'found'), ('Cookie_008', 'not_found'), ('Cookie_009', 'not_found'), ('Cookie_010', 'not_found'),
    ('Cookie_011', 'not_found'), ('Cookie_012', 'not_found'), ('Cookie_013', 'unclear')) v(item_id, status)
  UNION ALL SELECT host, 'user_agreement', item_id, CASE WHEN item_id IN ('Offer_001', 'Offer_006') AND NOT k2 THEN 'not_applicable' ELSE status END FROM u, (VALUES ('Offer_001', 'found'),
    ('Offer_002', 'not_found'), ('Offer_003', 'not_found'), ('Offer_004', 'not_found'), ('Offer_005', 'not_found'), ('Offer_006', 'not_found'), ('Offer_007', 'not_found'),
    ('Offer_008', 'unclear')) v(item_id, status))
"""


def _readable(a):
    return a.documents.where("present and is_accessible").select("site_id", "doc_pos")


@query("c01_c23_policy_items", ITEMS_CTE + "SELECT * FROM items")
def policy_items(spark, sf):
    a = audited(spark, sf)
    return a.checklist.join(_readable(a), ["site_id", "doc_pos"]).select(c("site_id").alias("host"), "doc_type", "item_id", "status")


@query("a04_a05_readable_documents", ITEMS_CTE + """
, told AS (SELECT host, 'user_agreement' AS doc_type, 1 + trackers::INT + cookies::INT AS n FROM flags
  UNION ALL SELECT host, 'cookie_policy', mail6::INT FROM flags UNION ALL SELECT host, 'privacy_policy', mail7::INT FROM flags),
done AS (SELECT host, doc_type, count(*) FILTER (status = 'found') AS f, count(*) FILTER (status <> 'not_applicable') AS n_items FROM items GROUP BY ALL)
SELECT host, doc_type, round_even(100 * f / greatest(1, n_items), 0)::INT AS completeness, n::BIGINT AS n_conflicts, TRUE AS manual FROM done JOIN told USING (host, doc_type)""")
def readable_documents(spark, sf):
    a = audited(spark, sf)
    return a.analysis.join(_readable(a), ["site_id", "doc_pos"]).select(
        c("site_id").alias("host"), "doc_type", c("overall_completeness").alias("completeness"), "n_conflicts", c("requires_manual_review").alias("manual"))


@query("k01_k04_conflicts", CTE + """
SELECT host, 'user_agreement' AS doc_type, 'tracker_not_disclosed' AS type FROM flags WHERE d8 AND trackers
UNION ALL SELECT host, 'user_agreement', 'cookies_not_disclosed' FROM flags WHERE d8 AND cookies
UNION ALL SELECT host, 'user_agreement', 'company_conflict' FROM flags WHERE d8
UNION ALL SELECT host, 'cookie_policy', 'company_conflict' FROM flags WHERE mail6
UNION ALL SELECT host, 'privacy_policy', 'company_conflict' FROM flags WHERE mail7""")
def conflicts(spark, sf):
    return audited(spark, sf).conflicts.select(c("site_id").alias("host"), "doc_type", "type")


RULES_CTE = CTE + """
, f AS (SELECT *, NOT d7 AND pd AS r1,
  (k2 OR k4 OR k5 OR k9) AS r2, (k3 OR k4 OR k5 OR k9) AS r3 FROM flags),
fired AS (
  SELECT host, unnest([
    CASE WHEN r1 THEN 'R001' END, CASE WHEN r2 THEN 'R002' END, CASE WHEN r3 THEN 'R003' END, CASE WHEN k3 THEN 'R004' END,
    CASE WHEN k2 THEN 'R005' END, CASE WHEN k2 THEN 'R006' END, CASE WHEN d7 AND pd AND k5 THEN 'R009' END,
    CASE WHEN pd AND NOT d7 THEN 'R010' END, CASE WHEN trackers AND NOT banner THEN 'R011' END, CASE WHEN cookies THEN 'R012' END,
    CASE WHEN cookies AND NOT (d6 AND linked) AND NOT (d7 AND trackers) THEN 'R013' END, CASE WHEN trackers AND d7 THEN 'R014' END,
    CASE WHEN trackers THEN 'R015' END, CASE WHEN scheme <> 'https' THEN 'R017' END, CASE WHEN scheme = 'https' AND k10 THEN 'R018' END,
    CASE WHEN k4 AND NOT (d11 AND linked) THEN 'R019' END, CASE WHEN k5 THEN 'R020' END, CASE WHEN children THEN 'R021' END,
    CASE WHEN k5 THEN 'R022' END, CASE WHEN hr THEN 'R023' END, CASE WHEN k2 THEN 'R024' END, CASE WHEN d8 AND linked THEN 'R025' END,
    CASE WHEN (d8 AND linked) OR mail THEN 'R026' END, CASE WHEN pd THEN 'R027' END]) AS rule FROM f),
meta AS (SELECT * FROM (VALUES ('R001', 'critical', 3, 35), ('R002', 'high', 2, 25), ('R003', 'high', 2, 25), ('R004', 'high', 2, 20), ('R005', 'high', 2, 25),
  ('R006', 'high', 2, 25), ('R009', 'high', 2, 25), ('R010', 'high', 2, 20), ('R011', 'high', 2, 25), ('R012', 'high', 2, 25), ('R013', 'high', 2, 20),
  ('R014', 'high', 2, 20), ('R015', 'high', 2, 25), ('R017', 'high', 2, 25), ('R018', 'medium', 1, 15), ('R019', 'high', 2, 25), ('R020', 'critical', 3, 30),
  ('R021', 'high', 2, 25), ('R022', 'high', 2, 25), ('R023', 'high', 2, 25), ('R024', 'medium', 1, 15), ('R025', 'high', 2, 25), ('R026', 'medium', 1, 15),
  ('R027', 'medium', 1, 10)) m(rule, risk_level, lr, score))
"""


@query("r001_r027_risks", RULES_CTE + """
SELECT host, rule, risk_level, score, row_number() OVER (PARTITION BY host ORDER BY lr DESC, score DESC, rule) AS rank FROM fired JOIN meta USING (rule)""")
def risks(spark, sf):
    return audited(spark, sf).risks.select(
        c("site_id").alias("host"), F.split_part("rule_id", F.lit("_"), F.lit(1)).alias("rule"), "risk_level", "score", "rank")


SCORE_CTE = RULES_CTE + """
, scored AS (SELECT h.host, least(150, coalesce(sum(m.score), 0))::INT AS risk_score FROM hosts h LEFT JOIN fired USING (host) LEFT JOIN meta m USING (rule) GROUP BY h.host)
"""


@query("m01_summary", SCORE_CTE + """
SELECT host, 'https://' || host AS site_url, industry, risk_score, CASE WHEN risk_score <= 20 THEN 'low' WHEN risk_score <= 50 THEN 'medium' WHEN risk_score <= 80 THEN 'high' ELSE 'critical' END AS risk_level,
  n_pd AS forms_found, d7 AS privacy_policy_found, banner AS cookie_banner_found, (CASE WHEN k6 THEN 2 ELSE 0 END) + (CASE WHEN k10 THEN 1 ELSE 0 END) AS trackers_found,
  trackers AS foreign_trackers_found, 'scanned' AS status FROM scored JOIN f USING (host)""")
def summary(spark, sf):
    a = audited(spark, sf)
    return report.summary(a.scored, a.risks).select(
        c("site_id").alias("host"), "site_url", "industry", "risk_score", "risk_level", "forms_found", "privacy_policy_found", "cookie_banner_found",
        "trackers_found", "foreign_trackers_found", "status")


CORE_CTE = RULES_CTE + """
, core AS (SELECT *, (k1 OR k2) AS boxes FROM f),
checks AS (
  SELECT host, 0 AS pos, 'PP_001' AS id, CASE WHEN d7 THEN 'ok' WHEN pd THEN 'risk' ELSE 'not_applicable' END AS status FROM core
  UNION ALL SELECT host, 1, 'PP_002', CASE WHEN NOT pd THEN 'not_applicable' WHEN n_linked = n_pd THEN 'ok' WHEN n_linked > 0 THEN 'unclear' ELSE 'risk' END FROM core
  UNION ALL SELECT host, p, i, CASE WHEN d7 THEN 'ok' ELSE 'not_applicable' END FROM core, (VALUES (2, 'PP_003'), (3, 'PP_004'), (4, 'PP_009'), (5, 'PP_011'), (7, 'PP_015'), (8, 'PP_018'), (9, 'PP_019')) v(p, i)
  UNION ALL SELECT host, 6, 'PP_012', CASE WHEN NOT pd OR NOT d7 THEN 'not_applicable' WHEN k5 THEN 'unclear' ELSE 'ok' END FROM core
  UNION ALL SELECT host, 10, 'PP_020', CASE WHEN trackers THEN 'risk' ELSE 'unclear' END FROM core
  UNION ALL SELECT host, 11, 'PP_024', CASE WHEN NOT trackers THEN 'not_applicable' WHEN d7 AND k6 THEN 'unclear' ELSE 'risk' END FROM core
  UNION ALL SELECT host, 12, 'PP_031', CASE WHEN d8 AND linked THEN 'risk' ELSE 'ok' END FROM core
  UNION ALL SELECT host, 13, 'PP_032', CASE WHEN (d8 AND linked) OR mail THEN 'risk' WHEN d7 THEN 'ok' ELSE 'not_applicable' END FROM core
  UNION ALL SELECT host, 14, 'Consent_011', CASE WHEN NOT pd THEN 'not_applicable' WHEN k2 THEN 'risk' WHEN k1 THEN 'ok' ELSE 'unclear' END FROM core
  UNION ALL SELECT host, 15, 'R003', CASE WHEN NOT pd THEN 'not_applicable' WHEN r3 THEN 'risk' ELSE 'ok' END FROM core
  UNION ALL SELECT host, 16, 'R017', CASE WHEN scheme = 'https' THEN 'ok' ELSE 'risk' END FROM core
  UNION ALL SELECT host, 17, 'Cookie_001', CASE WHEN NOT cookies THEN 'not_applicable' WHEN banner THEN 'ok' ELSE 'risk' END FROM core
  UNION ALL SELECT host, 18, 'Cookie_006', CASE WHEN cookies THEN 'risk' ELSE 'not_applicable' END FROM core
  UNION ALL SELECT host, 19, 'PP_027', CASE WHEN k5 THEN 'risk' ELSE 'not_applicable' END FROM core
  UNION ALL SELECT host, 20, 'R019', CASE WHEN NOT k4 THEN 'not_applicable' WHEN d11 AND linked THEN 'ok' ELSE 'risk' END FROM core)
"""


@query("e01_e21_core_checks", CORE_CTE + "SELECT host, pos, id, status FROM checks")
def core(spark, sf):
    return audited(spark, sf).core.select(c("site_id").alias("host"), "pos", "id", "status")


#: finding, rule and core check that lead to it
MAP_ROWS = """('PD-01', 'R001', 'PP_001'), ('PD-03', 'R026', 'PP_032'), ('PD-06', 'R009', NULL), ('PD-10', 'R014', 'PP_024'), ('PD-11', 'R015', 'PP_020'),
  ('PD-13', 'R011', 'Cookie_001'), ('PD-14', 'R012', 'Cookie_006'), ('PD-16', 'R003', 'R003'), ('PD-17', 'R005', 'Consent_011'), ('PD-19', 'R019', 'R019'),
  ('PD-27', 'R020', 'PP_027'), ('PD-26', 'R021', NULL), ('PD-24', 'R022', NULL), ('PD-23', 'R023', NULL), ('PD-31', 'R025', NULL), ('PD-22', 'R027', NULL), ('PD-40', 'R017', 'R017'), ('PD-40', 'R018', NULL)"""
FINDINGS_CTE = CORE_CTE + f"""
, map(fid, rule, core_id) AS (VALUES {MAP_ROWS}),
found AS (SELECT host, fid, max(CASE WHEN r.rule IS NOT NULL THEN m.score END) AS rule_score FROM
    (SELECT h.host, map.* FROM hosts h, map) x LEFT JOIN fired r USING (host, rule) LEFT JOIN meta m USING (rule)
    LEFT JOIN (SELECT host, id AS core_id FROM checks WHERE status = 'risk') k USING (host, core_id)
  WHERE r.rule IS NOT NULL OR k.core_id IS NOT NULL GROUP BY host, fid)
"""


@query("f01_f12_findings", FINDINGS_CTE + "SELECT host, fid AS finding_id, coalesce(rule_score, 20) AS score FROM found")
def findings(spark, sf):
    return audited(spark, sf).findings.select(c("site_id").alias("host"), "finding_id", "score")


@query("a10_commercial_score", FINDINGS_CTE + """
SELECT host, least(150, sum(coalesce(rule_score, 20)))::INT AS pd_score, CASE WHEN sum(coalesce(rule_score, 20)) >= 80 THEN 'critical' WHEN sum(coalesce(rule_score, 20)) >= 50 THEN 'high'
  WHEN sum(coalesce(rule_score, 20)) >= 25 THEN 'medium' ELSE 'low' END AS pd_level FROM found GROUP BY host""")
def commercial(spark, sf):
    return Fi.commercial_score(audited(spark, sf).findings).withColumnRenamed("site_id", "host")


@query("a13_tiles", CORE_CTE + """
SELECT f.host, (SELECT count(*) FROM checks k WHERE k.host = f.host AND status = 'risk') AS risk_zones,
  (CASE WHEN k6 THEN 1 ELSE 0 END) + (CASE WHEN k10 THEN 1 ELSE 0 END) AS foreign_services,
  d7::INT + (CASE WHEN linked THEN d6::INT + d8::INT + d11::INT ELSE 0 END) AS docs_found FROM f""")
def tiles(spark, sf):
    a = audited(spark, sf)
    return report.tiles(a.scored, a.core).select(c("site_id").alias("host"), "risk_zones", "foreign_services", "docs_found")


@query("a14_recommendations", RULES_CTE + """
SELECT host, CASE WHEN lr >= 2 THEN 'urgent' WHEN lr = 1 THEN 'soon' ELSE 'optional' END AS urgency, count(*) AS n FROM fired JOIN meta USING (rule) GROUP BY 1, 2""")
def recommendations(spark, sf):
    return report.recommendations(audited(spark, sf).risks).select(c("site_id").alias("host"), "urgency", F.size("rule_ids").alias("n"))


@query("m02_forms_table", CTE + f"""
SELECT host, page_id, form_type, replace(personal, ',', ', ') AS fields, CASE WHEN boxes = 1 THEN 'да' ELSE 'нет' END AS checkbox, CASE WHEN linked = 1 THEN 'да' ELSE 'нет' END AS policy_link,
  CASE WHEN boxes = 0 THEN '?' WHEN prechecked = 1 THEN 'да' ELSE 'нет' END AS prechecked, 'да' AS personal FROM audited JOIN {vals(FORMS)} f({FORM_COLS}) USING (k)""")
def forms_table(spark, sf):
    a = audited(spark, sf)
    t = report.forms_table(a.forms).join(a.audit.select("site_id", "page_pos", "page_id"), ["site_id", "page_pos"])
    return t.select(c("site_id").alias("host"), "page_id", "form_type", "fields", "checkbox", "policy_link", "prechecked", "personal")


@query("m04_services_table", CTE + f"""
SELECT DISTINCT host, 'tracker' AS kind, provider AS name, domain FROM audited JOIN {vals(PAGE_HITS)} h(k, provider, domain, matched_on) USING (k)
UNION ALL SELECT DISTINCT host, 'cookie', name, CASE name WHEN 'sid' THEN 'shop.ru' ELSE host END FROM audited, (SELECT unnest(['sid', '_ga']) AS name) WHERE k = 4""")
def services(spark, sf):
    a = audited(spark, sf)
    return report.services_table(a.trackers, a.cookies).select(c("site_id").alias("host"), "kind", "name", "domain")


@query("w03_m12_risk_cards", RULES_CTE + """
SELECT * FROM (SELECT host, row_number() OVER (PARTITION BY host ORDER BY lr DESC, score DESC, rule) AS rank, risk_level AS level,
  CASE risk_level WHEN 'critical' THEN 'критический' WHEN 'high' THEN 'высокий' ELSE 'средний' END AS level_label FROM fired JOIN meta USING (rule)) WHERE rank <= 3""")
def cards(spark, sf):
    return report.risk_cards(audited(spark, sf).risks).select(c("site_id").alias("host"), "rank", "level", "level_label")


#: the homepage, the archive, and all linked or guessed paths, stored or not
PAGES = f"(1 + n_archived + {len(set(PATHS) | set(PLAN_GUESSES))})"


@query("a09_a18_confidence", SCORE_CTE + f"""
, n AS (SELECT host, count(*) AS fired FROM fired WHERE rule IS NOT NULL GROUP BY host),
q AS (SELECT f.host, 50 + least(5 * (d7::INT + CASE WHEN linked THEN d6::INT + d8::INT ELSE 0 END), 20) + least(3 * coalesce(fired, 0), 12) + 5 * trackers::INT + 3 * k4::INT
    + 5 - 6 * (d11 AND linked)::INT - least(5 * ({PAGES} - n_audited), 20) - 10 - 5 - 1 AS confidence FROM f LEFT JOIN n USING (host))
SELECT host, confidence, confidence < 50 AS low_confidence FROM q""")
def confidence(spark, sf):
    return audited(spark, sf).scored.select(c("site_id").alias("host"), "confidence", "low_confidence")


@query("w08_unique_documents", CTE + """
, d AS (SELECT *, scheme || '://' || host AS b FROM flags)
SELECT host, 'privacy_policy' AS doc_type, b || '/privacy-policy' AS url, FALSE AS manual_only FROM d WHERE d7
UNION ALL SELECT host, 'cookie_policy', b || '/about', FALSE FROM d WHERE d6 AND linked
UNION ALL SELECT host, 'user_agreement', b || '/legal/doc-8', FALSE FROM d WHERE d8 AND linked
UNION ALL SELECT host, 'ad_consent', b || '/shell', TRUE FROM d WHERE d11 AND linked""")
def unique_documents(spark, sf):
    a = audited(spark, sf)
    return report.unique_documents(a.documents, a.analysis, a.checklist).select(c("site_id").alias("host"), "doc_type", "url", "manual_only")


@query("m05_executive_summary", SCORE_CTE + f"""
SELECT host, {PAGES} AS pages, n_pd AS forms, d7::INT + CASE WHEN linked THEN d6::INT + d8::INT ELSE 0 END AS docs, risk_score AS score,
  CASE WHEN trackers THEN 'есть' ELSE 'не замечены' END AS services FROM scored JOIN f USING (host)""")
def executive(spark, sf):
    a = audited(spark, sf)
    t = report.executive_summary(a.scored, a.risks)

    def num(word):
        return F.regexp_extract("executive_summary", word + r" (\d+)", 1).cast("int")

    return t.select(c("site_id").alias("host"), num("Страниц:").alias("pages"), num("форм:").alias("forms"), num("документов:").alias("docs"),
                    num("баллы").alias("score"), F.regexp_extract("executive_summary", "сервисы (есть|не замечены)", 1).alias("services"))


@query("m06_f13_facts", FINDINGS_CTE + f"""
, g AS (SELECT host, count(*) AS n, least(150, sum(coalesce(rule_score, 20)))::INT AS pd_score FROM found GROUP BY host)
SELECT host, {PAGES} AS pages, n_pd AS forms, coalesce(pd_score, 0) AS risk_score, greatest(0, coalesce(n, 0) - 4) AS hidden, coalesce(n, 0) AS n_ids,
  d7::INT + CASE WHEN linked THEN d6::INT + d8::INT + d11::INT ELSE 0 END AS n_docs,
  d7::INT + CASE WHEN linked THEN d6::INT + d8::INT ELSE 0 END AS n_read, TRUE AS compact FROM f LEFT JOIN g USING (host)""")
def fact_texts(spark, sf):
    a = audited(spark, sf)
    b = Fi.fact_bundle(a.scored, a.documents, a.trackers, a.findings)
    t = report.text_facts(a.scored, a.documents, a.trackers, a.risks)
    return b.join(t, "site_id").select(
        c("site_id").alias("host"), c("bundle.pages_checked").alias("pages"), c("bundle.forms_found").alias("forms"), c("bundle.risk_score").alias("risk_score"),
        c("bundle.hidden_findings_count").alias("hidden"), F.size("bundle.all_finding_ids").alias("n_ids"), F.size("bundle.documents").alias("n_docs"),
        F.size("facts.documents_found").alias("n_read"), (F.length(F.to_json("bundle")) < 12000).alias("compact"))


@query("m11_scan_header", SCORE_CTE + f"""
SELECT host, '2024-01-01T00:00:00' AS created_at, 'https://' || host AS site_url, scheme || '://' || host AS final_url, risk_score, {PAGES} AS pages_checked,
  banner AS cookie_banner_found, cookies AS marketing_before_consent, trackers AS foreign_trackers_found, 'scanned' AS status, 'http' AS fetch_method
FROM scored JOIN f USING (host)""")
def header(spark, sf):
    a = audited(spark, sf)
    return report.scan_header(a.scored, a.risks, "2024-01-01T00:00:00").select(
        c("site_id").alias("host"), "created_at", "site_url", "final_url", "risk_score", "pages_checked", "cookie_banner_found", "marketing_before_consent",
        "foreign_trackers_found", "status", "fetch_method")


# ---- outside input: stored bodies, suggestions, verdicts ------------------------------------
@query("j06_j07_stored_bodies", CTE + """
SELECT host, 'https://' AS x, TRUE AS readable, 'docx' AS format FROM hosts""")
def bodies(spark, sf):
    """Every site has a word file behind its usual offer path; the text arrives with the store."""
    a = audited(spark, sf)
    stored = a.homes.select(F.concat("base_url", F.lit("/oferta")).alias("url"), F.lit("application/msword").alias("content_type"),
                            F.lit(b"x").alias("content"), F.lit("Публичная оферта").alias("text"))
    docs = W.dedupe_documents(W.resolve_documents(a.candidates, a.audit, a.facts, a.homes, body_texts(stored)))
    return docs.where("doc_type = 'offer' and present").select(
        c("site_id").alias("host"), F.lit("https://").alias("x"), c("is_accessible").alias("readable"), "format")


@query("j12_suggestions", CTE + """
SELECT host, page_id FROM audited WHERE path LIKE '/archive/%' AND k IN (1, 3, 7)""")
def suggestions(spark, sf):
    """A reviewer names all archived pages of a site as policies; those that read like one are kept."""
    a = audited(spark, sf)
    pages = a.facts.where(c("url").contains("/archive/")).withColumn("host", U.get_host(c("url")))
    item = F.struct("page_id", F.struct("url", F.lit("privacy_policy").alias("doc_type")).alias("s"))
    answers = pages.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]).alias("l")).select(
        c("host").alias("site_id"), F.concat(F.lit("```json\n"), F.to_json(F.struct(c("l").alias("missed_documents"))), F.lit("\n```")).alias("answer"))
    new = W.ground_suggestions(W.read_suggestions(answers), a.documents, a.homes, a.audit, a.facts)
    return new.select(c("site_id").alias("host"), F.regexp_extract("url", r"/archive/(\d+)", 1).cast("long").alias("page_id"))


def _answers(a):
    verdict = F.lit('{"checklist_results": [{"id": "PP_014", "status": "found", "evidence_quote": "МЕРЫ защиты  приняты", "confidence": 80}, '
                    '{"id": "PP_007", "status": "found", "evidence_quote": "такой цитаты нет"}, {"id": "PP_003", "status": "not_found"},], '
                    '"conflicts": [{"type": "company_name", "risk": "HIGH"}, {"type": "tone", "risk": "odd"}]}')
    return a.documents.select("site_id", "doc_pos", "doc_type", "url", verdict.alias("answer"))


@query("j10_merge_verdicts", ITEMS_CTE + """
SELECT host, doc_type, item_id, CASE WHEN item_id = 'PP_014' THEN 'found' ELSE status END AS status, CASE WHEN item_id = 'PP_014' THEN 'merged' ELSE 'heuristic' END AS source FROM items""")
def verdicts(spark, sf):
    a = audited(spark, sf)
    items, _ = C.read_verdicts(_answers(a))
    merged = C.merge_verdicts(a.checklist, items, a.documents).join(_readable(a), ["site_id", "doc_pos"])
    return merged.select(c("site_id").alias("host"), "doc_type", "item_id", "status", "source")


@query("j11_merge_conflicts", CTE + """
, d AS (SELECT *, unnest(['privacy_policy', 'cookie_policy', 'user_agreement', 'consent', 'ad_consent', 'offer']) AS doc_type FROM flags)
SELECT host, doc_type, type, risk FROM d, (VALUES ('tone', 'medium'), ('company_name', 'high')) v(type, risk)
WHERE type = 'tone' OR CASE doc_type WHEN 'user_agreement' THEN d8 WHEN 'cookie_policy' THEN mail6 WHEN 'privacy_policy' THEN mail7 END""")
def outside_conflicts(spark, sf):
    a = audited(spark, sf)
    _, claimed = C.read_verdicts(_answers(a))
    return C.merge_conflicts(a.conflicts, claimed).where("source = 'llm'").select(
        c("site_id").alias("host"), "doc_type", "type", "risk")


@query("j16_legal_basis", RULES_CTE + """
SELECT host, rule, rule <> 'R019' AS data_law FROM fired JOIN meta USING (rule) WHERE rule <> 'R024'
UNION ALL SELECT host, rule, FALSE FROM fired WHERE rule = 'R024'""")
def basis(spark, sf):
    ids = audited(spark, sf).risks.select("site_id", "rule_id")
    return R.legal_basis(ids).select(c("site_id").alias("host"), F.split_part("rule_id", F.lit("_"), F.lit(1)).alias("rule"),
                                     c("legal_basis").startswith("152-ФЗ").alias("data_law"))


# ---- without SQL: checked by unit tests on small fixtures ----------------------------------
@query("a04_a06_doc_analysis")
def doc_analysis(spark, sf):
    return audited(spark, sf).analysis.select(c("site_id").alias("host"), "doc_pos", "doc_type", "overall_completeness", "n_conflicts", "summary")


@query("m03_w07_w09_documents_table")
def documents_table(spark, sf):
    a = audited(spark, sf)
    t = report.documents_table(a.documents, a.analysis, a.checklist, a.conflicts).join(report.open_items(a.checklist), ["site_id", "doc_pos"], "left")
    return t.select(c("site_id").alias("host"), "doc_pos", "doc_type", "url", "is_accessible", "overall_completeness",
                    F.array_join("critical_missing", "; ").alias("critical_missing"), F.array_join("conflicts", "; ").alias("conflicts"),
                    F.array_join("open_items", "; ").alias("open_items"))


# ---- what the fragments cannot show: an outside review of policies, and servers abroad -------------
#: number of a host
HOST_NUMBER = "(3 * length(host) + ascii(substring(host, 5, 1)))"
REVIEWED_CTE = CORE_CTE + f"""
, n AS (SELECT *, {HOST_NUMBER} AS n FROM f),
reviewed AS (SELECT host, pd, d7 AND n % 2 = 0 AS no_operator, d7 AND n % 3 < 2 AS no_purpose, d7 AND n % 5 < 3 AS no_terms, pd AND n % 7 < 4 AS abroad FROM n),
refired AS (SELECT host, rule FROM fired WHERE rule IS NOT NULL UNION SELECT host, unnest([CASE WHEN no_operator THEN 'R007' END, CASE WHEN no_purpose THEN 'R008' END,
  CASE WHEN no_terms AND pd THEN 'R010' END, CASE WHEN abroad THEN 'R016' END]) FROM reviewed),
remeta AS (SELECT * FROM meta UNION ALL VALUES ('R007', 'high', 2, 20), ('R008', 'high', 2, 25), ('R016', 'high', 2, 20)),
rechecks AS (SELECT host, id AS core_id FROM checks WHERE status = 'risk' UNION SELECT host, unnest([CASE WHEN no_operator THEN 'PP_003' END, CASE WHEN no_purpose THEN 'PP_009' END,
  CASE WHEN no_purpose THEN 'PP_011' END, CASE WHEN no_terms THEN 'PP_015' END, CASE WHEN no_terms THEN 'PP_018' END]) FROM reviewed),
remap(fid, rule, core_id) AS (VALUES {MAP_ROWS}, ('PD-04', 'R007', 'PP_003'), ('PD-05', NULL, 'PP_009'), ('PD-07', NULL, 'PP_011'), ('PD-08', NULL, 'PP_015'),
  ('PD-09', NULL, 'PP_018'), ('PD-40', 'R016', NULL))
"""


def _reviewed(spark, sf):
    """The context of the audit after a review of the policies found gaps, some servers abroad; with the rules that fire on it."""
    ctx = audited(spark, sf).context
    number = F.expr(HOST_NUMBER.replace("host", "site_id"))
    gaps = ((number % 2 == 0, ("PP_003", "PP_005")), (number % 3 < 2, ("PP_009", "PP_011")), (number % 5 < 3, ("PP_015", "PP_018")))

    def missing(item, old):
        gap = F.lit(False)
        for cond, ids in gaps:
            gap = gap | (cond & item.isin(*ids))
        return F.when(gap, old.withField("status", F.lit("not_found"))).otherwise(old)

    abroad = number % 7 < 4
    ctx = ctx.withColumns({
        "items": F.when(c("policy_readable"), F.transform_values("items", missing)).otherwise(c("items")),
        "server_country": F.when(abroad, "NL").otherwise("RU"), "geoip_confidence": F.lit(80)})
    return ctx, R.apply_rules(ctx)


@query("r007_r008_r016_reviewed_risks", REVIEWED_CTE + """
SELECT host, rule, risk_level, score, row_number() OVER (PARTITION BY host ORDER BY lr DESC, score DESC, rule) AS rank FROM refired JOIN remeta USING (rule)""")
def reviewed_risks(spark, sf):
    return _reviewed(spark, sf)[1].select(
        c("site_id").alias("host"), F.split_part("rule_id", F.lit("_"), F.lit(1)).alias("rule"), "risk_level", "score", "rank")


@query("f03_f04_reviewed_findings", REVIEWED_CTE + """
SELECT host, fid AS finding_id, coalesce(max(CASE WHEN r.rule IS NOT NULL THEN m.score END), 20) AS score FROM (SELECT h.host, remap.* FROM hosts h, remap) x
LEFT JOIN refired r USING (host, rule) LEFT JOIN remeta m USING (rule) LEFT JOIN rechecks k USING (host, core_id) WHERE r.rule IS NOT NULL OR k.core_id IS NOT NULL GROUP BY host, fid""")
def reviewed_findings(spark, sf):
    ctx, risks = _reviewed(spark, sf)
    return Fi.findings(ctx, risks, E.core_checks(ctx, risks)).select(c("site_id").alias("host"), "finding_id", "score")


@query("a19_a20_unreachable_sites", SCORE_CTE + f"""
SELECT host, CASE WHEN up THEN risk_score ELSE 0 END AS risk_score, CASE WHEN NOT up THEN 'unknown' WHEN risk_score <= 20 THEN 'low' WHEN risk_score <= 50 THEN 'medium'
  WHEN risk_score <= 80 THEN 'high' ELSE 'critical' END AS risk_level, TRUE AS manual, NOT up AS no_confidence,
  CASE WHEN up THEN 'Страницы получены без браузера: часть ссылок могла не загрузиться.' ELSE 'Сайт недоступен: главная страница не получена.' END AS first_error
FROM (SELECT *, {HOST_NUMBER} % 4 <> 0 AS up FROM scored)""")
def unreachable(spark, sf):
    """Every fourth homepage is lost: no risks, no score, and the reason among the errors."""
    up = F.expr(HOST_NUMBER.replace("host", "site_id")) % 4 != 0
    ctx = audited(spark, sf).context.withColumn("reachable", up)
    return R.score_sites(ctx, R.apply_rules(ctx)).select(
        c("site_id").alias("host"), "risk_score", "risk_level", c("requires_manual_review").alias("manual"), (c("confidence") == 0).alias("no_confidence"),
        F.get("errors", F.lit(0)).alias("first_error"))
