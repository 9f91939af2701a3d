"""Forms, fields and consent mechanics from element records.

Everything here is one expression per page row: no explode, no shuffle. What lies inside an element
is a slice of the row's sorted arrays, by the ranges that the parser's sweep left on the element, so
no lambda compares all pairs. ``let`` binds an intermediate value once, so that a lambda over scopes
does not evaluate it again per scope.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens import catalogue
from sitelens.functions import elements as P
from sitelens.functions import text as X
from sitelens.functions.text import let
from sitelens.operators.html_parse import NOT_A_FIELD

# ---- fixed values: words of form purposes and of consent ---------------------------
NEWSLETTER = ("подписаться", "подписк", "рассылк", "новости", "subscribe", "newsletter", "дайджест")
CALLBACK = ("звонк", "звонок", "перезвон", "callback", "заявк", "обратный звонок", "заказать звонок", "перезвоните",
            "обратная связь", "жду звонка")
ORDER = ("заказ", "корзин", "оформить", "купить", "оплат", "checkout", "order", "cart", "buy",
         "оформление заказа")
MEDICAL = ("медицин", "клиник", "врач", "диагноз", "симптом", "запись на прием", "запись к врачу", "здоровье", "лечен",
           "анализ")
HR = ("резюме", "ваканси", "career", "careers", "работа у нас", "отклик", "трудоустройство", "соискател", "job")
CHILDREN = ("ребен", "дети", "детей", "школьник", "ученик", "возраст ребенка", "имя ребенка", "детск")
CONSENT_TEXT = ("согласие", "согласен", "согласна", "даю согласие", "обработка персональных данных",
                "обработку персональных данных", "персональные данные", "персональных данных", "политика",
                "политику", "privacy", "consent")
PRIVACY_LINK = ("privacy", "policy", "персональн", "политик", "consent", "согласие", "cookie", "куки", "оферт",
                "конфиденциальн", "personal-data", "soglasie", "personal")
CONSENT_LINK = ("согласие", "consent", "soglasie")
AD_CONSENT = ("реклам", "рассылк", "маркетинг", "marketing", "рекламн")
COOKIE_CONSENT = ("cookie", "куки")
BUTTON_ACCEPTANCE = ("нажимая кнопку", "нажимая на кнопку", "отправляя форму", "нажимая «отправить»",
                     'нажимая "отправить"', "нажатием кнопки")
OFFER_WORDS = ("оферт", "пользовательск соглашен", "пользовательское соглашение")

# Form widgets drawn by a provider's script, with their markers.
WIDGETS = [
    {"key": "tilda", "name": "Tilda", "form_type": "lead", "markers": ["t-form", "tildaform", "t396", "tilda"]},
    {"key": "bitrix24", "name": "Bitrix24", "form_type": "lead",
     "markers": ["b24-form", "b24-window", "crm-webform", "bitrix/js/crm", "bitrix24"]},
    {"key": "amocrm", "name": "amoCRM", "form_type": "lead", "markers": ["amoforms", "amo-forms", "amocrm"]},
    {"key": "envybox", "name": "Envybox", "form_type": "callback", "markers": ["envycallback", "envybox", "eb-"]},
    {"key": "marquiz", "name": "Marquiz", "form_type": "lead", "markers": ["marquiz"]},
    {"key": "flexbe", "name": "Flexbe", "form_type": "lead", "markers": ["fb-form", "flexbe"]},
    {"key": "jivosite", "name": "JivoSite", "form_type": "other", "markers": ["jivosite", "jivo"]},
]
WIDGET_DDL = "key string, name string, form_type string, markers array<string>"

FIELD = ("struct<name: string, field_type: string, label: string, placeholder: string, category: string, "
         "required: boolean, raw_html: string>")
CONSENT = (
    "struct<checkbox_found: boolean, checkbox_prechecked: boolean, consent_text_found: boolean, "
    "privacy_link_found: boolean, consent_link_found: boolean, ad_consent_found: boolean, "
    "cookie_consent_found: boolean, button_acceptance_only: boolean, merged_with_offer: boolean, "
    "privacy_link_urls: array<string>, evidence_text: string, evidence_html: string, confidence: int>"
)
FORM = (
    "struct<form_id: string, source: string, form_type: string, fields: array<" + FIELD + ">, "
    "personal_data_fields: array<string>, submit_text: string, is_newsletter: boolean, is_callback: boolean, "
    "is_order: boolean, is_medical: boolean, is_hr: boolean, is_children_related: boolean, "
    "has_file_upload: boolean, personal: boolean, quote: string, snippet: string, confidence: int, "
    "consent: " + CONSENT + ">"
)


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _between(arr: Column, start: Column, end: Column) -> Column:
    """Elements start .. end - 1, counted from 0."""
    return F.slice(arr, start + 1, end - start)


def _text(node: Column, text: Column) -> Column:
    return F.substr(text, node["t0"] + 1, node["t1"] - node["t0"])


def _kind(node: Column) -> Column:
    return F.lower(X.strip(node["type"]))


def _submit_class(node: Column) -> Column:
    cls = X.normalize_for_search(node["class"])
    return cls.contains("btn") | cls.contains("button") | cls.contains("submit")


def controls(nodes: Column, text: Column) -> Column:
    """Fillable fields with label and category; ``loose_category`` ignores ``<label for>``."""
    def labelled(c):
        aria, title = X.clean_text(c["aria_label"]), X.clean_text(c["title"])
        linked, near = (F.when(c[k].isNotNull(), _text(c[k], text)) for k in ("linked", "around"))

        def pick(*options):
            return F.coalesce(*[F.when(o != "", o) for o in options], F.lit(""))

        return F.struct(
            c["pos"].alias("pos"), X.strip(c["name"]).alias("name"),
            F.when(c["tag"] != "input", c["tag"]).when(_kind(c) == "", "text").otherwise(_kind(c)).alias("field_type"),
            pick(aria, linked, near, title).alias("label"), pick(aria, near, title).alias("loose_label"),
            X.strip(c["placeholder"]).alias("placeholder"),
            (c["required"] | (F.lower(X.strip(c["aria_required"])) == "true")).alias("required"),
            c["html"].alias("html"),
        )

    def classified(c):
        def category(name):
            return P.classify_field(c["name"], c["field_type"], c[name], c["placeholder"])

        return F.struct(
            *[c[k].alias(k) for k in ("pos", "name", "field_type", "placeholder", "required", "html")],
            c["label"].alias("label"), category("label").alias("category"),
            F.when(c["label"] == c["loose_label"], F.lit(None)).otherwise(category("loose_label")).alias("loose_category"),
        )

    fillable = F.filter(nodes, lambda n: n["tag"].isin("textarea", "select")
                        | ((n["tag"] == "input") & ~_kind(n).isin(*NOT_A_FIELD)))
    return F.transform(F.transform(fillable, labelled), classified)


def scopes(nodes: Column, fields: Column, min_controls: int, containers: int | None = None) -> Column:
    """Every form, then the outermost form-less containers that look like one, of the page's first
    ``containers`` or of all."""
    forms = F.filter(nodes, lambda n: n["tag"] == "form")
    boxes = F.filter(nodes, lambda n: n["tag"].isin("div", "section", "aside", "article")
                     & ~n["mixed"] & (n["f1"] > n["f0"]) & (n["s1"] > n["s0"])
                     & (F.lit(True) if containers is None else n["rank"] < containers))

    def personal(c):
        return F.coalesce(c["loose_category"], c["category"]).isin(*P.PERSONAL_CATEGORIES)

    def outermost(gs):
        """In document order a container lies inside an earlier one when that reaches over it."""
        start = F.struct(F.lit(-1).alias("reach"), F.slice(gs, 1, 0).alias("out"))

        def step(acc, g):
            return F.struct(F.greatest(acc["reach"], g["last"]).alias("reach"),
                            F.when(g["pos"] > acc["reach"], F.array_append(acc["out"], g)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(gs, start, step)["out"]

    def chosen(b):
        groups = F.filter(b["boxes"], lambda n: (n["f1"] - n["f0"] >= min_controls)
                          | F.exists(_between(b["fields"], n["f0"], n["f1"]), personal))
        return F.concat(b["forms"], let(groups, outermost))

    return let(F.struct(forms.alias("forms"), boxes.alias("boxes"), fields.alias("fields")), chosen)


def _scope_facts(s: Column, i: Column, nodes: Column, fields: Column, text: Column) -> Column:
    own = _between(fields, s["f0"], s["f1"])
    inner = _between(nodes, s["n0"], s["n1"])
    near = F.filter(_between(nodes, s["n0"] - 1, s["area_n1"]), lambda n: ~F.exists(s["area"], lambda a: a["pos"] == n["pos"]))

    def submit(ns):
        buttons = F.transform(F.filter(ns, lambda n: (n["tag"] == "button") & (_kind(n) != "reset")),
                              lambda n: _text(n, text))
        inputs = F.transform(
            F.filter(ns, lambda n: (n["tag"] == "input") & _kind(n).isin("submit", "button", "image")),
            lambda n: F.when(X.strip(n["value"]) != "", X.strip(n["value"])).otherwise(X.strip(n["alt"])))
        links = F.transform(F.filter(ns, lambda n: (n["tag"] == "a") & _submit_class(n)), lambda n: _text(n, text))
        return X.truncate(F.coalesce(_first(F.filter(F.concat(buttons, inputs, links), lambda t: t != "")),
                                     F.lit("")), 120)

    pieces = F.filter(F.transform(s["area"], lambda a: _text(a, text)), lambda t: t != "")
    boxes = F.filter(near, lambda n: ((n["tag"] == "input") & (_kind(n) == "checkbox")) | (n["role"] == "checkbox"))
    links = F.transform(
        F.filter(near, lambda n: n["tag"] == "a"),
        lambda n: F.struct(X.strip(n["href"]).alias("href"),
                           X.normalize_for_search(F.concat_ws(" ", X.strip(n["href"]), _text(n, text))).alias("norm")))
    return F.struct(
        i.alias("pos"), own.alias("fields"), let(inner, submit).alias("submit_text"),
        _text(s, text).alias("text"), F.array_join(pieces, " ").alias("area_text"),
        F.transform(boxes, lambda n: n["checked"] | (F.lower(X.strip(n["aria_checked"])) == "true")).alias("boxes"),
        links.alias("links"), X.truncate(s["html"], 800).alias("html"),
    )


def _consent(s: Column, area: Column) -> Column:
    found = F.size(s["boxes"]) > 0
    has_text = X.has_any(area, CONSENT_TEXT)

    def link(words):
        return F.exists(s["links"], lambda a: X.has_any(a["norm"], words))

    ad = link(AD_CONSENT) | X.has_any(area, AD_CONSENT)
    cookie = link(COOKIE_CONSENT) | X.has_any(area, COOKIE_CONSENT)
    button = X.has_any(area, BUTTON_ACCEPTANCE) & ~found
    urls = F.filter(s["links"], lambda a: X.has_any(a["norm"], PRIVACY_LINK) & (a["href"] != "")
                    & ~F.lower(a["href"]).rlike("^(mailto:|tel:|javascript:|#)"))
    privacy = link(PRIVACY_LINK)

    def points(c, n):
        return F.when(c, n).otherwise(0)

    score = (points(found, 30) + points(has_text, 25) + points(privacy, 25) + points(button, 10)
             + points(ad | cookie, 10))
    return F.struct(
        found.alias("checkbox_found"),
        F.when(found, F.exists(s["boxes"], lambda b: b)).alias("checkbox_prechecked"),
        has_text.alias("consent_text_found"), privacy.alias("privacy_link_found"),
        link(CONSENT_LINK).alias("consent_link_found"), ad.alias("ad_consent_found"),
        cookie.alias("cookie_consent_found"), button.alias("button_acceptance_only"),
        (has_text & X.has_any(area, OFFER_WORDS)).alias("merged_with_offer"),
        F.array_distinct(F.transform(urls, lambda a: a["href"])).alias("privacy_link_urls"),
        X.truncate(s["area_text"], 500).alias("evidence_text"), s["html"].alias("evidence_html"),
        F.least(score, F.lit(95)).alias("confidence"),
    ).cast(CONSENT)


def _form(s: Column, source: str) -> Column:
    fields = s["fields"]

    def any_category(*names):
        return F.exists(fields, lambda f: f["category"].isin(*names))

    def pluck(key):
        return F.transform(fields, lambda f: f[key])

    parts = [F.array(s["text"], s["submit_text"])] + [pluck(k) for k in ("label", "placeholder", "name")]
    bound = F.struct(
        X.normalize_for_search(F.array_join(F.concat(*parts), " ")).alias("all"),
        X.normalize_for_search(s["area_text"]).alias("area"))

    def build(b):
        words = b["all"]
        personal = F.array_sort(F.array_distinct(F.filter(
            F.transform(fields, lambda f: f["category"]), lambda c: c.isin(*P.PERSONAL_CATEGORIES))))
        upload = F.exists(fields, lambda f: (f["category"] == "file") | (f["field_type"] == "file"))
        telling = F.filter(fields, lambda f: ~f["category"].isin("consent", "other", "unknown"))
        email_only = (any_category("email") & (F.size(telling) <= 1)
                      & F.forall(telling, lambda f: f["category"] == "email"))
        return F.struct(
            personal.alias("personal"), upload.alias("upload"),
            (email_only & X.has_any(words, NEWSLETTER)).alias("newsletter"),
            (any_category("phone") & X.has_any(words, CALLBACK)).alias("callback"),
            X.has_any(words, ORDER).alias("order"),
            (any_category("medical") | X.has_any(words, MEDICAL)).alias("medical"),
            X.has_any(words, HR).alias("hr"),
            (any_category("children") | X.has_any(words, CHILDREN)).alias("children"),
            _consent(s, b["area"]).alias("consent"),
        )

    def finish(b):
        kinds = ("newsletter", "callback", "order", "medical", "hr", "children")
        kind = F.coalesce(*[F.when(b[k], k) for k in kinds], F.lit("generic"))
        consent = b["consent"]

        def points(c, n):
            return F.when(c, n).otherwise(0)

        confidence = (40 + points(F.size(b["personal"]) > 0, 15) + points(F.size(fields) >= 3, 10)
                      + points(s["submit_text"] != "", 10)
                      + points(consent["checkbox_found"] | consent["consent_text_found"], 10)
                      + points(consent["privacy_link_found"], 5))
        return F.struct(
            F.concat(F.lit(source + "-"), s["pos"].cast("string")), F.lit(source), kind,
            F.transform(fields, lambda f: F.struct(
                f["name"], f["field_type"], X.truncate(f["label"], 200), X.truncate(f["placeholder"], 200),
                f["category"], f["required"], X.truncate(f["html"], 300))),
            b["personal"], s["submit_text"], b["newsletter"], b["callback"], b["order"], b["medical"], b["hr"],
            b["children"], b["upload"], F.size(b["personal"]) > 0,
            X.truncate(F.when(s["text"] != "", s["text"]).otherwise(s["submit_text"]), 300), s["html"],
            F.least(confidence, F.lit(90)), consent,
        ).cast(FORM)

    return let(let(bound, build), finish)


def page_forms(nodes: Column, text: Column, source: str, containers: int | None = None) -> Column:
    """array<form> of one page or one modal."""
    def build(b):
        facts = F.transform(scopes(b["nodes"], b["fields"], 1 if source == "modal" else 2, containers),
                            lambda s, i: _scope_facts(s, i, b["nodes"], b["fields"], b["text"]))
        return F.transform(F.filter(facts, lambda s: F.size(s["fields"]) > 0), lambda s: _form(s, source))

    bound = F.struct(nodes.alias("nodes"), controls(nodes, text).alias("fields"), text.alias("text"))
    return F.when(F.size(nodes) > 0, let(bound, build)).otherwise(F.array().cast(f"array<{FORM}>"))


def widget_forms(html: Column, low: Column) -> Column:
    """array<form> of provider-drawn forms: the first marker of each provider in the markup."""
    hits = F.filter(
        F.transform(
            catalogue.literal(WIDGETS, WIDGET_DDL),
            lambda w: F.struct(w["key"].alias("key"), w["name"].alias("name"), w["form_type"].alias("form_type"),
                               _first(F.filter(w["markers"], lambda m: low.contains(m))).alias("marker"))),
        lambda w: w["marker"].isNotNull())

    def build(w):
        at = F.position(w["marker"], low)
        start = F.greatest(F.lit(1), at - 60)
        snippet = X.clean_text(F.substr(html, start, at + F.length(w["marker"]) + 120 - start))
        no = F.lit(False)
        consent = F.struct(no, F.lit(None).cast("boolean"), no, no, no, no, no, no, no,
                           F.array().cast("array<string>"), F.lit(""), F.lit(""), F.lit(0)).cast(CONSENT)
        return F.struct(
            F.concat(F.lit("widget-"), w["key"]), F.lit("widget"), w["form_type"],
            F.array().cast(f"array<{FIELD}>"), F.array(F.lit("phone"), F.lit("name")), F.lit(""),
            w["form_type"] == "newsletter", w["form_type"] == "callback", no, no, no, no, no, F.lit(True),
            F.concat(F.lit("Форма сервиса "), w["name"]), snippet, F.lit(55), consent,
        ).cast(FORM)

    return F.transform(hits, build)
