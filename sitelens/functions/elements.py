"""Labels and predicates on extracted page elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions import text as X
from sitelens.functions import urls as U

# ---- fixed values: field keywords, checked in this order --------------------------
FIELD_KEYWORDS = {
    "passport": ("passport", "snils", "паспорт", "снилс", "серия паспорта", "номер паспорта", "паспортные данные",
                 "документ удостоверяющий"),
    "inn": ("inn", "ogrn", "kpp", "инн", "огрн", "кпп", "реквизиты", "расчетный счет", "бик"),
    "birthdate": ("birth", "birthday", "birthdate", "bday", "dob", "date_of_birth", "дата рождения", "день рождения",
                  "год рождения", "возраст"),
    "medical": ("diagnosis", "symptom", "clinic", "doctor", "appointment", "диагноз", "симптом", "жалоб",
                "заболевание", "болезнь", "здоровье", "к врачу", "запись к врачу", "прием врача", "анализ", "медицин",
                "клиник", "лечен"),
    "children": ("child", "children", "kid", "kids", "son", "daughter", "ребенок", "ребенка", "дети", "детей", "сын",
                 "дочь", "имя ребенка", "возраст ребенка", "школьник", "класс ученика"),
    "email": ("email", "e-mail", "mail", "почта", "эл. почта", "электронная почта", "электронный адрес", "e mail"),
    "phone": ("phone", "tel", "telephone", "mobile", "whatsapp", "телефон", "тел", "номер телефона", "моб", "мобильный",
              "контактный телефон", "номер"),
    "file": ("file", "upload", "attach", "attachment", "resume", "cv", "document", "файл", "загрузить", "прикрепить",
             "вложение", "резюме", "документ", "фото", "скан"),
    "company": ("company", "organization", "org", "firm", "brand", "компания", "организация",
                "название компании", "юридическое лицо", "наименование организации", "должность", "position"),
    "address": ("address", "city", "street", "zip", "postcode", "region", "адрес", "город", "улица", "индекс",
                "регион", "область", "населенный пункт", "дом", "квартира"),
    "name": ("name", "fio", "fname", "lname", "firstname", "lastname", "surname", "имя", "фамилия", "отчество", "фио",
             "ваше имя", "как вас зовут", "контактное лицо", "имя и фамилия"),
    "message": ("message", "comment", "question", "text", "msg", "description", "comments", "feedback", "detail",
                "сообщение", "комментарий", "вопрос", "текст", "опишите", "ваше сообщение", "ваш вопрос", "пожелания",
                "детали"),
}
CHECKBOX_CONSENT = ("согласие", "согласен", "согласна", "принимаю", "ознакомлен", "consent", "agree",
                    "политик", "персональн", "обработк", "рассылк", "оферт")
PERSONAL_CATEGORIES = ("name", "phone", "email", "address", "birthdate", "passport", "file", "message",
                       "medical", "children", "inn")
FIELD_CATEGORIES = tuple(FIELD_KEYWORDS) + ("consent", "other", "unknown")


def classify_field(name: Column, field_type: Column, label: Column, placeholder: Column) -> Column:
    kind = F.lower(X.strip(F.coalesce(field_type, F.lit(""))))
    hay = X.normalize_for_search(F.concat_ws(" ", name, label, placeholder))
    out = (
        F.when(kind == "email", "email")
        .when(kind == "tel", "phone")
        .when(kind == "file", "file")
        .when(kind == "date", F.when(X.has_any(hay, FIELD_KEYWORDS["birthdate"]), "birthdate").otherwise("other"))
        .when(kind.isin("checkbox", "radio"), F.when(X.has_any(hay, CHECKBOX_CONSENT), "consent").otherwise("other"))
    )
    for category, words in FIELD_KEYWORDS.items():
        out = out.when(X.has_any(hay, words), category)
    return out.otherwise("unknown")


# ---- fixed values: document types, checked in this order --------------------------
DOC_KEYWORDS = {
    "cookie_policy": ("cookie", "cookies", "куки", "файлы cookie", "политика cookie", "политика в отношении cookie",
                      "cookie-policy", "cookie_policy", "обработк cookie"),
    "ad_consent": ("рекламн", "рассылк", "маркетингов", "получение рекламы", "рекламная рассылка", "согласие на рекламу",
                   "согласие на рассылку", "информационная рассылка", "e-mail рассылк", "email-рассылк"),
    "consent": ("согласие на обработку", "согласие на обработку персональных", "согласие субъекта", "даю согласие",
                "soglasie", "consent", "согласие на обработку пдн", "форма согласия"),
    "offer": ("оферта", "публичная оферта", "договор оферты", "oferta", "offer", "публичн оферт", "публичная-оферта"),
    "user_agreement": ("пользовательское соглашение", "user agreement", "user-agreement", "условия использования", "terms",
                       "terms of use", "terms of service", "правила пользования", "правила использования",
                       "соглашение об использовании"),
    "privacy_policy": ("политика конфиденциальности", "политика обработки", "политика обработки персональных данных",
                       "конфиденциальность", "персональные данные", "обработка персональных данных",
                       "защита персональных данных", "privacy", "privacy policy", "privacy-policy", "personal data",
                       "personal-data", "politika", "политика в отношении обработки", "обработка пдн",
                       "персональных данных", "политик"),
}
GUESS_PATHS = {
    "/privacy": "privacy_policy", "/privacy-policy": "privacy_policy", "/privacy.html": "privacy_policy",
    "/policy": "privacy_policy", "/personal-data": "privacy_policy",
    "/personal-data-policy": "privacy_policy", "/politika": "privacy_policy",
    "/politika-konfidentsialnosti": "privacy_policy", "/obrabotka-personalnyh-dannyh": "privacy_policy",
    "/consent": "consent", "/soglasie": "consent",
    "/cookie": "cookie_policy", "/cookies": "cookie_policy", "/cookie-policy": "cookie_policy",
    "/oferta": "offer", "/offer": "offer", "/publichnaya-oferta": "offer",
    "/user-agreement": "user_agreement", "/terms": "user_agreement", "/agreement": "user_agreement",
}
ALL_DOC_WORDS = tuple(w for words in DOC_KEYWORDS.values() for w in words)


def link_blob(anchor: Column, url: Column, title: Column) -> Column:
    return X.normalize_for_search(
        F.concat(F.coalesce(anchor, F.lit("")), F.lit(" "), U.url_search_blob(url), F.lit(" "),
                 F.coalesce(title, F.lit("")))
    )


def doc_type_of_blob(norm: Column) -> Column:
    kinds = list(DOC_KEYWORDS.items())
    out = F.when(X.has_any(norm, kinds[0][1]), kinds[0][0])
    for kind, words in kinds[1:]:
        out = out.when(X.has_any(norm, words), kind)
    return out.otherwise("other")


def classify_doc_type(anchor: Column, url: Column, title: Column) -> Column:
    return doc_type_of_blob(link_blob(anchor, url, title))


def looks_like_document(anchor: Column, url: Column, title: Column) -> Column:
    return X.has_any(link_blob(anchor, url, title), ALL_DOC_WORDS)


def text_matches_doc_type(text: Column, doc_type: Column, title: Column) -> Column:
    blob = X.normalize_for_search(
        F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    )
    hit = F.lit(False)
    for kind, words in DOC_KEYWORDS.items():
        hit = hit | ((doc_type == kind) & X.has_any(blob, words))
    return hit


REAL_LINK_SOURCES = ("anchor", "page_link", "sitemap", "header", "footer")


def document_is_present(discovered_by, doc_type, accessible, confirmed, text, title) -> Column:
    """A document counts as published when a real link of the site leads to it and it opened;
    a guessed or suggested one only when its text reads like its type."""
    return F.when(discovered_by.isin(*REAL_LINK_SOURCES), accessible | confirmed).otherwise(
        accessible & text_matches_doc_type(text, doc_type, title)
    )


def link_confirmed(url: Column, final_url: Column, status: Column, ok: Column, same_site: Column) -> Column:
    """Opened with 2xx, and not collapsed to the site root. same_site: the final URL is on the registered
    domain of the first (an empty one is)."""
    final = F.coalesce(final_url, F.lit(""))
    same = (final == "") | same_site
    doc_path = F.trim(U.url_path(url), F.lit("/"))
    final_path = F.trim(U.url_path(final), F.lit("/"))
    return F.coalesce(
        ok & status.between(200, 299) & same & ~((doc_path != "") & (final_path == "")), F.lit(False)
    )


# ---- cookie banner (fixed values) -------------------------------------------------
COOKIE_MENTION = ("cookie", "куки", "cookies")
ACCEPT_WORDS = ("принять", "принимаю", "согласен", "согласна", "соглашаюсь", "accept", "agree", "ок",
                "okay", "хорошо", "понятно", "разрешить", "allow")
CONTINUE_PHRASES = ("используя сайт", "используя данный сайт", "используя этот сайт",
                    "продолжая пользоваться", "продолжая использовать", "оставаясь на сайте",
                    "продолжая просмотр")
BANNER_HINTS = ("cookie", "consent", "cookiebanner", "cookie-banner", "cookie-consent", "cookie-notice", "cookie-policy", "gdpr")
_HINT = f"(?:{'|'.join(BANNER_HINTS)})"
BANNER_CONTAINER = rf"(?:class|id){X.WS}*={X.WS}*(?:\"[^\"]*{_HINT}|'[^']*{_HINT}|[^\s>\"']*{_HINT})"


def cookie_banner(html: Column, text: Column) -> Column:
    """Struct(found, evidence): cookies are mentioned and either an accept word, a "by using the
    site" phrase or a banner-like container is there."""
    low_text, low_html = F.lower(text), F.lower(html)
    mention = X.mentions(low_text, COOKIE_MENTION) | X.mentions(low_html, COOKIE_MENTION)
    words = ACCEPT_WORDS + CONTINUE_PHRASES
    found = mention & (
        X.mentions(low_text, words) | X.mentions(low_html, words) | low_html.rlike(BANNER_CONTAINER)
    )
    source = X.clean_text(F.when(X.mentions(low_text, COOKIE_MENTION), text).otherwise(html))

    def window(src):
        def cut(at):
            start = F.greatest(F.lit(1), at - 120)
            return X.truncate(F.substr(src, start, at + 180 - start), 300)

        return X.let(X.normalize_for_search(src), lambda n: X.let(
            F.when(n.contains("cookie"), F.instr(n, "cookie")).otherwise(F.instr(n, "куки")), cut))

    return F.struct(
        F.coalesce(found, F.lit(False)).alias("found"),
        # bound inside the branch: only pages with a banner are cleaned
        F.when(found, X.let(source, window)).otherwise("").alias("evidence"),
    )


# ---- element text labels (fixed values) -------------------------------------------
MODAL_TRIGGERS = (
    "оставить заявку", "записаться", "записаться на приём", "заказать звонок", "обратный звонок",
    "получить консультацию", "бесплатная консультация", "задать вопрос", "обратная связь", "связаться",
    "связаться с нами", "перезвоните мне", "жду звонка", "написать", "рассчитать", "рассчитать стоимость",
    "получить расчёт", "заказать замер", "вызвать замерщика", "получить предложение", "получить прайс",
    "отправить заявку", "подписаться", "callback", "заявка", "консультация", "звонок", "заказать", "прайс",
    "предложение", "запись",
)
UNSAFE_CLICKS = ("оплатить", "оплата", "купить", "заказать и оплатить", "оформить заказ",
                 "оформить покупку", "в корзину", "добавить в корзину", "checkout", "buy", "pay")


def is_unsafe_click(text: Column) -> Column:
    return X.contains_any(text, UNSAFE_CLICKS)


def is_modal_trigger(text: Column) -> Column:
    return ~is_unsafe_click(text) & X.contains_any(text, MODAL_TRIGGERS)


def looks_like_form_html(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    return low.contains("<input") | low.contains("<textarea") | low.contains("<select")


def is_https(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).startswith("https:")


HOME_COUNTRIES = ("", "unknown", "ru", "russia", "russian federation", "российская федерация", "россия")


def country_is_foreign(country: Column) -> Column:
    return ~F.translate(F.lower(X.strip(F.coalesce(country, F.lit("")))), "ё", "е").isin(*HOME_COUNTRIES)
