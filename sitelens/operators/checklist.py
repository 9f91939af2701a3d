"""Document checklists, conflicts and document summaries.

A document row meets its items inside the row: the items of its type are one constant of
the plan, so the text is neither copied per item nor shuffled again.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens import catalogue
from sitelens.functions import text as X
from sitelens.operators.domains import on_site, with_domain
from sitelens.sources.staging import staged, work_dir

# ---- fixed values -----------------------------------------------------------------
APPLIES = ("has_pd_forms", "has_forms", "trackers_present", "foreign_trackers_present", "cookies_present",
           "newsletter_form", "file_upload", "medical", "children", "hr", "ecommerce", "finance", "publishes_people")
CATEGORY_WORDS = {
    "name": ("фамили", "имя", "фио", "отчеств"), "phone": ("телефон", "номер телефона", "контактн"),
    "email": ("email", "e-mail", "электронн", "адрес электронной"), "address": ("адрес", "место жительства", "почтов"),
    "birthdate": ("дата рождения", "возраст"),
    "message": ("сообщени", "текст обращени", "комментар", "иные данные", "иные сведения"),
    "file": ("файл", "документ", "вложени", "резюме"), "passport": ("паспорт", "документ, удостоверяющ"),
    "inn": ("инн",), "company": ("наименование организаци", "компани", "организац"),
    "medical": ("состояни здоровья", "здоровь", "медицинск", "специальны категори"),
    "children": ("несовершеннолетн", "ребен", "дет", "родител"),
}
THIRD_PARTY_WORDS = ("третьи лиц", "обработчик", "по поручению", "хостинг", "crm", "аналитик", "платёжн", "платежн", "доставк")
BORDER_WORDS = ("трансгранич", "за пределы российской федерации", "иностранн", "иностранное государство")
DATE_WORDS = ("утвержд", "дата", "версия", "редакция", "от 20")
PUBLIC_MAIL = ("gmail.com", "googlemail.com", "yandex.ru", "ya.ru", "mail.ru", "bk.ru", "inbox.ru", "list.ru",
               "rambler.ru", "outlook.com", "hotmail.com", "icloud.com", "yahoo.com", "proton.me", "protonmail.com")
TRACKING_WORDS = ("cookie", "куки", "метрик", "аналитик", "статистик", "ip-адрес", "идентификатор")
DENIAL = r"трансгранич[а-яё]*[^.\n]{0,80}?не\s+осуществля"
STATUS_RANK = {"found": 3, "unclear": 2, "not_found": 1, "not_applicable": 0}
VERDICT_RANK = {"found": 3, "not_found": 2, "unclear": 1, "not_applicable": 0}

RESULT = ("struct<item_pos: int, item_id: string, label: string, status: string, evidence_quote: string, "
          "comment: string, risk_if_missing: string, confidence: int, source: string>")
CONTEXT = APPLIES + ("pd_categories", "providers", "registered_domain", "below", "n_pd_forms", "n_pd_linked", "pd_link",
                     "form_merged", "form_prechecked", "form_button_only", "cookie_banner_found",
                     "marketing_before_consent")


def _rank_map(ranks) -> Column:
    return F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])


def _res(status, comment, confidence=0, quote="") -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(lit(status).alias("status"), lit(quote).alias("quote"), lit(comment).alias("comment"),
                    lit(confidence).cast("int").alias("confidence"))


def foreign_emails(text: Column, domain: Column, below: Column) -> Column:
    """Addresses on a domain that is neither the site's nor a public mail service, in order."""
    def foreign(e):
        host = F.lower(F.substring_index(e, "@", -1))
        return (host != "") & ~F.substring_index(host, ".", -2).isin(*PUBLIC_MAIL) & ~on_site(host, domain, below)

    return F.when(domain != "", F.filter(X.find_emails(text), foreign)).otherwise(F.array().cast("array<string>"))


def with_facts(docs: DataFrame, ctx: DataFrame) -> DataFrame:
    """Document rows with site flags and the text facts that several handlers share."""
    df = docs.join(ctx.select("site_id", *CONTEXT), "site_id")
    norm = X.normalize_for_search(F.col("text"))
    df = df.withColumn("norm", norm)
    n = F.col("norm")
    words = catalogue.literal([{"c": k, "w": list(v)} for k, v in CATEGORY_WORDS.items()], "c string, w array<string>")

    def is_covered(cat):
        own = F.try_element_at(F.filter(words, lambda w: w["c"] == cat), F.lit(1))["w"]
        return F.exists(F.coalesce(own, F.array(cat)), lambda k: n.contains(k))

    # a number of an organisation has ten digits or more: most texts hold none
    df = df.withColumn("_numbers", F.when(F.col("text").rlike(r"\p{Nd}{10}"), F.col("text")))
    df = df.withColumns({
        "inns": X.find_inn(F.col("_numbers")), "ogrns": X.find_ogrn(F.col("_numbers")),
        "blanks": X.find_placeholders(F.col("text")),
        "foreign_mail": foreign_emails(F.col("text"), F.col("registered_domain"), F.col("below")),
        "covered": F.filter("pd_categories", is_covered),
        "named": F.filter("providers", lambda p: n.contains(X.normalize_for_search(p))),
    })
    return df.drop("_numbers").withColumns({
        "uncovered": F.array_except("pd_categories", "covered"), "unnamed": F.array_except("providers", "named")})


#: keywords of the handlers that search, for items without their own
DEFAULT_WORDS = {"third_parties": THIRD_PARTY_WORDS, "cross_border": BORDER_WORDS, "doc_date": DATE_WORDS}


def _first_found(kws: Column) -> Column:
    return F.try_element_at(F.filter(kws, lambda k: F.array_contains(F.col("_found"), k)), F.lit(1))


def _found(lists) -> Column:
    """Keywords of the document's type that its text contains: each is searched once for all items."""
    out = F.array().cast("array<string>")
    for kind, items in lists.items():
        words = dict.fromkeys(k for i in items for k in i["norm_keywords"] or DEFAULT_WORDS.get(i["special"], ()))
        out = F.when(F.col("doc_type") == kind, X.found_words(F.col("norm"), list(words))).otherwise(out)
    return out


def _handlers(item: Column) -> dict[str, Column]:
    """Verdict per handler name. ``item`` supplies the keywords of the handlers that search."""
    c = F.col
    text, n = c("text"), c("norm")
    empty = text == ""

    def search(default=()):
        kws = item["norm_keywords"] if not default else F.when(
            F.size(item["norm_keywords"]) > 0, item["norm_keywords"]).otherwise(F.array(*map(F.lit, default)))
        return _first_found(kws)

    def quoted(kw, radius):
        return X.snippet_around(text, kw, radius, n)

    def joined(arr, k=5):
        return F.array_join(F.slice(arr, 1, k), ", ")

    na = lambda why: _res("not_applicable", why)
    no_cookies = na("Cookies не замечены.")
    third, border, dated = map(search, DEFAULT_WORDS.values())
    numbers = F.concat_ws("; ", F.when(F.size("inns") > 0, F.concat(F.lit("ИНН: "), joined(c("inns"), 3))),
                          F.when(F.size("ogrns") > 0, F.concat(F.lit("ОГРН/ОГРНИП: "), joined(c("ogrns"), 3))))
    stamp = F.concat_ws("; ", F.when(c("date_detected") != "", F.concat(F.lit("дата: "), c("date_detected"))),
                        F.when(c("version_detected") != "", F.concat(F.lit("версия: "), c("version_detected"))))
    mixed = X.has_any(n, ("настоящая оферта", "публичная оферта", "пользовательское соглашение")) & X.has_any(
        n, ("согласие на обработку", "даю согласие"))
    blanks = F.when(F.size("blanks") > 0, joined(c("blanks"))).when(c("placeholder"), F.lit("пустое место"))
    when = F.when
    return {
        "doc_accessible": when(c("is_accessible") & ~empty, _res("found", "Документ читается.", 80, X.squeeze(text, 300)))
        .otherwise(_res("not_found", "Документ не читается.", 60)),
        "policy_near_forms": when(c("n_pd_forms") == 0, na("Форм с данными нет."))
        .when(c("n_pd_linked") > 0, _res("found", "Ссылка у формы есть.", 70))
        .otherwise(_res("not_found", "Ссылки у формы нет.", 60)),
        "inn_ogrn": when(numbers != "", _res("found", "Реквизиты есть.", 80, numbers))
        .otherwise(_res("not_found", "Реквизитов нет.", 60)),
        "policy_matches_forms": when(F.size("pd_categories") == 0, na("Форм с данными нет."))
        .when(empty, _res("not_found", "Нет текста для сверки.", 40))
        .when(F.size("uncovered") == 0, _res("found", "Все поля названы.", 65,
                                             F.concat(F.lit("Названы: "), F.array_join("covered", ", "))))
        .when(F.size("covered") > 0, _res("unclear", F.concat(F.lit("Не названы: "), F.array_join("uncovered", ", ")), 45))
        .otherwise(_res("not_found", F.concat(F.lit("Не названы: "), F.array_join("uncovered", ", ")), 50)),
        "third_parties": when(third.isNotNull(), _res("found", "Третьи лица названы.", 65, quoted(third, 180)))
        .otherwise(_res("not_found", when(c("trackers_present"), "Сервисы есть, третьи лица не названы.")
                        .otherwise("Третьи лица не названы."), 55)),
        "cross_border": when(border.isNotNull(), _res("found", "О передаче за границу сказано.", 65, quoted(border, 180)))
        .when(c("foreign_trackers_present"), _res("not_found", "Зарубежные сервисы есть, о передаче не сказано.", 55))
        .otherwise(_res("unclear", "Зарубежных сервисов не видно.", 40)),
        "cookie_providers": when(F.size("providers") == 0, na("Сервисов нет."))
        .when(empty, _res("not_found", "Нет текста для сверки.", 40))
        .when(F.size("unnamed") == 0, _res("found", "Сервисы названы.", 65,
                                           F.concat(F.lit("Названы: "), joined(c("named")))))
        .when(F.size("named") > 0, _res("unclear", F.concat(F.lit("Не названы: "), joined(c("unnamed"))), 45))
        .otherwise(_res("not_found", F.concat(F.lit("Не названы: "), joined(c("unnamed"))), 55)),
        "placeholders": when(blanks.isNull(), _res("found", "Пустых мест нет.", 70))
        .otherwise(_res("not_found", F.concat(F.lit("Пустые места: "), blanks), 65, blanks)),
        "company_conflict": when(F.size("foreign_mail") == 0, _res("found", "Расхождения не видно.", 55))
        .otherwise(_res("not_found", F.concat(F.lit("Чужой адрес: "), F.get("foreign_mail", F.lit(0))), 45,
                        F.get("foreign_mail", F.lit(0)))),
        "doc_date": when(stamp != "", _res("found", "Дата или версия есть.", 75, stamp))
        .when(dated.isNotNull(), _res("found", "Дата или версия упомянута.", 55, quoted(dated, 120)))
        .otherwise(_res("not_found", "Даты и версии нет.", 55)),
        "consent_separate": when(c("form_merged"), _res("not_found", "Согласие слито с договором.", 55))
        .when(mixed, _res("unclear", "В тексте и согласие, и договор.", 45))
        .otherwise(_res("found", "Согласие отдельно.", 55)),
        "consent_prechecked": when(c("form_prechecked"), _res("not_found", "Флажок стоит заранее.", 65))
        .otherwise(_res("found", "Флажков, стоящих заранее, нет.", 60)),
        "consent_link_clickable": when(c("n_pd_forms") == 0, na("Форм с данными нет."))
        .when(c("pd_link"), _res("found", "Ссылка у формы есть.", 55)).otherwise(_res("not_found", "Ссылки у формы нет.", 55)),
        "button_acceptance": when(c("form_button_only"), _res("not_found", "Согласие только кнопкой.", 60))
        .otherwise(_res("found", "Подмены кнопкой не видно.", 55)),
        "newsletter_present": when(c("newsletter_form"), _res("found", "Подписка есть.", 70)).otherwise(na("Подписки нет.")),
        "cookie_banner": when(~c("cookies_present"), no_cookies)
        .when(c("cookie_banner_found"), _res("found", "Баннер есть.", 70)).otherwise(_res("not_found", "Баннера нет.", 60)),
        "cookie_banner_notice": when(~c("cookies_present"), no_cookies)
        .when(c("cookie_banner_found"), _res("found", "Баннер говорит о cookies.", 55))
        .otherwise(_res("not_found", "Уведомления нет.", 55)),
        "cookie_banner_action": when(~c("cookies_present"), no_cookies).otherwise(_res("unclear", "Кнопку проверит человек.", 40)),
        "cookie_banner_link": when(~c("cookies_present"), no_cookies).otherwise(_res("unclear", "Ссылку проверит человек.", 40)),
        "cookies_before_consent": when(~c("cookies_present"), no_cookies)
        .when(c("marketing_before_consent"), _res("not_found", "Слежение до согласия.", 65))
        .otherwise(_res("found", "Слежения до согласия не видно.", 55)),
        "cookie_banner_conflict": _res("unclear", "Баннер сверит человек.", 40),
        "needs_manual": _res("unclear", "Проверит юрист.", 30),
    }


def run_checklist(facts: DataFrame, path=None) -> DataFrame:
    """One row per document and item of its type."""
    lists = catalogue.checklists(path)
    items = F.from_json(F.lit(json.dumps(lists, ensure_ascii=False)),
                        f"map<string, array<struct<{catalogue.typed(catalogue.ITEM_DDL)}>>>")

    def verdict(item):
        applies = F.lit(True)
        for flag in APPLIES:
            applies = applies & ((item["applies_when"] != flag) | F.col(flag))
        kw = _first_found(item["norm_keywords"])
        generic = F.when((F.col("text") != "") & kw.isNotNull(), _res(
            "found", "Формулировка есть.", 70, X.snippet_around(F.col("text"), kw, 180, F.col("norm")))).otherwise(
            _res("not_found", "Формулировки нет.", 55))
        out = F.when(~applies, _res("not_applicable", "К этому сайту не относится.")).when(item["special"] == "", generic)
        handlers = _handlers(item)
        for name, column in handlers.items():
            out = out.when(item["special"] == name, column)
        return out.otherwise(handlers["needs_manual"])

    def result(item):
        pair = F.element_at(F.transform(F.array(verdict(item)), lambda v: F.struct(
            item["item_pos"], item["item_id"], item["label"], v["status"], X.truncate(v["quote"], 500), v["comment"],
            item["risk_if_missing"], v["confidence"], F.lit("heuristic"))), 1)
        return pair.cast(RESULT)

    return facts.withColumn("_found", _found(lists)).select(
        "site_id", "doc_pos", "doc_type", "url", F.explode(F.transform(F.try_element_at(items, F.col("doc_type")), result)).alias("r")
    ).select("site_id", "doc_pos", "doc_type", "url", "r.*")


def detect_conflicts(facts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Contradictions between a document and the facts of its site."""
    c, n = F.col, F.col("norm")
    mail_host = F.lower(F.substring_index(F.get("foreign_mail", F.lit(0)), "@", -1))

    def conflict(cond, kind, risk, fact, statement, comment):
        def lit(x):
            return x if isinstance(x, Column) else F.lit(x)

        return F.when(cond, F.struct(
            F.lit(kind).alias("type"), lit(fact).alias("detected_fact"), lit(statement).alias("document_statement"),
            F.lit(risk).alias("risk"), F.lit(comment).alias("comment"), F.lit("heuristic").alias("source")))

    denies = n.contains("трансгранич") & (n.rlike(DENIAL) | X.has_any(
        n, ("не осуществляется", "не осуществляем", "не производится")))
    topical = c("doc_type").isin("privacy_policy", "cookie_policy", "consent", "user_agreement", "other")
    found = F.array(
        conflict(topical & c("trackers_present") & (F.size("providers") > 0) & (F.size("named") == 0)
                 & ~X.has_any(n, TRACKING_WORDS), "tracker_not_disclosed", "high",
                 F.concat(F.lit("Сервисы сайта: "), F.array_join(F.slice("providers", 1, 5), ", ")),
                 "О сервисах не сказано.", "Сервисы не раскрыты."),
        conflict(c("foreign_trackers_present") & denies, "cross_border_denied", "high", "Есть зарубежные сервисы.",
                 "Передача за границу отрицается.", "Отрицание расходится с сервисами."),
        conflict(c("cookies_present") & ~X.has_any(n, ("cookie", "куки")), "cookies_not_disclosed", "medium",
                 "Есть cookies.", "О cookies не сказано.", "Cookies не раскрыты."),
        conflict(F.size("foreign_mail") > 0, "company_conflict", "medium",
                 F.concat(F.lit("Домен сайта: "), c("registered_domain")), F.concat(F.lit("Домен адреса: "), mail_host),
                 "Адрес на другом домене, уточнить юрлицо."),
    )
    rows = facts.where("text <> ''").select(
        "site_id", "doc_pos", "doc_type", "url", mail_host.alias("_mail"), F.posexplode(F.filter(found, lambda x: x.isNotNull())).alias("pos", "k")
    ).select("site_id", "doc_pos", "doc_type", "url", "pos", "k.*", F.when(F.col("k.type") == "company_conflict", F.col("_mail")).alias("_mail"))
    # the domains are joined to the rows that they come from: written, so that texts are searched once
    rows = staged(rows, work_dir(facts.sparkSession), "conflicts")
    named = with_domain(rows, F.col("_mail"), "_domain", suffixes)
    shown = F.when(F.col("_mail").isNotNull(), F.concat(F.lit("Домен адреса: "), "_domain")).otherwise(F.col("document_statement"))
    return named.withColumn("document_statement", shown).drop("_mail", "_domain")


# ---- verdicts of an outside reviewer --------------------------------------------------
def read_verdicts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site_id, doc_pos, doc_type, url, answer) in loose JSON to item verdicts and conflicts."""
    item = "struct<id: string, status: string, evidence_quote: string, comment: string, confidence: int>"
    conf = "struct<type: string, detected_fact: string, document_statement: string, risk: string, comment: string>"
    a = answers.withColumn("a", F.from_json(
        X.lenient_json(F.col("answer")), f"struct<checklist_results: array<{item}>, conflicts: array<{conf}>>"))
    items = a.select("site_id", "doc_pos", F.posexplode("a.checklist_results").alias("pos", "v")).where(
        "v.id <> ''").groupBy("site_id", "doc_pos", F.col("v.id").alias("item_id")).agg(F.max_by("v", "pos").alias("v"))
    key = ["site_id", "doc_pos", "doc_type", "url"]
    conflicts = a.select(*key, F.posexplode("a.conflicts").alias("pos", "k")).where("k.type <> ''").select(
        *key, (F.col("pos") + 100).alias("pos"), "k.*")
    return items, conflicts


def merge_verdicts(items: DataFrame, verdicts: DataFrame, docs: DataFrame) -> DataFrame:
    """A verdict replaces the heuristic result only with a valid status, a quote that the document
    really contains, and more information than before."""
    quotes = verdicts.select("site_id", "doc_pos", "item_id", "v").join(
        docs.select("site_id", "doc_pos", "text"), ["site_id", "doc_pos"])
    q = X.truncate(F.col("v.evidence_quote"), 500)  # for display only; the search is for the whole quote
    nq = X.normalize_for_search(F.coalesce("v.evidence_quote", F.lit("")))
    status = X.strip(F.coalesce("v.status", F.lit("")))
    grounded = (F.col("text") == "") | ((F.length(nq) >= 8) & X.normalize_for_search(F.col("text")).contains(nq))
    usable = status.isin(*VERDICT_RANK) & (~status.isin("found", "unclear") | ((q != "") & grounded))
    good = quotes.where(usable).select("site_id", "doc_pos", "item_id", F.struct(
        status.alias("status"), q.alias("quote"), F.coalesce("v.comment", F.lit("")).alias("comment"),
        F.coalesce("v.confidence", F.lit(0)).alias("confidence")).alias("n"))
    df = items.join(good, ["site_id", "doc_pos", "item_id"], "left")
    ranks = _rank_map(VERDICT_RANK)
    old, new = ranks[F.col("status")], F.try_element_at(ranks, F.col("n.status"))
    adds_quote = (F.col("n.quote") != "") & (F.col("evidence_quote") == "")
    take = F.coalesce((F.col("status") != "not_applicable") & ((new > old) | ((new == old) & adds_quote)), F.lit(False))

    def pick(a, b):
        return F.when(take, a).otherwise(F.col(b))

    def filled(a, b):
        return F.when(F.col(a) != "", F.col(a)).otherwise(F.col(b))

    return df.withColumns({
        "status": pick(F.col("n.status"), "status"), "evidence_quote": pick(filled("n.quote", "evidence_quote"), "evidence_quote"),
        "comment": pick(filled("n.comment", "comment"), "comment"),
        "confidence": pick(F.greatest("confidence", "n.confidence"), "confidence"),
        "source": F.when(take, "merged").otherwise(F.col("source")),
    }).drop("n")


def merge_conflicts(det: DataFrame, ext: DataFrame) -> DataFrame:
    """Outside conflicts join the found ones; claims about company or domain need a found one on the
    same document, an unknown risk reads as medium."""
    claim = F.lower("type").rlike("company|domain")
    risk = F.lower(F.coalesce("risk", F.lit("medium")))
    e = ext.withColumn("risk", F.when(risk.isin("low", "medium", "high", "critical"), risk).otherwise("medium")).withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("detected_fact", "document_statement", "comment")}
    ).withColumn("source", F.lit("llm"))
    backed = det.where(claim).select("site_id", "doc_pos").distinct()
    kept = e.where(claim).join(backed, ["site_id", "doc_pos"], "left_semi").unionByName(e.where(~claim))
    return det.unionByName(kept, allowMissingColumns=True)


# ---- rollups --------------------------------------------------------------------------
def best_status(results: DataFrame) -> DataFrame:
    """Best result per site and item: found > unclear > not_found > not_applicable, the earliest on ties."""
    rank = _rank_map(STATUS_RANK)[F.col("status")]
    return results.groupBy("site_id", "item_id").agg(
        F.max_by(F.struct("status", F.col("evidence_quote").alias("quote"), "comment"),
                 F.struct(rank.alias("r"), (-F.col("doc_pos")).alias("p"), (-F.col("item_pos")).alias("i"))).alias("best"))


def status_map(results: DataFrame) -> DataFrame:
    """site_id to a map item -> (status, quote, comment): at most one entry per catalogue item."""
    return best_status(results).groupBy("site_id").agg(
        F.map_from_entries(F.collect_list(F.struct("item_id", "best"))).alias("items"))


def doc_analysis(docs: DataFrame, results: DataFrame, conflicts: DataFrame, verdict_docs: DataFrame | None = None) -> DataFrame:
    """Completeness, manual flag and one-line summary per document."""
    high = F.col("risk_if_missing").isin("high", "critical")
    na = F.col("status") == "not_applicable"
    open_ = ~na & (F.col("status") != "found") & high
    per_doc = results.groupBy("site_id", "doc_pos").agg(
        F.bround(F.lit(100) * F.count_if(F.col("status") == "found") / F.greatest(F.lit(1), F.count_if(~na))).cast("int").alias("overall_completeness"),
        F.bool_or(open_).alias("open_high"),
        F.transform(F.array_sort(F.collect_list(F.when(open_, F.struct("item_pos", "label")))), lambda x: x["label"]).alias("missing_high"))
    n_conf = conflicts.groupBy("site_id", "doc_pos").agg(F.count("*").alias("n_conflicts"))
    df = docs.select("site_id", "doc_pos", "doc_type", "url", "text_extraction_failed").join(
        per_doc, ["site_id", "doc_pos"], "left").join(n_conf, ["site_id", "doc_pos"], "left")
    reviewed = F.lit(False)
    if verdict_docs is not None:
        df = df.join(verdict_docs.select("site_id", "doc_pos").distinct().withColumn("rv", F.lit(True)), ["site_id", "doc_pos"], "left")
        reviewed = F.coalesce("rv", F.lit(False))
    done = F.coalesce("overall_completeness", F.lit(0))
    missing = F.coalesce("missing_high", F.array().cast("array<string>"))
    k = F.coalesce("n_conflicts", F.lit(0))
    summary = F.concat_ws(
        " ", F.concat(X.label("doc_type", F.col("doc_type")), F.lit(": раскрыто "), done.cast("string"), F.lit("%.")),
        F.when(F.col("text_extraction_failed"), "Текст извлечь не удалось."),
        F.when(F.size(missing) > 0, F.concat(F.lit("Не подтверждено: "), F.array_join(F.slice(missing, 1, 3), "; "), F.lit(".")))
        .otherwise("Важные пункты подтверждены."),
        F.when(k > 0, F.concat(F.lit("Расхождений с сайтом: "), k.cast("string"), F.lit("."))),
        F.lit("Вывод предварительный."))
    return df.select(
        "site_id", "doc_pos", "doc_type", "url", done.alias("overall_completeness"), F.slice(missing, 1, 3).alias("missing_high"),
        k.alias("n_conflicts"), X.sanitize_tone(summary, repair=False).alias("summary"),
        (F.coalesce("open_high", F.lit(False)) | F.col("text_extraction_failed") | ~reviewed).alias("requires_manual_review"))
