"""Text, date and number column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str methods see it. An explicit class is much cheaper to match than
# the Unicode-aware \\s, and only runs that need a change are replaced.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WS_NOT_SPACE = r"[\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Printable ASCII, Latin and Cyrillic letters fail after two comparisons instead of a walk through the class.
_RUN = rf"(?: (?![!-~\xa1-\u167f]){WS}+|(?![ -~\xa1-\u167f]){_WS_NOT_SPACE}{WS}*)"
_WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a lambda would otherwise evaluate a captured
    expression again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def _collapse(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), _RUN, " ")


def clean_text(c: Column) -> Column:
    return strip(_collapse(F.coalesce(c, F.lit(""))))


def _cut(c: Column, n: int) -> Column:
    tail = F.rtrim(F.substring(c, 1, n - 1), F.lit(_WS_CHARS))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(tail, F.lit("…")))


def truncate(c: Column, n: int = 500) -> Column:
    return let(strip(F.coalesce(c, F.lit(""))), lambda s: _cut(s, n))


def squeeze(c: Column, n: int) -> Column:
    """Whitespace collapsed, then truncated. Where the head of a long text is enough, the rest is not collapsed."""
    return let(clean_text(F.substring(c, 1, 4 * n)), lambda head: F.when(F.length(head) > n, _cut(head, n)).otherwise(
        let(clean_text(c), lambda whole: _cut(whole, n))))


def normalize_for_search(c: Column) -> Column:
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))
    return _collapse(low)


def norm_keyword(k: str) -> str:
    """Driver-side twin of ``normalize_for_search`` for keyword literals."""
    return re.sub(r"\s+", " ", k.lower().replace("ё", "е"))


def minimal(keywords) -> list[str]:
    """Normalised keywords without those that another keyword already covers."""
    norm = list(dict.fromkeys(norm_keyword(k) for k in keywords))
    return [k for k in norm if not any(o != k and o in k for o in norm)]


FEW = 4


def _either(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def one_pass(words: list[list[str]]) -> str:
    """A pattern that matches any of the words (lists of pattern units, such as escaped characters), the
    longest at a position. Common beginnings are shared, and a look at the first character lets most
    positions fail at once: the time for a text hardly grows with the number of words."""
    root: dict = {}
    for word in words:
        node = root
        for unit in word:
            node = node.setdefault(unit, {})
        node[""] = {}

    def emit(node):
        branches = [unit + emit(below) for unit, below in node.items() if unit]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + ("?" if "" in node else "")

    first = [u[1:-1] if u.startswith("[") else u for u in root]
    return ("" if any(u.startswith(WS) for u in root) else f"(?=[{''.join(first)}])") + emit(root)


def _units(word: str) -> list[str]:
    return [re.escape(ch) for ch in word]


def has_any(norm: Column, keywords) -> Column:
    """Substring test on an already normalised column: plain searches for a few words, one
    pattern for many."""
    words = minimal(keywords)
    if not words:
        return F.lit(False)
    if len(words) <= FEW:
        return _either(norm.contains(w) for w in words)
    return norm.rlike(one_pass(list(map(_units, words))))


def mentions(low: Column, keywords) -> Column:
    """The same test on a lower-cased but not normalised column: the pattern absorbs ё and runs of
    whitespace, so a long text is scanned once and not rewritten."""
    words = minimal(keywords)
    if "" in words or not words:
        return F.lit("" in words)
    if len(words) <= FEW and not any(ch in w for w in words for ch in " е"):
        return _either(low.contains(w) for w in words)
    return low.rlike(one_pass([[WS + "+" if ch == " " else "[её]" if ch == "е" else re.escape(ch) for ch in w] for w in words]))


def contains_any(c: Column, keywords) -> Column:
    return mentions(F.lower(F.coalesce(c, F.lit(""))), keywords)


def find_all_matches(c: Column, keywords) -> Column:
    """Literal keywords contained in the text, in their order. One pass collects the longest keyword at
    each position; every keyword that occurs begins one of these."""
    known = [(k, norm_keyword(k)) for k in keywords if norm_keyword(k)]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in known])
    if len(known) <= FEW:
        return let(normalize_for_search(c), lambda norm: F.transform(F.filter(pairs, lambda p: norm.contains(p["n"])), lambda p: p["k"]))
    pattern = F.lit(f"(?=({one_pass([_units(n) for _, n in known])}))")
    return let(F.array_distinct(F.regexp_extract_all(normalize_for_search(c), pattern, F.lit(1))), lambda found: F.transform(
        F.filter(pairs, lambda p: F.exists(found, lambda f: f.startswith(p["n"]))), lambda p: p["k"]))


_ASCII = r"[\x00-\x7f]"


def found_words(norm: Column, words) -> Column:
    """Normalised words contained in a normalised text, for many words and long texts. Words with other
    than ASCII letters are looked for in the text without the inside of ASCII runs that are longer than
    any in these words, the others in the whole text."""
    plain, mixed = [[w for w in words if w.isascii() == a] for a in (True, False)]
    runs = max([len(r) for w in mixed for r in re.findall(_ASCII + "+", w)], default=0)
    keep = max(runs, 1)
    short = F.regexp_replace(norm, f"({_ASCII}{{{keep}}}){_ASCII}+({_ASCII}{{{keep}}})", "$1$2")

    def held(text, some):
        return F.filter(F.array(*map(F.lit, some)), lambda w: text.contains(w)) if some else F.array().cast("array<string>")

    return F.concat(held(norm, plain), let(short, lambda s: held(s, mixed)))


def find_first(c: Column, keywords) -> Column:
    return F.try_element_at(find_all_matches(c, keywords), F.lit(1))


# ---- patterns (fixed values) -------------------------------------------------------
# A leading look-ahead on the first character lets most positions fail before a Unicode word
# boundary or a case-blind letter is tried.
RE_OGRNIP = r"(?=\p{Nd})(?U)\b\d{15}\b"
RE_OGRN = r"(?=\p{Nd})(?U)\b\d{13}\b"
RE_INN = r"(?=\p{Nd})(?U)(?:\b\d{12}\b|\b\d{10}\b)"
RE_INN_LABELED = r"(?=[Ии])(?iU)ИНН[\s:№]*?(\d{10}|\d{12})"
RE_OGRN_LABELED = r"(?=[Оо])(?iU)ОГРН(?:ИП)?[\s:№]*?(\d{13}|\d{15})"
RE_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
RE_PHONE = r"(?U)(?:\+7|8|7)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
RE_DATE = (
    r"(?=\p{Nd})(?iU)(?:\b\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}\b"
    r"|\b\d{1,2}\s+(?:январ|феврал|март|апрел|ма[йя]|июн|июл|август|сентябр|октябр|ноябр|декабр)\w*\s+\d{4}"
    r"|\b\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}\b)"
)
RE_VERSION = r"(?=[VvА-я])(?=[Vv][Ee]|[ВвРр][Ее])(?iU)(?:верси[яи]|version|редакци[яи]|ред\.)\s*[:№]?\s*([0-9]+(?:\.[0-9]+)*)"
RE_PLACEHOLDER = r"(?=[\[{_«А-я])(?=[\[{_«РрНнАаУуВвПп])(?iU)(?:" + "|".join(
    [
        r"\[[^\]]{0,40}\]",
        r"\{\{[^}]{0,40}\}\}",
        r"_{3,}",
        r"«?\bромашк\w*\b»?",
        r"наименовани\w*\s+оператора",
        r"адрес\w*\s+оператора",
        r"указать",
        r"вставить",
        r"ваш[аеиуый]*\s+компани[яи]",
        r"пример\w*\s+ооо",
    ]
) + ")"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group)))


def _at_words(c: Column) -> Column:
    """The words around each @; an address holds no space."""
    def ends(p):
        return F.when(p.contains(" "), F.concat(F.substring_index(p, " ", 1), F.lit(" "), F.substring_index(p, " ", -1))).otherwise(p)

    return F.when(c.contains("@"), F.array_join(F.transform(F.split(c, "@"), ends), "@")).otherwise("")


def find_inn(c: Column) -> Column:
    labelled = _all(c, RE_INN_LABELED, 1)
    return F.when(F.size(labelled) > 0, labelled).otherwise(_all(c, RE_INN))


def find_ogrn(c: Column) -> Column:
    labelled = _all(c, RE_OGRN_LABELED, 1)
    bare = F.array_distinct(F.concat(_all(c, RE_OGRNIP), _all(c, RE_OGRN)))
    return F.when(F.size(labelled) > 0, labelled).otherwise(bare)


def find_emails(c: Column) -> Column:
    return let(_at_words(c), lambda words: _all(words, RE_EMAIL))


def find_phones(c: Column) -> Column:
    return _all(c, RE_PHONE)


def find_placeholders(c: Column) -> Column:
    return F.array_distinct(F.transform(_all(c, RE_PLACEHOLDER), strip))


def find_dates(c: Column) -> Column:
    return _all(c, RE_DATE)


def detect_date(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), RE_DATE, 0)


def detect_version(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), RE_VERSION, 1)


_FORMS = "ООО|АО|ПАО|ОАО|ЗАО|НАО|ИП"
_RE_OPERATOR_PHRASE = r"(?=[Оо])(?iU)оператор(?:ом)?[^.\n]{0,60}?(?:является|:)\s*([^.\n]{2,120})"
_RE_ENTITY_TAIL = (
    rf"(?=[ОАПЗНИоапзни])(?iU)\b(?=((?:{_FORMS})\b[\s\S]{{0,140}}))(?:{_FORMS})\b[\s\"'«»]*(?:[^\"'«»\n]{{1,80}})?"
)


def find_operator(c: Column) -> Column:
    """Operator named in a document: explicit phrase, else legal form with a quoted name, else
    a sole trader's full name."""
    text = F.coalesce(c, F.lit(""))
    said = let(F.btrim(clean_text(F.regexp_extract(text, _RE_OPERATOR_PHRASE, 1)), F.lit(" .;,:")),
               lambda p: F.when(p != "", p))

    def candidate(tail: Column) -> Column:
        t = F.substring(tail, 1, 140)
        form = F.upper(F.regexp_extract(t, rf"(?iU)^({_FORMS})\b", 1))
        quoted = clean_text(F.regexp_extract(t, "[\"'«]([^\"'«»]{1,80})[\"'»]", 1))
        person = clean_text(
            F.regexp_extract(t, r"(?U)ИП\s+([А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?)", 1)
        )
        return F.when(quoted != "", F.concat(form, F.lit(" «"), quoted, F.lit("»"))).when(
            (form == "ИП") & (person != ""), F.concat(F.lit("ИП "), person)
        )

    tails = F.regexp_extract_all(text, F.lit(_RE_ENTITY_TAIL), F.lit(1))
    named = F.try_element_at(F.filter(F.transform(tails, candidate), lambda x: x.isNotNull()), F.lit(1))
    return let(F.coalesce(said, named), lambda n: F.when(n.isNotNull(), truncate(n, 120)))


# Markers of processing purposes and of retention terms.
PURPOSE_MARKERS = (
    "обработки заявок", "обратной связи", "заключени", "исполнени договор", "оказани услуг",
    "доставк", "рассылк", "аналитик", "статистик", "информировани", "регистраци",
    "рассмотрени резюме", "подбор персонала", "продвижени", "консультаци", "записи на прием",
    "записи на приём", "бухгалтерск", "маркетинг",
)
RETENTION_MARKERS = (
    "срок хранени", "срок действия согласия", "до достижения цел", "до отзыва",
    "хранятся в течение", "срок обработки", "в течение", "лет с момента", "срок договора",
)


def find_purposes(c: Column) -> Column:
    return find_all_matches(c, PURPOSE_MARKERS)


def find_retention(c: Column) -> Column:
    return contains_any(c, RETENTION_MARKERS)


def snippet_around(text: Column, needle: Column, radius: int = 200, norm: Column | None = None) -> Column:
    """Window around the first match of ``needle``; the head of the text when there is none. Pass
    ``norm`` when the normalised text is already a column."""
    def window(b):
        raw, size = b["raw"], b["size"]
        start = F.greatest(F.lit(0), b["at"] - 1 - radius)
        end = F.least(size, b["at"] - 1 + b["n"] + radius)
        cut = F.concat(
            F.when(start > 0, "…").otherwise(""), clean_text(F.substr(raw, start + 1, F.greatest(F.lit(0), end - start))),
            F.when(end < size, "…").otherwise(""))
        return F.when(b["at"] > 0, cut).otherwise(squeeze(raw, 2 * radius))

    def found(nn):
        at = F.when(nn != "", F.position(nn, normalize_for_search(text) if norm is None else norm)).otherwise(0)
        raw = F.coalesce(text, F.lit(""))
        return F.struct(raw.alias("raw"), at.alias("at"), F.length(nn).alias("n"), F.length(raw).alias("size"))

    return let(let(normalize_for_search(needle), found), window)


def first_snippet(c: Column, n: int = 400) -> Column:
    raw = F.coalesce(c, F.lit(""))
    bare = F.regexp_replace(
        F.regexp_replace(raw, r"(?isU)<(script|style|noscript)[^>]*>.*?</\1>", " "), r"<[^>]+>", " "
    )
    return squeeze(F.when(raw.contains("<") & raw.contains(">"), bare).otherwise(raw), n)


def html_to_text_regex(c: Column) -> Column:
    """JVM-only text of an HTML column: comments, script-like blocks and tags dropped, the basic
    entities decoded. The audit itself uses the parsed text of ``operators.page_facts``."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?isU)<(script|style|noscript|template)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"),
                         ("copy", "©"), ("middot", "·"), ("amp", "&")):
        t = F.regexp_replace(t, f"&{entity};?", char)
    return clean_text(t)


def detect_format(url: Column, content_type: Column) -> Column:
    from sitelens.functions.urls import url_extension

    ext, ct = url_extension(url), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when((ext == "pdf") | ct.contains("pdf"), "pdf")
        .when(ext.isin("docx", "doc") | ct.contains("officedocument.wordprocessing") | ct.contains("msword"), "docx")
        .otherwise("html")
    )


def evidence(page_url=None, quote=None, html_snippet=None, extra=None) -> Column:
    """Evidence struct: quote at most 500 characters, HTML at most 800."""
    def text(x):
        return F.coalesce(x if isinstance(x, Column) else F.lit(x), F.lit(""))

    pairs = [x for k, v in (extra or {}).items() for x in (F.lit(k), v.cast("string"))]
    mapped = F.create_map(*pairs) if pairs else F.create_map()
    return F.struct(
        text(page_url).alias("page_url"),
        squeeze(text(quote), 500).alias("quote"),
        truncate(text(html_snippet), 800).alias("html_snippet"),
        mapped.cast("map<string,string>").alias("extra"),
    )


# Accusing wording and its neutral replacement, applied in this order.
TONE_REPLACEMENTS = (
    ("нарушение установлено", "выявлен признак риска, требующий проверки"),
    ("установлено нарушение", "выявлен признак риска, требующий проверки"),
    ("вы нарушаете", "имеются признаки риска, связанные с"),
    ("сайт незаконен", "в отношении сайта выявлены признаки риска"),
    ("это незаконно", "это требует проверки на соответствие требованиям"),
    ("является незаконным", "требует проверки на соответствие требованиям"),
    ("незаконно", "требует проверки на соответствие требованиям"),
    ("незаконный", "требующий проверки"),
    ("незаконная", "требующая проверки"),
    ("незаконное", "требующее проверки"),
    ("грозит штраф", "возможны риски, которые следует оценить с юристом"),
    ("грозит штрафом", "требует оценки рисков с юристом"),
    ("штрафом", "рисками, которые следует оценить с юристом"),
    ("штрафа", "рисков, которые следует оценить с юристом"),
    ("штрафы", "риски, которые следует оценить с юристом"),
    ("штраф", "риск, который следует оценить с юристом"),
    ("нарушение закона", "признак риска, требующий проверки"),
    ("вы нарушили", "имеются признаки риска, связанные с"),
    ("нарушение", "признак риска"),
    ("нарушения", "признаки риска"),
)
FORBIDDEN_PHRASES = (
    "вы нарушаете", "вы нарушили", "нарушение установлено", "установлено нарушение", "незаконно",
    "незаконный", "незаконная", "незаконное", "штраф", "штрафы", "штрафа", "штрафом",
    "сайт незаконен", "нарушение закона",
)
GENITIVE_HEADS = ("характер", "характере", "факт", "факта", "факте", "вид", "вида", "форм")


def sanitize_tone(c: Column, repair: bool = True) -> Column:
    out = F.coalesce(c, F.lit(""))
    for needle, neutral in TONE_REPLACEMENTS:
        out = F.regexp_replace(out, rf"(?iU)\Q{needle}\E", neutral)
    if not repair:
        return out
    for head in GENITIVE_HEADS:
        out = F.regexp_replace(
            out, rf"(?iU)(\b{head}[а-яё]*\s+)призна(?:ки|к)\s+риска", "$1признака риска"
        )
    sign = r"призна(?:к|ки|ка|ков)\s+риска"
    return F.regexp_replace(out, rf"(?iU)({sign})(?:\s+{sign})+", "$1")


def forbidden_phrases(c: Column) -> Column:
    return find_all_matches(c, FORBIDDEN_PHRASES)


def amount_to_int(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    digits = F.regexp_replace(low, "[^0-9]", "")
    money = low.contains("₽") | low.contains("руб")
    return F.when(money, F.coalesce(digits.try_cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def clamp_score(c: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(c, F.lit(0))))


def score_display(c: Column) -> Column:
    n = F.coalesce(c, F.lit(0))
    return F.when(n > 100, "100+").otherwise(F.greatest(n, F.lit(0)).cast("string"))


def lenient_json(c: Column) -> Column:
    """JSON object text out of a chatty answer, NULL when nothing parses; a list is wrapped
    as ``{"items": [...]}``."""
    s = strip(F.coalesce(c, F.lit("")))
    fenced = strip(F.regexp_extract(s, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1))
    half = strip(F.regexp_replace(F.regexp_replace(s, r"^```(?:json|JSON)?\s*", ""), r"\s*```$", ""))
    body = F.when(s.rlike(r"(?s)```(?:json|JSON)?\s*(.*?)```"), F.when(fenced != "", fenced).otherwise(s)).otherwise(half)
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    block = F.when(braces != "", strip(braces)).otherwise(body)
    quotes = F.translate(block, "“”„‟«»‘’", "\"\"\"\"\"\"''")
    tries = [x for base in (block, quotes) for x in (base, F.regexp_replace(base, r",(\s*[}\]])", "$1"))]

    def parsed(x):
        kind = F.schema_of_variant(F.try_parse_json(x))
        return F.when(kind.startswith("OBJECT"), x).when(
            kind.startswith("ARRAY"), F.concat(F.lit('{"items": '), x, F.lit("}"))
        )

    return F.coalesce(*[parsed(x) for x in tries])


# Labels shown for codes.
LABELS = {
    "level": {
        "unknown": "не определён", "low": "низкий", "medium": "средний", "high": "высокий",
        "critical": "критический",
    },
    "status": {
        "new": "новый", "scanned": "проверен", "needs_review": "нужна проверка",
        "approved": "одобрен", "sent": "отправлен", "interested": "интерес",
        "rejected": "отказ", "do_not_contact": "не контактировать",
    },
    "doc_type": {
        "privacy_policy": "Политика обработки персональных данных",
        "consent": "Согласие на обработку персональных данных",
        "ad_consent": "Согласие на рекламную рассылку",
        "cookie_policy": "Политика cookie",
        "offer": "Публичная оферта",
        "user_agreement": "Пользовательское соглашение",
        "special_consent": "Согласие на обработку специальных категорий ПДн",
        "distribution_consent": "Согласие на распространение ПДн",
        "other": "Иной документ",
    },
    "core_status": {
        "ok": "выполнено", "risk": "зона риска", "unclear": "требует проверки",
        "not_applicable": "не применимо",
    },
    "item_status": {"found": "есть", "not_found": "не обнаружено", "unclear": "требует проверки",
                    "not_applicable": "не применимо"},
    "industry": {"": "не указана", "auto": "не указана"},
}


def label(kind: str, c: Column) -> Column:
    """Display label of a code; an unknown code is shown as it is."""
    pairs = [F.lit(x) for kv in LABELS[kind].items() for x in kv]
    key = F.coalesce(c, F.lit(""))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(key)), key)


LEVEL_RANK = {"unknown": -1, "low": 0, "medium": 1, "high": 2, "critical": 3}


def level_rank(c: Column) -> Column:
    pairs = [F.lit(x) for kv in LEVEL_RANK.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(-1))
