from pyspark.sql import functions as F

from sitelens.limits import INTERACTIVE, NONE
from sitelens.operators.html_parse import parse_page
from sitelens.operators.page_facts import page_facts


def forms_of(spark, *htmls, modals=None, limits=NONE):
    cols = "i int, url string, html string" + (", modal_htmls array<string>" if modals else "")
    rows = [(i, "https://a.ru/x", h) + ((modals[i],) if modals else ()) for i, h in enumerate(htmls)]
    df = spark.createDataFrame(rows, cols).withColumnRenamed("i", "page_pos")
    out = page_facts(df, limits=limits).select("page_pos", F.posexplode("forms").alias("pos", "f")).orderBy("page_pos", "pos").collect()
    return [[r.f for r in out if r.page_pos == i] for i in range(len(htmls))]


def test_scopes(spark):
    got = forms_of(
        spark,
        "<div><input name=q><button>Найти</button></div>",  # a lone search box is no form
        "<div class=m><input type=tel name=p><button>Жду</button></div>",  # one personal field is
        "<div><section><input name=q><input name=w><a class='btn-go' href=#>ok</a></section></div>",  # two fields, outermost box
        "<div><form><input name=email></form><button>x</button></div>",  # a box around a form is not counted again
        "<form><input type=hidden name=t><input type=submit></form>",  # nothing to fill in
        "<div><input name=a><input name=b></div>",  # no submit
        "<form><div><input type=tel name=t><button>1</button></div></form>",  # a box inside a form is not counted
        "<DIV>" * 650 + "<input type=tel name=p><button>Ок</button>",  # the outermost of the first 600 boxes
    )
    assert [len(x) for x in got] == [0, 1, 1, 1, 0, 0, 1, 1]
    assert [f["name"] for f in got[2][0].fields] == ["q", "w"]
    assert got[3][0].source == "html" and got[3][0].personal_data_fields == ["email"]


def test_box_beyond_a_set_cap_is_ignored(spark):
    html = "<div></div>" * 600 + "<div><input type=tel name=p><button>Ок</button></div>"
    assert forms_of(spark, html, limits=INTERACTIVE) == [[]] and len(forms_of(spark, html)[0]) == 1


def test_labels_and_categories(spark):
    html = """<form><label for=a>Телефон</label><input id=a name=x1><label>Дата рождения <input type=date name=x2></label>
    <input name=x3 aria-label='Ваш паспорт' title='имя'><input name=x4 title='Фамилия' required>
    <input name=x5 placeholder='E-mail' aria-required=TRUE><select name=city></select><input type=radio name=r></form>"""
    (form,), = forms_of(spark, html)
    assert [(f.name, f.label, f.category, f.required) for f in form.fields] == [
        ("x1", "Телефон", "phone", False), ("x2", "Дата рождения", "birthdate", False), ("x3", "Ваш паспорт", "passport", False),
        ("x4", "Фамилия", "name", True), ("x5", "", "email", True), ("city", "", "address", False), ("r", "", "other", False)]


def test_consent_states(spark):
    got = forms_of(
        spark,
        "<form><input type=tel name=t><input type=checkbox checked></form>",
        "<form><input type=tel name=t><span role=checkbox aria-checked=true></span></form>",
        "<form><input type=tel name=t><input type=checkbox></form>",
        "<form><input type=tel name=t></form><p>Нажимая кнопку, вы согласны с <a href='/p'>политикой</a></p>",
        "<form><input type=tel name=t></form><i>1</i><i>2</i><i>3</i><p><a href='/privacy'>далеко</a></p>",
        "<form><input type=tel name=t></form><a href='/privacy'>сама ссылка</a>",
        "<form><input type=tel name=t><p>Даю согласие, принимаю оферту</p><a href='mailto:privacy@a.ru'>политика</a></form>",
    )
    con = [x[0].consent for x in got]
    assert [k.checkbox_prechecked for k in con] == [True, True, False, None, None, None, None]
    assert (con[3].button_acceptance_only, con[3].privacy_link_found, con[3].consent_text_found) == (True, True, False)
    assert not con[4].privacy_link_found  # only three following siblings belong to the form
    assert not con[5].privacy_link_found and con[5].evidence_text == "сама ссылка"  # the sibling's text, not the sibling as a link
    assert con[6].merged_with_offer and con[6].privacy_link_found and con[6].privacy_link_urls == []


def test_modals_and_widgets(spark):
    html = "<div id='MARQUIZ-1' class='T396 eb-x'></div>"
    modal = "<div><input name=q><button>ok</button></div><script>jivo</script>"
    (got,) = forms_of(spark, html, modals=[[modal, ""]])
    assert [(f.form_id, f.source, f.form_type, f.confidence) for f in got] == [
        ("widget-tilda", "widget", "lead", 55), ("widget-envybox", "widget", "callback", 55), ("widget-marquiz", "widget", "lead", 55),
        ("modal-0", "modal", "generic", 50), ("widget-jivosite", "widget", "other", 55)]


def test_parser_on_broken_markup():
    p = parse_page("<p>a<p>b<script>track('</p>')</script><a href=' /x ' title=t>c <b>d</a></div>e<noscript>n</noscript><!-- c --> &amp;", "https://s.ru/")
    assert p["text"] == "a b c d e n &" and p["doc_text"] == "a b c d e &"
    assert p["anchors"] == [{"href": "/x", "url": "https://s.ru/x", "text": "c d", "title": "t", "has_href": True}]
    assert parse_page("", "")["text"] == "" and parse_page("<a href=", "")["nodes"] == []


def test_parser_survives_anything():
    for bad in ("<![x y[z]]>ok", "<![CDATA[x]]>ok", "<!DOCTYPE [<!x>]>ok", "<!ok>ok", "<?php x ?>ok", "<a b='\"<c>ok", "</>ok", "<!-- <p>ok", "&#xD800;ok", "&#99999999;ok",
                "<svg/onload=x>ok", "<<p>>ok", "\x00<p\x00>ok", "<script>ok", "<title>a<b>c</title>ok"):
        assert isinstance(parse_page(bad, "https://s.ru/")["text"], str)
    assert parse_page("<![x y[z]]>ok", "")["text"].endswith("ok")
    deep = parse_page("<div>" * 5000 + "<input name=a><button>b</button>", "")
    assert sum(n["tag"] == "div" for n in deep["nodes"]) == 5000


def _many(n, wrap=0):
    one = '<section><input name="n{0}"><label for="i{0}">Телефон {0}</label><input id="i{0}" type="tel"><button>Отправить</button></section>'
    return "<body>" + "<div><p>x</p>" * wrap + "".join(one.format(i) for i in range(n)) + "</div>" * wrap + "</body>"


def test_pages_of_many_containers(spark):
    """10,000 fields in 5,000 containers, and containers below 700 others: all found, in seconds."""
    import time

    from pyspark.sql import functions as F

    from sitelens.operators.page_facts import page_facts

    deep = "<div>" * 700 + '</div>' * 700 + '<section><input name="user_name"><input type="tel"><button>Go</button></section>'
    df = spark.createDataFrame([("https://a.ru/", _many(5000)), ("https://b.ru/", deep), ("https://c.ru/", _many(3, 5))], "url string, html string")
    page_facts(df.limit(0)).select("url", "forms").collect()
    start = time.perf_counter()
    got = {r.url: r.forms for r in page_facts(df).select("url", "forms").collect()}
    assert time.perf_counter() - start < 60
    forms = got["https://a.ru/"]
    assert len(forms) == 5000 and [f.label for f in forms[4999].fields] == ["", "Телефон 4999"] and forms[4999].submit_text == "Отправить"
    assert len(got["https://b.ru/"]) == 1 and len(got["https://c.ru/"]) == 1 and len(got["https://c.ru/"][0].fields) == 6
