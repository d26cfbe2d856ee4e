"""Golden pages: one for each feature and each rule of main-content extraction, with the value worked out by hand."""

import pytest

from queryscope.operators import page_features as pf
from queryscope.operators import readability as rd
from queryscope.operators.dom import Flat, parse
from queryscope.sources import snippets

#: What each snippet shows, beside zeros.
SHOWN = {
    "face": {"face": 1},
    "phone": {"price_marks": 2},  # "(495)" and ">8 800 555 " read as prices
    "address_street_last": {"address_marks": 1},
    "address_street_first": {"address_marks": 1},
    "address_moscow": {"address_marks": 3},  # a street, Moscow, and "Адрес:"
    "search": {"search_text": 1},
    "consultant": {"online_consultant": 1},
    "payment": {"payment_delivery": 1},
    "delivery": {"payment_delivery": 1},
    "timetable": {"timetable": 1},
    "timetable_range": {"timetable": 1},
    "num_res": {"num_res": 1},
    "ads": {"advertising": 1},
    "ask": {"ask_q": 1},
    "callback": {"callback": 1},
    "callback_class": {"callback": 1},
    "price_list": {"price_list": 1},
    "catalogue": {"catalogue_text": 1},
    "prices": {"price_marks": 3},
    "range": {"shown_range": 20},
}


def test_pattern_features(spark):
    rows = {r["page_id"]: r.asDict() for r in pf.regex_features(snippets.pages(spark)).collect()}
    for k, (name, _, html) in enumerate(snippets.SNIPPETS):
        got = {c: v for c, v in rows[k].items() if v and c not in ("page_id", "html_len")}
        assert got == SHOWN.get(name, {}), name
        assert rows[k]["html_len"] == len(html)


def test_hard_spaces_count(spark):
    pages = spark.createDataFrame([(1, "u", "<a> Задать вопрос </a>"), (2, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["ask_q"] for r in pf.regex_features(pages).collect()}
    assert got == {1: 1, 2: 0}


def test_phones(spark):
    got = {r["page_id"]: r["phones"] for r in pf.phones(snippets.pages(spark)).collect()}
    names = [name for name, *_ in snippets.SNIPPETS]
    assert got[names.index("phone")] == ["1234567", "4951234568", "8005553535"][1:] and got[names.index("bad_phone")] == []
    assert sum(map(len, got.values())) == 2


OFFER = '<div itemtype="http://schema.org/Offer">{}</div>'
DOM = [
    ("", {}),
    ('<meta name="description" content="Всё об окнах">', {"description": "Всё об окнах"}),
    ('<div itemtype="http://schema.org/Organization"><p class="address">a</p><p class="address">b</p><i><p class="address">deep</p></i></div>', {"addresses_marked": 2}),
    ('<div class="vcard"><b class="adr">a</b></div>', {"addresses_marked": 1}),
    ('<form id="SearchForm"></form>', {"search_named": 1}),
    ('<div itemtype="http://schema.org/VideoObject"></div>', {"video": 1}),
    ('<iframe src="http://youtube.com/v/1"></iframe>', {"video": 1}),
    ('<a href="/Price.PDF">x</a>', {"file": 1}),
    ('<div class="paging"><a>1</a><a>2</a><a>3</a><a>17</a><a>next</a></div>', {"pagination": 17}),
    ('<div class="pager"><a>2</a><a>1</a></div><div class="page"><a>2</a><a>3</a><a>4</a><a>9</a></div>', {"pagination": 2}),
    ('<div class="pager"><a>5</a><a>6</a></div>', {}),
    (OFFER.format("<b>x 10 руб. </b>") + OFFER.format("<b>none</b>"), {"offers": 2, "marked_prices": 1}),
    ('<div class="list"><li class="c"><img><a>x</a></li><li class="c"><img><a>x</a></li><li class="d"><img><a>x</a></li></div>', {"cards": 2}),
    ('<a href="/shopping-cart/">x</a>', {"basket": 1}),
    ("<a>Моя Корзина</a>", {"basket": 1}),
    ('<b id="top" class="mini-cart">x</b>', {"basket": 1, "buy_buttons": 1}),
    ('<a class="buy-btn">x</a><a class="buy-btn">x</a><a class="buy">Купить</a>', {"buy_buttons": 2}),
    ('<b class="k">Купить</b><b class="k">Купить</b><b class="k">В корзину</b>', {"buy_buttons": 2}),
    ("<button>Купить в один клик</button><button>Нет</button>", {"buy_buttons": 1}),
    ('<input type="submit" value="Добавить в корзину"><button>Купить</button>', {"buy_buttons": 1}),
    ('<b class="price">10 руб.</b><b class="price">20</b><b class="old-price">нет</b><b class="cost">5</b>', {"marked_prices": 2}),
    ('<a href="/catalog/1">x</a>', {"catalogue_link": 1}),
    ('<a href="/x" title="Каталог">x</a>', {"catalogue_link": 1}),
    ('<a href="/my/catalog">x</a>', {}),
]


@pytest.mark.parametrize(("html", "shown"), DOM)
def test_tree_features(html, shown):
    got = {k: v for k, v in pf.dom_features(html).items() if v and k != "text_len"}
    assert got == shown


def test_steps_and_counts(spark):
    """Marked-up data goes before class names, and these before patterns."""
    text = "Слово, " * 200
    rows = [
        (1, "http://a.ru/x", '<div class="vcard"><b class="adr">ул. Ленина, дом 5</b></div><td>ул. Ленина, дом 5</td><td>ул. Мира, дом 6</td>'),
        (2, "http://a.ru/x", "<b>Товары 11 - 30 из 250</b>" + OFFER.format("x")),
        (3, "http://a.ru/x", '<b>Товары 11 - 30 из 250</b><li class="c"><img><a>x</a></li><li class="c"><img><a>x</a></li>'),
        (4, "http://a.ru/x", '<i class="price">1</i><b>1 200 руб.</b><b>10 руб.</b>'),
        (5, "http://a.ru/", f'<ins class="adsbygoogle"></ins><iframe src="http://youtube.com/v/1"></iframe><div><p>{text}</p></div>'),
        (6, "http://a.ru/x", '<a href="/cart">x</a><a> Доставка и оплата</a><a>Прайс</a><button>Купить</button>' + OFFER.format("<b>10 руб. </b>")),
        (7, None, None),
    ]
    got = {r["page_id"]: r for r in pf.vector(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["addresses"] == 1 and got[2]["variety_on_page"] == 1 and got[3]["variety_on_page"] == 20 and got[4]["prices"] == 1
    assert (got[5]["informational"], got[5]["face"], got[5]["commercial"]) == (5, 1, 0) and got[5]["text_len"] > 1000
    assert got[6]["commercial"] == 6 and got[6]["informational"] == 0
    assert all(got[7][c] == 0 for c in pf.VECTOR)


def test_places_in_the_source():
    html = "<div>\n<p>one<p>two <b>x</b></div><br/><i>open"
    flat = Flat(html)
    found = {x.tag + str(k): flat.markup(k) for k, x in enumerate(flat.nodes) if k}
    assert found == {"div1": html[:33], "p2": "<p>one", "p3": "<p>two <b>x</b>", "b4": "<b>x</b>", "br5": "<br/>", "i6": "<i>open"}
    assert flat.text(1) == "\nonetwo x" and flat.below(1, [2, 3, 4, 5]) == [2, 3, 4]
    assert parse('<p a="1&amp;2">x &lt; y<br></p>').html() == '<p a="1&amp;2">x &lt; y<br></p>'


LONG = "A sentence, with commas, that goes on. " * 12


def body(html):
    return rd.zones_of(f"<html><body>{html}</body></html>")["body"]


def test_unlikely_parts_go():
    got = body(f'<div><p>{LONG}</p></div><div class="sidebar"><p>{"Other words, of no use. " * 5}</p></div>')
    assert "A sentence" in got and "no use" not in got


def test_lenient_pass_finds_what_the_strict_one_drops():
    assert "A sentence" in body(f'<div class="comment"><p>{LONG}</p></div>')


def test_body_without_candidates():
    assert body("<b>tiny</b>") == "tiny"


def test_siblings():
    """Beside the best part stay lead paragraphs: long with few links, or short with a full stop and without any."""
    lead = "x" * 90
    kin = [f"<p>{lead}</p>", f"<p>{lead}<a>{lead}</a></p>", "<p>Short one.</p>", "<p>Short without stop</p>", "<p>Short <a>link</a>.</p>"]
    got = body(f"<section><article><p>{LONG}</p><p>{LONG}</p></article>{''.join(kin)}</section>")
    assert got.count(lead) == 1 and "Short one." in got and "without stop" not in got and "link" not in got


def test_headings_forms_and_frames():
    html = f'<div><h2 class="promo">Bad</h2><h2>Good</h2><h3><a>Linked</a></h3><form>form</form><iframe src="http://ads.example/">f</iframe><p>{LONG}</p></div>'
    got = body(html)
    assert "Good" in got and not any(x in got for x in ("Bad", "Linked", "form"))
    kept = rd.Extractor().summary(html.replace("http://ads.example/", "http://www.youtube.com/x"))
    assert kept.find("iframe") and not rd.Extractor().summary(html).find("iframe")


PARTS = [
    ("score", '<ul class="footer"><li>x</li></ul>'),
    ("images", f"<table><tr><td><p>{'w ' * 20}</p><img><img><img></td></tr></table>"),
    ("items", "<table><tr><td>" + "<ul>" + "<li>word</li>" * 101 + "</ul>" + "</td></tr></table>"),
    ("inputs", f"<table><tr><td>{'w ' * 20}<input></td></tr></table>"),
    (None, f"<table><tr><td>{'w ' * 20}<input type=hidden></td></tr></table>"),
    ("short", "<table><tr><td>few words</td></tr></table>"),
    (None, "<table><tr><td>few words<img></td></tr></table>"),
    ("links", f"<ul><li><a>{'w ' * 20}</a></li></ul>"),
    (None, f'<ul class="post"><li><a>{"w " * 20}</a>{"w " * 25}</li></ul>'),
    ("embeds", f"<table><tr><td>{'w ' * 20}<embed></td></tr></table>"),
    (None, "<table><tr><td>" + ",,,,,,,,,," + "</td></tr></table>"),
]


@pytest.mark.parametrize(("reason", "html"), PARTS)
def test_reasons_against_parts(reason, html):
    part = parse(html).elements()[0]
    assert rd.Extractor()._reason(part, {}) == reason


def test_text_around_spares_embedded_objects_alone():
    block = '<table><tr><td>' + "w " * 20 + "<embed></td></tr></table>"
    many = "<p>" + "Long text, of a kind. " * 60 + "</p>"
    assert rd.Extractor().summary(f"<section>{many}{block}{many}</section>").find("embed")
    short = "<p>" + "Long text, of a kind. " * 15 + "</p>"
    assert not rd.Extractor().summary(f"<section>{short}{block}{short}</section>").find("embed")


def test_keywords_and_divs():
    html = f'<div class="zzz"><p>{LONG}</p></div><div class="yyy"><p>{LONG} second</p></div>'
    assert "second" not in rd.Extractor(positive=["zzz"], negative=["yyy"]).summary(html).text()
    inner = parse("<div><div>text</div></div>")
    rd.Extractor(all_divs=False)._paragraphs(inner)
    assert [x.tag for x in inner.walk()] == ["#root", "div", "p"]


TITLES = [
    ("", ""),
    ("Plastic windows for your home | Site", "Plastic windows for your home"),
    ("Site | Plastic windows for your home", "Plastic windows for your home"),
    ("One two - Three four five six - Seven", "One two - Three four five six - Seven"),
    ("Shop: plastic windows for your home", "plastic windows for your home"),
    ("Shop: plastic windows cheap", "plastic windows cheap"),
    ("Short - name", "Short - name"),
    ("Окна — «дома»", 'Окна - "дома"'),
]


@pytest.mark.parametrize(("title", "want"), TITLES)
def test_short_titles(title, want):
    assert rd.short_title(parse(f"<title>{title}</title>")) == want


def test_title_by_heading():
    page = '<title>Plastic windows and doors of all kinds | Big site of things</title><h1>windows and doors of all</h1><b class="title">and doors of all kinds | Big</b>'
    assert rd.short_title(parse(page)) == "and doors of all kinds | Big"


def test_zones():
    z = rd.zones_of("<title></title><h1>One <b>two</b></h1><h1><i>deep</i></h1><h2>a</h2><h2></h2><img alt='pic'><img alt=''>")
    assert (z["title"], z["h1"], z["h2"], z["alts"]) == ("[no-title]", "One deep", ["a"], ["pic"])


def test_clean_markup():
    html = '<body bgcolor="red"><p style="a" onclick=\'x\' width=3 title="t">A<script>s()</script></p></body>'
    assert rd.body_html(html) == '<body><p title="t">A</p></body>'
    assert rd.readable_html("<p>x</p>") == "<html><body><p>x</p></body></html>"
