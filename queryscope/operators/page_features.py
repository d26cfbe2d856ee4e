"""Features of web pages: patterns as columns, tree features by one parse, and comparison with peers.

A feature of several steps takes the first step that finds anything: marked-up data before class names before patterns.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscope.operators.dom import Flat
from queryscope.operators.readability import Extractor

#: Fixed patterns. Spark reads them with Unicode classes and case (flags below), so that white space and Cyrillic count.
PHONE = r'(?:^|[>"\s])(?:т[.]\D*|тел[.]\D*|телефон\D*)(?:(?:\d{2,3})[-– ]?(?:\d{2})[-– ]?(?:\d{2})|(?:\d{3})[-– ](?:\d)[-– ](?:\d{3})|(?:\d{3})[-– ](?:\d{3})(?:[-– ](?:\d))?)(?:$|[<"\s])|(?:[+]7|[+]44|[ \^][8]?)(?:[-– ]?(?:\d{3}|[(]\d{3}[)])[-– ]?\d{3}[-– ]?\d[-– ]?\d[-– ]?\d[-– ]?\d|[-– ]?(?:\d{4}|[(]\d{4}[)])[-– ]?\d{2}[-– ]?\d[-– ]?\d[-– ]?\d[-– ]?\d)'
BAD_PHONE = "1234567|99999999|987654"
ADDRESSES = (
    r'(?:^|[>,;"\s])(?:[А-Я\d][А-Яа-я ]+ )[\s\n]*(?:[Уу]л[.]|[Пп]р-т|[Пп]р[.]|[Пп]ер[.]|[Нн]аб[.]|[Пп]роспект|[Пп]ереулок|[Уу]лица|[Нн]абережная|[Пп]роезд)(?:[,][\s]*|[\s\n]+)(?:д[.][\s]*|дом[\s]*|)[\d]+[/-]?[А-ЯA-Za-zа-я\d]{0,2}(?:["<]|$|[,]|[\s])',
    r'(?:[">]|^|[,;]|[\s])(?:[Уу]л[.][ ]?|[Пп]р-т |[Пп]р[.][ ]?|[Пп]ер[.][ ]?|[Нн]аб[.][ ]?|[Пп]роспект |[Пп]ереулок |[Уу]лица |[Нн]абережная |[Пп]роезд )(?:[А-Я\d][А-Яа-я ]+)(?:[,][\s]*|[\s\n]+)(?:д[.][\s]*|дом[\s]*|)[\d]+[/-]?[А-ЯA-Za-zа-я\d]{0,2}(?:["<]|$|[,]|[\s])',
    "Москва[,] [А-Яа-я ]*[,] [0-9]+",
)
ADDRESS_TAIL = "Адрес:"
FACE = r"^http://(?:[-_a-zA-Z.]+[.])+[a-z]{2,5}[/]?[\s]*$"
CONSULTANT = "livetex.ru/js/client.js|web.redhelper.ru/service/main.js|static.cloudim.ru/js/chat.js|consultsystems.ru/script/|//code.jivosite.com/script/widget/|//widget.siteheart.com/apps/js/sh.js"
PAYMENT = r"""[>=]["]?[\s](?:(?:варианты|способы|условия)[\s]*(?:оплаты|доставки)[\s]*|доставка(?:[\s]*[и\\][\s]*оплата)|оплата(?:[\s]*[и\\][\s]доставка))[\s]*["<]"""
SEARCH = r"""(?:^|>|=['"])[\s]*поиск(?: по сайту)?|найти[\s]*(?:$|[<'"])"""
TIMES = r"""(?:[>"]?[сc] ([\d]{1,2}:[\d]{2}) до ([\d]{1,2}:[\d]{2})|([\d]{1,2}:[\d]{2})(?:-| - )([\d]{1,2}:[\d]{2}))"""
SHOWN = r"""(?:(?:количество(?:[&]nbsp[;]|\s)|>)на стр(?:[.]|анице)|(?:выводить|показывать|показать|вывести)(?:[&]nbsp[;]|\s)(?:по|товаров))[:]?(?:[&]nbsp[;]|\s)*(?:$|"|<)"""
ADS = "(?:adsbygoogle|yandex_ad)"
ASK = r">[\s]*(?:задать вопрос|отправить сообщение)[\s]*<"
CALLBACK = r"(?:заказать |обратный )звонок|[>][\s]*перезвонить[\s]*[<]|call[-_]?back[^s]|звонок с сайта"
PRICE_LIST = r"""[>=]["]?прайс(?:[-\s]лист)?[< ]?"""
CATALOGUE = r"""(?:[>]|=["'])?(?:каталог|категории товаров)(?:[<]|["'])"""
PRICE = r"[\d]{1,3}(?:(?:[\s]|[&]nbsp[;]|[,])*[\d]{3})*(?:[.,](?:[\d][\d]|[-–]))?(?:[\s]|[&]nbsp[;])?(?:руб[.]?|[$]|USD|EUR|RUB|р[.])?"
PRICE_IN_OFFER = rf"""(?:["'>]|[^в][\s]*){PRICE}[ <"']"""
PRICE_IN_HTML = rf"""(?:["'>(]|(?:от|до|[Цц]ена[\s]*[-:]*[\s]*)(?:[\s]|[&]nbsp[;])+){PRICE}[) <"']"""
RANGE = r"(\d+)(?:[&]nbsp[;]|\s)*(?:[-—]|[&]mdash[;]|по)(?:[&]nbsp[;]|\s)*(\d+) из (\d+)"
PAGER = "pag(?:inat|e|ing|or)"
BASKET_HREF = r"[/=](?:shopping[-_])?(?:cart|basket)[/]?"
BASKET_TEXT = r"""(?:^|>|=")(?:[0-9\s\S]*(?:моя |ваша |товар(?:ов|а)?)?корзин[ае](?: пуста)?[:]?[\s\S]*|[\s]?в корзине(?: (?:[0-9]+|(?:пока)? нет)? товар[(]?(?:ов|а)?[)]?)?)(?:$|<|")"""
BASKET_NAME = "(?:^|[-_])?(?:cart|basket)(?:$|[-_])"
BUY_NAME = "(?:cart|basket)|^buy$|buy(?:[_-]?btn|[_-]?button|[_-]?now)"
BUY_TEXT = r"""^(?:[&]nbsp[;]|\s|["])*(?:купить(?: в один клик)?$|(?:добавить |положить )?в корзину|в корзину)(?:[&]nbsp[;]|\s|["])*$"""
PRICE_NAME = "(?:[Pp]ri[sc]e|[Cc]ena|[Cc]ost)"
CATALOGUE_HREF = r"^/catalog(?:ue)?(?:[/]|$)"
CATALOGUE_TEXT = "(?:каталог|категории товаров)"
VIDEO_SOURCES = ("youtube.com/v/", "//videoapi.my.mail.ru/")
OFFERS = ("http://schema.org/Offer", "http://data-vocabulary.org/Offer")
VIDEO_OBJECT = "http://schema.org/VideoObject"
#: Fixed pairs: attribute and value of an element, class of a child that is an address.
ADDRESS_MARKS = (("itemtype", "http://data-vocabulary.org/Organization", "adr"), ("itemtype", "http://data-vocabulary.org/Organization", "address"), ("class", "vcard", "adr"), ("itemtype", "http://schema.org/Organization", "address"))
HOLDERS = ("div", "table", "html", "section", "td")

#: Java flags: Unicode classes, with and without case. RE2 needs ``(?i)`` alone, since its case folding knows all letters.
EXACT, FOLDED = "(?U)", "(?iU)"
FLAGS = {"online_consultant": EXACT + CONSULTANT, "payment_delivery": FOLDED + PAYMENT, "search_text": FOLDED + SEARCH, "timetable": FOLDED + TIMES, "num_res": FOLDED + SHOWN, "advertising": FOLDED + ADS, "ask_q": FOLDED + ASK, "callback": FOLDED + CALLBACK, "price_list": FOLDED + PRICE_LIST, "catalogue_text": FOLDED + CATALOGUE}


def _pattern_columns(html: Column, url: Column) -> list[Column]:
    h = F.coalesce(html, F.lit(""))
    spots = h.contains(ADDRESS_TAIL).cast("int")
    for p in ADDRESSES:
        spots = spots + F.regexp_count(h, F.lit(EXACT + p))
    ends = [F.regexp_extract(h, EXACT + RANGE, k).try_cast("int") for k in (1, 2)]
    return [
        F.length(h).alias("html_len"), F.coalesce(url.rlike(FACE), F.lit(False)).cast("int").alias("face"), *[h.rlike(p).cast("int").alias(k) for k, p in FLAGS.items()],
        spots.alias("address_marks"), F.regexp_count(h, F.lit(EXACT + PRICE_IN_HTML)).alias("price_marks"), (ends[1] - ends[0] + 1).alias("shown_range"),
    ]


def regex_features(pages: DataFrame) -> DataFrame:
    """One row a page of what patterns on url and markup find; null markup counts as empty.

    ``shown_range`` is the size of the first "a-b of n", null without one.
    """
    return pages.select("page_id", *_pattern_columns(F.col("html"), F.col("url")))


def _phones(html: Column) -> Column:
    digits = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(EXACT + PHONE), F.lit(0)), lambda x: F.regexp_replace(x, r"\D", ""))
    short = F.transform(digits, lambda x: F.when((F.length(x) == 11) & (x.startswith("7") | x.startswith("8")), F.substr(x, F.lit(2))).when((F.length(x) == 12) & x.startswith("44"), F.substr(x, F.lit(3))).otherwise(x))
    return F.filter(short, lambda x: F.length(x).isin(5, 6, 7, 10, 11, 12) & ~x.rlike(BAD_PHONE))


def phones(pages: DataFrame) -> DataFrame:
    """(page_id, phones array): digits of acceptable numbers in order of appearance, country prefixes cut."""
    return pages.select("page_id", _phones(F.col("html")).alias("phones"))


def _re(pattern: str, fold: bool = True) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE if fold else 0)


_PAGER, _BASKET_TEXT, _BUY_NAME, _BUY_TEXT, _CATALOGUE_TEXT = map(_re, (PAGER, BASKET_TEXT, BUY_NAME, BUY_TEXT, CATALOGUE_TEXT))
_BASKET_HREF, _BASKET_NAME, _PRICE_NAME, _PRICE, _OFFER_PRICE, _CATALOGUE_HREF = (_re(p, fold=False) for p in (BASKET_HREF, BASKET_NAME, PRICE_NAME, PRICE, PRICE_IN_OFFER, CATALOGUE_HREF))


class Features:
    """The tree features of one page; elements are looked up by class, tag and place, not by walking the tree again."""

    def __init__(self, html: str | None):
        self.page = Flat(html)
        self.nodes = self.page.nodes
        self.links = self.page.tagged("a")
        self.by_class: dict[str, list[int]] = defaultdict(list)
        for k, x in enumerate(self.nodes):
            for name in dict.fromkeys(x.names()):
                self.by_class[name].append(k)

    def _with(self, attribute: str, value: str) -> list[int]:
        return [k for k, x in enumerate(self.nodes) if x.attrs.get(attribute) == value]

    def _commonest(self, names: re.Pattern, counts) -> int:
        """Most elements of one class whose name fits and that ``counts``."""
        return max((sum(map(counts, held)) for name, held in self.by_class.items() if names.search(name)), default=0)

    def description(self) -> str:
        return next((x.attrs.get("content", "") for x in self.nodes if x.tag == "meta" and x.attrs.get("name") == "description"), "")

    def addresses(self) -> int:
        return sum(y.attrs.get("class") == child for key, value, child in ADDRESS_MARKS for k in self._with(key, value) for y in self.nodes[k].elements())

    def search(self) -> bool:
        return any("search" in (x.attrs.get("class", "") + x.attrs.get("id", "")).lower() for x in self.nodes)

    def video(self) -> bool:
        return any(self.nodes[k].tag == "div" for k in self._with("itemtype", VIDEO_OBJECT)) or any(v in x.attrs.get("src", "") for x in self.nodes for v in VIDEO_SOURCES)

    def file(self, ext: str) -> bool:
        return any(self.nodes[k].attrs.get("href", "").lower().endswith(f".{ext.lower()}") for k in self.links)

    def pager(self) -> int:
        """Largest page number of the shortest list of numeric links below one pager class; an earlier list wins ties."""
        lists = {}
        for x in self.nodes:
            name = next(filter(_PAGER.search, x.names()), None)
            if name and name not in lists:
                texts = [self.page.text(a).strip() for k in self._with("class", name) for a in self.page.below(k, self.links)]
                lists[name] = [int(t) for t in texts if t.isdecimal()]
        fits = [n for n in lists.values() if n and ({1, 2, 3} <= set(n) or {2, 3, 4} <= set(n) or set(n) <= {1, 2})]
        return max(min(fits, key=lambda n: len(set(n)), default=[0]))

    def offers(self) -> list[int]:
        return next(filter(None, (self._with("itemtype", kind) for kind in OFFERS)), [])

    def cards(self) -> int:
        """Size of the commonest (class, holder's class) among elements with an image and a link; single ones do not count."""
        images, groups = self.page.tagged("img"), Counter()
        for k, x in enumerate(self.nodes):
            if k and self.page.below(k, images) and self.page.below(k, self.links):
                up = self.page.up[k]
                while up > 0 and self.nodes[up].tag not in HOLDERS:
                    up = self.page.up[up]
                groups.update((name, self.nodes[up].attrs.get("class", "")) for name in x.names() or [x.tag])
        return max((n for n in groups.values() if n > 1), default=0)

    def basket(self) -> bool:
        named = (x for x in self.nodes if x.attrs.get("id") and x.names())
        return any(_BASKET_HREF.search(self.nodes[k].attrs.get("href", "")) or _BASKET_TEXT.search(self.page.text(k)) for k in self.links) or any(_BASKET_NAME.search(n) for x in named for n in (*x.attrs["id"].split(), *x.names()))

    def buy_buttons(self) -> int:
        """Elements of the commonest buying class; without any, of the commonest buying label; without any, buttons so labelled."""
        labels = Counter(t for k, x in enumerate(self.nodes) if x.names() for t in [self.page.text(k).strip()] if _BUY_TEXT.search(t))
        submits = [x.attrs.get("value", "") for x in self.nodes if x.tag == "input" and x.attrs.get("type") == "submit"]
        shown = submits or [self.page.text(k).strip() for k in self.page.tagged("button")]
        return self._commonest(_BUY_NAME, lambda k: True) or max(labels.values(), default=0) or sum(bool(_BUY_TEXT.search(t)) for t in shown)

    def prices(self) -> int:
        """Offers with a price; without any, elements with a price of the commonest price class."""
        return sum(bool(_OFFER_PRICE.search(self.page.markup(k))) for k in self.offers()) or self._commonest(_PRICE_NAME, lambda k: bool(_PRICE.search(self.page.text(k))))

    def catalogue(self) -> bool:
        return any(_CATALOGUE_HREF.search(self.nodes[k].attrs["href"]) or _CATALOGUE_TEXT.search(self.page.markup(k)) for k in self.links if "href" in self.nodes[k].attrs)


def plain_text(html: str | None) -> str:
    """The main text with punctuation as blanks and blank lines closed up."""
    text = re.sub(r"[^\w\s]+|[•]+", " ", Extractor().summary(html).text()).strip()
    return re.sub(r"[\n\r][\n\r \t\a]+", "\n", text)


def dom_features(html: str | None, ext: str = "pdf") -> dict:
    f = Features(html)
    return {
        "description": f.description(), "addresses_marked": f.addresses(), "search_named": int(f.search()), "video": int(f.video()), "file": int(f.file(ext)), "pagination": f.pager(), "offers": len(f.offers()), "cards": f.cards(),
        "basket": int(f.basket()), "buy_buttons": f.buy_buttons(), "marked_prices": f.prices(), "catalogue_link": int(f.catalogue()), "text_len": len(plain_text(html)),
    }


DOM_SCHEMA = "description string, addresses_marked int, search_named int, video int, file int, pagination int, offers int, cards int, basket int, buy_buttons int, marked_prices int, catalogue_link int, text_len int"


def _tree_column(html: str, ext: str) -> Column:
    names = [x.split()[0] for x in DOM_SCHEMA.split(", ")]

    @F.pandas_udf(DOM_SCHEMA)
    def tree(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dom_features(h, ext) for h in pages], columns=names)

    return tree(html)


def tree_features(pages: DataFrame, ext: str = "pdf") -> DataFrame:
    """One row a page of the features that need the tree, in Python workers; ``ext`` is the kind of linked file looked for."""
    return pages.select("page_id", _tree_column("html", ext).alias("t")).select("page_id", "t.*")


#: The features that pages are compared by.
VECTOR = ("phones", "addresses", "buy_buttons", "prices", "variety_on_page", "basket", "ask_q", "callback", "catalogue", "timetable", "price_list", "num_res", "text_len", "face", "pdf", "online_consultant", "pagination", "payment_delivery", "search", "video")


def vector(pages: DataFrame) -> DataFrame:
    """page_id, the features of ``VECTOR``, the description, and the commercial and informational counts, in one pass without a join."""
    rows = pages.select("page_id", *_pattern_columns(F.col("html"), F.col("url")), F.size(_phones(F.col("html"))).alias("phones"), _tree_column("html", "pdf").alias("t"))
    rows = rows.select(*[c for c in rows.columns if c != "t"], "t.*")

    def first(*steps: str) -> Column:
        return F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in steps], F.lit(0)).cast("int")

    own = {"addresses": first("addresses_marked", "address_marks"), "prices": first("marked_prices", "price_marks"), "catalogue": first("catalogue_link", "catalogue_text"), "search": first("search_text", "search_named")}
    own |= {"variety_on_page": F.coalesce(F.when(F.col("offers") > 0, F.col("offers")), F.col("shown_range"), F.col("cards")).cast("int"), "pdf": F.col("file")}
    out = rows.select("page_id", "description", "advertising", "offers", *[(own[c] if c in own else F.col(c)).alias(c) for c in VECTOR])
    shows = [F.col(c) > 0 for c in ("basket", "payment_delivery", "price_list", "offers", "buy_buttons", "prices")]
    commercial = sum((x.cast("int") for x in shows[1:]), shows[0].cast("int"))
    informational = (F.col("text_len") > 1000).cast("int") + 3 * F.col("advertising") + F.col("video")
    return out.select("page_id", *VECTOR, "description", commercial.alias("commercial"), informational.alias("informational"))


def item_counts(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, pos, url, commercial, informational): what the pages behind ranked items (query_id, pos, url) show; 0 for unknown pages."""
    found = vector(pages.join(items.select("url").distinct(), "url", "left_semi")).join(pages.select("page_id", "url"), "page_id").groupBy("url").agg(F.max("commercial").alias("c"), F.max("informational").alias("i"))
    return items.join(found, "url", "left").select("query_id", "pos", "url", F.coalesce("c", F.lit(0)).alias("commercial"), F.coalesce("i", F.lit(0)).alias("informational"))


def outliers(features: DataFrame, peers: DataFrame) -> DataFrame:
    """(page_id, feature, value) outside mean ± sample deviation of the peer group; groups of one page judge nothing.

    ``features`` has numeric columns beside page_id; ``peers`` is (page_id, grp).
    """
    names = [c for c in features.columns if c != "page_id"]
    long = features.select("page_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("page_id", names, "feature", "value").join(peers, "page_id")
    stats = long.groupBy("grp", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n")).where("n > 1")
    out = long.join(stats, ["grp", "feature"]).where(F.abs(F.col("value") - F.col("mean")) > F.col("sd") + 1e-9)
    return out.select("page_id", "feature", F.round("value", 6).alias("value"))
