"""Hand-written pages: each shows one feature, so that patterns can be tried on markup that the tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name, url, markup.
SNIPPETS = (
    ("empty", "http://shop.example.ru/a", ""),
    ("face", "http://shop.example.ru/", "<p>x</p>"),
    ("phone", "http://a.ru/1", '<p>тел. 123-45-67</p><b>+7 (495) 123-45-68</b> <i>8 800 555 3535</i>'),
    ("bad_phone", "http://a.ru/1", "<p>телефон 1234567 </p>"),
    ("address_street_last", "http://a.ru/1", "<p>Большая Морская ул., д. 12</p>"),
    ("address_street_first", "http://a.ru/1", "<td>ул. Ленина, дом 5а</td>"),
    ("address_moscow", "http://a.ru/1", "<td>Москва, Тверская улица, 7</td> Адрес: там"),
    ("search", "http://a.ru/1", '<input value="Поиск по сайту"><b>Найти</b>'),
    ("consultant", "http://a.ru/1", '<script src="//code.jivosite.com/script/widget/1"></script>'),
    ("payment", "http://a.ru/1", '<a href="/d"> Способы оплаты <b>x</b></a>'),
    ("delivery", "http://a.ru/1", "<a> Доставка и оплата</a>"),
    ("timetable", "http://a.ru/1", "<b>С 9:00 до 18:30</b>"),
    ("timetable_range", "http://a.ru/1", "<b>9:00 - 18:00</b>"),
    ("num_res", "http://a.ru/1", "<b>Показывать по:</b>"),
    ("ads", "http://a.ru/1", '<ins class="AdsByGoogle"></ins>'),
    ("ask", "http://a.ru/1", "<a> Задать Вопрос </a>"),
    ("callback", "http://a.ru/1", "<a>Заказать Звонок</a>"),
    ("callback_class", "http://a.ru/1", '<a class="callback">x</a>'),
    ("price_list", "http://a.ru/1", "<a>Прайс-лист</a>"),
    ("catalogue", "http://a.ru/1", "<b>Каталог</b>"),
    ("prices", "http://a.ru/1", "<b>1 200 руб.</b> <i>Цена: 15,50 </i> (99$)"),
    ("range", "http://a.ru/1", "<b>Товары 11 - 30 из 250</b>"),
)


def pages(spark: SparkSession) -> DataFrame:
    """(page_id, url, html) of ``SNIPPETS``, numbered from 0."""
    return spark.createDataFrame([(k, url, html) for k, (_, url, html) in enumerate(SNIPPETS)], "page_id long, url string, html string")


def pages_sql() -> str:
    """The same as a VALUES list."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "(values " + ", ".join(f"({k}::bigint, {quoted(url)}, {quoted(html)})" for k, (_, url, html) in enumerate(SNIPPETS)) + ") as pages(page_id, url, html)"
