import pytest

from folium.llm.confusables import normal_form, normalized, odd_rows

CHANGED = [
    ("рyблeй", "рублей"), ("１２ ％", "12 %"), ("йод ёж", "йод ёж"), ("ру​б\xadль", "рубль"), ("1 000\xa0руб.", "1 000 руб."), ("1О0 и 2O26", "100 и 2026"), ("105З6", "10536"), ("c даты акта", "с даты акта"),
    ("миллиοнοв", "миллионов"), ("Warrаnty", "Warranty"), ("один，два", "один,два"), ("VL-99O9", "VL-9909"), ("für", "für"), ("ﬁle", "file"), ("6.1 а", "6.1\nа"),
]
PROPER = ["№ 5 «Ю» — … 77 м² 185 °C 5 ₽ “x” „y“", "TK-8703 и XM-3934", "附件101说明；请勿倒置，共5件！", "डॉ. शर्वाल ने जाँच पूरी की।", "อุปกรณ์รุ่นZM-6582มีน้ำหนัก", "تبدأ مدة الضمان", "क्‍ष", "530-З, К42-3615/2016", "Der Druck beträgt ca. 5 bar, i.e. viel", "Co. Ltd", "файл XL-1756.pdf", "", " ", "v5.16.1"]


@pytest.mark.parametrize("text,want", CHANGED)
def test_changed(text, want):
    assert normal_form(text) == want


@pytest.mark.parametrize("text", PROPER)
def test_proper_content_stays(text):
    assert normal_form(text) == text


def test_idempotent():
    for text, _ in CHANGED:
        assert normal_form(normal_form(text)) == normal_form(text)


def test_rows(spark):
    schema = "k bigint, raw string, text string, changed string"
    df = spark.createDataFrame([(1, "рyб", "", ""), (1, "рyб", "", ""), (2, "руб", "", ""), (3, None, "", ""), (None, "рyб", "", ""), (4, "а" * 100000 + "a", "", "")], schema)
    assert sorted(r["row_id"] for r in odd_rows(df, key="k", text="raw").collect()) == [1, 4]
    assert normalized(df, key="k", text="raw").count() == 4
    assert odd_rows(spark.createDataFrame([], schema), key="k", text="raw").count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("Наш Совет решил, что COBET прав", "Наш Совет решил, что СОВЕТ прав"),  # a whole word, known from the text
        ("Поставка TOB завершена, тов принят", "Поставка ТОВ завершена, тов принят"),
        ("Изделие TOB завершено", "Изделие TOB завершено"),  # a name, for all the text tells
        ("Партия TM-133 и ТМ-133", "Партия TM-133 и ТМ-133"),  # codes stay
        ("This is а test of Сору here", "This is a test of Copy here"),  # Cyrillic letters in a Latin text
        ("Text с русскими словами", "Text с русскими словами"),
        ("𝐀𝐁𝐂 и 𝟏𝟐", "ABC и 12"),
    ],
)
def test_whole_words_and_mathematical_letters(text, want):
    assert normal_form(text) == want
