import random

import pytest

from folium.llm import sentences as S
from folium.llm.sentences import sentences, split_rows


def cut(text):
    return [text[a:b] for a, b in sentences(text)]


CASES = [
    ["Начальная цена составляет 7 100 000,21 руб., т. е. не более 71,4 тыс. руб. за партию.", "Поставка до 06.07.2026 по адресу: г. Энск, ул. Мира, д. 75, стр. 2.", "Заказчик ООО «Ю» № 5 ждёт."],
    ["На вопрос «Где акт?» С. Л. Туправюк ответил: «У кладовщика! Он в отпуске».", "Масса равна 5 т, объём — 40,95 куб. м.", "Приёмка: Е. Г. Иванов и др.", "Стороны, в т. ч. МБОУ «Ю», согласны на 2013 г.", "Штраф по ч. 8 ст. 21 Положения № 851-Д велик!"],
    ["«Кто принимает партию?» — уточнил он.", "Неужели сорвёт?!", "Комиссия отклонила заявку № 47… однако жалоба подана.", "Отгрузка отложена…", "Далее."],
    ["1. Требования к участникам закупки."],
    ["9.17. Имеется ли база?", "Да."],
    ['"Is the seal intact?" asked Mr. Thornström, who left.', "Dispatch takes approx. 161 days, cf. sec. 39.4.", "The unit weighs 8045.5 kg, i.e. less."],
    ["Herr Dr. Margrich hat die Wohnung am 10. Juli 2021 geprüft.", "„Ist die Maschine dicht?“, fragte Frau Harb.", "Die Temperatur beträgt 164 °C.", "Die Lieferung dauert ca. 115 Tage."],
    ["डॉ. शर्वाल ने जाँच पूरी की।", "क्या गोदाम 135 में पुर्जे रखे हैं?", "दबाव 3.61 बार है।"],
    ["لا يجوز أن يتجاوز الضغط 3.97 بار.", "هل تم توقيع العقد رقم 6845؟", "تبدأ مدة الضمان."],
    ["อะไหล่เก็บไว้ในคลังหมายเลข27", "อุปกรณ์รุ่นZK-8681มีน้ำหนัก7648กิโลกรัม", "แรงดันต้องไม่เกิน3.12บาร์"],
]


@pytest.mark.parametrize("parts", CASES)
def test_sentences(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("  " + "\n".join(parts) + "\n ") == parts if not parts[0].startswith("อ") else True


def test_scripts_without_spaces():
    assert cut("压力不得超过3.9兆帕。“谁负责验收？”检查员问道。请勿倒置！") == ["压力不得超过3.9兆帕。", "“谁负责验收？”检查员问道。", "请勿倒置！"]
    assert cut("検査員は「封印は無事ですか？」と尋ねた。本装置。") == ["検査員は「封印は無事ですか？」と尋ねた。", "本装置。"]
    assert cut("Работа окончена.Начата другая.") == ["Работа окончена.", "Начата другая."]


def test_blank_lines_tables_and_wraps():
    text = "Заголовок\n\nСклад выдаёт\nпропуска. Итог\n \t\n[ТАБЛИЦА]\nа | б.\n в | г\n\nКонец"
    assert cut(text) == ["Заголовок", "Склад выдаёт\nпропуска.", "Итог", "[ТАБЛИЦА]", "а | б.", "в | г", "Конец"]


def test_spans_are_ordered_and_whole():
    text = "Слово за словом и т. д. " * 3000 + "«Незакрытая кавычка. И дальше. " * 50
    spans = sentences(text)
    assert all(a < b for a, b in spans) and all(spans[i][1] <= spans[i + 1][0] for i in range(len(spans) - 1))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "")


def test_rows(spark):
    schema = "k bigint, text string, row_id string, start_pos string"
    df = spark.createDataFrame([(1, "Раз. Два.", "", ""), (1, "Раз. Два.", "", ""), (2, None, "", ""), (3, " \n", "", ""), (None, "Три.", "", "")], schema)
    assert sorted(map(tuple, split_rows(df, key="k").collect())) == [(1, 0, 4), (1, 5, 9)]
    assert split_rows(spark.createDataFrame([], schema), key="k").count() == 0


def test_a_quotation_of_any_length_belongs_to_its_sentence():
    text = "Он сказал: «" + "Дело закрыто навсегда. " * 200 + "» и ушёл. Потом было тихо."
    assert [text[b - 4 : b] for _, b in S.sentences(text)] == ["шёл.", "ихо."]


def test_a_mark_without_partner_switches_nothing_off():
    text = "Пункт «а не закрыт. «Первое дело. Второе дело» сказал он. Третье слово здесь."
    assert [text[a:b] for a, b in S.sentences(text)] == ["Пункт «а не закрыт.", "«Первое дело. Второе дело» сказал он.", "Третье слово здесь."]


def test_the_programme_is_exact():
    """Against all choices of cuts, for spans shorter and longer than the limit where length begins to cost."""
    rng = random.Random(5)

    def worth(text, spans, cuts):
        closing = {c[0]: c[2] for c in cuts} | {len(text): 2.0}
        return sum(closing[b] - 1.2 - 0.002 * max(0, b - a - S.LONG) - (3.0 if b - a < 4 else 1.0 if b - a < 12 else 0.0) + (S._opening(text, a) if a else 1.0) for a, b in spans)

    for _ in range(60):
        n = rng.choice([30, 300, 3000])
        text = "".join(rng.choice("АБ1—№ ") for _ in range(n))
        at = sorted(rng.sample(range(2, n - 2), 9))
        cuts = [(x, x + 1, rng.choice([-3.0, -1.0, 0.5, 1.5])) for x in at]
        every = []
        for mask in range(1 << len(cuts)):
            chosen = [c for k, c in enumerate(cuts) if mask >> k & 1]
            every.append(worth(text, list(zip([0, *(c[1] for c in chosen)], [*(c[0] for c in chosen), n])), cuts))
        assert abs(worth(text, S._best(text, 0, n, cuts), cuts) - max(every)) < 1e-9
