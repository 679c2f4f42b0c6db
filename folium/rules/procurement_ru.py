"""Rule pack for Russian procurement documents.

Fixed values: the words, patterns and limits below must equal those of the engine whose results are to be matched.
Word tests are either plain substrings of lower-cased text or stems at a left word boundary; order is significant.
"""

MARKER = r"\[\[стр\.\s*(\d+)\]\]"
TABLE_LINE = "[ТАБЛИЦА]"

NUMBER = r"\d{1,3}(?:[ \x{a0}]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?"
MULTIPLIER = r"тыс\.?|млн\.?|миллион\w*|тысяч\w*"
CURRENCY = r"руб(?:\.|лей|ля|ль)?|₽|RUB"
VAT_INCLUDED = r"включа\w*\s+НДС|с\s+учётом\s+НДС|с\s+учетом\s+НДС"
VAT_EXCLUDED = r"без\s+(?:учёта\s+|учета\s+)?НДС|НДС\s+не\s+облага"

PRICE_KEYWORDS = [
    "начальная (максимальная) цена контракта", "начальная максимальная цена контракта", "нмцк", "цена контракта составляет", "цена контракта:",
    "цена договора, определенная", "цена договора, определённая", "цена договора определена", "цена договора", "стоимость работ составляет",
    "цена договора составляет", "сумма контракта",
]
CONTRACT_SECURITY_KEYWORDS = [
    "обеспечение исполнения контракта", "обеспечения исполнения контракта", "обеспечение исполнения договора",
    "независимой гарантии, обеспечивающей", "независимая гарантия, обеспечивающая", "обеспечивающей надлежащее исполнение обязательств",
]
APPLICATION_SECURITY_KEYWORDS = ["обеспечение заявки", "обеспечения заявки"]

DATE = r"\b\d{2}\.\d{2}\.\d{4}\b"
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
TEXT_DATE = r"«?\d{1,2}»?\s+(?:" + "|".join(MONTHS) + r")\s+\d{4}\s*(?:г\.?|года)?"
DURATION = r"(?:в\s+течение\s+)?(\d{1,4})\s*(?:\([^)]{0,60}\)\s*)?(календарн\w*|рабоч\w*)?\s*(дн\w*|месяц\w*|недел\w*)"
START_KEYWORDS = ["срок начала", "начало выполнения", "дата начала", "дата начала работ", "с даты заключения"]
END_KEYWORDS = ["срок окончания", "окончание выполнения", "дата окончания", "завершения работ"]
END_SKIP = ["имущественн", "санкц", "ответственност", "устранен", "дефект", "гарантийн"]
DURATION_KEYWORDS = ["срок выполнения", "срок оказания", "срок поставки", "в течение", "календарных"]
DURATION_LATE = ["окончательн", "расчет", "расчёт", "гаранти"]
DURATION_WORKS = ["выполнен", "капитальн", "ремонт", "работ"]

REQUIREMENT_TRIGGERS = [
    "наличие", "должен", "должна", "обязан", "не менее", "не ниже", "лицензи", "сро", "саморегулируем", "опыт", "квалификац", "аттестац",
    "штат", "специалист", "оборудован", "техник", "деклараци", "выписк", "свидетельств", "аккредитац", "допуск", "отсутствие", "требуется",
    "предъявляются требования",
]
CATEGORIES = ["license", "qualification", "experience", "staff", "equipment", "financial", "documents", "other"]
CATEGORY_RULES = [
    ("license", ["лицензи", "разрешени", "допуск", "аккредитац"]),
    ("qualification", ["сро", "саморегулируем", "квалификац", "аттестац", "сертификац", "реестр специалистов"]),
    ("experience", ["опыт", "аналогичн", "исполненн", "ранее выполн"]),
    ("staff", ["штат", "специалист", "работник", "персонал", "инженер"]),
    ("equipment", ["оборудован", "техник", "машин", "средства измерен", "поверк"]),
    ("financial", ["обеспечен", "банковск", "гаранти", "задолженност", "финансов", "устойчивост"]),
    ("documents", ["деклараци", "выписк", "копи", "документ", "справк", "заявк", "свидетельств"]),
]
OPTIONAL_MARKERS = ["желательно", "рекомендуется", "может быть", "приветствуется", "при наличии"]
PARTY_ROLES = ["подрядчик", "исполнитель", "поставщик", "заказчик", "участник", "генподрядчик"]
PENALTY_TRIGGERS = ["пеня", "пени", "пеню", "пеней", "штраф", "неустойк", "удержание обеспечения", "реестр недобросовестных", "рнп"]
NON_PENALTY_MARKERS = ["не может превышать", "общая сумма начисленных", "освобождается от", "не начисляются", "порядок начисления определяется"]
SANCTION_RULES = [
    ("Пеня", ["пеня", "пени", "пеню"]),
    ("Штраф", ["штраф"]),
    ("Неустойка", ["неустойк"]),
    ("Удержание обеспечения", ["удержание обеспечения", "обращение обеспечения"]),
    ("Включение в РНП", ["реестр недобросовестных", "рнп"]),
    ("Возмещение убытков", ["возмещ"]),
]
SANCTION_DEFAULT = "Ответственность"
FORMULA = r"(?:\d+\s*/\s*\d+|\d+(?:[.,]\d+)?\s*%)[^.;\n]{0,140}"

RELEVANCE = {
    "нмцк": 5.0, "начальная (максимальная) цена": 5.0, "цена контракта": 3.0, "цена договора": 3.0, "обеспечение исполнения": 2.5,
    "обеспечение заявки": 2.0, "срок выполнения": 3.0, "сроки выполнения": 3.0, "срок оказания": 2.5, "календарных дней": 2.0, "этап": 1.0,
    "требования к участник": 5.0, "требования к исполнител": 4.0, "лицензи": 2.0, "саморегулируем": 2.0, "опыт": 1.0,
    "ответственность сторон": 4.0, "штраф": 3.0, "пени": 3.0, "неустойк": 2.5,
}
SENTENCE_SPLIT = r"(?<=[.;!?])\s+(?=[А-ЯA-Z0-9«(])|\n+"
LIST_ITEM_START = r"^(?:\d+(?:\.\d+)+\.?\s|\d+[.)]\s|[-•–—*]\s|\[\[стр\.|\[ТАБЛИЦА\]|Этап\s|Раздел\s|Приложение\s)"
SENTENCE_END = r"[.!?;:]$"
PAGE_LABEL = r"^(?:стр\.?|страница|page)\s*\d+(?:\s*(?:из|/|of)\s*\d+)?$"
BARE_NUMBER = r"^[-–—(\[]?\s*\d{1,4}\s*[-–—)\]]?$"
SUBJECT_LABELS = ["предмет закупки", "предмет контракта", "предмет договора", "объект закупки", "наименование объекта закупки"]
CUSTOMER_LABELS = ["заказчик", "государственный заказчик", "наименование заказчика"]
LEGAL_FORMS = ["фонд", "гбу", "учрежден", "ооо", "ао", "пао"]

TRANSFER = r"(?s)(\d{1,4})\s*(?:\([^)]{0,60}\)\s*)?(?:календарн\w*\s*)?(?:дн\w*)[^.;\n]{0,80}(?:передачи\s+объекта|капитальн\w+\s+ремонт)"
STAGES = [
    r"((?:этап|период)\s*(?:№\s*)?\d+[^\n:.]{0,120})[:—-]\s*([^\n]{0,220})",
    r"((?:перв\w*|втор\w*|трет\w*|\d+)\s+этап[^\n:]{0,160})[:—-]\s*([^\n]{0,220})",
    r"(?m)(?:^|\n)\s*((?:проектирование|капитальн\w+\s+ремонт|выполнени\w+\s+работ)[^\n:]{0,80})[:—-]\s*([^\n]{0,220})",
]
SECTION = r"требовани\w*\s+к\s+(?:участник\w*|исполнител\w*|подрядчик\w*|поставщик\w*|лиц\w*,?\s+осуществляющ\w*)"
SECTION_END = r"(?m)^\s*(?:\d+(?:\.\d+)*\.?\s+)?(?:ответственность\s+сторон|порядок\s+расчёт\w*|порядок\s+расчет\w*|порядок\s+оплаты|приёмка|приемка|техническое\s+задание|проект\s+контракта|штрафы|неустойки)"
LIABILITY = r"(?m)^\s*(?:\d+(?:\.\d+)*\.?\s+)?ответственность\s+сторон"
EXCLUDED = r"(?:^за\s+нарушен|(?:^|\s)пен[яи](?:\s|$)|штраф|неустойк|1\s*/\s*130|уплат\w+\s+заказчик|начисля\w+\s+пен)"
RESCUED = ["сро", "лиценз", "гарант", "обеспечен", "квалификац", "опыт"]
ORGANISATION = r"(?s)(?:некоммерческ\w+\s+организац\w+|государственн\w+\s+учрежден\w+|федеральн\w+\s+(?:государственн\w+\s+)?учрежден\w+|муниципальн\w+\s+учрежден\w+)\s+«[^»]{10,220}»"
AS_CUSTOMER = r"(?s)«([^»]{10,220})»[^»]{0,160}\(\s*далее\s*[–-]\s*заказчик"
ABBREVIATED = ["г", "гг", "ул", "д", "стр", "обл", "руб", "коп", "тыс", "млн", "ст", "п", "пп", "ч", "им", "т"]
PARTY_MARKERS = ["фонд", "гбу", "му ", "ооо", "ао ", "пао", "учрежден"]
DEADLINES_MISSING = "Сроки выполнения в документе не найдены - проверьте проект контракта или отдельное приложение с графиком работ"
REQUIREMENTS_MISSING = "Требования к исполнителю в документе не найдены"
PENALTIES_MISSING = "Штрафы и пени в документе не найдены - раздел об ответственности может быть в отдельном файле проекта контракта"
SOME_FAILED = "Обработано {} из {} фрагментов документа: часть запросов к модели завершилась ошибкой, выжимка может быть неполной"
SOME_SENT = "В модель отправлено {} из {} фрагментов (отобраны наиболее релевантные); увеличьте max_chunks для полного разбора"
