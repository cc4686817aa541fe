"""Word lists of the language: fixed values that right results depend on, and the look-up tables made from them by rule."""

from __future__ import annotations

from typing import NamedTuple


class Unit(NamedTuple):
    """Forms after one, few and many, after a decimal quantity, and the gender m, f or n."""

    one: str
    few: str
    many: str
    decimal: str = ""
    gender: str = "m"


class Currency(NamedTuple):
    code: str
    symbol: str
    word: str  # pattern of its word forms after an amount
    main: Unit
    sub: Unit
    trailing: bool  # whether the symbol may follow the amount
    digits: int  # of the minor unit


# --- fixed values: nouns that are counted: after one, few, many; instrumental and locative plural; gender -------------------
COUNTED = [
    ("користувач", "користувачі", "користувачів", "користувачами", "користувачах", "m"),
    ("документ", "документи", "документів", "документами", "документах", "m"),
    ("файл", "файли", "файлів", "файлами", "файлах", "m"),
    ("товар", "товари", "товарів", "товарами", "товарах", "m"),
    ("учасник", "учасники", "учасників", "учасниками", "учасниках", "m"),
    ("день", "дні", "днів", "днями", "днях", "m"),
    ("тиждень", "тижні", "тижнів", "тижнями", "тижнях", "m"),
    ("місяць", "місяці", "місяців", "місяцями", "місяцях", "m"),
    ("заявка", "заявки", "заявок", "заявками", "заявках", "f"),
    ("спроба", "спроби", "спроб", "спробами", "спробах", "f"),
    ("людина", "людини", "людей", "людьми", "людях", "f"),
    ("особа", "особи", "осіб", "особами", "особах", "f"),
    ("дитина", "дитини", "дітей", "дітьми", "дітях", "f"),
    ("місто", "міста", "міст", "містами", "містах", "n"),
    ("село", "села", "сіл", "селами", "селах", "n"),
    ("питання", "питання", "питань", "питаннями", "питаннях", "n"),
    ("книга", "книги", "книг", "книгами", "книгах", "f"),
    ("сторінка", "сторінки", "сторінок", "сторінками", "сторінках", "f"),
    ("помилка", "помилки", "помилок", "помилками", "помилках", "f"),
    ("пісня", "пісні", "пісень", "піснями", "піснях", "f"),
    ("година", "години", "годин", "годинами", "годинах", "f"),
    ("хвилина", "хвилини", "хвилин", "хвилинами", "хвилинах", "f"),
    ("секунда", "секунди", "секунд", "секундами", "секундах", "f"),
    ("задача", "задачі", "задач", "задачами", "задачах", "f"),
    ("квиток", "квитки", "квитків", "квитками", "квитках", "m"),
    ("пристрій", "пристрої", "пристроїв", "пристроями", "пристроях", "m"),
    ("сервер", "сервери", "серверів", "серверами", "серверах", "m"),
    ("сайт", "сайти", "сайтів", "сайтами", "сайтах", "m"),
    ("запис", "записи", "записів", "записами", "записах", "m"),
    ("рядок", "рядки", "рядків", "рядками", "рядках", "m"),
    ("курс", "курси", "курсів", "курсами", "курсах", "m"),
    ("слово", "слова", "слів", "словами", "словах", "n"),
    ("будинок", "будинки", "будинків", "будинками", "будинках", "m"),
    ("квартира", "квартири", "квартир", "квартирами", "квартирах", "f"),
    ("кімната", "кімнати", "кімнат", "кімнатами", "кімнатах", "f"),
    ("офіс", "офіси", "офісів", "офісами", "офісах", "m"),
    ("магазин", "магазини", "магазинів", "магазинами", "магазинах", "m"),
    ("школа", "школи", "шкіл", "школами", "школах", "f"),
    ("компанія", "компанії", "компаній", "компаніями", "компаніях", "f"),
    ("країна", "країни", "країн", "країнами", "країнах", "f"),
    ("область", "області", "областей", "областями", "областях", "f"),
    ("вулиця", "вулиці", "вулиць", "вулицями", "вулицях", "f"),
    ("дорога", "дороги", "доріг", "дорогами", "дорогах", "f"),
    ("машина", "машини", "машин", "машинами", "машинах", "f"),
    ("автомобіль", "автомобілі", "автомобілів", "автомобілями", "автомобілях", "m"),
    ("автобус", "автобуси", "автобусів", "автобусами", "автобусах", "m"),
    ("поїзд", "поїзди", "поїздів", "поїздами", "поїздах", "m"),
    ("літак", "літаки", "літаків", "літаками", "літаках", "m"),
    ("пакет", "пакети", "пакетів", "пакетами", "пакетах", "m"),
    ("лист", "листи", "листів", "листами", "листах", "m"),
    ("номер", "номери", "номерів", "номерами", "номерах", "m"),
    ("приклад", "приклади", "прикладів", "прикладами", "прикладах", "m"),
    ("програма", "програми", "програм", "програмами", "програмах", "f"),
    ("додаток", "додатки", "додатків", "додатками", "додатках", "m"),
    ("застосунок", "застосунки", "застосунків", "застосунками", "застосунках", "m"),
    ("проєкт", "проєкти", "проєктів", "проєктами", "проєктах", "m"),
    ("система", "системи", "систем", "системами", "системах", "f"),
    ("мережа", "мережі", "мереж", "мережами", "мережах", "f"),
    ("запит", "запити", "запитів", "запитами", "запитах", "m"),
    ("відповідь", "відповіді", "відповідей", "відповідями", "відповідях", "f"),
    ("команда", "команди", "команд", "командами", "командах", "f"),
    ("тест", "тести", "тестів", "тестами", "тестах", "m"),
    ("версія", "версії", "версій", "версіями", "версіях", "f"),
    ("таблиця", "таблиці", "таблиць", "таблицями", "таблицях", "f"),
    ("база", "бази", "баз", "базами", "базах", "f"),
    ("ключ", "ключі", "ключів", "ключами", "ключах", "m"),
    ("порт", "порти", "портів", "портами", "портах", "m"),
    ("канал", "канали", "каналів", "каналами", "каналах", "m"),
    ("повідомлення", "повідомлення", "повідомлень", "повідомленнями", "повідомленнях", "n"),
    ("замовлення", "замовлення", "замовлень", "замовленнями", "замовленнях", "n"),
    ("рішення", "рішення", "рішень", "рішеннями", "рішеннях", "n"),
    ("завдання", "завдання", "завдань", "завданнями", "завданнях", "n"),
    ("оновлення", "оновлення", "оновлень", "оновленнями", "оновленнях", "n"),
    ("правило", "правила", "правил", "правилами", "правилах", "n"),
    ("поле", "поля", "полів", "полями", "полях", "n"),
    ("значення", "значення", "значень", "значеннями", "значеннях", "n"),
    ("зображення", "зображення", "зображень", "зображеннями", "зображеннях", "n"),
    ("студент", "студенти", "студентів", "студентами", "студентах", "m"),
    ("учень", "учні", "учнів", "учнями", "учнях", "m"),
    ("вчитель", "вчителі", "вчителів", "вчителями", "вчителях", "m"),
    ("лікар", "лікарі", "лікарів", "лікарями", "лікарях", "m"),
    ("пацієнт", "пацієнти", "пацієнтів", "пацієнтами", "пацієнтах", "m"),
    ("працівник", "працівники", "працівників", "працівниками", "працівниках", "m"),
    ("клієнт", "клієнти", "клієнтів", "клієнтами", "клієнтах", "m"),
    ("покупець", "покупці", "покупців", "покупцями", "покупцях", "m"),
    ("гість", "гості", "гостей", "гостями", "гостях", "m"),
    ("жінка", "жінки", "жінок", "жінками", "жінках", "f"),
    ("чоловік", "чоловіки", "чоловіків", "чоловіками", "чоловіках", "m"),
    ("пляшка", "пляшки", "пляшок", "пляшками", "пляшках", "f"),
    ("коробка", "коробки", "коробок", "коробками", "коробках", "f"),
    ("порція", "порції", "порцій", "порціями", "порціях", "f"),
    ("рецепт", "рецепти", "рецептів", "рецептами", "рецептах", "m"),
    ("стаття", "статті", "статей", "статтями", "статтях", "f"),
    ("книжка", "книжки", "книжок", "книжками", "книжках", "f"),
    ("журнал", "журнали", "журналів", "журналами", "журналах", "m"),
    ("газета", "газети", "газет", "газетами", "газетах", "f"),
    ("доба", "доби", "діб", "добами", "добах", "f"),
]
# --- fixed values: units of measure: spellings; forms after one, few, many and a decimal quantity; gender ------------------
UNITS = [
    (["км", "km"], "кілометр", "кілометри", "кілометрів", "кілометра", "m"),
    (["м", "m"], "метр", "метри", "метрів", "метра", "m"),
    (["см", "cm"], "сантиметр", "сантиметри", "сантиметрів", "сантиметра", "m"),
    (["мм", "mm"], "міліметр", "міліметри", "міліметрів", "міліметра", "m"),
    (["дм", "dm"], "дециметр", "дециметри", "дециметрів", "дециметра", "m"),
    (["мкм", "µm", "μm"], "мікрометр", "мікрометри", "мікрометрів", "мікрометра", "m"),
    (["нм", "nm"], "нанометр", "нанометри", "нанометрів", "нанометра", "m"),
    (["пм", "pm"], "пікометр", "пікометри", "пікометрів", "пікометра", "m"),
    (["in"], "дюйм", "дюйми", "дюймів", "дюйма", "m"),
    (["ft"], "фут", "фути", "футів", "фута", "m"),
    (["yd"], "ярд", "ярди", "ярдів", "ярда", "m"),
    (["mi"], "миля", "милі", "миль", "милі", "f"),
    (["кг", "kg"], "кілограм", "кілограми", "кілограмів", "кілограма", "m"),
    (["г", "g"], "грам", "грами", "грамів", "грама", "m"),
    (["мг", "mg"], "міліграм", "міліграми", "міліграмів", "міліграма", "m"),
    (["т", "tonne", "tonnes", "ton", "tons"], "тонна", "тонни", "тонн", "тонни", "f"),
    (["oz"], "унція", "унції", "унцій", "унції", "f"),
    (["lb"], "фунт", "фунти", "фунтів", "фунта", "m"),
    (["л", "L"], "літр", "літри", "літрів", "літра", "m"),
    (["мл", "ml", "mL"], "мілілітр", "мілілітри", "мілілітрів", "мілілітра", "m"),
    (["gal"], "галон", "галони", "галонів", "галона", "m"),
    (["год", "год."], "година", "години", "годин", "години", "f"),
    (["хв", "хв.", "min"], "хвилина", "хвилини", "хвилин", "хвилини", "f"),
    (["с", "s"], "секунда", "секунди", "секунд", "секунди", "f"),
    (["K", "К"], "кельвін", "кельвіни", "кельвінів", "кельвіна", "m"),
    (["га"], "гектар", "гектари", "гектарів", "гектара", "m"),
    (["м²", "м2", "m²", "m2"], "квадратний метр", "квадратні метри", "квадратних метрів", "квадратного метра", "m"),
    (["см²", "см2", "cm²", "cm2"], "квадратний сантиметр", "квадратні сантиметри", "квадратних сантиметрів", "квадратного сантиметра", "m"),
    (["км²", "км2", "km²", "km2"], "квадратний кілометр", "квадратні кілометри", "квадратних кілометрів", "квадратного кілометра", "m"),
    (["м³", "м3", "m³", "m3"], "кубічний метр", "кубічні метри", "кубічних метрів", "кубічного метра", "m"),
    (["см³", "см3", "cm³", "cm3"], "кубічний сантиметр", "кубічні сантиметри", "кубічних сантиметрів", "кубічного сантиметра", "m"),
    (["см³/год", "см3/год"], "кубічний сантиметр за годину", "кубічні сантиметри за годину", "кубічних сантиметрів за годину", "кубічного сантиметра за годину", "m"),
    (["км/год", "km/h"], "кілометр на годину", "кілометри на годину", "кілометрів на годину", "кілометра на годину", "m"),
    (["м/с", "m/s"], "метр за секунду", "метри за секунду", "метрів за секунду", "метра за секунду", "m"),
    (["м/с²", "m/s²", "m/s2", "м/с2"], "метр за секунду в квадраті", "метри за секунду в квадраті", "метрів за секунду в квадраті", "метра за секунду в квадраті", "m"),
    (["км/с"], "кілометр за секунду", "кілометри за секунду", "кілометрів за секунду", "кілометра за секунду", "m"),
    (["л/100км", "л/100 км", "L/100km"], "літр на сто кілометрів", "літри на сто кілометрів", "літрів на сто кілометрів", "літра на сто кілометрів", "m"),
    (["кг/м³", "кг/м3", "kg/m³", "kg/m3"], "кілограм на кубічний метр", "кілограми на кубічний метр", "кілограмів на кубічний метр", "кілограма на кубічний метр", "m"),
    (["г/см³", "г/см3", "g/cm³", "g/cm3"], "грам на кубічний сантиметр", "грами на кубічний сантиметр", "грамів на кубічний сантиметр", "грама на кубічний сантиметр", "m"),
    (["Гц", "Hz"], "герц", "герци", "герц", "герца", "m"),
    (["кГц", "kHz"], "кілогерц", "кілогерци", "кілогерц", "кілогерца", "m"),
    (["МГц", "MHz"], "мегагерц", "мегагерци", "мегагерц", "мегагерца", "m"),
    (["ГГц", "GHz"], "гігагерц", "гігагерци", "гігагерц", "гігагерца", "m"),
    (["мс", "ms"], "мілісекунда", "мілісекунди", "мілісекунд", "мілісекунди", "f"),
    (["об/хв", "rpm"], "оберт за хвилину", "оберти за хвилину", "обертів за хвилину", "оберта за хвилину", "m"),
    (["Па", "Pa"], "паскаль", "паскалі", "паскалів", "паскаля", "m"),
    (["кПа", "kPa"], "кілопаскаль", "кілопаскалі", "кілопаскалів", "кілопаскаля", "m"),
    (["МПа", "MPa"], "мегапаскаль", "мегапаскалі", "мегапаскалів", "мегапаскаля", "m"),
    (["бар"], "бар", "бари", "барів", "бара", "m"),
    (["атм"], "атмосфера", "атмосфери", "атмосфер", "атмосфери", "f"),
    (["Вт", "W"], "ват", "вати", "ват", "вата", "m"),
    (["кВт", "kW"], "кіловат", "кіловати", "кіловат", "кіловата", "m"),
    (["МВт", "MW"], "мегават", "мегавати", "мегават", "мегавата", "m"),
    (["Вт·год", "Wh"], "ват-година", "ват-години", "ват-годин", "ват-години", "f"),
    (["кВт·год", "кВт-год", "kWh"], "кіловат-година", "кіловат-години", "кіловат-годин", "кіловат-години", "f"),
    (["Дж", "J"], "джоуль", "джоулі", "джоулів", "джоуля", "m"),
    (["кДж", "kJ"], "кілоджоуль", "кілоджоулі", "кілоджоулів", "кілоджоуля", "m"),
    (["МДж", "MJ"], "мегаджоуль", "мегаджоулі", "мегаджоулів", "мегаджоуля", "m"),
    (["В", "V"], "вольт", "вольти", "вольт", "вольта", "m"),
    (["мВ", "mV"], "мілівольт", "мілівольти", "мілівольт", "мілівольта", "m"),
    (["кВ", "kV"], "кіловольт", "кіловольти", "кіловольт", "кіловольта", "m"),
    (["МВ", "MV"], "мегавольт", "мегавольти", "мегавольт", "мегавольта", "m"),
    (["А", "A"], "ампер", "ампери", "ампер", "ампера", "m"),
    (["Ом", "Ω"], "ом", "оми", "омів", "ома", "m"),
    (["моль"], "моль", "молі", "молів", "моля", "m"),
    (["ммоль"], "мілімоль", "мілімолі", "мілімолів", "мілімоля", "m"),
    (["дБ", "dB"], "децибел", "децибели", "децибелів", "децибела", "m"),
    (["дБм"], "децибел-міліват", "децибел-мілівати", "децибел-міліват", "децибел-мілівата", "m"),
    (["ppm"], "частина на мільйон", "частини на мільйон", "частин на мільйон", "частини на мільйон", "f"),
    (["bps", "б.п."], "базисний пункт", "базисні пункти", "базисних пунктів", "базисного пункту", "m"),
    (["dpi"], "точка на дюйм", "точки на дюйм", "точок на дюйм", "точки на дюйм", "f"),
    (["fps"], "кадр за секунду", "кадри за секунду", "кадрів за секунду", "кадра за секунду", "m"),
    (["байт"], "байт", "байти", "байт", "байта", "m"),
    (["КБ", "KB"], "кілобайт", "кілобайти", "кілобайт", "кілобайта", "m"),
    (["МБ", "MB"], "мегабайт", "мегабайти", "мегабайт", "мегабайта", "m"),
    (["ГБ", "GB"], "гігабайт", "гігабайти", "гігабайт", "гігабайта", "m"),
    (["ТБ", "TB"], "терабайт", "терабайти", "терабайт", "терабайта", "m"),
    (["ПБ", "PB"], "петабайт", "петабайти", "петабайт", "петабайта", "m"),
    (["KiB"], "кібібайт", "кібібайти", "кібібайт", "кібібайта", "m"),
    (["MiB"], "мебібайт", "мебібайти", "мебібайт", "мебібайта", "m"),
    (["GiB"], "гібібайт", "гібібайти", "гібібайт", "гібібайта", "m"),
    (["TiB"], "тебібайт", "тебібайти", "тебібайт", "тебібайта", "m"),
    (["кбіт/с", "Кбіт/с", "kbps"], "кілобіт за секунду", "кілобіти за секунду", "кілобітів за секунду", "кілобіта за секунду", "m"),
    (["Мбіт/с", "мбіт/с", "Mbps"], "мегабіт за секунду", "мегабіти за секунду", "мегабітів за секунду", "мегабіта за секунду", "m"),
    (["Гбіт/с", "гбіт/с", "Gbps"], "гігабіт за секунду", "гігабіти за секунду", "гігабітів за секунду", "гігабіта за секунду", "m"),
    (["Н", "N", "кг·м/с²", "кг·м/с2"], "ньютон", "ньютони", "ньютонів", "ньютона", "m"),
    (["еВ", "eV"], "електронвольт", "електронвольти", "електронвольтів", "електронвольта", "m"),
    (["кеВ", "keV"], "кілоелектронвольт", "кілоелектронвольти", "кілоелектронвольтів", "кілоелектронвольта", "m"),
    (["МеВ", "MeV"], "мегаелектронвольт", "мегаелектронвольти", "мегаелектронвольтів", "мегаелектронвольта", "m"),
    (["ГеВ", "GeV"], "гігаелектронвольт", "гігаелектронвольти", "гігаелектронвольтів", "гігаелектронвольта", "m"),
    (["ТеВ", "TeV"], "тераелектронвольт", "тераелектронвольти", "тераелектронвольтів", "тераелектронвольта", "m"),
    (["кН", "kN"], "кілоньютон", "кілоньютони", "кілоньютонів", "кілоньютона", "m"),
    (["Н·м", "N·m"], "ньютон-метр", "ньютон-метри", "ньютон-метрів", "ньютон-метра", "m"),
    (["кН·м"], "кілоньютон-метр", "кілоньютон-метри", "кілоньютон-метрів", "кілоньютон-метра", "m"),
    (["Па·с"], "паскаль-секунда", "паскаль-секунди", "паскаль-секунд", "паскаль-секунди", "f"),
    (["Вт/м²", "Вт/м2", "W/m²", "W/m2"], "ват на квадратний метр", "вати на квадратний метр", "ват на квадратний метр", "вата на квадратний метр", "m"),
    (["кВт/м²", "kW/m²"], "кіловат на квадратний метр", "кіловати на квадратний метр", "кіловат на квадратний метр", "кіловата на квадратний метр", "m"),
    (["моль/л", "mol/L"], "моль на літр", "молі на літр", "молів на літр", "моля на літр", "m"),
    (["ммоль/л", "mmol/L"], "мілімоль на літр", "мілімолі на літр", "мілімолів на літр", "мілімоля на літр", "m"),
    (["мг/кг", "mg/kg"], "міліграм на кілограм", "міліграми на кілограм", "міліграмів на кілограм", "міліграма на кілограм", "m"),
    (["мкг/м³", "мкг/м3", "µg/m³", "μg/m³", "µg/m3", "μg/m3"], "мікрограм на кубічний метр", "мікрограми на кубічний метр", "мікрограмів на кубічний метр", "мікрограма на кубічний метр", "m"),
    (["кВт·год/100км", "кВт·год/100 км", "kWh/100km"], "кіловат-година на сто кілометрів", "кіловат-години на сто кілометрів", "кіловат-годин на сто кілометрів", "кіловат-години на сто кілометрів", "f"),
    (["°"], "градус", "градуси", "градусів", "градуса", "m"),
    (["мкг", "µg", "μg"], "мікрограм", "мікрограми", "мікрограмів", "мікрограма", "m"),
    (["мкл", "µL", "μL"], "мікролітр", "мікролітри", "мікролітрів", "мікролітра", "m"),
    (["мкс", "µs", "μs"], "мікросекунда", "мікросекунди", "мікросекунд", "мікросекунди", "f"),
    (["мА", "mA"], "міліампер", "міліампери", "міліамперів", "міліампера", "m"),
    (["µA", "μA"], "мікроампер", "мікроампери", "мікроамперів", "мікроампера", "m"),
    (["KB/s"], "кілобайт за секунду", "кілобайти за секунду", "кілобайтів за секунду", "кілобайта за секунду", "m"),
    (["MB/s"], "мегабайт за секунду", "мегабайти за секунду", "мегабайтів за секунду", "мегабайта за секунду", "m"),
    (["GB/s"], "гігабайт за секунду", "гігабайти за секунду", "гігабайтів за секунду", "гігабайта за секунду", "m"),
]
# --- fixed values: finance units: code; forms after one, few, many and a decimal quantity; whether feminine ---------------------
FINANCE = [
    ("BTC", "біткоїн", "біткоїни", "біткоїнів", "біткоїна", False),
    ("ETH", "ефір", "ефіри", "ефірів", "ефіра", False),
    ("USDT", "тезер", "тезери", "тезерів", "тезера", False),
    ("BNB", "бі ен бі", "бі ен бі", "бі ен бі", "бі ен бі", False),
    ("SOL", "солана", "солани", "солан", "солани", True),
    ("XRP", "ікс ар пі", "ікс ар пі", "ікс ар пі", "ікс ар пі", False),
    ("ADA", "ада", "ади", "ад", "ади", True),
    ("DOGE", "доджкоїн", "доджкоїни", "доджкоїнів", "доджкоїна", False),
    ("USDC", "ю ес ді сі", "ю ес ді сі", "ю ес ді сі", "ю ес ді сі", False),
    ("TRX", "трон", "трони", "тронів", "трона", False),
    ("TON", "тонкоїн", "тонкоїни", "тонкоїнів", "тонкоїна", False),
    ("DOT", "полкадот", "полкадоти", "полкадотів", "полкадота", False),
    ("LINK", "чейнлінк", "чейнлінки", "чейнлінків", "чейнлінка", False),
    ("LTC", "лайткоїн", "лайткоїни", "лайткоїнів", "лайткоїна", False),
    ("BCH", "біткоїн кеш", "біткоїни кеш", "біткоїнів кеш", "біткоїна кеш", False),
    ("AVAX", "аваланч", "аваланчі", "аваланчів", "аваланча", False),
    ("XLM", "стелар", "стелари", "стеларів", "стелара", False),
    ("HBAR", "гедера", "гедери", "гедер", "гедери", True),
    ("SHIB", "шіба-іну", "шіба-іну", "шіба-іну", "шіба-іну", False),
    ("DAI", "дай", "даї", "даїв", "дая", False),
    ("UNI", "юнісвап", "юнісвапи", "юнісвапів", "юнісвапа", False),
    ("ATOM", "космос", "космоси", "космосів", "космоса", False),
    ("XMR", "монеро", "монеро", "монеро", "монеро", False),
    ("ETC", "ефіріум класик", "ефіріуми класик", "ефіріумів класик", "ефіріума класик", False),
    ("ICP", "інтернет-комп'ютер", "інтернет-комп'ютери", "інтернет-комп'ютерів", "інтернет-комп'ютера", False),
    ("NEAR", "ніар", "ніари", "ніарів", "ніара", False),
    ("APT", "аптос", "аптоси", "аптосів", "аптоса", False),
    ("FIL", "файлкоїн", "файлкоїни", "файлкоїнів", "файлкоїна", False),
    ("CRO", "кронос", "кроноси", "кроносів", "кроноса", False),
    ("OKB", "оу кей бі", "оу кей бі", "оу кей бі", "оу кей бі", False),
    ("LDO", "лідо", "лідо", "лідо", "лідо", False),
    ("ARB", "арбітрум", "арбітруми", "арбітрумів", "арбітрума", False),
    ("OP", "оптимізм", "оптимізми", "оптимізмів", "оптимізма", False),
    ("AAVE", "ааве", "ааве", "ааве", "ааве", False),
    ("MKR", "мейкер", "мейкери", "мейкерів", "мейкера", False),
    ("GRT", "зе граф", "зе граф", "зе граф", "зе граф", False),
    ("ALGO", "алгоранд", "алгоранди", "алгорандів", "алгоранда", False),
    ("VET", "вічейн", "вічейни", "вічейнів", "вічейна", False),
    ("QNT", "квант", "кванти", "квантів", "кванта", False),
    ("FTM", "фантом", "фантоми", "фантомів", "фантома", False),
    ("SUI", "суї", "суї", "суї", "суї", False),
    ("SEI", "сей", "сеї", "сеїв", "сея", False),
    ("INJ", "інджектив", "інджективи", "інджективів", "інджектива", False),
    ("RENDER", "рендер", "рендери", "рендерів", "рендера", False),
    ("RNDR", "рендер", "рендери", "рендерів", "рендера", False),
    ("TAO", "біттензор", "біттензори", "біттензорів", "біттензора", False),
    ("IMX", "ім'ютабл ікс", "ім'ютабл ікс", "ім'ютабл ікс", "ім'ютабл ікс", False),
    ("STX", "стекс", "стекси", "стексів", "стекса", False),
    ("PEPE", "пепе", "пепе", "пепе", "пепе", False),
    ("BONK", "бонк", "бонки", "бонків", "бонка", False),
    ("WIF", "догвіфгет", "догвіфгети", "догвіфгетів", "догвіфгета", False),
    ("FLOKI", "флокі", "флокі", "флокі", "флокі", False),
    ("POL", "полігон", "полігони", "полігонів", "полігона", False),
    ("MATIC", "матік", "матіки", "матіків", "матіка", False),
    ("KAS", "каспа", "каспи", "касп", "каспи", True),
    ("TIA", "селестія", "селестії", "селестій", "селестії", True),
    ("JUP", "юпітер", "юпітери", "юпітерів", "юпітера", False),
    ("ENA", "етена", "етени", "етен", "етени", True),
    ("ONDO", "ондо", "ондо", "ондо", "ондо", False),
    ("PYTH", "піт нетворк", "піт нетворк", "піт нетворк", "піт нетворк", False),
    ("RUNE", "торчейн", "торчейни", "торчейнів", "торчейна", False),
    ("THETA", "тета", "тети", "тет", "тети", True),
    ("EOS", "еос", "еоси", "еосів", "еоса", False),
    ("XTZ", "тезос", "тезоси", "тезосів", "тезоса", False),
    ("FLOW", "флоу", "флоу", "флоу", "флоу", False),
    ("EGLD", "елронд", "елронди", "елрондів", "елронда", False),
    ("KCS", "кукоїн токен", "кукоїн токени", "кукоїн токенів", "кукоїн токена", False),
    ("BSV", "біткоїн ес ві", "біткоїни ес ві", "біткоїнів ес ві", "біткоїна ес ві", False),
    ("WBTC", "обгорнутий біткоїн", "обгорнуті біткоїни", "обгорнутих біткоїнів", "обгорнутого біткоїна", False),
    ("1INCH", "ванінч", "ванінчі", "ванінчів", "ванінча", False),
    ("UAH", "гривня", "гривні", "гривень", "гривні", True),
    ("USD", "долар США", "долари США", "доларів США", "долара США", False),
    ("EUR", "євро", "євро", "євро", "євро", False),
    ("GBP", "фунт стерлінгів", "фунти стерлінгів", "фунтів стерлінгів", "фунта стерлінгів", False),
]
# --- fixed values: currencies of ISO 4217: code, symbol, pattern of word forms; main unit and whether feminine; subunit and
# whether feminine; whether the symbol may trail; digits of the subunit; the earlier wins --------------------------------------
CURRENCY_ROWS = [
    ("UAH", "₴", r"грн(ив(ень|ні|ня))?", "гривня", "гривні", "гривень", True, "копійка", "копійки", "копійок", True, True, 2),
    ("USD", "$", r"долар(ів|и|а)?", "долар", "долари", "доларів", False, "цент", "центи", "центів", False, False, 2),
    ("EUR", "€", r"євро", "євро", "євро", "євро", False, "євроцент", "євроценти", "євроцентів", False, True, 2),
    ("GBP", "£", r"фунт(ів|и|а)?", "фунт", "фунти", "фунтів", False, "пенс", "пенси", "пенсів", False, False, 2),
    ("PLN", "zł", r"злот(их|і|ий)?", "злотий", "злоті", "злотих", False, "ґрош", "ґроші", "ґрошів", False, True, 2),
    ("CHF", "", r"франк(ів|и|а)?", "франк", "франки", "франків", False, "сантим", "сантими", "сантимів", False, False, 2),
    ("JPY", "¥", r"єн(и|а)?", "єна", "єни", "єн", True, "сен", "сени", "сенів", False, True, 0),
    ("CNY", "元", r"юан(ів|і|ь)?", "юань", "юані", "юанів", False, "фень", "фені", "фенів", False, True, 2),
    ("CZK", "Kč", r"", "крона", "крони", "крон", True, "гелер", "гелери", "гелерів", False, True, 2),
    ("CAD", "", r"", "канадський долар", "канадські долари", "канадських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("AUD", "", r"", "австралійський долар", "австралійські долари", "австралійських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("SEK", "", r"", "шведська крона", "шведські крони", "шведських крон", True, "ере", "ере", "ере", False, False, 2),
    ("NOK", "", r"", "норвезька крона", "норвезькі крони", "норвезьких крон", True, "ере", "ере", "ере", False, False, 2),
    ("DKK", "", r"", "данська крона", "данські крони", "данських крон", True, "ере", "ере", "ере", False, False, 2),
    ("TRY", "₺", r"лір(и|а)?", "ліра", "ліри", "лір", True, "куруш", "куруші", "курушів", False, True, 2),
    ("INR", "₹", r"руп(ія|ії|ій)", "рупія", "рупії", "рупій", True, "пайс", "пайси", "пайсів", False, True, 2),
    ("RUB", "₽", r"рубл(ів|і|ь|я)?", "рубль", "рублі", "рублів", False, "копійка", "копійки", "копійок", True, True, 2),
    ("KRW", "₩", r"вон(и|а)?", "вона", "вони", "вон", True, "чон", "чони", "чонів", False, True, 0),
    ("BRL", "R$", r"реал(ів|и|а)?", "бразильський реал", "бразильські реали", "бразильських реалів", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("ZAR", "", r"ранд(ів|и|а)?", "південноафриканський ранд", "південноафриканські ранди", "південноафриканських рандів", False, "цент", "центи", "центів", False, False, 2),
    ("NZD", "", r"", "новозеландський долар", "новозеландські долари", "новозеландських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("MXN", "", r"", "мексиканський песо", "мексиканські песо", "мексиканських песо", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("SGD", "", r"", "сінгапурський долар", "сінгапурські долари", "сінгапурських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("HKD", "", r"", "гонконзький долар", "гонконзькі долари", "гонконзьких доларів", False, "цент", "центи", "центів", False, False, 2),
    ("AFN", "؋", r"", "афгані", "афгані", "афгані", False, "пул", "пули", "пулів", False, True, 2),
    ("ALL", "", r"", "лек", "леки", "леків", False, "кіндарка", "кіндарки", "кіндарок", True, False, 2),
    ("DZD", "", r"", "алжирський динар", "алжирські динари", "алжирських динарів", False, "сантим", "сантими", "сантимів", False, False, 2),
    ("AOA", "", r"", "ангольська кванза", "ангольські кванзи", "ангольських кванз", True, "сентимо", "сентимо", "сентимо", False, False, 2),
    ("XCD", "", r"", "східнокарибський долар", "східнокарибські долари", "східнокарибських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("XAD", "", r"", "арабський розрахунковий динар", "арабські розрахункові динари", "арабських розрахункових динарів", False, "сота частина", "соті частини", "сотих частин", True, False, 2),
    ("ARS", "", r"", "аргентинське песо", "аргентинські песо", "аргентинських песо", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("AMD", "֏", r"", "вірменський драм", "вірменські драми", "вірменських драмів", False, "лума", "луми", "лумів", False, True, 2),
    ("AWG", "", r"", "арубський флорин", "арубські флорини", "арубських флоринів", False, "цент", "центи", "центів", False, False, 2),
    ("AZN", "₼", r"", "азербайджанський манат", "азербайджанські манати", "азербайджанських манатів", False, "гяпік", "гяпіки", "гяпіків", False, True, 2),
    ("BSD", "", r"", "багамський долар", "багамські долари", "багамських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("BHD", "", r"", "бахрейнський динар", "бахрейнські динари", "бахрейнських динарів", False, "філс", "філси", "філсів", False, False, 3),
    ("BDT", "৳", r"", "така", "таки", "так", True, "пайса", "пайси", "пайс", True, True, 2),
    ("BBD", "", r"", "барбадоський долар", "барбадоські долари", "барбадоських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("BYN", "", r"", "білоруський рубль", "білоруські рублі", "білоруських рублів", False, "копійка", "копійки", "копійок", True, False, 2),
    ("BZD", "", r"", "белізький долар", "белізькі долари", "белізьких доларів", False, "цент", "центи", "центів", False, False, 2),
    ("XOF", "", r"", "західноафриканський франк КФА", "західноафриканські франки КФА", "західноафриканських франків КФА", False, "сантим", "сантими", "сантимів", False, False, 0),
    ("BMD", "", r"", "бермудський долар", "бермудські долари", "бермудських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("BTN", "", r"", "бутанський нгултрум", "бутанські нгултруми", "бутанських нгултрумів", False, "четрум", "четруми", "четрумів", False, False, 2),
    ("BOB", "", r"", "болівіано", "болівіано", "болівіано", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("BOV", "", r"", "розрахунковий болівіано", "розрахункові болівіано", "розрахункових болівіано", False, "сота частина", "соті частини", "сотих частин", True, False, 2),
    ("BAM", "", r"", "конвертована марка", "конвертовані марки", "конвертованих марок", True, "фенінг", "фенінги", "фенінгів", False, False, 2),
    ("BWP", "", r"", "ботсванська пула", "ботсванські пули", "ботсванських пул", True, "тхебе", "тхебе", "тхебе", False, False, 2),
    ("BND", "", r"", "брунейський долар", "брунейські долари", "брунейських доларів", False, "сен", "сени", "сенів", False, False, 2),
    ("BIF", "", r"", "бурундійський франк", "бурундійські франки", "бурундійських франків", False, "сантим", "сантими", "сантимів", False, False, 0),
    ("CVE", "", r"", "ескудо Кабо-Верде", "ескудо Кабо-Верде", "ескудо Кабо-Верде", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("KHR", "", r"", "камбоджійський рієль", "камбоджійські рієлі", "камбоджійських рієлів", False, "сен", "сени", "сенів", False, False, 2),
    ("XAF", "", r"", "центральноафриканський франк КФА", "центральноафриканські франки КФА", "центральноафриканських франків КФА", False, "сантим", "сантими", "сантимів", False, False, 0),
    ("KYD", "", r"", "долар Кайманових Островів", "долари Кайманових Островів", "доларів Кайманових Островів", False, "цент", "центи", "центів", False, False, 2),
    ("CLP", "", r"", "чилійське песо", "чилійські песо", "чилійських песо", False, "сентаво", "сентаво", "сентаво", False, False, 0),
    ("CLF", "", r"", "чилійська розрахункова одиниця", "чилійські розрахункові одиниці", "чилійських розрахункових одиниць", True, "десятитисячна частина", "десятитисячні частини", "десятитисячних частин", True, False, 4),
    ("COP", "", r"", "колумбійське песо", "колумбійські песо", "колумбійських песо", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("COU", "", r"", "колумбійська реальна вартісна одиниця", "колумбійські реальні вартісні одиниці", "колумбійських реальних вартісних одиниць", True, "сота частина", "соті частини", "сотих частин", True, False, 2),
    ("KMF", "", r"", "коморський франк", "коморські франки", "коморських франків", False, "сантим", "сантими", "сантимів", False, False, 0),
    ("CDF", "", r"", "конголезький франк", "конголезькі франки", "конголезьких франків", False, "сантим", "сантими", "сантимів", False, False, 2),
    ("CRC", "₡", r"", "костариканський колон", "костариканські колони", "костариканських колонів", False, "сентимо", "сентимо", "сентимо", False, True, 2),
    ("CUP", "", r"", "кубинське песо", "кубинські песо", "кубинських песо", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("XCG", "", r"", "карибський гульден", "карибські гульдени", "карибських гульденів", False, "цент", "центи", "центів", False, False, 2),
    ("DJF", "", r"", "джибутійський франк", "джибутійські франки", "джибутійських франків", False, "сантим", "сантими", "сантимів", False, False, 0),
    ("DOP", "", r"", "домініканське песо", "домініканські песо", "домініканських песо", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("EGP", "", r"", "єгипетський фунт", "єгипетські фунти", "єгипетських фунтів", False, "піастр", "піастри", "піастрів", False, False, 2),
    ("SVC", "", r"", "сальвадорський колон", "сальвадорські колони", "сальвадорських колонів", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("ERN", "", r"", "еритрейська накфа", "еритрейські накфи", "еритрейських накф", True, "цент", "центи", "центів", False, False, 2),
    ("SZL", "", r"", "свазілендський лілангені", "свазілендські лілангені", "свазілендських лілангені", False, "цент", "центи", "центів", False, False, 2),
    ("ETB", "", r"", "ефіопський бир", "ефіопські бири", "ефіопських бирів", False, "сантим", "сантими", "сантимів", False, False, 2),
    ("FKP", "", r"", "фунт Фолклендських Островів", "фунти Фолклендських Островів", "фунтів Фолклендських Островів", False, "пенс", "пенси", "пенсів", False, False, 2),
    ("FJD", "", r"", "фіджійський долар", "фіджійські долари", "фіджійських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("XPF", "", r"", "французький тихоокеанський франк", "французькі тихоокеанські франки", "французьких тихоокеанських франків", False, "сантим", "сантими", "сантимів", False, False, 0),
    ("GMD", "", r"", "гамбійський даласі", "гамбійські даласі", "гамбійських даласі", False, "бутут", "бутути", "бутутів", False, False, 2),
    ("GEL", "₾", r"", "грузинський ларі", "грузинські ларі", "грузинських ларі", False, "тетрі", "тетрі", "тетрі", False, True, 2),
    ("GHS", "₵", r"", "ганський седі", "ганські седі", "ганських седі", False, "песева", "песева", "песева", False, True, 2),
    ("GIP", "", r"", "гібралтарський фунт", "гібралтарські фунти", "гібралтарських фунтів", False, "пенс", "пенси", "пенсів", False, False, 2),
    ("GTQ", "", r"", "гватемальський кетсаль", "гватемальські кетсалі", "гватемальських кетсалів", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("GNF", "", r"", "гвінейський франк", "гвінейські франки", "гвінейських франків", False, "сантим", "сантими", "сантимів", False, False, 0),
    ("GYD", "", r"", "гаянський долар", "гаянські долари", "гаянських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("HTG", "", r"", "гаїтянський гурд", "гаїтянські гурди", "гаїтянських гурдів", False, "сантим", "сантими", "сантимів", False, False, 2),
    ("HNL", "", r"", "гондураська лемпіра", "гондураські лемпіри", "гондураських лемпір", True, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("HUF", "", r"", "угорський форинт", "угорські форинти", "угорських форинтів", False, "філер", "філери", "філерів", False, False, 2),
    ("ISK", "", r"", "ісландська крона", "ісландські крони", "ісландських крон", True, "ейре", "ейре", "ейре", False, False, 0),
    ("IDR", "", r"", "індонезійська рупія", "індонезійські рупії", "індонезійських рупій", True, "сен", "сени", "сенів", False, False, 2),
    ("XDR", "", r"", "спеціальне право запозичення", "спеціальні права запозичення", "спеціальних прав запозичення", False, "частина", "частини", "частин", True, False, 0),
    ("IRR", "", r"", "іранський ріал", "іранські ріали", "іранських ріалів", False, "динар", "динари", "динарів", False, False, 2),
    ("IQD", "", r"", "іракський динар", "іракські динари", "іракських динарів", False, "філс", "філси", "філсів", False, False, 3),
    ("ILS", "₪", r"", "новий ізраїльський шекель", "нові ізраїльські шекелі", "нових ізраїльських шекелів", False, "агора", "агори", "агор", True, True, 2),
    ("JMD", "", r"", "ямайський долар", "ямайські долари", "ямайських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("JOD", "", r"", "йорданський динар", "йорданські динари", "йорданських динарів", False, "філс", "філси", "філсів", False, False, 3),
    ("KZT", "₸", r"", "казахстанський тенге", "казахстанські тенге", "казахстанських тенге", False, "тиїн", "тиїни", "тиїнів", False, True, 2),
    ("KES", "", r"", "кенійський шилінг", "кенійські шилінги", "кенійських шилінгів", False, "цент", "центи", "центів", False, False, 2),
    ("KPW", "", r"", "північнокорейська вона", "північнокорейські вони", "північнокорейських вон", True, "чон", "чони", "чонів", False, False, 2),
    ("KWD", "", r"", "кувейтський динар", "кувейтські динари", "кувейтських динарів", False, "філс", "філси", "філсів", False, False, 3),
    ("KGS", "", r"", "киргизький сом", "киргизькі соми", "киргизьких сомів", False, "тиїн", "тиїни", "тиїнів", False, False, 2),
    ("LAK", "₭", r"", "лаоський кіп", "лаоські кіпи", "лаоських кіпів", False, "ат", "ати", "атів", False, True, 2),
    ("LBP", "", r"", "ліванський фунт", "ліванські фунти", "ліванських фунтів", False, "піастр", "піастри", "піастрів", False, False, 2),
    ("LSL", "", r"", "лесотський лоті", "лесотські лоті", "лесотських лоті", False, "сенте", "сенте", "сенте", False, False, 2),
    ("LRD", "", r"", "ліберійський долар", "ліберійські долари", "ліберійських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("LYD", "", r"", "лівійський динар", "лівійські динари", "лівійських динарів", False, "дирхам", "дирхами", "дирхамів", False, False, 3),
    ("MOP", "", r"", "макаоська патака", "макаоські патаки", "макаоських патак", True, "аво", "аво", "аво", False, False, 2),
    ("MKD", "", r"", "македонський денар", "македонські денари", "македонських денарів", False, "дені", "дені", "дені", False, False, 2),
    ("MGA", "", r"", "малагасійський аріарі", "малагасійські аріарі", "малагасійських аріарі", False, "іраймбіланджа", "іраймбіланджа", "іраймбіланджа", False, False, 2),
    ("MWK", "", r"", "малавійська квача", "малавійські квачі", "малавійських квач", True, "тамбала", "тамбали", "тамбал", True, False, 2),
    ("MYR", "", r"", "малайзійський рингіт", "малайзійські рингіти", "малайзійських рингітів", False, "сен", "сени", "сенів", False, False, 2),
    ("MVR", "", r"", "мальдівська руфія", "мальдівські руфії", "мальдівських руфій", True, "ларі", "ларі", "ларі", False, False, 2),
    ("MRU", "", r"", "мавританська угія", "мавританські угії", "мавританських угій", True, "хумс", "хумси", "хумсів", False, False, 2),
    ("MUR", "", r"", "маврикійська рупія", "маврикійські рупії", "маврикійських рупій", True, "цент", "центи", "центів", False, False, 2),
    ("XUA", "", r"", "розрахункова одиниця Азійського банку розвитку", "розрахункові одиниці Азійського банку розвитку", "розрахункових одиниць Азійського банку розвитку", True, "частина", "частини", "частин", True, False, 0),
    ("MXV", "", r"", "мексиканська інвестиційна одиниця", "мексиканські інвестиційні одиниці", "мексиканських інвестиційних одиниць", True, "сота частина", "соті частини", "сотих частин", True, False, 2),
    ("MDL", "", r"", "молдовський лей", "молдовські леї", "молдовських леїв", False, "бан", "бани", "банів", False, False, 2),
    ("MNT", "₮", r"", "монгольський тугрик", "монгольські тугрики", "монгольських тугриків", False, "мунгу", "мунгу", "мунгу", False, True, 2),
    ("MAD", "", r"", "марокканський дирхам", "марокканські дирхами", "марокканських дирхамів", False, "сантим", "сантими", "сантимів", False, False, 2),
    ("MZN", "", r"", "мозамбіцький метикал", "мозамбіцькі метикали", "мозамбіцьких метикалів", False, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("MMK", "", r"", "м'янманський к'ят", "м'янманські к'яти", "м'янманських к'ятів", False, "п'я", "п'я", "п'я", False, False, 2),
    ("NAD", "", r"", "намібійський долар", "намібійські долари", "намібійських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("NPR", "", r"", "непальська рупія", "непальські рупії", "непальських рупій", True, "пайса", "пайси", "пайс", True, False, 2),
    ("NIO", "", r"", "нікарагуанська кордоба", "нікарагуанські кордоби", "нікарагуанських кордоб", True, "сентаво", "сентаво", "сентаво", False, False, 2),
    ("NGN", "₦", r"", "нігерійська найра", "нігерійські найри", "нігерійських найр", True, "кобо", "кобо", "кобо", False, True, 2),
    ("OMR", "", r"", "оманський ріал", "оманські ріали", "оманських ріалів", False, "байза", "байзи", "байз", True, False, 3),
    ("PKR", "", r"", "пакистанська рупія", "пакистанські рупії", "пакистанських рупій", True, "пайса", "пайси", "пайс", True, False, 2),
    ("PAB", "", r"", "панамський бальбоа", "панамські бальбоа", "панамських бальбоа", False, "сентесимо", "сентесимо", "сентесимо", False, False, 2),
    ("PGK", "", r"", "кіна Папуа Нової Гвінеї", "кіни Папуа Нової Гвінеї", "кін Папуа Нової Гвінеї", True, "тойя", "тойї", "той", True, False, 2),
    ("PYG", "₲", r"", "парагвайський гуарані", "парагвайські гуарані", "парагвайських гуарані", False, "сентимо", "сентимо", "сентимо", False, True, 0),
    ("PEN", "", r"", "перуанський соль", "перуанські солі", "перуанських солів", False, "сентимо", "сентимо", "сентимо", False, False, 2),
    ("PHP", "₱", r"", "філіппінське песо", "філіппінські песо", "філіппінських песо", False, "сентимо", "сентимо", "сентимо", False, True, 2),
    ("QAR", "", r"", "катарський ріал", "катарські ріали", "катарських ріалів", False, "дирхам", "дирхами", "дирхамів", False, False, 2),
    ("RON", "", r"", "румунський лей", "румунські леї", "румунських леїв", False, "бан", "бани", "банів", False, False, 2),
    ("RWF", "", r"", "руандійський франк", "руандійські франки", "руандійських франків", False, "сантим", "сантими", "сантимів", False, False, 0),
    ("SHP", "", r"", "фунт Святої Єлени", "фунти Святої Єлени", "фунтів Святої Єлени", False, "пенс", "пенси", "пенсів", False, False, 2),
    ("WST", "", r"", "самоанська тала", "самоанські тали", "самоанських тал", True, "сене", "сене", "сене", False, False, 2),
    ("STN", "", r"", "добра Сан-Томе і Принсіпі", "добри Сан-Томе і Принсіпі", "добр Сан-Томе і Принсіпі", True, "сентимо", "сентимо", "сентимо", False, False, 2),
    ("SAR", "", r"", "саудівський ріял", "саудівські ріяли", "саудівських ріялів", False, "халала", "халали", "халал", True, False, 2),
    ("RSD", "", r"", "сербський динар", "сербські динари", "сербських динарів", False, "пара", "пари", "пар", True, False, 2),
    ("SCR", "", r"", "сейшельська рупія", "сейшельські рупії", "сейшельських рупій", True, "цент", "центи", "центів", False, False, 2),
    ("SLE", "", r"", "сьєрра-леонський леоне", "сьєрра-леонські леоне", "сьєрра-леонських леоне", False, "цент", "центи", "центів", False, False, 2),
    ("XSU", "", r"", "сукре", "сукре", "сукре", False, "частина", "частини", "частин", True, False, 0),
    ("SBD", "", r"", "долар Соломонових Островів", "долари Соломонових Островів", "доларів Соломонових Островів", False, "цент", "центи", "центів", False, False, 2),
    ("SOS", "", r"", "сомалійський шилінг", "сомалійські шилінги", "сомалійських шилінгів", False, "цент", "центи", "центів", False, False, 2),
    ("SSP", "", r"", "південносуданський фунт", "південносуданські фунти", "південносуданських фунтів", False, "піастр", "піастри", "піастрів", False, False, 2),
    ("LKR", "", r"", "шрі-ланкійська рупія", "шрі-ланкійські рупії", "шрі-ланкійських рупій", True, "цент", "центи", "центів", False, False, 2),
    ("SDG", "", r"", "суданський фунт", "суданські фунти", "суданських фунтів", False, "піастр", "піастри", "піастрів", False, False, 2),
    ("SRD", "", r"", "суринамський долар", "суринамські долари", "суринамських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("CHE", "", r"", "вейр-євро", "вейр-євро", "вейр-євро", False, "сота частина", "соті частини", "сотих частин", True, False, 2),
    ("CHW", "", r"", "вейр-франк", "вейр-франки", "вейр-франків", False, "сантим", "сантими", "сантимів", False, False, 2),
    ("SYP", "", r"", "сирійський фунт", "сирійські фунти", "сирійських фунтів", False, "піастр", "піастри", "піастрів", False, False, 2),
    ("TWD", "", r"", "новий тайванський долар", "нові тайванські долари", "нових тайванських доларів", False, "цент", "центи", "центів", False, False, 2),
    ("TJS", "", r"", "таджицький сомоні", "таджицькі сомоні", "таджицьких сомоні", False, "дирам", "дирами", "дирамів", False, False, 2),
    ("TZS", "", r"", "танзанійський шилінг", "танзанійські шилінги", "танзанійських шилінгів", False, "цент", "центи", "центів", False, False, 2),
    ("THB", "฿", r"", "тайський бат", "тайські бати", "тайських батів", False, "сатанг", "сатанги", "сатангів", False, True, 2),
    ("TOP", "", r"", "тонганська паанга", "тонганські паанги", "тонганських паанг", True, "сеніті", "сеніті", "сеніті", False, False, 2),
    ("TTD", "", r"", "долар Тринідаду і Тобаго", "долари Тринідаду і Тобаго", "доларів Тринідаду і Тобаго", False, "цент", "центи", "центів", False, False, 2),
    ("TND", "", r"", "туніський динар", "туніські динари", "туніських динарів", False, "мілім", "міліми", "мілімів", False, False, 3),
    ("TMT", "", r"", "туркменський манат", "туркменські манати", "туркменських манатів", False, "тенге", "тенге", "тенге", False, False, 2),
    ("UGX", "", r"", "угандійський шилінг", "угандійські шилінги", "угандійських шилінгів", False, "цент", "центи", "центів", False, False, 0),
    ("AED", "", r"", "дирхам ОАЕ", "дирхами ОАЕ", "дирхамів ОАЕ", False, "філс", "філси", "філсів", False, False, 2),
    ("USN", "", r"", "долар США наступного дня", "долари США наступного дня", "доларів США наступного дня", False, "цент", "центи", "центів", False, False, 2),
    ("UYU", "", r"", "уругвайське песо", "уругвайські песо", "уругвайських песо", False, "сентесимо", "сентесимо", "сентесимо", False, False, 2),
    ("UYI", "", r"", "уругвайське песо в індексованих одиницях", "уругвайські песо в індексованих одиницях", "уругвайських песо в індексованих одиницях", False, "частина", "частини", "частин", True, False, 0),
    ("UYW", "", r"", "уругвайська прогнозна одиниця", "уругвайські прогнозні одиниці", "уругвайських прогнозних одиниць", True, "десятитисячна частина", "десятитисячні частини", "десятитисячних частин", True, False, 4),
    ("UZS", "", r"", "узбецький сум", "узбецькі суми", "узбецьких сумів", False, "тіїн", "тіїни", "тіїнів", False, False, 2),
    ("VUV", "", r"", "вануатський вату", "вануатські вату", "вануатських вату", False, "частина", "частини", "частин", True, False, 0),
    ("VES", "", r"", "венесуельський болівар", "венесуельські болівари", "венесуельських боліварів", False, "сентимо", "сентимо", "сентимо", False, False, 2),
    ("VED", "", r"", "цифровий венесуельський болівар", "цифрові венесуельські болівари", "цифрових венесуельських боліварів", False, "сентимо", "сентимо", "сентимо", False, False, 2),
    ("VND", "₫", r"", "в'єтнамський донг", "в'єтнамські донги", "в'єтнамських донгів", False, "хао", "хао", "хао", False, True, 0),
    ("YER", "", r"", "єменський ріал", "єменські ріали", "єменських ріалів", False, "філс", "філси", "філсів", False, False, 2),
    ("ZMW", "", r"", "замбійська квача", "замбійські квачі", "замбійських квач", True, "нгве", "нгве", "нгве", False, False, 2),
    ("ZWG", "", r"", "одиниця зімбабвійського золота", "одиниці зімбабвійського золота", "одиниць зімбабвійського золота", True, "цент", "центи", "центів", False, False, 2),
    ("XBA", "", r"", "європейська комбінована одиниця", "європейські комбіновані одиниці", "європейських комбінованих одиниць", True, "частина", "частини", "частин", True, False, 0),
    ("XBB", "", r"", "європейська валютна одиниця", "європейські валютні одиниці", "європейських валютних одиниць", True, "частина", "частини", "частин", True, False, 0),
    ("XBC", "", r"", "європейська розрахункова одиниця дев'ять", "європейські розрахункові одиниці дев'ять", "європейських розрахункових одиниць дев'ять", True, "частина", "частини", "частин", True, False, 0),
    ("XBD", "", r"", "європейська розрахункова одиниця сімнадцять", "європейські розрахункові одиниці сімнадцять", "європейських розрахункових одиниць сімнадцять", True, "частина", "частини", "частин", True, False, 0),
    ("XTS", "", r"", "тестова валютна одиниця", "тестові валютні одиниці", "тестових валютних одиниць", True, "частина", "частини", "частин", True, False, 0),
    ("XXX", "", r"", "одиниця без валюти", "одиниці без валюти", "одиниць без валюти", True, "частина", "частини", "частин", True, False, 0),
    ("XAU", "", r"", "тройська унція золота", "тройські унції золота", "тройських унцій золота", True, "частина", "частини", "частин", True, False, 0),
    ("XPD", "", r"", "тройська унція паладію", "тройські унції паладію", "тройських унцій паладію", True, "частина", "частини", "частин", True, False, 0),
    ("XPT", "", r"", "тройська унція платини", "тройські унції платини", "тройських унцій платини", True, "частина", "частини", "частин", True, False, 0),
    ("XAG", "", r"", "тройська унція срібла", "тройські унції срібла", "тройських унцій срібла", True, "частина", "частини", "частин", True, False, 0),
]
# --- fixed values: abbreviations, in the order in which they are tried ----------------------------------------------------
ABBREVIATIONS = {
    "див. також": "дивись також", "до н. е.": "до нашої ери", "і т. д.": "і так далі", "і т. ін.": "і таке інше", "пн. ш.": "північної широти",
    "пд. ш.": "південної широти", "сх. д.": "східної довготи", "зх. д.": "західної довготи", "грн.": "гривень", "коп.": "копійок", "н. е.": "нашої ери", "т. б.": "тобто",
    "рр.": "роки", "р-н": "район", "б/в": "був у використанні", "та ін.": "та інші", "див.": "дивись", "напр.": "наприклад", "прибл.": "приблизно", "проф.": "професор",
    "доц.": "доцент", "ім.": "імені", "вул.": "вулиця", "просп.": "проспект", "пров.": "провулок", "буд.": "будинок", "тел.": "телефон", "табл.": "таблиця",
    "і т. п.": "і тому подібне", "у т. ч.": "у тому числі", "зокр.": "зокрема", "д-р": "доктор", "інж.": "інженер", "канд.": "кандидат",
}
# --- fixed values: acronyms that are read in full -------------------------------------------------------------------------
ACRONYMS = {
    "ПДВ": "податок на додану вартість", "ЄДРПОУ": "єдиний державний реєстр підприємств та організацій України", "ФОП": "фізична особа підприємець",
    "ТОВ": "товариство з обмеженою відповідальністю", "АТ": "акціонерне товариство", "ОСББ": "об'єднання співвласників багатоквартирного будинку",
    "ЗСУ": "збройні сили України", "СБУ": "служба безпеки України", "МВС": "міністерство внутрішніх справ", "ДСНС": "державна служба України з надзвичайних ситуацій",
    "НПУ": "національна поліція України", "ДБР": "державне бюро розслідувань", "НАБУ": "національне антикорупційне бюро України",
    "САП": "спеціалізована антикорупційна прокуратура", "НАЗК": "національне агентство з питань запобігання корупції", "НБУ": "національний банк України",
    "КМУ": "кабінет міністрів України", "ВРУ": "верховна рада України", "ЦВК": "центральна виборча комісія", "МОН": "міністерство освіти і науки України",
    "МОЗ": "міністерство охорони здоров'я України", "ДПС": "державна податкова служба України", "ЄС": "європейський союз", "УЗ": "українська залізниця",
    "ОВА": "обласна військова адміністрація", "РДА": "районна державна адміністрація", "ШІ": "штучний інтелект", "ІТ": "інформаційні технології",
    "ПЗ": "програмне забезпечення", "ООН": "організація об'єднаних націй", "НАТО": "організація північноатлантичного договору",
    "ВООЗ": "всесвітня організація охорони здоров'я", "МВФ": "міжнародний валютний фонд", "ДНК": "дезоксирибонуклеїнова кислота", "РНК": "рибонуклеїнова кислота",
    "ВПО": "внутрішньо переміщена особа", "ЦНАП": "центр надання адміністративних послуг", "ЗВО": "заклад вищої освіти", "НСЗУ": "національна служба здоров'я України",
    "ПФУ": "пенсійний фонд України", "ЄСПЛ": "європейський суд з прав людини", "ЮНЕСКО": "організація об'єднаних націй з питань освіти, науки і культури",
    "НАНУ": "національна академія наук України", "МАГАТЕ": "міжнародне агентство з атомної енергії",
}
# --- fixed values: Latin names and their readings -------------------------------------------------------------------------
BRANDS = {
    "google": "гугл", "python": "пайтон", "ios": "айос", "iphone": "айфон", "windows": "віндовс", "microsoft": "майкрософт", "apple": "епл", "facebook": "фейсбук",
    "youtube": "ютуб", "twitter": "твітер", "instagram": "інстаграм", "telegram": "телеграм", "whatsapp": "вотсап", "skype": "скайп", "android": "андроїд",
    "samsung": "самсунг", "linux": "лінукс", "internet": "інтернет", "online": "онлайн", "email": "імейл", "ok": "окей", "openai": "опеней", "chatgpt": "чатджипіті",
    "github": "гітхаб", "gitlab": "гітлаб", "macbook": "макбук", "ipad": "айпад", "airpods": "еірподс", "gmail": "джимейл", "zoom": "зум", "slack": "слак",
    "docker": "докер", "kubernetes": "кубернетіс", "react": "ріакт", "node": "ноуд", "javascript": "джаваскрипт", "typescript": "тайпскрипт", "adobe": "адобі",
    "amazon": "амазон", "netflix": "нетфлікс", "spotify": "спотіфай", "tiktok": "тікток", "linkedin": "лінкедін", "reddit": "реддіт", "wikipedia": "вікіпедія",
    "firefox": "фаєрфокс", "chrome": "хром", "chromium": "хроміум", "safari": "сафарі", "opera": "опера", "discord": "діскорд", "steam": "стім",
    "playstation": "плейстейшн", "xbox": "іксбокс", "nintendo": "нінтендо", "intel": "інтел", "tesla": "тесла", "oracle": "оракл", "dropbox": "дропбокс",
    "viber": "вайбер", "pinterest": "пінтерест", "snapchat": "снепчат", "messenger": "месенджер", "outlook": "аутлук", "yahoo": "яху", "bing": "бінг", "twitch": "твіч",
    "mastodon": "мастодон", "notion": "ноушн", "figma": "фігма", "canva": "канва", "trello": "трелло", "jira": "джира", "bitbucket": "бітбакет", "wordpress": "вордпрес",
    "django": "джанго", "angular": "ангуляр", "firebase": "файрбейс", "paypal": "пейпал", "uber": "убер", "glovo": "глово", "ikea": "ікеа", "lego": "лего",
    "disney": "дісней", "nike": "найк", "adidas": "адідас", "lenovo": "леново", "asus": "асус", "dell": "делл", "rozetka": "розетка", "privatbank": "приватбанк",
    "monobank": "монобанк", "diia": "дія", "ukrposhta": "укрпошта", "kyivstar": "київстар", "lifecell": "лайфселл", "vodafone": "водафон", "comfy": "комфі",
    "foxtrot": "фокстрот", "epicentr": "епіцентр", "silpo": "сільпо",
}
# --- fixed values: English words and their readings -----------------------------------------------------------------------
ENGLISH = {
    "python": "пайтон", "java": "джава", "javascript": "джаваскрипт", "typescript": "тайпскрипт", "docker": "докер", "kubernetes": "кубернетіс", "linux": "лінукс",
    "windows": "віндовс", "macos": "макос", "google": "гугл", "shop": "шоп", "server": "сервер", "client": "клієнт", "cloud": "клауд", "api": "ей пі ай", "web": "веб",
    "online": "онлайн", "offline": "офлайн", "browser": "браузер", "plugin": "плагін", "chat": "чат", "bot": "бот", "code": "код", "file": "файл", "script": "скрипт",
    "test": "тест", "build": "білд", "release": "реліз", "update": "апдейт", "backup": "бекап", "cache": "кеш", "database": "дейтабейс", "frontend": "фронтенд",
    "backend": "бекенд", "framework": "фреймворк", "download": "даунлоуд", "upload": "аплоуд", "account": "акаунт", "login": "логін", "token": "токен",
    "mobile": "мобайл", "desktop": "десктоп", "message": "меседж", "feature": "фіча", "bug": "баг", "link": "лінк", "click": "клік", "compiler": "компайлер",
    "runtime": "рантайм", "thread": "тред", "stack": "стек", "heap": "хіп", "index": "індекс", "data": "дейта", "dataset": "дейтасет", "model": "модель",
    "prompt": "промпт", "query": "квері", "user": "юзер", "admin": "адмін", "website": "вебсайт", "network": "нетворк", "privacy": "прайвесі", "audio": "аудіо",
    "video": "відео", "error": "ерор", "debug": "дебаг", "deploy": "деплой", "install": "інстал", "library": "лайбрарі", "array": "ерей", "string": "стрінг",
    "object": "об'єкт", "method": "метод", "process": "процес", "task": "таск", "job": "джоб", "input": "інпут", "output": "аутпут", "status": "статус",
    "config": "конфіг", "terminal": "термінал", "console": "консоль", "driver": "драйвер", "router": "роутер", "switch": "світч", "socket": "сокет", "kernel": "кернел",
    "memory": "меморі", "storage": "сторидж", "device": "девайс", "screen": "скрін", "display": "дисплей", "monitor": "монітор", "printer": "принтер",
    "scanner": "сканер",
}


#: Spelling -> unit; noun in any of its counted forms -> forms; oblique plural -> its case; code -> finance unit.
UNIT = {key: Unit(*forms) for keys, *forms in UNITS for key in keys}
COUNTED_NOUN = {key: Unit(one, few, many, "", gender) for one, few, many, _, _, gender in COUNTED for key in (one, few, many)}
COUNTED_CASE = {key: case for *_, instr, prep, _ in COUNTED for key, case in ((instr, "instr"), (prep, "prep"))}
FINANCE_UNIT = {code: Unit(one, few, many, decimal, "f" if feminine else "m") for code, one, few, many, decimal, feminine in FINANCE}
CURRENCIES = [Currency(r[0], r[1], r[2], Unit(*r[3:6], "", "f" if r[6] else "m"), Unit(*r[7:10], "", "f" if r[10] else "m"), r[11], r[12]) for r in CURRENCY_ROWS]
CURRENCY = {c.code: c for c in CURRENCIES}
#: A brand wins over a word.
LATIN_WORDS = ENGLISH | BRANDS
