"""Fixed values of the language that right results depend on, and tables made from them by rule."""

# --- fixed values: cardinal words -------------------------------------------------------------------------------
ONES = ["", "один", "два", "три", "чотири", "п'ять", "шість", "сім", "вісім", "дев'ять"]
TEENS = ["десять", "одинадцять", "дванадцять", "тринадцять", "чотирнадцять", "п'ятнадцять", "шістнадцять", "сімнадцять", "вісімнадцять", "дев'ятнадцять"]
TENS = ["", "десять", "двадцять", "тридцять", "сорок", "п'ятдесят", "шістдесят", "сімдесят", "вісімдесят", "дев'яносто"]
HUNDREDS = ["", "сто", "двісті", "триста", "чотириста", "п'ятсот", "шістсот", "сімсот", "вісімсот", "дев'ятсот"]
ZERO = "нуль"
SCALES = {
    10**15: ("квадрильйон", "квадрильйони", "квадрильйонів"),
    10**12: ("трильйон", "трильйони", "трильйонів"),
    10**9: ("мільярд", "мільярди", "мільярдів"),
    10**6: ("мільйон", "мільйони", "мільйонів"),
    10**3: ("тисяча", "тисячі", "тисяч"),
}
MAX_SPELLED_NUMBER = 999_999_999_999_999_999
# --- fixed values: ordinal stems of cardinal words ---------------------------------------------------------------
ORDINAL_STEMS = {
    "нуль": "нульовий", "один": "перший", "одна": "перший", "два": "другий", "дві": "другий", "три": "третій", "чотири": "четвертий", "п'ять": "п'ятий", "шість": "шостий", "сім": "сьомий",
    "вісім": "восьмий", "дев'ять": "дев'ятий", "десять": "десятий", "одинадцять": "одинадцятий", "дванадцять": "дванадцятий", "тринадцять": "тринадцятий", "чотирнадцять": "чотирнадцятий",
    "п'ятнадцять": "п'ятнадцятий", "шістнадцять": "шістнадцятий", "сімнадцять": "сімнадцятий", "вісімнадцять": "вісімнадцятий", "дев'ятнадцять": "дев'ятнадцятий", "двадцять": "двадцятий",
    "тридцять": "тридцятий", "сорок": "сороковий", "п'ятдесят": "п'ятдесятий", "шістдесят": "шістдесятий", "сімдесят": "сімдесятий", "вісімдесят": "вісімдесятий", "дев'яносто": "дев'яностий",
    "сто": "сотий", "двісті": "двохсотий", "триста": "трьохсотий", "чотириста": "чотирьохсотий", "п'ятсот": "п'ятисотий", "шістсот": "шестисотий", "сімсот": "семисотий", "вісімсот": "восьмисотий",
    "дев'ятсот": "дев'ятисотий", "тисяча": "тисячний", "тисячі": "тисячний", "тисяч": "тисячний",
}
ROUND_THOUSANDS = {2: "двох", 3: "трьох", 4: "чотирьох", 5: "п'яти", 6: "шести", 7: "семи", 8: "восьми", 9: "дев'яти"}
HARD_ENDINGS = {"nom_n": "е", "nom_f": "а", "nom_pl": "і", "gen": "ого", "dat": "ому", "prep": "ому", "loc": "ому", "pl": "их", "loc_pl": "их", "acc_f": "у", "gen_f": "ої", "ins": "им", "ins_f": "ою", "ins_pl": "ими", "loc_f": "ій"}
SOFT_ENDINGS = {"nom_n": "є", "nom_f": "я", "gen": "ього", "dat": "ьому", "prep": "ьому", "loc": "ьому", "pl": "іх", "loc_pl": "іх", "acc_f": "ю", "gen_f": "ьої", "ins": "ім", "ins_f": "ьою", "ins_pl": "іми"}
# --- fixed values: genitive, dative, instrumental, prepositional of words whose forms no rule below gives ---------
CASES = ("gen", "dat", "instr", "prep")
IRREGULAR_CASES = {
    "нуль": ("нуля", "нулю", "нулем", "нулі"), "один": ("одного", "одному", "одним", "одному"), "одна": ("однієї", "одній", "однією", "одній"),
    "два": ("двох", "двом", "двома", "двох"), "дві": ("двох", "двом", "двома", "двох"), "три": ("трьох", "трьом", "трьома", "трьох"), "чотири": ("чотирьох", "чотирьом", "чотирма", "чотирьох"),
    "шість": ("шести", "шести", "шістьма", "шести"), "сім": ("семи", "семи", "сьома", "семи"), "вісім": ("восьми", "восьми", "вісьмома", "восьми"),
    "сорок": ("сорока",) * 4, "дев'яносто": ("дев'яноста",) * 4, "сто": ("ста",) * 4,
    "двісті": ("двохсот", "двомстам", "двомастами", "двохстах"), "триста": ("трьохсот", "трьомстам", "трьомастами", "трьохстах"), "чотириста": ("чотирьохсот", "чотирьомстам", "чотирмастами", "чотирьохстах"),
    "п'ятсот": ("п'ятисот", "п'ятистам", "п'ятьмастами", "п'ятистах"), "шістсот": ("шестисот", "шестистам", "шістьмастами", "шестистах"), "сімсот": ("семисот", "семистам", "сьомастами", "семистах"),
    "вісімсот": ("восьмисот", "восьмистам", "вісьмомастами", "восьмистах"), "дев'ятсот": ("дев'ятисот", "дев'ятистам", "дев'ятьмастами", "дев'ятистах"), "тисяча": ("тисячі", "тисячі", "тисячею", "тисячі"),
}
# --- fixed values: names of decimal places, singular and plural, nominative --------------------------------------
PLACES = [("десята", "десятих"), ("сота", "сотих"), ("тисячна", "тисячних"), ("десятитисячна", "десятитисячних"), ("стотисячна", "стотисячних"), ("мільйонна", "мільйонних")]
# --- fixed values: letter names and Latin sequences ---------------------------------------------------------------
LETTER_NAMES = dict(zip("АБВГҐДЕЄЖЗИІЇЙКЛМНОПРСТУФХЦЧШЩЬЮЯ", "а|бе|ве|ге|ґе|де|е|є|же|зе|и|і|ї|йот|ка|ел|ем|ен|о|пе|ер|ес|те|у|еф|ха|це|че|ша|ща|м'який знак|ю|я".split("|"), strict=True))
LATIN_LETTER_NAMES = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ей|бі|сі|ді|і|еф|джі|ейч|ай|джей|кей|ел|ем|ен|оу|пі|к'ю|ар|ес|ті|ю|ві|дабл ю|екс|вай|зед".split("|"), strict=True))
LATIN = {
    "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "г", "i": "і", "j": "дж", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т",
    "u": "у", "v": "в", "w": "в", "x": "кс", "y": "и", "z": "з", "sh": "ш", "ch": "ч", "zh": "ж", "kh": "х", "ts": "ц", "yu": "ю", "ya": "я", "ye": "є", "yi": "ї", "oo": "у", "ee": "і", "sch": "щ",
}
#: Sequences in an order in which each can be replaced in turn: of overlapping ones that which begins first, then the longer one.
LATIN_SEQUENCES = ("ts", "sch", "sh", "ch", "zh", "kh", "ye", "yu", "ya", "yi", "oo", "ee")
DIACRITICS = {
    "á": "а", "à": "а", "â": "а", "ã": "а", "å": "а", "ā": "а", "ă": "а", "ą": "а", "Á": "а", "À": "а", "Â": "а", "Ã": "а", "Å": "а", "Ā": "а", "Ă": "а", "Ą": "а",
    "ä": "е", "Ä": "е", "é": "е", "è": "е", "ê": "е", "ë": "е", "ē": "е", "ė": "е", "ę": "е", "É": "е", "È": "е", "Ê": "е", "Ë": "е", "Ē": "е", "Ė": "е", "Ę": "е",
    "í": "і", "ì": "і", "î": "і", "ï": "і", "ī": "і", "Í": "і", "Ì": "і", "Î": "і", "Ï": "і", "Ī": "і", "ó": "о", "ò": "о", "ô": "о", "õ": "о", "ö": "о", "ō": "о",
    "Ó": "о", "Ò": "о", "Ô": "о", "Õ": "о", "Ö": "о", "Ō": "о", "ú": "у", "ù": "у", "û": "у", "ū": "у", "Ú": "у", "Ù": "у", "Û": "у", "Ū": "у", "ü": "ю", "Ü": "ю",
    "ç": "с", "Ç": "с", "ñ": "нь", "Ñ": "нь", "ß": "сс", "ł": "л", "Ł": "л", "ý": "и", "ÿ": "и", "Ý": "и", "Ÿ": "и",
}
# --- fixed values: lengths of IBANs by country, and of digests by algorithm ---------------------------------------
IBAN_LENGTHS = {
    "AL": 28, "AD": 24, "AT": 20, "AZ": 28, "BH": 22, "BE": 16, "BA": 20, "BR": 29, "BG": 22, "CR": 22, "HR": 21, "CY": 28, "CZ": 24, "DK": 18,
    "DO": 28, "EE": 20, "FO": 18, "FI": 18, "FR": 27, "GE": 22, "DE": 22, "GI": 23, "GR": 27, "GL": 18, "GT": 28, "HU": 28, "IS": 26, "IE": 22,
    "IL": 23, "IT": 27, "JO": 30, "KZ": 20, "XK": 20, "KW": 30, "LV": 21, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "MT": 31, "MR": 27, "MU": 30,
    "MC": 27, "MD": 24, "ME": 22, "NL": 18, "MK": 19, "NO": 15, "PK": 24, "PS": 29, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "LC": 32, "SM": 27,
    "ST": 25, "SA": 24, "RS": 22, "SC": 31, "SK": 24, "SI": 19, "ES": 24, "SE": 24, "CH": 21, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "AE": 23,
    "GB": 22, "VA": 22, "VG": 24,
}
HASH_LENGTHS = {"MD5": 32, "SHA1": 40, "SHA224": 56, "SHA256": 64, "SHA384": 96, "SHA512": 128, "SHA3256": 64, "SHA3512": 128, "BLAKE2S": 64, "BLAKE2B": 128}


def below_thousand(n: int) -> str:
    tail = [TEENS[n % 100 - 10]] if 10 <= n % 100 <= 19 else [TENS[n % 100 // 10], ONES[n % 10]]
    return " ".join(x for x in [HUNDREDS[n // 100], *tail] if x)


def agreed(words: str, gender: str) -> str:
    """The last word in the gender m, f or n."""
    head, _, last = words.rpartition(" ")
    last = {"f": {"один": "одна", "два": "дві"}, "n": {"один": "одне"}}.get(gender, {}).get(last, last)
    return f"{head} {last}".strip()


def inflected(stem: str, form: str) -> str:
    """An ordinal in a form; nom_m and unknown forms leave it as it is. The soft stem takes hard endings it lacks."""
    if form not in HARD_ENDINGS:
        return stem
    if stem.endswith("ій"):
        return stem[:-2] + SOFT_ENDINGS.get(form, HARD_ENDINGS[form])
    return stem.removesuffix("ий") + HARD_ENDINGS[form]


def case_forms() -> dict[str, tuple[str, str, str, str]]:
    """Case forms of all cardinal words that inflect: those listed, and those in -ть, -десят and -н or -рд by rule."""
    out = dict(IRREGULAR_CASES)
    for w in [*ONES, *TEENS, *TENS]:
        if w and w not in out:
            base = w.removesuffix("ь") if w.endswith("ть") else w  # п'ять -> п'яти, п'ятьма; п'ятдесят -> п'ятдесяти, п'ятдесятьма
            out[w] = (base + "и", base + "и", base + "ьма", base + "и")
    plural = tuple("тисяч" + x for x in ("", "ам", "ами", "ах"))
    out |= {"тисячі": plural, "тисяч": plural}
    for one in ("мільйон", "мільярд"):
        out[one] = tuple(one + x for x in ("а", "у", "ом", "і"))
        out[one + "и"] = out[one + "ів"] = tuple(one + x for x in ("ів", "ам", "ами", "ах"))
    return out
