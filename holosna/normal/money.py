"""Passes on money, tickers, market pairs and acronyms that are read in full."""

from __future__ import annotations

import regex

from holosna.normal import rx
from holosna.normal import lexicon as L
from holosna.normal import words as W
from holosna.normal.lexicon import Currency, Unit
from holosna.normal.rules import CODE, CURRENCY, LETTERS, MULTIPLIER, NO_CYRILLIC, NO_LETTER, Around, Match, Step, any_of, has, passes, rule

# --- fixed values: patterns of amounts and tickers; dollars and yen by country; words that tell of money ---------------------
AMOUNT = r"([+-]?(?:[1-9]\d{0,2}(?:,\d{3})+(?:\.\d{1,4})?|[1-9]\d{0,2}(?:\.\d{3})+(?:,\d{1,4})?|\d+[.,]\d{1,4}|\d+|[.,]\d{1,4})(?!\d|[.,]\d))"
RAW_AMOUNT = r"(?:\d{1,3}(?:[ ,.\u00a0]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
TICKER = r"(?![0-9]{2,10}\b)[A-Z0-9]{2,10}"
REGIONAL = {"us$": "USD", "ca$": "CAD", "au$": "AUD", "nz$": "NZD", "hk$": "HKD", "sg$": "SGD", "jp¥": "JPY", "cn¥": "CNY", "r$": "BRL"}
TELLING = ["грн", "долар", "євро", "фунт", "злот", "франк", "єн", "юан", "крон", "лір", "руп", "рубл", "вон", "реал", "ранд"]
# --------------------------------------------------------------------------------------------------------------------------------

_SYMBOLS = [c.symbol for c in L.CURRENCIES if c.symbol]
_CODES = [W.lower(c.code) for c in L.CURRENCIES]
_TICKERS = {W.lower(code) for code in L.FINANCE_UNIT}


def may_have_money(text: str) -> bool:
    low = W.lower(text)
    return has(text, *_SYMBOLS) or has(low, *TELLING) or has(low, *_CODES)


def may_have_tickers(text: str) -> bool:
    return "₿" in text or not _TICKERS.isdisjoint(rx.findall("[0-9a-z_]+", W.lower(text)))


_FIRST = f"[{''.join(sorted({k[0] for k in L.ACRONYMS}))}]"


def acronyms(text: str) -> str:
    """Known acronyms in full, capital at the start of a sentence."""
    return _acronyms(text) if rx.search(_FIRST, text) else text


@rule(rf"(^|[^{LETTERS}])((?:{any_of(L.ACRONYMS)}){NO_CYRILLIC})")
def _acronyms(m: Match, around: Around) -> str:
    before = (around.before + m[1]).rstrip()
    full = L.ACRONYMS[m[2]]
    return m[1] + (W.capitalised(full) if not before or before[-1] in ".!?" else full)


_MANY = {"грн": "гривень"}
for _c in L.CURRENCIES:
    for _key in (_c.code, _c.symbol):
        _MANY.setdefault(_key, _c.main.many)


@rule(rf"({CURRENCY})\s*(\d+(?:[.,]\d+)?)\s*({MULTIPLIER})")
def _sign_before_multiplier(m: Match) -> str:
    return f"{m[2]} {m[3]} {_MANY[m[1]]}"


@rule(rf"(\d+(?:[.,]\d+)?)\s*({MULTIPLIER})\s*({CURRENCY})")
def _sign_after_multiplier(m: Match) -> str:
    return f"{m[1]} {m[2]} {_MANY[m[3]]}"


multiplied = passes(_sign_before_multiplier, _sign_after_multiplier)


@rule(r"(US\$|CA\$|AU\$|NZ\$|HK\$|SG\$|JP¥|CN¥|R\$)", fold=True)
def regional(m: Match) -> str:
    return REGIONAL[W.lower(m[0])]


def _halves(amount: str, digits: int) -> tuple[str, str | None] | None:
    """Whole part and decimals of a written amount, for a subunit of so many digits; None if the marks make no sense."""
    marks = rx.findall("[.,]", amount)
    if len(set(marks)) == 2:  # the later mark is the decimal one
        amount = amount.replace(({".", ","} - {marks[-1]}).pop(), "")
    elif len(marks) > 1:
        tail = len(amount) - amount.rfind(marks[0]) - 1
        if tail > digits and tail != 3:
            return None
        whole, _, last = amount.rpartition(marks[0])
        amount = whole.replace(marks[0], "") + (marks[0] + last if tail == digits else last)
    elif marks:
        whole, _, tail = amount.partition(marks[0])
        if 1 <= len(whole) <= 3 and whole[0] != "0" and len(tail) == 3 and digits != 3:  # a group of thousands
            amount = whole + tail
    parts = rx.split("[.,]", amount, maxsplit=1)
    return parts[0], parts[1] if len(parts) == 2 else None


def amount_words(raw: str, money: Currency) -> str | None:
    raw = raw.replace(" ", "")
    sign, rest = W.sign_of(raw) if raw[:1] in ("+", "-") else ("", raw)
    halves = _halves(rest, money.digits)
    if halves is None:
        return None
    main, part = halves
    n = W.whole(main or "0")
    if n is None:
        return None
    if part is not None and not money.digits:  # no subunit: a fraction of the whole
        words = W.decimal(main or "0", part)
        return words and f"{sign}{words} {money.main.many}"
    if part is not None and len(part) > money.digits:
        return None
    subunits = W.whole((part or "").ljust(money.digits, "0")) or 0
    return f"{sign}{W.counted(n, money.main)}" + (f" {W.counted(subunits, money.sub)}" if subunits else "")


def _in_number(before: str) -> bool:
    return bool(rx.search(r"[0-9.,]\Z", before))


def _amounts_of(money: Currency) -> list[tuple[list[str], Step]]:
    """Steps for the ways to write amounts of a currency, each with literals of which a text needs one."""

    def read(m: Match, around: Around) -> str | None:
        return None if _in_number(around.before) else amount_words(m[1], money)

    symbol, out = regex.escape(money.symbol), []
    stem = rx.match("[^(|?\\[]*", money.word)[0].removesuffix("?")
    if money.word:
        either = rf"|{symbol}" if symbol else ""
        out.append(([x for x in (stem, money.symbol) if x], rule(rf"{AMOUNT}\s*({money.word}(?![а-яіїєґ]){either})", fold=True)(read)))
    elif symbol:
        out.append(([money.symbol], rule(rf"{AMOUNT}\s*(?:{symbol})")(read)))
    if symbol:
        out.append(([money.symbol], rule(rf"{symbol}\s*{AMOUNT}")(read)))
        if money.trailing:
            out.append(([money.symbol], rule(rf"(\d+)\s*{symbol}")(read)))
    return out


_AMOUNTS = [step for c in L.CURRENCIES for step in _amounts_of(c)]


@rule(rf"([+-])\s*({CURRENCY})\s*(?=\d)", fold=True)
def _sign_first(m: Match) -> str:
    return m[2] + m[1]


@rule(rf"\(({CURRENCY})\s*(\d+(?:[.,]\d{{1,4}})?)\)", fold=True)
def _bracketed(m: Match) -> str:
    return f"-{m[2]} {m[1]}"


@rule(rf"\((\d+(?:[.,]\d{{1,4}})?)\s*({CURRENCY})\)", fold=True)
def _bracketed_after(m: Match) -> str:
    return f"-{m[1]} {m[2]}"


@rule(rf"{AMOUNT}\s*({CODE}){NO_LETTER}", fold=True)
def _code_after(m: Match, around: Around) -> str | None:
    return None if _in_number(around.before) else amount_words(m[1], L.CURRENCY[m[2].upper()])


@rule(rf"({CODE})\s*{AMOUNT}{NO_LETTER}", fold=True)
def _code_before(m: Match) -> str | None:
    return amount_words(m[2], L.CURRENCY[m[1].upper()])


def _by_words(text: str) -> str:
    for literals, step in _AMOUNTS:
        if any(x in text for x in literals):
            text = step(text)
    return text


currency = passes(regional, _sign_first, _bracketed, _bracketed_after, _by_words, _code_after, _code_before)


def ticker_words(ticker: str) -> str:
    code = ticker.upper()
    if code in L.FINANCE_UNIT:
        return L.FINANCE_UNIT[code].many
    if code in L.CURRENCY:
        return L.CURRENCY[code].main.many
    return " ".join(W.cardinal(int(c)) if c.isdigit() else W.letters(c) for c in code)


def _canonical(raw: str) -> str | None:
    """An amount with a point at most, groups joined; None where groups aren't of three."""
    amount = rx.sub(r"[ \u00a0]", "", raw)
    marks = rx.findall("[.,]", amount)
    if len(set(marks)) == 2:
        amount = amount.replace(({".", ","} - {marks[-1]}).pop(), "")
        if marks[-1] == ",":
            amount = amount[::-1].replace(",", ".", 1)[::-1]
    elif marks:
        groups = amount.split(marks[0])
        grouped = all(len(g) == 3 for g in groups[1:]) and (len(marks) > 1 or groups[0] != "0")
        if not grouped and len(marks) > 1:
            return None
        amount = "".join(groups) if grouped else ".".join(groups)
    return amount if W.whole(amount.split(".")[0]) is not None else None


def _ticker_amount(raw: str, ticker: str, sign: str) -> str | None:
    code, amount = ticker.upper(), _canonical(raw)
    if code in L.CURRENCY or amount is None:
        return None
    unit = L.FINANCE_UNIT.get(code) or Unit(*[ticker_words(code)] * 4)
    return W.sign_of(sign)[0] + W.finance_amount(amount, unit)


def _after(ticker: str, fold: bool) -> Step:
    @rule(rf"(^|[^\w{LETTERS}])([+-]?)({RAW_AMOUNT})\s*({ticker})\b", fold)
    def step(m: Match) -> str | None:
        words = _ticker_amount(m[3], m[4], m[2])
        return words and m[1] + words

    return step


@rule(rf"₿\s*([+-]?)({RAW_AMOUNT})")
def _bitcoin_before(m: Match) -> str:
    return f"{m[1]}{m[2]} BTC"


@rule(rf"([+-]?)({RAW_AMOUNT})\s*₿")
def _bitcoin_after(m: Match) -> str:
    return f"{m[1]}{m[2]} BTC"


_RECOGNISED = any_of([*L.FINANCE_UNIT, *L.CURRENCY])


@rule(rf"\b({_RECOGNISED})/({_RECOGNISED})\b", fold=True)
def _known_pair(m: Match) -> str:
    return f"{ticker_words(m[1])} до {ticker_words(m[2])}"


@rule(rf"\b({any_of(L.FINANCE_UNIT)})\s*([+-]?)({RAW_AMOUNT})(?![\w.,])", fold=True)
def _ticker_before(m: Match) -> str | None:
    return _ticker_amount(m[3], m[1], m[2])


known_finance = passes(_bitcoin_before, _bitcoin_after, _known_pair, _after(any_of(L.FINANCE_UNIT), True), _ticker_before)


@rule(rf"\b({TICKER})/({TICKER})\b")
def _pair(m: Match) -> str:
    """Of two tokens, one that the lexicon knows makes a market pair; others are names with a slash."""
    market = any(x.upper() in L.FINANCE_UNIT or x.upper() in L.CURRENCY for x in (m[1], m[2]))
    return f"{ticker_words(m[1])} {'до' if market else 'слеш'} {ticker_words(m[2])}"


finance = passes(known_finance, _pair, _after(TICKER, False))
