"""Each query applies one operator to whole tables; ORACLE_SQL has the same in SQL, its tables made by the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holosna.functions import letters, numbers, structural, validation
from holosna.functions import tables as T
from holosna.operators import segmentation, token_rows


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ua_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinals of order keys and of prices in kopiykas, in three genders."""
    n = F.round(F.col("o_totalprice") * 100).cast("long")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.number_words(F.col("o_orderkey"), integral=True).alias("key_words"), numbers.number_words(n, "f", integral=True).alias("price_words"), numbers.number_words(F.col("o_custkey"), "n", integral=True).alias("customer_words")
    )


def ua_ordinal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", *(numbers.ordinal_words(c, f, integral=True).alias(f"o_{f}") for f in ("nom_m", "gen_f", "ins_pl", "loc_f")))


def ua_case_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", *(numbers.case_words(F.col("o_orderkey"), c, integral=True).alias(f"c_{c}") for c in T.CASES))


def ua_counted_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.hours_words(q, True).alias("hours"), numbers.minutes_words(q, True).alias("minutes"), numbers.counted(q, "документ", "документи", "документів", integral=True).alias("papers"))


def ua_decimal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.split(F.format_string("%.2f", "p_retailprice"), r"\.")
    return _t(spark, sf_dir, "part").select("p_partkey", numbers.decimal_words(F.get(digits, 0), F.get(digits, 1)).alias("price"), numbers.fraction_words(F.col("p_size"), F.lit(100)).alias("share"))


def ua_digit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", numbers.digit_words(F.col("c_name")).alias("digits"), letters.spelled_letters(F.col("c_name")).alias("spelled"))


def ua_spelled_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole part names, letter by letter."""
    return _t(spark, sf_dir, "part").select("p_partkey", letters.spelled_letters(F.col("p_name")).alias("spelled"))


def ua_transliterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", letters.transliterated(F.col("text")).alias("cyrillic"))


def ua_trim_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", letters.trimmed(F.concat(F.lit("  "), F.replace("text", F.lit("e"), F.lit("  ")))).alias("trimmed"))


def ua_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as upper-case Cyrillic, so that vowelless runs abound."""
    return _t(spark, sf_dir, "part").select("p_partkey", letters.spelled_acronyms(F.translate(F.upper("p_name"), "BCDFGHKLMNPRSTVXZAEIOUY", "БЦДФГХКЛМНПРСТВШЗАЕІОУИ")).alias("spelled"))


def ua_valid_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", validation.valid_date(k % 32, k % 14, 1890 + k % 230).alias("is_date"), validation.valid_iso_week(1900 + k % 400, 50 + k % 6).alias("is_week")
    )


def ua_valid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lpad(F.col("l_orderkey").cast("string"), 9, "0")
    d = F.concat(text, F.col("l_linenumber").cast("string"))
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", validation.valid_luhn(F.concat(F.lit("4111"), d)).alias("luhn"), validation.valid_isbn(d).alias("isbn10"), validation.valid_isbn(F.concat(F.lit("978"), d)).alias("isbn13"),
        validation.valid_issn(F.substring(d, 3, 8)).alias("issn"), validation.roman_value(F.translate(F.substring(d, 6, 5), "0123456789", "IVXLCDMIVX")).alias("roman"),
    )


def ua_valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account and vehicle numbers, UUIDs, digests and Roman numerals made of customer keys, some of them valid; numbers as identifiers say them."""
    k = F.col("c_custkey")
    digits = lambda n: F.lpad(k.cast("string"), n, "0")
    roman = F.translate(F.lpad((k % 1000).cast("string"), 3, "0"), "0123456789", "IVXLCDMIXC")
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", validation.valid_iban(F.concat(F.lit("GB82 WEST "), digits(14))).alias("iban"), validation.valid_vin(F.concat(F.lit("1M8GDM9AXKP"), digits(6))).alias("vin"),
        validation.valid_uuid(F.concat(F.lit("550e8400-e29b-"), (k % 10).cast("string"), F.lit("1d4-"), (k % 7 + 5).cast("string"), F.lit("716-446655440000"))).alias("uuid"),
        validation.valid_hash_length(F.lit("MD5"), F.repeat(F.lit("a"), (k % 40 + 1).cast("int"))).alias("digest"), validation.valid_roman(roman).alias("roman"),
        numbers.identifier_number(digits(4)).alias("padded"), numbers.identifier_number(k.cast("string")).alias("plain"), structural.variables(F.concat(F.lit("α = "), k.cast("string"))).alias("variable"),
    )


def ua_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return segmentation.exploded_rows(docs, "text", segmentation.split_sentences)


def ua_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of whole turns, by built-in functions."""
    return token_rows.token_rows(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", "conv_id", "turn")


def ua_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", structural.symbols(F.col("html")).alias("spoken"))


def ua_output_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a blank before each full stop and comma."""
    spaced = F.replace(F.replace("text", F.lit("."), F.lit(" .")), F.lit(","), F.lit("\t ,"))
    return _t(spark, sf_dir, "documents").select("doc_id", structural.output_spacing(spaced).alias("tight"))


def ua_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names set between marks that the structural passes take out or change."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        structural.unicode_forms(F.concat(F.lit("«"), name, F.lit("» ‑ −"), size, F.lit(" пʼять")), "straight").alias("forms"),
        structural.typography(F.concat(F.lit("**"), name, F.lit("** ,"), size, F.lit(" км / год, A / B"))).alias("typography"),
        structural.homoglyphs(F.concat(F.lit("Kиїв "), name)).alias("homoglyphs"),
        structural.headings(F.concat(F.lit("=== "), name, F.lit(" ===\n"), size)).alias("heading"),
    )


def ua_number_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys beyond a million, grouped by commas and by spaces."""
    grouped = F.format_number(F.col("o_orderkey") + 1000000, 0)
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", structural.number_groups(F.concat(F.lit("сума "), grouped, F.lit(" грн"))).alias("commas"), structural.number_groups(F.concat(F.lit(".5; "), F.translate(grouped, ",", " "))).alias("blanks")
    )


def ua_english_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", structural.english_words(F.col("text"), VOCABULARY).alias("read"))


#: A vocabulary for the query above.
VOCABULARY = {"the": "зе", "and": "енд", "for": "фор", "des": "де"}

QUERIES = {f.__name__: f for f in (
    ua_number_words, ua_ordinal_words, ua_case_words, ua_counted_nouns, ua_decimal_words, ua_digit_words, ua_transliterate, ua_trim_spaces, ua_acronyms, ua_valid_dates, ua_valid_identifiers, ua_sentences, ua_tokens,
    ua_symbols, ua_output_spacing, ua_structural, ua_number_groups, ua_english_words, ua_spelled_letters, ua_valid_codes,
)}


# ---- SQL ---------------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(n: str, gender: str = "m") -> str:
    """SQL for the cardinal words of an expression."""
    three = f"string_split({_q('|'.join(T.below_thousand(i) for i in range(1000)))}, '|')"
    thousands = f"string_split({_q('|'.join('' if i == 1 else T.agreed(T.below_thousand(i), 'f') for i in range(1000)))}, '|')"
    parts = []
    for value, forms in T.SCALES.items():
        c = f"(CAST({n} AS BIGINT) // {value} % 1000)"
        parts.append(f"CASE WHEN {c} > 0 THEN trim({thousands if value == 1000 else three}[{c} + 1] || ' ' || {_plural(c, *forms)}) END")
    parts.append(f"nullif({three}[CAST({n} AS BIGINT) % 1000 + 1], '')")
    last = {"f": [("один", "одна"), ("два", "дві")], "n": [("один", "одне")]}.get(gender, [])
    out = f"coalesce(nullif(concat_ws(' ', {', '.join(parts)}), ''), {_q(T.ZERO)})"
    for a, b in last:
        out = f"regexp_replace({out}, '(^| ){a}$', '\\1{b}')"
    return out


def _plural(n: str, one: str, few: str, many: str) -> str:
    return f"CASE WHEN {n} % 100 BETWEEN 11 AND 14 THEN {_q(many)} WHEN {n} % 10 = 1 THEN {_q(one)} WHEN {n} % 10 BETWEEN 2 AND 4 THEN {_q(few)} ELSE {_q(many)} END"


def _map(d: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in d.items())}}}"


def _ordinal(n: str, form: str) -> str:
    stems = _map({w: T.inflected(s, form) for w, s in T.ORDINAL_STEMS.items()})
    round_ = _map({str(k * 1000): T.inflected(p + "тисячний", form) for k, p in T.ROUND_THOUSANDS.items()})
    w = f"string_split({_words(n)}, ' ')"
    usual = f"list_transform([{w}], lambda w: array_to_string(list_append(w[:-2], coalesce({stems}[w[-1]], w[-1] || {_q(T.HARD_ENDINGS.get(form, ''))})), ' '))[1]"
    return f"coalesce({round_}[CAST({n} AS VARCHAR)], {usual})"


def _case(n: str, case: str) -> str:
    forms = _map({w: f[T.CASES.index(case)] for w, f in T.case_forms().items()})
    return f"array_to_string(list_transform(string_split({_words(n)}, ' '), lambda w: coalesce({forms}[w], w)), ' ')"


def _digits(s: str) -> str:
    names = "[" + ", ".join(map(_q, [T.ZERO, *T.ONES[1:]])) + "]"
    return f"array_to_string(list_transform(regexp_extract_all({s}, '[0-9]'), lambda d: {names}[CAST(d AS INT) + 1]), ' ')"


def _counted(n: str, one: str, few: str, many: str, gender: str = "m") -> str:
    return f"{_words(n, gender)} || ' ' || {_plural(n, one, few, many)}"


_NAMES = _map(T.LETTER_NAMES | T.LATIN_LETTER_NAMES)
_MARKS = T.DIACRITICS
_SEQUENCES = "|".join(k for k in T.LATIN if len(k) == 2)
_PRICE = "string_split(printf('%.2f', p_retailprice), '.')"
_SINGLE = "({n} % 10 = 1 AND {n} % 100 <> 11)"


def _decimal(w: str, f: str) -> str:
    one, many = ("[" + ", ".join(_q(p[i]) for p in T.PLACES) + "]" for i in (0, 1))
    wn, fn = f"CAST({w} AS BIGINT)", f"CAST({f} AS BIGINT)"
    return f"{_words(wn, 'f')} || CASE WHEN {_SINGLE.format(n=wn)} THEN ' ціла' ELSE ' цілих' END || ' і ' || {_words(fn, 'f')} || ' ' || CASE WHEN {_SINGLE.format(n=fn)} THEN {one}[length({f})] ELSE {many}[length({f})] END"


_D = "lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || CAST(l_linenumber AS VARCHAR)"

ORACLE_SQL = {
    "ua_number_words": f"SELECT o_orderkey, {_words('o_orderkey')} AS key_words, {_words('round(o_totalprice * 100)', 'f')} AS price_words, {_words('o_custkey', 'n')} AS customer_words FROM orders",
    "ua_ordinal_words": f"SELECT c_custkey, {', '.join(f'{_ordinal("c_custkey", f)} AS o_{f}' for f in ('nom_m', 'gen_f', 'ins_pl', 'loc_f'))} FROM customer",
    "ua_case_words": f"SELECT o_orderkey, {', '.join(f'{_case("o_orderkey", c)} AS c_{c}' for c in T.CASES)} FROM orders",
    "ua_counted_nouns": f"SELECT l_orderkey, l_linenumber, {_counted('q', 'година', 'години', 'годин', 'f')} AS hours, {_counted('q', 'хвилина', 'хвилини', 'хвилин', 'f')} AS minutes, {_counted('q', 'документ', 'документи', 'документів')} AS papers FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)",
    "ua_decimal_words": f"SELECT p_partkey, {_decimal('d[1]', 'd[2]')} AS price, {_words('p_size', 'f')} || ' ' || CASE WHEN {_SINGLE.format(n='p_size')} THEN 'сота' ELSE 'сотих' END AS share FROM (SELECT *, {_PRICE} AS d FROM part)",
    "ua_digit_words": f"SELECT c_custkey, {_digits('c_name')} AS digits, array_to_string(list_filter(list_transform(string_split(upper(c_name), ''), lambda c: {_NAMES}[c]), lambda x: x IS NOT NULL), ' ') AS spelled FROM customer",
    "ua_spelled_letters": f"SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(upper(p_name), ''), lambda c: {_NAMES}[c]), lambda x: x IS NOT NULL), ' ') AS spelled FROM part",
    "ua_transliterate": f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?is)sch|{_SEQUENCES}|.'), lambda x: coalesce({_map(T.LATIN | _MARKS)}[CASE WHEN x SIMILAR TO '[A-Za-z]+' THEN lower(x) ELSE x END], x)), '') AS cyrillic FROM documents",
    "ua_trim_spaces": "SELECT doc_id, trim(regexp_replace('  ' || replace(text, 'e', '  '), ' +', ' ', 'g'), ' ') AS trimmed FROM documents",
    "ua_valid_dates": "SELECT o_orderkey, try_cast(printf('%04d-%02d-%02d', 1890 + o_orderkey % 230, o_orderkey % 14, o_orderkey % 32) AS DATE) IS NOT NULL AS is_date, "
    "50 + o_orderkey % 6 <= 52 OR (50 + o_orderkey % 6 = 53 AND weekofyear(make_date(CAST(1900 + o_orderkey % 400 AS BIGINT), 12, 28)) = 53) AS is_week FROM orders",
}
_SPOKEN = "html"
for _sign, _name in structural.SYMBOLS.items():
    _SPOKEN = f"replace({_SPOKEN}, {_q(_sign)}, {_q(f' {_name} ')})"
ORACLE_SQL |= {
    "ua_symbols": f"SELECT page_id, trim(regexp_replace({_SPOKEN}, ' +', ' ', 'g'), ' ') AS spoken FROM pages",
    "ua_output_spacing": "SELECT doc_id, regexp_replace(replace(replace(text, '.', ' .'), ',', chr(9) || ' ,'), '[ \\t]+([,.;:!?])', '\\1', 'g') AS tight FROM documents",
    "ua_structural": """SELECT p_partkey, '"' || p_name || '" – -' || p_size || ' п''ять' AS forms, p_name || ',' || p_size || ' км/год, A/B' AS typography, 'Київ ' || p_name AS homoglyphs, p_name || chr(10) || p_size AS heading FROM part""",
    "ua_number_groups": "SELECT o_orderkey, 'сума ' || (o_orderkey + 1000000) || ' грн' AS commas, '0.5; ' || (o_orderkey + 1000000) AS blanks FROM orders",
    "ua_english_words": rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)\b[A-Za-z](?:[A-Za-z''’-]*[A-Za-z])?\b|.'), lambda x: coalesce({_map(VOCABULARY)}[lower(x)], x)), '') AS read FROM documents",
}
_LUHN = "list_sum(list_transform(range(0, 14), lambda i: CASE WHEN i % 2 = 0 THEN CAST(l[14 - i] AS INT) WHEN CAST(l[14 - i] AS INT) > 4 THEN 2 * CAST(l[14 - i] AS INT) - 9 ELSE 2 * CAST(l[14 - i] AS INT) END))"
_ROMAN = "list_transform(string_split(translate(d[6:10], '0123456789', 'IVXLCDMIVX'), ''), lambda c: MAP {'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}[c])"
ORACLE_SQL["ua_valid_identifiers"] = f"""
SELECT l_orderkey, l_linenumber, {_LUHN} % 10 = 0 AS luhn,
  list_sum(list_transform(range(1, 11), lambda i: (11 - i) * CAST(d[i] AS INT))) % 11 = 0 AS isbn10,
  list_sum(list_transform(range(1, 14), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END * CAST(('978' || d)[i] AS INT))) % 10 = 0 AS isbn13,
  list_sum(list_transform(range(1, 9), lambda i: (9 - i) * CAST(d[2 + i] AS INT))) % 11 = 0 AS issn,
  CAST(greatest(0, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i < 5 AND r[i] < r[i + 1] THEN -r[i] ELSE r[i] END))) AS BIGINT) AS roman
FROM (SELECT *, {_ROMAN} AS r FROM (SELECT *, {_D} AS d, '4111' || {_D} AS l FROM lineitem))"""

_RUNS = "[А-ЯҐЄІЇ]"
ORACLE_SQL["ua_acronyms"] = f"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(t, '{_RUNS}+|[^А-ЯҐЄІЇ]+'), lambda x: CASE WHEN length(x) > 1 AND regexp_full_match(x, '{_RUNS}+') AND NOT regexp_matches(x, '[АЕЄИІЇОУЮЯ]')
  THEN array_to_string(list_transform(string_split(x, ''), lambda c: {_NAMES}[c]), ' ') ELSE x END), '') AS spelled
FROM (SELECT p_partkey, translate(upper(p_name), 'BCDFGHKLMNPRSTVXZAEIOUY', 'БЦДФГХКЛМНПРСТВШЗАЕІОУИ') AS t FROM part)"""
_VIN = "'1M8GDM9AXKP' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')"
_VALUES = "MAP {'A': 1, 'D': 4, 'G': 7, 'K': 2, 'M': 4, 'P': 7, 'X': 7}"
_ROMAN3 = "translate(lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '0123456789', 'IVXLCDMIXC')"
_SAID = f"CASE WHEN length(s) > 4 OR (length(s) > 1 AND s[1] = '0') THEN {_digits('s')} ELSE {_words('CAST(s AS BIGINT)')} END"
ORACLE_SQL["ua_valid_codes"] = f"""
SELECT c_custkey, CAST('32142829' || lpad(CAST(c_custkey AS VARCHAR), 14, '0') || '161182' AS HUGEINT) % 97 = 1 AS iban,
  list_sum(list_transform(range(1, 18), lambda i: [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2][i] * coalesce({_VALUES}[v[i]], try_cast(v[i] AS INT)))) % 11 = 10 AS vin,
  c_custkey % 10 BETWEEN 1 AND 8 AND c_custkey % 7 + 5 IN (8, 9) AS uuid, c_custkey % 40 + 1 = 32 AS digest,
  regexp_full_match({_ROMAN3}, 'M{{0,4}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})') AS roman,
  list_transform([lpad(CAST(c_custkey AS VARCHAR), 4, '0')], lambda s: {_SAID})[1] AS padded, list_transform([CAST(c_custkey AS VARCHAR)], lambda s: {_SAID})[1] AS plain, 'альфа = ' || c_custkey AS variable
FROM (SELECT *, {_VIN} AS v FROM customer)"""


def _re2(chars: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):04x}}}" for c in chars)


_BLANK, _UK = _re2(segmentation.SPACE), segmentation.UK
_L = f"A-Za-z{_UK}"
# an address that a full stop alone follows would need a look ahead; no turn has one
_ATOM = (
    f"№-?[{_L}0-9/-]+|https?://(?:[^{_BLANK}<>\"«»“”()\\[\\]{{}}]*[^{_BLANK}<>\"«»“”()\\[\\]{{}}.,;:!?])?|[@#][{_L}0-9_-]+|[{_L}0-9][{_L}0-9_.-]*@[{_L}0-9_-]*\\.(?:[{_L}0-9_.-]*[{_L}0-9_-])?"
    f"|[{_UK}]+(?:['’ʼ`][{_UK}]+)*|[A-Za-z]+|[0-9]+|[^{_BLANK}]"
).replace("'", "''")
_MARKS = lambda c, chars: f"regexp_matches({c}, '^[{_re2(chars)}]')"
_BESIDE = lambda marks, fits: (
    f"(x2 IS NOT NULL AND {_MARKS('x1', marks)} AND {fits('k2', 'kind')} OR y IS NOT NULL AND {_MARKS('x', marks)} AND NOT (x2 IS NOT NULL AND x1[1] = x[1]) AND {fits('k1', 'ky')})"
)
_ORDERED = "OVER (PARTITION BY conv_id, turn ORDER BY i)"
ORACLE_SQL["ua_tokens"] = f"""
WITH p AS (SELECT conv_id, turn, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (SELECT conv_id, turn, regexp_extract_all(text, '[{_BLANK}]+|{_ATOM}') AS a FROM conversations)),
o AS (SELECT *, sum(strlen(x)) {_ORDERED} AS stop FROM p),
k AS (
  SELECT *, stop - strlen(x) AS start, CASE WHEN length(x) > 1 AND (regexp_matches(x, '^[№@#]') OR contains(x, '@') OR regexp_matches(x, '^https?://')) THEN 'other' WHEN regexp_matches(x, '^[{_UK}]') THEN 'uk'
    WHEN regexp_matches(x, '^[A-Za-z]') THEN 'lat' WHEN regexp_matches(x, '^[0-9]') THEN 'int' WHEN {_MARKS('x', segmentation.TOKEN_PUNCT)} THEN 'punct' ELSE 'other' END AS kind
  FROM o WHERE NOT regexp_matches(x, '^[{_BLANK}]')),
w AS (
  SELECT *, {', '.join(f'lag({c}, {n}) {_ORDERED} AS {a}{n}' for n in (1, 2, 3) for c, a in (('x', 'x'), ('kind', 'k'), ('start', 'start'), ('stop', 'stop')))}, lead(x) {_ORDERED} AS y, lead(kind) {_ORDERED} AS ky FROM k),
j AS (
  SELECT *, stop1 = start AND (
    {_BESIDE(segmentation.DASHES + "_", lambda a, b: f"{a} <> 'punct' AND {b} <> 'punct'")} OR {_BESIDE(".,/" + chr(92), lambda a, b: f"{a} = 'int' AND {b} = 'int'")}
    OR k1 = 'punct' AND kind = 'punct' AND (
      x IN ('(', ')') AND (x1 IN ('=', ':', ';') OR x1 IN ('(', ')') AND stop2 = start1 AND (x2 IN ('=', ':', ';') OR x2 IN ('(', ')') AND stop3 = start2 AND x3 IN ('=', ':', ';')))
      OR {_MARKS('x1', segmentation.ENDINGS)} AND {_MARKS('x', segmentation.ENDINGS)} OR x1 = x AND x IN ('-', '*'))
    OR 'other' IN (k1, kind) AND k1 IN ('uk', 'lat', 'other') AND kind IN ('uk', 'lat', 'other')
    OR k1 = 'int' AND kind IN ('uk', 'lat') AND lower(x) IN ({', '.join(_q(k) for k in sorted(segmentation.KNOWN))}) OR x = '!' AND lower(x1) = 'yahoo') AS fit
  FROM w),
t AS (SELECT *, sum(CASE WHEN fit THEN 0 ELSE 1 END) {_ORDERED} AS n FROM j)
SELECT conv_id, turn, CAST(n - 1 AS INT) AS place, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop, string_agg(x, '' ORDER BY i) AS piece FROM t GROUP BY conv_id, turn, n
"""
