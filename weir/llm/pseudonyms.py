"""Format-preserving Feistel pseudonyms for validated numbers and dates. DataFrame and SQL functions only.

Every value is mapped to a number in Z_A x Z_B and permuted there by a keyed Feistel network whose halves are
added modulo A and B in turn. That is a bijection of the domain, so equal values get equal pseudonyms in every
document, different values different ones, and nothing has to be stored or joined.

Kinds, tried in this order, and what makes a candidate valid (all else is left as it stands):
  iban   two letters, two check digits and 12 to 30 digits, ISO 7064 mod-97 remainder 1; the last 16 digits (of fewer than
         16, the last 12) are permuted, check digits made anew
  card   13 to 19 digits, singly spaced or hyphenated or not, Luhn-valid; all but the last digit permuted, the last made anew.
         Bare digits, 4-4-4-4 and 4-6-5 groups are tried at each group, so numbers at a card's side are no part of it;
         in other groupings the longest run counts
  phone  +1 (ddd) ddd-dddd, or ddd-ddd-dddd with a space, dot or hyphen between; ten digits permuted
  ssn    ddd-dd-dddd; area 001-665 or 667-899, group 01-99, serial 0001-9999, permuted among the valid ones
  ip     four numbers to 255 joined by dots; permuted among all addresses
  date   yyyy-mm-dd, yyyy/mm/dd, dd/mm/yyyy, dd.mm.yyyy, "March 5, 1999" or "5 March 1999" that the calendar has, from
         1900-03-01 to 2100-02-28; permuted among those days and written in the same form
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Forms of the candidates.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?(?![A-Za-z0-9])"
RUN = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SHAPED = r"(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9])"
CARD = rf"(?<![0-9]){SHAPED}|(?<![0-9])[0-9](?:[ -]?(?!(?<![0-9]){SHAPED})[0-9]){{12,18}}(?![0-9])"
PHONE = r"(?<![0-9])(?:\+1 ?)?\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])|(?<![0-9.-])(?:\+1[-. ])?[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{4}/[0-9]{2}/[0-9]{2}(?![0-9/])|(?<![0-9/.])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9])|(?<![0-9/.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])"
DATE += rf"|(?<![A-Za-z]){MONTH} [1-9][0-9]?, [0-9]{{4}}(?![0-9])|(?<![0-9])[1-9][0-9]? {MONTH} [0-9]{{4}}(?![0-9])"
KINDS = ("iban", "card", "phone", "ssn", "ip", "date")
PATTERN = "|".join((IBAN, DATE, SSN, PHONE, CARD, IP))
#: Days of the date domain, 1900-03-01 to 2100-02-28: 17 x 4297.
FIRST_DAY, DAYS_A, DAYS_B = "1900-03-01", 17, 4297


def _sql(text: str) -> str:
    return "r'" + text + "'"


def feistel(value: str, a: int, b: int, tag: str, key: str) -> str:
    """SQL: the bigint expression value in [0, a*b), permuted."""
    half = lambda x, m: f"(CAST(conv(substring(sha2(concat_ws('|', '{key}', '{tag}', i, {x}, '{key}'), 256), 1, 15), 16, 10) AS BIGINT) % {m})"
    step = f"IF(i % 2 = 1, struct((acc.l + {half('acc.r', a)}) % {a} AS l, acc.r AS r), struct(acc.l AS l, (acc.r + {half('acc.l', b)}) % {b} AS r))"
    return f"aggregate(sequence(1, {ROUNDS}), struct(CAST(({value}) DIV {b} AS BIGINT) AS l, CAST(({value}) % {b} AS BIGINT) AS r), (acc, i) -> {step}, acc -> acc.l * {b} + acc.r)"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string."""
    n = f"length({digits})"
    d = f"CAST(substring({digits}, j, 1) AS INT)"
    twice = f"IF(({n} - j) % 2 = 1, IF(2 * {d} > 9, 2 * {d} - 9, 2 * {d}), {d})"
    return f"aggregate(sequence(1, {n}), 0, (s, j) -> s + {twice})"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _laid_out(m: str, digits: str) -> str:
    """SQL: the match with its digits replaced in order; its other characters stay."""
    return f"array_join(transform(split({m}, ''), (ch, k) -> IF(ch RLIKE '[0-9]', substring({digits}, length(regexp_replace(substring({m}, 1, k + 1), '[^0-9]', '')), 1), ch)), '')"


def _pad(value: str, n: str) -> str:
    return f"lpad(CAST({value} AS STRING), {n}, '0')"


def pseudonym_sql(key: str) -> tuple[str, str]:
    """SQL of a lambda's variable m, a candidate: (its kind or null, its pseudonym)."""
    if "'" in key or "\\" in key:
        raise ValueError("a key must not hold quotes or backslashes")
    d = _digits("m")
    # card: 12 to 18 free digits, in a domain 10^a x 10^b of just that many
    powers = " ".join(f"WHEN {n} THEN {_pad(feistel(f'CAST(substring({d}, 1, {n}) AS BIGINT)', 10 ** (n // 2), 10 ** (n - n // 2), f'card{n}', key), str(n))}" for n in range(12, 19))
    body = f"(CASE length({d}) - 1 {powers} END)"
    card = _laid_out("m", f"element_at(transform(array({body}), x -> concat(x, CAST((10 - ({_luhn('concat(x, 0)')}) % 10) % 10 AS STRING))), 1)")
    ten = feistel(f"CAST(right({d}, 10) AS BIGINT)", 10**5, 10**5, "phone", key)
    phone = _laid_out("m", f"concat(IF(length({d}) = 11, '1', ''), {_pad(ten, '10')})")
    area, group, serial = (f"CAST(substring({d}, {i}, {n}) AS BIGINT)" for i, n in ((1, 3), (4, 2), (6, 4)))
    number = feistel(f"({area} - IF({area} > 666, 2, 1)) * {99 * 9999} + ({group} - 1) * 9999 + {serial} - 1", 898, 99 * 9999, "ssn", key)
    back = f"concat({_pad(f'x DIV {99 * 9999} + IF(x DIV {99 * 9999} >= 665, 2, 1)', '3')}, {_pad(f'(x DIV 9999) % 99 + 1', '2')}, {_pad('x % 9999 + 1', '4')})"
    ssn = _laid_out("m", f"element_at(transform(array({number}), x -> {back}), 1)")
    octet = lambda i: f"CAST(split(m, '[.]')[{i}] AS BIGINT)"
    address = feistel(f"(({octet(0)} * 256 + {octet(1)}) * 256 + {octet(2)}) * 256 + {octet(3)}", 65536, 65536, "ip", key)
    ip = f"element_at(transform(array({address}), x -> concat_ws('.', x DIV 16777216, (x DIV 65536) % 256, (x DIV 256) % 256, x % 256)), 1)"
    forms = (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{4}/", "yyyy/MM/dd"), ("/", "dd/MM/yyyy"), ("^[A-Z]", "MMMM d, yyyy"), (" ", "d MMMM yyyy"), (".", "dd.MM.yyyy"))
    form = "CASE " + " ".join(f"WHEN m RLIKE {_sql(p)} THEN '{f}'" for p, f in forms) + " END"
    day = "CASE " + " ".join(f"WHEN m RLIKE {_sql(p)} THEN try_to_date(m, '{f}')" for p, f in forms) + " END"
    moved = f"date_add(DATE'{FIRST_DAY}', CAST({feistel(f'CAST(datediff({day}, DATE{chr(39)}{FIRST_DAY}{chr(39)}) AS BIGINT)', DAYS_A, DAYS_B, 'date', key)} AS INT))"
    date = f"element_at(transform(array({moved}), x -> date_format(x, {form})), 1)"
    # iban: digits after the two check digits, as far as the last 16 of them
    mod97 = lambda x: f"CAST(CAST({x} AS DECIMAL(38, 0)) % 97 AS INT)"
    code = lambda x: f"CAST(ascii(substring({x}, 1, 1)) - 55 AS STRING), CAST(ascii(substring({x}, 2, 1)) - 55 AS STRING)"
    rest = f"substring({d}, 3)"
    turned = f"concat(left({rest}, length({rest}) - 16), {_pad(feistel(f'CAST(right({rest}, 16) AS BIGINT)', 10**8, 10**8, 'iban', key), '16')})"
    least = f"concat(left({rest}, length({rest}) - 12), {_pad(feistel(f'CAST(right({rest}, 12) AS BIGINT)', 10**6, 10**6, 'iban12', key), '12')})"
    turned = f"IF(length({rest}) >= 16, {turned}, {least})"
    check = f"concat({_pad('98 - ' + mod97(f'concat(x, {code(chr(109))}, {chr(39)}00{chr(39)})'), '2')}, x)"
    iban = _laid_out("m", f"element_at(transform(array({turned}), x -> {check}), 1)")
    whole = lambda p: f"m RLIKE {_sql('^(?:' + p + ')$')}"
    kind = f"""CASE
        WHEN {whole(IBAN)} THEN IF(length({rest}) BETWEEN 12 AND 30 AND {mod97(f'concat({rest}, {code("m")}, left({d}, 2))')} = 1, 'iban', NULL)
        WHEN {whole(DATE)} THEN IF(({day}) BETWEEN DATE'{FIRST_DAY}' AND DATE'2100-02-28', 'date', NULL)
        WHEN {whole(SSN)} THEN IF({area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0, 'ssn', NULL)
        WHEN {whole(PHONE)} THEN 'phone'
        WHEN {whole(RUN)} THEN IF(({_luhn(d)}) % 10 = 0, 'card', NULL)
        WHEN {whole(IP)} THEN IF({octet(0)} < 256 AND {octet(1)} < 256 AND {octet(2)} < 256 AND {octet(3)} < 256, 'ip', NULL)
    END"""
    return kind, f"CASE kind WHEN 'iban' THEN {iban} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {ssn} WHEN 'ip' THEN {ip} WHEN 'date' THEN {date} ELSE m END"


def _cards_sql() -> tuple[str, str]:
    """SQL on t: its Luhn-valid shaped cards, wherever a group begins; on shaped: valid longest runs without one of them."""
    valid = f"x -> ({_luhn(_digits('x'))}) % 10 = 0"
    shaped = f"array_distinct(filter(regexp_extract_all(t, {_sql(f'(?<![0-9])(?=({SHAPED}))')}, 1), {valid}))"
    runs = f"array_distinct(filter(filter(regexp_extract_all(t, {_sql('(' + RUN + ')')}, 1), {valid}), x -> NOT exists(shaped, s -> contains(x, s))))"
    return shaped, runs


def _pattern_sql() -> str:
    """SQL on shaped and runs: PATTERN where none but these cards are taken, and no other run takes a part of them."""
    cards = "array_join(concat(shaped, runs), '|')"
    before, after = PATTERN.split(CARD)
    return f"concat({_sql(before + '(?<![0-9])(?:')}, {cards}, {_sql(')(?![0-9])' + after)})"


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, text_col with pseudonyms, n_values, and n_<kind> for each kind.

    A null text stays null with counts of 0, an empty one stays empty. Ids may repeat or be null, other columns are
    not looked at. Whole texts are read; the work is one projection without a shuffle, so skew of any column and
    groups of copies don't matter. Java's regular expressions scan a text of any length in one pass.
    """
    kind, new = pseudonym_sql(key)
    t = F.col("t")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    shaped, runs = _cards_sql()
    rows = rows.withColumn("shaped", F.when(t.rlike(RUN), F.expr(shaped)))
    rows = rows.withColumn("runs", F.when(F.col("shaped").isNotNull(), F.expr(runs)))
    rows = rows.withColumn("pattern", F.when(F.size("shaped") + F.size("runs") > 0, F.expr(_pattern_sql())))
    either = lambda f: f"IF(pattern IS NULL, {f(_sql(PATTERN))}, {f('pattern')})"
    matches = either(lambda x: f"regexp_extract_all(t, {x}, 0)")
    found: Column = F.expr(f"transform({matches}, m -> struct(m, {kind} AS kind))")
    # a text without a digit, or without a candidate, is passed on as it is
    rows = rows.withColumn("found", F.when(t.rlike("[0-9][0-9 ./()-]{6}|[a-z] [0-9]{1,2}, [0-9]{4}|[0-9] [A-Z][a-z]{2,8} [0-9]{4}"), found))
    rows = rows.withColumn("some", F.coalesce(F.exists("found", lambda x: x["kind"].isNotNull()), F.lit(False)))
    put = F.expr(f"transform(found, x -> element_at(transform(array(x), y -> element_at(transform(array(y.m), (m, z) -> element_at(transform(array(y.kind), kind -> {new}), 1)), 1)), 1))")
    gaps = F.expr(either(lambda x: f"split(t, {x}, -1)"))
    joined = F.expr("array_join(transform(gaps, (g, i) -> concat(g, IF(i < size(put), put[i], ''))), '')")
    rows = rows.withColumn("put", F.when(F.col("some"), put)).withColumn("gaps", F.when(F.col("some"), gaps))
    count = lambda k: F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    return rows.select(
        F.col("id").alias(id_col), F.when(F.col("some"), joined).otherwise(t).alias(text_col),
        F.coalesce(F.size(F.filter("found", lambda x: x["kind"].isNotNull())), F.lit(0)).cast("long").alias("n_values"),
        *(count(k).alias(f"n_{k}") for k in KINDS),
    )
