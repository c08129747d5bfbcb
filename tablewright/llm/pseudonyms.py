"""Format-preserving pseudonyms for personal data, in column expressions alone.

Numbers and dates are found by pattern and validated: card numbers by their check digit, account numbers (IBAN) by
theirs, addresses by the range of their parts, dates by the calendar. What is valid is permuted by a keyed Feistel
network within its own format: a card number becomes a card number with a right check digit and the same separators, a
date another day of the same four centuries. Equal values become equal values in every document, different ones stay
different, and the key reverses it. Names in e-mail addresses and quoted secrets are not numbers of a fixed format; they
become keyed digests of their own length. Everything else, numbers that are not valid included, stays as it is.

A row is rewritten where it lies: one scan, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import let

ROUNDS = 10
_LETTERS, _BASE_26 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOP"

# Patterns of what may be personal; the validations follow. A match of an earlier pattern goes first.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
SECRET = r"(?:token|secret|password|api_key) ?[=:] ?\"[0-9A-Za-z_-]{16,}+\""
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DAY = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_DOTS = r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?!\.?[0-9])"
DAY_SLASHES = r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?!/?[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# Lengths of account numbers by country; where none is listed, bodies of digits in groups of four are taken.
_ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}
_LISTED = "|".join(" ".join(_ACCOUNT_LENGTHS.values()).split())
ACCOUNT = (r"(?<![A-Za-z0-9])(?:" + "|".join(
    rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}(?![A-Za-z0-9])" for n, c in _ACCOUNT_LENGTHS.items())
    + rf"|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{2,7}}(?: ?[0-9]{{1,3}})?(?![A-Za-z0-9]))")
# A value after a blank or hyphen that is no further group of the number before it.
_OTHER = rf"(?!{ADDRESS}|{DAY}|{DAY_DOTS}|{DAY_SLASHES}|{SOCIAL})"
_NO_CARD = r"(?![0-9]{4}(?:(?:[ -]?[0-9]{4}){3}|[ -]?[0-9]{6}[ -]?[0-9]{4,5})(?![0-9]))"
# Layouts of phone numbers behind the country's code, fixed ones first; numbers of no such layout are taken by groups.
_CODE = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
_AREA = r"(?: ?\(0\))?[ -]?(?:\([0-9]{1,5}\)|[0-9]{1,5})[ -]?"
_SHORT_AREA = r"(?: ?\(0\))?[ -]?(?:\([0-9]{1,2}\)|[0-9]{1,2})[ -]"
_LAYOUTS = [
    r"1[ -]?(?:\([0-9]{3}\)|[0-9]{3})[ -]?[0-9]{3}[ -]?[0-9]{4}",
    rf"{_CODE}[0-9]{{8,12}}",
    rf"{_CODE} ?\([0-9]{{1,4}}\)[ -]?[0-9]{{2}}(?:[ -]{_OTHER}[0-9]{{2}}){{3}}",
    rf"{_CODE}(?: ?\(0\))?[ -]?[0-9][ -][0-9]{{2}}(?:[ -]{_OTHER}[0-9]{{2}}){{3}}",
    rf"{_CODE}{_SHORT_AREA}(?:{_OTHER}[0-9]{{3}}[ -]{_OTHER}[0-9]{{3}}[ -]{_OTHER}[0-9]{{2}}|[0-9]{{2}}(?:[ -]{_OTHER}[0-9]{{2}}){{2}})",
    rf"{_CODE}{_AREA}{_OTHER}(?:[0-9]{{3}}[ -][0-9]{{2}}[ -]{_OTHER}[0-9]{{2}}|[0-9]{{3,5}}[ -]{_OTHER}[0-9]{{4}}|[0-9]{{3}}[ -]{_OTHER}[0-9]{{3}}|[0-9]{{5}}[ -]{_OTHER}[0-9]{{5}}|[0-9]{{6,8}})",
    r"[0-9]{1,3}(?: ?\([0-9]{1,4}\))?(?:[ -]?" + _NO_CARD + _OTHER + r"[0-9]{2,5}){2,4}",
]
PHONE = rf"(?<![0-9])\+(?:{'|'.join(f'{x}(?![0-9])' for x in _LAYOUTS)})"
# A run of numbers with at least as many digits as a card has; which of them are cards is found out in the run.
CARD = rf"(?<![A-Za-z0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:[ -]{_OTHER}[0-9]++(?![A-Za-z]))*+"
_ALL = "|".join([EMAIL, SECRET, PHONE, ADDRESS, DAY, DAY_DOTS, DAY_SLASHES, SOCIAL, ACCOUNT, CARD])

# A match of CARD: it is of numbers alone and no date or social security number.
_RUN = rf"^(?!(?:{DAY}|{SOCIAL})$)[0-9]+(?:[ -][0-9]+)*+$"

# Days are permuted among the 400 years from here on, which are 189 * 773 days.
_FIRST_DAY, _DAYS = "1800-01-01", (189, 773)


def _digest_number(key: str, *parts: Column) -> Column:
    """60 bits that only the key's owner can compute."""
    keyed = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(keyed, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, key: str, inverse: bool = False) -> Column:
    """A keyed permutation of pairs below (left_size, right_size), as a struct of ``l`` and ``r``."""
    rounds = list(range(ROUNDS))[::-1 if inverse else 1]

    def step(acc: Column, i: Column) -> Column:
        def moved(value: Column, other: Column, size: Column) -> Column:
            shift = _digest_number(key, tweak, i, other) % size
            return F.pmod(value - shift if inverse else value + shift, size)
        even = i % 2 == 0
        return F.struct(F.when(even, moved(acc["l"], acc["r"], left_size)).otherwise(acc["l"]).alias("l"),
                        F.when(even, acc["r"]).otherwise(moved(acc["r"], acc["l"], right_size)).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*map(F.lit, rounds)), start, step)


def permuted_digits(digits: Column, kind: str, key: str, inverse: bool = False) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    n, half = F.length(digits), F.floor(F.length(digits) / 2).cast("int")
    power = [F.pow(F.lit(10), x).cast("long") for x in (half, n - half)]
    pair = feistel(F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n - half).cast("long"),
                   power[0], power[1], F.concat(F.lit(f"{kind}:"), n.cast("string")), key, inverse)
    return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")),
                                        F.lpad(p["r"].cast("string"), n - half, F.lit("0"))))


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _in_place(template: Column, digits: Column, letters: bool = False) -> Column:
    """The template with its digits, or digits and capital letters, replaced in order."""
    def step(acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9") | c.between("A", "Z") if letters else c.between("0", "9")
        return F.struct(
            F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
            F.when(is_digit, acc["i"] + 1).otherwise(acc["i"]).alias("i"))
    return F.aggregate(_characters(template), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step)["s"]


def check_digit(payload: Column) -> Column:
    """The last digit that makes a number of card format valid."""
    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["i"] % 2 == 0, twice).otherwise(d)).alias("sum"), (acc["i"] + 1).alias("i"))
    total = F.aggregate(_characters(F.reverse(payload)), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), step)["sum"]
    return ((10 - total % 10) % 10).cast("string")


def _card(match: Column, key: str) -> Column:
    """A valid card number by its payload."""
    def replaced(digits: Column) -> Column:
        fresh = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
        return let(fresh, lambda p: _in_place(match, F.concat(p, check_digit(p))))
    return let(_digits(match), replaced)


_PARTS = "array<struct<m:string,p:string>>"


def _parts(match: Column, new: Column) -> Column:
    return F.array(F.struct(match.alias("m"), new.alias("p"))).cast(_PARTS)


def _cards(run: Column, key: str) -> Column:
    """A run of numbers as parts: from the left, the longest valid card number that begins with each number.

    A card takes whole numbers of the run, and the search goes on behind it.
    """
    def joined(groups: Column, begin: Column, n: Column) -> Column:
        return F.array_join(F.slice(groups, begin, n), "")

    def cut(groups: Column) -> Column:
        size = F.size(groups)

        def valid(i: Column, n: Column) -> Column:
            return let(_digits(joined(groups, i, n)), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))

        def longest(i: Column) -> Column:
            n = F.filter(F.sequence(F.least(F.lit(19), size - i + 1), F.lit(1), F.lit(-1)), lambda n: valid(i, n))
            return F.struct(i.alias("i"), F.get(n, F.lit(0)).alias("n"))

        def take(acc: Column, x: Column) -> Column:
            taken = F.struct(acc["next"].alias("begin"), x["i"].alias("i"), x["n"].alias("n"))
            free = x["i"] >= acc["next"]
            return F.struct(F.when(free, x["i"] + x["n"]).otherwise(acc["next"]).alias("next"),
                            F.when(free, F.concat(acc["out"], F.array(taken))).otherwise(acc["out"]).alias("out"))

        def shown(x: Column) -> Column:
            card = joined(groups, x["i"], x["n"])
            blank = F.regexp_extract(card, "^[ -]?", 0)
            number = F.regexp_replace(card, "^[ -]", "")
            before = F.concat(joined(groups, x["begin"], x["i"] - x["begin"]), blank)
            return F.concat(_parts(before, F.lit(None)), let(number, lambda c: _parts(c, _card(c, key))))

        starts = F.filter(F.transform(F.sequence(F.lit(1), size), longest), lambda x: x["n"].isNotNull())
        none = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<begin:int,i:int,n:int>>").alias("out"))
        return let(F.aggregate(starts, none, take), lambda t: F.concat(
            F.flatten(F.transform(t["out"], shown)), _parts(joined(groups, t["next"], size), F.lit(None))))

    return let(F.regexp_extract_all(run, F.lit("[ -]?[0-9]+"), 0), cut)


def _mod_97(number: Column) -> Column:
    """Letters count as two digits, from A = 10 on."""
    return F.aggregate(_characters(number), F.lit(0), lambda acc, c: F.when(
        c.between("0", "9"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def permuted_letters(letters: Column, tweak: Column, key: str) -> Column:
    """A string of capital letters permuted among those of its length, in blocks of 26."""
    def number(part: Column) -> Column:
        return F.coalesce(F.conv(F.translate(part, _LETTERS, _BASE_26), 26, 10).cast("long"), F.lit(0))

    def text(value: Column, n: Column) -> Column:
        return F.translate(F.lpad(F.conv(value.cast("string"), 10, 26), n, F.lit("0")), _BASE_26, _LETTERS)

    def block(i: Column) -> Column:
        def moved(part: Column) -> Column:
            n, half = F.length(part), F.floor(F.length(part) / 2).cast("int")
            power = [F.pow(F.lit(26), x).cast("long") for x in (half, n - half)]
            pair = feistel(number(F.substring(part, F.lit(1), half)), number(F.substring(part, half + 1, n - half)),
                           *power, F.concat_ws(":", tweak, n.cast("string"), i.cast("string")), key)
            return let(pair, lambda p: F.concat(text(p["l"], half), text(p["r"], n - half)))
        return let(F.substring(letters, 26 * i + 1, F.lit(26)), moved)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(letters) - 1) / 26).cast("int")), block)
    return F.when(F.length(letters) > 0, F.array_join(blocks, "")).otherwise("")


def _fresh_body(body: Column, key: str) -> Column:
    """Digits become digits and letters letters, each at its place."""
    letters, digits = F.regexp_replace(body, "[^A-Z]", ""), _digits(body)

    def placed(fresh: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            is_digit = c.between("0", "9")
            return F.struct(F.concat(acc["s"], F.when(is_digit, F.substring(fresh["d"], acc["i"], F.lit(1))).otherwise(
                                F.substring(fresh["a"], acc["k"], F.lit(1)))).alias("s"),
                            F.when(is_digit, acc["i"] + 1).otherwise(acc["i"]).alias("i"),
                            F.when(is_digit, acc["k"]).otherwise(acc["k"] + 1).alias("k"))
        start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"), F.lit(1).alias("k"))
        return F.aggregate(_characters(body), start, step)["s"]

    alone = ((F.coalesce(digits.try_cast("long"), F.lit(0)) + _digest_number(key, F.lit("account:1"))) % 10).cast("string")
    few = F.when(F.length(digits) == 1, alone).otherwise(digits)
    new = F.struct(F.when(F.length(digits) > 1, permuted_digits(digits, "account", key)).otherwise(few).alias("d"),
                   permuted_letters(letters, F.concat(F.lit("account:"), digits), key).alias("a"))
    return F.when(letters == "", permuted_digits(body, "account", key)).otherwise(let(new, placed))


def _account(match: Column, key: str) -> Column:
    """Country, check digits, then digits and letters; the check digits make the whole 1 modulo 97."""
    def checked(plain: Column) -> Column:
        country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
        valid = _mod_97(F.concat(body, country, F.substring(plain, 3, 2))) == 1
        def rebuilt(fresh: Column) -> Column:
            check = F.lpad((98 - _mod_97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, _in_place(F.substring(match, F.lit(3), F.length(match)), F.concat(check, fresh), letters=True))
        return F.when(valid, let(_fresh_body(body, key), rebuilt))
    return let(F.regexp_replace(match, " ", ""), checked)


def _phone(match: Column, key: str) -> Column:
    """The country code stays, whatever separates it from the rest."""
    code = F.regexp_extract(match, rf"^\+(?:{_CODE}|0[0-9]{{0,2}})", 0)
    rest = F.substring(match, F.length(code) + 1, F.length(match))
    digits = _digits(rest)
    return F.when(F.length(_digits(match)).between(7, 15) & (F.length(digits) >= 4),
                  F.concat(code, _in_place(rest, permuted_digits(digits, "phone", key))))


def _address(match: Column, key: str) -> Column:
    def checked(parts: Column) -> Column:
        pair = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), F.lit("address"), key)
        fresh = let(pair, lambda p: F.concat_ws(".", *[F.floor(x).cast("string") for x in (p["l"] / 256, p["l"] % 256, p["r"] / 256, p["r"] % 256)]))
        return F.when(F.forall(parts, lambda x: x <= 255), fresh)
    return let(F.transform(F.split(match, r"\."), lambda x: x.cast("long")), checked)


def _social(match: Column, key: str) -> Column:
    valid = ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.when(valid, _in_place(match, permuted_digits(_digits(match), "social", key)))


def _day(match: Column, patterns: tuple[str, str], key: str) -> Column:
    """``patterns``: with two digits for day and month, and with as many as they have."""
    a, b = _DAYS
    def permuted(day: Column) -> Column:
        n = F.datediff(day, F.to_date(F.lit(_FIRST_DAY))).cast("long")
        pair = feistel(F.floor(n / b), n % b, F.lit(a), F.lit(b), F.lit("day"), key)
        fresh = let(pair, lambda p: F.date_add(F.to_date(F.lit(_FIRST_DAY)), (p["l"] * b + p["r"]).cast("int")))
        shown = let(fresh, lambda d: F.when(F.length(match) == 10, F.date_format(d, patterns[0])).otherwise(F.date_format(d, patterns[1])))
        return F.when((n >= 0) & (n < a * b), shown)
    return let(F.try_to_timestamp(match, F.lit(patterns[1])).cast("date"), permuted)


def _digest_text(value: Column, n: Column, key: str, kind: str) -> Column:
    """Letters and digits of keyed digests, as many as asked for: one for each 64."""
    def block(i: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), F.when(i > 0, F.concat(i.cast("string"), F.lit("|"))).otherwise(""), value), 256)
    return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 64).cast("int")), block), ""), F.lit(1), n)


def pseudonym(match: Column, key: str) -> Column:
    """What a match other than a run of numbers becomes, NULL where it is not valid."""
    name, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    quoted = F.regexp_extract(match, "\"(.*)\"", 1)
    def is_(pattern: str) -> Column:
        return match.rlike(f"^(?:{pattern})$")
    return (F.when(match.contains("@"), F.concat(_digest_text(match, F.least(F.length(name), F.lit(64)), key, "mail"), F.lit("@"), domain))
            .when(match.endswith('"'), F.concat(F.regexp_extract(match, "^[^\"]*\"", 0), _digest_text(quoted, F.length(quoted), key, "secret"), F.lit('"')))
            .when(match.startswith("+"), _phone(match, key))
            .when(is_(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), _address(match, key))
            .when(is_(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), _day(match, ("yyyy-MM-dd", "yyyy-MM-dd"), key))
            .when(match.contains("."), _day(match, ("dd.MM.yyyy", "d.M.yyyy"), key))
            .when(match.contains("/"), F.coalesce(_day(match, ("MM/dd/yyyy", "M/d/yyyy"), key), _day(match, ("dd/MM/yyyy", "d/M/yyyy"), key)))
            .when(is_(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _social(match, key))
            .when(match.rlike("^[A-Z]"), _account(match, key)))


def replacements(match: Column, key: str) -> Column:
    """A match as parts ``m`` in order, each with what it becomes in ``p``, NULL where it stays."""
    return F.when(match.rlike(_RUN), _cards(match, key)).otherwise(_parts(match, pseudonym(match, key)))


def pseudonymise(df: DataFrame, key: str, text: str = "text", found: str = "n_private") -> DataFrame:
    """The table with personal data of ``text`` replaced, and their number in ``found`` (a column of that name goes).

    A NULL text stays NULL with 0 found. Other columns stay as they are; names that begin with two underscores are
    reserved. The key decides the pseudonyms: the same key links documents of different runs.
    """
    body = F.col(text)
    likely = body.rlike("[0-9@\"]")  # one of these is in every match
    matches = F.when(likely, F.regexp_extract_all(body, F.lit(_ALL), 0)).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__found", matches)
    df = df.withColumn("__new", F.transform("__found", lambda m: replacements(m, key)))
    pieces = F.split(body, _ALL, -1)
    shown = F.transform("__new", lambda parts: F.array_join(F.transform(parts, lambda x: F.coalesce(x["p"], x["m"])), ""))
    rebuilt = F.array_join(F.flatten(F.zip_with(pieces, shown, lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    counted = F.size(F.filter(F.flatten("__new"), lambda x: x["p"].isNotNull())).cast("long")
    counted = F.when(F.size("__found") > 0, counted).otherwise(0)
    return df.withColumns({text: F.when(F.size("__found") > 0, rebuilt).otherwise(body), found: F.coalesce(counted, F.lit(0)).cast("long")}).drop("__found", "__new")
