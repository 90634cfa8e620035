r"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Personal data is found by expressions and validated (check digits, ranges, calendar); what is not
valid stays as it is. A valid value is permuted within its format by a keyed Feistel network, so that
equal values have equal pseudonyms in all documents and different values different ones:

- e-mail: letters and digits of the local part, whose case does not matter for the pseudonym; the domain stays
- payment card (13 to 19 digits, Luhn): the digits between the first and the check digit, which is set anew;
  in a run of numbers every sequence of whole numbers is tried, longer ones first
- phone (+ country code, 8 to 15 digits): the national digits after the country code, which the digits alone
  decide, so that grouping does not matter; with +1, area and exchange still begin with 2 to 9;
  it ends where another value begins, and with +1 at ten national digits if they are grouped 3-3-4.
  A number grouped 3-3-4 without a country code counts as one of +1
- IPv4: the four octets; social security number: within the numbers that can be issued
- IBAN (mod 97), written together or in groups of four: the account part, check digits set anew
- date (1800 to 2199, also day first where the month cannot be): another valid day

A Feistel round adds to one half, modulo the size of each position's alphabet, numbers drawn from
SHA-256 of the key, kind, round, position and the other half; the halves take turns. Who knows the key
can undo the pseudonyms, so there is none built in: ``session_key`` takes it from the setting
``spark.takerank.pseudonym.key``, or draws one at random for the session.

Rows are treated one by one: a null text stays null, an empty one empty, repeated rows get equal
results, an empty table an empty one, other columns stay and may be null.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6
KEY_SETTING = "spark.takerank.pseudonym.key"
# The country codes of one and two digits; all others have three.
COUNTRY_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
CYCLE_DAYS = 146097  # 400 years, 1800-01-01 to 2199-12-31: 189 * 773 days


def session_key(spark: SparkSession) -> str:
    """The key of the setting; without one, a random key that holds for the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _draw(key: str, kind: str, turn: Column, place: Column, other: Column) -> Column:
    """A number below 2**40 from the key, the place and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), place.cast("string"), other), 256), 1, 10), 16, 10).cast("bigint")


def _shift(c: Column, alphabet: Column, by: Column) -> Column:
    """A character moved on in its alphabet: d digits, n 2 to 9, l and u letters."""
    first = F.when(alphabet == "d", 48).when(alphabet == "n", 50).when(alphabet == "l", 97).otherwise(65)
    size = F.when(alphabet == "d", 10).when(alphabet == "n", 8).otherwise(26)
    return F.chr((first + F.pmod(F.ascii(c) - first + by, size.cast("bigint"))).cast("bigint"))


def permute_symbols(symbols: Column, alphabets: Column, key: str, kind: str) -> Column:
    """A string permuted within the alphabets of its positions."""

    def halves(x: Column) -> Column:
        n = F.length(x.s)
        half = F.floor(n / 2).cast("int")
        parts = {"l": (x.s, F.lit(1), half), "r": (x.s, half + 1, n), "lk": (x.k, F.lit(1), half), "rk": (x.k, half + 1, n)}
        return F.struct(*[F.substr(*v).alias(k) for k, v in parts.items()])

    def added(own: Column, kinds: Column, other: Column, turn: Column) -> Column:
        moved = F.transform(F.sequence(F.lit(1), F.length(own)), lambda i: _shift(F.substr(own, i, F.lit(1)), F.substr(kinds, i, F.lit(1)), _draw(key, kind, turn, i, other)))
        return F.when(F.length(own) == 0, own).otherwise(F.array_join(moved, ""))

    def permuted(h: Column) -> Column:
        def step(s: Column, turn: Column) -> Column:
            even = turn % 2 == 0
            return F.struct(F.when(even, s.l).otherwise(added(s.l, h.lk, s.r, turn)).alias("l"), F.when(even, added(s.r, h.rk, s.l, turn)).otherwise(s.r).alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(h.l.alias("l"), h.r.alias("r")), step, lambda s: F.concat(s.l, s.r))

    return let(let(F.struct(symbols.alias("s"), alphabets.alias("k")), halves), permuted)


def permute_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """(a, b) permuted within range(sizes[0]) and range(sizes[1]), as a struct of big integers a and b."""

    def step(s: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        more = lambda own, size, other: F.pmod(own + _draw(key, kind, turn, F.lit(0), other.cast("string")), F.lit(size).cast("bigint"))
        return F.struct(F.when(even, s.a).otherwise(more(s.a, sizes[0], s.b)).alias("a"), F.when(even, more(s.b, sizes[1], s.a)).otherwise(s.b).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def _alphabets(symbols: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(symbols, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, symbols: Column) -> Column:
    """m with its letters and digits replaced by symbols, in order."""

    def filled(x: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(x.m)), lambda i: F.struct(F.substr(x.m, i, F.lit(1)).alias("c"), F.length(F.regexp_replace(F.substr(x.m, F.lit(1), i), "[^A-Za-z0-9]", "")).alias("k")))
        return F.array_join(F.transform(chars, lambda p: F.when(p.c.rlike("[A-Za-z0-9]"), F.substr(x.s, p.k, F.lit(1))).otherwise(p.c)), "")

    return let(F.struct(m.alias("m"), symbols.alias("s")), filled)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last counting once."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def value(i: Column) -> Column:
            once = F.substr(d, i, F.lit(1)).cast("int")
            twice = F.when(once > 4, 2 * once - 9).otherwise(2 * once)
            return F.when((n - i) % 2 == 1, twice).otherwise(once)

        return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)

    return let(digits, total)


def _mod97(account: Column) -> Column:
    """Remainder by 97 of a string whose letters stand for 10 to 35."""

    def rest(x: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.ascii(F.substr(x, i, F.lit(1))))
        return F.aggregate(chars, F.lit(0), lambda r, c: F.when(c < 58, (r * 10 + c - 48) % 97).otherwise((r * 100 + c - 55) % 97))

    return let(account, rest)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    new = let(F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", "")), lambda x: permute_symbols(x, _alphabets(x), key, "email"))
    # a digit that stands for a letter, or the other way round, does not occur: each position keeps its alphabet
    cased = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x.n)), lambda i: F.when(F.substr(x.o, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substr(x.n, i, F.lit(1)))).otherwise(F.substr(x.n, i, F.lit(1)))), "")
    both = F.struct(new.alias("n"), F.regexp_replace(local, "[^A-Za-z0-9]", "").alias("o"))
    return F.concat(_refill(local, let(both, cased)), F.lit("@"), F.substring_index(m, "@", -1))


def _card_ok(m: Column) -> Column:
    return let(_digits(m), lambda d: F.length(d).between(13, 19) & (_luhn(d) % 10 == 0))


def _card(m: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        middle = let(F.substr(d, F.lit(2), F.length(d) - 2), lambda x: permute_symbols(x, _alphabets(x), key, "card"))
        return F.concat(F.substr(d, F.lit(1), F.lit(1)), middle)

    def checked(b: Column) -> Column:
        return F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))

    return _refill(m, let(let(_digits(m), body), checked))


def _cards(run: Column, key: str, hide: Callable[[Column], Column]) -> Column:
    """Number of cards in a run of numbers, and the run with their pseudonyms."""

    def piece(x: Column, i: Column, k: Column) -> Column:
        more = F.transform(F.sequence(F.lit(2), F.greatest(k, F.lit(2))), lambda j: F.when(j <= k, F.concat(F.get(x.gaps, i + j - 1), F.get(x.numbers, i + j - 1))).otherwise(""))
        return F.concat(F.get(x.numbers, i), F.array_join(more, ""))

    def best(x: Column, i: Column) -> Column:
        """The longest card that begins at number i, as k numbers (null if there is none), and whether it is grouped as cards are."""

        def is_card(k: Column) -> Column:
            joined = F.forall(F.slice(x.gaps, i + 2, k - 1), lambda g: F.length(g) == 1)
            return joined & (F.get(x.gaps, i + k).rlike("^(?: |$)")) & let(F.array_join(F.slice(x.numbers, i + 1, k), ""), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), _luhn(d) % 10 == 0).otherwise(False))

        ends = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(x.numbers) - i)), is_card)
        k = F.when(F.get(x.gaps, i).rlike("(?:^| )$"), F.array_max(ends))
        shape = lambda n: F.array_join(F.transform(F.slice(x.numbers, i + 1, n), F.length), "-")
        return let(k, lambda n: F.struct(i.alias("i"), n.alias("k"), F.coalesce((n == 1) | shape(n).rlike("^4-(?:4-4-4(?:-[1-3])?|6-[45])$"), F.lit(False)).alias("grouped")))

    def chosen(x: Column) -> Column:
        """One entry for each card and each number outside of cards; a card in no usual grouping yields to one that begins inside it."""
        free = lambda c: c.k.isNotNull() & (c.grouped | ~F.exists(F.slice(x.cards, c.i + 2, c.k - 1), lambda o: o.grouped))
        start = F.struct(F.lit(0).alias("to"), F.expr("cast(array() AS array<struct<i: int, k: int>>)").alias("out"))

        def step(s: Column, c: Column) -> Column:
            k = F.when(free(c), c.k).otherwise(0)
            return F.when(c.i < s.to, s).otherwise(F.struct((c.i + F.greatest(k, F.lit(1))).alias("to"), F.concat(s.out, F.array(F.struct(c.i.alias("i"), k.alias("k")))).alias("out")))

        return F.aggregate(x.cards, start, step, lambda s: s.out)

    def rebuilt(x: Column) -> Column:
        to = F.transform(x.out, lambda o: F.concat(F.get(x.gaps, o.i), F.when(o.k > 0, let(piece(x, o.i, o.k), lambda m: _card(m, key))).otherwise(F.get(x.numbers, o.i))))
        return F.struct(F.size(F.filter(x.out, lambda o: o.k > 0)).alias("n"), F.array_join(to, "").alias("to"))

    def scanned(x: Column) -> Column:
        cards = F.transform(F.sequence(F.lit(0), F.size(x.numbers) - 1), lambda i: best(x, i))
        return let(F.struct(x.numbers.alias("numbers"), x.gaps.alias("gaps"), cards.alias("cards"), x.run.alias("run")), picked)

    def picked(x: Column) -> Column:
        with_cards = let(F.struct(x.numbers.alias("numbers"), x.gaps.alias("gaps"), chosen(x).alias("out")), rebuilt)
        return F.when(F.exists(x.cards, lambda c: c.k.isNotNull()), with_cards).otherwise(F.struct(F.lit(0).alias("n"), x.run.alias("to")))

    parts = F.struct(F.regexp_extract_all(run, F.lit(r"\d+"), F.lit(0)).alias("numbers"), F.split(run, r"\d+", -1).alias("gaps"), run.alias("run"))
    return let(parts, scanned)


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(8, 15)


def _phone(m: Column, key: str) -> Column:
    def new(x: Column) -> Column:
        code = F.when(x.plus, F.regexp_extract(x.d, COUNTRY_CODE, 1)).otherwise("")
        return let(F.struct(code.alias("code"), F.substr(x.d, F.length(code) + 1, F.lit(15)).alias("n")), lambda y: F.concat(y.code, national(y.code, y.n)))

    def national(code: Column, n: Column) -> Column:
        american = code.isin("", "1") & n.rlike("^[2-9]..[2-9].{6}$")
        return permute_symbols(n, F.when(american, F.lit("nddndddddd")).otherwise(F.regexp_replace(n, ".", "d")), key, "phone")

    return _refill(m, let(F.struct(_digits(m).alias("d"), m.startswith("+").alias("plus")), new))


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    p = let(octets, lambda o: permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ipv4"))
    return let(p, lambda x: F.concat_ws(".", *[f.cast("string") for f in (F.floor(x.a / 256), x.a % 256, F.floor(x.b / 256), x.b % 256)]))


def _ssn_ok(m: Column) -> Column:
    return m.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def _ssn(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, "-"), lambda x: x.cast("int"))
    area = F.when(part[0] < 666, part[0] - 1).otherwise(part[0] - 2)
    p = permute_pair(area, (part[1] - 1) * 9999 + part[2] - 1, (898, 99 * 9999), key, "ssn")
    return let(p, lambda x: F.format_string("%03d-%02d-%04d", F.when(x.a < 665, x.a + 1).otherwise(x.a + 2), F.floor(x.b / 9999) + 1, x.b % 9999 + 1))


def _iban_ok(m: Column) -> Column:
    return _mod97(F.concat(F.substr(m, F.lit(5), F.length(m)), F.substr(m, F.lit(1), F.lit(4)))) == 1


def _iban(m: Column, key: str) -> Column:
    country, account = F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(5), F.length(m))
    new = let(account, lambda x: permute_symbols(x, _alphabets(x), key, "iban"))
    return let(F.struct(country.alias("c"), new.alias("n")), lambda x: F.concat(x.c, F.lpad((98 - _mod97(F.concat(x.n, x.c, F.lit("00")))).cast("string"), 2, "0"), x.n))


def _ibans(run: Column, key: str, hide: Callable[[Column], Column]) -> Column:
    """Number of accounts in a match (0 or 1), and the match with a pseudonym: of groups, the longest sequence from the first that is valid."""

    def tried(x: Column) -> Column:
        solid = lambda k: F.array_join(F.slice(x.groups, F.lit(1), k), "")
        fits = F.filter(F.sequence(F.lit(1), F.size(x.groups)), lambda k: F.length(solid(k)).between(15, 34) & let(solid(k), _iban_ok))
        return let(F.struct(x.run.alias("run"), x.groups.alias("groups"), F.array_max(fits).alias("k")), replaced)

    def replaced(x: Column) -> Column:
        k = F.coalesce(x.k, F.lit(1))
        taken, rest = F.array_join(F.slice(x.groups, F.lit(1), k), " "), F.array_join(F.slice(x.groups, k + 1, F.size(x.groups)), " ")
        new = let(F.replace(taken, F.lit(" "), F.lit("")), lambda solid: hide(_refill(taken, _iban(solid, key))))
        out = F.concat(new, F.when(k < F.size(x.groups), F.concat(F.lit(" "), rest)).otherwise(""))
        return F.when(x.k.isNull(), F.struct(F.lit(0).alias("n"), x.run.alias("to"))).otherwise(F.struct(F.lit(1).alias("n"), out.alias("to")))

    return let(F.struct(run.alias("run"), F.split(run, " ").alias("groups")), tried)


def _day_first(m: Column) -> Column:
    """Whether a date with slashes has the day first: its first number can be no month."""
    return m.contains("/") & (F.substr(m, F.lit(1), F.lit(2)).cast("int") > 12)


def _day(m: Column) -> Column:
    """The day that a date in one of the forms names; null if there is none."""
    iso = F.regexp_extract(m, r"^(\d{4}-\d{2}-\d{2})$", 1)
    american = F.regexp_replace(m, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$1-$2")
    european = F.regexp_replace(m, r"^(\d{2})[./](\d{2})[./](\d{4})$", "$3-$2-$1")
    return F.when(iso != "", iso.try_cast("date")).when(m.contains("/") & ~_day_first(m), american.try_cast("date")).otherwise(european.try_cast("date"))


def _date_ok(m: Column) -> Column:
    return F.coalesce(_day(m).between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date")), F.lit(False))


def _date(m: Column, key: str) -> Column:
    n = F.datediff(_day(m), F.lit("1800-01-01").cast("date"))
    p = permute_pair(F.floor(n / 773), n % 773, (189, 773), key, "date")
    new = let(p, lambda x: F.date_add(F.lit("1800-01-01").cast("date"), (x.a * 773 + x.b).cast("int")))
    return F.when(m.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(_day_first(m), F.date_format(new, "dd/MM/yyyy")).when(m.contains("/"), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # every text with a find holds this character or matches it
    valid: Callable[[Column], Column]
    pseudonym: Callable[[Column, str], Column]
    hidden: bool = False  # whether later kinds must not find values in its pseudonyms
    parts: Callable[[Column, str, Callable], Column] | None = None  # instead of both: number of values in a match, and what it becomes


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What a phone separator may not lead into: an address, a date or a social security number.
_OTHER = rf"(?: (?:{_OCTET}(?:\.{_OCTET}){{3}}(?![\w-]|\.\d)|\d{{4}}-\d{{2}}-\d{{2}}(?!\d)|(?:\d{{2}}/\d{{2}}/|\d{{2}}\.\d{{2}}\.)\d{{4}}(?!\d)|\d{{3}}-\d{{2}}-\d{{4}}(?!\d)))"
_BETWEEN = rf"(?:(?!{_OTHER})[ .-])?"
#: A last group after a space is a whole number, not the first digits of an address, date, decimal or card.
_LAST = r"(?: (?!\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d))\d{2,4}(?![.:/,-]?\d)|[.-]?\d{2,4})?"
#: More than 15 digits; written out, as a lookbehind may hold no repeated group.
_LONG = r"\+" + r"[^\d+]{0,2}\d" * 16 + r"(?:[^\d+]{0,2}\d)?" * 3
#: Ten digits grouped 3-3-4 as in North America, which need no country code.
_NATIONAL = r"(?<![\w+.)-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[.-]\d{4}(?![\w-]|\.\d)"
_PHONE = (
    r"(?<![\w+])\+(?:1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|\d{{1,3}}{_BETWEEN}\(?\d{{2,4}}\)?{_BETWEEN}\d{{3,4}}{_BETWEEN}\d{{2,4}}{_LAST}(?!\d)(?<!{_LONG}))|"
    + _NATIONAL
)
KINDS = (
    Kind("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", "@", lambda m: F.lit(True), _email),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", r"[A-Z]{2}\d{2}", _iban_ok, _iban, hidden=True, parts=_ibans),
    Kind("phone", _PHONE, r"\+\d|[.-]\d{4}", _phone_ok, _phone, hidden=True),
    Kind("card", r"(?<![\w.+-])\d[\d -]{11,}\d(?![\w-]|\.\d)", r"\d[\d -]{11}", _card_ok, _card, parts=_cards),
    Kind("ipv4", rf"(?<![\w.-]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w-]|\.\d)", r"\d\.\d", lambda m: F.lit(True), _ipv4),
    Kind("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", r"\d-\d", _ssn_ok, _ssn),
    Kind("date", r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)", r"\d\d[-/.]\d", _date_ok, _date),
)
#: Characters for private use that stand for the digits of hidden pseudonyms; nothing is hidden in a text that holds one.
_DIGITS, _MASKS = "0123456789", "".join(chr(0xE0D0 + i) for i in range(10))


def pseudonymise(docs: DataFrame, key: str, counts: bool = True) -> DataFrame:
    """docs with pseudonyms in text, and the number of values replaced of each kind as n_<kind> (replacing columns of that name)."""
    new = [f"n_{k.name}" for k in KINDS] if counts else []
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in new]).alias("row")
    df = docs.select(row, F.col("text").cast("string").alias("t"))
    df = df.withColumns({"some": F.col("t").rlike("[0-9@]"), "open": F.col("t").rlike(f"[{_MASKS}]")})
    none = F.array().cast("array<string>")
    for k in KINDS:
        needs = F.col("t").contains(k.needs) if len(k.needs) == 1 else F.col("t").rlike(k.needs)
        df = df.withColumn("found", F.when(F.col("some") & needs, F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))).otherwise(none))
        df = df.withColumn("new", _replaced(k, key))
        gaps = F.split("t", k.pattern, -1)
        text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col("new"), i).to, F.lit("")))), "")
        df = df.withColumns({"t": F.when(F.size("found") > 0, text).otherwise(F.col("t")), f"n_{k.name}": F.aggregate("new", F.lit(0), lambda n, x: n + x.n).cast("long")}).drop("found", "new")
    masked = reduce(lambda a, b: a | b, [F.col(f"n_{k.name}") > 0 for k in KINDS if k.hidden])
    df = df.withColumn("t", F.when(masked & ~F.col("open"), F.translate("t", _MASKS, _DIGITS)).otherwise(F.col("t")))
    kept = [F.col("t").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in new]
    return df.select(*kept, *new)


def _replaced(kind: Kind, key: str) -> Column:
    hide = lambda to: F.when(F.col("open"), to).otherwise(F.translate(to, _DIGITS, _MASKS)) if kind.hidden else to
    if kind.parts:
        return F.transform("found", lambda m: kind.parts(m, key, hide))
    checked = F.transform("found", lambda m: F.struct(m.alias("m"), F.coalesce(kind.valid(m), F.lit(False)).alias("ok")))
    return F.transform(checked, lambda x: F.struct(x.ok.cast("int").alias("n"), F.when(x.ok, let(kind.pseudonym(x.m, key), hide)).otherwise(x.m).alias("to")))


def without_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms; n_chars, if there, is set anew."""
    out = pseudonymise(docs, key, counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
