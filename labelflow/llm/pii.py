"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Private values are found by pattern, validated (check digits, number ranges,
the calendar), and replaced by a keyed permutation of the set of all values of
the same format: a card number becomes another valid card number of the same
length and grouping, a date another date of the same layout. Equal values get
equal pseudonyms in every document, so they stay linked; with the key the
permutation can be undone. Values that fail validation are left alone.

Every permutation is a balanced Feistel network whose round function is a
SHA-256 of the key, the kind of value, the round and the other half:

- digits: halves are numbers, added modulo a power of ten;
- an address of four bytes: halves are 16-bit numbers, added modulo 2**16;
- a date: the day number in its span of 2**16 days, halves of 8 bits, walking the
  cycle until the new day fits the old one's layout;
- a card number keeps the digits that name its network and gets a new check digit;
- letters and digits (mail addresses, secrets): each character of a half is
  shifted within its own class, so lengths, separators and classes stay.

Everything is a DataFrame expression; there is no Python on the executors, no
shuffle, and texts without a candidate are only scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .quality import let

ROUNDS = 8
#: First day of a span of dates that are permuted among each other, and its days; spans before and after follow on.
FIRST_DAY, DAYS = "1900-01-01", 1 << 16

IBAN_LENGTHS = "AD24 AT20 BE16 BG22 CH21 CY28 CZ24 DE22 DK18 EE20 ES24 FI18 FR27 GB22 GR27 HR21 HU28 IE22 IS26 IT27 " \
               "LI21 LT20 LU20 LV21 MC27 MT31 NL18 NO15 PL28 PT25 RO24 SE24 SI19 SK24 SM27 TR26"


def iban_pattern() -> str:
    """The country fixes the length, so that no word after the number is taken with it."""
    by_length: dict[int, list[str]] = {}
    for entry in IBAN_LENGTHS.split():
        by_length.setdefault(int(entry[2:]), []).append(entry[:2])
    forms = []
    for length, countries in sorted(by_length.items()):
        fours, rest = divmod(length - 4, 4)
        forms.append(rf"(?:{'|'.join(countries)})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}"
                     + (rf" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return rf"(?<![\w])(?:{'|'.join(forms)})(?![\w])"


# Patterns of private values. Order decides where two could start at the same place.
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|" \
         "Nov(?:ember)?|Dec(?:ember)?"
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.){1,8}[A-Za-z]{2,24}"
             r"(?![\w-])",
    "secret": r"(?i)(?<![\w/+-])(?=[\w/+-]{16})(?<=(?:token|secret|passwd|password|api_key|apikey|api-key|access_key|auth)"
              r"[\"']? ?[:=] ?[\"']?)[A-Za-z0-9_/+-]{16,128}(?![\w/+-])",
    "iban": iban_pattern(),
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?![\w])"
             r"|(?<![\w+])\+(?!1[ (.-])\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?![\w]|[.-]\d)"
             r"|(?<![\w])\(\d{3}\) ?\d{3}-\d{4}(?![\w-])"
             r"|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "iso_date": r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?![A-SU-Za-z0-9_-]|T(?!\d))",
    "slash_date": r"(?<![\w./-])\d{1,2}/\d{1,2}/\d{4}(?![\w/])",
    "dot_date": r"(?<![\w./-])\d{1,2}\.\d{1,2}\.\d{4}(?![\w])",
    "month_date": rf"(?<![\w.])\d{{1,2}} (?:{MONTHS}) \d{{4}}(?![\w])|(?<![\w])(?:{MONTHS}) \d{{1,2}}, \d{{4}}(?![\w])",
}
ANY = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in PATTERNS.values())
# Card numbers by network (first digits, lengths), solid or in the usual groups.
CARD_FORMS = (
    r"4(?:\d{12}|\d{15}|\d{18})", r"5[1-5]\d{14}", r"2[2-7]\d{14}", r"3[47]\d{13}", r"3[0689]\d{12,17}", r"35\d{14,17}",
    r"(?:50|5[6-8]|6\d)\d{11,17}",
    r"(?:4\d|5[0-8]|2[2-7]|6\d|35)\d\d(?:[ -]\d{4}){3}", r"3[47]\d\d[ -]\d{6}[ -]\d{5}", r"3[0689]\d\d[ -]\d{6}[ -]\d{4}",
)
CARD = rf"(?:{'|'.join(CARD_FORMS)})(?![0-9])"
CARD_START = rf"(?<![0-9])(?={CARD})"
#: First digits that a card keeps: they name its network. A number spans at most so many groups.
CARD_HEAD, CARD_SPAN = 2, 4
#: Runs of digits that may hold card numbers, looked for between the other values.
RUN = r"(?<![\w.+-])(?=\d(?:[ -]?\d){12})[\d -]*\d(?![\w-])"
#: A cheap test that a text can hold any of them at all: each has a digit, or is a mail address.
HINT = "[0-9@]"
KINDS = ("email", "secret", "iban", "phone", "ssn", "card", "ip", "date")


def keyed(key: str, kind: str, step: Column, half: Column) -> Column:
    """64 hex digits that depend on all arguments."""
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), step.cast("string"), F.lit("|"), half.cast("string")), 256)


def pseudo_number(hashed: Column) -> Column:
    """60 bits of a hash as a number that is never negative."""
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long")


def rounds(left: Column, right: Column, turn, back: bool) -> Column:
    """The network: ``turn(half, other, step, sign)`` changes one half by the other."""
    pair = F.struct(left.alias("a"), right.alias("b"))

    def step(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        sign = F.lit(-1 if back else 1)
        return F.struct(F.when(even, turn(p["a"], p["b"], i, sign)).otherwise(p["a"]).alias("a"),
                        F.when(even, p["b"]).otherwise(turn(p["b"], p["a"], i, sign)).alias("b"))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in order]), pair, step)


def permute_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of all digit strings of the same length (2 to 36)."""
    half = F.floor(F.length(digits) / 2).cast("int")

    def turn(x: Column, other: Column, i: Column, sign: Column) -> Column:
        size = F.pow(F.lit(10.0), F.length(x)).cast("decimal(20,0)")
        moved = x.cast("decimal(20,0)") + sign * (pseudo_number(keyed(key, kind, i, other)).cast("decimal(20,0)") % size)
        return F.lpad(((moved + size) % size).cast("decimal(20,0)").cast("string"), F.length(x), F.lit("0"))

    done = rounds(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, F.length(digits)), turn, back)
    return let(done, lambda p: F.concat(p["a"], p["b"]))


def permute_word(number: Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of the numbers below 2**32, halves of 16 bits."""
    def turn(x: Column, other: Column, i: Column, sign: Column) -> Column:
        return F.pmod(x + sign * (pseudo_number(keyed(key, kind, i, other)) % 65536), F.lit(65536).cast("long"))

    number = number.cast("long")
    return let(rounds(F.shiftright(number, 16), F.pmod(number, F.lit(65536).cast("long")), turn, back),
               lambda p: p["a"] * 65536 + p["b"])


def permute_day(day: Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of the numbers below 2**16, halves of 8 bits."""
    def turn(x: Column, other: Column, i: Column, sign: Column) -> Column:
        return F.pmod(x + sign * (pseudo_number(keyed(key, kind, i, other)) % 256), F.lit(256).cast("long"))

    day = day.cast("long")
    return let(rounds(F.shiftright(day, 8), F.pmod(day, F.lit(256).cast("long")), turn, back),
               lambda p: p["a"] * 256 + p["b"])


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def permute_characters(value: Column, key: str, kind: str, letters: Column, back: bool = False) -> Column:
    """A keyed permutation within each character's class: digits, and the first
    ``letters`` letters; case and other characters stay, so spellings of one
    value that differ in case get pseudonyms that differ in case only."""
    half = F.greatest(F.floor(F.length(value) / 2), F.lit(1)).cast("int")

    def turn(x: Column, other: Column, i: Column, sign: Column) -> Column:
        stream = let(other, lambda o: F.concat(keyed(key, kind, i, o), keyed(key, kind, i + 100, o),
                                               keyed(key, kind, i + 200, o)))

        def shifted(stream_: Column) -> Column:
            def one(c: Column, n: Column) -> Column:
                digit, letter = F.instr(F.lit(DIGITS), c), F.instr(F.lit(LOWER), c)
                by = sign * F.conv(F.substring(stream_, 3 * (n % 64) + 1, F.lit(3)), 16, 10).cast("int")
                return (F.when(digit > 0, F.substring(F.lit(DIGITS), F.pmod(digit - 1 + by, F.lit(10)) + 1, F.lit(1)))
                        .when((letter > 0) & (letter <= letters),
                              F.substring(F.lit(LOWER), F.pmod(letter - 1 + by, letters) + 1, F.lit(1)))
                        .otherwise(c))

            return F.array_join(F.transform(F.split(x, ""), one), "")

        return F.when(F.length(x) > 0, let(stream, shifted)).otherwise(x)

    low = F.translate(value, UPPER, LOWER)
    done = let(rounds(F.substring(low, F.lit(1), half), F.substring(low, half + 1, F.length(low)), turn, back),
               lambda p: F.concat(p["a"], p["b"]))
    return F.array_join(F.zip_with(F.split(done, ""), F.split(value, ""), lambda n, o: F.when(
        F.instr(F.lit(UPPER), o) > 0, F.upper(n)).otherwise(n)), "")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def regroup(digits: Column, layout: Column) -> Column:
    """Digits put in place of the digits of a layout, other characters kept."""
    return F.array_join(F.transform(
        F.split(layout, ""), lambda c, i: F.when(
            c.rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(layout, F.lit(1), i + 1))), F.lit(1)))
        .otherwise(c)), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Check sum from the right; places with index parity ``doubled`` count twice."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: let(
        c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda n, d: n + d)


def other_card(number: Column, key: str, back: bool) -> Column:
    """The first digits, another body and its check digit, in the groups of the number."""
    def body(digits: Column) -> Column:
        head = F.substring(digits, 1, CARD_HEAD)
        inner = F.substring(digits, F.lit(CARD_HEAD + 1), F.length(digits) - CARD_HEAD - 1)
        return let(F.concat(head, permute_digits(inner, key, "card", back)),
                   lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, 0) % 10, F.lit(10)).cast("string")))

    return let(let(digits_of(number), body), lambda d: regroup(d, number))


def cards(run: Column, key: str, back: bool) -> Column:
    """A run of digits with its card numbers replaced, and their number.

    The run is cut before every number that looks like a card (network, length,
    groups); each is judged by its check digit. Of valid ones that overlap the
    first is taken. A piece is looked at with the few pieces beside it that a
    number can reach, so the work grows with the run's length."""
    def looked_at(pieces: Column) -> Column:
        def one(piece: Column, i: Column) -> Column:
            ahead = F.array_join(F.slice(pieces, i + 1, CARD_SPAN), "")
            return let(F.regexp_extract(ahead, f"^{CARD}", 0), lambda c: F.struct(
                piece.alias("piece"), c.alias("card"), ((c != "") & (luhn_sum(digits_of(c), 1) % 10 == 0)).alias("valid")))

        return F.transform(pieces, one)

    def reached(found: Column, i: Column, by: str) -> Column:
        """How many characters of piece ``i`` belong to an earlier number that is marked ``by``."""
        before = F.slice(found, F.greatest(i + 2 - CARD_SPAN, F.lit(1)), F.least(i, F.lit(CARD_SPAN - 1)))
        return F.aggregate(before, F.lit(0), lambda n, f: F.greatest(
            n, F.when(f[by], F.length(f["card"])).otherwise(0)) - F.length(f["piece"]))

    def taken(found: Column) -> Column:
        return F.transform(found, lambda f, i: F.struct(f["piece"].alias("piece"), f["card"].alias("card"), (
            f["valid"] & (reached(found, i, "valid") <= 0)).alias("taken")))

    def written(marked: Column) -> Column:
        def one(f: Column, i: Column) -> Column:
            return F.when(f["taken"], F.concat(other_card(f["card"], key, back), F.substr(f["piece"], F.length(f["card"]) + 1))) \
                .otherwise(F.substr(f["piece"], F.greatest(reached(marked, i, "taken"), F.lit(0)) + 1))

        return F.struct(F.array_join(F.transform(marked, one), "").alias("text"),
                        F.size(F.filter(marked, lambda f: f["taken"])).alias("n"))

    return let(let(let(F.split(run, CARD_START, -1), looked_at), taken), written)


def without_cards(piece: Column, key: str, back: bool) -> Column:
    """A piece of text between other values with its card numbers replaced, and their number."""
    def rebuilt(new: Column) -> Column:
        return F.struct(F.array_join(F.zip_with(F.split(piece, RUN, -1), new, lambda a, b: F.concat(
            a, F.coalesce(b["text"], F.lit("")))), "").alias("text"),
            F.aggregate(new, F.lit(0), lambda n, x: n + x["n"]).alias("n"))

    runs = F.regexp_extract_all(piece, F.lit(f"({RUN})"), F.lit(1))
    return F.when(piece.rlike(RUN), let(F.transform(runs, lambda r: cards(r, key, back)), rebuilt)).otherwise(
        F.struct(piece.alias("text"), F.lit(0).alias("n")))


def mod97(letters_and_digits: Column) -> Column:
    """Remainder by 97 with letters read as 10 to 35."""
    return F.aggregate(F.split(letters_and_digits, ""), F.lit(0), lambda n, c: F.when(
        c.rlike("[0-9]"), (n * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97).otherwise(
            (n * 100 + F.instr(F.lit(UPPER), c) + 9) % 97))


def iban(value: Column, key: str, back: bool) -> Column:
    """The digits of the account are permuted, and the check digits follow."""
    def account(plain: Column) -> Column:
        country, own = F.substring(plain, F.lit(1), F.lit(2)), F.substring(plain, F.lit(5), F.length(plain))
        known = F.concat(F.lit(" " + IBAN_LENGTHS + " ")).contains(
            F.concat(F.lit(" "), country, F.length(plain).cast("string"), F.lit(" ")))
        real = known & (mod97(F.concat(own, F.substring(plain, F.lit(1), F.lit(4)))) == 1)

        def renamed(body: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return F.concat(country, check, body)

        other = let(let(permute_digits(digits_of(own), key, "iban", back), lambda d: regroup(d, own)), renamed)
        spaced = let(other, lambda o: F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(
            c == " ", c).otherwise(F.substring(o, F.length(F.regexp_replace(
                F.substring(value, F.lit(1), i + 1), " ", "")), F.lit(1)))), ""))
        return F.when(real & (F.length(digits_of(own)) >= 2), spaced).otherwise(value)

    return let(F.regexp_replace(value, " ", ""), account)


def phone(value: Column, key: str, back: bool) -> Column:
    """All digits but the country code, of seven to fifteen in all."""
    def number(head: Column) -> Column:
        rest = F.substring(value, F.length(head) + 1, F.length(value))
        count = F.length(digits_of(value))
        return let(digits_of(rest), lambda d: F.when(
            count.between(7, 15) & (F.length(d) >= 4),
            let(permute_digits(d, key, "phone", back), lambda n: F.concat(head, regroup(n, rest)))).otherwise(value))

    return let(F.regexp_extract(value, r"^\+(?:1(?=[ .(-])|7(?=[ .(-])|\d{2,3}(?=[ .(-])|\d)", 0), number)


def social_number(value: Column, key: str, back: bool) -> Column:
    """Area 001-899 but 666, group and serial not zero; the cycle is walked until it is valid again."""
    def valid(d: Column) -> Column:
        return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")

    def number(d: Column) -> Column:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(32)), permute_digits(d, key, "ssn", back), lambda x, _: F.when(
            valid(x), x).otherwise(permute_digits(x, key, "ssn", back)))
        return F.when(valid(d), let(walked, lambda n: regroup(n, value))).otherwise(value)

    return let(digits_of(value), number)


def address(value: Column, key: str, back: bool) -> Column:
    """Four bytes in the usual spelling (no leading zero)."""
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    spelled = value.rlike(r"^(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}$")

    def four(p: Column) -> Column:
        real = spelled & F.forall(p, lambda x: x <= 255)
        packed = F.aggregate(p, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
        return F.when(real, let(permute_word(packed, key, "ip", back), lambda n: F.concat_ws(
            ".", *[F.pmod(F.shiftright(n, s), F.lit(256).cast("long")).cast("string") for s in (24, 16, 8, 0)]))
        ).otherwise(value)

    return let(parts, four)


def date(value: Column, key: str, back: bool) -> Column:
    """A day of the calendar becomes another in the same layout. With slashes the
    day comes first only if the number cannot be a month. The cycle of the
    permutation is walked until the day is written with as many digits, and
    reads in the same order, as the old one; a full month name stays full, a
    zero before the day stays beside a month's name or a number without one."""
    first = F.lit(FIRST_DAY).cast("date")
    number = [F.regexp_extract(value, r"^(\d+)\D(\d+)\D(\d+)$", i).try_cast("int") for i in (1, 2, 3)]
    name = F.regexp_extract(value, "[A-Za-z]+", 0)
    month = F.floor((F.instr(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), F.substring(name, 1, 3)) + 2) / 3)
    day = F.regexp_extract(value, r"(?:^|[a-z] )(\d{1,2})[ ,]", 1).try_cast("int")
    year = F.regexp_extract(value, r"\d{4}$", 0).try_cast("int")

    iso, dotted, slashed = (value.rlike(r"^\d{4}-"), value.rlike(r"^\d{1,2}\."), value.rlike(r"^\d{1,2}/"))
    named, leading = F.length(name) > 0, value.rlike(r"^\d")
    day_first = slashed & (number[0] > 12)
    full = F.length(name) > 3
    y = F.when(iso, number[0]).when(named, year).otherwise(number[2])
    m = F.when(named, month).when(slashed & ~day_first, number[0]).otherwise(number[1])
    d = F.when(iso, number[2]).when(named, day).when(dotted | day_first, number[0]).otherwise(number[1])
    old = F.try_to_date(F.format_string("%04d-%02d-%02d", y, m.cast("int"), d), "yyyy-MM-dd")
    width = [F.length(F.regexp_extract(value, r"^(\d+)\D(\d+)\D(\d+)$", i)) for i in (1, 2)]
    wide_d = F.when(iso, 2).when(named, F.length(F.regexp_extract(value, r"(?:^|[a-z] )(\d{1,2})[ ,]", 1))).when(
        dotted | day_first, width[0]).otherwise(width[1])
    wide_m = F.when(iso | named, 2).when(dotted | day_first, width[1]).otherwise(width[0])
    plan = F.struct(F.datediff(old, first).alias("n"), d.alias("d"), m.cast("int").alias("m"), wide_d.alias("wd"),
                    wide_m.alias("wm"), (named | (wide_d != wide_m)).alias("strict"), day_first.alias("late"),
                    full.alias("full"))
    names = F.array(*[F.lit(x) for x in "January February March April May June July August September October November "
                      "December".split()])

    def renamed(p: Column) -> Column:
        def text(n: Column) -> Column:
            at = F.date_add(first, n.cast("int"))
            yy = F.lpad(F.year(at).cast("string"), 4, "0")
            mm, dd = F.lpad(F.month(at).cast("string"), p["wm"], F.lit("0")), F.lpad(F.day(at).cast("string"), p["wd"], F.lit("0"))
            word = F.get(names, F.month(at) - 1)
            word = F.when(p["full"], word).otherwise(F.substring(word, 1, 3))
            return (F.when(iso, F.concat_ws("-", yy, mm, dd)).when(named & leading, F.concat_ws(" ", dd, word, yy))
                    .when(named, F.concat(word, F.lit(" "), dd, F.lit(", "), yy)).when(dotted, F.concat_ws(".", dd, mm, yy))
                    .when(day_first, F.concat_ws("/", dd, mm, yy)).otherwise(F.concat_ws("/", mm, dd, yy)))

        def fits(n: Column) -> Column:
            at = F.date_add(first, n.cast("int"))

            def written(new: Column, was: Column, wide: Column, strict: Column) -> Column:
                return F.when(wide == 1, new < 10).otherwise(~strict | ((new < 10) == (was < 10)))

            return (F.year(at).between(1, 9999) & written(F.day(at), p["d"], p["wd"], p["strict"])
                    & written(F.month(at), p["m"], p["wm"], p["strict"] & ~named)
                    & (~p["late"] | (F.day(at) > 12)) & (~p["full"] | (F.month(at) != 5)))

        def moved(n: Column) -> Column:  # within the span of 2**16 days that the day lies in
            within = F.pmod(n, F.lit(DAYS).cast("long"))
            return n - within + permute_day(within, key, "date", back)

        def step(x: Column, _: Column) -> Column:  # the first step always, then until it fits
            return F.struct(F.when(x["found"], x["n"]).otherwise(moved(x["n"])).alias("n"),
                            x["found"].alias("found"))

        def walk(x: Column, i: Column) -> Column:
            return let(step(x, i), lambda z: F.struct(z["n"].alias("n"), fits(z["n"]).alias("found")))

        start = F.struct(p["n"].cast("long").alias("n"), F.lit(False).alias("found"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(2000)), start, walk)
        return F.when(fits(p["n"]), let(end, lambda e: F.when(e["found"], text(e["n"]))))

    return F.coalesce(let(plan, renamed), value)


def mail(value: Column, key: str, back: bool) -> Column:
    """The name and the domain's labels; the top-level domain stays."""
    top = F.regexp_extract(value, r"\.[A-Za-z]+$", 0)
    rest = F.substring(value, F.lit(1), F.length(value) - F.length(top))
    return F.concat(permute_characters(rest, key, "email", F.lit(26), back), top)


def secret(value: Column, key: str, back: bool) -> Column:
    """Hexadecimal digits stay hexadecimal."""
    letters = F.when(value.rlike("^[0-9A-Fa-f_/+-]+$"), 6).otherwise(26)
    return F.when(value.rlike("[0-9]"), let(letters, lambda n: permute_characters(value, key, "secret", n, back))
                  ).otherwise(value)


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one found value, or the value if it is not valid."""
    def is_a(kind: str) -> Column:
        return value.rlike(f"^(?:{bare(kind)})$")

    dates = is_a("iso_date") | is_a("slash_date") | is_a("dot_date") | is_a("month_date")
    return (
        F.when(is_a("email"), mail(value, key, back))
        .when(is_a("iban"), iban(value, key, back))
        .when(is_a("ssn"), social_number(value, key, back))
        .when(is_a("ip"), address(value, key, back))
        .when(dates, date(value, key, back))
        .when(is_a("phone"), phone(value, key, back))
        .otherwise(secret(value, key, back)))


def bare(kind: str) -> str:
    """A pattern without the tests of what stands around the value."""
    import re

    return re.sub(r"\(\?<?!(?:[^()\[\]]|\[[^\]]*\])*\)", "", PATTERNS[kind])


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``text`` pseudonymised, plus ``n_private``
    (long), the number of values replaced.

    ``back=True`` undoes it. A null text stays null, an empty one empty;
    repeated rows get equal results; an empty table gives an empty table; an
    input column called ``n_private`` is replaced."""
    value = F.col(text).cast("string")
    found = F.when(value.rlike(HINT), F.regexp_extract_all(value, F.lit(f"({ANY})"), F.lit(1)))

    def rebuilt(values: Column) -> Column:
        new = F.transform(values, lambda v: pseudonym(v, key, back))
        between = F.transform(F.split(value, ANY, -1), lambda piece: without_cards(piece, key, back))
        return let(F.struct(new.alias("new"), between.alias("between")), lambda x: F.struct(
            F.array_join(F.zip_with(x["between"], x["new"], lambda a, b: F.concat(
                a["text"], F.coalesce(b, F.lit("")))), "").alias("text"),
            (F.aggregate(F.zip_with(values, x["new"], lambda a, b: F.when(a == b, 0).otherwise(1)),
                         F.lit(0).cast("long"), lambda x, y: x + y)
             + F.aggregate(x["between"], F.lit(0).cast("long"), lambda n, a: n + a["n"])).alias("n")))

    done = let(found, lambda v: F.when((F.size(v) > 0) | value.rlike(RUN), rebuilt(v)))
    names = [c for c in docs.columns if c != "n_private"]
    changed = docs.withColumn("_done", done)
    return changed.select(
        *[F.coalesce("_done.text", value).alias(text) if c == text else changed[c] for c in names],
        F.coalesce("_done.n", F.lit(0).cast("long")).alias("n_private"))


#: The query's key; a user passes their own.
DEMO_KEY = "corpus-demo-key"


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Every document text with its private values replaced."""
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
