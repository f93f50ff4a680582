"""Pseudonyms for personal data: keyed permutations that keep the format."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 10
#: kind: pattern; earlier kinds win where two start alike.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![0-9/-])",
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+\d{1,3}[ -]?)?(?:\(\d{3}\) ?|\d{3}[ -])\d{3}[ -]\d{4}(?![0-9A-Za-z])",
    "phone_intl": r"(?<![0-9A-Za-z+])\+\d{1,3}(?:[ -]?\d{2,4}){2,5}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Days from 1900-01-01 that a pseudonym can be, as a product of two near-equal halves.
DAYS, DAY_HALVES = 73049, (271, 270)


#: The two prefixes of an HMAC-SHA256, one block of the hash each.
Key = tuple[bytes, bytes]


def key_of(master: str, kind: str) -> Key:
    """The key of a kind, derived from the master key, so that equal digits in a card and in a telephone number are not linked."""
    block = hmac.new(master.encode(), kind.encode(), hashlib.sha256).digest().ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)


def _noise(key: Key, *parts: Column) -> Column:
    """60 bits of the HMAC-SHA256 of parts (joined by |) under key."""
    inner = F.unhex(F.sha2(F.concat(F.lit(key[0]), F.concat_ws("|", *parts).cast("binary")), 256))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(key[1]), inner), 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: Key, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """The pair (a, b), a below size_a and b below size_b, permuted among all such pairs: struct of a and b."""
    state = lambda x, y, m, n: F.struct(x.alias("x"), y.alias("y"), m.alias("m"), n.alias("n"))

    def step(s: Column, i: Column) -> Column:
        return state(s["y"], F.pmod(s["x"] + _noise(key, s["m"], s["n"], i, s["y"]), s["m"]), s["n"], s["m"])

    big = lambda c: c.cast("bigint")
    start = state(big(a), big(b), big(size_a), big(size_b))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.struct(s["x"].alias("a"), s["y"].alias("b")))


def permuted_digits(key: Key, digits: Column) -> Column:
    """A string of up to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("bigint")

    def halves(u: Column) -> Column:
        number = lambda s: F.when(s == "", F.lit(0)).otherwise(s.cast("bigint"))
        pair = feistel(key, number(F.substr(digits, F.lit(1), u)), number(F.substr(digits, u + 1)), power(u), power(n - u))
        text = lambda v, k: F.when(k == 0, F.lit("")).otherwise(F.lpad(v.cast("string"), k, F.lit("0")))
        return let(pair, lambda p: F.concat(text(p["a"], u), text(p["b"], n - u)))

    return F.when(n < 2, digits).otherwise(let(left, halves))


def permuted_local(key: Key, local: Column) -> Column:
    """The letters and digits of a string, each kept of its kind (lower, upper, digit), permuted among such strings."""
    kind = lambda c: F.when(c.rlike("[a-z]"), F.lit("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("[0-9]"), F.lit("0123456789"))

    def shifted(s: Column, by: Column, r: Column) -> Column:
        one = lambda c, i: let(kind(c), lambda al: F.when(al.isNull(), c).otherwise(F.substr(al, (F.pmod(F.instr(al, c) - 1 + _noise(key, F.lit("local"), r, i, by), F.length(al)) + 1).cast("int"), F.lit(1))))
        return F.when(s == "", s).otherwise(F.array_join(F.transform(F.split(s, ""), one), ""))

    def step(s: Column, r: Column) -> Column:
        x = shifted(s["x"], s["y"], r)
        return let(x, lambda v: F.struct(v.alias("x"), shifted(s["y"], v, r).alias("y")))

    left = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substr(local, F.lit(1), left).alias("x"), F.substr(local, left + 1).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda s: F.concat(s["x"], s["y"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _laid_out(s: Column, digits: Column) -> Column:
    """s with its digits replaced by others, one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(
        F.split(s, ""),
        start,
        lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substr(digits, a["k"], F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
        lambda a: a["out"],
    )


def _luhn(digits: Column) -> Column:
    """The check sum, 0 for a valid number."""
    value = lambda c, i: c.cast("int") * (F.lit(1) + i % 2)
    one = lambda c, i: F.when(value(c, i) > 9, value(c, i) - 9).otherwise(value(c, i))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x) % 10


def _card(key: Key, s: Column) -> Column:
    """Keeps the first digit and the check sum; null if the sum is wrong."""

    def body(d: Column) -> Column:
        n = F.length(d)
        payload = F.concat(F.substr(d, F.lit(1), F.lit(1)), permuted_digits(key, F.substr(d, F.lit(2), n - 2)))
        full = lambda p: F.concat(p, ((F.lit(10) - _luhn(F.concat(p, F.lit("0")))) % 10).cast("string"))
        return F.when((_luhn(d) == 0) & ~d.rlike("^0+$"), _laid_out(s, let(payload, full)))

    return let(_digits(s), body)


def _mod97(s: Column) -> Column:
    code = lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))
    digits = F.array_join(F.transform(F.split(s, ""), code), "")
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)


def _iban(key: Key, s: Column) -> Column:
    """Keeps country and letters, permutes the account's digits and sets the check digits; null if they are wrong."""

    def body(t: Column) -> Column:
        account = F.substr(t, F.lit(5))
        moved = lambda a, check: F.concat(a, F.substr(t, F.lit(1), F.lit(2)), check)
        new = _laid_out(account, permuted_digits(key, _digits(account)))
        checked = lambda a: F.concat(F.lpad((F.lit(98) - _mod97(moved(a, F.lit("00")))).cast("string"), 2, "0"), _digits(a))
        valid = (_mod97(moved(account, F.substr(t, F.lit(3), F.lit(2)))) == 1) & (F.length(t) <= 34)
        return F.when(valid, _laid_out(s, let(new, checked)))

    return let(F.replace(s, F.lit(" "), F.lit("")), body)


def _date(key: Key, s: Column) -> Column:
    """A calendar date of 1900 to 2099 to another, in the same layout; null if there is none.

    Of two-digit fields the first is the day, but where only the month can be first (12/25/1980): such a date goes to one
    that can only be read so, too, and others never do.
    """
    field = lambda at, n: F.substr(s, F.lit(at), F.lit(n))
    year_first = s.rlike("^[0-9]{4}-")
    month_first = ~year_first & s.contains("/") & (field(1, 2).cast("int") <= 12) & (field(4, 2).cast("int") > 12)

    def body(iso: Column) -> Column:
        day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date"))
        return let(day, lambda d: F.when((d >= 0) & (d < DAYS), again(d)))

    def at(x: Column) -> Column:
        return F.date_add(F.lit("1900-01-01").cast("date"), x.cast("int"))

    def again(d: Column) -> Column:
        m, n = DAY_HALVES
        once = lambda x: let(feistel(key, F.floor(x / n), x % n, F.lit(m), F.lit(n)), lambda p: p["a"] * n + p["b"])
        fits = lambda x: (x < DAYS) & (~month_first | (F.dayofmonth(at(x)) > 12))
        # walks the cycle until the day fits: all but 0.2 per cent (month first: 40 per cent) do at once
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(60)), once(d.cast("bigint")), lambda x, _: F.when(fits(x), x).otherwise(once(x)))
        return let(at(walked), written)

    def written(x: Column) -> Column:
        slashed = F.when(month_first, F.date_format(x, "MM/dd/yyyy")).otherwise(F.date_format(x, "dd/MM/yyyy"))
        return F.when(year_first, F.date_format(x, "yyyy-MM-dd")).when(s.contains("/"), slashed).otherwise(F.date_format(x, "dd.MM.yyyy"))

    two = F.when(month_first, F.concat_ws("-", field(1, 2), field(4, 2))).otherwise(F.concat_ws("-", field(4, 2), field(1, 2)))
    iso = F.when(year_first, s).otherwise(F.concat_ws("-", F.substr(s, F.lit(7)), two))
    return let(iso, body)


def _ip(key: Key, s: Column) -> Column:
    """Four numbers up to 255 to four others; null if one is larger."""

    def body(x: Column) -> Column:
        at = lambda i: F.get(x, F.lit(i))
        pair = feistel(key, at(0) * 256 + at(1), at(2) * 256 + at(3), F.lit(65536), F.lit(65536))
        parts = lambda p: F.concat_ws(".", *[v for h in ("a", "b") for v in (F.floor(p[h] / 256).cast("int"), (p[h] % 256).cast("int"))])
        return F.when(~F.exists(x, lambda v: v > 255), let(pair, parts))

    return let(F.transform(F.split(s, r"\."), lambda v: v.cast("int")), body)


def _tail_digits(key: Key, s: Column, most: int) -> Column:
    """The last ``most`` digits (all, if fewer) permuted, the rest as it is."""

    def body(d: Column) -> Column:
        keep = F.greatest(F.length(d) - most, F.lit(0))
        return _laid_out(s, F.concat(F.substr(d, F.lit(1), keep), permuted_digits(key, F.substr(d, keep + 1))))

    return let(_digits(s), body)


def _ssn(key: Key, s: Column) -> Column:
    valid = ~s.rlike("^(000|666|9..)-|-00-|-0000$")
    step = lambda x: _tail_digits(key, x, 9)
    bad = lambda x: x.rlike("^(000|666|9..)-|-00-|-0000$")
    return F.when(valid, F.aggregate(F.sequence(F.lit(1), F.lit(40)), step(s), lambda x, _: F.when(bad(x), step(x)).otherwise(x)))


def _email(key: Key, s: Column) -> Column:
    return let(F.split(s, "@"), lambda p: F.concat(permuted_local(key, F.get(p, F.lit(0))), F.lit("@"), F.get(p, F.lit(1))))


def pseudonyms(text: Column, key: str) -> Column:
    """Struct of the text with pseudonyms, and kinds: an array of the kinds replaced, in order."""
    change = {
        "email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card,
        "phone": lambda k, s: _tail_digits(k, s, 10), "phone_intl": lambda k, s: _tail_digits(k, s, 10),
    }

    def replaced(m: Column) -> Column:
        """The first kind whose pattern holds the whole match, its value null where it is not valid."""
        plain = {kind: p.split("(?<!", 1)[-1] for kind, p in KINDS.items()}
        whole = {kind: "^(?:" + p[p.index(")") + 1 :].rsplit("(?!", 1)[0] + ")$" for kind, p in plain.items()}
        out = None
        for kind, pattern in whole.items():
            name = kind.split("_")[0]
            one = F.struct(F.lit(name).alias("kind"), change[kind](key_of(key, name), m).alias("value"))
            out = F.when(m.rlike(pattern), one) if out is None else out.when(m.rlike(pattern), one)
        return out

    def together(t: Column, ms: Column) -> Column:
        def built(rs: Column) -> Column:
            values = F.transform(ms, lambda m, i: F.coalesce(F.get(rs, i)["value"], m))
            whole = F.array_join(F.flatten(F.zip_with(F.split(t, ANY), values, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")
            kinds = F.transform(F.filter(rs, lambda r: r["value"].isNotNull()), lambda r: r["kind"])
            return F.struct(whole.alias("text"), kinds.alias("kinds"))

        return let(F.transform(ms, replaced), built)

    nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    found = let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda ms: F.when(F.size(ms) == 0, nothing).otherwise(together(text, ms)))
    return F.when(text.rlike("[0-9@]"), found).otherwise(nothing)


def pseudonymize(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, and one count per kind (n_email, n_iban, n_date, n_ip, n_ssn, n_card, n_phone) of each row.

    Validated values are permuted by a Feistel network keyed with ``key``, within their format: cards that pass their
    check sum (first digit kept, check digit set anew), IBANs that pass theirs, calendar dates of 1900 to 2099, dotted
    quads up to 255, social security numbers in use, telephone numbers (last ten digits), and the letters and digits of an
    e-mail's local part. Each kind has a key of its own, derived from ``key``; round functions are HMACs. The same value has the same pseudonym in every document and layout of a kind, and two values never
    share one (a date that can only be month first keeps that, see ``_date``). Numbers that fail validation stay. A null text stays null. Rows count for themselves where ids repeat or are
    null; further columns are ignored; an empty table gives no rows. Nothing is shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), pseudonyms(F.col(text), key).alias("_p"))
    count = lambda k: F.coalesce(F.size(F.filter("_p.kinds", lambda x: x == k)), F.lit(0)).cast("bigint").alias(f"n_{k}")
    kinds = dict.fromkeys(k.split("_")[0] for k in KINDS)
    return rows.select(F.col("_id").alias(doc_id), F.col("_p.text").alias(text), *[count(k) for k in kinds])


def op2_query(docs: DataFrame) -> DataFrame:
    return pseudonymize(docs, key="pseudonym-key-1")
