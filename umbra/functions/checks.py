"""Check-digit and format predicates as native columns.

Each takes a string column of the compact form (no separators) and gives a boolean;
malformed or null input gives false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: registered lengths of IBANs by country (ISO 13616 registry)
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}


def value_of(char: Column) -> Column:
    """0-9 as is, A-Z as 10 to 35, anything else 0."""
    return F.when(char.between("A", "Z"), F.ascii(char) - 55).when(char.between("0", "9"), F.ascii(char) - 48).otherwise(0)


def values(text: Column) -> Column:
    return F.transform(F.split(text, ""), value_of)


def cross_sum(x: Column) -> Column:
    return F.floor(x / 10).cast("int") + x % 10


def weighted(text: Column, weights: list[int], cross: bool = False) -> Column:
    """Sum of the characters' values times the weights in turn, each product reduced to its cross sum if asked."""
    cycle = F.array(*[F.lit(w) for w in weights])

    def product(v: Column, i: Column) -> Column:
        p = v * F.get(cycle, i % len(weights))
        return cross_sum(p) if cross else p

    return F.aggregate(F.transform(values(text), product), F.lit(0), lambda total, p: total + p)


def holds(shape: str, text: Column, check: Column) -> Column:
    """The check where the shape matches in full; false elsewhere, null included."""
    return F.coalesce(F.when(F.rlike(text, F.lit(rf"^(?:{shape})\z")), check), F.lit(False))


def luhn(text: Column, shape: str = "[0-9]{2,19}") -> Column:
    return holds(shape, text, F.call_function("luhn_check", text))


def imei(text: Column) -> Column:
    return luhn(text, "[0-9]{15}")


# fixed values: issuer prefixes with the card lengths they allow
ISSUERS = [
    ("visa", "4", (13, 16, 19)),
    ("amex", "3[47]", (15,)),
    ("mastercard", "5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720", (16,)),
    ("diners", "30[0-5]|36|38", (14,)),
    ("diners", "3095|39", (14, 16)),
    ("jcb", "352[89]|35[3-8][0-9]", (16, 17, 18, 19)),
    ("discover", "6011|64[4-9]|65", (16, 17, 18, 19)),
    ("unionpay", "62", (16, 17, 18, 19)),
    ("maestro", "50|56|57|58|6304|6759|676[1-3]", (16, 17, 18, 19)),
]


def card_issuer(text: Column) -> Column:
    """Name of the first issuer whose prefix fits, null if its lengths exclude the number or none fits."""
    out = None
    for name, prefix, lengths in ISSUERS:
        fits = F.rlike(text, F.lit(f"^(?:{prefix})"))
        own = F.when(F.length(text).isin(list(lengths)), F.lit(name))
        out = F.when(fits, own) if out is None else out.when(fits, own)
    return out


def card(text: Column) -> Column:
    return holds("[0-9]{13,19}", text, F.call_function("luhn_check", text) & card_issuer(text).isNotNull())


def iban(text: Column) -> Column:
    """ISO 7064 MOD 97-10 over the rearranged form, folded value by value; length as registered."""
    rotated = values(F.concat(F.substring(text, 5, 34), F.substring(text, 1, 4)))
    rest = F.aggregate(rotated, F.lit(0), lambda r, v: F.when(v > 9, r * 100 + v).otherwise(r * 10 + v) % 97)
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return holds("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text, (F.length(text) == F.try_element_at(lengths, F.substring(text, 1, 2))) & (rest == 1))


def mod_11_10(text: Column) -> Column:
    """Check digit of ISO 7064 MOD 11,10 for the digits given."""

    def step(p: Column, d: Column) -> Column:
        s = (d + p) % 10
        return F.when(s == 0, 10).otherwise(s) * 2 % 11

    product = F.aggregate(values(text), F.lit(10), step)
    return (11 - product) % 10


def tax_id(text: Column) -> Column:
    """German tax identification number: 11 digits, digit frequencies of the first ten, MOD 11,10."""
    ten = F.substring(text, 1, 10)
    counts = F.transform(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.length(ten) - F.length(F.replace(ten, d, F.lit(""))))
    repeated = F.filter(counts, lambda c: c > 1)
    spread = (F.size(repeated) == 1) & (F.array_max(counts) <= 3) & ~F.rlike(ten, F.lit("|".join(str(d) * 3 for d in range(10))))
    return holds("[1-9][0-9]{10}", text, spread & (mod_11_10(ten) == F.substring(text, 11, 1).cast("int")))


def vat_de(text: Column) -> Column:
    digits = F.substring(text, 3, 9)
    return holds("DE[1-9][0-9]{8}", text, mod_11_10(F.substring(digits, 1, 8)) == F.substring(digits, 9, 1).cast("int"))


def two_digits(letter: Column) -> Column:
    return F.lpad((F.ascii(letter) - 64).cast("string"), 2, "0")


def kvnr(text: Column) -> Column:
    """German health insurance number: letter as two digits, weights 1, 2 with cross sums, modulo 10."""
    expanded = F.concat(two_digits(F.substring(text, 1, 1)), F.substring(text, 2, 8))
    return holds("[A-Z][0-9]{9}", text, weighted(expanded, [1, 2], cross=True) % 10 == F.substring(text, 10, 1).cast("int"))


def svnr(text: Column) -> Column:
    """German social security number: area, birth date, letter, serial, check digit."""
    day, month = F.substring(text, 3, 2).cast("int"), F.substring(text, 5, 2).cast("int")
    longest = F.get(F.array(*[F.lit(d) for d in (0, 31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), month)
    expanded = F.concat(F.substring(text, 1, 8), two_digits(F.substring(text, 9, 1)), F.substring(text, 10, 2))
    plausible = F.substring(text, 1, 2).cast("int").between(2, 89) & month.between(1, 12) & (day >= 1) & (day <= longest)
    right = weighted(expanded, [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1], cross=True) % 10 == F.substring(text, 12, 1).cast("int")
    return holds("[0-9]{8}[A-Z][0-9]{3}", text, plausible & right)


def aba(text: Column) -> Column:
    """US routing number."""
    return holds("[0-9]{9}", text, (text != "000000000") & (weighted(text, [3, 7, 1]) % 10 == 0))


def icao_digit(text: Column) -> Column:
    """ICAO 9303 check digit of a field of letters, digits and fillers."""
    return weighted(text, [7, 3, 1]) % 10


def mrz_td3(lower: Column) -> Column:
    """The five check digits of the lower line of a passport's machine readable zone."""

    def agrees(field: Column, at: int, filler: bool = False) -> Column:
        given = F.substring(lower, at, 1)
        ok = icao_digit(field).cast("string") == given
        return ok | (F.rlike(field, F.lit("^<+$")) & (given == "<")) if filler else ok

    number, born, ends, optional = F.substring(lower, 1, 9), F.substring(lower, 14, 6), F.substring(lower, 22, 6), F.substring(lower, 29, 14)
    whole = F.concat(F.substring(lower, 1, 10), F.substring(lower, 14, 7), F.substring(lower, 22, 22))
    return holds("[A-Z0-9<]{44}", lower, agrees(number, 10) & agrees(born, 20) & agrees(ends, 28) & agrees(optional, 43, True) & agrees(whole, 44))


def real_date(year: Column, month: Column, day: Column) -> Column:
    return F.coalesce(F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).isNotNull(), F.lit(False))


def ipv4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return holds(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}", text, F.forall(parts, lambda p: p.cast("int") <= 255))


def uuid_rfc(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$")), F.lit(False))


def bank_method_00(text: Column) -> Column:
    """German account check method 00: digits 1 to 9 of the ten, weights 2, 1 from the right with cross sums, modulo 10."""
    padded = F.lpad(text, 10, "0")
    return holds("[0-9]{1,10}", text, (10 - weighted(F.reverse(F.substring(padded, 1, 9)), [2, 1], cross=True) % 10) % 10 == F.substring(padded, 10, 1).cast("int"))


def bank_method(text: Column, weights: list[int], modulus: int, lenient: bool = True) -> Column:
    """Weighted methods over digits 1 to 9 from the right; modulo 11 with remainder 1 as 0 (lenient) or invalid."""
    padded = F.lpad(text, 10, "0")
    rest = weighted(F.reverse(F.substring(padded, 1, 9)), weights) % modulus
    expected = (modulus - rest) % modulus
    if modulus == 11:
        expected = F.when(expected == 10, F.lit(0 if lenient else -1)).otherwise(expected)
    return holds("[0-9]{1,10}", text, expected == F.substring(padded, 10, 1).cast("int"))
