"""Check-digit queries over identifiers derived from order keys.

A base number is computed from the key with the same arithmetic in both engines; part
of the derived identifiers carry a right check digit and part a wrong one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def number(digits: int, salt: int) -> Column:
    """``digits`` digits that depend on the order key."""
    return F.lpad(((F.col("o_orderkey") * 48271 + salt) * 16807 % 10**digits).cast("string"), digits, "0")


def number_sql(digits: int, salt: int) -> str:
    return f"lpad(((o_orderkey * 48271 + {salt}) * 16807 % {10**digits})::varchar, {digits}, '0')"


def _digit(x: str, i: int | str) -> str:
    return f"substr({x}, {i}, 1)::int"


def _value(x: str, i: int | str) -> str:
    c = f"substr({x}, {i}, 1)"
    return f"(case when {c} between 'A' and 'Z' then ascii({c}) - 55 when {c} between '0' and '9' then ascii({c}) - 48 else 0 end)"


def _sum(x: str, weights: list[int], cross: bool = False, start: int = 1) -> str:
    terms = []
    for i, w in enumerate(weights):
        p = f"({_value(x, start + i)} * {w})"
        terms.append(f"({p} // 10 + {p} % 10)" if cross else p)
    return "(" + " + ".join(terms) + ")"


def _luhn_sql(x: str, n: int) -> str:
    weights = [1 if (n - i) % 2 == 0 else 2 for i in range(1, n + 1)]
    return f"{_sum(x, weights, cross=True)} % 10 = 0"


def _check(name: str, value: Callable[[], Column], value_sql: str, valid: Callable[[Column], Column], valid_sql: str) -> None:
    """Rows o_orderkey, value, valid."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", value().alias("value"))
        return rows.select("o_orderkey", "value", valid(F.col("value")).alias("valid"))

    QUERIES[name] = run
    ORACLES[name] = f"with v as (select o_orderkey, {value_sql} as value from orders) select o_orderkey, value, coalesce({valid_sql}, false) as valid from v"


_PREFIXES = ["4", "34", "51", "2221", "36", "3528", "6011", "62", "50", "99"]


def _prefix() -> Column:
    return F.get(F.array(*[F.lit(p) for p in _PREFIXES]), (F.col("o_orderkey") % 10).cast("int"))


_prefix_sql = "[" + ", ".join(f"'{p}'" for p in _PREFIXES) + "][(o_orderkey % 10)::int + 1]"

_check("card_luhn_valid", lambda: number(16, 5), number_sql(16, 5), checks.luhn, _luhn_sql("value", 16))
_check("imei_valid", lambda: number(15, 7), number_sql(15, 7), checks.imei, _luhn_sql("value", 15))
_check("aba_valid", lambda: number(9, 11), number_sql(9, 11), checks.aba, f"value <> '000000000' and {_sum('value', [3, 7, 1] * 3)} % 10 = 0")

_ISSUER_SQL = "case " + " ".join(
    f"when regexp_matches(value, '^(?:{p})') then (case when length(value) in ({', '.join(map(str, n))}) then '{name}' end)" for name, p, n in checks.ISSUERS
) + " end"


def card_issuer_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.substring(F.concat(_prefix(), number(17, 3)), 1, 16)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(value.alias("value"))
    return rows.groupBy(F.coalesce(checks.card_issuer(F.col("value")), F.lit("none")).alias("issuer")).agg(F.count("*").alias("n"), F.count_if(checks.card(F.col("value"))).alias("n_valid"))


QUERIES["card_issuer_mix"] = card_issuer_mix
ORACLES["card_issuer_mix"] = f"""
with v as (select substr({_prefix_sql} || {number_sql(17, 3)}, 1, 16) as value from orders), i as (select value, {_ISSUER_SQL} as issuer from v)
select coalesce(issuer, 'none') as issuer, count(*) as n, count(*) filter (where issuer is not null and {_luhn_sql('value', 16)}) as n_valid from i group by 1
"""

# IBAN: the right check digits for even keys, two fixed ones for others
_bban_sql = number_sql(18, 13)


def _iban() -> Column:
    bban = number(18, 13)
    rest = F.aggregate(checks.values(F.concat(bban, F.lit("131400"))), F.lit(0), lambda r, v: (r * 10 + v) % 97)
    return F.concat(F.lit("DE"), F.when(F.col("o_orderkey") % 2 == 0, F.lpad((98 - rest).cast("string"), 2, "0")).otherwise("42"), bban)


_iban_sql = f"'DE' || case when o_orderkey % 2 = 0 then lpad((98 - ({_bban_sql} || '131400')::hugeint % 97)::varchar, 2, '0') else '42' end || {_bban_sql}"
_check("iban_valid_derived", _iban, _iban_sql, checks.iban, "length(value) = 22 and (substr(value, 5) || '1314' || substr(value, 3, 2))::hugeint % 97 = 1")


def _mod_11_10_sql(x: str, n: int, start: int = 1) -> str:
    p = "10"
    for i in range(n):
        s = f"(({_digit(x, start + i)} + {p}) % 10)"
        p = f"((case {s} when 0 then 10 else {s} end) * 2 % 11)" if i == 0 else f"(list_transform([{s}], lambda s{i}: (case s{i} when 0 then 10 else s{i} end) * 2 % 11)[1])"
    return f"((11 - {p}) % 10)"


# tax id: ten digits with one digit twice for most keys, and a check digit right for two keys in three
def _ten() -> Column:
    return F.concat(F.lit("1"), F.substring(F.lit("0234567892345678923"), (F.col("o_orderkey") % 9 + 1).cast("int"), 8), F.substring(F.lit("0123456789"), (F.col("o_orderkey") % 7 + 2).cast("int"), 1))


_ten_sql = "'1' || substr('0234567892345678923', (o_orderkey % 9 + 1)::int, 8) || substr('0123456789', (o_orderkey % 7 + 2)::int, 1)"


def _tax() -> Column:
    return F.concat(_ten(), (F.col("o_orderkey") % 10).cast("string"))


_counts_sql = "list_transform(range(10), lambda d: 10 - length(replace(substr(value, 1, 10), d::varchar, '')))"
_check(
    "tax_id_valid_derived", _tax, f"{_ten_sql} || (o_orderkey % 10)::varchar", checks.tax_id,
    f"len(list_filter({_counts_sql}, lambda c: c > 1)) = 1 and list_max({_counts_sql}) <= 3 "
    f"and not regexp_matches(substr(value, 1, 10), '{'|'.join(str(d) * 3 for d in range(10))}') and {_mod_11_10_sql('value', 10)} = {_digit('value', 11)}",
)

_check("vat_de_valid_derived", lambda: F.concat(F.lit("DE"), number(9, 17)), f"'DE' || {number_sql(9, 17)}", checks.vat_de, f"substr(value, 3, 1) <> '0' and {_mod_11_10_sql('value', 8, 3)} = {_digit('value', 11)}")

def _letter() -> Column:
    return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("o_orderkey") % 26 + 1).cast("int"), 1)


_letter_sql = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (o_orderkey % 26 + 1)::int, 1)"
_check(
    "kvnr_valid_derived", lambda: F.concat(_letter(), number(9, 19)), f"{_letter_sql} || {number_sql(9, 19)}", checks.kvnr,
    f"{_sum('(lpad((ascii(value) - 64)::varchar, 2, chr(48)) || substr(value, 2, 8))', [1, 2] * 5, cross=True)} % 10 = {_digit('value', 10)}",
)


def _svnr() -> Column:
    return F.concat(F.lpad((F.col("o_orderkey") % 90).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 32).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 13).cast("string"), 2, "0"), number(2, 23), _letter(), number(3, 29))


_svnr_sql = f"lpad((o_orderkey % 90)::varchar, 2, '0') || lpad((o_orderkey % 32)::varchar, 2, '0') || lpad((o_orderkey % 13)::varchar, 2, '0') || {number_sql(2, 23)} || {_letter_sql} || {number_sql(3, 29)}"
_check(
    "svnr_valid_derived", _svnr, _svnr_sql, checks.svnr,
    "substr(value, 1, 2)::int between 2 and 89 and substr(value, 5, 2)::int between 1 and 12 and substr(value, 3, 2)::int between 1 and "
    "[31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][substr(value, 5, 2)::int] and "
    f"{_sum('(substr(value, 1, 8) || lpad((ascii(substr(value, 9, 1)) - 64)::varchar, 2, chr(48)) || substr(value, 10, 2))', [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1], cross=True)} % 10 = {_digit('value', 12)}",
)


def icao_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.concat(_letter(), number(7, 31), F.lit("<"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", field.alias("field")).select("o_orderkey", "field", checks.icao_digit(F.col("field")).cast("int").alias("digit"))


QUERIES["icao_digit"] = icao_check_digit
ORACLES["icao_digit"] = f"with v as (select o_orderkey, {_letter_sql} || {number_sql(7, 31)} || '<' as field from orders) select o_orderkey, field, ({_sum('field', [7, 3, 1] * 3)} % 10)::int as digit from v"


def _mrz() -> Column:
    return F.concat(F.lit("L"), number(8, 37), (F.col("o_orderkey") % 10).cast("string"), F.lit("D<<"), number(6, 41), (F.col("o_orderkey") % 7).cast("string"), F.lit("F"), number(6, 43), (F.col("o_orderkey") % 3).cast("string"), F.lit("<" * 14), F.lit("<"), (F.col("o_orderkey") % 2).cast("string"))


_mrz_sql = f"'L' || {number_sql(8, 37)} || (o_orderkey % 10)::varchar || 'D<<' || {number_sql(6, 41)} || (o_orderkey % 7)::varchar || 'F' || {number_sql(6, 43)} || (o_orderkey % 3)::varchar || '{'<' * 15}' || (o_orderkey % 2)::varchar"


def mrz_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a passport line's check digits agree."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", _mrz().alias("line"))
    line = F.col("line")

    def ok(at: int, n: int, digit: int) -> Column:
        return checks.icao_digit(F.substring(line, at, n)).cast("string") == F.substring(line, digit, 1)

    return rows.select("o_orderkey", ok(1, 9, 10).alias("number_ok"), ok(14, 6, 20).alias("born_ok"), ok(22, 6, 28).alias("ends_ok"), checks.mrz_td3(line).alias("all_ok"))


QUERIES["mrz_check_digits"] = mrz_fields


def _icao_sql(at: int, n: int) -> str:
    return f"({_sum('line', [7, 3, 1] * 15, start=at) if n == 45 else _sum('line', ([7, 3, 1] * 15)[:n], start=at)} % 10)::varchar"


_whole = "(substr(line, 1, 10) || substr(line, 14, 7) || substr(line, 22, 22))"
ORACLES["mrz_check_digits"] = f"""
with v as (select o_orderkey, {_mrz_sql} as line from orders),
f as (select o_orderkey, {_icao_sql(1, 9)} = substr(line, 10, 1) as number_ok, {_icao_sql(14, 6)} = substr(line, 20, 1) as born_ok, {_icao_sql(22, 6)} = substr(line, 28, 1) as ends_ok,
  ({_sum(_whole, ([7, 3, 1] * 13)[:39])} % 10)::varchar = substr(line, 44, 1) as whole_ok from v)
select o_orderkey, number_ok, born_ok, ends_ok, number_ok and born_ok and ends_ok and whole_ok as all_ok from f
"""


def dob_real_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (k % 34).cast("int").alias("day"), (k % 14).cast("int").alias("month"), (1890 + k % 140).cast("int").alias("year"))
    return rows.select("o_orderkey", "day", "month", "year", (checks.real_date(F.col("year"), F.col("month"), F.col("day")) & F.col("year").between(1900, 2013)).alias("valid"))


QUERIES["dob_real_dates"] = dob_real_dates
ORACLES["dob_real_dates"] = """
with v as (select o_orderkey, (o_orderkey % 34)::int as day, (o_orderkey % 14)::int as month, (1890 + o_orderkey % 140)::int as year from orders)
select *, coalesce(try_cast(lpad(year::varchar, 4, '0') || '-' || lpad(month::varchar, 2, '0') || '-' || lpad(day::varchar, 2, '0') as date) is not null and year between 1900 and 2013, false) as valid from v
"""

for _name, _weights, _modulus in (("bank_method_02", [2, 3, 4, 5, 6, 7, 8, 9, 2], 11), ("bank_method_06", [2, 3, 4, 5, 6, 7, 2, 3, 4], 11), ("bank_method_01", [3, 7, 1] * 3, 10), ("bank_method_10", [2, 3, 4, 5, 6, 7, 8, 9, 10], 11)):
    _lenient = _name != "bank_method_02"
    _from_right = "(" + " + ".join(f"{_digit('value', 9 - i)} * {w}" for i, w in enumerate(_weights)) + ")"
    _expected = f"(({_modulus} - {_from_right} % {_modulus}) % {_modulus})"
    if _modulus == 11:
        _expected = f"(case {_expected} when 10 then {0 if _lenient else -1} else {_expected} end)"
    _check(_name, lambda: number(10, 47), number_sql(10, 47), lambda v, w=_weights, m=_modulus, n=_lenient: checks.bank_method(v, w, m, n), f"{_expected} = {_digit('value', 10)}")
_w00 = "(" + " + ".join(f"(({_digit('value', 9 - i)} * {w}) // 10 + ({_digit('value', 9 - i)} * {w}) % 10)" for i, w in enumerate([2, 1] * 4 + [2])) + ")"
_check("bank_method_00", lambda: number(10, 53), number_sql(10, 53), checks.bank_method_00, f"(10 - {_w00} % 10) % 10 = {_digit('value', 10)}")
