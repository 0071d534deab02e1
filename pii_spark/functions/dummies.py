"""Replacement values for the 26 labels, as expressions over a keyed hash.

The same (salt, label, original, attempt) always gives the same dummy, so retried tasks and
reruns agree, and equal originals share one dummy without any shared state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pii_spark.functions import fixed_values as fv
from pii_spark.functions.offsets import bind, let_sql, text_literal

_DRAWS = 6


def draw_sql(key: str, i: str) -> str:
    return f"CAST(conv(substring(md5(concat_ws('|', {key}, {i})), 1, 8), 16, 10) AS BIGINT)"


def hash_draw(key: Column, i: int) -> Column:
    """Non-negative BIGINT below 2^32 from ``key`` and the draw number."""
    return let_sql(key, draw_sql("x", str(i)))


def words_sql(pool: list[str]) -> str:
    """The pool as one literal array."""
    return f"split({text_literal('|'.join(pool))}, '[|]')"


def words(pool: list[str]) -> Column:
    return F.expr(words_sql(pool))


def _number(i: int, low: int, span: int) -> str:
    return f"CAST(d[{i}] % {span} + {low} AS STRING)"


def _pick(pool: list[str], i: int) -> str:
    return f"get({words_sql(pool)}, CAST(d[{i}] % {len(pool)} AS INT))"


def _other(pool: list[str], original: str) -> str:
    """A word of the pool other than ``original``; ``original`` itself if there is no other."""
    return bind(
        f"array_remove({words_sql(pool)}, {original})", "rest",
        f"CASE WHEN size(rest) > 0 THEN get(rest, CAST(d[0] % size(rest) AS INT)) ELSE {original} END",
    )


def _letter(i: int, span: int = 26) -> str:
    return f"substring('{fv.LETTERS}', CAST(d[{i}] % {span} + 1 AS INT), 1)"


def _characters(chars: str, length: str, key: str) -> str:
    digest = "concat(" + ", ".join(f"md5(concat_ws('|', {key}, 'c{j}'))" for j in range(3)) + ")"
    one = (
        f"substring({text_literal(chars)}, "
        f"CAST(conv(substring(hex, 2 * i + 1, 2), 16, 10) AS INT) % {len(chars)} + 1, 1)"
    )
    return bind(digest, "hex", f"array_join(transform(sequence(0, {length} - 1), i -> {one}), '')")


def _generators(original: str, key: str) -> dict[str, str]:
    """SQL text per label, over the draws ``d``."""
    third = f"substring({original}, 3, 1)"
    sep = f"CASE WHEN {third} IN ('/', '-') THEN {third} ELSE '/' END"
    phone = ", ".join([_number(0, 200, 800), _number(1, 200, 800), _number(2, 1000, 9000)])
    card = f"concat_ws(' ', {', '.join(_number(i, 1000, 9000) for i in range(4))})"
    iban = ", ".join(_number(i, 1000, 9000) for i in range(2, 6))
    zip_code = _number(0, 10000, 89999)
    building = _number(0, 1, 999)

    def dashed(*parts: str) -> str:
        return f"concat_ws('-', {', '.join(parts)})"

    def joined(*parts: str) -> str:
        return f"concat({', '.join(parts)})"

    def two(i: int, low: int, span: int) -> str:
        return f"lpad({_number(i, low, span)}, 2, '0')"

    return {
        "EMAIL": joined(_pick(fv.EMAIL_FIRST, 0), "'.'", _pick(fv.EMAIL_LAST, 1), "'@'", _pick(fv.EMAIL_DOMAINS, 2)),
        "PHONENUMBER": (
            f"CASE d[3] % 3 WHEN 0 THEN concat_ws('-', {phone}) WHEN 1 THEN concat_ws('.', {phone}) "
            f"ELSE format_string('(%s) %s-%s', {phone}) END"
        ),
        "SSN": dashed(_number(0, 100, 900), _number(1, 10, 90), _number(2, 1000, 9000)),
        "CREDITCARDNUMBER": f"CASE d[4] % 2 WHEN 0 THEN {card} ELSE translate({card}, ' ', '-') END",
        "USERNAME": joined(_pick(fv.USERNAME_PREFIXES, 1), _number(0, 1000, 9000)),
        "DATEOFBIRTH": joined(two(1, 1, 12), sep, two(2, 1, 28), sep, _number(0, 1950, 55)),
        "STREET": _pick(fv.STREETS, 0),
        "ZIP": f"CASE WHEN substring({original}, 6, 1) = '-' THEN {dashed(zip_code, _number(1, 1000, 8999))} ELSE {zip_code} END",
        "CITY": _other(fv.CITIES, original),
        "BUILDINGNUM": f"CASE WHEN d[1] % 10 < 3 THEN {joined(building, _letter(2, 6))} ELSE {building} END",
        "FIRSTNAME": _other(fv.FIRST_NAMES, original),
        "SURNAME": _other(fv.SURNAMES, original),
        "IDCARDNUM": dashed(_number(0, 10, 90), _number(1, 1000000, 8999999)),
        "DRIVERLICENSENUM": joined(_letter(0), _number(1, 100000000, 899999999)),
        "TAXNUM": dashed(_number(0, 10, 89), _number(1, 1000000, 8999999)),
        "URL": joined("'https://www.'", _pick(fv.URL_DOMAINS, 0), "'.'", _pick(fv.URL_TLDS, 1), _pick(fv.URL_PATHS, 2)),
        "COMPANYNAME": joined(_pick(fv.COMPANY_PREFIXES, 0), "' '", _pick(fv.COMPANY_SUFFIXES, 1)),
        "STATE": _other(fv.STATES, original),
        "COUNTRY": _other(fv.COUNTRIES, original),
        "PASSPORTID": joined(_letter(0), _letter(1), _number(2, 1000000, 8999999)),
        "NATIONALID": dashed(_number(0, 100, 900), _number(1, 1000, 9000), _number(2, 1000, 9000)),
        "LICENSEPLATENUM": joined(_letter(0), _letter(1), _letter(2), "'-'", _number(3, 1000, 9000)),
        "PASSWORD": _characters(fv.PASSWORD_CHARS, "CAST(d[0] % 5 + 12 AS INT)", key),
        "IBAN": joined(_pick(fv.IBAN_COUNTRIES, 0), _number(1, 10, 90), "' '", f"concat_ws(' ', {iban})"),
        "AGE": _number(0, 18, 68),
        "SECURITYTOKEN": joined(_pick(fv.TOKEN_PREFIXES, 1), _characters(fv.TOKEN_CHARS, "CAST(d[0] % 9 + 32 AS INT)", key)),
    }


def dummy_sql(label: str, original: str, salt: str = "", attempt: str = "0") -> str:
    """SQL text of the dummy for ``original``; unknown labels give ``[REDACTED]``.

    A label's branch is evaluated only for rows with that label.
    """
    seed = f"concat_ws('|', {text_literal(salt)}, {label}, {original}, {attempt})"
    cases = " ".join(f"WHEN '{name}' THEN {value}" for name, value in _generators(original, "seed").items())
    value = f"CASE {label} {cases} ELSE '{fv.GENERIC_DUMMY}' END"
    draws = f"transform(sequence(0, {_DRAWS - 1}), i -> {draw_sql('seed', 'i')})"
    return bind(seed, "seed", bind(draws, "d", value))


def generate_dummy(label: Column, original: Column, salt: str = "", attempt: Column | None = None) -> Column:
    """Dummy value for ``original``."""
    tries = F.lit(0) if attempt is None else attempt
    inputs = F.struct(label.alias("label"), original.alias("original"), tries.alias("attempt"))
    return let_sql(inputs, dummy_sql("x.label", "x.original", salt, "x.attempt"))
