"""Common Log Format lines to typed columns, with native expressions only.

Most lines are canonical: ten tokens between single spaces. Those are cut with one plain split and
checked for the exact shape. Anything else goes through one regular expression that follows the
format token by token. Both ways end in the same nine tokens.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.clock import datetime_from_parts, datetime_parts
from trafficlens.schema import METHODS

# One separator is exactly one space; text tokens may be empty; any one character may follow the
# closing bracket and the closing quote; one trailing space is tolerated. A request of another form
# leaves its three groups empty. Lines of a file hold no line feed, so that is the group separator.
_END_OF_LINE = r"(?:\r|\x{85}|\x{2028}|\x{2029})?"
LINE_PATTERN = (
    r"(?s)^([^ ]*+) ([^ ]*+) ([^ ]*+) \[([^\]]*+)\]."
    r'"(?:(' + "|".join(METHODS) + r') ([^\s"]++) HTTP/(\d[^"\n\r\x{85}\x{2028}\x{2029}]\d)'
    + _END_OF_LINE
    + r'|[^"]*+)".'
    r"([^ ]*+) (?:([^ ]++) ?| )\z"
)
TOKENS = ["host", "ident", "auth_user", "datetime", "method", "resource", "version", "status", "bytes"]
# Protocols taken by the plain split; any other one goes through the pattern.
_COMMON_PROTOCOLS = ['HTTP/1.0"', 'HTTP/1.1"', 'HTTP/2.0"']
_SEPARATOR = "\\n"
_TOKEN_TEMPLATE = _SEPARATOR.join(f"${i + 1}" for i in range(len(TOKENS)))


_METHOD_PIECES = ", ".join(f"'\"{m}'" for m in METHODS)
_PROTOCOL_PIECES = ", ".join(f"'{p}'" for p in _COMMON_PROTOCOLS)

# The ten space separated pieces `_s` have the exact shape of a well formed line.
_CANONICAL = f"""
    size(_s) = 10
    AND startswith(get(_s, 3), '[') AND instr(get(_s, 3), ']') = 0
    AND length(get(_s, 4)) = 6 AND instr(get(_s, 4), ']') = 6
    AND get(_s, 5) IN ({_METHOD_PIECES})
    AND get(_s, 6) <> '' AND NOT get(_s, 6) RLIKE r'["\\s]'
    AND get(_s, 7) IN ({_PROTOCOL_PIECES})
    AND get(_s, 9) <> ''"""
_CANONICAL_TOKENS = """array(
    get(_s, 0), get(_s, 1), get(_s, 2),
    concat(substring(get(_s, 3), 2), ' ', substring(get(_s, 4), 1, 5)),
    substring(get(_s, 5), 2), get(_s, 6), substring(get(_s, 7), 6, 3),
    get(_s, 8), get(_s, 9))"""


def strict_integer(text: str, dtype: str) -> str:
    """SQL: optional sign and digits only, null when malformed or out of the type's range.

    The guard keeps `-` and the like off the cast, which is slow when it fails.
    """
    return rf"CASE WHEN {text} RLIKE r'^[+-]?[0-9]+\z' THEN try_cast({text} AS {dtype}) END"


def section_sql(resource: str) -> str:
    from_first = f"substring({resource}, instr({resource}, '/'))"
    second = f"locate('/', {from_first}, 2)"
    return (
        f"CASE WHEN instr({resource}, '/') > 0 AND {second} > 0 "
        f"THEN substring({from_first}, 1, {second} - 1) END"
    )


def section(resource: str = "resource") -> Column:
    """Text from the first slash up to the second one, null without a second."""
    return F.expr(section_sql(resource))


def parse_clf(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add the typed access-log columns, `section` and `reject_reason` (null for a good line).

    All other columns of `lines` are kept. The parsed columns come out of a generator, which
    filters are not pushed below: a filter on a parsed column would otherwise re-run the parsing.
    """
    keep = [f"`{c}`" for c in lines.columns]
    token = {name: f"get(_t, {i})" for i, name in enumerate(TOKENS)}
    by_pattern = (
        f"split(regexp_replace(`{line_col}`, r'{LINE_PATTERN}', '{_TOKEN_TEMPLATE}'), '{_SEPARATOR}')"
    )
    typed = (
        lines.selectExpr(*keep, f"split(`{line_col}`, ' ') AS _s")
        .selectExpr(
            *keep,
            f"CASE WHEN {_CANONICAL} THEN {_CANONICAL_TOKENS} "
            f"WHEN instr(`{line_col}`, '{_SEPARATOR}') > 0 THEN array(`{line_col}`) ELSE {by_pattern} END AS _t",
        )
        .selectExpr(*keep, "_t", f"{datetime_parts(token['datetime'])} AS _p")
        .selectExpr(
            *keep,
            "_t",
            f"{datetime_from_parts('_p')} AS _ts",
            f"{strict_integer(token['status'], 'INT')} AS _status",
            f"{strict_integer(token['bytes'], 'BIGINT')} AS _bytes",
        )
    )
    reason = f"""CASE
        WHEN size(_t) <> {len(TOKENS)} THEN 'structure'
        WHEN _ts IS NULL THEN 'datetime'
        WHEN {token["method"]} = '' THEN 'request'
        WHEN _status IS NULL THEN 'status'
        WHEN _bytes IS NULL THEN 'bytes' END"""
    row = f"""named_struct(
        'host', {token["host"]}, 'ident', {token["ident"]}, 'auth_user', {token["auth_user"]},
        'ts', _ts, 'method', {token["method"]}, 'resource', {token["resource"]},
        'version', {token["version"]}, 'status', _status, 'bytes', _bytes,
        'section', {section_sql(token["resource"])}, 'reject_reason', {reason})"""
    return typed.selectExpr(*keep, f"inline(array({row}))")
