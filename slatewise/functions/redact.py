"""Masking of secrets in text and JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.functions import formats as fmt



def _sign(c: str) -> str:
    """A character of a secret word: any case, as it is or percent-encoded."""
    codes = {f"%{ord(x):02x}" for x in (c.lower(), c.upper())}
    return f"(?:{c}|{'|'.join(sorted(codes))})"


_GAP = r"(?:[_.-]|%5f|%2e|%2d)"
_PLAIN = r"(?:[a-z0-9_.-]|%5f|%2e|%2d)*"
# All patterns follow from the one list of names: a secret word with separators anywhere inside it, anything around it.
_PARTS = "|".join((_GAP + "?").join(map(_sign, word)) for word in fmt.SECRET_PARTS)
_ENDING = "".join(map(_sign, fmt.SECRET_ENDING)) + _GAP + "*"
_NAME = f"{_PLAIN}(?:{_PARTS}){_PLAIN}|{_PLAIN}{_ENDING}|{'|'.join(fmt.SECRET_NAMES)}"
# What one of the patterns below needs somewhere in a text; most texts hold none of it.
HINT = f"(?i){_PARTS}|{_ENDING}|{'|'.join(fmt.SECRET_NAMES)}|https?(?:://|%3a%2f%2f)"
# A value is quoted (to the end of the line where the quote stays open), bracketed, or runs to the next separator. Brackets nest
# `DEPTH` deep; where they go deeper or stay open, the rest of the line belongs to the value.
DEPTH = 12
_STRINGS = r""""(?:[^"\\\r\n]++|\\.)*+"|'(?:[^'\\\r\n]++|\\.)*+'"""
_NESTED = r"""[\[{](?:[^\[\]{}"'\r\n]++|""" + _STRINGS + r""")*+[\]}]"""
for _ in range(DEPTH - 1):
    _NESTED = r"""[\[{](?:[^\[\]{}"'\r\n]++|""" + _STRINGS + "|" + _NESTED + r""")*+[\]}]"""
_VALUE = r"""(?:"(?:[^"\\\r\n]++|\\.)*+"?|'(?:[^'\\\r\n]++|\\.)*+'?|""" + _NESTED + r"""|[\[{][^\r\n]*+|[^,;&\r\n}\]]*+)"""

# A name reaches to the end of its word, so words that no sign follows are passed over at once.
_ASSIGNED = r"""(?=[a-z0-9_.%-]++["']?\s*+[:=])"""
ASSIGNMENT = rf"""(?i)(^|[^a-z0-9_.%-]){_ASSIGNED}((?:{_NAME})["']?\s*[:=]\s*+)(?!\[redacted\]){_VALUE}"""
AUTH_HEADER = r"(?i)(^|[^A-Za-z0-9_-])((?:proxy-)?authorization|set-cookie|cookie)(\s*[:=]\s*)[^\r\n]*"
URL_LOGIN = r"(?i)(https?(?:://|%3a%2f%2f))[^\s/?#]*(?:@|%40)"
URL_SECRET = rf"(?i)((?:[?&#]|%3f|%26|%23)(?:{_NAME})(?:=|%3d))[^&#\s\"'<>,]*"


def redact_text(text: Column) -> Column:
    """Mask secret assignments, authorisation headers, URL logins and secret query values.

    Names may be percent-encoded, also inside an encoded URL (the rest of which is then masked). A login ends at the last `@`.
    """
    no_query = F.regexp_replace(text, URL_SECRET, "$1" + fmt.REDACTED)
    no_header = F.regexp_replace(no_query, AUTH_HEADER, "$1$2$3" + fmt.REDACTED)
    no_value = F.regexp_replace(no_header, ASSIGNMENT, f'$1$2"{fmt.REDACTED}"')
    return F.when(text.rlike(HINT), F.regexp_replace(no_value, URL_LOGIN, "$1")).otherwise(text)


_SECRET = re.compile("|".join([*fmt.SECRET_PARTS, f"{fmt.SECRET_ENDING}$", *(f"^{name}$" for name in fmt.SECRET_NAMES)]))


def secret_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "").rlike(_SECRET.pattern)


def _mask_document(text: str) -> str:
    """A JSON document with the values under secret names replaced; the walk keeps its own stack, so depth is no matter."""
    if text.lstrip()[:1] not in ("{", "["):
        return text
    try:
        document = json.loads(text)
    except (ValueError, RecursionError):
        return text
    changed, open_parts = False, [document]
    while open_parts:
        part = open_parts.pop()
        for place, value in part.items() if isinstance(part, dict) else enumerate(part):
            if isinstance(part, dict) and _SECRET.search(re.sub(r"[^a-z0-9]", "", place.lower())):
                changed |= value != fmt.REDACTED
                part[place] = fmt.REDACTED
            elif isinstance(value, (dict, list)):
                open_parts.append(value)
    return json.dumps(document, ensure_ascii=False) if changed else text


@F.pandas_udf(T.StringType())
def redact_json(text: pd.Series) -> pd.Series:
    """Replace the whole value, of any type, under secret names of a JSON document."""
    return text.map(_mask_document, na_action="ignore")


def redact(df: DataFrame, columns: list[str], json_columns: list[str] = (), flag: str = "redacted") -> DataFrame:
    """Mask text and JSON columns and say per row whether anything changed."""
    safe = {f"_safe_{c}": redact_text(redact_json(F.col(c)) if c in json_columns else F.col(c))
            for c in [*columns, *json_columns]}
    staged = df.withColumns(safe)
    changed = F.lit(False)
    for c in [*columns, *json_columns]:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_safe_{c}"))
    return (staged.withColumn(flag, changed)
            .withColumns({c: F.col(f"_safe_{c}") for c in [*columns, *json_columns]})
            .drop(*safe))


def redact_headers(headers: Column) -> Column:
    """Mask header values: wholly under a secret name, inside the text otherwise."""
    return F.transform(headers, lambda h: F.struct(
        h["key"].alias("key"),
        F.when(h["value"].isNotNull(),
               F.when(secret_name(h["key"]), F.lit(fmt.REDACTED).cast("binary"))
               .otherwise(redact_text(h["value"].cast("string")).cast("binary"))).alias("value")))
