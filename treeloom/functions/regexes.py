"""Regular expression builtins. Patterns are those of Java."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .strings import STRINGS, string
from .values import BOOL, C, QueryError


def pattern(a) -> str:
    p = a.val(0).lit
    if not isinstance(p, str):
        raise QueryError("a pattern must be a literal string")
    return p


def groups(p: str) -> int:
    """Capturing groups of a pattern."""
    n, i, inside = 0, 0, False
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            inside = True
        elif p[i] == "]":
            inside = False
        elif p[i] == "(" and not inside and (p[i + 1:i + 2] != "?" or p[i + 1:i + 4] not in ("?<=", "?<!") and p[i + 1:i + 3] == "?<"):
            n += 1
        i += 1
    return n


string("re_match", to=BOOL)(lambda s, a: F.rlike(s, F.lit(pattern(a))))
string("match_first")(lambda s, a: F.regexp_substr(s, F.lit(pattern(a))))
string("match_all", to=STRINGS)(lambda s, a: F.regexp_extract_all(s, F.lit(pattern(a)), 0))
string("split_re", to=STRINGS)(lambda s, a: F.split(s, pattern(a), -1))
string("replace_all_re")(lambda s, a: F.regexp_replace(s, pattern(a), a.val(1).col))


def _captured(s, p):
    """All groups of the first match; one that took no part is null, which an
    empty result and a pattern without it tell apart."""
    parts = [F.regexp_extract(s, p, i) for i in range(groups(p) + 1)]
    return F.array(parts[0], *[F.nullif(x, F.lit("")) for x in parts[1:]])


@string("captures", to=STRINGS)
def captures(s, a):
    p = pattern(a)
    return F.when(F.rlike(s, F.lit(p)), _captured(s, p))


@string("captures_all", to=T.ArrayType(STRINGS))
def captures_all(s, a):
    p = pattern(a)
    return C(F.transform(F.regexp_extract_all(s, F.lit(p), 0), lambda m: _captured(m, p)), T.ArrayType(STRINGS))


@string("replace_re")
def replace_re(s, a):
    p = pattern(a)
    hit = F.regexp_substr(s, F.lit(p))
    at = F.position(hit, s)
    return F.when(hit.isNull(), s).otherwise(F.concat(F.substr(s, F.lit(1), at - 1), F.regexp_replace(hit, f"^(?:{p})", a.val(1).col), F.substr(s, at + F.char_length(hit))))
