"""String builtins. On any other kind they give the receiver back."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import BOOL, LONG, STRING, C, builtin, kind, whole

#: White space as Unicode has it, for Java's patterns.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRINGS = T.ArrayType(STRING)


def string(*names, to=STRING):
    """A builtin of a string's Column."""
    def add(f):
        @functools.wraps(f)
        def run(c, a):
            if kind(c.t) == "variant":
                c = C(F.try_variant_get(c.col, "$", "string"), STRING)
            if kind(c.t) != "string":
                return c
            got = f(c.col, a)
            return got if isinstance(got, C) else C(got, to)

        builtin(*names)(run)
        return f

    return add


def text(a, i, default=None):
    if i >= a.count:
        return F.lit(default)
    c = a.val(i)
    return c.col if kind(c.t) == "string" else F.lit("")


def count(a, i, default):
    return a.val(i).col.cast("int") if i < a.count else F.lit(default)


string("upper")(lambda s, a: F.upper(s))
string("lower")(lambda s, a: F.lower(s))
string("capitalize")(lambda s, a: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2)))))
string("reverse_str")(lambda s, a: F.reverse(s))
string("trim")(lambda s, a: F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", ""))
string("trim_left", "lstrip")(lambda s, a: F.regexp_replace(s, f"^{SPACE}+", ""))
string("trim_right", "rstrip")(lambda s, a: F.regexp_replace(s, f"{SPACE}+$", ""))
string("byte_len", to=LONG)(lambda s, a: F.octet_length(s).cast("long"))
string("starts_with", to=BOOL)(lambda s, a: F.startswith(s, text(a, 0)))
string("ends_with", to=BOOL)(lambda s, a: F.endswith(s, text(a, 0)))
string("matches", to=BOOL)(lambda s, a: F.contains(s, text(a, 0)))
string("index_of", to=LONG)(lambda s, a: F.position(text(a, 0), s).cast("long") - 1)
string("replace_all")(lambda s, a: F.replace(s, text(a, 0), text(a, 1)))
string("is_blank", to=BOOL)(lambda s, a: F.rlike(s, F.lit(f"^{SPACE}*$(?!\\n)")))
string("is_numeric", to=BOOL)(lambda s, a: F.rlike(s, F.lit(r"\A[0-9]+\z")))
string("is_alpha", to=BOOL)(lambda s, a: F.rlike(s, F.lit(r"\A\p{IsAlphabetic}+\z")))
string("is_ascii", to=BOOL)(lambda s, a: F.rlike(s, F.lit(r"\A[\x00-\x7F]*\z")))
string("to_base64")(lambda s, a: F.replace(F.replace(F.base64(F.encode(s, "UTF-8")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")))
string("repeat", "repeat_str")(lambda s, a: F.repeat(s, count(a, 0, 1)))
string("words", to=STRINGS)(lambda s, a: F.regexp_extract_all(s, F.lit(f"[^{SPACE[1:-1]}]+"), 0))
string("chars", "chars_of", to=STRINGS)(lambda s, a: F.regexp_extract_all(s, F.lit("(?s)."), 0))


@string("title_case")
def title_case(s, a):
    parts = F.regexp_extract_all(s, F.lit(f"[^{SPACE[1:-1]}]+|{SPACE}+"), 0)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def word_parts(s):
    """Lower-case words: cut at _, - and spaces and before a capital that
    follows a small letter."""
    cut = F.regexp_replace(s, r"(\p{Ll}|\p{Nd})(\p{Lu})", "$1 $2")
    return F.transform(F.regexp_extract_all(cut, F.lit(f"[^-_{SPACE[1:-1]}]+"), 0), lambda w: F.lower(w))


def capital(w):
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))


string("snake_case")(lambda s, a: F.array_join(word_parts(s), "_"))
string("kebab_case")(lambda s, a: F.array_join(word_parts(s), "-"))
string("pascal_case")(lambda s, a: F.array_join(F.transform(word_parts(s), capital), ""))
string("camel_case")(lambda s, a: F.array_join(F.transform(word_parts(s), lambda w, i: F.when(i == 0, w).otherwise(capital(w))), ""))


@string("lines", to=STRINGS)
def lines(s, a):
    parts = F.split(F.regexp_replace(s, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(parts)


@string("bytes", to=T.ArrayType(LONG))
def bytes_(s, a):
    pairs = F.regexp_extract_all(F.hex(F.encode(s, "UTF-8")), F.lit(".."), 0)
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))


@string("split", to=STRINGS)
def split(s, a):
    sep = a.val(0)
    quoted = F.lit("\\Q" + str(sep.lit).replace("\\E", "\\E\\\\E\\Q") + "\\E") if sep.lit is not ... else F.concat(F.lit("\\Q"), sep.col, F.lit("\\E"))
    return F.split(s, quoted, -1)


@string("slice")
def slice_(s, a):
    n = F.char_length(s)
    at = lambda i: F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))
    start = at(count(a, 0, 0))
    stop = at(count(a, 1, 0)) if a.count > 1 else n
    return F.substr(s, start + 1, F.greatest(stop - start, F.lit(0)))


@string("replace")
def replace(s, a):
    at = F.position(text(a, 0), s)
    return F.when(at == 0, s).otherwise(F.concat(F.substr(s, F.lit(1), at - 1), text(a, 1), F.substr(s, at + F.char_length(text(a, 0)))))


@string("last_index_of", to=LONG)
def last_index_of(s, a):
    p = text(a, 0)
    at = F.position(F.reverse(p), F.reverse(s))
    return F.when(at == 0, F.lit(-1)).otherwise(F.char_length(s) - at + 1 - F.char_length(p)).cast("long")


string("strip_prefix")(lambda s, a: F.when(F.startswith(s, text(a, 0)), F.substr(s, F.char_length(text(a, 0)) + 1)).otherwise(s))
string("strip_suffix")(lambda s, a: F.when(F.endswith(s, text(a, 0)), F.substr(s, F.lit(1), F.char_length(s) - F.char_length(text(a, 0)))).otherwise(s))


def fill(a, n):
    return F.repeat(text(a, 1, " "), F.greatest(n, F.lit(0)).cast("int"))


string("pad_left")(lambda s, a: F.concat(fill(a, count(a, 0, 0) - F.char_length(s)), s))
string("pad_right")(lambda s, a: F.concat(s, fill(a, count(a, 0, 0) - F.char_length(s))))


@string("center")
def center(s, a):
    short = F.greatest(count(a, 0, 0) - F.char_length(s), F.lit(0))
    left = F.floor(short / 2).cast("int")
    return F.concat(fill(a, left), s, fill(a, short - left))


@string("indent")
def indent(s, a):
    pad = F.repeat(F.lit(" "), count(a, 0, 2))
    return F.array_join(F.transform(lines(s, a), lambda x: F.concat(pad, x)), "\n")


@string("dedent")
def dedent(s, a):
    parts = lines(s, a)
    lead = lambda x: F.char_length(x) - F.char_length(F.regexp_replace(x, f"^{SPACE}+", ""))
    least = F.coalesce(F.array_min(F.transform(F.filter(parts, lambda x: ~F.rlike(x, F.lit(f"\\A{SPACE}*\\z"))), lead)), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.substr(x, least + 1)), "\n")


@string("scan", to=STRINGS)
def scan(s, a):
    p = text(a, 0)
    n = (F.char_length(s) - F.char_length(F.replace(s, p, F.lit("")))) / F.greatest(F.char_length(p), F.lit(1))
    return F.array_repeat(p, n.cast("int"))


def listed(a):
    c = a.val(0)
    return c if kind(c.t) == "array" else C(F.array(whole(c)), T.ArrayType(c.t))


string("contains_any", to=BOOL)(lambda s, a: F.exists(listed(a).col, lambda x: F.contains(s, x)))
string("contains_all", to=BOOL)(lambda s, a: F.forall(listed(a).col, lambda x: F.contains(s, x)))


@string("from_base64")
def from_base64(s, a):
    # no padding, no partial group at the end; a bad character gives null
    bare = F.regexp_replace(s, r"=+\z|\s", "")
    full = F.rpad(bare, (F.ceil(F.char_length(bare) / 4) * 4).cast("int"), F.lit("="))
    return F.when(F.rlike(bare, F.lit(r"\A[A-Za-z0-9+/]*\z")), F.decode(F.try_to_binary(full, F.lit("base64")), "UTF-8"))


@string("url_encode")
def url_encode(s, a):
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        s = F.replace(F.url_encode(s) if old == "+" else s, F.lit(old), F.lit(new))
    return s


@string("url_decode")
def url_decode(s, a):
    return F.try_url_decode(F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25"))


#: The five characters that are escaped.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


@string("html_escape")
def html_escape(s, a):
    for raw, name in ENTITIES:
        s = F.replace(s, F.lit(raw), F.lit(name))
    return s


@string("html_unescape")
def html_unescape(s, a):
    for raw, name in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(raw))
    return s


@string("parse_int", to=LONG)
def parse_int(s, a):
    s = F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.rlike(s, F.lit(r"\A[+-]?[0-9]+\z")), s.try_cast("bigint"))


FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


@string("parse_float", to=T.DoubleType())
def parse_float(s, a):
    s = F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")
    return F.when(F.rlike(s, F.lit(FLOAT)), s.try_cast("double"))


@string("parse_bool", to=BOOL)
def parse_bool(s, a):
    s = F.lower(F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", ""))
    return F.when(s.isin("true", "yes", "1", "on"), True).when(s.isin("false", "no", "0", "off"), False)


@string("to_number", to=T.DoubleType())
def to_number(s, a):
    return F.when(F.rlike(s, F.lit(FLOAT)), s.try_cast("double"))


string("to_bool", to=BOOL)(lambda s, a: F.when(s == "true", True).when(s == "false", False))


@string("from_json", to=T.VariantType())
def from_json(s, a):
    return F.try_parse_json(s) if a.trying else F.parse_json(s)
