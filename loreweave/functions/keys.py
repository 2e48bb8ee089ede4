"""Normalised keys and surface rules, as native column expressions.

All of them stay inside whole-stage code generation: no Python function runs per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -------------------------------------------------------------------------
# Unicode White_Space characters.
WS_CHARS = (
    "\t\n\x0b\x0c\r \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
QUOTES = "\"'`“”‘’"
# Vietnamese letters and the base letter each one folds to.
FOLD = {
    "a": "àáảãạăằắẳẵặâầấẩẫậ",
    "e": "èéẻẽẹêềếểễệ",
    "i": "ìíỉĩị",
    "o": "òóỏõọôồốổỗộơờớởỡợ",
    "u": "ùúủũụưừứửữự",
    "y": "ỳýỷỹỵ",
    "d": "đ",
}
FOLD_FROM = "".join(FOLD.values())
FOLD_TO = "".join(base * len(letters) for base, letters in FOLD.items())
DEMONSTRATIVE_ENDINGS = (" này", " đó", " kia")
HONORIFIC_PREFIX = "vị "
# ------------------------------------------------------------------------------------------



def char_ranges(chars: str) -> str:
    """Members of a regular expression class, as ranges: a long list is tested one by one per character."""
    out, points = "", sorted({ord(c) for c in chars})
    while points:
        first = last = points.pop(0)
        while points and points[0] == last + 1:
            last = points.pop(0)
        out += chr(first) + (("-" if last > first + 1 else "") + chr(last) if last > first else "")
    return out


WS_CLASS = char_ranges(WS_CHARS)
WS = "[" + WS_CLASS + "]"
ALNUM = r"\p{IsAlphabetic}\p{N}"
WORD = ALNUM + "_"


def trim_ws(c: Column) -> Column:
    """Strip every Unicode white-space character at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze_ws(c: Column) -> Column:
    """Collapse each white-space run to one space and strip the ends."""
    return F.regexp_replace(trim_ws(c), WS + "+", " ")


def blank_to_null(c: Column) -> Column:
    t = trim_ws(c)
    return F.when(t != "", t)


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_ws(c), F.lit("")) == ""


def tokens(c: Column) -> Column:
    """White-space tokens, without empty ones."""
    return F.filter(F.split(squeeze_ws(c), " "), lambda t: t != "")


def alnum_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[^{ALNUM}]", ""))


def text_key(c: Column) -> Column:
    """Lower-case, every non-alphanumeric run to one underscore, none at the edges."""
    return F.btrim(F.regexp_replace(F.lower(c), f"[^{ALNUM}]+", "_"), F.lit("_"))


def fold_letters(c: Column) -> Column:
    return F.translate(F.lower(c), FOLD_FROM, FOLD_TO)


def folded_key(c: Column) -> Column:
    """C1 with Vietnamese letters folded to their base letter."""
    return F.btrim(F.regexp_replace(fold_letters(c), f"[^{ALNUM}]+", "_"), F.lit("_"))


def ascii_key(c: Column, key_mode: str = "parity") -> Column:
    """ASCII snake-case key. ``key_mode='unicode'`` keeps letters outside ASCII (C2 rule), so
    that names in other scripts do not all share the key ``field``."""
    t = trim_ws(c)
    if key_mode == "unicode":
        k = folded_key(t)
        return F.when(k == "", F.lit("field")).otherwise(k)
    # a key that is already in shape comes out unchanged
    k = F.btrim(F.regexp_replace(fold_letters(t), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.regexp_replace(F.regexp_replace(k, r"\A(?![a-z])", "field_"), r"_\z", "")


def schema_key(c: Column) -> Column:
    """C4: blank stays blank, else C3."""
    t = trim_ws(c)
    return F.when(t == "", F.lit("")).otherwise(ascii_key(t))


def strip_quotes(c: Column) -> Column:
    return F.btrim(c, F.lit(QUOTES))


def clean_surface(c: Column) -> Column:
    """A name or alias as it should be compared and shown."""
    s = squeeze_ws(strip_quotes(trim_ws(c)))
    for ending in DEMONSTRATIVE_ENDINGS:
        s = trim_ws(F.regexp_replace(s, ending + r"\z", ""))
    # the prefix goes only from names of more than two words
    s = F.regexp_replace(s, rf"\A(?={HONORIFIC_PREFIX}[^ ]+ [^ ])(?:{HONORIFIC_PREFIX})+", "")
    return strip_quotes(trim_ws(s))


def upper_token_count(c: Column) -> Column:
    return F.size(F.filter(tokens(c), lambda t: t.rlike(r"\A\p{IsUppercase}")))


def has_upper_token(c: Column) -> Column:
    return squeeze_ws(c).rlike(r"(\A| )\p{IsUppercase}")


def is_ambiguous(c: Column) -> Column:
    """No upper-case token, or at most two tokens with fewer than two upper-case ones."""
    n = upper_token_count(c)
    return (n == 0) | ((F.size(tokens(c)) <= 2) & (n < 2))


def stable_alias_in_text(raw: Column, clean: Column) -> Column:
    """May this surface, read from text, be an alias."""
    r, k = squeeze_ws(raw), squeeze_ws(clean)
    return (
        F.length(k).between(2, 64)
        & ~r.rlike(r"[:;\[\]{}]")
        & (F.size(tokens(clean)) <= 7)
        & ~k.rlike(r"[()<>/\\]")
    )


def stable_alias_stored(c: Column) -> Column:
    """May this surface be written to the alias map."""
    s = squeeze_ws(c)
    n, chars = F.size(tokens(c)), alnum_count(s)
    return (
        (folded_key(s) != "")
        & (chars > 3)
        & (has_upper_token(c) | (~((n <= 2) & (chars <= 6)) & (n <= 3)))
    )


def stable_alias_display(c: Column) -> Column:
    """May this surface be shown or highlighted to a reader."""
    s = squeeze_ws(c)
    n, chars = F.size(tokens(c)), alnum_count(s)
    return (
        (s != "")
        & (chars >= 2)
        & (has_upper_token(c) | (~((n == 1) & (chars <= 4)) & ~((n <= 2) & (chars <= 6))))
    )


def surface_variants(c: Column) -> Column:
    """C14: the surface, and the surface with its first letter in lower and in upper case."""
    head, rest = F.substring(c, 1, 1), F.substring(c, 2, 2147483647)
    return F.array_distinct(F.array(c, F.concat(F.lower(head), rest), F.concat(F.upper(head), rest)))
