"""Small builders for the DuckDB statements that state the expected results."""
from __future__ import annotations

from loreweave.functions.keys import FOLD_FROM, FOLD_TO, QUOTES, WS_CHARS


def lit(s: str) -> str:
    """SQL literal; control characters go through chr() so that the text stays readable."""
    parts, run = [], ""
    for ch in s:
        if ch < " " or ch in "\x85":
            if run:
                parts.append("'" + run.replace("'", "''") + "'")
            run = ""
            parts.append(f"chr({ord(ch)})")
        else:
            run += ch
    if run or not parts:
        parts.append("'" + run.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


_WS = lit(WS_CHARS)
_WSR = "(" + " || ".join(["'['", lit(WS_CHARS), "']+'"]) + ")"
AN = r"\p{L}\p{N}"


def trim(x):
    return f"trim({x}, {_WS})"


def squeeze(x):
    return f"regexp_replace({trim(x)}, {_WSR}, ' ', 'g')"


def toks(x):
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda t: t <> '')"


def ntoks(x):
    return f"len({toks(x)})"


def ups(x):
    return f"len(list_filter({toks(x)}, lambda t: regexp_matches(t, '^\\p{{Lu}}')))"


def alnum(x):
    return f"length(regexp_replace({x}, '[^{AN}]', '', 'g'))"


def key(x):
    return f"trim(regexp_replace(lower({x}), '[^{AN}]+', '_', 'g'), '_')"


def fold(x):
    return f"translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}')"


def fkey(x):
    return f"trim(regexp_replace({fold(x)}, '[^{AN}]+', '_', 'g'), '_')"


def akey(x):
    t = trim(x)
    k = f"trim(regexp_replace({fold(t)}, '[^a-z0-9]+', '_', 'g'), '_')"
    return (
        f"CASE WHEN regexp_full_match({t}, '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN {t} "
        f"WHEN {k} = '' THEN 'field' WHEN regexp_matches({k}, '^[a-z]') THEN {k} ELSE 'field_' || {k} END"
    )


def skey(x):
    return f"CASE WHEN {trim(x)} = '' THEN '' ELSE {akey(x)} END"


def unquote(x):
    return f"trim({x}, {lit(QUOTES)})"


def clean(x):
    """The statement of C5, nested in evaluation order."""
    s = squeeze(unquote(trim(x)))
    for e in (" này", " đó", " kia"):
        s = trim(f"regexp_replace({s}, '{e}$', '')")
    return s  # the honorific rule needs a second level, see clean_cols


def clean_cols(col, src, keep, out):
    """Sub-select that adds ``out`` = C5(``col``) to ``keep``."""
    return (
        f"SELECT {keep}, {unquote(trim('_s2'))} AS {out} FROM (SELECT *, CASE WHEN starts_with(_s1, 'vị ') AND {ntoks('_s1')} > 2 "
        f"THEN {trim(chr(114) + 'egexp_replace(_s1, ' + chr(39) + '^(vị )+' + chr(39) + ', ' + chr(39) * 2 + ')')} ELSE _s1 END AS _s2 "
        f"FROM (SELECT *, {clean(col)} AS _s1 FROM {src}))"
    )


def scan_hits(src, keep, text, variant):
    """Occurrences of ``variant`` in ``text`` for each row of ``src``: keep, s, e."""
    W = "'[\\p{L}\\p{N}_]'"
    return f"""
SELECT {keep}, s, s + n AS e FROM (
 SELECT {keep}, n, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + (i - 1) * n AS BIGINT) AS s,
  CASE WHEN ps[i] <> '' THEN right(ps[i], 1) WHEN i > 1 THEN right(v, 1) ELSE '' END AS bef,
  CASE WHEN ps[i + 1] <> '' THEN left(ps[i + 1], 1) WHEN i + 1 < len(ps) THEN left(v, 1) ELSE '' END AS aft
 FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM (
   SELECT {keep}, {variant} AS v, length({variant}) AS n, string_split({text}, {variant}) AS ps FROM {src} WHERE contains({text}, {variant}))))
WHERE NOT regexp_matches(bef, {W}) AND NOT regexp_matches(aft, {W})"""
