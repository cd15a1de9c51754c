"""SQL spellings of the text expressions, for the DuckDB side."""

from __future__ import annotations

import re

from reelgrid.functions import fixed_values as fv

SPACELESS = ("぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ가-힣฀-๿຀-໿က-႟ក-៿")
TOKEN = f"[{SPACELESS}]|[^\\s{SPACELESS}]+"


def NORM(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower(nfc_normalize({c})), "
            f"'[^\\p{{L}}\\p{{N}}\\p{{Mn}}\\p{{Mc}}_]', ' ', 'g'), ' +', ' ', 'g'))")


def N_TOKENS(c: str) -> str:
    return f"cast(len(regexp_extract_all({c}, '{TOKEN}')) as bigint)"


def _any_sql(c: str, patterns: list[str]) -> str:
    # RE2 has no look-ahead: "video game" is glued together first, so that "video" alone cannot end there
    plain = [p.replace(r"(?!\s*game)", "") for p in patterns]
    joined = "|".join(f"(?:{_unicode_edges(p)})" for p in plain).replace("'", "''")
    return f"regexp_matches(replace({c}, 'video game', 'videogame'), '{joined}')"


def _unicode_edges(pattern: str) -> str:
    # RE2 word edges are ASCII; the texts hold only letters, digits and single spaces
    p = re.sub(r"^\\b", r"(?:^|[^\\p{L}\\p{N}_])", pattern)
    return re.sub(r"\\b", r"(?:$|[^\\p{L}\\p{N}_])", p)


def is_cta_sql(c: str) -> str:
    return _any_sql(c, fv.CTA_PATTERNS)


def is_greeting_sql(c: str) -> str:
    return _any_sql(c, fv.GREETING_PATTERNS)


def is_promo_sql(c: str) -> str:
    return _any_sql(c, fv.PROMO_PATTERNS)


def is_junk_sql(c: str) -> str:
    return f"({is_cta_sql(c)} or {is_greeting_sql(c)} or {is_promo_sql(c)})"
