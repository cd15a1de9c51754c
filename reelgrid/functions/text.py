"""Text expressions: normalising, tokens, junk phrases, scripts, language and retelling marks."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from reelgrid.functions import fixed_values as fv

# Scripts written without spaces, one token per character.
SPACELESS = (r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}"
             r"\x{AC00}-\x{D7A3}\x{0E00}-\x{0E7F}\x{0E80}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}")
_TOKEN = f"[{SPACELESS}]|[^\\s{SPACELESS}]+"
# Two ranges that hold all of them: a class of many ranges is slow on every character, so texts without any of these skip it.
_MAY_SPACELESS = r"[\x{0E00}-\x{17FF}\x{3040}-\x{FF9F}]"
# A list of literals is looked up as a hash set; an array of them would be read from its start for every word.
_STOPS = list(dict.fromkeys(fv.STOP_VI + fv.STOP_EN + fv.STOP_HI))
# Characters that may change under canonical composition; all other text is composed already.
_MAY_COMPOSE = (r"[\p{M}\x{1161}-\x{1175}\x{11A8}-\x{11C2}\x{0374}\x{037E}\x{0387}\x{1F00}-\x{1FFF}"
                r"\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4F}]")


@F.pandas_udf(T.StringType())
def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC; only texts that may change travel to Python."""
    return F.coalesce(_compose(F.when(text.rlike(_MAY_COMPOSE), text)), text)


def norm_text(text: Column, compose: bool = True) -> Column:
    """Lower case, letters / digits / marks kept, everything else one space."""
    t = F.lower(composed(text) if compose else text)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}\p{Mn}\p{Mc}_]+", " "))


def tokens(norm: Column) -> Column:
    """Words; in spaceless scripts single characters. `norm` is read twice, so it should be a column of its own."""
    return (F.when(norm.rlike(_MAY_SPACELESS), F.regexp_extract_all(norm, F.lit(_TOKEN), F.lit(0)))
            .otherwise(F.regexp_extract_all(norm, F.lit(r"\S+"), F.lit(0))))


def n_tokens(norm: Column) -> Column:
    return (F.when(norm.rlike(_MAY_SPACELESS), F.regexp_count(norm, F.lit(_TOKEN)))
            .otherwise(F.regexp_count(norm, F.lit(r"\S+"))).cast("long"))


def has_spaceless(text: Column) -> Column:
    return text.rlike(_MAY_SPACELESS) & text.rlike(f"[{SPACELESS}]")


def _any(patterns: list[str]) -> str:
    return "(?U)" + "|".join(f"(?:{p})" for p in patterns)


def required_literal(pattern: str) -> str:
    """Longest text every match of the pattern contains: plain runs outside groups, classes and
    optional characters."""
    flat, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            flat.append("\0")
            i += 2
            continue
        if c == "[" and depth == 0:
            i = pattern.index("]", i) + 1
            flat.append("\0")
            continue
        depth += (c == "(") - (c == ")")
        if depth or c in "()":
            flat.append("\0")
        elif c in "?*":
            flat[-1] = "\0"
        elif c == "{":
            i = pattern.index("}", i)
            flat[-1] = "\0"
        else:
            flat.append("\0" if c in ".+^$" else c)
        i += 1
    return max("".join(flat).split("\0"), key=len)


def needed_texts(pattern: str) -> list[str]:
    """Texts of which every match holds at least one: the plain literal, or the alternatives of a
    group that must occur, whichever are longer."""
    options, i = [[required_literal(pattern)]], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            continue
        if pattern[i] == "[":
            i = pattern.index("]", i)
        elif pattern.startswith("(?:", i):
            depth, cut, alts, j = 1, i + 3, [], i + 3
            while depth:
                if pattern[j] == "\\":
                    j += 1
                elif pattern[j] == "(":
                    depth += 1
                elif pattern[j] == ")":
                    depth -= 1
                if depth == 0 or (depth == 1 and pattern[j] == "|"):
                    alts.append(pattern[cut:j])
                    cut = j + 1
                j += 1
            if pattern[j:j + 1] not in ("?", "*", "{"):
                options.append([required_literal(a) for a in alts])
            i = j - 1
        i += 1
    return max(options, key=lambda o: min(len(x) for x in o))


def by_need(patterns: list[str]) -> dict[frozenset[str], list[str]]:
    """Patterns by the texts of which each needs one; a needed text that holds another is told as that one."""
    needed = sorted({x for p in patterns for x in needed_texts(p)}, key=lambda x: (len(x), x))
    groups: dict[frozenset[str], list[str]] = {}
    for p in patterns:
        groups.setdefault(frozenset(next(y for y in needed if y in x) for x in needed_texts(p)), []).append(p)
    return groups


def _phrase(norm: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs; a text meets only the patterns whose needed texts it holds."""
    return reduce(Column.__or__, [reduce(Column.__or__, [F.contains(norm, F.lit(x)) for x in sorted(texts)]) & norm.rlike(_any(some))
                                  for texts, some in by_need(patterns).items()])


def is_cta(norm: Column) -> Column:
    return _phrase(norm, fv.CTA_PATTERNS)


def is_greeting(norm: Column) -> Column:
    return _phrase(norm, fv.GREETING_PATTERNS)


def is_promo(norm: Column) -> Column:
    return _phrase(norm, fv.PROMO_PATTERNS)


def is_junk(norm: Column) -> Column:
    return _phrase(norm, fv.CTA_PATTERNS + fv.GREETING_PATTERNS + fv.PROMO_PATTERNS)


# Script ranges by language code, in the order ties are broken.
SCRIPTS = {"ko": r"\x{AC00}-\x{D7A3}", "th": r"\x{0E00}-\x{0E7F}", "ru": r"\x{0400}-\x{04FF}",
           "ar": r"\x{0600}-\x{06FF}", "hi": r"\x{0900}-\x{097F}", "he": r"\x{0590}-\x{05FF}",
           "zh": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"}
KANA = r"\x{3040}-\x{30FF}\x{FF66}-\x{FF9F}"


def script_counts(text: Column) -> list[Column]:
    """Letter counts: all, kana and one per script, to be summed before `script_from_counts`."""
    foreign = text.rlike("[" + KANA + "".join(SCRIPTS.values()) + "]")      # most texts have none

    def count(ranges: str) -> Column:
        return F.when(foreign, F.regexp_count(text, F.lit(f"[{ranges}&&[\\p{{L}}]]"))).otherwise(0).cast("long")
    return [F.regexp_count(text, F.lit(r"\p{L}")).cast("long").alias("n_letters"),
            count(KANA).alias("n_ja"), *[count(r).alias(f"n_{c}") for c, r in SCRIPTS.items()]]


def script_from_counts() -> Column:
    """Language code of a non-Latin script, '' for Latin text, from the count columns."""
    counts = [F.col(f"n_{c}") for c in SCRIPTS]
    other = F.col("n_ja")
    for c in counts:
        other = other + c
    top = F.greatest(*counts)
    pick = F.when(F.col("n_ja") > 0, "ja")
    for code, c in zip(SCRIPTS, counts):
        pick = pick.when((c > 0) & (c == top), code)
    latin = (F.col("n_letters") == 0) | (other * 100 < F.col("n_letters") * 15)
    return F.when(latin, "").otherwise(pick.otherwise(""))


def english_counts(text: Column) -> list[Column]:
    """Latin words and English function words among them."""
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    known = F.array(*[F.lit(x) for x in fv.ENGLISH_FUNCTION_WORDS])
    hits = F.filter(w, lambda x: F.array_contains(known, x))
    return [F.size(w).cast("long").alias("n_latin_words"), F.size(hits).cast("long").alias("n_function_words")]


def english_from_counts() -> Column:
    return (F.col("n_latin_words") >= 25) & (F.col("n_function_words") * 100 >= F.col("n_latin_words") * 22)


def resolved_label(stored: Column, script: Column, english: Column) -> Column:
    """Label to trust: the script of the letters, else English if it reads so, else the stored one."""
    raw = F.lower(F.trim(F.coalesce(stored, F.lit(""))))
    names = F.create_map(*[F.lit(x) for pair in fv.LANGUAGE_NAMES.items() for x in pair])
    s = F.coalesce(F.element_at(names, raw), raw)
    return (F.when(script != "", F.when(s == script, stored).otherwise(script))
            .when((s != "") & (s != "en") & english, "en").otherwise(F.coalesce(stored, F.lit(""))))


def looks_vietnamese(text: Column) -> Column:
    """At least two letters found only in Vietnamese and more than a tenth of all letters."""
    t = F.lower(composed(text))
    hits = F.regexp_count(t, F.lit(f"[{fv.VIETNAMESE_LETTERS}]"))
    return (hits >= 2) & (hits * 10 > F.regexp_count(t, F.lit(r"\p{L}")))


def content_sequence(norm: Column) -> Column:
    """Content words in order: pronouns folded, common English endings cut, stop words dropped."""
    def stem(w: Column) -> Column:
        """An ending goes if three letters or more stay."""
        cut = F.when(F.lit(False), w)
        for end in ("ing", "ed", "es", "s"):
            cut = cut.when(F.endswith(w, F.lit(end)) & (F.length(w) >= 3 + len(end)), F.substring(w, F.lit(1), F.length(w) - len(end)))
        return cut.otherwise(w)

    words = F.filter(F.split(norm, " "), lambda w: w != "")
    folded = F.transform(words, lambda w: F.when(w.isin(fv.PRONOUNS), "§p").otherwise(stem(w)))
    return F.filter(folded, lambda w: (w == "§p") | ((F.length(w) > 1) & ~w.isin(_STOPS)))


def content_words(norm: Column) -> Column:
    """Distinct words of more than one character that are not stop words."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: (F.length(w) > 1) & ~w.isin(_STOPS)))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an array column that is computed once per row, even when lambdas below refer to it
    (the optimiser would otherwise copy the expression into them)."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def grams(seq: Column, n: int = 3) -> Column:
    """Runs of n consecutive items."""
    firsts = F.slice(seq, F.lit(1), F.greatest(F.lit(0), F.size(seq) - n + 1))
    return F.transform(firsts, lambda x, i: F.concat_ws(" ", x, *[F.get(seq, i + k) for k in range(1, n)]))


def clean_narration(text: Column) -> Column:
    """Voice tags in brackets out, words in capitals lowered, spaces tidied."""
    t = F.regexp_replace(text, r"\[[a-zA-Z][a-zA-Z '\-]{0,28}\]", " ")
    pieces = F.split(t, r"(?<=\p{L})(?=[^\p{L}])|(?<=[^\p{L}])(?=\p{L})")
    calm = F.transform(pieces, lambda x: F.when(x.rlike(r"^(?=.*\p{Lu})[\p{L}&&[^\p{Ll}]]{2,}$"), F.lower(x))
                       .otherwise(x))
    t = F.regexp_replace(F.array_join(calm, ""), r"\s+([,.!?…;:])", "$1")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def display_case(text: Column, how: str) -> Column:
    return {"upper": F.upper, "lower": F.lower, "capitalize": F.initcap}[how](text)


def is_keyword(word: Column) -> Column:
    t = F.lower(F.regexp_replace(F.trim(word), r"^[.,!?;:\"'…-]+|[.,!?;:\"'…-]+$", ""))
    return (F.length(t) >= 2) & ~t.isin(fv.CAPTION_STOP)
