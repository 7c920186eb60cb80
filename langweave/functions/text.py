"""Text normalisation and script tests as native column expressions (no Python UDF).

Character classes are spelled out because Java's ``\\s``, ``\\w`` and ``\\d`` are ASCII-only by
default while the results must follow Unicode.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from langweave.fixed_values import ARABIZI_DIGITS

# --- Fixed values: character sets as code-point ranges ----------------------------------------
WHITESPACE = (
    (0x9, 0xD),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
LATIN = ((0x41, 0x5A), (0x61, 0x7A))
ARABIC = ((0x600, 0x6FF),)
HARAKAT = ((0x64B, 0x65F), (0x670, 0x670))
MAPPED_DIGITS = "2378569"
WORD = r"\p{L}\p{N}_"


def any_of(*char_sets) -> str:
    """Regex class of the characters in the sets."""
    return "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for chars in char_sets for lo, hi in chars) + "]"


def none_of(*char_sets) -> str:
    """Regex class of the characters in none of the sets.

    The complement is written out as ranges: Java matches a negated class that mixes Latin with other
    ranges several times slower than the same characters listed.
    """
    gaps, start = [], 0
    for lo, hi in sorted(span for chars in char_sets for span in chars):
        if lo > start:
            gaps.append((start, lo - 1))
        start = max(start, hi + 1)
    return any_of([*gaps, (start, 0x10FFFF)])


# Whitespace by category: the separators are exactly the set's members beyond the control codes.
_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{1F}\x{85}\p{Z}]"

# --- Fixed values: code points that are emoji on their own (Unicode emoji data, non-ASCII) ----
EMOJI = "".join(
    r"\x{%s}" % span.replace("-", r"}-\x{")
    for span in """
    A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
    25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A
    262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697
    2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1
    26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721
    2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935
    2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E
    1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393
    1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567
    1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC
    1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
    1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0
    1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9
    1FAF0-1FAF8
    """.split()
)
# One emoji with its variation selector or skin tone, joined sequences, keycaps, tag flags.
_EMOJI_UNIT = rf"[{EMOJI}][\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]*"
EMOJI_PATTERN = (
    rf"\x{{1F3F4}}[\x{{E0060}}-\x{{E007F}}]+"
    rf"|[0-9#*]\x{{FE0F}}?\x{{20E3}}"
    rf"|{_EMOJI_UNIT}(?:\x{{200D}}{_EMOJI_UNIT})*"
)
# Where any of these can start; a cheap first look that spares most characters the long class.
_MAY_BE_EMOJI = r"(?=[#*0-9\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FAFF}])"


@dataclass(frozen=True)
class NormalizeOptions:
    """The seven switches of :func:`normalize_text`."""

    lowercase_latin: bool = True
    rm_urls: bool = True
    rm_mentions: bool = True
    rm_hashtags: bool = False
    norm_arabic: bool = True
    norm_arabizi: bool = True
    keep_emojis: bool = True


def _count_in(text: Column, char_class: str) -> Column:
    """How many characters of ``text`` lie in the class: the length lost by erasing them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{char_class}+", ""))


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a costly value that it looks at several times; written out plainly, each look would compute it anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def remove_urls(text: Column) -> Column:
    rest = none_of(WHITESPACE) + "+"
    return F.regexp_replace(text, rf"http{rest}|www\.{rest}", "")


def remove_mentions(text: Column) -> Column:
    return F.regexp_replace(text, f"@[{WORD}]+", "")


def remove_hashtags(text: Column) -> Column:
    return F.regexp_replace(text, f"#[{WORD}]+", "")


def remove_emojis(text: Column) -> Column:
    return F.regexp_replace(text, _MAY_BE_EMOJI + f"(?:{EMOJI_PATTERN})", "")


def lowercase_text(text: Column) -> Column:
    return F.lower(text)


def normalize_arabizi(text: Column) -> Column:
    """Digits that stand for Arabic letters, where a Latin letter touches them on either side.

    Each pattern opens on the bare digit, so the matcher skips all other characters cheaply; texts
    with no such digit pass one test and no rewrite.
    """
    latin = any_of(LATIN)

    def touching_latin(digit: str) -> str:
        return f"{digit}(?:(?<={latin}{digit})|(?={latin}))"

    def rewritten(text: Column) -> Column:
        out = text
        for digit, letter in ARABIZI_DIGITS.items():
            out = F.regexp_replace(out, touching_latin(digit), letter)
        return F.when(text.rlike(touching_latin(f"[{MAPPED_DIGITS}]")), out).otherwise(text)

    return _held(text, rewritten)


def normalize_arabic(text: Column) -> Column:
    """Unify alef forms, ta marbuta and alef maqsura; delete tatweel and harakat. A text without any passes one test."""
    forms = "إأآةىـ"
    concerned = any_of(HARAKAT, tuple((ord(c), ord(c)) for c in forms))

    def rewritten(text: Column) -> Column:
        unified = F.translate(text, forms, "اااهي")
        out = F.regexp_replace(unified, any_of(HARAKAT) + "+", "")
        return F.when(text.rlike(concerned), out).otherwise(text)

    return _held(text, rewritten)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+\z", "")


def clean_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{_SPACE}+", " "))


def normalize_text(text: Column, options: NormalizeOptions = NormalizeOptions()) -> Column:
    """The whole chain; null becomes the empty string.

    URLs go before lower-casing, so an upper-case scheme survives (and is lower-cased).
    """
    steps = (
        (options.rm_urls, remove_urls),
        (options.rm_mentions, remove_mentions),
        (options.rm_hashtags, remove_hashtags),
        (not options.keep_emojis, remove_emojis),
        (options.lowercase_latin, lowercase_text),
        (options.norm_arabizi, normalize_arabizi),
        (options.norm_arabic, normalize_arabic),
        (True, clean_whitespace),
    )
    out = F.coalesce(text, F.lit(""))
    for wanted, step in steps:
        if wanted:
            out = step(out)
    return out


def is_valid_text(text: Column) -> Column:
    """At least two Arabic or ASCII Latin letters and no more digits than letters; null is invalid."""
    letters = _count_in(text, any_of(LATIN, ARABIC))
    digits = _count_in(text, r"\p{Nd}")
    return F.coalesce(letters >= F.greatest(F.lit(2), digits), F.lit(False))


def tokenize_ws(text: Column) -> Column:
    """Whitespace tokens, none empty."""
    return F.array_remove(F.split(clean_whitespace(text), " "), "")


def count_tokens(text: Column) -> Column:
    """As many as ``tokenize_ws`` finds: each token becomes one character together with the whitespace after it, and
    what stands before the first is erased; no token is built."""
    marked = F.regexp_replace(text, f"{none_of(WHITESPACE)}+{_SPACE}*", "x")
    return F.length(F.regexp_replace(marked, f"^{_SPACE}+", ""))


def _tokens_touching(text: Column, chars) -> Column:
    """Tokens holding a character of the set: erase all else but whitespace, count what is left."""
    return count_tokens(F.regexp_replace(text, none_of(chars, WHITESPACE) + "+", ""))


def script_counts(text: Column) -> Column:
    """Struct ``tokens, arab, latin``: whitespace tokens, and those with a character of the script (maybe of both)."""
    return F.struct(
        count_tokens(text).alias("tokens"),
        _tokens_touching(text, ARABIC).alias("arab"),
        _tokens_touching(text, LATIN).alias("latin"),
    )


def script_ratios(text: Column) -> Column:
    """Struct ``arab_ratio, latin_ratio, cs_ratio`` over whitespace tokens; no tokens gives zeros.

    A token may count for both scripts; the code-switch ratio is the smaller share.
    """
    return ratios_of(script_counts(text))


def ratios_of(counts: Column) -> Column:
    """The ratios of ``script_counts``."""
    tokens = counts["tokens"]
    arab = F.coalesce(F.try_divide(counts["arab"], tokens), F.lit(0.0))
    latin = F.coalesce(F.try_divide(counts["latin"], tokens), F.lit(0.0))
    return F.struct(
        arab.alias("arab_ratio"), latin.alias("latin_ratio"), F.least(arab, latin).alias("cs_ratio")
    )


def is_arabizi(text: Column) -> Column:
    """Dialect written in Latin letters, judged on the raw text; null is not.

    More than half of the letters Latin; or more than 0.3 of them and one token that mixes a mapped
    digit with a Latin letter. With everything but digits, letters and whitespace erased, such a
    token has a digit next to a letter.
    """
    arab, latin = _count_in(text, any_of(ARABIC)), _count_in(text, any_of(LATIN))
    share = F.coalesce(F.try_divide(latin, arab + latin), F.lit(0.0))
    digit, letter = f"[{MAPPED_DIGITS}]", any_of(LATIN)
    digits = tuple((ord(d), ord(d)) for d in MAPPED_DIGITS)
    reduced = F.regexp_replace(F.lower(text), none_of(LATIN, digits, WHITESPACE) + "+", "")
    mixed = reduced.rlike(f"{digit}{letter}|{letter}{digit}")
    return F.coalesce((share > 0.5) | ((share > 0.3) & mixed), F.lit(False))


def script_of_dialect(label: Column, arabizi: Column) -> Column:
    """``arabizi`` or ``arabic`` for the dialect label, null for every other label."""
    return F.when(label == "AR_DAR", F.when(arabizi, "arabizi").otherwise("arabic"))


def prompt_key(label: Column, script: Column) -> Column:
    """The dialect splits by script (a null script counts as Arabic); other labels are their own key."""
    latin_script = F.coalesce(script == "arabizi", F.lit(False))
    return F.when(
        label == "AR_DAR", F.when(latin_script, "AR_DAR_LAT").otherwise("AR_DAR_AR")
    ).otherwise(label)


def strip_answer(text: Column) -> Column:
    return strip(text)
