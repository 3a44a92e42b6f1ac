"""String scalars: folding, decoding, names and offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: letters of other scripts drawn like Latin ones, in pairs
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԛ": "q", "ԁ": "d", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ԁ": "D", "Ӏ": "I", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ɡ": "g",
}
INVISIBLE = "[\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180F\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F\\u3164\\uFE00-\\uFE0F\\uFEFF\\uFFA0]"


def fold_confusables(text: Column) -> Column:
    return F.translate(text, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")


def without_invisible(text: Column) -> Column:
    """Default-ignorable and direction characters taken out, trailing blanks and long gaps tidied."""
    out = F.regexp_replace(text, INVISIBLE, "")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def kind_name(text: Column) -> Column:
    """Upper-case with underscores, starting with a letter; null if no letter can start it."""
    out = F.upper(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(F.rlike(out, F.lit("^[A-Z]")), out)


def percent_decoded(text: Column) -> Column:
    """Decoded, or null where an escape is broken or the bytes are no UTF-8."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def base64_text(run: Column) -> Column:
    """Text of a base64 run of 16 or more characters if it decodes to printable UTF-8, else null."""
    data = F.try_to_binary(run, F.lit("base64"))
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    shaped = (F.length(run) >= 16) & (F.length(run) % 4 == 0)
    return F.when(shaped & ~F.rlike(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")), text)


# fixed values: the named references that are decoded besides numeric ones
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "middot": "·", "amp": "&"}


def entities_decoded(text: Column) -> Column:
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(value))
    return text


def fold_for_compare(text: Column) -> Column:
    """Lower case, Latin marks stripped, letters and digits only."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")
    return F.regexp_replace(F.replace(plain, F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


# quality gate: limits
MIN_CHARS, MIN_PER_PAGE, MAX_REPLACEMENT, MAX_CONTROL, MAX_SHORT, MIN_RUNS = 16, 8, 0.1, 0.3, 0.6, 40
LETTERS = "[A-Za-z\\u00C0-\\u024F\\u0370-\\u03FF\\u0400-\\u04FF]"


def quality_reason(text: Column, pages: Column) -> Column:
    """First reason to refuse an extracted text, or null: too short, too short per page, replacement characters, control characters, fragments."""
    total = F.char_length(text)
    solid = F.char_length(F.regexp_replace(text, "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]", ""))
    replaced = total - F.char_length(F.replace(text, F.lit("�"), F.lit("")))
    control = total - F.char_length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    runs, short = F.regexp_count(text, F.lit(LETTERS + "+")), F.regexp_count(F.regexp_replace(text, LETTERS + "{3,}", " "), F.lit(LETTERS + "+"))
    return (
        F.when(solid < MIN_CHARS, "too few characters")
        .when(pages.isNotNull() & (pages >= 1) & (solid / pages < MIN_PER_PAGE), "too few characters per page")
        .when(replaced / total > MAX_REPLACEMENT, "replacement characters")
        .when(control / total > MAX_CONTROL, "control characters")
        .when((runs >= MIN_RUNS) & (short / runs > MAX_SHORT), "fragmented")
    )
