"""Text normalisation, hashing and n-grams as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the core normaliser. ``(?iduU)`` gives Python's reading of case, \w, \b, \s and dot.
PHONE = r"\b0\d[\d ]{8,11}\b"
GREETING = r"^(yeah hi|hi there|hello there|good (morning|afternoon|evening)|hi|hiya|hello|hey|morning|afternoon|evening|erm)[,!. ]+"
SIGN_OFF = r"(many thanks|thank you|thanks|cheers|kind regards|regards|best|ta)[,!. ]*\w*[.!]?\s*$"
FLAGS = "(?iduU)"

LABELS = ("routine", "same_day", "emergency")  # in order of rank


def squeezed(text: Column) -> Column:
    """Letters a-z, digits and single blanks of a text, in lower case: the key of the answer cache."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +", " "))


def body_hash(text: Column) -> Column:
    return F.sha2(squeezed(text), 256)


def with_id(message_id: Column, *parts: Column) -> Column:
    """The id of a message, or twelve hex digits of its parts where it has none: the same for the same message again."""
    return F.coalesce(message_id, F.substring(F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256), 1, 12))


def without_phone(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), FLAGS + PHONE, " ")


def without_greeting(text: Column) -> Column:
    return F.regexp_replace(text, FLAGS + GREETING, "")


def without_sign_off(text: Column, strict: bool = False) -> Column:
    """Without the closing words; ``strict`` wants a word boundary before them."""
    return F.regexp_replace(text, FLAGS + (r"\b" if strict else "") + SIGN_OFF, "")


def core(text: Column, strict: bool = False) -> Column:
    """The text in lower case without phone number, greeting and sign-off."""
    return without_sign_off(without_greeting(without_phone(text)), strict)


def core_text(text: Column, strict: bool = False) -> Column:
    """The text without phone number, greeting and sign-off, squeezed."""
    return squeezed(core(text, strict))


def core_hash(text: Column) -> Column:
    return F.substring(F.sha1(core_text(text)), 1, 16)


def tokens(squeezed_text: Column) -> Column:
    """The distinct words of a squeezed text."""
    return F.filter(F.array_distinct(F.split(squeezed_text, " ")), lambda w: w != "")


def spaced(text: Column) -> Column:
    """A text in lower case with one blank for any white space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", " ")


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with one blank; a shorter padded word is one gram. Repeats stay."""
    padded = F.transform(F.filter(F.split(spaced(text), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_word(w: Column) -> Column:
        grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
        # a word shorter than n gives itself once, for the smallest n only
        sizes = [F.when((F.length(w) >= n) | F.lit(n == low), grams(n)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.concat(*sizes)

    return F.flatten(F.transform(padded, of_word))


def long_words(text: Column) -> Column:
    """Words of two or more word characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))


def word_grams(text: Column) -> Column:
    """Words of two or more word characters and their bigrams."""
    w = long_words(text)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(w, pairs)


def plain_label(label: Column) -> Column:
    """A label in one spelling; null where it is none of the labels."""
    x = F.regexp_replace(F.lower(F.trim(label)), r"[\s\-]+", "_")
    return F.when(x.isin(*LABELS), x)


def rank(label: Column) -> Column:
    """0, 1, 2 in order of urgency; null for what is no label."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LABELS]), label), F.lit(0)).cast("int") - 1


def label_of(rank_col: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LABELS]), rank_col)
