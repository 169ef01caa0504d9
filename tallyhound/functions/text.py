"""Column expressions for identifiers and free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and the plain letters they fold to.
ACCENTED = "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇáàâäãéèêëíìîïóòôöõúùûüñç"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUNCaaaaaeeeeiiiiooooouuuunc"


def normalise_id(value: Column) -> Column:
    """Upper case without blanks, dashes, underscores or dots, so spellings of one plate agree."""
    return F.upper(F.regexp_replace(value.cast("string"), r"[\s\-_.]", ""))


def clean_text(value: Column) -> Column:
    """Trimmed text without the ``.0`` of a number read as a decimal; blank becomes null."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
    return F.when(~text.isin("", "nan"), text)


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_number(value: Column) -> Column:
    """Double, or null when the text is not a number in digits; ``12F`` and ``NaN`` are none."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def digits_only(value: Column) -> Column:
    """Only the digits; null when there are none."""
    return F.nullif(F.regexp_replace(value.cast("string"), r"\D", ""), F.lit(""))


def fold_accents(value: Column) -> Column:
    return F.translate(value.cast("string"), ACCENTED, PLAIN)


def categorise(value: Column, keywords: dict[str, list[str]], other: str = "otro") -> Column:
    """The first category with a keyword contained in the accent-folded upper-case text."""
    text = F.upper(fold_accents(value))
    out = None
    for name, words in keywords.items():
        hit = reduce(lambda a, b: a | b, [text.contains(w.upper()) for w in words])
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))


def value_shape(value: Column, limit: int = 60) -> Column:
    """The form of a value without its content: letters become A, digits 9, other signs stay."""
    text = fold_accents(F.trim(value.cast("string")))
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    shape = F.regexp_replace(F.regexp_replace(ascii_only, "[A-Za-z]", "A"), "[0-9]", "9")
    return F.when(F.length(shape) <= limit, shape).otherwise(F.concat(F.substring(shape, 1, limit), F.lit("…")))


# Pairs of signs that look alike on a plate.
LOOK_ALIKE = ["0O", "O0", "1I", "I1", "8B", "B8"]


def one_edit_kind(a: Column, b: Column) -> Column:
    """How two codes at one edit differ, or null when they are equal or further apart.

    One changed sign (``confusion_visual`` when the two look alike), two adjacent signs swapped, or one
    sign more or less. A swap of neighbours has Levenshtein distance 2, hence the bound of 2 below; all
    of it stays in built-in expressions.
    """
    same_length = F.length(a) == F.length(b)
    distance = F.levenshtein(a, b, 2)
    positions = F.sequence(F.lit(1), F.length(a))
    differing = F.filter(positions, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    first = F.element_at(differing, 1)
    at_first = F.concat(F.substr(a, first, F.lit(1)), F.substr(b, first, F.lit(1)))
    swapped = (
        (F.size(differing) == 2)
        & (F.element_at(differing, 2) == first + 1)
        & (F.substr(a, first, F.lit(2)) == F.reverse(F.substr(b, first, F.lit(2))))
    )
    return (
        F.when((distance == 1) & ~same_length, F.lit("letra_de_mas_o_de_menos"))
        .when((distance == 1) & at_first.isin(LOOK_ALIKE), F.lit("confusion_visual"))
        .when(distance == 1, F.lit("letra_cambiada"))
        .when((distance == 2) & same_length & F.coalesce(F.when(F.length(a) >= 2, swapped), F.lit(False)),
              F.lit("transposicion"))
    )


def deletion_keys(value: Column) -> Column:
    """The code and every code with one sign removed.

    Two codes at one edit (or one swap of neighbours) always share a key, so an equi-join on the exploded
    keys finds all of them without comparing every pair.
    """
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))),
        lambda i: F.concat(F.substr(value, F.lit(1), i - 1), F.substr(value, i + 1)),
    )
    return F.array_distinct(F.array_append(cut, value))
