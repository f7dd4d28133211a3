"""Text functions as Column helpers."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java flags that make a pattern mean what it does in Python: no case, Unicode classes, and
#: only the line feed ends a line.
FLAGS = "(?iUd)"
#: What ends a line of a text.
LINES = "[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# Emoji and their joiners, which editorial texts drop.
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}\x{FE0E}\x{FE0F}\x{200D}\x{20E3}]+"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def norm(text: Column) -> Column:
    """Lower case, white space collapsed; null stays null."""
    return collapsed(F.lower(text))


@cache
def folds() -> dict[str, str]:
    """What case folding makes of the characters that lower case leaves otherwise."""
    every = (chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return {c: c.casefold() for c in every if c.casefold() != c and c.lower() == c}


def casefold(text: Column) -> Column:
    """For comparing without case: lower case, characters that fold to one other, then those that
    fold to several, of which all but the commonest make a text be taken apart."""
    single = {c: f for c, f in folds().items() if len(f) == 1}
    several = {c: f for c, f in folds().items() if len(f) > 1 and c != "ß"}
    plain = F.replace(F.translate(F.lower(text), "".join(single), "".join(single.values())), F.lit("ß"), F.lit("ss"))
    pairs = F.map_from_arrays(F.array(*map(F.lit, several)), F.array(*map(F.lit, several.values())))

    def whole(t: Column) -> Column:
        letters = F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(pairs, c), c))
        return F.when(F.length(F.translate(t, "".join(several), "")) == F.length(t), t).otherwise(F.array_join(letters, ""))

    return F.when(text.isNotNull(), let(plain, whole))


def normalized_title(text: Column) -> Column:
    """A title for comparison: case folded, white space collapsed; null stays null."""
    return collapsed(casefold(text))


def console_safe(text: Column) -> Column:
    """For consoles of ASCII alone: other characters as backslash escapes of their code points."""

    def shown(c: Column) -> Column:
        code = F.ascii(c)
        digits = lambda n: F.lpad(F.lower(F.hex(code)), n, "0")
        wide = F.when(code < 0x100, F.concat(F.lit("\\x"), digits(2))).when(code < 0x10000, F.concat(F.lit("\\u"), digits(4)))
        return F.when(code < 0x80, c).otherwise(wide.otherwise(F.concat(F.lit("\\U"), digits(8))))

    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(letters, shown), "")).otherwise(text)


def contains_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts], F.lit(False))


def matches_any(text: Column, patterns) -> Column:
    """One alternation: whichever matches, the text is searched once."""
    return text.rlike(FLAGS + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")") if patterns else F.lit(False)


def word_set(normed: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(normed, F.lit(pattern), F.lit(0)))


def number_set(normed: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normed, F.lit(r"(?U)\b\d+(?:[.,]\d+)?\b"), F.lit(0)))


def stems_in(normed: Column, stems) -> Column:
    """Which of the stems the text contains."""
    found = [F.when(F.contains(normed, F.lit(s)), F.lit(s)) for s in stems]  # in a lambda, Spark would work ``normed`` out for each
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def jaccard(a: Column, b: Column) -> Column:
    """Of sets without duplicates; null if both are empty."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.try_divide(n, F.size(a) + F.size(b) - n))


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def clean(text: Column) -> Column:
    return collapsed(F.regexp_replace(text, EMOJI, ""))


def clean_start(text: Column, n: int) -> Column:
    """The first ``n`` characters of the cleaned text. Where a beginning is enough for them, only
    that is cleaned: nothing after it changes what is before it."""
    start = clean(F.substring(text, 1, 4 * n))
    enough = lambda c: (F.length(c) > n) | (F.length(text) <= 4 * n)
    return let(start, lambda c: F.when(enough(c), F.substring(c, 1, n)).otherwise(F.substring(clean(text), 1, n)))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, stripped; empty if there is none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINES), collapsed_ends)
    return F.coalesce(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), F.lit(""))


def collapsed_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def utf16_units(text: Column) -> Column:
    """The length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


def utf16_truncated(text: Column, units: int) -> Column:
    """The longest beginning of at most so many UTF-16 units that splits no character. Without
    characters of two units that is a beginning of so many characters."""

    def cut(short: Column) -> Column:
        # after each character the units so far; only beginnings with characters of two are taken apart
        letters = F.regexp_extract_all(short, F.lit("(?s)."), F.lit(0))
        none = F.struct(F.lit(0).alias("used"), F.lit(0).alias("kept"))

        def step(state: Column, c: Column) -> Column:
            used = state["used"] + F.when(F.ascii(c) > 0xFFFF, 2).otherwise(1)
            return F.struct(used.alias("used"), (state["kept"] + F.when(used <= units, 1).otherwise(0)).alias("kept"))

        kept = F.aggregate(letters, none, step, lambda s: s["kept"])
        return F.when(utf16_units(short) == F.length(short), short).otherwise(F.substring(short, F.lit(1), kept))

    return let(F.substring(text, 1, units), cut)


def first_sentence(text: Column, units: int = 320, cleaned: Column | None = None) -> Column:
    """Up to the first sentence end, else cut to ``units`` with an ellipsis. ``cleaned`` is the
    text after :func:`clean`, where a column has it already."""

    def shortened(cleaned: Column) -> Column:
        cut = F.regexp_replace(utf16_truncated(cleaned, units), r"(?U)\s+$", "")
        return let(cut, lambda c: F.when(c == cleaned, c).otherwise(F.concat(c, F.lit("…"))))

    def of(cleaned: Column) -> Column:
        found = F.regexp_extract(cleaned, r"(?Ud)^(.+?[.!?…])(?:\s|$)", 1)
        return let(found, lambda f: F.when(f != "", f).otherwise(shortened(cleaned)))

    return let(cleaned if cleaned is not None else clean(F.coalesce(text, F.lit(""))), of)


def rejection_title(title: Column, nothing: str = "Без заголовка", cleaned: Column | None = None) -> Column:
    """The first sentence if more follows, else the first 240 characters. ``cleaned`` as above."""

    def of(cleaned: Column) -> Column:
        first = F.regexp_extract(cleaned, r"(?Ud)^(.*?[.!?…])(?=\s|$).", 1)
        short = F.regexp_replace(F.substring(cleaned, 1, 240), r"(?U)\s+$", "")
        return let(first, lambda f: F.when(cleaned == "", nothing).when(f != "", f).otherwise(short))

    return let(cleaned if cleaned is not None else clean(F.coalesce(title, F.lit(""))), of)


def shown_source(name: Column, nothing: str = "Источник") -> Column:
    """A source's name for display: words in capitals of over three letters get one capital."""

    def of(flat: Column) -> Column:
        capitals = (F.upper(flat) == flat) & (F.lower(flat) != flat)
        parts = F.transform(F.split(flat, " "), lambda w: F.when(F.length(w) <= 3, w).otherwise(F.initcap(w)))
        return F.when(flat == "", nothing).when(capitals, F.array_join(parts, " ")).otherwise(flat)

    return let(collapsed(F.coalesce(name, F.lit(nothing))), of)


def story_terms(text: Column, pack) -> Column:
    """Stems of the words: the longest suffix goes that leaves four letters, then short stems,
    numbers and stop words."""
    suffixes = "|".join(sorted(pack.suffixes, key=len, reverse=True))
    lowered = F.translate(casefold(clean(F.coalesce(text, F.lit("")))), "ё", "е")
    found = F.filter(
        F.regexp_extract_all(lowered, F.lit(pack.story_word), F.lit(0)), lambda w: ~w.rlike(r"^\d+$")
    )
    # the shortest stem takes the longest suffix
    stems = F.transform(found, lambda w: F.regexp_replace(w, f"^(.{{4,}}?)(?:{suffixes})$", "$1"))
    stop = F.array(*[F.lit(s) for s in pack.stopwords])
    return F.array_distinct(F.filter(stems, lambda s: (F.length(s) >= 4) & ~F.array_contains(stop, s)))


def civil(ts: Column, hours: int = 6) -> Column:
    """The wall clock of a fixed offset from UTC, of a timestamp."""
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours))
