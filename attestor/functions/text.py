"""Text normalisation as Column expressions. Whole strings only; operators.views also keeps source offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def fold(text: Column) -> Column:
    """Zero-width characters out, quotes and dashes to ASCII, the ellipsis to three dots."""
    plain = "'" * len(P.SINGLE_QUOTES) + '"' * len(P.DOUBLE_QUOTES) + "-" * len(P.DASHES)
    text = F.translate(text, P.SINGLE_QUOTES + P.DOUBLE_QUOTES + P.DASHES + P.ZERO_WIDTH, plain)
    return F.replace(text, F.lit(P.ELLIPSIS), F.lit("..."))


def collapse(text: Column, run: str = P.WS_RUN) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, run, " "))


def keep_view(text: Column) -> Column:
    """The keep view of text that is already in compatibility form."""
    return collapse(fold(text))


def join_view(keep: Column) -> Column:
    """Words broken at a line end rejoined: "- " goes between a letter and a lower-case letter.

    The pattern begins with what it takes out and looks back from there, so most characters fail at one comparison.
    """
    return F.regexp_replace(keep, r"- (?<=\p{L}- )(?=\p{Ll})", "")


def loose_key(keep: Column) -> Column:
    """The loose view of a keep view, in which all white space is single spaces."""
    return F.replace(keep, F.lit(" "), F.lit(""))


def value_key(text: Column) -> Column:
    """A value as compared in edits."""
    spaced = F.translate(text, "\u00a0\u200b\u200e\u200f\ufeff", "     ")
    return collapse(F.translate(spaced, "\u2018\u2019\u201c\u201d\u2013\u2014", "''\"\"--"), P.SPACE_RUN)


def strip_commas(text: Column) -> Column:
    """Commas between digits go, in one pass from the left."""
    return F.regexp_replace(text, r"(\d),(\d)", "$1$2")


def exact_key(text: Column) -> Column:
    return js_trim(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "[ \t]+", " "))


def js_trim(text: Column) -> Column:
    return F.trim(text, F.lit(P.SPACE_CHARS))


def cosmetic_key(text: Column) -> Column:
    """Equal where a change is cosmetic only. The first word always goes, with or without a label before it."""
    bare = F.regexp_replace(F.lower(text), rf"^(?:section|article|clause)?{P.SPACE}*[\d.a-z\-:()]+{P.SPACE}*", "")
    return collapse(F.regexp_replace(bare, P.ONE_OF_NEITHER, ""), P.SPACE_RUN)


def title_key(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), P.ONE_OF_NEITHER, ""), P.SPACE_RUN)


def slug(text: Column, default: str = "org") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(made == "", default).otherwise(made)


def plain_slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def digit_mask(text: Column) -> Column:
    return F.lower(F.regexp_replace(js_trim(text), r"\d+", "#"))


def query_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def bare_page_number(text: Column) -> Column:
    """12, - 12 -, [12], Page 12 and Page 12 of 150."""
    t = js_trim(text)
    return t.rlike(rf"^\d{{1,4}}$|^[-\u2013\u2014\s]*\d{{1,4}}[-\u2013\u2014\s]*$|^\[\s*\d{{1,4}}\s*\]$|(?i)^page\s+\d{{1,4}}(\s+of\s+\d{{1,4}})?$")


def tokens(chars: Column) -> Column:
    """Estimated tokens of so many characters."""
    return F.ceil(chars / 4).cast("long")


def truncated(text: Column, most: int = 12_000, mark: str = "\n\n[... truncated ...]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences, split after . ! or ? before white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def highlighted(text: Column, query: Column) -> Column:
    """The query's words marked, whatever their case."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    quoted = F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([.*+?^${}()|\[\]\\])", r"\\$1")), "|")
    return F.when(F.size(words) > 0, F.regexp_replace(text, F.concat(F.lit("(?i)("), quoted, F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(text)


def escaped_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def byte_size(n: Column, largest: str = "MB") -> Column:
    """B, KB or MB with one decimal, ties to the even digit; null for null. With largest "KB" there is no MB."""
    unit = lambda by, name: F.format_string(f"%.1f {name}", F.bround(n / by, 1))
    kb = unit(1024.0, "KB")
    size = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    return size.when(n.isNotNull(), kb if largest == "KB" else F.when(n < 1024 * 1024, kb).otherwise(unit(1024.0 * 1024.0, "MB")))


def relative_time(then: Column, now: Column) -> Column:
    """Whole minutes, hours or days ago, counted to the microsecond."""
    passed = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    minutes = F.floor(passed / 60_000_000)  # a double holds 285 years of microseconds
    hours = F.floor(minutes / 60)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))


def masked(secret: Column) -> Column:
    return F.concat(F.lit("***"), F.right(secret, F.lit(4)))


def kept_secret(given: Column, stored: Column) -> Column:
    """A masked or empty input keeps what is stored."""
    return F.when(given.isNull() | (given == "") | given.startswith("***"), stored).otherwise(given)


def progress(page: Column, pages: Column) -> Column:
    return F.least(F.lit(75), F.floor(F.lit(15) + page / pages * 60 + 0.5).cast("int"))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")


def stepped(index: Column, n: Column, by: int) -> Column:
    """The next (1) or previous (-1) of n occurrences, numbered from 0, in a cycle."""
    return F.pmod(index + F.lit(by), n)


def unfenced(text: Column) -> Column:
    """A model's JSON without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def outermost_json(text: Column) -> Column:
    """The outermost object, else the outermost array, of a text."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(F.regexp_extract(text, r"(?s)\[.*\]", 0))
