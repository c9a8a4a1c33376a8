"""Text columns: search form, escapes, passages, quotes, units, dice and durations."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tomeforge.functions.batches import bounded

#: Accented letters of Latin-1 in lower case, and the letters below the accents (fixed values).
ACCENTED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def _bare(text: str | None) -> str | None:
    return None if text is None else re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", text)).lower()


@pandas_udf(T.StringType())
def _without_marks(text: pd.Series) -> pd.Series:
    return text.map(_bare)


def search_form(text: Column) -> Column:
    """Lower case without accents, every run of other than a-z and 0-9 one blank, trimmed; null gives ''.

    Texts up to Latin-1 stay in the JVM; only others go to Python, to be decomposed.
    """
    latin = F.translate(F.lower(text), ACCENTED, BARE)
    wide = _without_marks(F.when(text.rlike(r"[^\u0000-\u00ff]"), text))
    return F.trim(F.regexp_replace(F.coalesce(wide, latin, F.lit("")), "[^a-z0-9]+", " "))


def search_words(query: str) -> list[str]:
    """The words of a query in search form."""
    return re.sub("[^a-z0-9]+", " ", _bare(query)).split()


#: What each Latin-1 character is in search form; blanks for those that separate words.
_FORMS = bytes(ord(b) if (b := dict(zip(ACCENTED, BARE, strict=True)).get(c, c)).isascii() and b.isalnum() else 32 for c in (chr(i).lower() for i in range(256)))


def form_of(text: str | None) -> str:
    """search_form() of one text inside a Python task; texts up to Latin-1 take a table instead of a decomposition."""
    try:
        return b" ".join((text or "").encode("latin-1").translate(_FORMS).split()).decode("ascii")
    except UnicodeEncodeError:
        return " ".join(search_words(text))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(character), F.lit(entity))
    return out


def contains_form(parts: list[Column], query: str, section: Column | None = None, wanted: str | None = None) -> Column:
    """Whether the parts, joined by blanks, contain the query in search form; optionally one section only."""
    found = F.contains(search_form(F.concat_ws(" ", *parts)), F.lit(" ".join(search_words(query))))
    return found if wanted is None else found & (section == wanted)


def dice(text: Column) -> Column:
    """{dice, pips, total_pips, raw} of `2D+1` and the like; null for anything else."""
    pattern = r"^\s*([0-9]{1,3})[dD](?:\s*\+\s*([012]))?\s*\z"
    count = F.regexp_extract(text, pattern, 1).try_cast("int")
    pips = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("int"), F.lit(0))
    return F.when(text.rlike(pattern), F.struct(count.alias("dice"), pips.alias("pips"), (count * 3 + pips).alias("total_pips"), text.alias("raw")))


def collapsed(text: Column) -> Column:
    """The form in which texts count as equal whatever their line breaks and case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def image_links(markdown: Column) -> Column:
    """Targets of `![..](..)` that are files: no http, https or data."""
    found = F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
    return F.filter(found, lambda x: ~x.rlike("^(?:https?|data):"))


def page_header(markdown: Column) -> Column:
    """{source, unit_kind, unit} of a page's leading comment; nulls where it has none."""
    pattern = r"^<!--\s*source:\s*([^;]+?)\s*;\s*(pdf_page|document_unit):\s*([0-9]+)"
    text = lambda i: F.nullif(F.regexp_extract(markdown, pattern, i), F.lit(""))
    return F.struct(text(1).alias("source"), text(2).alias("unit_kind"), text(3).try_cast("int").alias("unit"))


def passage(markdown: Column, start: str | None, end: str | None) -> Column:
    """The trimmed text from an anchor to the next one; without a start, what follows the first comment.

    Null where an anchor is missing or nothing is between. Without a start and a comment the passage
    begins at the third character, which the original does and callers rely on.
    """
    begin = F.instr(markdown, start) if start else F.instr(markdown, "-->") + 3
    known = begin > 0 if start else F.lit(True)
    after = begin + (len(start) if start else 0)
    if end:
        stop = F.call_function("locate", F.lit(end), markdown, F.greatest(after, F.lit(1)))
    else:
        stop = F.length(markdown) + 1
    return F.when(known & (stop >= begin) & (stop > 0), F.nullif(F.trim(F.substring(markdown, begin, stop - begin)), F.lit("")))


def quote_pieces(text: str | None, most: int = 1100) -> list[str]:
    """Pieces of at most `most` UTF-16 units, cut at the last blank where there is one; blank ones go."""
    raw = (text or "").encode("utf-16-le", "surrogatepass")
    size, start, out = len(raw) // 2, 0, []
    cut = lambda a, b: raw[2 * a : 2 * b].decode("utf-16-le", "surrogatepass")
    while start < size:
        end = min(start + most, size)
        if end < size:
            blank = cut(start, end + 1).rfind(" ")
            wide = cut(start, end + 1)
            if blank > 0:
                end = start + len(wide[:blank].encode("utf-16-le", "surrogatepass")) // 2
        if piece := cut(start, end).strip():
            out.append(piece)
        start = end
    return out


@pandas_udf(T.ArrayType(T.StringType()))
def quote_units(text: pd.Series) -> pd.Series:
    return text.map(quote_pieces)


def quoted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, quote) of each text's quote_units(), in Python tasks that hold few texts at once."""
    bounded(texts.sparkSession)
    return texts.select(key, F.posexplode(quote_units(text)).alias("n", "quote"))


def paragraph_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, body, start, end) of a text's stretches, which end behind blank lines and together are the text; keys are unique.

    Offsets are a running sum of the stretches' lengths.
    """
    stretches = F.regexp_extract_all(F.col(text), F.lit(r"(?s).+?(?:\n\s*\n|\z)"), F.lit(0))
    rows = texts.select(key, F.posexplode(stretches).alias("n", "body"))
    end = F.sum(F.length("body")).over(Window.partitionBy(key).orderBy("n"))
    return rows.select(key, "n", "body", (end - F.length("body")).cast("int").alias("start"), end.cast("int").alias("end"))


NATIVE_TEXT_MARKER = "<!-- native-text-supplement: pdf-text-layer; uncorrected -->"


def with_native_text(text: Column, native: Column) -> Column:
    """The text with the page's native layer after a marker, once."""
    lines = F.array_join(F.transform(F.split(F.btrim(native, F.lit(" \t\r\n")), "\n"), lambda x: F.regexp_replace(x, r"\s+\z", "")), "\n")
    added = F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit(f"\n\n{NATIVE_TEXT_MARKER}\n\n"), lines, F.lit("\n"))
    return F.when(F.contains(text, F.lit(NATIVE_TEXT_MARKER)), text).otherwise(added)


def format_hours(hours: Column, unknown: str = "inconnue") -> Column:
    """`1 j 2 h 5 min` with zero parts left out, `0 h` for nothing."""
    minutes = F.floor(hours * 60 + 0.5)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    days, rest, left = F.floor(minutes / 1440), F.floor(minutes % 1440 / 60).cast("long"), minutes % 60
    text = F.concat_ws(" ", part(days, " j"), part(rest, " h"), part(left, " min"))
    return F.when(hours.isNull(), unknown).otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("0 h")))


def duration_label(least: Column, most: Column, factor: float = 1.0) -> Column:
    low, high = format_hours(least * factor), format_hours(most * factor)
    return F.when(least.isNull() | most.isNull(), "Durée inconnue").when(least == most, low).otherwise(F.concat(low, F.lit(" – "), high))


def stable_id(sha256: Column) -> Column:
    return F.concat(F.lit("src-"), F.substring(sha256, 1, 16))


def safe_path(path: Column) -> Column:
    """A relative path without traversal, drive or protocol."""
    return path.isNotNull() & ~path.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|[/\\])|(?:^|[/\\])\.\.(?:[/\\]|\z)|\x00") & (path != "")
