"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a trim removes, punctuation that parts query terms, ranges of characters
#: that are words of their own.
TRIM = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PUNCTUATION = r"[，。！？、；：\"'（）【】《》,.!?;:()\[\]{}<>|\\/]"
SINGLE = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
HASHTAG = r"#([A-Za-z0-9_\u4e00-\u9fa5]{1,24})"
MENTION = r"@([A-Za-z][A-Za-z0-9_]{4,31})"
BLOCK_END = r"(?i)</(p|div|blockquote|li|tr|h[1-6])>"


def trimmed(c: Column) -> Column:
    """Without white space at its ends; only these are looked at."""
    return F.btrim(c, F.lit(TRIM))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def len16(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _character(digits: Column, base: int) -> Column:
    """The character of a number in decimal or hexadecimal digits, as an array of one; null for no character."""
    # longer numbers are no characters, and beyond what conv takes
    n = F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 8, F.conv(digits, base, 10).cast("long"))
    good = n.isNotNull() & (n >= 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _numeric(t: Column) -> Column:
    """A text with its numeric entities decoded; those of no character stay. Texts without any aren't cut."""
    def piece(x: Column, i: Column) -> Column:
        hexadecimal = F.regexp_extract(x, "^[xX]([0-9a-fA-F]+);", 1)
        decimal = F.regexp_extract(x, "^([0-9]+);", 1)
        made = F.when(hexadecimal != "", _character(hexadecimal, 16)).when(decimal != "", _character(decimal, 10))
        rest = F.substring(x, F.instr(x, ";") + 1, F.length(x))
        return F.when(i == 0, x).when(made.isNotNull(), F.concat(made, rest)).otherwise(F.concat(F.lit("&#"), x))

    return F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(F.split(t, "&#"), piece), "")).otherwise(t)


def decode_entities(c: Column, numeric: bool = True) -> Column:
    """Named entities, numeric ones, ``&amp;`` last; null gives an empty text."""
    c = or_empty(c)
    for name, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&apos;", "'")):
        c = F.replace(c, F.lit(name), F.lit(plain))
    if numeric:
        c = F.transform(F.array(c), _numeric)[0]
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def strip_tags(c: Column, numeric: bool = True) -> Column:
    """Line breaks for block ends, then no tags, entities decoded, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(or_empty(c), r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, BLOCK_END, "\n")
    c = decode_entities(F.regexp_replace(c, "<[^>]*>", ""), numeric)
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\u00a0]+\n", "\n"), r"\n{3,}", "\n\n")
    return trimmed(c)


def normalize_text(c: Column) -> Column:
    """Without zero-width characters, with single blanks and line breaks, trimmed; null gives an empty text."""
    for unseen in "\u200b\ufeff":
        c = F.replace(or_empty(c), F.lit(unseen), F.lit(""))
    # a blank alone is passed over: replaced by itself, every word would cost a match
    c = F.regexp_replace(F.regexp_replace(c, r"[\t\u00a0][ \t\u00a0]*| [ \t\u00a0]+", " "), r"\n{2,}", "\n")
    return trimmed(c)


def split_terms(c: Column) -> Column:
    """Query terms: cut at punctuation and white space, none empty."""
    return F.array_remove(F.split(or_empty(c), rf"[\s{PUNCTUATION[1:-1]}]+"), "")


def to_gram(c: Column) -> Column:
    """Blanks around each single-word character, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(or_empty(c), f"({SINGLE})", " $1 "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words of the grammed text."""
    # the cut takes white space of any length, so it isn't made single first as in ``to_gram``
    return F.array_remove(F.split(F.lower(F.regexp_replace(or_empty(c), f"({SINGLE})", " $1 ")), r"[^\p{L}\p{N}]+"), "")


def hashtags(c: Column) -> Column:
    """All hashtags in order, repeated ones too."""
    return F.regexp_extract_all(or_empty(c), F.lit(HASHTAG), 1)


def mentions(c: Column, lower: bool = True) -> Column:
    """Distinct handles of a text, lower-cased or as they are written."""
    found = F.regexp_extract_all(or_empty(c), F.lit(MENTION), 1)
    return F.array_distinct(F.transform(found, F.lower) if lower else found)


def view_count(c: Column) -> Column:
    """``1.2K`` or ``3M`` as a number; null for what isn't one."""
    c = F.trim(c)
    number = F.regexp_extract(c, r"^([\d.]+)\s*([KMkm])?$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, r"^([\d.]+)\s*([KMkm])?$", 2))
    return F.floor(number * F.when(unit == "k", 1000.0).when(unit == "m", 1e6).otherwise(1.0) + 0.5).cast("long")


def key_terms(c: Column) -> Column:
    """Four-character pieces of the first four runs of ideographs (six at most), then the first six Latin words."""
    runs = F.slice(F.regexp_extract_all(or_empty(c), F.lit("([\u4e00-\u9fa5]{3,})"), 1), 1, 4)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r), F.lit(4)), lambda i: F.substring(r, i, F.lit(4)))))
    grams = F.slice(F.filter(grams, lambda g: F.length(g) >= 3), 1, 6)
    words = F.slice(F.regexp_extract_all(or_empty(c), F.lit("([A-Za-z][A-Za-z0-9_.-]{2,})"), 1), 1, 6)
    return F.array_distinct(F.concat(grams, words))


def fnv(c: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 units of a text. For comparison only: equal texts are found by the texts."""
    units = F.transform(F.sequence(F.lit(0), len16(c) - 1), lambda i: F.conv(F.substring(F.hex(F.encode(c, "UTF-16BE")), i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(c) > 0, units).otherwise(F.array().cast("array<long>"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(0x01000193), F.lit(1 << 32)))


def one_line(c: Column, most: int) -> Column:
    """White space as single blanks, cut to ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(or_empty(c), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def escape_html(c: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(name))
    return c


def without_controls(c: Column) -> Column:
    """Without the control characters that a workbook refuses."""
    return F.regexp_replace(or_empty(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")




def citations(c: Column) -> Column:
    """Numbers of the sources that an answer names, ``[3]``, in order, repeated ones too."""
    return F.transform(F.regexp_extract_all(or_empty(c), F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))


def batch_lines(c: Column, most: int = 500) -> Column:
    """Lines pasted for a batch: trimmed, none empty, ``most`` at most."""
    return F.slice(F.filter(F.transform(F.split(or_empty(c), "\n"), trimmed), lambda x: x != ""), 1, most)
