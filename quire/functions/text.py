"""Text functions as Catalyst expressions: cleaning, folding, markers, guesses."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() takes it, for use inside a character class.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0  -     　"

#: What cleaning writes for typographic characters.
CLEAN_CHARS = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl",
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"',
    "\u2013": "-", "\u2014": "-", "\u2212": "-",
    "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\ufeff": "",
    "\u2026": "...",
}
#: Bullets of list items.
BULLETS = "\u2022\u25cf\u25aa\u25a0\u25e6\u2043\u2219\u00b7-*\u2013\u2014>"
#: The forms of ordered markers, heading numbers and captions.
ORDERED = r"^\(?(\d{1,3}|[a-zA-Z]|[ivxIVX]{1,6})[\.\)\-]\s+"
HEADING_NUMBER = r"^(\d{1,2}(?:\.\d{1,2}){0,4})\.?\s+\S"
CAPTION = r"^(fig(ura)?|tabla|cuadro|imagen|foto|graf(ico)?)\.?\s*\d"
SYMBOL_FONT = r"(?i)symbol|dingbat|wingding|webding|zapf"
BOLD_FONT, ITALIC_FONT = r"(?i)bold|black|heavy|semib|demi", r"(?i)italic|oblique"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, f"[{SPACE_CLASS}]+", " "))


def clean(c: Column) -> Column:
    """Plain characters for typographic ones, no control characters, single spaces; newlines stay."""
    single = {k: v for k, v in CLEAN_CHARS.items() if len(v) == 1}
    out = F.translate(F.coalesce(c, F.lit("")), "".join(single) + "\ufeff", "".join(single.values()))
    for k, v in CLEAN_CHARS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return strip(F.regexp_replace(out, r"[ \t]{2,}", " "))


@lru_cache(1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """(characters, what each becomes, longer replacements) by compatibility decomposition of the Latin blocks."""
    one, to, more = [], [], {}
    gone = []
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0x2000, 0x2070)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if plain == chr(code):
            continue
        if len(plain) == 1:
            one.append(chr(code))
            to.append(plain)
        elif plain:
            more[chr(code)] = plain
        else:
            gone.append(chr(code))
    gone += [chr(x) for x in range(0x300, 0x370) if unicodedata.combining(chr(x))]
    return "".join(one + gone), "".join(to), more


def strip_accents(c: Column) -> Column:
    """Letters without marks: exact for Latin text; other scripts keep their characters."""
    chars, to, more = _accent_tables()
    out = F.translate(c, chars, to)
    slow = out
    for k, v in more.items():
        slow = F.replace(slow, F.lit(k), F.lit(v))
    return F.when(out.rlike(f"[{''.join(more)}]"), slow).otherwise(out)


def fold(c: Column) -> Column:
    """Key for comparing: no marks, lower case, single spaces. ASCII text takes the short way."""
    text = F.coalesce(c, F.lit(""))
    return collapse(F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(strip_accents(text))))


def is_letter(c: Column) -> Column:
    return c.rlike(r"^\p{L}")


def dehyphenate(prev: Column, following: Column) -> Column:
    """prev and following as one word if prev ends in a hyphen and following goes on in small letters, else null."""
    fits = prev.rlike(r"(?s)^.*\p{L}-$") & (F.length(prev) >= 3) & following.rlike(r"^\p{L}") & ~following.rlike(r"^\p{Lu}")
    return F.when(fits, F.concat(F.substr(prev, F.lit(1), F.length(prev) - 1), following))


def list_marker(text: Column, first_word: Column | None = None, first_font: Column | None = None) -> Column:
    """struct(marker, ordered) of a line that opens a list item, else null."""
    bullets = BULLETS.replace("-", "") + r"\-"
    bullet = F.regexp_extract(text, f"(?U)^([{bullets}])\\s+", 1)
    ordered = F.regexp_extract(text, f"(?U){ORDERED}", 0)
    body = F.regexp_extract(text, f"(?U){ORDERED}", 1)
    made = lambda m, o: F.struct(m.alias("marker"), F.lit(o).alias("ordered"))
    out = F.when(bullet != "", made(bullet, False)).when((ordered != "") & (F.length(body) <= 3), made(strip(ordered), True))
    if first_word is not None:
        symbol = (F.length(first_word) == 1) & F.coalesce(first_font, F.lit("")).rlike(SYMBOL_FONT)
        out = out.when(symbol, made(first_word, False))
    return out


def heading_number(text: Column) -> Column:
    """The section number a line begins with, else null."""
    found = F.regexp_extract(text, f"(?U){HEADING_NUMBER}", 1)
    return F.when(found != "", found)


def is_caption(text: Column) -> Column:
    return fold(text).rlike(f"(?U){CAPTION}")


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def looks_like_garbage(text: Column) -> Column:
    """Few letters and digits, or many replacement and private characters, in 40 characters or more."""
    n = F.length(text)
    weird = n - F.length(F.regexp_replace(text, r"[�-]", ""))
    return (n >= 40) & ((alnum_count(text) / F.greatest(n, F.lit(1)) < 0.35) | (weird / F.greatest(n, F.lit(1)) > 0.05))


def escape_md(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def escape_yaml(c: Column) -> Column:
    """A quoted scalar; empty for null."""
    return F.concat(F.lit('"'), strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))), F.lit('"'))


def escape_html(c: Column) -> Column:
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def slugify(c: Column, maxlen: int = 40) -> Column:
    s = F.lower(F.btrim(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), "[^a-zA-Z0-9]+", "-"), F.lit("-")))
    s = F.rtrim(F.left(s, F.lit(maxlen)), F.lit("-"))
    return F.when(s == "", F.lit("sin-titulo")).otherwise(s)


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def font_style(font: Column) -> Column:
    """struct(bold, italic) from the name of a font."""
    name = F.coalesce(font, F.lit(""))
    return F.struct(name.rlike(BOLD_FONT).alias("bold"), name.rlike(ITALIC_FONT).alias("italic"))


def context(text: Column, start: Column, end: Column, width: int = 46) -> Column:
    """What surrounds text[start:end], on one line, with dots where it is cut."""
    a, b = F.greatest(F.lit(0), start - width), F.least(F.length(text), end + width)
    middle = collapse(F.substr(text, a.cast("int") + 1, (b - a).cast("int")))
    return F.concat(F.when(a > 0, "...").otherwise(""), middle, F.when(b < F.length(text), "...").otherwise(""))
