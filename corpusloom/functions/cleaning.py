"""Text cleaning as Column to Column functions.

A word character is a letter, mark, digit or underscore, in any script.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import foreign

# The cleaning patterns and what each puts in their place.
W = "[\\p{L}\\p{M}\\p{N}_]"
_WHITE = "\\t-\\r \\x{1c}-\\x{1f}\\x{85}\\p{Z}"
CONTROL = ("[\\x00-\\x1f\\x7f]", "")
ZERO_WIDTH = ("[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]", "")
PUNCT_SPACING = (f"({W}+|\"|')([!,:;?])([a-zA-Z]{W})", "$1$2 $3")
SPACE_BEFORE_PUNCT = (f"[{_WHITE}]([!',:;?.])", "$1")
OPEN_QUOTE = (f"({W})([«“'\"])", "$1 $2")
CLOSE_QUOTE = (f"([”’'\"])({W})", "$1 $2")
SEG_BASIC = (f"([{_WHITE}])(\\p{{Ll}}+)([.!?:]*)(\\p{{Lu}})(\\p{{Ll}}+)([{_WHITE}.,;:?!])", "$1$2$3\n$4$5$6")
SEG_QUOTES = (f"([{_WHITE}])(\\p{{Ll}}+)([.!?:]+)('|\")(\\p{{Lu}})(\\p{{Ll}}+)([{_WHITE}.,;:?!])", "$1$2$3\n$4$5$6$7")
PARAGRAPH_TAG = (f"[{_WHITE}]*(<p>)+", "\n")
OTHER_TAGS = (" *(<.*?> ?)+ *", " ")
URL = ("(?i)\\b((https?:\\/\\/)?(www\\.)?[\\p{L}0-9\\-._~%]+\\.[\\p{L}]{2,}(\\/[\\p{L}0-9\\-._~%!$&'()*+,;=:@/]*)?(\\?[^" + _WHITE + "]*)?)", "")
EMAIL = ("(?i)[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-z0-9-.]+", " <EMAIL> ")
HASHTAG = (f"(@[A-Za-z0-9_]+)|(#{W}+)", " <HASHTAG> ")
CITATION = (f"[{_WHITE},;:]*\\[\\p{{Nd}}{{1,3}}\\]", "")
#: What Python's str.strip and str.split take as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# End of fixed values.

#: The same matches with less going back: what follows a run can never be part of it, and a run of word characters
#: begins where the last match ended or where no word character stands before it.
_QUICK = {
    PUNCT_SPACING: (f"((?:\\G|(?<!{W})){W}++|\"|')([!,:;?])([a-zA-Z]{W})", "$1$2 $3"),
    SEG_BASIC: (SEG_BASIC[0].replace("\\p{Ll}+", "\\p{Ll}++").replace("[.!?:]*", "[.!?:]*+"), SEG_BASIC[1]),
    SEG_QUOTES: (SEG_QUOTES[0].replace("\\p{Ll}+", "\\p{Ll}++").replace("[.!?:]+", "[.!?:]++"), SEG_QUOTES[1]),
}

TEXT_STEPS = {
    "control": [CONTROL],
    "zero_width": [ZERO_WIDTH],
    "punct_spacing": [PUNCT_SPACING],
    "space_before_punct": [SPACE_BEFORE_PUNCT],
    "open_quote": [OPEN_QUOTE],
    "close_quote": [CLOSE_QUOTE],
    "seg_basic": [SEG_BASIC],
    "seg_quotes": [SEG_QUOTES],
}
HTML_STEPS = {"html_tags": [PARAGRAPH_TAG, OTHER_TAGS], "urls": [URL], "email": [EMAIL], "hashtag": [HASHTAG], "citations": [CITATION]}


def replaced(text: Column, steps) -> Column:
    for step in steps:
        pattern, by = _QUICK.get(step, step)
        text = F.regexp_replace(text, pattern, by)
    return text


def _step(steps) -> Callable[[Column], Column]:
    return lambda text: replaced(text, steps)


STEPS: dict[str, Callable[[Column], Column]] = {name: _step(s) for name, s in {**TEXT_STEPS, **HTML_STEPS}.items()}


def clean_marks(text: Column, keep_newlines: bool = False) -> Column:
    """All text steps in order, without those for Unicode and encoding.  Line feeds go with the control characters unless they are kept."""
    control = "\\x00-\\x09\\x0b-\\x1f\\x7f" if keep_newlines else "\\x00-\\x1f\\x7f"
    both = (f"[{control}\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{FEFF}}]", "")  # the two steps that only drop characters
    return replaced(text, [both, *[s for name in list(TEXT_STEPS)[2:] for s in TEXT_STEPS[name]]])


def clean_text(text: Column, keep_newlines: bool = False) -> Column:
    """The whole chain: Unicode form, encoding repair, then the marks."""
    return clean_marks(foreign.fix_encoding(foreign.unicode_form("NFC")(text)), keep_newlines)


def clean_html(text: Column) -> Column:
    return replaced(text, [s for name in HTML_STEPS for s in HTML_STEPS[name]])


def squeeze(text: Column) -> Column:
    """Null as empty; white space inside as one space, none around."""
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), "(?U)[\\s\\x1c-\\x1f]+", " ")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def flatten_paragraphs(paragraphs: Column) -> Column:
    """Nested sentences: joined by spaces, paragraphs by line feeds."""
    return F.array_join(F.transform(paragraphs, lambda p: F.array_join(p, " ")), "\n")


# Language-aware punctuation rules, in order.
MOSES = (
    ("\\r", ""), ("\\(", " ("), ("\\)", ") "), (" +", " "), ("\\) ([.!:?;,])", ")$1"), ("\\( ", "("), (" \\)", ")"), ("(\\d) %", "$1%"), (" :", ":"), (" ;", ";"),
    ("„|“|”", "\""), ("–", "-"), ("—", " - "), (" +", " "), ("´", "'"), ("([a-z])[‘’]([a-z])", "$1'$2"), ("[‘‚’]", "'"), ("''", "\""), ("´´", "\""), ("…", "..."),
    ("\\u00A0«\\u00A0|«\\u00A0|«", "\""), ("\\u00A0»\\u00A0|\\u00A0»|»", "\""), ("\\u00A0%", "%"), ("nº\\u00A0", "nº "), ("\\u00A0([:;!?])", "$1"), (",\\u00A0", ", "),
)
# End of fixed values.


def moses_punctuation(text: Column, lang: Column | str = "en") -> Column:
    """Quotes, dashes and spaces as the public Moses scripts write them; digit marks by language."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    out = replaced(text, MOSES)
    commas = F.regexp_replace(out, "(\\d)\\u00A0(\\d)", "$1.$2")
    return F.when(lang == "en", F.regexp_replace(F.regexp_replace(out, "\"([,.]+)", "$1\""), "(\\d)\\u00A0(\\d)", "$1.$2")).otherwise(
        F.when(lang.isin("de", "es", "cz", "cs", "fr"), F.regexp_replace(out, "(\\d)\\u00A0(\\d)", "$1,$2")).otherwise(commas)
    )
