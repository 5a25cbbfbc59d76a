"""Forms in which texts compare: by looks, by content, and as the words a reader sees."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of other scripts drawn like Latin ones, each above its Latin twin, by script. Fixed values.
CYRILLIC_LIKE = "АВЕЅІЈКМНОРСТУХҮԌԚԜӀѴ" + "аеѕіјорсухһԁԛԝӏѵ"
CYRILLIC_TWIN = "ABESIJKMHOPCTYXYGQWIV" + "aesijopcyxhdqwlv"
GREEK_LIKE, GREEK_TWIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" + "οϲϳ", "ABEZHIKMNOPTYXCJ" + "ocj"
ARMENIAN_LIKE, ARMENIAN_TWIN = "ՕՍ" + "օսոհ", "OU" + "ounh"
CHEROKEE_LIKE, CHEROKEE_TWIN = "ᎪᎠᎡᎢᏔᎷᎻᏀᏃᏢᏙᎫᎬᏞᏟᏚᏦᏴ", "ADRTWMHGZPVJELCSKB"
LOOK_ALIKE = CYRILLIC_LIKE + GREEK_LIKE + ARMENIAN_LIKE + CHEROKEE_LIKE
LATIN_TWIN = CYRILLIC_TWIN + GREEK_TWIN + ARMENIAN_TWIN + CHEROKEE_TWIN
#: Hyphens drawn like the ASCII one. Fixed values.
HYPHENS = "‐‑"
#: Default-ignorable code points (nothing is drawn for them) as inclusive ranges. Fixed values.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Compatibility forms that keep their looks when replaced; raised, lowered, circled and squared forms don't.
SAME_LOOKS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>")

_TWIN = {ord(a): ord(b) for a, b in zip(LOOK_ALIKE, LATIN_TWIN, strict=True)} | {ord(h): 0x2D for h in HYPHENS}
#: Back to Cyrillic, the first letter of those with one twin.
_CYRILLIC = {ord(b): ord(a) for a, b in reversed(list(zip(CYRILLIC_LIKE, CYRILLIC_TWIN, strict=True)))}


def ignorable(code: int) -> bool:
    """Whether nothing is drawn for a code point; control characters other than white space count too."""
    return any(a <= code <= b for a, b in IGNORABLE) or (unicodedata.category(chr(code)) == "Cc" and not chr(code).isspace())


def _space(char: str) -> bool:
    return char.isspace()


class _Looks(dict):
    """Translation table by looks, filled as code points are met."""

    def __missing__(self, code: int) -> str | int | None:
        char = chr(code)
        out: str | int | None = code
        if ignorable(code):
            out = None
        elif _space(char):
            out = " "
        elif code in _TWIN:
            out = _TWIN[code]
        elif unicodedata.decomposition(char).startswith(SAME_LOOKS):
            wide = unicodedata.normalize("NFKC", char)
            out = code if wide[0] == " " else wide.translate(self)
        self[code] = out
        return out


class _Plain(dict):
    """Translation table for content: nothing for ignorable signs, a blank for white space, Latin twins if asked."""

    def __init__(self, twins: bool, keep_lines: bool = False) -> None:
        super().__init__()
        self.twins, self.keep_lines = twins, keep_lines

    def __missing__(self, code: int) -> str | int | None:
        char = chr(code)
        out: str | int | None = code
        if ignorable(code):
            out = None
        elif _space(char):
            out = code if self.keep_lines and char in "\n\r" else " "
        elif self.twins and code in _TWIN:
            out = _TWIN[code]
        self[code] = out
        return out


_LOOKS, _PLAIN, _LINES = _Looks(), _Plain(False), _Plain(True, True)
_OWN_WORD = re.compile(r"[^\W_]*[\u0400-\u052f][^\W_]*")
_PRINTABLE = re.compile(r"[!-~](?:[ -~]*[!-~])?\Z")


def looks(text: str | None) -> str | None:
    """Key under which texts that look the same are equal: invisible signs and surrounding white space don't count, any
    white space is a blank, wide forms, ligatures, composed accents and look-alike letters are one; case, accents, raised
    digits and signs drawn differently stay apart. Null stays null.
    """
    if text is None or (text.isascii() and _PRINTABLE.match(text)):
        return text
    return unicodedata.normalize("NFC", text.translate(_LOOKS)).translate(_LOOKS).strip(" ")


def one_form(text: str | None) -> str | None:
    """Compatibility-composed, fully case-folded text with single plain blanks, without ignorable signs. It is made from
    `looks`, so texts that look the same have one form: look-alike letters are Latin, but in words with a letter that only
    Cyrillic has they are Cyrillic. Null stays null.
    """
    if text is None:
        return None
    if text.isascii():
        return " ".join(text.translate(_PLAIN).casefold().split())
    while True:
        form = unicodedata.normalize("NFKC", looks(unicodedata.normalize("NFKC", looks(text))))
        form = _OWN_WORD.sub(lambda m: m[0].translate(_CYRILLIC), form)
        form = " ".join(unicodedata.normalize("NFKC", form.casefold()).split())
        if form == text:
            return form
        text = form


def _by_distinct(f):  # noqa: ANN001, ANN202
    def run(batches: Iterable[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            codes, distinct = pd.factorize(texts, use_na_sentinel=True)
            forms = pd.Series([f(t) for t in distinct] + [None], dtype=object)
            yield pd.Series(forms.to_numpy()[codes], index=texts.index)

    return run


def looks_column(text: Column) -> Column:
    """`looks` of a column, computed once per distinct value of an Arrow batch."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _by_distinct(looks)(batches)

    return form(text)


def one_form_column(text: Column) -> Column:
    """`one_form` of a column, computed once per distinct value of an Arrow batch."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _by_distinct(one_form)(batches)

    return form(text)


#: Elements that begin a new line or cell; tags of others stand inside words. Fixed values.
BLOCK_TAGS = "p|div|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|table|thead|tbody|tfoot|tr|td|th|caption|pre|blockquote|section|article"
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BLOCK = re.compile(rf"</?(?:{BLOCK_TAGS})\b[^<>]*>", re.I)
_INLINE = re.compile(r"</?[A-Za-z][^<>]*>")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|[{}]")
#: Signs that may stand inside a word without ending it, and the sign that takes the place of a hyphen at a line end.
GLUE = "*_~`\x02"
_WRAP = re.compile(r"[-\u2010\u2011\u00ad][ \t]*\r?\n[ \t]*")
_WORD = re.compile(r"[^\W_]+")
_GLUED = re.compile(rf"[^\W_]+(?:[{GLUE}]+[^\W_]+)*")
_SIGNS = re.compile(f"[{GLUE}]+")


_SPECIAL = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "".join(map(chr, _TWIN)) + "]")


#: Links by what marks them: all but the shown text goes.
_LINKS = (
    ("](", re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:\s+[\"'][^\n\"']*[\"'])?\)")),
    ("[[", re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]")),
    ("://", re.compile(r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]\n]*)\]")),
    ("\\href", re.compile(r"\\href\{[^{}\n]*\}\{([^{}]*)\}")),
)


def without_tags(text: str) -> str:
    """Text with character references resolved, however often escaped, comments and tags gone, links reduced to what they
    show, LaTeX commands to their arguments.
    """
    while "&" in text:
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    for sign, pattern in _LINKS:
        if sign in text:
            text = pattern.sub(r"\1", text)
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub("\n", _COMMENT.sub("", text)))
    if "{" in text:
        text = _COMMAND.sub("", text)
    return text


def reader_text(text: str) -> str:
    """Text as compared word by word: no markup, no invisible signs, one case, twins Latin; a hyphen that wraps a line is
    the sign \\x02, other line ends stay.
    """
    text = without_tags(text)
    if "\n" in text:
        text = _WRAP.sub("\x02", text)
    if text.isascii():
        return text.lower()
    if _SPECIAL.search(text):
        text = text.replace("\x02", "\ue000").translate(_LINES).replace("\ue000", "\x02")
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def words(text: str) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """Words of a `reader_text` in order, and for each position where glue joins runs of letters and digits the parts."""
    if not _SIGNS.search(text):
        return _WORD.findall(text), []
    out, parts = [], []
    for found in _GLUED.findall(text):
        if not found.isalnum():
            some = _WORD.findall(found)
            parts.append((len(out), some))
            found = "".join(some)
        out.append(found)
    return out, parts
