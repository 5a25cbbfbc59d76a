"""Markup residue (HTML, Markdown, wiki, LaTeX) to clean text that keeps headings, lists, tables, code and formulas.

Code and formulas are set aside first, as nothing inside them is markup. What remains is read by the standard library's
HTML parser, event by event; its text goes through the wiki, LaTeX and Markdown readers. Each reader notes the kind of
markup it met. Output notation: `# ` headings, `- ` lists, ` | ` between cells, ``` around code, $ around formulas.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
#: Names of HTML elements; other names in angle brackets are text. Fixed values.
ELEMENTS = frozenset(
    """a abbr address article aside audio b base bdi bdo blockquote body br button canvas caption center cite code col
    colgroup data dd del details dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head
    header hr html i iframe img input ins kbd label legend li link main map mark math meta nav noscript object ol option p
    param picture pre q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg
    table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr""".split()
)
BLOCKS = frozenset("p div br hr ul ol dl dt dd table thead tbody tfoot caption blockquote section article header footer main nav figure figcaption title h1 h2 h3 h4 h5 h6 li tr pre".split())
SILENT = frozenset(("script", "style", "template"))
#: Tags that aren't counted against the text of their line: structure to keep, and emphasis.
ROWS = frozenset("table thead tbody tfoot colgroup col caption tr td th li h1 h2 h3 h4 h5 h6 p br b i u em strong sup sub img".split())
#: LaTeX commands that count without braces. Fixed values.
COMMANDS = frozenset(
    """alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho varrho sigma tau
    upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega times cdot pm mp leq geq neq
    approx equiv sim infty partial nabla sum prod int sqrt frac dot ddot bar hat vec tilde log ln exp sin cos tan max min
    left right quad qquad ldots cdots item hline label cite ref emph textbf textit texttt section subsection subsubsection
    chapter paragraph caption footnote mathrm mathbf text SI si begin end circ degree""".split()
)
_MATH_ENV = r"equation|align|gather|multline|eqnarray|displaymath|math"
#: References that stand for signs which open no tag and no reference; width of the Gaussian in lines.
LESS, AMPERSAND, SIGMA = "&zzless;", "&zzand;", 1.5

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n`]*\n(.*?)(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_PRE = re.compile(r"<(pre|code|tt|samp|kbd)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
_WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^<>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_TICKS = re.compile(r"(?<![`\\])(`{1,2})(?!`)([^\n]*?[^\n`])\1(?!`)")
_DISPLAY = re.compile(rf"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\\begin\{{((?:{_MATH_ENV})\*?)\}}(.*?)(?:\\end\{{\4\}}|\Z)", re.S)
_INLINE = re.compile(r"(?<![\\$])\$(?![\s$])((?:[^$\n\\]|\\.)*?(?<![\s\\]))\$(?![\d$])")
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?=[\s/>])[^<>]*(?:>|\Z)|<!--.*?(?:-->|\Z)|<!doctype\b[^>]*>", re.S | re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)")

_W_HEAD = re.compile(r"^(={1,6})[ \t]*([^=\n](?:.*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_W_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.S | re.M)
_W_ROW = re.compile(r"^[ \t]*\|-+[ \t]*$", re.M)
_W_TEMPLATE = re.compile(r"(?<![\\^_{])\{\{([^{}]*)\}\}(?!\})")
_W_LINK = re.compile(r"\[\[([^\[\]\"\n]+)\]\]")
_W_OUT = re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:\s+([^\]\n]*))?\](?!\()")
_W_QUOTE = re.compile(r"(?<![\w'])('''''|'''|'')(?=[^\s'])([^\n]*?[^\s'])\1(?!')")

_L_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
_L_SECTION = re.compile(r"\\(chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}\n]*)\}")
_L_UNIT = re.compile(r"\\(?:SI|qty)\{([^{}]*)\}\{([^{}]*)\}")
_L_DROP = re.compile(r"\\(?:label|hline|toprule|midrule|bottomrule|centering|noindent|vspace|hspace|index)\b\*?(?:\{[^{}\n]*\})?")
_L_CITE = re.compile(r"\\(?:cite|ref|eqref|pageref)\w*\{([^{}\n]*)\}")
_L_ARGUMENT = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
_L_BARE = re.compile(r"\\([A-Za-z]+)(?![A-Za-z{])")
_L_SPACE = re.compile(r"(?<=\w)\\[,;!](?=\w)|(?<=\d)~(?=\w)")

_M_HEAD = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*$", re.M)
_M_SETEXT = re.compile(r"^(?=\S)([^\n|]+)\n(=+|-{3,})[ \t]*$", re.M)
_RULE = r"[ \t]*(?:-{2,}:?|:-+:?|-+:)[ \t]*"
_M_RULE = re.compile(rf"^[ \t]*\|?{_RULE}(?:\|{_RULE})+\|?[ \t]*$|^[ \t]*\|{_RULE}\|[ \t]*$", re.M)
_M_IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]*)[^()\n]*\)")
_M_LINK = re.compile(r"(?<!!)\[([^\]\n]+)\]\(([^()\s]+)[^()\n]*\)")
_M_STRONG = re.compile(r"(?<![\w*])\*\*(?=[^\s*])([^\n]*?[^\s*])\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])([^\n]*?[^\s_])__(?![\w_])")
_M_WEAK = re.compile(r"(?<![\w*])\*(?=[^\s*])([^\n*]*[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])([^\n_]*[^\s_])_(?![\w_])")
_M_STRIKE = re.compile(r"~~(?=[^\s~])([^\n]*?[^\s~])~~")
_M_QUOTE = re.compile(r"^ {0,3}>(?: |$)[ \t]*", re.M)
_M_LIST = re.compile(r"^([ \t]*)([-*+])[ \t]+(?=\S)", re.M)
_OWN_SIGNS = re.compile("[\ue100-\ueffd]+")
#: Pieces that have a sign of their own; later ones have a number in signs between \ueffc and \ueffd.
SINGLE = 0xEFC
_PIECE_SIGNS = re.compile("[\ue100-\ueffb]|\ueffc[\ue100-\ueffb]+\ueffd")


class _Events(HTMLParser):
    """Text and structure from the parser's events; per source line the length of text and the number of tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.silent = 0
        self.lists: list[int | None] = []
        self.cells = 0
        self.ratio: dict[int, list[int]] = {}
        self.kinds: set[str] = set()

    def _note(self, tag: str) -> None:
        self.ratio.setdefault(self.getpos()[0], [0, 0])[1] += tag not in ROWS

    def _line(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._note(tag)
        if tag not in ELEMENTS:
            self.out.append(self.get_starttag_text() or "")
            return
        self.kinds.add(HTML)
        if tag in SILENT:
            self.silent += 1
        if tag in ("td", "th"):
            if self.cells:
                self.out.append(" | ")
            self.cells += 1
        elif tag in BLOCKS:
            self._line()
            if tag == "tr":
                self.cells = 0
            elif tag in ("ul", "ol"):
                self.lists.append(0 if tag == "ol" else None)
            elif tag == "li":
                depth = "  " * (len(self.lists) - 1)
                if self.lists and self.lists[-1] is not None:
                    self.lists[-1] += 1
                    self.out.append(f"{depth}{self.lists[-1]}. ")
                else:
                    self.out.append(f"{depth}- ")
            elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.out.append("#" * int(tag[1]) + " ")
        elif tag == "img":
            named = dict(attrs)
            self.out.append(named.get("alt") or "")
        elif tag in ("sup", "sub"):
            self.out.append("^" if tag == "sup" else "_")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in SILENT:
            self.silent -= 1

    def handle_endtag(self, tag: str) -> None:
        self._note(tag)
        if tag not in ELEMENTS:
            self.out.append(f"</{tag}>")
            return
        self.kinds.add(HTML)
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
            elif tag == "tr":
                self.cells = 0
            self._line()

    def handle_data(self, data: str) -> None:
        if data.isspace() and "\n" in data and self.out and self.out[-1].endswith("\n") and "\n\n" not in data:
            return
        if not self.silent:
            at = self.getpos()[0]
            for k, line in enumerate(data.split("\n")):
                self.ratio.setdefault(at + k, [0, 0])[0] += len(line.strip())
            self.out.append(data)

    def handle_comment(self, data: str) -> None:
        self.kinds.add(HTML)

    def handle_decl(self, decl: str) -> None:
        self.kinds.add(HTML)

    def handle_entityref(self, name: str) -> None:
        own = {LESS: "<", AMPERSAND: "&"}.get(f"&{name};")
        if own is None:
            own = unescape(f"&{name};")
            if own != f"&{name};":
                self.kinds.add(HTML)
        self.handle_data(own)

    def handle_charref(self, name: str) -> None:
        self.kinds.add(HTML)
        self.handle_data(unescape(f"&#{name};"))


def content_lines(ratio: dict[int, list[int]], n: int) -> list[bool]:
    """Which of n source lines belong to content: text-to-tag ratios, smoothed by a Gaussian, split in two clusters; all
    if the ratios are alike. Lines without text belong to it, as their tags may open what follows, and so do lines without tags that
    count.
    """
    raw = [ratio.get(i + 1, (0, 0)) for i in range(n)]
    plain = [t / max(1, g) for t, g in raw]
    reach = max(1, round(3 * SIGMA))
    weights = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-reach, reach + 1)]
    smooth = []
    for i in range(n):
        some = [(w, plain[i + d]) for w, d in zip(weights, range(-reach, reach + 1), strict=True) if 0 <= i + d < n]
        smooth.append(sum(w * x for w, x in some) / sum(w for w, _ in some))
    low, high = min(smooth), max(smooth)
    if high - low < 1e-9:
        return [True] * n
    cut = (low + high) / 2
    for _ in range(50):
        a, b = [x for x in smooth if x <= cut], [x for x in smooth if x > cut]
        new = (sum(a) / len(a) + sum(b) / len(b)) / 2 if a and b else cut
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return [x > cut or not t or not g for x, (t, g) in zip(smooth, raw, strict=True)]


def _signs(number: int) -> str:
    """Private signs that stand for a piece."""
    if number < SINGLE:
        return chr(0xE100 + number)
    out = ""
    while number:
        number, digit = divmod(number, SINGLE)
        out = chr(0xE100 + digit) + out
    return f"\ueffc{out}\ueffd"


def _number(signs: str) -> int:
    out = 0
    for sign in signs.strip("\ueffc\ueffd"):
        out = out * SINGLE + ord(sign) - 0xE100
    return out


class _Holder:
    """Set-aside pieces, each behind a private sign; private signs of the text itself are set aside first."""

    def __init__(self, text: str) -> None:
        self.kept: list[str] = []
        self.kinds: set[str] = set()
        self.text = _OWN_SIGNS.sub(lambda m: self._put(m[0]), text)
        self.own = len(self.kept)

    def _put(self, shown: str) -> str:
        self.kept.append(shown)
        return _signs(len(self.kept) - 1)

    def hold(self, pattern: re.Pattern, kind: str, render) -> None:  # noqa: ANN001
        def put(m: re.Match) -> str:
            shown = render(m)
            if shown is None:
                return m[0]
            self.kinds.add(kind)
            return self._put(shown)

        self.text = pattern.sub(put, self.text)

    def release(self) -> None:
        """Put pieces into the later pieces that hold their signs."""
        for k in range(self.own, len(self.kept)):
            self.kept[k] = self.released(self.kept[k])

    def released(self, text: str) -> str:
        return _PIECE_SIGNS.sub(lambda m: self.kept[k] if (k := _number(m[0])) < len(self.kept) else m[0], text)


def _code(body: str) -> str:
    body = body.strip("\n")
    return f"\n```\n{body}\n```\n" if "\n" in body else f"`{body}`"


def _known_tag(m: re.Match) -> bool:
    return m[1] is None or m[1].lower() in ELEMENTS


def convert(value: str) -> tuple[str, list[str], str]:
    """Clean text, kinds of markup in order of their names, and the text of the content regions.

    Broken markup is read as far as it goes; a text without markup comes back as it is, without surrounding white space.
    """
    text = value.replace("\r\n", "\n")
    held = _Holder(text)
    if "<" in text:
        held.hold(_WIKI_CODE, WIKI, lambda m: _code(m[2]))
        held.hold(_PRE, HTML, lambda m: _code(unescape(re.sub(r"</?code\b[^>]*>", "", m[2]))) if m[1].lower() in ("pre", "code") else f"`{m[2]}`")
    if "```" in text or "~~~" in text:
        held.hold(_FENCE, MARKDOWN, lambda m: f"\n```\n{m[2].rstrip(chr(10))}\n```\n")
    if "\\begin" in text:
        held.hold(_VERBATIM, LATEX, lambda m: _code(m[2]))
    if "`" in held.text:
        held.hold(_TICKS, MARKDOWN, lambda m: f"`{m[2]}`")
    if "\\" in held.text or "$$" in held.text:
        held.hold(_DISPLAY, LATEX, lambda m: f"${next(g for g in (m[1], m[2], m[3], m[5], '') if g is not None).strip()}$")
    if "$" in held.text:
        held.hold(_INLINE, LATEX, lambda m: m[0])
    held.release()
    read, mask = _read(held.text, held.kinds)
    text = main = _tidy(held.released(read))
    if not all(mask):
        kept = "\n".join(line for line, use in zip(held.text.split("\n"), mask, strict=False) if use)
        main = _tidy(held.released(_read(kept, set())[0]))
    return text, sorted(held.kinds), main


def _read(text: str, kinds: set[str]) -> tuple[str, list[bool]]:
    """Text of a source without code and formulas, and which of its lines are content; the kinds met go into `kinds`."""
    source, mask = text, [True]
    if "<" in text or "&" in text:
        # Angle brackets that open no known element are text for the parser; a tag that is cut off is markup without text.
        safe, at = [], 0
        for m in _TAG.finditer(text):
            if _known_tag(m):
                safe.append(text[at : m.start()].replace("<", LESS))
                if m[0].endswith(">"):
                    safe.append(m[0])
                else:
                    kinds.add(HTML)
                at = m.end()
        safe.append(text[at:].replace("<", LESS))
        events = _Events()
        events.feed(re.sub(r"&(?![A-Za-z][A-Za-z0-9]*;|#)", AMPERSAND, "".join(safe)))
        events.close()
        kinds |= events.kinds
        if HTML in kinds:
            mask = content_lines(events.ratio, source.count("\n") + 1)
            text = "".join(events.out)
    text = _wiki(text, kinds)
    # Headings and lists are looked for in the source, as other readers write theirs in the same notation.
    bullets = {mark for _, mark in _M_LIST.findall(source)} - ({"*"} if WIKI in kinds else set())
    if ("#" in source and _M_HEAD.search(source)) or (bullets and len(_M_LIST.findall(source)) > 1):
        kinds.add(MARKDOWN)
    return _markdown(_latex(text, kinds), kinds), mask


def _tidy(text: str) -> str:
    lines = [re.sub(r"[ \t\u00a0]+", " ", x.strip()) if not x.startswith((" ", "\t")) else x.rstrip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _wiki(text: str, kinds: set[str]) -> str:
    def met(shown):  # noqa: ANN001, ANN202
        def put(m: re.Match) -> str:
            kinds.add(WIKI)
            return shown(m)

        return put

    def rows(m: re.Match) -> str:
        out: list[list[str]] = [[]]
        for line in m[0].split("\n"):
            line = line.strip()
            if line.startswith(("{|", "|}")) or not line:
                continue
            if line.startswith("|-"):
                out.append([])
            elif line.startswith("|+"):
                out.append([line[2:].strip()])
                out.append([])
            elif line[0] in "|!":
                cells = re.split(r"\|\||!!", line[1:])
                out[-1].extend(re.sub(r"^[^\[\]|]*=[^\[\]|]*\|", "", c).strip() for c in cells)
            else:
                out[-1].append(line)
        return "\n".join(" | ".join(r) for r in out if r)

    if "{|" in text:
        text = _W_TABLE.sub(met(rows), text)
    if "|-" in text:
        text = _W_ROW.sub(met(lambda m: ""), text)
    if "==" in text or text.startswith("="):
        text = _W_HEAD.sub(lambda m: met(lambda n: "#" * len(n[1]) + " " + n[2])(m) if len(m[1]) > 1 else m[0], text)
    if "{{" in text:
        text = _W_TEMPLATE.sub(met(lambda m: ", ".join(p.strip() for p in m[1].split("|"))), text)
    if "[[" in text:
        text = _W_LINK.sub(met(lambda m: "" if re.match(r"\s*(?:category|kategorie|catégorie)\s*:", m[1], re.I) else m[1].split("|")[-1].strip()), text)
    if "://" in text:
        text = _W_OUT.sub(met(lambda m: m[1] or ""), text)
    if "''" in text:
        text = _W_QUOTE.sub(met(lambda m: m[2]), text)
    return text


def _latex(text: str, kinds: set[str]) -> str:
    if "\\" not in text:
        return text
    if not any(m[1] in COMMANDS for m in re.finditer(r"\\([A-Za-z]+)", text)):
        return text
    kinds.add(LATEX)
    table = "\\begin{tab" in text
    text = _L_SECTION.sub(lambda m: "\n" + "#" * (1 + m[1].count("sub")) + " " + m[2] + "\n", text)
    text = _L_ENV.sub("\n", text)
    text = _L_DROP.sub("", text)
    text = re.sub(r"\\item\b(?:\[([^\]]*)\])?[ \t]*", lambda m: "\n- " + (m[1] + " " if m[1] else ""), text)
    text = _L_UNIT.sub(lambda m: f"{m[1]} {m[2]}", text)
    text = _L_CITE.sub(lambda m: f"[{m[1]}]", text)
    n = 1
    while n:
        text, n = _L_ARGUMENT.subn(lambda m: m[2], text)
    if table:
        text = re.sub(r"[ \t]*(?<!\\)&[ \t]*", " | ", text)
    text = re.sub(r"[ \t]*\\\\(?:\[[^\]]*\])?[ \t]*\n?", "\n", text)
    text = _L_SPACE.sub(" ", text)
    text = re.sub(r"\\([%&$#_{}])", r"\1", text)
    return _L_BARE.sub(lambda m: f"${m[0]}$" if m[1] in COMMANDS else m[0], text)


def _markdown(text: str, kinds: set[str]) -> str:
    def met(shown):  # noqa: ANN001, ANN202
        def put(m: re.Match) -> str:
            kinds.add(MARKDOWN)
            return shown(m)

        return put

    if "|" in text and _M_RULE.search(text):
        kinds.add(MARKDOWN)
        text = _M_RULE.sub("\x00", text).replace("\x00\n", "").replace("\x00", "")
        text = re.sub(r"^[ \t]*\|(.*?)\|?[ \t]*$", lambda m: " | ".join(c.strip() for c in m[1].split("|")), text, flags=re.M)
    if "\n=" in text or "\n---" in text:
        text = _M_SETEXT.sub(met(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip()), text)
    if "](" in text:
        text = _M_LINK.sub(met(lambda m: m[1]), _M_IMAGE.sub(met(lambda m: m[1]), text))
    if "~~" in text:
        text = _M_STRIKE.sub(met(lambda m: m[1]), text)
    if "**" in text or "__" in text:
        text = _M_STRONG.sub(met(lambda m: m[1] or m[2]), text)
    if "*" in text or "_" in text:
        text = _M_WEAK.sub(met(lambda m: m[1] or m[2]), text)
    if ">" in text:
        text = _M_QUOTE.sub(met(lambda m: ""), text)
    return _M_LIST.sub(r"\1- ", text)


def clean_texts(blocks: DataFrame, key: str = "block_id", fields: tuple[str, ...] = ("table_body", "html", "content")) -> DataFrame:
    """Rows (key, field, text, main, markup): of every field that is neither null nor empty the clean text, the text of its
    content regions, and the kinds of markup present. Whole texts are read; repeated rows give their rows again; further
    columns are ignored. A map over the scan.
    """
    schema = f"{key} {blocks.schema[key].dataType.simpleString()}, field string, text string, main string, markup array<string>"

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            names, texts, mains, kinds = [], [], [], []
            for f, field in enumerate(fields, 1):
                for k, value in enumerate(batch.column(f).to_pylist()):
                    if value:
                        text, found, main = convert(value)
                        at.append(k)
                        names.append(field)
                        texts.append(text)
                        mains.append(main)
                        kinds.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(texts, pa.string()), pa.array(mains, pa.string()), pa.array(kinds, pa.list_(pa.string()))],
                [key, "field", "text", "main", "markup"],
            )

    return blocks.select(key, *fields).mapInArrow(scan, schema)


def markup_kinds(blocks: DataFrame, key: str = "block_id", fields: tuple[str, ...] = ("table_body", "html", "content")) -> DataFrame:
    """Rows (key, field, markup), one per kind of markup that the conversion of a field met."""
    from pyspark.sql import functions as F

    return clean_texts(blocks, key, fields).select(key, "field", F.explode("markup").alias("markup"))
