"""Markup: kinds, kept structure, decoys and broken input."""

import pytest

from foliolith.llm import markup as M

CASES = [
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1<td>2</table>", "a | b\n1 | 2", ["html"]),
    ("<h2>Head</h2><ul><li>x<li>y</ul><ol><li>p</li></ol>", "## Head\n- x\n- y\n1. p", ["html"]),
    ("a &amp; b &lt; c&nbsp;d", "a & b < c d", ["html"]),
    ("<pre><code>**no** $x$ {{a}}\n</code></pre>", "`**no** $x$ {{a}}`", ["html"]),
    ("```py\n# x\n<b>y</b> $z$\n```", "```\n# x\n<b>y</b> $z$\n```", ["markdown"]),
    ("# Head\n\n- a\n- b", "# Head\n\n- a\n- b", ["markdown"]),
    ("Head\n====\n\ntext", "# Head\n\ntext", ["markdown"]),
    ("| a | b |\n|---|:-:|\n| 1 | 2 |", "a | b\n1 | 2", ["markdown"]),
    ("see [x](y.md), `c` and ~~d~~ **e**", "see x, `c` and d e", ["markdown"]),
    ("> q\n>\n> ![i](j.png) __k__", "q\n\ni k", ["markdown"]),
    ("== Head ==\n'''b''' ''i'' [[t|link]] {{x|y}}", "## Head\nb i link x, y", ["wiki"]),
    ("{| class=w\n! a !! b\n|-\n| 1 || 2\n|}", "a | b\n1 | 2", ["wiki"]),
    ("$x^2$ and \\(y\\) and \\[z\\]", "$x^2$ and $y$ and $z$", ["latex"]),
    ("\\section{Head}\n\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "# Head\n\n- a\n\n- b", ["latex"]),
    ("\\begin{tabular}{ll}\na & b \\\\\n1 & 2 \\\\\n\\end{tabular}", "a | b\n1 | 2", ["latex"]),
    ("\\begin{equation}\na = b\n\\end{equation}", "$a = b$", ["latex"]),
    ("\\SI{3}{\\mega\\pascal} \\emph{x}", None, ["latex"]),
    ("<b>x</b> and **y** and $z$", "x and y and $z$", ["html", "latex", "markdown"]),
    ("## Head\n\nH<sub>2</sub>O &ge; 3", "## Head\n\nH_2O ≥ 3", ["html", "markdown"]),
    ("<td>$\\sigma_{b}$</td>", "$\\sigma_{b}$", ["html", "latex"]),
]
DECOYS = ["a < b and c > d; |x| < 3", "Particles <5 µm and >80 µm; set {a, b}", "$40 to $65 and $12.", "Pipe of 2'' and pipe of 3'' nominal", "a == b fails; #3 and #7", "5 * 3 * 2 mm, or 7*4*2 mm", "C:\\runs\\t04\\new, max_pages and page_index_raw", "See [3], [4] and (a); R&D", "R = -1; 100% of 3 runs_ok", "About ~53 cells, 5% ± 2%, A/B/C", "plain"]


@pytest.mark.parametrize("source,text,kinds", CASES)
def test_cases(source, text, kinds):
    found = M.convert(source)
    assert found[1] == kinds
    if text is not None:
        assert found[0] == text


@pytest.mark.parametrize("text", DECOYS)
def test_decoys(text):
    assert M.convert(text) == (text, [], text)


@pytest.mark.parametrize("text", ["<table><tr><td>x", "<b", "```\nopen", "$", "{|\n| x", "\\begin{equation} x", "[[", "\ue100", "<!-- x", "<b>" * 3000, "&#xFFFFFFF;", "'''", "<script>x"])
def test_broken(text):
    assert isinstance(M.convert(text)[0], str)


def test_content_regions():
    page = "\n".join(["<ul><li><a href=x>m</a></li><li><a>n</a></li></ul>"] * 10 + ["<p>" + "long running text " * 12 + "</p>"] * 10 + ["<div><a>f</a><a>g</a><a>h</a></div>"] * 10)
    text, kinds, main = M.convert(page)
    assert "- m" in text and "long running" in main and len(main) < len(text) and main.count("- m") < 4


def test_long_text():
    assert M.convert("<p>" + "word " * 200_000 + "</p>")[1] == ["html"]


def test_any_number_of_held_pieces():
    n = 9_000
    text, kinds, _ = M.convert(" ".join(f"$a_{{{i}}}*b*$" for i in range(n)))
    assert kinds == ["latex"] and text == " ".join(f"$a_{{{i}}}*b*$" for i in range(n))
    text, kinds, _ = M.convert("$x$ " * 4_000 + "`<b>{{y}}</b>`")
    assert kinds == ["latex", "markdown"] and text.endswith("`<b>{{y}}</b>`")


def test_frame(spark):
    rows = [(1, "<b>x</b>", None, "", "clash"), (1, "<b>x</b>", None, "", None), (2, None, "plain", "$x$", ""), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "block_id bigint, table_body string, html string, content string, markup string")
    assert sorted(map(tuple, M.markup_kinds(df).collect())) == [(1, "table_body", "html"), (1, "table_body", "html"), (2, "content", "latex")]
    assert M.clean_texts(df).count() == 4 and M.clean_texts(df.limit(0)).count() == 0


def test_any_number_of_pieces_and_private_signs():
    text = "\n".join(f"` $\\alpha_{k}+\\beta$ `" for k in range(5_000))
    assert M.convert(text)[0].count("\\alpha_") == 5_000 and M.convert(text)[1] == ["markdown"]
    own = "a\ue200b \ue100\uefff`x\ue101y` $\ueffd$ <b>z\ue100</b>"
    assert M.convert(own)[0] == "a\ue200b \ue100\uefff`x\ue101y` $\ueffd$ z\ue100"


def test_deep_nesting():
    text = "\\emph{" * 40 + "core" + "}" * 40
    assert M.convert(text)[0] == "core"
    code = "`a`"
    for k in range(8):
        code = f"<tt>{code}</tt>" if k % 2 else f"<pre>{code}</pre>"
    assert not any("\ue100" <= c <= "\ueffd" for c in M.convert(code)[0])


def test_short_tables_are_content_whole():
    table = "<table>\n<tr><td>a</td><td>b</td></tr>\n<tr><td>longer text</td><td><b>c</b> d</td></tr>\n</table>"
    text, _, main = M.convert(table)
    assert main == text == "a | b\nlonger text | c d"
    page = '<div><a href="1">home</a><a href="2">up</a><a href="3">all</a></div>\n<p>A long line of running text that says something.</p>\n<p>Another long line of running text.</p>'
    text, _, main = M.convert(page)
    assert "home" in text and "home" not in main and "Another" in main
