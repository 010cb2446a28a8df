"""Trees of markup residue on pages they were not grown on, and cleaning that keeps what text means."""

import pytest

from pagemill.llm import markup

CASES = [
    ("<pre><code>if a &lt; b:\n\n    go()</code></pre>", "```\nif a < b:\n\n    go()\n```"),
    ("<p>text</p>\n<script>\nvar x = 1;\n\nf(x);\n</script>\nmore", "text\n\nmore"),
    ("\\section{A}\n\\subsection{B}\n\\subsubsection{C}", "## A\n### B\n#### C"),
    ("<ol>\n<li>one</li>\n<li>two</li>\n</ol>", "1. one\n2. two"),
    ('see <a href="/x">the page</a> now', "see [the page](/x) now"),
    ("{| class=x\n! h\n! i\n|-\n| style=y | a || b\n|-\n| c\n| d\n|}", "| h | i |\n| --- | --- |\n| a | b |\n| c | d |"),
    ("<table><tr><th>h</th><th>i</th></tr>\n<tr><td>a</td><td>b</td></tr></table>", "| h | i |\n| --- | --- |\n| a | b |"),
    ("it is {{convert|5|km|mi}} long, says {{cite web|title=A page|year=2019}}", "it is 5 km long, says A page"),
    ("where x <b and c> d holds", "where x <b and c> d holds"),
    ("\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}", "1. a\n2. b"),
    ("```\n<pre>x</pre>\n<script>y</script>\n```", "```\n<pre>x</pre>\n<script>y</script>\n```"),
    ("an [https://a.test/b outside page] with '''bold''' words", "an [outside page](https://a.test/b) with **bold** words"),
    ("{| class=x\n|-\n| never closed", "| never closed |\n| --- |"),
    ("", ""),
]


@pytest.mark.parametrize("dirty,clean", CASES)
def test_cleaning_loses_nothing(dirty, clean):
    assert markup.clean(dirty, markup.trees()) == clean


def test_trees_on_pages_they_were_not_grown_on():
    grown, other = markup.trees(markup.labelled_pages()), markup.labelled_pages(60, 5)
    for kind in markup.KINDS:
        answers = [(grown[kind].answer(row), kind in kinds) for page in other for row, (kinds, _) in zip(markup.features([markup.without_spans(b) for _, b in page]), page)]
        assert sum(a == b for a, b in answers) >= 0.98 * len(answers)


def test_neighbours_decide_what_rows_are():
    """Rows with doubled bars are a table of a wiki only beside one; so are rows with ampersands for LaTeX."""
    grown = markup.trees()

    def kinds(text):
        return [k for _, _, k in markup.judge(text, grown)]

    bars, ampersands = "| a || b\n| c || d", "a & b \\\\\nc & d \\\\"
    assert kinds(bars) == [()] and kinds("{| class=x\n|-\n\n" + bars)[1] == ("wiki",)
    assert kinds(ampersands) == [()] and kinds("\\begin{tabular}{ll}\n\n" + ampersands)[1] == ("latex",)
