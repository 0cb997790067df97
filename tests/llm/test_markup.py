import pytest

from clausewright.llm.markup import Reader, _read_html, clean_markup, clean_text, corpus_residue, markup_kinds, path_scores, path_sums

MARKED = [
    ("<p>One.</p>\n<p>The <b>two</b>.</p>", ["html"]),
    ("a &le; b &amp; c", ["html"]),
    ("&lt;p class=&quot;NO&quot;&gt;Text.&lt;/p&gt;", ["html"]),
    ("line<br/>line", ["html"]),
    ("## Heading\ntext", ["markdown"]),
    ("Heading\n=======\n* item", ["markdown"]),
    ("| a | b |\n|:--|--:|\n|:---|---:|\n| 1 | 2 |", ["markdown"]),
    ("See [here](a/b.md) and ![fig](x.png).", ["markdown"]),
    ("- [x] done\n- [ ] open", ["markdown"]),
    ("> quoted\n>\n> ~~gone~~ text[^1]", ["markdown"]),
    ("The **x** and `y`.", ["markdown"]),
    ("'''bold''' and [[a|b]]", ["wiki"]),
    ("== Head ==\ntext {{cite|x}}", ["wiki"]),
    ('{| class="w"\n|-\n| a || 1\n|}', ["wiki"]),
    ("\\begin{itemize}\n  \\item one\n\\end{itemize}", ["latex"]),
    ("gain is $G_{2} = \\frac{7}{4}$", ["latex"]),
    ("\\[ P = \\min\\{a, 2 + \\log_{10} M\\} \\]", ["latex"]),
    ("<ul><li>x</ul>\n\n== Head ==", ["html", "wiki"]),
]
PLAIN = [
    "Name ::= SEQUENCE\n{\n    a [0] INTEGER (0..3) OPTIONAL,\n}  -- end",
    'foo = <link> SP <table> *( ";" group )',
    "Map<String, Directory> x -- see item [17], #33",
    "value is 4 if x < 39 and y > 57; cause #15 applies",
    "P_total = P_0 + 10 log10(M) + a * PL, where a <= 1",
    "coded as N*M octets with N = 2**k, k in [0..10].",
    "A value matching ^\\d{7}-[A-F]+$ is treated as uplink [13].",
    "GET /group/v2/{segmentId}/teardown?handover=5&link=95",
    "the R&D profile (a | b) costs 58 $ per item * month",
    "-\tThe first;\n-\tThe second;",
    "a\tb\tc\nd\te\tf",
    "-- [[ 2: field ]] in ASN.1 [[\n x INTEGER ]]",
    "",
]


@pytest.mark.parametrize("text,kinds", MARKED)
def test_markup_is_found_and_goes(text, kinds):
    assert markup_kinds(text) == kinds
    cleaned, found, _, _ = clean_text(text)
    assert found == kinds and cleaned.strip()
    if "latex" not in kinds:
        assert markup_kinds(cleaned) == []


@pytest.mark.parametrize("text", PLAIN)
def test_what_only_looks_like_markup_stays(text):
    assert clean_text(text) == (text, [], 0, [])


def test_structure_is_kept():
    out = clean_text("<h2>Head</h2><ul><li>one</li><li>two</li></ul><pre>a  = b\n  c</pre>")[0]
    assert out.split("\n") == ["Head", "- one", "- two", "a  = b", "  c"] or "a  = b\n  c" in out
    assert "1\t2" in clean_text("| a | b |\n|---|---|\n| 1 | 2 |")[0]
    assert "\\frac{7}{4}" in clean_text("gain $\\frac{7}{4}$ and \\textbf{x}")[0]
    out, _, dropped, _ = clean_text("Text stays.{{cite|a|b}} [[Category:X]]\n\nMore text.")
    assert out == "Text stays.\n\nMore text." and dropped


@pytest.mark.parametrize("tag", ["sup", "b", "span", "a"])
@pytest.mark.parametrize("before,after", [("", ""), ("<div>", "</div>"), ("> ~~No~~ ", "")])
def test_inline_elements_belong_to_their_sentence(tag, before, after):
    long = "Any session trailer shall omit any idle mask, unless the bearer, the carrier or the counter says so; see below. " * 12
    text = f"{long}<br/>\n\n{before}{long}The value is 10<{tag}>4</{tag}> +/- 2 dB, of the <{tag}>next</{tag}> word.{after}"
    out, kinds, left_out, _ = clean_text(text)
    assert kinds[0] == "html" and "The value is 104 +/- 2 dB, of the next word." in out and left_out == 0


def test_inline_elements_do_not_thin_their_block():
    r, whole = Reader(), Reader()
    _read_html("<div>One, <b>two</b> and <i>three</i>. <a href='x'>Four</a>.</div>", r)
    _read_html("<div>One, two and three. Four.</div>", whole)
    assert set(path_sums(r.nodes)) == set(path_sums(whole.nodes)) == {"div"}
    assert path_scores(path_sums(r.nodes))["div"] == pytest.approx(path_scores(path_sums(whole.nodes))["div"], rel=0.1)


def test_path_scores_prefer_text():
    r = Reader()
    _read_html("<div><p>A long sentence, with marks. And more.</p><span>x</span><p>Another, one. Two.</p></div>", r)
    s = path_scores(path_sums(r.nodes))
    assert max(s, key=s.get) == "div/p"


def spans(text):
    out, _, _, found = clean_text(text)
    return [(k, n, out[a:b]) for k, n, a, b in found]


def test_structure_has_kind_and_level():
    assert spans("# A\n## B\n```py\nif x:\n  y\n```\n> q one\n> q two\n- it\n  - deep\n| a | b |\n|---|---|\n| 1 | 2 |") == [
        ("heading", 1, "A"), ("heading", 2, "B"), ("code", 0, "if x:\n  y"), ("quote", 0, "q one\nq two"), ("item", 1, "- it"), ("item", 2, "  - deep"), ("table", 0, "a\tb\n1\t2"),
    ]
    assert spans("<h3>H</h3><ol><li>one</li><li>two<ul><li>in</li></ul></li></ol><pre>a\n b</pre>") == [("heading", 3, "H"), ("item", 1, "1. one"), ("item", 1, "2. two"), ("item", 2, "- in"), ("code", 0, "a\n b")]
    assert spans("== H ==\n# one\n# two\n## deep\n# three") == [("heading", 2, "H"), ("item", 1, "1. one"), ("item", 1, "2. two"), ("item", 2, "  1. deep"), ("item", 1, "3. three")]
    assert spans("\\section{A}\n\\subsection{B}\n\\begin{enumerate}\n\\item x\n\\item y\n\\end{enumerate}\n\\[ a = b \\]") == [("heading", 1, "A"), ("heading", 2, "B"), ("item", 1, "1. x"), ("item", 1, "2. y"), ("formula", 0, "\\[ a = b \\]")]


def test_no_text_is_lost():
    assert clean_text("\\section{Intro} text $x^2$ goes on.")[0] == "Intro\ntext $x^2$ goes on."
    assert clean_text("Range is {{nowrap|5 km}} at most.{{cite|x}}")[0] == "Range is 5 km at most."
    assert clean_text("<p><span style='mso-list:Ignore'>2)</span> item</p>")[0] == "2) item"


def test_the_frame_of_pages_goes_by_the_ratios_of_all_texts(spark):
    word = "The gateway stores the value of each counter, and the relay forwards it; see the table below. "
    page = "<nav><ul><li><a href='a'>Home</a></li><li><a href='b'>About</a></li></ul></nav><main><h2>Part {0}</h2><p>" + word * 3 + "</p><ul><li>OK</li></ul></main><footer>Copyright</footer>"
    quote = "<footer><p>" + word * 2 + "</p></footer>"
    df = spark.createDataFrame([(i, page.format(i)) for i in range(20)] + [(50, quote)], "chunk_id long, text string")
    residue = corpus_residue(df)
    assert "nav/ul/li" in residue and "footer" in residue and "main/p" not in residue and "footer/p" not in residue
    got = {r.chunk_id: r for r in clean_markup(df, residue=residue).collect()}
    assert got[3].clean_text == f"Part 3\n\n{(word * 3).strip()}\n\n- OK" and got[3].left_out == len("- Home- AboutCopyright")
    assert got[50].clean_text == (word * 2).strip()
    assert corpus_residue(df.limit(0)) == frozenset()


def test_rows(spark):
    rows = [(1, None, "z"), (2, "", "z"), (3, "<b>x</b>", "z"), (3, "<b>x</b>", "z"), (4, "plain", "z"), (5, "x" * 200_000, "z")]
    df = spark.createDataFrame(rows, "chunk_id long, text string, kinds string")
    out = clean_markup(df).collect()
    assert len(out) == 6 and {r.chunk_id: r.clean_text for r in out}[1] is None
    assert [r.chunk_id for r in clean_markup(df, only_marked=True).collect()] == [3, 3]
    assert clean_markup(df.limit(0)).count() == 0
