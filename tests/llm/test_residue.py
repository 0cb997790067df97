import pytest

from clausewright.llm.residue import classify, find_residue, masked, placeholders, without_residue

RESIDUE = [
    ("Dear {{NAME}},\nplease find attached the report of {{ other-value }}.", "placeholder"),
    ("Adopted at <%= place %> on [Insert date here].", "placeholder"),
    ("Agenda item 8: {% a.b %}\nSource: {% c %}", "placeholder"),
    ("Status: @@packet-state@@", "placeholder"),
    ("Please enable JavaScript to view this page.\n\nPrivacy | Imprint | Contact the desk", "message"),
    ("Home | Search | Help\nThe archive needs JS. Switch it on in the preferences.", "message"),
    ("404 Not Found\nThe requested document /a/b was not found or could not be delivered.\nRef. 12ab34", "message"),
    ("Sorry, the view you requested is temporarily unavailable. Try again in a few minutes.", "message"),
    ("Sorry, this page does not exist any more. It may have been moved to another folder. Use the search.", "message"),
    ('Traceback (most recent call last):\n  File "a.py", line 3, in f\n    raise TimeoutError("X")\nTimeoutError: X', "message"),
    ("Access denied. You do not have permission to view x.", "message"),
    ("Fehler 404", "message"),
    ("请启用 JavaScript 以查看本文档。", "message"),
    ("Lorem ipsum dolor sit amet consectetur. Enim minim veniam quis nostrud.", "filler"),
    ("test asdf xxx qwer qwer xxx test asdf", "filler"),
    ("HTTP 418 I'm a teapot", "message"),
    ("We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "message"),
    ("For full functionality of this site it is necessary to enable JavaScript.", "message"),
    ("Pagina non trovata", "message"),
    ("Under construction", "message"),
    ("Dear {{first_name}}, your environment is ready.", "placeholder"),
    ("Overview\nComing soon. Content for this section will be added later.", "message"),
]
CONTENT = [
    "If the resource is unknown, the server answers 404 Not Found with a problem description.",
    "The report macro replaces {{ x }} by the template before delivery.",
    "The scripts export ${FLAG} to the environment, for example ${HOME}/zone.",
    "Requests to /lattice/{repositoryId}/filter carry the identifier in the path.",
    "The portal asks the reader to enable JavaScript; the tests check that the text is readable without it.",
    "Early drafts held lorem ipsum in annex C, which was removed in the second reading.",
    "Editor's note: the value is TBD and left for further study.",
    "404 Not Found\nThe gateway shall send this status whenever the entry is missing.",
    "Minutes, meeting #3\nAgenda item 2: Error handling",
    "The server shall return 404 Not Found when the resource does not exist.",
    "If the page does not exist, the portal returns error 404.",
    "🤖 ok",
    "   ",
    "",
    None,
]


@pytest.mark.parametrize("text,reason", RESIDUE)
def test_residue(text, reason):
    assert classify(text) == reason


@pytest.mark.parametrize("text", CONTENT)
def test_content(text):
    assert classify(text) is None


def test_masks():
    assert masked("Error 503 at  https://a.b/c on 2024-01-02") == "error # at @ on #"
    assert placeholders("```\n{{x}}\n```") == []


def test_rows(spark):
    partly = "Access denied. " + "Ask somebody who knows about these things in the house over there. " * 3
    rows = [(i, t, f"s{i % 4}", "z") for i, (t, _) in enumerate(RESIDUE)] + [(100 + i, t, None, "z") for i, t in enumerate(CONTENT)]
    rows += [(200 + i, partly, f"s{i}", "z") for i in range(6)] + [(300, partly + " Once more, one more thing.", "s", "z"), (0, RESIDUE[0][0], "s1", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, reason string")
    out = find_residue(df).collect()
    ids = sorted(r.doc_id for r in out)
    assert ids == sorted([0, *range(len(RESIDUE)), *range(200, 206)])
    assert {r.docs for r in out if r.doc_id == 200} == {6}
    assert without_residue(df, find_residue(df)).count() == len(rows) - len(ids)
    assert find_residue(df.limit(0)).count() == 0


def test_unknown_messages_count_when_they_recur_widely(spark):
    page = "Ups, tutaj niczego nie ma. Sprawdź odnośnik albo wróć później (kod {})."
    pages = [(i, f"Dział {i}\n\n{page.format(i)}\nHome | Search | Help", f"s{i % 9}") for i in range(12)]
    short = [(100 + i, "Dobrze, dziękuję.", f"s{i % 9}") for i in range(12)]
    note = [(200 + i, "Editor's note: this value is left for further study.", f"s{i % 9}") for i in range(12)]
    content = [(300 + i, "The gateway shall store each of the values in this table.", f"s{i % 9}") for i in range(12)]
    paths = [(400 + i, f"Requests to /lattice/{{id}}/{i} carry the identifier in the path.", f"s{i % 9}") for i in range(12)]
    few = [(500 + i, "Strona jest chwilowo zamknięta dla gości i autorów.", f"s{i % 2}") for i in range(12)]
    once = [(600, "Pozostała treść pojawi się tutaj po zalogowaniu się.", "s1")]
    df = spark.createDataFrame(pages + short + note + content + paths + few + once, "doc_id long, text string, source string")
    out = find_residue(df).collect()
    assert {(r.doc_id, r.reason, r.docs, r.sources) for r in out} == {(i, "recurring", 12, 9) for i in range(12)}
    assert find_residue(df, share_docs=0.5).count() == 0 and find_residue(df, share_sources=1.1).count() == 0


def test_groups_decide_what_is_known_by_a_word_only(spark):
    """A page that the rules know only by a word counts in a group, and alone does not."""
    page = "Quota of browser tabs reached. Close tab {} and come back."
    rows = [(i, page.format(i), f"s{i % 4}") for i in range(8)] + [(100, "Quota of browser tabs grows. Nobody reads tab 5.", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert classify(page) is None
    assert {(r.doc_id, r.reason, r.docs, r.sources) for r in find_residue(df).collect()} == {(i, "message", 8, 4) for i in range(8)}
    assert find_residue(df, min_docs=9).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "Test environment: {{ENV_NAME}}",
        "- approved by {{name}};",
        "- approved by {{name}};\n- checked by {{ other }};",
        "    Chair: {{chair}}",
        "\tChair: {{chair}}\n\tSecretary: {{secretary}}",
        "for the group: {{chair}}",
        "set by the chair (acting): {{chair}}",
        "The syntax of the variables was agreed with {{name}}.",
        'Variable: "{{name}}"',
        "It replaces ${regional.area}.",
    ],
)
def test_placeholders_where_values_belong(text):
    assert classify(text) == "placeholder"


@pytest.mark.parametrize(
    "text",
    [
        "The environment variable ${HOME} holds the folder.",
        "The shell expands ${HOME} first.",
        "Here ${HOME} expands to a folder.",
        "In this notation '{{x}}' means a value.",
        "export FLAG=${HOME}/bin",
        "if (a) {\n    call(${HOME});\n}",
        "~~~\nChair: {{chair}}\n~~~",
    ],
)
def test_placeholders_spoken_of_or_in_code(text):
    assert placeholders(text) == []
