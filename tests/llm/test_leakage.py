from clausewright.llm import leakage
from clausewright.llm.leakage import char_spans, find_leaks, remove_leaks, words_of

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_words():
    assert words_of("Don\u00adt  STOP\u200bhere, x_y") == ["dont", "stophere", "x", "y"]


def frames(spark):
    docs = [
        (1, "Intro text. " + ITEM.upper().replace(" ", ", ") + " and after.", "z"),
        (2, "> " + ITEM.replace("five", "fi\u200bve") + "\n", "z"),
        (3, " ".join(ITEM.split()[:11]), "z"),
        (4, None, "z"),
        (5, "", "z"),
        (6, "İİ " + ITEM, "z"),
        (7, " ".join(ITEM.split()[:12]) + " x " + " ".join(ITEM.split()[1:]), "z"),
        (1, "Intro text. " + ITEM.upper().replace(" ", ", ") + " and after.", "z"),
    ]
    items = [(10, ITEM, "q"), (11, ITEM, "q"), (12, None, "q"), (13, "too short", "q"), (10, ITEM, "q")]
    return spark.createDataFrame(docs, "doc_id long, text string, spans string"), spark.createDataFrame(items, "item_id long, text string, n_words string")


def test_leaks(spark):
    docs, items = frames(spark)
    rows = find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == sorted((d, i) for d in (1, 1, 2, 6, 7) for i in (10, 11))
    by = {(r.doc_id, r.item_id): r for r in rows}
    assert by[7, 10].n_words == 12 and len(by[7, 10].spans) == 2 and by[1, 10].n_words == 13
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        for s in r.spans:
            assert words_of(text[r.doc_id][s.start : s.end])[0] in ("one", "two")
    assert find_leaks(docs.limit(0), items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_several_tables_give_the_same(spark, monkeypatch):
    docs, items = frames(spark)
    want = {(r.doc_id, r.item_id, r.n_words) for r in find_leaks(docs, items).collect()}
    monkeypatch.setattr(leakage, "MAX_BROADCAST_GRAMS", 20)
    assert {(r.doc_id, r.item_id, r.n_words) for r in find_leaks(docs, items).collect()} == want


def test_removal(spark):
    docs, items = frames(spark)
    leaks = find_leaks(docs, items)
    out = {r.doc_id: r.text for r in remove_leaks(docs, leaks).collect()}
    assert out[1] == "Intro text.  and after." and out[3] == " ".join(ITEM.split()[:11]) and out[4] is None
    assert "thirteen" not in out[6] and out[6].startswith("İİ")
    assert {r.doc_id for r in remove_leaks(docs, leaks, drop_documents=True).collect()} == {3, 4, 5}


def test_spans_map_back():
    text = "a\u00adb c"
    assert char_spans(text, [(0, 1)]) == [(0, 5)]
