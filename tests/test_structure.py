"""The splitter's rules, case by case."""

from __future__ import annotations

from quarry.functions import structure as S
from quarry.functions import topics

LONG = "word " * 60


def texts(body: str, suffix: str = "md") -> list[str]:
    return [p.text for p in S.split_document(body, suffix)[1]]


def test_unclosed_comment_is_text():
    body = f"# A\n{LONG}\n<!-- never closed\n\n```\ncode <!-- kept -->\n```\n\n## B\n{LONG}"
    text = "\n".join(texts(body))
    assert "never closed" in text and "code <!-- kept -->" in text and "## B" in text
    assert texts(f"{LONG} a <!-- x\ny --> b")[0].endswith("a  b")


def test_shortcodes_over_lines():
    body = f'{LONG}\n{{{{% notice warning\n  "Heads up" %}}}}\ninner\n{{{{% /notice %}}}}\n{{{{< ref "one" "two" >}}}} {{{{< open'
    text = texts(body)[0]
    assert "Heads up" in text and "inner" in text and "one two" in text and "notice" not in text and "{{< open" in text


def test_headings():
    sections, title = S.markdown_sections("#\n#x\n   # indented\n# One ##\nbody\n####### seven\n## Two { #anchor }\n# C#\n")
    assert [(s.path, s.level) for s in sections] == [((), 0), (("One",), 1), (("One", "Two"), 2), (("C",), 1)]
    assert title == "One" and "####### seven" in sections[1].body and "# indented" in sections[0].body


def test_front_matter():
    assert S.markdown_sections('---\nx: 1\n Title: "T"\n---\n# H\n')[1] == "T"
    assert S.markdown_sections("---\nno end\n# H\n")[1] == "H"
    sections, title = S.rst_sections("---\ntitle: R\n---\nHead\n====\ntext\n")
    assert title == "R" and sections[0].path == ("Head",) and sections[0].body == "text"


def test_components_and_modules():
    body = f"{LONG}\n  import a from 'b'\nexport const x\n<Tip>\nkept\n</Tip>\n<Card title=\"t\" />\n<div>\n<A>text</A>\nimported\n"
    text = texts(body)[0].split("\n")[1:]
    assert text == ["kept", "<div>", "<A>text</A>", "imported"]


def test_rst_titles():
    rst = f"  Indented\n=========\n{LONG}\n\nPart\n,,,,\n\n.. _target:\n.. Contents:: x\n   gone\n\nSub\n---\n.. note:: stays\n"
    sections, title = S.rst_sections(rst)
    assert title == "Indented" and [s.path for s in sections] == [("Indented",), ("Indented", "Sub")]
    assert "Part\n,,,," in sections[0].body and "gone" not in sections[0].body and "target" not in sections[0].body and sections[1].body == ".. note:: stays"


def test_passages_keep_heading_marks():
    assert texts(f"# A\n{LONG}\n### B\n{LONG}") == [f"# A\n\n{LONG.strip()}\n\n### B\n\n{LONG.strip()}"]


def test_fences_are_not_cut_at_blank_lines():
    code = "```\n" + "\n\n".join(f"line {i}" for i in range(200)) + "\n```"
    pieces = [t for _, t in S.cut_block(f"{LONG}\n\n{code}\n\n{'para ' * 1500}\n\nend".split("\n"))]
    assert pieces == [f"{LONG}\n\n{code}", ("para " * 1500).strip(), "end"]


def test_line_step_of_an_oversized_paragraph():
    lines = ["x" * 99] * 200  # 19999 characters
    step = 200 * S.TARGET // 19999
    assert [t.count("\n") + 1 for _, t in S.cut_block(lines)] == [step] * (200 // step) + ([200 % step] if 200 % step else [])


def test_stub_joins_under_the_name_before():
    passages = S.split_document(f"{'word ' * 850}\n# Stub\nshort", "md")[1]
    assert len(passages) == 1 and passages[0].heading_path == "Stub" and passages[0].text.endswith("# Stub\n\nshort")
    passages = S.split_document(f"# Top\n{'word ' * 850}\n# Stub\nshort", "md")[1]
    assert [p.heading_path for p in passages] == ["Top"]


def test_pages_by_line():
    big = "word " * 700
    body = f"# T\n\n{topics.page_mark(3, 'iii')}\n\n{big}\n\n{topics.page_mark(4)}\n\n## U\n\n{big}\n\n## V\n\n{topics.page_mark(5)}\n\n{big}\n"
    title, found = topics.paged_passages(body)
    assert title == "T" and [(p.heading_path, p.page_start, p.page_end) for p in found] == [("T", 3, 4), ("T > U", 4, 4), ("T > V", 4, 5)]
    assert [p.provenance for p in found] == [((3, "iii"), (4, None)), (), ((5, None),)] and not any(topics.MARKER in p.text for p in found)
    assert topics.paged_passages(body, 2)[1][0].page_start == 2
    cut = f"{topics.page_mark(1)}\n\n" + f"\n\n{topics.page_mark(2)}\n\n".join(["word " * 760] * 3)
    assert [(p.page_start, p.page_end) for p in topics.paged_passages(cut)[1]] == [(1, 2), (2, 2), (2, 2)]
