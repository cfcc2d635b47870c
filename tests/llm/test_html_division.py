"""Articles that no tag declares, in several blocks."""

from __future__ import annotations

from quarry.llm import html_extract


def paragraphs(n: int, mark: str) -> str:
    return "".join(f"<p>{mark}{i} {'word ' * 59}</p>" for i in range(n))


def marks(page: str) -> list[str]:
    return [line.split()[0] for line in html_extract.extract(page).split("\n") if line]


def test_article_in_sibling_blocks_comes_out_whole():
    parts = "".join(f"<div>{paragraphs(n, m)}</div>" for m, n in (("a", 10), ("b", 8), ("c", 6)))
    want = [f"{m}{i}" for m, n in (("a", 10), ("b", 8), ("c", 6)) for i in range(n)]
    assert marks(f"<body><div>{parts}</div></body>") == want
    assert marks(f"<body>{parts}</body>") == want


def test_thin_blocks_beside_a_divided_article_stay_out():
    links = "".join(f"<li><a href=/{i}>Go {i}</a></li>" for i in range(8))
    page = f"<body><div><div><b>Site</b> <i>name</i></div><ul>{links}</ul><div>{paragraphs(4, 'a')}</div><div>{paragraphs(3, 'b')}</div><div>End</div></div></body>"
    assert marks(page) == [f"a{i}" for i in range(4)] + [f"b{i}" for i in range(3)]


def test_order_and_repeats():
    page = f"<body><div>{paragraphs(2, 'a')}</div><div><div>{paragraphs(9, 'b')}</div><div>{paragraphs(2, 'c')}</div></div></body>"
    assert marks(page) == ["a0", "a1", *[f"b{i}" for i in range(9)], "c0", "c1"]
