"""Density decides on every page; what earlier probes lost comes out."""

from __future__ import annotations

import math
import random

import pytest

from quarry.llm import html_extract as H

TEXT = "Long text here, and more of it. " * 12


def brute(node: H.Node) -> tuple[int, int, int, int]:
    """(chars, tags, link chars, link tags) of a subtree, by recursion."""
    total = [0, 0, 0, 0]
    for c in node.children:
        if isinstance(c, str):
            total[0] += len(" ".join(c.split()))
        elif not c.noise:
            chars, tags, link_chars, link_tags = brute(c)
            link = c.tag == "a"
            total = [x + y for x, y in zip(total, (chars, tags + 1, chars if link else link_chars, 1 if link else link_tags), strict=True)]
    return tuple(total)


def test_densities_equal_the_definition():
    rng = random.Random(4)

    def made(depth: int) -> str:
        if depth == 0 or rng.random() < 0.2:
            return "word " * rng.randrange(12)
        return "".join(f"<{t}>{made(depth - 1)}</{t}>" for t in rng.choices(["div", "b", "a", "section", "i"], k=rng.randrange(1, 4)))

    for _ in range(40):
        root = H.parse(f"<body>{made(4)}</body>")
        order = H.measure(root)
        all_chars, _, all_links, _ = brute(root)
        for n in order:
            c, t, lc, lt = brute(n)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt)
            if not c:
                continue
            t, ratio = max(t, 1), c / max(lc, 1) * max(t, 1) / max(lt, 1)
            base = math.log(c / max(c - lc, 1) * lc + all_links / max(all_chars, 1) * c + math.e)
            want = c / t * (math.log(max(ratio, 1 + 1e-9)) / math.log(base + 1 + 1e-9) if lc else 1.0)
            assert n.density == pytest.approx(want)
        for n in order:
            kids = [k for k in n.children if isinstance(k, H.Node)]
            assert n.total == pytest.approx(sum(k.density for k in kids) + sum(len(" ".join(k.split())) for k in n.children if isinstance(k, str)))


def test_density_chooses_between_articles():
    small = "<article><p>Teaser</p></article>"
    page = f"<body>{small}<article><h1>Head</h1><p>{TEXT}</p><p>{TEXT}</p></article>{small}</body>"
    assert H.extract(page) == f"Head\n{TEXT.strip()}\n{TEXT.strip()}"
    both = f"<body><article><p>{TEXT}</p><p>a {TEXT}</p></article><article><p>{TEXT}</p><p>b {TEXT}</p></article></body>"
    assert H.extract(both).split("\n") == [TEXT.strip(), f"a {TEXT}".strip(), TEXT.strip(), f"b {TEXT}".strip()]


def test_head_and_short_paragraphs_stay_with_one_long_one():
    inner = f"<h1>Head</h1><p>Short.</p><p><b>{TEXT}<br></p>"
    want = f"Head\nShort.\n{TEXT.strip()}"
    for tag in ("article", "div", "section"):
        assert H.extract(f"<body><nav><a href=/>x</a></nav><{tag}>{inner}</{tag}><footer>f</footer></body>") == want
    assert H.extract(f"<body>{inner}<div>Thin</div></body>") == want


def test_lost_text_of_earlier_probes():
    assert H.extract(f'<article><p title="a hidden gem">{TEXT}</p><p hidden>no</p><p style="display: none">no</p><p aria-hidden=true>no</p></article>') == TEXT.strip()
    assert H.extract(f"<header>Site</header><article><header><h1>Title</h1></header><p>{TEXT}</p><footer>tags</footer></article>") == f"Title\n{TEXT.strip()}"
    assert H.extract(f'<div id="page" class="header-fixed"><article><p>{TEXT}</p></article></div>') == TEXT.strip()
