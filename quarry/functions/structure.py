"""Structure-aware splitting of Markdown, reStructuredText and plain text into passages.

A text is read into sections (heading path and body), sections become blocks, blocks are packed into passages of
about 4000 characters.  Splitting is per document, so on a table it is a map without a shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.shipping import ship

#: Characters of a passage (aim, most, least) and of a whole document that isn't worth indexing.
TARGET, MOST, LEAST, STUB = 4000, 8000, 160, 40

#: Characters that rule off titles in reStructuredText, and its directives that hold no text.
RULE_CHARS = "=-~^\"'#*+<>`:._"
NOISE_DIRECTIVES = ("toctree", "contents", "sectionauthor", "moduleauthor")

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_DIRECTIVE = re.compile(r"\.\.\s+(\w+)::")


@dataclass
class Section:
    """A heading with the lines under it; ``begin`` is the number of its first line, ``first`` that of ``lines[0]``."""

    path: tuple[str, ...]
    level: int
    lines: list[str]
    begin: int = 0
    first: int = 0

    @property
    def body(self) -> str:
        return "\n".join(self.lines).strip()


@dataclass
class Passage:
    """``begin`` and ``end`` are the numbers of the cleaned document's lines that it covers, up to the next passage."""

    ord: int
    heading_path: str
    text: str
    begin: int = 0
    end: int = 0


def fenced(lines: list[str]) -> list[bool]:
    """Which lines belong to a code fence, its marks included; a fence closes at the next mark of its character."""
    inside, out = "", []
    for line in lines:
        m = _FENCE.match(line)
        mark = m.group(1)[0] if m else ""
        out.append(bool(inside) or bool(mark))
        if inside:
            inside = "" if mark == inside else inside
        else:
            inside = mark
    return out


def front_matter(lines: list[str]) -> tuple[list[str], str | None]:
    """(lines after a leading ``---`` block, its title).  Only a closed block at the very start is one."""
    if not lines or lines[0].rstrip() != "---":
        return lines, None
    end = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() == "---"), 0)
    fields = [line.partition(":") for line in lines[1:end]]
    title = next((value.strip().strip("\"'") for name, _, value in fields if name.strip().lower() == "title"), None)
    return (lines[end + 1 :], title or None) if end else (lines, None)


def _without_markup(text: str) -> str:
    """Comments go, a shortcode leaves its quoted arguments; what is opened and never closed is text and stays."""
    out, at = [], 0
    while True:
        begin, opener = min((i, o) if (i := text.find(o, at)) >= 0 else (len(text), o) for o in ("<!--", "{{<", "{{%"))
        if begin == len(text):
            return "".join([*out, text[at:]])
        closers = ("-->",) if opener == "<!--" else (">}}", "%}}")
        end = min((i for c in closers if (i := text.find(c, begin + len(opener))) >= 0), default=-1)
        if end < 0:
            out.append(text[at : begin + len(opener)])
            at = begin + len(opener)
            continue
        out.append(text[at:begin])
        if opener != "<!--":
            out.append(" ".join(text[begin:end].split('"')[1:-1:2]))
        at = end + 3


def _is_component(line: str) -> bool:
    """A line that is one tag of a component: its name begins with a capital letter."""
    tag = line.strip()
    inner = tag[1:-1].removeprefix("/")
    if len(tag) < 3 or tag[0] != "<" or tag[-1] != ">" or "<" in inner or ">" in inner or not inner[:1].isascii() or not inner[:1].isupper():
        return False
    name = inner.split(None, 1)[0].rstrip("/")
    return all(c.isalnum() or c in "_." for c in name)


def clean_markdown(lines: list[str]) -> list[str]:
    """Lines without comments, shortcodes, component tags and module imports; code fences stay as they are."""
    out: list[str] = []
    for code, group in itertools.groupby(zip(fenced(lines), lines, strict=True), key=lambda x: x[0]):
        run = [line for _, line in group]
        if not code:
            run = _without_markup("\n".join(run)).split("\n")
            run = [line for line in run if not _is_component(line) and line.split(None, 1)[:1] not in (["import"], ["export"])]
        out += run
    return out


class Breadcrumb:
    """The open headings: a new one closes all of its level or deeper."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = []

    def enter(self, level: int, title: str) -> tuple[str, ...]:
        self.open = [x for x in self.open if x[0] < level]
        self.open.append((level, title))
        return tuple(t for _, t in self.open)


def _heading(line: str) -> tuple[int, str] | None:
    """(level, title) of a heading of one to six ``#`` at the line's start and white space after them."""
    level = len(line) - len(line.lstrip("#"))
    if not 1 <= level <= 6 or not line[level : level + 1].isspace():
        return None
    title = line[level:].strip().rstrip("#").rstrip()
    if title.endswith("}") and title[title.rfind("{") + 1 :].lstrip().startswith("#"):  # its anchor
        title = title[: title.rfind("{")].rstrip()
    return level, title


def _sections(found: list[tuple[int, int, int, str]], lines: list[str]) -> list[Section]:
    """Sections of lines whose headings are (first line, lines, level, title), in order."""
    crumbs, out = Breadcrumb(), []
    begins = [(0, 0, 0, ""), *found]
    for (begin, used, level, title), (end, *_) in zip(begins, [*found, (len(lines), 0, 0, "")], strict=True):
        path = crumbs.enter(level, title) if level else ()
        section = Section(path, level, lines[begin + used : end], begin, begin + used)
        if title or section.body:
            out.append(section)
    return out


def markdown_lines(lines: list[str]) -> tuple[list[Section], str | None]:
    """Sections of cleaned lines and the first heading's title."""
    code = fenced(lines)
    found = [(i, 1, *h) for i, line in enumerate(lines) if not code[i] and (h := _heading(line))]
    return _sections(found, lines), (found[0][3] if found else None)


def markdown_sections(text: str) -> tuple[list[Section], str | None]:
    lines, title = front_matter(text.splitlines())
    sections, first = markdown_lines(clean_markdown(lines))
    return sections, title if title is not None else first


def _is_rule(line: str) -> bool:
    rule = line.rstrip()
    return len(rule) > 1 and rule[0] in RULE_CHARS and rule == rule[0] * len(rule)


def clean_rst(lines: list[str]) -> list[str]:
    """Lines without link targets and without the directives that hold no text (nor what is indented under them)."""
    out, depth = [], None
    for line in lines:
        indent = len(line) - len(line.lstrip())
        if depth is not None and (not line.strip() or indent > depth):
            continue
        m = _DIRECTIVE.match(line.lstrip())
        depth = indent if m and m[1].lower() in NOISE_DIRECTIVES else None
        bare = line.strip()
        is_target = bare.startswith("..") and bare[2:].lstrip().startswith("_") and bare[2:3].isspace() and bare.index(":") == len(bare) - 1 if ":" in bare else False
        if depth is None and not is_target:
            out.append(line)
    return out


def rst_sections(text: str) -> tuple[list[Section], str | None]:
    """A title stands over a rule, or between two of one character; the characters' levels go by first use."""
    lines, title = front_matter(text.splitlines())
    lines = clean_rst(lines)
    rule = [_is_rule(line) for line in lines] + [False, False]
    found, levels, i = [], {}, 0
    while i < len(lines):
        between = rule[i] and rule[i + 2] and lines[i + 1].strip() and lines[i][0] == lines[i + 2][0]
        over = not rule[i] and rule[i + 1] and lines[i].strip() and len(lines[i + 1].strip()) >= len(lines[i].strip()) - 2
        if not between and not over:
            i += 1
            continue
        name, char, used = (lines[i + 1], lines[i][0], 3) if between else (lines[i], lines[i + 1][0], 2)
        found.append((i, used, levels.setdefault(char, len(levels) + 1), name.strip()))
        i += used
    return _sections(found, lines), title if title is not None else (found[0][3] if found else None)


def cut_block(lines: list[str]) -> list[tuple[int, str]]:
    """(number of its first line, text) of the pieces of a block over the maximum.

    Paragraphs end at blank lines outside code fences and are packed up to the aim; a paragraph over the maximum is cut into
    equal runs of lines (a single line is never cut).
    """
    paragraphs, at = [], 0
    for blank, group in itertools.groupby(zip(lines, fenced(lines), strict=True), key=lambda x: not x[1] and not x[0].strip()):
        run = [line for line, _ in group]
        if not blank:
            paragraphs.append((at, run))
        at += len(run)
    pieces: list[tuple[int, list[str]]] = []
    room = 0
    for at, run in paragraphs:
        size = len("\n".join(run))
        if size > MOST:
            step = max(1, len(run) * TARGET // size)
            pieces += [(at + i, ["\n".join(run[i : i + step])]) for i in range(0, len(run), step)]
            room = 0
        elif size <= room:
            pieces[-1][1].append("\n".join(run))
            room -= size + 2
        else:
            pieces.append((at, ["\n".join(run)]))
            room = TARGET - size - 2
    return [(at, text) for at, parts in pieces if (text := "\n\n".join(parts).strip())]


def _block(s: Section) -> tuple[list[str], list[int]]:
    """The section's lines under its heading mark, without blank ones at the ends, and their numbers."""
    some = [i for i, line in enumerate(s.lines) if line.strip()]
    body = range(some[0], some[-1] + 1) if some else range(0)
    lines, numbers = [s.lines[i] for i in body], [s.first + i for i in body]
    if not s.path or not s.path[-1]:
        return lines, numbers
    head = f"{'#' * s.level} {s.path[-1]}"
    return [head, *([""] if lines else []), *lines], [s.begin, *([s.begin] if lines else []), *numbers]


def pack(sections: list[Section], n_lines: int = 0) -> list[Passage]:
    """Greedy: blocks are gathered until the next one would pass the aim (and enough is held); the first non-empty
    breadcrumb names the passage.  Small passages then join the one before them where that fits, under its name."""
    out: list[tuple[str, str, int]] = []
    held: list[tuple[str, str, int]] = []

    def flush() -> None:
        if held:
            out.append((next((name for name, _, _ in held if name), ""), "\n\n".join(text for _, text, _ in held), held[0][2]))
            held.clear()

    for s in sections:
        name = " > ".join(s.path)
        lines, numbers = _block(s)
        block = "\n".join(lines).strip()
        if not block:
            continue
        if len(block) > MOST:
            flush()
            out += [(name, text, s.begin if at == 0 else numbers[at]) for at, text in cut_block(lines)]
            continue
        size = sum(len(text) + 2 for _, text, _ in held)
        if size + len(block) > TARGET and size >= LEAST:
            flush()
        held.append((name, block, s.begin))
    flush()
    merged: list[tuple[str, str, int]] = []
    for name, text, begin in out:
        if merged and len(text) < LEAST and len(merged[-1][1]) + len(text) + 2 <= MOST:
            merged[-1] = (merged[-1][0], f"{merged[-1][1]}\n\n{text}", merged[-1][2])
        else:
            merged.append((name, text, begin))
    ends = [begin for _, _, begin in merged[1:]] + [n_lines]
    return [Passage(i, name, text, begin, end) for i, ((name, text, begin), end) in enumerate(zip(merged, ends, strict=False))]


def named(passages: list[Passage], title: str | None) -> list[Passage]:
    """Passages with the title in place of an empty breadcrumb; a document that is a mere stub has none."""
    if len(passages) == 1 and len(passages[0].text) < STUB:
        return []
    return [replace(p, heading_path=p.heading_path or title or "") for p in passages]


def split_document(text: str, suffix: str) -> tuple[str | None, list[Passage]]:
    """(title, passages) of one document."""
    suffix = suffix.lower().lstrip(".")
    if suffix in ("md", "mdx"):
        sections, title = markdown_sections(text)
    elif suffix == "rst":
        sections, title = rst_sections(text)
    else:
        sections, title = [Section((), 0, text.splitlines())], None
    return title, named(pack(sections), title)


def split_documents(files: DataFrame) -> DataFrame:
    """(source, path, chunk_id, ord, heading_path, text) of a table (source, path, text).

    chunk_id is a hash of source, path and ord, so it doesn't depend on partitioning.  Null texts have no passages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, path, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, found = split_document(text or "", path.rsplit(".", 1)[-1] if path and "." in path else "")
                rows += [(source, path, p.ord, p.heading_path, p.text) for p in found]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["source", "path", "ord", "heading_path", "text"])

    ship(files.sparkSession)
    split = files.select("source", "path", "text").mapInArrow(run, "source string, path string, ord int, heading_path string, text string")
    return split.withColumn("chunk_id", F.xxhash64("source", "path", "ord")).select("source", "path", "chunk_id", "ord", "heading_path", "text")
