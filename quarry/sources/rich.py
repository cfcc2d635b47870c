"""Rich documents (DOCX, PDF) as ordered blocks."""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from xml.etree import ElementTree

from quarry.config import Limits
from quarry.functions.text import MAX_SUSPICIOUS, MEDIA_TYPES, MIN_USABLE_CHARS, normalize

#: Fixed values of the formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAGIC = {"pdf": b"%PDF-", "docx": b"PK\x03\x04"}
NUMBERED = re.compile(r"(?:\d+(?:\.\d+)*[.)]?|chapter\s+\d+|פרק\s+\S+)[ \t]+\S", re.IGNORECASE)
BULLETS = ("- ", "* ", "• ")
HEADING_CHARS = (2, 100)


class RichError(ValueError):
    """A document that can't be taken, with a stable code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Block:
    """One unit of a document; ``index`` counts in the document, ``page_index`` within its page."""

    index: int
    kind: str  # heading, paragraph, list, table, code or formula
    text: str
    level: int | None = None
    page: int | None = None
    page_label: str | None = None
    page_index: int = 0
    method: str = "native"


@dataclass(frozen=True)
class Parsed:
    media_type: str
    blocks: tuple[Block, ...]
    parser: str
    version: str
    page_count: int | None = None
    warnings: tuple[str, ...] = field(default=())


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _word_xml(content: bytes, limits: Limits) -> bytes:
    """The main part of a container that passes all safety checks."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = z.infolist()
            names = [e.filename for e in entries]
            checks = (
                (len(entries) > limits.docx_entries, "too_many_zip_entries", "too many entries"),
                (sum(e.file_size for e in entries) > limits.docx_expanded_bytes, "docx_expansion_too_large", "too large when expanded"),
                (any(n.startswith("/") or ".." in PurePosixPath(n).parts for n in names), "unsafe_zip_path", "an entry leaves the container"),
                (any(n.lower().endswith("vbaproject.bin") for n in names), "docx_macro", "macros are not supported"),
            )
            for failed, code, message in checks:
                if failed:
                    raise RichError(code, message)
            for name in names:
                if name.lower().endswith(".rels") and re.search(rb"""TargetMode\s*=\s*["']External["']""", z.read(name)):
                    raise RichError("external_relationship", "relationships to outside are not supported")
            return z.read("word/document.xml")
    except (KeyError, zipfile.BadZipFile, OSError, EOFError, RuntimeError, NotImplementedError) as e:
        raise RichError("invalid_docx", "not a readable DOCX container") from e


def _word_paragraph(p: ElementTree.Element) -> tuple[str, str, int | None]:
    """(kind, text, level); text runs and formula runs both end in a ``t`` element."""
    names = [_local(x) for x in p.iter()]
    text = normalize("".join(x.text or "" for x in p.iter() if _local(x) == "t"), keep_layout=True)
    styled = p.find(f"{WORD}pPr/{WORD}pStyle")
    style = (styled.get(f"{WORD}val") or "").lower() if styled is not None else ""
    if style.startswith("heading"):
        number = "".join(filter(str.isdigit, style))
        return "heading", text, min(max(int(number or 1), 1), 6)
    if "oMath" in names or "oMathPara" in names:
        return "formula", text, None
    if "code" in style or "preformatted" in style:
        return "code", text, None
    if p.find(f"{WORD}pPr/{WORD}numPr") is not None:
        return "list", f"- {text}", None
    return "paragraph", text, None


def _word_table(table: ElementTree.Element) -> str:
    """A pipe table; short rows are filled up, the first row is the head."""
    rows = [[normalize(" ".join(t.text or "" for t in cell.iter(f"{WORD}t"))).replace("|", "\\|") for cell in row.findall(f"{WORD}tc")] for row in table.findall(f"{WORD}tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    columns = max(len(r) for r in rows)
    lines = ["| " + " | ".join(r + [""] * (columns - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * columns) + " |", *lines[1:]])


def parse_docx(content: bytes, limits: Limits) -> Parsed:
    """Blocks in body order; ``index`` is the element's place in the body."""
    try:
        body = ElementTree.fromstring(_word_xml(content, limits)).find(f".//{WORD}body")
    except ElementTree.ParseError as e:
        raise RichError("invalid_docx_xml", "the document part is not XML") from e
    if body is None:
        raise RichError("invalid_docx_xml", "the document has no body")
    blocks = []
    for i, element in enumerate(body):
        if element.tag == f"{WORD}p":
            kind, text, level = _word_paragraph(element)
        elif element.tag == f"{WORD}tbl":
            kind, text, level = "table", _word_table(element), None
        else:
            continue
        if text:
            blocks.append(Block(i, kind, text, level))
    return Parsed(MEDIA_TYPES["docx"], tuple(blocks), "docx-ooxml", "1")


def usable_text(text: str) -> bool:
    """The Python form of `functions.text.usable`."""
    solid = [c for c in text if not c.isspace()]
    odd = sum(c == "�" or ord(c) < 32 for c in solid)
    return len(solid) >= MIN_USABLE_CHARS and odd < MAX_SUSPICIOUS * len(solid)


def line_kind(line: str) -> str:
    """heading (numbered, or 2 to 100 characters without a lower-case letter), list or paragraph.

    Scripts without case count as upper case, so their short first lines become headings.
    """
    line = line.strip()
    low, high = HEADING_CHARS
    shouted = low <= len(line) <= high and line == line.upper() and any(map(str.isalpha, line))
    if NUMBERED.match(line) or shouted:
        return "heading"
    return "list" if line.startswith(BULLETS) else "paragraph"


def page_blocks(page: int, text: str, first: int, method: str = "native") -> list[Block]:
    """Blocks of one page's text: parted at blank lines, a heading line parted from what follows it."""
    pieces: list[tuple[str, str]] = []
    for group in re.split(r"\n\s*\n", normalize(text, keep_layout=True)):
        group = normalize(group, keep_layout=True)
        head, _, rest = group.partition("\n")
        kind = line_kind(head) if group else ""
        pieces += [("heading", head), ("paragraph", rest)] if kind == "heading" else [(kind, group)]
    cleaned = [(kind, normalize(body, keep_layout=True)) for kind, body in pieces]
    return [Block(first + i, kind, body, 1 if kind == "heading" else None, page, None, i, method) for i, (kind, body) in enumerate(x for x in cleaned if x[1])]


def parse_pdf(content: bytes, limits: Limits) -> Parsed:
    """Text of each page through the optional ``pypdf`` package; pages without usable text are reported as warnings."""
    if importlib.util.find_spec("pypdf") is None:
        raise RichError("pdf_unavailable", "reading PDF needs the pypdf package")
    import pypdf

    try:
        reader = pypdf.PdfReader(io.BytesIO(content), strict=False)
        locked, pages = reader.is_encrypted, [] if reader.is_encrypted else list(reader.pages)
    except Exception as e:  # the package raises many kinds for damaged files
        raise RichError("invalid_pdf", "not a readable PDF") from e
    if locked:
        raise RichError("encrypted_pdf", "encrypted PDFs are not supported")
    if len(pages) > limits.pdf_pages:
        raise RichError("too_many_pages", f"{len(pages)} pages")
    texts: list[str] = []
    for page in pages:
        try:
            texts.append(page.extract_text() or "")
        except Exception:  # one damaged page doesn't lose the others
            texts.append("")
    return from_pages(texts, "pypdf-native", pypdf.__version__)


def from_pages(texts: list[str], parser: str, version: str) -> Parsed:
    blocks: list[Block] = []
    warnings = []
    for number, text in enumerate(texts, 1):
        if usable_text(text):
            blocks += page_blocks(number, text, len(blocks))
        else:
            warnings.append(f"ocr_required: page {number} has no usable text")
    return Parsed(MEDIA_TYPES["pdf"], tuple(blocks), parser, version, len(texts), tuple(warnings))


PARSERS: dict[str, Callable[[bytes, Limits], Parsed]] = {"docx": parse_docx, "pdf": parse_pdf}


def parse(content: bytes, suffix: str, limits: Limits | None = None) -> Parsed:
    """Checks size and leading bytes, parses, checks what came out."""
    limits = limits or Limits()
    suffix = suffix.lower().lstrip(".")
    if suffix not in PARSERS:
        raise RichError("unsupported_format", f"no parser for .{suffix}")
    if len(content) > limits.rich_bytes:
        raise RichError("file_too_large", f"{len(content)} bytes")
    if not content.startswith(MAGIC[suffix]):
        raise RichError("format_mismatch", f"the content is no .{suffix} file")
    parsed = PARSERS[suffix](content, limits)
    if not parsed.blocks:
        raise RichError("empty_document", "no text was found")
    if sum(len(b.text) for b in parsed.blocks) > limits.extracted_chars:
        raise RichError("too_much_text", "more text than allowed")
    return parsed
