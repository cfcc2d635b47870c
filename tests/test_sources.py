"""Registry, acquisition, rich documents, materialisation, snapshots, synchronisation, streaming, access and read calls."""

from __future__ import annotations

import io
import json
import os
import subprocess
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quarry import access, api, config
from quarry.functions import text as T
from quarry.functions import topics
from quarry.operators import lifecycle, materialize, snapshot
from quarry.sources import acquire, manifest, registry, rich
from quarry.streaming import ingest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*items: tuple[str, str], rels: str | None = None) -> bytes:
    def paragraph(style: str, text: str) -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"

    def table(text: str) -> str:
        rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row.split(",")) + "</w:tr>" for row in text.split(";"))
        return f"<w:tbl>{rows}</w:tbl>"

    body = "".join(table(t) if s == "table" else paragraph(s, t) for s, t in items)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        if rels:
            z.writestr("word/_rels/document.xml.rels", rels)
    return out.getvalue()


GUIDE = docx(("", "Before all headings."), ("Heading1", "Pumps"), ("", "A pump moves water from one basin to the other."), ("Heading2", "Valves"), ("table", "name,size;inlet"), ("Code", "open(valve)"))


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ("version = 2", "version"),
        ("version = 1\nextra = 1", "unknown key"),
        ('version = 1\n[source]\nname = "a"', "array"),
        ('version = 1\n[[source]]\nname = "A"\ntype = "git"\nurl = "x"', "must match"),
        ('version = 1\n[[source]]\nname = "con.x"\ntype = "git"\nurl = "x"', "device"),
        ('version = 1\n[[source]]\nname = "a."\ntype = "git"\nurl = "x"', "dot"),
        ('version = 1\n[[source]]\nname = "a"\ntype = "ftp"', "type"),
        ('version = 1\n[[source]]\nname = "a"\ntype = "git"\nurl = "https://u:p@h/x"', "credentials"),
        ('version = 1\n[[source]]\nname = "a"\ntype = "git"\nurl = "x"\npath = "y"', "no field path"),
        ('version = 1\n[[source]]\nname = "a"\ntype = "git"\nurl = "x"\ndirectory = "../y"', "directory"),
        ('version = 1\n[[source]]\nname = "a"\ntype = "local"\npath = "/no/such/folder"', "no such folder"),
        ('version = 1\n[[source]]\nname = "a"\ntype = "git"\nurl = "x"\n[[source]]\nname = "a"\ntype = "git"\nurl = "y"', "twice"),
        ('version = 1\n[[source]]\nname = "a"\ntype = "git"\nurl = "x"\n[[source]]\nname = "a-docs"\ntype = "git"\nurl = "y"', "-docs"),
        ("version = ", "not TOML"),
    ],
)
def test_registry_refuses(text, fault):
    with pytest.raises(registry.RegistryError, match=fault):
        registry.parse(text)


def test_registry_hashes(tmp_path):
    one = registry.parse(f'version = 1\n[[source]]\nname = "a"\ntype = "local"\npath = "{tmp_path}"')[0]
    two = registry.parse(f'version = 1\n[[source]]\nname = "a"\ntype = "local"\npath = "{tmp_path}"\ndescription = "d"')[0]
    assert one.acquisition_hash == two.acquisition_hash and one.config_hash != two.config_hash
    (tmp_path / "x-docs").mkdir()
    (tmp_path / ".hidden").mkdir()
    assert [s.name for s in registry.discover(tmp_path)] == ["x"]


def tree(root: Path) -> Path:
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# Alpha\n\nThe alpha page tells of rivers and of bridges over them.\n")
    (root / "sub" / "B.TXT").write_text("Beta is a text about lighthouses on rocky coasts.\n")
    (root / "_c.rst").write_text("Gamma\n=====\n\nGamma rays are found above the mountain lakes.\n")
    (root / "x.png").write_bytes(b"x")
    (root / ".git").mkdir()
    (root / ".git" / "d.md").write_text("hidden")
    (root / "link.md").symlink_to(root / "a.md")
    return root


def test_local_snapshot(spark, tmp_path):
    root = tree(tmp_path / "in")
    taken = acquire.acquire(registry.Source("s", "local", str(root)), tmp_path / "work")
    assert (taken.paths, taken.skipped) == (("_c.rst", "a.md", "sub/B.TXT"), 3)
    rows = acquire.contents(spark, taken, most_bytes=60).orderBy("path").collect()
    assert [(r["path"], r["error"]) for r in rows] == [("_c.rst", "too_large" if rows[0]["bytes"] > 60 else None), ("a.md", "too_large" if rows[1]["bytes"] > 60 else None), ("sub/B.TXT", None)]
    assert rows[2]["content"] == (root / "sub" / "B.TXT").read_bytes()
    assert [r["path"] for r in acquire.scan(spark, str(root), "s").orderBy("path").collect()] == ["a.md", "link.md", "sub/B.TXT"]


def test_git_snapshot(tmp_path):
    root = tmp_path / "in"
    (root / "docs").mkdir(parents=True)
    (root / "docs" / "a.md").write_text("# A\n")
    (root / "docs" / "b.docx").write_bytes(GUIDE)
    env = os.environ | {"GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@t", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@t"}
    for command in (["init", "-q", "-b", "main"], ["add", "."], ["commit", "-qm", "one"]):
        subprocess.run(["git", *command], cwd=root, env=env, check=True)
    taken = acquire.acquire(registry.Source("g", "git", str(root), "main", "docs"), tmp_path / "work")
    assert (taken.paths, taken.skipped, len(taken.revision)) == (("a.md",), 1, 40)
    with pytest.raises(RuntimeError):
        acquire.acquire(registry.Source("g", "git", str(root), "nowhere"), tmp_path / "work")
    assert [p.name for p in (tmp_path / "work").iterdir()] == [taken.root.name]


def test_text_is_decoded_strictly(spark):
    rows = [("a", b"good"), ("b", b"\xff"), ("c", b"x\x00"), ("d", b"\x10\x0a\x00"), ("e", b"\x10\x0a"), ("f", b""), ("g", None)]
    found = acquire.decoded(spark.createDataFrame(rows, "path string, content binary")).orderBy("path").collect()
    assert [r["error"] is None for r in found] == [True, False, False, False, True, True, False]
    assert found[0]["text"] == "good" and found[3]["text"] is None
    assert T.normalize(" a\r\n b ") == "a b"


def test_docx_blocks():
    parsed = rich.parse(GUIDE, ".DOCX")
    assert [(b.kind, b.level) for b in parsed.blocks] == [("paragraph", None), ("heading", 1), ("paragraph", None), ("heading", 2), ("table", None), ("code", None)]
    assert parsed.blocks[4].text == "| name | size |\n| --- | --- |\n| inlet |  |"


@pytest.mark.parametrize(
    ("content", "code"),
    [
        (b"text", "format_mismatch"),
        (b"PK\x03\x04broken", "invalid_docx"),
        (docx(), "empty_document"),
        (docx(("", "x"), rels='<r TargetMode="External"/>'), "external_relationship"),
    ],
)
def test_docx_refused(content, code):
    with pytest.raises(rich.RichError) as e:
        rich.parse(content, "docx")
    assert e.value.code == code


def test_pages_and_topics():
    parsed = rich.from_pages(["INTRODUCTION\nplain words that follow the head", "\x01\x02", "- an item of a list"], "test", "1")
    assert [(b.page, b.page_index, b.kind) for b in parsed.blocks] == [(1, 0, "heading"), (1, 1, "paragraph"), (3, 0, "list")]
    assert parsed.warnings == ("ocr_required: page 2 has no usable text",)
    bare = rich.from_pages([f"words of page number {i} here" for i in range(12)], "test", "1")
    found = topics.topics_of(bare)
    assert [topics.file_name(t) for t in found] == ["p0001-p0010-untitled-section.md", "p0011-p0012-untitled-section.md"]
    assert found[0].title == "Untitled section (pages 1–10)" and found[0].confidence == 0.25


def test_topics_of_docx():
    found = topics.topics_of(rich.parse(GUIDE, "docx"))
    assert [(t.title, t.heading_path, t.confidence) for t in found] == [("Untitled section", (), 0.5), ("Pumps", ("Pumps",), 0.9), ("Valves", ("Pumps", "Valves"), 0.9)]
    assert topics.markdown(found[2]) == "# Valves\n\n| name | size |\n| --- | --- |\n| inlet |  |\n\n```\nopen(valve)\n```\n"
    assert topics.file_name(found[1]) == "d000002-b0000-pumps.md"


def test_page_marks():
    words = "word " * 1200
    text = f"# T\n\n{topics.page_mark(3, 'iii')}\n\n{words}\n\n## U\n\n{topics.page_mark(4)}\n\n{words}"
    title, passages = topics.paged_passages(text)
    assert title == "T"
    assert [(p.page_start, p.page_end) for p in passages] == [(3, 3), (3, 4)]
    assert passages[0].provenance == ((3, "iii"),) and topics.MARKER not in passages[0].text


def test_topic_numbers(spark):
    rows = [(1, 0, "paragraph"), (1, 1, "heading"), (1, 2, "list"), (2, 0, "heading"), (2, 1, "heading")]
    found = topics.topic_numbers(spark.createDataFrame(rows, "doc long, index int, kind string"), ["doc"]).orderBy("doc", "index").collect()
    assert [r["topic"] for r in found] == [0, 1, 1, 0, 1]


def test_manifest_checks(tmp_path):
    made, files = manifest.build("s", "g.docx", "0" * 64, "f", rich.parse(GUIDE, "docx"))
    manifest.publish(tmp_path / "g.docx", made, files)
    assert manifest.read(tmp_path / "g.docx") == json.loads(manifest.canonical(made))
    for change in ({"extra": 1}, {"origin_path": "../x"}, {"origin_sha256": "x"}, {"manifest_version": 2}, {"ocr_pages": [1]}, {"documents": made["documents"] * 2}):
        with pytest.raises(manifest.ManifestError):
            manifest.check(made | change)
    (tmp_path / "g.docx" / "more.md").write_text("x")
    with pytest.raises(manifest.ManifestError, match="differ"):
        manifest.read(tmp_path / "g.docx")
    (tmp_path / "g.docx" / "more.md").unlink()
    (tmp_path / "g.docx" / made["documents"][0]["path"]).write_text("altered")
    with pytest.raises(manifest.ManifestError, match="altered"):
        manifest.read(tmp_path / "g.docx")


def test_materialize_lifecycle(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"
    root.mkdir()
    (root / "good.docx").write_bytes(GUIDE)
    (root / "bad.docx").write_bytes(b"no container")

    def once(**options):
        taken = acquire.acquire(registry.Source("s", "local", str(root)), tmp_path / "work")
        return {r["path"]: r["action"] for r in materialize.materialize(spark, taken, out, **options)}

    assert once() == {"good.docx": "added", "bad.docx": "failed"}
    assert materialize.inspect(out, "s", "bad.docx")["last_failure"]["code"] == "format_mismatch"
    (root / "bad.docx").unlink()
    assert once() == {"good.docx": "unchanged"} and materialize.failures(out, "s") == {}
    first = {p.name: p.read_bytes() for p in (out / "s" / "good.docx").iterdir()}
    assert once(force=True) == {"good.docx": "changed"}
    assert first == {p.name: p.read_bytes() for p in (out / "s" / "good.docx").iterdir()}
    topic = next(n for n in first if n.endswith("pumps.md"))
    assert "moves water" in materialize.inspect(out, "s", f"good.docx/{topic}")["markdown"]
    (root / "good.docx").unlink()
    assert once() == {"good.docx": "removed"} and not (out / "s" / "good.docx").exists()


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    base = tmp_path_factory.mktemp("sync")
    root = tree(base / "in")
    (root / "g.docx").write_bytes(GUIDE)
    (base / "sources.toml").write_text(f'version = 1\n[[source]]\nname = "s"\ntype = "local"\npath = "{root}"\n')
    return base, root, config.Settings(sources_config=str(base / "sources.toml"), state_dir=str(base / "state"))


def test_sync_lifecycle(spark, place):
    base, root, settings = place
    dry = lifecycle.sync_index(spark, settings, dry_run=True)
    assert [(s.action, s.status) for s in dry.sources] == [("add", "planned")] and not (base / "state").exists()
    first = lifecycle.sync_index(spark, settings)
    assert first.sources[0].counts == {"added": 6, "changed": 0, "removed": 0, "unchanged": 0} and first.exit_code == 0
    (root / "a.md").write_text("# Alpha\n\nThe alpha page now tells of tunnels below the river instead.\n")
    (root / "sub" / "B.TXT").unlink()
    second = lifecycle.sync_index(spark, settings)
    assert second.sources[0].counts == {"added": 0, "changed": 1, "removed": 1, "unchanged": 4}
    library = api.Library(spark, settings)
    hits = library.search_docs("tunnels below the river", "s").collect()
    assert hits[0]["path"] == "a.md" and hits[0]["title"] == "Alpha"
    assert library.search_docs("lighthouses", "s").where(F.col("text").contains("lighthouses")).isEmpty()
    listed = library.list_sources().first()
    assert (listed["source"], listed["files"]) == ("s", 5)
    assert "tunnels" in library.document("s", "a.md")
    with pytest.raises(ValueError, match="unknown source"):
        library.search_docs("x", "nowhere")
    (root / "bad.txt").write_bytes(b"a\x00b")
    third = lifecycle.sync_index(spark, settings)
    assert third.exit_code == 1 and "bad.txt" in third.sources[0].error
    assert library.list_sources().first()["files"] == 5  # the last good state stays
    (root / "bad.txt").unlink()
    again = lifecycle.sync_index(spark, settings)
    assert (again.sources[0].action, again.sources[0].status, again.sources[0].counts["unchanged"]) == ("retry", "ready", 5)
    assert "unchanged" in lifecycle.report(again)
    rebuilt = lifecycle.sync_index(spark, settings, rebuild=True)
    assert rebuilt.sources[0].counts["added"] == 5
    with pytest.raises(ValueError):
        lifecycle.sync_index(spark, settings, only="s", rebuild=True)
    assert snapshot.validate(snapshot.open_index(spark, settings.index).tables) == []


def test_http_calls(spark, place):
    _, _, settings = place
    app = api.application(api.Library(spark, settings))

    def get(path, query="", **headers):
        seen = []
        body = b"".join(app({"PATH_INFO": path, "QUERY_STRING": query, **headers}, lambda status, _: seen.append(int(status.split()[0]))))
        return seen[0], json.loads(body)

    assert get("/health")[0] == 200
    status, found = get("/search", "query=gamma+rays&source=s&limit=1")
    assert status == 200 and found["hits"][0]["path"] == "_c.rst"
    assert get("/search", "query=x")[0] == 400
    assert get("/doc", "source=s&path=none")[0] == 404
    assert get("/sources", HTTP_ORIGIN="http://elsewhere")[0] == 403


def test_removed_source(spark, place):
    base, _, settings = place
    (base / "sources.toml").write_text("version = 1\n")
    done = lifecycle.sync_index(spark, settings)
    assert [(s.action, s.counts["removed"]) for s in done.sources] == [("remove", 5)]
    assert snapshot.open_index(spark, settings.index)["chunks"].isEmpty()
    assert not (settings.materialized / "s").exists()


def test_lock(tmp_path):
    with snapshot.locked(tmp_path), pytest.raises(snapshot.PublishError), snapshot.locked(tmp_path):
        pass


def test_stream(spark, tmp_path):
    settings = config.Settings(state_dir=str(tmp_path / "state"))
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n\nThe first file is about copper kettles and steam.\n")

    def once():
        query = ingest.ingest(spark, settings, str(folder), "s", str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        assert query.exception() is None

    once()
    (folder / "b.txt").write_text("The second file is about silver spoons and sugar.\n")
    (folder / "bad.txt").write_bytes(b"\xff\xfe")
    once()
    index = snapshot.open_index(spark, settings.index)
    assert [r["path"] for r in index["files"].orderBy("path").collect()] == ["a.md", "b.txt"]
    assert index["chunks"].count() == 2


def test_access():
    assert access.refuse("/search", {}) is None
    assert access.refuse("/search", {"origin": "http://a"}).status == 403
    assert access.refuse("/search", {"origin": "http://a"}, origins=["http://a"]) is None
    assert access.refuse("/search", {"host": "h:1"}, hosts=["h:*"]) is None
    assert access.refuse("/search", {}, hosts=["h:*"]).status == 421
    assert access.refuse("/search", {"authorization": "Bearer no"}, token="t").status == 401
    assert access.refuse("/search", {"authorization": "bearer t"}, token="t") is None
    assert access.refuse("/health", {}, token="t") is None


def test_settings():
    found = config.from_environment({"QUARRY_STATE_DIR": "/x", "QUARRY_ALLOWED_HOSTS": "a, b", "QUARRY_PDF_PAGES": "5"})
    assert (str(found.materialized), found.allowed_hosts, found.limits.pdf_pages) == ("/x/materialized", ("a", "b"), 5)
    with pytest.raises(ValueError):
        config.from_environment({"QUARRY_PDF_PAGES": "many"})
