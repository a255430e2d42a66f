"""Bytes of any supported kind as one envelope: text, tables, images, page anchors."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

from rolegraph.functions.sniff import sniff


@dataclass
class Table:
    name: str
    rows: list[dict[str, str]]
    origin: str = ""


@dataclass
class Image:
    data: bytes
    format: str
    caption: str = ""
    page: int | None = None


@dataclass
class Envelope:
    kind: str
    body: str = ""
    tables: list[Table] = field(default_factory=list)
    images: list[Image] = field(default_factory=list)
    meta: dict[str, object] = field(default_factory=dict)
    anchors: list[tuple[int, int]] = field(default_factory=list)  # (offset in the body, page)

    def page_at(self, offset: int) -> int | None:
        page = None
        for at, p in self.anchors:
            if at <= offset:
                page = p
        return page


class UnsupportedKind(ValueError):
    pass


def _cell(v: object) -> str:
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _objects(name: str, rows: list[dict]) -> Table:
    columns = list(dict.fromkeys(k for r in rows for k in r))
    return Table(name, [{c: _cell(r.get(c)) for c in columns} for r in rows])


def _json(name: str, text: str) -> Envelope:
    value = json.loads(text)
    if isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
        return Envelope("json", tables=[_objects(name, value)])
    return Envelope("json", body="```json\n" + json.dumps(value, indent=2, ensure_ascii=False) + "\n```")


def _csv(name: str, text: str) -> Envelope:
    try:
        dialect = csv.Sniffer().sniff("\n".join(text.splitlines()[:20]), delimiters=",;\t")
    except csv.Error:
        dialect = csv.excel
    rows = list(csv.DictReader(io.StringIO(text), dialect=dialect))
    return Envelope("csv", tables=[Table(name, [{k: _cell(v) for k, v in r.items() if k is not None} for r in rows])])


_NS = {"w": "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "a": "{http://schemas.openxmlformats.org/drawingml/2006/main}", "s": "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"}


def _grid(name: str, grid: list[list[str]]) -> Table | None:
    grid = [r for r in grid if any(c.strip() for c in r)]
    if len(grid) < 2:
        return None
    head = [c.strip() or f"column{i + 1}" for i, c in enumerate(grid[0])]
    return Table(name, [{h: (r[i] if i < len(r) else "") for i, h in enumerate(head)} for r in grid[1:]])


def _docx(name: str, data: bytes) -> Envelope:
    w = _NS["w"]
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    text = lambda el: "".join(t.text or "" for t in el.iter(f"{w}t"))
    out, env = [], Envelope("docx")
    body = root.find(f"{w}body")
    for el in [] if body is None else list(body):
        if el.tag == f"{w}p":
            style = el.find(f"{w}pPr/{w}pStyle")
            level = re.fullmatch(r"Heading(\d)", style.get(f"{w}val", "")) if style is not None else None
            if t := text(el).strip():
                out.append("#" * int(level[1]) + " " + t if level else t)
        elif el.tag == f"{w}tbl":
            t = _grid(f"{name} table {len(env.tables) + 1}", [[text(c) for c in r.iter(f"{w}tc")] for r in el.iter(f"{w}tr")])
            if t:
                env.tables.append(t)
    env.body = "\n\n".join(out)
    return env


def _xlsx(name: str, data: bytes) -> Envelope:
    s, z = _NS["s"], zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{s}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{s}si")]
    titles = [x.get("name", "") for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{s}sheet")]
    env = Envelope("xlsx")
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    for i, sheet in enumerate(sheets):
        grid = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{s}row"):
            cells: dict[int, str] = {}
            for n, c in enumerate(row.iter(f"{s}c")):
                ref = re.match(r"[A-Z]+", c.get("r", ""))
                col = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(ref[0]))) - 1 if ref else n
                v = c.find(f"{s}v")
                inline = "".join(t.text or "" for t in c.iter(f"{s}t"))
                cells[col] = shared[int(v.text)] if c.get("t") == "s" and v is not None else (v.text or "") if v is not None else inline
            grid.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        t = _grid(titles[i] if i < len(titles) else f"sheet {i + 1}", grid)
        if t:
            env.tables.append(t)
    return env


def _pptx(name: str, data: bytes) -> Envelope:
    a, z = _NS["a"], zipfile.ZipFile(io.BytesIO(data))
    env, body = Envelope("pptx"), ""
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    read = lambda part: [t for p in ElementTree.fromstring(z.read(part)).iter(f"{a}p") if (t := "".join(x.text or "" for x in p.iter(f"{a}t")).strip())]
    for i, slide in enumerate(slides, 1):
        lines = read(slide)
        notes = slide.replace("slides/slide", "notesSlides/notesSlide")
        said = read(notes) if notes in z.namelist() else []
        env.anchors.append((len(body), i))
        body += f"# {lines[0] if lines else f'slide {i}'}\n\n" + "".join(f"{x}\n\n" for x in lines[1:]) + ("Notes: " + " ".join(said) + "\n\n" if said else "")
    env.body = body.rstrip()
    return env


def _pdf(name: str, data: bytes) -> Envelope:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise UnsupportedKind("reading pdf needs the pypdf package") from e
    env, body = Envelope("pdf"), ""
    pages = PdfReader(io.BytesIO(data)).pages
    for i, page in enumerate(pages, 1):
        env.anchors.append((len(body), i))
        body += (page.extract_text() or "").strip() + "\n\n"
    env.body, env.meta["pages"] = body.rstrip(), len(pages)
    return env


def normalize(data: bytes, filename: str = "") -> Envelope:
    kind = sniff(data, filename)
    name = filename.rpartition("/")[2].rpartition(".")[0] or "table"
    if kind in ("png", "jpeg", "gif", "webp"):
        return Envelope(kind, images=[Image(data, kind, caption=filename)])
    if kind in ("docx", "xlsx", "pptx", "pdf"):
        return {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "pdf": _pdf}[kind](name, data)
    if kind in ("zip", "binary"):
        raise UnsupportedKind(f"{filename or 'the file'} is of an unsupported kind ({kind})")
    text = data.decode("utf-8-sig")
    if kind == "json":
        return _json(name, text)
    if kind == "jsonl":
        rows = [json.loads(x) for x in text.splitlines() if x.strip()]
        return Envelope("jsonl", tables=[_objects(name, rows)])
    if kind == "csv":
        return _csv(name, text)
    return Envelope(kind, body=text)
