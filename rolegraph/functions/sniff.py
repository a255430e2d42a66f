"""What a file holds, by its first bytes and its text."""

from __future__ import annotations

import csv
import io
import json
import zipfile

# fixed values: leading bytes of binary formats
MAGIC = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"%PDF-", "pdf"))
OFFICE = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"))
SUFFIX = {"md": "markdown", "markdown": "markdown", "csv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "txt": "text"}


def sniff(data: bytes, filename: str = "") -> str:
    """One of png, jpeg, webp, gif, pdf, docx, xlsx, pptx, zip, json, jsonl, markdown, csv, text, binary."""
    for magic, kind in MAGIC:
        if data.startswith(magic):
            return kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data.startswith(b"PK\x03\x04"):
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            return "binary"
        return next((kind for part, kind in OFFICE if part in names), "zip")
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "binary"
    if any(ord(c) < 32 and c not in "\t\n\r\f" for c in text):
        return "binary"
    body = text.strip()
    if not body:
        return "text"
    if _is_json(body):
        return "json"
    lines = [x for x in body.splitlines() if x.strip()]
    if len(lines) > 1 and all(x.lstrip().startswith("{") and _is_json(x) for x in lines):
        return "jsonl"
    suffix = SUFFIX.get(filename.rpartition(".")[2].lower())
    if suffix in ("markdown", "csv"):
        return suffix
    if any(x.startswith("#") and x.lstrip("#").startswith(" ") for x in lines) or "```" in body:
        return "markdown"
    return "csv" if suffix != "text" and _is_csv(lines) else "text"  # commas in prose are no columns


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def _is_csv(lines: list[str]) -> bool:
    if len(lines) < 2:
        return False
    try:
        dialect = csv.Sniffer().sniff("\n".join(lines[:20]), delimiters=",;\t")
    except csv.Error:
        return False
    widths = {len(r) for r in csv.reader(lines[:50], dialect)}
    return len(widths) == 1 and widths.pop() > 1
