"""Lines of a word processor's file: a zip member read as a stream of XML events, bounded in size."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

#: The member with the text, and the namespace of its elements. Fixed values.
MEMBER = "word/document.xml"
SPACE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class _Bounded(io.RawIOBase):
    """At most ``most`` bytes of a stream; more is an error, whatever the archive says about its size."""

    def __init__(self, stream, most: int) -> None:
        self.stream, self.left = stream, most

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.stream.read(len(buffer))
        self.left -= len(got)
        if self.left < 0:
            raise ValueError("the text is larger than allowed")
        buffer[: len(got)] = got
        return len(got)


def _events(stream) -> tuple[list[str], list[str]]:
    """Lines of table rows, and of paragraphs outside tables. A table inside a cell belongs to that cell."""
    rows, paragraphs = [], []
    tables = 0
    cells: list[str] = []
    text: list[str] = []
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        name = node.tag.removeprefix(SPACE)
        if event == "start":
            tables += name == "tbl"
            if name == "tr" and tables == 1:
                cells = []
            if name == "tc" and tables == 1 or name == "p" and tables == 0:
                text = []
            continue
        if name == "t":
            text.append(node.text or "")
        elif name == "tc" and tables == 1:
            cells.append("".join(text).strip())
        elif name == "tr" and tables == 1:
            filled = [c for c in cells if c]
            if filled:
                rows.append(f"- {filled[0]}: {' '.join(filled[1:])}" if len(filled) > 1 else filled[0])
        elif name == "p" and tables == 0:
            line = "".join(text).strip()
            if line:
                paragraphs.append(line)
        elif name == "tbl":
            tables -= 1
        node.clear()
    return rows, paragraphs


def document_text(content: bytes | None, most: int) -> str | None:
    """Table rows as ``- first: rest``, then paragraphs, repeats of the line before left out; null for a file that is no such archive, or whose text is larger than ``most`` bytes."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as archive, archive.open(MEMBER) as member:
            rows, paragraphs = _events(io.BufferedReader(_Bounded(member, most)))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, EOFError, NotImplementedError, OSError):
        return None
    lines = rows + paragraphs
    return "\n".join(x for i, x in enumerate(lines) if not i or x != lines[i - 1])


def texts(contents: Iterator, most: int) -> Iterator[str | None]:
    return (document_text(None if c is None else bytes(c), most) for c in contents)
