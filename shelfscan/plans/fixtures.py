"""Contents in the formats of files, made from plain text: what readers must give back."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterable
from email.message import EmailMessage
from xml.sax.saxutils import escape

FORMATS = (".html", ".docx", ".xlsx", ".pptx", ".odt", ".epub", ".rtf", ".eml", ".zip")


def _zip(members: dict[str, str]) -> bytes:
    return _packed((n, t.encode("utf-8", "ignore")) for n, t in members.items())


def _packed(members: Iterable[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(out, "w") as z:
        warnings.simplefilter("ignore")  # a name that comes again
        for name, raw in members:
            z.writestr(name, raw)
    return out.getvalue()


def _rtf(text: str) -> bytes:
    """Every unit of UTF-16 beyond ASCII as \\u with one replacement character."""
    out = []
    for c in text:
        if c in "\\{}":
            out.append("\\" + c)
        elif c.isascii() and (c.isprintable()):
            out.append(c)
        elif c in "\n\r\t":
            out.append("\\par ")
        else:
            raw = c.encode("utf-16-le", "surrogatepass")
            out += [f"\\u{int.from_bytes(raw[k : k + 2], 'little', signed=True)}?" for k in range(0, len(raw), 2)]
    return ("{\\rtf1\\ansi " + "".join(out) + "}").encode("ascii")


def _mail(text: str) -> bytes:
    m = EmailMessage()
    m.set_content(text, cte="base64")
    return bytes(m)


def content(text: str, ext: str) -> bytes:
    """The text as a file of the type: words split over runs, in more than one part, with what is no text beside them."""
    half = len(text) // 2
    a, b = escape(text[:half]), escape(text[half:])
    if ext == ".html":
        return f"<!doctype html><html><style>p {{}}</style><script>if (1 < 2) {{}}</script><body><p>{a}<b>{b}</b></p></body></html>".encode("utf-8", "ignore")
    if ext == ".rtf":
        return _rtf(text)
    if ext == ".eml":
        return _mail(text)
    if ext == ".zip":
        return _packed((name.replace("\0", " "), b"") for name in text.split())
    run = lambda p, t: f"<{p}:p><{p}:r><{p}:t>{a}</{p}:t></{p}:r><{p}:r><{p}:t>{t}</{p}:t></{p}:r></{p}:p>"
    return _zip({
        ".docx": {"word/document.xml": run("w", b), "word/styles.xml": "<w:style>no</w:style>"},
        ".pptx": {"ppt/slides/slide1.xml": run("a", b), "ppt/theme/theme1.xml": "<a:t>no</a:t>"},
        ".xlsx": {"xl/sharedStrings.xml": f"<sst><si><r><t>{a}</t></r><r><t>{b}</t></r></si></sst>", "xl/worksheets/sheet1.xml": "<row><c><v>7</v></c></row>"},
        ".odt": {"content.xml": f"<text:p>{a}<text:span>{b}</text:span></text:p>", "styles.xml": "<x>no</x>"},
        ".epub": {"a.xhtml": f"<html><p>{a}<i>{b}</i></p></html>", "s.css": "no {}"},
    }[ext])
