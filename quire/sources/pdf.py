"""What a PDF holds, read from its bytes: pages with their text and images, and the document's own metadata.

A small reader for plain files: objects, object streams, Flate and plain contents, text as it is shown or as `ActualText`
gives it. Fonts with encodings of their own, scans and encrypted files need a full extractor, which `files.PdfSource` takes as an option.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"\bstream\r?\n")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\d|\s+\d+\s+R)")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_STRING = rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*+\))*+\)|<[0-9A-Fa-f\s]*+>"
_TOKEN = re.compile(_STRING + rb"|<<|>>|[\[\]]|/[^\s/<>\[\]()]*|[^\s/<>\[\]()]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
INFO = ("Title", "Author", "Subject")


def string(token: bytes) -> bytes:
    """The bytes of a literal or a hexadecimal string."""
    if token.startswith(b"<"):
        digits = b"".join(token[1:-1].split())
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    told = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _ESCAPES.get(m[1], m[1])
    return _ESCAPE.sub(told, token[1:-1])


def decoded(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


class Document:
    """A file's objects; ValueError where it is no PDF, is encrypted or has no catalogue."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF header")
        self.objects: dict[int, tuple[bytes, bytes]] = {}
        packed, at = [], 0
        while m := _OBJECT.search(data, at):
            at = data.find(b"endobj", m.end())
            at = len(data) if at < 0 else at
            head, body = data[m.end() : at], b""
            if s := _STREAM.search(data, m.end(), at):
                head = data[m.end() : s.start()]
                n = _LENGTH.search(head)
                stop = s.end() + int(n[1]) if n else data.find(b"endstream", s.end())
                body = data[s.end() : stop if stop >= 0 else len(data)]
                at = max(s.end(), stop)
            self.objects[int(m[1])] = (head, body)
            if re.search(rb"/Type\s*/ObjStm\b", head):
                packed.append(int(m[1]))
        for number in packed:
            self._unpack(*self.objects[number])
        trailers = re.findall(rb"\btrailer\b(.*?)(?:startxref|\Z)", data, re.S)
        trailers += [head for head, _ in self.objects.values() if re.search(rb"/Type\s*/XRef\b", head)]
        self.trailer = next((t for t in reversed(trailers) if b"/Root" in t), b"")
        if b"/Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")
        if not self.trailer:
            raise ValueError("no catalogue")

    def _unpack(self, head: bytes, body: bytes) -> None:
        count, first = (re.search(rb"/" + k + rb"\s+(\d+)", head) for k in (b"N", b"First"))
        if count and first:
            data, start = self._plain(head, body), int(first[1])
            places = list(map(int, data[:start].split()[: 2 * int(count[1])]))
            ends = [*places[3::2], len(data) - start]
            for number, a, b in zip(places[::2], places[1::2], ends, strict=False):
                self.objects.setdefault(number, (data[start + a : start + b], b""))

    def _plain(self, head: bytes, body: bytes) -> bytes:
        named = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", head)
        for name in re.findall(rb"/(\w+)", named[1]) if named else []:
            if name != b"FlateDecode":
                raise ValueError(f"a stream of {name.decode()}")
            body = zlib.decompressobj().decompress(body)
        return body

    def _named(self, head: bytes, key: bytes) -> list[int]:
        """The objects that a key refers to, by itself or in a list."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R\b)", head)
        return [int(x) for x in _REFERENCE.findall(m[1])] if m else []

    def _head(self, number: int) -> bytes:
        return self.objects.get(number, (b"", b""))[0]

    def page_numbers(self) -> list[int]:
        """The objects of the pages, in order."""
        found: list[int] = []
        seen: set[int] = set()
        waiting = [p for r in self._named(self.trailer, b"Root") for p in self._named(self._head(r), b"Pages")]
        while waiting:
            number = waiting.pop()
            if number in seen:
                continue
            seen.add(number)
            head = self._head(number)
            if b"/Kids" in head:
                waiting += reversed(self._named(head, b"Kids"))
            elif re.search(rb"/Type\s*/Page\b", head):
                found.append(number)
        return found

    def info(self) -> dict[str, str | None]:
        """Title, Author and Subject, null where the file says none."""
        head = b"".join(self._head(x) for x in self._named(self.trailer, b"Info"))
        out = {}
        for key in INFO:
            m = re.search(rb"/" + key.encode() + rb"\s*(" + _STRING + rb")", head, re.S)
            out[key] = decoded(string(m[1])) if m else None
        return out

    def text(self, number: int) -> str:
        contents = self._named(self._head(number), b"Contents")
        return shown(b"\n".join(self._plain(*self.objects[x]) for x in contents if x in self.objects))

    def images(self, number: int) -> int:
        """How many images the page's resources name."""
        head = self._head(number)
        head += b"".join(self._head(x) for x in self._named(head, b"Resources"))
        m = re.search(rb"/XObject\s*<<(.*?)>>", head, re.S)
        return sum(bool(re.search(rb"/Subtype\s*/Image\b", self._head(int(x)))) for x in _REFERENCE.findall(m[1])) if m else 0


def shown(content: bytes) -> str:
    """The text that a page's contents show, a line for each move to another one; ActualText stands for what it spans."""
    out: list[str] = []
    operands: list[bytes] = []
    spans: list[bool] = []
    for token in _TOKEN.findall(content):
        first = token[:1]
        if first in b"(<>[]/" or first.isdigit() or first in b"+-.":
            operands.append(token)
            continue
        strings = [x for x in operands if x[:1] == b"(" or (x[:1] == b"<" and x != b"<<")]
        hidden = any(spans)
        if token in (b"BDC", b"BMC"):
            actual = operands.index(b"/ActualText") + 1 if b"/ActualText" in operands else 0
            if actual and not hidden:
                out.append(decoded(string(operands[actual])))
            spans.append(bool(actual))
        elif token == b"EMC":
            if spans:
                spans.pop()
        elif not hidden:
            if token in (b"T*", b"'", b'"') or (token in (b"Td", b"TD", b"BT") and out and out[-1] != "\n"):
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out.append("".join(decoded(string(x)) for x in strings))
        operands = []
    return "".join(out)


def opened(data: bytes) -> Document | None:
    """A file's document; none of an empty one."""
    return Document(data) if data else None


def pages(data: bytes | Document | None) -> Iterator[tuple[str, int]]:
    """(text, number of images) of each page of a file, in order; none of an empty one."""
    document = opened(data) if isinstance(data, bytes) else data
    if document:
        for number in document.page_numbers():
            yield document.text(number), document.images(number)


def told(data: bytes | Document | None) -> tuple[int, dict[str, str | None]]:
    """The number of pages and the metadata of a file, without a look at its texts."""
    document = opened(data) if isinstance(data, bytes) else data
    return (len(document.page_numbers()), document.info()) if document else (0, dict.fromkeys(INFO))
