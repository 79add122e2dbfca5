"""Paragraphs of the bodies of e-mail messages and bare texts.

A message's body is its decoded plain text part (its HTML part where it has no
plain one); a text without headers is all body. Lines are joined to paragraphs
per quotation level; separators, forwarded headers, contacts and
lines that are not prose (logs, tables) belong to none.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

# Header names by which a leading block is known to be a message's header.
HEADERS = (
    "from", "to", "cc", "bcc", "subject", "date", "sent", "received", "message-id", "in-reply-to", "references", "reply-to",
    "return-path", "mime-version", "content-type", "content-transfer-encoding", "content-disposition", "x-mailer", "sender", "user-agent",
)

_HEADER = re.compile(r"([A-Za-z][A-Za-z0-9-]*):(?:[ \t]|$)")
_QUOTE = re.compile(r"[ \t]*((?:[>|][ \t]?)+)")
_BOUNDARY = re.compile(r"boundary\s*=\s*\"?([^\";\s]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)
_TAG = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>", re.I | re.S)
_BREAK = re.compile(r"</p>|<br\s*/?>|</div>", re.I)
_ASIDE = re.compile(r"\([^()]*\d[^()]*\)")
_END = re.compile(r"[.!?。！？](?=[^\s0-9A-Za-zÀ-ɏ가-힣]{0,4}(?:\s+(?![\d+])|$))")
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_CONTACT = re.compile(r"@|://|\d{4}")
_RULE = re.compile(r"[\W_]*$")
_FORWARD = re.compile(r"-{3,}.*-{3,}$|_{4,}")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")

_CP1252 = {ord(bytes([b]).decode("cp1252", "replace")): b for b in range(0x80, 0xA0)}


def repaired(text: str) -> str:
    """Text that was UTF-8 but read as a one-byte charset is read again; other text stays."""
    if not _MOJIBAKE.search(text):
        return text

    def again(m: re.Match) -> str:
        try:
            return bytes(_CP1252.get(ord(c), ord(c)) for c in m[0]).decode("utf-8")
        except (ValueError, UnicodeDecodeError):
            return m[0]

    return re.sub("[\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]+", again, text)


def _split_header(text: str) -> tuple[dict[str, str] | None, str]:
    """Header fields, unfolded, and the rest; None if the text doesn't start with a header."""
    fields: dict[str, str] = {}
    name, at = "", 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if not line.strip():
            at = end + 1
            break
        if line[0] in " \t" and name:
            fields[name] += " " + line.strip()
        elif m := _HEADER.match(line):
            name = m[1].lower()
            fields.setdefault(name, "")
            fields[name] = line[m.end() :].strip()
        elif not (at == 0 and line.startswith("From ")):
            return None, text
        at = end + 1
    known = sum(f in HEADERS for f in fields)
    return (fields, text[at:]) if known and known * 2 >= len(fields) else (None, text)


def _decoded(body: str, fields: dict[str, str]) -> str:
    how = fields.get("content-transfer-encoding", "").lower()
    if "base64" in how:
        # Padding may end a piece in the middle, where encoded pieces were strung together.
        pieces = [re.sub(r"[^A-Za-z0-9+/]", "", p) for p in body.split("=")]
        pieces = [p[: len(p) - (len(p) % 4 == 1)] for p in pieces]
        try:
            data = b"".join(base64.b64decode(p + "=" * (-len(p) % 4)) for p in pieces)
        except (binascii.Error, ValueError):
            return body
    elif "quoted-printable" in how:
        data = quopri.decodestring(body.encode("utf-8", "replace"))
    else:
        return body
    charset = m[1] if (m := _CHARSET.search(fields.get("content-type", ""))) else "latin-1"
    for name in ("utf-8", charset):
        try:
            return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return data.decode("latin-1")


def _parts(text: str, boundary: str) -> list[str]:
    mark = "--" + boundary
    out, at = [], text.find(mark) if text.startswith(mark) else text.find("\n" + mark) + 1
    if at == 0 and not text.startswith(mark):
        return [text]
    while True:
        line = text.find("\n", at)
        if line < 0 or text.startswith("--", at + len(mark)):
            return out
        end = text.find("\n" + mark, line)
        out.append(text[line + 1 : end if end >= 0 else len(text)])
        if end < 0:
            return out
        at = end + 1


def body(text: str) -> str:
    """The decoded body of a message, or the whole of a bare text."""
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    fields, rest = _split_header(text.lstrip("﻿\n"))
    if fields is None:
        return text
    plain, rich = _texts(fields, rest)
    return "\n\n".join(plain or rich)


def _texts(fields: dict[str, str], rest: str) -> tuple[list[str], list[str]]:
    """Plain and HTML texts in their order, however deep multiparts are nested."""
    plain: list[str] = []
    rich: list[str] = []
    todo = [(fields, rest)]
    while todo:
        fields, rest = todo.pop()
        kind = fields.get("content-type", "text/plain").lower()
        if kind.startswith("multipart/") and (m := _BOUNDARY.search(fields["content-type"])) and (found := _parts(rest, m[1])) != [rest]:
            split = [({}, part[1:]) if part.startswith("\n") else _split_header(part) for part in found]
            todo += [(own or {}, inner) for own, inner in reversed(split)]
            continue
        if "attachment" in fields.get("content-disposition", "").lower() or not kind.startswith(("text/", "multipart/")):
            continue
        decoded = _decoded(rest, fields).replace("\r\n", "\n").replace("\r", "\n")
        if kind.startswith("text/html"):
            rich.append(html.unescape(_TAG.sub(" ", _BREAK.sub("\n\n", decoded))))
        else:
            plain.append(decoded)
    return plain, rich


def _prose(line: str) -> bool:
    letters = sum(map(len, _LETTER_RUN.findall(line)))
    return letters * 2 > len(line.replace(" ", ""))


def paragraphs(text: str) -> list[str]:
    """Paragraphs of prose of a message's body, lines joined by a blank."""
    out: list[str] = []
    held: list[str] = []
    level = ""

    def close() -> None:
        if held:
            joined = " ".join(held)
            if _prose(joined) and not (_CONTACT.search(joined) and not _END.search(joined)):
                out.append(repaired(joined))
            held.clear()

    for line in body(text).split("\n"):
        quote = ""
        if m := _QUOTE.match(line):
            quote = m[1].replace(" ", "").replace("\t", "")
            line = line[m.end() :]
        line = line.strip()
        if quote != level or not line or _RULE.match(line):
            close()
            level = quote
            if not line or _RULE.match(line):
                continue
        if _FORWARD.match(line) or ((m := _HEADER.match(line)) and m[1].lower() in HEADERS):
            close()
            continue
        held.append(line)
    close()
    return out


def sentences(paragraph: str) -> int:
    """Number of sentences of at least two words; asides and stops before a number end none."""
    plain = _ASIDE.sub(" ", paragraph)
    at = n = 0
    for m in _END.finditer(plain):
        n += len(_LETTER_RUN.findall(plain, at, m.end())) > 1
        at = m.end()
    return n
