"""The own sentences of an e-mail given as raw text: decoded bodies without quotes, forwards, signatures, disclaimers or attachments."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
import unicodedata

# How mail programs write attributions, forward marks, greetings and legal notices.
_QUOTED = re.compile(r"^\s*[^\W\d_]{0,3}\s?[>|]")
_WROTE = re.compile(r"\b(wrote|writes|escribi\S{1,3}|escribe|schrieb\b.*|schreibt\b.*)\s*:\s*$", re.I)
_MARK = re.compile(r"^\s*-{2,}\s*(original message|forwarded message|mensaje original|mensaje reenviado|urspr\S{1,3}ngliche nachricht|weitergeleitete nachricht|begin forwarded message)\s*:?\s*-*\s*$", re.I)
_FIELD = re.compile(r"^\s*(from|to|cc|sent|date|subject|von|an|gesendet|betreff|datum|de|para|enviado|fecha|asunto)\s*:", re.I)
_GREET = re.compile(r"^\s*((dear|hello|hi|hey|hola|buenas|buenos|estimad\w*|querid\w*|guten|hallo|liebe\w*|sehr geehrte\w*)\b[^.!?]{0,40}[,:]?|\w+ -)\s*$", re.I)
_RULE = re.compile(r"^\s*([-_*=]{3,})\s*$")
_RULES = ("---", "***", "___", "===")
_SENDER = re.compile(r"^\s*(from|von|de)\s*:", re.I)
_LEGAL = ("confidential", "unauthorised use", "unauthorized use", "not the addressee", "consider the trees", "liability for", "aviso legal", "confidencial", "privilegiada", "divulgaci", "destinatario, b", "vertraulich", "per e-mail nicht", "haftung ist", "gesetzlich gesch")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(¿¡]?[^\W\d_a-zà-ÿ]|[¿¡\"'(])")
_TAGS = ((re.compile(r"<(blockquote|script|style|head)\b.*?</\1\s*>", re.I | re.S), "\n"), (re.compile(r"<br\s*/?>\s*\n?|</(p|div|tr|li|h\d)\s*>", re.I), "\n"), (re.compile(r"<[^>]*>"), ""))


def fold(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))


def _legal(line: str) -> bool:
    low = line.lower()
    return any(x in low for x in _LEGAL)


def headers(block: str) -> dict[str, str]:
    """Header fields by lower-case name, unfolded; the first of a name counts."""
    out: dict[str, str] = {}
    name = ""
    for line in block.split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            a, sep, b = line.partition(":")
            name = a.strip().lower() if sep and a and " " not in a.strip() else ""
            if name in out:
                name = ""
            elif name:
                out[name] = b.strip()
    return out


def _parameter(value: str, name: str) -> str:
    m = re.search(rf'\b{name}\s*=\s*(?:"([^"]*)"|([^\s;]+))', value, re.I)
    return (m[1] if m[1] is not None else m[2]) if m else ""


def _decode(body: str, how: str, charset: str) -> str:
    """The body as text; encodings and charsets that lie fall back to what can be read."""
    if how == "base64":
        clean = re.sub(r"[^A-Za-z0-9+/]", "", body)
        try:
            raw = base64.b64decode(clean[: len(clean) // 4 * 4] if len(clean) % 4 == 1 else clean + "=" * (-len(clean) % 4))
        except (binascii.Error, ValueError):
            return ""
    elif how == "quoted-printable":
        raw = quopri.decodestring(body.encode("utf-8", "replace"))
    else:
        return body
    for name in ("utf-8", charset, "cp1252"):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1")


def bodies(block: str, depth: int = 0) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """The headers of a message or part and its readable leaves, (kind, text)."""
    head, sep, body = block.lstrip("\n").partition("\n\n") if depth == 0 or not block.startswith("\n") else ("", "", block[1:])
    if depth == 0 and head.startswith("From "):  # a mailbox's separator
        head = head.partition("\n")[2]
    first = head.split("\n", 1)[0]
    if depth == 0 and not re.match(r"[!-9;-~]+\s*:", first):
        head, body = "", block  # no headers: plain text
    h = headers(head)
    kind = h.get("content-type", "text/plain").lower()
    if h.get("content-disposition", "").lower().startswith("attachment") or kind.startswith("message/"):
        return h, []
    if kind.startswith("multipart/") and depth < 8:
        mark = "--" + _parameter(h["content-type"], "boundary")
        if mark != "--":
            parts: list[list[str]] = []
            for line in body.split("\n"):
                if line.rstrip() == mark:
                    parts.append([])
                elif line.rstrip() == mark + "--":
                    break
                elif parts:
                    parts[-1].append(line)
            leaves = [bodies("\n".join(p) if p else "", depth + 1)[1] for p in parts]
            if kind.startswith("multipart/alternative"):
                plain = [x for x in leaves if any(k == "plain" and t.strip() for k, t in x)]
                return h, (plain or [x for x in leaves if x] or [[]])[0]
            return h, [leaf for x in leaves for leaf in x]
    if not kind.startswith("text/") or _parameter(kind, "name"):
        return h, []
    text = _decode(body, h.get("content-transfer-encoding", "").strip().lower(), _parameter(kind, "charset") or "utf-8").replace("\r\n", "\n").replace("\r", "\n")
    if kind.startswith("text/html"):
        for pattern, by in _TAGS:
            text = pattern.sub(by, text)
        return h, [("html", html.unescape(text))]
    return h, [("plain", text)]


def _first_name(address: str) -> str:
    """Of a From field the given name, folded; of a bare address what it begins with."""
    name = address.split("<")[0].strip().strip('"')
    m = re.search(r"([^\s<@]+)@", address)
    if m:
        return fold(m[1].split(".")[0])
    if "," in name:
        name = name.split(",", 1)[1].strip()
    return fold(name.split()[0]) if name.split() else ""


def _paragraphs(text: str) -> list[tuple[list[str], int]]:
    """Runs of lines that aren't blank, each with the number of blank lines before it."""
    out: list[tuple[list[str], int]] = []
    gap, fresh = 0, True
    for line in text.split("\n"):
        if not line.strip():
            gap, fresh = gap + 1, True
        elif fresh:
            out.append(([line], gap))
            gap, fresh = 0, False
        else:
            out[-1][0].append(line)
    return out


def _own_lines(lines: list[str]) -> list[str]:
    """The lines that aren't quotes, attributions or a rule.

    A line without a prefix is a quote's, too, if a quoted one follows in its paragraph, or the one before it
    breaks off within a sentence."""
    quoted = [(">" in x or "|" in x) and bool(_QUOTED.match(x)) for x in lines]
    last = max((i for i, q in enumerate(quoted) if q), default=-1)
    out = []
    for i, x in enumerate(lines):
        if i <= last and (quoted[i] or any(quoted[:i])):
            continue
        if last >= 0 and i == last + 1 and lines[last].rstrip()[-1:] not in (".", "?", "!", ":", ">", "|"):
            last = i
            continue
        if x.rstrip().endswith(":") and _WROTE.search(x):
            continue
        if not out and x.lstrip()[:3] in _RULES and _RULE.match(x):
            continue
        out.append(x.strip())
    return out


def _signs(lines: list[str], name: str) -> bool:
    return bool(name) and any(len(x) <= len(name) + 4 and fold(x).strip().rstrip(",.") == name for x in lines)


def own_paragraphs(text: str, author: str = "") -> list[str]:
    """The paragraphs of a body that its author wrote in this message, each in one line.

    Lines with a quote's prefix and the attributions before them go, as do legal notices and whatever follows
    the author's sign-off or `-- `. A forward that begins with a mark and fields lasts to the end if the author
    has written and doesn't sign later; else to the sign-off of the person it is from, to two blank lines, to
    another greeting, or over one paragraph, the first of these that there is."""
    blocks = _paragraphs(text)
    out: list[str] = []
    signed, k = False, 0
    while k < len(blocks):
        lines, _ = blocks[k]
        k += 1
        mark = next((i for i, x in enumerate(lines) if "--" in x and _MARK.match(x)), None)
        kept = _own_lines(lines if mark is None else lines[:mark])
        if kept and not _legal(" ".join(kept)):
            end = next((i for i, x in enumerate(kept) if x == "--"), None)
            signed = signed or end is not None or _signs(kept, author)
            if kept[:end]:
                out.append(" ".join(kept[:end]))
        if signed:
            break
        if mark is None:
            continue
        fields = [x for x in lines[mark + 1 :] if _FIELD.match(x)]
        sender = next((_first_name(x.split(":", 1)[1]) for x in fields if _SENDER.match(x)), "")
        wrote = any(not _GREET.match(x) for x in out)
        later = [_own_lines(x) for x, _ in blocks[k:]]
        mine = [i for i, x in enumerate(later) if _signs(x, author)]
        if wrote and not mine:
            break
        theirs = [i for i, x in enumerate(later) if sender != author and _signs(x, sender) and (not mine or i < mine[-1])]
        if theirs:
            k += theirs[0] + 1
            continue
        first = 1 if len(fields) == len(lines) - mark - 1 else 0  # of the forward, one paragraph at least
        turns = [i for i in range(first, len(later)) if later[i] and (blocks[k + i][1] >= 2 or (len(later[i]) == 1 and _GREET.match(later[i][0])))]
        start = first + (first < len(later) and len(later[0]) == 1 and bool(_GREET.match(later[0][0])))
        k += turns[0] if turns else start
    return out


def own_sentences(raw: str) -> list[str]:
    """The sentences of a raw message's own text."""
    h, leaves = bodies(raw.replace("\r\n", "\n").replace("\r", "\n"))
    author = _first_name(h.get("from", ""))
    return [s for _, text in leaves for p in own_paragraphs(text, author) for s in _SENTENCE.split(p) if s]
