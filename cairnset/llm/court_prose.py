"""The prose of a ruling: the sentences of its paragraphs, without front matter, headnotes, page headers, citations,
lists and closing orders. Plain functions on one text, for use inside tasks; whole texts are read."""

from __future__ import annotations

import re

#: Frequent words that tell the languages apart.
MARKERS = {"en": (" the ", " of ", " and ", " was ", " that ", " to "), "de": (" der ", " die ", " und ", " das ", " nicht ", " den "), "fr": (" le ", " la ", " les ", " des ", " une ", " que ")}
#: Words that open a dependent clause or phrase.
SUBORDINATORS = frozenset("after although as because before if inasmuch insofar irrespective notwithstanding once provided since so subject than that though unless until when where whereas whether which while who whom whose without".split())

#: Blanks other than the space, and invisible characters; signs that end a word.
_BLANKS = {ord(c): " " for c in "\t\x0b\x0c\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"} | {ord(c): "\n" for c in "\r\x85\u2028\u2029"} | {ord(c): None for c in "\u200b\u200c\u200d\u2060\ufeff\xad"}
_ODD = re.compile("[" + "".join(map(chr, _BLANKS)) + "]")
_SIGNS = ',.;:!?"()[]'
_HEAD_END = re.compile(r"(?i)^(?:decided|judgment of|judgment delivered|date of (?:decision|judgment|hearing)|handed down|delivered on)\b")
_PAGE = re.compile(r"(?i)\b(?:page|sheet|folio|p\.)\s*\d+\b|\b[A-Z]{2,4}\s+\d+(?:-\d+)?/\d{4}\b.{0,20}$|^\W*\d{1,4}\W*$")
_DIGIT = re.compile(r"\d")
_ITEM = re.compile(r"^(?:\([a-z]{1,4}\)|[-•*–]|\([ivx]+\))\s")
_NUMBER = re.compile(r"^(?:¶\s*\d+|§+\s*\d+|\[\d+\]|\(\d+\)|\d+[.)])\s+")
_ORDER = re.compile(r"(?i)^order\s*:")
_PAREN = re.compile(r"\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)")
_CITE = re.compile(r" (?:see(?: also)?|cf\.|compare) (?=(?:[A-Z\[█_*]|s\.|ss\.|paras?\.|art\.))")
_STOP = re.compile(r"\.(?=\s+[A-Z\[█_*\"“]|\s*$)|;")
#: Titles and short forms that a stop follows within a sentence, and what may follow the stop of an abbreviation: a number
#: or another abbreviation.
_SHORT = re.compile(r"(?:\b(?:v|Mr|Ms|Mrs|Dr|No|Nos|s|ss|para|paras|art))\Z")
_ABBREVIATION = re.compile(r"(?:^|[\s(.])[A-Z][a-z]{0,4}\Z")
_GOES_ON = re.compile(r"\.\s+(?:\d|[A-Z][A-Za-z]{0,4}\.)")
_SPEAKER = re.compile(r"^(?:As to [^:.]{1,60}|[^:.,]{1,40}|(?:Mr|Ms|Mrs|Dr)\.? [^:]{1,40}?|[^:]{1,60}, through counsel)\s*:\s*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[\"“\[█_*¶]*[A-Z█_*\[])")


def plain(text: str) -> str:
    """The text with ordinary blanks and line breaks, and without invisible characters."""
    text = text.replace("\r\n", "\n")
    return text.translate(_BLANKS) if _ODD.search(text) else text


def language(text: str) -> str:
    """``en``, ``de`` or ``fr`` by frequent words between blanks; empty if there are none."""
    for form in (str, plain):
        t = form(text)
        found = {lang: sum(map(t.count, words)) for lang, words in MARKERS.items()}
        best = max(found, key=found.get)
        if found[best]:
            return best
    return ""


def _citation_end(text: str, at: int) -> re.Match | None:
    """The first stop or semicolon that is not an abbreviation's: short capitalised words before a number or another such
    word, and titles."""
    for end in _STOP.finditer(text, at):
        before = text[max(0, end.start() - 12) : end.start()]
        if end[0] == ";" or not (_SHORT.search(before) or (_ABBREVIATION.search(before) and _GOES_ON.match(text, end.start()))):
            return end
    return None


def without_citations(text: str) -> str:
    """The text with each citation, from its opening word to the end of its sentence or part, taken out."""
    out, at = [], 0
    for m in _CITE.finditer(text):
        if m.start() >= at:
            end = _citation_end(text, m.end())
            out += [text[at : m.start()].rstrip(" ;,"), "."]
            at = end.end() - (end[0] == ";") if end else len(text)
    return "".join([*out, text[at:]]) if at else text


def body_text(text: str) -> str:
    """The running text of the paragraphs."""
    lines, gaps, gap = [], [], 0
    for raw in plain(text).split("\n"):
        line = raw.strip(" ")
        if line:
            lines.append(line)
            gaps.append(gap)
            gap = 0
        else:
            gap += 1
    if not lines:
        return ""
    if sum(g > 0 for g in gaps[1:8]) >= 0.6 * max(1, len(gaps[1:8])):  # every line break was doubled
        gaps = [max(0, (g - 1) // 2) for g in gaps]
    # front matter: to the line of the date, else to the first gap
    at = next((i + 1 for i, line in enumerate(lines[:14]) if _HEAD_END.match(line)), 0) or next((i for i in range(1, len(lines)) if gaps[i] and i >= 3), 0)
    if at < len(lines) and lines[at].upper().strip(" :") in ("HEADNOTE", "HEADNOTES", "SUMMARY", "CATCHWORDS"):
        at += 1
        while at < len(lines) and not (gaps[at] or _NUMBER.match(lines[at])):
            at += 1
    body, body_gaps = lines[at:], gaps[at:]
    # closing orders: the last block, if short, and what follows a line that begins with "Order:"
    end = next((i for i, line in enumerate(body) if _ORDER.match(line)), len(body))
    block = end
    while block > 0 and end - block < 3 and len(body[block - 1]) < 90 and not _NUMBER.match(body[block - 1]) and not (block < len(body) and block < end and body_gaps[block]):
        block -= 1
        if body_gaps[block]:
            break
    if block < end and block > 0 and body_gaps[block]:
        end = block
    parts: list[str] = []
    for line in body[:end]:
        if len(line) < 90 and line[-1] != "." and _DIGIT.search(line) and _PAGE.search(line):
            continue
        if _ITEM.match(line):
            continue
        line = _NUMBER.sub("", line)
        if parts and parts[-1].endswith("-") and line[:1].islower():
            parts[-1] = parts[-1][:-1] + line
        else:
            parts.append(line)
    return " ".join(parts)


def sentences(text: str) -> list[tuple[list[str], int]]:
    """Words in lower case, and the number of commas, semicolons and clause openers, of each sentence of the prose."""
    return _sentences(body_text(text))


def english_prose(text: str) -> tuple[str, list[tuple[list[str], int]]]:
    """Language of the paragraphs, and their sentences if it is English."""
    body = body_text(text)
    lang = language(body)
    return lang, _sentences(body) if lang == "en" else []


def _sentences(body: str) -> list[tuple[list[str], int]]:
    parts = [_SPEAKER.sub("", s, 1) if ":" in s else s for s in _SENTENCE.split(without_citations(_PAREN.sub("", body)))]
    flat, out, opener = "\n".join(parts).lower(), [], SUBORDINATORS.__contains__
    for sign in _SIGNS:
        flat = flat.replace(sign, " ")
    for s, line in zip(parts, flat.split("\n")):
        words = [w for w in line.split() if w[0].isalpha()] if _DIGIT.search(line) else line.split()
        if len(words) >= 3:
            out.append((words, s.count(",") + s.count(";") + sum(map(opener, words))))
    return out


def quantile(values: list[float], q: float) -> float:
    """Of sorted values, linear between neighbours."""
    at = q * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


__all__ = ["body_text", "english_prose", "language", "quantile", "sentences"]
