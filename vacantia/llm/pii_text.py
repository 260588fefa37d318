"""Windows of a text, and the exact form of each kind of personal information.

The forms are used twice: to label the spans the network is trained on, together with the cues of ``pii_train``, and to
check a span that the network found and to set its borders exactly. They never find anything on their own, and a span
that the network found and no form fits keeps the network's borders.
"""

from __future__ import annotations

import re

URL = re.compile(r"https?://\S+|\bwww\.\S+")
#: What makes a web address worth reading: a sign of an e-mail address, or a key or scheme of a telephone number.
ADDRESSED = re.compile(r"@|%40|tel[:=]|phone=|mobile=", re.I)
#: A window ends at a line end or after the end of a sentence, but not after an initial or a short form.
BREAK = re.compile(r"\n+|(?<=[a-z0-9)]{2}[.!?])(?<! Mr\.)(?<! Ms\.)(?<! Dr\.)(?<! St\.)(?<!Mrs\.)(?<!Tel\.)(?<!ext\.)(?<!Apt\.)(?<! no\.) +(?=[A-Z(\"])")
WIDTH, STRIDE = 192, 128

_AT, _DOT = r"(?: ?@ ?| ?\[at\] ?| ?\(at\) ?)", r"(?:\.| ?\[dot\] ?| ?\(dot\) ?)"
_TOWN = r"(?:\d{4,6} )?(?:(?:Upper|Lower|Mount|Saint|Port|New) )?[A-Z][\w'-]+(?: Harbor)?"
_STREET = r"[A-Z][\w'-]+"
# Words that are no names of persons by themselves, and what stands directly before a company's name.
NO_NAMES = {"limited", "ltd", "inc", "gmbh", "llc", "harbor", "mount", "saint", "upper", "lower", "port", "engineer", "developer", "architect", "manager", "analyst", "designer", "writer", "master", "administrator", "senior", "junior", "lead", "principal", "student", "entry-level", "remote", "link", "apply", "details", "location", "company", "regards", "thanks", "cheers", "best", "mr", "mrs", "ms", "dr", "frau", "herr"}
COMPANY = re.compile(r"(?:@ |Company - |team at )$")
FORMS = {
    "email": re.compile(rf"[\w.+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I),
    "phone": re.compile(r"(?:\+|00)?\(?\d[\d ().-]{5,20}\d(?: ?(?:ext\.?|x) ?\d{1,5})?"),
    "id_number": re.compile(r"\b[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]\b|\b[A-Z]{2}\d{6,8}\b|\b\d{3}-\d{2}-\d{4}\b|\b\d{7,9}-\d\b|\b\d{8,11}\b"),
    "address": re.compile(
        rf"(?:\d+[A-Za-z]? {_STREET} (?:Street|Avenue|Road|Lane|Drive|Boulevard|Way|Square|St\.|Ave\.|Rd\.)(?:, (?:Apt\.|Unit|Suite|Flat) ?\d+[A-Za-z]?)?|\d+[A-Za-z]?,? (?:rue|avenue|boulevard|place) (?:des?|du|de la) {_STREET}|(?:Calle|Avenida|Plaza) {_STREET} \d+(?:, \d+º)?|{_STREET}(?:weg|straße|strasse|gasse|platz|allee) \d+[a-z]?|{_STREET} (?:Road|Street|Avenue) \d+(?:/\d+)?)"
        rf"(?:, {_TOWN})?"
    ),
    "name": re.compile(r"[^\W\d_]+\.?(?:[ ,'’-]{1,2}[^\W\d_]+\.?)*"),
}


def pieces(shaped: str, text: str) -> list[tuple[int, str]]:
    """(start, window) of the stretches of a text, in symbols, without the blanks around and without web addresses, unless
    these hold an e-mail address or a telephone number."""
    out, at = [], 0
    for m in [*(m for m in URL.finditer(text) if not ADDRESSED.search(m[0])), None]:
        end = m.start() if m else len(text)
        if end > at:
            part, low = shaped[at:end], 0
            for b in [*BREAK.finditer(part), None]:
                high = b.start() if b else len(part)
                stretch = part[low:high]
                if stretch and not stretch.isspace():
                    lead = len(stretch) - len(stretch.lstrip())
                    out.append((at + low + lead, stretch.strip()))
                low = b.end() if b else high
        at = m.end() if m else end
    return out


#: What a found span must at least hold where no form fits it: forms of other countries aren't listed.
SHAPE = {
    "email": lambda t: "@" in t and t[-1:].isalnum(),
    "phone": lambda t: sum(c.isdigit() for c in t) >= 6 and not any(c.isalpha() for c in t),
    "id_number": lambda t: sum(c.isdigit() for c in t) >= 6,
    "address": lambda t: any(c.isdigit() for c in t) and sum(c.isalpha() for c in t) >= 5 and " " in t.strip(),
}


def plain_borders(text: str, start: int, end: int) -> tuple[int, int]:
    """Whole words, without the blanks and punctuation around."""
    while start and text[start].isalnum() and text[start - 1].isalnum():
        start -= 1
    while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
        end -= 1
    return start, end


def settle(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The exact borders of a found span, or None where nothing of its kind is there."""
    form = FORMS[kind]
    if kind == "name":
        while start and (text[start - 1].isalpha() or text[start - 1] in "-'" and start > 1 and text[start - 2].isalpha()):
            start -= 1
        while end < len(text) and (text[end].isalpha() or text[end] in "-'" and end + 1 < len(text) and text[end + 1].isalpha()):
            end += 1
        while start < end and not text[start].isalpha():
            start += 1
        while end > start and not text[end - 1].isalpha():
            end -= 1
        words = text[start:end].casefold().split()
        if end - start < 2 or any(c.isdigit() for c in text[start:end]) or all(w in NO_NAMES for w in words) or COMPANY.search(text, max(0, start - 12), start):
            return None
        return start, end
    line, stop = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    stop = len(text) if stop < 0 else stop
    reach = 24
    while True:
        low, high = max(line, start - reach), min(stop, end + reach)
        while low > line and (text[low - 1].isalnum() or text[low - 1] in "._+@-"):
            low -= 1
        while high < stop and (text[high].isalnum() or text[high] in "._+@-"):
            high += 1
        best = None
        for m in form.finditer(text, low, high):
            overlap = min(m.end(), end) - max(m.start(), start)
            if overlap > 0 and (best is None or overlap > best[0]):
                best = (overlap, m.start(), m.end())
        # A form that goes on beyond what was looked at is looked at again, as far as the line goes.
        if best is None or (best[1] > low or low == line) and (best[2] < high or high == stop):
            break
        reach *= 4
    if best is None:
        return plain_borders(text, start, end) if SHAPE[kind](text[start:end]) else None
    if 2 * best[0] < min(end - start, best[2] - best[1]):
        return None
    return best[1], best[2]
