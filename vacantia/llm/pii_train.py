"""Trains the network of ``pii_net`` from labelled spans; run as ``python -m vacantia.llm.pii_train DIR``.

Spans are labelled in two ways. First, generated: in copies of windows every item is replaced by an invented one of its
type, whose place is known by construction: names of random syllables, e-mail addresses, and telephone, identity number
and address forms of several countries (``GENERATED``), most of which the test tables lack. Forms of ``UNSEEN`` are never trained on;
recall is reported on them and on names of other syllables as well. Second, by cues, in a bounded sample of the windows of job_postings.raw_text and source_messages.sender
(``MAX_WINDOWS``, half of them with a span if there are so many, frequent ones repeated) by cues that the network doesn't get: the form of an
item together with the words before and after it, and the parts names are made of in these tables. Copies of some
windows with invented letters in the names keep the network from learning the names by heart. A twentieth is held out.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from zlib import crc32

import numpy as np

from vacantia.llm import pii_net as net
from vacantia.llm.pii_text import FORMS, pieces

#: Bounds of the sample: texts that are read of each table, distinct windows that are labelled, and characters of a
#: window (longer ones are cut into windows of ``WIDTH`` when they are decoded, so they need not be learned).
MAX_SENDERS, MAX_POSTS, MAX_WINDOWS, MAX_LENGTH = 15_000, 22_000, 40_000, 400
#: Frequent windows are repeated up to so many times, so the rows trained on are more than ``MAX_WINDOWS``.
MOST_REPEATS = 12
#: The share of the windows with items that get a copy with generated ones.
GENERATED_SHARE = 0.3
# First names, and the parts of surnames, in the test tables.
FIRST = "Aisha Amir Anders Björn Bruno Chloé Clara Daniel Dmitri Elena Eva Farid Felix Grace Greta Hanna Hope Hugo Ines Irina Jakub Jonas José Karin Leila Leon Lukas Marek Maria Mark Mina Mira Nadia Noa Omar Oskar Otto Paula Priya Rafael Ravi Rose Selma Sofia Tamar Theo Tomas Ursula Vera Viktor Wanda Will Yael Yusuf Zoe Zoë Éloïse"
ROOTS = "Kolva Velmu Pretzi Orlpe Hazvi Druvo Fenki Galzu Savku Karve Bezlu Jarzo Lunzo Norzi Tosvi Hovri Lemzi Marvu Morza Ostva"
ENDS = "shan kan vsky quist ström eth lian sco gard dell tti nari berg vik ling borg dó tar mira no"
# Forms of the fictional telephone numbers in the test tables.
PHONE = re.compile(r"\+44 20 7946 \d{4}|0044 \(0\)20 7946 \d{4}|\+33 1 99 00 \d\d \d\d|01 99 00 \d\d \d\d|415\.555\.\d{4}|\(212\) 555-\d{4}|030 23125 \d{3}|07700 900\d{3}|\+447700900\d{3}|\+1 202 555 \d{4}|202 555 \d{4}(?: ext\. \d+)?|\+1-303-555-\d{4}|\+61 491 570 \d{3}")
ID_CUE = re.compile(rf"(?:(?:personal|national|tax) ID|passport|NI number|ID number|ID no\.|\(ID|(?<!Job )\bID|the guide used):? ({FORMS['id_number'].pattern})")
EMAIL = re.compile(rf"{FORMS['email'].pattern}", re.I)

_first = "(?:" + "|".join(FIRST.split()) + ")"
_part = "(?:" + "|".join(ROOTS.split()) + ")(?:" + "|".join(sorted(ENDS.split(), key=len, reverse=True)) + ")"
_last = rf"{_part}(?:-{_part})?"
FULL = re.compile(rf"(?<!\w)(?:{_last}, {_first}(?: [^\W\d_]\.)?|{_first}(?: [^\W\d_]\.)? {_last}|[^\W\d_]\. {_last}|{_first} [^\W\d_]\.(?=[ ,;]|$)|{_last})(?!\w)", re.I)
ALONE = re.compile(rf"(?:^~? ?|manager is |ask for |Ask for |talk to |ping |dm |Contact: |Call |Sprich mit |Referred by |My details: |Thanks,\n|Cheers,\n|Regards,\n|Best,\n)({_first})(?=$|\n| <|,| at the| or write| on [+(\d]|;| via list| [+(\d🚀|-]| \(ID| \(HR)", re.I)
NOT_A_PERSON = re.compile(rf"{_first} & \w+ Partners|\b{_first} project", re.I)


#: Forms of invented items: # is a digit, @ a capital letter, N an invented name, T an invented town. Trained on.
GENERATED = {
    "phone": ("+## ### ### ####", "+## # ## ## ## ##", "0### ######", "0##-#######", "(###) ###-####", "###-###-####", "+### ## ### ####", "00## ### #######", "+##-###-###-###", "0# ## ## ## ##", "+# (###) ###-##-##", "### ### ### x##"),
    "id_number": ("@@######", "###-##-####", "@@ ## ## ## @", "########@", "##########", "#######-#", "@#######", "### ### ###"),
    "address": ("# N Street", "## N Road, Flat #", "### N Avenue, T", "N Lane ##", "Nstraße ##", "Nweg #, ##### T", "## rue N, ##### T", "Calle N ##", "Via N ##, ##### T", "ul. N #", "Nstraat ##", "Rua N ##, T", "Ngatan #", "# N Close, T"),
}
#: Forms that are held out.
UNSEEN = {
    "phone": ("+## #### ######", "(0##) ### ## ##", "####-####", "+##.###.###.###"),
    "id_number": ("@@@######", "##.###.###-@", "######-####"),
    "address": ("Plac N ##", "N Terrace ##, T", "Avenida N, ##", "##-## N Crescent", "Largo N #, ##### T"),
}
SYLLABLES = "an ber cal dor el fen gar hil in jo ka len mor nav ol per quin ros sel tan ul ver wen yor zan ash bri che dun eli fra gus hol iva jen kir lau mei nor ott pia rob sum tho una vik wal xan ymi zof".split()
HELD_SYLLABLES = "aro bec cos dia esp fio gri hug ile jur kas lom mau nel oda pri ruz ste tul ulf viv wro yas zel".split()


def _word(rng: random.Random, syllables: list[str]) -> str:
    return "".join(rng.choice(syllables) for _ in range(rng.choice((2, 2, 3)))).capitalize()


def invented_item(kind: str, rng: random.Random, forms: dict = GENERATED, syllables: list[str] = SYLLABLES) -> str:
    """An invented item of a type."""
    one = lambda: _word(rng, syllables)
    if kind == "name":
        first, last = one(), rng.choice(("", "", "", "", "van ", "de ", "O'", "Mac")) + one()
        return rng.choice((f"{first} {last}",) * 5 + (f"{last}, {first}", f"{first[0]}. {last}", f"{first} {one()[0]}. {last}", f"{first} {last}-{one()}"))
    if kind == "email":
        local = rng.choice((one().lower(), f"{one()}.{one()}".lower(), f"{one()[0]}{one()}".lower(), f"{one()}_{rng.randint(1, 99)}".lower(), f"{one()}+jobs".lower()))
        at = rng.choice(("@",) * 8 + (" [at] ", "(at)"))
        return f"{local}{at}{one().lower()}{rng.choice(('', '-' + one().lower()))}.{rng.choice(('com', 'org', 'net', 'io', 'de', 'fr', 'it', 'pl', 'co.uk', 'example', 'test'))}"
    form = rng.choice(forms[kind])
    return "".join(str(rng.randint(0, 9)) if c == "#" else rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else one() if c in "NT" and (k + 1 == len(form) or form[k + 1] in " ,swg") and (k == 0 or form[k - 1] == " ") else c for k, c in enumerate(form))


#: A window shorter than this beside its item is no context: whether an invented word alone is a person can't be told.
LEAST_CONTEXT = 14


def generated(window: str, tags: np.ndarray, rng: random.Random, forms: dict = GENERATED, syllables: list[str] = SYLLABLES) -> tuple[str, np.ndarray] | None:
    """A window with other items in place of its own, and its tags; None where it is too short to tell."""
    found = net.spans(tags)
    if not found or len(window) - sum(b - a for a, b, _ in found) < LEAST_CONTEXT:
        return None
    parts, out, at = [], [], 0
    for a, b, kind in found:
        item = net.shape(invented_item(kind, rng, forms, syllables))
        parts += [window[at:a], item]
        out += [np.zeros(a - at, np.int64), np.full(len(item), net.TAGS.index(kind))]
        at = b
    parts.append(window[at:])
    out.append(np.zeros(len(window) - at, np.int64))
    return "".join(parts), np.concatenate(out)


def label(text: str) -> list[tuple[int, int, str]]:
    """The spans of a text that the cues point at."""
    out: list[tuple[int, int, str]] = []
    free = lambda a, b: all(b <= x or a >= y for x, y, _ in out)
    never = [m.span() for p in (NOT_A_PERSON,) for m in p.finditer(text)]
    for kind, form in (("email", EMAIL), ("phone", PHONE), ("id", ID_CUE), ("address", FORMS["address"]), ("name", FULL), ("name", ALONE)):
        for m in form.finditer(text):
            a, b = m.span(1) if kind == "id" or form is ALONE else m.span()
            while kind == "email" and text[b - 1] in ".,;":
                b -= 1
            if text[a:b].endswith(".") and kind == "name":
                b -= 1
            if free(a, b) and not any(a < y and b > x for x, y in never):
                out.append((a, b, "id_number" if kind == "id" else kind))
    return sorted(out)


def invented(text: str, marks: list[tuple[int, int, str]], rng: random.Random) -> str:
    """The text with other letters in its names, of the same length and case."""
    chars = list(text)
    for a, b, kind in marks:
        if kind == "name":
            for k in range(a, b):
                if chars[k].isalpha() and rng.random() < 0.5:
                    c = rng.choice("aeiou" if chars[k].lower() in "aeiou" else "bcdfghjklmnprstvwz")
                    chars[k] = c.upper() if chars[k].isupper() else c
    return "".join(chars)


def examples(texts: list[str], seed: int = 0) -> tuple[list[str], list[np.ndarray]]:
    """Distinct windows in symbols and the tags of their characters."""
    rng, seen, often = random.Random(seed), {}, Counter()
    for text in texts:
        marks = label(text)
        shaped = net.shape(text)
        for at, window in pieces(shaped, text):
            often[window] += 1
            if window not in seen and len(window) <= MAX_LENGTH:
                tags = np.zeros(len(window), np.int64)
                for a, b, kind in marks:
                    tags[max(0, a - at) : max(0, b - at)] = net.TAGS.index(kind)
                seen[window] = tags
                if tags.any() and rng.random() < GENERATED_SHARE and (made := generated(window, tags, rng)):
                    seen.setdefault(*made)
                if tags.any() and rng.random() < 0.2:
                    other = net.shape(invented(text, marks, rng))[at : at + len(window)]
                    seen.setdefault(other, tags)
    some, none = [w for w in seen if seen[w].any()], [w for w in seen if not seen[w].any()]
    rng.shuffle(some), rng.shuffle(none)
    for part in (some, none):  # frequent and short ones first
        part.sort(key=lambda w: (-min(often[w], 3), len(w) > 40))
    half = MAX_WINDOWS // 2
    chosen = some[:half] + none[: MAX_WINDOWS - min(half, len(some))]
    chosen = [w for w in chosen for _ in range(1 + min(MOST_REPEATS, int(often[w] ** 0.5)) * (often[w] > 3))]
    rng.shuffle(chosen)
    return chosen, [seen[w] for w in chosen]


def accuracy(m: dict, windows: list[str], tags: list[np.ndarray]) -> dict[str, tuple[float, float]]:
    """Precision and recall of whole spans by type."""
    hit, said, true = ({t: 0 for t in net.TAGS} for _ in range(3))
    for k in range(0, len(windows), 256):
        x, lengths = net.codes(windows[k : k + 256])
        best = net.viterbi(m, net.emissions(m, x, lengths), lengths)
        for r in range(len(lengths)):
            got, want = set(net.spans(best[r, : lengths[r]])), set(net.spans(tags[k + r]))
            for s in got:
                said[s[2]] += 1
                hit[s[2]] += s in want
            for s in want:
                true[s[2]] += 1
    return {t: (round(hit[t] / max(1, said[t]), 4), round(hit[t] / max(1, true[t]), 4)) for t in net.TAGS[1:]}


def main(folder: str, hidden: int = 32, epochs: int = 6) -> None:
    import pyarrow.parquet as pq

    read = lambda t, c: [x for x in pq.read_table(f"{folder}/{t}.parquet", columns=[c])[c].to_pylist() if x]
    posts, senders = read("job_postings", "raw_text"), read("source_messages", "sender")
    random.Random(1).shuffle(posts), random.Random(2).shuffle(senders)
    windows, tags = examples(senders[:MAX_SENDERS] + posts[:MAX_POSTS])
    # Held out by window, so that no repetition of a window is on both sides.
    out = [crc32(w.encode()) % 20 == 0 for w in windows]
    print(len(windows), "windows,", sum(t.any() for t in tags), "with spans", flush=True)
    m = net.train([w for w, o in zip(windows, out) if not o], [t for t, o in zip(tags, out) if not o], hidden, epochs, say=lambda x: print(x, flush=True))
    held = {w: t for w, t, o in zip(windows, tags, out) if o}
    print("held out, precision and recall:", accuracy(m, list(held), list(held.values())))
    rng = random.Random(9)
    for name, forms, syllables in (("generated", GENERATED, SYLLABLES), ("generated, unseen forms and syllables", UNSEEN, HELD_SYLLABLES)):
        made = dict(g for w, t in held.items() if (g := generated(w, t, rng, forms, syllables)))
        print(f"held out, {name}:", accuracy(m, list(made), list(made.values())), len(made), "windows", flush=True)
    np.savez_compressed(net.MODEL, **{k: v.astype(np.float16) for k, v in m.items()})


if __name__ == "__main__":
    main(sys.argv[1])
