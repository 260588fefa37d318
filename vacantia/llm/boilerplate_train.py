"""Fits the network of ``boilerplate``; run as ``python -m vacantia.llm.boilerplate_train DIR``.

Lines are labelled on a bounded sample of pages (``MAX_PAGES``) by phrases of page furniture and by their order on the
page. The network doesn't get these phrases: it sees hashed words, layout and frequency. For a part of the lines, drawn
anew in each epoch, the words or the frequencies are withheld, so that it learns to decide by the others; a part of the
pages is seen as if written in markup, with marks for lines of the frame. Pages outside of the sample are held out.
"""

from __future__ import annotations

import re
import sys
from zlib import crc32

import numpy as np

from vacantia.llm import boilerplate as B

MAX_PAGES = 8_000

# Phrases of page furniture, folded to lower case.
FURNITURE = """
home|jobs|careers|about us|about|contact|contact us|help|faq|blog|press|news|events|investors|culture|benefits|teams|locations|products|companies|students|salaries|language|languages|register|sign in|sign up|log in|login|log out|my applications|my account|my jobs|saved searches|saved jobs|for employers|post a job|pricing|partners|support|menu|search|all vacancies|openings|vacancies
skip to main content|skip to content|back to top|back to search results|back to results|back|toggle navigation|search jobs by keyword|search jobs|create job alert|get new jobs by e-mail|subscribe to the newsletter|subscribe|follow us|follow|share|share this job|email this job to a friend|e-mail this job to a friend|print this page|print|save job|save this job|report this listing|report a problem|report|download our app|chat with our assistant|was this page useful?|apply now|apply|tweet|post|copy link|like|facebook|twitter|linkedin|instagram|youtube|xing|whatsapp|telegram|next|previous|load more|show more|read more|view all jobs|see all jobs|close|cancel|yes|no
accept|accept all|reject|reject all|settings|manage choices|ok, got it|got it|ok|decline|allow all|customise|customize|agree|i agree|preferences|cookie preferences|alle akzeptieren|akzeptieren|ablehnen|einstellungen|tout accepter|accepter|refuser|paramètres|aceptar|aceptar todo|rechazar|configurar
privacy policy|privacy|cookie settings|cookie policy|cookies|legal notice|legal|imprint|impressum|terms of use|terms|terms and conditions|accessibility|sitemap|site map|trust centre|trust center|do not sell my data|modern slavery statement|all rights reserved|datenschutz|mentions légales|aviso legal|contact sales
you may also like|more openings|recently posted|similar jobs|recommended for you|people also viewed|related jobs|other jobs|more jobs|more like this|latest jobs|popular searches|recently viewed|jobs you may like
"""  # fmt: skip
PHRASES = {p.strip() for line in FURNITURE.strip().split("\n") for p in line.split("|")}
SECTIONS = {"you may also like", "more openings", "recently posted", "similar jobs", "recommended for you", "people also viewed", "related jobs", "other jobs", "more jobs", "more like this", "latest jobs", "jobs you may like"}
BETWEEN = re.compile(r"\s+[|/·•>»›–—-]\s+|\s*[|·•»›]\s*|\s{2,}|\t")
CRUMB = re.compile(r"^(?:home|start|startseite|accueil|inicio)\s*(?:[>»›/|]|::|→)\s*\S", re.I)
COPYRIGHT = re.compile(r"©|\(c\) ?\d{4}|^copyright\b|\ball rights reserved\b|^powered by\b", re.I)
COOKIES = re.compile(
    r"^(?:this (?:web)?site|we|our partners|[\w' -]{2,60} and its partners) (?:uses?|stores?|sets?|places?) (?:\w+ ){0,2}cookies?\b|^cookies? help\b|^by (?:continuing|using|browsing)\b.{0,60}\bcookies?\b|^your privacy matters\b|\bsmall files on your device\b"
    r"|^(?:diese (?:website|seite)|wir|[\w' -]{2,60}?) (?:verwende[tn]|nutz(?:t|en)|setz(?:t|en)) cookies\b|^(?:nous|ce site|[\w' -]{2,60}?) (?:utilis(?:e|ent|ons)|emploie|dépose) des cookies\b|^(?:este sitio|usamos|utilizamos|[\w' -]{2,60}?) ?(?:usa|utiliza|emplea)? ?(?:las )?cookies\b(?=.*\b(?:para|propias|terceros|mejorar|medir|experiencia|visitas|opcionales|que)\b)",
    re.I,
)
ROLE = r"(?:engineer|developer|architect|writer|administrator|analyst|manager|designer|master|scientist|consultant|specialist|recruiter|tester|researcher|nurse|accountant|technician|director|officer|assistant|eng\.|dev)"
OTHER_JOB = re.compile(rf"^(?:[-*•]\s*)?(?:[\w/+#.-]+ ){{0,5}}{ROLE}(?: \([a-z/]+\))?(?: [-–—·|@] |, | at | bei | chez | en )[A-Z][\w'-]*(?: [A-Z][\w'-]*){{0,3}}$", re.I)
PLAIN_ROLE = re.compile(rf"^(?:[\w/+#.-]+ ){{0,5}}{ROLE}$", re.I)
PITCH = re.compile(r"^you\b|^your (?!privacy)|^part of\b|^we (?:own|build|maintain|keep)\b", re.I)


def furniture(text: str) -> bool:
    """Whether a line is page furniture by itself."""
    line = text.strip()
    folded = line.casefold().strip(" \u00a0.:!…")
    if folded in PHRASES or folded.rstrip("?") + "?" in PHRASES:
        return True
    parts = [p.strip(" .:").casefold() for p in BETWEEN.split(line) if p.strip()]
    if len(parts) > 1 and all(p in PHRASES for p in parts):
        return True
    if CRUMB.match(line) or COPYRIGHT.search(line) and len(line) < 120:
        return True
    return bool(COOKIES.search(line)) and not PITCH.match(line)


def kind(line: str) -> str:
    """``section`` (a heading of other vacancies), ``furniture``, ``job`` (another vacancy), ``role`` or empty."""
    if furniture(line):
        return "section" if line.casefold().strip(" .:!…") in SECTIONS else "furniture"
    return "job" if OTHER_JOB.match(line) else "role" if PLAIN_ROLE.match(line) else ""


def labels(lines: list[str]) -> list[bool]:
    """Whether each of the solid lines of a page isn't vacancy."""
    out, listing = [], False
    for line in lines:
        is_a = kind(line)
        hit = is_a in ("job", "section", "furniture") or is_a == "role" and listing
        if is_a in ("section", "furniture"):
            listing = is_a == "section"
        elif not hit:
            listing = False
        out.append(hit)
    return out


def gradients(m: dict[str, np.ndarray], rows: B.Rows, gold: np.ndarray, keep_words: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    own, flat, at, scale = B.own(m, rows, keep_words)
    x = B.inputs(rows, own)
    z = np.tanh(x @ m["W"] + m["b"])
    p = 1 / (1 + np.exp(-np.clip(z @ m["v"] + m["c"][0], -30, 30)))
    loss = -np.mean(np.log(np.where(gold, p, 1 - p) + 1e-9))
    d = ((p - gold) / len(gold)).astype(np.float32)
    g = {"v": z.T @ d, "c": np.array([d.sum()], np.float32)}
    dz = (d[:, None] * m["v"]) * (1 - z * z)
    g["W"], g["b"] = x.T @ dz, dz.sum(0)
    dx = dz @ m["W"].T
    down = np.zeros_like(own)
    n = len(gold)
    for k, o in enumerate(range(-B.REACH, B.REACH + 1)):
        i = np.arange(n) + o
        good = (i >= 0) & (i < n)
        good[good] &= rows.page[i[good]] == rows.page[np.arange(n)[good]]
        np.add.at(down, rows.code[i[good]], dx[good, k * B.DIMS : (k + 1) * B.DIMS])
    down *= scale[:, None]
    g["T"] = np.zeros_like(m["T"])
    np.add.at(g["T"], flat, np.repeat(down, at, axis=0))
    return float(loss), g


def fit(pages: list[list[str]], gold: list[list[bool]], table: dict[int, tuple], epochs: int = 6, per_batch: int = 40, rate: float = 0.004, seed: int = 0, say=print) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m = {"T": (rng.normal(size=(B.ALL_SLOTS, B.DIMS)) * 0.1).astype(np.float32), "W": (rng.normal(size=(B.WIDTH, B.HIDDEN)) / np.sqrt(B.WIDTH)).astype(np.float32), "b": np.zeros(B.HIDDEN, np.float32), "v": (rng.normal(size=B.HIDDEN) / np.sqrt(B.HIDDEN)).astype(np.float32), "c": np.zeros(1, np.float32)}
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    total = epochs * -(-len(pages) // per_batch)
    for epoch in range(epochs):
        order, losses = rng.permutation(len(pages)), []
        for k in range(0, len(order), per_batch):
            part = order[k : k + per_batch]
            y = np.array([v for i in part for v in gold[i]], bool)
            marks = [[bool(v) if rng.random() < 0.9 else not v for v in gold[i]] if rng.random() < 0.1 else None for i in part]
            rows = B.Rows([pages[i] for i in part], marks, table if rng.random() < 0.7 else {})
            loss, g = gradients(m, rows, y, rng.random(len(rows.words)) > 0.15)
            losses.append(loss)
            step += 1
            lr = rate * min(1, step / 30) * (0.05 + 0.95 * (1 - step / total))
            for p, v in g.items():
                first[p] += 0.1 * (v - first[p])
                second[p] += 0.001 * (v * v - second[p])
                m[p] -= (lr * (first[p] / (1 - 0.9**step)) / (np.sqrt(second[p] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        say(f"epoch {epoch + 1}: loss {np.mean(losses):.5f}")
    return m


def accuracy(m: dict[str, np.ndarray], pages: list[list[str]], gold: list[list[bool]], table: dict[int, tuple], words: bool = True) -> tuple[float, float]:
    """Precision and recall of the lines that aren't vacancy."""
    y = np.array([v for g in gold for v in g], bool)
    rows = B.Rows(pages, [None] * len(pages), table)
    got = B.decide(m, rows, None if words else np.zeros(len(rows.words), bool))
    return round(float((got & y).sum() / max(1, got.sum())), 4), round(float((got & y).sum() / max(1, y.sum())), 4)


def main(folder: str) -> None:
    import pandas as pd
    import pyarrow.parquet as pq

    t = pq.read_table(f"{folder}/job_details.parquet", columns=["job_id", "description_text"]).to_pydict()
    found = [(i, [x.strip() for x in d.split("\n") if x.strip()]) for i, d in zip(t["job_id"], t["description_text"]) if d]
    counted = pd.concat(B.line_counts([p for _, p in found])).groupby("k").sum()
    table = B.frequent(list(counted.itertuples()), len(found))
    found.sort(key=lambda p: crc32(str(p[0]).encode()))
    sample, held = found[:MAX_PAGES], found[MAX_PAGES:]
    lines = lambda part: ([p for _, p in part], [labels(p) for _, p in part])
    m = fit(*lines(sample), table)
    print(len(sample), "pages; held out", len(held), "pages, precision and recall:", accuracy(m, *lines(held), table), "without frequencies", accuracy(m, *lines(held), {}), "without words", accuracy(m, *lines(held), table, words=False))
    np.savez_compressed(B.MODEL, **{k: v.astype(np.float16) for k, v in m.items()})


if __name__ == "__main__":
    main(sys.argv[1])
