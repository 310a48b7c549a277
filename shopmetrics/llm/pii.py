"""Personal data by candidate generation and gradient-boosted trees.

The base spans follow fixed rules: an e-mail address, an IP address, a card number with a valid check
digit, an international phone number. Beside them, generators of high recall propose spans that may
overlap: loose addresses around an at sign (also written out in brackets), addresses with bracketed dots,
and every run of digits with the separators that people use and, at these separators, its windows of up to
``WINDOW`` groups, as a possible address, card and phone number. For each
kind boosted trees of two splits score a candidate by its format and by the words around it.

What no base rule covers counts as positive by its form and check digit where the nearest telling word before it
names the kind or the form alone is plain (see ``label``), and as negative otherwise. As such forms are rare, the
base spans are also put into forms that the base rules don't find (without the plus, the at sign written out, other
lengths and separators), into contexts that do and don't tell, and spoiled; these disguises are labelled alike.
The trees are fitted on at most ``SAMPLE`` examples of each kind and class, those with the smallest digests of half of
all texts. The examples of all other texts that no base span covers set the threshold, by a histogram of their scores:
the lowest bin from which on at least ``PRECISION`` of them are positive. Candidates from there on that overlap no
other span of the result are added, the highest score first. Base spans always stay.

Offsets are code points, ends exclusive. Every scan is linear in the text. Defined cases: a null
text counts as empty and has no spans; where a kind has no examples of both classes
in one half of the texts and none that is positive in the other, nothing is added to it; rows are handled one by one, so repeated ids, null ids, further columns and
empty tables need nothing special.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import pieces, utf8
from shopmetrics.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 4000  # examples of each kind and class to fit on
BINS = 1000
TREES = 30
RATE = 0.3
PRECISION = 0.995
LEAST_CONFIDENCE = 0.9
CONTEXT = 40
SCORED = 4096  # candidates that are scored at once
WINDOW = 6  # groups of digits that a proposed part of a run has at most

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+")
DEFANGED = re.compile(r"(?<![0-9.\])])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])")
RUN = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*+")
WRITTEN = re.compile(r"\w[\w.+-]*+ ?[\[(]at[\])] ?\w[\w-]*+(?: ?(?:\.|[\[(]dot[\])]) ?\w[\w-]*+)+")
LOOSE_TAIL = re.compile(r"[^\s@<>\"']*+")

#: Words near a span that tell what it is, or that it is something else.
SAID = re.compile(
    r"\b(?:(?P<email>e-?mails?|correos?|courriel|contact)|(?P<ip>ip|ipv4|server|host|login)"
    r"|(?P<card>cards?|visa|mastercard|amex|credit|karte|kreditkarte|tarjeta|carte)"
    r"|(?P<phone>(?:tele)?phones?|tel|telefon|teléfono|téléphone|calls?|fax|mobile?|mobil|handy|móvil|portable|anruf|llama|appel)"
    r"|(?P<other>orders?|invoices?|ids?|tickets?|zip|isbn|total|amount|version|serial|items?|sku|ref|token))\b",
    re.I,
)
NATIONAL = ([3, 3, 4], [1, 3, 3, 4])
CARDS = ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
AT = re.compile(r" ?[\[(]at[\])] ?")
DOT = re.compile(r" ?[\[(]dot[\])] ?| ?\. ?")
ADDRESS = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the base rules: leftmost, not overlapping within a kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        # The local part is the run of its characters before the sign, from the last address on.
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for run in DOTTED.finditer(text):
            parts = run[0].split(".")
            start = run.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(map(_byte, four)):
                    found.append(("ip", start, end))
                start = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data; they may overlap."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] not in " \t\n\r\x0b\x0c@<>\"'":
            start -= 1
        end = LOOSE_TAIL.match(text, at + 1).end()
        while end > at + 1 and text[end - 1] in ".,;:!?)]}":
            end -= 1
        if start < at < end - 1:
            found.append(("email", start, end))
        free = at + 1
        at = text.find("@", free)
    if "at]" in text or "at)" in text:
        found += [("email", m.start(), m.end()) for m in WRITTEN.finditer(text)]
    if _DIGIT.search(text):
        for m in RUN.finditer(text):
            found += _within(text, m.start(), m.end())
        found += [("ip", m.start(), m.end()) for m in DEFANGED.finditer(text)]
    return list(dict.fromkeys(found))


def _within(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """The run from ``start`` to ``end`` and the windows of up to ``WINDOW`` of its groups of digits, where they fit a kind."""
    places = [(m.start(), m.end()) for m in GROUP.finditer(text, start, end)]
    sizes = [b - a for a, b in places]
    # (first, last, number of digits); the whole run comes first, whatever the number of its groups.
    spans = [(0, len(places) - 1, sum(sizes))]
    for k in range(len(places)):
        n = 0
        for last in range(k, min(k + WINDOW, len(places))):
            n += sizes[last]
            if n > 19:
                break
            spans.append((k, last, n))
    found = []
    for k, last, n in spans:
        digit, stop = places[k][0], places[last][1]
        if last - k == 3 and all(text[places[i][1] : places[i + 1][0]] == "." for i in range(k, last)):
            found.append(("ip", digit, stop))
        if 12 <= n <= 19:
            found.append(("card", digit, stop))
        if 7 <= n <= 15:
            # The sign and the bracket before the first group belong to a phone number.
            first = digit
            if first > start and text[first - 1] == "(" and text.find(")", digit, stop) > 0:
                first -= 1
            if first - 1 == start and text[start] == "+":
                first = start
            found.append(("phone", first, stop))
    return found


def _groups(span: str) -> list[int]:
    return [len(x) for x in GROUP.findall(span)]


def _cut(text: str, start: int, end: int) -> bool:
    """Whether the span is part of something longer: joined to a letter, a digit or a bracket's other half."""
    span = text[start:end]
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    before, after = text[max(0, start - 2) : max(0, start - 1)], text[end + 1 : end + 2]
    return (
        left.isalnum() or left in ("@", "_", "=", "+") or (left in ("-", ".", "/", ")") and before.isalnum())
        or right.isalnum() or right in ("@", "_", "=") or (right in ("-", ".", "/") and after.isalnum())
        or span.count("(") != span.count(")")
    )


def _usual(text: str, kind: str, start: int, end: int) -> bool:
    """Whether the digits are grouped as a card's or a national phone number's usually are."""
    span = text[start:end]
    digits, groups = _digits(span), _groups(span)
    if kind == "card":
        return groups in CARDS and digits[0] in "3456" and luhn(digits)
    return groups in NATIONAL and digits[-10] in "23456789" and digits[-7] in "23456789" and (len(groups) < 4 or digits[0] == "1")


def rivals(text: str, spans: list[tuple[str, int, int]]) -> set[tuple[str, int, int]]:
    """The cards and phone numbers among the spans that overlap one of the usual grouping, or are part of a longer one."""
    out = set()
    for kind in ("card", "phone"):
        own = sorted((s for s in spans if s[0] == kind), key=lambda s: (s[1], -s[2]))
        good = {s for s in own if valid(text, *s)}
        usual = [s for s in own if s in good and _usual(text, *s)]
        known, at, reach = set(usual), 0, -1
        for s in own:
            while at < len(usual) and usual[at][2] <= s[1]:
                at += 1
            k = at
            while k < len(usual) and usual[k][1] < s[2] and s not in out:
                other = usual[k]
                if other != s and other[2] > s[1] and (s not in known or other[2] - other[1] > s[2] - s[1]):
                    out.add(s)
                k += 1
            if s not in out and s not in known and s[2] <= reach:
                out.add(s)
            if s not in out and s in good:
                reach = max(reach, s[2])
    return out


def said(text: str, start: int, end: int) -> tuple[str, str]:
    """What the nearest telling words before and after the span name; empty without one."""
    before, after = "", ""
    for m in SAID.finditer(text, max(0, start - CONTEXT), start):
        before = m.lastgroup
    m = SAID.search(text, end, end + CONTEXT)
    return before, m.lastgroup if m else after


def valid(text: str, kind: str, start: int, end: int) -> bool:
    """Whether the span can be of its kind by its form and check digit."""
    span = text[start:end]
    if kind == "email":
        return bool(ADDRESS.fullmatch(DOT.sub(".", AT.sub("@", span))))
    if _cut(text, start, end):
        return False
    digits, groups = _digits(span), _groups(span)
    if kind == "ip":
        return len(groups) == 4 and all(map(_byte, GROUP.findall(span)))
    if kind == "card":
        return 12 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits)
    dated = groups[:3] in ([4, 2, 2], [4, 1, 2], [4, 2, 1]) or groups[:3] in ([2, 2, 4], [1, 2, 4])
    dotted = len(groups) == 4 and span.count(".") == 3
    return 7 <= len(digits) <= 15 and len(set(digits)) > 1 and not dated and not dotted


def plain(text: str, kind: str, start: int, end: int) -> bool:
    """Whether the form of a valid span tells its kind without further words."""
    if kind in ("email", "ip"):
        return True
    span, usual = text[start:end], _usual(text, kind, start, end)
    return usual if kind == "card" else span[0] == "+" and len(_digits(span)) >= 10 or usual and any(c in span for c in "-.(")


def label(text: str, kind: str, start: int, end: int, rival: bool) -> bool:
    """Whether a span that no base rule covers counts as personal data."""
    if rival or not valid(text, kind, start, end):
        return False
    before = said(text, start, end)[0]
    return before == kind or before != "other" and plain(text, kind, start, end)


def disguised(text: str, kind: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """Texts in which a base span stands in a form that the base rules don't find, or spoiled, and its place there."""
    span, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = _digits(span)
    if kind == "email":
        name, _, host = span.rpartition("@")
        forms = [("", f"{name} [at] {host.replace('.', ' [dot] ')}"), ("", f"{name}(at){host}"), ("", f"{name}@{host[0]}ü{host[1:]}"),
                 ("", f"{name}@{host.replace('.', '')}"), ("", f"{name}@{host.replace('.', '..')}ü"), ("", f"{name}@{host[:3].replace('.', '')}")]
    elif kind == "ip":
        parts = span.split(".")
        forms = [("", "[.]".join(parts)), ("", "[dot]".join(parts)), ("", "[.]".join(["7" + parts[0].zfill(2)[-2:], *parts[1:]]))]
    elif kind == "card":
        short = [next(digits[: n - 1] + d for d in "0123456789" if luhn(digits[: n - 1] + d)) for n in (12, 13)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        dotted = ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
        forms = [(w, f) for f in (*short, wrong, dotted, f"{span} 12") for w in ("", "card ", "order ")]
    else:
        bare = span.lstrip("+")
        last = f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"
        forms = [(w, f) for f in (bare, digits, last, f"{span} 00.00.00.00") for w in ("", "phone ", "order ")]
    return [(left + w + f + right, len(left) + len(w), len(left) + len(w) + len(f)) for w, f in forms]


#: What a number of ``examples`` stands for: a base span, a proposal that meets none, a proposal in a disguise.
BASE_RULE, PROPOSED, DISGUISED = range(3)


def examples(text: str) -> Iterator[tuple[str, int, bool, list[float]]]:
    """(kind, origin, label, features) of the text's spans and of disguises of those that the base rules find.

    Parts of a base span of the same kind are left out: they are never added and tell nothing.
    """
    base = base_spans(text)
    known = set(base)
    for origin, t, first, last in [(PROPOSED, text, 0, len(text)), *[(DISGUISED, *d) for span in base for d in disguised(text, *span)]]:
        found = candidates(t)
        rival = rivals(t, found)
        covered = base if origin == PROPOSED else base_spans(t)
        for span, met in zip(found, overlapping(found, covered), strict=True):
            kind, start, end = span
            if origin == PROPOSED and span in known:
                yield kind, BASE_RULE, True, features(t, *span, span in rival)
            elif start < last and end > first and kind not in met:
                own = PROPOSED if origin == PROPOSED and not met else DISGUISED if origin == DISGUISED and not met else BASE_RULE
                yield kind, own, not met and label(t, *span, span in rival), features(t, *span, span in rival)


def overlapping(spans: list[tuple[str, int, int]], covered: list[tuple[str, int, int]]) -> list[set[str]]:
    """For each span the kinds of those of ``covered`` that it overlaps."""
    # By kind the covered ones don't overlap each other, so two bounds find them.
    out: list[set[str]] = [set() for _ in spans]
    for kind in KINDS:
        own = sorted((a, b) for k, a, b in covered if k == kind)
        starts, ends = [a for a, _ in own], [b for _, b in own]
        for (_, start, end), kinds in zip(spans, out, strict=True):
            if bisect_left(starts, end) > bisect_right(ends, start):
                kinds.add(kind)
    return out


def features(text: str, kind: str, start: int, end: int, rival: bool = False) -> list[float]:
    span = text[start:end]
    digits = _digits(span)
    groups = _groups(span)
    left, right = text[max(0, start - 1) : start], text[end : end + 1]
    host = DOT.sub(".", AT.sub("@", span)).rpartition("@")[2] if kind == "email" else ""
    before, after = said(text, start, end)
    top = host.rpartition(".")[2]
    sound = not rival and valid(text, kind, start, end)
    # Of features that part a sample equally well the first one is taken.
    return [
        float(sound), float(sound and plain(text, kind, start, end)), float(before == kind), float(before == "other"),
        float(len(span)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(span[:1] == "+"), float("(" in span), float(span.count(".")), float(span.count("-")), float(span.count(" ")),
        float(bool(digits) and len(digits) < 40 and luhn(digits)), float(left.isalnum() or left in ("@", "_", "/", "=")),
        float(right.isalnum() or right in ("@", "_", "/", "=")), float(sum(map(str.isalpha, span))), float(host.count(".")),
        float(len(top)), float(top.isalpha()), float(host.isascii()), float(".." in span),
        float(max((int(x) for x in re.findall(r"[0-9]{1,4}", span)), default=0)), float(digits[:1] in ("3", "4", "5", "6")),
        float(before not in ("", kind)), float(after == kind), float("[" in span),
        float(kind != "email" and _cut(text, start, end)), float(rival), float(kind in ("card", "phone") and _usual(text, kind, start, end)),
    ]


# A tree is (feature, cut, feature and cut below it, on its left and right, and the values of the four leaves).
Tree = tuple[int, float, int, float, int, float, tuple[float, float, float, float]]


def _best_split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, float, float]:
    best = (0, np.inf, 0.0)
    g, h = gradient.sum(), weight.sum()
    for f in range(x.shape[1]):
        values, place = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        gl, hl = np.bincount(place, gradient)[:-1].cumsum(), np.bincount(place, weight)[:-1].cumsum()
        gains = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        k = int(gains.argmax())
        if gains[k] > best[2] + 1e-9:
            best = (f, float((values[k] + values[k + 1]) / 2), float(gains[k]))
    return best


def score(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Probability of each row."""
    total = np.zeros(len(x))
    for f, cut, fl, cl, fr, cr, leaves in trees:
        right = x[:, f] > cut
        under = np.where(right, x[:, fr] > cr, x[:, fl] > cl)
        total += np.asarray(leaves)[2 * right + under]
    return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> list[Tree]:
    """Boosted trees of two levels for the logistic loss."""
    model: list[Tree] = []
    for _ in range(trees):
        p = score(model, x)
        gradient, weight = y - p, p * (1 - p)
        f, cut, gain = _best_split(x, gradient, weight)
        if gain <= 0:
            break
        right = x[:, f] > cut
        (fl, cl, _), (fr, cr, _) = (_best_split(x[s], gradient[s], weight[s]) for s in (~right, right))
        under = np.where(right, x[:, fr] > cr, x[:, fl] > cl)
        leaf = 2 * right + under
        leaves = RATE * np.bincount(leaf, gradient, 4) / (np.bincount(leaf, weight, 4) + 1)
        model.append((f, cut, fl, cl, fr, cr, tuple(leaves.tolist())))
    return model


def _digest(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _held_out(text: str) -> bool:
    """Copies of a text are on one side."""
    return _digest(text) % 2 != 0


def _examples(docs: DataFrame) -> DataFrame:
    """(kind, y, key, x): of each kind and class ``SAMPLE`` examples at least, or all, from the texts to fit on.

    A task keeps those of the smallest digests, so the smallest of all tasks are among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], dict[int, list[float]]] = {(kind, y): {} for kind in KINDS for y in (0, 1)}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not _held_out(text):
                    for kind, _, y, x in examples(text):
                        rows = kept[kind, int(y)]
                        rows[_digest(text, x)] = x
                        if len(rows) >= 2 * SAMPLE:
                            kept[kind, int(y)] = {key: rows[key] for key in sorted(rows)[:SAMPLE]}
        rows = [{"kind": k, "y": y, "key": key, "x": part[key]} for (k, y), part in kept.items() for key in sorted(part)[:SAMPLE]]
        schema = pa.schema([("kind", pa.string()), ("y", pa.int64()), ("key", pa.int64()), ("x", pa.list_(pa.float64()))])
        yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.mapInArrow(run, "kind string, y long, key long, x array<double>").dropDuplicates(["kind", "y", "key"])


def _histograms(docs: DataFrame, trees: dict[str, list[Tree]]) -> DataFrame:
    """(kind, bin, y, n): scores of the examples of all held-out texts that the model could add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {kind: np.zeros((2, BINS), np.int64) for kind in trees}
        waiting: dict[str, list] = {kind: [] for kind in trees}

        def count(kind: str) -> None:
            values = score(trees[kind], np.array([x for _, x in waiting[kind]]))
            np.add.at(counts[kind], (np.array([y for y, _ in waiting[kind]], int), _bin(values)), 1)
            waiting[kind].clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if _held_out(text):
                    for kind, origin, y, x in examples(text):
                        if kind in trees and origin != BASE_RULE:
                            waiting[kind].append((y, x))
                            if len(waiting[kind]) == SCORED:
                                count(kind)
        rows = []
        for kind, table in counts.items():
            if waiting[kind]:
                count(kind)
            rows += [{"kind": kind, "bin": int(b), "y": int(y), "n": int(table[y, b])} for y, b in zip(*np.nonzero(table), strict=True)]
        schema = pa.schema([("kind", pa.string()), ("bin", pa.int64()), ("y", pa.int64()), ("n", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, schema)

    found = docs.mapInArrow(run, "kind string, bin long, y long, n long")
    return found.groupBy("kind", "bin", "y").agg(F.sum("n").alias("n"))


def _bin(values: np.ndarray) -> np.ndarray:
    return np.minimum((values * BINS).astype(np.int64), BINS - 1)


def train(docs: DataFrame) -> dict[str, tuple[list[Tree], float]]:
    """Trees and threshold for each kind that has examples of both classes."""
    texts = docs.where("text is not null").select("text")
    sample = stage(_examples(texts), "private-examples")
    trees = {}
    for kind in KINDS:
        parts = []
        for y in (0, 1):
            rows = sample.where((F.col("kind") == kind) & (F.col("y") == y)).select("key", "x").orderBy("key").limit(SAMPLE).collect()
            parts.append([r.x for r in rows])
        if all(parts):
            trees[kind] = fit(np.array(parts[0] + parts[1]), np.repeat([0.0, 1.0], [len(x) for x in parts]))
    # At most 2 * BINS rows of each kind.
    counts = {kind: np.zeros((2, BINS), np.int64) for kind in trees}
    for r in _histograms(texts, trees).collect() if trees else []:
        counts[r.kind][r.y, r.bin] = r.n
    model = {}
    for kind, (wrong, right) in counts.items():
        # From each bin on: of all that score at least as high, enough are positive.
        above, good = (wrong + right)[::-1].cumsum()[::-1], right[::-1].cumsum()[::-1]
        enough = np.flatnonzero((wrong + right > 0) & (good > 0) & (good >= PRECISION * above))
        if len(enough):
            model[kind] = (trees[kind], max(LEAST_CONFIDENCE, float(enough[0]) / BINS))
    return model


def all_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], model: dict) -> list[list[tuple[str, int, int]]]:
    """Of each text the base spans and the candidates that the model adds to them."""
    added: list[list] = [[] for _ in texts]
    waiting: dict[str, list] = {kind: [] for kind in model}

    def decide(kind: str) -> None:
        trees, threshold = model[kind]
        values = score(trees, np.array([x for *_, x in waiting[kind]]))
        for (k, start, end, _), value in zip(waiting[kind], values.tolist(), strict=True):
            if value >= threshold:
                added[k].append((-value, start - end, start, end, kind))
        waiting[kind].clear()

    for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
        found = candidates(text)
        rival = rivals(text, found) if found else set()
        for span, met in zip(found, overlapping(found, base), strict=True):
            if span[0] in model and not met:
                waiting[span[0]].append((k, *span[1:], features(text, *span, span in rival)))
                if len(waiting[span[0]]) == SCORED:
                    decide(span[0])
    for kind in model:
        if waiting[kind]:
            decide(kind)
    return [list(base) + _disjoint(more) for base, more in zip(bases, added, strict=True)]


def _disjoint(added: list) -> list[tuple[str, int, int]]:
    """The highest scores first, of equal ones the longest, those that overlap none before them."""
    starts, ends, out = [], [], []
    for _, _, start, end, kind in sorted(added):
        k = bisect_right(starts, start)
        if (k == 0 or ends[k - 1] <= start) and (k == len(starts) or starts[k] >= end):
            starts.insert(k, start)
            ends.insert(k, end)
            out.append((kind, start, end))
    return out


def find_spans(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<kind, start, end> in order of start and kind."""
    model = train(docs.select("doc_id", "text")) if model is None else model
    kind_of = {kind: k for k, kind in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a, b in pieces(utf8(batch.column(1))[1]):
                base, spans = [], []
                texts = [text or "" for text in batch.column(1).slice(a, b - a).to_pylist()]
                firsts = [base_spans(text) for text in texts]
                for pair in zip(firsts, all_spans(texts, firsts, model), strict=True):
                    for out, found in zip((base, spans), pair, strict=True):
                        found = sorted(found, key=lambda s: (s[1], kind_of[s[0]], s[2]))
                        out.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                columns = [batch.column(0).slice(a, b - a), pa.array(base, item), pa.array(spans, item)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the base spans' number by kind and their digest, and all spans."""

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
