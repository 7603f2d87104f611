"""Personal data in texts by weak supervision.

``base_spans`` finds what fixed patterns and their checks give; those spans always stay. Beside them a text yields
candidates that the patterns miss: addresses spelt with words or blanks, numbers of which a pattern took too much,
numbers in national notation, account numbers, names behind titles. Labelers vote on every candidate (for, against or
not at all): its form, its check digits or ranges, gazetteers, the words before it and its edges. Expectation-maximisation
over the counted vote patterns estimates how reliable each labeler is, without labels, and gives every pattern its
probability. A logistic regression trained on these soft labels, over votes, form and neighbours, is the final
classifier; candidates of 0.5 or more become spans.

The counted vote patterns are at most kinds x 3 ** labelers rows; the regression is fitted on the ``SAMPLE`` candidates
with the smallest hashes. Texts are read once: candidates are staged with the ids, and all else works on those.

Defined results: null and empty texts have no spans; a null id is kept; repeated rows give repeated results; texts of
any length are taken whole in linear time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import id_text, pieces_of, slim, stage

BASE_KINDS = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans that start together are listed.
KINDS = (*BASE_KINDS, "iban", "name", "ssn")
LABELERS = ("form", "check", "gazetteer", "words_for", "words_against", "edges")
FOR, AGAINST, SILENT = 1, 0, -1
#: Candidates that the final classifier is fitted on, at most.
SAMPLE = 20_000
#: Characters before a candidate that its context labelers read.
BEFORE = 48
#: Buckets of the hashed word before a candidate.
NEIGHBOURS = 32

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Wider forms. Each is tried in a bounded window around a rare sign, so that no text costs more than linear time.
_BRACKETED_AT = re.compile(r"[\[({<][ \t]?(?:at|AT|@)[ \t]?[\])}>]")
_SPELT_LOCAL = re.compile(r"[\w%+-]+(?:(?:\.|[ \t]?(?:\[dot\]|\(dot\)|[ \t]dot[ \t])[ \t]?)[\w%+-]+)*[ \t]?\Z")
_DOT = r"(?:\.|[ \t]?[\[({<][ \t]?(?:dot|DOT|\.)[ \t]?[\])}>][ \t]?|[ \t](?:dot|DOT)[ \t])"
_SPELT_DOMAIN = re.compile(rf"[ \t]?([\w-]+(?:{_DOT}[\w-]+)*{_DOT}([A-Za-z]{{2,12}})(?![\w@-]))")
_WORD_DOT = re.compile(r"(?i)[ \t]dot[ \t]|[\[({<][ \t]?dot")
_UNICODE_LOCAL = re.compile(r"[\w.%+-]+\Z")
_UNICODE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_NUMBERISH = re.compile(r"[(0-9][0-9 ()./-]{8,}")
_NATIONAL = re.compile(r"(?<![\w.+-])(?:\(0?[1-9][0-9]{1,4}\)[ ]?|00[1-9][0-9]{0,2}[ /.-]?\(?[0-9]{2,4}\)?[ /.-]|0?[1-9][0-9]{1,4}[ /.-])[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,2}(?![\w-]|\.[0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])")
_CAPITALS = r"[ \t]((?:[A-ZÀ-Þ][a-zß-ÿ'’]+)(?:[ -][A-ZÀ-Þ][a-zß-ÿ'’]+){0,2})"
_TITLED = re.compile(rf"[MDPSHF](?:(?<=M)(?:rs?|s)\.?|(?<=D)r\.?|(?<=P)rof\.?|(?<=S)ra?\.?|(?<=H)err|(?<=F)rau|(?<=M)adame|(?<=M)onsieur|(?<=S)eñora?){_CAPITALS}")
_INTRODUCED = re.compile(rf"(?:(?:my|his|her) name is|ich heiße|me llamo|je m'appelle|name:)(?-i:{_CAPITALS})", re.IGNORECASE)
_INTRODUCERS = ("name is", "name:", "Name:", "heiße", "llamo", "appelle")
_GROUP = re.compile(r"[0-9]+")
_CARD_RUN = re.compile(r"[0-9]{3,19}(?:[ .\- ]{1,2}[0-9]{2,19})*+")

# Gazetteers: fixed public values.
_TLDS = frozenset("com org net edu gov mil int info biz io co ai app dev me eu us uk de fr es it nl be at ch pl pt se no dk fi ie cz hu ro gr ru ua tr in cn jp kr au nz ca mx br ar cl za test example".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 961 962 965 966 971 972 974".split())
_IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "TR": 26}
_GIVEN = frozenset("james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah anna maria peter hans klaus ursula monika stefan jürgen sabine pierre marie jean claude sophie luc camille jose juan carlos ana carmen luis miguel elena laura paul emma".split())

# Words that speak for a kind, and words that speak against any.
_WORDS_FOR = {
    "email": r"e-?mail|mail|contact|write|reach|schreib|kontakt|correo|contacto|courriel|address|adresse",
    "ip": r"\bip\b|ipv[46]|host|server|client|address|login|from|adresse",
    "card": r"card|visa|master|amex|credit|debit|karte|tarjeta|carte|payment|pay\b|paid",
    "phone": r"phone|call|tel\b|tel\.|telef|téléphone|mobile|cell|fax|whatsapp|handy|anruf|llama|appel|dial|ring",
    "iban": r"iban|account|konto|cuenta|compte|bank|transfer",
    "name": r"name|mr|mrs|ms|dr|prof|herr|frau|madame|monsieur|señor|heiße|llamo|appelle",
    "ssn": r"ssn|social|security|tax|insurance",
}
_WORDS_FOR = {kind: re.compile(rf"(?i)(?<![a-z])(?:{words})") for kind, words in _WORDS_FOR.items()}
_WORDS_AGAINST = re.compile(r"(?i)(?<![a-z])(?:order|invoice|isbn|issn|version|release|build|section|chapter|figure|table|page|price|part|item|serial|model|sku|ticket|case|ref|doi|rfc)\b[ \t#:.no]*\Z")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _mod97(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base patterns: leftmost, not overlapping within a kind, failing matches dropped."""
    found: list[tuple[int, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end:
            left, domain = max(end, text.rfind("@", end, at) + 1), _DOMAIN.match(text, at + 1)
            if domain:
                start = at
                while start > left and text[start - 1] in _LOCAL_SIGNS:
                    start -= 1
                if start < at:
                    found.append((start, 0, domain.end()))
                    end = domain.end()
        at = text.find("@", at + 1)
    if _GROUP.search(text) is None:
        return found
    if "." in text:
        for m in _NUMBERS.finditer(text):
            parts, start = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                own = parts[k : k + 4]
                stop = start + sum(map(len, own)) + 3
                if _octets(own):
                    found.append((start, 1, stop))
                start = stop + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _spelt_addresses(text: str) -> Iterator[tuple[str, int, int]]:
    """Addresses whose sign is a word, bracketed or set off by blanks. A bare word asks for a dot that is a word too."""
    spots: list[tuple[int, int, str]] = []
    if any(bracket in text for bracket in "[({<"):
        spots += [(m.start(), m.end(), "bracket") for m in _BRACKETED_AT.finditer(text)]
    if " dot " in text or " DOT " in text:
        for word in (" at ", " AT "):
            at = text.find(word)
            while at >= 0:
                spots.append((at, at + 3, "word"))
                at = text.find(word, at + 3)
    at = text.find("@")
    while at >= 0:
        if text[at - 1 : at] in (" ", "\t") or text[at + 1 : at + 2] in (" ", "\t"):
            spots.append((at, at + 1, "sign"))
        at = text.find("@", at + 1)
    for start, end, sort in spots:
        right = _SPELT_DOMAIN.match(text, end, end + 256)
        if right is None or sort != "bracket" and right[2].lower() not in _TLDS or sort == "word" and not _WORD_DOT.search(right[0]):
            continue
        left = _SPELT_LOCAL.search(text[max(0, start - 64) : start])
        if left:
            yield "email", start - len(left[0]), right.end()


def _bare(text: str, start: int, signs: str = "") -> bool:
    """Nothing that would belong to it stands before ``start``."""
    before = text[start - 1 : start]
    return not (before.isalnum() or before == "_" or before != "" and before in signs)


def _wide_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what the wider forms find; they may overlap."""
    yield from _spelt_addresses(text)
    at = -1 if text.isascii() else text.find("@")
    while at >= 0:
        left, right = _UNICODE_LOCAL.search(text[max(0, at - 64) : at]), _UNICODE_DOMAIN.match(text, at + 1, at + 256)
        if left and right and not text[at - len(left[0]) : right.end()].isascii():
            yield "email", at - len(left[0]), right.end()
        at = text.find("@", at + 1)
    if _GROUP.search(text):
        if "+" in text:
            for m in _PHONE.finditer(text):
                if sum(c.isdigit() for c in m[0]) > 15:
                    yield from (("phone", m.start(), m.start() + n) for n in _phone_ends(m[0]))
        for m in _CARD_RUN.finditer(text):
            if m.end() - m.start() >= 12:
                yield from (("card", m.start() + a, m.start() + b) for a, b in _cards_within(m[0]))
        for run in _NUMBERISH.finditer(text):
            for m in _NATIONAL.finditer(text, run.start(), run.end() + 1):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    yield "phone", m.start(), m.end()
        for kind, pattern, signs in (("ssn", _SSN, "-"), ("iban", _IBAN, ""), ("ip", _IPV6, ":")):
            for m in pattern.finditer(text) if kind != "ip" or ":" in text else ():
                if _bare(text, m.start(), signs):
                    yield kind, m.start(), m.end()
    for m in _TITLED.finditer(text):
        if _bare(text, m.start()):
            yield "name", m.start(1), m.end(1)
    if any(word in text for word in _INTRODUCERS):
        for m in _INTRODUCED.finditer(text):
            yield "name", m.start(1), m.end(1)


def _phone_ends(run: str) -> Iterator[int]:
    """Where a number may end in a run that took too much: after the last group with which it has 9 to 15 digits, of its first 40 characters."""
    n, ends = 0, []
    for m in _GROUP.finditer(run[:40]):
        n += len(m[0])
        if n > 15:
            break
        if n >= 9:
            ends.append(m.end())
    # Long runs mostly take up the next number after a blank: the shortest number of common length comes first.
    yield from ends[:1]


def _cards_within(run: str) -> Iterator[tuple[int, int]]:
    """Numbers of 13 to 19 digits with a right check digit within a longer run of groups, from the left, not overlapping."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(run)]
    k = 0
    while k < len(groups):
        digits = ""
        for j in range(k, min(k + 8, len(groups))):
            digits += run[groups[j][0] : groups[j][1]]
            if len(digits) > 19:
                break
            sizes = [b - a for a, b in groups[k : j + 1]]
            regular = len(sizes) == 1 or all(s == 4 for s in sizes[:-1]) and sizes[-1] <= 4 or sizes == [4, 6, 5]
            if len(digits) >= 13 and regular and _luhn(digits):
                yield groups[k][0], groups[j][1]
                k = j
                break
        k += 1


@dataclass
class Candidate:
    kind: int
    start: int
    stop: int
    base: bool
    votes: list[int]
    before: str
    value: str


def candidates(text: str) -> list[Candidate]:
    """The base spans and the wider ones that say more than these, with the votes of the labelers."""
    base = base_spans(text)
    out = [_judged(text, kind, start, end, True) for start, kind, end in base]
    flat = sorted((start, end, kind) for start, kind, end in base)
    starts = [x[0] for x in flat]
    longest = max((x[1] - x[0] for x in flat), default=0)
    seen = {(kind, start, end) for start, kind, end in base}
    for name, start, end in _wide_spans(text):
        kind = KINDS.index(name)
        # One that overlaps a base span must hold it and say more of the same kind.
        touched = [x for x in flat[bisect_right(starts, start - longest - 1) : bisect_right(starts, end - 1)] if x[1] > start]
        if (kind, start, end) in seen or any(x[2] != kind or x[0] < start or x[1] > end for x in touched):
            continue
        seen.add((kind, start, end))
        out.append(_judged(text, kind, start, end, False))
    return out


def _judged(text: str, kind: int, start: int, end: int, base: bool) -> Candidate:
    name, value, before = KINDS[kind], text[start:end], text[max(0, start - BEFORE) : start]
    digits = "".join(c for c in value if c.isdigit())
    form = check = gazetteer = SILENT
    if name == "email":
        form = FOR if base or "@" in value else SILENT
        tld = re.split(r"[^A-Za-z]+", value.rstrip("])}>"))[-1].lower()
        gazetteer = FOR if tld in _TLDS else AGAINST
        check = AGAINST if ".." in value or value.startswith(".") else FOR
    elif name == "ip":
        parts = value.split(".")
        form = FOR if len(parts) == 4 or value.count(":") == 7 else AGAINST
        check = AGAINST if len(parts) == 4 and any(len(p) > 1 and p[0] == "0" for p in parts) else FOR
        gazetteer = SILENT if len(parts) != 4 else AGAINST if int(parts[0].lstrip("0") or "0") == 0 else FOR
    elif name == "card":
        form = FOR if len(digits) in (15, 16) else AGAINST
        check = FOR if _luhn(digits) and len(set(digits)) > 2 else AGAINST
        gazetteer = FOR if digits[0] in "3456" or digits[:2] in ("22", "23", "24", "25", "26", "27") else AGAINST
    elif name == "phone":
        form = FOR if value[0] in "+(" else SILENT if digits.startswith("00") else AGAINST
        check = FOR if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else AGAINST
        code = digits[2:] if digits.startswith("00") else digits
        gazetteer = SILENT if value[0] != "+" and not digits.startswith("00") else FOR if any(code[:n] in _CALLING for n in (1, 2, 3)) else AGAINST
    elif name == "iban":
        plain = value.replace(" ", "")
        form, check = (FOR if len(plain) == _IBAN_LENGTH.get(plain[:2], -1) else AGAINST), FOR if _mod97(plain) else AGAINST
        gazetteer = FOR if plain[:2] in _IBAN_LENGTH else AGAINST
    elif name == "name":
        form = FOR
        gazetteer = FOR if value.split()[0].lower() in _GIVEN else SILENT
    elif name == "ssn":
        area = value[:3]
        check = AGAINST if area in ("000", "666") or area[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else FOR
    words_for = FOR if _WORDS_FOR[name].search(before) else SILENT
    words_against = AGAINST if _WORDS_AGAINST.search(before) else SILENT
    left, right = text[start - 1 : start], text[end : end + 1]
    edges = AGAINST if left.isalnum() or right.isalnum() or left in ("/", "=", "#", "_") or right in ("/", "_") else FOR
    return Candidate(kind, start, end, base, [form, check, gazetteer, words_for, words_against, edges], before, value)


def features(kind: int, base: bool, votes: list[int], before: str, value: str) -> list[float]:
    """What the final classifier sees: kind, votes, form, and the hashed word before."""
    out = [1.0] + [0.0] * (len(KINDS) + 2 * len(LABELERS) + 4 + NEIGHBOURS)
    out[1 + kind] = 1.0
    at = 1 + len(KINDS)
    for k, vote in enumerate(votes):
        if vote != SILENT:
            out[at + 2 * k + vote] = 1.0
    at += 2 * len(LABELERS)
    digits = sum(c.isdigit() for c in value)
    out[at : at + 4] = [min(len(value), 64) / 64, digits / len(value), float(base), float(value.isascii())]
    word = before.split()[-1].lower() if before.strip() else ""
    out[at + 4 + xxhash.xxh32_intdigest(word) % NEIGHBOURS] = 1.0
    return out


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 50) -> tuple[np.ndarray, dict[tuple[int, tuple[int, ...]], float]]:
    """Expectation-maximisation over counted vote patterns (kind, votes, count).

    Gives P(vote = for | the labeler votes, truth) as an array (labelers, 2) and the probability of each pattern. A few
    pseudo-counts say that labelers are better than chance, which fixes the meaning of the two classes.
    """
    if not patterns:
        return np.tile([0.2, 0.8], (len(LABELERS), 1)), {}
    kind = np.array([p[0] for p in patterns])
    votes = np.array([p[1] for p in patterns]).reshape(len(patterns), len(LABELERS))
    n = np.array([p[2] for p in patterns], float)
    cast = votes != SILENT
    truth = ((votes == FOR).sum(1) + 1) / (cast.sum(1) + 2)
    right = np.empty((len(LABELERS), 2))
    for _ in range(rounds):
        for label, weight in ((0, n * (1 - truth)), (1, n * truth)):
            yes = (weight[:, None] * (votes == FOR)).sum(0)
            right[:, label] = (yes + (8 if label else 2)) / ((weight[:, None] * cast).sum(0) + 10)
        prior = (np.bincount(kind, n * truth, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
        log = np.log(prior / (1 - prior))[kind]
        odds = np.where(votes == FOR, np.log(right[:, 1] / right[:, 0]), np.log((1 - right[:, 1]) / (1 - right[:, 0])))
        truth = 1 / (1 + np.exp(-np.clip(log + (odds * cast).sum(1), -30, 30)))
    return right, {(int(k), tuple(int(x) for x in v)): float(t) for k, v, t in zip(kind, votes, truth)}


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method with an L2 penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


_FOUND = "kind int, start int, stop int, base boolean, votes array<int>, before string, value string"
_FIELDS = [("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("before", pa.string()), ("value", pa.string())]


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct(_FIELDS))
    for batch in pieces_of(batches):
        found = [[x.__dict__ for x in candidates(text)] for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])


def _listed(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def chosen(found: list[dict], weights: np.ndarray | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans and of the candidates that the classifier takes; of overlapping ones the likeliest."""
    spans = [(x["start"], x["kind"], x["stop"]) for x in found if x["base"]]
    extra = [x for x in found if not x["base"]]
    if not extra or weights is None:
        return spans
    score = np.array([features(x["kind"], x["base"], x["votes"], x["before"], x["value"]) for x in extra]) @ weights
    starts, taken = [], []  # of those taken, which do not overlap, in the order of the text
    for k in np.argsort(-score, kind="stable"):
        own = extra[k]
        at = bisect_right(starts, own["start"])
        if score[k] >= 0 and not (at and taken[at - 1]["stop"] > own["start"]) and not (at < len(taken) and starts[at] < own["stop"]):
            starts.insert(at, own["start"])
            taken.insert(at, own)
    return spans + [(x["start"], x["kind"], x["stop"]) for x in taken]


def _write(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                own = batch.slice(at, 2_000)
                counts, digests, listed, added = [], [], [], []
                for found in own.column(1).to_pylist():
                    base = [(x["start"], x["kind"], x["stop"]) for x in found if x["base"]]
                    spans = chosen(found, weights)
                    counts.append(np.bincount([x[1] for x in base], minlength=len(KINDS))[: len(BASE_KINDS)] if base else np.zeros(len(BASE_KINDS), np.int64))
                    digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                    listed.append(_listed(spans))
                    added.append(len(spans) - len(base))
                columns = np.array(counts, np.int64).reshape(-1, len(BASE_KINDS)).T
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), *map(pa.array, columns), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(added, pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"],
                )

    return run


def learn(found: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The weights of the final classifier, from staged candidates; None where there are none."""
    one = found.select(F.explode("found").alias("x")).select("x.*")
    counted = one.groupBy("kind", "votes").agg(F.count("*").alias("n"))
    _, truth = reliabilities([(r.kind, tuple(r.votes), r.n) for r in counted.collect()])  # kinds x 3 ** labelers rows at most
    shown = one.select("kind", "base", "votes", "before", "value", F.xxhash64("kind", "start", "before", "value").alias("h")).orderBy("h", "value", "before").limit(sample).collect()
    if not shown:
        return None
    x = np.array([features(r.kind, r.base, r.votes, r.before, r.value) for r in shown])
    return fit(x, np.array([truth[(r.kind, tuple(r.votes))] for r in shown]))


def personal_data(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    found = stage(id_text(docs, id_col, text_col).mapInArrow(slim(_read), f"doc_id long, found array<struct<{_FOUND}>>"), "personal-data")
    shared = docs.sparkSession.sparkContext.broadcast(learn(found, sample))
    result = ", ".join(["doc_id long", *(f"n_{k} long" for k in BASE_KINDS), "base_sha256 string, spans string, n_added long"])
    return found.mapInArrow(slim(_write(shared)), result)
