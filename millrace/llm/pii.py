"""Personal data: exact patterns, and further spans that boosted trees choose among candidates.

The base kinds (email, ip, card, phone) follow fixed patterns and always stay.
Generators with high recall propose more spans, which may overlap; gradient
boosted trees weigh the form of a candidate and the words around it; a threshold
for each kind selects. The trees are trained here on ``EXAMPLES`` sentences made
from a seed, since the tables have no labelled spans; thresholds are set on
sentences of other templates, whose words and forms training has not seen.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, lean

EXAMPLES, TREES, DEPTH, RATE, BINS, PRECISION = 6000, 40, 3, 0.3, 32, 0.98
KINDS = ("email", "ip", "card", "phone", "secret", "national_id", "iban", "local_phone", "spelled_email")
BASE = KINDS[:4]
RESULT = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,n_spans:bigint,spans:string,redacted:string>"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: Digits never give back: whatever follows a run of digits in these patterns is no digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    """Each @ decides on its own: the match starts where the run of local characters before it does, but not in an earlier match."""
    free, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > free:  # back in steps, so that a long run costs its length once
            step = max(free, low - 64)
            bad = [m.end() for m in _NOT_LOCAL.finditer(text, step, low)]
            if bad:
                low = step + (bad[-1] - step)
                break
            low = step
        domain = _DOMAIN.match(text, at + 1)
        if low < at and domain:
            yield low, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


_OPENS = re.compile(r"[:=]++\s{0,3}[\"']?")
_VALUE = re.compile(r"[^\s\"']*+")
#: An assigned or named value has so many characters at least; none of the generators of secrets has a most.
LEAST = 4
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{16,}+|[0-9a-fA-F]{32,}+)(?![A-Za-z0-9_-])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]*+")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=:,\s]|-(?!-))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----)?")
_NAMED = re.compile(r"(?i:\b(?:pass(?:word|wd|code|phrase)|pwd|pin|token|secret|api key|access key|credentials?) (?:is|was|are|set to) [\"']?)([^\s\"']++)")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{2,64})+")

_SAID = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{1,64}(?: dot [A-Za-z0-9_%+-]{1,64}){0,4} at [A-Za-z0-9-]{1,64}(?: dot [A-Za-z0-9-]{2,64})+")


def _assigned(text: str):
    """Every run of : and = opens a value up to the next blank or quote; a value with such signs inside has others within it, which share its end."""
    end = 0
    for m in _OPENS.finditer(text):
        start = m.end()
        if start >= end:
            end = _VALUE.match(text, start).end()
        if end - start >= LEAST:
            yield start, 4, end


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that might be personal; spans of different generators may overlap."""
    out = []
    digit = _DIGIT.search(text) is not None
    if "=" in text or ":" in text:
        out += [(a, b, k) for a, k, b in _assigned(text)]
    out += [(*m.span(), 4) for m in _TOKEN.finditer(text)]
    if "eyJ" in text:
        out += [(*m.span(), 4) for m in _JWT.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [(*m.span(), 4) for m in _KEY_BLOCK.finditer(text)]
    for m in _NAMED.finditer(text):
        low, high = m.span(1)
        high -= len(m.group(1)) - len(m.group(1).rstrip(".,;!?)"))  # the end of a sentence is no part of the value
        if high - low >= LEAST:
            out.append((low, high, 4))
    if digit:
        out += [(*m.span(), 6) for m in _IBAN.finditer(text)]
        out += [(*m.span(), 7) for m in _LOCAL_PHONE.finditer(text)]
        if "-" in text:
            out += [(*m.span(), 5) for m in _NATIONAL.finditer(text)]
    if "at]" in text or "at)" in text:
        out += [(*m.span(), 8) for m in _SPELLED.finditer(text)]
    if " at " in text and " dot " in text:
        out += [(*m.span(), 8) for m in _SAID.finditer(text)]
    return sorted({(a, k, b) for a, b, k in out})


#: Words that stand before a span: what they speak for.
_WORDS = [
    re.compile(r"token|secret|passw|pwd|api.?key|access.?key|credential", re.I),
    re.compile(r"ssn|social|passport|iban|account|tax|national|identity", re.I),
    re.compile(r"tel|phone|call|mobile|fax|dial", re.I),
    re.compile(r"commit|version|sha|md5|isbn|order|part|ref|invoice|page|serial|digest|revision|checksum", re.I),
]


#: Endings of host names that are frequent in addresses.
_ENDING = re.compile(r"[ .)\]](?:com|org|net|edu|gov|de|fr|es|uk|info|io)\Z", re.I)


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in "\"'" else 3


_LETTERS = string.ascii_letters


class _Tail:
    """What the features need of the characters before one end; the start only moves back, so spans within one another cost their length once."""

    def __init__(self, end: int):
        self.start, self.counts, self.digits, self.upper, self.lower = end, Counter(), 0, 0, 0
        self.lead, self.longest, self.plain, self.n_plain, self.hex = 0, 0, "", 0, True

    def back_to(self, text: str, start: int) -> None:
        s, self.start = text[start : self.start], start
        if not s:
            return
        self.counts.update(s)
        self.digits += sum(map(str.isdigit, s))
        self.upper += sum(map(str.isupper, s))
        self.lower += sum(map(str.islower, s))
        last = len(s) - len(s.rstrip(_LETTERS))
        self.longest = max(self.longest, last + self.lead, max(map(len, re.findall(r"[A-Za-z]+", s)), default=0))
        self.lead = last + self.lead if last == len(s) else len(s) - len(s.lstrip(_LETTERS))
        plain = re.sub(r"[^A-Za-z0-9]", "", s).upper()
        self.n_plain += len(plain)
        self.plain = plain + self.plain if self.n_plain <= 34 else ""
        self.hex = self.hex and re.fullmatch(r"[0-9a-fA-F]+", s) is not None


def features(text: str, found: list[tuple[int, int, int]]) -> np.ndarray:
    """A row for each of the sorted candidates."""
    rows, tails = [], {}
    for start, kind, end in reversed(found):
        n, before = end - start, text[max(0, start - 28) : start]
        t = tails.setdefault(end, _Tail(end))
        t.back_to(text, start)
        ok97 = 15 <= len(t.plain) <= 34 and int("".join(str(int(c, 36)) for c in t.plain[4:] + t.plain[:4])) % 97 == 1
        rows.append([
            *(float(kind == k) for k in range(4, len(KINDS))), n, t.digits / n, t.upper / n, t.lower / n,
            -sum(c / n * math.log2(c / n) for c in t.counts.values()), len(t.counts), t.longest,
            _side(text[start - 1 : start] if start else ""), _side(text[end : end + 1]), *(float(bool(w.search(before))) for w in _WORDS),
            float(ok97), float(t.hex), float(re.search(r"[:=]\s*[\"']?\Z", before) is not None), t.n_plain,
            float(re.search(r"(?i:pass\w*|pwd|pin|token|secret|key|credentials?)[\"']?\s*(?:[:=]+|is|was|are|set to)\s*[\"']?\Z", before) is not None),
            float(text.startswith(("eyJ", "AKIA", "gh", "sk-", "-----BEGIN"), start)), float(kind == 8 and _ENDING.search(text, max(start, end - 8), end) is not None),
        ])
    return np.array(rows[::-1])


def examples(n: int = EXAMPLES, seed: int = 5, other: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of the candidates in n made-up sentences, half of them with a personal span; ``other`` takes the templates that training has not seen."""
    rng = random.Random(seed)
    pick = rng.choice
    some = lambda chars, a, b: "".join(pick(chars) for _ in range(rng.randint(a, b)))
    word = lambda: some("aeiou", 0, 1) + "".join(pick(["th", "er", "on", "an", "re", "le", "de", "ion", "st"]) for _ in range(rng.randint(1, 4)))
    digits = lambda k: some("0123456789", k, k)
    hexes = lambda: some("0123456789abcdef", *(pick([(32, 32), (40, 40), (64, 64)])))

    def iban():
        country, body = pick(["DE", "FR", "GB", "ES"]), digits(pick([14, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    def case() -> tuple[str, str, bool]:
        mark, quote = pick([" = ", ": ", "=", ":"]), pick(['"', "'", ""])
        good = [
            lambda: (pick(["token", "api_key", "secret", "access key", "Token"]) + mark + quote, pick([hexes(), some("ABCDEFGHabcdefgh0123456789_-", 16, 44)])),
            lambda: (pick(["password", "passwd", "pwd"]) + mark + quote, pick([some("abcdefgXYZ0123456789!#%", 8, 20), some("abcXYZ0123456789!#", 1, 9) + pick("=:") + some("abcXYZ0123456789!#=:", 8, 20)])),
            lambda: (pick(["token", "api_key", "secret", "access_token", "Token", "credential"]) + mark + quote, some(_LETTERS + "0123456789_-", 60, 400) + pick(["", "=", "==", "." + some(_LETTERS + "0123456789_-", 40, 400)])),
            lambda: (pick(["", "key ", "use "]), pick(["sk-" + some(_LETTERS + "0123456789", 81, 400), "ghp_" + some(_LETTERS + "0123456789", 81, 400)])),
            lambda: (pick(["", "key ", "use "]), pick(["AKIA" + some("ABCDEFGHJKLMNPQ234567", 16, 16), "ghp_" + some("abcdefABCDEF0123456789", 36, 36), "sk-" + some("abcdefABCDEF0123456789", 24, 48)])),
            lambda: (pick(["SSN ", "social security ", "ssn: ", "tax id "]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
            lambda: (pick(["IBAN ", "account ", ""]), iban()),
            lambda: (pick(["call ", "phone ", "tel. ", "mobile: ", "fax "]), pick(["({}) {}-{}", "{}-{}-{}", "{} {} {}"]).format(digits(3), digits(3), digits(4))),
            lambda: (pick(["mail ", "write to ", ""]), f"{word()}.{word()}" + pick([" [at] ", "(at)", " (at) ", "[at]"]) + f"{word()}" + pick([".", " [dot] ", "(dot)"]) + pick(["com", "org", "net"])),
        ]
        bad = [
            lambda: (pick(["commit ", "sha ", "md5: ", "digest = ", "checksum: ", "revision "]) + quote, hexes()),
            lambda: (pick([word() + ": ", word() + " = ", "note: ", "title: ", "see: "]) + quote, pick([word() + word() + word(), word() + "-" + word() + word(), "https", "//" + word() + ".com/" + word() + word()])),
            lambda: (pick(["", word() + ": ", "see: ", "url=", "link = "]) + quote, "https://" + word() + ".com/" + "/".join(word() for _ in range(rng.randint(1, 20))) + pick(["", "?" + "&".join(word() + "=" + word() for _ in range(rng.randint(1, 20)))])),
            lambda: (pick(["integrity: ", "digest: ", "checksum = "]) + quote, "sha512-" + some(_LETTERS + "0123456789+/", 86, 86) + "=="),
            lambda: (pick(["order ", "part ", "invoice ", "ref ", "serial ", word() + " "]), pick([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(3)}"])),
            lambda: (pick([word() + " ", "isbn ", "page "]), pick(["{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(digits(pick([2, 3, 4])), digits(pick([3, 4])), digits(pick([3, 4])))),
            lambda: (pick([word() + " ", "model ", "version "]), pick(["AB", "ZX", "DE"]) + digits(2) + " " + digits(4) + " " + digits(4)),
            lambda: (word() + " ", word() + " (at) " + word() + ". " + word()),
            lambda: (pick([word() + ": ", word() + "="]), some("0123456789", 8, 20)),
        ]
        jwt = lambda: "eyJ" + ".".join(some(_LETTERS + "0123456789_-", 20, 120) for _ in range(3))
        block = lambda: f"-----BEGIN {pick(['RSA ', 'EC ', ''])}PRIVATE KEY-----" + pick(["", "\n" + some(_LETTERS + "0123456789+/", 64, 300) + "\n-----END PRIVATE KEY-----"])
        said = lambda: pick([word(), word() + " dot " + word()]) + " at " + word() + " dot " + pick(["com", "org", "net", "de"])
        good += [
            lambda: (pick(["", "cookie ", "use "]), jwt()),
            lambda: (pick(["", "key ", word() + " "]), block()),
            lambda: (pick(["my password is ", "the passcode is ", "pwd was ", "api key is ", "token set to "]), pick([some("abcdefgXYZ0123456789!#", 5, 16), word() + digits(rng.randint(1, 4)) + some("xyz!", 0, 3)])),
            lambda: (pick(["password: ", "pwd=", "pin: ", "passwd = "]), some("abcdXYZ0123456789", 4, 7)),
            lambda: (pick(["mail ", "", "reach "]), said()),
        ]
        bad += [
            lambda: (pick([word() + ": ", word() + "=", word() + " = "]), pick([word(), some("0123456789", 4, 7), word() + ","])),
            lambda: (pick(["the password is ", "a token is ", "the secret was "]), pick(["required", "not", "never", "stored", "kept", "hashed", "only", "sent", "valid", "expired", "shown", "rotated"])),
            lambda: (word() + " ", word() + " at " + word() + " dot " + word() + " " + word()),
            lambda: (word() + " ", f"-----BEGIN {pick(['CERTIFICATE', 'PUBLIC KEY'])}-----"),
        ]
        unseen_good = [
            lambda: (pick(["authorization: bearer ", "x-secret: ", "access token: ", "client_secret = ", "AUTH_TOKEN="]) + quote, pick([some(_LETTERS + "0123456789", 20, 60), hexes(), jwt()])),
            lambda: (pick(["my passphrase is ", "credentials are ", "the pin is ", "new password was "]), some("abcdefgXYZ0123456789!#%", 5, 14)),
            lambda: (pick(["login password=", "root pwd: ", "wifi passcode: "]), some("abcdefgXYZ0123456789", 6, 12)),
            lambda: (pick(["deploy ", "with "]), pick(["sk-" + some(_LETTERS, 30, 60), "gho_" + some(_LETTERS, 36, 36), block()])),
            lambda: (pick(["social security number ", "SSN# ", "identity no. "]), f"{digits(3)}-{digits(2)}-{digits(4)}"),
            lambda: (pick(["bank account ", "transfer to ", "pay into "]), iban()),
            lambda: (pick(["telephone ", "dial ", "phone number: ", "mobile no. "]), pick(["({}) {}-{}", "{}-{}-{}", "{} {} {}"]).format(digits(3), digits(3), digits(4))),
            lambda: (pick(["contact ", "ask "]), pick([said(), f"{word()}_{word()}(at){word()}(dot)com", f"{word()}[at]{word()}.org"])),
        ]
        unseen_bad = [
            lambda: (pick(["build ", "etag: ", "md5sum ", "serial = ", "tree "]) + quote, hexes()),
            lambda: (pick(["ticket ", "tracking ", "case ", "order no. "]), pick([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"])),
            lambda: (pick(["date: ", "time=", "name: ", "size = ", "lang: ", "id="]), pick([word(), f"{digits(4)}-{digits(2)}-{digits(2)}", digits(6), word() + word() + ".html", "http://" + word() + ".org/" + word()])),
            lambda: (pick(["password is ", "the token was ", "secret is "]), pick(["missing", "empty", "optional", "reset", "unknown", "generated", "encrypted", "changed"])),
            lambda: (pick(["lot ", "unit "]), pick(["AB", "ZX", "QX"]) + digits(2) + " " + digits(4) + " " + digits(4)),
            lambda: (word() + " ", pick([word() + " at " + word() + " dot " + word(), word() + " (at) " + word() + ". " + word()])),
        ]
        truth = rng.random() < 0.5
        return *pick((unseen_good if other else good) if truth else unseen_bad if other else bad)(), truth

    x, y, kinds = [], [], []
    for _ in range(n):
        lead, span, truth = case()
        head = " ".join(word() for _ in range(rng.randint(0, 8))) + " " + lead
        text = head + span + pick(['"', "'", "", "", "."]) + " " + " ".join(word() for _ in range(rng.randint(0, 6)))
        found = candidates(text)
        for (start, kind, end), row in zip(found, features(text, found), strict=True):
            if truth and kind == 4 and len(head) < start < len(head) + len(span):
                continue  # a value within the true one: find() takes the outer one
            x.append(row)
            y.append(float(truth and start < len(head) + len(span) and end > len(head) and end - start >= len(span) - 2))
            kinds.append(kind)
    return np.array(x), np.array(y), np.array(kinds)


@dataclass
class Trees:
    """Boosted trees of a fixed depth: feature, threshold and leaf values in heap order."""

    prior: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    thresholds: dict[int, float]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
            total += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def _tree(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = 2**DEPTH - 1
    feature, cut, at = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(len(x), int)
    for node in range(nodes):
        own = at == node
        g, h, best = gradient[own].sum(), weight[own].sum(), 1e-6
        for f, values in enumerate(cuts):
            bin_of = np.searchsorted(values, x[own, f], "left")
            gl = np.cumsum(np.bincount(bin_of, gradient[own], len(values) + 1))[:-1]
            hl = np.cumsum(np.bincount(bin_of, weight[own], len(values) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if len(gain) and gain.max() > best:
                best, feature[node], cut[node] = gain.max(), f, values[gain.argmax()]
        at[own] = 2 * node + 1 + (x[own, feature[node]] > cut[node])
    leaf = at - nodes
    g, h = np.bincount(leaf, gradient, 2**DEPTH), np.bincount(leaf, weight, 2**DEPTH)
    return feature, cut, RATE * g / (h + 1)


@lru_cache(maxsize=1)
def model() -> Trees:
    """The trees, with thresholds from sentences of other templates: the least share at which a kind keeps its precision, 0.5 at least."""
    a, t, _ = examples()
    cuts = [np.unique(np.quantile(a[:, f], np.linspace(0, 1, BINS + 1)[:-1])) for f in range(a.shape[1])]
    prior = float(np.log(t.mean() / (1 - t.mean())))
    total, trees = np.full(len(t), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        trees.append(_tree(a, cuts, t - p, p * (1 - p)))
        one = Trees(0.0, *(np.stack([v]) for v in trees[-1]), {})
        p = one.probabilities(a)
        total += np.log(p / (1 - p))
    out = Trees(prior, *(np.stack(v) for v in zip(*trees, strict=True)), {})
    x, y, kinds = examples(EXAMPLES // 2, 6, other=True)
    p = out.probabilities(x)
    for kind in range(4, len(KINDS)):
        mine, truth = p[kinds == kind], y[kinds == kind]
        out.thresholds[kind] = next((c for c in np.arange(0.5, 1, 0.01) if (mine >= c).any() and truth[mine >= c].mean() >= PRECISION), 0.99)
    return out


def quality_by_kind(trees: Trees, n: int = 3000, seed: int = 77) -> dict[str, tuple[float, float, float]]:
    """(threshold, precision, recall) of each added kind on new sentences of the templates that training has not seen."""
    x, y, kinds = examples(n, seed, other=True)
    p, out = trees.probabilities(x), {}
    for kind in range(4, len(KINDS)):
        own = kinds == kind
        chosen, truth = p[own] >= trees.thresholds[kind], y[own] > 0
        out[KINDS[kind]] = (float(trees.thresholds[kind]), float(truth[chosen].mean()) if chosen.any() else 1.0, float(chosen[truth].mean()) if truth.any() else 1.0)
    return out


def find(text: str, trees: Trees) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: chosen candidates join where they overlap neither a base span nor a likelier candidate."""
    base = base_spans(text)
    found = candidates(text)
    if not found:
        return base, base
    p = trees.probabilities(features(text, found))
    every = list(base)
    # secrets with one end rank as the likeliest of them, the longest first
    rank: dict[int, float] = {}
    for (_, kind, end), q in zip(found, p.tolist(), strict=True):
        if kind == 4 and q >= trees.thresholds[kind]:
            rank[end] = max(rank.get(end, 0.0), q)
    first = lambda k: (-rank.get(found[k][2], p[k]) if found[k][1] == 4 else -p[k], k)
    for k in sorted(range(len(found)), key=first):
        start, kind, end = found[k]
        if p[k] >= trees.thresholds[kind] and all(b <= start or end <= a for a, _, b in every):
            every.append(found[k])
    return base, sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Text with each span as its kind in brackets; where spans overlap, the union takes the first one's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join((*out, text[at:]))


def _finder(trees, redacting: bool):
    @F.arrow_udf(RESULT)
    def run(text: pa.Array) -> pa.Array:
        rows = []
        for t in text:
            t = t.as_py()
            base, every = find(t, trees.value)
            n = Counter(k for _, k, _ in base)
            rows.append({**{f"n_{name}": n[k] for k, name in enumerate(BASE)}, "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "n_spans": len(every), "spans": joined(every), "redacted": redact(t, every) if redacting else None})
        longs = [(f"n_{k}", pa.int64()) for k in BASE]
        return pa.array(rows, pa.struct([*longs, ("base_sha256", pa.string()), ("n_spans", pa.int64()), ("spans", pa.string()), ("redacted", pa.string())]))

    return run


def scan(docs: DataFrame, redacting: bool = True, column: str = "pii") -> DataFrame:
    """docs with a struct of counts, digest, spans and the redacted text; a null text counts as empty.

    Offsets count code points. Rows are independent of one another, so repeated
    rows, null ids and other columns need no care; an empty table stays empty.
    """
    trees = lean(docs).sparkSession.sparkContext.broadcast(model())
    return docs.withColumn(column, _finder(trees, redacting)(F.coalesce(F.col("text"), F.lit(""))))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of every row of docs (doc_id, text, …).

    A null text counts as empty and has no span; ``n_spans`` counts all spans,
    base ones and chosen ones. Rows are independent of one another. A very long
    text costs its length. Other columns are not read. An empty table gives no rows.
    """
    return scan(docs.select("doc_id", "text"), False).select("doc_id", *(f"pii.n_{k}" for k in BASE), "pii.base_sha256", "pii.spans", "pii.n_spans")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of the text masked; null texts stay null, other columns stay as they are."""
    found = fresh(docs, "found")
    return scan(docs, True, found).withColumn("text", F.when(F.col("text").isNotNull(), F.col(f"{found}.redacted"))).drop(found)
