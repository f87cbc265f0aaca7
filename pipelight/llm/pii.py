"""PII spans: base patterns, and further candidates that boosted trees accept.

The base kinds (email, ip, card, phone) are exact patterns.  On top of them high-recall generators
propose overlapping spans: secrets and keys, written-out e-mail addresses, phone numbers without a
plus sign, IBANs, social-security-like numbers, IPv6 addresses and cards that fail the check digit.
Features of a candidate's format (digits, letters, entropy, separators, lengths) and of the words
around it go to gradient-boosted trees; their scores are calibrated, and a kind's span is selected
if its probability reaches the kind's threshold, the least one at which held-out precision was
TARGET_PRECISION.  The model is trained here, once in each process, on synthetic text that a seeded
generator writes, positives and look-alikes in equal numbers; it depends on nothing in the corpus.
Selected spans that overlap a base span or a better candidate are dropped; base spans always stay.

Defined results: a null text is empty; ids may be null or repeated, each row is scanned whole; every
scan is linear in the text, whatever its length; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees, platt
from .common import lean, table

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the model may add, after the base kinds in the order of spans.
MODEL_KINDS = ("secret", "written_email", "local_phone", "iban", "ssn", "ipv6", "account")
KIND_ORDER = {k: i for i, k in enumerate((*BASE_KINDS, *MODEL_KINDS))}
TARGET_PRECISION = 0.98
TRAINING_ROWS = 6000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# From inside a run of digits nothing matches that doesn't match from its start, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds: leftmost matches of each, those that fail dropped."""
    found = []
    at = text.find("@")
    done = 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            found.append(("email", begin, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
                    found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub(r"[^0-9]", "", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end()))
    found.sort(key=lambda x: (x[1], KIND_ORDER[x[0]]))
    return found


#: High-recall generators: a kind's pattern, and characters of which a text must have one (None: any text).
GENERATORS = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{16,}+={0,2}(?![A-Za-z0-9_/+-])"), _DIGIT),
    ("written_email", re.compile(r"(?<![\w.])[A-Za-z0-9_-]{1,40}+(?:\.[A-Za-z0-9_-]{1,40}+){0,3} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,40}+(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?|\.)[A-Za-z0-9-]{2,40}+){1,3}"), re.compile(r"[(\[{ ]at[)\]} ]")),
    ("local_phone", re.compile(r"(?<![\w.+-])(?:\([0-9]{2,5}\)[ -]?|0?[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,5}(?![\w-])"), _DIGIT),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"), _DIGIT),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _DIGIT),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,7}(?![\w:.])"), re.compile(r":[0-9A-Fa-f]")),
    ("account", re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{13,19}(?![0-9A-Za-z.,-])"), _DIGIT),
)
#: Fixed words that stand before personal data or secrets, in groups that are features each.
CUES = (
    re.compile(r"\b(?:token|secret|passwor[dt]|passwd|pwd|api[_ -]?key|access[_ -]?key|auth\w*|bearer|credential\w*)\W{0,6}$", re.I),
    re.compile(r"\b(?:e-?mail|mail|contact|write|reach)\b[^\n]{0,16}$", re.I),
    re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|fon|telefon\w*|ring)\b[^\n]{0,12}$", re.I),
    re.compile(r"\b(?:iban|account|acct|konto|bank|card|visa|mastercard|payment|pay)\b[^\n]{0,16}$", re.I),
    re.compile(r"\b(?:ssn|social security|tax id|insurance)\b[^\n]{0,12}$", re.I),
    re.compile(r"\b(?:ip|ipv6|host|server|address|from)\b[^\n]{0,10}$", re.I),
    re.compile(r"\b(?:sha\d*|md5|commit|hash|digest|checksum|revision|version|isbn|doi|build|order|page|line|table|id|uuid|item|part)\b[^\n]{0,10}$", re.I),
)


def candidates(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern, needs in GENERATORS:
        if needs.search(text):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if kind != "secret" or _DIGIT.search(m.group())]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Of a candidate's format and of what stands around it."""
    span = text[start:end]
    n = end - start
    digits = sum(c.isdigit() for c in span)
    upper, lower = sum(c.isupper() for c in span), sum(c.islower() for c in span)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in span)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(span).values())
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False)) / n
    before, after = text[max(0, start - 40) : start], text[end : end + 3]
    numbers = re.sub(r"[^0-9]", "", span)
    words = re.split(r"[^A-Za-z]+", span)
    return [
        float(KIND_ORDER[kind]), n, digits / n, upper / n, lower / n, hexes / n, entropy, turns,
        float(n - digits - upper - lower), float(max(map(len, words), default=0)), float(luhn(numbers)) if numbers else 0.0, float(_iban(span)) if kind == "iban" else 0.0,
        float(bool(re.search(r"[=:]\s?[\"']?$", before))), float(before[-1:] in "\"'"), float(after[:1] in "\"'" and bool(after)), float(digits), float(before[-1:] == "."), float(span.startswith("eyJ")),
        *(float(bool(c.search(before))) for c in CUES),
    ]


def _iban(span: str) -> bool:
    s = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Synthetic:
    """Writes labelled candidates: (text, kind, start, end, label)."""

    FILLER = tuple("the of and to in was with for order table page report line see ref value made data found were chapter der die und les des que por una para".split())

    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def digits(self, n: int) -> str:
        return self.chars("0123456789", n)

    def words(self, n: int) -> str:
        return " ".join(self.chars("abcdefghijklmnoprstuvw", int(self.rng.integers(2, 9))) if self.rng.random() < 0.5 else self.pick(self.FILLER) for _ in range(n))

    def iban(self, valid: bool) -> str:
        body = self.digits(18)
        if valid:
            check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        else:
            check = int(self.rng.integers(10, 99))
        s = f"DE{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if self.rng.random() < 0.5 else s

    def long_secret(self, good: bool, cue: str) -> tuple[str, str]:
        """(cue before, span): keys and the later parts of signed tokens, against data, slugs and paths."""
        url = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
        base64 = url[:-2] + "+/"
        n = int(2 ** self.rng.uniform(6, 11))
        if good and self.rng.random() < 0.5:
            before = "eyJ" + self.chars(url, int(self.rng.integers(17, 60))) + "."
            if self.rng.random() < 0.5:
                return cue + before, "eyJ" + self.chars(url, n) + "." + self.chars(url, int(self.rng.integers(43, 400)))
            return cue + before + "eyJ" + self.chars(url, int(self.rng.integers(40, 400))) + ".", self.chars(url, n)
        if good:
            return cue, self.chars(self.pick(("0123456789abcdef", base64, url)), n) + self.pick(("", "", "=", "=="))
        return self.pick((
            (self.pick(("data:image/png;base64,", "src=data:font/woff;base64,", "image ", "")), self.chars(base64, n) + self.pick(("", "=", "=="))),
            (cue, self.chars("0123456789abcdef", self.pick((64, 96, 128)))),
            (self.pick(("see ", "www.host.org/", "")), "-".join(self.words(n // 6).split()) + "-" + self.digits(4)),
            (self.pick(("file ", "/", "")), "/".join(self.words(n // 6).split()) + "/" + self.digits(1)),
            (cue, self.digits(n)),
            (cue, self.pick("-_=+").replace("=", "_") * n + self.digits(2)),
        ))

    def row(self) -> tuple[str, str, bool]:
        """(cue before, span, label)"""
        r = self.rng.random
        hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        kind = self.pick(MODEL_KINDS)
        good = r() < 0.5
        if kind == "secret":
            cue = self.pick(("token = \"", "TOKEN = \"", "api_key: ", "password=", "secret = '", "Bearer ", "auth_token=\"", "access key ")) if good else self.pick(("", "", "commit ", "sha256 ", "see ", "file ", "version ", "id ", "checksum: "))
            if r() < 0.3:
                cue, span = self.long_secret(good, cue)
            elif good:
                span = self.chars(self.pick((hexes, hexes.upper(), mixed)), int(self.rng.integers(20, 65)))
            else:
                span = self.pick((self.chars(hexes, 40), self.chars(hexes, 32), "_".join(self.words(1).split() * 3) + self.digits(2), "-".join(self.words(4).split()) + "-" + self.digits(4), self.digits(18), "/".join(self.words(4).split()) + "/" + self.digits(1)))
        elif kind == "written_email":
            cue = self.pick(("write to ", "mail ", "contact: ", "")) if good else self.pick(("", "look ", "he was ", "sold "))
            name = self.chars("abcdefghijklmnop", int(self.rng.integers(3, 9)))
            host = self.pick(("mail", "example", "post", "web", "firma")) + self.pick(("", self.digits(1)))
            span = name + self.pick((" at ", " (at) ", "[at]", " [at] ")) + host + self.pick((" dot ", " [dot] ", "(dot)", ".")) + self.pick(("com", "org", "net", "de")) if good else self.pick(self.FILLER) + " at " + self.words(1).split()[0] + self.pick((". ", ".", " dot ")) + self.words(1).split()[0]
        elif kind == "local_phone":
            cue = self.pick(("call ", "Tel. ", "phone: ", "fax ", "mobile ")) if good else self.pick(("", "page ", "order ", "line ", "table ", "isbn "))
            span = self.pick((f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", f"{self.digits(3)}-{self.digits(3)}-{self.digits(4)}", f"0{self.digits(3)} {self.digits(3)} {self.digits(4)}"))
        elif kind == "iban":
            cue = self.pick(("IBAN ", "account ", "Konto: ", "")) if good else self.pick(("", "part ", "order ", "id "))
            span = self.iban(True) if good else self.pick((self.iban(False), self.chars("ABCDEFGHIJ", 2) + self.digits(2) + self.chars("ABCDEFGH0123456789", 12)))
        elif kind == "ssn":
            cue = self.pick(("SSN ", "social security ", "ssn: ")) if good else self.pick(("", "order ", "part ", "id ", "page "))
            span = f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}"
        elif kind == "ipv6":
            cue = self.pick(("ip ", "host ", "server ", "address ", "from ", ""))
            span = ":".join(self.chars(hexes, 4) for _ in range(8)) if good else self.pick((f"{self.digits(2)}:{self.digits(2)}:{self.digits(2)}", f"{self.digits(1)}:{self.digits(1)}:{self.digits(1)}"))
            cue = cue if good else self.pick(("", "at ", "from ", "page "))
        else:
            cue = self.pick(("card ", "Visa ", "payment: ", "account ", "bank account ")) if good else self.pick(("", "id ", "order ", "item ", "isbn ", "the ", "with "))
            span = self.digits(int(self.rng.integers(13, 20)))
        return kind, cue, span, good

    def rows(self, n: int):
        while n:
            kind, cue, span, good = self.row()
            head = self.words(int(self.rng.integers(2, 8))) + " " + cue
            text = head + span + self.pick(("\"", " ", " ", ". ", "\n")) + self.words(3)
            for found, start, end in candidates(text):
                if found == kind and start < len(head) + len(span) and end > len(head):
                    n -= 1
                    yield text, kind, start, end, good
                    break


@lru_cache(maxsize=1)
def model() -> tuple[BoostedTrees, tuple[float, float], dict[str, float]]:
    """(trees, calibration, thresholds by kind)."""
    rows = list(Synthetic(11).rows(TRAINING_ROWS))
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
    y = np.array([good for *_, good in rows], dtype=float)
    cut = len(rows) * 2 // 3
    trees = BoostedTrees().fit(x[:cut], y[:cut])
    raw = trees.raw(x[cut:])
    a, b = platt(raw, y[cut:])
    p = 1 / (1 + np.exp(-(a * raw + b)))
    thresholds = {}
    for kind in MODEL_KINDS:
        own = x[cut:, 0] == KIND_ORDER[kind]
        order = np.argsort(-p[own])
        right = np.cumsum(y[cut:][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= TARGET_PRECISION)
        thresholds[kind] = max(0.8, float(p[own][order][good[-1]])) if good.size else 2.0
    return trees, (a, b), thresholds


def find_spans(texts: list[str], trained: tuple | None = None) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int, float]]]]:
    """Base spans of each text, and the spans that the model adds with their probability."""
    base = [base_spans(t) for t in texts]
    rows = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    added: list[list] = [[] for _ in texts]
    if rows:
        trees, (a, b), thresholds = trained or model()
        p = 1 / (1 + np.exp(-(a * trees.raw(np.array([features(texts[i], k, s, e) for i, k, s, e in rows])) + b)))
        taken: dict[int, list[tuple[int, int]]] = {}
        for j in np.argsort(-p, kind="stable"):
            i, kind, start, end = rows[j]
            if p[j] >= thresholds[kind]:
                own = taken.setdefault(i, [(s, e) for _, s, e in base[i]])
                if all(end <= s or e <= start for s, e in own):
                    own.append((start, end))
                    added[i].append((kind, start, end, float(p[j])))
    return base, added


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(((x[0], x[1], x[2]) for x in spans), key=lambda x: (x[1], KIND_ORDER[x[0]])))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, base, probability>>, redacted) for each row; redacted:
    the text with every span replaced by its kind in brackets.  Offsets are code points.

    The model is trained once, on the driver, and goes to the workers as it is.
    """
    trained = model()

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            for at in range(0, len(raw), 256):
                texts = [(t or b"").decode("utf-8", "replace") for t in raw[at : at + 256]]
                base, added = find_spans(texts, trained)
                spans, redacted = [], []
                for t, own, more in zip(texts, base, added, strict=True):
                    every = sorted([(k, s, e, True, 1.0) for k, s, e in own] + [(k, s, e, False, p) for k, s, e, p in more], key=lambda x: (x[1], KIND_ORDER[x[0]]))
                    spans.append([{"kind": k, "start": s, "end": e, "base": is_base, "probability": p} for k, s, e, is_base, p in every])
                    out, done = [], 0
                    for k, s, e, *_ in every:
                        if e > done:
                            out += [t[done : max(s, done)], f"[{k}]"]
                            done = e
                    redacted.append("".join([*out, t[done:]]))
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(spans, kind), pa.array(redacted, pa.string())], names=["id", "spans", "redacted"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = dict(own.dtypes)["id"]
    return own.mapInArrow(lean(run), f"id {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean, probability: double>>, redacted string").withColumnRenamed("id", id_col)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    line = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
