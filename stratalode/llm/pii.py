"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds."""

from __future__ import annotations

import ipaddress
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, only, read, slices, small_batches, stage

KINDS = ("email", "ip", "card", "phone", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match takes whole runs of digits, so it begins one
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Texts without any of these characters hold no base span and no candidate.
_SIGNS = re.compile(r"[0-9@=:]|\(at\)|\[at\]")
_GENERATORS = (
    ("email", re.compile(r"\s?(?:@|\(at\)|\[at\])\s?[\w-]++(?:(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?)[\w-]++)+|(?:\s?(?:\.|\(dot\)|\[dot\])\s?[\w-]++)+)")),  # behind a local part
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.])")),
    ("card", re.compile(r"(?<![\w])[0-9]{4}(?:[ .-]?[0-9]{3,6}){2,4}(?!\w)")),
    ("phone", re.compile(r"(?<![\w])[(+]?[0-9][0-9 ()./-]{5,22}[0-9](?!\w)")),
    ("secret", re.compile(r"(?<=[=:])\s?[\"']?[\w+/=-]{8,}+|(?<![\w+/-])[A-Za-z0-9+/_-]{12,}+(?!\w)")),
)
_CUES = tuple(re.compile(x) for x in (r"mail|contact", r"\bip\b|host|server|addr", r"card|visa|credit|account|iban", r"tel|phone|call|mobile|fax|whats", r"pass|pwd|secret|token|key|auth|bearer", r"[=:]\s?[\"']?\Z"))
_HIDDEN_AT, _HIDDEN_DOT = re.compile(r"\s?(?:\(at\)|\[at\])\s?"), re.compile(r"\s?(?:\(dot\)|\[dot\])\s?")
_MAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_CALLED = re.compile(r"\b(?:tel|telephone|phone|call|mobile|fax|whatsapp)\b[^\w]{0,4}(?:(?:me|us|at|on|is|number|no)\b[^\w]{0,4}){0,2}\Z")
_PAID = re.compile(r"\b(?:card|visa|mastercard|amex|credit)\b")
_HOST = re.compile(r"\b(?:ip|ipv6|host|server|addr|address)\b")
_DATE = re.compile(r"[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}")


@dataclass(frozen=True)
class Boost:
    """The classifier learns from at most max_train candidates, those of least hash over all texts; everything else
    covers all rows. precision: what the calibrated threshold of each kind aims at on held-out candidates."""

    max_train: int = 20_000
    trees: int = 60
    depth: int = 3
    bins: int = 32
    rate: float = 0.15
    precision: float = 0.9
    context: int = 32


def _number(x: str) -> int:
    """The value of a digit string; a string with over nine digits that count is just large."""
    x = x.lstrip("0")
    return int(x or "0") if len(x) < 10 else 1 << 30


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed patterns, leftmost and without overlap within a kind; failing matches are dropped."""
    out = []
    if not _SIGNS.search(text):
        return out
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):  # a local part is the run of its characters in front, from the last match on
            at = m.start()
            begin = at
            while begin > last and (text[begin - 1] in "._%+-" or text[begin - 1].isascii() and text[begin - 1].isalnum()):
                begin -= 1
            if begin < at:
                out.append((begin, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(_number(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything a generator proposes; spans of different kinds may overlap."""
    if not _SIGNS.search(text):
        return []
    out = []
    for kind, (name, pattern) in enumerate(_GENERATORS):
        if name == "email" and "@" not in text and "at)" not in text and "at]" not in text:
            continue
        last = 0
        for m in pattern.finditer(text):
            begin, end = m.start(), m.end()
            if name == "email":
                while begin > last and (text[begin - 1] in ".%+-_" or text[begin - 1].isalnum()):
                    begin -= 1
                if begin == m.start():
                    continue
                last = end
            elif name == "secret" and (not begin or text[begin - 1] not in "=:") and not any(map(str.isdigit, m[0][:-11])):
                continue
            else:
                begin += len(m[0]) - len(m[0].lstrip(" \"'"))
            out.append((begin, kind, end))
    return sorted(set(out))


FEATURES = 24


def describe(text: str, start: int, kind: int, end: int, context: int) -> list[float]:
    """Format and context of a span. What labels the examples is not among them: no checksum or range, and for a secret
    not the words that lead to one."""
    s = text[start:end]
    n = max(len(s), 1)
    digits, letters, upper = sum(map(str.isdigit, s)), sum(map(str.isalpha, s)), sum(map(str.isupper, s))
    groups = re.findall(r"[0-9]+", s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    before, after = text[max(0, start - context) : start].lower(), text[end : end + 1]
    cues = [float(bool(p.search(before)) and not (kind == 4 and i == 4)) for i, p in enumerate(_CUES)]
    return [
        float(kind), float(n), float(digits), float(letters), upper / n, digits / n, float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("@")), float(s.count("+")), float(s.count(":")), entropy,
        float(ord(text[start - 1]) if start and ord(text[start - 1]) < 128 else 0), float(ord(after) if after and ord(after) < 128 else 0), *cues,
    ]


def evident(text: str, start: int, kind: int, end: int) -> bool:
    """Evidence of a candidate that needs no base span: an email address once signs are put for (at) and (dot), an IPv6
    address that parses (with few groups, after a word for a host), digits that pass the checksum of a card in four
    groups or after a word for a card, a number that a word for a telephone leads to."""
    s = text[start:end]
    if kind == 0:
        plain = _HIDDEN_DOT.sub(".", _HIDDEN_AT.sub("@", s))
        return plain != s and bool(_MAIL.fullmatch(plain))
    if kind == 1:
        if ":" not in s:
            return False
        try:
            ipaddress.IPv6Address(s)
        except ValueError:
            return False
        return any(map(str.isdigit, s)) and (s.count(":") > 3 or bool(_HOST.search(text[max(0, start - 24) : start].lower())))
    digits = re.sub(r"[^0-9]", "", s)
    if kind == 2:
        if not (13 <= len(digits) <= 19 and luhn(digits)):
            return False
        return bool(re.fullmatch(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", s) or _PAID.search(text[max(0, start - 24) : start].lower()))
    return kind == 3 and 7 <= len(digits) <= 15 and not _DATE.fullmatch(s) and bool(_CALLED.search(text[max(0, start - 32) : start].lower()))


def _weak_label(text: str, start: int, kind: int, end: int, base: list) -> int:
    """1: a base span of the kind lies in it, it is evident, or a keyword assigns it as a secret; 0: none of these."""
    if kind == 4:
        return int(bool(_CUES[4].search(text[max(0, start - 24) : start].lower())) and any(map(str.isdigit, text[start:end])))
    return int(any(k == kind and a >= start and b <= end for a, k, b in base) or evident(text, start, kind, end))


def _examples(b: Boost):
    def run(batches):
        for batch in batches:
            for rows, _, _ in slices(batch):
                marks, labels, values = [], [], []
                for doc, text in zip(column(batch, "doc_id")[rows].to_pylist(), column(batch, "text")[rows].to_pylist(), strict=True):
                    found = candidates(text or "")
                    base = base_spans(text) if found else []
                    for start, kind, end in found:
                        marks.append(f"{doc}:{start}:{kind}:{end}")
                        labels.append(_weak_label(text, start, kind, end, base))
                        values.append(describe(text, start, kind, end, b.context))
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(labels, pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["mark", "label", "x"])

    return run


@dataclass
class Trees:
    """Boosted trees over binned features, a Platt scale, and the threshold of each kind."""

    edges: list = field(default_factory=list)
    nodes: list = field(default_factory=list)  # a tree: (feature, bin, value) of each node, in heap order
    bias: float = -10.0
    scale: float = 1.0
    shift: float = 0.0
    limits: list = field(default_factory=lambda: [2.0] * len(KINDS))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if len(x) else np.empty((0, len(self.edges)), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if len(x) and self.nodes:
            b = self.binned(x)
            for feature, split, value in self.nodes:
                at = np.zeros(len(x), int)
                for _ in range(int(math.log2(len(feature) + 1)) - 1):
                    at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > split[at])
                z += value[at]
        return z

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margin(x) + self.shift, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, b: Boost) -> Trees:
    """Gradient boosting of the logistic loss on histograms; every fifth row is kept for calibration."""
    out = Trees()
    if len(y) < 40 or y.min() == y.max():
        return out
    out.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, b.bins + 1)[1:-1])) for j in range(x.shape[1])]
    fit = np.arange(len(y)) % 5 > 0
    binned, target = out.binned(x)[fit], y[fit]
    out.bias = float(np.log(target.mean() / (1 - target.mean()))) if 0 < target.mean() < 1 else 0.0
    z = np.full(len(target), out.bias)
    size = 2 ** (b.depth + 1) - 1
    for _ in range(b.trees):
        p = 1 / (1 + np.exp(-z))
        grad, curve = target - p, p * (1 - p) + 1e-6
        feature, split, value, at = np.zeros(size, int), np.full(size, b.bins), np.zeros(size), np.zeros(len(target), int)
        for node in range(2**b.depth - 1):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, b.bins)
            if len(rows) >= 10:
                g, h = grad[rows], curve[rows]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for j in range(x.shape[1]):
                    left_g = np.cumsum(np.bincount(binned[rows, j], g, b.bins))
                    left_h = np.cumsum(np.bincount(binned[rows, j], h, b.bins))
                    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1) - whole
                    k = int(gain[:-1].argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            _, feature[node], split[node] = best
            at[rows] = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
        total_g, total_h = np.bincount(at, grad, size), np.bincount(at, curve, size)
        value = b.rate * total_g / (total_h + 1)
        value[: 2**b.depth - 1] = 0
        z += value[at]
        out.nodes.append((feature, split, value))
    rest = ~fit
    m = out.margin(x[rest])
    for _ in range(100):  # Platt scaling on rows that no tree has seen
        p = 1 / (1 + np.exp(-np.clip(out.scale * m + out.shift, -40, 40)))
        gap, curve = p - y[rest], p * (1 - p) + 1e-3
        out.scale -= 0.5 * ((gap * m).mean() + 1e-3 * (out.scale - 1)) / ((curve * m**2).mean() + 1e-3)
        out.shift -= 0.5 * (gap.mean() + 1e-3 * out.shift) / (curve.mean() + 1e-3)
        out.scale = max(out.scale, 0.05)
    chance = out.chance(x[rest])
    for kind in range(len(KINDS)):
        own = x[rest, 0] == kind
        order = np.argsort(-chance[own])
        right = np.cumsum(y[rest][own][order])
        n = np.arange(1, len(order) + 1)
        good = np.flatnonzero(right - 1 >= b.precision * n - 1) if len(order) else []
        # the lowest chance that still keeps the precision; never below even odds
        out.limits[kind] = max(0.5, float(chance[own][order][good[-1]])) if len(good) and right[good[-1]] else 2.0
    return out


def fit(docs: DataFrame, b: Boost = Boost()) -> Trees:
    """Learns from the candidates of documents (doc_id, text): those of least hash, at most max_train of them."""
    small_batches(docs.sparkSession)
    rows = only(docs, "doc_id", "text").where("text is not null").mapInArrow(_examples(b), "mark string, label int, x array<double>")
    # by way of a staged table, so that no task's share of the rows goes to the driver
    rows = stage(rows.orderBy(F.xxhash64("mark"), "mark").limit(b.max_train), "examples").collect()
    return boost(np.array([r["x"] for r in rows], float).reshape(-1, FEATURES), np.array([r["label"] for r in rows], float), b)


def spans(text: str, model: Trees, context: int, found: list | None = None, chance=None) -> tuple[list, list]:
    """(base spans, all spans) of a text: base ones stay; then evident candidates, then likely ones, are added that
    overlap nothing chosen."""
    base = base_spans(text)
    found = candidates(text) if found is None else found
    if not found:
        return base, base
    chance = model.chance(np.array([describe(text, *x, context) for x in found])) if chance is None else chance
    every, taken = list(base), [(a, e) for a, _, e in base]
    # a table of too few candidates to learn from still has its secrets found, by the words that lead to them
    sure = np.array([evident(text, *x) or not model.nodes and x[1] == 4 and _weak_label(text, *x, []) for x in found], bool)
    for i in np.lexsort((-chance, ~sure)).tolist():
        a, kind, e = found[i]
        if (sure[i] or chance[i] >= model.limits[kind]) and all(e <= x or a >= y for x, y in taken):
            every.append((a, kind, e))
            taken.append((a, e))
    return base, sorted(every)


def joined(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in found)


def _find(shared, b: Boost):
    def run(batches):
        for batch in batches:
            for rows, _, _ in slices(batch):
                bases, alls, counts = [], [], []
                for text in column(batch, "text")[rows].to_pylist():
                    base, every = spans(text or "", shared.value, b.context)
                    bases.append(joined(base))
                    alls.append(joined(every))
                    counts.append([sum(k == j for _, k, _ in base) for j in range(4)])
                n = np.array(counts, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id")[rows], *(pa.array(n[:, j]) for j in range(4)), pa.array(bases, pa.string()), pa.array(alls, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def find(docs: DataFrame, model: Trees, b: Boost = Boost()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): base spans counted and listed, and all spans, each as
    kind:start:end in code points. Null and empty texts hold none. Rows are independent of each other."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return only(docs, "doc_id", "text").mapInArrow(_find(shared, b), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(docs: DataFrame, model: Trees, b: Boost = Boost()) -> DataFrame:
    """The documents, with all their columns, with every span replaced by its kind in angle brackets (overlapping base
    spans by the first one's); n_chars, where there is one, follows the new text. A null text stays null, an empty one
    empty; texts of any length are taken whole, in time that grows in proportion; repeated rows change alike."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for rows, _, _ in slices(batch):
                part = batch.slice(rows.start, rows.stop - rows.start)
                texts = column(part, "text").to_pylist()
                for i, text in enumerate(texts):
                    _, every = spans(text or "", shared.value, b.context)
                    if every:
                        out, last = [], 0
                        for a, kind, e in every:
                            if a >= last:
                                out += [text[last:a], f"<{KINDS[kind]}>"]
                            last = max(last, e)
                        texts[i] = "".join(out) + text[last:]
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                at = part.schema.get_field_index("n_chars")
                if at >= 0 and pa.types.is_integer(part.schema.field(at).type):
                    part = part.set_column(at, part.schema.field(at), pa.array([None if x is None else len(x) for x in texts], part.schema.field(at).type))
                yield part

    return docs.mapInArrow(run, schema)


def op1_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
