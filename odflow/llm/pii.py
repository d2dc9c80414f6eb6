"""Personal data by candidate spans and gradient boosting.

Generators with high recall propose spans, which may overlap: the base patterns of each kind, looser forms of them, and secrets in
assignments. Boosted trees score each span by its format and its context; per kind, the least score that keeps ``PRECISION`` on calibration
rows selects what is redacted. Base matches that pass their check are always kept; scored spans are added where they overlap none of them,
better scores first.

Training has no outside labels: base matches that pass their check are positive, those that fail it negative; secrets are labelled by
their assignment. The looser forms have no label and are only scored. The fit reads at most ``SAMPLE`` labelled candidates (in expectation),
an equal number of each kind and label, taken by a hash of document, start and kind; so kinds that are rare beside others keep their rows,
and equal candidates enter singly. Thresholds come from all labelled candidates of all documents but those the trees were fitted on,
as counts per bin of score that are summed in Spark.

Cases: a null or empty text has no spans; texts are read whole, at code point places; repeated rows are judged alike; an empty table gives no
rows; without candidates of a kind nothing of it is added. Other columns are ignored by ``find_spans`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm import text

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
SAMPLE = 20_000
PRECISION = 0.98
#: Bins of the log odds of a score, and how many there are for one unit.
BINS, BINS_A_UNIT = 2_048, 64
#: Code points before a span in which hint words count.
CONTEXT = 24

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser forms, and secrets in assignments.
_SPELLED_AT = re.compile(r"(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]+)+", re.IGNORECASE)
_PLAIN_PHONE = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])")
_SECRET = re.compile(r"(?P<name>[A-Za-z_]{2,20})\x20?[=:]\x20?[\"']?(?P<value>[A-Za-z0-9_+/-]{16,}+)")
_TOUCHES = re.compile(r"[0-9@]")
_HINTS = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "secret": ("token", "secret", "key", "passw", "api", "auth"),
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2)
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _emails(body: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain; read from each @ outwards, so that long words cost no retries."""
    end, at = 0, body.find("@")
    while at != -1:
        start = at
        while start > end and body[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(body, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = body.find("@", max(at + 1, end))


def _spelled_emails(body: str) -> Iterator[tuple[int, int]]:
    """As ``_emails``, from each spelled-out @ outwards."""
    end, m = 0, _SPELLED_AT.search(body)
    while m:
        edge = m.start() - int(m.start() > end and body[m.start() - 1] == " ")
        start = edge
        while start > end and body[start - 1] in _LOCAL:
            start -= 1
        if start < edge:
            end = m.end()
            yield start, end
        m = _SPELLED_AT.search(body, max(m.start() + 1, end))


def candidates(body: str) -> list[tuple[int, int, int, int]]:
    """``kind, start, end, label`` of all proposed spans: 1 passes its check, 0 fails it, -1 has none."""
    out = []
    if _TOUCHES.search(body):
        out += [(0, s, e, 1) for s, e in _emails(body)]
        for m in _IP.finditer(body):
            # Long digit runs are no octets; their value need not be computed.
            fine = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
            out.append((1, m.start(), m.end(), int(fine)))
        for m in _CARD.finditer(body):
            digits = _digits(m[0])
            out.append((2, m.start(), m.end(), int(16 <= len(digits) <= 19 and _luhn(digits))))
        for m in _PHONE.finditer(body):
            out.append((3, m.start(), m.end(), int(8 <= len(_digits(m[0])) <= 15)))
        out += [(3, m.start(), m.end(), -1) for m in _PLAIN_PHONE.finditer(body)]
        for m in _SECRET.finditer(body):
            value, name = m["value"], m["name"].lower()
            mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            out.append((4, m.start("value"), m.end("value"), int(mixed and any(h in name for h in _HINTS["secret"]))))
    if "[" in body or "(" in body or "{" in body:
        out += [(0, s, e, -1) for s, e in _spelled_emails(body)]
    return out


def features(body: str, kind: int, start: int, end: int) -> list[float]:
    span = body[start:end]
    before = body[max(0, start - CONTEXT) : start].lower()
    digits = _digits(span)
    counts = [span.count(c) for c in set(span)]
    n = len(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    parts = span.split(".")
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        float(n), float(len(digits)), len(digits) / n, float(len(counts)), entropy,
        float(sum(not c.isalnum() for c in span)), float(bool(digits) and _luhn(digits[:64])), float(octets), float(span[0] == "+"),
        float(any(h in before for h in _HINTS[KINDS[kind]])),
        float(start > 0 and body[start - 1].isalnum()), float(end < len(body) and body[end].isalnum()),
        sum(c in "0123456789abcdefABCDEF" for c in span) / n,
    ]


class BoostedTrees:
    """Logistic gradient boosting of shallow trees on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: dict = {}
            self._grow(tree, 0, binned, y - p, p * (1 - p), np.arange(len(y)), score)
            self.trees.append(tree)
        return self

    def _grow(self, tree: dict, node: int, binned, slope, weight, rows, score, level: int = 0) -> None:
        total_g, total_h = slope[rows].sum(), weight[rows].sum()
        best = (1e-6, None, None)
        if level < self.depth and len(rows) > 1:
            for f in range(binned.shape[1]):
                g = np.cumsum(np.bincount(binned[rows, f], weights=slope[rows], minlength=self.bins + 1))[:-1]
                h = np.cumsum(np.bincount(binned[rows, f], weights=weight[rows], minlength=self.bins + 1))[:-1]
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
        if best[1] is None:
            value = self.rate * total_g / (total_h + 1)
            tree[node] = (None, None, float(value))
            score[rows] += value
            return
        _, f, at = best
        tree[node] = (f, float(self.cuts[f][at]) if at < len(self.cuts[f]) else math.inf, 0.0)
        low = binned[rows, f] <= at
        self._grow(tree, 2 * node + 1, binned, slope, weight, rows[low], score, level + 1)
        self._grow(tree, 2 * node + 2, binned, slope, weight, rows[~low], score, level + 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            work = [(0, np.arange(len(x)))]
            while work:
                node, rows = work.pop()
                if not len(rows):
                    continue
                f, cut, value = tree[node]
                if f is None:
                    score[rows] += value
                else:
                    low = x[rows, f] < cut
                    work += [(2 * node + 1, rows[low]), (2 * node + 2, rows[~low])]
        return 1 / (1 + np.exp(-score))


def _bins(scores: np.ndarray) -> np.ndarray:
    odds = np.log(np.maximum(scores, 1e-12)) - np.log(np.maximum(1 - scores, 1e-12))
    return np.clip(np.floor(odds * BINS_A_UNIT) + BINS // 2, 0, BINS - 1).astype(np.int64)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """``kind, label, hash`` of the labelled candidates of a slice, and what to compute their features from; ``row_hash`` tells rows apart."""
    for batch in text.slices(batches, "text"):
        found = [(h, b, k, s, e, t) for h, b in zip(batch.column("row_hash").to_pylist(), batch.column("text").to_pylist(), strict=True) if b for k, s, e, t in candidates(b) if t >= 0]
        if found:
            row, start, kind = (np.array([f[i] for f in found], dtype=np.int64).view(np.uint64) for i in (0, 3, 2))
            code = text.mix64(text.mix64(row + start) + kind)
            yield kind.view(np.int64), np.array([f[5] for f in found]), code, [f[1:5] for f in found]


def _share(code: np.ndarray) -> np.ndarray:
    """Places in [0, 1) by hash."""
    return (code >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _is_held(code: np.ndarray) -> np.ndarray:
    return text.mix64(code ^ np.uint64(0x5DEECE66D)) % np.uint64(3) == 0


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Trees from at most ``sample`` labelled candidates (in expectation), thresholds from all."""
    seen = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row_hash"), F.col("text").cast("string"))
    groups = 2 * len(KINDS)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(groups, dtype=np.int64)
        for kind, label, _, _ in _labelled(batches):
            total += np.bincount(2 * kind + label, minlength=groups)
        yield pa.RecordBatch.from_pydict({"of": pa.array(np.arange(groups), pa.int32()), "n": total})

    counts = {r.of: r.n for r in seen.mapInArrow(tally, "of int, n long").groupBy("of").agg(F.sum("n").alias("n")).collect()}
    if not sum(counts.values()):
        return {"trees": None, "least": [math.inf] * len(KINDS)}
    bound = np.array([min(1.0, max(1, sample // groups) / max(1, counts[g])) for g in range(groups)])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, label, code, spans in _labelled(batches):
            at = np.flatnonzero(_share(code) < bound[2 * kind + label])
            x = [features(b, k, s, e) for b, k, s, e in (spans[i] for i in at)]
            yield pa.RecordBatch.from_pydict({"code": pa.array(code[at].view(np.int64)), "label": pa.array(label[at], pa.int32()), "x": pa.array(x, pa.list_(pa.float64()))})

    # Sorted by hash: sums of floats do not hang on the order of tasks.
    kept = sorted((r.code, r.label, r.x) for r in seen.mapInArrow(propose, "code long, label int, x array<double>").collect())
    held = _is_held(np.array([r[0] for r in kept], dtype=np.int64).view(np.uint64))
    x, y = np.array([r[2] for r in kept]), np.array([r[1] for r in kept], dtype=float)
    trees = BoostedTrees().fit(x[~held], y[~held]) if (~held).any() else BoostedTrees().fit(x, y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(KINDS), 2, BINS, 2), dtype=np.int64)
        for kind, label, code, spans in _labelled(batches):
            bins = _bins(trees.predict(np.array([features(*span) for span in spans])))
            fitted = (_share(code) < bound[2 * kind + label]) & ~_is_held(code)
            np.add.at(total, (kind, fitted.astype(np.int64), bins, label), 1)
        k, fitted, at, label = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(k, pa.int32()), "fitted": pa.array(fitted, pa.int32()), "bin": pa.array(at, pa.int32()), "label": pa.array(label, pa.int32()), "n": total[k, fitted, at, label]})

    summed = np.zeros((len(KINDS), 2, BINS, 2), dtype=np.int64)
    scored = seen.mapInArrow(score, "kind int, fitted int, bin int, label int, n long").groupBy("kind", "fitted", "bin", "label").agg(F.sum("n").alias("n"))
    for r in scored.collect():  # at most BINS rows for each kind, label and part
        summed[r.kind, r.fitted, r.bin, r.label] = r.n
    least = []
    for own in summed:
        # A kind of which all candidates were fitted is judged by those.
        n = (own[0] if own[0].sum() else own[1])[::-1].cumsum(axis=0)
        precise = np.flatnonzero((n[:, 1] > 0) & (n[:, 1] >= PRECISION * n.sum(axis=1)))
        least.append(max(BINS // 2, BINS - 1 - int(precise[-1])) if len(precise) else math.inf)
    return {"trees": trees, "least": least}


def _select(model: dict, bodies: list[str | None]) -> list[tuple[list, list]]:
    """Base and added spans (``kind, start, end``) of each text."""
    found = [candidates(b) if b else [] for b in bodies]
    open_ = [(i, c) for i, cs in enumerate(found) for c in cs if c[3] != 1 or c[0] >= len(BASE_KINDS)]
    added: dict[int, list] = {}
    if open_ and model["trees"] is not None:
        score = model["trees"].predict(np.array([features(bodies[i], k, s, e) for i, (k, s, e, _) in open_]))
        for (i, (k, s, e, _)), p, at in zip(open_, score.tolist(), _bins(score).tolist(), strict=True):
            if at >= model["least"][k]:
                added.setdefault(i, []).append((-p, s, e, k))
    out = []
    for i, cs in enumerate(found):
        base = sorted((k, s, e) for k, s, e, t in cs if t == 1 and k < len(BASE_KINDS))
        taken, more = [(s, e) for _, s, e in base], []
        for _, s, e, k in sorted(added.get(i, [])):
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                more.append((k, s, e))
        out.append((base, more))
    return out


def find_spans(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``kind, start, stop`` (code points, end exclusive), by kind, then start."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": s, "stop": e} for k, s, e in sorted(spans)]
        for batch in text.slices(batches, "text"):
            picked = _select(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([named(b) for b, _ in picked], span), pa.array([named(b + m) for b, m in picked], span)], ["doc_id", "base", "spans"])

    shape = "doc_id long, base array<struct<kind:string,start:long,stop:long>>, spans array<struct<kind:string,start:long,stop:long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, shape)


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]``; overlapping spans become one, under the first's kind. ``n_chars`` follows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")

    def clean(body: str | None, spans: list) -> str | None:
        if not spans:
            return body
        parts, upto = [], 0
        for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= upto:
                parts += [body[upto:s], f"[{KINDS[k].upper()}]"]
            upto = max(upto, e)
        return "".join((*parts, body[upto:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.slices(batches, "text"):
            bodies = batch.column("text").to_pylist()
            new = [clean(b, base + more) for b, (base, more) in zip(bodies, _select(shared.value, bodies), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                was = batch.column("n_chars").to_pylist()
                columns[names.index("n_chars")] = pa.array([w if a == b else len(b) for w, a, b in zip(was, bodies, new, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    shape = T.StructType([T.StructField(f.name, {"text": T.StringType(), "n_chars": T.LongType()}.get(f.name, f.dataType)) for f in docs.schema.fields])
    return docs.select(*[F.col(f.name).cast(f.dataType) for f in shape.fields]).mapInArrow(run, shape)
