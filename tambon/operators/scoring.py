"""Learned scoring of candidates: hashed features, label directions, and two ways to mix them with evidence."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from dataclasses import asdict, dataclass, field, fields
from functools import lru_cache
from itertools import accumulate, pairwise, repeat

import numpy as np

from ..functions import thai_text as t

LABELS = ("NAME", "PHONE", "ADDRESS_DETAIL", "SUBDISTRICT", "DISTRICT", "PROVINCE", "POSTCODE")
_space = re.compile(rf"[{t.S}]")
_numeric = re.compile(rf"[{t.D}{t.S}+().-]+\Z")
_plain_numeric = re.compile(rf"[+0-9{t.S}-]+\Z")
_thai, _latin, _digit = re.compile("[ก-๙]"), re.compile("[A-Za-z]"), re.compile("[0-9]")
_line_end_before, _line_end_after = re.compile(rf"\n[{t.S}]*\Z"), re.compile(rf"[{t.S}]*\n")


@dataclass
class Resources:
    """What a trained parser needs besides the gazetteer.

    features: `char-ngram-v2` (dense) or `candidate-hash-v3` (sparse). scoring: `label-mix-v1` (by_label: weights of the learned part)
    or `residual-rank-v2` (by_label: scales of the learned logit, whose size is bounded by most_logit).
    """

    version: str
    dimension: int
    features: str = "candidate-hash-v3"
    least_gram: int = 1
    most_gram: int = 4
    window: int = 12
    scoring: str = "residual-rank-v2"
    by_label: dict = field(default_factory=dict)
    most_logit: float = 2.0
    directions: dict = field(default_factory=dict)  # label -> (vector, bias)

    def __post_init__(self) -> None:
        if not self.version:
            raise ValueError("resources need a version")
        if not isinstance(self.dimension, int) or self.dimension <= 0:
            raise ValueError("dimension must be a positive integer")
        if self.features not in ("char-ngram-v2", "candidate-hash-v3"):
            raise ValueError(f"unknown features {self.features}")
        if not 1 <= self.least_gram <= self.most_gram:
            raise ValueError("n-gram lengths must be positive and in order")
        if self.scoring not in ("label-mix-v1", "residual-rank-v2"):
            raise ValueError(f"unknown scoring {self.scoring}")
        if self.scoring == "residual-rank-v2" and self.features != "candidate-hash-v3":
            raise ValueError("residual-rank-v2 requires candidate-hash-v3 features")
        top = 1 if self.scoring == "label-mix-v1" else math.inf
        if any(not (0 <= v <= top and math.isfinite(v)) for v in self.by_label.values()):
            raise ValueError("weights by label are out of range")
        for label, (vector, _) in self.directions.items():
            if label not in LABELS or len(vector) != self.dimension:
                raise ValueError(f"the direction of {label} has the wrong dimension")

    @property
    def kind(self) -> str:
        return "evidence-only" if not self.directions else "sparse-residual" if self.scoring == "residual-rank-v2" else "frozen-direction"


def save(resources: Resources, gazetteer, path: str, gate: dict | None = None, **about) -> None:
    """An artifact below `path`: the gazetteer as Parquet, everything else as one line of JSON with a checksum of directions and places.

    `gate` and `about` (split, source) are kept as they are given; `provenance.artifact_gate` reads the gate.
    """
    spark = gazetteer.sparkSession
    gazetteer.write.mode("overwrite").parquet(f"{path}/gazetteer")
    plain = asdict(resources) | {"directions": {label: {"vector": [float(x) for x in vector], "bias": float(bias)} for label, (vector, bias) in resources.directions.items()}}
    places = sorted([r.subdistrict, r.district, r.province, r.zipcode] for r in gazetteer.select("subdistrict", "district", "province", "zipcode").toLocalIterator())
    checksum = hashlib.sha256(json.dumps([plain["directions"], places], sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    scales = {"residualScaleByLabel": resources.by_label} if resources.scoring == "residual-rank-v2" else {"weightByLabel": resources.by_label}
    line = {"resources": plain | {"checksum": checksum, "scoringConfig": scales}, "promotionGate": gate, **about}
    spark.createDataFrame([(json.dumps(line, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/artifact")


def load(spark, path: str):
    """The resources and the gazetteer of an artifact; fails where its checksum doesn't fit what it holds."""
    whole = json.loads(spark.read.text(f"{path}/artifact").first()[0])["resources"]
    gazetteer = spark.read.parquet(f"{path}/gazetteer")
    places = sorted([r.subdistrict, r.district, r.province, r.zipcode] for r in gazetteer.select("subdistrict", "district", "province", "zipcode").toLocalIterator())
    if hashlib.sha256(json.dumps([whole["directions"], places], sort_keys=True, ensure_ascii=False).encode()).hexdigest() != whole["checksum"]:
        raise ValueError(f"the artifact {path} has been changed")
    known = {f.name for f in fields(Resources)}
    return Resources(**{k: v for k, v in whole.items() if k in known} | {"directions": {label: (np.array(x["vector"]), x["bias"]) for label, x in whole["directions"].items()}}), gazetteer


def fnv1a(text: str) -> int:
    h = 0x811C9DC5
    units = text.encode("utf-16-le")
    for i in range(0, len(units), 2):
        h = ((h ^ (units[i] | units[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return h


@lru_cache(maxsize=1 << 17)  # most n-grams and all other features recur from message to message
def slot(feature: str, dimension: int) -> tuple[int, int]:
    h = fnv1a(feature)
    return h % dimension, -1 if h >> 31 else 1


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def logit(p: float) -> float:
    p = min(1 - 1e-4, max(1e-4, p))
    return math.log(p / (1 - p))


def grams(text: str, least: int, most: int):
    return (text[i : i + n] for n in range(least, most + 1) for i in range(len(text) - n + 1))


def span_features(raw: str, start: int, end: int, r: Resources) -> np.ndarray:
    """Dense: counted n-grams, shape and context, hashed with signs, of length one. Sums are in single precision, as in the data contract."""
    return span_matrix([raw], [(0, start, end)], r)[0]


@lru_cache(maxsize=1 << 17)
def gram_place(gram: str, dimension: int) -> int:
    """The slot of an n-gram, beyond the dimension if its sign is negative."""
    at, sign = slot.__wrapped__(f"g{len(gram)}:{gram}", dimension)
    return at if sign > 0 else at + dimension


@lru_cache(maxsize=1 << 17)
def window_places(window: str, least: int, most: int, dimension: int) -> bytes:
    """For a position whose next `most` characters are `window`, as numbers of four bytes: the places of the n-grams that begin there (0 beyond the end of the text), and what its first character is: digit 1, Thai 2, of a number 4."""
    places = [gram_place(window[:n], dimension) if n <= len(window) else 0 for n in range(least, most + 1)]
    kinds = sum(bit for bit, pattern in ((1, _digit), (2, _thai), (4, _plain_numeric)) if pattern.match(window[0]))
    return np.array([*places, kinds], np.int32).tobytes()


@lru_cache(maxsize=64)
def length_slots(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    at, signs = zip(*(slot(f"len:{k}", dimension) for k in range(33)), strict=True)
    return np.array(at), np.array(signs)


def span_matrix(texts: list[str], spans: list[tuple[int, int, int]], r: Resources) -> np.ndarray:
    """`span_features` of spans (number of the text, start, end), as rows. The n-grams within a span are those that end by its end less those that begin before its start,
    so they are summed up to each start and each end, not for each span. Weights are quarters, so their sums are exact."""
    d, n, least, most = r.dimension, len(spans), r.least_gram, r.most_gram
    base = "\n".join(texts)  # a mark between texts: the end of one is not the start of the next
    if unicodedata.is_normalized("NFC", base):
        before = [0, *accumulate(len(x) + 1 for x in texts)]
        places = [(before[k] + a, before[k] + b) for k, a, b in spans]
    else:
        parts = [unicodedata.normalize("NFC", texts[k][a:b]) for k, a, b in spans]
        base, places = "\n".join(parts), [(e - len(x) - 1, e - 1) for e, x in zip(accumulate(len(x) + 1 for x in parts), parts, strict=True)]
    if not n:
        return np.zeros((0, d), np.float32)
    starts, ends = np.array(places).T
    lengths, rows = ends - starts, np.arange(n)
    first, last = int(starts.min()), int(ends.max())
    # Single precision holds quarters, and the sixteenths of their squares, exactly up to these bounds.
    exact = np.float32 if (last - first) * (most - least + 1) < 1 << 20 and ((most - least + 1) * int(lengths.max()) + 8) ** 2 < 1 << 20 else np.float64
    from_starts, start_of, start_row = np.unique(starts, return_index=True, return_inverse=True)
    to_ends, end_of, end_row = np.unique(ends, return_index=True, return_inverse=True)

    found = np.frombuffer(b"".join([window_places(base[i : i + most], least, most, d) for i in range(first, last)]), np.int32).reshape(last - first, most - least + 2)
    codes, kinds, at = found[:, :-1], found[:, -1], np.arange(first, last)[:, None]
    signs = np.where(codes < d, 1.0, -1.0).ravel()
    slots = codes % d

    def summed(bins: np.ndarray, count: int) -> np.ndarray:
        out = np.bincount((bins * d + slots).ravel(), signs, minlength=(count + 1) * d)[: count * d].reshape(count, d).astype(exact, copy=False)
        for above, row in pairwise(out):
            row += above
        return out

    begun = summed(np.searchsorted(from_starts, at, "right"), len(from_starts))
    ended = summed(np.searchsorted(to_ends, at + np.arange(least, most + 1), "left"), len(to_ends))
    for row, k in enumerate(start_of.tolist()):
        k, start, _ = spans[k]
        place, sign = slot(f"left:{texts[k][max(0, start - 3) : start] or '<BOS>'}", d)
        begun[row, place] -= 0.75 * sign
    for row, k in enumerate(end_of.tolist()):
        k, _, end = spans[k]
        place, sign = slot(f"right:{texts[k][end : end + 3] or '<EOS>'}", d)
        ended[row, place] += 0.75 * sign
    vectors = ended[end_row]
    vectors -= begun[start_row]
    for row in np.flatnonzero(lengths < most - 1).tolist():  # so short that an n-gram may begin before its start and end after its end, which was taken off
        a, b = places[row]
        for i in range(max(first, b - most + 1), a):
            for size in range(max(least, b - i + 1), most + 1):
                code = int(codes[i - first, size - least])
                vectors[row, code % d] += 1 if code < d else -1
    place, sign = length_slots(d)
    half = np.minimum(lengths // 2, 32)
    vectors[rows, place[half]] += 0.5 * sign[half]
    held = np.concatenate(([[0, 0, 0]], np.cumsum(kinds[:, None] >> np.arange(3) & 1, axis=0)))
    held = held[ends - first] - held[starts - first]
    for name, weight, holds in (("shape:digit", 1.5, held[:, 0] > 0), ("shape:thai", 1.5, held[:, 1] > 0), ("shape:numeric", 2.0, (held[:, 2] == lengths) & (lengths > 0))):
        place, sign = slot(name, d)
        vectors[holds, place] += sign * weight
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).astype(np.float64))
    norms[norms == 0] = 1.0
    vectors = vectors.astype(np.float32, copy=False)
    vectors /= norms.astype(np.float32)[:, None]
    return vectors


def bucket(distance: int | None) -> str:
    if distance is None:
        return "none"
    for most, name in ((0, "0"), (1, "1"), (3, "2-3"), (7, "4-7"), (15, "8-15"), (31, "16-31")):
        if distance <= most:
            return name
    return "32+"


def nearest(start: int, end: int, ranges) -> int | None:
    return min((max(0, start - b, a - end) for a, b in ranges), default=None)


def candidate_names(scan, seed, r: Resources) -> set[str]:
    """The sparse features of a candidate, as names."""
    raw, start, end = scan.raw, seed.start, seed.end
    span = unicodedata.normalize("NFC", raw[start:end])
    normal = t.strip(t.squeeze(span)).lower()
    before, after = raw[:start], raw[end:]
    short = min(3, r.most_gram)
    names = {f"{kind}:{g}" for kind, text, least, most in (("span.raw", span, r.least_gram, r.most_gram), ("span.compact", _space.sub("", normal), r.least_gram, r.most_gram), ("context.left", before[-r.window :] if r.window else "", 1, short), ("context.right", after[: r.window], 1, short)) for g in grams(text, least, most)}
    for n in range(1, min(4, len(normal)) + 1):
        names |= {f"boundary.start:{normal[:n]}", f"boundary.end:{normal[-n:]}"}
    names |= {f"label:{seed.label}", f"source:{seed.source}", f"length:{min(32, len(normal) // 4)}", f"position:{min(9, 10 * start // max(1, len(raw)))}", f"evidence:{min(10, math.floor(seed.evidence * 10))}", f"locations:{min(4, len(seed.ids))}", f"line:{min(5, before.count(chr(10)))}"}
    names |= {name for name, holds in (("shape:numeric", _numeric.match(span)), ("shape:thai", _thai.search(span)), ("shape:latin", _latin.search(span)), ("shape:multiline", "\n" in span), ("boundary:line-start", start == 0 or _line_end_before.search(before)), ("boundary:line-end", not after or _line_end_after.match(after))) if holds}
    names |= {f"evidence-rule:{rule}" for rule, *_ in seed.trace}
    for name, ranges in (("recipient-label", scan.to), ("phone", scan.phones), ("address-label", scan.at), ("administrative", scan.admin), ("postcode", scan.postcodes), ("separator", scan.breaks)):
        names.add(f"distance.{name}:{bucket(nearest(start, end, ranges))}")
    return names


def candidate_features(scan, seed, r: Resources) -> dict[int, int]:
    out: dict[int, int] = {}
    for at, sign in map(slot, candidate_names(scan, seed, r), repeat(r.dimension)):
        out[at] = out.get(at, 0) + sign
    return {k: out[k] for k in sorted(out) if out[k]}


def scorer(r: Resources):
    """A function of (scan, seed) to (latent score, score)."""

    def of(scan, seed) -> tuple[float, float]:
        direction = r.directions.get(seed.label)
        learned = 0.0
        if direction is not None:
            vector, bias = direction
            if r.features == "candidate-hash-v3":
                learned = sum(v * vector[k] for k, v in candidate_features(scan, seed, r).items()) + bias
            else:
                learned = float(np.dot(span_features(scan.raw, seed.start, seed.end, r).astype(np.float64), np.asarray(vector, float))) + bias
        mixed = r.scoring == "label-mix-v1"
        latent = 0.5 if direction is None else sigmoid(4 * learned if mixed else learned)
        if mixed:
            w = r.by_label.get(seed.label, 0.55)
            return latent, min(1.0, max(0.0, w * latent + (1 - w) * seed.evidence))
        scale = r.by_label.get(seed.label, 0.0)
        if direction is None or scale <= 0:
            return latent, seed.evidence
        return latent, sigmoid(logit(seed.evidence) + max(-r.most_logit, min(r.most_logit, learned * scale)))

    return of
