"""One message in, one parse out: candidate spans, beam decoding, validation.

The kernel holds no Spark object. It is compiled once per worker from the gazetteer and run over
Arrow batches (see engine.py), which makes a parse a narrow, stateless step: the same on batch and streaming frames.

Surfaces of the gazetteer are found in one pass over the text: an index from the first two characters to the
surfaces that begin so, longest text looked at once, instead of a search per term.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

from ..functions import thai_text as t

ORDER = ("PROVINCE", "DISTRICT", "SUBDISTRICT", "POSTCODE", "PHONE", "NAME", "ADDRESS_DETAIL")
FIELD = {"NAME": "name", "PHONE": "phone", "ADDRESS_DETAIL": "address", "SUBDISTRICT": "subdistrict", "DISTRICT": "district", "PROVINCE": "province", "POSTCODE": "zipcode"}
COLUMN = {"SUBDISTRICT": "subdistrict", "DISTRICT": "district", "PROVINCE": "province", "POSTCODE": "zipcode"}
CITY = "เมือง"
BANGKOK, BANGKOK_ALIASES = "กรุงเทพมหานคร", ("กรุงเทพ", "กทม.", "กทม")
LEAST_SIMILARITY = 80
LEAST_SCORE = 0.48
WIDEST = 140
UNVERIFIED_CAP = 0.3

_scans = {name: t.python_pattern(p) for name, p in {"phones": t.PHONE, "postcodes": t.POSTCODE, "hints": t.ADDRESS_HINT, "titles": t.TITLE, "admin": t.ADMIN, "to": t.RECIPIENT_LABEL, "tel": t.PHONE_LABEL, "at": t.ADDRESS_LABEL, "breaks": t.SEPARATOR}.items()}
_structured = [t.python_pattern(p) for p in t.STRUCTURED]
_space = re.compile(rf"[{t.S}]")
_thai_run = re.compile("[ก-๙]+")
_digit = re.compile("[0-9]")
_white = frozenset(t.WHITE)
_any_digit = re.compile(f"[{t.D}]")
_title, _address_word = (f"(?:{'|'.join(sorted(p[3:-1].split('|'), key=lambda x: len(x.replace(chr(92), ''))))})" for p in (t.TITLE, t.ADDRESS_WORD))  # the shortest that fits comes first
_title, _address_words = re.compile(_title), re.compile(f"(?=({_address_word}))")
_prefix_labels = (("SUBDISTRICT", ("แขวง", "ตำบล", "ต.", "ต")), ("DISTRICT", ("เขต", "อำเภอ", "อ.", "อ")), ("PROVINCE", ("จังหวัด", "จ.", "จ")))
_short_district = re.compile(rf"อ\.[{t.S}]*\Z")


@dataclass(frozen=True)
class Options:
    beam_width: int = 64
    candidates_per_label: int = 24
    min_field_confidence: float = 0.5
    diagnostics: str = "summary"
    offsets: str = "utf-16"  # the unit of the data contract, or "code-point"

    def __post_init__(self) -> None:
        for name in ("beam_width", "candidates_per_label"):
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value <= 0:
                raise ValueError(f"{name} must be a positive integer")
        if self.offsets not in ("utf-16", "code-point"):
            raise ValueError("offsets are in utf-16 units or code points")
        if not (math.isfinite(self.min_field_confidence) and 0 <= self.min_field_confidence <= 1):
            raise ValueError("min_field_confidence must be between zero and one")


@dataclass(slots=True)
class Seed:
    label: str
    start: int
    end: int
    evidence: float
    source: str
    trace: list
    canonical: str | None = None
    ids: dict = field(default_factory=dict)  # an ordered set of location numbers
    score: float = 0.0
    latent: float = 0.5
    text: str = ""


def touches(a, b) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def in_units(raw: str, out: dict) -> dict:
    """A parse with its offsets in UTF-16 units: characters beyond the basic plane take two."""
    at = [0, *accumulate(1 + (c > "\uffff") for c in raw)]
    for name in ("spans", "trace", "rejections"):
        if name in out:
            out[name] = [x | {"start": at[x["start"]], "end": at[x["end"]]} for x in out[name]]
    return out


def taken(ranges) -> int:
    """The positions of some ranges as bits."""
    bits = 0
    for start, end in ranges:
        bits |= (1 << end) - (1 << start)
    return bits


def _first(bits: int, start: int) -> float:
    """The first position of `bits` from `start`."""
    bits >>= start
    return start + (bits & -bits).bit_length() - 1 if bits else math.inf


def trimmed(raw: str, start: int, end: int):
    while start < end and raw[start] in _white:
        start += 1
    while end > start and raw[end - 1] in _white:
        end -= 1
    return (start, end) if start < end else None


def _end_of_text(raw: str, end: int) -> int:
    while end and raw[end - 1] in _white:
        end -= 1
    return end


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else (total - edit_distance(a, b)) / total * 100


def best_match(text: str, options: list, least: float):
    """The first of the most similar options (text, payload), as (similarity, payload); lengths must not differ by more than half the longer."""
    best = None
    for surface, payload in options:
        if surface and abs(len(text) - len(surface)) <= 0.5 * max(len(text), len(surface)):
            value = similarity(text, surface)
            if value >= least and (best is None or value > best[0]):
                best = (value, payload)
    return best


class Gazetteer:
    """Terms of location tuples (subdistrict, district, province, zipcode); a location's number is its position."""

    def __init__(self, locations: list[dict]):
        self.locations = locations
        self.terms: list[tuple[str, str, str, int]] = []  # label, surface, canonical, location
        for i, place in enumerate(locations):
            self.terms += [(label, place[c], place[c], i) for label, c in COLUMN.items()]
            if place["district"].startswith(CITY) and place["district"] != CITY:
                self.terms.append(("DISTRICT", CITY, place["district"], i))
            if place["province"] == BANGKOK:
                self.terms += [("PROVINCE", alias, BANGKOK, i) for alias in BANGKOK_ALIASES]
        self.exact = {label: defaultdict(list) for label in COLUMN}
        for i, place in enumerate(locations):
            for label, c in COLUMN.items():
                self.exact[label][place[c]].append(i)
        self.fuzzy, self.fuzzy_in = defaultdict(list), defaultdict(list)
        self.surfaces = {label: defaultdict(set) for label in COLUMN}
        starts = defaultdict(set)
        for label, surface, name, i in self.terms:
            if surface:
                starts[surface[:2]].add(surface)
                self.surfaces[label][surface[:1]].add(surface)
            if label != "POSTCODE":
                self.fuzzy[label].append((surface, (name, i)))
                self.fuzzy_in[label, locations[i]["province"]].append((surface, (name, i)))
        self.starts = {k: tuple(sorted(v)) for k, v in starts.items()}
        self.provinces = {s for label, s, *_ in self.terms if label == "PROVINCE"}
        self.by_surface = defaultdict(list)
        for n, term in enumerate(self.terms):
            self.by_surface[term[1]].append(n)

    def occurrences(self, raw: str) -> dict[str, list[int]]:
        """Where each surface stands, without overlaps with itself."""
        found: dict[str, list[int]] = {}
        get = self.starts.get
        for i, first in enumerate(raw):
            for surface in (*get(first, ()), *get(raw[i : i + 2], ())) if i + 1 < len(raw) else get(first, ()):
                if raw.startswith(surface, i):
                    places = found.setdefault(surface, [])
                    if not places or i >= places[-1] + len(surface):
                        places.append(i)
        return found

    def resolve(self, v: dict) -> list[int]:
        """Locations that agree with all four values, else with the last three, else with the last two."""
        for columns in (("subdistrict", "district", "province", "zipcode"), ("district", "province", "zipcode"), ("province", "zipcode")):
            hit = [i for i in self.exact["POSTCODE"].get(v["zipcode"], ()) if all(self.locations[i][c] == v[c] for c in columns)]
            if hit:
                return hit
        return []


class Scan:
    """The typed ranges of a message."""

    def __init__(self, raw: str, gazetteer: Gazetteer):
        self.raw = raw
        for name, pattern in _scans.items():
            setattr(self, name, [m.span() for m in pattern.finditer(raw) if m.end() > m.start()])
        self.found = gazetteer.occurrences(raw)
        self.coherent = [r for r in self.admin if (label := self.prefix_label(r, loose=True)) and any(raw.startswith(s, r[1]) for s in gazetteer.surfaces[label].get(raw[r[1] : r[1] + 1], ()))]
        last = [(raw.rfind(p), len(p), p) for p in self.found if p in gazetteer.provinces]
        self.province = max(last)[2] if last else None
        self.excluded = [*self.to, *self.tel, *self.at, *self.admin, *self.breaks]
        self.last_phone = max((p[0] for p in self.phones), default=-1)
        self.begins: dict[int, tuple] = {}
        self.ends: dict[int, bool] = {}
        self.foreign = [0, *accumulate(not "ก" <= c <= "๙" for c in raw)]
        self.solid = [0, *accumulate(c not in _white for c in raw)]
        self.words = [(m.start(), m.end(1)) for m in _address_words.finditer(raw)]

    def beginning(self, start: int) -> tuple:
        """What holds for all segments from `start`: after a recipient label, after an address label, first in the text, first in a line."""
        known = self.begins.get(start)
        if known is None:
            after = lambda ranges: any(self.blank(x[1], start) for x in ranges)
            known = self.begins[start] = (after(self.to), after(self.at), self.blank(0, start), start == 0 or after(b for b in self.breaks if b[1] <= start))
        return known

    def before_admin(self, end: int) -> bool:
        """Whether a known place's prefix follows `end`."""
        known = self.ends.get(end)
        if known is None:
            known = self.ends[end] = any(a[0] >= end and self.blank(end, a[0]) for a in self.coherent)
        return known

    def prefix_label(self, span, loose: bool = False) -> str | None:
        word = _space.sub("", self.raw[span[0] : span[1]])
        for label, prefixes in _prefix_labels:
            if word in prefixes or loose and word.startswith(prefixes[:3]):
                return label
        return None

    def blank(self, start: int, end: int) -> bool:
        return start >= end or self.solid[start] == self.solid[end]


class Parser:
    def __init__(self, gazetteer: Gazetteer, options: Options = Options(), scorer=None):
        self.places, self.options, self.scorer = gazetteer, options, scorer

    # Candidates

    def seeds(self, raw: str):
        scan = Scan(raw, self.places)
        store: dict[tuple, Seed] = {}
        refused: dict[tuple, dict] = {}

        def add(label, span, evidence, source, trace, name=None, places=(), apart=False):
            """Equal spans with equal names merge: the best evidence counts, its trace only if strictly better; locations add up."""
            if not places:
                kept = store.get(key := (label, *span, name or "", None))
                if kept is None:
                    store[key] = Seed(label, *span, evidence, source, trace, name)
                elif evidence > kept.evidence:
                    kept.evidence, kept.trace, kept.source = evidence, trace, source
                return
            for place in places:
                key = (label, *span, name or "", place if apart else None)
                kept = store.get(key)
                if kept is None:
                    kept = store[key] = Seed(label, *span, evidence, source, trace, name)
                elif evidence > kept.evidence:
                    kept.evidence, kept.trace, kept.source = evidence, trace, source
                kept.ids[place] = None

        def refuse(label, span, rule):
            refused[label, *span, rule] = {"label": label, "text": raw[span[0] : span[1]], "start": span[0], "end": span[1], "ruleId": rule}

        self._recipients(scan, add)
        self._suffixes(scan, add)
        self._prefixed(scan, add, refuse)
        for span in scan.phones:
            if name := t.phone(raw[slice(*span)]):
                add("PHONE", span, 0.99, "phone", [("phone.pattern", "base", 0.99)], name)
        for span in scan.postcodes:
            if not any(touches(p, span) for p in scan.phones) and (name := t.postcode(raw[slice(*span)])):
                add("POSTCODE", span, 0.94, "postcode", [("postcode.pattern", "base", 0.94)], name, self.places.exact["POSTCODE"].get(name, ()))
        self._mentions(scan, add, refuse)
        self._segments(scan, add, [(s.start, s.end) for s in store.values() if s.evidence >= 0.9])
        return scan, list(store.values()), list(refused.values())

    def _recipients(self, scan: Scan, add) -> None:
        stops = sorted(r[0] for r in (*scan.breaks, *scan.to, *scan.tel, *scan.at))

        def stop(start):
            at = bisect_left(stops, start)
            return stops[at] if at < len(stops) else len(scan.raw)

        for label in scan.to:
            if span := trimmed(scan.raw, label[1], stop(label[1])):
                add("NAME", span, 0.995, "recipient", [("name.labeled-value", "base", 0.995)])
        for label in scan.at:
            end = stop(label[1])
            end = min([a[0] for a in scan.admin if label[1] <= a[0] < end], default=end)
            if span := trimmed(scan.raw, label[1], end):
                add("ADDRESS_DETAIL", span, 0.995, "recipient", [("address.labeled-value", "base", 0.995)])
        first = next((b for b in scan.breaks if b[0] > 0), None)
        if first and (span := trimmed(scan.raw, 0, first[0])) and any(p[0] > span[1] for p in scan.phones) and not _any_digit.search(scan.raw, *span):
            add("NAME", span, 0.97, "recipient", [("name.titleless-first-line", "base", 0.97)])

    def _suffixes(self, scan: Scan, add) -> None:
        for pattern in _structured:
            for m in pattern.finditer(scan.raw):
                values = {k: t.strip(v) for k, v in m.groupdict().items()}
                if not all(values.values()):
                    continue
                ids, at = self.places.resolve(values), m.start()
                for label, column in COLUMN.items():
                    start = scan.raw.find(values[column], at)
                    if 0 <= start < m.end():
                        at = start + len(values[column])
                        add(label, (start, at), 0.995, "structured", [("location.structured-tuple", "resolve", 0.995)], values[column], ids, apart=True)

    def _prefixed(self, scan: Scan, add, refuse) -> None:
        for prefix in scan.admin:
            label, run = scan.prefix_label(prefix), _thai_run.match(scan.raw, prefix[1])
            if not label or not run or (label == "DISTRICT" and run[0] == CITY):
                continue
            span, value = run.span(), run[0]
            plain = [("location.prefixed-value", "base", 0.98)]
            if ids := self.places.exact[label].get(value):
                add(label, span, 0.98, "administrative", plain, value, ids)
                continue
            options = self.places.fuzzy_in.get((label, scan.province)) if scan.province is not None and label != "PROVINCE" else None
            if options is None:
                options = [] if label == "SUBDISTRICT" else self.places.fuzzy.get(label, [])
            match = best_match(value, options, LEAST_SIMILARITY)
            if match:
                evidence = min(0.85, 0.5 + (match[0] - LEAST_SIMILARITY) / (100 - LEAST_SIMILARITY) * 0.35)
                add(label, span, evidence, "administrative", [("location.fuzzy-prefixed-value", "base", evidence)], match[1][0], [match[1][1]])
            else:
                if options:
                    refuse(label, span, "location.fuzzy-no-match")
                add(label, span, 0.98, "administrative", plain, value)

    def _mentions(self, scan: Scan, add, refuse) -> None:
        raw, places = scan.raw, self.places
        last_phone = max((p[0] for p in scan.phones), default=-1)
        first_phone_end = min((p[1] for p in scan.phones), default=None)
        after_phone = next((a[0] for a in scan.admin if first_phone_end is not None and a[0] > first_phone_end), None)
        first_admin = min((a[0] for a in scan.admin), default=None)
        address_from = min([h[0] for h in scan.hints] + [x[1] for x in scan.at], default=None)
        for n in sorted(n for s in scan.found for n in places.by_surface[s]):
            label, surface, name, place = places.terms[n]
            where, is_city = places.locations[place], label == "DISTRICT" and surface == CITY
            in_hint = scan.province is not None and where["province"] == scan.province
            for start in scan.found[surface]:
                span = (start, start + len(surface))
                city = raw.find(CITY, span[1])
                province = raw.find(where["province"], span[1] if city < 0 else city + len(CITY))
                in_sequence = in_hint and ((label == "SUBDISTRICT" and city >= span[1] and province > city) or (is_city and where["subdistrict"] in raw[:start] and province > start))
                exempt = in_sequence or (label == "PROVINCE" and surface == scan.province)
                between = after_phone is not None and start > first_phone_end and start < after_phone
                early = address_from is not None and start >= address_from and first_admin is not None and first_admin > start
                if is_city and not (in_hint and (in_sequence or _short_district.search(raw[:start]))):
                    refuse(label, span, "location.city-unscoped")
                elif start < last_phone or (not exempt and (between or early)):
                    refuse(label, span, "location.outside-administrative-context")
                elif label == "POSTCODE" and (_digit.match(raw[start - 1 : start]) or _digit.match(raw[span[1] : span[1] + 1])):
                    refuse(label, span, "postcode.embedded-number")
                else:
                    trace = ("location.city-resolved", "resolve", 0.96) if is_city else ("location.gazetteer", "base", 0.96)
                    add(label, span, 0.96, "gazetteer", [trace], name, [place])

    def _segments(self, scan: Scan, add, anchors) -> None:
        raw = scan.raw
        edges = {0, len(raw)}
        for group in (anchors, scan.admin, scan.excluded):
            edges.update(x for r in group for x in r)
        edges.update(r[0] for r in (*scan.hints, *scan.titles))
        edges = sorted(edges)
        shielded = taken((*scan.phones, *scan.postcodes, *scan.to, *scan.tel, *scan.at, *scan.breaks))
        barred = taken((*anchors, *scan.excluded))
        # A segment between two edges is without white space around it, and without commas and semicolons at its end.
        last = []
        for end in edges:
            cut = _end_of_text(raw, end)
            while cut and raw[cut - 1] in ",;":
                cut -= 1
            last.append(_end_of_text(raw, cut))
        known, reached = None, 0
        for i, edge in enumerate(edges):
            start = edge
            while start < len(raw) and raw[start] in _white:
                start += 1
            if start != known:
                known, reached, evidence = start, start + 1, None
                name_until, address_until = _first(barred, start), _first(shielded, start)
                until = max(name_until, address_until)
            for end in last[i + 1 : bisect_right(edges, edge + WIDEST)]:
                if end <= reached:  # several pairs of edges give one span, and later edges no earlier end
                    continue
                reached = end
                if end > until:
                    break
                if evidence is None:
                    evidence = segment_evidence(scan, start)
                (name, names), (address, addresses) = evidence(end)
                if end <= name_until:
                    add("NAME", (start, end), name, "segment", names)
                if end <= address_until:
                    add("ADDRESS_DETAIL", (start, end), address, "segment", addresses)

    # Decoding

    def score(self, scan: Scan, seeds: list[Seed]) -> None:
        for s in seeds:
            s.text = scan.raw[s.start : s.end]
            if s.canonical is None:
                s.canonical = t.canonical(s.label, s.text) or s.text
            s.latent, s.score = (0.5, s.evidence) if self.scorer is None else self.scorer(scan, s)

    def decode(self, seeds: list[Seed]):
        # A state: what it is sorted by, the chosen, their score, common locations, positions taken, starts by label, bonus of each wanted order.
        beam, hypotheses = [(0.0, (), 0.0, None, 0, {}, _no_order)], 0
        shared: dict[tuple, dict] = {}
        for label in ORDER:
            choices = sorted((s for s in seeds if s.label == label and s.score >= LEAST_SCORE), key=lambda s: (-s.score, s.start - s.end, s.start))[: self.options.candidates_per_label]
            hypotheses += len(beam) * (1 + len(choices))
            if not choices:
                continue
            located, grown = label in COLUMN, []
            ready = [(s, (1 << s.end) - (1 << s.start), s.score - 0.5, s.start) for s in choices]
            for state in beam:
                _, chosen, score, ids, positions, starts, orders = state
                grown.append(state)
                for s, mask, gain, start in ready:
                    if positions & mask:
                        continue
                    now = ids
                    if located:
                        if not s.ids:
                            if ids is not None and label == "POSTCODE":
                                gain = gain - 0.9
                        elif ids is None:
                            now = s.ids
                        else:
                            pair = id(ids), id(s)
                            now = shared.get(pair)
                            if now is None:
                                now = shared[pair] = {k: None for k in ids if k in s.ids}
                            gain = gain + (0.22 if now else -0.9)
                    order = orders
                    for k, other, first, weight in _orders_of[label]:
                        if other in starts:
                            kept = (start <= starts[other]) if first else (starts[other] <= start)
                            order = (*order[:k], weight if kept else -weight, *order[k + 1 :])
                    total = score + gain
                    grown.append((-(total + sum(order)), (*chosen, s), total, now, positions | mask, {**starts, label: start}, order))
            beam = sorted(grown, key=_rank)[: self.options.beam_width]
        best, chosen, *_ = beam[0]
        return sorted(chosen, key=lambda s: s.start), -best, hypotheses

    # Validation

    def parse(self, raw: str) -> dict:
        scan, seeds, refused = self.seeds(raw)
        self.score(scan, seeds)
        chosen, _, hypotheses = self.decode(seeds)
        fields, spans, abstained = dict.fromkeys(FIELD.values()), [], []
        admin = [s for s in chosen if s.label in COLUMN]
        proven = [s for s in admin if s.ids]
        common = set.intersection(*(set(s.ids) for s in proven)) if proven else set()
        orphan = any(s.label == "POSTCODE" and not s.ids for s in admin) and any(s.label != "POSTCODE" for s in proven)
        agree = not orphan and (len(proven) <= 1 or bool(common))
        for s in chosen:
            name, confidence = t.canonical(s.label, s.canonical), min(1.0, max(0.0, s.score))
            if s.label in ("SUBDISTRICT", "DISTRICT", "PROVINCE") and not s.ids:
                confidence = min(confidence, UNVERIFIED_CAP)
            reason = "invalid-offset" if not 0 <= s.start < s.end <= len(raw) or raw[s.start : s.end] != s.text else "inconsistent-location" if s.label in COLUMN and not agree else "invalid-format" if not name else "low-confidence" if confidence < self.options.min_field_confidence else None
            if reason:
                abstained.append({"field": FIELD[s.label], "reason": reason})
            else:
                fields[FIELD[s.label]] = name
                spans.append({"label": s.label, "text": s.text, "canonical": name, "start": s.start, "end": s.end, "confidence": confidence})
        out = {**fields, "spans": spans, "confidence": sum(s["confidence"] for s in spans) / len(spans) if spans else 0.0, "abstentions": abstained, "candidates_evaluated": len(seeds), "hypotheses_evaluated": hypotheses}
        if self.options.diagnostics == "full":
            out |= {"trace": [self._traced(s, chosen, spans, abstained) for s in seeds], "rejections": refused}
        return in_units(raw, out) if self.options.offsets == "utf-16" and raw and max(raw) > "\uffff" else out

    def _traced(self, s: Seed, chosen, spans, abstained) -> dict:
        outcome, reason = "pruned", None
        if any((x["label"], x["start"], x["end"], x["canonical"]) == (s.label, s.start, s.end, s.canonical) for x in spans):
            outcome = "accepted"
        elif any(c is s for c in chosen):
            outcome, reason = "abstained", next((a["reason"] for a in abstained if a["field"] == FIELD[s.label]), None)
        elif s.score < LEAST_SCORE:
            reason = "below-threshold"
        elif any(c.start < s.end and s.start < c.end for c in chosen):
            reason = "overlap"
        else:
            reason = "lower-ranked" if any(c.label == s.label for c in chosen) else "beam-pruned"
        rules = [{"ruleId": r, "effect": e, "value": v} for r, e, v in s.trace]
        return {"label": s.label, "text": s.text, "canonical": s.canonical, "start": s.start, "end": s.end, "evidenceScore": s.evidence, "latentScore": s.latent, "score": s.score, "source": s.source, "evidence": rules, "outcome": outcome, "reason": reason}


_wanted_order = (("NAME", "ADDRESS_DETAIL", 0.04), ("SUBDISTRICT", "DISTRICT", 0.06), ("DISTRICT", "PROVINCE", 0.06), ("PROVINCE", "POSTCODE", 0.03))
#: For each label: number of the wanted order, the other label, whether this one comes first, weight.
_orders_of = {label: [(k, b if label == a else a, label == a, w) for k, (a, b, w) in enumerate(_wanted_order) if label in (a, b)] for label in ORDER}
_no_order = (0.0,) * len(_wanted_order)
_rank = itemgetter(0)


def segment_evidence(scan: Scan, start: int):
    """Evidence of the segments that begin at `start`, as a function of their end: as a name and as address detail, (value, trace) each. What only the start decides is looked up once."""
    raw, find = scan.raw, lambda x: at if (at := scan.raw.find(x, start)) >= 0 else math.inf
    after_to, after_at, first, starts_line = scan.beginning(start)
    word_from = min((end for at, end in scan.words if at >= start), default=math.inf)
    title_from = m.end() if (m := _title.match(raw, start)) else math.inf
    digit_at = m.start() if (m := _digit.search(raw, start)) else math.inf
    line_end, comma = find("\n"), find(",")
    admin = [a[0] for a in scan.admin if a[1] > start]

    def of(end: int):
        word, digit, title = word_from <= end, digit_at < end, title_from <= end
        prefixes = bisect_left(admin, end)
        if after_to:
            name = 0
        elif first and scan.last_phone > end and line_end >= end:
            name = 1
        elif title:
            name = 2
        elif not digit and (end - start - scan.foreign[end] + scan.foreign[start]) / (end - start) > 0.7:
            name = 3
        else:
            name = 4
        address = 0 if after_at else 1 if word else 2 if digit_at == start else 3
        return _name_evidence(name, word or digit), _address_evidence(address, title, scan.before_admin(end), prefixes > 1, starts_line, prefixes > 0 and comma < end)

    return of


_name_bases = (("name.after-recipient-label", "base", 0.96), ("name.titleless-first-line", "base", 0.96), ("name.title", "base", 0.94), ("name.script-shape", "base", 0.62), ("name.fallback", "base", 0.2))
_address_bases = (("address.after-label", "base", 0.94), ("address.keyword", "base", 0.94), ("address.numeric-prefix", "base", 0.94), ("address.fallback", "base", 0.45))


def _summed(trace: list) -> tuple[float, list]:
    """A base, the strongest that holds, and what is added to it."""
    return max(0.0, trace[0][2] + sum([v for *_, v in trace[1:]])), trace


@lru_cache
def _name_evidence(base: int, address_signal: bool) -> tuple[float, list]:
    return _summed([_name_bases[base], *([("name.address-signal", "add", -0.5)] if address_signal else [])])


@lru_cache
def _address_evidence(base: int, title: bool, before_admin: bool, prefixes: bool, starts_line: bool, comma: bool) -> tuple[float, list]:
    added = (
        (title, ("address.title-signal", "add", -0.4)),
        (before_admin, ("address.before-administrative", "add", 0.04)),
        (prefixes, ("address.contains-multiple-administrative-prefixes", "add", -0.08)),
        (starts_line, ("address.line-start", "add", 0.04)),
        (comma, ("address.comma-before-administrative", "add", -0.02)),
    )
    return _summed([_address_bases[base], *(x for holds, x in added if holds)])
