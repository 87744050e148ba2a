"""License scans by ordered signature rules.

A text is reduced to its words (digits, letters and characters above U+007F, A-Z in lower case) with one space between them; all but the base rules
read the two spellings of licence alike.
One pass of an Aho-Corasick automaton over it finds which keywords occur; only rules whose keywords all occur are matched, each
in one linear pass. Rules have a priority (license_rules.RULES: base, text, id, name, family, weak), and of overlapping
detections

* one that overlaps a kept detection of a higher priority goes,
* of detections of one priority, one whose interval is contained in another's goes; of equal intervals that of the first rule stays,

so "CC BY-NC 4.0" is one detection of that version, not also one of its family. Detections of the base rules neither suppress
nor are suppressed: they are always kept, beside the others. Resolution sorts detections and is n log n in their number.

score: the largest strength of a document's detections, raised by half of what is left to 1 for each further label, in the
order of strength; 0 without any.

Null or empty text: no words, no detections, score 0. Very long texts are scanned whole, in time linear in the text for each gated rule;
only their words and detections are held. Rows are independent of each other: repeated rows are alike. No documents: an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from fluvial.common import small_batches
from fluvial.llm.decontaminate import words_of
from fluvial.llm.license_rules import RULES

BASE = "base"


@dataclass(frozen=True)
class Rule:
    label: str
    section: str
    priority: int
    strength: float
    keywords: tuple[str, ...]
    pattern: str


def parse_rules(text: str = RULES) -> list[Rule]:
    out, head = [], None
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.startswith("=="):
            section, priority, strength = line[2:].split()
            head = (section, int(priority), float(strength))
            continue
        label, keywords, pattern = (x.strip() for x in line.split(" | ", 2))
        out.append(Rule(label, *head, tuple(k.strip() for k in keywords.split("+")), pattern.replace("VER", "(?:version|ver)")))
    return out


class Scanner:
    """Compiled rules; made once for each task."""

    def __init__(self, rules: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules or parse_rules()
        # the spaces around a detection belong to no detection, so neighbours may share one
        self.compiled = [re.compile(f"(?<= )(?:{r.pattern})(?= )") for r in self.rules]
        self.keywords = ahocorasick.Automaton()
        number: dict[str, int] = {}
        for r in self.rules:
            for k in r.keywords:
                number.setdefault(k, len(number))
        for k, n in number.items():
            self.keywords.add_word(k, n)
        self.keywords.make_automaton()
        self.needs = [frozenset(number[k] for k in r.keywords) for r in self.rules]
        self.base = [n for n, r in enumerate(self.rules) if r.section == BASE]

    def detections(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(rule, first word, word after the last) of all rules' matches, before suppression, by position."""
        plain = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
        text = plain.replace("licence", "license")  # as long as before, so places stay
        found = {n for _, n in self.keywords.iter(text)}
        if not found:
            return []
        gated = [k for k, need in enumerate(self.needs) if need <= found]
        spans = [(*m.span(), k) for k in gated for m in self.compiled[k].finditer(plain if self.rules[k].section == BASE else text) if m.end() > m.start()]
        spans.sort()
        out, at, before = [], 0, 0
        for a, b, k in spans:  # a word's number is the number of spaces before it, less the first
            before += text.count(" ", at, a)
            at = a
            out.append((k, before - 1, before + text.count(" ", a, b) - (text[b - 1] == " ")))
        return out

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The detections that stay, base ones included, by position and then rule."""
        kept = [d for d in found if self.rules[d[0]].section == BASE]
        rest = [d for d in found if self.rules[d[0]].section != BASE]
        taken: list[tuple[int, int]] = []  # intervals of higher priorities, merged and sorted
        for priority in sorted({self.rules[d[0]].priority for d in rest}, reverse=True):
            starts = [a for a, _ in taken]
            free = []
            for d in rest:
                if self.rules[d[0]].priority == priority:
                    k = bisect_right(starts, d[2] - 1) - 1
                    if k < 0 or taken[k][1] <= d[1]:
                        free.append(d)
            free.sort(key=lambda d: (d[1], -d[2], d[0]))
            most, stay = -1, []
            for d in free:  # all earlier ones begin no later, so one that ends no later than any of them is contained
                if d[2] > most:
                    most = d[2]
                    stay.append(d)
            kept += stay
            merged: list[list[int]] = []
            for a, b in sorted([*taken, *((d[1], d[2]) for d in stay)]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            taken = [(a, b) for a, b in merged]
        return sorted(kept, key=lambda d: (d[1], d[2], d[0]))

    def score(self, kept: list[tuple[int, int, int]]) -> float:
        strength: dict[str, float] = {}
        for k, *_ in kept:
            r = self.rules[k]
            strength[r.label] = max(strength.get(r.label, 0.0), r.strength)
        ordered = sorted(strength.values(), reverse=True)
        out = ordered[0] if ordered else 0.0
        for _ in ordered[1:]:
            out += (1.0 - out) / 2
        return out


def places(text: str, kept: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) in code points of the detections' words, in one pass over the text."""
    wanted = {w for _, a, b in kept for w in (a, b - 1)}
    spans = {}
    if wanted:
        last = max(wanted)
        for n, m in enumerate(re.finditer(r"[0-9A-Za-z\u0080-\U0010FFFF]+", text)):
            if n in wanted:
                spans[n] = m.span()
            if n == last:
                break
    return [(spans[a][0], spans[b - 1][1]) for _, a, b in kept]


DETECTION = "struct<label:string,rule:int,priority:int,first_word:bigint,n_words:bigint,start:bigint,end:bigint>"


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (of the places of base rules), base_labels, labels (arrays, sorted), score, and
    detections: an array of (label, rule number, priority, first word, words, start and end in code points)."""
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")
    item = pa.struct([("label", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.list_(item)]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]

    def run(batches):
        scanner = Scanner(rules)
        base_rules = set(scanner.base)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                words = words_of(text)
                found = scanner.detections(words)
                kept = scanner.resolve(found)
                base = [d for d in found if d[0] in base_rules]
                of = [scanner.rules[d[0]] for d in kept]
                starts = [a for _, a, _ in base]
                spans = places(text or "", kept)
                rows.append((
                    len(words), len(base), min(starts, default=None), max(starts, default=None),
                    sorted({scanner.rules[k].label for k, *_ in base}), sorted({r.label for r in of}), scanner.score(kept),
                    [{"label": r.label, "rule": k, "priority": r.priority, "first_word": a, "n_words": b - a, "start": s, "end": e} for r, (k, a, b), (s, e) in zip(of, kept, spans)],
                ))
            cols = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, detections array<{DETECTION}>")
