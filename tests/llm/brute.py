"""Plain versions of the operators, for small inputs, and the small input."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "Einszwei drei " * 3000

BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30", "other")
FAR = " ".join(f"w{i}" if i % 2 else f"word{i}" for i in range(60))
FOOT = "Share this page with your friends"

#: doc_id, text, lang, source
DOCS = [
    (1, BASE, "en", "a"), (2, NEAR, "en", "b"), (3, BASE, "en", "a"), (4, FAR, "en", "c"), (5, None, "en", "a"), (6, "", None, None), (7, " \n\t ", "en", "a"),
    (8, "Mail me at Jo.e@x-y.example.com or call +1 (212) 555-0100. Again: 212 555 0100", "en", "a"), (9, LONG, "de", "b"), (10, "one two", "en", "a"), (11, "One TWO", "en", "b"),
    (12, f"Intro line\n{FOOT}\nBody of twelve", "en", "a"), (13, f"{FOOT}\nother body", "en", "b"), (14, f"third\n  {FOOT} \nmore\n{FOOT}", "en", "c"), (15, f"fourth {FOOT}", "en", "d"),
    (16, "a b c d e a b c d e a b c d e x", "en", "d"), (17, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "d"), (17, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "d"),
    (None, BASE, "en", "a"), (None, "nobody owns this text at all, nobody", None, "e"), (None, FAR.replace("w40", "zz"), "en", "e"), (20, "née à Ñandú 漢字 12.3.4.5 and 4111 1111 1111 1111", "fr", "e"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Extra columns with names that operators use themselves.
CLASHES = ["n_words", "pos", "key", "site", "_row", "ids", "segment", "host", "perplexity", "kept", "score", "n_removed", "trusted", "spans"]


def documents(spark, rows=None):
    from pyspark.sql import functions as F

    return spark.createDataFrame(DOCS if rows is None else rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASHES})


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add(str(item))
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = ITEM_WORD.findall(lower(text)), set(), set()
        for i in range(len(w)):
            for n in {len(k) for k in wins}:
                if tuple(w[i : i + n]) in wins and i + n <= len(w):
                    hit.update(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


def shingles(text, k):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_duplicates(docs, k, percent=80):
    sets = [shingles(d[1], k) for d in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, d in enumerate(docs):
        groups[find(i)].append(d[0])
    out = []
    for i, d in enumerate(docs):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((d[0], len(sets[i]), min(ids) if ids else None))
    return out


def host_metrics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(w) - 4):
        grams[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def line_dedup(docs, min_sites):
    sites, first = defaultdict(set), {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0))
    for i in order:
        for pos, line in enumerate((docs[i][1] or "").split("\n") if docs[i][1] is not None else []):
            k = line.strip(" \t\r\x0b\x0c")
            if k:
                sites[k].add(docs[i][3] or "")
                first.setdefault(k, (docs[i][0], docs[i][1], pos))
    out = []
    for doc_id, text, _, _ in docs:
        if text is None:
            out.append((doc_id, None))
            continue
        left = []
        for pos, line in enumerate(text.split("\n")):
            k = line.strip(" \t\r\x0b\x0c")
            if not k or len(sites[k]) < min_sites or first[k] == (doc_id, text, pos):
                left.append(line)
        out.append((doc_id, "\n".join(left)))
    return out


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


class KneserNey:
    """Interpolated modified Kneser-Ney of order 3 over the items of sequences (lists), above a given lowest distribution.

    Each sequence has two starts before it. The highest order counts; lower orders count distinct items before.
    """

    def __init__(self, sequences, start, base):
        self.base, self.counts = base, [defaultdict(set), defaultdict(set), defaultdict(int)]
        for s in sequences:
            x = [start, start, *s]
            for a, b, c in zip(x, x[1:], x[2:]):
                self.counts[2][a, b, c] += 1
        for n in (2, 1):
            for key in self.counts[n]:
                self.counts[n - 1][key[1:]].add(key[0])
        self.counts = [{k: v if isinstance(v, int) else len(v) for k, v in c.items()} for c in self.counts]
        self.off, self.total, self.left = [], [], []
        for counts in self.counts:
            n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
            d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
            d = [x if 0 < x < k else 0.5 for k, x in zip((1, 2, 3), d)]
            total, left = defaultdict(int), defaultdict(float)
            for key, v in counts.items():
                total[key[:-1]] += v
                left[key[:-1]] += d[min(v, 3) - 1]
            self.off.append(d), self.total.append(total), self.left.append(left)

    def p(self, *key):
        n = len(key) - 1
        lower = self.p(*key[1:]) if n else self.base(key[0])
        total = self.total[n].get(key[:-1], 0)
        if not total:
            return lower
        v = self.counts[n].get(key, 0)
        return ((v - self.off[n][min(v, 3) - 1] if v else 0) + self.left[n][key[:-1]] * lower) / total


def perplexity(trusted):
    """A function from a text to its perplexity by character, trained on the trusted texts."""
    import math
    from functools import lru_cache

    words = [(t or "").lower().split() for t in trusted]
    words = [w for w in words if w]
    letters = [list((x + " ").encode()) for w in words for x in w] + [[10]] * len(words)
    known = {b for x in letters for b in x} | {10}
    size = len(known) + 1  # and one for all other bytes
    spelling = KneserNey(letters, None, lambda b: 1 / size)
    number = lambda b: b if b in known else -1

    @lru_cache(None)
    def spell(word):
        x = [None, None, *(number(b) for b in (word + " ").encode())] if word != "\n" else [None, None, 10]
        return math.exp(sum(math.log(spelling.p(*x[i : i + 3])) for i in range(len(x) - 2)))

    model = KneserNey([[*w, "\n"] for w in words], "", spell)

    def of(text):
        w = (text or "").lower().split()
        if not w:
            return None
        x = ["", "", *w, "\n"]
        total = sum(math.log(model.p(*x[i : i + 3])) for i in range(len(x) - 2))
        return math.exp(-total / (sum(map(len, w)) + len(w)))

    return of, model


def main_text(tree):
    """The main text of a page whose body holds the tree: (tag, children), where a child of p, h2 or a is a text."""

    def texts(x):
        return [x] if isinstance(x, str) else [t for c in x[1] for t in texts(c)]

    def length(x, links=False):
        if isinstance(x, str):
            return 0 if links else len(x)
        return length(x, False) if links and x[0] == "a" else sum(length(c, links) for c in x[1])

    parents, order = {}, []

    def walk(x, parent):
        if not isinstance(x, str):
            parents[id(x)] = parent
            order.append(x)
            for c in x[1]:
                walk(c, x)

    body = ("body", [tree])
    root = ("html", [body])
    walk(root, None)
    score = {id(x): 0.0 for x in order}
    for x in order:
        if x[0] in ("p", "h2") and length(x):
            text = "".join(texts(x))
            points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - length(x, True) / length(x))
            up = parents[id(x)]
            for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15):
                if up is not None:
                    score[id(up)] += points * share
                    up = parents[id(up)]
    worth = lambda x: score[id(x)] * (1 - length(x, True) / length(x) if length(x) else 0)
    best = max(order, key=worth)

    def prose(x):
        return length(x) and (x[0] in ("p", "h2") or any(prose(c) for c in x[1] if not isinstance(c, str)))

    if not worth(best):
        kept = [root]
    elif parents[id(best)] is None:
        kept = [best]
    else:
        kept = [c for c in parents[id(best)][1] if c is best or worth(c) >= 0.2 * worth(best) or 2 * length(c, True) < length(c) and prose(c)]
    blocks = []

    def collect(x):
        if x[0] in ("p", "h2"):
            blocks.append("".join(texts(x)))
        else:
            for c in x[1]:
                collect(c)

    for x in kept:
        collect(x)
    return "\n".join(b for b in blocks if b)


def page(x):
    return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(page, x[1]))}</{x[0]}>"
