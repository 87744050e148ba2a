"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns with checks (email, IP address, payment card, phone). A conditional random field then
labels the tokens that hold a digit, @ or an at in brackets, and the tokens next to them, as the beginning or the inside of a kind of entity, or
as none. Besides the four kinds it knows secrets, such as access tokens. Its factors: features of a token (its whole shape,
counts, checks, the words before and after); the labels of neighbouring tokens; and skip edges, which tie tokens whose
number or address repeats anywhere in the document, or is similar (the same local part of an address, a number with the same
beginning and length). So a number written without its plus sign, or an address with [at], is found because the same one stands elsewhere as a
phone or an email. All occurrences of a group are tied to one hub, a variable over kinds: a token that occurs a thousand times has a
thousand edges, not a million, and any two are two steps apart. What a pattern knows is observed: a base span's tokens have their label, and the hub of
what repeats a base span has its kind, so what is known reaches any number of repeats undiminished. All other hubs are free. Loopy message passing
runs until messages stand still; it is exact where the document's graph is a tree. A document whose messages don't settle is labelled without its free hubs, which leaves a tree.

All weights are trained here together, by the pseudo-likelihood of the tokens given their hubs, on a bounded sample of documents
(SAMPLE, chosen by hash, of at most MOST_TOKENS tokens each). Labels are those of the base patterns, and of a pattern for
secrets with a cue. Since patterns miss the mentions that are to be found, each sampled document gets further ones: an
entity of a kind drawn at random, its own or a made one in one of the layouts that the patterns know, and repeats of it in layouts that they don't (examples);
and numbers, addresses and strings in all these layouts that nothing marks, once or several times (counter-examples).

A token whose probability of a kind is at least `sure`, and that touches no base span, becomes a further span; tokens next
to each other become one unless a new entity is twice as likely to begin.

Null or empty text: no spans. Very long texts are read whole, in time and memory linear in the text. Positions are code
points, ends exclusive. Rows are independent of each other, repeated rows are alike; of equal probabilities the kind that
comes first in LABELS counts. No documents: nothing is learned, nothing found. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.common import small_batches

#: The kinds of base spans, and all kinds.
KINDS = ("email", "ip", "card", "phone")
ENTITIES = (*KINDS, "secret")
#: No entity, the beginning of each kind, the inside of each.
LABELS = ("", *ENTITIES, *ENTITIES)
SAMPLE, MOST_TOKENS = 600, 500
BUCKETS = 1 << 12
#: Messages are damped more after so many rounds, and again, until they stand still; below the least step they don't settle.
ROUNDS, LEAST_STEP = 200, 2.0**-6
STILL = 1e-7
#: The log factor of a label that is known not to be.
NEVER = -1e4

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]|[\[({][aA][tT][\])}]")
AT, DOT = re.compile(r"[\[({]at[\])}]", re.I), re.compile(r"[\[({](?:dot|\.)[\])}]", re.I)
#: Four small numbers with the same sign between them.
FOUR = re.compile(r"(?<![0-9])([0-9]{1,3})(\.|-|_|,|/|[\[({](?:\.|dot)[\])}])([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})(?![0-9])", re.I)
TOKEN = re.compile(r"\S+")
SECRET = re.compile(r"""(?i)(?:token|key|secret|passw(?:or)?d|pwd)["']?\s*[=:]\s*["']?([A-Za-z0-9_+/=-]{16,})""")
#: A part of a number, and what may follow the last one.
PART = re.compile(r"""([+(]*[0-9][0-9().-]*?)[.,;:!?"']*""")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and not overlapping within a kind."""
    out: list[tuple[str, int, int]] = []
    at, to = text.find("@"), 0
    while at >= 0:  # the part before @ goes back to the last character that can't stand in it
        start = at
        while start > to and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            to = m.end()
        else:
            to = max(to, at + 1)  # @ itself can't stand in it
        at = text.find("@", max(to, at + 1))
    for m in IP.finditer(text):
        if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of other characters than white space that hold a digit or @."""
    out, to = [], 0
    m = MARK.search(text)
    while m:
        start = m.start()
        while start > to and not text[start - 1].isspace():
            start -= 1
        to = TOKEN.match(text, m.start()).end()
        out.append((start, to))
        m = MARK.search(text, to)
    return out


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation around."""
    while start < end and not (text[start].isalnum() or text[start] == "+"):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings with a letter and a digit behind a word for a secret, apart from base spans: evidence, and labels to learn from."""
    if not MARK.search(text):
        return []
    found = [m.span(1) for m in SECRET.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]
    return [("secret", a, b) for a, b in found if not any(a < e and s < b for _, s, e in base)] if found else []


def tokens_near(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether it is a candidate) of the candidates and the tokens next to them, in order."""
    out: list[tuple[int, int, bool]] = []
    found = candidates(text)
    for k, (start, end) in enumerate(found):
        at, to = start, out[-1][1] if out else 0
        while at > to and text[at - 1].isspace():
            at -= 1
        if at > to:
            first = at
            while first > to and not text[first - 1].isspace():
                first -= 1
            out.append((first, at, False))
        out.append((start, end, True))
        m = TOKEN.search(text, end)
        if m and (k + 1 == len(found) or m.start() < found[k + 1][0]):
            out.append((*m.span(), False))
    return out


def _plain(token: str) -> str:
    return re.sub("[0-9]", "0", token.lower())


FEATURES, AROUND = 12, (8, 9)


def token_features(token: str, before: str, after: str) -> list[int]:
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "0", token))
    digits = re.sub(r"[^0-9]", "", token)
    core = token.strip("\"'()[]{}<>.,;:!?")
    mixed = len(core) >= 16 and digits and re.fullmatch(r"[A-Za-z0-9_+/=-]*[A-Za-z][A-Za-z0-9_+/=-]*", core)
    named = [
        "bias", "shape " + re.sub("a0(a0)+", "a0~", shape), f"n {len(digits)}", "@" if "@" in token or AT.search(token) else "no @", f"dots {token.count('.')}",
        "letters" if re.search("[A-Za-z]", token) else "none", "luhn" if 14 <= len(digits) <= 19 and luhn(digits) else "no luhn",
        "+" if token[0] == "+" else "no +", "before " + _plain(before), "after " + _plain(after), "mixed" if mixed else "no mix", "given" if before[-1:] in ("=", ":") else "not given",
    ]
    return [_hash(x) for x in named]


def repeat_key(text: str, start: int, end: int) -> str | None:
    """Equal for tokens that say the same: an address in lower case, @ and dots plain; four small numbers; the digits of a number of six or more."""
    token = text[start:end]
    if "@" in token or AT.search(token):
        a, b = _core(text, start, end)
        return DOT.sub(".", AT.sub("@", text[a:b])).lower()
    if four := four_numbers(token):
        return four
    return number_key(re.sub(r"[^0-9]", "", token))


def entity_key(kind: str, text: str) -> str | None:
    """The key of a span of this kind, as repeat_key() gives it for its repeats."""
    if kind == "email":
        return DOT.sub(".", AT.sub("@", text)).lower()
    if kind == "ip":
        return four_numbers(text) or "ip " + ".".join(x.lstrip("0") or "0" for x in text.split("."))
    return number_key(re.sub(r"[^0-9]", "", text))


def four_numbers(token: str) -> str | None:
    m = FOUR.search(token)
    parts = [int(x) for x in m.group(1, 3, 4, 5)] if m else [256]
    return "ip " + ".".join(map(str, parts)) if max(parts) <= 255 else None


def number_key(digits: str) -> str | None:
    """Equal for one number with and without its country code or leading zero: the last nine digits, unless it is longer than
    a phone number, or shorter than nine; nothing below six."""
    return None if len(digits) < 6 else digits[-9:] if len(digits) <= 15 else digits


def occurrences(text: str, spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, range]]:
    """(key, candidates) for each number or address that may repeat: base spans, numbers written in several candidates, and
    single candidates. base: by start."""
    out = []
    k = 0
    for kind, a, b in base:
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        n = k
        while n < len(spans) and spans[n][0] < b:
            n += 1
        key = text[a:b] if kind == "secret" else entity_key(kind, text[a:b])
        if key:
            out.append((key, range(k, n)))
    run: list[str] = []
    for k, (start, end) in enumerate([*spans, (len(text) + 2, len(text) + 2)]):
        token = text[start:end]
        part = PART.fullmatch(token)
        digits = re.sub(r"[^0-9]", "", token)
        if run and (not part or len(digits) >= 9 or token[0] == "+" or start - spans[k - 1][1] != 1 or spans[k - 1][1] - spans[k - 1][0] > len(PART.fullmatch(text[slice(*spans[k - 1])])[1])):
            if len(run) > 1 and sum(map(len, run)) <= 19 and (key := number_key("".join(run))):
                out.append((key, range(k - len(run), k)))
            run = []
        if part and len(digits) < 9:
            run.append(digits)
        if k < len(spans):
            core = slice(*_core(text, start, end))
            if key := repeat_key(text, start, end):
                out.append((key, range(k, k + 1)))
            if len(text[core]) >= 16:  # strings that may be secrets
                out.append((text[core], range(k, k + 1)))
    return out


def similar_keys(found: list[tuple[str, range]]) -> list[tuple[str, range]]:
    """Keys that similar numbers and addresses share: the local part; the length and all digits but the last three. Of what says the same only the
    first place counts, which its own hub ties to the others, so many repeats weigh no more than one."""
    out, seen = [], set()
    for key, at in found:
        if key in seen:
            continue
        seen.add(key)
        if "@" in key:
            local = re.sub(r"\+.*|[._-]", "", key.split("@")[0])
            if len(local) >= 4:
                out.append(("@" + local, at))
        elif key.isdigit() and len(key) >= 9:
            out.append((f"{len(key)} {key[:-3]}", at))
    return out


class Graph:
    """Tokens of many texts, with chain edges to the next token and spokes to the hubs of what repeats or is similar."""

    def __init__(self):
        #: for each token: its text, its place, features, label (given by a base span, or 0)
        self.owner, self.span, self.features, self.label = [], [], [], []
        #: (token, next token); (token, hub, 0: repeats, 1: similar); the number of hubs
        self.chain, self.spokes, self.hubs = [], [], 0
        #: the kinds (numbers from 1) that are known of a hub; none of most
        self.known: dict[int, set[int]] = {}

    def add(self, owner: int, text: str, base: list[tuple[str, int, int]]) -> None:
        first = len(self.span)
        near = tokens_near(text)
        by_start = sorted(base, key=lambda s: s[1])
        k, last = 0, None
        for n, (start, end, candidate) in enumerate(near):
            while k < len(by_start) and by_start[k][2] <= start:
                k += 1
            label = 0
            if candidate and k < len(by_start) and by_start[k][1] < end:
                label = 1 + ENTITIES.index(by_start[k][0]) + (len(ENTITIES) if last == k else 0)
                last = k
            joined = [n + d >= 0 and n + d < len(near) and text[near[min(n, n + d)][1] : near[max(n, n + d)][0]].isspace() for d in (-1, 1)]
            around = [text[slice(*near[n + d][:2])] if ok else "" for d, ok in zip((-1, 1), joined)]
            if joined[0]:
                self.chain.append((first + n - 1, first + n))
            self.owner.append(owner)
            self.span.append((start, end))
            self.label.append(label)
            self.features.append(token_features(text[start:end], *around))
        node = [first + n for n, x in enumerate(near) if x[2]]
        found = occurrences(text, [x[:2] for x in near if x[2]], by_start)
        for kind, keys in ((0, found), (1, similar_keys(found))):
            groups: dict[str, dict[range, None]] = {}
            for key, at in keys:
                groups.setdefault(key, {})[at] = None
            for places in groups.values():
                tokens = sorted({node[i] for at in places for i in at})
                if max(map(len, places)) == len(tokens):
                    continue  # nothing but one place
                self.spokes += [(t, self.hubs, kind) for t in tokens]
                given = {1 + (self.label[t] - 1) % len(ENTITIES) for t in tokens if self.label[t]}
                if kind == 0 and given:
                    self.known[self.hubs] = given
                self.hubs += 1


def marginals(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy message passing. unary: log factors; kinds: which of the tables of log factors an edge has."""
    return settled_marginals(unary, edges, kinds, tables)[0]


def settled_marginals(unary: np.ndarray, edges: np.ndarray, kinds: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities, and the edges whose messages haven't settled."""
    n, labels = unary.shape

    def normal(x):
        top = x.max(1, keepdims=True)
        return x - top - np.log(np.exp(x - top).sum(1, keepdims=True))

    if not len(edges):
        return np.exp(normal(unary)), np.zeros(0, int)
    m = len(edges)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(m) + m, np.arange(m)])
    factor = np.concatenate([np.exp(tables), np.exp(tables.transpose(0, 2, 1))])
    kind = np.concatenate([kinds, kinds + len(tables)])
    of_kind = [(f, np.flatnonzero(kind == k)) for k, f in enumerate(factor)]
    order = np.argsort(target, kind="stable")
    hit, at = np.unique(target[order], return_index=True)
    message = np.full((2 * m, labels), -np.log(labels))

    def beliefs():
        out = unary.copy()
        out[hit] += np.add.reduceat(message[order], at, axis=0)
        return out

    step, moved = 0.5, np.full(2 * m, np.inf)
    while moved.max() >= STILL and step >= LEAST_STEP:
        for _ in range(ROUNDS):
            belief = beliefs()
            away = np.exp(normal(belief[source] - message[back]))
            new = np.empty_like(message)
            for f, of in of_kind:
                new[of] = away[of] @ f
            new = normal(np.log(new))
            moved = np.abs(new - message).max(1)
            message += step * (new - message)
            if moved.max() < STILL:
                break
        step /= 2
    return np.exp(normal(beliefs())), np.flatnonzero(np.maximum(moved[:m], moved[m:]) >= STILL)


class Field:
    """weights: of each feature and label; chain: of a label and the next; spokes: of a label and a hub's kind, for hubs of repeats
    and of similar tokens."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, spokes: np.ndarray):
        self.weights, self.chain, self.spokes = weights, chain, spokes

    def factors(self, g: Graph, free: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """unary, edges, kinds, tables; hubs come after the tokens, and are no entity or the beginning of one. Hubs of known kinds are part of their
        tokens' own factors. free: whether there are other hubs."""
        n, label = len(g.span), np.array(g.label)
        unary = self.weights[np.array(g.features)].sum(1)
        for t, h, kind in g.spokes:
            if h in g.known:
                unary[t] += np.logaddexp.reduce(self.spokes[kind][:, sorted(g.known[h])], axis=1)
        unary -= unary.max(1, keepdims=True)
        given = np.flatnonzero(label)
        unary[given] = NEVER
        unary[given, label[given]] = 0.0
        hubs = np.zeros((g.hubs, len(LABELS)))
        hubs[:, 1 + len(ENTITIES) :] = NEVER
        spokes = [(t, n + h, kind) for t, h, kind in g.spokes if free and h not in g.known]
        edges = np.array([*g.chain, *((t, h) for t, h, _ in spokes)], np.int64).reshape(-1, 2)
        kinds = np.array([2] * len(g.chain) + [k for *_, k in spokes], np.int64)
        return np.concatenate([unary, hubs]), edges, kinds, np.stack([*self.spokes, self.chain])

    def probabilities(self, g: Graph) -> np.ndarray:
        """Of each label, for each token."""
        if not g.span:
            return np.zeros((0, len(LABELS)))
        unary, edges, kinds, tables = self.factors(g)
        out, unsettled = settled_marginals(unary, edges, kinds, tables)
        out = out[: len(g.span)]
        if len(unsettled):
            owner = np.array(g.owner)
            lost = np.isin(owner, owner[edges[unsettled, 0]])
            out[lost] = marginals(*self.factors(g, free=False))[: len(g.span)][lost]
        return out


# -- training ----------------------------------------------------------------------------------------------------------


def _groups(d: str) -> tuple[str, str, str, str]:
    """Country code, area and the two parts of a phone number."""
    return d[:-10], d[-10:-7], d[-7:-4], d[-4:]


#: Ways to write an entity that the patterns know, and ways that they don't. d: its digits; for others the text itself.
KNOWN = {
    "phone": [lambda d: "+{} ({}) {}-{}".format(*_groups(d)), lambda d: "+" + d, lambda d: "+{}-{}-{}-{}".format(*_groups(d)), lambda d: "+{} {} {} {}".format(*_groups(d)), lambda d: "+{}.{}.{}.{}".format(*_groups(d))],
    "card": [lambda d: d, lambda d: " ".join(d[k : k + 4] for k in range(0, len(d), 4)), lambda d: "-".join(d[k : k + 4] for k in range(0, len(d), 4))],
    "ip": [lambda d: d],
    "email": [lambda d: d],
    "secret": [lambda d: f"token = {d}"],
}
OTHER = {
    "phone": [lambda d: d, lambda d: d[-10:], lambda d: "{1}-{2}-{3}".format(*_groups(d)), lambda d: "{1}.{2}.{3}".format(*_groups(d)), lambda d: "({1}) {2}-{3}".format(*_groups(d)), lambda d: "{1} {2} {3}".format(*_groups(d)), lambda d: "{0} ({1}) {2}-{3}".format(*_groups(d)).strip(), lambda d: "{0}-{1}-{2}-{3}".format(*_groups(d)).strip("-")],
    "card": [lambda d: ".".join(d[k : k + 4] for k in range(0, len(d), 4)), lambda d: "/".join(d[k : k + 4] for k in range(0, len(d), 4))],
    "ip": [lambda d: d.replace(".", "-"), lambda d: d.replace(".", "[.]"), lambda d: d.replace(".", "_")],
    "email": [lambda d: d.replace("@", "[at]"), lambda d: d.replace("@", "(at)"), lambda d: d.replace("@", "(at)").replace(".", "[dot]")],
    "secret": [lambda d: d],
}


def plain(kind: str, text: str) -> str:
    """What the ways to write an entity start from."""
    return re.sub("[^0-9]", "", text) if kind in ("phone", "card") else text


def made_entity(kind: str, rng: np.random.Generator) -> str:
    """A random entity, in plain form."""
    draw = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    if kind == "phone":
        return draw("123456789", 1) + draw("23456789", 1) + draw("0123456789", 9)
    if kind == "card":
        head = draw("3456", 1) + draw("0123456789", 14)
        return next(head + c for c in "0123456789" if luhn(head + c))
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(1, 256, 4))
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == "email":
        return f"{draw(letters, int(rng.integers(2, 8)))}.{draw(letters, int(rng.integers(2, 9)))}@{draw(letters, int(rng.integers(3, 9)))}.{('com', 'org', 'example', 'net')[rng.integers(4)]}"
    return draw("0123456789abcdef", 39) + "a7"


def repeated(kind: str, entity: str, rng: np.random.Generator) -> str | None:
    """The entity in a way that the patterns don't know."""
    ways = OTHER[kind]
    out = ways[rng.integers(len(ways))](entity)
    return None if base_spans(out) else out


#: Where a mention can be inserted without touching another one.
BETWEEN_WORDS = re.compile(r"[^\W\d_] [^\W\d_]")


def example(text: str, rng: np.random.Generator) -> tuple[str, list, list]:
    """The text with further mentions, its spans that patterns know, and those of the further mentions."""
    inserts: list[tuple[int, str, str]] = []

    def insert(kind: str, word: str) -> None:
        m = BETWEEN_WORDS.search(text, int(rng.integers(0, len(text) + 1))) or BETWEEN_WORDS.search(text)
        if m and m.start() + 1 not in {at for at, *_ in inserts}:
            inserts.append((m.start() + 1, kind, word))

    own = base_spans(text)
    own += secret_spans(text, own)
    for kind in rng.permutation(ENTITIES)[: int(rng.integers(1, 4))].tolist():
        mine = [s for s in own if s[0] == kind]
        if mine and rng.random() < 0.5:
            _, a, b = mine[rng.integers(len(mine))]
            entity = plain(kind, text[a:b])
        else:
            entity = made_entity(kind, rng)
            insert("", KNOWN[kind][rng.integers(len(KNOWN[kind]))](entity))
        for _ in range((1, 1, 2, 4)[rng.integers(4)]):
            if word := repeated(kind, entity, rng):
                insert(kind, word)
    for kind in rng.choice(ENTITIES, int(rng.integers(2, 8))).tolist():  # what nothing marks, once or several times
        entity = made_entity(kind, rng)
        for _ in range((1, 1, 1, 3)[rng.integers(4)]):
            if word := repeated(kind, entity, rng):
                insert("", word)
    parts, at, spans, moved = [], 0, [], 0
    for where, kind, word in sorted(inserts, key=lambda x: x[0]):
        parts += [text[at:where], " ", word]
        at = where
        if kind:
            spans.append((kind, where + moved + 1, where + moved + 1 + len(word)))
        moved += 1 + len(word)
    made = "".join([*parts, text[at:]])
    base = base_spans(made)
    cued = base + secret_spans(made, base)
    return made, cued, [s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in cued)]


def _sample(docs: DataFrame, most: int) -> list:
    """Features, labels, weights and edges of about `most` documents that have candidates."""
    d = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.length("text") > 20)
    n = d.count()
    taken = d.where(F.pmod("h", F.lit(1 << 30)) < F.lit(most / max(n, 1) * (1 << 30)))
    copies = max(1, min(8, most // max(n, 1)))  # a small sample is used more than once, with other mentions

    def run(batches):
        for batch in batches:
            rows = []
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(candidates(text)) > MOST_TOKENS:
                    continue
                for copy in range(copies):
                    made, spans, more = example(text, np.random.default_rng(h % (1 << 32) + copy))
                    g = Graph()
                    g.add(0, made, spans + more)
                    rows.append((h, g.features, g.label, g.chain, g.spokes))
            cols = list(zip(*rows)) or [()] * 5
            pairs = pa.list_(pa.list_(pa.int32()))
            kinds = (pa.int64(), pairs, pa.list_(pa.int32()), pairs, pairs)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["h", "f", "y", "chain", "spokes"])

    schema = "h bigint, f array<array<int>>, y array<int>, chain array<array<int>>, spokes array<array<int>>"
    return sorted(taken.mapInArrow(run, schema).collect(), key=lambda r: (r.h, r.y))


def train(docs: DataFrame, most: int = SAMPLE, epochs: int = 120, rate: float = 0.15, decay: float = 1e-2) -> Field:
    """A field whose three kinds of factors maximise the pseudo-likelihood of the sample together (by Adam)."""
    rows = _sample(docs, most)
    labels = len(LABELS)
    field = Field(np.zeros((BUCKETS, labels)), np.zeros((labels, labels)), np.zeros((2, labels, labels)))
    f, y, left, right, token, hub, kind, hubs = ([] for _ in range(8))
    for r in rows:
        n, m = len(y), len(hubs)
        f += r.f
        y += r.y
        left += [n + a for a, _ in r.chain]
        right += [n + b for _, b in r.chain]
        token += [n + t for t, _, _ in r.spokes]
        hub += [m + h for _, h, _ in r.spokes]
        kind += [k for *_, k in r.spokes]
        said: dict[int, int] = {}
        for t, h, _ in r.spokes:
            entity = r.y[t] - len(ENTITIES) if r.y[t] > len(ENTITIES) else r.y[t]
            said[h] = said.get(h) or entity  # a hub is what one of its tokens is
        hubs += [said[h] for h in range(len(said))]
    if not y:
        return field
    f, y, left, right, token, hub, kind, hubs = (np.array(x) for x in (f, y, left, right, token, hub, kind, hubs))
    left, right, token, hub, kind, hubs = (x.astype(np.int64) for x in (left, right, token, hub, kind, hubs))
    params = [field.weights, field.chain, field.spokes]
    mean, spread = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]

    def views(columns):  # some of the features of all tokens, and where each feature occurs
        part = f[:, columns]
        order = np.argsort(part, axis=None, kind="stable")
        return part, *np.unique(part.ravel()[order], return_index=True), order // len(columns)

    # every other step does without the words around, which a small sample lets the field learn by heart
    every = [views(list(range(FEATURES))), views([j for j in range(FEATURES) if j not in AROUND])]

    def off(z, want):  # the gradient of -log softmax
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(want)), want] -= 1
        return p

    for epoch in range(epochs):
        part, used, first, of_feature = every[epoch % 2]
        z = field.weights[part].sum(1)
        np.add.at(z, right, field.chain[y[left]])
        np.add.at(z, left, field.chain[:, y[right]].T)
        np.add.at(z, token, field.spokes[kind, :, hubs[hub]] if len(hub) else np.zeros((0, labels)))
        g = off(z, y)
        grads = [decay * x * len(y) / 1000 * part for x, part in zip(params, (1, 0.1, 0.1))]
        grads[0][used] += np.add.reduceat(g[of_feature], first, axis=0)
        np.add.at(grads[1], y[left], g[right])
        np.add.at(grads[1].T, y[right], g[left])
        np.add.at(grads[2].transpose(0, 2, 1), (kind, hubs[hub]), g[token])
        for x, m, v, d in zip(params, mean, spread, grads):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    # a hub's kind gives its tokens a distribution of labels, so that tokens without evidence say nothing about it
    field.spokes -= np.log(np.exp(field.spokes).sum(1, keepdims=True))
    return field


# -- finding -----------------------------------------------------------------------------------------------------------


BASE_LABELS = [1 + k + i for k in range(len(KINDS)) for i in (0, len(ENTITIES))]


def further_spans(g: Graph, p: np.ndarray, sure: float) -> list[tuple[int, str, int, int]]:
    """(text, kind, first token, last token) of entities that have no label of a base span."""
    n = len(ENTITIES)
    by_kind = p[:, 1 : 1 + n] + p[:, 1 + n :]
    best = by_kind.argmax(1) if len(p) else []
    chained = {b for _, b in g.chain}
    out: list[list] = []
    for i in np.flatnonzero((by_kind.max(1, initial=0) >= sure) & ~np.isin(np.array(g.label, int), BASE_LABELS)).tolist():
        k = int(best[i])
        if out and out[-1][3] == i - 1 and i in chained and out[-1][1] == ENTITIES[k] and 2 * p[i, 1 + n + k] >= p[i, 1 + k]:
            out[-1][3] = i
        else:
            out.append([g.owner[i], ENTITIES[k], i, i])
    return [tuple(x) for x in out]


def find(docs: DataFrame, field: Field, sure: float = 0.7) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) by start, then kind as in ENTITIES; spans holds base and more."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    order = lambda s: (s[1], ENTITIES.index(s[0]), s[2])

    def run(batches):
        field = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base, g = [[] for _ in texts], Graph()
            for k, text in enumerate(texts):
                if text and MARK.search(text):
                    base[k] = sorted(base_spans(text), key=order)
                    g.add(k, text, base[k] + secret_spans(text, base[k]))
            every = [list(b) for b in base]
            for k, kind, i, j in further_spans(g, field.probabilities(g), sure):
                start, end = _core(texts[k], g.span[i][0], g.span[j][1])
                if start < end:
                    every[k].append((kind, start, end))
            rows = [[[dict(zip(("kind", "start", "end"), s)) for s in sorted(x, key=order)] for x in col] for col in (base, every)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], span), pa.array(rows[1], span)], ["doc_id", "base", "spans"])

    d = docs.select("doc_id", "text")
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, base {kind}, spans {kind}")
