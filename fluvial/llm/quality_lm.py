"""Quality by perplexity under an interpolated modified Kneser-Ney model of word trigrams, trained on all trusted texts.

Every word and every n-gram that occurs in a trusted text counts; there is no vocabulary, and words are 64-bit hashes. The
lowest order is interpolated with a model that spells words: byte trigrams, again by modified Kneser-Ney. So an unknown word
costs what its letters cost, in any script. A text is START START w1 ... wn END.

Shards. A trigram goes to the shard of its middle word, and with it all that its probability needs but the counts of single
words: its count, the totals of its context (first two words), the words before its last two, and the totals of the middle word.
A middle word of more than `hot` tokens is spread: trigrams over several shards by their first word, and the gains of their
last two words over as many by the last one. What such shards need of each other are bigram counts, summed in joins by key. All
trigrams that share their first two words are in one shard.

Training sums counts in the shards: how many n-grams occur once, twice and so on, for the discounts, and after how many words
each word occurs. A table then tells each shard the words' counts that it needs, and those of bigrams of spread words.

Scoring. All texts send their trigrams to the shards, trusted ones as well for the counts, which are made again there, not
stored. A text's log probability is that of spelling all its words, plus the gain of each n-gram in it: what the n-gram
adds beyond its own suffix, with its weight as a context. Both go in rounds over shares of the shards: texts are read again in each, and what a round
shuffles is deleted at its end, so disk holds a share of the n-grams. They travel in packs, where frequent words have numbers that all
packs share and others take their hashes along. A shard gives all its words numbers and sums slices of middle words one after the
other, so temporary memory is that of a slice. Equal texts have equal scores, so sums go by a hash of the text.

Perplexity is that of a character: all log probabilities over the number of characters of words and the spaces after
them. A document is kept if its perplexity is at most that quantile of the held-out trusted documents of its language, times
`slack`, and times exp(short / root of its characters), since the perplexity of a short text varies more. The quantiles
are exact on a scale of BINS steps for each unit of log perplexity. Held out is one of FOLDS shares of the trusted texts: the
model isn't trained on it, since it knows its own texts by heart and limits taken from those would reject all others.
Languages without held-out documents use the quantile over all languages.

Null, empty or blank text: no perplexity, not kept. Null language: the language "". Repeated rows count and are judged
each; a document is trusted if any of its labels says so. Without held-out documents nothing is dropped but documents
without text; without documents the result is empty. Very long texts are read whole, in memory linear in the text. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvial.common import checked_join, freed_shuffles, materialize, scratch, shuffled_join, skew_join, small_batches

BINS = 1000
FOLDS = 5
#: A middle word of more tokens is spread over shards of about half as many.
HOT = 1_000_000
#: Of so many tokens each, but at least SHARDS a round.
SHARD_TOKENS = 2_000_000
SHARDS = 16
#: At most so many rounds, of at least ROUND_TOKENS tokens.
ROUNDS = 4
ROUND_TOKENS = 2_000_000
#: A pack holds the trigrams of one shard in so many tokens of a task, or a batch more.
PACK_TOKENS = 1_000_000
#: So many of the most frequent words have numbers that all packs share; others take their hashes along. All words count alike in the model.
BOOK = 1 << 15
#: A task names words that make up more than 1 / NAMED of its tokens, so that the most frequent ones of all are found.
NAMED = 200_000
#: Sums over a shard take so many of its trigrams at a time, or those of one middle word.
SLICE = 500_000
#: Bits of a number that stands for three words.
BITS = 64
#: No longer used: there is no Bloom filter any more, but tests set it.
BLOOM_BITS = 27

START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (" start", " end"))  # no word has a space


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def words_in(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The words_of() all texts, and how many each has, without an object for each word."""
    trimmed = pc.utf8_trim_whitespace(strings(t.lower() if t else "" for t in texts))
    split = pc.utf8_split_whitespace(trimmed)
    empty = pc.binary_length(trimmed).to_numpy() == 0  # such a text is split into one empty word
    words = split.flatten()
    return words.filter(pc.not_equal(words, "")) if empty.any() else words, np.where(empty, 0, pc.list_value_length(split).to_numpy())


def strings(words: Iterable[str]) -> pa.Array:
    return pa.array(list(words), pa.string())


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# -- spelling ----------------------------------------------------------------------------------------------------------


def discounts(n: list[int]) -> list[float]:
    """Discounts for counts of one, two, and three or more, from how many n-grams have a count of 1, 2, 3 and 4.

    Where those are too few to give a discount between 0 and the count, it is 0.5.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return [x if 0 < x < k else 0.5 for k, x in zip((1, 2, 3), d)]


class Speller:
    """log p(byte | two bytes before) in words, where 0 stands before a word, a space ends it and a \\n is the END of a text."""

    def __init__(self, counts: np.ndarray | None = None, symbol: np.ndarray | None = None):
        """counts: how often each trigram of symbols occurs; symbol: that of each byte, from 1; the last is that of all others."""
        self.symbol = np.ones(256, np.int64) if symbol is None else symbol
        a = self.size = int(self.symbol.max()) + 1
        c3 = np.zeros((a, a, a), np.int64) if counts is None else counts.reshape(a, a, a)
        c2 = (c3 > 0).sum(0)
        p = np.full(a, 1 / (a - 1))
        p[0] = 0.0  # nothing is followed by what stands before a word
        for c in ((c2 > 0).sum(0), c2, c3):
            d = np.array([0.0, *discounts([int((c == k).sum()) for k in (1, 2, 3, 4)])])[np.minimum(c, 3)]
            total = c.sum(-1, keepdims=True)
            p = np.where(total > 0, (c - d) / np.maximum(total, 1) + d.sum(-1, keepdims=True) / np.maximum(total, 1) * p, p)
        with np.errstate(divide="ignore"):
            self.log_p = np.log(p).astype(np.float32).ravel()
        self.end = float(self.log_p[self.symbol[10]])

    def keys(self, spelled: np.ndarray) -> np.ndarray:
        """The trigram that ends in each byte of words, each followed by a space."""
        s, space = self.symbol[spelled], spelled == 32
        one = np.concatenate([[0], np.where(space[:-1], 0, s[:-1])])[: len(s)]
        two = np.concatenate([[0, 0], np.where(space[1:-1] | space[:-2], 0, s[:-2])])[: len(s)]
        return (two * self.size + one) * self.size + s

    def spell(self, spelled: np.ndarray) -> np.ndarray:
        return self.log_p[self.keys(spelled)]


def spelled(words: pa.Array) -> np.ndarray:
    """The bytes of words, each followed by a space."""
    data = pc.binary_join_element_wise(words, "", " ").buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)


def spellings(words: pa.Array, speller: Speller) -> np.ndarray:
    """The log probability of the letters of each word."""
    if not len(words):
        return np.zeros(0)
    n = pc.binary_length(words).to_numpy() + 1
    return np.add.reduceat(speller.spell(spelled(words)).astype(float), np.cumsum(n) - n)


def train_speller(trusted: DataFrame) -> Speller:
    """From all trusted texts. On the driver: one row for each trigram of byte values that occurs."""

    def seen(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            total += np.bincount(spelled(words_in(batch.column(0).to_pylist())[0]), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total))], ["b"])

    found = sorted(r.b for r in trusted.select("text").mapInArrow(seen, "b bigint").distinct().collect())
    symbol = np.full(256, len({*found, 10}) + 1, np.int64)
    symbol[sorted({*found, 10})] = np.arange(1, len({*found, 10}) + 1)
    plain = Speller(symbol=symbol)
    a = plain.size

    def count(batches):
        total = np.zeros(a**3, np.int64)
        for batch in batches:
            words, size = words_in(batch.column(0).to_pylist())
            total[symbol[10]] += np.count_nonzero(size)
            if len(words):  # each word is spelled once, and counts as often as it occurs
                each, n = words.value_counts().flatten()
                keys, at = np.unique(plain.keys(spelled(each)), return_inverse=True)
                total[keys] += np.bincount(at, np.repeat(n.to_numpy(), pc.binary_length(each).to_numpy() + 1)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["key", "c"])

    rows = trusted.select("text").mapInArrow(count, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(a**3, np.int64)
    counts[rows.column("key").to_numpy()] = rows.column("c").to_numpy()
    return Speller(counts, symbol)


# -- shards ------------------------------------------------------------------------------------------------------------


@dataclass
class Deal:
    """Which shard has a trigram: words with more than one part are spread."""

    shards: int
    rounds: int
    #: rounds of training, in which only trusted texts travel
    training: int
    #: hashes of the words that are spread, ascending, and over how many shards each
    spread: np.ndarray
    parts: np.ndarray
    #: the most frequent words
    book: list[str]

    def parts_of(self, word: np.ndarray) -> np.ndarray:
        found, at = lookup(self.spread, word)
        return np.where(found, self.parts[at] if len(self.parts) else 1, 1)


def lookup(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether ascending keys hold each asked one, and where; 0 if not."""
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    found = keys[at] == asked
    return found, np.where(found, at, 0)


def dealt(texts: DataFrame, hot: int) -> Deal:
    """Of texts: text, learned. On the driver: a row for each word that is spread, and BOOK others."""

    def count(batches):
        words, held, n, total, trusted = Counter(), [], 0, 0, 0

        def count_held():
            each, times = pa.chunked_array(held, pa.string()).value_counts().flatten()
            often = times.to_numpy() * NAMED > n
            words.update(dict(zip(each.filter(pa.array(often)).to_pylist(), times.to_numpy()[often].tolist())))

        for batch in batches:
            of, size = words_in(batch.column(0).to_pylist())
            tokens = size + (size > 0)
            held.append(of)
            n += len(of)
            total += int(tokens.sum())
            trusted += int(tokens[batch.column(1).to_numpy(zero_copy_only=False).astype(bool)].sum())
            words[" start"] += int(np.count_nonzero(size))
            if n > PACK_TOKENS:
                count_held()
                held, n = [], 0
        if n:
            count_held()
        named = [(w, n) for w, n in words.items() if n * NAMED > total]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in named] + ["", ""], pa.string()), pa.array([0] * len(named) + [1, 2]), pa.array([n for _, n in named] + [total, trusted], pa.int64())], ["w", "kind", "n"])

    sums = materialize(texts.mapInArrow(count, "w string, kind bigint, n bigint").groupBy("w", "kind").agg(F.sum("n").alias("n")), "lm-named")
    total, trusted = (sum(r.n for r in sums.where(F.col("kind") == k).collect()) for k in (1, 2))
    hot_words = sums.where((F.col("kind") == 0) & (F.col("n") > hot)).collect()
    book = sums.where((F.col("kind") == 0) & (F.col("w") != " start")).orderBy(F.desc("n"), "w").limit(BOOK).collect()
    rounds = max(1, min(ROUNDS, total // ROUND_TOKENS))
    shards = rounds * max(SHARDS, -(-total // (rounds * SHARD_TOKENS)))
    keys, parts = hashes([r.w for r in hot_words]), np.array([max(2, min(shards, -(-r.n // max(1, hot // 2)))) for r in hot_words], np.int64)
    order = np.argsort(keys)
    return Deal(shards, rounds, max(1, -(-rounds * trusted // max(1, total))), keys[order], parts[order], [r.w for r in book])


class Book:
    """The words that all packs number alike: START, END, and the most frequent ones."""

    def __init__(self, deal: Deal, speller: Speller | None):
        self.words = strings([" start", " end", *deal.book])  # no word has a space
        self.key = np.concatenate([[START, END], hashes(deal.book)])
        self.spell = np.zeros(len(self.key), np.float32)
        if speller:
            self.spell[1], self.spell[2:] = speller.end, spellings(self.words[2:], speller)
        self.order = np.argsort(self.key)
        self.ascending = self.key[self.order]

    def numbered(self, words: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
        """The number of each word, and the words beyond the book, whose numbers follow those of the book."""
        coded = pa.chunked_array(words, pa.string()).dictionary_encode()
        each = coded.chunk(coded.num_chunks - 1).dictionary  # all chunks have one
        at = pc.index_in(each, value_set=self.words)
        known = at.is_valid().to_numpy(zero_copy_only=False)
        number = np.where(known, at.fill_null(0).to_numpy(), len(self.words) + np.cumsum(~known) - 1).astype(np.int32)
        return number[np.concatenate([c.indices.to_numpy() for c in coded.chunks])], each.filter(pa.array(~known))


def share(spark: SparkSession, deal: Deal, speller: Speller | None) -> Broadcast:
    return spark.sparkContext.broadcast((deal, speller, Book(deal, speller)))


#: What a trigram in a pack is for: counts of the model, a text's score; the latter of its last two words only, as the first is elsewhere.
LEARN, SCORE, PAIR = 1, 2, 4


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Each array by itself, its bytes by their place in the items, so that like bytes are side by side."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
        out.append((x.dtype.str, len(x), pa.compress(raw.tobytes(), "zstd", asbytes=True)))
    return pickle.dumps(out, 5)


def unsqueezed(data: list[tuple]) -> Iterator[np.ndarray]:
    for kind, n, raw in data:
        size = np.dtype(kind).itemsize
        plain = np.frombuffer(pa.decompress(raw, n * size, "zstd", asbytes=True), np.uint8)
        yield np.ascontiguousarray(plain.reshape(size, n).T).view(kind).reshape(n)


def packs(texts: DataFrame, shared: Broadcast, rounds: int, k: int) -> DataFrame:
    """shard, pack: the trigrams of texts (text, learned, scored) in the shards of round k. shared: what share() gives."""

    def pack(words: list[pa.Array], size: list[np.ndarray], texts: list[int], uses: list[np.ndarray]):
        deal, speller, book = shared.value
        size, own = np.concatenate(size) + 3, len(book.key)
        ends = np.cumsum(size)
        # START START, the words, END
        at, inside = np.zeros(ends[-1], np.int32), np.ones(ends[-1], bool)
        inside[ends - size] = inside[ends - size + 1] = inside[ends - 1] = False
        at[ends - 1] = 1
        at[inside], rest = book.numbered(words)
        key = np.concatenate([book.key, hashes(rest.to_pylist())])
        spell = np.concatenate([book.spell, spellings(rest, speller) if speller else np.zeros(len(rest))]).astype(np.float32)
        signed, parts = key.view(np.int64), deal.parts_of(key)
        base = signed % deal.shards
        alone = parts == 1
        # where a middle word has a shard of this round, or may have one
        middle_at = ((base % rounds == k) | ~alone)[at]
        middle_at[ends - size] = middle_at[ends - 1] = False
        third = np.flatnonzero(middle_at) + 1
        first, middle, last = at[third - 2], at[third - 1], at[third]
        text = np.searchsorted(ends, third, "right").astype(np.int32)
        use = np.concatenate(uses)[text]
        shard = base[middle]
        many = np.flatnonzero(~alone[middle])
        n, spread = parts[middle[many]], shard[many]
        shard[many] = (spread + signed[first[many]] % n) % deal.shards
        inner = (spread + signed[last[many]] % n) % deal.shards
        here, there = np.flatnonzero(shard % rounds == k), np.flatnonzero((inner % rounds == k) & (use[many] & SCORE > 0))
        shard, inner, there = shard[here], inner[there], many[there]
        shard = np.concatenate([shard, inner])
        # the first word isn't needed there
        first, middle, last, text = np.concatenate([first[here], np.zeros(len(there), first.dtype)]), *(np.concatenate([x[here], x[there]]) for x in (middle, last, text))
        use = np.concatenate([use[here], np.full(len(there), SCORE | PAIR, np.uint8)])
        order = np.argsort(shard.astype(np.uint16) if deal.shards <= 1 << 16 else shard, kind="stable")
        shard, first, middle, last, text, use = (x[order] for x in (shard, first, middle, last, text, use))
        keys, cuts = np.array(texts, np.uint64), np.flatnonzero(np.diff(shard, prepend=-1))
        place = np.arange(len(key), dtype=np.int32)
        for lo, hi in zip(cuts, [*cuts[1:], len(shard)]):
            # middle and last words beyond the book, which are spelled, then those that only come first
            w = np.concatenate([middle[lo:hi], last[lo:hi]])
            near, far = np.unique(w[w >= own]), np.unique(first[lo:hi][first[lo:hi] >= own])
            far = far[~lookup(near, far)[0]]
            place[near], place[far] = own + np.arange(len(near)), own + len(near) + np.arange(len(far))
            kind = np.uint16 if own + len(near) + len(far) <= 1 << 16 else np.uint32
            seen = np.zeros(len(keys), bool)
            seen[text[lo:hi]] = True
            doc = (np.cumsum(seen) - 1)[text[lo:hi]]
            placed = (place[x[lo:hi]].astype(kind) for x in (first, middle, last))
            yield int(shard[lo]), squeezed(key[near], key[far], spell[near], *placed, use[lo:hi], keys[seen], np.diff(doc, prepend=0).astype(np.int32))

    def run(batches):
        held, n = None, 0
        for batch in batches:
            if held is None:
                words, size, held, uses = [], [], [], []
            raw = batch.column(0).to_pylist()
            of, many = words_in(raw)
            some = np.flatnonzero(many)
            words.append(of)
            size.append(many[some])
            held += [text_key(raw[k]) for k in some]
            learned, scored = (c.to_numpy(zero_copy_only=False).astype(np.uint8) for c in batch.columns[1:])
            uses.append((LEARN * learned + SCORE * scored)[some].astype(np.uint8))
            n += len(of)
            if n > PACK_TOKENS:
                yield from _packed(pack(words, size, held, uses))
                held, n = None, 0
        if n:
            yield from _packed(pack(words, size, held, uses))

    return texts.select("text", "learned", "scored").mapInArrow(run, "shard int, pack binary")


def _packed(rows) -> Iterator[pa.RecordBatch]:
    for shard, data in rows:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["shard", "pack"])


class Shard:
    """The packs of a shard with one number for each word: those of the book, then others by ascending hash."""

    def __init__(self, table: pa.Table, book: Book):
        self.book = book
        found = [pickle.loads(data.as_buffer()) for data in table.column("pack")]
        ends = [tuple(unsqueezed(f[:3])) for f in found]  # only words at first
        own, cuts = len(book.key), np.cumsum([0, *(len(near) + len(far) for near, far, _ in ends)])
        self.rest, number = np.unique(np.concatenate([x for near, far, _ in ends for x in (near, far)]), return_inverse=True)
        number = number.astype(np.int32) + np.int32(own)
        self.key = np.concatenate([book.key, self.rest])
        self.spell = np.concatenate([book.spell, np.zeros(len(self.rest), np.float32)]).astype(float)
        for lo, (near, _, spell) in zip(cuts, ends):
            self.spell[number[lo : lo + len(near)]] = spell
        del ends
        size = sum(f[6][1] for f in found)
        self.first, self.middle, self.last, self.text = np.empty((4, size), np.int32)
        self.use, texts, n, k = np.empty(size, np.uint8), [], 0, 0
        for at, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            first, middle, last, use, keys, doc = unsqueezed(found[at][3:])
            found[at] = None
            place, rows = np.concatenate([np.arange(own, dtype=np.int32), number[lo:hi]]), slice(k, k + len(use))
            self.first[rows], self.middle[rows], self.last[rows] = place[first], place[middle], place[last]
            self.use[rows], self.text[rows] = use, np.cumsum(doc) + n
            texts.append(keys)
            n += len(keys)
            k += len(use)
        self.texts = np.concatenate(texts)
        self.bits = len(self.key).bit_length()

    def numbers(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are words of the shard, and their numbers."""
        known, at = lookup(self.book.ascending, key)
        found, after = lookup(self.rest, key)
        return known | found, np.where(known, self.book.order[at], len(self.book.key) + after)

    def slices(self) -> Iterator[np.ndarray]:
        """The rows of some middle words at a time: all that belongs together has one middle word."""
        n = -(-len(self.use) // SLICE)
        part = self.middle % n
        for k in range(n):
            yield np.flatnonzero(part == k)

    def pairs(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one.astype(np.uint64) << np.uint64(self.bits) | two.astype(np.uint64)


class Trigrams:
    """Distinct trigrams in rows of a shard, by their first two words."""

    def __init__(self, shard: Shard, rows: np.ndarray):
        middle, last = shard.middle[rows], shard.last[rows]
        context = shard.pairs(shard.first[rows], middle)
        if 3 * shard.bits > BITS:  # too many words for one number
            context = np.unique(context, return_inverse=True)[1]
        key, self.of = np.unique(shard.pairs(context, last), return_inverse=True)
        self.middle, self.last = np.empty(len(key), np.int32), np.empty(len(key), np.int32)
        self.middle[self.of], self.last[self.of] = middle, last
        #: trigrams with the same first two words have the same number
        self.context = np.cumsum(np.diff(key >> np.uint64(shard.bits), prepend=key[:1] >> np.uint64(shard.bits)) != 0)

    def counts(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[which], minlength=len(self.middle))


# -- training ----------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    trusted: DataFrame
    hot: int
    deal: Deal
    #: discounts of words, bigrams and trigrams by their counts
    off: tuple[np.ndarray, np.ndarray, np.ndarray]
    #: words of all bigrams; 0: nothing is known
    total: int
    free: float
    #: the gain of END as a word
    end: float
    #: shard, a, b, c: after how many words b occurs; after how many the words a and b do, where a isn't 0
    told: DataFrame
    #: of words that are spread: totals and back-off weights of their bigrams
    totals: np.ndarray
    back: np.ndarray


def _offs(n: list[int]) -> np.ndarray:
    return np.array([0.0, *discounts(n)])


def _histogram(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5]


#: Rows of what training finds in a shard: after how many words each word occurs, after how many each bigram of a spread word does, and how many
#: trigrams and bigrams (of other words) have a count of 1, 2, 3 and 4.
WORD, BIGRAM, HOW3, HOW2 = range(4)


def shares(table: pa.Table, shared: Broadcast) -> pa.Table:
    deal, _, book = shared.value
    s = Shard(table, book)
    is_spread, mask = lookup(deal.spread, s.key)[0], np.uint64((1 << s.bits) - 1)
    c1, how3, how2, bigrams = np.zeros(len(s.key), np.int64), np.zeros(4, np.int64), np.zeros(4, np.int64), []
    for rows in s.slices():
        t = Trigrams(s, rows)
        pair, heavy = s.pairs(t.middle, t.last), is_spread[t.middle]
        light, c2 = np.unique(pair[~heavy], return_counts=True)
        c1 += np.bincount((light & mask).astype(np.int64), minlength=len(s.key))
        how3 += _histogram(np.bincount(t.of))
        how2 += _histogram(c2)
        bigrams.append(np.unique(pair[heavy], return_counts=True))
    heavy, part = (np.concatenate(x) for x in zip(*bigrams))
    words = np.flatnonzero(c1)
    four, none = np.arange(1, 5), np.zeros(4, np.uint64)
    kind = np.repeat([WORD, BIGRAM, HOW3, HOW2], [len(words), len(heavy), 4, 4])
    a = np.concatenate([np.zeros(len(words), np.uint64), s.key[(heavy >> np.uint64(s.bits)).astype(np.int64)], none, none])
    b = np.concatenate([s.key[words], s.key[(heavy & mask).astype(np.int64)], four.astype(np.uint64), four.astype(np.uint64)])
    n = np.concatenate([c1[words], part, how3, how2])
    shard = table.column("shard")[0].as_py()
    return pa.table({"kind": pa.array(kind, pa.int32()), "shard": pa.array(np.full(len(kind), shard), pa.int32()), "a": _signed(a), "b": _signed(b), "n": pa.array(n, pa.int64())})


def train(trusted: DataFrame, speller: Speller, docs: DataFrame | None = None, hot: int = HOT) -> tuple[Model, float]:
    """The model of trusted texts, and the log of the weight of spelling in the lowest order. docs are other texts that will be
    scored; how the work is dealt out looks at them."""
    spark = trusted.sparkSession
    yes, no = F.lit(True), F.lit(False)
    texts = trusted.select("text", yes.alias("learned"), no.alias("scored"))
    deal = dealt(texts.select("text", "learned") if docs is None else texts.select("text", "learned").unionByName(docs.select("text", no.alias("learned"))), hot)
    with scratch(spark) as keep:
        parts, shared = [], share(spark, deal, None)
        for k in range(deal.training):
            sent = packs(texts, shared, deal.training, k)
            parts.append(materialize(sent.groupBy("shard").applyInArrow(lambda t: shares(t, shared), "kind int, shard int, a bigint, b bigint, n bigint"), "lm-shares"))
        found = functools.reduce(DataFrame.unionByName, parts)
        how = {(r.kind, r.b): r.n for r in found.where(F.col("kind") >= HOW3).groupBy("kind", "b").agg(F.sum("n").alias("n")).collect()}
        pairs = found.where(F.col("kind") == BIGRAM)
        heavy = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("c")), "lm-bigrams")
        few = lambda df: [df.agg(*[F.count(F.when(F.col("c") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()[k] for k in range(4)]
        off3, off2 = _offs([how.get((HOW3, k), 0) for k in (1, 2, 3, 4)]), _offs([how.get((HOW2, k), 0) + n for k, n in zip((1, 2, 3, 4), few(heavy))])
        each = found.where(F.col("kind") == WORD).select("b", "n").unionByName(heavy.select("b", F.lit(1).cast("bigint").alias("n")))
        words = materialize(each.groupBy("b").agg(F.sum("n").alias("c")), "lm-words")
        off1 = _offs(few(words))
        whole = words.agg(F.sum("c").alias("total"), *[F.count(F.when(x, 1)).alias(n) for n, x in (("one", F.col("c") == 1), ("two", F.col("c") == 2), ("more", F.col("c") > 2), ("end", F.col("b") == int(END.view(np.int64))))], F.max(F.when(F.col("b") == int(END.view(np.int64)), F.col("c"))).alias("c_end")).first()
        total = whole.total or 0
        free = float(np.log((whole.one * off1[1] + whole.two * off1[2] + whole.more * off1[3]) / total)) if total else 0.0
        end = float(np.log((whole.c_end - off1[min(whole.c_end, 3)]) / total + np.exp(free + speller.end)) - free - speller.end) if total else 0.0

        by = {r.a: r for r in heavy.groupBy("a").agg(F.sum("c").alias("total"), *[F.count(F.when(x, 1)).alias(n) for n, x in (("one", F.col("c") == 1), ("two", F.col("c") == 2), ("more", F.col("c") > 2))]).collect()}
        of = [by.get(int(w)) for w in deal.spread.view(np.int64)]
        totals = np.array([r.total if r else 0 for r in of], float)
        back = np.array([(r.one * off2[1] + r.two * off2[2] + r.more * off2[3]) / r.total if r else 1.0 for r in of])

        ways = spark.createDataFrame(list(zip(deal.spread.view(np.int64).tolist(), deal.parts.tolist())), "w bigint, parts bigint")
        shard = lambda word, by: ((F.pmod(word, F.lit(deal.shards)) + by) % deal.shards).cast("int")
        own = words.join(F.broadcast(ways), words.b == ways.w, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)))
        own = own.select(shard(F.col("b"), F.col("part")).alias("shard"), F.lit(0).cast("bigint").alias("a"), "b", "c")
        placed = heavy.join(F.broadcast(ways), heavy.a == ways.w).select(shard(F.col("a"), F.pmod("b", "parts")).alias("shard"), "a", "b", "c")
        asked = found.where(F.col("kind") <= BIGRAM).select("shard", "b").unionByName(placed.select("shard", "b")).distinct()
        asked = shuffled_join(asked, words, "b").select("shard", F.lit(0).cast("bigint").alias("a"), "b", "c")
        both = shuffled_join(pairs.select("shard", "a", "b"), heavy, ["a", "b"]).select("shard", "a", "b", "c")
        told = keep(functools.reduce(DataFrame.unionByName, [own, asked, placed, both]), "lm-told")
    return Model(trusted, hot, deal, (off1, off2, off3), total, free, end, told, totals, back), free


# -- scoring -----------------------------------------------------------------------------------------------------------


def _sums(of: np.ndarray, n: int, c: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals and back-off weights of n contexts."""
    total = np.bincount(of, c, n)
    return total, np.bincount(of, off, n) / np.maximum(total, 1)


def scores(table: pa.Table, told: pa.Table, shared: Broadcast, off: tuple, total: int, free: float, totals: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of texts, and what the n-grams of a shard add to their log probabilities."""
    deal, _, book = shared.value
    off1, off2, off3 = off
    discount = lambda c, d: d[np.minimum(c, 3)]
    log = lambda x, where: np.log(x, out=np.zeros(len(x)), where=where)
    s = Shard(table, book)
    words = len(s.key)
    a, b = (told.column(k).to_numpy().view(np.uint64) for k in ("a", "b"))
    c = told.column("c").to_numpy()

    # of words: how likely they are after any other, the gain of that alone, and the weight as a context
    n1 = np.zeros(words, np.int64)
    found, at = s.numbers(b[a == 0])
    n1[at[found]] = c[a == 0][found]
    base = free + s.spell
    p1 = (n1 - discount(n1, off1)) / total + np.exp(base)
    alone = np.where(n1 > 0, log(p1, n1 > 0) - base, 0.0)
    found, at = s.numbers(deal.spread)
    is_spread, spread = np.zeros(words, bool), at[found]
    is_spread[spread] = True
    totals, back = totals[found], back[found]
    heavy = np.flatnonzero(a != 0)
    (is_a, at_a), (is_b, at_b) = s.numbers(a[heavy]), s.numbers(b[heavy])
    known = is_a & is_b
    heavy, heavy_pair = c[heavy[known]], s.pairs(at_a[known], at_b[known])
    # that of spelling, too; START isn't spelled
    alone += base
    alone[0] = 0.0

    sums, asked = np.zeros(len(s.texts)), np.zeros(len(s.texts), bool)
    for rows in s.slices():
        whole, pair = rows[s.use[rows] & PAIR == 0], rows[s.use[rows] & PAIR > 0]
        t = Trigrams(s, whole)
        c3 = t.counts(np.flatnonzero(s.use[whole] & LEARN > 0))
        light = ~is_spread[t.middle]

        # bigrams: those of the trigrams, then those of rows without a first word
        middle, last = np.concatenate([t.middle, s.middle[pair]]), np.concatenate([t.last, s.last[pair]])
        key, of = np.unique(s.pairs(middle, last), return_inverse=True)
        w2, w3 = np.empty(len(key), np.int32), np.empty(len(key), np.int32)
        w2[of], w3[of] = middle, last
        of, of_pair = of[: len(t.middle)], of[len(t.middle) :]
        c2 = np.bincount(of[light & (c3 > 0)], minlength=len(key))
        total2, back2 = _sums(w2, words, c2, discount(c2, off2))
        total2[spread], back2[spread] = totals, back
        weight = log(back2, total2 > 0)
        found, at = lookup(key, heavy_pair)
        c2[at[found]] = heavy[found]
        p2 = (c2 - discount(c2, off2)) / np.maximum(total2[w2], 1) + back2[w2] * p1[w3]
        gain2 = np.where(c2 > 0, log(np.divide(p2, p1[w3], out=np.ones(len(p2)), where=c2 > 0), c2 > 0), weight[w2])

        total3, back3 = _sums(t.context, len(t.context), c3, discount(c3, off3))
        total3, back3, low = total3[t.context], back3[t.context], np.where(c3 > 0, p2[of], 1.0)
        gain = np.where(c3 > 0, log(((c3 - discount(c3, off3)) / np.maximum(total3, 1) + back3 * low) / low, c3 > 0), log(back3, total3 > 0))
        gain += alone[t.middle] + np.where(light, gain2[of], 0.0)

        score = s.use[whole] & SCORE > 0
        for text, add in ((s.text[whole[score]], gain[t.of[score]]), (s.text[pair], gain2[of_pair])):
            sums += np.bincount(text, add, len(sums))
            asked[text] = True
    return s.texts[asked], sums[asked]


def own_scores(docs: DataFrame, shared: Broadcast, model: Model, keep: list[str]) -> DataFrame:
    """keep columns, n_chars_scored, key of the text, own: the log probability of END, and without a model that of spelling all words, which
    shards add otherwise."""
    free, end, trained = model.free, model.end, bool(model.total)

    def run(batches):
        from pyspark import TaskContext

        _, speller, book = shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw = batch.column(len(keep)).to_pylist()
            words, size = words_in(raw)
            # texts without words need a key of their own, so that they don't meet in one task
            key = np.array([text_key(t) if n else row + k for k, (t, n) in enumerate(zip(raw, size))], np.uint64)
            row += len(raw)
            some = np.flatnonzero(size)
            starts, chars, own = (np.cumsum(size) - size)[some], size.astype(np.int64), np.zeros(len(raw))
            if len(some):
                chars[some] += np.add.reduceat(pc.utf8_length(words).to_numpy(), starts)
                own[some] = speller.end + end + free
                if not trained:
                    at, rest = book.numbered([words])
                    own[some] += np.add.reduceat(np.concatenate([book.spell, spellings(rest, speller)])[at], starts) + free * size[some]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(chars), _signed(key), pa.array(own)], [*keep, "n_chars_scored", "lm_key", "lm_own"])

    d = docs.select(*keep, "text")
    return d.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "text") + ", n_chars_scored bigint, lm_key bigint, lm_own double")


def perplexities(docs: DataFrame, speller: Speller, model: Model, free: float, keep: list[str], hot: int | None = None, learned: Column | None = None) -> DataFrame:
    """keep columns, n_chars_scored, perplexity. learned: which of docs are the model's trusted texts; without it those are read beside
    docs. hot: another limit than the model's spreads other words."""
    if hot is not None and hot != model.hot:
        model, free = train(model.trusted, speller, docs, hot)
    shared = share(docs.sparkSession, model.deal, speller)
    own = materialize(own_scores(docs, shared, model, keep), "lm-own")
    sums = []
    if model.total:
        yes, no = F.lit(True), F.lit(False)
        if learned is None:
            texts = docs.select("text", no.alias("learned"), yes.alias("scored")).unionByName(model.trusted.select("text", yes.alias("learned"), no.alias("scored")))
        else:
            texts = docs.select("text", learned.alias("learned"), yes.alias("scored"))
        deal, off, total, free, totals, back = model.deal, model.off, model.total, model.free, model.totals, model.back

        def run(table, told):
            keys, add = scores(table, told, shared, off, total, free, totals, back) if len(table) else (np.empty(0, np.uint64), np.empty(0))
            return pa.table({"lm_key": _signed(keys), "add": pa.array(add)})

        for k in range(deal.rounds):
            sent = packs(texts, shared, deal.rounds, k).groupBy("shard")
            added = sent.cogroup(model.told.where(F.col("shard") % deal.rounds == k).groupBy("shard")).applyInArrow(run, "lm_key bigint, add double")
            sums.append(materialize(added.groupBy("lm_key").agg(F.sum("add").alias("add")), "lm-sums"))
    added = F.lit(0.0)
    if sums:
        # equal texts have added their n-grams to one sum
        copies = own.groupBy("lm_key").agg(F.count(F.lit(1)).alias("copies"))
        each = shuffled_join(functools.reduce(DataFrame.unionByName, sums).groupBy("lm_key").agg(F.sum("add").alias("add")), copies, "lm_key")
        each = materialize(each.select("lm_key", "copies", (F.col("add") / F.col("copies")).alias("lm_add")), "lm-added")
        own, added = skew_join(own, each, "lm_key", "copies", own.count()), F.coalesce("lm_add", F.lit(0.0))
    return own.select(*keep, "n_chars_scored", F.when(F.col("n_chars_scored") > 0, F.exp(-(F.col("lm_own") + added) / F.col("n_chars_scored"))).alias("perplexity"))


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """lang, threshold: the quantile of perplexity over trusted rows, and a row with lang null for all languages."""
    bins = scored.where("trusted AND perplexity IS NOT NULL").groupBy("lang", F.floor(F.log("perplexity") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    both = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    w = Window.partitionBy("lang")
    ranked = both.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return ranked.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang").agg(F.exp((F.min("bin") + 1) / BINS).alias("threshold"))


def held_out(text: Column) -> Column:
    """Trusted texts that aren't learned from: one of FOLDS shares, by a hash of the text, so all copies of a text together."""
    return F.coalesce(F.pmod(F.xxhash64(text), F.lit(FOLDS)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, slack: float = 1.4, short: float = 3.0) -> DataFrame:
    """doc_id, lang, trusted, n_chars_scored, perplexity, threshold, kept. labels: doc_id, quality (1: trusted)."""
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), held_out(F.col("text")).alias("held"))
    ids = labels.where("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    marked = checked_join(d, ids, "doc_id", "left", row_bytes=24).withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    learned = F.col("trusted") & ~F.col("held")
    speller = train_speller(marked.where(learned))
    with scratch(docs.sparkSession) as keep, freed_shuffles(docs.sparkSession):
        model, free = train(marked.where(learned), speller, docs=marked.where(~learned))
        scored = keep(perplexities(marked, speller, model, free, ["doc_id", "lang", "trusted", "held"], learned=learned), "lm-scores")
    limits = {r.lang: r.threshold for r in thresholds(scored.where("held"), quantile).collect()}  # one row for each language
    limit = F.lit(limits.pop(None, float("inf")))
    for lang, t in limits.items():
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    scored = scored.drop("held").withColumn("threshold", limit * slack * F.exp(short / F.sqrt(F.greatest("n_chars_scored", F.lit(1)))))
    return scored.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
