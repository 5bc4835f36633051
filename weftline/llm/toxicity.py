"""Toxicity by compression distance.

zstandard trains three dictionaries: one of what all ordinary text has in common,
one on toxic and one on ordinary windows, of equal size.  A side compresses with
its own dictionary and the common one.  Every window of ``WORDS`` neighbouring
words of a text is compressed by both sides, whatever it holds; how many bytes
fewer the toxic side needs is the window's gain.  Windows start at every word; a
word longer than ``LONGEST`` bytes is cut.  Words of ``INNER_FROM`` bytes or more
are read again from each of their characters on, so that compounds and text
without spaces are seen (inner windows).

A match costs zstandard three to four bytes, as much as a short word has, so
text is written wide: each byte of a run of letters or digits as itself and three
bytes that print the run's beginning up to it; the space between two words as a
print of both, so that phrases tell, too.  Dictionaries and windows are written
alike.

A toxic label speaks of a document of which few words are toxic.  The toxic side is
therefore trained on those windows of toxic texts that hold a string (beginning of
a word, inner string or pair of words) toxic texts have far more often than
ordinary ones; that choice is of training text only and decides no score.

A document's windows are counted by their gain; thresholds of the gain and the
weights of the counts are calibrated by logistic regression on labelled rows that
no dictionary has seen, a toxic row counting as ``TOXIC_WEIGHT``.  Only texts make
a score.

Learning uses a bounded sample of labelled rows (``SAMPLE`` by class and part,
of at most ``SAMPLE_BYTES`` each, chosen by hash); scoring covers every window of
every text.  Sampled texts that nearly repeat one already taken are left out, so
that copies don't pass for evidence.

Cases: a null or empty text is scored with no windows; a word of any length has
windows throughout; without labels of both classes all
scores are the share of toxic labels (0 without any); repeated rows get equal
scores; a row without id isn't held out; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions.pages import spread

#: Labelled rows by class for the dictionaries and, again, for the calibration.
SAMPLE = 1500
SAMPLE_BYTES = 20_000
#: Bytes of the common dictionary and, at most, of each side's own.
COMMON_BYTES, OWN_BYTES = 96 * 1024, 24 * 1024
WORDS, STEP = 3, 2
LONGEST = 32
INNER_FROM, INNER_BYTES = 12, 12
LEVEL, LEAST_MATCH = 2, 5
#: Least gains, in bytes, of the classes by which windows are counted.
GAINS = (2, 4, 6, 8, 10, 13, 17)
INNER_GAINS = (4, 8, 13, 20)
TOXIC_WEIGHT = 3.0
#: Windows compressed at once, and words whose inner gains are remembered.
CHUNK, WORD_CACHE = 20_000, 150_000
#: Bytes of texts that are written and compressed at once.
AT_ONCE = 128 * 1024
PHRASES = 700

#: Bytes that end a run: all ASCII but lower-case letters and digits.
_BREAK = np.ones(256, dtype=bool)
_BREAK[128:] = _BREAK[48:58] = _BREAK[97:123] = False
_ASCII_WORD = re.compile(rb"(?<=[^0-9a-z])[0-9a-z]")
_WORD = re.compile(r"(?<=[\W_])[^\W_]")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def starts_of(token: bytes) -> list[int]:
    """Where words begin in the token: its first byte, and what follows
    punctuation."""
    if token.isalnum():
        return [0]
    if token.isascii():
        return [0, *(m.start() for m in _ASCII_WORD.finditer(token))]
    text, out, at, done = token.decode("utf-8", "surrogateescape"), [0], 0, 0
    for m in _WORD.finditer(text):
        at += len(text[done : m.start()].encode("utf-8", "surrogateescape"))
        done = m.start()
        out.append(at)
    return out


def core_of(token: bytes) -> bytes:
    """The token without punctuation around it."""
    if token.isalnum():
        return token
    return _EDGES.sub("", token.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def _pairs(row: list[bytes], cores: dict[bytes, bytes]) -> set[bytes]:
    clean = [cores.get(w) or cores.setdefault(w, core_of(w)) for w in row]
    return {a + b" " + b for a, b in zip(clean, clean[1:]) if a and b}


def _distinct(texts: Iterable[bytes]) -> list[list[bytes]]:
    """The texts' tokens, without those of texts that nearly repeat an earlier one:
    no two may agree in both minhashes (of pairs of words) of one of four bands."""
    rng = np.random.default_rng(5)
    mul = rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen, out = set(), []
    for text in texts:
        row = text.lower().split() or [b""]
        h = np.array([xxhash.xxh3_64_intdigest(a + b" " + b) for a, b in zip(row, row[1:] or row)], dtype=np.uint64)
        least = ((h[:, None] * mul) >> np.uint64(8)).min(0).tolist()
        bands = [(k, least[2 * k], least[2 * k + 1]) for k in range(4)]
        if not any(b in seen for b in bands):
            out.append(row)
        seen.update(bands)
    return out


def _prints(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each byte of the runs a word of 32 bits: the byte and a print of the
    run's beginning up to it.  Bytes outside runs stand alone."""
    out = flat.astype(np.uint32)
    if not len(starts):
        return out
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    h = np.zeros(len(starts), dtype=np.uint32)
    for k in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -k))
        at = starts[:n] + k
        x = h[:n] * np.uint32(0x9E3779B1) + flat[at] + np.uint32(1)
        h[:n] = x ^ (x >> np.uint32(15))
        out[at] |= (h[:n] * np.uint32(0x85EBCA6B)) & np.uint32(0xFFFFFF00)
    return out


def _breaks(flat: np.ndarray) -> np.ndarray:
    """Whether each byte is of punctuation: of ASCII, Latin-1, or the blocks of
    general and of ideographic punctuation."""
    out = _BREAK[flat]
    if out.all() or flat.max() < 128:
        return out
    after = np.append(flat[1:], np.uint8(0))
    lead = (flat == 0xC2) | (flat == 0xE2) & (after >> 1 == 0x40) | (flat == 0xE3) & (after == 0x80)
    for k in range(3):
        own = lead if k < 2 else lead & (flat != 0xC2)
        out[k:] |= own[: len(flat) - k]
    return out


def wide(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text as it is compressed, and where each of its words starts and ends
    in that."""
    return _written(text)[:3]


def _written(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """What ``wide`` gives, and where each word starts in the text itself."""
    flat = np.frombuffer(text.lower(), dtype=np.uint8)
    space = (flat == 32) | (flat >= 9) & (flat <= 13)
    at = np.flatnonzero(~space)
    if not len(at):
        return b"", at, at, at
    flat = flat[at]
    first = np.empty(len(at), dtype=bool)
    first[0] = True
    first[1:] = np.diff(at) > 1
    starts = np.flatnonzero(first)
    # Words are cut at every LONGEST bytes, runs at breaks, too.
    inside = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    first |= inside % LONGEST == 0
    broken = _breaks(flat)
    opens = first & ~broken
    opens[1:] |= broken[:-1] & ~broken[1:]
    runs = np.flatnonzero(opens)
    closes = np.append(np.flatnonzero(first | broken), len(at))
    ends = closes[np.searchsorted(closes, runs, side="right")]
    letters = _prints(flat, runs, ends - runs)
    words = np.flatnonzero(first)
    number = np.cumsum(first) - 1
    # A word's own print counts its letters only.
    own = np.where(broken, 0, flat + np.uint32(1)).astype(np.uint32)
    turn = np.cumsum(~broken)
    turn -= (turn - ~broken)[words][number]
    own *= _POWERS[turn % len(_POWERS)]
    own = np.add.reduceat(own, words, dtype=np.uint32)
    out = np.empty(len(at) + 2 * (len(words) - 1), dtype=np.uint32)
    out[np.arange(len(at)) + 2 * number] = letters
    joint = own[:-1] * np.uint32(0x9E3779B1) + own[1:] * np.uint32(0x7FEB352D)
    joint ^= joint >> np.uint32(15)
    gap = words[1:] + 2 * np.arange(len(words) - 1)
    out[gap] = (joint * np.uint32(0x2C1B3C6D)) & np.uint32(0xFFFFFF00) | np.uint32(32)
    out[gap + 1] = joint * np.uint32(0x297A2D39)
    begin = 4 * (words + 2 * np.arange(len(words)))
    return out.astype("<u4").tobytes(), begin, begin + 4 * np.diff(np.append(words, len(at))), at[words]


_POWERS = np.cumprod(np.full(64, 0x01000193, dtype=np.uint32), dtype=np.uint32)


def windows(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts written wide one after another, offset and length of each window,
    and which text it is of: ``WORDS`` words from every ``STEP``-th word of a text on,
    fewer at its end.  All neighbours share a window, and no two texts do."""
    content, begin, end, source = _written(_APART.join(texts))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(sizes + len(_APART)) - sizes - len(_APART)
    low, high = np.searchsorted(source, starts), np.searchsorted(source, starts + sizes)
    counts = -(-np.maximum(high - low - WORDS + STEP, np.minimum(1, high - low)) // STEP)
    of = np.repeat(np.arange(len(texts)), counts)
    first = low[of] + STEP * (np.arange(len(of)) - (np.cumsum(counts) - counts)[of])
    out = np.empty((len(of), 2), dtype=np.uint64)
    out[:, 0] = begin[first]
    out[:, 1] = end[np.minimum(first + WORDS, high[of]) - 1] - begin[first]
    return content, out, of


#: A word between two texts that are written at once; it ends all that reaches
#: from byte to byte.
_APART = b" -- "


def inner_windows(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """What each word's inner windows are, written wide one after another: their
    bytes, offset and length of each, and which word it is of."""
    flat = np.frombuffer(b"".join(words), dtype=np.uint8)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[of] - np.arange(len(flat))
    at = np.flatnonzero((left > 3) & (left < sizes[of]) & (flat & 0xC0 != 0x80))
    sizes = np.minimum(left[at], INNER_BYTES)
    starts = np.cumsum(sizes) - sizes
    where = np.stack([4 * starts, 4 * sizes], axis=1).astype(np.uint64)
    each = flat[np.repeat(at - starts, sizes) + np.arange(int(sizes.sum()))]
    return _prints(each, starts, sizes).astype("<u4").tobytes(), where, of[at]


def _runs(text: bytes) -> set[bytes]:
    """The text's runs of letters and digits that have inner windows."""
    return {r[k : k + 4 * LONGEST] for r in _RUN.findall(text.lower()) for k in range(0, len(r), 3 * LONGEST)}


_RUN = re.compile(rb"[0-9a-z\x80-\xff]{%d,}" % INNER_FROM)


def _outer(rows: list[list[bytes]]) -> list[set[bytes]]:
    """Each text's windows at beginnings of words."""
    cuts: dict[bytes, list[bytes]] = {}
    for row in rows:
        for w in row:
            if w not in cuts:
                cuts[w] = [w[k : k + LONGEST] for k in starts_of(w)]
    return [{x for w in set(row) for x in cuts[w]} for row in rows]


def _toxic_pieces(toxic: list[set[bytes]], ordinary: list[set[bytes]]) -> list[bytes]:
    """Beginnings of words that tell, most telling first."""

    def beginnings(sets: list[set[bytes]], keep=None) -> Counter:
        found: Counter = Counter()
        for words in sets:
            own = {w[:k] for w in words for k in range(3, min(len(w), 12) + 1)}
            found.update(own if keep is None else own & keep)
        return found

    n_t, n_o = len(toxic), len(ordinary)
    in_t = beginnings(toxic)
    in_t = Counter({s: n for s, n in in_t.items() if n >= 3})
    in_o = beginnings(ordinary, in_t.keys())
    odds = {s: log(((n + 0.5) / (n_t + 1)) / ((in_o[s] + 0.5) / (n_o + 1))) for s, n in in_t.items()}
    good = {s: in_t[s] * o for s, o in odds.items() if o > log(8) and in_t[s] * o >= 14}
    # Of a word's beginnings the longest that has nearly all documents stays.
    longer: dict[bytes, int] = {}
    for s in good:
        if s[:-1] in good:
            longer[s[:-1]] = max(longer.get(s[:-1], 0), in_t[s])
    stems = {s for s in good if longer.get(s, 0) < 0.95 * in_t[s]}
    stems = {s for s in stems if not any(s[:k] in stems and 0.95 * in_t[s[:k]] > in_t[s] for k in range(3, len(s)))}
    return sorted(stems, key=lambda s: (-good[s], s))


def _telling(in_t: Counter, in_o: Counter, n_t: int, n_o: int, tried: int) -> dict[bytes, float]:
    """Those that toxic texts have eight times as often and that chance (Chernoff's
    bound, for as many as were tried) doesn't give, with their evidence."""
    least, share, out = log(max(1, tried)) + 3, n_t / (n_t + n_o), {}
    for s, t in in_t.items():
        o = in_o[s]
        evidence = t * log(t / ((t + o) * share)) + (o * log(o / ((t + o) * (1 - share))) if o else 0)
        if evidence >= least and log(((t + 0.5) / (n_t + 1)) / ((o + 0.5) / (n_o + 1))) > log(8):
            out[s] = evidence
    return out


def _inside(word: bytes, longest: int = 12) -> set[bytes]:
    """The beginnings of all windows of a token, at whatever character."""
    ends = len(word)
    return {word[k:n] for k in range(ends - 2) if word[k] & 0xC0 != 0x80 for n in range(k + 3, min(ends, k + longest) + 1)}


def _inner_pieces(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Strings that tell wherever they stand, most telling first."""
    n_t, n_o = len(toxic), len(ordinary)
    # Bounds from the counts of tokens leave few strings to count by text.
    most: Counter = Counter()
    for w, n in Counter(w for row in toxic for w in set(row)).items():
        for s in _inside(w):
            most[s] += n
    tried = len(most)
    low = {s for s, n in most.items() if n < 3}
    for s in low:
        del most[s]
    held: dict[bytes, int] = {}
    for w, n in Counter(w for row in ordinary for w in set(row)).items():
        for s in _inside(w) & most.keys():
            held[s] = max(held.get(s, 0), n)
    left = {s for s, t in most.items() if log(((min(t, n_t) + 0.5) / (n_t + 1)) / ((held.get(s, 0) + 0.5) / (n_o + 1))) > log(8)}

    def counted(rows: list[list[bytes]], among: set[bytes]) -> Counter:
        own: dict[bytes, set[bytes]] = {}
        found: Counter = Counter()
        for row in rows:
            words = set(row)
            for w in words:
                if w not in own:
                    own[w] = _inside(w) & among
            found.update({s for w in words for s in own[w]})
        return found

    in_t = counted(toxic, left)
    told = _telling(in_t, counted(ordinary, in_t.keys()), n_t, n_o, tried)
    # Of strings within one another the one that has nearly all texts stays.
    whole = set()
    for s in told:
        ends = {s[:-1]} | {s[k:] for k in range(1, len(s) - 2)}
        whole.update(x for x in ends if x in told and in_t[s] >= 0.95 * in_t[x])
    stems = {s for s in told if s not in whole}
    stems = {s for s in stems if not any(s[a:b] in stems and 0.95 * in_t[s[a:b]] > in_t[s] for a in range(len(s) - 2) for b in range(a + 3, len(s) + (a > 0)))}
    return sorted(stems, key=lambda s: (-told[s], s))


def _phrases(toxic: list[list[bytes]], ordinary: list[list[bytes]], pieces: list[bytes], inner: list[bytes]) -> list[bytes]:
    """Pairs of neighbouring words that tell without a telling word, most telling
    first."""
    cores: dict[bytes, bytes] = {}
    in_t: Counter = Counter()
    for row in toxic:
        in_t.update(_pairs(row, cores))
    tried = len(in_t)
    in_t = Counter({s: n for s, n in in_t.items() if n >= 3})
    in_o: Counter = Counter()
    for row in ordinary:
        in_o.update(_pairs(row, cores) & in_t.keys())
    told = _telling(in_t, in_o, len(toxic), len(ordinary), tried)
    plain = {s for s in told if not any(w.startswith(tuple(pieces)) for w in s.split(b" ")) and not any(x in s for x in inner)}
    return sorted(plain, key=lambda s: (-told[s], s))


def _telling_text(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Of each toxic text the words that hold a telling string, from where it
    starts on, each with the word after it, written wide."""
    outer = _toxic_pieces(_outer(toxic), _outer(ordinary))
    inner = _inner_pieces(toxic, ordinary)
    pairs = set(_phrases(toxic, ordinary, outer, inner)[:PHRASES])
    begins, within = tuple(outer), re.compile(b"|".join(map(re.escape, inner)) or rb"(?!)")
    cores: dict[bytes, bytes] = {}
    found: dict[bytes, int | None] = {}

    def first(word: bytes) -> int | None:
        at = next((k for k in starts_of(word) if word.startswith(begins, k)), None) if begins else None
        if at is None and (m := within.search(word)):
            at = m.start()
        return at

    out = []
    for row in toxic:
        own = []
        for a, b in zip(row, [*row[1:], b""]):
            if a not in found:
                found[a] = first(a)
            if found[a] is not None:
                own.append(a[found[a] :] + b" " + b)
            elif _pairs([a, b], cores) & pairs:
                own.append(core_of(a) + b" " + core_of(b))
        if own:
            out.append(wide(b"\n".join(own))[0])
    return out


def _trained(samples: list[bytes], size: int) -> bytes:
    """The dictionary zstandard trains on the samples.  It may come out nearly
    empty if its size is large for them, so smaller ones are tried as well and the
    one with most content is taken; samples too few to train on are one themselves."""
    best, whole = b"", sum(map(len, samples))
    for shift in range(5):
        for more in ({}, {"d": 8, "k": 48}, {"d": 8, "k": 96}):
            if size >> shift <= whole and len(best) < size >> shift:
                try:
                    own = zstandard.train_dictionary(size >> shift, samples, **more).as_bytes()
                except zstandard.ZstdError:
                    continue
                best = max(best, own, key=len)
    return best or b"".join(samples)[:size]


@dataclass
class Model:
    """The dictionaries and the calibrated weights; at most some 150 KB, whatever
    the corpus."""

    common: bytes = b""
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(GAINS) + len(INNER_GAINS) + 1))
    bias: float = -20.0
    _inner: dict = field(default_factory=dict, repr=False)
    _sides: tuple = field(default=(), repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_inner": {}, "_sides": ()}

    def sides(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        """The ordinary and the toxic compressor."""

        def side(own: bytes) -> zstandard.ZstdCompressor:
            content = own + self.common
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, min_match=LEAST_MATCH, source_size=64, dict_size=max(1, len(content)), write_content_size=0, write_checksum=0, write_dict_id=0,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            held.precompute_compress(compression_params=how)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

        if not self._sides:
            self._sides = (side(self.ordinary), side(self.toxic))
        return self._sides

    def _gains(self, content: bytes, where: np.ndarray) -> np.ndarray:
        """What the toxic side saves on each window of ``content``."""
        out = np.zeros(len(where), dtype=np.int64)
        for k in range(0, len(where), CHUNK):
            part = where[k : k + CHUNK]
            sizes = []
            for side in self.sides():
                done = side.multi_compress_to_buffer(zstandard.BufferWithSegments(content, part.tobytes()), threads=1)
                sizes.append(np.fromiter(map(len, map(done.__getitem__, range(len(done)))), dtype=np.int64, count=len(done)))
            out[k : k + CHUNK] = sizes[0] - sizes[1]
        return out

    def gains(self, text: bytes) -> np.ndarray:
        """The gain of each of the text's windows."""
        return self._gains(*windows([text])[:2])

    def inner_gains(self, text: bytes) -> np.ndarray:
        """The largest gain of the inner windows of each distinct long word."""
        return self._inner_gains([_runs(text)])[0]

    def _inner_gains(self, each: list[set[bytes]]) -> list[np.ndarray]:
        """``inner_gains`` of the texts that have these long words."""
        every = set().union(*each)
        new = [r for r in every if r not in self._inner]
        if len(self._inner) + len(new) > WORD_CACHE:
            self._inner.clear()
            new = list(every)
        for k in range(0, len(new), CHUNK):
            part = new[k : k + CHUNK]
            content, where, of = inner_windows(part)
            best = np.zeros(len(part), dtype=np.int64)
            if len(of):
                np.maximum.at(best, of, self._gains(content, where))
            self._inner.update(zip(part, best.tolist(), strict=True))
        return [np.fromiter(map(self._inner.__getitem__, runs), dtype=np.int64, count=len(runs)) for runs in each]

    def features(self, texts: Iterable[bytes]) -> list[list[float]]:
        """For each text how many windows and long words reach each gain, and how
        many windows there are."""
        if not self.toxic:
            return [[0.0] * len(self.weights) for _ in texts]
        out: list[list[float]] = []
        for part in _at_once(texts):
            content, where, of = windows(part)
            gains, inner = self._gains(content, where), self._inner_gains([_runs(t) for t in part])
            number = lambda which: np.bincount(which, minlength=len(part)).tolist()
            word_of = np.repeat(np.arange(len(part)), [len(x) for x in inner])
            inner = np.concatenate(inner)
            counts = [*(number(of[gains >= g]) for g in GAINS), *(number(word_of[inner >= g]) for g in INNER_GAINS)]
            out.extend([*map(log1p, own), log1p(n) / 10] for *own, n in zip(*counts, number(of), strict=True))
        return out

    def scores(self, texts: Iterable[bytes]) -> list[float]:
        """The score of each text, which depends on no other."""
        out = []
        for own in self.features(texts):
            z = self.bias + sum(w * x for w, x in zip(self.weights, own, strict=True))
            out.append(1 / (1 + exp(-max(-30.0, min(30.0, z)))))
        return out

    def score(self, text: bytes) -> float:
        return self.scores([text])[0]


def _at_once(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in parts of some ``AT_ONCE`` bytes, or of one text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 50) -> tuple[list[float], float]:
    """Weights and bias by Newton's method with a small ridge, toxic rows weighing
    ``TOXIC_WEIGHT``."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def train(dictionary: list[tuple[bytes, int]], calibration: list[tuple[bytes, int]]) -> Model:
    """A model from two lists of (text, label), each row's label 0 or 1."""
    toxic, plain = (_distinct(t for t, y in dictionary if y == label) for label in (1, 0))
    labels = [y for _, y in calibration] or [y for _, y in dictionary]
    share = sum(labels) / len(labels) if labels else 0.0
    model = Model(bias=log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0)
    if not toxic or not plain or not 0 < share < 1:
        return model
    telling = _telling_text(toxic, plain)
    if not telling:
        return model
    usual = [wide(b" ".join(row))[0] for row in plain]
    # As many ordinary texts as there are toxic ones, for a side of equal size.
    model.common, model.toxic = _trained(usual, COMMON_BYTES), _trained(telling, OWN_BYTES)
    model.ordinary = _trained(usual[: len(toxic)], len(model.toxic))
    calibration = calibration or dictionary
    x = np.array(model.features(t for t, _ in calibration))
    model.weights, model.bias = _logistic(x, np.array([y for _, y in calibration], dtype=np.float64))
    return model


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``labels(doc_id, toxic)`` of ``docs(doc_id, text)``: remainders
    1 to 3 of the id's checksum give the dictionaries, 4 the calibration."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").dropDuplicates(["doc_id"])
    part = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 4).alias("late")
    known = known.where(~held_out(F.col("doc_id"))).select("doc_id", "y", part)
    short = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(
        (F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES))
    order = F.xxhash64("doc_id")
    chosen = None
    for y in (0, 1):
        for late in (False, True):
            own = known.where((F.col("y") == y) & (F.col("late") == late)).orderBy(order).limit(sample)
            chosen = own if chosen is None else chosen.unionByName(own)
    # At most 4 * sample ids: small by construction, as is what is collected: a
    # repeated id brings the least of its texts.
    rows = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "late").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    pick = lambda late: [(bytes(r.text), r.y) for r in rows if r.late == late]
    return train(pick(False), pick(True))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and score, a double from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.scores(t.as_py() or b"" for t in batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"])

    rows = spread(docs.select(*keep, F.col("text").cast("binary").alias("text")))
    kinds = dict(docs.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = own.scores((t.as_py() or "").encode() for t in batch.column(at))
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
