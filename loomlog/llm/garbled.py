"""Text that was decoded with another character encoding than it was written in.

A noisy channel writes a text in one encoding and reads it in another. Every
stretch of a text that is not plain ASCII is turned back into the bytes it was
read from, with wildcards where bytes were lost, and decoded as it may have been
written; the lattice of readings is searched by Viterbi under word and
character frequencies of the whole corpus. A second Viterbi runs over the
stretches of a document: its states are the intact channel and the damaged
ones, and changing the channel costs, so one odd character is no damage but a
few consistent ones are.

The model has a bounded size for any corpus: entries of at least a given
relative frequency, of which there can be no more than its inverse.
"""

from __future__ import annotations

import itertools
import math
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.scratch import stage

LOST = "\N{REPLACEMENT CHARACTER}"
#: Least relative frequency of a word or pair in the model: at most 1 / RARE entries of a kind.
RARE = 2e-6
#: Least count of a word in the model: the only place where a word stands may be the damage that is judged.
TWICE = 2
#: Distinct stretches that a task of the counting has, and the most such tasks.
TASK_ROWS, MOST_TASKS = 8192, 20_000
# tried only where a stretch begins, and never given back: linear in texts of any length
STRETCH = r"(?<![^ \t\r\n])[\x00-\x08\x0b\x0c\x0e-\x1f\x21-\x7f]*+[^\x00-\x7F][^ \t\r\n]*+"
_STRETCH = re.compile(STRETCH)
_QUOTED = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_CONTROL = re.compile("[\\x00-\\x1f\\x7f-\\x9f\\ue000-\\uf8ff]")
WILD = -1

# Encodings of written and of read text, as (written, read) channels.
UTF8_READ_AS = ["western", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "iso8859-2", "gbk", "cp932", "big5", "euc_kr"]
SINGLE = [
    ("cp1252", r) for r in ("cp1250", "cp1251", "cp1253", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "gbk", "cp932")
] + [("cp1250", r) for r in ("western", "cp1251", "cp437", "cp852", "mac_roman", "iso8859-2")] + [("iso8859-2", r) for r in ("western", "cp1250", "cp1251")] + [
    ("cp1251", r) for r in ("western", "koi8-r", "cp866", "cp437", "cp850", "mac_roman", "cp1250", "gbk")
] + [("koi8-r", r) for r in ("western", "cp1251", "cp866", "mac_roman", "cp437")] + [("cp866", r) for r in ("western", "cp1251", "koi8-r", "mac_roman")] + [
    ("mac_roman", r) for r in ("western", "cp1251", "cp437")
] + [("cp437", "western"), ("cp850", "western"), ("cp852", "cp1250"), ("mac_cyrillic", "cp1251"), ("mac_cyrillic", "western"), ("iso8859-15", "western"), ("iso8859-5", "western"), ("iso8859-5", "cp1251")]
DOUBLE_BYTE = [(w, r) for w in ("cp932", "euc_jp", "gbk", "big5", "euc_kr") for r in ("western", "cp1251", "cp437", "mac_roman", "gbk", "cp932", "big5", "euc_kr") if w != r and not (w == "euc_jp" and r == "cp1251")]


_tables: dict[str, dict[str, int]] = {}
_alphabets: dict[str, list[str]] = {}


def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte of a one-byte encoding; control characters stand for undefined bytes."""
    if encoding in _tables:
        return _tables[encoding]
    base = "cp1252" if encoding == "western" else encoding
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(base)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        if encoding == "western" or b not in table.values():
            table.setdefault(chr(b), b)
    _tables[encoding] = table
    return table


def to_bytes(text: str, encoding: str) -> list[int] | None:
    """The bytes that a text was read from, WILD for a lost one; None if it cannot have been."""
    out: list[int] = []
    multi = encoding in ("gbk", "cp932", "big5", "euc_kr", "utf-8")
    table = None if multi or encoding == "ascii" else _bytes_of(encoding)
    for c in text:
        if c < "\x80":
            out.append(ord(c))
        elif c == LOST:
            out.append(WILD)
        elif multi:
            try:
                out += c.encode("gb18030" if encoding == "gbk" and "\ue000" <= c <= "\uf8ff" else encoding)
            except UnicodeEncodeError:
                return None
        elif table is not None and c in table:
            out.append(table[c])
        else:
            return None
    return out


def _chars_of(encoding: str) -> list[str]:
    if encoding in _alphabets:
        return _alphabets[encoding]
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append("")
    _alphabets[encoding] = out
    return out


_lost: dict[tuple[str, int | None], frozenset[int]] = {}
_SPECIAL = re.compile(r"[^\x00-\x7f]+")
_ONE_BYTE = {w for w, _ in SINGLE}


def _lost_bytes(read: str, after: int | None) -> frozenset[int]:
    """The bytes that an encoding has no character for when ``after`` follows (None: nothing, WILD: anything)."""
    if (read, after) not in _lost:
        out = set()
        for b in range(128, 256):
            try:
                if after != WILD:
                    bytes([b, after] if after is not None else [b]).decode("cp1252" if read == "western" else read)
                    continue
            except UnicodeDecodeError as e:
                if e.start:
                    continue
            out.add(b)
        _lost[read, after] = frozenset(out)
    return _lost[read, after]


def _with_lost(data: list[int], read: str) -> list | None:
    """Bytes with the set of possible ones for each that was lost; None if the encoding loses none there."""
    out: list = []
    multi = read in ("gbk", "cp932", "big5", "euc_kr")
    for x, after in zip(data, [*data[1:], None]):
        if x == WILD:
            x = _lost_bytes(read, after if multi else None)
            if not x:
                return None
        out.append(x)
    return out


def _may(p: int | frozenset[int], x: int) -> bool:
    return x in p if type(p) is not int else p == x or p == WILD and x > 127


def _lengths(written: str, first: int | frozenset[int]) -> range:
    """The lengths that the form of a character with this first byte can have."""
    if written in _ONE_BYTE:
        return range(1, 2)
    if written == "utf-8":
        if first == WILD:
            return range(2, 5)
        n = 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
        return range(n, n + 1) if n else range(0)
    return range(4, 13) if written == "utf-8 2" else range(8, 37) if written == "utf-8 3" else range(1, 4)


def _form(own: tuple, written: str) -> bool:
    """Whether bytes with lost ones can be the form of a character that the corpus lacks."""
    if written == "utf-8":
        return all(x == WILD or 0x80 <= x < 0xC0 for x in own[1:])
    first = own[0]
    return (type(first) is not int or not 0 <= first < 128) and (not written.startswith("utf-8") or all(type(x) is not int or not 0 <= x < 128 for x in own))


def _once_more(data: bytes, read: str) -> list[bytes]:
    """UTF-8 of what the bytes look like in a one-byte encoding; undefined ones may stand for themselves."""
    back: dict[int, list[str]] = {}
    for c, b in _bytes_of(read).items():
        back.setdefault(b, []).append(c)
    ways = {"".join(chr(b) if b < 128 else back[b][k] if k < len(back.get(b, ())) else back.get(b, [chr(b)])[0] for b in data) for k in (0, 1)}
    return [w.encode("utf-8") for w in sorted(ways)]


def _encoded(c: str, written: str, read: str) -> list[bytes]:
    """The forms of a character in a written encoding."""
    try:
        got = [c.encode("utf-8" if written.startswith("utf-8") else written)]
    except UnicodeEncodeError:
        return []
    for _ in range(int(written[6:] or 1) - 1 if written.startswith("utf-8") else 0):
        got = [b for g in got for b in _once_more(g, read)]
    return got


def _one_char(data: bytes, written: str, read: str) -> str | None:
    """The character whose form in a written encoding is ``data``, if it is one."""
    try:
        text = data.decode("utf-8" if written.startswith("utf-8") else written)
        for _ in range(int(written[6:] or 1) - 1 if written.startswith("utf-8") else 0):
            again = to_bytes(text, read)
            if again is None or WILD in again:
                return None
            text = bytes(again).decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if len(text) == 1 else None


@dataclass
class Model:
    """Frequencies of words, characters and pairs of characters over all undamaged stretches of a corpus."""

    words: dict[str, int]
    chars: dict[str, int]
    pairs: dict[str, int]
    n_words: int
    n_chars: int

    def __post_init__(self) -> None:
        self._by_bytes: dict[tuple, dict[int, list[tuple[bytes, str]]]] = {}
        self._words_by: dict[tuple, list[tuple[int, str]]] = {}
        self._whole: dict[tuple, list[tuple[str, float]]] = {}
        self._skeletons: dict[str, tuple[int, str]] = {}
        for w, n in self.words.items():
            s = skeleton(w)
            if n > self._skeletons.get(s, (0, ""))[0]:
                self._skeletons[s] = (n, w)
        self._fits: dict[tuple, list[tuple[str, float]]] = {}
        self._log: dict[str, float] = {}
        self.unseen = math.log(0.01 / (self.n_chars + 500))
        self.known = {*self.chars, *map(chr, range(128))}

    def tables(self) -> tuple:
        return self.words, self.chars, self.pairs, self.n_words, self.n_chars

    def char(self, c: str) -> float:
        n = self.chars.get(c)
        return math.log(n / (self.n_chars + 500)) if n else self.unseen

    def pair(self, a: str, b: str) -> float:
        """log P(b | a), backed off to the frequency of b."""
        k = a + b
        v = self._log.get(k)
        if v is None:
            n = self.chars.get(a, 0) if a != "^" else self.chars.get("^", 0)
            v = self._log[k] = math.log((self.pairs.get(k, 0) + 5 * math.exp(self.char(b))) / (n + 5))
            if len(self._log) > 1_000_000:
                self._log.clear()
        return v

    def score(self, text: str) -> float:
        """log likelihood of a stretch; known words count as wholes where that is better."""
        s = _DIGIT.sub("0", text.lower())
        total, at = 0.0, 0
        for m in _WORD.finditer(s):
            w = m.group()
            n = 0 if w.isascii() else self.words.get(w, 0)
            if n:
                total += self._run(s, at, m.start())
                spelled = self._run(s, m.start(), m.end())
                total += max(spelled, math.log(n / (self.n_words + 500)))
                at = m.end()
        return total + self._run(s, at, len(s)) + self.pair(s[-1] if s else "^", "$")

    def _run(self, s: str, a: int, b: int) -> float:
        t = 0.0
        p = s[a - 1] if a else "^"
        for c in s[a:b]:
            t += (self.pair(p, c) if p != LOST and c != LOST else -25.0 if c == LOST else self.char(c))
            p = c
        return t

    def options(self, written: str, read: str, own: tuple) -> list[tuple[str, float]]:
        """What bytes of one character may be in a written encoding; lost ones are sets, or WILD for any."""
        key = written, read if written[6:] else "", own
        got = self._fits.get(key)
        if got is None:
            if all(type(x) is int and x >= 0 for x in own):
                c = _one_char(bytes(own), written, read)
                got = [(c, 0.0)] if c else []
            else:
                got = [(c, 0.0) for b, c in self._forms(written, read).get(len(own), ()) if all(map(_may, own, b))]
                if _form(own, written):
                    got.append((LOST, -14.0 if written.startswith("utf-8") else -25.0))
            if len(self._fits) > 100_000:
                self._fits.clear()
            self._fits[key] = got
        return got

    def _forms(self, written: str, read: str) -> dict[int, list[tuple[bytes, str]]]:
        """The characters of the corpus by the length of their form in an encoding, small ones first."""
        key = written, read if written[6:] else ""
        if key not in self._by_bytes:
            table: dict[int, list[tuple[bytes, str]]] = {}
            small = [c for c in self.chars if c >= "\x80" and c != LOST]
            for c in small + [c.upper() for c in small if len(c.upper()) == 1 and c.upper() != c]:
                for b in _encoded(c, written, read):
                    table.setdefault(len(b), []).append((b, c))
            self._by_bytes[key] = table
        return self._by_bytes[key]

    def whole_words(self, written: str, own: tuple) -> list[tuple[str, float]]:
        """(word, log likelihood) of the corpus words that bytes with lost ones may be: the commonest by last letter."""
        key = written, own
        got = self._whole.get(key)
        if got is None:
            if not self._words_by:
                for w, n in self.words.items():
                    for utf8 in (True, False):
                        self._words_by.setdefault((utf8, len(w.encode("utf-8", "ignore")) if utf8 else len(w), _SPECIAL.sub("\0", w)), []).append((n, w))
                for found in self._words_by.values():
                    found.sort(key=lambda x: -x[0])
            letters = "".join(chr(x) if type(x) is int and 0 <= x < 128 else "\0" for x in own)
            plain = letters.replace("\0", "")
            loud = plain.isupper() and len(plain) > 1
            best: dict[str, tuple[str, float]] = {}
            for n, w in self._words_by.get((written == "utf-8", len(own), re.sub("\0+", "\0", letters.lower())), ()):
                if w[-1] in best:
                    continue
                forms = [w.upper(), w] if loud else [w, w[0].upper() + w[1:], w.upper()]
                for shown in forms:
                    try:
                        b = shown.encode(written)
                    except UnicodeEncodeError:
                        continue
                    # plain letters stand as they are, small or not
                    if len(b) == len(own) and all(_may(p, x) if not (type(p) is int and 0 <= p < 128) else x < 128 and chr(p).lower() == chr(x).lower() for p, x in zip(own, b)):
                        kept = iter(plain)
                        best[w[-1]] = "".join(next(kept) if c < "\x80" else c for c in shown), math.log(n / (self.n_words + 500))
                        break
            if len(self._whole) > 100_000:
                self._whole.clear()
            got = self._whole[key] = list(best.values())
        return got

    def fill(self, text: str) -> str:
        """Choose the commonest word for every word that has lost characters, where one fits."""

        def best(m: re.Match) -> str:
            w = m.group()
            hit = self._skeletons.get(skeleton(w.lower())) if LOST in w else None
            if not hit:
                return w
            return "".join(a.upper() if (b.isupper() or b == LOST and w.replace(LOST, "").isupper() and len(w.replace(LOST, "")) > 1) else a for a, b in zip(hit[1], w)) if len(hit[1]) == len(w) else w

        return re.sub(rf"(?<![^\W\d_])[^\W\d_]*+(?:{LOST}[^\W\d_]*+)+", best, text)


def skeleton(word: str) -> str:
    return "".join(c if c.isascii() else "\0" for c in word)


def _low(c: str) -> str:
    """The state that a character leaves behind: its small form, one digit for all."""
    low = c.lower()
    return "0" if "0" <= low <= "9" else low[0] if low else low


class _Arrivals:
    """The likeliest way on from a set of states, for all characters at once.

    Exact without a matrix of all pairs: a pair that the model lacks backs off
    to the frequency of its second character, so one predecessor is the best of
    all those; the pairs that the model has lie in arrays by either character.
    """

    FEW = 8

    def __init__(self, scorer: _Scorer):
        self.scorer = scorer
        size = scorer.size
        self.plain = math.log(5) + scorer.char
        first, second = scorer.keys // size, scorer.keys % size
        self.by_first = np.searchsorted(first, np.arange(size + 1))
        self.second, self.value = second, scorer.pair
        order = np.argsort(second, kind="stable")
        self.before, self.pair = first[order], scorer.pair[order]
        self.targets, self.starts = np.unique(second[order], return_index=True)
        self.sizes = np.diff(np.append(self.starts, len(order)))

    def best(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood, state it comes from) of every next character."""
        s = self.scorer
        live = np.flatnonzero(values > -math.inf)
        if len(live) <= self.FEW:
            top, source = np.full(s.size, -math.inf), np.zeros(s.size, np.int64)
            for p in live.tolist():
                row = self.plain - s.count[p]
                a, b = self.by_first[p], self.by_first[p + 1]
                row[self.second[a:b]] = self.value[a:b]
                row += values[p]
                better = row > top
                top[better], source[better] = row[better], p
            return top, source
        rest = values - s.count
        p = int(np.argmax(rest))
        top, source = rest[p] + self.plain, np.full(s.size, p)
        if len(self.pair):
            got = values[self.before] + self.pair
            most = np.maximum.reduceat(got, self.starts)
            at = np.flatnonzero(got == np.repeat(most, self.sizes))
            of = np.searchsorted(self.starts, at, side="right") - 1
            which, k = np.unique(of, return_index=True)
            most, back, target = most[which], self.before[at[k]], self.targets[which]
            better = most > top[target]
            top[target[better]], source[target[better]] = most[better], back[better]
        return top, source


class _States:
    """What is known at one position: the likelihood and the way of the best string that ends in each character."""

    __slots__ = ("values", "ways")

    def __init__(self, size: int):
        self.values, self.ways = np.full(size, -math.inf), {}

    def add(self, top: np.ndarray, source: np.ndarray, came: _States, options: _Options) -> None:
        """Go on from ``came`` by any of the options."""
        v = top[options.places] + options.extra
        for k in np.flatnonzero(v > self.values[options.places]).tolist():
            place = int(options.places[k])
            self.values[place] = v[k]
            self.ways[place] = (came.ways.get(int(source[place])), options.chars[k])

    def lose(self, came: _States, start: int, price: float) -> None:
        """Leave a character open: what follows it is as likely as at a beginning."""
        p = int(np.argmax(came.values))
        if came.values[p] + price > self.values[start]:
            self.values[start], self.ways[start] = came.values[p] + price, (came.ways.get(p), LOST)


class _Options:
    """Alternatives for one character: each small form once, the first of those that share it."""

    def __init__(self, options: list[tuple[str, float]], scorer: _Scorer):
        self.lost = max((extra for c, extra in options if c == LOST), default=None)
        first: dict[str, tuple[str, float]] = {}
        for c, extra in options:
            low = _low(c)
            if c != LOST and (low not in first or extra > first[low][1]):
                first[low] = c, extra
        self.chars = [c for c, _ in first.values()]
        self.extra = np.array([extra for _, extra in first.values()])
        self.places = scorer.places(np.array([ord(low) for low in first], np.uint32)) if first else np.zeros(0, np.int64)


def _spell(states: _States, scorer: _Scorer) -> tuple[str, float] | None:
    """The string that ends best, and its log likelihood with the end."""
    live = np.flatnonzero(states.values > -math.inf)
    if not len(live):
        return None
    ends = states.values[live] + scorer.pairs(live, np.full(len(live), scorer.end))
    k = int(np.argmax(ends))
    link = states.ways.get(int(live[k]))
    out = []
    while link is not None:
        link, c = link
        out.append(c)
    return "".join(reversed(out)), float(ends[k])


def _viterbi(slots: list[list[tuple[str, float]]], scorer: _Scorer) -> tuple[str, float]:
    """The likeliest string with one of the alternatives in each slot."""
    states = _States(scorer.size)
    states.values[scorer.start] = 0.0
    kept: dict[int, _Options] = {}
    for options in slots:
        if id(options) not in kept:
            kept[id(options)] = _Options(options, scorer)
        own, nxt = kept[id(options)], _States(scorer.size)
        nxt.add(*scorer.arrivals().best(states.values), states, own)
        if own.lost is not None:
            nxt.lose(states, scorer.start, own.lost)
        states = nxt
    return _spell(states, scorer)


def _lattice(data: list, written: str, read: str, scorer: _Scorer) -> tuple[str, float] | None:
    """The likeliest reading of bytes with lost ones as a written encoding; None if the known bytes rule one out.

    Positions are joined by the forms that fit there, of any length that the
    encoding has, and by known words over a whole run of letters; the search
    chooses where characters begin and end.
    """
    model = scorer.model
    words = {}
    if written == "utf-8" or written in _ONE_BYTE:
        at = 0
        for run, members in itertools.groupby(data, lambda x: not (type(x) is int and 0 <= x < 128) or chr(x).isalpha()):
            end = at + len(list(members))
            if run and any(type(x) is not int or x < 0 for x in data[at:end]):
                words[at] = end
            at = end
    ahead: dict[int, _States] = {0: _States(scorer.size)}  # only of positions that can still be reached
    ahead[0].values[scorer.start] = 0.0
    for i, x in enumerate(data):
        states = ahead.pop(i, None)
        if states is None:
            continue
        top, source = scorer.arrivals().best(states.values)
        for length in (1,) if type(x) is int and 0 <= x < 128 else _lengths(written, x):
            if i + length > len(data):
                continue
            own = scorer.options(written, read, tuple(data[i : i + length]))
            if len(own.chars) or own.lost is not None:
                into = ahead.setdefault(i + length, _States(scorer.size))
                into.add(top, source, states, own)
                if own.lost is not None:
                    into.lose(states, scorer.start, own.lost)
        if i in words:
            p = int(np.argmax(states.values))
            v, link = float(states.values[p]), states.ways.get(p)
            into = ahead.setdefault(words[i], _States(scorer.size))
            for w, more in model.whole_words(written, tuple(data[i : words[i]])):
                place = int(scorer.places(np.array([ord(_low(w[-1]))], np.uint32))[0])
                if v + more > into.values[place]:
                    into.values[place], into.ways[place] = v + more, (link, w)
    ends = ahead.get(len(data))
    return _spell(ends, scorer) if ends is not None else None


#: Channel names by number; 0 is the intact one.
CHANNELS = [("", "")] + [("utf-8", r) for r in UTF8_READ_AS] + [("utf-8 2", r) for r in UTF8_READ_AS[:5]] + [("utf-8 3", "western")] + SINGLE + DOUBLE_BYTE + [("utf-8", "ascii"), ("cp1252", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8")]


_MIXED = re.compile(r"[A-Za-z\u00c0-\u024f][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z\u00c0-\u024f]")


#: Encodings in which a stretch may show the structure of UTF-8.
STRUCTURAL = ("western", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "gbk")


def structural(stretch: str) -> bool:
    """Whether a stretch cannot teach what intact text looks like.

    It reads as multi-byte UTF-8 in some one-byte encoding, has lost or control
    characters, or Latin next to Cyrillic letters.
    """
    if LOST in stretch or any("\x80" <= c < "\xa0" for c in stretch) or _MIXED.search(stretch):
        return True
    for r in STRUCTURAL:
        data = to_bytes(stretch, r)
        if data is not None:
            try:
                text = bytes(data).decode("utf-8")
                # Cyrillic code pages hit three-byte forms of ideographs by chance
                if len(text) < len(stretch) + (r == "gbk") and not (r in ("koi8-r", "cp866") and any("\u0800" <= c < "\u2000" or "\u2e80" <= c for c in text)):
                    return True
            except UnicodeDecodeError:
                pass
    return False


INVALID = 0xFFFF
_MULTI = ("gbk", "cp932", "big5", "euc_kr")
_ONE_BYTE_READS = sorted({r for _, r in CHANNELS[1:]} - {*_MULTI, "utf-8", "ascii"})
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)


class Stretches:
    """Many stretches as one array of characters, to test all of them at once."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))

    def read_in(self, read: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the stretches that a one-byte encoding can have been read as, their bytes, lengths and characters)."""
        if read not in _luts:
            lut = np.full(1 << 16, INVALID, np.uint16)
            lut[:128] = np.arange(128)
            for c, b in _bytes_of(read).items():
                lut[ord(c)] = b
            _luts[read] = lut
        got = np.where(self.codes < 1 << 16, _luts[read][np.minimum(self.codes, INVALID)], INVALID)
        starts = np.cumsum(self.lengths) - self.lengths
        fine = np.maximum.reduceat(got, starts) < 256
        kept = np.repeat(fine, self.lengths)
        return np.flatnonzero(fine), got[kept].astype(np.uint8), self.lengths[fine], self.codes[kept]


_luts: dict[str, np.ndarray] = {}


def _neighbours(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the byte before, the byte after) each byte; 0 at the ends of a stretch."""
    before, after = np.empty_like(data), np.empty_like(data)
    before[1:], after[:-1] = data[:-1], data[1:]
    before[starts] = 0
    after[np.append(starts[1:], len(data)) - 1] = 0
    return before, after


def _all_in(fine: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.minimum.reduceat(fine, starts))


def utf8_shaped(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the stretches in which every high byte is where UTF-8 may have one; others cannot be UTF-8."""
    if not len(lengths):
        return lengths
    starts = np.cumsum(lengths) - lengths
    before, after = _neighbours(data, starts)
    follows = (data & 0xC0) == 0x80
    leads = (data >= 0xC2) & (data <= 0xF4) & ((after & 0xC0) == 0x80)
    return _all_in((data < 128) | leads | follows & (before >= 128), starts)


def structural_many(texts: list[str]) -> list[bool]:
    """``structural`` of many stretches; the shape of their bytes says at once which few can be multi-byte UTF-8."""
    if not texts:
        return []
    many = Stretches(texts)
    open_ = np.zeros(len(texts), bool)
    for r in STRUCTURAL:
        if r not in _MULTI:
            numbers, data, lengths, _ = many.read_in(r)
            open_[numbers[utf8_shaped(data, lengths)]] = True
    return [
        LOST in s or any("\x80" <= c < "\xa0" for c in s) or bool(_MIXED.search(s)) or (bool(o) or _encode(s, "gbk") is not None) and structural(s)
        for s, o in zip(texts, open_)
    ]


class _Pairs:
    """Which bytes and pairs of bytes an encoding of two-byte characters has."""

    def __init__(self, written: str):
        self.single, self.double = np.zeros(256, bool), np.zeros((256, 256), bool)
        for a in range(128, 256):
            self.single[a] = _decodes(bytes([a]), written)
            for b in range(256):
                self.double[a, b] = _decodes(bytes([a, b]), written)
        self.longer = np.zeros(256, bool)
        self.longer[[0x8E, 0x8F]] = written == "euc_jp"

    def shaped(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers of the stretches whose high bytes can all be part of a character."""
        if not len(lengths):
            return lengths
        starts = np.cumsum(lengths) - lengths
        before, after = _neighbours(data, starts)
        fine = (data < 128) | self.single[data] | self.double[data, after] | self.double[before, data]
        if self.longer.any():
            odd = np.maximum.reduceat(self.longer[data], starts)
            fine |= np.repeat(odd, lengths)
        return _all_in(fine, starts)


def _encode(text: str, read: str) -> bytes | None:
    """``to_bytes`` of a text without lost characters."""
    try:
        return text.encode(read)
    except UnicodeEncodeError:
        data = to_bytes(text, read) if read == "gbk" and _CONTROL.search(text) else None
        return bytes(data) if data is not None else None


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


class _Reader:
    """The likelihood of bytes as text of a one-byte encoding, for many stretches at once; the same as ``Model.score``."""

    def __init__(self, written: str, scorer: _Scorer):
        chars = _chars_of(written)
        low = ["0" if "0" <= c <= "9" else c.lower() for c in chars]
        self.hashes, self.logs = scorer.hashes, scorer.logs
        self.char = np.array([ord(c) if c else 0 for c in chars], np.uint32)
        self.fine = np.array([bool(c) and not _CONTROL.match(c) for c in chars])
        # a small form that depends on its neighbours, or is several characters, is left to the scoring of texts
        self.tricky = np.array([len(x) > 1 or c == "\u03a3" for c, x in zip(chars, low)])
        self.letter = np.array([bool(_WORD.fullmatch(x)) for x in low])
        self.code = np.array([ord(x[0]) if x else 0 for x in low], np.uint64)
        place = scorer.places(self.code.astype(np.uint32))
        rows, columns = np.append(place, scorer.start), np.append(place, scorer.end)
        self.pair = scorer.pairs(np.repeat(rows, 257), np.tile(columns, 257)).reshape(257, 257)

    def scores(self, data: np.ndarray, lengths: np.ndarray, shown: np.ndarray) -> np.ndarray:
        """The score of each stretch; -inf where it is no such text or the text ``shown``, inf where only the text tells."""
        starts = np.cumsum(lengths) - lengths
        before = np.empty(len(data), np.int64)
        before[1:] = data[:-1]
        before[starts] = 256
        p = self.pair[before, data]
        total = np.add.reduceat(p, starts) + self.pair[data[starts + lengths - 1], 256]
        total += _word_gain(self.letter[data], self.code[data], data >= 128, p, starts, lengths, self.hashes, self.logs)
        total[np.maximum.reduceat(self.tricky[data], starts)] = math.inf
        total[~np.minimum.reduceat(self.fine[data], starts) | np.minimum.reduceat(self.char[data] == shown, starts)] = -math.inf
        return total


class _Scorer:
    """``Model.score`` of many texts at once."""

    def __init__(self, model: Model, hashes: np.ndarray, logs: np.ndarray):
        self.model, self.hashes, self.logs = model, hashes, logs
        letters = sorted(c for c in {*model.chars, "^", "$"} if len(c) == 1)
        self.alphabet = np.array([ord(c) for c in letters], np.uint32)
        place = {c: i for i, c in enumerate(letters)}
        self.size = len(letters) + 1  # the last place is that of unknown characters
        self.char = np.array([model.char(c) for c in letters] + [model.unseen])
        self.count = np.log(np.array([model.chars.get(c, 0) for c in letters] + [0]) + 5.0)
        known = sorted((place[k[0]] * self.size + place[k[1]], k) for k in model.pairs if len(k) == 2 and k[0] in place and k[1] in place)
        self.keys = np.array([k for k, _ in known], np.int64)
        self.pair = np.array([model.pair(k[0], k[1]) for _, k in known])
        self.start, self.end = place["^"], place["$"]
        self._arrivals: _Arrivals | None = None
        self._options: dict[tuple, _Options] = {}

    def arrivals(self) -> _Arrivals:
        if self._arrivals is None:
            self._arrivals = _Arrivals(self)
        return self._arrivals

    def options(self, written: str, read: str, own: tuple) -> _Options:
        """The characters that bytes with lost ones can be; plain ASCII is itself."""
        key = written, read if written[6:] else "", own
        if key not in self._options:
            if len(self._options) > 20_000:
                self._options.clear()
            plain = len(own) == 1 and type(own[0]) is int and 0 <= own[0] < 128
            self._options[key] = _Options([(chr(own[0]), 0.0)] if plain else self.model.options(written, read, own), self)
        return self._options[key]

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where characters are in the alphabet of the model; all that it lacks share the last place."""
        place = np.minimum(np.searchsorted(self.alphabet, codes), self.size - 2)
        return np.where(self.alphabet[place] == codes, place, self.size - 1)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log P(b | a) of places, as ``Model.pair``."""
        out = math.log(5) + self.char[b] - self.count[a]
        if len(self.keys):
            key = a * self.size + b
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[k] == key, self.pair[k], out)
        return out

    def scores(self, texts: list[str]) -> list[float]:
        short = [i for i, t in enumerate(texts) if 0 < len(t) <= len(_POWERS) // 2 and LOST not in t]
        out = [0.0] * len(texts)
        if short:
            for i, v in zip(short, self._scores([_DIGIT.sub("0", texts[i].lower()) for i in short]).tolist()):
                out[i] = v
        if len(short) < len(texts):
            for i in set(range(len(texts))).difference(short):
                out[i] = self.model.score(texts[i])
        return out

    def _scores(self, low: list[str]) -> np.ndarray:
        many = Stretches(low)
        codes, lengths = many.codes, many.lengths
        starts = np.cumsum(lengths) - lengths
        place = self.places(codes)
        before = np.empty_like(place)
        before[1:] = place[:-1]
        before[starts] = self.start
        p = self.pairs(before, place)
        last = place[starts + lengths - 1]
        total = np.add.reduceat(p, starts) + self.pairs(last, np.full(len(last), self.end))
        kinds, which = np.unique(codes, return_inverse=True)
        letter = np.array([bool(_WORD.fullmatch(chr(c))) for c in kinds.tolist()])[which]
        return total + _word_gain(letter, codes, codes >= 128, p, starts, lengths, self.hashes, self.logs)


def _word_gain(letter: np.ndarray, codes: np.ndarray, special: np.ndarray, p: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """What each stretch gains by its known words that are not plain ASCII counting as wholes."""
    at = np.flatnonzero(letter)
    if not len(at) or not len(hashes):
        return np.zeros(len(lengths))
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    opens[starts] |= letter[starts]
    first = np.flatnonzero(opens[at])
    sizes = np.diff(np.append(first, len(at)))
    place = np.minimum(np.arange(len(at)) - np.repeat(first, sizes), len(_POWERS) - 1)
    h = np.add.reduceat(codes[at].astype(np.uint64) * _POWERS[place], first)
    spelled = np.add.reduceat(p[at], first)
    k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    known = np.maximum.reduceat(special[at], first) & (hashes[k] == h)
    gain = np.where(known, np.maximum(logs[k] - spelled, 0.0), 0.0)
    of = np.repeat(np.arange(len(lengths)), lengths)[at[first]]
    return np.bincount(of, weights=gain, minlength=len(lengths))


class Decoder:
    """Emissions of all channels for a stretch, and the search over a document.

    Entering a damaged channel costs, more so by one lone character whose bytes
    have no structure; leaving it costs little. A reading that is behind the
    text as it stands by the price of leaving the channel and entering it again
    is in no best path: being intact there would be better. Such readings, and
    states that far behind, are dropped; nothing else is.
    """

    def __init__(self, model: Model, enter_utf8: float = 5.0, enter: float = 14.0, leave: float = 1.0, lone: float = 6.0):
        self.model, self.leave, self.lone = model, leave, lone
        self.enter = [0.0] + [enter_utf8 if w.startswith("utf-8") else enter for w, _ in CHANNELS[1:]]
        #: What is lost at most by not being in a channel for one stretch.
        self.reach = [0.0] + [leave + e + (0.0 if w.startswith("utf-8") else lone) for e, (w, _) in zip(self.enter[1:], CHANNELS[1:])]
        self._memo: dict[str, tuple[float, list, float, float]] = {}
        self._readers: dict[str, _Reader] = {}
        self._pairs: dict[str, _Pairs] = {}
        self._words: tuple[np.ndarray, np.ndarray] | None = None
        self._texts: _Scorer | None = None

    def readings(self, stretch: str) -> tuple[float, list[tuple[int, float, str]]]:
        """(log likelihood as it stands, [(channel, log likelihood, restored)] of the channels it can have come through)."""
        own, read, _, _ = self._of(stretch)
        return own, [(c, score, self._restored(stretch, c, text)) for c, score, text in read]

    def _of(self, stretch: str) -> tuple[float, list[tuple[int, float, str | None]], float, float]:
        """As ``readings``, texts only where they had to be made, and the most that a channel of UTF-8 and one of another gain."""
        got = self._memo.get(stretch)
        if got is None:
            self.prepare([stretch])
            got = self._memo[stretch]
        return got

    @staticmethod
    def _restored(stretch: str, c: int, text: str | None) -> str:
        written, read = CHANNELS[c]
        return text if text is not None else bytes(to_bytes(stretch, read)).decode(written)

    @staticmethod
    def _hope(own: float, read: list) -> tuple[float, list, float, float]:
        gain = [0.0, 0.0]
        for c, score, _ in read:
            k = not CHANNELS[c][0].startswith("utf-8")
            gain[k] = max(gain[k], score - own)
        return own, read, *gain

    def prepare(self, stretches: Iterable[str]) -> None:
        """Find the readings of many stretches at once, each distinct one only once."""
        if len(self._memo) > 200_000:
            self._memo.clear()
        new = [s for s in dict.fromkeys(stretches) if s not in self._memo]
        for s in new:
            if LOST in s:
                self._memo[s] = self._hope(*self._read_lost(s))
        plain = [s for s in new if LOST not in s]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            self._memo.update((s, self._hope(*r)) for s, r in zip(part, self._read_many(part)))

    def _read_lost(self, stretch: str) -> tuple[float, list[tuple[int, float, str]]]:
        m, scorer = self.model, self._scorer()
        out = []
        coded: dict[str, list[int] | None] = {}
        searched: dict[tuple | None, tuple[str, float] | None] = {}
        for c, (written, read) in enumerate(CHANNELS):
            if not c:
                continue
            if read not in coded:
                coded[read] = to_bytes(stretch, read) if read != "utf-8" else [WILD if x == LOST else ord(x) for x in stretch]
            data = coded[read]
            if data is None:
                continue
            if read == "utf-8":
                if any(x > 127 and x < 0xA0 or x > 0x24F for x in data):
                    continue
                letters = [(x, 0.0) for x in _chars_of(written)[128:] if x and (x.lower() in m.chars)] + [(LOST, -14.0)]
                text, s = _viterbi([[(chr(x), 0.0)] if x != WILD else letters for x in data], scorer)
                filled = m.fill(stretch)
                if LOST not in filled:
                    text = filled
                out.append((c, max(s, m.score(text)), text))
                continue
            # what was lost of UTF-8 may be any byte; of other encodings, and of text written twice, one that the reader lacks
            known = data if written == "utf-8" else _with_lost(data, read)
            # encodings that differ in known bytes only read the same lost ones alike
            key = (written, read if written[6:] else "", tuple(known)) if known else None
            if key not in searched:
                searched[key] = _lattice(known, written, read, scorer) if known else None
            got = searched[key]
            if got and got[0] != stretch:
                out.append((c, max(got[1], m.score(got[0])), got[0]))
        # where readings are alike, the one that any byte is lost in comes first
        out.sort(key=lambda r: CHANNELS[r[0]][1] != "utf-8")
        return m.score(stretch), out

    def _read_many(self, texts: list[str]) -> list[tuple[float, list[tuple[int, float, str]]]]:
        """The readings of stretches without lost characters.

        Arrays rule out, for all stretches at once, the channels that cannot
        have written a stretch or whose reading is too unlikely to matter; what
        is left is decoded and scored as text.
        """
        own = self._scorer().scores(texts)
        asked: list[tuple[int, int, str]] = []
        out: list[list[tuple[int, float, str]]] = [[] for _ in texts]
        many = Stretches(texts)
        for read in _ONE_BYTE_READS:
            numbers, data, lengths, shown = many.read_in(read)
            if not len(numbers):
                continue
            starts = np.cumsum(lengths) - lengths
            raw = data.tobytes()
            shaped: dict[str, np.ndarray] = {}
            base = np.array([own[i] for i in numbers])
            for c, written in _channels_of(read):
                if written.startswith("utf-8"):
                    if "utf-8" not in shaped:
                        shaped["utf-8"] = utf8_shaped(data, lengths)
                    which = shaped["utf-8"]
                elif written in _ONE_BYTE:
                    scores = self._reader(written).scores(data, lengths, shown)
                    which = np.flatnonzero(scores > base - self.reach[c])
                    for k, i, v in zip(which.tolist(), numbers[which].tolist(), scores[which].tolist()):
                        if v < math.inf:
                            out[i].append((c, v, None))
                    which = which[scores[which] == math.inf]
                else:
                    if written not in self._pairs:
                        self._pairs[written] = _Pairs(written)
                    which = self._pairs[written].shaped(data, lengths)
                for k in which.tolist():
                    i, a = int(numbers[k]), int(starts[k])
                    text = self._decode(texts[i], c, raw[a : a + int(lengths[k])], own[i])
                    if text is not None:
                        asked.append((i, c, text))
        for read in _MULTI:
            channels = _channels_of(read)
            for i, s in enumerate(texts):
                data = _encode(s, read)
                if data is not None:
                    for c, _ in channels:
                        text = self._decode(s, c, data, own[i])
                        if text is not None:
                            asked.append((i, c, text))
        for (i, c, text), score in zip(asked, self._scorer().scores([t for _, _, t in asked])):
            if score > own[i] - self.reach[c]:
                out[i].append((c, score, text))
        for found in out:
            found.sort(key=lambda r: r[0])
        return list(zip(own, out))

    def _known_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words that are not plain ASCII, sorted, and their log likelihoods."""
        if self._words is None:
            m = self.model
            special = [(w, n) for w, n in m.words.items() if not w.isascii() and len(w) <= len(_POWERS)]
            hashes = np.array([np.sum(np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64) * _POWERS[: len(w)], dtype=np.uint64) for w, _ in special], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self._words = hashes[order], np.array([math.log(n / (m.n_words + 500)) for _, n in special])[order]
        return self._words

    def _reader(self, written: str) -> _Reader:
        if written not in self._readers:
            self._readers[written] = _Reader(written, self._scorer())
        return self._readers[written]

    def _scorer(self) -> _Scorer:
        if self._texts is None:
            self._texts = _Scorer(self.model, *self._known_words())
        return self._texts

    def _decode(self, stretch: str, c: int, data: bytes, own: float) -> str | None:
        """The reading of a stretch through a channel, if there is one that can matter."""
        m, (written, read) = self.model, CHANNELS[c]
        text = stretch
        try:
            if written.startswith("utf-8"):
                for k in range(int(written[6:] or 1)):
                    again = data if not k else to_bytes(text, read)
                    if again is None:
                        return None
                    text = bytes(again).decode("utf-8")
            else:
                text = data.decode(written)
        except UnicodeDecodeError:
            return None
        # every unknown character costs at least ``unseen``
        if text == stretch or len(set(text.lower()) - m.known) * m.unseen <= own - self.reach[c] or _CONTROL.search(text):
            return None
        return text

    def suspect(self, stretch: str) -> bool:
        """Whether a damaged channel explains a stretch better than the intact one.

        At the price of entering the channel, or half of it for a stretch with
        several characters to tell by.
        """
        own, read, utf8, other = self._of(stretch)
        if not utf8 and not other:
            return False
        price = 0.5 if sum(c > "\x7f" for c in stretch) > 2 else 1.0
        return any(score - own > self.enter[c] * price for c, score, _ in read)

    def document(self, text: str, spans: list[tuple[int, int, str]] | None = None) -> tuple[list[tuple[int, int, int, str]], float]:
        """([(start, end, channel, restored)], gain in log likelihood) of the damaged stretches."""
        spans = list(spans_of(text)) if spans is None else spans
        found = [self._of(s) for _, _, s in spans]
        # what channels gain at most, all together, does not pay for entering one: no search is needed
        if sum(f[2] for f in found) <= self.enter[1] and sum(f[3] for f in found) <= self.enter[-1]:
            return [], 0.0
        # channel -> (likelihood relative to the intact text, link); 0 is the intact channel
        live: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for i, (_, _, s) in enumerate(spans):
            own, read, _, _ = found[i]
            home, home_link = max(((v - (self.leave if c else 0.0), link) for c, (v, link) in live.items()), key=lambda x: x[0])
            nxt: dict[int, tuple[float, tuple | None]] = {0: (home, home_link)}
            for c, score, restored in read:
                stay = live.get(c)
                # one character alone tells little, if its bytes have no structure
                alone = len(s) == 1 and not CHANNELS[c][0].startswith("utf-8") and LOST not in s
                v, link = home - self.enter[c] - self.lone * alone, home_link
                if c and stay is not None and stay[0] >= v:
                    v, link = stay
                nxt[c] = (v + score - own, (link, i, c, restored))
            best = max(v for v, _ in nxt.values())
            live = {c: x for c, x in nxt.items() if x[0] > best - self.reach[c] or c == 0}
        gain, link = max(live.values(), key=lambda x: x[0])
        out = []
        while link is not None:
            link, i, c, restored = link
            out.append((spans[i][0], spans[i][1], c, self._restored(spans[i][2], c, restored)))
        out.reverse()
        return out, gain


def spans_of(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, stretch) of the stretches of a text that are not plain ASCII.

    Inline code is quoted on purpose: it is cut out, and what stands before and
    after it without a blank are stretches of their own.
    """
    quoted = [m.span() for m in _QUOTED.finditer(text)] if "`" in text else []
    q = 0
    for m in _STRETCH.finditer(text):
        a, b = m.span()
        while q < len(quoted) and quoted[q][1] <= a:
            q += 1
        k = q
        while k < len(quoted) and quoted[k][0] < b:
            if a < quoted[k][0] and not text[a : quoted[k][0]].isascii():
                yield a, quoted[k][0], text[a : quoted[k][0]]
            a = max(a, quoted[k][1])
            k += 1
        if a < b and (a == m.start() or not text[a:b].isascii()):
            yield a, b, text[a:b]


def _channels_of(read: str) -> list[tuple[int, str]]:
    """(number, written) of the channels that are read in an encoding."""
    return [(c, w) for c, (w, r) in enumerate(CHANNELS) if c and r == read]


def decoder_of(shared, number: str) -> Decoder:
    """The decoder of a broadcast model, one per worker process: its tables and what it has read serve later tasks."""
    kept = sys.__dict__.setdefault("_loomlog_decoders", {})  # functions come by value, so a module of ours would be new in every task
    if number not in kept:
        decoder = Decoder(Model(*shared.value))
        for older in list(kept):
            decoder._pairs.update(kept[older]._pairs)  # these are of encodings, not of a model
            if len(kept) > 1:
                kept.pop(older)
        kept[number] = decoder
    return kept[number]


MODEL_SCHEMA = "kind string, key string, n bigint"


def frequencies(docs: DataFrame, text: str = "text", rare: float = RARE, rounds: int = 2) -> Model:
    """Count words, characters and pairs over every undamaged stretch of every text.

    Distinct stretches are counted first, so their analysis is done once each.
    A later round leaves out what the model of the round before reads better
    through a damaged channel; else common damage would pass for a word. What
    comes to the driver has at least the relative frequency ``rare`` in its
    kind, hence at most 1 / ``rare`` rows a kind.
    """
    found = docs.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(STRETCH), F.lit(0))).alias("stretch")).groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    found = stage(found, "stretches")
    # by rows, not by bytes: stretches are few bytes and take long
    found = found.repartition(max(1, min(-(-found.count() // TASK_ROWS), MOST_TASKS)))
    model = None
    for _ in range(rounds):
        model = _count(found, rare, model)
    return model


def _count(found: DataFrame, rare: float, model: Model | None) -> Model:
    shared = found.sparkSession.sparkContext.broadcast(model.tables()) if model else None
    number = str(shared._jbroadcast.id()) if shared else ""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = decoder_of(shared, number) if shared else None
        for b in batches:
            words, chars, pairs = Counter(), Counter(), Counter()
            clean = [(s, n) for s, n, odd in zip(b["stretch"], b["n"], structural_many(list(b["stretch"]))) if not odd]
            if decoder:
                decoder.prepare(s for s, _ in clean)
            for s, n in clean:
                if decoder and decoder.suspect(s):
                    continue
                t = _DIGIT.sub("0", s.lower())
                for w in _WORD.findall(t):
                    if not w.isascii():
                        words[w] += n
                p = "^"
                chars[p] += n
                for c in t:
                    chars[c] += n
                    pairs[p + c] += n
                    p = c
                pairs[p + "$"] += n
            rows = [(k, key, n) for k, table in (("w", words), ("c", chars), ("p", pairs)) for key, n in table.items()]
            yield pd.DataFrame(rows, columns=["kind", "key", "n"]).astype({"n": "int64"})

    counted = stage(found.mapInPandas(count, MODEL_SCHEMA).groupBy("kind", "key").agg(F.sum("n").alias("n")), "frequencies")
    totals = {k: n for k, n in counted.groupBy("kind").agg(F.sum("n")).collect()}
    least = F.lit(0.0)
    for k, n in totals.items():
        least = F.when(F.col("kind") == k, F.lit(rare * n)).otherwise(least)
    kept: dict[str, dict[str, int]] = {"w": {}, "c": {}, "p": {}}
    for k, key, n in counted.where((F.col("n") >= least) & ((F.col("n") >= TWICE) | (F.col("kind") != "w"))).collect():
        kept[k][key] = n
    return Model(kept["w"], kept["c"], kept["p"], totals.get("w", 0), totals.get("c", 0))


RESTORED = "channels array<string>, damaged int, lost int, gain double, restored string"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, rare: float = RARE) -> DataFrame:
    """The damaged documents: key, channels (written>read), damaged stretches, lost characters left, gain, restored text.

    Null, empty and plain ASCII texts are intact. A character that was lost is
    damage wherever it stands outside a quotation (`inline code`). Repeated
    rows are judged one by one.
    """
    model = model or frequencies(docs, text, rare)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.tables())
    todo = docs.where(F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(key), F.col(text).alias("_text"))
    number = str(shared._jbroadcast.id())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = decoder_of(shared, number)
        for b in batches:
            rows = []
            stretches = [list(spans_of(t)) for t in b["_text"]]
            d.prepare(s for own in stretches for _, _, s in own)
            for k, t, own in zip(b[key], b["_text"], stretches):
                spans, gain = d.document(t, own)
                spans = [s for s in spans if s[3] != t[s[0] : s[1]]]
                open_ = LOST in (_QUOTED.sub("", t) if "`" in t else t)
                if not spans and not open_:
                    continue
                out, at = [], 0
                for a, e, _, restored in spans:
                    out += [t[at:a], restored]
                    at = e
                fixed = "".join([*out, t[at:]])
                names = sorted({">".join(CHANNELS[c]) for _, _, c, _ in spans})
                rows.append((k, names, len(spans), fixed.count(LOST), float(gain), fixed))
            yield pd.DataFrame(rows, columns=[key, "channels", "damaged", "lost", "gain", "restored"])

    return todo.mapInPandas(decode, f"{key} {docs.schema[key].dataType.simpleString()}, {RESTORED}")
