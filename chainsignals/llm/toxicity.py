"""Toxicity after noisy-channel deobfuscation.

A character language model (trigrams of all documents, counted in Spark) and a channel
of leetspeak, spacing and repetition span a lattice over each suspicious stretch of
text; Viterbi decoding restores the likeliest plain word.  Restored texts are then
scored by what the labelled documents say about their words, with or without an ending.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .logistic import Logistic
from .quality import labelled_sample

#: Labelled rows that evidence and weights are learned from, about, at most.
FIT_ROWS = 20_000
#: Signs and the letters that they may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l"}
_SEPARATORS = ".-_*~·•,/\\"
#: Log probabilities of the channel: a sign for a letter, a separator passed over, and a
#: repeat kept or dropped, for the second of a run and for later ones.
_SIGN, _SKIP, _KEEP, _DROP = -0.7, -0.1, (-0.2, -4.0), (-1.7, -0.02)

_WORD = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
#: Punctuation at the edges of a token; some of it may stand for letters.
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’„…¿¡·•–—€£"
_PLAIN_EDGE = "".join(c for c in _EDGE if c not in LEET)
#: Runs of edge signs next to a word of which every reading is decoded; among more, Viterbi decoding picks where the word begins and ends.
_EDGE_RUNS = 4
_SIGNS, _JOINT_SIGNS = frozenset(LEET), frozenset(_SEPARATORS)
_LETTER = re.compile(r"[^\W\d_]")
#: A doubled sign may be a doubled letter; the channel alone mostly drops the second.
_TWICE = re.compile(f"([{re.escape(''.join(LEET))}])\\1")
_LONG_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
#: Where parts of a token meet; a part stands for itself besides the whole token.
_JOINTS = re.compile(f"(?:[^\\w{re.escape(''.join(LEET))}]|[{re.escape(_SEPARATORS)}])+")
#: Single letters or signs set apart, wholly, before the end or at the beginning of a token.
_SINGLE, _GAP = f"(?:[^\\W\\d_]|[{re.escape(''.join(LEET))}])", f"[{re.escape(_SEPARATORS)}]{{1,2}}"
_SINGLES = re.compile(f"{_SINGLE}(?:{_GAP}{_SINGLE})*")
_TAIL = re.compile(f"(?<=[{re.escape(_SEPARATORS)}]){_SINGLES.pattern}$")
_HEAD = re.compile(f"{_SINGLES.pattern}(?=[{re.escape(_SEPARATORS)}])")
_SPACED = re.compile(f"(?<![^\\W_])(?:{_SINGLE}{_GAP}){{2,}}{_SINGLE}(?![^\\W_])")
#: Log probability of a word's end at a gap of a run of single signs, and how far below the best a way may be.
_BREAK, _MARGIN = -1.0, 7.0
#: Signs of a run that are looked at together, with half of them shared by neighbours.
_STRETCH = 80
#: Longer tokens are not kept in caches.
_CACHED = 64
_STATES = 28
#: Endings of inflected words (fixed values), and how many letters must be left of a word.
ENDINGS, _STEM = ("s", "es", "ed", "er", "ers", "ing", "ly", "ally", "ish", "ic", "ness"), 4


def _class_table() -> np.ndarray:
    """Byte to character class: 0 boundary, 1-26 letters, 27 other letters."""
    table = np.zeros(256, np.int32)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = 27
    return table


_CLASSES = _class_table()


def _classes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(b"  " + text + b" ", np.uint8)
    c = _CLASSES[raw]
    # a letter beyond ASCII is one class, however many bytes it has; runs of boundaries count once
    keep = np.ones(len(c), bool)
    keep[2:] = ~((raw[2:] & 0xC0) == 0x80) & ~((c[2:] == 0) & (c[1:-1] == 0) & (c[:-2] == 0))
    return c[keep]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(trigram, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(_STATES**3, np.int64)
            for text in batch["text"].to_pylist():
                c = _classes(text)
                total += np.bincount(c[:-2] * _STATES**2 + c[1:-1] * _STATES + c[2:], minlength=_STATES**3)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["trigram", "n"])

    texts = docs.select(common.text_bytes().alias("text"))
    return texts.mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Interpolated trigram log probabilities; its size is that of the alphabet cubed."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(_STATES, _STATES, _STATES).astype(float)
        one = (c.sum(axis=(0, 1)) + 1) / (c.sum() + _STATES)
        two = (c.sum(axis=0) + 20 * one) / (c.sum(axis=(0, 2))[:, None] + 20)
        self.log = np.log((c + 20 * two[None]) / (c.sum(axis=2)[:, :, None] + 20)).tolist()


class Deobfuscator:
    """Viterbi decoding of suspicious stretches; a bounded cache holds decoded ones."""

    def __init__(self, model: CharacterModel, max_entries: int = 50_000):
        self.log, self.cache, self.runs, self.max_entries = model.log, {}, {}, max_entries

    @staticmethod
    def _class(letter: str) -> int:
        return ord(letter) - 96 if "a" <= letter <= "z" else 27

    def lattice(self, stretch: str, twice: bool = False) -> list[list[tuple[str, float]]]:
        """Options at each sign: the letters that it may give, or none; with ``twice`` a second sign is kept."""
        options = []
        before, run = "", 0
        for ch in stretch:
            if ch.isspace() or ch in _SEPARATORS:
                options.append([("", _SKIP)])
                continue
            found = [(ch, 0.0)] if ch.isalpha() else [(x, _SIGN) for x in LEET.get(ch, "")]
            run = run + 1 if ch == before else 0
            if run:
                later = run > 1
                kept = [(x, p + _KEEP[later]) for x, p in found]
                found = kept if twice and kept and not later else [*kept, ("", _DROP[later])]
            options.append(found or [("", _SKIP)])
            before = ch
        return options

    def odds(self, word: str) -> float:
        """Log probability of a word between boundaries."""
        a = b = 0
        total = 0.0
        for letter in word:
            c = self._class(letter)
            total += self.log[a][b][c]
            a, b = b, c
        return total + self.log[a][b][0]

    def decode(self, stretch: str, twice: bool = False, edges: tuple[int, int] = (0, 0)) -> str:
        """The likeliest letters; of ``edges``, so many signs at either end, any outer ones may be no part of it."""
        if (known := self.cache.get((stretch, twice, edges))) is not None:
            return known
        log, best = self.log, {(0, 0): (0.0, None)}
        last = len(stretch) - edges[1]
        for i, options in enumerate(self.lattice(stretch, twice)):
            if i < edges[0] or i >= last:
                options = [*options, ("", 0.0)]
            after: dict = {}
            for (a, b), (p, path) in best.items():
                for letter, q in options:
                    if letter:
                        c = self._class(letter)
                        state, score, way = (b, c), p + q + log[a][b][c], (letter, path)
                    else:
                        state, score, way = (a, b), p + q, path
                    if state not in after or score > after[state][0]:
                        after[state] = (score, way)
            best = after
        _, path = max(((p + log[a][b][0], path) for (a, b), (p, path) in best.items()), key=lambda x: x[0])
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        out = "".join(reversed(letters))
        if len(stretch) > _CACHED:
            return out
        if len(self.cache) >= self.max_entries:
            self.cache.clear()
        self.cache[stretch, twice, edges] = out
        return out

    def spaced(self, run: str) -> set[str]:
        """Words of a run of single signs.

        A gap may end a word, at a cost and the language model's odds.  Trigrams alone
        often favour a wrong break ("ai diot"), so every word counts that lies on a way
        through the run within ``_MARGIN`` of the best one; so does the run as one word.
        """
        if (known := self.runs.get(run)) is not None:
            return known
        found = {self.decode(run)}
        if _LETTER.search(run):
            signs = [o for o in self.lattice(run) if o != [("", _SKIP)]]
            half = _STRETCH // 2
            for at in range(0, max(1, len(signs) - half), half):
                last = at + _STRETCH >= len(signs)
                found |= self._between_breaks(signs[at : at + _STRETCH], at == 0, last)
        found = {w for w in found if len(w) > 2}
        if len(run) <= _CACHED:
            if len(self.runs) >= self.max_entries:
                self.runs.clear()
            self.runs[run] = found
        return found

    def _between_breaks(self, signs: list, first: bool, last: bool) -> set[str]:
        """Likely words of some signs; those that touch an end which is not the run's own are left to its neighbour."""
        log, n = self.log, len(signs)
        head: list[dict[int, float]] = [{0: 0.0}, *({} for _ in signs)]
        ways = []  # words as (from, letter before, to, last letter, score, letters)
        for i in range(n):
            for before, score in head[i].items():
                states = {(before, 0): (0.0, "")}
                for j in range(i, n):
                    after: dict = {}
                    gap = _SKIP if j > i else 0.0
                    for (a, b), (p, word) in states.items():
                        for letter, q in signs[j]:
                            if letter:
                                c = self._class(letter)
                                state, total, spelt = (b, c), p + gap + q + log[a][b][c], word + letter
                            else:
                                state, total, spelt = (a, b), p + gap + q, word
                            if state not in after or total > after[state][0]:
                                after[state] = (total, spelt)
                    states = after
                    for (a, b), (p, word) in states.items():
                        if b:
                            total = p + log[a][b][0] + (_BREAK if j + 1 < n else 0.0)
                            ways.append((i, before, j + 1, b, total, word))
                            if score + total > head[j + 1].get(b, -math.inf):
                                head[j + 1][b] = score + total
        tail: list[dict[int, float]] = [*({} for _ in signs), dict.fromkeys(head[n], 0.0)]
        for i, before, j, b, p, _ in reversed(ways):
            rest = tail[j].get(b, -math.inf) + p
            if rest > tail[i].get(before, -math.inf):
                tail[i][before] = rest
        least = max(head[n].values(), default=0.0) - _MARGIN
        return {w for i, before, j, b, p, w in ways if (first or i) and (last or j < n) and head[i][before] + p + tail[j].get(b, -math.inf) >= least}

    def hidden(self, token: str) -> set[str]:
        """Words that a token or a part of it disguises by signs, separators or repetition."""
        core = token.strip(_PLAIN_EDGE)
        if len(core) < 3 or (core.isalpha() and not _THRICE.search(core)) or not _LETTER.search(core):
            return set()
        if _SIGNS.isdisjoint(core) and not _THRICE.search(core):
            found = {self.decode(core)}  # nothing but joints to pass over
        else:
            parts = {core, *_JOINTS.split(core)}
            stretches = {(x, (0, 0)) for part in parts for x in readings(part)} | {e for part in parts for e in with_edges(part)}
            found = {self.decode(x, twice, edges) for x, edges in stretches for twice in ((False, True) if _TWICE.search(x) else (False,))}
        if len(core) > 4:
            found.update(w for m in _SPACED.finditer(core) for w in self.spaced(m[0]))
        return {w for w in found if len(w) > 2}


def _run_starts(signs: str) -> list[int]:
    return [i for i, c in enumerate(signs) if c in LEET and (not i or signs[i - 1] != c)]


def _parted(part: str) -> tuple[str, str, str]:
    """Signs before a part's core, the core, and signs after it, with long repeats cut to three."""
    whole = _LONG_RUN.sub(r"\1\1\1", part.strip(_PLAIN_EDGE))
    inner = whole.lstrip(_EDGE)
    core = inner.rstrip(_EDGE)
    return whole[: len(whole) - len(inner)], core, inner[len(core) :]


def with_edges(part: str) -> list[tuple[str, tuple[int, int]]]:
    """A part with more runs of edge signs than ``readings`` tries, as what to decode with how many edge signs."""
    left, core, right = _parted(part)
    if max(len(_run_starts(left)), len(_run_starts(right))) <= _EDGE_RUNS or not any(map(str.isalpha, core)):
        return []
    return [(left + core + right, (len(left), len(right)))]


def readings(part: str) -> set[str]:
    """The suspicious stretches that a part of a token may be, with edge signs read as letters or stripped."""
    left, core, right = _parted(part)
    if not any(map(str.isalpha, core)):
        return set()
    starts = {0, len(left), *_run_starts(left)[-_EDGE_RUNS:]}
    ends = {0, len(right), *(len(right) - i for i in _run_starts(right[::-1])[-_EDGE_RUNS:])}
    found = {left[i:] + core + right[:j] for i in starts for j in ends}
    return {x for x in found if len(x) > 2 and (not x.isalpha() or _THRICE.search(x))}


class Spacing(dict):
    """Token to how it is made of single signs: 0 not, 1 wholly, 2 at its end, 3 at its beginning, 4 at both."""

    def __init__(self, max_entries: int = 100_000):
        self.max_entries = max_entries

    def __missing__(self, token: str) -> int:
        core = token if len(token) > 1 and token.isalpha() else token.strip(_EDGE)
        if len(token) == 1 or not core:
            kind = 1
        elif len(core) > 1 and (core.isalpha() or _JOINT_SIGNS.isdisjoint(core)):
            kind = 0
        elif singles(token, 1):
            kind = 1
        else:
            kind = 2 * bool(singles(token, 2)) + 3 * bool(singles(token, 3))
            kind = 4 if kind == 5 else kind
        if len(token) <= _CACHED:
            if len(self) >= self.max_entries:
                self.clear()
            self[token] = kind
        return kind


def singles(token: str, kind: int) -> str:
    """The single signs of a token of a kind of ``Spacing``, or none."""
    if kind == 1 and len(token) == 1:
        return token
    whole = token.strip(_PLAIN_EDGE)
    if kind == 1:
        core = whole.strip(_EDGE)
        return next((x for x in (whole, core) if _SINGLES.fullmatch(x)), "")
    m = _TAIL.search(whole) if kind == 2 else _HEAD.match(whole)
    return m[0] if m else ""


_RUN = re.compile(b"[\2\4]?\1+|[\2\4](?=[\3\4])")


def runs_of(tokens: list[str], kinds: bytes) -> list[str]:
    """Runs over tokens of three single signs or more put together; ``kinds`` are those of ``Spacing``."""
    spaced = []
    for m in _RUN.finditer(kinds):
        i, j = m.span()
        after = kinds[j : j + 1] in (b"\3", b"\4")
        if j - i + after > 1:
            run = [singles(t, 2 if k in (2, 4) else 1) for t, k in zip(tokens[i:j], kinds[i:j], strict=True)]
            run += [singles(tokens[j], 3)] if after else []
            if sum(c.isalnum() or c in LEET for part in run for c in part) > 2:
                spaced.append(" ".join(run))
    return spaced


class Reader:
    """Words of a text, plain and restored; facts about a token are cached."""

    def __init__(self, channel: Deobfuscator, max_entries: int = 50_000):
        self.channel, self.cache, self.max_entries = channel, {}, max_entries
        self.spacing = Spacing()

    def token(self, token: str) -> tuple[str, ...]:
        got = self.cache.get(token)
        if got is None:
            words = (token,) if token.isalpha() else tuple(_WORD.findall(token))
            got = (*words, *(self.channel.hidden(token) - set(words)))
            if len(token) > _CACHED:
                return got
            if len(self.cache) >= self.max_entries:
                self.cache.clear()
            self.cache[token] = got
        return got

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        found = {w for t in set(tokens) for w in self.token(t)}
        found.update(w for run in runs_of(tokens, bytes(map(self.spacing.__getitem__, tokens))) for w in self.channel.spaced(run))
        return found


def features_of(word: str) -> list[str]:
    """A word, and what is left of it without an ending."""
    if not word.endswith(ENDINGS):
        return [word]
    return [word, *(word[: -len(e)] for e in ENDINGS if len(word) >= len(e) + _STEM and word.endswith(e))]


def _decode(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def word_evidence(sample: DataFrame, counts: np.ndarray, min_docs: int = 4, min_share: float = 0.5) -> dict[str, tuple]:
    """Per feature the documents by fold and label that hold it, of features that speak for toxicity.

    Most of the documents that hold a feature must be toxic, beyond chance: the lower end
    of the Wilson interval (two standard errors) of their share is above ``min_share``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Deobfuscator(CharacterModel(counts)))
        total: dict[str, list[int]] = {}
        for batch in batches:
            for text, label, fold in zip(*(batch[c].to_pylist() for c in ("text", "label", "fold")), strict=True):
                for f in {f for w in reader.words(_decode(text)) for f in features_of(w)}:
                    total.setdefault(f, [0, 0, 0, 0])[2 * fold + int(label)] += 1
            if len(total) > 200_000:
                yield _evidence_rows(total)
                total = {}
        yield _evidence_rows(total)

    sums = [F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")]
    rows = sample.mapInArrow(run, "feature string, n0 long, t0 long, n1 long, t1 long").groupBy("feature").agg(*sums)
    # their number is bounded by the sample
    toxic, n = F.col("t0") + F.col("t1"), F.col("t0") + F.col("t1") + F.col("n0") + F.col("n1")
    share, z2 = toxic / n, 4.0
    least = (share + z2 / (2 * n) - 2 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    kept = rows.where((toxic >= min_docs) & (least >= min_share))
    return {r.feature: (r.n0, r.t0, r.n1, r.t1) for r in kept.collect()}


def _evidence_rows(total: dict[str, list[int]]) -> pa.RecordBatch:
    columns = list(zip(*total.values(), strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["feature", "n0", "t0", "n1", "t1"])


#: Each sign as its likeliest letter, to see whether pieces of a word may be joined at all.
_LIKELY = str.maketrans({sign: letters[0] for sign, letters in LEET.items()})
#: By how much a joined word must be likelier than its pieces as words.
_JOIN_MARGIN = 3.0
#: Bytes of an entry of a lexicon's facts besides the token's letters, and of all at most.
_FACT, _FACTS = 170, 96 << 20


def _piece(token: str) -> str:
    """A token that may be a piece of a word, without punctuation; an exclamation mark at its end is one."""
    return token.strip(_PLAIN_EDGE).rstrip("!")


class Lexicon:
    """Log odds of features, and the few numbers by which a document is scored."""

    def __init__(self, evidence: dict[str, tuple], folds: tuple[int, ...], sizes: np.ndarray):
        toxic = sum(int(sizes[2 * f + 1]) for f in folds) + 1
        clean = sum(int(sizes[2 * f]) for f in folds) + 1
        self.odds = {}
        for f, row in evidence.items():
            t, n = sum(row[2 * k + 1] for k in folds), sum(row[2 * k] for k in folds)
            self.odds[f] = math.log((t + 0.5 * toxic / (toxic + clean)) / (n + 0.5 * clean / (toxic + clean)) * clean / toxic) if t > 1 else 0.0
        telling = [f for f, x in self.odds.items() if x > 0.5]
        #: What telling words begin with, as far as a space may cut them.
        self.starts = {f[:k] for f in telling for k in range(1, len(f) + 1)}
        #: The first letters of telling words; other words need no look.
        self.heads = {f[:_STEM] for f in telling}
        self.letters = [frozenset(h) for h in self.heads]
        self.forget()

    def weight(self, word: str) -> float:
        """The greatest log odds of a word's features; 0 if none is telling."""
        if word[:_STEM] not in self.heads:
            return 0.0
        return max([self.odds.get(f, 0.0) for f in features_of(word)])

    def forget(self) -> None:
        #: A token to its kind of ``Spacing``, and from bit 3 on the place of what else is to say of it, 0 for nothing.
        self.facts: dict[str, int] = {}
        #: (word, weight) of each telling word of a token, and its letters if it may be a piece of a word.
        self.details: list[tuple[tuple, str]] = [((), "")]
        self.size = 0

    def fact(self, token: str, reader: Reader) -> int:
        """What is to say of a token that is not known yet."""
        core = token.strip(_PLAIN_EDGE)
        fact = 0
        # a plain word, maybe with punctuation, disguises nothing and begins nothing
        if not core.isalpha() or len(core) < 2 or core[:_STEM] in self.heads or core in self.starts or _THRICE.search(core):
            fact = reader.spacing[token]
            telling = ()
            # no reading of a token has other letters than its signs can stand for
            letters = {x for c in set(token) for x in LEET.get(c, c)}
            if any(map(letters.issuperset, self.letters)):
                telling = tuple((w, x) for w in reader.token(token) if (x := self.weight(w)) > 0.5)
            piece = _piece(token).translate(_LIKELY)
            if telling or piece != core or piece in self.starts:
                fact |= len(self.details) << 3
                self.details.append((telling, piece if piece.isalpha() else ""))
                self.size += _FACT
        self.facts[token] = fact
        self.size += _FACT + len(token)
        return fact

    def piece(self, token: str) -> str:
        place = self.facts[token] >> 3
        return self.details[place][1] if place else token.strip(_PLAIN_EDGE)

    def joined(self, tokens: list[str], i: int, reader: Reader) -> str:
        """The telling word that a space cut at token ``i``, or none.

        A space may vanish at the channel's cost for a separator, if the language model
        finds the word clearly likelier than the pieces as words of their own.  Pieces are
        added as long as they are the beginning of a telling word.
        """
        channel = reader.channel
        word = self.piece(tokens[i])
        for n, at in enumerate(range(i + 1, len(tokens)), start=1):
            piece = self.piece(tokens[at])
            if not piece.isalpha():
                return ""
            word += piece
            if self.weight(word) > 0.5:
                pieces = [_piece(t) for t in tokens[i : i + n + 1]]
                whole = channel.decode(" ".join(pieces))
                apart = sum(channel.odds(p.translate(_LIKELY)) for p in pieces) + n * _BREAK
                if self.weight(whole) > 0.5 and channel.odds(whole) + n * _SKIP >= apart + _JOIN_MARGIN:
                    return whole
            if word not in self.starts:
                return ""
        return ""

    def document(self, text: str, reader: Reader) -> tuple[float, ...]:
        """Weights of the two most telling words, how many tell much, and the length."""
        if self.size > _FACTS:
            self.forget()
        tokens = text.lower().split()
        facts = list(map(self.facts.get, tokens))
        if None in facts:
            known = self.facts
            facts = [(known[t] if t in known else self.fact(t, reader)) if f is None else f for t, f in zip(tokens, facts, strict=True)]
        facts = np.array(facts, np.int64)
        places, found = facts >> 3, {}
        begins = set()
        for place in np.unique(places[places > 0]).tolist():
            telling, piece = self.details[place]
            found.update(telling)
            if not telling and piece in self.starts:
                begins.add(place)
        for run in runs_of(tokens, (facts & 7).astype(np.uint8).tobytes()):
            found.update((w, x) for w in reader.channel.spaced(run) if (x := self.weight(w)) > 0.5)
        if begins:
            for i in np.flatnonzero(np.isin(places, list(begins))).tolist():
                if w := self.joined(tokens, i, reader):
                    found[w] = self.weight(w)
        top = [*sorted(found.values(), reverse=True)[:2], 0.0, 0.0]
        return (top[0], top[1], math.log1p(sum(x > 2 for x in found.values())), math.log1p(len(tokens)))


class ToxicityModel:
    """What tasks need for scoring: trigram counts, evidence, and four weights."""

    def __init__(self, counts: np.ndarray, evidence: dict[str, tuple], sizes: np.ndarray, weights: Logistic):
        self.counts, self.evidence, self.sizes, self.weights = counts, evidence, sizes, weights

    def scorer(self):
        reader, lexicon = Reader(Deobfuscator(CharacterModel(self.counts))), Lexicon(self.evidence, (0, 1), self.sizes)

        def score(texts: list[bytes]) -> np.ndarray:
            rows = [lexicon.document(_decode(t), reader) for t in texts]
            z = self.weights.logit(np.array(rows, float).reshape(-1, 4))
            return 1 / (1 + np.exp(-z))

        return score


def fit(docs: DataFrame, labels: DataFrame, scratch: common.Scratch, rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from labelled documents whose crc32 of the id as text is not a multiple of 5.

    Word evidence for one half of the sample comes from the other half while the weights
    are fitted, so that a word seen once is not believed.
    """
    counts = np.zeros(_STATES**3, np.int64)
    for r in trigram_counts(docs).collect():  # at most 28^3 rows
        counts[r.trigram] = r.n
    learnable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    sample = scratch.table(labelled_sample(docs, labels, "toxic", rows, learnable).withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)).cast("int")), "labelled")
    sizes = np.zeros(4, np.int64)
    for r in sample.groupBy("fold", "label").agg(F.count("*").alias("n")).collect():
        sizes[2 * r.fold + int(r.label)] = r.n
    evidence = word_evidence(sample, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Deobfuscator(CharacterModel(counts)))
        lexicons = [Lexicon(evidence, (1 - fold,), sizes) for fold in (0, 1)]
        for batch in batches:
            x = [lexicons[f].document(_decode(t), reader) for t, f in zip(batch["text"].to_pylist(), batch["fold"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    found = sample.mapInArrow(run, "label double, x array<double>").collect()  # four numbers for each row of the sample
    x = np.array([r.x for r in found], float).reshape(-1, 4)
    return ToxicityModel(counts, evidence, sizes, Logistic(x, np.array([r.label for r in found], float)))


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Only the text is scored; null and empty texts get the score of no words, long ones are
    read whole.  Rows with equal texts get equal scores, and a score of exactly 0.5 counts
    as toxic.  A null doc_id is not held out.  An empty table gives no rows.  Only doc_id
    and text are read, so other columns may have any name.
    """
    with common.scratch(docs.sparkSession) as scratch, common.small_batches(docs.sparkSession):
        return _score(docs, fit(docs, labels, scratch, rows))


def _score(docs: DataFrame, model: ToxicityModel) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(score(part["text"].to_pylist()), pa.float64())], ["doc_id", "held_out", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), common.text_bytes().alias("text"))
    scored = common.materialize(texts.mapInArrow(run, "doc_id long, held_out boolean, score double"), "toxicity")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
