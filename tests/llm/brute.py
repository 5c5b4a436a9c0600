"""The operators once more, from their definitions, over plain lists and dicts."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def rows_of(duck, sql):
    return duck.execute(sql).fetchall()


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- language models ---------------------------------------------------------------------------------

START, SEPARATOR = 1, 0
LENGTHS = [16, 32, 64, 128, 256, 512, 1024, 4096, 2**62]


def classes(text):
    """Letters in lower case, and one separator for every run of anything else."""
    out = []
    for c in text or "":
        low = c.lower()
        if not c.isalpha():
            x = SEPARATOR
        elif len(low) == 1 and ord(low) < 0x10000:
            x = ord(low)
        else:
            x = ord(c) if ord(c) < 0x10000 else 0xE000 + ord(c) % 0x1900
        if x != SEPARATOR or not out or out[-1] != SEPARATOR:
            out.append(x)
    return out


def grams(text):
    padded = [START] * 3 + classes(text)
    return [tuple(padded[i : i + 4]) for i in range(len(padded) - 3)]


class KneserNey:
    def __init__(self, counts, vocabulary):
        self.vocabulary, self.counts = vocabulary, {4: counts}
        for order in (3, 2, 1):
            self.counts[order] = Counter(g[1:] for g in self.counts[order + 1])
        self.total, self.kinds, self.discount = {}, {}, {}
        for order, n in self.counts.items():
            self.total[order], self.kinds[order] = Counter(), Counter()
            for g, k in n.items():
                self.total[order][g[:-1]] += k
                self.kinds[order][g[:-1]] += 1
            once, twice = (sum(k == x for k in n.values()) for x in (1, 2))
            self.discount[order] = once / (once + 2 * twice) if once and twice else 0.75
        self.known = {}

    def probability(self, gram):
        if gram in self.known:
            return self.known[gram]
        order = len(gram)
        if not order:
            return 1 / self.vocabulary
        context, lower = gram[:-1], self.probability(gram[1:])
        total, d = self.total[order][context], self.discount[order]
        p = lower
        if total:
            p = max(self.counts[order][gram] - d, 0) / total + d * self.kinds[order][context] / total * lower
        self.known[gram] = p
        return p


class Languages:
    """Models of labelled rows (lang, text), with the calibration of rejection."""

    def __init__(self, rows, reject_z=8.0):
        counts = defaultdict(Counter)
        rows = [(lang, text) for lang, text in rows if lang is not None and text is not None]
        for lang, text in rows:
            counts[lang].update(grams(text))
        self.langs = sorted(x for x in counts if counts[x])
        seen = {g[-1] for x in self.langs for g in counts[x]}
        self.models = [KneserNey(counts[x], len(seen) + 1) for x in self.langs]
        self.chance = [math.log(max(1, len({g[-1] for g in counts[x]}))) for x in self.langs]
        bins = defaultdict(list)
        for _, text in rows:
            h, n, letters = self.entropies(text)
            if letters:
                best = h.index(min(h))
                bins[best, self.bin(n)].append(min(h))
        self.limit = {
            k: np.mean(v) + reject_z * max(np.std(v), 0.02) for k, v in bins.items() if len(v) >= 20
        }

    @staticmethod
    def bin(n):
        return next(i for i, x in enumerate(LENGTHS) if n <= x)

    def entropies(self, text):
        all_grams = grams(text)
        n = len(all_grams)
        h = [-sum(math.log(m.probability(g)) for g in all_grams) / max(n, 1) for m in self.models]
        return h, n, sum(g[-1] != SEPARATOR for g in all_grams)

    def judge(self, text):
        """Language, score, entropy and whether the document is rejected."""
        h, n, letters = self.entropies(text)
        if not letters:
            return "und", 0.0, 0.0, True
        low = min(h)
        best = h.index(low)
        score = 1 / sum(math.exp(-(x - low) * min(n, 50)) for x in h)
        limit = self.limit.get((best, self.bin(n)), -math.inf)
        return self.langs[best], score, low, low > max(limit, self.chance[best])


def held_out(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


# --- the other stages of the pipeline ----------------------------------------------------------------


def dedup_lines(docs):
    """Texts by document without the lines that a document with a smaller id holds."""
    blank = " \t\n\v\f\r"

    def key(line):
        return lower_ascii(line.strip(blank))

    holders = defaultdict(set)
    for doc_id, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc_id)
    out = {}
    for doc_id, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == doc_id]
        out[doc_id] = "\n".join(kept)
    return out


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def components(docs, percent=80):
    """The least id that links reach, by document."""
    sets = {i: shingles(t) for i, t in docs.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] += 1
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in docs}


def contaminated(docs, items, window=10):
    """Documents that hold a window of an item."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted = defaultdict(set)
    for text in items:
        w = word.findall(lower_ascii(text))
        n = min(len(w), window)
        if n:
            wanted[n] |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for doc_id, text in docs.items():
        w = word.findall(lower_ascii(text))
        if any(tuple(w[i : i + n]) in x for n, x in wanted.items() for i in range(len(w) - n + 1)):
            out.add(doc_id)
    return out


# --- toxicity ----------------------------------------------------------------------------------------


def best_segments(scores):
    """All maximal-scoring segments by their definition: the best one, then left and right of it."""

    total = [0, *itertools.accumulate(scores)]

    def within(a, b):
        spans = ((i, j) for i in range(a, b) for j in range(i + 1, b + 1))
        top = max(((total[j] - total[i], i - j, i, j) for i, j in spans), default=(0,))
        if top[0] <= 0:
            return []
        _, _, i, j = top
        return [*within(a, i), (i, j, top[0]), *within(j, b)]

    return within(0, len(scores))
