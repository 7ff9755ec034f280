"""Defective question-reply pairs: a multi-label linear classifier on hashed n-grams and pair features.

For every label (empty, echo, refusal, other_language, truncated) a logistic regression scores a pair. All labels share
one feature space, and each looks only at what can tell it: the layout of the reply for `empty`, its overlap with the
question for `echo`, hashed word n-grams for `refusal`, the language field's agreement for `other_language`, the reply's
end for `truncated`. So words that training has not seen weigh nothing, and a reply in such words is sound unless its
overlap, its language or its end says otherwise.

The regressions are trained on the driver from a bounded sample of sound pairs (`sample_pairs` reference replies with
their questions) and on defects made from them: replies cut off, questions copied, replies swapped between languages,
refusals and empty strings. The first model then labels a bounded sample of given replies (`sample_heard`), and those it
is sure of join the training rows. Each label's threshold is calibrated on held-out made pairs. A defective pair gets the
first label, in the order above, whose score reaches its threshold.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.once import computed
from cadenza.functions.text import is_silence
from cadenza.llm import pairdata as D
from cadenza.llm.langid import Field, seed_field, train
from cadenza.llm.languages import LANGUAGES, LEXICON, NAMES, SEED

LABELS = ("empty", "echo", "refusal", "other_language", "truncated")

# ---- text --------------------------------------------------------------------------------------------------

_CJK = "぀-ヿ㐀-鿿"
_TOKEN = re.compile(rf"\d+(?:[.,:]\d+)*|[{_CJK}]|[^\W\d_{_CJK}]+(?:['’][^\W\d_{_CJK}]+)*")
_CONTROL = re.compile(r"<\|?/?[A-Za-z_]++\|?>|\[/?(?:PAD|UNK|EOS|BOS|CLS|SEP|MASK|EMPTY|INST|END)\]|<\|[^|<>]++\|>", re.I)
_NULLS = frozenset(D.NULLS)
_QUOTED = re.compile(r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\"[^\"\n]*\"|「[^「」]*」|『[^『』]*』|\([^()\n]*\)|（[^（）]*）")
_END = re.compile(r"[.!?。！？…][\"'”’»)\]」』*_\s\U0001F000-\U0001FAFF☀-➿️]*$")
_PAIRS = (("(", ")"), ("[", "]"), ("{", "}"), ("（", "）"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"))
_VERB = re.compile(r"\b(?:answer|reply|respond|speak|write|say|tell|talk|explain|dime|dímelo|dites|dis|antwort\w*|schreib\w*|sprich|sag\w*|répond\w*|écri\w*|parle\w*|respond\w*|contest\w*|escrib\w*|habla\w*|rispond\w*|antwoord\w*|ответ\w*)\b|回答|回复|答|说|讲|答えて", re.I)
_NAME = {n: k for k, v in NAMES.items() for n in v.split() if len(n) > 3 or n > "⺀"}
_NAMES = re.compile("|".join(rf"\b{re.escape(n)}\w{{0,2}}\b" if n < "⺀" else re.escape(n) for n in sorted(_NAME, key=len, reverse=True)), re.I)


@lru_cache(maxsize=50_000)
def tokens(text: str) -> tuple[str, ...]:
    """Words, numbers and single ideographs in lower case."""
    return tuple(_TOKEN.findall(unicodedata.normalize("NFKC", text).casefold().replace("’", "'")))


def units(toks: tuple[str, ...]) -> list[str]:
    """Words, and pairs of neighbouring ideographs: what coverage is counted in."""
    out = []
    for i, t in enumerate(toks):
        if t < "⺀":
            out.append(t)
        elif i + 1 < len(toks) and toks[i + 1] >= "⺀":
            out.append(t + toks[i + 1])
        elif not (i and toks[i - 1] >= "⺀"):
            out.append(t)
    return out


@lru_cache(maxsize=20_000)
def asked_language(question: str) -> int | None:
    """The language that a question asks the reply to be in, if it names one."""
    if not _VERB.search(question):
        return None
    m = _NAMES.search(question)
    if not m:
        return None
    w = m.group().casefold()
    k = next((_NAME[w[:n]] for n in range(len(w), 1, -1) if w[:n] in _NAME), None)
    return LANGUAGES.index(k) if k else None


def _without(p: tuple[str, ...], q: tuple[str, ...]) -> tuple[int, list[str]]:
    """How often q occurs in p as a whole, and the tokens after its last occurrence (or p)."""
    n, i, rest, count = len(q), 0, p, 0
    while n and i + n <= len(p):
        if p[i:i + n] == q:
            count, i, rest = count + 1, i + n, p[i + n:]
        else:
            i += 1
    return count, list(rest)


_bin = lambda x, cuts: bisect_left(cuts, x)

# ---- features ----------------------------------------------------------------------------------------------


@dataclass
class Words:
    """Words of the sample, their beginnings, and how often each ends a sentence: 1 seldom seen and never at an end, 2 often seen
    and never at an end, 3 seldom at an end, 4 often; words that are not in it count as 0."""

    known: frozenset[str]
    begins: frozenset[str] = field(default_factory=frozenset)
    final: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, texts: list[str], least: int = 2) -> Words:
        n = Counter(t for x in texts for t in set(tokens(x)) if t < "⺀")
        known = frozenset(t for t, c in n.items() if c >= least)
        seen, last = Counter(t for x in texts for t in tokens(x)), Counter(t[-1] for x in texts for s in _SENTENCE.split(x) if (t := tokens(s)))
        final = {t: (1 if c < 4 else 2) if not last[t] else 3 if last[t] < 0.05 * c else 4 for t, c in seen.items()}
        return cls(known, frozenset(t[:i] for t in known for i in range(1, len(t))), final)


_SENTENCE = re.compile(r"[.!?。！？…\n]+(?=\s|$)|[。！？]+")
_STOP = frozenset(w for v in LEXICON.values() for w in v)

# Families of pair features: name, number of values, labels that look at them.
_FAMILIES = (
    ("one", 1, "empty echo refusal other_language truncated"), ("nothing", 2, "empty other_language refusal truncated"), ("length", 10, "empty echo refusal truncated"), ("null", 4, "empty"),
    ("cover", 64, "echo"), ("cover_q", 56, "echo"), ("core", 392, "echo"), ("lead", 392, "echo"), ("copies", 21, "echo"), ("fresh", 48, "echo"), ("whole", 112, "echo"), ("same", 2, "echo"),
    ("agree", 16, "other_language"), ("agree_n", 30, "other_language"),
    ("open", 4, "truncated"), ("item", 2, "truncated"), ("listed", 32, "truncated"), ("comma", 2, "truncated"), ("end", 12, "truncated"), ("end_n", 48, "truncated"), ("open_end", 24, "truncated"), ("final", 40, "truncated"), ("final_end", 60, "truncated"),
)
_AT, _n = {}, 0
for _name, _size, _ in _FAMILIES:
    _AT[_name] = _n
    _n += _size
WORDS_AT, TAIL_AT, HASHED = _n, _n + (1 << 16), 1 << 16  # then come n-grams anywhere or at the beginning (for refusals), and at the end (for cut replies)
SIZE = TAIL_AT + HASHED
LOOKS = np.zeros((len(LABELS), SIZE), bool)
for _name, _size, _labels in _FAMILIES:
    for _k in _labels.split():
        LOOKS[LABELS.index(_k), _AT[_name]:_AT[_name] + _size] = True
LOOKS[LABELS.index("refusal"), WORDS_AT:TAIL_AT] = True
LOOKS[LABELS.index("truncated"), TAIL_AT:] = True
_STATES = ("cjk", "number", "stop", "known", "begun", "new")


@lru_cache(maxsize=50_000)
def _question(q: str) -> tuple:
    t = tokens(q)
    u = units(t)
    return t, u, frozenset(u), Counter(u)


@lru_cache(maxsize=50_000)
def _reply(p: str) -> tuple:
    """What is told of a reply alone: its tokens, and the look of its end."""
    t = tokens(_CONTROL.sub(" ", p))
    s = p.rstrip()
    ended = bool(_END.search(s))
    last_line = s.rsplit("\n", 1)[-1].strip()
    open_ = any(s.count(a) > s.count(b) for a, b in _PAIRS) or s.count('"') % 2 == 1
    number = re.search(r"(?:^|[\s。.!?！？])(\d{1,3})[.)、]$", s)  # an item of a list that has a number only
    item = last_line in ("-", "*", "•") and "\n" in s or bool(
        number and (last_line == number.group(1) + s[-1:] or re.search(rf"(?:^|[\s。.!?！？]){int(number.group(1)) - 1}[.)、]", s[:number.start()])))
    comma = s[-1:] in "，,;；:：-–—、/&+(（“«「" and s != ""
    listed = bool(re.search(r"(?m)^\s*1[.)、]\s*\S[^\n]*\n\s*2[.)、]", s))
    return t, units(t), ended, open_, bool(item), comma, listed, bool(_CONTROL.search(p))


def structure(q: str, p: str, agree: float, words: Words, strange: bool = False) -> list[int]:
    """The pair features of a question and a reply; `strange` sees its last word as one that nobody knows."""
    qt, qu, qs, qc = _question(q)
    pt, pu, ended, open_, item, comma, listed, control = _reply(p)
    n = len(pt)
    real = [t for t in pt if t not in _NULLS and t not in ("n", "a")]
    nothing = not pt or (n <= 2 and not real)
    f = [0, _AT["nothing"] + nothing, _AT["length"] + _bin(n, (0, 1, 2, 3, 5, 8, 12, 20, 40)), _AT["null"] + 2 * (n <= 2 and n > len(real)) + control]
    # overlap with the question
    inside = [u in qs for u in pu]
    cov_p = sum(inside) / len(pu) if pu else 0.0
    cov_q = sum((Counter(pu) & qc).values()) / len(qu) if qu and True in inside else 0.0
    lead = inside.index(True) if True in inside else len(pu)
    tail = inside[::-1].index(True) if True in inside else len(pu)
    copies, rest = _without(pt, qt) if cov_q > 0.9 else (0, pt)
    fresh = len(set(units(tuple(rest))) - qs) if copies else len(set(pu) - qs)
    cuts = (0.2, 0.4, 0.55, 0.7, 0.8, 0.9, 0.99)
    c1, c2 = _bin(cov_p, cuts), _bin(cov_q, cuts)
    core = len(pu) - lead - tail
    c3 = _bin(sum(inside) / core if core > 0 else 0.0, (0.3, 0.5, 0.7, 0.8, 0.9, 0.99))
    t3, l3, r3 = _bin(tail, (0, 1, 2, 3, 5, 8)), _bin(lead, (0, 1, 2, 3, 5, 8)), _bin(len(rest), (0, 1, 2, 3, 5, 8))
    f += [_AT["cover"] + c1 * 8 + c2, _AT["cover_q"] + c2 * 7 + t3, _AT["core"] + (c3 * 8 + c2) * 7 + t3, _AT["lead"] + (l3 * 7 + t3) * 7 + c3, _AT["copies"] + min(copies, 2) * 7 + (r3 if copies else 0),
          _AT["fresh"] + _bin(fresh, (0, 1, 2, 3, 5)) * 8 + c2, _AT["whole"] + ((copies > 0) * 7 + (r3 if copies else t3)) * 7 + l3, _AT["same"] + (pt == qt)]
    # language
    f += [_AT["agree"] + 2 * i + (agree > c) for i, c in enumerate((0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9))]  # by thresholds, so that what lies between seen values is known too
    f += [_AT["agree_n"] + (2 * i + (agree > c)) * 5 + _bin(n, (1, 2, 4, 8)) for i, c in enumerate((0.1, 0.25, 0.5))]
    # end of the reply
    last = pt[-1] if pt else ""
    state = 0 if last >= "⺀" else 1 if last[:1].isdigit() else 2 if last in _STOP else 3 if last in words.known else 4 if last in words.begins else 5
    if strange and state in (3, 4):
        state = 5
    k = not (ended and not item)
    f += [_AT["open"] + open_ * 2 + k, _AT["item"] + item, _AT["listed"] + (((listed * 2 + item) * 2 + open_) * 2 + comma) * 2 + (state == 4), _AT["comma"] + comma, _AT["end"] + state * 2 + k,
          _AT["end_n"] + (state * 2 + k) * 4 + _bin(n, (1, 3, 6)), _AT["open_end"] + (open_ * 6 + state) * 2 + k]
    final = 0 if strange else words.final.get("#" if last[:1].isdigit() else last, 0)
    f += [_AT["final"] + (final * 2 + k) * 4 + _bin(n, (1, 3, 6)), _AT["final_end"] + (final * 6 + state) * 2 + k]
    return f


_hashes: dict[str, int] = {}


def _hash(t: str) -> int:
    h = _hashes.get(t)
    if h is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        h = _hashes[t] = zlib.crc32(b"#" if t[0].isdigit() else t.encode("utf-8", "surrogatepass"))  # which number it is says nothing
    return h


def lexical(replies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the hashed n-grams of replies, each at most once a row."""
    toks = [_reply(p)[0] for p in replies]
    ended = np.array([_reply(p)[2] and not _reply(p)[4] for p in replies], "uint64")
    n = np.fromiter(map(len, toks), "int64", len(toks))
    h = np.fromiter((_hash(t) for ts in toks for t in ts), "uint64", int(n.sum()))
    row = np.repeat(np.arange(len(toks)), n)
    start = np.cumsum(n) - n
    grams = [(h * np.uint64(2654435761)) & np.uint64(0xFFFFFFFFFFFF)]
    for i in range(1, 5):  # of growing length; gram i at t ends at t + i
        prev = grams[-1]
        grams.append(((prev[:-1] if len(prev) else prev) * np.uint64(1000003) + h[i:] * np.uint64(2246822519)) & np.uint64(0xFFFFFFFFFFFF) if len(prev) > 1 else prev[:0])
    fold = lambda x, salt: (((x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("int64")
    rows, feats = [], []
    for i in range(3):
        g = grams[i]
        ok = row[:len(g)] == row[i:] if i else np.ones(len(g), bool)
        rows.append(row[:len(g)][ok])
        feats.append(WORDS_AT + fold(g[ok], i))
        whole = np.flatnonzero(n > i)
        rows.append(whole)
        feats.append(WORDS_AT + fold(g[start[whole]], 10 + i))
    for i in (0, 1, 2, 4):
        whole = np.flatnonzero(n > i)
        rows.append(whole)
        feats.append(TAIL_AT + fold(grams[i][start[whole] + n[whole] - 1 - i] * np.uint64(2) + ended[whole], 20 + i))
    key = np.unique(np.concatenate(rows) * SIZE + np.concatenate(feats))
    return key // SIZE, key % SIZE


# ---- the model ---------------------------------------------------------------------------------------------


@dataclass
class PairModel:
    weights: np.ndarray  # labels x SIZE
    thresholds: np.ndarray
    language: Field
    words: Words

    def languages(self, texts: list[str]) -> np.ndarray:
        """Distribution over languages of each text, without quoted parts unless there is nothing else."""
        bare = [_merged(tokens(_QUOTED.sub(" ", t)) or tokens(t)) for t in texts]
        out = np.full((len(texts), len(LANGUAGES)), 1 / len(LANGUAGES))
        full = [i for i, w in enumerate(bare) if w]
        if full:
            n = np.array([len(bare[i]) for i in full])
            g = np.concatenate(self.language.marginals([bare[i] for i in full]))
            size = np.fromiter((len(w) for i in full for w in bare[i]), "float64", int(n.sum()))
            at = np.cumsum(n) - n
            out[full] = np.add.reduceat(g * size[:, None], at) / np.add.reduceat(size, at)[:, None]
        return out

    def agreement(self, questions: list[str], replies: list[str]) -> np.ndarray:
        """Probability that the reply has the language wanted by its question; 1 if it has no words."""
        known = {t: i for i, t in enumerate(dict.fromkeys([*questions, *replies]))}
        lang = self.languages(list(known))
        want = np.array([lang[known[q]] if (a := asked_language(q)) is None else np.eye(len(LANGUAGES))[a] for q in questions]).reshape(-1, len(LANGUAGES))
        has = np.array([lang[known[p]] for p in replies]).reshape(-1, len(LANGUAGES))
        worded = np.array([any(not t[:1].isdigit() for t in tokens(p)) for p in replies], bool)
        return np.where(worded, (want * has).sum(1), 1.0)

    def rows(self, questions: list[str], replies: list[str], agree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of pairs, in order of rows."""
        agree = self.agreement(questions, replies) if agree is None else agree
        dense = [structure(q, p, a, self.words) for q, p, a in zip(questions, replies, agree)]
        return _joined(dense, *lexical(replies))

    def scores(self, questions: list[str], replies: list[str]) -> np.ndarray:
        if not questions:
            return np.zeros((0, len(LABELS)))
        row, feat = self.rows(questions, replies)
        return _sigmoid(np.add.reduceat(self.weights[:, feat], np.flatnonzero(np.diff(row, prepend=-1)), axis=1).T)

    def label(self, questions: list[str], replies: list[str]) -> list[str | None]:
        """The defect of each pair or None; pairs that are given more than once are scored once."""
        index: dict[tuple[str, str], int] = {}
        at = [index.setdefault(pair, len(index)) for pair in zip(questions, replies)]
        hit = self.scores([q for q, _ in index], [p for _, p in index]) >= self.thresholds
        names = [LABELS[int(h.argmax())] if h.any() else None for h in hit]
        return [names[i] for i in at]


_sigmoid = lambda z: 1 / (1 + np.exp(-z))


def _joined(dense: list[list[int]], row: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.concatenate([np.repeat(np.arange(len(dense)), [len(d) for d in dense]), row])
    feats = np.concatenate([np.fromiter((x for d in dense for x in d), "int64"), feat])
    order = np.argsort(rows, kind="stable")
    return rows[order], feats[order]


def _merged(toks: tuple[str, ...]) -> list[str]:
    """Tokens as the language model knows them: no numbers, ideographs of one script in runs of up to four."""
    out: list[str] = []
    kind = None
    for t in toks:
        if t[0].isdigit():
            kind = None
            continue
        k = None if t < "⺀" else "kana" if t <= "ヿ" else "han"
        if k and k == kind and len(out[-1]) < 4:
            out[-1] += t
        else:
            out.append(t)
        kind = k
    return out


def _phrases(replies: list[str], least: int = 4) -> tuple[list[str], set[tuple[str, ...]]]:
    """Beginnings of replies that many different words follow: complete phrases, as text and as tokens."""
    after: dict[tuple[str, ...], set[str]] = defaultdict(set)
    shown: dict[tuple[str, ...], str] = {}
    for r in replies:
        spans = [(m.end(), m.group()) for m in _TOKEN.finditer(r)]
        low = [t.casefold() for _, t in spans]
        for i in range(3, len(spans)):
            key = tuple(low[:i])
            after[key].add("#" if low[i][0].isdigit() else low[i])
            shown.setdefault(key, r[:spans[i - 1][0]])
    full = {k for k, v in after.items() if len(v) >= least and (k[-1] >= "⺀" and len(k) >= 4 or k[-1] < "⺀" and k[-1] not in _STOP)}
    return [shown[k] for k in sorted(full)], full


def _cut(r: str, full: set, rng: np.random.Generator) -> str | None:
    """The reply broken off inside a phrase: after a word, inside one, behind an opened bracket or a comma."""
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(r)]
    if len(spans) < 4:
        return None
    low = [r[a:b].casefold() for a, b in spans]
    i = int(rng.integers(2, len(spans) - 1))
    style = rng.random()
    a, b = spans[i]
    if style < 0.3:
        if b - a > 3:
            return r[:a + int(rng.integers(2, b - a - 1))]  # inside a word
        style = 0.4
    if style < 0.55:
        whole = tuple(low[:i]) in full or (low[i - 1] < "⺀" and i > 3 and tuple(low[1:i]) in full)
        return None if whole or r[spans[i - 1][1]:a].strip() else r[:spans[i - 1][1]]  # after a word
    if style < 0.75:
        x, y = spans[min(i, len(spans) - 2)]
        j = min(len(spans) - 1, i + int(rng.integers(1, 3)))
        return r[:x] + str(rng.choice(["\"", "(", "“", "«"])) + r[x:spans[j - 1][1]]
    return r[:spans[i - 1][1]] + str(rng.choice([",", ";", ":", " -", "，", "、"] if low[i - 1] < "⺀" else ["，", "、", "：", "；"]))


def _echo(q: str, lang: str, rng: np.random.Generator) -> str:
    w = q.split(" ") if " " in q.strip() else list(q)
    kind = int(rng.integers(0, 10))
    bare = q.rstrip(" .!?。！？")
    if kind == 0:
        return q
    if kind == 1:
        return bare + str(rng.choice(["", ".", "?", "!", "...", "……"]))
    if kind == 2:
        return str(rng.choice(["\"{}\"", "«{}»", "“{}”", "> {}", "*{}*"])).format(q)
    if kind in (3, 4):
        return str(rng.choice(D.INTRO.get(lang, D.INTRO["en"]))).format(q=q)
    if kind == 5:
        return q + " " + q
    if kind == 6:  # without its beginning
        n = max(1, int(len(w) * rng.uniform(0.08, 0.25)))
        return (" " if " " in q else "").join(w[n:]) if len(w) > 4 else q
    if kind == 7:  # without its end
        n = max(1, int(len(w) * rng.uniform(0.08, 0.3)))
        return (" " if " " in q else "").join(w[:-n]) + str(rng.choice(["", "...", "."])) if len(w) > 4 else q
    if kind == 8 and len(w) > 3:  # neighbours swapped
        i = int(rng.integers(0, len(w) - 1))
        w[i], w[i + 1] = w[i + 1], w[i]
        return (" " if " " in q else "").join(w)
    if len(w) > 4:
        del w[int(rng.integers(0, len(w)))]
    x = (" " if " " in q else "").join(w)
    return x.lower() if rng.random() < 0.5 else x


def made_pairs(sound: list[tuple[str, str]], lang_of, rng: np.random.Generator) -> list[tuple[str, str, str | None]]:
    """(question, reply, defect or None) for training, from sound pairs. `lang_of` names the language of texts."""
    out: list[tuple[str, str, str | None]] = []
    langs = [LANGUAGES[i] for i in lang_of([p for _, p in sound])]
    # rarer languages are used more than once, so that their phrases weigh enough
    share = Counter(langs)
    times = [min(2, max(1, round(max(share.values()) / (2 * share[k])))) if share[k] >= 10 else 1 for k in langs]
    pick = lambda x: x[int(rng.integers(len(x)))]
    own = lambda d, k: d.get(k, d["en"])
    asked_in = defaultdict(list)
    for (q, _), k in zip(sound, langs):
        asked_in[k].append(q)
    # statements from other fields, as replies to questions of their language
    plain = [((pick(asked_in[k]), x), k) for k in sorted(share) if share[k] >= 10 for x in [*D.FACTS.get(k, ()), *SEED[k]] for _ in range(3)]
    pairs = [(x, k) for x, k, n in zip(sound, langs, times) for _ in range(n)]
    by = defaultdict(list)
    for (_, p), k in pairs:
        by[k].append(p)
    phrases = {k: _phrases(v) for k, v in by.items()}
    for (_, p), k in plain:
        by[k].append(p)
    foreign = {k: [" ".join(w[:3]) for o in SEED if o != k for x in SEED[o] if len(w := x.split(" ")) > 3] for k in by}
    lists = {k: v[0] for k, v in phrases.items()}
    marks = ["!", "", "", ".", " 🙂"]
    low = lambda x: x[:1].lower() + x[1:]

    def refusal(k):
        opening, decline, what, end, whole = own(D.REFUSAL, k)
        kind = rng.random()
        if kind < 0.4:
            x = pick(whole) if kind < 0.15 else "".join(map(pick, pick(own(D.REFUSAL_PARTS, k))))
            x = pick(opening) + low(x) if rng.random() < 0.3 else x
        else:  # now and then what is declined is what somebody is told to do
            x = pick(opening) + pick(decline) + (pick(what) if kind < 0.85 else low(pick(by[k])).rstrip(" .。")) + pick(end)
        x = x[:1].upper() + x[1:]
        return x.rstrip(".。") if rng.random() < 0.3 else x

    def rows(items):
        return "\n".join(f"{i + 1}. {x}" for i, x in enumerate(items))

    for (q, p), k in pairs + plain:
        full = phrases[k][1]
        body = p.rstrip(" .。!！")
        sep = "" if k in ("zh", "ja") else " "
        good = [p, body, body + pick(marks), p + sep + pick(by[k]).rstrip(" .。!！"), p + sep + pick(by[k]), q + sep + p, pick(own(D.NEAR_REFUSAL, k)).format(x=pick([p, low(p)])),
                pick(own(D.NEAR_REFUSAL, k)).format(x="").rstrip(" ,，"), pick(own(D.SHORT, k)), "".join(map(pick, pick(own(D.SHORT_PARTS, k)))), body + f" ({pick(['«{}»', '“{}”', '\"{}\"']).format(pick(foreign[k]))})" + p[len(body):]]
        if len(lists.get(k, ())) > 3:
            items = [pick(lists[k]) for _ in range(int(rng.integers(2, 5)))]
            good.append(rows(items))
            out.append((q, rows(items[:-1] + [""]), "truncated"))
            if k in ("zh", "ja"):
                out.append((q, p + "1. " + items[0] + " 2.", "truncated"))
            x = pick(lists[k])
            if rng.random() < 0.5:
                x = p + sep + x if rng.random() < 0.5 else x
                out.append((q, x + pick([",", ";", ":", " -", " –", "…,"] if k not in ("zh", "ja") else ["，", "；", "：", "、"]), "truncated"))
        out += [(q, good[i], None) for i in rng.permutation(len(good))[:6]]
        for text in (p, p + sep + pick(by[k])):
            if (c := _cut(text, full, rng)) is not None:
                out.append((q, c, "truncated"))
        if rng.random() < 0.5:
            out.append((q, body + pick(own(D.JOIN, k)), "truncated"))
        out.append((q, _echo(q, k, rng), "echo"))
        out.append((q, refusal(k), "refusal"))
        others = [x for x in by if x != k and len(by[x]) >= 3]
        if others:
            o = pick(others)
            out.append((q, pick(by[o]) if rng.random() < 0.8 else pick([x for x in own(D.SHORT, o) if x not in own(D.SHORT, k)]), "other_language"))
            if rng.random() < 0.3:
                out.append((q, refusal(o), "refusal"))
            if rng.random() < 0.4 and asked_language(q) is None and (names := [n for n, c in _NAME.items() if c == o]):
                asked = pick(own(D.ASK, k)).format(n=pick(names), q=q)
                out += [(asked, pick(by[o]), None), (asked, pick(own(D.SHORT, o)), None), (asked, p, "other_language"), (asked, refusal(o), "refusal")]
                if rng.random() < 0.5:
                    out.append((asked, _echo(asked, k, rng), "echo"))
        if rng.random() < 0.4:
            x = pick(pick([D.BLANKS, D.CONTROL, D.NULLS]))
            x = pick([x, x.upper(), x.title(), x + ".", f"({x})", f'"{x}"', f"<{x}>", f"[{x}]", x + x if x in D.CONTROL else x]) if x in D.NULLS or x in D.CONTROL else x
            out.append((q, x, "empty"))
    return out


@dataclass
class Rows:
    """Training rows: features of each, the labels, and which labels each row counts for."""

    feats: list[np.ndarray]
    y: np.ndarray
    use: np.ndarray

    @classmethod
    def of(cls, model: PairModel, made: list[tuple[str, str, str | None]], rng: np.random.Generator | None = None) -> Rows:
        """With `rng`, a third of the sound pairs come once more without their words and with a last word that nobody knows,
        and a third of the cut ones without their words."""
        q, p = [x[0] for x in made], [x[1] for x in made]
        agree = model.agreement(q, p)
        row, feat = model.rows(q, p, agree)
        feats = np.split(feat, np.flatnonzero(np.diff(row)) + 1) if len(row) else []
        names = [x[2] for x in made]
        if rng is not None:
            for i in np.flatnonzero(rng.random(len(made)) < 0.33):
                if names[i] is None:
                    feats.append(np.array(structure(q[i], p[i], agree[i], model.words, strange=True)))
                    names.append(None)
                elif names[i] == "truncated":
                    feats.append(feats[i][feats[i] < WORDS_AT])
                    names.append("truncated")
        place = np.array([LABELS.index(d) if d else len(LABELS) for d in names])
        c = np.arange(len(LABELS))
        return cls(feats, (place[:, None] == c).astype("float32"), (place[:, None] >= c).astype("float32"))  # labels behind the first that fits are open

    def __add__(self, other: Rows) -> Rows:
        return Rows(self.feats + other.feats, np.concatenate([self.y, other.y]), np.concatenate([self.use, other.use]))


def _fit(rows: Rows, w: np.ndarray, epochs: int = 12, rate: float = 0.3, decay: float = 1e-6, batch: int = 1024) -> np.ndarray:
    """Logistic regressions for all labels from weights `w` on (AdaGrad on mini-batches, drawn once, in changing order)."""
    rng = np.random.default_rng(3)
    w = w.copy()
    mem = np.full_like(w, 1e-4)
    order = rng.permutation(len(rows.feats))
    parts = []
    for a in range(0, len(order), batch):
        part = order[a:a + batch]
        n = np.array([len(rows.feats[i]) for i in part])
        used, at = np.unique(np.concatenate([rows.feats[i] for i in part]), return_inverse=True)
        parts.append((part, np.repeat(np.arange(len(part)), n), np.concatenate([[0], np.cumsum(n)[:-1]]), used, at, LOOKS[:, used]))
    for _ in range(epochs):
        for i in rng.permutation(len(parts)):
            part, owner, begins, used, at, looks = parts[i]
            own = w[:, used]
            err = (_sigmoid(np.add.reduceat(own[:, at], begins, axis=1)) - rows.y[part].T) * rows.use[part].T / len(part)
            g = (np.stack([np.bincount(at, weights=e[owner], minlength=len(used)) for e in err]) + decay * own) * looks
            m = mem[:, used] + g * g
            mem[:, used] = m
            w[:, used] = own - rate * g / np.sqrt(m)
    return w


def _threshold(score: np.ndarray, truth: np.ndarray) -> float:
    """Of the thresholds that give the best F1, the one nearest to a half."""
    grid = np.linspace(0.02, 0.98, 97)
    f1 = []
    for t in grid:
        hit = score >= t
        f1.append(2 * (hit & truth).sum() / max(1, hit.sum() + truth.sum()))
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
    return float(min(grid[best], key=lambda t: abs(t - 0.5)))


def fit(sound: list[tuple[str, str]], seed: int = 5, heard: list[tuple[str, str]] | None = None, sure: float = 0.95) -> tuple[PairModel, dict[str, float]]:
    """A model from sound (question, reply) pairs, and each label's F1 on held-out made pairs.

    `heard` are pairs of unknown quality: those that the first model labels with at least `sure` probability, or finds sound
    with that of each label, are trained on in a second pass.
    """
    rng = np.random.default_rng(seed)
    texts = sorted({t for pair in sound for t in pair})
    short = [x for v in (D.SHORT, D.FACTS) for y in v.values() for x in y]
    # a sound reply has its question's language unless another is asked for: both together tell it more surely
    joint = {t: None for t in texts}
    whole = [pair for pair in sound if asked_language(pair[0]) is None]
    for (q, p), g in zip(whole, seed_field().marginals([_merged(tokens(q + " " + p)) for q, p in whole])):
        k = LANGUAGES[int(g.mean(0).argmax())] if len(g) else None
        joint[q] = joint[p] = k
    language = train(texts + short, [joint[t] for t in texts] + [k for v in (D.SHORT, D.FACTS) for k, y in v.items() for _ in y])
    words = Words.of(texts + [r for k in D.REFUSAL.values() for part in k for r in part] + [r for k in D.REFUSAL_PARTS.values() for way in k for part in way for r in part] + [x.replace("{x}", "") for v in D.NEAR_REFUSAL.values() for x in v] * 2 + short * 2 + [x for v in SEED.values() for x in v] * 2)
    model = PairModel(np.zeros((len(LABELS), SIZE), "float32"), np.full(len(LABELS), 0.5), language, words)
    lang_of = lambda t: model.languages(t).argmax(1)
    pairs = [sound[i] for i in rng.permutation(len(sound))]
    cut = max(1, len(pairs) * 3 // 4)
    made = Rows.of(model, made_pairs(pairs[:cut], lang_of, rng), rng)
    model.weights = _fit(made, model.weights)
    if heard:
        score = model.scores([q for q, _ in heard], [p for _, p in heard])
        known = [(q, p, LABELS[int((s >= sure).argmax())] if (s >= sure).any() else None) for (q, p), s in zip(heard, score)
                 if (s <= 1 - sure).all() or (s >= sure).any() and (s[:int((s >= sure).argmax())] <= 1 - sure).all()]
        if known:
            model.weights = _fit(made + Rows.of(model, known), model.weights, epochs=4)
    held = Rows.of(model, made_pairs(pairs[cut:] or pairs, lang_of, rng))
    score = np.array([_sigmoid(model.weights[:, r].sum(1)) for r in held.feats])
    f1 = {}
    for c, name in enumerate(LABELS):
        counts = held.use[:, c] > 0
        truth = held.y[counts, c] > 0
        model.thresholds[c] = _threshold(score[counts, c], truth)
        hit = score[counts, c] >= model.thresholds[c]
        f1[name] = float(2 * (hit & truth).sum() / max(1, hit.sum() + truth.sum()))
    return model, f1


# ---- tables ------------------------------------------------------------------------------------------------


def pairs_of(predictions: DataFrame) -> DataFrame:
    """(prediction_id, at_second, question, value, pred) of every assistant turn whose value is not silence.

    The question is the latest user turn at or before the turn (one without a time comes first; of several at one
    time, the last); NULL if there is none. Turns without a value or a time are no pairs. A pred that is silence is
    kept: it is for the caller to treat as sound.
    """
    users = F.transform(
        F.filter(F.transform("conversations", lambda c, i: F.struct(
            F.coalesce(c["timestamp"], F.lit(float("-inf"))).alias("t"), i.alias("i"), c["from"].alias("f"), c["value"].alias("v"))),
            lambda c: (c["f"] == "user") & c["v"].isNotNull() & (F.trim(c["v"]) != "<video>")),
        lambda c: F.struct(c["t"].alias("t"), c["i"].alias("i"), c["v"].alias("v")))
    turns = F.filter("conversations", lambda c: (c["from"] == "assistant") & c["timestamp"].isNotNull() & F.coalesce(~is_silence(c["value"]), F.lit(False)))
    # once per row: beside the explode it would be done again for every turn
    d = computed(predictions.select("prediction_id", "conversations"), "users", F.array_sort(users))
    t = d.select("prediction_id", "users", F.explode(turns).alias("c"))
    asked: Column = F.filter("users", lambda u: u["t"] <= F.col("c.timestamp"))
    return t.select("prediction_id", F.col("c.timestamp").cast("int").alias("at_second"),
                    F.try_element_at(asked, F.lit(-1))["v"].alias("question"), F.col("c.value").alias("value"), F.col("c.pred").alias("pred"))


def fit_on(predictions: DataFrame, sample_pairs: int = 2500, sample_heard: int = 2500, sample_rows: int = 400) -> tuple[PairModel, dict[str, float]]:
    """Train on at most `sample_pairs` sound pairs (question, value) and at most `sample_heard` given ones (question, pred).

    They are those with the smallest hash among the pairs of the `sample_rows` predictions whose key has the smallest hash;
    a first pass over the keys alone finds these rows, so that only they are taken apart.
    """
    key = F.xxhash64("prediction_id")
    least = predictions.select(key.alias("h")).distinct().orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if least is None:
        return fit([("?", "!")])
    found = pairs_of(predictions.where(key <= F.lit(least))).where("question is not null").select(F.xxhash64("prediction_id", "at_second").alias("h"), "question", "value", "pred")
    rows = found.where("value is not null").orderBy("h").limit(sample_pairs).collect()
    heard = found.where("pred is not null").where(~is_silence(F.col("pred"))).orderBy(F.xxhash64("h")).limit(sample_heard).collect()
    return fit([(r["question"], r["value"]) for r in rows], heard=[(r["question"], r["pred"]) for r in heard])


def label_pairs(pairs: DataFrame, model: PairModel) -> DataFrame:
    """(prediction_id, at_second, defect) for every pair; defect is NULL for a sound one.

    Silence as pred is sound; a NULL pred is empty; without a question only empty, refusal and truncated can hold.
    Repeated rows are labelled each; texts of any length are read whole. No shuffle.
    """
    sc = pairs.sparkSession.sparkContext
    shared = sc.broadcast((model.weights, model.thresholds, model.language.parts, model.words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, t, lang, words = shared.value
        own = PairModel(w, t, Field(*lang), words)
        for pdf in batches:
            pred, asked = pdf["pred"].fillna(""), pdf["question"]
            out = np.array([None] * len(pdf), dtype=object)
            talk = np.flatnonzero(~pdf["silent"].to_numpy(bool))
            for a in range(0, len(talk), 2000):
                part = talk[a:a + 2000]
                q = [asked.iat[i] if isinstance(asked.iat[i], str) else "" for i in part]
                out[part] = own.label(q, [pred.iat[i] for i in part])
            yield pd.DataFrame({"prediction_id": pdf["prediction_id"], "at_second": pdf["at_second"], "defect": out})

    cols = pairs.select("prediction_id", "at_second", "question", "pred", F.coalesce(is_silence(F.col("pred")), F.lit(False)).alias("silent"))
    return cols.mapInPandas(run, "prediction_id long, at_second int, defect string")
