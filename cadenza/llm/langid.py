"""Languages of documents and of their passages: a linear-chain conditional random field over words.

Fenced and marked-up code, tags, links and inline code are masked first (offsets stay true). The words of a line are
one sequence. A word's emission scores are sums of hashed affix, character n-gram, script and lexicon features; beside
the languages there is the label `NONE` for code, commands and log lines, whose score also depends on the signs around
a word and on the layout of its line and the lines beside it. Transitions are learned, and forward-backward gives every
word's distribution over the labels. A sentence has the label with the most probability over its words; a stretch of
four or more words in another language inside it is a passage of its own.

Training (on the driver, from a bounded sample): seed sentences and code lines of our own give a first model, which
labels the sentences of up to `sample_docs` documents together with the documents' labels (a label is only evidence, as
many are wrong); the sentences that are sure then join the seeds, and so do the lines that documents mark as code.
Sequences that switch languages are made by joining sentences and parts of sentences; prose is also shown as headings,
items, quotations, indented and with other ends, so that layout alone makes no line code.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import methodcaller

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.languages import CODE, LANGUAGES, LEXICON, SEED, label, strip_accents

BUCKETS = 1 << 15
MIN_FOREIGN = 4  # words of a stretch that counts as a passage inside a sentence of another language
NONE = len(LANGUAGES)  # the label of words without a language
LABELS = NONE + 1

# ---- masking -----------------------------------------------------------------------------------------------

_blank = lambda m: re.sub(r"[^\n]", " ", m.group())
_tag = lambda m: " " * (len(m.group()) - 1) + "\n"
_fence = lambda m: (m["tag"] or "") + re.sub(r"[^\n]", " ", m.group()[len(m["tag"] or ""):-1]) + "\n"
_PRE = re.compile(r"(?is)<(pre|code|script|style)\b[^>]*>(?P<code>.*?)(?:</\1\s*>|\Z)")
_BLOCK_TAG = r"</?(?:p|br|div|li|ul|ol|tr|td|table|h\d|blockquote|hr)\b[^<>]*>"
_BLOCK = re.compile(f"(?i){_BLOCK_TAG}")
# A fence opens at a line start, right after a block tag (which stays), or at the end of a line; masked, it ends its line. One without a partner masks its own mark only.
_FENCE = re.compile(rf"(?ims)(?:^[ \t>]*|(?P<tag>{_BLOCK_TAG})[ \t>]*|(?=```[a-z0-9+#.-]*[ \t]*$))(?P<f>```|~~~)(?P<code>.*?)(?:^[ \t>]*(?P=f)[`~]*[a-z0-9+#.-]*[ \t]*(?=$|<)|(?P=f))")
_STRAY = re.compile(r"(?im)(?:^[ \t>]*|(?<=>)[ \t]*)(?:```|~~~)[`~]*[a-z0-9+#.-]*[ \t]*(?=$|<)")
_COMMENT = re.compile(r"(?s)<!--.*?-->")
_INLINE = re.compile(r"</?[A-Za-z][^<>\n]*+>|&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);")
_CODE_SPAN = re.compile(r"`[^`\n]*`")
_LINK = re.compile(r"://\S+|[wW][wW][wW]\.\S+")
_SCHEME = re.compile(r"(?:https?|ftp|file)$", re.I)
_END = re.compile(r"[.!?…]++(?=[\s\"'”’»)\]]|$)[\"'”’»)\]」』]*|[。！？][.!?。！？…]*[\"'”’»)\]」』]*")


def _unfenced(text: str) -> str:
    """The text with marked code replaced by blanks, of the same length; line ends are `\\n`."""
    text = text.replace("\r\n", " \n").replace("\r", "\n").replace("\u2028", "\n").replace("\xa0", " ")
    if "```" in text or "~~~" in text:
        text = _STRAY.sub(_tag, _FENCE.sub(_fence, text))
    if "<" in text:
        text = _COMMENT.sub(_blank, _PRE.sub(_blank, text))
    return text


def _marked(text: str) -> list[str]:
    """What the text marks as code: the contents of its fences and code tags."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [m["code"] for m in _FENCE.finditer(text)] + [m["code"] for m in _PRE.finditer(_FENCE.sub(_fence, text))]


# Classes of characters, as the layout features see them.
_SIGNS = [" \t\n\v\f　", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".…", ",", "!?", ":", ";", "(", ")", "\"'“”«»„‘’‚‹›", "#", "/\\", "-–—", "=",
          "<>", "{}[]", "_", "$%&|^~@+*`", "。、，！？：；「」『』（）《》・"]
_SPACE, _LOWER, _UPPER, _DIGIT, _SEMI, _OPEN, _SLASH, _DASH, _UNDER, _LETTER, _OTHER = 0, 1, 2, 3, 8, 9, 13, 14, 18, len(_SIGNS), len(_SIGNS) + 1
N = len(_SIGNS) + 2  # number of classes
_SYMBOLS = (8, 12, 13, 15, 16, 17, 18, 19)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point below 2**16; those above count as the last."""
    table = np.full(1 << 16, _OTHER, "uint8")
    for c in range(0x80, 1 << 16):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = _LETTER
    for k, signs in enumerate(_SIGNS):
        for c in signs:
            table[ord(c)] = k
    return table


@dataclass
class Parsed:
    """Words of some texts in their order, with where they stand."""

    words: list[str]
    start: np.ndarray  # offset in `text`
    doc: np.ndarray
    line: np.ndarray  # number among the lines that have words
    sentence: np.ndarray
    around: np.ndarray  # feature of the signs before and behind
    layout: np.ndarray  # lines that have words x their layout features
    ends: np.ndarray  # end of each word's sentence
    offsets: np.ndarray  # of the documents in `text`
    text: str

    @property
    def line_starts(self) -> np.ndarray:
        return np.flatnonzero(np.diff(self.line, prepend=-1))


_SIZES = [N * N, N * N, N * N, 3 * N, 6 * 4, 32, 6 * N, 9 * N, 9 * 4]  # signs around a word; of lines: begin, ends, indent, shares, signs, words, lines beside, both
_AT = np.concatenate([[0], np.cumsum(_SIZES)])
SHAPES = int(_AT[-1])


def _masked(texts: list[str]) -> tuple[str, np.ndarray]:
    """All texts as one, without marked code, tags and links, and the offset of each."""
    kept = [_unfenced(t) for t in texts]
    big = "\n\n" + "\n\n".join(kept) + "\n\n"
    if "<" in big:
        big = _BLOCK.sub(_tag, big)
    if "<" in big or "&" in big:
        big = _INLINE.sub(_blank, big)
    if "`" in big:
        big = _CODE_SPAN.sub(_blank, big)
    return _unlinked(big), np.cumsum([2, *(len(t) + 2 for t in kept)])[:-1]


def _unlinked(big: str) -> str:
    """The text with links replaced by blanks."""
    out, at = [], 0
    for sign in ("://", "www.", "WWW.", "Www."):
        if sign in big:
            break
    else:
        return big
    for m in _LINK.finditer(big):
        a, b = m.span()
        if big[a] == ":":
            scheme = _SCHEME.search(big, max(at, a - 5), a)
            if not scheme:
                continue
            a = scheme.start()
        elif big[a - 1].isalnum():
            continue
        out += [big[at:a], " " * (b - a)]
        at = b
    return "".join([*out, big[at:]])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _class_of(cp: np.ndarray) -> np.ndarray:
    cls = _classes()[np.minimum(cp, 0xFFFF)]
    cls[(cp > 0xFFFF) & (cp < 0x1F000)] = _LETTER  # letters of other planes; what lies behind are pictures and rare ideographs
    return cls


def _words(cls: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: a run of letters with the apostrophes inside it, of Hiragana, of Katakana, or up to four ideographs."""
    kind = ((cls == _LOWER) | (cls == _UPPER) | (cls == _LETTER)).astype("int8")
    wide = cp >= 0x3005
    if wide.any():
        kind[wide & (cp >= 0x3040) & (cp <= 0x309F)] = 2
        kind[wide & ((cp >= 0x30A0) & (cp <= 0x30FF) | (cp >= 0x31F0) & (cp <= 0x31FF))] = 3
        kind[wide & ((cp >= 0x3400) & (cp <= 0x9FFF) | (cp == 0x3005) | (cp >= 0x20000) & (cp < 0x40000))] = 4
    inner = ((cp == 0x27) | (cp == 0x2019))[1:-1] & (kind[:-2] == 1) & (kind[2:] == 1)
    kind[1:-1][inner] = 1
    edges = np.flatnonzero(np.diff(kind)) + 1
    start, end = np.concatenate([[0], edges]), np.append(edges, len(kind))
    some = kind[start] > 0
    start, end, kind = start[some], end[some], kind[start[some]]
    pieces = np.where(kind == 4, (end - start + 3) // 4, 1)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, end, han = np.repeat(start, pieces) + 4 * nth, np.repeat(end, pieces), np.repeat(kind == 4, pieces)
    return start, np.where(han, np.minimum(start + 4, end), end)


def _names(cls: np.ndarray, cp: np.ndarray) -> np.ndarray:
    """Where paths, addresses and identifiers stand: runs of word signs with a slash, an underscore, an @, or a letter before a digit."""
    cjk = (cp >= 0x3040) & (cp <= 0x9FFF)
    letter = (cls == _LOWER) | (cls == _UPPER) | ((cls == _LETTER) & ~cjk)
    joint = (cls == _SLASH) | (cls == _UNDER) | (cp == 64)
    inside = letter | joint | (cls == _DIGIT) | (cp == 46) | (cp == 45)
    latin = (cls == _LOWER) | (cls == _UPPER)
    odd = joint.copy()
    odd[:-1] |= latin[:-1] & (cls[1:] == _DIGIT)
    odd[:-2] |= latin[:-2] & (cp[1:-1] == 45) & (cls[2:] == _DIGIT)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    out = np.zeros(len(cp), bool)
    a, b = edges[::2], edges[1::2]
    count = np.concatenate([[0], np.cumsum(odd & inside)])
    hit = count[b] > count[a]
    if hit.any():
        delta = np.zeros(len(cp) + 1, "int8")
        delta[a[hit]] += 1
        delta[b[hit]] -= 1
        out = np.cumsum(delta[:-1]) > 0
    return out


def prose(text: str) -> str:
    """The text with marked code, tags, links and names in signs replaced by blanks, of the same length."""
    big, at = _masked([text])
    cp = _codes(big)
    cls = _class_of(cp)
    cp = np.where(_names(cls, cp), 32, cp).astype("<u4")
    return cp.tobytes().decode("utf-32-le", "surrogatepass")[at[0]:at[0] + len(text)]


def parse(texts: list[str]) -> Parsed:
    """The words of texts, their sentences and lines, and the features of layout."""
    big, offsets = _masked(texts)
    cp = _codes(big)
    cls = _class_of(cp)
    start, end = _words(cls, cp)
    keep = ~_names(cls, cp)[start]
    start, end = start[keep], end[keep]
    words = [big[a:b] for a, b in zip(start.tolist(), end.tolist())]
    breaks = np.flatnonzero(cp == 10)
    bounds = np.union1d(np.fromiter(map(methodcaller("end"), _END.finditer(big)), "int64"), breaks)
    sentence = np.searchsorted(bounds, start, "right")
    row = np.searchsorted(breaks, start)
    rows, line = np.unique(row, return_inverse=True)
    around = cls[start - 1].astype("int64") * N + cls[np.minimum(end, len(cls) - 1)]
    layout = _layout(cls, cp, breaks, rows, np.bincount(line, minlength=len(rows)))
    return Parsed(words, start, np.searchsorted(offsets, start, "right") - 1, line.reshape(-1), sentence, around, layout, bounds[sentence] if len(start) else start, offsets, big)


def _layout(cls: np.ndarray, cp: np.ndarray, breaks: np.ndarray, rows: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The layout features of some lines (`rows`, by number of the line break that ends them)."""
    begin, stop = np.concatenate([[0], breaks[:-1] + 1]), breaks
    filled = np.flatnonzero(cls != _SPACE)
    i, j = np.searchsorted(filled, begin), np.searchsorted(filled, stop)
    blank = i == j
    filled = np.append(filled, len(cls) - 1)
    first, last = filled[i], filled[np.maximum(j, 1) - 1]
    head, second, tail = cls[first].astype("int64"), cls[np.minimum(first + 1, len(cls) - 1)].astype("int64"), cls[last].astype("int64")
    count = lambda hit: (lambda s: s[stop] - s[begin])(np.concatenate([[0], np.cumsum(hit)]))
    size = np.maximum(1, j - i)
    symbols = count(np.isin(cls, _SYMBOLS)) / size
    digits = count(cls == _DIGIT) / size
    word = (cls == _LOWER) | (cls == _UPPER) | (cls == _UNDER)
    call = np.zeros(len(cls), bool)
    call[1:] = word[:-1] & (cls[1:] == _OPEN)
    option = np.zeros(len(cls), bool)
    option[1:-1] = (cls[:-2] == _SPACE) & (cp[1:-1] == 45) & ((cls[2:] == _LOWER) | (cp[2:] == 45))
    dotted = np.zeros(len(cls), bool)
    dotted[1:-1] = word[:-2] & (cp[1:-1] == 46) & word[2:]
    signs = [count(x) > 0 for x in (call, cls == 15, cls == 17, option, dotted)]
    flags = sum(s.astype("int64") << k for k, s in enumerate(signs))
    tabs = count((cp == 9)) > 0
    indent = np.where(first - begin >= 4, 2, np.where(first > begin, 1, 0))
    indent = np.where((first > begin) & tabs, 2, indent)
    code = np.where(blank, 0, np.where((symbols >= 0.08) | signs[0] | (tail == _SEMI) | (tail == 17), 2, 1))
    code = np.concatenate([[0], code, [0]])
    beside = code[:-2] * 3 + code[2:]
    share = np.searchsorted([0.001, 0.02, 0.05, 0.1, 0.2], symbols, "right") * 4 + np.searchsorted([0.001, 0.05, 0.15], digits, "right")
    wide = np.searchsorted([1, 2, 3, 6, 12], n_words)
    r = rows
    out = np.stack([head[r] * N + second[r], head[r] * N + tail[r], indent[r] * N + head[r], share[r], flags[r], wide * N + tail[r], beside[r] * N + head[r],
                    beside[r] * 4 + signs[0][r] + 2 * signs[1][r]], 1) if len(r) else np.zeros((0, len(_SIZES) - 1), "int64")
    return out + _AT[1:-1]


# ---- features ----------------------------------------------------------------------------------------------

_PLAIN = {k: frozenset(strip_accents(w) for w in v) for k, v in LEXICON.items()}
_CJK = re.compile(r"[぀-ヿㇰ-ㇿ㐀-鿿々]")


def features(word: str) -> list[int]:
    w = word.casefold().replace("’", "'")
    f = ["w=" + w]
    if _CJK.match(w):
        f += ["u=" + c for c in w] + ["b=" + w[i:i + 2] for i in range(len(w) - 1)]
        f.append("s=" + ("hira" if w[0] < "゠" else "kata" if w[0] < "㐀" else "han"))
        f += [f"x={k}" for k in ("zh", "ja") if w in LEXICON[k]]
    else:
        b = f"^{w}$"
        f += ["p=" + w[:n] for n in (1, 2, 3, 4)] + ["e=" + w[-n:] for n in (1, 2, 3, 4)]
        f += ["g=" + b[i:i + n] for n in (2, 3) for i in range(len(b) - n + 1)]
        f += ["c=" + c for c in w if c > "\x7f"]
        f.append("s=" + ("latin" if w[0] < "ɐ" else "cyr" if "Ѐ" <= w[0] < "԰" else "other"))
        f += [f"x={k}" for k, v in LEXICON.items() if w in v] + [f"y={k}" for k, v in _PLAIN.items() if strip_accents(w) in v]
    return [zlib.crc32(x.encode()) % BUCKETS for x in f]


# ---- the random field --------------------------------------------------------------------------------------


@dataclass
class Field:
    weights: np.ndarray  # BUCKETS x labels
    shape: np.ndarray  # layout features: score of NONE
    transitions: np.ndarray  # from, to
    start: np.ndarray

    def __post_init__(self):
        self.seen: dict[str, np.ndarray] = {}

    @property
    def parts(self) -> tuple:
        return self.weights, self.shape, self.transitions, self.start

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words without regard to layout; each distinct word is hashed once."""
        if len(self.seen) > 200_000:
            self.seen.clear()
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(index.__getitem__, words), "int64", len(words))
        seen, rows = self.seen, np.empty((len(index), LABELS), "float32")
        for w, i in index.items():
            e = seen.get(w)
            if e is None:
                e = seen[w] = self.weights[features(w)].sum(0)
            rows[i] = e
        return rows[at]

    def probabilities(self, p: Parsed) -> np.ndarray:
        """Each word's distribution over the labels, lines as sequences."""
        if not p.words:
            return np.zeros((0, LABELS), "float32")
        e = self.emissions(p.words)
        e[:, NONE] += self.shape[p.around] + self.shape[p.layout].sum(1)[p.line]
        starts = p.line_starts
        return _marginals(e, starts, np.diff(starts, append=len(e)), self.transitions, self.start)

    def marginals(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Distributions over the languages alone of sequences of bare words."""
        n = np.array([len(s) for s in sequences], "int64")
        full = np.flatnonzero(n)
        out = [np.zeros((0, NONE), "float32")] * len(sequences)
        if len(full):
            e = self.emissions([w for s in sequences for w in s])[:, :NONE]
            starts = (np.cumsum(n) - n)[full]
            g = _marginals(e, starts, n[full], self.transitions[:NONE, :NONE], self.start[:NONE])
            for i, a in zip(full, starts):
                out[i] = g[a:a + n[i]]
        return out


def _marginals(e: np.ndarray, starts: np.ndarray, n: np.ndarray, trans: np.ndarray, start: np.ndarray, cells: int = 60_000) -> np.ndarray:
    """Forward-backward over sequences that lie one behind the other in `e`. Those of like length are worked on together, up to
    `cells` words with their padding, so a very long one is alone."""
    out = np.empty_like(e)
    order = np.argsort(n, kind="stable")
    a = 0
    while a < len(order):
        z = a + 1
        while z < len(order) and (z - a + 1) * n[order[z]] <= cells:
            z += 1
        part, a = order[a:z], z
        own = n[part]
        steps = np.arange(own.max())
        at = starts[part][:, None] + np.minimum(steps, own[:, None] - 1)
        gamma = _forward_backward(e[at], own, trans, start)[0]
        real = steps < own[:, None]
        out[at[real]] = gamma[real]
    return out


def _forward_backward(e: np.ndarray, n: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals of padded sequences (batch, time, label), and the expected transitions if `pairs`."""
    batch, steps, labels = e.shape
    psi = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(trans)
    alpha = np.zeros_like(psi)
    alpha[:, 0] = psi[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[:, t - 1] @ a) * psi[:, t]
        alpha[:, t] = x / x.sum(1, keepdims=True)
    beta = np.ones((batch, labels), psi.dtype)
    gamma = np.zeros_like(psi)
    expected = np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        beta[t >= n - 1] = 1.0
        g = alpha[:, t] * beta
        gamma[:, t] = g / g.sum(1, keepdims=True)
        if t:
            to = psi[:, t] * beta
            if pairs:
                before = alpha[:, t - 1]
                scale = ((before @ a) * to).sum(1)
                real = t < n
                expected += a * ((before[real] / scale[real, None]).T @ to[real])
            beta = to @ a.T
            beta /= beta.max(1, keepdims=True)
    return gamma, expected


Line = list[tuple[str, int]]  # pieces of a line with their labels


def fit(documents: list[list[Line]], steps: int = 60, rate: float = 0.25, decay: float = 2e-4) -> Field:
    """Maximise the conditional likelihood of labelled lines (full batches, AdaGrad)."""
    texts, labels, at = [], [], []
    for lines in documents:
        text = ""
        own = []
        for line in lines:
            for piece, c in line:
                own.append((len(text), c))
                text += piece + " "
            text = text[:-1] + "\n"
        texts.append(text)
        at.append([x for x, _ in own])
        labels += [c for _, c in own]
    p = parse(texts)
    where = np.concatenate([off + np.array(x, "int64") for off, x in zip(p.offsets, at)])
    y_all = np.array(labels)[np.searchsorted(where, p.start, "right") - 1]
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in p.words), "int64", len(p.words))
    feats = [features(w) for w in index]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    flat = np.concatenate([np.array(f) for f in feats])
    starts = p.line_starts
    size = np.diff(starts, append=len(ids))
    order = np.argsort(size, kind="stable")  # parts of like length, so that little is padding
    k = LABELS
    parts, seen, first = [], np.zeros((k, k)), np.zeros(k)
    for i in range(0, len(order), 800):
        part = order[i:i + 800]
        n = size[part]
        steps_of = np.arange(n.max())
        x = starts[part][:, None] + np.minimum(steps_of, n[:, None] - 1)
        real = steps_of < n[:, None]
        y = np.where(real, y_all[x], -1)
        both = real[:, 1:] & real[:, :-1]
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        first += np.bincount(y[:, 0], minlength=k)
        parts.append((x, n, real, np.eye(k, dtype="float32")[y_all[x[real]]]))
    total = len(ids)
    w, shape, trans, start = np.zeros((BUCKETS, k), "float32"), np.zeros(SHAPES), np.zeros((k, k)), np.zeros(k)
    mem = [np.full_like(v, 1e-6) for v in (w, shape, trans, start)]
    used = np.unique(flat)
    n_lines = len(p.layout)
    for _ in range(steps):
        per_word = np.stack([np.bincount(owner, weights=w[flat, c], minlength=len(feats)) for c in range(k)], 1).astype("float32")
        e = per_word[ids]
        e[:, NONE] += shape[p.around] + shape[p.layout].sum(1)[p.line]
        rest, expected, began = np.zeros((total, k), "float32"), np.zeros((k, k)), np.zeros(k)
        for x, n, real, onehot in parts:
            gamma, pairs = _forward_backward(e[x], n, trans, start, pairs=True)
            rest[x[real]] = onehot - gamma[real]
            expected += pairs
            began += gamma[:, 0].sum(0)
        up = np.stack([np.bincount(ids, weights=rest[:, c], minlength=len(feats)) for c in range(k)], 1)
        grad = np.stack([np.bincount(flat, weights=up[owner, c], minlength=BUCKETS)[used] for c in range(k)], 1) / total - decay * w[used]
        mem[0][used] += grad * grad
        w[used] += rate * grad / np.sqrt(mem[0][used])
        per_line = np.bincount(p.line, weights=rest[:, NONE], minlength=n_lines)
        laid = np.bincount(p.around, weights=rest[:, NONE], minlength=SHAPES) + np.bincount(p.layout.ravel(), weights=np.repeat(per_line, p.layout.shape[1]), minlength=SHAPES)
        for v, g, m in ((shape, laid / total - decay * shape, mem[1]), (trans, (seen - expected) / total - decay * trans, mem[2]), (start, (first - began) / total - decay * start, mem[3])):
            m += g * g
            v += rate * g / np.sqrt(m)
    return Field(w, shape.astype("float32"), trans.astype("float32"), start.astype("float32"))


_HEADS = ["# ", "## ", "- ", "* ", "> ", "1. ", "    ", "\t", "        ", "Note: ", "Error: "]
_TAILS = [":", ";", ",", "", " ...", "!", " (2/3)", " {", "?"]


def _made(by_language: dict[str, list[str]], code: list[list[str]], rng: np.random.Generator, mixed: int) -> list[list[Line]]:
    """Training documents: sentences alone, without accents, as headings, items and the like, and joined in a line (two to
    four of them, and parts of one inside another); code in blocks, alone, indented, with comments, and next to prose."""
    out: list[list[Line]] = []
    all_ = [(LANGUAGES.index(k), s) for k, v in by_language.items() for s in v if s.strip()]
    pick = lambda x: x[int(rng.integers(len(x)))]
    lines = [x for block in code for x in block]
    for c, s in all_:
        out.append([[(s, c)]])
        plain = strip_accents(s)
        if plain != s and not _CJK.search(s):
            out.append([[(plain, c)]])
        if rng.random() < 0.5:
            bare = s.rstrip(" .!?。！？")
            text = (pick(_HEADS) if rng.random() < 0.7 else "") + (bare + pick(_TAILS) if rng.random() < 0.6 else s)
            # what begins like a comment is prose only away from code
            near: list[Line] = [[(pick(lines), NONE)]] if lines and not text.startswith(("//", "#")) and rng.random() < 0.3 else []
            out.append([*near, [(text, c)]] if rng.random() < 0.5 else [[(text, c)], *near])
    for _ in range(mixed):
        row: Line = []
        c, s = pick(all_)
        for _ in range(rng.integers(2, 5)):
            if rng.random() < 0.5:  # as often as not the next sentence is in another language
                c, s = pick(all_)
            else:
                s = pick(by_language[LANGUAGES[c]])
            if rng.random() >= 0.7:  # a part only: half of the words, or of the signs where words are not parted
                w = s.split(" ")
                s = " ".join(w[:max(4, len(w) // 2)]) if len(w) > 4 else s[:max(8, len(s) // 2)]
            row.append((s, c))
        out.append([row])
    for block in code:
        for turn in range(3):
            a = int(rng.integers(len(block)))
            part = block[a:a + int(rng.integers(1, 9))]
            if turn == 2:  # with a comment in any language
                part.insert(int(rng.integers(len(part) + 1)), pick(["// {}", "# {}", "-- {}", "/* {} */"]).format(pick(all_)[1].rstrip(" .。")))
            pad = pick(["", "", "    ", "\t", "  "])
            doc: list[Line] = [[(pad + x, NONE)] for x in part if x.strip()]
            if rng.random() < 0.3:
                c, s = pick(all_)
                doc = [[(s, c)], *doc] if rng.random() < 0.5 else [*doc, [(s, c)]]
            if doc:
                out.append(doc)
    return out


def _seeds() -> dict[str, list[str]]:
    return {k: [*v, *sorted(LEXICON[k])] for k, v in SEED.items()}


@lru_cache(maxsize=1)
def seed_field() -> Field:
    return fit(_made(_seeds(), CODE, np.random.default_rng(1), 400))


def train(texts: list[str], labels: list[str | None] | None = None, sure: float = 0.9, per_language: int = 200, trust: float = 0.8, code_blocks: int = 300) -> Field:
    """A field from the seeds and from sentences of `texts` whose language is sure, at most `per_language` of each.

    Sure is a sentence by the current field's probabilities times the labels of the documents it occurs in, each of
    which is right with probability `trust`. Two rounds: the seeds' field labels for the first, that for the second.
    Of what the texts mark as code, `code_blocks` blocks are taken, each up to its first 40 lines. All of these numbers
    bound the training rows only; every text is labelled whole.
    """
    p = parse(texts)
    firsts = np.flatnonzero(np.diff(p.sentence, prepend=-1))
    ends = np.append(firsts[1:], len(p.words))
    votes = np.zeros((len(texts), NONE))
    for i, given in enumerate(labels or []):
        if label(given):
            votes[i] = np.log((1 - trust) / (NONE - 1))
            votes[i, LANGUAGES.index(label(given))] = np.log(trust)
    prior: dict[str, np.ndarray] = {}
    group: dict[str, list[int]] = {}
    for j, (a, b) in enumerate(zip(firsts, ends)):
        if b - a >= 3 or _CJK.match(p.words[a]):
            s = p.text[p.start[a]:p.ends[a]].strip()
            prior[s] = prior.get(s, 0) + votes[p.doc[a]]
            group.setdefault(s, []).append(j)
    found = sorted(prior)
    rng = np.random.default_rng(0)
    blocks = [kept for t in texts for block in _marked(t) if (kept := [x for x in block.split("\n") if x.strip()][:40])]
    code = CODE + [blocks[i] for i in rng.permutation(len(blocks))[:code_blocks]]
    own = _seeds()
    field = fit(_made(own, code, np.random.default_rng(1), 400)) if blocks else seed_field()
    for turn in (1, 2):
        if not found:
            break
        rng = np.random.default_rng(turn)
        own = _seeds()
        added = dict.fromkeys(LANGUAGES, 0)
        mean = np.add.reduceat(field.probabilities(p), firsts) / (ends - firsts)[:, None]
        score = np.array([np.append(np.maximum(prior[s] - prior[s].max(), -8), 0) + np.log(np.mean([mean[j] for j in group[s]], 0) + 1e-6) for s in found])
        score = np.exp(score - score.max(1, keepdims=True))
        for i in rng.permutation(len(found)):
            c = int(score[i].argmax())
            if c != NONE and 1 / score[i].sum() >= sure and added[LANGUAGES[c]] < per_language:
                added[LANGUAGES[c]] += 1
                own[LANGUAGES[c]].append(found[i])
        field = fit(_made(own, code, rng, 600), steps=40)
    return field


# ---- documents ---------------------------------------------------------------------------------------------

Passage = tuple[int, int, int, float, bool]  # start, end, label, confidence, whether it has a whole sentence


def _split(text: str, starts: np.ndarray, sizes: np.ndarray, end: int, g: np.ndarray) -> list[Passage]:
    """The passages of a sentence that has words of several labels."""
    best, share = g.argmax(1), sizes @ g
    main = int(share.argmax())
    cuts = [0, *(np.flatnonzero(np.diff(best)) + 1), len(starts)]
    runs = []  # foreign stretches of enough words; everything else goes with the sentence's label
    for a, b in zip(cuts, cuts[1:]):
        c = int(best[a])
        if c != main and (b - a < MIN_FOREIGN or sizes[a:b] @ g[a:b, c] < 0.8 * sizes[a:b].sum()):
            c = main
        if runs and runs[-1][2] == c:
            runs[-1][1] = b
        else:
            runs.append([a, b, c])
    out = []
    for a, b, c in runs:
        s, e = int(starts[a]), end if b == len(starts) else int(starts[b])
        out.append((s, e, c, float(sizes[a:b] @ g[a:b, c] / sizes[a:b].sum()), len(runs) == 1 or c == main or _quoted(text, s, e)))
    return out


def _quoted(text: str, start: int, end: int) -> bool:
    return bool(re.search(r"[\"“„«「『'‘(]\s*$", text[max(0, start - 3):start]) or re.search(r"[\"”“»」』'’)]", text[max(start, end - 3):end + 1]))


def passages(texts: list[str | None], field: Field) -> list[list[Passage]]:
    """The passages of each text, neighbours of one language joined. Texts without prose give none."""
    p = parse([t or "" for t in texts])
    out: list[list[Passage]] = [[] for _ in texts]
    if not p.words:
        return out
    g = field.probabilities(p)
    sizes = np.fromiter(map(len, p.words), "float64", len(p.words))
    firsts = np.flatnonzero(np.diff(p.sentence, prepend=-1))
    ends = np.append(firsts[1:], len(g))
    share = np.add.reduceat(g * sizes[:, None], firsts)
    main = share.argmax(1)
    conf = share[np.arange(len(firsts)), main] / np.add.reduceat(sizes, firsts)
    odd = np.add.reduceat(g.argmax(1) != np.repeat(main, ends - firsts), firsts, dtype="int64") >= MIN_FOREIGN
    for a, b, d, s, e, c, q, mixed in zip(firsts.tolist(), ends.tolist(), p.doc[firsts].tolist(), p.start[firsts].tolist(), p.ends[firsts].tolist(), main.tolist(), conf.tolist(), odd.tolist()):
        own = _split(p.text, p.start[a:b], sizes[a:b], e, g[a:b]) if mixed else ((s, e, c, q, True),)
        joined, off = out[d], int(p.offsets[d])
        for s, e, c, q, whole in own:
            if c == NONE:
                continue
            s, e = s - off, e - off
            if joined and joined[-1][2] == c:
                a0, b0, _, old, w = joined[-1]
                part = (b0 - a0) / max(1, b0 - a0 + e - s)
                joined[-1] = (a0, e, c, old * part + q * (1 - part), w or whole)
            else:
                joined.append((s, e, c, q, whole))
    return out


def fit_on(documents: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", sample_docs: int = 2000, max_chars: int = 20_000) -> Field:
    """Train on at most `sample_docs` documents of at most `max_chars` characters, those with the smallest hash of their key."""
    rows = (documents.where(F.col(text).isNotNull() & (F.length(text) <= max_chars)).select(F.xxhash64(key).alias("h"), text, lang)
            .orderBy("h").limit(sample_docs).collect())
    return train([r[1] for r in rows], [r[2] for r in rows])


def _labeller(field: Field, documents: DataFrame, rows_of, columns: list[str], schema: str, key: str, text: str, lang: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(field.parts)  # a few MB, whatever the data's size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Field(*shared.value)
        for pdf in batches:
            size = pdf["text"].str.len().fillna(0).cumsum() // 1_000_000  # parts of about so many characters; a longer text is alone
            for _, part in pdf.groupby(size, sort=False):
                rows = [row for k, given, ps in zip(part["key"], part["given"], passages(list(part["text"]), own)) for row in rows_of(k, label(given), ps)]
                yield pd.DataFrame(rows, columns=columns)

    cols = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.col(lang).alias("given"))
    return cols.where("key is not null").mapInPandas(run, schema)


def label_passages(documents: DataFrame, field: Field, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per passage: key, no (from 0), start and end (code points), lang, confidence, whole (it has a whole sentence).

    NULL, empty and code-only texts give no row, nor do rows with a NULL key. Equal rows are kept; no shuffle.
    """
    rows = lambda k, given, ps: [(k, i, s, e, LANGUAGES[c], conf, w) for i, (s, e, c, conf, w) in enumerate(ps)]
    return _labeller(field, documents, rows, ["key", "no", "start", "end", "lang", "confidence", "whole"],
                     "key long, no int, start int, end int, lang string, confidence double, whole boolean", key, text, lang)


def label_documents(documents: DataFrame, field: Field, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document and language in which it has a whole sentence: key, lang, share of its prose, confidence,
    n_langs, given (the two-letter language that the document's label names, if any)."""

    def rows(k, given, ps):
        chars: dict[int, float] = {}
        sure: dict[int, float] = {}
        whole = {c for _, _, c, _, w in ps if w}
        for s, e, c, conf, _ in ps:
            chars[c] = chars.get(c, 0) + e - s
            sure[c] = sure.get(c, 0) + conf * (e - s)
        total = sum(chars.values())
        return [(k, LANGUAGES[c], chars[c] / total, sure[c] / chars[c], len(whole), given) for c in sorted(whole)]

    return _labeller(field, documents, rows, ["key", "lang", "share", "confidence", "n_langs", "given"],
                     "key long, lang string, share double, confidence double, n_langs int, given string", key, text, lang)
