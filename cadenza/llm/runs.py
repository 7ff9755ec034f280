"""Repeated consecutive events: each run of the same event becomes one, with count and duration.

Near-identical events are told from different ones by a dissimilarity between their normal forms: letter case,
spacing, punctuation, decoration and one opening filler word do not count; a slip of the keyboard costs a
little; another number, direction or object is another event and may not share a run. Runs are the optimal
segmentation of a sequence: the fewest runs, and of these the least sum of dissimilarities to each run's medoid,
found by dynamic programming with pruning (start points whose run cannot become one event any more are dropped).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import is_blank, is_silence

SLIP = 0.2  # cost of one mistyped word
MAX_SLIPS = 3  # more mistyped words than this make another event
PENALTY = 1.0  # what a dissimilarity within one event stays below. Runs count before dissimilarities, so that slips never split a run, however often they are said again

# Discourse markers and interjections that may open an utterance without adding to it, by language (en, de, fr, es, pt, it, nl, zh, ja,
# ru). They hold the words of an earlier list, some of which were read off the synthetic tables, and further ones from general knowledge.
FILLERS = set("""
so well now okay ok right alright anyway anyhow actually basically look listen see hey um uhm uh hm hmm er erm ah oh yeah yes yep sure fine great good
also gut nun na naja tja äh ähm hm ja okay jetzt schau hör genau schön ach
alors voilà bon bah ben euh hein donc oui enfin bref tiens allez ok
entonces vale bueno pues eh este sí mira oye venga claro bien a ver ok
então bem bom pronto olha ora pois sim ok
allora ecco dunque beh bene insomma senti guarda sì ok
dus nou goed oké kijk zeg ja hè tja
嗯 好 那么 那 呃 啊 哦 好的 好吧 对 嗨 喂 来 唔 哎 那个
えっと では さて はい じゃあ ええ まあ あの うん
ну так итак хорошо вот ладно да слушай смотри э
""".split())
# Words of opposite or neighbouring meaning that lie close to each other in spelling or are exchanged in instructions: directions, states,
# numbers. Exchanging one for another is never a slip. They hold an earlier list and further words from general knowledge.
CONTRASTS = set("""
left right lift up down upper lower top bottom in on out off open close opened closed front back more less hot cold hard soft push pull
with without inside outside before after first last forward backward high low near far start stop eight eighty four forty six sixty seven seventy nine ninety
links rechts linke rechte linken rechten linkes rechtes oben unten obere untere oberen unteren ein aus auf ab zu mehr weniger vorn hinten vorne mit ohne
nein kein eine keine einen keinen acht achtzig drei dreißig sechs sechzig sieben siebzig
gauche droite droit haut bas plus moins ouvrir fermer ouvrez fermez avant après dessus dessous chaud froid deux douze trois treize
izquierda derecha izquierdo derecho arriba abajo más menos abre cierra abrir cerrar dentro fuera antes después alto bajo seis siete dos doce tres trece
esquerda direita cima baixo mais abre fecha sinistra destra sopra sotto apri chiudi links rechts boven onder open dicht
лево право влево вправо вверх вниз открой закрой больше меньше
""".split())

_TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*")


@lru_cache(maxsize=100_000)
def tokens(text: str) -> tuple[str, ...]:
    """Words and numbers of a text in lower case, without punctuation or decoration."""
    return tuple(_TOKEN.findall(unicodedata.normalize("NFKC", text).casefold().replace("’", "'")))


def _one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, replacement or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


def _slip(a: str, b: str) -> bool:
    """Whether one word can be the other mistyped."""
    if not (a.isalpha() and b.isalpha()) or max(a + b) >= "⺀":
        return False
    if max(len(a), len(b)) < 4 and not (len(a) == 3 and sorted(a) == sorted(b)):  # of short words only swapped letters
        return False
    return not (a in CONTRASTS and b in CONTRASTS) and _one_edit(a, b)


def _flat(t: tuple[str, ...]) -> str:
    return re.sub(r"(?<=\d) (?=\d)", "#", " ".join(t)).replace(" ", "")


def _aligned(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    if a == b or _flat(a) == _flat(b):
        return 0.0
    if len(a) != len(b):
        return inf
    slips = 0
    for x, y in zip(a, b):
        if x != y:
            slips += 1
            if slips > MAX_SLIPS or not _slip(x, y):
                return inf
    return SLIP * slips


@lru_cache(maxsize=200_000)
def dissimilarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """0 for the same event, SLIP per mistyped word, infinite for another event. An opening filler is ignored."""
    cost = _aligned(a, b)
    bare = lambda t: t[1:] if len(t) > 1 and t[0] in FILLERS else t
    x, y = bare(a), bare(b)
    for p, q in ((x, b), (a, y), (x, y)):
        if cost and (p, q) != (a, b):
            cost = min(cost, _aligned(p, q))
    return cost


@lru_cache(maxsize=200_000)
def unrelated(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether no third form can be the same event as both: numbers differ, or a word by more than two slips."""
    if dissimilarity(a, b) < inf:
        return False
    bare = lambda t: t[1:] if len(t) > 1 and t[0] in FILLERS else t
    for p in {a, bare(a)}:
        for q in {b, bare(b)}:
            if len(p) == len(q) and all(x == y or (x.isalpha() and y.isalpha() and _two_edits(x, y)) for x, y in zip(p, q)):
                return False
    return True


def _two_edits(a: str, b: str) -> bool:
    """Whether two edits at most can make one word of the other (a cheap bound: it may say yes for a few more)."""
    if abs(len(a) - len(b)) > 2 or a in CONTRASTS and b in CONTRASTS:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i:len(a) - j], b[i:len(b) - j]
    return max(len(x), len(y)) <= 4 or sum((Counter(x) - Counter(y)).values()) <= 2 >= sum((Counter(y) - Counter(x)).values())


class _Start:
    """The run from one start point, read on only when it is asked for: weights of its forms, and the forms it could have as medoid."""

    __slots__ = ("upto", "weight", "able")

    def __init__(self, at: int):
        self.upto, self.weight, self.able = at, {}, set()

    def read(self, blocks: list, to: int, cost) -> None:
        for form, first, end in blocks[self.upto:to]:
            if form not in self.weight:
                self.able = {m for m in self.able if cost(form, m) < inf}
                if all(cost(f, form) < inf for f in self.weight):
                    self.able.add(form)
                self.weight[form] = 0
            self.weight[form] += end - first
        self.upto = to

    def cost(self, cost) -> float:
        return min(sum(w * cost(f, m) for f, w in self.weight.items()) for m in self.able)


def segment(forms: list, penalty: float | None = None, cost=dissimilarity, apart=unrelated) -> list[tuple[int, int]]:
    """Optimal runs [start, end) of a sequence; of equally good ones those with the longest last run.

    Optimal are the fewest runs, then the least dissimilarity; with a `penalty` the least sum of it per run and dissimilarity.
    Equal neighbours are taken together first, which no optimum splits. Two prunings keep the optimum:

    * A start point is dropped as soon as its run holds two forms that no form of the sequence is alike to both of (`apart`
      is a cheap test that says so for most): nothing later can bring them into one run. All forms behind the last drop are
      then in no such conflict with each other, so only forms that are new there need the test.
    * Start points are kept by the number of runs before them. An end is sought in the runs of the lowest number first; if
      one is possible, those of higher numbers cannot win and are not looked at. Their runs are read on only when needed.

    A long stretch of the same event in many forms therefore costs one step per block and one per pair of distinct forms.
    """
    blocks: list[list] = []  # form, first, end
    for i, form in enumerate(forms):
        if blocks and blocks[-1][0] == form:
            blocks[-1][2] = i + 1
        else:
            blocks.append([form, i, i + 1])
    back = [0]
    totals: dict[int, float] = {0: 0.0}
    levels: dict[int, list[int]] = {}  # number of runs before -> start points, rising; with a penalty all count as 0
    states: dict[int, _Start] = {}
    runs, low = [0], 0  # start points below `low` are dropped
    last: dict = {}  # last block of each form at or behind `low`

    every = set(forms)
    kin: dict = {}

    def alike(form) -> set:
        if form not in kin:
            kin[form] = {m for m in every if cost(form, m) < inf}
        return kin[form]

    def conflict(a, b) -> bool:
        return apart(a, b) or (cost(a, b) == inf and alike(a).isdisjoint(alike(b)))

    def total(to: int) -> float:
        """Dissimilarity of the best segmentation of the blocks before `to`."""
        chain = []
        while to not in totals:
            chain.append(to)
            to = back[to]
        for at in reversed(chain):
            own = _Start(back[at])
            own.read(blocks, at, cost)
            totals[at] = totals[back[at]] + own.cost(cost) + (penalty or 0.0)
        return totals[chain[0] if chain else to]

    for s, (form, _, _) in enumerate(blocks):
        levels.setdefault(runs[s] if penalty is None else 0, []).append(s)
        if form not in last:
            hit = max((at for f, at in last.items() if conflict(f, form)), default=-1)
            if hit >= low:
                low = hit + 1
                last = {f: at for f, at in last.items() if at >= low}
                states = {at: x for at, x in states.items() if at >= low}
                levels = {n: kept for n, v in levels.items() if (kept := [at for at in v if at >= low])}
        last[form] = s
        for n in sorted(levels):
            fit = []
            for start in levels[n]:
                state = states.get(start) or states.setdefault(start, _Start(start))
                state.read(blocks, s + 1, cost)
                if state.able:
                    fit.append(start)
            if fit:
                if len(fit) > 1:
                    fit.sort(key=lambda at: (round(total(at) + states[at].cost(cost), 9), at))
                    totals[s + 1] = total(fit[0]) + states[fit[0]].cost(cost) + (penalty or 0.0)
                back.append(fit[0])
                runs.append(runs[fit[0]] + 1)
                break
    out, at = [], len(blocks)
    while at:
        out.append((blocks[back[at]][1], blocks[at - 1][2]))
        at = back[at]
    return out[::-1]


def runs_of(events: list[tuple[int, str | None]]) -> list[tuple[str, int, int, int, str]]:
    """(kind, start, end, n, text) of each run of (second, text) events in order; a NULL text is silence."""
    out, stretch = [], []

    def close():
        for a, b in segment([tokens(t) for _, t in stretch]):
            out.append(("talk", stretch[a][0], stretch[b - 1][0], b - a, stretch[a][1]))
        stretch.clear()

    for second, text in events:
        if text is None or not tokens(text):
            close()
            if out and out[-1][0] == "silence":
                kind, start, _, n, t = out[-1]
                out[-1] = (kind, start, second, n + 1, t)
            else:
                out.append(("silence", second, second, 1, None))
        else:
            stretch.append((second, text))
    close()
    return out


def _collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["id", "kind", "start_second", "end_second", "n_events", "text"]
    for pdf in batches:
        rows = [(i, *r) for i, at, said in zip(pdf["id"], pdf["at"], pdf["said"]) for r in runs_of(list(zip(at, said)))]
        yield pd.DataFrame(rows, columns=cols).astype({"id": "int64", "start_second": "int32", "end_second": "int32", "n_events": "int32"})


def collapse(sequences: DataFrame) -> DataFrame:
    """Runs of each row of (id BIGINT, at ARRAY<INT>, said ARRAY<STRING>), both arrays in order of time.

    A NULL or wordless text is silence: it ends a run, and silences in a row form a run of kind `silence`. Empty or
    NULL arrays give no rows. A row is a whole sequence; it is cut at its silences and worked on stretch by stretch. There
    is no shuffle.
    Output: id, kind (talk, silence), start_second, end_second, n_events, text of the first event.
    """
    return sequences.where("id is not null and size(at) > 0").mapInPandas(
        _collapse, "id long, kind string, start_second int, end_second int, n_events int, text string")


def sequences_of(predictions: DataFrame) -> DataFrame:
    """Assistant turns with a pred in order of time, as `collapse` takes them; silence becomes NULL.

    Turns of one time keep their order in the row. Seconds are cut to whole ones only after the ordering.
    """
    numbered = F.transform("conversations", lambda c, i: F.struct(c["timestamp"].alias("ts"), i.alias("i"), c["from"].alias("f"), c["pred"].alias("pred")))
    turns = F.filter(numbered, lambda c: (c["f"] == "assistant") & c["pred"].isNotNull() & c["ts"].isNotNull())
    said = lambda c: F.when(~is_silence(c["pred"]) & ~is_blank(c["pred"]), c["pred"])
    ordered: Column = F.transform(F.array_sort(turns), lambda c: F.struct(c["ts"].cast("int").alias("at"), said(c).alias("said")))
    return (predictions.select(F.col("prediction_id").alias("id"), ordered.alias("e"))
            .select("id", F.col("e.at").alias("at"), F.col("e.said").alias("said")))
