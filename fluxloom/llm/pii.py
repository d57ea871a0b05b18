"""Personal information inside free text (problem 10).

A semi-Markov conditional random field over candidate segments: every candidate (start, end, kind) is scored as a whole
by its shape, its words and its surroundings, and dynamic programming over the candidates of a text chooses the set of
segments that do not overlap with the highest score, boundaries and kinds jointly. Candidates are bounded: a kind's
patterns say how long it can be. The weights are learned here, from segments of the corpus that their wording labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "person": "[PERSON]"}

_W = r"[^\W\d_]"  # a letter
_TOWN = rf"{_W}[\w'’-]+(?:\s+{_W}[\w'’-]+)?"
_DOT = r"[.!]{0,2}"
# The written forms of each kind. Spaces may be line breaks.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "email": [
        ("sign", r"[\w.+\-]*\w\s?@\s?[\w\-]+(?:\.[\w\-]+)*\.[a-z]{2,}\b"),
        ("boxed", r"[\w.+\-]*\w\s?(?:\[at\]|\(at\))\s?[\w\-]+(?:\s?(?:\.|\[dot\]|\(dot\))\s?[\w\-]+)+"),
        ("spoken", r"[\w.+\-]*\w\s+at\s+[\w\-]+(?:\s+dot\s+[\w\-]+)+"),
    ],
    "phone": [
        ("north", r"(?<![\w+(.\-/])(?:\+?1[\s.\-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]?\d{3}[\s.\-]?\d{4}(?![\w\-]|\.\d)"),
        ("uk", r"(?<![\w+(.\-/])(?:(?:\+|00)44\s?(?:\(0\)\s?)?|0|\(0)\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}(?![\w\-]|\.\d)"),
        ("de", r"(?<![\w+(.\-/])(?:(?:\+|00)49\s?(?:\(0\)\s?)?|0|\(0)\d{2,4}\)?[\s/\-]*\d{5}\s?\d{3}(?![\w\-]|\.\d)"),
        ("fr", r"(?<![\w+(.\-/])(?:(?:\+|00)33\s?(?:\(0\)\s?)?|0)[\s.\-]?\d(?:[\s.\-]?\d{2}){4}(?![\w\-]|\.\d)"),
        ("es", r"(?<![\w+(.\-/])(?:(?:\+|00)34[\s.\-]?)?\d{3}(?:[\s.\-]?\d{3}[\s.\-]?\d{3}|(?:[\s.\-]?\d{2}){3})(?![\w\-]|\.\d)"),
        ("world", r"(?<![\w+(.\-/])\+\d{1,3}(?:[\s.\-/]?\(?\d{1,4}\)?){2,5}\d(?![\w\-]|\.\d)"),
    ],
    "id_number": [
        ("letters", r"(?<![\w\-])[a-z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[a-z](?![\w\-])"),
        ("serial", r"(?<![\w\-])[a-z]{1,2}\d{6,9}(?![\w\-])"),
        ("check", r"(?<![\w\-])\d{7,8}[\s\-]?[a-z](?![\w\-])"),
        ("social", r"(?<![\w\-])\d{3}[\s\-]?\d{2}[\s\-]?\d{4}(?![\w\-])"),
        ("french", r"(?<![\w\-])\d\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}(?:\s?\d{2})?(?![\w\-])"),
        ("tax", r"(?<![\w\-])\d{2}\s?\d{3}\s?\d{3}\s?\d{3}(?![\w\-])"),
        ("model", r"(?<![\w\-])[a-z]{2}-\d{7}(?![\w\-])"),
        ("order", r"(?<![\w\-])\d{4}-\d{6}(?![\w\-])"),
    ],
    "address": [
        (
            "en",
            rf"(?<!\w)\d{{1,4}}[a-z]?\s+(?:[\w'’.\-]+\s+){{1,3}}?(?:street|st|road|rd|lane|ln|court|ct|avenue|ave|drive|way|close|row|terrace|square){_DOT}"
            rf"(?:\s*,?\s*(?:apt|apartment|flat|unit|suite){_DOT}\s*#?\d+\w?)?\s*,?\s+{_TOWN}(?:\s*,?\s+(?:[a-z]{{1,2}}\d{{1,2}}[a-z]?\s+\d[a-z]{{2}}|(?:[a-z]{{2}}\s+)?\d{{5}}(?:-\d{{4}})?))(?!\w)",
        ),
        ("fr", rf"(?<!\w)\d{{1,4}}(?:\s+(?:bis|ter|quater))?\s*,?\s+(?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|route|cours)\s+(?:[\w'’\-]+\s+){{0,4}}?[\w'’\-]+\s*,\s*\d{{5}}\s+(?:(?:le|la|les|saint|sainte)\s+)?{_W}[\w'’\-]+"),
        ("de", rf"(?<!\w)(?:(?!(?:der|die|das|den|dem|in|im|an|am|zur|zum|auf)\s){_W}[\w\-]+\s+)?{_W}*(?:str\.|str!!|straße|strasse|gasse|weg|allee|platz|ring|ufer|damm)\s+\d{{1,4}}\s?[a-z]?\s*,\s*\d{{5}}\s+{_W}[\w'’\-]+"),
        ("es", rf"(?<!\w)(?:calle|c/|avda{_DOT}|avenida|plaza|paseo|camino|ronda)\s+(?:[\w'’\-]+\s+){{1,4}}?\d{{1,4}}(?:\s*,\s*\d{{1,2}}\s?[ºª°]\s?\w)?\s*,\s*\d{{5}}\s+{_W}[\w'’\-]+"),
    ],
}
COMPILED = {kind: [(name, re.compile(p, re.I)) for name, p in forms] for kind, forms in PATTERNS.items()}

# Words before a segment that label it for training, and words that label it as something else.
CUES = {
    "phone": {"tel", "tél", "call", "ring", "text", "number", "phone", "appelez", "llamadme", "unter", "mobile"},
    "id_number": {"ssn", "passport", "insurance", "dni", "nie", "pasaporte", "passeport", "ausweisnummer", "steuer-id", "sociale", "d'identité", "identité", "card"},
    "person": {"mr", "mrs", "ms", "mme", "madame", "monsieur", "frau", "herr", "herrn", "señor", "señora", "dr", "driver", "signed", "gezeichnet", "regards", "grüße", "saludos", "cordialement"},
}
NOT_PERSONAL = {"part", "pieza", "pièce", "ersatzteil", "order", "pedido", "commande", "bestellung", "serial", "model", "modell", "modelo", "modèle", "code", "edition"}
#: Texts worth a place in the training sample: those that name a cue, thank or sign.
SAMPLED = rf"\b(?:{'|'.join(sorted({re.escape(c) for words in CUES.values() for c in words} - {'number', 'text', 'card', 'unter'}))})\b|@|—\s*\p{{L}}|\b(?:thanks to|danke|gracias|merci)\b"
#: Kinds of words (see _name_flags) that make a name of a form for sure, used to label.
SURE_NAMES = {"plain": {"gf", "ga"}, "comma": {"fg", "ag"}, "initial": {"if", "ia"}, "three": {"ggf", "gga"}}
PARTICLES = {"von", "van", "de", "del", "der", "du", "la", "le", "zu", "di"}
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*(?:-[^\W_]+)*")
#: Between the words of a name: blanks and at most one line break.
_GAP = re.compile(r"[^\S\n]{1,3}\n?[^\S\n]{0,3}|\n[^\S\n]{0,3}")
_INITIAL = re.compile(r"\.[^\S\n]{0,3}\n?")
_MAIL_GOES_ON = re.compile(r"\s?(?:@|\[at\]|\(at\)|at\s[\w-]+\sdot)")
_NAME = re.compile(rf"{_W}+(?:['’]{_W}+)*(?:-{_W}+)*")


#: What a text must hold for a form of the kind to occur in it: a run of six digits, a postcode.
_NEEDS = {
    "phone": re.compile(r"\d(?:[\s.\-/()]{0,4}\d){5}"),
    "id_number": re.compile(r"\d(?:[\s.\-/()]{0,4}\d){5}"),
    "address": re.compile(r"\d{5}|[a-z]{1,2}\d{1,2}[a-z]?\s+\d[a-z]{2}", re.I),
}
_AT = {"sign": re.compile("@"), "boxed": re.compile(r"[\[(]at[\])]", re.I), "spoken": re.compile(r"\sdot\s", re.I)}


@dataclass
class Model:
    """Feature weights, and the words seen as given and family names in training."""

    weights: dict[str, float] = field(default_factory=dict)
    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the model as a table (part, key, value); its size is that of the vocabulary, not of the corpus."""
        rows = [("weight", k, v) for k, v in self.weights.items()] + [("given", w, 1.0) for w in self.given] + [("family", w, 1.0) for w in self.family]
        spark.createDataFrame(rows, "part string, key string, value double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path).collect()
        return cls({r["key"]: r["value"] for r in rows if r["part"] == "weight"}, *(frozenset(r["key"] for r in rows if r["part"] == part) for part in ("given", "family")))


def _around(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = [w.lower() for w in _TOKEN.findall(text[max(0, start - 48) : start])[-3:]]
    after = [w.lower() for w in _TOKEN.findall(text[end : end + 32])[:2]]
    return before, after


def _name_spans(text: str, known: frozenset[str]) -> Iterator[tuple[int, int, str]]:
    """Candidate names: two name words (initial, particle and comma forms too) of which one is cued, known or written as a name."""
    tokens = [(m.start(), m.end(), m.group()) for m in _NAME.finditer(text)]
    n = len(tokens)
    lows = [t[2].lower() for t in tokens]
    is_listed = [low in known or ("-" in low and any(p in known for p in low.split("-"))) for low in lows]
    gap = [text[tokens[k][1] : tokens[k + 1][0]] for k in range(n - 1)]
    for k in range(n - 1):
        s, e, w = tokens[k]
        listed = is_listed[k]
        cue = k > 0 and lows[k - 1] in CUES["person"]
        big = w[0].isupper()
        g = gap[k]
        initial = len(w) == 1 and g[:1] == "."
        if not (big or listed or cue or initial):
            continue
        if (s and (text[s - 1] in "@._+/\\" or text[s - 1].isdigit())) or "-" in text[max(0, s - 1) : s]:
            continue
        j = k + 1
        form = ""
        if initial and _INITIAL.fullmatch(g):
            form = "initial"
        elif g[:1] == "," and _GAP.fullmatch(g[1:]):
            form = "comma"
        elif g == " " or _GAP.fullmatch(g):
            form = "plain"
        if not form:
            continue
        if form != "comma" and lows[j] in PARTICLES and j + 1 < n:
            while j + 1 < n and lows[j] in PARTICLES and _GAP.fullmatch(gap[j]):
                j += 1
            form += "_of"
        s2, e2, w2 = tokens[j]
        if not (w2[0].isupper() or is_listed[j] or (cue and listed)):
            continue
        if text[e2 : e2 + 1] in {"@", "_"} or text[e2 : e2 + 1].isdigit() or _MAIL_GOES_ON.match(text[e2 : e2 + 40]) or len(w2) < 2:
            continue
        listed2 = is_listed[j]
        if form == "comma" and not (listed or listed2 or cue):
            continue
        yield s, e2, form
        # two given names before the family name
        if form == "plain" and listed and listed2 and j + 1 < n and _GAP.fullmatch(gap[j]) and lows[j + 1] in known:
            yield s, tokens[j + 1][1], "three"


def candidates(text: str, model: Model) -> list[tuple[int, int, str, str]]:
    """All candidate segments (start, end, kind, form) of a text."""
    out = []
    for kind, forms in COMPILED.items():
        if kind in _NEEDS and not _NEEDS[kind].search(text):
            continue
        for form, rx in forms:
            if kind == "email" and not _AT[form].search(text):
                continue
            at = 0
            while m := rx.search(text, at):
                s, e = m.span()
                out.append((s, e, kind, form))
                at = e if kind in ("email", "address") else s + 1
    known = model.given | model.family
    out += [(s, e, "person", form) for s, e, form in _name_spans(text, known)]
    return out


def features(text: str, cand: tuple[int, int, str, str], model: Model) -> list[str]:
    """Whole-span features of a candidate, each prefixed by its kind."""
    s, e, kind, form = cand
    before, after = _around(text, s, e)
    span = text[s:e]
    f = [f"{kind}:bias", f"{kind}:form={form}"]
    f += [f"{kind}:l{len(before) - i}={w}" for i, w in enumerate(before)] + [f"{kind}:near={w}" for w in set(before)]
    f += [f"{kind}:r{i + 1}={w}" for i, w in enumerate(after)]
    cued = set(before)
    for other, words in CUES.items():
        if cued & words:
            f.append(f"{kind}:cue={other}")
    if kind == "person":
        if after and after[0] == "edition":
            f.append("person:not")
    elif cued & NOT_PERSONAL:
        f.append(f"{kind}:not")
    if kind == "person":
        words = [w for w in _NAME.findall(span) if w.lower() not in PARTICLES]
        flags = _name_flags(span, model)
        f += [f"person:words={form}:{flags}", f"person:sure={flags in SURE_NAMES[form.split('_')[0]]}"]
        f.append(f"person:case={''.join('U' if w.isupper() and len(w) > 1 else 'C' if w[0].isupper() else 'l' for w in words[:3])}")
    else:
        digits = sum(c.isdigit() for c in span)
        f.append(f"{kind}:digits={digits}")
        f.append(f"{kind}:mask={re.sub(r'[a-zA-Z]', 'a', re.sub(r'[0-9]', '9', span))[:6]}" if kind in ("phone", "id_number") else f"{kind}:words={min(9, len(span.split()))}")
        if kind in ("phone", "id_number"):
            next_ = text[e : e + 2].strip()
            f.append(f"{kind}:runs_on={bool(next_) and next_[0].isdigit()}")
    return f


def _name_flags(span: str, model: Model) -> str:
    """Per word of a name: initial, given, family, like a family name (a), other."""
    out = ""
    for w in [w for w in _NAME.findall(span) if w.lower() not in PARTICLES][:3]:
        low = w.lower()
        out += "i" if len(w) == 1 else "g" if all(p in model.given for p in low.split("-")) else "f" if low in model.family else "a" if _family_like(low, model) else "o"
    return out


def _family_like(word: str, model: Model) -> bool:
    """A word put together from the beginning of one known family name and the end of another."""
    heads, tails = _parts(model.family)
    return any(word[:k] in heads and word[k:] in tails for k in range(3, len(word) - 2))


_PARTS: dict[int, tuple[frozenset[str], frozenset[str]]] = {}


def _parts(family: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Beginnings and endings that at least three family names share in at least three combinations."""
    key = hash(family)
    if key not in _PARTS:
        heads, tails = Counter(), Counter()
        for w in family:
            for k in range(3, len(w) - 2):
                heads[w[:k]] += 1
                tails[w[k:]] += 1
        _PARTS.clear()
        _PARTS[key] = (frozenset(h for h, n in heads.items() if n >= 3), frozenset(t for t, n in tails.items() if n >= 3))
    return _PARTS[key]


def _clusters(cands: list[tuple[int, int, str, str]]) -> Iterator[list[tuple[int, int, str, str]]]:
    """Groups of candidates linked by overlap; groups are independent of each other."""
    group, stop = [], -1
    for c in sorted(set(cands)):
        if group and c[0] >= stop:
            yield group
            group, stop = [], -1
        group.append(c)
        stop = max(stop, c[1])
    if group:
        yield group


def best_segments(text: str, model: Model) -> list[tuple[int, int, str]]:
    """Segments (start, end, kind) of the highest-scoring labelling of a text."""
    out = []
    for group in _clusters(candidates(text, model)):
        group = sorted(group, key=lambda c: c[1])
        scores = [sum(model.weights.get(f, 0.0) for f in features(text, c, model)) for c in group]
        ends = [c[1] for c in group]
        best, take = [0.0], []
        for i, c in enumerate(group):
            p = int(np.searchsorted(ends, c[0], side="right"))
            with_ = best[min(p, i)] + scores[i]
            take.append(with_ > best[i])
            best.append(max(best[i], with_))
        i = len(group)
        while i > 0:
            if take[i - 1]:
                out.append(group[i - 1][:3])
                i = min(int(np.searchsorted(ends, group[i - 1][0], side="right")), i - 1)
            else:
                i -= 1
    return sorted(out)


def _label(text: str, group: list[tuple[int, int, str, str]], model: Model) -> list[bool] | None:
    """Which candidates of a group are right, by the wording around them; None where the wording does not tell."""
    gold = [False] * len(group)
    told = False
    for i, (s, e, kind, form) in enumerate(group):
        before, after = _around(text, s, e)
        if kind in ("email", "address"):
            told = True
            longer = [c for c in group if c[2] == kind and (c[0] <= s and c[1] >= e) and c[:2] != (s, e)]
            gold[i] = not longer
        elif kind != "person" and set(before[-2:]) & NOT_PERSONAL or kind == "person" and after and after[0] == "edition":
            told = True
        elif kind == "person" and _name_flags(text[s:e], model) in SURE_NAMES[form.split("_")[0]]:
            told = gold[i] = True
        elif kind == "person" and set(_name_flags(text[s:e], model)) == {"o"} and not (before and before[-1] in CUES["person"]):
            told = True
        elif kind in CUES:
            nearest = next((o for w in reversed(before) for o in ("phone", "id_number") if w in CUES[o]), None)
            if kind == "person":
                cue = bool(before) and before[-1] in CUES["person"]
            else:
                cue = kind == nearest
            if cue:
                told = True
                gold[i] = not any(c[2] == kind and c[:2] != (s, e) and c[0] <= s and c[1] >= e for c in group)
            elif nearest:
                told = True
    if not told:
        return None
    seen: list[tuple[int, int]] = []
    for i in sorted(range(len(group)), key=lambda i: group[i][0] - group[i][1]):
        if gold[i]:
            if any(group[i][0] < b and group[i][1] > a for a, b in seen):
                gold[i] = False
            else:
                seen.append(group[i][:2])
    return gold


_LEAD = "|".join(sorted(CUES["person"], key=len, reverse=True))
_CUED_NAME = re.compile(rf"\b(?:{_LEAD})\b[.,:]?\s+({_W}+(?:-{_W}+)*)\s+(?:(?:{'|'.join(PARTICLES)})\s+)?({_W}+)\b", re.I)


def _cued_names(texts: Iterable[str]) -> tuple[Counter, Counter]:
    """How often words stand as a given and as a family name after a title or a closing formula."""
    first, last = Counter(), Counter()
    for t in texts:
        for m in _CUED_NAME.finditer(t):
            if m.group(1)[0].isupper() and m.group(2)[0].isupper():
                for p in m.group(1).lower().split("-"):
                    first[p] += 1
                last[m.group(2).lower()] += 1
    return first, last


def _name_lists(first: Counter, last: Counter) -> tuple[frozenset[str], frozenset[str]]:
    """Given and family names from the counts of cued words."""
    given = {w for w, n in first.items() if n >= 3 and len(w) > 2 and first[w] > 2 * last[w]}
    family = {w for w, n in last.items() if n >= 1 and len(w) > 3 and last[w] > first[w]}
    return frozenset(given), frozenset(family)


def corpus_names(docs: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Given and family names that are cued anywhere in ``docs``: all texts, whole, counted by an aggregation.

    Only the kept words reach the driver; they grow with the vocabulary of names, not with the rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, last = _cued_names(batch["text"])
            rows = [(w, first[w], last[w]) for w in first.keys() | last.keys()]
            yield pd.DataFrame(rows, columns=["word", "first", "last"])

    texts = docs.select("text").where(F.col("text").isNotNull())
    counts = texts.mapInPandas(run, "word string, first long, last long").groupBy("word").agg(F.sum("first").alias("first"), F.sum("last").alias("last"))
    words = counts.where((F.col("first") >= 3) | (F.col("last") > F.col("first"))).collect()
    return _name_lists(Counter({r["word"]: r["first"] for r in words}), Counter({r["word"]: r["last"] for r in words}))


def fit(texts: list[str], epochs: int = 8, rate: float = 0.3, ridge: float = 1e-4, names: tuple[frozenset[str], frozenset[str]] | None = None) -> Model:
    """Fit the weights by gradient ascent on the conditional likelihood of the labelled groups (AdaGrad).

    ``names`` are the lists of given and family names; without them, those cued in ``texts``.
    """
    given, family = names or _name_lists(*_cued_names(texts))
    model = Model({}, given, family)
    train = []
    for t in texts:
        for group in _clusters(candidates(t, model)):
            group = sorted(group, key=lambda c: c[1])
            gold = _label(t, group, model)
            if gold is not None:
                train.append(([c[1] for c in group], [c[0] for c in group], [features(t, c, model) for c in group], gold))
    w, g2 = model.weights, Counter()
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(train)):
            ends, starts, feats, gold = train[k]
            n = len(ends)
            score = [sum(w.get(f, 0.0) for f in fs) for fs in feats]
            back = [min(int(np.searchsorted(ends, s, side="right")), i) for i, s in enumerate(starts)]
            alpha = [0.0]
            for i in range(n):
                a, b = alpha[i], alpha[back[i]] + score[i]
                alpha.append(max(a, b) + math.log1p(math.exp(-abs(a - b))))
            beta = [-math.inf] * (n + 1)
            beta[n] = 0.0
            p = [0.0] * n
            for i in range(n, 0, -1):
                p[i - 1] = math.exp(min(0.0, alpha[back[i - 1]] + score[i - 1] + beta[i] - alpha[n]))
                for to, x in ((i - 1, beta[i]), (back[i - 1], beta[i] + score[i - 1])):
                    m = max(beta[to], x)
                    beta[to] = m if m == -math.inf else m + math.log(math.exp(beta[to] - m) + math.exp(x - m))
            for i in range(n):
                d = float(gold[i]) - p[i]
                if abs(d) < 1e-3:
                    continue
                for f in feats[i]:
                    step = d - ridge * w.get(f, 0.0)
                    g2[f] += step * step
                    w[f] = w.get(f, 0.0) + rate * step / (1e-6 + math.sqrt(g2[f]))
    return model


def train_model(docs: DataFrame, sample_docs: int = 6000) -> Model:
    """Name lists from all texts; weights from at most ``sample_docs`` whole texts whose wording labels segments, by hash
    order of doc_id."""
    labelled = docs.where(F.lower("text").rlike(SAMPLED))
    rows = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).select("text").collect()
    return fit([r["text"] for r in rows], names=corpus_names(docs))


def find_personal_data(docs: DataFrame, model: Model | None = None, sample_docs: int = 6000) -> DataFrame:
    """doc_id, kind, start_pos, end_pos (code points from 0, end exclusive) of the personal data in ``text``.

    Whole texts are read, in parallel and without a shuffle; the model (a few thousand weights and the name lists)
    travels with the tasks. NULL and blank texts have none; repeated rows are reported like single ones.
    """
    model = model or train_model(docs, sample_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, kind, s, e) for i, t in zip(batch["doc_id"], batch["text"]) for s, e, kind in best_segments(t, model)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos", "end_pos"])

    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return texts.mapInPandas(run, "doc_id long, kind string, start_pos int, end_pos int")


def redact(docs: DataFrame, model: Model | None = None, sample_docs: int = 6000) -> DataFrame:
    """doc_id, text with typed placeholders for the personal data, and the number of placeholders."""
    model = model or train_model(docs, sample_docs)

    def clean(text: str | None) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        parts, at, found = [], 0, best_segments(text, model)
        for s, e, kind in found:
            parts += [text[at:s], PLACEHOLDER[kind]]
            at = e
        return "".join([*parts, text[at:]]), len(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [clean(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [d[0] for d in done], "n_found": [d[1] for d in done]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string, n_found int")
