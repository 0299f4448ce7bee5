"""Language of documents and of their passages, by a byte convolutional network.

The network embeds bytes, convolves them with filters of several widths, takes each filter's maximum over a window and
ends in a softmax over the languages and 'none' (log lines, code, commands, names).  It is trained in numpy on the
labelled samples (a bounded table: at most ``MAX_SAMPLES`` rows are used) and on made-up lines without language, then
applied to batches of windows of fixed length that cover each sentence whole.

Defined results: null ids are left out; null and blank texts have no sentence and give no rows; repeated ids count once;
a text without any full sentence has no language; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "none"
MAX_SAMPLES = 20_000
WINDOW = 96
STRIDE = 72
WIDTHS = (2, 3, 4)
FILTERS = 28
DIM = 12
CROPS = 10
#: A sentence's language counts from this confidence on, and as a further language of a text from the second.
SURE = 0.75
SURE_FURTHER = 0.9
#: Spellings of the seven language codes, lower case.
LABELS = {
    "en": "en eng english anglais englisch inglés ingles", "ko": "ko kor korean kr 한국어 coreano", "de": "de deu ger german deutsch allemand", "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano spanisch", "pt": "pt por portuguese português portugues portugiesisch", "nl": "nl nld dut dutch nederlands niederländisch",
}
_MARK = re.compile(r"^\s*(?:>\s*)*(?:(?:[-*+•]|\d{1,4}[.)])\s+)?(?:>\s*)*(?:#{1,6}\s+)?(?:>\s*)*(?:(?:User|Assistant|System|Tool|Human|AI|Q|A):(?:\s+|$)|\[(?:user|assistant|system|tool)\]\s+)?")
_DATE = re.compile(r"^\s*\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d\S*)?\s*")
_LOG = re.compile(
    r"^\s*(?:\[\w+\]\s*)?(?:\d{4}-\d\d-\d\dT\d\d|\$ |\{\"|at [\w/.]+:\d|\d+\t|(?:```|~~~)|(?:https?|ssh)://|import |from \w+ import|def |class |return |SELECT |INSERT |[A-Z_]+=|<[^>]+>\s*$)|^[\s\W\d_]*$"
)
_END = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+|(?<=[다요][.])\s*")
_WORD = re.compile(r"[^\W\d_]+")
_UNSEEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]|</?[A-Za-z][^<>]{0,80}>")
_LINE_NUMBER = re.compile(r"^\s*\d{1,6}\t")


def passages(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, sentence) of everything that may be a sentence: prose lines of a paragraph are read on."""
    run: list[tuple[int, int, str]] = []
    at = 0

    def flush() -> Iterator[tuple[int, int, str]]:
        if run:
            joined = " ".join(t for _, _, t in run)
            offsets, n = [], 0
            for a, _, t in run:
                offsets.append((n, a))
                n += len(t) + 1
            where = lambda x: next(a + x - n for n, a in reversed(offsets) if n <= x)
            start = 0
            for m in [*_END.finditer(joined), None]:
                end = m.start() if m else len(joined)
                piece = joined[start:end].strip()
                if piece:
                    yield where(start), where(max(start, end - 1)) + 1, piece
                start = m.end() if m else end
            run.clear()

    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        body = _LINE_NUMBER.sub("", bare)
        if _LOG.match(_MARK.sub("", bare)) and not (body != bare and len(_WORD.findall(body)) > 3 and not re.search(r"\bdef |[{}();]$", body)):
            yield from flush()
        else:
            m = _MARK.match(body)
            mark = m[0].strip() if m else ""
            if mark and not set(mark) <= {">"}:
                yield from flush()
            rest = _DATE.sub("", body[m.end() :] if m else body)
            if rest.strip():
                run.append((at + len(bare) - len(rest), at + len(bare), rest.rstrip()))
            else:
                yield from flush()
            if "#" in mark:  # a heading ends with its line
                yield from flush()
        at += len(line)
    yield from flush()


def full_sentence(piece: str) -> bool:
    """Long enough to be a sentence: four words, or three with Hangul."""
    words = _WORD.findall(piece)
    return len(words) >= 4 or (len(words) >= 3 and any("가" <= c <= "힣" for c in piece)) or sum("가" <= c <= "힣" for c in piece) >= 10


class ByteNet:
    """Bytes -> embedding -> convolutions -> maximum -> softmax."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.pairs: dict[tuple[int, int], np.ndarray] | None = None
        self.p = {"E": r.normal(0, 0.5, (256, DIM)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = (r.normal(0, 1, (w * DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["V"] = (r.normal(0, 1, (FILTERS * len(WIDTHS), len(classes))) / np.sqrt(FILTERS * len(WIDTHS))).astype(np.float32)
        self.p["c"] = np.zeros(len(classes), np.float32)

    def _pairs(self) -> dict[tuple[int, int], np.ndarray]:
        """What each pair of bytes adds to the filters at each two places of a width: the look-ups of a convolution by twos."""
        if self.pairs is None:
            one = lambda w, k: self.p["E"] @ self.p[f"W{w}"][k * DIM : (k + 1) * DIM]
            self.pairs = {
                (w, k): (one(w, k)[:, None, :] + one(w, k + 1)[None, :, :]).reshape(65_536, FILTERS) if k + 1 < w else one(w, k) for w in WIDTHS for k in range(0, w, 2)
            }
        return self.pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Rows of bytes -> class probabilities; a convolution is a sum of table look-ups, one for each two places."""
        tables = self._pairs()
        x = np.ascontiguousarray(x.T)  # places first: the maximum runs over whole rows of filters
        both = x[:-1].astype(np.int32) * 256 + x[1:]
        pooled = []
        for w in WIDTHS:
            n = x.shape[0] - w + 1
            conv = tables[w, 0][both[:n]]
            for k in range(2, w, 2):
                conv += tables[w, k][both[k : k + n] if k + 1 < w else x[k : k + n]]
            pooled.append(np.maximum(conv.max(axis=0) + self.p[f"b{w}"], 0))
        z = np.hstack(pooled) @ self.p["V"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _step(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the cross-entropy on one batch."""
        p, rows = self.p, np.arange(len(x))
        embedded = p["E"][x]
        pooled, places = [], []
        for w in WIDTHS:
            win = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, w * DIM)
            conv = win @ p[f"W{w}"] + p[f"b{w}"]
            at = conv.argmax(axis=1)
            places.append((win, at))
            pooled.append(np.maximum(np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0], 0))
        h = np.hstack(pooled) * keep
        z = h @ p["V"] + p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[rows, y] -= 1
        z /= len(x)
        g = {"V": h.T @ z, "c": z.sum(axis=0), "E": np.zeros_like(p["E"])}
        dh = (z @ p["V"].T) * keep * (h > 0)
        for i, w in enumerate(WIDTHS):
            win, at = places[i]
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            best = win[rows[:, None], at]  # batch, filter, window
            g[f"W{w}"] = np.einsum("bf,bfk->kf", d, best)
            g[f"b{w}"] = d.sum(axis=0)
            back = d[:, :, None] * p[f"W{w}"].T[None]
            for k in range(w):
                np.add.at(g["E"], x[rows[:, None], at + k].ravel(), back[:, :, k * DIM : (k + 1) * DIM].reshape(-1, DIM))
        return g

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pairs": None}  # the tables are made where they are used

    def fit(self, texts: list[str], labels: list[str], rounds: int = 16, batch: int = 64, rate: float = 6e-3, seed: int = 3) -> ByteNet:
        r = random.Random(seed)
        n = np.random.default_rng(seed)
        number = {c: i for i, c in enumerate(self.classes)}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for epoch in range(rounds):
            order = [i for i in range(len(texts)) for _ in range(CROPS)]  # another stretch each time
            r.shuffle(order)
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                x = np.vstack([_row(_varied(texts[i], r)) for i in some])
                y = np.array([number[labels[i]] for i in some])
                keep = (n.random((len(some), FILTERS * len(WIDTHS))) < 0.8).astype(np.float32) / 0.8
                g = self._step(x, y, keep)
                step += 1
                lr = rate * (1 - epoch / rounds) + 1e-4
                for k, grad in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.pairs = None
                    self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
        return self


def _row(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "replace")[:WINDOW]
    return np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8)


def _varied(text: str, r: random.Random) -> str:
    """A stretch of the text, sometimes in another case, without accents' order changed."""
    words = text.split()
    if len(words) > 5 and r.random() < 0.7:
        a = r.randrange(len(words) - 4)
        words = words[a : a + r.randint(4, 14)]
    out = " ".join(words)
    k = r.random()
    return out.upper() if k < 0.12 else out.lower() if k < 0.24 else out


def lines_without_language(n: int, seed: int = 9) -> list[str]:
    """Made-up log lines, commands, code, numbers and names."""
    r = random.Random(seed)
    part = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    name = lambda: part().capitalize() + r.choice(["note", "hub", "craft", "grid", "lens", "path", "mesh", ""])
    num = lambda: str(r.randint(0, 10 ** r.randint(1, 6)))
    kinds = [
        lambda: f"2025-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:{num()[:2]}:07Z {r.choice(['INFO', 'WARN', 'ERROR', 'DEBUG'])} [{part()}.{part()}] id={num()} took={num()}ms",
        lambda: f"$ {part()} --{part()}={part()} --shard={num()}/16 --rev={r.getrandbits(32):x}", lambda: f'{{"k": {num()}, "state": "{part()}", "v": "{num()}.{num()}"}}',
        lambda: f"def {part()}_{part()}(rows, limit={num()}): return {part()}", lambda: f"at src/{part()}/{part()}.py:{num()}", lambda: " ".join(name() for _ in range(r.randint(2, 6))),
        lambda: f"{name()} {num()}.{num()} / {name()} {num()} ({name()}), {name()}", lambda: " ".join(num() for _ in range(r.randint(4, 9))), lambda: f"https://{part()}.{part()}.example/{part()}?{part()}={num()}&id={num()}",
        lambda: f"import {part()}; {part()}.{part()}({part()}, {num()})", lambda: f"{part()} | {part()} -n {num()} > /tmp/{part()}.txt && rm -rf {part()}/", lambda: ", ".join(name() for _ in range(r.randint(4, 8))),
        lambda: f"SELECT {part()}, {part()} FROM {part()} WHERE {part()} = {num()};", lambda: f"{part()}@{part()}.example, +{num()} {num()} {num()}",
    ]
    return [r.choice(kinds)() for _ in range(n)]


@lru_cache(maxsize=4)
def trained(samples: tuple[tuple[str, str], ...]) -> ByteNet:
    """Network fitted on (lang, text) rows; the same rows are learned once in a session."""
    texts, labels = [], []
    for lang, text in samples:
        for _, _, piece in passages(text):
            texts.append(piece)
            labels.append(lang)
    per_class = max(60, len(texts) // 4)
    texts += lines_without_language(per_class)
    labels += [NONE] * per_class
    return ByteNet([*sorted({lang for lang, _ in samples}), NONE]).fit(texts, labels)


def classify(net: ByteNet, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(class number, confidence) of each piece; longer pieces are read in overlapping windows, all of them."""
    rows, owner = [], []
    for i, piece in enumerate(pieces):
        raw = _UNSEEN.sub("", piece).encode("utf-8", "replace")
        for a in range(0, max(1, len(raw) - (WINDOW - STRIDE)), STRIDE):
            rows.append(raw[a : a + WINDOW])
            owner.append(i)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0)
    owner_of = np.array(owner)
    sizes = np.array([len(x) for x in rows])
    logs = np.empty((len(rows), len(net.classes)))
    for low, high in ((0, 48), (48, 72), (72, WINDOW)):
        some = np.flatnonzero((sizes > low) & (sizes <= high) | ((sizes == 0) & (low == 0)))
        for a in range(0, len(some), 512):
            at = some[a : a + 512]
            x = np.frombuffer(b"".join(rows[i].ljust(high, b"\0") for i in at), np.uint8).reshape(len(at), high)
            logs[at] = np.log(net.probabilities(x) + 1e-9)
    total = np.zeros((len(pieces), len(net.classes)))
    weight = np.zeros(len(pieces))
    np.add.at(total, owner_of, logs * sizes[:, None])
    np.add.at(weight, owner_of, sizes)
    mean = np.exp(total / np.maximum(1, weight)[:, None])
    mean /= mean.sum(axis=1, keepdims=True)
    return mean.argmax(axis=1), mean.max(axis=1)


def segments(documents: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, sentences, confidence, share): the languages of each document with at least one full sentence.

    confidence is that of the surest sentence; share the part of the document's sentences in that language.
    """
    return _applied(documents, samples, id_col, text_col, whole=True)


def spans(documents: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_char, end_char, lang, confidence): each run of sentences in one language."""
    return _applied(documents, samples, id_col, text_col, whole=False)


def _applied(documents: DataFrame, samples: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    labelled = samples.filter("lang is not null and text is not null").orderBy("sample_id").limit(MAX_SAMPLES).select("lang", "text").collect()
    net = documents.sparkSession.sparkContext.broadcast(trained(tuple(tuple(x) for x in labelled)))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body")).filter(
        F.col("doc_id").isNotNull() & (F.length("body") > 0)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = net.value
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.iloc[a : a + 1000]
                pieces, where = [], []
                for doc, body in zip(part["doc_id"], part["body"], strict=True):
                    for start, end, piece in passages(body):
                        if full_sentence(piece):
                            pieces.append(piece)
                            where.append((doc, start, end))
                kind, sure = classify(model, pieces)
                found: dict[int, list[tuple[int, int, str, float]]] = {}
                for (doc, start, end), k, c in zip(where, kind, sure, strict=True):
                    if model.classes[k] != NONE:
                        found.setdefault(doc, []).append((start, end, model.classes[k], float(c)))
                out = []
                for doc, got in found.items():
                    out += _languages(doc, got) if whole else _runs(doc, got)
                yield pd.DataFrame(out, columns=["doc_id", "lang", "sentences", "confidence", "share"] if whole else ["doc_id", "start_char", "end_char", "lang", "confidence"])

    kind = "doc_id long, lang string, sentences int, confidence double, share double" if whole else "doc_id long, start_char int, end_char int, lang string, confidence double"
    return rows.mapInPandas(run, kind).dropDuplicates(["doc_id", "lang"] if whole else ["doc_id", "start_char"])


def _main(got: list[tuple[int, int, str, float]]) -> str:
    """The language with most confidence-weighted text."""
    weight: dict[str, float] = {}
    for start, end, lang, c in got:
        weight[lang] = weight.get(lang, 0.0) + c * (end - start)
    return max(sorted(weight), key=weight.get)


def _counted(got: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Sentences that are sure enough: a language other than the main one needs more."""
    main = _main(got)
    return [x for x in got if x[3] >= (SURE if x[2] == main else SURE_FURTHER)]


def _languages(doc: int, got: list[tuple[int, int, str, float]]) -> list[tuple[int, str, int, float, float]]:
    sure = _counted(got)
    out = []
    for lang in sorted({x[2] for x in sure}):
        own = [x for x in sure if x[2] == lang]
        out.append((doc, lang, len(own), max(x[3] for x in own), len(own) / len(got)))
    return out


def _runs(doc: int, got: list[tuple[int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    out: list[list] = []
    for start, end, lang, c in _counted(got):
        if out and out[-1][3] == lang:
            out[-1][2] = end
            out[-1][4].append(c)
        else:
            out.append([doc, start, end, lang, [c]])
    return [(d, a, b, lang, sum(c) / len(c)) for d, a, b, lang, c in out]


def label_language(label: Column) -> Column:
    """The language that a label names: one of the codes, '?' if it names another or none."""
    bare = F.lower(F.trim(label))
    base = F.regexp_extract(bare, r"^([^\s_\-(]+)", 1)
    out = F.lit("?")
    for code, names in LABELS.items():
        out = F.when(base.isin(names.split()) | bare.isin(names.split()), F.lit(code)).otherwise(out)
    return F.coalesce(out, F.lit("?"))


def mislabelled(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of each document whose label is missing, unusable or wrong, or that mixes several."""
    found = segments(documents, samples)
    labels = documents.select("doc_id", label_language(F.col("lang")).alias("label")).filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    wrong = (
        found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("lang").alias("langs")).join(labels, "doc_id")
        .filter((F.col("n") > 1) | ~F.array_contains("langs", F.col("label")))
    )
    return wrong.select("doc_id", F.explode("langs").alias("lang"))
