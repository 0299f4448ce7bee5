"""Evaluation texts that leaked into training text.

Method: every shard of documents is turned into a suffix array over its words, every suffix of every test item (one per
word) is binary-searched in it, and each match is followed to its end: the longest verbatim matches with their places.
A document is affected if matches of one item line up to a stretch of at least ``STRETCH`` consecutive words of the
item with about one word in eight changed, dropped or added at most.

Texts are compared as letters and digits only, in compatible form and folded case, so case, punctuation, spacing, line
layout, invisible characters, markup and escapes play no part.  The array holds a suffix for every word start and, in
words longer than ``RUN_TOGETHER`` bytes, for every letter, since words may be written without blanks.  It is in full
order as far as the longest item reaches; no search compares more.  Equal texts of a shard are searched once.

Shards (of about ``SHARD_CHARS`` characters) and packs of items (of at most about ``PACK_CHARS``) are rows of two tables
that meet in a join of all shards with all packs; neither is ever collected.

Defined results: documents or items with a null id or text give no rows, nor do items of fewer than ``STRETCH`` words;
repeated ids count once; a document that holds several items gives a row for each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 12
#: A match counts from so many words and bytes on.
SEED_WORDS = 3
LEAST_BYTES = 8
LEAST_SEEDS = 4
#: Bytes between two matches of one stretch, at most.
NEAR = 160
RUN_TOGETHER = 24
SHARD_CHARS = 2_000_000
PACK_CHARS = 4_000_000
#: Packs of so many characters together are sent to every executor; more are joined by Spark as it sees fit.
SENT_CHARS = 32_000_000
WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[nrtbf]|\\(?=[\"'/\\*_#`>\[\](){}~|.!+-])")
_LINE_MARK = re.compile(r"(?m)^[ \t]*(?:>[> \t]*)?(?:\d{1,6}(?:\t|[ ]?[|:][ \t]))?")
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")


def words_of(text: str) -> list[str]:
    """Words without case, markup, escapes and invisible characters."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else (" " if m[0][1:] else ""), text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    text = _HIDDEN.sub("", _LINE_MARK.sub("", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.casefold())


class Items:
    """Test items as bytes of their words, with the seed of every suffix."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.raw, self.starts = [], [], [], []
        self.hidden = []  # whether words stand in an item that are too short for a match of their own
        first, owner, place, size = [], [], [], []
        for item_id, text in rows:
            words = [w.encode() for w in words_of(text)]
            if len(words) < STRETCH:
                continue
            at = len(self.ids)
            starts = np.cumsum([0] + [len(w) for w in words])
            self.ids.append(item_id)
            self.words.append(words)
            self.hidden.append(bool((starts[SEED_WORDS:] - starts[:-SEED_WORDS] < LEAST_BYTES).any()))
            self.raw.append(b"".join(words))
            self.starts.append(starts)
            for k in range(len(words) - SEED_WORDS + 1):
                end = k + SEED_WORDS
                while end < len(words) and starts[end] - starts[k] < LEAST_BYTES:
                    end += 1
                if starts[end] - starts[k] >= LEAST_BYTES:
                    first.append(self.raw[at][starts[k] : starts[k] + 8])
                    owner.append(at)
                    place.append(k)
                    size.append(starts[end] - starts[k])
        self.first = np.frombuffer(b"".join(first), ">u8").astype(np.uint64)
        self.owner, self.place, self.size = (np.array(x, np.int64) for x in (owner, place, size))
        self.longest = max(map(len, self.raw), default=0)
        self._masks: dict[int, dict[bytes, int]] = {}


    def masks(self, item: int) -> dict[bytes, int]:
        """For each word of an item the bits of its places."""
        if item not in self._masks:
            out: dict[bytes, int] = {}
            for i, w in enumerate(self.words[item]):
                out[w] = out.get(w, 0) | 1 << i
            self._masks[item] = out
        return self._masks[item]


class Shard:
    """Suffix array of the texts' words; ``order`` lists byte positions, ``first`` the eight bytes that stand there."""

    def __init__(self, texts: list[str]):
        parts, starts, inner, self.firsts, at = [], [], [], [], 0
        for text in texts:
            self.firsts.append(at)
            for w in words_of(text):
                b = w.encode()
                starts.append(at)
                if len(b) > RUN_TOGETHER:
                    inner += [at + i for i in range(1, len(b)) if b[i] & 0xC0 != 0x80]
                parts.append(b)
                at += len(b)
            parts.append(b"\0")  # no match runs over the end of a document
            at += 1
        self.raw = b"".join(parts)
        self.starts = np.array(starts, np.int64)
        self.places = np.sort(np.concatenate([self.starts, np.array(inner, np.int64)]))
        self.depth = 0

    def sort(self, depth: int) -> None:
        """Put the suffixes in order by their first ``depth`` bytes: eight at a time, only what is still equal again."""
        if self.depth >= max(8, depth):
            return
        self.depth = max(8, depth)
        text = np.frombuffer(self.raw + b"\0" * (self.depth + 16), np.uint8)
        eight = np.lib.stride_tricks.sliding_window_view(text, 8)
        key_at = lambda at: np.ascontiguousarray(eight[at]).view(">u8").ravel().astype(np.uint64)
        keys = key_at(self.places)
        order = np.argsort(keys, kind="stable")
        self.order, self.first = self.places[order], keys[order]
        group = np.cumsum(np.r_[0, (self.first[1:] != self.first[:-1]).astype(np.int64)]) if len(order) else order
        where = np.arange(len(order))
        for offset in range(8, self.depth, 8):
            # Groups of one are done, and so is a group at whose suffixes a document ends.
            sizes = np.bincount(group) if len(group) else group
            tied = sizes[group] > 1 if len(group) else np.zeros(0, bool)
            where, group = where[tied], group[tied]
            if not len(where):
                break
            keys = key_at(np.minimum(self.order[where] + offset, len(self.raw)))
            by = np.lexsort((keys, group))
            self.order[where] = self.order[where][by]
            keys, group = keys[by], group[by]
            group = np.cumsum(np.r_[0, ((group[1:] != group[:-1]) | (keys[1:] != keys[:-1])).astype(np.int64)])

    def holding(self, prefix: bytes, low: int, high: int) -> tuple[int, int]:
        """The part of order[low:high] whose suffixes begin with ``prefix``, by binary search."""
        n, raw, order = len(prefix), self.raw, self.order
        at = lambda i: raw[order[i] : order[i] + n]
        a = bisect_left(range(low, high), prefix, key=at) + low
        b = bisect_left(range(a, high), True, key=lambda i: at(i) > prefix) + a
        return a, b


def _common(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the longest verbatim match of a[i:] and b[j:]."""
    most = min(len(a) - i, len(b) - j)
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] == b[j + done : j + done + step]:
            done += step
            step *= 2
        elif step == 1:
            break
        else:
            step = max(1, step // 2) if step > 8 else 1
    return done


def hits(items: Items, shard: Shard) -> np.ndarray:
    """(document, item, word of the item, byte place) of every suffix of the items that a suffix of the shard begins like."""
    shard.sort(items.longest)
    low, high = np.searchsorted(shard.first, items.first), np.searchsorted(shard.first, items.first, "right")
    some = np.flatnonzero(high > low)
    ranges = np.array([shard.holding(items.raw[items.owner[s]][(at := int(items.starts[items.owner[s]][items.place[s]])) : at + int(items.size[s])], int(low[s]), int(high[s])) for s in some], np.int64).reshape(-1, 2)
    n = ranges[:, 1] - ranges[:, 0]
    if not n.sum():
        return np.zeros((0, 4), np.int64)
    again = np.repeat(np.arange(len(some)), n)
    place = shard.order[np.repeat(ranges[:, 0], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    doc = np.searchsorted(np.array(shard.firsts), place, "right") - 1
    return np.column_stack([doc, items.owner[some][again], items.place[some][again], place])


def followed(items: Items, shard: Shard, found: np.ndarray) -> np.ndarray:
    """The hits with the bytes for which each goes on verbatim."""
    sizes = [_common(items.raw[item], int(items.starts[item][k]), shard.raw, p) for _, item, k, p in found.tolist()]
    return np.column_stack([found, np.array(sizes, np.int64)])


def search(items: Items, texts: list[str], shard: Shard | None = None) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words of the longest match, its word in the item, its word in the text) for every leak in a shard."""
    shard = Shard(texts) if shard is None else shard
    found = hits(items, shard)
    if not len(found):
        return []
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    # A run ends where the document or the item changes or the next hit is far away; short ones are no stretch.
    new = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1) | (np.diff(found[:, 3]) > NEAR)]
    run = np.cumsum(new) - 1
    found = followed(items, shard, found[np.bincount(run)[run] >= LEAST_SEEDS])
    if not len(found):
        return []
    out = []
    new = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)])
    for a, b in zip(new, np.r_[new[1:], len(found)], strict=True):
        own = found[a:b]
        doc, item = int(own[0, 0]), int(own[0, 1])
        if any(lines_up(items, item, part, shard) for part in _windows(own, len(items.raw[item]))):
            k, p, n = own[own[:, 4].argmax()][2:]
            starts = items.starts[item]
            words = int(np.searchsorted(starts, starts[k] + n, "right")) - 1 - int(k)
            out.append((doc, item, words, int(k), int(np.searchsorted(shard.starts, p) - np.searchsorted(shard.starts, shard.firsts[doc]))))
    return out


def _windows(own: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Matches of one item in one document by places that may belong together: runs without wide gaps, cut into overlapping
    windows in which a whole copy of the item has room, so that no run, however long, is compared at once."""
    wide = size + size // 2 + 320
    place = own[:, 3]
    for run in np.split(own, np.flatnonzero(np.diff(place) > NEAR) + 1):
        if len(run) < LEAST_SEEDS:
            continue
        if run[-1, 3] - run[0, 3] <= wide:
            yield run
            continue
        for start in range(int(run[0, 3]), int(run[-1, 3]) + 1, wide):
            part = run[(run[:, 3] >= start) & (run[:, 3] < start + 2 * wide)]
            if len(part) >= LEAST_SEEDS:
                yield part


def _in_order(masks: dict[bytes, int], size: int, tokens: list[bytes]) -> int:
    """Length of the longest common subsequence of an item's words and other ones, all places of a word at once."""
    full = free = (1 << size) - 1
    for t in tokens:
        if m := masks.get(t):
            hit = free & m
            free = ((free + hit) | (free - hit)) & full
    return size - free.bit_count()


def lines_up(items: Items, item: int, own: np.ndarray, shard: Shard) -> bool:
    """Whether the item's words and the text around its matches agree on a long enough stretch."""
    if len(set(own[:, 2].tolist())) < LEAST_SEEDS:
        return False
    words, begin, raw = items.words[item], items.starts[item], shard.raw
    # Of the hits of one match, which end at one place on one diagonal, the first holds the others.
    ends_at = np.column_stack([own[:, 3] - begin[own[:, 2]], own[:, 3] + own[:, 4]])
    _, kept = np.unique(ends_at, axis=0, return_index=True)
    own = own[kept]
    own = own[np.argsort(own[:, 3], kind="stable")]
    # Between two errors of a stretch at most two words are no match.  So eight of its words are in matches: of 12 or 13 words one
    # is wrong and two may be hidden, of 14 to 21 two and four, of more the matches hold more.  One less is asked for, since a
    # word may be joined with the wrong one before it.
    until = np.searchsorted(begin, begin[own[:, 2]] + own[:, 4], "right") - 1
    if not items.hidden[item] and len({w for k, e in zip(own[:, 2].tolist(), until.tolist(), strict=True) for w in range(k, e)}) < STRETCH - 5:
        return False
    # Not beyond the document, and as far around the matches as a few changed words reach.
    left, right = raw.rfind(b"\0", 0, int(own[0, 3])) + 1, raw.find(b"\0", int(own[-1, 3]))
    first, last = max(left, int(own[0, 3]) - 120), min(right, int((own[:, 3] + own[:, 4]).max()) + 160)
    cuts = set(shard.starts[np.searchsorted(shard.starts, first) : np.searchsorted(shard.starts, last)].tolist())
    inside, known = set(), set()
    for _, _, k, p, n in own.tolist():
        # The item's own word starts hold as far as the match does; other cuts within it are a matter of layout.
        ends = begin[k : np.searchsorted(begin, begin[k] + n, "right")] - begin[k] + p
        known.update(ends.tolist())
        inside.update(c for c in cuts if p < c < ends[-1])
    marks = sorted((cuts - inside) | known)
    tokens = [raw[x:y].rstrip(b"\0") for x, y in zip(marks, [*marks[1:], last], strict=True)]
    # A stretch agrees in all but one of twelve words, or in more: with fewer in common, in order, nothing lines up.
    if _in_order(items.masks(item), len(words), tokens) < STRETCH - 1:
        return False
    units: list[tuple[int, int]] = []  # (words of the item, errors)
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, words, tokens, autojunk=False).get_opcodes():
        if tag == "equal":
            units += [(1, 0)] * (i2 - i1)
        else:
            both = min(i2 - i1, j2 - j1)
            units += [(1, 1)] * (i2 - i1) + [(0, 1)] * (j2 - j1 - both)
    size = np.cumsum([0] + [u[0] for u in units])
    wrong = np.cumsum([0] + [u[1] for u in units])
    good = np.array([u == (1, 0) for u in units])
    for a in np.flatnonzero(good):
        for b in range(a + STRETCH, len(units) + 1):
            if good[b - 1]:
                n, e = size[b] - size[a], wrong[b] - wrong[a]
                if n >= STRETCH and e <= (n + 2) / 8:
                    return True
    return False


def _packs(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(packs (pack, ids, texts), characters): the items in rows of bounded size."""
    known = items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).filter("id is not null and t is not null").dropDuplicates(["id"])
    chars = known.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    packs = -(-max(1, chars) // PACK_CHARS)
    grouped = known.groupBy(F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack")).agg(F.sort_array(F.collect_list(F.struct("id", "t"))).alias("r"))
    return grouped.select("pack", F.col("r.id").alias("ids"), F.col("r.t").alias("texts")), chars


def _shards(documents: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    """(shard_ids, bodies): the documents in rows of about ``SHARD_CHARS`` characters, where they are."""
    texts = documents.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body")).filter(F.col("doc_id").isNotNull() & (F.length("body") >= STRETCH))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda ids, bodies: pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([bodies], pa.list_(pa.string()))], ["shard_ids", "bodies"])
        ids: list[int] = []
        bodies: list[str] = []
        held = 0
        for part in parts:
            for i, t in zip(part.column(0), part.column(1), strict=True):
                ids.append(i.as_py())
                bodies.append(t.as_py())
                held += len(bodies[-1])
                if held >= SHARD_CHARS:
                    yield row(ids, bodies)
                    ids, bodies, held = [], [], 0
        if ids:
            yield row(ids, bodies)

    return texts.mapInArrow(run, "shard_ids array<long>, bodies array<string>")


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched_words, item_word, doc_word): every document that holds a passage of a test item.

    The last three tell the longest verbatim match: its words, and where it begins in the item and in the document.
    """
    packs, chars = _packs(items, item_col, text_col)
    # A stated set of queries against all rows, in blocks: each shard meets each pack, one after the other.
    both = _shards(documents, doc_col, text_col).crossJoin(F.broadcast(packs) if chars <= SENT_CHARS else packs)
    names = ["doc_id", "item_id", "matched_words", "item_word", "doc_word"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: tuple = ()
        pack: tuple = ()
        for part in parts:
            for i in range(part.num_rows):
                ids, bodies, number, item_ids, texts = (part.column(c)[i] for c in range(5))
                if pack[:1] != (number.as_py(),):
                    pack = (number.as_py(), Items(list(zip(item_ids.as_py(), texts.as_py(), strict=True))))
                ids = ids.as_py()
                if shard[:1] != (ids,):
                    copies: dict[str, list[int]] = {}
                    for doc, body in zip(ids, bodies.as_py(), strict=True):
                        copies.setdefault(body, []).append(doc)
                    shard = (ids, Shard(list(copies)), list(copies.values()))
                found = search(pack[1], [], shard[1])
                rows = [(doc, pack[1].ids[item], *rest) for at, item, *rest in found for doc in shard[2][at]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names)

    got = both.select("shard_ids", "bodies", "pack", "ids", "texts").mapInArrow(run, "doc_id long, item_id long, matched_words long, item_word long, doc_word long")
    return got.dropDuplicates(["doc_id", "item_id"])


def without_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage of a test item."""
    return documents.join(leaks(documents, items).select("doc_id").distinct(), "doc_id", "left_anti")
