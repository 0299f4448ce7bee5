"""Splitting oversized items at natural boundaries by structure-tree packing.

An item is parsed into a tree: speaker blocks and headings with everything below them, then paragraphs, lists with
their items and sub-items, and fenced code, then lines, sentences, clauses, words, characters.  What stands between two
marks of a fence is neither heading nor list, and a fence is one node.  Sibling subtrees that fit are merged while
together they stay under the limit; the packer descends only into nodes that are themselves oversized, and what is left
of such a node is never joined with what follows outside it.  Sizes count Unicode code points.

Defined results: an item of exactly the limit is not split; a null or empty item gives no pieces; white space stays
where it was, so the pieces without their overlaps, joined, are the item again; every piece after the first repeats the
last ``overlap`` characters of the piece before; a fence that never closes runs to the end; text without any boundary is
cut at the limit, never inside a character with its combining marks if one within reach can be avoided.  A first piece
shorter than the overlap is joined with the second.  Rows repeated under one id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.tables import once_by_key

LIMIT = 4000
OVERLAP = 200

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]")
_SPEAKER = re.compile(r"(?:User|Assistant|System|Tool|Human|AI):(?=\s)|\[(?:user|assistant|system|tool)\](?=\s)|#+ (?:user|assistant|system|tool)[ \t]*$", re.M)
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\d{1,4}[.)])[ \t]+")
#: Below the blocks, from the coarsest to the finest: a match's end is where a node of that level begins.
FINER = [
    re.compile(r"\r\n|\n|\r"),
    re.compile(r"[.!?…。！？]+[\"'”’)\]]*\s+"),
    re.compile(r"[,;:]\s+|\s+[–—-]\s+"),
    re.compile(r"\s+"),
]


class Node(NamedTuple):
    start: int
    end: int
    kind: str  # section, list, or text
    level: int  # of a section; of the finest parse tried for a text
    kids: tuple = ()


def _lines(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    for m in _LINE.finditer(text, start, end):
        yield m.span()


def blocks(text: str) -> list[list]:
    """[start, end, kind, level] of the item's blocks in order: h (heading or speaker), fence, list, text; blank lines end a block."""
    out: list[list] = []
    fence = ""
    closed = True
    for a, b in _lines(text, 0, len(text)):
        line = text[a:b]
        if fence:
            out[-1][1] = b
            m = _FENCE.match(line)
            if m and m[1].startswith(fence) and not line[m.end() :].strip():
                fence, closed = "", True
        elif m := _FENCE.match(line):
            fence = m[1]
            out.append([a, b, "fence", 0])
        elif not line.strip():
            closed = True
            if out:
                out[-1][1] = b
            else:
                out.append([a, b, "text", 0])
        elif _SPEAKER.match(line):
            out.append([a, b, "h", 0])
            closed = True
        elif m := _HEADING.match(line):
            out.append([a, b, "h", len(m[1])])
            closed = True
        else:
            item = _ITEM.match(line)
            last = out[-1][2] if out else ""
            if last == "list" and (item or not closed or line[0] in " \t"):
                out[-1][1] = b
            elif last == "text" and not item and not closed:
                out[-1][1] = b
            else:
                out.append([a, b, "list" if item else "text", 0])
            closed = False
    return out


def parse(text: str) -> Node:
    """The tree down to blocks: a section reaches to the next heading of its own or a higher rank."""
    open_ = [(-1, 0, [])]  # (level, start, children)

    def close(level: int, at: int) -> None:
        while len(open_) > 1 and open_[-1][0] >= level:
            rank, start, kids = open_.pop()
            open_[-1][2].append(Node(start, at, "section", rank, tuple(kids)))

    for a, b, kind, level in blocks(text):
        if kind == "h":
            close(level, a)
            open_.append((level, a, [Node(a, b, "text", 0)]))
        else:
            open_[-1][2].append(Node(a, b, "list" if kind == "list" else "text", 0))
    close(0, len(text))
    return Node(0, len(text), "section", -1, tuple(open_[0][2]))


def children(text: str, node: Node) -> list[Node]:
    """The node's parts, at least two, or a single one of a finer level; a heading stays with what follows it."""
    if node.kind == "section":
        kids = list(node.kids)
        if node.level >= 0 and len(kids) > 1:
            kids = [kids[1]._replace(start=node.start), *kids[2:]]
            if kids[0].kind == "section":  # its own first part takes the heading too
                first = kids[0]
                kids[0] = first._replace(kids=(first.kids[0]._replace(start=node.start), *first.kids[1:]))
        return kids or [Node(node.start, node.end, "text", 0)]
    if node.kind == "list":
        marks = [(len(m[1].expandtabs(4)), a) for a, b in _lines(text, node.start, node.end) if (m := _ITEM.match(text, a, b))]
        inner = [x for x in marks if x[1] > node.start]
        own = [x for x in marks if x[1] == node.start]
        least = min((x[0] for x in inner), default=0)
        # The first mark begins this very item if those after it are further in.
        starts = [at for depth, at in inner if depth <= (max(least, own[0][0]) if own else least)]
        if not starts:
            return [Node(node.start, node.end, "text", 0)]
        cuts = [node.start, *starts, node.end]
        return [Node(a, b, "list", 0) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    cuts = [node.start]
    for m in FINER[node.level].finditer(text, node.start, node.end):
        if cuts[-1] < m.end() < node.end:
            cuts.append(m.end())
    return [Node(a, b, "text", node.level + 1) for a, b in zip(cuts, [*cuts[1:], node.end], strict=True)]


def _cut_hard(text: str, start: int, end: int, first: int, room: int) -> Iterator[tuple[int, int]]:
    """Pieces of a stretch without boundaries; the first has ``first`` characters of room, the others ``room``."""
    size = first
    while end - start > size:
        at = start + size
        back = at
        while back > at - 16 and back > start + 1 and (unicodedata.combining(text[back]) or text[back] in "‍️" or text[back - 1] == "‍"):
            back -= 1
        at = back if back > at - 16 else at
        yield start, at
        start, size = at, room
    yield start, end


def pack(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans [start, end) of new text for each piece; piece n is text[start - overlap : end] (no overlap for the first)."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    # Only the piece at the start has no overlap to carry.
    room = lambda start: limit if start == 0 else limit - overlap
    done: list[tuple[int, int]] = []
    merged: tuple[int, int] | None = None  # siblings that go together so far
    stack: list[Node | None] = [parse(text)]
    while stack:
        node = stack.pop()
        if node is not None and node.end - node.start <= room(node.start):
            if merged and node.end - merged[0] <= room(merged[0]):
                merged = (merged[0], node.end)
                continue
            if merged:
                done.append(merged)
            merged = (node.start, node.end)
            continue
        if merged:  # what was merged ends before an oversized sibling, and with its parent
            done.append(merged)
            merged = None
        if node is None:
            continue
        if node.kind == "text" and node.level == len(FINER):
            done.extend(_cut_hard(text, node.start, node.end, room(node.start), limit - overlap))
            continue
        stack.append(None)
        stack.extend(reversed(children(text, node)))
    if merged:
        done.append(merged)
    while len(done) > 1 and done[0][1] < overlap:  # too short to be repeated; with the next piece it is within the limit
        done[:2] = [(0, done[1][1])]
    return done


def split_items(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(record_id, piece, start_char, n_chars, text) of the items above the limit; pieces count from 0."""
    over = once_by_key(
        df.select(F.col(id_col).cast("long").alias("record_id"), F.col(text_col).alias("body")).filter(F.col("record_id").isNotNull() & (F.length("body") > limit)), "record_id"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for record_id, body in zip(batch["record_id"], batch["body"], strict=True):
                for piece, (start, end) in enumerate(pack(body, limit, overlap)):
                    begin = max(0, start - overlap) if piece else start
                    rows.append((record_id, piece, begin, end - begin, body[begin:end]))
            yield pd.DataFrame(rows, columns=["record_id", "piece", "start_char", "n_chars", "text"])

    return over.mapInPandas(run, "record_id long, piece int, start_char long, n_chars int, text string")


def oversized(pieces: DataFrame, field: str) -> DataFrame:
    """(field, record_id) of the items that were split."""
    return pieces.filter("piece = 0").select(F.lit(field).alias("field"), "record_id")


def rejoined(pieces: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(record_id, pieces, longest, text): the items again, from their pieces without the overlaps; one row holds one item."""
    new = F.when(F.col("piece") == 0, F.col("text")).otherwise(F.substring("text", overlap + 1, 2**31 - 1))
    row = F.sort_array(F.collect_list(F.struct("piece", new.alias("t"))))
    return pieces.groupBy("record_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("n_chars").alias("longest"), F.array_join(F.transform(row, lambda x: x["t"]), "").alias("text"))
