"""Evaluation texts inside training texts: which document holds a passage of which item.

*Normal form.* Both sides lose escapes (HTML entities, backslash escapes), case and punctuation;
what stays are words (letters, digits, ``_``) with one blank between them.

*Filter (q-gram lemma).* An altered word of ``w`` characters destroys at most ``q - 1 + w`` q-grams. So
a passage that covers a window of ``words`` of the item's own words, ``budget`` of which are altered,
shares with it at least the q-grams of the window less those that the longest ``budget`` words can destroy,
all of them near one diagonal. This bound is computed for every window of every item, from q-grams
of 16 characters that stand in one item only where that leaves ``ENOUGH``; where it doesn't (idioms,
short words, formulas), from all of 16, those of several items included, or else from those of 8 in the same way. Hits are counted per document, item and diagonal band; bands
overlap by half, so that a passage lies whole in one of them. A band is retained if its hits reach the least bound
of the windows that they touch, and never asked for more than ``least``, as words put in between destroy q-grams, too.

*Verification.* Around each kept band, from each word diagonal that has hits, the words of both sides are
aligned, within a band of word diagonals, by a local alignment in which an equal word earns its length, an altered word costs
three times its length, words put in between (line numbers, markup) cost little, and words of
passages that stand in several items count nothing. The document holds the item when the best
alignment spans at least ``words`` words of the item that no other item has.

The items are a stated query set: they are cut into slices of about ``slice_chars`` characters (about 60 bytes
of arrays each), each slice is broadcast and held against all documents in one map without shuffle.

Defined results: null, empty or short texts hold nothing and aren't held; a pair occurs once however
many passages it shares; items with equal texts share all passages, hence none is found; rows with a null id are left out;
documents are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Collection, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import wordstream as ws

LONG, SHORT = 16, 8  # characters of a q-gram
BAND = 256
LEAST, ENOUGH = 24, 6
ALTERED = 8  # one word in so many may be altered
PLACES = 64  # of a q-gram that an item repeats more often, the first places stand for all
WORDS = 25
SHARED_RUN = 8
SIDE = 20  # half width of the word band
SAME = 4  # word diagonals so near to each other are followed once
MARGIN = 60  # words of the document looked at on either side of the hits
SLICE_CHARS = 1_000_000
_BITS = 22
_ESCAPE = re.compile(r"(?<!\\)\\+(?:u([0-9a-fA-F]{4})|[nrtbf0])")
_NUMBERED = re.compile(r"(?m)^[ >|]{0,6}(\d{1,5})[ |:.)\t][^\n]*\n[ >|]{0,6}\d{1,5}[ |:.)\t][^\n]*\n[ >|]{0,6}\d{1,5}[ |:.)\t]")
_LINE_NUMBER = re.compile(r"(?m)^[ >|]{0,6}\d{1,5}[|:.)]?(?=[ \t]|$)")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,2000}>")


def normal(text: str | None) -> str:
    """Without escapes, lower-cased and composed."""
    if not text:
        return ""
    for _ in range(3):
        if "&" not in text:
            break
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    if _NUMBERED.search(text):
        text = _LINE_NUMBER.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] and not 0xD800 <= int(m[1], 16) < 0xE000 else " ", text)
    return ws.lowered(text)


def stream(w: ws.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with one blank after each; where each word begins there; the word at each place."""
    size = w.ends - w.starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(begin[-1]) - begin[:-1][word] + w.starts[word]
    chars = w.chars[at].astype(np.uint64)
    chars[begin[1:] - 1] = 32
    return chars, begin, word


def qgrams(chars: np.ndarray, sizes: Collection[int] = (LONG, SHORT)) -> dict[int, np.ndarray]:
    """Hashes of all q-grams of a stream of code points, by q (powers of two)."""
    h, width, base, out = chars + np.uint64(7), 1, 0x9E3779B97F4A7C15, {}
    while width < max(sizes):
        if len(h) <= width:
            h = np.zeros(0, np.uint64)
        else:
            h = h[:-width] * np.uint64(base) + h[width:]
            h ^= h >> np.uint64(31)
        base = base * 0xD6E8FEB86659FD93 % 2**64
        width *= 2
        if width in sizes:
            out[width] = ws.mix64(h)
    return out


class Index(NamedTuple):
    """Q-grams of one size with the places they have in items, and how many hits a band needs that touches a place."""

    q: int
    grams: np.ndarray
    start: np.ndarray
    count: np.ndarray
    form: np.ndarray
    place: np.ndarray
    need: np.ndarray
    bits: np.ndarray

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a place in ``g`` and an entry of the index."""
        near = np.flatnonzero(self.bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(near):
            return near, near
        k = np.minimum(np.searchsorted(self.grams, g[near]), len(self.grams) - 1)
        hit = self.grams[k] == g[near]
        near, k = near[hit], k[hit]
        reps = self.count[k]
        pos = np.repeat(near, reps)
        return pos, np.repeat(self.start[k], reps) + np.arange(len(pos)) - np.repeat(np.cumsum(reps) - reps, reps)


class Items:
    """The query set of one slice, as arrays that a worker needs."""

    def __init__(self, ids: list[int], texts: list[str | None], shared: set[int], words: int = WORDS, least: int = LEAST):
        forms, owner = [], []
        for k, t in enumerate(texts):
            n = normal(t)
            forms.append(n)
            owner.append(k)
            bare = normal(_TAG.sub(" ", t)) if t and _TAG.search(t) else n
            if bare != n:  # the same item as it reads without its markup
                forms.append(bare)
                owner.append(k)
        self.ids, self.owner = np.array(ids, np.int64), np.array(owner, np.int64)
        w = ws.words(forms, "word")
        self.hashes = w.hashes
        self.first = np.searchsorted(w.owner, np.arange(len(forms) + 1))
        self.weight = np.minimum(w.ends - w.starts + 1, 16).astype(np.float32)
        h, at = ws.grams(w.hashes, w.owner, SHARED_RUN)
        held = np.zeros(len(w.hashes), bool)
        if len(h) and shared:
            for k in at[np.isin(h, np.fromiter(shared, np.uint64, len(shared)))]:
                held[k : k + SHARED_RUN] = True
        self.weight[held] = 0
        self.own = np.concatenate([[0], np.cumsum(~held)])  # words no other item has, so far
        chars, begin, word = stream(w)
        self.word_at = word.astype(np.int32)
        self.stream_first = begin[self.first[:-1]] if len(forms) else begin[:0]
        self.indexes = self._indexes(w, chars, begin, word, ~held, words, least)

    def _indexes(self, w: ws.Words, chars: np.ndarray, begin: np.ndarray, word: np.ndarray, own: np.ndarray, words: int, least: int) -> list[Index]:
        own = np.flatnonzero(own)
        a = own[: max(0, len(own) - words + 1)]
        b = own[words - 1 :]
        whole = w.owner[a] == w.owner[b] if len(a) else np.zeros(0, bool)
        if not whole.any():
            return []
        a, b = a[whole], b[whole]
        budget = words // ALTERED
        sizes = (w.ends - w.starts)[own]
        longest = np.partition(np.lib.stride_tricks.sliding_window_view(sizes, words)[whole], words - budget, axis=1)[:, words - budget :].sum(axis=1)
        found = qgrams(chars)
        usable, alone, bound = {}, {}, {}
        for q, g in found.items():
            form = w.owner[word[: len(g)]]
            inside = form == w.owner[word[q - 1 :]]
            item = self.owner[form]
            order = np.lexsort((np.arange(len(g)), form, g))
            start = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
            size = np.diff(np.concatenate([start, [len(g)]]))
            first, last = np.minimum.reduceat(item[order], start), np.maximum.reduceat(item[order], start)
            only = np.zeros(len(g), bool)
            only[order] = np.repeat(first == last, size)
            of_form = np.flatnonzero(np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (form[order][1:] != form[order][:-1])]))
            rank = np.arange(len(g)) - np.repeat(of_form, np.diff(np.concatenate([of_form, [len(g)]])))
            few = np.zeros(len(g), bool)
            few[order] = rank < PLACES
            usable[q], alone[q] = inside & few, inside & few & only
            lost = longest + budget * (q - 1)
            until = np.maximum(begin[b + 1] - q, begin[a])
            for all_items, counted in ((False, alone[q]), (True, usable[q])):
                edge = np.concatenate([[0], np.cumsum(counted)])
                bound[q, all_items] = edge[np.minimum(until, len(g))] - edge[np.minimum(begin[a], len(g))] - lost
        out, left = [], np.ones(len(a), bool)
        for q, all_items in ((LONG, False), (LONG, True), (SHORT, False), (SHORT, True)):
            last = q == SHORT and all_items
            mine = left & ((bound[q, all_items] >= ENOUGH) | last)
            left &= ~mine
            need = np.clip(bound[q, all_items], 1, least)
            g = found[q]
            at = np.zeros(len(g), np.int16)
            for k in np.flatnonzero(mine)[np.argsort(-need[mine], kind="stable")]:
                at[begin[a[k]] : begin[b[k] + 1] - q] = need[k]
            place = np.flatnonzero((at > 0) & (usable if all_items else alone)[q])
            if not len(place):
                continue
            order = place[np.argsort(g[place], kind="stable")]
            start = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
            form = w.owner[word[order]]
            bits = np.zeros(1 << _BITS, bool)
            bits[(g[order] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            out.append(Index(q, g[order][start], start.astype(np.int32), np.diff(np.concatenate([start, [len(order)]])).astype(np.int32), form.astype(np.int32), (order - self.stream_first[form]).astype(np.int32), at[order], bits))
        return out


def align(doc: np.ndarray, doc_weight: np.ndarray, items: Items, jobs: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The own words spanned by the best alignment of each job (first word, end word, form, item word minus document word)."""
    n, width = len(jobs), 2 * SIDE + 1
    best = np.zeros(n, np.int64)
    if not n:
        return best
    jobs_of = np.array(jobs, np.int64)
    order = np.argsort(jobs_of[:, 0] - jobs_of[:, 1], kind="stable")  # the longest first: those that have ended are a tail
    a, b, form, base = jobs_of[order].T
    lo, hi, length = items.first[form], items.first[form + 1], b - a
    spans = np.zeros(n, np.int64)
    score = np.zeros((n, width), np.float32)
    begun = np.zeros((n, width), np.int64)  # item word at which the alignment begins
    top = np.zeros(n, np.float32)
    off, column = np.arange(-SIDE, SIDE + 1), np.arange(width)
    last = len(items.hashes) - 1
    for step in range(int(length[0])):
        live = int(np.searchsorted(-length, -step))
        i = a[:live] + step
        j = (i + base[:live])[:, None] + off  # item word against which document word i stands
        valid = (j >= lo[:live, None]) & (j < hi[:live, None])
        jj = np.clip(j, 0, last)
        weight = items.weight[jj]
        score, begun = score[:live], begun[:live]
        straight = score + np.where(items.hashes[jj] == doc[i][:, None], weight, -3 * weight)
        # document word left out: the same item word one step later
        skip = np.full_like(score, -1)
        skip[:, :-1] = score[:, 1:] - 0.25 * doc_weight[i][:, None]
        along = straight >= skip
        origin = np.where(score <= 0, jj, begun)
        origin[:, :-1] = np.where(along[:, :-1], origin[:, :-1], begun[:, 1:])
        t = np.where(valid, np.where(along, straight, skip), -1)
        # item words left out: a running maximum along the band
        cost = np.cumsum(1.5 * weight, axis=1)
        v = np.where(t > 0, t + cost, -1)
        m = np.maximum.accumulate(v, axis=1)
        where = np.maximum.accumulate(np.where((v == m) & (t > 0), column, 0), axis=1)
        score = np.maximum(np.where(valid, m - cost, 0), 0)
        row = np.arange(live)[:, None]
        begun = origin[row, where]
        k = score.argmax(axis=1)[:, None]
        now = score[row, k][:, 0]
        better = np.flatnonzero(now > top[:live])
        if len(better):
            top[better] = now[better]
            kb = k[better, 0]
            spans[better] = np.maximum(spans[better], items.own[jj[better, kb] + 1] - items.own[begun[better, kb]])
    best[order] = spans
    return best


def holds(texts: list[str | None], items: Items, words: int = WORDS) -> list[tuple[int, int, int]]:
    """``text index, item index, own words spanned`` of every text that holds an item."""
    found: dict[tuple[int, int], int] = {}
    if not items.indexes:
        return []
    for x, y in ws.blocks(texts):
        w = ws.words([normal(t) for t in texts[x:y]], "word")
        if not len(w.hashes):
            continue
        chars, begin, word = stream(w)
        grams = qgrams(chars, {index.q for index in items.indexes})
        first = begin[np.searchsorted(w.owner, np.arange(y - x))]
        jobs, named = [], []
        for index in items.indexes:
            pos, entry = index.hits(grams[index.q])
            if not len(pos):
                continue
            form, place = index.form[entry].astype(np.int64), index.place[entry].astype(np.int64)
            owner = w.owner[word[pos]]
            # a q-gram that reaches into the next text is none of this one
            good = owner == w.owner[word[pos + index.q - 1]]
            pos, entry, form, place, owner = pos[good], entry[good], form[good], place[good], owner[good]
            if not len(pos):
                continue
            diagonal = pos - first[owner] - place + (1 << 40)
            base = items.word_at[place + items.stream_first[form]].astype(np.int64) - word[pos]
            pair = owner * len(items.first) + form
            for shift in (0, BAND // 2):
                band = (diagonal + shift) // BAND
                order = np.lexsort((base, band, pair))
                p, q, need = pair[order], band[order], index.need[entry[order]]
                start = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
                size = np.diff(np.concatenate([start, [len(p)]]))
                kept = size >= np.minimum.reduceat(need, start)
                for s, n in zip(start[kept], size[kept]):
                    h = order[s : s + n]
                    o, f = owner[h[0]], form[h[0]]
                    left, right = word[pos[h].min()], word[pos[h].max()]
                    begins, ends = np.searchsorted(w.owner, o), np.searchsorted(w.owner, o, "right")
                    # word diagonals come in order; one stands for those up to half the alignment's width away
                    k = 0
                    while k < n:
                        least_base = base[h[k]]
                        k = int(np.searchsorted(base[h], least_base + SIDE, "right"))
                        middle = h[int(np.searchsorted(base[h], least_base + SIDE // 2, "right")) - 1]
                        jobs.append((int(max(begins, left - MARGIN)), int(min(ends, right + MARGIN)), int(f), int(base[middle])))
                        named.append((x + int(o), int(items.owner[f])))
        weight = np.minimum(w.ends - w.starts + 1, 16).astype(np.float32)
        merged: list[list[int]] = []
        for lo, hi, f, diagonal_, t, i in sorted(((*j, *n) for j, n in zip(jobs, named)), key=lambda v: (v[4], v[2], v[3], v[0])):
            m = merged[-1] if merged else None
            if m and m[4] == t and m[2] == f and diagonal_ - m[3] <= SAME and lo <= m[1] and hi >= m[0]:
                m[0], m[1] = min(m[0], lo), max(m[1], hi)
            else:
                merged.append([lo, hi, f, diagonal_, t, i])
        merged.sort(key=lambda m: m[1] - m[0])  # those of a batch end together
        for c in range(0, len(merged), 512):
            part = merged[c : c + 512]
            for (_, _, _, _, t, i), span in zip(part, align(w.hashes, weight, items, [(m[0], m[1], m[2], m[3]) for m in part])):
                if span >= words:
                    found[t, i] = max(found.get((t, i), 0), int(span))
    return [(t, i, s) for (t, i), s in found.items()]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w = ws.words([normal(t) for t in b.column(1).to_pylist()], "word")
        h, at = ws.grams(w.hashes, w.owner, SHARED_RUN)
        ids = b.column(0).to_numpy()[w.owner[at]] if len(at) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.view(np.int64))], names=["item_id", "gram"])


def _search(items, words: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = items.value
        for b in batches:
            found = holds(b.column(1).to_pylist(), q, words)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(ids[t]) for t, _, _ in found], pa.int64()), pa.array([int(q.ids[i]) for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64())], names=["doc_id", "item_id", "words"]
            )

    return go


def find(docs: DataFrame, items: DataFrame, words: int = WORDS, least: int = LEAST, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``doc_id, item_id, words``: the documents that hold a passage of an item, with the item's words spanned."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    grams = items.mapInArrow(_shared, "item_id long, gram long").distinct()
    shared = grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    slices = int((items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // slice_chars) + 1
    out = None
    for k in range(slices):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k
        listed = items.where(mine).orderBy("item_id").collect()
        common = {r["gram"] & (2**64 - 1) for r in shared.join(grams.where(mine).select("gram"), "gram", "left_semi").collect()}
        q = docs.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in listed], [r["text"] for r in listed], common, words, least))
        found = rows.mapInArrow(_search(q, words), "doc_id long, item_id long, words long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
