"""Subjects of each document by interpolated n-gram language models.

*Forms.* Sentences (in code: lines) are held against text of their own kind. A sentence's form is code
or the natural language whose frequent words it has most of. Code is told from prose by two
language models: interpolated trigrams over the shapes of tokens (words, numbers, single signs), and
words. They are trained on labelled documents of the subject that code is about against all others, then
on the sentences that they tell apart themselves.

*Training.* Each subject has a model of each form that interpolates bigrams, unigrams and the
background; the background of a natural language has all subjects in equal parts, that of code is the code
of other documents, so that numerical code is told from other code by its names. Labels
name whole documents, are incomplete and partly wrong, so the models are refined: sentences are judged
by the first models, and the next ones are trained on those that speak clearly for a subject
their document is labelled with, or very clearly for another. Label spellings are matched without case and
blanks; a spelling that is no subject's name is taken for the subject that most of its documents speak for.
All of it is counted on the executors over all labelled documents, whatever their number and length: shapes and words of the
forms in every round, n-grams (of which the ``max_grams`` most frequent ones make the model) and their weights in every round, votes of the
spellings, and agreement at every threshold. The driver gets sums alone. A fifth of the documents, by a hash of the
id, is held out of the models that are calibrated; the final ones count it in. ``train`` makes the former from texts in memory.

*Judging.* The evidence of a sentence for a subject is its cross-entropy per token under the
background less that under the subject's model, taken with half the weight of its neighbours of the same
form. A sentence of prose goes to the subject with most evidence if that passes the subject's
threshold; a sentence of code is about ``CODE_SUBJECT`` and about every other subject whose threshold for code
is passed. A subject's share is the words of its sentences over all words; a
document has every subject whose share reaches ``accept``, the quarter that defines the task. The
thresholds are calibrated on all labelled documents that were held out (on all, if there are fewer than ``SPLIT``): of each subject's by which labels
and acceptance agree best, the middle one.

Defined results: null, empty and wordless texts, and texts in which no sentence speaks for a
subject, have no row; a subject occurs once per document; repeated labels count once; labels of
unknown documents, null labels and unmatched spellings don't count; without usable labels no
document has a subject; equal scores go to the subject that comes first in name order; texts are judged whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import wordstream as ws
from lexloom.session import discard, materialize

ACCEPT = 0.25
MAX_LABELLED = 2000  # of ``sample_of``, which no query uses
MAX_CHARS = 8_000_000
MAX_GRAMS = 400_000
FORM_ROUNDS = 3  # over all labelled documents, after sentences were told by label: in each, they are told by the forms before it
ROUNDS = 2  # over all labelled documents, after n-grams were counted by label: in each, sentences count as the model before it judges them
SPLIT = 200  # labelled documents from which on a fifth is held out
UNIGRAM, BIGRAM, SHAPE = 0.8, 0.35, 0.6  # weights of a model's own unigrams against the background, of bigrams against unigrams, of a form's own shapes
THRESHOLDS = np.round(np.geomspace(0.05, 1.0, 24), 4)  # nats per token
KNOWN = 4  # words that models of a language must know of a text without any frequent word, and that a text must have for words to tell code
OTHERS = 0.1  # weight of all subjects' agreement beside a subject's own
CODE_SUBJECT = "software"
CODE_GAIN, CODE_ODDS = 0.15, 3.0  # nats per token, and in all, by which code must be likelier than prose
#: Frequent words by which a sentence's language is told.
FREQUENT_WORDS = {
    "en": "the of and to in is that it was for with as are be this by not or from has have when while but which".split(),
    "es": "el la los las de y en que un una es por con para se del al como más pero su sin lo está cuando".split(),
    "fr": "le la les des et en est un une du que qui dans pour par sur pas au ce avec il se sont mais sans".split(),
    "de": "der die das und in den ist von zu mit dem ein eine im nicht auf sich des als auch es an wird dass aber".split(),
    "it": "il lo la gli di e che un una per con del della non si è in da al nel sono più come ma anche".split(),
    "pt": "o a os as de e que um uma em para com do da não no na por se mais ao dos das como mas".split(),
}
CODE, OTHER = 0, len(FREQUENT_WORDS) + 1  # forms; languages are 1, 2 ...
FORMS = OTHER + 1
_SALT = ws.mix64(np.arange(1, FORMS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z])")
_MARKUP = re.compile(r"<(?:!--|/?[a-zA-Z!])[^<>]{0,3000}>")
_FORMULA = re.compile(r"\\[a-zA-Z]{3,}|\$[^$\n]{1,300}\$")
_SIGNS = str.maketrans(dict.fromkeys("\\{}_^=$()[]", " "))
_ENDS = np.array([ord(c) for c in ".!?\n;…。！？"], np.uint32)
_WORD, _NUMBER, _LINE, _SIGN = 1, 2, 3, 4  # shapes; the blank is 0, signs follow by code, the last is any other
SHAPES = _SIGN + 129


def plain(text: str | None) -> str:
    """Lower-cased, with joined names taken apart, and without markup and the signs inside formulas."""
    if not text:
        return ""
    if "<" in text and ">" in text:
        text = _MARKUP.sub(" \n ", text)
    if "$" in text or "\\" in text:
        text = _FORMULA.sub(lambda m: m[0].translate(_SIGNS), text)
    return ws.lowered(_CAMEL.sub(" ", text))


def shapes(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shape of each token and the index of its first code point; blanks are no tokens."""
    kind = np.where(chars < 128, chars + _SIGN, SHAPES - 1).astype(np.int64)
    kind[(chars == 32) | (chars == 9) | (chars == 13) | (chars == 0xA0)] = 0
    kind[chars == 10] = _LINE
    kind[(chars >= 48) & (chars < 58)] = _NUMBER
    kind[ws.char_table("letters")[np.minimum(chars, 0xFFFF)]] = _WORD
    at = np.flatnonzero((kind > 0) & ((kind > 2) | (kind != np.concatenate([[0], kind[:-1]]))))
    return kind[at], at


def trigrams(kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each token's shape with those of the two before it, as one number; texts (``starts``: their first tokens) follow line feeds, not each other."""
    last, second = (np.concatenate([np.full(k, _LINE), kinds])[: len(kinds)] for k in (1, 2))
    last[starts] = second[starts] = _LINE
    second[starts[starts + 1 < len(kinds)] + 1] = _LINE
    return (second * SHAPES + last) * SHAPES + kinds


def _spread(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """With half of what the neighbours have."""
    out = x.astype(np.float64)
    out[1:][near] += 0.5 * x[:-1][near]
    out[:-1][near] += 0.5 * x[1:][near]
    return out


class Sentences:
    """Words of a block of texts with the sentence and text they belong to, and the tokens' shapes."""

    def __init__(self, texts: list[str | None]):
        w = ws.words([plain(t) for t in texts], "letters")
        self.hashes, self.form = w.hashes, None
        n = len(w.hashes)
        self.first = self.size = self.text = np.zeros(0, np.int64)
        self.joined, self.tokens, self.token_size = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n:
            return
        ends = np.concatenate([[0], np.cumsum(np.isin(w.chars, _ENDS))])
        part = ends[w.starts]
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (w.owner[1:] != w.owner[:-1])])
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.first, [n]]))
        self.text = w.owner[self.first]
        self.joined = ~new  # has a predecessor in its sentence
        kinds, at = shapes(w.chars)
        begin = w.starts[self.first]
        until = np.concatenate([begin[1:], [len(w.chars)]])
        until = np.where(np.concatenate([self.text[1:] != self.text[:-1], [True]]), w.offsets[self.text + 1], until)
        lo, hi = np.searchsorted(at, begin), np.searchsorted(at, until)
        self.token_size = hi - lo
        # signs in front of a text's first word belong to no sentence
        inside = np.arange(self.token_size.sum()) + np.repeat(lo - np.cumsum(self.token_size) + self.token_size, self.token_size)
        self.tokens = trigrams(kinds, np.searchsorted(at, w.offsets[:-1]))[inside]

    def per_sentence(self, values: np.ndarray) -> np.ndarray:
        """Sums of values of words."""
        return np.add.reduceat(values, self.first, axis=0) if len(self.first) else np.zeros((0, *values.shape[1:]))

    def told(self, forms: Forms) -> Sentences:
        """The same with each sentence's form, and words and pairs that differ by form."""
        if not len(self.first):
            self.form, self.words, self.pairs = np.zeros(0, np.int64), self.hashes, self.hashes
            return self
        near = self.text[1:] == self.text[:-1]
        lang = languages(self, near)
        self.form = np.where(forms.code(self), CODE, lang) if forms.known else lang
        return self.salted()

    def salted(self) -> Sentences:
        salt = np.repeat(_SALT[self.form], self.size)
        self.words = ws.mix64(self.hashes ^ salt)
        k = np.flatnonzero(self.joined)
        self.pairs = np.zeros(len(self.hashes), np.uint64)
        self.pairs[k] = ws.mix64(self.words[k - 1] * np.uint64(0xD6E8FEB86659FD93) + self.words[k])
        self.near = (self.text[1:] == self.text[:-1]) & (self.form[1:] == self.form[:-1])
        return self


def sentences(texts: list[str | None]) -> Sentences:
    """All sentences of many texts, laid out block by block so that only words, not characters, are held."""
    parts = [(a, Sentences(texts[a:b])) for a, b in ws.blocks(texts)]
    parts = [(a, s) for a, s in parts if len(s.first)]
    out = Sentences([])
    if not parts:
        return out
    for k in ("hashes", "size", "joined", "tokens", "token_size"):
        setattr(out, k, np.concatenate([getattr(s, k) for _, s in parts]))
    out.text = np.concatenate([s.text + a for a, s in parts])
    out.first = np.cumsum(out.size) - out.size
    return out


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, and which of them each is (by hashing, where ``np.unique`` sorts)."""
    coded = pa.array(h.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _lookup(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted table, or len(table)."""
    if not len(table):
        return np.zeros(len(h), np.int64)
    u, at = _distinct(h)
    u = u.view(np.uint64)
    k = np.minimum(np.searchsorted(table, u), len(table) - 1)
    return np.where(table[k] == u, k, len(table))[at]


_FREQUENT: list = []


def languages(s: Sentences, near: np.ndarray) -> np.ndarray:
    """The language of each sentence, by its frequent words, its neighbours' and its text's."""
    if not _FREQUENT:
        rows = [(int(h), k) for k, ws_ in enumerate(FREQUENT_WORDS.values()) for h in ws.words([" ".join(ws_)], "letters").hashes]
        table = np.unique(np.array([h for h, _ in rows], np.uint64))
        has = np.zeros((len(table) + 1, len(FREQUENT_WORDS)), np.float32)
        for h, k in rows:
            has[np.searchsorted(table, np.uint64(h)), k] = 1
        _FREQUENT.extend((table, has))
    table, has = _FREQUENT
    hits = s.per_sentence(has[_lookup(table, s.hashes)])
    whole = np.zeros((int(s.text[-1]) + 1, hits.shape[1]))
    np.add.at(whole, s.text, hits)
    votes = _spread(hits, near) + whole[s.text] / np.maximum(1, 1e3 * whole[s.text].sum(axis=1, keepdims=True))
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1) + 1, OTHER)


class Forms:
    """Code against prose: differences of log probability of token shapes after two others, and of words."""

    def __init__(self) -> None:
        self.known = False
        self.words, self.word_gain, self.shape_gain = np.zeros(0, np.uint64), np.zeros(1, np.float32), np.zeros(1, np.float32)

    def __getstate__(self) -> dict:
        # histories that were never seen have the same gains whatever the first shape is; side by side they shrink to little
        if not self.known:
            return self.__dict__
        return {**self.__dict__, "shape_gain": zlib.compress(self.shape_gain.reshape(SHAPES, SHAPES, SHAPES).transpose(1, 0, 2).tobytes(), 1)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.known:
            self.shape_gain = np.frombuffer(zlib.decompress(state["shape_gain"]), np.float32).reshape(SHAPES, SHAPES, SHAPES).transpose(1, 0, 2).ravel()

    def code(self, s: Sentences) -> np.ndarray:
        """Which sentences, with their neighbours, are likelier as code."""
        edge = np.concatenate([[0.0], np.cumsum(self.shape_gain[s.tokens], dtype=np.float64)])
        end = np.cumsum(s.token_size)
        # a few words without the shapes of code are no code: all counted, even rare names in code are known
        enough = np.bincount(s.text, s.size)[s.text] >= KNOWN
        both = edge[end] - edge[end - s.token_size] + enough * s.per_sentence(self.word_gain[_lookup(self.words, s.hashes)])
        near = s.text[1:] == s.text[:-1]
        return _spread(both, near) > np.maximum(CODE_ODDS, CODE_GAIN * _spread(s.token_size + s.size, near))

    @staticmethod
    def _shape_model(counts: np.ndarray) -> np.ndarray:
        """Interpolated trigram probabilities; each order's weight grows with what was seen of its history."""
        n3 = counts.reshape(SHAPES, SHAPES, SHAPES).astype(float)
        n2 = n3.sum(axis=0)
        n1 = n2.sum(axis=0)
        p = (n1 + 1) / (n1.sum() + SHAPES)
        kinds = (n2 > 0).sum(axis=1, keepdims=True) + 1
        p = (n2 + kinds * p) / (n2.sum(axis=1, keepdims=True) + kinds)
        kinds = (n3 > 0).sum(axis=2, keepdims=True) + 1
        return (n3 + kinds * p) / (n3.sum(axis=2, keepdims=True) + kinds)

    @classmethod
    def fit(cls, s: Sentences, code: np.ndarray, told: np.ndarray) -> Forms:
        """From sentences that are code and others; ``told``: of which it is known."""
        of_token, of_word = (np.repeat(np.where(told, np.where(code, 1, 2), 0), n) for n in (s.token_size, s.size))
        tokens = np.stack([np.bincount(s.tokens[of_token == k], minlength=SHAPES**3) for k in (1, 2)])
        words, at = np.unique(s.hashes, return_inverse=True)
        return cls.counted(tokens, words, np.stack([np.bincount(at[of_word == k], minlength=len(words)) for k in (1, 2)]))

    @classmethod
    def counted(cls, tokens: np.ndarray, words: np.ndarray, n: np.ndarray) -> Forms:
        """From how often each trigram of shapes and each word (sorted) is in code (first row) and in prose; words seen less than three times don't count."""
        out = cls()
        out.known = bool(tokens.any(axis=1).all())
        if not out.known:
            return out
        code, prose = (cls._shape_model(x) for x in tokens)
        both = (1 - SHAPE) * (code + prose) / 2
        out.shape_gain = np.log((SHAPE * code + both) / (SHAPE * prose + both)).astype(np.float32).ravel()
        often = n.sum(axis=0) >= 3
        out.words, n = words[often], n[:, often].astype(float)
        p = n / np.maximum(n.sum(axis=1, keepdims=True), 1)
        pooled = p.mean(axis=0)
        g = np.log((UNIGRAM * p[0] + (1 - UNIGRAM) * pooled) / (UNIGRAM * p[1] + (1 - UNIGRAM) * pooled))
        out.word_gain = np.concatenate([g, [0.0]]).astype(np.float32)
        return out


def learn_forms(s: Sentences, about_code: np.ndarray, labelled: np.ndarray, rounds: int = FORM_ROUNDS) -> Forms:
    """Forms from texts that are about code's subject and other labelled ones, refined on what they tell apart."""
    told = labelled[s.text]
    forms = Forms.fit(s, about_code[s.text], told)
    for _ in range(rounds):
        if not forms.known:
            break
        # code is looked for only where a label allows it at first, then everywhere
        forms = Forms.fit(s, forms.code(s), np.ones(len(s.text), bool))
    return forms


class Model:
    """Differences of log probability (subject minus background) of words, alone and after their predecessor, by form."""

    def __init__(self, names: list[str], forms: Forms, words: np.ndarray, pairs: np.ndarray, gains: np.ndarray, used: np.ndarray):
        self.names, self.forms, self.words, self.pairs, self.used, self.agreement = names, forms, words, pairs, used, {}
        self.gain = np.concatenate([gains, np.zeros((1, len(names)))]).astype(np.float32)
        self.prose_least, self.code_least = np.full(len(names), 0.12), np.full(len(names), 0.4)

    def like(self, other: Model) -> Model:
        """With the other's thresholds."""
        self.prose_least, self.code_least, self.agreement = other.prose_least, other.code_least, other.agreement
        return self

    def told(self, texts: list[str | None]) -> Sentences:
        """Sentences with their forms; texts without any frequent word are of the language whose models know most of their words."""
        s = Sentences(texts).told(self.forms)
        odd = np.flatnonzero(s.form == OTHER)
        if len(odd):
            of = np.flatnonzero(np.repeat(s.form == OTHER, s.size))
            text = np.repeat(s.text, s.size)[of]
            known = np.stack([np.bincount(text[_lookup(self.words, ws.mix64(s.hashes[of] ^ salt)) < len(self.words)], minlength=len(texts)) for salt in _SALT[1:OTHER]], axis=1)
            best = np.where(known.max(axis=1) >= KNOWN, known.argmax(axis=1) + 1, OTHER)
            s.form[odd] = best[s.text[odd]]
            s.salted()
        return s

    def evidence(self, s: Sentences) -> np.ndarray:
        """Per sentence and subject: by how many nats a token the subject's model is better than the background, neighbours of its form included."""
        if not len(s.first):
            return np.zeros((0, len(self.names)))
        none = len(self.words) + len(self.pairs)
        a = _lookup(self.words, s.words)
        a = np.where(a == len(self.words), none, a)
        b = _lookup(self.pairs, s.pairs)
        k = np.where(b < len(self.pairs), b + len(self.words), a)
        return _spread(s.per_sentence(self.gain[k]), s.near) / _spread(s.size, s.near)[:, None]

    def assign(self, s: Sentences, evidence: np.ndarray, prose_least: np.ndarray | None = None, code_least: np.ndarray | None = None) -> np.ndarray:
        """Which sentences (rows) speak for which subjects: prose for one at most, code for its own and others."""
        prose_least = self.prose_least if prose_least is None else prose_least
        code_least = self.code_least if code_least is None else code_least
        out = np.zeros(evidence.shape, bool)
        if not len(evidence):
            return out
        best = evidence.argmax(axis=1)
        row = np.arange(len(best))
        out[row, best] = evidence[row, best] > prose_least[best]
        code = s.form == CODE
        out[code] = evidence[code] > code_least
        if CODE_SUBJECT in self.names:
            out[code, self.names.index(CODE_SUBJECT)] = True
        return out

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Share of each subject in each text."""
        out = np.zeros((len(texts), len(self.names)))
        for a, b in ws.blocks(texts):
            s = self.told(texts[a:b])
            if len(s.first):
                out[a:b] = self._shares(s, self.assign(s, self.evidence(s)), b - a)
        return out

    def _shares(self, s: Sentences, speaks: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(s.text, s.size, n)
        t, k = np.nonzero(speaks)
        got = np.bincount(s.text[t] * len(self.names) + k, s.size[t], n * len(self.names)).reshape(n, -1)
        return got / np.maximum(total, 1)[:, None]

    def speaking(self, s: Sentences, named: np.ndarray) -> np.ndarray:
        """Weights (sentences x subjects) from which the next models learn; ``named``: sentences x subjects of the labels."""
        e = self.evidence(s)
        code = s.form == CODE
        speaks = self.assign(s, e)
        # a sentence may speak for a subject its document lacks a label for, if it does so clearly
        own = (speaks & ((named > 0) | (e > 2.5 * self.prose_least))).astype(np.float32)
        own[code] = named[code] > 0
        # of subjects that have no model of this form yet, the labels are all there is
        return np.where(self.used[s.form], own, named)


class Grams:
    """Counts from which models are made: words and pairs with their form, by subject and in all."""

    def __init__(self, words, word_form, u, u_all, pairs, k1, k2, b, b_all):
        self.words, self.word_form, self.u, self.u_all = words, word_form, u, u_all
        self.pairs, self.k1, self.k2, self.b, self.b_all = pairs, k1, k2, b, b_all

    @classmethod
    def count(cls, s: Sentences, own: np.ndarray) -> Grams:
        n = own.shape[1]

        def counts(at: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            sentence = np.repeat(np.arange(len(s.size)), s.size)[of]
            return np.stack([np.bincount(at, own[sentence, k], size) for k in range(n)], axis=1), np.bincount(at, minlength=size).astype(float)

        words, first, at, times = np.unique(s.words, return_index=True, return_inverse=True, return_counts=True)
        often = times >= 3
        at = np.where(often, np.cumsum(often) - 1, -1)[at]
        form = np.repeat(s.form, s.size)
        words, word_form = words[often], form[first[often]]
        of = np.flatnonzero(at >= 0)
        u, u_all = counts(at[of], of, len(words))
        follow = np.flatnonzero(s.joined & (at >= 0))
        follow = follow[at[follow - 1] >= 0]
        pairs, first, pat, times = np.unique(s.pairs[follow], return_index=True, return_inverse=True, return_counts=True)
        often = times >= 4
        pat = np.where(often, np.cumsum(often) - 1, -1)[pat]
        pairs, first = pairs[often], follow[first[often]]
        b, b_all = counts(pat[pat >= 0], follow[pat >= 0], len(pairs))
        return cls(words, word_form, u, u_all, pairs, at[first - 1], at[first], b, b_all)

    def model(self, names: list[str], forms: Forms) -> Model:
        g1, g2, used = np.zeros(self.u.shape), np.zeros(self.b.shape), np.zeros((FORMS, len(names)), bool)
        for form in range(FORMS):
            w = np.flatnonzero(self.word_form == form)
            if len(w):
                p = np.flatnonzero(self.word_form[self.k1] == form)
                place = np.full(len(self.words), -1)
                place[w] = np.arange(len(w))
                g1[w], g2[p], used[form] = _gains(self.u[w], self.u_all[w], place[self.k1[p]], place[self.k2[p]], self.b[p], self.b_all[p], form == CODE)
        return Model(names, forms, self.words, self.pairs, np.concatenate([g1, g2]), used)


def _gains(u, u_all, k1, k2, b, b_all, against_all: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences of log probability of the words and pairs of one form, and which subjects have a model of it."""
    size = u.sum(axis=0)
    used = size >= 50
    if against_all:  # a few wrong labels must not make a subject of code
        used &= size >= 0.02 * max(1.0, size.sum())
    f = u / np.maximum(size, 1)
    if against_all:  # all text of this form, less what is labelled with the subject itself
        base2 = np.maximum(np.maximum(b_all[:, None] - b, 0) / np.maximum(u_all[:, None] - u, 1)[k1], 0.05 * (b_all / np.maximum(u_all[k1], 1))[:, None])
        others = np.maximum(u_all[:, None] - u, 0)
        base = np.maximum(others / np.maximum(others.sum(axis=0), 1), 0.05 * (u_all / max(1.0, u_all.sum()))[:, None])
    else:  # the subjects in equal parts
        base = f[:, used].mean(axis=1)[:, None] if used.any() else np.zeros((len(u), 1))
        base2 = (b[:, used] / np.maximum(size[used], 1)).mean(axis=1)[:, None] / np.maximum(base[k1], 1e-12) if used.any() else np.zeros((len(b), 1))
    base = np.maximum(base, 1e-9)
    p = UNIGRAM * f + (1 - UNIGRAM) * base
    g1 = np.log(p / base)
    given = np.where(u[k1] >= 2, b / np.maximum(u[k1], 1), base2)
    g2 = np.log((BIGRAM * given + (1 - BIGRAM) * p[k2]) / (BIGRAM * base2 + (1 - BIGRAM) * base[k2]))
    # of words hardly seen in this form nothing is known
    few1, few2 = u.sum(axis=1) < 2, b.sum(axis=1) < 2
    g1[few1] = 0
    g2[few2] = g1[k2][few2]
    g1[:, ~used], g2[:, ~used] = -1.0, -1.0
    return g1, g2, used


def folded(label: str) -> str:
    return re.sub(r"\s+", " ", label).strip().lower()


def _middle(scores: np.ndarray) -> float:
    """The middle of the thresholds around the best score that are about as good."""
    best = int(scores.argmax())
    good = scores >= scores[best] - 0.004
    lo = hi = best
    while lo and good[lo - 1]:
        lo -= 1
    while hi + 1 < len(scores) and good[hi + 1]:
        hi += 1
    return float(np.sqrt(THRESHOLDS[lo] * THRESHOLDS[hi]))


def _tallies(model: Model, s: Sentences, wanted: np.ndarray, test: np.ndarray) -> np.ndarray:
    """For prose and code, each subject and threshold: twice the ``test`` texts that are accepted and labelled so, and the sum of those accepted and those labelled."""
    e, n = model.evidence(s), len(wanted)
    total = np.maximum(np.bincount(s.text, s.size, n), 1)
    code, best = s.form == CODE, e.argmax(axis=1)
    prose, coded = [], []
    for k, name in enumerate(model.names):
        fixed = np.bincount(s.text[code], s.size[code], n) if name == CODE_SUBJECT else np.zeros(n)

        def tally(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
            out = []
            for least in THRESHOLDS:
                on = rows & (e[:, k] > least)
                got = (np.bincount(s.text[on], s.size[on], n) + others) / total >= ACCEPT
                out.append((2 * (got & wanted[:, k])[test].sum(), got[test].sum() + wanted[test, k].sum()))
            return np.array(out, float)

        prose.append(tally(~code & (best == k), fixed))
        # in code, what its prose says for the subject counts, too
        on = ~code & (best == k) & (e[:, k] > 0.1)
        coded.append(tally(code, np.bincount(s.text[on], s.size[on], n)) if name != CODE_SUBJECT else np.zeros((len(THRESHOLDS), 2)))
    return np.array([prose, coded])


def _calibrate(model: Model, tallies: np.ndarray) -> None:
    """Thresholds of each subject, for prose and for code, by which acceptance and labels agree best."""
    for found, least in zip(tallies, (model.prose_least, model.code_least)):
        whole = sum(found)
        for k, own in enumerate(found):
            # a subject with few labels follows the others
            both = own + OTHERS * whole
            least[k] = _middle(both[:, 0] / np.maximum(both[:, 1], 1e-9))


def train(names: list[str], texts: list[str | None], labels: list[set[str]], rounds: int = 2) -> tuple[Model, dict[str, int]] | None:
    """Models with thresholds, and which subject each label spelling names, from labelled texts in memory; ``labels`` are spellings as given."""
    names = sorted(names)
    key = {folded(x): i for i, x in enumerate(names)}
    spelled = [{folded(x) for x in ls} for ls in labels]
    known = [{key[x] for x in ls if x in key} for ls in spelled]
    s = sentences(texts)
    if not any(known) or not len(s.first):
        return None
    n, own_code = len(texts), key.get(CODE_SUBJECT, -1)
    forms = learn_forms(s, np.array([own_code in ls for ls in known]), np.array([bool(ls) for ls in known])) if own_code >= 0 else Forms()
    s.told(forms)
    test = np.arange(n) % 5 == 4 if n >= SPLIT else np.zeros(n, bool)

    def by_label(sets: list[set[int]], skip: np.ndarray) -> np.ndarray:
        w = np.zeros((n, len(names)), np.float32)
        for i, ls in enumerate(sets):
            if ls and not skip[i]:
                w[i, list(ls)] = 1 / len(ls)
        return w[s.text]

    model = Grams.count(s, by_label(known, test)).model(names, forms)
    # spellings that are no name: what do their documents speak for?
    per = model._shares(s, model.assign(s, model.evidence(s)), n)
    votes: dict[str, Counter] = defaultdict(Counter)
    for i, ls in enumerate(spelled):
        if len(ls) == 1 and per[i].any():
            votes[next(iter(ls))][int(per[i].argmax())] += 1
    also = {x: c.most_common(1)[0][0] for x, c in votes.items() if x not in key and c.most_common(1)[0][1] > 0.5 * c.total()}
    names_of = {**also, **key}
    sets = [{names_of[x] for x in ls if x in names_of} for ls in spelled]
    skip = np.repeat(test[:, None], len(names), 1)[s.text]
    for _ in range(rounds):
        model = Grams.count(s, np.where(skip, 0, model.speaking(s, by_label(sets, test)))).model(names, forms)
    wanted = np.zeros((n, len(names)), bool)
    for i, ls in enumerate(sets):
        wanted[i, list(ls)] = True
    held = np.array([bool(ls) for ls in sets]) & (test | ~test.any())
    _calibrate(model, _tallies(model, s, wanted, held))
    got = model._shares(s, model.assign(s, model.evidence(s)), n)[held] >= ACCEPT
    both, either = (got & wanted[held]).sum(axis=0), got.sum(axis=0) + wanted[held].sum(axis=0)
    model.agreement = {x: float(2 * b / m) for x, b, m in zip(model.names, both, either) if m}
    return model, names_of


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``h, text, spellings`` of every labelled document with text (h: a hash of the id)."""
    per = labels.where(F.col("subject").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_set("subject").alias("spellings"))
    return docs.where(F.col("text").isNotNull()).join(per, "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "spellings")


def sample_of(rows: DataFrame, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_CHARS) -> tuple[list[str | None], list[set[str]]]:
    """For trials with ``train``: texts and label spellings of at most ``max_labelled`` documents of together at most ``max_chars`` characters, in order of the hash."""
    rows = rows.where(F.length("text") <= max_chars // 8)  # one document mustn't be most of the sample
    short = rows.select("h", F.length("text").alias("n")).orderBy("h", "n").limit(max_labelled).collect()
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in short]), max_chars, "right"))
    if not fits:
        return [], []
    got = rows.where(F.col("h") <= short[fits - 1]["h"]).orderBy("h", F.length("text"), "text").limit(fits).collect()
    return [r["text"] for r in got], [set(r["spellings"]) for r in got]


@contextmanager
def _shared(rows: DataFrame, value):
    """A broadcast for the jobs of a block; its files go with it."""
    shared = rows.sparkSession.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


_GRAM = "kind int, h long, a long, b long, form int, subject int, n double"


def _labelled(batches: Iterator[pa.RecordBatch], told, names_of: dict[str, int], n: int) -> Iterator[tuple[Sentences, np.ndarray, np.ndarray]]:
    """Sentences of labelled texts (``text, spellings, held``) with the weights (texts x subjects) of their labels, and which texts are held out."""
    for batch in batches:
        texts, held = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        sets = [{names_of[x] for x in map(folded, ls) if x in names_of} for ls in batch.column(1).to_pylist()]
        for lo, hi in ws.blocks(texts):
            named = np.zeros((hi - lo, n), np.float32)
            for i, ls in enumerate(sets[lo:hi]):
                if ls:
                    named[i, list(ls)] = 1 / len(ls)
            yield told(texts[lo:hi]), named, held[lo:hi]


def _weighted(s: Sentences, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word of each sentence that has a weight, once per subject: index of the word, of the sentence, of the subject, and the weight."""
    r, k = np.nonzero(own)
    size = s.size[r]
    word = np.arange(size.sum()) + np.repeat(s.first[r] - np.cumsum(size) + size, size)
    return word, np.repeat(r, size), np.repeat(k, size), np.repeat(own[r, k], size)


def _count_forms(shared):
    """How often trigrams of shapes (kind 0) and words (kind 1) are in code and in prose: told by the forms, or by labels where there are none yet."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, names_of, n = shared.value
        tokens = np.zeros((2, SHAPES**3), np.int64)

        def counts(kind: int, h: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h), *map(pa.array, both)], names=["kind", "h", "code", "prose"])

        for s, named, _ in _labelled(batches, Sentences, names_of, n):
            if not len(s.first):
                continue
            if forms:
                of = np.where(forms.code(s), 0, 1)
            else:
                about = named[:, names_of[CODE_SUBJECT]] > 0 if CODE_SUBJECT in names_of else np.zeros(len(named), bool)
                of = np.where(named.any(axis=1), np.where(about, 0, 1), 2)[s.text]
            side = np.repeat(of, s.token_size)
            for k in (0, 1):
                tokens[k] += np.bincount(s.tokens[side == k], minlength=SHAPES**3)
            words, at = _distinct(s.hashes)
            yield counts(1, words, np.bincount(np.repeat(of, s.size) * len(words) + at, minlength=3 * len(words)).reshape(3, -1)[:2])
        seen = np.flatnonzero(tokens.any(axis=0))
        yield counts(0, seen, tokens[:, seen])

    return go


def forms_of(rows: DataFrame, names_of: dict[str, int], n: int) -> Forms | None:
    """Forms from all labelled rows; None if no text has a label. The driver gets a count per trigram of shapes and per word seen three times."""
    forms = None
    for _ in range(FORM_ROUNDS + 1):
        with _shared(rows, (forms, names_of, n)) as shared:
            long = rows.select("text", "spellings", "held").mapInArrow(_count_forms(shared), "kind int, h long, code long, prose long")
            per = long.groupBy("kind", "h").agg(F.sum("code").alias("code"), F.sum("prose").alias("prose"))
            kind, h, code, prose = (c.to_numpy() for c in per.where((F.col("kind") == 0) | (F.col("code") + F.col("prose") >= 3)).toArrow().columns)
        both = np.stack([code, prose])
        tokens = np.zeros((2, SHAPES**3), np.int64)
        tokens[:, h[kind == 0]] = both[:, kind == 0]
        if not tokens.any():
            return None
        w = np.flatnonzero(kind == 1)
        words = h[w].view(np.uint64)
        order = np.argsort(words)
        # code is looked for only where a label allows it at first, then everywhere
        forms = Forms.counted(tokens, words[order], both[:, w[order]])
        if not forms.known:
            break
    return forms


def _count_grams(shared):
    """Words (kind 1) and, if asked for, pairs (kind 2: of a and b) with their labels' weight by subject where not held out; subject -1: in all."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names_of, pairs = shared.value
        n = len(model.names)
        for s, named, held in _labelled(batches, model.told, names_of, n):
            if not len(s.first):
                continue
            word, _, subject, weight = _weighted(s, np.where(held[:, None], 0, named)[s.text])
            form = np.repeat(s.form, s.size)
            for kind, h in ((1, s.words), (2, s.pairs))[: 1 + pairs]:
                u, at = _distinct(h)
                first = np.zeros(len(u), np.int64)
                first[at[::-1]] = np.arange(len(h))[::-1]
                total = np.concatenate([np.bincount(at, minlength=len(u)), np.bincount(subject * len(u) + at[word], weight, n * len(u))]).reshape(n + 1, -1)
                if kind == 2:  # words that begin a sentence end no pair
                    total[:, at[~s.joined]] = 0
                c, r = np.nonzero(total)
                at_first = first[r]
                before = s.words[np.maximum(at_first - 1, 0)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(r), kind, np.int32)), pa.array(u[r]), pa.array(before), pa.array(s.words[at_first].view(np.int64)), pa.array(form[at_first].astype(np.int32)), pa.array((c - 1).astype(np.int32)),
                        pa.array(total[c, r].astype(np.float64)),
                    ],
                    names=["kind", "h", "a", "b", "form", "subject", "n"],
                )

    return go


def _recount(shared):
    """Weight of the model's words and pairs by subject, as the model judges the sentences, not held out and held out: one row per n-gram and subject of a task."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names_of = shared.value
        n, words = len(model.names), len(model.words)
        total = np.zeros((2, words + len(model.pairs), n))
        for s, named, held in _labelled(batches, model.told, names_of, n):
            if not len(s.first):
                continue
            word, sentence, subject, weight = _weighted(s, model.speaking(s, named[s.text]))
            part = held[s.text][sentence].astype(np.int64)
            for known, table, h in ((0, model.words, s.words), (words, model.pairs, s.pairs)):
                at = _lookup(table, h)[word]
                ok = at < len(table)
                np.add.at(total.reshape(-1), ((part[ok] * len(total[0]) + known + at[ok]) * n + subject[ok]), weight[ok])
        r, c = np.nonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), *(pa.array(x[r, c]) for x in total)], names=["gram", "subject", "n", "held"])

    return go


def recounted(rows: DataFrame, model: Model, grams: Grams, names_of: dict[str, int]) -> tuple[Model, Model]:
    """Models from the same n-grams, their sentences judged by ``model``: without the rows held out and with them; the driver gets as many rows as the model has weights."""
    with _shared(rows, (model, names_of)) as shared:
        got = rows.select("text", "spellings", "held").mapInArrow(_recount(shared), "gram int, subject int, n double, held double").groupBy("gram", "subject").agg(F.sum("n").alias("n"), F.sum("held").alias("held")).toArrow()
    gram, subject, n, held = (c.to_numpy() for c in got.columns)
    out = []
    for weight in (n, n + held):
        own = np.zeros((len(model.words) + len(model.pairs), len(model.names)))
        own[gram, subject] = weight
        grams.u, grams.b = own[: len(model.words)], own[len(model.words) :]
        out.append(grams.model(model.names, model.forms))
    return out[0], out[1]


def _most_frequent(long: DataFrame, max_grams: int) -> dict[str, list]:
    """A row per n-gram with its weights by subject."""
    per = long.groupBy("kind", "h", "subject").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("form").alias("form"))
    gram = per.groupBy("kind", "h").agg(F.sum(F.when(F.col("subject") < 0, F.col("n"))).alias("times"), F.map_from_entries(F.collect_list(F.when(F.col("subject") >= 0, F.struct("subject", "n")))).alias("by"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("form").alias("form"))
    return gram.where(F.col("times") >= F.when(F.col("kind") == 1, 3).otherwise(4)).orderBy(F.col("times").desc(), "kind", "h").limit(max_grams).toArrow().to_pydict()


def count_all(rows: DataFrame, model: Model, names_of: dict[str, int], max_grams: int = MAX_GRAMS, pairs: bool = True) -> Grams:
    """N-grams of all labelled rows, and by label where not held out, counted on the executors; the driver gets the ``max_grams`` most frequent ones."""
    n = len(model.names)
    with _shared(rows, (model, names_of, pairs)) as shared:
        long = rows.select("text", "spellings", "held").mapInArrow(_count_grams(shared), _GRAM)
        often = _most_frequent(long, max_grams)
    kind, h, times = np.array(often["kind"]), np.array(often["h"], np.int64).view(np.uint64), np.array(often["times"], float)
    own = np.zeros((len(h), n))
    for i, by in enumerate(often["by"]):
        for k, x in by:
            own[i, k] = x
    form, a, b = np.array(often["form"], np.int64), np.array(often["a"], np.int64).view(np.uint64), np.array(often["b"], np.int64).view(np.uint64)
    w = np.flatnonzero(kind == 1)
    w = w[np.argsort(h[w])]
    words = h[w]
    p = np.flatnonzero(kind == 2)
    k1, k2 = _lookup(words, a[p]), _lookup(words, b[p])
    good = (k1 < len(words)) & (k2 < len(words))
    p, k1, k2 = p[good], k1[good], k2[good]
    order = np.argsort(h[p])
    p, k1, k2 = p[order], k1[order], k2[order]
    return Grams(words, form[w], own[w], times[w], h[p], k1, k2, own[p], times[p])


def _count_votes(shared):
    """The subject that most of a text speaks for, of texts whose only spelling is no subject's name."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key = shared.value
        for batch in batches:
            spelled = [{folded(x) for x in ls} for ls in batch.column(1).to_pylist()]
            odd = [i for i, ls in enumerate(spelled) if len(ls) == 1 and not ls & key.keys()]
            if odd:
                per = model.shares(batch.column(0).take(pa.array(odd)).to_pylist())
                some = np.flatnonzero(per.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([next(iter(spelled[odd[i]])) for i in some], pa.string()), pa.array(per[some].argmax(axis=1).astype(np.int32))], names=["spelling", "subject"])

    return go


def spellings_of(rows: DataFrame, model: Model, key: dict[str, int]) -> dict[str, int]:
    """Which subject each spelling names: its own, or the one that more than half of its documents speak for."""
    with _shared(rows, (model, key)) as shared:
        votes = rows.select("text", "spellings").mapInArrow(_count_votes(shared), "spelling string, subject int").groupBy("spelling", "subject").count()
        most = votes.groupBy("spelling").agg(F.max_by("subject", "count").alias("subject"), F.max("count").alias("most"), F.sum("count").alias("n")).where(F.col("most") * 2 > F.col("n"))
        return {**{r["spelling"]: r["subject"] for r in most.collect()}, **key}


def _count_agreement(shared):
    """Sums of ``_tallies``, a row per number."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names_of = shared.value
        total = 0.0
        for s, named, _ in _labelled(batches, model.told, names_of, len(model.names)):
            total = total + _tallies(model, s, named > 0, named.any(axis=1)).ravel()
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.ravel(total)[cell])], names=["cell", "n"])

    return go


def calibrated(rows: DataFrame, model: Model, names_of: dict[str, int]) -> Model:
    """The model with thresholds by which acceptance and the labels of all rows agree best."""
    with _shared(rows, (model, names_of)) as shared:
        got = rows.select("text", "spellings", "held").mapInArrow(_count_agreement(shared), "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = (c.to_numpy() for c in got.columns)
    tallies = np.zeros((2, len(model.names), len(THRESHOLDS), 2))
    tallies.ravel()[cell] = n
    _calibrate(model, tallies)
    return model


def trained(rows: DataFrame, names: list[str], max_grams: int = MAX_GRAMS) -> tuple[Model, Model, dict[str, int]] | None:
    """As ``train``, from all rows (``text, spellings, held``) on the executors: the model without the rows held out, whose thresholds are calibrated on these, and the one of all rows."""
    names = sorted(names)
    key = {folded(x): i for i, x in enumerate(names)}
    forms = forms_of(rows, key, len(names))
    if forms is None:
        return None
    none = np.zeros(0, np.uint64)
    part = Model(names, forms, none, none, np.zeros((0, len(names))), np.zeros((FORMS, len(names)), bool))
    # words by language first: they tell the language of texts without any frequent word
    part = count_all(rows, part, key, max_grams, pairs=False).model(names, forms)
    grams = count_all(rows, part, key, max_grams)
    part = grams.model(names, forms)
    names_of = spellings_of(rows, part, key)
    for _ in range(ROUNDS):
        part, whole = recounted(rows, part, grams, names_of)
    held = rows.where("held")
    calibrated(rows if held.isEmpty() else held, part, names_of)
    return part, whole.like(part), names_of


def fitted(docs: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int | None = None, max_grams: int = MAX_GRAMS) -> Model | None:
    """The model of all labelled documents (of the first ``max_labelled`` in order of the hash, if that is asked for); None without usable labels."""
    names = [r["subject"] for r in subjects.where(F.col("subject").isNotNull()).select("subject").distinct().collect()]
    if not names:
        return None
    rows = labelled_rows(docs, labels)
    rows = materialize(rows if max_labelled is None else rows.orderBy("h", F.length("text"), "text").limit(max_labelled))
    fifth = F.pmod("h", F.lit(5)) == 4
    n, out = rows.agg(F.count("*"), F.count_if(fifth)).first()
    got = trained(rows.withColumn("held", fifth if n >= SPLIT and out < n else F.lit(False)), names, max_grams)
    discard(rows)
    return got[1] if got else None


def _judge(model):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            shares = m.shares(b.column(1).to_pylist())
            t, k = np.nonzero(shares > 0)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[t].astype(np.int64)), pa.array([m.names[i] for i in k], pa.string()), pa.array(shares[t, k])], names=["doc_id", "subject", "share"])

    return go


def shares(docs: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int | None = None) -> DataFrame:
    """``doc_id, subject, share`` of every subject that some sentence of the document speaks for."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    spark = docs.sparkSession
    model = fitted(docs, labels, subjects, max_labelled)
    if model is None:
        return spark.createDataFrame([], "doc_id long, subject string, share double")
    judged = docs.mapInArrow(_judge(spark.sparkContext.broadcast(model)), "doc_id long, subject string, share double")
    return judged.groupBy("doc_id", "subject").agg(F.max("share").alias("share"))


def find(docs: DataFrame, labels: DataFrame, subjects: DataFrame, accept: float = ACCEPT, max_labelled: int | None = None) -> DataFrame:
    """``doc_id, subject``: the subjects to which at least ``accept`` of a document is devoted."""
    return shares(docs, labels, subjects, max_labelled).where(F.col("share") >= accept).select("doc_id", "subject")
