"""Which source files weren't written by hand: generated, minified, vendored, or data saved as code.

Each file is judged by itself, in one pass without shuffle:

* **generated** - a multi-pattern automaton finds words of generation notices (four languages). A
  hit counts only in a comment of the file's head or tail, outside quotes; there the sentence must
  say that *this file* is made by a program, or join a word of making with a hands-off word. Tables
  and directives that only program generators write (lexer tables with ``#line``, message
  descriptors, wrapper stubs) count too, as do lockfiles: by exact name, or by pinned hashes in a file
  named after locks.
* **vendored** - a release notice (a version number with words of licence, release or origin) in a
  comment of the head or tail, a path through a folder that only package managers fill, or one through
  another vendored or release directory if a comment of the head or tail speaks of an origin, a licence or a
  holder of rights.
* **minified** - statements without spacing: little white space beside many statement marks. A
  minified suffix in the path halves what is asked of the text but isn't believed alone.
* **data** - nearly all lines share a few comma-separated shapes, or the file is one long literal
  or mostly digits.

Paths and lang may mislead, hence hand-written text in ``generators/`` or ``vendors/`` stays, and a
file without path is judged by its text.

Defined results: null, empty and blank contents are hand-written (no kind); null path or lang
count as unknown; a byte order mark and CRLF don't matter; a file_id delivered several times yields
one row (cases win); shapes are judged over the whole text. The head is the comments before the first
line of code, or else 20 lines; the tail the comments after the last one, or else 6 lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of notices. made: a program made it; off: hands off; origin: from a release of others.
NOTICE_WORDS = {
    "made": (
        "generated", "auto-generated", "autogenerated", "auto generated", "machine-generated", "machine generated", "@generated", "<auto-generated", "produced by", "emitted by", "written by the tool", "output of", "created by", "compiled from",
        "automatically created", "automatically produced", "automatically written", "generado", "generada", "autogenerado", "producido por", "creado autom", "généré", "genere par", "autogénéré", "produit par", "créé autom", "erzeugt", "generiert", "erstellt von", "automatisch erstellt", "generato", "gerado",
    ),
    "off": (
        "do not edit", "do not modify", "do not change", "don't edit", "don't modify", "not edit by hand", "edit by hand", "modify by hand", "instead of editing", "not be edited", "not be modified", "manual changes", "will be lost", "are lost", "will be overwritten", "is overwritten", "are overwritten", "get overwritten",
        "regenerate", "any changes", "all changes", "no editar", "no modificar", "no edite", "no modifique", "se perder", "sobrescri", "ne pas modifier", "ne pas éditer", "ne modifiez pas", "seront perdues", "sera écrasé", "seront écrasé", "nicht bearbeiten", "nicht ändern", "nicht von hand", "nicht editieren",
        "gehen verloren", "überschrieben", "non modificare", "não edite",
    ),
    "origin": (
        "(c)", "©", "copyright", "license", "licence", "vendored", "imported from", "bundled", "upstream", "release", "source tree", "authors", "contributors", "third-party", "third party", "redistribut", "taken from", "copied from", "derived from", "based on", "mirror of", "homepage", "package", "distributed", "distribution", "tag v", "spdx", "mit", "://", "forked from", "unmodified",
    ),
}
#: Marks that only program generators write. Two different ones, or one many times, are needed.
MACHINE_MARKS = ("_descriptor.descriptor(", "serialized_start=", "serialized_end=", "yy_break", "yy_accept", "static const short yy", "static const yytype", "yytext_ptr", "#line ", "$root.", "$util.", "_wrap_", "swigintern", "moc_literal", "qt_meta_", "#define have_", "descriptor_pb2", "goog.provide", "__pyx_", "bits_ & 0x", "memoizedserializedsize")
#: Paths. Names of lockfiles are believed by themselves, and so are folders that only tools fill.
LOCKFILES = {
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "deno.lock", "cargo.lock", "poetry.lock", "pipfile.lock", "uv.lock", "pdm.lock", "gemfile.lock", "composer.lock", "go.sum", "mix.lock", "pubspec.lock", "flake.lock", "podfile.lock", "cartfile.resolved", "package.resolved",
    "packages.lock.json", "paket.lock", "conan.lock", "gradle.lockfile", "elm-stuff.lock", "berksfile.lock", "chart.lock", "stack.yaml.lock", "cabal.project.freeze", "manifest.lock", "shrinkwrap.yaml",
}
INSTALLED_DIR = re.compile(r"(^|/)(node_modules|bower_components|site-packages|dist-packages|jspm_packages)/", re.I)
#: These need support from the text.
VENDORED_DIR = re.compile(r"(^|/)(third[_-]?party|externals?|vendor(ed)?/[^/]+|pods/[^/]+|[a-z][\w.]*-v?\d+\.\d+(\.\d+)?)/", re.I)
LOCK_NAME = re.compile(r"(^|[./-])lock(file)?(\.\w+)?$", re.I)
LOCKED = re.compile(r"(?im)^\s*\"?(integrity|checksum|hash(es)?|sha\d*|resolved|lockfile_?version|resolution|rev|narhash|content-hash)\"?\s*[:= ]")
MINIFIED_NAME = re.compile(r"([.-](min|bundle|chunk|pack|prod)(\.[0-9a-f]{6,})?\.(m?js|css)|-[0-9a-f]{8,}\.(m?js|css))$", re.I)

COMMENT = re.compile(r"^\s*(//+|#+!?|/\*+!?|\*+|--|<!--|;+|%+|\"\"\"|'''|rem\b)\s?(.*?)\s*(\*/|-->|\"\"\"|''')?\s*$", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'|`(?!make)[^`]*`|“[^”]*”|„[^“]*“|«[^»]*»")
VERSION = re.compile(r"(?<![\w.])v?\d+\.\d+(\.\d+)*(-?(alpha|beta|rc)\d*)?(?![\w])")
_THING = r"(file|class|code|source|module|header|script|document|unit|package|program|interface|stub|binding)s?"
SELF_MADE = re.compile(
    r"^\W*((note|warning|attention|achtung|aviso|caution|important)\W+)?("
    r"@generated\b|<auto-?generated|(auto[- ]?|machine[- ]?)?generated (by|from|with|using|automatically)\b|autogenerated\b|auto[- ]generated\b|machine[- ]generated\b|automatically (generated|created|produced|written) (by|from|with|using)\b"
    rf"|(\w+ )?{_THING} (auto\w*[- ]?)?generated (by|from|with|using)\b|code generated\b|this is an? (auto\w*[- ]?|machine[- ]?)?generated\b"
    rf"|(this|the) (\w+ )?{_THING}\b.{{0,40}}\b(is|was|has been|are|were) (\w+ )?(auto[- ]?|machine[- ]?)?(generated|produced|emitted) (\w+ )?(by|from|with|using)\b|this (is|was|has been) (\w+ )?(auto[- ]?|machine[- ]?)?generated\b"
    r"|(produced|emitted) by\b|(este |el )?(archivo|fichero|código) (\w+ ){0,3}generado|(ce |le )?(fichier|code) (\w+ ){0,3}(généré|produit)|(diese |dieser |die |der )?(datei|code|quelltext) .{0,60}(erzeugt|generiert|erstellt)|automatisch (erzeugt|generiert)|généré automatiquement|generado automáticamente)",
    re.I,
)
ORIGIN_STRONG = re.compile(r"(?i)\(c\)|©|copyright|@licen[cs]e|vendored|imported from|bundled (copy|version)|\bupstream\b|source tree|\bauthors\b|contributors|spdx|redistribut|(taken|copied|forked) from|mirror of|unmodified|local changes")
LICENCE_VERSION = re.compile(r"(?i)\b(licen[cs]es?|apache|[al]?gpl|mpl|epl|bsd|cc[- ]by\S*)\b[ ,-]*(licen[cs]e)?[ ,]*(v|version)?[ .-]*\d+(\.\d+)*")
LIBRARY = re.compile(r"(?i)^\W*[\w.@/-]{2,40}( (javascript|js|css|library|lib|runtime|toolkit|framework))* v?\d+\.\d+(\.\d+)?\s*([|(;:,–-]|$)")
DATA_ATOM = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[+-]?(?:0x[0-9a-f]+|\d+(?:\.\d+)?(?:e[+-]?\d+)?)[a-z%]*|[^\W\d_]+(?:[ '-][^\W\d_]+)*", re.I)
LONG_LITERAL = re.compile(r"[A-Za-z0-9+/=_-]{400,}|[0-9a-fA-F\s]{800,}|(?:\\x[0-9a-fA-F]{2}){100,}")
HEAD_LINES, TAIL_LINES = 20, 6
PREAMBLE = re.compile(r"^\s*(<\?(php|xml)\b[^<]*|<!doctype\b[^<]*|[\"']use strict[\"'];?)\s*$", re.I)
BLOCKS = {"*/": "/*", "-->": "<!--"}
DIRECTIVE = re.compile(r"^\s*#(include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|line|import)\b")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for group, words in NOTICE_WORDS.items():
        for w in words:
            a.add_word(w, group)
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def machine_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in MACHINE_MARKS:
        a.add_word(w, w)
    a.make_automaton()
    return a


def _said(lines: Iterable[str]) -> Iterator[str | None]:
    """What the comment in each line says, without marks; None for other lines."""
    block = ""
    for line in lines:
        m = COMMENT.match(line)
        if m:
            yield m[2]
            # an opener without its end makes the next lines comment, too
            opener = m[1]
            if opener[:2] in ("/*", "<!") or opener in ('"""', "'''"):
                block = "" if m[3] else {"/*": "*/", "<!": "-->"}.get(opener[:2], opener)
            elif block and m[3] == block:
                block = ""
        elif block:
            if block in line:
                yield line.split(block)[0].strip()
                block = ""
            else:
                yield line.strip()
        else:
            yield None


def _head(lines: list[str]) -> int:
    """How many lines stand before the first line of code."""
    for n, (line, said) in enumerate(zip(lines, _said(lines))):
        if said is None and not PREAMBLE.match(line) or DIRECTIVE.match(line):
            return n
    return len(lines)


def _tail(lines: list[str]) -> int:
    """How many lines stand after the last line of code."""
    n = len(lines)
    while n:
        line = lines[n - 1]
        end = next((e for e in BLOCKS if line.rstrip().endswith(e)), None)
        if end and BLOCKS[end] not in line.rstrip()[: -len(end)]:
            opened = next((k for k in range(n - 2, -1, -1) if BLOCKS[end] in lines[k]), None)
            if opened is None or not COMMENT.match(lines[opened]):
                break
            n = opened
        elif COMMENT.match(line) and not DIRECTIVE.match(line):
            n -= 1
        else:
            break
    return len(lines) - n


def _comments(lines: list[str]) -> Iterator[str]:
    """What the comments of the head and the tail say, line by line, without their marks and quotes."""
    if len(lines) > HEAD_LINES + TAIL_LINES:
        head, tail = max(HEAD_LINES, _head(lines)), max(TAIL_LINES, _tail(lines))
        if head + tail < len(lines):
            lines = lines[:head] + lines[-tail:]
    return (x for x in _said(lines) if x is not None)


def notice_kind(lines: list[str]) -> str | None:
    return notice(lines)[0]


def notice(lines: list[str]) -> tuple[str | None, bool]:
    """What a notice in the head or tail says the file is, and whether a comment there speaks of an origin or a licence at all."""
    a = automaton()
    recent: list[tuple[int, str]] = []
    found, origin = None, False
    for n, said in enumerate(_comments(lines)):
        bare = QUOTED.sub(" ", said)
        groups = {g for _, g in a.iter(bare.lower())}
        if not groups:
            continue
        origin = origin or "origin" in groups and bool(ORIGIN_STRONG.search(bare) or VERSION.search(bare))
        if "made" in groups and (SELF_MADE.search(bare) or "off" in groups):
            return "generated", origin
        if "off" in groups and re.search(r"(?i)\b(this|generated) file\b|diese[rs]? datei|este archivo|ce fichier", bare):
            return "generated", origin
        if "made" in groups or "off" in groups:
            # the two halves of a notice may stand on neighbouring lines
            recent = [(k, g) for k, g in recent if n - k <= 2] + [(n, g) for g in groups if g != "origin"]
            if {g for _, g in recent} == {"made", "off"} and len(bare) < 160:
                return "generated", origin
        plain = LICENCE_VERSION.sub(" ", bare)
        if "origin" in groups and found is None and len(bare) < 240 and VERSION.search(plain) and "part of" not in bare.lower() and (ORIGIN_STRONG.search(bare) or LIBRARY.search(plain)):
            found = "vendored"
    return found, origin


def machine_made(low: str) -> bool:
    seen = Counter(w for _, w in machine_automaton().iter(low))
    if not seen:
        return False
    lines = low.count("\n") + 1
    # one mark on a fifth of the lines, or two kinds of marks on a tenth of them
    return max(seen.values()) * 5 >= lines and max(seen.values()) >= 4 or len(seen) >= 2 and sum(seen.values()) * 10 >= lines and sum(seen.values()) >= 4


def data_like(text: str, lines: list[str]) -> bool:
    size = len(text)
    if size >= 600:
        if sum(len(m[0]) for m in LONG_LITERAL.finditer(text)) >= 0.6 * size:
            return True
        digits = sum(map(text.count, "0123456789"))
        if digits >= 0.4 * size and digits + sum(map(text.count, " .,-\n\t;:xML")) >= 0.75 * size:
            return True
    if len(lines) >= 8 and text.count(",") >= 1.6 * len(lines) * 0.75:
        rows = [x for x in lines if x.count(",") >= 2]
        if len(rows) >= 0.75 * len(lines):
            shapes = Counter(re.sub(r"\s+", "", DATA_ATOM.sub("a", x)) for x in rows)
            runs = Counter(re.sub(r"(a,){3,}", "a,*", s) for s in shapes.elements())
            top = sum(n for _, n in runs.most_common(3))
            return top >= 0.75 * len(lines)
    return False


def minified(text: str, lines: list[str], path: str) -> bool:
    size = len(text)
    named = bool(MINIFIED_NAME.search(path))
    if size < (120 if named else 300):
        return False
    blank = text.count(" ") + text.count("\t")
    marks = sum(map(text.count, ";{}()"))
    limit = 0.12 if named else 0.075
    if blank > limit * size or marks < 0.05 * size or size < (40 if named else 60) * len(lines):
        return False
    # a long literal has no spacing either, but then the other lines are as usual
    long = [x for x in lines if len(x) >= 30]
    dense = sum(x.count(" ") + x.count("\t") <= limit * len(x) for x in long)
    if dense < 0.6 * len(long):
        return False
    bare = QUOTED.sub("''", text)
    return len(bare) >= 0.5 * size and bare.count(" ") + bare.count("\t") <= limit * len(bare)


def locked(path: str, low: str) -> bool:
    """Whether the file is a lockfile: by its exact name, or by one that speaks of locks and pinned hashes or versions inside."""
    if path.rsplit("/", 1)[-1].lower() in LOCKFILES or low.count('"integrity": "sha') >= 3 or low.count("checksum = ") >= 5:
        return True
    return bool(LOCK_NAME.search(path)) and sum(1 for _ in zip(LOCKED.finditer(low), range(3))) == 3


def file_rule(path: str | None, content: str | None) -> tuple[str | None, str | None]:
    """What the file is (``generated``, ``vendored``, ``minified``, ``data``, None: hand-written) and the rule that says so."""
    if not content or not content.strip():
        return None, None
    text = content.lstrip("\ufeff").replace("\r\n", "\n")
    path = path or ""
    lines = [x for x in text.split("\n") if x.strip()]
    kind, origin = notice(lines)
    if kind:
        return kind, "notice"
    low = text.lower()
    if locked(path, low):
        return "generated", "lockfile"
    if INSTALLED_DIR.search(path):
        return "vendored", "path"
    if origin and VENDORED_DIR.search(path):
        return "vendored", "path and origin"
    if machine_made(low):
        return "generated", "marks"
    if minified(text, lines, path):
        return "minified", "name and shape" if MINIFIED_NAME.search(path) else "shape"
    if data_like(text, lines):
        return "data", "shape"
    return None, None


def file_kind(path: str | None, content: str | None) -> str | None:
    return file_rule(path, content)[0]


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds = [file_rule(p, c) for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in kinds], pa.string()), pa.array([r for _, r in kinds], pa.string())], names=["file_id", "kind", "rule"])


def judge(df: DataFrame, key: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """``file_id, kind, rule`` (kind null: hand-written), one row per file."""
    rows = df.select(F.col(key).cast("long").alias("file_id"), F.col(path).alias("path"), F.col(content).alias("content"))
    found = rows.mapInArrow(_kinds, "file_id long, kind string, rule string").groupBy("file_id").agg(F.max(F.struct("kind", "rule")).alias("k"))
    return found.select("file_id", "k.kind", "k.rule")
