"""Working credentials in source code: find every place, redact it, leave the code around it intact.

1. *Index.* One pass reads every file and emits candidate literals: values given to a name of a
   secret, credentials in URLs, headers, calls, command lines, connection strings and comments,
   provider formats, and private key blocks. An automaton over a file's lower-cased text finds the
   anchors; expressions run only around them.
2. *Suppress.* Values that many owners (repositories) share are placeholders: an unstructured one if
   its owners, counted over distinct contents, are too many (all copies of a text are one owner), a
   structured one only if it also holds a word of placeholders, a provider's format never. Known placeholder wordings, references to variables or secret stores, bare markers and names
   never become candidates.
3. *Confirm.* Of the rest, values that are structured (a token of letters and digits, long enough
   not to occur by chance) or mixed (letters, digits and punctuation) are confirmed.
4. *Re-scan.* A second pass looks through every file with an automaton of the confirmed values,
   so that a secret is also found where nothing around it gives it away. The automaton is broadcast;
   values of more than ``automaton_bytes`` are taken in slices, with a pass over the files for each.

Places are ``file_id, line_no`` of the value's first character (a key block: its BEGIN line).
Redaction keeps quotes, separators, line ends and everything outside the values.

Defined results: null or empty content has no places and stays as it is; a null repository counts
as an owner of its own; a file delivered twice yields each place once; equal values in
several places are several places; texts are read whole; columns beyond the named ones don't matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize

MASK = "[REDACTED]"
MAX_OWNERS = 12
AUTOMATON_BYTES = 32 << 20

#: Endings of names that hold secrets, letters only.
SECRET_ENDINGS = (
    "password", "passwd", "passphrase", "passcode", "kennwort", "passwort", "contrasena", "contraseña", "motdepasse", "senha", "parola", "wachtwoord", "secret", "token", "apikey", "secretkey", "signingkey", "encryptionkey", "accesskey", "privatekey", "authkey", "masterkey", "sharedkey", "sessionkey", "deploykey", "accountkey",
    "storagekey", "licensekey", "servicekey", "cryptkey", "hmackey", "jwtkey", "secrettext", "secretvalue", "credential", "credentials", "geheimnis", "secreto", "clavesecreta", "clesecrete", "schluessel",
    "bindpw", "adminpw", "rootpw", "userpw", "dbpw", "mailpw", "smtppw", "rootpass", "smtppass", "dbpass", "userpass", "adminpass", "mailpass", "ftppass", "loginpass", "sshpass", "pwd", "pswd",
)
SECRET_LAST_WORDS = {"pw", "pass", "pwd", "psw", "pswd", "creds", "cred", "psk", "pin", "clave", "mdp", "auth"}
#: Anchors that make a look worth while.
ANCHORS = (
    *SECRET_ENDINGS, "_key", "-key", "pwd", "pw", "pass", "psk", "creds", "clave", "mdp", "://", "bearer ", "basic ", "token ", "-----begin", "akia", "asia", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "sk_test_", "sk-", "xoxb-", "xoxp-", "xoxa-", "aiza", "eyj", "npm_", "sg.", "login", "access to", "log in", "sign in",
    "account", "geheim", "-u ", "--user", "connect(", "auth", "key=", "sig=",
)
PLACEHOLDER = re.compile(
    r"""(?ix)^(
      (your|my|the|insert|replace|change|enter|put|add|set|paste|fill|use|provide|choose|some|any)[-_\s].*
    | (change|replace|insert|fill)_?(me|this|it|here).* | .*(change.?me|replace.?me|place.?holder|redacted|your[-_ ]?(own|api|token|key|secret|password|client|auth).*|_here|-here|\ here)$
    | (example|dummy|sample|test|demo|fake|mock|todo|fixme|tbd|none|null|nil|undefined|empty|default|unset|n/a|redacted|masked|hidden|removed|secret|password|passwd|pass|pw|pwd|user|username|admin|root|token|key|foo|bar|foobar|foobarbaz|qwerty|letmein|changeit|string|value|text)\d{0,3}
    | (example|dummy|sample|fake|mock|test)[-_ ].* | .*[-_ ](example|placeholder|dummy)
    | [x*.#?_\-\s•…0]+ | [x*•]{5,}.{0,6} | .{0,6}[*•]{4,} | (.)\9+ | (abc|123|xyz)[\w-]{0,9} | 0?123456\d* | lorem\ ipsum.*
    )$"""
)
REFERENCE = re.compile(
    r"""(?ix)^(
      \$\w+ | \$\{.* | \$\(.* | %\(.*\)s? | %\w+% | %[sd] | \{\{.* | \{[\w.]+\} | <.*> | \#\{.* | \[\[.* | @\w[\w.]*@? | &\w+
    | (vault|env|ref|secret|secrets|ssm|arn|file|kms|op|sm|aws|gcp|azure|keyring|keychain|sops|data|config|consul|doppler)[:/].*
    | ~?/?(etc|run|var|home|opt|usr|secrets?|mnt|tmp|keys?|root|srv)/[\w./-]* | (?-i:\.{0,2}/[a-z0-9_.-]+(/[a-z0-9_.-]+)*) | [a-z]:\\.*
    | (process\.env|os\.environ|os\.getenv|system\.getenv|env|config|settings|secrets|vault|credentials|self|this|request|params|args|options|opts|ctx)[.\[(].*
    | !\w+.* | enc\[.* | \S[^\s@]*@\S+\.[a-z]{2,} | https?://\S* | [\w.-]+\.(pem|key|crt|txt|json|ya?ml|env|ini|cfg|conf|py|js|sh)
    )$"""
)
#: Words that a structured value holds if it is a placeholder that many copied.
PLACEHOLDER_WORD = r"(?i)(?:place.?holder|example|sample|dummy|change.?me|replace.?me|default|insecure|your[-_.])"
STOP = {"the", "a", "an", "is", "are", "must", "not", "be", "for", "of", "to", "your", "my", "and", "or", "in", "with", "no", "missing", "invalid", "required", "empty", "should", "has", "have", "please", "enter", "password", "token", "secret", "key", "wrong", "failed", "error", "expired", "by", "from", "this", "that", "it"}
WORDS3 = re.compile(r"[^\W\d_]{2,}(?: [^\W\d_]{2,}){2,7}")

NAME = re.compile(r"[A-Za-z_À-ÿ][\w$.À-ÿ-]*+")
#: What stands for a value that was taken out.
MASKED = re.compile(r"(?i)^[\[(<{*#_\s-]*(?:redacted|masked|hidden|removed|censored|filtered|secret|scrubbed|sanitized|omitted|suppressed|private|protected|confidential|withheld|elided|snip|truncated|x{3,}|\*{3,})(?:[ _-](?:for|by|value|secret|password|token|key|security|privacy|reasons|ed)\w*)*[\])>}*#_\s.!-]*$")
QUOTED_VALUE = re.compile(r"""["'`]?\s*\]?\s*(?:\[\s*\d*\s*\])?\s*(?::\s*[A-Za-z<>\[\]]+\s*=|=>|:=|\?\?=|\|\|=|\+=|=|:|,|\|\||\?\?|(?<=\s)(?=["'`]))\s*(?:str|String|string|bytes|Some|new String|SecretStr|Buffer\.from)?\s*([(\[]?)\s*(?:[bBrRuUfFL]{1,2}|@)?("{3}|'{3}|["'`])""")
DEFAULT_VALUE = re.compile(r"""["']?\s*\]?\s*\)?\s*(?:\|\||\?\?|:-|\bor\b)\s*(["'`])""")
TAG_VALUE = re.compile(r"""["']?\s*>\s*+([^<>\n]{4,}+)\s*+</([\w:.-]+)""")
ATTR_VALUE = re.compile(r"""["']?\s*[,;]?\s*(?:type\s*=\s*["']\w+["']\s*)?(?:value|content|default)\s*[=:]\s*(["']?)""")
CALL_VALUE = re.compile(r"""\s*(?::=|=|:)\s*(?:await\s+|new\s+)?([\w.:>-]+)\(\s*((?:["'][^"'\n]*["']\s*,\s*)+)(["'])""")
FLAG_VALUE = re.compile(r"""(?:\s+|=)(["']?)""")
ATTR_RUN, FLAG_RUN = re.compile(r"[^\s,}>]*"), re.compile(r"\S*")
BARE_VALUE = re.compile(r"""["']?\s*(?::|=)[ \t]*([^\s"'`#;|>&{\[(,][^\n]*)""")
ENV_VALUE = re.compile(r"""[ \t]+([^\s"'`#;|>&{\[(,=][^\n]*)""")
BLOCK_VALUE = re.compile(r"""["']?\s*:\s*[|>][+-]?[ \t]*\n[ \t]+([^\n]+)""")
LINE_START = re.compile(r"""[ \t﻿]*(?:(?://+|\#+|/?\*+|--|;+|<!--)\s*)?(?:(?:export|set|setenv|declare|local|env|ENV|ARG|LABEL|-|,|\{)\s+)*["']?(?:[\w-]+\.)*""")
NEXT_LITERAL = re.compile(r"""\s*(?:\+|\.|\\|,|&)?\s*\\?\s*(["'`])""")
CODE = re.compile(r"(?m)^\s*(#include|#define|import\s+[\w{*.]|from\s+[\w.]+\s+import|package\s+\w|public\s+(final\s+)?class|def\s+\w+\(|class\s+\w+|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=|function\s*\w*\(|static\s+\w|using\s+\w|<!doctype|<html|@\w+\()", re.I)

URL = re.compile(r"""(?<=[A-Za-z0-9])://([^\s/:@"'`<>]*):([^\s@"'`<>/]+|<[^>\s]*>)@(?=[\w.\[$<{-])""")
CONNECTION = re.compile(r"""(?i)(?<!\w)(?:password|pwd|accountkey|sharedaccesskey)\s*=\s*([^;"'`<\n]{4,})""")
CONNECTED = re.compile(r"""(?i)\b(?:server|data source|host|user id|uid|user|username|database|endpoint|account\w*)\s*=[^;\n"'`<]*;""")
HEADER = re.compile(r"""(?:(?<=["'`>=:,(\s])|^)(?:[Aa]uthorization["']?\s*[:=,]\s*["']?)?(Bearer|bearer|Basic|token|Token|ApiKey|Apikey|apikey|Digest)\s+([A-Za-z0-9+/][\w.~+/=:-]{13,}[\w~+/=-])(?![\w.~+/=-])""")
PROVIDER = re.compile(
    r"(?<![\w+/=-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[\w-]{20,}|AIza[\w-]{30,40}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{20,})(?![\w+/=])"
)
KEY_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
KEY_END = re.compile(r"-----END ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
KEY_NEAR = 20_000
KEY_BREAK = re.compile(r"\r?\n|\\+[nr]")
KEY_RUN = re.compile(r"[A-Za-z0-9+/=]+")
KEY_HEADER = re.compile(r"[\s\"'`+#*,;/]*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID): ?")
KEY_AROUND = " \t\r\"'`+#*,;/\\>|().&-"
QUERY = re.compile(r"""[?&]([A-Za-z_-]{2,}+)=([^&\s"'`<>#{}$]{8,})""")
CALL = re.compile(r"""\b\w*(?:login|log_in|logon|connect|authenticate|auth|signin|sign_in|set_?password)\(\s*(?:["'][^"'\n]*["']\s*,\s*)+(["'])([^"'\n]+)\1\s*[,)]""", re.I)
FALLBACK = re.compile(r"""\s*:-([^}\s"'`]+)\}""")
SHELL_USER = re.compile(r"""(?:^|\s)(?:-u|--user)(?:\s+|=)(["']?)[\w.@-]+:([^\s"']+)\1""")
SHELL_PASS = re.compile(r"""(?:^|\s)(?:-u|--user)(?:\s+|=)?["']?[\w.@-]+["']?\s+(?:\S+\s+){0,3}?-p\s?(?:(["'])([^"'\n]+)\1|([^\s"'-][^\s"']*))""")
SAID = (
    re.compile(r"(?i)(?:remember|note|hint|reminder|fyi|nb|merke|recuerda|rappel)\W+(?P<v>\S.*?) (?:is|ist|es|est) (?:the|das|la|le|el|our|my) (?:\w+ ){0,2}?(?:password|passphrase|secret|token|key|pw|kennwort|passwort|contraseña|clave|mot de passe)\b"),
    re.compile(r"(?i)\b(?:login|log in|sign in|access|account|credentials?|user|anmeldung|acceso|accès)\b[^\n]{0,80}?\b(?:is|with|as|are|mit|con|avec|using|ist|es)\s+[\w.@-]+\s?[:/]\s?(?P<v>\S+(?: [a-z]+ [a-z]+(?=\W*$))?)"),
    re.compile(r"(?i)\b(?:password|passphrase|passwd|pw|kennwort|passwort|contraseña|mot de passe|token|secret|api key)\b[^\n\"'=]{0,50}?\b(?:is|ist|es|est|now)\s+(?P<v>[^\s\"']+(?: [a-z]+ [a-z]+)?)\s*[.*/]*\s*$"),
)
COMMENT = re.compile(r"^\s*(//|#|/\*|\*|--|<!--|;|%|rem\b)", re.I)
STRUCTURED = re.compile(r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_+/=.~-]{14,}")
#: Generated passwords: punctuation among letters and digits, of both cases or long.
MIXED = re.compile(r"(?=.*\d)(?=.*[!@#$%^&*?:;,|])(?:(?=.*[a-z])(?=.*[A-Z])|(?=.*[A-Za-z])(?=.{14}))[A-Za-z0-9_+/=.~!@#$%^&*?:;,|-]{10,}")
CONFIRMED = f"^(?:{STRUCTURED.pattern}|{MIXED.pattern})$"
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=~-")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in ANCHORS:
        a.add_word(w, w)
    a.make_automaton()
    return a


@lru_cache(maxsize=100_000)
def secret_name(name: str) -> bool:
    """Whether a variable, key or flag of this name holds a secret; only its last words tell."""
    letters = re.sub(r"[^a-zà-ÿ]", "", name.lower())
    if letters.endswith(SECRET_ENDINGS):
        return not letters.endswith(("nexttoken", "pagetoken", "continuationtoken", "synctoken", "csrftoken"))
    words = re.findall(r"[A-ZÀ-Þ]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿ]+", name)
    return bool(words) and words[-1].lower() in SECRET_LAST_WORDS


def secret_value(v: str, phrase: bool = True, plain: bool = False) -> bool:
    """Whether a value could give access. ``phrase``: words may be a passphrase; ``plain``: lower-case letters may."""
    v = v.strip()
    if len(v) < 6 or PLACEHOLDER.match(v) or REFERENCE.match(v) or MASKED.match(v) or MASK in v or v.startswith("-----BEGIN"):
        return False
    if " " in v or "\t" in v:
        return phrase and bool(WORDS3.fullmatch(v)) and not STOP & set(v.lower().split()) and v == v.lower()
    if any(k in v for k in ("${", "{{", "}}", "%(", "()")) or len(set(v)) <= 3:
        return False
    letters, digits = any(map(str.isalpha, v)), any(map(str.isdigit, v))
    if not letters:
        return False
    if not digits:
        if re.fullmatch(r"[A-Za-z_.À-ÿ-]+", v):
            # a plain word or a name; a run of words without spacing may be a passphrase
            return (plain or len(v) >= 15) and v.isalpha() and v.islower() and not secret_name(v)
        return len(v) >= 8
    return not re.fullmatch(r"\d+(\.\d+)*[a-z]{1,3}|v?\d+(\.\d+)+\S{0,8}|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\S*", v)


def _literal(text: str, at: int, quote: str) -> int:
    """Where the literal that begins at ``at`` ends, or -1."""
    end = text.find(quote, at)
    while end > 0 and text[end - 1] == "\\" and len(quote) == 1:
        end = text.find(quote, end + 1)
    if end < 0 or (len(quote) == 1 and quote != "`" and "\n" in text[at:end]):
        return -1
    return end


def _joined(text: str, start: int, end: int, quote: str, listed: bool) -> tuple[str, list[tuple[int, int]]]:
    """The literal with those concatenated to it."""
    spans, pos = [(start, end)], end + len(quote)
    while True:
        m = NEXT_LITERAL.match(text, pos)
        if not m or ("," in m[0] and not listed) or ("\n" in m[0] and not listed and not any(c in m[0] for c in "+.\\&") and not text[start - 2 : start - 1].isspace()):
            break
        stop = _literal(text, m.end(), m[1])
        if stop < 0:
            break
        spans.append((m.end(), stop))
        pos = stop + 1
    return "".join(text[a:b] for a, b in spans), spans


def _named(text: str, start: int, name: str, config: bool) -> tuple[str, list[tuple[int, int]]] | None:
    """The secret given to the name that stands at ``start``."""
    at = start + len(name)
    for pattern in (QUOTED_VALUE, DEFAULT_VALUE):
        m = pattern.match(text, at)
        if m:
            quote = m[m.lastindex]
            end = _literal(text, m.end(), quote)
            if end < 0:
                continue
            opened = pattern is QUOTED_VALUE and m[1]
            value, spans = _joined(text, m.end(), end, quote, bool(opened))
            return (value, spans) if secret_value(_bare(value)) else None
    m = CALL_VALUE.match(text, at)
    if m:
        end = _literal(text, m.end(), m[3])
        # credentials in a call: a host comes first, the secret last
        if end > 0 and re.match(r"\s*\)", text[end + 1 : end + 9]) and "." in m[2]:
            return (text[m.end() : end], [(m.end(), end)]) if secret_value(text[m.end() : end]) else None
        return None
    m = ATTR_VALUE.match(text, at)
    if m:
        end = _literal(text, m.end(), m[1]) if m[1] else ATTR_RUN.match(text, m.end()).end()
        return (text[m.end() : end], [(m.end(), end)]) if end > 0 and secret_value(_bare(text[m.end() : end])) else None
    m = TAG_VALUE.match(text, at)
    if m and (text[at] in "\"'" or m[2] == name):
        value = m[1].rstrip()
        return (value, [(m.start(1), m.start(1) + len(value))]) if secret_value(_bare(value)) else None
    if text[max(0, start - 2) : start] == "--":
        m = FLAG_VALUE.match(text, at)
        if m:
            end = _literal(text, m.end(), m[1]) if m[1] else FLAG_RUN.match(text, m.end()).end()
            return (text[m.end() : end], [(m.end(), end)]) if end > 0 and secret_value(text[m.end() : end]) else None
    m = FALLBACK.match(text, at)
    if m:
        return (m[1], [m.span(1)]) if secret_value(m[1]) else None
    if config and LINE_START.fullmatch(text, text.rfind("\n", 0, start) + 1, start):
        m = BLOCK_VALUE.match(text, at) or BARE_VALUE.match(text, at)
        if not m and re.search(r"(?:ENV|ARG)\s+$", text[max(0, start - 8) : start]):
            m = ENV_VALUE.match(text, at)
        if m:
            value = re.sub(r"\s+[#;].*$", "", m[1]).rstrip().rstrip(",")
            spans = [(m.start(1), m.start(1) + len(value))]
            if m.re is BLOCK_VALUE:
                spans += _block_rest(text, m)
            return (value, spans) if not value.endswith((";", "{", ")")) and secret_value(_bare(value)) else None
    return None


def _block_rest(text: str, m: re.Match) -> list[tuple[int, int]]:
    """The further lines of a block scalar that are one token each."""
    out, opening, pos = [], text[text.rfind("\n", 0, m.start(1)) : m.start(1)], m.end()
    while text.startswith(opening, pos):
        line = FLAG_RUN.match(text, pos + len(opening))
        pos = text.find("\n", line.end())
        pos = len(text) if pos < 0 else pos
        if not line[0] or text[line.end() : pos].strip():
            break
        out.append(line.span())
    return out


def _bare(v: str) -> str:
    """Without the scheme of a header."""
    return re.sub(r"^(?:[Aa]uthorization:\s*)?(?:[Bb]earer|[Bb]asic|[Tt]oken|[Aa]pi[Kk]ey)\s+", "", v)


def _key_pieces(text: str, at: int, stop: int) -> Iterator[tuple[int, int, list[tuple[int, int]], bool]]:
    """The lines between two places, cut at escaped line ends, too: start, end, runs of key characters, whether nothing else stands there."""
    while at < stop:
        m = KEY_BREAK.search(text, at, stop)
        end = m.start() if m else stop
        runs = [k.span() for k in KEY_RUN.finditer(text, at, end) if k[0].strip("+/")]
        yield at, end, runs, not (text[at : runs[0][0]] + text[runs[-1][1] : end] if len(runs) == 1 else text[at:end]).strip(KEY_AROUND)
        at = m.end() if m else stop


def _key_lines(text: str, at: int, stop: int) -> list[tuple[int, int]]:
    """The key material on the lines from ``at`` on, up to the first line without."""
    out: list[tuple[int, int]] = []
    for a, b, runs, alone in _key_pieces(text, at, stop):
        if not runs:
            if text[a:b].strip(KEY_AROUND):
                break
            continue
        if KEY_HEADER.match(text, a, b):
            continue
        words = [text[c:d] for c, d in runs]
        mixed = [bool(re.search("[a-z]", w) and re.search("[A-Z]", w) and re.search("[0-9+/]", w)) for w in words]
        if alone and len(words[0]) < 16:
            # the last line of a block
            return out + runs if out and re.search("[0-9=+]", words[0]) else out
        if not any(x and (alone or len(w) >= 40) for x, w in zip(mixed, words)):
            break
        out += [k for k, x, w in zip(runs, mixed, words) if x and len(w) >= 16]
    return out


def _key_body(text: str, m: re.Match) -> list[tuple[int, int]] | None:
    """Where key material stands after the BEGIN mark ``m``: up to its END, or else as far as lines of it follow."""
    stop = text.find("-----BEGIN", m.end())
    stop = len(text) if stop < 0 else stop
    end = KEY_END.search(text, m.end(), stop)
    if end:
        body = text[m.end() : end.start()]
        material = re.search(r"[A-Za-z0-9+/=]{40,}", re.sub(r"\\[nr]|[\s\"'`+#*,;/\\]|//", "", body))
        # two marks far apart may be just that, unless most of what is between them is key material
        near = len(body) <= KEY_NEAR or 2 * sum(len(k) for k in re.findall(r"[A-Za-z0-9+/=]{40,}", body)) >= len(body)
        if near:
            if not material or len(set(material[0])) < 12:
                return None
            return [k for _, _, runs, alone in _key_pieces(text, m.end(), end.start()) for k in runs if alone or k[1] - k[0] >= 16]
    spans = _key_lines(text, m.end(), stop)
    held = "".join(text[a:b] for a, b in spans)
    return spans if len(held) >= 40 and len(set(held)) >= 12 else None


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """``start, end, value`` of every literal secret; of a joined literal each part has a row, the first with the whole value.

    A key block starts at its BEGIN mark, and its value is the empty string.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = [end for end, _ in anchors().iter(low)]
    if not hits:
        return []
    out: dict[int, tuple[int, str]] = {}
    starts: list[int] = []
    config = CODE.search(text) is None
    done_to, line_end = -1, -1

    def put(a: int, b: int, value: str) -> None:
        if a not in out:
            out[a] = (b, value)
            insort(starts, a)

    for at in hits:
        if at < done_to:
            continue
        begin, line_end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        done_to = line_end = len(text) if line_end < 0 else line_end
        line = text[begin:line_end]
        for m in KEY_BLOCK.finditer(line):
            whole = KEY_BLOCK.match(text, begin + m.start())
            if _key_body(text, whole):
                put(begin + m.start(), begin + m.end(), "")
        for m in URL.finditer(line):
            if secret_value(m[2], plain=True):
                put(begin + m.start(2), begin + m.end(2), m[2])
        connected = CONNECTED.search(line)
        for m in CONNECTION.finditer(line):
            if connected and connected.end() <= m.start() and secret_value(m[1], plain=True):
                put(begin + m.start(1), begin + m.end(1), m[1])
        for m in HEADER.finditer(line):
            if any(map(str.isdigit, m[2])) and secret_value(m[2]):
                put(begin + m.start(2), begin + m.end(2), m[2])
        for m in PROVIDER.finditer(line):
            if len(set(m[0])) > 8:
                put(begin + m.start(), begin + m.end(), m[0])
        for m in QUERY.finditer(line):
            if secret_name(m[1]) and secret_value(m[2]):
                put(begin + m.start(2), begin + m.end(2), m[2])
        for m in CALL.finditer(line):
            if secret_value(m[2]) and (" " in m[2] or re.search(r"\d|[^\w.-]", m[2])):
                put(begin + m.start(2), begin + m.end(2), m[2])
        for m in SHELL_USER.finditer(line):
            if secret_value(m[2]):
                put(begin + m.start(2), begin + m.end(2), m[2])
        for m in SHELL_PASS.finditer(line):
            g = 2 if m[2] else 3
            if secret_value(m[g]):
                put(begin + m.start(g), begin + m.end(g), m[g])
        said = COMMENT.match(line) is not None
        if said:
            for sentence in SAID:
                m = sentence.search(line)
                if m and secret_value(re.sub(r"[.,;]?\s*(\*/|-->)?$", "", m["v"])) and (re.search(r"\d|\W", m["v"].replace(" ", "")) or " " in m["v"]):
                    put(begin + m.start("v"), begin + m.end("v"), m["v"])
                    break
        for m in NAME.finditer(line):
            name = m[0]
            tail = name.rsplit(".", 1)[-1] if "." in name else name
            start = begin + m.end() - len(tail)
            tail = tail.rstrip("-")
            if tail in ("key", "secret") and "." in name:  # api.key and the like
                tail = ".".join(name.rsplit(".", 2)[-2:])
                start = begin + m.end() - len(tail)
            if not secret_name(tail[-200:]):
                continue
            got = _named(text, start, tail, config or said)
            if got:
                value, spans = got
                prefix = len(value) - len(_bare(value))
                (a, b), rest = spans[0], spans[1:]
                k = bisect_left(starts, a)
                if k == len(starts) or starts[k] >= b:
                    put(a + (prefix if a + prefix < b else 0), b, value[prefix:])
                    for c, d in rest:
                        put(c, d, "\0")
    return sorted((a, b, v) for a, (b, v) in out.items())


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, owners, copies, lines, values = [], [], [], [], []
        for key, repo, copy, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            for a, _, v in candidates(text):
                if v != "\0":
                    ids.append(key)
                    owners.append(repo)
                    copies.append(copy)
                    lines.append(text.count("\n", 0, a) + 1)
                    values.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owners, pa.string()), pa.array(copies, pa.int64()), pa.array(lines, pa.int64()), pa.array(values, pa.string())], names=["file_id", "owner", "copy", "line_no", "value"])


def index(df: DataFrame, key: str = "file_id", owner: str = "repo_name", content: str = "content") -> DataFrame:
    """``file_id, owner, copy, line_no, value`` of every candidate (value empty: a key block; copy: equal for equal contents)."""
    rows = df.select(F.col(key).cast("long").alias("file_id"), F.coalesce(F.col(owner).cast("string"), F.concat(F.lit("\0"), F.col(key).cast("string"))).alias("owner"), F.xxhash64(F.col(content)).alias("copy"), F.col(content).alias("content"))
    return rows.mapInArrow(_index, "file_id long, owner string, copy long, line_no long, value string")


def shared_values(indexed: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Values that are placeholders, as more owners have them than have a secret.

    Copies of one text count as one owner. A structured value needs a placeholder's word besides (then copies
    count, too), and one of a provider's format is never taken for a placeholder.
    """
    value = F.col("value")
    held = indexed.where((value != "") & ~value.rlike(f"^(?:{PROVIDER.pattern})$"))
    texts = held.groupBy("value", "copy").agg(F.min("owner").alias("owner"))
    by_count = texts.where(~value.rlike(f"^{STRUCTURED.pattern}$")).select("value", "owner")
    by_word = held.where(value.rlike(f"^{STRUCTURED.pattern}$") & value.rlike(PLACEHOLDER_WORD)).select("value", "owner")
    return by_count.unionByName(by_word).distinct().groupBy("value").agg(F.count("*").alias("owners")).where(F.col("owners") > max_owners)


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def automaton_of(values: list[str]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for v in values:
        a.add_word(v, len(v))
    if not len(a):
        return None
    a.make_automaton()
    return a


def value_automaton(shared) -> ahocorasick.Automaton | None:
    """The automaton of a broadcast list of values, built once per worker and broadcast."""
    at = shared._path
    if at not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[at] = automaton_of(shared.value)
    return _AUTOMATA[at]


def _ends(text: str, begin: int, end: int) -> bool:
    """Whether a value's token ends at ``end``; ``=`` goes on with it where it may be its padding."""
    if end == len(text) or text[end] not in TOKEN_CHARS:
        return True
    if text[end] != "=":
        return False
    stop = end
    while stop < len(text) and text[stop] == "=":
        stop += 1
    value = text[begin:end]
    body = len(value.rstrip("="))
    missing = -body % 4 - (len(value) - body) if body % 4 > 1 else 0
    return stop - end > missing or (stop < len(text) and text[stop] in TOKEN_CHARS)


def _begins(text: str, begin: int) -> bool:
    """Whether a value's token begins at ``begin``: ``=`` and ``/`` before it are no part of it, nor are hyphens with nothing before them."""
    if begin == 0 or text[begin - 1] not in TOKEN_CHARS or text[begin - 1] in "=/" or text[max(0, begin - 2) : begin] in ("\\n", "\\t", "\\r"):
        return True
    at = begin
    while at and text[at - 1] == "-":
        at -= 1
    return at < begin and (at == 0 or text[at - 1] not in TOKEN_CHARS or text[at - 1] in "=/")


def occurrences(text: str, a: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """Places where a confirmed value stands as a whole token."""
    out = []
    for end, size in a.iter(text):
        begin = end - size + 1
        if _begins(text, begin) and _ends(text, begin, end + 1):
            out.append((begin, end + 1))
    return out


def _rescan(shared):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = value_automaton(shared)
        for b in batches:
            ids, lines = [], []
            if a is not None:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if text:
                        for begin, _ in occurrences(text, a):
                            ids.append(key)
                            lines.append(text.count("\n", 0, begin) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], names=["file_id", "line_no"])

    return go


def slices_of(values: DataFrame, placeholders: DataFrame, automaton_bytes: int) -> Iterator[tuple[Broadcast, Broadcast]]:
    """Confirmed values and placeholders in broadcast lists of together about ``automaton_bytes``; one pair at least.

    A pair holds the values whose hash falls into its slice, so that what is broadcast at once doesn't grow with the data.
    """
    size = sum(t.agg(F.sum(F.octet_length("value")).alias("b")).first()["b"] or 0 for t in (values, placeholders))
    slices = int(size // automaton_bytes) + 1
    sc = values.sparkSession.sparkContext
    for k in range(slices):
        mine = F.pmod(F.xxhash64("value"), F.lit(slices)) == k
        yield sc.broadcast([r["value"] for r in values.where(mine).collect()]), sc.broadcast([r["value"] for r in placeholders.where(mine).collect()])


def without(rows: DataFrame, shared: DataFrame, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """The rows whose value isn't shared. ``shared`` is broadcast after a check of its size, else joined by shuffle, where
    a value that many rows hold is split by adaptive execution (each shared value is one row)."""
    size = shared.agg(F.sum(F.octet_length("value")).alias("b")).first()["b"] or 0
    return rows.join(F.broadcast(shared) if size <= broadcast_bytes else shared.hint("merge"), "value", "left_anti")


def find(df: DataFrame, key: str = "file_id", owner: str = "repo_name", content: str = "content", max_owners: int = MAX_OWNERS, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``file_id, line_no`` of every place, each once. Confirmed values are taken in slices as in ``redact``."""
    indexed = materialize(index(df, key, owner, content))
    shared = materialize(shared_values(indexed, max_owners).select("value"))
    # key blocks have no value to look up
    blocks, valued = indexed.where("value = ''"), indexed.where("value != ''")
    kept = materialize(without(valued.select("file_id", "line_no", "value"), shared))
    confirmed = kept.where(F.col("value").rlike(CONFIRMED)).select("value").distinct()
    places = kept.select("file_id", "line_no").unionByName(blocks.select("file_id", "line_no"))
    files = df.select(F.col(key).cast("long").alias("file_id"), F.col(content).alias("content"))
    for values, _ in slices_of(confirmed, shared.limit(0), automaton_bytes):
        places = places.unionByName(files.mapInArrow(_rescan(values), "file_id long, line_no long"))
    return places.distinct()


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """What is to be masked of the literal secrets of a text, with the value it belongs to (of a key block: none)."""
    spans, value = [], ""
    for begin, end, v in candidates(text):
        if v == "" and text.startswith("-----BEGIN", begin):
            spans += [(a, b, "") for a, b in _key_body(text, KEY_BLOCK.match(text, begin))]
        else:
            # parts of a joined literal follow the first one, which has the whole value
            value = value if v == "\0" else v
            spans.append((begin, end, value))
    return spans


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span replaced by a mask, overlapping ones by one."""
    out, pos = [], 0
    for begin, end in sorted(set(spans)):
        if begin >= pos:
            out += [text[pos:begin], MASK]
        pos = max(pos, end)
    return "".join(out) + text[pos:]


def redact_text(text: str | None, placeholders: frozenset[str] = frozenset(), a: ahocorasick.Automaton | None = None) -> str | None:
    """The text with each secret replaced by a mask; key blocks keep their marks and line structure."""
    if not text:
        return text
    return masked(text, [(x, y) for x, y, v in secret_spans(text) if v not in placeholders] + (occurrences(text, a) if a is not None else []))


SPANS = "file_id long, content string, spans array<struct<a: long, b: long, v: string>>"


def _redact(values, placeholders, first: bool, last: bool):
    """One pass with a slice of the values. Only the last one masks; those before it hand on their spans."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, known = value_automaton(values), frozenset(placeholders.value)
        for b in batches:
            texts, spans = b.column(1).to_pylist(), []
            for k, text in enumerate(texts):
                own = [] if not text else secret_spans(text) if first else [(x["a"], x["b"], x["v"]) for x in b.column(2)[k].as_py()]
                # an occurrence is a secret in any case, hence no value that a later slice could know as a placeholder
                spans.append([x for x in own if x[2] not in known] + ([(x, y, "") for x, y in occurrences(text, a)] if text and a is not None else []))
            if last:
                texts = [masked(t, [(x, y) for x, y, _ in z]) if t else t for t, z in zip(texts, spans)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["file_id", "content"])
            else:
                kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("v", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"a": x, "b": y, "v": v} for x, y, v in z] for z in spans], kind)], names=["file_id", "content", "spans"])

    return go


def redact(df: DataFrame, key: str = "file_id", owner: str = "repo_name", content: str = "content", max_owners: int = MAX_OWNERS, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``file_id, content`` with every secret masked, one row per row of ``df``.

    Candidates are found once; confirmed values and placeholders are taken in slices of ``automaton_bytes``,
    through which the texts pass in one chain of maps without shuffle.
    """
    indexed = materialize(index(df, key, owner, content).select("value", "owner", "copy").where("value != ''").distinct())
    shared = materialize(shared_values(indexed, max_owners).select("value"))
    confirmed = materialize(without(indexed.where(F.col("value").rlike(CONFIRMED)).select("value").distinct(), shared))
    out = df.select(F.col(key).cast("long").alias("file_id"), F.col(content).alias("content"))
    slices = list(slices_of(confirmed, shared, automaton_bytes))
    for k, (values, placeholders) in enumerate(slices, 1):
        last = k == len(slices)
        out = out.mapInArrow(_redact(values, placeholders, k == 1, last), "file_id long, content string" if last else SPANS)
    return out
