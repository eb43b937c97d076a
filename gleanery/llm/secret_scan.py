"""Secret scans: assignment-aware lexing of source and configuration text.

Base spans come from three patterns (assign, access, hex).  Beyond them a text is read into tokens (strings, names, bare words,
operators, line ends) and these into pairs of a name and literals: ``name = "..."``, ``name: value``, ``"name": "..."``,
``obj["name"] = ...``, ``a.b.name => ...``, ``NAME := ...``, ``name="..."`` of a call or a tag, ``--name value`` of a command.
A value may be pieces joined by ``+``, ``.`` or mere sequence, and a piece may be a name that was given a value before: constants
are propagated, in order, a later assignment replacing an earlier one; comments are read too, as what is commented out
leaks as well.  Where the name that gets a value is sensitive, the value
is scored by how telling the name is and how much it looks like a random string rather than a word or a placeholder; from half on,
each piece is a span: ``literal`` where it stands in the assignment itself, ``constant`` where it came through a name.

Texts that hold no marker at all are passed over by one search; the others are read once, in time linear in their length (no
pattern can go back over what it has read).  A text is a row's own work, no row meets another.

Results in special cases: a null or empty text has no spans, and the digest of an empty string; repeated rows are judged each; a
span is given once, base and method alike, so equal spans of a kind are one; an empty table gives an empty result; offsets are code
points, ends are exclusive; a value of over 8,192 characters isn't a secret (a key in PEM has 4,000 at most); other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed by the contract: the base patterns and how long a match must be.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # what is shorter is dropped anyway
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "literal", "constant")

#: How telling a part of a name is, from none to certain.  Parts are what capitals, digits and punctuation separate.
TELLING = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.95, "credential": 0.9, "credentials": 0.9, "token": 0.85, "apikey": 0.95, "bearer": 0.8,
    "authorization": 0.8, "auth": 0.6, "pass": 0.7, "private": 0.5, "signature": 0.5, "salt": 0.6, "cookie": 0.5, "key": 0.35,
}
#: Parts before ``key`` that make it a secret, and parts that make a name one about a secret, not its value.
KEY_OF = {"api", "access", "private", "signing", "encryption", "account", "auth", "master", "secret", "shared", "ssh", "client", "app", "license"}
ABOUT = {"name", "id", "url", "uri", "path", "file", "type", "length", "len", "count", "field", "label", "policy", "hint", "prompt", "expiry", "expires", "ttl", "header", "format", "min", "max", "regex", "pattern", "size", "public"}
#: Values that stand for one.
PLACEHOLDER = re.compile(r"(?:change.?me|your|example|placeholder|dummy|sample|test|todo|xxx|\*\*\*|\.\.\.|none|null|true|false|undefined|redacted|insert|replace|default|enter|secret|password|token)", re.I | re.A)
TEMPLATE = re.compile(r"\A\$\w+\Z|\$\{|\{\{|<\w+>|%\(\w+\)|%s\Z|\{\w*\}\Z")

#: The least score of a secret, the lengths that a secret may have, and the pieces that a name may hand on.
LEAST_SCORE, LEAST_LENGTH, MOST_LENGTH, CHAIN = 0.5, 6, 8192, 64

#: One token.  Every alternative is possessive, and an escape outside a string is a token, so reading is linear.
TOKEN = re.compile(
    r"""
      (?P<text>  \"\"\"(?:[^"\\]++|\\.|"(?!""))*+\"\"\" | '''(?:[^'\\]++|\\.|'(?!''))*+'''
               | "(?:[^"\\\n]++|\\.)*+" | (?<![\w])'(?:[^'\\\n]++|\\.)*+' | `(?:[^`\\\n]++|\\.)*+` )
    | (?P<flag>  (?<![\w-])--?[A-Za-z][\w-]*+ )
    | (?P<word>  [A-Za-z_$][\w$]*+(?:(?:\.|->|::|-(?=[A-Za-z]))[A-Za-z_$][\w$]*+)*+ )
    | (?P<bare>  [0-9][\w]*+ )
    | (?P<op>    => | := | ==++ | != | <= | >= | [=:+.,;()\[\]{}<>] )
    | (?P<line>  \n )
    | (?P<note>  \# | // )
    | (?P<gap>   [ \t\r\f\v]++ )
    | (?P<other> \\. | . )
    """,
    re.X | re.S,
)
#: A value of a configuration line without quotes: up to white space or what ends a value.
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>#]++")
MARKER = r"(?i:passw|passp|pwd|secret|credential|token|api.?key|bearer|auth|pass|private|signature|salt|cookie|key)"


def parts_of(name: str) -> list[str]:
    """``dbPassword2``, ``db-password`` and ``DB_PASSWORD`` are db and password; only what stands after the last dot counts."""
    last = re.split(r"\.|->|::", name)[-1]
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", last)
    return [p.lower() for p in re.split(r"[^A-Za-z]+", split) if p]


def telling(name: str) -> float:
    """How likely what a name holds is a secret."""
    parts = parts_of(name)
    if not parts or parts[-1] in ABOUT or parts[0] in ABOUT:
        return 0.0
    best = max(TELLING.get(p, 0.0) for p in parts)
    if any(a in KEY_OF and b in ("key", "keys") for a, b in zip(parts, parts[1:], strict=False)):
        best = max(best, 0.9)
    return best


def entropy(value: str) -> float:
    """Bits of a character by their frequencies in the value."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def randomness(value: str) -> float:
    """Between 0 and 1: how little a value looks like prose, a path or a placeholder."""
    if len(value) < LEAST_LENGTH or any(c.isspace() for c in value) or TEMPLATE.search(value):
        return 0.0
    found = PLACEHOLDER.match(value)
    if (found and len(value) < 2 * len(found[0]) + 4) or len(set(value)) < 4:
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    spread = min(1.0, entropy(value) / 3.5)
    return min(1.0, spread * (0.45 + 0.2 * kinds) + min(0.2, len(value) / 160))


class Reader:
    """Reads one text: pairs of names and literals, with what names hold so far."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup not in ("gap", "note")]
        self.known: dict[str, tuple[tuple[int, int], ...]] = {}
        self.spans: set[tuple[str, int, int]] = set()
        self.best = 0.0

    def _said(self, i: int) -> str:
        _, a, b = self.tokens[i]
        return self.text[a:b]

    def _is(self, i: int, *ops: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "op" and self._said(i) in ops

    def _inside(self, i: int) -> tuple[int, int]:
        """Where a string's content stands."""
        _, a, b = self.tokens[i]
        n = 3 if self.text.startswith(('"""', "'''"), a) and b - a >= 6 else 1
        return a + n, b - n

    def _target(self, i: int) -> tuple[str, int] | None:
        """A name that something may be assigned to, and the place of the sign after it."""
        kind = self.tokens[i][0]
        if kind in ("word", "text"):
            name = self._said(i) if kind == "word" else self.text[slice(*self._inside(i))]
            if not name or len(name) > 200 or "\n" in name:
                return None
            at = i + 1
            if self._is(at, "]"):  # obj["name"] = ...
                at += 1
            elif self._is(at, ":") and kind == "word" and at + 2 < len(self.tokens) and self.tokens[at + 1][0] == "word" and self._is(at + 2, "=") and not telling(self._said(at + 1)):
                at += 2  # name: type = ..., and not prose: name = ...
            if self._is(at, "=", ":", ":=", "=>"):
                return name, at
        if kind == "flag":
            if self._is(i + 1, "="):
                return self._said(i).lstrip("-"), i + 1
            return self._said(i).lstrip("-"), i
        return None

    def _value(self, i: int) -> tuple[list[tuple[str, tuple[tuple[int, int], ...]]], int]:
        """Pieces of a value that begins at token i, each with the spans that it stands for, and the token after it."""
        pieces: list[tuple[str, tuple[tuple[int, int], ...]]] = []
        start, joined = i, True
        while i < len(self.tokens):
            kind, a, b = self.tokens[i]
            if kind == "text" and (joined or pieces):
                # a string right before a sign is the next pair's name
                if pieces and self._is(i + 1, "=", ":", ":=", "=>"):
                    break
                pieces.append(("literal", (self._inside(i),)))
            elif kind == "word" and joined and self._said(i) in self.known and not self._is(i + 1, "(", "=", ":", ":=", "=>"):
                pieces.append(("constant", self.known[self._said(i)]))
            elif kind in ("word", "bare", "other", "flag") and joined and i == start and (found := BARE.match(self.text, a)):
                if kind == "word" and found.end() == b and (self._is(i + 1, "(") or not re.search("[0-9]", found[0])):
                    break  # a call, or a name that nothing is known of
                end = found.end()
                while end > a and self.text[end - 1] in ".:,":
                    end -= 1
                pieces.append(("literal", ((a, end),)))
                while i < len(self.tokens) and self.tokens[i][1] < found.end():
                    i += 1
                break
            elif kind == "op" and pieces and not joined and self._said(i) in ("+", "."):
                joined = True
                i += 1
                continue
            elif kind == "line" and joined and pieces:
                i += 1  # goes on after a sign of joining
                continue
            elif kind == "op" and joined and self._said(i) == "(":
                i, start = i + 1, i + 1
                continue
            else:
                break
            joined = False
            i += 1
        return pieces, i

    def read(self) -> None:
        i = 0
        while i < len(self.tokens):
            found = self._target(i)
            if not found:
                i += 1
                continue
            name, at = found
            pieces, after = self._value(at + 1)
            if pieces:
                self._assigned(name, pieces)
            # a value that is a name with a sign of its own is read again as a target
            i = max(at + 1, after) if pieces else at + 1

    def _assigned(self, name: str, pieces: list[tuple[str, tuple[tuple[int, int], ...]]]) -> None:
        all_spans = tuple(s for _, spans in pieces for s in spans)
        if len(all_spans) > CHAIN:  # a name of names of names: the value is judged, and no longer handed on
            self.known.pop(name, None)
        else:
            self.known[name] = all_spans
        told = telling(name)
        if not told:
            return
        if sum(b - a for a, b in all_spans) > MOST_LENGTH:  # a document, not a secret
            return
        value = "".join(self.text[a:b] for a, b in all_spans)
        score = told * randomness(value)
        if score >= LEAST_SCORE:
            self.best = max(self.best, score)
            for kind, spans in pieces:
                self.spans |= {(kind, a, b) for a, b in spans if a < b}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], float]:
    """(base spans, all spans, best score of a named literal) of one text."""
    base = base_spans(text)
    reader = Reader(text)
    reader.read()
    return base, base + list(reader.spans), reader.best


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for b in batches:
        column = b.column("text")
        marked = pc.fill_null(pc.match_substring_regex(column, rf"{MARKER}|AKIA[A-Z0-9]|[0-9a-f]{{16}}"), False).to_pylist()
        cols: list[list] = [[], [], [], [], [], [], []]
        for i, there in enumerate(marked):
            if there:
                base, spans, score = scan_text(column[i].as_py())
                n = Counter(kind for kind, _, _ in base)
                row = (n["assign"], n["access"], n["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(set(spans)) - len(base), score)
            else:
                row = (0, 0, 0, nothing, "", 0, 0.0)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named", "score"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_named (spans the lexer added), score (its best one)."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(common.frugal(_run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long, score double")
