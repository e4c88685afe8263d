"""Literal credentials in source code and configuration: where each begins, and the text with it hidden.

Every literal that stands where a credential could stand is a candidate: what is assigned, passed, sent as a
header, written into an address or told in a comment. How unnatural a candidate looks is measured in
characters per subword under a public tokenizer vocabulary: words need few subwords, random strings many.
The place a candidate stands in sets how natural it may look and still count (see ``LIMITS``).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import TOKENIZER_FOLDER, token_counts


class Span(NamedTuple):
    """[start, end) in code points of the hidden part; ``begin``: where the credential begins."""

    begin: int
    start: int
    end: int
    kind: str


# Words in a name whose credentials people choose; those whose credentials machines make; those of either.
CHOSEN_WORDS = frozenset("pass password passwd passphrase passcode pw pwd passwort kennwort contrasena motdepasse".split())
MADE_WORDS = frozenset("secret secrets token tokens bearer cred creds credential credentials apikey auth authorization authtoken unlock signature sig psk otp".split())
LOGIN_WORDS = frozenset("login signin logon".split())
# Words that make "key" a credential.
KEY_WORDS = frozenset("with api access auth secret private signing sign encryption client master service account session app deploy tls ssl license hmac jwt shared storage webhook consumer".split())
# Words that end a name about a credential that holds none.
ABOUT_WORDS = frozenset("limit budget name names file path dir length len min max count id ids ttl expiry expires expiration type url uri endpoint field header prefix suffix env var policy rotation days hours minutes seconds enabled required kind at size bytes algorithm alg format version hint label title description help prompt placeholder regex pattern timeout interval number index mode provider store window usage used".split())
# Words of names whose random values are no credentials.
PUBLIC_WORDS = frozenset("public pub host checksum revision digest sha sha1 sha256 md5 hash commit etag id uuid guid build icon image integrity fingerprint cert certificate version magic nonce iv salt trace span request correlation data".split())

#: The most characters per subword of a credential, and its least length, by the place it stands in.
LIMITS = {
    "format": (float("inf"), 16),  # a format that only credentials have
    "chosen": (float("inf"), 4),  # assigned to a password, which may be plain words
    "chosen part": (5.0, 5),  # a password elsewhere: an argument, an option, an address
    "scheme": (3.6, 5),  # behind Bearer, Basic or Token
    "made": (3.6, 8),  # under the name of a token, key or secret
    "login": (3.0, 8),  # under the name of a login, where plain account names stand too
    "said": (2.9, 8),  # in a comment that speaks of logging in
    "neutral": (2.3, 16),  # under any other name
}

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_STAND_IN = re.compile(
    r"(?ix) ^$ | ^[<\[{(].*[>\]})]$ | \$\{ | \$\( | \{\{ | \{\} | \{\w*\} | ^\$\w+ | ^%\w+%$ | ^@\w+@$ | <[^<>]*> | ^<[a-z]+$ | ^(.)\1*$ | ^[x*.\-_#?0]+$"
    r" | \b(?:your|my|some|insert|enter)[\s_\-] | re?place[\s_\-]?me | change[\s_\-]?(?:me|it|this) | placeholder | example | dummy | redacted | ^(?:todo|tbd|fixme|none|null|nil|undefined|true|false|yes|no|on|off|test|secret|password|passwd|token|changeit|default|unset|empty|hidden|masked|string|str|text|required|optional|invalid|wrong|missing|prompt|stdin|basic|bearer|digest|usize|value|auth)$"
)
_REFERENCE = re.compile(r"(?i)^(?:/|\./|\.\./|~/|[a-z]:\\)[\w./\\\-~]*$|^(?:vault|kv|secret|secrets|ssm|arn|env|file|ref|op|keychain|aws-sm|gcp-sm)(?::|/)|^(?:env|process\.env|std::env|os\.environ|os\.getenv|config|settings|self|ctx|vault|secrets?)[.(\[:]|^(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2)\b|^https?://")
_NUMBER = re.compile(r"[-+]?[\d_.,]+(?:e\d+)?(?:ms|s|m|h|d|k|kb|mb|gb|%)?", re.I)
_FORMAT = re.compile(
    r"(?<![A-Za-z0-9_])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}|(?<![A-Za-z0-9])github_pat_\w{20,}|(?<![A-Za-z0-9])glpat-[\w\-]{16,}|(?<![A-Za-z0-9])xox[abeprs]-[A-Za-z0-9\-]{16,}"
    r"|(?<![A-Za-z0-9])[a-z]{2,5}_(?:live|prod|test|pat|secret|sk|key)_[A-Za-z0-9]{16,}|(?<![A-Za-z0-9])sk-[A-Za-z0-9_\-]{20,}|(?<![A-Za-z0-9])AIza[\w\-]{35}|(?<![A-Za-z0-9_.\-])eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,}"
)
_HEX = re.compile(r"(?i)(?:0x)?[0-9a-f]{16,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")

_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_PUBLIC_BLOCK = re.compile(r"-----BEGIN (?!(?:[A-Z0-9]+ )*PRIVATE KEY)[A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
_NAME = r"(?P<name>[A-Za-z_$][\w.$\-]*)"
_QUOTED = r"""(?:b|r\#*|br)?(?:"(?P<dq>(?:[^"\\\n]|\\.)*)"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|`(?P<bq>[^`\n]*)`)"""
_OPTIONS = "-u|--user|--proxy-user"
_SHAPE = r"[A-Za-z0-9+/=_.\-~!@#$%^&*]"
_RULES = [
    # name = "value", "name": 'value', const NAME: &str = b"value", name := value, name => value
    re.compile(_NAME + r"""["']?\]?\s*(?::\s*&?\s*(?:'\w+\s+)?(?:str|String|\[u8;?[^\]]*\]|&\[u8\])\s*=|=>|:=|(?<![=!<>])=(?!=)|:(?!:))\s*\(?\s*""" + _QUOTED),
    # <entry key="name" value="value"/>
    re.compile(r"""\b(?:key|name|id)\s*=\s*["'](?P<name>[\w.\-]+)["']\s+(?:value|content)\s*=\s*(?:"(?P<dq>[^"\n]*)"|'(?P<sq>[^'\n]*)')"""),
    # <name>value</name>
    re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*)(?:\s[^<>\n]*)?>(?P<plain>[^\n]*?)</(?P=name)>"),
    # name: value, name=value, also in comments, queries, headers and connection strings
    re.compile(_NAME + r"""[ \t]*(?:=(?!=)|:(?!:)[ \t])[ \t]*(?P<plain>(?:(?:Bearer|Basic|Token)\s+)?[^\s"'`;&<>()\[\]{},]+)"""),
    # --name value
    re.compile(r"""(?<!\S)--?(?P<name>[A-Za-z][\w\-]*)[ =]+(?:"(?P<dq>[^"\n]*)"|'(?P<sq>[^'\n]*)'|(?P<plain>[^\s"'\-][^\s"']*))"""),
    # -u user:value
    re.compile(r"""(?<!\S)(?P<name>""" + _OPTIONS + r""")[ =]+["']?[^\s:"']+:(?P<plain>[^\s"']+)"""),
    # machine host login user name value
    re.compile(r"(?:login|user|account)[ \t]+\S+[ \t]+(?P<name>[A-Za-z_][\w\-]*)[ \t]+(?P<plain>\S+)"),
    # name("value"), name(("value"
    re.compile(r"\b(?P<name>[A-Za-z_]\w*)!?\(\(?\s*" + _QUOTED + r"(?=\s*[,)])"),
    # "name", "value"
    re.compile(r"""["'](?P<name>[A-Za-z][\w.\-]*)["']\s*,\s*(?:Some\(\s*)?""" + _QUOTED),
    # let name = anything("value") and let name = reference.unwrap_or_else(|_| "value")
    re.compile(r"\b" + _NAME + r"\s*(?::\s*[\w&<>\[\]; ']+)?=\s*(?P<call>[A-Za-z_][^\"\n;]*?(?:\(\"[^\"\n]*\"\)[^\"\n;]*?)?(?:decode\w*|from\w*|unwrap_or\w*|or_else\w*|new|to_vec|literal|value|String::from)!?\((?:\|\w*\|\s*)?)\s*" + _QUOTED),
]
_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s:/@\"'<>]*):(?P<plain>[^\s@/\"'<>]+)@")
_BASIC = re.compile(r"\bbasic_auth\(\s*[^,\n]+,\s*(?:Some\(\s*)?" + _QUOTED)
_PIECES = re.compile(_NAME + r"\s*(?::\s*[^=\n]+)?=\s*(?:concat!\s*\(|\[|\()\s*(?P<body>(?:b?\"[^\"\n]*\"\s*[,+]?\s*){2,})[\])]")
_JOINED = re.compile(_NAME + r"\s*(?::\s*[^=\n]+)?=\s*(?P<body>b?\"[^\"\n]*\"(?:\.to_(?:string|owned)\(\))?(?:\s*(?:\+|\\)\s*&?b?\"[^\"\n]*\"){1,})")
_BYTES = re.compile(_NAME + r"\s*(?::\s*[^=\n]+)?=\s*&?(?:vec!)?\[\s*(?P<body>(?:(?:0x[0-9A-Fa-f]{1,2}|\d{1,3}|b'[^'\n]+')(?:u8)?\s*,?\s*){8,})\]")
_FORMATS = r"AKIA|ASIA|gh[pousr]_|github_pat|glpat|xox|_(?:live|prod|test|pat|secret|sk|key)_|sk-|AIza|eyJ"
_MAY_FORMAT = re.compile(_FORMATS)
_SCHEMES = "bearer|basic|token"
_SCHEME = re.compile(rf"(?i)^({_SCHEMES})\s+")
#: Words of the names, schemes and addresses of credentials; those that hold another one are found by it.
_NAMED = CHOSEN_WORDS | MADE_WORDS | LOGIN_WORDS | {"key", "sign", "://", *_SCHEMES.split("|")}
_SIGNS = tuple(sorted(w for w in _NAMED if not any(v != w and v in w for v in _NAMED)))
_OTHER_SIGNS = re.compile(rf"(?<!\S)(?:{_OPTIONS})[ =]|{_FORMATS}")
_PIECE_SIGN = re.compile(r'=\s*(?:concat!\s*\(|\[|\()\s*b?"')
_JOINED_SIGN = re.compile(r'"(?:\.to_\w+\(\))?\s*[+\\]')
_BYTES_SIGN = re.compile(r"\[\s*(?:0x|\d|b')")
_RUN = re.compile(_SHAPE + "{16,}")
_TALK = re.compile(r"(?i)\b(?:log(?:s|ged)?[ -]?in(?:to)?|login|sign(?:s|ed)?[ -]in|pw|pwd|pass(?:word|phrase|code)?s?|creds?|credentials?|secret|token|key|unlocks?|(?:just|can|may|to) use|use .* for now)\b")
_SAID = re.compile(r"(?<![^\s'\"`(])[^\s\"'`<>()\[\]{},;]{8,}")
_NOT_SAID = re.compile(r"::|://|^\S+@\S+\.\w+$|^[\w.\-]*/[\w./\-]*$|^v?\d[\d.\-:_]*\w?$|^\w+[:=]|^[A-Za-z_][a-z_0-9]*$|^[A-Z_0-9]+$|^[\w.]+\(")
_OPEN_END = re.compile(r"[=(,\[+\\|&]\s*$|=>\s*$")
_OPEN_START = re.compile(r"\s*[+.)\]\"|]")


class Candidate(NamedTuple):
    """``value`` that stands in ``place``; ``parts``: its [start, end) pieces; ``natural``: whether plain words may count."""

    place: str
    value: str
    begin: int
    parts: tuple[tuple[int, int], ...]
    kind: str
    natural: bool = False


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _PARTS.findall(name)]


def place_of(name: str) -> str:
    """What a name says of the literal under it: chosen, made, login, neutral, or public for what is no secret."""
    words = [w for w in name_words(name) if not w.isdigit()]
    if not words or words[-1] in ABOUT_WORDS:
        return "public"
    held = set(words)
    if held & {"public", "pub", "host"}:
        return "public"
    if held & CHOSEN_WORDS:
        return "chosen"
    if held & MADE_WORDS or any(w in ("key", "keys") and before in KEY_WORDS or (before, w) == ("sign", "with") for before, w in zip(["", *words], words)):
        return "made"
    if held & LOGIN_WORDS:
        return "login"
    return "public" if held & PUBLIC_WORDS else "neutral"


def is_credential(candidate: Candidate, subwords: int) -> bool:
    """Whether a candidate of so many subwords looks unnatural enough for the place it stands in."""
    value, place = candidate.value, candidate.place
    if _STAND_IN.search(value) or _REFERENCE.search(value):
        return False
    most, least = LIMITS[place]
    if len(value) < least or len(value) >= most * max(1, subwords):
        return False
    if place == "format":
        return True
    plain = re.fullmatch(r"[A-Za-z]+(?:[ _.\-][A-Za-z]+)*", value) is not None or " " in value and not re.search(r"\d", value)
    if place == "chosen" and candidate.natural:
        return not value.endswith((":", "?", "...")) and not CHOSEN_WORDS & set(name_words(value))
    if _NUMBER.fullmatch(value) or value.endswith((":", "?", "...")):
        return False
    # words joined by signs are natural whatever their length, unless capitals break them into short subwords
    if plain and not (re.search("[a-z][A-Z]|[A-Z]{2}[a-z]", value) and len(value) < 2.6 * subwords):
        return False
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    if place == "neutral":
        return kinds == 3 and re.fullmatch(_SHAPE + "+", value) is not None and not _HEX.fullmatch(value)
    if place == "said":
        return kinds >= 2 and not _HEX.fullmatch(value)
    return True


def _signs(text: str) -> Iterator[int]:
    """Where the name, option, address, format or form of a credential stands."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals become two letters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for sign in _SIGNS:
        at = low.find(sign)
        while at >= 0:
            yield at
            at = low.find(sign, at + 1)
    for rule in (_OTHER_SIGNS, _PIECE_SIGN, _JOINED_SIGN):
        for m in rule.finditer(text):
            yield m.start()


def _segments(text: str) -> list[tuple[int, int]]:
    """[start, end) of the statements to look at: lines with a sign, and the lines that a statement runs over."""
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    starts.append(len(text) + 1)
    marked = {bisect_right(starts, at) - 1 for at in _signs(text)}
    marked |= {bisect_right(starts, m.start()) - 1 for m in _RUN.finditer(text) if (v := m[0]) != v.lower() and v != v.upper() and re.search(r"\d", v)}
    marked |= {bisect_right(starts, m.start()) - 1 for m in _COMMENT_LINE.finditer(text) if _TALK.search(m[0])}
    line = lambda i: text[starts[i] : starts[i + 1] - 1]
    runs: list[list[int]] = []
    for i in sorted(marked):
        if runs and i <= runs[-1][1]:
            continue
        first = last = i
        while first > 0 and (_OPEN_END.search(line(first - 1)) or _OPEN_START.match(line(first))):
            first -= 1
        while last + 2 < len(starts) and (_OPEN_END.search(line(last)) or _OPEN_START.match(line(last + 1))):
            last += 1
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(last, runs[-1][1])
        else:
            runs.append([first, last])
    return [(starts[a], starts[b + 1] - 1) for a, b in runs]


_COMMENT_LINE = re.compile(r"(?m)(?:^|(?<=[ \t]))(?://+!?|#+|--|/\*+|\*|;+|<!--)[ \t]+\S.*$")


def _found(text: str) -> tuple[list[Candidate], list[tuple[int, int]]]:
    """Candidates in the order in which they are believed, and the stretches that hold public blocks."""
    out: list[Candidate] = []
    closed = [m.span() for m in _PUBLIC_BLOCK.finditer(text)] if "-----BEGIN" in text else []
    for m in _BLOCK.finditer(text) if "-----BEGIN" in text else ():
        body = re.sub(r"\s", "", m[1])
        if len(body) >= 32 and not _STAND_IN.search(body):
            out.append(Candidate("block", body, m.start(), (m.span(1),), "block"))
        closed.append((m.end(1), m.end()))
    segments = _segments(text)
    for lo, hi in segments:
        for sign, rule in ((_PIECE_SIGN, _PIECES), (_JOINED_SIGN, _JOINED)):
            for m in rule.finditer(text, lo, hi) if sign.search(text, lo, hi) else ():
                pieces = list(re.finditer(r'"([^"\n]*)"', m["body"]))
                at = m.start("body")
                value = "".join(p[1] for p in pieces)
                place = "format" if _FORMAT.search(value) else place_of(m["name"])
                if place != "public":
                    out.append(Candidate(place, value, at + pieces[0].start(), tuple((at + p.start(1), at + p.end(1)) for p in pieces), "pieces"))
    for lo, hi in segments:
        for m in _BYTES.finditer(text, lo, hi) if _BYTES_SIGN.search(text, lo, hi) else ():
            if place_of(m["name"]) in ("chosen", "made") and len(set(re.findall(r"0x\w+|\d+|'[^']'", m["body"]))) > 4:
                out.append(Candidate("bytes", m["body"], m.start("body"), (m.span("body"),), "bytes"))
        for m in _LOGIN.finditer(text, lo, hi):
            out.append(Candidate("address", m["plain"], m.start("plain"), (m.span("plain"),), "login"))
        for m in _BASIC.finditer(text, lo, hi):
            if m.lastgroup and m[m.lastgroup]:
                out.append(Candidate("address", m[m.lastgroup], m.start(m.lastgroup), (m.span(m.lastgroup),), "login"))
    for number, rule in enumerate(_RULES):
        for lo, hi in segments:
            for m in rule.finditer(text, lo, hi):
                part = next((p for p in ("dq", "sq", "bq", "plain") if p in m.re.groupindex and m[p] is not None), None)
                if part is None or m["name"] == "basic_auth":
                    continue
                value, start = m[part], m.start(part)
                after = text[m.end(part) : m.end(part) + 2]
                if part == "plain" and ((after[:1] in tuple("([<") and after != "</") or "::" in value):
                    continue
                scheme = _SCHEME.match(value)
                if scheme:
                    value, start = value[scheme.end() :], start + scheme.end()
                value = value.rstrip(".,;")
                place = "scheme" if scheme else "chosen" if m["name"].startswith("-") else place_of(m["name"])
                natural = number < 4 and place == "chosen" and "=>" not in text[m.end("name") : start]
                if part == "plain" and natural and number == 3:
                    # an unquoted word is a literal only where it is all that its line sets
                    before = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
                    natural = re.fullmatch(r"\s*(?:export\s+|[#;]+\s*|//\s*|-\s+)?", before) is not None and re.match(r"\s*(?:\n|\Z)", text[m.end(part) :]) is not None and value == m[part]
                if place == "chosen" and not natural:
                    place = "chosen part"
                if _FORMAT.search(value) and place != "public":
                    place = "format"
                if place != "public":
                    out.append(Candidate(place, value, start, ((start, start + len(value)),), place, natural))
    for lo, hi in segments:
        for m in _COMMENT_LINE.finditer(text, lo, hi):
            if _TALK.search(m[0]):
                for said in _SAID.finditer(text, m.start(), m.end()):
                    value = said[0].rstrip(".,;:")
                    if not _NOT_SAID.search(value):
                        out.append(Candidate("said", value, said.start(), ((said.start(), said.start() + len(value)),), "said"))
    for m in _FORMAT.finditer(text) if _MAY_FORMAT.search(text) else ():
        out.append(Candidate("format", m[0], m.start(), (m.span(),), "format"))
    return out, closed


def find_all(texts: list[str], folder: str = TOKENIZER_FOLDER) -> list[list[Span]]:
    """Credentials of each text in order of their begin; of overlapping candidates the first believed counts.

    The candidates of all texts are encoded together.
    """
    found = [_found(t) for t in texts]
    values = list(dict.fromkeys(c.value for candidates, _ in found for c in candidates if c.place in LIMITS))
    subwords = dict(zip(values, token_counts(values, folder))) if values else {}
    out = []
    for candidates, closed in found:
        spans: list[Span] = []
        taken = _Taken(closed)
        for c in candidates:
            if c.place in ("block", "bytes"):
                sure = True
            elif c.place == "address":
                sure = len(c.value) >= 3 and not _STAND_IN.search(c.value) and not _REFERENCE.search(c.value)
            else:
                sure = is_credential(c, subwords[c.value])
            if sure:
                spans += [Span(c.begin, a, b, c.kind) for a, b in c.parts if taken.take(a, b)]
        out.append(sorted(spans))
    return out


class _Taken:
    """Disjoint stretches in order; a stretch that meets an earlier one is refused."""

    def __init__(self, stretches: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(stretches):
            self.take(a, b)

    def take(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        if end <= start or at and self.ends[at - 1] > start or at < len(self.starts) and self.starts[at] < end:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def find_credentials(text: str, folder: str = TOKENIZER_FOLDER) -> list[Span]:
    """Credentials of one text, see :func:`find_all`; an empty or null text has none."""
    return find_all([text], folder)[0] if text else []


_ELEMENT = re.compile(r"b'(\\x|\\)?([^'\\]*)'|\b(0x)?([0-9A-Fa-f]+)(?=u8|\b)")


def _masked(text: str, span: Span) -> str:
    """What stands in place of a span: as many characters, and still a literal of the same kind."""
    hidden = text[span.start : span.end]
    if span.kind == "bytes":
        return _ELEMENT.sub(lambda m: f"b'{m[1] or ''}{('0' if m[1] else '*') * len(m[2])}'" if m[2] is not None else (m[3] or "") + "0" * len(m[4]), hidden)
    # in quotes and key blocks any sign will do; elsewhere only a letter has no other meaning
    quoted = span.kind in ("block", "pieces") or text[span.start - 1 : span.start] in tuple("\"'`") and span.start > 0
    return re.sub(r"[^\r\n]", "*" if quoted else "x", hidden)


def hide(text: str, spans: list[Span]) -> str:
    """``text`` with the spans masked; line ends and all offsets stay, literals stay literals."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: s.start):
        out += [text[at : span.start], _masked(text, span)]
        at = span.end
    return "".join(out) + text[at:]


FOUND = "node_id long, line_no long, begin long, start long, end long, kind string"


def scan(nodes: DataFrame, id_column: str = "node_id", text_column: str = "source", folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """A row for each part of a credential: line_no (zero-based, split at newline) and code point offsets.

    Null ids or texts and empty texts give no rows, repeated rows count once, empty tables give none.
    """
    rows = nodes.select(nodes[id_column].cast("long").alias("node_id"), nodes[text_column].alias("text")).filter("node_id is not null and text is not null and text <> ''")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, t, spans in zip(batch["node_id"], batch["text"], find_all(batch["text"].tolist(), folder)):
                at = line = 0
                for s in spans:
                    line, at = line + t.count("\n", at, s.begin), s.begin
                    out.append((n, line, *s))
            yield pd.DataFrame(out, columns=["node_id", "line_no", "begin", "start", "end", "kind"])

    # repeats are dropped from what was found: the texts themselves never pass a shuffle
    return rows.mapInPandas(search, FOUND).distinct()


def redact(nodes: DataFrame, id_column: str = "node_id", text_column: str = "source", folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """All rows and columns of ``nodes``, with the credentials in ``text_column`` hidden; nulls stay null."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch[text_column]]
            hidden = [hide(t, spans) for t, spans in zip(texts, find_all(texts, folder))]
            batch[text_column] = [h if isinstance(t, str) else None for t, h in zip(batch[text_column], hidden)]
            yield batch

    return nodes.mapInPandas(rewrite, nodes.schema)


def redaction_report(nodes: DataFrame, folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """node_id, same_offsets, clean of each source: redaction kept its length and line ends, and none is found again."""
    rows = nodes.select(nodes["node_id"].cast("long").alias("node_id"), nodes["source"].alias("text")).filter("node_id is not null and text is not null")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            hidden = [hide(t, spans) for t, spans in zip(texts, find_all(texts, folder))]
            same = [len(a) == len(b) and all((x == "\n") == (y == "\n") for x, y in zip(a, b)) if a != b else True for a, b in zip(texts, hidden)]
            again = iter(find_all([b for a, b in zip(texts, hidden) if a != b], folder))
            clean = [a == b or not next(again) for a, b in zip(texts, hidden)]
            yield pd.DataFrame({"node_id": batch["node_id"], "same_offsets": same, "clean": clean})

    return rows.mapInPandas(check, "node_id long, same_offsets boolean, clean boolean").groupBy("node_id").agg(F.min("same_offsets").alias("same_offsets"), F.min("clean").alias("clean"))


def credential_lines(nodes: DataFrame, folder: str = TOKENIZER_FOLDER) -> DataFrame:
    """node_id and line_no of each line on which a literal credential begins."""
    return scan(nodes, folder=folder).select("node_id", "line_no").distinct()
