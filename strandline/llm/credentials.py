"""Credentials embedded in source code and configuration: found through a trigram index, verified by expressions, masked.

`Rules` derives from each detection expression the trigrams that every match must contain (`required`). `find` builds a
trigram index over the chunks of each shard's texts (an Arrow batch), intersects the postings each rule requires and runs the
rule's expression only on the chunks that remain. `mask` uses the same spans to blank the values in place.

A chunk is a text, or of a longer text so many whole lines as make CHUNK characters; every expression but that of private key
blocks, which is matched over whole texts, stays within a line, so no match is lost between chunks. All expressions take time
in proportion to the text.

Two sets of rules: "address" for addresses and configuration entries (what follows `password=` in a URL is a value), and "code"
for source code, where a value is a string literal, stands bare only on a line of a configuration file, or has the format of a
known provider.

Defined results: null and empty texts hold nothing; values that are empty, masks, placeholders or variable references
are no findings; of overlapping findings the one of the earlier rule counts; texts are searched whole, at any length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from re import _constants as C
from re import _parser
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of fields that hold credentials, without prefixes such as CAM_ or X-.
SECRET_NAMES = ["password", "passwd", "passphrase", "pass", "pwd", "passwort", "kennwort", "contraseña", "contrasena", "clave", "mot_de_passe", "motdepasse", "mdp", "senha", "пароль", "密码", "userpw", "token", "access_token", "accesstoken", "auth_token", "authtoken", "refresh_token", "apikey", "api_key", "api-key", "access-key", "access_key", "accesskey", "auth-key", "auth_key", "authkey", "secret", "client_secret", "secret_key", "streamkey", "stream_key", "stream-key", "private_key", "sas"]
NAME = "(?:" + "|".join(sorted(map(re.escape, SECRET_NAMES), key=len, reverse=True)) + ")"
#: A prefix such as CAM_, sig_, X-Nvr-.
PREFIX = r"(?:[A-Za-z0-9]{1,20}[-_]){0,3}"
#: A field name; "pw" only behind a mark that sets it apart, which also gives it a trigram.
FIELD = rf"(?:(?<![A-Za-z0-9]){PREFIX}{NAME}|[-_?&;|,\"' ]pw)"

#: A blank of a key block's marks, plain or as an address has it, and the two marks. A block goes from a BEGIN to the next END.
_GAP = "(?:[ +]|%20|%2B)"
KEY_MARK = re.compile(rf"-----(?:(BEGIN)|END){_GAP}(?:[A-Z0-9]+{_GAP})*?PRIVATE{_GAP}KEY(?:{_GAP}BLOCK)?-----", re.I)
KEY_BLOCK = ("private_key_block", rf"-----BEGIN{_GAP}.*PRIVATE{_GAP}KEY.*-----.*-----END{_GAP}.*PRIVATE{_GAP}KEY.*-----")

#: name, expression (the group that takes part is the value), in order of precedence.
RULES: list[tuple[str, str]] = [
    KEY_BLOCK,
    ("userinfo_encoded_twice", r"%253A%252F%252F(?:(?!%253A|%2540|%252F)[^\s&/@\"'])*%253A((?:(?!%252F)[^\s&/\"'])*)%2540"),
    ("userinfo_encoded", r"%3A%2F%2F(?:(?!%3A|%40|%2F)[^\s&/@\"'])*%3A((?:(?!%2F)[^\s&/\"'])*)%40"),
    ("userinfo_password", r"[a-z0-9]://[^\s/:@?#\"'|]*:([^\s/\"|]*)@"),
    ("userinfo_token", r"[a-z0-9]://([^\s/:@?#\"']+):?@"),
    ("authorization_scheme", r"authorization(?:\"|'|%22)?[^\S\n]*+(?:=|:|%3D|%3A)[^\S\n]*+[\"']?(?:bearer|basic|digest|token)(?:[^\S\n]|%20|\+)++([^\s\"'&#|;,]+)"),
    ("path_token", r"/(?:auth|token|key|secret)/([A-Za-z0-9_~.=-]+)(?=/|$|\?|#)"),
    ("login_comment", r"#[^\S\n]*login[^\S\n]+\S+[^\S\n]*/[^\S\n]*(\S+)"),
    ("underscored_pair", r"user=(?:(?!user=)[^\s/&;])*?_password=([^\s/&]*?)_channel="),
    ("quoted_pair", rf"{FIELD}[\"']?[^\S\n]*+[=:][^\S\n]*+\"((?:[^\"\\\n]++|\\[^\n])*+)\""),
    ("single_quoted_pair", rf"{FIELD}[\"']?[^\S\n]*+[=:][^\S\n]*+'((?:[^'\\\n]++|\\[^\n])*+)'"),
    ("config_line", rf"(?m:^)[ \t]*(?:{PREFIX}{NAME}|[A-Za-z0-9]{{1,20}}[-_]pw)[ \t]*:[ \t]+([^\n\r\"' \t][^\n\r]*?)[^\S\n]*(?=\r|\n|\Z)"),
    ("header_pair", rf"{FIELD}:[ \t]*([^\s\"'&#|;,]+)"),
    ("plain_pair", rf"{FIELD}=([^\s\"'&#|;]+)"),
    ("encoded_pair", rf"(?:%3F|%26|%23){PREFIX}{NAME}%3D((?:(?!%26|%23)[^\s\"'&#|;])+)"),
]

#: Words that name a credential in code, as parts of identifiers of any style.
CODE_WORD = r"(?:pass[_-]?word|passwd|pass[_-]?phrase|pwd|passwort|contrase(?:ñ|n)a|secret[_-]?access[_-]?key|access[_-]?key|secret[_-]?key|api[_-]?key|app[_-]?key|auth[_-]?key|account[_-]?key|master[_-]?key|private[_-]?key|signing[_-]?key|encryption[_-]?key|session[_-]?key|client[_-]?secret|secret|token|credential)"
#: What may follow the word in the same identifier, and what closes a key: quotes, brackets, array marks.
CODE_NAME = CODE_WORD + r"(?:[_-]?(?:prod|dev|test|staging|live|value|str|text|raw))?[_-]?\d{0,4}(?![A-Za-z0-9_-])[\"'`]?\]?(?:\[\d{0,5}\])?"
#: A type between name and value, at most so long as types are.
_TYPE = r"(?:[ \t]*:[ \t]*[&A-Za-z_][\w.<>\[\]?&' ]{0,40}?|[ \t]+(?:string|String|str))?"
_LITERAL = r"(?:[rbuflLR@$]{0,2}\"((?:[^\"\\\n]++|\\[^\n])*+)\"|[rbuflLR]{0,2}'((?:[^'\\\n]++|\\[^\n])*+)'|`((?:[^`\\\n]++|\\[^\n])*+)`)"
#: Formats of tokens that providers document.
PROVIDERS = [
    r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,255}", r"github_pat_[A-Za-z0-9_]{22,255}", r"glpat-[A-Za-z0-9_-]{20,255}", r"xox[abeoprs]-[A-Za-z0-9-]{10,255}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,255}", r"whsec_[A-Za-z0-9]{24,255}", r"AIza[0-9A-Za-z_-]{35}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"SG\.[A-Za-z0-9_-]{16,64}\.[A-Za-z0-9_-]{16,64}",
    r"npm_[A-Za-z0-9]{36}", r"hf_[A-Za-z]{30,64}", r"pypi-[A-Za-z0-9_-]{32,255}", r"dop_v1_[a-f0-9]{64}", r"sk-(?:proj-)?[A-Za-z0-9_-]{20,255}", r"ya29\.[A-Za-z0-9_-]{20,255}",
]
CODE_RULES: list[tuple[str, str]] = [
    KEY_BLOCK,
    ("userinfo_password", r"[a-z0-9]://[^\s/:@?#\"'|]*:([^\s/\"'|]*)@(?=[\w\[$.-])"),
    ("userinfo_database", r"(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|rediss|amqps?|mssql)://[^\s/:@?#\"'|]*:([^\s\"'|@]+)@(?=[\w\[$.-])"),
    ("authorization_scheme", r"authorization(?:\"|')?\]?[^\S\n]*+(?:=>|=|:|,)[^\S\n]*+[rbf]?[\"'`]?(?:bearer|basic|digest|token)[ \t]++([^\s\"'`&#|;,]+)"),
    ("bearer_literal", r"[\"'`]bearer[ \t]++([A-Za-z0-9._~+/=-]{8,})[\"'`]"),
    ("provider_token", r"(?-i:(?<![A-Za-z0-9_])(" + "|".join(PROVIDERS) + r")(?![A-Za-z0-9_]))"),
    ("assigned_literal", rf"{CODE_NAME}{_TYPE}[ \t]*+(?:=>|:=|\?=|\|\|=|=|:)[ \t]*+{_LITERAL}"),
    ("defined_literal", rf"define[ \t]++\w*?{CODE_NAME}[ \t]++{_LITERAL}"),
    ("paired_literal", rf"{CODE_WORD}[_-]?\d{{0,4}}[\"'`][ \t]*+,[ \t]*+{_LITERAL}"),
    ("called_literal", rf"(?:(?<=set)|(?<=set_)|(?<=with)|(?<=with_)|(?<=\.)){CODE_WORD}\([ \t]*+{_LITERAL}"),
    ("keyed_value", rf"{CODE_WORD}[_-]?\d{{0,4}}[\"'][ \t]++value[ \t]*+=[ \t]*+[\"']([^\"'\n]*+)[\"']"),
    ("element_text", rf"{CODE_WORD}\d{{0,4}}>[ \t]*+([^<>\n]++)</"),
    ("option_value", rf"--?(?:[A-Za-z0-9]{{1,20}}-){{0,3}}{CODE_WORD}(?:=|[ \t]++)(?![-\"'])([^\s\"'`|;,)]+)"),
    ("connection_part", rf"(?<=[;\"' ]){CODE_WORD}=([^;\"'\s&<>]+)(?=[;\"'])"),
    ("bare_line", rf"(?m:^)[ \t]*+(?:export[ \t]++|set[ \t]++|ENV[ \t]++|ARG[ \t]++|-[ \t]++)?[\w.-]*?{CODE_WORD}(?:[_-]?(?:prod|dev|test|staging|live|value))?[_-]?\d{{0,4}}(?![A-Za-z0-9_-])[ \t]*+(?:=|:)[ \t]*+([^\s\"'`#;,(){{}}\[\]<>|&*]++)[ \t]*+(?:[#;][^\n]*+)?(?=\r?\n|\r?\Z)"),
]
#: Shortest text that no field names and that still counts as a token, and the share of neighbours that differ in kind (upper,
#: lower, digit) which makes it look random, for short and for LONG_TOKEN or more letters and digits. Of 20,000 tokens of
#: letters and digits 97.3 % pass at 16 characters, 99.1 % at 20, all at 32; of 20,000 names made of words and numbers 1.7 % do.
TOKEN_CHARS, LONG_TOKEN, CHANGES, LONG_CHANGES = 16, 24, 0.35, 0.22
#: Forms that stand for a value without being one, after decoding of escapes.
PLACEHOLDER = re.compile(r"""(?ix)
    [*•●·.x#?_\s-]* | <[^<>]*> | \[[^\[\]]*\] | \$\{[^}]*\} | \$\([^)]*\) | \$[A-Z_][A-Z0-9_]* | \{\{.*\}\} | \{[A-Za-z_][\w.]*\} | %[A-Z_][A-Z0-9_]*% | %\([^)]*\)s
    | !\s*(?:vault|secret|env|ref)\b.* | null | none | nil | undefined | true | false | redacted | hidden | masked | removed | changeme | change[-_ ]me | todo | tbd | n/?a | empty | your[-_ ].* | (?:vault|env|ssm|secret|secrets|kms):.+ | os\.environ.* | ENC\(.*\)
    | (?:x+|\*+)(?:[-_.:](?:x+|\*+))* | \.\.\.
""")  # fmt: skip


def _alternatives(tree, fold: bool, limit: int = 4096) -> list[list[str]]:
    """Ways to match `tree`, each the list of literal runs it must contain in order; '' parts a run from the next."""
    ways: list[list[str]] = [[""]]

    def literal(c: str) -> None:
        for w in ways:
            w[-1] += c.lower() if fold else c

    def gap() -> None:
        for w in ways:
            w.append("")

    for op, arg in tree:
        inner = None
        if op is C.LITERAL:
            literal(chr(arg))
            continue
        if op is C.SUBPATTERN:
            inner = _alternatives(arg[3], fold)
        elif op is C.IN and len(arg) <= 10 and all(x is C.LITERAL for x, _ in arg):
            inner = [[chr(c).lower() if fold else chr(c)] for _, c in arg]
        elif op is C.BRANCH:
            inner = [w for x in arg[1] for w in _alternatives(x, fold)]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            inner = [[*w, ""] for w in _alternatives(arg[2], fold)] if arg[1] > 1 else _alternatives(arg[2], fold)
        elif op in (C.ASSERT, C.ASSERT_NOT, C.AT):
            continue  # no text of their own
        if inner is None or len(ways) * len(inner) > limit:
            gap()
        else:
            ways = [[*w[:-1], w[-1] + v[0], *v[1:]] for w in ways for v in inner]
    return ways


def trigrams(text: str) -> set[int]:
    b = text.lower().encode()
    return {b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)}


def required(expression: str) -> list[frozenset[int]] | None:
    """Any text that matches holds all trigrams of at least one of these sets; None: nothing can be required."""
    sets = {frozenset(t for run in way for t in trigrams(run)) for way in _alternatives(_parser.parse(expression, re.I), True)}
    if frozenset() in sets:
        return None
    return [s for s in sets if not any(o < s for o in sets)]  # a set that contains another adds nothing


#: Characters after which a chunk of a longer text ends, at the end of the line.
CHUNK = 1 << 16
#: Bytes of text that the index takes up at once.
BUFFER = 1 << 20


def chunks(text: str) -> list[tuple[int, int]]:
    """Where the chunks of a text lie: whole lines, CHUNK characters or more, but for the last."""
    if len(text) <= CHUNK:
        return [(0, len(text))]
    out, a = [], 0
    while a < len(text):
        b = text.find("\n", min(a + CHUNK, len(text)) - 1) + 1
        out.append((a, b or len(text)))
        a = out[-1][1]
    return out


class TrigramIndex:
    """Postings of one shard: for each trigram (of lower-cased UTF-8) the ascending numbers of the chunks that hold it.

    `wanted`: the trigrams that rules require (a mark for each of the 2 ** 24); others are not posted. None posts all.
    """

    def __init__(self, texts: pa.Array, wanted: np.ndarray | None = None):
        self.wanted = wanted
        self.text: list[int] = []  # of each chunk
        self.span: list[tuple[int, int]] = []
        found, waiting, held = [], [], 0
        for i, text in enumerate(texts.to_pylist()):
            if not text:
                continue
            for a, b in chunks(text):
                self.text.append(i)
                self.span.append((a, b))
                raw = (text if b - a == len(text) else text[a:b]).lower().encode("utf-8", "surrogatepass")
                waiting.append(raw)
                held += len(raw)
                if held >= BUFFER:
                    found.append(self._pairs(len(self.text) - len(waiting), waiting))
                    waiting, held = [], 0
        if waiting:
            found.append(self._pairs(len(self.text) - len(waiting), waiting))
        self.owner = np.array(self.text, np.int64)
        pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        grams, self.chunks = pairs >> 32, pairs & 0xFFFFFFFF
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        self.at = dict(zip(grams[first].tolist(), zip(first.tolist(), np.append(first[1:], len(grams)).tolist())))

    def _pairs(self, base: int, waiting: list[bytes]) -> np.ndarray:
        """(trigram, chunk) pairs of some chunks, each pair in one number."""
        flat = np.frombuffer(b"".join(waiting), np.uint8).astype(np.int32)
        if len(flat) < 3:
            return np.zeros(0, np.int64)
        code = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
        ends = np.cumsum([len(c) for c in waiting])
        keep = np.ones(len(code), bool) if self.wanted is None else self.wanted[code]
        for back in (1, 2):  # trigrams over the end of a chunk
            over = ends[:-1] - back
            keep[over[(over >= 0) & (over < len(code))]] = False
        at = np.flatnonzero(keep)
        return code[at].astype(np.int64) << 32 | np.searchsorted(ends, at, "right") + base

    def postings(self, gram: int) -> np.ndarray:
        a, b = self.at.get(gram, (0, 0))
        return self.chunks[a:b]

    def candidates(self, need: list[frozenset[int]] | None, whole: bool = False) -> np.ndarray:
        """Numbers of the chunks (`whole`: of the texts) that can match, by intersecting postings from the shortest on."""
        hit = np.zeros(int(self.owner[-1]) + 1 if whole and len(self.owner) else len(self.text), bool)
        if need is None:
            hit[self.owner if whole else slice(None)] = True
            return np.flatnonzero(hit)
        for grams in need:
            if not all(g in self.at for g in grams):
                continue
            lists = sorted((self.postings(g) for g in grams), key=len)
            if whole:
                lists = [np.unique(self.owner[x]) for x in lists]
            found = lists[0]
            for other in lists[1:]:
                if not len(found):
                    break
                found = found[other[np.minimum(np.searchsorted(other, found), len(other) - 1)] == found]
            hit[found] = True
        return np.flatnonzero(hit)


def random_looking(value: str) -> bool:
    """Whether a text that no field names is a generated token: its characters change kind (upper, lower, digit) all along."""
    kinds = [1 if c.isdigit() else 2 if c.isupper() else 3 for c in value if c.isalnum()]
    changes = sum(x != y for x, y in zip(kinds, kinds[1:]))
    return len(value) >= TOKEN_CHARS and len(set(kinds)) > 1 and changes >= (LONG_CHANGES if len(kinds) >= LONG_TOKEN else CHANGES) * len(kinds)


_NESTED = re.compile("%(?:25)+")


def is_placeholder(value: str) -> bool:
    """Whether a value stands for another, in itself or once its escapes are undone, however often they were made."""
    while not PLACEHOLDER.fullmatch(value.strip()):
        plain = unquote(_NESTED.sub("%", value))
        if plain == value or len(plain) >= len(value):
            return False
        value = plain
    return True


#: Types of programming languages, which stand behind a colon as a value would.
TYPES = {"str", "string", "int", "integer", "float", "double", "bool", "boolean", "bytes", "char", "any", "object", "number", "unknown", "void", "none", "null", "undefined", "auto", "var", "text", "varchar", "optional", "secretstr", "uuid", "date", "required", "self", "this", "true", "false", "yes", "no", "enabled", "disabled"}
_WORDS = re.compile(CODE_WORD, re.I)
_LABEL = re.compile(r"(?:[A-Za-z]*[_ -]?)*", re.I)


def code_value(rule: str, value: str) -> bool:
    """Whether a value that code gives to a field is a credential, and not a label, a reference or a format."""
    if len(value) < 3 or value.lower() in TYPES or re.fullmatch(r"%[sdv@]|\{\d*\}|:\w+|@\w+|\?", value):
        return False
    if rule in ("bare_line", "option_value", "connection_part", "element_text"):
        if "$" in value or value.startswith(("@", "%", "./")) or re.fullmatch(r"[A-Za-z_]\w*(?:\.\w+)+", value) or value.endswith("="):
            return "=" in value[-2:] and len(value) > 15
        return bool(re.search(r"[0-9!#%^*+?/~=-]", value)) or value.islower() and len(value) >= 6 and not _WORDS.search(value)
    if rule in ("assigned_literal", "defined_literal", "paired_literal", "called_literal", "keyed_value"):
        rest = _WORDS.sub("", value)
        if len(rest) < len(value) and not re.search(r"\d", rest) and re.fullmatch(r"[\w .:*\[\]-]*", value):
            return False  # a name or label of the field itself
        if " " in value and not re.search(r"\d", value) and (value[0].isupper() or value[-1] in ".:?!"):
            return False  # a sentence
        if re.match(r"[a-z]+://|/[\w/.-]+$|\.{1,2}/|[\w-]+\.(?:json|ya?ml|pem|key|txt|env)$", value):
            return False  # where it is, not what it is
        if "${" in value or "#{" in value or re.search(r"\{[A-Za-z_][\w.]*\}", value):
            return False
    return True


def address_value(rule: str, value: str) -> bool:
    return rule not in ("userinfo_token", "path_token") or random_looking(value)


class Rules:
    """Detection rules with the trigrams they require; `accepts` (rule, value) has the last word on a value."""

    def __init__(self, rules: Iterable[tuple[str, str]] = RULES, accepts: Callable[[str, str], bool] = address_value):
        self.rules = [(name, re.compile(x, re.I | re.S), required(x)) for name, x in rules]
        self.accepts = accepts
        self.wanted = np.zeros(1 << 24, bool)
        for _, _, need in self.rules:
            for grams in need or ():
                self.wanted[list(grams)] = True

    @staticmethod
    def _matches(name: str, x: re.Pattern, text: str):
        """(start, end) of the values one rule finds."""
        if name == KEY_BLOCK[0]:
            begin = None
            for m in KEY_MARK.finditer(text):
                if m[1] is None and begin is not None:
                    yield begin, m.end()
                    begin = None
                elif m[1] is not None and begin is None:
                    begin = m.start()
            return
        at = 0
        while m := x.search(text, at):
            a, b = m.span(m.lastindex)
            at = max(b, m.start() + 1)
            yield a, b

    def spans(self, text: str, rules=None, taken: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
        """(start, end, rule) of the values in `text`, in order of place; `taken`: what is settled already, in order."""
        taken = [] if taken is None else taken
        for name, x, _ in self.rules if rules is None else rules:
            for a, b in self._matches(name, x, text):
                i = bisect_left(taken, (a, b, ""))
                if a == b or i and taken[i - 1][1] > a or i < len(taken) and taken[i][0] < b:
                    continue
                value = text[a:b]
                if is_placeholder(value) or not self.accepts(name, value):
                    if name.startswith("userinfo"):
                        taken.insert(i, (a, b, ""))  # what stands there is settled
                    continue
                taken.insert(i, (a, b, name))
        return [x for x in taken if x[2]]

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, str]]:
        """(number, start, end, rule) over a shard: index, intersect, verify."""
        index = TrigramIndex(texts, self.wanted)
        by_chunk: dict[int, list] = {}
        blocks: dict[int, list] = {}
        for rule in self.rules:
            if rule[0] == KEY_BLOCK[0]:
                for i in index.candidates(rule[2], whole=True).tolist():
                    if found := self.spans(texts[i].as_py(), [rule]):
                        blocks[i] = found
            else:
                for c in index.candidates(rule[2]).tolist():
                    by_chunk.setdefault(c, []).append(rule)
        out = [(i, a, b, name) for i, found in blocks.items() for a, b, name in found]
        number, text = -1, ""
        for c in sorted(by_chunk):
            if index.text[c] != number:
                number = index.text[c]
                text = texts[number].as_py()
            low, high = index.span[c]
            # what lies in a key block is settled
            taken = [(max(a - low, 0), b - low, "") for a, b, _ in blocks.get(number, ()) if a < high and b > low]
            out += [(number, a + low, b + low, name) for a, b, name in self.spans(text[low:high], by_chunk[c], taken)]
        return sorted(out)


KINDS = {"address": (RULES, address_value), "code": (CODE_RULES, code_value)}
_made: dict[str, Rules] = {}


def rules_of(kind: str) -> Rules:
    """A set of rules, made once in a worker."""
    if kind not in _made:
        _made[kind] = Rules(*KINDS[kind])
    return _made[kind]


def find(df: DataFrame, id_col: str, text_col: str, kind: str = "address") -> DataFrame:
    """row_id, rule, span_start, span_end, secret_text: one row for each value found. No shuffle."""

    def run(batches):
        rules = rules_of(kind)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            hits = rules.search(texts)
            values = [texts[i].as_py()[a:e] for i, a, e, _ in hits]
            cols = [pa.array([ids[h[0]].as_py() for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int64()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["row_id", "rule", "span_start", "span_end", "secret_text"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "row_id long, rule string, span_start long, span_end long, secret_text string")


def mask(df: DataFrame, id_col: str, text_col: str, mark: str = "***", kind: str = "address") -> DataFrame:
    """row_id, masked: each text with its credential values replaced by `mark`, all else as it was."""

    def run(batches):
        rules = rules_of(kind)
        for b in batches:
            texts = b.column(1).to_pylist()
            pieces: dict[int, list[str]] = {}
            done: dict[int, int] = {}
            for i, a, e, _ in rules.search(b.column(1)):
                pieces.setdefault(i, []).extend((texts[i][done.get(i, 0) : a], mark))
                done[i] = e
            for i, found in pieces.items():
                texts[i] = "".join(found) + texts[i][done[i] :]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row_id", "masked"])

    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("masked")).mapInArrow(run, "row_id long, masked string")
