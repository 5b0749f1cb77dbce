"""Brackets and function headers of one file's text (the helper of ``operators.extract``).

``braced`` walks a file's brackets once.  Round and curly brackets form one
tree, so a pair of braces inside an open parenthesis (a destructured parameter,
a default value) does not cut the header around it; a ``}`` closes the last open
``{`` and drops parentheses left open inside it, a ``)`` that fits nothing is
passed over.  As in the scanner being reproduced, brackets in strings and
comments count, and a body without its ``}`` runs to the end of the file.

The header of a ``{`` is the text back to the last ``;``, brace or enclosing
bracket of its own level, kept as *gaps* (the texts between its parenthesised
groups), so a character belongs to the gaps of one header only and reading all
headers takes time in proportion to the file.  Every language has one reader; it
works on the gaps from the brace backwards and uses only anchored patterns.

``indented`` finds Python ``def`` and Ruby ``def ... end`` blocks.  A Python
header or statement goes on over physical lines while a bracket or a
triple-quoted string is open; a line that begins with ``def``, ``async def`` or
``class`` always starts a statement, so a bracket left open hides nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from quarry.functions.patterns import HEADER_SKIP_NAMES, JAVA_MODIFIERS, JAVA_NOT_RETURN_TYPES, NOT_BEFORE_A_NAME

_BRACKET = re.compile(r"[(){};]")


class Header(NamedTuple):
    """What a reader makes of a header; ``start`` is the offset of its first character."""

    start: int
    name: str
    return_type: str
    parameters: str


class Gaps:
    """A header: texts between its groups, and the groups' bracket offsets."""

    def __init__(self, src: str, start: int, end: int, groups: list, owner: "Frame"):
        self.src, self.start, self.end, self.groups, self.owner = src, start, end, groups, owner

    def text(self, i: int) -> str:
        """The gap before group ``i`` (the last gap for ``len(groups)``)."""
        return self.src[self.at(i):self.groups[i][0] if i < len(self.groups) else self.end]

    def at(self, i: int) -> int:
        return self.groups[i - 1][1] + 1 if i else self.start

    def inside(self, i: int) -> str:
        return self.src[self.groups[i][0] + 1:self.groups[i][1]]


class Frame:
    """An open bracket: its kind and offset, where the header being read starts, and that header's groups so far."""

    __slots__ = ("kind", "open", "cut", "groups", "header")

    def __init__(self, kind: str, at: int, header: Gaps | None = None):
        self.kind, self.open, self.cut, self.groups, self.header = kind, at, at + 1, [], header


# ------------------------------------------------------------- readers
_WORD = re.compile(r"\w+")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_DIRECTIVE = re.compile(r"^[ \t]*#[^\n]*$|(?:public|private|protected)\s*:(?!:)", re.M)
_CPP_AFTER = re.compile(r"\s*(?:(?:const|volatile|noexcept|override|final|throw|try|mutable|requires)\b\s*|&&?\s*|\[\[[^\]]*\]\]\s*)*"
                        r"(?:(?P<arrow>->)|:(?!:)|\Z)")
_CPP_TYPE = re.compile(r"[\w:*&<>,\s\[\]()\"]*")
_SYMBOLS = re.compile(r"\s*([^\w\s(){};]{1,3}|\]\[)\s*rotarepo\b")      # reversed: operator and its symbols
_CLASS = re.compile(r"(?:class|struct|union)\s+(?:\[\[[^\]]*\]\]\s*)?(\w+)")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _balanced_left(text: str, at: int) -> int:
    """Start of the ``<...>`` that ends before ``at``, or -1."""
    depth = 0
    for k in range(at - 1, -1, -1):
        if text[k] == ">":
            depth += 1
        elif text[k] == "<":
            depth -= 1
            if not depth:
                return k
    return -1


def _qualified(text: str) -> int:
    """Where the (qualified, possibly destructor or operator) name at the end of ``text`` begins, or -1."""
    back = text[::-1]
    symbols = _SYMBOLS.match(back)
    at = len(text) - (symbols.end() if symbols else 0)
    if not symbols:
        word = _WORD.match(back)
        if not word:
            return -1
        at = len(text) - word.end()
        if text[:at].endswith("~"):
            at -= 1
        left = text[:at].rstrip()
        if left.endswith("operator") and not re.match(r"\w", left[-9:-8]):         # operator bool
            at = len(left) - 8
    while True:                                    # A::  B<C>::  in front of it
        left = text[:at].rstrip()
        if not left.endswith("::"):
            return at
        at = len(left) - 2
        left = left[:-2].rstrip()
        if left.endswith(">"):
            begin = _balanced_left(left, len(left))
            if begin < 0:
                return at
            left = left[:begin].rstrip()
        word = _WORD.match(left[::-1])
        if not word:
            return at
        at = len(left) - word.end()


def _class_of(owner: Frame) -> str | None:
    """Name of the class whose braces these are."""
    h = owner.header
    if h is None:
        return None
    last = h.text(len(h.groups))
    at = max(last.rfind("class "), last.rfind("struct "), last.rfind("union "))
    m = _CLASS.match(last, at) if at >= 0 else None
    return m and m[1]


def _cpp(g: Gaps) -> Header | None:
    for i in range(len(g.groups)):
        before = g.text(i).rstrip()
        after = _CPP_AFTER.match(_COMMENT.sub(_blank, g.text(i + 1)))
        if not after:
            continue
        params = i
        if re.search(r"\boperator\Z", before[-9:]) and i + 1 < len(g.groups) and not g.inside(i).strip() and not g.text(i + 1).strip():
            at, params = len(before) - 8, i + 1                            # operator()(...)
            name = "operator()"
        else:
            at = _qualified(before)
            if at < 0:
                continue
            name = re.sub(r"\s*(\W)\s*", r"\1", re.sub(r"\s+", " ", before[at:]))       # blanks stay between words only
        if name in HEADER_SKIP_NAMES:
            return None
        begin, end = g.start, g.at(i) + at                                # the raw text before the name
        prefix = _COMMENT.sub(_blank, g.src[begin:end])
        cut = 0
        for m in _DIRECTIVE.finditer(prefix):
            cut = m.end()
        prefix = prefix[cut:]
        if prefix.lstrip().startswith("template"):
            close = _template_end(prefix)
            cut, prefix = cut + close, prefix[close:]
        begin += cut + len(prefix) - len(prefix.lstrip())
        ret = prefix.strip()
        if ret:
            words = re.findall(r"\w+", ret[-40:])
            if not _CPP_TYPE.fullmatch(ret) or re.search(r"(?<!:):(?!:)", ret) or (words and words[-1] in NOT_BEFORE_A_NAME):
                return None
        elif "::" not in name and not name.startswith(("~", "operator")) and name != _class_of(g.owner):
            return None
        else:
            begin = end
        if after["arrow"] and params == i:
            arrow = g.src[g.groups[params][1] + 1:g.end]
            ret = arrow[arrow.index("->") + 2:].strip()
        return Header(begin, name, ret, g.inside(params))
    return None


def _template_end(text: str) -> int:
    depth = 0
    for m in re.finditer(r"[<>]", text):
        depth += 1 if m[0] == "<" else -1
        if not depth:
            return m.end()
    return 0


_JAVA_AFTER = re.compile(r"\s*(?:throws\s[\w.,\s<>@]+)?\Z")
_JAVA_NAME = re.compile(r"\s*(\w+)\s+(?=[\w\]>?.])")
_JAVA_TYPE = set(".[]<>?,@&_")


def _java(g: Gaps) -> Header | None:
    i = len(g.groups) - 1
    if i < 0 or not _JAVA_AFTER.match(_COMMENT.sub(_blank, g.text(i + 1))):
        return None
    text = _COMMENT.sub(_blank, g.text(i))
    name = _JAVA_NAME.match(text[::-1])
    if not name:
        return None
    end = at = len(text) - name.end()
    depth = 0
    while at and (depth or text[at - 1].isalnum() or text[at - 1] in _JAVA_TYPE):   # the type, blanks only inside < >
        at -= 1
        depth += (text[at] == ">") - (text[at] == "<")
    ret = text[at:end]
    if depth or ret in JAVA_NOT_RETURN_TYPES or ret in JAVA_MODIFIERS:
        return None
    return Header(g.at(i) + at, name[1][::-1], ret, g.inside(i))


def _keyword(text: str, word: str) -> int:
    """Offset of the last whole ``word`` in ``text``, or -1."""
    at = text.rfind(word)
    while at >= 0 and (re.match(r"[\w$.]", text[at - 1]) if at else False):
        at = text.rfind(word, 0, at)
    return at


_JS_FUNCTION = re.compile(r"function\s*\*?\s*([\w$]+)\s*(?:<.*>)?\s*\Z", re.S)
_JS_BOUND = re.compile(r"\s*(?:cnysa\s+|cnysa\Z)?=(?![=!<>+*/&|?-])\s*")          # reversed:  = async
_JS_ONE = re.compile(r"\s*>=\s*([\w$]+)(?=[\s=])")                                # reversed:  x =>
_JS_DECLARED = re.compile(r"(?:const|let|var)\s+([\w$]+)\s*(?::.*)?\Z", re.S)
_JS_NAME = re.compile(r"[\w$]+")


def _annotation(text: str) -> str | None:
    """The type of ``: type``, an empty text for none, None for anything else."""
    text = text.strip()
    if not text:
        return ""
    return text[1:].strip() if text[0] == ":" and "=" not in text else None


def _javascript(g: Gaps) -> Header | None:
    i = len(g.groups) - 1
    after = _COMMENT.sub(_blank, g.text(i + 1))
    tail = after.rstrip()
    if not tail.endswith("=>"):
        ret = _annotation(after) if i >= 0 else None
        if ret is None:
            return None
        before = g.text(i)
        at = _keyword(before, "function")
        m = _JS_FUNCTION.match(before, at) if at >= 0 else None
        return m and Header(g.at(i) + at, m[1], ret, g.inside(i))
    ret = _annotation(tail[:-2]) if i >= 0 else None
    if ret is not None:                                # (...) =>
        left, base, params = g.text(i), g.at(i), g.inside(i)
    else:                                              # x =>
        one = _JS_ONE.match(tail[::-1])
        if not one:
            return None
        left, base, params, ret = tail[:len(tail) - one.end()], g.at(i + 1), one[1][::-1], ""
    bound = _JS_BOUND.match(left[::-1])
    if not bound:
        return None
    left = left[:len(left) - bound.end()]
    at = max(_keyword(left, "const"), _keyword(left, "let"), _keyword(left, "var"))
    m = _JS_DECLARED.match(left, at) if at >= 0 else None
    if m:
        return Header(base + m.start(1), m[1], ret, params)
    line = left.rfind("\n") + 1
    colon = left.find(":", line)
    end = len(left[:colon].rstrip()) if colon >= 0 else len(left)
    m = _JS_NAME.match(left[:end][::-1])
    return m and Header(base + end - m.end(), m[0][::-1], ret, params)


_GO_NAME = re.compile(r"func\s+(\w+)\s*(?:\[.*\])?\s*\Z", re.S)
_RUST_NAME = re.compile(r"fn\s+(\w+)\s*(?:<.*>)?\s*\Z", re.S)
_RUST_AFTER = re.compile(r"\s*(?:->(.*?))?\s*(?:\bwhere\b.*)?\Z", re.S)
_PHP_NAME = re.compile(r"function\s+&?\s*(\w+)\s*\Z")
_PHP_AFTER = re.compile(r"\s*(?::\s*([?\w\\|&]+))?\s*\Z")


def _declared(g: Gaps, word: str, pattern: re.Pattern, after) -> Header | None:
    """The last group whose gap ends in ``word name``; ``after`` reads the result type behind it."""
    for i in range(len(g.groups) - 1, -1, -1):
        before = g.text(i)
        at = _keyword(before, word)
        m = pattern.match(before, at) if at >= 0 else None
        if m:
            ret = after(_COMMENT.sub(_blank, g.src[g.groups[i][1] + 1:g.end]))
            return None if ret is None else Header(g.at(i) + at, m[1], ret, g.inside(i))
    return None


def _go_result(text: str) -> str | None:
    """A result type or list of them; a declaration without a body before something else is none."""
    text = text.strip()
    return text if "\n" not in text or text[0] == "(" and text[-1] == ")" else None


def _matched(pattern):
    def read(text):
        m = pattern.match(text)
        return m and (m[1] or "").strip()
    return read


#: The scanner for files of no known language, on reversed text: parameters, name, return type.
_ANY = re.compile(r"\s*\)([^)]*)\(\s*(\w+)\s+([\w:*&<>\s]+)")


def _any(src: str, last_brace: int, at: int) -> Header | None:
    m = _ANY.match(src[last_brace + 1:at][::-1])
    if not m:
        return None
    ret = m[3][::-1]
    return Header(at - m.end() + len(ret) - len(ret.lstrip()), m[2][::-1], ret.strip(), m[1][::-1])


READERS = {
    "cpp": _cpp, "c": _cpp, "java": _java, "javascript": _javascript, "typescript": _javascript,
    "go": lambda g: _declared(g, "func", _GO_NAME, _go_result),
    "rust": lambda g: _declared(g, "fn", _RUST_NAME, _matched(_RUST_AFTER)),
    "php": lambda g: _declared(g, "function", _PHP_NAME, _matched(_PHP_AFTER)),
}


# ------------------------------------------------------------- braces
class Lines:
    """Line numbers (from 1) of offsets."""

    def __init__(self, src: str):
        self.ends = [m.start() for m in re.finditer("\n", src)]

    def of(self, at: int) -> int:
        return bisect_left(self.ends, at) + 1


def braced(src: str, lang: str):
    """(header, open offset, close offset or None) of every ``{`` that follows a function header."""
    reader = READERS.get(lang)
    root = Frame("", -1)
    stack, curly, found, closing, last_brace = [root], [], [], {}, -1
    for m in _BRACKET.finditer(src):
        at, c, top = m.start(), m[0], stack[-1]
        if c == ";":
            top.cut, top.groups = at + 1, []
        elif c == "(":
            stack.append(Frame("(", at))
        elif c == ")":
            if top.kind == "(":
                stack.pop()
                stack[-1].groups.append((top.open, at))
        elif c == "{":
            gaps = Gaps(src, top.cut, at, top.groups, top)
            head = reader(gaps) if reader else _any(src, last_brace, at)
            if head and head.name not in HEADER_SKIP_NAMES:
                found.append((head, at))
            top.groups = []
            stack.append(Frame("{", at, gaps))
            curly.append(at)
            last_brace = at
        else:
            if curly:
                closing[curly.pop()] = at
                while stack[-1].kind != "{":
                    stack.pop()
                stack.pop()
            stack[-1].cut, stack[-1].groups = at + 1, []
            last_brace = at
    return [(head, at, closing.get(at)) for head, at in found]


def brace_pairs(src: str):
    """(piece number, level, open offset, close offset or None) of every ``{``; pieces start at braces."""
    pos = 0 if src[:1] in ("{", "}") else 1
    depth, waiting, out = 0, [], []
    for m in re.finditer(r"[{}]", src):
        if m[0] == "{":
            waiting.append(len(out))
            out.append([pos, depth, m.start(), None])
            depth += 1
        else:
            depth -= 1
            if waiting:
                out[waiting.pop()][3] = m.start()
        pos += 1
    return out


# ------------------------------------------------------------- indentation
_INDENT = re.compile(r"[ \t]*")
_BLANK = re.compile(r"[ \t\r]*(?:#.*)?\Z", re.S)
_STATEMENT = re.compile(r"[ \t]*(?:async[ \t]+def|def|class)\b")
_PY_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_][A-Za-z0-9_]*)[ \t]*(?:\[[^\]]*\])?[ \t]*\(")
_PY_AFTER = re.compile(r"\s*(?:\\\n\s*)?(?:->[^:]*)?:")
_RB_DEF = re.compile(r"[ \t]*def[ \t]+(?:self\.)?([A-Za-z_][A-Za-z0-9_]*[?!=]?)[ \t]*(?:\((.*)\))?")
_RB_END = re.compile(r"[ \t]*end\b")
_PY_TOKEN = re.compile(r"'''|\"\"\"|['\"]|#|[(\[{]|[)\]}]|\\")
_CLOSER = {"'": re.compile(r"\\.|'"), '"': re.compile(r'\\.|"')}


def _lines(src: str):
    """(offset, text) of the physical lines."""
    at = 0
    for text in src.split("\n"):
        yield at, text
        at += len(text) + 1


def _logical(src: str):
    """(offset, text, closing bracket of the first group or None) of Python's logical lines."""
    begin, depth, quote, group, close = 0, 0, "", None, None
    for at, text in _lines(src):
        if quote or depth and not _STATEMENT.match(text):
            pass                                        # this line goes on
        else:
            if at:
                yield begin, src[begin:at - 1], close
            begin, depth, group, close = at, 0, None, None
        k = 0
        while k <= len(text):
            if quote:                                   # inside a triple-quoted string
                end = text.find(quote, k)
                if end < 0:
                    break
                k, quote = end + 3, ""
                continue
            m = _PY_TOKEN.search(text, k)
            if not m or m[0] == "#":
                break
            k = m.end()
            if m[0] == "\\":
                k += 1
            elif len(m[0]) == 3:
                quote = m[0]
            elif m[0] in "'\"":
                for e in _CLOSER[m[0]].finditer(text, k):
                    if len(e[0]) == 1:
                        k = e.end()
                        break
                else:
                    k = len(text) + 1                   # a string without its end stops with the line
            elif m[0] in "([{":
                if not depth and group is None and m[0] == "(":
                    group = at + m.start()
                depth += 1
            else:
                depth = max(0, depth - 1)
                if not depth and group is not None and close is None:
                    close = at + m.start()
    yield begin, src[begin:], close


def _python_defs(src: str):
    """(offset, end, indent, blank, header, is_end) of the logical lines."""
    for at, text, close in _logical(src):
        head = None
        m = _PY_DEF.match(text)
        if m and close is not None and _PY_AFTER.match(src, close + 1, at + len(text)):
            head = (m[1], src[at + m.end():close])
        yield at, at + len(text), _INDENT.match(text).end(), bool(_BLANK.match(text)), head, False


def _ruby_defs(src: str):
    for at, text in _lines(src):
        m = _RB_DEF.match(text)
        yield (at, at + len(text), _INDENT.match(text).end(), bool(_BLANK.match(text)), m and (m[1], m[2] or ""),
               bool(_RB_END.match(text)))


def indented(src: str, lang: str):
    """(header, offset of the first character, end offset) of every ``def``."""
    found, waiting, last = [], [], 0                    # waiting: (indent, index) of blocks not ended; last: end of the last code line
    for at, end, indent, blank, head, is_end in (_python_defs if lang == "python" else _ruby_defs)(src):
        if not blank:
            while waiting and waiting[-1][0] >= indent:
                depth, k = waiting.pop()
                found[k][2] = end if is_end and depth == indent else last
            last = end
        if head:
            found.append([Header(at + indent, head[0], "", head[1]), at + indent, None])
            waiting.append((indent, len(found) - 1))
    for _, k in waiting:
        found[k][2] = last
    return found
