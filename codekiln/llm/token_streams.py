"""Token streams of C++, JavaScript and Python: a character for each token, lines kept.

Each lexer is one regular expression over the whole text and a table from a token's
text to its character; a token that spans lines is followed by its line ends. What
no token may be, such as a lone quote, becomes ILLEGAL, which no grammar knows; a
comment or string that the text ends in becomes UNCLOSED.
"""

from __future__ import annotations

import re

ILLEGAL, UNCLOSED = "\x01", "\x02"
_KEPT = 300_000


class _Characters(dict):
    """The character of each token seen so far; others are asked of the lexer."""

    def __init__(self, fixed: dict[str, str], other) -> None:
        super().__init__(fixed)
        self.other, self.fixed = other, len(fixed)

    def __missing__(self, token: str) -> str:
        found = self.other(token)
        if "\n" in token and token != "\n":
            found += "\n" * token.count("\n")
        if len(token) <= 40:
            if len(self) > _KEPT:
                for k in list(self)[self.fixed :]:
                    del self[k]
            self[token] = found
        return found


def _table(groups: dict[str, str]) -> dict[str, str]:
    return {word: c for c, words in groups.items() for word in words.split()} | {"\n": "\n"}


# --- C++ ---------------------------------------------------------------------

_CPP_TOKENS = re.compile(
    r"""(?:\b(?:u8|[uUL])?R"([^\s()\\"]{0,16})\((?:[^)]|\)(?!\1"))*\)\1")"""
    r"""|(?://[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?)"""
    r"""|(?:(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:.|\n))*"|(?:u8|[uUL])?'(?:[^'\\\n]|\\(?:.|\n))+')(?:_?\w+)?"""
    r"""|(?:\.|->)[*]?\s*(?:template\s+)?~?[A-Za-z_]\w*|->\*"""
    r"""|(?:\d|\.\d)(?:[eEpP][+-]|'(?=\w)|[\w.])*"""
    r"""|\boperator\s*(?:\(\s*\)|\[\s*\]|(?:new|delete)\b(?:\s*\[\s*\])?|""\s*\w+|[^\w\s(]+)"""
    r"""|delete\s*\[\s*\]|\[\[\s*[A-Za-z][^\[\]]*\]\]"""
    r"""|~?[^\W\d]\w*(?:\s*::\s*~?[^\W\d]\w*)*|::\s*~?[^\W\d]\w*(?:\s*::\s*~?[^\W\d]\w*)*"""
    r"""|\.\.\.|<<=|>>=|<=>|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|->|[-+*/%&|^=!<>~?:;,.(){}\[\]]|\n|[^\s\ufeff]"""
)
_CPP_CHARACTERS = _table(
    {
        "t": "int long unsigned signed short char double float bool void auto wchar_t char8_t char16_t char32_t decltype",
        "c": "const static inline extern virtual constexpr consteval constinit volatile mutable register explicit friend thread_local typedef typename noexcept alignas",
        "n": "this nullptr true false",
        "u": "new delete throw sizeof co_await co_yield ! ~ not compl",
        "o": "/ % == != <= >= <=> << || | ^ += -= *= /= %= &= |= ^= <<= >>= and or bitor bitand xor and_eq or_eq xor_eq not_eq ->*",
        "a": "+ -",
        "*": "* & &&",
        "p": "++ --",
        "e": "...",
        "S": "class struct union",
        "Y": "enum",
        "I": "if",
        "E": "else",
        "F": "for",
        "W": "while",
        "D": "do",
        "H": "switch",
        "C": "case",
        "L": "default",
        "R": "return co_return",
        "J": "break continue",
        "G": "goto",
        "T": "try",
        "K": "catch",
        "N": "namespace",
        "U": "using",
        "A": "public private protected",
        "M": "template",
        "-": "->",
        **{c: c for c in "<>,:?=;()[]{}"},
    }
)


def _cpp_other(token: str) -> str:
    first = token[0]
    if first == "/":
        return "" if token.startswith("//") or (token.endswith("*/") and len(token) > 3) else UNCLOSED
    if first.isdigit():
        return "n"
    if '"' in token or "'" in token:
        return "n" if len(token) > 1 else ILLEGAL
    if first in ".-":
        return "n" if token[1:2].isdigit() else "d" if len(token) > 1 else ILLEGAL
    if token.startswith("::"):
        return "q"
    if token.startswith("[["):
        return ""
    if token.startswith("delete"):
        return "u"
    return "i" if first.isalpha() or first in "_~" else ILLEGAL


_CPP = _Characters(_CPP_CHARACTERS, _cpp_other)
#: Names of preprocessor directives.
_DIRECTIVES = {"", "include", "define", "undef", "if", "ifdef", "ifndef", "elif", "else", "endif", "pragma", "error", "warning", "line", "import", "elifdef", "elifndef"}
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:\\\r?\n|[^\n])*)", re.M)
_OUTSIDE = re.compile(r'R"([^\s()\\"]{0,16})\((?:[^)]|\)(?!\1"))*\)\1"|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|//[^\n]*|"(?:[^"\\\n]|\\.)*"|^[ \t]*#[ \t]*(\w*)((?:\\\r?\n|[^\n])*)', re.M)


def _lines_of(text: str) -> str:
    return "\n" * text.count("\n")


def _directive(m: re.Match) -> str:
    """What is left of a directive: its line ends, and something illegal if there is no such directive."""
    word, rest = m[m.lastindex - 1], m[m.lastindex]
    known = word in _DIRECTIVES and (word or not rest.strip())
    return _lines_of(m[0]) if known else "`" + _lines_of(m[0])


def _preprocessed(text: str) -> str:
    """The text without directives and without the branches of conditions that are off or not first."""
    out, at, off = [], 0, []  # off: for each open condition whether its current branch is left out
    for m in _OUTSIDE.finditer(text):
        word, rest = m[2], (m[3] or "").split("//")[0].strip()
        if word is None:
            continue
        out.append(_lines_of(text[at : m.start()]) if any(off) else text[at : m.start()])
        out.append(_lines_of(m[0]) if any(off) else _directive(m))
        at = m.end()
        if word in ("if", "ifdef", "ifndef"):
            off.append(word == "if" and rest in ("0", "false"))
        elif word in ("else", "elif") and off:
            off[-1] = not off[-1]
        elif word == "endif" and off:
            off.pop()
    out.append(_lines_of(text[at:]) if any(off) else text[at:])
    return "".join(out)


def _without_directives(text: str) -> str:
    """The careful scan is needed only where a # may be in a comment or string, or a branch may be off."""
    if "#" not in text:
        return text
    if any(mark in text for mark in ("#if", "# ", "#\t", '"#', "/*", 'R"')):
        return _preprocessed(text)
    return _DIRECTIVE.sub(_directive, text)


def _keep_lines(put: str):
    return lambda m: put + _lines_of(m[0])


_HEAD = re.compile(r"([SY])[^;{}()=]*\{")
_TEMPLATE = re.compile(r"M\n*<(?:[^<>;{}]|<(?:[^<>;{}]|<[^<>;{}]*>)*>)*>")
_TRAILING = re.compile(r"\)([c\n]*)d[it<>:*cq,\n]*(?=\{)")


def cpp_stream(text: str) -> str:
    text = _without_directives(text)
    stream = "".join([_CPP[m[0]] for m in _CPP_TOKENS.finditer(text)])
    if "M" in stream:
        stream = _TEMPLATE.sub(_keep_lines(""), stream)
    if "S" in stream or "Y" in stream:
        stream = _HEAD.sub(lambda m: m[1] + _lines_of(m[0]) + "{", stream)
    if ")d" in stream or "cd" in stream:
        stream = _TRAILING.sub(lambda m: ")" + _lines_of(m[0]), stream)
    if "q" in stream:
        stream = stream.replace(">q", ">").replace("q", "i")
    # Four names in a row are prose, not a declaration.
    while ">>" in stream:
        stream = stream.replace(">>", ">")  # the ends of templates in templates; as an operator it is one, too
    return stream.replace("<>", "").replace("<", "o").replace(">", "o").replace("iiii", ILLEGAL + "iiii")


# --- JavaScript --------------------------------------------------------------

_TEMPLATE_LITERAL = r"`(?:[^`\\$]|\\(?:.|\n)|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
_JS_TOKENS = re.compile(
    r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/)?|<!--[^\n]*"
    rf"|{_TEMPLATE_LITERAL}"
    r"""|"(?:[^"\\\n]|\\(?:.|\n))*"|'(?:[^'\\\n]|\\(?:.|\n))*'"""
    r"|(?:(?<=[=(,\[!&|?{};:+\n>~^*%])|(?<=return)|(?<=typeof)|(?<=case)|(?<=^))[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
    r"|\?\.(?=[\[(])|(?:\?\.|\.)\s*#?[A-Za-z_$][\w$]*"
    r"|(?:\d|\.\d)(?:[eE][+-](?=\d)|[\w.])*"
    r"|(?:async\s+)?function\b(?:\s*\*)?|import\s*[^(.;\n\"']*\bfrom\s*(?:\"[^\"\n]*\"|'[^'\n]*')|import\s*(?:\"[^\"\n]*\"|'[^'\n]*')|export\s+default\b|export\b"
    r"|#?(?:[^\W\d]|\$)[\w$]*"
    r"|\.\.\.|=>|>>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\+\+|--|&&|\|\||\?\?|\*\*|<<|>>|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>~?:;,.(){}\[\]]|\n|[^\s\ufeff]"
)
_JS = _Characters(
    _table(
        {
            "n": "this null true false super",
            "o": "/ % == != === !== < > <= >= << >> >>> || | ^ & && ?? += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= in of instanceof **",
            "a": "+ -",
            "*": "*",
            "u": "typeof void delete new await yield async",
            "v": "! ~",
            "p": "++ --",
            "e": "...",
            ">": "=>",
            "V": "var let const",
            "S": "class",
            "x": "extends",
            "I": "if",
            "E": "else",
            "F": "for",
            "W": "while",
            "D": "do",
            "H": "switch",
            "C": "case",
            "L": "default",
            "R": "return",
            "J": "break continue debugger",
            "Q": "throw",
            "T": "try",
            "K": "catch",
            "Z": "finally",
            "i": "static get set from as",
            "": "?. export",
            **{c: c for c in ",:?=;()[]{}"},
        }
    ),
    lambda token: _js_other(token),
)


def _js_other(token: str) -> str:
    first = token[0]
    if first == "/" and token[1:2] in ("/", "*"):
        return "" if token[1] == "/" or (token.endswith("*/") and len(token) > 3) else UNCLOSED
    if token.startswith("<!--"):
        return ""
    if first in "\"'`":
        return ("g" if first == "`" else "n") if len(token) > 1 else UNCLOSED if first == "`" else ILLEGAL
    if "/" in token and not token.startswith("import"):
        return "n" if len(token.strip()) > 1 else "o"
    if first == ".":
        return "n" if token[1:2].isdigit() else "d" if len(token) > 1 else ILLEGAL
    if first == "?":
        return "d"
    if first.isdigit():
        return "n"
    if "function" in token and token.split()[0] in ("async", "function", "function*"):
        return "f"
    if token.startswith("import") and len(token) > 6:
        return ";"
    if token.startswith("export") and token.split()[0] == "export":
        return ""
    return "i" if first.isalpha() or first in "_$" or (first in "#" and len(token) > 1) else ILLEGAL


def javascript_stream(text: str) -> str:
    if text.startswith("#!"):
        text = "//" + text
    return "".join([_JS[m[0]] for m in _JS_TOKENS.finditer(text)])


# --- Python ------------------------------------------------------------------

_PY_TOKENS = re.compile(
    r"#[^\n]*"
    r'|[bBrRuUfF]{0,2}(?:"""(?:[^"\\]|\\(?:.|\n)|"(?!""))*(?:"""|\Z)|\'\'\'(?:[^\'\\]|\\(?:.|\n)|\'(?!\'\'))*(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\(?:.|\n))*"|\'(?:[^\'\\\n]|\\(?:.|\n))*\')'
    r"|\.\.\.|\.[ \t]*(?!import\b)[^\W\d]\w*"
    r"|(?:\d|\.\d)(?:[eE][+-](?=\d)|[\w.])*"
    r"|[^\W\d]\w*"
    r"|\\\r?\n|\*\*=|//=|>>=|<<=|->|:=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%&|^@]=|[-+*/%&|^=<>~@:;,.(){}\[\]]|\n[ \t\f]*|[^\s\ufeff]"
)
_PY_FIXED = _table(
    {
        "n": "None True False",
        "o": "in is and or == != <= >= < > / // % << >> & | ^ :=",
        "a": "+ -",
        "*": "* **",
        "u": "await ~",
        "!": "not",
        "=": "=",
        "g": "+= -= *= /= //= %= &= |= ^= <<= >>= **= @=",
        ">": "->",
        "I": "if",
        "h": "elif",
        "E": "else",
        "F": "for",
        "W": "while with",
        "T": "try",
        "K": "except",
        "Z": "finally",
        "f": "def",
        "S": "class",
        "R": "return raise del global nonlocal assert",
        "y": "yield",
        "b": "lambda",
        "P": "pass break continue",
        "A": "async",
        "s": "as",
        "m": "from",
        "M": "import",
        **{c: c for c in ",:;()[]{}@"},
    }
)


def _py_other(token: str) -> str:
    first = token[0]
    if first == "#" or first == "\\":
        return "" if len(token) > 1 or first == "#" else ILLEGAL
    if first in "\"'" or token[-1] in "\"'":
        body = token.lstrip("bBrRuUfF")
        if body[:3] in ('"""', "'''"):
            return "n" if len(body) >= 6 and body.endswith(body[:3]) else UNCLOSED
        return "n" if len(body) > 1 else ILLEGAL
    if first == ".":
        return "n" if token[1:2].isdigit() or token in (".", "...") else "d"
    if first.isdigit():
        return "n"
    return "i" if first.isalpha() or first == "_" else ILLEGAL


_PY = _Characters(_PY_FIXED, _py_other)
_SOFT = re.compile(r"^[ \t]*(?:(match)(?=[ \t]+[^\s=.,:)\]+*/%<>!|&^][^\n]*:[ \t]*(?:#.*)?$)|(case)(?=[ \t]+[^\s=.,:)\]+*/%<>!|&^][^\n]*:))", re.M)


def python_stream(text: str) -> str:
    """Line ends count only outside brackets: l at the end of a statement, < and ^ where the indent changes."""
    if "match" in text:
        text = _SOFT.sub(lambda m: m[0].replace(m[1] or m[2], "while"), text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out: list[str] = []
    indents, depth, fresh, width = [0], 0, True, 0
    first = re.match(r"\ufeff?[ \t\f]*", text)[0]
    width = len(first.lstrip("\ufeff").expandtabs(8))
    for m in _PY_TOKENS.finditer(text):
        token = m[0]
        if token[0] == "\n":
            if depth == 0 and not fresh:
                out.append("l")
                fresh = True
            width = len(token[1:].expandtabs(8))
            out.append("\n")
            continue
        c = _PY[token]
        if not c or c[0] == "\n":
            out.append(c)
            continue
        if fresh and depth == 0:
            if width > indents[-1]:
                indents.append(width)
                out.append("<")
            while width < indents[-1]:
                indents.pop()
                out.append("^")
            if width > indents[-1]:
                out.append(ILLEGAL)
                indents.append(width)
        fresh = False
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        out.append(c)
    if not fresh and depth == 0:
        out.append("l")
    if depth == 0:
        out.append("^" * (len(indents) - 1))
    return "".join(out)


STREAMS = {"cpp": cpp_stream, "javascript": javascript_stream, "python": python_stream}
