"""Lexers and grammars of eight languages at the level of token classes.

A file becomes one character a token. Nested groups are reduced from the inside:
the content of a bracket group is matched against the productions for its kind
of bracket and replaced by one character that says which of them it fits. So a
production never contains itself and is a regular expression over classes and
reduced groups. The same productions give the permissible adjacent pairs of
tokens, by first, last and follow sets (pairs()).

Classes: i name, n literal, s string, D .name, = assignment, B binary, X unary
or binary, U unary, p ++ or --, l <, g >, G type arguments, a =>, r ->, c ::,
e ..., T ?, A annotation, N end of line, ! never allowed. Keywords have the
letters given in WORDS. Reduced groups: a brace group is a digit, a parenthesis
a Greek letter, each the sum of the kinds it fits (1, 2, 4); Q is a bracket.
"""

from __future__ import annotations

import re

# Keyword classes by language; words not listed are names.
WORDS = {
    "javascript": {
        "F": "function", "v": "var let const", "K": "class", "x": "extends", "m": "import", "o": "export", "d": "default", "R": "return throw",
        "I": "if", "W": "while with", "f": "for", "S": "switch", "C": "case", "t": "try", "h": "catch", "y": "finally", "E": "else", "O": "do",
        "b": "break continue debugger", "U": "new typeof void delete await yield", "B": "in instanceof", "j": "async", "z": "of",
        "M": "static get set", "n": "true false null this super undefined",
    },
    "typescript": {
        "F": "function", "v": "var let const", "K": "class", "x": "extends implements", "m": "import", "o": "export", "d": "default", "R": "return throw",
        "I": "if", "W": "while", "f": "for", "S": "switch", "C": "case", "t": "try", "h": "catch", "y": "finally", "E": "else", "O": "do",
        "b": "break continue debugger", "U": "new typeof void delete await yield keyof infer", "B": "in instanceof is", "j": "async", "z": "of",
        "M": "static get set public private protected readonly abstract declare override accessor", "L": "interface namespace module", "J": "enum",
        "n": "true false null this super undefined",
    },
    "java": {
        "k": "package", "m": "import", "K": "class interface enum record", "x": "extends implements throws permits", "R": "return throw assert yield",
        "M": "public private protected static final abstract native synchronized transient volatile strictfp sealed",
        "I": "if", "W": "while", "f": "for", "S": "switch", "C": "case", "d": "default", "t": "try", "h": "catch", "y": "finally", "E": "else", "O": "do",
        "b": "break continue", "N": "new", "B": "instanceof", "n": "true false null this super",
    },
    "csharp": {
        "k": "namespace", "m": "using", "K": "class struct interface enum record", "R": "return throw", "x": "where",
        "M": "public private protected internal static readonly sealed abstract override virtual async const ref out params volatile unsafe extern partial event implicit explicit",
        "I": "if", "W": "while lock fixed", "f": "for foreach", "S": "switch", "C": "case", "d": "default", "t": "try", "h": "catch", "y": "finally",
        "E": "else", "O": "do", "b": "break continue", "N": "new", "B": "is as in", "U": "await yield", "n": "true false null this base",
    },
    "c": {
        "k": "struct union enum", "M": "static extern const inline volatile register typedef restrict unsigned signed long short",
        "R": "return goto", "I": "if", "W": "while", "f": "for", "S": "switch", "C": "case", "d": "default", "E": "else", "O": "do",
        "b": "break continue", "U": "sizeof",
    },
    "go": {
        "k": "package", "m": "import", "F": "func", "v": "var const", "y": "type", "q": "struct interface", "R": "return", "I": "if", "f": "for",
        "S": "switch select", "C": "case", "d": "default", "E": "else", "b": "break continue goto fallthrough", "U": "go defer range", "H": "chan",
        "n": "true false nil iota",
    },
    "rust": {
        "m": "use", "F": "fn", "v": "let", "k": "struct enum trait union mod", "K": "impl", "M": "pub mut const static unsafe async extern ref move dyn crate default",
        "y": "type", "S": "match", "I": "if", "W": "while", "f": "for", "O": "loop", "E": "else", "R": "return", "b": "break continue", "B": "as in",
        "w": "where", "n": "true false self super",
    },
    "python": {
        "F": "def", "K": "class", "m": "import", "q": "from", "R": "return raise", "I": "if", "L": "elif", "W": "while", "f": "for", "E": "else",
        "t": "try", "h": "except", "y": "finally", "w": "as", "b": "pass break continue", "U": "not await yield", "B": "and or is", "z": "in",
        "M": "async", "V": "global nonlocal", "Y": "with", "d": "del assert", "j": "lambda", "n": "None True False",
    },
}

# Names of languages as they are written, and file extensions.
LANGUAGES = {
    "javascript": "javascript", "js": "javascript", "node": "javascript", "ecmascript": "javascript", "jsx": "javascript", "typescript": "typescript",
    "ts": "typescript", "tsx": "typescript", "python": "python", "py": "python", "python3": "python", "go": "go", "golang": "go", "java": "java",
    "csharp": "csharp", "c#": "csharp", "cs": "csharp", "c-sharp": "csharp", "rust": "rust", "rs": "rust", "c": "c", "ansi c": "c", "c99": "c",
}
EXTENSIONS = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "tsx": "typescript", "py": "python", "pyi": "python", "go": "go", "java": "java", "cs": "csharp", "rs": "rust", "c": "c", "h": "c",
}

_CONFLICT = r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)[^\n]*"
_SPACE = r"[^\S\n]+"
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_NUMBER = r"\.?\d(?:[\w]|\.(?=\d)|(?<=[eE])[+-])*\.?"
_DQ = r'"(?:\\[\s\S]|[^"\\\n])*"'
_SQ = r"'(?:\\[\s\S]|[^'\\\n])*'"
_BLOCK = r"/\*[\s\S]*?\*/|//[^\n]*"
_REGEX = r"(?<=[=(,:!&|?\[;{}\s])/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[dgimsuvy]*(?=\s*(?:[.,;)\]}\n]|\Z))"

# comments (dropped), strings, numbers, members, names, operators; whatever else is one character
_LEX = {
    "javascript": (r"\A#![^\n]*|" + _BLOCK, rf"{_DQ}|{_SQ}|`(?:\\[\s\S]|[^`\\])*`|{_REGEX}", r"\??\.\s*#?(?:" + _NAME + ")", r"#(?:" + _NAME + ")",
                   r">>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|\.\.\.|=>|\+\+|--|&&|\|\||\?\?|==|!=|<=|>=|[-+*/%&|^]=|<<|\*\*|\?\.(?=[(\[])"),
    "java": (_BLOCK, rf'"""[\s\S]*?"""|{_DQ}|{_SQ}', r"\.\s*(?:" + _NAME + ")", r"@\s*(?!interface\b)(?:" + _NAME + r")(?:\.\w+)*",
             r"<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<"),
    "csharp": (_BLOCK + r"|^[^\S\n]*#\s*(?:region|endregion|if|else|elif|endif|define|undef|pragma|nullable|line|error|warning)\b[^\n]*",
               rf'[$@]*@[$@]*"(?:""|[^"])*"|"""[\s\S]*?"""|\$?{_DQ}|{_SQ}', r"\??\.\s*(?:" + _NAME + ")", r"@(?:" + _NAME + ")",
               r"<<=|\?\?=|=>|->|::|\+\+|--|&&|\|\||\?\?|==|!=|<=|>=|[-+*/%&|^]=|<<"),
    "c": (_BLOCK + r"|^[^\S\n]*#\s*(?:include|define|undef|ifdef|ifndef|if|else|elif|endif|pragma|error|warning|line)\b(?:\\\r?\n|[^\n])*",
          rf"[LuU]?{_DQ}|{_SQ}", r"\.\s*(?:" + _NAME + r")|->\s*(?:" + _NAME + ")", r"(?!)", r"<<=|>>=|\.\.\.|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|>>"),
    "go": (_BLOCK, rf"{_DQ}|{_SQ}|`[^`]*`", r"\.\s*(?:" + _NAME + ")", r"(?!)", r"<<=|>>=|&\^=|\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|>>|&\^"),
    "rust": (_BLOCK, rf'b?r(#*)"[\s\S]*?"\1|b?"(?:\\[\s\S]|[^"\\])*"|b?\'(?:\\[^\n]{{1,8}}?|[^\'\\\n])\'', r"\.\s*(?:" + _NAME + r"|\d+)", r"'(?:" + _NAME + ")",
             r"<<=|\.\.=|\.\.\.?|->|=>|::|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|(?:" + _NAME + r")!(?=\s*[(\[{])"),
    "python": (r"#[^\n]*|\\\r?\n", r'[rRbBuUfF]{0,2}(?:"""(?:\\[\s\S]|[^\\])*?"""|' + r"'''(?:\\[\s\S]|[^\\])*?'''" + rf"|{_DQ}|{_SQ})", r"\.\s*(?:" + _NAME + ")", r"(?!)",
               r"\*\*=|//=|<<=|>>=|\.\.\.|:=|->|==|!=|<=|>=|[-+*/%&|^@]=|<<|>>|\*\*|//"),
}
_LEX["typescript"] = _LEX["javascript"]
_OPERATORS = {
    "!": "U", "~": "U", "+": "X", "-": "X", "*": "X", "&": "X", "<": "l", ">": "g", "=": "=", "/": "B", "%": "B", "^": "B", "|": "B", "?": "T", "++": "p", "--": "p",
    "=>": "a", "->": "r", "::": "c", "...": "e", "..": "e", "..=": "e", ":=": "=", "<-": "X", "@": "@", ".": "o", "**": "B", "&&": "B", "||": "B", "#": "#",
}


class _Classes(dict):
    """Class of every token text of one language, filled as texts are met."""

    def __init__(self, language: str):
        super().__init__()
        self.language = language
        self.words = {w: c for c, ws in WORDS[language].items() for w in ws.split()}
        comments, strings, members, special, _ = _LEX[language]
        self.kinds = [(re.compile(p, re.M), c) for p, c in ((_CONFLICT, "!"), (comments, ""), (strings, "s"), (members, "D"), (special, "i"))]

    def __missing__(self, t: str) -> str:
        if len(self) > 200_000:
            self.clear()
        c = self[t] = self._of(t)
        return c

    def _of(self, t: str) -> str:
        if t[0] == "\n":
            return "N"
        if t[:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||"):
            return "!"
        if t in self.words:
            return self.words[t]
        if t in ("type", "as", "from", "satisfies"):  # only with what follows; see tokens()
            return {"type": "Y", "as": "w", "satisfies": "w", "from": "q"}[t] if self.language in ("javascript", "typescript") else "i"
        if t[0].isalpha() and len(t) > 1 and t[-1] in "\"'" or t[0] in "\"'`$@" and len(t) > 1 and t[-1] in "\"'`":
            return "s" if self.language != "rust" or t[0] != "'" or len(t) > 2 and t[-1] == "'" else "L"
        if t[:2] in ("/*", "//") and self.language != "python" or t[0] == "#" and len(t) > 1 and self.language in ("c", "csharp", "python") or t[:2] == "#!":
            return ""
        if t[0] == "\\":
            return "" if "\n" in t else "!"
        if t[0] == "/" and len(t) > 2 and self.language in ("javascript", "typescript"):
            return "s"
        if self.language == "rust" and t[0] == "'":
            return "L"
        if self.language == "c" and t[:2] == "->" and len(t) > 2:
            return "D"
        if t[0] in ".?" and len(t) > 1 and (t.lstrip("?. \t\r\n#")[:1].isalpha() or t.lstrip("?. \t\r\n#")[:1] in "_$" and t.lstrip("?. \t\r\n#")):
            return "D"
        if self.language == "rust" and re.fullmatch(r"\.\s*\d+", t):
            return "D"
        if t == "?.":
            return ""
        if t[0].isdigit() or t[0] == "." and len(t) > 1 and t[1].isdigit():
            return "n" if re.fullmatch(_NUM_OK, t) else "!"
        if t[0] == "@" and len(t) > 1:
            return "A" if self.language == "java" else "i"
        if t[0].isalpha() or t[0] in "_$" or t[0] == "#" and len(t) > 1:
            return "i"
        if t in _OPERATORS:
            return _OPERATORS[t]
        if len(t) > 1:
            return "=" if t[-1] == "=" and t not in ("==", "!=", "<=", ">=", "===", "!==") else "B"
        return t if t in "()[]{},;:" else "!"


_NUM_OK = r"0[xX][0-9a-fA-F_]+[a-zA-Z0-9_]*|0[bB][01_]+\w*|0[oO]?[0-7_]*\w*|[\d_]*\.?[\d_]*(?:[eE][+-]?[\d_]+)?(?:[fFdDlLmMnuUjJ]{0,3}|[iuf](?:8|16|32|64|128|size))"

_CLASSES: dict[str, _Classes] = {}
_TOKENS: dict[str, re.Pattern] = {}


def _tokens(language: str) -> re.Pattern:
    if language not in _TOKENS:
        comments, strings, members, special, operators = _LEX[language]
        newline = r"\n[ \t\f]*" if language == "python" else r"\n"
        contextual = r"\btype(?=\s*\{|\s*\*|\s+[A-Za-z_$])|\bas(?=\s+[\w{\[(\"'$])|\bsatisfies(?=\s+\w)|\bfrom(?=\s*[\"'])|" if language == "typescript" else r"\bas(?=\s+[\w$])|\bfrom(?=\s*[\"'])|" if language == "javascript" else ""
        pattern = f"{_CONFLICT}|{comments}|{strings}|{members}|{special}|{operators}|{_NUMBER}|{contextual}{_NAME}|{newline}|[^\\s]"
        # groups inside would change what findall returns
        _TOKENS[language] = re.compile(pattern.replace(r"(#*)", "#*").replace(r"\1", "#*"), re.M)
        _CLASSES[language] = _Classes(language)
    return _TOKENS[language]


_ENDS = r"(?<=[insDpQGzMbRdU\)\]\}])"
_JS_LINE = re.compile(r"N(?=N*[insFvKmoRIWfStObUjMLJYAzwqdCe\{@](?!\Z))")


def classes(code: str, language: str) -> str:
    """The class string of a file."""
    if "\r" in code:
        code = code.replace("\r\n", "\n").replace("\r", "\n")
    code = code.lstrip("\ufeff")
    found = _tokens(language).findall(code)
    if language == "python":
        return _python(found)
    s = "".join(map(_CLASSES[language].__getitem__, found))
    if language == "go":
        s = re.sub(r"(?<=[insDpbR\)\]\}Gd])N+", ";", s)
    elif language in ("javascript", "typescript"):
        # a line break ends a statement if the next line can't continue it
        s = re.sub(r"(?<=[insDpzbRGqw\)\]\}])N+(?=[insFvKmoRIWfSCdtObUjMLJYAzqw@])", ";", s)
        s = re.sub(r"(?<=[bR])N+", ";", s)
    s = s.replace("N", "")
    if language == "typescript":
        return s
    return s


def _python(found: list[str]) -> str:
    """Class string with ; between logical lines, and > and < marks (as lines of their own) where the indentation changes."""
    of = _CLASSES["python"]
    out: list[str] = []
    depth, levels = 0, [0]
    start, pending = True, 0
    if found and found[0][0] != "\n":
        pending = 0
    for t in found:
        if t[0] == "\n":
            if depth == 0:
                if not start:
                    out.append(";")
                start, pending = True, len(t[1:].replace("\t", " " * 8))
            continue
        c = of[t]
        if not c:
            continue
        if start:
            start = False
            if pending > levels[-1]:
                levels.append(pending)
                out.append("\u2192")
            else:
                while pending < levels[-1]:
                    levels.pop()
                    out.append("\u2190")
                if pending != levels[-1]:
                    out.append("!")
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        out.append(c)
    if not start:
        out.append(";")
    out.append("\u2190" * (len(levels) - 1))
    return "".join(out)
