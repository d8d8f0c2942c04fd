"""Brackets and quotes of source text as SQL expressions: whether they nest and end.

One regular expression per language steps over comments and whole literals and captures what is
left of brackets and quotes; an aggregate over these keeps the brackets that are open. All of it runs in
built-in functions. Repeats of more than one character are possessive, so no stack grows with a literal.
The open brackets are kept as text: the work is their number times the depth.
"""

from __future__ import annotations

import re

_DQ = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"'
_SQ = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
_ANY_DQ = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
_ANY_SQ = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
_TRIPLE_DQ = r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""'
_TRIPLE_SQ = r"'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
_SLASHES = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
_HASH = r"#[^\n]*+"
_CHAR = r"'(?:\\[^\n][^'\n]*+|[^'\\\n])'"
_WORD = r"[\p{L}_][\w\u0080-\uffff]*+"


def _interpolated(sign: str, quote: str = '"', depth: int = 2) -> str:
    """A literal with expressions between braces, which may hold the quotes it stands between; doubled braces are plain."""
    inner = [_interpolated(sign, q, depth - 1) for q in "\"'"] if depth else []
    hole = "|".join([*inner, rf"(?:(?!{sign}[\"'])[^{{}}\"'\n])++", _DQ, _SQ, r"\{[^{}]*+\}"])
    return sign + quote + rf"(?:[^{quote}\\{{\n]++|\\[\s\S]|\{{\{{|\{{(?:{hole})*+\}}|\{{)*+" + quote


def _template(inner: str | None) -> str:
    """A template literal whose holes may hold blocks, strings and templates of the inner form."""
    hole = r"\$\{(?:[^{}`'\"]++|%s|%s|\{[^{}`]*+\}%s)*+\}" % (_DQ, _SQ, "|" + inner if inner else "")
    return r"`(?:[^`\\$]++|\\[\s\S]|%s|\$(?!\{))*+`" % hole


# A slash starts a pattern where a value may stand: behind a sign, some words, or a statement's condition.
_CONDITION = r"\b(?:if|while|for|with)\s{0,4}\([^()\n]{0,200}(?:\([^()\n]{0,100}\)[^()\n]{0,100})?\)"
_PATTERN = r"(?=\s{0,8}/(?![*/]))(?<=[(,=:\[!&|?{};+\-*%%<>~^]|^|\b(?:return|typeof|case|in|of)|%s)\s{0,8}/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/\w*+" % _CONDITION
_SCRIPT = [_SLASHES, _DQ, _SQ, _template(_template(_template(None))), r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`", _PATTERN]
_LINE_END = r"(?=\n|\z)"
# A YAML scalar of several lines: those that are indented deeper than the line it begins on.
_BLOCK_SCALAR = r"""(?m:^)([ ]*+)(?:[^\n#"'|>]*?(?::|-)[ \t]++)(?:[!&]\S*+[ \t]++)*+[|>][-+0-9]*+[ \t]*+(?:#[^\n]*+)?(?:\n(?:\1[ \t]++[^\n]*+|[ \t]*+(?=\n|\z)))*+"""
# A plain YAML scalar outside of flow brackets goes on to the end of its line.
_PLAIN = r"""(?<= )(?<=(?:^|\n)[^\n\[{"']{0,400}[:\-?] {1,8})(?![,])[^\s\[\]{}"'#&*!|>%@`][^\n]*?(?=:[ \n]|:\z|[ \t]#|\n|\z)"""

#: Comments and literals to step over, in order; the first group of a block scalar is its own.
SKIPPED = {
    "python": [_HASH, r"(?i:br|rb|fr|rf|[rbfu])?+(?:%s|%s)" % (_TRIPLE_DQ, _TRIPLE_SQ),
               _interpolated("(?i:fr|rf|f)"), _interpolated("(?i:fr|rf|f)", "'"), r"(?i:br|rb|[rbu])?+(?:%s|%s)" % (_DQ, _SQ)],
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "go": [_SLASHES, _CHAR, _DQ, r"`[^`]*+`"],
    "java": [_SLASHES, _CHAR, _TRIPLE_DQ, _DQ],
    "csharp": [_SLASHES, r"(?m:^[ \t]*+#[^\n]*+)", r'\$*+"{3,}(?:[^"]|"(?!""))*+"{3,}', r'(?:\$@|@\$|@)"[^"]*+(?:""[^"]*+)*+"', _interpolated(r"\$"), _CHAR, _DQ],
    "rust": [_SLASHES, r'(?:b|c)?r(#*)"[\s\S]*?"\1', "b?" + _CHAR, r"'\w++", "[bc]?" + _ANY_DQ],
    "php": [r"\A(?:(?!<\?)[\s\S])*+(?:<\?(?:php\b|=)?|\z)", r"(?://|#(?!\[))(?:(?!\?>)[^\n])*+", r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)", r"\?>(?:(?!<\?)[\s\S])*+(?:<\?(?:php\b|=)?|\z)",
            r"<<<[ \t]*+(['\"]?)(\w++)\1[ \t]*+\r?\n[\s\S]*?(?m:^)[ \t]*+\2\b", r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`",
            r"""\"(?:[^"\\{]++|\\[\s\S]|\{\$(?:[^{}"']++|"[^"\n]*+"|'[^'\n]*+')*+\}|\{)*+\"""", _ANY_DQ, _ANY_SQ],
    "json": [_DQ],
    "hcl": [_SLASHES, _HASH, _DQ, r"<<[-~]?([\w-]++)[ \t]*+\r?\n(?:[\s\S]*?\n)?[ \t]*+\1\b"],
    "sql": [r"--[^\n]*+", r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)", "'[^']*+'", '"[^"]*+"'],
    "yaml": [_BLOCK_SCALAR, r"(?m:(?<=\s|^)#[^\n]*+)", _PLAIN, _ANY_DQ, "'[^']*+(?:''[^']*+)*+'", r"""[^\s\[\]{},:"'#][^\s\[\]{},]*+"""],
    # What a shell gets is free text; lists and values of other instructions are not.
    "dockerfile": [r"(?m:^)[ \t]*+#[^\n]*+", r"(?im:^)[ \t]*+(?i:RUN|CMD|ENTRYPOINT|HEALTHCHECK|ONBUILD|MAINTAINER)\b(?![ \t]*+\[)(?:[^\n\\]|\\[\s\S])*+", r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"', _SQ],
}
#: Brackets and quotes that are looked at.
SIGNS = {"sql": r"[()\[\]{}\"'`]", "yaml": r"[\[\]{}\"']", "dockerfile": r"[\[\]{}\"']"}
_ANY_SIGN = r"[()\[\]{}\"'`]"


def pattern(language: str) -> str:
    """Steps over what is whole; its last group holds a bracket or quote, if that is what was found."""
    words = [] if language in ("yaml",) else [r"(?<![\w\u0080-\uffff])" + _WORD + r"(?![\"'#])"]
    return "|".join([f"(?:{p})" for p in [*SKIPPED[language], *words]] + [f"(?<sign>{SIGNS.get(language, _ANY_SIGN)})"])


def _groups(regex: str) -> int:
    """Number of the last capturing group."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", regex)  # without escapes and sets
    return len(re.findall(r"\((?!\?)|\(\?<sign>", plain))


def literal(text: str) -> str:
    """A SQL literal of any text."""
    return "r'" + text.replace("'", "\\x27") + "'"


def broken(language: str, content: str = "content") -> str:
    """SQL: whether brackets do not match or a literal does not end."""
    regex = pattern(language)
    signs = f"filter(regexp_extract_all(cast({content} AS string), {literal(regex)}, {_groups(regex)}), x -> x <> '')"
    return f"""aggregate({signs}, '', (open, x) -> CASE
        WHEN open IS NULL THEN NULL
        WHEN x IN ('(', '[', '{{') THEN concat(open, x)
        WHEN x IN (')', ']', '}}') AND right(open, 1) = translate(x, ')]}}', '([{{') THEN left(open, length(open) - 1)
        END, open -> open IS NULL OR open <> '')"""
