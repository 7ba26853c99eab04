"""Comments and literals of a source file, by the syntax of its content."""

from __future__ import annotations

import re

_C = re.compile(
    r"(?<=[=(,:!&|?;{}\[])[ \t]*(/(?![*/ ])(?:[^\\/\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-z]*)"
    r"|//([^\n\r]*)|/\*([\s\S]*?)(?:\*/|\Z)"
    r'|"""([\s\S]*?(?:(?<!\\)"""|\Z))|"((?:[^"\\\n\r]|\\.)*)(?:"|\Z)|\'((?:[^\'\\\n\r]|\\.)*)(?:\'|\Z)|`((?:[^`\\]|\\[\s\S])*)(?:`|\Z)'
)
_PY = re.compile(
    r"#([^\n\r]*)"
    r'|[rRbBuUfF]{0,2}(?:"""([\s\S]*?)(?:(?<!\\)"""|\Z)|\'\'\'([\s\S]*?)(?:(?<!\\)\'\'\'|\Z)|"((?:[^"\\\n\r]|\\.)*)(?:"|\Z)|\'((?:[^\'\\\n\r]|\\.)*)(?:\'|\Z))'
)
_JSON = re.compile(r'"((?:[^"\\]|\\.)*)(?:"(\s*:)?|\Z)')
_XML = re.compile(r"<!--([\s\S]*?)(?:-->|\Z)")
_ESCAPE = re.compile(r"\\(?:u+\{?([0-9a-fA-F]{4,6})\}?|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\n", "b": " ", "f": " ", "0": " "}

_LOOKS = {
    "java": re.compile(r"(?m)^\s*(?:package|import)\s+(?:static\s+)?[\w.]+(?:\.\*)?;|\b(?:public|private|protected|final|implements|throws)\b|@Override"),
    "js": re.compile(r"\b(?:const|let|var|function|require|async|typeof|prototype)\b|=>|===|module\.exports|use strict"),
    "py": re.compile(r"(?m)^\s*(?:def \w+\(|import \w+\s*$|from [\w.]+ import|(?:if|for|while|with|elif|else|try|except|class)\b.*:\s*$|@\w+\s*$)|\bself\b|\bNone\b"),
}


def content_language(code: str, ext: str) -> str:
    """The language whose syntax the content has: that with the most marks in the whole text; the
    extension decides between equals."""
    s = code.lstrip("\ufeff \t\r\n")
    if re.match(r"<(?:[?!][a-zA-Z-]|[a-zA-Z])", s):
        return "xml"
    if re.match(r"[{\[]\s*(?:\"|[\[{\]}]|-?\d|true\b|false\b|null\b|\Z)", s) and not re.search(r"(?m)[;]\s*$", s):
        return "json"
    score = {k: len(p.findall(code)) for k, p in _LOOKS.items()}
    best = max(score.values())
    if ext in ("json", "xml") and best < 3:
        return ext
    return ext if ext in score and score[ext] == best else max(score, key=score.get)


def denoted(literal: str) -> str:
    """The text a literal's escapes denote."""
    if "\\" not in literal:
        return literal

    def one(m: re.Match) -> str:
        h = m.group(1) or m.group(2)
        if h:
            n = int(h, 16)
            return chr(n) if n <= 0x10FFFF else " "
        return _SIMPLE.get(m.group(3), "" if m.group(3) in ("\n", "\r\n") else m.group(3))

    t = _ESCAPE.sub(one, literal)
    return t.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if re.search("[\ud800-\udfff]", t) else t


def _unstarred(comment: str) -> str:
    return re.sub(r"(?m)^[ \t]*(?:\*|#|//|--)+[ \t]?", "", comment).strip("*! \t")


def texts(code: str, ext: str) -> tuple[str, list[tuple[str, str]]]:
    """(content language, [(kind, text)]) with kind ``comment`` or ``literal``. Line comments on
    neighbouring lines are one comment. An unclosed comment or literal runs to the end."""
    lang = content_language(code, ext)
    out: list[tuple[str, str]] = []
    if lang == "xml":
        return lang, [("comment", m.group(1)) for m in _XML.finditer(code)]
    if lang == "json":
        return lang, [("literal", denoted(m.group(1))) for m in _JSON.finditer(code) if not m.group(2)]
    last = -1
    for m in (_PY if lang == "py" else _C).finditer(code):
        k = m.lastindex
        line = k == (1 if lang == "py" else 2)
        if line:
            t = m.group(k).lstrip("/!# ")
            if out and out[-1][0] == "line" and code[last : m.start()].strip() == "" and code.count("\n", last, m.start()) <= 1:
                out[-1] = ("line", out[-1][1] + "\n" + t)
            else:
                out.append(("line", t))
            last = m.end()
        elif lang == "py":
            t = denoted(m.group(k))
            out.append(("literal", t))
        elif k == 1:
            continue
        elif k == 3:
            out.append(("comment", _unstarred(m.group(3))))
        else:
            t = m.group(k)
            out.append(("literal", denoted(re.sub(r"\$\{[^}]*\}", " ", t) if k == 7 else t)))
    return lang, [("comment" if kind == "line" else kind, t) for kind, t in out]


def without_texts(code: str, ext: str) -> str:
    """The code alone, comments and literals taken out."""
    lang = content_language(code, ext)
    return {"xml": _XML, "json": _JSON, "py": _PY}.get(lang, _C).sub(" ", code)
