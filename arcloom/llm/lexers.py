"""Tokens of source files, as terminals of the grammars. A lexer gives None where no token fits."""

from __future__ import annotations

import re

from arcloom.llm.gll import Grammar

_NAME = r"(?:[^\W\d]|\$)(?:\w|\$)*"

# -- Java ------------------------------------------------------------------------------------
_JAVA = re.compile(
    r"(?:[ \t\f\r\n\x1a\ufeff]+|//[^\r\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)+"
    rf"|({_NAME})"
    r'|("""[ \t\f]*(?:\r\n|\r|\n)(?:[^\\"]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\r\n]|\\(?:[btnfrs"\'\\0-7\r\n]|u+[0-9a-fA-F]{4}))*"(?!")|""|\'(?:[^\'\\\r\n]|[\ud800-\udbff][\udc00-\udfff]|\\(?:[btnfrs"\'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4}))\')'
    r"|((?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d[\d_]*[fFdD]?|0[xX][0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?|(?:\d(?:[\d_]*\d)?\.?(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d[\d_]*)?[fFdDlL]?)(?![\w$]))"
    r"|(>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/&|^%<>=!~?:;,.@(){}\[\]])"
    r"|([\s\S])"
)
_JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while _"
).split()
_JAVA_SOFT = "sealed permits record yield non".split()


def java(text: str, g: Grammar):
    ident, literal, block = g.tid("IDENT"), g.tid("LITERAL"), g.tid("TEXTBLOCK")
    words = {w: g.tid(w) for w in _JAVA_WORDS} | {w: literal for w in ("true", "false", "null")} | {w: (ident, g.tid(w)) for w in _JAVA_SOFT}
    out, ops = [], {}
    for m in _JAVA.finditer(text):
        k = m.lastindex
        if k is None:
            continue
        if k == 1:
            out.append(words.get(m.group(1), ident))
        elif k == 4:
            s = m.group(4)
            if s not in ops:
                ops[s] = g.tid(s)
            out.append(ops[s])
        elif k == 5:
            return None
        else:
            out.append(block if m.group(k).startswith('"""') else literal)
    return out


# -- JavaScript ------------------------------------------------------------------------------
_JS_SKIP = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)+")
_JS = re.compile(
    r"((?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|\u200c|\u200d|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)"
    r"|(\"(?:[^\"\\\r\n]|\\(?:\r\n|[^ux\r]|\r|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[^ux\r]|\r|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}))*')"
    r"|((?:0[xX][0-9a-fA-F][0-9a-fA-F_]*n?|0[bB][01][01_]*n?|0[oO][0-7][0-7_]*n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?)(?![\w$]))"
    r"|(#(?:[^\W\d]|\$)(?:\w|\$)*)"
    r"|(>>>=|\.\.\.|===|!==|>>>|<<=|>>=|\*\*=|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^<>=!~?:;,.(){}\[\]])"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-zA-Z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JS_WORDS = (
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return "
    "super switch this throw try typeof var void while with null true false enum"
).split()
_JS_SOFT = "async get set of let static yield await".split()
_BEFORE_REGEX = {
    *"( , = : [ ! & | ? { } ; + - * / % < > ~ ^ => && || ?? == != === !== <= >= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= << >> >>> ** ...".split(),
    *"return typeof case in of delete void throw new else do instanceof yield await".split(),
}


def js(text: str, g: Grammar):
    ident, string, number, private, keyword = (g.tid(x) for x in ("IDENT", "STRING", "NUMBER", "PRIVATE", "KEYWORD"))
    words = {w: (g.tid(w), keyword) for w in _JS_WORDS} | {w: (ident, g.tid(w)) for w in _JS_SOFT}
    asi, pre, regex = g.tid("ASI"), g.tid("PRE"), g.tid("REGEX")
    whole, head, middle, tail = (g.tid(x) for x in ("TEMPLATE", "THEAD", "TMIDDLE", "TTAIL"))
    out, free, i, n, before, depth = [], [], 0, len(text), "", []
    if text.startswith("#!"):
        i = len(text.split("\n", 1)[0])
    ops: dict[str, int] = {}
    while True:
        newline = False
        m = _JS_SKIP.match(text, i)
        if m:
            newline = any(c in m.group(0) for c in "\n\r\u2028\u2029")
            i = m.end()
        if i >= n:
            free.append(True)
            return out, free
        if newline and before in ("return", "break", "continue", "throw"):
            out.append(asi)
            free.append(False)
            before = ";"
        c = text[i]
        token = None
        if c == "`" or (c == "}" and depth and depth[-1] == "`"):
            m = _JS_TEMPLATE.match(text, i + 1)
            if not m:
                return None
            if c == "`":
                token = whole if m.group(1) == "`" else head
                if token == head:
                    depth.append("`")
            else:
                token = tail if m.group(1) == "`" else middle
                if token == tail:
                    depth.pop()
            before = "`" if m.group(1) == "`" else "{"
        elif c == "/" and (not before or before in _BEFORE_REGEX) and (m := _JS_REGEX.match(text, i)):
            token, before = regex, "re"
        else:
            m = _JS.match(text, i)
            if not m:
                return None
            s, k = m.group(0), m.lastindex
            if k == 1:
                token = ident if s not in words else words[s] if before not in (".", "?.") else keyword if s not in _JS_SOFT else ident
                s = s if before not in (".", "?.") else "x"
            elif k == 2:
                token = string
            elif k == 3:
                token = number
            elif k == 4:
                token = private
            else:
                if s not in ops:
                    ops[s] = g.tid(s)
                token = ops[s]
                if s == "{":
                    depth.append("{")
                elif s == "}":
                    if not depth or depth[-1] != "{":
                        return None
                    depth.pop()
                elif newline and s in ("++", "--"):
                    token = pre
            before = s if k in (1, 5) else "lit"
        out.append(token)
        free.append(newline or c == "}")
        i = m.end()


# -- Python ----------------------------------------------------------------------------------
_PY = re.compile(
    r"((?:[^\W\d])\w*)"
    r"|((?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))"
    r"|(\.\.\.|\*\*=|//=|>>=|<<=|!=|->|:=|==|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>()\[\]{},:;.=])"
)
_PY_STRING = re.compile(r"(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"(?:[^\\\"\n]|\\[\s\S])*\"|'(?:[^\\'\n]|\\[\s\S])*')")
_PY_SKIP = re.compile(r"(?:[ \t\f]+|\\\n)+")
_PY_LINE = re.compile(r"([ \t\f]*)(?:#[^\n]*)?(\n|\Z)?")
_PY_WORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield"
).split()
_PY_SOFT = "match case type".split()


def py(text: str, g: Grammar):
    name, number, string, newline, indent, dedent = (g.tid(x) for x in ("NAME", "NUMBER", "STRING", "NEWLINE", "INDENT", "DEDENT"))
    words = {w: g.tid(w) for w in _PY_WORDS} | {w: (name, g.tid(w)) for w in _PY_SOFT}
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, stack, depth, i, n, fresh = [], [0], [], 0, len(text), True
    ops: dict[str, int] = {}
    if "\0" in text:
        return None
    while i < n:
        if fresh and not depth:
            m = _PY_LINE.match(text, i)
            if m.group(2) is not None:
                i = m.end()
                if i >= n and m.group(2) == "":
                    break
                continue
            width = 0
            for c in m.group(1):
                width = 0 if c == "\f" else (width // 8 + 1) * 8 if c == "\t" else width + 1
            i, fresh = m.end(1), False
            if text[i] == "#":
                i = text.find("\n", i) + 1 or n
                fresh = True
                continue
            if width > stack[-1]:
                stack.append(width)
                out.append(indent)
            while width < stack[-1]:
                stack.pop()
                out.append(dedent)
            if width != stack[-1]:
                return None
            continue
        m = _PY_SKIP.match(text, i)
        if m:
            i = m.end()
            if i >= n:
                break
        c = text[i]
        if c == "\n":
            if not depth:
                out.append(newline)
                fresh = True
            i += 1
            continue
        if c == "#":
            i = text.find("\n", i)
            if i < 0:
                i = n
            continue
        m = _PY_STRING.match(text, i)
        if m:
            out.append(string)
            i = m.end()
            continue
        m = _PY.match(text, i)
        if not m:
            return None
        s, k = m.group(0), m.lastindex
        if k == 1:
            out.append(words.get(s, name))
        elif k == 2:
            out.append(number)
        else:
            if s in "([{":
                depth.append(s)
            elif s in ")]}":
                if not depth or depth.pop() + s not in ("()", "[]", "{}"):
                    return None
            if s not in ops:
                ops[s] = g.tid(s)
            out.append(ops[s])
        i = m.end()
    if depth:
        return None
    if out and not fresh:
        out.append(newline)
    return out + [dedent] * (len(stack) - 1)


# -- JSON and XML ----------------------------------------------------------------------------
_JSON = re.compile(
    r"[ \t\r\n]+|(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(true|false|null|[\[\]{}:,])|([\s\S])"
)


def json(text: str, g: Grammar):
    string, number, out = g.tid("STRING"), g.tid("NUMBER"), []
    for m in _JSON.finditer(text):
        k = m.lastindex
        if k == 4:
            return None
        if k:
            out.append(string if k == 1 else number if k == 2 else g.tid(m.group(3)))
    return out


_X = r"[^\s<>/=\"'&;!?,()\[\]{}+*#|@$%^~`\\.\-\d][^\s<>/=\"'&;!?,()\[\]{}+*#|@$%^~`\\]*"
_REF = r"&(?:lt|gt|amp|apos|quot|#\d+|#x[0-9a-fA-F]+);"
_VALUE = rf"\"(?:[^<&\"]|{_REF})*\"|'(?:[^<&']|{_REF})*'"
_XML = re.compile(
    rf"(<\?xml\s[^?]*\?>)|(<!--(?:[^-]|-(?!-))*-->|<\?(?!xml[\s?])[\s\S]*?\?>)|(<!\[CDATA\[[\s\S]*?\]\]>)|(<!DOCTYPE\s(?:[^<>\[\]\"']|\"[^\"]*\"|'[^']*'|\[[\s\S]*?\])*>)"
    rf"|<({_X})((?:\s+{_X}\s*=\s*(?:{_VALUE}))*)\s*(/?)>|</({_X})\s*>|((?:[^<&\]]|\](?!\]>)|{_REF})+)"
)
_ATTRIBUTE = re.compile(rf"({_X})\s*=\s*(?:{_VALUE})")


def xml(text: str, g: Grammar):
    t = {x: g.tid(x) for x in ("DECL", "MISC", "DOCTYPE", "EMPTY", "OPEN", "CLOSE", "TEXT")}
    out, names, i, n = [], [], 0, len(text)
    if text.startswith("\ufeff"):
        text, n = text[1:], n - 1
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", text):
        return None
    while i < n:
        m = _XML.match(text, i)
        if not m:
            return None
        if m.group(1):
            if i:
                return None
            out.append(t["DECL"])
        elif m.group(2):
            out.append(t["MISC"])
        elif m.group(3):
            out.append(t["TEXT"])
        elif m.group(4):
            out.append(t["DOCTYPE"])
        elif m.group(5):
            found = _ATTRIBUTE.findall(m.group(6))
            if len(found) != len(set(found)):
                return None
            out.append(t["EMPTY"] if m.group(7) else t["OPEN"])
            if not m.group(7):
                names.append(m.group(5))
        elif m.group(8):
            if not names or names.pop() != m.group(8):
                return None
            out.append(t["CLOSE"])
        elif names or m.group(9).strip(" \t\r\n"):
            out.append(t["TEXT"])
        i = m.end()
    return None if names else out
