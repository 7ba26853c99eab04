"""Sentences of a text, without the code, traces and marks around them; names of languages."""

from __future__ import annotations

import re

LANGS = ("en", "zh", "de", "fr", "es", "pt", "ru", "ja")

#: What labels call the languages (ISO 639 codes, English names, own names).
NAMES = {
    "en": "en eng english englisch anglais ingles inglés inglês",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 chinesisch chinois hans hant",
    "de": "de deu ger german deutsch allemand alemán alemao",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano spanisch espagnol",
    "pt": "pt por portuguese português portugues portugiesisch",
    "ru": "ru rus russian русский russisch russe",
    "ja": "ja jpn japanese 日本語 日本语 japanisch japonais",
}
_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}

_FENCE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
_TRACE = re.compile(r"(?m)^\s*(?:at [\w.$<>]+\(.*|Caused by:.*|(?:[\w$]+\.)+\w*(?:Exception|Error)\b.*|\.\.\. \d+ more|File \".*|Traceback .*)$")
_LINK = re.compile(r"(?:https?|ftp)://\S+|www\.\S+|\S+@\S+\.\w+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,80}>|<\|\w+\|>|\{@\w+|&\w+;|`")
_SPLIT = re.compile(r"(?<=[。！？])|(?<=[.!?;:])\s+|\n+")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:[a-z0-9][A-Z]|_)[A-Za-z0-9_$]*(?:\(\))?|\w+(?:\.\w+)+(?:\(\w*\))?|\w+\(\)")
_NOISE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]*[0-9][A-Za-z0-9]*|[\d_#*>`|\ufeff\"“”«»()\[\]]+")
_WORD = re.compile(r"[^\W\d_]{2,}|[àaeéoyuóàéè]\b", re.I)
_HAN = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:import|package|return|public|private|protected|const|let|var|def|class)\b.*[;:{(]|\w\(.*\)\s*[;{]|[=!<>]=|&&|\|\||->|=>|::")


def language_of_label(label: str | None) -> str | None:
    """The code a label means, whatever its spelling; None if it names none of the languages."""
    if label is None:
        return None
    x = label.strip().lower()
    return _BY_NAME.get(x) or _BY_NAME.get(re.split(r"[-_ ]", x)[0])


def words_in(text: str) -> int:
    return len(_WORD.findall(_HAN.sub(" ", text)))


def han_in(text: str) -> int:
    """Han and kana characters."""
    return len(_HAN.findall(text))


def bare(sentence: str) -> str:
    """The sentence without names of code, digits and marks, in lower case."""
    x = _NOISE.sub(" ", _NAME.sub(" ", sentence))
    return " ".join(x.split()).strip(" -.,;:!?").lower()


def sentences(text: str, least_words: int = 3, least_han: int = 5) -> list[str]:
    """Full sentences of prose: code blocks, traces, links, headings of one name and code lines are left out."""
    t = _FENCE.sub("\n", text) if "```" in text or "~~~" in text else text
    t = _TRACE.sub("\n", t) if "(" in t or "rror" in t or "xception" in t or "more" in t else t
    t = _TAG.sub(" ", _LINK.sub(" ", t) if "@" in t or ":/" in t or "www." in t else t)
    out = []
    for s in _SPLIT.split(t):
        s = s.strip()
        if not s or _CODE.search(s) and not _HAN.search(s):
            continue
        b = bare(s)
        if han_in(b) >= least_han or words_in(b) >= least_words:
            out.append(s)
    return out
