"""The words a reader sees on the page typeset from markup."""

from __future__ import annotations

import re
import unicodedata

#: Commands whose argument is not printed where they stand.
SILENT = (
    "begin|end|bibitem|bibliography|bibliographystyle|documentclass|usepackage|input|include|includegraphics|hspace|vspace|"
    "color|setlength|setcounter|addtocounter|pagestyle|thispagestyle|graphicspath|newtheorem|url|href|hyperref|textcolor|"
    "[a-zA-Z]*cite[a-zA-Z]*|[a-zA-Z]*ref|nocite"
)
#: Marks that print nothing at all, even inside a word.
UNSEEN = "index|label|glossary|phantom|hphantom|vphantom|marginmark|sindex"
#: Font commands, whose argument continues the word.
FONTS = (
    "emph|textbf|textit|textsl|textsc|textrm|textsf|texttt|textup|textmd|textnormal|underline|uline|mbox|text|em|bf|it|sl|sc|rm|sf|tt|"
    "bfseries|itshape|slshape|scshape|rmfamily|sffamily|ttfamily|normalfont|ensuremath|mathrm|mathbf|mathit"
)
#: Accent commands and their combining characters.
ACCENTS = {
    "'": "\u0301", "`": "\u0300", '"': "\u0308", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307",
    "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "d": "\u0323", "b": "\u0331", "k": "\u0328", "r": "\u030a",
}
#: Commands that print one letter.
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "i", "j": "j"}

#: Characters that the macros of one document print at most: macros that double each other have no end that fits in memory.
MACRO_TEXT = 4_000_000

_DEFINED = re.compile(r"\\(?:(?:re|provide)?newcommand|providecommand|DeclareRobustCommand)\*?\s*\{?\s*\\([A-Za-z@]+)\s*\}?\s*\{((?:[^{}]|\{[^{}]*\})*)\}|\\[gex]?def\s*\\([A-Za-z@]+)\s*\{((?:[^{}]|\{[^{}]*\})*)\}")
_ACCENT = re.compile(r"""\\(?:(['`"^~=.])\s*|([uvHcdbkr])(?:\s+|(?=\{)))(?:\{\s*\\?([A-Za-z])\s*\}|\\?([A-Za-z]))""")
_LETTER = re.compile(r"\\(ss|ae|AE|oe|OE|o|O|aa|AA|l|L|i|j)(?![A-Za-z])(?:\{\}|\s(?=\S))?")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u202a-\u202e]")
_GLUED = re.compile(r"(?<!\\)%[^\S\n]*\n[^\S\n]*%?")
_BROKEN = re.compile(r"(?<=[^\W_])[-\u2010][^\S\n]*\n[^\S\n]*(?:%+[^\S\n]*)*(?=[^\W_])")
_UNSEEN = re.compile(rf"\\(?:{UNSEEN})\*?\s*(?:\[[^\]]*\])*\{{[^{{}}]*\}}")
_SILENT = re.compile(rf"\\(?:{SILENT})(?![A-Za-z])\*?\s*(?:\[[^\]]*\]\s*)*(?:\{{[^{{}}]*\}})?")
_FONT = re.compile(rf"\\(?:{FONTS})(?![A-Za-z])\s*(?=\{{)|\{{\\(?:{FONTS})(?![A-Za-z])\s*")
_UNKNOWN = re.compile(r"\\(?!(?:footnote|caption|item|section|subsection|subsubsection|paragraph|title|author|thanks|chapter)(?![A-Za-z]))[A-Za-z@]+\*?(?=\{)")
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?|\\[^A-Za-z]")
_WORD = re.compile(r"[^\W_]+")


def _compose(m: re.Match) -> str:
    return unicodedata.normalize("NFC", (m[3] or m[4]) + ACCENTS[m[1] or m[2]])


def plain(text: str) -> str:
    """Printed text of a marked-up one, in lower case; punctuation is left in.

    Comment signs, emphasis, citations, index marks, labels, accents, soft and
    line-end hyphens, ties and invisible characters are resolved, macros without
    arguments are replaced by their text. Commented-out text is kept.
    """
    t = text
    if "\r" in t:
        t = t.replace("\r\n", "\n").replace("\r", "\n")
    if not t.isascii():
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    if "\\" in t:
        if "newcommand" in t or "def" in t or "providecommand" in t or "DeclareRobustCommand" in t:
            t = _expand(t)
        t = t.replace("\\-", "").replace("\\/", "").replace("\\\\", " ")
        t = _ACCENT.sub(_compose, t)
        t = _LETTER.sub(lambda m: LETTERS[m[1]], t)
        t = _UNSEEN.sub("", t)
        t = _SILENT.sub(" ", t)
        t = _FONT.sub("", t)
        t = _UNKNOWN.sub("", t)
    if "%" in t:
        t = _GLUED.sub("", t)
    if "-\n" in t or "- \n" in t or "\u2010" in t or "-\t\n" in t:
        t = _BROKEN.sub("", t)
    if "\\" in t:
        t = _COMMAND.sub(" ", t)
    t = t.replace("{", "").replace("}", "")
    if t.isascii():
        return t.lower()
    return unicodedata.normalize("NFC", t.casefold())


def _expand(t: str) -> str:
    macros = {m[1] or m[3]: (m[2] if m[1] else m[4]) for m in _DEFINED.finditer(t)}
    macros = {k: v for k, v in macros.items() if "#" not in v}
    if not macros:
        return t
    use = re.compile(r"\\(" + "|".join(sorted(map(re.escape, macros), key=len, reverse=True)) + r")(?![A-Za-z@])(\{\}|[^\S\n]*)")
    # the macros that a body uses are resolved before it; one that leads back to itself prints nothing there
    done: dict[str, str] = {}
    for first in macros:
        path = {} if first in done else {first: use.finditer(macros[first])}
        while path:
            name, uses = next(reversed(path.items()))
            if inner := next((m[1] for m in uses if m[1] not in done and m[1] not in path), None):
                path[inner] = use.finditer(macros[inner])
            else:
                done[name] = _insert(macros[name], use, done)
                del path[name]
    return _insert(_DEFINED.sub(" ", t), use, done)


def _insert(text: str, use: re.Pattern, macros: dict[str, str]) -> str:
    """``text`` with the macros put in, as long as they make up no more than MACRO_TEXT characters."""
    room = MACRO_TEXT

    def put(m: re.Match) -> str:
        nonlocal room
        body = macros.get(m[1], "")
        if len(body) > room:
            return " "
        room -= len(body)
        return body + ("" if m[2] in ("{}", "") else " ")

    return use.sub(put, text)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the printed text; none of a null text."""
    return _WORD.findall(plain(text)) if text else []
