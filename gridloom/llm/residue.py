"""Template residue, filler, error pages and script notices (problem 8).

Every document is taken apart into its whole text, title, author line, abstract
and sections. Of each part numbers, addresses, dates and reference codes are
masked and the text is hashed; all parts are grouped by hash across documents
and sources. Rules that name a message or a placeholder outright decide for
single texts. A text that recurs widely needs no known wording: it is a template
or a message if the documents that share it differ in title, authors or
abstract, which copies and versions of one article do not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

#: A vague message must recur in so many documents and sources.
RECUR_DOCS, RECUR_SOURCES = 5, 2
#: Titles and author lines meet by chance or belong to one author, and long texts may be copies: without known wording
#: these must recur in so many documents, in one of so many, and in so many sources.
WIDE_DOCS, WIDE_SHARE, WIDE_SOURCES = 20, 10_000, 3
#: Hashes whose verdict a task keeps.
KNOWN = 200_000
#: Words of a recurring whole text from which it may be the copy of an article.
ARTICLE_WORDS = 60
#: Words beside the message that its part may hold (a reference, a signature), and their share of all words; beside placeholders the share alone.
SPARE_WORDS, SPARE_SHARE, SPARE_BESIDE = 4, 0.25, 0.12

#: Names of the fields that templates leave unfilled.
FIELDS = (
    "title|short[ _-]?title|sub[ _-]?title|running[ _-]?title|author|authors|author[ _-]?names?|name|names|abstract|summary|keywords?|affiliations?|institution|"
    "university|department|address|e-?mail|year|date|grant[ _-]?no|grant|funding|results?|methods?|introduction|conclusions?|discussion|data|text|content|"
    "section[ _-]?body|section|body|section[ _-]?title|caption|figure|table|references?|citation|journal|doi|paragraph|description|titel|autor|auteur|titre|resumen|résumé|zusammenfassung|título"
)
_F = rf"(?:the |your |a |an )?(?:(?:doc|paper|article|page|item|meta)[._])?(?:{FIELDS})"
#: Unfilled placeholders, whatever their field, in the notations of template languages.
PLACEHOLDERS = [
    r"\{\{\{?[#&/]?\s*[\w .|'\"()-]+\s*\}?\}\}", r"\$\{\s*[\w .|'\"()-]+\s*\}", r"#\{\s*[\w .|'\"()-]+\s*\}", r"<%[=-]?\s*[\w .|'\"()-]+\s*-?%>",
    r"\{%\s*[\w .|'\"()-]+\s*%\}", r"@@\s*[\w -]+\s*@@", r"%%\s*[\w -]+\s*%%", r"__[A-Za-z][\w -]*__", r"<<\s*[\w -]+\s*>>",
    rf"<{_F}\s*/?>", rf"\[(?:your|insert|add|enter|put|type)\b[\w ,'_-]{{0,60}}\]", rf"<(?:your|insert|add|enter)\b[\w ,'_-]{{0,60}}>",
    rf"\b(?:{FIELDS})[ _-]placeholder\b", rf"\bplaceholder[ _-](?:for )?{_F}\b", rf"\b{_F} (?:goes|comes|here|to be inserted) here\b", rf"\b{_F} (?:goes|comes) in here\b",
    rf"\b(?:type|insert|enter|write|put|add|place) {_F} here\b", rf"\bto be (?:filled in|completed|added|inserted|provided)\s*:?\s*{_F}?\b",
    rf"\binsérer {_F} ici\b", rf"\b(?:saisissez|tapez|écrivez) {_F} ici\b", rf"\bhier {_F} (?:einfügen|eingeben|eintragen)\b", rf"\b(?:escriba|inserte|introduzca) aquí\s*:?\s*{_F}\b", rf"\b(?:escriba|inserte|introduzca) {_F} aquí\b",
    rf"\badd {_F} in this space(?:, at most \d+ words)?", rf"\bclick (?:here )?to add {_F}\b", rf"\[\s*{_F}\s*\]", rf"\b(?:todo|tbd|tba|fixme)\b\s*[:-]?\s*(?:{_F}\b)?",
]
#: Phrases of error pages and failed conversions, numbers masked as 0.
ERRORS = [
    r"\b0 (?:bad gateway|not found|forbidden|unauthorized|bad request|gateway time-?out|internal server error|service (?:temporarily )?unavailable|too many requests|gone)\b",
    r"\b(?:http )?error 0\b(?:\s*:?\s*(?:the )?(?:service|page|server|file|document) (?:is|was|could) not (?:be )?(?:available|found|reached|located)(?: at the moment)?)?", r"\bthe service is (?:currently |temporarily )?(?:not available|unavailable)(?: at the moment)?",
    r"\berreur 0\b\s*:?\s*(?:page introuvable)?", r"\bpage introuvable\b", r"\ble service est (?:momentanément |actuellement )?(?:indisponible|inaccessible)\b(?: \(code 0\))?",
    r"\bel servicio no está disponible\b(?: por ahora)?(?: \(código 0\))?", r"\bpágina no encontrada\b", r"\berror 0\s*:?\s*no se (?:encontró|ha encontrado) (?:la página|el archivo)\b", r"\bno se (?:encontró|ha encontrado) (?:la página|el archivo)\b", r"\berror 0\s*:?\s*página no encontrada\b",
    r"\b(?:fehler 0\s*:?\s*)?(?:die )?seite (?:wurde )?nicht gefunden\b", r"\bder dienst ist (?:derzeit|zurzeit|zur zeit|momentan|im moment) nicht (?:verfügbar|erreichbar)\b(?: \((?:code|kennung) 0\))?", r"\bfehler 0\b",
    r"\btoo many requests\b(?:\. wait 0 seconds and try again)?", r"\binternal error while [\w ]{3,40}(?: \(code 0\))?", r"\binternal server error\b",
    r"\bconversion failed\b(?:: no output was produced for job 0)?", r"\bno output was produced for job 0\b", r"\bthis (?:paper|page|article|document) has been (?:moved|deleted|removed)(?: or (?:moved|deleted|removed))?\b(?:\. go back to the start page)?",
    r"\baccess denied\b(?:\. your session has (?:run out|expired), sign in again)?", r"\bzugriff verweigert\b(?:, bitte (?:neu|erneut) anmelden)?", r"\baccès (?:refusé|interdit)\b(?:[,.;:]? ?veuillez vous (?:re)?connecter(?: à nouveau)?)?",
    r"\bacceso (?:denegado|prohibido)\b(?:[,.;:]? ?(?:inicie|vuelva a iniciar) sesión(?: de nuevo| otra vez)?)?", r"\b(?:ihre|die) sitzung ist abgelaufen\b", r"\b(?:su|la) sesión ha (?:caducado|expirado)\b", r"\b(?:votre|la) session (?:a|est) expirée?\b",
    r"\bzu viele anfragen\b(?:[,.;:]? ?bitte [\w ]{0,40})?", r"\btrop de requêtes\b(?:[,.;:]? ?[\w ]{0,40})?", r"\bdemasiadas (?:solicitudes|peticiones)\b(?:[,.;:]? ?[\w ]{0,40})?",
    r"\b(?:diese|die) (?:seite|datei|arbeit) (?:wurde|ist) (?:verschoben|gelöscht|entfernt)(?: oder (?:verschoben|gelöscht|entfernt))?\b[\w ]{0,40}", r"\b(?:cet article|cette page|ce document) a été (?:déplacée?|supprimée?)(?: ou (?:déplacée?|supprimée?))?\b[\w ]{0,40}",
    r"\b(?:este|esta|el|la) (?:artículo|página|documento) (?:se ha|ha sido|fue) (?:movid[oa]|eliminad[oa]|borrad[oa])(?: o (?:movid[oa]|eliminad[oa]|borrad[oa]))?\b[\w ]{0,40}",
    r"\b(?:interner|schwerer) (?:server)?fehler\b[\w ]{0,40}(?: \((?:code|kennung) 0\))?", r"\berreur interne\b[\w ]{0,40}(?: \(code 0\))?", r"\berror interno\b[\w ]{0,40}(?: \(código 0\))?",
    r"\bumwandlung fehlgeschlagen\b[\w :,]{0,60}", r"\b(?:la )?conversion a échoué\b[\w :,]{0,60}", r"\bla conversión ha fallado\b[\w :,]{0,60}",
    r"\bdie angeforderte (?:datei|seite) (?:wurde|konnte) [\w ]{0,40}nicht gefunden(?: werden)?\b", r"\ble fichier demandé est introuvable\b[\w ]{0,40}", r"\bno se ha encontrado (?:el archivo|la página)\b[\w ]{0,40}", r"\byour session has (?:run out|expired)\b(?:, sign in again)?",
    r"\bthe requested (?:file|page|url|document|resource) (?:could not be (?:located|found)|was not found)(?: on this server)?",
    r"\btraceback \(most recent call last\)\s*:?(?:\s*file \"[^\"]*\", line 0)?(?:,? in [\w<>]+)?(?:\s*\w+error\s*:?\s*(?:'[^']*')?)?", r"\b(?:key|value|type|attribute|index|name|runtime)error\s*:\s*'[^']*'",
    r"! latex error\s*:?\s*file [`'‘][^'’]*['’] not found\b(?:\.\s*type x to quit or (?:<return>|return) to proceed)?", r"\btype x to quit or <return> to proceed\b",
]
#: Phrases of notices that scripts are required.
SCRIPTS = [
    r"\b(?:please )?(?:enable|turn on|activate|allow) (?:javascript|scripts?|scripting)\b[\w ,]{0,60}", r"\b(?:this|the) (?:viewer|page|site|article|application) (?:needs|requires) (?:javascript|scripts)\b",
    r"\b(?:you have )?(?:javascript|scripts?|scripting) (?:is |are )?(?:switched off|turned off|disabled)\b(?:; the formulas and the text cannot be shown)?", r"\bthe formulas and the text cannot be shown\b",
    r"\byour browser does not (?:run|support) (?:javascript|scripts)\b(?:, so nothing can be displayed here)?", r"\bnothing can be displayed here\b",
    r"\bchecking your browser before you continue\b", r"\bscripts and cookies must be allowed\b", r"\bturn on scripting in your browser and reload\b",
    r"\b(?:bitte )?(?:schalten|aktivieren) sie (?:bitte )?javascript(?: ein)?\b(?:, um [\w ]{0,50})?", r"\bdiese (?:ansicht|seite) (?:braucht|benötigt) (?:aktive skripte|javascript)\b(?: im browser)?",
    r"\bveuillez activer (?:javascript|les scripts)\b[\w ]{0,50}", r"\bcette page ne fonctionne pas sans (?:scripts|javascript)\b",
    r"\b(?:active|habilite|active usted) (?:javascript|los scripts)\b[\w ]{0,50}", r"\besta (?:página|vista) (?:necesita|requiere|no funciona sin) (?:javascript|scripts|guiones)\b[\w ]{0,40}", r"\b(?:debe|necesita) activar javascript\b[\w ]{0,40}", r"\besta (?:página|vista) necesita que el navegador permita (?:javascript|scripts)\b",
]
#: What a page's visitor or its parts want or lack, and how messages in several languages say so.
_THING = (
    r"(?:page|gateway|server|service|request|file|document|resource|connection|session|url|website|site|host|upstream|proxy|link|login|"
    r"seite|dienst|anfrage|datei|verbindung|sitzung|serveur|fichier|connexion|requête|página|servidor|archivo|conexión|sesión|solicitud|pagina|servizio|richiesta|connessione|sessione|sito)"
)
_FAULT = (
    r"(?:not (?:be )?found|timed out|time-?out|unavailable|unreachable|refused|expired|denied|forbidden|failed|not available|not respond(?:ing)?|overloaded|no longer exists?|offline|interrupted|"
    r"nicht (?:gefunden|verfügbar|erreichbar)|abgelaufen|überlastet|verweigert|introuvable|indisponible|inaccessible|expirée?|refusée?|no (?:encontrad[oa]|disponible)|caducad[oa]|rechazad[oa]|non (?:trovat[oa]|disponibile|raggiungibile)|scadut[oa]|rifiutat[oa])"
)
_SCRIPT = r"(?:javascript|java-script|js|scripts?|scripting|cookies|skripte?|guiones)"
_WANTED = (
    r"(?:enabled?|disabled?|requires?|required|must|needs?|needed|turned (?:on|off)|turn on|switched (?:on|off)|switch on|activated?|allow(?:ed)?|blocked|missing|aktivier\w*|deaktiviert|erforderlich|benötigt|nötig|eingeschaltet|ausgeschaltet|"
    r"activée?s?|activer|désactivée?s?|nécessaires?|requis|activ(?:ar|e|ad[oa]s?)|desactivad[oa]s?|necesari[oa]s?|requiere|necesita|attiv(?:are|at[oi])|disattivat[oi]|necessari[oa]?|richiest[oi]|abilitare)"
)
_SENTENCE = r"[\w ,'()-]{0,60}"
ERRORS += [rf"\b{_THING}\b{_SENTENCE}?\b{_FAULT}\b{_SENTENCE}", rf"\b{_FAULT}\b{_SENTENCE}?\b{_THING}\b{_SENTENCE}"]
SCRIPTS += [rf"\b{_SCRIPT}\b{_SENTENCE}?\b{_WANTED}\b{_SENTENCE}", rf"\b{_WANTED}\b{_SENTENCE}?\b{_SCRIPT}\b{_SENTENCE}"]
#: Words that let a recurring short text count as a message.
VAGUE = re.compile(r"\b(?:javascript|scripts?|browser|server|cookies?|unavailable|not found|access denied|session|placeholder|template|reload|timed? out|webmaster|redirect\w*|captcha|introuvable|skripte|navegador|navigateur|servidor|serveur)\b")
#: Words of the customary Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint "
    "occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vero porro modi odio ullam natus fuga cursus "
    # the passages of Cicero that the usual text was cut from
    "perspiciatis unde omnis iste error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta "
    "explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque quisquam dolorem adipisci numquam eius tempora incidunt magnam "
    "aliquam quaerat minima nostrum exercitationem corporis suscipit laboriosam aliquid commodi consequatur autem vel eum iure quam nihil molestiae illum quo at accusamus iusto dignissimos "
    "ducimus blanditiis praesentium voluptatum deleniti atque corrupti quos quas molestias excepturi occaecati cupiditate provident similique mollitia animi dolorum harum quidem rerum facilis "
    "expedita distinctio nam libero tempore cum soluta nobis eligendi optio cumque impedit minus quod maxime placeat facere possimus assumenda repellendus temporibus quibusdam officiis debitis "
    "necessitatibus saepe eveniet voluptates repudiandae recusandae itaque earum hic tenetur a sapiente delectus reiciendis voluptatibus maiores alias perferendis doloribus asperiores repellat "
    # the words of the usual generators
    "ac accumsan aenean aliquet ante aptent arcu auctor augue bibendum class commodo condimentum congue conubia convallis cras cubilia curabitur curae cursus dapibus diam dictum dictumst "
    "dignissim dis donec dui efficitur egestas eget eleifend elementum erat eros etiam euismod facilisi facilisis fames faucibus felis fermentum feugiat finibus fringilla fusce gravida habitant "
    "habitasse hac hendrerit himenaeos iaculis imperdiet inceptos integer interdum justo lacinia lacus laoreet lectus leo libero ligula litora lobortis luctus maecenas massa mattis mauris metus mi "
    "molestie montes morbi mus nascetur natoque nec netus nibh nisl nostra nullam nunc orci ornare parturient pellentesque penatibus per pharetra phasellus placerat platea posuere potenti praesent "
    "pretium primis proin pulvinar purus quisque rhoncus ridiculus risus rutrum sagittis sapien scelerisque sem semper senectus sociis sociosqu sodales sollicitudin suscipit suspendisse taciti tellus "
    "tempus tincidunt torquent tortor tristique turpis ullamcorper ultrices ultricies urna varius vehicula vel venenatis vestibulum vitae vivamus viverra volutpat vulputate".split()
)
#: Words that stand for text when repeated over and over.
STAND_INS = frozenset("dummy text blah bla word words filler placeholder foo bar baz lorem ipsum etc content sample test testing tbd xxx todo abc asdf texto texte mot wort palabra ble".split())
#: Notes that stand alone where the text is missing, and stand-ins that nothing else is meant by.
UNDONE = frozenset("tbd tba todo fixme".split())
PLAIN_STAND_INS = frozenset("dummy blah bla lorem asdf xxx".split()) | UNDONE

_HEAD = re.compile(r"<head>.*?</head>", re.S | re.I)
_TAG = re.compile(r"</?(?:html|body|h\d|p|hr|br|div|noscript|span|center|pre)\b[^<>]*>", re.I)
_URL = re.compile(r"\b(?:https?://|www\.)\S+")
_MAIL = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]+\.[\w.]+\b")
#: Numbers, and dates written with them.
_NUMBER = re.compile(r"\d+(?:[-/.,:]\d+)*")
#: Names of the months in five languages.
MONTHS = frozenset(
    "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre "
    "novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre gennaio febbraio aprile maggio giugno luglio settembre ottobre dicembre".split()
)
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS), re.I)
_MESSAGE = re.compile("|".join(f"(?:{p})" for p in [*ERRORS, *SCRIPTS]), re.I)
_FILLER_COMMAND = re.compile(r"\\(?:lipsum|blindtext|Blindtext|blinddocument|kant|zeile)\*?(?:\[[^\]]*\])*")
_REFERENCE = re.compile(r"\bref\.?\s*:?\s*[\w-]+\b|\b\w+/0\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_BRACKET = re.compile(r"\{\{|[$#]\{|<%|\{%|@@|%%|__|<<|<\w[\w -]*/?>|\[(?:your|insert|add|enter|put|type)\b")
#: One of these stands in every text that the pattern fits.
_MARKS = ("{{", "${", "#{", "<", "{%", "@@", "%%", "__", "[")
#: Words of the statements and headings that real articles share.
CUSTOMARY = re.compile(
    r"\b(?:conflicts?|competing|interests?|acknowledg\w*|thank\w*|grateful|gratitude|fund(?:ed|ing)|grants?|supported by|licen[cs]\w*|copyright|rights reserved|on (?:reasonable )?request|availab(?:le (?:at|from|in|on)|ility)|"
    r"contribut\w*|ethic\w*|consent|danken|dank|danksagung|interessenkonflikte?|gefördert|förderung|lizenz|remerci\w*|intérêts|financé\w*|soutenu\w*|agradec\w*|intereses|financiad[oa]|apoyad[oa]|licencia|"
    r"editorial|letters? to the editor|book reviews?|erratum|corrigendum|preface|foreword)\b"
)
_MARKUP = re.compile(r"\\(?:[a-zA-Z]+\*?(?:\s?\[[^\]]*\])*(?:\s?\{[^{}]*\})*|[^a-zA-Z])")
#: Every word that a rule above spells.
PHRASE_WORDS = frozenset(_WORD.findall(re.sub(r"\\[a-zA-Z]", " ", " ".join([FIELDS, *PLACEHOLDERS, *ERRORS, *SCRIPTS])).lower()))

_KEPT_PERCENT = re.compile(r"\{%[^%\n]*%\}|<%[^%\n]*%>|(?<![\w%])%%[A-Za-z][\w -]*%%(?!%)")
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|Verbatim|minted|alltt|comment)\*?\}.*?\\end\{\1\*?\}|\\verb\*?([^\w\s])[^\n]*?\2|\\lstinline\*?(?:\[[^\]]*\])?([^\w\s{])[^\n]*?\3|\\iffalse\b.*?(?:\\fi\b|\Z)", re.S)
_NOTE = re.compile(r"\\(?:todo|note|fixme|marginpar|marginnote|comment)(?:\[[^\]]*\])?\{(?:[^{}]|\{[^{}]*\})*\}")
_SECTION = re.compile(r"\\(section|chapter)\*?\s*(?:\[[^\]]*\])?\s*\{")
_STOP = re.compile(r"\\(?:section|chapter)\*?\s*(?:\[[^\]]*\])?\s*\{|\\begin\{thebibliography\}|\\bibliography\{|\\appendix\b|\\end\{document\}")
_PART = {"title": re.compile(r"\\title\s*(?:\[[^\]]*\])?\s*\{"), "author": re.compile(r"\\author\s*(?:\[[^\]]*\])?\s*\{")}
_ABSTRACT = re.compile(r"\\begin\{abstract\}(.*?)(?:\\end\{abstract\}|\Z)", re.S)
_DROP = re.compile(r"\\(?:label|index|cite\w*|ref|eqref|input|include|bibliographystyle|vspace|hspace|thanks|maketitle|newpage|clearpage|noindent|centering|par|bigskip|medskip|smallskip)\*?(?![A-Za-z])(?:\[[^\]]*\])*(?:\{[^{}]*\})?")
_DRESS = re.compile(r"\\textcolor\s*\{[^{}]*\}|\\color\s*\{[^{}]*\}|\\(?:emph|textbf|textit|texttt|underline|textsc|large|Large|small|begin\{center\}|end\{center\}|begin\{quote\}|end\{quote\})(?![A-Za-z])")


def _braced(text: str, at: int) -> str:
    """What stands from ``at`` on to the brace that closes; the line if none does."""
    depth, i = 1, at
    for m in re.finditer(r"\\.|[{}]", text[at:], re.S):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return text[at : at + m.start()]
        i = at + m.end()
    return text[at:].split("\n", 1)[0] if i else ""


def parts_of(text: str) -> list[tuple[str, str]]:
    """``(part, text)``: title, author, abstract, sections and whole.

    The whole is taken of every text without sections, whatever its length, and
    of every one with the tag of an HTML page, wherever it stands. The name of a
    part that ends where the text is cut off begins with "cut".
    Comments, verbatim and listing examples, switched-off passages and authors'
    notes are taken out first; placeholders that use the comment sign are kept.
    """
    t = _INVISIBLE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    t = _VERBATIM.sub(" ", t)
    if "%" in t:
        kept: list[str] = []
        if "{%" in t or "<%" in t or "%%" in t:
            t = _KEPT_PERCENT.sub(lambda m: kept.append(m[0]) or f"\x00{len(kept) - 1}\x00", t)
        t = _COMMENT.sub("", t)
        if kept:
            t = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], t)
    t = _NOTE.sub(" ", t)
    out = []
    for name, pattern in _PART.items():
        for m in pattern.finditer(t):
            inner = _braced(t, m.end())
            out.append((name if t.startswith("}", m.end() + len(inner)) else f"cut {name}", inner))
    out += [("abstract" if m[0].endswith("\\end{abstract}") else "cut abstract", m[1]) for m in _ABSTRACT.finditer(t)]
    heads = list(_SECTION.finditer(t))
    for m in heads:
        heading = _braced(t, m.end())
        start = m.end() + len(heading) + 1
        stop = _STOP.search(t, start)
        out.append(("section" if stop else "cut section", t[start : stop.start() if stop else len(t)]))
    body = t
    if "\\begin{document}" in t:
        body = t.split("\\begin{document}", 1)[1].split("\\end{document}", 1)[0]
    if not heads or "<html" in t.lower():
        torn = t.count("\\begin{") != t.count("\\end{") or "\\documentclass" in t and "\\end{document}" not in t
        out.append(("cut whole" if torn else "whole", body))
    return out


def masked(text: str) -> str:
    """Plain lower-case text of a part with numbers, addresses and dates masked."""
    t = _DROP.sub(" ", text)
    if "</" in t:
        t = _HEAD.sub(" ", t)
        t = _TAG.sub(" . ", t)  # what stands in different elements is no one phrase
    t = _DRESS.sub(" ", t).replace("\\_", "_").replace("\\#", "#").replace("\\$", "$")
    if "www." in t or "://" in t:
        t = _URL.sub(" url ", t)
    if "@" in t:
        t = _MAIL.sub(" mail ", t)
    t = _NUMBER.sub("0", t)
    return " ".join(t.lower().split())


def _spare(rest: str) -> int:
    return len(_WORD.findall(_REFERENCE.sub(" ", rest)))


def _keyboard(words: list[str], text: str) -> bool:
    """Rows of keys struck at random: hardly a word with the vowels of language."""
    letters = "".join(words)
    if len(letters) < 30:
        return False
    home = sum(map(letters.count, "asdfghjklqwer")) / len(letters)
    return home > 0.97 and sum(map(letters.count, "aeiouyäöüéèàíóú")) / len(letters) < 0.32


def classify(text: str, words: list[str] | None = None) -> str | None:
    """``placeholder``, ``filler``, ``message`` or ``vague`` for a masked text (of the given words), else None."""
    if not text:
        return None
    words = _WORD.findall(text) if words is None else words
    marked = any(map(text.__contains__, _MARKS)) and _BRACKET.search(text) is not None
    # a text of messages and placeholders consists of their words, or has the marks of a template
    phrases = marked or sum(map(PHRASE_WORDS.__contains__, words)) >= 0.5 * len(words)
    rest = _PLACEHOLDER.sub(" ", text) if phrases else text
    if rest != text and _spare(rest) <= SPARE_BESIDE * len(words):
        return "placeholder"
    bare = _FILLER_COMMAND.sub(" ", text) if "\\" in text else text
    words = _WORD.findall(bare) if bare is not text else words
    if bare != text and len(words) <= SPARE_WORDS:
        return "filler"
    if words and set(words) <= UNDONE or len(words) == 1 and len(words[0]) >= 4 and not words[0].strip("x"):
        return "filler"
    if len(words) >= 2:
        if set(words) <= STAND_INS | UNDONE and words[0] in PLAIN_STAND_INS:
            return "filler"
        x = sum(not w.strip("x") for w in words)
        if x >= 0.9 * len(words) and sum(map(len, words)) >= 8:
            return "filler"
        if len(set(words)) <= 2 and words[0] in STAND_INS and len(words) >= 5:
            return "filler"
        if len(words) >= 6 and sum(map(LATIN.__contains__, words)) >= 0.85 * len(words) and len(set(words) & LATIN) >= 3:
            return "filler"
        if _keyboard(words, bare):
            return "filler"
    if not phrases:
        return None
    rest = _MESSAGE.sub(" ", text)
    if rest != text:
        if _spare(_PLACEHOLDER.sub(" ", rest)) <= max(SPARE_WORDS, SPARE_SHARE * len(_WORD.findall(text))):
            return "message"
    if len(words) <= 25 and len(set(VAGUE.findall(text))) >= 2:
        return "vague"
    return None


def verdict_of(text: str) -> str | None:
    """What :func:`classify` says of a masked text, else what it is if it recurs."""
    words = _WORD.findall(text)
    return classify(text, words) or _open(text, words)


def _open(text: str, words: list[str]) -> str | None:
    """``text`` or ``long`` for a masked text that is residue if it recurs in otherwise different documents, else None.

    Markup alone, a single word and customary statements are not.
    """
    words = len(_WORD.findall(_MARKUP.sub(" ", text)) if "\\" in text else words)
    if words < 2 or CUSTOMARY.search(text):
        return None
    return "text" if words < ARTICLE_WORDS else "long"


def recurrence_key(text: str) -> bytes:
    """The hash that a masked text is grouped by: words with digits, and months beside them, count as one number."""
    if "0" not in text:
        return _digest(text)
    out, last = [], ""
    words = ["0" if "0" in w else w for w in text.split(" ")]
    for w, after in zip(words, [*words[1:], ""]):
        if w.strip(",.") in MONTHS and "0" in (last, after):
            w = "0"
        if w != "0" or last != "0":
            out.append(w)
        last = w
    return _digest(" ".join(out))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()


def residue(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """``(doc_id,)`` of the documents of which a part is residue instead of content.

    Null, empty, blank, short or cut-off texts are no cases as such; repeated
    rows give one case, a null source counts as one source, a null id stays.
    One narrow pass takes the documents apart and leaves a row of hashes for
    every part: of its masked text, and of the title, authors and abstract beside
    it. The verdict belongs to the hash: a text is classified where a task first
    meets it, so that texts need not be moved to their groups. Rows are counted
    by hash with partial results before the shuffle; only
    hashes met often are counted exactly. What is cut off may be equal by chance:
    it is a case if its text is one, but adds nothing to the counts.
    """
    schema = f"d {docs.schema[doc_id].dataType.simpleString()}, s {docs.schema[source].dataType.simpleString()}, key binary, part string, verdict string, title bigint, author bigint, abstract bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, str | None] = {}  # equal texts have equal verdicts: one classification per text and task
        for batch in batches:
            rows = []
            if len(known) > KNOWN:
                known.clear()
            for d, t, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found, beside = {}, {}
                for part, body in parts_of(t) if t and t.strip() else ():
                    if m := masked(body):
                        key = recurrence_key(m)
                        beside.setdefault(part.removeprefix("cut "), int.from_bytes(key[:8], "little", signed=True))
                        own = key if "0" not in m else _digest(m)
                        if own not in known:
                            known[own] = verdict_of(m)
                        if verdict := known[own]:
                            found.setdefault((key, part), verdict)
                for (key, part), verdict in found.items():
                    rows.append((d, s, key, part, verdict, *(None if k == part else beside.get(k) for k in ("title", "author", "abstract"))))
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [batch.column(0).type, batch.column(2).type, pa.binary(), pa.string(), pa.string(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["d", "s", "key", "part", "verdict", "title", "author", "abstract"])

    wide = max(WIDE_DOCS, docs.select(doc_id).count() // WIDE_SHARE)
    parts = cut(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(source).alias("s")).mapInArrow(run, schema), "p8-parts")
    loose = parts.filter("verdict in ('vague', 'text', 'long')")
    counted = loose.filter("verdict = 'vague' or part not like 'cut%'")
    often = counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RECUR_DOCS).select("key")
    one, beside = F.struct("d", "s"), ("title", "author", "abstract")
    groups = counted.join(often, "key", "left_semi").groupBy("key").agg(
        F.min("verdict").alias("verdict"), F.max(~F.col("part").isin("title", "author")).alias("body"), F.count_distinct(one).alias("docs"), F.count_distinct(F.struct("s")).alias("sources"),
        F.count_distinct(F.when((F.col("part") == "whole") & F.coalesce(*beside).isNull(), one)).alias("alone"), *(F.count_distinct(k).alias(k) for k in beside),
    )
    # of the three, two must differ: versions may change one, a template may fill one everywhere
    apart = F.col("title") + F.col("author") + F.col("abstract") - F.greatest(*beside) - F.least(*beside)
    message = (F.col("verdict") == "vague") | F.col("body") & (apart >= RECUR_DOCS) | (F.col("verdict") == "text") & (F.col("alone") >= RECUR_DOCS)
    recurs = (F.col("docs") >= RECUR_DOCS) & (F.col("sources") >= RECUR_SOURCES) & message
    widely = (F.col("docs") >= wide) & (F.col("sources") >= WIDE_SOURCES) & ((apart >= wide) | (F.greatest(*beside) == 0))
    cases = groups.filter(recurs | widely).select("key")
    outright = parts.filter("verdict in ('placeholder', 'filler', 'message')").select("d")
    return outright.unionAll(loose.join(cases, "key", "left_semi").select("d")).select(F.col("d").alias(doc_id)).distinct()
