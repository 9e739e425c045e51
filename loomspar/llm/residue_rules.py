"""Trusted labels for template residue: the few forms from which labels spread.

Texts are judged without code in backticks or fences. Placeholders and filler are told by their
syntax and by the usual filler words, wherever they stand. For pages only single passages (sentences
or lines) get a trusted label: a status line, a notice that scripts are needed (a word for scripts and
a word for switching on), or a failed subject (a word for what was asked for and a word for its
failing). A request to the reader may stand beside these. Whether a document is a page is decided by what all its passages are, after labels have
spread (see ``residue``); so these rules know neither navigation nor courtesy lines nor content.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# fixed values: names of HTML elements, which are no placeholders in angle brackets
HTML_TAGS = set(
    "a abbr address article aside audio b base blockquote body br button canvas caption center cite code col colgroup data dd del details div dl dt em embed fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param picture pre progress q s samp "
    "script section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
# fixed values: the words of the usual Latin filler text
FILLER_WORDS = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco "
    "laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia "
    "deserunt mollit anim id est laborum".split()
)

WORD = re.compile(r"[^\W\d_]+")
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|``[^`]+``|`[^`\n]+`", re.S)
NAME = r"[A-Za-z_][\w.]*(?:[ _-][\w.]+){0,4}"
# each with a literal that every match contains, so that most texts need no search
PLACEHOLDERS = [
    (literal, re.compile(pattern, re.I))
    for literal, pattern in [
        ("{{", r"\{\{\{?[^{}\n]{1,80}\}\}\}?"),
        ("{%", r"\{%[^%\n]{1,80}%\}"),
        ("<%", r"<%[^%\n]{1,80}%>"),
        ("<?", r"<\?[=\w][^?\n]{0,80}\?>"),
        ("{", rf"[$#@]\{{\s*{NAME}[^{{}}\n]{{0,40}}\}}"),
        ("{", r"(?<![\w\\^$#@])\{[A-Za-z_]+(?:[ _][A-Za-z]+){0,3}\}"),
        ("[[", rf"\[\[\s*{NAME}\s*\]\]"),
        ("<<", rf"<<\s*{NAME}\s*>>"),
        ("@@", rf"@@\s*{NAME}\s*@@"),
        ("##", r"##[A-Z][A-Z_]+##"),
        ("%(", r"%\([A-Za-z_]\w*\)[sdifrg]"),
        ("%", r"%(?-i:[A-Z][A-Z_]{2,})%"),
        ("__", r"(?<![A-Za-z0-9_])__[A-Za-z]+(?:_[A-Za-z]+)*__(?![A-Za-z0-9_])"),
        ("«", r"«[a-z]+(?:_[a-z]+)*»"),
        ("‹", r"‹[a-z]+(?:_[a-z]+)*›"),
        ("", r"[\[(<](?:insert|enter|add|your|put|type|fill in|replace with|tbd|todo|placeholder|einfügen|insérer|votre|ihr|ihre|insertar|su|tu)[ :][^\])>\n]{1,50}[\])>]"),
        ("[", r"\[(?:TBD|TODO|TBA|PLACEHOLDER|FIXME|XXX+)\]"),
        ("[", r"\[(?:请|在此|此处)[^\]\n]{1,30}\]"),
        ("【", r"【[^】\n]{0,10}(?:填写|插入|输入)[^】\n]{0,20}】"),
    ]
]
ANGLE = re.compile(r"(?<![<\w])<([A-Za-z][a-z]+(?:[ _-][a-z]+){0,3}|[A-Z]+(?:[ _-][A-Z]+){0,3})>")

FIELD = r"(?:text|title|abstract|summary(?: text)?|procedure|results?|(?:compound |product |item )?description|(?:author )?note|(?:body )?copy|content|name|caption|introduction|intro|paragraph|heading|image|data|section|body(?: text)?|details?|conclusion|discussion)"
# words without which no filler pattern matches
FILLER_HINT = re.compile(
    r" here|dummy|filler|placeholder|sample|publishing|to be |coming|construction|soon|venir|exemple|remplissage|disponible|text|platzhalter|inhalt|texto|contenido|aufbau|asdf|qwer|test |foo|blah|xxx|undefined|null|nan |n/a|object object"
    r"|not yet|no content|no text|no description|heading|example|in this box|示例|占位|此处|内容|敬请|建设"
)
FILLER = re.compile(
    rf"\b{FIELD}\s+goes\s+here\b|\b(?:your|insert|enter|add|type|put|write)\s+(?:an?\s+|the\s+|your\s+)?{FIELD}\s+(?:here\b|in\s+this\s+(?:box|field|space)\b)"
    rf"|\bdummy\s+{FIELD}\s+for\s+layout\b|^\W*(?:dummy|filler|placeholder|sample|example)\s+{FIELD}\W*$"
    rf"|\badd\s+(?:an?\s+|the\s+)?{FIELD}\s+before\s+publishing\b|\(\s*{FIELD}\s+to\s+be\s+(?:written|added|completed|supplied)\s*\)|^\W*{FIELD}\s+(?:not\s+yet|to\s+be)\s+(?:entered|written|added|available|supplied|filled\s+in)\W*$"
    rf"|^\W*no\s+{FIELD}(?:\s+yet)?\W*$|^\W*(?:body\s+text\W*){{2,}}$|^\W*heading\s+(?:one|two|three|four|[1-4])\W*$"
    r"|^\W*this\s+is\s+(?:a\s+|an\s+)?(?:placeholder|dummy|sample)\s+(?:entry|page|text|record|paragraph)\b|^\W*(?:coming\s+soon|under\s+construction|content\s+(?:will\s+be\s+added|coming)\s+soon|page\s+under\s+construction)\W*$"
    r"|^\W*(?:contenu\s+à\s+venir|texte?\s+d[e’']\s*exemple|texte\s+de\s+remplissage|bientôt\s+disponible|beispieltext|blindtext|platzhaltertext|platzhalter|fülltext|inhalt\s+folgt(?:\s+in\s+kürze)?|texto\s+de\s+(?:ejemplo|relleno|prueba|muestra)|contenido\s+(?:próximamente|en\s+preparación|pendiente)|próximamente|en\s+construcción|página\s+en\s+construcción|seite\s+im\s+aufbau)\W*$"
    r"|^\W*hier\s+steht\s+(?:ihr|der|ein|später)\s+[\w ]*text\W*$|^\W*(?:(?:asdf|qwer|qwerty|test|foo|bar|baz|blah?|xxx|abc|123|lkj|jkl)\W+){3,}(?:\w{1,5})?\W*$"
    r"|^\W*(?:(?:undefined|null|nan|none|n/a|object object)\W*){3,}$"
    r"|示例文本|占位(?:文本|符)|此处(?:为|是|填写|输入)|内容(?:待补充|即将推出|待定|正在建设)|敬请期待|正在建设中",
    re.I,
)

# these are looked for in lower case
SCRIPTS = re.compile(r"java\s?-?script|\bjs\b|\bscript(?:s|ing)?\b|\bskripte?\b|\bcookies\b|\b(?:your|ihrem?|votre|su) (?:web )?(?:browser|navigateur|navegador)\b|脚本|浏览器")
SCRIPT_HINTS = ("script", "js", "skript", "cookie", "browser", "naviga", "脚本", "浏览器")  # every match of SCRIPTS holds one
SWITCHED = re.compile(r"\b(?:enabl|activ|aktivier|habilit|requir|disabl|désactiv|deaktiv|allow|need|block|support|nécess|benötig|erforder)|\b(?:turn|switch)(?:ed|ing)? (?:\w+ )?o(?:n|ff)\b|\bis off\b|\b(?:only|not|start) (?:\w+ )?with(?:out)?\b|启用|开启|打开|需要|禁用")
SUBJECT = re.compile(
    r"\b(?:pages?|site|website|record|item|document|file|url|address|entry|resource|content|viewer|server|service|session|request|access|connection|upstream|gateway|host|database|application|browser|permission|seite|datei|eintrag|server\w*|zugriff|dienst|serveur|accès|página|servidor|acceso)\b|页面|网页|服务器|访问|会话",
)
FAILED = re.compile(
    r"\b(?:not|n[’']t|no longer|cannot|can[’']t|unable to|failed to|could not) (?:be )?(?:\w+ )?(?:found|exist|available|displayed|loaded|opened|open|load|shown|respond|answer|connect|find|reach|reached|permitted|supported|valid)\b|\b(?:does|did|do) not (?:exist|respond|answer|have permission)|\bunavailable\b|\bdenied\b|\bforbidden\b|\bexpired\b|\brestricted\b|\btimed? ?-?out\b|\btook too long\b|\b(?:has|was|been) (?:been )?(?:removed|deleted|blocked)\b|\bmoved (?:without|permanently)\b"
    r"|\binternal error\b|\bis (?:down|offline|under maintenance)\b|\bnicht (?:gefunden|verfügbar|erreichbar)\b|\bexistiert nicht\b|\bverweigert\b|\bserverfehler\b|\bintrouvable\b|\bn[’']existe pas\b|\brefusé\b|\bindisponible\b|\bno (?:encontrad[ao]|existe|disponible)\b|\bdenegado\b|\b(?:error|problema|erreur|fehler)\b.{0,30}\b(?:servidor|serveur|server)\b|不存在|找不到|错误|被拒绝|已过期|无法",
)
STATUS = r"(?:bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|payload too large|uri too long|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
STATUS_LINE = re.compile(rf"^\W*(?:(?:http(?:/\d\.\d)?|status|error|fehler|erreur|código|code)\W*)*[45]\d\d(?:\W+{STATUS})?\W*$|^\W*{STATUS}\W*(?:\(?[45]\d\d\)?)?\W*$|^\W*(?:uncaught |unhandled )?[\w.]*(?:error|exception|traceback)\b(?: page| \(most recent call last\))?\W*$")
# fixed values: notices of widespread public software that name neither a subject nor a script
NOTICES = re.compile(r"^\W*(?:something went wrong|an error (?:has )?occurred|checking your browser\b.*|(?:please )?verify (?:that )?you are (?:a )?human\b.*|just a moment|ein fehler ist aufgetreten|une erreur est survenue|ha ocurrido un (?:error|problema)\b.*|系统繁忙)\W*$")
# what a passage of a page does not do: a first person who tells what they did, a need denied, an amount
TOLD = re.compile(
    r"\b(?:we|i)\s+(?!(?:noticed|detected|encountered|needed|failed|tried|could|cannot|can)\b)(?:\w+ed|ran|wrote|sent|took|found|bought|got|made|did|saw)\b|\b(?:wir|ich) haben?\b|\bnous avons\b|\bhemos\b|\b(?:not|no longer) (?:needed|required|necessary)\b|\bworks? without\b|\bn[’']est pas nécessaire\b"
    r"|\bscript (?!(?:is|has|was|must)\b)[a-z]+s\b|\bskript liest\b|\d\s?(?:°\s?C|[mµ]?l\b|[mkµ]?g\b|h\b|[mµ]?mol\b|ppm\b)|\b(?:once|twice|lot|, so|because)\b",
    re.I,
)
# a request to the reader to try another way: it goes with a page and says nothing by itself
REQUEST = re.compile(r"^\W*(?:please|bitte|veuillez|por favor|请)|\b(?:try again|reload|refresh|sign (?:in|out)|log ?(?:in|out)|go back|check the address|contact (?:the|your) \w+|retry|enable it|turn (?:it|them) on)\b")
SENTENCE = re.compile(r"\n+|(?<=[.!?…])\s+|(?<=[。！？])|\s[–—|·]\s|[;；]\s?")


def without_code(text: str) -> str:
    return CODE.sub(" ", text)


def passages(plain: str) -> Iterator[str]:
    """The sentences and lines of a text (given without code), one after the other."""
    for s in SENTENCE.split(plain):
        if s and (s := s.strip()):
            yield s


def has_placeholder(plain: str) -> bool:
    if any(literal in plain and pattern.search(plain) for literal, pattern in PLACEHOLDERS):
        return True
    return "<" in plain and any(not set(re.split(r"[ _-]", m[1].lower())) & HTML_TAGS for m in ANGLE.finditer(plain))


def may_be_latin(plain: str) -> bool:
    low = plain.lower()
    return any(w in low for w in ("dolor", "amet", "eiusmod", "magna", "nostrud", "labor", "ullamco"))


def has_latin_filler(plain: str) -> bool:
    if may_be_latin(plain):
        run = 0
        for w in WORD.findall(plain.lower()):
            run = run + 1 if w in FILLER_WORDS else 0
            if run >= 6:
                return True
    return False


def is_filler(low: str) -> bool:
    return bool(FILLER_HINT.search(low) and FILLER.search(low))


def is_latin(low: str) -> bool:
    w = WORD.findall(low)
    return len(w) >= 3 and sum(x in FILLER_WORDS for x in w) >= 0.8 * len(w)


def is_page_part(low: str) -> bool:
    """Whether a passage alone shows that it belongs to an error page or a notice about scripts."""
    if STATUS_LINE.search(low) or NOTICES.search(low):
        return True
    scripts = any(h in low for h in SCRIPT_HINTS) and SCRIPTS.search(low)
    return bool(scripts and SWITCHED.search(low) or SUBJECT.search(low) and FAILED.search(low)) and not TOLD.search(low)


def is_request(low: str) -> bool:
    return bool(REQUEST.search(low)) and not TOLD.search(low)


def trusted(low: str, latin: bool = True) -> str | None:
    """Of a passage in lower case: ``filler!`` for filler wherever it stands, ``filler`` for Latin filler,
    ``page``, ``request`` or None; ``latin``: whether the text holds words of Latin filler at all."""
    if is_filler(low):
        return "filler!"
    if latin and is_latin(low):
        return "filler"
    if is_page_part(low):
        return "page"
    return "request" if is_request(low) else None
